"""N-gram Jaccard join: exact links at a Jaccard threshold between sets of word shingles.

The join is a prefix-filter join that uses the relations between sets twice:

* *blocks of index lists are skipped by position*: each set is ordered by (document frequency, hash); only
  the first ``n - ceil(t n) + 1`` entries are indexed, and entries that occur in one set alone are
  never posted.  A list is laid out by size and position in blocks.  A pair of blocks is skipped whole where the smallest sizes
  and the latest positions in them leave too little room behind the common entry for the needed overlap; only the
  entries of the other pairs are looked at;
* *answers come from a similar set's answers*: equal sets are one node; the rest are gathered
  into stars around a set that is already known to be within the threshold.  Distances between
  star centres are computed once, and the triangle inequality of the Jaccard distance tells which
  members can still link.  Only those are compared, in blocks: the overlaps of the member nearest to the centre with the
  whole other block are computed, and every other member's overlaps are those, changed by the entries in which
  it differs.  No pair of members is ever a row.

A first pass (the screen) drops every document that cannot have a partner: of two linked sets the
first entries in hash order share a known minimum number, so a document with fewer entries that
occur twice anywhere is done.  Frequencies are then counted for the rest.

``jaccard_components`` needs the links between components alone, leaves the other pairs of one
component uncompared, and stops at the first link between two stars.  ``jaccard_join`` and ``jaccard_links`` find every link: the same index without
regard to components names the pairs of stars whose members may link, and their sets are compared in
blocks.  There no threshold, cap or sample drops a link.  Hashes have 64 bits.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .common import list_array, materialize, mix, release, shingle_sets, slices, small, spread_join, table
from .components import connected_components

BLOCK = 512
LIST_ROWS = 20_000
DOCS_PER_BUCKET = 4000
BUCKET_BYTES = 8 << 20
BLOCK_TOKENS = 400_000
POSITION_BLOCK = 64
PAIRS_PER_SET = 2000


def _least_overlap(n, percent: int):
    """Shared entries that a set of n needs with any linked set."""
    return -(-n * percent // 100)


def _more(n, percent: int):
    return 1 + n * 12 // 100


def _screen_rows(width: int, percent: int, buckets: int):
    """Arrow batches (doc_id, text) -> packed (bucket, tok, doc, need, cnt, size) rows.

    Entries that occur twice within a batch are counted here and sent once, so a very common
    entry reaches a bucket at most once for each batch.
    """

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole)):
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            sets = shingle_sets(batch.column(1), width)
            n = np.array([len(s) for s in sets], np.int64)
            take = np.minimum(n, n - _least_overlap(n, percent) + _more(n, percent))
            need = _more(_least_overlap(n, percent), percent)
            tok = np.concatenate([s[:k] for s, k in zip(sets, take.tolist())]) if len(sets) else np.zeros(0, np.uint64)
            row = np.repeat(np.arange(len(ids)), take)
            order = np.argsort(tok, kind="stable")
            tok, row = tok[order], row[order]
            head = np.flatnonzero(np.r_[True, tok[1:] != tok[:-1]]) if len(tok) else np.zeros(0, np.int64)
            runs = np.diff(np.r_[head, len(tok)])
            twice = np.repeat(runs > 1, runs)
            local = np.bincount(row[twice], minlength=len(ids)).astype(np.int32)
            doc = np.where(runs > 1, np.int64(-1), ids[row[head]] if len(tok) else head)
            needed = np.where(runs > 1, 0, need[row[head]] if len(tok) else head).astype(np.int32)
            tok = tok[head]
            # a set's own bucket can't be told from its first entries' low bits: they are uniform
            b = (tok % np.uint64(buckets)).astype(np.int32)
            order = np.lexsort((doc, b))
            tok, doc, needed, b = tok[order], doc[order], needed[order], b[order]
            cut = np.searchsorted(b, np.arange(buckets + 1))
            full = np.flatnonzero(np.diff(cut))
            rows = [(int(k), tok[x:y].tobytes(), doc[x:y].tobytes(), needed[x:y].tobytes(), b"", b"") for k, x, y in zip(full, cut[full], cut[full + 1])]
            at = int(mix(np.array([ids[0] if len(ids) else 0], np.int64).view(np.uint64))[0] % np.uint64(buckets))
            rows.append((at, b"", ids.tobytes(), need.astype(np.int32).tobytes(), local.tobytes(), n.tobytes()))
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32())] + [pa.array(c, pa.binary()) for c in cols[1:]], ["bucket", "tok", "doc", "need", "cnt", "size"])
        release()

    return run


def _count_shared(pdf: pd.DataFrame) -> pd.DataFrame:
    """One bucket: entries that arrive twice are shared; the count per document, and the documents' own rows."""
    own = pdf[pdf["cnt"].str.len() > 0]
    out = [(np.frombuffer(r.doc, np.int64), np.frombuffer(r.cnt, np.int32), np.frombuffer(r.need, np.int32), np.frombuffer(r.size, np.int64)) for r in own.itertuples()]
    tok = np.frombuffer(b"".join(pdf["tok"]), np.uint64)
    rest = pdf[pdf["tok"].str.len() > 0]
    doc, need = np.frombuffer(b"".join(rest["doc"]), np.int64), np.frombuffer(b"".join(rest["need"]), np.int32)
    if len(tok):
        order = np.argsort(tok)
        tok, doc, need = tok[order], doc[order], need[order]
        same = tok[1:] == tok[:-1]
        hit = (np.r_[False, same] | np.r_[same, False]) & (need > 0)
        ids, at, n = np.unique(doc[hit], return_index=True, return_counts=True)
        out.append((ids, n.astype(np.int32), need[hit][at], np.full(len(ids), -1, np.int64)))
    cols = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in zip(*out)] or [np.zeros(0, np.int64)] * 4
    release()
    return pd.DataFrame({"doc_id": cols[0], "shared": cols[1].astype(np.int64), "need": cols[2].astype(np.int64), "size": cols[3].astype(np.int64)})


def _set_rows(width: int):
    def run(batches):
        for batch in (part for whole in batches for part in slices(whole)):
            sets = shingle_sets(batch.column(1), width)
            other = [int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).min().view(np.int64)) if len(s) else 0 for s in sets]
            both = [mix(s * np.uint64(2) + np.uint64(1)).sum(dtype=np.uint64).tobytes() + mix(s ^ np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64).tobytes() + len(s).to_bytes(4, "big") for s in sets]
            signed = [s.view(np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(both, pa.binary()), pa.array([int(s[0]) if len(s) else 0 for s in signed], pa.int64()), pa.array(other, pa.int64()), list_array(signed)],
                ["doc_id", "n", "set_key", "low1", "low2", "tokens"],
            )
        release()

    return run


@F.pandas_udf(DoubleType())
def _jaccard(a: pd.Series, b: pd.Series) -> pd.Series:
    out = np.empty(len(a))
    for i, (x, y) in enumerate(zip(a, b)):
        z = np.concatenate((x, y))
        z.sort()
        both = int((z[1:] == z[:-1]).sum())
        out[i] = both / (len(x) + len(y) - both) if len(z) else 0.0
    return pd.Series(out)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) -> (a, b, j): the exact Jaccard similarity; ``pairs`` are distinct.

    A set in very many pairs is repeated once for each ``PAIRS_PER_SET`` of them, so that no task meets all.
    """
    pairs = materialize(pairs.select("a", "b"), "pairs")
    for key, salt, name in (("a", "sa", "ta"), ("b", "sb", "tb")):
        often = pairs.groupBy(key).agg(F.count("*").alias("c")).where(F.col("c") > PAIRS_PER_SET).select(key, F.ceil(F.col("c") / PAIRS_PER_SET).cast("int").alias("parts"))
        often = small(materialize(often, "often"))
        parts = F.coalesce("parts", F.lit(1))
        pairs = pairs.join(often, key, "left").withColumn(salt, F.pmod(F.xxhash64("a", "b"), parts).cast("int")).drop("parts")
        side = sets.select(F.col("rep").alias(key), F.col("tokens").alias(name)).join(often, key, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
        pairs = pairs.join(side, [key, salt])
    return pairs.select("a", "b", _jaccard("ta", "tb").alias("j"))


def _blocks_met(lo: np.ndarray, hi: np.ndarray, rest: np.ndarray, percent: int) -> np.ndarray:
    """Pairs (p, q), p <= q, of position blocks of one list that may hold a link; ``rest`` is what a set has from the entry on."""
    heads = np.arange(0, len(lo), POSITION_BLOCK)
    low, high, room = np.minimum.reduceat(lo, heads), np.maximum.reduceat(hi, heads), np.maximum.reduceat(rest, heads)
    need = -(-percent * (low[:, None] + low[None, :]) // (100 + percent))
    fits = (low[None, :] * percent <= high[:, None] * 100) & (low[:, None] * percent <= high[None, :] * 100)
    return np.argwhere(np.triu(fits & (np.minimum(room[:, None], room[None, :]) >= need)))


def _across(percent: int):
    """Some (token, block pair) lists: star pairs of different components whose sizes and positions leave room for a link."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        # within a list: by class of size, then by position, so that the blocks are alike inside
        pdf = pdf.assign(size=np.floor(np.log(pdf["lo"]) / np.log(100 / percent))).sort_values(["token", "b1", "b2", "size", "rest", "star"], ascending=[True, True, True, True, False, True])
        token, b1, b2, lo, hi, rest, star, comp, side = (pdf[c].to_numpy() for c in ("token", "b1", "b2", "lo", "hi", "rest", "star", "comp", "side"))
        new = np.r_[True, (token[1:] != token[:-1]) | (b1[1:] != b1[:-1]) | (b2[1:] != b2[:-1])]
        cut = np.r_[np.flatnonzero(new), len(token)]
        found = []
        for x, y in zip(cut[:-1].tolist(), cut[1:].tolist()):
            for p, q in _blocks_met(lo[x:y], hi[x:y], rest[x:y], percent).tolist():
                i = slice(x + p * POSITION_BLOCK, min(x + (p + 1) * POSITION_BLOCK, y))
                j = slice(x + q * POSITION_BLOCK, min(x + (q + 1) * POSITION_BLOCK, y))
                need = -(-percent * (lo[i, None] + lo[None, j]) // (100 + percent))
                ok = (comp[i, None] != comp[None, j]) & (np.minimum(rest[i, None], rest[None, j]) >= need)
                ok &= (lo[None, j] * percent <= hi[i, None] * 100) & (lo[i, None] * percent <= hi[None, j] * 100)
                if b1[x] != b2[x]:
                    ok &= side[i, None] != side[None, j]
                if p == q:
                    ok = np.triu(ok, 1)
                u, v = np.nonzero(ok)
                if len(u):
                    u, v = star[i][u], star[j][v]
                    found.append(np.stack((np.minimum(u, v), np.maximum(u, v)), 1))
            if len(found) > 2000:
                found = [np.unique(np.concatenate(found), axis=0)]
        pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
        release()
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return run


def _gathered(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """The texts, the screen, the members ``(doc_id, rep)`` of each set, the sets ``(rep, n, tokens)`` and the stars ``(rep, star, d)``."""
    pairs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = pairs.where(F.col("doc_id").isNotNull())
    size = known.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    buckets = max(64, -(-size.n // DOCS_PER_BUCKET), (size.bytes or 0) // BUCKET_BYTES)
    packed = known.mapInArrow(_screen_rows(width, percent, buckets), "bucket int, tok binary, doc binary, need binary, cnt binary, size binary")
    counted = packed.groupBy("bucket").applyInPandas(_count_shared, "doc_id long, shared long, need long, size long")
    screen = materialize(counted.groupBy("doc_id").agg(F.sum("shared").alias("shared"), F.min("need").alias("need"), F.max("size").alias("n")), "screen")

    kept = screen.where("shared >= need and n > 0").select("doc_id")
    texts = materialize(known.join(small(kept), "doc_id", "left_semi").mapInArrow(_set_rows(width), "doc_id long, n long, set_key binary, low1 long, low2 long, tokens array<long>").where("n > 0"), "sets")
    # equal sets are one node, that of the smallest id
    keys = texts.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).where("copies > 1")
    keys = materialize(keys, "keys")
    total = texts.count()
    met = spread_join(texts.select("doc_id", "set_key"), keys, "set_key", "copies", total).select("doc_id", "set_key", F.coalesce("rep", "doc_id").alias("rep"))
    met = materialize(met.distinct(), "member")
    member = met.select("doc_id", "rep").distinct()
    first = met.where("doc_id = rep").select("doc_id", "set_key")
    sets = materialize(texts.join(first, ["set_key", "doc_id"], "left_semi").dropDuplicates(["doc_id", "set_key"]).select(F.col("doc_id").alias("rep"), "n", "low1", "low2", "tokens"), "reps")

    # stars: around the smallest id among the sets with the same smallest entry, in two orders
    tried, n_sets = [], sets.count()
    for low in ("low1", "low2"):
        centre = materialize(sets.groupBy(low).agg(F.min("rep").alias("a"), F.count("*").alias("c")).where("c > 1"), "centres")
        tried.append(spread_join(sets.select("rep", low), centre, low, "c", n_sets).where("rep <> a").select("a", F.col("rep").alias("b")))
    near = _verified(tried[0].unionByName(tried[1]).distinct(), sets).where(f"j >= {percent / 100}")
    best = near.groupBy("b").agg(F.max(F.struct("j", (-F.col("a")).alias("a"))).alias("x")).select(F.col("b").alias("rep"), (-F.col("x.a")).alias("star"), (1 - F.col("x.j")).alias("d"))
    best = materialize(best, "stars")
    return pairs, screen, member, sets, best


def _star_pairs(sets: DataFrame, state: DataFrame, percent: int) -> DataFrame:
    """``(a, b)``: the stars of different ``comp`` of ``state(rep, n, star, d, comp)`` of which some members may link."""
    # the index: entries in two sets at least, by (frequency, hash); the first ones of each set are posted
    each = sets.select("rep", "n", F.explode("tokens").alias("token"))
    often = each.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    listed = each.join(often, "token").groupBy("rep", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("e"))
    alone = F.col("n") - F.size("e")
    room = F.col("n") - F.ceil(F.col("n") * percent / 100).cast("long") + 1 - alone
    posted = listed.where(room > 0).select("rep", "n", alone.alias("first"), F.posexplode(F.slice("e", 1, room.cast("int"))).alias("i", "x"))
    posted = posted.select("rep", "n", F.col("x.token").alias("token"), (F.col("first") + F.col("i")).alias("pos"))
    posted = posted.join(state.select("rep", "star", "comp"), "rep")
    # the sets of a star are one entry of a list; lists whose sets are all in one component already are skipped
    lists = materialize(posted.groupBy("token", "star", "comp").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max(F.col("n") - F.col("pos")).alias("rest")), "lists")
    mixed = lists.groupBy("token").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2"), F.count("*").alias("m")).where("c1 < c2")
    mixed = materialize(mixed.select("token", (F.col("m") > BLOCK).alias("long")), "mixed")
    dealt = _dealt(lists.join(small(mixed), "token"), percent)
    return dealt.withColumn("deal", F.pmod(F.xxhash64("token", "b1", "b2"), F.lit(max(64, lists.count() // LIST_ROWS))).cast("int")).groupBy("deal").applyInPandas(_across(percent), "a long, b long").distinct()


def _dealt(lists: DataFrame, percent: int) -> DataFrame:
    """``lists(token, star, comp, lo, hi, rest, long)`` with ``b1``, ``b2`` and ``side``: a row for each pair of blocks that an entry is looked at in.

    A long list is put in order of the class of size, then of position, over as many tasks as it needs, and cut into blocks of ``BLOCK`` entries where it stands.  Two blocks
    are a pair only where the sizes and positions in them leave room for a link, so what is dealt grows with the list and with how many blocks are alike, not with all pairs of blocks.
    """
    size = F.floor(F.log(F.col("lo")) / np.log(100 / percent))
    order = ["token", size, F.desc("rest"), "star"]
    entries = materialize(lists.where("long").repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    # the upper bits of the running id are the task, the lower ones the place in it
    entries = entries.withColumn("blk", F.shiftright("_at", 33) * (1 << 33) + F.floor(F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) / BLOCK)).drop("_at")
    blocks = entries.groupBy("token", "blk").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("rest").alias("rest"), F.min("comp").alias("c1"), F.max("comp").alias("c2"))
    blocks = materialize(blocks, "blocks")
    x, y = (blocks.select("token", *[F.col(c).alias(f"{c}{k}") for c in ("blk", "lo", "hi", "rest", "c1", "c2")]) for k in ("x", "y"))
    need = F.ceil((F.col("lox") + F.col("loy")) * percent / (100 + percent) - 1e-9)
    room = (F.least("restx", "resty") >= need) & (F.col("loy") * percent <= F.col("hix") * 100) & (F.col("lox") * percent <= F.col("hiy") * 100)
    pairs = x.join(y, "token").where("blkx <= blky and (c1x <> c2x or c1y <> c2y or c1x <> c1y)").where(room).select("token", F.col("blkx").alias("b1"), F.col("blky").alias("b2"))
    pairs = materialize(pairs, "block-pairs")
    jobs = pairs.withColumn("blk", F.col("b1")).withColumn("side", F.lit(0)).unionByName(pairs.where("b1 < b2").withColumn("blk", F.col("b2")).withColumn("side", F.lit(1)))
    columns = ["token", "b1", "b2", "lo", "hi", "rest", "star", "comp", "side"]
    short = lists.where("not long").select("token", F.lit(0).cast("long").alias("b1"), F.lit(0).cast("long").alias("b2"), "lo", "hi", "rest", "star", "comp", F.lit(0).alias("side"))
    return entries.join(small(materialize(jobs, "block-jobs")), ["token", "blk"]).select(*columns).unionByName(short)


def _closed(pairs: DataFrame, screen: DataFrame, member: DataFrame, links: DataFrame) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` of the rows with an id."""
    twice = member.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b").select("a", "b")
    final = connected_components(links.unionByName(twice))
    of = member.join(final.withColumnRenamed("node", "rep"), "rep", "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "rep")).alias("component"))
    return screen.join(of, "doc_id", "left").select("doc_id", F.greatest("n", F.lit(0)).alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def _without_id(pairs: DataFrame, width: int) -> DataFrame:
    lost = pairs.where(F.col("doc_id").isNull()).mapInArrow(_set_rows(width), "doc_id long, n long, set_key binary, low1 long, low2 long, tokens array<long>")
    return lost.select("doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``, one row per distinct document id.

    Two documents link when ``100 * |A & B| >= percent * |A | B|`` over their distinct shingles of
    ``width`` words (A-Z lower-cased, words between ASCII white space).  A text with fewer words
    is one shingle; a null, empty or blank text has none and links with nothing.  Rows that repeat
    an id count as further texts of that document; rows without an id keep a null component.
    Any further columns are ignored.  An empty table gives an empty result.
    """
    pairs, screen, member, sets, best = _gathered(docs, id_col, text_col, width, percent)
    comp = connected_components(best.select(F.col("star").alias("a"), F.col("rep").alias("b")))
    state = materialize(
        sets.select("rep", "n").join(best, "rep", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
        .select("rep", "n", F.coalesce("star", "rep").alias("star"), F.coalesce("d", F.lit(0.0)).alias("d"), F.coalesce("component", "rep").alias("comp")), "state"
    )

    across = _star_pairs(sets, state, percent)
    centres = materialize(_verified(across, sets), "centres")
    # centres that are too far apart for a link of their own but whose members may link
    open_pairs = centres.where(f"j < {percent / 100}").select("a", "b", (1 - F.col("j")).alias("apart"))
    met = _compared(open_pairs, state, sets, sets.select("rep", F.lit(0).cast("long").alias("weight"), F.lit(False).alias("asks")), percent, True)
    links = best.select(F.col("star").alias("a"), F.col("rep").alias("b"))
    links = links.unionByName(centres.where(f"j >= {percent / 100}").select("a", "b")).unionByName(met.select(F.col("x").alias("a"), F.col("y").alias("b")))
    return _closed(pairs, screen, member, links).unionByName(_without_id(pairs, width))


def _overlaps(ids: np.ndarray, off: np.ndarray, to: int, y: int):
    """For each set ``x < to`` in turn, its overlap with every set from ``y`` on, derived from the overlaps of set 0.

    ``ids[off[x]:off[x + 1]]`` are the entries of set x, as numbers from 0.  The lists say which of the compared sets hold an entry.
    """
    n, width = len(off) - 1 - y, int(ids.max()) + 1
    held, owner = ids[off[y] :], np.repeat(np.arange(n), np.diff(off[y:]))
    order = np.argsort(held, kind="stable")
    owner, lists = owner[order], np.r_[0, np.cumsum(np.bincount(held, minlength=width))]

    def holders(entries):
        size = lists[entries + 1] - lists[entries]
        at = np.repeat(lists[entries] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        return np.bincount(owner[at], minlength=n)

    first, in_first, there = ids[: off[1]], np.zeros(width, bool), np.zeros(width, bool)
    in_first[first] = True
    base = holders(first)
    for x in range(to):
        mine = ids[off[x] : off[x + 1]]
        there[mine] = True
        yield base - holders(first[~there[first]]) + holders(mine[~in_first[mine]])
        there[mine] = False


def _linked(percent: int, one: bool):
    """Some jobs, each a block of sets of one star against a block of another (or against itself): every pair is compared exactly.

    Rows ``kind, x, y, n``: 0 for the weight ``n`` of the sets that set x links with in this job, 1 for
    one link between two stars, 2 for each link of a set that asks for pairs.  With ``one``, a job ends at its first link.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["a", "b", "i", "j", "side", "d", "rep"])
        job = pdf[["a", "b", "i", "j"]].to_numpy()
        rep, weight, asks, side, tokens = (pdf[c].to_numpy() for c in ("rep", "weight", "asks", "side", "tokens"))
        cut = np.r_[np.flatnonzero(np.r_[True, (job[1:] != job[:-1]).any(axis=1)]), len(job)]
        out = []
        for u, v in zip(cut[:-1].tolist(), cut[1:].tolist()):
            r, w, q = rep[u:v], weight[u:v], asks[u:v]
            size = np.array([len(t) for t in tokens[u:v]], np.int64)
            off = np.r_[0, np.cumsum(size)]
            # a block against itself has one side only
            to = int((side[u:v] == 0).sum())
            own = to == v - u and job[u, 0] == job[u, 1] and job[u, 2] == job[u, 3]
            y = 0 if own else to
            if y == v - u or not to:
                continue
            ids = np.unique(np.concatenate(tokens[u:v]), return_inverse=True)[1].ravel()
            count, first = np.zeros(v - u, np.int64), True
            for x, both in enumerate(_overlaps(ids, off, to, y)):
                ok = 100 * both >= percent * (size[x] + size[y:] - both)
                if own:
                    ok[x] = False
                hit = y + np.flatnonzero(ok)
                if not len(hit):
                    continue
                count[x] += w[hit].sum()
                if not own:
                    count[hit] += w[x]
                    if first and job[u, 0] != job[u, 1]:
                        out.append(np.array([[1, r[x], r[hit[0]], 0]], np.int64))
                        first = False
                if one:
                    break
                told = hit[(q[hit] | q[x]) & ((hit > x) if own else True)]
                if len(told):
                    out.append(np.stack((np.full(len(told), 2), np.full(len(told), r[x]), r[told], np.zeros(len(told), np.int64)), 1))
            some = np.flatnonzero(count) if not one else np.zeros(0, np.int64)
            out.append(np.stack((np.zeros(len(some), np.int64), r[some], np.zeros(len(some), np.int64), count[some]), 1))
        rows = np.concatenate(out) if out else np.zeros((0, 4), np.int64)
        release()
        return pd.DataFrame({"kind": rows[:, 0], "x": rows[:, 1], "y": rows[:, 2], "n": rows[:, 3]})

    return run


def _compared(across: DataFrame, state: DataFrame, sets: DataFrame, weights: DataFrame, percent: int, one: bool) -> DataFrame:
    """The rows of ``_linked`` for the members of the star pairs ``across(a, b, apart)``; without ``one``, also inside each star.

    Stars are cut into blocks of about ``BLOCK_TOKENS`` entries, and pairs of blocks are dealt, so no star is held whole.
    """
    gap, eps = 1 - percent / 100, 1e-9
    stars = materialize(state.groupBy("star").agg(F.max("d").alias("r"), F.count("*").alias("m"), F.sum("n").alias("all"), F.ceil(F.sum("n") / BLOCK_TOKENS).cast("int").alias("blocks")), "star_sizes")
    few = small(stars)
    side = lambda c: few.select(F.col("star").alias(c), F.col("r").alias(f"r{c}"), F.col("blocks").alias(f"n{c}"), (F.col("all") / F.col("blocks")).alias(f"t{c}"))
    both = across.join(side("a"), "a").join(side("b"), "b").where(f"apart <= {gap + eps} + ra + rb").select("a", "b", "apart", "ra", "na", "ta", "rb", "nb", "tb")
    if not one:
        both = both.unionByName(side("a").join(stars.where("m > 1").select(F.col("star").alias("a")), "a", "left_semi").selectExpr("a", "a as b", "0.0D as apart", "ra", "na", "ta", "ra as rb", "na as nb", "ta as tb"))
    jobs = both.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("na") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).where("a <> b or i <= j")
    jobs = materialize(jobs, "jobs")
    deals = max(64, int((jobs.agg(F.sum(F.col("ta") + F.col("tb"))).first()[0] or 0) // (8 * BLOCK_TOKENS)))
    jobs = jobs.withColumn("deal", F.pmod(F.xxhash64("a", "b", "i", "j"), F.lit(deals)).cast("int"))
    placed = spread_join(state.select("rep", "star", "d"), stars.select("star", "m", "blocks"), "star", "m", state.count()).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).drop("blocks")
    sides = jobs.select("deal", "a", "b", "i", "j", F.lit(0).alias("side"), F.col("a").alias("star"), F.col("i").alias("block"), (F.col("apart") - F.col("rb")).alias("least"))
    sides = sides.unionByName(jobs.where("a <> b or i <> j").select("deal", "a", "b", "i", "j", F.lit(1).alias("side"), F.col("b").alias("star"), F.col("j").alias("block"), (F.col("apart") - F.col("ra")).alias("least")))
    # a member that is too far from the other star by the triangle inequality meets none of its members
    rows = sides.join(placed, ["star", "block"]).where(f"least - d <= {gap + eps}").join(weights, "rep").join(sets.select("rep", "tokens"), "rep")
    found = rows.select("deal", "a", "b", "i", "j", "side", "d", "rep", "weight", "asks", "tokens").groupBy("deal").applyInPandas(_linked(percent, one), "kind long, x long, y long, n long")
    return materialize(found, "links")


def _all_links(sets: DataFrame, best: DataFrame, weights: DataFrame, percent: int) -> DataFrame:
    """The rows of ``_linked`` over all pairs of sets; ``weights(rep, weight, asks)``."""
    state = materialize(sets.select("rep", "n").join(best, "rep", "left").select("rep", "n", F.coalesce("star", "rep").alias("star"), F.coalesce("d", F.lit(0.0)).alias("d")).withColumn("comp", F.col("star")), "state")
    across = _verified(_star_pairs(sets, state, percent), sets).select("a", "b", (1 - F.col("j")).alias("apart"))
    return _compared(across, state, sets, weights, percent, False)


def jaccard_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """``(a, b)`` with ``a < b``, every link between two different sets, each named by its smallest document id, and the
    membership ``(doc_id, rep)`` of the documents that may have links.  Documents of one set are linked with each other."""
    _, _, member, sets, best = _gathered(docs, id_col, text_col, width, percent)
    found = _all_links(sets, best, sets.select("rep", F.lit(1).cast("long").alias("weight"), F.lit(True).alias("asks")), percent)
    return found.where("kind = 2").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")), member


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """``(doc_id, n_shingles, component_id, n_links)``: as ``jaccard_components``, and with how many other documents each one links.

    Links are counted between sets and weighted with the copies of each set, so a group of m different near copies costs m^2 / 2
    comparisons inside blocks and no row for a pair.  Only the sets of documents with several texts give pairs, since
    a document that is met twice counts once.  Rows without an id have a null number.
    """
    pairs, screen, member, sets, best = _gathered(docs, id_col, text_col, width, percent)
    several = materialize(member.join(member.groupBy("doc_id").count().where("count > 1").select("doc_id"), "doc_id", "left_semi"), "several")
    single = member.join(small(several.select("doc_id").distinct()), "doc_id", "left_anti")
    weights = sets.select("rep").join(single.groupBy("rep").agg(F.count("*").alias("weight")), "rep", "left").join(several.select("rep").distinct().withColumn("asks", F.lit(True)), "rep", "left")
    weights = materialize(weights.select("rep", F.coalesce("weight", F.lit(0)).alias("weight"), F.coalesce("asks", F.lit(False)).alias("asks")), "weights")
    found = _all_links(sets, best, weights, percent)
    counted = found.where("kind = 0").groupBy(F.col("x").alias("rep")).agg(F.sum("n").alias("n"))
    told = found.where("kind = 2")
    told = told.select(F.col("x").alias("rep"), F.col("y").alias("to")).unionByName(told.select(F.col("y").alias("rep"), F.col("x").alias("to")))
    told = told.unionByName(several.select("rep", F.col("rep").alias("to")).distinct())
    hosts = several.select(F.col("rep").alias("to"), F.col("doc_id").alias("host"))
    # a document of one text: the weights of its set and of those linked with it, and each host of several texts once
    extra = told.join(hosts, "to").groupBy("rep").agg(F.count_distinct("host").alias("hosts"))
    ones = single.join(weights.select("rep", "weight"), "rep").join(counted, "rep", "left").join(extra, "rep", "left")
    ones = ones.select("doc_id", (F.col("weight") + F.coalesce("n", F.lit(0)) + F.coalesce("hosts", F.lit(0)) - 1).alias("n_links"))
    reach = several.join(told, "rep").select("doc_id", "to").distinct()
    more = reach.join(weights.select(F.col("rep").alias("to"), "weight"), "to").groupBy("doc_id").agg(F.sum("weight").alias("weight"))
    more = more.join(reach.join(hosts, "to").groupBy("doc_id").agg(F.count_distinct("host").alias("hosts")), "doc_id").select("doc_id", (F.col("weight") + F.col("hosts") - 1).alias("n_links"))
    links = best.select(F.col("star").alias("a"), F.col("rep").alias("b")).unionByName(found.where("kind = 1").select(F.col("x").alias("a"), F.col("y").alias("b")))
    out = _closed(pairs, screen, member, links).join(ones.unionByName(more), "doc_id", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)))
    return out.unionByName(_without_id(pairs, width).withColumn("n_links", F.lit(None).cast("long")))


def keep_one_per_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without the near copies of a smaller id; unlinked rows and rows without an id stay, and rows that repeat an id go or stay together."""
    gone = jaccard_components(docs, id_col, text_col, width, percent).where("component_id < doc_id").select(F.col("doc_id").alias(id_col))
    return docs.join(small(materialize(gone, "near-copies")), id_col, "left_anti")


def op1_ngram_jaccard_join(spark, sf_dir):
    return jaccard_components(table(spark, sf_dir, "documents"))


def op1_ngram_jaccard_links(spark, sf_dir):
    return jaccard_join(table(spark, sf_dir, "documents"))


ORACLE = {
    "op1_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS a FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(a) = 0 THEN [] WHEN len(a) < 5 THEN [array_to_string(a, ' ')]
    ELSE list_transform(range(1, len(a) - 3), lambda i: array_to_string(a[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM o JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.b) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN r ON r.a = d.doc_id GROUP BY 1, 2""",
    "op1_ngram_jaccard_links": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS a FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(a) = 0 THEN [] WHEN len(a) < 5 THEN [array_to_string(a, ' ')]
    ELSE list_transform(range(1, len(a) - 3), lambda i: array_to_string(a[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM o JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.b) AS component_id, (SELECT count(*) FROM e WHERE e.a = d.doc_id) AS n_links
FROM documents d LEFT JOIN n USING (doc_id) JOIN r ON r.a = d.doc_id GROUP BY 1, 2"""
}
