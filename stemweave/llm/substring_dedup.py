"""Substring dedup by seed and extend: words that stand in a passage of at least ``least`` words that a document with a smaller id has too.

A seed is ``seed`` consecutive words.  Winnowing chooses one for every window of ``least`` words, the one with the smallest hash (of equal ones the first),
so two equal windows choose the same seed at the same place, and documents that share a window meet at its seed.  About two words in ten are
the beginning of a seed; the consecutive windows that choose the same one are its span, as far as the seed reaches both ways.

1. Seeds of one document alone are dropped: what is left is a small part of most corpora.
2. Matches are extended span by span: of occurrences with equal spans, all but those of the smallest id are repeats as a whole.
3. Where one seed has several spans, the first occurrence of each is extended window by window, and a window is a repeat where a smaller id has it.
   What that occurrence's windows say holds for all occurrences of its span in the same document.
4. The windows' words are united into maximal repeats, intervals of words of each document.

No pairs of a group are made: every step is an aggregation to the smallest id and a join of its outcome, and a seed, span or window may be in any
share of the rows.  Hashes of spans and windows have 128 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import EXACT, free, list_array, materialize, mix, release, slices, small, spread_join, table, text_buffers, word_hashes

NO_ID = (1 << 63) - 1
MOST_BITS = 29
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _grams(h: np.ndarray, width: int, odd: np.uint64) -> np.ndarray:
    """A hash of the ``width`` words from each word on."""
    n = max(0, len(h) - width + 1)
    x = np.zeros(n, np.uint64)
    for k in range(width):
        x = mix(x * odd + h[k : n + k])
    return x


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.Array:
    """128-bit values as a binary column."""
    data = np.stack([a, b], axis=1)
    return pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(np.arange(0, 16 * len(a) + 1, 16, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def windows_of(h: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of the hash of each window of ``least`` words."""
    return _grams(h, least, _A), _grams(h, least, _B)


def spans_of(h: np.ndarray, first: np.ndarray, least: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(text, first window, number of windows, hash of the seed)`` of each span of texts whose words have the hashes ``h``."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    n = max(0, len(h) - least + 1)
    at = np.flatnonzero(text[:n] == text[least - 1 :]) if n else np.zeros(0, np.int64)
    grams = _grams(h, seed, _C)
    best, where = grams[:n].copy(), np.zeros(n, np.int64)
    for k in range(1, least - seed + 1):
        other = grams[k : n + k]
        less = other < best
        best[less], where[less] = other[less], k
    chosen = at + where[at]
    new = np.flatnonzero(np.concatenate(([True], chosen[1:] != chosen[:-1]))) if len(at) else at
    return text[at[new]], at[new], np.diff(np.concatenate((new, [len(at)]))), best[at[new]]


def _span_hashes(w: tuple[np.ndarray, np.ndarray], at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of the hash of each span: of its windows in their order."""
    out = []
    for half, odd in zip(w, (_B, _A)):
        x = n.astype(np.uint64)
        for k in range(int(n.max()) if len(n) else 0):
            m = n > k
            x[m] = mix(x[m] * odd + half[at[m] + k])
        out.append(x)
    return out[0], out[1]


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))


def _seed_ids(texts: DataFrame, least: int, seed: int) -> DataFrame:
    """``(a, lo, hi, n)``: the smallest and greatest id and the number of spans of each seed in some piece of the table."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                h, _, _, first = word_hashes(*text_buffers(part.column(1)), letters=EXACT)
                text, _, _, a = spans_of(h, first, least, seed)
                if not len(a):
                    continue
                ids = part.column(0).to_numpy()[text]
                order = np.argsort(a)
                a, ids = a[order], ids[order]
                head = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
                n = np.diff(np.concatenate((head, [len(a)])))
                yield pa.RecordBatch.from_arrays([pa.array(a[head].view(np.int64)), pa.array(np.minimum.reduceat(ids, head)), pa.array(np.maximum.reduceat(ids, head)), pa.array(n)], ["a", "lo", "hi", "n"])
        release()

    return texts.select("id", "text").mapInArrow(run, "a long, lo long, hi long, n long")


def _bitmap(seeds: DataFrame, bits: int) -> np.ndarray:
    """``2 ** bits`` bits, in words of 64, with those set that the first ``bits`` bits of a seed name."""
    bit = F.shiftrightunsigned("a", 64 - bits)
    words = seeds.select(bit.alias("b")).groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("m")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words["w"].to_numpy()] = words["m"].to_numpy()
    return out.view(np.uint64)


def _occurrences(texts: DataFrame, least: int, seed: int, bitmap) -> DataFrame:
    """``(id, h, a, span, at, n)`` of each span, of those alone whose seed the broadcast ``bitmap`` may hold if there is one."""

    def run(batches):
        have = bitmap.value if bitmap is not None else None
        shift = np.uint64(64 - (len(have) * 64).bit_length() + 1) if have is not None else None
        for batch in batches:
            for part in slices(batch, column=2):
                h, _, _, first = word_hashes(*text_buffers(part.column(2)), letters=EXACT)
                text, at, n, a = spans_of(h, first, least, seed)
                if have is not None:
                    bit = a >> shift
                    keep = (have[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) > 0
                    text, at, n, a = text[keep], at[keep], n[keep], a[keep]
                span = _span_hashes(windows_of(h, least), at, n)
                rows = pa.array(text)
                yield pa.RecordBatch.from_arrays([part.column(0).take(rows), part.column(1).take(rows), pa.array(a.view(np.int64)), _pairs(*span), pa.array((at - first[text]).astype(np.int32)), pa.array(n.astype(np.int32))], ["id", "h", "a", "span", "at", "n"])
        release()

    return texts.mapInArrow(run, "id long, h long, a long, span binary, at int, n int")


def _shared_spans(texts: DataFrame, least: int, seed: int, most_bits: int) -> DataFrame:
    """Written occurrences of all seeds that two ids have, and perhaps of others.

    A bitmap of the shared seeds, of at most ``2 ** most_bits`` bits, screens the spans before they are written.  With more seeds than half its bits it would tell
    little, and the spans are joined with the seeds instead.
    """
    seeds = _seed_ids(texts, least, seed).groupBy("a").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"))
    seeds = materialize(seeds.where("lo < hi").select("a", "n"), "seeds")
    many = seeds.count()
    if many <= 1 << (most_bits - 1):
        bits = min(most_bits, max(10, (many * 16).bit_length()))
        return materialize(_occurrences(texts, least, seed, texts.sparkSession.sparkContext.broadcast(_bitmap(seeds, bits))), "spans")
    every = materialize(_occurrences(texts, least, seed, None), "all-spans")
    return materialize(spread_join(every, seeds.withColumn("shared", F.lit(True)), "a", "n", every.count()).where("shared").drop("shared"), "spans")


def _windows(texts: DataFrame, wanted: DataFrame, least: int) -> DataFrame:
    """``(w, id, h, at, o)``: the windows of the ``wanted(id, h, spans)``, a number ``64 * at + n`` for each span, ``o`` their place in it."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, column=2):
                h, _, _, first = word_hashes(*text_buffers(part.column(2)), letters=EXACT)
                w = windows_of(h, least)
                lists = part.column(3)
                each = lists.flatten().to_numpy()
                at, n = each >> 6, each & 63
                row = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy())
                which = np.repeat(np.arange(len(at)), n)
                o = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
                place, rows = first[row][which] + at[which] + o, pa.array(row[which])
                yield pa.RecordBatch.from_arrays([_pairs(w[0][place], w[1][place]), part.column(0).take(rows), part.column(1).take(rows), pa.array(at[which].astype(np.int32)), pa.array(o.astype(np.int32))], ["w", "id", "h", "at", "o"])
        release()

    # the keys alone are small for longer, and keep the other texts out of a shuffle
    held = texts.join(small(wanted.select("id", "h")), ["id", "h"], "left_semi")
    return held.join(small(wanted), ["id", "h"]).select("id", "h", "text", "spans").mapInArrow(run, "w binary, id long, h long, at int, o int")


def _united(rows: DataFrame, least: int) -> DataFrame:
    """``(id, h, start, stop)``: the words that the windows marked in ``rows(id, h, marks)`` cover, as arrays of maximal intervals."""

    def run(batches):
        for batch in batches:
            starts, stops = [], []
            for marks in batch.column(2):
                at, bits = marks.values.field("at").to_numpy(), marks.values.field("bits").to_numpy()
                at = np.concatenate([at[bits >> k & 1 > 0] + k for k in range(int(bits.max()).bit_length())])
                at.sort()
                new = np.flatnonzero(np.diff(at) > least) + 1
                starts.append(at[np.concatenate(([0], new))])
                stops.append(at[np.concatenate((new - 1, [len(at) - 1]))] + least)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), list_array(starts, np.int32), list_array(stops, np.int32)], ["id", "h", "start", "stop"])

    return rows.mapInArrow(run, "id long, h long, start array<int>, stop array<int>")


def _repeats(texts: DataFrame, least: int, seed: int, most_bits: int) -> DataFrame:
    """Written ``(id, h, start, stop)`` of each text that has repeats."""
    spans = _shared_spans(texts, least, seed, most_bits)
    total = spans.count()
    first = spans.groupBy("span").agg(F.min(F.struct("id", "h", "at", "n", "a")).alias("f"), F.count("*").alias("c"))
    first = materialize(first.select("span", "f.*", "c"), "first-spans")
    seeds = first.groupBy("a").agg(F.count("*").alias("k"), F.min("id").alias("lo"), F.max("id").alias("hi"))
    seeds = materialize(seeds.where("k > 1 and lo < hi").select("a", "k", F.lit(True).alias("several")), "open-seeds")
    open_ = spread_join(first.select("a", "id", "h", "at", "n"), seeds, "a", "k", first.count()).where("several")
    wanted = materialize(open_.groupBy("id", "h").agg(F.collect_list(F.col("at").cast("long") * 64 + F.col("n")).alias("spans")), "open-spans")
    windows = materialize(_windows(texts, wanted, least), "windows")
    least_ids = windows.groupBy("w").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("c"))
    least_ids = materialize(least_ids.where("lo < hi").select("w", "lo", "c"), "shared-windows")
    hit = spread_join(windows, least_ids, "w", "c", windows.count()).where("lo < id")
    # the first occurrence of a span stands for it
    masks = hit.groupBy("id", "h", "at").agg(F.bit_or(F.expr("shiftleft(1L, o)")).alias("mask"))
    verdict = materialize(first.join(masks, ["id", "h", "at"], "left").where("c > 1 or mask is not null").select("span", F.col("id").alias("lo"), "mask", "c"), "verdicts")
    marks = spread_join(spans.select("id", "h", "span", "at", "n"), verdict, "span", "c", total)
    bits = F.when(F.col("id") > F.col("lo"), F.expr("shiftleft(1L, n) - 1")).when(F.col("id") == F.col("lo"), F.col("mask"))
    marks = marks.select("id", "h", "at", bits.alias("bits")).where("bits > 0").groupBy("id", "h").agg(F.collect_set(F.struct("at", "bits")).alias("marks"))
    return materialize(_united(marks, least), "repeats")


def _checked(least: int, seed: int) -> None:
    if not 0 < seed <= least <= seed + 61:
        raise ValueError("a window has between seed and seed + 61 words")


def maximal_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 13, seed: int = 4, most_bits: int = MOST_BITS) -> DataFrame:
    """``(id, text_hash, start, stop)``: one row for each maximal stretch of words (numbers from 0, ``stop`` behind the last) that windows of
    ``least`` words cover whose words a document with a smaller id has as well.

    Words are what ASCII white space separates, as they stand; null and blank texts have none, and texts of fewer than ``least`` words no
    window.  Ids are whole numbers; a null one (``null`` in the result too) counts as the greatest, and documents with equal ids are no source for each other,
    so a text that repeats a window inside itself keeps it.  ``text_hash`` is Spark's ``xxhash64`` of the text and tells texts with the same id apart.
    """
    _checked(least, seed)
    found = _repeats(_texts(docs, id_col, text_col), least, seed, most_bits)
    pairs = found.select(F.when(F.col("id") != NO_ID, F.col("id")).alias(id_col), F.col("h").alias("text_hash"), F.explode(F.arrays_zip("start", "stop")).alias("p"))
    return pairs.select(id_col, "text_hash", "p.start", "p.stop")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 13, seed: int = 4, most_bits: int = MOST_BITS) -> DataFrame:
    """``docs`` with the words of ``maximal_repeats`` removed: the text is what is left, joined by one blank; ``n_words`` and ``n_removed`` are added.

    A null text stays null and has no words; rows that repeat id and text are treated alike.  Columns of ``docs`` with the names of the new ones stay, and the new ones get underscores behind theirs.
    """
    _checked(least, seed)
    found = _repeats(_texts(docs, id_col, text_col), least, seed, most_bits)
    names = docs.columns
    own = [free(n, names) for n in ("_id", "_h", "_start", "_stop")]
    made = [free(n, names) for n in ("n_words", "n_removed")]
    found = found.select(*[F.col(c).alias(n) for c, n in zip(("id", "h", "start", "stop"), own)])
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    same = (F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)) == F.col(own[0])) & (F.xxhash64(text) == F.col(own[1]))
    rows = docs.join(small(found), same, "left").select(*[F.col(f"`{c}`").cast("string").alias(c) if c == text_col else F.col(f"`{c}`") for c in names], *own[2:])
    t = names.index(text_col)

    def run(batches):
        for batch in batches:
            for part in slices(batch, column=t):
                buf, off = text_buffers(part.column(t))
                there = part.column(t).is_valid().to_pylist()
                starts, stops = part.column(len(names)), part.column(len(names) + 1)
                texts, n, gone = [], [], []
                for i, known in enumerate(there):
                    words = buf[off[i] : off[i + 1]].tobytes().split()
                    n.append(len(words))
                    if starts[i].is_valid:
                        kept, at = [], 0
                        for a, b in zip(starts[i].as_py(), stops[i].as_py()):
                            kept += words[at:a]
                            at = b
                        words = kept + words[at:]
                    gone.append(n[-1] - len(words))
                    texts.append(b" ".join(words) if known else None)
                columns = [*part.columns[: len(names)], pa.array(n, pa.int64()), pa.array(gone, pa.int64())]
                columns[t] = pa.array(texts, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays(columns, [*names, *made])
        release()

    return rows.mapInArrow(run, StructType([*[StructField(f.name, StringType()) if f.name == text_col else f for f in docs.schema.fields], *[StructField(m, LongType()) for m in made]]))


def op12_substring_dedup(spark, sf_dir):
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE = {
    "op12_substring_dedup": r"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS MATERIALIZED (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS t FROM d, LATERAL (SELECT unnest(range(1, len(w) - 11)) AS i)),
f AS (SELECT t, min(doc_id) AS lo FROM g GROUP BY t HAVING min(doc_id) < max(doc_id)),
h AS MATERIALIZED (SELECT doc_id, i FROM g JOIN f USING (t) WHERE doc_id > lo),
c AS MATERIALIZED (SELECT DISTINCT doc_id, i + k AS i FROM h, range(13) r(k)),
o AS (SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS s FROM x ANTI JOIN c USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(o.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM d LEFT JOIN o USING (doc_id) LEFT JOIN k USING (doc_id)"""
}
