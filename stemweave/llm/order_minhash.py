"""Document fingerprints by Order MinHash, in DataFrame functions alone.

A text falls into pieces: runs of up to 12 characters without white space, and the single characters of
longer runs, so that an edit inside a long run changes the pieces beside it alone.  Its k-mers are ``k``
consecutive pieces, at stride one, numbered by occurrence, so that a repeated k-mer counts again.  One hash deals
them into bins; in each bin the ``l`` smallest are selected, put back into their order in the text,
and hashed as a tuple.  Two texts share a bin's tuple only where they have the same k-mers in the
same order, which is what makes the fingerprint sensitive to edit distance and not only to overlap.

All of it runs inside one row: hash and position share a 64-bit number, two array sorts number the
occurrences and find the smallest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small, table

POSITION_BITS = 24
BIN_BITS = 7
_LOW = (1 << POSITION_BITS) - 1
QUANTILES = 256
HOT_IDS = 2048
ROWS_PER_BUCKET = 5000
TASK_BYTES = 4 << 20
MOST_TASKS = 200_000


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _hash_part(x: Column) -> Column:
    return x.bitwiseAND(F.lit(~_LOW))


def _bin(x: Column) -> Column:
    return F.shiftrightunsigned(x, 64 - BIN_BITS)


def _earlier(a: Column, i: Column, x: Column) -> Column:
    """How many entries before ``i`` in the sorted ``a`` have the hash of ``x``: 0 at once in most places, else by bisection."""
    same = lambda j: F.coalesce(_hash_part(F.get(a, j)) == _hash_part(x), F.lit(False))
    steps = F.array(*[F.lit(1 << s) for s in range(POSITION_BITS - 1, -1, -1)])
    run = F.aggregate(steps, F.lit(0), lambda n, s: F.when((i - n - s >= 0) & same(i - n - s), n + s).otherwise(n))
    return F.when((i > 0) & same(i - 1), run).otherwise(F.lit(0))


def signature(text: Column, k: int = 3, l: int = 2) -> Column:  # noqa: E741
    """An array of ``bin << 32 | 32-bit tuple hash``, one entry for each bin that has a k-mer; empty for a blank text.

    Places have ``POSITION_BITS`` bits: behind the first 16 million pieces all have the last place, so there the order within a tuple is
    that of the hashes.
    """
    pieces = F.regexp_extract_all(text, F.lit(r"((?<!\S)\S{1,12}(?!\S)|\S)"), F.lit(1))

    def numbered(w):
        kmer = lambda x, i: F.xxhash64(x, *[F.get(w, i + j) for j in range(1, k)])
        return F.sort_array(F.transform(w, lambda x, i: _hash_part(kmer(x, i)).bitwiseOR(F.least(i.cast("long"), F.lit(_LOW)))))

    def again(a):
        def entry(x, i):
            n = _earlier(a, i, x)
            other = _hash_part(F.xxhash64(_hash_part(x), n)).bitwiseOR(x.bitwiseAND(F.lit(_LOW)))
            return F.when((i > 0) & (_hash_part(F.get(a, i - 1)) == _hash_part(x)), other).otherwise(x)

        return F.sort_array(F.transform(a, entry))

    def smallest(s):
        return F.filter(s, lambda x, i: (i < l) | (_bin(F.get(s, i - l)) != _bin(x)))

    def tuples(c):
        def entry(x, i):
            mine = F.filter(F.slice(c, i + 1, l), lambda y: _bin(y) == _bin(x))
            order = F.sort_array(F.transform(mine, lambda y: F.struct(y.bitwiseAND(F.lit(_LOW)).alias("p"), _hash_part(y).alias("h"))))
            tuple_hash = F.xxhash64(F.transform(order, lambda y: y["h"])).bitwiseAND(F.lit(0xFFFFFFFF))
            return F.when((i == 0) | (_bin(F.get(c, i - 1)) != _bin(x)), F.shiftleft(_bin(x), 32).bitwiseOR(tuple_hash))

        return F.filter(F.transform(c, entry), lambda x: x.isNotNull())

    return _let(pieces, lambda w: _let(numbered(w), lambda a: _let(again(a), lambda s: _let(smallest(s), tuples))))


def fingerprint(sig: Column) -> Column:
    """The signature as a string: ten hexadecimal digits for each bin that has a tuple."""
    return F.array_join(F.transform(sig, lambda x: F.lower(F.lpad(F.hex(x), 10, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """The share of the bins filled in either signature that hold the same tuple; 1 for two blank texts."""
    filled = lambda s: F.transform(s, lambda x: F.shiftright(x, 32))
    all_bins = F.size(F.array_union(filled(a), filled(b)))
    return F.when(all_bins == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / all_bins)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, Window]:
    """Rows ``(doc_id, text, b, o)`` dealt into buckets ``b`` of consecutive ids, and ``(b, next_text)``: the text
    that follows each bucket (behind the last one, the first).

    The order is (id, hash of the text); null ids come first.  At most ``QUANTILES`` ids come to the driver, and the ids with more
    than one in ``HOT_IDS`` of the rows, of which there are fewer than that.  Rows of such an id, and those without one, are dealt
    into buckets by the hash of their text, which is their order.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    seen = rows.agg(F.percentile_approx("doc_id", [i / QUANTILES for i in range(QUANTILES)], 10_000).alias("q"), F.count("*").alias("n"), F.max("doc_id").alias("top"), F.count_if(F.col("doc_id").isNull()).alias("lost"), F.sum(F.octet_length("text")).alias("bytes")).first()
    often = rows.where("doc_id is not null").groupBy("doc_id").count().where((F.col("count") > ROWS_PER_BUCKET) & (F.col("count") * HOT_IDS > seen.n)).collect()
    hot = {r.doc_id: -(-r["count"] // ROWS_PER_BUCKET) for r in often}
    # a hot id is a bucket range of its own
    edges = sorted({*(seen.q or [0]), *hot, *(h + 1 for h in hot)})
    per = max(1, -(-seen.n // (ROWS_PER_BUCKET * len(edges))))
    parts = [hot.get(e, per) for e in edges]
    before = [0]
    for k in parts:
        before.append(before[-1] + k)
    literal = lambda values: F.array(*[F.lit(x).cast("long") for x in values])
    lows, highs = literal(edges), literal([*edges[1:], max((seen.top or 0) + 1, edges[-1] + 1)])
    at = F.greatest(F.size(F.filter(lows, lambda x: x <= F.col("doc_id"))) - 1, F.lit(0))
    rows = rows.select("doc_id", "text", F.xxhash64("text").alias("o")).withColumn("at", at)
    take = lambda values: F.get(literal(values), F.col("at"))
    by_text = lambda k: F.floor((F.shiftright("o", 32) + F.lit(1 << 31)) * k / F.lit(1 << 32))
    low, high = F.get(lows, F.col("at")), F.get(highs, F.col("at"))
    by_id = F.least(F.greatest(F.floor((F.col("doc_id") - low) * take(parts) / (high - low)), F.lit(0)), take(parts) - 1)
    inside = F.when(take([int(e in hot) for e in edges]) == 1, by_text(take(parts))).otherwise(by_id)
    lost = max(1, -(-seen.lost // ROWS_PER_BUCKET))
    rows = rows.select("doc_id", "text", F.when(F.col("doc_id").isNull(), by_text(F.lit(lost)) - lost).otherwise(take(before[:-1]) + inside).cast("long").alias("b"), "o")
    # as many tasks as the bytes ask for
    n = min(MOST_TASKS, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), (seen.bytes or 0) // TASK_BYTES))
    heads = rows.groupBy("b").agg(F.min(F.struct("doc_id", "o")).alias("f")).select("b", F.col("f.doc_id").alias("i"), F.col("f.o").alias("fo"))
    heads = materialize(heads, "heads")
    ring = Window.orderBy("b")  # one row per bucket
    after = heads.select(F.lead("b").over(ring).alias("nb"), F.first("b").over(ring).alias("b0"), "b").select("b", F.coalesce("nb", "b0").alias("nb"))
    h = heads.withColumnRenamed("b", "hb")
    first = rows.join(small(h), (rows["b"] == h["hb"]) & rows["doc_id"].eqNullSafe(h["i"]) & (rows["o"] == h["fo"]), "left_semi").dropDuplicates(["b"]).select(F.col("b").alias("nb"), F.col("text").alias("next_text"))
    following = materialize(after.join(first, "nb").select("b", "next_text"), "following")
    return rows.repartition(n, "b"), following, Window.partitionBy("b").orderBy("doc_id", "o")


def fingerprints(docs: DataFrame, k: int = 3, l: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:  # noqa: E741
    """``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)`` for every row.

    The edited text has the last ``floor(n_chars / 2)`` code points replaced by the first as many of the next
    document by id (of the first one, behind the last).  A null text is empty; a blank text has an empty
    fingerprint; two of them are alike.  Rows that repeat an id follow one another by the hash of their text.
    """
    rows, following, order = with_next(docs, id_col, text_col)
    pairs = rows.withColumn("n", F.lead("text").over(order)).join(following, "b", "left")
    cut = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - cut), F.substring(F.coalesce("n", "next_text", F.lit("")), F.lit(1), cut))
    texts = pairs.select("doc_id", "b", "o", F.when(F.col("n").isNull(), F.col("next_text")).alias("edge"), "text", edited.alias("edited"))
    signed = texts.select("doc_id", "b", "o", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), signature(F.col("text"), k, l).alias("sig"), signature(F.col("edited"), k, l).alias("esig"), F.when(F.col("edge").isNotNull(), signature(F.col("edge"), k, l)).alias("edge"))
    lead = signed.withColumn("nsig", F.coalesce(F.lead("sig").over(order), "edge"))
    return lead.select("doc_id", "n_chars", "edited_sha256", fingerprint(F.col("sig")).alias("fingerprint"), fingerprint(F.col("esig")).alias("edited_fingerprint"), likeness(F.col("sig"), F.col("esig")).alias("near_edited"), likeness(F.col("sig"), F.col("nsig")).alias("near_next"))


def op5_order_minhash(spark, sf_dir):
    return fingerprints(table(spark, sf_dir, "documents"))
