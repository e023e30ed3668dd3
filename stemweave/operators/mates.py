"""Similarity of each vector to the others of its bucket, by blocks and without rows of pairs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import stored, stored_with

BLOCK = 2048
#: a bucket's blocks, as far as they are not below the asked size, and the bytes that a block's vectors take as doubles at most; larger buckets have more blocks
BLOCKS = 4
HELD = 16 << 20
#: rows and columns that are multiplied at once, and products that a task makes
TILE = 1024
PAIRS = 1 << 28


def _units(column, norms) -> np.ndarray:
    """The rows of a list column of numbers, all of the same length, over their norms."""
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) / norms.to_numpy()[:, None]


def _meet(key, rows):
    """Least and greatest cosine of each vector of two blocks to those of the other one, or of a block to the others in it."""
    _, i, j = (k.as_py() for k in key)
    unit, first = _units(rows.column("_v"), rows.column("_l")), rows.column("_p").to_numpy() == i
    x = np.flatnonzero(first)
    y = x if i == j else np.flatnonzero(~first)
    low, high = np.full(len(unit), np.inf), np.full(len(unit), -np.inf)
    for a in range(0, len(x), TILE):
        for b in range(a if i == j else 0, len(y), TILE):
            s, t = x[a : a + TILE], y[b : b + TILE]
            p = unit[s] @ unit[t].T
            for end, fold, none in ((low, np.minimum, np.inf), (high, np.maximum, -np.inf)):
                if i == j and a == b:
                    np.fill_diagonal(p, none)
                end[s] = fold(end[s], fold.reduce(p, axis=1))
                end[t] = fold(end[t], fold.reduce(p, axis=0))
    return pa.table({"_r": rows.column("_r"), "lo": low, "hi": high})


def bucket_mates(vectors: DataFrame, ident: str, bucket: str, vector: str, block: int = BLOCK) -> DataFrame:
    """``(id, bucket, mates, least, mean, greatest)``: the cosine of each vector to all others of its bucket.

    The mean follows from the sum of the bucket's unit vectors.  For least and greatest the bucket is cut into blocks: ``BLOCKS`` of at least about ``block`` vectors, or as many more as hold
    ``HELD`` bytes each.  Two blocks meet in a group of rows, whose products are made tile by tile and leave two numbers a row; so a bucket of any size is spread over its pairs of blocks,
    and what is shuffled is vectors times blocks, never pairs of vectors.  A vector with no direction (null, empty, all zeros, or with a null or non-finite component) has no cosines and is
    nobody's mate; alone in its bucket a vector has none either.  Ids are unique; null buckets are one bucket.
    """
    x, length = lambda c: c.cast("double"), F.col("_l")
    v = F.col(vector) if vectors.schema[vector].dataType.elementType.typeName() == "float" else F.col(vector).cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, c: s + x(c) * x(c)))
    good = (F.size("_v") > 0) & F.forall("_v", lambda c: c.isNotNull() & ~F.isnan(x(c)) & (F.abs(x(c)) < float("inf"))) & (length > 0)
    rows = vectors.select(F.col(ident).alias("_id"), F.struct(F.col(bucket).alias("b")).alias("_b"), v.alias("_v"), norm.alias("_l"))
    rows = stored(rows.select(F.monotonically_increasing_id().alias("_r"), "_id", "_b", "_v", F.when(good, length).alias("_l")))
    unit = rows.where("_l is not null")
    held = F.ceil(F.count("*") * F.max(F.size("_v")) * 8 / HELD)
    sizes = unit.groupBy("_b").agg(F.count("*").alias("_n"), F.greatest(F.least(F.ceil(F.count("*") / block), F.lit(BLOCKS)), held).cast("int").alias("_k"))
    sums = unit.select("_b", "_l", F.posexplode("_v").alias("_i", "_x")).groupBy("_b", "_i").agg(F.sum(x(F.col("_x")) / length).alias("_s")).groupBy("_b").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_s"))), lambda p: p["_s"]).alias("_sum"))
    sizes, seen = stored_with(sizes.join(sums, "_b").withColumn("_g", F.monotonically_increasing_id()), F.sum(F.col("_n").cast("double") * F.col("_n")).alias("pairs"))
    tasks = max(int(seen["pairs"] or 0) // PAIRS + 1, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = unit.join(sizes.where("_n > 1").select("_b", "_g", "_k"), "_b").select("_g", "_k", F.pmod(F.xxhash64("_r"), F.col("_k")).cast("int").alias("_p"), "_r", "_v", "_l")
    met = placed.withColumn("_q", F.explode(F.sequence(F.lit(0), F.col("_k") - 1))).select("_g", F.least("_p", "_q").alias("i"), F.greatest("_p", "_q").alias("j"), "_p", "_r", "_v", "_l")
    ends = met.repartition(tasks, "_g", "i", "j").groupBy("_g", "i", "j").applyInArrow(_meet, "_r long, lo double, hi double").groupBy("_r").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    own = F.aggregate(F.zip_with("_v", "_sum", lambda a, s: x(a) / length * s), F.lit(0.0), lambda s, c: s + c)
    mates = F.when(length.isNotNull(), F.col("_n") - 1).otherwise(0)
    out = rows.join(sizes.select("_b", "_n", "_sum"), "_b", "left").select("_r", "_id", "_b", mates.cast("long").alias("mates"), F.when(mates > 0, (own - 1) / (F.col("_n") - 1)).alias("mean")).join(ends, "_r", "left")
    some = F.col("mates") > 0
    return out.select(F.col("_id").alias(ident), F.col("_b.b").alias(bucket), "mates", F.when(some, F.col("lo")).alias("least"), "mean", F.when(some, F.col("hi")).alias("greatest"))
