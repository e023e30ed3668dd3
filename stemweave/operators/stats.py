"""Distributions and their divergences, grading, smoothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import stored

EPSILON = 1e-9


def distribution(df: DataFrame, key: str, n: str | None = None) -> DataFrame:
    """``(key, p)``: shares of the rows, or of the sum of ``n``; nothing for an empty table."""
    counts = df.groupBy(key).agg((F.sum(n) if n else F.count("*")).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_t"))
    return counts.crossJoin(F.broadcast(total)).select(key, (F.col("_n") / F.col("_t")).alias("p"))  # one row


def kl_divergence(p: DataFrame, q: DataFrame, key: str) -> DataFrame:
    """One row ``kl``: sum of p ln(p / (q + 1e-9)) over the keys with p > 0."""
    both = p.where("p > 0").join(q.select(key, F.col("p").alias("q")), key, "left")
    return both.agg(F.coalesce(F.sum(F.col("p") * F.log(F.col("p") / (F.coalesce("q", F.lit(0.0)) + EPSILON))), F.lit(0.0)).alias("kl"))


def total_variation(p: DataFrame, q: DataFrame, key: str) -> DataFrame:
    """One row ``tv``: half the sum of absolute differences."""
    both = p.join(q.select(key, F.col("p").alias("q")), key, "full_outer")
    return both.agg(F.coalesce(F.sum(F.abs(F.coalesce("p", F.lit(0.0)) - F.coalesce("q", F.lit(0.0)))) / 2, F.lit(0.0)).alias("tv"))


def spearman(a: DataFrame, b: DataFrame, key: str, rank: str = "rank") -> DataFrame:
    """One row ``rho``: Pearson's correlation of the given ranks over shared keys; 0.0 below two keys or without variance."""
    both = a.select(key, F.col(rank).alias("x")).join(b.select(key, F.col(rank).alias("y")), key)
    r = F.when((F.count("*") > 1) & (F.stddev_pop("x") > 0) & (F.stddev_pop("y") > 0), F.corr("x", "y"))
    return both.agg(F.coalesce(r, F.lit(0.0)).alias("rho"))


def fraction_true(df: DataFrame, flag: Column, out: str = "fraction") -> DataFrame:
    """One row: the mean of a boolean; null for an empty table."""
    return df.agg(F.avg(flag.cast("double")).alias(out))


def grade(df: DataFrame, found: str, wanted: str) -> DataFrame:
    """Per row: recall of a wanted set, rate of spurious elements, exactness, coverage and a hit on the head element."""
    hits = F.size(F.array_intersect(found, wanted))
    return df.select(
        "*", (hits / F.greatest(F.size(F.array_distinct(wanted)), F.lit(1))).alias("recall"),
        (F.size(F.array_except(found, wanted)) / F.greatest(F.size(F.array_distinct(found)), F.lit(1))).alias("spurious"),
        F.col(found).eqNullSafe(F.col(wanted)).alias("exact"), (hits > 0).alias("covered"), F.coalesce(F.get(found, F.lit(0)) == F.get(wanted, F.lit(0)), F.lit(False)).alias("head_hit"),
    )


def paired_diff(off: DataFrame, on: DataFrame, key: str, dimensions: dict[str, bool]) -> DataFrame:
    """Regressions and improvements of each row between two configurations; a dimension maps to whether more is better."""
    both = off.alias("a").join(on.alias("b"), key)
    change = {d: (F.col(f"b.{d}") - F.col(f"a.{d}")) * (1 if up else -1) for d, up in dimensions.items()}
    listed = lambda test: F.array_compact(F.array(*[F.when(test(c), F.lit(d)) for d, c in change.items()]))
    return both.select(key, listed(lambda c: c < 0).alias("regressions"), listed(lambda c: c > 0).alias("improvements"))


def eb_smoothing(df: DataFrame, split: str, literal: str, k: float = 5.0) -> DataFrame:
    """``probability = (split + k * backoff) / (n + k)``; the backoff is the overall rate, 0.5 without any count."""
    total = df.agg((F.sum(split) / F.nullif(F.sum(F.col(split) + F.col(literal)), F.lit(0))).alias("_b"))
    rate = F.coalesce("_b", F.lit(0.5))
    return df.crossJoin(F.broadcast(total)).withColumn("probability", (F.col(split) + k * rate) / (F.col(split) + F.col(literal) + k)).drop("_b")  # one row


def ranked(df: DataFrame, key: str, n: str) -> DataFrame:
    """Keys with their rank by count, ties in order of the key: ranges are numbered apart, and the sizes of those before are added."""
    spread = stored(df.repartitionByRange(F.desc(n), key).withColumn("_p", F.spark_partition_id()))
    sizes = spread.groupBy("_p").agg(F.count("*").alias("_c"))
    before = F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))  # one row per range
    offsets = sizes.select("_p", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(F.desc(n), key))
    return spread.withColumn("_i", inside).join(F.broadcast(offsets), "_p").withColumn("rank", (F.col("_i") + F.col("_before")).cast("int")).drop("_p", "_i", "_before")


def realism_report(sample: DataFrame, reference: DataFrame, key: str, bands: dict[str, float]) -> DataFrame:
    """``(metric, value, limit, violated)`` of a sample's distribution against a reference."""
    p, q = distribution(sample, key), distribution(reference, key)
    rows = kl_divergence(p, q, key).select(F.lit("kl").alias("metric"), F.col("kl").alias("value")).union(total_variation(p, q, key).select(F.lit("tv"), "tv"))
    limit = F.create_map(*[F.lit(x) for kv in bands.items() for x in kv])
    return rows.withColumn("limit", F.try_element_at(limit, F.col("metric"))).withColumn("violated", F.coalesce(F.col("value") > F.col("limit"), F.lit(False)))
