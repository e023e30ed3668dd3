"""Set operators: expansion from seeds, ledgers, merges of set-valued fields, vocabulary scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def expand_seeds(seeds: DataFrame, edges: DataFrame, key: str, src: str, dst: str) -> DataFrame:
    """Seeds and their neighbours one hop away in either direction, distinct."""
    out = edges.join(seeds, edges[src] == seeds[key], "left_semi").select(F.col(dst).alias(key))
    back = edges.join(seeds, edges[dst] == seeds[key], "left_semi").select(F.col(src).alias(key))
    return seeds.select(key).union(out).union(back).distinct()


def remaining(cohort: DataFrame, *ledgers: DataFrame, key: str) -> DataFrame:
    """The cohort without the keys of any ledger."""
    for ledger in ledgers:
        cohort = cohort.join(ledger, key, "left_anti")
    return cohort


def keep_existing(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Union in which existing rows win over new ones with the same key, and the first of equal new rows counts."""
    both = existing.withColumn("_o", F.lit(0)).unionByName(new.withColumn("_o", F.lit(1)))
    order = Window.partitionBy(*keys).orderBy("_o", *[c for c in new.columns if c not in keys])
    return both.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k", "_o")


def merge_fields(rows: DataFrame, key: str, order: str, arrays: list[str], scalars: list[str]) -> DataFrame:
    """One row per key: array fields united in first-seen order, scalar fields the first that is not null.

    A key's history is never gathered: scalars are minima, and of an array field only the first place of each distinct element is kept.
    """
    out = rows.groupBy(key).agg(F.count("*").alias("_n"), *[F.min(F.when(F.col(c).isNotNull(), F.struct(order, c))).alias(c) for c in scalars])
    out = out.select(key, *[F.col(c)[c].alias(c) for c in scalars])
    for c in arrays:
        each = rows.select(key, order, F.posexplode(c).alias("_i", "_e"))
        first = each.groupBy(key, "_e").agg(F.min(F.struct(order, "_i")).alias("_at"))
        lists = first.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("_at", "_e"))), lambda x: x["_e"]).alias(c))
        out = out.join(lists.withColumnRenamed(key, "_k"), F.col(key).eqNullSafe(F.col("_k")), "left").drop("_k").withColumn(c, F.coalesce(c, F.array().cast(rows.schema[c].dataType)))
    return out.select(key, *arrays, *scalars)


def vocabulary_scan(df: DataFrame, column: str, canonical: list[str], aliases: dict[str, str]) -> DataFrame:
    """Each distinct value with its count and status: ok, stale (an alias, with its target), dirty (differs from a
    canonical value in case or blanks only), unknown, or info for nulls."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    alias = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv]) if aliases else F.create_map().cast("map<string,string>")
    folded = F.lower(F.trim("value"))
    status = F.when(F.col("value").isNull(), "info").when(F.col("value").isin(canonical), "ok").when(F.col("value").isin(list(aliases)), "stale").when(folded.isin([c.lower() for c in canonical]), "dirty").otherwise("unknown")
    return counts.select("value", "n", status.alias("status"), F.try_element_at(alias, F.col("value")).alias("target"))
