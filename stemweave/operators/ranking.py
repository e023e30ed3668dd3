"""Top-1, dedupe and ordering operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key by a total order (first-wins dedupe, argmax with ties, precedence pick)."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def top_n_per_key(df: DataFrame, keys: list[str], order: list, n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each key, with their rank."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n)


def unanimous(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """The single distinct value of each key, or null: differing values and any null taint the key."""
    one = (F.count_distinct(F.col(value)) == 1) & (F.count("*") == F.count(value))
    return df.groupBy(*keys).agg(F.when(one, F.min(value)).alias(out))


def argmax_with_conflict(df: DataFrame, key: str, score: str, ident: str, root: str) -> DataFrame:
    """``(key, best, conflict)``: the highest score, ties to the lowest id; a conflict where a key has several roots."""
    best = F.max_by(ident, F.struct(F.col(score), -F.col(ident)))
    return df.groupBy(key).agg(best.alias("best"), (F.count_distinct(root) > 1).alias("conflict"))


def frequency_pick(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """The most frequent non-empty value of each key; ties go to the first in alphabetical order."""
    counts = df.where(F.col(value).isNotNull() & (F.col(value) != "")).groupBy(*keys, value).count()
    return first_per_key(counts, keys, [F.desc("count"), value]).select(*keys, F.col(value).alias(out))


def case_fold_groups(df: DataFrame, form: str, precedence: Column, ident: str) -> DataFrame:
    """Groups of forms equal when lower-cased: the representative by precedence, then id, and the group's size."""
    return df.groupBy(F.lower(form).alias("folded")).agg(F.min_by(form, F.struct(precedence, F.col(ident))).alias("representative"), F.count("*").alias("members"))


def next_slice(df: DataFrame, done: list[DataFrame], key: str, order: list, n: int) -> DataFrame:
    """The next ``n`` rows by ``order`` whose key is in none of the ledgers."""
    for ledger in done:
        df = df.join(ledger.select(key).distinct(), key, "left_anti")
    return df.orderBy(*order).limit(n)
