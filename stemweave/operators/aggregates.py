"""Aggregation operators: roll-ups, signatures, count cubes with skip reasons, tallies and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


TASK_ROWS = 1_000_000
SPREAD = 8


def tasks_for(rows: DataFrame) -> int:
    """As many tasks as hold ``TASK_ROWS`` of ``rows`` each, and not fewer than the session's.  Rows that are dealt over a given number of tasks stay so, where Spark would put
    small shuffled rows together until a task's hash tables hold very many of them."""
    return max(rows.count() // TASK_ROWS + 1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def unflagged_impact(rows: DataFrame, key: str, value: str, flag: Column, out: str) -> DataFrame:
    """``(key, out)``: the number of distinct values of each key none of whose rows has the flag.

    Rows meet by key and value in tasks of ``TASK_ROWS``, a key in ``SPREAD`` of them at most, so that one with a large share of the rows is not one task's.
    """
    slim = rows.select(key, value, F.coalesce(flag, F.lit(False)).alias("_flag")).where(F.col(key).isNotNull())
    dealt = slim.withColumn("_r", F.pmod(F.hash(value), F.lit(SPREAD))).repartition(tasks_for(rows), key, "_r")
    each = dealt.groupBy(key, "_r", value).agg(F.bool_or("_flag").alias("_flag")).groupBy(key, "_r").agg(F.count(value).alias("_n"), F.bool_or("_flag").alias("_flag"))
    return each.groupBy(key).agg(F.sum("_n").alias(out), F.bool_or("_flag").alias("_flag")).where("not _flag").drop("_flag")


def table_counts(tables: dict[str, DataFrame | None]) -> DataFrame:
    """``(name, n)`` for each named table; a missing one counts -1.  One job for all of them."""
    have = [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, t in tables.items() if t is not None]
    out = have[0]
    for t in have[1:]:
        out = out.unionByName(t)
    for name, t in tables.items():
        if t is None:
            out = out.unionByName(have[0].limit(1).select(F.lit(name).alias("name"), F.lit(-1).cast("long").alias("n")))
    return out


def witness_rollup(entities: DataFrame, witnesses: DataFrame, root: Column, key: str, witness: str, out: str = "witnesses") -> DataFrame:
    """Distinct witnesses per rolled-up root; roots without any count 0.

    ``entities`` holds ``key``, which ``witnesses`` refers to; ``root`` maps an entity to its root.
    """
    rooted = entities.select(F.col(key), root.alias("root"))
    return rooted.join(witnesses.select(key, witness), key, "left").groupBy("root").agg(F.count_distinct(F.col(witness)).alias(out))


def ordered_signature(df: DataFrame, keys: list[str], value: str, order: list[str], sep: str = ",", out: str = "signature") -> DataFrame:
    """Values of a key joined in order; nulls are skipped and an empty list is null."""
    listed = F.sort_array(F.collect_list(F.struct(*order, F.col(value).cast("string").alias("_v"))))
    joined = F.array_join(F.transform(listed, lambda x: x["_v"]), sep)
    return df.groupBy(*keys).agg(F.when(F.count(value) > 0, joined).alias(out))


def earliest_of_two(a: DataFrame, b: DataFrame, key: str, year: str) -> DataFrame:
    """The earliest value per key over two evidence tables."""
    return a.select(key, year).unionByName(b.select(key, year)).groupBy(key).agg(F.min(year).alias("earliest"))


def productivity(parts: DataFrame, whole: str, ordinal: str, entity: str, universe: DataFrame) -> DataFrame:
    """Distinct wholes in which an entity stands first, last or within; zero for entities never used.

    The first part of a whole is ``pre`` (a sole one too), the last ``post``, others ``inner``.
    """
    # a whole's parts meet once, in tasks of a bounded number of rows; what is left is one row per (whole, entity, place), so counts need no distinct
    slim = parts.select(F.col(whole).alias("_w"), F.col(ordinal).alias("_i"), entity).where(F.col("_w").isNotNull())
    w = Window.partitionBy("_w")
    pos = F.when(F.col("_i") == F.min("_i").over(w), 0).when(F.col("_i") == F.max("_i").over(w), 1).otherwise(2)
    placed = slim.repartition(tasks_for(parts), "_w").select("_w", entity, pos.alias("_p")).distinct()
    name = F.when(F.col("_p") == 0, "pre").when(F.col("_p") == 1, "post").otherwise("inner")
    used = placed.groupBy(entity, "_p").agg(F.count("*").alias("n")).select(entity, name.alias("position"), "n")
    grid = universe.select(entity).distinct().withColumn("position", F.explode(F.array(*map(F.lit, ("pre", "post", "inner")))))
    return grid.join(used, [entity, "position"], "left").select(entity, "position", F.coalesce("n", F.lit(0)).alias("productivity"))


def set_size_histogram(df: DataFrame, key: str, bucket: str, universe: DataFrame) -> DataFrame:
    """How many entities have 0, 1, 2 ... distinct non-null buckets."""
    sizes = df.groupBy(key).agg(F.count_distinct(F.col(bucket)).alias("buckets"))
    return universe.select(key).distinct().join(sizes, key, "left").groupBy(F.coalesce("buckets", F.lit(0)).alias("buckets")).agg(F.count("*").alias("entities"))


def count_cube(df: DataFrame, cell: list[str], skips: list[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """``(cells with counts, statuses with counts)``: each row gets the first skip reason that holds, or ``ok``;
    only ok rows are counted into cells."""
    status = F.lit("ok")
    for name, test in reversed(skips):
        status = F.when(test, name).otherwise(status)
    marked = df.withColumn("status", status)
    return marked.where("status = 'ok'").groupBy(*cell).agg(F.count("*").alias("n")), marked.groupBy("status").agg(F.count("*").alias("n"))


def fallback_max(cube: DataFrame, asks: DataFrame, dims: list[str], wild: list[list[str]], value: str, out: str = "value") -> DataFrame:
    """Look up each ask at its exact cell, then with ever more dimensions wild; the maximum of the level's cells.

    ``wild`` lists the dimensions that each further level ignores.  A stored zero counts as found; nothing
    found is 0.0.
    """
    got = asks
    names = []
    for i, ignored in enumerate([[], *wild]):
        keys = [d for d in dims if d not in ignored]
        level = cube.groupBy(*keys).agg(F.max(value).alias(f"_v{i}")) if keys else cube.agg(F.max(value).alias(f"_v{i}"))
        got = got.join(level, keys, "left") if keys else got.crossJoin(F.broadcast(level))  # one row
        names.append(f"_v{i}")
    return got.withColumn(out, F.coalesce(*names, F.lit(0.0))).drop(*names)


def cumulative_weights(df: DataFrame, group: str, key: str, weight: str) -> DataFrame:
    """Strictly increasing prefix sums of the positive weights of each group, in order of the key."""
    w = Window.partitionBy(group).orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    return df.where(F.col(weight) > 0).withColumn("cumulative", F.sum(weight).over(w))


def adjacent_pairs(df: DataFrame, seq: str) -> DataFrame:
    """Counts of consecutive (left, right) elements over all sequences."""
    pair = F.transform(F.sequence(F.lit(1), F.size(seq) - 1), lambda i: F.struct(F.element_at(seq, i).alias("left"), F.element_at(seq, i + 1).alias("right")))
    return df.where(F.size(seq) > 1).select(F.explode(pair).alias("p")).groupBy("p.left", "p.right").agg(F.count("*").alias("n"))


def conditional_table(pairs: DataFrame, left: str, right: str, n: str) -> DataFrame:
    """P(right | left) from counted pairs."""
    return pairs.withColumn("p", F.col(n) / F.sum(n).over(Window.partitionBy(left)))


def winning_cluster(clusters: DataFrame, place: str, key: str, row: str) -> DataFrame:
    """Per place: the element-sequence key with most rows and at least two of them (ties to the lowest row id), and
    the runner-up's count; places whose keys are all empty have no winner."""
    votes = clusters.where(F.col(key) != "").groupBy(place, key).agg(F.count("*").alias("votes"), F.min(row).alias("first"))
    ranked = votes.withColumn("k", F.row_number().over(Window.partitionBy(place).orderBy(F.desc("votes"), "first")))
    top = ranked.groupBy(place).agg(F.max(F.when((F.col("k") == 1) & (F.col("votes") >= 2), F.col(key))).alias("winner"), F.max(F.when(F.col("k") == 1, F.col("votes"))).alias("votes"), F.coalesce(F.max(F.when(F.col("k") == 2, F.col("votes"))), F.lit(0)).alias("runner_up"))
    return clusters.select(place).distinct().join(top, place, "left").select(place, "winner", F.coalesce("votes", F.lit(0)).alias("votes"), F.coalesce("runner_up", F.lit(0)).alias("runner_up"))


def corroborated(evidence: DataFrame, families: DataFrame, key: str, source: str, excluded: str, least: int) -> DataFrame:
    """Families with at least ``least`` distinct sources other than ``excluded``; 0 admits all."""
    n = evidence.groupBy(key).agg(F.count_distinct(F.when(F.col(source) != excluded, F.col(source))).alias("others"))
    return families.select(key).distinct().join(n, key, "left").select(key, F.coalesce("others", F.lit(0)).alias("others")).where(F.col("others") >= least)


def promotion_union(counted: DataFrame, key: str, language: str, witnesses: str, thresholds: dict[str, int], default: int, flat: list[DataFrame]) -> DataFrame:
    """Keys admitted by their language's witness threshold, or by any flat channel."""
    limit = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in thresholds.items() for x in kv]), F.col(language)), F.lit(default))
    out = counted.where(F.col(witnesses) >= limit).select(key)
    for channel in flat:
        out = out.union(channel.select(key))
    return out.distinct()


def source_dependence(evidence: DataFrame, key: str, source: str, members: list[str]) -> DataFrame:
    """Each key's sources against a set: ``only`` (all within), ``mixed`` or ``none``."""
    inside = F.col(source).isin(members)
    return evidence.groupBy(key).agg(F.when(F.bool_and(inside), "only").when(F.bool_or(inside), "mixed").otherwise("none").alias("dependence"))


def hierarchical_report(df: DataFrame, levels: list[str], measures: dict[str, Column]) -> DataFrame:
    """Totals at every prefix of ``levels``; a level that is summed over is null and ``depth`` says how many are kept."""
    depth = sum((F.when(F.grouping(c) == 0, 1).otherwise(0) for c in levels), F.lit(0))
    return df.rollup(*levels).agg(*[m.alias(n) for n, m in measures.items()], depth.cast("long").alias("depth")).where("depth > 0")


def null_population(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column_name, filled, total)`` in one pass."""
    one = df.agg(F.count("*").alias("_n"), *[F.count(c).alias(c) for c in columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("filled"), F.col("_n").alias("total")) for c in columns])).alias("x")).select("x.*")


def flag_rate(df: DataFrame, group: str, flag: Column) -> DataFrame:
    """Rows, flagged rows and rate per group."""
    return df.groupBy(group).agg(F.count("*").alias("n"), F.count_if(flag).alias("flagged"), (F.count_if(flag) / F.count("*")).alias("rate"))


def gap_matrix(df: DataFrame, band: Column, dimensions: dict[str, Column]) -> DataFrame:
    """Rows per band, and how many of them miss each dimension."""
    return df.groupBy(band.alias("band")).agg(F.count("*").alias("n"), *[F.count_if(~have).alias(f"no_{name}") for name, have in dimensions.items()])
