"""Join operators: equality joins in all their forms, range and as-of lookups, diffs, precedence and similarity joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import stored, stored_with


def star_join(fact: DataFrame, *dims: tuple[DataFrame, str, str], how: str = "inner") -> DataFrame:
    """Join ``fact`` to each ``(dimension, fact key, dimension key)`` in turn."""
    for dim, fk, pk in dims:
        fact = fact.join(dim, fact[fk] == dim[pk], how)
    return fact


def left_with_condition(left: DataFrame, right: DataFrame, on, keep: Column) -> DataFrame:
    """A left join whose right-side filter belongs to the join: rows without a kept partner survive with nulls."""
    return left.join(right.where(keep), on, "left")


def range_lookup(values: DataFrame, value: str, ranges: list[tuple[str, int | None, int | None]], label: str, undated: str = "Undated") -> DataFrame:
    """Label each value by the half-open range ``[start, end)`` that holds it; an open end is None.

    The ranges are literals, so the lookup is one CASE and needs no join.  A null value is ``undated``; a value
    outside all ranges has a null label.
    """
    v = F.col(value)
    case = F.when(v.isNull(), F.lit(undated))
    for name, start, end in ranges:
        inside = F.lit(True)
        if start is not None:
            inside = inside & (v >= start)
        if end is not None:
            inside = inside & (v < end)
        case = case.when(inside, F.lit(name))
    return values.withColumn(label, case)


def range_join(values: DataFrame, value: str, ranges: DataFrame, start: str, end: str, cell: int) -> DataFrame:
    """Join values to the rows of a *table* of half-open ranges: both sides are dealt into cells of ``cell``
    units, so the join stays an equality; a null end is open up to the largest value."""
    top = values.agg(F.max(value).alias("_top"))
    r = ranges.crossJoin(F.broadcast(top))  # one row
    r = r.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(start) / cell), F.floor(F.greatest(F.coalesce(F.col(end) - 1, F.col("_top")), F.col(start)) / cell))))
    v = values.withColumn("_cell", F.floor(F.col(value) / cell))
    return v.join(r, "_cell").where((F.col(value) >= F.col(start)) & (F.col(end).isNull() | (F.col(value) < F.col(end)))).drop("_cell", "_top")


def asof_join(left: DataFrame, right: DataFrame, by: str, at: str, right_at: str, take: dict[str, str]) -> DataFrame:
    """For each left row the last right row with the same key at or before it, or nulls.

    One shuffle: both sides are stacked and the latest right row is carried forward in order of (time, side).
    """
    order = Window.partitionBy(by).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    carried = F.struct(*[F.col(c).alias(n) for c, n in take.items()])
    stacked = left.select(F.col(by), F.col(at).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_l"), F.lit(None).cast(right.select(carried).schema[0].dataType).alias("_r")).unionByName(
        right.select(F.col(by), F.col(right_at).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("_l"), carried.alias("_r"))
    )
    out = stacked.withColumn("_last", F.last("_r", ignorenulls=True).over(order)).where("_side = 1")
    return out.select("_l.*", *[F.col(f"_last.{n}").alias(n) for n in take.values()])


def snapshot_diff(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows on one side only or with another value: keys, ``value_a``, ``value_b``, ``delta`` (null unless both are there)."""
    x, y = a.withColumnRenamed(value, "value_a"), b.withColumnRenamed(value, "value_b")
    both = x.join(y, keys, "full_outer").where(~F.col("value_a").eqNullSafe(F.col("value_b")))
    return both.withColumn("delta", F.col("value_b") - F.col("value_a"))


def tiered_lookup(tiers: list[DataFrame], key: str, order: list[str]) -> DataFrame:
    """One row per key from the first tier that has it; ``tier`` counts from 1, ties go by ``order``."""
    stacked = reduce(DataFrame.unionByName, [t.withColumn("tier", F.lit(i)) for i, t in enumerate(tiers, 1)])
    first = F.row_number().over(Window.partitionBy(key).orderBy("tier", *order))
    return stacked.withColumn("_k", first).where("_k = 1").drop("_k")


def token_overlap_join(rows: DataFrame, id_col: str, tokens: str, least: float, max_bucket: int | None = None) -> DataFrame:
    """Pairs ``(a, b, overlap)``, a < b, whose token sets overlap by ``least`` of the smaller set, over an inverted index.

    The smaller set asks with its rarest tokens alone: of n tokens, one of the first ``n - ceil(least * n) + 1`` is in any partner, so
    common tokens name candidates only where a set has no other.  Tokens in more than ``max_bucket`` sets are left out
    as candidates where that is the caller's rule; they still count in the overlap.
    """
    sets = rows.select(F.col(id_col).alias("id"), F.array_distinct(tokens).alias("s")).where("size(s) > 0")
    posted = sets.select("id", F.size("s").alias("n"), F.explode("s").alias("t"))
    often = posted.groupBy("t").agg(F.count("*").alias("df"))
    posted = posted.join(often, "t")
    if max_bucket is not None:
        posted = posted.where(F.col("df") <= max_bucket)
        asks = posted
    else:
        rank = F.row_number().over(Window.partitionBy("id").orderBy("df", "t"))
        asks = posted.withColumn("k", rank).where(F.col("k") <= F.col("n") - F.ceil(F.round(F.col("n") * least, 9)) + 1)
    smaller = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.id") < F.col("y.id")))
    met = asks.alias("x").join(posted.alias("y"), (F.col("x.t") == F.col("y.t")) & smaller)
    pairs = met.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()
    left, right = sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), sets.select(F.col("id").alias("b"), F.col("s").alias("sb"))
    both = pairs.join(left, "a").join(right, "b")
    overlap = F.size(F.array_intersect("sa", "sb")) / F.least(F.size("sa"), F.size("sb"))
    return both.select("a", "b", overlap.alias("overlap")).where(F.col("overlap") >= least)


def unique_key_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join on ``key`` with right rows whose key is unique on the right; ambiguous keys match nothing."""
    alone = right.withColumn("_n", F.count("*").over(Window.partitionBy(key))).where("_n = 1").drop("_n")
    return left.join(alone, key)


def capped_product(parts: DataFrame, key: str, part: str, choice: str, order: list[str], per_part: int) -> DataFrame:
    """All ways to take one choice for each part of a key, the first ``per_part`` choices of a part at most:
    ``(key, combo)`` with the choices in order of the parts."""
    rank = F.row_number().over(Window.partitionBy(key, part).orderBy(*order))
    lists = parts.withColumn("_k", rank).where(F.col("_k") <= per_part).groupBy(key, part).agg(F.sort_array(F.collect_list(F.struct("_k", choice))).alias("c"))
    grouped = lists.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct(part, "c"))), lambda x: F.transform(x["c"], lambda y: y[choice])).alias("all"))
    step = lambda acc, cs: F.flatten(F.transform(acc, lambda head: F.transform(cs, lambda c: F.concat(head, F.array(c)))))
    start = F.array(F.array().cast("array<string>"))
    return grouped.select(key, F.explode(F.aggregate(F.transform("all", lambda cs: F.transform(cs, lambda c: c.cast("string"))), start, step)).alias("combo"))


def resolve_mentions(mentions: DataFrame, entities: DataFrame, form: str, hint: str, region: str, entity: str) -> DataFrame:
    """``mentions`` with the id of the entity they name: the only one of that form, else the only one whose
    region stands in the hint as whole words (letters and digits in lower case; what is between them doesn't count), else null.  A region without
    a letter or digit stands in none.

    Entities are counted by form and by (form, region) first, and each distinct (form, hint) is looked up once, so neither the
    entities nor the mentions of a common form meet in full.
    """
    words = lambda c: F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    cells = entities.groupBy(form, words(region).alias("_r")).agg(F.count("*").alias("_n"), F.min(entity).alias("_e"))
    alone = cells.groupBy(form).agg(F.sum("_n").alias("_all"), F.min("_e").alias("_only"))
    asks = mentions.select(form, F.col(hint).alias("_h")).distinct().where("_h is not null")
    fits = asks.join(cells.where("trim(_r) <> ''"), form).where(F.contains(words("_h"), F.col("_r"))).groupBy(F.col(form).alias("_form"), "_h").agg(F.sum("_n").alias("_fits"), F.min("_e").alias("_fit"))
    joined = mentions.join(alone, form, "left").join(fits, (mentions[form] == fits["_form"]) & (mentions[hint] == fits["_h"]), "left")
    chosen = F.when(F.col("_all") == 1, F.col("_only")).when(F.col("_fits") == 1, F.col("_fit"))
    return joined.withColumn("resolved", chosen).drop("_all", "_only", "_form", "_h", "_fits", "_fit")


PAIRS = 4_000_000
LIST = 1_000


def shared_group_pairs(rows: DataFrame, member: str, group: str) -> DataFrame:
    """``(a, b, shared)``: pairs of members, the smaller one first, with the number of groups that both are in.

    Each member of a group meets the lists of the group's other members (``LIST`` long at most) and goes with what is greater in them to the tasks that count its pairs, as
    many tasks as hold ``PAIRS`` pairs each; a member with more than that is split by the other one.  So no task counts more pairs in larger tables, however many members a group has.
    """
    m = stored(rows.select(F.col(member).alias("s"), F.col(group).alias("g")).where("s is not null and g is not null").distinct())
    sizes, seen = stored_with(m.groupBy("g").agg(F.count("*").alias("c")).where("c > 1"), F.sum(F.expr("c * (c - 1)")).alias("n"))
    ends = seen["n"] or 0
    keyed = stored(m.join(sizes, "g").select("g", "s", "c", F.ceil(F.col("c") / LIST).cast("int").alias("k")))
    bucket = F.pmod(F.hash("s"), "k")
    lists = keyed.groupBy("g", "k", bucket.alias("_j")).agg(F.collect_list("s").alias("bs")).select("g", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("_i"), "bs")
    busy = F.broadcast(keyed.groupBy(F.col("s").alias("a")).agg(F.sum("c").alias("w")).where(F.col("w") > PAIRS).select("a", F.ceil(F.col("w") / PAIRS).cast("int").alias("h")))  # few: 2 * ends / PAIRS
    met = keyed.select("g", bucket.alias("_i"), F.col("s").alias("a")).join(lists, ["g", "_i"]).select("a", F.filter("bs", lambda b: b > F.col("a")).alias("bs")).where("size(bs) > 0")
    met = met.join(busy, "a", "left").select("a", "bs", F.coalesce("h", F.lit(1)).alias("h")).withColumn("r", F.explode(F.sequence(F.lit(0), F.col("h") - 1)))
    part = F.when(F.col("h") == 1, F.col("bs")).otherwise(F.filter("bs", lambda b: F.pmod(F.hash(b), F.col("h")) == F.col("r")))
    tasks = max(ends // (2 * PAIRS) + 1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = met.select("a", "r", part.alias("bs")).repartition(tasks, "a", "r")
    return dealt.select("a", "r", F.explode("bs").alias("b")).groupBy("a", "r", "b").agg(F.count("*").alias("shared")).select("a", "b", "shared")
