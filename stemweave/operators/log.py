"""Event-log operators: folding, validation, effective assertions, overlays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import stored

OPS = ("add", "set", "patch", "remove")


def fold_log(log: DataFrame, keys: list[str], order: str, op: str, fields: str) -> DataFrame:
    """``(keys, live, state, errors)``: the state of each key after its events in order.

    ``fields`` is a ``map<string,string>``.  ``set`` overwrites, ``add`` is an error on a live key, ``patch``
    merges fields and is an error on a missing key, ``remove`` is idempotent.  Errors change nothing.

    No history is gathered: whether a key is live before an event follows from the last event that was no patch, the
    state is the latest value of each field since the last event that began it, and both are a window and sums.
    """
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col(op) != "patch", F.col(op)), ignorenulls=True).over(before)
    marked = log.select(*keys, F.col(order).alias("_o"), F.col(op).alias("_op"), F.col(fields).alias("_f"), F.coalesce(last.isin("set", "add"), F.lit(False)).alias("_live"))
    bad = (F.col("_live") & (F.col("_op") == "add")) | (~F.col("_live") & (F.col("_op") == "patch"))
    begins = F.col("_op").isin("set", "remove") | (~F.col("_live") & (F.col("_op") == "add"))
    heads = marked.groupBy(*keys).agg(F.max(F.when(begins, F.struct("_o", "_op"))).alias("_b"), F.count_if(bad).cast("int").alias("errors"))
    since = marked.where(~bad & (F.col("_op") != "remove")).join(heads.select(*keys, F.col("_b._o").alias("_from")), keys).where("_o >= _from")
    latest = since.select(*keys, "_o", F.explode("_f").alias("_k", "_v")).groupBy(*keys, "_k").agg(F.max_by("_v", "_o").alias("_v"))
    state = latest.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_k", "_v"))).alias("state"))
    live = F.coalesce(F.col("_b._op") != "remove", F.lit(False))
    return heads.join(state, keys, "left").select(*keys, live.alias("live"), F.coalesce("state", F.create_map().cast("map<string,string>")).alias("state"), "errors")


def _liveness(log: DataFrame, keys: list[str], order: str, op: str, ranges: int) -> DataFrame:
    """``log`` with ``_live``: whether its key is live before each event, which its last event before that was no patch decides.

    A key's events are looked at by ranges of ``order``, so that one key with a large share of the log is spread: the last such event of each (key,
    range) goes ahead to the ranges behind it, and the rest is found inside a range.
    """
    turn = F.when(F.col(op) != "patch", F.col(op))
    cut = log.agg(F.percentile_approx(order, [i / ranges for i in range(1, ranges)], 10_000).alias("q")).first().q or [] if ranges > 1 else []
    if not cut:
        before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return log.withColumn("_live", F.coalesce(F.last(turn, ignorenulls=True).over(before).isin("set", "add"), F.lit(False)))
    bounds = F.array(*[F.lit(x) for x in sorted(set(cut))])
    rows = stored(log.withColumn("_range", F.size(F.filter(bounds, lambda x: x < F.col(order)))))
    ends = rows.groupBy(*keys, "_range").agg(F.max_by(turn, F.when(turn.isNotNull(), F.col(order))).alias("_end"))
    ahead = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*keys, "_range", F.last("_end", ignorenulls=True).over(ahead).alias("_carried"))
    inside = Window.partitionBy(*keys, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    last = F.coalesce(F.last(turn, ignorenulls=True).over(inside), "_carried")
    return rows.join(ends, [*keys, "_range"]).withColumn("_live", F.coalesce(last.isin("set", "add"), F.lit(False))).drop("_range", "_carried")


SUFFIXES = {"_add": "add", "_remove": "remove", "_set": "set"}


def fold_entities(log: DataFrame, keys: list[str], order: str, op: str, fields: str, lists: str, ranges: int = 1) -> DataFrame:
    """``(keys, live, state, lists, errors)``: :func:`fold_log` with fields that are lists of distinct values.

    ``lists`` is a ``map<string,array<string>>``.  ``set`` (or a null op) and ``add`` begin a key anew with the lists as given.  In a ``patch`` the
    name says what happens: ``x_add`` puts the values that x lacks behind it, ``x_remove`` takes values out, ``x_set`` and plain ``x`` replace it; the
    entries of one event act in their order, and a list that isn't there begins empty.  Errors (``add`` on a live key, ``patch`` on a missing one) change
    nothing, ``remove`` is idempotent, and a removed key has empty maps.  Null values of a list count as absent.

    Each value is folded by itself, since only its own events since the list was last replaced bear on it: the last removal, and the
    first mention behind that.  No history of a key or list is gathered, only the values that are left.  ``order`` is unique within a key;
    ``ranges`` (up to some hundreds) spreads keys with very many events.
    """
    log = log.select(*keys, F.col(order).alias("_o"), F.coalesce(F.col(op), F.lit("set")).alias("_op"), F.col(fields).alias("_f"), F.col(lists).alias("_l"))
    # each of these is read by several steps
    marked = stored(_liveness(log, keys, "_o", "_op", ranges))
    bad = (F.col("_live") & (F.col("_op") == "add")) | (~F.col("_live") & (F.col("_op") == "patch"))
    begins = F.col("_op").isin("set", "remove") | (~F.col("_live") & (F.col("_op") == "add"))
    heads = stored(marked.groupBy(*keys).agg(F.max(F.when(begins, F.struct("_o", "_op"))).alias("_b"), F.count_if(bad).cast("int").alias("errors")))
    since = stored(marked.where(~bad & (F.col("_op") != "remove")).join(heads.select(*keys, F.col("_b._o").alias("_from")), keys).where("_o >= _from").drop("_from"))

    latest = since.select(*keys, "_o", F.explode("_f").alias("_k", "_v")).groupBy(*keys, "_k").agg(F.max_by("_v", "_o").alias("_v"))
    state = latest.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_k", "_v")))).alias("state"))

    each = since.select(*keys, "_o", "_op", F.posexplode("_l").alias("_i", "_k", "_v"))
    kind, name = F.lit("set"), F.col("_k")
    for suffix, what in SUFFIXES.items():
        has = (F.col("_op") == "patch") & F.endswith("_k", F.lit(suffix))
        kind, name = F.when(has, what).otherwise(kind), F.when(has, F.expr(f"left(_k, length(_k) - {len(suffix)})")).otherwise(name)
    each = each.select(*keys, name.alias("_k"), kind.alias("_what"), F.struct("_o", "_i").alias("_t"), "_v")
    named = each.groupBy(*keys, "_k").agg(F.max(F.when(F.col("_what") == "set", F.col("_t"))).alias("_reset"))
    behind = each.join(named, [*keys, "_k"]).where("_reset is null or _t >= _reset")
    values = stored(behind.select(*keys, "_k", "_what", "_t", F.posexplode("_v").alias("_j", "_e")).where("_e is not null"))
    gone = values.where("_what = 'remove'").groupBy(*keys, "_k", "_e").agg(F.max("_t").alias("_gone"))
    there = values.where("_what <> 'remove'").join(gone, [*keys, "_k", "_e"], "left").where("_gone is null or _t > _gone")
    place = F.struct("_t", "_j")
    # a list given as a whole keeps its repeated values, and what is added comes in once
    first = there.groupBy(*keys, "_k", "_e").agg(F.collect_list(F.when(F.col("_what") == "set", place)).alias("_given"), F.min(place).alias("_first"))
    left = first.select(*keys, "_k", "_e", F.explode(F.when(F.size("_given") > 0, F.col("_given")).otherwise(F.array("_first"))).alias("_p"))
    filled = left.groupBy(*keys, "_k").agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_e"))), lambda x: x["_e"]).alias("_v"))
    whole = named.select(*keys, "_k").join(filled, [*keys, "_k"], "left").select(*keys, "_k", F.coalesce("_v", F.array().cast("array<string>")).alias("_v"))
    found = whole.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_k", "_v")))).alias("lists"))

    live = F.coalesce(F.col("_b._op") != "remove", F.lit(False))
    none = lambda kind: F.create_map().cast(kind)
    out = heads.join(state, keys, "left").join(found, keys, "left")
    return out.select(*keys, live.alias("live"), F.coalesce("state", none("map<string,string>")).alias("state"), F.coalesce("lists", none("map<string,array<string>>")).alias("lists"), "errors")


def distinct_facts(facts: DataFrame, within: list[str], content: list[str], order: str) -> DataFrame:
    """``facts`` without those that repeat the content of an earlier one of the same ``within``, plus ``fingerprint`` (of the content) and ``copies``."""
    print_ = F.sha2(F.to_json(F.struct(*content), {"ignoreNullFields": "false"}), 256)
    others = [c for c in facts.columns if c not in within]
    g = facts.withColumn("fingerprint", print_).groupBy(*within, "fingerprint").agg(F.min_by(F.struct(*others), order).alias("_r"), F.count("*").alias("copies"))
    return g.select(*within, *[F.col(f"_r.{c}").alias(c) for c in others], "fingerprint", "copies")


def merge_files(folded: DataFrame, keys: list[str], file: str) -> DataFrame:
    """``(keys, files, state, lists)`` of the live keys of :func:`fold_entities` by file, merged over the files in order of their names: of a
    scalar the first that is not null, of a list the distinct values in the order in which they are first seen."""
    live = folded.where("live")
    scalars = live.select(*keys, F.col(file).alias("_file"), F.explode("state").alias("_k", "_v")).where("_v is not null")
    scalars = scalars.groupBy(*keys, "_k").agg(F.min_by("_v", "_file").alias("_v")).groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_k", "_v")))).alias("state"))
    values = live.select(*keys, F.col(file).alias("_file"), F.explode("lists").alias("_k", "_l")).select(*keys, "_k", "_file", F.posexplode_outer("_l").alias("_i", "_e"))
    first = values.groupBy(*keys, "_k", "_e").agg(F.min(F.struct("_file", "_i")).alias("_p"))
    lists = first.groupBy(*keys, "_k").agg(F.array_compact(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_e"))), lambda x: x["_e"])).alias("_v"))
    lists = lists.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_k", "_v")))).alias("lists"))
    base = live.groupBy(*keys).agg(F.count("*").cast("int").alias("files"))
    out = base.join(scalars, keys, "left").join(lists, keys, "left")
    return out.select(*keys, "files", F.coalesce("state", F.create_map().cast("map<string,string>")).alias("state"), F.coalesce("lists", F.create_map().cast("map<string,array<string>>")).alias("lists"))


def resolve_refs(facts: DataFrame, entities: DataFrame, ref: str, key: str) -> DataFrame:
    """``facts`` plus ``orphan``: whether their reference names no entity.  Facts without a reference are none."""
    known = entities.select(F.col(key).alias("_ref")).distinct().withColumn("_there", F.lit(True))
    return facts.join(known, F.col(ref) == F.col("_ref"), "left").select(*facts.columns, (F.col(ref).isNotNull() & F.col("_there").isNull()).alias("orphan"))


def last_write_wins(log: DataFrame, keys: list[str], order: list, reverted: Column) -> DataFrame:
    """The last row of each key, without those whose last row reverts it."""
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))
    return log.withColumn("_k", last).where("_k = 1").drop("_k").where(~F.coalesce(reverted, F.lit(False)))


def effective_assertions(rows: DataFrame, ident: str, retracts: str) -> DataFrame:
    """Rows that no retraction names, without the retractions."""
    gone = rows.where(F.col(retracts).isNotNull()).select(F.col(retracts).alias(ident)).distinct()
    return rows.where(F.col(retracts).isNull()).join(gone, ident, "left_anti")


def validate(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """``rows`` with ``errors``: the names of the checks that a row fails; a check that is null fails."""
    return rows.withColumn("errors", F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()])))


def overlay(base: DataFrame, patch: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``base`` with the non-null values of ``patch`` laid over it."""
    p = patch.select(key, *[F.col(c).alias(f"_p_{c}") for c in columns])
    return base.join(p, key, "left").select(*[F.coalesce(f"_p_{c}", c).alias(c) if c in columns else F.col(c) for c in base.columns])


def rewrite_refs(df: DataFrame, redirect: DataFrame, column: str) -> DataFrame:
    """``column`` through the map ``redirect(old, new)``; other values stay."""
    return df.join(redirect.withColumnRenamed("old", column), column, "left").withColumn(column, F.coalesce("new", column)).drop("new").select(*df.columns)


def reparent(df: DataFrame, redirect: DataFrame, column: str) -> DataFrame:
    """Rows of merged-away keys moved to the winner; rows that are then equal count once."""
    return rewrite_refs(df, redirect, column).dropDuplicates()


def one_per_key(new: DataFrame, key: str, version: Column) -> DataFrame:
    """The row of the greatest version of each key; of equal versions the one that comes last by its values.  A null version is the least."""
    rest = [c for c in new.columns if c != key]
    r = F.struct(version.alias("v"), F.to_json(F.struct(*rest)).alias("t"), F.struct(*rest).alias("r"))
    return new.groupBy(key).agg(F.max_by(r["r"], F.struct(r["v"], r["t"])).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def upsert_fill(existing: DataFrame, new: DataFrame, key: str, columns: list[str], version: Column | None = None, pairs: list[tuple[str, str]] = ()) -> DataFrame:
    """Insert new keys and fill only null fields of existing ones, each field by the last new row (by ``version``) that has it.

    The second column of one of the ``pairs`` belongs to the first: both come from the side that gives the first, also where the second is null there.
    """
    order = version if version is not None else F.lit(0)
    belongs = {b: a for a, b in pairs}
    each = [c for c in columns if c not in belongs]
    taken = lambda c: F.struct(c, *[b for b, a in belongs.items() if a == c])
    last = new.groupBy(key).agg(*[F.max_by(taken(c), F.when(F.col(c).isNotNull(), F.struct(order.alias("v"), F.to_json(F.struct(c)).alias("t")))).alias(f"_{c}") for c in each])
    both = existing.join(last, key, "full_outer")
    own = lambda c: F.coalesce(c, f"_{c}.{c}") if c in each else F.when(F.col(belongs[c]).isNotNull(), F.col(c)).otherwise(F.col(f"_{belongs[c]}.{c}"))
    return both.select(key, *[own(c).alias(c) for c in columns])


def upsert_last(existing: DataFrame, new: DataFrame, key: str, version: Column | None = None) -> DataFrame:
    """New rows replace existing rows of the same key; of several new rows the last by ``version``."""
    last = one_per_key(new, key, version if version is not None else F.lit(0))
    return last.select(*existing.columns).unionByName(existing.join(last, key, "left_anti"))


def insert_absent(existing: DataFrame, new: DataFrame, key: str, version: Column | None = None) -> DataFrame:
    """New rows are added only for keys that do not exist; of several new rows the first by ``version`` is, as the others find its key there."""
    order = F.struct((version if version is not None else F.lit(0)).alias("v"), F.to_json(F.struct(*[c for c in new.columns if c != key])).alias("t"))
    first = new.groupBy(key).agg(F.min_by(F.struct(*[c for c in new.columns if c != key]), order).alias("_r"))
    first = first.select(key, *[F.col(f"_r.{c}").alias(c) for c in new.columns if c != key])
    return existing.unionByName(first.join(existing, key, "left_anti").select(*existing.columns))
