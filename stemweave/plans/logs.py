"""Queries of event logs with lists: folds, ledgers over several files, versioned upserts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import log as L
from ..sources import files as S
from ..sources import sinks as K
from .registry import query

# what an event does to its user's entry
_EVENTS = """e AS (SELECT user_id, event_id, strftime(ts, '%d') AS file, CASE event_type WHEN 'signup' THEN NULL WHEN 'purchase' THEN 'patch' WHEN 'view' THEN 'patch' WHEN 'error' THEN 'remove' ELSE 'add' END AS op, event_id AS last,
  CASE event_type WHEN 'signup' THEN ['t' || event_id % 7, 't' || event_id % 3] WHEN 'click' THEN ['t' || event_id % 5] END AS begun,
  CASE WHEN event_type = 'purchase' THEN ['t' || event_id % 11, 't' || event_id % 4] ELSE [] END AS added, CASE WHEN event_type IN ('purchase', 'view') THEN ['t' || event_id % 6] ELSE [] END AS gone,
  CASE WHEN event_type = 'view' AND event_id % 10 = 0 THEN ['t8', 't9'] END AS replaced FROM events)"""
# one step of the fold, in the order in which the entries of a patch act: replaced, added, gone
_STEP = """CASE WHEN op = 'remove' THEN false WHEN op = 'patch' THEN live ELSE true END AS live, errors + CASE WHEN (op = 'add' AND live) OR (op = 'patch' AND NOT live) THEN 1 ELSE 0 END AS errors,
    CASE WHEN op = 'remove' THEN NULL WHEN (op = 'add' AND live) OR (op = 'patch' AND NOT live) THEN r.last ELSE o.last END AS last,
    CASE WHEN op = 'remove' THEN [] WHEN (op = 'add' AND live) OR (op = 'patch' AND NOT live) THEN tags WHEN op = 'patch' THEN list_filter(list_concat(coalesce(replaced, tags), list_filter(CASE WHEN len(added) = 2 AND added[1] = added[2] THEN [added[1]] ELSE added END, lambda x: NOT list_contains(coalesce(replaced, tags), x))), lambda x: NOT list_contains(gone, x)) ELSE begun END AS tags"""


def _fold(key: str) -> str:
    return f"""WITH RECURSIVE {_EVENTS}, o AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY event_id) AS i FROM e),
r AS (SELECT {key}, 0::BIGINT AS i, false AS live, 0 AS errors, NULL::BIGINT AS last, []::VARCHAR[] AS tags FROM (SELECT DISTINCT {key} FROM e) UNION ALL
  SELECT {", ".join("r." + k.strip() for k in key.split(","))}, r.i + 1, {_STEP} FROM r JOIN o ON {" AND ".join(f"o.{k.strip()} = r.{k.strip()}" for k in key.split(","))} AND o.i = r.i + 1),
z AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY i DESC) = 1)"""


def _log(t):
    e, tag = F.col("event_type"), lambda n: F.concat(F.lit("t"), (F.col("event_id") % n).cast("string"))
    op = F.when(e.isin("purchase", "view"), "patch").when(e == "error", "remove").when(e != "signup", "add")
    entry = lambda name, *values: F.struct(F.lit(name).alias("key"), F.array(*values).alias("value"))
    lists = (
        F.when(e == "signup", F.array(entry("tags", tag(7), tag(3)))).when(e == "click", F.array(entry("tags", tag(5))))
        .when(e == "purchase", F.array(entry("tags_add", tag(11), tag(4)), entry("tags_remove", tag(6))))
        .when((e == "view") & (F.col("event_id") % 10 == 0), F.array(entry("tags_set", F.lit("t8"), F.lit("t9")), entry("tags_remove", tag(6)))).when(e == "view", F.array(entry("tags_remove", tag(6)))).otherwise(F.array().cast("array<struct<key:string,value:array<string>>>"))
    )
    return t("events").select("user_id", "event_id", F.date_format("ts", "dd").alias("file"), op.alias("op"), F.create_map(F.lit("last"), F.col("event_id").cast("string")).alias("fields"), F.map_from_entries(lists).alias("lists"))


_SHOWN = "concat_ws(',', tags)"


@query("l01_list_fold", _fold("user_id") + " SELECT user_id, live, errors, CAST(last AS VARCHAR) AS last, array_to_string(tags, ',') AS tags FROM z")
def _(t):
    """Scalars and lists of each user: patches that add, remove and replace, removals and entries begun again."""
    out = L.fold_entities(_log(t), ["user_id"], "event_id", "op", "fields", "lists", ranges=4)
    return out.select("user_id", "live", "errors", F.try_element_at("state", F.lit("last")).alias("last"), F.coalesce(F.array_join(F.try_element_at("lists", F.lit("tags")), ","), F.lit("")).alias("tags"))


@query("l04_file_build", _fold("user_id, file") + """, m AS (SELECT *, 'u' || user_id AS ref FROM z WHERE live), n AS (SELECT ref, file, unnest(tags) AS tag, unnest(range(len(tags))) AS j FROM m), p AS (SELECT ref, tag, min((file, j)) AS p FROM n GROUP BY 1, 2), g AS (SELECT ref, string_agg(tag, ',' ORDER BY p) AS tags FROM p GROUP BY 1),
c AS (SELECT DISTINCT strftime(ts, '%d') AS file, 'u' || (user_id + CASE WHEN event_id % 3 = 0 THEN 7 ELSE 0 END) AS ref, CAST(floor(value / 20) AS BIGINT) AS page FROM events WHERE event_type = 'click'), f AS (SELECT ref, count(*) AS facts FROM c GROUP BY 1),
a AS (SELECT ref, count(*) AS files, arg_min(last, file) AS last FROM m GROUP BY 1)
SELECT ref, a.ref IS NULL AS orphan, a.files, CAST(last AS VARCHAR) AS last, tags, coalesce(facts, 0) AS facts FROM a LEFT JOIN g USING (ref) FULL JOIN f USING (ref)""")
def _(t):
    """The log as ledgers, one a day, read back, folded file by file and merged; facts that repeat within a file count once, and some name no entry."""
    log = _log(t).withColumn("ref", F.concat(F.lit("u"), F.col("user_id").cast("string")))
    body = F.to_json(F.struct(F.lit("entry").alias("_type"), F.col("op").alias("_op"), "ref", F.col("fields.last").alias("last"), *[F.col(f"lists.{k}").alias(k) for k in ("tags", "tags_set", "tags_add", "tags_remove")]))
    page = F.to_json(F.struct(F.lit("citation").alias("_type"), F.concat(F.lit("u"), (F.col("user_id") + F.when(F.col("event_id") % 3 == 0, 7).otherwise(0)).cast("string")).alias("entry"), F.floor(F.col("value") / 20).alias("page")))
    cited = t("events").where("event_type = 'click'").select(F.date_format("ts", "dd").alias("file"), "event_id", F.lit(1).alias("k"), page.alias("line"))
    lines = log.select("file", "event_id", F.lit(0).alias("k"), body.alias("line")).unionByName(cited)
    path = G.scratch(lines.sparkSession, "ledgers")
    K.ledgers(lines, path, "file", "line", ["event_id", "k"])
    events = G.stored(S.read_events(lines.sparkSession, path))
    folded = L.fold_entities(events.where("type = 'entry'"), ["file", "ref"], "line_no", "op", "fields", "lists")
    merged = G.stored(L.merge_files(folded, ["ref"], "file"))
    facts = events.where("type = 'citation'").select("file", "line_no", F.col("fields.entry").alias("ref"), F.col("fields.page").alias("page"))
    facts = L.resolve_refs(L.distinct_facts(facts, ["file"], ["ref", "page"], "line_no"), merged, "ref", "ref")
    counts = facts.groupBy("ref").agg(F.count("*").alias("facts"), F.max("orphan").alias("orphan"))
    out = merged.select("ref", F.col("files").cast("long").alias("files"), F.col("state.last").alias("last"), F.nullif(F.array_join("lists.tags", ","), F.lit("")).alias("tags"))
    return out.join(counts, "ref", "full_outer").select("ref", F.coalesce("orphan", F.lit(False)).alias("orphan"), "files", "last", "tags", F.coalesce("facts", F.lit(0)).alias("facts"))


_NEW = "n AS (SELECT user_id AS k, event_type AS v, CASE WHEN event_type = 'view' THEN NULL ELSE value END AS w, event_id AS i FROM events), h AS (SELECT c_custkey AS k, c_mktsegment AS v, CASE WHEN c_acctbal >= 2000 THEN c_acctbal END AS w FROM customer WHERE c_acctbal >= 0)"


def _sides(t):
    have = t("customer").where("c_acctbal >= 0").selectExpr("c_custkey as k", "c_mktsegment as v", "case when c_acctbal >= 2000 then c_acctbal end as w")
    return have, t("events").selectExpr("user_id as k", "event_type as v", "case when event_type = 'view' then null else value end as w", "event_id as i")


@query("k10_upsert_fill_versions", f"WITH {_NEW}, b AS (SELECT k, arg_max(v, i) FILTER (v IS NOT NULL) AS v, arg_max(w, i) FILTER (w IS NOT NULL) AS w FROM n GROUP BY k) SELECT k, coalesce(h.v, b.v) AS v, coalesce(h.w, b.w) AS w FROM h FULL JOIN b USING (k)")
def _(t):
    """Many new rows a key: each empty field takes the last value that is not null."""
    have, new = _sides(t)
    return L.upsert_fill(have, new, "k", ["v", "w"], F.col("i"))


@query("k12_upsert_last_versions", f"WITH {_NEW}, b AS (SELECT k, v, w FROM n QUALIFY row_number() OVER (PARTITION BY k ORDER BY i DESC) = 1) FROM b UNION ALL SELECT k, v, w FROM h ANTI JOIN b USING (k)")
def _(t):
    """Many new rows a key: the last one replaces the row that is there."""
    have, new = _sides(t)
    return L.upsert_last(have, new, "k", F.col("i"))


@query("k11_insert_absent_versions", f"WITH {_NEW}, b AS (SELECT k, v, w FROM n QUALIFY row_number() OVER (PARTITION BY k ORDER BY i) = 1) SELECT k, v, w FROM h UNION ALL SELECT k, v, w FROM b ANTI JOIN h USING (k)")
def _(t):
    """Many new rows a key: the first one comes in where the key is new."""
    have, new = _sides(t)
    return L.insert_absent(have, new, "k", F.col("i"))
