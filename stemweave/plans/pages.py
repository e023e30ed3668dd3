"""Queries for sources, sinks and streams over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.graph import stored
from ..sources import files as S
from ..sources import sinks as K
from ..streaming import logs as L
from .registry import query


@query("c01_jsonl_round_trip", "SELECT event_id, user_id, event_type FROM events")
def _(t):
    """Events written as JSON lines and read back with a declared schema."""
    lines = stored(t("events").select(F.to_json(F.struct("event_id", "user_id", "event_type")).alias("value")))
    return lines.select(F.from_json("value", "event_id bigint, user_id bigint, event_type string").alias("r")).select("r.*")


@query("c12_gazetteer_flatten", "SELECT DISTINCT r_name AS country, n_name AS region, c_mktsegment AS name FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey")
def _(t):
    j = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    regions = j.groupBy("r_name", "n_name").agg(F.collect_set("c_mktsegment").alias("names"))
    doc = regions.groupBy("r_name").agg(F.map_from_entries(F.collect_list(F.struct("n_name", "names"))).alias("m")).select(F.to_json(F.create_map("r_name", "m")).alias("doc"))
    return S.flatten_gazetteer(doc, "doc")


@query("c16_html_text", r"""
SELECT page_id, sha256(trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g'))) AS digest FROM pages""")
def _(t):
    return t("pages").select("page_id", F.sha2(S.html_text(F.col("html")), 256).alias("digest"))


@query("c16_links", r"""SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS link FROM pages""")
def _(t):
    return t("pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("link"))


@query("c13_entry_split", r"""
SELECT doc_id, len(regexp_extract_all(text, '(?m)^[A-Z][A-Z-]+\b[,.]')) + CASE WHEN trim(regexp_replace(text, '(?ms)^[A-Z][A-Z-]+\b[,.].*', '')) <> '' THEN 1 ELSE 0 END AS entries FROM documents""")
def _(t):
    return t("documents").select("doc_id", F.size(S.split_entries(F.col("text"))).alias("entries"))


@query("k02_grouped_refs", "SELECT o_orderkey, coalesce(string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_partkey), '') AS refs FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def _(t):
    j = t("orders").join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return j.groupBy("o_orderkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list("l_partkey")), lambda x: x.cast("string")), ",").alias("refs"))


@query("k03_documents", """
SELECT o_custkey, to_json({'orders': list_sort(list(DISTINCT {'o_orderkey': o_orderkey, 'o_orderpriority': o_orderpriority})), 'parts': list_sort(list(DISTINCT {'l_partkey': l_partkey, 'l_returnflag': l_returnflag}))})::VARCHAR AS document
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def _(t):
    j = t("orders").join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return K.documents(j, "o_custkey", {"orders": ("o_orderkey", ["o_orderpriority"]), "parts": ("l_partkey", ["l_returnflag"])})


@query("k05_subset_trimming", """
WITH w AS (SELECT p_brand, p_type, sum(p_size) AS w FROM part GROUP BY 1, 2), k AS (SELECT p_brand, p_type FROM w QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY w DESC, p_type) <= 2) SELECT p_partkey, p_brand, p_type FROM part SEMI JOIN k USING (p_brand, p_type)""")
def _(t):
    return K.trim_subset(t("part").select("p_partkey", "p_brand", "p_type", "p_size"), "p_brand", "p_size", "p_type", 2).select("p_partkey", "p_brand", "p_type")


@query("k01_repointed_rows", "SELECT CASE WHEN l_partkey % 5 = 1 THEN l_partkey - 1 ELSE l_partkey END AS l_partkey, count(*) AS n FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size <= 45) GROUP BY 1")
def _(t):
    merged = t("part").where("p_size <= 45").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 5 == 1, F.col("p_partkey") - 1).alias("winner"))
    return K.repointed(t("lineitem").select("l_partkey"), "l_partkey", merged)[0].groupBy("l_partkey").agg(F.count("*").alias("n"))


@query("x_tumbling_windows", "SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR AS \"end\", event_type, count(*) AS n FROM events GROUP BY ALL")
def _(t):
    return L.windowed_counts(t("events"), "ts", ["event_type"], "6 hours")


@query("x_session_windows", """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS b FROM events), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT min(ts) AS start, max(ts) + INTERVAL 12 HOUR AS "end", user_id, count(*) AS n FROM s GROUP BY user_id, k""")
def _(t):
    return L.session_counts(t("events"), "ts", ["user_id"], "12 hours")
