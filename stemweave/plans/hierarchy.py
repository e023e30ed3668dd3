"""Queries for graph operators on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from .registry import query

_NODES = """n AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 10 = 3 THEN c_custkey // 10 + 1 END AS merged, CASE WHEN c_custkey % 4 = 1 AND c_custkey > 1 THEN c_custkey // 4 + 1 END AS lemma, c_mktsegment AS lang FROM customer)"""


def _nodes(t):
    return t("customer").selectExpr(
        "c_custkey as id", "case when c_custkey % 10 = 3 then cast(c_custkey div 10 + 1 as bigint) end as merged", "case when c_custkey % 4 = 1 and c_custkey > 1 then cast(c_custkey div 4 + 1 as bigint) end as lemma", "c_mktsegment as lang"
    )


@query("g01_two_step_root", f"WITH {_NODES}, x AS (SELECT id, coalesce(merged, lemma, id) AS t FROM n) SELECT x.id, coalesce(n.lemma, x.t) AS root FROM x LEFT JOIN n ON n.id = x.t")
def _(t):
    return G.two_step_root(_nodes(t), "id", "merged", "lemma")


@query("g02_flat_rollup", f"WITH {_NODES} SELECT coalesce(merged, lemma, id) AS hub, count(*) AS members, min(lang) AS lang FROM n GROUP BY 1")
def _(t):
    return _nodes(t).groupBy(F.coalesce("merged", "lemma", "id").alias("hub")).agg(F.count("*").alias("members"), F.min("lang").alias("lang"))


@query("g03_smallest_reaching_root", """
WITH RECURSIVE e AS (SELECT n_regionkey::BIGINT AS p, 100 + n_nationkey AS c FROM nation UNION SELECT 100 + s_nationkey, 1000 + s_suppkey FROM supplier UNION SELECT 1000 + l_suppkey, 1000000000 + l_partkey FROM lineitem),
r AS (SELECT p AS node, p AS root FROM e WHERE p NOT IN (SELECT c FROM e) UNION SELECT e.c, r.root FROM r JOIN e ON e.p = r.node), n AS (SELECT p AS node FROM e UNION SELECT c FROM e)
SELECT n.node, min(root) AS root FROM n LEFT JOIN r ON r.node = n.node GROUP BY 1""")
def _(t):
    e = t("nation").selectExpr("cast(n_regionkey as bigint) as p", "cast(100 + n_nationkey as bigint) as c")
    e = e.union(t("supplier").selectExpr("cast(100 + s_nationkey as bigint)", "1000 + s_suppkey")).union(t("lineitem").selectExpr("1000 + l_suppkey", "1000000000 + l_partkey"))
    return G.smallest_reaching_root(e, "p", "c")


@query("g04_ancestors", """
WITH RECURSIVE r AS (SELECT c_custkey AS seed, c_custkey AS node, 0 AS depth FROM customer UNION SELECT seed, node // 2, depth + 1 FROM r WHERE node // 2 >= 1)
SELECT seed, node, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY 1, 2""")
def _(t):
    c = t("customer")
    e = c.selectExpr("c_custkey as child", "cast(nullif(c_custkey div 2, 0) as bigint) as parent")
    return G.ancestors(c.selectExpr("c_custkey as seed"), e, "seed", "parent", "child")


@query("g05_classify_by_parents", """
WITH e AS (SELECT DISTINCT l_suppkey AS parent, l_partkey AS child, l_returnflag AS kind FROM lineitem), n AS (SELECT s_suppkey AS id, 'lang' || s_nationkey AS lang FROM supplier),
a AS (SELECT child, list(DISTINCT lang) AS alls, list(DISTINCT lang) FILTER (kind = 'R') AS loans FROM e JOIN n ON n.id = parent GROUP BY 1)
SELECT p_partkey AS id, CASE WHEN list_has_any(coalesce(loans, []), ['lang1', 'lang2', 'lang3']) THEN 'loan' WHEN list_has_any(alls, ['lang4', 'lang5']) THEN 'old' WHEN list_has_any(alls, ['lang6', 'lang7', 'lang1']) THEN 'native' END AS stratum FROM part LEFT JOIN a ON child = p_partkey""")
def _(t):
    e = t("lineitem").selectExpr("-l_suppkey - 1 as parent", "l_partkey as child", "l_returnflag as kind").distinct()
    n = t("supplier").selectExpr("-s_suppkey - 1 as id", "concat('lang', s_nationkey) as lang").union(t("part").selectExpr("p_partkey", "cast(null as string)"))
    return G.classify_by_parents(n, e, "id", "lang", "parent", "child", "kind", [("loan", ["lang1", "lang2", "lang3"], True), ("old", ["lang4", "lang5"], False), ("native", ["lang6", "lang7", "lang1"], False)], ["R"]).where("id >= 0")


@query("g06_components", """
WITH RECURSIVE e AS (SELECT DISTINCT l_orderkey AS x, 1000000000 + l_partkey AS y FROM lineitem), b AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r(node, component) USING KEY (node) AS (SELECT x, min(least(x, y)) FROM b GROUP BY 1 UNION
  SELECT b.y, min(r.component) FROM r JOIN b ON b.x = r.node JOIN recurring.r AS c ON c.node = b.y WHERE r.component < c.component GROUP BY 1)
SELECT node, component FROM r""")
def _(t):
    e = t("lineitem").selectExpr("l_orderkey as a", "1000000000 + l_partkey as b")
    return G.min_label_components(e, "a", "b")


@query("g08_chain_flattening", """
WITH RECURSIVE r AS (SELECT c_custkey AS id, c_custkey AS x FROM customer UNION ALL SELECT id, x // 3 FROM r WHERE x >= 3) SELECT id, min(x) AS terminal, false AS cyclic FROM r GROUP BY 1""")
def _(t):
    return G.flatten_chains(t("customer").selectExpr("c_custkey as id", "cast(case when c_custkey >= 3 then c_custkey div 3 end as bigint) as to_id"), "id", "to_id")


@query("g09_cluster_labels", "SELECT l_orderkey AS cluster, string_agg(DISTINCT p_name, '|' ORDER BY p_name) AS labels FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1")
def _(t):
    return t("lineitem").join(t("part"), F.col("p_partkey") == F.col("l_partkey")).groupBy(F.col("l_orderkey").alias("cluster")).agg(F.array_join(F.array_sort(F.collect_set("p_name")), "|").alias("labels"))


@query("g11_majority_outliers", """
WITH v AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2), d AS (SELECT o_custkey, o_orderpriority AS dominant FROM v QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderpriority) = 1)
SELECT o_custkey, o_orderkey, o_orderpriority, dominant FROM orders JOIN d USING (o_custkey) WHERE o_orderpriority <> dominant""")
def _(t):
    return G.majority_outliers(t("orders"), "o_custkey", "o_orderkey", "o_orderpriority")


@query("g11_fan_out", "SELECT l_suppkey, count(DISTINCT l_partkey) AS children FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_partkey) >= 20")
def _(t):
    return G.fan_out(t("lineitem"), "l_suppkey", "l_partkey", 20)


@query("g12_gloss_collapse", "SELECT b.p_partkey AS child, min(a.p_partkey) AS parent FROM part a JOIN part b ON lower(trim(a.p_name)) = lower(trim(b.p_name)) AND a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey GROUP BY 1")
def _(t):
    p = t("part").select("p_partkey", "p_brand", F.lower(F.trim("p_name")).alias("g"))
    low = p.groupBy("p_brand", "g").agg(F.min("p_partkey").alias("parent"))
    return p.join(low, ["p_brand", "g"]).where("p_partkey > parent").select(F.col("p_partkey").alias("child"), "parent")


@query("g13_edge_projection", """
SELECT l_partkey AS a, l_suppkey AS b, CASE WHEN bool_or(l_returnflag = 'R' AND l_quantity / 50 >= 0.6) THEN 'refuted' WHEN bool_or(l_returnflag <> 'R' AND l_quantity / 50 >= 0.6) THEN 'kept' ELSE 'gated' END AS status FROM lineitem GROUP BY 1, 2""")
def _(t):
    a = t("lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), F.when(F.col("l_returnflag") == "R", "refute").otherwise("affirm").alias("polarity"), "l_quantity")
    return G.project_edges(a, ["a", "b"], "polarity", F.col("l_quantity") / 50, 0.6)


@query("g14_identity_conflicts", f"""
WITH {_NODES}, x AS (SELECT lang || '-' || (id % 50) AS hub, coalesce(merged, id) AS root FROM n) SELECT hub, CASE WHEN count(DISTINCT root) = 1 THEN min(root) END AS bound, count(DISTINCT root) AS roots FROM x GROUP BY 1""")
def _(t):
    n = _nodes(t).select(F.concat_ws("-", "lang", F.col("id") % 50).alias("hub"), F.coalesce("merged", "id").alias("root"))
    return n.groupBy("hub").agg(F.count_distinct("root").alias("roots"), F.min("root").alias("m")).select("hub", F.when(F.col("roots") == 1, F.col("m")).alias("bound"), "roots")


@query("g15_partition_fidelity", "SELECT c_nationkey, count(DISTINCT c_mktsegment) AS groups FROM customer GROUP BY 1 HAVING count(DISTINCT c_mktsegment) > 1")
def _(t):
    return G.partition_fidelity(t("customer"), "c_nationkey", "c_mktsegment")


@query("g16_compound_alignment", """
WITH l AS (SELECT l_orderkey AS place, l_returnflag AS src, string_agg(l_linestatus || (l_partkey % 3), '+' ORDER BY l_linenumber, l_linestatus || (l_partkey % 3)) AS e, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT a.e AS composite, b.e AS parts, count(DISTINCT a.place) AS support FROM l a JOIN l b ON a.place = b.place WHERE a.n = 1 AND b.n > 1 GROUP BY 1, 2 HAVING count(DISTINCT a.place) >= 3""")
def _(t):
    b = t("lineitem").select(F.col("l_orderkey").alias("place"), F.col("l_returnflag").alias("src"), "l_linenumber", F.concat("l_linestatus", F.col("l_partkey") % 3).alias("part"))
    return G.compound_alignments(b, "place", "src", "l_linenumber", "part", 3)
