"""Queries for joins, aggregates, ranking, sets and statistics on the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import ranking as D
from ..operators import sets as S
from ..operators import stats as X
from ..operators import text as T
from .registry import query

ERAS = [("early", None, 1996), ("middle", 1996, 1999), ("late", 1999, None)]


def _r(c, n: int = 6):
    return F.round(c, n)


@query("a03_consensus_rollup", """
SELECT coalesce(n.n_regionkey, -1) AS root, count(DISTINCT o.o_orderpriority) AS witnesses
FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY 1""")
def _(t):
    e = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    w = t("orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority").distinct()
    return A.witness_rollup(e, w, F.coalesce("n_regionkey", F.lit(-1)), "c_custkey", "o_orderpriority")


@query("j01_star_join", """
SELECT r_name, n_name, c_mktsegment, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def _(t):
    j = J.star_join(t("orders"), (t("customer"), "o_custkey", "c_custkey"), (t("nation"), "c_nationkey", "n_nationkey"), (t("region"), "n_regionkey", "r_regionkey"))
    return j.groupBy("r_name", "n_name", "c_mktsegment").agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))


@query("j02_left_join_gaps", """
SELECT o_orderkey, count(l_orderkey) AS n_lines, count(l_orderkey) = 0 AS gap FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def _(t):
    lines = t("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return t("orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.coalesce("n", F.lit(0)).alias("n_lines"), F.col("n").isNull().alias("gap"))


@query("j03_left_join_condition", """
SELECT o_orderkey, l_linenumber, l_partkey FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'R'""")
def _(t):
    return J.left_with_condition(t("orders"), t("lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey", F.col("l_returnflag") == "R").select("o_orderkey", "l_linenumber", "l_partkey")


@query("j04_pointer_self_join", """
SELECT c.c_custkey, p.c_name AS parent_name, g.c_name AS grandparent_name FROM customer c
LEFT JOIN customer p ON p.c_custkey = c.c_custkey // 2 LEFT JOIN customer g ON g.c_custkey = p.c_custkey // 2""")
def _(t):
    c = t("customer").select("c_custkey", "c_name")
    up = lambda df, k, name: df.join(c.select(F.col("c_custkey").alias(f"{name}_id"), F.col("c_name").alias(f"{name}_name")), F.expr(f"cast({k} div 2 as bigint)") == F.col(f"{name}_id"), "left")
    return up(up(c, "c_custkey", "parent"), "parent_id", "grandparent").select("c_custkey", "parent_name", "grandparent_name")


@query("j05_computed_key_join", """
SELECT c_mktsegment, count(*) AS n FROM orders JOIN customer ON coalesce(nullif(o_custkey % 7, 0), o_custkey) = c_custkey GROUP BY 1""")
def _(t):
    o = t("orders").select(F.coalesce(F.nullif(F.col("o_custkey") % 7, F.lit(0)), "o_custkey").alias("root"))
    return o.join(t("customer"), F.col("root") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("j06_semi_join", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def _(t):
    return t("customer").join(t("orders").where("o_totalprice > 400000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("j07_anti_join", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def _(t):
    return t("orders").join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@query("j08_era_lookup", """
SELECT o_orderkey, CASE WHEN year(o_orderdate) < 1996 THEN 'early' WHEN year(o_orderdate) < 1999 THEN 'middle' ELSE 'late' END AS era FROM orders""")
def _(t):
    return J.range_lookup(t("orders").withColumn("y", F.year("o_orderdate")), "y", ERAS, "era").select("o_orderkey", "era")


@query("j08_range_join", """
WITH b AS (SELECT DISTINCT p_size AS lo, p_size + 5 AS hi FROM part)
SELECT lo, count(*) AS n FROM lineitem JOIN b ON l_quantity >= lo AND l_quantity < hi GROUP BY 1""")
def _(t):
    b = t("part").selectExpr("p_size as lo", "p_size + 5 as hi").distinct()
    return J.range_join(t("lineitem").select("l_quantity"), "l_quantity", b, "lo", "hi", 5).groupBy("lo").agg(F.count("*").alias("n"))


@query("j09_asof_join", """
WITH p AS (SELECT * FROM events WHERE event_type = 'purchase'), s AS (SELECT user_id, ts, event_id AS signup_id, ts AS signup_ts FROM events WHERE event_type = 'signup')
SELECT p.event_id, p.user_id, s.signup_id, s.signup_ts FROM p ASOF LEFT JOIN s ON p.user_id = s.user_id AND p.ts >= s.ts""")
def _(t):
    e = t("events").select("event_id", "user_id", "ts", "event_type")
    s = e.where("event_type = 'signup'").withColumnsRenamed({"event_id": "signup_id"}).withColumn("signup_ts", F.col("ts"))
    return J.asof_join(e.where("event_type = 'purchase'"), s, "user_id", "ts", "ts", {"signup_id": "signup_id", "signup_ts": "signup_ts"}).select("event_id", "user_id", "signup_id", "signup_ts")


@query("j10_snapshot_diff", """
WITH a AS (SELECT user_id, event_type, count(*) AS v FROM events WHERE hour(ts) < 12 GROUP BY ALL), b AS (SELECT user_id, event_type, count(*) AS v FROM events WHERE hour(ts) >= 12 GROUP BY ALL)
SELECT user_id, event_type, a.v AS value_a, b.v AS value_b, b.v - a.v AS delta FROM a FULL JOIN b USING (user_id, event_type) WHERE a.v IS DISTINCT FROM b.v""")
def _(t):
    """What users did before noon against what they did after it."""
    half = lambda late: t("events").where((F.hour("ts") >= 12) == late).groupBy("user_id", "event_type").agg(F.count("*").alias("v"))
    return J.snapshot_diff(half(False), half(True), ["user_id", "event_type"], "v")


@query("j11_capped_product", """
WITH w AS (SELECT p_brand, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part),
x AS (SELECT DISTINCT p_brand, a, dense_rank() OVER (PARTITION BY p_brand ORDER BY a) AS k FROM w), y AS (SELECT DISTINCT p_brand, b, dense_rank() OVER (PARTITION BY p_brand ORDER BY b) AS k FROM w)
SELECT p_brand, a || ' ' || b AS combo FROM x JOIN y USING (p_brand) WHERE x.k <= 3 AND y.k <= 3""")
def _(t):
    w = F.split("p_name", " ")
    parts = t("part").select("p_brand", F.posexplode(F.array(w[0], w[1])).alias("slot", "word")).distinct()
    return J.capped_product(parts, "p_brand", "slot", "word", ["word"], 3).select("p_brand", F.array_join("combo", " ").alias("combo"))


@query("j12_tiered_lookup", """
WITH x AS (SELECT o_custkey AS k, o_orderkey AS v, 1 AS tier FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT o_custkey, o_orderkey, 2 FROM orders WHERE o_orderpriority = '2-HIGH' UNION ALL SELECT o_custkey, o_orderkey, 3 FROM orders)
SELECT k, v, tier FROM x QUALIFY row_number() OVER (PARTITION BY k ORDER BY tier, v) = 1""")
def _(t):
    o = t("orders").selectExpr("o_custkey as k", "o_orderkey as v", "o_orderpriority as p")
    return J.tiered_lookup([o.where("p = '1-URGENT'").drop("p"), o.where("p = '2-HIGH'").drop("p"), o.drop("p")], "k", ["v"]).select("k", "v", F.col("tier"))


@query("j13_token_overlap_pairs", """
WITH s AS (SELECT min(p_partkey) AS id, list_distinct(string_split(p_name, ' ')) AS s FROM part GROUP BY p_name), p AS (SELECT id, unnest(s) AS t FROM s),
c AS (SELECT DISTINCT x.id AS a, y.id AS b FROM p x JOIN p y ON x.t = y.t AND x.id < y.id)
SELECT a, b, round(len(list_intersect(x.s, y.s)) / least(len(x.s), len(y.s)), 6) AS overlap FROM c JOIN s x ON x.id = a JOIN s y ON y.id = b WHERE len(list_intersect(x.s, y.s)) / least(len(x.s), len(y.s)) >= 0.5""")
def _(t):
    names = t("part").groupBy("p_name").agg(F.min("p_partkey").alias("id")).select("id", F.split("p_name", " ").alias("w"))
    return J.token_overlap_join(names, "id", "w", 0.5).select("a", "b", _r("overlap").alias("overlap"))


@query("j15_unique_fold_join", """
WITH r AS (SELECT lower(replace(s_name, '#', '')) AS f, s_suppkey FROM supplier UNION ALL SELECT lower(replace(s_name, '#', '')), -s_suppkey FROM supplier WHERE s_acctbal < 0), u AS (SELECT f, min(s_suppkey) AS s_suppkey FROM r GROUP BY f HAVING count(*) = 1),
l AS (SELECT replace(lower(s_name), '#', '') AS f, l_orderkey, l_linenumber, l_partkey FROM lineitem JOIN supplier ON s_suppkey = l_suppkey)
SELECT l_orderkey, l_linenumber, l_partkey, s_suppkey FROM l JOIN u USING (f)""")
def _(t):
    """Lines meet suppliers by their folded names; a name that two rows have meets none."""
    fold = F.lower(F.replace("s_name", F.lit("#"), F.lit("")))
    s = t("supplier")
    right = s.select(fold.alias("f"), "s_suppkey").union(s.where("s_acctbal < 0").select(fold, -F.col("s_suppkey")))
    left = t("lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey")).select(fold.alias("f"), "l_orderkey", "l_linenumber", "l_partkey")
    return J.unique_key_join(left, right, "f").select("l_orderkey", "l_linenumber", "l_partkey", "s_suppkey")


@query("j16_containment_join", "SELECT doc_id, item_id FROM documents JOIN benchmark ON contains(documents.text, benchmark.text)")
def _(t):
    return T.containing(t("documents"), "doc_id", "text", t("benchmark"), "item_id", "text").select("doc_id", "item_id")


@query("j17_shared_group_pairs", """
SELECT a.s_suppkey AS a, b.s_suppkey AS b, count(DISTINCT a.p) AS shared FROM (SELECT DISTINCT l_suppkey AS s_suppkey, l_partkey AS p FROM lineitem) a
JOIN (SELECT DISTINCT l_suppkey AS s_suppkey, l_partkey AS p FROM lineitem) b ON a.p = b.p AND a.s_suppkey < b.s_suppkey GROUP BY 1, 2""")
def _(t):
    return J.shared_group_pairs(t("lineitem"), "l_suppkey", "l_partkey")


@query("j18_mention_resolution", """
WITH e AS (SELECT p_name AS form, p_brand AS region, p_partkey AS id FROM part), m AS (SELECT l_orderkey, l_linenumber, l_suppkey, p_name AS form, CASE WHEN l_suppkey % 2 = 0 THEN 'near ' || p_brand ELSE 'far' END AS hint FROM lineitem JOIN part ON p_partkey = l_partkey),
c AS (SELECT form, count(*) AS n, min(id) AS only FROM e GROUP BY 1), h AS (SELECT DISTINCT form, hint FROM m),
f AS (SELECT h.form, h.hint, count(*) AS n, min(id) AS only FROM h JOIN e ON e.form = h.form AND contains(' ' || regexp_replace(lower(hint), '[^a-z0-9]+', ' ', 'g') || ' ', ' ' || regexp_replace(lower(region), '[^a-z0-9]+', ' ', 'g') || ' ') GROUP BY 1, 2)
SELECT l_orderkey, l_linenumber, l_suppkey, m.form, m.hint, CASE WHEN c.n = 1 THEN c.only WHEN f.n = 1 THEN f.only END AS resolved FROM m JOIN c USING (form) LEFT JOIN f ON f.form = m.form AND f.hint = m.hint""")
def _(t):
    e = t("part").selectExpr("p_name as form", "p_brand as region", "p_partkey as id")
    m = t("lineitem").join(t("part"), F.col("p_partkey") == F.col("l_partkey")).select("l_orderkey", "l_linenumber", "l_suppkey", F.col("p_name").alias("form"), F.when(F.col("l_suppkey") % 2 == 0, F.concat(F.lit("near "), "p_brand")).otherwise("far").alias("hint"))
    return J.resolve_mentions(m, e, "form", "hint", "region", "id").select("l_orderkey", "l_linenumber", "l_suppkey", "form", "hint", "resolved")


@query("j20_scalar_subquery", "SELECT s_suppkey, (SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey AND l_returnflag = 'A') AS returned FROM supplier")
def _(t):
    n = t("lineitem").where("l_returnflag = 'A'").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    return t("supplier").join(n, F.col("s_suppkey") == F.col("l_suppkey"), "left").select("s_suppkey", F.coalesce("n", F.lit(0)).alias("returned"))


@query("a01_table_counts", """
SELECT 'region' AS name, count(*) AS n FROM region UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'absent', -1""")
def _(t):
    return A.table_counts({n: t(n) for n in ("region", "orders", "lineitem", "events")} | {"absent": None})


@query("a02_frequency_with_null", "SELECT CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS priority, count(*) AS n FROM orders GROUP BY 1")
def _(t):
    return t("orders").groupBy(F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("priority")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "priority")


@query("a04_having", "SELECT l_suppkey, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_partkey) > 3 AND min(l_returnflag) = 'A'")
def _(t):
    return t("lineitem").groupBy("l_suppkey").agg(F.count_distinct("l_partkey").alias("parts"), F.min("l_returnflag").alias("f")).where("parts > 3 and f = 'A'").drop("f")


@query("a05_ordered_signature", "SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey, l_suppkey) AS signature FROM lineitem GROUP BY 1")
def _(t):
    return A.ordered_signature(t("lineitem"), ["l_orderkey"], "l_partkey", ["l_linenumber", "l_partkey", "l_suppkey"])


@query("a06_sum_min_rollup", """
SELECT n_regionkey AS root, count(*) AS n, min(o_orderdate) AS first_seen, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1""")
def _(t):
    j = J.star_join(t("orders"), (t("customer"), "o_custkey", "c_custkey"), (t("nation"), "c_nationkey", "n_nationkey"))
    return j.groupBy(F.col("n_regionkey").alias("root")).agg(F.count("*").alias("n"), F.min("o_orderdate").alias("first_seen"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))


@query("a07_distinct_child_rollup", "SELECT DISTINCT n_regionkey AS root, c_mktsegment AS tag FROM customer JOIN nation ON n_nationkey = c_nationkey")
def _(t):
    return t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("root"), F.col("c_mktsegment").alias("tag")).distinct()


@query("a08_earliest_of_two", """
SELECT k, min(y) AS earliest FROM (SELECT o_orderkey AS k, year(o_orderdate) AS y FROM orders UNION ALL SELECT l_orderkey, year(l_shipdate) FROM lineitem) GROUP BY 1""")
def _(t):
    return A.earliest_of_two(t("orders").select(F.col("o_orderkey").alias("k"), F.year("o_orderdate").alias("y")), t("lineitem").select(F.col("l_orderkey").alias("k"), F.year("l_shipdate").alias("y")), "k", "y")


@query("a09_productivity", """
WITH l AS (SELECT l_orderkey, l_partkey, CASE WHEN l_linenumber = min(l_linenumber) OVER w THEN 'pre' WHEN l_linenumber = max(l_linenumber) OVER w THEN 'post' ELSE 'inner' END AS position FROM lineitem WINDOW w AS (PARTITION BY l_orderkey))
SELECT p_partkey AS l_partkey, position, (SELECT count(DISTINCT l_orderkey) FROM l WHERE l.l_partkey = p_partkey AND l.position = g.position) AS productivity FROM part, (SELECT unnest(['pre', 'post', 'inner']) AS position) g""")
def _(t):
    return A.productivity(t("lineitem"), "l_orderkey", "l_linenumber", "l_partkey", t("part").select(F.col("p_partkey").alias("l_partkey")))


@query("a10_set_size_histogram", """
WITH s AS (SELECT c_custkey, count(DISTINCT year(o_orderdate)) AS b FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1) SELECT b AS buckets, count(*) AS entities FROM s GROUP BY 1""")
def _(t):
    return A.set_size_histogram(t("orders").select(F.col("o_custkey").alias("c_custkey"), F.year("o_orderdate").alias("y")), "c_custkey", "y", t("customer"))


_CUBE = """c AS (SELECT c_mktsegment, o_orderpriority, year(o_orderdate) AS y, CASE WHEN o_orderstatus = 'F' THEN 'closed' WHEN o_totalprice < 1000 THEN 'small' ELSE 'ok' END AS status FROM orders JOIN customer ON o_custkey = c_custkey)"""


def _cube(t):
    j = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).withColumn("y", F.year("o_orderdate"))
    return A.count_cube(j, ["c_mktsegment", "o_orderpriority", "y"], [("closed", F.col("o_orderstatus") == "F"), ("small", F.col("o_totalprice") < 1000)])


@query("a11_count_cube", f"WITH {_CUBE} SELECT c_mktsegment, o_orderpriority, y, count(*) AS n FROM c WHERE status = 'ok' GROUP BY ALL")
def _(t):
    return _cube(t)[0]


@query("a11_skip_reasons", f"WITH {_CUBE} SELECT status, count(*) AS n FROM c GROUP BY 1")
def _(t):
    return _cube(t)[1]


@query("a12_fallback_lookup", f"""
WITH {_CUBE}, k AS (SELECT c_mktsegment AS m, o_orderpriority AS p, y, count(*) AS n FROM c WHERE status = 'ok' GROUP BY ALL),
a AS (SELECT DISTINCT c_mktsegment AS m, o_orderpriority AS p, year(o_orderdate) AS y FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT m AS c_mktsegment, p AS o_orderpriority, y, CAST(coalesce((SELECT max(n) FROM k WHERE k.m = a.m AND k.p = a.p AND k.y = a.y), (SELECT max(n) FROM k WHERE k.m = a.m AND k.p = a.p), (SELECT max(n) FROM k WHERE k.m = a.m), (SELECT max(n) FROM k), 0) AS DOUBLE) AS value FROM a""")
def _(t):
    cube = _cube(t)[0]
    asks = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select("c_mktsegment", "o_orderpriority", F.year("o_orderdate").alias("y")).distinct()
    dims = ["c_mktsegment", "o_orderpriority", "y"]
    return A.fallback_max(cube, asks, dims, [["y"], ["o_orderpriority", "y"], dims], "n").withColumn("value", F.col("value").cast("double"))


@query("a13_usage_tallies", """
WITH w AS (SELECT p_brand, unnest(string_split(p_name, ' ')) AS usage, unnest(['pre', 'post']) AS position FROM part)
SELECT p_brand, usage, position, count(*) AS weight FROM w GROUP BY ALL""")
def _(t):
    return t("part").select("p_brand", F.posexplode(F.split("p_name", " ")).alias("i", "usage")).groupBy("p_brand", "usage", F.when(F.col("i") == 0, "pre").otherwise("post").alias("position")).agg(F.count("*").alias("weight"))


@query("a13_structure_templates", "SELECT p_brand, CASE WHEN p_size < 20 THEN 'short' ELSE 'long' END || '-' || len(string_split(p_name, ' ')) AS template, count(*) AS weight FROM part GROUP BY ALL")
def _(t):
    template = F.concat_ws("-", F.when(F.col("p_size") < 20, "short").otherwise("long"), F.size(F.split("p_name", " ")))
    return t("part").groupBy("p_brand", template.alias("template")).agg(F.count("*").alias("weight"))


@query("a14_cumulative_weights", """
WITH w AS (SELECT p_brand, p_name, sum(p_size % 4) AS weight FROM part GROUP BY ALL)
SELECT p_brand, p_name, CAST(weight AS BIGINT) AS weight, CAST(sum(weight) OVER (PARTITION BY p_brand ORDER BY p_name) AS BIGINT) AS cumulative FROM w WHERE weight > 0""")
def _(t):
    w = t("part").groupBy("p_brand", "p_name").agg(F.sum(F.col("p_size").cast("long") % 4).alias("weight"))
    return A.cumulative_weights(w, "p_brand", "p_name", "weight")


_PAIRS = "p AS (SELECT lower(split_part(p_name, ' ', 1)) AS \"left\", lower(split_part(p_name, ' ', 2)) AS \"right\", count(*) AS n FROM part GROUP BY ALL)"


def _pairs(t):
    return A.adjacent_pairs(t("part").select(F.split(F.lower("p_name"), " ").alias("w")), "w")


@query("a15_adjacent_pairs", f"WITH {_PAIRS} SELECT * FROM p")
def _(t):
    return _pairs(t)


@query("a16_conditional_table", f'WITH {_PAIRS} SELECT "left", "right", n, round(n / sum(n) OVER (PARTITION BY "left"), 6) AS p FROM p')
def _(t):
    return A.conditional_table(_pairs(t), "left", "right", "n").withColumn("p", _r("p"))


_DIST = """a AS (SELECT p_brand AS k, count(*) / sum(count(*)) OVER () AS p FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'R' GROUP BY 1),
b AS (SELECT p_brand AS k, count(*) / sum(count(*)) OVER () AS p FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'N' GROUP BY 1)"""


def _brands(t, flag):
    return t("lineitem").where(F.col("l_returnflag") == flag).join(t("part"), F.col("p_partkey") == F.col("l_partkey")).select(F.col("p_brand").alias("k"))


@query("a17_distribution", f"WITH {_DIST} SELECT k, round(p, 6) AS p FROM a")
def _(t):
    return X.distribution(_brands(t, "R"), "k").select("k", _r("p").alias("p"))


@query("a18_kl_divergence", f"WITH {_DIST} SELECT round(sum(a.p * ln(a.p / (coalesce(b.p, 0) + 1e-9))), 8) AS kl FROM a LEFT JOIN b USING (k) WHERE a.p > 0")
def _(t):
    return X.kl_divergence(X.distribution(_brands(t, "R"), "k"), X.distribution(_brands(t, "N"), "k"), "k").select(_r("kl", 8).alias("kl"))


@query("a19_total_variation", f"WITH {_DIST} SELECT round(sum(abs(coalesce(a.p, 0) - coalesce(b.p, 0))) / 2, 8) AS tv FROM a FULL JOIN b USING (k)")
def _(t):
    return X.total_variation(X.distribution(_brands(t, "R"), "k"), X.distribution(_brands(t, "N"), "k"), "k").select(_r("tv", 8).alias("tv"))


@query("a20_spearman", f"""
WITH {_DIST}, x AS (SELECT k, row_number() OVER (ORDER BY p DESC, k) AS r FROM a), y AS (SELECT k, row_number() OVER (ORDER BY p DESC, k) AS r FROM b) SELECT round(corr(x.r, y.r), 8) AS rho FROM x JOIN y USING (k)""")
def _(t):
    rank = lambda f: X.ranked(_brands(t, f).groupBy("k").agg(F.count("*").alias("n")), "k", "n")
    return X.spearman(rank("R"), rank("N"), "k").select(_r("rho", 8).alias("rho"))


@query("a21_fraction_true", "SELECT round(avg(CASE WHEN l_quantity > 25 THEN 1.0 ELSE 0.0 END), 8) AS fraction FROM lineitem")
def _(t):
    return X.fraction_true(t("lineitem"), F.col("l_quantity") > 25).select(_r("fraction", 8).alias("fraction"))


@query("a22_grade_sets", """
WITH f AS (SELECT l_orderkey, list(DISTINCT l_returnflag ORDER BY l_returnflag) AS found, list(DISTINCT CASE WHEN l_linenumber <= 2 THEN l_returnflag END ORDER BY CASE WHEN l_linenumber <= 2 THEN l_returnflag END) FILTER (l_linenumber <= 2) AS wanted FROM lineitem GROUP BY 1)
SELECT l_orderkey, round(len(list_intersect(found, coalesce(wanted, []))) / greatest(len(coalesce(wanted, [])), 1), 6) AS recall,
  round(len(list_filter(found, lambda x: NOT list_contains(coalesce(wanted, []), x))) / len(found), 6) AS spurious, found = coalesce(wanted, []) AS exact FROM f""")
def _(t):
    f = t("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_returnflag")).alias("found"), F.array_sort(F.collect_set(F.when(F.col("l_linenumber") <= 2, F.col("l_returnflag")))).alias("wanted"))
    return X.grade(f, "found", "wanted").select("l_orderkey", _r("recall").alias("recall"), _r("spurious").alias("spurious"), "exact")


@query("a23_paired_diff", """
WITH a AS (SELECT user_id, count(*) AS n, max(CAST(value AS DECIMAL(18,4))) AS v FROM events WHERE day(ts) <= 15 GROUP BY 1), b AS (SELECT user_id, count(*) AS n, max(CAST(value AS DECIMAL(18,4))) AS v FROM events WHERE day(ts) > 15 GROUP BY 1)
SELECT user_id, concat_ws(',', CASE WHEN b.n < a.n THEN 'n' END, CASE WHEN b.v > a.v THEN 'v' END) AS regressions, concat_ws(',', CASE WHEN b.n > a.n THEN 'n' END, CASE WHEN b.v < a.v THEN 'v' END) AS improvements FROM a JOIN b USING (user_id)""")
def _(t):
    half = lambda cond: t("events").where(cond).groupBy("user_id").agg(F.count("*").alias("n"), F.max(F.col("value").cast("decimal(18,4)")).alias("v"))
    return X.paired_diff(half(F.dayofmonth("ts") <= 15), half(F.dayofmonth("ts") > 15), "user_id", {"n": True, "v": False}).select("user_id", F.concat_ws(",", "regressions").alias("regressions"), F.concat_ws(",", "improvements").alias("improvements"))


@query("a24_eb_smoothing", """
WITH c AS (SELECT p_brand, count(*) FILTER (l_returnflag = 'R') AS s, count(*) FILTER (l_returnflag <> 'R') AS l FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1), g AS (SELECT sum(s) / sum(s + l) AS b FROM c)
SELECT p_brand, s, l, round((s + 5 * b) / (s + l + 5), 8) AS probability FROM c, g""")
def _(t):
    c = t("lineitem").join(t("part"), F.col("p_partkey") == F.col("l_partkey")).groupBy("p_brand").agg(F.count_if(F.col("l_returnflag") == "R").alias("s"), F.count_if(F.col("l_returnflag") != "R").alias("l"))
    return X.eb_smoothing(c, "s", "l").withColumn("probability", _r("probability", 8))


@query("a25_conditional_tallies", """
SELECT 's' || short_form AS long_form, short_form, long_count, short_count FROM
  (SELECT substr(word, 2) AS short_form, count(*) AS long_count FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents) WHERE starts_with(word, 's') AND length(word) > 1 GROUP BY 1) JOIN
  (SELECT word AS short_form, count(*) AS short_count FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents) GROUP BY 1) USING (short_form)""")
def _(t):
    n = t("documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    long = n.where("w like 's%' and length(w) > 1").select(F.col("w").alias("long_form"), F.expr("substring(w, 2)").alias("short_form"), F.col("n").alias("long_count"))
    return long.join(n.select(F.col("w").alias("short_form"), F.col("n").alias("short_count")), "short_form").select("long_form", "short_form", "long_count", "short_count")


@query("a26_winning_cluster", """
WITH k AS (SELECT l_partkey AS place, l_returnflag || l_linestatus AS key, min(l_orderkey) AS first, count(*) AS votes FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY place ORDER BY votes DESC, first) AS i FROM k)
SELECT place, max(CASE WHEN i = 1 AND votes >= 2 THEN key END) AS winner, max(CASE WHEN i = 1 THEN votes END) AS votes, coalesce(max(CASE WHEN i = 2 THEN votes END), 0) AS runner_up FROM r GROUP BY 1""")
def _(t):
    c = t("lineitem").select(F.col("l_partkey").alias("place"), F.concat("l_returnflag", "l_linestatus").alias("key"), F.col("l_orderkey").alias("row"))
    return A.winning_cluster(c, "place", "key", "row")


@query("a27_corroboration", "SELECT c_custkey, count(DISTINCT CASE WHEN o_orderpriority <> '1-URGENT' THEN o_orderpriority END) AS others FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1 HAVING others >= 3")
def _(t):
    return A.corroborated(t("orders").withColumnRenamed("o_custkey", "c_custkey"), t("customer"), "c_custkey", "o_orderpriority", "1-URGENT", 3)


@query("a28_promotion_union", """
WITH c AS (SELECT c_custkey, c_mktsegment, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY ALL)
SELECT c_custkey FROM c WHERE n >= CASE c_mktsegment WHEN 'BUILDING' THEN 12 WHEN 'MACHINERY' THEN 8 ELSE 10 END UNION SELECT o_custkey FROM orders WHERE o_totalprice > 450000 UNION SELECT c_custkey FROM customer WHERE c_acctbal > 9900""")
def _(t):
    c = t("customer").join(t("orders"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_custkey", "c_mktsegment").agg(F.count("*").alias("n"))
    flat = [t("orders").where("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey")), t("customer").where("c_acctbal > 9900").select("c_custkey")]
    return A.promotion_union(c, "c_custkey", "c_mktsegment", "n", {"BUILDING": 12, "MACHINERY": 8}, 10, flat)


@query("a29_scorecard", """
SELECT source, count(*) AS docs, count(DISTINCT text) AS texts, CAST(sum(n_chars) AS BIGINT) AS chars, count(quality) AS labelled, count(*) FILTER (quality = 1) AS good, count(*) FILTER (n_chars < 200) AS short FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def _(t):
    j = t("documents").join(t("labels"), "doc_id", "left")
    return j.groupBy("source").agg(F.count("*").alias("docs"), F.count_distinct("text").alias("texts"), F.sum("n_chars").alias("chars"), F.count("quality").alias("labelled"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("n_chars") < 200).alias("short"))


@query("a30_source_dependence", """
SELECT o_custkey, CASE WHEN bool_and(o_orderpriority IN ('1-URGENT', '2-HIGH')) THEN 'only' WHEN bool_or(o_orderpriority IN ('1-URGENT', '2-HIGH')) THEN 'mixed' ELSE 'none' END AS dependence FROM orders GROUP BY 1""")
def _(t):
    return A.source_dependence(t("orders"), "o_custkey", "o_orderpriority", ["1-URGENT", "2-HIGH"])


@query("a31_hierarchical_report", """
SELECT r_name, n_name, c_mktsegment, count(*) AS n, count(*) FILTER (c_acctbal < 0) AS gap, CAST(3 - grouping(r_name) - grouping(n_name) - grouping(c_mktsegment) AS BIGINT) AS depth
FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ROLLUP (r_name, n_name, c_mktsegment) HAVING grouping(r_name) = 0""")
def _(t):
    j = J.star_join(t("customer"), (t("nation"), "c_nationkey", "n_nationkey"), (t("region"), "n_regionkey", "r_regionkey"))
    return A.hierarchical_report(j, ["r_name", "n_name", "c_mktsegment"], {"n": F.count("*"), "gap": F.count_if(F.col("c_acctbal") < 0)})


@query("a32_null_population", """
WITH j AS (SELECT o_orderkey, l_partkey, l_comment FROM (SELECT o_orderkey, l_partkey, CASE WHEN l_tax > 0.04 THEN l_returnflag END AS l_comment FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey))
SELECT 'o_orderkey' AS column_name, count(o_orderkey) AS filled, count(*) AS total FROM j UNION ALL SELECT 'l_partkey', count(l_partkey), count(*) FROM j UNION ALL SELECT 'l_comment', count(l_comment), count(*) FROM j""")
def _(t):
    j = t("orders").join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumn("l_comment", F.when(F.col("l_tax") > 0.04, F.col("l_returnflag")))
    return A.null_population(j, ["o_orderkey", "l_partkey", "l_comment"])


@query("a33_flag_rate", "SELECT source, count(*) AS n, count(*) FILTER (contains(text, '!!')) AS flagged, round(count(*) FILTER (contains(text, '!!')) / count(*), 6) AS rate FROM documents GROUP BY 1")
def _(t):
    return A.flag_rate(t("documents"), "source", F.contains("text", F.lit("!!"))).withColumn("rate", _r("rate"))


@query("a34_fragment_frequency", "SELECT f AS fragment, count(*) AS n FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS f FROM part) WHERE length(f) >= 4 GROUP BY 1")
def _(t):
    return t("part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("fragment")).where("length(fragment) >= 4").groupBy("fragment").agg(F.count("*").alias("n"))


@query("a35_impact_ranking", "SELECT l_partkey, count(DISTINCT l_orderkey) AS impact, row_number() OVER (ORDER BY count(DISTINCT l_orderkey) DESC, l_partkey) AS place FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_orderkey) >= 2 QUALIFY place <= 50")
def _(t):
    n = t("lineitem").groupBy("l_partkey").agg(F.count_distinct("l_orderkey").alias("impact")).where("impact >= 2").orderBy(F.desc("impact"), "l_partkey").limit(50)
    return n.withColumn("place", F.row_number().over(Window.orderBy(F.desc("impact"), "l_partkey")))


@query("a36_gap_matrix", """
SELECT n AS band, count(*) AS n, count(*) FILTER (NOT rich) AS no_rich, count(*) FILTER (NOT solvent) AS no_solvent FROM (SELECT c_custkey, least(count(o_orderkey), 15) AS n, coalesce(max(o_totalprice) > 300000, false) AS rich, c_acctbal >= 0 AS solvent FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_acctbal) GROUP BY 1""")
def _(t):
    j = t("customer").join(t("orders"), F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey", "c_acctbal").agg(F.least(F.count("o_orderkey"), F.lit(15)).alias("k"), F.coalesce(F.max("o_totalprice") > 300000, F.lit(False)).alias("rich"))
    return A.gap_matrix(j, F.col("k"), {"rich": F.col("rich"), "solvent": F.col("c_acctbal") >= 0})


@query("d01_order_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def _(t):
    return t("orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("d02_top_n_per_group", "SELECT c_nationkey, c_custkey, c_acctbal, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer QUALIFY rank <= 5")
def _(t):
    return D.top_n_per_key(t("customer").select("c_nationkey", "c_custkey", "c_acctbal"), ["c_nationkey"], [F.desc("c_acctbal"), "c_custkey"], 5)


@query("d03_first_wins", "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def _(t):
    return D.first_per_key(t("events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("d04_case_fold_groups", "SELECT lower(p_name) AS folded, arg_min(p_name, (p_size, p_partkey)) AS representative, count(*) AS members FROM part GROUP BY 1")
def _(t):
    return D.case_fold_groups(t("part"), "p_name", F.col("p_size"), "p_partkey")


@query("d06_unanimous", "SELECT l_orderkey, CASE WHEN count(DISTINCT l_returnflag) = 1 THEN min(l_returnflag) END AS flag FROM lineitem GROUP BY 1")
def _(t):
    return D.unanimous(t("lineitem"), ["l_orderkey"], "l_returnflag", "flag")


@query("d07_argmax_conflict", "SELECT l_orderkey AS l_orderkey, arg_max(l_partkey, (l_quantity, -l_partkey)) AS best, count(DISTINCT l_returnflag) > 1 AS conflict FROM lineitem GROUP BY 1")
def _(t):
    return D.argmax_with_conflict(t("lineitem"), "l_orderkey", "l_quantity", "l_partkey", "l_returnflag")


@query("d09_frequency_pick", "SELECT o_custkey, o_orderpriority AS main FROM (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderpriority) = 1")
def _(t):
    return D.frequency_pick(t("orders"), ["o_custkey"], "o_orderpriority", "main")


@query("d10_sibling_ranking", """
SELECT p_name, string_agg(p_brand, '>' ORDER BY p_size DESC, p_partkey) AS ranked, len(list(DISTINCT p_type)) AS tags FROM part GROUP BY 1""")
def _(t):
    row = F.struct((-F.col("p_size")).alias("s"), "p_partkey", "p_brand")
    return t("part").groupBy("p_name").agg(F.array_join(F.transform(F.sort_array(F.collect_list(row)), lambda x: x["p_brand"]), ">").alias("ranked"), F.count_distinct("p_type").alias("tags"))


@query("d11_next_slice", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AND o_orderstatus <> 'P' ORDER BY o_orderkey LIMIT 40")
def _(t):
    done = t("lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    parked = t("orders").where("o_orderstatus = 'P'").select("o_orderkey")
    return D.next_slice(t("orders").select("o_orderkey"), [done, parked], "o_orderkey", ["o_orderkey"], 40)


@query("s01_union_distinct", "SELECT l_partkey AS k FROM lineitem UNION SELECT p_partkey FROM part")
def _(t):
    return t("lineitem").select(F.col("l_partkey").alias("k")).union(t("part").select("p_partkey")).distinct()


@query("s02_union_all", "SELECT kind, count(*) AS n FROM (SELECT 'o' AS kind FROM orders UNION ALL SELECT 'e' FROM events WHERE event_type = 'click' UNION ALL SELECT 'e' FROM events WHERE event_type = 'error') GROUP BY 1")
def _(t):
    e = t("events")
    u = t("orders").select(F.lit("o").alias("kind")).unionByName(e.where("event_type = 'click'").select(F.lit("e").alias("kind"))).unionByName(e.where("event_type = 'error'").select(F.lit("e").alias("kind")))
    return u.groupBy("kind").agg(F.count("*").alias("n"))


@query("s03_seed_expansion", """
WITH s AS (SELECT p_partkey AS k FROM part WHERE p_size = 1), e AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem) SELECT k FROM s UNION SELECT b FROM e WHERE a IN (SELECT k FROM s) UNION SELECT a FROM e WHERE b IN (SELECT k FROM s)""")
def _(t):
    e = t("lineitem").selectExpr("l_partkey as a", "l_suppkey as b").distinct()
    return S.expand_seeds(t("part").where("p_size = 1").select(F.col("p_partkey").alias("k")), e, "k", "a", "b")


@query("s04_remaining", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 200000 EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def _(t):
    o = t("orders").withColumnRenamed("o_custkey", "c_custkey")
    return S.remaining(t("customer").select("c_custkey"), o.where("o_totalprice > 200000"), o.where("o_orderstatus = 'P'"), key="c_custkey")


@query("s05_ledger_union", """
WITH x AS (SELECT o_custkey AS k, max(o_orderkey) AS v, 0 AS o FROM orders WHERE o_orderstatus = 'F' GROUP BY 1 UNION ALL SELECT o_custkey, o_orderkey, 1 FROM orders WHERE o_orderstatus = 'O') SELECT k, v FROM x QUALIFY row_number() OVER (PARTITION BY k ORDER BY o, v) = 1""")
def _(t):
    o = t("orders").selectExpr("o_custkey as k", "o_orderkey as v", "o_orderstatus as s")
    return S.keep_existing(o.where("s = 'F'").groupBy("k").agg(F.max("v").alias("v")), o.where("s = 'O'").drop("s"), ["k"])


@query("s06_field_merge", """
WITH e AS (SELECT user_id, event_id, event_type, CASE WHEN value > 50 THEN event_type END AS strong FROM events), f AS (SELECT user_id, event_type, min(event_id) AS i FROM e GROUP BY 1, 2)
SELECT e.user_id, (SELECT string_agg(event_type, '>' ORDER BY i) FROM f WHERE f.user_id = e.user_id) AS types, arg_min(strong, event_id) FILTER (strong IS NOT NULL) AS strong FROM e GROUP BY e.user_id""")
def _(t):
    e = t("events").select("user_id", "event_id", F.array("event_type").alias("types"), F.when(F.col("value") > 50, F.col("event_type")).alias("strong"))
    return S.merge_fields(e, "user_id", "event_id", ["types"], ["strong"]).select("user_id", F.array_join("types", ">").alias("types"), "strong")


@query("s07_vocabulary_scan", """
SELECT v AS value, count(*) AS n, CASE WHEN v IS NULL THEN 'info' WHEN v IN ('click', 'view', 'purchase') THEN 'ok' WHEN v = 'signup' THEN 'stale' WHEN lower(trim(v)) IN ('click', 'view', 'purchase') THEN 'dirty' ELSE 'unknown' END AS status, CASE WHEN v = 'signup' THEN 'register' END AS target
FROM (SELECT CASE WHEN event_id % 10 = 0 THEN NULL WHEN event_id % 10 = 1 THEN upper(event_type) ELSE event_type END AS v FROM events) GROUP BY ALL""")
def _(t):
    v = F.when(F.col("event_id") % 10 == 0, None).when(F.col("event_id") % 10 == 1, F.upper("event_type")).otherwise(F.col("event_type"))
    return S.vocabulary_scan(t("events").select(v.alias("v")), "v", ["click", "view", "purchase"], {"signup": "register"})
