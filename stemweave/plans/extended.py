"""Further queries: readings, structure picks, evidence, membership and publication tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import generation as N
from ..operators import joins as J
from ..operators import ranking as D
from ..operators import scoring as W
from ..operators import text as T
from .language import _ENTRIES, _entries, _glued, _parses
from .registry import query


@query("j14_poor_rich_similarity", """
WITH u AS (SELECT p_name, count(*) AS n FROM part GROUP BY 1), x AS (SELECT p_name, n, split_part(p_name, ' ', 1) AS h, split_part(p_name, ' ', 2) AS t FROM u), m AS (SELECT avg(n) AS a FROM u)
SELECT p.p_name AS poor, r.p_name AS rich, levenshtein(p.p_name, r.p_name) AS d FROM x p, x r, m WHERE p.n < m.a AND r.n >= m.a AND (p.h = r.h OR p.t = r.t) AND p.p_name <> r.p_name QUALIFY row_number() OVER (PARTITION BY p.p_name ORDER BY d, r.n DESC, r.p_name) = 1""")
def _(t):
    u = t("part").groupBy("p_name").agg(F.count("*").alias("n"))
    u = u.crossJoin(F.broadcast(u.agg(F.avg("n").alias("a"))))  # one row
    words = F.explode(F.array(F.concat(F.lit("h:"), F.split("p_name", " ")[0]), F.concat(F.lit("t:"), F.split("p_name", " ")[1])))
    poor = u.where("n < a").select(F.col("p_name").alias("poor"), words.alias("k"))
    rich = u.where("n >= a").select(F.col("p_name").alias("rich"), "n", words.alias("k"))
    pairs = poor.join(rich, "k").select("poor", "rich", "n").distinct().where("poor <> rich").withColumn("d", F.levenshtein("poor", "rich").cast("long"))
    return D.first_per_key(pairs, ["poor"], ["d", F.desc("n"), "rich"]).select("poor", "rich", "d")


@query("j19_natural_key_resolve", "SELECT o_orderkey, n_name || ':' || c_name AS ref FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey")
def _(t):
    j = J.star_join(t("orders"), (t("customer"), "o_custkey", "c_custkey"), (t("nation"), "c_nationkey", "n_nationkey"))
    return j.select("o_orderkey", F.concat_ws(":", "n_name", "c_name").alias("ref"))


@query("a41_reflex_coverage", "SELECT p_brand, count(*) AS total, count(*) FILTER (p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')) AS direct, count(*) FILTER (p_size <= 10) AS derived FROM part GROUP BY 1")
def _(t):
    used = t("lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"), F.lit(True).alias("_u")).distinct()
    return t("part").join(used, "p_partkey", "left").groupBy("p_brand").agg(F.count("*").alias("total"), F.count("_u").alias("direct"), F.count_if(F.col("p_size") <= 10).alias("derived"))


@query("a42_filled_share", "SELECT c_mktsegment, count(CASE WHEN c_acctbal > 0 THEN 1 END) AS filled, count(*) AS total FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) GROUP BY 1")
def _(t):
    e = t("customer").join(t("orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi")
    return e.groupBy("c_mktsegment").agg(F.count(F.when(F.col("c_acctbal") > 0, 1)).alias("filled"), F.count("*").alias("total"))


@query("t04_culture_tie_break", """
WITH c AS (SELECT l_orderkey, l_returnflag AS parse, count(*) FILTER (s_nationkey < 12) AS aligned, min(l_linenumber) AS first FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2), m AS (SELECT *, max(aligned) OVER (PARTITION BY l_orderkey) AS top FROM c)
SELECT l_orderkey, parse, aligned FROM m WHERE top = 0 OR aligned = top QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY first, parse) = 1""")
def _(t):
    c = t("lineitem").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy("l_orderkey", F.col("l_returnflag").alias("parse")).agg(F.count_if(F.col("s_nationkey") < 12).alias("aligned"), F.min("l_linenumber").alias("first"))
    top = F.max("aligned").over(Window.partitionBy("l_orderkey"))
    return D.first_per_key(c.withColumn("top", top).where("top = 0 or aligned = top"), ["l_orderkey"], ["first", "parse"]).select("l_orderkey", "parse", "aligned")


@query("t15_reverse_search", """
WITH x AS (SELECT doc_id, unnest(regexp_extract_all(text, '([A-Z][a-z]+) ([a-z]{4,})', 1)) AS form, unnest(regexp_extract_all(text, '([A-Z][a-z]+) ([a-z]{4,})', 2)) AS mate FROM documents), k AS (SELECT form, count(DISTINCT mate) AS n, min(mate) AS mate FROM x GROUP BY 1)
SELECT x.form, x.mate, count(*) AS hits FROM x JOIN k ON k.form = x.form AND k.n = 1 GROUP BY 1, 2""")
def _(t):
    p = r"([A-Z][a-z]+) ([a-z]{4,})"
    zipped = F.arrays_zip(F.regexp_extract_all("text", F.lit(p), F.lit(1)).alias("f"), F.regexp_extract_all("text", F.lit(p), F.lit(2)).alias("m"))
    x = t("documents").select(F.explode(zipped).alias("z")).select(F.col("z.f").alias("form"), F.col("z.m").alias("mate"))
    one = x.groupBy("form").agg(F.count_distinct("mate").alias("n")).where("n = 1").select("form")
    return x.join(one, "form", "left_semi").groupBy("form", "mate").agg(F.count("*").alias("hits"))


@query("w11_single_slot_regenerate", """
SELECT l_orderkey, min(p_name) AS replacement FROM (SELECT DISTINCT l_orderkey, p_brand FROM lineitem JOIN part ON p_partkey = l_partkey) o JOIN part USING (p_brand) WHERE p_name NOT IN (SELECT p_name FROM lineitem JOIN part ON p_partkey = l_partkey WHERE lineitem.l_orderkey = o.l_orderkey) GROUP BY 1""")
def _(t):
    used = t("lineitem").join(t("part"), F.col("p_partkey") == F.col("l_partkey")).select("l_orderkey", "p_brand", "p_name")
    return N.first_unused(used, "l_orderkey", "p_brand", "p_name", t("part")).withColumnRenamed("p_name", "replacement")


@query("w13_rendering", "SELECT l_orderkey, string_agg(p_name || '/' || l_returnflag, ' ' ORDER BY l_linenumber, l_partkey, l_suppkey) AS rendered FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1")
def _(t):
    j = t("lineitem").join(t("part"), F.col("p_partkey") == F.col("l_partkey")).withColumn("r", F.concat_ws("/", "p_name", "l_returnflag"))
    return j.groupBy("l_orderkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "r"))), lambda x: x["r"]), " ").alias("rendered"))


@query("z02_all_readings", f"""
WITH RECURSIVE {_ENTRIES}, {_parses("SELECT DISTINCT replace(lower(p_name), ' ', 's') || 's' || lower(split_part(p_name, ' ', 2)) AS word FROM part", "'s'")}, c AS (SELECT word, min({{'un': un, 'm': m}}) AS c FROM parses GROUP BY 1)
SELECT word, parse, un AS unaccounted, m AS morphemes FROM parses JOIN c USING (word) WHERE un = c.un AND m = c.m""")
def _(t):
    """Every tied best parse of each glued name, with glue between parts allowed."""
    name = F.lower("p_name")
    return T.segment(t("part").select(F.concat(F.replace(name, F.lit(" "), F.lit("s")), F.lit("s"), F.split_part(name, F.lit(" "), F.lit(2))).alias("g")), "g", _entries(t), "w", ("s",), all_ties=True)


@query("z04_stage_order", "SELECT o_custkey, string_agg(DISTINCT CAST(year(o_orderdate) AS VARCHAR), '>' ORDER BY CAST(year(o_orderdate) AS VARCHAR)) AS stages FROM orders GROUP BY 1")
def _(t):
    return t("orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set(F.year("o_orderdate").cast("string"))), ">").alias("stages"))


@query("z05_gap_mining", """
WITH w AS (SELECT lang, lower(unnest(regexp_extract_all(text, '[A-Za-z]{6,}'))) AS w FROM documents), t AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]{6,}'))) AS w FROM benchmark)
SELECT w, arg_min(lang, (-n, lang)) AS lang, sum(n)::BIGINT AS n FROM (SELECT lang, w, count(*) AS n FROM w WHERE w IN (SELECT w FROM t) GROUP BY 1, 2) GROUP BY 1""")
def _(t):
    words = lambda df, *k: df.select(*k, F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]{6,})"), F.lit(1))).alias("x")).select(*k, F.lower("x").alias("w"))
    n = words(t("documents"), "lang").join(words(t("benchmark")).distinct(), "w", "left_semi").groupBy("lang", "w").agg(F.count("*").alias("n"))
    return n.groupBy("w").agg(F.min_by("lang", F.struct(-F.col("n"), "lang")).alias("lang"), F.sum("n").alias("n"))


@query("z10_suffix_evidence", """
WITH w AS (SELECT lang, lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS w FROM documents), c AS (SELECT lang, w, count(*) AS n FROM w GROUP BY 1, 2)
SELECT lang, CASE WHEN regexp_matches(w, '(ing|inge|inges)$') THEN 'split' WHEN regexp_matches(w, 's$') THEN 'literal' END AS evidence, sum(n)::BIGINT AS n FROM c GROUP BY 1, 2""")
def _(t):
    w = t("documents").select("lang", F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), F.lit(1))).alias("x")).select("lang", F.lower("x").alias("w"))
    e = F.when(F.col("w").rlike("(ing|inge|inges)$"), "split").when(F.col("w").rlike("s$"), "literal")
    return w.groupBy("lang", e.alias("evidence")).agg(F.count("*").alias("n"))


@query("z12_entry_persistence", "SELECT DISTINCT n_name || '@' || r_name AS ref, row_number() OVER (PARTITION BY r_name ORDER BY n_name) AS ordinal FROM nation JOIN region ON r_regionkey = n_regionkey")
def _(t):
    j = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.select(F.concat_ws("@", "n_name", "r_name").alias("ref"), F.row_number().over(Window.partitionBy("r_name").orderBy("n_name")).alias("ordinal"))


@query("z13_membership_list", """
SELECT p_type, count(*) AS members, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) FILTER (p_size < 5) AS core FROM part GROUP BY 1""")
def _(t):
    core = F.array_join(F.array_sort(F.collect_set(F.when(F.col("p_size") < 5, F.col("p_brand")))), ",")
    return t("part").groupBy("p_type").agg(F.count("*").alias("members"), F.nullif(core, F.lit("")).alias("core"))


@query("z15_assertion_authoring", "SELECT l_partkey, l_suppkey, 'AS' || left(sha256('=' || l_partkey || chr(31) || '=' || l_suppkey), 16) AS id, CASE WHEN count(*) >= 2 THEN 'high' ELSE 'low' END AS confidence FROM lineitem GROUP BY 1, 2")
def _(t):
    g = t("lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"))
    return g.select("l_partkey", "l_suppkey", S.content_id("AS", F.col("l_partkey"), F.col("l_suppkey")).alias("id"), F.when(F.col("n") >= 2, "high").otherwise("low").alias("confidence"))


@query("z18_done_ledger", "SELECT o_custkey, count(*) AS open FROM orders WHERE o_orderstatus = 'O' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F') GROUP BY 1")
def _(t):
    done = t("lineitem").where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("o_orderkey"))
    return t("orders").where("o_orderstatus = 'O'").join(done, "o_orderkey", "left_anti").groupBy("o_custkey").agg(F.count("*").alias("open"))


@query("z20_slice_totals", "SELECT event_type, day(ts) AS slice, count(*) AS n FROM events GROUP BY ROLLUP (event_type, slice) HAVING grouping(event_type) = 0")
def _(t):
    return t("events").rollup("event_type", F.dayofmonth("ts").alias("slice")).agg(F.count("*").alias("n"), F.grouping("event_type").alias("g")).where("g = 0").drop("g")


@query("z21_case_insensitive_records", "SELECT lower(p_name) AS name, max(p_partkey) AS latest FROM part GROUP BY 1")
def _(t):
    return t("part").groupBy(S.ascii_lower(F.col("p_name")).alias("name")).agg(F.max("p_partkey").alias("latest"))
