"""Queries for the composed domain steps on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import log as L
from ..operators import workflows as Y
from .registry import query


@query("a38_profile_coverage", """
WITH t AS (SELECT p_brand, unnest(string_split(p_name, ' ')) AS tag FROM part), c AS (SELECT p_brand, tag, count(*) AS n FROM t GROUP BY 1, 2), top AS (SELECT tag FROM c WHERE p_brand = 'Brand#1' ORDER BY n DESC, tag LIMIT 5),
g AS (SELECT b.p_brand, top.tag, coalesce(n, 0) AS n FROM (SELECT DISTINCT p_brand FROM c) b CROSS JOIN top LEFT JOIN c ON c.p_brand = b.p_brand AND c.tag = top.tag)
SELECT p_brand, tag, n, count(*) FILTER (n > 0) OVER (PARTITION BY p_brand) AS hits, count(*) OVER (PARTITION BY p_brand) AS "of" FROM g""")
def _(t):
    return Y.profile_coverage(t("part").select("p_brand", F.explode(F.split("p_name", " ")).alias("tag")), "p_brand", "tag", "Brand#1", 5)


_LOG = """e AS (SELECT user_id, event_id, CASE event_type WHEN 'signup' THEN 'set' WHEN 'purchase' THEN 'patch' WHEN 'error' THEN 'remove' WHEN 'click' THEN 'add' END AS op FROM events WHERE event_type <> 'view')"""


@query("l02_compacted_log", f"""
WITH RECURSIVE {_LOG}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM e),
r AS (SELECT user_id, 0::BIGINT AS i, false AS live, NULL::BIGINT AS last FROM (SELECT DISTINCT user_id FROM e) UNION ALL
  SELECT r.user_id, r.i + 1, CASE WHEN op = 'remove' THEN false WHEN op = 'patch' AND NOT live THEN false ELSE true END,
    CASE WHEN op = 'remove' THEN NULL WHEN (op = 'add' AND live) OR (op = 'patch' AND NOT live) THEN last ELSE event_id END FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1),
f AS (SELECT user_id, live, last FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i DESC) = 1)
SELECT f.user_id, max(e.event_id) AS event_id, CAST(any_value(last) AS VARCHAR) AS last, true AS same FROM f JOIN e USING (user_id) WHERE live GROUP BY 1""")
def _(t):
    """Each live key as one row; folding the compacted log again gives the same state."""
    op = F.when(F.col("event_type") == "signup", "set").when(F.col("event_type") == "purchase", "patch").when(F.col("event_type") == "error", "remove").when(F.col("event_type") == "click", "add")
    log = t("events").where("event_type <> 'view'").select("user_id", "event_id", op.alias("op"), F.create_map(F.lit("last"), F.col("event_id").cast("string")).alias("f"))
    small = Y.compact_log(log, ["user_id"], "event_id", "op", "f")
    again = L.fold_log(small, ["user_id"], "event_id", "op", "f").select("user_id", F.try_element_at("state", F.lit("last")).alias("_again"))
    out = small.join(again, "user_id").withColumn("last", F.try_element_at("f", F.lit("last")))
    return out.select("user_id", "event_id", "last", F.col("last").eqNullSafe(F.col("_again")).alias("same"))


@query("l10_triage_outcomes", """
WITH x AS (SELECT event_id, day(ts) AS batch, user_id, CASE event_type WHEN 'signup' THEN 'create' WHEN 'click' THEN 'map' WHEN 'error' THEN 'skip' ELSE 'defer' END AS action, user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 60) AS known FROM events),
y AS (SELECT *, sum((action = 'map' AND NOT known)::INT) OVER (PARTITION BY batch) > 40 AS off FROM x), z AS (SELECT *, action = 'create' AND NOT known AND NOT off AS creates FROM y), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, creates ORDER BY event_id) AS k FROM z)
SELECT event_id, CASE WHEN off THEN 'aborted' WHEN action = 'map' AND NOT known THEN 'error' WHEN creates AND k = 1 THEN 'create' WHEN action = 'create' THEN 'map' ELSE action END AS outcome FROM r""")
def _(t):
    e = t("events")
    action = F.when(F.col("event_type") == "signup", "create").when(F.col("event_type") == "click", "map").when(F.col("event_type") == "error", "skip").otherwise("defer")
    rows = e.select("event_id", F.dayofmonth("ts").alias("batch"), "user_id", action.alias("action"))
    return Y.triage(rows, "batch", "event_id", "user_id", "action", e.where("event_type = 'purchase' and value > 60"), 40).select("event_id", "outcome")


@query("w11_slot_regeneration", """
WITH n AS (SELECT l_orderkey, l_linenumber, p_name, p_brand FROM lineitem JOIN part ON p_partkey = l_partkey), pool AS (SELECT p_brand, p_name, sum(p_size) AS score FROM part GROUP BY 1, 2), o AS (SELECT l_orderkey, max(p_brand) FILTER (l_linenumber = 1) AS pool FROM n GROUP BY 1)
SELECT o.l_orderkey, arg_min(pool.p_name, (-score, pool.p_name)) FILTER (NOT EXISTS (SELECT 1 FROM n WHERE n.l_orderkey = o.l_orderkey AND n.p_name = pool.p_name)) AS replacement FROM o JOIN pool ON pool.p_brand = o.pool WHERE o.pool IS NOT NULL GROUP BY 1""")
def _(t):
    """The first slot of each order's name, filled anew from the best of its pool that the name does not hold."""
    n = t("lineitem").join(t("part"), F.col("p_partkey") == F.col("l_partkey")).select("l_orderkey", "l_linenumber", "p_name", F.col("p_brand").alias("pool"))
    pool = t("part").groupBy(F.col("p_brand").alias("pool"), "p_name").agg(F.sum("p_size").alias("score"))
    return Y.regenerate_slot(n, "l_orderkey", "l_linenumber", "p_name", pool, "score", 1)


@query("z04_stage_labels", r"""
WITH x AS (SELECT o_orderkey, year(o_orderdate) AS y, o_orderpriority AS p FROM orders)
SELECT o_orderkey, CASE WHEN y < 1996 THEN NULL ELSE p END AS stage, CAST(CASE WHEN y < 1996 OR y >= 2000 THEN NULL ELSE y - 100 END AS INTEGER) AS start, CAST(CASE WHEN y < 1996 THEN NULL ELSE y + 25 END AS INTEGER) AS "end",
  CAST(CASE WHEN y < 1996 THEN NULL WHEN y >= 2000 THEN y + 25 ELSE floor((2 * y - 75) / 2) END AS INTEGER) AS middle FROM x""")
def _(t):
    y = F.year("o_orderdate")
    label = F.when(y < 1996, F.concat("o_orderpriority", F.lit(" undated"))).when(y >= 2000, F.concat("o_orderpriority", F.lit(" (-"), y + 25, F.lit(")"))).otherwise(F.concat("o_orderpriority", F.lit(" ("), y - 100, F.lit("–"), y + 25, F.lit(")")))
    return t("orders").select("o_orderkey", Y.parse_stage(label).alias("s")).select("o_orderkey", "s.stage", "s.start", "s.end", "s.middle")


@query("z05_corpus_gaps", """
WITH w AS (SELECT lang, source, lower(unnest(regexp_extract_all(text, '[A-Za-z]{6,}'))) AS w FROM documents), k AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]{6,}'))) AS w FROM benchmark),
c AS (SELECT w, lang, source, count(*) AS n FROM w WHERE w NOT IN (SELECT w FROM k) GROUP BY 1, 2, 3), s AS (SELECT w, source, sum(n) AS n FROM c GROUP BY 1, 2)
SELECT c.w, sum(n)::BIGINT AS n, count(DISTINCT lang) AS slices, (SELECT count(DISTINCT lang) FROM documents) - count(DISTINCT lang) AS missing, any_value(b.source) AS source
FROM c JOIN (SELECT w, arg_min(source, (-n, source)) AS source FROM s GROUP BY 1) b ON b.w = c.w GROUP BY 1 HAVING sum(n) >= 20""")
def _(t):
    words = lambda df, *k: df.select(*k, F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]{6,})"), F.lit(1))).alias("x")).select(*k, F.lower("x").alias("w"))
    counts = words(t("documents"), "lang", "source").groupBy("lang", "source", "w").agg(F.count("*").alias("n"))
    return Y.corpus_gaps(counts, "w", "lang", "source", "n", words(t("benchmark")), 20)


_PLACED = """p AS (SELECT l_orderkey, l_suppkey, p_name, p_type, p_partkey, CASE WHEN l_linenumber = 1 THEN 'pre' ELSE 'post' END AS position FROM lineitem JOIN part ON p_partkey = l_partkey)"""


@query("z07_grounded_consensus", f"""
WITH {_PLACED}, v AS (SELECT p_name, position, p_type, count(DISTINCT l_suppkey) AS witnesses FROM p GROUP BY 1, 2, 3), b AS (SELECT * FROM v WHERE witnesses >= 2 QUALIFY row_number() OVER (PARTITION BY p_name, position ORDER BY witnesses DESC, p_type) = 1)
SELECT b.p_name, position, b.p_type, witnesses, min(p_partkey) AS p_partkey FROM b LEFT JOIN part ON part.p_name = b.p_name AND part.p_type = b.p_type GROUP BY 1, 2, 3, 4""")
def _(t):
    j = t("lineitem").join(t("part"), F.col("p_partkey") == F.col("l_partkey")).withColumn("position", F.when(F.col("l_linenumber") == 1, "pre").otherwise("post"))
    return Y.grounded_consensus(j, "p_name", "position", "p_type", "l_suppkey", t("part"), "p_partkey", 2)


_NAMED = """x AS (SELECT c_custkey AS id, 'N' || c_custkey % 300 AS name, CASE WHEN c_acctbal > 3000 THEN r_name END AS country FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey),
a AS (SELECT name, min(country) AS c FROM x WHERE country IS NOT NULL GROUP BY 1 HAVING count(DISTINCT country) = 1), f AS (SELECT id, name, coalesce(country, c) AS country FROM x LEFT JOIN a USING (name)), k AS (SELECT *, CASE WHEN country IS NULL THEN id ELSE min(id) OVER (PARTITION BY name, country) END AS keep FROM f)"""


def _named(t):
    j = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    x = j.select(F.col("c_custkey").alias("id"), F.concat(F.lit("N"), F.col("c_custkey") % 300).alias("name"), F.when(F.col("c_acctbal") > 3000, F.col("r_name")).alias("country"))
    return Y.backfill_and_merge(x, "id", "name", "country")


@query("z08_backfill_merge", f"WITH {_NAMED} SELECT id, name, country FROM k WHERE keep = id")
def _(t):
    return _named(t)[0]


@query("z08_merged_children", f"WITH {_NAMED} SELECT keep AS o_custkey, count(*) AS n FROM orders JOIN k ON id = o_custkey GROUP BY 1")
def _(t):
    """The orders of merged customers under the one that stays."""
    return L.rewrite_refs(t("orders").select("o_custkey"), _named(t)[1], "o_custkey").groupBy("o_custkey").agg(F.count("*").alias("n"))


@query("z09_audited_links", """
WITH l AS (SELECT DISTINCT p_partkey AS child, p_partkey // 2 AS parent FROM part WHERE p_partkey > 0) SELECT l.parent, l.child, levenshtein(a.p_name, b.p_name) AS d FROM l JOIN part a ON a.p_partkey = l.parent JOIN part b ON b.p_partkey = l.child
WHERE levenshtein(a.p_name, b.p_name) > 6 AND NOT list_has_any(string_split(lower(a.p_type), ' '), string_split(lower(b.p_type), ' '))""")
def _(t):
    links = t("part").where("p_partkey > 0").selectExpr("p_partkey as child", "p_partkey div 2 as parent")
    return Y.audit_links(links, "parent", "child", t("part"), "p_partkey", "p_name", "p_type", 6)


@query("z10_genitive_links", """
WITH x AS (SELECT split_part(p_name, ' ', 1) AS head, CASE p_size % 4 WHEN 0 THEN 'es' WHEN 1 THEN 's' WHEN 2 THEN '' ELSE NULL END AS link FROM part) SELECT head, link, count(*) AS n FROM x WHERE link IS NOT NULL GROUP BY 1, 2""")
def _(t):
    """Old spellings of names with a link between their parts; a fourth of them is spelled otherwise and says nothing."""
    w, k = F.split("p_name", " "), F.col("p_size") % 4
    old = F.when(k == 0, F.concat(w[0], F.lit("es"), w[1])).when(k == 1, F.concat(w[0], F.lit("s"), w[1])).when(k == 2, F.concat(w[0], w[1])).otherwise(F.concat(F.lit("x"), w[0], w[1]))
    return Y.genitive_evidence(t("part").select(w[0].alias("head"), w[1].alias("tail"), old.alias("old")), "old", "head", "tail")


@query("z12_persisted_entries", """
WITH x AS (SELECT item_id, array_to_string(string_split(text, ' ')[1:3], ' ') AS head FROM benchmark) SELECT 'EN' || left(sha256('=' || head), 16) AS id, head, min(item_id) AS item_id FROM x GROUP BY 1, 2""")
def _(t):
    """Entries by the hash of their heads; storing them once more, with others, adds nothing twice."""
    head = F.array_join(F.slice(F.split("text", " "), 1, 3), " ")
    entries = t("benchmark").select(head.alias("head"), "item_id").groupBy("head").agg(F.min("item_id").alias("item_id")).select(S.content_id("EN", F.col("head")).alias("id"), "head", "item_id")
    first = L.insert_absent(entries.limit(0), entries.where("item_id % 2 = 0"), "id")
    return L.insert_absent(first, entries, "id")


@query("z13_membership_upsert", """
WITH m AS (SELECT l_returnflag AS grp, l_partkey AS member, arg_max(l_discount, (l_orderkey, l_linenumber, l_suppkey, l_discount)) AS fit FROM lineitem GROUP BY 1, 2) SELECT grp, count(*) AS members, round(avg(fit), 8) AS fit FROM m GROUP BY 1""")
def _(t):
    rows = t("lineitem").select(F.col("l_returnflag").alias("grp"), F.col("l_partkey").alias("member"), F.col("l_discount").alias("fit"), F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_discount").alias("o"))
    return Y.upsert_members(rows, "grp", "member", "fit", "o").groupBy("grp").agg(F.count("*").alias("members"), F.round(F.avg("fit"), 8).alias("fit"))


@query("z15_authored_assertions", """
WITH g AS (SELECT l_partkey, l_suppkey, count(DISTINCT l_returnflag) AS sources FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_returnflag) >= 2)
SELECT 'AS' || left(sha256('=' || l_partkey || chr(31) || '=' || l_suppkey), 16) AS id, l_partkey, l_suppkey, 'affirm' AS polarity, 1 - pow(0.5, sources) AS confidence, sources FROM g WHERE l_partkey % 10 > 0""")
def _(t):
    ident = S.content_id("AS", F.col("l_partkey"), F.col("l_suppkey"))
    there = t("lineitem").where("l_partkey % 10 = 0").select(ident.alias("id")).distinct()
    return Y.author_assertions(t("lineitem"), ["l_partkey", "l_suppkey"], "l_returnflag", ident, 2, there)


@query("z16_derived_threshold", """
WITH x AS (SELECT l_shipmode AS m, round(l_quantity * (1 - l_discount), 0) AS s, l_returnflag <> 'R' AND l_quantity > 20 AS ok FROM (SELECT *, l_linestatus AS l_shipmode FROM lineitem)), b AS (SELECT m, s, count(*) AS n, count(*) FILTER (ok) AS a FROM x GROUP BY 1, 2),
r AS (SELECT m, s, sum(n) OVER w AS n, sum(a) OVER w AS a FROM b WINDOW w AS (PARTITION BY m ORDER BY s DESC ROWS UNBOUNDED PRECEDING))
SELECT m AS grp, min(s) AS threshold, round(arg_min(a / n, s), 8) AS precision, arg_min(a, s)::BIGINT AS accepted, arg_min(n, s)::BIGINT AS n FROM r WHERE a >= n * 0.65 GROUP BY 1""")
def _(t):
    v = t("lineitem").select(F.col("l_linestatus").alias("grp"), F.round(F.col("l_quantity") * (1 - F.col("l_discount")), 0).alias("s"), ((F.col("l_returnflag") != "R") & (F.col("l_quantity") > 20)).alias("ok"))
    return Y.derive_threshold(v, "grp", "s", F.col("ok"), 0.65).withColumn("precision", F.round("precision", 8))


@query("z18_open_cohort", """
WITH p AS (SELECT l_orderkey, max(l_linenumber) AS u FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_tax = 0) AND o_orderkey NOT IN (SELECT l_orderkey FROM p WHERE u > 4)""")
def _(t):
    """Orders that are neither done nor parked until later; what was parked until now is open again."""
    l = t("lineitem").withColumnRenamed("l_orderkey", "o_orderkey")  # noqa: E741
    return Y.open_cohort(t("orders").where("o_orderstatus <> 'F'").select("o_orderkey"), "o_orderkey", l.where("l_tax = 0"), l.where("l_returnflag = 'R'"), "l_linenumber", 4)


_SLICES = """s AS (SELECT hour(ts) AS slice, event_id, value < 20 AS bad FROM events), r AS (SELECT slice, count(*) AS n, count(*) FILTER (bad) AS bad, CASE WHEN count(*) FILTER (bad) > count(*) * 0.33 THEN 'failed' ELSE 'ok' END AS status FROM s GROUP BY 1)"""


def _slices(t):
    return Y.ingest_slices(t("events").select(F.hour("ts").alias("slice"), "event_id", "value"), "slice", F.col("value") < 20, 0.33)


@query("z20_slice_report", f"WITH {_SLICES} SELECT slice, n, bad, status FROM r UNION ALL SELECT NULL, sum(n)::BIGINT, sum(bad)::BIGINT, CASE WHEN count(*) FILTER (status = 'failed') > 0 THEN 'partial' ELSE 'ok' END FROM r")
def _(t):
    return _slices(t)[1]


@query("z20_slice_rows", f"WITH {_SLICES} SELECT slice, count(*) AS kept FROM s WHERE NOT bad AND slice IN (SELECT slice FROM r WHERE status = 'ok') GROUP BY 1")
def _(t):
    return _slices(t)[0].groupBy("slice").agg(F.count("*").alias("kept"))


@query("z21_record_upsert", """
WITH x AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS name, p_partkey AS k, p_brand AS brand FROM part) SELECT arg_min(name, k) AS name, max(k) AS k, arg_max(brand, k) AS brand FROM x GROUP BY lower(name)""")
def _(t):
    x = t("part").select(F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("name"), F.col("p_partkey").alias("k"), F.col("p_brand").alias("brand"))
    return Y.upsert_records(x.where("k < 100"), x.where("k >= 100"), "name", "k")


@query("t29_mention_grounding", """
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g') AS t, lag(coalesce(text, '')) OVER (ORDER BY doc_id) AS before FROM documents)
SELECT doc_id, contains(t, regexp_replace(left(before, 60), '\\s+', ' ', 'g')) AS grounded FROM d WHERE before IS NOT NULL""")
def _(t):
    """Whether each document holds the opening that the one before it quotes: a mention meets the one text that it names."""
    flat = lambda c: F.regexp_replace(c, r"\s+", " ")
    d = t("documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    quotes = d.select((F.col("doc_id") + 1).alias("doc_id"), flat(F.left("text", F.lit(60))).alias("quote"))
    return d.join(quotes, "doc_id").select("doc_id", F.contains(flat("text"), F.col("quote")).alias("grounded"))
