"""Queries of identity: roll-ups to the oldest root and the hub, components that keep kinds apart, projected statements, bucket mates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import identity as I
from ..operators.mates import bucket_mates
from .registry import query

_NODES = """n AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 11 = 0 THEN p_partkey - 1 END AS merged, CASE WHEN p_partkey % 5 = 0 THEN p_partkey - 2 END AS lemma, p_brand AS lang, p_name AS form, p_partkey % 50 AS k FROM part),
ed AS (SELECT id AS child, CASE WHEN k <= 12 THEN id - k + (k - 9) % 3 + 10 ELSE id - 1 END AS parent FROM n WHERE k >= 10 AND k <> 31 UNION SELECT id, id - 3 FROM n WHERE k > 34 AND k % 6 = 1),
tg AS (SELECT id, coalesce(merged, lemma, id) AS t FROM n), lr AS (SELECT tg.id, coalesce(n.lemma, t) AS root FROM tg LEFT JOIN n ON n.id = t),
up AS (SELECT c.root AS id, arg_min(p.root, (n.lang, n.form, p.root)) AS up FROM ed JOIN lr c ON c.id = child JOIN lr p ON p.id = parent JOIN n ON n.id = p.root WHERE c.root <> p.root GROUP BY 1),
w AS (SELECT DISTINCT root AS id, root AS cur, [root] AS seen FROM lr UNION ALL SELECT w.id, up.up, list_append(seen, up.up) FROM w JOIN up ON up.id = w.cur WHERE NOT list_contains(seen, up.up)),
top AS (SELECT id, arg_max(cur, len(seen)) AS top FROM w GROUP BY 1), old AS (SELECT lr.id, top AS root FROM lr JOIN top ON top.id = lr.root)"""


def _nodes(t):
    p, k = t("part"), F.col("p_partkey") % 50
    n = p.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 11 == 0, F.col("p_partkey") - 1).alias("merged"), F.when(F.col("p_partkey") % 5 == 0, F.col("p_partkey") - 2).alias("lemma"), F.col("p_brand").alias("lang"), F.col("p_name").alias("form"), k.alias("k"))
    a = n.where("k >= 10 and k <> 31").select(F.col("id").alias("child"), F.when(F.col("k") <= 12, F.col("id") - F.col("k") + (F.col("k") - 9) % 3 + 10).otherwise(F.col("id") - 1).alias("parent"))
    return n.drop("k"), a.union(n.where("k > 34 and k % 6 = 1").select("id", F.col("id") - 3))


@query("g01_oldest_roots", f"WITH RECURSIVE {_NODES} SELECT * FROM old")
def _(t):
    """Merges, lemmas and curated ancestry up to the oldest entry; some ancestors run in a circle of three."""
    n, edges = _nodes(t)
    return I.oldest_roots(n, "id", "merged", "lemma", ["lang", "form"], edges, "parent", "child")


@query("g02_hub_roots", f"""WITH RECURSIVE {_NODES}, hb AS (SELECT DISTINCT p_partkey % 40 AS h, CASE WHEN h BETWEEN 1 AND 3 THEN h % 3 + 1 WHEN h >= 10 THEN h // 2 END AS m FROM part),
hw AS (SELECT h, h AS cur, []::BIGINT[] AS seen FROM hb UNION ALL SELECT hw.h, m, list_append(seen, cur) FROM hw JOIN hb ON hb.h = cur WHERE m IS NOT NULL AND NOT list_contains(seen, cur)), hr AS (SELECT h, arg_max(cur, len(seen)) AS hub FROM hw GROUP BY 1),
bd AS (SELECT p_partkey AS id, hub FROM part JOIN hr ON h = p_partkey % 40 WHERE p_size < 25), fa AS (SELECT old.id, root, CASE WHEN hub IS NULL THEN 'r' || root ELSE 'h' || hub END AS f FROM old LEFT JOIN bd ON bd.id = old.id),
rp AS (SELECT f, arg_min(root, (coalesce(lang, ''), coalesce(form, ''), root)) AS root FROM fa LEFT JOIN n ON n.id = fa.root GROUP BY 1)
SELECT fa.id, rp.root FROM fa JOIN rp USING (f)""")
def _(t):
    """Entries bound to hubs, which chains and a circle of hubs lead to the surviving one; the others keep their oldest root."""
    n, edges = _nodes(t)
    old = I.oldest_roots(n, "id", "merged", "lemma", ["lang", "form"], edges, "parent", "child")
    h = t("part").select((F.col("p_partkey") % 40).alias("h")).distinct()
    hubs = h.select(F.col("h").cast("string").alias("id"), F.when(F.col("h").between(1, 3), F.col("h") % 3 + 1).when(F.col("h") >= 10, F.floor(F.col("h") / 2)).cast("string").alias("merged_into"))
    bound = t("part").where("p_size < 25").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 40).cast("string").alias("hub"))
    return I.hub_roots(old, "id", "root", n, ["lang", "form"], bound, hubs)


_MERGES = """n AS (SELECT c_custkey AS node, c_mktsegment AS kind FROM customer), m AS (SELECT o_orderkey, o_custkey AS a, o_orderkey % 2500 AS b FROM orders WHERE o_orderpriority < '3'),
j AS (SELECT o_orderkey, m.a, m.b, CASE WHEN x.kind IS NULL OR y.kind IS NULL THEN 'unknown' WHEN x.kind <> y.kind THEN 'crosses' END AS reason FROM m LEFT JOIN n x ON x.node = m.a LEFT JOIN n y ON y.node = m.b)"""


def _merges(t):
    return t("customer").selectExpr("c_custkey as node", "c_mktsegment as kind"), t("orders").where("o_orderpriority < '3'").select(F.col("o_custkey").alias("a"), (F.col("o_orderkey") % 2500).alias("b"))


@query("g06_guarded_components", f"""WITH RECURSIVE {_MERGES}, e AS (SELECT a, b FROM j WHERE reason IS NULL UNION SELECT b, a FROM j WHERE reason IS NULL), r AS (SELECT node, node AS to_ FROM n UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.to_)
SELECT n.node, kind, min(to_) AS root FROM r JOIN n ON n.node = r.node GROUP BY 1, 2""")
def _(t):
    """Customers that orders tie together, where both are of one segment."""
    return I.guarded_components(*_merges(t)[:1], "node", "kind", _merges(t)[1], "a", "b")[0]


@query("g06_skipped_merges", f"WITH {_MERGES} SELECT a, b, reason, count(*) AS n FROM j WHERE reason IS NOT NULL GROUP BY ALL")
def _(t):
    """The ties that cross segments or name no customer."""
    return I.guarded_components(*_merges(t)[:1], "node", "kind", _merges(t)[1], "a", "b")[1].groupBy("a", "b", "reason").agg(F.count("*").alias("n"))


_STATED = """st AS (SELECT event_id AS id, event_id % 60 AS j, CASE event_type WHEN 'signup' THEN 'mint' WHEN 'view' THEN 'merge' WHEN 'purchase' THEN 'label' ELSE 'bind' END AS predicate, CASE WHEN event_type = 'error' THEN 'refute' ELSE 'affirm' END AS polarity, value / 100 AS score, user_id, event_type, event_id, value FROM events),
s AS (SELECT id, predicate, polarity, score, CASE WHEN predicate = 'bind' THEN CASE WHEN event_id % 10 = 0 THEN 'other' WHEN event_id % 2 = 0 THEN 'word' ELSE 'town' END WHEN (CASE WHEN predicate = 'label' THEN event_id % 64 ELSE j END) % 2 = 0 THEN 'morph' ELSE 'place' END AS kind,
  CASE predicate WHEN 'bind' THEN 'o' || user_id WHEN 'label' THEN 'n' || event_id % 64 ELSE 'n' || j END AS ref,
  CASE WHEN predicate = 'bind' THEN 'n' || (user_id * 2 + event_id % 2 + CASE WHEN event_id % 25 < 2 THEN 2 ELSE 0 END) % 70 WHEN predicate = 'merge' AND j < 20 THEN 'n' || j * 7 % 60 WHEN predicate = 'merge' AND j < 26 THEN 'n' || (j + 1) WHEN predicate = 'merge' AND j < 31 THEN 'n' || (j + 60) WHEN predicate = 'merge' THEN 'n' || j END AS object,
  CASE WHEN predicate = 'label' THEN 's' || event_id % 3 END AS stratum, CASE WHEN predicate = 'label' THEN 'v' || event_id END AS value FROM st),
mi AS (SELECT DISTINCT kind, ref AS node FROM s WHERE predicate = 'mint'),
mg AS (SELECT ref AS a, object AS b, CASE WHEN x.kind IS NULL OR y.kind IS NULL THEN 'unknown' WHEN x.kind <> y.kind THEN 'crosses' END AS reason FROM s LEFT JOIN mi x ON x.node = ref LEFT JOIN mi y ON y.node = object WHERE predicate = 'merge'),
e AS (SELECT a, b FROM mg WHERE reason IS NULL UNION SELECT b, a FROM mg WHERE reason IS NULL), r AS (SELECT node, node AS to_ FROM mi UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.to_), ro AS (SELECT node, min(to_) AS root FROM r GROUP BY 1),
rf AS (SELECT DISTINCT kind, ref, object FROM s WHERE predicate = 'bind' AND polarity = 'refute'),
bj AS (SELECT s.*, CASE WHEN s.kind = 'other' THEN 'no target' WHEN rf.ref IS NOT NULL THEN 'refuted' WHEN score < 0.2 THEN 'below gate' WHEN mi.node IS NULL THEN 'bind to no node' END AS reason FROM s LEFT JOIN rf ON rf.kind = s.kind AND rf.ref = s.ref AND rf.object = s.object LEFT JOIN mi ON mi.node = s.object AND mi.kind = CASE s.kind WHEN 'word' THEN 'morph' WHEN 'town' THEN 'place' END WHERE predicate = 'bind' AND polarity = 'affirm'),
b AS (SELECT kind, ref, count(DISTINCT root) AS n, string_agg(DISTINCT root, ',' ORDER BY root) AS roots, arg_min(object, (-score, id, object)) AS node FROM bj JOIN ro ON ro.node = object WHERE reason IS NULL GROUP BY 1, 2)"""


def _projected(t):
    e, j, what = t("events"), F.col("event_id") % 60, F.col("event_type")
    predicate = F.when(what == "signup", "mint").when(what == "view", "merge").when(what == "purchase", "label").otherwise("bind")
    at = F.when(F.col("predicate") == "label", F.col("event_id") % 64).otherwise(F.col("j"))
    n = lambda c: F.concat(F.lit("n"), c.cast("string"))
    e = e.withColumn("j", j).withColumn("predicate", predicate)
    kind = F.when(F.col("predicate") == "bind", F.when(F.col("event_id") % 10 == 0, "other").when(F.col("event_id") % 2 == 0, "word").otherwise("town")).when(at % 2 == 0, "morph").otherwise("place")
    ref = F.when(F.col("predicate") == "bind", F.concat(F.lit("o"), F.col("user_id").cast("string"))).otherwise(n(at))
    bound = n((F.col("user_id") * 2 + F.col("event_id") % 2 + F.when(F.col("event_id") % 25 < 2, 2).otherwise(0)) % 70)
    merged = F.when(F.col("j") < 20, n(F.col("j") * 7 % 60)).when(F.col("j") < 26, n(F.col("j") + 1)).when(F.col("j") < 31, n(F.col("j") + 60)).otherwise(n(F.col("j")))
    s = e.select(
        F.col("event_id").alias("id"), "predicate", F.when(what == "error", "refute").otherwise("affirm").alias("polarity"), kind.alias("kind"), ref.alias("ref"),
        F.when(F.col("predicate") == "bind", bound).when(F.col("predicate") == "merge", merged).alias("object"), (F.col("value") / 100).alias("score"),
        F.when(F.col("predicate") == "label", F.concat(F.lit("s"), (F.col("event_id") % 3).cast("string"))).alias("stratum"), F.when(F.col("predicate") == "label", F.concat(F.lit("v"), F.col("event_id").cast("string"))).alias("value"),
    )
    return I.project_identity(s, {"word": "morph", "town": "place"}, 0.2)


@query("g14_projected_nodes", f"WITH RECURSIVE {_STATED} SELECT kind, mi.node, nullif(root, mi.node) AS merged_into FROM mi JOIN ro ON ro.node = mi.node")
def _(t):
    return _projected(t)["nodes"]


@query("g14_projected_binds", f"WITH RECURSIVE {_STATED} SELECT kind, ref, CASE WHEN n = 1 THEN node END AS node, CASE WHEN n > 1 THEN roots END AS conflict FROM b")
def _(t):
    """Observations with the node they are bound to, or the roots that their binds disagree on."""
    out = _projected(t)
    return out["bound"].withColumn("conflict", F.lit(None).cast("string")).unionByName(out["conflicts"].select("kind", "ref", F.lit(None).cast("string").alias("node"), F.array_join("roots", ",").alias("conflict")))


@query("g14_projected_labels", f"WITH RECURSIVE {_STATED} SELECT s.kind, node, coalesce(stratum, '') AS stratum, arg_min(value, (-score, id)) AS value, arg_min(id, (-score, id)) AS id FROM s JOIN mi ON mi.kind = s.kind AND mi.node = s.ref WHERE predicate = 'label' GROUP BY ALL")
def _(t):
    return _projected(t)["labels"]


@query("g14_skipped_statements", f"""WITH RECURSIVE {_STATED}, z AS (SELECT 'merge ' || reason AS reason FROM mg UNION ALL SELECT reason FROM bj UNION ALL SELECT 'label of no node' FROM s ANTI JOIN mi ON mi.kind = s.kind AND mi.node = s.ref WHERE predicate = 'label')
SELECT reason, count(*) AS n FROM z WHERE reason IS NOT NULL GROUP BY 1""")
def _(t):
    return _projected(t)["skipped"]


@query("t31_bucket_mates", """
WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), p AS (SELECT a.vec_id, a.label, list_cosine_similarity(a.v, b.v) AS c FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id)
SELECT vec_id, label, count(*) AS mates, round(min(c), 5) AS least, round(avg(c), 5) AS mean, round(max(c), 5) AS greatest FROM p GROUP BY 1, 2""")
def _(t):
    """Least, mean and greatest similarity of each vector to all others of its label, the most suspect first."""
    out = bucket_mates(t("embeddings"), "vec_id", "label", "embedding", 32)
    rounded = lambda c: F.when((F.col(c) < 0) & (F.round(c, 5) == 0), F.lit(-0.0)).otherwise(F.round(c, 5))  # noqa: E731  # SQL keeps the sign of a zero
    return out.select("vec_id", "label", "mates", *[rounded(c).alias(c) for c in ("least", "mean", "greatest")]).orderBy("mean", "vec_id")
