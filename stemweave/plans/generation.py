"""Queries for name generation, curation, enrichment and canonical lookup on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import curation as U
from ..operators import generation as N
from ..operators import text as T
from .registry import query

# ------------------------------------------------------------------------------ generation

_STRUCTURES = {"AUTOMOBILE": ["saint", "post"], "BUILDING": ["pre", "post"], "FURNITURE": ["pre", "saint"], "HOUSEHOLD": ["post"], "MACHINERY": ["pre", "inner", "post"]}
_U = "('0x' || left(md5('{seed}|' || {key}), 13))::BIGINT / 4503599627370496"


def _generation_sql() -> str:
    """The draws of ``w09`` in SQL, round by round."""
    rows = ", ".join(f"('{s}', {list(v)})" for s, v in _STRUCTURES.items())
    out = f"""sl AS (SELECT * FROM (VALUES {rows}) AS v(structure, slots)), s AS (SELECT structure, slots, count(*)::DOUBLE AS w FROM customer JOIN sl ON structure = c_mktsegment GROUP BY 1, 2),
words AS (SELECT o_orderpriority AS gate, CASE WHEN p_size = 50 THEN 'saint' WHEN p_size % 3 = 0 THEN 'pre' WHEN p_size % 3 = 1 THEN 'post' ELSE 'inner' END AS slot, p_name AS word, split_part(p_name, ' ', 1) AS tag
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey WHERE p_size < 50 OR o_orderpriority < '3'),
pool AS (SELECT gate, slot, word, min(tag) AS tag, count(*)::DOUBLE AS weight FROM words GROUP BY 1, 2, 3),
need AS (SELECT structure, unnest(list_distinct(slots)) AS slot, len(list_distinct(slots)) AS n FROM s), f AS (SELECT gate, structure FROM need JOIN (SELECT DISTINCT gate, slot FROM pool) USING (slot) GROUP BY 1, 2, n HAVING count(*) = n),
q AS (SELECT o_orderkey AS id, o_orderpriority AS gate FROM orders), p0 AS (SELECT id, gate, []::VARCHAR[] AS tried FROM q)"""
    for k in range(6):
        last = k == 5
        source = "(SELECT id, gate, []::VARCHAR[] AS tried FROM p5)" if last else f"p{k}"
        out += f""",
c{k} AS (SELECT p.id, p.gate, p.tried, s.structure, sum(s.w) OVER (PARTITION BY p.id ORDER BY s.structure) AS cum, sum(s.w) OVER (PARTITION BY p.id) AS total FROM {source} p JOIN s ON NOT list_contains(p.tried, s.structure)),
d{k} AS (SELECT id, gate, tried, min(structure) FILTER (cum > {_U.format(seed=9, key=f"id || '|{k}'")} * total) AS chosen FROM c{k} GROUP BY 1, 2, 3)"""
        if not last:
            out += f""",
p{k + 1} AS (SELECT id, gate, list_append(tried, chosen) AS tried FROM d{k} WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.gate = d{k}.gate AND f.structure = chosen))"""
    picks = " UNION ALL ".join([f"SELECT id, gate, chosen AS structure, false AS permissive FROM d{k} WHERE EXISTS (SELECT 1 FROM f WHERE f.gate = d{k}.gate AND f.structure = chosen)" for k in range(5)] + ["SELECT id, gate, chosen, true FROM d5"])
    out += f""",
picks AS ({picks}), s0 AS (SELECT id, gate, permissive, structure, slots, '' AS before, []::VARCHAR[] AS parts FROM picks JOIN sl USING (structure))"""
    for i in range(3):
        out += f""",
w{i} AS (SELECT x.id, l.word, l.tag, sum(l.weight * CASE WHEN l.tag = x.before THEN 2 ELSE 1 END) OVER (PARTITION BY x.id ORDER BY l.word) AS cum, sum(l.weight * CASE WHEN l.tag = x.before THEN 2 ELSE 1 END) OVER (PARTITION BY x.id) AS total
  FROM s{i} x JOIN pool l ON l.gate = x.gate AND l.slot = x.slots[{i + 1}]),
g{i} AS (SELECT id, arg_min(word, word) FILTER (cum > u * total) AS word, arg_min(tag, word) FILTER (cum > u * total) AS tag FROM (SELECT *, {_U.format(seed=21, key=f"id || '|{i}'")} AS u FROM w{i}) GROUP BY 1),
s{i + 1} AS (SELECT x.id, gate, permissive, structure, slots, coalesce(g.tag, before) AS before, CASE WHEN g.word IS NULL THEN parts ELSE list_append(parts, g.word) END AS parts FROM s{i} x LEFT JOIN g{i} g USING (id))"""
    return out + ", names AS (SELECT id, structure, permissive, array_to_string(parts, ' ') AS name FROM s3 WHERE len(parts) > 0)"


def _generated(t) -> tuple[DataFrame, DataFrame]:
    """Picks and names: a structure for each order from the mix of segments, filled with part names that orders of its priority use."""
    slots = F.create_map(*[x for s, v in _STRUCTURES.items() for x in (F.lit(s), F.array(*map(F.lit, v)))])
    s = t("customer").groupBy(F.col("c_mktsegment").alias("structure")).agg(F.count("*").alias("w")).withColumn("slots", F.try_element_at(slots, F.col("structure"))).where("slots is not null")
    kind = F.when(F.col("p_size") == 50, "saint").when(F.col("p_size") % 3 == 0, "pre").when(F.col("p_size") % 3 == 1, "post").otherwise("inner")
    j = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).where("p_size < 50 or o_orderpriority < '3'")
    words = j.select(F.col("o_orderpriority").alias("gate"), kind.alias("slot"), F.col("p_name").alias("word"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("tag"), F.lit(1).alias("weight"))
    pools = N.stored(N.slot_pools(words, "gate", "slot", "word", "tag", "weight"))
    full = N.stored(N.fillable(s, "structure", "slots", pools, "gate", "slot"))
    asks = t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("gate"))
    picks = N.stored(N.pick_structures(asks, "id", "gate", s, "structure", "w", full, 9).join(s.select("structure", "slots"), "structure"))
    return picks, N.fill_slots(picks, "id", "gate", "slots", pools, "slot", "word", "tag", "weight", 21)


@query("w09_structure_pick", f"WITH {_generation_sql()} SELECT id AS o_orderkey, structure, permissive FROM picks")
def _(t):
    """A structure per order, drawn by weight; one that the order's priority can't fill is excluded from the next draw."""
    return _generated(t)[0].select(F.col("id").alias("o_orderkey"), "structure", "permissive")


@query("w09_slot_filling", f"WITH {_generation_sql()} SELECT id AS o_orderkey, name FROM names")
def _(t):
    """The slots of the picked structures filled in turn; each pick leans the next one to its tag."""
    return _generated(t)[1].select(F.col("id").alias("o_orderkey"), F.array_join("parts", " ").alias("name"))


@query("z03_era_map", f"""
WITH {_generation_sql()}, n AS (SELECT DISTINCT name FROM names), e AS (SELECT * FROM (VALUES ('old', 10), ('middle', 25), ('modern', 60)) AS v(era, y)),
fm AS (SELECT DISTINCT ON (p_name, p_size) p_name AS name, p_size AS y0, p_brand AS form FROM part ORDER BY p_name, p_size, p_brand DESC)
SELECT n.name, e.era, coalesce(arg_max(form, y0), n.name) AS rendered, count(form) > 0 AS attested FROM n CROSS JOIN e LEFT JOIN fm ON fm.name = n.name AND fm.y0 <= e.y GROUP BY 1, 2""")
def _(t):
    """Generated names through three eras; names of one part have forms of their own by size, others stay as they are."""
    forms = t("part").groupBy("p_name", "p_size").agg(F.max("p_brand").alias("form"))
    names = _generated(t)[1].select(F.array_join("parts", " ").alias("name"))
    return N.era_map(names, "name", forms, "p_name", "p_size", "form", [("old", 10), ("middle", 25), ("modern", 60)])


@query("w12_request_composition", """
WITH e AS (SELECT * FROM (VALUES ('1-URGENT', 'harsh', 0.6), ('1-URGENT', 'grim', 0.5), ('2-HIGH', 'harsh', 0.7), ('2-HIGH', 'soft', -0.4), ('5-LOW', 'soft', 0.9)) AS v(mood, axis, w)),
m AS (SELECT DISTINCT o_custkey AS id, o_orderpriority AS mood FROM orders), k AS (SELECT id, axis, w FROM m JOIN e USING (mood) UNION ALL SELECT c_custkey, 'harsh', c_acctbal / 10000 FROM customer WHERE c_custkey IN (SELECT id FROM m))
SELECT id, axis, round(greatest(least(sum(w), 1), -1), 6) AS weight FROM k GROUP BY 1, 2 HAVING greatest(least(sum(w), 1), -1) <> 0""")
def _(t):
    """The priorities that a customer orders with as moods, and the balance as a knob of harshness."""
    o = t("orders").groupBy(F.col("o_custkey").alias("id")).agg(F.collect_set("o_orderpriority").alias("moods"))
    r = o.join(t("customer").select(F.col("c_custkey").alias("id"), "c_acctbal"), "id")
    effects = r.sparkSession.createDataFrame([("1-URGENT", "harsh", 0.6), ("1-URGENT", "grim", 0.5), ("2-HIGH", "harsh", 0.7), ("2-HIGH", "soft", -0.4), ("5-LOW", "soft", 0.9)], "mood string, axis string, weight double")
    out = N.compose_requests(r, "id", "moods", {"harsh": F.col("c_acctbal") / 10000}, effects)
    return out.withColumn("weight", F.round("weight", 6))


# ------------------------------------------------------------------------------ spelling and sound

_IPA = {"sm": "zm", "ng": "ŋ", "th": "θ", "gi": "ʤɪ", "g": "ɡ", "ar": "ɑː", "ea": "iː", "oo": "uː", "w": "ʋ", "r": "ɹ", "a": "æ", "o": "ɒ", "e": "ɛ", "i": "ɪ", "ll": "l"}
_RESPELL = {"ŋ": "ng", "ʤɪ": "ji", "ɡ": "g", "ɑː": "ah", "iː": "ee", "uː": "oo", "ʋ": "v", "ɹ": "r", "æ": "a", "ɒ": "o", "ɛ": "eh", "ɪ": "ih"}


def _mapped(source: str, table: dict[str, str], out: str, n: str) -> str:
    """SQL: longest match first along each word of the query ``source(word, x)``."""
    keys = ", ".join(f"('{k}', '{v}')" for k, v in table.items())
    return f"""t{n} AS (SELECT * FROM (VALUES {keys}) AS v(a, b)), q{n} AS ({source}), o{n} AS (SELECT word, x, unnest(range(1, length(x) + 1)) AS i FROM q{n}),
m{n} AS (SELECT word, i, coalesce(arg_max(b, length(a)), min(substr(x, i, 1))) AS b, coalesce(max(length(a)), 1) AS k FROM o{n} LEFT JOIN t{n} ON substr(x, i, length(a)) = a GROUP BY 1, 2),
r{n} AS (SELECT word, 1::BIGINT AS i, '' AS y FROM q{n} UNION ALL SELECT r.word, r.i + k, y || b FROM r{n} r JOIN m{n} m ON m.word = r.word AND m.i = r.i),
{out} AS (SELECT q.word, y AS x FROM r{n} r JOIN q{n} q ON q.word = r.word WHERE r.i = length(q.x) + 1)"""


@query("t27_spelling_to_sound", f"""
WITH RECURSIVE {_mapped("SELECT DISTINCT w AS word, w AS x FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS w FROM part)", _IPA, "ipa", "1")}, {_mapped("SELECT word, x FROM ipa", _RESPELL, "respelt", "2")}
SELECT ipa.word, ipa.x AS ipa, respelt.x AS respelling FROM ipa JOIN respelt ON respelt.word = ipa.word""")
def _(t):
    """Words to sounds by the longest graphemes first, and back to a plain respelling."""
    w = t("part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("word")).distinct()
    ipa = T.mapped(w, "word", _IPA, "ipa")
    return T.mapped(ipa, "ipa", _RESPELL, "respelling")


@query("a43_sound_coverage", f"""
WITH x AS (SELECT p_type AS language, p_name AS form, CASE WHEN p_size % 4 > 0 THEN p_brand END AS ipa, p_retailprice > 1200 AS bundled FROM part WHERE p_size <= 40)
SELECT language, count(*) AS eligible, count(ipa) AS lexicon, count(*) FILTER (bundled) AS bundle_eligible, count(ipa) FILTER (bundled) AS bundle, round(count(ipa) / count(*), 6) AS rate FROM x GROUP BY 1""")
def _(t):
    """Eligible words that have a pronunciation, in the lexicon and in the bundle, by language."""
    x = t("part").where("p_size <= 40").select(F.col("p_type").alias("language"), F.when(F.col("p_size") % 4 > 0, F.col("p_brand")).alias("ipa"), (F.col("p_retailprice") > 1200).alias("bundled"))
    return T.sound_coverage(x, "language", "ipa", F.col("bundled")).withColumn("rate", F.round("rate", 6))


# ------------------------------------------------------------------------------ canonical lookup

_TOPONYMS = """tp AS (SELECT s_suppkey AS id, 'Place' || s_suppkey % 20 AS name, CASE WHEN s_suppkey % 3 > 0 THEN n_name END AS region FROM supplier JOIN nation ON n_nationkey = s_nationkey),
dc AS (SELECT l_orderkey * 8 + l_linenumber AS id, l_suppkey AS place, l_returnflag || '+' || l_linenumber AS signature, l_returnflag AS source FROM lineitem WHERE l_linenumber = 7),
ak AS (SELECT c_custkey, 'Place' || c_custkey % 25 AS name, CASE WHEN c_custkey % 2 = 0 THEN n_name END AS region FROM customer JOIN nation ON n_nationkey = c_nationkey)"""


@query("t09_canonical_lookup", f"""
WITH {_TOPONYMS}, hit AS (SELECT c_custkey, ak.name, tp.id FROM ak LEFT JOIN tp ON tp.name = ak.name AND (ak.region IS NULL OR tp.region = ak.region OR tp.region IS NULL) QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY CASE WHEN ak.region IS NULL THEN 0 ELSE (tp.region IS NULL)::INT END, tp.id) = 1),
k AS (SELECT place, arg_min(signature, (id, signature, source)) AS signature, arg_min(source, (id, signature, source)) AS source FROM dc GROUP BY 1)
SELECT c_custkey, coalesce(signature, 'guess:' || lower(name)) AS signature, source FROM hit LEFT JOIN k ON k.place = hit.id""")
def _(t):
    """The scholarly decomposition of a place by name and region, else the matcher's own."""
    s = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("id"), F.concat(F.lit("Place"), F.col("s_suppkey") % 20).alias("name"), F.when(F.col("s_suppkey") % 3 > 0, F.col("n_name")).alias("region"))
    d = t("lineitem").where("l_linenumber = 7").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.col("l_suppkey").alias("place"), F.concat_ws("+", "l_returnflag", "l_linenumber").alias("signature"), F.col("l_returnflag").alias("source"))
    asks = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.concat(F.lit("Place"), F.col("c_custkey") % 25).alias("name"), F.when(F.col("c_custkey") % 2 == 0, F.col("n_name")).alias("region"))
    guess = F.concat(F.lit("guess:"), F.lower("name"))
    return T.canonical_lookup(asks, "name", "region", s, d, guess).select("c_custkey", "signature", "source")


# ------------------------------------------------------------------------------ curation and enrichment

_CURATED = """n AS (SELECT c_custkey AS id, c_mktsegment AS label FROM customer), e AS (SELECT o_custkey AS node, o_orderkey AS child, o_orderpriority AS v FROM orders),
act AS (SELECT c_custkey AS ref, CASE c_custkey % 10 WHEN 1 THEN 'set' WHEN 2 THEN 'fold' WHEN 3 THEN 'split' WHEN 4 THEN 'drop' END AS kind FROM customer WHERE c_custkey % 10 BETWEEN 1 AND 4 UNION ALL SELECT 1000000000 + s_suppkey, 'set' FROM supplier)"""


def _curation(t):
    n = t("customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("label"))
    e = t("orders").select(F.col("o_custkey").alias("node"), F.col("o_orderkey").alias("child"), F.col("o_orderpriority").alias("v"))
    k = F.col("c_custkey") % 10
    kind = F.when(k == 1, "set").when(k == 2, "fold").when(k == 3, "split").when(k == 4, "drop")
    # a set gives a label, a fold goes into the node before, a split puts urgent orders on a new node, a drop takes low ones off
    value = F.when(k == 1, F.lit("CURATED")).when(k == 3, F.lit("1-URGENT")).when(k == 4, F.lit("5-LOW"))
    to = F.when(k == 2, F.col("c_custkey") - 1).when(k == 3, F.col("c_custkey") + 500_000_000)
    a = t("customer").where(k.between(1, 4)).select(F.col("c_custkey").alias("ref"), kind.alias("kind"), value.alias("value"), to.alias("to"))
    a = a.unionByName(t("supplier").select((1_000_000_000 + F.col("s_suppkey")).alias("ref"), F.lit("set").alias("kind"), F.lit("CURATED").alias("value"), F.lit(None).cast("long").alias("to")))
    return U.apply_curation(n, "id", "label", e, "node", "v", a)


@query("l06_curation_nodes", f"""
WITH {_CURATED} SELECT n.id, CASE WHEN kind = 'set' THEN 'CURATED' ELSE label END AS label FROM n LEFT JOIN act ON ref = n.id WHERE kind IS DISTINCT FROM 'fold' UNION ALL SELECT id + 500000000, label FROM n JOIN act ON ref = n.id AND kind = 'split'""")
def _(t):
    return _curation(t)["nodes"]


@query("l06_curation_children", f"""
WITH {_CURATED} SELECT CASE WHEN kind = 'fold' THEN node - 1 WHEN kind = 'split' AND v = '1-URGENT' THEN node + 500000000 ELSE node END AS node, child, v FROM e LEFT JOIN act ON ref = node WHERE NOT coalesce(kind = 'drop' AND v = '5-LOW', false)""")
def _(t):
    return _curation(t)["children"]


@query("l06_unresolved_refs", f"WITH {_CURATED} SELECT kind, count(*) FILTER (ref IN (SELECT id FROM n)) AS applied, count(*) FILTER (ref NOT IN (SELECT id FROM n)) AS unresolved FROM act GROUP BY 1")
def _(t):
    return _curation(t)["counts"]


_FOLDS = """n AS (SELECT c_custkey AS id FROM customer), a AS (SELECT id, CASE WHEN id % 10 = 6 THEN id - 1 WHEN id % 20 = 5 THEN id + 1000000000 WHEN id % 10 = 5 THEN id - 1 WHEN id % 10 = 7 THEN id + 1 WHEN id % 10 = 8 THEN id - 1 WHEN id % 10 = 9 THEN id - 1 END AS to_ FROM n WHERE id % 10 BETWEEN 5 AND 9),
g AS (SELECT id, CASE WHEN id % 10 = 6 THEN CASE WHEN id % 20 = 6 THEN id - 1 ELSE id - 2 END WHEN id % 20 = 15 THEN id - 1 WHEN id % 10 = 9 THEN id - 1 WHEN id % 10 = 7 AND id + 1 > (SELECT max(id) FROM n) THEN NULL END AS into_ FROM a)"""


def _folded(t):
    n = t("customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("label"))
    e = t("orders").select(F.col("o_custkey").alias("node"), F.col("o_orderkey").alias("child"), F.col("o_orderpriority").alias("v"))
    k, c = F.col("c_custkey") % 10, F.col("c_custkey")
    to = F.when(k == 6, c - 1).when(c % 20 == 5, c + 1_000_000_000).when(k == 5, c - 1).when(k == 7, c + 1).when(k >= 8, c - 1)
    a = t("customer").where(k.between(5, 9)).select(c.alias("ref"), F.lit("fold").alias("kind"), F.lit(None).cast("string").alias("value"), to.alias("to"))
    return U.apply_curation(n, "id", "label", e, "node", "v", a)


@query("l06_fold_chains", f"WITH {_FOLDS} SELECT coalesce(into_, o_custkey) AS node, o_orderkey AS child FROM orders LEFT JOIN g ON g.id = o_custkey")
def _(t):
    """Folds into nodes that are folded themselves, that aren't there, or in a circle."""
    return _folded(t)["children"].select("node", "child")


@query("l06_fold_counts", f"WITH {_FOLDS} SELECT 'fold' AS kind, count(*) FILTER (into_ IS NOT NULL) AS applied, count(*) FILTER (into_ IS NULL) AS unresolved FROM g")
def _(t):
    return _folded(t)["counts"]


_CHAIN = """x AS (SELECT c_custkey AS id, c_mktsegment AS lang, 'N-' || c_custkey % 40 AS form FROM customer), f AS (SELECT id, lang, form, min(id) OVER (PARTITION BY lang, regexp_replace(lower(form), '[^a-z0-9]+', '', 'g')) AS winner FROM x),
r AS (SELECT *, CASE WHEN winner <> id THEN winner END AS merged_into FROM f), c AS (SELECT lang, winner, count(*) AS members FROM r GROUP BY 1, 2)"""


@query("l08_enrichment_chain", f"WITH {_CHAIN} SELECT id, merged_into, members, CASE WHEN members >= 3 THEN 'common' ELSE 'rare' END AS rank FROM r JOIN c USING (lang, winner)")
def _(t):
    """Variants are folded, witnesses counted on what is left, and ranks given by the counts, in the order that each step needs."""
    return _enriched(t).select("id", "merged_into", "members", "rank")


def _steps() -> list:
    folded = F.regexp_replace(F.lower("form"), "[^a-z0-9]+", "")
    win = lambda df: F.min("id").over(Window.partitionBy("lang", folded))
    return [
        U.Step("fold", [], ["winner", "merged_into"], lambda df: df.withColumn("winner", win(df)).withColumn("merged_into", F.when(F.col("winner") != F.col("id"), F.col("winner")))),
        U.Step("count", ["fold"], ["members"], lambda df: df.withColumn("members", F.count("*").over(Window.partitionBy("lang", "winner")))),
        U.Step("rank", ["count"], ["rank"], lambda df: df.withColumn("rank", F.when(F.col("members") >= 3, "common").otherwise("rare"))),
    ]


def _enriched(t) -> DataFrame:
    x = t("customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("lang"), F.concat(F.lit("N-"), F.col("c_custkey") % 40).alias("form"))
    return U.enrich(x, _steps())


@query("k14_stage_drop", f"WITH {_CHAIN} SELECT id, lang, form, merged_into FROM r")
def _(t):
    """What a stage and all stages behind it derived is dropped; what was there before it stays."""
    return U.reset(_enriched(t), _steps(), "count").select("id", "lang", "form", "merged_into")


@query("z11_modern_reflexes", """
WITH w AS (SELECT DISTINCT 'oe' AS lang, split_part(p_name, ' ', 1) AS form, NULL AS gloss FROM part), r AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS old, split_part(p_name, ' ', 2) AS modern, 'like ' || split_part(p_name, ' ', 2) AS gloss FROM part UNION ALL SELECT 'nowhere', 'x', 'y')
SELECT 'word' AS kind, lang AS a, form AS b, gloss AS c FROM w UNION ALL SELECT DISTINCT 'word', 'en', modern, gloss FROM r WHERE old IN (SELECT form FROM w) UNION ALL SELECT 'edge', 'oe:' || old, 'en:' || modern, 'inheritance' FROM r WHERE old IN (SELECT form FROM w) UNION ALL SELECT 'count', 'parent_missing', '1', NULL""")
def _(t):
    w = F.split("p_name", " ")
    words = t("part").select(F.lit("oe").alias("lang"), w[0].alias("form"), F.lit(None).cast("string").alias("gloss")).distinct()
    rows = t("part").select(F.lit("oe").alias("old_lang"), w[0].alias("old"), F.lit("en").alias("lang"), w[1].alias("form"), F.concat(F.lit("like "), w[1]).alias("gloss")).distinct()
    rows = rows.unionByName(rows.sparkSession.createDataFrame([("oe", "nowhere", "en", "x", "y")], rows.schema))
    out = U.import_reflexes(words, rows)
    flat = lambda df, kind, *c: df.select(F.lit(kind).alias("kind"), *[(F.col(x) if x else F.lit(None)).cast("string").alias(n) for x, n in zip(c, "abc")])
    return flat(out["words"], "word", "lang", "form", "gloss").unionByName(flat(out["edges"], "edge", "parent", "child", "edge_type")).unionByName(flat(out["counts"], "count", "outcome", "n", None))


_FAMILY = """n AS (SELECT s_suppkey AS id, CASE WHEN s_nationkey < 5 THEN 'welsh' WHEN s_nationkey < 8 THEN 'middle-welsh' WHEN s_nationkey < 12 THEN 'latin' WHEN s_nationkey < 16 THEN 'old-irish' WHEN s_nationkey < 20 THEN 'french' ELSE 'frankish' END AS lang FROM supplier),
e AS (SELECT DISTINCT l_suppkey AS child, l_partkey % (SELECT count(*) FROM supplier) AS parent FROM lineitem WHERE l_partkey % (SELECT count(*) FROM supplier) < l_suppkey)"""


@query("z14_family_strata", f"""
WITH RECURSIVE {_FAMILY}, a AS (SELECT child AS id, parent AS node FROM e UNION SELECT a.id, e.parent FROM a JOIN e ON e.child = a.node), l AS (SELECT a.id, list(DISTINCT n.lang) AS langs FROM a JOIN n ON n.id = a.node GROUP BY 1)
SELECT 'welsh' AS family, n.id, CASE WHEN lang = 'middle-welsh' THEN 'medieval' WHEN list_contains(coalesce(langs, []), 'latin') THEN 'latin-loan' WHEN list_contains(coalesce(langs, []), 'old-irish') THEN 'irish-loan' ELSE 'native' END AS stratum FROM n LEFT JOIN l USING (id) WHERE lang IN ('welsh', 'middle-welsh')
UNION ALL SELECT 'french', n.id, CASE WHEN lang = 'frankish' THEN 'substrate' WHEN list_contains(coalesce(langs, []), 'frankish') THEN 'frankish-loan' ELSE 'romance' END FROM n LEFT JOIN l USING (id) WHERE lang IN ('french', 'frankish')""")
def _(t):
    """One classifier, two families: a word's own language settles it, else the first stratum that its ancestors name."""
    k = F.col("s_nationkey")
    lang = F.when(k < 5, "welsh").when(k < 8, "middle-welsh").when(k < 12, "latin").when(k < 16, "old-irish").when(k < 20, "french").otherwise("frankish")
    n = t("supplier").select(F.col("s_suppkey").alias("id"), lang.alias("lang"))
    size = t("supplier").count()
    e = t("lineitem").select(F.col("l_suppkey").alias("child"), (F.col("l_partkey") % size).alias("parent")).where("parent < child").distinct()
    families = [
        U.Family("welsh", "welsh", [("latin-loan", ["latin"]), ("irish-loan", ["old-irish"])], {"middle-welsh": "medieval"}, "native"),
        U.Family("french", "french", [("frankish-loan", ["frankish"])], {"frankish": "substrate"}, "romance"),
    ]
    return U.classify_families(n, "id", "lang", e, "parent", "child", families)
