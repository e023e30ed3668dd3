"""Queries of reserved slots, repeats within a name and rendered names."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import generation as N
from .registry import query

_U = "('0x' || left(md5('{seed}|' || {key}), 13))::BIGINT / 4503599627370496"
_POOL = """words AS (SELECT o_orderpriority AS gate, CASE WHEN p_size = 50 THEN 'saint' WHEN p_size % 3 = 0 THEN 'pre' WHEN p_size % 3 = 1 THEN 'post' ELSE 'inner' END AS slot, p_name AS word, split_part(p_name, ' ', 1) AS tag
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey WHERE p_size < 50 OR o_orderpriority < '3'), pool AS (SELECT gate, slot, word, min(tag) AS tag, count(*)::DOUBLE AS weight FROM words WHERE slot <> 'inner' OR tag <> 'old' GROUP BY 1, 2, 3)"""
_ASKS = """q AS (SELECT o_orderkey AS id, o_orderpriority AS gate, CASE o_orderkey % 4 WHEN 0 THEN ['pre', 'post'] WHEN 1 THEN ['post'] WHEN 2 THEN ['pre', 'inner', 'post'] ELSE ['saint', 'inner'] END AS slots,
  CASE o_orderkey % 5 WHEN 0 THEN 'hot' WHEN 1 THEN 'old' WHEN 2 THEN 'nowhere' END AS tag, CASE o_custkey % 4 WHEN 0 THEN [] WHEN 1 THEN [{'tag': 'cold', 'weight': 0.5}, {'tag': 'new', 'weight': 2.0}] WHEN 2 THEN [{'tag': 'nowhere', 'weight': 1.0}] ELSE [{'tag': 'hot', 'weight': 1.0}] END AS moods FROM orders),
ix AS (SELECT id, gate, tag, moods, unnest(slots) AS slot, unnest(range(len(slots))) AS i FROM q),
ct AS (SELECT id, list(DISTINCT i ORDER BY i) AS can FROM ix SEMI JOIN pool ON pool.gate = ix.gate AND pool.slot = ix.slot AND pool.tag = ix.tag GROUP BY 1),
cm AS (SELECT id, list(DISTINCT i ORDER BY i) AS can FROM (SELECT id, gate, slot, i, unnest(moods).tag AS m FROM ix) x SEMI JOIN pool ON pool.gate = x.gate AND pool.slot = x.slot AND pool.tag = x.m GROUP BY 1),
rm AS (SELECT q.*, ct.can AS tc, CASE WHEN cm.can IS NOT NULL THEN cm.can[1 + CAST(floor((""" + _U.format(seed=5, key="q.id || '|mood'") + """) * len(cm.can)) AS INTEGER)] END AS mood_slot FROM q LEFT JOIN ct ON ct.id = q.id LEFT JOIN cm ON cm.id = q.id),
rf AS (SELECT *, CASE WHEN len(list_filter(tc, lambda x: mood_slot IS NULL OR x <> mood_slot)) > 0 THEN list_filter(tc, lambda x: mood_slot IS NULL OR x <> mood_slot) ELSE tc END AS free FROM rm),
rs AS (SELECT id, gate, slots, tag, moods, mood_slot, CASE WHEN tag IS NOT NULL AND free IS NOT NULL THEN free[1 + CAST(floor((""" + _U.format(seed=5, key="id || '|tag'") + """) * len(free)) AS INTEGER)] END AS tag_slot FROM rf), re AS (SELECT *, tag IS NOT NULL AND tag_slot IS NULL AS failed FROM rs)"""


def _filled() -> str:
    out = "s0 AS (SELECT id, gate, slots, tag, moods, mood_slot, tag_slot, '' AS before, []::VARCHAR[] AS parts FROM re WHERE NOT failed)"
    for i in range(3):
        u, u2 = _U.format(seed=7, key=f"id || '|{i}'"), _U.format(seed=7, key=f"id || '|{i}|word'")
        out += f""",
k{i} AS (SELECT *, CASE WHEN tag_slot = {i} THEN 'tag' WHEN mood_slot = {i} THEN 'mood' ELSE 'plain' END AS how FROM s{i}),
y{i} AS (SELECT id, min(t) FILTER (cum > {u} * total) AS t FROM (SELECT id, t, sum(sh) OVER (PARTITION BY id ORDER BY t) AS cum, sum(sh) OVER (PARTITION BY id) AS total FROM (
  SELECT k.id, m.tag AS t, m.weight * sum(pool.weight) * CASE WHEN m.tag = any_value(k.before) THEN 2 ELSE 1 END AS sh FROM (SELECT id, gate, slots, before, unnest(moods) AS m FROM k{i} WHERE how = 'mood') k JOIN pool ON pool.gate = k.gate AND pool.slot = k.slots[{i + 1}] AND pool.tag = m.tag GROUP BY k.id, m.tag, m.weight)) GROUP BY id),
w{i} AS (SELECT x.id, l.word, l.tag, how, CASE WHEN how = 'plain' AND l.tag = x.before THEN 2 ELSE 1 END * l.weight AS sh FROM k{i} x LEFT JOIN y{i} y ON y.id = x.id JOIN pool l ON l.gate = x.gate AND l.slot = x.slots[{i + 1}] AND CASE how WHEN 'tag' THEN l.tag = x.tag WHEN 'mood' THEN l.tag = y.t ELSE true END),
g{i} AS (SELECT id, arg_min(word, word) FILTER (cum > u * total) AS word, arg_min(tag, word) FILTER (cum > u * total) AS tag FROM (SELECT *, sum(sh) OVER (PARTITION BY id ORDER BY word) AS cum, sum(sh) OVER (PARTITION BY id) AS total, CASE WHEN how = 'mood' THEN {u2} ELSE {u} END AS u FROM w{i}) GROUP BY 1),
s{i + 1} AS (SELECT x.* EXCLUDE (before, parts), coalesce(g.tag, before) AS before, CASE WHEN g.word IS NULL THEN parts ELSE list_append(parts, g.word) END AS parts FROM s{i} x LEFT JOIN g{i} g USING (id))"""
    return out


def _reserved(t):
    kind = F.when(F.col("p_size") == 50, "saint").when(F.col("p_size") % 3 == 0, "pre").when(F.col("p_size") % 3 == 1, "post").otherwise("inner")
    j = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).where("p_size < 50 or o_orderpriority < '3'")
    words = j.select(F.col("o_orderpriority").alias("gate"), kind.alias("slot"), F.col("p_name").alias("word"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("tag"), F.lit(1).alias("weight")).where("slot <> 'inner' or tag <> 'old'")
    pools = N.stored(N.slot_pools(words, "gate", "slot", "word", "tag", "weight"))
    arr = lambda *x: F.array(*map(F.lit, x))
    mood = lambda *x: F.array(*[F.struct(F.lit(a).alias("tag"), F.lit(w).alias("weight")) for a, w in x])
    k, c = F.col("o_orderkey"), F.col("o_custkey") % 4
    q = t("orders").select(
        k.alias("id"), F.col("o_orderpriority").alias("gate"), F.when(k % 4 == 0, arr("pre", "post")).when(k % 4 == 1, arr("post")).when(k % 4 == 2, arr("pre", "inner", "post")).otherwise(arr("saint", "inner")).alias("slots"),
        F.when(k % 5 == 0, "hot").when(k % 5 == 1, "old").when(k % 5 == 2, "nowhere").alias("tag"),
        F.when(c == 0, F.array().cast("array<struct<tag:string,weight:double>>")).when(c == 1, mood(("cold", 0.5), ("new", 2.0))).when(c == 2, mood(("nowhere", 1.0))).otherwise(mood(("hot", 1.0))).alias("moods"),
    )
    return N.stored(N.reserve_slots(q, "id", "gate", "slots", "tag", "moods", pools, "slot", "tag", 5)), pools


@query("w07_two_reserved_slots", f"WITH {_POOL}, {_ASKS} SELECT id, mood_slot, tag_slot, failed FROM re")
def _(t):
    """A slot for the mood and another for the demanded tag; orders whose tag no slot can carry fail."""
    return _reserved(t)[0].select("id", F.col("mood_slot").cast("long").alias("mood_slot"), F.col("tag_slot").cast("long").alias("tag_slot"), "failed")


@query("w07_reserved_names", f"WITH {_POOL}, {_ASKS}, {_filled()} SELECT id, array_to_string(parts, ' ') AS name FROM s3 WHERE len(parts) > 0")
def _(t):
    """The names filled around their reserved slots."""
    reserved, pools = _reserved(t)
    return N.fill_reserved(reserved, "id", "gate", "slots", "tag", "moods", pools, "slot", "word", "tag", "weight", 7).select("id", F.array_join("parts", " ").alias("name"))


_NAMES = """nm AS (SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS slot, split_part(p_name, ' ', 1) AS usage, CASE WHEN l_linenumber % 2 = 0 THEN 'post' ELSE 'pre' END AS position FROM lineitem JOIN part ON p_partkey = l_partkey),
se AS (SELECT split_part(p_name, ' ', 1) AS usage, p_partkey AS rank, 'l' || p_size % 3 AS language, split_part(p_name, ' ', 2) AS form, p_brand AS gloss, left(p_type, 1) AS tag FROM part)"""


@query("w10_diversified_repeats", f"""
WITH RECURSIVE {_NAMES}, ow AS (SELECT DISTINCT ON (usage) usage, language, gloss, tag FROM se ORDER BY usage, rank), pl AS (SELECT DISTINCT usage, position, language, tag FROM nm JOIN ow USING (usage)),
ln AS (SELECT usage, position || chr(31) || language || chr(31) || unnest(['', 't' || tag]) AS lane FROM pl), nb AS (SELECT lane, usage, row_number() OVER (PARTITION BY lane ORDER BY usage) - 1 AS n, count(*) OVER (PARTITION BY lane) AS size FROM ln),
sy AS (SELECT se.usage, list(DISTINCT {{'rank': se.rank, 'language': se.language, 'form': form}} ORDER BY {{'rank': se.rank, 'language': se.language, 'form': form}}) AS syn FROM se JOIN ow ON ow.usage = se.usage AND ow.gloss = se.gloss AND ow.language <> se.language GROUP BY 1),
wh AS (SELECT id, count(*) AS k, string_agg(usage, '|' ORDER BY slot) AS name FROM nm GROUP BY 1),
ag AS (SELECT id, slot, k, name, unnest([{{'o': 0, 'l': position || chr(31) || language || chr(31) || 't' || tag}}, {{'o': 1, 'l': position || chr(31) || language || chr(31)}}]) AS c FROM (SELECT *, row_number() OVER (PARTITION BY id, usage ORDER BY slot) AS r FROM nm) JOIN wh USING (id) JOIN ow USING (usage) WHERE r > 1),
op AS (SELECT id, slot, list(usage ORDER BY o, j) AS options FROM (SELECT id, slot, k, c.o AS o, usage, size, (n - CAST(floor(({_U.format(seed=0, key="name || '|' || slot")}) * size) AS BIGINT) + size) % size AS j FROM ag JOIN nb ON lane = c.l) WHERE j <= least(k, size - 1) GROUP BY 1, 2),
fu AS (SELECT nm.id, nm.slot, nm.usage, language, syn, options FROM nm JOIN ow ON ow.usage = nm.usage LEFT JOIN sy ON sy.usage = nm.usage LEFT JOIN op ON op.id = nm.id AND op.slot = nm.slot),
r AS (SELECT id, 0::BIGINT AS slot, ''::VARCHAR AS final, []::VARCHAR[] AS folds, []::VARCHAR[] AS langs FROM wh
  UNION ALL SELECT id, slot, CASE kind WHEN 'syn' THEN s.form WHEN 'other' THEN o ELSE usage END, CASE kind WHEN 'first' THEN list_append(folds, usage) WHEN 'syn' THEN list_append(folds, s.form) WHEN 'other' THEN list_append(folds, o) ELSE folds END,
    CASE kind WHEN 'first' THEN list_append(langs, usage || '|' || language) WHEN 'syn' THEN list_append(langs, s.form || '|' || s.language) WHEN 'other' THEN list_append(langs, o || '|' || language) ELSE langs END
  FROM (SELECT *, CASE WHEN NOT list_contains(folds, usage) THEN 'first' WHEN s IS NOT NULL THEN 'syn' WHEN o IS NOT NULL THEN 'other' ELSE 'stay' END AS kind FROM (
    SELECT r.id, fu.slot, fu.usage, fu.language, folds, langs, list_filter(syn, lambda x: NOT list_contains(langs, fu.usage || '|' || x.language))[1] AS s, list_filter(options, lambda x: NOT list_contains(folds, x))[1] AS o FROM r JOIN fu ON fu.id = r.id AND fu.slot = r.slot + 1)))
SELECT id, slot, nm.usage, position, final FROM r JOIN nm USING (id, slot)""")
def _(t):
    """Repeats within an order's names: another language's word for the same, else another word of the same place, else as they are."""
    j = t("lineitem").join(t("part"), F.col("p_partkey") == F.col("l_partkey"))
    slot = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")).cast("long")
    first, second = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    names = j.select(F.col("l_orderkey").alias("id"), slot.alias("slot"), first.alias("usage"), F.when(F.col("l_linenumber") % 2 == 0, "post").otherwise("pre").alias("position"))
    senses = t("part").select(first.alias("usage"), F.col("p_partkey").alias("rank"), F.concat(F.lit("l"), (F.col("p_size") % 3).cast("string")).alias("language"), second.alias("form"), F.col("p_brand").alias("gloss"), F.left("p_type", F.lit(1)).alias("tag"))
    return N.diversified(names, "id", "slot", "usage", "position", senses)


@query("w13_rendered_names", f"""
WITH x AS (SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS slot, p_size % 30 AS entity, split_part(p_name, ' ', 1) AS usage FROM lineitem JOIN part ON p_partkey = l_partkey),
va AS (SELECT p_size % 30 AS e, split_part(p_name, ' ', 2) AS f, CAST(count(*) AS DOUBLE) AS w FROM part WHERE p_partkey % 4 > 0 GROUP BY 1, 2), ia AS (SELECT DISTINCT p_size % 30 AS e, upper(split_part(p_name, ' ', 2)) || chr(31) || p_brand AS f FROM part WHERE p_size % 30 < 11 AND p_partkey % 9 = 0),
vc AS (SELECT *, sum(w) OVER (PARTITION BY e ORDER BY f) AS cum, sum(w) OVER (PARTITION BY e) AS total FROM va), ic AS (SELECT *, count(*) OVER (PARTITION BY e ORDER BY f) AS cum, count(*) OVER (PARTITION BY e) AS total FROM ia),
d AS (SELECT *, (SELECT min(f) FROM ic WHERE ic.e = entity AND cum > ({_U.format(seed=3, key="id || '|' || slot || '|i1'")}) * total) AS inf, (SELECT min(f) FROM vc WHERE vc.e = entity AND cum > ({_U.format(seed=3, key="id || '|' || slot || '|v1'")}) * total) AS var FROM x),
k AS (SELECT id, slot, entity, usage, CASE WHEN inf IS NOT NULL AND ({_U.format(seed=3, key="id || '|' || slot || '|i0'")}) < 0.3 THEN string_split(inf, chr(31)) END AS got, CASE WHEN ({_U.format(seed=3, key="id || '|' || slot || '|v0'")}) < 0.5 THEN var END AS var FROM d),
c AS (SELECT p_size % 30 AS e, 'f' || p_partkey % 3 AS family, p_size // 10 AS stage, lower(p_brand) AS language, list(DISTINCT {{'form': p_name, 'source': p_type}} ORDER BY {{'form': p_name, 'source': p_type}}) AS forms FROM part WHERE p_size % 30 < 20 AND p_partkey < 300 GROUP BY ALL),
f AS (SELECT e, family, list({{'language': language, 'forms': forms}} ORDER BY stage, language) AS stages FROM c GROUP BY 1, 2), g AS (SELECT e, to_json(list({{'family': family, 'stages': stages}} ORDER BY CASE family WHEN 'f2' THEN 1 WHEN 'f0' THEN 2 ELSE 3 END, family))::VARCHAR AS grid FROM f GROUP BY 1),
z AS (SELECT *, coalesce(got[1], var, usage) AS shown FROM k LEFT JOIN g ON e = entity)
SELECT id, sha256('{{"name":"' || string_agg(shown, '' ORDER BY slot) || '","parts":[' || string_agg('{{"usage":"' || usage || '","rendered":"' || shown || '"' || CASE WHEN got IS NULL THEN '' ELSE ',"label":"' || got[2] || '"' END || CASE WHEN grid IS NULL THEN '' ELSE ',"grid":' || grid END || '}}', ',' ORDER BY slot) || ']}}') AS digest FROM z GROUP BY 1""")
def _(t):
    """Names as nested documents: an inflected form or a variant by repeatable draws, and the forms of each part by family and stage."""
    j = t("lineitem").join(t("part"), F.col("p_partkey") == F.col("l_partkey"))
    slot = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")).cast("long")
    first, second, entity = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2)), (F.col("p_size") % 30).alias("entity")
    parts = j.select(F.col("l_orderkey").alias("id"), slot.alias("slot"), entity, first.alias("usage"))
    p = t("part")
    variants = p.where("p_partkey % 4 > 0").select(entity, second.alias("form"), F.lit(1).alias("weight"))
    inflections = p.where("p_size % 30 < 11 and p_partkey % 9 = 0").select(entity, F.upper(second).alias("form"), F.col("p_brand").alias("label"))
    grid = p.where("p_size % 30 < 20 and p_partkey < 300").select(entity, F.concat(F.lit("f"), (F.col("p_partkey") % 3).cast("string")).alias("family"), F.floor(F.col("p_size") / 10).alias("stage"), F.lower("p_brand").alias("language"), F.col("p_name").alias("form"), F.col("p_type").alias("source"))
    out = N.rendered_names(parts, "id", "slot", "entity", "usage", variants, inflections, grid, ["f2", "f0"], 3, 0.5, 0.3)
    return out.select("id", F.sha2("rendered", 256).alias("digest"))
