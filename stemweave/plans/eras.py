"""Queries of forms through time: rewriting cells both ways, names rewound part by part, all readings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import era as E
from .generation import _generated, _generation_sql
from .language import _ENTRIES, _GLUED, _entries, _parses
from .registry import query

# (family, from, to, k, pattern, replacement, weight)
_CELLS = [
    ("hill", "old", "middle", 1, "sm", "schm", 0.75), ("hill", "old", "middle", 2, "ng", "nk", 1.0), ("hill", "old", "middle", 3, "o", "a", 1.0), ("hill", "old", "middle", 4, "ea", "e", 0.5),
    ("hill", "middle", "late", 1, "schm", "shm", 1.0), ("hill", "middle", "late", 2, "a", "e", 0.25), ("hill", "middle", "late", 3, "nk", "nck", 1.0),
    ("shore", "old", "late", 1, "wi", "vi", 1.0), ("shore", "old", "late", 2, "g", "j", 0.5), ("shore", "old", "late", 3, "d", "t", 1.0),
]
_CHAIN = {"hill": ["old", "middle", "late"], "shore": ["old", "late"]}
_RU = "ru AS (SELECT * FROM (VALUES " + ", ".join(f"('{f}', '{a}', '{b}', {k}, '{p}', '{r}', {w}::DOUBLE)" for f, a, b, k, p, r, w in _CELLS) + ") AS v(family, from_era, to_era, k, p, r, w)), cell AS (SELECT family, from_era, to_era, max(k) AS last FROM ru GROUP BY ALL UNION ALL SELECT 'moor', 'old', 'late', 0)"


def _rewrite_sql(inverse: bool) -> str:
    rule, old, new, w = ("last - s.k", "r", "p", "0.5") if inverse else ("s.k + 1", "p", "r", "w")
    return f"""WITH RECURSIVE {_RU}, s AS (SELECT DISTINCT {_GLUED} AS form, family, from_era, to_era, last, {_GLUED} AS candidate, 1.0::DOUBLE AS mass, 0 AS k FROM part, cell
  UNION ALL SELECT form, s.family, s.from_era, s.to_era, last, CASE WHEN z = 0 THEN replace(candidate, {old}, {new}) ELSE candidate END, mass * CASE WHEN NOT contains(candidate, {old}) THEN 1 WHEN z = 0 THEN {w} ELSE 1 - {w} END, s.k + 1
  FROM s JOIN ru ON ru.family = s.family AND ru.from_era = s.from_era AND ru.to_era = s.to_era AND ru.k = {rule} JOIN (VALUES (0), (1)) AS q(z) ON z = 0 OR (contains(candidate, {old}) AND {w} < 1))
SELECT form, family, from_era, to_era, candidate, round(sum(mass), 6) AS mass FROM s WHERE k = last GROUP BY ALL"""


def _asked(t):
    forms = t("part").select(F.lower(F.replace("p_name", F.lit(" "), F.lit(""))).alias("form")).distinct()
    cells = sorted({c[:3] for c in _CELLS}) + [("moor", "old", "late")]
    table = F.array(*[F.struct(F.lit(a).alias("family"), F.lit(b).alias("from_era"), F.lit(c).alias("to_era")) for a, b, c in cells])
    rules = forms.sparkSession.createDataFrame(_CELLS, "family string, from_era string, to_era string, k int, pattern string, replacement string, weight double")
    return forms.select("form", F.explode(table).alias("c")).select("form", "c.*"), rules


@query("t26_rewriting_cells", _rewrite_sql(False))
def _(t):
    """What each glued name becomes in each cell of a language and two eras; one cell has no rules."""
    asked, rules = _asked(t)
    return E.rewrite_forms(asked, "form", ["family", "from_era", "to_era"], rules).withColumn("mass", F.round("mass", 6))


@query("t26_inverse_cells", _rewrite_sql(True))
def _(t):
    """What each glued name may come from, by each cell read backwards: no vocabulary is asked."""
    asked, rules = _asked(t)
    return E.rewrite_forms(asked, "form", ["family", "from_era", "to_era"], rules, inverse=True).withColumn("mass", F.round("mass", 6))


_STOPS = [("first", "old", 1100), ("second", "middle", 1300), ("third", "middle", 1450), ("now", "modern", None)]
_REWIND = f"""an AS (SELECT DISTINCT left(lower(p_name), 3) AS surface, CASE p_size % 3 WHEN 0 THEN 'old' WHEN 1 THEN 'norse' ELSE 'late' END AS language, left(lower(p_name), 2) || p_size % 5 AS form, p_size % 20 AS entity FROM part WHERE p_size < 30),
fo AS (SELECT p_size % 20 AS entity, CASE WHEN p_partkey % 2 = 0 THEN 'old' ELSE 'middle' END AS language, 1000 + p_partkey % 50 * 10 AS year, CASE WHEN p_partkey % 3 = 0 THEN left(lower(p_name), 3) ELSE left(split_part(lower(p_name), ' ', 2), 3) || p_partkey % 4 END AS form FROM part),
st AS (SELECT * FROM (VALUES ('first', 'old', 1100), ('second', 'middle', 1300), ('third', 'middle', 1450), ('now', 'modern', NULL)) AS v(stop, lg, yr)),
tok AS (SELECT word, unnest(string_split(parse, ' ')) AS token, unnest(range(len(string_split(parse, ' ')))) AS part FROM (SELECT word, arg_min(parse, (un, m, rank, parse)) AS parse FROM parses GROUP BY 1)),
pt AS (SELECT name, i AS word, part, CASE WHEN token LIKE '(%' THEN token[2:-2] ELSE token END AS token, token NOT LIKE '(%' AS known FROM (SELECT name, unnest(string_split(name, ' ')) AS w, unnest(range(len(string_split(name, ' ')))) AS i FROM nm) JOIN tok ON tok.word = w),
ac AS (SELECT DISTINCT ON (token) token, entity, language, form FROM (SELECT DISTINCT token FROM pt WHERE known) JOIN an ON surface = token WHERE language IN ('old', 'norse') ORDER BY token, language = 'norse', form, entity),
sh AS (SELECT token, stop, CASE WHEN language = lg THEN form WHEN lg = 'modern' THEN token ELSE (SELECT arg_min(fo.form, (-year, CASE WHEN fo.form = token THEN 0 WHEN fo.form = ac.form THEN 1 ELSE 2 END, fo.form)) FROM fo WHERE fo.entity = ac.entity AND fo.language = lg AND year <= yr) END AS shown FROM ac, st),
ea AS (SELECT name, word, part, pt.token, st.stop, lg, shown FROM pt JOIN st ON true LEFT JOIN sh ON sh.token = pt.token AND sh.stop = st.stop WHERE known),
wd AS (SELECT name, stop, word, string_agg(CASE WHEN lg <> 'modern' AND token = 'ed' THEN ' _' || lower(coalesce(shown, token)) || ' ' ELSE coalesce(shown, token) END, '' ORDER BY part) AS w FROM ea GROUP BY ALL),
tk AS (SELECT name, stop, word, unnest(list_filter(string_split(w, ' '), lambda x: x <> '')) AS k, unnest(range(len(list_filter(string_split(w, ' '), lambda x: x <> '')))) AS j FROM wd),
re AS (SELECT name, stop, string_agg(CASE WHEN starts_with(k, '_') THEN k[2:] ELSE upper(k[1]) || lower(k[2:]) END, ' ' ORDER BY word, j) AS rendered FROM tk GROUP BY ALL),
fb AS (SELECT name, stop, bool_or(shown IS NULL) AS fallback, coalesce(string_agg(token, ',' ORDER BY word, part) FILTER (shown IS NULL), '') AS fallbacks FROM ea GROUP BY ALL),
un AS (SELECT name, coalesce(string_agg(token, ',' ORDER BY word, part) FILTER (NOT known), '') AS unaccounted FROM pt GROUP BY 1)
SELECT name, st.stop, coalesce(rendered, '') AS rendered, coalesce(fallback, true) AS fallback, coalesce(fallbacks, '') AS fallbacks, unaccounted FROM un JOIN st ON true LEFT JOIN re USING (name, stop) LEFT JOIN fb USING (name, stop)"""


def _rewound(t, names):
    p, name = t("part"), F.lower("p_name")
    language = F.when(F.col("p_size") % 3 == 0, "old").when(F.col("p_size") % 3 == 1, "norse").otherwise("late")
    anchors = p.where("p_size < 30").select(F.left(name, F.lit(3)).alias("surface"), language.alias("language"), F.lit(0).alias("place"), F.concat(F.left(name, F.lit(2)), (F.col("p_size") % 5).cast("string")).alias("form"), (F.col("p_size") % 20).alias("entity"))
    form = F.when(F.col("p_partkey") % 3 == 0, F.left(name, F.lit(3))).otherwise(F.concat(F.left(F.split_part(name, F.lit(" "), F.lit(2)), F.lit(3)), (F.col("p_partkey") % 4).cast("string")))
    forms = p.select((F.col("p_size") % 20).alias("entity"), F.when(F.col("p_partkey") % 2 == 0, "old").otherwise("middle").alias("language"), (1000 + F.col("p_partkey") % 50 * 10).cast("int").alias("year"), form.alias("form"))
    out = E.rewind_names(names, "name", _entries(t), "w", anchors, forms, ["old", "norse"], _STOPS, "modern", particles=("ed",))
    joined = lambda c: F.array_join(c, ",").alias(c)
    return out.select("name", "stop", "rendered", "fallback", joined("fallbacks"), joined("unaccounted"))


@query("z01_rewound_parts", f"WITH RECURSIVE {_ENTRIES}, nm AS (SELECT DISTINCT lower(p_name) AS name FROM part), {_parses('SELECT DISTINCT unnest(string_split(name, chr(32))) AS word FROM nm')}, {_REWIND}")
def _(t):
    """Names of two words taken apart, each part at four stops in the form of its own time; some have no older form."""
    return _rewound(t, t("part").select(F.lower("p_name").alias("name")))


@query("z03_rewound_names", f"WITH RECURSIVE {_ENTRIES}, {_generation_sql().replace('WITH ', '')}, nm AS (SELECT DISTINCT lower(name) AS name FROM names WHERE name <> ''), {_parses('SELECT DISTINCT unnest(string_split(name, chr(32))) AS word FROM nm')}, {_REWIND}")
def _(t):
    """Generated names, each rewound by its parts through four stops."""
    return _rewound(t, _generated(t)[1].select(F.lower(F.array_join("parts", " ")).alias("name")).where("name <> ''"))


@query("z02_name_readings", f"""
WITH RECURSIVE {_ENTRIES}, nm AS (SELECT DISTINCT lower(p_name) AS name FROM part), {_parses('SELECT DISTINCT unnest(string_split(name, chr(32))) AS word FROM nm')}, c AS (SELECT word, min({{'un': un, 'm': m}}) AS c FROM parses GROUP BY 1),
b AS (SELECT word, parse, un, m FROM parses JOIN c USING (word) WHERE un = c.un AND m = c.m)
SELECT name, x.parse || ' / ' || y.parse AS reading, x.un + y.un AS unaccounted, x.m + y.m AS morphemes FROM nm JOIN b x ON x.word = split_part(name, ' ', 1) JOIN b y ON y.word = split_part(name, ' ', 2)""")
def _(t):
    """Every combination of the tied readings of the two words of a name."""
    return E.name_readings(t("part"), "p_name", _entries(t), "w")
