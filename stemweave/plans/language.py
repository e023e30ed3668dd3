"""Queries for text, scalar, scoring and log operators on the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import log as L
from ..operators import scoring as W
from ..operators import aggregates as A
from ..operators import text as T
from .registry import query

_GLUED = "lower(replace(p_name, ' ', ''))"


def _glued(t):
    return t("part").select("p_partkey", F.lower(F.replace("p_name", F.lit(" "), F.lit(""))).alias("glued"), F.split(F.lower("p_name"), " ").alias("w"))


_ENTRIES = "d AS (SELECT DISTINCT left(w, 3) AS w FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS w FROM part) UNION SELECT DISTINCT right(w, 2) FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS w FROM part))"


def _entries(t):
    """A dictionary that leaves letters over: the first three and the last two letters of the words of part names."""
    w = t("part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("w"))
    return w.select(F.left("w", F.lit(3)).alias("w")).union(w.select(F.right("w", F.lit(2)))).distinct()


def _parses(words: str, glue: str = "NULL") -> str:
    """SQL: every parse ``(word, parse, un, m, rank)`` of the words of a query, step by step."""
    return f"""g AS ({words}), pos AS (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM g),
tr AS (SELECT word, i, w AS token, length(w) AS n, 0 AS cu, 1 AS cm, 'behind' AS kind FROM pos JOIN d ON substr(word, i, length(w)) = w
  UNION ALL SELECT word, i, '+' || {glue} || '+', 1, 0, 0, 'glued' FROM pos WHERE substr(word, i, 1) = {glue}
  UNION ALL SELECT word, i, '(' || substr(word, i, x) || ')', x, x, 0, 'closed' FROM (SELECT word, i, unnest(range(1, length(word) - i + 2)) AS x FROM pos)),
p AS (SELECT word, 1::BIGINT AS i, '' AS parse, 0::BIGINT AS un, 0::BIGINT AS m, 0::BIGINT AS rank, 'any' AS kind FROM g
  UNION ALL SELECT p.word, p.i + n, CASE WHEN parse = '' THEN token ELSE parse || ' ' || token END, un + cu, m + cm, CASE WHEN p.i > 1 THEN rank WHEN tr.kind = 'behind' THEN -n ELSE 1 END, tr.kind
  FROM p JOIN tr ON tr.word = p.word AND tr.i = p.i WHERE tr.kind = 'behind' OR (tr.kind = 'glued' AND p.kind = 'behind') OR (tr.kind = 'closed' AND p.kind IN ('any', 'behind'))),
parses AS (SELECT word, parse, un, m, rank FROM p WHERE i = length(word) + 1 AND kind <> 'glued')"""


_NAMES = f"SELECT DISTINCT {_GLUED} AS word FROM part"
_S_NAMES = "SELECT DISTINCT replace(lower(p_name), ' ', 's') AS word FROM part"


@query("t01_dictionary_matches", f"WITH {_ENTRIES}, g AS ({_NAMES}), p AS (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM g) SELECT word, i - 1 AS at, w AS surface FROM p JOIN d ON substr(word, i, length(w)) = w")
def _(t):
    """Every dictionary entry inside every name, with its place: what a trie walk finds, as one equality join."""
    x = T.dictionary_matches(_glued(t), "glued", _entries(t), "w")
    return x.select("word", F.explode("matches").alias("m")).select("word", "m.at", "m.surface")


@query("t18_folded_surfaces", "SELECT regexp_replace(lower(p_brand || ' ' || p_name), '[^a-z]+', '', 'g') AS folded, count(*) AS n FROM part GROUP BY 1")
def _(t):
    return t("part").groupBy(S.fold_surface(F.concat_ws(" ", "p_brand", "p_name")).alias("folded")).agg(F.count("*").alias("n"))


@query("t18_accented_surfaces", "SELECT p_partkey, regexp_replace(replace(replace(lower(p_name), 't', 'th'), 'w', 'ae'), '[^a-z]+', '', 'g') AS folded FROM part")
def _(t):
    """Names written with accents, strokes, ligatures and letters of other Latin alphabets."""
    strange = F.translate(F.upper("p_name"), "AEIONLTWDRGZ", "ĀÉÏǾṆŁÞǢĐŘǴẒ")
    return t("part").select("p_partkey", S.fold_surface(strange).alias("folded"))


@query("t02_all_segmentations", f"WITH RECURSIVE {_ENTRIES}, {_parses(_NAMES)} SELECT word AS glued, count(*) AS parses FROM parses GROUP BY 1")
def _(t):
    return T.parse_counts(_glued(t), "glued", _entries(t), "w").withColumnRenamed("word", "glued")


@query("t03_best_segmentation", f"WITH RECURSIVE {_ENTRIES}, {_parses(_NAMES)} SELECT word, arg_min(parse, (un, m, rank, parse)) AS parse, min((un, m)).un AS unaccounted, min((un, m)).m AS morphemes FROM parses GROUP BY 1".replace("min((un, m)).un", "min({'un': un, 'm': m}).un").replace("min((un, m)).m", "min({'un': un, 'm': m}).m"))
def _(t):
    return T.segment(_glued(t), "glued", _entries(t), "w")


@query("t05_connective_glue", f"WITH RECURSIVE {_ENTRIES}, {_parses(_S_NAMES, chr(39) + 's' + chr(39))} SELECT word, arg_min(parse, (un, m, rank, parse)) AS parse, min({{'un': un, 'm': m}}).un AS unaccounted, min({{'un': un, 'm': m}}).m AS morphemes FROM parses GROUP BY 1")
def _(t):
    """Names whose words are glued by a letter, which costs nothing between two entries."""
    return T.segment(t("part").select(F.replace(F.lower("p_name"), F.lit(" "), F.lit("s")).alias("g")), "g", _entries(t), "w", ("s",))


@query("t03_split_point_segmentation", f"SELECT DISTINCT {_GLUED} AS word, split_part(lower(p_name), ' ', 1) AS head, split_part(lower(p_name), ' ', 2) AS tail FROM part")
def _(t):
    g = _glued(t)
    return T.split_point_segment(g, "glued", g.select(F.explode("w").alias("e")), "e")


@query("t07_position_labels", """
SELECT w AS word, CASE WHEN n = 1 THEN 'bare' WHEN i = 1 THEN 'pre' WHEN i = n THEN 'post' ELSE 'inner' END AS position, count(*) AS n FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS w, unnest(range(1, len(string_split(p_name, ' ')) + 1)) AS i, len(string_split(p_name, ' ')) AS n FROM part) GROUP BY ALL""")
def _(t):
    x = _glued(t).select(F.posexplode("w").alias("i", "word"), F.size("w").alias("m"))
    return x.groupBy("word", T.position_label(F.col("i") + 1, F.col("m")).alias("position")).agg(F.count("*").alias("n"))


@query("t10_corpus_counts", """
WITH w AS (SELECT doc_id AS doc, unnest(regexp_split_to_array(lower(text), '[^\\p{L}]+')) AS form FROM documents), f AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^\\p{L}]+')) AS form FROM benchmark)
SELECT form, doc, count(*) AS n FROM w WHERE length(form) >= 6 AND form IN (SELECT form FROM f) GROUP BY 1, 2""")
def _(t):
    forms = t("benchmark").select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("f"))
    return T.corpus_counts(t("documents"), "doc_id", "text", forms, "f", 6)


@query("t11_levenshtein", "SELECT a.r_name AS a, b.n_name AS b, levenshtein(a.r_name, b.n_name) AS d FROM region a JOIN nation b ON b.n_regionkey = a.r_regionkey WHERE levenshtein(a.r_name, b.n_name) <= 6")
def _(t):
    j = t("region").join(t("nation"), F.col("r_regionkey") == F.col("n_regionkey"))
    return j.select(F.col("r_name").alias("a"), F.col("n_name").alias("b"), F.levenshtein("r_name", "n_name").cast("long").alias("d")).where("d <= 6")


@query("t12_fuzzy_pairs", """
WITH v AS (SELECT DISTINCT w FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS w FROM documents) WHERE length(w) >= 9), c AS (SELECT DISTINCT w AS f FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS w FROM benchmark) WHERE length(w) >= 9)
SELECT w AS word, f AS form FROM v JOIN c ON levenshtein(w, f) = 1 WHERE w NOT IN (SELECT f FROM c)""")
def _(t):
    v = t("documents").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("w"))
    c = t("benchmark").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("f"))
    return T.fuzzy_pairs(v, "w", c, "f", 9)


@query("t12_anchored_search", """
WITH d AS (SELECT doc_id AS doc, lower(regexp_replace(text, '[^\\x00-\\x7F]', '~', 'g')) AS t FROM documents), p AS (SELECT doc, t, regexp_split_to_array(t, '\\p{L}+') AS g, regexp_extract_all(t, '\\p{L}+') AS w FROM d),
r AS (SELECT doc, unnest(w) AS word, unnest(range(len(w))) AS k, unnest(g[1:len(w)]) AS gap FROM p), a AS (SELECT doc, word, CAST(sum(length(gap) + length(word)) OVER (PARTITION BY doc ORDER BY k) - length(word) AS BIGINT) AS pos FROM r),
s AS (SELECT doc, word, min(pos) AS pos, count(*) AS n FROM a WHERE length(word) >= 8 GROUP BY 1, 2), x AS (SELECT item_id, lower(regexp_replace(text, '[^\\x00-\\x7F]', '~', 'g')) AS t FROM benchmark),
e AS (SELECT DISTINCT item_id AS entity, unnest(regexp_extract_all(t, '\\p{L}{8,}')) AS form, regexp_extract_all(t, '\\p{L}{4,7}') AS glosses FROM x), c AS (SELECT DISTINCT form FROM e),
v AS (SELECT DISTINCT word FROM s ANTI JOIN c ON c.form = s.word), pr AS (SELECT word, form FROM v JOIN c ON abs(length(word) - length(form)) <= 1 AND levenshtein(word, form) = 1),
h AS (SELECT entity, s.doc, s.word, s.n, substr(d.t, greatest(pos - 40, 0) + 1, least(pos, 40) + length(s.word) + 40) AS snippet, substr(d.t, greatest(pos - 100, 0) + 1, least(pos, 100) + length(s.word) + 100) AS wd, glosses FROM s JOIN pr USING (word) JOIN e USING (form) JOIN d ON d.doc = s.doc)
SELECT entity, doc, m.word AS matched, m.n AS count, sha256(trim(m.snippet, ' ')) AS snippet FROM (SELECT entity, doc, min({'word': word, 'n': n, 'snippet': snippet}) AS m FROM h WHERE len(list_filter(glosses, lambda g: contains(wd, g))) > 0 GROUP BY 1, 2)""")
def _(t):
    """Words of all documents that are one edit from a long word of a benchmark item, near one of its short words."""
    plain = F.regexp_replace("text", r"[^\x00-\x7F]", "~").alias("text")  # the oracle's edit distance counts bytes
    b = t("benchmark").select(F.col("item_id").alias("entity"), plain).select("entity", F.lower("text").alias("t"))
    words = b.select("entity", F.explode(F.array_distinct(F.regexp_extract_all("t", F.lit(r"(\p{L}{8,})"), F.lit(1)))).alias("form"), F.regexp_extract_all("t", F.lit(r"(\p{L}{4,7})"), F.lit(1)).alias("glosses"))
    out = T.anchored_search(t("documents").select("doc_id", plain), "doc_id", "text", words, words, "form", 8)
    return out.withColumn("snippet", F.sha2("snippet", 256))


@query("t13_ambiguous_forms", "SELECT p_brand, p_name, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS entities FROM part GROUP BY 1, 2 HAVING count(DISTINCT p_type) > 1")
def _(t):
    return T.ambiguous_matches(t("part"), "p_brand", "p_name", "p_type").select("p_brand", "p_name", F.array_join("entities", ",").alias("entities"))


@query("t14_year_attestations", """
WITH x AS (SELECT o_orderkey AS doc, 'In ' || lower(o_orderstatus) || 'ton ' || year(o_orderdate) || ' and ' || o_orderpriority || 'ham ' || (o_orderkey % 3000) AS text FROM orders),
p AS (SELECT doc, unnest(regexp_extract_all(text, '([A-Za-z]+) (\\d{3,4})\\b', 1)) AS f, CAST(unnest(regexp_extract_all(text, '([A-Za-z]+) (\\d{3,4})\\b', 2)) AS INTEGER) AS y FROM x)
SELECT lower(f) AS form, doc, min(y) AS year FROM p WHERE y BETWEEN 700 AND 2000 GROUP BY 1, 2""")
def _(t):
    text = F.concat(F.lit("In "), F.lower("o_orderstatus"), F.lit("ton "), F.year("o_orderdate"), F.lit(" and "), "o_orderpriority", F.lit("ham "), F.col("o_orderkey") % 3000)
    return T.year_attestations(t("orders").select("o_orderkey", text.alias("text")), "o_orderkey", "text", 700, 2000)


@query("t17_refill_passages", """
WITH b AS (SELECT item_id, left(text, 100) AS q, right(left(text, 100), 80) AS e FROM benchmark)
SELECT b.item_id, d.doc_id, q || substr(d.text, instr(d.text, e) + length(e), 200) AS refilled FROM b LEFT JOIN documents d ON contains(d.text, e)""")
def _(t):
    """The first 100 characters of each passage, refilled from every document whose body has their tail; null where none has."""
    q = t("benchmark").select("item_id", F.left("text", F.lit(100)).alias("q")).withColumn("e", F.right("q", F.lit(80)))
    found = T.containing(t("documents"), "doc_id", "text", q, "item_id", "e").join(t("documents").select("doc_id", "text"), "doc_id")
    return q.join(found, "item_id", "left").select("item_id", "doc_id", T.refill_quote(F.col("q"), F.col("text"), 80, 200).alias("refilled"))


@query("c18_paragraph_chunks", r"""
WITH RECURSIVE p AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS i, length(p) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS p, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS k FROM documents) WHERE trim(p) <> ''),
r AS (SELECT doc_id, i, 0::BIGINT AS chunk, n AS used FROM p WHERE i = 1 UNION ALL SELECT r.doc_id, p.i, CASE WHEN used + n + 2 <= 1000 THEN chunk ELSE chunk + 1 END, CASE WHEN used + n + 2 <= 1000 THEN used + n + 2 ELSE n END FROM r JOIN p ON p.doc_id = r.doc_id AND p.i = r.i + 1)
SELECT doc_id, chunk, max(used) AS n_chars FROM r GROUP BY 1, 2""")
def _(t):
    lines = F.regexp_replace("text", "\n", "\n\n")
    return t("documents").select("doc_id", F.posexplode(T.pack_paragraphs(lines, 1000)).alias("chunk", "text")).select("doc_id", "chunk", F.length("text").alias("n_chars"))


@query("t19_gloss_tokens", """
SELECT item_id, len(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}]+'), lambda x: length(x) >= 3 AND x NOT IN ('the', 'and', 'with')))) AS tokens FROM benchmark""")
def _(t):
    return t("benchmark").select("item_id", F.size(S.gloss_tokens(F.col("text"), ["the", "and", "with"])).cast("long").alias("tokens"))


@query("t20_consonant_skeleton", "SELECT n_name, regexp_replace(regexp_replace(lower(n_name), '[^a-z]+', '', 'g'), '[aeiouy]+', '', 'g') AS skeleton FROM nation")
def _(t):
    return t("nation").select("n_name", S.consonant_skeleton(F.col("n_name")).alias("skeleton"))


@query("t21_lemma_candidates", """
WITH w AS (SELECT row_number() OVER (ORDER BY lang, w) AS id, lang, w FROM (SELECT DISTINCT lang, w FROM (SELECT lang, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS w FROM documents) WHERE length(w) >= 4)), r AS (SELECT * FROM (VALUES (0, 'ing', ''), (1, 'ed', ''), (2, 'er', 'e')) AS v(i, a, b))
SELECT w.lang, w.w, l.w AS lemma, CAST(r.i AS INTEGER) AS rule FROM w JOIN r ON w.w LIKE '%' || r.a AND length(w.w) > length(r.a) JOIN w l ON l.lang = w.lang AND l.w = left(w.w, length(w.w) - length(r.a)) || r.b WHERE l.id <> w.id QUALIFY row_number() OVER (PARTITION BY w.id ORDER BY r.i) = 1""")
def _(t):
    w = t("documents").select("lang", F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("w")).where("length(w) >= 4").distinct().withColumn("id", F.concat_ws(":", "lang", "w"))
    hit = T.lemma_candidates(w, "id", "lang", "w", [("ing", ""), ("ed", ""), ("er", "e")])
    return hit.select(F.split_part("id", F.lit(":"), F.lit(1)).alias("lang"), F.split_part("id", F.lit(":"), F.lit(2)).alias("w"), F.split_part("lemma_id", F.lit(":"), F.lit(2)).alias("lemma"), "rule")


@query("t22_ocr_clusters", "SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_brand, regexp_replace(lower(p_name), '[^a-z]+', '', 'g')) AS winner FROM part")
def _(t):
    return T.ocr_clusters(t("part"), "p_partkey", "p_brand", "p_name")


@query("t24_suffix_anchor", f"""
WITH n AS (SELECT DISTINCT {_GLUED} AS name FROM part), s AS (SELECT DISTINCT split_part(lower(p_name), ' ', 2) AS suffix FROM part)
SELECT name, left(name, length(name) - length(suffix)) AS stem, suffix FROM n JOIN s ON name LIKE '%' || suffix AND length(name) - length(suffix) >= 2 AND length(suffix) >= 2 QUALIFY row_number() OVER (PARTITION BY name ORDER BY length(suffix) DESC) = 1""")
def _(t):
    g = _glued(t)
    return T.suffix_anchor(g, "glued", g.select(F.element_at("w", -1).alias("s")), "s")


@query("t25_low_overlap", """
WITH x AS (SELECT DISTINCT p_name, p_brand, regexp_replace(lower(p_name), '[^a-z]+', '', 'g') AS a, regexp_replace(lower(p_brand), '[^a-z]+', '', 'g') AS b FROM lineitem JOIN part ON p_partkey = l_partkey),
k AS (SELECT *, unnest(range(1, length(a) + 1)) AS i FROM x), r AS (SELECT p_name, p_brand, a, b, i, unnest(range(1, length(a) - i + 2)) AS n FROM k),
c AS (SELECT p_name, p_brand, max(CASE WHEN contains(b, substr(a, i, n)) THEN n ELSE 0 END) AS common FROM r GROUP BY 1, 2)
SELECT p_name, p_brand, common FROM c WHERE common < 3""")
def _(t):
    j = T.stored(t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).select("p_name", "p_brand").distinct())  # else the run is searched for in each part's row
    run = T.longest_common_run(S.fold_surface(F.col("p_name")), S.fold_surface(F.col("p_brand")))
    return j.repartition(A.tasks_for(j)).select("p_name", "p_brand", run.alias("common")).where("common < 3")


_ERAS = """ru AS (SELECT * FROM (VALUES ('early', 1, 'sm', 'schm', 0.7), ('early', 2, 'ng', 'nk', 1.0), ('late', 1, 'o', 'a', 0.4), ('late', 2, 'schm', 'shm', 1.0), ('late', 3, 'r', '', 0.25)) AS v(era, k, a, b, w))"""
_RULES = {"early": [("sm", "schm", 0.7), ("ng", "nk", 1.0)], "late": [("o", "a", 0.4), ("schm", "shm", 1.0), ("r", "", 0.25)]}


@query("t26_sound_changes", f"""
WITH RECURSIVE {_ERAS}, s AS (SELECT DISTINCT {_GLUED} AS form, era, {_GLUED} AS candidate, 1.0::DOUBLE AS mass, 0 AS k FROM part, (SELECT DISTINCT era FROM ru)
  UNION ALL SELECT form, s.era, CASE WHEN z = 0 THEN replace(candidate, a, b) ELSE candidate END, mass * CASE WHEN z = 0 THEN w ELSE 1 - w END, s.k + 1 FROM s JOIN ru ON ru.era = s.era AND ru.k = s.k + 1 JOIN (VALUES (0), (1)) AS q(z) ON z = 0 OR w < 1)
SELECT form, s.era, candidate, round(sum(mass), 6) AS mass FROM s JOIN (SELECT era, max(k) AS last FROM ru GROUP BY 1) m ON m.era = s.era AND m.last = s.k GROUP BY 1, 2, 3""")
def _(t):
    """Candidate spellings of each glued name after the rules of each era."""
    return T.sound_change_table(_glued(t), "glued", _RULES, "form").withColumn("mass", F.round("mass", 6))


@query("t26_inverse_sound_changes", f"""
WITH e AS (SELECT DISTINCT {_GLUED} AS form FROM part), c AS (SELECT form, replace(replace(form, 'ng', 'nk'), 'o', 'a') AS attested FROM e)
SELECT attested, form AS origin FROM c""")
def _(t):
    """The names that each changed spelling may come from: the changes of all names, looked up by what they give."""
    forms = _glued(t).select("glued").distinct()
    attested = forms.select(F.replace(F.replace("glued", F.lit("ng"), F.lit("nk")), F.lit("o"), F.lit("a")).alias("attested")).distinct()
    return T.sound_change_origins(attested, "attested", forms, "glued", [("ng", "nk", 1.0), ("o", "a", 1.0)]).select("attested", "origin")


@query("t28_spelling_vector", """
WITH f AS (SELECT n_name, regexp_replace(lower(n_name), '[^a-z]+', '', 'g') AS s FROM nation)
SELECT n_name, round(length(regexp_replace(s, '[^aeiouy]', '', 'g')) / greatest(length(s), 1), 6) AS vowel_rate, round(length(regexp_replace(s, '[^mn]', '', 'g')) / greatest(length(s), 1), 6) AS nasal_rate, CASE WHEN regexp_matches(s, '[aeiouy]$') THEN 1.0 ELSE 0.0 END::DOUBLE AS ends_vowel FROM f""")
def _(t):
    v = T.spelling_vector(F.col("n_name"))
    return t("nation").select("n_name", F.round(v["vowel_rate"], 6).alias("vowel_rate"), F.round(v["nasal_rate"], 6).alias("nasal_rate"), v["ends_vowel"].alias("ends_vowel"))


@query("t31_cosine_to_centroid", """
WITH c AS (SELECT label, list(s ORDER BY i) AS m FROM (SELECT label, i, sum(CAST(v AS DOUBLE)) AS s FROM (SELECT label, unnest(embedding) AS v, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY 1, 2) GROUP BY 1)
SELECT vec_id, label, round(list_cosine_similarity(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), m), 5) AS similarity FROM embeddings JOIN c USING (label)""")
def _(t):
    e = t("embeddings")
    sums = e.select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.sum(F.col("v").cast("double")).alias("s"))
    centre = sums.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "s"))), lambda x: x["s"]).alias("m"))
    return e.join(centre, "label").select("vec_id", "label", F.round(S.cosine(F.col("embedding"), F.col("m")), 5).alias("similarity"))


@query("f01_ascii_lower", "SELECT doc_id, sha256(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS digest FROM documents")
def _(t):
    return t("documents").select("doc_id", F.sha2(S.ascii_lower(F.col("text")), 256).alias("digest"))


@query("f03_json_fields", "SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1, 2")
def _(t):
    return t("events").groupBy("event_type", F.from_json("props", "k bigint")["k"].alias("k")).agg(F.count("*").alias("n"))


@query("f04_midpoints", "SELECT l_orderkey, CAST(floor((year(min(l_shipdate)) + year(max(l_shipdate))) / 2) AS BIGINT) AS mid FROM lineitem GROUP BY 1")
def _(t):
    return t("lineitem").groupBy("l_orderkey").agg(S.midpoint(F.year(F.min("l_shipdate")), F.year(F.max("l_shipdate"))).alias("mid"))


@query("f05_weighted_sum", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(greatest(least(l_discount * 4 - l_tax * 2 + l_quantity / 50 * 0.5, 1), -1), 6) AS score FROM lineitem")
def _(t):
    f = {"discount": F.col("l_discount"), "tax": F.col("l_tax"), "share": F.col("l_quantity") / 50, "other": F.lit(9.0)}
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(S.weighted_sum(f, {"discount": 4.0, "tax": -2.0, "share": 0.5}), 6).alias("score"))


@query("f07_map_lookup", "SELECT event_id, CASE event_type WHEN 'click' THEN 3 WHEN 'purchase' THEN 7 ELSE 0 END AS w FROM events")
def _(t):
    return t("events").select("event_id", S.map_lookup({"click": 3, "purchase": 7}, F.col("event_type"), 0).alias("w"))


@query("f09_content_ids", "SELECT p_partkey, 'CM' || left(sha256('=' || p_brand || chr(31) || '=' || p_name), 16) AS id FROM part")
def _(t):
    return t("part").select("p_partkey", S.content_id("CM", F.col("p_brand"), F.col("p_name")).alias("id"))


@query("p02_eligibility_gates", "SELECT p_partkey FROM part WHERE (p_size % 7 = 0 OR p_brand IN ('Brand#1', 'Brand#2', 'Brand#3')) AND p_size <= 30 AND contains(p_name, 'small') AND NOT contains(p_name, 'bolt')")
def _(t):
    culture = F.when(F.col("p_size") % 7 != 0, F.col("p_brand"))
    ok = W.eligible(culture, F.col("p_size"), F.split("p_name", " "), cultures=["Brand#1", "Brand#2", "Brand#3"], latest=30, required=["small"], excluded=["bolt"])
    return t("part").where(ok).select("p_partkey")


@query("p05_pattern_filters", "SELECT p_partkey FROM part WHERE p_name ILIKE '%O_D%' AND p_name GLOB '*[rt]'")
def _(t):
    return t("part").where(F.col("p_name").ilike("%O_D%") & F.col("p_name").rlike("[rt]$")).select("p_partkey")


@query("w01_composite_score", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(0.5 * l_quantity + 10 * l_discount - 3 * l_tax, 6) AS score FROM lineitem")
def _(t):
    s = W.composite_score({"q": F.col("l_quantity"), "d": F.col("l_discount"), "t": F.col("l_tax")}, {"q": 0.5, "d": 10.0, "t": -3.0})
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(s, 6).alias("score"))


@query("w04_frequency_allocation", """
WITH x AS (SELECT p_name, p_partkey, p_size % 5 AS score, count(*) OVER (PARTITION BY p_name) AS freq FROM part) SELECT p_name, p_partkey, round(CASE WHEN sum(score) OVER (PARTITION BY p_name) > 0 THEN freq * score / sum(score) OVER (PARTITION BY p_name) ELSE freq / count(*) OVER (PARTITION BY p_name) END, 6) AS weight FROM x""")
def _(t):
    x = t("part").select("p_name", "p_partkey", (F.col("p_size") % 5).alias("score"), F.count("*").over(Window.partitionBy("p_name")).alias("freq"))
    return W.allocate_frequency(x, "p_name", "score", "freq").select("p_name", "p_partkey", F.round("weight", 6).alias("weight"))


@query("w05_cohesion_reweight", "SELECT p_brand, p_partkey, round(p_size * (0.4 + 0.6 * p_retailprice / avg(p_retailprice) OVER (PARTITION BY p_brand)), 4) AS weight FROM part")
def _(t):
    x = t("part").select("p_brand", "p_partkey", F.col("p_size").cast("double").alias("weight"), "p_retailprice")
    return W.cohesion_reweight(x, "p_brand", "weight", "p_retailprice", 0.6).select("p_brand", "p_partkey", F.round("weight", 4).alias("weight"))


@query("w06_novelty_blend", "SELECT p_brand, p_partkey, round(0.75 * p_size / sum(p_size) OVER (PARTITION BY p_brand) + 0.25 / count(*) OVER (PARTITION BY p_brand), 8) AS weight FROM part")
def _(t):
    x = t("part").select("p_brand", "p_partkey", F.col("p_size").cast("double").alias("weight"))
    return W.novelty_blend(x, "p_brand", "weight", 0.25).select("p_brand", "p_partkey", F.round("weight", 8).alias("weight"))


@query("w08_weighted_choice", """
WITH w AS (SELECT p_brand, p_name, sum(p_size % 4) AS weight FROM part GROUP BY ALL), c AS (SELECT p_brand, p_name, sum(weight) OVER (PARTITION BY p_brand ORDER BY p_name) AS cum, sum(weight) OVER (PARTITION BY p_brand) AS total FROM w WHERE weight > 0), d AS (SELECT p_partkey, p_brand, (p_partkey * 37 % 101) / 101.0::DOUBLE AS u FROM part)
SELECT p_partkey, arg_min(p_name, cum) FILTER (cum > u * total) AS chosen FROM d LEFT JOIN c USING (p_brand) GROUP BY 1""")
def _(t):
    w = t("part").groupBy("p_brand", "p_name").agg(F.sum(F.col("p_size") % 4).alias("weight"))
    d = t("part").select("p_partkey", "p_brand", (F.col("p_partkey") * 37 % 101 / F.lit(101.0)).alias("u"))
    return W.weighted_choice(w, d, "p_brand", "p_name", "weight", "u").select("p_partkey", "chosen")


@query("w10_repeat_resolution", """
WITH s AS (SELECT p_brand AS key, min(p_type) AS synonym FROM part GROUP BY 1), x AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, p_brand, row_number() OVER (PARTITION BY l_orderkey, p_brand ORDER BY l_linenumber * 1000000 + l_partkey, l_suppkey) > 1 AS again FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, CASE WHEN again THEN synonym ELSE p_brand END AS final FROM x JOIN s ON s.key = p_brand""")
def _(t):
    syn = t("part").groupBy(F.col("p_brand").alias("key")).agg(F.min("p_type").alias("synonym"))
    x = t("lineitem").join(t("part"), F.col("p_partkey") == F.col("l_partkey")).select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "p_brand", F.struct((F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("a"), "l_suppkey").alias("slot"))
    return W.resolve_repeats(x, "l_orderkey", "slot", "p_brand", syn).select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "final")


_LOG = "e AS (SELECT user_id, event_id, CASE event_type WHEN 'signup' THEN 'set' WHEN 'purchase' THEN 'patch' WHEN 'error' THEN 'remove' WHEN 'click' THEN 'add' END AS op FROM events WHERE event_type <> 'view')"


@query("l01_log_fold", f"""
WITH RECURSIVE {_LOG}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM e),
r AS (SELECT user_id, 0::BIGINT AS i, false AS live, 0 AS errors, NULL::BIGINT AS last FROM (SELECT DISTINCT user_id FROM e) UNION ALL
  SELECT r.user_id, r.i + 1, CASE WHEN op = 'remove' THEN false WHEN op = 'patch' AND NOT live THEN false ELSE true END, errors + CASE WHEN (op = 'add' AND live) OR (op = 'patch' AND NOT live) THEN 1 ELSE 0 END,
    CASE WHEN op = 'remove' THEN NULL WHEN (op = 'add' AND live) OR (op = 'patch' AND NOT live) THEN last ELSE event_id END FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1)
SELECT user_id, live, CAST(errors AS INTEGER) AS errors, CAST(last AS VARCHAR) AS last FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i DESC) = 1""")
def _(t):
    op = F.when(F.col("event_type") == "signup", "set").when(F.col("event_type") == "purchase", "patch").when(F.col("event_type") == "error", "remove").when(F.col("event_type") == "click", "add")
    log = t("events").where("event_type <> 'view'").select("user_id", "event_id", op.alias("op"), F.create_map(F.lit("last"), F.col("event_id").cast("string")).alias("f"))
    return L.fold_log(log, ["user_id"], "event_id", "op", "f").select("user_id", "live", "errors", F.try_element_at("state", F.lit("last")).alias("last"))


@query("l05_effective_assertions", "SELECT event_id FROM events WHERE event_type <> 'error' AND event_id NOT IN (SELECT event_id // 2 FROM events WHERE event_type = 'error')")
def _(t):
    rows = t("events").select("event_id", F.when(F.col("event_type") == "error", F.expr("cast(event_id div 2 as bigint)")).alias("retracts"))
    return L.effective_assertions(rows, "event_id", "retracts").select("event_id")


@query("l07_last_write_wins", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1 AND event_type <> 'error'")
def _(t):
    return L.last_write_wins(t("events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "error").select("user_id", "event_id", "event_type")


@query("l09_validation_gates", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, concat_ws(',', CASE WHEN l_discount > 0.08 THEN 'discount' END, CASE WHEN l_quantity <> floor(l_quantity) THEN 'whole' END, CASE WHEN l_returnflag NOT IN ('A', 'N') THEN 'flag' END) AS errors FROM lineitem""")
def _(t):
    checks = {"discount": F.col("l_discount") <= 0.08, "whole": F.col("l_quantity") == F.floor("l_quantity"), "flag": F.col("l_returnflag").isin("A", "N")}
    return L.validate(t("lineitem"), checks).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.concat_ws(",", "errors").alias("errors"))


@query("l11_ref_rewrite", "SELECT l_partkey - CASE WHEN l_partkey % 5 = 1 THEN 1 ELSE 0 END AS l_partkey, count(*) AS n FROM lineitem GROUP BY 1")
def _(t):
    redirect = t("part").where("p_partkey % 5 = 1").select(F.col("p_partkey").alias("old"), (F.col("p_partkey") - 1).alias("new"))
    return L.rewrite_refs(t("lineitem").select("l_partkey"), redirect, "l_partkey").groupBy("l_partkey").agg(F.count("*").alias("n"))


@query("k10_upsert_fill", """
WITH a AS (SELECT c_custkey AS k, CASE WHEN c_acctbal >= 2000 THEN c_mktsegment END AS v FROM customer WHERE c_acctbal >= 0), b AS (SELECT c_custkey AS k, lower(c_mktsegment) AS v FROM customer WHERE c_acctbal < 5000) SELECT k, coalesce(a.v, b.v) AS v FROM a FULL JOIN b USING (k)""")
def _(t):
    c = t("customer")
    a = c.where("c_acctbal >= 0").selectExpr("c_custkey as k", "case when c_acctbal >= 2000 then c_mktsegment end as v")
    return L.upsert_fill(a, c.where("c_acctbal < 5000").selectExpr("c_custkey as k", "lower(c_mktsegment) as v"), "k", ["v"])


@query("k12_upsert_last", "SELECT c_custkey AS k, CASE WHEN c_acctbal < 5000 THEN lower(c_mktsegment) ELSE c_mktsegment END AS v FROM customer")
def _(t):
    c = t("customer")
    return L.upsert_last(c.where("c_acctbal >= 0").selectExpr("c_custkey as k", "c_mktsegment as v"), c.where("c_acctbal < 5000").selectExpr("c_custkey as k", "lower(c_mktsegment) as v"), "k")


@query("k15_reparent", "SELECT DISTINCT CASE WHEN l_suppkey % 4 = 3 THEN l_suppkey - 1 ELSE l_suppkey END AS l_suppkey, l_partkey FROM lineitem")
def _(t):
    redirect = t("supplier").where("s_suppkey % 4 = 3").select(F.col("s_suppkey").alias("old"), (F.col("s_suppkey") - 1).alias("new"))
    return L.reparent(t("lineitem").select("l_suppkey", "l_partkey"), redirect, "l_suppkey")
