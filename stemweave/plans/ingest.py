"""Queries that write files from the driver tables and read them back through the sources."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph as G
from ..sources import dictionary as C
from ..sources import files as S
from ..sources import gazetteers as Z
from ..sources import sections as D
from ..sources import sinks as K
from ..sources.publish import publish, read_published
from .registry import query


def _place(df: DataFrame) -> str:
    """A folder of its own that all executors share."""
    return G.scratch(df.sparkSession, "files")


_LINES = """x AS (SELECT l_returnflag || strftime(l_shipdate, '%m') || '.jsonl' AS file, CASE l_linenumber WHEN 6 THEN '' WHEN 7 THEN ' # note' ELSE '{"k":' || l_orderkey || ',"p":' || l_partkey || '}' END AS value,
  row_number() OVER (PARTITION BY l_returnflag, strftime(l_shipdate, '%m') ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS line_no, l_orderkey AS k, l_partkey AS p FROM lineitem)"""


def _logs(t) -> str:
    """Ledgers of JSON lines with blank and comment lines, one for each return flag and ship month, each written by a task of its own."""
    body = F.concat(F.lit('{"k":'), "l_orderkey", F.lit(',"p":'), "l_partkey", F.lit("}"))
    lines = t("lineitem").withColumn("value", F.when(F.col("l_linenumber") == 6, "").when(F.col("l_linenumber") == 7, " # note").otherwise(body)).withColumn("file", F.concat("l_returnflag", F.date_format("l_shipdate", "MM")))
    path = _place(lines)
    K.ledgers(lines, path, "file", "value", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])
    return path


@query("c01_jsonl_scan", f"WITH {_LINES} SELECT file, CAST(line_no AS INTEGER) AS line_no, k, p FROM x WHERE value LIKE '{{%'")
def _(t):
    return S.read_jsonl(t("lineitem").sparkSession, _logs(t), "k bigint, p bigint")


@query("c02_directory_scan", f"WITH {_LINES} SELECT file, CAST(line_no AS INTEGER) AS line_no, value FROM x WHERE value LIKE '{{%' AND file NOT IN ('R01.jsonl', 'A07.jsonl')")
def _(t):
    return S.numbered_lines(t("lineitem").sparkSession, _logs(t), exclude=["R01.jsonl", "A07.jsonl"])


@query("c03_compressed_scan", """
SELECT CASE WHEN c_mktsegment = 'BUILDING' THEN 'txt' WHEN c_mktsegment = 'MACHINERY' THEN 'gz' ELSE 'zst' END AS kind, c_custkey || ' ' || c_name AS value FROM customer""")
def _(t):
    c = t("customer").select("c_mktsegment", F.concat_ws(" ", "c_custkey", "c_name").alias("value"))
    path = _place(c)
    c.where("c_mktsegment = 'BUILDING'").select("value").write.text(f"{path}/plain")
    c.where("c_mktsegment = 'MACHINERY'").select("value").write.option("compression", "gzip").text(f"{path}/gz")
    K.zstandard_lines(c.where("c_mktsegment not in ('BUILDING', 'MACHINERY')").repartition(3), f"{path}/zst", "value")
    lines = S.compressed_lines(c.sparkSession, [f"{path}/{k}" for k in ("plain", "gz", "zst")])
    return lines.select(F.regexp_extract("file", r"\.(\w+)$", 1).alias("kind"), "value")


_ENTRIES = """e AS (SELECT p_partkey AS k, lower(p_type) AS lang, 'w' || p_partkey AS word, p_size AS s, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b, p_size % 6 AS shape FROM part),
up AS (SELECT lang || ':' || word AS child, 'anc:*r' || s AS parent, 'inheritance' AS edge_type FROM e WHERE shape = 0
  UNION SELECT lang || ':' || word, lang || ':' || unnest([a, b]), 'compound' FROM e WHERE shape = 1
  UNION SELECT lang || ':' || word, 'ine-pro:*' || unnest(['x' || s, 'y']), 'inheritance' FROM e WHERE shape = 2
  UNION SELECT lang || ':' || word, lang || ':long' || k, 'derivation' FROM e WHERE shape = 3),
down AS (SELECT 'fr:d' || k AS child, lang || ':' || word AS parent, 'borrowing' AS edge_type FROM e WHERE shape = 5
  UNION SELECT 'es:e' || s, 'fr:d' || k, 'inheritance' FROM e WHERE shape = 5 UNION SELECT 'pt:f', 'es:e' || s, 'calque' FROM e WHERE shape = 5)"""


def _entries(t) -> DataFrame:
    """Dictionary entries of every shape of template, written as JSON lines and read back by the source."""
    text = lambda x: F.lit(f'"{x}"')

    def template(name, *args):
        inside = F.concat_ws(",", *[F.concat(text(i + 1), F.lit(':"'), a, F.lit('"')) for i, a in enumerate(args)])
        return F.concat(F.lit(f'[{{"name":"{name}","args":{{'), inside, F.lit("}}]"))

    p = t("part").select(F.lower("p_type").alias("lang"), F.concat(F.lit("w"), "p_partkey").alias("word"), (F.col("p_size") % 6).alias("shape"), F.col("p_size").cast("string").alias("s"), F.col("p_partkey").cast("string").alias("k"), F.split("p_name", " ").alias("w"))
    shape = F.col("shape")
    templates = (
        F.when(shape == 0, template("inh", F.col("lang"), F.lit("anc"), F.concat(F.lit("*r"), "s"))).when(shape == 1, template("af", F.col("lang"), F.col("w")[0], F.col("w")[1]))
        .when(shape == 2, template("root", F.col("lang"), F.lit("ine-pro"), F.concat(F.lit("*x"), "s"), F.lit("*y"))).when(shape == 3, template("clipping", F.col("lang"), F.concat(F.lit("long"), "k")))
        .when(shape == 4, template("cog", F.lit("de"), F.lit("fr"), F.lit("x"))).otherwise(F.lit("[]"))
    )
    tree = F.when(shape == 5, F.concat(F.lit('[{"lang_code":"fr","word":"d'), "k", F.lit('","raw_tags":["borrowed"],"descendants":[{"lang_code":"es","word":"e'), "s", F.lit('","descendants":[{"lang_code":"pt","word":"f","tags":["calque"]}]}]}]')))
    line = F.concat(F.lit('{"word":"'), "word", F.lit('","lang_code":"'), "lang", F.lit('","senses":[{"glosses":["'), F.col("w")[1], F.lit('","zz"]}],"categories":["c'), "s", F.lit('"],"forms":[{"form":"'), F.upper("word"), F.lit('"}],"etymology_templates":'), templates, F.coalesce(F.concat(F.lit(',"descendants":'), tree), F.lit("")), F.lit("}"))
    path = _place(p)
    p.select(line.alias("value")).write.text(path)
    return C.read_entries(p.sparkSession, path)


@query("c04_dictionary_words", f"""
WITH {_ENTRIES}, r AS (SELECT lang || ':' || word AS ref FROM e UNION SELECT child FROM up UNION SELECT parent FROM up UNION SELECT child FROM down UNION SELECT parent FROM down)
SELECT ref, split_part(ref, ':', 1) AS lang, substr(ref, instr(ref, ':') + 1) AS form, b AS gloss FROM r LEFT JOIN e ON ref = e.lang || ':' || word""")
def _(t):
    return C.ingest(_entries(t))["words"]


@query("c04_dictionary_tags", f"WITH {_ENTRIES} SELECT lang || ':' || word AS ref, 'c' || s AS tag, upper(word) AS variant FROM e")
def _(t):
    tables = C.ingest(_entries(t))
    return tables["tags"].join(tables["variants"].withColumnRenamed("form", "variant"), "ref")


@query("c05_template_edges", f"WITH {_ENTRIES} SELECT child, parent, edge_type FROM up UNION SELECT child, parent, edge_type FROM down")
def _(t):
    return C.ingest(_entries(t))["edges"]


@query("c06_category_tags", """
SELECT DISTINCT p_partkey, tag FROM part, (VALUES ('old', 'aged'), ('ring', 'round'), ('economy', 'cheap'), ('small', 'little')) AS r(k, tag) WHERE contains(lower(p_name), k) OR contains(lower(p_type), k)""")
def _(t):
    rows = t("part").select("p_partkey", F.array(F.concat(F.lit("Things: "), "p_name"), F.upper("p_type")).alias("cats"))
    return S.map_categories(rows, "p_partkey", "cats", {"old": "aged", "ring": "round", "economy": "cheap", "small": "little"})


_CSV = """x AS (SELECT c_name AS form, n_name AS county, CASE c_custkey % 4 WHEN 0 THEN CAST(1660 + c_custkey % 20 AS VARCHAR) WHEN 1 THEN 'x' ELSE NULL END AS y FROM customer JOIN nation ON n_nationkey = c_nationkey)"""


def _gazetteer(t, name: str, year: str) -> tuple:
    c = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    text = F.when(F.col("c_custkey") % 4 == 0, (1660 + F.col("c_custkey") % 20).cast("string")).when(F.col("c_custkey") % 4 == 1, "x")
    c = c.select(F.col("c_name").alias(name), F.col("n_name").alias("county"), text.alias(year))
    path = _place(c)
    c.union(c.limit(0)).write.option("header", True).csv(path)
    return c.sparkSession, path


@query("c07_csv_attestations", f"WITH {_CSV} SELECT form || '@' || county AS ref, form, CAST(CASE WHEN try_cast(y AS INTEGER) BETWEEN 1662 AND 1674 THEN try_cast(y AS INTEGER) ELSE 1665 END AS INTEGER) AS date_year FROM x")
def _(t):
    spark, path = _gazetteer(t, "place_name", "year")
    return S.csv_events(spark, path, ["place_name", "county"], "place_name", "year", 1665, (1662, 1674))[1]


@query("c08_csv_source_map", f"WITH {_CSV} SELECT DISTINCT form || '@' || county AS ref, form, 1279 AS date_year FROM x")
def _(t):
    """A source with columns of its own names, whose entries all have the source's year."""
    spark, path = _gazetteer(t, "vill", "notes")
    places, facts = S.csv_source(spark, path, {"name": "vill", "year": None, "default_year": 1279, "window": (1279, 1280), "required": ["vill", "county"]})
    return places.join(facts.select("ref", "date_year").distinct(), "ref")


@query("c10_derivations", """
WITH x AS (SELECT p_partkey AS k, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part)
SELECT k, 'OE' AS language, a AS form, b || '; more' AS gloss FROM x UNION ALL SELECT k, 'ON', b, '' FROM x""")
def _(t):
    w = F.split("p_name", " ")
    x = t("part").select(F.col("p_partkey").alias("k"), F.concat(F.lit("OE "), w[0], F.lit(" - "), w[1], F.lit("; more; ON "), w[1]).alias("d"))
    return x.select("k", F.explode(S.parse_derivation(F.col("d"), ["OE", "ON"])).alias("e")).select("k", "e.language", "e.form", "e.gloss")


@query("c14_ocr_cleanup", "SELECT p_partkey, 'field' || split_part(p_name, ' ', 1) || ' off' || chr(10) AS clean FROM part")
def _(t):
    w = F.split("p_name", " ")
    page = F.concat(F.lit("THE BOOK 12\nﬁeld-\n"), w[0], F.lit(" oﬀ\n "), "p_size", F.lit(" \n"))
    return t("part").select("p_partkey", S.clean_ocr(page).alias("clean"))


@query("c15_etymology_prose", """
WITH x AS (SELECT p_partkey AS k, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part)
SELECT k, 'middle english:' || a AS child, 'old english:' || b AS parent FROM x UNION ALL SELECT k, 'old english:' || b, 'proto-germanic:*' || a FROM x""")
def _(t):
    w = F.split("p_name", " ")
    text = F.concat(F.lit("From Middle English "), w[0], F.lit(", from Old English "), w[1], F.lit(", from Proto-Germanic *"), w[0], F.lit("."))
    rows = t("part").select(F.col("p_partkey").alias("k"), S.etymology_chain(text, ["Old English", "Middle English", "Proto-Germanic"]).alias("c"))
    return S.chain_edges(rows, "k", "c")


@query("c17_manifest", "SELECT r_name || '.txt' AS name, CASE WHEN r_regionkey % 2 = 0 THEN 'ok' ELSE 'mismatch' END AS status FROM region UNION ALL SELECT 'absent.txt', 'missing'")
def _(t):
    """Files of the nations of each region against a manifest that is wrong for every second one and names one too many."""
    n = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    path = _place(n)
    names = [r.r_name for r in t("region").select("r_name").limit(100).collect()]
    for name in names:
        K.named_lines(n.where(F.col("r_name") == name), f"{path}/{name}.txt", "n_name", ["n_name"])
    body = n.groupBy("r_name", "r_regionkey").agg(F.concat(F.array_join(F.array_sort(F.collect_list("n_name")), "\n"), F.lit("\n")).alias("b"))
    manifest = body.select(F.concat("r_name", F.lit(".txt")).alias("name"), F.when(F.col("r_regionkey") % 2 == 0, F.sha2("b", 256)).otherwise("0").alias("sha256")).union(n.limit(1).select(F.lit("absent.txt"), F.lit("0")))
    return S.verify_manifest(n.sparkSession.read.format("binaryFile").load(path), manifest)


@query("c22_report_lines", "SELECT lower(p_type) AS category, replace(p_brand, '#', ' ') || ' size' AS metric, round(avg(p_size), 2) AS value_num FROM part GROUP BY lower(p_type), p_type, p_brand")
def _(t):
    g = t("part").groupBy("p_type", "p_brand").agg(F.round(F.avg("p_size"), 2).alias("v"))
    lines = g.select(F.concat(F.lower("p_type"), F.lit(".md")).alias("file"), F.explode(F.array(F.lit("# Report"), F.concat(F.replace("p_brand", F.lit("#"), F.lit(" ")), F.lit(" size: "), F.col("v").cast("string")), F.lit(""))).alias("value"))
    path = _place(lines)
    lines.write.partitionBy("file").text(path)
    return S.report_metrics(lines.sparkSession.read.text(path), "file", "value")


@query("c21_seed_import", """
WITH h AS (SELECT DISTINCT p_type AS label FROM part), s AS (SELECT p_brand AS label, min(p_type) AS up FROM part GROUP BY 1)
SELECT 'S' || left(sha256('=' || label), 16) AS id, label, NULL AS hypernym_id FROM h UNION ALL SELECT 'S' || left(sha256('=' || label), 16), label, 'S' || left(sha256('=' || up), 16) FROM s""")
def _(t):
    """Groups named by label, each once whatever is there already, with the id of the group above them."""
    seeds = t("part").select(F.col("p_type").alias("label"), F.lit(None).cast("string").alias("hypernym")).distinct().union(t("part").groupBy("p_brand").agg(F.min("p_type")))
    have = S.import_seeds(seeds.limit(0).select(F.lit("").alias("id"), "label", F.lit("").alias("hypernym_id")), seeds.where("hypernym is null"))
    return S.import_seeds(have, seeds)


@query("k04_gold_tables", """
WITH w AS (SELECT p_type AS culture, p_name AS word, sum(p_size) AS weight FROM part GROUP BY 1, 2) SELECT culture, word, weight, sum(weight) OVER (PARTITION BY culture ORDER BY word) AS cumulative FROM w""")
def _(t):
    return read_published(t("part").sparkSession, _gold(t), K.GOLD)["words"]


def _gold(t) -> str:
    p = t("part").select(F.col("p_type").alias("culture"), F.col("p_name").alias("word"), F.col("p_brand").alias("structure"), F.col("p_size").alias("weight"))
    path = _place(p)
    for _ in range(2):  # the second call replaces the tables of the first
        K.gold_tables(p.select("culture", "word", "weight"), p.select("culture", "structure", "weight"), path, "culture", "weight", "word", "structure")
    return path


@query("c19_bundle", """
WITH w AS (SELECT p_type AS culture, p_name AS word, sum(p_size)::BIGINT AS weight FROM part GROUP BY 1, 2), s AS (SELECT p_type AS culture, p_brand AS structure, sum(p_size)::BIGINT AS weight FROM part GROUP BY 1, 2),
wc AS (SELECT *, (sum(weight) OVER (PARTITION BY culture ORDER BY word))::BIGINT AS cumulative FROM w), sc AS (SELECT *, (sum(weight) OVER (PARTITION BY culture ORDER BY structure))::BIGINT AS cumulative FROM s)
SELECT culture, to_json({'n': n, 'total': total, 'structures': structures, 'words': words})::VARCHAR AS bundle FROM (SELECT p_type AS culture, count(*) AS n, sum(p_size)::BIGINT AS total FROM part GROUP BY 1)
JOIN (SELECT culture, list({'word': word, 'weight': weight, 'cumulative': cumulative} ORDER BY word) AS words FROM wc GROUP BY 1) USING (culture) JOIN (SELECT culture, list({'structure': structure, 'weight': weight, 'cumulative': cumulative} ORDER BY structure) AS structures FROM sc GROUP BY 1) USING (culture)""")
def _(t):
    return K.read_bundle(t("part").sparkSession, _gold(t), "culture", "weight", "word", "structure")


@query("k06_priors_sidecar", """
WITH x AS (SELECT p_brand AS k, count(*) AS n, sum(p_size)::BIGINT AS s FROM part GROUP BY 1) SELECT CAST(row_number() OVER (ORDER BY k) AS INTEGER) AS line_no, to_json({'k': k, 'n': n, 's': s})::VARCHAR AS value FROM x""")
def _(t):
    spark, path = _sidecar(t)
    return S.numbered_lines(spark, path, pattern="*.json").select("line_no", "value")


def _sidecar(t) -> tuple:
    x = t("part").groupBy(F.col("p_brand").alias("k")).agg(F.count("*").alias("n"), F.sum("p_size").alias("s"))
    path = _place(x)
    K.json_sidecar(x, f"{path}/priors.json", "k")
    return x.sparkSession, path


@query("z19_payload_loader", "SELECT p_brand AS k, sum(p_size) / count(*) AS rate FROM part GROUP BY 1")
def _(t):
    """The priors of the sidecar as a table again."""
    spark, path = _sidecar(t)
    return S.read_jsonl(spark, path, "k string, n bigint, s bigint", pattern="*.json").select("k", (F.col("s") / F.col("n")).alias("rate"))


@query("k08_csv_report", "SELECT p_brand, count(*) AS n, CAST(round(avg(p_size), 2) AS VARCHAR) AS size FROM part GROUP BY 1")
def _(t):
    r = t("part").groupBy("p_brand").agg(F.count("*").alias("n"), F.round(F.avg("p_size"), 2).cast("string").alias("size"))
    path = _place(r)
    K.csv_report(r, path, ["p_brand"])
    return r.sparkSession.read.option("header", True).schema("p_brand string, n bigint, size string").csv(path)


@query("k13_replace_all", "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY 1")
def _(t):
    """A table that is replaced as a whole: nothing of the first version is left."""
    c = t("customer")
    path = f"{_place(c)}/gold"
    for part in (c.groupBy("c_mktsegment").agg(F.count("*").alias("n")), c.where("c_acctbal > 0").groupBy("c_mktsegment").agg(F.count("*").alias("n"))):
        publish({"gold": part}, path, "1")
    return read_published(c.sparkSession, path, "1")["gold"]


@query("g07_cycle_breaking", """
WITH RECURSIVE x AS (SELECT c_nationkey AS a, s_nationkey AS b, min(l_orderkey) AS o FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2),
e AS (SELECT a, b, o, row_number() OVER (ORDER BY o, a, b) AS k FROM x), r AS (SELECT k, a AS node FROM e UNION SELECT r.k, CASE WHEN e.a = node THEN e.b ELSE e.a END FROM r JOIN e ON e.k < r.k AND (e.a = node OR e.b = node))
SELECT a, b, o, NOT EXISTS (SELECT 1 FROM r WHERE r.k = e.k AND r.node = e.b) AS kept FROM e""")
def _(t):
    """Trade between nations in order of its first order: an edge that closes a cycle goes."""
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    e = j.groupBy(F.col("c_nationkey").alias("a"), F.col("s_nationkey").alias("b")).agg(F.min("l_orderkey").alias("o"))
    return G.break_cycles(e, "a", "b", "o")


@query("x04_bridges", """
WITH n AS (SELECT c_custkey AS id, lower(c_mktsegment) AS lang, 'Name' || c_custkey % 50 AS form FROM customer), m AS (SELECT lang, form, min(id) AS id FROM n GROUP BY 1, 2), b AS (SELECT * FROM (VALUES ('Name1', 'Name2'), ('Name3', 'Name4'), ('Name5', 'Nowhere')) AS v(a, z))
SELECT n.id, w.id AS merged_into FROM n JOIN b ON b.a = n.form JOIN m w ON w.lang = n.lang AND w.form = b.z""")
def _(t):
    """A hand table of spellings: each form is merged into the other one of its language where both are there."""
    n = t("customer").select(F.col("c_custkey").alias("id"), F.lower("c_mktsegment").alias("lang"), F.concat(F.lit("Name"), F.col("c_custkey") % 50).alias("form"))
    return S.bridge_merges(n, "id", "lang", "form", {"Name1": "Name2", "Name3": "Name4", "Name5": "Nowhere"})


_INDEX = r"""x AS (SELECT n_name AS head, upper(c_mktsegment) AS place, r_name AS county, c_custkey % 3 AS k FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)"""


@query("c11_name_index", f"WITH {_INDEX} SELECT DISTINCT head AS headform, place AS toponym, county FROM x WHERE k < 2")
def _(t):
    """An index of names as text: a head and its places with their counties; heads without places and stray lines are passed over."""
    c = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    place = F.concat(F.upper("c_mktsegment"), F.lit(" ("), "r_name", F.lit(")"))
    g = c.groupBy("n_name").agg(F.array_join(F.array_sort(F.collect_set(F.when(F.col("c_custkey") % 3 < 2, place))), "; ").alias("p"))
    lines = g.select(F.explode(F.array(F.lit("INDEX 12"), F.concat("n_name", F.lit(": "), "p", F.lit(".")), F.lit(""))).alias("value"))
    path = _place(lines)
    lines.write.text(path)
    return S.parse_name_index(lines.sparkSession.read.text(path), "value").distinct()


@query("c13_sections", """
SELECT r_name AS section, upper(replace(n_name, '_', '-')) AS head, 'a nation; ' || n_nationkey || ' of all' AS body FROM nation JOIN region ON r_regionkey = n_regionkey""")
def _(t):
    """A dictionary text of one section per region, parsed into headwords and bodies; a line that is no entry belongs to the one before it."""
    j = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    entry = F.concat(F.upper(F.replace("n_name", F.lit("_"), F.lit("-"))), F.lit(", a nation;\n  "), "n_nationkey", F.lit(" of all\n"))
    text = j.groupBy(F.col("r_name").alias("section")).agg(F.array_join(F.array_sort(F.collect_list(entry)), "").alias("text"))
    return S.parse_sections(text, "section", "text")


@query("c16_nested_documents", """
SELECT o_custkey AS owner, o_orderkey AS item, l_returnflag AS trait, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL""")
def _(t):
    """Documents of two nested levels, one per customer, flattened to rows."""
    j = t("orders").join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    items = j.groupBy("o_custkey", "o_orderkey").agg(F.sort_array(F.collect_list("l_returnflag")).alias("traits"))
    docs = items.groupBy("o_custkey").agg(F.to_json(F.struct(F.col("o_custkey").alias("owner"), F.sort_array(F.collect_list(F.struct(F.col("o_orderkey").alias("item"), "traits"))).alias("items"))).alias("value"))
    path = _place(docs)
    docs.select("value").write.text(path)
    read = docs.sparkSession.read.schema("owner bigint, items array<struct<item:bigint,traits:array<string>>>").json(path)
    rows = read.select("owner", F.explode("items").alias("i")).select("owner", "i.item", F.explode("i.traits").alias("trait"))
    return rows.groupBy("owner", "item", "trait").agg(F.count("*").alias("n"))


@query("c16_section_trees", """
WITH l AS (SELECT l_orderkey, string_agg(l_returnflag || l_linenumber, chr(10) || chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey) AS t FROM lineitem GROUP BY 1),
o AS (SELECT o_custkey, string_agg(o_orderpriority || chr(10) || chr(10) || t, chr(10) || chr(10) ORDER BY o_orderkey) AS t FROM orders JOIN l ON l_orderkey = o_orderkey GROUP BY 1)
SELECT c_custkey AS k, c_name || coalesce(chr(10) || chr(10) || t, '') AS text FROM customer LEFT JOIN o ON o_custkey = c_custkey""")
def _(t):
    """Trees of customers, their orders and lines, written as JSON and walked whatever their depth."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("text"))
    texts = lambda c: F.transform(F.sort_array(c), lambda x: F.struct(x["text"].alias("text")))
    items = t("lineitem").groupBy("l_orderkey").agg(texts(F.collect_list(line)).alias("sections"))
    orders = t("orders").join(items, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderpriority", "sections"))), lambda x: F.struct(x["o_orderpriority"].alias("text"), x["sections"].alias("sections"))).alias("sections"))
    docs = t("customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.to_json(F.struct(F.col("c_custkey").alias("k"), F.col("c_name").alias("text"), "sections")).alias("value"))
    path = _place(docs)
    docs.write.text(path)
    read = docs.sparkSession.read.text(path).select(F.parse_json("value").alias("tree")).select(F.variant_get("tree", "$.k", "long").alias("k"), "tree")
    rows = D.section_texts(read, "k", F.col("tree"))
    return rows.groupBy("k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "text"))), lambda x: x["text"]), "\n\n").alias("text"))


@query("c16_named_records", """
WITH d AS (SELECT p_partkey AS o, CASE WHEN p_size % 5 = 0 THEN p_name ELSE split_part(p_name, ' ', 1) || p_size % 4 END AS own, CASE WHEN p_size % 3 = 0 THEN NULL WHEN p_size % 3 = 1 THEN upper(split_part(p_name, ' ', 2)) || ', Great' ELSE 'Two Words' END AS fam, 'about ' || p_brand AS ft, 'of ' || p_type AS fs, 'own ' || p_size AS os FROM part),
f AS (SELECT *, CASE WHEN split_part(fam, ',', 1) NOT LIKE '% %' THEN split_part(fam, ',', 1) END AS root FROM d),
r AS (SELECT o, 0 AS k, root AS name, ft || chr(10) || chr(10) || fs AS description FROM f WHERE root IS NOT NULL UNION ALL SELECT o, 1, own, CASE WHEN fam IS NULL THEN '' ELSE ft || chr(10) || chr(10) || fs || chr(10) || chr(10) END || os FROM f WHERE own NOT LIKE '% %' AND lower(own) IS DISTINCT FROM lower(root))
SELECT DISTINCT ON (lower(name)) name, description, CASE k WHEN 0 THEN 'family' ELSE 'own' END AS kind FROM r ORDER BY lower(name), o, k""")
def _(t):
    """Records of families and single-word names from nested documents, the first of each name."""
    w = F.split("p_name", " ")
    own = F.when(F.col("p_size") % 5 == 0, F.col("p_name")).otherwise(F.concat(w[0], (F.col("p_size") % 4).cast("string")))
    family = F.when(F.col("p_size") % 3 > 0, F.struct(F.when(F.col("p_size") % 3 == 1, F.concat(F.upper(w[1]), F.lit(", Great"))).otherwise("Two Words").alias("name"), F.concat(F.lit("about "), "p_brand").alias("text"), F.array(F.struct(F.concat(F.lit("of "), "p_type").alias("text"))).alias("sections")))
    docs = t("part").select("p_partkey", F.parse_json(F.to_json(F.struct(own.alias("name"), family.alias("family"), F.array(F.struct(F.concat(F.lit("own "), F.col("p_size").cast("string")).alias("text"))).alias("sections")))).alias("tree"))
    return D.named_records(docs, "p_partkey", "tree")


@query("c15_sense_chains", """
WITH x AS (SELECT p_partkey AS k, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part)
SELECT k, a || '(n.1)' AS head, 'middle english:' || a AS child, 'old english:' || b AS parent FROM x UNION ALL SELECT k, a || '(n.1)', 'old english:' || b, 'proto-germanic:*' || a FROM x UNION ALL SELECT k, a || '(v.)', 'old english:' || a, 'proto-germanic:*' || b FROM x""")
def _(t):
    """Entries of two senses and a stray paragraph: each sense with a chain of its own."""
    w = F.split("p_name", " ")
    text = F.concat(F.lit("Of names\nand words.\n\n"), w[0], F.lit("(n.1)\n\nFrom Middle English "), w[0], F.lit(", from Old English "), w[1], F.lit(", from Proto-Germanic *"), w[0], F.lit(".\n\nMore of it.\n \n"), w[0], F.lit("(v.)\n\nfrom Old English "), w[0], F.lit(", from Proto-Germanic *"), w[1], F.lit(".\n\nlast(n.)"))
    senses = t("part").select("p_partkey", F.posexplode(D.split_senses(text)).alias("i", "s"))
    rows = senses.select(F.struct(F.col("p_partkey").alias("k"), F.col("s.head").alias("head")).alias("key"), S.etymology_chain(F.col("s.summary"), ["Old English", "Middle English", "Proto-Germanic"]).alias("c"))
    return S.chain_edges(rows, "key", "c").select("key.k", "key.head", "child", "parent")


@query("k09_ledger_page", """
WITH r AS (SELECT CAST(event_id AS VARCHAR) AS id, ts AS created, event_type AS generator, 'reason ' || event_id % 7 AS reason FROM events WHERE event_type IN ('error', 'click')),
c AS (SELECT CAST(event_id - 1 AS VARCHAR) AS id, max(ts) AS changed, arg_max(CASE WHEN value < 30 THEN 'accepted' ELSE 'dismissed' END, ts) AS status FROM events WHERE event_type = 'view' AND CAST(event_id - 1 AS VARCHAR) IN (SELECT id FROM r) GROUP BY 1)
SELECT id, created, generator, reason FROM r ANTI JOIN c USING (id) WHERE generator = 'error' AND created < TIMESTAMP '2024-01-20' ORDER BY created DESC, id LIMIT 50""")
def _(t):
    """The reports of one kind that are still open, one page of them behind a key, newest first."""
    from ..sources import ledger

    e = t("events")
    path = _place(e)
    reports = e.where("event_type in ('error', 'click')").select(F.col("event_id").cast("string").alias("id"), F.col("ts").alias("at"), F.col("event_type").alias("generator"), F.concat(F.lit("reason "), (F.col("event_id") % 7).cast("string")).alias("reason"))
    ledger.record(reports, path)
    none = F.lit(None).cast("string")
    changes = e.where("event_type = 'view'").select((F.col("event_id") - 1).cast("string").alias("id"), F.col("ts").alias("at"), F.when(F.col("value") < 30, "accepted").otherwise("dismissed").alias("status"), none.alias("ticket"), none.alias("note"))
    ledger.transition(changes.join(reports.select("id"), "id", "left_semi"), path)
    found = ledger.page(ledger.state(ledger.read(e.sparkSession, path)), 50, generator="error", after=(datetime.datetime(2024, 1, 20), ""))
    return found.select("id", "created", "generator", "reason")


_EXPORT = """f AS (SELECT c_custkey % 900 AS idx, CASE WHEN c_custkey % 37 = 0 THEN NULL ELSE c_mktsegment || c_custkey % 70 END AS name, CASE WHEN c_custkey % 29 = 0 THEN '' ELSE 'C' || c_nationkey % 5 END AS county, CASE c_custkey % 11 WHEN 0 THEN 'speculative' WHEN 1 THEN 'unknown' ELSE 'sure' END AS status, 'h' || c_nationkey AS hundred FROM customer),
p AS (SELECT s_suppkey AS idx, 'p' || s_suppkey % 9 AS page FROM supplier WHERE s_acctbal > 0), w AS (SELECT *, CASE WHEN status IN ('speculative', 'unknown') THEN 'uncertain' WHEN name IS NULL THEN 'no name' WHEN county = '' THEN 'no county' END AS why FROM f),
g AS (SELECT name, CASE county WHEN 'C0' THEN 'Kent' WHEN 'C1' THEN 'Powys' ELSE county END AS region, CASE county WHEN 'C1' THEN 'Wales' ELSE 'England' END AS country, coalesce(page, hundred) AS source FROM w LEFT JOIN p USING (idx) WHERE why IS NULL),
h AS (SELECT min(c_custkey) AS id, c_mktsegment || c_custkey % 70 AS name, 'Kent' AS region FROM customer WHERE c_custkey % 2 = 0 GROUP BY 2), tp AS (SELECT g.name, g.region, min(country) AS country, min(h.id) AS id FROM g LEFT JOIN h ON h.name = g.name AND h.region = g.region GROUP BY 1, 2),
fa AS (SELECT DISTINCT g.name, g.region, source, h.id, h.id IS NOT NULL AND source < 'h2' AS there FROM g LEFT JOIN h ON h.name = g.name AND h.region = g.region)"""


def _export(t):
    c, k = t("customer"), F.col("c_custkey")
    name = F.concat("c_mktsegment", (k % 70).cast("string"))
    forms = c.select((k % 900).alias("idx"), F.when(k % 37 != 0, name).alias("name"), F.when(k % 29 == 0, "").otherwise(F.concat(F.lit("C"), (F.col("c_nationkey") % 5).cast("string"))).alias("county"), F.when(k % 11 == 0, "speculative").when(k % 11 == 1, "unknown").otherwise("sure").alias("status"), F.concat(F.lit("h"), "c_nationkey").alias("hundred"), F.lit("grid").alias("grid"))
    places = t("supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("idx"), F.concat(F.lit("p"), (F.col("s_suppkey") % 9).cast("string")).alias("page"))
    have = c.where(k % 2 == 0).groupBy(name.alias("name")).agg(F.min("c_custkey").alias("id")).withColumn("region", F.lit("Kent"))
    cited = forms.join(places, "idx", "left").select("name", F.coalesce("page", "hundred").alias("source")).where("source < 'h2'").distinct()
    attested = have.join(cited, "name").select("id", F.col("name").alias("form"), F.lit(1086).alias("year"), "source")
    return Z.resolve_forms(places, forms, {"C0": ("Kent", "England"), "C1": ("Powys", "Wales")}, have, attested, 1086)


@query("c09_gazetteer_toponyms", f"WITH {_EXPORT} SELECT name, region, country, id FROM tp")
def _(t):
    """Names of an exported gazetteer, found among those that are there or new."""
    return _export(t)["toponyms"]


@query("c09_gazetteer_attestations", f"WITH {_EXPORT} SELECT name, region, 1086 AS year, source FROM fa WHERE NOT there")
def _(t):
    return _export(t)["attestations"]


@query("c09_gazetteer_counts", f"""WITH {_EXPORT} SELECT coalesce(why, 'taken') AS what, count(*) AS n FROM w GROUP BY 1 UNION ALL SELECT 'new names', count(*) FROM tp WHERE id IS NULL UNION ALL SELECT 'known names', count(*) FROM tp WHERE id IS NOT NULL
UNION ALL SELECT 'new attestations', count(*) FROM fa WHERE NOT there UNION ALL SELECT 'known attestations', count(*) FROM fa WHERE there""")
def _(t):
    return _export(t)["counts"]


@query("c10_derivation_cells", """
WITH x AS (SELECT p_partkey AS k, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b, p_size % 3 AS s FROM part)
SELECT k, 'old-english' AS language, a AS form, CASE WHEN s = 2 THEN NULL ELSE b || '; a ' || a || '; more' END AS gloss, 1 AS unmapped, CASE WHEN s = 0 THEN 1 WHEN s = 2 THEN 2 ELSE 0 END AS dropped FROM x
UNION ALL SELECT k, 'old-norse', b, 'the ' || a, 1, CASE WHEN s = 0 THEN 1 WHEN s = 2 THEN 2 ELSE 0 END FROM x""")
def _(t):
    """Cells whose glosses hold semicolons, with an element of an unknown language and pieces that continue nothing."""
    w, s = F.split("p_name", " "), F.col("p_size") % 3
    first = F.concat(w[0], F.lit(" Old English"), F.when(s == 2, F.lit("")).otherwise(F.concat(F.lit(" - "), w[1])))
    text = F.concat(F.when(s == 0, F.lit("stray; ")).otherwise(F.lit("")), first, F.lit("; a "), w[0], F.lit("; more; x Pictish - lost; "), w[1], F.lit(" Old Norse - the "), w[0])
    x = t("part").select(F.col("p_partkey").alias("k"), Z.derivation(text, {"Old English": "old-english", "Old Norse": "old-norse"}).alias("d"))
    return x.select("k", "d.unmapped", "d.dropped", F.explode("d.elements").alias("e")).select("k", "e.language", "e.form", "e.gloss", "unmapped", "dropped")


@query("c10_matched_names", """
WITH a AS (SELECT DISTINCT w FROM (SELECT unnest(regexp_extract_all(regexp_replace(text, '[^\x00-\x7F]', '~', 'g'), '[A-Z][a-z]{3,}')) AS w FROM documents)), i AS (SELECT DISTINCT unnest(regexp_extract_all(regexp_replace(text, '[^\x00-\x7F]', '~', 'g'), '[A-Z][a-z]{4,}')) AS f FROM benchmark),
k AS (SELECT lower(f) AS k, min(f) AS f FROM i GROUP BY 1), n AS (SELECT a.w, arg_min(k.f, k.k) AS f FROM a JOIN k ON abs(length(w) - length(k)) <= 1 AND levenshtein(lower(w), k) = 1 GROUP BY 1)
SELECT a.w AS name, coalesce(k.f, n.f) AS form, CASE WHEN coalesce(k.f, n.f) IS NOT NULL THEN 'x' END AS language, CASE WHEN k.f IS NOT NULL THEN 't1' WHEN n.f IS NOT NULL THEN 't2' ELSE 'miss' END AS tier FROM a LEFT JOIN k ON k.k = lower(w) LEFT JOIN n ON n.w = a.w""")
def _(t):
    """Capitalised words of all documents looked up among those of the benchmark, by their letters or one letter off."""
    words = lambda df, n: df.select(F.explode(F.regexp_extract_all(F.regexp_replace("text", r"[^\x00-\x7F]", "~"), F.lit(f"([A-Z][a-z]{{{n},}})"), F.lit(1))).alias("form"))
    return Z.match_names(words(t("documents"), 3), "form", words(t("benchmark"), 4).distinct().withColumn("language", F.lit("x")))


@query("k01_canonical_dump", """
WITH m AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 1 THEN p_partkey - 1 END AS winner FROM part WHERE p_size <= 45), r AS (SELECT l_returnflag AS source, coalesce(winner, id) AS part, l_orderkey AS o, l_linenumber AS n FROM lineitem JOIN m ON id = l_partkey)
SELECT source, to_json({'o': o, 'n': n, 'part': part})::VARCHAR AS line, count(*) AS copies FROM r GROUP BY 1, 2 UNION ALL SELECT 'orphans', CAST(count(*) AS VARCHAR), 1 FROM lineitem WHERE l_partkey NOT IN (SELECT id FROM m)""")
def _(t):
    """Rows of each source dumped in a fixed order, with merged parts re-pointed, read back; those that name no part are counted."""
    merged = t("part").where("p_size <= 45").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 5 == 1, F.col("p_partkey") - 1).alias("winner"))
    rows, orphans = K.repointed(t("lineitem").select(F.col("l_returnflag").alias("source"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("part")), "part", merged)
    path = _place(rows)
    K.canonical_dump(rows, path, "source", ["o", "n", "part"])
    back = rows.sparkSession.read.text(path, recursiveFileLookup=True).select(F.regexp_extract("_metadata.file_path", "source=([^/]*)/", 1).alias("source"), F.col("value").alias("line"))
    return back.groupBy("source", "line").agg(F.count("*").alias("copies")).unionByName(orphans.agg(F.count("*").alias("n")).select(F.lit("orphans").alias("source"), F.col("n").cast("string").alias("line"), F.lit(1).cast("long").alias("copies")))
