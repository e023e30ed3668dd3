"""File sources: JSON lines with line numbers, compressed dumps, CSV gazetteers, nested documents, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def numbered_lines(spark: SparkSession, path, exclude: list[str] = (), pattern: str = "*.jsonl") -> DataFrame:
    """``(file, line_no, value)`` of the lines of text files; blank lines and ``#`` comments keep their number but go.

    Files are split as any text source is.  Lines of one block of a file follow one another in one task, so their running ids give
    their places in the block; the numbers of lines of the blocks before are added from a table of one row per block.  No
    line is shuffled and no file is held whole.  Files named in ``exclude`` are left out.
    """
    lines = spark.read.option("pathGlobFilter", pattern).text(path).select("value", F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"), F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"))
    if exclude:
        lines = lines.where(~F.col("file").isin(list(exclude)))
    blocks = lines.groupBy("_path", "_start").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_path").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select("_path", "_start", "_first", F.coalesce(before, F.lit(0)).alias("_before"))
    numbered = lines.join(F.broadcast(blocks), ["_path", "_start"]).select("file", (F.col("_before") + F.col("_id") - F.col("_first") + 1).cast("int").alias("line_no"), "value")
    return numbered.where("trim(value) <> '' and not startswith(ltrim(value), '#')")


def read_jsonl(spark: SparkSession, path, schema: str, **options) -> DataFrame:
    """``(file, line_no, *fields)``; a line that is no JSON object fails the read with its file and number."""
    lines = numbered_lines(spark, path, **options)
    parsed = lines.withColumn("_r", F.from_json("value", schema, {"mode": "PERMISSIVE"})).withColumn("_ok", F.try_parse_json("value").isNotNull() & F.startswith(F.ltrim("value"), F.lit("{")))
    where = F.concat(F.lit("bad JSON at "), "file", F.lit(":"), F.col("line_no").cast("string"))
    checked = parsed.withColumn("line_no", F.when(F.col("_ok"), F.col("line_no")).otherwise(F.raise_error(where).cast("int")))
    return checked.select("file", "line_no", "_r.*")


def read_events(spark: SparkSession, path, **options) -> DataFrame:
    """``(file, line_no, type, op, ref, fields, lists)`` of the rows of JSON-line ledgers: ``_type``, ``_op`` and ``ref`` by themselves, of the
    other entries those that are arrays in ``lists`` (``map<string,array<string>>``), the rest in ``fields`` (``map<string,string>``), in the order of the line.

    A line that is no JSON object, or that lacks ``_type``, fails the read with its file and number.
    """
    lines = numbered_lines(spark, path, **options)
    # the text of a line is parsed once into a map and once into a value, and every entry looks at those
    lines = lines.withColumn("_m", F.from_json("value", "map<string,string>")).withColumn("_v", F.try_parse_json("value"))
    ok = F.col("_v").isNotNull() & F.startswith(F.ltrim("value"), F.lit("{")) & F.try_element_at("_m", F.lit("_type")).isNotNull()
    where = F.concat(F.lit("bad event at "), "file", F.lit(":"), F.col("line_no").cast("string"))
    lines = lines.withColumn("line_no", F.when(ok, F.col("line_no")).otherwise(F.raise_error(where).cast("int")))
    entries = F.filter(F.map_entries("_m"), lambda e: ~e["key"].isin("_type", "_op", "ref"))
    # an array and a string that looks like one are told apart by the parsed value
    array = lambda e: F.coalesce(F.startswith(e["value"], F.lit("[")) & F.startswith(F.schema_of_variant(F.try_variant_get("_v", F.concat(F.lit('$["'), e["key"], F.lit('"]')), "variant")), F.lit("ARRAY")), F.lit(False))
    lines = lines.withColumn("_e", F.transform(entries, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"), array(e).alias("many"))))
    lists = F.transform(F.filter("_e", lambda e: e["many"]), lambda e: F.struct(e["key"].alias("key"), F.from_json(e["value"], "array<string>").alias("value")))
    fields = F.transform(F.filter("_e", lambda e: ~e["many"]), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))
    at = lambda name: F.try_element_at("_m", F.lit(name))
    return lines.select("file", "line_no", at("_type").alias("type"), at("_op").alias("op"), at("ref").alias("ref"), F.map_from_entries(fields).alias("fields"), F.map_from_entries(lists).alias("lists"))


def compressed_lines(spark: SparkSession, path) -> DataFrame:
    """``(file, value)`` of plain, gzip or Zstandard line files.

    Plain files are split, gzip files are streamed by the text source, and Zstandard files are opened by name inside the tasks and streamed
    frame by frame, so memory does not grow with a file.
    """
    import io

    import pyarrow as pa
    import zstandard
    from pyarrow import fs

    def run(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                place, inner = fs.FileSystem.from_uri(uri)
                with place.open_input_stream(inner, compression=None) as raw:
                    stream = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True)
                    held = []
                    for line in io.TextIOWrapper(stream, "utf-8"):
                        held.append(line.rstrip("\r\n"))
                        if len(held) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array([uri] * len(held)), pa.array(held)], ["path", "value"])
                            held = []
                    if held:
                        yield pa.RecordBatch.from_arrays([pa.array([uri] * len(held)), pa.array(held)], ["path", "value"])

    name = F.element_at(F.split("path", "/"), -1).alias("file")
    plain = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value").where("not endswith(path, '.zst')")
    # only names are read here, and each is a task of its own
    packed = spark.read.format("binaryFile").option("pathGlobFilter", "*.zst").load(path).select("path")
    files = packed.repartition(max(1, packed.count()), "path").mapInArrow(run, "path string, value string")
    return plain.unionByName(files).select(name, "value")


def map_categories(rows: DataFrame, key: str, categories: str, rules: dict[str, str]) -> DataFrame:
    """``(key, tag)``: distinct tags of the keywords contained in an array of category names."""
    table = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in rules.items()])
    x = rows.select(key, F.explode(categories).alias("c"), table.alias("r")).select(key, "c", F.explode("r").alias("r"))
    return x.where(F.contains(F.lower("c"), F.col("r.k"))).select(key, F.col("r.v").alias("tag")).distinct()


def csv_events(spark: SparkSession, path, required: list[str], name: str, year: str | None, default_year: int, window: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """``(places, attestations)`` of a gazetteer CSV with a header.

    Missing columns fail the read.  A blank, unparsable or out-of-window year becomes the default one;
    places are distinct by reference, attestations all kept.
    """
    df = spark.read.option("header", True).option("mode", "FAILFAST").csv(path)
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    y = F.col(year).try_cast("int") if year else F.lit(None).cast("int")
    rows = df.where(f"trim({name}) <> ''").select(F.trim(name).alias("form"), *[F.col(c) for c in df.columns if c not in (name, year)], F.when(y.between(*window), y).otherwise(default_year).alias("date_year"))
    region = "county" if "county" in df.columns else None
    ref = F.concat_ws("@", "form", region) if region else F.col("form")
    rows = rows.withColumn("ref", ref)
    return rows.groupBy("ref").agg(F.min("form").alias("form")), rows.select("ref", "form", "date_year")


def csv_source(spark: SparkSession, path, columns: dict) -> tuple[DataFrame, DataFrame]:
    """:func:`csv_events` by the column map of a source: ``name``, ``year`` (or None), ``default_year``, ``window``, ``required``."""
    return csv_events(spark, path, columns["required"], columns["name"], columns.get("year"), columns["default_year"], columns["window"])


def parse_name_index(lines: DataFrame, value: str) -> DataFrame:
    """``(headform, toponym, county)`` of index lines ``Head: Place (County); Place (County).``; other lines are passed over."""
    head = r"^\s*(\p{Lu}[\w\p{L}'# -]*):\s*(.+?)\.?\s*$"
    x = lines.where(F.col(value).rlike(head)).select(F.regexp_extract(value, head, 1).alias("headform"), F.explode(F.split(F.regexp_extract(value, head, 2), r"\s*;\s*")).alias("p"))
    place = r"^(.+?)\s*\(([^()]+)\)$"
    return x.where(F.col("p").rlike(place)).select("headform", F.regexp_extract("p", place, 1).alias("toponym"), F.regexp_extract("p", place, 2).alias("county"))


def import_seeds(have: DataFrame, seeds: DataFrame) -> DataFrame:
    """``have(id, label, hypernym_id)`` with the groups of ``seeds(label, hypernym)`` that it lacks; ids come from labels, so a
    repeated import adds nothing, and the label above becomes its id where that group is there.  Of several labels above one the least counts."""
    ident = lambda c: F.concat(F.lit("S"), F.left(F.sha2(F.concat(F.lit("="), c), 256), F.lit(16)))
    new = seeds.groupBy("label").agg(F.min("hypernym").alias("hypernym")).join(have, "label", "left_anti").select(ident(F.col("label")).alias("id"), "label", F.when(F.col("hypernym").isNotNull(), ident(F.col("hypernym"))).alias("_up"))
    known = have.select("id").union(new.select("id")).distinct().withColumnRenamed("id", "hypernym_id")
    added = new.join(known, F.col("_up") == F.col("hypernym_id"), "left").select("id", "label", "hypernym_id")
    return have.select("id", "label", "hypernym_id").unionByName(added)


def bridge_merges(nodes: DataFrame, ident: str, language: str, form: str, table: dict[str, str]) -> DataFrame:
    """``(id, merged_into)``: nodes whose form a hand table maps to another form that their language has (its lowest id)."""
    to = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    winners = nodes.groupBy(F.col(language).alias("_l"), F.col(form).alias("_f")).agg(F.min(ident).alias("merged_into"))
    named = nodes.withColumn("_to", F.try_element_at(to, F.col(form))).where("_to is not null")
    return named.join(winners, (F.col(language) == F.col("_l")) & (F.col("_to") == F.col("_f"))).where(F.col(ident) != F.col("merged_into")).select(ident, "merged_into")


def flatten_gazetteer(rows: DataFrame, column: str) -> DataFrame:
    """``(country, region, name)`` from JSON text ``{country: {region: [names]}}``."""
    x = rows.select(F.explode(F.from_json(column, "map<string,map<string,array<string>>>")).alias("country", "r"))
    return x.select("country", F.explode("r").alias("region", "n")).select("country", "region", F.explode("n").alias("name"))


def parse_derivation(text: Column, languages: list[str]) -> Column:
    """Elements (language, form, gloss) of ``lang form - gloss; ...``; a chunk that names no known language continues
    the gloss before it."""
    chunks = F.filter(F.split(text, r"\s*;\s*"), lambda c: c != "")
    pattern = r"^(" + "|".join(sorted(languages, key=len, reverse=True)) + r")\s+(\S+)(?:\s+-\s+(.*))?$"
    kind = "array<struct<language:string,form:string,gloss:string>>"

    def step(acc, c):
        new = F.struct(F.regexp_extract(c, pattern, 1).alias("language"), F.regexp_extract(c, pattern, 2).alias("form"), F.regexp_extract(c, pattern, 3).alias("gloss"))
        last = F.element_at(acc, -1)
        longer = F.struct(last["language"].alias("language"), last["form"].alias("form"), F.concat_ws("; ", last["gloss"], c).alias("gloss"))
        return F.when(c.rlike(pattern), F.concat(acc, F.array(new))).when(F.size(acc) > 0, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(longer))).otherwise(acc)

    start = F.array(F.struct(F.lit("").alias("language"), F.lit("").alias("form"), F.lit("").alias("gloss")))
    full = F.aggregate(chunks, F.slice(start, 1, 0).cast(kind), lambda acc, c: F.when(F.size(acc) == 0, F.when(c.rlike(pattern), F.array(F.struct(F.regexp_extract(c, pattern, 1).alias("language"), F.regexp_extract(c, pattern, 2).alias("form"), F.regexp_extract(c, pattern, 3).alias("gloss"))).cast(kind)).otherwise(acc)).otherwise(step(acc, c).cast(kind)))
    return full


def split_entries(text: Column, head: str = r"(?m)^(?=[A-Z][A-Z-]+\b[,.])") -> Column:
    """The entries of a dictionary text: each starts at a line with a headword in capitals."""
    return F.filter(F.split(text, head), lambda e: F.trim(e) != "")


def parse_sections(df: DataFrame, ident: str, text: str, head: str = r"^\s*([A-Z][\w-]*)[,.]\s*") -> DataFrame:
    """``(ident, head, body)``: the entries of a text; runs of blanks and line breaks in a body are one blank.  What stands before the first
    headword is no entry."""
    e = df.select(ident, F.explode(split_entries(F.col(text), r"(?m)^(?=[A-Z][A-Z\d-]+[,.])")).alias("e")).where(F.col("e").rlike(head))
    body = F.trim(F.regexp_replace(F.regexp_replace("e", head, ""), r"\s+", " "))
    return e.select(ident, F.regexp_extract("e", head, 1).alias("head"), body.alias("body"))


def clean_ocr(text: Column) -> Column:
    """Running headers and page numbers dropped, ligatures and hyphenated line ends mended."""
    out = F.regexp_replace(text, r"(?m)^\s*(?:\d+|[A-Z][A-Z .]{3,}\s+\d+|\d+\s+[A-Z][A-Z .]{3,})\s*$\n?", "")
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(out, "ﬁ", "fi"), "ﬂ", "fl"), "ﬀ", "ff")
    return F.regexp_replace(out, r"(\p{L})-\n(\p{Ll})", "$1$2")


def etymology_chain(text: Column, languages: list[str]) -> Column:
    """Links ``(language, word)`` of "from Old English tun, from Proto-Germanic *tunaz", left to right."""
    names = "|".join(sorted(languages, key=len, reverse=True))
    pattern = rf"({names})\s+(\*?[\p{{L}}]+)"
    return F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("language"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("word"))


def chain_edges(rows: DataFrame, key: str, chain: str) -> DataFrame:
    """``(key, child, parent)`` between neighbours of a chain column."""
    x = rows.select(key, F.posexplode(chain).alias("i", "c"))
    ref = F.concat_ws(":", F.lower("c.language"), F.col("c.word"))
    w = Window.partitionBy(key).orderBy("i")
    return x.select(key, ref.alias("child"), F.lead(ref).over(w).alias("parent")).where("parent is not null")


def verify_manifest(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """``(name, status)``: ok, mismatch or missing, for each ``manifest(name, sha256)`` row against binary ``files(path, content)``."""
    have = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("found"))
    j = manifest.join(have, "name", "left")
    return j.select("name", F.when(F.col("found").isNull(), "missing").when(F.col("found") == F.col("sha256"), "ok").otherwise("mismatch").alias("status"))


def html_text(html: Column) -> Column:
    """The visible text of a page: scripts, styles and comments dropped, tags to blanks, common entities decoded."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def report_metrics(lines: DataFrame, file: str, value: str) -> DataFrame:
    """``(category, metric, value_num)`` of report lines ``name: number``."""
    p = r"^\s*([A-Za-z][\w .-]*?)\s*[:=]\s*(-?\d+(?:\.\d+)?)\s*$"
    x = lines.where(F.col(value).rlike(p))
    return x.select(F.regexp_replace(file, r"\.[^.]*$", "").alias("category"), F.regexp_extract(value, p, 1).alias("metric"), F.regexp_extract(value, p, 2).cast("double").alias("value_num"))


def with_schema(spark: SparkSession, path, schema: StructType | str, fmt: str = "parquet", **options) -> DataFrame:
    """A table of a declared schema; nothing is inferred."""
    return spark.read.format(fmt).options(**options).schema(schema).load(path)
