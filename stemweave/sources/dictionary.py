"""Bulk dictionary source: nested entries to words, variants, tags and typed descent edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import stored_with

ENTRY = (
    "word string, lang_code string, pos string, senses array<struct<glosses:array<string>>>, forms array<struct<form:string,tags:array<string>>>, "
    "categories array<string>, etymology_templates array<struct<name:string,args:map<string,string>>>, descendants string"
)
_NODE = "array<struct<word:string,lang_code:string,tags:array<string>,raw_tags:array<string>,descendants:string>>"

# Template names by the shape of their arguments, and the edge type they state.
#: argument 2 is the parent's language, argument 3 its word
ACROSS = {
    "inheritance": ["inh", "inherited", "inh+", "inh-lite"],
    "borrowing": ["bor", "borrowed", "bor+", "lbor", "ubor"],
    "derivation": ["der", "derived", "der+", "der-lite/lang", "uder"],
    "calque": ["cal", "calque", "clq", "semantic loan", "sl"],
}
#: argument 2 is the parents' language, arguments 3 and on are words, each an inheritance
ROOTS = ["root"]
#: argument 1 is the entry's own language, arguments 2 and on are its parts, each a compound edge
PARTS = ["compound", "compound+", "com", "com+", "prefix", "pre", "suffix", "suf", "af", "affix", "confix", "blend", "univerbation"]
#: argument 1 is the entry's own language, argument 2 the word it is derived from
SAME_LANGUAGE = [
    "clipping", "bf", "back-formation", "back-form", "contraction", "deverbal", "nom", "nominalization", "syncope", "alternative form of", "abbreviation", "reduplication",
    "contr", "sync", "apocopic form", "metathesis", "past participle of", "alt form", "abbrev", "vrd",
]
#: tags of a descendant that make its edge something else than an inheritance
DESCENDANT_TAGS = {"calque": "calque", "borrowed": "borrowing", "borrowing": "borrowing", "derived": "derivation", "derivation": "derivation"}


def read_entries(spark: SparkSession, path) -> DataFrame:
    """Entries of JSON lines; a line that does not parse fails the read."""
    return spark.read.schema(ENTRY).option("mode", "FAILFAST").json(path)


def _ref(lang: Column, word: Column) -> Column:
    return F.concat_ws(":", lang, word)


def _run_of(args: Column, first: int) -> Column:
    """The arguments from number ``first`` on, as far as numbers follow one another; empty ones are left out."""
    keys = F.sequence(F.lit(first), F.lit(first) + F.size(args))
    values = F.transform(keys, lambda k: F.try_element_at(args, k.cast("string")))
    gap = F.array_position(F.transform(values, lambda v: v.isNull()), True)
    return F.filter(F.slice(values, F.lit(1), gap.cast("int") - 1), lambda v: v != "")


def upward_edges(entries: DataFrame) -> DataFrame:
    """``(child, parent, edge_type)`` of the etymology templates of each entry, by the shape of their arguments.

    Templates of any other name (cognates, mentions, formatting) and those that lack an argument state no edge.
    """
    t = entries.select(_ref(F.col("lang_code"), F.col("word")).alias("child"), F.explode("etymology_templates").alias("t")).select("child", "t.name", F.coalesce("t.args", F.create_map().cast("map<string,string>")).alias("args"))
    arg = lambda k: F.try_element_at("args", F.lit(str(k)))
    named = F.create_map(*[F.lit(x) for kind, names in ACROSS.items() for n in names for x in (n, kind)])
    across = F.try_element_at(named, F.col("name"))
    none = F.array().cast("array<string>")
    lang = F.when(across.isNotNull() | F.col("name").isin(ROOTS), arg(2)).when(F.col("name").isin(PARTS + SAME_LANGUAGE), arg(1))
    words = (
        F.when(across.isNotNull(), F.filter(F.array(arg(3)), lambda v: v.isNotNull() & (v != ""))).when(F.col("name").isin(ROOTS), _run_of(F.col("args"), 3)).when(F.col("name").isin(PARTS), _run_of(F.col("args"), 2))
        .when(F.col("name").isin(SAME_LANGUAGE), F.filter(F.array(arg(2)), lambda v: v.isNotNull() & (v != ""))).otherwise(none)
    )
    kind = F.coalesce(across, F.when(F.col("name").isin(ROOTS), "inheritance").when(F.col("name").isin(PARTS), "compound").otherwise("derivation"))
    return t.where(F.coalesce(lang, F.lit("")) != "").select("child", lang.alias("lang"), F.explode(words).alias("parent"), kind.alias("edge_type")).select("child", _ref(F.col("lang"), F.col("parent")).alias("parent"), "edge_type").distinct()


def downward_edges(entries: DataFrame) -> DataFrame:
    """``(child, parent, edge_type)`` of the trees in ``descendants``, level by level to whatever depth they have."""
    kinds = F.create_map(*[F.lit(x) for kv in DESCENDANT_TAGS.items() for x in kv])
    level = entries.select(_ref(F.col("lang_code"), F.col("word")).alias("parent"), F.explode(F.from_json("descendants", _NODE)).alias("d"))
    parts = []
    while True:
        tags = F.concat(F.coalesce("d.tags", F.array().cast("array<string>")), F.coalesce("d.raw_tags", F.array().cast("array<string>")))
        kind = F.get(F.filter(F.transform(tags, lambda x: F.try_element_at(kinds, x)), lambda x: x.isNotNull()), F.lit(0))
        here = level.where("d.word <> '' and d.lang_code <> ''").select(_ref(F.col("d.lang_code"), F.col("d.word")).alias("child"), "parent", F.coalesce(kind, F.lit("inheritance")).alias("edge_type"), F.col("d.descendants").alias("rest"))
        here, seen = stored_with(here, F.count("*").alias("n"))
        parts.append(here.drop("rest"))
        if not seen["n"]:
            return reduce(DataFrame.unionByName, parts).distinct()
        level = here.where("rest is not null").select(F.col("child").alias("parent"), F.explode(F.from_json("rest", _NODE)).alias("d"))


def ingest(entries: DataFrame) -> dict[str, DataFrame]:
    """The tables of a dictionary: ``words(ref, lang, form, gloss)``, ``variants(ref, form)``, ``tags(ref, tag)`` and ``edges``.

    Words that only edges name have no gloss.  Of several glosses the first in order stays.
    """
    ref = _ref(F.col("lang_code"), F.col("word"))
    named = entries.where("word <> '' and lang_code <> ''")
    glosses = named.select(ref.alias("ref"), F.explode_outer(F.flatten(F.transform("senses", lambda s: s["glosses"]))).alias("gloss")).groupBy("ref").agg(F.min("gloss").alias("gloss"))
    edges = upward_edges(named).unionByName(downward_edges(named)).distinct()
    refs = named.select(ref.alias("ref")).unionByName(edges.select(F.col("child").alias("ref"))).unionByName(edges.select(F.col("parent").alias("ref"))).distinct()
    words = refs.join(glosses, "ref", "left").select("ref", F.split_part("ref", F.lit(":"), F.lit(1)).alias("lang"), F.expr("substring(ref, instr(ref, ':') + 1)").alias("form"), "gloss")
    variants = named.select(ref.alias("ref"), F.col("word"), F.explode("forms").alias("f")).where("f.form <> '' and f.form <> word").select("ref", "f.form").distinct()
    tags = named.select(ref.alias("ref"), F.explode("categories").alias("tag")).distinct()
    return {"words": words, "variants": variants, "tags": tags, "edges": edges}
