"""Documents whose sections hold sections: trees of unknown depth, walked level by level."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.aggregates import tasks_for
from ..operators.graph import stored, stored_with


def section_texts(docs: DataFrame, ident: str, tree: Column) -> DataFrame:
    """``(ident, path, text)`` of every section with a text, however deep: ``tree`` is a variant with ``text`` and ``sections``, the latter a list of such trees.

    ``path`` has the place of each ancestor in its list, from 0 (the root: an empty path), so rows in order of their paths stand as in the document.  Each level is one pass over the
    nodes of the level before.  Sections that are null, no objects or without a text count as none, their own sections still do if they are objects.
    """
    level = docs.select(F.col(ident), F.array().cast("array<int>").alias("path"), tree.alias("node"))
    found = []
    while True:
        level, seen = stored_with(level.withColumn("text", F.try_variant_get("node", "$.text", "string")).withColumn("_below", F.try_variant_get("node", "$.sections", "array<variant>")), F.count_if(F.size("_below") > 0).alias("n"))
        found.append(level.where("text <> ''").select(ident, "path", "text"))
        if not seen["n"]:
            return reduce(DataFrame.unionByName, found)
        level = level.select(ident, "path", F.posexplode("_below").alias("_i", "node")).select(ident, F.concat("path", F.array("_i")).alias("path"), "node").where("node is not null")


def _joined(texts: DataFrame, ident: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("_part", "path", "text")))
    return texts.groupBy(ident).agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n\n").alias("_d"))


def named_records(docs: DataFrame, order: str, tree: str) -> DataFrame:
    """``(name, description, kind)`` of documents ``(order, tree)`` with a ``name``, ``sections`` and perhaps a ``family`` that has these too.

    A family whose name, up to a comma, is one word gives a record of its own, with the family's texts.  A document whose name is one word other than that gives another one,
    with the family's texts and its own.  Names that differ in case alone are one record, that of the first document by ``order``, there the family's before the document's.
    """
    get = lambda path: F.trim(F.try_variant_get(F.col(tree), F.lit(path), "string"))
    base = docs.repartition(tasks_for(docs)).select(F.col(order).alias("_o"), F.col(tree).alias("_t"), get("$.name").alias("_own"), F.trim(F.split_part(get("$.family.name"), F.lit(","), F.lit(1))).alias("_fam"))
    word = lambda c: (F.length(c) > 0) & ~F.contains(c, F.lit(" "))
    base = stored(base.withColumn("_fam", F.when(word(F.col("_fam")), F.col("_fam"))))  # several steps read it
    family = section_texts(base.where("_fam is not null or try_variant_get(_t, '$.family.text', 'string') is not null or try_variant_get(_t, '$.family.sections', 'array<variant>') is not null"), "_o", F.try_variant_get("_t", "$.family", "variant")).withColumn("_part", F.lit(0))
    own = section_texts(base.select("_o", "_t"), "_o", F.col("_t")).where("size(path) > 0").withColumn("_part", F.lit(1))
    of_family, of_both = _joined(family, "_o"), _joined(family.unionByName(own), "_o")
    a = base.where("_fam is not null").join(of_family, "_o", "left").select("_o", F.lit(0).alias("_k"), F.col("_fam").alias("name"), "_d")
    b = base.where(word(F.col("_own")) & ~F.coalesce(F.lower("_own") == F.lower("_fam"), F.lit(False))).join(of_both, "_o", "left").select("_o", F.lit(1).alias("_k"), F.col("_own").alias("name"), "_d")
    first = a.unionByName(b).groupBy(F.lower("name").alias("_l")).agg(F.min(F.struct("_o", "_k", "name", "_d")).alias("r"))
    return first.select("r.name", F.coalesce("r._d", F.lit("")).alias("description"), F.when(F.col("r._k") == 0, "family").otherwise("own").alias("kind"))


def split_senses(text: Column) -> Column:
    """The senses ``(head, summary)`` of a text of paragraphs: a paragraph of one line that ends in ``(...)`` is a head, and the paragraph behind it its summary, whatever
    that looks like.  Others are passed over; a head without a paragraph behind it is none."""
    blocks = F.transform(F.split(F.trim(text), r"\n\s*\n"), lambda b: F.trim(F.regexp_replace(b, r"^\s+|\s+$", "")))
    start = F.struct(F.array().cast("array<struct<head:string,summary:string>>").alias("out"), F.lit(None).cast("string").alias("head"))
    is_head = lambda b: ~F.contains(b, F.lit("\n")) & b.rlike(r"\([\w.]+\)$")

    def step(s, b):
        taken = F.struct(F.concat(s["out"], F.array(F.struct(s["head"].alias("head"), b.alias("summary")))).alias("out"), F.lit(None).cast("string").alias("head"))
        return F.when(s["head"].isNotNull(), taken).otherwise(F.struct(s["out"].alias("out"), F.when(is_head(b), b).alias("head")))

    return F.aggregate(blocks, start, step, lambda s: s["out"])
