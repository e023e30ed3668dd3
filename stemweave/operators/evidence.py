"""What names and texts give evidence of: spellings that a name implies, links that no known form explains, genitives, ambiguous and reverse matches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import fold_surface
from .text import residual_span


def guarded_spans(name: str, parts: list[tuple[list[str], list[str]]], least: int = 2) -> tuple[int, str, int, int] | None:
    """(part, span, from, to) of the one part whose spelling a name implies, the others tiling what is before and behind it; None where none or several can be it.

    Each part has its own spellings and those of its equivalents.  A span that some part of the name has among either is known, not implied.  Nor is one that begins or ends with a spelling of its
    own part: then another part took too little.
    """
    taken = {f for own, wider in parts for f in (*own, *wider)}
    found = []
    for i, (own, wider) in enumerate(parts):
        others = [o for j, (o, _) in enumerate(parts) if j != i]
        if not all(others) or not (span := residual_span(name, others, least)) or span in taken:
            continue
        if not any(f and f != span and (span.startswith(f) or span.endswith(f)) for f in (*own, *wider)):
            found.append((i, span))
    if len(parts) < 2 or len(found) != 1:
        return None
    i, span = found[0]
    at = name.find(span)
    return i, span, at, at + len(span)


def guarded_surfaces(parts: DataFrame, keys: list[str], ordinal: str, part: str, known: DataFrame, equivalents: DataFrame, least: int = 1) -> DataFrame:
    """``(part, span, position, support)``: spellings that the names of ``parts(*keys, ordinal, part)`` imply (the last key is the name), by :func:`guarded_spans`, where ``least`` names or more say so.

    ``known(part, form)`` are a part's own spellings, ``equivalents(part, other)`` the parts whose spellings are as good as its own; ``position`` is pre, inner or post.  All spellings are folded.
    """
    name = keys[-1]
    forms = known.select(F.col(part), fold_surface(F.col("form")).alias("_f")).where("_f <> ''").distinct()
    own = forms.groupBy(part).agg(F.array_sort(F.collect_set("_f")).alias("_own"))
    wider = equivalents.select(F.col(part), F.col("other")).join(forms.withColumnsRenamed({part: "other"}), "other").groupBy(part).agg(F.array_sort(F.collect_set("_f")).alias("_wider"))
    none = F.array().cast("array<string>")
    rows = parts.select(*keys, ordinal, part).distinct().join(own, part, "left").join(wider, part, "left")
    lists = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(ordinal).alias("i"), F.col(part).alias("p"), F.coalesce("_own", none).alias("own"), F.coalesce("_wider", none).alias("wider")))).alias("x"))

    def run(frames):
        for pdf in frames:
            out = []
            for n, x in zip(pdf["name"], pdf["x"]):
                if hit := guarded_spans(n, [(list(e["own"]), list(e["wider"])) for e in x]):
                    i, span, a, b = hit
                    out.append((x[i]["p"], span, "pre" if a == 0 else "post" if b == len(n) else "inner"))
            yield pd.DataFrame(out, columns=["part", "span", "position"])

    kind = parts.schema[part].dataType.simpleString()
    spans = lists.select(fold_surface(F.col(name)).alias("name"), "x").mapInPandas(run, f"part {kind}, span string, position string")
    return spans.groupBy("part", "span", "position").agg(F.count("*").alias("support")).where(F.col("support") >= least)


def unexplained_links(links: DataFrame, nodes: DataFrame, variants: DataFrame, mates: DataFrame, edges: DataFrame) -> DataFrame:
    """``links(surface, id)`` whose surface, folded, is no known form of the node: not its own, nor a variant's, a mate's or a direct descendant's.

    ``nodes(id, form)``, ``variants(id, form)``, ``mates(id, cluster)`` (nodes of one cluster are mates), ``edges(parent, child)``.  A cluster's forms are looked up by cluster, so its members never meet in pairs.
    """
    fold = lambda c: fold_surface(F.col(c))
    own = nodes.select("id", fold("form").alias("_f")).unionByName(variants.select("id", fold("form").alias("_f")))
    below = edges.select(F.col("parent").alias("id"), F.col("child")).join(nodes.select(F.col("id").alias("child"), fold("form").alias("_f")), "child").select("id", "_f")
    asked = links.withColumn("_f", fold("surface")).where("_f <> ''")
    left = asked.join(own.unionByName(below).distinct(), ["id", "_f"], "left_anti")
    cluster = mates.join(nodes.select("id", fold("form").alias("_f")), "id").select("cluster", "_f").distinct()
    explained = left.join(mates, "id").join(cluster, ["cluster", "_f"], "left_semi").select("id", "_f").distinct()
    return left.join(explained, ["id", "_f"], "left_anti").select("surface", "id")


def historical_genitive(names: DataFrame, forms: DataFrame, towns: list[str], stones: list[str], decided: DataFrame) -> DataFrame:
    """``(id, evidence)`` of ``names(id, name)``: ``split`` where an old form ends in a genitive s before one of the ``towns``, ``literal`` where one ends in one of the ``stones``, null where neither or both do.

    Only ``forms(id, form)`` that differ from the name count, all folded.  What is ``decided(id, evidence)`` otherwise comes first.
    """
    old = forms.select("id", fold_surface(F.col("form")).alias("_f")).join(names.select("id", fold_surface(F.col("name")).alias("_n")), "id").where("_f <> '' and _f <> _n")
    town = F.col("_f").rlike("(es|[^aeiouy]s)(" + "|".join(towns) + ")$") if towns else F.lit(False)
    stone = F.col("_f").rlike("(" + "|".join(stones) + ")$") if stones else F.lit(False)
    seen = old.groupBy("id").agg(F.bool_or(town).alias("t"), F.bool_or(stone).alias("s"))
    said = F.when(F.col("t") & ~F.col("s"), "split").when(F.col("s") & ~F.col("t"), "literal")
    first = decided.select("id", F.col("evidence").alias("_e"))
    return names.select("id").join(seen, "id", "left").join(first, "id", "left").select("id", F.coalesce("_e", said).alias("evidence"))


def _around(radius: int):
    """``(forms, lower-case text, text) -> snippets``: each form's first place is looked for in the one text that the task has at hand."""

    @F.pandas_udf("array<string>")
    def cut(forms: pd.Series, low: pd.Series, text: pd.Series) -> pd.Series:
        def one(words, lowered, whole):
            if lowered is None or whole is None:
                return [None] * len(words)
            places = [(f["low"], f["n"], -1 if f["low"] is None else lowered.find(f["low"])) for f in words]
            return [whole[max(at - radius, 0) : max(at - radius, 0) + n + radius + min(at, radius)].strip(" ") if at >= 0 else None for _, n, at in places]

        return pd.Series([one(*x) for x in zip(forms, low, text)])

    return cut


def in_context(several: DataFrame, docs: DataFrame, ident: str, text: str, radius: int = 40) -> DataFrame:
    """``several(source, form, entities)`` with ``snippet``, the text around the form's first place in its source.

    The place is one of the form as it stands, without regard to case; null where it has none.  Each source's text is met once, with all its forms, and is lower-cased once.
    """
    lists = several.groupBy("source").agg(F.collect_list(F.struct("form", "entities")).alias("_m"))
    rows = lists.join(docs.select(F.col(ident).alias("source"), F.col(text).alias("_t")), "source", "left")
    words = F.transform("_m", lambda x: F.struct(F.lower(x["form"]).alias("low"), F.coalesce(F.length(x["form"]), F.lit(0)).alias("n")))
    cut = rows.select("source", "_m", _around(radius)(words, F.lower("_t"), F.col("_t")).alias("_s"))
    each = cut.select("source", F.explode(F.arrays_zip("_m", "_s")).alias("x"))
    return each.select("source", "x._m.form", "x._m.entities", F.col("x._s").alias("snippet"))


def ambiguous_hits(matches: DataFrame, docs: DataFrame, ident: str, text: str, radius: int = 40) -> DataFrame:
    """``(source, form, entities, snippet)`` of ``matches(source, form, entity)`` that several entities claim, each :func:`in_context`."""
    several = matches.groupBy("source", "form").agg(F.array_sort(F.collect_set("entity")).alias("entities")).where("size(entities) > 1")
    return in_context(several, docs, ident, text, radius)


def reverse_search(docs: DataFrame, ident: str, text: str, pattern: str, entities: DataFrame) -> DataFrame:
    """``(entity, doc, detail, hits)``: pairs of a form and a detail (the two groups of ``pattern``) in texts, where the form, folded, is that of exactly one of ``entities(entity, form)``."""
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("f"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("d"))
    found = docs.select(F.col(ident).alias("doc"), F.explode(pairs).alias("p")).select("doc", fold_surface(F.col("p.f")).alias("_f"), F.col("p.d").alias("detail"))
    one = entities.select("entity", fold_surface(F.col("form")).alias("_f")).where("_f <> ''").groupBy("_f").agg(F.min("entity").alias("entity"), F.max("entity").alias("_o")).where("entity = _o").select("_f", "entity")
    counted = found.groupBy("_f", "doc", "detail").agg(F.count("*").alias("hits"))
    return counted.join(one, "_f").groupBy("entity", "doc", "detail").agg(F.sum("hits").alias("hits"))
