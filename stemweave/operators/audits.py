"""Audits: names that no spelling of a part explains, breakdowns that belong elsewhere, entries that are another one's variant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import fold_surface
from .text import longest_common_run


def _matched(pairs: DataFrame, name: str, entity: str, surfaces: DataFrame) -> DataFrame:
    known = surfaces.select(F.col("entity").alias("_e"), fold_surface(F.col("surface")).alias("_s")).where("_s <> ''").groupBy("_e").agg(F.array_sort(F.collect_set("_s")).alias("_all"))
    rows = pairs.select(F.col(name).alias("name"), F.col(entity).alias("entity")).withColumn("_f", fold_surface(F.coalesce("name", F.lit(""))))
    rows = rows.join(known, rows["entity"] == known["_e"], "left").drop("_e")
    hits = F.coalesce(F.filter("_all", lambda s: F.contains(F.col("_f"), s)), F.array().cast("array<string>"))
    kind = F.when(F.col("_all").isNull(), "reflex_less").when(F.size("_hits") > 0, "matched").otherwise("variant_gap")
    return rows.withColumn("_hits", hits).withColumn("kind", kind).drop("_all")


def gap_census(pairs: DataFrame, name: str, entity: str, surfaces: DataFrame) -> DataFrame:
    """``(kind, n)`` of the pairs of a name and a part of it: ``matched`` where a known surface of the part stands in the name (both folded), ``variant_gap`` where it
    has surfaces but none does, ``reflex_less`` where it has none.  ``surfaces(entity, surface)``; each pair counts, repeated ones too."""
    return _matched(pairs, name, entity, surfaces).groupBy("kind").agg(F.count("*").alias("n"))


def variant_gaps(pairs: DataFrame, name: str, entity: str, surfaces: DataFrame, allowed: DataFrame, samples: int = 3) -> DataFrame:
    """``(entity, flips, names, evidence)`` of the ``allowed(entity)`` parts that some name needs a new spelling of: in how many names, whether it is the only unmatched part in one of them, and
    the first ``samples`` names in order, each with the spans of its matched parts."""
    each = _matched(pairs.select(name, entity).distinct(), name, entity, surfaces).where("_f <> ''")
    spans = F.array_sort(F.array_distinct(F.flatten(F.collect_list("_hits"))))
    whole = each.groupBy("name").agg(F.count_if(F.col("kind") != "matched").alias("_open"), spans.alias("spans"))
    gaps = each.where("kind = 'variant_gap'").select("name", "entity").join(allowed.select("entity").distinct(), "entity", "left_semi").join(whole, "name")
    counts = gaps.groupBy("entity").agg(F.max(F.col("_open") == 1).alias("flips"), F.count("*").alias("names"))
    first = gaps.withColumn("_k", F.row_number().over(Window.partitionBy("entity").orderBy("name"))).where(F.col("_k") <= samples)
    shown = first.groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("name", "spans"))).alias("evidence"))
    return counts.join(shown, "entity")


def suspect_breakdowns(elements: DataFrame, ident: str, name: str, historical: str, ordinal: str, form: str, least: int = 3) -> DataFrame:
    """``(id, name, historical, elements)`` of breakdowns whose elements, put together in order, have no ``least`` letters in a row with the name, and whose historical form has none either or is missing.

    All is folded first; names of fewer than ``least`` letters are passed over.  ``name`` and ``historical`` are those of the breakdown, the same in all its rows.
    """
    g = elements.groupBy(ident).agg(F.max(name).alias("name"), F.max(historical).alias("historical"), F.transform(F.array_sort(F.collect_list(F.struct(ordinal, form))), lambda x: x[form]).alias("elements"))
    n, whole, old = fold_surface(F.col("name")), fold_surface(F.array_join("elements", "")), fold_surface(F.coalesce("historical", F.lit("")))
    low = lambda a, b: F.coalesce(longest_common_run(a, b), F.lit(0)) < least
    return g.where((F.length(n) >= least) & low(n, whole) & ((old == "") | low(n, old)))


def variant_collapses(nodes: DataFrame, variants: DataFrame, glosses: DataFrame) -> DataFrame:
    """``(ref, into, variant_class)``: live entries whose form is a variant of another live one of their language with which they share a gloss (trimmed, in lower case).

    ``nodes(id, language, form, merged)``, ``variants(id, form, variant_class)`` of the other one, ``glosses(id, gloss)``.  A ref is language and form; of several others the least ref counts, of its
    classes the least, and one without a class is ``alternative``.
    """
    live = nodes.where("merged is null").select("id", "language", "form", F.concat_ws(":", "language", "form").alias("_ref"))
    told = glosses.select("id", F.lower(F.trim("gloss")).alias("_g")).where("_g is not null").distinct()
    # a ref is its language and form, so entries alike are one row a gloss, and the join is no product of entries; their ends of ids tell whether two of them differ
    own = live.join(told, "id").groupBy("language", F.col("form").alias("_form"), "_g", F.col("_ref").alias("ref")).agg(F.min("id").alias("_a"), F.max("id").alias("_b"))
    shown = variants.join(live.select("id", "language", F.col("_ref").alias("into")), "id").join(told, "id").withColumn("variant_class", F.coalesce("variant_class", F.lit("alternative")))
    other = shown.groupBy("language", F.col("form").alias("_form"), "_g", "into", "variant_class").agg(F.min("id").alias("_c"), F.max("id").alias("_d"))
    met = own.join(other, ["language", "_form", "_g"]).where("ref <> into and not (_a = _b and _c = _d and _a = _c)")
    best = met.groupBy("ref").agg(F.min(F.struct("into", "variant_class")).alias("m"))
    return best.select("ref", "m.into", "m.variant_class")


POINTER = r"(?i)\b(?:form|spelling|variant) of\s+(.+)"


def pointer_collapses(nodes: DataFrame, glosses: DataFrame) -> DataFrame:
    """``(ref, into)``: live entries all of whose glosses say "form of X" (or spelling, or variant), where the words behind name exactly one other live form of their language.

    ``nodes(id, language, form, merged)``, ``glosses(id, gloss)``.  Words are compared as they stand, without dashes at their ends; an entry with a gloss of its own, and one whose words name several forms, is left.
    """
    live = nodes.where("merged is null").select("id", "language", "form")
    tail = F.regexp_extract("gloss", POINTER, 1)
    told = glosses.groupBy("id").agg(F.bool_and(F.col("gloss").rlike(POINTER)).alias("_all"), F.array_distinct(F.flatten(F.collect_list(F.split(tail, r"[^\p{L}\p{M}-]+")))).alias("_w")).where("_all")
    words = live.join(told, "id").select("id", "language", "form", F.explode("_w").alias("_x")).select("id", "language", "form", F.regexp_replace("_x", r"^-+|-+$", "").alias("_x")).where("_x <> '' and _x <> form")
    target = live.select("language", F.col("form").alias("_x")).distinct()
    found = words.join(target, ["language", "_x"], "left_semi").groupBy("id", "language", "form").agg(F.collect_set("_x").alias("_t")).where("size(_t) = 1")
    return found.select(F.concat_ws(":", "language", "form").alias("ref"), F.concat(F.col("language"), F.lit(":"), F.col("_t")[0]).alias("into")).distinct()


def checked_statements(rows: DataFrame, ident: str, content: Column, where: Column) -> DataFrame:
    """``rows``, each of which has no id, or the one that its content gives; another one fails the read and is named by ``where``."""
    wrong = F.col(ident).isNotNull() & ~F.col(ident).eqNullSafe(content)
    said = F.concat(where, F.lit(": stored id "), F.col(ident), F.lit(" is not "), content)
    return rows.withColumn(ident, F.when(wrong, F.raise_error(said)).otherwise(F.coalesce(F.col(ident), content)))


def project_descent(statements: DataFrame, nodes: DataFrame, gate: float) -> tuple[DataFrame, DataFrame]:
    """``(parent_id, child_id, kind, score)`` of the edges that statements affirm at ``gate`` or above and nowhere refute, and ``(reason, n)`` of what was left out.

    ``statements(child, parent, kind, polarity, score)`` name entries by ref, ``nodes(ref, id)`` resolve them (of several ids the least).  An edge of several statements counts once, by the strongest; an
    affirmation is ``refuted``, else ``gated``, else ``unresolved`` where a side names no entry.
    """
    refuted = statements.where("polarity = 'refute'").select("child", "parent", "kind").distinct().withColumn("_no", F.lit(True))
    of = nodes.groupBy("ref").agg(F.min("id").alias("id"))
    yes = statements.where("polarity = 'affirm'").join(refuted, ["child", "parent", "kind"], "left")
    yes = yes.join(of.withColumnsRenamed({"ref": "child", "id": "child_id"}), "child", "left").join(of.withColumnsRenamed({"ref": "parent", "id": "parent_id"}), "parent", "left")
    why = F.when(F.col("_no"), "refuted").when(F.coalesce("score", F.lit(0.0)) < gate, "gated").when(F.col("child_id").isNull() | F.col("parent_id").isNull(), "unresolved")
    judged = yes.withColumn("reason", why)
    kept = judged.where("reason is null").groupBy("parent_id", "child_id", "kind").agg(F.max("score").alias("score"))
    return kept, judged.where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))
