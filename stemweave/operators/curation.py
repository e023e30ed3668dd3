"""Curation and enrichment: overlays of hand-made actions, chains of derivation steps, imported links, strata of language families."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import chain_ends, inherited_marks, stored


def apply_curation(nodes: DataFrame, ident: str, label: str, children: DataFrame, node: str, value: str, actions: DataFrame) -> dict[str, DataFrame]:
    """Hand-made ``actions(ref, kind, value, to)`` over nodes and their child rows; one action of each kind for a node.

    ``set`` gives a node the label ``value``; ``drop`` takes off its children of that value; ``add`` gives it such a child (its other
    columns null); ``split`` makes the node ``to``, with its label, and moves the children of that value there; ``fold`` moves all children to ``to``
    and drops the node.  A fold into a node that is folded itself goes on to where that one ends.  One into a node that isn't there (nor made by a split), into itself, or round in a circle
    changes nothing.  ``counts(kind, applied, unresolved)`` tells how many actions name a node that is not there, or are such a fold.
    """
    here = nodes.select(F.col(ident).alias("ref"))
    known = actions.join(here, "ref", "left_semi")
    of = lambda kind: known.where(F.col("kind") == kind)
    renamed = nodes.join(of("set").select(F.col("ref").alias(ident), F.col("value").alias("_set")), ident, "left").withColumn(label, F.coalesce("_set", label)).select(*nodes.columns)
    made = renamed.join(of("split").select(F.col("ref").alias(ident), F.col("to").alias("_to")), ident).withColumn(ident, F.col("_to")).select(*nodes.columns)
    there = here.union(of("split").select("to")).distinct().select(F.col("ref").alias("_to"))
    wanted = of("fold").select("ref", F.col("to").alias("_to")).where("ref <> _to").join(there, "_to", "left_semi")
    ends = chain_ends(wanted.select("ref", "_to").unionByName(wanted.select(F.col("_to").alias("ref")).distinct().join(wanted.select("ref"), "ref", "left_anti").withColumn("_to", F.lit(None).cast(wanted.schema["_to"].dataType))), "ref", "_to")
    resolved = stored(wanted.select("ref").join(ends, "ref").select("ref", F.coalesce("terminal", "entry").alias("_fold")).where("ref <> _fold"))
    kept = renamed.join(resolved.select(F.col("ref").alias(ident)), ident, "left_anti").unionByName(made)
    drop = of("drop").select(F.col("ref").alias(node), F.col("value").alias(value))
    rest = children.join(drop, [node, value], "left_anti")
    moves = of("split").select(F.col("ref").alias(node), F.col("value").alias(value), F.col("to").alias("_split"))
    folds = resolved.select(F.col("ref").alias(node), "_fold")
    moved = rest.join(moves, [node, value], "left").join(folds, node, "left").withColumn(node, F.coalesce("_split", "_fold", node)).select(*children.columns)
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in children.schema if f.name not in (node, value)]
    added = of("add").select(F.col("ref").alias(node), F.col("value").alias(value), *blank)
    judged = actions.join(here.withColumn("_known", F.lit(True)), "ref", "left").join(resolved.select("ref", F.lit(True).alias("_goes")), "ref", "left")
    done = F.coalesce(F.when(F.col("kind") == "fold", F.col("_goes")).otherwise(F.col("_known")), F.lit(False))
    counts = judged.groupBy("kind").agg(F.count_if(done).alias("applied"), F.count_if(~done).alias("unresolved"))
    return {"nodes": kept, "children": moved.unionByName(added), "counts": counts}


class Step(NamedTuple):
    """A derivation: its name, the steps it needs, the columns it makes, and how."""

    name: str
    needs: list[str]
    makes: list[str]
    run: Callable[[DataFrame], DataFrame]


def enrich(df: DataFrame, steps: list[Step]) -> DataFrame:
    """All steps in order; a step whose needs do not stand before it is an error, not a silent null."""
    seen: set[str] = set()
    for s in steps:
        if missing := [n for n in s.needs if n not in seen]:
            raise ValueError(f"{s.name} needs {', '.join(missing)} before it")
        df = s.run(df)
        seen.add(s.name)
    return df


def reset(df: DataFrame, steps: list[Step], stage: str) -> DataFrame:
    """``df`` without what ``stage`` made, nor any step that needs it directly or through others."""
    if stage not in {s.name for s in steps}:
        raise ValueError(f"no step {stage}")
    gone = {stage}
    for s in steps:
        if gone & set(s.needs):
            gone.add(s.name)
    return df.drop(*[c for s in steps if s.name in gone for c in s.makes])


def import_reflexes(words: DataFrame, rows: DataFrame) -> dict[str, DataFrame]:
    """Links from old words to modern ones: ``words(lang, form, gloss)`` and ``rows(old_lang, old, lang, form, gloss)``.

    A row whose old word is not there is only counted; else its modern word is made where it is missing, its gloss filled where it is
    null, and an inheritance edge drawn, once.
    """
    old = words.select(F.col("lang").alias("old_lang"), F.col("form").alias("old"))
    known = rows.join(old, ["old_lang", "old"], "left_semi").distinct()
    new = known.groupBy("lang", "form").agg(F.min("gloss").alias("_gloss"))
    merged = words.join(new, ["lang", "form"], "full_outer").select("lang", "form", F.coalesce("gloss", "_gloss").alias("gloss"))
    edges = known.select(F.concat_ws(":", "old_lang", "old").alias("parent"), F.concat_ws(":", "lang", "form").alias("child"), F.lit("inheritance").alias("edge_type")).distinct()
    lost = rows.join(old, ["old_lang", "old"], "left_anti").agg(F.count("*").alias("n")).select(F.lit("parent_missing").alias("outcome"), "n")
    return {"words": merged, "edges": edges, "counts": lost}


class Family(NamedTuple):
    """A language family: its modern language, its strata in order with the ancestor languages that name them, the languages
    that settle a word by themselves, and the stratum of all other words."""

    name: str
    modern: str
    strata: list[tuple[str, list[str]]]
    own: dict[str, str]
    default: str


def classify_families(nodes: DataFrame, ident: str, language: str, edges: DataFrame, parent: str, child: str, families: list[Family]) -> DataFrame:
    """``(family, ident, stratum)`` of the words of each family, by own language or by the languages of all their ancestors."""
    modern = [f.modern for f in families]
    named = sorted({x for f in families for _, members in f.strata for x in members})
    marked = nodes.where(F.col(language).isin(named)).select(ident, F.col(language).alias("_l"))
    # a word is told by which of the named languages its ancestors have, so only those go down the edges, not the ancestors
    above = inherited_marks(marked, edges, ident, "_l", parent, child).join(nodes.where(F.col(language).isin(modern)).select(ident), ident, "left_semi")
    langs = above.groupBy(ident).agg(F.collect_set("_l").alias("_langs"))
    out = []
    for f in families:
        if f.modern in f.own:
            raise ValueError(f"{f.name}: its modern language is classified twice")
        case = F.lit(f.default)
        for name, members in reversed(f.strata):
            case = F.when(F.arrays_overlap(F.coalesce("_langs", F.array().cast("array<string>")), F.array(*map(F.lit, members))), name).otherwise(case)
        for lang, stratum in f.own.items():
            case = F.when(F.col(language) == lang, stratum).otherwise(case)
        mine = nodes.where(F.col(language).isin([f.modern, *f.own])).join(langs, ident, "left")
        out.append(mine.select(F.lit(f.name).alias("family"), ident, case.alias("stratum")))
    return reduce(DataFrame.unionByName, out)
