"""Domain steps that join several operators: coverage profiles, triage, consensus, backfill, audits, thresholds, ledgers, slices."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import content_id, fold_surface
from .log import fold_log
from .ranking import first_per_key, top_n_per_key


def profile_coverage(tags: DataFrame, group: str, tag: str, reference: str, top: int) -> DataFrame:
    """``(group, tag, n, hits, of)``: every tag of the reference group's ``top`` most frequent ones with its count in each group, 0 where
    there is none, and how many of them the group has at all."""
    counts = tags.groupBy(group, tag).agg(F.count("*").alias("n"))
    profile = counts.where(F.col(group) == reference).orderBy(F.desc("n"), tag).limit(top).select(tag)  # at most ``top`` rows
    grid = counts.select(group).distinct().join(F.broadcast(profile))
    filled = grid.join(counts, [group, tag], "left").select(group, tag, F.coalesce("n", F.lit(0)).alias("n"))
    w = Window.partitionBy(group)
    return filled.withColumn("hits", F.count_if(F.col("n") > 0).over(w)).withColumn("of", F.count("*").over(w))


def compact_log(log: DataFrame, keys: list[str], order: str, op: str, fields: str) -> DataFrame:
    """The log with each key's history folded into one ``set`` row of its last order; keys that are not live have no row.

    Folding the compacted log gives the same states.
    """
    last = log.groupBy(*keys).agg(F.max(order).alias(order))
    state = fold_log(log, keys, order, op, fields).where("live")
    return state.join(last, keys).select(*keys, order, F.lit("set").alias(op), F.col("state").alias(fields))


def triage(rows: DataFrame, batch: str, ident: str, key: str, action: str, known: DataFrame, most_errors: int) -> DataFrame:
    """``rows`` with ``outcome``: what a commit of each batch does with a row.

    ``create`` of a key that exists already, or that an earlier row of any batch creates, is demoted to ``map``; ``map`` of an
    unknown key is an ``error``; a batch with more than ``most_errors`` errors is ``aborted`` as a whole, and creates nothing.
    """
    have = known.select(F.col(key)).distinct().withColumn("_known", F.lit(True))
    x = rows.join(have, key, "left").withColumn("_known", F.coalesce("_known", F.lit(False)))
    bad = (F.col(action) == "map") & ~F.col("_known")
    x = x.withColumn("_off", F.sum(bad.cast("int")).over(Window.partitionBy(batch)) > most_errors)
    creates = (F.col(action) == "create") & ~F.col("_known") & ~F.col("_off")
    first = F.row_number().over(Window.partitionBy(key, creates).orderBy(ident)) == 1
    out = F.when(F.col("_off"), "aborted").when(bad, "error").when(creates & first, "create").when(F.col(action) == "create", "map").otherwise(F.col(action))
    return x.withColumn("outcome", out).drop("_known", "_off")


def regenerate_slot(names: DataFrame, ident: str, slot: str, word: str, pool: DataFrame, score: str, target: int) -> DataFrame:
    """``(ident, replacement)``: the best-scored word of the pool for slot ``target`` that the name does not use yet.

    Only the first few of a pool can be needed: a name of m words uses m of them at most.
    """
    used = names.groupBy(ident).agg(F.count("*").alias("m"), F.max(F.when(F.col(slot) == target, F.col("pool"))).alias("pool"), F.collect_set(word).alias("_used")).where("pool is not null")
    most = names.groupBy(ident).count().agg(F.max("count")).first()[0] or 0
    ranked = top_n_per_key(pool, ["pool"], [F.desc(score), word], int(most) + 1)
    lists = ranked.groupBy("pool").agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col(score)).alias("s"), F.col(word).alias("w")))), lambda x: x["w"]).alias("_best"))
    return used.join(lists, "pool").select(ident, F.get(F.array_except("_best", "_used"), F.lit(0)).alias("replacement"))


def parse_stage(label: Column) -> Column:
    """A struct (stage, start, end, middle) of labels like ``Middle (1100-1500)``, ``Modern (1700-)`` and ``Old (-1100)``; an open side is
    null, and the middle is that of what is known.  All null for any other label."""
    p = r"^\s*(.+?)\s*\((\d*)\s*[-–]\s*(\d*)\)\s*$"
    ok = label.rlike(p)
    start, end = (F.regexp_extract(label, p, k).try_cast("int") for k in (2, 3))
    middle = F.when(start.isNotNull() & end.isNotNull(), F.floor((start + end) / 2)).otherwise(F.coalesce(start, end)).cast("int")
    return F.struct(F.when(ok, F.regexp_extract(label, p, 1)).alias("stage"), start.alias("start"), end.alias("end"), middle.alias("middle"))


def corpus_gaps(counts: DataFrame, word: str, slice_: str, sense: str, n: str, known: DataFrame, least: int) -> DataFrame:
    """``(word, n, slices, missing, sense)``: words of the corpus that the lexicon lacks, with at least ``least`` uses.

    ``slices`` have the word, ``missing`` is how many of all slices lack it, and the sense is the one with most uses (ties in order).
    """
    gaps = counts.join(known.select(word).distinct(), word, "left_anti")
    every = counts.agg(F.count_distinct(slice_).alias("_all"))
    g = gaps.groupBy(word).agg(F.sum(n).alias("n"), F.count_distinct(slice_).alias("slices")).where(F.col("n") >= least)
    best = first_per_key(gaps.groupBy(word, sense).agg(F.sum(n).alias("_s")), [word], [F.desc("_s"), sense]).select(word, sense)
    return g.join(best, word).crossJoin(F.broadcast(every)).select(word, "n", "slices", (F.col("_all") - F.col("slices")).alias("missing"), sense)  # one row


def grounded_consensus(elements: DataFrame, form: str, position: str, gloss: str, witness: str, lexicon: DataFrame, ident: str, least: int) -> DataFrame:
    """``(form, position, gloss, witnesses, ident)``: per form and place in the name the gloss that most witnesses give, where ``least``
    agree, with the lowest lexicon entry of that form and gloss (null where there is none)."""
    votes = elements.select(form, position, gloss, witness).distinct().groupBy(form, position, gloss).agg(F.count("*").alias("witnesses"))
    best = first_per_key(votes.where(F.col("witnesses") >= least), [form, position], [F.desc("witnesses"), gloss])
    entry = lexicon.groupBy(form, gloss).agg(F.min(ident).alias(ident))
    return best.join(entry, [form, gloss], "left").select(form, position, gloss, "witnesses", ident)


def backfill_and_merge(rows: DataFrame, ident: str, name: str, country: str) -> tuple[DataFrame, DataFrame]:
    """``(rows, redirect)``: missing countries filled where all known rows of a name agree; rows that are then equal in name and
    country become the one of the lowest id, and ``redirect(old, new)`` says which."""
    agreed = rows.where(F.col(country).isNotNull()).groupBy(name).agg(F.min(country).alias("_a"), F.max(country).alias("_b")).where("_a = _b").select(name, "_a")
    filled = rows.join(agreed, name, "left").withColumn(country, F.coalesce(country, "_a")).drop("_a")
    keep = F.min(ident).over(Window.partitionBy(name, country))
    marked = filled.withColumn("_keep", F.when(F.col(country).isNotNull(), keep).otherwise(F.col(ident)))
    return marked.where(F.col("_keep") == F.col(ident)).drop("_keep"), marked.where(F.col("_keep") != F.col(ident)).select(F.col(ident).alias("old"), F.col("_keep").alias("new"))


def audit_links(links: DataFrame, parent: str, child: str, nodes: DataFrame, ident: str, form: str, gloss: str, distance: int) -> DataFrame:
    """``(parent, child, d)``: links whose forms are more than ``distance`` edits apart and whose glosses share no word."""
    n = lambda key, k: nodes.select(F.col(ident).alias(key), F.col(form).alias(f"_f{k}"), F.col(gloss).alias(f"_g{k}"))
    j = links.join(n(parent, 1), parent).join(n(child, 2), child)
    words = lambda c: F.split(F.lower(c), r"\s+")
    return j.withColumn("d", F.levenshtein("_f1", "_f2")).where((F.col("d") > distance) & ~F.arrays_overlap(words("_g1"), words("_g2"))).select(parent, child, "d")


def genitive_evidence(rows: DataFrame, historical: str, head: str, tail: str) -> DataFrame:
    """``(head, link, n)``: what old forms have between the head and the tail of the modern name; forms that do not
    begin and end with them say nothing."""
    fits = F.startswith(historical, F.col(head)) & F.endswith(historical, F.col(tail)) & (F.length(historical) >= F.length(head) + F.length(tail))
    link = F.substring(F.col(historical), F.length(head) + 1, F.length(historical) - F.length(head) - F.length(tail))
    return rows.where(fits).select(head, link.alias("link")).groupBy(head, "link").agg(F.count("*").alias("n"))


def upsert_members(members: DataFrame, group: str, member: str, fit: str, order: str) -> DataFrame:
    """``(group, member, fit)``: one row per member, with the fit of its last write."""
    return members.groupBy(group, member).agg(F.max_by(fit, order).alias(fit))


def author_assertions(facts: DataFrame, keys: list[str], source: str, ident: Column, least: int, existing: DataFrame) -> DataFrame:
    """``(id, keys, polarity, confidence, sources)``: assertions for facts of ``least`` sources or more that are not there yet."""
    g = facts.select(*keys, source).distinct().groupBy(*keys).agg(F.count("*").alias("sources")).where(F.col("sources") >= least)
    out = g.select(ident.alias("id"), *keys, F.lit("affirm").alias("polarity"), (1 - F.pow(F.lit(0.5), F.col("sources"))).alias("confidence"), "sources")
    return out.join(existing.select("id"), "id", "left_anti")


def derive_threshold(verdicts: DataFrame, group: str, score: str, accepted: Column, precision: float) -> DataFrame:
    """``(group, threshold, precision, accepted, n)``: the lowest score from which on at least ``precision`` of the verdicts accept.

    Verdicts are summed by score first, so the running sums go over distinct scores.
    """
    by = verdicts.groupBy(group, score).agg(F.count("*").alias("_n"), F.count_if(accepted).alias("_a"))
    above = Window.partitionBy(group).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    run = by.select(group, score, F.sum("_n").over(above).alias("n"), F.sum("_a").over(above).alias("accepted"))
    ok = run.where(F.col("accepted") >= F.col("n") * precision)
    return ok.groupBy(group).agg(F.min_by(F.struct("n", "accepted"), score).alias("x"), F.min(score).alias("threshold")).select(group, "threshold", (F.col("x.accepted") / F.col("x.n")).alias("precision"), "x.accepted", "x.n")


def open_cohort(cohort: DataFrame, key: str, done: DataFrame, parked: DataFrame, until: str, now: int) -> DataFrame:
    """The cohort without what is done, nor what is parked until later than ``now``."""
    still = parked.groupBy(key).agg(F.max(until).alias("_until")).where(F.col("_until") > now).select(key)
    return cohort.join(done.select(key).distinct(), key, "left_anti").join(still, key, "left_anti")


def ingest_slices(rows: DataFrame, slice_: str, error: Column, most: float) -> tuple[DataFrame, DataFrame]:
    """``(rows, report)``: the good rows of all slices in which at most a share ``most`` is bad; a failed slice gives none.
    ``report(slice, n, bad, status)`` has a row for each slice and a last one, with a null slice, for all."""
    marked = rows.withColumn("_bad", F.coalesce(error, F.lit(True)))
    per = marked.groupBy(slice_).agg(F.count("*").alias("n"), F.count_if("_bad").alias("bad"))
    per = per.withColumn("status", F.when(F.col("bad") > F.col("n") * most, "failed").otherwise("ok"))
    total = per.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.when(F.count_if(F.col("status") == "failed") > 0, "partial").otherwise("ok").alias("status")).select(F.lit(None).cast(rows.schema[slice_].dataType).alias(slice_), "n", "bad", "status")
    good = marked.where(~F.col("_bad")).join(per.where("status = 'ok'").select(slice_), slice_, "left_semi").drop("_bad")
    return good, per.unionByName(total)


def upsert_records(have: DataFrame, new: DataFrame, name: str, order: str) -> DataFrame:
    """Records with names that differ in case alone are one: its latest row, with the spelling of the first one."""
    both = have.unionByName(new)
    rest = [c for c in both.columns if c not in (name, order)]
    g = both.groupBy(F.lower(name).alias("_k")).agg(F.min_by(name, order).alias(name), F.max(order).alias(order), *[F.max_by(c, order).alias(c) for c in rest])
    return g.select(*both.columns)


def persist_entries(entries: DataFrame, places: DataFrame, breakdowns: DataFrame, countries: dict[str, str], country: str, run: str) -> dict[str, DataFrame]:
    """Parsed ``entries(name, region, source, page, elements)`` stored beside what is there; ``elements`` are ``(ordinal, ref, inflection)``.

    * ``places(id, name, region, country)``: the places that are there and the new ones, whose id is that of their name and region and whose country ``countries`` gives for the region
    * ``breakdowns(id, place, source, page)`` and ``elements(id, ordinal, ref, inflection)``: the new ones; the id is that of place, source, page and elements, so an entry that is there already, or comes twice, is stored once
    * ``run(run, entries, places, breakdowns)``: how many entries came and how many places and breakdowns were new

    An entry without a name or without elements is counted and not stored.
    """
    name, region = F.trim("name"), F.coalesce("region", F.lit(""))
    good = entries.where((F.coalesce(name, F.lit("")) != "") & (F.size("elements") > 0)).select(name.alias("name"), region.alias("region"), "source", F.coalesce("page", F.lit("")).alias("page"), F.array_sort("elements").alias("elements"))
    land = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in countries.items() for x in kv]), F.col("region")), F.lit(country)) if countries else F.lit(country)
    have = places.groupBy("name", F.coalesce("region", F.lit("")).alias("region")).agg(F.min("id").alias("id"))
    new = good.select("name", "region").distinct().join(have, ["name", "region"], "left_anti").select(content_id("TP", F.col("name"), F.col("region")).alias("id"), "name", "region", land.alias("country"))
    every = have.select("id", "name", "region").unionByName(new.select("id", "name", "region"))
    placed = good.join(every, ["name", "region"])
    told = placed.select(content_id("BD", F.col("id"), F.col("source"), F.col("page"), F.to_json("elements")).alias("id"), F.col("id").alias("place"), "source", "page", "elements").dropDuplicates(["id"])
    fresh = told.join(breakdowns.select("id").distinct(), "id", "left_anti")
    counts = entries.agg(F.count("*").alias("entries")).withColumn("run", F.lit(run))
    counts = counts.join(new.agg(F.count("*").alias("places"))).join(fresh.agg(F.count("*").alias("breakdowns")))  # one row each
    return {
        "places": places.select("id", "name", "region", "country").unionByName(new), "breakdowns": fresh.select("id", "place", "source", "page"),
        "elements": fresh.select("id", F.explode("elements").alias("e")).select("id", "e.*"), "run": counts.select("run", "entries", "places", "breakdowns"),
    }


def fold_cohorts(residue: DataFrame, word: str, clusters: DataFrame, letters: int, most: int) -> DataFrame:
    """``(word, cluster, member)``: for each word without a cluster the first ``most`` members, in order, of ``clusters(cluster, member)`` that begin with the same ``letters`` folded letters; shorter words have none.

    The members of a beginning are cut to ``most`` before they meet its words, so a common beginning makes no more rows than that for each.
    """
    head = lambda c: F.left(fold_surface(F.col(c)), F.lit(letters))
    first = clusters.select("cluster", "member", head("member").alias("_h")).distinct().where(F.length("_h") == letters)
    first = first.withColumn("_k", F.row_number().over(Window.partitionBy("_h").orderBy("member", "cluster"))).where(F.col("_k") <= most)
    asked = residue.select(F.col(word).alias("word"), head(word).alias("_h")).distinct()
    return asked.join(first, "_h").select("word", "cluster", "member")


def composed(c: Column) -> Column:
    """Text in composed form (NFC), so that a letter with a mark is one character however it was written."""

    @F.pandas_udf("string")
    def normal(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))

    return normal(c)


def open_slice(cohort: DataFrame, key: str, done: DataFrame, parked: DataFrame, until: str, now: int, evidence: DataFrame, order: list, most: int) -> DataFrame:
    """``(key, evidence)`` of what is open (:func:`open_cohort`, by keys in composed form), with the first ``most`` quotes of each in ``evidence(key, quote)``; none gives an empty list."""
    same = lambda df: df.withColumn(key, composed(F.col(key)))
    left = open_cohort(same(cohort).select(key).distinct(), key, same(done), same(parked), until, now)
    told = same(evidence).join(left, key, "left_semi")
    first = told.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_k") <= most).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "quote"))), lambda x: x["quote"]).alias("evidence"))
    return left.join(first, key, "left").select(key, F.coalesce("evidence", F.array().cast("array<string>")).alias("evidence"))
