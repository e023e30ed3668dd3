"""Gazetteers: exported tables of places and forms, cells that list the elements of a name, names looked up with a spelling off."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import fold_surface
from ..operators.text import deletion_neighbours


def resolve_forms(places: DataFrame, forms: DataFrame, counties: dict[str, tuple[str, str]], have: DataFrame, attested: DataFrame, year: int, uncertain: tuple[str, ...] = ("speculative", "unknown"), country: str = "England") -> dict[str, DataFrame]:
    """An export of ``places(idx, page)`` and ``forms(idx, name, county, status, hundred, grid)`` against the toponyms and attestations that are there.

    ``counties`` gives the region and country of a county code (an unknown code is its own region, of the default ``country``); ``have(id, name, region)``, ``attested(id, form, year, source)``.

    * ``toponyms(name, region, country, id)``: each name and region once, with its id (the least) or null where it is new
    * ``attestations(name, region, year, source)``: those that aren't attested yet, each once; the source is the page, else the hundred, else the grid reference
    * ``counts(what, n)``: forms by what became of them, names new and there, attestations new and there

    A form of an ``uncertain`` status, without a name or without a county is left out, and counted by the first of these.
    """
    f = forms.withColumn("_why", F.when(F.col("status").isin(*uncertain), "uncertain").when(F.coalesce("name", F.lit("")) == "", "no name").when(F.coalesce("county", F.lit("")) == "", "no county"))
    pages = places.groupBy("idx").agg(F.max("page").alias("page"))
    pairs = [x for code, (region, land) in counties.items() for x in (F.lit(code), F.struct(F.lit(region).alias("region"), F.lit(land).alias("country")))]
    of = F.try_element_at(F.create_map(*pairs), F.col("county")) if pairs else F.lit(None).cast("struct<region:string,country:string>")
    good = f.where("_why is null").join(pages, "idx", "left").withColumn("_c", of)
    good = good.select("name", F.coalesce("_c.region", "county").alias("region"), F.coalesce("_c.country", F.lit(country)).alias("country"), F.coalesce("page", "hundred", "grid", F.lit("")).alias("source"))
    known = have.groupBy("name", "region").agg(F.min("id").alias("id"))
    toponyms = good.groupBy("name", "region").agg(F.min("country").alias("country")).join(known, ["name", "region"], "left")
    facts = good.select("name", "region", "source").distinct().join(known, ["name", "region"], "left")
    there = attested.where(F.col("year") == year).select("id", F.col("form").alias("name"), "source").distinct().withColumn("_there", F.lit(True))
    facts = facts.join(there, ["id", "name", "source"], "left")
    new = facts.where("_there is null")
    total = lambda df, what: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    counts = [f.groupBy(F.coalesce("_why", F.lit("taken")).alias("what")).agg(F.count("*").alias("n")), total(toponyms.where("id is null"), "new names"), total(toponyms.where("id is not null"), "known names"), total(new, "new attestations"), total(facts.where("_there"), "known attestations")]
    return {"toponyms": toponyms, "attestations": new.select("name", "region", F.lit(year).alias("year"), "source"), "counts": reduce(DataFrame.unionByName, counts)}


def derivation(text: Column, languages: dict[str, str]) -> Column:
    """``(elements, unmapped, dropped)`` of a cell ``form Label - gloss; form Label - gloss``, elements ``(form, language, gloss)`` with the language that ``languages`` gives for a label.

    A gloss may hold semicolons itself: a chunk begins an element only where the text before its `` - `` ends in a known label.  One whose text ends in a capitalised word there is an element of an unknown
    language, counted as ``unmapped``.  Any other continues the gloss before it, or is counted as ``dropped`` where there is none.
    """
    labels = "|".join(re.escape(x) for x in sorted(languages, key=len, reverse=True))
    known, odd = rf"(?:^|\s)({labels})$", r"[A-Z][a-zA-Z]*$"
    pre = lambda c: F.trim(F.element_at(F.split(c, " - ", 2), 1))
    gloss = lambda c: F.when(F.contains(c, F.lit(" - ")), F.trim(F.element_at(F.split(c, " - ", 2), 2)))
    table = F.create_map(*[F.lit(x) for kv in languages.items() for x in kv])
    kind = "struct<elements:array<struct<form:string,language:string,gloss:string>>,unmapped:int,dropped:int>"
    chunks = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ";"), lambda c: F.trim(c)), lambda c: c != "")
    state = lambda e, u, d: F.struct(e.alias("elements"), u.alias("unmapped"), d.alias("dropped")).cast(kind)

    def step(s, c):
        done, last = s["elements"], F.get(s["elements"], F.size(s["elements"]) - 1)
        new = F.struct(F.trim(F.regexp_replace(pre(c), known, "")).alias("form"), F.try_element_at(table, F.regexp_extract(pre(c), known, 1)).alias("language"), gloss(c).alias("gloss"))
        longer = F.struct(last["form"].alias("form"), last["language"].alias("language"), F.concat(last["gloss"], F.lit("; "), c).alias("gloss"))
        return (
            F.when(pre(c).rlike(known), state(F.concat(done, F.array(new)), s["unmapped"], s["dropped"]))
            .when(F.contains(c, F.lit(" - ")) & pre(c).rlike(odd), state(done, s["unmapped"] + 1, s["dropped"]))
            .when((F.size(done) > 0) & last["gloss"].isNotNull(), state(F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(longer)), s["unmapped"], s["dropped"]))
            .otherwise(state(done, s["unmapped"], s["dropped"] + 1))
        )

    none = F.array().cast("array<struct<form:string,language:string,gloss:string>>")
    return F.aggregate(chunks, state(none, F.lit(0), F.lit(0)), step)


def match_names(asks: DataFrame, name: str, index: DataFrame, least: int = 4) -> DataFrame:
    """``(name, form, language, tier)`` of each distinct asked name: by its folded key in ``index(form, language)``, else by a key one edit away where both have ``least`` letters, else ``miss``.

    Of forms with one key the least counts, of several keys one edit away the least key.
    """
    keyed = index.withColumn("_k", fold_surface(F.col("form"))).where("_k <> ''").groupBy("_k").agg(F.min(F.struct("form", "language")).alias("_v"))
    a = asks.select(F.col(name).alias("name")).where("name is not null").distinct().withColumn("_f", fold_surface(F.col("name")))
    exact = a.join(keyed.withColumnsRenamed({"_k": "_f", "_v": "_t1"}), "_f", "left")
    left = exact.where(f"_t1 is null and length(_f) >= {least}").select("_f").distinct().withColumn("_n", F.explode(deletion_neighbours(F.col("_f"))))
    right = keyed.where(f"length(_k) >= {least}").withColumn("_n", F.explode(deletion_neighbours(F.col("_k"))))
    near = left.join(right, "_n").where(F.levenshtein("_f", "_k") <= 1).groupBy("_f").agg(F.min(F.struct("_k", "_v"))["_v"].alias("_t2"))
    out = exact.join(near, "_f", "left").withColumn("_v", F.coalesce("_t1", "_t2"))
    return out.select("name", "_v.form", "_v.language", F.when(F.col("_t1").isNotNull(), "t1").when(F.col("_t2").isNotNull(), "t2").otherwise("miss").alias("tier"))


def checked_csv(spark, path: str, columns: list[str], name: str, year: str | None, default_year: int, window: tuple[int, int], kind: str | None = None, kinds: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """``(rows, warnings)`` of CSV files with a header that has all ``columns`` in this order: the rows with ``date_year``, and ``(what, n)``.

    A header that lacks a column fails the read.  Left out and counted are rows of another number of columns, rows with a blank ``name`` and, where ``kind`` is given, rows of other ``kinds``; a year
    that is no number or out of the ``window`` is counted and becomes the default, a blank one is the default without a word.
    """
    have = spark.read.option("header", True).csv(path).columns
    if missing := [c for c in columns if c not in have]:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    schema = ", ".join(f"`{c}` string" for c in [*have, "_bad"])
    df = spark.read.option("header", True).option("enforceSchema", True).option("columnNameOfCorruptRecord", "_bad").schema(schema).csv(path)
    y = F.col(year).try_cast("int") if year else F.lit(None).cast("int")
    told = F.trim(F.coalesce(F.col(year) if year else F.lit(None), F.lit(""))) != ""
    good = y.between(*window)
    why = F.when(F.col("_bad").isNotNull(), "columns").when(F.trim(F.coalesce(name, F.lit(""))) == "", "blank name")
    if kind is not None:
        why = F.when(why.isNotNull(), why).when(~F.coalesce(F.col(kind).isin(*kinds), F.lit(False)), "kind")
    marked = df.select("*", why.alias("_why"), F.when(told & y.isNull(), "no year").when(told & ~good, "year out of window").alias("_warn"), F.when(good, y).otherwise(default_year).alias("date_year"))
    rows = marked.where("_why is null").select(*columns, "date_year")
    warnings = marked.select(F.coalesce("_why", "_warn").alias("what")).where("what is not null").groupBy("what").agg(F.count("*").alias("n"))
    return rows, warnings
