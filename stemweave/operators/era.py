"""Forms through time: rewriting rules per language and pair of eras, both ways, and names taken back part by part."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import segment


def rewritten(form: str, rules, inverse: bool, floor: float) -> dict[str, float]:
    """Candidates of one form with their masses, which sum to one.

    Forward, a rule of weight one replaces what it finds, a lighter one branches by its weight.  Backwards the rules come in reversed order with both sides
    swapped, and each one that finds something branches evenly, since what it made may have been there before.  Equal candidates are
    merged; after each rule those below ``floor`` go, or all but the form itself if none would be left.
    """
    masses = {form: 1.0}
    for r in reversed(rules) if inverse else rules:
        old, new = (r["replacement"], r["pattern"]) if inverse else (r["pattern"], r["replacement"])
        if not old:
            continue
        share = 0.5 if inverse else min(r["weight"], 1.0)
        after: dict[str, float] = {}
        for f, mass in masses.items():
            changed = f.replace(old, new)
            parts = ((f, mass),) if old not in f else ((changed, mass),) if share == 1.0 else ((changed, mass * share), (f, mass * (1.0 - share)))
            for g, m in parts:
                after[g] = after.get(g, 0.0) + m
        if len(after) > 1:
            after = {g: m for g, m in after.items() if m >= floor} or {form: 1.0}
        masses = after
    total = sum(masses.values())
    return {g: m / total for g, m in masses.items()}


def rewrite_forms(forms: DataFrame, form: str, cell: list[str], rules: DataFrame, inverse: bool = False, floor: float = 1e-6) -> DataFrame:
    """``(form, *cell, candidate, mass)`` of each distinct form in its cell, the columns that name a language and two eras.

    ``rules(*cell, k, pattern, replacement, weight)`` are met by their cell and act in order of ``k``, each on plain text; ``inverse`` reads a cell backwards.  A cell
    without rules gives the form itself with mass one; a null form has no candidates.
    """

    def run(frames):
        for pdf in frames:
            rows = [(i, g, m) for i, f, r in zip(pdf["key"], pdf["form"], pdf["rules"]) for g, m in rewritten(f, [] if r is None else list(r), inverse, floor).items()]
            key, candidate, mass = zip(*rows) if rows else ((), (), ())
            yield pd.DataFrame({"key": key, "candidate": candidate, "mass": mass})

    lists = rules.groupBy(*cell).agg(F.sort_array(F.collect_list(F.struct("k", "pattern", "replacement", "weight"))).alias("rules"))
    asked = forms.select(F.col(form).alias("form"), *cell).where("form is not null").distinct().join(lists, cell, "left")
    keyed = asked.select(F.struct("form", *cell).alias("key"), "form", "rules")
    kind = keyed.schema["key"].dataType

    # pandas has no struct keys: they travel as JSON
    schema = "key string, candidate string, mass double"
    out = keyed.withColumn("key", F.to_json("key", {"ignoreNullFields": "false"})).mapInPandas(run, schema)
    return out.select(F.from_json("key", kind).alias("key"), "candidate", "mass").select(F.col("key.form").alias(form), *[F.col(f"key.{c}").alias(c) for c in cell], "candidate", "mass")


def walk_eras(forms: DataFrame, form: str, family: str, start: str, end: str, chain: dict[str, list[str]], rules: DataFrame, floor: float = 1e-6) -> DataFrame:
    """``forms`` plus ``reached``: the form at the era ``end`` from that of ``start``, by the cells between them in the family's ``chain`` of eras.

    Each cell takes the heaviest candidate (of equal ones the first in order) to the next; towards an earlier era cells are read backwards.  Null where an era isn't in the chain, where
    both are the same, or where nothing changed.  ``rules(family, from_era, to_era, k, pattern, replacement, weight)``.
    """
    eras = F.create_map(*[x for f, es in chain.items() for x in (F.lit(f), F.array(*map(F.lit, es)))])
    at = lambda c: F.array_position(F.try_element_at(eras, F.col(family)), F.col(c)).cast("int")
    asked = forms.select(form, family, start, end).distinct().withColumn("_i", at(start)).withColumn("_j", at(end))
    rows = asked.where(f"_i > 0 and _j > 0 and _i <> _j and {form} is not null").withColumn("_now", F.col(form)).withColumn("_es", F.try_element_at(eras, F.col(family)))
    for step in range(max((len(es) for es in chain.values()), default=1) - 1):
        parts = []
        for inverse in (False, True):
            here = F.col("_i") - step if inverse else F.col("_i") + step
            goes = (F.col("_i") > F.col("_j")) == F.lit(inverse)
            mine = rows.where(goes).withColumn("_moves", here > F.col("_j") if inverse else here < F.col("_j"))
            a, b = (here - 1, here) if inverse else (here, here + 1)
            mine = mine.withColumn("from_era", F.when(F.col("_moves"), F.get("_es", a - 1))).withColumn("to_era", F.when(F.col("_moves"), F.get("_es", b - 1)))
            found = rewrite_forms(mine.where("_moves"), "_now", [family, "from_era", "to_era"], rules, inverse, floor)
            best = found.groupBy("_now", family, "from_era", "to_era").agg(F.min(F.struct((-F.col("mass")).alias("m"), "candidate"))["candidate"].alias("_next"))
            parts.append(mine.join(best, ["_now", family, "from_era", "to_era"], "left").select(*[c for c in rows.columns if c != "_now"], F.coalesce("_next", "_now").alias("_now")))
        rows = parts[0].unionByName(parts[1])
    done = rows.select(form, family, start, end, F.nullif("_now", F.col(form)).alias("reached"))
    return forms.join(done, [form, family, start, end], "left")


# ------------------------------------------------------------------------------ names


def named_parts(names: DataFrame, name: str, dictionary: DataFrame, entry: str, glue: tuple[str, ...] = ()) -> DataFrame:
    """``(name, word, part, token, known)``: the best parse of each word of each distinct name, words and parts numbered from 0; a token in brackets is unknown and loses them."""
    words = names.select(F.col(name).alias("name")).where("name is not null").distinct().select("name", F.posexplode(F.split("name", " +")).alias("word", "_w")).where("_w <> ''")
    parses = segment(words, "_w", dictionary, entry, glue).select(F.col("word").alias("_l"), F.posexplode(F.split("parse", " ")).alias("part", "_t"))
    known = ~F.startswith("_t", F.lit("("))
    token = F.when(known, F.col("_t")).otherwise(F.expr("substring(_t, 2, length(_t) - 2)"))
    return words.join(parses, F.lower("_w") == F.col("_l")).where("not startswith(_t, '+')").select("name", "word", "part", token.alias("token"), known.alias("known"))


def anchored(parts: DataFrame, token: str, anchors: DataFrame, preference: list[str]) -> DataFrame:
    """``(token, entity, language, form)`` of each distinct token: its entry in the first language of ``preference`` that has one, there the one of the least ``place``, then form and entity.

    ``anchors(surface, language, place, form, entity)``; surfaces are compared in lower case and without dashes.  Tokens without an entry have none.
    """
    rank = F.array_position(F.array(*map(F.lit, preference)), F.col("language"))
    a = anchors.withColumn("_s", F.replace(F.lower("surface"), F.lit("-"), F.lit(""))).where(rank > 0)
    best = a.groupBy("_s").agg(F.min(F.struct(rank.alias("r"), "place", "form", "entity", "language")).alias("b"))
    return parts.select(token).distinct().join(best, F.lower(token) == F.col("_s")).select(token, "b.entity", "b.language", "b.form")


def parts_at_stops(anchor: DataFrame, forms: DataFrame, stops: list[tuple[str, str, int | None]], modern: str) -> DataFrame:
    """``(token, stop, shown, fallback)`` of each anchored token at each stop ``(name, language, year)``.

    In the language of its anchor a token has the anchor's form, in the ``modern`` one it stays.  Else it is the form that its entity has in that language at the year or last
    before it (any form where the stop has no year); of those of one year the token itself, then the anchor's form, then the first in order.  Where there is
    none, the token stands for itself and ``fallback`` is true.  ``forms(entity, language, year, form)``.
    """
    table = F.array(*[F.struct(F.lit(n).alias("stop"), F.lit(lang).alias("at"), F.lit(y).cast("int").alias("by")) for n, lang, y in stops])
    asked = anchor.select("token", "entity", "language", "form", F.explode(table).alias("s")).select("token", "entity", "language", "form", "s.*")
    f = forms.select(F.col("entity").alias("_e"), F.col("language").alias("_l"), F.col("year").alias("_y"), F.col("form").alias("_f"))
    tier = F.when(F.lower("_f") == F.lower("token"), 0).when(F.lower("_f") == F.lower("form"), 1).otherwise(2)
    met = asked.join(f, (F.col("entity") == F.col("_e")) & (F.col("at") == F.col("_l")) & (F.col("by").isNull() | (F.col("_y") <= F.col("by"))))
    year = F.when(F.col("by").isNotNull(), -F.col("_y"))
    mates = met.groupBy("token", "stop").agg(F.min(F.struct(year.alias("y"), tier.alias("t"), "_f")).alias("m"))
    shown = F.when(F.col("language") == F.col("at"), F.col("form")).when(F.col("at") == modern, F.col("token")).otherwise(F.col("m._f"))
    out = asked.join(mates, ["token", "stop"], "left").withColumn("_shown", shown)
    return out.select("token", "stop", F.coalesce("_shown", "token").alias("shown"), F.col("_shown").isNull().alias("fallback"))


def _assembled(parts: Column, smart: Column) -> Column:
    """The parts ``(word, part, shown, particle)`` of a name as it is written: words apart, parts together, particles by themselves in lower case."""
    mark = "\u0001"
    piece = lambda x: F.when(smart & x["particle"], F.concat(F.lit(f" {mark}"), F.lower(x["shown"]), F.lit(" "))).otherwise(x["shown"])
    text = F.array_join(F.transform(parts, lambda x: F.concat(F.when(x["part"] == 0, F.lit(" ")).otherwise(F.lit("")), piece(x))), "")
    tokens = F.filter(F.split(text, " +"), lambda x: x != "")
    return F.array_join(F.transform(tokens, lambda x: F.when(F.startswith(x, F.lit(mark)), F.replace(x, F.lit(mark), F.lit(""))).otherwise(F.concat(F.upper(F.left(x, F.lit(1))), F.lower(F.substring(x, F.lit(2), F.length(x)))))), " ")


def rewind_names(names: DataFrame, name: str, dictionary: DataFrame, entry: str, anchors: DataFrame, forms: DataFrame, preference: list[str], stops: list[tuple[str, str, int | None]], modern: str, particles: tuple[str, ...] = (), glue: tuple[str, ...] = ()) -> DataFrame:
    """``(name, stop, rendered, fallback, fallbacks, unaccounted)`` of each distinct name at each stop.

    Names are taken apart (:func:`named_parts`), parts anchored (:func:`anchored`) and looked up once each at every stop (:func:`parts_at_stops`), then put together
    again in their order: words stay words, and at older stops a particle stands by itself.  ``fallbacks`` are the parts that keep their modern form,
    ``fallback`` says whether there is one; letters that no entry accounts for aren't rendered but listed.
    """
    parts = named_parts(names, name, dictionary, entry, glue)
    known = parts.where("known")
    anchor = anchored(known, "token", anchors, preference)
    seen = parts_at_stops(anchor, forms, stops, modern)
    table = F.array(*[F.struct(F.lit(n).alias("stop"), F.lit(lang != modern).alias("smart")) for n, lang, _ in stops])
    each = known.select("name", "word", "part", "token", F.explode(table).alias("s")).select("name", "word", "part", "token", "s.*").join(seen, ["token", "stop"], "left")
    missing = F.coalesce("fallback", F.lit(True))
    particle = F.lower("token").isin(*particles) if particles else F.lit(False)
    whole = each.groupBy("name", "stop", "smart").agg(
        F.sort_array(F.collect_list(F.struct("word", "part", F.coalesce("shown", "token").alias("shown"), particle.alias("particle")))).alias("p"), F.bool_or(missing).alias("fallback"),
        F.transform(F.sort_array(F.collect_list(F.when(missing, F.struct("word", "part", "token")))), lambda x: x["token"]).alias("fallbacks"),
    )
    left = parts.groupBy("name").agg(F.transform(F.sort_array(F.collect_list(F.when(~F.col("known"), F.struct("word", "part", "token")))), lambda x: x["token"]).alias("unaccounted"))
    first = F.transform("p", lambda x, i: F.struct(x["word"], F.when((i == 0) | (F.get("p", i - 1)["word"] != x["word"]), 0).otherwise(1).alias("part"), x["shown"].alias("shown"), x["particle"].alias("particle")))
    stops_of = parts.select("name").distinct().select("name", F.explode(F.array(*[F.lit(n) for n, _, _ in stops])).alias("stop"))
    out = stops_of.join(whole.withColumn("p", first), ["name", "stop"], "left").join(left, "name")
    none = F.array().cast("array<string>")
    return out.select("name", "stop", F.coalesce(_assembled(F.col("p"), F.col("smart")), F.lit("")).alias("rendered"), F.coalesce("fallback", F.lit(True)).alias("fallback"), F.coalesce("fallbacks", none).alias("fallbacks"), "unaccounted")


def name_readings(names: DataFrame, name: str, dictionary: DataFrame, entry: str, glue: tuple[str, ...] = ()) -> DataFrame:
    """``(name, reading, unaccounted, morphemes)``: every way to read a name by taking one of the tied best parses for each of its words, joined by `` / ``.

    Words are parsed once each, however many names have them; readings grow by one word a join, so no task holds the product of a name.
    """
    words = names.select(F.col(name).alias("name")).where("name is not null").distinct().select("name", F.filter(F.split(F.lower("name"), " +"), lambda x: x != "").alias("_ws")).where("size(_ws) > 0")
    ties = segment(words.select(F.explode("_ws").alias("_w")), "_w", dictionary, entry, glue, all_ties=True).select(F.col("word").alias("_w"), F.col("parse").alias("_p"), F.col("unaccounted").alias("_u"), F.col("morphemes").alias("_m"))
    most = words.agg(F.max(F.size("_ws"))).first()[0] or 0
    rows = words.select("name", "_ws", F.lit("").alias("reading"), F.lit(0).cast("long").alias("unaccounted"), F.lit(0).cast("long").alias("morphemes"))
    for i in range(most):
        joined = rows.withColumn("_w", F.get("_ws", F.lit(i))).join(ties, "_w", "left" if i else "inner")
        rows = joined.select("name", "_ws", F.when(F.col("_p").isNull(), F.col("reading")).when(F.col("reading") == "", F.col("_p")).otherwise(F.concat("reading", F.lit(" / "), "_p")).alias("reading"), *[(F.col(c) + F.coalesce(d, F.lit(0))).alias(c) for c, d in (("unaccounted", "_u"), ("morphemes", "_m"))])
    return rows.drop("_ws")
