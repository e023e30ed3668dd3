"""What decomposed names are made of, by culture: seven tallies; and score cards of how far each language is covered."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import position_label


def name_tallies(parts: DataFrame, culture: str, name: str) -> dict[str, DataFrame]:
    """Seven tallies of ``parts(culture, name, word, part, surface, tags, language, flag)``, the parts of the words of each name (both numbered from 0).

    * ``usages(culture, surface, position, n)``: parts of words of several parts, by where they stand in the word (pre, inner, post)
    * ``single_usages(culture, surface, n)``: words of one part
    * ``structures(culture, structure, n)``: the positions of the parts of a name's words, as ``pre-post post``; a part with a flag has it behind a colon.  Left out are structures in which
      a word is a pre, inner or post part alone without a flag, which stands nowhere in a name
    * ``tag_marginal(culture, tag, n)`` and ``tag_pairs(culture, left, right, n)``: of neighbours in a name, also across words, each tag of either, and each tag of the one with each of the other
    * ``languages(culture, surface, languages)``: the languages that a surface's parts are from
    * ``word_positions(culture, position, surface, n)``: of names of several words, the words of one part by where they stand among the words

    Surfaces are compared in lower case without dashes and outer blanks; null tags are none.  What is gathered is one name at a time.
    """
    surface = F.trim(F.lower(F.regexp_replace("surface", r"\p{Pd}", "")))
    p = parts.select(F.col(culture).alias("culture"), F.col(name).alias("_name"), "word", "part", surface.alias("surface"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), "language", "flag", F.col("surface").rlike(r"^\p{Pd}").alias("_tail"), F.col("surface").rlike(r"\p{Pd}$").alias("_head"))
    whole = p.groupBy("culture", "_name").agg(F.array_sort(F.collect_list(F.struct("word", "part", "surface", "tags", "language", "flag", "_tail", "_head"))).alias("p"))
    sizes = F.transform("p", lambda x: F.size(F.filter("p", lambda y: y["word"] == x["word"])))
    ranks = F.transform("p", lambda x: F.size(F.filter("p", lambda y: (y["word"] == x["word"]) & (y["part"] <= x["part"]))))
    words = F.array_distinct(F.transform("p", lambda x: x["word"]))
    rows = whole.select("culture", "_name", "p", F.posexplode(F.arrays_zip(F.col("p").alias("x"), sizes.alias("size"), ranks.alias("rank"))).alias("_i", "z"), F.size(words).alias("n_words"), words.alias("_words"))
    rows = rows.select("culture", "_name", "_i", "z.size", "z.rank", "z.x.*", "n_words", F.array_position("_words", F.col("z.x.word")).cast("int").alias("word_rank"))
    alone = F.when(F.col("_tail") & F.col("_head"), "inner").when(F.col("_tail"), "post").when(F.col("_head"), "pre").otherwise("bare")
    rows = rows.withColumn("position", F.when(F.col("size") > 1, position_label(F.col("rank"), F.col("size"))).otherwise(alone))
    several, single = F.col("size") > 1, F.col("size") == 1

    shown = F.when(F.col("flag").isNotNull(), F.concat_ws(":", "position", "flag")).otherwise(F.col("position"))
    stray = single & F.col("flag").isNull() & (F.col("position") != "bare")
    per_word = rows.groupBy("culture", "_name", "word").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", shown.alias("s")))), lambda x: x["s"]), "-").alias("s"), F.bool_or(stray).alias("stray"))
    per_name = per_word.groupBy("culture", "_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word", "s"))), lambda x: x["s"]), " ").alias("structure"), F.bool_or("stray").alias("stray"))

    step = lambda i: F.struct(F.get("p", i - 1)["tags"].alias("l"), F.get("p", i)["tags"].alias("r"))
    pairs = whole.where("size(p) > 1").select("culture", F.explode(F.transform(F.sequence(F.lit(1), F.size("p") - 1), step)).alias("z"))
    # a tag of the left one counts once a pair, one of the right one likewise
    marginal = pairs.select("culture", F.explode(F.concat("z.l", "z.r")).alias("tag"))
    both = pairs.select("culture", "z.r", F.explode("z.l").alias("left")).select("culture", "left", F.explode("r").alias("right"))
    count = F.count("*").alias("n")
    return {
        "usages": rows.where(several).groupBy("culture", "surface", "position").agg(count),
        "single_usages": rows.where(single).groupBy("culture", "surface").agg(count),
        "structures": per_name.where("not stray").groupBy("culture", "structure").agg(count),
        "tag_marginal": marginal.groupBy("culture", "tag").agg(count),
        "tag_pairs": both.groupBy("culture", "left", "right").agg(count),
        "languages": rows.where("language is not null").groupBy("culture", "surface").agg(F.array_sort(F.collect_set("language")).alias("languages")),
        "word_positions": rows.where(single & (F.col("n_words") > 1)).groupBy("culture", position_label(F.col("word_rank"), F.col("n_words")).alias("position"), "surface").agg(count),
    }


def _rate(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(part / whole, 4)).otherwise(0.0)


def scorecards(words: DataFrame, citations: DataFrame, tags: DataFrame, variants: DataFrame, inflections: DataFrame, edges: DataFrame, periods: DataFrame, subjects: DataFrame, reference_tags: list[str], thresholds: dict[str, int], default: int = 3) -> DataFrame:
    """A row for each language of ``words(id, language, lemma, eligible, stratum, ipa, cognate)``, in groups:

    A depth: words, lemmas (words without a lemma of their own), the eligible of both, those with as many distinct sources as the language's threshold asks for, sources a word, distinct sources;
    B attestation of ``subjects(language, tags, attested, ipa, reflex)``, by what attests them (scholar, empirical, port or nothing);
    C tags: eligible words with a tag, and the share of the reference tags that some word, or some subject, has;
    D inflections ``(id, label)`` of eligible lemmas and distinct labels; E variants ``(id)``; F older and younger words along ``edges(parent, child)``, cognates, ``periods(id)``, and any of these;
    G strata; H pronunciations of words and subjects; I citations ``(id, source)`` of eligible words and how many each has.

    Shares are of eligible words (or lemmas, or subjects), with four digits, and 0 where there are none.  Each detail table is brought to one row a word first, so nothing is counted twice and every language is
    one aggregation.
    """
    one = lambda df, *aggs: df.groupBy("id").agg(*aggs)
    known = F.array(*map(F.lit, reference_tags)) if reference_tags else F.array().cast("array<string>")
    of_word = [
        one(citations, F.count_distinct("source").alias("witnesses"), F.count("*").alias("cites")),
        one(tags, F.lit(True).alias("tagged")), one(variants, F.lit(True).alias("varied")), one(inflections, F.lit(True).alias("inflected")),
        one(edges.select(F.col("child").alias("id")), F.lit(True).alias("older")), one(edges.select(F.col("parent").alias("id")), F.lit(True).alias("younger")), one(periods, F.lit(True).alias("period")),
    ]
    w = reduce(lambda df, d: df.join(d, "id", "left"), of_word, words)
    limit = F.coalesce(F.try_element_at(F.create_map(*[x for k, v in thresholds.items() for x in (F.lit(k), F.lit(v))]), F.col("language")), F.lit(default)) if thresholds else F.lit(default)
    ok, lemma, seen = F.col("eligible"), F.col("lemma").isNull(), F.coalesce("witnesses", F.lit(0))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    related = yes("older") | yes("younger") | yes("period") | F.col("cognate").isNotNull()
    depth = w.groupBy("language").agg(
        F.count("*").alias("words"), F.count_if(lemma).alias("lemmas"), F.count_if(ok).alias("eligible"), F.count_if(ok & lemma).alias("eligible_lemmas"), F.count_if(ok & (seen >= limit)).alias("promotable"),
        F.coalesce(F.round(F.avg(F.when(ok, seen)), 4), F.lit(0.0)).alias("witnesses"), F.count_if(ok & yes("tagged")).alias("tagged"), F.count_if(ok & lemma & yes("inflected")).alias("inflected"), F.count_if(ok & yes("varied")).alias("varied"),
        F.count_if(ok & yes("older")).alias("older"), F.count_if(ok & yes("younger")).alias("younger"), F.count_if(ok & F.col("cognate").isNotNull()).alias("cognates"), F.count_if(ok & yes("period")).alias("periods"), F.count_if(ok & related).alias("related"),
        F.count_if(ok & F.col("stratum").isNotNull()).alias("strata"), F.count_if(ok & F.col("ipa").isNotNull()).alias("sounded"), F.count_if(ok & F.col("cites").isNotNull()).alias("cited"), F.coalesce(F.round(F.avg(F.when(ok, F.col("cites"))), 4), F.lit(0.0)).alias("cites"),
    )
    language = words.select("id", "language")
    told = lambda df, c, n: df.join(language, "id").groupBy("language").agg(F.count_distinct(c).alias(n))
    sources, labels = told(citations, "source", "sources"), told(inflections, "label", "labels")
    hits = tags.where(F.array_contains(known, F.col("tag"))).join(language, "id").groupBy("language").agg(F.count_distinct("tag").alias("tags_hit"))
    s = subjects.groupBy("language").agg(F.count("*").alias("subjects"), *[F.count_if(F.col("attested") == k).alias(f"by_{k}") for k in ("scholar", "empirical", "port")], F.count_if(F.col("attested").isNull()).alias("by_nothing"), F.count_if(F.col("reflex")).alias("subject_reflexes"), F.count_if(F.col("ipa").isNotNull()).alias("subject_sounds"))
    s_hits = subjects.select("language", F.explode("tags").alias("tag")).where(F.array_contains(known, F.col("tag"))).groupBy("language").agg(F.count_distinct("tag").alias("subject_tags_hit"))
    out = reduce(lambda a, b: a.join(b, "language", "left"), [sources, labels, hits, s, s_hits], depth).fillna(0)
    n, shares = F.lit(max(len(reference_tags), 1)), {}
    for name, part, whole in (
        ("tag_rate", "tagged", "eligible"), ("inflection_rate", "inflected", "eligible_lemmas"), ("variant_rate", "varied", "eligible"), ("related_rate", "related", "eligible"), ("stratum_rate", "strata", "eligible"),
        ("sound_rate", "sounded", "eligible"), ("scholar_rate", "by_scholar", "subjects"), ("subject_reflex_rate", "subject_reflexes", "subjects"), ("subject_sound_rate", "subject_sounds", "subjects"),
    ):
        shares[name] = _rate(F.col(part), F.col(whole))
    return out.withColumns(shares | {"tag_hit_rate": F.round(F.col("tags_hit") / n, 4), "subject_tag_hit_rate": F.round(F.col("subject_tags_hit") / n, 4)})
