"""Rewriting both ways, names rewound by parts, readings, slots, repeats and rendering."""

import json
import random

import pytest
from pyspark.sql import functions as F

from stemweave.functions import scalars
from stemweave.operators import era, generation, joins, text

RULES = [("en", "old", "mid", 1, "ē", "e", 1.0), ("en", "old", "mid", 2, "ǣ", "e", 1.0), ("en", "old", "mid", 3, "sċ", "sh", 1.0), ("en", "mid", "new", 1, "a", "o", 0.25), ("en", "mid", "new", 2, "sh", "ch", 1.0)]
KIND = "family string, from_era string, to_era string, k int, pattern string, replacement string, weight double"
CELL = ["family", "from_era", "to_era"]


def candidates(spark, form, cell, inverse=False):
    df = spark.createDataFrame([(form, *cell)], "form string, family string, from_era string, to_era string")
    return {r.candidate: r.mass for r in era.rewrite_forms(df, "form", CELL, spark.createDataFrame(RULES, KIND), inverse).collect()}


def test_cells_both_ways(spark):
    assert candidates(spark, "fisċ", ("en", "old", "mid")) == {"fish": 1.0}
    back = candidates(spark, "deg", ("en", "old", "mid"), True)
    # the later rule is undone first, then the earlier one where an e is left
    assert back == {"dǣg": 0.5, "dēg": 0.25, "deg": 0.25} and sum(back.values()) == pytest.approx(1)
    assert "fisċ" in candidates(spark, "fish", ("en", "old", "mid"), True)
    assert candidates(spark, "qqq", ("en", "old", "mid"), True) == {"qqq": 1.0}
    assert candidates(spark, "any", ("cy", "old", "mid")) == {"any": 1.0} == candidates(spark, "any", ("cy", "old", "mid"), True)
    assert candidates(spark, "sash", ("en", "mid", "new")) == {"soch": 0.25, "sach": 0.75}


def test_masses_are_pruned_and_sum_to_one():
    rules = [{"pattern": chr(98 + k) * 2, "replacement": chr(97 + k), "weight": 1.0} for k in range(25)]
    got = era.rewritten("abcdefghijklmnopqrstuvwxy", rules, True, 1e-3)
    assert 0 < len(got) <= 1000 and sum(got.values()) == pytest.approx(1)
    assert era.rewritten("ab", [{"pattern": "x", "replacement": "a", "weight": 1.0}], True, 0.9) == {"ab": 1.0}


def test_walks_along_eras(spark):
    rows = [("fisċ", "en", "old", "new"), ("chep", "en", "new", "old"), ("same", "en", "old", "old"), ("x", "en", "old", "odd"), ("x", "cy", "old", "new"), ("qqq", "en", "old", "new"), (None, "en", "old", "new")]
    df = spark.createDataFrame(rows, "form string, family string, a string, b string")
    got = {(r.form, r.a, r.b, r.family): r.reached for r in era.walk_eras(df, "form", "family", "a", "b", {"en": ["old", "mid", "new"]}, spark.createDataFrame(RULES, KIND)).collect()}
    assert got[("fisċ", "old", "new", "en")] == "fich" and len(got) == len(rows)
    assert got[("chep", "new", "old", "en")] == "chǣp"  # the heaviest of each cell, of equal ones the first in order
    assert [v for k, v in got.items() if k[0] not in ("fisċ", "chep")] == [None] * 5


def test_names_are_rewound_by_parts(spark):
    names = spark.createDataFrame([("Elmton on Mere",), ("Zyxton",), (None,), ("Qq",)], "name string")
    entries = spark.createDataFrame([("elm",), ("ton",), ("on",), ("mere",)], "w string")
    anchors = spark.createDataFrame([("Elm-", "oe", 0, "elm", 1), ("-ton", "on", 0, "tún", 5), ("-ton", "oe", 1, "tūn", 2), ("-ton", "oe", 2, "aaa", 2), ("mere", "xx", 0, "m", 3)], "surface string, language string, place int, form string, entity int")
    forms = spark.createDataFrame([(2, "me", 1200, "toun"), (2, "me", 1300, "tone"), (2, "me", 1300, "TON"), (1, "me", 1400, "helm")], "entity int, language string, year int, form string")
    stops = [("oe", "oe", 900), ("me1", "me", 1250), ("me2", "me", 1350), ("now", "mo", None)]
    got = {(r.name, r.stop): r for r in era.rewind_names(names, "name", entries, "w", anchors, forms, ["oe", "on"], stops, "mo", particles=("on",)).collect()}
    assert len(got) == 12
    row = lambda *k: (got[k].rendered, got[k].fallback, got[k].fallbacks, got[k].unaccounted)
    assert row("Elmton on Mere", "oe") == ("Elmtūn on Mere", True, ["on", "mere"], [])
    assert row("Elmton on Mere", "me1")[0] == "Elmtoun on Mere" and row("Elmton on Mere", "me2")[0] == "Elmton on Mere"
    assert got[("Elmton on Mere", "me1")].fallbacks == ["elm", "on", "mere"]
    assert row("Elmton on Mere", "now")[0] == "Elmton On Mere"
    assert row("Zyxton", "oe") == ("Tūn", False, [], ["zyx"]) and row("Qq", "now") == ("", True, [], ["qq"])


def test_readings_of_a_name(spark):
    entries = spark.createDataFrame([("ab",), ("c",), ("a",), ("bc",), ("x",)], "w string")
    got = {(r.name, r.reading, r.unaccounted, r.morphemes) for r in era.name_readings(spark.createDataFrame([("abc x abc",), ("x",), (None,), ("zz",)], "n string"), "n", entries, "w").collect()}
    two = ("a bc", "ab c")
    assert got == {("abc x abc", f"{a} / x / {b}", 0, 5) for a in two for b in two} | {("x", "x", 0, 1), ("zz", "(zz)", 2, 0)}


def drawn(seed, *key):
    import hashlib

    return int(hashlib.md5("|".join([str(seed), *map(str, key)]).encode()).hexdigest()[:13], 16) / (1 << 52)


def pick(weights, u):
    at, total = 0.0, sum(w for _, w in weights)
    for k, w in weights:
        at += w
        if at > u * total:
            return k
    return None


POOL = [("g", "pre", f"p{k}", "ab"[k % 2], k % 4 + 1) for k in range(9)] + [("g", "post", f"q{k}", "bc"[k % 2], 3 - k % 3) for k in range(7)] + [("h", "pre", "only", "a", 2)]


def pools(spark):
    return spark.createDataFrame(POOL, "gate string, slot string, word string, tag string, weight int")


def of(gate, slot):
    return sorted((w, t, n) for g, s, w, t, n in POOL if g == gate and s == slot)


def test_slots_lean_to_the_tag_before(spark):
    asks = [(i, "gh"[i % 5 == 0], [["pre", "post"], ["post", "pre", "post"], ["none", "pre"], []][i % 4]) for i in range(300)]
    got = {r.id: r.parts for r in generation.fill_slots(spark.createDataFrame(asks, "id int, gate string, slots array<string>"), "id", "gate", "slots", pools(spark), "slot", "word", "tag", "weight", 4, 3.0).collect()}
    want = {}
    for i, gate, slots in asks:
        before, parts = "", []
        for k, s in enumerate(slots):
            word = pick([(w, n * (4.0 if t == before else 1.0)) for w, t, n in of(gate, s)], drawn(4, i, k))
            if word:
                before = next(t for w, t, _ in of(gate, s) if w == word)
                parts.append(word)
        if parts:
            want[i] = parts
    assert got == want


def test_pools_stay_in_proportion(spark):
    """A thousand words of a thousand tags: what is laid out is a few rows a word, not words times tags."""
    words = [("g", "s", f"w{k:04}", f"t{k}", 1) for k in range(1000)]
    laid = generation.Pools(spark.createDataFrame(words, "gate string, slot string, word string, tag string, weight int"), "gate", "slot", "word", "tag", "weight", 1.0)
    assert laid.plain.count() == 1000 and laid.tagged.count() == 1000 and laid.leaning.count() <= 3000


def test_reserved_slots(spark):
    rng = random.Random(2)
    asks = [(i, rng.choice("ggh"), rng.choice([["pre", "post"], ["post"], ["pre"], ["none"], ["pre", "post", "pre"]]), rng.choice([None, "a", "b", "c", "z"]), rng.choice([[], [("c", 1.0)], [("b", 2.0), ("a", 0.5)], [("z", 1.0)], [("b", 0.0)]])) for i in range(400)]
    df = spark.createDataFrame(asks, "id int, gate string, slots array<string>, tag string, moods array<struct<tag:string,weight:double>>")
    got = {r.id: r for r in generation.reserve_slots(df, "id", "gate", "slots", "tag", "moods", pools(spark), "slot", "tag", 8).collect()}
    for i, gate, slots, tag, moods in asks:
        able = lambda tags: [k for k, s in enumerate(slots) if any(t in tags for _, t, _ in of(gate, s))]
        mood, hard = able([t for t, w in moods if w > 0]), able([tag])
        r = got[i]
        assert (r.mood_slot in mood) if mood else r.mood_slot is None
        assert r.failed == (tag is not None and not hard)
        if tag is not None and hard:
            assert r.tag_slot in hard and (r.tag_slot != r.mood_slot or hard == [r.mood_slot])
        else:
            assert r.tag_slot is None
    reserved = generation.stored(generation.reserve_slots(df, "id", "gate", "slots", "tag", "moods", pools(spark), "slot", "tag", 8))
    names = generation.fill_reserved(reserved, "id", "gate", "slots", "tag", "moods", pools(spark), "slot", "word", "tag", "weight", 8)
    tags = {w: t for _, _, w, t, _ in POOL}
    for r in names.collect():
        ask = got[r.id]
        assert not ask.failed
        filled = [k for k, s in enumerate(ask.slots) if of(ask.gate, s)]
        assert len(r.parts) == len(filled)
        if ask.tag_slot is not None:
            assert tags[r.parts[filled.index(ask.tag_slot)]] == ask.tag
        if ask.mood_slot is not None and ask.mood_slot != ask.tag_slot:
            assert tags[r.parts[filled.index(ask.mood_slot)]] in [m.tag for m in ask.moods if m.weight > 0]


def test_repeats(spark):
    senses = spark.createDataFrame([("hill", 1, "en", "hill", "height", "land"), ("hill", 2, "cy", "bryn", "height", "land"), ("hill", 3, "en", "hillock", "height", "land"), ("hill", 4, "fr", "autre", "else", "land"), ("park", 1, "en", "park", "p", "land"), ("dale", 1, "en", "dale", "d", "land"), ("foss", 1, "on", "foss", "f", "land")], "usage string, rank int, language string, form string, gloss string, tag string")
    names = [(1, 1, "hill", "bare"), (1, 2, "hill", "bare"), (1, 3, "hill", "bare"), (2, 1, "park", "bare"), (2, 2, "park", "bare"), (3, 1, "foss", "post"), (3, 2, "foss", "post"), (4, 1, "dale", "bare"), (4, 2, "park", "bare"), (5, 1, "odd", "bare"), (5, 2, "odd", "bare")]
    got = {(r.id, r.slot): r.final for r in generation.diversified(spark.createDataFrame(names, "id int, slot int, usage string, position string"), "id", "slot", "usage", "position", senses).collect()}
    assert (got[1, 1], got[1, 2], got[1, 3]) == ("hill", "bryn", "bryn")
    assert got[2, 2] in ("hill", "dale") and got[3, 2] == "foss" and (got[4, 1], got[4, 2]) == ("dale", "park") and got[5, 2] == "odd"


def test_rendered_documents(spark):
    parts = spark.createDataFrame([(1, 1, 7, "ton"), (1, 2, 8, "mere")], "id int, slot int, entity int, usage string")
    variants = spark.createDataFrame([(7, "tun", 0), (8, "mer", 3)], "entity int, form string, weight int")
    inflections = spark.createDataFrame([(7, "tune", "dat")], "entity int, form string, label string")
    grid = spark.createDataFrame([(7, "norse", 1, "old norse", "tún", "c"), (7, "english", 2, "middle english", "toun", "c"), (7, "english", 1, "old english", "tūn", "d"), (7, "welsh", 1, "welsh", "din", "c")], "entity int, family string, stage int, language string, form string, source string")
    show = lambda variety, density: json.loads(generation.rendered_names(parts, "id", "slot", "entity", "usage", variants, inflections, grid, ["english"], 1, variety, density).first().rendered)
    whole = show(1.0, 1.0)
    assert whole["name"] == "tunemer" and whole["parts"][0]["label"] == "dat" and "grid" not in whole["parts"][1]
    assert [(f["family"], [s["language"] for s in f["stages"]]) for f in whole["parts"][0]["grid"]] == [("english", ["old english", "middle english"]), ("norse", ["old norse"]), ("welsh", ["welsh"])]
    assert show(0.0, 0.0)["name"] == "tonmere" and show(1.0, 0.0)["name"] == "tonmer" and "label" not in show(1.0, 0.0)["parts"][0]


def test_regions_are_whole_words(spark):
    e = spark.createDataFrame([("hot", "Brand#1", 1), ("hot", "Brand#12", 12), ("hot", "--", 9), ("one", None, 5)], "form string, region string, id int")
    m = spark.createDataFrame([("hot", "near brand#12"), ("hot", "BRAND 1, the"), ("hot", "brand"), ("hot", None), ("one", None)], "form string, hint string")
    got = {(r.form, r.hint): r.resolved for r in joins.resolve_mentions(m, e, "form", "hint", "region", "id").collect()}
    assert got == {("hot", "near brand#12"): 12, ("hot", "BRAND 1, the"): 1, ("hot", "brand"): None, ("hot", None): None, ("one", None): 5}


def test_letters_of_all_latin_alphabets(spark):
    df = spark.createDataFrame([("ǽþelṡtān ḥ Ǿ ǣ ﬁ",), ("Ŋ ƿ ȝ ſ ĳ Ǆ Ł ħ",), ("é Straße",), ("漢字 Ω 12",), (None,)], "s string")
    assert [r[0] for r in df.select(scalars.fold_surface(F.col("s"))).collect()] == ["aethelstanhoaefi", "ngwysijdzlh", "estrasse", "", None]


def test_anchored_search(spark):
    docs = [(1, "A " + "x " * 80 + "the bridgs near water; Bridgs"), (2, "bridgs " + "far " * 60 + "water"), (3, "bridges and water"), (4, "nothing"), (5, None), (6, "brodge: Water. bridgs")]
    entities = spark.createDataFrame([(1, "Bridge", ["water", None, ""]), (2, "bridge", []), (3, "bridge", ["moon"])], "entity int, form string, glosses array<string>")
    got = text.anchored_search(spark.createDataFrame(docs, "id int, t string"), "id", "t", entities, spark.createDataFrame([("bridges",)], "f string"), "f", 5, 40, 8).collect()
    assert sorted((r.entity, r.doc, r.matched, r["count"], r.snippet) for r in got) == [(1, 1, "bridgs", 2, "x x the bridgs near wa"), (1, 6, "bridgs", 1, "water. bridgs")]
