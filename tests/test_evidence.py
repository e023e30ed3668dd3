"""Gazetteers, audits and evidence at their edges."""

import pytest
from pyspark.sql import functions as F

from stemweave.operators import audits, evidence, proportions, workflows
from stemweave.sources import gazetteers


def test_derivation_cells(spark):
    cells = ["stōw Old English - A place; a place of assembly; holy. ; tūn Old English", "odd; x Pictish - y; by Old Norse - farm", "hām Old English; more", "", None, "Old English - only a gloss"]
    d = gazetteers.derivation(F.col("c"), {"Old English": "oe", "Old Norse": "on"})
    got = [([tuple(e) for e in r.d.elements], r.d.unmapped, r.d.dropped) for r in spark.createDataFrame([(c,) for c in cells], "c string").coalesce(1).select(d.alias("d")).collect()]
    assert got == [
        ([("stōw", "oe", "A place; a place of assembly; holy."), ("tūn", "oe", None)], 0, 0), ([("by", "on", "farm")], 1, 1), ([("hām", "oe", None)], 0, 1), ([], 0, 0), ([], 0, 0), ([("", "oe", "only a gloss")], 0, 0),
    ]


def test_names_one_letter_off(spark):
    index = spark.createDataFrame([("Dudda", "oe"), ("dúdda", "on"), ("Cyni", "oe"), ("Al", "oe")], "form string, language string")
    got = {r.name: (r.form, r.tier) for r in gazetteers.match_names(spark.createDataFrame([("DUDDA",), ("Duda",), ("Cynni",), ("Ai",), ("Zzzz",), ("漢",), (None,)], "n string"), "n", index).collect()}
    assert got == {"DUDDA": ("Dudda", "t1"), "Duda": ("Dudda", "t2"), "Cynni": ("Cyni", "t2"), "Ai": (None, "miss"), "Zzzz": (None, "miss"), "漢": (None, "miss")}


def test_checked_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("vill,kind,yr\nAby,Town,1290\nBee,Town,\nCee,Town,x\nDee,Town,900\n,Town,1290\nEff,Hill,1290\nGee,Town,1290,more\nHit,Town\n")
    rows, warnings = gazetteers.checked_csv(spark, str(tmp_path), ["vill", "kind", "yr"], "vill", "yr", 1279, (1270, 1300), "kind", ("Town",))
    assert sorted((r.vill, r.date_year) for r in rows.collect()) == [("Aby", 1290), ("Bee", 1279), ("Cee", 1279), ("Dee", 1279)]
    assert {r.what: r.n for r in warnings.collect()} == {"columns": 2, "blank name": 1, "kind": 1, "no year": 1, "year out of window": 1}
    with pytest.raises(ValueError, match="county"):
        gazetteers.checked_csv(spark, str(tmp_path), ["vill", "county"], "vill", None, 1279, (1270, 1300))


def test_implied_spellings():
    known = lambda *f: list(f)
    assert evidence.guarded_spans("hotgear", [(known("hot"), []), (known("zz"), [])]) == (1, "gear", 3, 7)
    assert evidence.guarded_spans("hotgear", [(known("hot"), []), (known("zz"), known("gear"))]) is None  # an equivalent has it
    assert evidence.guarded_spans("hotgear", [(known("hot"), []), (known("ear"), [])]) is None  # the other part took too little
    assert evidence.guarded_spans("hotgear", [(known("hot"), []), ([], []), (known("q"), [])]) is None
    assert evidence.guarded_spans("hotgear", [(known("hot"), [])]) is None and evidence.guarded_spans("", [(known("a"), []), ([], [])]) is None


def test_gaps_and_collapses(spark):
    pairs = spark.createDataFrame([("Aby", 1), ("Aby", 2), ("Bee", 1), (None, 1), ("Aby", 3)], "name string, e int")
    surfaces = spark.createDataFrame([(1, "ab-"), (1, ""), (2, "zz")], "entity int, surface string")
    assert {r.kind: r.n for r in audits.gap_census(pairs, "name", "e", surfaces).collect()} == {"matched": 1, "variant_gap": 3, "reflex_less": 1}
    got = audits.variant_gaps(pairs, "name", "e", surfaces, spark.createDataFrame([(1,), (2,)], "entity int")).collect()
    assert sorted((r.entity, r.flips, r.names, [(x.name, x.spans) for x in r.evidence]) for r in got) == [(1, True, 1, [("Bee", [])]), (2, False, 1, [("Aby", ["ab"])])]
    nodes = spark.createDataFrame([(1, "en", "ton", None), (2, "en", "tun", None), (3, "en", "tonn", 1), (4, "cy", "ton", None), (5, "en", "two", None)], "id int, language string, form string, merged int")
    glosses = spark.createDataFrame([(2, "Variant of ton."), (4, "spelling of tun"), (5, "form of ton or tun"), (1, "farm")], "id int, gloss string")
    assert [tuple(r) for r in audits.pointer_collapses(nodes, glosses).collect()] == [("en:tun", "en:ton")]


def test_entries_come_in_once(spark):
    kind = "name string, region string, source string, page string, elements array<struct<ordinal:int,ref:string,inflection:string>>"
    entries = spark.createDataFrame([("Aby", "Kent", "s", None, [(2, "b", None), (1, "a", None)]), ("Aby", "Kent", "s", "", [(1, "a", None), (2, "b", None)]), (" ", "Kent", "s", None, [(1, "a", None)]), ("Bee", None, "s", None, [])], kind)
    places = spark.createDataFrame([], "id string, name string, region string, country string")
    none = spark.createDataFrame([], "id string")
    out = workflows.persist_entries(entries, places, none, {"Kent": "England"}, "Wales", "r")
    assert [(r.name, r.country) for r in out["places"].collect()] == [("Aby", "England")]
    assert sorted((r.ordinal, r.ref) for r in out["elements"].collect()) == [(1, "a"), (2, "b")]
    assert tuple(out["run"].first()) == ("r", 4, 1, 1)
    again = workflows.persist_entries(entries, out["places"], out["breakdowns"], {}, "Wales", "r2")
    assert tuple(again["run"].first()) == ("r2", 4, 0, 0)


def test_tallies_of_one_name(spark):
    kind = "c string, n int, word int, part int, surface string, tags array<string>, language string, flag string"
    rows = [("x", 1, 0, 0, "Bridg-", ["water"], "oe", None), ("x", 1, 0, 1, "-water", ["water", "wet"], "oe", None), ("x", 1, 1, 0, "Gate", None, "on", None), ("x", 2, 0, 0, "-by", ["farm"], None, None), ("x", 3, 0, 0, "-by", ["farm"], None, "saint")]
    out = {k: sorted(tuple(r)[1:] for r in v.collect()) for k, v in proportions.name_tallies(spark.createDataFrame(rows, kind), "c", "n").items()}
    assert out["usages"] == [("bridg", "pre", 1), ("water", "post", 1)] and out["single_usages"] == [("by", 2), ("gate", 1)]
    assert out["structures"] == [("post:saint", 1), ("pre-post bare", 1)]
    assert out["tag_marginal"] == [("water", 3), ("wet", 2)] and out["tag_pairs"] == [("water", "water", 1), ("water", "wet", 1)]
    assert out["languages"] == [("bridg", ["oe"]), ("gate", ["on"]), ("water", ["oe"])] and out["word_positions"] == [("post", "gate", 1)]
