"""Versions and pointers, the ledger, section trees, senses."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from stemweave.sources import ledger, publish, sections


def tables(spark, k):
    return {"a": spark.createDataFrame([(k, "x")], "n int, s string"), "b": spark.createDataFrame([(k,), (k,)], "n int")}


def test_a_reader_sees_one_version_at_any_step(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/gold"
    with pytest.raises(FileNotFoundError):
        publish.read_published(spark, root)
    publish.publish(tables(spark, 1), root, "2", "v1")
    seen = []

    def look(*_):
        got = publish.read_published(spark, root, "2")
        seen.append((got["a"].first().n, got["b"].first().n, got["b"].count()))

    real_point = publish._point
    held = publish.read_published(spark, root)

    def point(*args):
        look()  # all tables are written, the pointer isn't
        done = real_point(*args)
        look()
        return done

    monkeypatch.setattr(publish, "_point", point)
    real_exists = publish._pointers
    monkeypatch.setattr(publish, "_pointers", lambda *a: real_exists(*a))
    assert publish.publish(tables(spark, 2), root, "2", "v2") == "v2"
    assert seen == [(1, 1, 2), (2, 2, 2)]
    assert held["a"].first().n == 1  # who has read a pointer keeps its version
    monkeypatch.setattr(publish, "_point", real_point)

    class Broken(Exception):
        pass

    def fails(*_):
        raise Broken

    monkeypatch.setattr(publish, "_point", fails)
    with pytest.raises(Broken):
        publish.publish(tables(spark, 3), root, "2", "v3")
    monkeypatch.setattr(publish, "_point", real_point)
    look()
    assert seen[-1] == (2, 2, 2)
    with pytest.raises(ValueError, match="already"):
        publish.publish(tables(spark, 3), root, "2", "v1")
    with pytest.raises(ValueError, match="schema version"):
        publish.read_published(spark, root, "3")
    assert publish.roll_back(spark, root) == "v1" and publish.current(spark, root)["version"] == "v1"
    assert publish.current(spark, root)["tables"]["b"]["rows"] == 2
    assert publish.prune(spark, root, 1) == ["v2", "v3"]
    look()
    assert seen[-1] == (1, 1, 2)


def test_ledger_pages_are_stable(spark, tmp_path):
    path = f"file://{tmp_path}/ledger"
    at = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    make = lambda ids: spark.createDataFrame([(f"r{i:02}", at(i // 2), None if i % 5 == 0 else f"g{i % 2}", f" why {i} ") for i in ids], "id string, at timestamp, generator string, reason string")
    ledger.record(make(range(20)), path)
    with pytest.raises(Exception, match="no reason in report bad"):
        ledger.record(spark.createDataFrame([("bad", at(1), "g", "  ")], "id string, at timestamp, generator string, reason string"), path)
    change = lambda *rows: spark.createDataFrame(list(rows), "id string, at timestamp, status string, ticket string, note string")
    ledger.transition(change(("r03", at(30), "accepted", "t-1", "real"), ("r04", at(30), "accepted", None, None), ("r04", at(31), "dismissed", None, "no")), path)
    for row, said in ((("zz", at(1), "accepted", None, None), "no report zz"), (("r01", at(1), "new", None, None), "can't become new"), (("r01", at(1), "odd", None, None), "can't become odd")):
        with pytest.raises(Exception, match=said):
            ledger.transition(change(row), path)
    state = lambda: ledger.state(ledger.read(spark, path))
    got = {r.id: r for r in state().collect()}
    assert len(got) == 20 and got["r03"].status == "accepted" and got["r03"].ticket == "t-1" and got["r04"].status == "dismissed" and got["r05"].generator == "unknown" and got["r01"].reason == "why 1"
    seen, after = [], None
    while True:
        rows = ledger.page(state(), 4, after=after).collect()
        if not rows:
            break
        seen += [r.id for r in rows]
        after = (rows[-1].created, rows[-1].id)
        ledger.record(make(range(100 + len(seen), 102 + len(seen))), path)  # newer reports come meanwhile
    want = sorted((i for i in range(20) if i not in (3, 4)), key=lambda i: (-(i // 2), i))
    assert seen == [f"r{i:02}" for i in want]
    assert {r.id for r in ledger.page(state(), 99, status=None, generator="g1").collect()} >= {"r01", "r03"}
    assert [r.id for r in ledger.page(state(), 9, status="dismissed").collect()] == ["r04"]
    with pytest.raises(ValueError):
        ledger.page(state(), 9, status="odd")


def walked(node):
    out = [node["text"]] if isinstance(node, dict) and node.get("text") else []
    for s in (node.get("sections") or []) if isinstance(node, dict) else []:
        out += walked(s)
    return out


def test_trees_of_any_depth(spark):
    deep = {"text": "t12"}
    for k in range(11, 0, -1):
        deep = {"text": f"t{k}" if k % 3 else None, "sections": [{"text": f"l{k}"}, deep, {"sections": []}, {"text": ""}]}
    docs = [(1, deep), (2, {"text": "alone"}), (3, {"sections": None}), (4, {"text": "a", "sections": [{"text": f"s{i}"} for i in range(12)]}), (5, {"sections": [None, "odd", 3, {"text": "x"}]})]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in docs], "id int, j string").select("id", F.parse_json("j").alias("tree"))
    rows = sections.section_texts(df, "id", F.col("tree")).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.id, r.path)):
        got.setdefault(r.id, []).append(r.text)
    assert got == {i: w for i, d in docs if (w := walked(d))}
    assert max(len(r.path) for r in rows) >= 11


def test_senses(spark):
    text = "intro\n\nharpy(n.)\n\nfrom Greek.\n\nmore\n \ntroll(n.1)\n\nodd(n.)\n\nlast(v.)"
    got = spark.createDataFrame([(text,), ("",), (None,), ("two\nlines(n.)\n\nx",)], "t string").select(sections.split_senses(F.col("t")).alias("s")).collect()
    assert [[tuple(x) for x in r.s] if r.s is not None else None for r in got] == [[("harpy(n.)", "from Greek."), ("troll(n.1)", "odd(n.)")], [], None, []]


def test_named_records(spark):
    docs = [
        (1, {"name": "Djinni", "family": {"name": "Genie", "text": "kin", "sections": [{"text": "deep"}]}, "sections": [{"text": "own"}]}), (2, {"name": "genie", "family": {"name": "GENIE", "text": "other"}}),
        (3, {"name": "Red Dragon", "family": {"name": "Dragon, Red"}, "sections": [{"text": "hot"}]}), (4, {"name": "Two Words", "family": {"name": "No Root"}}), (5, {"name": "Harpy", "sections": [{"text": "a"}, {"text": "b"}]}), (6, {}),
    ]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in docs], "o int, j string").select("o", F.parse_json("j").alias("tree"))
    got = sorted(map(tuple, sections.named_records(df, "o", "tree").collect()))
    assert got == [("Djinni", "kin\n\ndeep\n\nown", "own"), ("Dragon", "", "family"), ("Genie", "kin\n\ndeep", "family"), ("Harpy", "a\n\nb", "own")]
