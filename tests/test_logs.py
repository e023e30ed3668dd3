"""Logs with lists against a plain fold, in one go and as a stream; versioned upserts."""

import json
import random

import pytest
from pyspark.sql import functions as F

from stemweave.operators import log as L
from stemweave.sources import files, sinks
from stemweave.streaming import logs as streams

SCHEMA = "k string, i long, op string, f map<string,string>, l map<string,array<string>>"


def frame(spark, rows):
    """Rows as a table; lists travel as entries, since a dict loses its order on the way."""
    flat = [(k, i, op, f, None if lists is None else list(lists.items())) for k, i, op, f, lists in rows]
    df = spark.createDataFrame(flat, "k string, i long, op string, f map<string,string>, l array<struct<key:string,value:array<string>>>")
    return df.withColumn("l", F.map_from_entries("l"))


def by_hand(rows):
    """(live, scalars, lists, errors) of each key, event by event."""
    state = {}
    for k, _, op, f, lists in sorted(rows, key=lambda r: r[1]):
        live, scalars, arrays, errors = state.get(k, (False, {}, {}, 0))
        scalars, arrays = dict(scalars), {n: list(v) for n, v in arrays.items()}
        if (op == "add" and live) or (op == "patch" and not live):
            errors += 1
        elif op == "remove":
            live, scalars, arrays = False, {}, {}
        elif op == "patch":
            scalars |= f
            for n, v in lists.items():
                if n.endswith("_add"):
                    have = arrays.get(n[:-4], [])
                    for x in v:
                        have = have if x in have else [*have, x]
                    arrays[n[:-4]] = have
                elif n.endswith("_remove"):
                    arrays[n[:-7]] = [x for x in arrays.get(n[:-7], []) if x not in v]
                else:
                    arrays[n.removesuffix("_set")] = list(v)
        else:
            live, scalars, arrays = True, dict(f), {n: list(v) for n, v in lists.items()}
        state[k] = (live, scalars, arrays, errors)
    return state


def events(rng, n, keys=6):
    out = []
    for i in range(n):
        op = rng.choice(["patch"] * 6 + ["add", "set", None, "remove"])
        values = lambda: [rng.choice("abcdef") for _ in range(rng.randint(0, 4))]
        names = rng.sample(["x_add", "x_remove", "x_set", "y_add", "y_remove", "z"], rng.randint(0, 3)) if op == "patch" else rng.sample(["x", "y"], rng.randint(0, 2))
        out.append((f"k{rng.randrange(keys)}", i * 3, op, {rng.choice("pq"): str(i)} if rng.random() < 0.7 else {}, {n: values() for n in names}))
    return out


@pytest.mark.parametrize("seed,ranges", [(1, 1), (2, 7), (3, 3)])
def test_fold_of_lists(spark, seed, ranges):
    rows = events(random.Random(seed), 400)
    got = L.fold_entities(frame(spark, rows), ["k"], "i", "op", "f", "l", ranges).collect()
    assert {r.k: (r.live, r.state, r.lists, r.errors) for r in got} == by_hand(rows)


def test_edges(spark):
    rows = [("a", 1, None, {}, {"x": ["a", None, "a"]}), ("a", 2, "patch", {}, {"x_remove": ["b", None], "y_remove": ["q"]}), ("b", 1, "patch", {"p": "1"}, {}), ("c", 5, "add", None, None)]
    got = {r.k: r for r in L.fold_entities(frame(spark, rows), ["k"], "i", "op", "f", "l").collect()}
    assert got["a"].lists == {"x": ["a", "a"], "y": []} and got["b"].errors == 1 and not got["b"].live and got["c"].live and got["c"].state == {}
    assert L.fold_entities(frame(spark, []), ["k"], "i", "op", "f", "l").count() == 0


def test_stream_and_batch_agree(spark, tmp_path):
    rows = events(random.Random(9), 300)
    source = f"{tmp_path}/in"
    for start in (0, 100, 200):
        frame(spark, rows[start : start + 100]).coalesce(1).write.mode("append").parquet(source)
    stream = streams.fold_stream(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source), "k", "i", "op", "f", "l")
    seen = {}

    def keep(batch, _):
        seen.update({r.k: (r.live, r.state, r.lists, r.errors) for r in batch.collect()})

    query = stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start()
    query.awaitTermination(180)
    assert seen == by_hand(rows)
    whole = L.fold_entities(frame(spark, rows), ["k"], "i", "op", "f", "l").collect()
    assert {r.k: (r.live, r.state, r.lists, r.errors) for r in whole} == seen


def test_ledgers_are_read_and_merged(spark, tmp_path):
    lines = [
        ("b", 1, {"_type": "word", "ref": "r1", "gloss": "[odd", "tags": ["x", "y"], "n": 3}), ("b", 2, {"_type": "word", "ref": "r2", "gloss": None, "tags": []}),
        ("a", 1, {"_type": "word", "_op": "add", "ref": "r1", "tags": ["z", "x"]}), ("a", 2, {"_type": "word", "_op": "patch", "ref": "r1", "tags_add": ["w"], "gloss": "first"}),
        ("a", 3, {"_type": "cite", "of": "r1", "page": 4}), ("a", 4, {"_type": "cite", "of": "r1", "page": 4}), ("b", 3, {"_type": "cite", "of": "r9", "page": 4}), ("b", 4, {"_type": "cite", "of": None, "page": 5}),
    ]
    df = spark.createDataFrame([(f, i, json.dumps(x)) for f, i, x in lines], "file string, i int, line string").repartition(3)
    assert sinks.ledgers(df, f"{tmp_path}/l", "file", "line", ["i"]) == ["a", "b"]
    e = files.read_events(spark, f"{tmp_path}/l")
    first = e.where("file = 'b.jsonl' and line_no = 1").first()
    assert first.fields == {"gloss": "[odd", "n": "3"} and first.lists == {"tags": ["x", "y"]} and first.op is None
    merged = L.merge_files(L.fold_entities(e.where("type = 'word'"), ["file", "ref"], "line_no", "op", "fields", "lists"), ["ref"], "file")
    assert {r.ref: (r.files, r.state, r.lists) for r in merged.collect()} == {"r1": (2, {"gloss": "first", "n": "3"}, {"tags": ["z", "x", "w", "y"]}), "r2": (1, {}, {"tags": []})}
    facts = L.distinct_facts(e.where("type = 'cite'").select("file", "line_no", F.col("fields.of").alias("of"), F.col("fields.page").alias("page")), ["file"], ["of", "page"], "line_no")
    got = L.resolve_refs(facts, merged, "of", "ref").collect()
    assert sorted((r.file, r.line_no, r.of or "", r.copies, r.orphan) for r in got) == [("a.jsonl", 3, "r1", 2, False), ("b.jsonl", 3, "r9", 1, True), ("b.jsonl", 4, "", 1, False)]
    spark.createDataFrame([("c", 1, '{"ref": "no type"}')], "file string, i int, line string").select("line").coalesce(1).write.text(f"{tmp_path}/bad.jsonl")
    with pytest.raises(Exception, match="bad event"):
        files.read_events(spark, f"{tmp_path}/bad.jsonl", pattern="*").collect()


def test_upserts_take_one_row_a_key(spark):
    have = spark.createDataFrame([(1, "x", None), (4, None, "k")], "k int, v string, w string")
    new = spark.createDataFrame([(2, "a", None, 1), (2, "b", "p", 2), (1, "c", "q", 5), (1, "d", None, 6), (4, None, "m", 1), (3, "t", "t", None)], "k int, v string, w string, n int")
    rows = lambda df: sorted((r.k, r.v, r.w) for r in df.collect())
    assert rows(L.upsert_fill(have, new, "k", ["v", "w"], F.col("n"))) == [(1, "x", "q"), (2, "b", "p"), (3, "t", "t"), (4, None, "k")]
    assert rows(L.upsert_last(have, new, "k", F.col("n"))) == [(1, "d", None), (2, "b", "p"), (3, "t", "t"), (4, None, "m")]
    assert rows(L.insert_absent(have, new, "k", F.col("n"))) == [(1, "x", None), (2, "a", None), (3, "t", "t"), (4, None, "k")]
