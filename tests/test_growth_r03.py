"""Steps whose tasks must not hold more in larger tables, with the results they give."""

import itertools
from collections import Counter

import pytest
from pyspark.sql import functions as F

from stemweave.operators import aggregates, evidence, graph, identity, joins, log, text
from stemweave.plans import catalogue
from stemweave.sources import files


def test_shared_groups_are_counted_by_bounded_tasks(spark, monkeypatch):
    groups = {0: range(90), 1: [1, 2, 3], 2: [2, 3], 3: [5]} | {g: [7, 8, g] for g in range(100, 160)}
    rows = [(s, g) for g, found in groups.items() for s in found] + [(2, 2), (None, 1), (4, None)]
    monkeypatch.setattr(joins, "PAIRS", 100, raising=False)
    monkeypatch.setattr(joins, "LIST", 16, raising=False)
    out = joins.shared_group_pairs(spark.createDataFrame(rows, "s long, g long"), "s", "g")
    want = Counter(p for found in groups.values() for p in itertools.combinations(sorted(found), 2))
    assert {(r.a, r.b): r.shared for r in out.collect()} == want
    assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString() and out.rdd.getNumPartitions() >= sum(want.values()) // 100


def test_impact_is_counted_by_bounded_tasks(spark, monkeypatch):
    monkeypatch.setattr(aggregates, "TASK_ROWS", 100, raising=False)
    rows = spark.createDataFrame([(1, v % 40, 1) for v in range(1500)] + [(2, 1, 1), (2, 2, 50), (3, None, None), (3, 7, 2), (None, 1, 1)], "k long, v long, q int")
    out = aggregates.unflagged_impact(rows, "k", "v", F.col("q") == 50, "impact")
    assert sorted(tuple(r) for r in out.collect()) == [(1, 40), (3, 1)]
    assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString() and aggregates.tasks_for(rows) == 16


def test_productivity_deals_parts_over_bounded_tasks(spark, monkeypatch):
    monkeypatch.setattr(aggregates, "TASK_ROWS", 100, raising=False)
    rows = spark.createDataFrame([(w, i, w % 7 + i) for w in range(400) for i in range(3)], "w long, i int, e long")
    out = aggregates.productivity(rows, "w", "i", "e", spark.range(10).withColumnRenamed("id", "e"))
    got = {(r.e, r.position): r.productivity for r in out.collect()}
    assert len(got) == 30 and all(got[e, p] == sum(w % 7 + i == e for w in range(400)) for e in range(10) for i, p in enumerate(("pre", "inner", "post")))
    assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_chains_and_roots_do_not_pass_the_driver(spark, monkeypatch):
    plans, write = [], graph.stored
    monkeypatch.setattr(graph, "stored", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df))
    monkeypatch.setattr(identity, "stored", graph.stored)
    nodes = spark.range(60).selectExpr("id", "if(id % 7 = 3, id - 1, null) as merged", "cast(null as bigint) as lemma", "'x' as lang")
    edges = spark.range(1, 50).selectExpr("id as child", "id - 1 as parent").union(spark.createDataFrame([(50, 51), (51, 50), (52, 50)], "child long, parent long"))
    old = identity.oldest_roots(nodes, "id", "merged", "lemma", ["lang"], edges, "parent", "child")
    assert {r.id: r.root for r in old.collect()} == {i: 0 if i < 50 else {50: 51, 51: 50, 52: 50}.get(i, i) for i in range(60)} | {59: 58}
    bound = spark.createDataFrame([(1, "a"), (55, "b")], "id long, hub string")
    hubs = spark.createDataFrame([("a", "b"), ("b", None)], "id string, merged_into string")
    found = identity.hub_roots(old, "id", "root", nodes, ["lang"], bound, hubs)
    assert {r.id: r.root for r in found.collect()}[55] == 0
    assert not [p for p in plans if "Broadcast" in p]
    assert "Broadcast" not in old._jdf.queryExecution().executedPlan().toString() + found._jdf.queryExecution().executedPlan().toString()


def test_runs_are_searched_for_once_a_pair_of_names(spark):
    out = catalogue.QUERIES["t25_low_overlap"](spark, "/root/testdata/sf0.001")
    assert "Join" not in plan(out) and out.count()


def test_texts_are_lower_cased_once_and_not_copied_to_their_forms(spark):
    docs = spark.createDataFrame([(1, " The Kells of kells. \u00e9Kells"), (2, None)], "id long, t string")
    m = spark.createDataFrame([(1, "Kells", "a"), (1, "Kells", "b"), (1, "none", "a"), (1, "none", "b"), (1, None, "a"), (1, None, "b"), (2, "x", "a"), (2, "x", "b"), (3, "y", "a"), (3, "y", "b"), (1, "one", "a")], "source long, form string, entity string")
    out = evidence.ambiguous_hits(m, docs, "id", "t", 4)
    assert {(r.source, r.form): r.snippet for r in out.collect()} == {(1, "Kells"): "The Kells of", (1, "none"): None, (1, None): None, (2, "x"): None, (3, "y"): None}
    lowered = [x for x in plan(out).splitlines() if "lower(_t" in x]
    assert len(lowered) == 1 and "ArrowEvalPython" in lowered[0] + plan(out).split(lowered[0])[0]


def test_places_of_words_need_no_sorted_words(spark, monkeypatch):
    plans, write = [], text.stored
    monkeypatch.setattr(text, "stored", lambda df: plans.append(plan(df)) or write(df))
    docs = spark.createDataFrame([(1, "on the Kirkbi hill, kirkbi 7 by stan"), (2, ""), (3, None)], "id long, t string")
    entities = spark.createDataFrame([("e", "kirkby", ["hill"])], "entity string, form string, glosses array<string>")
    out = text.anchored_search(docs, "id", "t", entities, entities, "form", 5, 20, 5)
    assert [tuple(r) for r in out.collect()] == [("e", 1, "kirkbi", 2, "the kirkbi hill")]
    assert not any("Window" in p for p in plans)


def test_ancestors_of_a_forest_take_few_rounds(spark, monkeypatch):
    rounds, write = [], graph.stored
    monkeypatch.setattr(graph, "stored", lambda df: rounds.append(1) or write(df))
    n = 40
    chain = spark.range(1, n).selectExpr("id as c", "id - 1 as p").union(spark.createDataFrame([(0, None), (100, 3)], "c long, p long"))
    seeds = spark.range(n).union(spark.createDataFrame([(100,), (7,), (500,)], "id long"))
    got = [tuple(r) for r in graph.ancestors(seeds, chain, "id", "p", "c").collect()]
    want = [(a, b, a - b) for a in range(n) for b in range(a + 1)] + [(100, 100, 0)] + [(100, b, 4 - b) for b in range(4)] + [(500, 500, 0)]
    assert sorted(got) == sorted(want) and len(rounds) < 20
    ring = spark.createDataFrame([(1, 2), (2, 1), (3, 1), (4, 4)], "c long, p long")
    got = [tuple(r) for r in graph.ancestors(spark.range(1, 5), ring, "id", "p", "c").collect()]
    assert sorted(got) == [(1, 1, 0), (1, 2, 1), (2, 1, 1), (2, 2, 0), (3, 1, 1), (3, 2, 2), (3, 3, 0), (4, 4, 0)]


@pytest.mark.parametrize("few", [10_000, 3])
def test_components_are_found_in_few_rounds_whatever_the_shape(spark, monkeypatch, few):
    reads, write = [], graph.stored
    monkeypatch.setattr(graph, "FEW", few)
    monkeypatch.setattr(graph, "HUBS", 20)
    monkeypatch.setattr(graph, "stored", lambda df: reads.append(1) or write(df))
    path = [(i, i + 1) for i in range(400)]
    star = [(1000 if i % 2 else 1000 + i, 1000 + i if i % 2 else 1000) for i in range(1, 200)]
    twice = [(2001, 2000), (2000, 2001), (2001, 2000), (2002, 2002), (None, 2000)]
    got = {r.node: r.component for r in graph.min_label_components(spark.createDataFrame(path + star + twice, "a long, b long"), "a", "b").collect()}
    assert got == {i: 0 for i in range(401)} | {1000 + i: 1000 for i in range(200)} | {2000: 2000, 2001: 2000}
    assert len(reads) < 60
    none = graph.min_label_components(spark.createDataFrame([(7, 7)], "a long, b long"), "a", "b")
    assert none.columns == ["node", "component"] and none.count() == 0


def test_edges_leave_the_rounds_of_a_component_search(spark, monkeypatch):
    seen, write = [], graph.stored_with
    monkeypatch.setattr(graph, "stored_with", lambda df, *m: (lambda r: seen.append((df.columns, r[1])) or r)(write(df, *m)))
    edges = spark.range(3000).selectExpr("id div 3 as a", "10000 + cast(pmod(xxhash64(id), 100) as bigint) as b")
    got = {r.node: r.component for r in graph.min_label_components(edges, "a", "b").collect()}
    assert set(got.values()) == {0} and len(got) == 1100
    # nodes done with are not carried on: the second round's edges run between the 100 nodes of the smaller side
    sizes = [s["n"] for columns, s in seen if columns == ["x", "y"]]
    assert sizes[0] <= 3000 and sizes[1] <= 2000 and sizes[2] < 1000 and sizes[-1] == 0


def test_lines_are_parsed_once_and_not_shuffled(spark, tmp_path):
    rows = ['{"_type": "a", "ref": "x", "n": [1, "b"], "s": "[1]", "t": ["c"], "z": null, "f": 1.50}', "", '{"_type": "b", "_op": "patch"}']
    (tmp_path / "x.jsonl").write_text("\n".join(rows))
    out = files.read_events(spark, str(tmp_path))
    got = {r.line_no: r for r in out.collect()}
    assert sorted(got) == [1, 3] and got[1].lists == {"n": ["1", "b"], "t": ["c"]} and got[1].fields["s"] == "[1]" and set(got[1].fields) == {"s", "z", "f"} and got[3].op == "patch" and got[3].lists == {}
    assert plan(out).count("parseJson") + plan(out).count("parse_json") <= 1
    lines = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in lines and "SortMergeJoin" not in lines


def test_a_fold_looks_at_its_log_once(spark):
    rows = [("k", i, op, {"f": str(i)}, {"x_add" if op == "patch" else "x": ["a", str(i)]}) for i, op in enumerate(["add", "patch", "patch", "remove", "set", "patch"])]
    out = log.fold_entities(spark.createDataFrame(rows, "k string, i int, op string, f map<string,string>, l map<string,array<string>>"), ["k"], "i", "op", "f", "l")
    assert [(r.live, r.state, r.lists, r.errors) for r in out.collect()] == [(True, {"f": "5"}, {"x": ["a", "4", "5"]}, 0)]
    assert "Window" not in plan(out) and "LogicalRDD" not in plan(out)


def test_productivity_sums_nothing_up_before_parts_are_dealt(spark):
    rows = spark.createDataFrame([(1, 1, 5), (1, 2, 6), (1, 3, 5), (2, 4, 6), (None, 1, 5)], "w long, i int, e long")
    out = aggregates.productivity(rows, "w", "i", "e", spark.createDataFrame([(5,), (6,), (7,)], "e long"))
    got = {(r.e, r.position): r.productivity for r in out.collect() if r.productivity}
    assert got == {(5, "pre"): 1, (6, "inner"): 1, (5, "post"): 1, (6, "pre"): 1}
    assert plan(out).count("RepartitionByExpression") == 1 and "Aggregate [_w" not in plan(out).split("RepartitionByExpression")[1] and plan(out).count("Join") == 1
