"""Chains, roots, guarded components and projected statements against plain Python."""

import random

import numpy as np
import pyarrow as pa
import pytest

from stemweave.operators import audits, curation, graph, identity, mates
from stemweave.operators.mates import bucket_mates


def follow(pointers, start):
    """(terminal, entry) of a walk."""
    seen, at = [], start
    while at not in seen:
        seen.append(at)
        to = pointers.get(at)
        if to is None or to == at:
            return at, None
        if to not in pointers:
            return to, None
        at = to
    return None, at


@pytest.mark.parametrize("seed", [1, 2])
def test_chains_and_cycles(spark, seed):
    rng = random.Random(seed)
    pointers = {i: i - 1 if i else None for i in range(100)}  # a chain of a hundred
    pointers |= {200: 201, 201: 202, 202: 200, 203: 202, 204: 203, 300: 300, 301: 999, 302: 301}  # a circle of three and what hangs on it
    pointers |= {400 + i: 400 + rng.randrange(40) for i in range(40)} if seed == 2 else {}
    df = spark.createDataFrame(list(pointers.items()), "id long, to_id long")
    got = {r.id: (r.terminal, r.entry) for r in graph.chain_ends(df, "id", "to_id").collect()}
    assert got == {i: follow(pointers, i) for i in pointers}
    flat = {r.id: (r.terminal, r.cyclic) for r in graph.flatten_chains(df, "id", "to_id").collect()}
    assert flat == {i: (i if t is None else t, e is not None) for i, (t, e) in got.items()}


def test_oldest_roots(spark):
    rows = [(i, None, None, "en", f"w{i:03}") for i in range(1, 120)] + [(200, 7, None, "en", "x"), (201, None, 9, "en", "y"), (202, 201, None, "en", "z"), (301, None, None, "a", "p"), (302, None, None, "a", "q"), (303, None, None, "a", "r")]
    edges = [(i - 1, i) for i in range(2, 110)] + [(50, 109), (302, 301), (303, 302), (301, 303), (301, 119)]
    n = spark.createDataFrame(rows, "id long, merged long, lemma long, language string, form string")
    got = {r.id: r.root for r in identity.oldest_roots(n, "id", "merged", "lemma", ["language", "form"], spark.createDataFrame(edges, "parent long, child long"), "parent", "child").collect()}
    assert got[108] == 1 and got[109] == 1 and got[200] == 1 and got[201] == 1 and got[202] == 1 and got[115] == 115
    # round a circle: the node whose parent is the first one met
    assert (got[301], got[302], got[303], got[119]) == (303, 301, 302, 303)


def test_guarded_components(spark):
    rng = random.Random(3)
    kind = {i: rng.choice("ab") for i in range(60)}
    merges = [(rng.randrange(64), rng.randrange(64)) for _ in range(60)]
    root = {i: i for i in kind}
    skipped = []
    for a, b in merges:
        if a not in kind or b not in kind:
            skipped.append((a, b, "unknown"))
        elif kind[a] != kind[b]:
            skipped.append((a, b, "crosses"))
        else:
            low, high = sorted((root[a], root[b]))
            root = {i: low if r == high else r for i, r in root.items()}
    for order in (merges, merges[::-1]):
        got, left = identity.guarded_components(spark.createDataFrame(list(kind.items()), "node long, kind string"), "node", "kind", spark.createDataFrame(order, "a long, b long"), "a", "b")
        assert {r.node: r.root for r in got.collect()} == root
        assert sorted(map(tuple, left.collect())) == sorted(skipped)


def test_projection(spark):
    rows = [
        ("1", "mint", "affirm", "m", "h1", None, 1.0), ("2", "mint", "affirm", "m", "h2", None, 1.0), ("3", "mint", "affirm", "p", "t1", None, 1.0), ("4", "mint", "refute", "m", "h9", None, 1.0),
        ("5", "merge", "affirm", "m", "h2", "h1", 1.0), ("6", "merge", "affirm", "m", "h1", "t1", 1.0), ("7", "merge", "affirm", "m", "h1", "h9", 1.0),
        ("10", "bind", "affirm", "word", "o1", "h1", 0.9), ("11", "bind", "affirm", "word", "o1", "h2", 0.95), ("12", "bind", "affirm", "word", "o2", "t1", 0.9), ("13", "bind", "affirm", "word", "o3", "h1", 0.1),
        ("14", "bind", "affirm", "word", "o4", "h1", 0.9), ("15", "bind", "refute", "word", "o4", "h1", 0.1), ("16", "bind", "affirm", "odd", "o5", "h1", 0.9), ("17", "mint", "affirm", "m", "h3", None, 1.0),
        ("18", "bind", "affirm", "word", "o6", "h1", 0.9), ("19", "bind", "affirm", "word", "o6", "h3", 0.9),
        ("20", "label", "affirm", "m", "h1", None, 0.5), ("21", "label", "affirm", "m", "h1", None, 0.7), ("22", "label", "affirm", "m", "h9", None, 0.7),
    ]
    df = spark.createDataFrame([(*r, None, f"v{r[0]}") for r in rows], "id string, predicate string, polarity string, kind string, ref string, object string, score double, stratum string, value string")
    out = {k: sorted(map(tuple, v.collect())) for k, v in identity.project_identity(df, {"word": "m"}, 0.5).items()}
    assert out["nodes"] == [("m", "h1", None), ("m", "h2", "h1"), ("m", "h3", None), ("p", "t1", None)]
    assert out["bound"] == [("word", "o1", "h2")] and out["conflicts"] == [("word", "o6", ["h1", "h3"])]
    assert out["labels"] == [("m", "h1", "", "v21", "21")]
    assert dict(out["skipped"]) == {"merge crosses": 1, "merge unknown": 1, "bind to no node": 1, "below gate": 1, "refuted": 1, "no target": 1, "label of no node": 1}


def test_folds_are_checked_and_followed(spark):
    nodes = spark.createDataFrame([(i, f"n{i}") for i in range(1, 9)], "id long, label string")
    children = spark.createDataFrame([(i, f"c{i}") for i in range(1, 9)], "node long, v string")
    acts = [(1, "fold", None, 2), (2, "fold", None, 3), (4, "fold", None, 99), (5, "fold", None, 6), (6, "fold", None, 5), (7, "fold", None, 5), (8, "fold", None, 8), (77, "fold", None, 1)]
    out = curation.apply_curation(nodes, "id", "label", children, "node", "v", spark.createDataFrame(acts, "ref long, kind string, value string, to long"))
    assert sorted(r.id for r in out["nodes"].collect()) == [3, 4, 5, 6, 8]
    assert sorted((r.node, r.v) for r in out["children"].collect()) == [(3, "c1"), (3, "c2"), (3, "c3"), (4, "c4"), (5, "c5"), (5, "c7"), (6, "c6"), (8, "c8")]
    assert [tuple(r) for r in out["counts"].collect()] == [("fold", 3, 5)]


def test_bucket_mates(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([1, 1, 1, 2]), [rng.gauss(0, 1) for _ in range(5)]) for i in range(70)] + [(100, 3, [1.0] * 5), (101, None, [1.0, 2.0, 0.0, 0.0, 1.0]), (102, None, [1.0] * 5), (103, 1, None), (104, 1, [0.0] * 5), (105, 2, [float("nan")] * 5)]
    got = {r.id: r for r in bucket_mates(spark.createDataFrame(rows, "id long, b int, v array<double>"), "id", "b", "v", 8).collect()}
    unit = {i: [x / sum(y * y for y in v) ** 0.5 for x in v] for i, _, v in rows if v and all(x == x for x in v) and any(v)}
    for i, b, _ in rows:
        cos = [sum(x * y for x, y in zip(unit[i], unit[j])) for j, c, _ in rows if j != i and c == b and j in unit] if i in unit else []
        assert got[i].mates == len(cos)
        want = (min(cos), sum(cos) / len(cos), max(cos)) if cos else (None, None, None)
        assert (got[i].least, got[i].mean, got[i].greatest) == (pytest.approx(want) if cos else want)


def test_bucket_mates_in_lists_of_any_order(spark, monkeypatch):
    """On several executors a list that is gathered twice comes in two orders; here each one is dealt anew."""
    from pyspark.sql import functions as F

    gathered, key = F.collect_list, "reflect('java.util.UUID', 'randomUUID')"
    monkeypatch.setattr(F, "collect_list", lambda c: F.transform(F.array_sort(F.transform(gathered(c), lambda x: F.struct(F.expr(key).alias("k"), x.alias("x")))), lambda p: p["x"]))
    rng = random.Random(6)
    unit = [[x / sum(y * y for y in v) ** 0.5 for x in v] for v in ([rng.gauss(0, 1) for _ in range(5)] for _ in range(40))]
    got = bucket_mates(spark.createDataFrame([(i, 1, v) for i, v in enumerate(unit)], "id long, b int, v array<double>"), "id", "b", "v", 16).collect()
    for r in got:
        cos = [sum(x * y for x, y in zip(unit[r.id], u)) for i, u in enumerate(unit) if i != r.id]
        assert (r.mates, r.least, r.greatest) == (39, pytest.approx(min(cos)), pytest.approx(max(cos)))


def _shuffled(spark):
    """Bytes that all stages so far have written for shuffles."""
    sc = spark.sparkContext
    bus = sc._jsc.sc().listenerBus()
    bus.waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_bucket_mates_send_a_vector_to_few_blocks(spark):
    rng, n, width = random.Random(7), 160, 1024  # eight vectors are more than compression looks back over
    rows = spark.createDataFrame([(i, 1, [rng.gauss(0, 1) for _ in range(width)]) for i in range(n)], "id long, b int, v array<double>")
    before, key = _shuffled(spark), "spark.sql.autoBroadcastJoinThreshold"
    held = spark.conf.get(key)
    spark.conf.set(key, -1)  # as on a table that is too large for it
    try:
        assert bucket_mates(rows, "id", "b", "v", 8).where("mates = 159 and least < 0 and greatest > 0").count() == n
    finally:
        spark.conf.set(key, held)
    sent = _shuffled(spark) - before
    assert sent < 8 * n * width * 8  # a vector has width * 8 bytes; of 20 blocks of 8 it was sent to each


def test_bucket_mates_of_many_blocks_and_tiles(spark, monkeypatch):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(40, 5))
    cos = (v @ v.T) / np.sqrt((v * v).sum(1))[:, None] / np.sqrt((v * v).sum(1))
    least, greatest = np.where(np.eye(40), np.inf, cos).min(1), np.where(np.eye(40), -np.inf, cos).max(1)
    monkeypatch.setattr(mates, "HELD", 6 * 5 * 8)
    rows = spark.createDataFrame([(i, "x", [float(c) for c in v[i]]) for i in range(40)], "id long, b string, v array<double>")
    got = bucket_mates(rows, "id", "b", "v").orderBy("id").collect()
    assert [r.least for r in got] == pytest.approx(list(least)) and [r.greatest for r in got] == pytest.approx(list(greatest))
    monkeypatch.setattr(mates, "TILE", 4)
    side = np.arange(40) % 3 // 2  # two blocks of unlike sizes
    table = lambda at: pa.table({"_r": at, "_p": side[at], "_v": pa.array([list(x) for x in v[at]]), "_l": np.sqrt((v[at] ** 2).sum(1))})
    for i, j in ((0, 0), (0, 1), (1, 1)):
        at = np.flatnonzero((side == i) | (side == j))
        out, other = mates._meet((pa.scalar(0), pa.scalar(i), pa.scalar(j)), table(at)), lambda r: [c for c in at if c != r and (i == j or side[c] != side[r])]  # noqa: B023
        assert out.column("lo").to_pylist() == pytest.approx([cos[r][other(r)].min() for r in at]) and out.column("hi").to_pylist() == pytest.approx([cos[r][other(r)].max() for r in at])


def test_statements_with_a_wrong_id_fail(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "x", None), (2, "y", "AS1")], "n int, c string, id string")
    with pytest.raises(Exception, match="line 2: stored id AS1"):
        audits.checked_statements(df, "id", F.concat(F.lit("AS"), "c"), F.concat(F.lit("line "), F.col("n").cast("string"))).collect()
