"""Links and components against brute force, and the defined edge cases."""

import random

import numpy as np
import pandas as pd

from stemweave.llm import ngram_jaccard as J
from stemweave.llm.components import connected_components
from stemweave.llm.ngram_jaccard import jaccard_components, keep_one_per_component


def brute(rows, width=5, percent=80):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        s = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
        sets[i] = s
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted((i, len(sets[i]), find(i)) for i in ids)


def corpus(seed, families=14, size=9):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(4))
    common = [word() for _ in range(60)]
    rows = []
    for _ in range(families):
        base = [word() for _ in range(rng.randint(3, 120))]
        if rng.random() < 0.5:
            base = common + base[:20]
        for _ in range(rng.randint(1, size)):
            t = list(base)
            for _ in range(rng.randint(0, 4)):
                t[rng.randrange(len(t))] = word()
            if rng.random() < 0.3:
                t = t[: rng.randint(len(t) * 7 // 10, len(t))]
            rows.append((len(rows) * 3 + 1, " ".join(t) if rng.random() < 0.8 else "\n".join(t).upper()))
    return rows


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(tuple(r) for r in jaccard_components(df).collect())


def test_matches_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        assert run(spark, rows) == brute(rows)


def test_one_large_family_and_a_common_passage(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base, passage = [word() for _ in range(60)], [word() for _ in range(40)]
    rows = []
    for i in range(300):
        t = list(base)
        t[rng.randrange(60)] = word()
        rows.append((i, " ".join(t)))
    for i in range(300, 420):
        rows.append((i, " ".join([word() for _ in range(30)] + passage)))
    assert run(spark, rows) == brute(rows)


def test_edges(spark):
    df = spark.createDataFrame(
        [(1, None, "x"), (2, "", "x"), (3, " \n\t", "y"), (4, "one two", "y"), (5, "ONE\ttwo", None), (6, "one  two three", "z"), (7, "a b c d e", "z"), (7, "a b c d e", "z"), (8, "one two", "q"), (None, "one two", "q"), (9, "É b c d e", "k"), (10, "é b c d e", "k")],
        "doc_id long, text string, component_id string",
    )
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(df).collect()}
    assert got == {(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6), (7, 1, 7), (8, 1, 4), (None, 1, None), (9, 1, 9), (10, 1, 10)}


def test_repeated_id_joins_its_texts(spark):
    a, b = " ".join("abcdefghij"), " ".join("klmnopqrst")
    df = spark.createDataFrame([(1, a), (2, a), (2, b), (3, b), (4, "z y x w v")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in jaccard_components(df).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4)}


def test_empty_table_and_filter(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert jaccard_components(empty).count() == 0
    df = spark.createDataFrame([(1, "a b c d e f", "x"), (2, "a b c d e f", "y"), (3, "q", "z"), (4, None, "z")], "doc_id long, text string, lang string")
    kept = keep_one_per_component(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {1, 3, 4}


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (101, 100)], "a long, b long")
    got = {r.node: r.component for r in connected_components(e).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def brute_links(rows, width=5, percent=80):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.setdefault(i, []).append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    link = lambda x, y: x and y and 100 * len(x & y) >= percent * len(x | y)
    return {(a, b) for a in sets for b in sets if a != b and any(link(x, y) for x in sets[a] for y in sets[b])}


def test_number_of_links_by_brute_force(spark, monkeypatch):
    from stemweave.llm import ngram_jaccard as J

    for seed, tokens in ((1, 400_000), (2, 400)):  # the second splits the stars into many blocks
        monkeypatch.setattr(J, "BLOCK_TOKENS", tokens)
        rows = corpus(seed, 10)
        rows += [(1000 + i, t) for i, t in rows[:20]]  # exact copies
        rows += [(2000 + i % 5, t) for i, t in enumerate(t for _, t in rows[::4])]  # ids with several texts
        want = {i: 0 for i, _ in rows}
        for a, _ in brute_links(rows):
            want[a] += 1
        df = spark.createDataFrame([*rows, (None, "a b")], "doc_id long, text string")
        got = J.jaccard_join(df).collect()
        assert {r.doc_id: r.n_links for r in got if r.doc_id is not None} == want and sum(want.values()) > 100
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None) == sorted(tuple(r) for r in J.jaccard_components(df).where("doc_id is not null").collect())


def test_links_between_all_members_of_a_group(spark):
    from stemweave.llm.ngram_jaccard import jaccard_links

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(60)]
    rows = []
    for i in range(80):
        t = list(base)
        t[rng.randrange(60)] = word()
        rows.append((i, " ".join(t)))
    links, member = jaccard_links(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {tuple(r) for r in links.collect()}
    assert got == {(a, b) for a, b in brute_links(rows) if a < b} and len(got) > 300
    assert {r.doc_id for r in member.collect()} == set(range(80))


def test_overlaps_are_derived_from_the_first_set():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50))) for _ in range(30)]
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1].ravel()
    off = np.r_[0, np.cumsum([len(s) for s in sets])]
    for to, y in ((30, 0), (12, 12), (1, 1)):
        for x, got in enumerate(J._overlaps(flat, off, to, y)):
            assert got.tolist() == [len(np.intersect1d(sets[x], s)) for s in sets[y:]]


def test_skipped_blocks_hold_no_pair_with_room():
    rng = np.random.default_rng(2)
    lo = np.sort(rng.integers(5, 400, 700))
    hi, rest = lo + rng.integers(0, 9, 700), rng.integers(1, 300, 700)
    met = {tuple(p) for p in J._blocks_met(lo, hi, rest, 80).tolist()}
    skipped = 0
    for p in range(11):
        for q in range(p, 11):
            if (p, q) in met:
                continue
            skipped += 1
            i, j = slice(64 * p, 64 * p + 64), slice(64 * q, 64 * q + 64)
            need = -(-80 * (lo[i, None] + lo[None, j]) // 180)
            assert not ((np.minimum(rest[i, None], rest[None, j]) >= need) & (lo[None, j] * 80 <= hi[i, None] * 100) & (lo[i, None] * 80 <= hi[None, j] * 100)).any()
    assert skipped > 10


def test_two_families_just_apart(spark, monkeypatch):
    """Members of two stars whose centres are too far apart: one pair of members links, and no pair of members is a row."""
    monkeypatch.setattr(J, "BLOCK_TOKENS", 300)
    monkeypatch.setattr(J, "PAIRS_PER_SET", 3)
    base = [f"w{k}" for k in range(100)]
    rows = []
    for k in range(25):  # shifted copies: neighbours are alike, the ends are not
        rows.append((k, " ".join([*base[k:], *[f"n{j}" for j in range(k)]])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_components(df).collect()}
    sets = {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for d, t in rows for w in [t.split()]}
    root = {d: d for d in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = {d: low if r == high else r for d, r in root.items()}
    assert {d: c for d, (_, c) in got.items()} == root and all(got[d][0] == len(s) for d, s in sets.items())


def test_a_long_list_is_dealt_in_proportion(spark):
    """50,000 entries of one list: sizes and positions skip most pairs of blocks before any entry is sent, and no pair with room is lost."""
    rng = np.random.default_rng(4)
    m = 50_000
    lo = np.exp(rng.uniform(np.log(5), np.log(5000), m)).astype(np.int64)
    rest = np.maximum(1, (lo * rng.uniform(0.6, 1.0, m)).astype(np.int64))
    table = pd.DataFrame({"token": 7, "star": np.arange(m), "comp": np.arange(m), "lo": lo, "hi": lo, "rest": rest, "long": True})
    short = pd.DataFrame({"token": 8, "star": [1, 2, 3], "comp": [1, 2, 3], "lo": 9, "hi": 9, "rest": 9, "long": False})
    dealt = J._dealt(spark.createDataFrame(pd.concat([table, short])), 80).toPandas()
    assert len(dealt) < 12 * m < m * (m // J.BLOCK)
    assert len(dealt[dealt.token == 8]) == 3
    met = {}
    for star, b1, b2, side in dealt[dealt.token == 7][["star", "b1", "b2", "side"]].itertuples(index=False):
        met.setdefault(star, set()).add((b1, b2))
    for _ in range(20_000):
        x = int(rng.integers(m))
        y = int(rng.choice(np.flatnonzero((lo >= lo[x] * 0.8) & (lo <= lo[x] * 1.25))[:200]))
        if x != y and min(rest[x], rest[y]) >= -(-80 * (lo[x] + lo[y]) // 180):
            assert met[x] & met[y]


def test_components_with_lists_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 2)
    rng = random.Random(8)
    words = [f"w{k}" for k in range(300)]
    bases = [[rng.choice(words) for _ in range(rng.randint(20, 60))] for _ in range(6)]
    rows = []
    for d in range(90):
        w = list(rng.choice(bases))
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((d, " ".join(w)))
    got = {r.doc_id: r.component_id for r in J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for d, t in rows for w in [t.split()]}
    root = {d: d for d in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = {d: low if r == high else r for d, r in root.items()}
    assert got == root
