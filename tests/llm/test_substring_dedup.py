import random

import numpy as np
import pytest

from stemweave.llm import substring_dedup as S


def kept_by_hand(rows, least=13):
    """(id, words, kept words) of each row: every window against the smallest id it starts in."""
    top = S.NO_ID
    texts = [(top if i is None else i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in texts:
        for k in range(len(w) - least + 1):
            key = tuple(w[k : k + least])
            first[key] = min(first.get(key, top), i)
    out = []
    for i, w in texts:
        gone = {j for k in range(len(w) - least + 1) if first[tuple(w[k : k + least])] < i for j in range(k, k + least)}
        out.append((i, len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()))
    return sorted(out)


def corpus(rng, n=120):
    word = lambda: f"w{rng.randrange(400)}"
    passages = [[word() for _ in range(rng.randint(10, 60))] for _ in range(8)]
    rows = []
    for i in range(n):
        w = []
        for _ in range(rng.randint(0, 5)):
            w += [word() for _ in range(rng.randint(0, 30))]
            if rng.random() < 0.6:
                p = rng.choice(passages)
                a, b = sorted((rng.randrange(len(p) + 1), rng.randrange(len(p) + 1)))
                w += p[a:b] if rng.random() < 0.5 else p
        rows.append((rng.randrange(1000), rng.choice([" ", "\n", "  "]).join(w)))
    rows += [(rng.randrange(1000), rows[k][1]) for k in range(20)]  # copies
    near = rows[3][1].split()
    rows += [(2000 + k, " ".join(near[:k] + ["x"] + near[k:])) for k in range(0, 40, 3)]  # near copies
    rows += [(5, "spam " * 100), (6, "spam " * 50 + "end"), (7, "a b c " * 40), (3000, " ".join(f"{'a b c'} " for _ in range(30)))]
    rows += [(None, rows[0][1]), (None, None), (8, None), (8, ""), (9, "\x0b\t"), (9, rows[1][1]), (9, rows[2][1]), (9, rows[1][1]), (4000, "Ab " * 20), (4001, "ab " * 20)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_removed_words_by_brute_force(spark, seed):
    rows = corpus(random.Random(seed))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((S.NO_ID if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.text or "") for r in S.remove_repeats(df).collect())
    assert got == kept_by_hand(rows)
    if seed == 1:  # more seeds than a bitmap of this size may hold: the join instead of the screen
        assert sorted((S.NO_ID if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.text or "") for r in S.remove_repeats(df, most_bits=7).collect()) == got
        shorter = sorted((S.NO_ID if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.text or "") for r in S.remove_repeats(df, least=5, seed=2).collect())
        assert shorter == kept_by_hand(rows, 5)


def test_maximal_repeats(spark):
    long = [f"p{k}" for k in range(40)]
    rows = [(1, " ".join(["a", *long, "b"])), (2, " ".join(["c", "d", *long[:20], "e", *long[15:], "f"])), (3, " ".join(long[:12]))]
    got = sorted(tuple(r)[:1] + tuple(r)[2:] for r in S.maximal_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(2, 2, 22), (2, 23, 48)]


def test_every_window_lies_in_one_span():
    rng = np.random.default_rng(5)
    h = S.mix(rng.integers(0, 9, 500).astype(np.uint64))
    first = np.array([0, 3, 3, 200, 213, 225, 500])
    text, at, n, a = S.spans_of(h, first, 13, 4)
    covered = np.concatenate([np.arange(x, x + m) for x, m in zip(at, n)])
    want = [k for t in range(len(first) - 1) for k in range(first[t], first[t + 1] - 12)]
    assert covered.tolist() == want and n.max() <= 10
    # the seed of a window depends on its words alone
    grams = S._grams(h, 4, S._C)
    for t, x, m, s in zip(text, at, n, a):
        for k in range(x, x + m):
            assert grams[k : k + 10].min() == s and first[t] <= k and k + 13 <= first[t + 1]


def test_edges(spark):
    kind = "doc_id long, text string, n_words string, _id int"
    empty = S.remove_repeats(spark.createDataFrame([], kind))
    assert empty.columns == ["doc_id", "text", "n_words", "_id", "n_words_", "n_removed"] and empty.count() == 0
    same = " ".join(f"x{k}" for k in range(20))
    got = S.remove_repeats(spark.createDataFrame([(2, same, "mine", 1), (2, same, "mine", 1), (1, None, None, None)], kind)).collect()
    assert sorted((r.doc_id, r.n_words_, r.n_removed, r.n_words) for r in got) == [(1, 0, 0, None), (2, 20, 0, "mine"), (2, 20, 0, "mine")]
    assert [r.text for r in got if r.doc_id == 1] == [None]
    # ids that are no longs
    ints = spark.createDataFrame([(1, same), (2, same)], "doc_id int, text string")
    assert sorted((r.doc_id, r.n_removed) for r in S.remove_repeats(ints).collect()) == [(1, 0), (2, 20)]
    with pytest.raises(ValueError):
        S.remove_repeats(ints, least=3, seed=4)
