import hashlib
import math
import random

import numpy as np

from stemweave.llm import vector_codes as V


def codes_by_hand(rows, parts=16, entries=64, rounds=2):
    """Plain k-means over all entries, in whole numbers."""
    kept = [(i, label, [math.floor(256 * x) for x in v]) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    size = len(kept[0][2]) // parts
    cut = lambda v, p: tuple(v[p * size : (p + 1) * size])
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    start = sorted(kept, key=lambda r: (r[0], r[2]))[:entries]
    books = [[cut(r[2], p) for r in start] for p in range(parts)]
    assign = lambda v: [min(range(len(b)), key=lambda e: (far(cut(v, p), b[e]), e)) for p, b in enumerate(books)]
    for _ in range(rounds):
        codes = [assign(v) for _, _, v in kept]
        new = []
        for p, b in enumerate(books):
            balls = [[cut(v, p) for (_, _, v), c in zip(kept, codes) if c[p] == e] for e in range(len(b))]
            new.append([tuple(sum(x[k] for x in ball) // len(ball) for k in range(size)) if ball else b[e] for e, ball in enumerate(balls)])
        books = new
    out = []
    for i, label, v in kept:
        c = assign(v)
        out.append((i, label, bytes(c), sum(far(cut(v, p), books[p][e]) for p, e in enumerate(c))))
    return out, books


def test_codes_by_brute_force(spark):
    rng = random.Random(6)
    vector = lambda: [rng.choice([rng.gauss(0, 0.2), rng.gauss(1, 0.05), -0.25, 0.0]) for _ in range(32)]
    rows = [(i * 3, vector(), i % 4) for i in range(300)]
    same = vector()
    rows += [(2000 + i, same, 9) for i in range(60)] + [(1, rows[0][1], None), (1, rows[0][1], None), (1, rows[5][1], None)]
    bad = [(9001, None, 1), (9002, [], 1), (9003, [None] * 32, 1), (9004, [float("nan")] + [0.0] * 31, 1), (9005, [float("inf")] * 32, None)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, label int")
    rounded = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    want, books = codes_by_hand([r for r in rounded])
    coded, got_books = V.product_codes(df, "vec_id", "embedding", "label")
    assert got_books.tolist() == [[list(e) for e in b] for b in books]
    key = lambda r: (r[0], str(r[1]), r[2], r[3])
    assert sorted([(r.id, r.label, bytes(r.code), r.error) for r in coded.collect()], key=key) == sorted(want, key=key)
    sums = {}
    for _, label, _, e in want:
        sums[label] = sums.get(label, 0) + e
    assert {(r.label, r.label_error) for r in V.with_label_errors(coded).collect()} == set(sums.items())
    assert V.codebooks_sha256(got_books) == hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def test_pruned_search_is_exact_and_skips():
    rng = np.random.default_rng(3)
    for d in (1, 2, 4, 9):
        c = rng.integers(-40, 40, (64, d))
        c[10] = c[3]  # equal entries
        x = np.concatenate([rng.integers(-50, 50, (500, d)), c[rng.integers(0, 64, 1500)] + rng.integers(-1, 2, (1500, d))])
        far = ((x[:, None] - c[None]) ** 2).sum(2)
        best = far.argmin(1)  # the first of equal ones
        index, least, _ = V.Balls(c).nearest(x, rng.integers(0, 64, len(x)))
        assert (index == best).all() and (least == far.min(1)).all()
        moved = c + rng.integers(-2, 3, c.shape)
        radius = np.array([np.sqrt(far[best == e, e].max()) if (best == e).any() else 0.0 for e in range(64)]) + np.sqrt(((moved - c) ** 2).sum(1))
        index, least, pairs = V.Balls(moved, radius).nearest(x, best)
        far = ((x[:, None] - moved[None]) ** 2).sum(2)
        assert (index == far.argmin(1)).all() and (least == far.min(1)).all()
        assert pairs < len(x) * 64


def test_edges(spark):
    kind = "vec_id long, embedding array<float>, label string, code int"
    coded, books = V.product_codes(spark.createDataFrame([], kind), "vec_id", "embedding", "label")
    assert coded.count() == 0 and books.size == 0
    assert coded.columns == ["id", "label", "code", "error"]
    # fewer rows than entries, another length, a length that 16 doesn't divide, no id
    rows = [(1, [1.0] * 20, "a", 1), (2, [2.0] * 20, None, 1), (None, [3.0] * 20, "a", 1), (4, [1.0], "b", 1)]
    coded, books = V.product_codes(spark.createDataFrame(rows, kind), "vec_id", "embedding", "label")
    assert books.shape == (16, 3, 2)
    got = {r.id: (bytes(r.code), r.error) for r in coded.collect()}
    # behind the twentieth component there are zeros, of which the first entry is the nearest
    assert got == {1: (bytes([0] * 16), 0), 2: (bytes([1] * 10 + [0] * 6), 0), None: (bytes([2] * 10 + [0] * 6), 0)}
