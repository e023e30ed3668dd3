import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stemweave.llm import periodic_runs as P


def runs_by_hand(w, least=24, exponent=3):
    """Every maximal stretch by trying each period, from the smallest on."""
    out = []
    for p in range(1, len(w) // exponent + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            s, n = i, j + p - i
            if j > i and n >= max(least, exponent * p) and not any(a <= s and s + n <= a + b and p % q == 0 for a, b, q in out):
                out.append((s, n, p))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def strange_words(rng):
    k, n = rng.choice([1, 2, 2, 3, 5]), rng.randint(0, 90)
    w = [rng.randrange(k) for _ in range(n)]
    if n and rng.random() < 0.6:
        p, a = rng.randint(1, 10), rng.randrange(n)
        w = [w[i] if i < a else w[min(a + (i - a) % p, n - 1)] for i in range(n)] + [rng.randrange(k) for _ in range(rng.randint(0, 20))]
    return w


def test_runs_by_brute_force():
    rng = random.Random(1)
    for _ in range(600):
        w = strange_words(rng)
        least, exponent = rng.choice([(24, 3), (9, 3), (12, 4)])
        h = P.mix(np.array(w, np.uint64) + np.uint64(5))
        want = runs_by_hand(w, least, exponent)
        assert P.text_runs(h, np.array([0, len(w)]), least, exponent)[0] == want
        if w:  # without the screen
            assert P.sequence_runs(np.array(w) + 1, least, exponent) == want


def test_common_extensions():
    rng = random.Random(2)
    for _ in range(60):
        w = [rng.randrange(2) + 1 for _ in range(rng.randint(1, 60))]
        common = P.Extensions(*P.SuffixTree(w).tour())
        a = np.array([i for i in range(len(w)) for j in range(len(w)) if i != j], np.int64)
        b = np.array([j for i in range(len(w)) for j in range(len(w)) if i != j], np.int64)

        def by_hand(i, j):
            n = 0
            while max(i, j) + n < len(w) and w[i + n] == w[j + n]:
                n += 1
            return n

        if len(a):
            assert common(a, b).tolist() == [by_hand(i, j) for i, j in zip(a.tolist(), b.tolist())]


def query_by_hand(doc_id, text):
    w = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = runs_by_hand(w)
    gone = {i for s, m, p in runs for i in range(s + p, s + m)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (
        doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{m},{p}\n" for s, m, p in runs).encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)),
    )


def test_query_by_brute_force(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{x}" for x in strange_words(rng)), "s") for i in range(150)]
    rows += [(1000 + i, " ".join(f"v{rng.randrange(500)}" for _ in range(rng.randint(1, 400))), "s") for i in range(60)]
    rows += [(2000, None, "s"), (2001, "", None), (2002, " \t\n\x0b ", "s"), (2003, "a b " * 40, "s"), (2004, "漢 字\r" * 30, "s"), (2005, "x " * 3000, "s"), (2006, "Ab ab " * 30, "s"), (2007, "same " * 24, "s"), (2008, "same " * 23, "s")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    df = P.op13_periodic_runs(spark, str(tmp_path))
    assert df.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, df.collect())) == sorted(query_by_hand(i, t) for i, t, _ in rows)


def test_edges(spark):
    df = spark.createDataFrame([(None, "a " * 30, 1), (None, "a " * 30, 1), (7, None, 2), (7, "b", 3)], "doc_id long, text string, runs int")
    got = P.collapse_runs(df).collect()
    assert [c for c in P.collapse_runs(df).columns] == ["doc_id", "text", "runs", "n_words", "runs_", "collapsed"]
    assert sorted((r.n_words, len(r.runs_), r.collapsed, r.runs) for r in got) == [(0, 0, "", 2), (1, 0, "b", 3), (30, 1, "a", 1), (30, 1, "a", 1)]
    assert P.collapse_runs(df.limit(0)).count() == 0
    # equal exponents: the first by start, then by period
    tied = spark.range(1).select(F.array(*[F.struct(F.lit(s).alias("start"), F.lit(n).alias("length"), F.lit(p).alias("period")) for s, n, p in [(0, 24, 6), (0, 40, 10), (9, 30, 5), (50, 60, 10)]]).alias("r"))
    assert tuple(tied.select(P.strongest(F.col("r").cast("array<struct<start:long,length:long,period:long>>")).alias("b")).first().b) == (9, 30, 5)
    with pytest.raises(ValueError):
        P.collapse_runs(df, exponent=2)
