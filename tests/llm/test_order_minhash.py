import hashlib
import random

from pyspark.sql import functions as F

from stemweave.llm import order_minhash as O


def test_edited_texts_and_order(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeé漢") for _ in range(rng.randint(1, 7)))
    rows = [(i * 7, " ".join(word() for _ in range(rng.choice([0, 1, 2, 30, 400]))), "z") for i in range(60)] + [(5, None, "n"), (6, "", "e"), (8, "a" * 3000, "l"), (10_000_000_000, "far away", "o")]
    df = spark.createDataFrame(rows, "doc_id long, text string, sig string")
    got = {r.doc_id: r for r in O.fingerprints(df).collect()}
    order = sorted((i, t or "") for i, t, _ in rows)
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        m = len(t) // 2
        assert got[i].n_chars == len(t)
        assert got[i].edited_sha256 == hashlib.sha256((t[: len(t) - m] + nxt[:m]).encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
        if nxt == t:
            assert got[i].near_next == 1
    assert O.fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = O.fingerprints(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and one.near_next == 1


def test_repeated_ids_and_equal_texts(spark):
    df = spark.createDataFrame([(1, "one two three four"), (1, "one two three four"), (2, "one two three four"), (None, "x")], "doc_id long, text string")
    got = O.fingerprints(df).collect()
    assert len(got) == 4 and len({r.fingerprint for r in got if r.n_chars > 1}) == 1


def signature_by_hand(spark, text, k=3, l=2):  # noqa: E741
    """The same definition in plain Python; the hashes come from Spark."""
    import re

    pieces = re.findall(r"\S{1,12}", text)
    mask = ~((1 << O.POSITION_BITS) - 1)
    schema = ", ".join(f"c{j} string" for j in range(k))
    rows = [tuple(pieces[i + j] if i + j < len(pieces) else None for j in range(k)) for i in range(len(pieces))]
    hashes = [r[0] & mask for r in spark.createDataFrame(rows, schema).coalesce(1).select(F.xxhash64(*[f"c{j}" for j in range(k)])).collect()]
    seen, items = {}, []
    for p, h in enumerate(hashes):
        n = seen[h] = seen.get(h, -1) + 1
        if n:
            h = spark.range(1).select(F.xxhash64(F.lit(h), F.lit(n))).first()[0] & mask
        items.append((h, p))
    bins = {}
    for h, p in sorted(items):
        bins.setdefault((h % (1 << 64)) >> (64 - O.BIN_BITS), []).append((p, h))
    out = []
    for b, members in bins.items():
        chosen = [h for _, h in sorted(members[:l])]
        t = spark.range(1).select(F.xxhash64(F.array(*[F.lit(h) for h in chosen]))).first()[0] & 0xFFFFFFFF
        out.append(b << 32 | t)
    return out


def test_signature_by_brute_force(spark):
    rng = random.Random(9)
    text = " ".join(rng.choice(["a", "bb", "ccc", "dd"]) for _ in range(40))
    got = spark.createDataFrame([(text,)], "t string").select(O.signature(F.col("t"))).first()[0]
    assert sorted(got) == sorted(signature_by_hand(spark, text))


def test_likeness_follows_edits(spark):
    rng = random.Random(1)
    base = [f"w{rng.randrange(10**6)}" for _ in range(600)]
    versions = [" ".join(base)]
    for share in (0.01, 0.1, 0.5):
        t = list(base)
        for i in rng.sample(range(600), int(600 * share)):
            t[i] = "x%d" % rng.randrange(10**6)
        versions.append(" ".join(t))
    rotated = " ".join(base[300:] + base[:300])
    df = spark.createDataFrame([(versions[0], v) for v in [*versions, rotated]], "a string, b string")
    got = [r[0] for r in df.select(O.likeness(O.signature(F.col("a")), O.signature(F.col("b")))).collect()]
    assert got[0] == 1 and got[0] > got[1] > got[2] >= got[3] and got[4] < 0.9


def test_one_character_put_into_a_long_run(spark):
    rng = random.Random(4)
    run = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(3000))
    df = spark.createDataFrame([(run, "一" + run), (run, run[:1500] + "一" + run[1500:])], "a string, b string")
    got = [r[0] for r in df.select(O.likeness(O.signature(F.col("a")), O.signature(F.col("b")))).collect()]
    assert min(got) > 0.9


def test_hot_ids_and_rows_without_ids_are_split(spark, monkeypatch):
    monkeypatch.setattr(O, "ROWS_PER_BUCKET", 5)
    rows = [(7, f"text {k} of seven") for k in range(60)] + [(None, f"text {k} of none") for k in range(40)] + [(k, f"text {k} alone") for k in range(100, 160)] + [(7, "text 3 of seven"), (9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    dealt = O.with_next(df)[0]
    buckets = {(r.doc_id, r.b) for r in dealt.select("doc_id", "b").collect()}
    assert len([b for i, b in buckets if i == 7]) > 5 and len([b for i, b in buckets if i is None]) > 4
    # the order of the buckets is that of (id, hash of the text)
    seen = [(r.doc_id is not None, r.doc_id or 0, r.o) for r in dealt.orderBy("b", F.col("doc_id").asc_nulls_first(), "o").collect()]
    assert seen == sorted(seen)
    got = {(r.doc_id, r.n_chars, r.edited_sha256) for r in O.fingerprints(df).collect()}
    hashes = {r.text: r.o for r in df.select(F.coalesce("text", F.lit("")).alias("text")).distinct().withColumn("o", F.xxhash64("text")).collect()}
    line = sorted(((i is not None, i or 0, hashes[t or ""]), i, t or "") for i, t in rows)
    want = set()
    for k, (_, i, t) in enumerate(line):
        after, n = line[(k + 1) % len(line)][2], len(t) // 2
        want.add((i, len(t), hashlib.sha256((t[: len(t) - n] + after[:n]).encode()).hexdigest()))
    assert got == want


def test_places_beyond_their_bits_are_one_place(spark, monkeypatch):
    monkeypatch.setattr(O, "POSITION_BITS", 4)
    monkeypatch.setattr(O, "_LOW", 15)
    df = spark.createDataFrame([(" ".join(f"w{k}" for k in range(200)),), (" ".join(f"w{k}" for k in range(200)),)], "t string")
    a, b = (r.s for r in df.select(O.signature(F.col("t")).alias("s")).collect())
    assert a == b and len(a) > 50
