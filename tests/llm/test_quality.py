import math
import random
import zlib

import pyarrow as pa
from pyspark.sql import functions as F

from stemweave.llm import quality as Q


def tables(spark, n=400):
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        text = ("JUNK!!! ### $$$ %%% " * 8) if bad else f"This is a plain sentence number {i}, and it reads well enough. " * 3
        rows.append((i, text, f"s{i % 5}", "en" if i % 2 else "fr", "x"))
        if i % 3:
            labels.append((i, int(not bad), 0))
    rows += [(9001, None, None, None, "x"), (9002, "", "s1", "en", "x"), (9003, "new site text here, all fine. " * 3, "unseen", "de", "x"), (9003, "new site text here, all fine. " * 3, "unseen", "de", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, host string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy_and_edges(spark):
    docs, labels = tables(spark)
    got = Q.quality_scores(docs, labels).collect()
    assert len(got) == docs.count()
    held = [r for r in got if r.held_out and r.doc_id < 9000]
    assert held and sum(r.keep == int(r.doc_id % 4 != 0) for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.score == r.score for r in got)
    empty = labels.limit(0)
    assert {round(r.score, 6) for r in Q.quality_scores(docs, empty).collect()} == {0.5}
    assert Q.quality_scores(docs.limit(0), labels).count() == 0


def test_sparse_sites_shrink(spark):
    rows = [("big", "a", 1.0)] * 80 + [("big", "a", 0.0)] * 20 + [("bad", "a", 0.0)] * 100 + [("one", "p", 0.0)] + [("good", "a", 1.0)] * 200 + [(None, None, 1.0)]
    hosts, paths, base = Q.site_posteriors(spark.createDataFrame(rows, "host string, path string, label double"))
    rate = {r.host: r.host_rate for r in hosts.collect()}
    assert rate["bad"] < rate["one"] < base < rate["good"] and abs(rate["one"] - base) < abs(rate["bad"] - base)
    assert {(r.host, r.path) for r in paths.collect()} == {(h, p) for h, p, _ in rows}


def test_path_below_a_real_host(spark):
    from pyspark.sql import functions as F

    from stemweave.llm.quality import quality_scores

    paths = ["good", "bad"]
    docs = spark.createDataFrame([(i, "one two three", f"https://{'ab'[i % 4 // 2]}.org/{paths[i % 2]}/{i}") for i in range(200)], "doc_id long, text string, url string")
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(200)], "doc_id long, quality int")
    got = quality_scores(docs, labels, F.split_part("url", F.lit("/"), F.lit(3)), F.split_part("url", F.lit("/"), F.lit(4))).collect()
    assert len(got) == 200
    assert min(r.path_rate for r in got if r.doc_id % 2 == 0) > 0.8 and max(r.path_rate for r in got if r.doc_id % 2) < 0.2


def brute_posteriors(rows):
    """Posteriors of each host and path, with strengths by the method of moments, in plain Python."""
    cells = {}
    for h, p, y in rows:
        g, n = cells.get((h, p), (0.0, 0))
        cells[h, p] = (g + y, n + 1)
    base = (sum(g for g, _ in cells.values()) + 1) / (sum(n for _, n in cells.values()) + 2)

    def strength(groups):  # (good, n, prior)
        chi = sum(n * (g / n - q) ** 2 for g, n, q in groups)
        noise = sum(q * (1 - q) for _, _, q in groups)
        room = sum(q * (1 - q) * (n - 1) for _, n, q in groups)
        if not room or chi <= noise:
            return 1000.0
        return min(max(1 / min(max((chi - noise) / room, 1e-3), 0.5) - 1, 1.0), 1000.0)

    hosts = {}
    for (h, _), (g, n) in cells.items():
        a, b = hosts.get(h, (0.0, 0))
        hosts[h] = (a + g, b + n)
    k = strength([(g, n, base) for g, n in hosts.values()])
    rate = {h: (g + k * base) / (n + k) for h, (g, n) in hosts.items()}
    k = strength([(g, n, rate[h]) for (h, _), (g, n) in cells.items()])
    return base, rate, {(h, p): (g + k * rate[h]) / (n + k) for (h, p), (g, n) in cells.items()}


def test_posteriors_and_scores_against_brute_force(spark):
    rng = random.Random(7)
    good = {h: rng.random() for h in "abcdef"}
    rows = [(h, f"p{rng.randrange(4)}", float(rng.random() < good[h])) for h in good for _ in range(rng.randint(1, 60))] + [(None, "p0", 1.0), ("a", None, 0.0)]
    base, hosts, paths = brute_posteriors(rows)
    got_hosts, got_paths, got_base = Q.site_posteriors(spark.createDataFrame(rows, "host string, path string, label double"))
    assert abs(got_base - base) < 1e-12
    assert {r.host: round(r.host_rate, 10) for r in got_hosts.collect()} == {h: round(v, 10) for h, v in hosts.items()}
    assert {(r.host, r.path): round(r.path_rate, 10) for r in got_paths.collect()} == {k: round(v, 10) for k, v in paths.items()}
    docs, labels = tables(spark)
    logit = lambda q: math.log(q / (1 - q))
    out = Q.quality_scores(docs, labels).collect()
    seen = {r.doc_id: (r.source, r.lang) for r in docs.collect()}
    known = [(*seen[r.doc_id], float(r.quality)) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5]
    base, hosts, paths = brute_posteriors(known)
    for r in out:
        site = seen[r.doc_id]
        rate = paths.get(site, hosts.get(site[0], base))
        want = 1 / (1 + math.exp(-(r.evidence + logit(rate) - logit(base))))
        assert abs(r.score - want) < 1e-9 and r.keep == int(r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_evidence_is_the_models_sum(spark):
    docs, labels = tables(spark, 120)
    model = Q.fit_evidence(Q.training_rows(docs, labels, "quality", 1000))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in Q.evidence(docs.dropDuplicates(["doc_id"]), model, ["doc_id"]).collect():
        x = Q.shape_features(pa.array([texts[r.doc_id]]))[0]
        z = [min(max((v - m) / s, -8), 8) for v, m, s in zip(x, model["mean"], model["scale"])]
        assert abs(r.evidence - min(max(sum(a * b for a, b in zip(z, model["w"])) + model["b"], -30), 30)) < 1e-6


def test_sites_help_where_texts_say_nothing(spark):
    """Texts of good and bad documents are alike; hosts differ, and paths within them."""
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(3000):
        host, path = f"h{rng.randrange(20)}", f"p{rng.randrange(3)}"
        rate = 0.9 if (int(host[1:]) + int(path[1:])) % 3 else 0.15
        rows.append((i, " ".join(rng.choice("one two three four five".split()) for _ in range(12)), host, path))
        labels.append((i, int(rng.random() < rate)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string, host string, path string"), spark.createDataFrame(labels, "doc_id long, quality int")
    got = [r for r in Q.quality_scores(docs, marks, F.col("host"), F.col("path")).collect() if r.held_out]
    truth = dict(labels)
    right = sum(r.keep == truth[r.doc_id] for r in got) / len(got)
    alone = sum((r.evidence >= 0) == truth[r.doc_id] for r in got) / len(got)
    assert right > 0.85 and right > alone + 0.1


def test_long_texts_ties_and_clashing_columns(spark):
    rows = [(i, "fine words " * (40_000 if i == 1 else 3), "s", "en", 1.0, True) for i in range(1, 41)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, evidence double, held_out boolean")
    marks = spark.createDataFrame([(i, k) for i in range(2, 41) for k in (0, 1)], "doc_id long, quality int")
    got = Q.quality_scores(docs, marks).collect()
    assert len(got) == 40 and len({round(r.score, 12) for r in got if r.doc_id > 1}) == 1
