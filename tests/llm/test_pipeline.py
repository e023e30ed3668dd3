import random
import re

import corpus_pipeline
from stemweave.llm.sentencepiece_codec import codec, default_model


def test_stages_on_a_small_table(spark, tmp_path):
    clean = "".join(f"Sentence number {i} of the clean text goes on here. " for i in range(20))
    bench = "the quick brown fox jumps over the lazy dog again and again today"
    rows = []
    for i in range(60):
        text = clean.replace("clean", f"clean{i} and odd{i * 7}").replace("text", f"t{i}x")
        if i % 10 == 1:
            text += " nitwit"
        rows.append((i, text, "en", f"s{i % 7}", len(text)))
    rows += [(100, rows[0][1] + " end", "en", "s1", 1), (101, f"intro words here {bench} outro", "en", "s2", 1), (102, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 10 == 1)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == {i for i in range(60) if i % 10 != 1} | {102}
    assert all(r.round_trip for r in got.values())
    assert got[2].ids == list(codec(default_model()).encode(rows[2][1]))


def brute_lines(rows, sites=5, least=20):
    """Lines on ``sites`` sources or more are cut but for their first place; rows with nothing left go."""
    where = {}
    for i, text, _, source, _ in rows:
        for k, line in enumerate((text or "").split("\n")):
            if len(line.strip(" ")) >= least:
                where.setdefault(line.strip(" "), []).append((i, k, source))
    gone = {(i, k) for places in where.values() if len({s for _, _, s in places}) >= sites for i, k, _ in sorted(places)[1:]}
    out = []
    for i, text, lang, source, n in rows:
        cut = {k for j, k in gone if j == i}
        if cut:
            text = "\n".join(line for k, line in enumerate(text.split("\n")) if k not in cut)
            n = len(text)
            if not text.strip(" "):
                continue
        out.append((i, text, lang, source, n))
    return out


def brute_copies(rows):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets = {r[0]: shingles(r[1]) for r in rows}
    root = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    return [r for r in rows if root[r[0]] == r[0]]


def brute_leaks(rows, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    windows = [w[s : s + 10] for _, t in items if (w := words(t)) for s in range(max(len(w) - 10, 0) + 1)]
    return [r for r in rows if not any(words(r[1])[s : s + len(x)] == x for x in windows for s in range(len(words(r[1])) - len(x) + 1))]


def test_run_against_brute_force(spark, tmp_path):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    bench = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate((14, 11, 3))]
    rows = []
    for i in range(90):
        kind = i % 9
        w = [word() for _ in range(rng.choice([0, 3, 30, 120]))]
        if kind == 1 and rows:
            w = (rng.choice(rows)[1] or "").split() + ["tail"]
        if kind == 2:
            w += bench[i % 3][1].upper().split() + ["after"]
        if kind == 3:
            w.append("nitwit")
        text = " ".join(w)
        if kind in (4, 5):
            text += "\nThis line stands on every site.\nbody " + word()
        rows.append((i, text if kind != 6 else rng.choice([None, "", text]), "en", f"s{i % 7}", len(text)))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    labels = [(i, 1, int(i % 9 == 3)) for i in range(90)]
    put(spark, tmp_path, rows, schema, labels, bench)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    rest = [tuple(r) for r in corpus_pipeline.toxicity(spark, docs, str(tmp_path)).collect()]  # the classifier's own decisions
    assert 75 <= len(rest) < 90 and not any("nitwit" in (r[1] or "").split() for r in rest if r[0] % 9 == 3)
    rest = brute_leaks(brute_copies(brute_lines(rest)), bench)
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == {r[0] for r in rest} and all(r.round_trip for r in got.values())
    assert all(got[i].ids == list(codec(default_model()).encode(t or "")) for i, t, *_ in rest)


def put(spark, path, rows, schema, labels, bench):
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def test_empty_tables_and_columns_of_any_name(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, h long, _h long, _id long, _bad long, rep long, n_removed long"
    put(spark, tmp_path / "none", [], schema, [], [])
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    put(spark, tmp_path / "some", [(1, "a few words", "en", "s", 11, 1, 2, 3, 4, 5, 6), (None, None, None, None, None, 1, 2, 3, 4, 5, 6)], schema, [], [])
    docs = spark.read.parquet(f"{tmp_path}/some/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path / "some"))
        assert out.columns == docs.columns and sorted(map(str, out.collect())) == sorted(map(str, docs.collect())), name
    assert corpus_pipeline.run(spark, str(tmp_path / "some")).count() == 2
