"""Edge rows of operators that the queries on the driver tables do not reach."""

import gzip

import pytest
from pyspark.sql import functions as F

from stemweave.functions import scalars
from stemweave.operators import aggregates, graph, joins, log, ranking, scoring, sets, stats, text
from stemweave.sources import files, sinks


def test_range_lookup_bounds(spark):
    df = spark.createDataFrame([(None,), (1065,), (1066,), (1499,), (1500,)], "y int")
    got = [r.e for r in joins.range_lookup(df, "y", [("old", None, 1066), ("middle", 1066, 1500)], "e").collect()]
    assert got == ["Undated", "old", "middle", "middle", None]


def test_asof_takes_the_last_at_or_before(spark):
    left = spark.createDataFrame([(1, 5), (1, 10), (2, 1)], "k int, t int")
    right = spark.createDataFrame([(1, 5, "a"), (1, 9, "b"), (2, 2, "c")], "k int, t int, v string")
    got = {(r.k, r.t, r.v) for r in joins.asof_join(left, right, "k", "t", "t", {"v": "v"}).collect()}
    assert got == {(1, 5, "a"), (1, 10, "b"), (2, 1, None)}


def test_snapshot_diff(spark):
    a = spark.createDataFrame([("x", 1.0), ("y", 2.0), ("same", 3.0)], "m string, v double")
    b = spark.createDataFrame([("y", 5.0), ("z", None), ("same", 3.0)], "m string, v double")
    got = {(r.m, r.value_a, r.value_b, r.delta) for r in joins.snapshot_diff(a, b, ["m"], "v").collect()}
    assert got == {("x", 1.0, None, None), ("y", 2.0, 5.0, 3.0)}


def test_fallback_levels_and_stored_zero(spark):
    cube = spark.createDataFrame([("a", "t", 1, 0.0), ("a", "t", 2, 4.0), ("a", "u", 1, 9.0)], "c string, tag string, era int, v double")
    asks = spark.createDataFrame([("a", "t", 1), ("a", "t", 7), ("a", "w", 7), ("b", "w", 7)], "c string, tag string, era int")
    got = {(r.c, r.tag, r.era): r.value for r in aggregates.fallback_max(cube, asks, ["c", "tag", "era"], [["era"], ["tag", "era"]], "v").collect()}
    assert got == {("a", "t", 1): 0.0, ("a", "t", 7): 4.0, ("a", "w", 7): 9.0, ("b", "w", 7): 0.0}


def test_divergences_on_empty_and_disjoint(spark):
    empty = spark.createDataFrame([], "k string")
    one = stats.distribution(spark.createDataFrame([("x",), ("x",)], "k string"), "k")
    none = stats.distribution(empty, "k")
    assert none.count() == 0
    assert stats.kl_divergence(none, one, "k").first().kl == 0.0
    assert stats.total_variation(one, stats.distribution(spark.createDataFrame([("y",)], "k string"), "k"), "k").first().tv == 1.0
    r = spark.createDataFrame([("a", 1)], "k string, rank int")
    assert stats.spearman(r, r, "k").first().rho == 0.0


def test_eb_smoothing_without_counts(spark):
    df = spark.createDataFrame([("a", 0, 0)], "k string, s int, l int")
    assert stats.eb_smoothing(df, "s", "l").first().probability == 0.5


def test_graph_edges(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (5, 3), (8, 9), (9, 8), (7, 7)], "p long, c long")
    got = {r.node: r.root for r in graph.smallest_reaching_root(e, "p", "c").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 5: 5, 8: None, 9: None}
    n = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 5), (5, 4), (6, 99)], "id long, to_id long")
    assert {(r.id, r.terminal, r.cyclic) for r in graph.flatten_chains(n, "id", "to_id").collect()} == {(1, 1, False), (2, 1, False), (3, 1, False), (4, 4, True), (5, 5, True), (6, 99, False)}


def test_break_cycles_against_union_find(spark):
    import random

    rng = random.Random(2)
    rows = [(rng.randrange(15), rng.randrange(15), rng.randrange(20)) for _ in range(60)] + [(3, 3, 0), (1, 2, 5), (1, 2, 5)]
    root = list(range(15))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    want = []
    for k, a, b in sorted((k, a, b) for a, b, k in rows):
        x, y = find(a), find(b)
        root[x] = y
        want.append((a, b, k, x != y))
    got = [tuple(r) for r in graph.break_cycles(spark.createDataFrame(rows, "a long, b long, k long"), "a", "b", "k").collect()]
    assert sorted(got) == sorted(want)
    assert graph.break_cycles(spark.createDataFrame([], "a long, b long, k long"), "a", "b", "k").count() == 0


def test_depth_has_no_bound(spark):
    chain = spark.range(1, 71).selectExpr("id as child", "id - 1 as parent")
    assert graph.ancestors(spark.createDataFrame([(70,)], "s long"), chain, "s", "parent", "child").count() == 71
    cycle = spark.createDataFrame([(1, 2), (2, 1)], "child long, parent long")
    assert {(r.node, r.depth) for r in graph.ancestors(spark.createDataFrame([(1,)], "s long"), cycle, "s", "parent", "child").collect()} == {(1, 0), (2, 1)}
    roots = graph.smallest_reaching_root(spark.range(1, 231).selectExpr("id as c", "id - 1 as p"), "p", "c")
    assert roots.where("root = 0").count() == 231


def test_components_against_brute_force(spark):
    import random

    rng = random.Random(6)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(200 + i, 201 + i) for i in range(30)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    want = {n: find(n) for e in edges if e[0] != e[1] for n in e}
    got = {r.node: r.component for r in graph.min_label_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == want


def test_log_fold_rules(spark):
    rows = [("a", 1, "add", {"x": "1"}), ("a", 2, "add", {"x": "2"}), ("a", 3, "patch", {"y": "3"}), ("b", 1, "patch", {"x": "1"}), ("c", 1, "remove", None), ("c", 2, "set", {"x": "9"}), ("c", 3, "remove", None), ("c", 4, "add", {"z": "1"})]
    got = {r.k: (r.live, r.state, r.errors) for r in log.fold_log(spark.createDataFrame(rows, "k string, i int, op string, f map<string,string>"), ["k"], "i", "op", "f").collect()}
    assert got == {"a": (True, {"x": "1", "y": "3"}, 1), "b": (False, {}, 1), "c": (True, {"z": "1"}, 0)}


def test_segmentation():
    trie = text.build_trie(["Bridg-", "-water", "-y", "---", "ham", "bridge", "wat"])
    assert text.best_segmentations("bridgwater", trie) == [["bridg", "water"]]
    assert text.best_segmentations("bridgxham", trie) == [["bridg", "(x)", "ham"]]
    assert text.best_segmentations("xyz", trie)[0] == ["(x)", "y", "(z)"]
    assert text.best_segmentations("bridgsham", trie, ("s",)) == [["bridg", "+s+", "ham"]]
    assert text.best_segmentations("", trie) == [[]]
    starts = text.trie_starts("bridgwater", trie)
    every = list(text.segmentations("bridgwater", starts))
    assert ["bridg", "water"] in every and ["(bridgwater)"] in every and len(every) == len({tuple(p) for p in every}) == text.count_segmentations("bridgwater", starts)


def test_best_parses_against_all_parses():
    import random

    rng = random.Random(5)
    for _ in range(300):
        trie = text.build_trie({"".join(rng.choice("ab") for _ in range(rng.randint(1, 3))) for _ in range(4)})
        word = "".join(rng.choice("abc") for _ in range(rng.randint(0, 9)))
        every = list(text.segmentations(word, text.trie_starts(word, trie)))
        cost = lambda p: (sum(len(x) - 2 for x in p if x[0] == "("), sum(x[0] != "(" for x in p))
        low = min(map(cost, every))
        best = text.best_segmentations(word, trie)
        assert sorted(best) == sorted(p for p in every if cost(p) == low)
        assert best[0] == min(best, key=lambda p: (-len(p[0]) if p and p[0][0] != "(" else 1, p))


def test_ties_and_words_have_no_bound(spark):
    words = spark.createDataFrame([("abc" * 12,), ("A-b",), (None,), ("",)], "w string")
    entries = spark.createDataFrame([("a",), ("bc",), ("ab",), ("c",), ("-",), (None,)], "e string")
    got = text.segment(words, "w", entries, "e", all_ties=True).groupBy("word").count().collect()
    starts = text.trie_starts("abc" * 12, text.build_trie(["a", "bc", "ab", "c"]))
    want = sum(1 for _ in text.BestParses("abc" * 12, starts).all())
    assert {r.word: r["count"] for r in got} == {"abc" * 12: want, "a-b": 1} and want == 2**12
    long = spark.createDataFrame([("ab" * 20,)], "w string")
    count = text.parse_counts(long, "w", spark.createDataFrame([("a",), ("b",)], "e string"), "e").first().parses
    assert count == 2**40


def test_longest_common_run(spark):
    rows = [("abcdefghijklmnopqrst", "xxbcdefghijklmnopqrsyy", 18), ("abc", "xyz", 0), ("", "a", 0), ("a", "a", 1), (None, "a", 0), ("banana", "ananas", 5)]
    df = spark.createDataFrame(rows, "a string, b string, n int")
    assert all(r.n == r.got for r in df.select("n", text.longest_common_run(F.col("a"), F.col("b")).alias("got")).collect())


def test_residual_span():
    assert text.residual_span("nettleton", [["nettle"]]) == "ton"
    assert text.residual_span("downton", [["dow", "down"]]) == "ton"  # the longer spelling leaves less over
    assert text.residual_span("tondown", [["down"]]) == "ton"  # in any order
    assert text.residual_span("abxxab", [["ab"], ["ab"]]) == "xx" and text.residual_span("abc", [["ab"]]) is None
    assert text.residual_span("abxyab", [["ab"]]) is None  # a head and a tail of one length: two rests


def test_residual_and_sound_changes():
    assert text.residual_alignment("kingston", [["king"], ["tun", "ton"]]) is None
    assert text.residual_alignment("kingstun", [["kings"], ["ton"]]) == (1, "tun")
    assert text.sound_changes("hus", [("u", "ou", 0.75)]) == [("hous", 0.75), ("hus", 0.25)]
    assert text.sound_changes("hus", [("u", "u", 0.5)]) == [("hus", 1.0)]
    assert text.transliterate("thing", {"th": "þ", "t": "T"}) == "þing"


def test_scalars(spark):
    df = spark.createDataFrame([("Æthelstān-1",), (None,), ("LOW",)], "s string")
    got = [tuple(r) for r in df.select(scalars.fold_surface(F.col("s")), scalars.consonant_skeleton(F.col("s")), scalars.confidence_score(F.col("s"))).collect()]
    assert got[0][:2] == ("aethelstan", "thlstn") and got[1][0] is None and got[2][2] == 0.3 and got[1][2] == 0.0
    ids = [r[0] for r in spark.createDataFrame([(None, ""), ("", None)], "a string, b string").select(scalars.content_id("X", F.col("a"), F.col("b"))).collect()]
    assert ids[0] != ids[1]


def test_sampling_rules(spark):
    w = spark.createDataFrame([("g", "a", 0.0), ("g", "b", 1.0), ("g", "c", 3.0)], "g string, k string, w double")
    d = spark.createDataFrame([("g", 0.0), ("g", 0.24), ("g", 0.25), ("g", 0.999), ("none", 0.5)], "g string, u double")
    assert {(r.g, r.u): r.chosen for r in scoring.weighted_choice(w, d, "g", "k", "w", "u").collect()} == {("g", 0.0): "b", ("g", 0.24): "b", ("g", 0.25): "c", ("g", 0.999): "c", ("none", 0.5): None}
    u = [r[0] for r in spark.range(1000).select(scoring.hashed_uniform(7, F.col("id"))).collect()]
    assert 0.45 < sum(u) / 1000 < 0.55 and min(u) >= 0 and max(u) < 1


def test_unanimous_and_vocabulary(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, "b"), (3, "a"), (3, None)], "k int, v string")
    assert {r.k: r.x for r in ranking.unanimous(df, ["k"], "v", "x").collect()} == {1: "a", 2: None, 3: None}
    scan = sets.vocabulary_scan(spark.createDataFrame([("England",), (" england",), ("Brittany",), ("Mars",), (None,)], "c string"), "c", ["England", "France"], {"Brittany": "France"})
    assert {r.value: (r.status, r.target) for r in scan.collect()} == {"England": ("ok", None), " england": ("dirty", None), "Brittany": ("stale", "France"), "Mars": ("unknown", None), None: ("info", None)}


def test_jsonl_numbers_and_errors(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('# head\n{"ref": "x", "n": 1}\n\n{"ref": "y"}\n')
    (tmp_path / "skip.jsonl").write_text("not json\n")
    got = files.read_jsonl(spark, str(tmp_path), "ref string, n int", exclude=["skip.jsonl"]).collect()
    assert sorted((r.file, r.line_no, r.ref, r.n) for r in got) == [("a.jsonl", 2, "x", 1), ("a.jsonl", 4, "y", None)]
    with pytest.raises(Exception, match="skip.jsonl:1"):
        files.read_jsonl(spark, str(tmp_path), "ref string, n int").collect()


def test_compressed_dumps(spark, tmp_path):
    import zstandard

    (tmp_path / "a.txt").write_text("one\ntwo\n")
    (tmp_path / "b.gz").write_bytes(gzip.compress(b"three\n"))
    (tmp_path / "c.zst").write_bytes(zstandard.ZstdCompressor().compress(b"four\nfive"))
    assert {(r.file, r.value) for r in files.compressed_lines(spark, str(tmp_path)).collect()} == {("a.txt", "one"), ("a.txt", "two"), ("b.gz", "three"), ("c.zst", "four"), ("c.zst", "five")}


def test_csv_events(spark, tmp_path):
    p = tmp_path / "g.csv"
    p.write_text("place_name,county,year\nBath,Som,1665\nBath,Som,x\nYork,Yks,1200\n ,Yks,1670\n")
    places, facts = files.csv_events(spark, str(p), ["place_name"], "place_name", "year", 1665, (1662, 1674))
    assert {r.ref for r in places.collect()} == {"Bath@Som", "York@Yks"}
    assert sorted((r.ref, r.date_year) for r in facts.collect()) == [("Bath@Som", 1665), ("Bath@Som", 1665), ("York@Yks", 1665)]
    with pytest.raises(ValueError):
        files.csv_events(spark, str(p), ["vill"], "vill", None, 1, (0, 1))


def test_dictionary_shapes(spark, tmp_path):
    from stemweave.sources import dictionary

    lines = [
        '{"word":"town","lang_code":"en","senses":[{"glosses":["settlement"]}],"etymology_templates":[{"name":"inh","args":{"1":"en","2":"ang","3":"tun"}},{"name":"foo","args":{"2":"x","3":"y"}},{"name":"cog","args":{"1":"de","2":"Zaun"}},{"name":"bor","args":{"1":"en"}},{"name":"root","args":{"1":"en","2":"ine-pro","3":"*a","4":"","5":"*b","7":"*c"}}],"descendants":[{"word":"toun","lang_code":"sco","raw_tags":["borrowed"],"descendants":[{"word":"w","lang_code":"q","descendants":[]}]}]}',
        '{"word":"treehouse","lang_code":"en","etymology_templates":[{"name":"compound","args":{"1":"en","2":"tree","3":"house"}},{"name":"clipping","args":{"1":"en","2":"treehousing"}},{"name":"af"}]}',
        '{"word":"","lang_code":"en"}',
    ]
    (tmp_path / "d.jsonl").write_text("\n".join(lines))
    tables = dictionary.ingest(dictionary.read_entries(spark, str(tmp_path)))
    assert {tuple(r) for r in tables["edges"].collect()} == {
        ("en:town", "ang:tun", "inheritance"), ("en:town", "ine-pro:*a", "inheritance"), ("en:town", "ine-pro:*b", "inheritance"), ("en:treehouse", "en:tree", "compound"),
        ("en:treehouse", "en:house", "compound"), ("en:treehouse", "en:treehousing", "derivation"), ("sco:toun", "en:town", "borrowing"), ("q:w", "sco:toun", "inheritance"),
    }
    words = {r.ref: r.gloss for r in tables["words"].collect()}
    assert words["en:town"] == "settlement" and words["ang:tun"] is None and len(words) == 10


def test_derivation_parsers(spark):
    d = spark.createDataFrame([("OE tun - farm; enclosure; ON by - village",), ("stray",)], "d string").select(files.parse_derivation(F.col("d"), ["OE", "ON"]).alias("x")).collect()
    assert [tuple(e) for e in d[0].x] == [("OE", "tun", "farm; enclosure"), ("ON", "by", "village")] and d[1].x == []
    c = spark.createDataFrame([(1, "From Old English tun, from Proto-Germanic *tunaz.")], "k int, t string").select("k", files.etymology_chain(F.col("t"), ["Old English", "Proto-Germanic"]).alias("c"))
    assert [(r.child, r.parent) for r in files.chain_edges(c, "k", "c").collect()] == [("old english:tun", "proto-germanic:*tunaz")]


def test_clean_ocr_and_manifest(spark, tmp_path):
    got = spark.createDataFrame([("THE BOOK 12\nﬁeld-\nname here\n 34 \n",)], "t string").select(files.clean_ocr(F.col("t"))).first()[0]
    assert got == "fieldname here\n"
    (tmp_path / "a.bin").write_bytes(b"x")
    m = spark.createDataFrame([("a.bin", "2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881"), ("b.bin", "0")], "name string, sha256 string")
    f = spark.read.format("binaryFile").load(str(tmp_path / "a.bin"))
    assert {(r.name, r.status) for r in files.verify_manifest(f, m).collect()} == {("a.bin", "ok"), ("b.bin", "missing")}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("s1", 2, "b"), ("s1", 1, "a"), ("s2", 3, None)], "src string, n int, v string")
    sinks.canonical_dump(df, str(tmp_path / "dump"), "src", ["n"])
    assert [p.read_text() for p in sorted((tmp_path / "dump" / "src=s1").glob("*.json"))] == ['{"n":1,"v":"a"}\n{"n":2,"v":"b"}\n']
    target = f"file://{tmp_path}/gold"
    for part in (df, df.limit(1)):
        sinks.replace_atomically(part, target)
        assert spark.read.parquet(target).count() == part.count()
    assert [p.name for p in tmp_path.iterdir() if p.name.startswith("gold")] == ["gold"]


def test_streaming_counts_match_batch(spark, tmp_path):
    from stemweave.streaming import logs

    rows = spark.range(200).select(F.timestamp_seconds(F.col("id") * 60).alias("ts"), (F.col("id") % 3).alias("k"))
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = logs.windowed_counts(stream, "ts", ["k"], "10 minutes", late="1 day").writeStream.outputMode("complete").format("memory").queryName("w").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    want = {tuple(r) for r in logs.windowed_counts(rows, "ts", ["k"], "10 minutes").collect()}
    assert {tuple(r) for r in spark.table("w").collect()} == want


def test_containing_meets_every_text(spark):
    from stemweave.operators import text as T

    docs = spark.createDataFrame([(1, "one two three four"), (42, "x one two three fourteen"), (43, "bone two\nthree four"), (4, "two"), (5, None), (6, "of the one two three")], "d long, t string")
    quotes = spark.createDataFrame([(1, "one two three four"), (2, "one two three"), (3, "two"), (4, "one unseen word"), (5, "one two\nthree"), (6, None)], "q long, quote string")
    want = {(q.q, d.d) for q in quotes.collect() for d in docs.collect() if q.quote and d.t and q.quote in d.t}
    got = [tuple(r) for r in T.containing(docs, "d", "t", quotes, "q", "quote").collect()]
    assert set(got) == want and len(got) == len(want) and {(1, 42), (5, 43), (3, 4)} <= want


def test_intermediate_tables_can_be_cleared(spark):
    kept = graph.stored(spark.range(5))
    assert kept.count() == 5
    graph.clear(spark)
    with pytest.raises(Exception):
        spark.read.parquet(graph.shared_dir(spark) + "/stemweave/" + spark.sparkContext.applicationId).count()


@pytest.mark.parametrize("hubs", [0, 3, 10_000])
def test_components_with_and_without_hubs(spark, monkeypatch, hubs):
    import random

    monkeypatch.setattr(graph, "HUBS", hubs)
    rng = random.Random(hubs)
    edges = [(0, k) for k in range(1, 60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(70)] + [(300 + k, 301 + k) for k in range(40)] + [(5, 5)]
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.component for r in graph.min_label_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: root[x] for x in linked}
