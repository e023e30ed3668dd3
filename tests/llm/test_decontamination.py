import random
import re

from stemweave.llm.decontamination import contamination, drop_contaminated, positional_index, proximity_matches

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items, width=10):
    wins = [(i, w[s : s + width]) for i, t in items if (w := words(t)) for s in range(max(len(w) - width, 0) + 1)]
    out = {}
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for i, x in wins:
            for s in range(len(w) - len(x) + 1):
                if w[s : s + len(x)] == x:
                    hit.update(range(s, s + len(x)))
                    ids.add(i)
        out[d] = (len(w), len(hit), len(ids))
    return out


PASSAGE = "Alpha beta, gamma-delta epsilon zeta eta theta iota kappa lambda mu 42 É"
ITEMS = [(1, PASSAGE), (2, "gamma delta epsilon zeta eta theta iota kappa lambda mu"), (3, "rare pair"), (4, None), (5, "..."), (6, "the the"), (7, "rare pair")]
DOCS = [(1, f"x {PASSAGE.upper()} y"), (2, "nothing here"), (3, None), (4, ""), (5, "the the the"), (6, "RARE-pair rare pair"), (7, "a " * 3000 + PASSAGE), (8, " ".join(words(PASSAGE)[1:9])), (9, "alpha beta gamma delta epsilon zeta eta theta iota kappa alpha beta"), (10, PASSAGE + " " + PASSAGE)]


def test_against_brute_force(spark):
    docs = spark.createDataFrame([(d, t, 1, "q") for d, t in DOCS], "doc_id long, text string, pos int, term string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {r.doc_id: r for r in contamination(docs, bench).collect()}
    for d, (n, hit, ids) in brute(DOCS, ITEMS).items():
        assert (got[d].n_words, got[d].n_hit, got[d].n_items, got[d].contaminated) == (n, hit, ids, hit > 0), d
    kept = drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, v in brute(DOCS, ITEMS).items() if not v[1]}


def test_empty_tables_and_repeats(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "c"), (None, "rare pair")], "doc_id long, text string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = sorted((r.doc_id or -1, r.n_words, r.n_hit) for r in contamination(docs, bench).collect())
    assert got == [(-1, 2, 2), (1, 1, 0), (1, 2, 0)]
    assert contamination(docs, bench.limit(0)).where("contaminated").count() == 0
    assert contamination(docs.limit(0), bench).count() == 0
    assert drop_contaminated(docs, bench).count() == 3


def test_index_holds_every_word(spark):
    docs = spark.createDataFrame([(1, "red x x blue"), (2, "Blue-red"), (3, None), (None, "red")], "doc_id long, text string")
    index = positional_index(docs)
    names = {r.t: r.w for r in spark.createDataFrame([("red",), ("x",), ("blue",), ("",)], "w string").selectExpr("w", "xxhash64(w) as t").collect()}
    got = {(r.doc_id, names[r.term], r.pos) for r in index.collect()}
    assert got == {(1, "red", 0), (1, "x", 1), (1, "x", 2), (1, "blue", 3), (1, "", 4), (2, "blue", 0), (2, "red", 1), (2, "", 2), (3, "", 0), (None, "red", 0), (None, "", 1)}


def near(docs, queries, span):
    """Brute force: positions of the rarest term with all others within the span."""
    texts = [(d, words(t)) for d, t in docs]
    out = set()
    for q, terms in queries:
        rank = sorted((sum(w.count(t) for _, w in texts), t) for t in set(terms))
        if not rank or not rank[0][0]:
            continue
        for d, w in texts:
            out |= {(d, q, p) for p, x in enumerate(w) if x == rank[0][1] and all(t in w[max(p - span, 0) : p + span + 1] for _, t in rank[1:])}
    return out


def test_proximity_against_brute_force(spark):
    rng = random.Random(6)
    docs = [(k, " ".join(rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(rng.choice([0, 3, 40, 90])))) for k in range(40)] + [(None, "a b c"), (90, None)]
    queries = [(k, rng.sample(["a", "bb", "c", "dd", "e", "ff", "hh", "zz"], rng.randint(1, 4))) for k in range(12)] + [(20, []), (21, ["a", "a"]), (22, ["a", "aa"])]
    index = positional_index(spark.createDataFrame(docs, "doc_id long, text string"))
    q = spark.createDataFrame(queries, "query_id long, terms array<string>")
    for span in (0, 1, 5):
        got = [(r.doc_id, r.query_id, r.pos) for r in proximity_matches(index, q, span).collect()]
        assert len(got) == len(set(got)) and set(got) == near(docs, queries, span)


def test_long_texts_and_ties_of_frequency(spark):
    body = ["w%d" % (k % 50) for k in range(40_000)]
    item = "w7 w8 w9 w10 w11 w12 w13 w14 w15 w16 w17"
    docs = [(1, " ".join(body)), (2, " ".join(body[::-1])), (3, item)]
    bench = [(1, item), (2, "w3 w4")]
    got = {r.doc_id: r for r in contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()}
    for d, (n, hit, ids) in brute(docs, bench).items():
        assert (got[d].n_words, got[d].n_hit, got[d].n_items) == (n, hit, ids)


def test_columns_of_any_name_stay(spark):
    docs = spark.createDataFrame([(1, "rare pair", 5, 6, 7), (2, "fine", 5, 6, 7)], "doc_id long, text string, _H long, _bad long, term long")
    kept = drop_contaminated(docs, spark.createDataFrame(ITEMS, "item_id long, text string"))
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(2, "fine", 5, 6, 7)]
