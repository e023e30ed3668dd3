import os
import random

import pytest

from stemweave.llm import token_counts as T

P = pytest.importorskip("public_tokenizers")
PATH = P.path("word_bpe_49k.json")
TEXTS = ["", "a", "<|endoftext|>", "x<|endoftext|>y <|startoftext|>", "don't 'sun !!'s x's", "a\x1cb", "a\x85b", "ΑΣ ΟΣ", "İstanbul", "é é", "漢字かな 12½", "😀😀", " x　y", "a" * 5000, "abcdé" * 1500, "théatre" * 40, "word " * 9000, "<|endoftext|><|endoftext"]


def fuzz(n):
    rng = random.Random(1)
    letters = "aB'sr tdmvel\n\té́ß漢1２½_-.!😀Σς\x1c <|endoftext|>"
    return ["".join(rng.choice(letters) for _ in range(rng.randint(1, 80))) for _ in range(n)]


def library(texts):
    t = pytest.importorskip("tokenizers").Tokenizer.from_file(PATH)
    return [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]


def mapped(t, text, chunk):
    edges = t.cuts(text, chunk)
    maps = [t.load(t.dump(t.state_map(text[a:b]))) for a, b in zip(edges, edges[1:])]
    return t.total(t.scan(maps)[-1]) if maps else 0


def test_counts_are_the_librarys():
    t, texts = T.transducer(PATH), TEXTS + fuzz(3000)
    want = library(texts)
    assert t.counts(texts).tolist() == want
    for chunk in (16_384, 7, 1):
        some = range(len(texts)) if chunk > 1 else range(0, len(texts), 10)
        assert [mapped(t, texts[i], chunk) for i in some] == [want[i] for i in some]


def test_states_agree_with_merges_run_on_prefixes():
    """The last token that a state stands for, against the merges themselves on every prefix of random words."""
    t, rng = T.transducer(PATH), random.Random(3)

    def merged(parts):
        while True:
            ranks = [t.rank.get(p, 1 << 60) for p in zip(parts, parts[1:])]
            if not ranks or min(ranks) == 1 << 60:
                return parts
            i = ranks.index(min(ranks))
            parts = [*parts[:i], parts[i] + parts[i + 1], *parts[i + 2 :]]

    for _ in range(400):
        word = "".join(rng.choice("abcdeilnorst" if rng.random() < 0.7 else "aaabé漢-!") for _ in range(rng.randint(1, 14))).encode()
        letters = [t.letters[b] for b in word]
        for n in range(1, len(word)):
            state, total = t.advance(0, word[:n])
            want = merged(letters[:n])
            ending, places = t.keys[state]
            assert total == len(want) and places[-1][0] == want[-1] and "".join(letters[:n]).endswith(ending)
        state, total = t.advance(0, word[:-1])
        assert total + t.end(state, word[-1]) == len(merged([*letters[:-1], letters[-1] + t.ends[0][1:]]))


def test_a_compiled_path_compiles_nothing(monkeypatch):
    t, texts = T.transducer(PATH), fuzz(200)
    want = t.counts(texts).tolist()

    def never(*_):
        raise AssertionError("a transition was compiled twice")

    for name in ("_step", "_finish", "_ending", "_crossed", "fits"):
        monkeypatch.setattr(t, name, never)
    assert t.counts(texts).tolist() == want


def test_maps_act_as_texts_do_and_compose_associatively():
    t = T.transducer(PATH)
    chunks = ["ab", "c d", "", "e", " f g", "h", "!!", "?a", "12", "é", "x" * 300, " "]
    maps = [t.state_map(c) for c in chunks]
    entries = [None, t.state_map(" ab").tail, t.state_map(" !").tail, t.state_map(" thea").tail]
    for x in maps:
        for y in maps:
            for e in entries:
                n, mid = t.apply(x, e)
                m, out = t.apply(y, mid)
                assert t.apply(t.compose(x, y), e) == (n + m, out)
            for z in maps[:6]:
                assert t.compose(t.compose(x, y), z) == t.compose(x, t.compose(y, z))
    left = maps[0]
    for i, m in enumerate(t.scan(maps)):
        left = left if i == 0 else t.compose(left, maps[i])
        assert m == left


def test_cuts_keep_normalisation_contractions_and_special_strings_whole():
    t, rng = T.transducer(PATH), random.Random(5)
    for text in ["e\u0301" * 50, "각" * 40, "don't " * 30, "<|endoftext|>" * 20, "a" * 70, "漢" * 70]:
        edges = t.cuts(text, 5)
        assert edges[0] == 0 and edges[-1] == len(text) and edges == sorted(set(edges))
        assert mapped(t, text, rng.randint(1, 9)) == library([text])[0]


def test_a_full_table_starts_anew(monkeypatch):
    monkeypatch.setattr(T, "STATES", 50)
    t, texts = T.CountTransducer(T.json.load(open(PATH, encoding="utf-8"))), fuzz(300)
    assert [int(t.counts([x])[0]) for x in texts] == library(texts) and len(t.keys) < 2000


def test_frame(spark):
    texts = [*TEXTS, None, TEXTS[13]]
    df = spark.createDataFrame([(i if i != 3 else None, t, 0) for i, t in enumerate(texts)] + [(13, TEXTS[13], 0)], "doc_id long, text string, n_tokens int")
    want = sorted((i if i != 3 else -1, n, len((texts[i] or "").encode()), n > 2048) for i, n in enumerate(library([t or "" for t in texts])))
    want = sorted([*want, next(w for w in want if w[0] == 13)])
    for chunk, long in ((T.CHUNK, T.LONG), (100, 400)):
        rows = T.token_counts(df, PATH, chunk=chunk, long=long).collect()
        assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.n_bytes, r.over_limit) for r in rows) == want
    assert T.token_counts(df.limit(0), PATH).count() == 0


def test_offsets_are_counts_of_prefixes(spark):
    text = " ".join(f"word{k} runs" for k in range(400))
    df = spark.createDataFrame([(1, text), (2, "")], "doc_id long, text string")
    rows = T.token_offsets(df, PATH, chunk=500).orderBy("at").collect()
    assert len(rows) > 5 and rows[0].at == rows[0].tokens_before == 0
    for r in rows[1:]:  # the word that is open at a cut counts as far as it goes
        whole = text[: r.at].rsplit(" ", 1)[0]
        assert 0 <= r.tokens_before - library([whole])[0] <= 4


def test_maps_of_the_given_texts_are_composed(monkeypatch):
    """The driver's documents of more than a chunk go through state maps and their scan, in the production setting."""
    import pyarrow.dataset as ds

    place = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(place):
        pytest.skip("no tables")
    texts = sorted((x or "" for x in ds.dataset(place).to_table(columns=["text"])["text"].to_pylist()), key=len)[-120:]
    t, composed = T.transducer(PATH), []
    real = t.compose
    monkeypatch.setattr(t, "compose", lambda x, y: composed.append(1) or real(x, y))
    assert t.counts(texts).tolist() == library(texts)
    assert len(composed) >= sum(len(x) > 2 * T.CHUNK for x in texts) > 0


def test_chunks_in_a_batch_have_the_maps_they_have_alone():
    t, rng = T.transducer(PATH), random.Random(9)
    texts = [x for x in TEXTS + fuzz(300) if x]
    chunks = [x[a:b] for x in texts for e in [t.cuts(x, rng.randint(1, 40))] for a, b in zip(e, e[1:])] + ["", "\n", "1", "a1", "1a"]
    assert t.state_maps(chunks) == [t.state_map(c) for c in chunks]
