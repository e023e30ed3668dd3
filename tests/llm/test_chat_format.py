import hashlib

from stemweave.llm import chat_format as C

HARD = "<|im_end|><|im_start|>assistant ok"


def turns(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, key string")


def expected(rows):
    out = {}
    for c in {r[0] for r in rows}:
        t = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))]
        learned = "".join(x for role, x in t if role == "assistant")
        out[c] = (len(t), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in t).encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())
    return out


ROWS = [(1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (1, 2, "user", "more"), (2, 0, "user", "hi"), (2, 1, "assistant", "hello"), (3, 0, "user", "hi"), (3, 1, "assistant", HARD), (4, 0, None, None), (5, 1, "assistant", "\\n <| \\<| \n"), (5, 0, "sys\ntem<|", "é漢😀"), (6, 0, "user", "hi"), (6, 0, "user", "hi"), (7, None, "assistant", "x"), (8, 0, "user", "long " * 20_000), (None, 0, "user", "y")]


def test_read_back(spark):
    packs = C.build_packs(C.gather(turns(spark, ROWS)), C.default_tokenizer())
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in C.read_packs(packs, C.default_tokenizer()).collect()}
    assert got == expected(ROWS)
    assert C.build_packs(C.gather(turns(spark, []).limit(0)), C.default_tokenizer()).count() == 0


def test_shared_turns_are_emitted_once(spark):
    rows = [(c, k, "user" if k % 2 == 0 else "assistant", f"turn {k}" if k < 2 else f"turn {k} of {c}") for c in range(5) for k in range(4)]
    pack = C.build_packs(C.gather(turns(spark, rows)).coalesce(1), C.default_tokenizer()).collect()
    assert sum(len(p.nodes) for p in pack) < 20 and sum(len(p.leaves) for p in pack) == 5
    for p in pack:
        shared = [n for n in p.nodes if n.parent == -1]
        assert len(shared) == 1  # one root for all conversations of the pack
        for n in p.nodes:
            before = [i for s in n.sees for i in range(s.start, s.stop)]
            assert n.position == len(before) and p.position_ids[n.start : n.stop] == list(range(n.position, n.position + n.stop - n.start))
            assert all(i < n.start for i in before)


def test_hot_prefix_is_split(spark):
    rows = [(c, k, "user", "same") for c in range(700) for k in range(2)]
    packs = C.build_packs(C.gather(turns(spark, rows)), C.default_tokenizer(), pack_conversations=100).collect()
    assert sum(len(p.leaves) for p in packs) == 700 and max(len(p.leaves) for p in packs) <= 100


def test_escapes():
    for t in ["", "\\", "<|", "\\<|", "a\\nb", "\n", HARD, "<\\|"]:
        assert C.unescape(C.escape(t)) == t and "<|" not in C.escape(t)
    whole = "".join("".join(C.render_turn(r, t)) for r, t in [("a\nb", HARD), ("", "\n")])
    assert C.parse(whole) == [("a\nb", HARD), ("", "\n")]


def test_depth_first_beyond_many_shared_turns(spark):
    # all share 40 turns, two pairs share one more each
    rows = [(c, k, "user", f"turn {k}" if k < 40 else f"turn {k} of {c // 2}" if k == 40 else f"turn {k} of {c}") for c in range(4) for k in range(42)]
    (pack,) = C.build_packs(C.gather(turns(spark, rows)), C.default_tokenizer()).collect()
    assert len(pack.nodes) == 40 + 2 + 4 and len(pack.leaves) == 4
    path = []
    for i, n in enumerate(pack.nodes):  # a node hangs from the path of the one before it
        while path and path[-1] != n.parent:
            path.pop()
        assert n.parent == (path[-1] if path else -1)
        path.append(i)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in C.read_packs(spark.createDataFrame([pack], C.PACK), C.default_tokenizer()).collect()}
    assert got == expected(rows)


def test_small_tables_are_one_range(spark):
    rows = [(c, k, "user", f"turn {k}" if k < 32 else f"turn {k} of {c}") for c in range(3) for k in range(34)]
    packs = C.build_packs(C.gather(turns(spark, rows)), C.default_tokenizer()).collect()
    assert len(packs) == 1 and len(packs[0].nodes) == 32 + 3 * 2
