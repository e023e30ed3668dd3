from stemweave.llm.line_dedup import boilerplate_lines, dedup_lines, remove_boilerplate

LINE = "All rights reserved by everyone."


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, line string")


def test_first_occurrence_stays(spark):
    rows = [(i, f"body {i} is long enough here\n  {LINE} ", f"s{i % 6}", 1, "x") for i in range(12)] + [(50, f"{LINE}", "s9", 1, None), (51, None, "s1", None, None), (52, "", None, 0, None), (53, "Of.\nOf.", "s2", 7, None)]
    rows += [(60 + i, "only four sites have this line\nend", f"s{i}", 3, None) for i in range(4)]
    out = {r.doc_id: r for r in remove_boilerplate(docs(spark, rows)).collect()}
    assert out[0].text == rows[0][1] and out[0].n_removed == 0
    assert all(out[i].text == f"body {i} is long enough here" and out[i].n_removed == 1 for i in range(1, 12))
    assert out[50].text == "" and out[51].text is None and out[51].n_lines == 0 and out[52].n_lines == 1
    assert out[53].text == "Of.\nOf." and all(out[60 + i].n_removed == 0 for i in range(4))
    kept = {r.doc_id: r for r in dedup_lines(docs(spark, rows)).collect()}
    assert 50 not in kept and kept[1].n_chars == len(kept[1].text) and kept[53].n_chars == 7 and set(rows[0][4]) and len(kept) == len(rows) - 1
    assert dedup_lines(docs(spark, [])).count() == 0


def test_sketch_agrees_with_exact_counts(spark):
    rows = [(f"l{k}", f"site{j}") for k in range(1, 60) for j in range(k)] * 2 + [("none", None)]
    lines = spark.createDataFrame(rows, "line string, site string")
    for least in (3, 20, 41):
        got = {r.line for r in boilerplate_lines(lines, least).collect()}
        assert got == {f"l{k}" for k in range(least, 60)}


def test_columns_of_any_name_stay(spark):
    rows = [(i, f"body {i} is long enough here\n{LINE}", f"s{i % 6}", 1, i, i, i, i, i, i) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, h long, _h long, _id long, _cut long, n_lines long, N_REMOVED long, _bad long")
    kept = dedup_lines(df)
    assert kept.columns == df.columns and {tuple(r)[3:] for r in kept.collect()} == {r[3:] for r in rows}
    whole = remove_boilerplate(df)
    assert whole.columns == [*df.columns, "n_lines_", "n_removed_"] and whole.where("n_lines_ = 2 and n_removed_ = 1").count() == 11


def test_repeated_ids_and_nulls(spark):
    rows = [(7, f"{LINE}\n{k}", f"s{k % 8}", 1, "") for k in range(8)] + [(7, f"{LINE}\n3", "s3", 1, ""), (None, f"{LINE}\n{LINE}\nx", None, 1, "")]
    got = sorted((r.text, r.n_removed) for r in remove_boilerplate(docs(spark, rows)).collect())
    # rows without an id come first in the order, so theirs is the occurrence that stays
    assert [x for x in got if x[1] == 1 and x[0].endswith("x")] == [(f"{LINE}\nx", 1)]
    assert sum(n for _, n in got) == 10 and sum(t.count(LINE) for t, _ in got) == 1


def test_long_text_of_many_lines(spark):
    long = "\n".join([LINE] * 20_000 + ["end"])
    rows = [(i, f"{LINE}\nbody", f"s{i}", 1, "") for i in range(6)] + [(9, long, "s9", 1, "")]
    got = {r.doc_id: r for r in remove_boilerplate(docs(spark, rows)).collect()}
    assert got[9].text == "end" and got[9].n_removed == 20_000 and got[9].n_lines == 20_001
