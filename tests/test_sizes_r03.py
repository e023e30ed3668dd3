"""Steps whose rows or shuffles must not grow faster than their input, with the results they give."""

from pyspark.sql import functions as F

from stemweave.operators import audits, curation, generation, graph
from stemweave.plans import catalogue


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def pools(spark):
    rows = [("g", s, f"{t} {i}", t, 1 + i) for s in ("pre", "post") for t in ("a", "b") for i in range(3)]
    return spark.createDataFrame(rows, "gate string, slot string, word string, tag string, weight int")


def test_repeats_gather_each_name_once(spark):
    senses = spark.createDataFrame([("old", r, "l1" if r else "l0", f"f{r}", "g", "t") for r in range(50)] + [("new", 60, "l0", "x", "h", "t")], "usage string, rank long, language string, form string, gloss string, tag string")
    names = spark.createDataFrame([(1, 1, "old", "pre"), (1, 2, "old", "pre"), (1, 3, "old", "pre"), (2, 1, "new", "pre"), (2, 2, "none", "pre"), (None, 1, "new", "pre")], "id long, slot long, usage string, position string")
    out = generation.diversified(names, "id", "slot", "usage", "position", senses)
    assert exchanges(out) <= 1
    assert sorted((r.id, r.slot, r.final) for r in out.collect()) == [(1, 1, "old"), (1, 2, "f1"), (1, 3, "f1"), (2, 1, "new"), (2, 2, "none")]


def test_first_unused_looks_up_one_word_more_than_are_used(spark):
    used = spark.createDataFrame([(1, "b", "a"), (1, "b", "c"), (1, "d", "b"), (2, "d", "b"), (3, "none", "z")], "id long, g string, w string")
    pool = spark.createDataFrame([("b", x) for x in "abcxyz"] + [("d", "b"), (None, "a")], "g string, w string")
    assert [tuple(r) for r in generation.first_unused(used, "id", "g", "w", pool).collect()] == [(1, "x")]


def test_marks_go_down_without_pairs(spark):
    n = 300  # every node is below all smaller ones: n * n / 2 pairs
    nodes = spark.range(n).select("id", F.when(F.col("id") % 100 == 7, "latin").when(F.col("id") == 0, "irish").otherwise("welsh").alias("lang"))
    edges = nodes.select(F.col("id").alias("p")).join(nodes.select(F.col("id").alias("c")), F.expr("p < c"))
    got = graph.inherited_marks(nodes.where("lang <> 'welsh'"), edges, "id", "lang", "p", "c")
    assert got.where("lang = 'latin'").count() == n - 8 and got.where("lang = 'irish'").count() == n - 1
    # on a circle a node's own mark counts only if another node has it too
    ring = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "p long, c long")
    marked = lambda rows: graph.inherited_marks(spark.createDataFrame(rows, "id long, m string"), ring, "id", "m", "p", "c")
    assert sorted(r.id for r in marked([(1, "x")]).collect()) == [2, 3]
    assert sorted(r.id for r in marked([(1, "x"), (2, "x")]).collect()) == [1, 2, 3]
    fam = [curation.Family("w", "welsh", [("loan", ["welsh"])], {}, "native")]
    one = spark.createDataFrame([(1, "welsh"), (2, "x"), (3, "x")], "id long, lang string")
    assert [r.stratum for r in curation.classify_families(one, "id", "lang", ring, "p", "c", fam).collect()] == ["native"]


def test_small_pools_leave_requests_where_they_are(spark):
    picks = spark.range(200).select("id", F.lit("g").alias("gate"), F.array(F.lit("pre"), F.lit("post")).alias("slots"))
    out = generation.fill_slots(picks, "id", "gate", "slots", pools(spark), "slot", "word", "tag", "weight", 3)
    assert exchanges(out) == 0 and out.count() == 200
    drawn = generation.pick_structures(picks.drop("slots"), "id", "gate", spark.createDataFrame([("s", 1), ("t", 2)], "s string, w int"), "s", "w", spark.createDataFrame([("g", "t")], "gate string, s string"), 1)
    assert exchanges(drawn) == 0 and {(r.s, r.permissive) for r in drawn.collect()} == {("t", False)}


def test_pools_are_summed_without_sorting(spark):
    rows = pools(spark)
    plan = generation.slot_pools(rows, "gate", "slot", "word", "tag", "weight")._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate(keys=[gate" in plan.split("Scan")[0].rsplit("Exchange", 1)[1].replace("SortAggregate", "-")


def test_grids_are_not_shuffled(spark):
    parts = spark.createDataFrame([(i, s, "e", "u") for i in range(5) for s in range(2)], "id long, slot long, entity string, usage string")
    variants = spark.createDataFrame([("e", "v", 1)], "entity string, form string, weight int")
    inflections = spark.createDataFrame([("e", "i", "l")], "entity string, form string, label string")
    grid = spark.createDataFrame([("e", "f", 1, "x", "form", "src")], "entity string, family string, stage int, language string, form string, source string")
    out = generation.rendered_names(parts, "id", "slot", "entity", "usage", variants, inflections, grid, ["f"], 1, 0.5, 0.5)
    assert exchanges(out) == 1 and out.count() == 5


def test_a_negative_mean_keeps_its_sign_when_rounded_to_zero(spark, tmp_path):
    spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [-1e-7, 1.0], 0)], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = catalogue.QUERIES["t31_bucket_mates"](spark, str(tmp_path)).collect()
    assert [str(r[c]) for r in got for c in ("least", "mean", "greatest")] == ["-0.0"] * 6


def test_variants_meet_by_form_and_gloss_not_entry_by_entry(spark):
    n = 3000  # of one form and gloss each: n * n pairs of entries
    nodes = spark.range(2 * n).select("id", F.lit("l").alias("language"), F.when(F.col("id") < n, "a").otherwise("b").alias("form"), F.lit(None).cast("int").alias("merged"))
    variants = spark.range(n, 2 * n).select("id", F.lit("a").alias("form"), F.lit("c").alias("variant_class"))
    out = audits.variant_collapses(nodes, variants, nodes.select("id", F.concat(F.lit(" G"), (F.col("id") % 1).cast("string")).alias("gloss")))
    assert [tuple(r) for r in out.collect()] == [("l:a", "l:b", "c")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert any("Join Inner" in x and x.count("_g#") == 2 for x in plan.splitlines())
