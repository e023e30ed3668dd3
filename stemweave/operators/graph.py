"""Graph and hierarchy operators.  Loops are rounds of joins; every few rounds the state is written to the
shared folder, and only counts come to the driver."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only a local session may do without it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        have = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = have.get() if have.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="stemweave-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new place for an intermediate table below the shared folder, in a folder of this application's own."""
    return f"{shared_dir(spark)}/stemweave/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application; call it when no result that was built on them is needed any more."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/stemweave/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    path = scratch(df.sparkSession, "round")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_with(df: DataFrame, *measures: Column) -> tuple[DataFrame, dict]:
    """``stored(df)`` and aggregates over it, which the write itself gathers."""
    seen = Observation()
    out = stored(df.observe(seen, *measures))
    return out, seen.get


def sent(df: DataFrame) -> DataFrame:
    """``df``, which what it is joined to meets by a shuffle.  Spark broadcasts a table whose files are small, and where many rounds do so with numbers that compress well the driver
    is sent many times the bytes of the files."""
    return df.hint("merge")


BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20


def stored_few(df: DataFrame) -> DataFrame:
    """``stored(df)``, broadcast to what it is joined to if the rows and bytes that the write counted are few; else the join is left to Spark."""
    size = F.sum(F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))
    out, seen = stored_with(df, F.count("*").alias("n"), size.alias("bytes"))
    return F.broadcast(out) if seen["n"] <= BROADCAST_ROWS and (seen["bytes"] or 0) <= BROADCAST_BYTES else out


def two_step_root(nodes: DataFrame, ident: str, merged: str, lemma: str) -> DataFrame:
    """``(id, root)``: the target is merged-into, else lemma, else the node; the root is the target's lemma, else the target."""
    target = F.coalesce(F.col(merged), F.col(lemma), F.col(ident))
    t = nodes.select(F.col(ident).alias("_t"), F.col(lemma).alias("_l"))
    return nodes.select(ident, target.alias("_t")).join(t, "_t", "left").select(ident, F.coalesce("_l", "_t").alias("root"))


def _doubled(state: DataFrame, ended: str) -> tuple[DataFrame, DataFrame | None]:
    """``state(id, to, ended)`` with each pointer as far as it goes, and the rows of those that never end (or None); pointers double each round.

    The nodes of a chain end nearest first, so a round in which no node ends leaves those alone that are on a cycle or behind one.
    Both sides are of the size of the table, so they meet by a shuffle (``sent``), not by way of the driver.
    """
    done, open_ = [state.where(ended)], state.where(~F.col(ended))
    while True:
        hop = state.select(F.col("id").alias("to"), F.col("to").alias("_further"), F.col(ended).alias("_end"))
        moved = open_.drop(ended).join(sent(hop), "to").select("id", F.col("_further").alias("to"), F.col("_end").alias(ended))
        moved, seen = stored_with(moved, F.count_if(F.col(ended)).alias("new"), F.count("*").alias("n"))
        if not seen["n"]:
            return reduce(DataFrame.unionByName, done), None
        if not seen["new"]:
            return reduce(DataFrame.unionByName, done), open_
        done, open_ = [*done, moved.where(ended)], moved.where(~F.col(ended))
        state = stored(reduce(DataFrame.unionByName, [*done, open_]))
        done, open_ = [state.where(ended)], state.where(~F.col(ended))


def chain_ends(nodes: DataFrame, ident: str, pointer: str) -> DataFrame:
    """``(id, terminal, entry)``: where the pointers of each node lead.  A chain ends at a node without a pointer, at one that points to itself or at an id that is not in the
    table, its ``terminal``; one that runs into a cycle has none, but an ``entry``: the first node of the cycle on its way.
    """
    here = nodes.select(F.col(ident).alias("id"), F.coalesce(pointer, ident).alias("to"))
    known = nodes.select(F.col(ident).alias("to"), F.lit(True).alias("_in")).distinct()
    state = stored(here.join(sent(known), "to", "left").select("id", "to", ((F.col("id") == F.col("to")) | F.col("_in").isNull()).alias("_end")))
    done, left = _doubled(state, "_end")
    ends = done.select("id", F.col("to").alias("terminal"), F.lit(None).cast(here.schema["id"].dataType).alias("entry"))
    if left is None:
        return ends.withColumnRenamed("id", ident)
    # as many steps as there are nodes lead from every node onto its cycle, and from the nodes of a cycle to all of them
    jump = stored(state.join(sent(left.select("id")), "id", "left_semi").select("id", "to"))
    steps, n = 1, jump.count()
    first = jump
    while steps < n:
        jump = stored(jump.join(sent(jump.select(F.col("id").alias("to"), F.col("to").alias("_further"))), "to").select("id", F.col("_further").alias("to")))
        steps *= 2
    cycle = stored(jump.select(F.col("to").alias("id")).distinct().withColumn("_on", F.lit(True)))
    entered = first.join(sent(cycle), "id", "left").select("id", F.when(F.col("_on"), F.col("id")).otherwise(F.col("to")).alias("to"), F.coalesce("_on", F.lit(False)).alias("_end"))
    onto = entered.join(sent(cycle.withColumnsRenamed({"id": "to", "_on": "_to_on"})), "to", "left").select("id", "to", (F.col("_end") | F.coalesce("_to_on", F.lit(False))).alias("_end"))
    found, _ = _doubled(stored(onto), "_end")
    return ends.unionByName(found.select("id", F.lit(None).cast(here.schema["to"].dataType).alias("terminal"), F.col("to").alias("entry"))).withColumnRenamed("id", ident)


def flatten_chains(nodes: DataFrame, ident: str, pointer: str) -> DataFrame:
    """``(id, terminal, cyclic)``: pointer doubling to the end of each chain; nodes on or behind a cycle are marked and keep their own id."""
    ends = chain_ends(nodes, ident, pointer)
    return ends.select(ident, F.coalesce("terminal", ident).alias("terminal"), F.col("entry").isNotNull().alias("cyclic"))


HUBS = 10_000
FEW = 10_000


def _with_hubs(rows: DataFrame, groups: DataFrame, total: int, most: int) -> DataFrame:
    """``rows(x, ...)`` joined to the written ``groups(x, m, c)``, where ``c`` are the rows of each x among ``total``, ``most`` at most.

    A node with more than ``total / HUBS`` edges is a hub; there are fewer than ``HUBS`` of them, so they are broadcast and
    their edges stay where they are.  The others meet by a shuffle, and all do in a small graph (``FEW`` edges a node at most).
    """
    if most <= FEW or most * HUBS <= total:
        return rows.join(groups.drop("c"), "x")
    hub = F.col("c") * HUBS > total
    hubs, rest = F.broadcast(groups.where(hub).drop("c")), groups.where(~hub).drop("c")
    return rows.join(hubs, "x").unionByName(rows.join(hubs.select("x"), "x", "left_anti").join(rest, "x"))


def min_label_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, component)``: the smallest node reachable over undirected edges, by contraction.

    In a round every node picks the first by hash of those that its edges lead to (itself, if it comes before them and is led to), edges then run between picks, and those inside one pick
    are gone; so nodes that are done with leave the rounds, and a new hash a round leaves a part of the others at most.  The first round follows the edges to the side of fewer nodes, later
    ones from the later node to the earlier, where picks of picks are taken at once.  Then the least node of each pick goes up the rounds and its name down again.
    """
    e, seen = stored_with(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y"), F.count("*").alias("n"), F.approx_count_distinct("x").alias("x"), F.approx_count_distinct("y").alias("y"))
    if seen["x"] < seen["y"]:
        e = e.select(F.col("y").alias("x"), F.col("x").alias("y"))
    rounds, n = [], seen["n"]
    while n:
        place = lambda c, k=len(rounds): F.xxhash64(c, F.lit(k))
        both = e.withColumn("_out", F.lit(True)).unionByName(e.select(F.col("y").alias("x"), F.col("x").alias("y"), F.lit(False).alias("_out")))
        first = both.groupBy("x").agg(F.min_by(F.when(F.col("_out"), F.col("y")), F.when(F.col("_out"), place("y"))).alias("_y"), F.bool_and("_out").alias("_only"), F.count("*").alias("c"))
        pick = F.when(F.col("_only") | (F.col("_y").isNotNull() & (place("_y") < place("x"))), F.col("_y")).otherwise(F.col("x"))
        low, top = stored_with(first.select("x", pick.alias("m"), "c"), F.max("c").alias("c"))
        if rounds:
            # as many nodes as a node has edges pick it at most
            low = stored(_with_hubs(low.select(F.col("m").alias("x"), F.col("x").alias("_x"), F.col("c").alias("_c")), low, 2 * n, top["c"]).select(F.col("_x").alias("x"), "m", F.col("_c").alias("c")))
        half = _with_hubs(e, low, 2 * n, top["c"]).select(F.col("y").alias("x"), F.col("m").alias("_m"))
        after = lambda c, k=len(rounds) + 1: F.xxhash64(c, F.lit(k))
        new = _with_hubs(half, low, 2 * n, top["c"]).where("_m <> m").select(F.when(after("_m") > after("m"), F.struct(F.col("_m").alias("x"), F.col("m").alias("y"))).otherwise(F.struct(F.col("m").alias("x"), F.col("_m").alias("y"))).alias("e")).select("e.*")
        # few edges of the first round fall together
        e, now = stored_with(new.distinct() if rounds else new, F.count("*").alias("n"))
        rounds.append(low.select("x", "m"))
        n = now["n"]
    if not rounds:
        return e.select(F.col("x").alias("node"), F.col("y").alias("component"))
    least, picks = None, []
    for low in rounds:
        known = low.withColumn("least", F.col("x")) if least is None else low.join(least.select(F.col("m").alias("x"), "least"), "x")
        least, seen = stored_with(known.groupBy("m").agg(F.min("least").alias("least"), F.count("*").alias("c")), F.sum("c").alias("n"), F.max("c").alias("c"))
        picks.append((least, seen))
    named = None
    for low, (least, seen) in zip(reversed(rounds), reversed(picks)):
        here = least.select(F.col("m").alias("x"), F.col("least").alias("m"), "c")
        if named is not None:
            here = stored(here.join(stored(named).withColumnsRenamed({"node": "x"}), "x", "left").select("x", F.coalesce("component", "m").alias("m"), "c"))
        named = _with_hubs(low.select(F.col("m").alias("x"), F.col("x").alias("node")), here, seen["n"], seen["c"]).select("node", F.col("m").alias("component"))
    return named


COMPACT = 8


class _Growing:
    """A table that grows by stored parts; every few parts it is written as one."""

    def __init__(self, first: DataFrame, fold=lambda df: df):
        self.parts, self.fold = [first], fold

    def table(self) -> DataFrame:
        return self.fold(reduce(DataFrame.unionByName, self.parts))

    def add(self, part: DataFrame):
        self.parts.append(part)
        if len(self.parts) > COMPACT:
            self.parts = [stored(self.table())]


def smallest_reaching_root(edges: DataFrame, parent: str, child: str) -> DataFrame:
    """``(node, root)``: over directed edges, the smallest root (a parent that is never a child) that reaches each node.

    Only nodes whose root moved in a round offer it in the next one; rounds go on until none moves.
    Nodes that no root reaches (pure cycles and what hangs from them) keep a null root.
    """
    e = stored(edges.select(F.col(parent).alias("p"), F.col(child).alias("c")).where("p <> c").distinct())
    children = e.select(F.col("c").alias("node")).distinct()
    moved = stored(e.select(F.col("p").alias("node")).distinct().join(children, "node", "left_anti").withColumn("root", F.col("node")))
    state = _Growing(moved, lambda df: df.groupBy("node").agg(F.min("root").alias("root")))
    while True:
        offered = e.join(moved.withColumnRenamed("node", "p"), "p").groupBy(F.col("c").alias("node")).agg(F.min("root").alias("root"))
        known = state.table().withColumnRenamed("root", "was")
        moved, seen = stored_with(offered.join(known, "node", "left").where("was is null or root < was").select("node", "root"), F.count("*").alias("n"))
        if not seen["n"]:
            break
        state.add(moved)
    found = state.table()
    return found.unionByName(children.join(found, "node", "left_anti").withColumn("root", F.lit(None).cast(found.schema["root"].dataType)))


def _jumps(up: DataFrame) -> list[DataFrame] | None:
    """``up(node, _p)``, then tables of two, four, eight ... steps up, where every node has one parent at most and none is its own ancestor; else None."""
    one, seen = stored_with(up.groupBy("node").agg(F.min("_p").alias("_p"), F.max("_p").alias("_q")), F.count_if(F.col("_p") != F.col("_q")).alias("several"), F.count("*").alias("n"))
    if seen["several"]:
        return None
    found, n = [one.drop("_q")], seen["n"]
    while n:
        # a way of more steps than there are nodes with a parent goes round
        if 1 << (len(found) - 1) > seen["n"]:
            return None
        jump, now = stored_with(found[-1].select("node", F.col("_p").alias("_m")).join(found[-1].select(F.col("node").alias("_m"), "_p"), "_m").select("node", "_p"), F.count("*").alias("n"))
        n = now["n"]
        found.append(jump)
    return found[:-1]


def ancestors(seeds: DataFrame, edges: DataFrame, seed: str, parent: str, child: str) -> DataFrame:
    """``(seed, node, depth)``: every ancestor of each seed with its least depth (the seed itself at 0), however deep.

    In a forest, what is found within n steps gives what is found within 2 n by one join with the steps of length n, so rounds are as many as the depth has binary digits and what is
    found is never looked up.  Else rounds go one step each and leave out what was found before.
    """
    up = edges.select(F.col(child).alias("node"), F.col(parent).alias("_p")).where("_p is not null")
    front = stored(seeds.select(F.col(seed).alias("seed"), F.col(seed).alias("node"), F.lit(0).alias("depth")).distinct())
    jumps = _jumps(up)
    if jumps is not None:
        for k, jump in enumerate(jumps):
            front = front.unionByName(front.join(jump, "node").select("seed", F.col("_p").alias("node"), (F.col("depth") + (1 << k)).alias("depth")))
            front = stored(front) if k < len(jumps) - 1 else front
        return front
    found, depth = _Growing(front), 0
    while True:
        depth += 1
        step = front.join(up, "node").select("seed", F.col("_p").alias("node")).distinct()
        front, seen = stored_with(step.join(found.table(), ["seed", "node"], "left_anti").withColumn("depth", F.lit(depth)), F.count("*").alias("n"))
        if not seen["n"]:
            return found.table()
        found.add(front)


def inherited_marks(marks: DataFrame, edges: DataFrame, node: str, mark: str, parent: str, child: str) -> DataFrame:
    """``(node, mark)``: the marks that a node's ancestors other than itself have, however far up.

    Marks go down edge by edge, each with the node it comes from; a node passes on two sources of a mark at most, which is enough to tell whether another one than a given node
    has it.  So a round's rows are bounded by nodes times marks, never by pairs of a node and an ancestor.
    """
    down = stored(edges.select(F.col(parent).alias("p"), F.col(child).alias("c")).where("p <> c").distinct())
    front = stored(marks.select(F.col(node).alias("node"), F.col(mark).alias("mark")).where("mark is not null").distinct().withColumn("source", F.col("node")))
    found = None
    two = [F.min("source").alias("a"), F.max("source").alias("b")]
    while True:
        offered = down.join(front.withColumnRenamed("node", "p"), "p").groupBy(F.col("c").alias("node"), "mark").agg(*two)
        sources = F.array_distinct(F.array("a", "b"))
        if found is not None:
            known = found.table().groupBy("node", "mark").agg(F.min("source").alias("x"), F.max("source").alias("y"))
            fresh = F.filter(sources, lambda s: s != F.col("x"))
            sources = F.when(F.col("x").isNull(), sources).when(F.col("x") == F.col("y"), F.slice(fresh, 1, 1))
            offered = offered.join(known, ["node", "mark"], "left")
        front, seen = stored_with(offered.select("node", "mark", F.explode(sources).alias("source")), F.count("*").alias("n"))
        if found is None:
            found = _Growing(front)
        elif seen["n"]:
            found.add(front)
        if not seen["n"]:
            return found.table().where("source <> node").select(F.col("node").alias(node), F.col("mark").alias(mark)).distinct()


def classify_by_parents(nodes: DataFrame, edges: DataFrame, ident: str, language: str, parent: str, child: str, kind: str, strata: list[tuple[str, list[str], bool]], loans: list[str]) -> DataFrame:
    """``(id, stratum)``: the first stratum whose languages meet those of the parents one hop up; a stratum
    marked True looks at loan edges only.  Nothing fits: null."""
    up = edges.join(nodes.select(F.col(ident).alias(parent), F.col(language).alias("_pl")), parent)
    langs = up.groupBy(F.col(child).alias(ident)).agg(F.collect_set("_pl").alias("_all"), F.collect_set(F.when(F.col(kind).isin(loans), F.col("_pl"))).alias("_loan"))
    case = F.lit(None).cast("string")
    for name, members, loan_only in reversed(strata):
        case = F.when(F.arrays_overlap(F.col("_loan" if loan_only else "_all"), F.array(*map(F.lit, members))), name).otherwise(case)
    return nodes.select(ident).join(langs, ident, "left").select(ident, case.alias("stratum"))


def partition_fidelity(df: DataFrame, old: str, new: str) -> DataFrame:
    """Old groups whose members fall into several new ones (a join of groups is allowed, a split is not)."""
    return df.groupBy(old).agg(F.count_distinct(new).alias("groups")).where("groups > 1")


def majority_outliers(df: DataFrame, group: str, member: str, sense: str) -> DataFrame:
    """Members whose sense is not their group's dominant one (most members, ties to the first in order)."""
    votes = df.groupBy(group, sense).agg(F.count("*").alias("n"))
    top = votes.withColumn("k", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), sense))).where("k = 1").select(group, F.col(sense).alias("dominant"))
    return df.join(top, group).where(F.col(sense) != F.col("dominant")).select(group, member, sense, "dominant")


def fan_out(edges: DataFrame, parent: str, child: str, least: int) -> DataFrame:
    """Parents with ``least`` distinct children or more."""
    return edges.groupBy(parent).agg(F.count_distinct(child).alias("children")).where(F.col("children") >= least)


def project_edges(assertions: DataFrame, keys: list[str], polarity: str, confidence: Column, gate: float) -> DataFrame:
    """Edges affirmed at or above the gate and never refuted at it; ``status`` counts the rest as gated or refuted."""
    ok = confidence >= gate
    g = assertions.groupBy(*keys).agg(F.bool_or((F.col(polarity) == "affirm") & ok).alias("yes"), F.bool_or((F.col(polarity) == "refute") & ok).alias("no"))
    return g.select(*keys, F.when(F.col("no"), "refuted").when(F.col("yes"), "kept").otherwise("gated").alias("status"))


def break_cycles(edges: DataFrame, a: str, b: str, order: str) -> DataFrame:
    """``(a, b, order, kept)``: edges taken in order, where one that closes a cycle (without regard to direction) is dropped.

    What is kept is the spanning forest of least order, so rounds find it without going through the edges one by one: every
    component picks its first edge to another one, and all picks are kept.  Edges of equal order follow one another by
    their ends; of repeated edges the first is kept; a loop never is.
    """
    w = Window.partitionBy("k", "a", "b").orderBy("a")
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b"), F.col(order).alias("k")).withColumn("r", F.row_number().over(w))
    e = stored(e.select("a", "b", F.struct("k", "a", "b", "r").alias("w")))
    label = stored(e.select(F.col("a").alias("node")).union(e.select("b")).distinct().withColumn("c", F.col("node")))
    picks = None
    while True:
        left, right = label.select(F.col("node").alias("a"), F.col("c").alias("ca")), label.select(F.col("node").alias("b"), F.col("c").alias("cb"))
        # an edge inside one component is out for good
        across, seen = stored_with(e.join(left, "a").join(right, "b").where("ca <> cb").select("a", "b", "w", "ca", "cb"), F.count("*").alias("n"))
        if not seen["n"]:
            break
        e = across.select("a", "b", "w")
        first = across.select(F.col("ca").alias("c"), "w").union(across.select("cb", "w")).groupBy("c").agg(F.min("w").alias("w")).select("w").distinct()
        chosen = stored(across.join(first, "w", "left_semi").select("w", "ca", "cb"))
        joined = min_label_components(chosen, "ca", "cb").withColumnsRenamed({"node": "c", "component": "to"})
        label = stored(label.join(joined, "c", "left").select("node", F.coalesce("to", "c").alias("c")))
        picks = chosen.select("w") if picks is None else picks.unionByName(chosen.select("w"))
    every = edges.select(F.col(a).alias("a"), F.col(b).alias("b"), F.col(order).alias("k")).withColumn("r", F.row_number().over(w)).select(F.struct("k", "a", "b", "r").alias("w"))
    if picks is None:
        kept = every.withColumn("kept", F.lit(False))
    else:
        kept = every.join(picks.withColumn("kept", F.lit(True)), "w", "left")
    return kept.select(F.col("w.a").alias(a), F.col("w.b").alias(b), F.col("w.k").alias(order), F.coalesce("kept", F.lit(False)).alias("kept"))


def compound_alignments(breakdowns: DataFrame, place: str, source: str, ordinal: str, part: str, least: int) -> DataFrame:
    """``(composite, parts, support)``: a single element of one breakdown that stands for several of another one of the
    same place, as often as ``least`` places."""
    lists = breakdowns.groupBy(place, source).agg(F.transform(F.sort_array(F.collect_list(F.struct(ordinal, part))), lambda x: x[part]).alias("e"))
    coarse = lists.where("size(e) = 1").select(place, F.col("e")[0].alias("composite")).distinct()
    fine = lists.where("size(e) > 1").select(place, F.array_join("e", "+").alias("parts")).distinct()
    return coarse.join(fine, place).groupBy("composite", "parts").agg(F.count_distinct(place).alias("support")).where(F.col("support") >= least)
