"""Identity of entries: roll-ups over merges, lemmas and curated ancestry, components that keep types apart, projection of statements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import chain_ends, min_label_components, sent, stored


def lemma_roots(nodes: DataFrame, ident: str, merged: str, lemma: str) -> DataFrame:
    """``(id, root)`` in two steps: what a node was merged into, else its lemma, else itself; then the lemma of that, if it has one."""
    target = nodes.select(F.col(ident).alias("id"), F.coalesce(merged, lemma, ident).alias("_t"))
    of = nodes.select(F.col(ident).alias("_t"), F.col(lemma).alias("_l"))
    return target.join(sent(of), "_t", "left").select("id", F.coalesce("_l", "_t").alias("root"))


def oldest_roots(nodes: DataFrame, ident: str, merged: str, lemma: str, content: list[str], edges: DataFrame, parent: str, child: str) -> DataFrame:
    """``(id, root)``: :func:`lemma_roots`, and from there up curated ``edges`` to the oldest ancestor.

    Edges hold between roots; of several parents of a root the one of the least ``content`` (then id) counts, which doesn't depend on how ids were given.  Where
    ancestors run in a circle, the way up stops before it meets a node again: at the one whose parent is the circle's first node on the way.
    """
    roots = stored(lemma_roots(nodes, ident, merged, lemma))
    up = edges.select(F.col(parent).alias("p"), F.col(child).alias("c")).join(sent(roots.select(F.col("id").alias("c"), F.col("root").alias("_c"))), "c").join(sent(roots.select(F.col("id").alias("p"), F.col("root").alias("_p"))), "p")
    up = up.where("_c <> _p").select("_c", "_p").distinct()
    key = nodes.select(F.col(ident).alias("_p"), F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in content]).alias("_k"))
    blank = F.struct(*[F.lit("").alias(c) for c in content])
    chosen = up.join(sent(key), "_p", "left").groupBy(F.col("_c").alias("id")).agg(F.min(F.struct(F.coalesce("_k", blank).alias("k"), "_p")).alias("m")).select("id", F.col("m._p").alias("up"))
    every = roots.select(F.col("root").alias("id")).union(chosen.select("up")).distinct()
    chosen = stored(every.join(sent(chosen), "id", "left"))
    ends = stored(chain_ends(chosen, "id", "up"))
    on = ends.where("entry = id").select("id")
    before = chosen.join(sent(on), "id", "left_semi").select(F.col("up").alias("entry"), F.col("id").alias("_last"))
    tops = ends.join(sent(before), "entry", "left").select(F.col("id").alias("root"), F.coalesce("terminal", "_last").alias("_top"))
    return roots.join(sent(tops), "root").select(F.col("id").alias(ident), F.col("_top").alias("root"))


def hub_roots(legacy: DataFrame, ident: str, root: str, keys: DataFrame, content: list[str], bound: DataFrame, hubs: DataFrame) -> DataFrame:
    """``(id, root)``: families by the hub that a node is ``bound(id, hub)`` to, followed along ``hubs(id, merged_into)``; nodes without one keep the family of their
    legacy root, as all do where nothing is bound.

    A family is represented by the legacy root of least ``content`` among its members; a chain of hubs that runs in a circle ends at the
    circle's first hub on the way.  ``keys`` has the content of legacy roots; one that isn't there has an empty one, which is the least.
    """
    ends = chain_ends(hubs.select(F.col("id").alias("_h"), F.nullif(F.col("merged_into"), F.lit("")).alias("_to")), "_h", "_to")
    of = bound.select(F.col("id").alias(ident), F.col("hub").alias("_h")).join(sent(ends), "_h", "left").select(ident, F.coalesce("terminal", "entry", "_h").alias("_hub"))
    family = F.when(F.col("_hub").isNotNull(), F.concat(F.lit("h"), F.col("_hub").cast("string"))).otherwise(F.concat(F.lit("r"), F.col(root).cast("string")))
    rows = stored(legacy.select(ident, root).join(sent(of), ident, "left").select(ident, root, family.alias("_family")))
    k = keys.select(F.col(ident).alias(root), F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in content]).alias("_k"))
    blank = F.struct(*[F.lit("").alias(c) for c in content])
    shown = rows.select("_family", root).distinct().join(sent(k), root, "left").groupBy("_family").agg(F.min(F.struct(F.coalesce("_k", blank).alias("_k"), root))[root].alias("_shown"))
    return rows.join(sent(shown), "_family").select(ident, F.col("_shown").alias(root))


def guarded_components(nodes: DataFrame, node: str, kind: str, merges: DataFrame, a: str, b: str) -> tuple[DataFrame, DataFrame]:
    """``(node, kind, root)`` of every node, its root the least node that merges reach, and ``(a, b, reason)`` of the merges that were left out: ``unknown`` where a side is no node,
    ``crosses`` where the sides are of two kinds.

    A component is of one kind, since each merge is judged by what its own two nodes were declared as, so the result doesn't depend on the order of the merges.
    """
    left = nodes.select(F.col(node).alias(a), F.col(kind).alias("_ka"))
    right = nodes.select(F.col(node).alias(b), F.col(kind).alias("_kb"))
    known = merges.join(left, a, "left").join(right, b, "left")
    reason = F.when(F.col("_ka").isNull() | F.col("_kb").isNull(), "unknown").when(F.col("_ka") != F.col("_kb"), "crosses")
    judged = stored(known.select(a, b, reason.alias("reason")))
    found = min_label_components(judged.where("reason is null"), a, b).withColumnsRenamed({"node": node, "component": "root"})
    return nodes.select(node, kind).join(found, node, "left").select(node, kind, F.coalesce("root", node).alias("root")), judged.where("reason is not null")


def project_identity(statements: DataFrame, targets: dict[str, str], gate: float) -> dict[str, DataFrame]:
    """Nodes, bindings and labels that statements amount to: ``statements(id, predicate, polarity, kind, ref, object, score, stratum, value)``.

    ``mint`` declares the node ``ref`` of that kind, ``merge`` joins it with ``object``, ``bind`` ties an observation (whose kind ``targets`` maps to a kind of node) to the node
    ``object``, ``label`` names a node in a stratum.  Only affirmed ones count, a bind only at ``gate`` or above and where the same bind is nowhere refuted.

    * ``nodes(kind, node, merged_into)``: minted nodes, with the root where it is another one
    * ``bound(kind, ref, node)``: by the strongest bind (of equal ones the least id), if all of them lead to one root
    * ``conflicts(kind, ref, roots)``: observations that lead to several roots and stay unbound
    * ``labels(kind, node, stratum, value, id)``: the strongest of each node and stratum
    * ``skipped(reason, n)``: merges of unknown nodes or two kinds, binds below the gate, refuted, of a kind without target or to no node, labels of no node
    """
    yes = statements.where("polarity = 'affirm'")
    minted = yes.where("predicate = 'mint'").select("kind", F.col("ref").alias("node")).distinct()
    of_kind = minted.groupBy("node").agg(F.min("kind").alias("kind"))
    merges = yes.where("predicate = 'merge'").select(F.col("ref").alias("a"), F.col("object").alias("b"))
    roots, left_out = guarded_components(of_kind, "node", "kind", merges, "a", "b")
    roots = stored(roots)

    pairs = [x for k, v in targets.items() for x in (F.lit(k), F.lit(v))]
    target = F.try_element_at(F.create_map(*pairs), F.col("kind")) if pairs else F.lit(None).cast("string")
    refuted = statements.where("predicate = 'bind' and polarity = 'refute' and object is not null").select("kind", "ref", "object").distinct().withColumn("_no", F.lit(True))
    binds = yes.where("predicate = 'bind' and object is not null").withColumn("_target", target).join(refuted, ["kind", "ref", "object"], "left")
    node = minted.select(F.col("kind").alias("_target"), F.col("node").alias("object"), F.lit(True).alias("_there"))
    why = F.when(F.col("_target").isNull(), "no target").when(F.col("_no"), "refuted").when(F.coalesce("score", F.lit(0.0)) < gate, "below gate").when(F.col("_there").isNull(), "bind to no node")
    judged = stored(binds.join(node, ["_target", "object"], "left").select("id", "kind", "ref", "object", "score", why.alias("reason")))
    led = judged.where("reason is null").join(roots.select(F.col("node").alias("object"), "root"), "object")
    best = led.groupBy("kind", "ref").agg(F.collect_set("root").alias("roots"), F.min(F.struct((-F.col("score")).alias("s"), "id", "object"))["object"].alias("node"))
    best = stored(best)

    labels = yes.where("predicate = 'label'").join(minted.select("kind", F.col("node").alias("ref"), F.lit(True).alias("_there")), ["kind", "ref"], "left")
    picked = labels.where("_there").groupBy("kind", F.col("ref").alias("node"), F.coalesce("stratum", F.lit("")).alias("stratum")).agg(F.min(F.struct((-F.coalesce("score", F.lit(0.0))).alias("s"), "id", "value")).alias("m"))
    skipped = left_out.select(F.concat(F.lit("merge "), "reason").alias("reason")).unionByName(judged.where("reason is not null").select("reason")).unionByName(labels.where("_there is null").select(F.lit("label of no node").alias("reason")))
    return {
        "nodes": minted.join(roots.select("node", "root"), "node").select("kind", "node", F.nullif("root", F.col("node")).alias("merged_into")),
        "bound": best.where("size(roots) = 1").select("kind", "ref", "node"),
        "conflicts": best.where("size(roots) > 1").select("kind", "ref", F.array_sort("roots").alias("roots")),
        "labels": picked.select("kind", "node", "stratum", F.coalesce("m.value", F.lit("")).alias("value"), F.col("m.id").alias("id")),
        "skipped": skipped.groupBy("reason").agg(F.count("*").alias("n")),
    }
