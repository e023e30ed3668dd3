"""Quality: document evidence shrunk through a hierarchy of sites.

The evidence of a document is its log-odds under a logistic classifier on shape features (shares of
letters, capitals, punctuation, digits, repeated words, and the like).  Sites form a hierarchy:
all rows, a host, a path below the host.  For each level the labelled rows give good and bad counts
by grouped aggregation; a level's posterior is a beta posterior whose prior is the level above,
with a strength estimated from the spread of the groups (method of moments).  Sparse sites so stay near the
global rate.  A document's probability joins its evidence with the log-odds of its path against
the global rate.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices, small, table, text_buffers
from .toxicity import training_rows

FEATURES = 14
HELD_OUT = 5


def shape_features(column) -> np.ndarray:
    """One row of ``FEATURES`` numbers for each text, from its bytes; all zero for an empty text."""
    buf, off = text_buffers(column)
    n = np.diff(off)
    kind = np.zeros((8, 256), np.float32)
    kind[0, 97:123] = kind[0, 128:] = 1  # letters, with bytes beyond ASCII
    kind[1, 65:91] = 1
    kind[2, 48:58] = 1
    kind[3, [9, 10, 13, 32]] = 1
    kind[4, [ord(c) for c in ".,;:'\"-?()"]] = 1
    kind[5, [ord(c) for c in "#$%&*!@^~=+<>{}[]\\/_`"]] = 1
    kind[6, 124] = 1
    kind[7, 10] = 1
    owner = np.repeat(np.arange(len(n)), n)
    share = [np.bincount(owner, row[buf], minlength=len(n)) for row in kind]
    size = np.maximum(n, 1)
    words = np.maximum(share[3], 1)
    same = np.zeros(len(buf), np.float32)
    if len(buf) > 1:
        same[1:] = (buf[1:] == buf[:-1]) & (kind[3][buf[1:]] == 0)
    # a repeated word: the word starts with the same bytes as the one before it
    space = kind[3][buf] > 0
    start = np.flatnonzero(~space & np.r_[True, space[:-1]]) if len(buf) else np.zeros(0, np.int64)
    code = np.zeros(len(start), np.int64)
    for i in range(6):
        at = np.minimum(start + i, max(len(buf) - 1, 0))
        code = code * 257 + (buf[at] if len(buf) else 0)
    again = np.r_[False, code[1:] == code[:-1]] if len(code) else np.zeros(0, bool)
    count = np.maximum(np.bincount(owner[start], minlength=len(n)) if len(start) else np.zeros(len(n)), 1)
    repeat = np.bincount(owner[start], again, minlength=len(n)) if len(start) else np.zeros(len(n))
    cols = [s / size for s in share] + [np.log1p(n), np.log1p(words), size / words / 10, np.bincount(owner, same, minlength=len(n)) / size, repeat / count, np.log1p(count)]
    return np.where(n[:, None] > 0, np.stack(cols, 1), 0.0)


def fit_evidence(labelled: DataFrame, steps: int = 400, l2: float = 1e-3) -> dict:
    """Logistic weights from a bounded table ``(label, text)``; only ``FEATURES`` numbers a row come to the driver."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1, 1 << 20):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(shape_features(part.column(1))), pa.list_(pa.float64()))], ["y", "x"])

    rows = labelled.select(F.col("label").cast("int").alias("y"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("y is not null")
    got = rows.mapInArrow(run, "y int, x array<double>").toArrow()
    y = got.column("y").to_numpy().astype(float)
    if not len(y):
        return {"mean": np.zeros(FEATURES), "scale": np.ones(FEATURES), "w": np.zeros(FEATURES), "b": 0.0}
    x = got.column("x").combine_chunks().flatten().to_numpy().reshape(len(y), FEATURES)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.hstack([np.ones((len(y), 1)), np.clip((x - mean) / scale, -8, 8)])
    w = np.zeros(FEATURES + 1)
    w[0] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    pull = np.r_[0, np.full(FEATURES, l2)]
    for _ in range(steps):  # Newton's steps; few are needed
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (p - y) / len(y) + pull * w
        h = (z * (p * (1 - p) + 1e-6)[:, None]).T @ z / len(y) + np.diag(pull + 1e-6)
        d = np.linalg.solve(h, g)
        w -= np.clip(d, -1, 1)
        if np.abs(d).max() < 1e-8:
            break
    return {"mean": mean, "scale": scale, "w": w[1:], "b": float(w[0])}


def evidence(docs: DataFrame, model: dict, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns plus ``evidence``: the log-odds of each row's text."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, batch.num_columns - 1, 1 << 20):
                x = np.clip((shape_features(part.column(part.num_columns - 1)) - model["mean"]) / model["scale"], -8, 8)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(np.clip(x @ model["w"] + model["b"], -30, 30))], [*part.schema.names[:-1], "evidence"])

    from pyspark.sql.types import DoubleType, StructField, StructType

    schema = StructType([*[docs.schema[c] for c in keep], StructField("evidence", DoubleType())])
    return docs.select(*keep, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text")).mapInArrow(run, schema)


def _strength(groups: DataFrame, prior: Column) -> float:
    """The prior strength of a level by the method of moments over its groups ``(good, n)``; between 1 and 1000."""
    e = F.col("n") * (F.col("good") / F.col("n") - prior) ** 2
    s = groups.where("n > 0").agg(F.sum(e).alias("chi"), F.sum(prior * (1 - prior)).alias("noise"), F.sum(prior * (1 - prior) * (F.col("n") - 1)).alias("room")).first()
    if not s.room or s.chi is None or s.chi <= s.noise:
        return 1000.0
    rho = min(max((s.chi - s.noise) / s.room, 1e-3), 0.5)
    return float(min(max(1 / rho - 1, 1.0), 1000.0))


def site_posteriors(labelled: DataFrame) -> tuple[DataFrame, DataFrame, float]:
    """Posteriors ``(host, host_rate)`` and ``(host, path, path_rate)`` of ``labelled(host, path, label)``, and the global rate."""
    cells = materialize(labelled.groupBy("host", "path").agg(F.sum("label").cast("double").alias("good"), F.count("label").cast("double").alias("n")), "cells")
    total = cells.agg(F.sum("good").alias("g"), F.sum("n").alias("n")).first()
    base = ((total.g or 0.0) + 1.0) / ((total.n or 0.0) + 2.0)
    hosts = cells.groupBy("host").agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    k = _strength(hosts, F.lit(base))
    hosts = materialize(hosts.select("host", ((F.col("good") + k * base) / (F.col("n") + k)).alias("host_rate")), "hosts")
    named = hosts.withColumnRenamed("host", "_host")
    joined = cells.join(small(named), cells["host"].eqNullSafe(named["_host"])).drop("_host")
    k = _strength(joined, F.col("host_rate"))
    paths = joined.select("host", "path", ((F.col("good") + k * F.col("host_rate")) / (F.col("n") + k)).alias("path_rate"))
    return hosts, materialize(paths, "paths"), base


def quality_scores(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, sample_rows: int = 20_000) -> DataFrame:
    """``(doc_id, held_out, evidence, host_rate, path_rate, score, keep)`` for every row of ``docs``.

    ``host`` and ``path`` default to the columns source and lang.  The classifier learns from at most
    ``sample_rows`` labelled rows, the posteriors from all labelled rows, both outside the held-out fold
    (crc32 of the id, mod 5 = 0).  Null hosts and paths are groups of their own; sites without labels
    get the rate of the level above; null texts count as empty; repeated rows are scored each.
    """
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    model = fit_evidence(training_rows(docs, labels, "quality", sample_rows))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % HELD_OUT == 0, F.lit(False))
    sited = docs.select("doc_id", host.cast("string").alias("host"), path.cast("string").alias("path"), "text")
    known = labels.where("quality is not null and doc_id is not null").where(~held).select("doc_id", F.col("quality").cast("double").alias("label"))
    hosts, paths, base = site_posteriors(sited.select("doc_id", "host", "path").join(known, "doc_id").select("host", "path", "label"))
    out = evidence(sited, model, ["doc_id", "host", "path"])
    h, p = hosts.withColumnRenamed("host", "_h"), paths.withColumnsRenamed({"host": "_ph", "path": "_pp"})
    out = out.join(small(h), F.col("host").eqNullSafe(F.col("_h")), "left").join(small(p), F.col("host").eqNullSafe(F.col("_ph")) & F.col("path").eqNullSafe(F.col("_pp")), "left")
    host_rate = F.coalesce("host_rate", F.lit(base))
    path_rate = F.coalesce("path_rate", host_rate)
    logit = lambda q: F.log(q / (1 - q))
    odds = F.col("evidence") + logit(path_rate) - float(np.log(base / (1 - base)))
    score = 1 / (1 + F.exp(-odds))
    return out.select("doc_id", held.alias("held_out"), "evidence", host_rate.alias("host_rate"), path_rate.alias("path_rate"), score.alias("score"), (score >= 0.5).cast("int").alias("keep"))


def op7_quality_classifier(spark, sf_dir):
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
