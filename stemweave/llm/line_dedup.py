"""Line dedup by the number of distinct sites a line is seen on.

Every line's sites are folded into a HyperLogLog sketch by a partial aggregation, so a line that
is in a third of all rows costs one sketch for each map task.  Lines whose estimate is near the
threshold get an exact distinct count.  A line on ``min_sites`` sites or more is cross-site boilerplate: its first occurrence
(smallest document id, then position) stays, all others are removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free, materialize, small, table


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def _lines(docs: DataFrame, id_col: str, text_col: str, site_col: str, min_chars: int) -> DataFrame:
    """Written ``(doc_id, h, site, pos, line)``: hashes of the lines that are long enough, ``h`` the hash of their text."""
    each = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(_text(text_col)).alias("h"), F.col(site_col).cast("string").alias("site"), F.posexplode(F.split(_text(text_col), "\n")).alias("pos", "line"))
    line = F.trim("line")
    return materialize(each.where(F.length(line) >= min_chars).select("doc_id", "h", "site", "pos", F.xxhash64(line).alias("line")), "lines")


def boilerplate_lines(lines: DataFrame, min_sites: int, lg_k: int = 10, band: float = 0.4) -> DataFrame:
    """``(line)``: hashes of ``lines(site, line)`` seen on ``min_sites`` distinct non-null sites or more.

    The relative error of the sketch is about ``1.04 / 2 ** (lg_k / 2)``; estimates within ``band`` of the
    threshold, over ten times that, are settled by an exact count.
    """
    spread = lines.groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", lg_k)).alias("sites"))
    spread = materialize(spread.where(F.col("sites") >= min_sites * (1 - band)), "spread")
    sure = spread.where(F.col("sites") >= min_sites * (1 + band)).select("line")
    near = spread.where(F.col("sites") < min_sites * (1 + band)).select("line")
    exact = lines.join(small(near), "line", "left_semi").groupBy("line").agg(F.countDistinct("site").alias("sites")).where(F.col("sites") >= min_sites)
    return sure.unionByName(exact.select("line"))


def _cuts(docs: DataFrame, id_col: str, text_col: str, site_col: str, min_sites: int, min_chars: int) -> DataFrame:
    """Written ``(doc_id, h, cut)``: the positions of the lines to remove, for each text that loses any."""
    lines = _lines(docs, id_col, text_col, site_col, min_chars)
    bad = materialize(boilerplate_lines(lines, min_sites), "boilerplate")
    hit = materialize(lines.join(small(bad), "line", "left_semi").select("doc_id", "h", "pos", "line"), "hits")
    first = hit.groupBy("line").agg(F.min(F.struct("doc_id", "h", "pos")).alias("f"))
    first = materialize(first.select("line", F.col("f.doc_id").alias("i0"), F.col("f.h").alias("h0"), F.col("f.pos").alias("p0")), "first")
    rest = hit.join(small(first), "line").where(~(F.col("doc_id").eqNullSafe(F.col("i0")) & (F.col("h") == F.col("h0")) & (F.col("pos") == F.col("p0"))))
    return materialize(rest.groupBy("doc_id", "h").agg(F.collect_set("pos").alias("cut")), "cuts")


def _cleaned(docs: DataFrame, id_col: str, text_col: str, site_col: str, min_sites: int, min_chars: int) -> tuple[DataFrame, str, str]:
    """``docs`` with lines cut, and the names of the two added columns."""
    names = {n: free(n, docs.columns) for n in ("_cut", "_id", "_h", "n_lines", "n_removed")}
    cut = _cuts(docs, id_col, text_col, site_col, min_sites, min_chars).select(F.col("doc_id").alias(names["_id"]), F.col("h").alias(names["_h"]), F.col("cut").alias(names["_cut"]))
    rows = docs.join(small(cut), docs[id_col].eqNullSafe(F.col(names["_id"])) & (F.xxhash64(_text(text_col)) == F.col(names["_h"])), "left")
    parts = F.split(F.col(text_col).cast("string"), "\n")
    # array_except compares by hash, so a text of many lines with many cuts stays linear
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(names["_cut"]))
    kept = F.element_at(F.transform(F.array(parts), lambda a: F.array_join(F.transform(left, lambda i: F.get(a, i)), "\n")), 1)
    out = rows.select(
        *[F.when(F.col(names["_cut"]).isNull(), F.col(f"`{c}`")).otherwise(kept).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns],
        F.when(F.col(text_col).isNull(), 0).otherwise(F.size(parts)).cast("long").alias(names["n_lines"]), F.coalesce(F.size(names["_cut"]), F.lit(0)).cast("long").alias(names["n_removed"]),
    )
    return out, names["n_lines"], names["n_removed"]


def remove_boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = 5, min_chars: int = 20) -> DataFrame:
    """``docs`` with its columns, boilerplate lines cut from the text, plus ``n_lines`` and ``n_removed``.

    Lines are split at ``\\n`` and compared without the spaces around them; lines of fewer than ``min_chars``
    characters are never boilerplate.  A null text stays null with no lines; an empty one has one line.  A null site counts as no
    site.  Rows that repeat both id and text keep or lose the same lines.  Columns of ``docs`` with the names of the two
    new ones stay as they are, and the new ones get underscores behind theirs.
    """
    return _cleaned(docs, id_col, text_col, site_col, min_sites, min_chars)[0]


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = 5, min_chars: int = 20) -> DataFrame:
    """``docs`` without boilerplate lines; a row of which nothing but blanks is left goes.  ``n_chars`` follows the text."""
    out, _, removed = _cleaned(docs, id_col, text_col, site_col, min_sites, min_chars)
    out = out.where((F.col(removed) == 0) | (F.trim(F.col(text_col)) != ""))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(removed) > 0, F.length(text_col).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.drop(*set(out.columns) - set(docs.columns))


def op4_line_dedup(spark, sf_dir):
    out = remove_boilerplate(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("clean_sha256"))


ORACLE = {
    "op4_line_dedup": """
WITH x AS (SELECT doc_id, source, text IS NULL AS gone, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
l AS (SELECT doc_id, source, unnest(range(1, len(a) + 1)) AS pos, unnest(a) AS line FROM x),
b AS (SELECT trim(line) AS t FROM l WHERE length(trim(line)) >= 20 GROUP BY 1 HAVING count(DISTINCT source) >= 5),
h AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY t ORDER BY doc_id, pos) AS k FROM l JOIN b ON trim(line) = t),
k AS (SELECT l.doc_id, count(h.k) AS n_removed, string_agg(CASE WHEN h.k IS NULL THEN line END, chr(10) ORDER BY l.pos) AS s
  FROM l LEFT JOIN h ON h.doc_id = l.doc_id AND h.pos = l.pos AND h.k > 1 GROUP BY 1)
SELECT doc_id, CAST(CASE WHEN gone THEN 0 ELSE len(a) END AS BIGINT) AS n_lines, n_removed, sha256(coalesce(s, '')) AS clean_sha256 FROM x JOIN k USING (doc_id)"""
}
