"""Product codes of vectors: every part of a vector becomes the index of an entry of its part's codebook, by ball k-means.

An entry and the parts that chose it are a ball.  After the entries have moved, the ball's radius (at most the old one plus the move) tells
which other entries are neighbours: only those nearer than twice the radius can win a part of it.  A part whose
distance to its entry is less than half the way to the nearest neighbour lies in the stable core and keeps its entry without another
distance.  The others lie in rings, bounded by half the ways to the first, second, ... neighbour, and a part in the k-th ring
is compared with the first k neighbours alone.  The bounds are taken a little wide, so that the result is that of comparing all.

The vectors stay in their tasks: each round sends back sums, counts and radii of the entries, and sends out the entries, both of a size that is
fixed by the parameters and the dimension.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import materialize, release, spread_join, table

SCALE = 256
MOST = 1 << 24
SLACK = 1 + 1e-9
PAIRS = 1 << 22


class Balls:
    """One part position's entries ``c`` (integers, a row each), and for each entry its neighbours by distance with half the way to each.

    ``radius`` bounds the distance of the members of each ball; without it every other entry is a neighbour.
    """

    def __init__(self, c: np.ndarray, radius: np.ndarray | None = None):
        self.c = c
        n = len(c)
        gap = np.sqrt(((c[:, None, :] - c[None, :, :]) ** 2).sum(2).astype(float)) / 2
        np.fill_diagonal(gap, np.inf)
        if radius is not None:
            gap[gap > radius[:, None] * SLACK] = np.inf
        self.order = np.argsort(gap, axis=1, kind="stable")[:, : n - 1]
        self.half = np.take_along_axis(gap, self.order, 1)

    def nearest(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """``(index, squared distance, distances computed)`` of the nearest entry of every row of ``x``, ties to the lower index;
        ``own`` are the entries whose balls the rows are in."""
        mine = ((x - self.c[own]) ** 2).sum(1)
        index, best, pairs = own.astype(np.int64), mine.copy(), len(x)
        if not self.half.shape[1]:
            return index, best, pairs
        reach = np.sqrt(mine.astype(float)) * SLACK
        at = np.flatnonzero(self.half[own, 0] <= reach)  # the others are in the stable core
        ring = np.zeros(len(at), np.int64)
        for e in np.unique(own[at]):
            m = own[at] == e
            ring[m] = np.searchsorted(self.half[e], reach[at[m]], "right")
        block = max(1, PAIRS // max(1, self.half.shape[1] * x.shape[1]))
        for a in range(0, len(at), block):
            rows, many = at[a : a + block], ring[a : a + block]
            head = np.concatenate(([0], np.cumsum(many)))
            who = np.repeat(np.arange(len(rows)), many)
            other = self.order[own[rows][who], np.arange(head[-1]) - head[who]]
            far = ((x[rows][who] - self.c[other]) ** 2).sum(1)
            pairs += len(far)
            least = np.minimum(np.minimum.reduceat(far, head[:-1]), mine[rows])
            tied = np.where(far == least[who], other, len(self.c))
            first = np.minimum(np.minimum.reduceat(tied, head[:-1]), np.where(mine[rows] == least, own[rows], len(self.c)))
            index[rows], best[rows] = first, least
        return index, best, pairs


def _matrix(column) -> np.ndarray:
    """The rows of an integer list column, all of the same length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def _digits(column, parts: int) -> np.ndarray:
    """Entry indexes of a column of codes; a null one puts all parts into the first ball."""
    first = bytes(parts)
    return np.frombuffer(b"".join(x or first for x in column.to_pylist()), np.uint8).astype(np.int64).reshape(-1, parts)


def _assigned(rows: DataFrame, balls: list[Balls]) -> DataFrame:
    """``rows(id, label, vector, code)`` with the code of the nearest entries, and ``error``, the sum of squared distances."""
    parts = len(balls)

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                ids, labels, vectors, codes = batch.slice(a, 4096).columns
                x, old = _matrix(vectors), _digits(codes, parts)
                x = x.reshape(len(x), parts, -1)
                new, far = np.empty(old.shape, np.uint8), np.zeros(len(old), np.int64)
                for p, ball in enumerate(balls):
                    new[:, p], best, _ = ball.nearest(x[:, p], old[:, p])
                    far += best
                code = pa.array([y.tobytes() for y in new], pa.binary())
                yield pa.RecordBatch.from_arrays([ids, labels, vectors, code, pa.array(far)], ["id", "label", "vector", "code", "error"])
        release()

    return rows.select("id", "label", "vector", "code").mapInArrow(run, StructType([*rows.schema.fields[:4], StructField("error", LongType())]))


def _ball_sums(rows: DataFrame, books: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the balls of ``rows``: ``(members, sums, greatest squared distance of a member)`` by part and entry.  A task sends one row for each
    part, entry and component, and as many in all come to the driver."""
    parts, entries, size = books.shape

    def run(batches):
        n, far, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries), np.int64), np.zeros((parts, entries, size), np.int64)
        for batch in batches:
            x, code = _matrix(batch.column(0)), _digits(batch.column(1), parts)
            x = x.reshape(len(x), parts, -1)
            for p in range(parts):
                own = code[:, p]
                n[p] += np.bincount(own, minlength=entries)
                np.add.at(sums[p], own, x[:, p])
                np.maximum.at(far[p], own, ((x[:, p] - books[p, own]) ** 2).sum(1))
        used = np.flatnonzero(np.repeat(n.ravel() > 0, size))
        ball = used // size
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n.ravel()[ball]), pa.array(far.ravel()[ball]), pa.array(sums.ravel()[used])], ["at", "n", "far", "total"])

    found = rows.select("vector", "code").mapInArrow(run, "at long, n long, far long, total long").groupBy("at").agg(F.sum("n"), F.max("far"), F.sum("total")).collect()
    n, far, sums = np.zeros(books.size, np.int64), np.zeros(books.size, np.int64), np.zeros(books.size, np.int64)
    for at, many, most, total in found:
        n[at], far[at], sums[at] = many, most, total
    return n.reshape(books.shape)[:, :, 0], sums.reshape(books.shape), far.reshape(books.shape)[:, :, 0]


def whole_numbers(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """``(id, label, vector)`` of the rows whose vector has components, all of them finite: each component x as ``floor(SCALE * x)``."""
    v, x = F.col(vector_col), lambda c: F.floor(c.cast("double") * SCALE)
    ok = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    far = F.raise_error(F.lit(f"a component times {SCALE} is beyond {MOST}")).cast("int")
    return vectors.where(ok).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.transform(v, lambda c: F.when(F.abs(c.cast("double")) * SCALE > MOST, far).otherwise(x(c).cast("int"))).alias("vector"))


def product_codes(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, parts: int = 16, entries: int = 64, rounds: int = 2) -> tuple[DataFrame, np.ndarray]:
    """Written ``(id, label, code, error)`` of each kept row, and the codebooks ``[part, entry, component]``.

    Components are whole numbers, ``floor(SCALE * x)``.  A row without a vector, with an empty one, or with a null or non-finite component is
    not kept, nor is one whose length differs from that of the kept row with the smallest id.  A length that ``parts`` doesn't divide is
    filled up with zeros.  Codebooks begin as the ``entries`` (256 at most) smallest ids (null ids last, equal ones by their vectors); with fewer rows they
    are shorter.  ``code`` has a byte a part, ``error`` is the sum of the squared distances.  Repeated rows count each time.  A component beyond
    ``MOST / SCALE`` is an error, as squares must fit 64 bits.  Without kept rows the codebooks are empty.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has one byte a part")
    kept = whole_numbers(vectors, id_col, vector_col, label_col)
    order = [F.col("id").asc_nulls_last(), F.col("vector")]
    head = kept.orderBy(*order).select(F.size("vector").alias("n")).first()
    if head is None:
        return kept.select("id", "label", F.lit(None).cast("binary").alias("code"), F.lit(0).cast("long").alias("error")), np.zeros((parts, 0, 0), np.int64)
    size = -(-head.n // parts)
    kept = kept.where(F.size("vector") == head.n)
    if size * parts > head.n:
        kept = kept.withColumn("vector", F.concat("vector", F.array_repeat(F.lit(0), size * parts - head.n)))
    start = np.array([r.vector for r in kept.orderBy(*order).select("vector").limit(entries).collect()], np.int64)
    books = start.reshape(len(start), parts, size).transpose(1, 0, 2)
    balls = [Balls(c) for c in books]
    state = kept.withColumn("code", F.lit(None).cast("binary"))
    for k in range(rounds):
        state = materialize(_assigned(state, balls).drop("error"), f"codes-{k}")
        n, sums, far = _ball_sums(state, books)
        moved = np.where(n[:, :, None] > 0, sums // np.maximum(n, 1)[:, :, None], books)
        radius = np.sqrt(far.astype(float)) + np.sqrt(((moved - books) ** 2).sum(2).astype(float))
        books, balls = moved, [Balls(c, r) for c, r in zip(moved, radius)]
    return materialize(_assigned(state, balls).drop("vector"), "codes"), books


def codebooks_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_label_errors(coded: DataFrame) -> DataFrame:
    """The written ``coded(id, label, code, error)`` plus ``label_error``, the errors of its label summed; nulls are one label."""
    known = F.when(F.col("label").isNull(), "-").otherwise(F.concat(F.lit("="), F.col("label").cast("string")))
    rows = coded.withColumn("_label", known)
    sums = materialize(rows.groupBy("_label").agg(F.sum("error").alias("label_error"), F.count("*").alias("_n")), "label-errors")
    return spread_join(rows, sums, "_label", "_n", coded.count()).drop("_label")


def op11_vector_codes(spark, sf_dir):
    coded, books = product_codes(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")
    out = with_label_errors(coded)
    return out.select(F.col("id").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256"))


_ROUND = """
a{r} AS MATERIALIZED (SELECT vec_id, j, x, e, far FROM (SELECT p.vec_id, p.j, any_value(p.x) AS x, arg_min({{e: c.e, far: f}}, f * 64 + c.e) AS m FROM p JOIN c{r} c ON p.j = c.j,
  LATERAL (SELECT list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - c.x[i]) * (p.x[i] - c.x[i]))) AS f) GROUP BY p.vec_id, p.j) t, LATERAL (SELECT m.e AS e, m.far AS far))"""
_MOVE = """
c{n} AS MATERIALIZED (SELECT c.j, c.e, coalesce(s.x, c.x) AS x FROM c{r} c LEFT JOIN (SELECT j, e, list(CAST(floor(t / n) AS BIGINT) ORDER BY i) AS x FROM (
  SELECT j, e, i, CAST(sum(x[i]) AS DOUBLE) AS t, count(*) AS n FROM a{r}, range(1, (SELECT max(len(x)) FROM p) + 1) g(i) GROUP BY j, e, i) GROUP BY j, e) s ON s.j = c.j AND s.e = c.e)"""
ORACLE = {
    "op11_vector_codes": """
WITH k AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, label, j, v[j * (len(v) // 16) + 1 : (j + 1) * (len(v) // 16)] AS x FROM k, range(16) g(j)),
c0 AS MATERIALIZED (SELECT j, row_number() OVER (PARTITION BY j ORDER BY vec_id) - 1 AS e, x FROM p WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT 64)),"""
    + ",".join([_ROUND.format(r=0), _MOVE.format(r=0, n=1), _ROUND.format(r=1), _MOVE.format(r=1, n=2), _ROUND.format(r=2)])
    + """,
b AS (SELECT sha256(string_agg(v, ',' ORDER BY j, e)) AS codebooks_sha256 FROM (SELECT j, e, array_to_string(x, ',') AS v FROM c2)),
r AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY j) AS code, CAST(sum(far) AS BIGINT) AS error FROM a2 GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM r JOIN k USING (vec_id), b"""
}
