"""A ledger of reports with a status: an append-only table, its current state, and pages by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "id string, at timestamp, status string, generator string, reason string, ticket string, note string"
NEW, STATUSES = "new", ("new", "accepted", "dismissed")


def record(reports: DataFrame, path: str) -> None:
    """Append ``reports(id, at, generator, reason)`` as new.  A report without a reason fails the call, and nothing is added; a null generator is ``unknown``."""
    reason = F.trim("reason")
    checked = F.when(F.coalesce(reason, F.lit("")) == "", F.raise_error(F.concat(F.lit("no reason in report "), F.col("id")))).otherwise(reason)
    rows = reports.select("id", "at", F.lit(NEW).alias("status"), F.coalesce("generator", F.lit("unknown")).alias("generator"), checked.alias("reason"), F.lit(None).cast("string").alias("ticket"), F.lit(None).cast("string").alias("note"))
    rows.write.mode("append").parquet(path)


def transition(changes: DataFrame, path: str) -> None:
    """Append ``changes(id, at, status, ticket, note)``.  An id that was never recorded, an unknown status and the status new fail the call."""
    known = read(changes.sparkSession, path).where(F.col("status") == NEW).select("id", F.lit(True).alias("_there")).distinct()
    rows = changes.join(known, "id", "left")
    wrong = F.when(F.col("_there").isNull(), F.concat(F.lit("no report "), F.col("id"))).when(~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)) | (F.col("status") == NEW), F.concat(F.lit("a report can't become "), F.coalesce("status", F.lit("null"))))
    status = F.when(wrong.isNotNull(), F.raise_error(wrong)).otherwise(F.col("status"))
    none = F.lit(None).cast("string")
    rows.select("id", "at", status.alias("status"), none.alias("generator"), none.alias("reason"), "ticket", "note").write.mode("append").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def state(rows: DataFrame) -> DataFrame:
    """``(id, created, generator, reason, status, changed, ticket, note)`` of each report: its last transition by time, of equal times by status, or none."""
    change = F.when(F.col("status") != NEW, F.struct("at", "status", "ticket", "note"))
    first = F.when(F.col("status") == NEW, F.struct(F.col("at").alias("created"), "generator", "reason"))
    g = rows.groupBy("id").agg(F.min(first).alias("r"), F.max(change).alias("c")).where("r is not null")
    return g.select("id", "r.created", "r.generator", "r.reason", F.coalesce("c.status", F.lit(NEW)).alias("status"), F.col("c.at").alias("changed"), "c.ticket", "c.note")


def page(reports: DataFrame, size: int, status: str | None = NEW, generator: str | None = None, after: tuple | None = None) -> DataFrame:
    """The ``size`` newest reports of a status (None: any) and generator behind the key ``after``, the ``(created, id)`` of the last row of the page before.

    The order is by time, newest first, then by id, so pages stay what they are while newer reports are added.
    """
    if status is not None and status not in STATUSES:
        raise ValueError(f"unknown status {status!r}")
    rows = reports
    if status is not None:
        rows = rows.where(F.col("status") == status)
    if generator is not None:
        rows = rows.where(F.col("generator") == generator)
    if after is not None:
        created, ident = after
        rows = rows.where((F.col("created") < F.lit(created)) | ((F.col("created") == F.lit(created)) & (F.col("id") > F.lit(ident))))
    return rows.orderBy(F.desc("created"), "id").limit(size)
