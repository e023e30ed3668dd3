"""Sinks: canonical dumps, trimmed gold tables, atomic replacement, reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .publish import publish, read_published

GOLD = "1"


def canonical_dump(df: DataFrame, path: str, partition: str, order: list[str]) -> None:
    """JSON lines, one folder per partition value, rows in a fixed order within each file."""
    df.repartitionByRange(partition, *order).sortWithinPartitions(partition, *order).write.mode("overwrite").partitionBy(partition).json(path)


def repointed(df: DataFrame, column: str, merged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(rows with tombstones re-pointed to their winner, orphans)``; ``merged(id, winner)`` has a null winner for live ids."""
    j = df.join(merged.withColumnRenamed("id", column).withColumn("_known", F.lit(True)), column, "left")
    live = j.where("_known").withColumn(column, F.coalesce("winner", column)).select(*df.columns)
    return live, j.where("_known is null").select(*df.columns)


def trim_subset(df: DataFrame, group: str, weight: str, key: str, n: int) -> DataFrame:
    """The rows of the ``n`` heaviest keys of each group."""
    totals = df.groupBy(group, key).agg(F.sum(weight).alias("_w"))
    top = totals.withColumn("_k", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("_w"), key))).where(F.col("_k") <= n)
    return df.join(top.select(group, key), [group, key], "left_semi")


def replace_atomically(df: DataFrame, path: str) -> None:
    """Write beside the target, then swap by two renames; a failed write leaves the old table.

    Between the renames there is no table for a moment: where others read meanwhile, use :func:`publish.publish`.
    """
    spark = df.sparkSession
    staged, old = f"{path}.{uuid.uuid4().hex}.new", f"{path}.{uuid.uuid4().hex}.old"
    df.write.parquet(staged)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(conf)
    had = fs.exists(at(path))
    if had:
        fs.rename(at(path), at(old))
    if not fs.rename(at(staged), at(path)):
        if had:
            fs.rename(at(old), at(path))
        raise OSError(f"could not put {path} in place")
    if had:
        fs.delete(at(old), True)


def documents(df: DataFrame, key: str, parts: dict[str, tuple[str, list[str]]]) -> DataFrame:
    """One nested JSON document per key: each part is an ordered array of structs built from columns of ``df``."""
    grouped = df.groupBy(key).agg(*[F.sort_array(F.collect_set(F.struct(order, *cols))).alias(name) for name, (order, cols) in parts.items()])
    return grouped.select(key, F.to_json(F.struct(*parts)).alias("document"))


def csv_report(df: DataFrame, path: str, order: list[str]) -> None:
    """A CSV with a header in a fixed order."""
    df.orderBy(*order).write.mode("overwrite").option("header", True).csv(path)


def _move_only_part(spark, folder: str, target: str) -> None:
    """The one part file of a written folder becomes the file ``target``."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = at(folder).getFileSystem(conf)
    (part,) = [f.getPath() for f in fs.listStatus(at(folder)) if f.getPath().getName().startswith("part-")]
    fs.mkdirs(at(target).getParent())
    if fs.exists(at(target)):
        fs.delete(at(target), False)
    if not fs.rename(part, at(target)):
        raise OSError(f"could not put {target} in place")
    fs.delete(at(folder), True)


def named_lines(df: DataFrame, target: str, line: str, order: list[str]) -> None:
    """A ledger: one text file of a fixed name with the lines of ``df`` in order.  It is one file, so one task writes it."""
    folder = f"{target}.{uuid.uuid4().hex}.parts"
    df.orderBy(*order).select(line).coalesce(1).write.text(folder)
    _move_only_part(df.sparkSession, folder, target)


def ledgers(df: DataFrame, path: str, file: str, line: str, order: list[str], suffix: str = ".jsonl") -> list[str]:
    """Many ledgers at once: the lines of each value of ``file`` become one text file of that name in ``path``, each written by its own task.
    The names of the files, which are few, come to the driver, and each is put in place by a rename."""
    spark, staged = df.sparkSession, f"{path}/.{uuid.uuid4().hex}"
    df.select(F.col(file).cast("string").alias("_file"), line, *order).repartition("_file").sortWithinPartitions("_file", *order).select("_file", line).write.partitionBy("_file").text(staged)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = at(staged).getFileSystem(conf)
    names = sorted(f.getPath().getName().partition("=")[2] for f in fs.listStatus(at(staged)) if f.isDirectory())
    for name in names:
        _move_only_part(spark, f"{staged}/_file={name}", f"{path}/{name}{suffix}")
    fs.delete(at(staged), True)
    return names


def zstandard_lines(df: DataFrame, path: str, line: str) -> int:
    """Zstandard line files, one for each partition of ``df``, named by its number; each attempt writes a file of its own and renames it at the end.  The number of lines."""
    import pyarrow as pa
    import zstandard
    from pyarrow import fs
    from pyspark import TaskContext

    def run(batches):
        place, inner = fs.FileSystem.from_uri(path)
        place.create_dir(inner, recursive=True)
        n = 0
        task = TaskContext.get()
        final = f"{inner}/part-{task.partitionId():05d}.zst"
        own = f"{inner}/.part-{task.partitionId():05d}-{task.taskAttemptId()}"
        with place.open_output_stream(own, compression=None) as raw, zstandard.ZstdCompressor().stream_writer(raw) as out:
            for batch in batches:
                values = batch.column(0).to_pylist()
                out.write("".join(f"{v}\n" for v in values).encode())
                n += len(values)
        place.move(own, final)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return df.select(line).mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def json_sidecar(df: DataFrame, target: str, key: str) -> None:
    """A byte-stable sidecar: one JSON line per row, fields in the order of the columns, rows in order of the key."""
    named_lines(df.select(key, F.to_json(F.struct(*df.columns)).alias("line")), target, "line", [key])


def gold_tables(words: DataFrame, structures: DataFrame, path: str, culture: str, weight: str, word: str, structure: str) -> str:
    """The tables that generation reads, published together as one version: words and structures of each culture with their
    cumulative weights (in order of the word or structure), and the totals."""

    def cumulated(df, key):
        order = Window.partitionBy(culture).orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
        return df.groupBy(culture, key).agg(F.sum(weight).alias(weight)).withColumn("cumulative", F.sum(weight).over(order))

    totals = words.groupBy(culture).agg(F.count("*").alias("n"), F.sum(weight).alias("total"))
    return publish({"words": cumulated(words, word), "structures": cumulated(structures, structure), "totals": totals}, path, GOLD)


def read_bundle(spark, path: str, culture: str, weight: str, word: str, structure: str) -> DataFrame:
    """``(culture, bundle)``: the current gold tables nested again, one JSON document per culture."""
    tables = read_published(spark, path, GOLD)
    rows = lambda name, key: tables[name].groupBy(culture).agg(F.sort_array(F.collect_list(F.struct(key, weight, "cumulative"))).alias(name))
    return tables["totals"].join(rows("words", word), culture, "left").join(rows("structures", structure), culture, "left").select(culture, F.to_json(F.struct("n", "total", "structures", "words")).alias("bundle"))
