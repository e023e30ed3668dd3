"""Tables published as versions: folders that are never changed, and a log of pointers that says which one is current."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _files(spark: SparkSession, path: str):
    """The file system of a path, and a maker of paths."""
    jvm = spark._jvm
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    return at(path).getFileSystem(spark._jsc.hadoopConfiguration()), at


def _pointers(spark: SparkSession, root: str) -> list[int]:
    fs, at = _files(spark, root)
    if not fs.exists(at(f"{root}/current")):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(at(f"{root}/current"))]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def _point(spark: SparkSession, root: str, body: dict) -> int:
    """Add a pointer behind the last one; of two publishers at once one gets the number, the other takes the next."""
    fs, at = _files(spark, root)
    fs.mkdirs(at(f"{root}/current"))
    staged = f"{root}/.{uuid.uuid4().hex}"
    spark.createDataFrame([(json.dumps(body, sort_keys=True),)], "value string").coalesce(1).write.text(staged)
    (part,) = [f.getPath() for f in fs.listStatus(at(staged)) if f.getPath().getName().startswith("part-")]
    while True:
        number = max(_pointers(spark, root), default=0) + 1
        target = at(f"{root}/current/{number:012d}.json")
        # a rename onto a name that is taken fails or is refused here, so a pointer is never replaced
        if not fs.exists(target) and fs.rename(part, target):
            fs.delete(at(staged), True)
            return number


def publish(tables: dict[str, DataFrame], root: str, schema_version: str, version: str | None = None) -> str:
    """Write all ``tables`` as one version below ``root`` and make it the current one; the version's name.

    The tables are written to a folder of their own; rows are counted and a digest of each is taken from what was written. Only when
    all of that is there a pointer is added, by one rename of a small file.  A reader that comes before sees the version before in all its tables, one that comes
    behind the new one in all; one that has read a pointer keeps what it points to, since folders aren't changed.  A failed
    call leaves a folder that no pointer names.  A version that is there already is an error.
    """
    spark = next(iter(tables.values())).sparkSession
    version = version or uuid.uuid4().hex
    fs, at = _files(spark, root)
    folder = f"{root}/v/{version}"
    if fs.exists(at(folder)):
        raise ValueError(f"there is a version {version} already")
    about = {}
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}")
        written = spark.read.schema(df.schema).parquet(f"{folder}/{name}")
        n, digest = written.agg(F.count("*"), F.sum(F.xxhash64(*written.columns).cast("decimal(38,0)"))).first()
        about[name] = {"rows": n, "digest": str(digest or 0), "schema": df.schema.json()}
    _point(spark, root, {"version": version, "schema_version": schema_version, "tables": about})
    return version


def current(spark: SparkSession, root: str, schema_version: str | None = None) -> dict:
    """The last pointer.  Without one, or with another schema version than the one asked for, an error."""
    numbers = _pointers(spark, root)
    if not numbers:
        raise FileNotFoundError(f"nothing is published in {root}")
    body = json.loads(spark.read.text(f"{root}/current/{numbers[-1]:012d}.json", wholetext=True).first()[0])
    if schema_version is not None and body["schema_version"] != schema_version:
        raise ValueError(f"{root} has schema version {body['schema_version']!r}, {schema_version!r} is asked for")
    return body


def read_published(spark: SparkSession, root: str, schema_version: str | None = None) -> dict[str, DataFrame]:
    """All tables of the current version, by name, with the schemas they were written with."""
    from pyspark.sql.types import StructType

    body = current(spark, root, schema_version)
    return {name: spark.read.schema(StructType.fromJson(json.loads(x["schema"]))).parquet(f"{root}/v/{body['version']}/{name}") for name, x in body["tables"].items()}


def roll_back(spark: SparkSession, root: str) -> str:
    """Point at the version before the current one again, as a new pointer; its name."""
    numbers, now = _pointers(spark, root), current(spark, root)["version"]
    for number in reversed(numbers):
        body = json.loads(spark.read.text(f"{root}/current/{number:012d}.json", wholetext=True).first()[0])
        if body["version"] != now:
            _point(spark, root, body)
            return body["version"]
    raise ValueError(f"{root} has no version before {now}")


def prune(spark: SparkSession, root: str, keep: int) -> list[str]:
    """Delete the folders of all but the last ``keep`` versions that pointers name, and of those that none does; their names.  Readers of an older version lose it."""
    fs, at = _files(spark, root)
    kept: list[str] = []
    for number in reversed(_pointers(spark, root)):
        name = json.loads(spark.read.text(f"{root}/current/{number:012d}.json", wholetext=True).first()[0])["version"]
        if name not in kept and len(kept) < max(keep, 1):
            kept.append(name)
    gone = [f.getPath().getName() for f in fs.listStatus(at(f"{root}/v")) if f.getPath().getName() not in kept]
    for name in gone:
        fs.delete(at(f"{root}/v/{name}"), True)
    return sorted(gone)
