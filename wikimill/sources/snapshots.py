"""Tables as versions (K1, K2, K4). A change writes the files of the buckets it touches into a new folder and then adds one small
version file that names the folder of every bucket. Readers follow the newest version file, so they see the table before a change
or after it and never in between; a change that fails leaves files nobody points to, which ``vacuum`` deletes.

    <path>/data/<id>/bucket=<n>/part-…     rows; a folder is written once and never changed
    <path>/versions/<number>.json          key, number of buckets, schema, folder of each bucket
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import sinks


@dataclass(frozen=True)
class Version:
    number: int
    key: str
    buckets: int
    schema: str
    folders: dict[str, str]  # of the buckets that have rows

    @property
    def struct(self) -> StructType:
        return StructType.fromJson(json.loads(self.schema))

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    _, p, fs = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def version_numbers(spark: SparkSession, path: str) -> list[int]:
    return [int(n.removesuffix(".json")) for n in _names(spark, f"{path}/versions") if n[:1].isdigit()]


def version(spark: SparkSession, path: str, number: int | None = None) -> Version:
    """The newest version, or one that is still there."""
    known = version_numbers(spark, path)
    if not known:
        raise FileNotFoundError(f"no table at {path}")
    number = known[-1] if number is None else number
    return Version(**json.loads(spark.read.text(f"{path}/versions/{number:012d}.json", wholetext=True).first()[0]))


def commit(spark: SparkSession, path: str, new: Version) -> Version:
    """Make ``new`` the newest version: its file is written aside and renamed into place. Of two changes that started from the same
    version the second one finds its number taken and raises."""
    jvm, aside, fs = _fs(spark, f"{path}/versions/.{uuid.uuid4().hex}")
    out = fs.create(aside, False)
    out.write(json.dumps(asdict(new)).encode())
    out.close()
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
    files.rename(fs.makeQualified(aside), fs.makeQualified(jvm.org.apache.hadoop.fs.Path(f"{path}/versions/{new.number:012d}.json")), none)
    return new


def read(spark: SparkSession, path: str, at: Version | None = None, only: list[int] | None = None) -> DataFrame:
    """The table at a version (the newest), or only the rows of some buckets."""
    at = at or version(spark, path)
    folders = [f"{path}/{folder}/bucket={b}" for b, folder in at.folders.items() if only is None or int(b) in only]
    return spark.read.schema(at.struct).parquet(*folders) if folders else spark.createDataFrame([], at.struct)


def _written(rows: DataFrame, path: str, at: Version) -> dict[str, str]:
    """Folder of each bucket that has rows."""
    folder = f"data/{uuid.uuid4().hex}"
    sinks.write_bucketed(rows.withColumn("bucket", at.bucket()), f"{path}/{folder}")
    return {n.removeprefix("bucket="): folder for n in _names(rows.sparkSession, f"{path}/{folder}") if n.startswith("bucket=")}


def create(df: DataFrame, path: str, key: str, buckets: int = 64) -> Version:
    """The first version of a table, or a new one with all its rows replaced. Rows with a null key have a bucket as well."""
    if "bucket" in {c.lower() for c in df.columns}:
        raise ValueError("the column name bucket is taken by the layout")
    last = max(version_numbers(df.sparkSession, path), default=0)
    new = Version(last + 1, key, buckets, df.schema.json(), {})
    return commit(df.sparkSession, path, replace(new, folders=_written(df, path, new)))


def _changed(spark: SparkSession, path: str, at: Version, touched: list[int], rows: DataFrame) -> Version:
    kept = {b: folder for b, folder in at.folders.items() if int(b) not in touched}
    return commit(spark, path, replace(at, number=at.number + 1, folders=kept | _written(rows.select(*at.struct.names), path, at)))


def _touched(keys: DataFrame, at: Version) -> list[int]:
    return [r[0] for r in keys.select(at.bucket().alias("b")).distinct().collect()]  # at most ``buckets`` numbers


def replace_children(spark: SparkSession, path: str, parents: DataFrame, children: DataFrame) -> Version:
    """Replace all rows of the given parents (a column of the table's key) by their ``children``; children of other parents are left
    out. Only the buckets that hold a parent are read and written anew."""
    at = version(spark, path)
    parents = parents.select(at.key).distinct()
    touched = _touched(parents, at)
    kept = read(spark, path, at, touched).join(parents, at.key, "left_anti")
    new = children.join(parents, at.key, "left_semi")
    return _changed(spark, path, at, touched, kept.unionByName(new.select(*at.struct.names)))


def upsert(spark: SparkSession, path: str, updates: DataFrame, order: str) -> Version:
    """Merge rows by the table's key, as ``sinks.upsert`` does, in the buckets that hold one of them."""
    at = version(spark, path)
    touched = _touched(updates, at)
    return _changed(spark, path, at, touched, sinks.upsert(read(spark, path, at, touched), updates, [at.key], order))


def insert_ignore(spark: SparkSession, path: str, new: DataFrame, order: Column) -> Version:
    """Add the rows whose key the table lacks, as ``sinks.insert_ignore`` does."""
    at = version(spark, path)
    touched = _touched(new, at)
    return _changed(spark, path, at, touched, sinks.insert_ignore(read(spark, path, at, touched), new, [at.key], order))


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Delete all but the newest ``keep`` versions and the data folders that none of those names (left over by failed changes or old
    versions). Run it while nobody changes the table. Returns the deleted folders."""
    numbers = version_numbers(spark, path)
    held = {f for n in numbers[-keep:] for f in version(spark, path, n).folders.values()}
    gone = [f"data/{n}" for n in _names(spark, f"{path}/data") if f"data/{n}" not in held]
    for name in [*(f"versions/{n:012d}.json" for n in numbers[:-keep]), *gone]:
        _, p, fs = _fs(spark, f"{path}/{name}")
        fs.delete(p, True)
    return gone
