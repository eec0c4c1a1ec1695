"""What every operator needs from the session: code on the workers, cut lineage, tables and bounded hot keys."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import weakref
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NullType, StructField, StructType

PACKAGE = Path(__file__).resolve().parent
#: A key with more rows than this is spread over SALTS tasks. The list of such keys has at most rows / HOT_ROWS
#: entries of some 24 bytes, that is, about a millionth of the data it was counted on.
HOT_ROWS = 200_000
SALTS = 64
#: Spark deletes the shuffles of an action when it ends.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_shipped: set[str] = set()
_own_folders: dict[str, str] = {}
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, wherever they run."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    archive = Path(tempfile.mkdtemp()) / f"{PACKAGE.name}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(PACKAGE.parent))
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)


def _shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the cluster's spark.checkpoint.dir, or what the session was given.

    Only a local session (tests, a laptop) gets a folder of its own; a cluster without a shared folder is an error, as
    its nodes would write to different disks.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not (spark.conf.get("spark.master", None) or "local").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if "own" not in _own_folders:
        _own_folders["own"] = tempfile.mkdtemp(prefix="cuts-")
        atexit.register(shutil.rmtree, _own_folders["own"], ignore_errors=True)
    return _own_folders["own"]


def scratch(spark: SparkSession) -> str:
    """The path of a new folder in the shared folder."""
    return f"{_shared_folder(spark)}/tables/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write df as a table to the shared folder and read it back: lineage ends, and lost executors lose nothing.

    Being a table it has its real size for the planner, and only the columns asked for are read again. Columns may have
    any names, repeated ones too; those of type void stay void. The shuffles behind it are deleted once it is written;
    discard() deletes the table itself before the session ends.
    """
    spark, names = df.sparkSession, df.columns
    path = scratch(spark)
    places = [f"c{i}" for i in range(len(names))]
    void = {c for c, f in zip(places, df.schema.fields) if isinstance(f.dataType, NullType)}
    placed = df.toDF(*places)
    cleaned = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        placed.select(F.lit(0).alias("_"), *[c for c in places if c not in void]).write.parquet(path)
    finally:
        spark.conf.unset(CLEAN_UP) if cleaned is None else spark.conf.set(CLEAN_UP, cleaned)
    kept = StructType([StructField(c, f.dataType) for c, f in zip(places, df.schema.fields) if c not in void])
    back = spark.read.schema(kept).parquet(path).select(*[F.lit(None).alias(c) if c in void else c for c in places]).toDF(*names)
    _paths[back] = path
    return back


def discard(df: DataFrame) -> None:
    """Delete a table that cut() wrote; df and what is derived from it can't be read any more."""
    path = _paths.pop(df, None)
    if path is None:
        return
    local = path.removeprefix("file://") if path.startswith("file:") else path
    if os.path.isdir(local):
        shutil.rmtree(local, ignore_errors=True)
        return
    jvm = df.sparkSession.sparkContext._jvm  # Python has no way of its own to a distributed file system
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def salted_join(rows: DataFrame, reps: DataFrame, keys: list[str], count: str, spread: Column) -> DataFrame:
    """Inner join of rows with reps (one row per key, `count` rows behind it), hot keys spread over SALTS tasks.

    keys must not be NULL. The broadcast list of hot keys is bounded as HOT_ROWS states; reps of a hot key are
    repeated SALTS times, all others stay single.
    """
    # the hash holds on to all columns, so that both uses of reps are one plan and its shuffle is done once; should it be
    # 0, a hot key stays unsalted and meets the repetition with salt 0
    hot = reps.where((F.col(count) > HOT_ROWS) & (F.xxhash64(*reps.columns) != 0)).select(*keys, F.lit(True).alias("_hot"))
    salted = rows.join(F.broadcast(hot), keys, "left").withColumn(
        "_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    )
    salts = F.when(F.col(count) > HOT_ROWS, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return salted.drop("_hot").join(reps.withColumn("_salt", F.explode(salts)), [*keys, "_salt"]).drop("_salt")
