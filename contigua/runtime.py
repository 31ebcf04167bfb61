"""Session helpers shared by operators: shared scratch folder, materialised tables, shipping the package."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a temporary one takes its
    place, but only if driver and executors are one process (tests); on a cluster that is an error."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if jvm_dir.isDefined():
        return str(jvm_dir.get()).rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    own = tempfile.mkdtemp(prefix="contigua-checkpoints-")
    spark.sparkContext.setCheckpointDir(own)
    return f"file://{own}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/contigua/{name}-{uuid.uuid4().hex[:12]}"


@contextlib.contextmanager
def without_shuffles(spark: SparkSession) -> Iterator[None]:
    """What is run meanwhile leaves no shuffle files: else they stay until the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def materialize(df: DataFrame, name: str, path: str | None = None, tidy: bool = False) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts lineage and survives lost executors.

    ``tidy``: its shuffles are deleted as soon as it is written."""
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    with without_shuffles(spark) if tidy else contextlib.nullcontext():
        df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def write_in_order(parts: list[DataFrame], path: str) -> None:
    """Write tables of one column ``value`` as text files whose names sort by table. Tasks of a union stand in the order of
    its tables, each file is one task's, and no row moves for it."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows.write.mode("overwrite").text(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a table that ``materialize`` gave, once nothing reads it any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(df._scratch)
    path.getFileSystem(conf).delete(path, True)


#: Keys that ``join_unique`` sends to every task at most, and the fewest rows of a key that are worth it.
HOT_KEYS, HOT_ROWS = 1000, 100_000


def join_unique(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``left`` joined (inner or left) to ``right``, in which ``key`` is unique; ``left`` should be a written table.

    Keys that hold more than one in ``HOT_KEYS`` of the rows of ``left`` can't be more than ``HOT_KEYS``: their rows of
    ``right`` are broadcast. All others meet in a merge join, so that no broadcast grows with the data.
    """
    rows = left.count()
    least = max(rows // HOT_KEYS, HOT_ROWS)
    hot = [r[0] for r in left.groupBy(key).count().filter(F.col("count") > least).select(key).collect()] if rows > least else []
    if not hot:
        return left.join(right.hint("merge"), key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    few = left.filter(is_hot).join(F.broadcast(right.filter(is_hot)), key, how)
    return left.filter(~is_hot).join(right.filter(~is_hot).hint("merge"), key, how).unionByName(few)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application (``addPyFile``)."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    root = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="contigua-ship-"), "contigua.zip")
    with zipfile.ZipFile(out, "w") as z:
        for folder, _, files in os.walk(root):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join("contigua", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(out)
