"""Tables that cut lineage, in the folder shared by all executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset, one of our own, in a local session only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="siltstone-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_folder(spark: SparkSession) -> str:
    """A fresh folder below the shared one, deleted when the driver ends."""
    at = f"{shared_folder(spark)}/siltstone-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_clean)
    _made.append((spark, at))
    return at


def _clean() -> None:
    for spark, at in _made:
        try:
            drop_folder(spark, at)
        except Exception:  # noqa: BLE001 - the session may be gone
            pass


def drop_folder(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def names_in(spark: SparkSession, at: str) -> list[str]:
    """Names of the files in a folder; none where there is no such folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []


def new_file(spark: SparkSession, at: str) -> bool:
    """Makes an empty file (and its folders); False where it is there already."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path.getParent())
    return fs.createNewFile(path)


def new_text(spark: SparkSession, at: str, text: str) -> bool:
    """Writes a small file that nobody ever sees half of; False where it is there already."""
    draft, path = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (f"{at}.{uuid.uuid4().hex}", at))
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path.getParent())
    out = fs.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.exists(path) and fs.rename(draft, path):
        return True
    fs.delete(draft, False)
    return False


def get_text(spark: SparkSession, at: str) -> str:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    f = path.getFileSystem(spark._jsc.hadoopConfiguration()).open(path)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(f, "UTF-8")
    finally:
        f.close()


def written(df: DataFrame, at: str | None = None) -> DataFrame:
    """``df`` written as a table and read back: later steps start from files, not from the lineage."""
    spark = df.sparkSession
    at = at or new_folder(spark)
    df.write.mode("overwrite").parquet(at)
    back = spark.read.schema(df.schema).parquet(at)
    back._written_at = at
    return back


def discard(df: DataFrame) -> None:
    """Deletes what ``written`` wrote for ``df``, once nothing reads it any more."""
    drop_folder(df.sparkSession, df._written_at)
