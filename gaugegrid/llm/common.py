"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: White space of the data contract, as a string and as the inside of a regular expression class.
SPACE = " \t\n\x0b\x0c\r"
SPACE_CLASS = "\\x20\\x09-\\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a temporary one where all run on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="gaugegrid-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Folders that were written since :func:`tidied` began, in this thread.
_WRITTEN: ContextVar[list[str] | None] = ContextVar("written", default=None)


def saved(df: DataFrame) -> DataFrame:
    """The rows written once to the shared folder and read back: later steps neither repeat the work nor depend on executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/gaugegrid-{uuid.uuid4().hex}"
    df.write.parquet(path)
    written = _WRITTEN.get()
    if written is not None:
        written.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def delete_folder(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def discard(*tables: DataFrame | None) -> None:
    """Delete what :func:`saved` wrote for these tables; nothing that is still to run may read them."""
    for df in tables:
        path = df and df.__dict__.get("_saved_at")
        if path:
            delete_folder(df.sparkSession, path)


def tidied(build: Callable[[], DataFrame]) -> DataFrame:
    """The saved result of ``build``; all else that was saved on the way is deleted."""
    outer = _WRITTEN.set([])
    try:
        out = saved(build())
        for path in _WRITTEN.get()[:-1]:
            delete_folder(out.sparkSession, path)
        return out
    finally:
        _WRITTEN.reset(outer)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; texts of ASCII alone take the cheaper built-in."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def bare(text: Column) -> Column:
    """The text without any white space of the contract."""
    return F.regexp_replace(text, f"[{SPACE_CLASS}]+", "")


def words_of(text: Column) -> Column:
    """Array of the runs of other characters than white space; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{SPACE_CLASS}]+"))


def keep_rows(docs: DataFrame, kept: DataFrame, by: str = "doc_id") -> DataFrame:
    """The rows whose key is in ``kept`` (one row per key), null keys included; all columns stay as they are."""
    key = f"__key_{uuid.uuid4().hex[:8]}"
    return docs.join(kept.select(F.col(by).alias(key)), docs[by].eqNullSafe(F.col(key)), "left_semi")
