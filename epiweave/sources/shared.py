"""Folders that driver and executors share, and tables staged in them."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_base(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where that is unset: a temporary folder on local masters, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = getattr(spark, "_epiweave_dir", None)
        if base is None:
            base = spark._epiweave_dir = tempfile.mkdtemp(prefix="spark-epiweave-")
    return base.rstrip("/")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared one."""
    return f"{shared_base(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def file_system(spark: SparkSession, path: str):
    """(Hadoop path, its file system)."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def create_file(spark: SparkSession, path: str, text: str) -> bool:
    """Creates a small file unless it is there; tells whether it did."""
    place, fs = file_system(spark, path)
    try:
        out = fs.create(place, False)
    except Py4JJavaError as taken:
        if "AlreadyExists" in taken.java_exception.getClass().getName() or "already exists" in str(taken.java_exception.getMessage()):
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet in a shared folder and read it back: cuts the lineage, survives lost executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged = path
    return out


def unstage(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing will read again."""
    for t in tables:
        place, fs = file_system(t.sparkSession, t._staged)
        fs.delete(place, True)


def fingerprint(rows: DataFrame) -> str:
    """A digest of a table's rows in any order, of its column names and types."""
    names = sorted(rows.columns)
    one = F.xxhash64(*names)
    n, low, both = rows.agg(F.count("*"), F.sum(F.pmod(one, F.lit(1 << 31))), F.bit_xor(one)).first()
    return hashlib.sha256(f"{[(c, rows.schema[c].dataType.simpleString()) for c in names]} {n} {low} {both}".encode()).hexdigest()[:16]


def stored(spark: SparkSession, name: str, key: str, write: Callable[[str], None]) -> str:
    """The folder that `write` filled for this name and key, now or before, by this application or another.

    A folder counts once its note is created; of two that write at once, the first note stands.
    """
    note = f"{shared_base(spark)}/stored/{name}-{key}.note"
    place, fs = file_system(spark, note)
    if not fs.exists(place):
        path = shared_dir(spark, f"stored/{name}")
        write(path)
        create_file(spark, note, path)
    return spark.read.text(note, wholetext=True).first()[0]
