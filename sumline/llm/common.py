"""What the corpus operators share: table access and the shared working folder."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lists that record the folders made while they are here; see recorded().
_recorders: list[list[str]] = []


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset a session of one machine gets a temporary one; on a cluster that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not (spark.sparkContext.master or "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='sumline-')}"
        spark.sparkContext.setCheckpointDir(named)
    return named


def remove_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh folder name in the shared folder, removed when the driver's Python ends, if not before."""
    path = f"{shared_dir(spark)}/sumline-{tag}-{uuid.uuid4().hex}"
    for made in _recorders:
        made.append(path)

    def clean() -> None:
        try:
            remove_path(spark, path)
        except Exception:  # the session may be gone already
            pass

    atexit.register(clean)
    return path


@contextlib.contextmanager
def recorded(made: list[str]) -> Iterator[None]:
    """Adds to made the folders that are made inside, so that they can be removed once what they feed is written."""
    _recorders.append(made)
    try:
        yield
    finally:
        _recorders.remove(made)


def stash(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write df as a table in the shared folder and read it back."""
    path = new_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stashed_at = path
    return out


def discard(df: DataFrame) -> None:
    """Remove a table made by stash() that nothing reads any more."""
    remove_path(df.sparkSession, df._stashed_at)


def total_words(docs: DataFrame) -> int:
    """About how many words docs hold: the bytes of their texts by seven."""
    return int(docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0) // 7


def set_aside(df: DataFrame, names: list[str]) -> DataFrame:
    """df with columns that an operator would add itself under other names; put_back() gives them their own again."""
    clashing = {c.lower() for c in names}
    return df.select(*[F.col(f"`{c}`").alias(f"__aside_{c}" if c.lower() in clashing else c) for c in df.columns])


def put_back(df: DataFrame, columns: list[str]) -> DataFrame:
    """Those columns of df, under their own names where they were set aside."""
    held = set(df.columns)
    return df.select(*[F.col(f"`__aside_{c}`").alias(c) if f"__aside_{c}" in held else F.col(f"`{c}`") for c in columns])
