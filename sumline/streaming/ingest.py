"""Continuous reading of cells: whole files arrive, are read as tables and appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..functions.numbers import keep
from ..operators.footing import foot
from ..operators.health import with_health
from ..operators.statements import assemble, read_tables
from ..sources.tables import CELLS


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Read Parquet files of cells as they come into the folder source; append their verdicts to target.

    A batch holds whole files, so a table is complete when it is read. A batch's rows go to a folder of its own number,
    overwritten when the batch is repeated."""

    def batch(cells: DataFrame, number: int) -> None:
        done = with_health(keep(foot(read_tables(assemble(cells))))).select("table_id", "file", "page", "title", "kind", "years", "foots", "foot_by_col", "health")
        done.write.mode("overwrite").parquet(f"{target}/batch={number}")

    writer = spark.readStream.schema(CELLS).parquet(source).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
