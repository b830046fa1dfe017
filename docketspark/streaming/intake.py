"""Intake and maintenance on streams."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.readwriter import DataStreamWriter


def first_uploads(uploads: DataFrame, horizon: str = "1 day") -> DataFrame:
    """The first upload of each (bureau, partner, digest) within the horizon.

    A unique constraint never forgets; this does beyond the horizon, so its rows still meet the batch anti-join
    of operators.ingest before they become materials.
    """
    return uploads.withWatermark("arrival", horizon).dropDuplicatesWithinWatermark(["bureau_id", "partner_id", "sha256"])


def every(stream: DataFrame, job: Callable[[DataFrame, int], None], seconds: int = 300) -> DataStreamWriter:
    """Runs job on each micro-batch, one every `seconds`; a late tick runs when the earlier one is done."""
    return stream.writeStream.foreachBatch(job).trigger(processingTime=f"{seconds} seconds")


def passes(spark: SparkSession, job: Callable[[int], None], seconds: int = 300) -> DataStreamWriter:
    """Runs job(tick) every `seconds`, without input; a late tick runs when the earlier one is done.

    A pass that fails is logged and the next tick tries again, so job must start from the tables' state, not from
    what an earlier pass left in memory. The stream itself goes on until it is stopped.
    """

    def tick(_, batch: int) -> None:
        try:
            job(batch)
        except Exception:
            logging.getLogger(__name__).warning("pass %d failed; the next tick tries again", batch, exc_info=True)

    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).option("numPartitions", 1).load()
    return ticks.writeStream.foreachBatch(tick).trigger(processingTime=f"{seconds} seconds")
