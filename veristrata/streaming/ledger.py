"""Ledger counts over arriving files of matches. The q sweep needs a global order and stays a batch step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_ledger(psms: DataFrame, ts: str = "ts", group: str = "class", decoy: str = "is_decoy", size: str = "1 day", late: str = "2 days") -> DataFrame:
    """Accepted targets and decoys by event-time window and class; windows close after the watermark."""
    d = F.col(decoy).cast("long")
    w = psms.withWatermark(ts, late).groupBy(F.window(ts, size), group).agg(F.sum(1 - d).alias("n_target"), F.sum(d).alias("n_decoy"))
    return w.select(F.col("window.start").alias("start"), group, "n_target", "n_decoy")


def ledger_to_table(stream: DataFrame, path: str, checkpoint: str):
    """Runs what is there to a parquet table and stops: exactly once by the checkpoint."""
    return stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
