"""Quality counters of parcels that arrive as a stream of files: an extension, since the batch analysis has no stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from parcelspark.functions import nicad as nic


def counters(parcels: DataFrame, by: str = "syscol") -> DataFrame:
    """Running counters for each commune: parcels, without identifier, invalid ones. Works on a stream and on a table alike."""
    raw = F.col("nicad_raw")
    return parcels.groupBy(by).agg(F.count("*").alias("parcels"), F.count_if(nic.is_missing(raw) | (F.length(F.trim(raw)) < 8)).alias("missing"), F.count_if(~nic.is_valid(raw)).alias("invalid"))


def start(parcels: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Keeps the counters under ``sink`` in one table per batch, written whole, so that a batch that runs again replaces itself."""

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return counters(parcels).writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(save).start()
