"""Block maxima of a stream, an extension: the reference has none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def block_maxima(stream: DataFrame, station: str, ts: str, value: str, block: str = "1 day", late: str = "1 day") -> DataFrame:
    """(station, block_start, ams) of positive values; a block is final when the watermark
    has passed its end, and rows that come later than ``late`` are dropped."""
    rows = stream.where(F.col(value) > 0).withWatermark(ts, late)
    found = rows.groupBy(F.col(station).alias("station"), F.window(ts, block).alias("w")).agg(F.max(value).alias("ams"))
    return found.select("station", F.col("w.start").alias("block_start"), "ams")


def final_blocks(stream: DataFrame, station: str, ts: str, value: str, path: str, block: str = "1 day", late: str = "1 day") -> DataFrame:
    """Writes the blocks that are final to ``path``, with the stream's checkpoint beside it,
    until what is there now has been read; a later call goes on from there.  Both are to be in
    a folder that the cluster shares."""
    blocks = block_maxima(stream, station, ts, value, block, late)
    blocks.writeStream.format("parquet").option("path", f"{path}/blocks").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(blocks.schema).parquet(f"{path}/blocks")
