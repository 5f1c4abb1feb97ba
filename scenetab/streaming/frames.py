"""Frame records as a stream: mapped by a user function, written in order."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scenetab.functions.session import scratch_path

PACKETS = "stream STRING, seq BIGINT, is_video BOOLEAN, value DOUBLE"


def map_frames(packets: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """Apply ``fn`` to batches of video rows; other rows pass unchanged. Works on streams and tables."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            video = pdf["is_video"].to_numpy(bool)
            done = fn(pdf[video]) if video.any() else pdf[video]
            yield pd.concat([done, pdf[~video]])[list(pdf.columns)]

    return packets.mapInPandas(run, packets.schema)


def number_frames(packets: DataFrame, stream: str = "stream", order: str = "seq") -> DataFrame:
    """Only video rows advance the frame number; packets before the first frame keep -1."""
    from scenetab.functions.scan import running

    one = F.when(F.col("is_video"), F.lit(1.0)).otherwise(F.lit(0.0))
    out = running(packets, [stream], order, one, "_n")
    number = F.when(F.col("is_video"), F.col("_n")).otherwise(F.col("_n") - 1)
    return out.withColumn("frame_idx", number.cast("bigint")).drop("_n")


def stream_frames(
    spark: SparkSession, source: str, sink: str, fn: Callable[[pd.DataFrame], pd.DataFrame], files_per_trigger: int = 16, schema: str = PACKETS
) -> StreamingQuery:
    """Map a folder of packet files into ordered output folders, one per batch; ends with the input."""
    packets = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source)

    def write(batch: DataFrame, epoch: int) -> None:
        ordered = batch.repartitionByRange("stream", "seq").sortWithinPartitions("stream", "seq")
        ordered.write.mode("overwrite").parquet(f"{sink}/batch={epoch}")

    return (
        map_frames(packets, fn).writeStream.foreachBatch(write)
        .option("checkpointLocation", scratch_path(spark, "frames")).trigger(availableNow=True).start()
    )
