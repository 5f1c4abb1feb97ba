"""Progress of jobs from their log lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scenetab.functions.session import scratch_path

# phase, pattern with two numbers, what is added to the first; a null-like shift of None means always 1
RULES = [
    ("decode", r"Decoded frame: (\d+) / (\d+)", 0),
    ("keypoints", r"Extracting keypoints and descriptors for image (\d+) / (\d+)", 1),
    ("matching", r"Matching keypoints between image pair: (\d+), (\d+)", None),
    ("depth", r"Estimating mono depthmap: (\d+) / (\d+)", 1),
    ("solve", r"==== # active cameras: (\d+) / (\d+)", 0),
    ("batch", r"Batch: (\d+) / (\d+)", 0),
    ("points", r"# Points: (\d+) / (\d+)", 0),
]


def complete_lines(text: Column) -> Column:
    """The complete lines of a piece of log text; an unfinished last line does not count."""
    parts = F.split(text, "\n")
    return F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))


def line_progress(lines: DataFrame, rules: list[tuple] | None = None) -> DataFrame:
    """Phase and fraction of each line that a rule matches; the largest fraction where several do."""
    hits = []
    for phase, pattern, shift in rules or RULES:
        a, b = (F.regexp_extract("line", pattern, i) for i in (1, 2))
        frac = F.lit(1.0) if shift is None else F.try_divide(a.cast("double") + shift, b.cast("double"))
        hits.append(F.when(F.col("line").rlike(pattern), F.struct(frac.alias("fraction"), F.lit(phase).alias("phase"))))
    best = F.array_max(F.filter(F.array(*hits), lambda h: h.isNotNull()))
    out = lines.withColumn("_h", best).where(F.col("_h").isNotNull())
    return out.select(*lines.columns, F.col("_h.phase").alias("phase"), F.col("_h.fraction").alias("fraction"))


def stream_progress(lines: DataFrame, rules: list[tuple] | None = None) -> DataFrame:
    """Latest phase and fraction per job: the same plan for a table and for a stream in update mode."""
    hit = line_progress(lines, rules)
    latest = F.max_by(F.struct("phase", "fraction", "seq"), "seq").alias("p")
    return hit.groupBy("job").agg(latest).select("job", "p.*")


def run_progress(lines: DataFrame, sink: str, rules: list[tuple] | None = None) -> StreamingQuery:
    """Append the jobs that moved in each batch to a table; ends with the input."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={epoch}")

    return (
        stream_progress(lines, rules).writeStream.outputMode("update").foreachBatch(write)
        .option("checkpointLocation", scratch_path(lines.sparkSession, "progress-state")).trigger(availableNow=True).start()
    )


def latest_progress(table: DataFrame) -> DataFrame:
    """The state per job of a table written by ``run_progress``."""
    latest = F.max_by(F.struct("phase", "fraction", "seq"), "seq").alias("p")
    return table.groupBy("job").agg(latest).select("job", "p.*")
