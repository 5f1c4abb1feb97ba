"""Exponential averages kept as state of a stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from scenetab.operators.series import moving_average

STATE = "smooth DOUBLE"
OUTPUT = "run STRING, step BIGINT, smooth DOUBLE"


def averages(values: np.ndarray, keep: float) -> np.ndarray:
    """x[0] = v[0], x[i] = keep * x[i-1] + (1 - keep) * v[i]; a NaN makes all that follow NaN."""
    out = pd.Series(values).ewm(alpha=1.0 - keep, adjust=False).mean().to_numpy().copy()
    out[np.logical_or.accumulate(np.isnan(values))] = np.nan
    return out


class Smoother(StatefulProcessor):
    """One number per series; rows of a batch are taken in order of step.

    A run's rows of one micro-batch meet in a task, so the source's ``maxFilesPerTrigger`` bounds what it holds. ``run_ewma`` has no
    such bound.
    """

    def __init__(self, keep: float):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("smooth", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values("step")
        loss = pdf["loss"].to_numpy("float64")
        if self.state.exists():
            smooth = averages(np.concatenate([[self.state.get()[0]], loss]), self.keep)[1:]
        else:
            smooth = averages(loss, self.keep)
        self.state.update((float(smooth[-1]),))
        yield pd.DataFrame({"run": key[0], "step": pdf["step"].to_numpy(), "smooth": smooth})

    def close(self) -> None:
        pass


def stream_ewma(series: DataFrame, keep: float = 0.9) -> DataFrame:
    """Running average of (run, step, loss) rows as they arrive."""
    return series.groupBy("run").transformWithStateInPandas(
        statefulProcessor=Smoother(keep), outputStructType=OUTPUT, outputMode="Append", timeMode="None"
    )


def run_ewma(series: DataFrame, out: str, checkpoint: str, keep: float = 0.9) -> StreamingQuery:
    """Running averages of (run, step, loss) rows, written to ``<out>/rows`` batch by batch, for batches of any size.

    The state is one number per run in ``<out>/state``. A batch goes on from the state that the batch before it left; its rows are
    cut into segments that are composed by ``moving_average``, so no task holds a run. A batch that is repeated overwrites its own
    rows and state.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark, kind = batch.sparkSession, "run string, smooth double"
        before = spark.read.schema(kind).parquet(f"{out}/state/batch={number - 1}") if number else spark.createDataFrame([], kind)
        moving_average(batch, "run", "step", "loss", keep, start=before).select("run", "step", "smooth").write.mode("overwrite").parquet(f"{out}/rows/batch={number}")
        rows = spark.read.schema("run string, step bigint, smooth double").parquet(f"{out}/rows/batch={number}")
        last = rows.groupBy("run").agg(F.max_by("smooth", "step").alias("smooth"))
        rest = before.join(last, "run", "left_anti")
        last.unionByName(rest).write.mode("overwrite").parquet(f"{out}/state/batch={number}")

    return series.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
