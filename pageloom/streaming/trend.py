"""The trend of scores over a stream of score files: each score's change since its url's last one."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pageloom.functions.text import normal_url

ROWS = "score_file string, pos long, evaluated_at timestamp, url string, parseability_score double"
TREND = "url string, score_file string, pos long, evaluated_at timestamp, parseability_score double, delta double, late boolean"


class LastScore(StatefulProcessor):
    """Holds, for each url, the last score that isn't null and its place in time; two numbers a url, whatever the history."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "score double, at long, score_file string, pos long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(rows).sort_values(["evaluated_at", "score_file", "pos"])
        held = self.last.get() if self.last.exists() else None
        deltas, late = [], []
        for at, file, pos, score in zip(batch["evaluated_at"].astype("datetime64[us]").astype("int64"), batch["score_file"], batch["pos"], batch["parseability_score"], strict=True):
            here = (int(at), file or "", int(pos))
            behind = held is not None and here < tuple(held)[1:]
            known = score == score and score is not None
            deltas.append(score - held[0] if known and held is not None and not behind else None)
            late.append(behind)
            if known and not behind:
                held = (float(score), *here)
        if held is not None:
            self.last.update(tuple(held))
        yield batch.assign(url=key[0], delta=pd.Series(deltas, index=batch.index, dtype="float64"), late=late)[[c.split()[0] for c in TREND.split(", ")]]

    def close(self) -> None:
        pass


def score_stream(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(ROWS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def score_trend(rows: DataFrame) -> DataFrame:
    """Scores with the change since the url's last non-null score, as ``score_history`` has it, as they arrive.

    Rows of one micro-batch are put in order; a row from before what has been seen of its url is ``late`` and has no change.
    The state needs the RocksDB provider (``use_rocksdb``).
    """
    named = rows.withColumn("url", normal_url(F.col("url")))
    return named.groupBy("url").transformWithStateInPandas(LastScore(), outputStructType=TREND, outputMode="append", timeMode="none")


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def append_once(path: str):
    """A foreachBatch writer to a Parquet table by batch: a batch that is replayed replaces what it wrote before.

    The table is partitioned by ``batch``; only the partitions that a write holds are replaced.
    """

    def write(df: DataFrame, batch: int) -> None:
        df.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return write


def write_trend(rows: DataFrame, path: str, checkpoint: str):
    """Starts the trend over what there is (``availableNow``), appended to ``path`` once for each batch."""
    return score_trend(rows).writeStream.foreachBatch(append_once(path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
