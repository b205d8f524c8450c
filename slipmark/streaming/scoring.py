"""Score each new file of a growing response log once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from slipmark.functions.text import number_scorer
from slipmark.operators.aggregates import scored_rows, summary_columns
from slipmark.plans.scoring import Scorer
from slipmark.sources.logs import stream_log


def incremental_scoring(
    spark: SparkSession,
    log_path: str,
    schema: StructType | None,
    out_path: str,
    checkpoint: str,
    by: list[str],
    scorer: Scorer = number_scorer,
    files_per_batch: int = 1000,
) -> StreamingQuery:
    """Score the log files that are new since the last run, and stop. With a ``schema`` they are Parquet, else CSV logs.

    Each batch writes its summary rows to a folder of its own number. A batch that is tried again after a failure
    overwrites that folder, so every file counts once.
    """

    def score(batch: DataFrame, batch_id: int) -> None:
        summary = scored_rows(batch, scorer).groupBy(*by).agg(*summary_columns())
        summary.write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")

    if schema is None:
        stream = stream_log(spark, log_path, files_per_batch=files_per_batch)
    else:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(log_path)
    return (
        stream.writeStream.foreachBatch(score)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
