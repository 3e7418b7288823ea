"""Pick up new result files since the last run.

The file source's checkpoint remembers which files were read, so a run over a tree with a
million old results lists them but parses only what is new.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tabgauge.sources.run_records import FILE_SCHEMA, RECORD_FILES, _parsed, flatten_records, limit_folds


def stream_records(spark: SparkSession, root: str, max_folds: int | None = None, max_splits: int | None = None, file_name: str = RECORD_FILES) -> DataFrame:
    """Streaming twin of ``read_run_records``."""
    raw = (
        spark.readStream.schema(FILE_SCHEMA)
        .option("multiLine", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", file_name)
        .json(root)
    )
    records = limit_folds(_parsed(raw), max_folds, max_splits)
    return records.filter("run_config is not null and info is not null")


def ingest_new_results(spark: SparkSession, root: str, output: str, checkpoint: str, **limits) -> StreamingQuery:
    """Append the fact rows of all new files to ``output`` (parquet by method and task) and stop."""
    facts = flatten_records(stream_records(spark, root, **limits))
    query = (
        facts.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .partitionBy("method", "task_id")
        .trigger(availableNow=True)
        .start(output)
    )
    query.awaitTermination()
    return query
