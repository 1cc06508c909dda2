"""Scoring a stream of texts.  Stateless, so exactly the batch plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from textmill.models.scoring import TextClassifier


def read_stream(spark: SparkSession, directory: str, schema, file_glob: str = "*.parquet",
                files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", file_glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(directory)


def score_stream(
    texts: DataFrame, classifier: TextClassifier, sink: str, checkpoint: str,
    text_col: str = "text", once: bool = False,
) -> StreamingQuery:
    """Write scored rows to a parquet folder; ``once`` stops at the end of the
    input that is there now."""
    writer = (
        classifier.score(texts, text_col)
        .writeStream.format("parquet")
        .option("path", sink)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )
    return (writer.trigger(availableNow=True) if once else writer).start()
