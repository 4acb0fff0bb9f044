"""Indexing as a stream: new files of documents become postings, batch by batch, each file once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions.text import STOP_WORDS
from ..operators.index import build_postings, corpus_from_documents


def index_stream(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, stop=STOP_WORDS) -> StreamingQuery:
    """Reads the Parquet files in ``source`` that were not read yet, appends their postings to ``target`` and ends.

    ``checkpoint`` remembers the files; a batch that fails is written again under its own number, so each is stored once.
    """

    def write(batch: DataFrame, number: int) -> None:
        build_postings(corpus_from_documents(batch), stop).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
