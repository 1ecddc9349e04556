"""Postings of documents that keep arriving.

Postings need nothing but their own document, so the batch plan serves a stream as it is: no state, no watermark. Ids must
be given by the source, as the order of arrival is not known to a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from glyphmill.config import IndexConfig
from glyphmill.operators.index import describe, postings, stored_documents, write_postings


def postings_stream(corpus: DataFrame, config: IndexConfig) -> DataFrame:
    """Streaming postings of a streaming corpus with doc_id."""
    return postings(corpus, config)


def append_index(corpus: DataFrame, config: IndexConfig, path: str, checkpoint: str) -> StreamingQuery:
    """Append each micro-batch to the index at `path`; a batch written twice after a failure replaces itself.

    The batches lie beside each other as folders of the same layout as a saved index has, so SearchIndex.load opens them.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        stored_documents(batch, config).write.mode("overwrite").parquet(f"{path}/documents/batch={number}")
        write_postings(postings(batch, config), f"{path}/postings/batch={number}")
        describe(batch.sparkSession, path, config.metadata_fields)
        batch.unpersist()

    return corpus.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
