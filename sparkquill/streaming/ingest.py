"""Documents that arrive become segments of an index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from sparkquill.operators.segments import Segments


def index_stream(docs: DataFrame, index: Segments, checkpoint: str, compact_at: int = 16) -> StreamingQuery:
    """Starts a query over a stream of (doc_id, text) that adds each batch to the index as a segment; a batch that Spark repeats after a
    failure is added once, and a document that comes again in a later batch replaces the older one. Segments are merged when there are
    compact_at of them."""

    def write(batch: DataFrame, number: int) -> None:
        index.add(batch, f"{checkpoint}#{number}")
        if len(index.manifest()["segments"]) >= compact_at:
            index.compact()

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
