"""Documents that land as a stream, added to an index batch by batch; a batch that is run again counts once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lakeloom.operators import bm25, growing


def run(stream: DataFrame, folder: str, checkpoint: str, id_col: str, text_col: str, params: bm25.Params | None = None, once: bool = True) -> StreamingQuery:
    """Adds a stream's documents to the index in a folder; with `once` what is there now, then it ends.

    A batch is known by the query's id, which stands in its checkpoint, and its number: another stream, or one that starts
    anew, adds its own batches to the same index. One stream at a time writes to a folder.
    """

    def batch(docs: DataFrame, number: int) -> None:
        query = docs.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        growing.add(docs, folder, f"{query}/{number}", id_col, text_col, params)

    w = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime="5 seconds")).start()
