"""Structured Streaming front end (this library's own extension): new query vectors are searched in a static library."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.retrieve import share, topk_cosine, topk_shared


def search_stream(queries: DataFrame, library: DataFrame, out: str, checkpoint: str, k: int = 100, strategy: str = "auto") -> StreamingQuery:
    """Writes the Top-K of each micro-batch; the search is stateless per query. A batch that is repeated overwrites its own folder.

    A library that can be broadcast is collected once, before the stream starts.
    """
    shared = share(library) if strategy in ("auto", "block") else None
    if shared is None and strategy == "block":
        raise ValueError("the library is too large to broadcast; use partitioned")

    def write(batch: DataFrame, number: int) -> None:
        rows = topk_cosine(batch, library, k, "partitioned") if shared is None else topk_shared(batch, shared, k)
        rows.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return queries.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
