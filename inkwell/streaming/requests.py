"""Search requests as a stream: every micro-batch of queries is answered against a saved index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from inkwell.operators import search
from inkwell.operators.index import Index

REQUEST = "query_id bigint, query string, mode string"


def answer_stream(requests: DataFrame, index: Index, sink: str, checkpoint: str, k: int = search.TOP, **trigger) -> StreamingQuery:
    """Append the best documents of each request to the Parquet folder ``sink``.

    ``requests`` is a streaming DataFrame of ``query_id, query, mode``.  A
    batch is written to a folder of its own, so a batch that is run again
    after a failure replaces its first attempt.
    """

    def answer(batch: DataFrame, number: int) -> None:
        search.top(search.scores(index, batch), k).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return requests.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
