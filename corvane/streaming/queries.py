"""Source-1 rows as a stream, matched against fixed targets.

Each micro-batch is blocked against the kept target keys; targets and their
pruning don't depend on the batch, so results equal those of one batch run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from corvane.operators import blocking


def candidates_of_stream(queries: DataFrame, target_keys: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, k: int = blocking.TOP_K, max_block: int = blocking.MAX_BLOCK) -> StreamingQuery:
    """Starts a query that hands each batch's ranked candidates to ``sink``.

    ``target_keys`` should be a written table: it is read again by each batch.
    """

    def batch(rows: DataFrame, number: int) -> None:
        found = blocking.keys(blocking.normalized(rows))
        sink(blocking.top_k(blocking.scored(found, target_keys, max_block=max_block), k), number)

    return queries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
