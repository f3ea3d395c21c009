"""State kept from a stream: each micro-batch is upserted by key, and latest attempts are held by event time.

An extension beyond the batch pipeline, over the same operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import state
from ..sources.files import current, swap_in


def upsert_stream(blocks: DataFrame, path: str, checkpoint: str, empty: Callable[[], DataFrame]) -> StreamingQuery:
    """Applies every micro-batch of blocks to the table at `path` (read it by current()); a repeated batch changes nothing, as the upsert is idempotent."""

    def apply(batch: DataFrame, _: int) -> None:
        old = current(batch.sparkSession, path)
        old = empty() if old is None else old
        latest = state.last_written(batch, ["page_no", "block_index"], "seq").drop("seq") if "seq" in batch.columns else batch
        swap_in(state.upsert_blocks(old, latest), path)

    return blocks.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_attempts(qa: DataFrame, at: str = "ts", late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """The last attempt of each (page_no, kind) in windows of event time; state goes as the watermark passes."""
    return (
        qa.withWatermark(at, late).groupBy(F.window(at, window), "page_no", "kind")
        .agg(F.max(F.struct("attempt", "passed")).alias("r")).select("window", "page_no", "kind", "r.*")
    )
