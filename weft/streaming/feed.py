"""A stream of changes folded into a change log (an extension: the engine itself has no streams)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from weft.functions.ids import plain_entry_key
from weft.operators.changelog import ChangeLog


class ChangeFeed:
    """Each micro-batch becomes a run. A batch that is given again after a failure changes nothing: runs are merged by
    key and sequence number, so neither order nor repetition matters."""

    def __init__(self, log: ChangeLog):
        self.log = log

    def start(self, entries: DataFrame, checkpoint: str) -> StreamingQuery:
        """``entries``: a stream of entry_key, op, lsn, payload, arrived_at."""

        def fold(batch: DataFrame, epoch: int) -> None:
            self.log.append(batch.select(plain_entry_key("entry_key").alias("key"), "op", batch.lsn.alias("seq"), "payload", "arrived_at"))

        return entries.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
