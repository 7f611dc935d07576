"""Reference counts kept up to date from a stream of change files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from siltstone.operators.references import COUNTS, merge_counts
from siltstone.session import written
from siltstone.streaming.state import Table

COUNTS_SCHEMA = "object_key string, n_refs bigint, n_exists bigint, n_present bigint, first_ref_at timestamp_ntz, stored_at timestamp_ntz"


def follow(deltas: DataFrame, counts: Table, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Merges a stream of signed counts (see ``operators.references``) into ``counts``, one commit per micro-batch.

    Only keys of the micro-batch are read and written. The batch's number is committed with its rows, so a batch that is
    delivered again after a failure is merged once. Keys whose counts are all zero go.
    """
    def merge(batch: DataFrame, number: int) -> None:
        state = counts.state
        if state.marks().get("batch", -1) >= number:
            return
        new = merge_counts(batch.select(*COUNTS).where("object_key is not null"))
        old = counts.read().join(new.select("object_key"), "object_key", "left_semi")
        rows = written(merge_counts(old, new))
        zero = "n_refs = 0 and n_exists = 0 and n_present = 0"
        state.commit(puts={counts.name: rows.where(f"not ({zero})")}, deletes={counts.name: rows.where(zero)}, marks={"batch": number})

    writer = deltas.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
