"""Unbounded text streams: lines across items with state for each stream, and error routing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LINE = "stream_id long, seq long, text string"
STATE = "pending string, next long"


def split_lines(items: DataFrame, idle_ms: int = 60_000) -> DataFrame:
    """Lines of each stream of text items (stream_id, seq, text); the break stays on its line.

    What follows a stream's last line break waits in its state. A stream has no end here, so the rest is
    emitted when nothing has come for idle_ms. Items of one micro-batch are put in order of seq; streams
    must deliver earlier items in earlier batches.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending, number = state.get if state.exists else ("", 0)
        if state.hasTimedOut:
            state.remove()
            if pending:
                yield pd.DataFrame({"stream_id": [key[0]], "seq": [number], "text": [pending]})
            return
        parts = pd.concat(list(batches)).sort_values("seq")["text"]
        whole = pending + "".join(t for t in parts if t is not None)
        pieces = whole.split("\n")
        lines, pending = [p + "\n" for p in pieces[:-1]], pieces[-1]
        state.update((pending, number + len(lines)))
        state.setTimeoutDuration(idle_ms)
        if lines:
            yield pd.DataFrame({"stream_id": key[0], "seq": range(number, number + len(lines)), "text": lines})

    grouped = items.select("stream_id", "seq", "text").groupBy("stream_id")
    return grouped.applyInPandasWithState(run, LINE, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def route(items: DataFrame, good: Callable[[DataFrame, int], None], bad: Callable[[DataFrame, int], None]):
    """A query writer that hands each batch's good and error items to two sinks, computing the batch once.

    The sinks get the batch number: a sink that overwrites its batch's output makes the pair exactly-once.
    """

    def both(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        try:
            good(kept.where("err is null"), number)
            bad(kept.where("err is not null"), number)
        finally:
            kept.unpersist()

    return items.writeStream.foreachBatch(both)


def file_items(spark, folder: str) -> DataFrame:
    """Lines of text files that arrive in a folder, as items of one stream for each file."""
    rows = spark.readStream.format("text").option("wholetext", "true").load(folder)
    return rows.select(F.abs(F.xxhash64(F.col("_metadata.file_path"))).alias("stream_id"), F.lit(0).cast("long").alias("seq"), F.col("value").alias("text"))
