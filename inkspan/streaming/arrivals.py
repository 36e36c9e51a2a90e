"""Units that arrive over time: passages packed as they come, and sessions of
events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PASSAGE = "book string, passage long, first_seq long, last_seq long, units long, tokens long"
_STATE = "passage long, first_seq long, last_seq long, units long, tokens long"


def incremental_passages(units: DataFrame, passage_tokens: int = 1200) -> DataFrame:
    """Greedy passages of a stream of units (book, seq, n_tokens): each is sent when
    it reaches its tokens; what is open is kept as five numbers a book.

    A closed passage can't take back a short tail, so the tail stays open here,
    where the batch operator would join it to the passage before."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        passage, first, last, n, total = state.get if state.exists else (0, -1, -1, 0, 0)
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for seq, tokens in zip(rows["seq"], rows["n_tokens"], strict=True):
            first, last, n, total = (seq if n == 0 else first), seq, n + 1, total + tokens
            if total >= passage_tokens:
                out.append((key[0], passage, first, last, n, total))
                passage, first, last, n, total = passage + 1, -1, -1, 0, 0
        state.update((int(passage), int(first), int(last), int(n), int(total)))
        if out:
            yield pd.DataFrame(out, columns=["book", "passage", "first_seq", "last_seq", "units", "tokens"])

    return units.select("book", "seq", "n_tokens").groupBy("book").applyInPandasWithState(step, _PASSAGE, _STATE, "append", "NoTimeout")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a user's events; on a stream, late events are dropped after
    ``late``.  The same expression runs on a table."""
    seen = events.withWatermark("ts", late) if events.isStreaming else events
    by = seen.groupBy("user_id", F.session_window("ts", gap).alias("s"))
    return by.agg(F.count("*").alias("events"), F.sum("value").alias("value")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "events", "value")
