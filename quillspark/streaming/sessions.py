"""Gap sessions and repeats of adjacent cues over a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.merging import CUE


def _bare(text: str) -> str:
    return "".join(c for c in text.lower() if c.isalpha() or c.isdigit())


def _alike(a: str, b: str, least: float) -> bool:
    if not a or not b:
        return False
    grams = lambda x: {x} if len(x) <= 3 else {x[i : i + 3] for i in range(len(x) - 2)}
    x, y = grams(a), grams(b)
    return a in b or b in a or len(x & y) / len(x | y) >= least


def streaming_distinct_cues(cues: DataFrame, least: float = CUE) -> DataFrame:
    """(file, idx, text) of a stream of cues (file, idx, text) in order: those that do not repeat the last kept one, of two alike the longer.

    The state of a file is its last kept cue, which goes out when one comes that is not like it, or
    with the file's end, a cue without text.  Cues of one batch are taken in order of idx.
    """

    def keep(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else None
        rows = pd.concat(list(batches)).sort_values("idx")
        out = []
        for idx, text in zip(rows["idx"], rows["text"], strict=True):
            if text is None:
                out += [held] if held else []
                held = None
            elif held and _alike(_bare(text), _bare(held[1]), least):
                held = (int(idx), text) if len(_bare(text)) > len(_bare(held[1])) else held
            else:
                out += [held] if held else []
                held = (int(idx), text)
        if held:
            state.update(held)
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"file": [key[0]] * len(out), "idx": [x[0] for x in out], "text": [x[1] for x in out]})

    return cues.groupBy("file").applyInPandasWithState(keep, "file string, idx long, text string", "idx long, text string", "append", GroupStateTimeout.NoTimeout)


def streaming_sessions(events: DataFrame, gap: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    """(user_id, start, end, n) of sessions that end ``gap`` after their last event.

    Events later than ``lateness`` behind the newest are dropped, which bounds the state.
    """
    marked = events.withWatermark("ts", lateness)
    by = marked.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return by.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
