"""Paragraphs of bounded size from a stream of cues, the same as from the whole."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.sessions import GAP_MS, MOST_CHARS

#: A short paragraph that is nothing but a bracketed remark.
REMARK = re.compile(r"^\s*[\[(（【][^\])）】]*[\])）】]\s*\Z")
OUT = "file string, para long, start_ms long, end_ms long, chars long, cue_count long, text string"


def streaming_capped_sessions(cues: DataFrame, gap_ms: int = GAP_MS, most: int = MOST_CHARS) -> DataFrame:
    """The paragraphs of :func:`..operators.sessions.capped_sessions` from a stream of cues (file, idx, start_ms, end_ms, text).

    Cues of a file are numbered from 0 without gaps and may come in any order; one without text ends
    the file.  The state of a file is its open paragraph and the cues that came before their turn; a
    paragraph goes out as soon as a cue shows that it is whole.  Cues that were already taken are passed over.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        following, paras, waiting, open_ = (*state.get[:2], json.loads(state.get[2]), json.loads(state.get[3])) if state.exists else (0, 0, {}, None)
        for rows in batches:
            for idx, start, end, text in zip(rows["idx"], rows["start_ms"], rows["end_ms"], rows["text"], strict=True):
                if idx >= following:
                    waiting[str(int(idx))] = [None if pd.isna(start) else int(start), None if pd.isna(end) else int(end), text]
        out: list[tuple] = []

        def close() -> None:
            nonlocal paras, open_
            if open_ and not (len(text := " ".join(open_["texts"])) < 12 and REMARK.match(text)):
                out.append((key[0], paras, open_["start"], open_["end"], len(text), len(open_["texts"]), text))
                paras += 1
            open_ = None

        while (cue := waiting.pop(str(following), None)) is not None:
            following += 1
            start, end, text = cue
            if text is None:
                close()
                continue
            if open_ and (None not in (start, open_["end"]) and start - open_["end"] > gap_ms or open_["held"] + 1 + len(text) > most):
                close()
            if open_:
                open_ |= {"end": end, "held": open_["held"] + 1 + len(text), "texts": [*open_["texts"], text]}
            else:
                open_ = {"start": start, "end": end, "held": len(text), "texts": [text]}
        state.update((following, paras, json.dumps(waiting), json.dumps(open_)))
        yield pd.DataFrame(out, columns=["file", "para", "start_ms", "end_ms", "chars", "cue_count", "text"])

    return cues.groupBy("file").applyInPandasWithState(step, OUT, "following long, paras long, waiting string, open string", "append", GroupStateTimeout.NoTimeout)
