"""Bounded memory of conversations that arrive as a stream, equal to the batch view whatever order messages come in."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stratum.operators.memory import ASSISTANT_CHARS, MESSAGES, TOTAL, USER_CHARS, line_contents


def memory_views(messages: DataFrame, last: int = MESSAGES, total: int = TOTAL, user_chars: int = USER_CHARS, assistant_chars: int = ASSISTANT_CHARS) -> DataFrame:
    """A stream of (conv_id, memory, n_lines), in update mode, of a stream of messages (conv_id, turn, role, text).

    What is kept of a conversation are its last messages, ``last`` at most, cut as the memory cuts them: a bounded state,
    however long it goes on. Each batch gives the new view of every conversation that it touches; one without lines has
    null. Messages may come late; one that is no longer among the last changes nothing. A turn that comes again with
    another text replaces the former.
    """
    cut = messages.select(F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", line_contents(user_chars, assistant_chars).alias("content"))

    def carried(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = dict(json.loads(state.get[0])) if state.exists else {}
        for batch in batches:
            for turn, role, content in zip(batch["turn"], batch["role"], batch["content"], strict=True):
                held[int(turn)] = (role, content)
        kept = sorted(((int(t), tuple(m)) for t, m in held.items()), reverse=True)[:last]
        state.update((json.dumps(kept, ensure_ascii=False),))
        lines, used = [], 0
        for _, (role, content) in kept:
            if role not in ("user", "assistant") or not content:
                continue
            line = ("用户：" if role == "user" else "助手：") + content
            used += len(line)
            if used > total:
                break
            lines.append(line)
        yield pd.DataFrame({"conv_id": [key[0]], "memory": ["\n".join(reversed(lines)) or None], "n_lines": [len(lines)]})

    return cut.groupBy("conv_id").applyInPandasWithState(carried, "conv_id string, memory string, n_lines long", "kept string", "update", GroupStateTimeout.NoTimeout)
