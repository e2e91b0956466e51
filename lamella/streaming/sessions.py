"""Session memory over a stream of messages: bounded state for each session."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.memory import checked

STATE = "turns long, lines array<string>, users array<boolean>"


def session_memory(messages: DataFrame, max_messages: int = 20, turns: int = 2, max_chars: int = 2000, idle_ms: int | None = None) -> DataFrame:
    """For each session and micro-batch: turns ever, messages held, and the context window after the batch.

    ``messages`` streams session_id, seq, role, content; a role other than user and assistant fails the batch, as in memory.checked.
    State is at most ``max_messages`` lines a session and is dropped after ``idle_ms`` without a message, if given.
    """
    messages = checked(messages)
    output = f"session_id {messages.schema['session_id'].dataType.simpleString()}, total_turns long, held long, context string"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        count, lines, users = state.get if state.exists else (0, [], [])
        lines, users = list(lines), list(users)
        rows = pd.concat(list(batches)).sort_values("seq")
        for role, content in zip(rows["role"], rows["content"], strict=True):
            count += role == "user"
            lines.append(("User: " if role == "user" else "Assistant: ") + content)
            users.append(role == "user")
        lines, users = lines[-max_messages:], users[-max_messages:]
        state.update((int(count), lines, users))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        text = "\n".join(lines[-2 * turns :])
        yield pd.DataFrame({"session_id": [key[0]], "total_turns": [count], "held": [len(lines)], "context": ["..." + text[-max_chars:] if len(text) > max_chars else text]})

    return messages.groupBy("session_id").applyInPandasWithState(step, output, STATE, "update", GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout)
