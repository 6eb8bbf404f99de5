"""Streaming operators: bounded queues, staleness budgets, conversation states, group accumulation."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TRANSITIONS = {"system": "PENDING", "user": "GENERATING", "assistant": "PROCESSING_TOOLS", "tool": "GENERATING"}


def bounded_queue(stream: DataFrame, size: int, key: str = "queue", value: str = "value", order: str = "position") -> DataFrame:
    """A FIFO queue a key that holds `size` values; when full the oldest is dropped. Emits after each batch: produced, dropped, held."""
    kind = stream.schema[key].dataType.simpleString()

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        produced, dropped, held = state.get if state.exists else (0, 0, [])
        held = list(held)
        rows = pd.concat(list(frames)).sort_values(order)
        for v in rows[value]:
            held.append(int(v))
            produced += 1
            if len(held) > size:
                held.pop(0)
                dropped += 1
        state.update((produced, dropped, held))
        yield pd.DataFrame({key: [k[0]], "produced": [produced], "dropped": [dropped], "held": [held]})

    return stream.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, produced long, dropped long, held array<long>", "produced long, dropped long, held array<long>", "update", GroupStateTimeout.NoTimeout)


def in_flight_budget(required: int, threshold: float, sync_steps: int) -> int:
    """Most samples that may be in flight before a version bump."""
    return int(required * (threshold + 1) * sync_steps)


def fresh(stream: DataFrame, current: int, staleness: int, version: str = "version") -> DataFrame:
    """Rows whose version is at most `staleness` behind the current one."""
    return stream.filter(F.col(version) >= current - staleness)


def conversation_states(stream: DataFrame, most_turns: int) -> DataFrame:
    """Replays (conv_id, turn, role) events: conv_id, state, turns after each batch; TERMINATED at most_turns."""

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, turns = state.get if state.exists else ("PENDING", 0)
        for role in pd.concat(list(frames)).sort_values("turn")["role"]:
            if now == "TERMINATED":
                break
            turns += 1
            now = "TERMINATED" if turns >= most_turns else TRANSITIONS.get(role, now)
        state.update((now, turns))
        yield pd.DataFrame({"conv_id": [k[0]], "state": [now], "turns": [turns]})

    return stream.groupBy("conv_id").applyInPandasWithState(run, "conv_id long, state string, turns long", "state string, turns long", "update", GroupStateTimeout.NoTimeout)


def accumulate_groups(stream: DataFrame, path: str, checkpoint: str, keep):
    """Each micro-batch's surviving groups, appended to a table: a query to start; keep filters a batch."""

    def add(batch: DataFrame, _: int) -> None:
        keep(batch).write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_table(stream: DataFrame, name: str, mode: str = "update") -> DataFrame:
    """Runs a stream over what is available and returns its in-memory result: for tests and small replays."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def sessions(stream: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Extension, beyond the reference's surface: events a user's session by event time."""
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour")
    return timed.groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
