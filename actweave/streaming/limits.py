"""Sliding-window rate limits, where whether a request counts depends on those accepted before it.

Batch and stream share one rule: a request is refused during a cool-down, or if its key has `most` accepted requests in the `window` before it; a refusal
starts the cool-down of its key if there is one. The state of a key is bounded by `most` instants.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


@dataclass(frozen=True)
class Limit:
    most: int = 5
    window: float = 3600.0
    cooldown: float = 0.0


def decide(times: list[float], limit: Limit, accepted: list[float], until: float) -> tuple[list[bool], list[float], float]:
    """(accepted or not, instants still in the window, end of the cool-down) for sorted instants in seconds."""
    out = []
    for t in times:
        accepted = [a for a in accepted if a > t - limit.window]
        ok = t >= until and len(accepted) < limit.most
        if ok:
            accepted.append(t)
        elif t >= until and limit.cooldown:
            until = t + limit.cooldown
        out.append(ok)
    return out, accepted, until


def _seconds(ts: pd.Series) -> list[float]:
    return (ts.astype("datetime64[us]").astype("int64") / 1e6).tolist()


def limited(requests: DataFrame, limit: Limit) -> DataFrame:
    """requests(key, ts, id) → (key, ts, id, accepted) of a finished table; a key's requests are read in order of time, then id, batch by batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, ([], float("-inf"))
        for b in batches:
            b = b.copy()
            ok: list[bool] = []
            for k, own in b.groupby(b["key"].ne(b["key"].shift()).cumsum(), sort=False):
                if own["key"].iloc[0] != key:
                    key, state = own["key"].iloc[0], ([], float("-inf"))
                found, *state = decide(_seconds(own["ts"]), limit, *state)
                ok += found
            b["accepted"] = ok
            yield b

    kinds = ", ".join(f"{c} {requests.schema[c].dataType.simpleString()}" for c in ("key", "ts", "id"))
    return requests.select("key", "ts", "id").repartition("key").sortWithinPartitions("key", "ts", "id").mapInPandas(run, f"{kinds}, accepted boolean")


def limited_stream(requests: DataFrame, limit: Limit) -> DataFrame:
    """The same over a stream; a key's state is dropped when it has been silent for a window and a cool-down."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        accepted, until = ([], float("-inf"))
        if state.exists:
            held, until = state.get
            accepted = list(held)
        rows = pd.concat(list(batches)).sort_values(["ts", "id"])
        ok, accepted, until = decide(_seconds(rows["ts"]), limit, accepted, until)
        state.update((accepted, until))
        state.setTimeoutDuration(int(1000 * (limit.window + limit.cooldown)) + 1000)
        yield pd.DataFrame({"key": key[0], "ts": rows["ts"], "id": rows["id"], "accepted": ok})

    kinds = ", ".join(f"{c} {requests.schema[c].dataType.simpleString()}" for c in ("key", "ts", "id"))
    return requests.groupBy("key").applyInPandasWithState(run, f"{kinds}, accepted boolean", "held array<double>, until double", "append", GroupStateTimeout.ProcessingTimeTimeout)
