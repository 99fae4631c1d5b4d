"""Write leases as keyed streaming state, and progress as a de-duplicated stream.

A lease of an inode has a session, a fence and an expiry (seconds). Requests are
acquire, renew and release:

* acquire by the session that holds a live lease renews it under the same fence;
  on a free or expired lease it takes the next fence; else it is a conflict;
* renew needs the same session and fence, whatever the expiry;
* release clears session and expiry and keeps the fence.

``step`` is the rule of one request; the stream and the batch fold share it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TTL = 300
RESULT = "inode long, seq long, outcome string, fence long, expire_at long"
STATE = "session string, fence long, expire_at long"


def step(state: tuple[str | None, int, int | None], op: str, session: str, fence: int | None, now: int, ttl: int = TTL) -> tuple[tuple[str | None, int, int | None], str]:
    """The state and the outcome after one request at ``now``."""
    held, current, expire = state
    if op == "acquire":
        live = held is not None and expire is not None and expire > now
        if live and held != session:
            return state, "conflict"
        return (session, current if live else current + 1, now + ttl), "renewed" if live else "acquired"
    if held != session or fence != current:
        return state, "conflict"
    if op == "renew":
        return (held, current, now + ttl), "renewed"
    return (None, current, None), "released"


def _run(rows: pd.DataFrame, state: tuple) -> tuple[list[tuple], tuple]:
    out = []
    for r in rows.sort_values(["now", "seq"]).itertuples(index=False):
        state, outcome = step(state, r.op, r.session, None if pd.isna(r.fence) else int(r.fence), int(r.now))
        out.append((r.inode, r.seq, outcome, state[1], state[2]))
    return out, state


COLUMNS = [x.split()[0] for x in RESULT.split(", ")]


def lease_stream(requests: DataFrame) -> DataFrame:
    """Outcomes of a stream of (inode, seq, op, session, fence, now); state is kept by inode.

    State of an inode without a session and idle for a day of processing time
    is dropped, but for its fence, which must never fall back.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def task(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = tuple(state.get) if state.exists else (None, 0, None)
        now = (now[0], int(now[1]), None if now[2] is None or pd.isna(now[2]) else int(now[2]))
        frames = list(batches)
        if frames:
            out, now = _run(pd.concat(frames), now)
            state.update(now)
            frame = pd.DataFrame(out, columns=COLUMNS)
            frame["expire_at"] = frame["expire_at"].astype("Int64")
            yield frame

    return requests.groupBy("inode").applyInPandasWithState(task, RESULT, STATE, "append", GroupStateTimeout.NoTimeout)


def lease_batch(requests: DataFrame) -> DataFrame:
    """The same outcomes for a finished log; requests of one inode are folded in one group.

    A group is one inode's requests: the fold is sequential by nature.
    """

    def task(rows: pd.DataFrame) -> pd.DataFrame:
        out, _ = _run(rows, (None, 0, None))
        frame = pd.DataFrame(out, columns=COLUMNS)
        frame["expire_at"] = frame["expire_at"].astype("Int64")
        return frame

    return requests.groupBy("inode").applyInPandas(task, RESULT)


def progress_stream(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Progress events (chunk_id, seq, ts, progress) once each, within a watermark."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["chunk_id", "seq"])


def expired(leases: DataFrame, now) -> DataFrame:
    """Leases (inode, session, fence, expire_at) that a sweep at ``now`` clears: the expiry itself included."""
    return leases.where(F.col("session").isNotNull() & (F.col("expire_at") <= F.lit(now)))
