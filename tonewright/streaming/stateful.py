"""Streams with state by key: notes over the seams of a model's chunks, and job logs that end.

Both keep little: a track its open notes, a job the number of the event that comes next. What comes too
early waits in the state; what comes twice is known by its number; keys that fall silent are cleared by
timers. The state is Spark's, in RocksDB and checkpoints, so a lost executor loses nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..schema import FRAME_RATE, LEAST_NOTE, TRACK
from .event_log import ENDED, EVENTS

NOTES = "song_id long, track string, program int, pitch int, is_drum boolean, start_s double, end_s double"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def prepare(spark: SparkSession) -> None:
    """The state store that these streams need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def _mode(idle_ms: int | None) -> str:
    return "None" if idle_ms is None else "ProcessingTime"


def _later(handle: StatefulProcessorHandle, now, timer: int, idle_ms: int | None) -> int:
    """Sets the key's timer anew; 0 where there are none."""
    if idle_ms is None:
        return 0
    if timer:
        handle.deleteTimer(timer)
    timer = now.getCurrentProcessingTimeInMs() + idle_ms
    handle.registerTimer(timer)
    return timer


def chunk_events(tokens: list[tuple[str, int]], seek: float, next_seek: float | None) -> tuple[set, list, list]:
    """(keys tied over the chunk's begin, [(program, pitch, time, whether it begins)], [(drum, time)]) of the
    tokens (type, value) of one chunk, in order."""
    closing = next((k for k, (kind, _) in enumerate(tokens) if kind in ("tie", "shift")), None)
    ties, notes, hits = set(), [], []
    if closing is None or tokens[closing][0] != "tie":
        return ties, notes, hits
    program = velocity = None
    begin = round(seek * FRAME_RATE)
    t = begin / FRAME_RATE
    for k, (kind, value) in enumerate(tokens):
        if kind == "program":
            program = value
        elif k < closing:
            if kind == "pitch" and program is not None:
                ties.add((program, value))
        elif kind == "velocity":
            velocity = value
        elif kind == "shift" and value > 0:
            t = (begin + value) / FRAME_RATE
        elif next_seek is not None and t >= next_seek:
            continue  # the next chunk's to tell
        elif kind == "drum":
            hits.append((value, t))
        elif kind == "pitch" and program is not None and velocity is not None:
            notes.append((program, value, t, velocity > 0))
    return ties, notes, hits


class NoteTracker(StatefulProcessor):
    """Chunks of a track in their order, whatever order they arrive in; each must arrive whole."""

    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.next = handle.getValueState("next", "chunk long, timer long")
        self.open = handle.getMapState("open", "program int, pitch int", "start_s double")
        self.early = handle.getMapState("early", "chunk long", "seek double, next_seek double, kinds string, amounts string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.next.get() if self.next.exists() else None
        number, timer = (int(known[0]), int(known[1])) if known else (0, 0)
        if number < 0:  # the track has ended
            return
        for chunk, own in pd.concat(list(rows)).sort_values("i").groupby("chunk"):
            if chunk >= number:
                last = own["next_seek"].iloc[0]
                self.early.updateValue((int(chunk),), (float(own["seek"].iloc[0]), None if pd.isna(last) else float(last), " ".join(own["type"]), " ".join(map(str, own["value"]))))
        out: list[tuple] = []
        while number >= 0 and self.early.containsKey((number,)):
            seek, next_seek, kinds, amounts = self.early.getValue((number,))
            self.early.removeKey((number,))
            out += self._step(list(zip(kinds.split(), map(int, amounts.split()))), seek, next_seek)
            number = -1 if next_seek is None else number + 1
        self.next.update((number, _later(self.handle, timerValues, timer, self.idle_ms)))
        yield self._frame(key, out)

    def _step(self, tokens, seek, next_seek) -> list[tuple]:
        ties, notes, hits = chunk_events(tokens, seek, next_seek)
        held = {tuple(k): v[0] for k, v in self.open.iterator()}
        out = [(128, drum, True, t, t + LEAST_NOTE) for drum, t in hits]
        for k in [k for k in held if k not in ties]:
            # The chunk doesn't tie it on: it ends at the chunk's begin.
            out.append((*k, False, held[k], min([seek, *(t for p, q, t, _ in notes if (p, q) == k)][:2])))
            del held[k]
        for program, pitch, t, begins in notes:
            if (program, pitch) in held:
                out.append((program, pitch, False, held.pop((program, pitch)), t))
            if begins:
                held[program, pitch] = t
        if next_seek is None:
            out += [(*k, False, start, start + LEAST_NOTE) for k, start in held.items()]
            held = {}
        self.open.clear()
        for k, start in held.items():
            self.open.updateValue(k, (start,))
        return out

    def _frame(self, key, out: list[tuple]) -> pd.DataFrame:
        rows = pd.DataFrame(out, columns=["program", "pitch", "is_drum", "start_s", "end_s"])
        rows.insert(0, "track", key[1])
        rows.insert(0, "song_id", key[0])
        return rows

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """A track fell silent: what sounds ends as at a song's end, and nothing is kept."""
        out = [(*k, False, v[0], v[0] + LEAST_NOTE) for k, v in self.open.iterator()]
        for state in (self.next, self.open, self.early):
            state.clear()
        yield self._frame(key, out)

    def close(self) -> None:
        pass


def tracked_stream(events: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """A stream of events (as of ``tokens.tracked_notes``) -> notes as they end. Chunks of a track count from 0
    without a gap; the one without ``next_seek`` is its last. ``idle_ms`` ends and forgets tracks that fall silent; a stream
    with such timers runs on and on, so leave it out with the trigger ``availableNow``."""
    return events.groupBy(*TRACK).transformWithStateInPandas(statefulProcessor=NoteTracker(idle_ms), outputStructType=NOTES, outputMode="Append", timeMode=_mode(idle_ms))


class LiveLog(StatefulProcessor):
    """Events of a job in the order of their numbers, each once, up to the one that ends it."""

    def __init__(self, since: int, idle_ms: int | None):
        self.since, self.idle_ms = since, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.next = handle.getValueState("next", "seq long, timer long")
        self.early = handle.getMapState("early", "seq long", "stage string, message string, part string, notes long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.next.get() if self.next.exists() else None
        number, timer = (int(known[0]), int(known[1])) if known else (0, 0)
        out = []
        clean = lambda x: None if pd.isna(x) else x
        if number >= 0:
            for r in pd.concat(list(rows)).sort_values("seq", kind="stable").itertuples():
                if r.seq >= number and not self.early.containsKey((int(r.seq),)):
                    notes = clean(r.notes)
                    self.early.updateValue((int(r.seq),), (clean(r.stage), clean(r.message), clean(r.part), None if notes is None else int(notes)))
        while number >= 0 and self.early.containsKey((number,)):
            stage, message, part, notes = self.early.getValue((number,))
            self.early.removeKey((number,))
            if number >= self.since:
                out.append((key[0], number, stage, message, part, notes))
            number = -1 if stage in ENDED else number + 1
        if number < 0:  # closed: whatever else has come is refused
            self.early.clear()
        self.next.update((number, _later(self.handle, timerValues, timer, self.idle_ms)))
        yield self._frame(out)

    def _frame(self, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=[c.split()[0] for c in EVENTS.split(", ")]).astype({"notes": "Int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """A job that was silent for so long is forgotten, ended or not."""
        self.next.clear()
        self.early.clear()
        yield self._frame([])

    def close(self) -> None:
        pass


def live_log(events: DataFrame, since: int = 0, idle_ms: int | None = None) -> DataFrame:
    """A stream of events (EVENTS, seq from 0 without a gap) -> each job's from ``since`` on, in order and once,
    up to its end; what comes after the end, or again, is refused for as long as the job is remembered:
    for ``idle_ms`` of silence, or for good (one number a job)."""
    return events.groupBy("job_id").transformWithStateInPandas(statefulProcessor=LiveLog(since, idle_ms), outputStructType=EVENTS, outputMode="Append", timeMode=_mode(idle_ms))
