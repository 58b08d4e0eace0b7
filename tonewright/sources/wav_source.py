"""A Spark data source ``wav``: blocks of samples of WAV files, of the section that a query asks for.

    spark.dataSource.register(WavSource)
    spark.read.format("wav").load("/music").where("t0 >= 60 AND t0 < 70")

PCM can be read from anywhere, so a file is dealt out as ranges of whole blocks, SECONDS each, over
tasks, and comparisons of ``t0``, ``channel`` and ``path`` with constants decide which ranges are read at all
(``spark.sql.python.filterPushdown.enabled``). Headers are read where the query is planned, a few
hundred bytes a file. Files are opened by Arrow's file systems: local paths and the stores it knows.

Cases: files that aren't readable PCM give no rows unless the option ``strict`` is true; a file cut short
gives the samples that it has; a block never crosses files, the last one of a file is shorter.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from .stores import listed, store_of
from .wav import BLOCK, BLOCKS, samples

SECONDS = 30.0  # of sound in a task


@dataclass
class Sound:
    """Where a file's samples lie."""

    path: str
    rate: int
    channels: int
    width: int
    begin: int  # byte of the first sample
    frames: int


def header(f, path: str, size: int) -> Sound:
    """Reads the chunks before the samples; ValueError where they aren't PCM of 8 to 32 bits."""
    if len(head := f.read(12)) < 12 or head[:4] != b"RIFF" or head[8:] != b"WAVE":
        raise ValueError(f"not a WAV file: {path}")
    at, form = 12, None
    while True:
        f.seek(at)
        head = f.read(8)
        if len(head) < 8:
            raise ValueError(f"no samples: {path}")
        kind, length = struct.unpack("<4sI", head)
        if kind == b"fmt ":
            form = struct.unpack("<HHIIHH", f.read(16))
        elif kind == b"data":
            if form is None or form[0] not in (1, 0xFFFE) or not form[1] or form[5] not in (8, 16, 24, 32):
                raise ValueError(f"not PCM: {path}")
            frame = form[1] * form[5] // 8
            return Sound(path, form[2], form[1], form[5] // 8, at + 8, min(length, max(0, size - at - 8)) // frame)
        at += 8 + length + length % 2


class Section(InputPartition):
    """Blocks ``first`` to ``last`` of a file, and the channels asked for."""

    def __init__(self, sound: Sound, first: int, last: int, channels: tuple[int, ...]):
        super().__init__((sound.path, first))
        self.sound, self.first, self.last, self.channels = sound, first, last, channels

    @property
    def bytes(self) -> int:
        s = self.sound
        return max(0, min((self.last + 1) * BLOCK, s.frames) - self.first * BLOCK) * s.channels * s.width


class WavReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.strict = options["path"], options.get("strict", "false").lower() == "true"
        self.seconds = float(options.get("seconds", SECONDS))
        self.low, self.high = (-np.inf, False), (np.inf, False)  # bounds of t0, and whether they are left out
        self.paths: set | None = None
        self.only: set | None = None

    def pushFilters(self, filters: list[Filter]):
        """Takes bounds of t0 and values of path and channel, and gives back what it can't judge."""
        for f in filters:
            name, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if name == ("t0",) and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, (float(value), isinstance(f, GreaterThan)))
            elif name == ("t0",) and isinstance(f, (LessThan, LessThanOrEqual)):
                self.high = min(self.high, (float(value), not isinstance(f, LessThan)), key=lambda b: (b[0], b[1]))
            elif name in (("path",), ("channel",)) and isinstance(f, (EqualTo, In)):
                values = set(value if isinstance(f, In) else [value])
                if name == ("path",):
                    self.paths = values if self.paths is None else self.paths & values
                else:
                    self.only = values if self.only is None else self.only & values
            elif not isinstance(f, IsNotNull):  # no column is ever null
                yield f

    def _inside(self, t: float) -> bool:
        above = t > self.low[0] or t == self.low[0] and not self.low[1]
        return above and (t < self.high[0] or t == self.high[0] and self.high[1])

    def partitions(self) -> list[InputPartition]:
        store, files = listed(self.path, ".wav")
        out: list[InputPartition] = []
        for x in files:
            if self.paths is not None and x.path not in self.paths:
                continue
            try:
                with store.open_input_file(x.path) as f:
                    sound = header(f, x.path, x.size)
            except ValueError:
                if self.strict:
                    raise
                continue
            channels = tuple(c for c in range(sound.channels) if self.only is None or c in self.only)
            blocks = -(-sound.frames // BLOCK)
            # The first and the last block whose t0 is asked for; a few are looked at, as times are rounded.
            first = 0 if self.low[0] == -np.inf else int(np.clip(self.low[0] * sound.rate // BLOCK - 1, 0, blocks))
            last = blocks - 1 if self.high[0] == np.inf else int(np.clip(self.high[0] * sound.rate // BLOCK + 1, -1, blocks - 1))
            while first <= last and not self._inside(first * BLOCK / sound.rate):
                first += 1
            while first <= last and not self._inside(last * BLOCK / sound.rate):
                last -= 1
            each = max(1, int(self.seconds * sound.rate) // BLOCK)
            if channels:
                out += [Section(sound, k, min(k + each - 1, last), channels) for k in range(first, last + 1, each)]
        return out or [Section(Sound("", 1, 1, 1, 0, 0), 0, -1, ())]

    def read(self, partition: Section):
        s = partition.sound
        if partition.last < partition.first:
            return
        with store_of(self.path)[0].open_input_file(s.path) as f:
            f.seek(s.begin + partition.first * BLOCK * s.channels * s.width)
            for k in range(partition.first, partition.last + 1):
                raw = f.read(min(BLOCK, s.frames - k * BLOCK) * s.channels * s.width)
                x = samples(raw[: len(raw) // (s.channels * s.width) * s.channels * s.width], s.width).reshape(-1, s.channels)
                yield pa.RecordBatch.from_arrays([
                    pa.array([s.path] * len(partition.channels), pa.string()), pa.array(partition.channels, pa.int32()), pa.array([k] * len(partition.channels), pa.int64()),
                    pa.array([k * BLOCK / s.rate] * len(partition.channels), pa.float64()), pa.array([s.rate] * len(partition.channels), pa.int32()),
                    pa.array([x[:, c] for c in partition.channels], pa.list_(pa.float32())),
                ], [c.split()[0] for c in BLOCKS.split(", ")])


class WavSource(DataSource):
    @classmethod
    def name(cls):
        return "wav"

    def schema(self):
        return BLOCKS

    def reader(self, schema):
        return WavReader(self.options)


def register(spark) -> None:
    """Makes the format known to the session and lets filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WavSource)
