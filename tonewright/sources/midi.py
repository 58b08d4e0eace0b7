"""Standard MIDI files: a codec, and a Spark data source ``midi`` that reads and writes notes.

Reading yields a row per note of every track, with seconds from the file's tempo changes.
"""

from __future__ import annotations

import itertools
import struct
import uuid
from array import array
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyarrow.fs import FileType
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from .stores import listed, store_of

SCHEMA = "path string, track_index int, track string, channel int, program int, is_drum boolean, pitch int, velocity int, start_tick long, end_tick long, start_s double, end_s double"
DRUM_CHANNEL = 9
SLAB = 1 << 16  # notes or events that are turned into rows or bytes at a time


@dataclass
class Track:
    name: str = ""
    program: int = 0
    is_drum: bool = False
    notes: list = field(default_factory=list)  # (pitch, velocity, start, end), seconds when writing


def number(value: int) -> bytes:
    """A variable-length quantity: seven bits a byte, highest first."""
    out = [value & 0x7F]
    while value := value >> 7:
        out.append(value & 0x7F | 0x80)
    return bytes(reversed(out))


def _read_number(data: bytes, at: int) -> tuple[int, int]:
    value = 0
    while True:
        byte = data[at]
        at += 1
        value = value << 7 | byte & 0x7F
        if byte < 0x80:
            return value, at


def chunks(data: bytes) -> list[tuple[bytes, bytes]]:
    out, at = [], 0
    while at + 8 <= len(data):
        kind, (size,) = data[at : at + 4], struct.unpack(">I", data[at + 4 : at + 8])
        out.append((kind, data[at + 8 : at + 8 + size]))
        at += 8 + size
    return out


def track_events(data: bytes):
    """(tick, status, payload) of a track; running status is resolved, meta events have status 0xFF
    and a payload that begins with their kind."""
    at = tick = status = 0
    while at < len(data):
        step, at = _read_number(data, at)
        tick += step
        if data[at] >= 0x80:
            status = data[at]
            at += 1
        if status == 0xFF:
            kind = data[at]
            size, at = _read_number(data, at + 1)
            yield tick, status, bytes([kind]) + data[at : at + size]
            at += size
        elif status in (0xF0, 0xF7):
            size, at = _read_number(data, at)
            at += size
        else:
            size = 1 if status & 0xF0 in (0xC0, 0xD0) else 2
            yield tick, status, data[at : at + size]
            at += size


def _columns(data: bytes) -> tuple[int, list[tuple[int, int]], list[tuple[int, Track, list[np.ndarray]]]]:
    """``parse`` with notes as columns (pitch, velocity, start, end): 18 bytes each while they are read."""
    parts = chunks(data)
    if not parts or parts[0][0] != b"MThd":
        raise ValueError("not a Standard MIDI File")
    division = struct.unpack(">H", parts[0][1][4:6])[0]
    tempi, tracks = [], []
    for kind, body in parts[1:]:
        if kind != b"MTrk":
            continue
        name, by_channel, open_notes, programs = "", {}, {}, {}
        last = 0

        def add(channel: int, *note: int) -> None:
            for column, value in zip(by_channel.setdefault(channel, [array(c) for c in "BBqq"]), note):  # noqa: B023
                column.append(value)

        for tick, status, payload in track_events(body):
            last = tick
            if status == 0xFF:
                if payload[0] == 0x03:
                    name = payload[1:].decode("utf-8", "replace")
                elif payload[0] == 0x51:
                    tempi.append((tick, int.from_bytes(payload[1:4], "big")))
                continue
            kind_, channel = status & 0xF0, status & 0x0F
            if kind_ == 0xC0:
                programs.setdefault(channel, payload[0])
            elif kind_ == 0x90 and payload[1]:
                open_notes.setdefault((channel, payload[0]), []).append((tick, payload[1]))
            elif kind_ in (0x80, 0x90):
                for begun, velocity in open_notes.pop((channel, payload[0]), []):
                    add(channel, payload[0], velocity, begun, tick)
        for (channel, pitch), begun in open_notes.items():  # never released: to the track's end
            for t, v in begun:
                add(channel, pitch, v, t, last)
        for channel, listed_ in sorted(by_channel.items()):
            columns = [np.array(c) for c in listed_]
            order = np.lexsort((columns[0], columns[2]))
            tracks.append((channel, Track(name, programs.get(channel, 0), channel == DRUM_CHANNEL), [c[order] for c in columns]))
        if not by_channel and name:
            tracks.append((-1, Track(name), [np.zeros(0, np.int64)] * 4))
    tempi.sort()
    if not tempi or tempi[0][0] > 0:
        tempi.insert(0, (0, 500_000))
    return division, tempi, tracks


def parse(data: bytes) -> tuple[int, list[tuple[int, int]], list[tuple[int, Track]]]:
    """(ticks a quarter, tempo changes (tick, microseconds a quarter), (channel, track) with notes in ticks)."""
    division, tempi, tracks = _columns(data)
    for _, track, columns in tracks:
        track.notes = list(zip(*(c.tolist() for c in columns)))
    return division, tempi, [(channel, track) for channel, track, _ in tracks]


def _clock(division: int, tempi: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tick and second of each tempo change, and the seconds of a tick from there on."""
    at = np.array([t for t, _ in tempi])
    length = np.array([us for _, us in tempi]) / 1e6 / division
    return at, np.concatenate([[0.0], np.cumsum(np.diff(at) * length[:-1])]), length


def _seconds(t: np.ndarray, division: int, tempi: list[tuple[int, int]]) -> np.ndarray:
    at, begin, length = _clock(division, tempi)
    k = np.maximum(np.searchsorted(at, t, "right") - 1, 0)
    return begin[k] + (t - at[k]) * length[k]


def _ticks(t: np.ndarray, division: int, tempi: list[tuple[int, int]]) -> np.ndarray:
    at, begin, length = _clock(division, tempi)
    k = np.maximum(np.searchsorted(begin, t, "right") - 1, 0)
    return np.rint(at[k] + (t - begin[k]) / length[k]).astype(np.int64)


def seconds(ticks: list[int], division: int, tempi: list[tuple[int, int]]) -> list[float]:
    """Seconds of ticks, each in the last tempo change at or before it."""
    return _seconds(np.asarray(ticks, dtype=np.int64), division, tempi).tolist()


def ticks(times: list[float], division: int, tempi: list[tuple[int, int]]) -> list[int]:
    """Ticks of seconds: the inverse of ``seconds``."""
    return _ticks(np.asarray(times, dtype=float), division, tempi).tolist()


def _chunk(kind: bytes, *body: bytes) -> bytes:
    return b"".join([kind, struct.pack(">I", sum(map(len, body))), *body])


def _conductor(changes: list[tuple[int, int]], meter: tuple[int, int]) -> bytes:
    """The track of tempo changes (tick, microseconds a quarter) and the meter."""
    events = [(tick, b"\xff\x51\x03" + us.to_bytes(3, "big")) for tick, us in changes]
    events.append((0, bytes([0xFF, 0x58, 4, meter[0], meter[1].bit_length() - 1, 24, 8])))
    out, last = [], 0
    for tick, body in sorted(events, key=lambda e: e[0]):
        out.append(number(tick - last) + body)
        last = tick
    return _chunk(b"MTrk", *out, b"\x00\xff\x2f\x00")


def _bytes(step: np.ndarray, body: np.ndarray) -> bytes:
    """Events' steps as ``number`` writes them, each before its three bytes."""
    size = np.ones(len(step), np.int64)
    for k in range(1, 9):
        size += step >= 1 << 7 * k
    first = np.cumsum(size + 3) - size - 3
    out = np.zeros(int((size + 3).sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        on = np.flatnonzero(size > k)
        rest = size[on] - 1 - k
        out[first[on] + k] = step[on] >> 7 * rest & 0x7F | np.where(rest > 0, 0x80, 0)
    for k in range(3):
        out[first + size + k] = body[:, k]
    return out.tobytes()


def _track(name: str, program: int, channel: int, pitch: np.ndarray, velocity: np.ndarray, start: np.ndarray, end: np.ndarray, division: int, changes: list[tuple[int, int]]) -> bytes:
    """A track of notes in seconds; of one tick, ends come before starts and each by the notes' order."""
    n = len(pitch)
    if n and not 0 <= pitch.min() <= pitch.max() <= 255:
        raise ValueError("pitches go from 0 to 255")
    a = _ticks(start, division, changes)
    if n and a.min() < 0:
        raise ValueError("notes begin before the time 0")
    tick = np.concatenate([a, np.maximum(a + 1, _ticks(end, division, changes))])
    order = np.lexsort((np.repeat(np.array([1, 0], np.uint8), n), tick))
    title, out, last = name.encode(), [], 0
    head = b"\x00\xff\x03" + number(len(title)) + title + bytes([0, 0xC0 | channel, program])
    for k in range(0, 2 * n, SLAB):
        now = order[k : k + SLAB]
        note, on = now % n, now < n
        body = np.stack([np.where(on, 0x90 | channel, 0x80 | channel), pitch[note], np.where(on, np.clip(velocity[note], 1, 127), 0)], 1)
        out.append(_bytes(np.diff(tick[now], prepend=last), body))
        last = int(tick[now[-1]])
    return _chunk(b"MTrk", head, *out, b"\x00\xff\x2f\x00")


def _channel(k: int) -> int:
    """Channel of a song's k-th pitched track."""
    return k % 15 if k % 15 < DRUM_CHANNEL else k % 15 + 1


def _changes(tempi) -> list[tuple[int, int]]:
    return [(tick, min(round(60e6 / qpm), (1 << 24) - 1)) for tick, qpm in tempi]


def _file(parts: list[bytes], division: int) -> bytes:
    return b"".join([_chunk(b"MThd", struct.pack(">HHH", 1, len(parts), division)), *parts])


def write(tracks: list[Track], bpm: float = 120.0, division: int = 480, meter: tuple[int, int] = (4, 4), tempi: list[tuple[int, float]] | None = None) -> bytes:
    """A type 1 file: a conductor track, then one track each; drums on channel 9, others around it; at one
    tick notes end before others begin. tempi: changes (tick, quarters a minute), from tick 0 on."""
    changes = _changes(tempi or [(0, bpm)])
    parts, k = [_conductor(changes, meter)], 0
    for t in tracks:
        columns = [np.array(c, kind) for c, kind in zip(zip(*t.notes), (np.int64, np.int64, float, float))] or [np.zeros(0, np.int64)] * 4
        parts.append(_track(t.name, t.program, DRUM_CHANNEL if t.is_drum else _channel(k), *columns, division, changes))
        k += not t.is_drum
    return _file(parts, division)


def merge(files: list[bytes]) -> bytes:
    """Several files as one: the first conductor track, channels dealt anew; divisions must agree."""
    parsed = [parse(f) for f in files]
    if len({p[0] for p in parsed}) > 1:
        raise ValueError("the files have different divisions")
    division, tempi, _ = parsed[0]
    tracks = []
    for d, tempo, listed in parsed:
        for _, t in listed:
            flat = seconds([x for n in t.notes for x in n[2:]], d, tempo)
            tracks.append(Track(t.name, t.program, t.is_drum, [(n[0], n[1], a, b) for n, a, b in zip(t.notes, flat[::2], flat[1::2])]))
    return write(tracks, 60e6 / tempi[0][1], division)


def rows(path: str, data: bytes):
    division, tempi, tracks = _columns(data)
    for index, (channel, t, columns) in enumerate(tracks):
        for k in range(0, len(columns[0]), SLAB):
            part = [c[k : k + SLAB] for c in columns]
            times = [_seconds(c, division, tempi).tolist() for c in part[2:]]
            for n in zip(*(c.tolist() for c in part), *times):
                yield path, index, t.name, channel, t.program, t.is_drum, *n


def slabs(found):
    """Lists of at most SLAB of the rows: a file's notes are never rows all at once."""
    found = iter(found)
    while out := list(itertools.islice(found, SLAB)):
        yield out


def read_notes(spark, path: str):
    """Notes of MIDI files by Spark's own reader of binary files, so any store it knows will do."""
    import pandas as pd

    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def parsed(frames):
        for frame in frames:
            for p, data in zip(frame["path"], frame["content"]):
                for some in slabs(rows(p, bytes(data))):
                    yield pd.DataFrame(some, columns=names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parsed, SCHEMA)


def to_files(notes, bpm: float = 120.0, tempi=None, stamps=None, division: int = 480, meter: tuple[int, int] = (4, 4)):
    """notes(song_id, track, program, is_drum, pitch, velocity, start_s, end_s, note_id) -> (song_id, midi
    binary), at one tempo, at each song's of tempi(song_id, bpm), or with the tempo changes of
    stamps(song_id, tick, qpm), whose ticks are of ``division`` to a quarter.

    A task encodes one track at a time, as columns; a song's encoded tracks then meet as bytes, some
    ten a note. Notes without a track are left out."""
    import pyarrow as pa

    def encode(notes: pa.Table, heads: pa.Table) -> pa.Table:
        out = []
        for h in heads.to_pylist():
            if not notes.num_rows:
                break
            changes = _changes((int(t["tick"]), float(t["qpm"])) for t in h["tempi"])
            chunk = None
            if h["name"] is not None:
                c = {x: notes.column(x).to_numpy() for x in ("pitch", "velocity", "start_s", "end_s", "note_id")}
                order = np.lexsort((c["note_id"], c["pitch"], c["start_s"]))
                chunk = _track(h["name"], h["program"], DRUM_CHANNEL if h["is_drum"] else _channel(h["k"]), *(c[x][order] for x in ("pitch", "velocity", "start_s", "end_s")), division, changes)
            out.append({"song_id": h["song"], "track": h["name"], "conductor": _conductor(changes, meter), "chunk": chunk})
        return pa.Table.from_pylist(out, pa.schema([("song_id", pa.int64()), ("track", pa.string()), ("conductor", pa.binary()), ("chunk", pa.binary())]))

    def join(parts: pa.Table) -> pa.Table:
        chunks = parts.sort_by("track").column("chunk").drop_null().to_pylist()
        data = _file([parts.column("conductor")[0].as_py(), *chunks], division)
        return pa.table({"song_id": pa.array([parts.column("song_id")[0].as_py()], pa.int64()), "midi": pa.array([data], pa.binary())})

    held = notes.select(F.col("song_id").cast("long").alias("song_id"), "track", "program", "is_drum", "pitch", "velocity", "start_s", "end_s", "note_id")
    # A track has its first note's program.
    first = F.min(F.struct("start_s", "pitch", "note_id", "program", "is_drum"))
    heads = held.groupBy("song_id", "track").agg(first.alias("f")).select("song_id", "track", "f.program", "f.is_drum")
    pitched = (F.col("track").isNotNull() & ~F.col("is_drum")).cast("int")
    heads = heads.withColumn("k", F.sum(pitched).over(Window.partitionBy("song_id").orderBy("track")) - pitched)
    one_tempo = lambda c: F.array(F.struct(F.lit(0).cast("long").alias("tick"), c.cast("double").alias("qpm")))
    if stamps is not None:
        listed = stamps.groupBy("song_id").agg(F.array_sort(F.collect_list(F.struct(F.col("tick").cast("long").alias("tick"), "qpm"))).alias("tempi"))
        heads = heads.join(listed, "song_id")
    elif tempi is not None:
        heads = heads.join(tempi.select("song_id", one_tempo(F.col("bpm")).alias("tempi")), "song_id")
    else:
        heads = heads.withColumn("tempi", one_tempo(F.lit(bpm)))
    heads = heads.select(F.col("song_id").alias("song"), F.col("track").alias("name"), "program", "is_drum", "k", "tempi")  # names of its own: both sides have the same origin
    columns = held.select("song_id", "track", "pitch", "velocity", "start_s", "end_s", "note_id")
    parts = columns.groupBy("song_id", "track").cogroup(heads.groupBy("song", "name")).applyInArrow(encode, "song_id long, track string, conductor binary, chunk binary")
    return parts.groupBy("song_id").applyInArrow(join, "song_id long, midi binary")


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class MidiReader(DataSourceReader):
    """A file to a task. ``read_notes`` reads stores that only Spark knows."""

    def __init__(self, options):
        self.path = options["path"]

    def partitions(self):
        return [_File(x.path) for x in listed(self.path, ".mid", ".midi")[1]] or [_File("")]

    def read(self, partition):
        if partition.path:
            with store_of(self.path)[0].open_input_file(partition.path) as f:
                yield from rows(partition.path, f.read())


@dataclass
class Staged(WriterCommitMessage):
    """What one attempt of one task has written: song and file."""

    files: list[tuple[str, str]]


class MidiWriter(DataSourceWriter):
    """A file for each song, by a commit protocol: attempts of tasks write to a folder of the job, each
    under names of its own; once all tasks are done, the files of the attempts that counted are moved
    into place and the folder goes, with what failed attempts left in it. A job that fails publishes nothing.

    Rows are files (song_id, midi) as ``to_files`` makes them, a song each, or notes, which a task gathers
    by song. A song over several tasks is refused: ``save`` brings songs together first."""

    def __init__(self, options, overwrite: bool = False, files: bool = False):
        self.path, self.bpm, self.overwrite, self.files = options["path"], float(options.get("bpm", 120.0)), overwrite, files
        self.job = uuid.uuid4().hex
        self.stage = f"{store_of(self.path)[1].rstrip('/')}/_staging-{self.job}"

    def _songs(self, iterator):
        if self.files:
            for row in iterator:
                yield str(row["song_id"]), bytes(row["midi"])
            return
        songs: dict = {}
        for row in iterator:
            t = songs.setdefault(row["song_id"], {}).setdefault(row["track"], Track(row["track"], row["program"], row["is_drum"]))
            t.notes.append((row["pitch"], row["velocity"], row["start_s"], row["end_s"]))
        for song, tracks in songs.items():
            yield str(song), write(list(tracks.values()), self.bpm)

    def write(self, iterator):
        store, out = store_of(self.path)[0], []
        store.create_dir(self.stage, recursive=True)
        for song, data in self._songs(iterator):
            name = f"{self.stage}/{uuid.uuid4().hex}.part"
            with store.open_output_stream(name) as f:
                f.write(data)
            out.append((song, name))
        return Staged(out)

    def commit(self, messages):
        store, where = store_of(self.path)
        files = [x for m in messages if m is not None for x in m.files]
        twice = sorted(song for song, n in Counter(song for song, _ in files).items() if n > 1)
        if twice:
            self.abort(messages)
            raise ValueError(f"songs that came from several tasks: {', '.join(twice[:5])}; save() brings a song's notes together")
        old = [x.path for x in listed(self.path, ".mid", ".midi")[1]] if self.overwrite else []
        for song, name in files:
            store.move(name, f"{where.rstrip('/')}/{song}-{self.job[:8]}.mid")
        for path in old:  # the new ones are there by now
            store.delete_file(path)
        self._clear(store)

    def abort(self, messages):
        self._clear(store_of(self.path)[0])

    def _clear(self, store) -> None:
        if store.get_file_info(self.stage).type != FileType.NotFound:
            store.delete_dir(self.stage)


class MidiSource(DataSource):
    @classmethod
    def name(cls):
        return "midi"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return MidiReader(self.options)

    def writer(self, schema, overwrite):
        return MidiWriter(self.options, overwrite, "midi" in schema.fieldNames())


def register(spark) -> None:
    spark.dataSource.register(MidiSource)


def save(notes, path: str, mode: str = "append", **options) -> None:
    """Writes a file for each song, whatever tasks its notes are in; options as of ``to_files``."""
    register(notes.sparkSession)
    to_files(notes, **options).write.format("midi").mode(mode).save(path)
