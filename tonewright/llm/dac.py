"""Token-ID output as directly addressable codes.

Every id is cut into chunks of eight bits, lowest first. Level k keeps chunk k of all
ids that have one, a bitmap that says which of them go on, and a directory of the
bitmap's rank at every 512th bit. Token i is read by following its rank down the levels:
no block is decoded for it. Levels are at most four for ids below 2**32; small ids
take one chunk.

Cases: null text counts as empty and yields the end id alone; equal doc_ids are
ordered by text, null ids come first; an empty table writes no block and reads as no
rows; other columns of the input are ignored.
"""

from __future__ import annotations

import os
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .textkit import buffers, pieces, slices

MAGIC = b"DACS"
STEP = 512  # bits between two entries of a rank directory
POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)
BLOCK_TOKENS = 1 << 20


def encode(ids: np.ndarray) -> bytes:
    """ids (below 2**32) -> magic, level count, then per level: length, chunks, bitmap, ranks."""
    rest, parts = np.ascontiguousarray(ids, np.uint32), []
    while True:
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        ones = np.add.reduceat(POP[bits], np.arange(0, len(bits), STEP // 8), dtype=np.int64) if len(bits) else np.zeros(0, np.int64)
        ranks = (np.cumsum(ones) - ones).astype("<u4")
        parts.append(struct.pack("<I", len(rest)) + (rest & 0xFF).astype(np.uint8).tobytes() + bits.tobytes() + ranks.tobytes())
        if not more.any():
            return MAGIC + struct.pack("<B", len(parts)) + b"".join(parts)
        rest = rest[more] >> 8


class Reader:
    """Random access to, and decoding of, one encoded run of ids."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a run of directly addressable codes")
        at, self.levels = 5, []
        for _ in range(data[4]):
            (n,) = struct.unpack_from("<I", data, at)
            n_bits = (n + 7) // 8
            n_ranks = -(-n_bits // (STEP // 8))
            chunks = np.frombuffer(data, np.uint8, n, at + 4)
            bits = np.frombuffer(data, np.uint8, n_bits, at + 4 + n)
            ranks = np.frombuffer(data, "<u4", n_ranks, at + 4 + n + n_bits)
            self.levels.append((chunks, bits, ranks))
            at += 4 + n + n_bits + 4 * n_ranks

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def token(self, i: int) -> int:
        if not 0 <= i < len(self):
            raise IndexError(i)
        value = shift = 0
        for chunks, bits, ranks in self.levels:
            value |= int(chunks[i]) << shift
            byte, bit = divmod(i, 8)
            if not bits[byte] >> bit & 1:
                break
            begin = byte // (STEP // 8) * (STEP // 8)
            i = int(ranks[byte // (STEP // 8)]) + int(POP[bits[begin:byte]].sum(dtype=np.int64)) + int(POP[bits[byte] & ((1 << bit) - 1)])
            shift += 8
        return value

    def all(self) -> np.ndarray:
        value = np.zeros(0, np.uint32)
        for chunks, bits, _ in reversed(self.levels):
            here = chunks.astype(np.uint32)
            if len(value):
                here[np.unpackbits(bits, count=len(chunks), bitorder="little").astype(bool)] |= value << np.uint32(8)
            value = here
        return value


#: Classes of code points: 0 other, 1 letter, 2 number, 3 white space; 4: not the same in all
#: versions of Unicode, so texts with it go to the library whole.
def _classes() -> np.ndarray:
    import unicodedata

    now, then = unicodedata.category, unicodedata.ucd_3_2_0.category
    out = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        kind = now(chr(cp))
        out[cp] = {"L": 1, "N": 2}.get(kind[0], 0) if kind[0] == then(chr(cp))[0] else 4
    out[[*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = 3
    out[0x180E] = 4
    return out


class PieceEncoder:
    """Whole-text encoding with the ``tokenizers`` library, each distinct pre-token once.

    Byte-level BPE never merges across pre-tokens, so the ids of a text are those of its
    pre-tokens in a row. Pre-tokens of the byte-level pattern (contractions; letters, numbers
    or other signs with a space before them; white space) are found in all texts at once; a
    table of their 64-bit hashes leads to their ids, and only those not met before go to the
    library. A pre-token found is held against the remembered one: the bytes up to eight, else
    their size and a second hash; one that only shares a hash goes to the library too. Texts with the string of an added token, or with code points whose class changed
    between versions of Unicode, go to the library whole.
    """

    KEEP = 600_000  # pre-tokens remembered; beyond it the memory starts anew
    IDLE = 150_000  # pre-tokens that a worker still remembers between tasks: it lives on through other stages
    classes: np.ndarray | None = None

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        # The sign of every byte of UTF-8, as the library's own byte-level step shows it.
        shows, signs = ByteLevel(add_prefix_space=False, use_regex=False), {}
        for cp in (*range(0x800), *range(0x800, 0xD800, 0x40), *range(0xE000, 0x10000, 0x40), *range(0x10000, 0x110000, 0x1000)):
            signs.update(zip(chr(cp).encode(), "".join(part for part, _ in shows.pre_tokenize_str(chr(cp)))))
        self.signs = signs
        if PieceEncoder.classes is None:
            PieceEncoder.classes = _classes()
        self.forget()

    def forget(self) -> None:
        self.bits, self.n = 16, 0
        self.slots, self.where = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.int32)
        self.ids, self.first = np.zeros(1 << 16, np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32), np.zeros(1 << 14, np.int64)
        self.checks, self.sizes = np.zeros(1 << 14, np.uint64), np.zeros(1 << 14, np.int64)

    def rest(self) -> None:
        """A task is over: what is remembered waits for the next one, if it isn't much."""
        if self.n > self.IDLE:
            self.forget()

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Number of each remembered key, or -1. Keys are never 0."""
        mask, out = np.uint64((1 << self.bits) - 1), np.full(len(keys), -1, np.int32)
        left, at = np.arange(len(keys)), keys & mask
        while len(left):
            held = self.slots[at]
            hit = held == keys[left]
            out[left[hit]] = self.where[at[hit]]
            on = ~hit & (held != 0)
            left, at = left[on], (at[on] + np.uint64(1)) & mask
        return out

    def _place(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        mask, at = np.uint64((1 << self.bits) - 1), keys & np.uint64((1 << self.bits) - 1)
        while len(keys):
            free = self.slots[at] == 0
            self.slots[at[free]], self.where[at[free]] = keys[free], numbers[free]
            lost = self.slots[at] != keys
            keys, numbers, at = keys[lost], numbers[lost], (at[lost] + np.uint64(1)) & mask

    def _ids(self, word: bytes) -> list[int]:
        """Ids of a pre-token from the library's model, which reads bytes as printable signs."""
        return [t.id for t in self.tokenizer.model.tokenize(word.decode("latin-1").translate(self.signs))]

    def _learn(self, keys: np.ndarray, checks: np.ndarray, words: list[bytes]) -> None:
        """Remember new pre-tokens with their ids."""
        ids, size = [], []
        for word in words:
            got = self._ids(word)
            ids += got
            size.append(len(got))
        begin, end = int(self.first[self.n]), int(self.first[self.n]) + len(ids)
        if end > len(self.ids):
            self.ids.resize(end * 5 // 4, refcheck=False)
        if self.n + len(words) + 1 > len(self.first):
            for held in (self.first, self.checks, self.sizes):
                held.resize((self.n + len(words) + 1) * 5 // 4, refcheck=False)
        self.ids[begin:end] = ids
        numbers = np.arange(self.n, self.n + len(words), dtype=np.int32)
        self.first[self.n + 1 : self.n + 1 + len(words)] = begin + np.cumsum(size)
        self.checks[self.n : self.n + len(words)], self.sizes[self.n : self.n + len(words)] = checks, [len(w) for w in words]
        self.n += len(words)
        if 10 * self.n > 6 * len(self.slots):
            old = self.slots != 0
            kept, where = self.slots[old], self.where[old]
            self.bits = int(2 * self.n).bit_length()
            self.slots, self.where = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
            self._place(kept, where)
        self._place(keys, numbers)

    def pretokens(self, points: np.ndarray, edge: np.ndarray) -> np.ndarray:
        """Starts, as indices of code points, of all pre-tokens. edge: marks the texts' starts."""
        kind, n = self.classes[points], len(points)
        cut = edge.copy()
        cut[1:] |= kind[1:] != kind[:-1]
        runs = np.flatnonzero(cut)
        ends = np.append(runs[1:], n)
        is_space = kind[runs] == 3
        begins = runs.copy()
        # A space before a run of one text belongs to it; of other white space the last sign stands alone.
        followed = np.zeros(len(runs), bool)
        followed[:-1] = is_space[:-1] & ~edge[runs[1:]]
        takes = np.flatnonzero(followed)
        last = ends[takes] - 1
        joined = points[last] == 32
        begins[takes[joined] + 1] -= 1
        alone = last[~joined & (last > runs[takes])]
        gone = np.zeros(len(runs), bool)
        gone[takes[joined]] = ends[takes[joined]] - runs[takes[joined]] == 1
        # Contractions: an apostrophe by itself and the letters after it.
        quote = np.flatnonzero((points[runs] == 39) & (ends - runs == 1) & (begins == runs))
        quote = quote[quote + 1 < len(runs)]
        quote = quote[(kind[runs[quote + 1]] == 1) & ~edge[runs[quote + 1]]] if len(quote) else quote
        if len(quote):
            after = runs[quote + 1]
            one, size = points[after], ends[quote + 1] - after
            two = np.where(size > 1, points[np.minimum(after + 1, n - 1)], 0)
            pair = one.astype(np.int64) << 8 | np.minimum(two, 255)
            takes_n = np.where(np.isin(one, [ord(c) for c in "sdmt"]), 1, np.where(np.isin(pair, [ord(a) << 8 | ord(b) for a, b in ("ll", "ve", "re")]), 2, 0))
            quote, size, takes_n = quote[takes_n > 0], size[takes_n > 0], takes_n[takes_n > 0]
            begins[quote + 1] += takes_n
            gone[quote + 1] |= size == takes_n
        mark = np.zeros(n, bool)
        mark[begins[~gone]] = True
        mark[alone] = True
        return np.flatnonzero(mark)

    def __call__(self, column) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each text) of an Arrow string column."""
        raw, off = buffers(column)
        n = len(off) - 1
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(n, np.int64)
        points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
        at = np.flatnonzero((raw & 0xC0) != 0x80)
        edge = np.zeros(len(raw) + 1, bool)
        edge[off] = True
        start = at[self.pretokens(points, edge[:-1][at])]
        end = np.append(start[1:], len(raw))
        keys, checks = slices(raw, start, end)
        keys |= np.uint64(1)
        number = self._find(keys)
        if (number < 0).any():
            new, which = np.unique(keys[number < 0], return_index=True)
            if self.n + len(new) > self.KEEP:
                self.forget()
                new, which = np.unique(keys, return_index=True)
                spans = which
            else:
                spans = np.flatnonzero(number < 0)[which]
            view = raw.tobytes()
            self._learn(new, checks[spans], [view[a:b] for a, b in zip(start[spans].tolist(), end[spans].tolist())])
            number = self._find(keys)
        begin = self.first[number]
        size = self.first[number + 1] - begin
        wrong = np.flatnonzero((self.checks[number] != checks) | (self.sizes[number] != end - start))
        if len(wrong):  # other pre-tokens of the same hash
            told = [self._ids(raw[start[k] : end[k]].tobytes()) for k in wrong.tolist()]
            size[wrong] = [len(ids) for ids in told]
        place = np.concatenate([[0], np.cumsum(size)])
        out = self.ids[np.minimum(np.repeat(begin - place[:-1], size) + np.arange(place[-1]), len(self.ids) - 1)].astype(np.uint32)
        for k, ids in zip(wrong.tolist(), told if len(wrong) else []):
            out[place[k] : place[k + 1]] = ids
        edges = place[np.searchsorted(start, off)]
        count = np.diff(edges)
        odd = set(np.searchsorted(off, at[self.classes[points] == 4], "right") - 1) | {k for k in range(n) if any(raw[off[k] : off[k + 1]].tobytes().find(a) >= 0 for a in self.added)} if (self.classes[points] == 4).any() or any(raw.tobytes().find(a) >= 0 for a in self.added) else set()
        if odd:
            parts = np.split(out, edges[1:-1])
            for k in odd:
                parts[k] = np.array(self.tokenizer.encode(raw[off[k] : off[k + 1]].tobytes().decode(), add_special_tokens=False).ids, np.uint32)
                count[k] = len(parts[k])
            out = np.concatenate(parts)
        return out, count


_encoders: dict[str, PieceEncoder] = {}


def encoder_of(tokenizer: str) -> PieceEncoder:
    """The worker's own encoder. A task's function is sent with copies of the globals that it names, so it has to
    ask here: a function of this module is sent by name."""
    if tokenizer not in _encoders:
        _encoders[tokenizer] = PieceEncoder(tokenizer)
    return _encoders[tokenizer]


BLOCKS = "part int, start long, doc_ids array<long>, counts array<long>, payload binary"


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0) -> None:
    """Write the ids of all texts, in ascending doc_id order, each text closed by ``end_id``.

    Texts are range-partitioned by doc_id; a task encodes its range in batches and emits
    blocks of about ``BLOCK_TOKENS`` ids, so memory holds one block whatever the table's size.
    """

    def blocks(batches):
        encoder = encoder_of(tokenizer)
        part, start, ids, counts, held, n_held = TaskContext.get().partitionId(), 0, [], [], [], 0

        def block():
            nonlocal start, ids, counts, held, n_held
            flat = np.concatenate(held)
            out = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "start": pa.array([start], pa.int64()), "doc_ids": pa.array([ids], pa.list_(pa.int64())), "counts": pa.array([counts], pa.list_(pa.int64())), "payload": pa.array([encode(flat)], pa.binary())})
            start, ids, counts, held, n_held = start + len(flat), [], [], [], 0
            return out

        for batch in batches:
            for piece in pieces(batch, "text", 1 << 19):
                flat, n = encoder(piece.column(1))
                closed = np.insert(flat, np.cumsum(n), end_id).astype(np.uint32)
                held.append(closed)
                ids += piece.column(0).to_pylist()
                counts += (n + 1).tolist()
                n_held += len(closed)
                if n_held >= BLOCK_TOKENS:
                    yield block()
        if held:
            yield block()
        encoder.rest()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(common.tidy(blocks), BLOCKS).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files alone: doc_id, start, n_tokens, ids_crc32."""
    stored = spark.read.schema(BLOCKS).parquet(path)
    ends = stored.groupBy("part").agg(F.max(F.col("start") + F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    # One row per partition of the writer: as bounded as the number of its tasks.
    before = ends.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))

    def digests(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k] for c in batch.schema.names}
                ids = Reader(row["payload"].as_py()).all().astype("<u4").tobytes()
                n = np.array(row["counts"].values)
                edge = np.concatenate([[0], np.cumsum(n)])
                yield pa.RecordBatch.from_pydict({"doc_id": row["doc_ids"].values.cast(pa.int64()), "start": pa.array(edge[:-1] + row["start"].as_py() + row["before"].as_py()), "n_tokens": pa.array(n, pa.int64()), "ids_crc32": pa.array([zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())], pa.int64())})

    return stored.join(F.broadcast(before), "part").select("start", "before", "doc_ids", "counts", "payload").mapInArrow(common.tidy(digests), "doc_id long, start long, n_tokens long, ids_crc32 long")


def write_and_read(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """The contract of the query: encode, write, read back."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    path = common.fresh_path(docs.sparkSession, "dac")
    write(docs, path, tokenizer)
    return read(docs.sparkSession, path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_and_read(common.table(spark, sf_dir, "documents"))
