"""Language ID by cross-parsing entropy.

For every language a suffix automaton is built over labelled text. A text is cut greedily
into the longest pieces that occur in that text; the language that needs the fewest
pieces, each weighed by log2 of what it had to choose from (a byte at least), per byte, wins.

The automata are transition tables, and whole batches of texts walk them side by side, so
a step costs a few array operations however many texts there are. Long texts are walked in
segments of ``SEGMENT`` bytes at once, each as if a piece began there; then every segment
is walked again from the state that the one before it ends in, until both walks meet. So the
count is that of the whole text parsed in one go.

Learned from, per language, are whole texts of rows of least hash: up to SAMPLE_DOCS rows are
looked at and those taken that fit into SAMPLE_BYTES, or into an equal part of TOTAL_BYTES
where languages are many; where none fits, the shortest of them. Of more than LANGS languages those with
the most rows are learned: they are a set of labels that every worker holds.

Cases: null text and texts without a letter of any script are ``und`` with score 0; so is
everything where nothing is learned. Very long texts are parsed whole. Equal entropies go to
the first language by name. Null doc_ids are predicted and not learned from; repeated rows are
predicted each and learned from once; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .textkit import LOWER, SPACE, buffers, pieces

#: The training sample: rows looked at and bytes of text taken of each language, and bytes in all.
SAMPLE_DOCS, SAMPLE_BYTES, TOTAL_BYTES = 200, 48_000, 400_000
LANGS = 500
SEGMENT = 1024
FLAG = np.int32(1 << 30)

_SYMBOL = LOWER.copy()
_SYMBOL[SPACE] = 32
_SYMBOL[[c for c in range(128) if not chr(c).isalpha()]] = 32


def normal(raw: np.ndarray) -> np.ndarray:
    """Lower-case; everything in ASCII but letters is a space; capital Latin letters with marks are small."""
    out = _SYMBOL[raw]
    if len(raw):
        after = np.flatnonzero((raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E)) + 1
        out[after] += 32
    return out


def automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of ``text``; state 0 is the start."""
    go, link, length, last = [{}], [-1], [0], 0
    for c in text:
        new = len(go)
        go.append({})
        link.append(0)
        length.append(length[last] + 1)
        p, last = last, new
        while p >= 0 and c not in go[p]:
            go[p][c] = new
            p = link[p]
        if p < 0:
            continue
        q = go[p][c]
        if length[q] == length[p] + 1:
            link[new] = q
            continue
        copy = len(go)
        go.append(dict(go[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        while p >= 0 and go[p].get(c) == q:
            go[p][c] = copy
            p = link[p]
        link[q] = link[new] = copy
    return go


class Model:
    """Per language a table next[state, symbol class]; FLAG marks that a new piece begins."""

    def __init__(self, samples: dict[str, bytes]):
        self.langs = sorted(samples)
        self.tables, self.bits = [], []
        for lang in self.langs:
            symbol = np.zeros(256, np.int32)
            seen = sorted(set(samples[lang]))
            symbol[seen] = np.arange(1, len(seen) + 1)
            width, go = len(seen) + 1, automaton(samples[lang])
            start = np.full(width, FLAG, np.int32)  # a piece that begins with an unknown symbol
            for c, to in go[0].items():
                start[symbol[c]] = to * width | FLAG
            table = np.tile(start, (len(go), 1))
            for state, edges in enumerate(go):
                for c, to in edges.items():
                    table[state, symbol[c]] = to * width
            self.tables.append((symbol, table.ravel()))
            self.bits.append(np.log2(max(256, len(samples[lang]))))

    def pieces_of(self, text: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Pieces that each text takes, per language."""
        size = np.diff(off)
        parts = -(-size // SEGMENT)
        doc = np.repeat(np.arange(len(size)), parts)
        place = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
        begin = off[:-1][doc] + SEGMENT * place
        end = np.minimum(begin + SEGMENT, off[1:][doc])
        out = np.zeros((len(size), len(self.langs)))
        for k, (symbol, table) in enumerate(self.tables):
            symbols = symbol[text]
            last, begun = walk(table, symbols, begin, end)
            first = np.zeros(len(doc), np.int32)
            todo = np.flatnonzero(place)
            while len(todo):  # segments whose predecessor may end in another state than they were walked from
                todo = todo[last[todo - 1] != first[todo]]
                fewer, to, met = meet(table, symbols, begin[todo], end[todo], first[todo], last[todo - 1])
                begun[todo] += fewer
                first[todo] = last[todo - 1]
                other = todo[~met]
                last[other] = to[~met]
                todo = other + 1
                todo = todo[todo < len(doc)]
                todo = todo[place[todo] > 0]
            out[:, k] = np.bincount(doc, weights=begun, minlength=len(size)) + (size > 0)
        return out

    def predict(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the language or -1, score) of each text."""
        n = len(off) - 1
        text = normal(raw)
        letters = np.concatenate([[0], np.cumsum((text != 32) & (text < 128))])
        others = np.concatenate([[0], np.cumsum(text >= 128)])
        has = letters[off[1:]] > letters[off[:-1]]
        for k in np.flatnonzero(~has & (others[off[1:]] > others[off[:-1]])):
            has[k] = any(map(str.isalpha, raw[off[k] : off[k + 1]].tobytes().decode(errors="replace")))
        if not self.langs:
            return np.full(n, -1), np.zeros(n)
        size = np.diff(off)
        total = self.pieces_of(text, off)
        entropy = total * np.array(self.bits) / np.maximum(size, 1)[:, None]
        best = entropy.argmin(1)
        rest = np.exp2(np.clip(-(entropy - entropy.min(1, keepdims=True)) * np.minimum(size, 64)[:, None], -60, 0)).sum(1)
        return np.where(has, best, -1), np.where(has, 1 / rest, 0.0)


def walk(table: np.ndarray, symbols: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(last state, pieces begun after the first) of each segment, walked from the start."""
    size = end - begin
    order = np.argsort(-size, kind="stable")
    at, size = begin[order], size[order]
    steps = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(steps), "left")
    state, begun = np.zeros(len(size), np.int32), np.zeros(len(size), np.int32)
    for t in range(steps):
        n = active[t]
        to = table[state[:n] + symbols[at[:n] + t]]
        begun[:n] += to >> 30
        state[:n] = to & (FLAG - 1)
    out = np.empty_like(state), np.empty_like(begun)
    out[0][order], out[1][order] = state, begun
    return out


def meet(table: np.ndarray, symbols: np.ndarray, begin: np.ndarray, end: np.ndarray, old: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Walks each segment from two states until they are one: (pieces begun from the new state less
    those from the old, last state, whether they met)."""
    at, old, new = begin.copy(), old.copy(), new.copy()
    more, live = np.zeros(len(at), np.int32), np.arange(len(at))
    while len(live):
        c = symbols[at[live]]
        a, b = table[old[live] + c], table[new[live] + c]
        more[live] += (b >> 30) - (a >> 30)
        old[live], new[live] = a & (FLAG - 1), b & (FLAG - 1)
        at[live] += 1
        live = live[(old[live] != new[live]) & (at[live] < end[live])]
    return more, new, old == new


def sample(docs: DataFrame) -> dict[str, bytes]:
    """Text to learn from by language, as the module says, of documents that aren't held out. The
    languages are those of the rows that may be learned from and have a letter, the LANGS most frequent."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    known = known.where("doc_id is not null and lang is not null").where(~common.held_out()).where(F.col("text").rlike(r"\p{L}"))
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGS)
    # Three times as many rows as are looked at, by hash, so that no language's rows meet in one task.
    h = F.xxhash64("doc_id", "text")
    near = known.join(F.broadcast(counts), "lang").select("lang", "doc_id", h.alias("h"), F.octet_length("text").alias("size"), "n").where((F.col("h") / 2.0**64 + 0.5) * F.col("n") <= 3 * SAMPLE_DOCS)
    few = near.distinct().withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).where(F.col("r") <= SAMPLE_DOCS)
    by: dict[str, list] = {}
    for row in few.collect():
        by.setdefault(row["lang"], []).append((row["h"], row["doc_id"], row["size"]))
    picked, room = [], min(SAMPLE_BYTES, TOTAL_BYTES // max(1, len(by)))
    for lang, rows in sorted(by.items()):
        used = 0
        for h_, doc_id, size in sorted(rows):
            if used + size <= room:
                used += size
                picked.append((lang, doc_id, h_))
        if not used:
            picked.append((lang, *min((size, h_, doc_id) for h_, doc_id, size in rows)[:0:-1]))
    wanted = docs.sparkSession.createDataFrame(picked, "lang string, doc_id long, h long")
    found: dict[str, bytes] = {}
    for row in sorted(known.withColumn("h", h).join(F.broadcast(wanted), ["lang", "doc_id", "h"]).select("lang", "h", "doc_id", "text").distinct().collect()):
        raw = normal(np.frombuffer(row["text"].encode(), np.uint8)).tobytes()
        found[row["lang"]] = found.get(row["lang"], b"") + b" " + b" ".join(raw.split())
    return found


_models: dict[tuple, Model] = {}


def predict(docs: DataFrame, samples: dict[str, bytes]) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; a worker builds the automata once."""
    held = docs.sparkSession.sparkContext.broadcast(samples)

    def predicted(batches):
        key = tuple(sorted(held.value.items()))
        model = _models.get(key)
        if model is None:
            _models.clear()
            model = _models[key] = Model(held.value)
        names = np.array([*model.langs, "und"], object)
        for batch in batches:
            for piece in pieces(batch, "text"):
                best, score = model.predict(*buffers(piece.column(2)))
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(names[best], pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.held_out().alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(common.tidy(predicted), "doc_id long, held_out boolean, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return predict(docs, sample(docs))
