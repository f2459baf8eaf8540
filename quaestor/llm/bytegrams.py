"""Byte-context counts and tables for the language models.

A gram is a byte and the ``depth`` bytes before it in one 64-bit number: the
byte in the lowest 8 bits, the oldest in the highest. Dropping the oldest byte
is a mask, dropping the byte itself a shift. Every text starts after ``depth``
newlines and ends with one; no word has a newline, so texts can't be confused.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.llm.common import binary_values, map_arrow

PAD = b"\n"
#: Bytes that are turned to grams at once.
PIECE = 1 << 20
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def body(text: bytes | None, lower: bool = True) -> bytes:
    """The words of a text, each pair apart by one space, and the end."""
    text = text or b""
    return b" ".join((text.lower() if lower else text).split()) + PAD


def mask(depth: int) -> int:
    return (1 << 8 * (depth + 1)) - 1


def pieces(bodies: list[bytes], depth: int):
    """(grams, first, end, owner): grams of a stretch of bytes, and the runs of it that belong to a text.

    A text that is longer than PIECE comes in several runs, each after the bytes before it.
    """
    buffer, first, end, owner, size = [], [], [], [], 0

    def made():
        stream = np.frombuffer(b"".join(buffer), np.uint8).astype(np.uint64)
        grams = stream.copy()
        for k in range(1, depth + 1):
            grams[k:] |= stream[:-k] << np.uint64(8 * k)
        return grams, np.array(first), np.array(end), np.array(owner)

    for i, text in enumerate(bodies):
        for at in range(0, len(text), PIECE):
            part = text[at : at + PIECE]
            buffer += [text[at - depth : at] if at else PAD * depth, part]
            first.append(size + depth)
            size += depth + len(part)
            end.append(size)
            owner.append(i)
            if size >= PIECE:
                yield made()
                buffer, first, end, owner, size = [], [], [], [], 0
    if buffer:
        yield made()


def inside(grams: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The grams that belong to texts, without those of the bytes before them."""
    keep = np.ones(len(grams), bool)
    before = np.r_[0, end[:-1]]
    for a, b in zip(before.tolist(), first.tolist(), strict=True):
        keep[a:b] = False
    return grams[keep]


def sums(values: np.ndarray, first: np.ndarray, end: np.ndarray, owner: np.ndarray, total: np.ndarray) -> None:
    """Adds the sum over each run to its owner's total; always in the same order, whatever the batch."""
    edges = np.column_stack([first, end]).ravel()[:-1]  # the last run goes to the end of the stretch
    np.add.at(total, owner, np.add.reduceat(values, edges, axis=0, dtype=np.float64)[::2])


class Tally:
    """Counts of grams, kept sorted and merged when the pending ones have become many."""

    def __init__(self, most: int = 1 << 20):
        self.most, self.codes, self.counts, self.waiting, self.pending = most, np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

    def add(self, grams: np.ndarray) -> None:
        self.waiting.append(np.unique(grams, return_counts=True))
        self.pending += len(self.waiting[-1][0])
        if self.pending > self.most:
            self.merge()

    def merge(self) -> None:
        codes = np.concatenate([self.codes, *(w[0] for w in self.waiting)])
        counts = np.concatenate([self.counts, *(w[1] for w in self.waiting)])
        order = np.argsort(codes, kind="stable")
        codes, counts = codes[order], counts[order]
        if len(codes):
            start = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
            codes, counts = codes[start], np.add.reduceat(counts, start)
        self.codes, self.counts, self.waiting, self.pending = codes, counts, [], 0

    def full(self) -> bool:
        return len(self.codes) > self.most

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        self.merge()
        out = self.codes, self.counts
        self.codes, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return out


def tally_grams(rows: DataFrame, depth: int, keys: int = 0, lower: bool = True) -> DataFrame:
    """(key, code, n) from rows (key, text), to be added up; key is a number below ``keys``, or 0 with no such column."""

    def run(batches):
        tallies = [Tally() for _ in range(max(1, keys))]

        def out(k):
            codes, counts = tallies[k].take()
            for at in range(0, len(codes), 200_000):
                part = codes[at : at + 200_000].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), k, np.int32)), pa.array(part), pa.array(counts[at : at + 200_000])], ["key", "code", "n"])

        for batch in batches:
            texts = [body(t, lower) for t in binary_values(batch.column(batch.num_columns - 1))]
            owners = np.array(batch.column(0).to_pylist(), int) if keys else np.zeros(len(texts), int)
            for k in range(len(tallies)):
                for grams, first, end, _ in pieces([texts[i] for i in np.flatnonzero(owners == k)], depth):
                    tallies[k].add(inside(grams, first, end))
                if tallies[k].full():
                    yield from out(k)
        for k in range(len(tallies)):
            yield from out(k)

    return map_arrow(rows, run, "key int, code long, n long")


def count_grams(rows: DataFrame, depth: int, keys: int = 0, lower: bool = True) -> DataFrame:
    """(key, code, n) from rows (key, text), as ``tally_grams``, added up.

    Each task adds up its own grams before they are shuffled.
    """
    return tally_grams(rows, depth, keys, lower).groupBy("key", "code").agg(F.sum("n").alias("n"))


def threshold(counts: DataFrame, column: str, most: int, weight: str | None = None) -> int:
    """The smallest count that at most ``most`` rows reach, or rows of that total weight, to within an eighth of a power of two.

    The driver gets one number for each eighth of a power of two.
    """
    step = F.floor(F.log2(F.col(column).cast("double")) * 8).cast("int").alias("step")
    size = F.sum(weight) if weight else F.count(F.lit(1))
    left, above = most, 1 << 62
    for row in counts.groupBy(step).agg(F.min(column).alias("low"), size.alias("n")).orderBy(F.desc("step")).collect():
        left -= row["n"]
        if left < 0:
            return above
        above = row["low"]
    return 1


def shorter(grams: DataFrame, depth: int) -> DataFrame:
    """Counts of the grams with ``depth`` bytes of context, from those of longer ones."""
    return grams.groupBy(F.col("code").bitwiseAND(F.lit(mask(depth)).cast("long")).alias("code")).agg(F.sum("n").alias("n"))


def arrays(df: DataFrame) -> list[np.ndarray]:
    """The columns of a table of bounded size, sorted by the first as an unsigned number."""
    table = df.toArrow()
    columns = [c.to_numpy() for c in table.columns]
    order = np.argsort(columns[0].view(np.uint64))
    return [columns[0].view(np.uint64)[order], *(c[order] for c in columns[1:])]


class GramTable:
    """Finds the positions of grams in an array of distinct ones: open addressing, filled and searched by whole arrays."""

    def __init__(self, codes: np.ndarray):
        bits = max(4, int(2 * max(1, len(codes)) - 1).bit_length())
        self.shift, self.wrap = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.at = np.full(1 << bits, _EMPTY), np.zeros(1 << bits, np.int32)
        left = np.arange(len(codes))
        slot = self._slot(codes)
        while len(left):
            free = self.keys[slot] == _EMPTY
            self.keys[slot[free]] = codes[left[free]]
            won = self.keys[slot] == codes[left]
            self.at[slot[won]] = left[won]
            left, slot = left[~won], (slot[~won] + 1) & self.wrap

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return (codes * _FACTOR >> self.shift).astype(np.int64)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Positions, -1 for grams that aren't there."""
        slot = self._slot(codes)
        key = self.keys[slot]
        out = np.where(key == codes, self.at[slot], np.int32(-1))
        left = np.flatnonzero((key != codes) & (key != _EMPTY))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & self.wrap
            key = self.keys[slot]
            same = key == codes[left]
            out[left[same]] = self.at[slot[same]]
            on = ~same & (key != _EMPTY)
            left, slot = left[on], slot[on]
        return out


class BackoffModel:
    """log2 probabilities of a byte after its context, for one or several models at once.

    grams[d] = (codes, values): the full value of each gram with d bytes of context that some model has seen.
    contexts[d] = (codes, values): what a model adds when it goes from d bytes of context to fewer, 0 if it doesn't know the context.
    """

    def __init__(self, grams: list, contexts: list):
        self.grams, self.contexts, self.tables = grams, contexts, None
        self.depth = len(grams) - 1

    def _open(self):
        if self.tables is None:  # once in each worker
            self.tables = [GramTable(g[0]) for g in self.grams], [GramTable(c[0]) for c in self.contexts]
        return self.tables

    def values(self, codes: np.ndarray) -> np.ndarray:
        grams, contexts = self._open()
        at = grams[-1].find(codes)
        known = self.grams[-1][1]
        out = known[np.maximum(at, 0)] if len(known) else np.zeros((len(codes), *known.shape[1:]), np.float32)
        left = np.flatnonzero(at < 0)
        if len(left):
            rest, back = np.unique(codes[left], return_inverse=True)
            out[left] = self._slow(rest)[back]
        return out

    def _slow(self, codes: np.ndarray) -> np.ndarray:
        grams, contexts = self._open()
        out = np.zeros((len(codes), *self.grams[0][1].shape[1:]), np.float32)
        left = np.arange(len(codes))
        for d in range(self.depth, -1, -1):
            own = codes[left] & np.uint64(mask(d))
            at = grams[d].find(own)
            hit = at >= 0
            out[left[hit]] += self.grams[d][1][at[hit]]
            left, own = left[~hit], own[~hit]
            if not len(left):
                break
            at = contexts[d].find(own >> np.uint64(8))
            known = at >= 0
            out[left[known]] += self.contexts[d][1][at[known]]
        return out

    def score(self, bodies: list[bytes]) -> np.ndarray:
        """log2 probability of each text, a row per text."""
        total = np.zeros((len(bodies), *self.grams[0][1].shape[1:]))
        for grams, first, end, owner in pieces(bodies, self.depth):
            sums(self.values(grams), first, end, owner, total)
        return total
