"""Benchmark decontamination with a generalised suffix automaton.

Words are runs of a-z, 0-9 and characters beyond ASCII, after lower-casing A-Z.
A window is WINDOW consecutive words of an item, or a whole item of fewer words;
the words of a document that lie inside an occurrence of a window are hit.

The automaton holds all items of a block of the benchmark. Every word of every
document is streamed through it, in many lanes at a time, and the longest match
that ends at each word tells which windows end there. It is packed in arrays of
some 60 bytes a benchmark word. Items are taken in blocks of at most BLOCK_WORDS words,
each a broadcast of bounded size; for more than one block the documents are
passed once a block and the findings are joined by id and text digest.

Defined cases: null texts have no words; an item without words has no window; a
null item id counts as an empty one; rows that repeat an item id are one item
with the windows of all; repeated documents get the same row each; an empty
benchmark hits nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaestor.llm.common import ascii_lower_sql, binary_values, free_name, map_arrow, materialise, opened, read, share, sized, with_arrow_column

WINDOW = 13
#: Contaminated: at least one word in so many is hit.
ONE_IN = 20
BLOCK_WORDS = 400_000

_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_NO_KEY = np.uint64((1 << 64) - 1)
#: A lane is so many windows long; so many lanes take their steps together.
_LANE = 16
_LANES = 4096


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TABLE).split()


class Automaton:
    """Generalised suffix automaton over word numbers, packed in arrays, with the windows that end in each state."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.number: dict[bytes, int] = {}
        self.names: list[str] = sorted({name for name, text in items if text})
        place = {name: k for k, name in enumerate(self.names)}
        growing, coded = _Growing(), []
        for name, text in items:
            if text:
                code = [self.number.setdefault(w, len(self.number) + 1) for w in text]
                coded.append((place[name], np.array(code, np.int64)))
                last = 0
                for w in code:
                    last = growing.extend(last, w)
        self.len, self.link = np.array(growing.len, np.int32), np.array(growing.link, np.int32)
        self.root = np.zeros(len(self.number) + 1, np.int32)
        self.root[list(growing.next[0].keys())] = list(growing.next[0].values())
        size = np.fromiter(map(len, growing.next), np.int64, len(growing.next))
        source = np.repeat(np.arange(len(size)), size)
        word = np.fromiter(chain.from_iterable(growing.next), np.uint64, int(size.sum()))
        to = np.fromiter(chain.from_iterable(f.values() for f in growing.next), np.int32, int(size.sum()))
        del growing
        self._pack(source.astype(np.uint64) << np.uint64(32) | word, to)
        self._mark(coded)

    def _pack(self, key: np.ndarray, to: np.ndarray) -> None:
        """Transitions in buckets of a hash of state and word: bucket b is from start[b] up to start[b + 1]."""
        self.shift = np.uint64(64 - max(4, int(len(key)).bit_length()))
        bucket = (key * _FACTOR) >> self.shift
        order = np.argsort(bucket, kind="stable")
        self.key, self.to = np.append(key[order], _NO_KEY), np.append(to[order], 0).astype(np.int32)
        self.start = np.searchsorted(bucket[order], np.arange((1 << (64 - int(self.shift))) + 1, dtype=np.uint64)).astype(np.int32)

    def _mark(self, coded: list[tuple[int, np.ndarray]]) -> None:
        """Windows by the state in which they end; for each state, the nearest such state and the shortest window of its suffixes."""
        triples = []
        for name, code in coded:
            n = min(self.window, len(code))
            state, length = self.stream(code)
            at = state[length >= n]
            while (deep := np.flatnonzero(self.len[self.link[at]] >= n)).size:
                at[deep] = self.link[at[deep]]
            triples.append(np.stack([at, np.full(len(at), n), np.full(len(at), name)], 1))
        found = np.unique(np.concatenate(triples), axis=0) if triples else np.zeros((0, 3), np.int64)
        self.end_state, self.end_n, self.end_name = (np.ascontiguousarray(found[:, k], np.int32) for k in range(3))
        far = np.iinfo(np.int32).max
        self.near, self.shortest = np.zeros(len(self.len), np.int32), np.full(len(self.len), far, np.int32)
        self.near[self.end_state] = self.end_state
        np.minimum.at(self.shortest, self.end_state, self.end_n)
        near, shortest = self.near.tolist(), self.shortest.tolist()
        for s, up in zip((order := np.argsort(self.len, kind="stable")[1:]).tolist(), self.link[order].tolist(), strict=True):
            near[s] = near[s] or near[up]
            shortest[s] = min(shortest[s], shortest[up])
        self.near, self.shortest = np.array(near, np.int32), np.array(shortest, np.int32)

    def _follow(self, state: np.ndarray, w: np.ndarray) -> np.ndarray:
        """The state after word ``w``, 0 if there is none; for states but the root."""
        key = state.astype(np.uint64) << np.uint64(32) | w.astype(np.uint64)
        bucket = ((key * _FACTOR) >> self.shift).astype(np.int64)
        at, end = self.start[bucket], self.start[bucket + 1]
        same = (self.key[at] == key) & (at < end)
        out = np.where(same, self.to[at], 0)
        left = np.flatnonzero(~same & (at + 1 < end))
        while left.size:
            at[left] += 1
            same = self.key[at[left]] == key[left]
            out[left[same]] = self.to[at[left[same]]]
            left = left[~same]
            left = left[at[left] + 1 < end[left]]
        return out

    def stream(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """After each word of a stream: the state, and the length of the longest match that ends there.

        The stream is cut into lanes that take their steps together. A lane begins
        window - 1 words early, so a length is exact up to the window, and at
        least the window if the match is longer.
        """
        early = self.window - 1
        span = _LANE * self.window
        lanes = -(-len(code) // span)
        padded = np.zeros(early + lanes * span, np.int64)
        padded[early : early + len(code)] = code
        states, lengths = np.zeros((lanes, span), np.int32), np.zeros((lanes, span), np.int32)
        for first in range(0, lanes, _LANES):
            some = np.arange(first, min(first + _LANES, lanes))
            state, length = np.zeros(len(some), np.int32), np.zeros(len(some), np.int32)
            for t in range(early + span):
                w = padded[some * span + t]
                to = self.root[w]
                grown = (w > 0).astype(np.int32)  # every word that has a number follows the root
                left = np.flatnonzero((state > 0) & (w > 0))
                at, held = state[left], length[left]
                while left.size:
                    new = self._follow(at, w[left])
                    ok = new > 0
                    to[left[ok]] = new[ok]
                    grown[left[ok]] = held[ok] + 1
                    at = self.link[at[~ok]]
                    held = self.len[at]
                    left = left[~ok]
                    deep = at > 0
                    left, at, held = left[deep], at[deep], held[deep]
                state, length = to, grown
                if t >= early:
                    states[first : first + len(some), t - early] = state
                    lengths[first : first + len(some), t - early] = length
        return states.reshape(-1)[: len(code)], lengths.reshape(-1)[: len(code)]

    def match(self, code: np.ndarray) -> tuple[list[tuple[int, int, set[str]]], np.ndarray]:
        """Windows found in a stream of word numbers (0: none): (first, end, items), and the mask of words hit."""
        state, length = self.stream(code)
        found, hit = [], np.zeros(len(code), bool)
        for i in np.flatnonzero(self.shortest[state] <= length).tolist():
            at, most = int(self.near[state[i]]), int(length[i])
            while at:
                a, b = np.searchsorted(self.end_state, [at, at + 1]).tolist()
                for n in set(self.end_n[a:b].tolist()):
                    if n <= most:
                        found.append((i - n + 1, i + 1, {self.names[k] for k in self.end_name[a:b][self.end_n[a:b] == n].tolist()}))
                        hit[i - n + 1 : i + 1] = True
                at = int(self.near[self.link[at]])
        return found, hit


class _Growing:
    """The automaton while words are added."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [0], [0]

    def _add(self, length: int, link: int, follow: dict[int, int]) -> int:
        self.len.append(length)
        self.link.append(link)
        self.next.append(follow)
        return len(self.len) - 1

    def _lead(self, p: int, w: int, old: int | None, new: int) -> int:
        """Along suffix links from ``p``, words ``w`` that lead to ``old`` lead to ``new``; gives the state that has another, -1 beyond the root."""
        while self.next[p].get(w) == old:
            self.next[p][w] = new
            if not p:
                return -1
            p = self.link[p]
        return p

    def _split(self, p: int, q: int, w: int) -> int:
        copy = self._add(self.len[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        self._lead(p, w, q, copy)
        return copy

    def extend(self, last: int, w: int) -> int:
        q = self.next[last].get(w)
        if q is not None:
            return q if self.len[q] == self.len[last] + 1 else self._split(last, q, w)
        new = self._add(self.len[last] + 1, 0, {})
        p = self._lead(last, w, None, new)
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.len[q] == self.len[p] + 1 else self._split(p, q, w)
        return new


def matches(automaton: Automaton, texts: list) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
    """For each text: its number of words, the spans (first, end) of words hit, and the items that hit them."""
    starts, code, get = [], [], automaton.number.get
    for text in texts:
        starts.append(len(code))
        code.extend(map(get, words(text), repeat(0)))
        code.append(0)  # no window spans two texts
    stream = np.array(code, np.int64)
    found, hit = automaton.match(stream)
    ends = [*starts[1:], len(code)]
    items: dict[int, set[str]] = {}
    if found:
        owner = np.searchsorted(np.array(starts), np.array([f[0] for f in found]), side="right") - 1
        for k, (_, _, names) in zip(owner.tolist(), found, strict=True):
            items.setdefault(k, set()).update(names)
    out = []
    for k, (start, end) in enumerate(zip(starts, ends, strict=True)):
        spans = []
        if k in items:
            edge = np.flatnonzero(np.diff(np.r_[False, hit[start : end - 1], False])).tolist()
            spans = list(zip(edge[::2], edge[1::2], strict=True))
        out.append((end - start - 1, spans, items.get(k, set())))
    return out


def automata(benchmark: DataFrame, id_col: str, text_col: str, window: int, block_words: int):
    """One automaton for each block of items; only one block is on the driver at a time."""
    block, held = [], 0
    rows = benchmark.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), F.col(f"`{text_col}`").alias("text"))
    for row in rows.toLocalIterator(prefetchPartitions=False):
        text = words((row.text or "").encode())
        if block and held + len(text) > block_words:
            yield Automaton(block, window)
            block, held = [], 0
        block.append((row.id, text))
        held += len(text)
    yield Automaton(block, window)


_RESULT = "id long, n_words long, spans array<struct<first:long,end:long>>, items array<string>"


def _pass(rows: DataFrame, shared, columns: str) -> DataFrame:
    """One pass over (id, ..., text): the columns before text, and the findings of one automaton."""

    def run(batches):
        for batch in batches:
            found = matches(opened(shared), binary_values(batch.column(batch.num_columns - 1)))
            spans = pa.array([[{"first": a, "end": b} for a, b in f[1]] for f in found], pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])))
            new = [pa.array([f[0] for f in found], pa.int64()), spans, pa.array([sorted(f[2]) for f in found], pa.list_(pa.string()))]
            own = batch.schema.names[:-1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], [*own, "n_words", "spans", "items"])

    return map_arrow(rows, run, columns)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(f"`{text_col}`")
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.md5(F.coalesce(text, F.lit("")).cast("binary")).alias("key"), text.alias("text"))


def _over_blocks(keyed: DataFrame, blocks) -> DataFrame:
    """For more than one block: (of, has, spans, items) of each id and text digest with a hit, written."""
    parts = None
    columns = _RESULT.replace("id long, ", "id long, key string, ")
    for automaton in blocks:
        shared = share(keyed.sparkSession, automaton)
        part = materialise(_pass(keyed, shared, columns).filter(F.size("items") > 0).dropDuplicates(["id", "key"]))
        parts = part if parts is None else parts.unionByName(part)
        shared.unpersist()
    inside = F.expr("flatten(transform(spans, s -> sequence(s.first, s.end - 1)))")
    hit = parts.select("id", "key", F.explode(inside).alias("at")).distinct()
    # Along a run of words hit, position and rank differ by the same number.
    runs = hit.groupBy("id", "key").agg(F.array_sort(F.collect_list("at")).alias("at"))
    runs = runs.select("id", "key", F.posexplode("at").alias("rank", "at")).groupBy("id", "key", (F.col("at") - F.col("rank")).alias("run"))
    runs = runs.agg(F.struct(F.min("at").alias("first"), (F.max("at") + 1).alias("end")).alias("span"))
    runs = runs.groupBy("id", "key").agg(F.array_sort(F.collect_list("span")).alias("spans")).withColumnsRenamed({"id": "of", "key": "has"})
    items = parts.select("id", "key", F.explode("items").alias("item")).groupBy("id", "key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    both = runs.join(items, F.col("id").eqNullSafe(F.col("of")) & (F.col("key") == F.col("has")))
    return materialise(both.select("of", "has", "spans", "items"))


def findings(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document: id, n_words, spans (first and end of each run of words hit), items (sorted)."""
    keyed = _keyed(docs, id_col, text_col)
    blocks = automata(benchmark, item_col, item_text_col, window, block_words)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return _pass(keyed.select("id", "text"), share(docs.sparkSession, first), _RESULT)
    found = _over_blocks(keyed, chain([first, second], blocks))
    count = with_arrow_column(keyed, "n_words", T.LongType(), lambda batch: pa.array([len(words(t)) for t in binary_values(batch.column(2))], pa.int64()))
    both = count.drop("text").join(sized(found), F.col("id").eqNullSafe(F.col("of")) & (F.col("key") == F.col("has")), "left")
    none = F.array().cast("array<struct<first:bigint,end:bigint>>")
    return both.select("id", "n_words", F.coalesce("spans", none).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def _hits():
    return F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.first)")


def _cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``text`` without the words of ``spans`` and what is between them."""
    at = [m.span() for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", text)]
    out, upto = [], 0
    for first, end in spans:
        out.append(text[upto : at[first][0]])
        upto = at[end - 1][1]
    return b"".join([*out, text[upto:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, one_in: int = ONE_IN, cut: bool = False, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` without the contaminated documents; with ``cut``, also without the spans hit in those that stay."""
    at, columns = docs.columns.index(text_col), docs.columns
    blocks = automata(benchmark, item_col, item_text_col, window, block_words)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        rows, shared = docs, share(docs.sparkSession, first)

        def spans_of(batch):
            return [(n, spans) for n, spans, _ in matches(opened(shared), binary_values(batch.column(at)))]
    else:
        of, has, spans = (free_name(docs, x) for x in ("of", "has", "spans"))
        found = _over_blocks(_keyed(docs, id_col, text_col), chain([first, second], blocks))
        found = found.select(F.col("of").alias(of), F.col("has").alias(has), F.col("spans").alias(spans))
        key = F.md5(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary"))
        rows = docs.join(sized(found), F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(of)) & (key == F.col(has)), "left").select(*[F.col(f"`{c}`") for c in columns], spans)

        def spans_of(batch):
            listed = [[(s["first"], s["end"]) for s in x or ()] for x in batch.column(len(columns)).to_pylist()]
            return [(len(words(t)), s) for t, s in zip(binary_values(batch.column(at)), listed, strict=True)]

    kind = docs.schema

    def run(batches):
        for batch in batches:
            found = spans_of(batch)
            hit = [sum(b - a for a, b in spans) for _, spans in found]
            keep = pa.array([not (h and one_in * h >= n) for h, (n, _) in zip(hit, found, strict=True)], pa.bool_())
            own = batch.columns[: len(columns)]
            if cut:
                new = [t if not spans or t is None else _cut(t, spans) for t, (_, spans) in zip(binary_values(own[at]), found, strict=True)]
                own[at] = pa.array(new, pa.binary()).cast(own[at].type)
            yield pa.RecordBatch.from_arrays(own, batch.schema.names[: len(columns)]).filter(keep)

    return map_arrow(rows, run, kind)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = findings(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).withColumn("n_hit", _hits())
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (ONE_IN * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


_WORDS = "regexp_extract_all(" + ascii_lower_sql("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_WORDS} AS ws FROM benchmark),
iw AS (SELECT DISTINCT item, least(13, len(ws)) AS n, array_to_string(ws[i:i + least(13, len(ws)) - 1], ' ') AS w
  FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
dw AS (SELECT r, i, n, array_to_string(ws[i:i + n - 1], ' ') AS w
  FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM iw) WHERE len(ws) >= n)),
m AS (SELECT r, i, n, item FROM dw JOIN iw USING (n, w)),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM m) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""
