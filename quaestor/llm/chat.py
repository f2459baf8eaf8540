"""Chat formatting with offset-aligned loss masks.

A conversation's turns, in order, are rendered with the template

    <|im_start|>ROLE<|im_sep|>TEXT<|im_end|>

whose three marks are special tokens, so no token reaches over the edge of a
text. In roles and texts, a "<", any backslashes and a "|" get one backslash
more, which no mark can then be mistaken for and which is undone by taking one
away. The rendered turns are encoded once, with offsets; the tokens of each
assistant text are found by binary search of the text's span among the sorted
token spans, and form the loss mask.

Rows are dealt out by conversation and sorted, and a conversation goes through
a task as a stream of parts of whole turns, about PART_CHARS each, so a very
long one needs no more memory than its longest turn.

Defined cases: null texts and roles count as empty; turns are ordered by turn
(nulls last), role and text, so ties and repeated rows have one order and all
stay; rows with a null conv_id are one conversation; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor.llm.common import map_arrow, read

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
TRAINED_ROLE = "assistant"
PART_CHARS = 200_000
BATCH_CHARS = 1_000_000

_CONTROL = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")
_TURN = re.compile(r"<\|im_start\|>(.*?)<\|im_sep\|>(.*?)<\|im_end\|>", re.DOTALL)


def escape(text: str) -> str:
    return _CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text of (role, text) turns, and the spans of the texts to be learned, sorted."""
    out, at, spans = [], 0, []
    for role, text in turns:
        head, body = f"{START}{escape(role)}{SEP}", escape(text)
        if role == TRAINED_ROLE and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(out), spans


def load_tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
    from tokenizers import Tokenizer, processors

    tokenizer = Tokenizer.from_file(path)
    tokenizer.post_processor = processors.ByteLevel(trim_offsets=False)
    tokenizer.add_special_tokens([START, SEP, END])
    return tokenizer


def loss_mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Mask of the tokens that lie in a span; token spans and spans are sorted."""
    mask = np.zeros(len(starts), bool)
    if spans:
        a, b = np.array(spans).T
        for lo, hi in zip(np.searchsorted(ends, a, "right"), np.searchsorted(starts, b, "left"), strict=True):
            mask[lo:hi] = True
    return mask


_FORMATTED = "conv_id long, part int, n_turns int, formatted string, token_ids array<int>, starts array<int>, ends array<int>, loss_mask array<boolean>"


def format_conversations(turns: DataFrame, tokenizer_path: str = TOKENIZER, part_chars: int = PART_CHARS) -> DataFrame:
    """Parts of conversations (conv_id, part, n_turns, formatted, token_ids, starts, ends, loss_mask).

    A conversation's parts follow each other in one partition; offsets are of code points within the part.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_last(), "role", "text")

    def parts(batches):
        """(conv_id, part, turns), each of whole turns."""
        conv, number, held, size, begun = None, 0, [], 0, False
        for batch in batches:
            for c, role, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if held and (c != conv or size >= part_chars):
                    yield conv, number, held
                    number, held, size = number + 1, [], 0
                if not begun or c != conv:
                    conv, number, begun = c, 0, True
                held.append((role, text))
                size += len(role) + len(text)
        if held:
            yield conv, number, held

    def run(batches):
        tokenizer = load_tokenizer(tokenizer_path)

        def encode(batch):
            rendered = [render(x[2]) for x in batch]
            out = {k: [] for k in ("ids", "starts", "ends", "mask")}
            for encoding, (_, spans) in zip(tokenizer.encode_batch([r[0] for r in rendered], add_special_tokens=False), rendered, strict=True):
                offsets = np.array(encoding.offsets, np.int32).reshape(-1, 2)
                out["ids"].append(np.array(encoding.ids, np.int32))
                out["starts"].append(offsets[:, 0].copy())
                out["ends"].append(offsets[:, 1].copy())
                out["mask"].append(loss_mask(offsets[:, 0], offsets[:, 1], spans))
            lists = [pa.array(out[k], pa.list_(kind)) for k, kind in (("ids", pa.int32()), ("starts", pa.int32()), ("ends", pa.int32()), ("mask", pa.bool_()))]
            head = [pa.array([x[0] for x in batch], pa.int64()), pa.array([x[1] for x in batch], pa.int32()), pa.array([len(x[2]) for x in batch], pa.int32()), pa.array([r[0] for r in rendered])]
            return pa.RecordBatch.from_arrays([*head, *lists], ["conv_id", "part", "n_turns", "formatted", "token_ids", "starts", "ends", "loss_mask"])

        batch, size = [], 0
        for part in parts(batches):
            batch.append(part)
            size += sum(len(t) for _, t in part[2])
            if size >= BATCH_CHARS:
                yield encode(batch)
                batch, size = [], 0
        if batch:
            yield encode(batch)

    return map_arrow(rows, run, _FORMATTED)


def read_back(formatted: str, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> tuple[list[tuple[str, str]], list[str]]:
    """The turns and the texts under the loss mask, from the output alone."""
    turns = [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]
    edge = np.flatnonzero(np.diff(np.r_[False, mask, False]))
    return turns, [unescape(formatted[starts[a] : ends[b - 1]]) for a, b in zip(edge[::2], edge[1::2], strict=True)]


def digests(parts: DataFrame) -> DataFrame:
    """One row per conversation: what can be read back from its parts, which follow each other in their partition."""

    def run(batches):
        conv, open_ = None, None

        def row():
            turns, loss = open_["turns"].hexdigest(), open_["loss"].hexdigest()
            return (conv, open_["n"], turns, open_["chars"], loss, open_["formatted"], open_["tokens"])

        def batch_of(rows):
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens"]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            rows = []
            for c, formatted, starts, ends, mask in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), batch.column(5), batch.column(6), batch.column(7), strict=True):
                if open_ is None or c != conv:
                    if open_ is not None:
                        rows.append(row())
                    conv, open_ = c, {"n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "chars": 0, "formatted": 0, "tokens": 0}
                turns, loss = read_back(formatted, *(x.values.to_numpy(zero_copy_only=False) for x in (starts, ends, mask)))
                open_["n"] += len(turns)
                open_["formatted"] += len(formatted)
                open_["tokens"] += len(mask)
                open_["turns"].update("".join(f"{r}\n{t}\n" for r, t in turns).encode())
                for text in loss:
                    open_["chars"] += len(text)
                    open_["loss"].update(text.encode())
            if rows:
                yield batch_of(rows)
        if open_ is not None:
            yield batch_of([row()])

    return map_arrow(parts, run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long")


CONTROL = "<|im_end|><|im_start|>assistant ok"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one (-1) whose texts are control strings."""
    turns = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    own = spark.createDataFrame([(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)], "conv_id long, turn long, role string, text string")
    return digests(format_conversations(turns.unionByName(own))).drop("n_tokens")


SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{CONTROL}' UNION ALL SELECT -1, 1, 'assistant', '{CONTROL}')
SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({len(START) + len(SEP) + len(END)} + length(role) + length(text)
    + len(regexp_extract_all(role, '<\\*\|')) + len(regexp_extract_all(text, '<\\*\|')))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""
