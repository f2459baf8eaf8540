"""Language identification by prediction by partial matching.

For each language a tree of byte contexts of 0 to DEPTH bytes is counted from
labelled texts and then frozen. A byte that a context has seen costs
-log2(count / (total + kinds)); one that it hasn't costs the escape,
-log2(kinds / (total + kinds)), and goes on in the context that is one byte
shorter, in the end to 256 equally likely bytes (escape method C, no exclusion).
The language with the shortest exact code length of the whole text wins.

The trees are fitted on SAMPLE_DOCS documents of each language, chosen by a hash
of the id at a rate that the counts of all training documents give, and on whole
documents only up to SAMPLE_CHARS characters; these bounds are the parameters that limit
what is learned from. Prediction reads nothing
but the text.

Defined cases: a null text, or one without a letter, is 'und' with score 0; a
null id counts as an empty text in the split; rows with a null lang teach
nothing; without any labelled text everything is 'und'; ties go to the language
first by name; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor.llm.bytegrams import BackoffModel, body, count_grams, mask
from quaestor.llm.common import binary_values, id_remainder, map_arrow, materialise, opened, read, share, within_chars

DEPTH = 4
SAMPLE_DOCS = 1500
#: Characters of all languages together.
SAMPLE_CHARS = 1 << 24
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"


def build(counts: list[tuple[np.ndarray, np.ndarray]]) -> BackoffModel:
    """From each language's longest grams (codes, n)."""
    width = len(counts)
    union = np.unique(np.concatenate([c[0] for c in counts]))
    table = np.zeros((len(union), width))
    for k, (codes, n) in enumerate(counts):
        table[np.searchsorted(union, codes), k] = n
    levels = [(union, table)]
    for d in range(DEPTH - 1, -1, -1):
        codes, back = np.unique(levels[-1][0] & np.uint64(mask(d)), return_inverse=True)
        table = np.zeros((len(codes), width))
        np.add.at(table, back, levels[-1][1])
        levels.append((codes, table))
    levels.reverse()
    every = np.zeros((256, width))
    every[levels[0][0].astype(int)] = levels[0][1]
    levels[0] = (np.arange(256, dtype=np.uint64), every)
    grams, contexts, last = [], [], np.full((256, width), 1 / 256)
    for d, (codes, n) in enumerate(levels):
        context, at = np.unique(codes >> np.uint64(8), return_inverse=True)
        total, kinds = np.zeros((len(context), width)), np.zeros((len(context), width))
        np.add.at(total, at, n)
        np.add.at(kinds, at, n > 0)
        space = total + kinds
        escape = np.where(total > 0, kinds / np.maximum(space, 1), 1.0)
        if d:
            shorter = last[np.searchsorted(levels[d - 1][0], codes & np.uint64(mask(d - 1)))]
        else:
            shorter = last
        last = np.where(n > 0, n / np.maximum(space[at], 1), escape[at] * shorter)
        grams.append((codes, np.log2(last).astype(np.float32)))
        contexts.append((context, np.log2(escape).astype(np.float32)))
    return BackoffModel(grams, contexts)


def has_letter(text: bytes | None) -> bool:
    if not text:
        return False
    return text[:64].isalpha() or any(c.isalpha() for c in text.decode())


def train(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> tuple[list[str], BackoffModel | None]:
    """Languages, sorted, and their model, from rows (id, lang, text)."""
    labelled = labelled.filter(F.col("lang").isNotNull())
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return [], None
    number = F.create_map(*[F.lit(x) for k, name in enumerate(languages) for x in (name, k)])[F.col("lang")]
    rate = F.create_map(*[F.lit(x) for name in languages for x in (name, min(1.0, sample_docs / counts[name]))])[F.col("lang")]
    draw = F.pmod(F.xxhash64(F.lit("langid"), F.col("id")), F.lit(1 << 30)) / float(1 << 30)
    sample = within_chars(labelled.filter(draw < rate), "lang", sample_chars // len(languages)).select(number.cast("int").alias("key"), "text")
    table = materialise(count_grams(sample, DEPTH, keys=len(languages))).toArrow()
    keys, codes, n = (table.column(c).to_numpy() for c in ("key", "code", "n"))
    return languages, build([(codes[keys == k].view(np.uint64), n[keys == k]) for k in range(len(languages))])


def identify(docs: DataFrame, languages: list[str], model: BackoffModel | None, text_col: str = "text") -> DataFrame:
    """``docs`` (without the text) and lang_pred, score: the posterior of the winner for equal priors and one byte's mean code length taken 16 times."""
    shared = share(docs.sparkSession, model)
    at = docs.columns.index(text_col)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text_col] + ["lang_pred string", "score double"])

    def run(batches):
        for batch in batches:
            texts = binary_values(batch.column(at))
            names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            known = [i for i, t in enumerate(texts) if languages and has_letter(t)]
            if known:
                bodies = [body(texts[i]) for i in known]
                bits = opened(shared).score(bodies)
                best = bits.argmax(axis=1)
                mean = bits / np.array([len(b) for b in bodies])[:, None]
                weight = np.exp2(16 * (mean - mean.max(axis=1, keepdims=True)))
                scores[known] = weight[np.arange(len(known)), best] / weight.sum(axis=1)
                for i, k in zip(known, best.tolist(), strict=True):
                    names[i] = languages[k]
            own = [c for i, c in enumerate(batch.columns) if i != at]
            own_names = [c for i, c in enumerate(batch.schema.names) if i != at]
            yield pa.RecordBatch.from_arrays([*own, pa.array(names, pa.string()), pa.array(scores)], [*own_names, "lang_pred", "score"])

    return map_arrow(docs, run, schema)


def predictions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """One row per document: id, held_out, lang_pred, score."""
    held = (id_remainder(F.col(f"`{id_col}`"), FOLDS) == HELD_OUT).alias("held_out")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), held, F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text"))
    languages, model = train(rows.filter(~F.col("held_out")).drop("held_out"), sample_docs)
    return identify(rows.drop("lang"), languages, model)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
