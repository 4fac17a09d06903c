"""Language identification with string kernels.

The kernel of two texts counts the byte n-grams (n = 1 to ``LONGEST``, of the lower-cased
text, letters only, runs of anything else as one blank) present in both, over the root of
the product of their own counts: a blended-spectrum presence kernel. N-grams are hashed to
``GRAMS`` cells. ``LANDMARKS`` labelled texts per language span a Nyström map; one-versus-
rest kernel ridge regression is fitted on ``SAMPLE`` labelled texts per language. Both are
taken in the order of a hash of the id and bound the fit, whatever the corpus holds.

Since a response is linear in the presence vector, landmarks, map and coefficients are
multiplied out once into a weight matrix, cells x languages. Every whole text is then
scored by products of batches of presence vectors with that matrix: one narrow stage.

Nulls, ties: a null text or one without a letter gets ``und`` and score 0; null languages
and null ids are not learned from; equal responses go to the first language by code
point; without any training row all texts get ``und``. Repeated rows get equal answers;
other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkweave.llm import common

LONGEST = 4
GRAMS = 1 << 17
LANDMARKS = 48
SAMPLE = 1000
RIDGE = 1e-3
HELD = (4, 2)
UNDETERMINED = "und"

_LETTER = np.full(256, 32, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def presence(lowered: pa.Array) -> list[np.ndarray]:
    """For each lower-cased text the sorted cells of the n-grams it holds."""
    data, offsets = common.flat(lowered)
    row = np.repeat(np.arange(len(lowered)), np.diff(offsets))
    x = _LETTER[data]
    keep = x != 32
    if len(x):
        keep[1:] |= (x[:-1] != 32) & (row[1:] == row[:-1])
    x = x[keep].astype(np.uint32)
    ends = np.concatenate([[0], np.cumsum(keep)])[offsets]
    cells, code = [], np.zeros(len(x), np.uint32)
    for n in range(1, LONGEST + 1):
        code = code[: len(x) - n + 1] if n > 1 else x
        if n > 1:
            code = code * np.uint32(256) + x[n - 1 :]
        mixed = (code + np.uint32(n)) * np.uint32(2654435761)
        cells.append((mixed ^ (mixed >> np.uint32(15))) * np.uint32(2246822519) >> np.uint32(15))
    flags, out = np.zeros(GRAMS, bool), []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        for n, c in enumerate(cells):
            flags[c[a : max(a, b - n)]] = True
        held = np.flatnonzero(flags)
        flags[held] = False
        out.append(held)
    return out


def _has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


def _lowered(part: pa.RecordBatch) -> pa.Array:
    return pc.utf8_lower(pc.fill_null(part.column("text"), ""))


def _sample(docs: DataFrame) -> DataFrame:
    """Labelled texts to learn from: ``lang, place, doc_id, text``, the first SAMPLE ids per language.

    Rows that repeat an id and its language count once, with the smallest of their texts.
    """
    modulus, out = HELD
    labelled = docs.where(
        (common.held("doc_id", modulus) != out) & F.col("lang").isNotNull() & F.col("text").isNotNull()
    )
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = (
        labelled.select("doc_id", "lang")
        .distinct()
        .withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= SAMPLE)
    )
    return common.stash(
        labelled.select("doc_id", "lang", "text")
        .join(F.broadcast(ids), ["doc_id", "lang"])
        .groupBy("lang", "place", "doc_id")
        .agg(F.min("text").alias("text")),
        "labelled",
    )


def fit(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """The languages and the weight matrix (cells x languages)."""
    sample = _sample(docs)

    def cells(batches):
        for batch in batches:
            for part, _, _ in common.slices(batch, "text"):
                yield pa.RecordBatch.from_arrays(
                    [part.column("lang"), part.column("place"), pa.array(presence(_lowered(part)), pa.list_(pa.int64()))],
                    names=["lang", "place", "cells"],
                )

    marks = (
        sample.where(F.col("place") <= LANDMARKS)
        .select("lang", "place", "text")
        .mapInArrow(cells, "lang string, place int, cells array<long>")
        .collect()
    )
    marks = sorted(((r["lang"], r["place"], r["cells"]) for r in marks if r["cells"]))
    languages = sorted({m[0] for m in marks}, key=lambda x: x.encode())
    if not languages:
        return [], np.zeros((GRAMS, 0), np.float32)
    held = np.zeros((GRAMS, len(marks)), bool)
    for k, (_, _, c) in enumerate(marks):
        held[np.array(c), k] = True
    scale = 1 / np.sqrt(held.sum(axis=0))
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(held)

    def kernels(batches):
        for batch in batches:
            for part, _, _ in common.slices(batch, "text"):
                rows = [sent.value[c].sum(axis=0) * scale / max(1, len(c)) ** 0.5 for c in presence(_lowered(part))]
                yield pa.RecordBatch.from_arrays(
                    [part.column("lang"), part.column("place"), pa.array(rows, pa.list_(pa.float32()))],
                    names=["lang", "place", "row"],
                )

    found = sorted(
        (r["lang"], r["place"], r["row"])
        for r in sample.select("lang", "place", "text")
        .mapInArrow(kernels, "lang string, place int, row array<float>")
        .collect()
        if r["lang"] in languages
    )
    k_nm = np.array([f[2] for f in found])
    y = np.array([[1.0 if f[0] == c else -1.0 for c in languages] for f in found])
    share = np.array([1 / (y[:, languages.index(f[0])] > 0).sum() for f in found])
    both = np.stack([held[np.array(c)].sum(axis=0) for _, _, c in marks])
    value, vector = np.linalg.eigh(both * scale[:, None] * scale[None, :])
    good = value > 1e-6 * value.max()
    root = vector[:, good] / np.sqrt(value[good])
    phi = k_nm @ root
    weighted = phi * share[:, None]
    beta = np.linalg.solve(
        phi.T @ weighted + RIDGE * len(languages) * np.eye(phi.shape[1]), weighted.T @ y
    )
    return languages, held @ (scale[:, None] * (root @ beta)).astype(np.float32)


def predict(docs: DataFrame, languages: list[str], weights: np.ndarray) -> DataFrame:
    """``docs`` (with a column text) and ``lang_pred, score`` of every row."""
    names = docs.columns
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        w = sent.value
        for batch in batches:
            for part, data, offsets in common.slices(batch, "text"):
                cells = presence(_lowered(part))
                count = np.array([len(c) for c in cells])
                response = np.zeros((len(cells), len(languages)))
                some = np.flatnonzero(count)
                if len(some) and languages:
                    first = np.concatenate([[0], np.cumsum(count[some])[:-1]])
                    response[some] = np.add.reduceat(w[np.concatenate(cells)], first, axis=0)
                    response[some] /= np.sqrt(count[some])[:, None]
                plain = (common.LOWER[data] >= 97) & (common.LOWER[data] <= 122)
                seen = np.concatenate([[0], np.cumsum(plain)])
                letters = seen[offsets[1:]] > seen[offsets[:-1]]
                for k in np.flatnonzero(~letters & (np.diff(offsets) > 0)):
                    letters[k] = _has_letter(part.column("text")[k].as_py())
                known = letters & bool(languages)
                odds = np.exp(4 * (response - response.max(axis=1, keepdims=True, initial=-9)))
                best = response.argmax(axis=1) if languages else np.zeros(len(cells), int)
                score = np.where(known, 1 / np.maximum(1, odds.sum(axis=1)), 0.0)
                label = [languages[b] if k else UNDETERMINED for b, k in zip(best, known, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(label, pa.string()), pa.array(score)],
                    names=[*names, "lang_pred", "score"],
                )

    schema = docs.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row of ``docs``."""
    languages, weights = fit(docs)
    modulus, out = HELD
    rows = docs.select("doc_id", F.coalesce(common.held("doc_id", modulus) == out, F.lit(False)).alias("held_out"), "text")
    return predict(rows, languages, weights).drop("text")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents that some learned language can be given to; texts without letters go."""
    names = docs.columns
    languages, weights = fit(docs)
    plain = docs.select(F.struct(*names).alias("_row"), "text")
    if not languages:  # nothing to learn from: only texts without a letter are known to have none
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return predict(plain, languages, weights).where(F.col("lang_pred") != UNDETERMINED).select("_row.*")
