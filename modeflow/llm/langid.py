"""Language identification by segmentation-marginalised unigrams.

Each language is a unigram model over the pieces of a fixed public vocabulary. Its piece probabilities are the expected piece
uses, over all segmentations, in a bounded sample of labelled documents. A text's score under a language sums the log
marginals of its words, each a forward recursion over all segmentations of the word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lattice as L
from . import textops as T
from .common import bounded_sample, held_out, table

#: About so many labelled documents are learned from at most; their choice; pseudo-counts of the vocabulary's own scores.
SAMPLE, SEED, STRENGTH = 12_000, 29, 200.0
UNKNOWN = "und"

_LETTERS = T._LOWER.copy()
_LETTERS[[b for b in range(128) if not (65 <= b <= 90 or 97 <= b <= 122)]] = 0x20


def distinct_words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Lower-cased letters, starts and ends of their distinct runs, and for all runs the number of the run and the row."""
    low = _LETTERS[data]
    starts, ends, owner = T.words(low, offs)
    _, first, which = np.unique(T.word_hashes(low, starts, ends), return_index=True, return_inverse=True)
    return low, starts[first], ends[first], which, owner


def learn(docs: DataFrame, text_col: str, lang_col: str, path: str, sample: int = SAMPLE) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The languages in order, their shares of the sample and their piece probabilities.

    docs: labelled documents only. What reaches the driver is bounded by languages times pieces.
    """
    chosen = bounded_sample(docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), "__id"), "__id", sample, SEED)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, p = L.load(path)
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for first, n, data, offs in T.steps(batch.column(1)):
                low, starts, ends, which, owner = distinct_words(data, offs)
                of_row = langs[first : first + n]
                for lang in set(of_row):
                    weights = np.bincount(which, (of_row == lang)[owner].astype(float), len(starts))
                    used = np.flatnonzero(weights)
                    got = sums.setdefault(lang, np.zeros(vocabulary.n + 2))
                    got[:-2] += L.expected_counts(vocabulary, p, low, starts[used], ends[used], weights[used])
                    got[-2] += weights.sum()
                    got[-1] += (of_row == lang).sum()
        for lang, got in sums.items():
            at = np.flatnonzero(got)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at, pa.int32()), pa.array(got[at])], ["lang", "piece", "n"])

    vocabulary, p = L.load(path)
    rows = chosen.mapInArrow(count, "lang string, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(rows["lang"].unique(), key=lambda x: x.encode())
    models, shares = np.zeros((len(langs), vocabulary.n)), np.zeros(len(langs))
    for k, lang in enumerate(langs):
        own = rows[rows["lang"] == lang].sort_values("piece")
        got = np.zeros(vocabulary.n + 2)
        got[own["piece"]] = own["n"]
        models[k], shares[k] = L.smoothed(got[:-2], got[-2], p, STRENGTH), got[-1]
    return langs, shares / max(shares.sum(), 1), models


def identify(df: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """id, lang_pred and score (the posterior probability of the prediction) of every row.

    A text that is null or has no letter is `und` with score 0, as is any text if no language was learned. Ties go to the
    first language by code points. Upper and lower case A-Z are alike; ASCII characters other than letters only separate
    words; words of any length count whole.
    """
    langs, shares, models = model
    path = path or L.default_path()
    shared = df.sparkSession.sparkContext.broadcast(models)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, _ = L.load(path)
        prior = np.log(np.maximum(shares, 1e-12))
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for first, n, data, offs in T.steps(texts):
                names, scores = np.array([UNKNOWN] * n, object), np.zeros(n)
                if langs:
                    low, starts, ends, which, owner = distinct_words(data, offs)
                    each = L.marginals(vocabulary, shared.value, low, starts, ends)
                    sums = np.stack([np.bincount(owner, each[k][which], n) for k in range(len(langs))]) + prior[:, None]
                    best = sums.argmax(axis=0)
                    lettered = np.zeros(n, bool)
                    lettered[owner] = True
                    if (data >= 128).any():  # runs of other bytes alone may hold no letter
                        plain = np.zeros(n, bool)
                        ascii_at = np.flatnonzero((data < 128) & (low != 0x20))
                        plain[np.searchsorted(offs, ascii_at, "right") - 1] = True
                        for r in np.flatnonzero(lettered & ~plain):
                            lettered[r] = any(c.isalpha() for c in data[offs[r] : offs[r + 1]].tobytes().decode())
                    names[lettered] = np.array(langs, object)[best[lettered]]
                    scores = np.where(lettered, 1 / np.exp(sums - sums.max(axis=0)).sum(axis=0), 0.0)
                yield pa.RecordBatch.from_arrays([ids.slice(first, n), pa.array(names, pa.string()), pa.array(scores)], [id_col, "lang_pred", "score"])

    rows = df.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    return rows.mapInArrow(predict, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, lang_pred string, score double")


def op9_langid(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    labelled = docs.where(~held_out(3, 1) & F.col("text").isNotNull() & F.col("lang").isNotNull()).withColumn("__id", F.col("doc_id"))
    found = identify(docs, learn(labelled, "text", "lang", L.default_path()))
    return found.select("doc_id", held_out(3, 1).alias("held_out"), "lang_pred", "score")
