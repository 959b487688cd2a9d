"""Operator 8: a toxicity classifier that is regularised by counterfactuals.

A document is the set of its words and of their first three, four and five letters. Features whose presence speaks for
toxicity with confidence (the lower bound of the smoothed log odds ratio) are kept, and all features of
the identity terms. In labelled sentences that mention a group, the term is swapped for another of its kind, and a
logistic fit pays for the squared change of the score, so mentioning a group moves no score.

The fit takes at most ``labelled.MAX_LABELLED`` documents; counting their features is a Spark aggregation, and only
the kept features of that bounded sample reach the driver. Scoring is one pass over all texts.

Cases: a null or empty text gets the score of no features; without two classes of labels every score is the
share of label 1 (0 without labels); repeated rows get equal scores; an empty table gives no rows; other columns are
ignored by ``score_toxicity`` and kept by ``drop_toxic``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dendrovox.llm.common import ddl, slices, small_side, table
from dendrovox.llm.labelled import MAX_LABELLED, held_out, training_labels
from dendrovox.llm.pieces import Memo
from dendrovox.plans.iterate import materialize, settle

THRESHOLD = 0.3
MAX_FEATURES, MIN_DOCS, MIN_EVIDENCE = 512, 2, 1.0
#: Documents that are a dense block at a time in the fit.
FIT_ROWS = 1024
#: The ridge is for the summed loss, so it weighs less the more documents there are.
RIDGE, COUNTERFACTUAL = 0.3, 10.0
# Neutral names of groups, by kind; a term is swapped for the next of its kind.
IDENTITY = (
    ("women", "men", "girls", "boys", "mothers", "fathers"),
    ("woman", "man", "girl", "boy", "mother", "father"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab", "african"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "heterosexual"),
    ("immigrants", "refugees", "foreigners", "natives", "citizens"),
    ("disabled", "blind", "deaf", "autistic"),
    ("old", "young", "elderly", "teenage"),
)
SWAP = {a: kind[(k + 1) % len(kind)] for kind in IDENTITY for k, a in enumerate(kind)}
_WORD, _SENTENCE = re.compile(r"[^\W_]+"), re.compile(r"[.!?\n]+")


def word_features(word: str) -> tuple[str, ...]:
    return (word, *(word[:k] + "~" for k in (3, 4, 5) if len(word) > k))


def document_words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def swapped_pairs(text: str | None) -> list[tuple[list[str], list[str]]]:
    """Features of each sentence that names a group, before and after the swap (only those that differ)."""
    out, lower = [], (text or "").lower()
    if not any(term in lower for term in SWAP):
        return out
    for sentence in _SENTENCE.split(lower):
        words = set(_WORD.findall(sentence))
        if named := words & SWAP.keys():
            before = {f for w in words for f in word_features(w)}
            after = {f for w in (words - named) | {SWAP[w] for w in named} for f in word_features(w)}
            out.append((sorted(before - after), sorted(after - before)))
    return out


def _featurise(labelled: DataFrame) -> DataFrame:
    """``doc_id, y, features`` and, for sentences that name a group, ``gone, new``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 128):
            rows = {"doc_id": [], "y": [], "features": [], "gone": [], "new": []}
            for i, y, t in zip(b["doc_id"].to_pylist(), b["y"].to_pylist(), b["text"].to_pylist(), strict=True):
                plain = sorted({f for w in document_words(t) for f in word_features(w)})
                for features, gone, new in [(plain, None, None), *((None, g, n) for g, n in swapped_pairs(t))]:
                    for k, v in zip(rows, (i, y, features, gone, new), strict=True):
                        rows[k].append(v)
            texts = pa.list_(pa.string())
            kinds = (b["doc_id"].type, pa.int32(), texts, texts, texts)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), kinds, strict=True)], list(rows))

    schema = ddl(labelled, ["doc_id"], "y int, features array<string>, gone array<string>, new array<string>")
    return labelled.mapInArrow(run, schema)


def fit_logistic(rows: tuple[np.ndarray, np.ndarray], y: np.ndarray, swaps: np.ndarray, ridge: float = RIDGE, penalty: float = COUNTERFACTUAL) -> tuple[np.ndarray, float]:
    """Weights and intercept that minimise mean log loss + ridge / n |w|^2 / 2 + penalty mean((swaps w)^2) / 2, by Newton steps.

    ``rows``: offsets and feature numbers of the documents; only a block of them is dense at a time.
    """
    (offsets, features), n, d = rows, len(y), swaps.shape[1]
    fixed = np.zeros((d + 1, d + 1))
    fixed[:d, :d] = np.eye(d) * ridge / n
    if len(swaps):
        fixed[:d, :d] += penalty * (swaps.T @ swaps) / len(swaps)
    w = np.zeros(d + 1)
    w[d] = np.log((y.sum() + 0.5) / (n - y.sum() + 0.5))
    for _ in range(25):
        gradient, curve = fixed @ w, fixed + 1e-9 * np.eye(d + 1)
        for a in range(0, n, FIT_ROWS):
            at = offsets[a : a + FIT_ROWS + 1]
            x = np.zeros((len(at) - 1, d + 1))
            x[:, d] = 1
            x[np.repeat(np.arange(len(at) - 1), np.diff(at)), features[at[0] : at[-1]]] = 1
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            gradient += x.T @ (p - y[a : a + FIT_ROWS]) / n
            curve += (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x / n
        step = np.linalg.solve(curve, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:d], float(w[d])


def _numbers(column: pa.ChunkedArray, kept: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and feature numbers of a column of lists of kept features."""
    lists = column.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return np.append(0, np.cumsum(sizes)), pc.index_in(lists.flatten(), kept).to_numpy(zero_copy_only=False).astype(np.int64)


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> dict:
    """``weights`` by feature and ``intercept``. Never reads a held-out row's label."""
    chosen = materialize(training_labels(labels, "toxic", max_labelled), "labelled")
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # bounded by max_labelled
    rows = materialize(_featurise(texts), "features")
    whole = rows.where("features is not null")
    total = whole.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("pos")).first()
    n, pos = total["n"], total["pos"]
    if not 0 < pos < n:
        p = pos / n if n else 0.0
        return {"weights": {}, "intercept": None, "share": p}
    named = sorted({f for kind in IDENTITY for w in kind for f in word_features(w)})
    counted = whole.select("y", F.explode("features").alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("df"), F.sum("y").alias("p"))
    yes, no = F.col("p") + 0.5, F.col("df") - F.col("p") + 0.5
    evidence = F.log(yes / (pos + 1)) - F.log(no / (n - pos + 1)) - 1.64 * F.sqrt(1 / yes + 1 / no)
    best = counted.where(F.col("df") >= MIN_DOCS).select("f", evidence.alias("e")).where(F.col("e") >= MIN_EVIDENCE).orderBy(F.desc("e"), "f").limit(MAX_FEATURES).select("f")
    met = whole.select(F.explode(F.array_intersect("features", F.array(*map(F.lit, named)))).alias("f")).distinct()
    swapped = rows.where("gone is not null").select(F.explode(F.concat("gone", "new")).alias("f")).where(F.col("f").isin(named)).distinct()
    names = [r["f"] for r in best.union(met.union(swapped).distinct()).distinct().orderBy("f").collect()]  # bounded
    if not names:
        return {"weights": {}, "intercept": None, "share": pos / n}
    wanted, kept = F.array(*map(F.lit, names)), pa.array(names)
    cut = rows.select("y", *[F.array_intersect(c, wanted).alias(c) for c in ("features", "gone", "new")])
    plain = cut.where("features is not null").select("y", "features").toArrow()  # bounded by max_labelled
    pairs = cut.where("gone is not null").select("gone", "new").toArrow()
    swaps = np.zeros((pairs.num_rows, len(names)), np.float32)
    if pairs.num_rows:
        for column, sign in (("gone", -1), ("new", 1)):
            offsets, features = _numbers(pairs[column], kept)
            swaps[np.repeat(np.arange(pairs.num_rows), np.diff(offsets)), features] = sign
    w, b = fit_logistic(_numbers(plain["features"], kept), plain["y"].to_numpy().astype(float), swaps)
    return {"weights": {f: float(v) for f, v in zip(names, w, strict=True) if abs(v) > 1e-9}, "intercept": b, "share": pos / n}


def score_toxicity(docs: DataFrame, model: dict) -> DataFrame:
    """``doc_id, score`` of each row of ``docs`` (``doc_id, text``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = model["weights"]
        known = Memo(lambda w: tuple(f for f in word_features(w) if f in weights), 100_000)
        for b in slices(batches):
            out = []
            for t in b["text"].to_pylist():
                if model["intercept"] is None:
                    out.append(model["share"])
                    continue
                met = {f for w in document_words(t) for f in known[w]}
                z = model["intercept"] + sum(weights[f] for f in sorted(met))
                out.append(float(1 / (1 + np.exp(-np.clip(z, -30, 30)))))
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(out, pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, docs.select("doc_id").schema.add("score", "double"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents that score ``threshold`` or more; all columns stay."""
    bad = settle(lambda: score_toxicity(docs, fit_toxicity(docs, labels)).where(F.col("score") >= threshold).select("doc_id").distinct(), "toxic")
    return docs.join(small_side(bad), "doc_id", "left_anti").select(docs.columns)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
