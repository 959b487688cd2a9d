"""Operator 7: a quality classifier on random Fourier features of document statistics.

One pass over all texts gives each document's statistics (whole text, nothing sampled). They are standardised over all
documents, mapped to ``FEATURES`` random cosines that approximate a Gaussian kernel, and a ridge fit solves the
normal equations, which partitions sum. Isotonic regression on rows kept out of that fit makes the ridge scores
probabilities. The fit takes at most ``labelled.MAX_LABELLED`` labelled documents.

Cases: a null or empty text has statistics of zero and gets their score; without two classes of labels every
score is the share of label 1 (0 without labels); repeated rows get equal scores; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dendrovox.llm import pieces
from dendrovox.llm.common import ddl, table
from dendrovox.llm.labelled import MAX_LABELLED, held_out, training_labels
from dendrovox.plans.iterate import materialize

THRESHOLD = 0.7
FEATURES, WIDTH, RIDGE, SEED = 256, 3.0, 1e-3, 7
#: One labelled row in so many calibrates instead of fitting.
CALIBRATE = 3


def statistics(text: str | None) -> list[float]:
    """Numbers that describe a text's make-up, length aside bounded and free of its language's words."""
    text = text or ""
    n = len(text)
    if not n:
        return [0.0] * 17
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = pieces.classes()[code]
    letters = kind == pieces.LETTER
    marks = code[kind == pieces.OTHER]
    upper = sum(map(str.isupper, text)) if not text.isascii() else int(((code >= 65) & (code <= 90)).sum())
    words = text.split()
    m = max(1, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    lines = [x for x in text.split("\n") if x]
    threes = set(zip(words, words[1:], words[2:], strict=False))
    raw = text.encode("utf-8", "surrogatepass")
    most = np.bincount(marks[marks < 128], minlength=128) if len(marks) else np.zeros(128)
    return [
        math.log1p(n),
        upper / max(1, int(letters.sum())),
        len(marks) / n,
        most[ord("!")] / m,
        most[ord("|")] / m,
        float(most[[ord(c) for c in "#$%&*<>{}=@^~_"]].sum()) / m,
        float(most[[ord(c) for c in ".,"]].sum()) / m,
        float((kind == pieces.NUMBER).sum()) / n,
        float((kind == pieces.WHITE).sum()) / n,
        float(sizes.mean()),
        float(sizes.std()),
        math.log(1 + len(set(words))) / math.log(1 + m),
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / m,
        len(threes) / max(1, len(words) - 2) if len(words) > 2 else 1.0,
        len(set(lines)) / max(1, len(lines)),
        len(lines) / m,
        min(2.0, len(zlib.compress(raw, 1)) / len(raw)),
    ]


def document_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id, x`` of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = pa.array([statistics(t.as_py()) for t in b["text"]], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b["doc_id"], x], ["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(run, ddl(docs, ["doc_id"], "x array<double>"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def fourier(x: np.ndarray, model: dict) -> np.ndarray:
    """Random cosines of standardised statistics (clipped at 6 deviations), and a constant."""
    z = np.clip((x - model["mean"]) / model["sd"], -6, 6)
    out = np.cos(z @ model["directions"] + model["phases"]) * math.sqrt(2 / FEATURES)
    return np.hstack([out, np.ones((len(x), 1))])


def isotonic(scores: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing step fit (pool adjacent violators): scores and their probabilities."""
    order = np.argsort(scores, kind="stable")
    blocks: list[list[float]] = []  # mean, weight, first score, last score
    for s, v in zip(scores[order], y[order], strict=True):
        blocks.append([float(v), 1.0, float(s), float(s)])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b = blocks.pop()
            a = blocks[-1]
            blocks[-1] = [(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2], b[3]]
    knots = np.array([k for b in blocks for k in (b[2], b[3])])
    return knots, np.array([b[0] for b in blocks for _ in (0, 1)])


def fit_quality(stats: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> dict:
    """The model, from ``document_statistics`` of all documents. Never reads a held-out row's label."""
    chosen = materialize(training_labels(labels, "quality", max_labelled), "labelled")
    width = 17
    moments = stats.agg(*[F.avg(F.col("x")[k]).alias(f"m{k}") for k in range(width)], *[F.stddev_pop(F.col("x")[k]).alias(f"s{k}") for k in range(width)]).first()
    model = {"mean": np.array([moments[f"m{k}"] or 0.0 for k in range(width)]), "sd": np.array([max(moments[f"s{k}"] or 0.0, 1e-6) for k in range(width)])}
    rng = np.random.default_rng(SEED)
    model |= {"directions": rng.normal(size=(width, FEATURES)) / WIDTH, "phases": rng.uniform(0, 2 * math.pi, FEATURES)}
    part = F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(CALIBRATE))
    sample = materialize(stats.join(F.broadcast(chosen), "doc_id").select("y", "x", (part == 0).alias("calibrates")), "sample")  # bounded by max_labelled
    share = sample.agg(F.avg("y")).first()[0]
    model["share"] = float(share or 0.0)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, right = np.zeros((FEATURES + 1, FEATURES + 1)), np.zeros(FEATURES + 1)
        for b in batches:
            z = fourier(_matrix(b["x"], width), model)
            gram += z.T @ z
            right += z.T @ b["y"].to_numpy().astype(float)
        yield pa.RecordBatch.from_arrays([pa.array([gram.tobytes()]), pa.array([right.tobytes()])], ["gram", "right"])

    if not 0 < model["share"] < 1:
        return model | {"weights": None}
    found = sample.where("not calibrates").repartition(8).mapInArrow(sums, "gram binary, right binary").collect()  # eight sums
    gram = sum(np.frombuffer(r["gram"]).reshape(FEATURES + 1, -1) for r in found)
    right = sum(np.frombuffer(r["right"]) for r in found)
    n = max(1.0, gram[-1, -1])
    model["weights"] = np.linalg.solve(gram + RIDGE * n / FEATURES * np.eye(FEATURES + 1), right)
    kept = sample.where("calibrates").select("x", "y").toPandas()
    if len(kept):
        raw = fourier(np.array(kept["x"].tolist(), float), model) @ model["weights"]
        model["knots"] = isotonic(raw, kept["y"].to_numpy(float))
    else:
        model["knots"] = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    return model


def score_quality(stats: DataFrame, model: dict) -> DataFrame:
    """``doc_id, score`` of ``document_statistics``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if model["weights"] is None:
                out = np.full(b.num_rows, model["share"])
            else:
                out = np.interp(fourier(_matrix(b["x"], 17), model) @ model["weights"], *model["knots"])
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(np.clip(out, 0.0, 1.0))], ["doc_id", "score"])

    return stats.mapInArrow(run, stats.select("doc_id").schema.add("score", "double"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = materialize(document_statistics(table(spark, sf_dir, "documents")), "statistics")
    scored = score_quality(stats, fit_quality(stats, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
