import random
import zlib

import numpy as np
import pytest
from helpers import SCHEMA, Union

from dendrovox.llm import embeddings, quality, toxicity

TOXIC = ["idiot", "moron", "scum"]


def labelled(n=400):
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcdefghilmnoprstu") for _ in range(rnd.randint(2, 8))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        some = [rnd.choice(words) for _ in range(rnd.randint(5, 60))]
        bad, junk = rnd.random() < 0.3, rnd.random() < 0.3
        if bad:
            some[rnd.randrange(len(some))] = rnd.choice(TOXIC)
        if rnd.random() < 0.3:
            some[rnd.randrange(len(some))] = rnd.choice(["women", "muslim", "black"]) if not bad else "women"
        text = (" ".join(w.upper() + "!!" for w in some) if junk else " ".join(some).capitalize() + ".")
        docs.append((i, text, "en", "a", len(text)))
        labels.append((i, int(not junk), int(any(t in text.lower() for t in TOXIC))))
    docs += [(n, None, None, None, None), (n + 1, "", "en", "a", 0)]
    labels += [(n, None, None), (n + 7, 1, 1)]
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = labelled()
    return spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {r[0]: r[1:] for r in labels}


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def accuracy(rows, truth, threshold):
    some = [(r["score"] >= threshold, bool(truth[r["doc_id"]])) for r in rows if held(r["doc_id"]) and truth.get(r["doc_id"]) is not None]
    return np.mean([a == b for a, b in some])


def test_quality_on_held_out_rows(tables):
    docs, labels, truth = tables
    stats = quality.document_statistics(docs)
    rows = quality.score_quality(stats, quality.fit_quality(stats, labels)).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert accuracy(rows, {k: v[0] for k, v in truth.items()}, quality.THRESHOLD) > 0.95


def test_toxicity_on_held_out_rows_and_neutral_mentions(spark, tables):
    docs, labels, truth = tables
    model = toxicity.fit_toxicity(docs, labels)
    rows = toxicity.score_toxicity(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert accuracy(rows, {k: v[1] for k, v in truth.items()}, toxicity.THRESHOLD) > 0.95
    pair = [(1, "many women came", "en", "a", 1), (2, "many men came", "en", "a", 1), (3, "many people came", "en", "a", 1)]
    a, b, c = (r["score"] for r in sorted(toxicity.score_toxicity(spark.createDataFrame(pair, SCHEMA), model).collect()))
    assert abs(a - b) < 0.05 and max(a, b, c) < toxicity.THRESHOLD


def test_held_out_labels_are_never_read(spark, tables):
    docs, labels, truth = tables
    from pyspark.sql import functions as F

    from dendrovox.llm.labelled import held_out

    turned = labels.withColumns({c: F.when(held_out(), 1 - F.col(c)).otherwise(F.col(c)) for c in ("quality", "toxic")})
    score = lambda x: {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, x)).collect()}
    assert score(labels) == score(turned)


def test_models_without_labels_or_rows(spark, tables):
    docs, labels, _ = tables
    none = labels.where("false")
    assert {r["score"] for r in toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, none)).collect()} == {0.0}
    stats = quality.document_statistics(docs)
    assert {r["score"] for r in quality.score_quality(stats, quality.fit_quality(stats, none)).collect()} == {0.0}
    empty = docs.where("false")
    assert toxicity.score_toxicity(empty, toxicity.fit_toxicity(empty, labels)).count() == 0
    no_stats = quality.document_statistics(empty)
    assert quality.score_quality(no_stats, quality.fit_quality(no_stats, labels)).count() == 0


def test_isotonic_is_monotone():
    rnd = np.random.default_rng(0)
    s = rnd.normal(size=300)
    knots, values = quality.isotonic(s, (s + rnd.normal(size=300) > 0).astype(float))
    assert (np.diff(knots) >= 0).all() and (np.diff(values) > -1e-12).all() and 0 <= values.min() and values.max() <= 1


def vectors(n=1500, width=16):
    rnd = np.random.default_rng(7)
    x = rnd.normal(size=(n, width))
    for i in range(300, 800):
        x[i] = x[i % 60] + rnd.normal(size=width) * rnd.choice([0.02, 0.08, 0.25])
    x[800:1000] = x[0] + rnd.normal(size=(200, width)) * 0.01
    x[1000:1040] = x[1]
    return x


def test_vector_links_match_brute_force(spark):
    x = vectors()
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    odd = [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] + [1.0] * 15), (5003, [None] + [1.0] * 15), (5004, [1.0]), (5005, []), (5006, [float("inf")] * 16)]
    df = spark.createDataFrame(rows + odd + rows[:5], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in embeddings.near_duplicate_vectors(df).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = (u @ u.T) >= 0.95
    np.fill_diagonal(linked, False)
    union = Union(range(len(x)))
    for i, j in zip(*np.nonzero(linked), strict=True):
        union.join(int(i), int(j))
    found = sum(got[i]["n_links"] for i in range(len(x)))
    assert len(got) == len(x) + len(odd)
    assert found >= 0.9 * linked.sum() and all(got[i]["n_links"] <= linked[i].sum() for i in range(len(x)))
    assert np.mean([got[i]["component_id"] == union.root(i) for i in range(len(x))]) > 0.98
    assert all(got[i]["kept"] == (got[i]["component_id"] == i) for i in range(len(x)))
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i, _ in odd)


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embeddings.near_duplicate_vectors(df).count() == 0
    one = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in embeddings.near_duplicate_vectors(one).collect()] == [(1, 0, 1, True)]


def test_graph_recall():
    x = vectors(4000)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    g = embeddings.Graph.load(embeddings.Graph.build(u, np.arange(len(u))).dump())
    truth = (u.astype(np.float32) @ u.astype(np.float32).T) >= 0.95
    found = sum(len(f) for f in g.search(u.astype(np.float32), embeddings.BEAM, 0.95))
    assert found >= 0.9 * truth.sum()
