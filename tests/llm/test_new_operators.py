"""Merkle manifests, exact search and collocations against brute force, with awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from helpers import AWKWARD, SCHEMA, corpus, documents, lower
from pyspark.sql import functions as F

from dendrovox.llm import merkle, phrases, topk


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def row_digest(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_manifest(rows):
    """(doc_id, leaf, subroot, root, proof, folded) of rows ``doc_id, source, lang, n_chars, text``, level by level."""

    def climb(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            now = levels[-1]
            levels.append([sha("".join(now[i : i + 3])) for i in range(0, len(now), 3)])
        return levels

    def siblings(levels, i):
        out = []
        for now in levels[:-1]:
            first = i - i % 3
            out.append((now[first:i], now[i + 1 : first + 3]))
            i //= 3
        return out

    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, row_digest(r)))
        trees[s] = climb([row_digest(r) for r in by[s]])
    top = climb([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, r in enumerate(by[s]):
            way = siblings(trees[s], i) + siblings(top, k)
            struck = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None
            at = row_digest((*r[:4], r[4].replace("\n", "") if struck else r[4]))
            for left, right in way:
                at = sha("".join([*left, at, *right]))
            proof = sha("".join(d for left, right in way for d in (*left, *right)))
            out.append((r[0], trees[s][0][i], trees[s][-1][0], top[-1][0], proof, at, at == top[-1][0]))
    return out


def manifest_of(spark, rows, levels):
    got = merkle.audit(documents(spark, rows), levels)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


def fields(rows):
    """Rows of the corpus in the digest's order of fields."""
    return [(r[0], r[3], r[2], r[4], r[1]) for r in rows]


def test_manifest_equals_brute_force(spark, tmp_path):
    rnd = random.Random(2)
    rows = corpus(60) + [(i, f"row {i}\nof source", "en", "hot", 5) for i in range(100, 300)]
    rows += [(None, "no id\n", "en", "a", 3), (None, "no id\n", "en", "a", 3), (7, "again\n", None, None, None), rows[20], (400, "x", None, "", 1)]
    rnd.shuffle(rows)
    want = sorted(plain_manifest(fields(rows)), key=repr)
    assert manifest_of(spark, rows, 2) == want  # blocks of nine, so that trees have several rounds
    documents(spark, rows).write.parquet(f"file://{tmp_path}/documents.parquet")
    assert sorted((tuple(r) for r in merkle.op11_merkle(spark, f"file://{tmp_path}").collect()), key=repr) == want
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(con.execute(merkle.ORACLE_OP11).fetchall(), key=repr) == want


@pytest.mark.parametrize("n", [1, 4, 10])
def test_small_trees(spark, n):
    rows = [(i, f"text\n{i}", "en", "s", i) for i in range(n)]
    assert manifest_of(spark, rows, 1) == sorted(plain_manifest(fields(rows)), key=repr)


def test_empty_manifest(spark):
    assert manifest_of(spark, [], 5) == []


def test_appender_extends_witnesses_as_siblings_come():
    tree = merkle.Appender()
    for d in "abc":
        tree.append(d)
    assert tree.witness == [[("", "bc")], [("a", "c")], [("ab", "")]]
    tree.append("d")
    assert tree.close() == sha(sha("abc") + sha("d"))
    assert tree.witness[3] == [("", ""), (sha("abc"), "")] and tree.witness[0][1] == ("", sha("d"))


def plain_top(rows, k=20):
    usable = {}
    for i, v in rows:
        if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v):
            q = [int(np.floor(64 * c)) for c in v]
            usable[i] = min(usable.get(i, q), q)
    out = []
    for i, q in usable.items():
        if i % 20 == 0:
            scores = [(-sum(a * b for a, b in zip(q, w, strict=True)), j) for j, w in usable.items() if j != i and len(w) == len(q)]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def vectors(rnd, n, width):
    rows = [(i, [rnd.uniform(-1, 1) for _ in range(width)]) for i in range(-40, n)]
    rows += [(n + i, list(rows[5][1])) for i in range(90)]  # a group of copies with queries among them
    rows += [(2000, None), (2001, [float("nan")] * width), (2002, [None] * width), (2003, [float("inf")] * width), (None, rows[3][1]), (2020, [0.0] * width)]
    rows += [(2040, [0.5, 0.25]), (2041, [1.5, -0.25]), (2060, []), (2061, [])]
    return rows + [(rows[0][0], list(rows[0][1])), (rows[1][0], [0.0] * width)]


def test_search_equals_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_NUMBERS", 400)
    rows = vectors(random.Random(4), 300, 6)
    root = f"file://{tmp_path}/v"
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("*", *[F.lit("clash").alias(c) for c in ("q", "width", "shard", "score", "rank", "label")])
    df.write.parquet(f"{root}/embeddings.parquet")
    got = topk.op12_kd_search(spark, root)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(tuple(r) for r in got.collect()) == plain_top(rows)


def test_search_of_nothing(spark, tmp_path):
    root = f"file://{tmp_path}/v0"
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(f"{root}/embeddings.parquet")
    assert topk.op12_kd_search(spark, root).collect() == []


@pytest.mark.parametrize("scale", [1, 10**9])
def test_tree_is_exact_beyond_doubles(scale):
    rnd = np.random.default_rng(3)
    rows = rnd.integers(-64, 64, (700, 5)) * scale + rnd.integers(0, 3, (700, 5))
    rows[100:300] = rows[100]
    ids = rnd.permutation(700)
    asked = np.arange(0, 700, 7)
    full = rows.astype(object)
    known = [None if k % 2 else (int(full[asked[k]] @ full[asked[k]]) // 4, -5) for k in range(len(asked))]
    for k, found in enumerate(topk.Tree(rows, ids).search(rows[asked], ids[asked], 9, known)):
        pairs = sorted(((int(full[asked[k]] @ w), -int(i)) for w, i in zip(full, ids, strict=True) if i != ids[asked[k]]), reverse=True)
        want = [p for p in pairs if known[k] is None or p > known[k]][:9]
        assert sorted(found, reverse=True) == want


def plain_collocations(rows, least=10, share=50, top=2000):
    counts, total = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower(text)):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            for k in (1, 2, 3):
                counts[lang].update(" ".join(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        cand = {p: a for p, a in f.items() if " " in p and a >= least}
        scored = []
        for p, a in cand.items():
            longer = [b for q, b in cand.items() if len(q) > len(p) and f" {p} " in f" {q} "]
            if any(100 * b >= share * a for b in longer):
                continue
            w = p.split(" ")
            cuts = [(10**6 * a * a // (f[" ".join(w[:k])] * f[" ".join(w[k:])]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            scored.append((-score, -a, p.encode(), p, f[" ".join(w[:k])], f[" ".join(w[k:])]))
        out += [(lang, r + 1, p, -a, x, y, total[lang], -s) for r, (s, a, _, p, x, y) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def chatter(seed, n=400):
    rnd = random.Random(seed)
    words = ["new", "york", "City", "state", "of", "the", "art", "ÉTÉ", "x y", "don't", "a-b"] + [f"w{i}" for i in range(40)]
    sets = [["New", "York"], ["state", "of", "the"], ["of", "the", "art"], ["a", "a", "a", "a"]]
    rows = []
    for i in range(n):
        parts = [" ".join(w for _ in range(rnd.randint(1, 6)) for w in (rnd.choice(sets) if rnd.random() < 0.4 else [rnd.choice(words)])) for _ in range(rnd.randint(0, 6))]
        rows.append((i, rnd.choice([". ", ",", "\n", "; ", "!\t", "\x0b", "  "]).join(parts), rnd.choice(["en", "de", None, "und"]), "s", 1))
    return rows + AWKWARD + [(None, "the the the " * 700, "long", "s", 1), (5, None, "en", "s", 1)]


def test_collocations_equal_brute_force_and_sql(spark, tmp_path):
    rows = chatter(6)
    root = f"{tmp_path}/c"
    documents(spark, rows).write.parquet(f"file://{root}/documents.parquet")
    got = phrases.op13_collocations(spark, f"file://{root}")
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    found = sorted(tuple(r) for r in got.collect())
    assert found == plain_collocations(rows)
    small = phrases.collocations(spark.read.parquet(f"file://{root}/documents.parquet"), block=20_000, unit=40, segment=50_000)  # many blocks, slices and segments
    assert sorted(tuple(r) for r in small.collect()) == found
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{root}/documents.parquet/*.parquet'")
    assert sorted(con.execute(phrases.ORACLE_OP13).fetchall()) == found


def test_collocations_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert phrases.collocations(empty).collect() == []
    assert phrases.collocations(spark.createDataFrame([(1, None, None, None, None), (2, " \t.,", "en", "a", 1)], SCHEMA)).collect() == []
