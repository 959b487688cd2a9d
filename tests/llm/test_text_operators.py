import hashlib
import random
import zlib

import numpy as np
import pytest
from helpers import SCHEMA, Union, corpus, documents, lower, plain_words

from dendrovox.llm import byte_bpe, decontaminate, line_dedup, shards, simhash, token_counts, token_files


def rows_of(df, key="doc_id"):
    out = {}
    for r in df.collect():
        out.setdefault(r[key], []).append(r)
    return out


# ---- 2


ITEMS = [(1, "one two three four five six seven eight nine ten"), (2, "five six"), (3, None), (4, "..."), (5, "One two three four five six seven eight nine TEN"), (6, "two three four five six seven eight nine ten eleven twelve")]


def hits(text, items, window=10):
    words, hit, found = plain_words(text), set(), set()
    for item, t in items:
        w = plain_words(t)
        m = min(window, len(w))
        for k in range(len(w) - m + 1) if w else ():
            for i in range(len(words) - m + 1):
                if words[i : i + m] == w[k : k + m]:
                    hit |= set(range(i, i + m))
                    found.add(str(item))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("limit", [1, 500_000])
def test_decontamination_matches_brute_force(spark, limit):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = rows_of(decontaminate.find_hits(documents(spark), items, max_broadcast=limit))
    for doc_id, text, *_ in corpus():
        (r,) = found[doc_id]
        n, hit, names = hits(text, ITEMS)
        covered = set().union(*[range(s["i"], s["i"] + s["m"]) for s in r["spans"]]) if r["spans"] else set()
        assert (r["n_words"], len(covered), r["items"]) == (n, hit, names), doc_id
    kept = {r["doc_id"] for r in decontaminate.decontaminate(documents(spark), items).collect()}
    assert kept == {d for d, t, *_ in corpus() if not hits(t, ITEMS)[1]}


def test_large_benchmarks_find_the_same(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = sorted(map(str, decontaminate.find_hits(documents(spark), items, max_broadcast=1).collect()))
    assert got == sorted(map(str, decontaminate.find_hits(documents(spark), items).collect()))


def test_decontamination_of_nothing(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = documents(spark)
    assert decontaminate.decontaminate(docs, none).count() == docs.count()
    assert decontaminate.find_hits(documents(spark, []), spark.createDataFrame(ITEMS, none.schema)).count() == 0


# ---- 3


def naive_fingerprint(text):
    import re

    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    some = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in some]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(spark):
    got = rows_of(simhash.fingerprints(documents(spark)))
    for doc_id, text, *_ in corpus():
        assert got[doc_id][0]["fp"] & (2**64 - 1) == naive_fingerprint(text), doc_id


@pytest.mark.parametrize("shard", [2, 4096])
def test_links_span_all_pairs_within_the_radius(spark, shard):
    rnd = np.random.default_rng(2)
    base = rnd.integers(0, 2**63, 12)
    fps = {int(b) for b in base}
    for b in base:
        for _ in range(12):
            flips = rnd.choice(64, rnd.integers(1, 7), replace=False)
            fps.add(int(np.bitwise_xor.reduce([np.uint64(b), *(np.uint64(1) << np.uint64(f) for f in flips)])))
    fps = sorted(fps)
    want, got = Union(range(len(fps))), Union(range(len(fps)))
    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= 4:
                want.join(i, j)
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    place = {s: k for k, s in enumerate(signed)}
    for r in simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"), shard=shard).collect():
        assert (fps[place[r["a"]]] ^ fps[place[r["b"]]]).bit_count() <= 64
        got.join(place[r["a"]], place[r["b"]])
    assert [want.root(k) for k in range(len(fps))] == [got.root(k) for k in range(len(fps))]


def test_near_duplicates_keep_one_of_each_group(spark):
    rows = corpus()
    fp, union = {d: naive_fingerprint(t) for d, t, *_ in rows}, Union([r[0] for r in rows])
    for a in fp:
        for b in fp:
            if (fp[a] ^ fp[b]).bit_count() <= 4:
                union.join(a, b)
    got = rows_of(simhash.near_duplicates(documents(spark)))
    assert {d: r[0]["component_id"] for d, r in got.items()} == {d: union.root(d) for d in fp}
    kept = simhash.drop_near_duplicates(documents(spark))
    assert {r["doc_id"] for r in kept.collect()} == {union.root(d) for d in fp}
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


# ---- 5


def test_stage_drops_all_similar_documents(spark):
    import corpus_pipeline

    rnd = random.Random(4)
    rows, k = [(1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, "two words", "en", "a", 9), (4, "Two  words", "en", "a", 10)], 10
    for n in (6, 30, 120):
        for _ in range(4):
            base = [f"w{rnd.randrange(10**6)}" for _ in range(n)]
            for edits in (0, 1, 2, 3, 5, 8):
                words = list(base)
                for i in rnd.sample(range(n), min(edits, n)):
                    words[i] = f"v{rnd.randrange(10**6)}"
                rows.append((k, " ".join(words), "en", "a", 1))
                k += 1
    rnd.shuffle(rows)
    cut = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for d, t, *_ in rows for w in [lower(t or "").split()]}
    pairs = {(a, b) for a in cut for b in cut if a < b and 10 * len(cut[a] & cut[b]) >= 8 * len(cut[a] | cut[b])}
    union = Union(list(cut))
    for a, b in pairs:
        union.join(a, b)
    assert len(pairs) > 12
    kept = corpus_pipeline.simhash_dedup(spark, documents(spark, rows), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d in cut if union.root(d) == d)
    assert simhash.drop_similar(documents(spark, [])).count() == 0
    groups = simhash.similar_groups(documents(spark, rows), shard=2).collect()
    part = {}
    for r in groups:
        part.setdefault(r["part"], set()).add(r["doc_id"])
    want = {}
    for d in cut:
        want.setdefault(union.root(d), set()).add(d)
    assert sorted(map(sorted, part.values())) == sorted(map(sorted, want.values()))


def naive_lines(rows):
    occurrences = [(d, n, x) for d, t, *_ in rows if t is not None for n, x in enumerate(t.split("\n")) if len(x) >= line_dedup.MIN_CHARS]
    texts = sorted({o[2] for o in occurrences})
    union = Union(texts)
    for i, a in enumerate(texts):
        for b in texts[:i]:
            if line_dedup.within_edits(a, b):
                union.join(a, b)
    first = {}
    for d, n, x in occurrences:
        first[union.root(x)] = min(first.get(union.root(x), (1 << 60, 0)), (d, n))
    gone = {(d, n) for d, n, x in occurrences if first[union.root(x)] != (d, n)}
    return {d: None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (d, n) not in gone) for d, t, *_ in rows}


def edited_rows():
    base = "the quick brown fox jumps over it"
    lines = {base[:i] + c + base[i + k :] for i in range(len(base)) for c in "xyz" for k in (0, 1)}
    lines |= {base[:9] + c + base[10:] for c in "abcdefghijklm"} | {base[:9] + c + d + base[10:] for c in "abcdefg" for d in "pqrs"}
    lines = sorted(lines)
    return [(100 + k, "\n".join([*lines[k::9], "short"]), "en", "a", 1) for k in range(9)]


@pytest.mark.parametrize("bucket", [3, 64])
def test_line_dedup_matches_brute_force(spark, bucket):
    rows = corpus() + edited_rows()
    got = line_dedup.dedup_lines(documents(spark, rows), bucket).collect()
    assert {r["doc_id"]: r["text"] for r in got} == naive_lines(rows)
    assert all(r["n_chars"] == len(r["text"]) for r in got if r["text"] and r["doc_id"] >= 100)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_edit_distance():
    rnd = np.random.default_rng(1)
    for _ in range(2000):
        a, b = ("".join(rnd.choice(list("ab"), rnd.integers(0, 8))) for _ in range(2))
        for most in (1, 2, 3):
            assert line_dedup.within_edits(a, b, most) == (distance(a, b) <= most), (a, b, most)


def several_edits():
    """Lines of 40 to 160 characters, and each of them with one to seven edits; some with long parts in common."""
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7)))
    texts = []
    for n in (39, 41, 60, 79, 81, 99, 101, 124, 126, 160):
        base = " ".join(word() for _ in range(80))[:n]
        texts.append(base)
        for e in range(1, 8):
            for _ in range(3):
                line = base
                for _ in range(e):
                    i, kind = rnd.randrange(len(line)), rnd.randrange(3)
                    line = line[:i] + rnd.choice("XYZ") * (kind > 0) + line[i + (kind < 2) :]
                texts.append(line)
        texts += [base[: n // 2] + " ".join(word() for _ in range(40))[: n - n // 2] for _ in range(6)]
    rnd.shuffle(texts)
    return [(200 + k, "\n".join(texts[k::8]), "en", "a", 1) for k in range(8)]


@pytest.mark.parametrize("bucket", [3, 64])
def test_line_dedup_links_lines_of_several_edits(spark, bucket):
    rows = several_edits()
    texts = sorted({x for _, t, *_ in rows for x in t.split("\n")})
    want = {(a, b) for a in texts for b in texts if a < b and line_dedup.within_edits(a, b, min(5, min(len(a), len(b)) // 20))}
    assert {distance(a, b) for a, b in sorted(want)[::5]} == {1, 2, 3, 4, 5}
    index = line_dedup.index_lines(documents(spark, rows))
    name = {r["k"]: r["line"] for r in index.collect()}
    found = {tuple(sorted((name[r["a"]], name[r["b"]]))) for r in line_dedup.edit_links(index, bucket, block=20).collect()}
    parts, all_parts = Union(texts), Union(texts)
    for a, b in found:
        parts.join(a, b)
    for a, b in want:
        all_parts.join(a, b)
    assert found <= want and (bucket < 64 or found == want)
    assert [parts.root(x) for x in texts] == [all_parts.root(x) for x in texts]
    got = line_dedup.dedup_lines(documents(spark, rows), bucket).collect()
    assert {r["doc_id"]: r["text"] for r in got} == naive_lines(rows)


def test_line_dedup_removes_short_repeats(spark):
    rows = [(1, "Menu\n\nRead more\nx", "en", "a", 17), (2, "Read more\n\nMenu.\nx\nx", "en", "a", 21)]
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in line_dedup.dedup_lines(documents(spark, rows)).collect()}
    assert got == {1: (rows[0][1], 17), 2: ("\nMenu.", 6)}


def test_line_dedup_of_nothing(spark):
    assert line_dedup.dedup_lines(documents(spark, [])).count() == 0
    assert line_dedup.dedup_lines(documents(spark, corpus()[:3])).count() == 3


# ---- 4


def test_token_files_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(token_files.TOKENIZER)
    rows = corpus()
    files = token_files.write_token_files(documents(spark, rows), f"file://{tmp_path}/ids", docs_per_file=20)
    got = {r["doc_id"]: r for r in token_files.document_starts(files).collect()}
    crc = {r["doc_id"]: r["ids_crc32"] for r in token_files.ids_checksum(files).collect()}
    start = 0
    for doc_id, text, *_ in sorted(rows):
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, token_files.END_ID]
        assert (got[doc_id]["ids"], got[doc_id]["start"], got[doc_id]["n_tokens"]) == (ids, start, len(ids))
        assert crc[doc_id] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_added_tokens_are_as_the_library_has_them(spark, tmp_path):
    from tokenizers import Tokenizer

    end = "<|endoftext|>"
    texts = [f"a {end} b", end, end + end, f"{end}start", f"the end {end}", f"  {end}  {end}\n", "<|endoftext|", f"x{end}y\u00e9{end}{end} z", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tok = Tokenizer.from_file(token_files.TOKENIZER)
    for special_text in (False, True):
        tok.encode_special_tokens = special_text
        got = {r["doc_id"]: r["ids"] for r in token_files.write_token_files(df, f"file://{tmp_path}/{special_text}", special_text=special_text).collect()}
        assert got == {k: [*tok.encode(t or "", add_special_tokens=False).ids, token_files.END_ID] for k, t in enumerate(texts)}


def test_token_files_encodings(spark, tmp_path):
    import pyarrow.parquet as pq

    token_files.write_token_files(documents(spark), f"file://{tmp_path}/ids", docs_per_file=20)
    for part in (tmp_path / "ids").glob("*.parquet"):
        meta = pq.ParquetFile(part).metadata
        columns = {c.path_in_schema: c for g in range(meta.num_row_groups) for c in [meta.row_group(g).column(k) for k in range(meta.num_columns)]}
        assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings and "RLE_DICTIONARY" in columns["ids.list.element"].encodings
        assert all(c.has_column_index and c.has_offset_index for c in columns.values())


def test_token_files_of_nothing(spark, tmp_path):
    assert token_files.write_token_files(documents(spark, []), f"file://{tmp_path}/ids").count() == 0


# ---- 9


def test_shards_differ_by_one_row_and_slots_have_no_gap(spark):
    rows = corpus() + [corpus()[20]] * 3
    got = shards.assign_shards(documents(spark, rows), 7).collect()
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert len(got) == len(rows) and len(slots) == 7
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    text = {r[0]: r[1] for r in rows}
    assert all(r["text_crc32"] == zlib.crc32((text[r["doc_id"]] or "").encode()) and r["size"] == len((text[r["doc_id"]] or "").encode()) + 1 for r in got)
    order = [r["index"] for r in sorted(got, key=lambda r: (r["shard"], r["slot"]))]
    assert order == sorted(order)
    assert shards.assign_shards(documents(spark, [])).count() == 0


@pytest.mark.parametrize(("dims", "bits"), [(2, 3), (3, 2)])
def test_hilbert_curve_visits_neighbours(dims, bits):
    import itertools

    import pandas as pd

    points = list(itertools.product(range(1 << bits), repeat=dims))
    index = shards.hilbert_index([pd.Series([p[k] for p in points]) for k in range(dims)], bits)
    assert sorted(index) == list(range(len(points)))
    walk = [p for _, p in sorted(zip(index, points, strict=True))]
    assert all(sum(abs(a - b) for a, b in zip(p, q, strict=True)) == 1 for p, q in zip(walk, walk[1:], strict=False))


def test_written_shards_hold_all_rows(spark, tmp_path):
    rows = corpus()
    shards.write_shards(documents(spark, rows), f"file://{tmp_path}/shards", 4)
    back = spark.read.parquet(f"file://{tmp_path}/shards")
    assert sorted(r["doc_id"] for r in back.collect()) == sorted(r[0] for r in rows)


# ---- 10


def reference_encoding():
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(byte_bpe.RANKS), special_tokens={})


def thue_morse(n, a, b):
    """Runs whose polynomial hashes modulo a power of two are equal to those of their complements."""
    return "".join(b if i.bit_count() & 1 else a for i in range(n))


COLLIDING = [(901 + k, t, "en", "a", 1) for k, t in enumerate([thue_morse(2048, *"ab"), thue_morse(2048, *"ba"), "x " + thue_morse(1024, *"ko") + " " + thue_morse(1024, *"ok"), thue_morse(4096, *"xy"), thue_morse(4096, *"yx")])]


@pytest.mark.parametrize("block", [60, byte_bpe.BLOCK])
def test_byte_bpe_round_trip(spark, block):
    enc, rows = reference_encoding(), [*corpus(), (99, "a" * 5000 + " '" + "'ll" * 20 + "x́̂" * 50 + " " + "a" * 37 + " " + "ab" * 60, "en", "a", 1), *COLLIDING]
    encoded = byte_bpe.encode_documents(documents(spark, rows), block=block)
    decoded = rows_of(byte_bpe.decode_documents(encoded))
    for doc_id, text, *_ in rows:
        assert decoded[doc_id][0]["ids"] == enc.encode_ordinary(text or ""), doc_id
        assert bytes(decoded[doc_id][0]["decoded"]) == (text or "").encode()


def test_colliding_pieces_have_their_own_ids(spark, tmp_path):
    from tokenizers import Tokenizer

    tok, enc = Tokenizer.from_file(token_files.TOKENIZER), token_counts.tokenizer(token_counts.RANKS)
    files = rows_of(token_files.write_token_files(documents(spark, COLLIDING), f"file://{tmp_path}/ids"))
    trees = rows_of(token_counts.build_trees(documents(spark, COLLIDING)))
    for doc_id, text, *_ in COLLIDING:
        assert files[doc_id][0]["ids"][:-1] == tok.encode(text, add_special_tokens=False).ids
        assert sum(trees[doc_id][0]["tokens"]) == len(enc.encode_ordinary(text))


def test_byte_bpe_of_a_merge_with_id_zero(spark, tmp_path, monkeypatch):
    """An empty cell of the map of ranks is no merge of two parts of id 0; common words are folded in several tasks."""
    import base64

    import public_tokenizers
    import tiktoken

    monkeypatch.setattr(byte_bpe, "FOLDED", 2, raising=False)
    ranks = {bytes([b]): b + 1 for b in range(256)} | {b"ab": 0, b"bc": 257, b"abc": 258, b"bcab": 259}
    path = tmp_path / "own.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(p) + b" %d\n" % r for p, r in ranks.items()))
    enc = tiktoken.Encoding("small", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [(k, t, "en", "a", 1) for k, t in enumerate(["abab", "xababab ab", "bcabcab abcbcab", "aabbcc abcabcabc", "abcabcabc \0\0"])]
    got = rows_of(byte_bpe.encode_documents(documents(spark, rows), str(path)))
    for doc_id, text, *_ in rows:
        assert got[doc_id][0]["ids"] == enc.encode_ordinary(text), text


def test_byte_bpe_digests_and_empty_table(spark):
    (r,) = byte_bpe.digests(documents(spark, corpus()[3:4])).collect()
    ids = reference_encoding().encode_ordinary(corpus()[3][1])
    assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert byte_bpe.digests(documents(spark, [])).count() == 0


# ---- 1


def test_token_counts_follow_edits(spark):
    enc = token_counts.tokenizer(token_counts.RANKS)
    rnd = np.random.default_rng(4)
    rows, edits = corpus(), []
    for doc_id, text, *_ in rows:
        n = len(text or "")
        some = [(int(rnd.integers(-2, n + 5)), int(rnd.integers(0, 9)), str(rnd.choice(["", " ", "x", "'s", " new words\n\n", "é 12 ", "  "]))) for _ in range(6)]
        edits.append((doc_id, some if doc_id % 9 else None))
    schema = f"doc_id long, edits {token_counts.EDITS}"
    both = documents(spark, rows).drop("edits").join(spark.createDataFrame(edits, schema), "doc_id")
    got = rows_of(token_counts.apply_edits(token_counts.build_trees(both)))
    for (doc_id, text, *_), (_, some) in zip(rows, edits, strict=True):
        r, now = got[doc_id][0], text or ""
        assert r["n_tokens_before"] == len(enc.encode_ordinary(now))
        for at, cut, put in some or []:
            at = min(max(at, 0), len(now))
            now = now[:at] + put + now[at + cut :]
        assert r["text"] == now
        assert r["n_tokens"] == len(enc.encode_ordinary(now)) == sum(r["tokens"]), doc_id
        assert sum(r["chars"]) == len(now)
    assert got[60][0]["n_reencoded"] < 2000  # of a text of 30,000 words
    assert token_counts.build_trees(documents(spark, rows[:4])).count() == 4  # its edits are of another type
    assert token_counts.apply_edits(token_counts.build_trees(token_counts.derived_edits(documents(spark, [])))).count() == 0


def test_repeated_rows(spark):
    rows = corpus()[3:12]
    twice = spark.createDataFrame(rows + rows, SCHEMA)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.find_hits(twice, items).count() == len(rows)
    assert simhash.near_duplicates(twice).count() == 2 * len(rows)
    assert line_dedup.dedup_lines(twice).count() == 2 * len(rows)
    assert byte_bpe.encode_documents(twice).count() == 2 * len(rows)
