"""Operator 13: phrase collocations from stripes, a counter of next words for each prefix.

A task counts a block of text at a time: every word of a piece stands for the prefix of it and its next word, whose stripe
counts the word after that (or the piece's end), so a block gives a stripe for each pair of neighbours. Stripes travel packed,
one row each, and are merged elementwise where their prefix is gathered, in sorted order and a bounded slice at a time. A
merged stripe holds everything at once: its entries are the extensions (phrases of three words), its sum is the prefix total
(how often the pair occurs), its greatest entry the subsumption maximum of the pair from the right; the same entries by
their last two words give the one from the left. Prefixes of one word have a stripe of ends alone, whose sum is the word's count.

A prefix met everywhere sends a row a block at most, and its stripe is cut by the hash of the next word into segments
whose number follows the size of the corpus, so no task gathers all of a prefix at scale.

Cases: a null text is empty; a null lang is ``und``, together with rows that say so; pieces without words count nothing;
repeated rows count each time; an empty table gives no rows; a text of any length is counted whole, cut where a piece ends
(one endless piece is counted in one task's memory); other columns are ignored.
"""

from __future__ import annotations

import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dendrovox.llm.common import slices, small_side, table
from dendrovox.plans.iterate import materialize, settle

LEAST, SHARE, TOP = 10, 50, 2000
#: Bytes of text that a task counts at once.
BLOCK = 12_000_000
#: Bytes of text to each segment of a stripe.
SEGMENT_BYTES = 64 << 30
#: Stripes that a task merges at once, about.
UNIT = 150_000
BREAKS = ".,;:!?\n\x0b\x0c\r"
_TABLE = bytes.maketrans((string.ascii_uppercase + BREAKS + "\t").encode(), (string.ascii_lowercase + "\n" * len(BREAKS) + " ").encode())
STRIPE = pa.schema([("lang", pa.string()), ("prefix", pa.string()), ("segment", pa.int32()), ("nexts", pa.string()), ("counts", pa.binary())])
MERGED = pa.schema([("lang", pa.string()), ("prefix", pa.string()), ("next", pa.string()), ("n", pa.int64())])


def words_of(text: bytes) -> tuple[np.ndarray, pa.Array]:
    """(the codes of a prepared text's words, 0 at the end of a piece; the words by code, the empty one first)."""
    spaced = text.replace(b"\n", b" \n ")
    buffers = [None, pa.py_buffer(np.array([0, len(spaced)], np.int64).tobytes()), pa.py_buffer(spaced)]
    coded = pc.split_pattern(pa.Array.from_buffers(pa.large_string(), 1, buffers), " ").flatten().dictionary_encode()
    found = coded.dictionary.cast(pa.string())
    kinds = np.arange(1, len(found) + 1)
    for sign, kind in (("", -1), ("\n", 0)):
        kinds[np.flatnonzero(pc.equal(found, sign).to_numpy(zero_copy_only=False))] = kind
    real = np.flatnonzero(kinds > 0)
    kinds[real] = np.arange(1, len(real) + 1)
    code = kinds[coded.indices.to_numpy()]
    return code[code >= 0], pa.concat_arrays([pa.array([""], pa.string()), found.take(pa.array(real))])


def stripes_of(lang: str, text: bytes, segments: int) -> pa.RecordBatch:
    """The stripes of one block of prepared text, one-word prefixes included; ``counts`` is empty where all are 1."""
    code, words = words_of(text)
    base = len(words)
    part = np.array([zlib.crc32(w.encode()) % segments for w in words.to_pylist()], np.int64) if segments > 1 else np.zeros(base, np.int64)
    part[0] = 0
    code = np.concatenate([code, np.zeros(2, np.int64)])
    at = np.flatnonzero(code[:-2])
    first, second, third = code[at], code[at + 1], code[at + 2]
    counts = np.bincount(first, minlength=base)
    alone = np.flatnonzero(counts)
    pairs = second > 0
    pair, third = first[pairs] * base + second[pairs], third[pairs]
    pair, which = np.unique(pair, return_inverse=True)
    order = np.argsort(part, kind="stable")  # codes of a segment are neighbours
    place = np.empty(base, np.int64)
    place[order] = np.arange(base)
    key, n = np.unique(which.astype(np.int64) * base + place[third], return_counts=True)
    which, third = key // base, order[key % base]
    seg = part[third]
    starts = np.flatnonzero(np.concatenate([[True], (which[1:] != which[:-1]) | (seg[1:] != seg[:-1])])) if len(key) else np.empty(0, np.int64)
    ends = np.concatenate([starts, [len(key)]]).astype(np.int32)
    nexts = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), words.take(pa.array(third))), " ")
    owner = pair[which[starts]]
    prefixes = pc.binary_join_element_wise(words.take(pa.array(owner // base)), words.take(pa.array(owner % base)), " ")
    sizes, packed = np.concatenate([np.diff(ends), np.ones(len(alone), np.int64)]).astype(np.int64), np.concatenate([n, counts[alone]]).astype(np.int64)
    ones = np.maximum.reduceat(packed, np.cumsum(sizes) - sizes) == 1 if len(sizes) else np.empty(0, bool)  # most stripes: their counts need no bytes
    packed = packed[~np.repeat(ones, sizes)]
    offsets = np.concatenate([[0], np.cumsum(np.where(ones, 0, sizes) * 8)]).astype(np.int32)
    rows = len(sizes)
    return pa.RecordBatch.from_arrays(
        [
            pa.repeat(lang, rows),
            pa.concat_arrays([prefixes, words.take(pa.array(alone))]),
            pa.array(np.concatenate([seg[starts], np.zeros(len(alone), np.int64)]).astype(np.int32)),
            pa.concat_arrays([nexts, pa.repeat("", len(alone))]),
            pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(packed.tobytes())]),
        ],
        schema=STRIPE,
    )


def _spans(text: bytes, size: int) -> Iterator[bytes]:
    """The prepared text in parts of about ``size`` bytes, cut where a piece ends."""
    at = 0
    while at < len(text):
        end = text.find(b"\n", at + size)
        end = len(text) if end < 0 else end + 1
        yield text[at:end]
        at = end


def count_stripes(batches: Iterator[pa.RecordBatch], segments: int, block: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Stripes of rows ``lang, text``, block by block."""
    held: dict[str, list[bytes]] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for lang in list(held):
            for span in _spans(b"\n".join(held.pop(lang)), block):
                out = stripes_of(lang, span, segments)
                for k in range(0, out.num_rows, 50_000):
                    yield out.slice(k, 50_000)

    for b in slices(batches):
        for lang, text in zip(b["lang"].to_pylist(), b["text"].to_pylist(), strict=True):
            if text:
                held.setdefault(lang, []).append(text.encode().translate(_TABLE))
                size += len(held[lang][-1])
                if size >= block:
                    yield from flush()
                    size = 0
    yield from flush()


def merge(rows: pa.Table, least: int) -> tuple[pa.RecordBatch, pa.Table]:
    """Stripes in order of their prefix, merged: (what is known of all but the last prefix, the last prefix's stripe)."""
    rows = rows.combine_chunks()
    columns = [rows[c].chunk(0) for c in rows.column_names]
    lang, prefix, segment, nexts, counts = columns
    new = np.zeros(len(rows), bool)
    new[0] = True
    for c in (lang, prefix, segment):
        new[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
    starts, run = np.flatnonzero(new), np.cumsum(new) - 1
    lists = pc.split_pattern(nexts, " ")
    sizes, given = pc.list_value_length(lists).to_numpy(), pc.binary_length(counts).to_numpy() > 0
    n = np.ones(int(sizes.sum()), np.int64)
    n[np.repeat(given, sizes)] = np.frombuffer(pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(counts)], pa.int32()), counts), b"")[0].as_buffer(), np.int64)
    words = lists.flatten().dictionary_encode()
    code, base = words.indices.to_numpy().astype(np.int64), len(words.dictionary)
    key = np.repeat(run, sizes) * base + code
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    key, n = key[heads], np.add.reduceat(n, heads)
    owner, code = key // base, key % base
    total = np.zeros(len(starts), np.int64)
    np.add.at(total, owner, n)
    last = len(starts) - 1
    tail = owner == last
    keep = pa.Table.from_arrays(
        [columns[k].slice(int(starts[last]), 1) for k in range(3)]
        + [pa.array([" ".join(words.dictionary.take(pa.array(code[tail])).to_pylist())], pa.string()), pa.array([n[tail].tobytes()], pa.binary())],
        schema=STRIPE,
    )
    text = lambda rows_: (lang.take(pa.array(starts[rows_])), prefix.take(pa.array(starts[rows_])))
    single = pc.invert(pc.match_substring(prefix.take(pa.array(starts)), " ")).to_numpy(zero_copy_only=False)
    done = np.arange(len(starts)) < last
    known = np.flatnonzero(done & (total >= least))
    longer = np.flatnonzero(~tail & (n >= least) & (words.dictionary.take(pa.array(code)).to_numpy(zero_copy_only=False) != ""))
    ones = np.flatnonzero(done & single)
    langs = lang.take(pa.array(starts[ones])).dictionary_encode()
    sums = np.zeros(len(langs.dictionary), np.int64)
    np.add.at(sums, langs.indices.to_numpy(), total[ones])
    parts = [
        (*text(known), pa.nulls(len(known), pa.string()), total[known]),
        (*text(owner[longer]), words.dictionary.take(pa.array(code[longer])), n[longer]),
        (langs.dictionary, pa.repeat("", len(sums)), pa.nulls(len(sums), pa.string()), sums),
    ]
    out = [pa.concat_arrays([pa.array(p[k], MERGED.field(k).type) if isinstance(p[k], np.ndarray) else p[k] for p in parts]) for k in range(4)]
    return pa.RecordBatch.from_arrays(out, schema=MERGED), keep


def merge_stripes(batches: Iterator[pa.RecordBatch], least: int, unit: int = UNIT) -> Iterator[pa.RecordBatch]:
    """``merge`` over sorted stripes, a slice at a time; a prefix that the slice's end cuts goes on as one stripe."""
    held, size = [], 0
    for b in batches:
        if b.num_rows:
            held.append(pa.Table.from_batches([b]).cast(STRIPE))
            size += b.num_rows
        if size >= unit:
            out, rest = merge(pa.concat_tables(held), least)
            held, size = [rest], 1
            yield out
    if held:
        end = pa.Table.from_pylist([{"lang": "", "prefix": "", "segment": -1, "nexts": "", "counts": np.zeros(1, np.int64).tobytes()}], schema=STRIPE)
        yield merge(pa.concat_tables([*held, end]), least)[0]


def phrase_counts(docs: DataFrame, least: int = LEAST, block: int = BLOCK, unit: int = UNIT, segment: int = SEGMENT_BYTES) -> DataFrame:
    """``lang, prefix, next, n``: prefixes of one and two words with their totals (``next`` null), extensions to three
    words, of ``least`` occurrences and more; ``prefix`` empty: all words of the lang."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    segments = 1 + size // segment
    floor = least if segments == 1 else 1  # totals of a cut stripe are not known before its segments are summed
    stripes = texts.mapInArrow(lambda b: count_stripes(b, segments, block), "lang string, prefix string, segment int, nexts string, counts binary")
    key = ["lang", "prefix", "segment"]
    gathered = stripes.repartition(*key).sortWithinPartitions(F.xxhash64(*key), *key)
    merged = materialize(gathered.mapInArrow(lambda b: merge_stripes(b, floor, unit), "lang string, prefix string, next string, n long"), "stripes")
    return merged.groupBy("lang", "prefix", "next").agg(F.sum("n").alias("n")).where(F.col("n") >= F.when(F.col("prefix") == "", 1).otherwise(least))


def collocations(docs: DataFrame, least: int = LEAST, share: int = SHARE, top: int | None = TOP, **sizes: int) -> DataFrame:
    """The phrases of two and three words by score: ``lang, rank, phrase, a, l, r, n, score``.

    A phrase scores the least of its cuts; one whose words lie in a longer phrase that has ``share`` percent of its
    occurrences goes. ``top``: as many of each lang; all, if None. ``sizes``: those of
    ``phrase_counts``.
    """
    counts = materialize(phrase_counts(docs, least, **sizes), "counts")
    known = counts.where("next is null and prefix <> ''").select("lang", F.col("prefix").alias("words"), "n")
    longer = counts.where("next is not null").select("lang", F.concat_ws(" ", "prefix", "next").alias("phrase"), F.col("n").alias("a"))
    two = known.where(F.contains("words", F.lit(" "))).select("lang", F.col("words").alias("phrase"), F.col("n").alias("a"))
    word = F.split("phrase", " ")
    inside = longer.select("lang", "a", F.explode(F.array(F.concat_ws(" ", word[0], word[1]), F.concat_ws(" ", word[1], word[2]))).alias("phrase"))
    most = inside.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    held = two.join(most, ["lang", "phrase"], "left").where(F.expr(f"most is null or 100 * most < {share} * a")).drop("most")
    cut = lambda k: F.struct(F.lit(k).alias("k"), F.concat_ws(" ", F.slice(word, 1, k)).alias("left"), F.concat_ws(" ", F.slice(word, F.lit(k + 1), F.size(word))).alias("right"))
    cuts = F.filter(F.array(cut(1), cut(2)), lambda c: c.right != "")
    each = held.union(longer).select("lang", "phrase", "a", F.inline(cuts))
    lookup = small_side(materialize(known, "totals"))
    for side, name in (("left", "l"), ("right", "r")):
        each = each.join(lookup.select("lang", F.col("words").alias(side), F.col("n").alias(name)), ["lang", side])
    wide = lambda c: F.col(c).cast("decimal(15,0)")
    score = F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * wide("a") * wide("a"), wide("l") * wide("r"))
    best = each.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("b")).select("lang", "phrase", "a", "b.l", "b.r", "b.score")
    words = counts.where("prefix = ''").select("lang", F.col("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long")
    ranked = best.withColumn("rank", rank)
    return (ranked if top is None else ranked.where(F.col("rank") <= top)).join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settle(lambda: collocations(table(spark, sf_dir, "documents")), "collocations")


ORACLE_OP13 = """
with texts as (select row_number() over () as d, coalesce(lang, 'und') as lang,
                      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
pieces as (select lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) as p from texts),
w as (select lang, regexp_extract_all(p, '[^ \\t]+') as w from pieces),
each as (select lang, k + 1 as k, unnest(list_transform(range(1, greatest(len(w) - k, 0) + 1), lambda i: array_to_string(w[i:i + k], ' '))) as phrase from w, (values (0), (1), (2)) v(k)),
f as (select lang, phrase, k, count(*) as a from each group by all),
n as (select lang, sum(a)::bigint as n from f where k = 1 group by lang),
c as (select * from f where k > 1 and a >= 10),
inside as (select lang, unnest([array_to_string(string_split(phrase, ' ')[1:2], ' '), array_to_string(string_split(phrase, ' ')[2:3], ' ')]) as phrase, a from c where k = 3),
most as (select lang, phrase, max(a) as most from inside group by all),
held as (select c.* from c left join most on c.k = 2 and c.lang = most.lang and c.phrase = most.phrase where most.most is null or 100 * most.most < 50 * c.a),
cuts as (select *, unnest(range(1, k)) as u from held),
parts as (select *, array_to_string(string_split(phrase, ' ')[1:u], ' ') as lp, array_to_string(string_split(phrase, ' ')[u + 1:k], ' ') as rp from cuts),
scored as (select parts.lang, parts.phrase, parts.a, x.a as l, y.a as r, u, (1000000::hugeint * parts.a * parts.a // (x.a::hugeint * y.a))::bigint as score
           from parts join f x on x.lang = parts.lang and x.phrase = lp join f y on y.lang = parts.lang and y.phrase = rp),
best as (select * from scored qualify row_number() over (partition by lang, phrase order by score, u) = 1),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from best)
select lang, rank, phrase, a, l, r, n, score from ranked join n using (lang) where rank <= 2000
"""
