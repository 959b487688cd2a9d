"""Operator 10: byte-level BPE by the ranks of a vocabulary file.

Texts are split into blocks of about ``BLOCK`` characters. A block is one row: its distinct words (the pieces that are
merged separately) as arrays of the ranks of their bytes, and each document as numbers of these words. Spark's
higher-order functions do the rest in the stage of the scan, without a shuffle: a fold over each distinct word joins
the pair of the lowest rank again and again, looking ranks up in a literal map; a document's ids are its words' ids,
one after the other. Decoding looks the binary piece of each id up in a literal array and concatenates the pieces.

Words that many blocks share would be folded in each: those met in two documents or more of a bounded sample (``COMMON_DOCS``
documents, ``COMMON`` words of ``COMMON_BYTES`` bytes at most) are folded once by the same expression and enter all blocks as a literal. The sample
decides only how often a word is folded, never its ids.

The fold is quadratic in a word's bytes, so words over ``MAX_FOLD_BYTES`` (and those that are in the vocabulary as they are)
enter it merged already, by the same ranks. No table of words is gathered anywhere: memory follows the block, and a
text longer than a block is a block of its own.

Cases: a null text is empty and has no ids; repeated rows give repeated results; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
import json
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dendrovox.llm.common import slices, table
from dendrovox.llm.pieces import Numbers, chunks, split

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Characters in a block, about: words are merged once a block.
BLOCK = 8_000_000
MAX_FOLD_BYTES = 256
#: Documents looked at for common words, and the most words, and bytes of a word, that are kept.
COMMON_DOCS, COMMON, COMMON_BYTES = 16_000, 120_000, 48
#: Common words that a task folds.
FOLDED = 1 << 15


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a piece: its bytes, the adjacent pair of lowest rank (leftmost first) merged while there is one."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    size = [1] * n
    todo = [(ranks[piece[i : i + 2]], i, 1, 1) for i in range(n - 1) if piece[i : i + 2] in ranks]
    heapq.heapify(todo)
    while todo:
        _, i, left, right = heapq.heappop(todo)
        j = i + left
        if size[i] != left or j >= n or size[j] != right:
            continue
        size[i], size[j] = left + right, 0
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for a in (before[i], i):
            if a >= 0 and (b := after[a]) < n and (r := ranks.get(piece[a : b + size[b]])) is not None:
                heapq.heappush(todo, (r, a, size[a], size[b]))
    return [ranks[piece[i : i + size[i]]] for i in range(n) if size[i]]


#: Odd, and small enough that no product in ``RankMap`` leaves 63 bits.
_TURN = 2654435


class RankMap:
    """Rank of the concatenation of two pieces by their ranks, as a literal for Spark expressions.

    Spark searches a map literal from its start, so the map is laid out as a perfect hash: a pair's first hash gives a
    factor, and that the only place where the pair can be, with its rank.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.bits = max(8, max(ranks.values()).bit_length())
        self.bits += max(ranks.values()) == (1 << self.bits) - 1
        if self.bits > 17:
            raise ValueError("the vocabulary has more than 131,071 ranks")
        self.none = (1 << self.bits) - 1
        joined = [(ranks[p[:k]], ranks[p[k:]], r) for p, r in ranks.items() for k in range(1, len(p)) if p[:k] in ranks and p[k:] in ranks]
        left, right, rank = np.array(joined, np.int64).reshape(-1, 3).T
        pair = left << self.bits | right
        self.size = 1 << max(8, (len(pair) * 5 // 4).bit_length())
        while not self._fill(pair, rank):
            self.size *= 2

    def _fill(self, pair: np.ndarray, rank: np.ndarray) -> bool:
        """Give each pair its place, groups of one first hash together, the largest first; whether that was possible."""
        self.firsts = self.size // 2
        cells, factors, taken = np.zeros(self.size, np.int64), np.zeros(self.firsts, np.int64), np.zeros(self.size, bool)
        first = self._first(pair)
        order = np.argsort(first, kind="stable")
        groups = np.split(order, np.flatnonzero(np.diff(first[order])) + 1) if len(order) else []
        for group in sorted(groups, key=len, reverse=True):
            for factor in range(_TURN + 2, 120 * _TURN, 2 * _TURN):
                place = self._place(pair[group], factor)
                if not taken[place].any() and len(set(place.tolist())) == len(place):
                    break
            else:
                return False
            taken[place], factors[first[group[0]]] = True, factor
            cells[place] = pair[group] << self.bits | rank[group]
        if not taken[0]:  # where the pair of ids 0 and 0 is looked up, which an empty cell would pass for
            cells[0] = self.none
        self.cells, self.factors = cells.tolist(), factors.tolist()
        return True

    def _first(self, pair):
        return (pair * _TURN >> 22) & (self.firsts - 1)

    def _place(self, pair, factor):
        return (pair * factor >> 18) & (self.size - 1)

    def literals(self) -> tuple[F.Column, F.Column]:
        return tuple(F.from_json(F.lit(json.dumps(x, separators=(",", ":"))), "array<bigint>") for x in (self.cells, self.factors))

    def rank(self, cells, factors, pair) -> F.Column:
        """The rank of a pair's concatenation; ``none`` if it has none or the pair is null."""
        first = F.shiftright(pair * _TURN, 22).bitwiseAND(self.firsts - 1)
        place = F.shiftright(pair * F.get(factors, first.cast("int")), 18).bitwiseAND(self.size - 1)
        cell = F.get(cells, place.cast("int"))
        # a cell of another pair keeps a bit above the ranks; written so that each part is evaluated once
        return F.least(cell.bitwiseXOR(F.shiftleft(pair, self.bits)), F.lit(self.none).cast("long"))


def let(value, then) -> F.Column:
    """``then(value)``, with the value evaluated once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def fold_merges(word, known: RankMap, cells, factors) -> F.Column:
    """The ids of a word, by a fold of ranked merges.

    An element of ``word`` and of the state is a part's id below the rank of its concatenation with the next part.
    """
    id_of = lambda x: x.bitwiseAND(known.none)
    both = lambda a, b: F.shiftleft(a, known.bits).bitwiseOR(b)
    absent = F.lit(known.none).cast("long")

    def step(state, _):
        having = lambda value, then: F.aggregate(F.array(value), state, lambda _, x: then(x))

        def merge_at(made, k):
            """Parts k and k + 1 become one; the ranks of its pairs with the parts beside it are looked up."""
            pairs = F.array(both(id_of(F.get(state, k - 1)), made), both(made, F.coalesce(id_of(F.get(state, k + 2)), absent)))
            two = F.transform(pairs, lambda pair: both(known.rank(cells, factors, pair), F.shiftright(pair, known.bits)))
            put = lambda two, left: F.transform(F.filter(state, lambda _, i: i != left + 2), lambda x, i: F.coalesce(F.get(two, i - left), x))
            return having(k - 1, lambda left: having(two, lambda two: put(two, left)))

        def merge(least):
            """``least``: the lowest rank above the first place where it is."""
            merged = having(F.shiftright(least, known.bits), lambda made: having(id_of(least).cast("int"), lambda k: merge_at(made, k)))
            return F.when(least >= known.none << known.bits, state).otherwise(merged)

        return having(F.array_min(F.transform(state, lambda x, k: x.bitwiseAND(~known.none).bitwiseOR(k.cast("long")))), merge)

    merged = F.aggregate(F.sequence(F.lit(2), F.size(word)), word, step)
    return F.transform(F.when(F.array_min(word) < known.none << known.bits, merged).otherwise(word), lambda x: id_of(x).cast("int"))


def _ranked(ranks: dict[bytes, int], known: RankMap):
    """A function that makes words into arrays as ``fold_merges`` takes them."""
    byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
    no_rank = known.none << known.bits  # workers do not need the map itself
    beside = np.array([[ranks.get(bytes([a, b]), known.none) for b in range(256)] for a in range(256)], np.int64) << known.bits

    def ranked(words: list[bytes]) -> pa.Array:
        """Each word's bytes by their ids, below the rank of each with the next; those that need no fold as they end."""
        done = {k: [ranks[w]] if w in ranks else merge(w, ranks) for k, w in enumerate(words) if w in ranks or len(w) > MAX_FOLD_BYTES}
        raw = np.frombuffer(b"".join(w for k, w in enumerate(words) if k not in done), np.uint8)
        sizes = np.fromiter((len(done[k]) if k in done else len(w) for k, w in enumerate(words)), np.int64, len(words))
        folds = np.fromiter((k not in done for k in range(len(words))), bool, len(words))
        pair = np.append(beside[raw[:-1], raw[1:]], 0) if len(raw) else np.empty(0, np.int64)
        pair[np.cumsum(sizes[folds]) - 1] = no_rank
        out = np.empty(int(sizes.sum()), np.int64)
        at = np.repeat(folds, sizes)
        out[at] = pair | byte[raw]
        out[~at] = np.array([i for k in sorted(done) for i in done[k]], np.int64) | no_rank
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(out))

    return ranked


def common_words(docs: DataFrame) -> list[str]:
    """Words that several documents of a bounded sample hold, the most common first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            for some in chunks(b["text"].to_pylist()):
                joined, _, first, end, hashed, before = split(some)
                doc = np.repeat(np.arange(len(some)), np.diff(before)).astype(np.uint64)
                _, one = np.unique(hashed * np.uint64(0x9E3779B97F4A7C15) + doc, return_index=True)
                one = one[end[one] - first[one] <= COMMON_BYTES]
                words, n = np.unique(np.array([joined[i:j] for i, j in zip(first[one].tolist(), end[one].tolist(), strict=True)], object), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(n, pa.int64())], ["word", "n"])

    every = max(1, docs.count() // COMMON_DOCS)
    each = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).select("text").mapInArrow(run, "word string, n long")
    most = each.groupBy("word").agg(F.sum("n").alias("n")).where((F.col("n") > 1) & (F.octet_length("word") <= COMMON_BYTES))
    return [r["word"] for r in most.orderBy(F.desc("n"), "word").limit(COMMON).collect()]


def word_blocks(docs: DataFrame, ranks: dict[bytes, int], known: RankMap, block: int = BLOCK, common: list[str] = ()) -> DataFrame:
    """``docs`` (``doc_id`` and the numbers of its words) and ``words`` (as ``fold_merges`` takes them) of each block of texts.

    The words of ``common`` have the first numbers, and are not among a block's ``words``.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    ranked, seeded = _ranked(ranks, known), Numbers.of(list(common))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, words, numbers, chars = [], [], seeded.copy(), 0
        held: list[tuple[np.ndarray, np.ndarray]] = []  # numbers of words, and how many before each text

        def close() -> pa.RecordBatch:
            ends = np.cumsum(np.concatenate([[0], *(np.diff(n) for _, n in held)]))
            each = pa.StructArray.from_arrays([pa.concat_arrays(ids), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([x for x, _ in held])))], ["doc_id", "words"])
            some = pa.concat_arrays(words)
            return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays([0, len(each)], each), pa.ListArray.from_arrays([0, len(some)], some)], ["docs", "words"])

        for b in slices(batches):
            at = 0
            for some in chunks(b["text"].to_pylist()):
                joined, code, first, end, hashed, before = split(some)
                found, new = numbers.number(joined, code, first, end, hashed)
                words.append(ranked([joined[first[i] : end[i]].encode() for i in new.tolist()]))
                ids.append(b["doc_id"].slice(at, len(some)))
                held.append((found.astype(np.int32), before))
                at, chars = at + len(some), chars + len(joined)
                if chars >= block:
                    yield close()
                    ids, words, numbers, chars, held = [], [], seeded.copy(), 0, []
        if ids:
            yield close()

    return docs.select("doc_id", "text").mapInArrow(run, f"docs array<struct<doc_id:{kind},words:array<int>>>, words array<array<bigint>>")


def encode_documents(docs: DataFrame, ranks_path: str = RANKS, block: int = BLOCK) -> DataFrame:
    """``doc_id, ids`` of each row of ``docs`` (``doc_id, text``)."""
    ranks = read_ranks(ranks_path)
    known = RankMap(ranks)
    cells, factors = known.literals()
    common = common_words(docs)
    fold = lambda column: let(cells, lambda c: let(factors, lambda s: F.transform(column, lambda w: fold_merges(w, known, c, s))))
    ranked, cuts = _ranked(ranks, known), range(0, len(common), FOLDED)
    each = [ranked([w.encode() for w in common[i : i + FOLDED]]) for i in cuts]
    words = pa.chunked_array([pa.ListArray.from_arrays([0, len(x)], x) for x in each], pa.list_(pa.list_(pa.int64()))).combine_chunks()
    parts = docs.sparkSession.createDataFrame(pa.table({"at": pa.array(cuts, pa.int64()), "words": words})).repartition(max(1, len(cuts)))
    folded = sorted(parts.select("at", F.to_json(fold("words")).alias("ids")).collect())
    first = F.from_json(F.lit("[" + ",".join(r["ids"][1:-1] for r in folded) + "]"), "array<array<int>>")
    merged = F.concat(first, fold("words"))
    whole = let(merged, lambda m: F.transform("docs", lambda d: F.struct(d["doc_id"].alias("doc_id"), F.flatten(F.transform(d["words"], lambda i: F.get(m, i))).alias("ids"))))
    return word_blocks(docs, ranks, known, block, common).select(F.explode(whole).alias("d")).select("d.doc_id", "d.ids")


def decode_documents(encoded: DataFrame, ranks_path: str = RANKS) -> DataFrame:
    """``encoded`` (``doc_id, ids``) with ``decoded``, the binary pieces of the ids concatenated."""
    ranks = read_ranks(ranks_path)
    spelt = [""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        spelt[rank] = piece.decode("latin-1")  # a character for each byte
    literal = F.from_json(F.lit(json.dumps(spelt, separators=(",", ":"))), "array<string>")
    joined = let(literal, lambda p: F.array_join(F.transform("ids", lambda i: F.get(p, i)), ""))
    return encoded.select("doc_id", "ids", F.encode(joined, "ISO-8859-1").alias("decoded"))


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of the encoded and decoded texts."""
    both = decode_documents(encode_documents(docs))
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
