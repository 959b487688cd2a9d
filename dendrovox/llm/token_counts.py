"""Operator 1: token counts that follow edits.

Each document keeps the segment tree of its pre-token pieces: leaves are blocks of pieces (characters and tokens of
each), inner nodes hold the sums of their subtrees. An edit walks down the character sums to the pieces it
touches, splits again from a piece start a few characters before it until the new pieces meet an old piece
start behind it, counts the tokens of those pieces only, and updates the sums on the way up. So a document's count
follows its edits at the cost of the edited regions, whatever its length.

Cases: a null text is empty; an edit beyond the end acts at the end, one with a negative place at the start; null in an
edit is 0 or nothing; no edits leave the count as it is; repeated rows are treated alike; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dendrovox.llm.common import ddl, table
from dendrovox.llm.pieces import WHITE_POINTS, Memo, PieceTable, one_by_one

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
FAN = 64
#: Characters between a new split's start and the edit: the pattern looks no further ahead.
CONTEXT = 4
EDITS = "array<struct<at:int,cut:int,put:string>>"
TREE = "chars array<int>, tokens array<int>, blocks array<int>, sums array<long>"


def tokenizer(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class SegmentTree:
    """Blocks of leaves (characters, tokens of each piece) under a binary tree of their sums."""

    def __init__(self, chars: np.ndarray, tokens: np.ndarray, blocks: np.ndarray | None = None, sums: np.ndarray | None = None):
        if blocks is None:
            blocks = np.full(-(-len(chars) // FAN), FAN)
            blocks[-1:] = len(chars) - FAN * (len(blocks) - 1)
        ends = np.cumsum(blocks)
        self.leaves = [(chars[e - b : e], tokens[e - b : e]) for b, e in zip(blocks, ends, strict=True)] or [(chars, tokens)]
        self.base = 1 << (len(self.leaves) - 1).bit_length()
        if sums is not None and len(sums):
            self.sums = sums.reshape(2, -1).copy()
        else:
            self.sums = np.zeros((2, 2 * self.base), np.int64)
            self.sums[:, self.base : self.base + len(self.leaves)] = [[int(x[k].sum()) for x in self.leaves] for k in (0, 1)]
            for i in range(self.base - 1, 0, -1):
                self.sums[:, i] = self.sums[:, 2 * i] + self.sums[:, 2 * i + 1]

    @property
    def n_chars(self) -> int:
        return int(self.sums[0, 1])

    @property
    def n_tokens(self) -> int:
        return int(self.sums[1, 1])

    def find(self, place: int) -> tuple[int, int]:
        """The block that holds character ``place`` (the last one for the end), and where it starts."""
        i, start = 1, 0
        while i < self.base:
            i *= 2
            if place >= start + self.sums[0, i] and self.sums[0, i + 1]:
                start += int(self.sums[0, i])
                i += 1
        return i - self.base, start

    def set(self, block: int, chars: np.ndarray, tokens: np.ndarray) -> None:
        self.leaves[block] = (chars, tokens)
        i = self.base + block
        change = np.array([int(chars.sum()), int(tokens.sum())]) - self.sums[:, i]
        while i:
            self.sums[:, i] += change
            i //= 2

    def boundary_before(self, place: int) -> int:
        """The last piece start at or before ``place``."""
        block, start = self.find(max(0, place))
        starts = start + np.append(0, np.cumsum(self.leaves[block][0]))
        return int(starts[max(0, np.searchsorted(starts, place, side="right") - 1)])

    def boundaries(self, first: int, last: int) -> set[int]:
        """All piece starts between two places, both included."""
        out: set[int] = set()
        block, start = self.find(max(0, first))
        while block < len(self.leaves) and start <= last:
            out.update((start + np.append(0, np.cumsum(self.leaves[block][0]))).tolist())
            start += int(self.sums[0, self.base + block])
            block += 1
        return {x for x in out if first <= x <= last}

    def splice(self, first: int, last: int, chars: list[int], tokens: list[int]) -> None:
        """Put new leaves in place of those from piece start ``first`` to piece start ``last``."""
        block, start = self.find(first)
        while start > first or (first == start and block and not self.leaves[block][0].size):
            block -= 1
            start -= int(self.sums[0, self.base + block])
        new = (np.array(chars, np.int64), np.array(tokens, np.int64))
        while True:
            c, t = self.leaves[block]
            edges = start + np.append(0, np.cumsum(c))
            i, j = np.searchsorted(edges, first), np.searchsorted(edges, last)
            i, j = min(i, len(c)), min(j, len(c))
            size = int(self.sums[0, self.base + block])
            self.set(block, np.concatenate([c[:i], new[0], c[j:]]), np.concatenate([t[:i], new[1], t[j:]]))
            start += size
            block += 1
            if start >= last or block >= len(self.leaves):
                break
            new = (new[0][:0], new[1][:0])

    def columns(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.array([len(x[0]) for x in self.leaves], np.int32)
        return (*(np.concatenate([x[k] for x in self.leaves]).astype(np.int32) for k in (0, 1)), sizes, self.sums.reshape(-1))


def apply_edit(text: str, tree: SegmentTree, at: int, cut: int, put: str, split, count) -> tuple[str, int]:
    """The edited text and how many of its characters were encoded again; ``tree`` is updated."""
    at = min(max(at, 0), len(text))
    cut = min(max(cut, 0), len(text) - at)
    new = text[:at] + put + text[at + cut :]
    first = tree.boundary_before(at - CONTEXT) if at > CONTEXT else 0
    shift, reach = len(put) - cut, 64
    while True:
        end = min(len(new), at + len(put) + reach)
        sure = end if end == len(new) else end - CONTEXT
        old = tree.boundaries(at + cut, end - shift)
        sizes, place, stop = [], first, None
        for piece in split(new[first:end]):
            if place >= at + len(put) and place - shift in old and place <= sure:
                stop = place
                break
            sizes.append(piece)
            place += len(piece)
        if stop is None and end == len(new):
            stop = place
        if stop is not None:
            break
        reach *= 4
    tree.splice(first, stop - shift, [len(p) for p in sizes], [count[p] for p in sizes])
    return new, stop - first


def _array(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(values) if values else [], kind))


def build_trees(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """The columns of ``docs`` (``doc_id, text`` and maybe ``edits``) with the tree's: ``chars, tokens, blocks, sums``.

    A column that bears the name ``edits`` but is of another type than ``EDITS`` is ignored.
    """
    names = ["doc_id", "text", *(["edits"] if dict(docs.dtypes).get("edits") == EDITS else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokenizer(ranks)
        pieces = PieceTable(one_by_one(enc.encode_ordinary))
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                trees = [SegmentTree(chars, sizes).columns() for _, sizes, chars in pieces.documents(b["text"].to_pylist())]
                kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([*(b[c] for c in names), *(_array([t[k] for t in trees], kind) for k, kind in enumerate(kinds))], [*names, "chars", "tokens", "blocks", "sums"])

    return docs.select(names).mapInArrow(run, ddl(docs, names, TREE))


def apply_edits(trees: DataFrame, ranks: str = RANKS) -> DataFrame:
    """Apply each row's ``edits`` in order (places are those of the text that the edits before have left).

    Returns ``doc_id, text`` (edited), the updated tree, ``n_tokens_before, n_tokens, n_reencoded`` (characters).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        enc = tokenizer(ranks)
        white = "".join(map(chr, WHITE_POINTS))
        pattern = public_tokenizers.PATTERN.replace(r"[^\s", f"[^{white}").replace(r"(?!\S)", f"(?![^{white}])").replace(r"\s", f"[{white}]")
        split, count = regex.compile(pattern).findall, Memo(lambda p: len(enc.encode_ordinary(p)))
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                out = {k: [] for k in ("text", "before", "now", "again")}
                trees = []
                columns = [(b[c].offsets.to_numpy(), b[c].values.to_numpy(zero_copy_only=False)) for c in ("chars", "tokens", "blocks", "sums")]
                for i, (text, edits) in enumerate(zip(b["text"].to_pylist(), b["edits"].to_pylist(), strict=True)):
                    tree = SegmentTree(*(v[o[i] : o[i + 1]] for o, v in columns))
                    text, again = text or "", 0
                    out["before"].append(tree.n_tokens)
                    for e in filter(None, edits or []):
                        text, n = apply_edit(text, tree, e["at"] or 0, e["cut"] or 0, e["put"] or "", split, count)
                        again += n
                    out["text"].append(text)
                    out["now"].append(tree.n_tokens)
                    out["again"].append(again)
                    trees.append(tree.columns())
                kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b["doc_id"], pa.array(out["text"], pa.string()), *(_array([t[k] for t in trees], kind) for k, kind in enumerate(kinds)), *(pa.array(out[k], pa.int64()) for k in ("before", "now", "again"))],
                    ["doc_id", "text", "chars", "tokens", "blocks", "sums", "n_tokens_before", "n_tokens", "n_reencoded"],
                )

    schema = ddl(trees, ["doc_id"], f"text string, {TREE}, n_tokens_before long, n_tokens long, n_reencoded long")
    return trees.select("doc_id", "text", "edits", "chars", "tokens", "blocks", "sums").mapInArrow(run, schema)


def derived_edits(docs: DataFrame) -> DataFrame:
    """``doc_id, text, edits``: three edits of each text, at places drawn by hash of doc_id: an insertion, a deletion and a replacement."""
    n = F.length(F.coalesce("text", F.lit("")))

    def place(k: int) -> F.Column:
        return F.pmod(F.xxhash64(F.lit(k), "doc_id"), n + 1).cast("int")

    edits = F.array(
        F.struct(place(1).alias("at"), F.lit(0).alias("cut"), F.concat(F.lit(" edit "), F.col("doc_id").cast("string")).alias("put")),
        F.struct(place(2).alias("at"), F.lit(7).alias("cut"), F.lit("").alias("put")),
        F.struct(place(3).alias("at"), F.lit(5).alias("cut"), F.reverse(F.substring("text", F.lit(1), F.lit(9))).alias("put")),
    )
    return docs.select("doc_id", "text", edits.cast(EDITS).alias("edits"))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = apply_edits(build_trees(derived_edits(table(spark, sf_dir, "documents"))))
    return out.select("doc_id", "n_tokens_before", "n_tokens", "n_reencoded", F.size("chars").alias("n_pieces"), F.crc32(F.col("text").cast("binary")).alias("edited_crc32"))
