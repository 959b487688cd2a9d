"""Operator 3: SimHash near-duplicates, found with BK-trees over shards of fingerprints.

Two fingerprints that differ in at most ``RADIUS`` bits agree in one of ``RADIUS + 1`` bands of their bits,
so each fingerprint goes to one shard per band, keyed by the band's value, and every link lies inside a
shard. A shard's distinct fingerprints form a BK-tree (children keyed by their Hamming distance to
the parent); a search follows only the edges within the radius. A shard of more than ``SHARD``
fingerprints is cut into blocks, and each pair of blocks is one group: no group is larger than two blocks.

The trees are not broadcast as one: together they hold every fingerprint, which has no bound. Each shard's
tree is built where its probes are instead. Copies share one fingerprint before any of this.

Cases: a null or empty text has fingerprint zero, and links like any other; repeated rows share a
fingerprint; empty input gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dendrovox.llm.common import ddl, slices, small_side, table
from dendrovox.plans.iterate import connected_components, materialize, settle

SHINGLE, RADIUS, SHARD = 4, 4, 4096
#: Shingles whose bits are counted at once.
BLOCK = 100_000


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The XXH64 (seed 42) of a text's word shingles in order; fewer words are one shingle, none are the empty one."""
    import xxhash

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    joined = b" ".join(parts)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    end = np.cumsum(sizes) - 1
    first = (end - sizes + 1)[: max(1, len(parts) - shingle + 1)].tolist() or [0]
    last = end[min(shingle, len(parts)) - 1 :].tolist() if parts else [0]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[i:j], 42) for i, j in zip(first, last, strict=True)), np.uint64, len(first))


def majority(h: np.ndarray) -> int:
    """The 64 bits that over half the hashes have set."""
    counts = np.zeros(64, np.int64)
    for a in range(0, len(h), BLOCK):
        counts += np.unpackbits(h[a : a + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 bits: bit i is set if it is set in over half the hashes of the word shingles; zero without words."""
    return majority(shingle_hashes(text, shingle)) if text and text.strip(" \t\n\v\f\r") else 0


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a signed long) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fp = np.array([fingerprint(t.as_py(), shingle) for t in b["text"]], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(fp)], ["doc_id", "fp"])

    schema = docs.select("doc_id").schema.add("fp", "long")
    return docs.select("doc_id", "text").mapInArrow(run, schema)


class BKTree:
    """Distinct integers under Hamming distance."""

    def __init__(self, value: int):
        self.value, self.children = value, {}

    def add(self, value: int) -> None:
        node = self
        while (d := (node.value ^ value).bit_count()) and d in node.children:
            node = node.children[d]
        if d:
            node.children[d] = BKTree(value)

    def within(self, value: int, radius: int) -> list[int]:
        found, todo = [], [self]
        while todo:
            node = todo.pop()
            d = (node.value ^ value).bit_count()
            if d <= radius:
                found.append(node.value)
            todo += [c for k, c in node.children.items() if d - radius <= k <= d + radius]
        return found


class Forest:
    """Union-find that can give a spanning forest, as pairs of a member and its root."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)

    def pairs(self) -> list[tuple[int, int]]:
        return [(x, r) for x in self.up if (r := self.root(x)) != x]


def shard_links(fps: list[int], left: list[bool], right: list[bool], radius: int) -> list[tuple[int, int]]:
    """Spanning pairs of the links between the left and the right fingerprints of a group."""
    forest, tree = Forest(), None
    for fp, put in zip(fps, left, strict=True):
        if put:
            if tree is None:
                tree = BKTree(fp)
            tree.add(fp)
    for fp, probe in zip(fps, right, strict=True):
        if probe and tree is not None:
            for other in tree.within(fp, radius):
                if other != fp:
                    forest.join(fp, other)
    return forest.pairs()


def links(fps: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """Pairs ``a, b`` that span the components of distinct fingerprints ``fp`` linked within ``radius`` bits."""
    cuts = [64 * k // (radius + 1) for k in range(radius + 2)]
    bands = [F.struct(F.lit(k).alias("band"), F.shiftrightunsigned("fp", cuts[k]).bitwiseAND((1 << (cuts[k + 1] - cuts[k])) - 1).alias("value")) for k in range(radius + 1)]
    keyed = fps.select("fp", F.explode(F.array(*bands)).alias("k")).select("fp", "k.band", "k.value")
    sizes = keyed.groupBy("band", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    each = keyed.join(sizes, ["band", "value"]).withColumn("blocks", F.ceil(F.col("n") / shard).cast("int"))
    each = each.withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(F.col("block"), o).alias("i"), F.greatest(F.col("block"), o).alias("j")))
    each = each.select("band", "value", "block", "fp", F.explode(pairs).alias("p")).select("band", "value", "p.i", "p.j", "block", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows = None, []

        def close():
            found = shard_links([r[1] for r in rows], [r[0] == group[2] for r in rows], [r[0] == group[3] for r in rows], radius)
            return [(np.uint64(a).astype(np.int64), np.uint64(b).astype(np.int64)) for a, b in found]

        for b in batches:
            out = []
            for *key, block, fp in zip(*(b[c].to_pylist() for c in ("band", "value", "i", "j", "block", "fp")), strict=True):
                if key != group:
                    if len(rows) > 1:
                        out += close()
                    group, rows = key, []
                rows.append((block, fp & 0xFFFFFFFFFFFFFFFF))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])
        if len(rows) > 1:
            out = close()
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    key = ["band", "value", "i", "j"]
    dealt = each.repartition(*key).sortWithinPartitions(*key)
    return dealt.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``doc_id, fp, component_id``: the smallest doc_id that links of at most ``radius`` bits reach."""
    each = materialize(fingerprints(docs, shingle), "fingerprints")
    least = materialize(each.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    parts = connected_components(links(least.select("fp"), radius))
    named = least.join(parts.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("component", "fp").alias("part"))
    lows = named.groupBy("part").agg(F.min("low").alias("component_id"))
    lookup = materialize(named.join(lows, "part").select("fp", "component_id"), "lookup")
    return each.join(lookup, "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one document of each group, the one of the smallest doc_id; all columns stay.

    A doc_id that several rows have keeps all of them.
    """
    gone = settle(lambda: near_duplicates(docs, shingle, radius).where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    return docs.join(small_side(gone), "doc_id", "left_anti").select(docs.columns)


#: What the pipeline's stage calls near-duplicates: at least so similar (Jaccard) sets of shingles of so many words.
SIMILAR, WORDS = 0.8, 5
#: Shingles that a task met in so many documents may be among the MOST_COMMON, which are broadcast to order the others before them.
COMMON_AT, MOST_COMMON, COUNTED = 8, 100_000, 1 << 20
#: Least hashes that are compared before whole sets, and how far below ``SIMILAR`` their share may be (six deviations).
FIRST, SLACK = 64, 0.3


def pack(hashes: np.ndarray) -> bytes:
    """The upper 48 bits of sorted hashes, six bytes each."""
    return (hashes >> np.uint64(16)).astype(np.uint32).tobytes() + (hashes >> np.uint64(48)).astype(np.uint16).tobytes()


def unpack(packed: bytes) -> np.ndarray:
    n = len(packed) // 6
    return np.frombuffer(packed, np.uint32, n).astype(np.uint64) | np.frombuffer(packed, np.uint16, n, 4 * n).astype(np.uint64) << np.uint64(32)


def sketches(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``k, doc_id, fp, h, g, size, hashes, first`` of each row: its number, fingerprint, the 128 bits that name its set of
    shingles, the set (48 bits of each hash) and the upper halves of its ``FIRST`` least hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in slices(batches, 256):
            all_of = [shingle_hashes(t.as_py(), words) for t in b["text"]]
            sets = [np.unique(h) for h in all_of]
            names = np.array([np.frombuffer(xxhash.xxh3_128_digest(x.tobytes()), np.int64) for x in sets]).reshape(-1, 2)
            fp = np.array([majority(h) for h in all_of], np.uint64).view(np.int64)
            first = [(x[:FIRST] >> np.uint64(32)).astype(np.uint32).tobytes() for x in sets]
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], pa.array(fp), pa.array(names[:, 0]), pa.array(names[:, 1]), pa.array(map(len, sets), pa.int32()), pa.array(map(pack, sets), pa.binary()), pa.array(first, pa.binary())],
                ["doc_id", "fp", "h", "g", "size", "hashes", "first"],
            )

    found = docs.select("doc_id", "text").mapInArrow(run, ddl(docs, ["doc_id"], "fp long, h long, g long, size int, hashes binary, first binary"))
    return materialize(found.select(F.monotonically_increasing_id().alias("k"), "*"), "sketches")


def first_share(x: bytes, y: bytes) -> float:
    """Estimate of the similarity of two sets by the least hashes of their union."""
    x, y = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
    least = np.union1d(x, y)[:FIRST]
    return float((np.isin(least, x) & np.isin(least, y)).mean())


def set_share(x: bytes, y: bytes) -> float:
    x, y = unpack(x), unpack(y)
    both = len(np.intersect1d(x, y))
    return both / (len(x) + len(y) - both)


def _where_alike(pairs: DataFrame, sets: DataFrame, column: str, share: Callable[[bytes, bytes], float], least: float) -> DataFrame:
    """The pairs ``a, b`` (of ``k`` of ``sets``) for which ``share`` of the column is at least ``least``."""
    need = materialize(pairs.select(F.col("a").alias("k")).union(pairs.select(F.col("b").alias("k"))).distinct(), "need")
    held = materialize(sets.select("k", column).join(small_side(need), "k", "left_semi"), "held")
    named = pairs.join(held.toDF("a", "x"), "a").join(held.toDF("b", "y"), "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 64):
            ok = [share(x, y) >= least - 1e-9 for x, y in zip(b["x"].to_pylist(), b["y"].to_pylist(), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return materialize(named.mapInArrow(run, "a long, b long"), "alike")


def similar_of(pairs: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """The pairs whose sets are similar: by their least hashes, with slack, then by the whole sets."""
    some = _where_alike(materialize(pairs.distinct(), "candidates"), sets, "first", first_share, similar - SLACK)
    return _where_alike(some, sets, "hashes", set_share, similar)


def common_shingles(sets: DataFrame) -> np.ndarray:
    """The hashes (sorted) of the most common shingles. They only order other work, so what a task meets seldom is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h[n >= COMMON_AT].view(np.int64)), pa.array(n[n >= COMMON_AT])], ["hash", "n"])

        for b in slices(batches):
            held += map(unpack, b["hashes"].to_pylist())
            size = sum(map(len, held))
            if size >= COUNTED:
                yield counted()
                held = []
        if held:
            yield counted()

    total = sets.select("hashes").mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    most = total.orderBy(F.desc("n"), "hash").limit(MOST_COMMON).select("hash").toPandas()  # bounded
    return np.sort(most["hash"].to_numpy(np.int64).view(np.uint64))


def prefixes(sets: DataFrame, common: np.ndarray, similar: float) -> DataFrame:
    """``key, k, part, size``: the shingles of each set of n of which similar sets must share one: n - similar * n + 1, the rare first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            keys = []
            for x in b["hashes"].to_pylist():
                h = unpack(x)
                at = np.minimum(np.searchsorted(common, h), max(0, len(common) - 1))
                often = common[at] == h if len(common) else np.zeros(len(h), bool)
                keys.append(np.append(h[~often], h[often])[: len(h) - int(np.ceil(similar * len(h) - 1e-9)) + 1])
            n = np.fromiter(map(len, keys), np.int64, len(keys))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), *(pa.array(np.repeat(b[c].to_numpy(), n)) for c in ("k", "part", "size"))], ["key", "k", "part", "size"])

    return sets.select("k", "part", "size", "hashes").mapInArrow(run, "key long, k long, part long, size int")


def similar_groups(docs: DataFrame, words: int = WORDS, similar: float = SIMILAR, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """``doc_id, part``: rows of one part are linked by sets of shingles that are similar.

    The BK-trees find the pairs that span the fingerprints within ``radius`` bits. Similar sets may differ in more bits, for
    which shards by bands would be too few, so a second search, over what the first has not joined, shards
    by shingles: sets that are similar share one of their first ones (``prefixes``). Both verify by the whole sets.
    """
    rows = sketches(docs, words)
    nodes = materialize(rows.groupBy("h", "g").agg(F.min("k").alias("k"), F.min("fp").alias("fp")), "nodes")
    least = nodes.groupBy("fp").agg(F.min("k").alias("low"))
    same = nodes.join(least, "fp").where("k <> low").select(F.col("low").alias("a"), F.col("k").alias("b"))
    near = links(least.select("fp"), radius, shard)
    names = lambda old, new: least.select(F.col("fp").alias(old), F.col("low").alias(new))
    near = near.toDF("x", "y").join(names("x", "a"), "x").join(names("y", "b"), "y").select("a", "b")
    linked = similar_of(same.union(near), rows, similar)
    parts = connected_components(linked).select(F.col("node").alias("k"), F.col("component").alias("part"))
    known = materialize(nodes.select("k").join(parts, "k", "left").select("k", F.coalesce("part", "k").alias("part")), "parts")
    sets = rows.select("k", "size", "hashes").join(small_side(known), "k")
    common = common_shingles(sets)
    keys = prefixes(sets, common, similar)
    shared = keys.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("key")
    keys = keys.join(small_side(materialize(shared, "shared")), "key")
    sizes = keys.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / shard).cast("int").alias("blocks"))
    keys = materialize(keys.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int")), "keys")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    one = keys.select("key", F.col("block").alias("i"), every.alias("j"), F.col("k").alias("a"), F.col("part").alias("p"), F.col("size").alias("s"))
    two = keys.select("key", F.col("block").alias("j"), every.alias("i"), F.col("k").alias("b"), "part", "size")
    may = (F.col("p") < F.col("part")) & (F.least("s", "size") >= F.greatest("s", "size") * similar - 1e-9)
    wide = similar_of(one.join(two, ["key", "i", "j"]).where(may).select("a", "b"), rows, similar)
    parts = connected_components(linked.union(wide)).select(F.col("node").alias("k"), F.col("component").alias("part"))
    known = nodes.select("h", "g", "k").join(parts, "k", "left").select("h", "g", F.coalesce("part", "k").alias("part"))
    return rows.select("doc_id", "h", "g").join(known, ["h", "g"]).select("doc_id", "part")


def drop_similar(docs: DataFrame, words: int = WORDS, similar: float = SIMILAR) -> DataFrame:
    """``docs`` with one document of each group that similar shingle sets link, the one of the smallest doc_id; as ``drop_near_duplicates``.

    Texts of fewer words than a shingle are one shingle; texts without words are copies of each other.
    """

    def others() -> DataFrame:
        named = materialize(similar_groups(docs, words, similar), "groups")
        lows = named.groupBy("part").agg(F.min("doc_id").alias("low"))
        return named.join(lows, "part").where("doc_id <> low").select("doc_id").distinct()

    return docs.join(small_side(settle(others, "gone")), "doc_id", "left_anti").select(docs.columns)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
