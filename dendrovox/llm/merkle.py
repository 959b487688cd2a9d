"""Operator 11: a Merkle manifest of a dataset, with a witness for every row, by aligned append.

A tree takes its nodes one after another. A subtree that is still open keeps, for each child it has, what is known of that
child's siblings (a partial witness); every later sibling extends it, and when the run of three is full its digest is appended
one level up. A task appends an aligned block of a tree's leaves and hands on the block's root; the roots of all blocks are
appended in their turn, in tasks again, until a tree has one node left. The witnesses then go the other way: what a block's root gathered above
extends the witnesses of all rows in the block. So no task holds more than a block, and the rounds are the logarithm of the rows
to the base of a block. Rows are numbered within their tree by ranges of (source, row), so a source of any size is spread over
tasks. The roots of the sources, in order, are the leaves of one more tree.

Cases: null columns are told apart from empty ones; rows without a source are a tree of their own, before all others; a null
doc_id comes first and is never tampered with; rows that repeat a doc_id are leaves of their own, in order of their digests; an
empty table gives no rows; a single row is its own root; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dendrovox.llm.common import ddl, small_side, table
from dendrovox.plans.iterate import materialize, settle

ARITY = 3
#: Levels of a block: a task appends as many as 3^5 nodes.
LEVELS = 5
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: A tree is named by whether its rows have a source, and the source.
TREE = ["named", "name"]
WITNESS = "array<struct<left string, right string>>"
_WITNESS = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class Appender:
    """A tree in the making: the open run of each level, and the witness so far of each node appended."""

    def __init__(self):
        self.open: list[list[list]] = []
        self.witness: list[list[tuple[str, str]]] = []

    def append(self, digest: str) -> None:
        self.witness.append([])
        self._join(0, digest, len(self.witness) - 1, len(self.witness))

    def _join(self, level: int, digest: str, first: int, end: int) -> None:
        """A finished subtree over the nodes from ``first`` to ``end`` joins the open run of its level."""
        if level == len(self.open):
            self.open.append([])
        run = self.open[level]
        before = "".join(child[0] for child in run)
        for child in run:
            child[4] += digest
        run.append([digest, first, end, before, ""])
        if len(run) == ARITY:
            self._finish(level)

    def _finish(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        for _, first, end, left, right in run:
            for w in self.witness[first:end]:
                w.append((left, right))
        self._join(level + 1, _digest("".join(child[0] for child in run)), run[0][1], run[-1][2])

    def close(self, levels: int | None = None) -> str:
        """The root, ``levels`` above the nodes; None: as soon as one node is left."""
        level = 0
        while True:
            run, last = self.open[level], level == len(self.open) - 1
            if last and (len(run) == 1 if levels is None else level == levels):
                return run[0][0]
            if run:
                self._finish(level)
            level += 1


def _closed(nodes: pa.Table, levels: int) -> tuple[Appender, str, pa.Table]:
    """A block's nodes appended in order: (the tree, the block's root, the nodes in order)."""
    nodes = nodes.sort_by("at")
    tree = Appender()
    for digest in nodes["digest"].to_pylist():
        tree.append(digest)
    return tree, tree.close(None if nodes["n"][0].as_py() <= ARITY**levels else levels), nodes


def leaf(fields=FIELDS, text: Column | None = None) -> Column:
    """Digest of a row: each field as byte count and value; ``text`` stands for the column of that name."""
    out = []
    for name in fields:
        c = (F.col(name) if name != "text" or text is None else text).cast("string")
        out.append(F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)))
    return F.sha2(F.concat(*out).cast("binary"), 256)


def number(rows: DataFrame, order: list[str]) -> DataFrame:
    """The rows with their place ``at`` in their tree, from 0, by ``order``, and the tree's number ``n`` of rows.

    Ranges are numbered each in its task; what lies before a range is summed over the ranges' counts. No task gathers a tree.
    """
    schema = ddl(rows, rows.columns, "part int, at long")

    def count(batches):
        part, now, k = TaskContext.get().partitionId(), None, 0
        for b in batches:
            at = np.empty(b.num_rows, np.int64)
            for i, tree in enumerate(zip(b["named"].to_pylist(), b["name"].to_pylist(), strict=True)):
                now, k = (tree, k + 1) if tree == now else (tree, 0)
                at[i] = k
            yield pa.RecordBatch.from_arrays([*b.columns, pa.repeat(part, b.num_rows).cast(pa.int32()), pa.array(at)], [*b.schema.names, "part", "at"])

    dealt = rows.repartitionByRange(*TREE, *order).sortWithinPartitions(*TREE, *order)
    each = materialize(dealt.mapInArrow(count, schema), "numbered")
    ranges = each.groupBy(*TREE, "part").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*TREE)
    before = F.coalesce(F.sum("_n").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = materialize(ranges.select(*TREE, "part", before.alias("_before"), F.sum("_n").over(whole).alias("n")), "ranges")
    return each.join(small_side(sums), [*TREE, "part"]).withColumn("at", F.col("at") + F.col("_before")).drop("_before", "part")


def climb(nodes: DataFrame, levels: int = LEVELS) -> tuple[list[DataFrame], list[DataFrame]]:
    """Of a table ``named, name, at, n, digest``: (the nodes of each round; the trees that end in each round, with their root)."""

    size = ARITY**levels

    def close(block: pa.Table) -> pa.Table:
        _, root, block = _closed(block, levels)
        first = block.slice(0, 1)
        return pa.table({"named": first["named"], "name": first["name"], "at": pa.array([first["at"][0].as_py() // size]), "n": pa.array([-(-first["n"][0].as_py() // size)]), "digest": [root]})

    rounds, ended = [nodes], []
    while True:
        now = rounds[-1].select(*TREE, "at", "n", "digest", F.expr(f"at div {size}").alias("block"))
        schema = "named boolean, name string, at long, n long, digest string"
        roots = materialize(now.groupBy(*TREE, "block").applyInArrow(close, schema), "roots")
        ended.append(roots.where("n = 1").select(*TREE, F.col("digest").alias("root")))
        more = roots.where("n > 1")
        if more.isEmpty():
            return rounds, ended
        rounds.append(more)


def _extender(keep: list[str], levels: int):
    """A function of a block and what its root has gathered above: the block's nodes with their whole witness."""

    def extend(nodes: pa.Table, over: pa.Table) -> pa.Table:
        tree, _, nodes = _closed(nodes, levels)
        more = over["witness"][0].as_py()
        whole = [[*({"left": a, "right": b} for a, b in w), *more] for w in tree.witness]
        found = {c: nodes[c] for c in (*TREE, "at", *keep)}
        return pa.table(found | {"top": pa.array([over["top"][0].as_py()] * len(nodes), pa.string()), "witness": pa.array(whole, _WITNESS)})

    return extend


def descend(rounds: list[DataFrame], above: list[DataFrame], carry: list[str], levels: int = LEVELS) -> DataFrame:
    """The leaves with ``witness``, their columns ``carry``, and ``top`` of their tree.

    ``above``: for each round the trees that end in it, with what their root has gathered (``witness``) and ``top``.
    """
    known = None
    for k in range(len(rounds) - 1, -1, -1):
        over = above[k].select(*TREE, F.lit(0).cast("long").alias("block"), "top", "witness")
        if known is not None:
            over = over.unionByName(known.select(*TREE, F.col("at").alias("block"), "top", "witness"))
        keep = [] if k else carry
        nodes = rounds[k].select(*TREE, "at", "n", "digest", *keep, F.expr(f"at div {ARITY**levels}").alias("block"))
        schema = ddl(nodes, [*TREE, "at", *keep], f"top string, witness {WITNESS}")
        known = nodes.groupBy(*TREE, "block").cogroup(over.groupBy(*TREE, "block")).applyInArrow(_extender(keep, levels), schema)
        if k:
            known = materialize(known, "witnesses")
    return known


def merkle_manifest(docs: DataFrame, fields=FIELDS, source: str = "source", row: str = "doc_id", carry: dict[str, Column] | None = None, levels: int = LEVELS) -> DataFrame:
    """A row for each row of ``docs``: its column ``row``, the ``carry`` columns, ``leaf, subroot, root, witness``.

    ``witness``: what stands to the left and to the right of the row's subtree in its run, level by level up to the root.
    """
    more = {row: F.col(row), **(carry or {})}
    names = {name: f"c{k}" for k, name in enumerate(more)}
    trees = [F.col(source).isNotNull().alias("named"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("name")]
    digest = leaf(fields)
    leaves = materialize(docs.select(*trees, digest.alias("digest"), digest.alias("leaf"), *[c.alias(names[n]) for n, c in more.items()]), "leaves")
    rounds, ended = climb(number(leaves, [names[row], "digest"]), levels)
    roots = ended[0]
    for some in ended[1:]:
        roots = roots.unionByName(some)
    one_tree = roots.select(F.lit(True).alias("named"), F.lit("").alias("name"), F.col("named").alias("is_named"), F.col("name").alias("of"), F.col("root").alias("digest"), F.col("root").alias("subroot"))
    top_rounds, top_ended = climb(number(one_tree, ["is_named", "of"]), levels)
    found = [some.first() for some in top_ended]
    root = next((r["root"] for r in found if r), None)
    nothing = F.array().cast(WITNESS)
    over = [some.select(*TREE, F.col("root").alias("top"), nothing.alias("witness")) for some in top_ended]
    gathered = materialize(descend(top_rounds, over, ["is_named", "of", "subroot"], levels).select(F.col("is_named").alias("named"), F.col("of").alias("name"), F.col("subroot").alias("top"), "witness"), "sources")
    above = [some.select(*TREE).join(gathered, TREE) for some in ended]
    out = descend(rounds, above, ["leaf", *names.values()], levels)
    return out.select(*[F.col(c).alias(n) for n, c in names.items()], "leaf", F.col("top").alias("subroot"), F.lit(root).cast("string").alias("root"), "witness")


def folded(start: Column, witness: str = "witness") -> Column:
    """The root that a leaf and its witness give."""
    return F.aggregate(witness, start, lambda below, w: F.sha2(F.concat(w["left"], below, w["right"]).cast("binary"), 256))


def audit(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Each row's proof, and the root that its tampered text (without newlines, for every other crc32 of doc_id) folds to."""
    struck = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.contains("text", F.lit("\n"))
    tampered = F.when(struck, leaf(text=F.translate("text", "\n", "")))
    rows = merkle_manifest(docs, carry={"tampered": tampered}, levels=levels)
    proof = F.sha2(F.array_join(F.transform("witness", lambda w: F.concat(w["left"], w["right"])), "").cast("binary"), 256)
    out = rows.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), folded(F.coalesce("tampered", "leaf")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settle(lambda: audit(table(spark, sf_dir, "documents")), "manifest")


def _oracle(levels: int = 16, top_levels: int = 10) -> str:
    """The contract in SQL, level by level; ``levels`` suffice for 3^16 rows of a source."""
    one = lambda c: f"coalesce(strlen({c}::varchar) || ':' || {c}, '-')"
    row = lambda text: f"sha256(concat({', '.join(one(c) for c in FIELDS[:4])}, {one(text)}))"
    step = "list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)"
    crc = f"list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)), lambda a, b: {step})"
    sql = [
        f"""with given as materialized (select doc_id, source, {row('text')} as leaf,
             case when doc_id is not null and {crc} & 1 = 1 then {row("replace(text, chr(10), '')")} end as struck from documents),
        leaves as materialized (select *, coalesce(struck, leaf) as checked, source is not null as named, coalesce(source, '') as name,
             row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as i from given),
        a0 as materialized (select named, name, i, leaf as h, count(*) over (partition by named, name) as c from leaves)"""
    ]

    def grow(a: str, count: int) -> None:
        for k in range(count):
            run = "partition by named, name, i // 3 order by i rows between"
            sql.append(f"""{a}s{k} as materialized (select *, coalesce(string_agg(h, '') over ({run} unbounded preceding and 1 preceding), '') as l,
                coalesce(string_agg(h, '') over ({run} 1 following and unbounded following), '') as r from {a}{k})""")
            sql.append(f"""{a}{k + 1} as materialized (select *, count(*) over (partition by named, name) as c from (
                select named, name, i // 3 as i, case when max(c) = 1 then max(h) else sha256(string_agg(h, '' order by i)) end as h from {a}{k} group by named, name, i // 3))""")

    grow("a", levels)
    sql.append(f"b0 as materialized (select true as named, '' as name, row_number() over (order by x.named, x.name) - 1 as i, h, count(*) over () as c, x.named as is_named, x.name as of from a{levels} x)")
    grow("b", top_levels)
    sql.append("f0 as materialized (select doc_id, leaf, named, name, i, checked as f, '' as p from leaves)")

    def fold(a: str, at: int, count: int) -> None:
        for k in range(count):
            sql.append(f"""f{at + k + 1} as materialized (select f.doc_id, f.leaf, f.named, f.name, {'f.is_named, f.of, f.subroot, ' if a == 'b' else ''}f.i // 3 as i,
                case when c > 1 then sha256(l || f || r) else f end as f, case when c > 1 then p || l || r else p end as p
                from f{at + k} f join {a}s{k} x on x.named = f.named and x.name = f.name and x.i = f.i)""")

    fold("a", 0, levels)
    sql.append(f"f{levels + 1} as materialized (select doc_id, leaf, true as named, '' as name, b0.is_named, b0.of, b0.h as subroot, b0.i as i, f, p from f{levels} f join b0 on b0.is_named = f.named and b0.of = f.name)")
    fold("b", levels + 1, top_levels)
    return ",\n".join(sql) + f"""
        select doc_id, leaf, subroot, h as root, sha256(p) as proof_sha256, f as folded_root, f = h as verified from f{levels + 1 + top_levels}, b{top_levels}"""


ORACLE_OP11 = _oracle()
