"""Operator 2: benchmark decontamination with DataFrame functions only.

Items of the benchmark become windows of ``WINDOW`` consecutive normalised words (a shorter item is
one window). The windows, grouped by hash, are the hash set, broadcast once their number has been
checked. Each document is read once: its words are hashed, the rolling windows of hashes are
exploded without leaving the scan's stage and probed, and a hit is verified word for word in that stage. What is shuffled
is one row per document and one per hit. A set that is too large to broadcast is joined by the windows' hashes alone
(no text or word goes with them), and only texts with candidates are read again to verify those.

Cases: a null or empty text has no words and no hits; rows that repeat a doc_id give one row for each
different text; repeated item rows count once; an empty benchmark hits nothing; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dendrovox.llm.common import ascii_lower, small_side, table
from dendrovox.plans.iterate import materialize, settle

WINDOW = 10
#: Windows of the benchmark that may be broadcast; more are joined by shuffling.
MAX_BROADCAST_WINDOWS = 500_000
# What stands between words once A-Z are lower case.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text) -> F.Column:
    """The words of a text; none for null."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP, -1), "")


def benchmark_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows: ``w_hash, w_words, w_items`` (sorted distinct item ids as strings)."""
    w = items.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(window))
    at = w.select("item", "w", size.alias("m"), F.explode(F.sequence(F.lit(1), F.size("w") - size + 1)).alias("i"))
    cut = at.select("item", F.slice("w", F.col("i"), F.col("m")).alias("w_words"))
    return (
        cut.groupBy("w_words")
        .agg(F.array_sort(F.collect_set("item")).alias("w_items"))
        .select(F.xxhash64(F.transform("w_words", lambda x: F.xxhash64(x))).alias("w_hash"), "w_words", "w_items")
    )


def _mark() -> F.Column:
    """Stands for a document in front of its windows."""
    return F.array(F.struct(F.lit(-1).alias("i"), F.lit(0).alias("m"), F.lit(None).cast("long").alias("hash")))


def _rolling(sizes: list[int]) -> F.Column:
    """``i, m, hash`` of all windows of these sizes over the word hashes ``h``, of which there are ``n``."""

    def some(m: int) -> F.Column:
        def at(i):
            return F.struct(i.alias("i"), F.lit(m).alias("m"), F.xxhash64(F.array(*[F.get(F.col("h"), i + k) for k in range(m)])).alias("hash"))

        return F.when(F.col("n") >= m, F.transform(F.sequence(F.lit(0), F.col("n") - m), at)).otherwise(F.slice(_mark(), 1, 0))

    return F.concat(*map(some, sizes)) if sizes else F.slice(_mark(), 1, 0)


def _same(w, i, m, found) -> F.Column:
    return F.slice(w, i + 1, m) == found


def _sorted(spans, items) -> list[F.Column]:
    return [F.array_sort(F.array_distinct(spans)).alias("spans"), F.array_sort(F.array_distinct(F.flatten(items))).alias("items")]


def find_hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_broadcast: int = MAX_BROADCAST_WINDOWS) -> DataFrame:
    """Per document: ``doc_id, n_words, spans`` (first word, length; sorted) and ``items`` (sorted ids).

    ``docs`` has ``doc_id, text``; ``items`` has ``item_id, text``.
    """
    known = materialize(benchmark_windows(items, window), "windows")
    sizes = [r[0] for r in known.select(F.size("w_words")).distinct().collect()]  # at most ``window`` numbers
    d = docs.select("doc_id", F.xxhash64("text").alias("t"), words(F.col("text")).alias("w"))
    d = d.select("doc_id", "t", "w", F.size("w").alias("n"), F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    if known.limit(max_broadcast + 1).count() > max_broadcast:
        return _find_by_shuffle(docs, d, known, sizes)
    each = d.select("doc_id", "t", "n", "w", F.explode(F.concat(_mark(), _rolling(sizes))).alias("p"))
    each = each.select("doc_id", "t", "n", "w", "p.i", "p.m", "p.hash")
    # the words are compared after the join: as a join key they would be cut out for every window
    same = F.when(F.col("w_hash").isNotNull(), _same(F.col("w"), F.col("i"), F.col("m"), F.col("w_words")))
    hit = each.join(F.broadcast(known), F.col("hash") == F.col("w_hash"), "left").where((F.col("i") < 0) | same)
    hit = hit.select("doc_id", "t", "n", F.when(F.col("i") >= 0, F.struct("i", "m")).alias("s"), "w_items")
    return hit.groupBy("doc_id", "t").agg(F.max("n").alias("n_words"), *_sorted(F.collect_list("s"), F.collect_set("w_items"))).drop("t")


def _find_by_shuffle(docs: DataFrame, d: DataFrame, known: DataFrame, sizes: list[int]) -> DataFrame:
    probes = d.select("doc_id", "t", F.explode(_rolling(sizes)).alias("p")).select("doc_id", "t", "p.*")
    met = probes.join(known.select("w_hash"), F.col("hash") == F.col("w_hash"), "left_semi")
    held = met.distinct().join(known, F.col("hash") == F.col("w_hash")).groupBy("doc_id", "t").agg(F.collect_list(F.struct("i", "m", "w_words", "w_items")).alias("met"))
    held = materialize(held.select(F.col("doc_id").alias("held_id"), F.col("t").alias("held_t"), "met"), "met")
    one = docs.select("doc_id", "text", F.xxhash64("text").alias("t")).groupBy("doc_id", "t").agg(F.first("text").alias("text"))
    both = one.join(held, F.col("doc_id").eqNullSafe(F.col("held_id")) & (F.col("t") == F.col("held_t")), "left").select("doc_id", words(F.col("text")).alias("w"), "met")
    hits = F.filter("met", lambda c: _same(F.col("w"), c["i"], c["m"], c["w_words"]))
    both = both.select("doc_id", F.size("w").alias("n_words"), F.when(F.col("met").isNull(), F.array().cast(held.schema["met"].dataType)).otherwise(hits).alias("hits"))
    return both.select("doc_id", "n_words", *_sorted(F.transform("hits", lambda c: F.struct(c["i"].alias("i"), c["m"].alias("m"))), F.transform("hits", lambda c: c["w_items"])))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the documents in which any window of the benchmark occurs; all columns stay."""
    bad = settle(lambda: find_hits(docs, items, window).where(F.size("spans") > 0).select("doc_id").distinct(), "bad")
    return docs.join(small_side(bad), "doc_id", "left_anti").select(docs.columns)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach"))
    covered = F.aggregate(
        "spans",
        start,
        lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["i"] + s["m"] - F.greatest(a["reach"], s["i"]))).alias("n"), F.greatest(a["reach"], s["i"] + s["m"]).alias("reach")),
        lambda a: a["n"],
    ).cast("long")
    return found.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        covered.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (covered > 0).alias("contaminated"),
    )


ORACLE_OP2 = r"""
with i as (
  select distinct cast(item_id as varchar) as item, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w
  from benchmark where text is not null),
w as (
  select item, w[k:k + least(len(w), 10) - 1] as win, least(len(w), 10) as m
  from (select item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as k from i where len(w) > 0)),
d as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w
  from documents),
p as (select doc_id, w, m, unnest(range(1, greatest(len(w) - m + 1, 0) + 1)) as k from d, (select distinct m from w)),
h as (select p.doc_id, p.k, p.m, w.item from (select doc_id, k, m, w[k:k + m - 1] as win from p) p join w on p.m = w.m and p.win = w.win),
c as (select doc_id, count(distinct j) as n_hit from (select doc_id, unnest(range(k, k + m)) as j from h) group by doc_id),
t as (select doc_id, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as items from h group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(c.n_hit, 0) as bigint) as n_hit,
  cast(coalesce(t.n_items, 0) as bigint) as n_items, sha256(coalesce(t.items, '')) as items_sha256,
  coalesce(c.n_hit, 0) > 0 as contaminated
from d left join c using (doc_id) left join t using (doc_id)
"""
