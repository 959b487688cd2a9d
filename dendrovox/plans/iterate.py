"""Durable intermediate tables and fix-point loops.

Every loop here cuts its lineage by writing a Parquet table below the folder that the cluster
names in ``spark.checkpoint.dir``, so a lost executor costs a re-read and never a re-computation
of earlier rounds.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A loop that has not settled after so many rounds raises; it never returns a partial answer.
MAX_ROUNDS = 100

#: By application: the folder chosen where the cluster names none.
_own: dict[str, str] = {}
#: Tables that ``materialize`` made and nothing has deleted yet.
_made: list[DataFrame] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir`` where it is set.

    Unset on a local master (tests): a temporary folder. Unset on a cluster: below the warehouse.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or _own.get(spark.sparkContext.applicationId)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.startswith("local["):
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
    else:
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_intermediate"
    _own[spark.sparkContext.applicationId] = found
    return found


def new_path(spark: SparkSession, name: str = "table") -> str:
    """A path that nothing has used yet, below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "table", partitions: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    path = new_path(df.sparkSession, name)
    (df if partitions is None else df.coalesce(partitions)).write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._kept_at = path
    _made.append(out)
    return out


def apart(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join of two tables that both grow: the join shuffles.

    Spark takes a Parquet file's size for that of its table, but sorted keys and small counts grow a hundredfold in memory; so it would
    broadcast tables of many million rows.
    """
    return df.hint("merge")


def settle(make: Callable[[], DataFrame], name: str = "table") -> DataFrame:
    """``materialize`` what ``make`` returns, and delete the tables that were written on the way to it."""
    before = {id(x) for x in _made}
    out = materialize(make(), name)
    for df in [x for x in _made if x is not out and id(x) not in before]:
        release(df)
    return out


def kept(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` as a written table, for steps that read it many times: each reading would derive it anew."""
    return df if any(x is df for x in _made) else materialize(df, name)


def release(df: DataFrame) -> None:
    """Delete the files of a table that ``materialize`` made; no later plan may read it."""
    jvm, path = df.sparkSession._jvm, getattr(df, "_kept_at", None)
    _made[:] = [x for x in _made if x is not df]
    if path:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


class Versions:
    """A table of which a loop changes some keys a round: a round writes those alone, and the newest version of a key counts.

    Versions of like size are merged, so a row is written again a logarithmic number of times, and a large
    version is not written for the sake of a small one.
    """

    def __init__(self, keys, name: str = "version"):
        self.keys, self.name, self.parts, self.count = list(keys), name, [], 0

    def put(self, rows: DataFrame) -> DataFrame:
        """Write the changed keys' rows, all of each key; returns what was written."""
        self.count += 1
        part = materialize(rows.withColumn("_version", F.lit(self.count)), self.name)
        self.parts.append((part, part.count()))
        return part.drop("_version")

    def _newest(self, rows: DataFrame) -> DataFrame:
        latest = rows.groupBy(*self.keys).agg(F.max("_version").alias("_version"))
        return rows.join(latest, [*self.keys, "_version"], "left_semi")

    def now(self, among: DataFrame | None = None) -> DataFrame:
        """The table as it is; only the keys ``among``, if given. What ``put`` returned before may not be read any more."""
        while len(self.parts) > 1 and 2 * self.parts[-1][1] >= self.parts[-2][1]:
            (old, _), (new, _) = self.parts[-2:]
            both = materialize(self._newest(old.unionByName(new)), self.name)
            self.parts[-2:] = [(both, both.count())]
            release(old)
            release(new)
        rows = self.parts[0][0]
        for part, _ in self.parts[1:]:
            rows = rows.unionByName(part)
        if among is not None:
            rows = rows.join(among, self.keys, "left_semi")
        return (rows if len(self.parts) == 1 else self._newest(rows)).drop("_version")


class Log:
    """A table that a loop appends to, a folder a round; it is read as one."""

    def __init__(self, spark: SparkSession, name: str = "log"):
        self.spark, self.path, self.rounds, self.schema = spark, new_path(spark, name), 0, None

    def append(self, rows: DataFrame) -> DataFrame:
        """Write the rows; returns what was written."""
        at = f"{self.path}/round={self.rounds}"
        rows.write.parquet(at)
        self.rounds, self.schema = self.rounds + 1, rows.schema
        return self.spark.read.schema(rows.schema).parquet(at)

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Components of an undirected graph given as pairs of longs.

    Returns ``node, component`` for every node that has an edge; ``component`` is the smallest node
    reachable. Alternates large-star and small-star contraction (Kiveris et al. 2014), which
    takes a logarithmic number of rounds whatever the diameter. Each round aggregates with a map-side
    combine and joins one row per node, so a hub's edges can be split by AQE.
    """
    now = materialize(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct(),
        "edges",
    )
    seen = _digest(now)
    for _ in range(MAX_ROUNDS):
        if seen[0] == 0:
            break
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(apart(low), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(apart(least), "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u > v").distinct()
        after = materialize(small, "edges")
        release(now)
        now, before, seen = after, seen, _digest(after)
        if seen == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % (1 << 31)), F.sum(F.xxhash64("v", "u") % (1 << 31))).first())
