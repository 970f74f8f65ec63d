"""How operators use the cluster: lineage cuts, dimension joins, direct partition placement."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A dimension of at most this many rows and bytes is broadcast; beyond either the join shuffles and AQE splits skewed keys.
BROADCAST_ROWS = 400_000
BROADCAST_BYTES = 64 << 20
#: Checkpoints whose tables are no longer used are deleted.
_CLEAN = "spark.cleaner.referenceTracking.cleanCheckpoints"


class NoCheckpointFolder(RuntimeError):
    """A cluster without a shared folder for lineage cuts."""


def _folder(spark: SparkSession) -> str:
    """The checkpoint folder the session names; one of this machine's own only where all of Spark runs in this process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        return tempfile.mkdtemp(prefix="docweft-")
    raise NoCheckpointFolder("set spark.checkpoint.dir to a folder that all executors share")


def cut(df: DataFrame, bare: bool = False) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the folder the cluster names in spark.checkpoint.dir.

    Without one, a cluster is refused (NoCheckpointFolder). Files go when the last table that reads them does. A
    checkpoint keeps what the optimizer inferred about its rows; where a loop joins a table with itself, that doubles
    each round, so such loops ask for a ``bare`` one without it.
    """
    sc = df.sparkSession.sparkContext
    jvm = sc._jsc.sc()
    if not jvm.getCheckpointDir().isDefined():
        sc.setCheckpointDir(_folder(df.sparkSession))
    if not jvm.conf().contains(_CLEAN):
        jvm.conf().set(_CLEAN, "true")
    kept = df.checkpoint(eager=True)
    if not bare:
        return kept
    spark = df.sparkSession
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(kept._jdf.queryExecution().toRdd(), kept._jdf.schema(), False), spark)


def union(parts: list[DataFrame], most: int = 16) -> DataFrame:
    """The rows of all parts of a growing table. Only new parts are ever written; when there are more than ``most``, the
    list is compacted in place into one, so plans stay small in loops of any length."""
    if len(parts) > most:
        whole = parts[0]
        for p in parts[1:]:
            whole = whole.unionByName(p)
        parts[:] = [cut(whole, bare=True)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def bounded(dim: DataFrame, rows: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> tuple[DataFrame, bool]:
    """The dimension and whether it is small enough to broadcast: at most ``rows`` rows, by a count that stops at the
    bound, which hold at most ``most_bytes`` characters and numbers as JSON."""
    width = F.length(F.to_json(F.struct("*"))) if dim.columns else F.lit(0)
    n, size = dim.select(width.alias("w")).limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum("w"), F.lit(0))).first()
    return dim, n <= rows and size <= most_bytes


def join_dim(fact: DataFrame, dim: DataFrame, on: str, how: str = "inner", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join a fact table with a dimension.

    Up to ``rows`` rows and BROADCAST_BYTES (both checked by one pass) the dimension is broadcast. A larger one is joined
    by a shuffle on the key, where AQE's skew join splits hot keys.
    """
    dim, small = bounded(dim, rows)
    return fact.join(F.broadcast(dim) if small else dim, on, how)


def partitions(spark: SparkSession, rows: int, per_task: int) -> int:
    """Tasks for so many rows, never fewer than the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_task))


def place(df: DataFrame, n: int, part: str | Column) -> DataFrame:
    """Send each row to the partition whose number stands in ``part`` (0 to n - 1)."""
    return df.repartitionById(n, F.col(part) if isinstance(part, str) else part)


#: Rows of a table's key space are counted in this many equal ranges of the key's 64-bit hash.
FINE_BITS = 12


def fine_range(h: Column) -> Column:
    """The range, 0 to 2**FINE_BITS - 1, of a signed 64-bit hash, in ascending order of the hash."""
    return (F.shiftright(h, 64 - FINE_BITS) + F.lit(2 ** (FINE_BITS - 1))).cast("int")


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores, for work in Python on few input splits; input with a split a core or more stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
