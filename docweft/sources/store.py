"""Writing tables so that later reads need no shuffle: buckets of specs, sorted inside, replaced spec by spec."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweft.operators.corpus import first_rows

#: Directories a table is spread over. A directory a spec would make far too many.
BUCKETS = 64


def bucket(spec: Column, buckets: int = BUCKETS) -> Column:
    """The directory a spec's rows lie in."""
    return F.pmod(F.xxhash64(spec), F.lit(buckets)).cast("int")


def with_ord(rows: DataFrame, items: str, by: list[str]) -> DataFrame:
    """One row per item of an array of structs, with ord, its place in it (from 0)."""
    return rows.select(*by, F.posexplode(items).alias("ord", "_item")).select(*by, "ord", "_item.*")


def _placed(rows: DataFrame, spec: str, order: list[str], buckets: int, files: int) -> DataFrame:
    # the salt splits a spec that holds a large part of all rows over several files of its bucket
    salt = F.pmod(F.xxhash64(*[c for c in order if c in rows.columns] or [spec]), F.lit(files))
    placed = rows.withColumn("spec_bucket", bucket(F.col(spec), buckets)).repartition(F.col("spec_bucket"), salt)
    return placed.sortWithinPartitions("spec_bucket", spec, *[F.col(c).asc_nulls_last() for c in order])


def write_table(rows: DataFrame, path: str, spec: str = "spec", keys: list[str] = (), order: list[str] = ("ord",), buckets: int = BUCKETS, files: int = 4) -> None:
    """Write a table by spec bucket, sorted by spec and order. Of rows with equal ``keys`` the first in order stands."""
    if keys:
        rows = first_rows(rows, list(keys), list(order))
    _placed(rows, spec, list(order), buckets, files).write.mode("overwrite").partitionBy("spec_bucket").parquet(path)


def replace_specs(rows: DataFrame, specs: DataFrame, path: str, spec: str = "spec", order: list[str] = ("ord",), buckets: int = BUCKETS, files: int = 4) -> None:
    """Replace all rows of some specs (delete and insert): only their buckets are read and written.

    ``specs`` holds the specs to replace; one without rows loses its rows. The new buckets are first written whole beside
    the table, then moved in by a dynamic partition overwrite: a job that fails while they are worked out leaves the table
    as it was, and one that fails later can be run again.
    """
    spark = rows.sparkSession
    gone = specs.select(spec).distinct()
    touched = [r[0] for r in gone.select(bucket(F.col(spec), buckets).alias("b")).distinct().collect()]  # at most `buckets` numbers
    if not touched:
        return
    old = spark.read.parquet(path).filter(F.col("spec_bucket").isin(touched)).drop("spec_bucket")
    new = old.join(gone, spec, "left_anti").select(*old.columns).unionByName(rows.join(gone, spec, "left_semi").select(*old.columns))
    staged = path.rstrip("/") + ".staged"
    _placed(new, spec, list(order), buckets, files).write.mode("overwrite").parquet(staged)
    ready = spark.read.parquet(staged)
    left = {r[0] for r in ready.select("spec_bucket").distinct().collect()}
    ready.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("spec_bucket").parquet(path)
    fs = spark._jvm.org.apache.hadoop.fs
    files_of = fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for b in set(touched) - left:  # nothing is left in these
        files_of.delete(fs.Path(path, f"spec_bucket={b}"), True)
    files_of.delete(fs.Path(staged), True)


def read_specs(spark, path: str, names: list[str], spec: str = "spec", buckets: int = BUCKETS) -> DataFrame:
    """The rows of some specs; only their buckets are read (partition pruning), and the sort lets row groups be skipped."""
    wanted = [r[0] for r in spark.createDataFrame([(n,) for n in names], f"{spec} string").select(bucket(F.col(spec), buckets)).distinct().collect()]
    return spark.read.parquet(path).filter(F.col("spec_bucket").isin(wanted) & F.col(spec).isin(names)).drop("spec_bucket")
