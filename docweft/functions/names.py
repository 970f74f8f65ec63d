"""Names of documents of two publishers with rules of their own, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweft.operators.runtime import cut


def is_ietf(name: Column) -> Column:
    """``rfc`` and a digit, or ``draft-``, in any case."""
    return F.lower(name).rlike(r"^(?:rfc[0-9]|draft-)")


def canonical_ietf(name: Column) -> Column:
    """``RFC`` and the number without leading zeros; drafts without their two-digit revision."""
    number = F.regexp_extract(F.lower(name), r"^rfc0*([0-9]+)$", 1)
    return F.when(number != "", F.concat(F.lit("RFC"), number)).when(F.lower(name).startswith("rfc"), F.upper(name)).otherwise(F.regexp_replace(name, r"-[0-9]{2}$", ""))


def pinned_revision(name: Column) -> Column:
    """The two-digit revision a draft is pinned to; null for the latest and for anything else."""
    return F.when(~F.lower(name).startswith("rfc"), F.nullif(F.regexp_extract(name, r"-([0-9]{2})$", 1), F.lit("")))


def latest_of(chain: DataFrame, names: DataFrame) -> DataFrame:
    """The document that each name leads to by following obsoleted-by: name, latest, hops, loops (true on a circle; then
    latest is the name itself).

    chain: name, obsoleted_by (null at the end; of several the least counts); names: name. By pointer doubling: as many
    rounds as the logarithm of the longest chain, which is one join each.
    """
    step = chain.filter("name is not null and obsoleted_by is not null").groupBy("name").agg(F.min("obsoleted_by").alias("to"))
    wanted = names.select("name").filter("name is not null").distinct()
    every = wanted.unionByName(step.select("name")).unionByName(step.select(F.col("to").alias("name"))).distinct()
    last = F.col("to").isNull()
    at = cut(every.join(step, "name", "left").select("name", "to", F.when(last, 0).otherwise(1).cast("bigint").alias("hops"), F.when(last, F.col("name")).alias("end")))
    left = None
    while (n := at.filter("to is not null").count()) and n != left:
        left = n
        on = at.select(F.col("name").alias("to"), F.col("to").alias("_to"), F.col("hops").alias("_hops"), F.col("end").alias("_end"))
        at = cut(at.join(on, "to", "left").select("name", F.col("_to").alias("to"), (F.col("hops") + F.coalesce("_hops", F.lit(0))).alias("hops"), F.coalesce("end", "_end").alias("end")), bare=True)
    return wanted.join(at, "name").select("name", F.coalesce("end", "name").alias("latest"), F.when(F.col("end").isNotNull(), F.col("hops")).alias("hops"), F.col("end").isNull().alias("loops"))


def is_itu(name: Column) -> Column:
    """A letter, a dot and groups of digits: ``G.711``, ``h.265.1``."""
    return name.rlike(r"^[A-Za-z]\.[0-9]+(?:\.[0-9]+)*$")


def canonical_itu(name: Column) -> Column:
    """The same with its letter in upper case."""
    return F.concat(F.upper(F.substring(name, 1, 1)), F.substring(name, 2, 2**30))
