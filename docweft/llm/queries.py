"""Queries of the training-data operators, and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.llm.markup import clean_markup
from docweft.llm.mixing import mix_sources
from docweft.llm.packing import pack_documents
from docweft.llm.pages import shared_lines
from docweft.llm.repetition import repetition_profile, repetitive_documents
from docweft.llm.splitting import split_oversized
from docweft.operators.runtime import join_dim
from docweft.sources.tables import Tables


def p2_pieces(spark: SparkSession, path: str) -> DataFrame:
    t = Tables(spark, path)
    return split_oversized(t.sections, t.limit("section_char_limit"), t.limit("piece_overlap_chars")).withColumnRenamed("id", "section_id")


def p2_found(spark: SparkSession, path: str) -> DataFrame:
    return p2_pieces(spark, path).filter("piece_no = 1").select("section_id")


def p2_rebuilt(spark: SparkSession, path: str) -> DataFrame:
    """What the pieces of each text give when they are put together again without their overlaps."""
    limit = Tables(spark, path).limit("section_char_limit")
    each = p2_pieces(spark, path).select("section_id", "piece_no", "start", (F.col("end") - F.col("start") <= limit).alias("within"), F.substring("piece", F.col("overlap") + 1, F.length("piece")).alias("fresh"))
    whole = each.groupBy("section_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_no", "fresh"))), lambda x: x["fresh"]), "").alias("text"), F.bool_and("within").alias("within"))
    return whole.select("section_id", F.md5("text").alias("digest"), F.length("text").cast("bigint").alias("n_chars"), F.col("within").cast("int").alias("within"))


def p3_shared(spark: SparkSession, path: str) -> DataFrame:
    """Page differencing: the lines each section shares with the nearest section before it, by address, in its delivery."""
    t = Tables(spark, path)
    base = t.snapshots.join(t.specs.select(F.col("id").alias("spec_id"), "base_url"), "spec_id").select(F.col("id").alias("snapshot_id"), "base_url").groupBy("snapshot_id").agg(F.min("base_url").alias("base_url"))
    pages = join_dim(t.sections.select("id", "snapshot_id", "anchor", "content_text", "ord"), base, "snapshot_id")
    host = F.concat_ws(" ", F.parse_url("base_url", F.lit("HOST")), "snapshot_id")
    return shared_lines(pages, "id", host, F.concat(F.parse_url("base_url", F.lit("PATH")), F.lit("#"), "anchor"), "content_text", ["ord", "id"]).select(F.col("id").alias("section_id"), "n_lines", "n_shared")


def p3_plain(spark: SparkSession, path: str) -> DataFrame:
    """Cleaning on all fields of letters, digits, blanks and plain stops: such text must come out as it went in."""
    plain = Tables(spark, path).sections.withColumns({c: F.when(F.col(c).rlike(r"\A[A-Za-z0-9][A-Za-z0-9 ,.;:?()%/-]*\n?\z"), F.col(c)) for c in ("title", "content_text")})
    return clean_markup(plain, only_cases=False).select("section_id", "field", "clean_text", F.size("markup").alias("n_kinds"))


def p3_clean(spark: SparkSession, path: str) -> DataFrame:
    return clean_markup(Tables(spark, path).sections, only_cases=False)


def p3_found(spark: SparkSession, path: str) -> DataFrame:
    return clean_markup(Tables(spark, path).sections).select("section_id", "field")


def p8_sequences(spark: SparkSession, path: str) -> DataFrame:
    t = Tables(spark, path)
    return pack_documents(t.documents, t.limit("context_tokens"))


def _counts(df: DataFrame, *names: str) -> DataFrame:
    """One row of counts as rows of (what, n)."""
    return df.select(F.inline(F.array(*[F.struct(F.lit(n).alias("what"), F.coalesce(F.col(n).cast("bigint"), F.lit(0)).alias("n")) for n in names])))


def p8_checks(spark: SparkSession, path: str) -> DataFrame:
    """What must hold of the sequences, as counts: whole documents, no sequence too full, no copies together."""
    t = Tables(spark, path)
    most = t.limit("context_tokens")
    packed = p8_sequences(spark, path)
    docs = packed.groupBy("doc_id").agg(F.count("*").alias("k"), F.max("piece_no").alias("last"), F.sum("n_tokens").alias("n"), F.max(F.col("first_token") + F.col("n_tokens")).alias("end"), F.count_if(F.col("bin_id").isNull() & (F.col("n_tokens") > 0)).alias("lost"))
    per_doc = docs.agg(F.count("*").alias("documents"), F.count_if((F.col("k") != F.col("last")) | (F.col("n") != F.col("end")) | (F.col("lost") > 0)).alias("broken"), F.count_if((F.col("k") > 1) & (F.col("n") <= most)).alias("cut_though_short"))
    bins = packed.filter("bin_id is not null").groupBy("bin_id").agg(F.sum("n_tokens").alias("n"), F.max("bin_tokens").alias("said"), F.count("cluster").alias("k"), F.count_distinct("cluster").alias("c"))
    per_bin = bins.agg(F.count_if(F.col("n") > most).alias("too_full"), F.count_if(F.col("n") != F.col("said")).alias("wrong_sum"), F.count_if(F.col("k") != F.col("c")).alias("copies_together"))
    return _counts(per_doc, "documents", "broken", "cut_though_short").unionByName(_counts(per_bin, "too_full", "wrong_sum", "copies_together"))


def p9_checks(spark: SparkSession, path: str) -> DataFrame:
    """Per source: its documents, the repeats it may have, and whether these and its share are kept: to half a point, or, as
    documents are drawn whole, to the size of its greatest document where that is more (as in the smallest tables)."""
    t = Tables(spark, path)
    draws, report = mix_sources(t.documents, t.mix_targets)
    used = draws.groupBy("source").agg(F.count("*").alias("n_documents"), F.max("repeats").alias("most"), F.max("n_tokens").alias("greatest"))
    whole = report.agg(F.sum("expected_tokens")).scalar()
    there = report.filter("source is not null and available_tokens > 0")
    goal = F.col("target_share") / there.agg(F.sum("target_share")).scalar()
    return there.join(used, "source").select("source", "n_documents", "max_repeats", (F.col("most") <= F.col("max_repeats")).cast("int").alias("repeats_kept"), (F.abs(F.col("expected_share") - goal) * whole < F.greatest(0.005 * whole, F.col("greatest"))).cast("int").alias("share_kept"))


def p9_draws(spark: SparkSession, path: str) -> DataFrame:
    t = Tables(spark, path)
    return mix_sources(t.documents, t.mix_targets)[0]


def p9_report(spark: SparkSession, path: str) -> DataFrame:
    t = Tables(spark, path)
    return mix_sources(t.documents, t.mix_targets)[1]


def p10_found(spark: SparkSession, path: str) -> DataFrame:
    return repetitive_documents(Tables(spark, path).documents).select("doc_id")


def p10_profile(spark: SparkSession, path: str) -> DataFrame:
    return repetition_profile(Tables(spark, path).documents)


QUERIES = {f.__name__: f for f in (p2_found, p2_pieces, p2_rebuilt, p3_found, p3_clean, p3_plain, p3_shared, p8_sequences, p8_checks, p9_draws, p9_report, p9_checks, p10_found, p10_profile)}

#: Words of documents with their places, and the first place of each run of eight: what p10 asks for, word by word.
_WORDS = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM documents WHERE text IS NOT NULL),
runs AS (SELECT doc_id, unnest(range(1, len(ws) - 6)) AS i, ws FROM w),
keyed AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 7], ' ')) AS k FROM runs),
again AS (SELECT doc_id, i FROM (SELECT *, min(i) OVER (PARTITION BY doc_id, k) AS f FROM keyed) WHERE i > f),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM again) GROUP BY 1)
"""

SQL = {
    "p2_found": "SELECT id AS section_id FROM sections WHERE length(content_text) > (SELECT amount FROM run_limits WHERE name = 'section_char_limit')",
    "p2_rebuilt": "SELECT id AS section_id, md5(content_text) AS digest, length(content_text) AS n_chars, 1 AS within FROM sections WHERE length(content_text) > (SELECT amount FROM run_limits WHERE name = 'section_char_limit')",
    "p3_plain": " UNION ALL ".join(
        f"SELECT id AS section_id, '{c}' AS field, rtrim({c}, E'\\n') AS clean_text, 0 AS n_kinds FROM sections WHERE regexp_full_match({c}, '[A-Za-z0-9][A-Za-z0-9 ,.;:?()%/-]*\\n?')" for c in ("title", "content_text")
    ),
    "p8_checks": "SELECT * FROM (SELECT 'documents' AS what, count(DISTINCT doc_id) AS n FROM documents) UNION ALL SELECT unnest(['broken', 'cut_though_short', 'too_full', 'wrong_sum', 'copies_together']), 0",
    "p9_checks": r"""
SELECT lower(trim(d.source, E' \t\r\n')) AS source, count(*) AS n_documents, any_value(max_repeats) AS max_repeats, 1 AS repeats_kept, 1 AS share_kept
FROM documents d JOIN mix_targets t ON lower(trim(d.source, E' \t\r\n')) = lower(trim(t.source)) GROUP BY 1 HAVING sum(length(text)) > 0""",
    "p10_found": _WORDS + "SELECT doc_id FROM w JOIN hit USING (doc_id) WHERE len(ws) >= 16 AND 3 * n >= len(ws)",
}
