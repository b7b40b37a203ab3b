"""Licence scan by canonical digests.

A text is brought into canonical form: lower case, lines that state a copyright removed,
equivalent spellings unified, and everything but letters and digits turned into single spaces.
The SHA-256 of the whole canonical text, and of every line of it on its own, is joined by hash
with the digests of known licences: a document that is a licence is found whatever its layout,
case, punctuation or holder, and so is a one-line licence notice inside other text.

Only DataFrame functions are used. The known digests are a literal table of some hundred rows,
so that side is broadcast; licence tables of any size may be passed and then Spark decides.

Defined results: null and empty texts, and those that become empty, match nothing; rows are
independent of each other, rows that repeat id and text each get the same result; rows without
id are kept. Extra columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwarden.llm.common import id_text
from gridwarden.llm.license_texts import KNOWN

# Equivalent spellings, the second form is used. Applied to lower-case words.
SPELLINGS = [
    ("licence", "license"),
    ("licenced", "licensed"),
    ("sublicence", "sublicense"),
    ("acknowledgement", "acknowledgment"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("behaviour", "behavior"),
    ("favour", "favor"),
    ("fulfil", "fulfill"),
    ("merchantibility", "merchantability"),
    ("non infringement", "noninfringement"),
    ("organisation", "organization"),
    ("recognised", "recognized"),
    ("whilst", "while"),
    ("https", "http"),
    ("v2 0", "version 2 0"),
    ("v3", "version 3"),
]
# A line that states a copyright: it begins with the word or the sign, or says all rights
# reserved. Lines that only mention copyright stay.
COPYRIGHT = r"^[^a-z0-9©]*(copyright +(\(c\)|©|[0-9])|\(c\) +|© *|all rights reserved)"
NO_WORD = r"[^a-z0-9\x{80}-\x{10FFFF}]+"


def canonical_lines(text: Column) -> Column:
    """The canonical form of every line that is no copyright line and not empty."""
    lines = F.split(F.lower(F.coalesce(text, F.lit(""))), r"\n")
    lines = F.filter(lines, lambda line: ~line.rlike(COPYRIGHT))
    lines = F.transform(lines, _canonical)
    return F.filter(lines, lambda line: line != "")


def _canonical(line: Column) -> Column:
    # Every word has a space of its own on both sides, so that neighbours can both be replaced.
    line = F.concat(F.lit(" "), F.regexp_replace(line, NO_WORD, "  "), F.lit(" "))
    for other, used in spaced(SPELLINGS):
        line = F.replace(line, F.lit(other), F.lit(used))
    return F.trim(F.replace(line, F.lit("  "), F.lit(" ")))


def spaced(pairs: list[tuple[str, str]]) -> list[tuple[str, str]]:
    return [tuple(f" {form} ".replace(" ", "  ")[1:-1] for form in pair) for pair in pairs]


def digest(canonical: Column) -> Column:
    return F.sha2(canonical, 256)


def known_digests(spark: SparkSession, known: DataFrame | None = None) -> DataFrame:
    """license, digest of every known text; texts given as (license, text)."""
    if known is None:
        known = F.broadcast(spark.createDataFrame(KNOWN, "license string, text string"))
    lines = known.select("license", F.array_join(canonical_lines(F.col("text")), " ").alias("text"))
    return lines.where("text <> ''").select("license", digest(F.col("text")).alias("digest")).distinct()


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: DataFrame | None = None
) -> DataFrame:
    """Every row: doc_id, digest of the canonical text, whole_license (of the whole text, or
    null), notices (licences named by single lines, sorted), n_notices (different
    such lines)."""
    spark = docs.sparkSession
    table = known_digests(spark, known)
    if known is None:
        table = F.broadcast(table)
    lines = id_text(docs, id_col, text_col).select(
        "doc_id", canonical_lines(F.col("text")).alias("lines")
    )
    marked = lines.select(
        "doc_id", digest(F.array_join("lines", " ")).alias("digest"), "lines",
        F.xxhash64("lines").alias("shape"),  # rows of one id and text may have other line breaks
    )
    whole = table.groupBy("digest").agg(F.min("license").alias("whole_license"))
    if known is None:
        whole = F.broadcast(whole)
    found = (
        marked.select("doc_id", "digest", "shape", F.explode("lines").alias("line"))
        .select("doc_id", F.col("digest").alias("of"), "shape", digest(F.col("line")).alias("digest"))
        .join(table, "digest")
        .groupBy("doc_id", "of", "shape")
        .agg(F.array_sort(F.collect_set("license")).alias("notices"), F.size(F.collect_set("digest")).alias("n"))
        .select(F.col("doc_id").alias("id"), "of", F.col("shape").alias("cut"), "notices", "n")
    )
    same = (
        F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("of")) & (F.col("shape") == F.col("cut"))
    )
    return (
        marked.select("doc_id", "digest", "shape")
        .join(whole, "digest", "left")
        .join(found, same, "left")
        .select(
            "doc_id", "digest", "whole_license",
            F.coalesce("notices", F.array().cast("array<string>")).alias("notices"),
            F.coalesce("n", F.lit(0)).alias("n_notices"),
        )
    )
