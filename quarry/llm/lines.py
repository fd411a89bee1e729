"""Boilerplate removal: lines that spread over many sites stay in one document only.

Native: only DataFrame functions. Each line's sites go into a HyperLogLog sketch by the
line's hash; sketches merge in the aggregation, on both sides of the shuffle, so a line
that is in every document costs one row from each task. Where an estimate is near the
threshold, sites are counted exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quarry.llm.common import Scratch, shield
from quarry.llm.quality import NOT_SPACE

#: Lines on at least so many sites are boilerplate.
MIN_SITES = 10
#: log2 of a sketch's registers; its standard error is 1.04 / 2**(LG / 2).
LG = 10
#: Estimates within this share of the threshold are counted exactly: more than six standard errors.
NEAR = 0.2
#: Up to so many boilerplate lines (24 bytes each) are broadcast: all, or those that are found most often.
BROADCAST_LINES = 200_000


def line_hash(line: Column) -> Column:
    """Hash of a line without white space at its ends.

    Two lines share one of 2**64 values with a chance too small to matter: a false
    merge counts only if the two together reach the threshold.
    """
    return F.xxhash64(F.regexp_replace(line, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""))


def _lines(docs: DataFrame, text: Column, *columns: str) -> DataFrame:
    """A row for each line with a word: its hash and ``columns`` of its document."""
    each = docs.select(*columns, F.explode(F.split(text, "\n", -1)).alias("_line"))
    return each.filter(F.col("_line").rlike(NOT_SPACE)).select(*columns, line_hash(F.col("_line")).alias("_h"))


def _few(df: DataFrame, most: int) -> bool:
    return df.limit(most + 1).count() <= most


def _met(lines: DataFrame, some: DataFrame, how: str = "inner") -> DataFrame:
    """``lines`` joined with ``some`` (_h, _n, ...), where _n is how often the line _h is found.

    Lines that are at least one in BROADCAST_LINES of those found, no more than so many, are broadcast. The
    others are shuffled, and none of them outweighs a task.
    """
    if _few(some, BROADCAST_LINES):
        return lines.join(F.broadcast(some.drop("_n")), "_h", how)
    found = some.agg(F.sum("_n")).first()[0]
    often = F.col("_n") * BROADCAST_LINES >= found
    most, rest = some.filter(often).drop("_n"), some.filter(~often).drop("_n")
    other = lines.join(F.broadcast(most.select("_h")), "_h", "left_anti")
    return lines.join(F.broadcast(most), "_h", how).unionByName(other.join(rest, "_h", how))


def boilerplate(docs: DataFrame, scratch: Scratch, *, min_sites: int, text_col: str, site_col: str, id_col: str) -> DataFrame:
    """Hashes of boilerplate lines, how often each is found, and the smallest id of a document that has it."""
    text = F.col(text_col).cast("string")
    slim = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(site_col).cast("string"), F.lit("")).alias("_site"), text.alias("_text"))
    lines = _lines(slim, F.col("_text"), "_id", "_site")
    sketch = lines.groupBy("_h").agg(F.hll_sketch_agg("_site", F.lit(LG)).alias("sketch"), F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    spread = scratch.keep(sketch.select("_h", "_first", "_n", F.hll_sketch_estimate("sketch").alias("sites")).filter(F.col("sites") >= min_sites * (1 - NEAR)), "spread")
    sure, near = spread.filter(F.col("sites") > min_sites * (1 + NEAR)), spread.filter(F.col("sites") <= min_sites * (1 + NEAR))
    exact = _met(lines, near.select("_h", "_n"), "left_semi").select("_h", "_site").distinct().groupBy("_h").count().filter(F.col("count") >= min_sites)
    return scratch.keep(sure.select("_h", "_first", "_n").unionByName(near.join(exact, "_h", "left_semi").select("_h", "_first", "_n")), "boilerplate")


def dedup_lines(docs: DataFrame, *, min_sites: int = MIN_SITES, text_col: str = "text", site_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """``docs`` without lines that are found on ``min_sites`` sites or more.

    Such a line stays in the document with the smallest id that has it, with all its
    occurrences there. Lines without a word always stay. Adds n_lines (lines with a word)
    and n_removed; input columns of these names give way. Null text stays null and has no
    lines; null sites count as one site ''; a document with a null id never keeps
    boilerplate. Documents with one id are judged alike.
    """
    scratch = Scratch(docs.sparkSession)
    docs, back = shield(docs, text_col, site_col, id_col)
    boil = boilerplate(docs, scratch, min_sites=min_sites, text_col=text_col, site_col=site_col, id_col=id_col)
    own = docs.select(F.col(id_col).cast("long").alias("_key"), F.col(text_col).cast("string").alias("_text"))
    hits = _met(_lines(own, F.col("_text"), "_key"), boil).filter(~F.col("_key").eqNullSafe(F.col("_first")))
    gone = hits.groupBy("_key").agg(F.collect_set("_h").alias("_gone"))  # no more than the lines of one document
    rest = docs.drop("n_lines", "n_removed")
    joined = rest.join(gone, rest[id_col].cast("long").eqNullSafe(gone["_key"]), "left").drop("_key")
    lines = F.split(F.col(text_col).cast("string"), "\n", -1)
    stays = lambda x: ~x.rlike(NOT_SPACE) | ~F.array_contains(F.col("_gone"), line_hash(x))
    with_word = lambda c: F.size(F.filter(c, lambda x: x.rlike(NOT_SPACE)))
    cut = joined.withColumn("_kept", F.when(F.col("_gone").isNotNull(), F.filter(lines, stays)).otherwise(lines))
    n_lines, left = F.coalesce(with_word(lines), F.lit(0)).cast("long"), F.coalesce(with_word(F.col("_kept")), F.lit(0)).cast("long")
    texts = F.when(F.col("_gone").isNotNull(), F.array_join("_kept", "\n")).otherwise(F.col(text_col).cast("string"))
    return cut.withColumns({"n_lines": n_lines, "n_removed": n_lines - left, text_col: texts}).select(*[c for c in rest.columns], "n_lines", "n_removed").withColumnsRenamed(back)
