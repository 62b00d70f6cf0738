"""Cross-site boilerplate: lines that many distinct sites carry go, except where they stand first.

Every line hash gets a HyperLogLog sketch of its sites; sketches are built on the map side and merged by the aggregation,
so a line in a third of all documents costs one small sketch per task. Lines whose estimate is clearly beyond or below
the threshold are decided by it; lines near the threshold get exact distinct counts. All of it is DataFrame code.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetweave.llm.columns import let

MIN_SITES = 10
LG_K = 12  # 4096 registers: a standard error of 1.6 per cent
BAND = 0.1  # estimates within this share of the threshold, and within one of it, are counted exactly


def _line_key(line: Column) -> Column:
    """96 bits of a line without its outer blanks."""
    plain = F.trim(line)
    return F.struct(F.xxhash64(plain).alias("a"), F.hash(plain).alias("b"))


def _occurrences(docs: DataFrame) -> DataFrame:
    """One row per line that is not blank: the document's key, the line's position and key, the site."""
    lines = docs.select("_id", "_digest", "_site", F.posexplode(F.split("_text", "\n")).alias("_pos", "_line"))
    return lines.where(F.trim("_line") != "").select("_id", "_digest", "_site", "_pos", _line_key(F.col("_line")).alias("_key"))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(_key, _first): lines on at least ``min_sites`` distinct sites, and the place where each stands first."""
    place = F.struct(F.col("_id").isNull().alias("null"), "_id", "_digest", "_pos")
    sketched = (lines.groupBy("_key").agg(F.hll_sketch_agg("_site", F.lit(LG_K)).alias("_sketch"), F.min(place).alias("_first"))
                .select("_key", "_first", F.hll_sketch_estimate("_sketch").alias("_sites")))
    slack = max(1.0, BAND * min_sites)
    sketched = sketched.where(F.col("_sites") >= min_sites - slack)
    clear = F.col("_sites") > min_sites + slack
    near = sketched.where(~clear)
    counted = (lines.join(near.select("_key"), "_key", "left_semi").where("_site is not null")
               .select("_key", "_site").distinct().groupBy("_key").agg(F.count("*").alias("_exact"))
               .where(F.col("_exact") >= min_sites).select("_key"))
    exact = near.join(counted, "_key", "left_semi")
    return sketched.where(clear).unionByName(exact).select("_key", "_first")


def _without(lines: Column, gone: Column) -> Column:
    """The lines between the ascending positions ``gone``, in time linear in both."""
    start = lambda k: F.when(k == 0, 0).otherwise(F.get(gone, k - 1) + 1)
    return let(lines, lambda lines: F.flatten(F.transform(
        F.sequence(F.lit(0), F.size(gone)),
        lambda k: F.slice(lines, start(k) + 1, F.when(k == F.size(gone), F.size(lines)).otherwise(F.get(gone, k)) - start(k)))))


def without_boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source",
                        min_sites: int = MIN_SITES) -> DataFrame:
    """The input with its text cleaned, and two more columns: ``n_lines`` and ``n_removed``.

    Lines are cut at newlines and compared without outer blanks; blank lines are never removed. A line on ``min_sites``
    or more distinct sites stays only where it stands first by (id, text, position), null ids last; rows equal in id and
    text are treated alike. A null site is no site. A null text stays null and has 0 lines; an empty one has one empty
    line. Other columns pass through, whatever their names; inner names start with an underscore and two such names of
    the input, ``n_lines`` and ``n_removed``, are replaced.
    """
    keys = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_digest"), F.col(text_col).alias("_text"),
                       F.col(site_col).cast("string").alias("_site"))
    lines = _occurrences(keys)
    bad = boilerplate(lines, min_sites)
    here = F.struct(F.col("_id").isNull().alias("null"), "_id", "_digest", "_pos")
    gone = (lines.join(bad, "_key").where(here != F.col("_first"))
            .groupBy("_id", "_digest").agg(F.sort_array(F.collect_set("_pos")).alias("_gone")))
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col(id_col).alias("_rid"),
                        F.xxhash64(text_col).alias("_rdigest"))
    joined = whole.join(gone, F.col("_rid").eqNullSafe(F.col("_id")) & (F.col("_rdigest") == F.col("_digest")), "left")
    text, cut = F.col(f"_row.`{text_col}`"), F.split(F.col(f"_row.`{text_col}`"), "\n")
    cleaned = F.when(F.col("_gone").isNull(), text).otherwise(F.array_join(_without(cut, F.col("_gone")), "\n"))
    return joined.select(*[(cleaned if c == text_col else F.col(f"_row.`{c}`")).alias(c) for c in names],
                         F.when(text.isNull(), 0).otherwise(F.size(cut)).cast("long").alias("n_lines"),
                         F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_removed"))
