"""I-Match fingerprints: terms within a band of inverse document frequency, hashed for several randomised lexicons.

The lexicon holds the terms that between ``LOW`` and ``HIGH`` of all distinct texts contain. Their number is bounded by
the mean number of distinct terms of a text over ``LOW``, however large the corpus. Each of ``VIEWS`` views draws a chain
of ever sparser random halves of it: a term's byte of a digest says how far down the chain it stays. A text's signature
in a view hashes the sorted distinct terms of the sparsest member that it still meets, so long and short texts hash a few
terms each and an edit elsewhere leaves a signature alone. The fingerprint lists the signatures; likeness is the share of
equal ones. All of it is DataFrame code.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetweave.llm.columns import let, range_of
from fleetweave.llm.scratch import stored

LOW, HIGH = 0.001, 0.05  # shares of distinct texts; a term is in two of them at least
VIEWS = 16
DIGITS = 8  # hexadecimal digits of a signature
SPACE = r"[\x20\x09-\x0D]+"
BUCKET_ROWS, MOST_BUCKETS = 2000, 32_768  # beyond so many buckets they grow, and are sorted on disk
BOUND = 1_000_000  # lexicon terms that are sent to every task; more are met by a shuffle


def terms(text: Column) -> Column:
    """Distinct lower-cased words of a text."""
    return F.filter(F.array_distinct(F.split(F.lower(text), SPACE)), lambda w: w != "")


def _depth(term: Column, view: int) -> Column:
    """How far down the chain of a view a term stays: the number of binary digits of its byte of a digest."""
    byte = F.conv(F.substring(F.md5(term), 2 * view + 1, 2), 16, 2)  # without leading zeros
    return F.when(byte == "0", 0).otherwise(F.length(byte)).cast("long")


def _depths(term: Column) -> Column:
    """The depths of all views, four bits each."""
    packed = _depth(term, 0)
    for view in range(1, VIEWS):
        packed = packed.bitwiseOR(F.shiftleft(_depth(term, view), 4 * view))
    return packed


def lexicon(docs: DataFrame, texts: int, low: float = LOW, high: float = HIGH) -> DataFrame:
    """(term, depths): terms of the band among the ``texts`` distinct texts of ``docs(_key, _text)``, keyed by their content.

    The terms of a text travel as one string, once per task that holds copies of it.
    """
    least = max(2.0, low * texts)
    distinct = docs.select("_key", F.array_join(terms(F.col("_text")), " ").alias("_terms")).groupBy("_key").agg(F.first("_terms").alias("_terms"))
    counted = distinct.select(F.explode(F.split("_terms", " ")).alias("term")).where("term <> ''").groupBy("term").agg(F.count("*").alias("_texts"))
    return counted.where(F.col("_texts").between(least, max(least, high * texts))).select("term", _depths(F.col("term")).alias("depths"))


def _signatures(found: Column) -> Column:
    """One signature per view of an array of (term, depths) in term order."""
    def view(shift: Column) -> Column:
        depth = lambda x: F.call_function("shiftrightunsigned", x["depths"], shift).bitwiseAND(F.lit(15))
        return let(F.array_min(F.transform(found, depth)), lambda least: F.substring(F.md5(F.array_join(
            F.transform(F.filter(found, lambda x: depth(x) == least), lambda x: x["term"]), " ")), 1, DIGITS))

    return F.transform(F.sequence(F.lit(0), F.lit(4 * (VIEWS - 1)), F.lit(4)), view)


def _likeness(a: Column, b: Column) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / F.lit(VIEWS)


def _neighbours(docs: DataFrame, rows: int) -> DataFrame:
    """Rows with the next text in descending id order: (_bucket, _nth, _extra, _id, _text, _next).

    Ranges of ids are buckets; an id that fills a bucket has one of its own, and such a bucket, like that of null ids, is
    divided by ranges of the text's hash, which is the order inside. Each bucket also gets a copy of the row that follows
    its last one (``_extra``), so that the next row is always in the same task.
    """
    buckets = min(MOST_BUCKETS, max(1, rows // BUCKET_ROWS))
    marks = docs.agg(F.percentile_approx("_id", [k / buckets for k in range(1, buckets)] or [0.5], 10_000).alias("q")).first()["q"] or []
    alone = {m for m, following in zip(marks, marks[1:]) if m == following}
    marks = sorted({*marks, *(m + 1 for m in alone)})
    docs = docs.withColumn("_range", F.when(F.col("_id").isNull(), -1).otherwise(range_of(F.col("_id"), marks)))
    # one row per range
    sizes = docs.groupBy("_range").agg(F.count("*").alias("_rows"), (F.min("_id") < F.max("_id")).alias("_mixed"))
    parts = F.when(F.coalesce("_mixed", F.lit(False)), 1).otherwise(F.ceil(F.col("_rows") / BUCKET_ROWS)).cast("int")
    docs = docs.join(F.broadcast(sizes.select("_range", F.least(parts, F.lit(MOST_BUCKETS)).alias("_parts"))), "_range")
    part = F.floor((F.shiftrightunsigned("_digest", 32) * F.col("_parts")) / (1 << 32)).cast("int")  # ascending in the hash's upper half
    docs = docs.withColumn("_bucket", F.struct("_range", F.when(F.col("_parts") > 1, part).otherwise(0).alias("_part")))
    # one row per bucket: its first row, and the bucket before
    heads = docs.groupBy("_bucket").agg(F.max(F.struct("_id", "_order", "_digest")).alias("_head"))
    every, along = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), Window.orderBy("_bucket")
    heads = heads.select(F.col("_bucket").alias("_own"), F.col("_head._id").alias("_head_id"), F.col("_head._digest").alias("_head_digest"),
                         F.coalesce(F.lead("_bucket").over(along), F.first("_bucket").over(every)).alias("_before"))
    is_head = (F.col("_bucket") == F.col("_own")) & F.col("_id").eqNullSafe(F.col("_head_id")) & (F.col("_digest") == F.col("_head_digest"))
    copies = (docs.join(F.broadcast(heads), is_head).dropDuplicates(["_own"])
              .select("_id", "_order", "_text", F.col("_before").alias("_bucket"), F.lit(True).alias("_extra")))
    both = docs.select("_id", "_order", "_text", "_bucket", F.lit(False).alias("_extra")).unionByName(copies)
    order = Window.partitionBy("_bucket").orderBy("_extra", F.col("_id").desc_nulls_last(), F.col("_order").desc())
    return both.select("_bucket", F.row_number().over(order).alias("_nth"), "_extra", "_id", "_text", F.lead("_text").over(order).alias("_next"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", low: float = LOW,
                 high: float = HIGH, keep_text: bool = False) -> DataFrame:
    """One row per input row: (id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next).

    The edited text is the text with its last half (rounded down, in code points) replaced by the start of the next text
    in descending id order; after the last comes the first, and a single row follows itself. Null ids come last, equal ids
    in descending order of a text hash; a null text is empty. Document frequency counts distinct texts, so copies do not
    push terms out of the band; in small tables the band narrows to terms of two texts. A text that meets no term of the
    band is its own lexicon: all its terms count. One without terms has the hash of the whole text in every view. Repeated
    rows stay; other columns are not read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = docs.select(F.col(id_col).cast("long").alias("_id"), text.alias("_text"))
    keyed = docs.select(F.unhex(F.md5("_text")).alias("_key"), "_text")
    rows, texts = keyed.groupBy("_key").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    known = stored(lexicon(keyed, texts, low, high))
    known = F.broadcast(known) if known.count() <= BOUND else known

    digest = F.xxhash64("_text")
    # unsigned order of the hash, so that its ranges are those of its upper half
    docs = docs.select("_id", digest.alias("_digest"), digest.bitwiseXOR(F.lit(-1 << 63)).alias("_order"), "_text")
    half = F.floor(F.char_length("_text") / 2).cast("int")
    edited = F.concat(F.left("_text", F.char_length("_text") - half), F.left("_next", half))
    placed = _neighbours(docs, rows).withColumn("_edited", F.when(~F.col("_extra"), edited))

    def whole(column) -> Column:
        return F.substring(F.md5(column), 1, DIGITS)

    # all that a row needs later travels with one entry of its own, beside an entry per term; its key is no term
    def entries(both: Column) -> Column:
        meta = F.struct("_extra", "_id", F.char_length("_text").cast("long").alias("n_chars"),
                        (F.col("_edited") if keep_text else F.sha2("_edited", 256)).alias("_edited"), whole("_text").alias("_whole"),
                        whole(F.coalesce("_edited", F.lit(""))).alias("_edited_whole"), both["plain"].alias("_plain_terms"),
                        both["edited"].alias("_edited_terms"))
        nothing = F.when(F.lit(False), meta)
        entry = lambda kind, term, more: F.struct(F.lit(kind).alias("kind"), term.alias("term"), more.alias("meta"))
        key = F.concat(F.lit(" "), F.col("_bucket").cast("string"), F.col("_nth").cast("string"))
        return F.concat(F.array(entry(2, key, meta)), F.transform(both["plain"], lambda w: entry(0, w, nothing)),
                        F.transform(both["edited"], lambda w: entry(1, w, nothing)))

    both = F.struct(terms(F.col("_text")).alias("plain"), terms(F.coalesce("_edited", F.lit(""))).alias("edited"))
    spread = placed.select("_bucket", "_nth", F.explode(let(both, entries)).alias("_w")).select("_bucket", "_nth", "_w.*")
    # all rows of a bucket are in one task already, so this grouping moves nothing if the lexicon is sent to every task
    found = F.sort_array(F.collect_list(F.struct("term", "depths", "kind", "meta"))).alias("_found")
    grouped = spread.join(known, "term", "left").where("depths is not null or kind = 2").groupBy("_bucket", "_nth").agg(found)
    grouped = grouped.withColumn("_meta", F.get(F.filter("_found", lambda x: x["kind"] == 2), F.lit(0))["meta"])

    def signed(kind: int, every: str, otherwise: str) -> Column:
        own = F.transform(F.array_sort(F.col(f"_meta.{every}")), lambda w: F.struct(w.alias("term"), _depths(w).alias("depths")))
        return let(F.filter("_found", lambda x: x["kind"] == kind), lambda some: F.when(F.size(some) > 0, _signatures(some)).when(
            F.size(f"_meta.{every}") > 0, let(own, _signatures)).otherwise(F.array_repeat(F.col(f"_meta.{otherwise}"), VIEWS)))

    joined = grouped.select("_bucket", "_nth", "_meta._extra", "_meta._id", "_meta.n_chars", "_meta._edited",
                            signed(0, "_plain_terms", "_whole").alias("_plain"), signed(1, "_edited_terms", "_edited_whole").alias("_changed"))
    order = Window.partitionBy("_bucket").orderBy("_nth")
    return joined.withColumn("_following", F.lead("_plain").over(order)).where(~F.col("_extra")).select(
        F.col("_id").alias("id"), "n_chars", F.col("_edited").alias("edited"), F.array_join("_plain", "").alias("fingerprint"),
        F.array_join("_changed", "").alias("edited_fingerprint"), _likeness(F.col("_plain"), F.col("_changed")).alias("near_edited"),
        _likeness(F.col("_plain"), F.col("_following")).alias("near_next"))
