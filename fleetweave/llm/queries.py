"""Each operator of this subpackage as a query over its whole table, and its SQL twin where SQL can express it."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetweave.llm import (byte_bpe, decontamination, imatch, language_id, lexical_search, line_dedup, lm_scoring, metric_join, sharding,
                            simhash_dedup, substring_dedup, token_rollups, whitening)
from fleetweave.llm.scratch import folder, stored

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(build):
    QUERIES[build.__name__] = build
    return build


def documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/documents.parquet")


@query
def op9_simhash_near_dedup(spark: SparkSession, path: str) -> DataFrame:
    """Every document's SimHash of four-word shingles and the smallest document it is linked to."""
    found = simhash_dedup.near_duplicates(documents(spark, path))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        "component_id")


@query
def op8_substring_dedup(spark: SparkSession, path: str) -> DataFrame:
    """Words of every document, how many of them earlier documents repeat, and a digest of the rest."""
    found = substring_dedup.without_repeats(documents(spark, path))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query
def op4_byte_bpe(spark: SparkSession, path: str) -> DataFrame:
    """Digests of the token ids of every document and of the bytes that they decode to."""
    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = byte_bpe.encode(documents(spark, path), vocabulary, public_tokenizers.PATTERN)
    decoded = byte_bpe.decode(encoded, vocabulary)
    listed = F.array_join(F.col("token_ids").cast("array<string>"), ",")
    return decoded.select(F.col("id").alias("doc_id"), F.size("token_ids").cast("long").alias("n_tokens"),
                          F.sha2(listed, 256).alias("ids_sha256"), F.sha2("data", 256).alias("decoded_sha256"))


@query
def op10_language_id(spark: SparkSession, path: str) -> DataFrame:
    """The predicted language of every document, learned from two thirds of the labels."""
    docs = documents(spark, path)
    found = language_id.predict(docs, language_id.train(docs))
    return found.select(F.col("id").alias("doc_id"), (language_id.remainder("id", 3) == 1).alias("held_out"),
                        "lang_pred", "score")


@query
def op1_lm_scoring(spark: SparkSession, path: str) -> DataFrame:
    """Every document's log-probability under the backoff automaton of nine tenths of the documents."""
    return lm_scoring.scores(documents(spark, path)).withColumnRenamed("id", "doc_id")


@query
def op2_line_dedup(spark: SparkSession, path: str) -> DataFrame:
    """Lines of every document, how many of them are boilerplate of ten or more sources, and a digest of the rest."""
    found = line_dedup.without_boilerplate(documents(spark, path))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


ORACLES["op2_line_dedup"] = f"""
    WITH lines AS (
        SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
               generate_subscripts(string_split(text, chr(10)), 1) AS pos
        FROM documents),
    bad AS (
        SELECT trim(line) AS plain, min({{'d': doc_id, 'p': pos}}) AS first
        FROM lines WHERE trim(line) <> '' GROUP BY 1 HAVING count(DISTINCT source) >= {line_dedup.MIN_SITES}),
    judged AS (
        SELECT lines.*, first IS NOT NULL AND first <> {{'d': doc_id, 'p': pos}} AS gone
        FROM lines LEFT JOIN bad ON trim(line) = plain)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
    FROM judged GROUP BY doc_id"""


@query
def op6_benchmark_decontamination(spark: SparkSession, path: str) -> DataFrame:
    """Every document that holds a benchmark item, with the window where it is most similar."""
    found = decontamination.contaminated(documents(spark, path), spark.read.parquet(f"{path}/benchmark.parquet"))
    return found.select(F.col("id").alias("doc_id"), "item_id", "start", "n_words", F.round("similarity", 9).alias("similarity"))


@query
def op7_sharding(spark: SparkSession, path: str) -> DataFrame:
    """The shard of every document, 24 of near-equal bytes, and its slot there."""
    return sharding.shards(documents(spark, path)).withColumnRenamed("id", "doc_id")


@query
def op5_imatch(spark: SparkSession, path: str) -> DataFrame:
    """The fingerprint of every document and of its edited text, and its likeness to that and to the next document."""
    found = imatch.fingerprints(documents(spark, path))
    return found.select(F.col("id").alias("doc_id"), "n_chars", F.col("edited").alias("edited_sha256"), "fingerprint",
                        "edited_fingerprint", "near_edited", "near_next")


ORACLES["op5_imatch"] = f"""
    WITH ordered AS (
        SELECT doc_id, coalesce(text, '') AS text,
               coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id DESC), first(coalesce(text, '')) OVER (ORDER BY doc_id DESC)) AS next
        FROM documents),
    texts AS (
        SELECT doc_id, 0 AS kind, text FROM ordered
        UNION ALL
        SELECT doc_id, 1, left(text, length(text) - length(text) // 2) || left(next, length(text) // 2) FROM ordered),
    terms AS (
        SELECT doc_id, kind, term
        FROM (SELECT doc_id, kind, unnest(list_distinct(string_split_regex(lower(text), '[\\x20\\x09-\\x0D]+'))) AS term FROM texts)
        WHERE term <> ''),
    distinct_terms AS (
        SELECT unnest(list_distinct(string_split_regex(lower(text), '[\\x20\\x09-\\x0D]+'))) AS term FROM (SELECT DISTINCT text FROM ordered)),
    size AS (SELECT count(DISTINCT text) AS n FROM ordered),
    lexicon AS (
        SELECT term FROM distinct_terms, size WHERE term <> '' GROUP BY term, n
        HAVING count(*) BETWEEN greatest(2, {imatch.LOW} * n) AND greatest(2, {imatch.LOW} * n, {imatch.HIGH} * n)),
    banded AS (SELECT terms.*, lexicon.term IS NOT NULL AS inside FROM terms LEFT JOIN lexicon USING (term)),
    used AS (
        SELECT doc_id, kind, term FROM banded
        QUALIFY inside OR NOT bool_or(inside) OVER (PARTITION BY doc_id, kind)),
    viewed AS (
        SELECT doc_id, kind, term, v, length(ltrim(bin(('0x' || substr(md5(term), 2 * v + 1, 2))::INT), '0')) AS depth
        FROM used, range({imatch.VIEWS}) views(v)),
    ranked AS (SELECT *, min(depth) OVER (PARTITION BY doc_id, kind, v) AS least FROM viewed),
    signatures AS (
        SELECT doc_id, kind, v, left(md5(string_agg(term, ' ' ORDER BY term)), {imatch.DIGITS}) AS sig
        FROM ranked WHERE depth = least GROUP BY ALL),
    prints AS (
        SELECT texts.doc_id, texts.kind, v, coalesce(sig, left(md5(text), {imatch.DIGITS})) AS sig
        FROM texts CROSS JOIN range({imatch.VIEWS}) views(v) LEFT JOIN signatures USING (doc_id, kind, v)),
    listed AS (SELECT doc_id, kind, list(sig ORDER BY v) AS sigs FROM prints GROUP BY ALL),
    paired AS (
        SELECT a.doc_id, a.sigs AS own, b.sigs AS changed,
               coalesce(lead(a.sigs) OVER (ORDER BY a.doc_id DESC), first(a.sigs) OVER (ORDER BY a.doc_id DESC)) AS following
        FROM listed a JOIN listed b ON a.doc_id = b.doc_id AND a.kind = 0 AND b.kind = 1)
    SELECT paired.doc_id, length(ordered.text) AS n_chars, sha256(texts.text) AS edited_sha256,
           array_to_string(own, '') AS fingerprint, array_to_string(changed, '') AS edited_fingerprint,
           len(list_filter(list_zip(own, changed), lambda x: x[1] = x[2])) / {imatch.VIEWS} AS near_edited,
           len(list_filter(list_zip(own, following), lambda x: x[1] = x[2])) / {imatch.VIEWS} AS near_next
    FROM paired JOIN ordered USING (doc_id) JOIN texts ON texts.doc_id = paired.doc_id AND texts.kind = 1"""


TOKENIZERS = ("byte_bpe_50k", "byte_bpe_multi_50k")


@query
def op3_token_rollups(spark: SparkSession, path: str) -> DataFrame:
    """Tokens by source, language and tokenizer version of all documents whose text no earlier one has.

    Three batches lead there: every document is inserted with a quarter of its bytes as an estimate, every count is revised
    to that of the tokenizer, and repeated texts are deleted. The second batch is sent twice, which changes nothing.
    """
    text = F.coalesce("text", F.lit(""))
    docs = documents(spark, path).select("doc_id", "source", "lang", "text", F.ceil(F.octet_length(text) / 4).alias("estimate"),
                                         F.md5(text).alias("digest"))
    files = {v: (public_tokenizers.path(f"{v}.tiktoken"), public_tokenizers.PATTERN) for v in TOKENIZERS}
    counts = stored(token_rollups.counted(docs, files, name="counted").withColumn("row", F.monotonically_increasing_id()))
    # null ids come last; of rows equal in id and text any one is the first
    place = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "row")
    firsts = counts.groupBy("digest", "tokenizer_version").agg(F.min(place).alias("first")).select(F.col("first.row").alias("row"))
    repeats = counts.join(firsts, "row", "left_anti")

    def changes(rows: DataFrame, op: str, new, old) -> DataFrame:
        return rows.select(*token_rollups.KEYS, F.lit(op).alias("op"), F.expr(new).alias("n_tokens"), F.expr(old).alias("old_tokens"))

    rollup = token_rollups.Rollup(spark, folder(spark))
    recount = changes(counts, "revise", "counted", "estimate")
    rollup.commit("load", changes(counts, "insert", "estimate", "cast(null as bigint)"))
    rollup.commit("recount", recount)
    rollup.commit("repeats", changes(repeats, "delete", "cast(null as bigint)", "counted"))
    rollup.commit("recount", recount)
    return rollup.totals()


@query
def op11_lexical_search(spark: SparkSession, path: str) -> DataFrame:
    """The ten documents that fit each benchmark item best."""
    return lexical_search.search(documents(spark, path), spark.read.parquet(f"{path}/benchmark.parquet"))


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
ORACLES["op11_lexical_search"] = f"""
    WITH words AS (
        SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}')) AS term
        FROM documents),
    counted AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
    sizes AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM counted GROUP BY doc_id),
    whole AS (SELECT count(*)::BIGINT AS rows, sum(n)::BIGINT AS total FROM sizes),
    weights AS (
        SELECT term, floor(1000 * ln((2 * rows + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
        FROM (SELECT term, count(*) AS df FROM counted GROUP BY term), whole),
    asked AS (
        SELECT DISTINCT item_id, term FROM (
            SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}')) AS term
            FROM benchmark)),
    scored AS (
        SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * rows) // total))))::BIGINT AS score
        FROM asked JOIN counted USING (term) JOIN weights USING (term) JOIN sizes USING (doc_id), whole GROUP BY ALL)
    SELECT item_id, rank, doc_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM scored WHERE score > 0)
    WHERE rank <= 10"""


@query
def op12_metric_join(spark: SparkSession, path: str) -> DataFrame:
    """The number of vectors at cosine 0.95 or more of every vector, and the smallest one that such links reach."""
    return metric_join.near_duplicates(spark.read.parquet(f"{path}/embeddings.parquet")).withColumnRenamed("id", "vec_id")


ORACLES["op12_metric_join"] = f"""
    WITH RECURSIVE usable AS (
        SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
        WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    links AS (
        SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b
        ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= {metric_join.LEAST}),
    reached AS (
        SELECT vec_id AS a, vec_id AS b FROM embeddings
        UNION SELECT reached.a, links.b FROM reached JOIN links ON reached.b = links.a),
    least AS (SELECT a AS vec_id, min(b) AS component_id FROM reached GROUP BY a),
    counted AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
    SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
    FROM least LEFT JOIN counted USING (vec_id)"""


@query
def op13_whitening(spark: SparkSession, path: str) -> DataFrame:
    """Every vector on the first eight principal components, each scaled to variance one."""
    return whitening.whitened(spark.read.parquet(f"{path}/embeddings.parquet")).withColumnRenamed("id", "vec_id")
