"""The operators over their whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.sources.tables import read_table

from . import ann, bpe, langid, lines, mixing, negatives, pages, pii, quality, records, simhash, toxicity, whitening
from .common import shared_path
from .learn import fold

#: Rows and bytes of an Arrow batch: what a Python worker holds at a time.
ARROW_ROWS, ARROW_BYTES = "2000", str(32 << 20)


def arrow_batches(spark: SparkSession, rows: str = ARROW_ROWS, size: str = ARROW_BYTES) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


#: The key of the surrogates; a deployment passes its own secret.
PII_KEY = "cadenza"


def op1_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    return pii.surrogates(docs, PII_KEY).select("doc_id", "text", F.size("entities").alias("n_entities"), "entities")


def domain_of(source: Column) -> Column:
    """Sources are dealt to four domains by their number."""
    number = F.regexp_extract(source, "([0-9]{1,6})$", 1).try_cast("int")
    last = len(DOMAINS) - 1
    return F.when(number.isNull(), F.lit("other")).otherwise(
        F.get(F.array(*map(F.lit, DOMAINS)), F.least(F.floor(number / 5), F.lit(last)).cast("int")))


DOMAINS = ("web", "books", "forum", "reference")
DOMAIN_WEIGHTS = {"web": 4, "books": 3, "forum": 2, "reference": 1}
LANG_WEIGHTS = {"en": 6, "de": 2, "fr": 2, "es": 1}


def weight_of(name: Column, weights: dict[str, int], other: int = 1) -> Column:
    out = F.lit(other)
    for key, weight in weights.items():
        out = F.when(name == key, weight).otherwise(out)
    return out


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text", "lang", "source"])
    domain, lang = domain_of(F.col("source")), F.col("lang")
    mixed = mixing.mix(docs, {"domain": domain, "lang": lang, "source": F.col("source")},
                       [weight_of(domain, DOMAIN_WEIGHTS), weight_of(lang, LANG_WEIGHTS), F.lit(1)],
                       portion=(3, 5), max_epochs=4, seed=2)
    return mixed.select("doc_id", "domain", "lang", "source", "epoch", "n_tokens", "take_tokens")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    labels = read_table(spark, sf_dir, "labels", ["doc_id", "quality"]).filter(fold(F.col("doc_id"), 3) != 1)
    return quality.quality(docs, labels).select(
        "doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding"])
    found = ann.nearest(vectors, F.col("id") % 20 == 0, k=20)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    return lines.clean_lines(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                                          "n_repeat_words", "base_failed", "kept")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    learn = read_table(spark, sf_dir, "documents", ["doc_id", "text", "lang"]).filter(fold(F.col("doc_id"), 5) != 0)
    return langid.identify(docs, learn).select(
        "doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    labels = read_table(spark, sf_dir, "labels", ["doc_id", "toxic"]).filter(fold(F.col("doc_id"), 3) != 1)
    return toxicity.toxicity(docs, labels).select(
        "doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")


def op8_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    # ids of this vocabulary (50,257) fit into two bytes
    manifest = records.write_texts(spark, docs, shared_path(spark, "records"), width=2)
    rows = records.with_start(records.read_records(manifest), manifest)
    return rows.select(F.col("id").alias("doc_id"), "start",
                       (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                       F.crc32("ids").alias("ids_crc32"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    return bpe.digests(bpe.encode_decode(docs))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    found = simhash.near_duplicates(docs, shingle=3, max_bits=2)
    return found.select(F.col("id").alias("doc_id"), simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"),
                        "component_id")


def op11_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pages.extract(read_table(spark, sf_dir, "pages", ["page_id", "url", "html"]))
    return found.select("page_id", "url", "text", "n_chars")


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding", "label"])
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(vectors, F.col("vec_id") % 100 == 0, label)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding"]), k=4)


def _with_batches(query):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        arrow_batches(spark)
        return query(spark, sf_dir)
    return run


QUERIES = {
    "op1_surrogates": op1_surrogates,
    "op2_mixing": op2_mixing,
    "op3_quality": op3_quality,
    "op4_neighbours": op4_neighbours,
    "op5_lines": op5_lines,
    "op6_language": op6_language,
    "op7_toxicity": op7_toxicity,
    "op8_records": op8_records,
    "op9_bpe": op9_bpe,
    "op10_simhash": op10_simhash,
    "op11_pages": op11_pages,
    "op12_negatives": op12_negatives,
    "op13_whitening": op13_whitening,
}

QUERIES = {name: _with_batches(query) for name, query in QUERIES.items()}
