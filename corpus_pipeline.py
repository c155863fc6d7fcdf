"""The corpus pipeline: operators of cadenza.llm in a row, each over all that
the one before kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import bpe, mixing, pii, simhash, toxicity
from cadenza.llm.common import materialize
from cadenza.llm.learn import fold
from cadenza.llm.queries import PII_KEY, arrow_batches, domain_of, weight_of
from cadenza.sources.tables import read_table

#: Targets are the shares of the tokens that the stage is given, times these
#: corrections in per cent; the entry None is for every node not named.  Other
#: languages than English get a quarter more.  The budget is BUDGET of all tokens:
#: as much as the largest correction, so that a node without one never gets less
#: than it has and no document is left out (one pass of each leaf is also asked
#: for, as a share rounded down on its way to a leaf of a few words may miss it);
#: what the others gain is read again in a second epoch.
BUDGET = (5, 4)
DOMAIN_CORRECTION: dict[str | None, int] = {None: 100}
LANG_CORRECTION: dict[str | None, int] = {"en": 100, None: 125}
SOURCE_CORRECTION: dict[str | None, int] = {None: 100}
MIX_SEED = 2

#: Rows and bytes of an Arrow batch: stages follow each other in the same
#: executors and workers, whose memory does not shrink in between.
BATCH = ("1000", str(8 << 20))


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under 0.7 stay.  The network learns from
    labels whose crc32(doc_id) mod 3 is not 1.

    Null and empty texts are scored as empty ones; long texts whole, the worst
    window counts.  A score on the cut goes.  Rows that repeat are judged alike,
    null ids are no obstacle.  An empty table gives an empty one; all columns stay.
    """
    arrow_batches(spark, *BATCH)
    labels = read_table(spark, sf_dir, "labels", ["doc_id", "toxic"]).filter(fold(F.col("doc_id"), 3) != 1)
    return toxicity.toxicity(docs, labels).filter("predicted = 0").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays (shingles of three words, at
    most two differing bits): the one with the smallest doc_id.

    Texts without a word (null, empty) are one group.  Long texts are taken
    whole.  Rows that repeat doc_id and text keep one; an id that repeats with
    another text is another document; rows with a null id all stay.  An empty
    table gives an empty one; all columns stay.
    """
    arrow_batches(spark, *BATCH)
    return simhash.keep_one(docs, shingle=3, max_bits=2)


def _sized(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Columns of documents, n_chars as the text is now."""
    return docs.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in columns])


def replace_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by surrogates; every document stays.

    Null and empty texts stay as they are, long ones are searched whole.  Rows
    that repeat get the same text; ids play no part.  An empty table gives an
    empty one; all columns stay, n_chars is that of the new text.
    """
    arrow_batches(spark, *BATCH)
    return _sized(pii.surrogates(docs, PII_KEY), docs.columns)


def _corrected(name: Column, correction: dict[str | None, int]) -> Column:
    return weight_of(name, {k: v for k, v in correction.items() if k is not None}, correction[None])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents selected for the target mix, once per epoch they are in: each
    once whole at least; then the document that a leaf's budget ends in keeps the
    words that fit.

    Documents without a word (null, empty, white space) are in no mix and go.
    Null domains, languages and sources are nodes of their own.  Texts are taken
    whole but for the one cut in a leaf, however long.  Rows that repeat are
    documents of their own.  An empty table gives an empty one; all columns stay.
    """
    arrow_batches(spark, *BATCH)
    domain, lang, source = domain_of(F.col("source")), F.col("lang"), F.col("source")
    mixed = mixing.mix(docs, {"domain": domain, "lang": lang, "source": source},
                       [_corrected(domain, DOMAIN_CORRECTION), _corrected(lang, LANG_CORRECTION),
                        _corrected(source, SOURCE_CORRECTION)], portion=BUDGET, max_epochs=4, seed=MIX_SEED,
                       natural=True, min_epochs=1)
    cut = mixing.cut_text(F.col("text"), F.col("n_tokens"), F.col("take_tokens"))
    return _sized(mixed.withColumn("text", cut), docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the bytes
    decoded from them.

    Null and empty texts have no ids; long texts are encoded whole.  Rows that
    repeat, and null ids, come out as they come in.  An empty table gives an
    empty one; other columns than doc_id, lang and source are not kept.
    """
    arrow_batches(spark, *BATCH)
    coded = docs.select("doc_id", "lang", "source", bpe.round_trip(F.col("text")).alias("both"))
    return coded.select(
        "doc_id", "lang", "source", F.size("both.ids").cast("long").alias("n_tokens"), "both.ids",
        F.sha2(F.array_join(F.col("both.ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("both.decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", reject_toxic),
    ("simhash", near_duplicates),
    ("pii", replace_private),
    ("mixing", mix_sources),
    ("bpe", tokenize),
]

#: SQL can express neither the network, the fingerprints nor the merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared
    folder and read back."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
