"""Corpus cleaning in five stages, each over all that the stage before has kept.

Language identification drops what it rejects, SimHash near-dedup keeps one document of
each group, decontamination cuts benchmark passages out, the secret scan redacts secrets,
and BPE encoding adds token ids and their decoding.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sondage import storage
from sondage.llm import bpe, decontam, langid, secret_scan, simhash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _text_changed(docs: DataFrame) -> DataFrame:
    """Columns of documents, with n_chars of the text as it is now."""
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*COLUMNS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts. It learns from the labelled documents of its
    input; null texts, texts without letters and texts far from every language go. Where no labelled
    text has a letter nothing can be learned, and every document stays. A very long text is read as a whole;
    repeated rows share a verdict; an empty table gives an empty one; columns beyond those of documents go."""
    model = langid.fit(docs)
    if not model.languages:
        return docs.select(*COLUMNS)
    return langid.predict(docs.select(*COLUMNS), model).where(~F.col("lang_rejected")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8 or
    more): the one with the smallest doc_id. Rows are told apart by all their columns, so rows
    that share a doc_id stay or go on their own; of rows that are equal in all columns one stays. Null, empty and
    wordless texts are equal to each other. Very long texts are compared as a whole; an empty table gives an empty one."""
    keys = {"_k1": F.xxhash64(*COLUMNS), "_k2": F.xxhash64(F.lit(1), *reversed(COLUMNS))}
    keyed = docs.select(*COLUMNS).withColumns(keys)
    groups = simhash.near_duplicates(keyed, carry=list(keys))
    later = groups.where(~F.col("is_first")).select(*keys).distinct()
    kept = keyed.join(later, list(keys), "left_anti")
    # the join has dealt and sorted by the keys, so that looking for equal rows moves nothing again
    again = F.row_number().over(Window.partitionBy(*keys).orderBy(*keys))
    return kept.withColumn("_again", again).where("_again = 1").select(*COLUMNS)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of ten words of a benchmark item; a document of which more
    than half is such passages goes. Null texts and all documents of an empty or wordless benchmark stay as they are;
    very long texts are read as a whole; an empty table gives an empty one."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return _text_changed(decontam.remove_hits(docs.select(*COLUMNS), items))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark. Null and empty texts stay; very long texts are read
    as a whole; repeated rows are treated alike; an empty table gives an empty one."""
    trees = secret_scan.forest(secret_scan.train(secret_scan.labelled_findings(spark)))
    return _text_changed(secret_scan.redact(docs.select(*COLUMNS), trees))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their token ids, how many they are, and the text decoded from them; a null text has none and
    decodes to an empty one. Very long texts are encoded as a whole; an empty table gives an empty one."""
    return bpe.encode(docs.select(*COLUMNS), decoded="decoded").withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("language identification", identify_language),
    ("near-duplicate removal", drop_near_duplicates),
    ("benchmark decontamination", remove_benchmark),
    ("secret redaction", redact_secrets),
    ("BPE encoding", encode),
]

#: The stages learn, hash and search in ways that SQL has no words for; tests/llm holds each stage
#: against a plain version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; what each returns is written to the shared folder and read again,
    and deleted when the next one is written."""
    folder = storage.new_folder(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            storage.delete(spark, f"{folder}/{k - 1}")
    return docs
