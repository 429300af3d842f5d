"""A corpus pipeline of the training-data operators: every stage reads what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ostinato.llm import decontaminate, langid, sentencepieces, setsketch_dedup, toxicity
from ostinato.llm.common import cut, table, text_hash, without_rows

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Percent of shared shingles from which documents are near copies. At 80 a pair misses all 28 bands of 5
#: registers with a probability of 6e-6 (all 24 of 6: 3.5e-4).
NEAR = 80


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted to be toxic, by a model of the labels of those given."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, keep=COLUMNS).filter("predicted = 0").select(COLUMNS)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language: without letters, or ambiguous and unsure, they go."""
    out = langid.identify(docs, langid.fit(docs), keep=COLUMNS)
    unknown = (F.col("lang_pred") == langid.UNKNOWN) | (F.col("ambiguous") & (F.col("score") < 0.5))
    return out.filter(~unknown).select(COLUMNS)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of every near-duplicate group.

    Decisions hold for a row's id and text together: of rows that share an id each text is judged on its own, and of
    rows that repeat both, or an id and a set of shingles, one stays. Rows with null ids stay.
    """
    docs = docs.select(COLUMNS)
    found = setsketch_dedup.near_duplicates(docs.withColumn("text_hash", text_hash()), percent=NEAR, slack=0.12, band_rows=5, keep=["doc_id", "text_hash"])
    found = found.filter("doc_id is not null")
    lead = found.filter("kept and leads")
    gone = found.filter("not (kept and leads)").select("doc_id", "text_hash")
    again = lead.groupBy("doc_id", "h1").agg(F.count("*").alias("n"), F.min("text_hash").alias("stays")).filter("n > 1").drop("n")
    again = again.join(lead.select("doc_id", "h1", "text_hash"), ["doc_id", "h1"]).select("doc_id", "stays", "text_hash").distinct()
    again = cut(again)
    if again.isEmpty():
        return without_rows(docs, gone)
    one = docs.join(again.select("doc_id", F.col("stays").alias("_hash")).distinct(), "doc_id").filter(text_hash() == F.col("_hash"))
    return without_rows(docs, gone.union(again.select("doc_id", "text_hash"))).union(one.dropDuplicates(["doc_id", "_hash"]).select(COLUMNS))


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item within its error budget; rows are told by id and text, so null
    and repeated ids are judged by their own texts."""
    docs = docs.select(COLUMNS)
    found = decontaminate.find(docs.withColumn("text_hash", text_hash()), table(spark, sf_dir, "benchmark"), keep=["doc_id", "text_hash"])
    return without_rows(docs, found)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document's pieces, their number, and whether they decode to the text."""
    return sentencepieces.encode_and_check(docs)


STAGES = [
    ("toxicity", keep_civil),
    ("language_id", keep_languages),
    ("minhash_near_dedup", keep_one_of_each_group),
    ("decontamination", keep_uncontaminated),
    ("sentencepiece", to_pieces),
]

#: Learned models, components and pieces have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages one after another over the table ``documents``.

    Between stages rows are written to the shared checkpoint folder and read back, as a scheduler of
    the stages would do with Parquet.
    """
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
