"""The corpus pipeline: quality filter, near-duplicate removal, redaction, source mix, tokens.

``STAGES`` are (name, function); a function takes (spark, docs, sf_dir), and its result is written and read again as the
next one's ``docs``. Empty tables give no rows, repeated rows are treated alike, further columns of any name stay (in the
last stage: are left out)."""

from pyspark.sql import functions as F

from llm.common import bounded_batches, stage
from llm.mixing import mixed_documents
from llm.near_duplicates import keep_one
from llm.personal_data import redact
from llm.quality import keep_good
from llm.queries import model_path
from llm.sentencepiece_bpe import tokenize


def quality(spark, docs, sf_dir):
    """Drops the documents that the classifier rejects: ``keep_good``, also for nulls, empty and repeated rows."""
    bounded_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return keep_good(docs, labels, F.col("source"), F.concat_ws("/", "source", "lang"))


def near_duplicates(spark, docs, sf_dir):
    """Keeps one document of each group of near-duplicates (five words, 0.8): ``keep_one``; null and empty texts stay."""
    bounded_batches(spark)
    return keep_one(docs)


def personal_data(spark, docs, sf_dir):
    """Masks personal data in the texts: ``redact``; null texts stay null, and have no n_chars."""
    bounded_batches(spark)
    return redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def source_mix(spark, docs, sf_dir):
    """Brings the sources to their target weights: ``mixed_documents``; null and empty texts are in no mix."""
    bounded_batches(spark)
    return mixed_documents(docs).withColumn("n_chars", F.length("text").cast("long"))


def tokens(spark, docs, sf_dir):
    """Token ids of the texts: ``tokenize``; a null text is an empty one."""
    bounded_batches(spark)
    return tokenize(docs, model_path(), ("n_tokens", "ids_sha256", "decoded_sha256", "ids"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("personal_data", personal_data),
          ("source_mix", source_mix), ("tokens", tokens)]


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


ORACLE_SQL = None  # classifier, signatures and merges have no SQL form; tested against brute force
QUERIES = {"pipeline": run}
ORACLE = {}
