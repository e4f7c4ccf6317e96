"""Registered queries of the corpus operators, over whole tables, and their DuckDB text where SQL can say it."""

import importlib.util
import os

from pyspark.sql import functions as F

from llm import oracles
from llm.centroids import cluster
from llm.licenses import scan_licenses
from llm.mixing import mix
from llm.near_duplicates import near_duplicates
from llm.near_vectors import near_vectors
from llm.neighbours import neighbours
from llm.personal_data import find_personal_data
from llm.quality import classify_quality
from llm.ranked_search import ranked_search
from llm.sentencepiece_bpe import tokenize
from llm.sharding import shard_documents
from llm.toxicity import score_toxicity
from llm.url_rules import filter_urls


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_empirical_bayes(spark, sf_dir):
    judged = classify_quality(documents(spark, sf_dir), labels(spark, sf_dir), F.col("source"), F.concat_ws("/", "source", "lang"))
    return judged.drop("hash")


def op2_label_propagation(spark, sf_dir):
    return shard_documents(documents(spark, sf_dir), shards=16)


def op3_random_field(spark, sf_dir):
    return score_toxicity(documents(spark, sf_dir), labels(spark, sf_dir)).drop("spans")


def op4_superminhash(spark, sf_dir):
    found = near_duplicates(documents(spark, sf_dir), shingle=2, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def model_path():
    """piece_bpe_32k.model of the installed package of public tokenizers (found without a global import)."""
    found = importlib.util.find_spec("public_tokenizers")
    return os.path.join(os.path.dirname(found.origin), "piece_bpe_32k.model")


def op5_source_mix(spark, sf_dir):
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op6_bootstrapped_contexts(spark, sf_dir):
    return find_personal_data(documents(spark, sf_dir)).drop("hash", "added")


def op8_diagonal_voting(spark, sf_dir):
    return scan_licenses(documents(spark, sf_dir)).drop("spans")


def embeddings(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def op7_lattice(spark, sf_dir):
    return near_vectors(embeddings(spark, sf_dir))


def op9_learned_partitions(spark, sf_dir):
    return neighbours(embeddings(spark, sf_dir), "vec_id % 20 = 0", k=20)


def op10_sentencepiece(spark, sf_dir):
    return tokenize(documents(spark, sf_dir), model_path(), ("n_tokens", "ids_sha256", "decoded_sha256"))


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"),
         ("com", "/de/", "block")]


def op11_url_rules(spark, sf_dir):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


def op12_presence_masks(spark, sf_dir):
    return ranked_search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_threshold_centroids(spark, sf_dir):
    return cluster(embeddings(spark, sf_dir))


QUERIES = {
    "op1_empirical_bayes": op1_empirical_bayes,
    "op2_label_propagation": op2_label_propagation,
    "op3_random_field": op3_random_field,
    "op4_superminhash": op4_superminhash,
    "op5_source_mix": op5_source_mix,
    "op6_bootstrapped_contexts": op6_bootstrapped_contexts,
    "op8_diagonal_voting": op8_diagonal_voting,
    "op7_lattice": op7_lattice,
    "op9_learned_partitions": op9_learned_partitions,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_url_rules": op11_url_rules,
    "op12_presence_masks": op12_presence_masks,
    "op13_threshold_centroids": op13_threshold_centroids,
}

ORACLE = {
    "op4_superminhash": oracles.NEAR_DUPLICATES,
    "op7_lattice": oracles.NEAR_VECTORS,
    "op11_url_rules": oracles.url_rules(RULES),
    "op12_presence_masks": oracles.RANKED_SEARCH,
    "op13_threshold_centroids": oracles.centroid_clusters(),
}
