"""The registered queries of this subpackage, over whole tables with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.llm import best_fit_packing, extendible_shards, factorization, fill_in_middle, hmm_lm, html_layout, ngram_jaccard, posting_lists, quality_rules, secrets, sentencepiece_scan, source_divergence, source_mixing
from statuta.llm.ship import ship


#: The SentencePiece model of the encoding query.
MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
#: The tokenizer whose ids are packed.
TOKENIZER_FILE = public_tokenizers.path("byte_bpe_50k.json")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.link_classes(documents(spark, sf_dir))


def op2_ann_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return posting_lists.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.statistics(documents(spark, sf_dir)).drop("rejected_by")


def op4_hmm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_lm.score(documents(spark, sf_dir))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mixing.taken(documents(spark, sf_dir))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(documents(spark, sf_dir)).drop("s")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factorization.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extendible_shards.shards(documents(spark, sf_dir))


def op9_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return html_layout.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_scan.encode(documents(spark, sf_dir), MODEL_FILE)


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing.pack_documents(documents(spark, sf_dir), TOKENIZER_FILE)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.divergence(documents(spark, sf_dir))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle.transform(documents(spark, sf_dir))
    digests = {"output_sha256": F.col("output"), "restored_sha256": fill_in_middle.restored()}
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *(F.sha2(text.cast("binary"), 256).alias(name) for name, text in digests.items()))


QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_ann_posting_lists": op2_ann_posting_lists,
    "op3_quality_rules": op3_quality_rules,
    "op4_hmm_scoring": op4_hmm_scoring,
    "op5_source_mixing": op5_source_mixing,
    "op6_secret_scan": op6_secret_scan,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_extendible_shards": op8_extendible_shards,
    "op9_html_layout": op9_html_layout,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_best_fit_packing": op11_best_fit_packing,
    "op12_source_divergence": op12_source_divergence,
    "op13_fill_in_middle": op13_fill_in_middle,
}
