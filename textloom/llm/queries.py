"""The queries of this subpackage, as the entry module registers them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import clustering, decontaminate, dictionary, exact_dedup, html_text, importance, language, mixing, packing, pii, simhash, token_file, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """A public tokenizer's file; TEXTLOOM_TOKENIZERS names another folder."""
    folder = os.environ.get("TEXTLOOM_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns; n_cut: words in hit spans over the length limit of one window, which a cut would take out."""
    hits = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    long = F.filter("spans", lambda x: x["end"] - x["start"] > decontaminate.WINDOW)
    n_cut = F.aggregate(long, F.lit(0), lambda a, x: a + x["end"] - x["start"]).cast("long")
    return hits.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated", n_cut.alias("n_cut"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file.token_output(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=2)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), toxicity.learnable())
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    return toxicity.toxicity(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns; then how many spans of each other kind, and every span's score in hundredths."""
    spans = pii.personal_data(table(spark, sf_dir, "documents"))

    def listed(x):
        return F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    only = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE_KINDS))
    scores = F.array_join(F.transform("spans", lambda s: F.round(s["score"] * 100).cast("int").cast("string")), ",")
    return spans.select("doc_id", *map(count, pii.BASE_KINDS), F.sha2(listed(only), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), *map(count, pii.KINDS[len(pii.BASE_KINDS) :]), scores.alias("scores"))


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_texts(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op6_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=1)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    return language.languages(docs, language.fit(docs, language.learnable())).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", digits.alias("fingerprint"), "component_id")


def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.clustered(table(spark, sf_dir, "embeddings"))


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.drawn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


def op13_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """One query per operator, over whole tables."""
    return {f.__name__: f for f in (op1_decontaminate, op2_token_files, op3_toxicity, op4_personal_data, op5_main_text, op6_importance, op7_pack, op8_exact_dedup, op9_language, op10_simhash, op11_clusters, op12_resample, op13_mix)}


def oracle_sql() -> dict[str, str]:
    from .oracles import SQL

    return dict(SQL)
