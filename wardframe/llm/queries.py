"""The operators over the supplied tables, under the names ``op<N>_<name>``, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardframe.llm import bpe, dialogue, forest, html_text, language, packing, quadratic, recursive_bpe, risk_rules, simhash, spelling, token_counts, warc
from wardframe.llm.dialogue_sql import DIALOGUE_SQL
from wardframe.llm.spelling_sql import SPELLING_SQL
from wardframe.llm.sql import RULES_SQL, WARC_SQL
from wardframe.llm.texts import id_bucket, table
from wardframe.session import cut_lineage

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_forest_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every row whose vec_id is divisible by 20."""
    return forest.search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, tokenizer_path("byte_bpe_50k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op3_segment_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.bpe_digests(docs, tokenizer_path("word_bpe_49k.json")).drop("text")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(id_bucket("doc_id", 4) == 2, F.lit(False))
    model = language.fit(docs.where(~held_out))
    scored = docs.select("doc_id", held_out.alias("held_out"), language.predict(model).alias("p"))
    return scored.select("doc_id", "held_out", "p.lang_pred", "p.score")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op9_risk_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    judged = risk_rules.apply_rules(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op10_quadratic(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(id_bucket("doc_id", 5) == 0, F.lit(False))
    measured = cut_lineage(docs.select("doc_id", quadratic.statistics_column(F.col("text")).alias("x")))
    labels = quadratic.clean_labels(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "quality")
    model = quadratic.fit(measured.where(~held_out).join(labels, "doc_id"))
    scored = measured.select("doc_id", held_out.alias("held_out"), quadratic.score_statistics(model, "x").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= quadratic.THRESHOLD).cast("int"))


def op11_recursive_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return recursive_bpe.bpe_digests(docs, tokenizer_path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).drop("text")


def op12_dialogue_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return dialogue.with_empty(conversations, dialogue.repair_digests(dialogue.damage(conversations)))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.runs_with_typos(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return spelling.group_variants(spelling.vocabulary(words))


QUERIES: dict[str, Query] = {
    f.__name__: f for f in (
        op1_forest_search, op2_token_counts, op3_segment_tree_bpe, op4_language, op5_best_fit_packing, op6_simhash, op7_warc,
        op8_main_text, op9_risk_rules, op10_quadratic, op11_recursive_bpe, op12_dialogue_repair, op13_spelling,
    )
}
ORACLES: dict[str, str] = {"op7_warc": WARC_SQL, "op9_risk_rules": RULES_SQL, "op12_dialogue_repair": DIALOGUE_SQL, "op13_spelling": SPELLING_SQL}
