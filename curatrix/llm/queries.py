"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from curatrix.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from curatrix.llm.quality import quality

    out = quality(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


@query
def op5_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    from curatrix.llm.simhash import near_duplicates

    out = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "fingerprint", "component_id")


@query
def op6_pii_boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    from curatrix.llm.pii import digests, find_pii

    return digests(find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False))


@query
def op7_entropy_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from curatrix.llm.mixing import files_of, mix

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")
    return out.repartition(files_of(docs.count()))


@query
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from curatrix.llm.sentencepiece_codec import default_model, digests

    return digests(table(spark, sf_dir, "documents").select("doc_id", "text"), default_model())


@query
def op2_chat_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from curatrix.llm.chat import format_chats, read_back

    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return read_back(format_chats(rows))


def _op2_oracle() -> str:
    from curatrix.llm.chat import oracle

    return oracle()


ORACLES["op2_chat_templates"] = _op2_oracle()


@query
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from curatrix.llm.warc import round_trip

    return round_trip(spark, table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def _op3_oracle() -> str:
    from curatrix.llm.warc import ORACLE

    return ORACLE


ORACLES["op3_warc"] = _op3_oracle()


@query
def op9_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from curatrix.llm.html_main import main_text

    out = main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", "n_chars")


@query
def op8_ivf_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from curatrix.llm.ann import search

    return search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)


@query
def op4_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from curatrix.llm.lm_score import score

    return score(table(spark, sf_dir, "documents").select("doc_id", "text"))
