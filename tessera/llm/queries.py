"""One registered query per operator, over its whole table with production parameters, and SQL where it exists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import (
    bpe, common, decontamination, html_text, jaccard_join, lexical_search, line_quality, oracles, packing, pii, quality_qda, sharding, token_counts, toxicity, whitening,
)
from tessera.registry import register as _register


def register(name: str, oracle: str | None = None):
    """Registers a query that makes sure that the executors have this package."""

    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            common.ship(spark)
            return fn(spark, sf_dir)

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        return _register(name, oracle)(run)

    return deco


def vocabulary(name: str) -> str:
    """A file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


@register("op1_line_quality", oracles.LINE_QUALITY)
def q_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.digest(common.table(spark, sf_dir, "documents"))


@register("op2_byte_bpe")
def q_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(common.table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


@register("op3_toxicity")
def q_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


@register("op4_pii")
def q_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(common.table(spark, sf_dir, "documents"))


@register("op5_quality_qda")
def q_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_qda.digest(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


@register("op6_html_text")
def q_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    return html_text.extract(common.table(spark, sf_dir, "pages"), ["page_id", "url"]).withColumn("n_chars", F.length("text").cast("long"))


@register("op7_shards")
def q_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(common.table(spark, sf_dir, "documents"))


@register("op8_decontamination", oracles.DECONTAMINATION)
def q_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digest(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


@register("op9_token_counts")
def q_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(common.table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), ["doc_id"])


@register("op10_ngram_jaccard", oracles.NGRAM_JACCARD)
def q_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.links(common.table(spark, sf_dir, "documents"))


@register("op11_bestfit_packing")
def q_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(common.table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


@register("op12_lexical_search", oracles.LEXICAL_SEARCH)
def q_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.digest(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


@register("op13_whitening")
def q_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.digest(common.table(spark, sf_dir, "embeddings"))
