"""The registered queries of the text operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterkit.llm import bpe, chat, collocations, decontam, htmltext, jaccard, langid, lines, oracle, pii, quality, rank, spots, warc
from meterkit.llm.common import table


def op1_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_signals(table(spark, sf_dir, "documents"))


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return htmltext.extract(pages).withColumn("n_chars", F.length("text").cast("bigint"))


def op3_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    span = F.transform("removed", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string")))
    units = F.expr("coalesce(aggregate(removed, 0L, (n, s) -> n + s.units), 0L)")
    kept = F.coalesce("text", F.lit(""))
    return found.select("doc_id", units.alias("n_removed"), F.coalesce(F.array_join(span, ","), F.lit("")).alias("removed"), F.length(kept).cast("bigint").alias("n_kept_chars"), F.sha2(kept, 256).alias("kept_sha256"))


def byte_vocabulary() -> tuple[str, str]:
    """(rank file, split pattern) of the byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(table(spark, sf_dir, "documents").select("doc_id", "text"), *byte_vocabulary())


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs.select("doc_id", "text"), langid.train(docs))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op6_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = warc.derivatives(warc.responses(table(spark, sf_dir, "pages")), keep=["page_id"])
    return made.withColumn("refers_to", F.col("response_id")).drop("response_id")


def op7_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = chat.conversations(table(spark, sf_dir, "conversations"))
    return chat.preference_examples(chat.pairs_by_first_turn(convs), convs)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest, "contaminated")


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.component_ids(table(spark, sf_dir, "documents"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"), pii.train())
    counts = [F.expr(f"cast(size(filter(split(base, ','), x -> startswith(x, '{k}:'))) as bigint)").alias(f"n_{k}") for k in pii.BASE]
    more = "cast(size(filter(split(spans, ','), x -> x <> ''{0})) as bigint)"
    secret, every = F.expr(more.format(" and startswith(x, 'secret:')")), F.expr(more.format(""))
    return found.select("doc_id", *counts, F.sha2("base", 256).alias("base_sha256"), "spans", secret.alias("n_secret"), every.alias("n_spans"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spots.edited_likeness(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_repetition, op2_main_text, op3_repeated_passages, op4_byte_bpe, op5_language_id, op6_warc_derivatives, op7_preference_format, op8_decontamination, op9_ngram_jaccard, op10_personal_data, op11_ranked_search, op12_collocations, op13_fingerprints, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_repetition": oracle.repetition(),
        "op3_repeated_passages": oracle.repeated_passages(),
        "op7_preference_format": oracle.preference_format(),
        "op8_decontamination": oracle.decontamination(),
        "op9_ngram_jaccard": oracle.ngram_jaccard(),
        "op11_ranked_search": oracle.ranked_search(),
        "op12_collocations": oracle.collocations(),
        "op13_fingerprints": oracle.fingerprints(),
    }
