"""The registered queries of the operators: each one over its whole table, reduced to the agreed digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spinecat.llm import (
    chat,
    decontaminate,
    divergence,
    host_rules,
    html_extract,
    language,
    mixing,
    packing,
    pii,
    simhash,
    spelling,
    substrings,
    toxicity,
)
from spinecat.llm.common import ready, table


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    done = html_extract.main_text(pages)
    return done.select("row.page_id", "row.url", "text", F.length("text").cast("long").alias("n_chars"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return done.select(
        "doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal weight for every source, at the size of the corpus."""
    ready(spark)
    return mixing.mix(table(spark, sf_dir, "documents"))


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    return substrings.cut(table(spark, sf_dir, "documents"), with_text=False)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        "n_words",
        decontaminate.n_hit().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        decontaminate.items_digest().alias("items_sha256"),
        (decontaminate.n_hit() > 0).alias("contaminated"),
    )


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    return simhash.assign(table(spark, sf_dir, "documents"), size=4)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    docs = table(spark, sf_dir, "documents")
    done = language.label(docs.select("doc_id", "text"), language.train(docs), keep=["doc_id"])
    return done.select(
        F.col("row.doc_id").alias("doc_id"), language.held_out("row.doc_id").alias("held_out"), "lang_pred", "score"
    )


def op8_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    judged = host_rules.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", *host_rules.COUNTS, "base_failed", "kept")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    found = pii.spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        *(pii.counted("pii_base", k).alias(f"n_{k}") for k in ("email", "ip", "card", "phone")),
        F.sha2(pii.joined("pii_base").cast("binary"), 256).alias("base_sha256"),
        pii.joined("pii_all").alias("spans"),
    )


#: Two texts made of control strings only; the conversation that proves the escapes.
PROBE = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame(PROBE, "conv_id long, turn long, role string, text string"))
    done = chat.conversations(chat.format_turns(rows))
    return done.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.select(
        "doc_id", "start", "length", packing.ids_crc32().alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_main_text": op1_main_text,
    "op2_toxicity": op2_toxicity,
    "op3_mixing": op3_mixing,
    "op4_substrings": op4_substrings,
    "op5_decontaminate": op5_decontaminate,
    "op6_simhash": op6_simhash,
    "op7_language": op7_language,
    "op8_host_rules": op8_host_rules,
    "op9_pii": op9_pii,
    "op10_chat": op10_chat,
    "op11_packing": op11_packing,
    "op12_spelling": op12_spelling,
    "op13_divergence": op13_divergence,
}
