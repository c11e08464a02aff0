"""The registered queries of this subpackage: thin, whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_BPE = "word_bpe_49k.json"
PIECE_BPE = "piece_bpe_32k.model"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from burrow.llm.decontam import measure

    out = measure(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from burrow.llm import html_extract

    return html_extract.extract(table(spark, sf_dir, "pages"), html_extract.fit())


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from burrow.llm import token_store
    from burrow.llm.textual import scratch

    path = scratch(spark, "tokens")
    docs = table(spark, sf_dir, "documents")
    token_store.write(docs, path, vocabulary(WORD_BPE), end_id=2)
    return token_store.fetch(docs, path).unionByName(token_store.keyless(spark, path))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from burrow.llm.quality import judge

    return judge(table(spark, sf_dir, "documents"), with_text=True)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from burrow.llm.license_scan import scan

    return scan(table(spark, sf_dir, "documents"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from burrow.llm import jaccard

    return jaccard.join(table(spark, sf_dir, "documents"), percent=80)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from burrow.llm.token_count import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), vocabulary(PIECE_BPE), limit=4096)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from burrow.llm import langid

    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = langid.fit(docs.where(~held).select("text", "lang"))
    return langid.predict(docs.select("doc_id", "text", held.alias("held_out")), model)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from burrow.llm import toxicity

    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(fold != 0))
    rows = docs.select("doc_id", "text", F.coalesce(fold == 0, F.lit(False)).alias("held_out"))
    return toxicity.score(rows, model).select("doc_id", "held_out", "score", "predicted")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from burrow.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), vocabulary(WORD_BPE), end_id=0, capacity=2048)


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from burrow.llm.minhash import near_dedup

    return near_dedup(table(spark, sf_dir, "documents"), percent=80)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from burrow.llm.prefix_trie import trie

    return trie(table(spark, sf_dir, "conversations"), block=100, most=6)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from burrow.llm.fim import restored, transform

    out = restored(transform(table(spark, sf_dir, "documents"), unit="lines", seed=7, rate=100, spm=50))
    digests = [F.sha2(c, 256).alias(f"{c}_sha256") for c in ("output", "restored")]
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": op1_decontamination,
        "op2_html_extraction": op2_html_extraction,
        "op3_token_store": op3_token_store,
        "op4_quality_rules": op4_quality_rules,
        "op5_license_scan": op5_license_scan,
        "op6_jaccard_join": op6_jaccard_join,
        "op7_token_counts": op7_token_counts,
        "op8_language_id": op8_language_id,
        "op9_toxicity": op9_toxicity,
        "op10_packing": op10_packing,
        "op11_minhash": op11_minhash,
        "op12_prefix_trie": op12_prefix_trie,
        "op13_fill_in_middle": op13_fill_in_middle,
    }


def oracle_sql() -> dict[str, str]:
    from burrow.llm import twins

    return {
        "op1_decontamination": twins.DECONTAMINATION,
        "op4_quality_rules": twins.QUALITY,
        "op6_jaccard_join": twins.jaccard(5),
        "op11_minhash": twins.MINHASH,
        "op12_prefix_trie": twins.PREFIX_TRIE,
        "op13_fill_in_middle": twins.FILL_IN_MIDDLE,
    }
