"""The registered queries, whole rows: DuckDB's where SQL can say them, the libraries' and plain definitions' for the others; of learned ones the folds."""

import html
import os
import re
import zlib

import duckdb
import numpy as np
import pytest

from burrow.llm import queries, twins

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_decontamination": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op2_html_extraction": ["page_id", "url", "text", "n_chars"],
    "op3_token_store": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op4_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op5_license_scan": ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
    "op6_jaccard_join": ["doc_id", "n_shingles", "component_id"],
    "op7_token_counts": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
    "op8_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op9_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op11_minhash": ["doc_id", "n_shingles", "component_id", "kept"],
    "op12_prefix_trie": ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"],
    "op13_fill_in_middle": ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"],
    "op10_packing": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
}
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables aren't here")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_duckdb(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        duck.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    rel = duck.sql(queries.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    want = sorted((tuple(dict(zip(rel.columns, r))[c] for c in columns) for r in rel.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name,folds", [("op8_language_id", (4, 2)), ("op9_toxicity", (5, 0))])
def test_folds_of_the_learned_queries(spark, name, folds):
    df = queries.queries()[name](spark, SF)
    assert df.columns[: len(COLUMNS[name])] == COLUMNS[name]
    rows = df.collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds[0] == folds[1]) and 0 <= r["score"] <= 1 for r in rows)


def documents(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def rows_of(spark, name):
    df = queries.queries()[name](spark, SF)
    assert df.columns[: len(COLUMNS[name])] == COLUMNS[name]
    return [tuple(r) for r in df.select(*COLUMNS[name]).collect()]


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def library_ids(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary(queries.WORD_BPE))
    return {i: t.encode(text or "", add_special_tokens=False).ids for i, text in documents(spark)}


def test_pages_are_their_articles(spark):
    """The pages of the tables hold one article each, of headings and paragraphs; its blocks, by regular expressions."""

    def blocks(page):
        inner = re.search(r"<article>(.*?)</article>", page or "", re.S)
        parts = re.split(r"</?(?:p|h\d|ul|li|table|tr|td|pre|blockquote|div|section)\b[^>]*>", inner[1]) if inner else []
        plain = (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br\s*/?>", " ", x)))).strip() for x in parts)
        return "\n\n".join(x for x in plain if x)

    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert sorted(rows_of(spark, "op2_html_extraction")) == sorted((r["page_id"], r["url"], t := blocks(r["html"]), len(t)) for r in pages)


def test_stored_tokens_are_the_library_s(spark):
    at, want = 0, []
    for i, ids in sorted(library_ids(spark).items()):
        want.append((i, at, len(ids) + 1, crc([*ids, 2])))
        at += len(ids) + 1
    assert sorted(rows_of(spark, "op3_token_store")) == want


def test_base_columns_of_the_license_scan_are_duckdb_s(spark):
    duck = duckdb.connect()
    duck.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    want = duck.sql(twins.LICENSE_BASE).fetchall()
    assert sorted(r[:6] for r in rows_of(spark, "op5_license_scan")) == sorted(want)


def test_token_counts_are_the_library_s(spark):
    from sentencepiece import SentencePieceProcessor

    p = SentencePieceProcessor(model_file=queries.vocabulary(queries.PIECE_BPE))
    want = [(i, len((t or "").encode()), n := len(p.encode(t or "")), n > 4096) for i, t in documents(spark)]
    assert sorted(rows_of(spark, "op7_token_counts")) == sorted(want)


def test_packed_pieces_are_all_there_and_fit(spark):
    got = rows_of(spark, "op10_packing")
    want = []
    for i, ids in library_ids(spark).items():
        ids = [*ids, 0]
        want += [(i, k, s, len(p := ids[s : s + 2048]), crc(p)) for k, s in enumerate(range(0, len(ids), 2048))]
    assert sorted(r[:5] for r in got) == sorted(want)
    sequences = {}
    for r in got:
        sequences.setdefault(r[5], []).append((r[6], r[3]))
    for pieces in sequences.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [sum(n for _, n in pieces[:k]) for k in range(len(pieces))] and sum(n for _, n in pieces) <= 2048
    assert len(sequences) <= 1.05 * -(-sum(r[3] for r in got) // 2048) + 1
