"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import (bwt, contentsort, covertree, decontam, embeddings, html, langid, lines, minhash, packing, prefixtrie,
                          secrets, substring)

QUERIES, ORACLES = {}, {}


def _query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The vocabulary the packing query is defined on."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@_query()
def op1_secret_scan(spark, sf_dir):
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents"), keep=["doc_id"]))


@_query()
def op2_language_id(spark, sf_dir):
    d = langid.identify(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return d.select("row.doc_id", langid.held_out("row.doc_id").alias("held_out"), "lang_pred", "score")


@_query(minhash.DIGEST_SQL)
def op3_minhash_dedup(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), size=2, percent=80)


@_query()
def op4_best_fit_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


@_query(embeddings.DIGEST_SQL)
def op5_embedding_dedup(spark, sf_dir):
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


@_query()
def op6_suffix_array_dedup(spark, sf_dir):
    return bwt.digest(bwt.dedup_bytes(table(spark, sf_dir, "documents"), keep=["doc_id"]))


@_query(lines.DIGEST_SQL)
def op7_line_dedup(spark, sf_dir):
    return lines.digest(lines.dedup_lines(table(spark, sf_dir, "documents")))


@_query(substring.DIGEST_SQL)
def op8_substring_dedup(spark, sf_dir):
    return substring.digest(substring.dedup_substrings(table(spark, sf_dir, "documents"), keep=["doc_id"]))


@_query(decontam.DIGEST_SQL)
def op9_decontamination(spark, sf_dir):
    d = decontam.find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return decontam.digest(d)


@_query()
def op10_html_extraction(spark, sf_dir):
    return html.digest(html.extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"]))


@_query(covertree.DIGEST_SQL)
def op11_vector_codes(spark, sf_dir):
    return covertree.digest(*covertree.compress(table(spark, sf_dir, "embeddings"), keep=["vec_id"]))


@_query(contentsort.DIGEST_SQL)
def op12_exact_dedup(spark, sf_dir):
    return contentsort.digest(contentsort.dedup_exact(table(spark, sf_dir, "documents"), keep=["doc_id"]))


@_query(prefixtrie.DIGEST_SQL)
def op13_prefix_trie(spark, sf_dir):
    return prefixtrie.prefix_trie(table(spark, sf_dir, "conversations"))
