"""The queries of the training-data operators, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.ann import nearest
from ledgerline.llm.common import table
from ledgerline.llm.exact_dedup import exact_duplicates
from ledgerline.llm.html_extract import extracted
from ledgerline.llm.language_id import fit, identified_documents, identified_pages, sampled
from ledgerline.llm.license_scan import license_scan
from ledgerline.llm.mixing import mixed
from ledgerline.llm.packing import packed
from ledgerline.llm.sharding import shards
from ledgerline.llm.simhash import near_duplicates
from ledgerline.llm.substring import repeated_substrings


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    """The place of a public tokenizer's vocabulary; a parameter of the operators, never copied here."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = identified_documents(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "source", F.col("lang").alias("declared"), "language", "probability", "accepted", "text_language", "evidence")


def language_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator of op1 over web pages: markup language, address suffix and host."""
    model = fit(sampled(table(spark, sf_dir, "documents"), "text", "lang"))
    rows = identified_pages(table(spark, sf_dir, "pages"), model)
    return rows.select("page_id", "url", "language", "probability", "accepted", "text_language", "evidence")


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), tokenizer_file())


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(table(spark, sf_dir, "documents"), n_shards=40)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repeated_substrings(table(spark, sf_dir, "documents"), window=20)
    return rows.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"), keep="largest")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixed(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "source", "text", "copy", "copies", rows["rate"].cast("decimal(20,6)").cast("double").alias("rate"), "mix_key")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, distance=3)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_nearest, op3_packing, op4_html_extraction, op5_sharding, op6_substring_dedup, op7_exact_dedup, op8_mixing, op9_simhash, op10_license_scan, language_of_pages)}

ORACLES = {
    "op6_substring_dedup": r"""
        WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
        starts AS (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS s FROM docs WHERE len(words) >= 20),
        ranked AS (SELECT doc_id, s, row_number() OVER (PARTITION BY array_to_string(words[s:s + 19], ' ') ORDER BY doc_id, s) AS place FROM starts),
        gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM ranked WHERE place > 1),
        numbered AS (SELECT doc_id, unnest(range(1, len(words) + 1)) AS i, unnest(words) AS word FROM docs),
        kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS body, count(*) AS n FROM numbered ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
        SELECT d.doc_id, len(d.words) AS n_words, len(d.words) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.body, '')) AS kept_sha256
        FROM docs d LEFT JOIN kept k USING (doc_id)
    """,
    "op7_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
    "op8_mixing": """
        WITH docs AS (SELECT doc_id, source, coalesce(text, '') AS body, text FROM documents),
        masses AS (SELECT source, sum(length(body))::DOUBLE AS mass FROM docs GROUP BY source),
        wanted AS (SELECT source, mass, pow(mass, 0.7) AS wanted FROM masses),
        rates AS (
            SELECT source, coalesce(wanted / nullif(sum(wanted) OVER (), 0) * sum(mass) OVER () / nullif(mass, 0), 0) AS rate FROM wanted
        ),
        terms AS (
            SELECT source, k, sum(CASE WHEN rate = 0 THEN CASE WHEN k = 0 THEN 1.0 ELSE 0.0 END ELSE exp(k * ln(rate) - rate - lgamma(k + 1)) END)
                   OVER (PARTITION BY source ORDER BY k) AS cdf
            FROM (SELECT source, rate, unnest(range(0, (ceil(rate + 12 * sqrt(rate)) + 21)::BIGINT)) AS k FROM rates)
        ),
        cdfs AS (SELECT source, list(cdf ORDER BY k) AS cdf FROM terms GROUP BY source),
        drawn AS (
            SELECT d.doc_id, d.source, d.text, r.rate,
                   len(list_filter(c.cdf, lambda x: x < ((('0x' || substr(md5('17/' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496.0)) AS copies
            FROM docs d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source JOIN cdfs c ON d.source IS NOT DISTINCT FROM c.source
        ),
        copied AS (SELECT *, unnest(range(0, copies)) AS copy FROM drawn)
        SELECT doc_id, source, text, copy::INTEGER AS copy, copies::INTEGER AS copies, round(rate, 6) AS rate,
               ((('0x' || substr(md5('17/' || coalesce(doc_id::VARCHAR, 'null') || '/' || copy::VARCHAR), 1, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496.0 AS mix_key
        FROM copied
    """,
}
