"""One query per operator, over its whole table; each derives its digest columns from the operator's rows."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embedding, html, packing, pii, quality, scoring, simhash, substring, toxicity
from .common import crc_mod, table


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return os.environ.get("GRIDLARK_TOKENIZERS", os.path.dirname(public_tokenizers.path(name))) + "/" + name


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary_path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path), path)
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = scoring.score(table(spark, sf_dir, "documents"), crc_mod("doc_id", 10) == 0)
    return scored.select("*", (F.col("score") / F.col("n_tokens")).alias("mean_score"))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.strip(table(spark, sf_dir, "documents"), digest=True)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), crc_mod("doc_id", 5) == 0)


def op7_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.classes(table(spark, sf_dir, "embeddings"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    counts = [pii.count(F.col("spans"), k).alias(f"n_{k}") for k in pii.BASE]
    base = F.sha2(pii.listed(F.col("spans"), pii.BASE), 256).alias("base_sha256")
    whole = F.size("spans").cast("long").alias("n_spans")
    return found.select("doc_id", *counts, base, pii.listed(F.col("spans"), pii.KINDS).alias("spans"), whole)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json"))


QUERIES = {"op1_bpe": op1_bpe, "op2_scoring": op2_scoring, "op3_html": op3_html, "op4_quality": op4_quality, "op5_substring": op5_substring, "op6_toxicity": op6_toxicity, "op7_embedding": op7_embedding, "op8_pii": op8_pii, "op9_simhash": op9_simhash, "op10_packing": op10_packing}
#: DuckDB SQL where it can express a query: the others need hashes, tokenizers, learning or parsing that SQL has not.
ORACLES: dict[str, str] = {
    "op5_substring": """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS k FROM d, unnest(range(1, len(w) - 48)) AS t(i) WHERE len(w) >= 50),
owners AS (SELECT k, min(doc_id) AS owner FROM windows GROUP BY k),
gone AS (SELECT DISTINCT doc_id, i + j AS place FROM windows JOIN owners USING (k), unnest(range(0, 50)) AS t(j) WHERE owner < doc_id),
places AS (SELECT doc_id, list(place) AS places FROM gone GROUP BY doc_id),
words AS (SELECT doc_id, i, w[i] AS word FROM d, unnest(range(1, len(w) + 1)) AS t(i)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone ON words.doc_id = gone.doc_id AND words.i = gone.place GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(places), 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op7_embedding": """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_dot_product(embedding, embedding) > 0),
pairs AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach(x, y) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.x, p.y FROM reach r JOIN pairs p ON r.y = p.x),
links AS (SELECT x, count(*) AS n FROM pairs GROUP BY x)
SELECT e.vec_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_links, min(y) AS component_id, e.vec_id = min(y) AS kept
FROM embeddings e JOIN reach ON e.vec_id = reach.x LEFT JOIN links ON links.x = e.vec_id GROUP BY e.vec_id""",
}
