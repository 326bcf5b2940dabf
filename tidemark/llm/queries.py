"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import decontamination, fingerprint, html_extraction, line_dedup, lm_scoring, minhash_dedup, mixing, more_queries, secrets, substring_dedup, toxicity

_SPACES = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page; null html has none."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return html_extraction.extract_text(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the windows of 20 words that start earlier elsewhere or before."""
    kept = substring_dedup.remove_repeats(_documents(spark, sf_dir, "doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every document, with its source's size and target."""
    mixed = mixing.mix(_documents(spark, sf_dir, "doc_id", "source", "text")).documents
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of every document: base kinds, and the spans that the battery adds."""
    found = secrets.find_secrets(_documents(spark, sf_dir, "doc_id", "text"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random")


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its component of near duplicates."""
    found = minhash_dedup.near_duplicates(_documents(spark, sf_dir, "doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items that documents hold."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return decontamination.contaminated(_documents(spark, sf_dir, "doc_id", "text"), benchmark)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learnt from the labels of those not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    scored = toxicity.toxicity(_documents(spark, sf_dir, "doc_id", "text"), labels)
    return scored.select("doc_id", "held_out", "score", "predicted")


def op8_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's likelihood under words alone and under the hidden Markov model."""
    return lm_scoring.lm_scores(_documents(spark, sf_dir, "doc_id", "text"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that an earlier one holds."""
    kept = line_dedup.dedup_lines(_documents(spark, sf_dir, "doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP9_SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, {_SPACES}), '{_UPPER}', '{_LOWER}') AS key FROM lines
), firsts AS (
  SELECT key, min(doc_id) AS first_doc FROM keyed WHERE length(key) >= 10 GROUP BY key
), marked AS (
  SELECT k.doc_id, k.pos, k.line, coalesce(k.doc_id > f.first_doc, false) AS gone
  FROM keyed k LEFT JOIN firsts f ON k.key = f.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and their likeness."""
    return fingerprint.edit_report(_documents(spark, sf_dir, "doc_id", "text"))


OP2_SQL = r"""
WITH tokens AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), places AS (
  SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS pos FROM tokens
), starts AS (
  SELECT doc_id, pos, array_to_string(words[pos:pos + 19], ' ') AS seq FROM places WHERE pos + 19 <= len(words)
), ranked AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY seq ORDER BY doc_id, pos) AS k FROM starts
), latest AS (
  SELECT p.doc_id, p.pos, p.words[p.pos] AS word,
         max(CASE WHEN r.k > 1 THEN r.pos END) OVER (PARTITION BY p.doc_id ORDER BY p.pos) AS last_start
  FROM places p LEFT JOIN ranked r ON r.doc_id = p.doc_id AND r.pos = p.pos
), kept AS (
  SELECT doc_id, count(*) AS n_words,
         count(*) FILTER (WHERE coalesce(pos < last_start + 20, false)) AS n_removed,
         string_agg(word, ' ' ORDER BY pos) FILTER (WHERE NOT coalesce(pos < last_start + 20, false)) AS text
  FROM latest GROUP BY doc_id
)
SELECT d.doc_id, coalesce(k.n_words, 0) AS n_words, coalesce(k.n_removed, 0) AS n_removed,
       sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""


#: Exact pairs over common shingles; the reach of a component is a recursion over its links.
OP5_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)
), e AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r(node, root) AS (
  SELECT DISTINCT a, a FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node
), c AS (
  SELECT node, min(root) AS root FROM r GROUP BY node
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.root, d.doc_id) AS component_id, coalesce(c.root, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.node = d.doc_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_html_text": op1_html_text, "op2_substring_dedup": op2_substring_dedup, "op3_mixing": op3_mixing, "op4_secrets": op4_secrets, "op5_minhash": op5_minhash, "op6_decontamination": op6_decontamination, "op7_toxicity": op7_toxicity, "op8_hmm_scores": op8_hmm_scores, "op9_line_dedup": op9_line_dedup, "op10_fingerprint": op10_fingerprint, "pipeline": corpus_pipeline.run} | more_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return {"op2_substring_dedup": OP2_SQL, "op5_minhash": OP5_SQL, "op9_line_dedup": OP9_SQL} | more_queries.ORACLES
