"""One registered query for each operator of this subpackage, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelight.llm import bpe, html_extract, lm, mixing, near_dup, quality, spotsigs, toxicity, url_filter, vector_index
from cuelight.llm.store import table

#: The byte-level vocabulary that the BPE query uses.
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), BYTE_BPE)


#: The rules of the URL query as (host, path, verdict).
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document: doc_id, text_score, meta_score, quality, kept."""
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, deciding rule and verdict; a URL that no listing covers is not listed, so allowed."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), rules)


OP3_SQL = """
with parts as (
  select page_id,
         coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') as path
  from pages),
rules(h, p, v) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
                          ('net', '/es/', 'block'), ('net', '/fr/', 'block'))
select page_id, host, path,
       (select h || p from rules where (host = h or ends_with(host, '.' || h)) and starts_with(path, p) order by length(h || p) desc limit 1) as rule,
       coalesce((select v from rules where (host = h or ends_with(host, '.' || h)) and starts_with(path, p) order by length(h || p) desc limit 1), 'allow') as verdict
from parts
"""


def op4_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents on two-word shingles at similarity 0.8."""
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document: doc_id, held_out, score, predicted."""
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model scores of every document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    return lm.score_texts(table(spark, sf_dir, "documents"))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page: page_id, url, text, n_chars."""
    return html_extract.extract_text(table(spark, sf_dir, "pages"))


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five highest integer inner products of every vector whose vec_id is divisible by 50, against all others."""
    return vector_index.top_k(table(spark, sf_dir, "embeddings"), k=5, every=50)


OP8_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as q from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id as query_id, b.vec_id,
         list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2]))::bigint as score
  from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id)
select query_id, rank::int as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 5
"""

def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, with how alike they are."""
    return spotsigs.edited_fingerprints(table(spark, sf_dir, "documents"))


#: Shares of all tokens that the mixing query and the pipeline aim at, by language as the domain.
TARGETS = {"en": 0.55, "fr": 0.15, "de": 0.18, "es": 0.12}


def domain_classifier(docs: DataFrame, labels: DataFrame) -> mixing.Classifier:
    """A classifier of the documents' languages, learned from the documents of the labelled table."""
    known = labels.select("doc_id").dropDuplicates()
    return mixing.fit_classifier(docs.select("doc_id", "text", F.col("lang").alias("domain")).join(known, "doc_id"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens, domain posterior, fitted rate and number of copies, and each domain's target and reached share of all tokens."""
    docs = table(spark, sf_dir, "documents")
    model = domain_classifier(docs, table(spark, sf_dir, "labels"))
    mixture, rated = mixing.fit_rates(docs.select("doc_id", "text"), model, TARGETS)
    listed = lambda values: F.array(*map(F.lit, values))
    wanted, reached = mixture.shares()
    return rated.select("doc_id", "tokens", listed(model.domains).alias("domains"), "posterior", "rate", mixing.copies(F.col("rate"), F.col("doc_id")).alias("copies"), listed(wanted).alias("target_shares"), listed(reached).alias("reached_shares"))


def spotsigs_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose signature sets are alike by 0.8 or more: (a, b, likeness) between classes of equal sets, b null for members (a: the row, class: its class)."""
    members, pairs = spotsigs.similar_pairs(table(spark, sf_dir, "documents"), 0.8)
    nothing = F.lit(None)
    of_rows = members.select(F.col("key").alias("a"), nothing.cast("long").alias("b"), F.col("class"), nothing.cast("double").alias("likeness"))
    return of_rows.unionByName(pairs.select("a", "b", nothing.cast("long").alias("class"), "likeness"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_quality": op2_quality,
    "op3_url_filter": op3_url_filter,
    "op4_near_dup": op4_near_dup,
    "op5_toxicity": op5_toxicity,
    "op6_lm": op6_lm,
    "op7_html": op7_html,
    "op8_top_k": op8_top_k,
    "op9_fingerprints": op9_fingerprints,
    "op10_mixing": op10_mixing,
    "spotsigs_pairs": spotsigs_pairs,
}
ORACLES: dict[str, str] = {"op3_url_filter": OP3_SQL, "op8_top_k": OP8_SQL}
