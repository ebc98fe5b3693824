"""One query per operator, over the whole of the given tables."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textmatch.config import EngineConfig, materialize, scratch_path, spread
from textmatch.functions.text import (
    base_stem,
    clean_text,
    clean_title_text,
    ellipsis,
    extension,
    fingerprint,
    preview,
    round6,
)
from textmatch.functions.titles import (
    normalize_title,
    normalize_title_lite,
    standardize_title,
)
from textmatch.functions.tokens import default_stop_words, words
from textmatch.functions.vectors import cosine, l2_normalize, norm
from textmatch.operators import metrics as M
from textmatch.operators.chunking import chunk_docs, chunk_text, register_chunks
from textmatch.operators.overlap import best_overlap, overlap_score, title_map
from textmatch.operators.nearest import build_inverted_file, scored_pairs, search
from textmatch.operators.pooling import mean_pool
from textmatch.operators.ranking import dedup_titles, rank_results
from textmatch.operators.relational import (
    column_profile,
    content_dedup,
    dedup_stats,
    group_concat_distinct,
)
from textmatch.operators.sampling import sample_truth
from textmatch.operators.similarity import all_scores, top_k
from textmatch.operators.summary import (
    comparison_series,
    overall_summary,
    result_lines,
    scan_summary,
    summary_lines,
)
from textmatch.operators.tfidf import (
    TfidfModel,
    boost_text,
    postings,
    term_statistics,
    top_terms,
    vocabulary,
)
from textmatch.plans.corpus import join_profiles, prepare_corpus
from textmatch.plans.evaluate import evaluate_model
from textmatch.plans.match import (
    embed,
    encode_chunks,
    match_documents,
    match_lite,
    similar_documents,
    text_queries,
    with_average,
)
from textmatch.plans.scan import process_documents
from textmatch.sources.bucketed import open_by_key, write_by_key
from textmatch.sources.documents import (
    describe_texts,
    extract_text,
    file_formats,
    html_pages,
    latest_artifact,
    list_files,
    reject_unsupported,
    scan_folder,
)
from textmatch.sources.envelope import read_envelope_table, write_envelope_table
from textmatch.sources.growing import compact, load_growing, update_index
from textmatch.sources.index import build_index, corpus_fingerprint, open_index
from textmatch.sources.sinks import (
    read_matches,
    write_csv,
    write_envelope,
    write_json,
    write_matches,
    write_metrics,
    write_table,
    write_threshold,
)
from textmatch.sources.tables import (
    load_ground_truth,
    load_processed,
    csv_rows,
    read_envelope,
    read_lines,
    read_person_tables,
)
from textmatch.streaming.files import scan_stream, scanned_documents, scanned_matches
from textmatch.streaming.match import match_stream
from workload.texts import INLINE_TEXTS

CFG = EngineConfig()
K_VALUES = (3, 5, 10)
MATCH_SCHEMA = (
    "query_id bigint, rank bigint, id bigint, title string, similarity_percentage double"
)
THRESHOLDS = CFG.thresholds

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- inputs -------------------------------------------------------------------------


def raw_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return spread(docs, "doc_id")


def corpus_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the corpus: the source stands for the title."""
    return raw_documents(spark, sf_dir).select(
        F.col("doc_id").alias("id"),
        standardize_title(F.col("source")).alias("title"),
        clean_text(F.col("text")).alias("embedding_text"),
    )


def stored_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus written once, for plans that read it for terms, vectors and texts."""
    return materialize(corpus_of(spark, sf_dir), "corpus")


def queries_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as the documents to match."""
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), "text"
    )


def fitted(corpus: DataFrame) -> TfidfModel:
    return TfidfModel.fit(corpus, "embedding_text", CFG)


def matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = stored_corpus(spark, sf_dir)
    return match_documents(queries_of(spark, sf_dir), corpus, fitted(corpus), CFG)


def page_title(html: Column) -> Column:
    return F.regexp_extract(html, "(?is)<title>(.*?)</title>", 1)


def titles_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    parts = [
        part.select(F.col("p_name").alias("title")),
        part.select(F.col("p_type").alias("title")),
        part.select(F.concat_ws(" - ", "p_name", "p_type").alias("title")),
        table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("title")),
        table(spark, sf_dir, "pages").select(page_title(F.col("html")).alias("title")),
    ]
    return functools.reduce(DataFrame.unionByName, parts).distinct()


def person_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts that people ordered, with the texts of the parts."""
    orders = table(spark, sf_dir, "orders")
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    owner = orders.select("o_orderkey", F.col("o_custkey").alias("person_id"))
    # First sight of a part by a person, before the part's texts are attached.
    seen = (
        line.join(owner, line.l_orderkey == owner.o_orderkey)
        .groupBy("person_id", "l_partkey")
        .agg(F.min(F.struct("l_orderkey", "l_linenumber")).alias("seq"))
    )
    return seen.join(part, seen.l_partkey == part.p_partkey)


def person_tables(
    spark: SparkSession, sf_dir: str, details: DataFrame | None = None
) -> dict[str, DataFrame]:
    """Customers as people: priorities are abilities, ordered parts titles and skills."""
    customer = table(spark, sf_dir, "customer")
    orders = table(spark, sf_dir, "orders")
    details = person_parts(spark, sf_dir) if details is None else details
    return {
        "people": customer.select(
            F.col("c_custkey").alias("person_id"), F.col("c_name").alias("name")
        ),
        "abilities": orders.select(
            F.col("o_custkey").alias("person_id"),
            F.col("o_orderpriority").alias("ability"),
            F.col("o_orderkey").alias("seq"),
        ),
        "experience": details.select("person_id", F.col("p_name").alias("title"), "seq"),
        "skills": details.select("person_id", F.col("p_type").alias("skill"), "seq"),
    }


def ranking_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings ranked by likeness to the centre of each label."""
    vectors = table(spark, sf_dir, "embeddings")
    centres = mean_pool(vectors, "label").select(
        F.col("label").cast("string").alias("query_id"), "vector"
    )
    corpus = vectors.select(
        F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector")
    )
    scores = all_scores(centres, corpus).withColumnRenamed("id", "item_id")
    rounded = scores.withColumn("score", F.floor(F.col("score") * 1000000 + 0.5))
    return materialize(rank_results(rounded), "ranking")


def truth_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector is worth 3 for its own label and 1 for the labels next to it."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    near = F.explode(F.expr("array(label - 1, label, label + 1)")).alias("near")
    return vectors.select("vec_id", "label", near).select(
        F.col("near").cast("string").alias("query_id"),
        F.col("vec_id").cast("string").alias("item_id"),
        F.when(F.col("near") == F.col("label"), 3.0).otherwise(1.0).alias("relevance"),
    )


def metric_rows(
    spark: SparkSession, sf_dir: str, thresholds=(1.0,), names=M.METRICS
) -> DataFrame:
    ranking, truth = ranking_of(spark, sf_dir), truth_of(spark, sf_dir)
    return M.evaluate(ranking, truth, K_VALUES, thresholds, names)


def metric_means(spark: SparkSession, sf_dir: str, thresholds=(1.0,)) -> DataFrame:
    return M.averages(metric_rows(spark, sf_dir, thresholds), K_VALUES, thresholds)


# --- text, titles, relational ---------------------------------------------------------


@query
def clean_text_docs(spark, sf_dir):
    text = F.col("text")
    return raw_documents(spark, sf_dir).select(
        "doc_id",
        F.length(clean_text(text)).cast("bigint").alias("clean_chars"),
        F.md5(clean_text(text)).alias("clean_md5"),
        F.length(clean_title_text(text)).cast("bigint").alias("title_chars"),
        fingerprint(text).alias("text_hash"),
        preview(text).alias("text_preview"),
        ellipsis(clean_text(text), 30).alias("short_text"),
    )


@query
def standardize_titles(spark, sf_dir):
    return titles_of(spark, sf_dir).select(
        "title",
        standardize_title(F.col("title")).alias("standard"),
        standardize_title(F.col("title"), word_boundary=True).alias("standard_strict"),
    )


@query
def standardize_titles_lite(spark, sf_dir):
    lite = standardize_title(F.col("title"), "lite")
    return titles_of(spark, sf_dir).select(
        "title", lite.alias("standard"), normalize_title_lite(lite).alias("normal")
    )


@query
def normalize_titles(spark, sf_dir):
    return titles_of(spark, sf_dir).select(
        "title", normalize_title(F.col("title")).alias("normal")
    )


def _brand_titles(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("query_id"),
        F.col("p_partkey").alias("id"),
        standardize_title(F.col("p_name")).alias("title"),
        F.col("p_retailprice").alias("similarity_percentage"),
    )


@query
def dedup_titles_full(spark, sf_dir):
    return dedup_titles(_brand_titles(spark, sf_dir), 5).select(
        "query_id", F.col("rank").cast("bigint").alias("rank"), "id", "title",
        "similarity_percentage",
    )


@query
def dedup_without_titles(spark, sf_dir):
    """A match list that has no title column passes as it is."""
    return dedup_titles(cosine_topk(spark, sf_dir), 5, by="query_id", value="score")


@query
def dedup_titles_lite(spark, sf_dir):
    return dedup_titles(_brand_titles(spark, sf_dir), None, "lite")


@query
def group_concat(spark, sf_dir):
    return group_concat_distinct(
        table(spark, sf_dir, "orders"),
        "o_custkey",
        ["o_orderpriority", "o_orderstatus"],
        ["o_orderkey"],
    )


@query
def distinct_keys(spark, sf_dir):
    return group_concat_distinct(table(spark, sf_dir, "orders"), "o_custkey", [], [])


@query
def person_profiles(spark, sf_dir):
    return join_profiles(**person_tables(spark, sf_dir))


@query
def prepared_corpus(spark, sf_dir):
    return prepare_corpus(**person_tables(spark, sf_dir))


@query
def content_dedup_docs(spark, sf_dir):
    kept = content_dedup(table(spark, sf_dir, "documents"), "doc_id")
    return kept.select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("h"))


@query
def dedup_statistics(spark, sf_dir):
    return dedup_stats(table(spark, sf_dir, "documents"), "doc_id")


@query
def profile_columns(spark, sf_dir):
    return column_profile(table(spark, sf_dir, "documents"), exact=True)


# --- terms ----------------------------------------------------------------------------


@query
def tokenize_ngrams(spark, sf_dir):
    docs = corpus_of(spark, sf_dir)
    return term_statistics(docs, "embedding_text")


@query
def stopword_counts(spark, sf_dir):
    text = clean_text(F.col("text"))
    stop = list(default_stop_words())
    return raw_documents(spark, sf_dir).select(
        "doc_id",
        F.size(words(text, [])).cast("bigint").alias("n_words"),
        F.size(words(text, stop)).cast("bigint").alias("n_kept"),
    )


def _terms(found: DataFrame) -> DataFrame:
    return found.select("term", "df", "ctf", round6(F.col("idf")).alias("idf"))


@query
def vocabulary_terms(spark, sf_dir):
    return _terms(vocabulary(corpus_of(spark, sf_dir), "embedding_text", CFG))


@query
def tfidf_vectors(spark, sf_dir):
    corpus = stored_corpus(spark, sf_dir)
    model = fitted(corpus)
    vectors = corpus.select("id", model.vector(F.col("embedding_text")).alias("vector"))
    return postings(vectors).withColumn("weight", round6(F.col("weight")))


@query
def top_terms_docs(spark, sf_dir):
    corpus = stored_corpus(spark, sf_dir)
    model = fitted(corpus)
    vectors = corpus.select("id", model.vector(F.col("embedding_text")).alias("vector"))
    return vectors.select(
        "id", F.posexplode_outer(top_terms(F.col("vector"), CFG.boost_terms))
    ).filter(F.col("pos").isNotNull()).select(
        "id",
        (F.col("pos") + 1).cast("bigint").alias("place"),
        F.col("col.term").alias("term"),
        round6(F.col("col.weight")).alias("weight"),
    )


@query
def tfidf_boost(spark, sf_dir):
    corpus = stored_corpus(spark, sf_dir)
    model = fitted(corpus)
    text = F.col("embedding_text")
    vectors = corpus.select("id", "embedding_text", model.vector(text).alias("v"))
    return vectors.select(
        "id",
        F.md5(boost_text(text, F.col("v"))).alias("literal_md5"),
        F.md5(boost_text(text, F.col("v"), sep=" ")).alias("spaced_md5"),
    )


@query
def chunk_documents(spark, sf_dir):
    docs = corpus_of(spark, sf_dir).select("id", F.col("embedding_text").alias("text"))
    return chunk_docs(docs).select(
        "id",
        F.col("chunk_idx").cast("bigint").alias("chunk_idx"),
        F.length("chunk").cast("bigint").alias("chunk_chars"),
        F.md5("chunk").alias("chunk_md5"),
    )


@query
def chunk_documents_sql(spark, sf_dir):
    """The same from SQL, by the registered table function."""
    name = register_chunks(spark)
    docs = corpus_of(spark, sf_dir)
    return spark.sql(
        "SELECT id, cast(chunk_idx AS bigint) AS chunk_idx, cast(length(chunk) AS bigint) AS "
        f"chunk_chars, md5(chunk) AS chunk_md5 FROM {{docs}}, LATERAL {name}(embedding_text, 2048, 200)",
        docs=docs,
    )


@query
def chunk_mean_tfidf(spark, sf_dir):
    corpus = stored_corpus(spark, sf_dir)
    model = fitted(corpus)
    chunked = corpus.select("id", chunk_text(F.col("embedding_text")).alias("chunks"))
    means = chunked.select("id", model.mean_vector(F.col("chunks")).alias("vector"))
    return postings(means).withColumn("weight", round6(F.col("weight")))


# --- vectors and matching ---------------------------------------------------------------


@query
def normalize_vectors(spark, sf_dir):
    v = F.col("embedding")
    doubled = F.transform(v, lambda x: x.cast("double") * 2)
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        round6(norm(v)).alias("length"),
        round6(F.aggregate(l2_normalize(doubled), F.lit(0.0), lambda s, x: s + x)).alias(
            "total"
        ),
        round6(cosine(v, doubled)).alias("self_cosine"),
        round6(cosine(v, F.transform(v, lambda x: F.lit(0.0)))).alias("zero_cosine"),
    )


@query
def mean_pool_labels(spark, sf_dir):
    pooled = mean_pool(table(spark, sf_dir, "embeddings"), "label", unit=True)
    return pooled.select("label", F.posexplode("vector").alias("pos", "value")).select(
        "label", F.col("pos").cast("bigint").alias("pos"), round6(F.col("value")).alias("value")
    )


def _label_search(spark, sf_dir, **how):
    vectors = table(spark, sf_dir, "embeddings")
    centres = mean_pool(vectors, "label").select(F.col("label").alias("query_id"), "vector")
    corpus = vectors.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return top_k(centres, corpus, 15, **how).select(
        "query_id", F.col("rank").cast("bigint").alias("rank"), "id",
        round6(F.col("score")).alias("score"),
    )


@query
def cosine_topk(spark, sf_dir):
    return _label_search(spark, sf_dir)


@query
def cosine_topk_blocked(spark, sf_dir):
    return _label_search(spark, sf_dir, block=4)


def _every_fiftieth(spark, sf_dir):
    """Vectors as a corpus, and those with an id divisible by 50 as queries."""
    vectors = table(spark, sf_dir, "embeddings")
    corpus = vectors.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    asked = corpus.where(F.pmod("id", F.lit(50)) == 0).withColumnRenamed("id", "query_id")
    return corpus, asked


@query
def cosine_topk_indexed(spark, sf_dir):
    corpus, asked = _every_fiftieth(spark, sf_dir)
    return search(build_inverted_file(corpus), asked, 15).select(
        "query_id", F.col("rank").cast("bigint").alias("rank"), "id",
        round6(F.col("score")).alias("score"),
    )


@query
def index_recall(spark, sf_dir):
    """How many of the exact neighbours the index finds, of those there are."""
    corpus, asked = _every_fiftieth(spark, sf_dir)
    index = build_inverted_file(corpus)
    found = search(index, asked, 15).select("query_id", "id").withColumn("found", F.lit(1))
    exact = top_k(asked, corpus, 15).select("query_id", "id")
    both = exact.join(found, ["query_id", "id"], "left").agg(
        F.count(F.lit(1)).alias("wanted"), F.count("found").alias("found")
    )
    # Numbers of pairs don't fit in the type of a literal.
    pairs = asked.count() * corpus.count()
    return both.select(
        "wanted",
        (F.col("found") >= 0.9 * F.col("wanted")).alias("recall_reached"),
        F.lit(scored_pairs(index, asked) < pairs).alias("fewer_pairs_scored"),
    )


@query
def hash_embed(spark, sf_dir):
    corpus = stored_corpus(spark, sf_dir)
    embedded = embed(corpus, fitted(corpus), "embedding_text", CFG)
    return (
        embedded.select("id", F.posexplode_outer("embedding").alias("pos", "value"))
        .select(
            "id",
            F.col("pos").cast("bigint").alias("pos"),
            round6(F.col("value").cast("double")).alias("value"),
        )
        .filter(F.col("value") != 0)
    )


@query
def tfidf_topk(spark, sf_dir):
    corpus = stored_corpus(spark, sf_dir)
    return similar_documents(queries_of(spark, sf_dir), corpus, fitted(corpus), 5).select(
        "query_id", F.col("rank").cast("bigint").alias("rank"), "id",
        round6(F.col("score")).alias("score"),
    )


def _shown(matches: DataFrame) -> DataFrame:
    return with_average(matches).select(
        "query_id",
        F.col("rank").cast("bigint").alias("rank"),
        "id",
        "title",
        "similarity_percentage",
        round6(F.col("avg_similarity")).alias("avg_similarity"),
    )


@query
def match_lite_documents(spark, sf_dir):
    corpus = stored_corpus(spark, sf_dir)
    return _shown(match_lite(queries_of(spark, sf_dir), corpus, fitted(corpus), CFG))


@query
def match_benchmark(spark, sf_dir):
    return _shown(matched(spark, sf_dir))


@query
def match_profiles(spark, sf_dir):
    """Person tables to a corpus, and the persons matched for each kind of part."""
    corpus = materialize(prepare_corpus(**person_tables(spark, sf_dir)), "corpus").select(
        F.col("person_id").alias("id"), "title", "embedding_text"
    )
    asked = (
        table(spark, sf_dir, "part")
        .select(F.concat_ws(" ", "p_name", "p_type").alias("text"))
        .distinct()
        .select(F.col("text").alias("query_id"), "text")
    )
    return _shown(match_lite(asked, corpus, fitted(corpus), CFG))


# --- evaluation -------------------------------------------------------------------------


def _one_metric(spark, sf_dir, name):
    rows = metric_rows(spark, sf_dir, names=(name,))
    return rows.select("query_id", "k", round6(F.col("value")).alias("value"), "valid")


@query
def ndcg_at_k(spark, sf_dir):
    return _one_metric(spark, sf_dir, "ndcg")


@query
def precision_at_k(spark, sf_dir):
    return _one_metric(spark, sf_dir, "precision")


@query
def recall_at_k(spark, sf_dir):
    return _one_metric(spark, sf_dir, "recall")


@query
def mrr(spark, sf_dir):
    return _one_metric(spark, sf_dir, "mrr").drop("k")


@query
def map_score(spark, sf_dir):
    return _one_metric(spark, sf_dir, "map").drop("k")


@query
def ari(spark, sf_dir):
    return _one_metric(spark, sf_dir, "ari").drop("k")


@query
def nmi(spark, sf_dir):
    return _one_metric(spark, sf_dir, "nmi").drop("k")


@query
def purity(spark, sf_dir):
    return _one_metric(spark, sf_dir, "purity").drop("k")


@query
def source_metrics(spark, sf_dir):
    """Documents of each source by length, against their labels, at two thresholds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    results = docs.select(
        F.col("source").alias("query_id"),
        F.col("doc_id").alias("item_id"),
        F.col("n_chars").cast("double").alias("score"),
    )
    ranking = materialize(rank_results(results), "ranking")
    labels = table(spark, sf_dir, "labels").join(docs, "doc_id")
    truth = labels.select(
        F.col("source").alias("query_id"),
        F.col("doc_id").alias("item_id"),
        (F.col("quality") + F.col("toxic")).cast("double").alias("relevance"),
    )
    truth = materialize(truth, "truth")
    return M.evaluate(ranking, truth, K_VALUES, (1.0, 2.0)).select(
        "query_id", "metric", "k", "threshold", round6(F.col("value")).alias("value"), "valid"
    )


@query
def evaluate_all(spark, sf_dir):
    return metric_means(spark, sf_dir, THRESHOLDS).withColumn(
        "value", round6(F.col("value"))
    )


@query
def metric_series(spark, sf_dir):
    series = M.metric_series(metric_means(spark, sf_dir))
    return series.select(
        "k", *[round6(F.col(c)).alias(c) for c in ("ndcg", "precision", "recall")]
    )


@query
def metric_bars(spark, sf_dir):
    return M.metric_bars(metric_means(spark, sf_dir)).withColumn(
        "value", round6(F.col("value"))
    )


@query
def evaluation_report(spark, sf_dir):
    return M.evaluation_report(metric_means(spark, sf_dir))


@query
def best_threshold(spark, sf_dir):
    rows = metric_rows(spark, sf_dir, THRESHOLDS, ("precision", "recall"))
    best = M.best_threshold(M.averages(rows, K_VALUES, THRESHOLDS, ("precision", "recall")), K_VALUES)
    return best.select(
        "threshold", *[round6(F.col(c)).alias(c) for c in ("f1", "precision", "recall")]
    )


def _part_items(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("item_id"),
        F.col("p_name").alias("title"),
        F.col("p_partkey").alias("seq"),
    )


@query
def title_mapping(spark, sf_dir):
    return title_map(_part_items(spark, sf_dir))


@query
def word_overlap_match(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    wanted = part.select(F.concat_ws(" ", "p_type", "p_name").alias("title")).unionByName(
        part.select(F.col("p_brand").alias("title"))
    )
    mapping = materialize(title_map(_part_items(spark, sf_dir)), "titles")
    return best_overlap(wanted, mapping)


@query
def word_overlap_scores(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    both = F.concat_ws(" ", "p_type", "p_name")
    return part.select(
        "p_partkey", overlap_score(both, F.col("p_name")).alias("with_name"),
        overlap_score(both, F.col("p_type")).alias("with_type"),
    )


@query
def sampled_truth(spark, sf_dir):
    return sample_truth(corpus_of(spark, sf_dir))


@query
def evaluated_model(spark, sf_dir):
    corpus = stored_corpus(spark, sf_dir)
    return evaluate_model(corpus, fitted(corpus)).withColumn("value", round6(F.col("value")))


# --- reports ------------------------------------------------------------------------------


@query
def scan_summary_rows(spark, sf_dir):
    return scan_summary(matched(spark, sf_dir)).withColumn(
        "rank", F.col("rank").cast("bigint")
    )


@query
def overall_summary_row(spark, sf_dir):
    return overall_summary(matched(spark, sf_dir), queries_of(spark, sf_dir))


@query
def overall_summary_lines(spark, sf_dir):
    return summary_lines(overall_summary(matched(spark, sf_dir)))


@query
def comparison(spark, sf_dir):
    series = comparison_series(materialize(matched(spark, sf_dir), "matches"))
    return series.select(
        "document",
        round6(F.col("avg_similarity")).alias("avg_similarity"),
        round6(F.col("overall_average")).alias("overall_average"),
    )


@query
def match_lines(spark, sf_dir):
    return result_lines(matched(spark, sf_dir)).withColumn(
        "rank", F.col("rank").cast("bigint")
    )


# --- sources and sinks ----------------------------------------------------------------------


def _page_files(spark, sf_dir):
    """Pages as document files; every fourth kind of file is one no extractor takes."""
    pages = table(spark, sf_dir, "pages")
    ext = F.element_at(
        F.array(*[F.lit(e) for e in (".pdf", ".DOCX", ".doc", ".txt")]),
        (F.length("html") % 4 + 1).cast("int"),
    )
    return pages.select(
        F.concat(F.lit("/scan/page_"), F.col("page_id"), ext).alias("path"),
        F.encode("html", "UTF-8").alias("content"),
    )


@query
def extract_pages(spark, sf_dir):
    documents = reject_unsupported(_page_files(spark, sf_dir))
    extracted = materialize(extract_text(documents, html_pages), "extracted")
    return describe_texts(extracted).select(
        "name", "stem", F.col("n_chars").cast("bigint").alias("n_chars"), "text_hash", "error"
    )


@query
def scan_pages(spark, sf_dir):
    corpus = stored_corpus(spark, sf_dir)
    model = fitted(corpus)
    documents, matches = process_documents(
        _page_files(spark, sf_dir),
        lambda q: match_lite(q, corpus, model, CFG),
        html_pages,
    )
    every = documents.select(F.col("query_id").alias("cv_file"), "error")
    return every.join(scan_summary(matches), "cv_file", "left").select(
        "cv_file", "error", F.col("rank").cast("bigint").alias("rank"), "match_title", "similarity"
    )


@query
def file_kinds(spark, sf_dir):
    files = _page_files(spark, sf_dir).select("path", F.length("content").alias("length"))
    return file_formats(files).withColumn("size_mb", round6(F.col("size_mb")))


@query
def path_parts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id",
        base_stem(F.col("url")).alias("stem"),
        extension(F.col("url")).alias("ext"),
    )


@query
def ground_truth_load(spark, sf_dir):
    """Truth written as CSV and read back; a second, later row replaces the first."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    labels = table(spark, sf_dir, "labels").join(docs, "doc_id")

    def rows(grade):
        return labels.select(
            F.col("source").alias("resume_id"),
            F.col("doc_id").alias("job_id"),
            grade.alias("relevance"),
        )

    path = scratch_path(spark, "truth")
    write_csv(rows(F.col("quality")), f"{path}/a")
    write_csv(rows(F.col("quality") + F.col("toxic")), f"{path}/b")
    return load_ground_truth(spark, f"{path}/[ab]").drop("seq")


@query
def person_csv_corpus(spark, sf_dir):
    """The person tables written as CSV files, read back by name, and prepared."""
    # Two files are written from the parts; joined once.
    parts = person_parts(spark, sf_dir).select("person_id", "p_name", "p_type", "seq")
    tables = person_tables(spark, sf_dir, materialize(parts, "parts"))
    folder = scratch_path(spark, "persons")
    names = {
        "people": "01_people.csv",
        "abilities": "02_abilities.csv",
        "experience": "04_experience.csv",
        "skills": "05_person_skills.csv",
    }
    for key, name in names.items():
        df = tables[key]
        if "seq" in df.columns:
            value = next(c for c in df.columns if c not in ("person_id", "seq"))
            df = df.orderBy("seq", value).drop("seq")
        write_csv(df, f"{folder}/{name}")
    corpus = prepare_corpus(**read_person_tables(spark, folder))
    write_csv(corpus, f"{folder}/processed.csv")
    return load_processed(spark, f"{folder}/processed.csv").select(
        "person_id", "ability", "title", "skill", "embedding_text"
    )


@query
def json_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "matches")
    write_json(matched(spark, sf_dir), path, {"top_n": CFG.top_n})
    return read_lines(spark, path, MATCH_SCHEMA)


@query
def index_roundtrip(spark, sf_dir):
    """The index written, reopened without a rebuild, and used."""
    # Read for two versions and for the index.
    corpus = stored_corpus(spark, sf_dir)
    path = scratch_path(spark, "index")
    open_index(corpus, path, CFG)
    index = open_index(corpus, path, CFG)
    matches = match_documents(
        queries_of(spark, sf_dir), index.corpus, index.model, CFG, index.embeddings
    )
    out = f"{path}/matches"
    write_matches(matches.drop("embedding_text", "score"), out)
    return _shown(read_matches(spark, out, MATCH_SCHEMA))


@query
def index_by_key(spark, sf_dir):
    """Titles and texts stored by id, opened again, and joined to the matches in place."""
    path = scratch_path(spark, "by_key")
    write_by_key(corpus_of(spark, sf_dir), path)
    corpus = open_by_key(spark, path)
    return _shown(match_lite(queries_of(spark, sf_dir), corpus, fitted(corpus), CFG))


def _earlier(corpus: DataFrame) -> DataFrame:
    """The corpus as it may have been: some rows not there yet, some with another text or title,
    and some that have gone since."""
    third = F.pmod("id", F.lit(3))
    before = corpus.where(third != 0).select(
        "id",
        F.when(third == 1, F.col("title")).otherwise("Former Title").alias("title"),
        F.when(F.pmod("id", F.lit(5)) == 0, F.concat(F.lit("former "), "embedding_text"))
        .otherwise(F.col("embedding_text")).alias("embedding_text"),
    )
    gone = corpus.where(third == 0).select((-F.col("id") - 1).alias("id"), "title", "embedding_text")
    return before.unionByName(gone)


@query
def index_grown(spark, sf_dir):
    """An index brought up to date by its differences, and used like one built anew."""
    corpus = stored_corpus(spark, sf_dir)
    path = scratch_path(spark, "grown")
    update_index(_earlier(corpus), path, CFG)
    update_index(corpus, path, CFG)
    compact(spark, path)
    index = load_growing(spark, path)
    return _shown(match_lite(queries_of(spark, sf_dir), index.corpus, index.model, CFG, index.vectors))


@query
def index_terms_grown(spark, sf_dir):
    """The vocabulary of an index after rows were added, changed and removed."""
    corpus = stored_corpus(spark, sf_dir)
    path = scratch_path(spark, "grown")
    update_index(_earlier(corpus), path, CFG)
    update_index(corpus, path, CFG)
    return _terms(load_growing(spark, path).vocabulary)


@query
def index_changes(spark, sf_dir):
    """What each of three updates did to an index; the last one finds nothing to do."""
    corpus = stored_corpus(spark, sf_dir)
    path = scratch_path(spark, "grown")
    done = [update_index(c, path, CFG) for c in (_earlier(corpus), corpus, corpus)]
    rows = [(i, d.version, d.added, d.changed, d.removed) for i, d in enumerate(done, 1)]
    return spark.createDataFrame(rows, "step int, version int, added bigint, changed bigint, removed bigint")


@query
def corpus_prints(spark, sf_dir):
    return corpus_fingerprint(corpus_of(spark, sf_dir))


@query
def artifact_inventory(spark, sf_dir):
    """The artifacts of an index by kind; how many files a task writes doesn't show."""
    path = scratch_path(spark, "index")
    build_index(corpus_of(spark, sf_dir), path, CFG)
    files = list_files(spark, path).filter(F.col("length") > 0)
    part = F.regexp_extract("path", r"/(\w+)/[^/]+$", 1)
    return files.select(part.alias("artifact"), extension(F.col("path")).alias("ext")).distinct()


@query
def newest_artifact(spark, sf_dir):
    """The newest of several artifacts, by its folder and its rows."""
    path = scratch_path(spark, "artifacts")
    for name, folder in (("labels", "tfidf_enhanced_a"), ("benchmark", "tfidf_enhanced_b")):
        table(spark, sf_dir, name).write.json(f"{path}/{folder}")
    newest = latest_artifact(spark, path, "part-*.json").first().path
    folder = newest.rsplit("/", 2)[-2]
    rows = read_lines(spark, f"{path}/{folder}", "item_id bigint, text string")
    return rows.select(F.lit(folder).alias("artifact"), "item_id", F.md5("text").alias("text_md5"))


@query
def batch_summary_written(spark, sf_dir):
    """The rows of the batch summary as written and read back."""
    path = scratch_path(spark, "summary")
    write_csv(scan_summary(matched(spark, sf_dir)), path)
    return csv_rows(spark, path, multi_line=True).select(
        F.col("cv_file").cast("bigint").alias("cv_file"),
        F.col("rank").cast("bigint").alias("rank"),
        "match_title",
        F.col("similarity").cast("double").alias("similarity"),
        "match_details",
    )


@query
def overall_summary_written(spark, sf_dir):
    path = scratch_path(spark, "overall")
    write_table(overall_summary(matched(spark, sf_dir)), path, {"top_n": CFG.top_n})
    return spark.read.parquet(path)


@query
def report_envelope(spark, sf_dir):
    """The overall summary as one JSON document with its metadata, read back."""
    path = scratch_path(spark, "report")
    summary = overall_summary(matched(spark, sf_dir))
    write_envelope(summary, path, {"top_n": CFG.top_n})
    return read_envelope(spark, path, ", ".join(f"{n}: {kind}" for n, kind in summary.dtypes))


@query
def matches_envelope(spark, sf_dir):
    """A whole match table as one JSON document, written and read by several tasks."""
    path = scratch_path(spark, "document")
    shown = match_lite_documents(spark, sf_dir)
    write_envelope_table(shown, path, {"top_n": CFG.top_n})
    return read_envelope_table(spark, path, shown.schema, split_bytes=1 << 20)


@query
def metrics_written(spark, sf_dir):
    """The averages as written with their time, and read back without it."""
    path = scratch_path(spark, "metrics")
    write_metrics(metric_means(spark, sf_dir), path)
    schema = "metric string, k bigint, threshold double, value double, queries bigint, written_at timestamp"
    rows = read_lines(spark, path, schema).filter(F.col("written_at").isNotNull())
    return rows.select("metric", "k", "threshold", round6(F.col("value")).alias("value"), "queries")


@query
def threshold_written(spark, sf_dir):
    rows = metric_rows(spark, sf_dir, THRESHOLDS, ("precision", "recall"))
    means = M.averages(rows, K_VALUES, THRESHOLDS, ("precision", "recall"))
    path = scratch_path(spark, "threshold")
    write_threshold(M.best_threshold(means, K_VALUES), path, K_VALUES)
    names = ("threshold", "f1", "precision", "recall")
    found = read_lines(spark, path, ", ".join(f"{n} double" for n in names))
    return found.select("threshold", *[round6(F.col(c)).alias(c) for c in names[1:]])


@query
def csv_line_breaks(spark, sf_dir):
    """Whole texts, line breaks and quotes included, through CSV files."""
    path = scratch_path(spark, "texts")
    write_csv(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), path)
    rows = csv_rows(spark, path, multi_line=True)
    return rows.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.md5("text").alias("text_md5"), "source"
    )


@query
def processed_corpus_load(spark, sf_dir):
    """A processed corpus stored as Parquet, loaded with its columns checked."""
    path = scratch_path(spark, "processed")
    prepare_corpus(**person_tables(spark, sf_dir)).write.parquet(path)
    return load_processed(spark, path).select(
        "person_id", "ability", "title", "skill", "embedding_text"
    )


@query
def capped_profiles(spark, sf_dir):
    """Profiles of the persons up to a highest id."""
    half = table(spark, sf_dir, "customer").agg(F.floor(F.avg("c_custkey"))).first()[0]
    return join_profiles(**person_tables(spark, sf_dir), cfg=EngineConfig(max_person_id=int(half)))


@query
def fallback_extraction(spark, sf_dir):
    """Pages that the first extractor can't read, or finds empty, go to the second."""

    def first(content: bytes) -> list[str]:
        if len(content) % 3 == 0:
            raise ValueError("unreadable")
        return [] if len(content) % 3 == 1 else html_pages(content)

    documents = reject_unsupported(_page_files(spark, sf_dir))
    extracted = extract_text(documents, first, html_pages)
    return describe_texts(materialize(extracted, "extracted")).select(
        "name", "stem", F.col("n_chars").cast("bigint").alias("n_chars"), "text_hash", "error"
    )


@query
def folder_scan(spark, sf_dir):
    """Documents written as files, one per passage, and found again by the folder scan."""
    path = scratch_path(spark, "folder")
    items = table(spark, sf_dir, "benchmark")
    name = F.concat(F.lit("i"), F.col("item_id"), F.element_at(F.array(F.lit("doc"), F.lit("txt")), (F.col("item_id") % 2 + 1).cast("int")))
    items.select(F.col("text").alias("value"), name.alias("name")).write.partitionBy("name").text(path)
    found = scan_folder(spark, f"{path}/*", (".txt",))
    return found.select(
        F.regexp_extract("path", r"name=(\w+)/", 1).alias("name"),
        F.md5("content").alias("content_md5"),
    )


@query
def files_streamed(spark, sf_dir):
    """Passages that arrive as files in a few batches, matched and committed; every other file
    is of a format that no extractor takes."""
    path = scratch_path(spark, "arrivals")
    items = table(spark, sf_dir, "benchmark")
    ext = F.when(F.pmod("item_id", F.lit(2)) == 0, ".doc").otherwise(".txt")
    named = items.select(F.col("text").alias("value"), F.concat(F.lit("i"), "item_id", ext).alias("name"))
    named.write.partitionBy("name").text(f"{path}/in")
    corpus = stored_corpus(spark, sf_dir)
    model = fitted(corpus)
    vectors = corpus.select("id", model.vector(F.col("embedding_text")).alias("vector"))
    vectors = materialize(vectors, "vectors")
    scan_stream(
        spark,
        f"{path}/in",
        lambda batch: match_lite(batch, corpus, model, CFG, vectors),
        f"{path}/out",
        f"{path}/state",
        lambda content: [content.decode()],
        name=lambda p: F.regexp_extract(p, "name=([^/]+)/", 1),
        max_files=500,
    ).awaitTermination()
    every = scanned_documents(spark, f"{path}/out").select(F.col("query_id").alias("cv_file"), "error")
    summary = scan_summary(scanned_matches(spark, f"{path}/out"))
    return every.join(summary, "cv_file", "left").select(
        "cv_file", "error", F.col("rank").cast("bigint").alias("rank"), "match_title", "similarity"
    )


@query
def inline_texts(spark, sf_dir):
    """Texts given in the program and every benchmark passage, matched with the whole corpus."""
    corpus = stored_corpus(spark, sf_dir)
    passages = queries_of(spark, sf_dir).withColumn("query_id", F.concat(F.lit("b"), "query_id"))
    asked = text_queries(spark, INLINE_TEXTS).unionByName(passages)
    return _shown(match_lite(asked, corpus, fitted(corpus), CFG))


def letter_encoder():
    """A stand-in for a user's encoder: how often each letter from a to h occurs."""
    import numpy as np

    return lambda texts: np.array([[1.0 + t.count(c) for c in "abcdefgh"] for t in texts])


@query
def user_encoder(spark, sf_dir):
    """Whole texts, not cut into chunks, embedded by an encoder that the user brings."""
    corpus = stored_corpus(spark, sf_dir)
    vectors = corpus.select("id", encode_chunks(F.array("embedding_text"), letter_encoder).alias("v"))
    return vectors.select("id", F.posexplode("v").alias("pos", "value")).select(
        "id", F.col("pos").cast("bigint").alias("pos"), F.round(F.col("value").cast("double"), 4).alias("value")
    )


@query
def unchunked_embedding(spark, sf_dir):
    """The built-in encoder over whole boosted texts."""
    corpus = stored_corpus(spark, sf_dir)
    embedded = embed(corpus, fitted(corpus), "embedding_text", CFG, use_chunking=False)
    cells = embedded.select("id", F.posexplode_outer("embedding").alias("pos", "value"))
    return cells.select(
        "id",
        F.col("pos").cast("bigint").alias("pos"),
        round6(F.col("value").cast("double")).alias("value"),
    ).filter(F.col("value") != 0)


@query
def match_streamed(spark, sf_dir):
    """Conversation turns arriving as a stream, matched against stored vectors."""
    path = scratch_path(spark, "stream")
    corpus = stored_corpus(spark, sf_dir)
    model = fitted(corpus)
    vectors = corpus.select("id", model.vector(F.col("embedding_text")).alias("vector"))
    vectors = materialize(vectors, "vectors")
    turns = table(spark, sf_dir, "conversations")
    arrivals = (
        spark.readStream.schema(turns.schema)
        .parquet(f"{sf_dir}/conversations*.parquet")
        .select(F.concat_ws("-", "conv_id", "turn").alias("query_id"), "text")
    )
    match_stream(
        arrivals,
        lambda batch: match_lite(batch, corpus, model, CFG, vectors),
        f"{path}/out",
        f"{path}/state",
    ).awaitTermination()
    return _shown(spark.read.parquet(f"{path}/out"))
