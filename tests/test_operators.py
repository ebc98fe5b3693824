"""Operators against brute force on small tables, skewed ones among them."""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textmatch.config import EngineConfig
from textmatch.operators import cells, similarity, tfidf
from textmatch.operators.cells import in_cells
from textmatch.operators.chunking import chunks, register_chunks
from textmatch.operators.nearest import build_inverted_file, scored_pairs, search
from textmatch.operators.overlap import best_overlap, overlap_candidates, overlap_score, title_map
from textmatch.operators.pooling import mean_pool
from textmatch.operators.ranking import dedup_titles, rank_ranges, rank_results
from textmatch.operators.relational import (
    clean_columns,
    column_profile,
    content_dedup,
    dedup_stats,
    filter_max_id,
    group_concat_distinct,
    require_columns,
)
from textmatch.operators.sampling import sample_texts, sample_truth
from textmatch.operators.similarity import all_scores, top_k
from textmatch.operators.summary import overall_summary
from textmatch.operators.tfidf import TfidfModel, boost_text, top_terms, vocabulary
from textmatch.plans.corpus import prepare_corpus
from textmatch.plans.evaluate import evaluate_model
from textmatch.plans.match import embed, match_documents, match_lite

LOOSE = EngineConfig(min_df=1, max_df=1.0, dim=64)


# --- relational -------------------------------------------------------------------------


def test_require_columns(spark):
    with pytest.raises(ValueError, match="b"):
        require_columns(spark.range(1), ["id", "b"])


def test_filter_and_clean(spark):
    df = spark.createDataFrame([(1, "a!"), (9, None)], "person_id long, x string")
    rows = clean_columns(filter_max_id(df, 5)).collect()
    assert [tuple(r) for r in rows] == [(1, "a")]
    assert filter_max_id(df.drop("person_id"), 5).count() == 2


def test_group_concat_keeps_first_seen_order(spark):
    rng = random.Random(1)
    # One key holds a third of the rows.
    rows = [
        (0 if n % 3 == 0 else rng.randint(1, 40), n, rng.choice(["x", "y", "", None, "z"]))
        for n in range(3000)
    ]
    df = spark.createDataFrame(rows, "k int, seq int, v string").repartition(8)
    got = {r.k: r.v for r in group_concat_distinct(df, "k", ["v"], ["seq"]).collect()}
    want = {}
    for k, _, v in rows:
        seen = want.setdefault(k, [])
        if v is not None and v not in seen:
            seen.append(v)
    assert got == {k: "; ".join(v) for k, v in want.items()}
    dropped = group_concat_distinct(df, "k", ["v"], ["seq"], drop_empty=True).collect()
    assert {r.k: r.v for r in dropped} == {
        k: "; ".join(x for x in v if x) for k, v in want.items()
    }


def test_group_concat_empty_table_keeps_its_schema(spark):
    df = spark.createDataFrame([], "k int, seq int, v string")
    assert group_concat_distinct(df, "k", ["v"], ["seq"]).columns == ["k", "v"]


def test_content_dedup(spark):
    rows = [(n, "same", None) for n in range(100, 0, -1)] + [(500, "other", "x")]
    df = spark.createDataFrame(rows, "person_id int, a string, b string")
    assert sorted(r.person_id for r in content_dedup(df).collect()) == [1, 500]
    assert tuple(dedup_stats(df).first()) == (101, 2, 99, 98.02)


def test_column_profile(spark):
    df = spark.createDataFrame([(n, "ab"[n % 2]) for n in range(300)], "n long, s string")
    rows = {r.column_name: r for r in column_profile(df, exact=True).collect()}
    assert rows["n"].suggested_type == "smallint" and rows["n"].distinct_values == 300
    assert rows["s"].low_cardinality and rows["s"].suggested_type == "dictionary"


def test_prepare_corpus(spark):
    people = spark.createDataFrame(
        [(1, "n"), (2, "n"), (3, "n"), (4, "n")], "person_id int, name string"
    )
    abilities = spark.createDataFrame(
        [(1, "b", 1), (1, "a", 2), (1, "b", 3), (2, "b", 4), (2, "a", 5), (4, None, 6)],
        "person_id int, ability string, seq int",
    )
    experience = spark.createDataFrame(
        [(1, "Sr. Dev; x", 1), (2, "Sr. Dev; y", 2)], "person_id int, title string, seq int"
    )
    skills = spark.createDataFrame(
        [(4, None, 1), (4, "Py", 2)], "person_id int, skill string, seq int"
    )
    rows = {
        r.person_id: r for r in prepare_corpus(people, abilities, experience, skills).collect()
    }
    # Persons 1 and 2 have the same content; the lower id stays.
    assert sorted(rows) == [1, 3, 4]
    assert rows[1].embedding_text == "b; a | DevDevDev | Unknown skill"
    assert tuple(rows[3])[1:4] == ("Unknown ability", "Unknown Title", "Unknown skill")
    assert rows[4].skill == "; Py" and rows[4].ability == ""


# --- terms --------------------------------------------------------------------------------


def test_vocabulary_prunes_and_caps(spark):
    docs = spark.createDataFrame(
        [("red fox",), ("red fox",), ("red cat",), ("red dog",)], "text string"
    )
    kept = vocabulary(docs, cfg=EngineConfig(min_df=2, max_df=0.75)).collect()
    assert {r.term for r in kept} == {"fox", "red fox"}
    assert kept[0].idf == pytest.approx(math.log(5 / 3) + 1)
    capped = vocabulary(docs, cfg=EngineConfig(min_df=1, max_df=1.0, max_features=2))
    assert [r.term for r in capped.orderBy(F.desc("ctf")).collect()] == ["red", "fox"]


def test_vectors_are_unit_and_boost_orders_terms(spark):
    docs = spark.createDataFrame(
        [(1, "red fox jumps"), (2, "blue fox"), (3, "the")], "id int, text string"
    )
    model = TfidfModel.fit(docs, cfg=LOOSE)
    rows = docs.select("id", "text", model.vector(F.col("text")).alias("v"))
    got = {r.id: r.v for r in rows.collect()}
    assert [x.term for x in got[2]] == ["blue", "blue fox", "fox"] and got[3] == []
    assert sum(x.weight**2 for x in got[1]) == pytest.approx(1.0)
    out = rows.select(
        "id",
        boost_text(F.col("text"), F.col("v")).alias("all"),
        boost_text(F.col("text"), F.col("v"), n=2, sep=" ").alias("two"),
        top_terms(F.col("v"), 2).alias("top"),
    )
    two = {r.id: r for r in out.collect()}[2]
    times = {x.term: min(5, max(1, int(x.weight * 10))) for x in got[2]}
    assert two["all"] == "blue fox " + " ".join(t * n for t, n in times.items())
    assert [x.term for x in two.top] == ["blue", "blue fox"]
    heavy = [" ".join([t] * times[t]) for t in ("blue fox", "blue")]
    assert two.two == "blue fox " + " ".join(heavy)


# --- top-k --------------------------------------------------------------------------------


def ranked(df):
    rows = df.orderBy("query_id", "rank").collect()
    out = {}
    for r in rows:
        out.setdefault(r.query_id, []).append((r.id, round(r.score, 6)))
    return out


def test_dense_top_k_with_a_third_of_the_rows_alike(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(900, 8)).round(3)
    m[::3] = m[0]
    m[5] = 0.0
    data = [(int(i), [float(x) for x in m[i]]) for i in rng.permutation(900)]
    corpus = spark.createDataFrame(data, "id int, vector array<double>").repartition(8)
    queries = corpus.filter("id < 40").withColumnRenamed("id", "query_id")
    length = np.linalg.norm(m, axis=1, keepdims=True)
    unit = np.divide(m, length, out=np.zeros_like(m), where=length > 0)
    key = np.floor(unit[:40] @ unit.T * 1e6 + 0.5)
    want = {
        q: [int(i) for i in np.lexsort((np.arange(900), -key[q]))[:7]] for q in range(40)
    }
    for how in ({}, {"block": 3}):
        got = ranked(top_k(queries, corpus, 7, **how))
        assert {q: [i for i, _ in v] for q, v in got.items()} == want


def test_sparse_top_k_matches_brute_force(spark):
    rng = random.Random(2)
    vocab = [f"t{n}" for n in range(30)]

    def vector():
        picked = rng.sample(vocab, rng.randint(0, 6))
        # One term is in most rows.
        picked = sorted(set(picked) | ({"hot"} if rng.random() < 0.8 else set()))
        return [(t, rng.choice([0.25, 0.5, 1.0])) for t in picked]

    kind = "array<struct<term:string,weight:double>>"
    docs = {f"d{n:03}": vector() for n in range(200)}
    asks = {n: vector() for n in range(30)}
    corpus = spark.createDataFrame(list(docs.items()), f"id string, vector {kind}")
    queries = spark.createDataFrame(list(asks.items()), f"query_id int, vector {kind}")

    def score(a, b, cosine):
        a, b = dict(a), dict(b)
        dot = sum(w * b[t] for t, w in a.items() if t in b)
        size = math.sqrt(sum(w * w for w in a.values()) * sum(w * w for w in b.values()))
        return dot if not cosine else (dot / size if size else 0.0)

    for name, cosine in (("sparse", False), ("sparse_cosine", True)):
        want = {}
        for q, v in asks.items():
            all_scores = [(d, math.floor(score(v, w, cosine) * 1e6 + 0.5)) for d, w in docs.items()]
            want[q] = [d for d, _ in sorted(all_scores, key=lambda x: (-x[1], x[0]))[:6]]
        for how in ({}, {"block": 7}):
            got = ranked(top_k(queries, corpus, 6, name, **how))
            assert {q: [i for i, _ in v] for q, v in got.items()} == want


def test_top_k_without_queries_or_corpus(spark):
    some = spark.createDataFrame([(1, [1.0])], "id int, vector array<double>")
    none = some.limit(0)
    asked = some.withColumnRenamed("id", "query_id")
    assert top_k(asked.limit(0), some, 3).count() == 0
    assert top_k(asked, none, 3).count() == 0


def test_mean_pool(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [2.0, 2.0])]
    df = spark.createDataFrame(rows, "k int, embedding array<float>")
    got = {r.k: r.vector for r in mean_pool(df, "k").collect()}
    assert got == {1: [0.5, 0.5], 2: [2.0, 2.0]}


# --- ranking, overlap, samples --------------------------------------------------------------


def test_dedup_titles(spark):
    rows = [
        ("q", 1, "Front End Dev", 50.0),
        ("q", 2, "Frontend Developer", 60.0),
        ("q", 3, "Analyst", 60.0),
        ("q", 4, "Clerk", 10.0),
    ]
    schema = "query_id string, id int, title string, similarity_percentage double"
    df = spark.createDataFrame(rows, schema)
    got = [(r.id, r["rank"]) for r in dedup_titles(df, 2).orderBy("rank").collect()]
    assert got == [(2, 1), (3, 2)]
    assert dedup_titles(df.drop("title")).columns == df.drop("title").columns
    assert dedup_titles(df, None, "lite").count() == 4


def test_rank_results(spark):
    rows = [("q", "b", 1.0), ("q", "a", 1.0), ("q", "c", 2.0)]
    df = spark.createDataFrame(rows, "query_id string, item_id string, score double")
    got = [r.item_id for r in rank_results(df, 2).orderBy("rank").collect()]
    assert got == ["c", "a"]


def test_full_ranking_of_long_lists(spark):
    rng = random.Random(4)
    rows = [("long", f"i{n:05}", float(rng.choice([rng.randint(0, 50), 7]))) for n in range(6000)]
    rows += [("short", f"i{n}", 1.0) for n in range(3)] + [("one", "x", 0.0)]
    df = spark.createDataFrame(rows, "query_id string, item_id string, score double")
    got = {(r.query_id, r.item_id): r["rank"] for r in rank_results(df).collect()}
    want = {}
    for q in ("long", "short", "one"):
        mine = sorted((r for r in rows if r[0] == q), key=lambda r: (-r[2], r[1]))
        want.update({(q, r[1]): place for place, r in enumerate(mine, 1)})
    assert got == want


def test_equal_scores_are_dealt_over_many_tasks(spark):
    rng = random.Random(5)
    scores = [0.0 if rng.random() < 0.9 else rng.random() for _ in range(20_000)]
    rows = [("q", f"i{n:05}", s) for n, s in enumerate(scores)]
    df = spark.createDataFrame(rows, "query_id string, item_id string, score double")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in rank_ranges(df).groupBy("_range").count().collect()]
        got = {r.item_id: r["rank"] for r in rank_results(df).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) > 4 and max(sizes) < 2 * len(rows) / len(sizes)
    assert got == {r[1]: n for n, r in enumerate(sorted(rows, key=lambda r: (-r[2], r[1])), 1)}


def test_all_scores_hold_every_pair(spark):
    rows = [(i, [float(i), 1.0]) for i in range(30)]
    corpus = spark.createDataFrame(rows, "id int, vector array<double>")
    asked = corpus.filter("id < 5").withColumnRenamed("id", "query_id")
    got = {(r.query_id, r.id): r.score for r in all_scores(asked, corpus, block=2).collect()}
    assert len(got) == 150 and all(abs(got[(q, q)] - 1) < 1e-9 for q in range(5))


def test_a_vocabulary_is_never_cut(spark):
    table = spark.range(30).selectExpr("concat('t', id) AS term", "1.0D AS idf")
    assert len(TfidfModel(table, EngineConfig(max_features=30)).lookup.value.terms) == 30
    with pytest.raises(ValueError, match="max_features"):
        TfidfModel(table, EngineConfig(max_features=10))


def test_best_overlap(spark):
    items = spark.createDataFrame(
        [("j1", "Data Analyst", 1), ("j2", "data engineer", 2), ("j3", "DATA ANALYST", 3)],
        "item_id string, title string, seq int",
    )
    mapping = title_map(items)
    assert {tuple(r) for r in mapping.collect()} == {
        ("data analyst", "j3", 1), ("data engineer", "j2", 2),
    }
    titles = spark.createDataFrame([("Data Chef",), ("Senior Data Engineer",), ("Zoo",)], "title string")
    got = {r.title: (r.item_id, r.overlap) for r in best_overlap(titles, mapping).collect()}
    assert got["data chef"] == ("j3", 1) and got["senior data engineer"] == ("j2", 2)
    assert got["zoo"][0].startswith("job_") and got["zoo"][1] == 0
    score = titles.select(overlap_score(F.col("title"), F.lit("data engineer"))).collect()
    assert sorted(r[0] for r in score) == [0, 1, 2]


def test_samples_are_stable(spark):
    corpus = spark.createDataFrame(
        [(n, f"t{n % 3}", f"text {n}") for n in range(50)],
        "id int, title string, embedding_text string",
    )
    truth = sample_truth(corpus, 4, 7)
    first = sorted(map(tuple, truth.collect()))
    assert first == sorted(map(tuple, sample_truth(corpus.repartition(5), 4, 7).collect()))
    assert len(first) == 28 and {r[4] for r in first} <= {0.0, 1.0, 2.0, 3.0}
    assert {r[2] for r in first if r[1] in ("job_0", "job_3", "job_6")} == {"t0"}
    assert sample_texts(corpus, 5).count() == 5


def test_overall_summary_without_results(spark):
    schema = "query_id string, similarity_percentage double"
    row = overall_summary(spark.createDataFrame([], schema)).first()
    assert tuple(row) == (0, 0.0, 0.0, 100.0, 0.0, 100.0, 0.0)


# --- plans ----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def small(spark):
    rng = random.Random(4)
    pool = [f"w{n}" for n in range(60)]
    rows = [
        (n, f"Title {chr(97 + n % 9)}", " ".join(rng.choices(pool, k=rng.randint(3, 700))))
        for n in range(60)
    ]
    return spark.createDataFrame(rows, "id int, title string, embedding_text string")


def test_match_finds_the_document_itself(spark, small):
    cfg = EngineConfig(min_df=1, max_df=1.0, dim=256, top_n=3)
    model = TfidfModel.fit(small, "embedding_text", cfg)
    asked = small.select(F.col("id").alias("query_id"), F.col("embedding_text").alias("text"))
    for run in (match_documents, match_lite):
        rows = run(asked, small, model, cfg).collect()
        firsts = {r.query_id: r for r in rows if r["rank"] == 1}
        assert all(r.id == q for q, r in firsts.items()) and len(firsts) == 60
        assert all(0 <= r.similarity_percentage <= 100 for r in rows)
        titles = {(r.query_id, r.title.lower()) for r in rows}
        assert len(titles) == len(rows) and max(r["rank"] for r in rows) <= 3


def test_user_encoder(spark, small):
    def factory():
        def encode(texts):
            return np.array([[len(t), t.count("w1"), 1.0] for t in texts], dtype=float)

        return encode

    model = TfidfModel.fit(small, "embedding_text", LOOSE)
    rows = embed(small, model, "embedding_text", LOOSE, factory).select("embedding").collect()
    assert all(np.linalg.norm(r.embedding) == pytest.approx(1.0, abs=1e-5) for r in rows)


def test_embedding_of_unknown_text_is_zero(spark, small):
    model = TfidfModel.fit(small, "embedding_text", LOOSE)
    df = spark.createDataFrame([("",), (None,), ("zzz zzz",)], "text string")
    rows = embed(df, model, "text", LOOSE).select("embedding").collect()
    assert all(r.embedding == [0.0] * 64 for r in rows)


def test_evaluate_model_with_given_truth(spark, small):
    cfg = EngineConfig(min_df=1, max_df=1.0, dim=128, k_values=(1, 2))
    model = TfidfModel.fit(small, "embedding_text", cfg)
    truth = spark.createDataFrame(
        [("a", "j1", "Title a", 2.0), ("a", "j2", "Title b", 0.0), ("b", "j2", "Title b", 3.0)],
        "query_id string, item_id string, item_title string, relevance double",
    )
    texts = small.filter("id < 2").select(
        F.when(F.col("id") == 0, "a").otherwise("b").alias("query_id"),
        F.col("embedding_text").alias("text"),
    )
    rows = evaluate_model(small, model, truth, texts, cfg, threshold=1.0).collect()
    got = {(r.metric, r.k): r.value for r in rows}
    assert got[("mrr", None)] == 1.0 and got[("ndcg", 1)] == 1.0
    assert all(r.queries == 2 for r in rows)


def test_rows_without_a_vector_take_no_part(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0])]
    corpus = spark.createDataFrame(rows, "id int, vector array<double>")
    queries = corpus.withColumnRenamed("id", "query_id")
    for how in ({}, {"block": 1}):
        got = ranked(top_k(queries, corpus, 5, **how))
        assert got == {1: [(1, 1.0), (3, 0.0)], 3: [(3, 1.0), (1, 0.0)]}


def test_best_overlap_by_brute_force(spark):
    rng = random.Random(11)
    words = ["data", "senior"] + [f"w{i}" for i in range(60)]

    def title():
        some = [rng.choice(words[2:]) for _ in range(rng.randint(0, 4))]
        return " ".join(rng.sample(["Data", "senior", "data"], rng.randint(0, 3)) + some)

    listed = [(f"j{i}", title(), i) for i in range(400)]
    asked = [title() for _ in range(200)] + ["", "data", "none of these"]
    mapping = title_map(spark.createDataFrame(listed, "item_id string, title string, seq int"))
    seqs = {r.title: (r.seq, r.item_id) for r in mapping.collect()}
    titles = spark.createDataFrame([(t,) for t in asked], "title string")
    got = {r.title: (r.item_id, r.overlap) for r in best_overlap(titles, mapping).collect()}
    assert set(got) == {t.lower() for t in asked}
    for t in got:
        scores = {m: len(set(t.split()) & set(m.split())) for m in seqs}
        most = max(scores.values())
        if most:
            first = min(seqs[m] for m, n in scores.items() if n == most)
            assert got[t] == (first[1], most), t
        else:
            assert got[t][1] == 0 and got[t][0].startswith("job_")
    compared = overlap_candidates(titles, mapping).count()
    assert compared < 0.35 * len(got) * len(seqs)


def test_an_inverted_file_holds_every_row_and_finds_most(spark):
    rng = np.random.default_rng(3)
    points = rng.normal(size=(40, 16))[rng.integers(0, 40, 3000)] + 0.4 * rng.normal(size=(3000, 16))
    points[100:1100] = points[7]  # a third of all rows alike
    rows = [(i, v.tolist()) for i, v in enumerate(points)] + [(5000, None), (5001, [0.0] * 16)]
    corpus = spark.createDataFrame(rows, "id int, vector array<double>").repartition(6)
    index = build_inverted_file(corpus, k=5)
    assert index.lists.count() == 3001 and index.sizes.agg(F.sum("n")).first()[0] == 3001
    asked = corpus.where("id % 40 = 3").withColumnRenamed("id", "query_id")
    for how in ({}, {"part_rows": 100, "part_queries": 7}):
        found = {(r.query_id, r.id): r.score for r in search(index, asked, 5, **how).collect()}
        exact = {(r.query_id, r.id): r.score for r in top_k(asked, corpus, 5).collect()}
        both = found.keys() & exact.keys()
        assert len(found) == len(exact) and len(both) >= 0.9 * len(exact)
        assert all(abs(found[x] - exact[x]) < 1e-9 for x in both)
    every = {(r.query_id, r.id) for r in search(index, asked, 5, probes=len(index.centres)).collect()}
    assert every == exact.keys()
    assert scored_pairs(index, asked) < asked.count() * 3001


def test_an_inverted_file_of_nothing(spark):
    none = spark.createDataFrame([], "id int, vector array<double>")
    some = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], "id int, vector array<double>")
    asked = some.withColumnRenamed("id", "query_id")
    assert search(build_inverted_file(none), asked.limit(0), 3).count() == 0
    found = search(build_inverted_file(some), asked, 3, probes=9).collect()
    assert {(r.query_id, r.id) for r in found} == {(1, 1), (1, 2), (2, 1), (2, 2)}


def test_cells_in_rounds_hold_every_pair_once(spark, monkeypatch):
    monkeypatch.setattr(cells, "COPIES", 2)
    queries = spark.range(50).withColumnRenamed("id", "query_id")
    items = spark.range(300).union(spark.range(5))

    def pairs(a, b):
        left, right = np.meshgrid(a.column("query_id").to_numpy(), b.column("id").to_numpy())
        return pa.table({"q": left.ravel(), "i": right.ravel()})

    for query_rows in (7, 25, 100):
        got = in_cells(queries, items, pairs, "q bigint, i bigint", 50, 305, query_rows, 60)
        assert got.count() == 50 * 305 and got.distinct().count() == 50 * 300


def test_chunks_from_sql(spark):
    docs = spark.createDataFrame([(1, "aa bb cc dd"), (2, ""), (3, None), (4, "x" * 25)], "id int, text string")
    register_chunks(spark)
    sql = "SELECT id, chunk_idx, chunk FROM {docs}, LATERAL text_chunks(text, 6, 2)"
    got = sorted(tuple(r) for r in spark.sql(sql, docs=docs).collect())
    want = [(i, *pair) for i, t in ((1, "aa bb cc dd"), (2, ""), (3, None), (4, "x" * 25)) for pair in enumerate(chunks(t, 6, 2))]
    assert got == want and got[0][2] == "aa bb" and got[-1][0] == 4


def test_terms_are_weighed_and_counted_in_bounded_parts():
    from textmatch.operators import tfidf as t

    docs = [["red", "the", "cat"], None, [], ["red", "cat"] * 40, ["cat"], ["blue", "red", "cat"]]
    found = pa.array(docs, pa.list_(pa.string()))
    stop = pa.array(["the"], pa.string())
    assert [len(x) for x in t._parts(found, 5)] == [3, 1, 2]
    nested = pa.array([[d, d] for d in docs], pa.list_(pa.list_(pa.string())))
    assert [len(x) for x in t._parts(nested, 10, 2)] == [2, 1, 1, 2]
    counts = {r["term"]: (r["df"], r["ctf"]) for r in t._counted(found, stop).to_pylist()}
    assert counts["cat"] == (4, 43) and counts["red cat"] == (3, 42) and counts["cat red"] == (1, 39)
    assert "the" not in counts and "red the" not in counts
    model = t._Lookup(["cat", "cat red", "red cat"], np.array([1.0, 2.0, 2.0]), 8, stop)
    sizes = []

    def weigh(part):
        sizes.append(sum(len(x or []) for x in part.to_pylist()))
        return model.vectors(*model.weigh(part), len(part))

    whole = weigh(found)
    sizes.clear()
    many = pa.concat_arrays([found] * 2000)
    assert t._worked(many, weigh, t._VECTORS).equals(pa.concat_arrays([whole] * 2000))
    assert len(sizes) > 1 and max(sizes) <= t._WORDS


def test_python_workers_get_small_batches(spark):
    from textmatch.config import BATCH_BYTES

    docs = spark.createDataFrame([(1, "red cat"), (2, "red dog")], "id bigint, text string")
    TfidfModel.fit(docs, "text", EngineConfig(min_df=1, max_df=1.0))
    size = spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    assert 0 < size <= BATCH_BYTES


def test_boosting_needs_the_heaviest_terms_only(spark):
    words = [f"w{i:02d}" for i in range(30)]
    rows = [(i, " ".join(words[: i + 1] + words[:i:3])) for i in range(30)]
    docs = spark.createDataFrame(rows, "id bigint, text string")
    model = TfidfModel.fit(docs, "text", EngineConfig(min_df=1, max_df=1.0))
    text = F.col("text")
    both = docs.select(
        boost_text(text, model.vector(text)).alias("whole"),
        boost_text(text, model.vector(text, 21)).alias("cut"),
    )
    assert both.where("whole <> cut OR whole IS NULL").isEmpty()


def test_jobs_over_cells_leave_no_shuffle_files(spark, monkeypatch):
    def files():
        env = spark._jvm.org.apache.spark.SparkEnv.get()
        found = env.blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
        return {f for f in found if "/shuffle_" in f and f.endswith(".data")}

    def pairs(a, b):
        left, right = np.meshgrid(a["query_id"].to_numpy(), b["id"].to_numpy())
        return pa.table({"q": left.ravel(), "i": right.ravel()})

    monkeypatch.setattr(cells, "COPIES", 1)
    items = spark.range(40)
    before = files()
    found = in_cells(items.withColumnRenamed("id", "query_id"), items, pairs, "q bigint, i bigint", 40, 40, 8, 40)
    assert not files() - before
    assert found.distinct().count() == 1600
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_a_vocabulary_spells_few_of_the_rare_terms(spark, monkeypatch):
    draw = random.Random(5)
    texts = [
        " ".join(f"w{int(draw.paretovariate(0.7)) % 3000}" for _ in range(draw.randrange(1, 60)))
        for _ in range(400)
    ]
    # Terms of a few documents that no draw shows, some of them as frequent as wanted ones.
    for i in range(0, 40, 10):
        texts[i] = "rare burst " * 80
    texts[50], texts[60] = None, ""
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(5)
    cfg = EngineConfig(max_features=60, min_df=3, max_df=0.9)
    every = tfidf.term_statistics(docs)
    wanted = {tuple(r) for r in tfidf.pruned_vocabulary(every, 400, cfg).collect()}
    assert any(r[0] == "rare burst" for r in wanted)
    for drawn in (2, 40):
        monkeypatch.setattr(tfidf, "_DRAWN", drawn)
        monkeypatch.setattr(tfidf, "_MANY", 0)
        assert {tuple(r) for r in vocabulary(docs, cfg=cfg).collect()} == wanted
    assert tfidf.frequent_statistics(docs, 400, cfg=cfg).count() < every.count() / 4
    empty = docs.where("false")
    assert vocabulary(empty, cfg=cfg).collect() == []


def test_cells_are_shuffled_once(spark):
    """a partition for each cell; cells of few bytes aren't put into one task."""
    items = spark.range(400)

    def pairs(a, b):
        return pa.table({"n": [a.num_rows * b.num_rows]})

    found = in_cells(items.withColumnRenamed("id", "query_id"), items, pairs, "n bigint", 400, 400, 200, 40)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2 and found.rdd.getNumPartitions() == 20
    sizes = [r.n for r in found.collect()]
    assert len(sizes) == 20 and sum(sizes) == 160_000


def test_common_terms_are_multiplied_and_others_looked_up(monkeypatch):
    """whatever terms are taken for common, each query meets each row once."""
    draw = random.Random(4)
    terms = [f"t{int(draw.paretovariate(0.6))}" for _ in range(400)]

    def some(n):
        rows = [sorted(set(draw.sample(terms, draw.randrange(12)))) for _ in range(n)]
        return [{t: draw.random() + 0.1 for t in row} for row in rows]

    def vectors(rows):
        return pa.array([[{"term": t, "weight": w} for t, w in r.items()] for r in rows], kind)

    kind = pa.list_(pa.struct([("term", pa.string()), ("weight", pa.float64())]))
    asked, items = some(60), some(300)
    want = np.array([[sum(w * q.get(t, 0.0) for t, w in r.items()) for q in asked] for r in items])
    length = np.sqrt([[sum(w * w for w in r.values())] for r in items]) * np.sqrt(
        [sum(w * w for w in q.values()) for q in asked]
    )
    unit = np.divide(want, length, out=np.zeros_like(want), where=length > 0)
    monkeypatch.setattr(similarity, "_ACROSS", 7)
    monkeypatch.setattr(similarity, "_NUMBERS", 50)
    widths = []
    for common in (0.0, 0.006, 0.1, 2.0):
        monkeypatch.setattr(similarity, "_COMMON", common)
        for cosine, exact in ((False, want), (True, unit)):
            scorer = similarity._Sparse(vectors(asked), cosine)
            scorer.prepare(vectors(items))
            blocks = list(scorer.scores(vectors(items)))
            assert [lo for lo, _ in blocks] == list(range(0, 60, 7))
            assert np.allclose(np.concatenate([x for _, x in blocks], axis=1), exact, atol=1e-12)
        widths.append(scorer.width)
    assert widths[0] > widths[1] > widths[2] > widths[3] == 0


def test_the_best_of_many_equal_rows(monkeypatch):
    """F1, F2: rows that score alike, also 0, come by their ids, in whatever order they are given."""
    draw = np.random.default_rng(8)
    n = 700
    m = draw.normal(size=(n, 3)).round(2)
    m[draw.random(n) < 0.4] = m[0]
    ids = draw.permutation(n)
    asked = np.concatenate([m[:20], np.zeros((5, 3))])
    monkeypatch.setattr(similarity, "_CELLS", 90)
    monkeypatch.setattr(similarity, "_ACROSS", 8)

    def unit(x):
        length = np.linalg.norm(x, axis=1, keepdims=True)
        return np.divide(x, length, out=np.zeros_like(x), where=length > 0)

    def table(name, keys, rows):
        return pa.table({name: pa.array(keys), "vector": pa.array(rows.tolist(), pa.list_(pa.float64()))})

    key = np.floor(unit(asked) @ unit(m).T * 1e6 + 0.5)
    for name in (ids, np.array([f"d{i:03}" for i in ids])):
        got = similarity.best_in_table(table("query_id", np.arange(25), asked), table("id", name, m), 6)
        best = {q: [name[i] for i in np.lexsort((ids, -key[q]))[:6]] for q in range(25)}
        assert got.num_rows == 150
        for q in range(25):
            rows = [r for r in got.to_pylist() if r["query_id"] == q]
            assert [r["id"] for r in sorted(rows, key=lambda r: (-np.floor(r["score"] * 1e6 + 0.5), r["id"]))] == best[q]
