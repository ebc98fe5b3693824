"""Sources, sinks, the stored index, and the stream."""

from __future__ import annotations

import json
import os
import shutil
import time
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from textmatch.config import EngineConfig
from textmatch.plans.match import match_lite
from textmatch.plans.scan import scan_documents
from textmatch.operators import tfidf
from textmatch.operators.ranking import present_matches
from textmatch.sources import growing, sinks
from textmatch.sources.bucketed import open_by_key, write_by_key
from textmatch.sources.documents import (
    extract_text,
    file_details,
    file_formats,
    html_pages,
    latest_artifact,
    list_files,
    reject_unsupported,
)
from textmatch.sources.envelope import read_envelope_table, write_envelope_table
from textmatch.sources.growing import compact, current_version, load_growing, update_index
from textmatch.sources.index import build_index, corpus_fingerprint, load_index, open_index
from textmatch.sources.tables import (
    load_ground_truth,
    load_processed,
    read_csv,
    read_envelope,
    read_person_tables,
    require_files,
)
from textmatch.streaming.files import committed, scan_stream, scanned_documents, scanned_matches
from textmatch.streaming.match import index_matcher, match_stream

CFG = EngineConfig(min_df=1, max_df=1.0, dim=64, top_n=2)


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(n, f"Job {chr(97 + n)}", f"alpha{n} beta{n} gamma{n % 3}") for n in range(12)]
    return spark.createDataFrame(rows, "id int, title string, embedding_text string")


def test_ground_truth_last_row_wins(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("resume_id,job_id,relevance\n1,2,0\n1,3,2\n1,2,1.5\n")
    rows = {(r.query_id, r.item_id): r.relevance for r in load_ground_truth(spark, str(path)).collect()}
    assert rows == {("1", "2"): 1.5, ("1", "3"): 2.0}
    bad = tmp_path / "bad.csv"
    bad.write_text("resume_id,job_id\n1,2\n")
    with pytest.raises(ValueError, match="relevance"):
        load_ground_truth(spark, str(bad))


def test_person_tables(spark, tmp_path):
    (tmp_path / "01_people.csv").write_text("person_id,name\n1,x\n")
    (tmp_path / "02_abilities.csv").write_text("person_id,ability\n1,b\n1,a\n")
    (tmp_path / "04_experience.csv").write_text("title,person_id,firm\nDev,1,f\n")
    with pytest.raises(FileNotFoundError, match="05_person_skills"):
        read_person_tables(spark, str(tmp_path))
    (tmp_path / "05_person_skills.csv").write_text("person_id,skill\n1,Py\n")
    tables = read_person_tables(spark, str(tmp_path))
    assert tables["experience"].first().title == "Dev"
    ordered = tables["abilities"].orderBy("seq").collect()
    assert [r.ability for r in ordered] == ["b", "a"]


def test_the_listing_order_of_many_files_holds_no_paths(spark, tmp_path):
    """files by name, then splits, then rows; also names that a path spells otherwise."""
    rows = [(n, f"t{n}") for n in range(600)]
    for i, name in enumerate(("b b.csv", "a%20é.csv", "c.csv")):
        lines = "".join(f"{n},{t}\n" for n, t in rows[i * 200 : (i + 1) * 200])
        (tmp_path / name).write_text("person_id,ability\n" + lines)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        found = read_csv(spark, str(tmp_path), "person_id int, ability string")
        ordered = [tuple(r)[:2] for r in found.orderBy("seq").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert ordered == rows[200:400] + rows[:200] + rows[400:]
    assert "string" not in found.schema["seq"].dataType.simpleString()


def test_envelope_and_processed(spark, tmp_path):
    path = tmp_path / "m.json"
    path.write_text(json.dumps({"data": [{"a": 1, "b": "x"}, {"a": 2, "b": None}], "version": "1"}))
    rows = read_envelope(spark, str(path), "a: int, b: string").collect()
    assert [tuple(r) for r in rows] == [(1, "x"), (2, None)]
    bad = tmp_path / "c.csv"
    bad.write_text("person_id,x\n1,2\n")
    with pytest.raises(ValueError, match="embedding_text"):
        load_processed(spark, str(bad))


def test_sinks_write_metadata(spark, tmp_path, corpus):
    sinks.write_table(corpus, f"{tmp_path}/t", {"rows": 12})
    meta = spark.read.json(f"{tmp_path}/t_meta").first()
    assert meta.metadata.rows == "12" and meta.created_at
    assert spark.read.parquet(f"{tmp_path}/t").count() == 12
    averages = spark.createDataFrame([("mrr", 0.5)], "metric string, value double")
    sinks.write_metrics(averages, f"{tmp_path}/m")
    assert spark.read.json(f"{tmp_path}/m").first().written_at
    sinks.write_threshold(averages, f"{tmp_path}/th", (3, 5))
    with pytest.raises(FileNotFoundError):
        require_files(spark, [f"{tmp_path}/none"])


def test_extraction(spark):
    def fail(_content):
        raise ValueError("unreadable")

    rows = [("/a/x.pdf", b"<p>one\ntwo</p><p>3!</p>"), ("/a/y.txt", b"t"), ("/a/z.doc", b"  ")]
    docs = reject_unsupported(spark.createDataFrame(rows, "path string, content binary"))
    got = {r.path: r for r in extract_text(docs, html_pages).collect()}
    assert got["/a/x.pdf"].text == "one two 3" and got["/a/x.pdf"].error is None
    assert got["/a/y.txt"].error == "Unsupported file format: .txt"
    assert got["/a/z.doc"].text == ""
    second = {r.path: r for r in extract_text(docs, fail, html_pages).collect()}
    assert second["/a/x.pdf"].text == "one two 3"
    neither = {r.path: r for r in extract_text(docs, fail).collect()}
    assert neither["/a/x.pdf"].error == "unreadable" and neither["/a/x.pdf"].text is None


def test_scan_folder(spark, tmp_path, corpus):
    for name in ("a.PDF", "b.docx", "c.txt"):
        (tmp_path / name).write_text("<p>alpha1 beta1</p>")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "d.pdf").write_text("<p>x</p>")
    index = build_index(corpus, f"{tmp_path}/sub/index", CFG)
    docs, matches = scan_documents(spark, str(tmp_path), index_matcher(index, CFG), html_pages)
    assert sorted(r.query_id for r in docs.collect()) == ["a.PDF", "b.docx"]
    firsts = {r.query_id: r.id for r in matches.collect() if r["rank"] == 1}
    assert firsts == {"a.PDF": 1, "b.docx": 1}


def test_inventory_and_latest(spark, tmp_path):
    below, other = tmp_path / "tfidf_enhanced_1", tmp_path / "else"
    for folder in (below, other):
        folder.mkdir()
    for n, path in enumerate([tmp_path / "v_1.json", below / "v_2.json", other / "v_3.json"]):
        path.write_text("{}")
        os.utime(path, (time.time() - 100 + n, time.time() - 100 + n))
    (below / "w.json").write_text("{}")
    files = list_files(spark, str(tmp_path))
    assert [tuple(r)[:2] for r in file_formats(files).collect()] == [(".json", 4)]
    assert file_details(files).count() == 4
    newest = latest_artifact(spark, str(tmp_path), "v_*.json").first()
    assert newest.path.endswith("tfidf_enhanced_1/v_2.json")
    assert latest_artifact(spark, str(tmp_path), "none*").first().path is None


def test_index_is_reused_only_for_its_corpus(spark, tmp_path, corpus):
    path = f"{tmp_path}/index"

    def versions():
        return {v: os.path.getmtime(f"{path}/{v}/fingerprint/_SUCCESS") for v in os.listdir(path)}

    first = open_index(corpus, path, CFG)
    built = versions()
    open_index(corpus.repartition(3), path, CFG)
    assert versions() == built
    changed = corpus.withColumn("embedding_text", F.concat("embedding_text", F.lit(" new")))
    assert corpus_fingerprint(changed).first() != corpus_fingerprint(corpus).first()
    second = open_index(changed, path, CFG)
    open_index(corpus, path, replace(CFG, dim=32))
    assert len(versions()) == 3 and built.items() <= versions().items()
    retitled = corpus.withColumn("title", F.concat("title", F.lit(" new")))
    assert {r.title for r in open_index(retitled, path, CFG).corpus.collect()} == {
        r.title for r in retitled.collect()
    }
    open_index(corpus, path, CFG, stop_words=["alpha1"])
    open_index(corpus, path, CFG, use_chunking=False)
    assert len(versions()) == 6
    # The first version still serves whoever reads it.
    assert first.embeddings.count() == second.embeddings.count() == 12


def test_index_keeps_its_settings(spark, tmp_path, corpus):
    path = f"{tmp_path}/index"
    build_index(corpus, path, CFG, stop_words=["alpha1"])
    index = load_index(spark, path)
    assert index.cfg == CFG and index.model.stop_words == ["alpha1"]
    asked = spark.createDataFrame([("q", "beta3")], "query_id string, text string")
    wide = index_matcher(index, replace(CFG, dim=7, top_n=3))(asked)
    assert wide.count() == 3 and wide.filter("rank = 1").first().id == 3
    os.remove(f"{path}/settings/_SUCCESS")
    with pytest.raises(FileNotFoundError, match="settings"):
        load_index(spark, path)
    with pytest.raises(ValueError, match="encoder_name"):
        build_index(corpus, path, CFG, encoder=lambda: None)


def test_line_breaks_in_csv_fields(spark, tmp_path):
    (tmp_path / "p.csv").write_text('person_id,skill\n1,"two\nlines"\n2,"a ""b"", c"\n')
    schema = "person_id int, skill string"
    rows = read_csv(spark, f"{tmp_path}/p.csv", schema, multi_line=True).collect()
    assert [(r.person_id, r.skill) for r in rows] == [(1, "two\nlines"), (2, 'a "b", c')]
    with pytest.raises(Exception, match="(?i)malformed"):
        read_csv(spark, f"{tmp_path}/p.csv", schema).collect()


def test_matches_are_read_back(spark, tmp_path):
    schema = "query_id string, rank int, id int"
    rows = [(f"q{n % 9}", n // 9, n) for n in range(40)]
    matches = spark.createDataFrame(rows, schema)
    sinks.write_matches(matches, f"{tmp_path}/m")
    assert sorted(map(tuple, sinks.read_matches(spark, f"{tmp_path}/m", schema).collect())) == sorted(rows)
    one = sinks.read_matches(spark, f"{tmp_path}/m", schema, "q3").collect()
    assert sorted(map(tuple, one)) == sorted(r for r in rows if r[0] == "q3")


def test_stream_equals_batch(spark, tmp_path, corpus):
    index = build_index(corpus, f"{tmp_path}/index", CFG)
    asked = spark.createDataFrame(
        [(f"q{n}", f"alpha{n} gamma{n % 3}") for n in range(8)], "query_id string, text string"
    )
    asked.repartition(4).write.parquet(f"{tmp_path}/in")
    arrivals = (
        spark.readStream.schema(asked.schema)
        .option("maxFilesPerTrigger", 1)
        .parquet(f"{tmp_path}/in")
    )
    for _ in range(2):  # the second run finds nothing new and repeats nothing
        match_stream(
            arrivals, index_matcher(index, CFG, lite=True), f"{tmp_path}/out", f"{tmp_path}/state"
        ).awaitTermination()
    columns = ["query_id", "rank", "id", "similarity_percentage"]
    streamed = spark.read.parquet(f"{tmp_path}/out").select(columns)
    batch = match_lite(asked, index.corpus, index.model, CFG, index.vectors).select(columns)
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, batch.collect()))


def grown_rows(n, word="spark"):
    return [(i, f"T{i % 7}", f"{word} data row{i % 11} alpha{i % 5} beta") for i in range(n)]


def grown(spark, rows):
    return spark.createDataFrame(rows, "id long, title string, embedding_text string")


def contents(index):
    rows = sorted(tuple(r) for r in index.corpus.select("id", "title", "embedding_text").collect())
    terms = sorted((r.term, r.df, r.ctf, round(r.idf, 9)) for r in index.vocabulary.collect())
    vectors = {r.id: [(x.term, round(x.weight, 9)) for x in r.vector] for r in index.vectors.collect()}
    return rows, terms, vectors


def test_an_index_grows_to_what_a_fresh_build_gives(spark, tmp_path):
    cfg = EngineConfig(min_df=1, max_df=1.0, dim=32)
    path = str(tmp_path / "grown")
    first = grown_rows(60)
    second = first[5:40] + [(i, t, f"changed {x}") for i, t, x in first[40:50]] + grown_rows(80, "new")[60:]
    second += [(900, None, None), (901, "", "")]
    third = [r if r[0] != 900 else (900, "", None) for r in second][3:]
    done = [update_index(grown(spark, rows), path, cfg) for rows in (first, second, second, third)]
    assert [(d.version, d.added, d.changed, d.removed) for d in done] == [
        (1, 60, 0, 0), (2, 22, 10, 15), (2, 0, 0, 0), (3, 0, 1, 3),
    ]
    fresh = str(tmp_path / "fresh")
    update_index(grown(spark, third), fresh, cfg)
    want = contents(load_growing(spark, fresh))
    assert want[0] == sorted(third, key=lambda r: r[0])
    assert contents(load_growing(spark, path)) == want
    assert compact(spark, path).segments != current_version(spark, fresh).segments
    assert contents(load_growing(spark, path)) == want
    again = update_index(grown(spark, third[:-1]), path, cfg)
    assert (again.version, again.removed) == (5, 1)


def test_an_update_that_dies_leaves_the_version_before(spark, tmp_path, monkeypatch):
    cfg = EngineConfig(min_df=1, max_df=1.0, dim=32)
    path = str(tmp_path / "grown")
    update_index(grown(spark, grown_rows(30)), path, cfg)
    before = contents(load_growing(spark, path))

    def dies(*_):
        raise OSError("lost")

    with monkeypatch.context() as patched:
        patched.setattr(growing, "_write_manifest", dies)
        with pytest.raises(OSError, match="lost"):
            update_index(grown(spark, grown_rows(50, "other")), path, cfg)
    (tmp_path / "grown" / "manifests" / "2-half" / "_temporary").mkdir(parents=True)
    assert contents(load_growing(spark, path)) == before
    assert update_index(grown(spark, grown_rows(50, "other")), path, cfg).version == 2
    assert len(contents(load_growing(spark, path))[0]) == 50


def test_counts_are_summed_when_read(spark, tmp_path):
    path, cfg = str(tmp_path / "index"), EngineConfig(min_df=1, dim=32)

    def copies():
        last = current_version(spark, path).segments[-1]
        counts = spark.read.parquet(f"{path}/segments/{last}/counts")
        return counts.count() - counts.select("term").distinct().count()

    rows = grown_rows(40)
    update_index(grown(spark, rows).repartition(4), path, cfg)
    assert copies() > 0 and not current_version(spark, path).summed
    want = contents(load_growing(spark, path))
    assert compact(spark, path).summed and copies() == 0
    assert contents(load_growing(spark, path)) == want
    update_index(grown(spark, rows[:30] + grown_rows(45, "new")[30:]), path, cfg)
    assert not current_version(spark, path).summed
    update_index(grown(spark, rows), path, cfg)
    assert contents(load_growing(spark, path)) == want


@pytest.mark.parametrize("features, few_ids", [(6, 1 << 18), (10_000, 0)])
def test_a_large_index_counts_by_a_list(spark, tmp_path, monkeypatch, features, few_ids):
    """what a segment counts doesn't grow with its texts, and the vocabulary stays exact."""
    cfg = EngineConfig(min_df=2, max_df=0.9, dim=32, max_features=features)
    path, fresh = str(tmp_path / "index"), str(tmp_path / "fresh")

    def rows(n, first, word):
        return [(i, f"T{i}", f"{word} x{i} y{i % 9} z{i % 4} {word} u{i}v w{i % 40}") for i in range(first, first + n)]

    def size(version, part):
        return sum(spark.read.parquet(f"{path}/segments/{name}/{part}").count() for name in version.counted)

    steps = [rows(60, 0, "old"), rows(150, 10, "old"), rows(90, 10, "old") + rows(120, 100, "new"), rows(40, 70, "new")]
    want = []
    for step in steps:
        shutil.rmtree(fresh, ignore_errors=True)
        update_index(grown(spark, step), fresh, cfg)
        want.append(contents(load_growing(spark, fresh)))
    assert len(want[2][1]) > 5
    monkeypatch.setattr(growing, "_MANY", 100)
    monkeypatch.setattr(growing, "_FEW_IDS", few_ids)
    monkeypatch.setattr(tfidf, "_LIKELY", 2 if features < 100 else 0)
    for i, step in enumerate(steps):
        update_index(grown(spark, step).repartition(3), path, cfg)
        version = current_version(spark, path)
        assert bool(version.terms) == (i > 0) and len(version.segments) == i + 1
        assert contents(load_growing(spark, path)) == want[i]
        if i:
            assert len(version.counted) == i and size(version, "counts") <= 20 * i and size(version, "cells") <= 32 * i
    assert compact(spark, path).counted == current_version(spark, path).segments
    kept = [f for name in current_version(spark, path).segments for f in os.listdir(f"{path}/segments/{name}/rows")]
    assert all(f.endswith(".zstd.parquet") for f in kept if f.startswith("part-"))
    assert contents(load_growing(spark, path)) == want[3]
    update_index(grown(spark, steps[0]), path, cfg)
    assert contents(load_growing(spark, path)) == want[0]


def test_an_index_refuses_other_settings_and_repeated_ids(spark, tmp_path):
    path = str(tmp_path / "grown")
    with pytest.raises(FileNotFoundError):
        load_growing(spark, path)
    with pytest.raises(ValueError, match="unique"):
        update_index(grown(spark, grown_rows(3) + grown_rows(1)), path)
    with pytest.raises(ValueError, match="unique"):
        update_index(grown(spark, [(None, "a", "b")]), path)
    assert update_index(grown(spark, []), path).version == 1
    assert load_growing(spark, path).corpus.count() == 0
    with pytest.raises(ValueError, match="settings"):
        update_index(grown(spark, []), path, EngineConfig(min_df=2))


def test_files_arriving_are_extracted_matched_and_committed(spark, tmp_path):
    folder, out, state = (tmp_path / x for x in ("in", "out", "state"))
    folder.mkdir()

    def arrive(name, content):
        (folder / name).write_bytes(content)

    def matcher(asked):
        return asked.select("query_id", F.length("text").cast("int").alias("score"))

    def run():
        scan_stream(spark, str(folder), matcher, str(out), str(state), html_pages).awaitTermination()

    assert scanned_documents(spark, str(out)).count() == 0
    arrive("a.pdf", b"<p>one</p><p>two</p>")
    arrive("b.exe", b"x")
    arrive("c.pdf", b"\xff\xfe broken")
    run()
    first = {r.query_id: (r.text, r.error) for r in scanned_documents(spark, str(out)).collect()}
    assert first["a.pdf"] == ("one two", None) and set(first) == {"a.pdf", "b.exe", "c.pdf"}
    assert "Unsupported" in first["b.exe"][1] and first["c.pdf"][0] is None and first["c.pdf"][1]
    assert [tuple(r) for r in scanned_matches(spark, str(out)).collect()] == [("a.pdf", 7)]
    arrive("d.pdf", b"<p>three</p>")
    run()
    run()
    assert sorted(r.query_id for r in scanned_documents(spark, str(out)).collect()) == ["a.pdf", "b.exe", "c.pdf", "d.pdf"]
    # A batch that wrote its rows but not its manifest is done again, over what it left.
    batches = sorted(committed(spark, str(out)))
    (last,) = [x for x in (out / "manifest").iterdir() if x.name == f"batch_id={batches[-1]}"]
    moved = tmp_path / "moved"
    last.rename(moved)
    assert len(scanned_matches(spark, str(out)).collect()) == 1
    (state / "commits" / str(batches[-1])).rename(tmp_path / "commit")
    (state / "commits" / f".{batches[-1]}.crc").rename(tmp_path / "crc")
    run()
    assert sorted(tuple(r) for r in scanned_matches(spark, str(out)).collect()) == [("a.pdf", 7), ("d.pdf", 5)]
    assert scanned_documents(spark, str(out)).count() == 4


def test_an_envelope_of_many_tasks_is_one_document(spark, tmp_path):
    path = tmp_path / "doc"
    rows = [(i, f'line "{i}"\nwith ü', None if i % 5 else i / 4, [i, i + 1]) for i in range(3000)]
    schema = "a long, b string, c double, d array<long>"
    df = spark.createDataFrame(rows, schema).repartition(7)
    for _ in range(2):  # written again, it replaces the first
        write_envelope_table(df, str(path), {"k": 5})
    whole = b"".join(f.read_bytes() for f in sorted(path.iterdir()) if f.name.endswith(".json"))
    document = json.loads(whole)
    assert set(document) == {"metadata", "created_at", "version", "data"} and document["metadata"] == {"k": "5"}
    assert sorted(r["a"] for r in document["data"]) == list(range(3000))
    for split in (97, 10_000, 1 << 25):
        found = read_envelope_table(spark, str(path), schema, split)
        assert sorted(tuple(r) for r in found.collect()) == rows
    assert read_envelope_table(spark, str(path), schema, 10_000).rdd.getNumPartitions() > 7
    # Head and records in one file, as another program would keep it.
    one = tmp_path / "one.json"
    one.write_text(json.dumps(document, indent=2))
    assert read_envelope_table(spark, str(one), schema).count() == 3000
    (path / "99999999-tail.json").unlink()
    with pytest.raises(Exception, match="not a whole document"):
        read_envelope_table(spark, str(path), schema).count()


def test_an_envelope_without_records(spark, tmp_path):
    path = tmp_path / "none"
    write_envelope_table(spark.createDataFrame([], "a int"), str(path))
    document = json.loads(b"".join(f.read_bytes() for f in sorted(path.iterdir()) if f.name.endswith(".json")))
    assert document["data"] == []
    assert read_envelope_table(spark, str(path), "a int").collect() == []


def test_a_table_stored_by_key_is_not_exchanged(spark, tmp_path):
    rows = [(i, f"T{i % 9}", f"text {i}") for i in range(500)] + [(None, "n", None)]
    corpus = spark.createDataFrame(rows, "id long, title string, embedding_text string")
    path = str(tmp_path / "by_key")
    write_by_key(corpus, path, buckets=8)
    stored = open_by_key(spark, path)
    assert sorted(map(str, stored.collect())) == sorted(map(str, corpus.collect()))
    found = spark.range(0, 500, 7).selectExpr("id % 3 AS query_id", "id", "1 / (id + 1) AS score")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shown = present_matches(found, stored, 4)
        plan = shown._jdf.queryExecution().executedPlan().toString()
        got = sorted(map(str, shown.collect()))
        want = sorted(map(str, present_matches(found, corpus, 4).collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == want and len(got) == 9
    # Up from each scan of the table to the first join there is no exchange.
    lines = plan.splitlines()
    depth = [len(line) - len(line.lstrip(" :+-")) for line in lines]
    scans = [i for i, line in enumerate(lines) if "Bucketed: true" in line]
    assert len(scans) == 2
    for i in scans:
        above = i
        while "Join" not in lines[above]:
            above = next(j for j in range(above - 1, -1, -1) if depth[j] < depth[above])
            assert "Exchange" not in lines[above]
    (tmp_path / "by_key" / "layout" / "_SUCCESS").unlink()
    with pytest.raises(FileNotFoundError):
        open_by_key(spark, path)
