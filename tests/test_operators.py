"""Operators over crafted tables."""

import json

import pytest
from pyspark.sql import functions as F

from tabbyline.operators import embed, ingest, lexical, links, metrics, quality, search, store
from tabbyline.plans.pipeline import index_corpus, ingest_corpus
from tabbyline.sources import corpus, pages

BODY = "<h1>%s</h1><p>" + "A cat that eats well sleeps well. " * 5 + "</p>"


def page_rows(spark, rows):
    return spark.createDataFrame(rows, "url string, final_url string, html string, error string")


def test_first_seen_wins_before_extraction(spark):
    df = page_rows(spark, [("b", "f", BODY % "Two", None), ("a", "f", "<p>x</p>", None), ("c", "g", None, "HTTP 500"), ("d", "h", "<p>" + "long enough text " * 9 + "</p>", None), ("e", "i", BODY % "Good", None)])
    good, bad = ingest.ingest_pages(df, "aspca_toxicology", "p_")
    assert [(r["id"], r["title"]) for r in good.collect()] == [("p_e", "Good")]
    assert {(r["url"], r["reason"]) for r in bad.collect()} == {("c", "fetch failure: HTTP 500"), ("f", "extraction failure"), ("h", "no title")}
    good, bad = ingest.ingest_pages(df, "aspca_toxicology", "p_", most=1)
    assert good.count() == 0 and bad.count() == 1
    assert ingest.first_per_source(df.withColumn("source", F.lit("s")), 0, "url").count() == 5


@pytest.mark.parametrize("n, passed", [(0, False), (49, False), (50, True), (500, True), (501, False)])
def test_report_row_count(spark, n, passed):
    df = spark.range(n).select(F.repeat(F.lit("x"), 100).alias("content"), F.lit("merck_vet_manual").alias("source"))
    rows = {r["check"]: (r["passed"], r["detail"]) for r in quality.quality_report(df).collect()}
    assert rows["row_count_range"] == (passed, f"{n} docs (expected 50~500)")
    assert all(rows[c][0] for c in rows if c != "row_count_range")


def test_report_bounds(spark):
    df = spark.createDataFrame([("x" * 49 + " \n", "merck_vet_manual"), ("x" * 100, "new"), ("x" * 100101, "new"), (None, None)], "content string, source string")
    rows = {r["check"]: (r["passed"], r["detail"]) for r in quality.quality_report(df).collect()}
    assert rows["no_empty_content"] == (False, "2 documents with empty/short content")
    assert rows["sources_in_expected_set"] == (False, "Sources found: [merck_vet_manual, new]. Unknown: [new]")
    assert rows["content_length_in_bounds"][1].startswith("3 docs outside")


def test_breed_table_is_required(spark):
    with pytest.raises(Exception, match="no wikitable"):
        links.breed_links(spark.createDataFrame([("<p>x</p>",)], "html string"), "b").collect()
    assert links.seed_urls(spark, [("A B", "a-b")], "https://x.example").first()["url"] == "https://x.example/breed/a-b/"


POINTS = [("a", [1.0, 0.0], 1), ("b", [1.0, 0.0], 2), ("c", [0.6, 0.8], 1), ("d", [0.0, 0.0], 1), ("e", None, 1), ("f", [-2.0, 0.0], 1)]


def test_search(spark):
    df = spark.createDataFrame(POINTS, "point_id string, vector array<float>, label int")
    assert [r["point_id"] for r in search.search(df, [2.0, 0.0], 3).collect()] == ["a", "b", "c"]
    assert [r["point_id"] for r in search.search(df, [2.0, 0.0], 3, F.col("label") == 1).collect()] == ["a", "c", "f"]
    rows = search.search_batch(df, [(1, [1.0, 0.0]), (2, [0.0, 1.0])], 2).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["point_id"], r["rank"]) for r in rows] == [(1, "a", 1), (1, "b", 2), (2, "c", 1), (2, "a", 2)]
    assert search.search(df.limit(0), [1.0, 0.0]).count() == 0


def test_queries_in_blocks_give_the_same(spark, monkeypatch):
    import random

    rng = random.Random(1)
    vector = lambda: [rng.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(4)]
    df = spark.createDataFrame([(f"p{n:03d}", vector()) for n in range(90)] + [("n", None), ("s", [1.0])], "point_id string, vector array<float>")
    asked = spark.createDataFrame([(n, vector()) for n in range(40)] + [(90, None), (91, [0.0] * 4), (92, [1.0])], "q bigint, v array<float>")
    shipped = sorted(map(tuple, search.search_batch(df, asked, 3).collect()))
    for name, size in (("SHIPPED_QUERIES", 5), ("QUERY_BLOCK", 7), ("POINT_BLOCK", 20)):
        monkeypatch.setattr(search, name, size)
    assert sorted(map(tuple, search.search_batch(df, asked, 3).collect())) == shipped
    assert sorted(map(tuple, search.search_batch(df, [(r["q"], r["v"] or []) for r in asked.collect()], 3).collect())) == shipped
    assert {r[0] for r in shipped} >= {92} and not {r[0] for r in shipped} & {90, 91}


def chunk_rows(spark, rows):
    full = [(i, "doc", "s", "text of the chunk", "article", 0, 3, v, "m", "0.1.0", t, None) for i, v, t in rows]
    return spark.createDataFrame(full, "id string, document_id string, source string, content string, content_type string, chunk_index int, token_count int, embedding array<float>, embedding_model string, pipeline_version string, created_at timestamp, metadata struct<title:string,url:string>")


def test_collection(spark, tmp_path):
    import datetime as dt

    t = [dt.datetime(2026, 1, d) for d in (1, 2)]
    c = store.Collection(spark, f"file://{tmp_path}/c")
    with pytest.raises(FileNotFoundError):
        c.points()
    c.create(dim=2)
    rows = chunk_rows(spark, [("x", [1.0, 0.0], t[0]), ("x", [0.0, 1.0], t[1]), ("y", [1.0, 1.0], None), ("z", None, t[0]), ("w", [0.0, 0.0], t[0])])
    assert c.upsert(rows, 2) == {"sent": 3, "distinct": 2, "skipped": 2, "batches": 2, "last_batch": 1}
    first = c.points().orderBy("chunk_id").collect()
    assert [(r["chunk_id"], r["vector"], r["title"]) for r in first] == [("x", [0.0, 1.0], ""), ("y", [1.0, 1.0], "")]
    c.upsert(rows)
    assert c.points().orderBy("chunk_id").collect() == first
    c.create(dim=2)
    assert c.points().count() == 2
    old = c.points()
    c.create(dim=2, recreate=True)
    assert c.points().count() == 0 and old.count() == 2  # who reads the old state goes on
    assert c.upsert(rows.limit(0)) == {"sent": 0, "distinct": 0, "skipped": 0, "batches": 0, "last_batch": 0}


def test_only_touched_buckets_are_written(spark, tmp_path):
    import os

    c = store.Collection(spark, f"file://{tmp_path}/c")
    c.create(dim=2, buckets=16)
    c.upsert(chunk_rows(spark, [(f"k{n}", [1.0, float(n)], None) for n in range(60)]))
    before = c._state()["versions"]
    c.upsert(chunk_rows(spark, [("k7", [5.0, 5.0], None)]))
    after = c._state()["versions"]
    assert sum(before[b] != after[b] for b in before) == 1 and c.points().count() == 60
    assert [r["vector"] for r in c.points().filter("chunk_id = 'k7'").collect()] == [[5.0, 5.0]]
    folders = lambda: {f for f in os.listdir(f"{tmp_path}/c") if not f.startswith(("states", "."))}
    assert len(folders()) == 2 and c.expire() == 0  # the first is still read
    c.replace(chunk_rows(spark, [("new", [1.0, 0.0], None)]), 2)
    assert [r["chunk_id"] for r in c.points().collect()] == ["new"]
    assert c.expire() == 2 and len(folders()) == 1 and c.points().count() == 1


def test_of_two_writers_one_tries_again(spark, tmp_path, monkeypatch):
    c, other = (store.Collection(spark, f"file://{tmp_path}/c") for _ in range(2))
    c.create(dim=2)
    stale = c._state()
    other.upsert(chunk_rows(spark, [("a", [1.0, 0.0], None)]))
    with pytest.raises(store.ConflictError):
        c._publish(stale, stale["number"] + 1)
    states = iter([stale, c._state()])
    monkeypatch.setattr(c, "_state", lambda: next(states))
    c.upsert(chunk_rows(spark, [("b", [0.0, 1.0], None)]))
    assert sorted(r["chunk_id"] for r in other.points().collect()) == ["a", "b"]


def test_embedding(spark):
    df = spark.createDataFrame([("cats and dogs",), ("cats and dogs",), ("",), (None,)], "content string")
    rows = embed.embed_chunks(df, embed.hash_model(32)).collect()
    assert rows[0]["embedding"] == rows[1]["embedding"] and rows[2]["embedding"] is None and rows[3]["embedding"] is None
    assert sum(x * x for x in rows[0]["embedding"]) == pytest.approx(1, abs=1e-5)


def test_lexical(spark):
    df = spark.createDataFrame([("a", "cat cat dog"), ("b", "dog"), ("c", None), ("d", "bird cat")], "id string, content string")
    rows = lexical.bm25(df, [(1, "Cat"), (2, "absent")]).collect()
    assert [(r["query_id"], r["id"]) for r in rows] == [(1, "a"), (1, "d")]
    assert lexical.bm25(df.limit(0), [(1, "cat")]).count() == 0
    d = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "query_id bigint, id string, rank int")
    x = spark.createDataFrame([(1, "b", 1), (1, "c", 2)], "query_id bigint, id string, rank int")
    fused = lexical.fuse(d, x).orderBy("rank").collect()
    assert [r["id"] for r in fused] == ["b", "a", "c"] and fused[0]["score"] == pytest.approx(1 / 61 + 1 / 62)
    texts = spark.createDataFrame([(1, "big cat", "p", "a cat"), (1, "big cat", "q", "a big cat"), (1, "big cat", "r", None)], "query_id bigint, query string, id string, text string")
    assert [r["id"] for r in lexical.rerank(texts, 2).orderBy("rank").collect()] == ["q", "p"]


def test_corpus_files(spark, tmp_path):
    row = {"id": "a", "source": "merck_vet_manual", "url": "u", "title": "t", "content": "x" * 60, "content_type": "disease", "scraped_at": "2026-01-01T00:00:00Z", "metadata": {"word_count": 1}}
    path = tmp_path / "c.json"
    path.write_text(json.dumps([row, row | {"id": "b"}]))
    assert corpus.read_corpus(spark, str(path), multiline=True).count() == 2
    path.write_text(json.dumps([row, row | {"id": "b", "content": "short"}]))
    with pytest.raises(Exception, match="content"):
        corpus.read_corpus(spark, str(path), multiline=True).collect()
    good, bad = corpus.read_corpus(spark, str(path), multiline=True, quarantine=True)
    assert good.count() == bad.count() == 1
    assert not corpus.write_failures(bad.limit(0), str(tmp_path / "f")) and corpus.write_failures(bad, str(tmp_path / "f"))
    with pytest.raises(Exception):
        corpus.read_corpus(spark, str(tmp_path / "none")).collect()


def test_pipeline(spark, tmp_path):
    df = page_rows(spark, [(f"https://a.example/t{n}", f"https://a.example/t{n}", BODY % f"Page {n}", None) for n in range(7)])
    done = ingest_corpus({"aspca_toxicology": (df, "a_"), "merck_vet_manual": (df, "m_")}, str(tmp_path / "o"), only="merck_vet_manual", test=True)
    assert done["total_documents"] == 5 and done["source_breakdown"] == {"merck_vet_manual": 5} and not done["quality_passed"]
    docs = corpus.read_corpus(spark, done["output"])
    counts = index_corpus(docs, f"file://{tmp_path}/points", dim=64)
    assert counts["sent"] == counts["distinct"] == 5 and counts["rejected"] == 0
    odd = docs.withColumn("source", F.when(F.col("id").endswith("t1"), "elsewhere").otherwise(F.col("source")))
    counts = index_corpus(odd, f"file://{tmp_path}/points", dim=64)
    assert counts["distinct"] == 4 and counts["rejected"] == 1 and store.Collection(spark, f"file://{tmp_path}/points").points().count() == 4
    assert spark.read.json(f"file://{tmp_path}/points-rejected").first()["violations"] == ["source"]


def test_pages_are_extracted_once(spark):
    df = page_rows(spark, [("a", "f", BODY % "One", None), ("b", "f", BODY % "Two", None), ("c", "g", BODY % "Three", None), ("d", None, BODY % "Four", None), ("e", None, BODY % "Five", None)])
    assert [(r["url"], r["final_url"]) for r in ingest.first_per_final_url(df).orderBy("url").collect()] == [("a", "f"), ("c", "g"), ("d", None)]
    good, _ = ingest.ingest_pages(df, "aspca_toxicology", "p_")
    plan = good._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("</\\1") == 4 and plan.count("<title") <= 2  # scripts once, furniture in three rounds; nullif names its argument twice
    assert good.count() == 3


def test_metrics(spark, tmp_path):
    rows = metrics.metric_rows(spark.range(3).agg(F.count("*").alias("n"), F.max("id").alias("m")), "r")
    metrics.log_rows(rows, str(tmp_path / "m"))
    metrics.log_rows(rows, str(tmp_path / "m"))
    assert {(r["key"], r["value"]) for r in spark.read.parquet(str(tmp_path / "m")).collect()} == {("n", "3"), ("m", "2")}


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    import sys

    from tabbyline.__main__ import main

    rows = [(f"https://a.example/t{n}", f"https://a.example/t{n}", BODY % f"Cat page {n}", None) for n in range(7)]
    page_rows(spark, rows).write.parquet(str(tmp_path / "pages"))

    def run(*args):
        monkeypatch.setattr(sys, "argv", ["tabbyline", "--master", "local[4]", *map(str, args)])
        main()
        return capsys.readouterr().out

    done = json.loads(run("ingest", tmp_path / "pages", f"file://{tmp_path}/out", "--source", "merck_vet_manual", "--prefix", "m_", "--test"))
    assert done["total_documents"] == 5
    counts = json.loads(run("index", done["output"], f"file://{tmp_path}/points", "--dim", "64"))
    assert counts["distinct"] == 5 and counts["rejected"] == 0 and counts["seconds"] >= 0
    assert "merck_vet_manual" in run("search", f"file://{tmp_path}/points", "cat that sleeps", "--dim", "64", "-k", "2")
    assert "5" in run("stats", done["output"])


def test_run_record(spark):
    rows = metrics.run_rows(spark.range(3).agg(F.count("*").alias("n")), "r", {"size": 5}, {"stage": "x"})
    assert sorted((r["kind"], r["key"], r["value"]) for r in rows.collect()) == [("metric", "n", "3"), ("param", "size", "5"), ("tag", "stage", "x")]


def test_page_source(spark):
    import functools
    import http.server
    import threading

    seen = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            seen.append((self.path, self.headers["User-Agent"]))
            if self.path == "/moved":
                self.send_response(302)
                self.send_header("Location", "/there")
            elif self.path == "/weak":
                self.send_response(200 if sum(p == "/weak" for p, _ in seen) > 2 else 503)
            else:
                self.send_response(200 if self.path == "/there" else 404)
                self.send_header("Content-Type", "text/html; charset=utf-8")
            self.end_headers()
            if self.path == "/there":
                self.wfile.write("<h1>é</h1>".encode())

        log_message = functools.partial(lambda *a: None)

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    pages.register(spark)
    rows = spark.read.format("pages").option("urls", f"{base}/moved\n{base}/none\nhttp://127.0.0.1:1/x").load().orderBy("url").collect()
    host = base.removeprefix("http://")
    weak = spark.read.format("pages").option("urls", f"{base}/weak\n{base}/none").option("retries", 2).option(f"useragent.{host}", "one/1").load().orderBy("url").collect()
    server.shutdown()
    assert [r["error"] for r in weak] == ["HTTP 404", None] and [p for p, a in seen if a == "one/1"].count("/weak") >= 3  # the sort reads twice
    told = {r["url"]: (r["final_url"], r["html"], r["error"]) for r in rows}
    assert told[f"{base}/moved"] == (f"{base}/there", "<h1>é</h1>", None) and told[f"{base}/none"][2] == "HTTP 404"
    assert told["http://127.0.0.1:1/x"][2]


def test_streams(spark, tmp_path):
    from tabbyline.streaming import pages as S

    rows = [(1, "a", "f", BODY % "One", None, "2026-01-01 00:00:00"), (2, "b", "f", BODY % "Again", None, "2026-01-01 00:01:00"), (3, "c", "g", None, "HTTP 500", "2026-01-01 00:02:00")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, final_url string, html string, error string, fetched_at string").withColumn("fetched_at", F.col("fetched_at").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    stream = S.stream_documents(S.read_pages(spark, str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("docs").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("docs").count() == 1
    counts = S.stream_counts(S.read_pages(spark, str(tmp_path / "in")))
    q = counts.writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r["pages"], r["failed"]) for r in spark.table("counts").collect()] == [(3, 1)]
    chunk_rows(spark, [("x", [1.0, 0.0], None), ("x", [1.0, 0.0], None)]).write.parquet(str(tmp_path / "ch"))
    c = store.Collection(spark, f"file://{tmp_path}/c")
    c.create(dim=2)
    chunks = spark.readStream.schema(spark.read.parquet(str(tmp_path / "ch")).schema).parquet(str(tmp_path / "ch"))
    S.upsert_stream(chunks, c, str(tmp_path / "cp3")).awaitTermination()
    assert c.points().count() == 1


def test_materialised_tables(spark):
    import os

    from tabbyline import session

    session.release(spark)
    df = session.materialise(spark.range(5).withColumn("x", F.lit("a")), "t")
    assert df.count() == 5 and df.schema["x"].dataType.simpleString() == "string"
    path = session._written[-1].removeprefix("file://")
    with session.scope(spark):
        inner = session.materialise(spark.range(2), "inner")
        assert inner.count() == 2
        kept = session._written[-1].removeprefix("file://")
    assert not os.path.exists(kept) and os.path.exists(path)
    assert session.release(spark) == 1 and not os.path.exists(path)
