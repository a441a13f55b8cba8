"""Threads, sections, pairs, index, retrieval, budgets, answers, evaluation, sources: small goldens and invariants."""

import datetime as dt
import json

import plain
import pytest
from pyspark.sql import functions as F

from loomline.models import HashEmbedder, OverlapScorer, embed, score_pairs
from loomline.functions import text as T
from loomline.operators import chunking, qa, sections, skew, sparse, threads
from loomline.plans import answers, budget, evaluate, index, retrieve
from loomline.sources import chat, jsonl

UTC = dt.timezone.utc
META = "map<string,string>"


def test_hub_join_equals_join(spark, monkeypatch):
    monkeypatch.setattr(skew, "LEAST", 5)
    left = spark.createDataFrame([(1, i) for i in range(40)] + [(k, k) for k in range(2, 9)] + [(None, 99)], "k int, v int")
    right = spark.createDataFrame([(1, "a"), (3, "b"), (77, "c")], "k int, w string")
    for how in ("inner", "left"):
        got = sorted(map(tuple, skew.hub_join(left, right, "k", how).select("k", "v", "w").collect()), key=repr)
        assert got == sorted(map(tuple, left.join(right, "k", how).select("k", "v", "w").collect()), key=repr)


RAW = "message_id string, room_id string, parent_id string, author string, person_email string, created string, updated string, text string, markdown string, ingested_at timestamp"


def test_threads(spark):
    at = lambda m: dt.datetime(2024, 1, 1, 0, m, tzinfo=UTC)
    rows = [
        ("a", "r", None, "Ann", None, "2024-01-01T10:00:00Z", None, "root", None, at(0)), ("c", "r", "a", "Bob", None, None, None, "late", None, at(1)), ("b", "r", "a", "Bob", None, "2024-01-01T09:00:00Z", "2024-02-01T00:00:00Z", "x\ny", None, at(1)),
        ("b", "r", "a", "Bob", None, "2024-01-01T09:00:00Z", None, "second delivery", None, at(5)), ("s", "r", None, "Ann", None, "2024-01-01T10:00:00Z", None, "single", None, at(0)), ("o", "r", "gone", "Bob", None, "2024-01-01T10:00:00Z", None, "orphan", None, at(0)),
    ]
    (t,) = threads.threads(spark.createDataFrame(rows, RAW)).collect()
    assert (t.thread_id, t.message_count, t.participants) == ("a", 3, ["Ann", "Bob"])
    assert t.text.split("\n") == ["[2024-01-01T10:00:00Z] Ann: root", "[2024-01-01T09:00:00Z] Bob: x y", "[unknown-time] Bob: late"]
    assert t.updated_at == dt.datetime(2024, 2, 1)
    assert threads.message_records(spark.createDataFrame(rows, RAW)).count() == 6


def test_sections(spark):
    toc = spark.createDataFrame([("f", 1, 1, "One", 1), ("f", 2, 2, "Deep", 2), ("f", 3, 1, "Two", 4), ("f", 4, 1, "Same page", 4), ("f", 5, 1, "Far", 99)], "file string, pos int, level int, title string, page int")
    pages = spark.createDataFrame([("f", 6), ("g", 3)], "file string, page_count int")
    got = {(x.file, x.title, x.page_start, x.page_end) for x in sections.section_ranges(toc, pages).collect()}
    assert got == {("f", "One", 1, 3), ("f", "Same page", 4, 5), ("f", "Far", 6, 6), ("g", "g", 1, 3)}
    deep = toc.where("level = 2").unionByName(spark.createDataFrame([("f", 1, 3, "Deeper", 3)], toc.schema).withColumn("pos", F.lit(9)))
    assert {x.path for x in sections.section_ranges(deep, pages).where("file = 'f'").collect()} == {"Deep", "Deep > Deeper"}
    many = [("h", i, i, f"L{i}", i) for i in range(2, 10)] + [("h", 10, 3, "", 20), ("h", 11, None, None, 21)]
    ranged = sections.section_ranges(spark.createDataFrame(many, toc.schema), spark.createDataFrame([("h", 30), ("none", 0)], pages.schema)).collect()
    assert [(x.title, x.path) for x in ranged] == [("Untitled Section", "Untitled Section")]  # a missing level is the first level
    deep = sections.section_ranges(spark.createDataFrame(many[:9], toc.schema), pages.where("false").union(spark.createDataFrame([("h", 30)], pages.schema))).orderBy("section_no").collect()
    assert deep[7].path == " > ".join(f"L{i}" for i in range(2, 10)) and deep[8].path == "L2 > Untitled Section"


def test_packing_of_sections(spark):
    ranges = spark.createDataFrame([("f", 1, "One", 1, "One", 1, 2)], "file string, section_no int, title string, level int, path string, page_start int, page_end int")
    text = "A sentence of the page that goes on for a while. " * 10
    units = spark.createDataFrame([("f", 1, 1, "1 Setup"), ("f", 1, 2, text), ("f", 2, 1, text), ("f", 2, 2, "short end of it."), ("f", 2, 3, "2 Next"), ("f", 2, 4, text * 3)], "file string, page int, unit_no int, text string")
    plans = sections.pack_sections(ranges, units).orderBy("chunk_no").collect()
    assert [p.heading for p in plans] == ["1 Setup", "1 Setup", "2 Next", "2 Next"] or {p.heading for p in plans} == {"1 Setup", "2 Next"}
    assert all("1 Setup" not in p.text for p in plans) and any(p.sentence_split_count for p in plans)
    assert sections.section_records(sections.pack_sections(ranges, units), ranges).select("doc_id").distinct().count() == len(plans)


DOC = f"doc_id string, source_type string, source_ref string, source_path string, title string, page int, text string, markdown string, created_at timestamp, metadata {META}"


def test_chunk_routes(spark):
    doc = lambda i, kind, text, meta: (i, kind, "ref", None, "T", 1, text, None, None, meta)
    rows = [doc("t", "webex", "reply only", {"thread_id": "x", "message_count": "3", "thread_start_line": "[a] b: c"}), doc("s", "pdf", "cut", {"split_mode": "page_paragraph"}), doc("p", "pdf", "one\n\ntwo", {}), doc("w", "web", "word " * 500, {}), doc("n", "web", None, {}), doc("q", "web", "short", {})]
    out = chunking.chunk_documents(spark.createDataFrame(rows, DOC), 200, 50, 20).collect()
    by = {}
    for x in out:
        by.setdefault(x.doc_id, []).append(x)
    assert by["t"][0].text == "[a] b: c\nreply only" and by["s"][0].text == "cut" and by["p"][0].text == "one\n\ntwo" and len(by["w"]) > 10
    assert "n" not in by and "q" not in by and len({x.chunk_id for x in out}) == len(out)
    assert by["w"][0].metadata["title"] == "T"


def test_judge_order_of_reasons(spark):
    good = "the rollback point belongs to the treatment"
    rows = [(1, "short?", good, good), (2, "What is the rollback point?", "no", good), (3, "What is the rollback point?", "zzzz yyyy xxxx wwww vvvv uuuu", good), (4, "What is the rollback point?", good, good), (5, "what is the Rollback point?", good, good)]
    got = {x.pos: x.reason for x in qa.judge(spark.createDataFrame(rows, "pos int, question string, answer string, context string"), "pos").collect()}
    assert got == {1: "short_question", 2: "answer_length", 3: "weak_grounding", 4: "keep", 5: "duplicate_question"}


def test_exact_split_sizes(spark):
    for n in (0, 1, 7, 250):
        out = qa.exact_split(spark.range(n).selectExpr("cast(id as string) k"), "k").groupBy("split_name").count().collect()
        sizes = {x.split_name: x["count"] for x in out}
        assert sizes.get("train", 0) == int(n * 0.9) and sizes.get("valid", 0) == int(n * 0.08) and sum(sizes.values()) == n


def test_thread_answers_by_user(spark):
    text = "[t] Ann: how?\n[t] Bob: like this\n[t] Cy: or that"
    df = spark.createDataFrame([("c", text)], "chunk_id string, text string")
    assert qa.thread_answers(df).first().answer == "like this\n\nor that"
    assert qa.thread_answers(df, " BOB").first().reply_count == 1


def test_upsert_is_idempotent(spark, tmp_path):
    old = spark.createDataFrame([("a", "1", "pdf"), ("b", "2", "pdf")], "point_id string, text string, source_type string")
    new = spark.createDataFrame([("b", "3", "pdf"), ("c", "4", "webex"), ("c", "4", "webex")], old.schema)
    once = index.latest(old, new)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, index.latest(once, new).collect())) == [("a", "1", "pdf"), ("b", "3", "pdf"), ("c", "4", "webex")]
    at = str(tmp_path / "bundle")
    manifest = index.export_index(once, at, sources=(" PDF ",))
    assert (manifest["points_count"], manifest["filtered_out_points"]) == (2, 1)
    assert sorted(map(tuple, index.import_index(spark, at, old.schema).collect())) == [("a", "1", "pdf"), ("b", "3", "pdf")]
    with pytest.raises(ValueError):
        index.upsert_index(spark, once.drop("text"), _written(once, tmp_path), str(tmp_path / "out"))


def _written(df, tmp_path):
    index.write_index(df, str(tmp_path / "idx"))
    return str(tmp_path / "idx")


def test_sparse_vectors_ignore_case(spark):
    df = spark.createDataFrame([(1, "Decision-Node engine"), (2, "decision-node ENGINE")], "id int, text string")
    a, b = sparse.sparse_vectors(df, "id", "text").orderBy("id").collect()
    assert a.indices == b.indices and len(a.indices) >= 4 and min(a["values"]) > 0


def test_fusion_prefers_the_weighted_list(spark):
    dense = spark.createDataFrame([("q", 1, 1), ("q", 2, 2)], "query string, doc int, rank int")
    lexical = spark.createDataFrame([("q", 2, 1)], "query string, doc int, rank int")
    assert retrieve.rrf([dense, lexical], [0.1, 3.0]).orderBy("rank").first().doc == 2
    assert retrieve.rrf([dense, lexical], [0.0, 0.0]).count() == 2


def test_dense_blocks_agree(spark):
    pts = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(40)], "doc int, v array<double>")
    q = pts.where("doc < 6").withColumnRenamed("doc", "query")
    a = sorted(map(tuple, retrieve.dense_topk(pts, q, 3).select("query", "doc", "rank").collect()))
    assert a == sorted(map(tuple, retrieve.dense_topk(pts, q, 3, block=2).select("query", "doc", "rank").collect())) and len(a) == 18


def cap_model(rows, most, k):
    seen, counts, out = set(), {}, []
    for key, bucket in rows:
        if counts.get(bucket, 0) < most and key not in seen:
            out.append(key)
            seen.add(key)
            counts[bucket] = counts.get(bucket, 0) + 1
    out += [key for key, _ in rows if key not in seen and not seen.add(key)]
    return out[:k]


def test_source_cap_equals_model(spark):
    rows = [(f"k{i % 9}", f"b{(i % 9) % 3}", 1.0 - i / 20) for i in range(14)]
    df = spark.createDataFrame([("q", *r) for r in rows], "query string, row_key string, bucket string, score double")
    got = [x.row_key for x in retrieve.cap_sources(df, 1, 6).orderBy("rank").collect()]
    assert got == cap_model([(k, b) for k, b, _ in rows], 1, 6)
    assert retrieve.cap_sources(df, 0, 20).count() == 14


def test_recency_and_threshold(spark):
    meta = {"updated_at": "2024-01-01T00:00:00Z"}
    rows = [("q", "latest rule", "webex", meta, 0.5), ("q", "rule", "webex", meta, 0.5), ("q", "rule", "pdf", meta, 0.5), ("q", "rule", "pdf", meta, 0.01)]
    df = spark.createDataFrame(rows, f"query string, question string, source_type string, metadata {META}, first_score double")
    df = df.withColumns({"rerank_score": F.lit(None).cast("double"), "text": F.lit("x"), "retrieval_text": F.lit(None).cast("string"), "record_type": F.lit("chunk"), "source_ref": F.lit("")})
    out = retrieve.score_rows(df, F.lit("2024-01-15 00:00:00").cast("timestamp"), threshold=0.05).select("question", "source_type", "score").collect()
    assert sorted(x.score for x in out) == [0.5, round(0.5 + 0.04 * 0.5 ** (14 / 45), 6), 0.55]


def test_budget(spark):
    def fit(texts, *limits):
        df = spark.createDataFrame([(texts,)], "x array<string>").select(budget.fitting(F.col("x"), *limits).alias("y"))
        return [tuple(x) for x in df.first().y]

    assert fit(["a" * 50, " ", None, "b" * 50], 5, 0, 70) == [(0, "a" * 50), (3, "b" * 20)]
    assert fit(["a", "b"], 1, 0, 0) == [(0, "a")] and fit([], 1, 0, 0) == []
    texts = ["word " * 60, "x, y! " * 20, None, "last one here", "z" * 400]
    for limits in ((0, 0, 0), (3, 120, 300), (0, 100, 0, 20, 50), (4, 0, 500, 0, 45), (2, 7, 9)):
        assert fit(texts, *limits) == plain.fitting(texts, *limits)
    assert budget.prompt_mode(" Legacy-Reasoning ") == "legacy_reasoning" and budget.prompt_mode("x") == "grounded"


def test_answers(spark):
    rows = spark.createDataFrame([("q", 0, "a", 0.1, 0.1), ("q", 1, "b", 0.1, 0.9), ("s", 0, "c", 0.9, 0.9)], "query string, position int, answer string, relevance double, support double")
    ranked = answers.rank_answers(rows)
    assert {x.query: x.answer for x in answers.best_answers(ranked).collect()} == {"q": "b", "s": "c"}
    assert ranked.where("query = 's'").first().score == 0.0
    near = spark.createDataFrame([("q", 0, 1, " ", 0.9), ("q", 0, 2, "x", 0.4), ("q", 0, 9, "x", 0.8)], "query string, position int, context_no int, context string, score double")
    assert answers.support(near).first().support == 0.4


def test_models(spark):
    df = spark.createDataFrame([("a b", "a b c"), (None, "x")], "l string, r string")
    assert [x.s for x in df.select(score_pairs(F.col("l"), F.col("r"), OverlapScorer()).alias("s")).collect()] == [1.0, 0.0]
    v = df.select(embed(F.col("l"), HashEmbedder(8)).alias("v")).first().v
    assert len(v) == 8 and abs(sum(x * x for x in v) - 1) < 1e-6


def test_evaluation(spark):
    schema = "query_id string, question string, expected_source_refs array<string>, expected_chunk_ids array<string>, expected_answer_contains array<string>, answerable boolean"
    raw = spark.createDataFrame([("a", "Q?", [" r1 ", ""], [], ["x"], True), ("b", "Q?", [], ["c9"], [], None), ("c", "Q?", [], [], [], False)], schema)
    rows = spark.createDataFrame([("a", 1, "r0", "c0", None), ("a", 2, "r1", "c1", None), ("b", 1, "r0", "qa::1", "zz")], "query string, rank int, source_ref string, chunk_id string, linked_chunk_id string")
    best = evaluate.best_ranks(rows, evaluate.load_cases(raw))
    r = evaluate.recall_mrr(best, 5).first()
    assert (r.labelled, r.recall, r.mrr) == (2, 0.5, 0.25)
    assert evaluate.recall_mrr(best.limit(0), 5).first().recall is None
    with pytest.raises(Exception, match="case without question"):
        evaluate.load_cases(spark.createDataFrame([("a", " ", [], [], [], None)], schema)).collect()


def test_fetch_policy():
    now = dt.datetime(2024, 5, 10, tzinfo=UTC)
    assert chat.fetch_policy("").most == 10_000 and chat.fetch_policy("25").most == 25
    assert chat.fetch_policy("30d", now).after == now - dt.timedelta(days=30)
    p = chat.fetch_policy("01052021-11062021")
    assert p.after == dt.datetime(2021, 5, 1, tzinfo=UTC) and p.before == dt.datetime(2021, 6, 12, tzinfo=UTC)
    with pytest.raises(ValueError):
        chat.fetch_policy("soon")


def test_paged_fetch_retries_and_stops():
    item = lambda d: {"id": f"m{d}", "created": f"2024-01-{d:02}T00:00:00Z", "text": "x"}
    pages = {"p2": (200, {}, {"items": [item(2), item(1)]})}
    calls = []

    def get(url):
        calls.append(url)
        if len(calls) == 1:
            return 429, {"Retry-After": "3"}, None
        return pages["p2"] if url == "p2" else (200, {"Link": '<p2>; rel="next"'}, {"items": [item(9), item(8)]})

    waits = []
    chat_get = lambda url: get(url)
    assert chat.get_with_retry(chat_get, "p2", sleep=waits.append)[1]["items"] and waits == [3.0]
    policy = chat.FetchPolicy(after=dt.datetime(2024, 1, 2, tzinfo=UTC), most=None)
    assert [m["id"] for m in chat.fetch_room(get, "http://x", "r", policy)] == ["m2", "m8", "m9"]
    with pytest.raises(RuntimeError):
        chat.get_with_retry(lambda u: (500, {}, None), "x", sleep=lambda s: None)


def test_dump_and_rooms(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"items": [{"id": "1", "text": "x", "replies": [{"id": "2", "markdown": "y", "parentId": "1"}]}]}))
    (tmp_path / "b.jsonl").write_text('{"id": "3", "body": "z"}\n')
    (tmp_path / "c.json").write_text("{broken")
    assert {x.message_id for x in chat.read_dump(spark, str(tmp_path)).collect()} == {"1", "2", "3"}
    rooms = spark.createDataFrame([("r1", " A  b ", "group"), ("r2", "a B", "group"), ("r3", "x" * 200, "direct"), ("r1", "A b", "group")], "room_id string, title string, room_type string")
    names = [x.base_name for x in chat.file_names(chat.rooms_of(rooms)).collect()]
    assert len({n.lower() for n in names}) == 3 and max(map(len, names)) <= 80
    assert chat.rooms_of(rooms, "direct").count() == 1


def test_json_lines(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"a": 1}\n\n{"a": 2}\n{bad\n{"a": 3}\n')
    assert jsonl.line_count(spark, str(p)) == 4
    assert jsonl.read_tolerant(spark, str(p), "a int").where("a is not null").count() == 3
    assert jsonl.read_tolerant(spark, str(tmp_path / "none"), "a int").count() == 0
    with pytest.raises(Exception):  # noqa: B017
        jsonl.read_strict(spark, str(p), "a int").collect()
    lines = spark.createDataFrame(list(enumerate(p.read_text().splitlines())), "line_no int, value string")
    assert [x.line_no for x in jsonl.repair_tail(lines).orderBy("line_no").collect()] == [0, 1, 2]
    (tmp_path / "s.json").write_text('{"b": 1}')
    with pytest.raises(ValueError, match="unknown settings"):
        jsonl.read_settings(str(tmp_path / "s.json"), {"a"})


def test_incremental_batches(spark, tmp_path):
    from loomline.streaming import ingest

    source = str(tmp_path / "in")
    rows = spark.createDataFrame([("c1", "x"), ("c2", "y"), ("c1", "x")], "chunk_id string, text string")
    rows.write.parquet(source)
    stream = ingest.message_stream(spark, source, rows.schema)
    for _ in range(2):
        q = ingest.run_batches(stream, ingest.append_new(rows, str(tmp_path / "out")), str(tmp_path / "cp"))
        q.awaitTermination(120)
    rows.write.mode("append").parquet(source)
    ingest.run_batches(stream, ingest.append_new(rows, str(tmp_path / "out")), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_sparse_ways_agree(spark):
    docs = spark.createDataFrame([(i, f"rule {i % 3} node {i % 5} cap") for i in range(30)] + [(99, None)], "doc int, text string")
    v = sparse.vector_lists(docs, "doc", "text")
    q = v.where("doc < 4").withColumnRenamed("doc", "query")
    n = docs.agg(F.count("*").alias("n")).scalar()
    ways = [sorted(map(tuple, retrieve.sparse_topk(v, sparse.doc_frequency(v), n, q, 4, entries=e, cells=7).select("query", "doc", "score", "rank").collect())) for e in (1000, 0)]
    assert ways[0] == ways[1] and len(ways[0]) == 16


def test_vectors_equal_a_counter(spark):
    import collections
    import math

    texts = ["a bb bb cc-dd CC", "", None, "x " * 5, "rule " * 700 + " ".join(f"t{i}" for i in range(600))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc int, text string")
    terms = {r.doc: r.t for r in docs.select("doc", T.lexical_terms(F.col("text")).alias("t")).collect()}
    for most in (0, 3, 512):
        got = {r.doc: {(x.term, round(x.weight, 9)) for x in r.v} for r in sparse.vector_lists(docs, "doc", "text", most).collect()}
        for i, t in terms.items():
            want = {(k, round(1 + math.log(n), 9)) for k, n in collections.Counter(t).items()}
            assert got[i] == want if most == 0 or len(want) <= most else got[i] < want and len(got[i]) == most
    stored = sparse.sparse_vectors(docs, "doc", "text").collect()
    assert {r.doc for r in stored} == {0, 4} and all(r.indices == sorted(r.indices) for r in stored)


def test_search_reads_stored_vectors(spark):
    from loomline.models import EmbeddingScorer, HashEmbedder, OverlapScorer

    class Broken:
        def predict(self, pairs):
            raise RuntimeError("no model")

    rows = [(f"p{i}", f"c{i}", "d", f"pdf::f#{i}", "pdf", t, t, "chunk", {"ingested_at": "2024"}) for i, t in enumerate(["the rule moves with the group", "a gateway drops the message", "the pool of the gateway", "rule of the pool"])]
    df = spark.createDataFrame(rows, "point_id string, chunk_id string, doc_id string, source_ref string, source_type string, text string, retrieval_text string, record_type string, metadata map<string,string>")
    asked = spark.createDataFrame([("q", "which gateway drops it"), ("none", "??")], "query string, search string")
    now = F.lit("2025-01-01 00:00:00").cast("timestamp")
    full = index.with_vectors(df, HashEmbedder(32))
    run = lambda x, **kw: [(r.query, r.rank, r.chunk_id, r.score) for r in retrieve.search(x, asked, now, HashEmbedder(32), fetch=4, k=2, **kw).orderBy("query", "rank").collect()]
    assert run(full) == run(df) and [x for x in run(full) if x[0] == "q"][0][2] == "c1"
    assert retrieve.is_hybrid(full) and not retrieve.is_hybrid(index.with_vectors(df, HashEmbedder(32), sparse=False))
    assert run(index.with_vectors(df, HashEmbedder(32), sparse=False))
    assert run(full, scorers=(Broken(), OverlapScorer())) == run(full, scorers=(OverlapScorer(),)) != run(full)
    assert run(full, scorers=(Broken(),)) == run(full) and run(full, scorers=(EmbeddingScorer(HashEmbedder(32)),))
    old = df.withColumn("metadata", F.create_map(F.lit("ingested_at"), F.lit("2023"))).withColumn("text", F.lit("older"))
    assert {r.text for r in index.newest(old.unionByName(df)).collect()} == {r[5] for r in rows}
    with pytest.raises(ValueError):
        index.index_rows(df.limit(0), required=True)


CHUNK = "chunk_id string, doc_id string, source_ref string, source_type string, text string, metadata map<string,string>"


def test_generation_resumes(spark, tmp_path):
    from loomline.models import PassageGenerator
    from loomline.operators import generation

    class Flaky(PassageGenerator):
        def generate(self, prompt, seed=0):
            if "breaks" in prompt:
                raise RuntimeError("model")
            return "no json at all" if "unparsable" in prompt else super().generate(prompt, seed)

    thread = "[2024] Ann: where is the rule of the group kept\n[2024] Bob: it is kept in the group of the tenant, always\n[2024] Cy: yes"
    meta = {"thread_id": "t", "message_count": "3"}
    long = "The rule moves with the group of the tenant. The pool drops what it cannot keep. " * 4
    rows = [
        ("a", "d", "r", "pdf", long, {}), ("b", "d", "r", "webex", thread, meta), ("c", "d", "r", "webex", "[2024] Ann: hi", {}), ("e", "d", "r", "pdf", "it breaks here and there", {}), ("f", "d", "r", "pdf", "unparsable text of a page", {}),
        ("g", "d", "r", "pdf", "Short. No.", {}), ("h", "d", "r", "webex", "[2024] Ann: only the first message of the thread", {**meta}), ("n", "d", "r", "pdf", None, None), ("z", "d", "r", "pdf", "  ", {}),
    ]
    chunks = spark.createDataFrame(rows, CHUNK)
    cfg = generation.GenerationConfig(least_chat_chars=20)
    at = [str(tmp_path / x) for x in ("pairs", "progress")]
    counts = generation.run_generation(spark, chunks, *at, Flaky(), cfg)
    assert counts == {"completed": 2, "skipped_short_webex": 1, "no_valid_qa": 1, "filtered_after_validation": 1, "skipped_webex_thread_without_answer": 1}
    pairs = {x.chunk_id: x for x in spark.read.parquet(at[0]).collect()}
    assert set(pairs) == {"a", "b"} and pairs["b"].answer == "it is kept in the group of the tenant, always\n\nyes" and pairs["b"].metadata.thread_reply_count == 2
    assert pairs["a"].metadata.qa_generation_mode is None and pairs["a"].metadata.chunk_text == long.strip()
    assert generation.run_generation(spark, chunks, *at, PassageGenerator(), cfg) == {"completed": 1}  # the one that failed
    assert generation.run_generation(spark, chunks, *at, PassageGenerator(), cfg) == {}
    assert sum(generation.run_generation(spark, chunks, *at, Flaky(), cfg, resume=False).values()) == 6
    only = generation.GenerationConfig(least_chat_chars=20, user="bOB")
    judged = {x.chunk_id: (x.status, [p.answer for p in x.pairs]) for x in generation.judged_chunks(chunks, Flaky(), only).where("source_type = 'webex'").collect()}
    assert judged["b"] == ("completed", ["it is kept in the group of the tenant, always"]) and judged["h"][0] == "skipped_webex_user_filter"
    assert generation.first_chunks(chunks, 2, "chunk_id").count() == 2 and generation.first_chunks(chunks, 0, "chunk_id").count() == 7


def test_bundles_carry_and_check_vectors(spark, tmp_path):
    df = spark.createDataFrame([("a", "pdf", [1.0, 0.0]), ("b", "webex", [0.0, 1.0])], "point_id string, source_type string, dense array<double>")
    at, to = str(tmp_path / "bundle"), str(tmp_path / "index")
    manifest = index.export_index(df, at, distance="Dot")
    assert index.read_vectors_config(manifest["vectors_config"]) == {"dense": (2, "dot")}
    assert index.import_index(spark, at, df.schema, to).count() == 2
    index.export_index(df.where("point_id = 'a'").withColumn("dense", F.array(F.lit(0.5), F.lit(0.5))), at)
    index.import_index(spark, at, df.schema, to)
    assert {(r.point_id, tuple(r.dense)) for r in spark.read.parquet(to).collect()} == {("a", (0.5, 0.5)), ("b", (0.0, 1.0))}
    index.import_index(spark, at, df.schema, to, recreate=True)
    assert spark.read.parquet(to).count() == 1
    for bad in (df.withColumn("dense", F.when(F.col("point_id") == "a", F.col("dense"))), df.withColumn("point_id", F.lit(None).cast("string"))):
        index.export_index(bad, at)
        with pytest.raises(Exception, match="point without"):
            index.import_index(spark, at, df.schema).collect()
    with pytest.raises(ValueError):
        index.read_manifest(spark, str(tmp_path / "index"))
    single = index.vectors_config(3, "Euclid", None)
    assert index.read_vectors_config(single) == {None: (3, "euclid")} and index.read_sparse_config(index.sparse_config(modifier="")) == {"sparse": None}
    for wrong in ({"kind": "named", "vectors": {}}, {"kind": "other"}, {"size": 1, "distance": "near"}):
        with pytest.raises(ValueError):
            index.read_vectors_config(wrong)
    with pytest.raises(ValueError):
        index.read_sparse_config({"s": {"modifier": "tf"}})


def test_validation_reasons(spark):
    rows = [("1", None, "a" * 30, "m", "a" * 30), ("2", "short", "a" * 30, "m", "x"), ("3", "a question that is long", "word " * 20, "webex_thread_question_child_messages_answer", "word"), ("4", "a question that is long", "word " * 20, "m", "word"), ("5", "A  question that is LONG", "word " * 10, None, "word"), ("6", "another long question", "word " * 10, None, None)]
    df = spark.createDataFrame(rows, "pos string, question string, answer string, mode string, context string")
    got = {r.pos: r.reason for r in qa.judge(df, "pos", mode="mode", required=("question",), most_thread_a=60).collect()}
    assert got == {"1": "invalid_schema", "2": "short_question", "3": "answer_length", "4": "keep", "5": "duplicate_question", "6": "weak_grounding"}


def test_files_and_sinks(spark, tmp_path):
    from loomline.plans import feedback
    from loomline.sources import jsonl, pdf

    at = tmp_path / "x.jsonl"
    at.write_text('{"a": 1}\n\n{"a": 2}\n{"a": \n{"a": 4}\n')
    assert jsonl.repair_file(spark, str(at), str(tmp_path / "fixed")) == 2
    assert [r.value for r in spark.read.text(str(tmp_path / "fixed")).collect()] == ['{"a": 1}', '{"a": 2}']
    assert jsonl.access_token({"access_token": " t "}, "NO_SUCH_VARIABLE") == "t"
    with pytest.raises(ValueError):
        jsonl.access_token({}, "NO_SUCH_VARIABLE")
    rows = spark.createDataFrame([("m", "up")], "message_id string, rating string")
    feedback.append_feedback(rows, str(tmp_path / "f"))
    feedback.append_feedback(rows, str(tmp_path / "f"))
    assert spark.read.json(str(tmp_path / "f")).count() == 2
    with pytest.raises(Exception, match="up or down"):
        feedback.append_feedback(rows.withColumn("rating", F.lit("meh")), str(tmp_path / "f"))
    contents = spark.createDataFrame([("f", "T", 5, [(0, 1, "One", 1), (1, 1, "Two", 3)], None), ("bad", None, None, None, "no pdf")], pdf.TOC)
    assert [(x.title, x.page_start, x.page_end) for x in sections.section_ranges(*pdf.contents_tables(contents)).orderBy("section_no").collect()] == [("One", 1, 2), ("Two", 3, 5)]


def test_hub_join_splits_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(skew, "LEAST", 20)
    monkeypatch.setattr(skew, "TASK_ROWS", 10)
    left = spark.range(500).select(F.when(F.col("id") < 300, "hot").when(F.col("id") < 310, None).otherwise(F.concat(F.lit("k"), F.col("id"))).alias("k"), "id", F.create_map(F.lit("a"), F.col("id").cast("string")).alias("m"))
    right = spark.createDataFrame([("hot", 1), ("k400", 2), ("other", 3)], "k string, v int")
    assert skew.hubs_of(left, "k") == [("hot", 30)]
    for how in ("inner", "left"):
        rows = lambda d: sorted((x.k or "", x.id, x.v or 0) for x in d.collect())
        assert rows(skew.hub_join(left, right, "k", how)) == rows(left.join(right, "k", how))


def test_command_line_from_dump_to_report(spark, tmp_path):
    import hashlib
    import json

    from loomline import cli

    dump = [{"id": f"m{i}", "roomId": "r", "parentId": None if i % 3 == 0 else f"m{i - i % 3}", "personDisplayName": "Ann" if i % 3 == 0 else "Bob", "created": f"2024-01-0{1 + i // 3}T10:0{i}:00Z", "text": f"the rule number {i} moves with the group of the tenant and stays there", "markdown": f"**rule {i}**" if i == 1 else None, "files": ["f"] if i == 1 else []} for i in range(9)]
    (tmp_path / "dump.json").write_text(json.dumps({"items": dump}))
    at = lambda x: str(tmp_path / x)
    run = lambda *a: cli.main(list(a))
    run("ingest-chat", "--input", at("dump.json"), "--output", at("docs"))
    docs = spark.read.parquet(at("docs")).orderBy("source_ref").collect()
    assert len(docs) == 3 and json.loads(docs[0].metadata["message_ids"]) == ["m0", "m1", "m2"] and docs[0].metadata["files"] == '["f"]' and docs[0].metadata["thread_start_author"] == "Ann"
    assert docs[0].markdown == "[2024-01-01T10:01:00Z] Bob: **rule 1**" and docs[1].markdown is None
    run("chunk", "--input", at("docs"), "--output", at("chunks"))
    run("generate", "--input", at("chunks"), "--output", at("pairs"))
    run("validate", "--input", at("pairs"), "--output", at("judged"))
    run("split", "--input", at("pairs"), "--output", at("split"))
    assert spark.read.parquet(at("judged")).count() == spark.read.parquet(at("split")).count() == 3
    run("index", "--chunks", at("chunks"), "--pairs", at("pairs"), "--output", at("index"))
    spark.createDataFrame([("q", "which rule number 4 moves")], "query string, search string").write.parquet(at("queries"))
    run("search", "--input", at("index"), "--queries", at("queries"), "--output", at("found"), "--k", "3")
    assert 0 < spark.read.parquet(at("found")).count() <= 3
    chunk = spark.read.parquet(at("chunks")).first().chunk_id
    spark.createDataFrame([("c", "which rule moves", ["x"], [chunk], [], True)], "query_id string, question string, expected_source_refs array<string>, expected_chunk_ids array<string>, expected_answer_contains array<string>, answerable boolean").write.parquet(at("cases"))
    run("eval-retrieval", "--input", at("index"), "--cases", at("cases"), "--output", at("report"))
    assert spark.read.parquet(at("report")).first().match_rank is not None
    run("export", "--input", at("index"), "--output", at("bundle"))
    run("import", "--input", at("bundle"), "--output", at("again"))
    assert spark.read.parquet(at("again")).count() == spark.read.parquet(at("index")).count() == 6
    assert retrieve.capability(spark.read.parquet(at("again"))) == ("dense", True)
    ids = spark.createDataFrame([("rule",), (None,)], "t string").select(sparse.blake2b_id(F.col("t")).alias("i")).collect()
    assert [r.i for r in ids] == [int.from_bytes(hashlib.blake2b(b"rule", digest_size=4).digest(), "big"), None]


@pytest.mark.parametrize("entries", [1000, 0])
def test_sparse_search_shuffles_few_rows(spark, monkeypatch, entries):
    """k rows a query and task leave the scan, whatever the steps and the number of scans."""
    docs = spark.createDataFrame([(i, f"rule {i % 7} node {i % 5} cap") for i in range(200)], "doc int, text string").coalesce(2)
    v = sparse.vector_lists(docs, "doc", "text")
    q = v.where("doc < 4").withColumnRenamed("doc", "query")
    n = docs.agg(F.count("*").alias("n")).scalar()
    monkeypatch.setattr(retrieve, "_top", lambda scored, k: scored)
    assert retrieve.sparse_topk(v, sparse.doc_frequency(v), n, q, 3, entries=entries, cells=7).count() <= 2 * 4 * 3


def test_sparse_search_equals_a_plain_one(spark):
    """Frequent and rare terms, several steps and blocks, ties: as a sum for each pair gives it."""
    import math
    import random

    r = random.Random(3)
    texts = {f"d{i}": " ".join(r.choice(("often", "usual", "plain", f"w{r.randrange(60)}")) for _ in range(12)) for i in range(120)}
    texts |= {f"copy{i}": texts["d1"] for i in range(9)} | {"none": ""}
    docs = spark.createDataFrame(list(texts.items()), "doc string, text string").repartition(3, "doc")
    v = sparse.vector_lists(docs, "doc", "text")
    q = v.where("doc like 'd%'").withColumnRenamed("doc", "query")
    vectors = {x.doc: {t.term: t.weight for t in x.v} for x in v.collect()}
    df = {}
    for x in vectors.values():
        for t in x:
            df[t] = df.get(t, 0) + 1
    idf = {t: math.log(1 + (len(texts) - m + 0.5) / (m + 0.5)) for t, m in df.items()}
    expected = set()
    for name in (d for d in texts if d.startswith("d")):
        scores = {d: sum(w * x[t] * idf[t] for t, w in vectors[name].items() if t in x) for d, x in vectors.items() if x.keys() & vectors[name].keys()}
        best = sorted(scores.items(), key=lambda s: (-round(s[1], 6), s[0]))[:5]
        expected |= {(name, d, i + 1) for i, (d, s) in enumerate(best)}
    n = docs.agg(F.count("*").alias("n")).scalar()
    for entries, cells in ((2_000_000, 2_000_000), (300, 500)):
        found = retrieve.sparse_topk(v, sparse.doc_frequency(v), n, q, 5, entries=entries, cells=cells).collect()
        assert {(x.query, x.doc, x["rank"]) for x in found} == expected and len(found) == len(expected)


@pytest.fixture
def few_documents(spark, tmp_path):
    """A folder with 40 documents of 1,500 characters and four vectors."""
    docs = spark.createDataFrame([(i, f"source {i % 3}", f"rule {i % 3} node " * 120) for i in range(1, 41)], "doc_id long, source string, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(20 * i, [1.0, float(i)]) for i in range(1, 5)], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    return str(tmp_path)


def test_context_ships_clipped_texts(spark, few_documents, monkeypatch):
    from loomline import queries

    real, seen = budget.select_context, []
    monkeypatch.setattr(budget, "select_context", lambda ranked, **limits: seen.append(ranked) or real(ranked, **limits))
    found = queries.context_budget(spark, few_documents)
    assert seen[0].agg(F.max(F.length("text"))).first()[0] <= 800
    texts = spark.read.parquet(f"{few_documents}/documents.parquet").select(F.col("source").alias("source_ref"), "text").distinct()
    whole = real(seen[0].drop("text").join(texts, "source_ref"), rows=6, chunk_chars=800, total_chars=2400, total_tokens=500)
    assert found.count() > 2 and sorted(map(tuple, found.collect())) == sorted(map(tuple, whole.select(found.columns).collect()))


def test_prompts_leave_no_vectors(spark, few_documents):
    """What the ranks were made from is deleted before texts are joined; each query has its prompt."""
    from loomline import queries, session

    before = set(map(id, session._STAGES))
    assert queries.prompts(spark, few_documents).count() == 2
    assert [s.at.split("loomline-")[-1].split("-")[0] for s in session._STAGES if id(s) not in before] == ["ranked"]


def test_hybrid_search_leaves_no_vectors(spark, few_documents):
    from loomline import queries, session

    before = set(map(id, session._STAGES))
    found = queries.hybrid_rrf(spark, few_documents)
    assert {x.query for x in found.collect()} == {20, 40, 60, 80} and found.where("rank = 1").count() == 4
    assert [s.at.split("loomline-")[-1].split("-")[0] for s in session._STAGES if id(s) not in before] == ["ranked"]


def test_source_cap_leaves_no_vectors(spark, few_documents):
    from loomline import queries, session

    before = set(map(id, session._STAGES))
    found = queries.source_cap(spark, few_documents)
    assert found.groupBy("query").count().where("count <> 5").count() == 0 and {x.query for x in found.collect()} == {20, 40}
    assert [s.at.split("loomline-")[-1].split("-")[0] for s in session._STAGES if id(s) not in before] == ["ranked"]


def test_hybrid_search_sends_packed_queries(spark, tmp_path, monkeypatch):
    """Files of what is broadcast lie at the driver and at every executor: a few bytes a term of a query, and the same scores."""
    import pickle
    import random

    import numpy as np
    from pyspark import SparkContext

    from loomline import queries

    r = random.Random(5)
    docs = spark.createDataFrame([(i, f"source {i % 3}", " ".join(f"w{r.randrange(300)}" for _ in range(80))) for i in range(1, 1201)], "doc_id long, source string, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(20 * i, [1.0, float(i)]) for i in range(1, 5)], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    entries = sparse.vector_lists(docs.where("doc_id % 20 = 0"), "doc_id", "text").agg(F.sum(F.size("v"))).first()[0]
    real, sent = SparkContext.broadcast, []
    monkeypatch.setattr(SparkContext, "broadcast", lambda self, value: sent.append(pickle.dumps(value)) or real(self, value))
    assert queries.hybrid_rrf(spark, str(tmp_path)).select("query").distinct().count() == 60
    assert len(sent) == 2 and max(map(len, sent)) < 6 * entries
    values = [np.array(x) for x in ([7, 7, 9, 7, 3, 9], [1, 0, 0, 2, 2, 1], [0.5, 0.5, 2.0, 1.0, 4.0, 2.0], [0.9, 0.9, 0.001, 0.9, 0.3, 0.001])]
    whole, again = retrieve.QueryPostings(*values, 4, 2), pickle.loads(pickle.dumps(retrieve.SentQueries(*values, 4, 2)))
    found = lambda x: [(f, j, s.tolist()) for f, j, s in x.scores(np.array([0, 2, 4]), np.array([3, 7, 8, 9]), np.array([1.0, 2.0, 3.0, 0.5]), 1)]
    assert found(again) == found(whole) and any(map(np.any, (s for _, _, s in found(whole))))


def test_source_cap_stages_numbered_terms(spark, few_documents, monkeypatch):
    """The vectors that are written hold a number a term, neither its letters nor a second id."""
    from loomline import queries

    real, kinds = queries.cut, {}
    monkeypatch.setattr(queries, "cut", lambda df, label="stage": kinds.update({label: dict(df.dtypes)}) or real(df, label))
    found = queries.source_cap(spark, few_documents)
    assert kinds["vectors"] == {"doc": "bigint", "v": "array<struct<term:bigint,weight:double>>"}
    assert [x.doc for x in found.where("query = 20").orderBy("rank").collect()] == [1, 2, 3, 4, 5]


def test_prompts_shuffle_no_query_terms(spark, few_documents, monkeypatch):
    """Document frequencies go to the terms of the queries, as long as they are few; the shuffled way gives the same."""
    from loomline import queries

    real, plans, found = retrieve.cut, [], []
    keep = lambda df, label="stage": (label == "asked" and plans.append(df._jdf.queryExecution().executedPlan().toString())) or real(df, label)
    monkeypatch.setattr(retrieve, "cut", keep)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for most in (retrieve.SENT_TERMS, 0):
            monkeypatch.setattr(retrieve, "SENT_TERMS", most)
            found.append(sorted(map(tuple, queries.prompts(spark, few_documents).collect())))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plans[0] and "SortMergeJoin" in plans[1]
    assert found[0] == found[1] and len(found[0]) == 2
