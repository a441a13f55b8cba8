"""Splits by group, overlaps, splitting, encoding, leaks: against brute force on small tables."""

import random
import re

import pytest

from loomline.llm import bpe, groups, leakage, overlap, splitting

QA = "qa_id string, question string, answer string, chunk_id string, doc_id string, source_type string, extra string"
WORD = re.compile(r"[^\W_]+")


def qa(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], QA)


def brute_groups(rows):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    clean = lambda v: (v or "").strip().lower() or None
    for q, _, _, c, d, _ in rows:
        for node in (("c", clean(c)), ("d", clean(d))):
            if node[1]:
                parent[find(node)] = find(("q", q))
        find(("q", q))
    members, docs = {}, {}
    for q, _, _, _c, d, _ in rows:
        root = find(("q", q))
        members.setdefault(root, set()).add(q)
        if clean(d):
            docs.setdefault(root, set()).add(clean(d))
    return {(q, min(docs[r]) if r in docs else None) for r, m in members.items() if len(m) > 1 for q in m}


def test_groups_match_union_find(spark):
    r = random.Random(3)
    rows = [(f"q{i}", "q", "a", r.choice([None, " ", f"C{r.randint(0, 40)} "]), r.choice([None, f"d{r.randint(0, 60)}", f" D{r.randint(0, 60)}"]), "pdf") for i in range(90)]
    rows += [("q1", "q", "a", "c1", "d59", "pdf"), rows[5], ("lone", "q", "a", None, None, None)]
    got = {tuple(x) for x in groups.found_groups(qa(spark, rows)).collect()}
    assert got == brute_groups(rows)


def test_groups_on_a_hub_and_a_chain(spark):
    rows = [(f"h{i}", "q", "a", f"c{i}", "hub", "pdf") for i in range(300)] + [(f"p{i}", "q", "a", f"k{i // 2}", f"e{(i + 1) // 2}", "pdf") for i in range(60)]
    assert {tuple(x) for x in groups.found_groups(qa(spark, rows)).collect()} == brute_groups(rows)


def test_splits_keep_groups_and_sizes(spark):
    rows = [(f"q{i}", "q", "a", None, f"d{i // 4}", "pdf") for i in range(400)]
    targets = spark.createDataFrame([("train", 0.8), ("valid", 0.1), ("test", 0.1)], "split_name string, share double")
    out = groups.assign_splits(qa(spark, rows), targets).collect()
    assert len({x.qa_id for x in out}) == len(out) == 400
    by = {}
    for x in out:
        by.setdefault(x.group_id, set()).add(x.split_name)
    assert all(len(v) == 1 for v in by.values())
    assert sum(x.split_name == "train" for x in out) == 320
    few = groups.assign_splits(qa(spark, rows), targets, large=1, cells=16).collect()
    assert 0.6 < sum(x.split_name == "train" for x in few) / 400 < 0.95
    more = [*rows, *[(f"g{i}", "q", "a", None, "giant", "pdf") for i in range(200)], *[(f"m{i}", "q", "a", None, f"e{i // 3}", "pdf") for i in range(300)]]
    out = groups.assign_splits(qa(spark, more), targets).collect()
    assert {x.split_name for x in out if x.qa_id.startswith("g")} == {"train"}
    assert abs(sum(x.split_name == "train" for x in out) - 720) <= 8 and abs(sum(x.split_name == "test" for x in out) - 90) <= 8


def test_groups_of_nothing(spark):
    assert groups.found_groups(qa(spark, [])).count() == 0
    targets = spark.createDataFrame([("train", 1.0)], "split_name string, share double")
    assert groups.assign_splits(qa(spark, []), targets).count() == 0


def near_pairs(records, splits, share=0.7):
    label = {}
    for q, s in splits:
        if s and (n := overlap.LABELS.get(s.strip().lower())):
            label.setdefault(q, set()).add(n)
    words = lambda t: frozenset(WORD.findall((t or "").lower()))
    ok = lambda a, b: len(a & b) >= share * len(a | b) - 1e-9
    rows = [(q, words(x), words(y)) for q, x, y, *_ in records if q in label]
    out = set()
    for a in rows:
        for b in rows:
            if a[0] < b[0] and ok(a[1], b[1]) and ok(a[2], b[2]):
                la, lb = label[a[0]], label[b[0]]
                if ("train" in la and lb - {"train"}) or ("train" in lb and la - {"train"}):
                    out.add((a[0], b[0]))
    return out


@pytest.mark.parametrize("wide", [10_000, 1])
def test_overlaps_match_brute_force(spark, wide):
    r = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    records, splits = [], []
    for i in range(40):
        q, a = [r.choice(vocab) for _ in range(24)], [r.choice(vocab) for _ in range(30)]
        for j in range(3):
            q2, a2 = list(q), list(a)
            for _ in range(j):
                q2[r.randrange(24)] = r.choice(vocab)
                a2.insert(r.randrange(30), "also")
            records.append((f"r{i}-{j}", " ".join(q2).title() if j == 1 else " ".join(q2), ", ".join(a2), None, None, "pdf"))
            splits.append((f"r{i}-{j}", r.choice([" Train", "TRAIN", "test", "validation", None, "other"])))
    records += [("n1", None, None, None, None, None), ("n2", "", "", None, None, None), records[0]]
    splits += [("n1", "train"), ("n2", "test"), splits[0]]
    s = spark.createDataFrame(splits, "qa_id string, split_name string")
    pairs = overlap.cross_split_overlaps(qa(spark, records), s, wide=wide).collect()
    got = {(min(p.eval_id, p.train_id), max(p.eval_id, p.train_id)) for p in pairs}
    assert got == near_pairs(records, splits)
    if wide > 1:  # the suffix array alone
        alone = overlap.cross_split_overlaps(qa(spark, records), s, exact=False).collect()
        alone = {(min(p.eval_id, p.train_id), max(p.eval_id, p.train_id)) for p in alone}
        text = {q: [WORD.findall(f"{x or ''}".lower()), WORD.findall(f"{y or ''}".lower())] for q, x, y, *_ in records}
        n = overlap.SPAN + overlap.STEP - 1
        grams = {q: {tuple(w[i : i + n]) for w in ws for i in range(len(w) - n + 1)} for q, ws in text.items()}
        assert alone <= got and alone >= {(a, b) for a, b in got if grams[a] & grams[b]}
        counted = {(x.split_name, x.source_type): (x.records, x.pairs) for x in overlap.overlap_counts(qa(spark, records), s).collect()}
        for key, n in counted.items():
            mine = [p for p in pairs if (p.eval_split, p.eval_source) == key]
            assert n == (len({p.eval_id for p in mine}), len(mine))
        assert sum(n for _, n in counted.values()) == len(pairs)


def test_overlap_of_nothing(spark):
    s = spark.createDataFrame([], "qa_id string, split_name string")
    assert overlap.found_overlaps(qa(spark, []), s).count() == 0
    assert overlap.coverage(qa(spark, []), s).count() == 0


def test_coverage_merges_spans(spark):
    body = [f"b{i}" for i in range(60)]
    records = [("t", "x y", " ".join(body[:40]), None, None, "pdf"), ("u", "z", " ".join(body[20:60]), None, None, "pdf"), ("e", "q r", " ".join(["new"] * 5 + body), None, None, "pdf"), ("n", "", " ".join(f"c{i}" for i in range(30)), None, None, "pdf"), ("k", "x y", " ".join(body[:40]), None, None, "webex")]
    splits = [("t", "train"), ("u", "train"), ("e", "test"), ("n", "valid"), ("k", "test")]
    s = spark.createDataFrame(splits, "qa_id string, split_name string")
    got = {x.qa_id: (x.split_name, x.words, x.covered) for x in overlap.coverage(qa(spark, records), s).collect()}
    assert got["n"] == ("valid", 30, 0) and got["k"] == ("test", 42, 42)
    assert got["e"][1] == 67 and 40 <= got["e"][2] <= 62


@pytest.mark.parametrize("most_bits", [27, 10])
def test_coverage_sees_every_place(spark, monkeypatch, most_bits):
    """A common run of 12 to 22 words is covered from its first word to its last, however full the bitmap is."""
    monkeypatch.setattr(overlap, "MOST_BITS", most_bits)
    records, splits, expected = [], [], {}
    for i in range(60):
        n = 11 + i % 12
        run = [f"r{i}x{j}" for j in range(n)]
        for kind, split in (("t", "train"), ("e", "test")):
            records.append((f"{kind}{i}", f"{kind}{i} q", " ".join([f"{kind}{i}y{j}" for j in range(1 + i % 7)] + run + [f"{kind}{i}z{j}" for j in range(9)]), None, None, "pdf"))
            splits.append((f"{kind}{i}", split))
        expected[f"e{i}"] = n if n >= 12 else 0
    s = spark.createDataFrame(splits, "qa_id string, split_name string")
    assert {x.qa_id: x.covered for x in overlap.coverage(qa(spark, records), s).collect()} == expected


@pytest.mark.parametrize("rows,batch", [(700, 50), (300, 300)])
def test_runs_across_edges_and_batches(rows, batch):
    """The pass over sorted suffixes gives the pairs of every run, whatever the partitions and batches."""
    import numpy as np
    import pyarrow as pa

    r = random.Random(rows)
    items = sorted(([r.choice([1, 2]) for _ in range(5)], i, r.random() < 0.5) for i in range(rows))
    run = overlap._neighbours(3, 10_000)

    def batches(part):
        for k in range(0, len(part), batch):
            some = part[k : k + batch]
            keys = [np.array(w, dtype=">u4").tobytes() for w, _, _ in some]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([c for _, c, _ in some]), pa.array([0] * len(some), pa.int32()), pa.array([e for *_, e in some]), pa.array([not e for *_, e in some])], names=["key", "class", "pos", "e", "t"])

    pairs, edges = set(), {}
    for part in (items[: rows // 3], items[rows // 3 :]):
        for out in run(batches(part)):
            for x in out.to_pylist():
                if x["prefix"] is None:
                    pairs.add((x["ec"], x["tc"]))
                else:
                    edges.setdefault(x["prefix"], []).append((x["ec"], x["e"]))
    for members in edges.values():
        pairs |= {(a, b) for a, ea in members for b, eb in members if ea and not eb}
    expected = {(a[1], b[1]) for a in items for b in items if a[0][:3] == b[0][:3] and a[2] and not b[2]}
    assert pairs == expected


TEXTS = ["", "short", "word " * 500, "a" * 3000, "One sentence. " * 200, "para one is here.\n\n" * 150, "é́" * 900, "👩‍👩‍👧" * 400, "x\n" * 900, "no space," * 300]


@pytest.mark.parametrize("limit,overlap_chars", [(100, 20), (1100, 180), (50, 0), (7, 6)])
def test_cuts_cover_and_stay_within(limit, overlap_chars):
    for text in TEXTS:
        pieces = splitting.cut_offsets(text, limit, overlap_chars)
        assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
        assert all(b - a <= limit for a, b in pieces)
        assert all(n[0] <= p[1] and n[0] > p[0] and n[1] > p[1] for p, n in zip(pieces, pieces[1:]))


def test_cuts_prefer_paragraphs_and_balance():
    text = ("Sentence one is here. Sentence two follows.\n\n") * 60
    pieces = splitting.cut_offsets(text, 1000, 100)
    sizes = [b - a for a, b in pieces]
    assert all(text[b - 2 : b] == "\n\n" or b == len(text) for _, b in pieces)
    assert max(sizes) - min(sizes) < 300


def test_split_table_edges(spark):
    rows = [("a", None, "z"), ("b", "", "z"), ("c", "w " * 300, "z"), ("c", "w " * 300, "z"), ("d", "ok", "z")]
    df = spark.createDataFrame(rows, "chunk_id string, text string, record_id string")
    out = splitting.split_oversized(df, "chunk_id", 100, 10).collect()
    assert {x.record_id for x in out} == {"c"} and len(out) == len({x.piece_no for x in out})
    assert all(len(x.text) <= 100 and x.text == ("w " * 300)[x.start : x.end] for x in out)
    assert {x.record_id for x in splitting.split_oversized(df, "chunk_id", 100, None, keep_small=True).collect()} == {"c", "d"}


CORPUS = ["", None, "Hello world, it's 2024!", "  two  spaces\n\n\tand tabs  nbsp", "naïve café Ünïcödé 漢字かな 🧩🧩👩‍👩‍👧", "x" * 700, "don't we'll I'm", "​﻿", "Drenmetal 520336,594535", "<|endoftext|>", "é \x85 end"]


def expected_ids():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{bpe.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch([c or "" for c in CORPUS], add_special_tokens=False)]


@pytest.mark.parametrize("limit", [100_000, 4, 0])
def test_encoding_equals_the_library_and_decodes(spark, limit):
    docs = spark.createDataFrame([(i, c, [1]) for i, c in enumerate(CORPUS)], "doc_id long, text string, ids array<int>")
    out = {x.doc_id: x for x in bpe.decode_ids(bpe.encode_corpus(docs, literal_words=limit, block=3)).collect()}
    assert [list(out[i].ids) for i in range(len(CORPUS))] == expected_ids()
    assert [out[i].text for i in range(len(CORPUS))] == [c or "" for c in CORPUS]


def test_encoding_of_repeated_ids_and_nothing(spark):
    schema = "doc_id long, text string"
    assert bpe.encode_corpus(spark.createDataFrame([], schema)).count() == 0
    out = bpe.encode_corpus(spark.createDataFrame([(1, "b"), (1, "a"), (1, "a")], schema)).collect()
    assert len(out) == 1 and len(out[0].ids) == 1


def test_leaks_match_brute_force(spark):
    r = random.Random(9)
    vocab = [f"t{i}" for i in range(80)]
    passages = [(f"case-{i}", " ".join(r.choice(vocab) for _ in range(r.choice([5, 14, 30])))) for i in range(12)] + [("blank", " "), ("null", None)]
    docs = []
    for i in range(60):
        body = [r.choice(vocab) for _ in range(40)]
        if i % 3 == 0:
            p = passages[r.randrange(12)][1].split()
            k = r.choice([8, 11, 12, 13, 30])
            body[10:10] = p[:k]
        docs.append((i, r.choice([" ", ", ", "\n"]).join(body).upper() if i % 2 else " ".join(body)))
    docs += [(100, None), (101, ""), docs[0]]
    expected = set()
    for d, text in docs:
        w = WORD.findall((text or "").lower())
        grams = {tuple(w[i : i + 12]) for i in range(len(w) - 11)}
        for q, p in passages:
            pw = WORD.findall((p or "").lower())
            if any(tuple(pw[i : i + 12]) in grams for i in range(len(pw) - 11)):
                expected.add((d, q))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    e = spark.createDataFrame(passages, "query_id string, gold_passage string")
    assert {(x.doc_id, x.query_id) for x in leakage.find_leaks(d, e).collect()} == expected
    assert leakage.find_leaks(d.limit(0), e).count() == 0 and leakage.find_leaks(d, e.limit(0)).count() == 0
    stored = leakage.positional_index(d, block=100).cache()
    assert {(x.doc_id, x.query_id) for x in leakage.find_leaks(d, e, index=stored).collect()} == expected
    posted = {(x.doc, x.place, x.term) for x in stored.selectExpr("term", "explode(arrays_zip(docs, places)) as o").selectExpr("term", "o.docs as doc", "o.places as place").collect()}
    assert len(posted) == sum(len(WORD.findall((t or "").lower())) for _, t in docs[:-1])


def test_leaks_in_proximity(spark):
    p = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron".split()
    rows = {1: p, 2: [*p[:5], "new", *p[5:]], 3: [*p[:6], "x", *p[7:]], 4: p[:6], 5: list(reversed(p)), 6: ["pad"] * 30 + [*p[:4], "in", "between", *p[4:]]}
    d = spark.createDataFrame([(k, " ".join(v)) for k, v in rows.items()], "doc_id long, text string")
    e = spark.createDataFrame([("q", " ".join(p)), ("none", None)], "query_id string, gold_passage string")
    got = {x.doc_id: (x.run, x.near) for x in leakage.find_leaks(d, e, slack=3).collect()}
    assert got[1] == (15, 12) and got[2][0] == 10 and got[2][1] == 12 and got[3][1] == 11 and got[6] == (11, 12)
    assert 4 not in got and 5 not in got
    assert {x.doc_id for x in leakage.find_leaks(d, e).collect()} == {1}
