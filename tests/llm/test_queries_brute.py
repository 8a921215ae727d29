"""The registered queries over whole tables against brute force, the public libraries, or an exact round trip."""

from __future__ import annotations

import re
import warnings
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import sentencepiece
from test_operators import brute_repetition, words

import corpus_pipeline
from leafmill.llm import decontaminate, frames, pieces, pii, queries, repetition, secrets, simhash, toxicity, warc
from leafmill.llm.common import Words, utf8


@pytest.fixture(scope="module")
def docs(sf):
    return pq.read_table(f"{sf}/documents.parquet").to_pylist()


def test_op2_is_plain_viterbi_and_finds_planted_secrets(spark, sf, docs):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    field = secrets.train(secrets.sample(table, "text", secrets.TRAIN_DOCS))
    got = {(r.doc_id, r.start_byte, r.end_byte) for r in queries.op2_secrets(spark, sf).collect()}
    want = set()
    for d in docs:
        data, offsets = utf8(pa.array([d["text"]]))
        t = secrets.Tokens(data, offsets)
        if len(t):
            labels = secrets.viterbi(field.scores(t)[None].astype(float), field.moves, np.array([len(t)]))[0]
            for k in np.flatnonzero(labels == secrets.BEGIN):
                end = k + 1
                while end < len(t) and labels[end] == secrets.INSIDE:
                    end += 1
                want.add((d["doc_id"], int(t.start[k]), int(t.end[end - 1])))
    assert got == want


def test_op2_finds_the_secrets_of_the_documents(spark):
    """The documents at this scale hold tokens of 40 digits; SQL knows where."""
    sf = "/root/testdata/sf0.01"
    planted = duckdb.sql(f"SELECT doc_id, strlen(split_part(text, secret, 1)), strlen(split_part(text, secret, 1)) + 40 FROM (SELECT doc_id, text, regexp_extract(text, 'token = \"([0-9a-f]{{40}})\"', 1) AS secret FROM '{sf}/documents.parquet') WHERE secret <> ''").fetchall()
    got = {(r.doc_id, r.start_byte, r.end_byte) for r in queries.op2_secrets(spark, sf).collect()}
    assert planted and len(got & set(planted)) >= 0.9 * len(planted) and len(got & set(planted)) >= 0.9 * len(got)


def test_op3_is_brute_force(spark, sf, docs):
    key = b"demonstration"
    found = {d["doc_id"]: pii.entities(d["text"]) if d["text"] else [] for d in docs}
    real = {(e.kind, e.canonical) for some in found.values() for e in some}
    attempts = dict.fromkeys(real, 0)
    while True:
        by = defaultdict(list)
        for (kind, canonical), n in attempts.items():
            by[kind, pii.surrogate(kind, canonical, n, key)].append((n, canonical))
        clash = {(kind, c) for (kind, s), own in by.items() for c in [x[1] for x in sorted(own)[1:]] + [x[1] for x in own if (kind, s) in real]}
        if not clash:
            break
        for x in clash:
            attempts[x] += 1
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        got = {r.doc_id: r.text for r in queries.op3_pii_surrogates(spark, sf).collect()}
    assert got == {d["doc_id"]: None if d["text"] is None else pii.replace(d["text"], key, attempts, found=found[d["doc_id"]])[0] for d in docs}


def test_op4_is_brute_force(spark, sf, docs):
    def folded(text):
        data, offsets = utf8(pa.array([text]))
        w = Words(data, offsets)
        return [re.sub(r"[A-Z]", lambda m: m[0].lower(), data[s:e].tobytes().decode()) for s, e in zip(w.start.tolist(), w.end.tolist())]

    items = [(r["item_id"], folded(r["text"])) for r in pq.read_table(f"{sf}/benchmark.parquet").to_pylist()]
    got = {(r.doc_id, r.item_id, r.item_word, r.doc_word, r.n_words) for r in queries.op4_decontaminate(spark, sf).collect()}
    places = defaultdict(list)
    for i, b in items:
        for y in range(len(b)):
            places[b[y]].append((i, b, y))
    want = set()
    for d in docs:
        a = folded(d["text"])
        for x, word in enumerate(a):
            for i, b, y in places.get(word, ()):
                if x and y and a[x - 1] == b[y - 1]:
                    continue
                n = 0
                while x + n < len(a) and y + n < len(b) and a[x + n] == b[y + n]:
                    n += 1
                if n >= min(decontaminate.MIN_WORDS, len(b)):
                    want.add((d["doc_id"], i, y, x, n))
    assert got == want and want


def test_op5_is_brute_force(spark, sf, docs):
    got = {r.doc_id: r for r in queries.op5_repetition(spark, sf).collect()}
    assert set(got) == {d["doc_id"] for d in docs}
    for d in docs:
        if d["text"] and d["text"].isascii() and len(words(d["text"])) < 400 and max(map(len, words(d["text"])), default=0) <= repetition.PIECE_BYTES:
            assert got[d["doc_id"]].longest_words == brute_repetition(d["text"], repetition.MIN_WORDS)[0]


def test_op6_is_brute_force(spark, sf, docs):
    prints, there = simhash.fingerprints(*utf8(pa.array([d["text"] for d in docs])))
    value = [int.from_bytes(p.tobytes(), "big") if t else None for p, t in zip(prints, there)]
    group = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if value[i] is not None and value[j] is not None and group[i] != group[j] and (value[i] ^ value[j]).bit_count() <= simhash.MAX_BITS:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    members = defaultdict(list)
    for k, g in enumerate(group):
        members[g].append(docs[k]["doc_id"])
    want = {x: (min(own), len(own)) for own in members.values() if len(own) > 1 for x in own}
    assert {r.doc_id: (r.kept_id, r.group_size) for r in queries.op6_simhash(spark, sf).collect()} == want and want


def test_op7_reads_back_what_the_library_gives(spark, sf, docs):
    folder, index = frames.write(spark.read.parquet(f"{sf}/documents.parquet"))
    coder = frames.encoding()
    got = {r.doc_id: (r.ids, r.text) for r in frames.read_back(folder, index).collect()}
    assert got == {d["doc_id"]: (coder.encode(d["text"], disallowed_special=()), d["text"]) for d in docs}
    rows = queries.op7_token_frames(spark, sf).collect()
    assert {r.doc_id: r.n_tokens for r in rows} == {k: len(ids) for k, (ids, _) in got.items()}


def test_op8_is_the_librarys_encoding(spark, sf, docs):
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_PATH)
    got = {r.doc_id: (r.ids, r.round_trip) for r in queries.op8_sentencepiece(spark, sf).collect()}
    assert got == {d["doc_id"]: (library.encode(d["text"]), True) for d in docs}


def test_op10_is_brute_force(spark, sf, docs):
    table, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    chain = toxicity.train(table, labels)
    assert chain.names == ["quality", "insult", "contempt", "toxic"]
    weight = dict(zip(chain.hashes.tolist(), chain.weights.tolist()))
    want = {}
    for d in docs:
        w = Words(*utf8(pa.array([d["text"]])))
        long = w.end - w.start >= toxicity.PREFIX_BYTES + 2
        own = {h for h in [*w.hash.tolist(), *w.prefix(toxicity.PREFIX_BYTES)[long].tolist()] if h in weight}
        p = []
        for k in range(len(chain.names)):
            x = sum(weight[h][k] for h in own) + sum(p[j] * chain.links[j, k] for j in range(k)) + chain.bias[k]
            p.append(1 / (1 + np.exp(-np.clip(x, -40, 40))))
        if p[-1] >= toxicity.THRESHOLD:
            want[d["doc_id"]] = p
    got = {r.doc_id: [r[f"p_{n}"] for n in chain.names] for r in queries.op10_toxicity(spark, sf).collect()}
    assert set(got) == set(want) and all(np.allclose(got[k], want[k]) for k in got)


# defined cases ------------------------------------------------------------------------------------


def test_rows_that_differ_in_where_the_null_is(spark):
    rows = [(1, "a b c d", None), (2, "a b c d", None), (2, None, "a b c d"), (None, "", None), (2, "a b c d", None)]
    out = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id int, text string, row string"))
    assert sorted(map(str, out.collect())) == sorted(map(str, spark.createDataFrame([rows[0], rows[2], rows[3]], "doc_id int, text string, row string").collect()))
    nested = spark.createDataFrame([(1, "x y z", [None, "a"]), (1, "x y z", ["a", None])], "doc_id int, text string, tags array<string>")
    assert simhash.drop_near_duplicates(nested).count() == 1


@pytest.mark.parametrize("blocks", simhash.BLOCKS)
def test_any_blocks_and_parts_find_the_same_pairs(spark, blocks):
    r = np.random.default_rng(3)
    base = [int.from_bytes(r.bytes(16), "big") for _ in range(12)]
    values = {b ^ sum(1 << int(x) for x in r.choice(128, int(r.integers(0, 22)), replace=False)) for b in base for _ in range(12)}
    raw = [v.to_bytes(16, "big") for v in values]
    leaves = spark.createDataFrame([(x,) for x in raw], "fp binary")
    got = {(bytes(a), bytes(b)) for a, b in simhash.near_fingerprints(leaves, len(raw), True, task_leaves=20, blocks=blocks).collect()}
    assert got == {(a, b) for a in raw for b in raw if a < b and (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_count() <= simhash.MAX_BITS}


def test_surrogates_where_a_form_has_no_place_left(spark):
    docs = spark.createDataFrame([(k, " ".join(f"192.168.{k}.{j}" for j in range(256))) for k in range(256)], "doc_id int, text string").repartition(4)
    out = pii.pseudonymize(docs, key=b"k" * 100).collect()
    new = {x for r in out for x in r.text.split(" ")}
    assert len(new) == 65_536 and not any(re.fullmatch(r"192\.168\.\d+\.\d+", x) for x in new)
    assert pii.surrogate("surname", "weber", 0, b"k" * 64 + b"a") != pii.surrogate("surname", "weber", 0, b"k" * 64 + b"b")
    assert pii.surrogate("phone", "5551234", 9, b"k") != "5551234" and len(pii.surrogate("phone", "5551234", 9, b"k")) == 8


def test_capture_keys_of_any_type(spark):
    pages = spark.createDataFrame([("a1", "http://x.org", "b"), (None, "http://x.org", None), ("a", "http://x.org", "c"), ("a1", "http://x.org", "b")], "page_id string, url string, html string").selectExpr("*", "timestamp_seconds(5) AS timestamp")
    got = warc.capture_index(pages).collect()
    assert [(r.position, r.capture, r.page_id) for r in got] == [(0, 1, None), (1, 2, "a"), (2, 3, "a1"), (3, 4, "a1")]


def test_histories_over_many_runs_and_ranges(spark):
    pages = spark.range(3000).selectExpr("id AS page_id", "concat('http://h', CASE WHEN id % 3 = 0 THEN 0 ELSE id % 50 END, '.org') AS url", "'x' AS html", "timestamp_seconds(id * 7919 % 3000) AS timestamp").repartition(40)
    one = [tuple(r) for r in warc.capture_index(pages).collect()]
    assert [tuple(r) for r in warc.capture_index(pages, fan_in=3, range_rows=100).collect()] == one
    assert max(r[1] for r in one) >= 1000


def test_ids_that_the_model_has_not(spark):
    ids = spark.createDataFrame([([5, -1, 10**6, None],), (None,), ([],), ([0, 1, 2],)], "ids array<int>")
    texts = [r.text for r in pieces.decode(ids).collect()]
    assert texts[1] is None and texts[2] == "" and len(texts) == 4


def test_giants_of_many_chunks(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_PATH)
    text = " ".join(["the quick brown", "日本語 é", "   ", "abcabcabc"] * 800)
    docs = spark.createDataFrame([(1, text, "x"), (None, text[7:], None), (3, "short", None)], "doc_id int, text string, ids string")
    got = pieces.encode(docs, chunk_chars=64)
    assert {r.doc_id: (r.ids, r.round_trip, r.n_tokens) for r in got.collect()} == {k: (i, True, len(i)) for k, i in ((1, library.encode(text)), (None, library.encode(text[7:])), (3, library.encode("short")))}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan


def test_boilerplate_of_many_items_in_many_places(spark):
    same = " ".join(f"w{k}" for k in range(13))
    items = spark.createDataFrame([(k, f"{same} i{k}") for k in range(60)], "item_id int, text string")
    docs = spark.createDataFrame([(k, f"d{k} {same} e{k}") for k in range(200)] + [(999, "clean " * 20)], "doc_id int, text string")
    assert decontaminate.matches(docs, items).count() == 60 * 200
    assert [r.doc_id for r in decontaminate.decontaminate(docs, items).collect()] == [999]


@pytest.mark.parametrize("benchmark", [[], [(1, None)], [(None, "a b")]])
def test_pipeline_on_empty_tables_and_clashing_names(spark, tmp_path, benchmark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, ids string, matrix int"
    spark.createDataFrame(benchmark, "item_id bigint, text string").write.parquet(str(tmp_path / "some/benchmark.parquet"))
    rows = [(1, "one two three", None, None, None, "r", "i", 1), (None, None, None, None, None, None, None, None), (2, "", "en", "s", 0, "r", "i", 1), (2, "", "en", "s", 0, "r", "i", 1)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "some/documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path / "some"))
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got.where("ids is not null").collect()) == [(1, 3), (2, 0), (2, 0)] and got.count() == 4
    if not benchmark:
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / "none/documents.parquet"))
        spark.createDataFrame([], "item_id bigint, text string").write.parquet(str(tmp_path / "none/benchmark.parquet"))
        assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
