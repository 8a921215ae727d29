"""Each corpus operator against brute force, an exact round trip or held-out accuracy, and on hard rows."""

from __future__ import annotations

import random
import re
from itertools import combinations

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from leafmill.llm import bloom, decontaminate, frames, pieces, pii, queries, repetition, secrets, simhash, toxicity, warc
from leafmill.llm.common import Words, suffix_array, utf8

R = random.Random(5)
WORDS = ["".join(R.choice("abcdefghijklmnop") for _ in range(R.randint(2, 9))) for _ in range(3000)]
SCHEMA = "doc_id bigint, text string, fp string, row int, listed boolean, n_entities int, lang string"


def prose(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def hard(spark, extra=()):
    """Nulls in any column, empty and very long texts, repeated rows, ties, and clashing extra columns."""
    rows = [(None, prose(50, 1), None, None, None, None, None), (1, None, "x", 1, True, 1, "en"), (2, "", None, 2, None, None, None), (3, prose(60_000, 2), None, None, None, None, "en"), (4, prose(40, 3), "a", 1, False, 2, None), (4, prose(40, 3), "a", 1, False, 2, None), (5, "... !!! \n", None, None, None, None, None), (None, None, None, None, None, None, None)]
    return spark.createDataFrame([*rows, *[(k, t, "f", 0, True, 0, "en") for k, t in extra]], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# 1 ------------------------------------------------------------------------------------------------


def test_loser_tree_merges_like_sorting(spark):
    r = random.Random(1)
    rows = [(k, r.choice([None, "", "http://www.a.com/x?b=2&a=1", "https://b.org", f"http://h{r.randint(0, 9)}.net/{r.randint(0, 3)}/", "x"]), r.choice([None, *range(5)]), r.choice([None, "b", "c"])) for k in range(600)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, t bigint, html string").withColumn("timestamp", F.timestamp_seconds("t")).repartition(9)
    want = None
    for fan_in, range_rows in ((256, 10**6), (256, 70), (3, 50)):
        got = [tuple(x) for x in warc.capture_index(pages, fan_in=fan_in, range_rows=range_rows).collect()]
        assert [g[0] for g in got] == list(range(600))
        key = lambda g: (g[2], g[3] is not None, g[3] or 0, g[4], g[6] or "")
        assert got == sorted(got, key=lambda g: (g[2].encode(), g[3] is not None, g[3].timestamp() if g[3] else 0, g[4]))
        seen: dict[str, int] = {}
        for g in got:
            seen[g[2]] = seen.get(g[2], 0) + 1
            assert g[1] == seen[g[2]]
        want = want or [key(g) for g in got]
        assert [key(g) for g in got] == want
    assert warc.capture_index(pages.limit(0)).count() == 0


def test_surt(spark):
    urls = ["HTTP://WWW.Example.com:80/a/?z=1&b=2#f", "https://user@x.org", None, "", "a.b.c/d/"]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(warc.surt("u")).collect()]
    assert got == ["com,example)/a?b=2&z=1", "org,x)", "", "", "c,b,a)/d"]


# 2 ------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def field():
    docs = duckdb.sql("select text from '/root/testdata/sf0.01/documents.parquet' where text not like '%token%' order by doc_id limit 250").fetchall()
    return secrets.train([d[0] for d in docs])


def test_secrets_on_held_out_sentences(field):
    docs = [d[0] for d in duckdb.sql("select text from '/root/testdata/sf0.01/documents.parquet' where text not like '%token%' order by doc_id desc limit 250").fetchall()]
    made, spans = secrets.sentences(docs, 600, seed=99)
    data, offsets = utf8(pa.array([m.decode() for m in made]))
    doc, start, end, _, _ = secrets.spans_of(data, offsets, field)
    found = {(d, s - offsets[d], e - offsets[d]) for d, s, e in zip(doc, start, end)}
    want = {(k, a, b) for k, own in enumerate(spans) for a, b in own}
    assert len(found & want) >= 0.93 * len(want)
    assert len(found & want) >= 0.93 * len(found)


def test_viterbi_is_the_best_of_all_labellings():
    r = np.random.default_rng(0)
    for _ in range(30):
        n = int(r.integers(1, 6))
        scores, moves = r.normal(size=(n, 3)), r.normal(size=(3, 3))
        moves[secrets.OUT, secrets.INSIDE] = -np.inf
        best = max(np.ndindex(*[3] * n), key=lambda y: sum(scores[k, y[k]] for k in range(n)) + sum(moves[a, b] for a, b in zip((0, *y), (*y, 0))))
        assert secrets.viterbi(scores[None], moves, np.array([n]))[0].tolist() == list(best)
        assert secrets.decode(scores, moves, np.zeros(n, int)).tolist() == list(best)


def test_secrets_planted_and_hard_rows(spark, field):
    docs = hard(spark, [(9, 'the token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" here'), (10, prose(100, 8))])
    got = {r.doc_id for r in secrets.scan(docs, field).collect()}
    assert got == {9}
    out = secrets.redact(docs, field)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert out.where("doc_id = 9").first().text == 'the token = "[SECRET]" here'
    assert out.where("doc_id <> 9").exceptAll(docs.where("doc_id <> 9")).count() == 0
    assert secrets.scan(empty(spark), field).count() == secrets.redact(empty(spark), field).count() == 0
    assert secrets.scan(empty(spark)).count() == 0


# 3 ------------------------------------------------------------------------------------------------

TEXT = "Dr. Anna Keller (a.Keller-1@Mail.example.com) met Mr. John Smith. Keller called +1 (743) 555-3824 or 743-555-3824, card 4111 1111 1111 1111 from 10.1.2.3 and 8.196.197.208. Госпожа Анна Петрова, 王小芳女士; KELLER"


def test_surrogates_keep_kind_form_gender_and_coreference():
    new, n = pii.replace(TEXT, b"key")
    assert n == 14
    for private in ("Keller", "KELLER", "Anna", "Smith", "555-3824", "4111 1111", "8.196.197.208", "Петрова", "王小芳"):
        assert private not in new
    m = re.fullmatch(r"Dr\. (\w+) (\w+) \((\S+)@(\S+)\) met Mr\. (\w+) (\w+)\. (\w+) called \+1 \((\d{3})\) (\d{3}-\d{4}) or (\d{3})-(\d{3}-\d{4}), card ([\d ]{19}) from (10\.\S+) and (\S+)\. Госпожа (\w+) (\w+), (\w+)女士; (\w+)", new)
    assert m and m[2] == m[7] and m[18] == m[2].upper() and (m[8], m[9]) == (m[10], m[11])
    assert m[1] in pii._GIVEN["latin", "f"] and m[5] in pii._GIVEN["latin", "m"] and m[15] in pii._GIVEN["cyrillic", "f"] and m[16].endswith("а")
    assert pii._luhn(m[12].replace(" ", "")) == 0 and pii.script_of(m[17]) == "han" and len(m[17]) == 3
    assert new == pii.replace(TEXT, b"key")[0] != pii.replace(TEXT, b"other")[0]


def test_surrogates_stay_distinct_when_they_collide(spark):
    names = [f"Mr. {w.title()}" for w in WORDS[:40]]
    docs = spark.createDataFrame(list(enumerate(names)), "doc_id int, text string")

    def few(kind, canonical, attempt, key):
        return "name" + "abcdefgh"[hash_of(canonical, attempt) % 8] + "xyzuvw"[attempt % 6] * attempt

    def hash_of(a, b):
        import hashlib

        return int(hashlib.sha1(f"{a}{b}".encode()).hexdigest(), 16)

    got = {r.doc_id: r.text for r in pii.pseudonymize(docs, make=few).collect()}
    assert len(set(got.values())) == len({n.lower() for n in names})


def test_surrogates_on_hard_rows(spark):
    docs = hard(spark, [(9, TEXT), (10, TEXT)])
    out = pii.pseudonymize(docs, key=b"key")
    assert out.columns == [*docs.columns, "n_entities_"]
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[9].text == rows[10].text == pii.replace(TEXT, b"key")[0] and rows[1].n_entities_ is None and rows[2].text == ""
    assert out.drop("n_entities_").where("doc_id < 9").exceptAll(docs).count() == 0 and out.count() == docs.count()
    assert pii.pseudonymize(empty(spark)).count() == 0


# 4 ------------------------------------------------------------------------------------------------


def words(text):
    return [w.lower() for w in re.findall(r"[A-Za-z0-9]+", text or "")]


def brute_matches(docs, items, least):
    found = set()
    for d, text in docs:
        a = words(text)
        for i, item in items:
            b = words(item)
            need = min(least, len(b))
            if len(b) < decontaminate.LEAST_ITEM_WORDS:
                continue
            for x in range(len(a)):
                for y in range(len(b)):
                    if a[x] != b[y] or x and y and a[x - 1] == b[y - 1]:
                        continue
                    n = 0
                    while x + n < len(a) and y + n < len(b) and a[x + n] == b[y + n]:
                        n += 1
                    if n >= need:
                        found.add((d, i, y, x, n))
    return found


def test_matches_are_those_of_brute_force(spark):
    items = [(k, prose(30, 100 + k)) for k in range(6)] + [(50, None), (51, "a b"), (52, prose(8, 150))]
    docs = [(k, prose(30, k)) for k in range(8)]
    docs += [(20, prose(5, 60) + " " + items[0][1].upper() + ", " + prose(5, 61)), (21, " ".join(items[1][1].split()[3:18])), (22, " ".join(items[1][1].split()[3:15])), (23, items[52 - 44][1] if len(items) > 52 else items[8][1]), (24, (items[2][1] + " ") * 3), (25, None), (26, "")]
    d, b = spark.createDataFrame(docs, "doc_id int, text string").repartition(3), spark.createDataFrame(items, "item_id int, text string")
    got = {(r.doc_id, r.item_id, r.item_word, r.doc_word, r.n_words) for r in decontaminate.matches(d, b).collect()}
    want = brute_matches(docs, items, decontaminate.MIN_WORDS)
    assert got == want and {20, 21, 23, 24} <= {g[0] for g in got} and 22 not in {g[0] for g in got}
    kept = {r.doc_id for r in decontaminate.decontaminate(d, b).collect()}
    assert kept == {k for k, _ in docs} - {g[0] for g in want}


def test_decontamination_of_hard_rows(spark):
    b = spark.createDataFrame([(1, prose(60_000, 2)[1000:1400])], "item_id int, text string")
    docs = hard(spark)
    out = decontaminate.decontaminate(docs, b)
    assert out.columns == docs.columns and docs.exceptAll(out).count() == 1 == docs.where("doc_id = 3").count()
    assert decontaminate.decontaminate(empty(spark), b).count() == 0 == decontaminate.matches(docs, b.limit(0)).count()


def test_suffix_array():
    r = np.random.default_rng(3)
    for n in (1, 2, 50, 300):
        x = r.integers(0, 3, n)
        order, _ = suffix_array(x)
        assert order.tolist() == sorted(range(n), key=lambda k: x[k:].tolist())


# 5 ------------------------------------------------------------------------------------------------


def brute_repetition(text, least):
    w = words(text)
    covered, longest, n = [False] * len(w), 0, len(w)
    for a in range(n):
        for b in range(a + 1, n):
            k = 0
            while b + k < n and w[a + k] == w[b + k]:
                k += 1
            if k >= least:
                longest = max(longest, k)
                for x in (*range(a, a + k), *range(b, b + k)):
                    covered[x] = True
    return longest, covered


def test_repetition_is_that_of_brute_force(spark):
    r = random.Random(4)
    texts = []
    for k in range(25):
        parts = [prose(r.randint(5, 15), r.randint(0, 6)) for _ in range(r.randint(1, 8))]
        texts.append(" ".join(parts))
    got = {x.doc_id: x for x in repetition.repetition(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3)).collect()}
    for k, t in enumerate(texts):
        longest, covered = brute_repetition(t, repetition.MIN_WORDS)
        assert got[k].longest_words == longest and (got[k].covered_fraction > 0) == any(covered)
        w = words(t)
        size = [len(x) + 1 for x in w]
        size[-1] -= 1
        assert got[k].covered_fraction == pytest.approx(sum(s for s, c in zip(size, covered) if c) / sum(size))


def test_repetition_keeps_clean_and_hard_rows(spark):
    line = prose(12, 77)
    docs = hard(spark, [(9, " ".join([line] * 30)), (10, prose(500, 78) + " " + line + " " + prose(300, 79) + " " + line), (11, "ab" * 3000)])
    out = repetition.keep_unrepetitive(docs)
    assert out.columns == docs.columns
    assert docs.exceptAll(out).select("doc_id").distinct().collect()[0][0] in (9, 11) and {r.doc_id for r in docs.exceptAll(out).collect()} == {9, 11}
    assert repetition.repetition(empty(spark)).count() == 0


# 6 ------------------------------------------------------------------------------------------------


def test_trie_join_finds_all_pairs():
    r = np.random.default_rng(2)
    x = np.unique(r.integers(0, 2**32, 400, dtype=np.uint32))
    x = np.unique(np.concatenate([x, x[:100] ^ (np.uint32(1) << r.integers(0, 32, 100).astype(np.uint32)), x[:50] ^ np.uint32(7)]))
    got = {(min(a, b), max(a, b)) for i, j in simhash.trie_join(x, None, 4) for a, b in zip(i.tolist(), j.tolist())}
    want = {(a, b) for a in range(len(x)) for b in range(a, len(x)) if int(x[a] ^ x[b]).bit_count() <= 4}
    assert got == want
    y = x[::3] ^ np.uint32(5)
    y.sort()
    got = {(a, b) for i, j in simhash.trie_join(x, y, 3) for a, b in zip(i.tolist(), j.tolist())}
    assert got == {(a, b) for a in range(len(x)) for b in range(len(y)) if int(x[a] ^ y[b]).bit_count() <= 3}


def test_near_fingerprints_are_those_of_brute_force(spark):
    r = random.Random(6)
    prints = {r.getrandbits(128) for _ in range(60)}
    for p in list(prints)[:30]:
        q = p
        for _ in range(r.randint(1, 22)):
            q ^= 1 << r.randint(0, 127)
        prints.add(q)
    rows = [(p.to_bytes(16, "big"),) for p in prints]
    got = {(bytes(a), bytes(b)) for a, b in simhash.near_fingerprints(spark.createDataFrame(rows, "fp binary"), len(rows), all_pairs=True).collect()}
    want = {(min(a, b).to_bytes(16, "big"), max(a, b).to_bytes(16, "big")) for a, b in combinations(prints, 2) if (a ^ b).bit_count() <= simhash.MAX_BITS}
    assert {(a, b) for a, b in got if a != b} == want


def test_near_duplicates_and_hard_rows(spark):
    base = prose(400, 30).split()
    near = base.copy()
    near[200] = "changed"
    docs = hard(spark, [(20, " ".join(base)), (21, " ".join(near)), (22, " ".join(base)), (23, prose(400, 31))])
    got = {r.doc_id: (r.kept_id, r.group_size) for r in simhash.near_duplicates(docs).collect()}
    assert got == {20: (20, 3), 21: (20, 3), 22: (20, 3), 4: (4, 2)}
    out = simhash.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in out.collect()) == [-1, -1, 1, 2, 3, 4, 5, 20, 23]
    assert simhash.near_duplicates(empty(spark)).count() == simhash.drop_near_duplicates(empty(spark)).count() == 0


# 7 ------------------------------------------------------------------------------------------------


def test_frames_round_trip(spark, tmp_path):
    docs = hard(spark, [(9, "日本語 é 😀\n\n  x\ty  "), (10, "<|endoftext|>")])
    folder, index = frames.write(docs, str(tmp_path / "a"), frame_bytes=256)
    rows = index.collect()
    assert len(rows) == docs.count() and {r.n_tokens for r in rows if r.doc_id == 1} == {None} and {r.n_tokens for r in rows if r.doc_id == 2} == {0}
    want = sorted((r.doc_id or -1, r.text or "") for r in docs.collect())
    got = sorted((r.doc_id or -1, r.text or "") for r in frames.read_back(folder, index).collect())
    assert got == want
    one = frames.read_back(folder, index.where("doc_id = 9")).collect()
    assert one[0].text == "日本語 é 😀\n\n  x\ty  " and list(one[0].ids) == frames.encoding().encode_ordinary(one[0].text)
    assert frames.write(empty(spark), str(tmp_path / "b"))[1].count() == 0


def test_frames_are_plain_zstandard_and_checked(tmp_path):
    import io

    import zstandard

    out = io.BytesIO()
    writer = frames.FrameWriter(out)
    parts = [bytes([k]) * (100 + k) for k in range(5)]
    for p in parts:
        writer.frame(p)
    writer.close()
    raw = out.getvalue()
    assert zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read() == b"".join(parts)
    reader = frames.FrameReader(pa.BufferReader(raw))
    assert [reader.frame(k) for k in (3, 0, 4)] == [parts[3], parts[0], parts[4]]
    at = raw.rindex(b"\x5e\x2a\x4d\x18") + 8 + 8  # the first checksum
    with pytest.raises(ValueError, match="checksum"):
        frames.FrameReader(pa.BufferReader(raw[:at] + bytes([raw[at] ^ 1]) + raw[at + 1 :])).frame(0)


# 8 ------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_PATH)


@pytest.fixture(scope="module")
def table():
    return pieces.Pieces()


ODD = ["  a  b", " " * 47, " " * 31 + "x", "日本語テキスト\n\n\tfoo▁bar 😀", "a" * 300, "aaa bbb" + " " * 20 + "\n x", "́́", "\x00\x01"]


def test_pieces_are_the_librarys(library, table):
    texts = [r[0] for r in duckdb.sql("select text from '/root/testdata/sf0.001/documents.parquet'").fetchall()] + ODD
    ids, at = pieces.encode_texts(table, *utf8(pa.array(texts)))
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == library.encode(t)


def test_chunks_give_the_librarys_pieces(library, table):
    r = random.Random(7)
    texts = [*ODD, *["".join(r.choice("abcdeの日é́theing ") for _ in range(500)) for _ in range(25)], *["".join(r.choice("theingaor") for _ in range(500)) for _ in range(15)]]
    for t in texts:
        own = " " + t.replace("▁", " ")
        for size in (33, 50):
            parts = list(pieces.chunks(own, size, table.longest))
            matrices = [pieces.matrix(table, x, lead, size) for _, lead, x in parts]
            marks = pieces.down(matrices, (0, pieces.START), (0, pieces.START))
            ids = [i for (_, lead, x), a, b in zip(parts, marks, marks[1:]) for i in pieces.trace(table, x, lead, size, a, b)]
            assert pieces._joined_spaces(table, np.array(ids, np.int32), np.array([0, len(ids)]))[0].tolist() == library.encode(t)
            left = matrices[0]
            for m in matrices[1:]:
                left = pieces.combine(left, m)
            right = matrices[-1]
            for m in reversed(matrices[:-1]):
                right = pieces.combine(m, right)
            assert set(left) == set(right) == {(0, pieces.START, 0, pieces.START)}


def test_encoding_of_hard_rows(spark, library):
    docs = hard(spark, [(9, "a▁b"), (10, "the" * 30_000)])
    rows = pieces.encode(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == docs.count()
    for r in rows:
        if r.doc_id is not None:
            assert (r.ids is None) == (texts[r.doc_id] is None) == (r.n_tokens is None)
            assert r.ids is None or (r.ids == library.encode(texts[r.doc_id]) and r.n_tokens == len(r.ids) and r.round_trip == (r.doc_id != 9))
    back = pieces.decode(pieces.encode(docs).withColumn("text", F.lit(1)).where("doc_id in (1, 2, 3, 10)")).collect()
    assert {r.doc_id: r.text_ for r in back} == {k: texts[k] for k in (1, 2, 3, 10)}
    assert pieces.encode(empty(spark)).count() == 0


# 9 ------------------------------------------------------------------------------------------------


def test_cascade_is_exact():
    r = np.random.default_rng(1)
    keys = np.unique(r.integers(0, 2**63, (5000, 2), dtype=np.uint64), axis=0)
    for share in (0, 0.001, 0.3, 1):
        listed = r.random(len(keys)) < share
        made = bloom.Cascade.of(keys, listed)
        assert (made.has(keys) == listed).all()
    twins = np.repeat(keys[:1], 2, axis=0)
    assert bloom.Cascade.of(twins, np.array([True, False])).has(twins).tolist() == [True, True]


def test_url_filter_of_hard_rows(spark):
    urls = [None, "", "http://www.bad.com/x?y", "https://m.BAD.com:8080/x/", "http://sub.bad.com", "http://notbad.com/x", "good.org", "good.org", *[f"http://h{k}.net/{k}" for k in range(300)]]
    pages = spark.createDataFrame([(k, u, k % 2 == 0) for k, u in enumerate(urls)], "page_id int, url string, listed boolean")
    keys = spark.createDataFrame([("h7.net/7",), ("h8.net/9",), (None,)], "url_key string")
    for kwargs in ({}, {"shard_keys": 40}, {"shard_keys": 40, "worker_bytes": 0}):
        out = bloom.filter_urls(pages, keys, ["bad.com"], **kwargs)
        assert out.columns == ["page_id", "url", "listed", "url_key", "listed_"] and out.count() == len(urls)
        assert {r.url for r in out.where("listed_").collect()} == {"http://www.bad.com/x?y", "https://m.BAD.com:8080/x/", "http://sub.bad.com", "http://h7.net/7"}
    assert bloom.filter_urls(pages.limit(0), keys, ["bad.com"]).count() == 0


# 10 -----------------------------------------------------------------------------------------------


def test_toxicity_on_held_out_documents():
    rows = duckdb.sql("select d.text, toxic from '/root/testdata/sf0.1/documents.parquet' d join '/root/testdata/sf0.1/labels.parquet' using (doc_id) order by hash(doc_id)").fetchall()

    def prepared(some):
        text, found = toxicity.features(*utf8(pa.array([t for t, _ in some])))
        y = np.array([[False, t > 0] for _, t in some])
        y[np.unique(text[np.isin(found, np.array([toxicity.word_hash(w) for w in toxicity.LEXICON["insult"]], np.uint64))]), 0] = True
        y[:, 0] &= y[:, 1]
        return text, found, y

    half = len(rows) * 2 // 3
    chain = toxicity.fit(*prepared(rows[:half]), ["insult", "toxic"])
    text, found, y = prepared(rows[half:])
    p = chain.score(text, found, len(y))[:, 1] >= toxicity.THRESHOLD
    assert chain.links[0, 1] > 0  # the first category's probability counts for the second
    assert p[y[:, 1]].mean() > 0.83 and p[~y[:, 1]].mean() < 0.01  # about 8 % of the toxic ones hold no toxic word at all


def test_toxicity_of_hard_rows(spark):
    r = random.Random(3)
    extra = [(100 + k, prose(60, k) + (" " + r.choice(["idiot", "worthless scum", "pathetic moron"]) if k % 3 == 0 else "")) for k in range(300)]
    docs = hard(spark, extra)
    labels = spark.createDataFrame([(100 + k, int(k % 3 == 0)) for k in range(300)] + [(None, 1), (7, None)], "doc_id bigint, toxic int")
    chain = toxicity.train(docs, labels)
    out = toxicity.score(docs, chain)
    assert out.columns == ["doc_id", "p_insult", "p_contempt", "p_toxic"] and out.count() == docs.count()
    assert {r.doc_id for r in toxicity.toxic(docs, labels).collect()} == {100 + k for k in range(0, 300, 3)}
    assert toxicity.toxic(docs, labels.limit(0)).count() == 0 and toxicity.toxic(empty(spark), labels).count() == 0


# queries ------------------------------------------------------------------------------------------


def test_queries_agree_with_sql(spark, sf):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    con.execute(f"create view pages as select * from '{sf}/pages.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        got = queries.QUERIES[name](spark, sf).toPandas()
        want = con.execute(sql).df()[list(got.columns)]
        show = lambda df: sorted(tuple(str(v).replace("+00:00", "") for v in row) for row in df.itertuples(index=False))
        assert show(got) == show(want)


def test_pipeline(spark, sf):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, sf).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontamination", "secret_scan", "piece_ids"]
    assert 0 < len(rows) < len(docs) and len({r.doc_id for r in rows}) == len(rows) and all(r.round_trip for r in rows)


def test_words():
    w = Words(*utf8(pa.array(["Ab, c!", "", None, "日本 é"])))
    assert w.count.tolist() == [2, 0, 0, 3]
