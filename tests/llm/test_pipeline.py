"""The pipeline against one that compares everything with everything."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import sentencepiece
from test_operators import brute_matches, brute_repetition, prose, words

import corpus_pipeline
from leafmill.llm import decontaminate, pieces, repetition, secrets, simhash
from leafmill.llm.common import utf8


def repetitive(text):
    w = words(text)
    longest, covered = brute_repetition(text, repetition.MIN_WORDS)
    size = [len(x) + 1 for x in w]
    share = sum(s for s, c in zip(size, covered) if c) / max(sum(size), 1)
    return longest > repetition.MAX_LONGEST or share > repetition.MAX_COVERED + 0.01  # the fixture is far from the limit


def first_of_groups(rows):
    prints = [int.from_bytes(p.tobytes(), "big") if t else None for p, t in (lambda f: zip(*f))(simhash.fingerprints(*utf8(pa.array([t or "" for _, t in rows]))))]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if prints[i] is not None and prints[j] is not None and (prints[i] ^ prints[j]).bit_count() <= simhash.MAX_BITS:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    return [r for k, r in enumerate(rows) if r[0] == min(rows[m][0] for m in range(len(rows)) if group[m] == group[k])]


def redacted(text, field):
    data, offsets = utf8(pa.array([text]))
    t = secrets.Tokens(data, offsets)
    if not len(t):
        return text
    labels = secrets.viterbi(field.scores(t)[None].astype(float), field.moves, np.array([len(t)]))[0]
    out, at, raw = b"", 0, data.tobytes()
    for k in np.flatnonzero(labels == secrets.BEGIN):
        end = k + 1
        while end < len(t) and labels[end] == secrets.INSIDE:
            end += 1
        out += raw[at : t.start[k]] + secrets.REDACTED
        at = t.end[end - 1]
    return (out + raw[at:]).decode()


def test_run_is_that_of_brute_force(spark, tmp_path):
    item = prose(40, 900)
    long = prose(300, 901).split()
    near = [*long[:150], "other", *long[151:]]
    rows = [(k, prose(60 + 7 * k, 500 + k)) for k in range(25)]
    rows += [(30, " ".join(long)), (31, " ".join(near)), (32, " ".join(long)), (33, " ".join([prose(12, 7)] * 20)), (34, prose(20, 8) + " " + item + " " + prose(20, 9)), (35, 'the token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" ' + prose(30, 10)), (36, None), (37, ""), (38, "日本 é\n\n" + prose(30, 11))]
    docs = spark.createDataFrame([(k, t, "en", "src", len(t or "")) for k, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item), (2, None)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    left = [r for r in rows if not repetitive(r[1])]
    left = first_of_groups(left)
    hit = {m[0] for m in brute_matches(left, [(1, item)], decontaminate.MIN_WORDS)}
    left = [r for r in left if r[0] not in hit]
    assert {r[0] for r in rows} - {r[0] for r in left} == {31, 32, 33, 34}
    field = secrets.train(secrets.sample(spark.createDataFrame(left, "doc_id int, text string"), "text", secrets.TRAIN_DOCS))
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_PATH)
    want = {k: None if t is None else library.encode(redacted(t, field)) for k, t in left}
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == want
    assert "24be6443" not in library.decode(got[35]) and "[SECRET]" in library.decode(got[35])
