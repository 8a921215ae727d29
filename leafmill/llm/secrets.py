"""Secret scans by a linear-chain conditional random field.

Tokens (runs of letters and digits, or single signs) get the labels begin,
inside or outside. Scores are linear in a token's shape, the shapes and words
around it, whether it touches the token before, and features of the whole text;
the best labelling is found by Viterbi decoding. The field is trained here, by
maximum likelihood, on a bounded sample of the documents into which generated
secrets and look-alikes (commit ids, card numbers, addresses ...) are set.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import mix, run_hashes, slices, tidy, trim, utf8

#: Documents of the sample, and sentences made from it, that the field is trained on; passes over them.
TRAIN_DOCS = 256
TRAIN_SENTENCES = 1800
EPOCHS = 40
#: Characters of a document from which sentences are made at most.
TRAIN_CHARS = 65_536
REDACTED = b"[SECRET]"

OUT, BEGIN, INSIDE = 0, 1, 2
NEVER = -1e4
_SHAPES, _BUCKETS, _FILES = 512, 1 << 14, 64
#: Feature tables by name: offset of the token that is looked at, rows.
_TABLES = {"shape0": (0, _SHAPES), "shape-1": (-1, _SHAPES), "shape-2": (-2, _SHAPES), "shape+1": (1, _SHAPES), "word0": (0, _BUCKETS), "word-1": (-1, _BUCKETS), "word-2": (-2, _BUCKETS), "word-3": (-3, _BUCKETS), "word+1": (1, _BUCKETS), "head0": (0, _BUCKETS), "glued": (0, 4), "file": (0, _FILES)}

_KIND = np.zeros(256, np.uint8)  # 1 letter, digit, underscore or non-ASCII; 2 sign
_KIND[33:127] = 2
_KIND[np.r_[48:58, 65:91, 95, 97:123, 128:256]] = 1


def _flag(*ranges: slice) -> np.ndarray:
    x = np.zeros(256, bool)
    for r in ranges:
        x[r] = True
    return x


_DIGIT, _UPPER, _LOWER = _flag(slice(48, 58)), _flag(slice(65, 91)), _flag(slice(97, 123), slice(128, 256))
_HEX = _flag(slice(48, 58), slice(65, 71), slice(97, 103))


class Tokens:
    """Tokens of several texts: start, end (bytes), text; shape, hashes of the word and of its
    first four bytes, glued (no white space before it), file features."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        kind = _KIND[data]
        word, sign = kind == 1, kind == 2
        first = word.copy()
        first[1:] &= ~word[:-1]
        edges = offsets[:-1][offsets[:-1] < len(data)]
        first[edges] |= word[edges]
        first |= sign
        last = word.copy()
        last[:-1] &= ~word[1:] | first[1:]
        last |= sign
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        s, e, n = self.start, self.end, len(data)
        self.first = np.searchsorted(s, offsets)
        self.count = np.diff(self.first)
        self.text = np.repeat(np.arange(len(offsets) - 1), self.count)

        def per_token(x: np.ndarray) -> np.ndarray:
            total = np.zeros(n + 1, np.int32)
            np.cumsum(x, out=total[1:])
            return total[e] - total[s]

        length, is_digit = e - s, _DIGIT[data]
        digits, upper, lower, hexes = per_token(is_digit), per_token(_UPPER[data]), per_token(_LOWER[data]), per_token(_HEX[data])
        flip = np.zeros(n, bool)
        flip[1:] = is_digit[1:] != is_digit[:-1]
        flips = np.maximum(per_token(flip) - (flip[s] if len(s) else 0), 0)
        size = np.searchsorted([3, 6, 10, 16, 24, 40], length, "right")
        mixed = (lower > 0) * 1 + (upper > 0) * 2 + (digits > 0) * 4
        shape = 40 + ((size * 8 + mixed) * 4 + np.searchsorted([1, 3, 6], flips, "right")) * 2 + (hexes == length)
        self.shape = np.where(sign[s], np.searchsorted(np.flatnonzero(_KIND == 2), data[s]), shape).astype(np.int32)
        self.hash = mix(run_hashes(data, s, e))
        self.head = mix(run_hashes(data, s, np.minimum(e, s + 4), False) + np.uint64(1))
        self.glued = np.zeros(len(s), np.int32)
        self.glued[1:] = (s[1:] == e[:-1]) & (self.text[1:] == self.text[:-1])
        texts = len(offsets) - 1
        count = np.maximum(self.count, 1)
        share = lambda x: np.bincount(self.text, x, texts) / count
        marks = np.isin(data[s], np.frombuffer(b"=:{}();", np.uint8)) & sign[s]
        file = np.searchsorted([0.01, 0.05, 0.2], share(marks), "right") * 16 + np.searchsorted([0.01, 0.05, 0.2], share(digits > 0), "right") * 4 + np.searchsorted([50, 500, 5000], self.count, "right")
        self.file = file[self.text].astype(np.int32)

    def __len__(self) -> int:
        return len(self.start)


@dataclass
class Field:
    """A trained field: weights by feature table, transitions, and the words that it knows."""

    weights: dict[str, np.ndarray]
    moves: np.ndarray
    owner: np.ndarray

    def features(self, t: Tokens) -> dict[str, np.ndarray]:
        """The row of each table for each token; row 0 of the words stands for unknown ones."""
        bucket = (t.hash & np.uint64(_BUCKETS - 1)).astype(np.int32)
        word = np.where(self.owner[bucket] == t.hash, bucket, 0)
        bucket = (t.head & np.uint64(_BUCKETS - 1)).astype(np.int32)
        head = np.where(self.owner[bucket] == t.head, bucket, 0)
        base = {"shape": t.shape, "word": word, "head": head, "glued": t.glued, "file": t.file}
        out = {}
        for name, (k, rows) in _TABLES.items():
            x = base[re.match("[a-z]+", name)[0]]
            if k:
                moved = np.full(len(x), rows - 1, np.int32)  # the last row: no such token in this text
                here, there = (slice(-k, None), slice(None, k)) if k < 0 else (slice(None, -k), slice(k, None))
                if len(x) > abs(k):
                    moved[here] = np.where(t.text[here] == t.text[there], x[there], rows - 1)
                x = moved
            out[name] = x
        return out

    def scores(self, t: Tokens) -> np.ndarray:
        out = np.zeros((len(t), 3), np.float32)
        for name, rows in self.features(t).items():
            out += self.weights[name][rows]
        out[t.glued == 0, INSIDE] = NEVER  # a secret holds no white space
        return out


def viterbi(scores: np.ndarray, moves: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Best labels of a batch of sequences (n, longest, 3), each preceded and followed by outside."""
    n, longest, _ = scores.shape
    back = np.zeros((n, longest, 3), np.int8)
    best = np.where([True, False, False], 0.0, -np.inf) + np.zeros((n, 3))
    end = np.zeros((n, 3))
    for k in range(longest):
        total = best[:, :, None] + moves[None]
        back[:, k] = total.argmax(1)
        best = total.max(1) + scores[:, k]
        end = np.where((lengths == k + 1)[:, None], best + moves[:, OUT], end)
    labels = np.zeros((n, longest), np.int8)
    state = end.argmax(1)
    for k in range(longest - 1, -1, -1):
        inside = k < lengths
        labels[inside, k] = state[inside]
        state = np.where(inside, back[np.arange(n), k, state], state)
    return labels


def decode(scores: np.ndarray, moves: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Viterbi labels of every token of every text. A token is left out of the search only if no run
    of labels through it can score more than outside does, by a bound that adds the best label and
    best transition of each token; the rest of the tokens form the sequences that are decoded."""
    n = len(scores)
    labels = np.zeros(n, np.int8)
    if not n:
        return labels
    finite = moves[np.isfinite(moves)]
    gain = scores[:, 1:].max(1).astype(np.float64) - scores[:, 0] + (finite.max() - moves[OUT, OUT])
    leave = max(0.0, float(finite.max() - moves[OUT, OUT]))
    if not (gain > -leave).any():
        return labels
    far = 2 * np.abs(gain).sum() + 1
    far = min(far, 1e7)
    total = np.cumsum(gain)
    shift = far * text
    before = total - gain - shift
    left = total - shift - np.minimum.accumulate(before)
    after = (total + far * (text[-1] - text))[::-1]
    right = np.maximum.accumulate(after)[::-1] - far * (text[-1] - text) - (total - gain)
    hot = np.flatnonzero(left + right - gain + leave > -1e-3)
    if not len(hot):
        return labels
    cut = np.flatnonzero((np.diff(hot) > 1) | (np.diff(text[hot]) > 0)) + 1
    begin, length = hot[np.append(0, cut)], np.diff(np.concatenate([[0], cut, [len(hot)]]))
    by = np.argsort(length, kind="stable")
    at = 0
    while at < len(by):
        to = at + 1
        while to < len(by) and length[by[to]] * (to + 1 - at) <= 2_000_000 and to - at < 20_000:
            to += 1
        some = by[at:to]
        grid = np.minimum(begin[some][:, None] + np.arange(length[some].max()), n - 1)
        inside = np.arange(grid.shape[1]) < length[some][:, None]
        found = viterbi(scores[grid], moves, length[some])
        labels[grid[inside]] = found[inside]
        at = to
    return labels


# training ----------------------------------------------------------------------------------------

_ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
_HEXES = "0123456789abcdef"
_KEYS = "token api_key apikey secret secret_key client_secret password passwd pwd access_token auth_token private_key aws_secret_access_key credentials db_password session_key signing_key".split()
_KNOWN = re.compile(rb"""(?i)\b(?:token|api_?key|secret|password|passwd|access_key)\s*[=:]\s*["']?([^\s"'|]{12,})|\b(AKIA[0-9A-Z]{16}|ghp_\w{36})\b""")


def _draw(r: np.random.Generator, alphabet: str, n: int) -> str:
    return "".join(alphabet[i] for i in r.integers(0, len(alphabet), n))


def _secret(r: np.random.Generator) -> tuple[str, bool]:
    """A secret, and whether its form alone gives it away."""
    k = int(r.integers(0, 14))
    if k in (0, 13):
        return "AKIA" + _draw(r, _ALNUM[:26] + _ALNUM[52:], 16), True
    if k == 1:
        return "ghp_" + _draw(r, _ALNUM, 36), True
    if k == 2:
        return "sk-" + _draw(r, _ALNUM, 48), True
    if k == 3:
        return f"xoxb-{_draw(r, _ALNUM[52:], 12)}-{_draw(r, _ALNUM, 24)}", True
    if k == 4:
        return "AIza" + _draw(r, _ALNUM + "-_", 35), True
    if k == 5:
        return f"eyJ{_draw(r, _ALNUM, 20)}.eyJ{_draw(r, _ALNUM, 40)}.{_draw(r, _ALNUM + '-_', 43)}", True
    if k == 6:
        return "sk_live_" + _draw(r, _ALNUM, 24), True
    if k == 7:
        return _draw(r, _ALNUM + "+/", 40), False
    if k == 8:
        return _draw(r, _ALNUM + "!#%^*-", int(r.integers(12, 20))), False
    x = _draw(r, _HEXES, int(r.choice([12, 16, 18, 20, 24, 32, 40, 48, 64])))
    return (x.upper() if r.random() < 0.2 else x), False


def _like(r: np.random.Generator) -> str:
    """Something that looks like a secret and is none."""
    hexes, digits = _draw(r, _HEXES, 40), _draw(r, "0123456789", 16)
    word = _draw(r, _ALNUM[26:52], int(r.integers(3, 12)))
    return str(
        r.choice(
            [
                f"commit {hexes}", f"sha256: {_draw(r, _HEXES, 64)}", f"checksum = {hexes}", digits, f"card {digits}", f"+1 ({digits[:3]}) 555-{digits[3:7]}", f"{word}.{digits[:2]}@mail{digits[3]}.example.com",
                f"{int(digits[:2])}.{int(digits[2:4])}.{int(digits[4:6])}.{int(digits[6:8])}", f"token = {word}.token", f'{word} = "{word}"', f"https://{word}.example.com/{word}/{digits[:4]}", f"password: {word}", f"v{digits[0]}.{digits[1]}.{digits[2]}", f"{hexes[:8]}-{hexes[8:12]}-{hexes[12:16]}-{hexes[16:20]}-{hexes[20:32]}",
                f"Licensed under {word[:2].upper()} {word[:2].upper()}-{word[2:4].upper()} {digits[0]}.0.", f"{word.upper()}-{word[:3].upper()}", f"{word[:3].upper()}-{digits[:4]}-{digits[4]}", f"UTF-8 {word.upper()}", f"{word}.{word.title()} {word}",
                f"id={digits[:9]}", f"{word}_{word}_{digits[:3]}", word.upper() * 2, f"secret {word}", f"the token {word}", f"{digits[:4]}-{digits[4:6]}-{digits[6:8]}",
            ]
        )
    )


def _place(r: np.random.Generator) -> tuple[str, str, str]:
    """A secret with what goes before and after it."""
    secret, plain = _secret(r)
    key = str(r.choice(_KEYS))
    key = key.upper() if r.random() < 0.25 else key
    quote = str(r.choice(['"', "'", "", '"']))
    forms = [(f"{key} = {quote}", quote), (f"{key}={quote}", quote), (f"{key}: {quote}", quote), (f'"{key}": "', '"'), (f"export {key}={quote}", quote), ("Authorization: Bearer ", ""), (f"{key} => {quote}", quote)]
    if plain and r.random() < 0.5:
        forms = [("", ""), ("key ", ""), (quote, quote)]
    before, after = forms[int(r.integers(0, len(forms)))]
    return before, secret, after + str(r.choice(["", "", "", "!!", "%%%", ".", ",", ";", "***"]))


def sentences(texts: list[str], count: int, seed: int = 7) -> tuple[list[bytes], list[list[tuple[int, int]]]]:
    """Stretches of the texts' words with secrets and look-alikes set in, and the secrets' spans."""
    r = np.random.default_rng(seed)
    pool = [t.split() for t in texts if t and t.strip()] or [["and", "the", "of"]]
    out, spans = [], []
    for _ in range(count):
        words = pool[int(r.integers(0, len(pool)))]
        at = int(r.integers(0, max(1, len(words) - 10)))
        some = list(words[at : at + int(r.integers(4, 28))])
        if r.random() < 0.2:  # noise, as in badly extracted text
            some = [w + str(r.choice(["###", "%%%", "***", "$$$", "&&&", "!!", " |", ".", "--"])) for w in some]
        inserts: list[tuple[int, str, str, str]] = []
        for _ in range(int(r.integers(0, 3))):
            inserts.append((int(r.integers(0, len(some) + 1)), *_place(r)))
        for _ in range(int(r.integers(0, 3))):
            inserts.append((int(r.integers(0, len(some) + 1)), _like(r), "", ""))
        inserts.sort(key=lambda x: x[0])
        text, own = b"", []
        for i in range(len(some) + 1):
            for k, before, secret, after in inserts:
                if k == i:
                    text += before.encode()
                    if secret:
                        own.append((len(text), len(text) + len(secret.encode())))
                    text += (secret + after).encode() + (b"\n" if r.random() < 0.2 else b" ")
            if i < len(some):
                text += some[i].encode() + b" "
        for m in _KNOWN.finditer(text):  # what the sample itself holds
            a, b = m.span(1) if m[1] else m.span(2)
            if re.search(rb"\d", text[a:b]) and not any(x < b and a < y for x, y in own):
                own.append((a, b))
        out.append(text)
        spans.append(own)
    return out, spans


def token_labels(t: Tokens, offsets: np.ndarray, spans: list[list[tuple[int, int]]]) -> np.ndarray:
    labels = np.zeros(len(t), np.int8)
    for k, own in enumerate(spans):
        for a, b in own:
            i, j = np.searchsorted(t.start, [offsets[k] + a, offsets[k] + b])
            labels[i:j] = INSIDE
            labels[i : i + 1] = BEGIN
    return labels


def train(texts: list[str], count: int = TRAIN_SENTENCES, epochs: int = EPOCHS, seed: int = 7) -> Field:
    """A field fitted by maximum likelihood (forward-backward sums, Adam) on sentences(texts)."""
    made, spans = sentences(texts, count, seed)
    data, offsets = utf8(pa.array(made, pa.binary()).cast(pa.string(), safe=False))
    t = Tokens(data, offsets)
    gold = token_labels(t, offsets, spans)
    near = np.zeros(len(t), bool)
    for k in range(-1, 4):
        near |= np.roll(gold > 0, -k)
    known, often = np.unique(np.concatenate([t.hash[near & (t.end - t.start < 24)], t.head[gold > 0]]), return_counts=True)
    owner = np.zeros(_BUCKETS, np.uint64)
    for h in known[often >= 3][np.argsort(often[often >= 3])]:
        owner[int(h & np.uint64(_BUCKETS - 1))] = h
    owner[[0, _BUCKETS - 1]] = 0
    field = Field({name: np.zeros((rows, 3), np.float32) for name, (_, rows) in _TABLES.items()}, np.zeros((3, 3)), owner)
    rows = field.features(t)
    longest = int(t.count.max())
    grid = np.minimum(t.first[:-1][:, None] + np.arange(longest), len(t) - 1)
    inside = np.arange(longest) < t.count[:, None]
    moves, ban = np.zeros((3, 3)), np.zeros((3, 3))
    ban[OUT, INSIDE] = -np.inf  # a secret starts with begin
    one = np.zeros((len(t), 3))
    one[np.arange(len(t)), gold] = 1
    prior = np.where(t.first[:-1] == t.first[1:], 0, 1)
    gold_moves = np.zeros((3, 3))
    before = np.where(np.append(True, t.text[1:] != t.text[:-1]), OUT, np.append(0, gold[:-1]))
    np.add.at(gold_moves, (before, gold), 1)
    np.add.at(gold_moves, (gold[t.first[1:][t.count > 0] - 1], OUT), 1)
    params = {**field.weights, "moves": moves}
    m, v = ({k: np.zeros(x.shape) for k, x in params.items()} for _ in range(2))
    n = len(made)
    for step in range(1, epochs + 1):
        score = np.zeros((len(t), 3))
        for name, r in rows.items():
            score += field.weights[name][r]
        score[t.glued == 0, INSIDE] = NEVER
        e, step_to = np.exp(np.minimum(score, 40))[grid], np.exp(moves + ban)
        alpha, beta, scale = np.zeros((n, longest, 3)), np.zeros((n, longest, 3)), np.ones((n, longest))
        state = np.tile([1.0, 0.0, 0.0], (n, 1))
        for k in range(longest):
            state = np.where(inside[:, k : k + 1], (state @ step_to) * e[:, k], state)
            scale[:, k] = np.where(inside[:, k], state.sum(1), 1)
            state = np.where(inside[:, k : k + 1], state / scale[:, k : k + 1], state)
            alpha[:, k] = state
        out = np.tile(step_to[:, OUT], (n, 1))
        for k in range(longest - 1, -1, -1):
            beta[:, k] = np.where(inside[:, k : k + 1], out, 0)
            out = np.where(inside[:, k : k + 1], ((e[:, k] * out) / scale[:, k : k + 1]) @ step_to.T, out)
        post = alpha * beta
        post /= np.maximum(post.sum(2, keepdims=True), 1e-300)
        expected = np.zeros((3, 3))
        for k in range(1, longest):
            pair = alpha[:, k - 1, :, None] * step_to[None] * (e[:, k] * beta[:, k])[:, None, :]
            pair *= inside[:, k, None, None]
            expected += (pair / np.maximum(pair.sum((1, 2), keepdims=True), 1e-300)).sum(0)
        expected[OUT] += post[:, 0][prior > 0].sum(0)
        at_end = post[np.arange(n), np.maximum(t.count - 1, 0)]
        expected[:, OUT] += at_end[prior > 0].sum(0)
        flat = np.zeros((len(t), 3))
        flat[grid[inside]] = post[inside]
        slope = one - flat
        for name, x in params.items():
            if name == "moves":
                g = gold_moves - expected
                g[OUT, INSIDE] = 0
            else:
                g = np.stack([np.bincount(rows[name], slope[:, c], len(x)) for c in range(3)], 1)
            g = g / n - 2e-5 * x
            m[name] = 0.9 * m[name] + 0.1 * g
            v[name] = 0.99 * v[name] + 0.01 * g * g
            x += (0.15 * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-9)).astype(x.dtype)
    field.moves = moves + ban
    return field


# scanning ----------------------------------------------------------------------------------------


def spans_of(data: np.ndarray, offsets: np.ndarray, field: Field) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, start and end byte (in data), tokens and score over outside of each secret found."""
    t = Tokens(data, offsets)
    scores = field.scores(t)
    labels = decode(scores, field.moves, t.text)
    begin = np.flatnonzero(labels == BEGIN)
    if not len(begin):
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0),)
    other = np.flatnonzero(labels != INSIDE)
    end = np.append(other, len(t))[np.searchsorted(other, begin, "right")]
    end = np.minimum(end, t.first[1:][t.text[begin]])
    lead = np.concatenate([[0], np.cumsum(np.take_along_axis(scores, labels[:, None].astype(np.int64), 1)[:, 0].astype(np.float64) - scores[:, 0])])
    return t.text[begin], t.start[begin], t.end[end - 1], end - begin, lead[end] - lead[begin]


def sample(docs: DataFrame, text: str, count: int) -> list[str]:
    """At most `count` texts of docs, the first TRAIN_CHARS characters of each: those of the least hashes, so that
    neither the order nor the partitions of docs matter. Of the whole table only hashes are sorted. Null
    texts take no part; equal ones count once; an empty table gives none."""
    texts = docs.select(F.col(f"`{text}`").alias("text"), F.xxhash64(F.col(f"`{text}`")).alias("hash")).where("text is not null")
    least = [r[0] for r in texts.select("hash").distinct().orderBy("hash").limit(count).collect()]
    if not least:
        return []
    found = texts.where(F.col("hash") <= least[-1]).select(F.substring("text", 1, TRAIN_CHARS), "hash").dropDuplicates(["hash"]).collect()
    return [r[0] for r in sorted(found, key=lambda r: r[1])]


def scan(docs: DataFrame, field: Field | None = None, key: str = "doc_id", text: str = "text", train_docs: int = TRAIN_DOCS) -> DataFrame:
    """(doc_id, start_byte, end_byte, n_tokens, score) of every secret in every document; bytes count
    in the text's UTF-8, score is the log-odds of the tokens' labels against outside.

    Without a field, one is trained on at most train_docs documents. Null and empty texts hold no
    secrets; null keys are carried; repeated rows are each reported; other columns don't matter.
    There is no shuffle."""
    field = field or train(sample(docs, text, train_docs))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            data, offsets = utf8(part.column(1))
            doc, start, end, count, score = spans_of(data, offsets, field)
            numbers = [pa.array(x, pa.int64()) for x in (start - offsets[doc], end - offsets[doc], count)]
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc)), *numbers, pa.array(score, pa.float64())], names=["doc_id", "start_byte", "end_byte", "n_tokens", "score"])

    return docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(lambda b: tidy(run(b)), f"doc_id {kind}, start_byte bigint, end_byte bigint, n_tokens bigint, score double")


def redact(docs: DataFrame, field: Field | None = None, text: str = "text", train_docs: int = TRAIN_DOCS) -> DataFrame:
    """docs with every secret in text replaced by [SECRET]; all rows and columns stay, null texts null.
    A text column's other measures (such as a length) are left as they were."""
    field = field or train(sample(docs, text, train_docs))

    @F.arrow_udf("string")
    def clean(texts: pa.Array) -> pa.Array:
        out: list[pa.Array] = []
        for part in slices(iter([pa.RecordBatch.from_arrays([texts], names=["text"])]), "text"):
            column = part.column(0)
            data, offsets = utf8(column)
            doc, start, end, _, _ = spans_of(data, offsets, field)
            if len(doc):
                rows = column.to_pylist()
                for d in np.unique(doc).tolist():
                    raw, pieces, at = data[offsets[d] : offsets[d + 1]].tobytes(), [], 0
                    for s, e in zip((start[doc == d] - offsets[d]).tolist(), (end[doc == d] - offsets[d]).tolist()):
                        pieces += [raw[at:s], REDACTED]
                        at = e
                    rows[d] = b"".join([*pieces, raw[at:]]).decode()
                column = pa.array(rows, pa.string())
            out.append(column.cast(pa.string()))
        trim()
        return pa.concat_arrays(out) if out else pa.array([], pa.string())

    return docs.withColumn(text, clean(F.col(f"`{text}`")))
