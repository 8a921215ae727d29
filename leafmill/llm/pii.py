"""Surrogates for personal data.

E-mail addresses, telephone and card numbers, IP addresses and names are
detected and replaced by made-up ones of the same kind and form: letters of the
same script and case, as many digits, the same separators, checksum and address
class, given names of the same gender. A replacement depends only on a secret
key and on what is named, whatever its spelling, so mentions of one thing stay
mentions of one thing, in all documents. The replacements of the whole corpus
are checked for collisions, with each other and with real data; who collides
gets another one, until all are distinct.
"""

from __future__ import annotations

import hashlib
import re
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import forget, free_name, slices, stored, tidy, trim

#: Setting of the session that has the secret key; without it, replacements can be repeated by anyone.
KEY_SETTING = "spark.leafmill.pii.key"
#: Entities with changed replacements up to which every worker has them all (some 100 bytes each); beyond it the
#: documents that hold them are joined by a hash of their text.
WORKER_ENTITIES = 100_000
#: Attempts after which a form that has no free place is widened, a step for each further so many.
WIDER = 8

_GIVEN = {
    ("latin", "m"): "Adam Albert Andreas Anton Benjamin Carlos Charles Christian Daniel David Diego Edward Emil Eric Felix Frank Fernando George Gustav Henry Hugo Ivan Jacob James Javier John Jorge Joseph Julian Karl Leon Louis Lukas Marco Martin Michael Miguel Nicolas Oliver Oscar Pablo Patrick Paul Peter Philip Pierre Richard Robert Samuel Simon Stefan Thomas Victor Walter William".split(),
    ("latin", "f"): "Alice Amelie Andrea Angela Anna Barbara Beatriz Camille Carmen Caroline Charlotte Christine Clara Diana Elena Elizabeth Ella Emily Emma Eva Florence Grace Hannah Helen Ingrid Isabel Jane Johanna Julia Karen Laura Lena Linda Louise Lucia Margaret Maria Martha Mary Monica Nicole Nina Nora Olivia Patricia Paula Rachel Rosa Sarah Sofia Susan Teresa Ursula Valerie Victoria".split(),
    ("cyrillic", "m"): "Александр Алексей Андрей Борис Виктор Владимир Дмитрий Иван Максим Михаил Николай Олег Павел Пётр Роман Сергей Юрий".split(),
    ("cyrillic", "f"): "Анастасия Анна Вера Виктория Галина Дарья Екатерина Елена Ирина Ксения Людмила Марина Мария Наталья Ольга Светлана Татьяна".split(),
    ("greek", "m"): "Αλέξανδρος Ανδρέας Γιώργος Δημήτρης Κώστας Μιχάλης Νίκος Παύλος Σπύρος".split(),
    ("greek", "f"): "Άννα Αικατερίνη Βασιλική Γεωργία Δέσποινα Ελένη Ιωάννα Μαρία Σοφία".split(),
}
_PARTS = {
    "latin": ("Al Bar Bel Bor Bran Cal Car Dal Del Dor El Fal Fen Gar Gel Hal Har Hol Kal Kel Kor Lan Lin Mar Mel Mor Nor Or Pal Per Ral Ran Ros Sal Sel Sil Tal Tor Val Ver Wal Wen Win".split(), "ba ca da de do ga go la le li lo ma mi na ne ni no ra re ri ro sa se ta te ti to va vi".split(), "berg court dale den der don feld field gard ger holm ker land ler ley man mer mont more nard ner nov rens res rin sen ser son stad ston ter ton ville well wood".split()),
    "cyrillic": ("Бар Бел Бор Вел Вор Гор Дал Дор Зар Кал Кор Лан Мар Мел Нор Пал Рос Сав Сел Тар Тор Фед".split(), "ба ва го да за ка ло ма ни по ра са ти".split(), "дин кин лин мин нин рин син тин ков нов ров сов тов".split()),
    "greek": ("Βαλ Γερ Δελ Καλ Κορ Λαν Μαρ Μελ Νικ Παν Ραλ Σαβ Στα Ταρ Φερ".split(), "βα γε δη κα λο μα νι ρα σα τη".split(), "δης κης λης μης νης ρης της".split()),
}
_HAN = "王李张刘陈杨黄赵周吴徐孙马朱胡郭何林高罗郑梁谢宋唐许韩冯邓曹彭曾肖田董袁潘蔡蒋余"
_HAN_GIVEN = {"m": "伟强磊军洋勇杰涛明超刚平辉鹏华飞龙波宁浩", "f": "芳娜敏静丽艳娟霞秀燕玲桂兰红梅莹雪琳慧颖"}
_GENDER = {n.lower(): (s, g) for (s, g), names in _GIVEN.items() for n in names}
_TITLES = {"mr": "m", "mister": "m", "herr": "m", "señor": "m", "sr": "m", "monsieur": "m", "господин": "m", "κύριος": "m", "mrs": "f", "ms": "f", "miss": "f", "frau": "f", "señora": "f", "sra": "f", "madame": "f", "mme": "f", "госпожа": "f", "κυρία": "f", "dr": "", "prof": "", "professor": "", "доктор": ""}

_EMAIL = re.compile(r"[^\W_][\w.+-]*@[^\W_][\w-]*(?:\.[^\W_][\w-]*)+")
_DIGITS = re.compile(r"[+(\d](?:[() .-]?\d|[ -]?\(\d|\) ?\d){5,}")
_IP = re.compile(r"(?:\d{1,3}\.){3}\d{1,3}")
_WORD = r"[^\W\d_](?:[^\W\d_]|['’-](?=[^\W\d_]))+"
_TITLED = re.compile(rf"(?:{'|'.join(sorted({t for k in _TITLES for t in (k, k.title(), k.upper())}, key=len, reverse=True))})\.? ({_WORD})(?: ({_WORD}))?(?: ({_WORD}))?")
_KNOWN = rf"(?:{'|'.join(n for names in _GIVEN.values() for n in names)})"
_NAMED = re.compile(rf"{_KNOWN}(?: [^\W\d_]\.| {_KNOWN}(?![\w'’-]))* ({_WORD})")
#: Telephone numbers as they are written in one country: area and number, groups after a zero, nine digits in groups.
_NATIONAL = re.compile(r"0\d{1,4}[ -]\d{5,8}|0\d(?:[ .-]\d{2}){4}|0\d{2,4}(?:[ -]\d{2,4}){2,4}|[6-9]\d{2}(?:[ -]\d{3}){2}|[6-9]\d{2}(?: \d{2}){3}")
_HAN_TITLED = re.compile(rf"([{_HAN}][一-鿿]{{1,2}})(先生|女士|小姐)")


@dataclass(frozen=True)
class Entity:
    """What is named in text[start:end]: canonical is the same for all spellings of one thing."""

    start: int
    end: int
    kind: str
    canonical: str


def script_of(text: str) -> str:
    """latin, cyrillic, greek or han, by the first letter."""
    c = next((c for c in text if c.isalpha()), "a")
    return "cyrillic" if "Ѐ" <= c <= "ӿ" else "greek" if "Ͱ" <= c <= "Ͽ" or "ἀ" <= c <= "῿" else "han" if "一" <= c <= "鿿" else "latin"


def _luhn(digits: str) -> int:
    """The checksum modulo 10, which is 0 for a valid card number."""
    return sum(sum(divmod(2 * int(d), 10)) if k % 2 else int(d) for k, d in enumerate(reversed(digits))) % 10


def _numbers(text: str) -> Iterator[Entity]:
    for m in _DIGITS.finditer(text):
        whole = _number(text, *m.span())
        if whole:
            yield whole
        elif " " in m[0]:  # several numbers side by side
            for part in re.finditer(r"[^ ]+", m[0]):
                own = _number(text, m.start() + part.start(), m.start() + part.end())
                if own:
                    yield own


def _number(text: str, a: int, b: int) -> Entity | None:
    """What text[a:b] is if it is an address, a card's or a telephone's number."""
    raw = text[a:b]
    if a and (text[a - 1].isalnum() or text[a - 1] in "_.@/#=-" and raw[0] != "+") or b < len(text) and (text[b].isalnum() or text[b] in "_@"):
        return None
    if _IP.fullmatch(raw):
        return Entity(a, b, "ip", ".".join(str(int(x)) for x in raw.split("."))) if all(int(x) < 256 for x in raw.split(".")) else None
    digits = re.sub(r"\D", "", raw)
    if 13 <= len(digits) <= 19 and re.fullmatch(r"\d+|\d{4}(?:[ -]\d{2,7})+", raw):
        return Entity(a, b, "card", digits)
    if 7 <= len(digits) <= 15 and raw.count("(") == raw.count(")") and (raw[0] in "+(" or re.fullmatch(r"(?:1[ .-])?\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}", raw) or 9 <= len(digits) <= 12 and _NATIONAL.fullmatch(raw)):
        return Entity(a, b, "phone", digits[-10:] if len(digits) == 10 or len(digits) == 11 and digits[0] == "1" else digits)
    return None


def _names(text: str) -> Iterator[Entity]:
    surnames: set[str] = set()

    def add(at: int, word: str) -> Entity:
        known = _GENDER.get(word.lower())
        if not known:
            surnames.add(word)
        return Entity(at, at + len(word), f"given-{known[1]}" if known else "surname", word.lower())

    for m in _TITLED.finditer(text):
        if m.start() and (text[m.start() - 1].isalnum() or text[m.start() - 1] == "_"):
            continue
        for g in (1, 2, 3):
            if not m[g] or not (m[g].istitle() or m[g].isupper() and not m[0][:2].isupper()):
                break
            yield add(m.start(g), m[g])
    for m in _NAMED.finditer(text):
        if m.start() and (text[m.start() - 1].isalnum() or text[m.start() - 1] in "_-"):
            continue
        given = list(re.finditer(_WORD, m[0][: m.start(1) - m.start()]))
        if not m[1].istitle() and len(given) < 2:
            continue
        for g in given:
            yield add(m.start() + g.start(), g[0])
        if m[1].istitle():
            yield add(m.start(1), m[1])
    for m in _HAN_TITLED.finditer(text):
        yield Entity(*m.span(1), f"han-{'m' if m[2] == '先生' else 'f'}", m[1])
    for word in surnames:  # later mentions of a person by the surname alone
        for m in re.finditer(rf"(?<!\w)(?:{re.escape(word)}|{re.escape(word.upper())}|{re.escape(word.title())})(?!\w)", text):
            yield Entity(*m.span(), "surname", word.lower())


def entities(text: str, numbers: bool = True, names: bool = True) -> list[Entity]:
    """All personal data in a text, in order and without overlaps (the earlier and longer wins)."""
    found = [Entity(*m.span(), "email", m[0].lower()) for m in _EMAIL.finditer(text)] if "@" in text else []
    if numbers:
        found += _numbers(text)
    if names:
        found += _names(text)
    out: list[Entity] = []
    for e in sorted(found, key=lambda e: (e.start, -e.end)):
        if not out or e.start >= out[-1].end:
            out.append(e)
    return out


_MAY_NUMBER = r"\d[0-9() .-]{5,}|@"
_MAY_NAME = f"(?:{'|'.join(sorted({t for k in _TITLES for t in (k, k.title(), k.upper())} | {n for names in _GIVEN.values() for n in names}))})\\.? |先生|女士|小姐"


def all_entities(texts: pa.Array) -> list[list[Entity] | None]:
    """entities() of each text, null for a null one. What can't hold any is told by one pass of an automaton."""
    numbers = pc.match_substring_regex(texts, _MAY_NUMBER).to_pylist()
    names = pc.match_substring_regex(texts, _MAY_NAME).to_pylist()
    return [None if a is None else entities(texts[k].as_py(), a, b) if a or b else [] for k, (a, b) in enumerate(zip(numbers, names))]


class _Stream:
    """Numbers drawn from a keyed hash of what is named."""

    def __init__(self, key: bytes, *what: object) -> None:
        self.key, self.what, self.block, self.data = key if len(key) <= 64 else hashlib.blake2b(key).digest(), "\0".join(map(str, what)).encode(), 0, b""

    def below(self, n: int) -> int:
        if len(self.data) < 4:
            self.data += hashlib.blake2b(self.what + self.block.to_bytes(4, "big"), key=self.key).digest()
            self.block += 1
        x, self.data = int.from_bytes(self.data[:4], "big"), self.data[4:]
        return x * n >> 32

    def pick(self, some: list[str] | str) -> str:
        return some[self.below(len(some))]


def _letter(c: str, draw: _Stream) -> str:
    if c.isdigit():
        return str(draw.below(10))
    if not c.isalpha():
        return c
    letters = {"cyrillic": "абвгдежзиклмнопрстуфхцчшэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω", "han": _HAN}.get(script_of(c), "abcdefghijklmnopqrstuvwxyz")
    new = draw.pick(letters)
    return new.upper() if c.isupper() else new


def surrogate(kind: str, canonical: str, attempt: int, key: bytes) -> str:
    """The canonical form of the replacement; another for each attempt, never the thing itself.
    The first attempts vary the form's free letters and digits. A form may have no free place left (there are
    65,536 addresses 192.168.x.x), so further ones widen it: names grow by syllables, numbers by digits, e-mail
    addresses by letters, private addresses to 10.x.x.x and then to local IPv6 ones, public to IPv6 ones."""
    for again in range(100):
        new = _surrogate(kind, canonical, attempt, _Stream(key, kind, canonical, attempt, again))
        if new != canonical:
            return new
    return new


def _surrogate(kind: str, canonical: str, attempt: int, draw: _Stream) -> str:
    if kind == "email":
        local, _, domain = canonical.partition("@")
        labels = domain.split(".")
        local += "a" * (attempt // WIDER)
        return "".join(_letter(c, draw) for c in local) + "@" + ".".join(["".join(_letter(c, draw) for c in x) for x in labels[:-1]] + labels[-1:])
    if kind == "ip":
        old = canonical.split(".")
        private = old[0] in ("10", "127") or old[:2] == ["192", "168"] or old[0] == "172" and 16 <= int(old[1]) < 32
        if attempt >= 3 * WIDER:
            return ("fd00" if private else "2001:db8") + "".join(f":{draw.below(65536):x}" for _ in range(7 if private else 6))
        if private and old[0] != "127" and attempt >= WIDER:
            old = ["10", "0", "0", "0"]
        keep = 1 if old[0] in ("10", "127") else 2 if old[:2] == ["192", "168"] or old[0] == "172" and 16 <= int(old[1]) < 32 else 0
        new = old[:keep] + [str(draw.below(256)) for _ in old[keep:]]
        if not keep:
            new[0] = draw.pick([str(k) for k in range(1, 224) if k not in (10, 127, 172, 192)])
        return ".".join(new)
    if kind == "card":
        body = canonical[0] + "".join(str(draw.below(10)) for _ in canonical[2:] + "0" * (attempt // WIDER))
        return body + next(d for d in "0123456789" if _luhn(body + d) == _luhn(canonical))
    if kind == "phone":
        keep = max(0, len(canonical) - 10)
        new = [str(draw.below(10)) for _ in canonical[keep:]]
        for k in (0, 3):  # a zero or one doesn't begin an area or exchange, unless it did
            if k < len(new) and new[k] in "01" and canonical[keep + k] not in "01":
                new[k] = str(2 + draw.below(8))
        if canonical[keep] == "0":  # of a number as written in one country
            new[0] = "0"
        elif len(canonical) == 9 and canonical[0] in "6789":
            new[0] = draw.pick("6789")
        return canonical[:keep] + "".join(new) + "".join(str(draw.below(10)) for _ in range(attempt // WIDER))
    script = script_of(canonical)
    if kind.startswith("han"):
        return draw.pick(_HAN) + "".join(draw.pick(_HAN_GIVEN[kind[-1]]) for _ in canonical[1:]) + "".join(draw.pick(_HAN_GIVEN[kind[-1]]) for _ in range(attempt // 8))
    if kind.startswith("given"):
        names = _GIVEN[script, kind[-1]]
        return "-".join(draw.pick(names) for _ in range(1 + (attempt > 0) + attempt // 4)).lower()
    first, middle, last = _PARTS.get(script, _PARTS["latin"])
    name = draw.pick(first) + "".join(draw.pick(middle) for _ in range(1 + draw.below(2) + attempt)) + draw.pick(last)
    return (name + "а" if script == "cyrillic" and canonical.endswith("а") else name).lower()


def rendered(original: str, kind: str, new: str) -> str:
    """A replacement in the spelling of what it replaces: separators, case, country code, leading zeros."""
    if kind == "ip":
        return new
    if kind in ("card", "phone"):
        old = "".join(c for c in original if c.isdigit())
        digits = iter(old[: max(0, len(old) - len(new))] + new)
        return "".join(next(digits) if c.isdigit() else c for c in original) + "".join(digits)  # a widened one has more
    if kind == "email":
        return "".join(n.upper() if o.isupper() else n for o, n in zip(original, new)) if len(original) == len(new) else new
    return new.upper() if original.isupper() and len(original) > 1 else re.sub(_WORD.replace("['’-](?=[^\\W\\d_])", "['’]"), lambda m: m[0][0].upper() + m[0][1:], new)


def replace(text: str, key: bytes, attempts: dict[tuple[str, str], int] | None = None, make: Callable[[str, str, int, bytes], str] = surrogate, found: list[Entity] | None = None) -> tuple[str, int]:
    """The text with every entity replaced, and how many there were."""
    found, out, at = entities(text) if found is None else found, [], 0
    for e in found:
        new = make(e.kind, e.canonical, (attempts or {}).get((e.kind, e.canonical), 0), key)
        out += [text[at : e.start], rendered(text[e.start : e.end], e.kind, new)]
        at = e.end
    return "".join([*out, text[at:]]), len(found)


def settle(named: DataFrame, key: bytes, make: Callable[[str, str, int, bytes], str] = surrogate) -> DataFrame:
    """(kind, canonical, attempt, surrogate) of all distinct entities in named (kind, canonical), without
    two of a kind that share a surrogate and without a surrogate that is itself an entity. Repeated rows
    count once, rows with a null don't count, no rows give none. Forms widen with the attempts, so rounds
    come to an end however many entities there are."""

    @F.arrow_udf("string")
    def made(kind: pa.Array, canonical: pa.Array, attempt: pa.Array) -> pa.Array:
        return pa.array([make(*x, key) for x in zip(kind.to_pylist(), canonical.to_pylist(), attempt.to_pylist())], pa.string())

    real = stored(named.select("kind", "canonical").dropna().distinct(), "entities")
    now = stored(real.withColumn("attempt", F.lit(0)).withColumn("surrogate", made("kind", "canonical", "attempt")), "surrogates")
    while True:
        winners = now.groupBy("kind", "surrogate").agg(F.min(F.struct("attempt", "canonical")).alias("first"), F.count("*").alias("n"))
        losers = now.join(winners.where("n > 1"), ["kind", "surrogate"]).where("canonical <> first.canonical").select("kind", "canonical")
        taken = now.join(real.select("kind", F.col("canonical").alias("surrogate")), ["kind", "surrogate"], "left_semi").select("kind", "canonical")
        clash = stored(losers.unionAll(taken).distinct(), "clashes")
        if clash.isEmpty():
            forget(clash, real)
            return now
        again = now.join(clash, ["kind", "canonical"], "left_semi").withColumn("attempt", F.col("attempt") + 1).withColumn("surrogate", made("kind", "canonical", "attempt"))
        before, now = now, stored(now.join(clash, ["kind", "canonical"], "left_anti").unionByName(again), "surrogates")
        forget(before, clash)


def pseudonymize(docs: DataFrame, text: str = "text", key: bytes | None = None, make: Callable[[str, str, int, bytes], str] = surrogate) -> DataFrame:
    """docs with personal data in text replaced, and n_entities. Every other column stays as it is.

    A null text stays null with a null n_entities; an empty one stays empty; repeated rows and null
    keys don't matter; a column named n_entities stays and the new one gets a trailing underscore.
    Texts are read twice: for the entities of all documents, which are shuffled by what they name to
    be told apart, and to be rewritten where they are. Workers have the few replacements that a collision
    changed; only if these exceed WORKER_ENTITIES, the documents that hold them are joined."""
    spark = docs.sparkSession
    if key is None:
        key = spark.conf.get(KEY_SETTING, "").encode()
        if not key:
            warnings.warn(f"{KEY_SETTING} is not set: a published key is used, with which anyone can repeat the replacements", stacklevel=2)
            key = b"demonstration"
    count, name = free_name(docs, "n_entities"), free_name(docs, "text_hash")
    special_name = free_name(docs, "changed")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            rows = [(h, *x) for h, some in zip(part.column(0).to_pylist(), all_entities(part.column(1))) for x in {(e.kind, e.canonical) for e in some or ()}]
            h, k, c = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(k, pa.string()), pa.array(c, pa.string())], names=["h", "kind", "canonical"])

    named = stored(docs.select(F.xxhash64(F.col(f"`{text}`")).alias("h"), F.col(f"`{text}`").alias("text")).mapInArrow(lambda b: tidy(find(b)), "h bigint, kind string, canonical string"), "named")
    changed = stored(settle(named, key, make).where("attempt > 0").select("kind", "canonical", "attempt"), "changed")
    few = changed.count() <= WORKER_ENTITIES
    shared = spark.sparkContext.broadcast({(r.kind, r.canonical): r.attempt for r in changed.collect()} if few else {})
    if few:
        forget(named, changed)

    def swap(texts: pa.Array, lists: pa.Array | None) -> pa.Array:
        found, out, counts = all_entities(texts), [], []
        for k, some in enumerate(found):
            attempts = shared.value
            if lists is not None and some:
                attempts = {(x["kind"], x["canonical"]): x["attempt"] for x in lists[k].as_py() or ()}
            out.append(replace(texts[k].as_py(), key, attempts, make, some)[0] if some else texts[k].as_py())
            counts.append(None if some is None else len(some))
        made = pa.StructArray.from_arrays([pa.array(out, pa.string()), pa.array(counts, pa.int32())], names=["text", "n"])
        trim()
        return made

    def one(texts: pa.Array) -> pa.Array:
        return swap(texts, None)

    def two(texts: pa.Array, lists: pa.Array) -> pa.Array:
        return swap(texts, lists)

    if few:
        joined, new = docs, F.arrow_udf(one, "text string, n int")(F.col(f"`{text}`"))
    else:
        special = named.join(changed, ["kind", "canonical"]).distinct().groupBy("h").agg(F.collect_list(F.struct("kind", "canonical", "attempt")).alias(special_name)).withColumnRenamed("h", name)
        joined = docs.withColumn(name, F.xxhash64(F.col(f"`{text}`"))).join(special, name, "left")
        new = F.arrow_udf(two, "text string, n int")(F.col(f"`{text}`"), F.col(special_name))
    made = joined.withColumn(name, new)
    return made.select(*[F.col(f"`{name}`.text").alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns], F.col(f"`{name}`.n").alias(count))
