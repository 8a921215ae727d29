"""Cases that the operators once left out."""

from __future__ import annotations

import random

from test_operators import prose

from leafmill.llm import decontaminate, pii, repetition


def kept(spark, texts):
    return {r.doc_id for r in repetition.repetition(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).where("keep").collect()}


def test_short_repeats_count(spark):
    unique = prose(200, 40).split()
    in_row = " ".join(w for w in unique[:8] for _ in range(6))
    pairs = " ".join(f"{a} {b} " * 3 for a, b in zip(unique[:20:2], unique[1:20:2]))
    lines = "\n".join(f"read more about it\n{w}" for w in unique[:40])
    item = prose(6, 41)
    menu = " ".join(f"{item} {w}" for w in unique[:3])
    sentence = prose(12, 42)
    clean = [prose(60_000, 43), prose(30, 44), "the cat and the dog and the bird saw the man and the boy at the end of the day", f"{sentence} {prose(8, 45)} {sentence}"]
    assert kept(spark, [in_row, pairs, lines, menu, *clean]) == {4, 5, 6, 7}
    got = repetition.repetition(spark.createDataFrame([(in_row,)], "text string")).first()
    assert (got.n_repeats, got.covered_fraction, got.short_fraction, got.repeated_fraction) == (0, 0, 1, 1)


def test_one_block_pasted_often_counts(spark):
    unique = prose(40, 50).split()
    block, half, licence = prose(50, 51), prose(95, 52), prose(20, 53)
    pasted = " ".join(f"{block} {w}" for w in unique[:20])
    thrice = " ".join(f"{licence} {w}" for w in unique[:3])
    assert kept(spark, [pasted, f"{half} {half}", thrice, f"{licence} {unique[0]} {licence}", f"{half} {licence} {prose(300, 54)} {licence}"]) == {3, 4}
    got = repetition.repetition(spark.createDataFrame([(pasted,)], "text string")).first()
    assert (got.n_repeats, got.n_extra, got.longest_words) == (1, 19, 50)


def test_repeats_in_a_run_without_spaces(spark):
    r = random.Random(7)
    thai = lambda n: "".join(chr(r.randint(0x0E01, 0x0E2E)) for _ in range(n))
    passage = thai(55)
    rows = [(k, thai(100) + passage + thai(101 + k) + passage + thai(102 + 2 * k) + passage + thai(40)) for k in range(20)]
    got = repetition.repetition(spark.createDataFrame([*rows, (99, thai(600))], "doc_id int, text string")).collect()
    for x in got:
        assert (x.n_repeats > 0 and 0.25 < x.covered_fraction < 0.4) == (x.doc_id < 99)
    assert kept(spark, [passage * 9, "abc" * 200, thai(600)]) == {2}


def test_short_items_are_reported_and_remove_nothing(spark):
    long = prose(20, 60)
    items = [(1, "Paris"), (2, "forty two?"), (3, "na na"), (4, long), (5, ""), (6, None)]
    docs = [(1, "In Paris, it was Forty-Two."), (2, "na na na"), (3, f"paris {long}"), (4, "forty one two"), (5, None)]
    d, b = spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string")
    got = {(r.doc_id, r.item_id, r.doc_word, r.n_words, r.start_byte, r.end_byte, r.short) for r in decontaminate.matches(d, b).collect()}
    assert got == {(1, 1, 1, 1, 3, 8, True), (1, 2, 4, 2, 17, 26, True), (2, 3, 0, 2, 0, 5, True), (2, 3, 1, 2, 3, 8, True), (3, 1, 0, 1, 0, 5, True), (3, 4, 1, 20, 6, 6 + len(long), False)}
    assert {r.doc_id for r in decontaminate.decontaminate(d, b).collect()} == {1, 2, 4, 5}


def test_national_numbers_and_several_given_names():
    numbers = ["030 1234567", "0171-2345678", "01 23 45 67 89", "612 345 678", "020 7946 0958"]
    for number in numbers:
        new, n = pii.replace(f"Call {number}, please.", b"key")
        assert n == 1 and number not in new and len(new) == len(number) + 14 and (number[0] != "0" or new[5] == "0")
    for other in ("01.02.2003", "2003-01-02 10", "0.123456789", "1 234 567", "123 456 789"):
        assert pii.replace(f"On {other}, then.", b"key")[1] == 0
    found = [(e.kind, e.canonical) for e in pii.entities("Maria Anna Schmidt met Karl J. Emil Paul Weber; Eva Lena said so. Maria went.")]
    assert found == [("given-f", "maria"), ("given-f", "anna"), ("surname", "schmidt"), ("given-m", "karl"), ("given-m", "emil"), ("given-m", "paul"), ("surname", "weber"), ("given-f", "eva"), ("given-f", "lena")]
