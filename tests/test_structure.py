from __future__ import annotations

from leafmill.operators import structure as S


def render(spark, text):
    return S.markdown(spark.createDataFrame([(1, text)], "doc_id int, text string")).first().markdown


def test_report(spark):
    text = "Quarterly Report\n====\n\nname\tQ1\tQ2\nalpha\t1\t2\nbeta\t3\n\nClosing note"
    assert render(spark, text) == "# Quarterly Report\n\n| name | Q1 | Q2 |\n| --- | --- | --- |\n| alpha | 1 | 2 |\n| beta | 3 |  |\n\nClosing note"


def test_pairs_need_two_lines(spark):
    assert render(spark, "Name: A\nAge = 3\nx") == "| Name | A |\n| --- | --- |\n| Age | 3 |\n\nx"
    assert render(spark, "Name: A\nx") == "Name: A\n\nx"
    assert render(spark, "2024-01-01 10:30\nsee http://a.b\nTitle: x") == "2024-01-01 10:30\n\nsee http://a.b\n\nTitle: x"


def test_separator_rows_and_outer_pipes(spark):
    assert render(spark, "| a | b |\n|---|:---:|\n| c | d |") == "| a | b |\n| --- | --- |\n| c | d |"


def test_null_and_empty(spark):
    assert render(spark, None) == render(spark, "") == render(spark, "\n \n") == ""


def test_line_ends(spark):
    assert render(spark, "a\r\nb\rc") == "a\n\nb\n\nc"
