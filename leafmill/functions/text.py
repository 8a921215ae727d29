"""Column functions over text: lines, markers, Markdown measures, normal forms. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO_DATE = r"^\s*\d{4}-\d{2}-\d{2}"
UNDERLINE = r"^\s*(={3,}|-{3,})\s*$"
SEPARATOR_CELL = r"^\s*:?-{3,}:?\s*$"
KEY_VALUE = r"^\s*([^:：=＝|\t]{1,80}?)\s*[:：=＝]\s*(\S.*)$"
HEADING_LABEL = r"(?i)^\s*(title|heading\s*[0-9]*)\s*$"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lines(text: Column | str) -> Column:
    """A text's lines; CR LF and CR end one too."""
    return F.split(F.regexp_replace(col(text), "\r\n?", "\n"), "\n")


def blank(line: Column) -> Column:
    return F.trim(line) == ""


def is_table_line(line: Column) -> Column:
    """Two parts or more between tabs or pipes, the outer pipes not counted."""
    return F.size(cells(line)) > 1


def cells(line: Column) -> Column:
    """The trimmed parts of a table line."""
    inner = F.regexp_replace(F.trim(line), r"^\||\|$", "")
    return F.transform(F.split(inner, r"[\t|]"), lambda x: F.trim(x))


def is_separator(line: Column) -> Column:
    """A row of dashes under a Markdown table's header."""
    return is_table_line(line) & F.forall(cells(line), lambda x: x.rlike(SEPARATOR_CELL))


def key_of(line: Column) -> Column:
    return F.regexp_extract(line, KEY_VALUE, 1)


def value_of(line: Column) -> Column:
    return F.trim(F.regexp_extract(line, KEY_VALUE, 2))


def is_key_value(line: Column) -> Column:
    """`key: value` or `key = value`; the key isn't a date or a heading's label and the value no rest of a URL."""
    return line.rlike(KEY_VALUE) & ~key_of(line).rlike(ISO_DATE) & ~key_of(line).rlike(HEADING_LABEL) & ~value_of(line).startswith("//")


#: Ordered rules of list markers: pattern and replacement; the first that matches counts.
LIST_MARKERS = [
    (r"^\s*[□☐]\s*", "- [ ] "),
    (r"^\s*[☑☒✓✔]\s*", "- [x] "),
    (r"^\s*\[\s*[xX✓✔]\s*\]\s*", "- [x] "),
    (r"^\s*\[\s*\]\s*", "- [ ] "),
    (r"^\s*[•·▪◦●○■‣∙・]\s*", "- "),
    (r"^\s*\(([0-9]{1,3})\)\s*", "$1. "),
    (r"^\s*([0-9]{1,3})\s*[):]\s*", "$1. "),
    (r"^\s*([0-9]{1,3})\.\s+", "$1. "),
    (r"^\s*(?:[a-zA-Z]|[ivxlcdmIVXLCDM]{2,8})[.)]\s+", "- "),
    (r"^\s*[①-⑩]\s*", "- "),
]


def normal_marker(line: Column | str) -> Column:
    """A line with its list marker in Markdown's form; null if it has none."""
    line = col(line)
    return F.coalesce(*[F.when(line.rlike(p), F.regexp_replace(line, p, r)) for p, r in LIST_MARKERS])


#: Steps, in order, that leave of Markdown its words.
NORMAL_STEPS = [
    (r"(?m)^#{1,6}\s+", ""), (r"\*{1,3}([^*\n]+)\*{1,3}", "$1"), (r"~~", ""), (r"</?(sup|sub|u|br)\s*/?>", " "), (r"!\[[^\]]*\]\([^)]*\)", " "),
    (r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"[|`_>\\{}\[\]()\"',.;:!?]", " "), (r"(?i)\bimage [0-9]+\b", " "), (r"-{3,}", " "), (r"\s+", " "),
]


def normalized(text: Column | str) -> Column:
    """A text without Markdown and punctuation, white space collapsed."""
    out = col(text)
    for pattern, new in NORMAL_STEPS:
        out = F.regexp_replace(out, pattern, new)
    return F.trim(out)


def count_of(text: Column | str, pattern: str) -> Column:
    return F.regexp_count(col(text), F.lit(pattern)).cast("bigint")


#: Measures of a Markdown text by name: the pattern that is counted.
PROFILE = {
    "words": r"\S+", "headings": r"(?m)^#{1,6}\s+\S", "table_rows": r"(?m)^\s*\|.*\|\s*$", "images": r"!\[[^\]]*\]\([^)]*\)", "links": r"\[[^\]]+\]\([^)]+\)",
    "comments": r"\[comment[^\]]*\]", "bookmarks": r"\[bookmark[^\]]*\]", "formulas": r"\(=[^)]+\)",
}


def profile(text: Column | str) -> list[Column]:
    """The measures of PROFILE, lines and distinct tokens of a text."""
    text = col(text)
    tokens = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), 0))
    return [*(count_of(text, p).alias(k) for k, p in PROFILE.items()), F.size(lines(text)).cast("bigint").alias("lines"), F.size(tokens).cast("bigint").alias("unique_tokens")]


def bigrams(text: Column | str) -> Column:
    """The distinct pairs of neighbouring characters."""
    text = col(text)
    return F.when(F.length(text) > 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: F.substring(text, i, F.lit(2))))).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column, both_empty: float = 1.0) -> Column:
    """Shared of all members of two arrays without repeats."""
    every = F.size(F.array_union(a, b))
    return F.when(every == 0, F.lit(both_empty)).otherwise(F.size(F.array_intersect(a, b)) / every)


_GREEK = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi pi rho sigma tau upsilon phi chi psi omega".split()
_FUNCTIONS = "sum int prod lim sin cos tan log ln exp".split()
_WORDS = {"times": "times", "pm": "pm", "inf": "infty", "cdot": "cdot", "approx": "approx", "leq": "leq", "geq": "geq", "neq": "neq"}
#: Names become commands: letters of the Greek alphabet in both cases, functions, operators; then signs, roots and fractions.
LATEX_STEPS = [
    (rf"(?<![\\a-zA-Z])({'|'.join([*_GREEK, *(g.title() for g in _GREEK), *_FUNCTIONS])})(?![a-zA-Z])", r"\\$1"), *((rf"(?<![\\a-zA-Z]){k}(?![a-zA-Z])", rf"\\{v}") for k, v in _WORDS.items()),
    ("<=", r"\\leq "), (">=", r"\\geq "), ("!=", r"\\neq "), (r"(?<![\\a-zA-Z])sqrt\s*\{([^}]*)\}", r"\\sqrt{$1}"), (r"(?<![\\a-zA-Z])sqrt\s+(\w+)", r"\\sqrt{$1}"),
    (r"\{([^{}]*)\}\s*over\s*\{([^{}]*)\}", r"\\frac{$1}{$2}"), (r"(\S+)\s+over\s+(\S+)", r"\\frac{$1}{$2}"),
]


def latex(script: Column | str) -> Column:
    """An equation script of word processors as LaTeX."""
    out = col(script)
    for pattern, new in LATEX_STEPS:
        out = F.regexp_replace(out, pattern, new)
    return F.trim(F.regexp_replace(out, r"\s+", " "))
