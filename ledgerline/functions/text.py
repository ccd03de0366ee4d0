"""Text normalization. Column functions unless named a UDF; patterns spell their classes out, as dialects differ."""

from __future__ import annotations

import re
import unicodedata
from difflib import SequenceMatcher
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Typographic characters and what they are folded to (the zero-width space goes).
FOLD_FROM = "‘’“”–— ​"
FOLD_TO = "''\"\"-- "
#: Invisible characters of HTML mail; the first becomes a space.
INVISIBLE = " ​‌‍﻿­"
#: Legal forms at the end of company names.
LEGAL_SUFFIXES = "ab ag aps as bv co company corp corporation gmbh inc incorporated kk limited llc llp lp ltd nv oy oyj pbc plc pty sa sarl sas spa srl".split()
#: Level words dropped from roles.
SENIORITY = "assoc associate entry i ii iii iv junior lead level mid principal senior staff v 1 2 3 4 5".split()
#: Abbreviations in roles.
ROLE_WORDS = {
    "dev": "developer", "devops": "development operations", "em": "engineering manager", "eng": "engineer", "engr": "engineer", "mgr": "manager",
    "ml": "machine learning", "mle": "machine learning engineer", "ops": "operations", "pm": "product manager", "qa": "quality assurance",
    "sde": "software development engineer", "sr": "senior", "sre": "site reliability engineer", "swe": "software engineer", "ui": "user interface", "ux": "user experience",
}
#: The same for linking, where two differ.
LINK_WORDS = {"swe": "software engineer", "sde": "software engineer", "mle": "machine learning engineer", "ml": "machine learning", "eng": "engineer", "engr": "engineer", "dev": "developer", "mgr": "manager", "pm": "product manager", "sr": "senior"}
#: Words that tell nothing about a role when linking, besides numbers of one or two digits.
LINK_NOISE = "senior sr junior jr staff principal lead mid entry level i ii iii iv v intern internship fulltime parttime contract remote hybrid onsite".split()

#: What numbers a vacancy: a run of letters, digits, _ and - with a digit in it; and the words before such a number.
_MARK = r"[A-Za-z_-]*[0-9][A-Za-z0-9_-]*"
_LABEL = r"(?:job|requisition|req)(?:\s+(?:number|id|no))?\s*[:#-]?\s*"
#: Numbers of vacancies glued to a title: labelled or bare in brackets, labelled, behind a hash, or a code of few letters and many digits.
REQUISITION = re.compile("|".join([rf"[(\[]\s*(?:{_LABEL}|#\s*)?{_MARK}\s*[)\]]", rf"\b{_LABEL}{_MARK}", rf"#\s*{_MARK}", r"\b[A-Za-z]{1,4}[0-9]{4,}\b"]), re.IGNORECASE)


def let(value: Column, body) -> Column:
    """body(value), with value computed once: expressions that repeat their argument grow without bounds when nested."""
    return F.element_at(F.transform(F.array(value), body), 1)


def one_of(value: Column, words: list[str]) -> Column:
    """Whether value is one of a few words; they are one constant, which is much quicker to build into a plan than a list of literals."""
    return F.array_contains(F.split(F.lit("\n".join(words)), "\n"), value)


_CASED = [c for c in map(chr, range(0x80, 0x10000)) if len(c.casefold()) == 1 and c.casefold() != c.lower()]


def casefold(text: Column) -> Column:
    """Lower case with what full case folding adds for single characters, and ss for the sharp s."""
    return F.replace(F.translate(F.lower(text), "".join(c.lower() for c in _CASED if len(c.lower()) == 1), "".join(c.casefold() for c in _CASED if len(c.lower()) == 1)), F.lit("ß"), F.lit("ss"))


def normalize_text(text: Column) -> Column:
    """Typographic characters folded, case folded, blanks collapsed, ends trimmed. A text of ASCII alone needs no table of characters."""
    other = lambda t: F.regexp_replace(casefold(F.translate(t, FOLD_FROM, FOLD_TO)), "(?U)\\s+", " ")
    return F.trim(let(text, lambda t: F.when(t.rlike("[^\\x00-\\x7F]"), other(t)).otherwise(F.regexp_replace(F.lower(t), "\\s+", " "))))


def collapse_whitespace(text: Column) -> Column:
    """Line ends unified, invisible characters gone, lines stripped, at most one blank line between paragraphs."""
    x = F.translate(F.regexp_replace(text, "\r\n?", "\n"), INVISIBLE, " ")
    x = F.regexp_replace(x, "(?U)[^\\S\n]+", " ")
    x = F.regexp_replace(F.regexp_replace(x, " ?\n ?", "\n"), "\n{3,}", "\n\n")
    return F.regexp_replace(x, "^[ \n]+|[ \n]+$", "")


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits of a text that is free of accents; & counts as the word and."""
    spaced = F.trim(F.regexp_replace(F.replace(F.lower(text), F.lit("&"), F.lit(" and ")), "[^0-9a-z]+", " "))
    return F.filter(F.split(spaced, " "), lambda x: x != "")


def _plain(x: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", x) if unicodedata.category(c) != "Mn")


_ACCENTED = [c for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]) if len(_plain(c)) == 1 and _plain(c) != c]
_MARKS = [c for c in map(chr, range(0x300, 0x370)) if unicodedata.category(c) == "Mn"]


def fold_accents(text: Column) -> Column:
    """Lower case without accents, for Latin letters and combining marks; strip_accents does so for every script."""
    plain = F.translate(text, "".join(_ACCENTED + _MARKS), "".join(map(_plain, _ACCENTED)))
    return F.lower(F.replace(plain, F.lit("ß"), F.lit("ss")))


@F.pandas_udf(T.StringType())
def strip_accents(texts: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks, and full case folding."""

    return texts.map(lambda x: None if x is None else _plain(x).casefold())


def _without_the(words: Column) -> Column:
    return F.when((F.size(words) > 1) & (F.get(words, 0) == "the"), F.slice(words, 2, F.size(words))).otherwise(words)


def company_key(text: Column) -> Column:
    """Matching key of a company name: no leading article, no trailing legal forms, at least one token; null for none.

    Expects a text free of accents (see fold_accents).
    """
    spaced = F.array_join(let(tokens(text), _without_the), " ")
    return F.nullif(F.regexp_replace(spaced, f"(?<=[0-9a-z])(?: (?:{'|'.join(LEGAL_SUFFIXES)}))+$", ""), F.lit(""))


def _expanded(words: Column, table: dict[str, str]) -> Column:
    return F.flatten(F.transform(words, lambda x: F.split(_lookup(table, x), " ")))


def _lookup(table: dict[str, str], x: Column) -> Column:
    found = x
    for k, v in table.items():
        found = F.when(x == k, v).otherwise(found)
    return found


def role_tokens(text: Column) -> Column:
    """Tokens of a role without requisition ids and seniority (unless nothing else is left), abbreviations written out."""
    bare = F.regexp_replace(text, f"(?i){REQUISITION.pattern}", " ")
    graded = lambda words: let(F.filter(words, lambda x: ~one_of(x, SENIORITY)), lambda kept: F.when(F.size(kept) > 0, kept).otherwise(words))
    return let(let(_expanded(tokens(bare), ROLE_WORDS), graded), _without_the)


def role_key(text: Column) -> Column:
    return F.nullif(F.array_join(role_tokens(text), " "), F.lit(""))


def link_tokens(title: Column) -> Column:
    """The bag of words by which linking compares two titles; empty for null."""
    joined = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), "[^a-z0-9]+", " "), "\\b(full|part) time\\b", "$1time")
    words = _expanded(F.filter(F.split(joined, " "), lambda x: x != ""), LINK_WORDS)
    return F.array_distinct(F.filter(words, lambda x: ~one_of(x, LINK_NOISE) & ~x.rlike("^[0-9]{1,2}$")))


def dice(a: Column, b: Column) -> Column:
    """Dice coefficient of two arrays of distinct words; 0 if either is empty."""
    share = lambda p: F.coalesce(F.try_divide(2.0 * F.size(F.array_intersect(p["a"], p["b"])), F.size(p["a"]) + F.size(p["b"])), F.lit(0.0))
    return let(F.struct(a.alias("a"), b.alias("b")), share)


def jaccard(a: Column, b: Column) -> Column:
    share = lambda p: F.coalesce(F.try_divide(F.size(F.array_intersect(p["a"], p["b"])), F.size(F.array_union(p["a"], p["b"]))), F.lit(0.0)).cast("double")
    return let(F.struct(a.alias("a"), b.alias("b")), share)


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching characters in the longest matching blocks (frequent characters of long texts don't count, as the standard
    library has it); 0 if either is null."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in zip(a, b)], dtype=float)


def role_similarity(a: Column, b: Column) -> Column:
    """Mean of Jaccard and character ratio of two normalized roles, to four decimals."""
    words = jaccard(F.array_distinct(role_tokens(a)), F.array_distinct(role_tokens(b)))
    return F.bround((words + sequence_ratio(role_key(a), role_key(b))) / 2, 4)


#: Words with which models say that a field has no value.
NULLISH = ["", "null", "none", "n/a", "na", "unknown", "not specified", "not provided", "-"]


def clean_value(text: Column) -> Column:
    """Blanks collapsed and edge punctuation stripped; null for words that mean no value."""
    x = F.btrim(F.regexp_replace(text, "(?U)\\s+", " "), F.lit(" ,;:-"))
    return let(x, lambda v: F.when(~one_of(F.lower(v), NULLISH), v))


#: Elements without prose, elements that end a line, and cells, which add a space.
DROPPED = {"script", "style", "head", "title", "noscript", "template"}
BLOCKS = set("address article aside blockquote br div footer h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tr ul".split())
CELLS = {"td", "th"}


class _Prose(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden: list[str] = []

    def _edge(self, tag: str) -> None:
        if tag in BLOCKS:
            self.out.append("\n")
        elif tag in CELLS:
            self.out.append(" ")

    def handle_starttag(self, tag, attrs):
        if tag in DROPPED:
            self.hidden.append(tag)
        elif tag == "body":
            self.hidden.clear()  # an unclosed head ends here
        self._edge(tag)

    def handle_endtag(self, tag):
        if tag in self.hidden:
            del self.hidden[self.hidden.index(tag) :]
        self._edge(tag)

    def handle_startendtag(self, tag, attrs):
        self._edge(tag)

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


def prose(html: str | None) -> str | None:
    if html is None:
        return None
    parser = _Prose()
    parser.feed(html)
    parser.close()
    return "".join(parser.out)


@F.pandas_udf(T.StringType())
def _prose_udf(pages: pd.Series) -> pd.Series:
    return pages.map(prose)


def html_to_text(html: Column) -> Column:
    """Text of an HTML page or mail part: no scripts and styles, lines at block elements, entities decoded once."""
    return collapse_whitespace(_prose_udf(html))
