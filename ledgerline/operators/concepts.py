"""Texts as strings of concepts.

A text is read once: each of its words becomes one character, that of the concept it belongs to, or a dot; the end of a sentence becomes a bar. A rule
is then a short expression over that string, a sixth as long as the text and made of few letters: some concepts in a row within a
sentence, with no more than so many words between two of them. What a word means is said here, what a rule wants to hear in rules.py.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word, a number or the end of a sentence, in a normalized text.
TOKEN = "[\\p{L}\\p{N}](?:[\\p{L}\\p{N}'-]*[\\p{L}\\p{N}])?|[.!?]"
STOP, OTHER, NUMBER = "|", ".", "#"


def forms(*verbs: str) -> str:
    """The regular forms of verbs: -s, -ed, -ing."""
    out = []
    for v in verbs:
        stem = v[:-1] if v.endswith("e") else v
        out += [v, f"{v}s", f"{stem}ed", f"{stem}ing"]
    return " ".join(out)


#: The words of each concept; a word has one concept.
CONCEPTS: dict[str, str] = {
    "apply": "apply applied applying",
    "application": "application applications candidacy",
    "withdraw": "withdraw withdrawal withdrawing",
    "withdrawn": "withdrew withdrawn",
    "request": forms("request"),
    "per": "as at per upon",
    "not": "not never unable cannot can't won't isn't aren't wasn't weren't hasn't haven't didn't",
    "no": "no",
    "longer": "longer",
    "go": forms("advance", "continue", "move", "proceed", "progress") + " go going",
    "onward": "ahead forward forwards further onward",
    "pursue": forms("pursue") + " hire hired hires",
    "with": "with",
    "next": "next following",
    "decided": "decided elected opted resolved",
    "chosen": "chosen picked selected shortlisted",
    "other": "another other others",
    "person": "applicant applicants candidate candidates",
    "regret": "unfortunately regret regrettably sadly",
    "failed": "unsuccessful",
    "success": "successful",
    "job": "job opening position post role vacancy",
    "closed": "closed filled",
    "keep": "hold keep retain store",
    "paper": "background cv details experience github linkedin portfolio profile resume",
    "file": "file record",
    "wish": "wish wishing",
    "best": "best luck",
    "consider": "consider considered considering consideration",
    "match": "fit match",
    "offer": "offer",
    "give": forms("extend", "present"),
    "glad": "delighted excited glad happy pleased thrilled",
    "work": "employment",
    "pay": "compensation salary",
    "package": "package",
    "letter": "letter",
    "begin": "start starting joining",
    "date": "date day",
    "planned": "anticipated expected planned proposed tentative",
    "interview": forms("interview"),
    "invite": "invitation invite invited inviting",
    "plan": "arrange arranging book booking schedule scheduling",
    "settled": "booked confirmation confirmed scheduled set",
    "talk": "call chat conversation meeting",
    "speak": "meet speak",
    "screen": "screen screening",
    "phone": "initial phone telephone",
    "recruiter": "headhunter recruiter sourcer",
    "talent": "talent",
    "partner": "partner",
    "onsite": "onsite on-site",
    "virtual": "virtual",
    "final": "final last",
    "round": "round",
    "steps": "step steps",
    "pick": "choose find grab pick reserve select",
    "time": "slot slots time times timeslot",
    "free": "availability available",
    "tell": "give know provide reply send share",
    "link": "calendar link scheduler",
    "crew": "engineer engineers manager managers team",
    "skill": "coding online programming skill skills technical",
    "test": "assessment challenge exercise test",
    "takehome": "take-home takehome",
    "take": "take",
    "home": "home",
    "finish": "complete completing finish",
    # fixed values: makers of assessments
    "maker": "codesignal coderpad codility hackerrank karat woven",
    "unit": "days hours minutes",
    "thanks": "appreciate thank thanks thankyou",
    "interest": "interest",
    "have": "has have had",
    "we": "we",
    "we have": "we've",
    "we are": "we're",
    "are": "are",
    "you": "you",
    "you have": "you've you'll",
    "your": "your",
    "got": "got received",
    "sent": "sent submitted",
    "review": "review reviewing",
    "it": "it",
    "attract": "career exciting great new",
    "chance": "opportunities opportunity",
    "reaching": "reaching",
    "out": "out",
    "found": "came come found noticed saw stumbled",
    "i": "i",
    "i am": "i'm",
    "am": "am",
    "hiring": "hiring",
    "would": "would",
    "open": "interested open",
    "to": "in to",
}
CODE = {name: chr(0x100 + i) for i, name in enumerate(CONCEPTS)}
CODE_OF = {word: CODE[name] for name, words in CONCEPTS.items() for word in words.split()} | {x: STOP for x in ".!?"}


def heard(*sayings: str) -> str:
    """The expression for any of sayings: concepts (``a/b`` is either, with _ for the blank in a name), parted by the most words that may lie between."""
    return "|".join(_heard(x) for x in sayings)


def _heard(saying: str) -> str:
    out = ""
    for step in saying.split(" "):
        if step.isdigit():
            out += f"[^{re.escape(STOP)}]{{0,{step}}}" if int(step) else ""
        else:
            codes = "".join(NUMBER if x == "number" else CODE[x.replace("_", " ")] for x in step.split("/"))
            out += codes if len(codes) == 1 else f"[{codes}]"
    return out


def encoded(texts: Column) -> Column:
    """The concepts of each of an array of normalized texts, a character for each word."""
    table = F.str_to_map(F.lit(" ".join(f"{w}={c}" for w, c in CODE_OF.items())), F.lit(" "), F.lit("="))
    known = list(CODE_OF)
    code = lambda t: F.when(t.isin(known), F.element_at(table, t)).when((t >= "0") & (t < ":"), NUMBER).otherwise(OTHER)
    return F.transform(texts, lambda text: F.array_join(F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), code), ""))
