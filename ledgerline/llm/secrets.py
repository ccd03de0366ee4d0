"""Secret scans: an Aho-Corasick keyword prefilter, anchored expressions at its hits, checksum validation.

One pass of the automaton over a text finds every keyword; expressions are only ever tried at those hits. The
hex kind has no keyword: its prefilter is one search for a long enough run. Kinds beyond the base
ones are reported only if they are valid: the checksum of GitHub and npm tokens must be right; JSON web tokens and private keys hold no
checksum, so their structure must decode.

Every character is tried a bounded number of times, whatever the text: a kind whose expression runs over a stretch of its own characters
is not tried again inside a stretch in which it has failed, and a key's body ends at the next five hyphens. So a text takes
time in proportion to its length.

Cases: null and empty texts have no spans; keywords in either case count where the kind says so; overlapping
spans of different kinds are all reported; repeated rows are scanned one by one. Other columns are ignored.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib
from collections.abc import Callable, Iterator
from functools import cache
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import text_slices

#: The digits of base 62 in the order that prefixed tokens use for their checksums.
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def crc_suffix(token: str, prefix: int) -> bool:
    """Whether the last six characters are the base-62 CRC-32 of what lies between them and the prefix."""
    value, digits = zlib.crc32(token[prefix:-6].encode()), ""
    while value:
        value, digit = divmod(value, 62)
        digits = BASE62[digit] + digits
    return digits.rjust(6, "0") == token[-6:]


def _decoded(part: str) -> bytes:
    return base64.urlsafe_b64decode(part + "=" * (-len(part) % 4))


def web_token(token: str) -> bool:
    """Whether the first two parts are JSON objects in base64url and the first names an algorithm."""
    try:
        head, body, _ = token.split(".")
        return "alg" in json.loads(_decoded(head)) and isinstance(json.loads(_decoded(body)), dict)
    except (ValueError, TypeError, RecursionError):
        return False


def key_block(block: str) -> bool:
    """Whether the body of a private-key block decodes, up to header lines, to DER or to an OpenSSH key."""
    lines = [x.strip() for x in block.split("\n")[1:-1]]
    body = "".join(x for x in lines if x and ":" not in x)
    try:
        raw = base64.b64decode(body, validate=True)
    except (binascii.Error, ValueError):
        return False
    return raw[:1] == b"\x30" or raw.startswith(b"openssh-key-v1\0")


class Kind(NamedTuple):
    name: str
    keywords: tuple[str, ...]
    pattern: str
    valid: Callable[[re.Match], bool]
    base: bool = False
    any_case: bool = False
    stretch: str = ""  # what a hit that fails runs over; other hits in there fail too


#: Kinds in the order in which equal starts are listed.
KINDS = (
    Kind("assign", ("password", "passwd", "secret", "token", "apikey", "api_key"), r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 12, base=True, any_case=True),
    Kind("access", ("AKIA",), r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18, base=True),
    Kind("hex", (), r"[0-9a-f]{16,}", lambda m: True, base=True),
    Kind("github", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])", lambda m: crc_suffix(m[0], 4)),
    Kind("npm", ("npm_",), r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])", lambda m: crc_suffix(m[0], 4)),
    Kind("jwt", ("eyJ",), r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", lambda m: web_token(m[0]), stretch=r"[A-Za-z0-9_-]+"),
    Kind("pem", ("-----BEGIN ",), r"-----BEGIN ([A-Z ]*)PRIVATE KEY-----\r?\n(?:[A-Za-z0-9+/=\s:,.]++|-(?!----))++-----END \1PRIVATE KEY-----", lambda m: key_block(m[0])),
)


@cache
def _scanner() -> tuple[ahocorasick.Automaton, list[re.Pattern], list[re.Pattern | None]]:
    automaton, at = ahocorasick.Automaton(), {}
    for k, kind in enumerate(KINDS):
        for word in kind.keywords:
            at.setdefault(word.lower(), []).append(k)
    for word, kinds in at.items():
        automaton.add_word(word, (len(word), kinds))
    automaton.make_automaton()
    compiled = [re.compile(x.pattern, re.ASCII | (re.IGNORECASE if x.any_case else 0)) for x in KINDS]
    return automaton, compiled, [re.compile(x.stretch, re.ASCII) if x.stretch else None for x in KINDS]


def scan(text: str | None) -> list[tuple[int, int, int]]:
    """(start, end, kind's position in KINDS) of all secrets, ordered; code points, end exclusive."""
    if not text:
        return []
    automaton, patterns, stretches = _scanner()
    found: list[tuple[int, int, int]] = []
    raw = text.encode("utf-8", "surrogatepass")
    folded = raw.lower().decode("latin-1")  # one character a byte; only A-Z change
    starts: dict[int, list[int]] = {}
    for last, (size, kinds) in automaton.iter(folded):
        for k in kinds:
            starts.setdefault(k, []).append(last + 1 - size)
    ascii_only = len(raw) == len(text)
    for k, places in starts.items():
        free = byte = start = 0
        for place in sorted(set(places)):
            start = place if ascii_only else start + len(raw[byte:place].decode("utf-8", "surrogatepass"))
            byte = place
            if start < free:
                continue
            if m := patterns[k].match(text, start):
                free = m.end()
                if KINDS[k].valid(m):
                    found.append((m.start(), m.end(), k))
            elif stretches[k]:
                free = stretches[k].match(text, start).end()
    for k, kind in enumerate(KINDS):
        if not kind.keywords:
            found += [(m.start(), m.end(), k) for m in patterns[k].finditer(text) if kind.valid(m)]
    return sorted(found, key=lambda x: (x[0], x[2]))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k].name}:{start}:{end}" for start, end, k in spans)


def redacted(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    """text with the outermost runs of overlapping spans replaced by the kind that begins each."""
    if not spans:
        return text
    out, at, end = [], 0, 0
    for start, stop, k in spans:
        if start < end:
            end = max(end, stop)
            continue
        out += [text[max(at, end) : start], f"<{KINDS[k].name}>"]
        at = end = stop
    return "".join(out) + text[max(at, end) :]


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans): one row for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            found = [scan(x) for x in part.column(1).to_pylist()]
            counts = [pa.array([sum(k == want for *_, k in x) for x in found], pa.int64()) for want in range(3)]
            base = [hashlib.sha256(joined([s for s in x if KINDS[s[2]].base]).encode()).hexdigest() for x in found]
            yield pa.RecordBatch.from_arrays([part.column(0), *counts, pa.array(base), pa.array([joined(x) for x in found])], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """docs with each secret replaced by its kind in angle brackets; chars_col, if there, follows the new text."""

    names, schema = docs.columns, docs.schema
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            texts = part.column(at).to_pylist()
            new = [redacted(x, scan(x)) for x in texts]
            columns = part.columns
            columns[at] = pa.array(new, part.schema.field(at).type)
            if chars_col in names:
                i = names.index(chars_col)
                old = part.column(i).to_pylist()
                columns[i] = pa.array([o if a == b or b is None else len(b) for o, a, b in zip(old, texts, new)], part.schema.field(i).type)
            yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return docs.mapInArrow(run, schema)


def op6_secrets(spark, sf_dir: str) -> DataFrame:
    return secret_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
