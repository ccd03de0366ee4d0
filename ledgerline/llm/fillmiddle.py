"""Fill-in-middle transformation: cuts between tokens found in a run-length encoding of character classes.

A text is cut into units: a stretch of ASCII letters is one, every other character is one. Of a text only its maximal runs of letters and of
other characters are kept, each with the character that it begins at and the units before it. The run of a cut is found by binary search
over those counts; inside a run of letters there is no cut, inside another run every unit is a character, so the cut's place is a sum. No list of
units is made, and a text is encoded a stretch at a time.

Cases: a null text counts as empty; an empty text, and one that holds a marker, stays as it is (plain); a text of one long run has two
places to cut; cuts may coincide, then the middle is empty. Rows are transformed one by one, so repeated rows give equal results. A null id
draws as the word null does. An empty table gives an empty one. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import text_slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts that many are transformed, and of 100 transformed ones that many put the suffix first.
RATE, SUFFIX_FIRST = 90, 20
#: Characters that are encoded at a time.
STRETCH = 1 << 20


class Runs(NamedTuple):
    """Maximal runs of one class: first characters and units before them, each with the text's end behind."""

    starts: np.ndarray
    units: np.ndarray
    letters_first: bool


def encode(text: str) -> Runs:
    """The runs of text; runs of letters and of other characters alternate."""
    starts, first, last = [], False, None
    for at in range(0, len(text), STRETCH):
        codes = np.frombuffer(text[at : at + STRETCH].encode("utf-32-le", "surrogatepass"), "<u4")
        letter = ((codes | 32) - np.uint32(97)) < 26
        turns = np.flatnonzero(letter[1:] != letter[:-1]) + 1
        if last is None:
            first = bool(letter[0])
        if last is None or last != letter[0]:
            turns = np.concatenate([[0], turns])
        starts.append(turns + at)
        last = letter[-1]
    starts = np.concatenate([*starts, [len(text)]]).astype(np.int64)
    lengths = np.diff(starts)
    lengths[0 if first else 1 :: 2] = 1  # a run of letters is one unit
    return Runs(starts, np.concatenate([[0], np.cumsum(lengths)]), first)


def offset(runs: Runs, unit: int) -> int:
    """The character before which unit (the text's end for their number) begins."""
    run = int(np.searchsorted(runs.units, unit, "right")) - 1
    return int(runs.starts[run]) + unit - int(runs.units[run])  # the difference is 0 in a run of letters


def draws(doc_id: int | None, seed: int) -> tuple[int, int, int, int]:
    """Four numbers below 2^32 that hang on the id and the seed alone."""
    digest = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))


class Cut(NamedTuple):
    n: int
    form: str
    prefix: int | None
    middle: int | None
    output: str


def transform(doc_id: int | None, text: str, seed: int, rate: int, suffix_first: int) -> Cut:
    runs = encode(text)
    n = int(runs.units[-1])
    first, second, form, order = draws(doc_id, seed)
    if not text or form % 100 >= rate or any(x in text for x in (PREFIX, SUFFIX, MIDDLE)):
        return Cut(n, "plain", None, None, text)
    a, b = (offset(runs, x) for x in sorted((first % (n + 1), second % (n + 1))))
    if order % 100 < suffix_first:
        return Cut(n, "spm", a, b - a, f"{SUFFIX}{text[b:]}{PREFIX}{text[:a]}{MIDDLE}{text[a:b]}")
    return Cut(n, "psm", a, b - a, f"{PREFIX}{text[:a]}{SUFFIX}{text[b:]}{MIDDLE}{text[a:b]}")


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): one row for each row of docs; output is the text to train on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, 64):
            cuts = [transform(i, x or "", seed, rate, suffix_first) for i, x in zip(part.column(0).to_pylist(), part.column(1).to_pylist())]
            fields = zip(Cut._fields, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()))
            yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array([getattr(c, name) for c in cuts], kind) for name, kind in fields]], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of; a transformed one holds each marker once, as texts with markers stay plain."""
    part = F.split(output, "|".join((PREFIX, SUFFIX, MIDDLE)), -1)
    return F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output)


def op11_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    rows = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


SQL = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || doc_id) AS h FROM documents),
  u AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS x, [('0x' || substr(h, 1 + 8 * i, 8))::BIGINT FOR i IN range(4)] AS h FROM d),
  f AS (SELECT *, len(x) AS n, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
    least(h[1] % (len(x) + 1), h[2] % (len(x) + 1)) AS a, greatest(h[1] % (len(x) + 1), h[2] % (len(x) + 1)) AS b FROM u),
  p AS (SELECT doc_id, t, n, form, array_to_string(x[1:a], '') AS p, array_to_string(x[a + 1:b], '') AS m, array_to_string(x[b + 1:n], '') AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""
