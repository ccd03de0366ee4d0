"""Whole-text encoding with the tokenizers library, with a bounded memo of the stretches between spaces.

The two layouts below never join characters across a space, so a text's ids are the ids of its stretches
in turn. Tokenizers of any other layout encode each text as it is.

Strings of special tokens in a text are ordinary text (encode_special_tokens), as the tokenizers' own README has it: a document
that holds "<|endoftext|>" gets the ids of its characters and no end id inside.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of stretches, their ids and their entries that one Python worker remembers, about.
MEMO_BYTES = 64 << 20
ENTRY_BYTES = 160
#: Bytes of text that are encoded at a time; a longer text is encoded alone.
SLICE_BYTES = 8 << 20
#: Stretches that are encoded in one call, and punctuation that is told apart from the letters before it.
JOINED = 1024
TAILS = ".,"

_LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")
_known: dict[int, Encoder] = {}


def read_tokenizer(path: str) -> str:
    """The tokenizer file's text, to be sent to the executors (a few MB whatever the input)."""
    return Path(path).read_text(encoding="utf-8")


def encoder(spec: str) -> Encoder:
    """The worker's encoder for a tokenizer file's text; its memo lives as long as the worker, within MEMO_BYTES."""
    key = zlib.crc32(spec.encode())
    if key not in _known:
        _known.clear()
        _known[key] = Encoder(spec)
    return _known[key]


def layout(spec: dict) -> str:
    """'spaced': a lone space opens a stretch and belongs to it; 'dropped': blanks only part stretches; 'whole'."""
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None:
        return "spaced"
    steps = pre.get("pretokenizers") or [{}]
    norms = (norm or {}).get("normalizers") or []
    first = steps[0]
    drops = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert")
    plain = all(x["type"] in ("NFC", "Lowercase") or x["type"] == "Replace" and x["pattern"] == {"Regex": "\\s+"} for x in norms)
    no_blanks = "\\s" not in str(first.get("pattern")).replace("[^\\\\s", "").replace("[^\\s", "") and " " not in str((first.get("pattern") or {}).get("Regex", " "))
    return "dropped" if drops and plain and no_blanks else "whole"


class Encoder:
    def __init__(self, spec: str, memo_bytes: int = MEMO_BYTES):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.encode_special_tokens = True
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.layout = layout(json.loads(spec))
        self.memo_bytes, self.memo_held = memo_bytes, 0
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.edge = np.zeros(max(vocab.values()) + 1, bool)
        if self.layout == "spaced":
            self.edge[[i for x, i in vocab.items() if x.startswith("Ġ")]] = True
        elif self.layout == "dropped":
            self.edge[[i for x, i in vocab.items() if x.endswith("</w>")]] = True
        self.memo: dict[str, bytes] = {}
        self.tails = dict(zip(TAILS, self._whole(list(TAILS))))

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype=self.dtype).tobytes() for x in found]

    def _ids(self, stretches: list[str]) -> list[bytes]:
        """The ids of each stretch. Where it is told which ids open or end a stretch, many are encoded in one call."""
        if self.layout == "spaced":
            return self._jointly([" " + x for x in stretches], "", opens=True)
        # letters alone are one word; a full stop or comma behind them is another
        cores = {x: x[:-1] if x[-1:] in TAILS else x for x in stretches if x and x not in TAILS}
        cores = {x: c for x, c in cores.items() if c.isalpha() and "\u0130" not in c}
        known = {c: self.memo.get(c) for c in cores.values()}
        new = [c for c, ids in known.items() if ids is None]
        known.update(zip(new, self._jointly(new, " ", opens=False)))
        odd = [x for x in stretches if x not in cores]
        found = dict(zip(odd, self._whole(odd)))
        for x, c in cores.items():
            found[x] = known[c] if x is c or x == c else known[c] + self.tails[x[-1]]
        return [found[x] for x in stretches]

    def _jointly(self, stretches: list[str], space: str, opens: bool) -> list[bytes]:
        """The ids of stretches that each open (or end) with the one edge id in them."""
        out: list[bytes] = []
        for at in range(0, len(stretches), JOINED):
            part = stretches[at : at + JOINED]
            ids = np.array(self.tokenizer.encode_batch_fast([space.join(part)], add_special_tokens=False)[0].ids, dtype=self.dtype)
            edges = np.flatnonzero(self.edge[ids])
            if len(edges) != len(part):
                out += self._whole(part)
                continue
            cuts = np.append(edges, len(ids)) if opens else np.append(0, edges + 1)
            raw, size = ids.tobytes(), self.dtype.itemsize
            out += [raw[a:b] for a, b in zip((cuts[:-1] * size).tolist(), (cuts[1:] * size).tolist())]
        return out

    def _remembered(self, stretches: list[str], sound: list[bool]) -> list[bytes]:
        """The ids of each stretch, those that aren't sound left empty; new ones are remembered while there is room."""
        found = list(map(self.memo.get, stretches))
        new = [x for x, ids, ok in zip(stretches, found, sound) if ids is None and ok]
        fresh = dict(zip(new, self._ids(new)))
        if self.memo_held < self.memo_bytes:
            self.memo.update(fresh)
            self.memo_held += sum(len(x) + len(ids) + ENTRY_BYTES for x, ids in fresh.items())
        return [fresh.get(x, b"") if ids is None else ids for x, ids in zip(stretches, found)]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text (none null), without special tokens.

        Stretches are numbered column-wise, each distinct one is looked up once, and the ids are gathered by number.
        """
        if not len(texts):
            return []
        if self.layout == "whole":
            return [np.frombuffer(x, self.dtype) for x in self._whole(texts.to_pylist())]
        spaced = self.layout == "spaced"
        parts = pc.split_pattern(texts if spaced else pc.replace_substring(texts, "\n", " "), " ")
        bounds = parts.offsets.to_numpy().astype(np.int64)
        bounds -= bounds[0]
        words = parts.flatten()
        coded = words.dictionary_encode()
        number, known = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
        sound = list(map(_parts_well, known)) if spaced else [True] * len(known)
        ids = self._remembered(known, sound)
        alone: dict[int, bytes] = {}
        if spaced:  # the first stretch has no space before it; spaces beside other blanks open no stretch
            heads = words.take(pa.array(bounds[:-1])).to_pylist()
            odd = ~np.array(sound)[number]
            odd[bounds[:-1]] = [not _parts_well(x) for x in heads]
            alone = {int(i): self._by_lone_spaces(texts[int(i)].as_py()) for i in np.flatnonzero(np.logical_or.reduceat(odd, bounds[:-1]))}
            number[bounds[:-1]] = len(known) + np.arange(len(heads))
            ids += self._whole(heads)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // self.dtype.itemsize
        flat, begins = np.frombuffer(b"".join(ids), self.dtype), np.cumsum(sizes) - sizes
        each = sizes[number]
        ends = np.cumsum(each)
        small = np.int32 if max(ends[-1], len(flat)) < 1 << 31 else np.int64
        out = flat[np.repeat((begins[number] - (ends - each)).astype(small), each) + np.arange(ends[-1], dtype=small)]
        cuts = np.append(0, ends[bounds[1:] - 1])
        return [np.frombuffer(alone[i], self.dtype) if i in alone else out[a:b] for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist()))]

    def _by_lone_spaces(self, text: str) -> bytes:
        head, *rest = _LONE_SPACE.split(text)
        return b"".join(self._whole([head, *[" " + x for x in rest]]))


def _parts_well(stretch: str) -> bool:
    """Whether spaces beside the stretch are lone ones: it is not empty and has no blanks at its ends."""
    return stretch != "" and not stretch[0].isspace() and not stretch[-1].isspace()


def text_batches(batches: Iterator[pa.RecordBatch], most_bytes: int = SLICE_BYTES) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(column 0, texts of column 1 with null as empty) in slices of about most_bytes of text, one text at least."""
    for batch in batches:
        texts = pc.fill_null(batch.column(1), "")
        grown = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(grown, (grown[at - 1] if at else 0) + most_bytes, "right")))
            yield batch.column(0).slice(at, end - at), texts.slice(at, end - at)
            at = end


def crc32_of(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())
