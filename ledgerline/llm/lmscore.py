"""Language-model scores from a subword lattice.

The model is a unigram model over the pieces of an existing vocabulary. The vocabulary file's own scores are merge
ranks and no probabilities: they give the first guess, a piece of rank r having a probability in proportion to 1 / (r + 2). ROUNDS rounds of
expectation-maximization over all training words then weight every segmentation: a piece's expected count, by a
forward-backward recursion over each word's lattice, add one. A text's probability is the product over its words, and its
end, of the sum over all segmentations of the word into pieces, by a forward recursion in logarithms; characters that no
piece covers go byte by byte.

As a word's probability doesn't depend on its text, the recursion runs once for each distinct word, in a distributed word
table with the training counts. The most frequent words (at most FREQUENT) are sent to the
tasks; a text's other words are joined with the table. Words of one length go through the recursion together, as rows of an array.

Cases: null and empty texts are the end token alone; a null id is trained on; repeated rows count and are scored
one by one; with no training document all counts are zero. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import materialize, text_slices

#: Most words whose counts and probabilities are sent to the tasks.
FREQUENT = 1 << 17
#: Distinct words that a task counts before it hands them on.
HELD_WORDS = 500_000
#: Rounds of expectation-maximization.
ROUNDS = 2
#: Longest words (with their space) that go through the recursion as arrays, and cells of such an array.
ARRAY_CHARS = 40
CELLS = 1 << 20
#: Distinct words that a task scores at a time.
WORDS = 1 << 16
LN10 = math.log(10)
SPACE = "▁"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


class Lattice:
    """Sums over the segmentations of words into pieces with natural-log probabilities; bytes stand for characters without a piece."""

    def __init__(self, pieces: dict[str, float], byte_logs: list[float]):
        self.pieces, self.byte_logs = pieces, byte_logs
        self.longest = max(map(len, pieces), default=1)
        self.names = list(pieces)
        self.logs = np.array([*pieces.values(), -np.inf])  # the last stands for no piece
        keys = np.array([self._hash(x) for x in self.names], np.uint64)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        assert (self.keys[1:] != self.keys[:-1]).all()
        self.seen = np.zeros(1 << 22, bool)
        self.seen[self.keys >> np.uint64(42)] = True

    MULTIPLIER = 0x9E3779B97F4A7C15

    def _hash(self, piece: str) -> int:
        h = 0
        for c in piece:
            h = ((h ^ ord(c)) * self.MULTIPLIER) % (1 << 64)
        return h

    def _char(self, char: str) -> float:
        return sum(self.byte_logs[b] for b in char.encode("utf-8"))

    def _found(self, hashes: np.ndarray) -> np.ndarray:
        """Places in names of the pieces of these hashes; len(names) for none."""
        out = np.full(len(hashes), len(self.names), np.int64)
        some = np.flatnonzero(self.seen[hashes >> np.uint64(42)])
        if len(some):
            at = np.minimum(np.searchsorted(self.keys, hashes[some]), len(self.keys) - 1)
            hit = self.keys[at] == hashes[some]
            out[some[hit]] = self.order[at[hit]]
        return out

    def _arrays(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, list, np.ndarray]:
        """For words of one length: (characters, single-character byte logs, pieces by (start, length), forward sums)."""
        text = "".join([SPACE + w for w in words])
        chars = np.frombuffer(text.encode("utf-32-le"), np.uint32).reshape(len(words), -1)
        length = chars.shape[1]
        found: list[list[np.ndarray]] = []
        for i in range(length):
            h, row = np.zeros(len(words), np.uint64), []
            for m in range(min(self.longest, length - i)):
                h = (h ^ chars[:, i + m].astype(np.uint64)) * np.uint64(self.MULTIPLIER)
                row.append(self._found(h))
            found.append(row)
        none = len(self.names)
        singles = np.stack([row[0] for row in found], axis=1) == none
        spelt = np.full(chars.shape, -np.inf)
        if singles.any():
            kinds, at = np.unique(chars[singles], return_inverse=True)
            spelt[singles] = np.array([self._char(chr(c)) for c in kinds])[at]
        forward = np.full((len(words), length + 1), -np.inf)
        forward[:, 0] = 0
        for j in range(1, length + 1):
            ways = [forward[:, j - m] + self.logs[found[j - m][m - 1]] for m in range(1, min(self.longest, j) + 1)]
            ways.append(forward[:, j - 1] + spelt[:, j - 1])
            forward[:, j] = np.logaddexp.reduce(ways, axis=0)
        return chars, spelt, found, forward

    def _by_length(self, words: list[str]) -> Iterator[tuple[np.ndarray, bool]]:
        """Places of words of one length each, few enough for arrays; and whether they go through arrays."""
        sizes = np.array([len(w) + 1 for w in words])
        for size in np.unique(sizes):
            places = np.flatnonzero(sizes == size)
            step = max(1, CELLS // int(size * min(size, self.longest))) if size <= ARRAY_CHARS else 1
            for at in range(0, len(places), step):
                yield places[at : at + step], bool(size <= ARRAY_CHARS)

    def log10s(self, words: list[str]) -> np.ndarray:
        """The log10 probability of each word."""
        out = np.empty(len(words))
        for places, together in self._by_length(words):
            out[places] = self._arrays([words[i] for i in places])[3][:, -1] / LN10 if together else [self.log10(words[i]) for i in places]
        return out

    def _forward(self, text: str) -> list[float]:
        pieces, exp, log, at = self.pieces, math.exp, math.log, [0.0]
        for j in range(1, len(text) + 1):
            ways = []
            for i in range(max(0, j - self.longest), j):
                p = pieces.get(text[i:j])
                if p is not None:
                    ways.append(at[i] + p)
            if text[j - 1] not in pieces:
                ways.append(at[j - 1] + self._char(text[j - 1]))
            top = max(ways)
            at.append(top + log(sum([exp(x - top) for x in ways])) if len(ways) > 1 else top)
        return at

    def log10(self, word: str) -> float:
        """The forward recursion of one word: at[j] is the log of the sum over all segmentations of the first j characters."""
        return self._forward(SPACE + word)[-1] / LN10

    def expect(self, words: list[str], times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected counts of the pieces, in their order, and of the 256 bytes, over all segmentations of words seen so many times."""
        counts, spelt_counts = np.zeros(len(self.names) + 1), np.zeros(256)
        for places, together in self._by_length(words):
            if not together:
                self._expect_one(words[places[0]], float(times[places[0]]), counts, spelt_counts)
                continue
            chars, spelt, found, forward = self._arrays([words[i] for i in places])
            weight, length = np.asarray(times)[places].astype(float), chars.shape[1]
            backward = np.full((len(places), length + 1), -np.inf)
            backward[:, length] = 0
            for i in range(length - 1, -1, -1):
                ways = [self.logs[x] + backward[:, i + m] for m, x in enumerate(found[i], 1)]
                ways.append(spelt[:, i] + backward[:, i + 1])
                backward[:, i] = np.logaddexp.reduce(ways, axis=0)
                ahead = forward[:, i] - forward[:, length]
                for way, x in zip(ways, found[i]):
                    some = np.flatnonzero(x < len(self.names))
                    if len(some):
                        counts += np.bincount(x[some], weight[some] * np.exp(ahead[some] + way[some]), len(counts))
                for k in np.flatnonzero(spelt[:, i] > -np.inf):
                    for b in chr(chars[k, i]).encode("utf-8"):
                        spelt_counts[b] += weight[k] * math.exp(ahead[k] + ways[-1][k])
        return counts[:-1], spelt_counts

    def _expect_one(self, word: str, weight: float, counts: np.ndarray, spelt_counts: np.ndarray) -> None:
        text = SPACE + word
        forward, place = self._forward(text), {}
        total, n = forward[-1], len(text)
        after = [-math.inf] * n + [0.0]
        for i in range(n - 1, -1, -1):
            ways = [(text[i:j], self.pieces[text[i:j]] + after[j]) for j in range(i + 1, min(n, i + self.longest) + 1) if text[i:j] in self.pieces]
            if text[i] not in self.pieces:
                ways.append((None, self._char(text[i]) + after[i + 1]))
            top = max(x for _, x in ways)
            after[i] = top + math.log(sum(math.exp(x - top) for _, x in ways))
            for piece, x in ways:
                share = weight * math.exp(forward[i] + x - total)
                if piece is None:
                    for b in text[i].encode("utf-8"):
                        spelt_counts[b] += share
                else:
                    place[piece] = place.get(piece, 0.0) + share
        at = self._places()
        for piece, share in place.items():
            counts[at[piece]] += share

    def _places(self) -> dict[str, int]:
        if not hasattr(self, "_at"):
            self._at = {x: i for i, x in enumerate(self.names)}
        return self._at


def split_rows(docs: DataFrame, id_col: str, text_col: str, held_out: Column | None) -> DataFrame:
    key = F.col(id_col).cast("long")
    held = held_out if held_out is not None else F.coalesce(F.crc32(key.cast("string").cast("binary")) % 7 == 2, F.lit(False))
    return docs.select(key.alias("doc_id"), F.col(text_col).cast("string").alias("text"), held.alias("held_out"))


def word_table(rows: DataFrame) -> DataFrame:
    """(word, trained, total): how often each word occurs in training documents and in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trained, held = Counter(), Counter()

        def out():
            keys = list(trained.keys() | held.keys())
            counts = [[trained[k] for k in keys], [trained[k] + held[k] for k in keys]]
            trained.clear()
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()).cast(pa.string()), *(pa.array(x, pa.int64()) for x in counts)], names=["word", "trained", "total"])

        for part in text_slices(batches):
            for text, is_held in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                (held if is_held else trained).update(words_of(text))
                if len(trained) + len(held) > HELD_WORDS:
                    yield out()
        yield out()

    return rows.mapInArrow(run, "word string, trained long, total long").groupBy("word").agg(F.sum("trained").alias("trained"), F.sum("total").alias("total"))


def gathered(batches: Iterator[pa.RecordBatch], rows: int = WORDS) -> Iterator[pa.RecordBatch]:
    """Batches put together to about so many rows, so that there are many words of each length."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) >= rows:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def expected_counts(words: DataFrame, pieces: dict[str, float], byte_logs: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """Expected counts of the pieces and bytes over the training words (a number for each piece of the vocabulary at most)."""
    sent = words.sparkSession.sparkContext.broadcast((pieces, byte_logs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, total = Lattice(*sent.value), 0
        for part in gathered(batches):
            total = total + np.concatenate(lattice.expect(part.column(0).to_pylist(), part.column(1).to_numpy()))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int64)), pa.array(np.atleast_1d(total)[used].astype(float))], names=["piece", "n"])

    found = words.filter("trained > 0").select("word", "trained").mapInArrow(run, "piece long, n double")
    out = np.zeros(len(pieces) + 256)
    # rounded, as sums of doubles in changing order differ in their last digits
    for x in found.groupBy("piece").agg(F.round(F.sum("n"), 6).alias("n")).collect():
        out[x.piece] = x.n
    return out[: len(pieces)], out[len(pieces) :]


def vocabulary(model_path: str) -> tuple[list[str], list[float]]:
    """The pieces of a vocabulary file that may stand in a text, and their first guess: in proportion to 1 / (rank + 2) by their scores."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    usable = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))]
    names, scores = [model.id_to_piece(i) for i in usable], [model.get_score(i) for i in usable]
    rank = {x: r for r, x in enumerate(sorted(set(scores), reverse=True))}
    return names, [1 / (rank[x] + 2) for x in scores]


def fit(words: DataFrame, train_docs: int, model_path: str, rounds: int = ROUNDS) -> tuple[dict[str, float], list[float], float]:
    """Natural-log probabilities of the pieces, of the 256 bytes, and of the end."""
    names, guess = vocabulary(model_path)
    counts, of_bytes = np.array(guess), np.full(256, min(guess, default=1.0))
    end, add = float(np.sum(guess) / max(1, len(guess))), 0.0
    for turn in range(rounds + 1):
        total = counts.sum() + of_bytes.sum() + end + add * (len(names) + 257)
        log = lambda x: np.log((x + add) / total)  # noqa: B023, E731
        pieces, byte_logs, end_log = dict(zip(names, log(counts).tolist())), log(of_bytes).tolist(), float(log(end))
        if turn < rounds:
            counts, of_bytes = expected_counts(words, pieces, byte_logs)
            end, add = float(train_docs), 1.0
    return pieces, byte_logs, end_log


def scored_words(words: DataFrame, pieces: dict[str, float], byte_logs: list[float]) -> DataFrame:
    """words with the column score, the log10 probability of each word."""
    sent = words.sparkSession.sparkContext.broadcast((pieces, byte_logs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(*sent.value)
        for batch in gathered(batches):
            scores = lattice.log10s(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=["word", "trained", "total", "score"])

    return words.mapInArrow(run, "word string, trained long, total long, score double")


def frequent_words(words: DataFrame, most: int = FREQUENT) -> list:
    """The words of at least some number of occurrences, that being the least that leaves no more than most of them."""
    level = F.floor(F.log2(F.col("total").cast("double")) * 8).cast("int")
    levels, room = sorted(words.filter("total > 0").groupBy(level.alias("level")).count().collect(), key=lambda x: -x.level), most
    least = None
    for x in levels:
        room -= x["count"]
        if room < 0:
            break
        least = x.level
    return words.filter(level >= least).collect() if least is not None else []


def scores(docs: DataFrame, model_path: str, held_out: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs.

    held_out tells the rows not to learn from; unless given, those whose crc32(doc_id as text) mod 7 is 2.
    """
    spark: SparkSession = docs.sparkSession
    rows = split_rows(docs, id_col, text_col, held_out)
    words = materialize(word_table(rows), "lm-words")
    train_docs = rows.filter("NOT held_out").count()
    sums = words.agg(F.coalesce(F.sum("trained"), F.lit(0)).alias("n"), F.count(F.when(F.col("trained") > 0, 1)).alias("v")).first()
    train_tokens, distinct = sums.n + train_docs, sums.v + (train_docs > 0)
    pieces, byte_logs, end_log = fit(words, train_docs, model_path)
    table = materialize(scored_words(words, pieces, byte_logs), "lm-scored")

    base_of = lambda c: math.log10((c + 1) / (train_tokens + 1 * (distinct + 1)))
    known = {x.word.encode(): (x.trained > 0, base_of(x.trained), x.score) for x in frequent_words(table)}
    sent = spark.sparkContext.broadcast(known)
    end_base, end_known, end_score = base_of(train_docs), int(train_docs > 0), end_log / LN10

    rare_type = pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, uid = sent.value, TaskContext.get().partitionId() << 33
        for part in text_slices(batches):
            out: list[list] = [[] for _ in range(6)]
            for text in part.column(1).to_pylist():
                words = words_of(text)
                n_known, base, score, rare = end_known, [end_base], [end_score], []
                for word, n in Counter(words).items():
                    found = table.get(word)
                    if found is None:
                        rare.append({"word": word.decode(), "n": n})
                    else:
                        n_known += n * found[0]
                        base.append(n * found[1])
                        score.append(n * found[2])
                for to, x in zip(out, (uid, len(words) + 1, n_known, math.fsum(base), math.fsum(score), rare)):
                    to.append(x)
                uid += 1
            types = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), rare_type)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *map(pa.array, out, types)], names=["doc_id", "held_out", "uid", "n_tokens", "n_known", "base", "score", "rare"])

    schema = "doc_id long, held_out boolean, uid long, n_tokens long, n_known long, base double, score double, rare array<struct<word:string,n:long>>"
    partial = materialize(rows.mapInArrow(run, schema), "lm-partial")
    rare = partial.select("uid", F.explode("rare").alias("r")).select("uid", "r.word", "r.n")
    found = rare.join(table.select("word", "trained", F.col("score").alias("s")), "word")
    base = F.log10((F.col("trained") + 1) / F.lit(float(train_tokens + 1 * (distinct + 1))))
    more = found.groupBy("uid").agg(F.sum(F.when(F.col("trained") > 0, F.col("n")).otherwise(0)).alias("more_known"), F.sum(F.col("n") * base).alias("more_base"), F.sum(F.col("n") * F.col("s")).alias("more_score"))
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return partial.drop("rare").join(more, "uid", "left").select("doc_id", "held_out", "n_tokens", plus("n_known", "more_known").alias("n_known"), F.lit(train_tokens).cast("long").alias("train_tokens"), plus("base", "more_base").alias("base_score"), plus("score", "more_score").alias("score"))


def op3_lm(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
