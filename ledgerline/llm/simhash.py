"""SimHash near-duplicates by multi-index hashing.

A fingerprint of 64 bits is cut into segments. Two fingerprints within ``max_distance`` bits agree in at
least one segment up to ``max_distance // segments`` bits, so each fingerprint enumerates the small
Hamming balls of its segments, ball members meet in a keyed table, and complete distances are verified
there. Every key's members are joined into a forest, so a group of n near copies yields n - 1 links
and not all pairs. A key of many members is split by the bits outside its segment, of which one part in max_distance + 1 agrees, and
what is large even then is dealt out as pairs of blocks.

``keep_one_each``, the stage of a corpus pipeline, links texts by the exact similarity of their sets of shingles. At 0.8 fingerprints of 64 bits are too
far apart, so candidates come from wide ones of 2,048 bits: they agree in one of 128 segments, complete distances are verified, and then the texts.

Cases: a null or empty text (or one of blanks) has fingerprint zero and is linked like any other; texts of fewer words than a
shingle give one shingle; rows with equal texts share a fingerprint; a row with a null id keeps its place in a
component, whose id is the smallest non-null one (null if there is none). Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import connected_components, materialize, text_slices
from ledgerline.operators.components import written

BITS = 64
SEED = 42
#: Members of one key that are compared at a time; larger keys are split and dealt out in blocks of this size.
BLOCK = 4096
#: Share of fingerprints (1 in so many) from which large keys are told; it shapes the layout only, never the result.
HOT_SAMPLE = 64
#: Most large keys that are broadcast; more are joined by a shuffle.
HOT_BROADCAST = 100_000
#: Bits of the wide fingerprint and of its segments, each of which is a key. Texts of similarity 0.8 differ in 15.1 % of the bits at most, 310 on average
#: (deviation 16), so they agree in a segment with probability 0.073, and in one of the 128 with 0.9999.
WIDE, SEGMENT = 2048, 16
#: Bits within which candidates are verified.
RADIUS = 460
#: 64-bit words of the wide fingerprint that go along with a key; bits of these within which a pair is met, and within which a pair is a sure one.
SHORT, SHORT_RADIUS, SURE = 2, 40, 18
#: Pairs for each member from which on a key's members are joined by few pairs first, and by all that are left in a second round.
DENSE = 1
#: Of the pairs that join large groups, met in many keys, as many are verified for a member in the first round (with the least others).
JOINS = 4
#: Hashes of shingles of a block where whole sets are compared; a node counts as HASHES // BLOCK at least.
HASHES = 1 << 20
#: Kinds of rows of the rounds: a pair, one of the few that join what all pairs join (of a key, or of a large key's block), a node that meets others.
PAIR, JOIN, WHOLE, MEMBER = range(4)
#: Bins of the fine sketch: a byte of the least hash of each, 0 where a bin is empty. Texts of similarity s agree in about that share of
#: the bins that either fills, and pairs more than MARGIN deviations below the wanted share aren't verified.
BINS, MARGIN = 512, 3.9
_WORDS = np.random.default_rng(WIDE // 64).integers(1 << 63, size=WIDE // 64, dtype=np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
_LANES = np.uint64(0x0101010101010101)

def shingles(text: bytes, size: int) -> list[bytes]:
    """Shingles of the lower-cased (A-Z) words, repeats included; fewer words give their whole sequence."""
    words = text.lower().split()
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(size)))))


def fingerprint(text: str | None, size: int) -> int:
    """Bit i is set if it is set in over half of the shingles' XXH64 values; 0 for no words."""
    parts = shingles((text or "").encode("utf-8", "surrogatepass"), size)
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(parts), 1 << 16):
        hashes = np.array([xxhash.xxh64_intdigest(x, SEED) for x in parts[at : at + (1 << 16)]], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(parts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle_words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): one row for each row of docs, fp as a signed 64-bit integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            values = np.array([fingerprint(x, shingle_words) for x in part.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(values.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def ball(width: int, radius: int) -> list[int]:
    """Masks of at most radius set bits among width."""
    return [sum(1 << i for i in bits) for n in range(radius + 1) for bits in combinations(range(width), n)]


def _probes(fps: DataFrame, max_distance: int, segments: int) -> DataFrame:
    """(key, segment, fp): the ball members of each segment of each fingerprint. The radius is shared between the
    two that meet: centres within r meet at a point within half of r of one and the rest of r of the other."""
    radius = max_distance // segments
    edges = [BITS * i // segments for i in range(segments + 1)]
    entries = [
        F.struct(F.lit(low).alias("low"), F.lit((1 << (high - low)) - 1).cast("long").alias("full"), F.lit(mask).cast("long").alias("mask"), F.lit(s << (high - low)).cast("long").alias("tag"), F.lit(s).alias("segment"))
        for s, (low, high) in enumerate(zip(edges, edges[1:]))
        for mask in ball(high - low, radius - radius // 2)
    ]
    key = F.expr("(shiftrightunsigned(fp, p.low) & p.full ^ p.mask) + p.tag")
    return fps.select("fp", F.explode(F.array(*entries)).alias("p")).select(key.alias("key"), F.col("p.segment").alias("segment"), "fp")


def _parts_of_rest(segment: int, max_distance: int, segments: int):
    """Array of the parts of the bits outside a segment; fingerprints within max_distance agree in at least one of them."""
    low, high = BITS * segment // segments, BITS * (segment + 1) // segments
    width = BITS - (high - low)
    below = f"(fp & {(1 << low) - 1}L)"
    rest = below if high == BITS else f"({below} | shiftleft(shiftrightunsigned(fp, {high}), {low}))"
    cuts = [width * i // (max_distance + 1) for i in range(max_distance + 2)]
    return F.array(*[F.expr(f"((shiftrightunsigned({rest}, {a}) & {(1 << (b - a)) - 1}L) * {max_distance + 1}L + {i}L) + 1L") for i, (a, b) in enumerate(zip(cuts, cuts[1:]))])


def _hot(rows: DataFrame, key: list[str], member: str) -> DataFrame:
    """(key, n): keys of about BLOCK members or more, told from a share of the members; it shapes the layout and never the result."""
    share = rows.filter(F.pmod(F.xxhash64(member, F.lit(11)), F.lit(HOT_SAMPLE)) == 0).groupBy(*key).count()
    hot = share.filter(F.col("count") >= max(1, BLOCK // HOT_SAMPLE)).select(*key, (F.col("count") * HOT_SAMPLE).alias("n"))
    hot = materialize(hot, "simhash-hot")
    return F.broadcast(hot) if hot.limit(HOT_BROADCAST + 1).count() <= HOT_BROADCAST else hot


def _block_pairs(member: str):
    """(i, j), i <= j: the pairs of blocks to which a member of a key of about n members goes; (0, 0) where n is null."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64(member, F.lit(7)), blocks).cast("int")
    pair = lambda j: F.struct(F.least(mine, j).alias("i"), F.greatest(mine, j).alias("j"))
    return F.when(F.col("n").isNull(), F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(F.transform(F.sequence(F.lit(0), blocks - 1), pair))


def _dealt(probes: DataFrame, max_distance: int, segments: int) -> DataFrame:
    """(key, part, i, j, fp): members of large keys go by the parts of their other bits, and in pairs of blocks where these are large too."""
    hot = _hot(probes, ["key"], "fp")
    parts = F.coalesce(*[F.when(F.col("segment") == k, _parts_of_rest(k, max_distance, segments)) for k in range(segments)])
    split = probes.join(hot, "key", "left").select("key", "fp", F.explode(F.when(F.col("n").isNull(), F.array(F.lit(0).cast("long"))).otherwise(parts)).alias("part"))
    hot = _hot(split.filter("part > 0"), ["key", "part"], "fp")
    return split.join(hot, ["key", "part"], "left").select("key", "part", "fp", F.explode(_block_pairs("fp")).alias("p")).select("key", "part", "p.i", "p.j", "fp")


def forest(fp: np.ndarray, max_distance: int) -> list[tuple[int, int]]:
    """Links within max_distance, as few as join what all links join."""
    label, links = np.arange(len(fp)), []
    for i in range(len(fp)):
        near = np.flatnonzero(np.bitwise_count(fp ^ fp[i]) <= max_distance)
        others, first = np.unique(label[near], return_index=True)
        for comp, j in zip(others, near[first]):
            if comp != label[i]:
                links.append((int(fp[i]), int(fp[j])))
                label[label == comp] = label[i]
        if len(links) == len(fp) - 1:
            break
    return links


def _integers(column: pa.Array) -> np.ndarray:
    """A column of integers, or of binaries of equal length, as columns of 64-bit integers."""
    if pa.types.is_binary(column.type):
        return np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(len(column), -1)
    return column.to_numpy().astype(np.int64, copy=False)[:, None]


def whole_groups(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[np.ndarray]:
    """Rows of 64-bit integers in which every group (equal in the first width columns, sorted) is whole; memory is one group or a batch."""
    waiting: list[np.ndarray] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.concatenate([_integers(c) for c in batch.columns], axis=1)
        if waiting and (waiting[-1][-1, :width] != rows[0, :width]).any():
            yield np.concatenate(waiting)
            waiting = []
        others = np.flatnonzero((rows[:, :width] != rows[-1, :width]).any(axis=1))
        cut = int(others[-1]) + 1 if len(others) else 0
        if cut:
            yield np.concatenate([*waiting, rows[:cut]])
            waiting = []
        waiting.append(rows[cut:])
    if waiting:
        yield np.concatenate(waiting)


def _groups(rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the groups of rows."""
    starts = np.flatnonzero(np.r_[True, (rows[1:, :width] != rows[:-1, :width]).any(axis=1)])
    return starts, np.diff(np.r_[starts, len(rows)])


def _linker(max_distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, 4):
            starts, sizes = _groups(rows, 4)
            fp = np.ascontiguousarray(rows[:, 4]).view(np.uint64)
            pairs = starts[sizes == 2]
            close = pairs[(np.bitwise_count(fp[pairs] ^ fp[pairs + 1]) <= max_distance) & (fp[pairs] != fp[pairs + 1])]
            a, b = fp[close].tolist(), fp[close + 1].tolist()
            for at, n in zip(starts[sizes > 2], sizes[sizes > 2]):
                for x, y in forest(fp[at : at + n], max_distance):
                    a.append(x)
                    b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64)) for x in (a, b)], names=["a", "b"])

    return run


def near_links(fps: DataFrame, max_distance: int = 3, segments: int = 2) -> DataFrame:
    """(a, b): links that join all distinct fingerprints of fps(fp) within max_distance of each other."""
    dealt = _dealt(_probes(fps, max_distance, segments), max_distance, segments)
    place = ["key", "part", "i", "j"]
    return dealt.repartition(*place).sortWithinPartitions(*place).mapInArrow(_linker(max_distance), "a long, b long")


def near_duplicates(docs: DataFrame, shingle_words: int = 3, max_distance: int = 3, segments: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest id reachable over links of at most max_distance bits."""
    fps = materialize(fingerprints(docs, shingle_words, id_col, text_col), "simhash-fp")
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = connected_components(near_links(distinct.select("fp"), max_distance, segments)).toDF("fp", "root")
    of = distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    component = of.groupBy("root").agg(F.min("least").alias("component_id"))
    return fps.join(of.select("fp", "root").join(component, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def majority(hashes: np.ndarray) -> np.ndarray:
    """The WIDE bits, in words of 64, that are set in over half of what the hashes are stretched to; eight counters are added up in a word."""
    counts = np.zeros((WIDE // 64, 8, 8), dtype=np.int64)  # word, byte, bit
    for at in range(0, len(hashes), 255):
        words = hashes[None, at : at + 255] * _WORDS
        words = (words ^ (words >> np.uint64(32))) * _WORDS
        words ^= words >> np.uint64(29)
        for bit in range(8):
            counts[:, :, bit] += ((words >> np.uint64(bit)) & _LANES).sum(axis=1, dtype=np.uint64).view(np.uint8).reshape(-1, 8)
    return np.packbits((2 * counts > len(hashes)).ravel(), bitorder="little").view(np.uint64)


def set_hashes(text: str | None, size: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, in order."""
    parts = set(shingles((text or "").encode("utf-8", "surrogatepass"), size))
    return np.unique(np.array([xxhash.xxh64_intdigest(x, SEED) for x in parts], dtype=np.uint64))


def sketch(text: str | None, size: int) -> tuple[int, list[int], int, bytes]:
    """(node, wide, n, fine) of a text's set of shingles: a hash of the set, its fingerprint of WIDE bits, its size, its fine sketch."""
    hashes = set_hashes(text, size)
    fine = np.zeros(BINS, np.uint8)
    bins = hashes >> np.uint64(64 - (BINS - 1).bit_length())
    first = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])[: len(bins)]  # the hashes are sorted
    fine[bins[first]] = (hashes[first] % np.uint64(255) + np.uint64(1)).astype(np.uint8)
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED), majority(hashes).tolist(), len(hashes), fine.tobytes()


def text_hash(text_col: str):
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def sketches(docs: DataFrame, shingle_words: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, hash, node, wide, size, fine): one row for each row of docs, hash telling its text."""
    names, schema = ["doc_id", "hash", "node", "wide", "size", "fine"], "doc_id long, hash long, node long, wide array<long>, size long, fine binary"
    signed = lambda x: np.array(x, np.uint64).view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            found = [sketch(x, shingle_words) for x in part.column(2).to_pylist()]
            node, wide, size, fine = ([x[i] for x in found] for i in range(4))
            wide = pa.ListArray.from_arrays(np.arange(len(found) + 1, dtype=np.int32) * (WIDE // 64), pa.array(signed(wide).ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(signed(node)), wide, pa.array(size, pa.int64()), pa.array(fine, pa.binary())], names=names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_hash(text_col).alias("hash"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def _near_pairs(node: np.ndarray, bits: np.ndarray, label: np.ndarray, radius: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Pairs within radius, as few as join what all join, the sure ones first and then the closest; and what they join, by labels."""
    label, pairs = label.copy(), []
    for most in (SURE, radius):
        for i in range(len(node)):
            if (label == label[0]).all():
                return pairs, label
            distance = np.bitwise_count(bits ^ bits[i]).sum(axis=1, dtype=np.int64)
            near = np.flatnonzero((distance <= most) & (label != label[i]))
            if len(near):
                near = near[np.argsort(distance[near], kind="stable")]
                near = near[np.unique(label[near], return_index=True)[1]]
                label[np.isin(label, label[near])] = label[i]
            pairs += [(int(node[i]), int(node[j])) for j in near]
    return pairs, label


def may_be_similar(fine: np.ndarray, other: np.ndarray, similarity: float) -> np.ndarray:
    """Of each row of fine whether its set may have the similarity to other's: bins agree often enough, by MARGIN deviations.

    The bins' least hashes are drawn from the union without replacement, so the deviation falls with the share of the union that is drawn; a
    tenth is added to what is left, as the union's size is told from the filled bins.
    """
    filled = ((fine > 0) | (other > 0)).sum(axis=1)
    same = ((fine == other) & (other > 0)).sum(axis=1)
    union = -BINS * np.log(np.maximum(1 - filled / BINS, 0.5 / BINS))
    undrawn = np.minimum(1, 1.1 - filled / np.maximum(union, 1))
    return same >= similarity * filled - MARGIN * np.sqrt(similarity * (1 - similarity) * filled * undrawn) - 1


def _close(place: np.ndarray, short: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, j), i < j: all pairs of rows of one place (sorted) within radius."""
    words = [np.ascontiguousarray(x) for x in short.T]
    found, step, at = [], 1, np.arange(max(len(place) - 1, 0))
    while True:
        at = at[: np.searchsorted(at, len(place) - step)]
        at = at[place[at] == place[at + step]]
        if not len(at):
            break
        near = at[sum(np.bitwise_count(x[at] ^ x[at + step]).astype(np.int16) for x in words) <= radius]
        found.append((near, near + step))
        step += 1
    return tuple(np.concatenate([x[k] for x in found]) if found else np.zeros(0, np.int64) for k in range(2))


def _segments(nodes: DataFrame) -> DataFrame:
    """(key, node, s0, s1 ...): nodes by each segment of their wide fingerprints."""
    short = [F.col("wide")[k].alias(f"s{k}") for k in range(SHORT)]
    words = nodes.select("node", *short, F.posexplode("wide").alias("at", "word"))
    count, full = 64 // SEGMENT, (1 << SEGMENT) - 1
    keys = [((F.col("at") * count + k) * (full + 1)).cast("long") + F.shiftrightunsigned("word", k * SEGMENT).bitwiseAND(F.lit(full).cast("long")) for k in range(count)]
    return words.select(F.explode(F.array(*keys)).alias("key"), "node", *[f"s{k}" for k in range(SHORT)])


def _first_round(members: DataFrame, hot: DataFrame) -> DataFrame:
    """(a, b, kind, centre): PAIR for nodes that share a key and are close. Of a key with many such pairs only as few as join them, as JOIN, with the least node of what
    they join as centre; the second round takes the rest, by centres, as a group has fewer of them than keys.

    The members of a large key are dealt to blocks with one member in common, so that a group of copies of any size is joined by
    about as many pairs as it has members; the second round takes the whole key again.
    """
    short = [f"s{k}" for k in range(SHORT)]
    blocks = F.ceil(F.col("n") / BLOCK)
    place = lambda block: (F.col("key") * (1 << 32) + block).alias("place")
    dealt = members.join(hot, "key", "left").select(place(F.coalesce(F.pmod(F.xxhash64("node", F.lit(7)), blocks) + 1, F.lit(0))), "node", *short)
    leaders = members.join(hot, "key").groupBy("key").agg(F.min(F.struct("node", *short)).alias("lead"), F.first("n").alias("n"))
    leaders = leaders.select("key", F.explode(F.sequence(F.lit(1).cast("long"), blocks)).alias("block"), "lead.*").select(place(F.col("block")), "node", *short)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, 1):
            starts, sizes = _groups(rows, 1)
            node, bits = rows[:, 1], rows[:, 2:].view(np.uint64)
            group = np.repeat(np.arange(len(starts)), sizes)
            i, j = _close(group, bits, SHORT_RADIUS)
            dense = np.bincount(group[i], minlength=len(starts)) > DENSE * sizes
            few = ~dense[group[i]] & (node[i] != node[j])
            out = {PAIR: [np.stack([node[i[few]], node[j[few]], node[i[few]]], axis=1)], JOIN: [], WHOLE: []}
            for g in np.flatnonzero(dense):
                at = slice(starts[g], starts[g] + sizes[g])
                joined, label = _near_pairs(node[at], bits[at], node[at], SHORT_RADIUS)
                joined = np.array(joined, np.int64).reshape(-1, 2)
                of, back = np.unique(label, return_inverse=True)
                least = np.full(len(of), np.iinfo(np.int64).max)
                np.minimum.at(least, back, node[at])
                centre = least[back[np.searchsorted(node[at], joined[:, 0])]]  # nodes are sorted
                large = rows[at.start, 0] & ((1 << 32) - 1) > 0  # all of a large key's members meet again
                out[WHOLE if large else JOIN].append(np.column_stack([joined, centre]))
            for kind, parts in out.items():
                found = np.concatenate([np.zeros((0, 3), np.int64), *parts])
                found[:, :2].sort(axis=1)
                found = np.unique(found, axis=0)
                columns = [pa.array(found[:, 0]), pa.array(found[:, 1]), pa.array(np.full(len(found), kind, np.int32)), pa.array(found[:, 2], mask=np.full(len(found), kind != JOIN))]
                yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "kind", "centre"])

    rows = dealt.unionByName(leaders)
    return rows.repartition("place").sortWithinPartitions("place", "node").mapInArrow(run, "a long, b long, kind int, centre long")


def _places(members: DataFrame, most: int) -> DataFrame:
    """(key, i, j, node, root, block): where the members(key, node, root, weight) of keys of more than one root meet. Keys of more weight than most are dealt out as pairs of
    blocks; a root of more weight than that has blocks of its own, which do not meet each other."""
    sizes = members.groupBy("key", "root").agg(F.sum("weight").alias("size"))
    mixed = sizes.groupBy("key").agg(F.count(F.lit(1)).alias("roots"), F.sum("size").alias("n"), F.sum(F.when(F.col("size") <= most, F.col("size")).otherwise(0)).alias("small"))
    mixed = materialize(mixed.filter("roots > 1").drop("roots"), "near-mixed")
    members = members.drop("weight").join(mixed, "key")
    dealt = members.filter(F.col("n") <= most).select("key", F.lit(0).alias("i"), F.lit(0).alias("j"), "node", "root", F.lit(0).alias("block"))
    large = mixed.filter(F.col("n") > most)
    if not large.isEmpty():
        whole = lambda n: F.ceil(n / most).cast("int")
        own = materialize(sizes.filter(F.col("size") > most).join(large, "key").select("key", "root", whole(F.col("size")).alias("mine"), whole(F.col("small")).alias("first")), "near-large")
        order = Window.partitionBy("key").orderBy("root")  # as many rows as the key has roots of over so much weight
        own = own.withColumn("low", F.col("first") + F.sum("mine").over(order) - F.col("mine"))
        total = own.groupBy("key").agg(F.sum("mine").alias("owned"))
        parts = members.filter(F.col("n") > most).join(own.select("key", "root", "mine", "low"), ["key", "root"], "left").join(total, "key", "left")
        blocks = whole(F.col("small")) + F.coalesce("owned", F.lit(0))
        block = F.when(F.col("mine").isNull(), F.pmod(F.xxhash64("root"), whole(F.col("small")))).otherwise(F.col("low") + F.pmod(F.xxhash64("node"), F.col("mine"))).cast("int")
        parts = parts.withColumns({"block": block, "blocks": blocks})
        partners = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.col("mine").isNull() | (j < F.col("low")) | (j >= F.col("low") + F.col("mine")))
        parts = parts.select("key", "node", "root", "block", F.explode(partners).alias("other"))
        dealt = dealt.unionByName(parts.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "root", "block"))
    return dealt


def _brought(dealt: DataFrame, features: DataFrame) -> DataFrame:
    """dealt with the features(node, ...) of its nodes, joined once a node and not once a place."""
    places = dealt.groupBy("node", "root").agg(F.collect_list(F.struct("key", "i", "j", "block")).alias("places"))
    names = [c for c in features.columns if c != "node"]
    rows = places.join(features, "node").select(F.explode("places").alias("p"), "node", "root", *names)
    return rows.select("p.key", "p.i", "p.j", "node", "root", "p.block", *names)


def _second_round(groups: DataFrame, nodes: DataFrame, roots: DataFrame, similarity: float, pairs: bool = True) -> DataFrame:
    """Of the nodes of differing roots that share a key of groups(key, node), are close and have fine sketches that allow the similarity: all pairs (a, b), or,
    however many pairs there are, rows in proportion to the members: as (a, b, kind) the nodes that have such a partner with their roots, kind MEMBER, and of the pairs of
    roots as few as join what all join, kind JOIN."""
    keys = groups.groupBy("node").agg(F.collect_list("key").alias("keys"))  # of each segment one at most, or its group's centre; joined once a node, not once a key
    members = keys.join(roots, "node").select(F.explode("keys").alias("key"), "node", "root", F.lit(1).alias("weight"))
    features = nodes.select("node", *[F.col("wide")[k].alias(f"s{k}") for k in range(SHORT)], "fine")
    dealt = _brought(_places(materialize(members, "near-members"), BLOCK), features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, 3):
            starts, sizes = _groups(rows, 3)
            node, root, block, bits = rows[:, 3], rows[:, 4], rows[:, 5], rows[:, 6 : 6 + SHORT].view(np.uint64)
            fine = np.ascontiguousarray(rows[:, 6 + SHORT :]).view(np.uint8)
            across = rows[:, 1] != rows[:, 2]  # those inside one block meet where it is paired with itself
            label, partnered = root.copy(), np.zeros(len(rows), bool)
            found: dict[int, list[np.ndarray]] = {PAIR: [], JOIN: []}
            for at, size in zip(starts, sizes):
                part = slice(at, at + size)
                if (root[part] == root[at]).all():
                    continue
                for k in range(at, at + size - 1):
                    rest = slice(k + 1, at + size)
                    meet = (root[rest] != root[k]) & (np.bitwise_count(bits[rest] ^ bits[k]).sum(axis=1, dtype=np.int64) <= SHORT_RADIUS)
                    near = k + 1 + np.flatnonzero(meet & (block[rest] != block[k]) if across[at] else meet)
                    near = near[may_be_similar(fine[near], fine[k], similarity)]
                    if pairs:
                        found[PAIR].append(np.stack([np.full(len(near), node[k]), node[near]], axis=1))
                    elif len(near):
                        partnered[k] = partnered[near] = True
                        other = _newly_joined(label[part], near - at, k - at) + at
                        found[JOIN].append(np.stack([np.full(len(other), root[k]), root[other]], axis=1))
            found[MEMBER] = [] if pairs else [np.stack([node[partnered], root[partnered]], axis=1)]
            for kind, parts in found.items():
                both = np.concatenate([np.zeros((0, 2), np.int64), *parts])
                both = np.unique(both if kind == MEMBER else np.sort(both, axis=1), axis=0)
                out = [pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(np.full(len(both), kind, np.int32))]
                yield pa.RecordBatch.from_arrays(out, names=["a", "b", "kind"])

    place = ["key", "i", "j"]
    told = dealt.repartition(*place).sortWithinPartitions(*place).mapInArrow(run, "a long, b long, kind int")
    return told.select("a", "b") if pairs else told


def _newly_joined(label: np.ndarray, near: np.ndarray, k: int) -> np.ndarray:
    """Of near one for each label other than k's; label, changed in place, has these joined with k's afterwards."""
    others, first = np.unique(label[near], return_index=True)
    new = others != label[k]
    if new.any():
        label[np.isin(label, others[new])] = label[k]
    return near[first[new]]


def _linked_where_met(told: DataFrame, nodes: DataFrame, roots: DataFrame, docs: DataFrame, shingle_words: int, similarity: float, text_col: str) -> DataFrame:
    """(a, b): links that join all similar nodes of differing roots that the second round has told of, as few as do in each place.

    Roots that candidates join are a group. Its nodes meet with their whole sets of shingles (hashes of 64 bits), and pairs are compared there, so that no row is made for
    a pair that is no link; a group of more hashes than HASHES, or of more nodes than BLOCK, is dealt out as pairs of blocks.
    """
    group = connected_components(told.filter(F.col("kind") == JOIN).select("a", "b")).toDF("root", "key")
    wanted = told.filter(F.col("kind") == MEMBER).select(F.col("a").alias("node"), F.col("b").alias("root")).distinct()
    wanted = materialize(wanted.join(nodes.select("node", "hash", "size"), "node").join(group, "root"), "near-wanted")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices([batch]):
                sets = [set_hashes(x, shingle_words).tobytes() for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], names=["node", "set"])

    sets = materialize(_texts(docs, wanted, text_col).mapInArrow(hashed, "node long, set binary"), "near-sets")
    features = nodes.select("node", *[F.col("wide")[k].alias(f"s{k}") for k in range(SHORT)], "fine").join(sets, "node")
    dealt = _brought(_places(wanted.select("key", "node", "root", F.greatest("size", F.lit(HASHES // BLOCK)).alias("weight")), HASHES), features)

    def run(place: pa.Table) -> pa.Table:
        names = ["i", "j", "node", "root", "block", *[f"s{k}" for k in range(SHORT)]]
        i, j, node, label, block, *short = (place.column(x).to_numpy().astype(np.int64) for x in names)
        bits = np.stack(short, axis=1).view(np.uint64)
        fine, packed = (place.column(x).to_pylist() for x in ("fine", "set"))
        fine = np.frombuffer(b"".join(fine), np.uint8).reshape(len(node), -1)
        size = np.array([len(x) // 8 for x in packed])
        _, number = np.unique(np.frombuffer(b"".join(packed), np.uint64), return_inverse=True)
        of = np.split(number, np.cumsum(size)[:-1])
        mine, links = np.zeros(len(number), np.int64), []
        for k in range(len(node) - 1):
            rest = slice(k + 1, None)
            meet = (label[rest] != label[k]) & (np.bitwise_count(bits[rest] ^ bits[k]).sum(axis=1, dtype=np.int64) <= SHORT_RADIUS)
            near = k + 1 + np.flatnonzero(meet & (block[rest] != block[k]) if i[0] != j[0] else meet)
            near = near[(np.minimum(size[near], size[k]) >= similarity * np.maximum(size[near], size[k]) - 0.5) & (size[near] > 0)]
            near = near[may_be_similar(fine[near], fine[k], similarity)]
            if not len(near):
                continue
            mine[of[k]] = 1
            both = np.add.reduceat(mine[np.concatenate([of[x] for x in near])], np.r_[0, np.cumsum(size[near])[:-1]])
            mine[of[k]] = 0
            other = _newly_joined(label, near[both >= similarity * (size[k] + size[near] - both)], k)
            links.append(np.stack([np.full(len(other), node[k]), node[other]], axis=1))
        both = np.concatenate([np.zeros((0, 2), np.int64), *links])
        return pa.table({"a": both[:, 0], "b": both[:, 1]})

    return dealt.groupBy("key", "i", "j").applyInArrow(run, "a long, b long")


def _candidates(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """(a, b): the pairs whose complete fingerprints are within RADIUS, and whose sizes and fine sketches allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            fine = [np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for k in (2, 3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(may_be_similar(*fine, similarity)))

    left, right = (nodes.select(F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("wide", "size", "fine")]) for x in "ab")
    distance = sum(F.bit_count(F.col("wide_a")[k].bitwiseXOR(F.col("wide_b")[k])) for k in range(WIDE // 64))
    rows = pairs.distinct().join(left, "a").join(right, "b").filter(F.least("size_a", "size_b") >= similarity * F.greatest("size_a", "size_b") - 0.5).filter(distance <= RADIUS)
    return rows.select("a", "b", "fine_a", "fine_b").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame, shingle_words: int, similarity: float) -> DataFrame:
    """(a, b): the pairs whose sets of shingles have a Jaccard similarity of at least similarity; texts: (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = lambda x: set(shingles((x or "").encode("utf-8", "surrogatepass"), shingle_words))
        last, left = None, set()
        for batch in batches:
            for part in text_slices([batch]):
                kept = []
                for a, x, y in zip(part.column(0).to_pylist(), part.column(2), part.column(3)):
                    if a != last:
                        last, left = a, of(x.as_py())
                    right = of(y.as_py())
                    both = len(left & right)
                    kept.append(both >= similarity * (len(left) + len(right) - both))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(pa.array(kept, pa.bool_()))

    rows = pairs.join(texts.toDF("b", "text_b"), "b").join(texts.toDF("a", "text_a"), "a")
    return rows.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _texts(docs: DataFrame, nodes: DataFrame, text_col: str) -> DataFrame:
    """(node, text): a text of each of the nodes(node, hash ...)."""
    texts = docs.select(text_hash(text_col).alias("hash"), F.col(text_col).cast("string").alias("text")).join(nodes.select("node", "hash"), "hash")
    return texts.groupBy("node").agg(F.first("text").alias("text"))


def _roots(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node is joined with by links."""
    joined = connected_components(links).toDF("node", "up")
    return materialize(nodes.select("node").join(joined, "node", "left").select("node", F.coalesce("up", "node").alias("root")), "near-roots")


def similar_groups(docs: DataFrame, shingle_words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, hash, root): rows of docs of one root are joined by links of a Jaccard similarity of at least similarity.

    Candidates come by multi-index hashing: their wide fingerprints agree in a segment and are within RADIUS of each other. A first round joins the members of a
    key with many close pairs by as few as can join them; a second compares every pair of such a key that verification has left in different groups,
    where its members meet, and makes rows for the links alone, so a group costs rows in proportion to its members.
    """
    rows = materialize(sketches(docs, shingle_words, id_col, text_col), "near-sketches")
    nodes = materialize(rows.groupBy("node").agg(F.min("hash").alias("hash"), *[F.first(x).alias(x) for x in ("wide", "size", "fine")]), "near-nodes")
    members = _segments(nodes)
    hot = _hot(members, ["key"], "node")
    met = written(_first_round(members, hot), "near-met")  # narrow rows, in batches of the usual size
    joined = met.filter(F.col("kind") == JOIN)
    groups = joined.select(F.col("centre").alias("key"), F.col("a").alias("node")).union(joined.select("centre", "b")).distinct()
    groups = groups.unionByName(members.join(hot, "key").select("key", "node"))
    joins = met.filter(F.col("kind").isin(JOIN, WHOLE)).groupBy("b").agg(F.slice(F.array_sort(F.collect_set("a")), 1, JOINS).alias("least"))
    pairs = met.filter(F.col("kind") == PAIR).select("a", "b").union(joins.select(F.explode("least"), "b"))
    pairs = materialize(_candidates(pairs, nodes, similarity), "near-pairs")
    ends = nodes.join(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "node")
    texts = materialize(_texts(docs, ends, text_col), "near-texts")
    links = materialize(_verified(pairs, texts, shingle_words, similarity), "near-links")
    roots = _roots(nodes, links)
    told = materialize(_second_round(groups, nodes, roots, similarity, pairs=False), "near-told")
    if not told.isEmpty():
        links = links.union(materialize(_linked_where_met(told, nodes, roots, docs, shingle_words, similarity, text_col), "near-links"))
        roots = _roots(nodes, links)
    return rows.select("doc_id", "hash", "node").join(roots, "node").select("doc_id", "hash", "root")


def keep_one_each(docs: DataFrame, shingle_words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without near copies: of each group the row with the smallest id stays, once; a null id comes after all others.

    Links are of an exact Jaccard similarity of the sets of shingles of at least similarity. Candidates agree in a segment
    of their wide fingerprints and are within RADIUS bits, so a link is missed only by chance (see the README). Rows are told apart by
    id and text: of one id, rows of other texts stay or go by their own groups.
    """
    found = materialize(similar_groups(docs, shingle_words, similarity, id_col, text_col), "near-found")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")
    best = found.groupBy("root").agg(F.min(rank).alias("best"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    marked = found.join(best, "root").groupBy(F.col("doc_id").alias("_near_id"), F.col("hash").alias("_near_hash")).agg(F.first(rank == F.col("best")).alias("stays"), F.count(F.lit(1)).alias("n"))
    marked = materialize(marked.filter("NOT stays OR n > 1"), "near-marked")
    key = F.col(id_col).cast("long").eqNullSafe(F.col("_near_id")) & (text_hash(text_col) == F.col("_near_hash"))
    kept = docs.join(marked, key, "left_anti")
    repeated = marked.filter("stays")
    if not repeated.isEmpty():  # rows that stand there several times, alike in id and text: one of them
        again = docs.join(repeated, key, "left_semi").withColumns({"_near_id": F.col(id_col).cast("long"), "_near_hash": text_hash(text_col)})
        kept = kept.unionByName(again.dropDuplicates(["_near_id", "_near_hash"]).select(*docs.columns))
    return kept
