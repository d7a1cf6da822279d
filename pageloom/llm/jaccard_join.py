"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

A document's set is its distinct word n-grams as 64-bit hashes.  Documents with equal sets are one class, found by a
128-bit key of the set; only classes are joined.

Order: n-grams by the number of classes that hold them, rarest first, then by hash.  The numbers are counted over all
classes, with no cap and no table that all tasks share.  Classes are dealt by their key to blocks of about BLOCK_GRAMS
grams.  A block sends each of its distinct grams once, with its own count, to the gram's bucket, so a gram that a third
of all classes hold is one entry for each block.  A bucket adds up the counts and tells each block which of its grams
are in more than one class, and in how many.  For counting, hashes are cut to 16 bits more than the corpus needs to tell
its grams apart: where two grams are taken for one (one in 65,536), both count as a little more frequent than they are,
everywhere alike, so that the order stays one order.

A gram of one class only links nothing and comes first in the order.  So a class of n grams whose prefix of
``n - ceil(t n) + 1`` grams is all such grams links with nothing and is done; of the others only the repeated grams are
kept, which hold every intersection.  The prefix grams among them are few, and are all that is joined.

Join: classes that link share a prefix gram.  Many near copies share whole prefixes, so pairs are not formed within a
gram.  First each class is verified against one pivot, the nearest of the smallest classes of its grams; the links
contract dense groups.  Classes left over are verified against the nearest of one member of each of their grams' largest
components.  Then only pairs from different components are formed, on one side without each gram's largest component and
never of two classes that have too many grams of their own (``crossing_rows``), and pass the filters on length, position and suffix (the grams after the shared one differ at least by their counts in
RANGES hash ranges).  Of these the nearest of each class are verified, and then all that are still in different
components.  Pairs are verified once each on whole sets, in cells of about CELL_GRAMS grams: a cell gets each set that it
needs once, so a pivot of very many classes is sent to cells, and no task gathers its classes.  No link that changes a
component is lost, and no group of copies is expanded into its pairs.

Words are runs of anything but ASCII white space, with A-Z lower-cased.  A text with fewer than n words is one gram of
all its words; null text and text without words has an empty set and links with nothing.  Rows that repeat, with their
doc_id or without, are rows of their own and linked.  doc_id may have any orderable type; a null one is smallest.  Other
columns are never looked at.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import cells, durable, handed_back, isolate, numbered, parallel, release, small_side, stored, thrifty

#: Defaults of near-duplicate stages.
WORDS, PERCENT = 5, 80

#: Grams of one block of classes, of one bucket of counts and of one cell of pairs.
BLOCK_GRAMS, BUCKET_GRAMS, CELL_GRAMS = 1 << 20, 1 << 21, 1 << 21

#: Links that one task contracts.
TASK_LINKS = 1 << 17

#: Bits of a gram that are counted beyond the logarithm of their number.
SPARE_BITS = 16

#: Hash ranges of the suffix filter, and columns of parity bits.
RANGES, MARKS = 16, ("m0", "m1", "m2", "m3")

_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)

#: A random value for each byte, the same for both cases of a letter; and which bytes are white space.
_BYTES = np.random.default_rng(2024).integers(0, 1 << 63, 256, np.uint64)
_BYTES[65:91] = _BYTES[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


class _Powers:
    """Powers of an odd base modulo 2^64 and their inverses, grown to the longest text seen."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> None:
        if n > len(self.up):
            size = max(2 * len(self.up), n)
            inverse = pow(self.BASE, -1, 1 << 64)
            run = lambda base: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, base, np.uint64)]), dtype=np.uint64)
            with np.errstate(over="ignore"):
                self.up, self.down = run(self.BASE), run(inverse)


_powers = _Powers()

#: Words of more bytes than LONG_WORD take a second polynomial into their hash, modulo a prime: modulo 2^64 alone, long words
#: of two letters can be written (Thue and Morse's, of 1,024) whose polynomials are equal for every base.
LONG_WORD, PRIME, PRIME_BASE = 32, (1 << 31) - 1, 1_368_512_369
_SMALL = np.random.default_rng(2025).integers(1, PRIME, 256, np.uint64)
_SMALL[65:91] = _SMALL[97:123]


@lru_cache(maxsize=40)
def _prime_powers(doublings: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    for _ in range(doublings):
        out = np.concatenate([out, out * np.uint64(pow(PRIME_BASE, len(out), PRIME)) % np.uint64(PRIME)])
    return out


def prime_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A polynomial modulo PRIME of each of the words, each from its own first byte."""
    powers = _prime_powers(int((ends - starts).max()).bit_length())
    out = np.zeros(len(starts), np.uint64)
    for k, (a, b) in enumerate(zip(starts, ends, strict=True)):  # few words are long
        terms = _SMALL[data[a:b]] * powers[: b - a] % np.uint64(PRIME)
        out[k] = int(terms.sum(dtype=np.uint64)) % PRIME
    return out


def word_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each word of a text's bytes, from one running sum."""
    blank = _SPACE[data]
    edge = np.flatnonzero(np.diff(blank))
    if not len(data) or (not len(edge) and blank[0]):
        return np.zeros(0, np.uint64)
    starts, ends = edge[blank[edge]] + 1, edge[~blank[edge]] + 1
    if not blank[0]:
        starts = np.concatenate([[0], starts])
    if not blank[-1]:
        ends = np.append(ends, len(data))
    _powers.to(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * _powers.up[: len(data)], dtype=np.uint64)])
        h = (sums[ends] - sums[starts]) * _powers.down[starts]
        long = np.flatnonzero(ends - starts > LONG_WORD)
        if len(long):
            h[long] ^= (prime_hashes(data, starts[long], ends[long]) + np.uint64(1)) * np.uint64(_FACTORS[0])
        h = (h ^ (h >> np.uint64(32))) * np.uint64(_FACTORS[2])
    return h ^ (h >> np.uint64(29))


def gram_set(text: str | bytes | np.ndarray | None, n: int) -> np.ndarray:
    """The sorted distinct n-grams of a whole text."""
    if text is None:
        return np.zeros(0, np.uint64)
    if not isinstance(text, np.ndarray):
        text = np.frombuffer(text.encode() if isinstance(text, str) else text, np.uint8)
    hashes = word_hashes(text)
    if not len(hashes):
        return hashes
    size = min(n, len(hashes))
    with np.errstate(over="ignore"):
        grams = np.full(len(hashes) - size + 1, size, np.uint64)
        for k in range(size):
            grams = (grams ^ hashes[k : len(hashes) - size + 1 + k]) * np.uint64(_FACTORS[k % 3])
            grams ^= grams >> np.uint64(29)
        grams = (grams ^ (grams >> np.uint64(32))) * np.uint64(_FACTORS[1])
    grams = np.sort(grams ^ (grams >> np.uint64(31)))
    return grams[np.concatenate([[True], grams[1:] != grams[:-1]])]


def texts_of(column: pa.Array) -> Iterator[np.ndarray | None]:
    """The bytes of each text, without a copy."""
    wide = column.cast(pa.large_binary())
    _, offsets, data = wide.buffers()
    at = np.frombuffer(offsets, np.int64)[wide.offset : wide.offset + len(wide) + 1]
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    null = wide.is_null().to_numpy(zero_copy_only=False)
    return (None if null[i] else held[at[i] : at[i + 1]] for i in range(len(wide)))


def prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def can_link(n: int, percent: int) -> bool:
    """Whether a set of n grams can link with a larger one that isn't equal."""
    return percent * (n + 1) <= 100 * n


def _key(grams: np.ndarray) -> bytes | None:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest() if len(grams) else None


def described(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, text_hash, n_shingles and key of every document."""

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            sizes, keys = [], []
            for text in texts_of(frame["text"]):
                grams = gram_set(text, n)
                sizes.append(len(grams))
                keys.append(_key(grams))
            yield pa.RecordBatch.from_arrays([frame["doc_id"], frame["text_hash"], pa.array(sizes, pa.int64()), pa.array(keys, pa.binary())], ["doc_id", "text_hash", "n_shingles", "key"])

    return docs.mapInArrow(thrifty(batches), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_hash long, n_shingles long, key binary")


def texts_by_block(docs: DataFrame, n: int, percent: int, blocks: int) -> DataFrame:
    """block, key and text of each set that can link with another, once for each task that reads it.

    The text is shuffled and hashed again where it arrives: compressed, it is half as large as its n-grams.
    """

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for frame in frames:
            block, keys, chosen = [], [], []
            for i, text in enumerate(texts_of(frame["text"])):
                grams = gram_set(text, n)
                if can_link(len(grams), percent) and (key := _key(grams)) not in seen:
                    seen.add(key)
                    block.append(int.from_bytes(key[:6]) % blocks)
                    keys.append(key)
                    chosen.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), pa.array(keys, pa.binary()), frame["text"].take(pa.array(chosen, pa.int32()))], ["block", "key", "text"])

    return docs.mapInArrow(thrifty(batches), "block int, key binary, text string")


def _longs(held: bytes) -> np.ndarray:
    return np.frombuffer(held, np.uint64)


def packed(values: np.ndarray) -> bytes:
    """Rising values as the first and the bytes of their steps: all lowest bytes, then all second ones, as far as any step needs."""
    steps = np.diff(values, prepend=values[:1])
    width = max(1, (int(steps.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + values[:1].tobytes() + np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unpacked(held: bytes) -> np.ndarray:
    planes = np.frombuffer(held, np.uint8, offset=9).reshape(held[0], -1)
    steps = np.zeros((planes.shape[1], 8), np.uint8)
    steps[:, : held[0]] = planes.T
    return np.frombuffer(held, np.uint64, 1, 1) + np.cumsum(steps.reshape(-1).view(np.uint64), dtype=np.uint64)


def counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and how often each occurs."""
    values = np.sort(values)
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return values[first], np.diff(np.append(first, len(values)))


def classes_in(table: pa.Table, n: int) -> tuple[list[bytes], list[np.ndarray]]:
    """Keys and sets of a block, each key once."""
    place = {key: i for i, key in enumerate(table["key"].to_pylist())}
    sets = [gram_set(text, n) if place[key] == i else None for i, (key, text) in enumerate(zip(table["key"].to_pylist(), texts_of(table["text"].combine_chunks()), strict=True))]
    order = sorted(place)
    return order, [sets[place[key]] for key in order]


def block_counts(texts: DataFrame, n: int, bits: int, buckets: int) -> DataFrame:
    """bucket, block, grams (cut to ``bits``, packed) and the places and counts of those in several classes of the block."""

    def count(key: tuple, table: pa.Table) -> pa.Table:
        _, sets = classes_in(table, n)
        values, counts = counted(np.concatenate(sets) >> np.uint64(64 - bits))
        bucket = ((values >> np.uint64(bits - 32)) * np.uint64(buckets)) >> np.uint64(32)  # rises with the value
        edge = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]]).tolist()
        out = []
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            many = np.flatnonzero(counts[a:b] > 1)
            out.append((int(bucket[a]), key[0].as_py(), packed(values[a:b]), np.stack([many, counts[a:b][many]]).astype(np.uint32).tobytes()))
        bucket, block, grams, many = zip(*out, strict=True)
        return pa.table([pa.array(bucket, pa.int32()), pa.array(block, pa.int32()), pa.array(grams, pa.binary()), pa.array(many, pa.binary())], ["bucket", "block", "grams", "many"])

    return texts.groupBy("block").applyInArrow(lambda key, table: handed_back(count(key, table)), "bucket int, block int, grams binary, many binary")


def repeated_grams(counts: DataFrame) -> DataFrame:
    """block, grams (cut, rising) and in how many classes each is, of the grams in more than one class."""

    def add(table: pa.Table) -> pa.Table:
        held = [unpacked(x.as_py()) for x in table["grams"]]
        values, totals = counted(np.concatenate(held))
        for grams, x in zip(held, table["many"], strict=True):
            at, several = np.frombuffer(x.as_py(), np.uint32).reshape(2, -1)
            totals[np.searchsorted(values, grams[at])] += several.astype(np.int64) - 1
        values, totals = values[totals > 1], np.minimum(totals[totals > 1], 0xFFFFFFFF).astype(np.uint32)
        blocks, grams_out, df_out = [], [], []
        for block, grams in zip(table["block"].to_pylist(), held, strict=True):
            at = np.searchsorted(values, grams)
            hit = np.append(values, np.uint64(0))[at] == grams if len(values) else np.zeros(len(grams), bool)
            hit &= at < len(values)
            if hit.any():
                blocks.append(block)
                grams_out.append(grams[hit].tobytes())
                df_out.append(totals[at[hit]].tobytes())
        return pa.table([pa.array(blocks, pa.int32()), pa.array(grams_out, pa.binary()), pa.array(df_out, pa.binary())], ["block", "grams", "df"])

    return counts.groupBy("bucket").applyInArrow(lambda table: handed_back(add(table)), "block int, grams binary, df binary")


LIVE = "sid long, key binary, n int, u int, m0 long, m1 long, m2 long, m3 long, grams binary, prefix array<struct<gram:long,pos:int,suffix:array<tinyint>>>"
_PREFIX = pa.list_(pa.struct([("gram", pa.int64()), ("pos", pa.int32()), ("suffix", pa.list_(pa.int8()))]))
_LIVE = pa.schema([("sid", pa.int64()), ("key", pa.binary()), ("n", pa.int32()), ("u", pa.int32()), *((m, pa.int64()) for m in MARKS), ("grams", pa.binary()), ("prefix", _PREFIX)])


def parity(grams: np.ndarray) -> np.ndarray:
    """Whether an odd number of grams falls on each of 64 * len(MARKS) places, as bits of longs."""
    flags = np.bincount((grams & np.uint64(64 * len(MARKS) - 1)).astype(np.int64), minlength=64 * len(MARKS)).astype(np.uint8) & 1
    return np.packbits(flags).view(np.int64)


def rare_first(grams: np.ndarray, df: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``want`` rarest of a class's repeated grams, and for each how many of those after it fall in each hash range."""
    order = np.lexsort((grams, df))
    ranges = (grams >> np.uint64(60)).astype(np.int64)
    ahead = np.cumsum(np.eye(RANGES, dtype=np.int32)[ranges[order[:want]]], axis=0)
    return grams[order[:want]], np.minimum(np.bincount(ranges, minlength=RANGES) - ahead, 127).astype(np.int8)


def live_classes(texts: DataFrame, n: int, repeated: DataFrame, percent: int, bits: int) -> DataFrame:
    """The classes that may link: their repeated grams, the number u of their other grams, and their prefix among the former."""

    def choose(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows or not replies.num_rows:
            return _LIVE.empty_table()
        keys, sets = classes_in(table, n)
        heard = sorted(((_longs(g.as_buffer()), np.frombuffer(d.as_buffer(), np.uint32)) for g, d in zip(replies["grams"], replies["df"], strict=True)), key=lambda x: x[0][0])
        known, totals = (np.concatenate(x) for x in zip(*heard, strict=True))
        every = np.concatenate(sets)
        cut = every >> np.uint64(64 - bits)
        at = np.minimum(np.searchsorted(known, cut), len(known) - 1)
        hit = known[at] == cut
        ends = np.cumsum([len(s) for s in sets])
        out: list[tuple] = []
        for i, (name, grams) in enumerate(zip(keys, sets, strict=True)):
            mine = hit[ends[i] - len(grams) : ends[i]]
            kept = int(mine.sum())
            want = prefix_length(len(grams), percent) - (len(grams) - kept)
            if want <= 0:
                continue
            again, lone = grams[mine], len(grams) - kept
            first, suffix = rare_first(again, totals[at[ends[i] - len(grams) : ends[i]][mine]], want)
            prefix = [{"gram": g, "pos": lone + k + 1, "suffix": s} for k, (g, s) in enumerate(zip(first.view(np.int64).tolist(), suffix.tolist(), strict=True))]
            out.append(((key[0].as_py() << 32) | i, name, len(grams), lone, *parity(again).tolist(), again.tobytes(), prefix))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _LIVE, strict=True)], schema=_LIVE) if out else _LIVE.empty_table()

    return texts.groupBy("block").cogroup(repeated.groupBy("block")).applyInArrow(lambda key, table, replies: handed_back(choose(key, table, replies)), LIVE)


def verified(pairs: DataFrame, live: DataFrame, percent: int) -> DataFrame:
    """Those of the distinct pairs (a, b, weight) that link, by their whole sets."""
    n_pairs, total = pairs.agg(F.count("*"), F.coalesce(F.sum("weight"), F.lit(0))).first()
    cell = F.pmod(F.xxhash64("a", "b"), F.lit(cells(total, CELL_GRAMS))).cast("int")
    wanted = pairs.select(cell.alias("cell"), F.explode(F.array("a", "b")).alias("sid")).distinct()
    sets = small_side(wanted, 2 * n_pairs).join(live.select("sid", "n", "grams"), "sid").select("cell", F.col("sid").alias("a"), F.lit(None).cast("long").alias("b"), "n", "grams")
    both = sets.unionByName(pairs.select(cell.alias("cell"), "a", "b", F.lit(None).cast("int").alias("n"), F.lit(None).cast("binary").alias("grams")))

    def check(table: pa.Table) -> pa.Table:
        names, others, sizes, grams = (table[c].to_pylist() if c != "grams" else table[c] for c in ("a", "b", "n", "grams"))
        held = {a: (sizes[i], _longs(grams[i].as_buffer())) for i, (a, b) in enumerate(zip(names, others, strict=True)) if b is None}
        out = []
        for a, b in zip(names, others, strict=True):
            if b is not None:
                (n, x), (m, y) = held[a], held[b]
                same = np.sort(np.concatenate([x, y]))
                shared = int((same[1:] == same[:-1]).sum())
                if 100 * shared >= percent * (n + m - shared):
                    out.append((a, b))
        return pa.table([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    return both.groupBy("cell").applyInArrow(lambda table: handed_back(check(table)), "a long, b long")


def _contracted(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node of a task's links with the smallest node that they reach."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for frame in frames:
        for a, b in zip(frame["a"].to_pylist(), frame["b"].to_pylist(), strict=True):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    found = [(x, find(x)) for x in list(root)]
    yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found if f[0] != f[1]], pa.int64()) for k in (0, 1)], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """node and root (its smallest member) of every node of ``edges`` (a, b).

    Tasks contract TASK_LINKS links each to stars; alternating large and small stars then join what is in several tasks.
    """
    edges = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    edges = durable(edges.repartition(cells(edges.count(), TASK_LINKS)).mapInArrow(thrifty(_contracted), "a long, b long").distinct())
    while True:
        links, nodes = edges.agg(F.count("*"), F.count_distinct("a")).first()
        if links == nodes and edges.select(F.col("b").alias("a")).join(edges, "a", "left_semi").isEmpty():
            break  # all links are stars around their smallest node
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("low", "a").alias("low"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b")
        kept = both.where("b < a").groupBy("a").agg(F.min("b").alias("b"))
        edges = durable(large.unionByName(kept).distinct())
        low = edges.groupBy("a").agg(F.min("b").alias("low"))
        small = edges.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b")
        small = small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        edges = durable(small.unionByName(low.select("a", F.col("low").alias("b"))).distinct())
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select("b", "b").toDF("node", "root").distinct())


CARRIED = ("sid", "n", "u", "pos", "suffix", "c", *MARKS)


def open_rows(open_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows (gram, ...) of grams with several components ``c``, and each gram's largest."""
    split = durable(open_.groupBy("gram").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("gram"))
    rows = durable(open_.join(small_side(split, split.count()), "gram"))
    largest = rows.groupBy("gram", "c").agg(F.count("*").alias("held")).groupBy("gram").agg(F.max_by("c", F.struct("held", "c")).alias("main"))
    return rows, largest


def _side(mark: str, names: tuple[str, ...] = CARRIED) -> list[Column]:
    return [F.col(x).alias(f"{x}_{mark}") for x in names]


def _pairs(rows: DataFrame) -> DataFrame:
    """Distinct (a, b, gap, weight) of rows with two sides x and y: the least number of grams that only one has, and the grams to compare."""
    weight = F.col("n_x") - F.col("u_x") + F.col("n_y") - F.col("u_y")
    return rows.select(F.greatest("sid_x", "sid_y").alias("a"), F.least("sid_x", "sid_y").alias("b"), _gap("x", "y").alias("gap"), weight.alias("weight")).distinct()


def attaching_pairs(open_: DataFrame, percent: int) -> DataFrame:
    """Pairs of a class with one member of each of its grams' largest components: one for each gram and class at most."""
    rows, largest = open_rows(open_)
    rows = rows.join(largest, "gram")
    member = F.min_by(F.struct(*_side("y")), F.xxhash64("sid", "gram"))
    members = rows.where("c = main").groupBy("gram").agg(member.alias("y")).select("gram", "y.*")
    return _pairs(rows.where("c <> main").select("gram", *_side("x")).join(members, "gram").where(_can("x", "y", percent)))


def crossing_rows(open_: DataFrame, percent: int) -> DataFrame:
    """Two sides x and y of a prefix gram, x not in its largest component.

    Two sets can link only if their grams of one class, u, are at most (100 - percent) of each (100 + percent) of their sizes
    together.  A class with more than its share of them is heavy, and two heavy classes are never brought together.  So the
    pages of a template that differ by just more than the threshold, which all keep its grams in their prefixes, make no rows.
    """
    rows, largest = open_rows(open_)
    heavy = F.col("u") * (100 + percent) > F.col("n") * (100 - percent)
    left = lambda df: df.join(largest, "gram").where("c <> main").select("gram", "main", *_side("x"))
    right = lambda df: df.select("gram", *_side("y"))
    light = rows.where(~heavy)
    return left(light).join(right(rows), "gram").unionByName(left(rows.where(heavy)).join(right(light), "gram"))


def crossing_pairs(open_: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes in different components that share a prefix gram and pass all filters."""
    once = (F.col("c_y") == F.col("main")) | (F.col("sid_x") < F.col("sid_y"))
    return _pairs(crossing_rows(open_, percent).where((F.col("c_x") != F.col("c_y")) & once & _can("x", "y", percent) & _places("x", "y", percent)))


def _needed(x: str, y: str, percent: int) -> Column:
    """Shared grams that a link of sets of these sizes takes."""
    return F.ceil((F.col(f"n_{x}") + F.col(f"n_{y}")) * percent / (100.0 + percent) - 1e-9)


def _gap(x: str, y: str) -> Column:
    """Grams that only one of two sets has: those of no other class, and of the rest at least the differing parity bits."""
    bits = [F.bit_count(F.col(f"{m}_{x}").bitwiseXOR(F.col(f"{m}_{y}"))) for m in MARKS]
    return F.col(f"u_{x}") + F.col(f"u_{y}") + bits[0] + bits[1] + bits[2] + bits[3]


def _can(x: str, y: str, percent: int) -> Column:
    """The length filter, and the grams that must differ."""
    length = 100 * F.least(f"n_{x}", f"n_{y}") >= percent * F.greatest(f"n_{x}", f"n_{y}")
    return length & (_gap(x, y) <= F.col(f"n_{x}") + F.col(f"n_{y}") - 2 * _needed(x, y, percent))


def _places(x: str, y: str, percent: int) -> Column:
    """The positional and the suffix filter of two sets that share the gram at pos."""
    before = F.least(F.col(f"pos_{x}") - F.col(f"u_{x}"), F.col(f"pos_{y}") - F.col(f"u_{y}"))
    left_x, left_y = F.col(f"n_{x}") - F.col(f"pos_{x}"), F.col(f"n_{y}") - F.col(f"pos_{y}")
    apart = F.aggregate(F.zip_with(f"suffix_{x}", f"suffix_{y}", lambda p, q: F.abs(p.cast("int") - q.cast("int"))), F.lit(0), lambda s, d: s + d)
    needed = _needed(x, y, percent)
    return (before + F.least(left_x, left_y) >= needed) & (2 * before + left_x + left_y - apart >= 2 * needed)


def best_partners(pairs: DataFrame) -> DataFrame:
    """Of (a, b, gap, weight) the nearest partner of each class, on either side."""
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "gap", "weight"))
    best = both.groupBy("a").agg(F.min(F.struct("gap", "b", "weight")).alias("best"))
    return best.select(F.greatest("a", "best.b").alias("a"), F.least("a", "best.b").alias("b"), "best.weight").distinct()


def still_apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose classes are in different components."""
    root = lambda mark: roots.select(F.col("node").alias(mark), F.col("root").alias(f"root_{mark}"))
    rows = pairs.join(root("a"), "a", "left").join(root("b"), "b", "left")
    return rows.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select(*pairs.columns)


def linked(live: DataFrame, percent: int) -> DataFrame:
    """key and root_key of every class that is linked with another."""
    postings = live.select("sid", "n", "u", *MARKS, F.explode("prefix").alias("at")).select("at.gram", "sid", "n", "u", *MARKS, "at.pos", "at.suffix")
    shared = postings.groupBy("gram").agg(F.count("*").alias("df"), F.min(F.struct("sid", "n", "u", *MARKS)).alias("y")).where("df > 1")
    shared = durable(shared.select("gram", F.struct(*[F.col(f"y.{x}").alias(f"{x}_y") for x in ("sid", "n", "u", *MARKS)]).alias("y")))
    open_ = durable(postings.join(small_side(shared, shared.count(), 128), "gram"))
    stars = open_.select(*_side("x", ("sid", "n", "u", *MARKS)), "y.*").where((F.col("sid_x") != F.col("sid_y")) & _can("x", "y", percent))
    stars = durable(best_partners(_pairs(stars)))
    open_ = open_.drop("y")
    roots = durable(components(verified(stars, live, percent)))

    def now_open() -> DataFrame:
        at = open_.join(small_side(roots, roots.count()), open_["sid"] == roots["node"], "left")
        return at.select("gram", "sid", "n", "u", "pos", "suffix", *MARKS, F.coalesce("root", "sid").alias("c"))

    def joined(pairs: DataFrame) -> DataFrame:
        """The roots after these pairs too."""
        return durable(components(verified(pairs, live, percent).unionByName(roots.toDF("a", "b"))))

    tried = stars
    near = attaching_pairs(now_open(), percent).join(tried, ["a", "b"], "left_anti")
    near = durable(best_partners(near))  # what the pivots left over goes to a near member of a large component
    if not near.isEmpty():
        roots = joined(near)
        tried = durable(tried.unionByName(near))
    pairs = durable(crossing_pairs(now_open(), percent).join(tried, ["a", "b"], "left_anti"))
    for nearest in (True, False):  # the nearest pair of each class first: what it links leaves few of the others to do
        if pairs.isEmpty():
            break
        now = durable(best_partners(pairs)) if nearest else pairs
        roots = joined(now)
        if nearest:
            pairs = durable(still_apart(pairs.join(now, ["a", "b"], "left_anti"), roots))
    key = live.select("sid", "key")
    return roots.join(key, roots["node"] == key["sid"]).select("key", "root").join(key.select(F.col("sid").alias("root"), F.col("key").alias("root_key")), "root").select("key", "root_key")


def near_duplicates(docs: DataFrame, n: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id (smallest doc_id of its component), stays (one row of each)."""
    rows = parallel(isolate(docs, id_col, text_col).toDF("doc_id", "text"))
    every = durable(described(rows.select("doc_id", "text", F.xxhash64("text").alias("text_hash")), n))
    total = every.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    bits = min(64, max(32, total.bit_length() + SPARE_BITS))
    texts = texts_by_block(rows.select("text"), n, percent, cells(total, BLOCK_GRAMS))
    repeated = repeated_grams(block_counts(texts, n, bits, cells(total, BUCKET_GRAMS)))
    live, path = stored(live_classes(texts, n, repeated, percent, bits))
    moved = durable(linked(live, percent))
    release(live, path)
    every = every.join(small_side(moved, moved.count()), "key", "left").withColumn("group", F.coalesce("root_key", "key"))
    first = F.min(F.struct("doc_id", "text_hash"))
    least = every.where("group is not null").groupBy("group").agg(F.min("doc_id").alias("component_id"), first.alias("first"), F.count("*").alias("rows"))
    least = durable(least.where("rows > 1"))
    out = every.join(small_side(least, least.count()), "group", "left")
    alone = F.col("rows").isNull()
    stays = alone | (F.struct("doc_id", "text_hash").eqNullSafe(F.col("first")))
    return out.select("doc_id", "text_hash", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), stays.alias("stays"))


def drop_near_duplicates(docs: DataFrame, n: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one of each component, with all their columns."""
    plain, at, old = numbered(docs)
    found = durable(near_duplicates(docs, n, percent, id_col, text_col))
    keys = found.groupBy("doc_id", "text_hash").agg(F.bool_and("stays").alias("stays"), F.count("*").alias("copies"))
    keys = durable(keys.where("not stays or copies > 1"))
    lost, again = keys.where("not stays").select("doc_id", "text_hash"), not keys.where("stays and copies > 1").isEmpty()
    keyed = plain.withColumn("hash", F.xxhash64(at[text_col]))
    kept = keyed.join(small_side(lost, lost.count()), F.col(at[id_col]).eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("text_hash")), "left_anti")
    if again:  # equal rows of one doc_id: one of them stays
        kept = kept.dropDuplicates([at[id_col], "hash"])
    return kept.drop("hash").toDF(*old)
