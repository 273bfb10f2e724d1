"""Removal of repeated passages with a sparse suffix array.

Every 50-byte string has one anchor: its leftmost 16-byte gram of least hash. So
equal strings have equal anchors at equal places, and it is enough to sort the
suffixes that start at anchors, about one in eighteen, each with the few bytes
around it that its strings reach. Grams that no second document has are dropped
first. The rest is dealt to buckets by splitters sampled from leading tokens,
sorted in each bucket by multikey quicksort, and compared between neighbours:
equal contexts share a document, and contexts that only share their gram are
compared string by string. Grams at very many anchors would fill a bucket;
their strings are compared by hash in all buckets instead. A splitter is a whole gram, so suffixes that could
share a string are never on two sides of a boundary.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StructType

from tidewell.llm.common import by_whole_text, materialise, strings, table

#: Length of the strings, of the grams, and the number of grams in a string.
LENGTH, GRAM = 50, 16
WINDOW = LENGTH - GRAM + 1
RIGHT_WORDS, LEFT_WORDS = 7, 5  # 8-byte words of a suffix's right and left context, lengths included
#: Bytes of text in a block, and for each shard, of a table of 100 MB; a task holds some twenty times as much.
#: Both grow with the square root of the table up to MOST times that, so there are as many pairs of them as there are bytes.
BLOCK_BYTES, SHARD_BYTES, MOST = 1_000_000, 2_400_000, 8.0
#: Grams at more anchors than that are compared string by string over all shards.
HOT = 20_000
SAMPLE = 50_000
#: Grams sampled for each shard at least, so that there are as many splitters as shards.
SAMPLES_EACH = 4
#: Text is searched for anchors in stretches of half as many bytes as these bits count.
PLACE_BITS = 20


def _pack(**arrays: np.ndarray) -> bytes:
    return zstandard.compress(pickle.dumps(arrays, 5), 3)


def _unpack(data: bytes) -> dict[str, np.ndarray]:
    return pickle.loads(zstandard.decompress(data))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(32)


class Anchors:
    """The anchors of a block's documents: gram hash, place, document and the first and last string of each."""

    def __init__(self, text: np.ndarray, lengths: np.ndarray):
        """text: uint8, the documents one after the other."""
        self.text, self.lengths = text, lengths
        ends = np.cumsum(lengths)
        self.starts = ends - lengths
        parts = []
        n, step = len(text), 1 << PLACE_BITS - 1
        for low in range(0, max(0, n - LENGTH + 1), step):
            high = min(low + step, n - LENGTH + 1)
            hashes = self._grams(text[low : high + LENGTH - 1])
            at = self._least(hashes)
            parts.append((at + low, hashes[at]))
        if parts:
            at, hashes = (np.concatenate(x) for x in zip(*parts, strict=True))
        else:
            at, hashes = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        first = np.arange(len(at))
        valid = np.ones(len(at), bool)
        # strings that reach over a document's end are none
        for end in ends[:-1][ends[:-1] < n].tolist():
            valid[max(0, end - LENGTH + 1) : end] = False
        first = first[valid]
        at, hashes = at[valid], hashes[valid]
        new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (first[1:] != first[:-1] + 1)]) if len(at) else np.zeros(0, np.int64)
        self.at, self.hash, self.first = at[new], hashes[new], first[new]
        self.last = first[np.r_[new[1:], len(at)] - 1] if len(at) else first
        self.doc = np.searchsorted(ends, self.at, side="right")

    @staticmethod
    def _grams(text: np.ndarray) -> np.ndarray:
        """Hash of the gram at each place."""
        two = text[:-1].astype(np.uint64) | text[1:].astype(np.uint64) << np.uint64(8)
        four = two[:-2] | two[2:] << np.uint64(16)
        eight = four[:-4] | four[4:] << np.uint64(32)
        hashes = eight[:-8] * np.uint64(0x9E3779B97F4A7C15)
        hashes += eight[8:] * np.uint64(0xC2B2AE3D27D4EB4F)
        hashes ^= hashes >> np.uint64(32)
        hashes *= np.uint64(0xBF58476D1CE4E5B9)
        hashes ^= hashes >> np.uint64(29)
        return hashes

    @staticmethod
    def _least(hashes: np.ndarray) -> np.ndarray:
        """For each string the place of its gram of least leading hash bits, the leftmost of equals."""
        place = np.uint64((1 << PLACE_BITS) - 1)
        value, size = hashes & ~place | np.arange(len(hashes), dtype=np.uint64), 1
        while size < WINDOW:
            step = min(size, WINDOW - size)
            value = np.minimum(value[:-step], value[step:])
            size += step
        return (value & place).astype(np.int64)


def contexts(a: Anchors, rows: np.ndarray) -> np.ndarray:
    """A row of big-endian words for each anchor of rows: the suffix as far as its strings reach, then what is before it, reversed."""
    n = len(rows)
    right, left = a.last[rows] + LENGTH - a.at[rows], a.at[rows] - a.first[rows]
    padded = np.concatenate([np.zeros(64, np.uint8), a.text, np.zeros(64, np.uint8)])
    out = np.zeros((n, 8 * (RIGHT_WORDS + LEFT_WORDS)), np.uint8)
    base = a.at[rows] + 64
    for k in range(LENGTH):
        out[:, k] = np.where(k < right, padded[base + k], 0)
    out[:, 8 * RIGHT_WORDS - 1] = right
    for k in range(WINDOW - 1):
        out[:, 8 * RIGHT_WORDS + k] = np.where(k < left, padded[base - 1 - k], 0)
    out[:, -1] = left
    return out


def multikey_quicksort(words: np.ndarray) -> np.ndarray:
    """Order of the rows of words (n x k, unsigned), column by column.

    Three-way partitioning by one word at a time: rows below and above the
    pivot go on with the same word, equal ones with the next. All segments of
    a round are partitioned together.
    """
    n, width = words.shape
    order = np.arange(n)
    starts, sizes, depths = np.array([0]), np.array([n]), np.array([0])
    while True:
        open_ = (sizes > 1) & (depths < width)
        starts, sizes, depths = starts[open_], sizes[open_], depths[open_]
        if not len(starts):
            return order
        owner = np.repeat(np.arange(len(starts)), sizes)
        places = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[owner]
        rows = order[places]
        key = words[rows, depths[owner]]
        thirds = [words[order[starts + sizes * f // 4], depths] for f in (1, 2, 3)]
        pivot = np.maximum(np.minimum(thirds[0], thirds[1]), np.minimum(np.maximum(thirds[0], thirds[1]), thirds[2]))[owner]
        side = (key > pivot).astype(np.int64) + (key >= pivot)
        slot = owner * 3 + side
        counts = np.bincount(slot, minlength=3 * len(starts))
        order[places] = rows[np.argsort(slot, kind="stable")]
        begins = np.repeat(starts, 3) + (np.cumsum(counts.reshape(-1, 3), axis=1) - counts.reshape(-1, 3)).ravel()
        depths = np.repeat(depths, 3) + np.tile([0, 1, 0], len(starts))
        starts, sizes = begins, counts


_B = 0x100000001B3


def _strings(rows: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(bytes before the anchor, rows, hashes) of the strings of context rows.

    Strings with as many bytes before their anchor come at a time; the hash of
    a row's string rolls on from one to the next.
    """
    right, left = rows[:, 8 * RIGHT_WORDS - 1].astype(np.int64), rows[:, -1].astype(np.int64)
    after = np.ascontiguousarray(rows[:, :LENGTH].T)
    before = np.ascontiguousarray(rows[:, 8 * RIGHT_WORDS : 8 * RIGHT_WORDS + WINDOW - 1].T)
    back, first = np.uint64(pow(_B, -1, 1 << 64)), np.uint64(pow(_B, LENGTH - 1, 1 << 64))
    rolled = np.zeros(len(rows), np.uint64)
    for k in range(LENGTH):
        rolled = rolled * np.uint64(_B) + after[k] + np.uint64(1)
    for k in range(WINDOW):
        if k:
            rolled = (rolled - after[LENGTH - k] - np.uint64(1)) * back + (before[k - 1] + np.uint64(1)) * first
        has = np.flatnonzero((k <= left) & (LENGTH - k <= right))
        if len(has):
            yield k, has, _mix(rolled[has])


def _string_runs(rows: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs (row, bytes before the anchor, smallest document) over the strings of context rows."""
    last = np.full(len(rows), -1)
    known = np.zeros(len(rows), bool)
    out = []
    for k, has, hashes in _strings(rows):
        order = np.argsort(hashes, kind="stable")
        new = np.flatnonzero(np.r_[True, hashes[order[1:]] != hashes[order[:-1]]])
        doc = np.empty(len(has), np.int64)
        doc[order] = np.repeat(np.minimum.reduceat(least[has][order], new), np.diff(np.r_[new, len(has)]))
        change = ~known[has] | (doc != last[has])
        last[has], known[has] = doc, True
        out.append((has[change], np.full(int(change.sum()), k), doc[change]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


class _HotStrings:
    """The distinct strings of a block's contexts with a hot gram, in the order of their hashes."""

    def __init__(self, made: np.ndarray):
        parts = [(np.full(len(has), k), has, hashes) for k, has, hashes in _strings(made)]
        none = np.zeros(0, np.int64)
        self.before, self.row, hashes = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (none, none, none.astype(np.uint64))
        # strings of other places in their rows are other strings: their anchors differ
        self.hash, self.of = np.unique(hashes + self.before.astype(np.uint64), return_inverse=True)

    def least(self, docs: np.ndarray) -> np.ndarray:
        out = np.full(len(self.hash), np.iinfo(np.int64).max)
        np.minimum.at(out, self.of, docs[self.row])
        return out


def first_documents(rows: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs (row, bytes before the anchor, smallest document) over the strings of context rows.

    A run holds from its number of bytes before the anchor up to the row's next
    run. docs: the smallest document of each row.
    """
    words = np.ascontiguousarray(rows).view(">u8").astype(np.uint64)
    order = multikey_quicksort(words)
    same = np.r_[False, (words[order[1:]] == words[order[:-1]]).all(axis=1)] if len(order) else np.zeros(0, bool)
    unique = np.cumsum(~same) - 1
    heads = order[~same]
    least = np.full(len(heads), np.iinfo(np.int64).max)
    np.minimum.at(least, unique, docs[order])
    of = np.empty(len(order), np.int64)
    of[order] = unique
    # neighbours that share their gram, but not their context, are compared string by string
    gram = words[heads, :2]
    shared = np.r_[False, (gram[1:] == gram[:-1]).all(axis=1)] if len(heads) else np.zeros(0, bool)
    mixed = np.flatnonzero(shared | np.r_[shared[1:], False]) if len(heads) else np.zeros(0, np.int64)
    low = rows[heads, 8 * RIGHT_WORDS - 1].astype(np.int64)
    run_row, run_from, run_doc = [np.setdiff1d(np.arange(len(heads)), mixed)], [], []
    run_from.append((LENGTH - low)[run_row[0]])
    run_doc.append(least[run_row[0]])
    row, before, doc = _string_runs(rows[heads[mixed]], least[mixed])
    run_row.append(mixed[row])
    run_from.append(before)
    run_doc.append(doc)
    run_row, run_from, run_doc = (np.concatenate(x) for x in (run_row, run_from, run_doc))
    o = np.lexsort((run_from, run_row))
    run_row, run_from, run_doc = run_row[o], run_from[o], run_doc[o]
    # from the distinct contexts back to all rows
    counts = np.bincount(run_row, minlength=len(heads))
    begins = np.cumsum(counts) - counts
    many = counts[of]
    index = np.repeat(begins[of] - (np.cumsum(many) - many), many) + np.arange(many.sum())
    return np.repeat(np.arange(len(rows)), many), run_from[index], run_doc[index]


_MESSAGE = "shard int, block long, body binary"


def _messages(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], ["shard", "block", "body"])


def _by_shard(messages: DataFrame, answer: Callable[[list[dict]], Iterator[dict]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, blocks, bodies = None, [], []
        for batch in batches:
            for n in range(batch.num_rows):
                s, b, body = (batch.column(k)[n].as_py() for k in range(3))
                if s != shard and blocks:
                    yield from made_for(shard, blocks, bodies)
                    blocks, bodies = [], []
                shard = s
                blocks.append(b)
                bodies.append(_unpack(body))
        if blocks:
            yield from made_for(shard, blocks, bodies)

    def made_for(shard: int, blocks: list[int], bodies: list[dict]) -> Iterator[pa.RecordBatch]:
        for block, made in zip(blocks, answer(bodies), strict=True):
            yield _messages([(shard, block, _pack(**made))])

    return messages.repartition("shard").sortWithinPartitions("shard", "block").mapInArrow(run, _MESSAGE)


def _blocks(docs: DataFrame, key: str, text: str, block_bytes: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        keys, texts, size = [], [], 0

        def made() -> pa.RecordBatch:
            body = zstandard.compress(b"".join(texts), 3)
            return pa.RecordBatch.from_arrays([pa.array([part << 24 | number]), pa.array([keys], pa.list_(pa.int64())), pa.array([[len(t) for t in texts]], pa.list_(pa.int64())), pa.array([body], pa.binary())], ["block", "keys", "lengths", "body"])

        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), strings(batch.column(1)), strict=True):
                keys.append(k)
                texts.append(t)
                size += len(t) + 64
                if size >= block_bytes:
                    yield made()
                    number += 1
                    keys, texts, size = [], [], 0
        if keys:
            yield made()

    return by_whole_text(docs).select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).mapInArrow(run, "block long, keys array<bigint>, lengths array<bigint>, body binary")


class _Block:
    def __init__(self, row: dict):
        self.block, self.lengths = row["block"], np.array(row["lengths"], np.int64)
        #: A document without an id is neither smaller nor greater than another: it keeps all and covers nothing.
        self.named = np.array([k is not None for k in row["keys"]], bool)
        self.keys = np.array([k if k is not None else 0 for k in row["keys"]], np.int64)
        self.text = np.frombuffer(zstandard.decompress(row["body"]), np.uint8)
        self.anchors = Anchors(self.text, self.lengths)

    def grams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct gram hashes, whether two documents of the block have them, at how many anchors they are, and the gram of each anchor (-1 without an id)."""
        a = self.anchors
        live = np.flatnonzero(self.named[a.doc])
        hashes, of = np.unique(a.hash[live], return_inverse=True)
        key = self.keys[a.doc[live]]
        low, high = np.full(len(hashes), np.iinfo(np.int64).max), np.full(len(hashes), np.iinfo(np.int64).min)
        np.minimum.at(low, of, key)
        np.maximum.at(high, of, key)
        gram = np.full(len(a.at), -1)
        gram[live] = of
        return hashes, low < high, np.bincount(of, minlength=len(hashes)), gram

    def suffixes(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct contexts of the anchors with a wanted gram, their smallest document, those anchors, and the context of each."""
        *_, gram = self.grams()
        rows = np.flatnonzero((gram >= 0) & wanted[gram])
        made = contexts(self.anchors, rows)
        flat = np.ascontiguousarray(made).view(f"V{made.shape[1]}").ravel()
        _, first, of = np.unique(_row_hash(made), return_index=True, return_inverse=True)
        if len(flat) and not (flat[first[of]] == flat).all():  # two contexts of one hash
            _, first, of = np.unique(flat, return_index=True, return_inverse=True)
        least = np.full(len(first), np.iinfo(np.int64).max)
        np.minimum.at(least, of, self.keys[self.anchors.doc[rows]])
        return made[first], least, rows, of


    def cover(self, covered: np.ndarray, rows: np.ndarray, of: np.ndarray, context: np.ndarray, begin: np.ndarray, doc: np.ndarray) -> None:
        """Add the strings to go to covered, as steps up and down.

        rows, of: anchors and the context of each; context, begin, doc: runs of
        strings and their smallest document.
        """
        a = self.anchors
        o = np.lexsort((begin, context))
        context, begin, doc = context[o].astype(np.int64), begin[o].astype(np.int64), doc[o]
        end = np.where(np.r_[context[1:] == context[:-1], False], np.r_[begin[1:], 0] - 1, WINDOW - 1)
        counts = np.bincount(context, minlength=int(of.max(initial=-1)) + 1)
        many = counts[of]
        index = np.repeat((np.cumsum(counts) - counts)[of] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        anchor = np.repeat(rows, many)
        gone = doc[index] < self.keys[a.doc[anchor]]
        anchor, index = anchor[gone], index[gone]
        # from begin to end bytes before the anchor, as far as the anchor has such strings
        first = np.maximum(a.at[anchor] - end[index], a.first[anchor])
        last = np.minimum(a.at[anchor] - begin[index], a.last[anchor]) + LENGTH
        np.add.at(covered, first, 1)
        np.add.at(covered, last, -1)


def _row_hash(rows: np.ndarray) -> np.ndarray:
    words = np.ascontiguousarray(rows).view("<u8")
    out = np.zeros(len(rows), np.uint64)
    for k in range(words.shape[1]):
        out = _mix(out + words[:, k])
    return out


def _planes(x: np.ndarray) -> np.ndarray:
    """Bytes of the differences of an ascending sequence, one plane after another; they compress well."""
    return np.ascontiguousarray(np.diff(x, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T)


def _from_planes(planes: np.ndarray) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8")[:, 0], dtype=np.uint64)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for n in range(batch.num_rows):
            yield batch.slice(n, 1).to_pylist()[0]


def remove_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_removed, n_spans and kept_sha256 of each row of docs; the key is an integer.

    Each byte goes that is covered by a 50-byte string of its document which
    also starts in a document of a smaller key. A null text is empty; a text
    under 50 bytes stays whole; a document with a null key stays whole and
    removes nothing; rows of one key don't remove from each other. On an empty
    table the result is empty. Grams, contexts and strings are told apart by
    64-bit hashes where sets of them are matched.

    A block sends a distinct gram, and a distinct context, once. Contexts with
    a gram at more than HOT anchors don't meet in one bucket: their strings,
    each distinct one of a block once, are spread over all buckets by hash.
    """
    spark = docs.sparkSession
    if not isinstance(docs.schema[key].dataType, IntegralType):
        raise ValueError(f"{key} must be an integer column, not {docs.schema[key].dataType.simpleString()}")
    chars = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    growth = min(MOST, max(1.0, (chars / 1e8) ** 0.5))
    blocks = materialise(_blocks(docs, key, text, int(BLOCK_BYTES * growth)))
    sizes = blocks.select("block", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    number, total = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    shards = max(1, -(-total // int(SHARD_BYTES * growth)))
    wanted = max(SAMPLE, SAMPLES_EACH * shards)
    each = max(1, -(-wanted // max(1, number)))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            data = zstandard.decompress(row["body"])
            places = np.random.default_rng(row["block"]).integers(0, max(1, len(data) - GRAM), each)
            found = [data[k : k + GRAM] for k in places.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["gram"])

    share = min(1.0, wanted / max(1, number))  # with more blocks than samples, some blocks give one each
    asked = blocks.select("block", "body").where(F.pmod(F.xxhash64("block"), F.lit(1 << 20)) < int(share * (1 << 20)))
    drawn = sorted(r["gram"] for r in asked.mapInArrow(sample, "gram binary").collect())
    cuts = sorted({drawn[len(drawn) * k // shards] for k in range(1, shards)}) if drawn else []
    splitters = np.array(cuts, f"S{GRAM}")

    def ask_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            block = _Block(row)
            hashes, two, count, _ = block.grams()
            owner = ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
            starts = np.searchsorted(owner, np.arange(shards + 1))
            for s in np.flatnonzero(np.diff(starts)).tolist():
                a, b = starts[s], starts[s + 1]
                yield _messages([(s, block.block, _pack(at=np.array([a, b]), planes=_planes(hashes[a:b]), two=np.packbits(two[a:b]), n=np.minimum(count[a:b], 65535).astype(np.uint16)))])

    def answer_grams(asked: list[dict]) -> Iterator[dict]:
        hashes = [_from_planes(m["planes"]) for m in asked]
        _, of, counts = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
        hot = np.bincount(of, np.concatenate([m["n"] for m in asked])) > HOT
        at = 0
        for m, h in zip(asked, hashes, strict=True):
            two, mine = np.unpackbits(m["two"], count=len(h)).astype(bool), of[at : at + len(h)]
            yield {"at": m["at"], "repeated": np.packbits(two | (counts[mine] > 1)), "hot": np.packbits(hot[mine])}
            at += len(h)

    def met(answers: DataFrame) -> DataFrame:
        """Each block with what came back for it."""
        return answers.groupBy("block").agg(F.collect_list("body").alias("bodies"))

    def kinds_of(row: dict, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Which of the block's grams are repeated and not hot, and which are repeated and hot."""
        repeated, hot = np.zeros(size, bool), np.zeros(size, bool)
        for m in map(_unpack, row["grams"] or []):
            a, b = m["at"].tolist()
            repeated[a:b] = np.unpackbits(m["repeated"], count=b - a).astype(bool)
            hot[a:b] = np.unpackbits(m["hot"], count=b - a).astype(bool)
        return repeated & ~hot, repeated & hot

    grams = materialise(met(_by_shard(blocks.mapInArrow(ask_grams, _MESSAGE), answer_grams)).withColumnRenamed("bodies", "grams"))

    def ask_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            block = _Block(row)
            cold, hot = kinds_of(row, len(block.grams()[0]))
            made, least, *_ = block.suffixes(cold)
            order = multikey_quicksort(np.ascontiguousarray(made).view(">u8").astype(np.uint64)[:, :2])  # sorted, they compress better
            lead = np.ascontiguousarray(made[:, :GRAM]).view(f"S{GRAM}").ravel()
            owner = np.searchsorted(splitters, lead, side="right")
            cut = np.argsort(owner[order], kind="stable")
            order = order[cut]
            starts = np.searchsorted(owner[order], np.arange(len(splitters) + 2))
            for s in np.flatnonzero(np.diff(starts)).tolist():
                mine = order[starts[s] : starts[s + 1]]
                yield _messages([(s, block.block, _pack(at=mine.astype(np.uint32), rows=made[mine], docs=least[mine]))])
            if hot.any():
                made, least, *_ = block.suffixes(hot)
                strings = _HotStrings(made)
                least, owner = strings.least(least), (strings.hash % np.uint64(shards)).astype(np.int64)
                for s in np.unique(owner).tolist():
                    mine = np.flatnonzero(owner == s)
                    yield _messages([(s, block.block, _pack(at=mine.astype(np.uint32), hash=strings.hash[mine], docs=least[mine]))])

    def answer_contexts(asked: list[dict]) -> Iterator[dict]:
        spread = [m for m in asked if "hash" in m]
        if spread:
            _, of = np.unique(np.concatenate([m["hash"] for m in spread]), return_inverse=True)
            docs_of = np.full(int(of.max()) + 1, np.iinfo(np.int64).max)
            np.minimum.at(docs_of, of, np.concatenate([m["docs"] for m in spread]))
            for m, mine in zip(spread, np.split(of, np.cumsum([len(m["at"]) for m in spread])[:-1]), strict=True):
                m["least"] = docs_of[mine]
        rows = [m for m in asked if "hash" not in m]
        if rows:
            row, begin, doc = first_documents(np.concatenate([m["rows"] for m in rows]), np.concatenate([m["docs"] for m in rows]))
        at = 0
        for m in asked:
            if "hash" in m:
                yield {"string": m["at"], "doc": m["least"]}
                continue
            a, b = np.searchsorted(row, [at, at + len(m["at"])])
            yield {"row": m["at"][row[a:b] - at], "from": begin[a:b].astype(np.uint8), "doc": doc[a:b]}
            at += len(m["at"])

    known = blocks.join(grams, "block", "left")
    runs = materialise(met(_by_shard(known.mapInArrow(ask_contexts, _MESSAGE), answer_contexts)).withColumnRenamed("bodies", "runs"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            block = _Block(row)
            a = block.anchors
            cold, hot = kinds_of(row, len(block.grams()[0]))
            _, _, rows, of = block.suffixes(cold)
            got = [_unpack(m) for m in row["runs"] or []]
            covered = np.zeros(len(block.text) + 1, np.int32)
            runs = [m for m in got if "row" in m]
            if runs:
                block.cover(covered, rows, of, *(np.concatenate([m[k] for m in runs]) for k in ("row", "from", "doc")))
            spread = [m for m in got if "string" in m]
            if spread:
                made, _, rows, of = block.suffixes(hot)
                strings = _HotStrings(made)
                doc = np.full(len(strings.hash), np.iinfo(np.int64).max)
                doc[np.concatenate([m["string"] for m in spread])] = np.concatenate([m["doc"] for m in spread])
                block.cover(covered, rows, of, strings.row, strings.before, doc[strings.of])
            covered = np.cumsum(covered[:-1], dtype=np.int32) > 0
            edge = np.r_[covered[:1], covered[1:] & ~covered[:-1]]
            edge[a.starts[(a.starts < len(edge))]] = covered[a.starts[a.starts < len(edge)]]
            sums, edges = (np.concatenate([[0], np.cumsum(x, dtype=np.int32)]) for x in (covered, edge))
            ends = a.starts + block.lengths
            removed, spans = sums[ends] - sums[a.starts], edges[ends] - edges[a.starts]
            digests = []
            for s, e, gone in zip(a.starts.tolist(), ends.tolist(), removed.tolist(), strict=True):
                piece = block.text[s:e]
                digests.append(hashlib.sha256(piece[~covered[s:e]] if gone else piece).hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(row["keys"], pa.int64()), pa.array(block.lengths), pa.array(removed.astype(np.int64)), pa.array(spans.astype(np.int64)), pa.array(digests)], schema.names)

    schema = StructType.fromDDL("n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    schema = StructType([StructType.fromDDL("k long")["k"], *schema.fields])
    return spark.createDataFrame([], schema).limit(0).withColumnRenamed("k", key) if not number else known.join(runs, "block", "left").mapInArrow(finish, schema).withColumnRenamed("k", key)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document less its bytes that a document before it has."""
    return remove_repeats(table(spark, sf_dir, "documents"))


ORACLE_SQL = """
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
chunks AS (SELECT r, doc_id, length(h) // 2 AS n, c, substr(h, 1024 * c + 1, 1024 + 98) AS part FROM (SELECT *, unnest(range(CAST((length(h) + 1023) // 1024 AS BIGINT))) AS c FROM docs)),
strings AS (SELECT r, doc_id, 512 * c + j AS i, CASE WHEN 512 * c + j + 50 <= n THEN substr(part, 2 * j + 1, 100) END AS s, substr(part, 2 * j + 1, 2) AS b
  FROM (SELECT *, unnest(range(least(512, n - 512 * c))) AS j FROM chunks)),
first AS (SELECT s, min(doc_id) AS d FROM strings WHERE s IS NOT NULL AND doc_id IS NOT NULL GROUP BY s),
gone AS (SELECT t.r, t.i, t.b, coalesce(f.d < t.doc_id, false) AS starts FROM strings t LEFT JOIN first f ON t.s = f.s),
covered AS (SELECT r, i, b, coalesce(bool_or(starts) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), false) AS c FROM gone),
edges AS (SELECT r, i, b, c, c AND NOT coalesce(lag(c) OVER (PARTITION BY r ORDER BY i), false) AS e FROM covered),
kept AS (SELECT r, count(*) FILTER (c) AS n_removed, count(*) FILTER (e) AS n_spans, coalesce(string_agg(b, '' ORDER BY i) FILTER (NOT c), '') AS k FROM edges GROUP BY r)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, coalesce(k.n_removed, 0) AS n_removed, coalesce(k.n_spans, 0) AS n_spans, sha256(unhex(coalesce(k.k, ''))) AS kept_sha256
FROM docs d LEFT JOIN kept k ON d.r = k.r
"""
