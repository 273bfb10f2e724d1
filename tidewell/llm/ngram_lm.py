"""An n-gram language model in Elias-Fano trie shards.

The corpus is read once into blocks of documents. Word numbers come from word
shards, dealt by hash. Then every block sends each of its distinct n-grams
once, with its training count, to the shard of its last context word. All
n-grams with that word as nearest context are there, so the shard can lay out
the levels of its trie: bigrams under the word, longer ones under longer
contexts, each successor written as its place among the successors of the
shorter context. Contexts, monotone pointers and successors are Elias-Fano
sequences, probabilities are smoothed with the level below and quantised, and
the whole is memory-mapped. The shard answers each block by a successor search
inside the context's range.
"""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Callable, Iterable, Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, LongType, StructField, StructType

from tidewell.llm.common import by_whole_text, discard, materialise, strings, table
from tidewell.llm.language_id import held_out

#: Hash of the end of a document; no word contains white space.
END = xxhash.xxh64_intdigest(b"\n")
#: Numbers of rows that aren't a block's: what a shard stores, and counts that it needs from elsewhere.
STORED, WIDE = -2, -1
#: Answers are log10 probabilities in so many parts.
PARTS = 4096


@dataclass(frozen=True)
class Settings:
    """prior[n-2]: how many observations of an n-gram's context the estimate of the next shorter context stands for.

    Blocks and shards grow with the square root of the table, from the given
    sizes for 100 million characters up to eight times those; so there are as
    many pairs of them as there are characters, and a task stays bounded.
    """

    order: int = 3
    prior: tuple[float, ...] = (8.0, 4.0, 4.0)
    add: float = 0.1
    levels: int = 255  # quantisation steps of a log probability
    block_chars: int = 2_300_000
    shard_tokens: int = 280_000

    def grown(self, size: int, chars: int) -> int:
        return int(size * min(8.0, max(1.0, (chars / 1e8) ** 0.5)))


_FIVES, _THREES, _FIFTEENS, _ONES, _TOPS = (np.uint64(x * 0x0101010101010101) for x in (0x55, 0x33, 0x0F, 0x01, 0x80))
#: Place of the k-th set bit of each byte.
_PLACES = np.array([([k for k in range(8) if b >> k & 1] + [0] * 8)[:8] for b in range(256)], np.int64)


class EliasFano:
    """A monotone sequence of n values below u: low bits packed, and a unary bit vector of the rest."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.low, self.high, self.ones = arrays["low"], arrays["high"], arrays["ones"]
        self.width, self.n = int(arrays["meta"][0]), int(arrays["meta"][1])

    @staticmethod
    def build(values: np.ndarray) -> dict[str, np.ndarray]:
        n = len(values)
        values = values.astype(np.uint64)
        width = max(0, (int(values[-1]) // n).bit_length() - 1) if n else 0
        flat = np.zeros(n * width, np.uint8)
        for k in range(width):
            flat[k::width] = values >> np.uint64(k) & np.uint64(1)
        low = np.zeros(n * width // 64 + 2, "<u8")
        low.view(np.uint8)[: -(-n * width // 8)] = np.packbits(flat, bitorder="little")
        places = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        size = (int(places[-1]) // 64 + 2) * 64 if n else 64
        bits = np.zeros(size, np.uint8)
        bits[places] = 1
        words = np.packbits(bits, bitorder="little").view("<u8")
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(words))]).astype(np.uint32)
        return {"low": low, "high": words, "ones": ones, "meta": np.array([width, n], np.int64)}

    def _select(self, k: np.ndarray, of_ones: bool) -> np.ndarray:
        """Position of the k-th (from 0) one, or zero, bit."""
        before = self.ones.astype(np.int64) if of_ones else np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones
        word = np.searchsorted(before, k, side="right") - 1
        word = np.minimum(word, len(self.high) - 1)
        left, bits = (k - before[word]).astype(np.uint64), self.high[word] if of_ones else ~self.high[word]
        # counts of set bits up to the end of each byte, then the byte, then the place in it
        up_to = bits - (bits >> np.uint64(1) & _FIVES)
        up_to = (up_to & _THREES) + (up_to >> np.uint64(2) & _THREES)
        up_to = (up_to + (up_to >> np.uint64(4)) & _FIFTEENS) * _ONES
        byte = np.uint64(8) - np.bitwise_count((up_to | _TOPS) - (left + np.uint64(1)) * _ONES & _TOPS).astype(np.uint64)
        byte = np.minimum(byte, np.uint64(7)) << np.uint64(3)
        left -= up_to << np.uint64(8) >> byte & np.uint64(255)
        at = _PLACES[(bits >> byte & np.uint64(255)).astype(np.int64), np.minimum(left, np.uint64(7)).astype(np.int64)]
        return word * 64 + byte.astype(np.int64) + at

    def _lows(self, at: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(at), np.int64)
        bit = at.astype(np.uint64) * np.uint64(self.width)
        word, off = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
        above = np.where(off > 0, self.low[word + 1] << (np.uint64(64) - off & np.uint64(63)), np.uint64(0))
        return ((self.low[word] >> off | above) & np.uint64((1 << self.width) - 1)).astype(np.int64)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self._select(at, True) - at) << self.width | self._lows(at)

    def successor(self, values: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first value >= each of values within [first, last), last if there is none, and whether it is that value."""
        top = values >> self.width
        most = int(self.ones[-1])
        zeros = len(self.high) * 64 - most
        end = np.where(top < zeros, self._select(np.minimum(top, zeros - 1), False) - top, self.n)
        start = np.where(top > 0, self._select(np.clip(top - 1, 0, zeros - 1), False) - np.maximum(top - 1, 0), 0)
        start = np.where(top > zeros, self.n, start)
        lo, hi = np.clip(start, first, last), np.clip(end, first, last)
        want, stop = values & ((1 << self.width) - 1), hi
        rows = np.flatnonzero(lo < hi)
        while len(rows):  # those whose range isn't down to one place
            a, z = lo[rows], hi[rows]
            mid = (a + z) // 2
            less = self._lows(mid) < want[rows]
            lo[rows] = a = np.where(less, mid + 1, a)
            hi = hi.copy() if hi is stop else hi
            hi[rows] = z = np.where(less, z, mid)
            rows = rows[a < z]
        hit = lo < stop
        hit[hit] = self._lows(lo[hit]) == want[hit]
        return lo, hit


@dataclass(frozen=True)
class Scale:
    """Quantised log10 probabilities: codes 0 to levels-1, 0 for probability 1, the last for 10**least."""

    least: float
    levels: int

    @staticmethod
    def of(mass: float, spec: Settings) -> Scale:
        """Wide enough for the least probability there is, that of an unknown word."""
        return Scale(float(np.floor(np.log10(min(spec.add, 1.0) / mass))) - 1.0, spec.levels)

    def code(self, p: np.ndarray) -> np.ndarray:
        return np.clip(np.rint(np.log10(p) / self.least * (self.levels - 1)), 0, self.levels - 1).astype(np.uint8)

    def value(self, code: np.ndarray) -> np.ndarray:
        """log10 of the code's probability."""
        return code * (self.least / (self.levels - 1))


def _packed(keys: tuple[np.ndarray, ...]) -> np.ndarray | None:
    """The keys (not negative) in the bits of one number, first key highest; None if they don't fit."""
    widths = [int(k.max(initial=0)).bit_length() for k in keys]
    if sum(widths) > 63:
        return None
    out = np.zeros(len(keys[0]), np.int64)
    for k, w in zip(keys, widths, strict=True):
        out = out << w | k
    return out


def _grouped(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in the order of the keys (first key first), the places where a new combination starts, and each row's combination."""
    one = _packed(keys)
    if one is None:  # ranks are in the order of the keys and need fewer bits
        one = _packed(tuple(np.unique(k, return_inverse=True)[1] for k in keys))
    order = np.lexsort(keys[::-1]) if one is None else np.argsort(one)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys if one is None else (one,):
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), of


def _places(asked: tuple[np.ndarray, np.ndarray], held: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Where each pair of numbers is among the held pairs (one of several), -1 if it isn't; numbers may take all 63 bits."""
    if not len(held[0]):
        return np.full(len(asked[0]), -1)
    known = np.ones(len(asked[0]), bool)
    n = len(held[0])
    both = _packed(tuple(np.r_[h, a] for a, h in zip(asked, held, strict=True)))
    if both is not None:
        keys, want = both[:n], both[n:]
    else:  # ranks need fewer bits
        keys, want = np.zeros(n, np.int64), np.zeros(len(asked[0]), np.int64)
        for a, h in zip(asked, held, strict=True):
            names, rank = np.unique(h, return_inverse=True)
            at = np.minimum(np.searchsorted(names, a), len(names) - 1)
            known &= names[at] == a
            keys, want = keys * len(names) + rank, want * len(names) + at
    order = np.argsort(keys, kind="stable")  # quick where they are sorted already
    keys = keys[order]
    at = np.minimum(np.searchsorted(keys, want), n - 1)
    return np.where(known & (keys[at] == want), order[at], -1)


class Level:
    """One level: contexts, pointers to their successors, successors, codes, and each context's back-off code."""

    def __init__(self, part: dict[str, np.ndarray]):
        self.contexts, self.pointers, self.successors = (EliasFano({k[2:]: v for k, v in part.items() if k[:2] == p}) for p in ("c_", "p_", "s_"))
        self.code, self.back, self.base = part["code"], part["back"], int(part["base"][0])
        self.width = int(part["width"][0]) if "width" in part else 0  # numbers of the words by which the next level's contexts go on

    @staticmethod
    def build(contexts: np.ndarray, starts: np.ndarray, successors: np.ndarray, code: np.ndarray, back: np.ndarray) -> dict[str, np.ndarray]:
        """contexts: distinct, ascending; starts: where the successors of each begin, which ascend in it."""
        base = int(successors.max(initial=0)) + 1
        group = np.repeat(np.arange(len(contexts)), np.diff(np.r_[starts, len(successors)]))
        return {
            **{f"c_{k}": v for k, v in EliasFano.build(contexts).items()},
            **{f"p_{k}": v for k, v in EliasFano.build(np.r_[starts, len(successors)]).items()},
            # each context's successors continue where the last one's could end
            **{f"s_{k}": v for k, v in EliasFano.build(group * base + successors).items()},
            "code": code,
            "back": back,
            "base": np.array([base], np.int64),
        }

    def context(self, values: np.ndarray) -> np.ndarray:
        """Index of each of ascending contexts, -1 if the level has none."""
        new = np.r_[True, values[1:] != values[:-1]][: len(values)]
        names, size = values[new], self.contexts.n
        if not size or not len(names):
            return np.full(len(values), -1)
        none = np.zeros(len(names), np.int64)
        at, hit = self.contexts.successor(names, none, none + size)
        return np.where(hit, at, -1)[np.cumsum(new) - 1]

    def find(self, context: np.ndarray, successors: np.ndarray) -> np.ndarray:
        """Index of each successor in its (ascending) context's range, -1 if it isn't there (or there is no context)."""
        out = np.full(len(context), -1)
        rows = np.flatnonzero((context >= 0) & (successors >= 0) & (successors < self.base))
        if not len(rows):
            return out
        c = context[rows]
        new = np.r_[True, c[1:] != c[:-1]]
        of, names = np.cumsum(new) - 1, c[new]
        found, hit = self.successors.successor(c * self.base + successors[rows], self.pointers.get(names)[of], self.pointers.get(names + 1)[of])
        out[rows[hit]] = found[hit]
        return out


class Trie:
    """The levels of a shard, memory-mapped from the bytes of ``build``."""

    def __init__(self, data: bytes, scale: Scale, prior: tuple[float, ...]):
        size = int.from_bytes(data[:8], "little")
        places = pickle.loads(data[8 : 8 + size])
        self.file = tempfile.TemporaryFile()  # a task's own, gone with it
        self.file.write(memoryview(data)[8 + size :])
        self.file.write(bytes(8))
        self.file.flush()
        mapped = np.memmap(self.file, np.uint8, "r")
        self.levels = [Level({name: mapped[o : o + n * kind.itemsize].view(kind) for name, (o, n, kind) in level.items()}) for level in places]
        self.scale, self.prior = scale, prior

    @staticmethod
    def build(grams: dict[str, np.ndarray], wide: dict[str, np.ndarray], scale: Scale, prior: tuple[float, ...]) -> bytes:
        """grams: context (columns, nearest first), word, code, count, total; distinct rows with a count.

        wide: near, word, code, total and count of the bigrams whose n-grams
        are spread over several shards, sorted by near and word.
        """
        none = np.zeros((len(wide["near"]), grams["context"].shape[1] - 1), np.int64)
        grams = {
            "context": np.concatenate([grams["context"], np.c_[wide["near"], none]]),
            "count": np.r_[grams["count"], np.zeros(len(none), np.int64)],
            **{k: np.r_[grams[k], wide[k]] for k in ("word", "code", "total")},
        }
        near, word, count = grams["context"][:, 0], grams["word"], grams["count"]
        levels, parts, at, data = [], [], 0, []
        context, back = near, np.zeros(0, np.uint8)
        lower = 10.0 ** scale.value(grams["code"])
        rows, successor = np.arange(len(word)), word
        total = grams["total"]
        for n in range(grams["context"].shape[1]):
            order, new, of = _grouped(context, successor)
            counts = np.add.reduceat(count[rows][order], new) if len(order) else np.zeros(0, np.int64)
            first = rows[order[new]]
            heads = context[order[new]]
            starts = np.flatnonzero(np.r_[True, heads[1:] != heads[:-1]]) if len(heads) else np.zeros(0, np.int64)
            group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(heads)]))
            if n == 0:
                place = _places((near[first], word[first]), (wide["near"], wide["word"]))
                counts = np.where(place >= 0, _at(wide["count"], place), counts)
                of_context = total[first]
            else:
                sums = np.add.reduceat(counts, starts) if len(starts) else np.zeros(0, np.int64)
                of_context = sums[group]
                back = scale.code(prior[n] / (sums + prior[n]))
            code = scale.code((counts + prior[n] * lower[first]) / (of_context + prior[n]))
            parts.append(Level.build(heads[starts], starts, successor[order[new]], code, back))
            if n + 1 == grams["context"].shape[1]:
                break
            # the next level's contexts are an older word under this context, its successors places among this level's
            older = grams["context"][rows, n + 1]
            long = older > 0
            lower = lower.copy()
            lower[rows] = 10.0 ** scale.value(code[of])
            width = int(grams["context"][:, n + 1].max(initial=0)) + 1
            context = (group[of] * width + older)[long]
            successor = (of - starts[group[of]])[long] if len(starts) else of[long]
            rows = rows[long]
            parts[-1]["width"] = np.array([width], np.int64)
        for part in parts:
            places = {}
            for name, value in part.items():
                at += -at % 8
                places[name], at = (at, value.size, value.dtype), at + value.nbytes
                data.append((places[name][0], np.ascontiguousarray(value)))
            levels.append(places)
        body = bytearray(at)
        for o, value in data:
            body[o : o + value.nbytes] = value.tobytes()
        head = pickle.dumps(levels, 5)
        return len(head).to_bytes(8, "little") + head + bytes(body)

    def log10(self, grams: dict[str, np.ndarray]) -> np.ndarray:
        """log10 probability of each n-gram (sorted by context, nearest first): that of its longest known context, backed off where the word is new to it."""
        near = grams["context"]
        q = self.scale.value(grams["code"])
        seen = grams["total"] > 0
        context = self.levels[0].context(near[:, 0])
        order, new, of = _grouped(context + 1, grams["word"])
        found = self.levels[0].find(context[order[new]], grams["word"][order[new]])[of]
        back = self.scale.value(self.scale.code(self.prior[0] / (grams["total"] + self.prior[0])))
        q = np.where(found >= 0, self.scale.value(_at(self.levels[0].code, found)), np.where(seen, q + back, q))
        for n in range(1, near.shape[1]):
            above, level = self.levels[n - 1], self.levels[n]
            rows = np.flatnonzero((context >= 0) & (near[:, n] > 0) & (near[:, n] < above.width))
            longer, place = np.full(len(q), -1), np.full(len(q), -1)
            longer[rows] = level.context(context[rows] * above.width + near[rows, n])
            inside = np.flatnonzero((longer >= 0) & (found >= 0))
            c = context[inside]
            first = np.r_[True, c[1:] != c[:-1]][: len(c)]
            place[inside] = found[inside] - above.pointers.get(c[first])[np.cumsum(first) - 1]
            found = level.find(longer, place)
            q = np.where(found >= 0, self.scale.value(_at(level.code, found)), np.where(longer >= 0, q + self.scale.value(_at(level.back, longer)), q))
            context = longer
        return q


def _at(values: np.ndarray, index: np.ndarray) -> np.ndarray:
    return values[np.maximum(index, 0)].astype(np.int64) if len(values) else np.zeros(len(index), np.int64)


def _pack(**arrays: np.ndarray) -> bytes:
    """Signed arrays as zigzag differences, unsigned ones as they are, a byte of all values after another.

    Sorted and repeated values take little. Hashes (64 bits) and scalars aren't split.
    """
    parts, kinds = {}, {}
    for name, x in arrays.items():
        if x.dtype == np.uint64 or not x.ndim:
            parts[name] = x
            continue
        kinds[name] = x.dtype.kind == "u"
        steps = x.astype(np.uint64)
        if not kinds[name]:
            steps = np.diff(x.astype(np.int64), prepend=0)
            steps = (steps << 1 ^ steps >> 63).view(np.uint64)
        used = max(1, -(-int(steps.max(initial=0)).bit_length() // 8))
        parts[name] = np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :used].T)
    return zstandard.compress(pickle.dumps((parts, kinds), 5), 3)


def _plain(x: np.ndarray) -> np.ndarray:
    """Numbers without an order, which _pack had better keep as they are; from 2**32 on it takes their differences."""
    return x.astype(np.uint32) if x.max(initial=0) < 1 << 32 else x


def _unpack(data: bytes) -> dict[str, np.ndarray]:
    parts, kinds = pickle.loads(zstandard.decompress(data))
    for name, plain in kinds.items():
        planes = parts[name]
        wide = np.zeros((planes.shape[1], 8), np.uint8)
        wide[:, : len(planes)] = planes.T
        steps = wide.view("<u8")[:, 0]
        parts[name] = steps.astype(np.int64) if plain else np.cumsum((steps >> np.uint64(1)).astype(np.int64) ^ -(steps & np.uint64(1)).astype(np.int64))
    return parts


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _block_schema(kind) -> StructType:
    return StructType([
        StructField("block", LongType()),
        StructField("keys", ArrayType(kind)),
        StructField("held", ArrayType(BooleanType())),
        StructField("body", BinaryType()),
        StructField("tokens", LongType()),
        StructField("trained", LongType()),
    ])


def _blocks(docs: DataFrame, key: str, text: str, held: str, block_chars: int) -> DataFrame:
    """Blocks of documents as word numbers of the block's own word list."""
    rows = docs.select(F.col(key).alias("key"), F.col(held).alias("held"), F.col(text).alias("text"))
    schema = _block_schema(rows.schema["key"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        words, keys, held, bodies, chars = _Words(), [], [], [], 0
        words[b"\n"] = 0

        def made() -> pa.RecordBatch:
            lengths = np.array([len(b) for b in bodies], np.int32)
            hashes = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)
            body = _pack(lengths=lengths, tokens=np.concatenate(bodies).astype(np.uint32), words=hashes)
            trained = int(lengths[~np.array(held)].sum())
            return pa.RecordBatch.from_arrays([pa.array([part << 24 | number]), pa.array([keys], pa.list_(kind)), pa.array([held]), pa.array([body], pa.binary()), pa.array([int(lengths.sum())]), pa.array([trained])], schema.names)

        for batch in batches:
            kind = batch.schema.field(0).type
            for k, h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strings(batch.column(2)), strict=True):
                ids = [words[w] for w in t.lower().split()]
                ids.append(0)
                bodies.append(np.array(ids, np.uint32))
                keys.append(k)
                held.append(bool(h))
                chars += len(t) + 64
                if chars >= block_chars:
                    yield made()
                    number += 1
                    words, keys, held, bodies, chars = _Words(), [], [], [], 0
                    words[b"\n"] = 0
        if keys:
            yield made()

    return by_whole_text(rows).mapInArrow(run, schema)


_MESSAGE = "shard int, block long, body binary"


def _messages(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], ["shard", "block", "body"])


def _dealt(block: int, owner: np.ndarray, columns: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Messages of the rows of columns to the shards that own them; the order of rows is kept in each, so places needn't be sent."""
    if not len(owner):
        return
    order = np.argsort(owner, kind="stable")
    owner = owner[order]
    starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    for s, e in zip(starts.tolist(), np.r_[starts[1:], len(owner)].tolist(), strict=True):
        yield _messages([(int(owner[s]), block, _pack(**{k: v[order[s:e]] for k, v in columns.items()}))])


def _by_shard(messages: DataFrame, answer: Callable[[int, list[bytes], list[dict], list[dict]], Iterable[tuple]]) -> DataFrame:
    """Each shard's messages to answer(shard, what is stored, wide counts, bodies) at once.

    answer gives (n, body): n counts its bodies, or is STORED; a triple names another shard.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, got = None, ([], [], [], [])

        def flush() -> Iterator[pa.RecordBatch]:
            blocks, stored, wide, bodies = got
            for n, body, *to in answer(shard, stored, wide, bodies):
                yield _messages([(to[0] if to else shard, n if n < 0 else blocks[n], body if isinstance(body, bytes) else _pack(**body))])

        for batch in batches:
            for n in range(batch.num_rows):
                s, b, body = (batch.column(k)[n].as_py() for k in range(3))
                if s != shard and shard is not None:
                    yield from flush()
                    got = ([], [], [], [])
                shard = s
                if b == STORED:
                    got[1].append(body)
                elif b == WIDE:
                    got[2].append(_unpack(body))
                else:
                    got[0].append(b)
                    got[3].append(_unpack(body))
        if shard is not None:
            yield from flush()

    return messages.repartition("shard").sortWithinPartitions("shard", "block").mapInArrow(run, _MESSAGE)


def _with_blocks(blocks: DataFrame, answers: DataFrame, schema, per_block: Callable) -> DataFrame:
    """per_block(block, keys, held, body, answers) for each block, with what came back for it."""
    kinds = dict(blocks.dtypes)
    rows = blocks.select("block", F.lit(-1).alias("shard"), "keys", "held", "body")
    rows = rows.union(answers.where("block >= 0").select("block", "shard", F.lit(None).cast(kinds["keys"]), F.lit(None).cast(kinds["held"]), "body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, found = None, []
        for batch in batches:
            for n in range(batch.num_rows):
                block, shard, body = (batch.column(k)[n].as_py() for k in (0, 1, 4))
                if shard < 0:
                    if head:
                        yield from per_block(*head, found)
                    head, found = (block, batch.column(2).slice(n, 1).flatten(), np.array(batch.column(3)[n].as_py(), bool), _unpack(body)), []
                else:
                    found.append(_unpack(body))
        if head:
            yield from per_block(*head, found)

    return rows.repartition("block").sortWithinPartitions("block", "shard").mapInArrow(run, schema)


def _gathered(answers: list[dict], owner: np.ndarray, name: str) -> np.ndarray:
    """The answers of the shards, in their order, in the order in which the rows were asked for."""
    out = np.zeros(len(owner), np.int64)
    if answers:
        out[np.argsort(owner, kind="stable")] = np.concatenate([m[name] for m in answers])
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ x >> np.uint64(29)


def _owner(x: np.ndarray, shards: int) -> np.ndarray:
    return (_mix(x) % np.uint64(shards)).astype(np.int64)


@dataclass(frozen=True)
class Shape:
    """What every task must know of a model."""

    trained: int
    vocabulary: int
    word_shards: int
    shards: int
    limit: int  # training tokens after a word beyond which its n-grams are spread
    order: int
    prior: tuple[float, ...]
    add: float
    levels: int

    @property
    def mass(self) -> float:
        return self.trained + self.add * (self.vocabulary + 1)

    @property
    def scale(self) -> Scale:
        return Scale.of(self.mass, Settings(add=self.add, levels=self.levels))

    def parts(self, total: np.ndarray) -> np.ndarray:
        """Number of shards among which the n-grams of a word with that total are spread."""
        return np.maximum(1, -(-total // self.limit))

    def part(self, near: np.ndarray, number: np.ndarray) -> np.ndarray:
        return _owner(near * 1_000_003 + number, self.shards)

    def owner(self, grams: dict[str, np.ndarray]) -> np.ndarray:
        """By the nearest context word; a frequent one's n-grams by the word before it too, or by the word itself where there is none, as in a document's first."""
        other = np.where(grams["context"][:, 1] > 0, grams["context"][:, 1], grams["word"]) if self.order > 2 else grams["word"]
        parts = self.parts(grams["total"])
        return self.part(grams["context"][:, 0], np.where(parts > 1, (_mix(other) % parts.astype(np.uint64)).astype(np.int64), 0))


@dataclass(frozen=True)
class Model:
    """A fitted model: its shape, and tables of word and trie shards."""

    shape: Shape
    words: DataFrame
    tries: DataFrame

    def save(self, path: str) -> None:
        """Write the model under path, which must not exist."""
        spark = self.words.sparkSession
        self.words.write.parquet(f"{path}/words")
        self.tries.write.parquet(f"{path}/tries")
        shape = asdict(self.shape) | {"prior": list(self.shape.prior)}
        spark.createDataFrame([tuple(shape.values())], "trained long, vocabulary long, word_shards int, shards int, limit long, order int, prior array<double>, add double, levels int").coalesce(1).write.parquet(f"{path}/shape")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Model:
        row = spark.read.parquet(f"{path}/shape").first().asDict()
        return Model(Shape(**row | {"prior": tuple(row["prior"])}), spark.read.parquet(f"{path}/words"), spark.read.parquet(f"{path}/tries"))


class _Tokens:
    """The tokens of a coded block, and the words before each (nearest first), by the block's own numbers: 0 for an unknown word or none.

    ids, counts and codes say what those numbers stand for.
    """

    def __init__(self, body: dict, held: np.ndarray, shape: Shape):
        self.lengths, tokens = body["lengths"].astype(np.int64), body["tokens"].astype(np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        position = np.arange(len(tokens)) - np.repeat(self.starts, self.lengths)
        order = np.argsort(body["id"])  # in the order of the ids, which compresses
        self.ids, self.counts = np.r_[0, body["id"][order]], np.r_[0, body["count"][order]]
        self.codes = shape.scale.code((self.counts + shape.add) / shape.mass)
        own = np.zeros(len(order), np.int64)
        own[order] = np.where(self.ids[1:] > 0, np.arange(1, len(order) + 1), 0)
        self.word = own[tokens]
        self.older = []
        for n in range(1, shape.order):
            x = np.zeros(len(tokens), np.int64)
            x[n:] = self.word[:-n] if len(tokens) > n else 0
            x = np.where(position >= n, x, np.where(position == n - 1, own[0], 0))
            self.older.append(x if n == 1 else np.where(self.older[-1] > 0, x, 0))
        self.trained = np.repeat(~held, self.lengths)


class _Block(_Tokens):
    """With the distinct n-grams of the tokens after a known word."""

    def __init__(self, body: dict, held: np.ndarray, shape: Shape):
        super().__init__(body, held, shape)
        self.live = live = np.flatnonzero(self.older[0] > 0)
        order, new, self.of = _grouped(*[x[live] for x in self.older], self.word[live])
        first = live[order[new]]
        self.grams = {
            "context": np.stack([self.ids[x[first]] for x in self.older], axis=1),
            "word": self.ids[self.word[first]],
            "code": self.codes[self.word[first]],
            "total": self.counts[self.older[0][first]],
            "count": np.bincount(self.of, self.trained[live], minlength=len(first)).astype(np.int64),
        }
        self.owner = shape.owner(self.grams)

    def columns(self) -> dict[str, np.ndarray]:
        context = {f"c{n}": self.grams["context"][:, n] for n in range(self.grams["context"].shape[1])}
        return context | {"word": _plain(self.grams["word"]), "code": self.grams["code"], "total": self.grams["total"], "count": _plain(self.grams["count"])}


def _rows_of(blocks: DataFrame, schema: str, per_block: Callable[[int, np.ndarray, dict], Iterable[pa.RecordBatch]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                yield from per_block(batch.column(0)[n].as_py(), np.array(batch.column(1)[n].as_py(), bool), _unpack(batch.column(2)[n].as_py()))

    return blocks.select("block", "held", "body").mapInArrow(run, schema)


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([len(_unpack(b.as_py())["word"]) for b in batch.column(0)], pa.int64())], ["n"])


def _coded(docs: DataFrame, key: str, text: str, held: str, spec: Settings, model: Model | None, keep: bool) -> tuple[DataFrame, Shape, DataFrame | None]:
    """Blocks with word numbers (from 1; 0 for a word without a training count) and counts, the shape, and if wanted the word shards."""
    chars = docs.agg(F.coalesce(F.sum(F.length(text)), F.lit(0))).first()[0]
    blocks = materialise(_blocks(docs, key, text, held, spec.grown(spec.block_chars, chars)))
    tokens, trained = blocks.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("trained"), F.lit(0))).first()
    size = spec.grown(spec.shard_tokens, chars)
    shards = model.shape.word_shards if model else max(1, -(-tokens // size))

    def ask(block: int, on: np.ndarray, body: dict) -> Iterator[pa.RecordBatch]:
        counts = np.bincount(body["tokens"], np.repeat(~on, body["lengths"]), minlength=len(body["words"])).astype(np.int64)
        yield from _dealt(block, _owner(body["words"], shards), {"word": body["words"], "count": counts})

    def answer(shard: int, stored: list[bytes], wide: list[dict], asked: list[dict]) -> Iterator[tuple]:
        if stored:
            have = _unpack(stored[0])
        else:
            words, at = np.unique(np.concatenate([m["word"] for m in asked]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([m["count"] for m in asked]), minlength=len(words)).astype(np.int64)
            have = {"word": words[counts > 0], "count": counts[counts > 0]}
            yield STORED, have
        for n, m in enumerate(asked):
            if not len(have["word"]):
                yield n, {"id": np.zeros(len(m["word"]), np.int64), "count": np.zeros(len(m["word"]), np.int64)}
                continue
            at = np.minimum(np.searchsorted(have["word"], m["word"]), len(have["word"]) - 1)
            known = have["word"][at] == m["word"]
            yield n, {"id": np.where(known, at * shards + shard + 1, 0), "count": np.where(known, have["count"][at], 0)}

    asked = _rows_of(blocks, _MESSAGE, ask)
    answers = materialise(_by_shard(asked.union(model.words) if model else asked, answer))
    words = answers.where(F.col("block") == STORED)
    if model:
        shape = model.shape
    else:
        vocabulary = words.select("body").mapInArrow(_sizes, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        shape = Shape(trained, vocabulary, shards, shards, size, spec.order, spec.prior[: spec.order - 1], spec.add, spec.levels)
    kind = blocks.schema["keys"].dataType.elementType
    schema = StructType(_block_schema(kind).fields[:4])

    def code(block: int, keys: pa.Array, on: np.ndarray, body: dict, got: list[dict]) -> Iterator[pa.RecordBatch]:
        owner = _owner(body["words"], shards)
        made = _pack(lengths=body["lengths"], tokens=body["tokens"].astype(np.uint32), id=_plain(_gathered(got, owner, "id")), count=_plain(_gathered(got, owner, "count")))
        yield pa.RecordBatch.from_arrays([pa.array([block]), pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys), pa.array([on.tolist()], pa.list_(pa.bool_())), pa.array([made], pa.binary())], schema.names)

    coded = materialise(_with_blocks(blocks, answers, schema, code))
    words = materialise(words) if keep else None
    discard(blocks, answers)
    return coded, shape, words


def _tries(coded: DataFrame, shape: Shape, model: Model | None, answers: bool) -> DataFrame:
    """The answers of the trie shards to each block; or, if not asked for, the shards themselves (STORED rows)."""

    fields = ("near", "word", "code", "total", "count")

    def wide(block: int, on: np.ndarray, body: dict) -> Iterator[pa.RecordBatch]:
        if int(shape.parts(body["count"].max(initial=0))) == 1:
            return
        t = _Tokens(body, on, shape)
        rows = np.flatnonzero((shape.parts(t.counts) > 1)[t.older[0]] & t.trained)
        near, word = t.older[0][rows], t.word[rows]
        order, new, _ = _grouped(near, word)
        near, word = near[order[new]], word[order[new]]
        columns = {"near": t.ids[near], "word": t.ids[word], "code": t.codes[word], "total": t.counts[near], "count": np.diff(np.r_[new, len(rows)])}
        yield from _dealt(block, _owner(columns["near"] * 31 + columns["word"], shape.shards), columns)

    def summed(shard: int, stored: list[bytes], _: list[dict], asked: list[dict]) -> Iterator[tuple]:
        m = {k: np.concatenate([a[k] for a in asked]) for k in fields}
        order, new, _ = _grouped(m["near"], m["word"])
        counts = np.add.reduceat(m["count"][order], new)
        m = {k: v[order[new]] for k, v in m.items()} | {"count": counts}
        # every shard that holds some of a word's n-grams gets the counts
        many = shape.parts(m["total"])
        rows = np.repeat(np.arange(len(counts)), many)
        to = shape.part(m["near"][rows], np.arange(len(rows)) - np.repeat(np.cumsum(many) - many, many))
        for s in np.unique(to).tolist():
            mine = np.unique(rows[to == s])
            yield WIDE, _pack(**{k: v[mine] for k, v in m.items()}), s

    def grams(block: int, on: np.ndarray, body: dict) -> Iterator[pa.RecordBatch]:
        made = _Block(body, on, shape)
        yield from _dealt(block, made.owner, made.columns())

    def answer(shard: int, stored: list[bytes], spread: list[dict], asked: list[dict]) -> Iterator[tuple]:
        if not asked:
            return
        sizes = [len(a["word"]) for a in asked]
        m = {k: np.concatenate([a.pop(k) for a in asked]) for k in list(asked[0])}
        context = np.stack([m[f"c{n}"] for n in range(shape.order - 1)], axis=1)
        order, new, of = _grouped(*context.T, m["word"])
        first = order[new]
        g = {"context": context[first], "count": np.add.reduceat(m["count"][order], new), **{k: m[k][first] for k in ("word", "code", "total")}}
        del m, context
        if stored:
            data = zstandard.decompress(stored[0])
        else:
            w = {k: np.concatenate([x[k] for x in spread]) if spread else np.zeros(0, np.int64) for k in fields}
            if answers:  # counts of bigrams that no block asks for are only wanted in a model to keep
                asked_for = _places((w["near"], w["word"]), (g["context"][:, 0], g["word"])) >= 0
                w = {k: v[asked_for] for k, v in w.items()}
            o = np.lexsort((w["word"], w["near"]))
            known = g["count"] > 0
            data = Trie.build({k: v[known] for k, v in g.items()}, {k: v[o] for k, v in w.items()}, shape.scale, shape.prior)
            if not answers:
                yield STORED, zstandard.compress(data, 3)
        if answers:
            q = np.rint(Trie(data, shape.scale, shape.prior).log10(g) * -PARTS).astype(np.uint32)[of]
            for n, part in enumerate(np.split(q, np.cumsum(sizes)[:-1])):
                yield n, {"q": part}

    messages = _rows_of(coded, _MESSAGE, grams)
    if model:
        messages = messages.union(model.tries)
    else:
        messages = messages.union(materialise(_by_shard(_rows_of(coded, _MESSAGE, wide), summed)))
    return materialise(_by_shard(messages, answer))


def fit(docs: DataFrame, spec: Settings | None = None, *, key: str = "doc_id", text: str = "text") -> Model:
    """A model of all rows of docs; it can be saved, loaded, and given to score."""
    coded, shape, words = _coded(docs.withColumn("_tw_held", F.lit(False)), key, text, "_tw_held", spec or Settings(), None, True)
    tries = _tries(coded, shape, None, False)
    discard(coded)
    return Model(shape, words, tries)


def score(docs: DataFrame, spec: Settings | None = None, *, model: Model | None = None, key: str = "doc_id", text: str = "text", held: str = "held_out") -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of docs.

    Without a model, one is learned from the rows whose ``held`` is false, in
    the same pass. Rows are counted one by one, repeated ones too; a null text
    is empty, its end is its only token. base_score is the log10 probability
    under the smoothed unigram counts, score that under the trie: of a word
    after its longest known context, backed off once for each longer context
    that is known without the word. The first word's context is a document's
    end. On an empty table the result is empty.

    A block sends a distinct n-gram once, however often it occurs. N-grams
    after a word that has more training tokens than a shard are spread over
    several shards by the word before; those get the counts of its bigrams
    from all of them.
    """
    coded, shape, _ = _coded(docs, key, text, held, spec or Settings(), model, False)
    found = _tries(coded, shape, model, True)
    kind = coded.schema["keys"].dataType.elementType
    schema = StructType([StructField(key, kind), *StructType.fromDDL("held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double").fields])

    def scores(block: int, keys: pa.Array, on: np.ndarray, body: dict, got: list[dict]) -> Iterator[pa.RecordBatch]:
        b = _Block(body, on, shape)
        q = shape.scale.value(b.codes)[b.word]
        q[b.live] = (_gathered(got, b.owner, "q") / -PARTS)[b.of]
        count = b.counts[b.word]
        base = np.log10((count + shape.add) / shape.mass)
        add = lambda x: np.add.reduceat(x, b.starts)
        yield pa.RecordBatch.from_arrays(
            [keys, pa.array(on), pa.array(b.lengths), pa.array(add((count > 0).astype(np.int64))), pa.array(np.full(len(on), shape.trained)), pa.array(add(base)), pa.array(add(q))],
            schema.names,
        )

    return _with_blocks(coded, found, schema, scores)


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score under a model of those whose crc32 isn't divisible by 10."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out("doc_id", 10).alias("held_out"))
    return score(docs).withColumns({c: F.round(c, 6) for c in ("base_score", "score")})


def _sql(spec: Settings = Settings()) -> str:
    """The same scores out of plain counts: crc32 by its table, n-grams by joins."""
    turn = "SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END AS v FROM "
    table = "(SELECT i, i AS v FROM range(256) t(i))"
    for _ in range(8):
        table = f"({turn}{table})"
    level = lambda p: f"(least({spec.levels - 1}, greatest(0, round(log10({p}) / (SELECT least FROM totals) * {spec.levels - 1}.0::DOUBLE))) * ((SELECT least FROM totals) / {spec.levels - 1}.0::DOUBLE))"

    def smoothed(n: int, count: str, seen: str) -> str:
        prior = f"{spec.prior[n - 2]!r}::DOUBLE"
        return f"CASE WHEN coalesce({seen}, 0) = 0 THEN q{n - 1} WHEN coalesce({count}, 0) > 0 THEN {level(f'({count} + {prior} * pow(10.0::DOUBLE, q{n - 1})) / ({seen} + {prior})')} ELSE q{n - 1} + {level(f'{prior} / ({seen} + {prior})')} END AS q{n}"

    return f"""
WITH crc AS (SELECT list(v ORDER BY i) AS t FROM {table}),
docs AS (SELECT row_number() OVER () AS r, doc_id,
  coalesce(xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 10 = 0, false) AS held_out,
  list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') || [chr(10)] AS ws
  FROM documents, crc),
tokens AS (SELECT r, held_out, unnest(ws) AS w, unnest([chr(10)] || ws[:-2]) AS v, unnest(CASE WHEN len(ws) = 1 THEN [NULL] ELSE [NULL, chr(10)] || ws[:-3] END) AS u
  FROM (SELECT r, held_out, ws FROM docs)),
c1 AS (SELECT w, count(*) AS c FROM tokens WHERE NOT held_out GROUP BY w),
c2 AS (SELECT v, w, count(*) AS c FROM tokens WHERE NOT held_out GROUP BY v, w),
c3 AS (SELECT u, v, w, count(*) AS c FROM tokens WHERE NOT held_out AND u IS NOT NULL GROUP BY u, v, w),
s3 AS (SELECT u, v, sum(c)::BIGINT AS s FROM c3 GROUP BY u, v),
mass AS (SELECT coalesce(sum(c), 0)::BIGINT AS n, coalesce(sum(c), 0)::BIGINT + {spec.add}::DOUBLE * (count(*) + 1) AS m FROM c1),
totals AS (SELECT n, m, floor(log10({min(spec.add, 1.0)}::DOUBLE / m)) - 1.0::DOUBLE AS least FROM mass),
one AS (SELECT t.*, coalesce(a.c, 0) AS n1, b.c AS nv, c2.c AS n2, s3.s AS nuv, c3.c AS n3, (coalesce(a.c, 0) + {spec.add}::DOUBLE) / (SELECT m FROM totals) AS p
  FROM tokens t LEFT JOIN c1 a ON t.w = a.w LEFT JOIN c1 b ON t.v = b.w LEFT JOIN c2 ON t.v = c2.v AND t.w = c2.w
  LEFT JOIN s3 ON t.u = s3.u AND t.v = s3.v LEFT JOIN c3 ON t.u = c3.u AND t.v = c3.v AND t.w = c3.w),
level1 AS (SELECT *, {level('p')} AS q1 FROM one),
level2 AS (SELECT *, {smoothed(2, 'n2', 'nv')} FROM level1),
level3 AS (SELECT *, {smoothed(3, 'n3', 'nuv')} FROM level2),
scored AS (SELECT r, count(*) AS n_tokens, count(*) FILTER (n1 > 0) AS n_known, sum(log10(p)) AS base, sum(CASE WHEN nv > 0 THEN round(q3 * -{PARTS}.0::DOUBLE) / -{PARTS}.0::DOUBLE ELSE q1 END) AS score FROM level3 GROUP BY r)
SELECT d.doc_id, d.held_out, s.n_tokens, s.n_known, (SELECT n FROM totals) AS train_tokens, round(s.base, 6) AS base_score, round(s.score, 6) AS score FROM docs d JOIN scored s ON d.r = s.r
"""


ORACLE_SQL = _sql()
