"""SimHash near-duplicates, found through tables of Hamming distances to reference fingerprints.

Distances of a 64-bit fingerprint to references drawn at random crowd around
32, and a tolerance on them hardly narrows a search. The references are
therefore compared block by block: the 64 bits are split into five blocks and
each block's distances to eight references are precomputed. Two fingerprints
that differ in at most two bits leave at least three blocks alone, so they
agree in all distances of three blocks. Each of the ten choices of three
blocks is a table keyed by those distances. Pairs that share a key are
discarded if any other distance differs by more than two, and the rest are
verified bit by bit.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import append_columns, by_whole_text, materialise, strings, table
from tidewell.llm.graph import components

SEED = 42
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
REFERENCES = 8
TABLES = tuple(combinations(range(len(BLOCKS)), 3))
#: Up to so many fingerprints of one key are compared as pairs.
PAIRWISE = 64
#: Up to so many meet in one task; beyond, the same comparison is dealt out by Spark.
IN_TASK = 20_000


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _mask(block: int) -> int:
    first, size = BLOCKS[block]
    return ((1 << size) - 1) << first


def reference(block: int, n: int) -> int:
    """The n-th reference fingerprint of a block."""
    return xxhash.xxh64_intdigest(b"reference %d %d" % (block, n), SEED)


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of the word shingles of UTF-8 bytes, A-Z lower-cased, repeats included.

    A text of fewer words than ``width`` is one shingle, one without a word has none.
    """
    words = text.lower().split()
    line = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(line, SEED)] * bool(words), np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[i:j], SEED) for i, j in zip((ends - sizes)[: 1 - width].tolist(), ends[width - 1 :].tolist(), strict=True)], np.uint64)


#: For each byte its eight bits, lowest first, as the eight bytes of a word.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8")[:, 0]


def majorities(lanes: np.ndarray) -> np.ndarray:
    """For each row of hashes the bits that more than half of them have; 0 for none.

    Bits are counted eight to a word, at most 255 hashes before counts are
    widened.
    """
    size = lanes.shape[1]
    votes = np.zeros((len(lanes), 64), np.int64)
    for k in range(0, size, 255 * 64):
        part = np.ascontiguousarray(lanes[:, k : k + 255 * 64].astype("<u8"))
        spread = _SPREAD[part.view(np.uint8).reshape(*part.shape, 8)]
        sums = np.add.reduceat(spread, np.arange(0, part.shape[1], 255), axis=1)
        votes += np.ascontiguousarray(sums).view(np.uint8).reshape(len(lanes), -1, 64).sum(axis=1, dtype=np.int64)
    return np.packbits(2 * votes > size, axis=1, bitorder="little").view("<u8")[:, 0]


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have; 0 for none."""
    return int(majorities(hashes[None, :])[0])


def fingerprint(text: bytes, width: int = 3) -> int:
    """64-bit SimHash of a text's shingles, repeats included; 0 without a word."""
    return majority(shingle_hashes(text, width))


def with_fingerprint(docs: DataFrame, *, text: str = "text", width: int = 3) -> DataFrame:
    """docs with simhash, the fingerprint as a signed long; null and blank texts have 0."""

    def per_batch(column: pa.Array) -> list[pa.Array]:
        return [pa.array([_signed(fingerprint(t, width)) for t in strings(column)], pa.int64())]

    return append_columns(docs, [text], "simhash long", per_batch)


def distance_table(prints: DataFrame) -> DataFrame:
    """prints (simhash) with c0..c4: each block's distances to its references, four bits each."""
    made = {}
    for block in range(len(BLOCKS)):
        code = F.lit(0).cast("long")
        for n in range(REFERENCES):
            near = F.bit_count(F.col("simhash").bitwiseXOR(F.lit(_signed(reference(block, n)))).bitwiseAND(F.lit(_signed(_mask(block)))))
            code = code.bitwiseOR(F.shiftleft(near.cast("long"), 4 * n))
        made[f"c{block}"] = code
    return prints.withColumns(made)


def _linked(prints: np.ndarray, codes: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Positions of a spanning set of the links among a key's few fingerprints."""
    n = len(prints)
    shifts = np.arange(0, 4 * REFERENCES, 4, dtype=np.uint64)
    table = ((codes[:, :, None] >> shifts) & np.uint64(15)).reshape(n, -1).astype(np.int8)
    i, j = np.triu_indices(n, 1)
    near = np.abs(table[i] - table[j]).max(axis=1) <= distance
    i, j = i[near], j[near]
    near = np.bitwise_count(prints[i] ^ prints[j]) <= distance
    return list(zip(i[near].tolist(), j[near].tolist(), strict=True))


def _free_masks(number: int) -> list[int]:
    """For the number-th table: all ways to blank two bits outside its three blocks."""
    bits = [b for k, (first, size) in enumerate(BLOCKS) if k not in TABLES[number] for b in range(first, first + size)]
    return [1 << a | 1 << b for a, b in combinations(bits, 2)]


def _spanning(n: int, links) -> list[tuple[int, int]]:
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for i, j in links:
        a, b = root(i), root(j)
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((i, j))
    return out


def _links_of_key(number: int, prints: np.ndarray, codes: np.ndarray, distance: int) -> list[tuple[int, int]]:
    if len(prints) <= PAIRWISE:
        return _spanning(len(prints), _linked(prints, codes, distance))
    links = []
    for mask in _free_masks(number):
        blank = prints & np.uint64(~mask & (1 << 64) - 1)
        order = np.argsort(blank, kind="stable")
        same = np.flatnonzero(blank[order][1:] == blank[order][:-1])
        links += zip(order[same].tolist(), order[same + 1].tolist(), strict=True)
    return _spanning(len(prints), links)


def links(prints: DataFrame, distance: int = 2) -> DataFrame:
    """(a, b): links that connect all fingerprints of prints (simhash, distinct) within ``distance`` bits.

    Every two linked fingerprints are connected, if not always by an edge of
    their own. A key's fingerprints are sorted together and compared in one
    task; keys with more than IN_TASK of them are compared by a grouping of
    Spark's on the fingerprints with two bits blanked.
    """
    if distance > 2:
        raise ValueError("three of five blocks agree only up to distance 2")
    coded = distance_table(prints.select("simhash"))
    codes = [f"c{b}" for b in range(len(BLOCKS))]
    keyed = coded.select("simhash", *codes, F.posexplode(F.array(*[F.xxhash64(F.lit(n), *[F.col(f"c{b}") for b in blocks]) for n, blocks in enumerate(TABLES)])).alias("number", "key"))
    keyed = materialise(keyed)
    large = materialise(keyed.groupBy("key").count().where(F.col("count") > IN_TASK).select("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in chain(batches, [None]):
            rows = rest if batch is None else pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            if rows is None or not rows.num_rows:
                continue
            key = rows["key"].to_numpy()
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            whole = len(key) if batch is None else int(starts[-1])
            rest = rows.slice(whole)
            if not whole:
                continue
            ends = np.r_[starts[1:], len(key)]
            prints = rows["simhash"].to_numpy().view(np.uint64)
            numbers = rows["number"].to_numpy()
            table = np.stack([rows[c].to_numpy().view(np.uint64) for c in codes], axis=1)
            a, b = [], []
            for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                if e - s > 1 and e <= whole:
                    for i, j in _links_of_key(int(numbers[s]), prints[s:e], table[s:e], distance):
                        a.append(prints[s + i])
                        b.append(prints[s + j])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.array(a, np.uint64).view(np.int64)), pa.array(np.array(b, np.uint64).view(np.int64))], ["a", "b"])

    near = keyed.join(large, "key", "left_anti").repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")
    if not large.limit(1).count():
        return near
    blanks = F.array(*[F.array(*[F.lit(_signed(m)) for m in _free_masks(n)]) for n in range(len(TABLES))])
    blanked = keyed.join(large, "key").select("simhash", "number", F.explode(blanks[F.col("number")]).alias("mask"))
    blanked = blanked.withColumn("blank", F.col("simhash").bitwiseAND(F.bitwise_not("mask")))
    hubs = blanked.groupBy("mask", "blank").agg(F.min("simhash").alias("b"))
    return near.union(blanked.join(hubs, ["mask", "blank"]).where("simhash <> b").select(F.col("simhash").alias("a"), "b").distinct())


def linked_fingerprints(prints: DataFrame, distance: int = 2) -> DataFrame:
    """prints (simhash, distinct, written) with component, the smallest fingerprint of those connected by links within ``distance`` bits."""
    found = components(links(prints.select("simhash"), distance)).select(F.col("node").alias("simhash"), "component")
    return prints.join(found, "simhash", "left").withColumn("component", F.coalesce("component", "simhash"))


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = 3, distance: int = 2) -> DataFrame:
    """(key, simhash, component_id) for each row of docs; other columns are not read.

    Fingerprints link at ``distance`` or fewer differing bits, and a component
    is named by its smallest key. Empty texts share the fingerprint 0 and link
    like any other. Rows with a null key take part but name no component (null
    if a component has no other). Equal fingerprints meet only in partial
    aggregates and in joins that Spark may split, so a text with very many
    copies is no heavier than the rest.
    """
    prints = materialise(with_fingerprint(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), text="text", width=width).select("key", "simhash"))
    nodes = materialise(prints.groupBy("simhash").agg(F.min("key").alias("low")))
    named = linked_fingerprints(nodes, distance)
    lows = named.groupBy("component").agg(F.min("low").alias("component_id"))
    of = named.join(lows, "component").select("simhash", "component_id")
    return prints.join(of, "simhash").select(F.col("key").alias(key), "simhash", "component_id")


@dataclass(frozen=True)
class Similar:
    """Parameters of the search for similar texts: Jaccard similarity of the sets of word shingles.

    SimHash only brings candidates together; links are decided by the sets.
    Texts of that similarity differ in a bit with probability ``differ``, in one
    of few shingles with at most ``differ_short`` (four shared, one more in one
    of them). ``slack`` standard deviations are allowed on top of the expected
    distance, and as many tables are made as it takes to bring a pair of just
    that similarity together in one with probability ``recall``. Sets of up to
    ``short`` shingles meet by their smallest hashes instead, where no pair is lost.
    """

    width: int = 5
    similarity: float = 0.8
    slack: float = 3.5
    recall: float = 0.995
    lanes: int = 16
    short: int = 32

    @property
    def differ(self) -> float:
        return math.acos(2 * self.similarity / (1 + self.similarity)) / math.pi + 0.004

    @property
    def differ_short(self) -> float:
        return max(self.differ, 0.1875)

    def distance(self, bits: int, short: bool) -> int:
        """Most bits in which candidates differ."""
        p = self.differ_short if short else self.differ
        return int(bits * p + self.slack * math.sqrt(bits * p * (1 - p)))

    def prefix(self, size: int) -> int:
        """Of sets of that size as many smallest hashes that similar ones have one in common."""
        return size - math.ceil(self.similarity * size - 1e-9) + 1 if size else 0

    def tables(self, texts: int) -> list[np.ndarray]:
        """Bit positions of each table, out of all lanes; keys grow by a bit as texts double, so a key's chance company doesn't.

        The number follows from the spread of the distance of pairs of just that similarity, not from its mean.
        """
        bits, all_bits = min(40, max(8, round(math.log2(max(texts, 1))) - 4)), 64 * self.lanes
        sigma = math.sqrt(self.differ * (1 - self.differ) / all_bits)
        z = np.linspace(-4, 4, 161)
        weight = np.exp(-z * z / 2)
        apart = 1 - (1 - self.differ - sigma * z) ** bits
        number = 1
        while (weight * (1 - apart**number)).sum() < self.recall * weight.sum():
            number += 1
        return [np.random.default_rng([SEED, n]).permutation(all_bits)[:bits] for n in range(number)]


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """Another 64-bit hash of each hash."""
    x = x + np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _lanes(hashes: np.ndarray, spec: Similar) -> np.ndarray:
    """SimHash lanes of a set of shingles."""
    return majorities(np.stack([hashes, *[_mixed(hashes, k) for k in range(4, spec.lanes + 3)]]))


def _near_rows(key: np.ndarray, lanes: np.ndarray, spec: Similar) -> list[tuple[int, int]]:
    """Links among the rows (sorted by key) that share a key; negative keys are those of short sets."""
    n = len(key)
    limit = np.where(key < 0, spec.distance(128, True), spec.distance(128, False))
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, n])
    size_of = np.repeat(sizes, sizes)
    found: list[tuple[int, int]] = []

    small = np.flatnonzero(size_of <= PAIRWISE)
    step = 1
    while len(small := small[small + step < n]):
        small = small[key[small] == key[small + step]]
        ok = np.bitwise_count(lanes[small] ^ lanes[small + step]).sum(axis=1) <= limit[small]
        found.extend(zip(small[ok].tolist(), (small[ok] + step).tolist(), strict=True))
        step += 1

    for s, e in zip(starts[sizes > PAIRWISE].tolist(), (starts + sizes)[sizes > PAIRWISE].tolist(), strict=True):
        found += _connected(np.arange(s, e), lambda k, others: np.bitwise_count(lanes[others] ^ lanes[k]).sum(axis=1) <= limit[k])
    return found


def _connected(rows: np.ndarray, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Links that connect all rows that are near one another, directly or over others.

    A row is compared with those that nothing has reached yet, so a crowd of
    copies takes one pass.
    """
    links, left = [], rows
    while len(left):
        front, left = [int(left[0])], left[1:]
        while front and len(left):
            k = front.pop()
            hit = near(k, left)
            got, left = left[hit].tolist(), left[~hit]
            links += [(g, k) for g in got]
            front += got
    return links


def _verified(group: np.ndarray, lanes: np.ndarray, sets: list[np.ndarray], spec: Similar) -> list[tuple[int, int]]:
    """Links among the rows of each group (sorted) whose sets have the similarity; pairs far apart over all lanes are left out first."""
    limit, share = spec.distance(64 * spec.lanes, True), spec.similarity
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    links = []
    for s, e in zip(starts.tolist(), np.r_[starts[1:], len(group)].tolist(), strict=True):
        if e - s < 2:
            continue
        sizes = np.array([len(x) for x in sets[s:e]], np.int64)
        first = np.cumsum(sizes) - sizes
        names, ids = np.unique(np.concatenate(sets[s:e]), return_inverse=True)
        marked = np.zeros(len(names), bool)

        def near(k: int, others: np.ndarray, s=s, sizes=sizes, first=first, ids=ids, marked=marked) -> np.ndarray:
            ok = np.bitwise_count(lanes[others] ^ lanes[k]).sum(axis=1) <= limit
            size = sizes[k - s]
            ok &= np.minimum(sizes[others - s], size) >= share * np.maximum(sizes[others - s], size) - 1e-9
            rows = others[ok] - s
            if not len(rows):
                return ok
            own = ids[first[k - s] : first[k - s] + size]
            marked[own] = True
            runs = np.cumsum(sizes[rows]) - sizes[rows]
            at = np.arange(sizes[rows].sum()) + np.repeat(first[rows] - runs, sizes[rows])
            common = np.add.reduceat(marked[ids[at]], runs, dtype=np.int64)
            marked[own] = False
            ok[ok] = common >= share * (sizes[rows] + size - common) - 1e-9
            return ok

        links += _connected(np.arange(s, e), near)
    return links


def _by_key(found: Callable[[pa.Table, np.ndarray], tuple[np.ndarray, np.ndarray]]):
    """A function for mapInArrow over rows sorted by key: found(rows, keys) gets all rows of a key at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in chain(batches, [None]):
            rows = rest if batch is None else pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            if rows is None or not rows.num_rows:
                continue
            key = rows["key"].to_numpy()
            whole = len(key) if batch is None else int(np.searchsorted(key, key[-1]))
            rest = rows.slice(whole)
            if whole > 1:
                ends = found(rows.slice(0, whole), key[:whole])
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in ends], ["a", "b"])

    return run


def _dealt(keyed: DataFrame, columns: list[str], weight=None) -> DataFrame:
    """keyed (key, columns), with keys of more than IN_TASK rows (or that weight) split into blocks of which every pair gets a key of its own."""
    total = F.count(F.lit(1)) if weight is None else F.sum(weight)
    large = materialise(keyed.groupBy("key").agg(total.alias("count")).where(F.col("count") > IN_TASK))
    if not large.limit(1).count():
        return keyed
    parts = F.ceil(2 * F.col("count") / IN_TASK).cast("int")
    split = keyed.join(large, "key").select("*", parts.alias("parts"), F.pmod(F.xxhash64("node"), parts).cast("int").alias("own"))
    split = split.select("key", *columns, "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    again = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    again = F.when(F.col("key") < 0, again.bitwiseOR(F.lit(-1 << 63))).otherwise(again.bitwiseAND(F.lit((1 << 63) - 1)))
    return keyed.join(large, "key", "left_anti").union(split.select(again.alias("key"), *columns))


def _stars(node: np.ndarray, links: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The links' connected nodes, each with the smallest of its group.

    Tables that bring the same group together then give the same pairs.
    """
    names, number = np.unique(node, return_inverse=True)
    parent = list(range(len(names)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for i, j in links:
        a, b = root(number[i]), root(number[j])
        parent[max(a, b)] = min(a, b)
    linked = np.unique(number[np.array(links, np.int64).ravel()])
    hubs = np.array([root(k) for k in linked.tolist()], np.int64)
    away = linked != hubs
    return names[linked[away]], names[hubs[away]]


def _tied(prints: DataFrame, distance: int) -> DataFrame:
    """(a, b): links that connect the nodes of prints (node, simhash) whose fingerprints are connected within ``distance`` bits."""
    of = linked_fingerprints(materialise(prints.select("simhash").distinct()), distance)
    tied = materialise(prints.select("node", "simhash").distinct().join(of, "simhash").select("node", "component").distinct())
    hubs = tied.groupBy("component").agg(F.min("node").alias("b"))
    return tied.join(hubs, "component").where("node <> b").select(F.col("node").alias("a"), "b")


def similar_documents(docs: DataFrame, spec: Similar | None = None, *, key: str = "doc_id", text: str = "text", distance: int | None = None) -> DataFrame:
    """(key, component_id) for each row of docs: connected groups of similar texts, named by their smallest key.

    With ``distance`` texts are linked as well whose fingerprints, those of
    near_duplicates, differ in at most so many bits, by the same tables of
    distances to references: the groups of near_duplicates are then parts of
    these.

    Equal sets of shingles are one node. Nodes meet in tables keyed by sampled
    bits, short sets in keys of their smallest hashes; those within the limit
    over 128 bits are candidates. Within a connected group of candidates the
    sets themselves are compared, and only texts of the similarity are linked.
    Keys and groups with more than IN_TASK nodes (texts of 2048 characters) are
    split into blocks and every pair of blocks is compared, so no task holds
    more than two. Empty texts are one group, rows with a null key name no group.
    """
    spec = spec or Similar()

    def wide(column: pa.Array) -> list[pa.Array]:
        sets = [np.unique(shingle_hashes(t, spec.width)) for t in strings(column)]
        lanes = np.array([_lanes(x, spec) for x in sets], np.uint64).reshape(-1, spec.lanes)
        node = np.array([xxhash.xxh64_intdigest(x.astype("<u8").tobytes(), SEED) for x in sets], np.uint64)
        longest = spec.short / spec.similarity  # of the sets that are similar to a short one
        least = [x[: spec.prefix(len(x)) if len(x) <= longest else 0] for x in sets]
        made = [pa.array(node.view(np.int64)), pa.array([len(x) for x in sets], pa.int32()), *(pa.array([x.astype("<u8").tobytes() for x in part], pa.binary()) for part in (lanes, least))]
        return made if distance is None else [*made, pa.array([_signed(fingerprint(t)) for t in strings(column)], pa.int64())]

    fingerprints = [] if distance is None else ["simhash"]
    added = ", ".join(["node long, size int, lanes binary, least binary", *[f"{c} long" for c in fingerprints]])
    prints = append_columns(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), ["text"], added, wide)
    prints = materialise(prints.select("key", "node", "size", "lanes", "least", *fingerprints, "text"))
    nodes = materialise(prints.groupBy("node").agg(F.min("key").alias("low"), *[F.min(c).alias(c) for c in ("size", "lanes", "least")]))
    tables = spec.tables(nodes.count())

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, size = batch.column("node").to_numpy(), batch.column("size").to_numpy()
            lanes = np.frombuffer(b"".join(batch.column("lanes").to_pylist()), "<u8").reshape(len(node), -1)

            def made(key: np.ndarray, rows: np.ndarray, node=node, lanes=lanes) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(x) for x in (key, node[rows], lanes[rows, 0].view(np.int64), lanes[rows, 1].view(np.int64))], ["key", "node", "a", "b"])

            long = np.flatnonzero(size > spec.short)
            if len(long):
                bits = np.unpackbits(np.ascontiguousarray(lanes[long]).view(np.uint8), axis=1, bitorder="little")
                for n, places in enumerate(tables):
                    yield made((bits[:, places].astype(np.int64) << np.arange(len(places))).sum(axis=1) + (n << 40), long)
            least = [np.frombuffer(x, "<u8") for x in batch.column("least").to_pylist()]
            rows = np.repeat(np.arange(len(node)), [len(x) for x in least])
            if len(rows):
                yield made((np.concatenate(least) | np.uint64(1 << 63)).view(np.int64), rows)

    def meet(rows: pa.Table, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lanes = np.stack([rows[c].to_numpy().view(np.uint64) for c in ("a", "b")], axis=1)
        return _stars(rows["node"].to_numpy(), _near_rows(key, lanes, spec))

    def verify(rows: pa.Table, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lanes = np.frombuffer(b"".join(rows["lanes"].to_pylist()), "<u8").reshape(len(key), -1)
        sets = [np.unique(shingle_hashes(t, spec.width)) for t in strings(rows["text"])]
        return _stars(rows["node"].to_numpy(), _verified(key, lanes, sets, spec))

    keyed = nodes.select("node", "size", "lanes", "least").mapInArrow(keys, "key long, node long, a long, b long")
    met = _dealt(keyed, ["node", "a", "b"]).repartition("key").sortWithinPartitions("key").mapInArrow(_by_key(meet), "a long, b long")
    groups = components(met).withColumnRenamed("component", "key")
    # texts are carried, not their sets: those of a text take several times its room
    texts = prints.groupBy("node").agg(F.min("lanes").alias("lanes"), F.min("text").alias("text"))
    grouped = materialise(by_whole_text(texts.join(groups, "node").select("key", "node", "lanes", "text")))
    weight = F.greatest(F.lit(1.0), F.length("text") / 2048)
    links = _dealt(grouped, ["node", "lanes", "text"], weight).repartition("key").sortWithinPartitions("key").mapInArrow(_by_key(verify), "a long, b long")
    found = components(links if distance is None else links.union(_tied(prints, distance)))
    named = nodes.select("node", "low").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lows = named.groupBy("component").agg(F.min("low").alias("component_id"))
    of = named.join(lows, "component").select("node", "component_id")
    return prints.join(of, "node").select(F.col("key").alias(key), "component_id")


def without_similar(docs: DataFrame, spec: Similar | None = None, *, key: str = "doc_id", text: str = "text", distance: int = 2) -> DataFrame:
    """docs with one row of each group of near-duplicates: the one of the smallest key.

    Texts are linked by their fingerprints, as in near_duplicates, and by the
    similarity of their sets of shingles; a group is connected by links of
    either kind. Rows that share that key are told apart by all their columns as JSON, and
    the smallest stays. Rows with a null key can't be named and all stay.
    """
    of = materialise(similar_documents(docs, spec, key=key, text=text, distance=distance))
    kept = of.where(F.col(key) == F.col("component_id")).groupBy(key).count()
    again = materialise(kept.where("count > 1").select(key))
    # a merge join whatever the size, so that the plan is the same at every scale
    stay = docs.join(kept.where("count = 1").select(key).hint("merge"), key, "left_semi")
    unnamed = docs.where(F.col(key).isNull())
    if not again.limit(1).count():
        return stay.unionByName(unnamed).select(docs.columns)
    row = F.struct(*docs.columns)
    repeated = docs.join(again, key, "left_semi").groupBy(key).agg(F.min_by(row, F.to_json(row)).alias("row")).select("row.*")
    return stay.unionByName(repeated).unionByName(unnamed).select(docs.columns)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), "component_id")
