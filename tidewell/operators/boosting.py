"""Boosted trees on the softmax for tables of any size, all classes and folds in one pass a level; and attributions of trees.

Columns are cut at approximate quantiles of the table, and the rows' bins are
written once. A round grows one tree for each class of each fit, level by
level: a pass sums gradients and second derivatives by (node, column, bin), the
sums of a node meet in one task, and what comes to the driver is each node's
best cut. Rows keep no state between passes but the scores that are written
every few rounds; within those, a pass applies the trees grown since.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tidewell.operators.fits import AT_ONCE, BLOCK, WORK, Block, Fits, Table, few, trained
from tidewell.sources.shared import new_path, remove

#: Gains so near to each other are equal, in whatever order rows were added.
TIE = 1e-9

#: Size of a closure of trees that attributions send to the tasks.
TREES_MB = 256

#: The bits of every byte as eight bytes.
EIGHT = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()

#: A level of up to so many nodes is compared whole, a wider one at each row's own node.
WHOLE = 16

CODED = "y binary, bin binary, crc binary, row binary, fold binary"
CHOSEN = ("node", "own", "bin", "gain", "left_g", "left_h", "left_n", "right_g", "right_h", "right_n")


@dataclass
class Boosted:
    """Trees of each fit, round and class: the column and cut of every inner node, leaves' values and training rows (cover).

    A row goes right where its value is over the cut. Nodes are numbered as in
    a heap; columns is (fit, round, class, inner node), values and cover (fit,
    round, class, leaf). A node that isn't cut has an infinite cut.
    """

    columns: np.ndarray
    cuts: np.ndarray
    values: np.ndarray
    cover: np.ndarray
    present: np.ndarray

    @property
    def depth(self) -> int:
        return int(math.log2(self.values.shape[3]))

    def leaves(self, x: np.ndarray, fit: int, round_: int, k: int) -> np.ndarray:
        """Leaf of every row in one tree."""
        node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[rows, self.columns[fit, round_, k, node]] > self.cuts[fit, round_, k, node])
        return node - (self.values.shape[3] - 1)

    def scores(self, x: np.ndarray, fit: int, rounds: range | None = None) -> np.ndarray:
        """Rows by classes: sums of the trees' values."""
        made = np.zeros((len(x), self.values.shape[2]))
        for r in range(self.values.shape[1]) if rounds is None else rounds:
            for k in np.flatnonzero(self.present[fit]).tolist():
                made[:, k] += self.values[fit, r, k][self.leaves(x, fit, r, k)]
        return made

    def probabilities(self, x: np.ndarray, fit: int) -> np.ndarray:
        s = np.where(self.present[fit], self.scores(x, fit), -np.inf)
        e = np.exp(s - s.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def codes(self, x: np.ndarray, fit: int) -> np.ndarray:
        return np.where(self.present[fit], self.scores(x, fit), -np.inf).argmax(axis=1)


def column_cuts(table: Table, bins: int = 32, accuracy: int = 10_000) -> list[np.ndarray]:
    """Distinct inner quantiles of each column, from approximate percentiles of all rows of the table."""
    at = F.array(*[F.lit(k / bins) for k in range(1, bins)])
    rows = table.values()
    found = rows.agg(*[F.percentile_approx(F.col("x")[k], at, F.lit(accuracy)).alias(f"c{k}") for k in range(table.width)]).first() if table.rows else None
    return [np.unique(np.array(found[f"c{k}"], float)) for k in range(table.width)] if found else []


def drawn(pid: list[str], round_: int, share: float, seed: int) -> np.ndarray:
    """Rows of a round's sample: those whose hashed id falls under the share. The hash mixes a CRC of the id."""
    return drawn_crc(np.array([zlib.crc32(p.encode()) for p in pid], np.uint32), round_, share, seed)


def drawn_crc(crc: np.ndarray, round_: int, share: float, seed: int) -> np.ndarray:
    """The same from the ids' CRCs."""
    h = (crc.astype(np.uint64) + np.uint64((seed * 1_000_003 + round_) & 0xFFFFFFFF)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(11)).astype(float) / float(1 << 53) < share


def drawn_columns(n: int, round_: int, share: float, seed: int) -> np.ndarray:
    """A round's columns, the same for all fits."""
    return np.sort(np.random.default_rng([seed, round_]).permutation(n)[: max(1, round(share * n))])


def best_cuts(g: np.ndarray, h: np.ndarray, n: np.ndarray, ridge: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(column, bin, gain) of every node's best cut, from sums (node, column, bin); the first of those that differ by rounding only.

    gain is what the two sides' scores have over the node's own; a cut that
    leaves a side without rows has none.
    """
    left_g, left_h, left_n = (np.cumsum(v, axis=2) for v in (g, h, n))
    all_g, all_h, all_n = (v[:, :, -1:] for v in (left_g, left_h, left_n))
    gain = left_g**2 / (left_h + ridge) + (all_g - left_g) ** 2 / (all_h - left_h + ridge) - all_g**2 / (all_h + ridge)
    gain = np.where((left_n > 0) & (all_n - left_n > 0), gain, -np.inf)
    flat = gain.reshape(len(g), -1)
    top = flat.max(axis=1, keepdims=True)
    at = (flat >= top - TIE * np.maximum(1.0, np.abs(top))).argmax(axis=1)
    return at // g.shape[2], at % g.shape[2], flat[np.arange(len(g)), at]


def fit_boosted(table: Table, cuts: list[np.ndarray], fits: Fits | None = None, rounds: int = 200, depth: int = 4, rate: float = 0.05, share: float = 0.8, ridge: float = 1.0, seed: int = 42, kept_rounds: int = 10) -> Boosted:
    """Boosted trees of every fit of a table: ``rounds`` trees for each class, second order on the softmax.

    A round takes ``share`` of the rows (by hash of the id) and of the columns.
    A node is cut where the gain is largest, and not at all where none is
    positive. Passes over the table: depth for each round, whatever the number
    of classes and fits; ties are broken by column, then bin. Fits take all
    columns.
    """
    fits = table.fits() if fits is None else fits
    k, n_fits = max((len(c) for c in table.classes), default=0), len(fits)
    bins = max((len(c) for c in cuts), default=0) + 1
    inner, leaves = (1 << depth) - 1, 1 << depth
    shape = (n_fits, rounds, k)
    made = Boosted(np.zeros((*shape, inner), np.int32), np.full((*shape, inner), np.inf), np.zeros((*shape, leaves)), np.zeros((*shape, leaves)), np.zeros((n_fits, k), bool))
    if not table.rows:
        return made

    def seen(block: Block):
        trains = block.trains(fits.fold)
        return [(0, np.array([np.bincount(block.y[trains[:, f], fits.label[f]], minlength=k) for f in range(n_fits)]))]

    made.present = table.summed(seen)[0].reshape(n_fits, k) > 0
    trees = [(f, c) for f in range(n_fits) for c in range(k)]
    table.spread(len(trees) * max(1, table.width))
    rows = _Rows(table, fits, made, cuts)
    for r in range(rounds):
        columns = drawn_columns(table.width, r, share, seed)
        for level in range(depth):
            width = 1 << level
            for n in rows.best(r, level, columns, bins, share, seed, ridge):
                (f, c), node, own = trees[n["node"] // width], n["node"] % width, columns[n["own"]]
                cut = n["gain"] > 1e-12
                if cut:
                    at = (f, r, c, width - 1 + node)
                    made.columns[at], made.cuts[at], rows.bins[at] = own, cuts[own][n["bin"]], n["bin"]
                if level == depth - 1:
                    for side in ("left", "right"):
                        if n[f"{side}_n"] > 0:
                            leaf = (f, r, c, 2 * node + (side == "right"))
                            made.values[leaf] = -rate * n[f"{side}_g"] / (n[f"{side}_h"] + ridge)
                            made.cover[leaf] = n[f"{side}_n"]
        rows.grown = r + 1
        if rows.grown - rows.written >= kept_rounds and rows.grown < rounds:
            rows.write()
    rows.discard()
    return made


def asked(columns: np.ndarray, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different (column, bin) of inner nodes, and the place of each node's among them."""
    code, place = np.unique(columns.astype(np.int64) << 32 | bins, return_inverse=True)
    return np.stack([code >> 32, code & 0xFFFFFFFF], axis=1), place.reshape(columns.shape)


def answers(pairs: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Pairs by rows, eight rows a byte: whether a row's bin of the column is over the pair's."""
    made = np.empty((len(pairs), -(-at.shape[1] // 8)), np.uint8)
    for k, (column, cut) in enumerate(pairs.tolist()):
        made[k] = np.packbits(at[column] > cut)
    return made


def descend(columns: np.ndarray, bins: np.ndarray, at: np.ndarray, levels: int, known: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Trees by rows: the node of a level that each row comes to, from trees' (tree, inner node) columns and bins and rows' (column, row) bins.

    known are answers of the rows and the nodes' places among them, where the caller has them.
    """
    narrow, n = min(levels, WHOLE.bit_length()), at.shape[1]
    first = slice(0, (1 << narrow) - 1)
    if known is None:
        pairs, place = asked(columns[:, first], bins[:, first])
        known = answers(pairs, at), place
    answer, place = known
    passed: list[np.ndarray] = []
    node = np.zeros((len(columns), answer.shape[1]), np.uint64)
    for level in range(narrow):
        right = [answer[place[:, i]] for i in range((1 << level) - 1, (2 << level) - 1)]
        for way in passed:
            half = len(right) // 2
            # what np.where would choose, many times faster on bits
            right = [right[i] ^ (way & (right[i] ^ right[half + i])) for i in range(half)]
        passed.append(right[0])
        node = node << np.uint64(1) | EIGHT.take(right[0])
    node = node.view(np.uint8)[:, :n]
    if narrow < levels:
        node = node.astype(np.int64)
    for level in range(narrow, levels):
        inner = slice((1 << level) - 1, (2 << level) - 1)
        right = at[np.take_along_axis(columns[:, inner], node, 1), np.arange(n)] > np.take_along_axis(bins[:, inner], node, 1)
        node = node << 1 | right
    return node


#: Rows of one or more blocks: label codes, bins (column, row), CRCs of ids, (row, fold) of the folds that rows are tested in, scores (tree, row) or None.
Part = tuple[np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray], np.ndarray | None]


def merged(parts: list[Part]) -> Part:
    """Parts as one."""
    if len(parts) == 1:
        return parts[0]
    y, at, crc, tested, scores = zip(*parts, strict=True)
    starts = np.cumsum([0, *[len(c) for c in crc[:-1]]])
    rows = np.concatenate([row + start for (row, _), start in zip(tested, starts, strict=True)]).astype(np.int32)
    return np.concatenate(y), np.concatenate(at, axis=1), np.concatenate(crc), (rows, np.concatenate([fold for _, fold in tested])), None if scores[0] is None else np.concatenate(scores, axis=1)


class _Rows:
    """The table's rows as bins, with the scores that they had after so many rounds.

    They are written every few rounds; between, their parts are cached, in as
    many tasks as a pass is worth, and a pass applies the trees grown since.
    """

    def __init__(self, table: Table, fits: Fits, model: Boosted, cuts: list[np.ndarray]):
        self.spark, self.fits, self.model = table.blocks.sparkSession, fits, model
        most = max((len(c) for c in cuts), default=0)
        self.kind = np.uint8 if most < 255 else np.int32
        #: cuts of the inner nodes by number; the greatest number where a node isn't cut
        self.bins = np.full(model.cuts.shape, np.iinfo(self.kind).max, self.kind)
        self.written, self.grown, self.path, self.scored = 0, 0, None, False
        self.base = self.sums = None
        #: tasks of a pass
        self.tasks = max(1, -(-table.rows * model.present.size * table.width // WORK))
        #: rows of a part
        self.most = max(BLOCK, AT_ONCE // max(1, model.present.size, 8 * table.width))
        kind = self.kind

        def coded(block: Block) -> pa.RecordBatch:
            at = np.array([np.searchsorted(own, block.x[:, c], side="left") for c, own in enumerate(cuts)], kind)
            crc = np.array([zlib.crc32(p.encode()) for p in block.pid], np.uint32)
            return pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (block.y, at, crc, *block.tested)], ["y", "bin", "crc", "row", "fold"])

        self._write(table.each(coded, CODED), CODED)

    def _write(self, made: DataFrame, schema: str) -> None:
        old, self.path = self.path, new_path(self.spark)
        made.write.parquet(self.path)
        self._forget()
        self.blocks = self.spark.read.schema(schema).parquet(self.path)
        part, most, rows = self._part(schema != CODED), self.most, self.blocks.rdd
        rows = rows.coalesce(min(self.tasks, rows.getNumPartitions()))

        def parts(rows: Iterator[Row]) -> Iterator[Part]:
            found, n = [], 0
            for row in rows:
                found.append(part(row))
                n += len(found[-1][2])
                if n >= most:
                    yield merged(found)
                    found, n = [], 0
            if found:
                yield merged(found)

        self.parts, self.base = rows.getNumPartitions(), rows.mapPartitions(parts).persist(StorageLevel.MEMORY_AND_DISK)
        if old:
            remove(self.spark, old)

    def _forget(self) -> None:
        if self.base:
            self.base.unpersist()

    def discard(self) -> None:
        self._forget()
        remove(self.spark, self.path)

    def _part(self, scored: bool) -> Callable[[Mapping], Part]:
        """A function from a row of the blocks to its part."""
        kind, n_trees = self.kind, self.model.present.size

        def part(row: Mapping) -> Part:
            y, at, crc, tested, fold = (np.frombuffer(row[c], t) for c, t in (("y", np.int32), ("bin", kind), ("crc", np.uint32), ("row", np.int32), ("fold", np.int32)))
            scores = np.frombuffer(row["scores"], float).reshape(n_trees, -1) if scored else None
            return y.reshape(len(crc), -1), at.reshape(-1, len(crc)), crc, (tested, fold), scores

        return part

    def _scores(self) -> Callable[[Part], np.ndarray]:
        """A function from a part to its scores after the rounds grown so far."""
        m, recent = self.model, slice(self.written, self.grown)
        live, n_trees, depth = np.flatnonzero(m.present.ravel()).tolist(), m.present.size, m.depth
        # a round's trees by (fit, class)
        columns, bins, values = (np.moveaxis(v[:, recent], 1, 0).reshape(-1, n_trees, v.shape[3]) for v in (m.columns, self.bins, m.values))
        pairs, place = asked(columns, bins)

        def scores(part: Part) -> np.ndarray:
            made = np.zeros((n_trees, len(part[2]))) if part[4] is None else part[4].copy()
            answer = answers(pairs, part[1])
            for t in live:
                for v, leaf in zip(values[:, t], descend(columns[:, t], bins[:, t], part[1], depth, (answer, place[:, t])), strict=True):
                    made[t] += v.take(leaf)
            return made

        return scores

    def write(self) -> None:
        """Write the rows anew with their scores after the rounds grown so far."""
        part, scores = self._part(self.scored), self._scores()
        names = [c.split()[0] for c in CODED.split(", ")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k, row in enumerate(batch.to_pylist()):
                    yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(k, 1) for c in names], pa.array([scores(part(row)).tobytes()], pa.binary())], [*names, "scores"])

        schema = f"{CODED}, scores binary"
        self._write(self.blocks.mapInArrow(run, schema), schema)
        self.written, self.scored = self.grown, True

    def best(self, round_: int, level: int, columns: np.ndarray, bins: int, share: float, seed: int, ridge: float) -> list[dict]:
        """The best cut of every node of a level of the round's trees that rows come to, and the sums of its two sides.

        The sums of few tasks and numbers are added here, where those of the
        level before give the larger child's: only the smaller child's rows are
        summed. Otherwise a node's sums are added where they meet, in one task
        for some of the trees, and its cut is chosen there.
        """
        fits, (n_fits, k), width = self.fits, self.model.present.shape, 1 << level
        present = self.model.present
        live = np.flatnonzero(present.ravel())
        own_columns, own_bins = (v[:, round_].reshape(n_fits * k, -1)[:, : width - 1] for v in (self.model.columns, self.bins))
        size = len(columns) * bins
        scored, (pairs, asks) = self._scores(), asked(own_columns, own_bins)
        here = self.parts > 1 and (level == 0 or self.sums is not None) and few(self.parts, len(live) * max(1, width // 2) * 3 * size)
        #: by tree and parent: the side with fewer rows
        small = self.small if here and level else None
        places = width if small is None else width // 2

        def sums(parts: Iterator[Part]) -> np.ndarray:
            """(tree, node or parent, gradient and second derivative and rows, column and bin) of the live trees."""
            total = np.zeros((len(live), places, 3, size))
            for part in parts:
                y, at, crc, tested, _ = part
                scores = scored(part)
                rows = drawn_crc(crc, round_, share, seed)[:, None] & trained(len(crc), tested, fits.fold)
                slots, answer = at[columns] + np.arange(0, size, bins)[:, None], answers(pairs, at)
                for f in range(n_fits):
                    own = np.flatnonzero(rows[:, f])
                    there = np.flatnonzero(present[f])
                    if not len(own):
                        continue
                    p = scores[f * k + there].take(own, axis=1)
                    p = np.exp(p - p.max(axis=0))
                    p /= p.sum(axis=0)
                    label, slot = y[own, fits.label[f]], slots.take(own, axis=1)
                    for c, q in zip(there.tolist(), p, strict=True):
                        t, where, place = f * k + c, slot, 0
                        g, h = q - (label == c), np.maximum(q * (1 - q), 1e-9)
                        if level:
                            place = descend(own_columns[t : t + 1], own_bins[t : t + 1], at, level, (answer, asks[t : t + 1]))[0].take(own)
                            if small is not None:
                                mine = np.flatnonzero(small[np.searchsorted(live, t)].take(place >> 1) == (place & 1))
                                g, h, where, place = g.take(mine), h.take(mine), slot.take(mine, axis=1), place.take(mine) >> 1
                            where = where + place.astype(np.int64) * size
                        where = where.ravel()
                        made = [np.bincount(where, v, places * size) for v in (*(np.tile(v, len(columns)) for v in (g, h)),)] + [np.bincount(where, minlength=places * size)]
                        total[np.searchsorted(live, t)] += np.stack(made).reshape(3, places, size).transpose(1, 0, 2)
            return total

        def chosen(trees: np.ndarray, total: np.ndarray) -> list[dict]:
            """The cuts of the nodes that have rows."""
            nodes = (trees[:, None] * width + np.arange(width)).ravel()
            v = total.reshape(-1, 3, len(columns), bins)
            held = v[:, 2].any(axis=(1, 2))
            nodes, v, found = nodes[held], v[held], []
            for a in range(0, len(nodes), 256):
                every = np.ascontiguousarray(v[a : a + 256].transpose(1, 0, 2, 3))
                column, at, gain = best_cuts(*every, ridge)
                own = every[:, np.arange(len(column)), column]
                left = np.arange(bins) <= np.where(gain > 1e-12, at, bins)[:, None]
                sides = [np.where(side, x, 0.0).sum(axis=1) for side in (left, ~left) for x in own]
                found += [dict(zip(CHOSEN, row, strict=True)) for row in zip(*(x.tolist() for x in (nodes[a : a + 256], column, at, gain, *sides)), strict=True)]
            return found

        if here:
            total = sum(self.base.mapPartitions(lambda parts: [sums(parts)]).collect())
            if small is not None:
                both = np.empty((len(live), width // 2, 2, *total.shape[2:]))
                of = np.arange(len(live))[:, None], np.arange(width // 2)
                both[*of, small], both[*of, 1 - small] = total, self.sums - total
                total = both.reshape(len(live), width, *total.shape[2:])
            found = chosen(live, total)
            self.sums, self.small = total, np.ones((len(live), width), np.int64)
            for n in found:
                self.small[np.searchsorted(live, n["node"] // width), n["node"] % width] = n["right_n"] <= n["left_n"]
            return found
        self.sums = None
        if self.parts == 1:
            return self.base.mapPartitions(lambda parts: chosen(live, sums(parts))).collect()
        groups = np.array_split(np.arange(len(live)), min(self.parts, len(live)))

        def dealt(parts: Iterator[Part]) -> Iterator[tuple[int, np.ndarray]]:
            total = sums(parts)
            return ((j, total[own]) for j, own in enumerate(groups))

        def met(pairs: Iterator[tuple[int, np.ndarray]]) -> Iterator[dict]:
            found: dict[int, np.ndarray] = {}
            for j, v in pairs:
                found[j] = found[j] + v if j in found else v
            for j, v in found.items():
                yield from chosen(live[groups[j]], v)

        return self.base.mapPartitions(dealt).partitionBy(len(groups), int).mapPartitions(met).collect()


# ---- attributions


def tree_shap(columns: np.ndarray, cuts: np.ndarray, values: np.ndarray, cover: np.ndarray, x: np.ndarray, width: int) -> np.ndarray:
    """Rows by columns: Shapley values of one tree, where an absent column's cuts are passed in proportion to the cover.

    A leaf pays for the rows that reach it. On its path each column has a
    share of the training rows (the product over its cuts), and is passed by
    the row or isn't. Of the leaf's value a column gets the weighted sum, over
    the sets of the path's other columns, of what its presence changes; the
    sets enter by a polynomial in their size, made by one factor for each
    column, so a path of m columns takes m squared steps.
    """
    made = np.zeros((len(x), width))
    leaves = len(values)
    total = np.zeros(2 * leaves - 1)
    total[leaves - 1 :] = cover
    for node in range(leaves - 2, -1, -1):
        total[node] = total[2 * node + 1] + total[2 * node + 2]
    for leaf in range(leaves):
        if not total[leaves - 1 + leaf] or not values[leaf]:
            continue
        share: dict[int, float] = {}
        passed: dict[int, np.ndarray] = {}
        node = leaves - 1 + leaf
        while node:
            up = (node - 1) // 2
            if np.isfinite(cuts[up]):
                c = int(columns[up])
                right = x[:, c] > cuts[up]
                share[c] = share.get(c, 1.0) * total[node] / total[up]
                passed[c] = passed.get(c, True) & (right if node == 2 * up + 2 else ~right)
            node = up
        own, m = [*share], len(share)
        for c in own:
            # coefficients by the number of the other columns that are present
            poly = np.zeros((m, len(x)))
            poly[0], size = 1.0, 0
            for other in own:
                if other == c:
                    continue
                size += 1
                poly[1 : size + 1] = poly[1 : size + 1] * share[other] + poly[:size] * passed[other]
                poly[0] *= share[other]
            weight = np.array([math.factorial(s) * math.factorial(m - s - 1) / math.factorial(m) for s in range(m)])
            made[:, c] += values[leaf] * (passed[c] - share[c]) * (weight @ poly)
    return made


def expected(values: np.ndarray, cover: np.ndarray) -> float:
    """A tree's mean over its training rows."""
    return float((values * cover).sum() / cover.sum()) if cover.sum() else 0.0


def tree_attributions(model: Boosted, classes: list, rows: DataFrame, columns: list[str], fit: int = 0, key: str = "pid") -> DataFrame:
    """(key, class, feature, base, value): what each feature adds to a row's score for each class, along the trees' paths.

    The values of a row and class sum to its score minus base, the mean score
    over the training rows. A row is a task's own matter, so any number of rows
    spreads; the trees go to the tasks in the closure, after a check of their
    size. Null values are errors.
    """
    size = sum(v[fit].nbytes for v in (model.columns, model.cuts, model.values, model.cover)) / 1e6
    if size > TREES_MB:
        raise ValueError(f"{size:.0f} MB of trees; at most {TREES_MB} MB are sent to the tasks")
    trees = [[(model.columns[fit, r, k], model.cuts[fit, r, k], model.values[fit, r, k], model.cover[fit, r, k]) for r in range(model.values.shape[1])] for k in range(len(classes))]
    base = [sum(expected(t[2], t[3]) for t in own) for own in trees]
    names = list(columns)

    def run(batches):
        for batch in batches:
            flat = batch.column("_x").flatten()
            if flat.null_count:
                raise ValueError("null values")
            x = flat.to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(names))
            for k, own in enumerate(trees):
                total = sum((tree_shap(*t, x, len(names)) for t in own), np.zeros(x.shape))
                yield pa.RecordBatch.from_arrays([batch.column("_key"), pa.array(np.full(len(x), k, np.int32)), pa.array(np.full(len(x), base[k])), pa.array(list(total), pa.list_(pa.float64()))], ["_key", "_class", "base", "_values"])

    given = rows.select(F.col(key).alias("_key"), F.array(*[F.col(c).cast("double") for c in columns]).alias("_x"))
    kind = rows.schema[key].dataType.simpleString()
    made = given.mapInArrow(run, f"_key {kind}, _class int, base double, _values array<double>")
    label = F.get(F.array(*[F.lit(c) for c in classes]), F.col("_class"))
    long = made.select(F.col("_key").alias(key), label.alias("class"), "base", F.posexplode("_values").alias("_k", "value"))
    return long.select(key, "class", F.get(F.array(*[F.lit(c) for c in names]), F.col("_k")).alias("feature"), "base", "value")


def mean_attributions(attributions: DataFrame) -> DataFrame:
    """(class, feature, mean_abs): mean size of the attributions over the rows, the data of a bar chart of features."""
    return attributions.groupBy("class", "feature").agg(F.avg(F.abs("value")).alias("mean_abs"))
