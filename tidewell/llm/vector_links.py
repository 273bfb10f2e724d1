"""Near-duplicate vectors: all pairs of a cosine of at least 0.9, by a pigeonhole over subspaces.

Unit vectors with cosine c are 2 - 2c apart, squared. They are rotated onto the
principal axes of a sample, which are dealt to blocks of few dimensions, and
each block gets a share of the squared distance in proportion to the spread it
holds. A pair within the whole distance is within its share in one block at
least, so a range join in each block finds every pair:

* a block's subspace is cut into cells of about as many vectors, each with its
  bounding box; cells with many vectors are cut further, by hash;
* two cells meet where their boxes are within the block's radius, and a vector
  is sent only to cells whose box it can reach;
* a task holds two cells, compares them tile by tile in the block's dimensions,
  and verifies what is left by the cosine of the whole vectors.

A pair counts in the first block whose share it keeps, so it is counted once.
Coordinates are integers, so all tasks judge a pair in a block alike. Tasks
return counts and, for components, a forest of their links: no list of pairs,
however many links a group of copies has. Equal vectors are one, with a weight.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import discard, materialise, table
from tidewell.llm.graph import components
from tidewell.llm.vector_codes import finite

#: Smallest cosine of a link.
COSINE = 0.9

#: Dimensions of a block; vectors of the sample that axes and cells are taken from.
WIDTH, SAMPLE = 16, 16384

#: Vectors of a cell: so many times the square root of all, between two bounds. A vector goes to every cell it can reach,
#: so with cells of a fixed size copies would grow with the table; the upper bound keeps two cells within a task's memory.
CELL_ROOT, CELL_LEAST, CELL_MOST = 32, 2048, 131072

#: Units of a coordinate. Squares of at most 2 * GRID over a block's dimensions are exact in doubles.
GRID = 1 << 20

#: Added to the squared distance allowed, for coordinates and axes that were rounded to the grid.
SLACK = 1e-3

#: Vectors of a tile.
TILE = 1024


@dataclass
class Blocks:
    """Rotation (integer columns), dimensions and squared radius (on the grid) of each block, and its cells as a tree of cuts."""

    axes: np.ndarray
    spans: list[tuple[int, int]]
    budgets: list[float]
    trees: list[list[tuple[int, float]]]

    def coordinates(self, unit: np.ndarray) -> np.ndarray:
        """Integer coordinates of unit vectors; products of integers are exact, so they don't depend on the batch."""
        return np.floor(np.rint(unit * GRID) @ self.axes / GRID)

    def cells(self, x: np.ndarray, block: int) -> np.ndarray:
        """Cell of each row of coordinates: each cut of the tree halves a cell."""
        a, b = self.spans[block]
        own, node, tree = x[:, a:b], np.zeros(len(x), np.int64), self.trees[block]
        if not tree:
            return node
        axis, cut = np.array([t[0] for t in tree]), np.array([t[1] for t in tree])
        depth = (len(tree) + 1).bit_length() - 1
        for _ in range(depth):
            node = 2 * node + 1 + (own[np.arange(len(x)), axis[node]] > cut[node])
        return node - len(tree)


def unit_vectors(column: pa.Array) -> np.ndarray:
    """Unit doubles of an Arrow list column of vectors of one length."""
    sizes = np.unique(column.value_lengths().to_numpy(zero_copy_only=False))
    if len(sizes) > 1:
        raise ValueError(f"vectors of different lengths: {sizes[:5].tolist()}")
    x = np.ascontiguousarray(column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(column), int(sizes[0]) if len(sizes) else 0))
    if not x.size:
        return x
    x = x / np.abs(x).max(axis=1, keepdims=True)  # very large and very small ones too
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def plan(sample: np.ndarray, rows: int, cosine: float, width: int, cell: int) -> Blocks:
    """Blocks for so many rows, of which sample holds some unit vectors."""
    size = sample.shape[1]
    _, axes = np.linalg.eigh(sample.T @ sample / max(1, len(sample)) + 1e-12 * np.eye(size))
    n = -(-size // width)
    order = np.concatenate([np.arange(size)[::-1][k::n] for k in range(n)])  # axes are dealt, so that blocks hold about as much
    spans, at = [], 0
    for k in range(n):
        own = len(range(k, size, n))
        spans.append((at, at + own))
        at += own
    blocks = Blocks(np.rint(axes[:, order] * GRID), spans, [], [])
    x = blocks.coordinates(sample)
    spread = np.array([max(1e-9, x[:, a:b].var(axis=0).sum()) for a, b in spans])
    # between even shares and shares of the spread, so that no block's share vanishes
    share = 0.5 * spread / spread.sum() + 0.5 * np.array([b - a for a, b in spans]) / size
    blocks.budgets = [float((2 - 2 * cosine + SLACK) * GRID * GRID * s) for s in share]
    depth = max(0, int(np.ceil(np.log2(max(1, rows / cell)))))
    depth = min(depth, max(0, int(np.log2(max(1, len(sample) / 8)))))
    for a, b in spans:
        blocks.trees.append(_tree(x[:, a:b], depth))
    return blocks


def _tree(x: np.ndarray, depth: int) -> list[tuple[int, float]]:
    """(axis, cut) of each inner node, in the order of a heap: the median on the axis of the largest spread."""
    parts, tree = [x], []
    for _ in range(depth):
        below = []
        for own in parts:
            if len(own) > 1:
                axis = int(own.var(axis=0).argmax())
                cut = float(np.median(own[:, axis]))
            else:
                axis, cut = 0, 0.0
            tree.append((axis, cut))
            high = own[:, axis] > cut
            below += [own[~high], own[high]]
        parts = below
    return tree


def _boxes(blocks: Blocks):
    """(block, cell, n, low, high) of the cells that a task's vectors fall into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        boxes: dict[tuple[int, int], list] = {}
        for batch in batches:
            x = blocks.coordinates(unit_vectors(batch.column("vector")))
            for k, (a, b) in enumerate(blocks.spans):
                cells = blocks.cells(x, k)
                for c in np.unique(cells).tolist():
                    own = x[cells == c, a:b]
                    n, low, high = len(own), own.min(axis=0), own.max(axis=0)
                    if (k, c) in boxes:
                        m, lo, hi = boxes[k, c]
                        n, low, high = n + m, np.minimum(low, lo), np.maximum(high, hi)
                    boxes[k, c] = [n, low, high]
        made = [(k, c, n, low.tolist(), high.tolist()) for (k, c), (n, low, high) in boxes.items()]
        if made:
            columns = list(zip(*made, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64())), strict=True)], ["block", "cell", "n", "low", "high"])

    return run


@dataclass
class Cells:
    """Of one block: how many pieces each cell is in, where its pieces begin, and the box of each cell (empty ones: none)."""

    pieces: np.ndarray
    starts: np.ndarray
    low: np.ndarray
    high: np.ndarray
    near: list[np.ndarray]

    @classmethod
    def of(cls, rows: list, cells: int, width: int, budget: float, cell: int) -> Cells:
        low, high, n = np.full((cells, width), np.inf), np.full((cells, width), -np.inf), np.zeros(cells, np.int64)
        for r in rows:
            low[r["cell"]], high[r["cell"]], n[r["cell"]] = r["low"], r["high"], r["n"]
        pieces = -(-n // (2 * cell))
        near = []
        for c in range(cells):
            if not n[c]:
                near.append(np.zeros(0, np.int64))
                continue
            gap = np.maximum(0, np.maximum(low - high[c], low[c] - high))
            near.append(np.flatnonzero((n > 0) & (np.square(np.where(np.isfinite(gap), gap, 0)).sum(axis=1) <= budget)))
        return cls(pieces, np.r_[0, np.cumsum(pieces)[:-1]], low, high, near)


def _sent(blocks: Blocks, cells: list[Cells]):
    """Rows (pair of pieces, side, rep, n, vector): each vector with every piece that it has to meet, its own included."""

    def targets(x: np.ndarray, reps: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray]]:
        """(rows, block, own piece of each, other piece of each)."""
        mixed = reps.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)
        for k, (a, b) in enumerate(blocks.spans):
            known, own = cells[k], blocks.cells(x, k)
            for c in np.unique(own).tolist():
                rows = np.flatnonzero(own == c)
                mine = known.starts[c] + (mixed[rows] % np.uint64(known.pieces[c])).astype(np.int64)
                for d in known.near[c].tolist():
                    gap = np.maximum(0, np.maximum(known.low[d] - x[rows, a:b], x[rows, a:b] - known.high[d]))
                    there = (gap * gap).sum(axis=1) <= blocks.budgets[k]
                    for piece in range(known.starts[d], known.starts[d] + known.pieces[d]):
                        yield rows[there], k, mine[there], np.full(int(there.sum()), piece)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps = batch.column("rep").to_numpy()
            x = blocks.coordinates(unit_vectors(batch.column("vector")))
            for rows, block, mine, other in targets(x, reps):
                # the piece with the larger number is the second side
                low, high, side = np.minimum(mine, other), np.maximum(mine, other), (mine > other).astype(np.int8)
                for a in range(0, len(rows), 2048):
                    at = slice(a, a + 2048)
                    taken = batch.take(pa.array(rows[at]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(taken), block, np.int32)), pa.array(low[at].astype(np.int32)), pa.array(high[at].astype(np.int32)), pa.array(side[at]), *[taken.column(c) for c in ("rep", "n", "vector")]], ["block", "low", "high", "side", "rep", "n", "vector"])

    return run


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows of integers, exact."""
    return (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)


def _linked(blocks: Blocks, block: int, cosine: float, ux: np.ndarray, cx: np.ndarray, uy: np.ndarray, cy: np.ndarray) -> np.ndarray:
    """True for the pairs of a tile that are linked, and for which this is the first block that finds them."""
    a, b = blocks.spans[block]
    # in single precision first, with room for its rounding
    fx, fy = (c[:, a:b].astype(np.float32) / GRID for c in (cx, cy))
    most = blocks.budgets[block] / GRID / GRID
    close = (fx * fx).sum(axis=1)[:, None] + (fy * fy).sum(axis=1)[None, :] - 2 * (fx @ fy.T) <= most + 1e-4
    rows, columns = np.flatnonzero(close.any(axis=1)), np.flatnonzero(close.any(axis=0))
    found = np.zeros(close.shape, bool)
    if len(rows):
        near = close[np.ix_(rows, columns)]
        near &= ux[rows] @ uy[columns].T >= cosine
        if near.any():
            near &= _squares(cx[rows, a:b], cy[columns, a:b]) <= blocks.budgets[block]
            for k in range(block):
                c, d = blocks.spans[k]
                near &= _squares(cx[rows, c:d], cy[columns, c:d]) > blocks.budgets[k]
            found[np.ix_(rows, columns)] = near
    return found


def _compared(blocks: Blocks, cosine: float):
    """(rep, links, near) of the vectors of two pieces that have links; near is one of a tree of the links."""

    def run(group: pa.Table) -> pa.Table:
        block, low, high = (group.column(c)[0].as_py() for c in ("block", "low", "high"))
        group = group.combine_chunks()
        reps, weights, side = (group.column(c).to_numpy() for c in ("rep", "n", "side"))
        unit = unit_vectors(group.column("vector").combine_chunks())
        x = blocks.coordinates(unit)
        one = np.flatnonzero(side == 0)
        two = one if low == high else np.flatnonzero(side == 1)
        links, label = np.zeros(len(reps), np.int64), np.arange(len(reps))
        pairs = []  # one link of each row and tile, and of each column and tile
        for i in range(0, len(one), TILE):
            for j in range(i if low == high else 0, len(two), TILE):
                r, c = one[i : i + TILE], two[j : j + TILE]
                found = _linked(blocks, block, cosine, unit[r], x[r], unit[c], x[c])
                if low == high and i == j:
                    found = np.triu(found, 1)
                if not found.any():
                    continue
                links[r] += found @ weights[c]
                links[c] += weights[r] @ found
                pairs += [(r[p], c[q]) for p, q in _forest(found)]
        label = _labels(label, pairs)
        has = np.flatnonzero((links > 0) | (label != np.arange(len(reps))))
        return pa.table({"rep": reps[has], "links": links[has], "near": reps[label[has]]})

    return run


def _forest(found: np.ndarray) -> list[tuple[int, int]]:
    """Links of a tile, fewer than its rows and columns, that connect what its links connect."""
    pairs, open_rows, open_columns = [], found.any(axis=1), found.any(axis=0)
    while open_rows.any():
        first = int(open_rows.argmax())
        rows, columns = np.array([first]), np.zeros(0, np.int64)
        open_rows[first] = False
        while len(rows):
            hit = found[rows] & open_columns
            columns = np.flatnonzero(hit.any(axis=0))
            pairs += [(int(rows[hit[:, c].argmax()]), int(c)) for c in columns]
            open_columns[columns] = False
            back = found[:, columns] & open_rows[:, None]
            rows = np.flatnonzero(back.any(axis=1))
            pairs += [(int(r), int(columns[back[r].argmax()])) for r in rows]
            open_rows[rows] = False
    return pairs


def _labels(label: np.ndarray, pairs: list[tuple[int, int]]) -> np.ndarray:
    """The smallest row that each row is connected to."""
    parent = label.tolist()

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for a, b in pairs:
        a, b = root(int(a)), root(int(b))
        parent[max(a, b)] = min(a, b)
    return np.array([root(k) for k in range(len(parent))], np.int64)


def _links(reps: DataFrame, rows: int, cosine: float, width: int, cell: int) -> DataFrame:
    """(rep, links, near): per comparison of two pieces, the links of a vector to others and one neighbour in their forest."""
    spark = reps.sparkSession
    sample = unit_vectors(reps.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("vector").toArrow().column("vector").combine_chunks())
    blocks = plan(sample, rows, cosine, width, cell)
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = reps.repartition(parts, "rep")
    found = dealt.mapInArrow(_boxes(blocks), "block int, cell int, n long, low array<double>, high array<double>")
    ends = [f(F.get(c, F.lit(k))).alias(f"{c}{k}") for c, f in (("low", F.min), ("high", F.max)) for k in range(max(b - a for a, b in blocks.spans))]
    boxes: dict[int, list] = {}
    for r in found.groupBy("block", "cell").agg(F.sum("n").alias("n"), *ends).collect():
        own = blocks.spans[r["block"]][1] - blocks.spans[r["block"]][0]
        boxes.setdefault(r["block"], []).append({"cell": r["cell"], "n": r["n"], "low": [r[f"low{k}"] for k in range(own)], "high": [r[f"high{k}"] for k in range(own)]})
    cells = [Cells.of(boxes[k], len(blocks.trees[k]) + 1, b - a, blocks.budgets[k], cell) for k, (a, b) in enumerate(blocks.spans)]
    kind = reps.schema["vector"].dataType.simpleString()
    sent = dealt.mapInArrow(_sent(blocks, cells), f"block int, low int, high int, side byte, rep long, n long, vector {kind}")
    return sent.groupBy("block", "low", "high").applyInArrow(_compared(blocks, cosine), "rep long, links long, near long")


def vector_links(df: DataFrame, *, key: str = "vec_id", vector: str = "embedding", cosine: float = COSINE, width: int = WIDTH, cell: int | None = None) -> DataFrame:
    """(key, n_links, component_id, kept): links of each vector to others, and the smallest key that links lead to.

    Two rows are linked where the cosine of their vectors, in doubles, is
    ``cosine`` or more (over 0); rows with equal vectors are linked. Null and
    empty vectors, zero ones, and those with null or non-finite components are
    linked with nothing. Every row is returned, repeated ones and null keys
    too; kept is true where the key is the component's smallest (a null key,
    where all keys of its component are null). Vectors that can be linked must
    have one length. Other columns of df don't matter. Rows that share a key
    but not a vector are different vectors.

    Equal vectors are joined with their representative by the vector, a join
    Spark may split. What comes to the driver are a sample of SAMPLE vectors
    and the cells' boxes, one for ``cell`` vectors in each block (see CELL_ROOT if it isn't given).
    """
    if not 0 < cosine <= 1:
        raise ValueError("cosine must be over 0, and 1 at most")
    rows = df.select(F.col(key).alias("key"), F.col(vector).alias("vector"))
    usable = finite(F.col("vector")) & F.exists("vector", lambda x: x != 0)
    rows = materialise(rows.withColumn("vector", F.when(F.coalesce(usable, F.lit(False)), F.transform("vector", lambda x: x + F.lit(0).cast("float")))))
    each = rows.where("vector is not null").groupBy("vector").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("least"))
    reps = materialise(each.select(F.monotonically_increasing_id().alias("rep"), "n", "least", "vector"))
    n = reps.count()
    if n:
        pairs = materialise(_links(reps.select("rep", "n", "vector"), n, cosine, width, cell or int(min(CELL_MOST, max(CELL_LEAST, CELL_ROOT * n**0.5)))))
        counts = pairs.groupBy("rep").agg(F.sum("links").alias("links"))
        labels = components(pairs.where("rep <> near").select(F.col("rep").alias("a"), F.col("near").alias("b")))
    else:
        pairs = None
        counts, labels = reps.select("rep", F.lit(0).alias("links")), reps.select(F.col("rep").alias("node"), F.col("rep").alias("component"))
    known = reps.join(counts, "rep", "left").join(labels, reps.rep == labels.node, "left").select("rep", "n", "least", "vector", "links", F.coalesce("component", "rep").alias("component"))
    known = materialise(known)
    smallest = known.groupBy("component").agg(F.min("least").alias("_smallest"))
    known = known.join(smallest, "component").select("vector", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "_smallest")
    found = rows.join(known, "vector", "left")
    linkless = F.col("n_links").isNull()
    component = F.when(linkless, F.col("key")).otherwise(F.col("_smallest"))
    made = found.select(F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("key").eqNullSafe(component).alias("kept"))
    if pairs is not None:
        discard(pairs)
    return made


def op13_vector_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at cosine 0.9."""
    return vector_links(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = f"""
WITH RECURSIVE usable AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= {COSINE}),
reach AS (
  SELECT vec_id AS node, vec_id AS reached FROM embeddings
  UNION
  SELECT reach.node, links.b FROM reach JOIN links ON reach.reached = links.a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(c.n, 0) AS n_links, r.component_id, e.vec_id = r.component_id AS kept
FROM embeddings e JOIN (SELECT node, min(reached) AS component_id FROM reach GROUP BY node) r ON e.vec_id = r.node
LEFT JOIN counts c ON c.a = e.vec_id
"""
