"""Many fits of one table at once: what each pass over the rows yields is summed for all of them.

A fit takes a label, some of the columns, and the rows to train on: all rows of
the table but those tested in one fold of one repetition, or simply all. The
table is written once as blocks of rows (values, label codes, and the folds
each row is tested in), and every pass reads the blocks once for all fits that
still run. Sums are made in the
tasks, then by Spark per slot; what comes to the driver has the size of the
models, not of the table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidewell.sources.shared import new_path, remove

#: Rows of a block, and numbers that a pass holds at once for a block and some of the fits.
BLOCK, AT_ONCE = 2048, 4_000_000

#: The sums of so few tasks, and of so many numbers at most, are added on the driver; those of more are added by Spark first.
FEW, FEW_NUMBERS = 8, 250_000

#: Numbers that a task's part of a pass is worth; with more, blocks are dealt to more tasks.
WORK = 4_000_000

#: More labels than that are no classes.
MAX_CLASSES = 1000

NAMES = ("pid", "y", "x", "row", "fold")
SCHEMA = "pid array<string>, y binary, x binary, row binary, fold binary"


def few(parts: int, numbers: int) -> bool:
    """Whether the driver may add up the sums of so many tasks, each of so many numbers."""
    return parts == 1 or parts <= FEW and parts * numbers <= FEW_NUMBERS


@dataclass
class Block:
    """Rows of the table: ids, codes of every label, values, and (row, fold) of the folds that rows are tested in."""

    pid: list[str]
    y: np.ndarray
    x: np.ndarray
    tested: tuple[np.ndarray, np.ndarray]

    def trains(self, folds: np.ndarray) -> np.ndarray:
        """Rows by folds (a fold may be asked for several times): whether the row is trained on."""
        return trained(len(self.y), self.tested, folds)


def trained(rows: int, tested: tuple[np.ndarray, np.ndarray], folds: np.ndarray) -> np.ndarray:
    """Rows by folds: whether the row is trained on, as tested holds (row, fold) of the folds it is tested in."""
    every, back = np.unique(folds, return_inverse=True)
    made = np.ones((rows, len(every)), bool)
    at = np.searchsorted(every, tested[1])
    hit = at < len(every)
    hit[hit] = every[at[hit]] == tested[1][hit]
    made[tested[0][hit], at[hit]] = False
    return made[:, back]


@dataclass
class Fits:
    """Which label, fold and columns (a mask) each fit takes, and the condition it belongs to."""

    condition: np.ndarray
    label: np.ndarray
    fold: np.ndarray
    mask: np.ndarray

    def __len__(self) -> int:
        return len(self.label)


class Table:
    """A table in blocks, the classes of its labels, and the names (rep, fold) of its folds."""

    def __init__(self, data: DataFrame, columns: list[str] | str, labels: list[str] | str, folds: DataFrame | None = None, key: str = "pid"):
        """data: key, labels, columns; folds: (rep, fold, pid), or None to train on all rows.

        columns are names, or the name of a vector column. Null values or
        labels are errors. Rows in no fold are trained on in every fit.
        """
        self.labels = [labels] if isinstance(labels, str) else list(labels)
        kinds = {dict(data.dtypes)[c] for c in self.labels}
        self.kind = kinds.pop() if len(kinds) == 1 else "string"
        found = [sorted({r[0] for r in data.select(F.col(c).cast(self.kind)).distinct().limit(MAX_CLASSES + 1).collect()}, key=lambda v: (v is not None, v)) for c in self.labels]
        if any(None in own for own in found):
            raise ValueError("null labels")
        if any(len(own) > MAX_CLASSES for own in found):
            raise ValueError(f"more than {MAX_CLASSES} classes")
        self.classes = found
        codes = [F.create_map(*[x for k, v in enumerate(own) for x in (F.lit(v).cast(self.kind), F.lit(k))])[F.col(c).cast(self.kind)] if own else F.lit(0) for c, own in zip(self.labels, found, strict=True)]
        values = vector_to_array(columns) if isinstance(columns, str) else F.array(*[F.col(c).cast("double") for c in columns])
        rows = data.select(F.col(key).cast("string").alias("pid"), F.array(*codes).alias("y"), values.alias("x"))
        if folds is None:
            self.names = [(0, 0)]
            rows = rows.withColumn("tested", F.array().cast("array<int>"))
        else:
            self.names = sorted((r["rep"], r["fold"]) for r in folds.select("rep", "fold").distinct().collect())
            number = F.create_map(*[x for k, (rep, fold) in enumerate(self.names) for x in (F.lit(f"{rep}:{fold}"), F.lit(k))])[F.concat_ws(":", F.col("rep").cast("string"), F.col("fold").cast("string"))] if self.names else F.lit(0)
            tests = folds.groupBy(F.col("pid").cast("string").alias("pid")).agg(F.sort_array(F.collect_set(number)).alias("tested"))
            rows = rows.join(tests, "pid", "left").withColumn("tested", F.coalesce("tested", F.array().cast("array<int>")))
        at = new_path(data.sparkSession)
        rows.mapInArrow(_blocks, SCHEMA).write.parquet(at)
        self.paths: list[str] = []
        self._take(data.sparkSession, at)
        self.rows, self.width = 0, 0
        if sizes := self.summed(lambda b: [(0, np.array([len(b.y), b.x.size]))]):
            self.rows, self.width = int(sizes[0][0]), int(sizes[0][1] // sizes[0][0])

    def _take(self, spark: SparkSession, at: str) -> None:
        self.paths.append(at)
        self.blocks = spark.read.schema(SCHEMA).parquet(at)
        self.parts = self.blocks.rdd.getNumPartitions()

    def spread(self, numbers: int) -> int:
        """Deal the blocks anew to as many tasks as passes of so many numbers a row are worth, at most one for each core; their number.

        What has been read from the blocks before stays valid until the table is discarded.
        """
        spark = self.blocks.sparkSession
        wanted = min(spark.sparkContext.defaultParallelism, -(-self.rows // BLOCK), self.rows * numbers // WORK)
        if wanted > self.parts:
            at = new_path(spark)
            self.blocks.repartition(wanted).write.parquet(at)
            self._take(spark, at)
        return self.parts

    def values(self) -> DataFrame:
        """(x) of every row, from the blocks as they were first written, so that nothing made of it hangs on how they were dealt since."""

        def run(block: Block) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(block.x), pa.list_(pa.float64()))], ["x"])

        return self.each(run, "x array<double>", self.blocks.sparkSession.read.schema(SCHEMA).parquet(self.paths[0]))

    def fits(self, conditions: list[tuple[int, list[int] | None]] = ((0, None),)) -> Fits:
        """One fit for each condition (label, columns or None for all) and fold, in that order."""
        each = [(c, label, fold, columns) for c, (label, columns) in enumerate(conditions) for fold in range(len(self.names))]
        mask = np.zeros((len(each), self.width), bool)
        for k, (_, _, _, columns) in enumerate(each):
            mask[k, slice(None) if columns is None else columns] = True
        return Fits(*[np.array([e[i] for e in each], np.int64) for i in range(3)], mask)

    def discard(self) -> None:
        """Delete the blocks, once all that reads them is written."""
        for at in self.paths:
            remove(self.blocks.sparkSession, at)

    def each(self, function: Callable[[Block], pa.RecordBatch], schema: str | StructType, blocks: DataFrame | None = None) -> DataFrame:
        """What function makes of every block (or of those given)."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    yield function(_block(batch, k))

        return (self.blocks if blocks is None else blocks).mapInArrow(run, schema)

    def summed(self, function: Callable[[Block], list[tuple[int, np.ndarray]]], numbers: int = 0) -> dict[int, np.ndarray]:
        """Sums over all blocks of what function yields as (slot, values), about so many numbers; a slot nothing is yielded for is absent."""

        def sums(blocks: Iterator[Block]) -> dict[int, np.ndarray]:
            total: dict[int, np.ndarray] = {}
            for block in blocks:
                for slot, values in function(block):
                    total[slot] = total[slot] + values if slot in total else values
            return {slot: np.asarray(v, float).ravel() for slot, v in total.items()}

        if few(self.parts, numbers):
            # a job on rows starts sooner than a query
            made: dict[int, np.ndarray] = {}
            for found in self.blocks.rdd.mapPartitions(lambda rows: [sums(map(_row_block, rows))]).collect():
                for slot, v in found.items():
                    made[slot] = made[slot] + v if slot in made else v
            return made

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = sums(_block(batch, k) for batch in batches for k in range(batch.num_rows))
            if total:
                offsets = np.r_[0, np.cumsum([len(v) for v in total.values()])].astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([*total], pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*total.values()])))], ["slot", "v"])

        added = self.blocks.mapInArrow(run, "slot int, v array<double>").groupBy("slot").agg(Summarizer.sum(array_to_vector("v")).alias("v"))
        found = added.select("slot", vector_to_array("v").alias("v")).toArrow()
        if not found.num_rows:
            return {}
        values = found.column("v").combine_chunks()
        flat, ends = values.flatten().to_numpy(), np.cumsum(values.value_lengths().to_numpy())
        return dict(zip(found.column("slot").to_pylist(), np.split(flat, ends[:-1]), strict=True))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            part = batch.slice(start, BLOCK)
            lists = {c: part.column(c) for c in ("y", "x", "tested")}
            flat = {c: v.flatten() for c, v in lists.items()}
            if any(lists[c].null_count or flat[c].null_count for c in ("y", "x")):
                raise ValueError("null values or labels")
            x = flat["x"].to_numpy(zero_copy_only=False).astype(float)
            row = np.repeat(np.arange(part.num_rows), lists["tested"].value_lengths().to_numpy(zero_copy_only=False)).astype(np.int32)
            binary = [flat["y"].to_numpy(zero_copy_only=False).astype(np.int32), x, row, flat["tested"].to_numpy(zero_copy_only=False).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array([part.column("pid").to_pylist()], pa.list_(pa.string())), *[pa.array([v.tobytes()], pa.binary()) for v in binary]], list(NAMES))


def _block(batch: pa.RecordBatch, k: int) -> Block:
    return _row_block({c: batch.column(c)[k].as_py() for c in NAMES})


def _row_block(row: Mapping) -> Block:
    y, x, at, fold = (np.frombuffer(row[c], t) for c, t in (("y", np.int32), ("x", float), ("row", np.int32), ("fold", np.int32)))
    pid = row["pid"]
    return Block(pid, y.reshape(len(pid), -1), x.reshape(len(pid), -1), (at, fold))


@dataclass
class Logistic:
    """Balanced logistic models of all fits: coefficients (fit, class, column) and intercepts on the columns as they are, and the classes that were there."""

    weights: np.ndarray
    intercepts: np.ndarray
    present: np.ndarray

    def probabilities(self, x: np.ndarray, fit: int) -> np.ndarray:
        s = np.where(self.present[fit], x @ self.weights[fit].T + self.intercepts[fit], -np.inf)
        e = np.exp(s - s.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def codes(self, x: np.ndarray, fit: int) -> np.ndarray:
        return self.probabilities(x, fit).argmax(axis=1)


def _moments(table: Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class counts by label, means, population deviations) of each fold's training rows, from the sums of all rows and those tested."""
    sizes, d, folds = [len(c) for c in table.classes], table.width, len(table.names)
    k = max(sizes)

    def plain(b: Block):
        return [(0, np.concatenate([b.x.sum(axis=0), (b.x * b.x).sum(axis=0)]))]

    sums = table.summed(plain)[0]
    centre = sums[:d] / table.rows
    scale = np.sqrt(np.maximum(0, sums[d:] / table.rows - centre**2))
    scale[scale == 0] = 1.0

    def of(y: np.ndarray, z: np.ndarray) -> np.ndarray:
        counts = [np.bincount(y[:, i], minlength=k) for i in range(len(sizes))]
        return np.concatenate([*counts, z.sum(axis=0), (z * z).sum(axis=0)])

    def about(b: Block):
        z = (b.x - centre) / scale
        row, fold = b.tested
        order = np.argsort(fold, kind="stable")
        made = [(folds, of(b.y, z))]
        for own in np.split(order, np.flatnonzero(np.diff(fold[order])) + 1) if len(order) else []:
            made.append((int(fold[own[0]]), of(b.y[row[own]], z[row[own]])))
        return made

    found = table.summed(about, (folds + 1) * (k * len(sizes) + 2 * d))
    left = np.array([found[folds] - found.get(f, 0.0) for f in range(folds)])
    counts = np.rint(left[:, : k * len(sizes)]).reshape(folds, len(sizes), k)
    n = np.maximum(1, counts[:, 0].sum(axis=1))[:, None]
    mean = left[:, k * len(sizes) : -d] / n
    spread = np.sqrt(np.maximum(0, left[:, -d:] / n - mean**2))
    return counts, centre + mean * scale, np.where(spread < 1e-12, 1.0, spread * scale)  # a constant column stays as it is


def fit_logistic(table: Table, fits: Fits | None = None, c: float = 1.0, tolerance: float = 1e-7, most: int = 500, history: int = 12) -> Logistic:
    """Every fit's L2 logistic regression with balanced class weights on columns standardised by its training rows.

    Limited-memory BFGS runs for all fits side by side: each pass over the
    table gives the loss and gradient of every fit at a point of its own, and a
    fit is done when its gradient is so small that, as the penalty makes the
    loss strongly convex, no coefficient is off by more than ``tolerance`` (or
    when rounding lets it get no smaller). Two classes have one set of
    coefficients, more have one each. A class absent from a fit's training rows
    is never predicted by it; a fit with one class predicts that.
    """
    fits = table.fits() if fits is None else fits
    k, d, n_fits = max((len(x) for x in table.classes), default=0), table.width, len(fits)
    if not table.rows:
        return Logistic(np.zeros((n_fits, k, d)), np.zeros((n_fits, k)), np.zeros((n_fits, k), bool))
    table.spread(n_fits * k * (d + 1))
    counts, mean, scale = _moments(table)
    counts, mean, scale = counts[fits.fold, fits.label], mean[fits.fold], scale[fits.fold]
    present = counts > 0
    free = present & ~((present.sum(axis=1, keepdims=True) <= 2) & (np.cumsum(present, axis=1) == 1))
    free = free[:, :, None] & np.concatenate([fits.mask, np.ones((n_fits, 1), bool)], axis=1)[:, None, :]
    n = counts.sum(axis=1)
    weight = np.divide(n[:, None], present.sum(axis=1, keepdims=True) * counts, out=np.zeros((n_fits, k)), where=present)
    penalty = np.r_[np.full(d, 1.0 / c), 0.0]

    def evaluate(points: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Loss and gradient of the fits ``who`` at points (fit, class, column and intercept)."""
        w = points[:, :, :d] / scale[who, None, :]
        b = points[:, :, d] - (w * mean[who, None, :]).sum(axis=2)
        step = max(1, AT_ONCE // (BLOCK * k))
        own = []
        for a in range(0, len(who), step):
            mine = who[a : a + step]
            there = np.where(present[mine], b[a : a + step], -np.inf)
            own.append((np.ascontiguousarray(w[a : a + step].transpose(1, 2, 0)), np.ascontiguousarray(there.T)[:, None, :], np.ascontiguousarray(weight[mine].T), fits.label[mine], fits.fold[mine]))

        def gradients(block: Block):
            """Losses and gradients of a part of the fits at a time, by (class, row, fit), so that classes are far apart and fits together."""
            made, rows = [], len(block.y)
            for part, (w, b, weights, label, fold) in enumerate(own):
                s = np.matmul(block.x, w)
                s += b
                s -= s.max(axis=0)
                row_weight, hit, target = np.empty((rows, len(label))), np.empty(s.shape, bool), s[0].copy()
                for one in np.unique(label):
                    which, y = np.flatnonzero(label == one), block.y[:, one]
                    row_weight[:, which] = weights[:, which][y]
                    hit[:, :, which] = (y == np.arange(k)[:, None])[:, :, None]
                row_weight *= block.trains(fold)
                for c in range(1, k):
                    np.copyto(target, s[c], where=hit[c])
                e = np.exp(s, out=s)
                total = e.sum(axis=0)
                with np.errstate(invalid="ignore"):
                    loss = np.where(row_weight > 0, row_weight * (np.log(total) - target), 0.0).sum(axis=0)
                e /= total
                e -= hit
                e *= row_weight
                g = np.matmul(e.transpose(0, 2, 1), block.x).transpose(1, 0, 2).reshape(len(label), -1)
                made += [(part * step + i, v) for i, v in enumerate(np.concatenate([loss[:, None], g, e.sum(axis=1).T], axis=1))]
            return made

        found = table.summed(gradients, len(who) * (1 + k * (d + 1)))
        sums = np.array([found[i] for i in range(len(who))])
        bias = sums[:, 1 + k * d :]
        g = (sums[:, 1 : 1 + k * d].reshape(-1, k, d) - bias[:, :, None] * mean[who, None, :]) / scale[who, None, :]
        gradient = (np.concatenate([g, bias[:, :, None]], axis=2) + penalty * points) * free[who]
        return sums[:, 0] + 0.5 * (penalty * points * points).sum(axis=(1, 2)), gradient

    points = _minimised(evaluate, np.zeros((n_fits, k, d + 1)), n, tolerance / c, most, history)
    w = points[:, :, :d] / scale[:, None, :]
    return Logistic(w, points[:, :, d] - (w * mean[:, None, :]).sum(axis=2), present)


def _minimised(evaluate, start: np.ndarray, rows: np.ndarray, tolerance: float, most: int, history: int) -> np.ndarray:
    """The minimum of every fit's loss. A step that doesn't lower a fit's loss enough is halved in the next pass."""
    x = start.copy()
    running = np.flatnonzero(rows > 0)
    loss, gradient = np.zeros(len(x)), np.zeros(x.shape)
    loss[running], gradient[running] = evaluate(x[running], running)
    kept: list[list[tuple[np.ndarray, np.ndarray, float]]] = [[] for _ in x]
    least = tolerance + 1e-14 * rows

    def norm(f: int) -> float:
        return float(np.sqrt((gradient[f] ** 2).sum()))

    def direction(f: int) -> np.ndarray:
        q, taken = gradient[f].copy(), []
        for s, y, rho in reversed(kept[f]):
            a = rho * (s * q).sum()
            q -= a * y
            taken.append(a)
        if kept[f]:
            s, y, rho = kept[f][-1]
            q *= 1.0 / (rho * (y * y).sum())
        else:
            q *= 1.0 / max(1.0, norm(f))
        for (s, y, rho), a in zip(kept[f], reversed(taken), strict=True):
            q += (a - rho * (y * q).sum()) * s
        return -q

    size = np.ones(len(x))
    heading = {f: direction(f) for f in running}
    running = np.array([f for f in running if norm(f) > least[f]], np.int64)
    for _ in range(most):
        if not len(running):
            break
        trial = np.array([x[f] + size[f] * heading[f] for f in running])
        now, slope = evaluate(trial, running)
        going = []
        for i, f in enumerate(running.tolist()):
            descent = (gradient[f] * heading[f]).sum()
            if now[i] > loss[f] + 1e-4 * size[f] * descent + 1e-14 * abs(loss[f]):
                size[f] /= 2
                if size[f] > 1e-10:
                    going.append(f)
                continue
            s, y = trial[i] - x[f], slope[i] - gradient[f]
            if (sy := (s * y).sum()) > 1e-300:
                kept[f] = [*kept[f][-history + 1 :], (s, y, 1.0 / sy)]
            x[f], loss[f], gradient[f], size[f] = trial[i], now[i], slope[i], 1.0
            if norm(f) > least[f]:
                heading[f] = direction(f)
                going.append(f)
        running = np.array(going, np.int64)
    return x


def tested_predictions(table: Table, fits: Fits, codes: Callable[[np.ndarray, int], np.ndarray]) -> DataFrame:
    """(condition, rep, fold, pid, y_true, y_pred): each row once for every fit it is tested in; codes gives the class numbers of values under a fit."""
    spark, names, classes = table.blocks.sparkSession, np.array(table.names, np.int32).reshape(-1, 2), table.classes
    schema = StructType.fromDDL(f"condition int, rep int, fold int, pid string, y_true {table.kind}, y_pred {table.kind}")
    if not table.rows:
        return spark.createDataFrame([], schema)
    arrow = to_arrow_schema(schema)

    def predict(block: Block) -> pa.RecordBatch:
        row, fold = block.tested
        parts = [[] for _ in schema.names]
        for f in range(len(fits)):
            own = row[fold == fits.fold[f]]
            if not len(own):
                continue
            label = classes[fits.label[f]]
            made = (np.full(len(own), fits.condition[f]), np.full(len(own), names[fits.fold[f], 0]), np.full(len(own), names[fits.fold[f], 1]), [block.pid[r] for r in own], [label[j] for j in block.y[own, fits.label[f]]], [label[j] for j in codes(block.x[own], f)])
            for part, v in zip(parts, made, strict=True):
                part.extend(v)
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(parts, arrow, strict=True)], schema=arrow)

    return table.each(predict, schema)
