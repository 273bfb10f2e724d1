"""Vector codes: product quantisation by Lloyd's rounds that look again only at parts whose bounds have failed.

Vectors are cut into equal parts, and each part position has a codebook. A part
is scanned against its whole codebook once; from then on it lies in a heap of
the entry it is assigned to, keyed by how much further the second nearest entry
is. When entries move, nothing happens to a part until the drift that has
accumulated since (its own entry's, and the largest of the others') reaches
that slack; then the part is popped and scanned again. All components are
integers, so distances, sums and codebooks are exact.

Vectors are dealt into blocks, rows of a table in the shared folder that hold
the codes and heaps of some thousand vectors. A round is one pass over the
blocks, which yields the next blocks and what the codebooks' sums change by.
Only codebooks, and sums of their size, come to the driver.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from tidewell.llm.common import discard, materialise, table

#: Components are floor(SCALE * x), and smaller than LARGEST in size, so that distances fit 64 bits.
SCALE, LARGEST = 1024, 1 << 27

#: Vectors of a block.
BLOCK = 4096

#: Bounds are taken to fail so much too early, that rounding can't hide a failure.
MARGIN = 1e-6


@dataclass
class Codebooks:
    """Integer entries (part, entry, component), rows used in them, and how far each has moved since the first round."""

    entries: np.ndarray
    sums: np.ndarray
    counts: np.ndarray
    drift: np.ndarray = field(default=None)
    others: np.ndarray = field(default=None)

    def __post_init__(self):
        if self.drift is None:
            self.drift, self.others = np.zeros(self.counts.shape), np.zeros(self.counts.shape)

    def changed(self, sums: np.ndarray, counts: np.ndarray) -> Codebooks:
        """The books after a round: every used entry becomes the floored mean of its parts.

        drift grows by an entry's step, others by the largest step among the
        other entries of the part.
        """
        sums, counts = self.sums + sums, self.counts + counts
        entries = np.where(counts[..., None] > 0, sums // np.maximum(counts, 1)[..., None], self.entries)
        step = np.sqrt(((entries - self.entries).astype(float) ** 2).sum(axis=2))
        rest = np.zeros(step.shape)
        if step.shape[1] > 1:
            top = np.sort(step, axis=1)[:, -2:]
            rest = np.where(step == top[:, 1:], top[:, :1], top[:, 1:])
        return Codebooks(entries, sums, counts, self.drift + step, self.others + rest)

    def sha256(self) -> str:
        """Digest of all entries' decimal components by part, entry and position, comma-joined."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def scan(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest entry, its squared distance, slack) of integer parts; ties go to the lower index.

    slack is the second nearest entry's distance minus the nearest's; infinite
    where there is one entry only.
    """
    n, k = len(parts), len(entries)
    code, best, slack = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, np.inf)
    for a in range(0, n, 512):
        x = parts[a : a + 512]
        # exact in 64 bits, whatever the order of the sums
        d = (x * x).sum(axis=1)[:, None] - 2 * _products(x, entries) + (entries * entries).sum(axis=1)[None, :]
        rows = np.arange(len(x))
        code[a : a + 512] = at = d.argmin(axis=1)
        best[a : a + 512] = d[rows, at]
        if k > 1:
            d[rows, at] = np.iinfo(np.int64).max
            slack[a : a + 512] = np.sqrt(d.min(axis=1).astype(float)) - np.sqrt(best[a : a + 512].astype(float))
    return code, best, slack


def _products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x @ y.T of integers: in doubles while these are exact, in integers beyond."""
    largest = [int(max(v.max(initial=0), -v.min(initial=0))) for v in (x, y)]
    if largest[0] * largest[1] * x.shape[1] < 1 << 52:
        return (x.astype(float) @ y.T.astype(float)).astype(np.int64)
    return x @ y.T


class _Heaps:
    """For each entry of one part position a heap of (key, row of the block); stored as flat arrays in heap order."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray, starts: np.ndarray):
        self.keys, self.rows, self.starts = keys, rows, starts

    def failed(self, reach: np.ndarray) -> tuple[list[int], dict[int, list]]:
        """Rows popped, whose key is within the drift (reach) of their entry, and what is left of the heaps that were touched."""
        out, touched = [], {}
        sizes = np.diff(self.starts)
        full = np.flatnonzero(sizes)
        for entry in full[self.keys[self.starts[full]] <= reach[full]].tolist():
            a, b = self.starts[entry], self.starts[entry + 1]
            heap = list(zip(self.keys[a:b].tolist(), self.rows[a:b].tolist(), strict=True))  # in heap order as it was stored
            while heap and heap[0][0] <= reach[entry]:
                out.append(heapq.heappop(heap)[1])
            touched[entry] = heap
        return out, touched

    def pushed(self, touched: dict[int, list], keys: np.ndarray, rows: np.ndarray, codes: np.ndarray) -> _Heaps:
        """These heaps with the touched ones replaced and rows added."""
        for key, row, entry in zip(keys.tolist(), rows.tolist(), codes.tolist(), strict=True):
            if entry not in touched:
                a, b = self.starts[entry], self.starts[entry + 1]
                touched[entry] = list(zip(self.keys[a:b].tolist(), self.rows[a:b].tolist(), strict=True))
            heapq.heappush(touched[entry], (key, row))
        if not touched:
            return self
        k, r, sizes = [], [], []
        for entry in range(len(self.starts) - 1):
            if entry in touched:
                heap = touched[entry]
                k.append(np.array([x[0] for x in heap], float))
                r.append(np.array([x[1] for x in heap], np.int32))
            else:
                a, b = self.starts[entry], self.starts[entry + 1]
                k.append(self.keys[a:b])
                r.append(self.rows[a:b])
            sizes.append(len(k[-1]))
        return _Heaps(np.concatenate(k), np.concatenate(r), np.r_[0, np.cumsum(sizes)].astype(np.int32))

    @classmethod
    def of(cls, keys: np.ndarray, codes: np.ndarray, entries: int) -> _Heaps:
        """Heaps of rows 0, 1, ...; sorted keys are in heap order."""
        rows = np.lexsort((keys, codes)).astype(np.int32)
        return cls(keys[rows], rows, np.searchsorted(codes[rows], np.arange(entries + 1)).astype(np.int32))

    def packed(self) -> bytes:
        return self.starts.tobytes() + self.keys.tobytes() + self.rows.tobytes()

    @classmethod
    def unpacked(cls, data: bytes, entries: int) -> _Heaps:
        starts = np.frombuffer(data, np.int32, entries + 1)
        n, at = int(starts[-1]), 4 * (entries + 1)
        return cls(np.frombuffer(data, np.float64, n, at), np.frombuffer(data, np.int32, n, at + 8 * n), starts)


def _integers(column: pa.Array, scale: int) -> np.ndarray:
    """floor(scale * x) of every component of an Arrow list column of vectors of one length."""
    sizes = np.unique(column.value_lengths().to_numpy(zero_copy_only=False))
    if len(sizes) > 1:
        raise ValueError(f"vectors of different lengths: {sizes[:5].tolist()}")
    values = np.floor(column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False) * scale)
    if len(values) and np.abs(values).max() >= LARGEST:
        raise ValueError(f"components must be under {LARGEST / scale:g} in size")
    return values.astype(np.int32).reshape(len(column), int(sizes[0]) if len(sizes) else 0)


def finite(vector: Column) -> Column:
    """True for a vector without null, NaN or infinite components; false for a null one."""
    good = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(good, F.lit(False))


def _schema(kept: DataFrame, key: str, label: str) -> tuple[StructType, StructType]:
    """Of block rows, which have sums too where ``part`` isn't null, and of coded vectors."""
    blocks = StructType([StructField("keys", ArrayType(kept.schema[key].dataType)), StructField("labels", ArrayType(kept.schema[label].dataType)), *[StructField(c, BinaryType()) for c in ("vectors", "codes")], StructField("heaps", ArrayType(BinaryType())), StructField("part", LongType()), StructField("entry", LongType()), StructField("n", LongType()), StructField("sums", ArrayType(LongType()))])
    return blocks, StructType([StructField("key", kept.schema[key].dataType), StructField("label", kept.schema[label].dataType), StructField("codes", BinaryType()), StructField("error", LongType())])


class _Sums:
    """What the vectors of one task add to the sums and counts of the entries."""

    def __init__(self, books: Codebooks):
        self.sums, self.counts = np.zeros(books.entries.shape, np.int64), np.zeros(books.counts.shape, np.int64)

    def add(self, part: int, codes: np.ndarray, vectors: np.ndarray, sign: int) -> None:
        np.add.at(self.sums[part], codes, sign * vectors)
        np.add.at(self.counts[part], codes, sign)

    def rows(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        at = np.argwhere((self.counts != 0) | (self.sums != 0).any(axis=2))
        if len(at):
            made = [{"part": int(p), "entry": int(e), "n": int(self.counts[p, e]), "sums": self.sums[p, e].tolist()} for p, e in at]
            yield pa.RecordBatch.from_pylist(made, schema=schema)


def _first_blocks(parts: int, books: Codebooks, scale: int):
    """Vectors to blocks whose parts are all scanned once."""
    entries = books.counts.shape[1]

    def run(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        total = _Sums(books)
        for keys, labels, column in _in_blocks(batches):
            x = _integers(column, scale)
            width = x.shape[1] // parts
            codes, heaps = np.zeros((parts, len(x)), np.uint16), []
            for p in range(parts):
                own = x[:, p * width : (p + 1) * width].astype(np.int64)
                code, _, slack = scan(own, books.entries[p])
                codes[p] = code
                heaps.append(_Heaps.of(slack, code, entries).packed())
                total.add(p, code, own, 1)
            yield _block(schema, keys, labels, x.tobytes(), codes.tobytes(), heaps)
        yield from total.rows(schema)

    return run


def _in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array, pa.Array]]:
    """Columns of at most BLOCK rows."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        while rows >= BLOCK:
            whole = pa.Table.from_batches(held).combine_chunks()
            yield tuple(c.combine_chunks() for c in whole.slice(0, BLOCK).columns)
            rest = whole.slice(BLOCK)
            held, rows = rest.to_batches(), rest.num_rows
    if rows:
        yield tuple(c.combine_chunks() for c in pa.Table.from_batches(held).columns)


def _block(schema: pa.Schema, keys: pa.Array, labels: pa.Array, vectors: bytes, codes: bytes, heaps: list[bytes]) -> pa.RecordBatch:
    one = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (keys, labels)]
    made = [*one, pa.array([vectors], pa.binary()), pa.array([codes], pa.binary()), pa.array([heaps], pa.list_(pa.binary())), *[pa.array([None], schema.field(c).type) for c in ("part", "entry", "n", "sums")]]
    return pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(made, schema, strict=True)], schema=schema)


def _next_blocks(parts: int, books: Codebooks):
    """Blocks after the codebooks have moved: parts whose bounds failed are popped, scanned and pushed."""
    entries = books.counts.shape[1]
    reach = books.drift + books.others

    def run(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        total = _Sums(books)
        for keys, labels, x, codes, packed in _stored(batches, parts):
            width, heaps = x.shape[1] // parts, []
            for p in range(parts):
                heap = _Heaps.unpacked(packed[p], entries)
                popped, touched = heap.failed(reach[p] + MARGIN)
                if popped:
                    rows = np.array(popped, np.int64)
                    own = x[rows, p * width : (p + 1) * width].astype(np.int64)
                    code, _, slack = scan(own, books.entries[p])
                    moved = code != codes[p, rows]
                    total.add(p, codes[p, rows[moved]].astype(np.int64), own[moved], -1)
                    total.add(p, code[moved], own[moved], 1)
                    codes[p, rows] = code
                    heap = heap.pushed(touched, slack + reach[p][code], rows, code)
                heaps.append(heap.packed())
            yield _block(schema, keys, labels, x.tobytes(), codes.tobytes(), heaps)
        yield from total.rows(schema)

    return run


def _stored(batches: Iterator[pa.RecordBatch], parts: int):
    for batch in batches:
        for k in range(batch.num_rows):
            keys, labels = batch.column("keys").slice(k, 1).flatten(), batch.column("labels").slice(k, 1).flatten()
            n = len(keys)
            x = np.frombuffer(batch.column("vectors")[k].as_py(), np.int32)
            codes = np.frombuffer(batch.column("codes")[k].as_py(), np.uint16).reshape(parts, n).copy()
            yield keys, labels, x.reshape(n, -1), codes, batch.column("heaps")[k].as_py()


def _coded(parts: int, books: Codebooks):
    """Blocks to one row for each vector, with the squared distance to its entries."""

    def run(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        for keys, labels, x, codes, _ in _stored(batches, parts):
            width, error = x.shape[1] // parts, np.zeros(len(x), np.int64)
            for p in range(parts):
                off = x[:, p * width : (p + 1) * width].astype(np.int64) - books.entries[p][codes[p]]
                error += (off * off).sum(axis=1)
            own = codes.T.astype(">u2") if books.counts.shape[1] > 256 else codes.T.astype(np.uint8)
            text = pa.array([row.tobytes() for row in np.ascontiguousarray(own)], pa.binary())
            yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip((keys, labels, text, pa.array(error)), schema, strict=True)], schema=schema)

    return run


def _mapped(df: DataFrame, run, schema: StructType) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    return df.mapInArrow(lambda batches: run(batches, arrow), schema)


def _step(df: DataFrame, run, schema: StructType, books: Codebooks) -> tuple[DataFrame, DataFrame, Codebooks]:
    """(table as written, its blocks, codebooks after the round)."""
    made = materialise(_mapped(df, run, schema))
    width = books.entries.shape[2]
    summed = made.where("part is not null").groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(width)])
    sums, counts = np.zeros(books.entries.shape, np.int64), np.zeros(books.counts.shape, np.int64)
    for r in summed.collect():
        counts[r["part"], r["entry"]] = r["n"]
        sums[r["part"], r["entry"]] = [r[f"s{k}"] for k in range(width)]
    return made, made.where("part is null"), books.changed(sums, counts)


def vector_codes(df: DataFrame, *, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = SCALE) -> DataFrame:
    """(key, label, codes, error, codebooks_sha256): product codes of the vectors, after ``rounds`` of Lloyd's method.

    codes is binary, a byte for each part (two from 257 entries on), error the
    sum of the parts' squared distances to their entries, in units of 1/scale.
    Codebooks start with the parts of the rows of the smallest keys (equal keys
    by vector, a null key last); with fewer rows they have fewer entries.
    Entries nothing is assigned to stay.

    Rows whose vector is null, or has null or non-finite components, are left
    out. Every other row is coded, repeated rows each. An empty table gives an
    empty one. Vectors of different lengths, of a length that ``parts`` doesn't
    divide, or with components of LARGEST / scale and more are errors. Other
    columns of df don't matter.

    Work is linear in the rows, whatever their labels: rows are dealt by hash
    of key and vector. The table is kept in the shared folder, twice at most.
    """
    if not 1 <= entries <= 1 << 16:
        raise ValueError("entries must be from 1 to 65536")
    spark = df.sparkSession
    kept = df.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(vector).alias("vector")).where(finite(F.col("vector")))
    blocks, coded = _schema(kept, "key", "label")
    names = [*coded.names[:2], "codes", "error"]
    start = [r["vector"] for r in kept.orderBy(F.asc_nulls_last("key"), "vector").limit(entries).collect()]
    if not start:
        return spark.createDataFrame([], StructType([*coded.fields])).withColumn("codebooks_sha256", F.lit(hashlib.sha256(b"").hexdigest())).withColumnsRenamed({"key": key, "label": label})
    size = len(start[0])
    if size % parts:
        raise ValueError(f"{parts} parts don't divide vectors of {size} components")
    first = _integers(pa.array(start, pa.list_(pa.float64())), scale).reshape(len(start), parts, size // parts).transpose(1, 0, 2).astype(np.int64)
    books = Codebooks(np.ascontiguousarray(first), np.zeros(first.shape, np.int64), np.zeros(first.shape[:2], np.int64))
    dealt = kept.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), F.xxhash64("key", "vector"))
    written, rows, run = None, dealt, _first_blocks(parts, books, scale)
    for _ in range(rounds):
        made, rows, books = _step(rows, run, blocks, books)
        if written is not None:
            discard(written)
        written, run = made, _next_blocks(parts, books)
    if rounds:
        last = materialise(_mapped(rows, run, blocks))
        discard(written)
        rows = last.where("part is null")
    else:
        rows = _mapped(rows, run, blocks).where("part is null")
    found = _mapped(rows, _coded(parts, books), coded).select(*names)
    return found.withColumn("codebooks_sha256", F.lit(books.sha256())).withColumnsRenamed({"key": key, "label": label})


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all embeddings in four bytes, with their error and that of all rows of the same label."""
    found = materialise(vector_codes(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")))
    of = found.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    return found.join(of, F.col("label").eqNullSafe(F.col("_label"))).select("vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", "codebooks_sha256")


def _oracle(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = SCALE) -> str:
    """The same in SQL, each round against all entries."""
    near = """
  SELECT vec_id, part, x, arg_min({{k: entry, d: d}}, (d, entry)) AS best
  FROM (SELECT p.vec_id, p.part, p.x, b.entry, list_sum(list_transform(list_zip(p.x, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
        FROM parts p JOIN b{k} b ON p.part = b.part)
  GROUP BY vec_id, part, x"""
    sql = f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
parts AS (
  SELECT vec_id, part, v[1 + part * (len(v) // {parts}) : (part + 1) * (len(v) // {parts})] AS x
  FROM kept, (SELECT unnest(range({parts})) AS part)),
ranked AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept),
b0 AS (SELECT part, entry, x AS c FROM parts JOIN ranked USING (vec_id) WHERE entry < {entries})"""
    for k in range(rounds):
        sql += f""",
n{k} AS MATERIALIZED ({near.format(k=k)}),
m{k} AS (
  SELECT part, entry, list(m ORDER BY i) AS c
  FROM (SELECT part, entry, i, CAST(floor(sum(x) / count(*)) AS BIGINT) AS m
        FROM (SELECT part, best.k AS entry, unnest(x) AS x, unnest(range(len(x))) AS i FROM n{k})
        GROUP BY part, entry, i)
  GROUP BY part, entry),
b{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.c, b.c) AS c FROM b{k} b LEFT JOIN m{k} m USING (part, entry))"""
    return f"""{sql},
n{rounds} AS MATERIALIZED ({near.format(k=rounds)}),
coded AS (
  SELECT vec_id, string_agg(lower(printf('%02x', CAST(best.k AS INTEGER))), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error
  FROM n{rounds} GROUP BY vec_id),
books AS (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, i)) AS codebooks_sha256
          FROM (SELECT part, entry, unnest(c) AS c, unnest(range(len(c))) AS i FROM b{rounds}))
SELECT c.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded c JOIN kept k USING (vec_id), books
"""


ORACLE_SQL = _oracle()
