"""Harmonic packing of token ids into fixed-capacity sequences.

Lengths are partitioned into reciprocal-capacity classes: class k holds the
lengths of which k fit a sequence and k+1 don't, those from capacity/(k+1)
(exclusive) to capacity/k. A class's bins take exactly k pieces each, whatever
their lengths. To leave little padding, a document's ids are first cut where a
class ends: into whole sequences, powers of two, and one short tail, whose
class is narrow. Workers fill the bins of their share of the pieces without
talking to each other; all they need is how many pieces of each class the
shares before theirs hold.
"""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidewell.llm.common import by_whole_text, materialise, table


@dataclass(frozen=True)
class Packing:
    """capacity and shortest_power are powers of two; tokenizer is a path, None for the packaged byte-level BPE."""

    capacity: int = 2048
    shortest_power: int = 64
    end_id: int = 1
    tokenizer: str | None = None

    def __post_init__(self):
        for n in (self.capacity, self.shortest_power):
            if n < 1 or n & (n - 1):
                raise ValueError(f"{n} is not a power of two")


class Encoder:
    """Ids of a byte-level BPE tokenizer file, as the tokenizers library gives them.

    The file's vocabulary is run by tiktoken, which is several times as fast.
    A text that holds one of the file's added tokens, or that tiktoken's
    pattern engine gives up on, goes to the tokenizers library, which gives an
    added token its own id.
    """

    def __init__(self, path: str | None):
        import public_tokenizers
        import tiktoken

        self.path = path or public_tokenizers.path("byte_bpe_50k.json")
        with open(self.path, encoding="utf-8") as file:
            spec = json.load(file)
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(sorted({*range(256)} - {*visible}))}
        ranks = {bytes(byte_of[c] for c in token): n for token, n in spec["model"]["vocab"].items() if token not in self.added}
        self._fast = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._slow = None

    def __call__(self, text: str) -> np.ndarray:
        if any(t in text for t in self.added):
            return self.by_library(text)
        try:
            return np.asarray(self._fast.encode_ordinary(text), dtype="<u4")
        except ValueError:
            return self.by_library(text)

    def by_library(self, text: str) -> np.ndarray:
        if self._slow is None:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_file(self.path)
        return np.asarray(self._slow.encode(text, add_special_tokens=False).ids, dtype="<u4")


def cut(n: int, capacity: int, shortest_power: int) -> list[int]:
    """Lengths of the pieces of n ids: whole sequences, powers of two, a tail below shortest_power."""
    lengths, rest = [capacity] * (n // capacity), n % capacity
    power = capacity // 2
    while power >= shortest_power:
        if rest & power:
            lengths.append(power)
            rest -= power
        power //= 2
    while rest:
        lengths.append(min(rest, max(1, shortest_power - 1)))
        rest -= lengths[-1]
    return lengths


def tokenise(docs: DataFrame, spec: Packing, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens. A null text is empty: its end id alone."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    names = ("start", "length", "ids_crc32", "doc_tokens")
    schema = StructType([rows.schema["doc_id"], *[StructField(n, LongType()) for n in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(spec.tokenizer)
        for batch in batches:
            row, made = [], []
            for k, text in enumerate(batch.column(1)):
                ids = np.append(encode(text.as_py() or ""), np.uint32(spec.end_id)).astype("<u4")
                start = 0
                for length in cut(len(ids), spec.capacity, spec.shortest_power):
                    row.append(k)
                    made.append((start, length, zlib.crc32(ids[start : start + length].tobytes()), len(ids)))
                    start += length
            columns = np.array(made, dtype=np.int64).reshape(-1, 4).T
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), *map(pa.array, columns)], schema.names)

    return by_whole_text(rows).mapInArrow(run, schema)


def place(pieces: DataFrame, capacity: int) -> DataFrame:
    """pieces (doc_id, start, length, ...) with sequence_id and offset.

    Pieces are dealt by hash into about sqrt(n) shares. In each share they are
    ranked within their class k; counts of the shares before give their rank
    among all pieces of the class, hence their bin of k. Each class's last,
    incomplete bin (fewer than k pieces, so at most some capacity * log(capacity)
    rows altogether, whatever the size of the table) goes to a next-fit by
    falling length.
    """
    shares = max(1, math.isqrt(pieces.count()))
    dealt = pieces.withColumns({"share": F.pmod(F.xxhash64("doc_id", "start"), F.lit(shares)), "k": F.expr(f"{capacity} div length")})
    before = Window.partitionBy("k").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("k", "share").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select("k", "share", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"), F.sum("n").over(Window.partitionBy("k")).alias("total"))
    within = Window.partitionBy("k", "share").orderBy("doc_id", "start", "ids_crc32")
    ranked = dealt.withColumn("rank", F.row_number().over(within) - 1).join(counts, ["k", "share"])
    ranked = ranked.withColumn("rank", F.col("first") + F.col("rank"))
    ranked = ranked.withColumn("whole", F.expr("rank < total - total % k"))
    in_bin = Window.partitionBy("sequence_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    full = ranked.where("whole").withColumn("sequence_id", F.expr(f"(rank div k) * {2 * capacity} + k"))
    full = full.withColumn("offset", F.coalesce(F.sum("length").over(in_bin), F.lit(0))).select(*pieces.columns, "sequence_id", "offset")

    rest = ranked.where("not whole").select(*pieces.columns, F.lit(0).alias("one"))
    schema = StructType([*pieces.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])

    def next_fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop(columns="one").sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable")
        sequence, used, at = 0, 0, []
        for length in rows["length"]:
            if used + length > capacity:
                sequence, used = sequence + 1, 0
            at.append((sequence * 2 * capacity, used))
            used += length
        return rows.assign(sequence_id=[x[0] for x in at], offset=[x[1] for x in at])

    return full.unionByName(rest.groupBy("one").applyInPandas(next_fit, schema))


def pack(docs: DataFrame, spec: Packing | None = None, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Sequences are gapless from offset 0. Every row of docs is packed, repeated
    and empty ones too; an empty table gives an empty result. Columns of docs
    other than key and text are not read.
    """
    spec = spec or Packing()
    return place(materialise(tokenise(docs, spec, key=key, text=text)), spec.capacity)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 ids."""
    return pack(table(spark, sf_dir, "documents"))
