"""Benchmark decontamination by pigeonhole edit matching.

An item that occurs in a document with at most k edits leaves at least one of
its k+1 pieces untouched. An Aho-Corasick automaton of all pieces finds exact
piece hits; each hit says where the item would start, and Myers' bit-parallel
distance over that stretch of the document decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from tidewell.llm.common import append_columns, table


@dataclass(frozen=True)
class Matching:
    """error_rate: edits allowed per character of an item.

    An item so short that the rate allows it no edit is found between word
    boundaries only, so that "no" isn't found in "nothing".
    block_chars bounds the text of the items that are sent to the executors at
    once; more items make more passes over the documents.
    """

    error_rate: float = 0.06
    block_chars: int = 4_000_000


def normal(text: str | None) -> str:
    """Lower case, single spaces."""
    return " ".join((text or "").lower().split())


def pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """(start, piece) of edits+1 pieces of nearly equal length that make up item."""
    cuts = [len(item) * k // (edits + 1) for k in range(edits + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(item: str, text: str) -> tuple[int, int]:
    """(distance, end) of the stretch of text nearest to item; the earliest end among equals."""
    where: dict[str, int] = {}
    for k, c in enumerate(item):
        where[c] = where.get(c, 0) | 1 << k
    full, top = (1 << len(item)) - 1, 1 << len(item) - 1
    up, down, score, best = full, 0, len(item), (len(item), 0)
    for k, c in enumerate(text):
        same = where.get(c, 0)
        vertical = same | down
        across = (((same & up) + up) ^ up) | same
        rise, fall = down | ~(across | up) & full, up & across
        if rise & top:
            score += 1
        elif fall & top:
            score -= 1
        rise, fall = rise << 1 & full, fall << 1 & full
        up, down = fall | ~(vertical | rise) & full, rise & vertical
        if score < best[0]:
            best = (score, k + 1)
            if not score:
                break
    return best


class Matcher:
    """Piece automaton of a block of (item id, normalised text)."""

    def __init__(self, items: list[tuple], spec: Matching):
        self.items = [(i, t, int(spec.error_rate * len(t))) for i, t in items if t]
        hits: dict[str, list[tuple[int, int]]] = {}
        for n, (_, text, edits) in enumerate(self.items):
            for start, piece in pieces(text, edits):
                hits.setdefault(piece, []).append((n, start))
        self.automaton = ahocorasick.Automaton()
        for piece, places in hits.items():
            self.automaton.add_word(piece, (len(piece), places))
        if hits:
            self.automaton.make_automaton()

    def find(self, text: str | None) -> list[tuple]:
        """(item's number, distance, end) of each item found in text; its nearest occurrence, the earliest among equals."""
        doc = normal(text)
        if not doc or not self.items:
            return []
        starts: dict[int, list[int]] = {}
        for end, (size, places) in self.automaton.iter(doc):
            for n, start in places:
                starts.setdefault(n, []).append(end + 1 - size - start)
        found = []
        for n, at in starts.items():
            _, item, edits = self.items[n]
            best = None
            if not edits:
                ends = [a + len(item) for a in at if not (doc[a - 1 : a].isalnum() and item[0].isalnum()) and not (doc[a + len(item) : a + len(item) + 1].isalnum() and item[-1].isalnum())]
                if ends:
                    found.append((n, 0, min(ends)))
                continue
            for first, last in self._stretches(sorted(set(at)), len(item), edits):
                low = max(0, first)
                distance, end = myers(item, doc[low:last])
                if distance <= edits and (best is None or distance < best[1]):
                    best = (n, distance, low + end)
            if best:
                found.append(best)
        return found

    @staticmethod
    def _stretches(starts: list[int], size: int, edits: int) -> Iterator[tuple[int, int]]:
        """Overlapping stretches of the document joined, so each character is compared once an item."""
        first, last = starts[0] - edits, starts[0] + size + edits
        for s in starts[1:]:
            if s - edits > last:
                yield first, last
                first = s - edits
            last = s + size + edits
        yield first, last


def _blocks(benchmark: DataFrame, spec: Matching, key: str, text: str) -> Iterator[list[tuple]]:
    """The items in blocks of about spec.block_chars characters, each collected on its own."""
    rows = benchmark.select(F.col(key).alias("k"), F.col(text).alias("t")).where("t is not null")
    chars = rows.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    blocks = max(1, -(-chars // spec.block_chars))
    for n in range(blocks):
        block = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("k", "t"), F.lit(blocks)) == n)
        yield sorted({(r["k"], normal(r["t"])) for r in block.collect()}, key=lambda x: (str(x[0]), x[1]))


def leaks(docs: DataFrame, benchmark: DataFrame, spec: Matching | None = None, *, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item, distance, end_char) for every item found in a document; each row of docs is searched whole.

    end_char counts in the lower-cased document with single spaces. Null and
    blank texts contain nothing, and null or blank items are looked for
    nowhere. An item with a null id is found under that null id. Repeated
    items (id and text) count once. Documents are searched where they are read;
    nothing is shuffled. Where both columns have one name, the item's is
    called benchmark_<name>.
    """
    spec = spec or Matching()
    named = f"benchmark_{item}" if item == key else item
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    kind = StructType([StructField("item", benchmark.schema[item].dataType), StructField("distance", LongType()), StructField("end_char", LongType())])
    arrow = pa.list_(to_arrow_type(kind))
    found = None
    for items in _blocks(benchmark, spec, item, item_text):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def run(column: pa.Array, sent=sent, state=[]) -> list[pa.Array]:  # noqa: B006
            if not state:
                state.append(Matcher(sent.value, spec))
            got = [[{"item": state[0].items[n][0], "distance": d, "end_char": e} for n, d, e in state[0].find(t.as_py())] for t in column]
            return [pa.array(got, arrow)]

        hits = append_columns(rows, ["_text"], StructType([StructField("hits", ArrayType(kind))]), run)
        hits = hits.select("_key", F.explode("hits").alias("h")).select(F.col("_key").alias(key), F.col("h.item").alias(named), "h.distance", "h.end_char")
        found = hits if found is None else found.unionByName(hits)
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame, spec: Matching | None = None, *, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs without the rows that contain a benchmark item; all other rows stay, unchanged."""
    spec = spec or Matching()
    columns = docs.columns
    for items in _blocks(benchmark, spec, item, item_text):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def run(column: pa.Array, sent=sent, state=[]) -> list[pa.Array]:  # noqa: B006
            if not state:
                state.append(Matcher(sent.value, spec))
            return [pa.array([bool(state[0].find(t.as_py())) for t in column], pa.bool_())]

        docs = append_columns(docs, [text], "_tw_leaks boolean", run).where("not _tw_leaks").select(columns)
    return docs


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item found in a document."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
