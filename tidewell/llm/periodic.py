"""Periodic runs: stretches of a text's words that repeat with some period, found by a suffix automaton.

An automaton's state stands for the strings that end at the same positions of
the text. States are taken from the longest to the shortest, and the position
sets of those that hang on one are merged into the largest of them. Two
positions that become neighbours in a state of length m, at a distance d of at
most m, show a square of period d: the m words up to the one are those up to
the other. m is exactly what the two have in common to the left, so the run
starts there; where the words after the two positions agree, the same square
is met again one word further, and so a square counts where it can't be
extended.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_right, insort
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import append_columns, strings, table

#: A run has at least so many words, and twice its period.
LEAST = 12

#: Positions in one chunk of a position set.
CHUNK = 1024

RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


class _Automaton:
    """States of a suffix automaton: length, suffix link, and the position a state was made for (-1: a clone).

    Most states have one way on; it is kept in two arrays, and further ones in
    a dictionary of those states alone.
    """

    def __init__(self, words: Sequence[int]):
        self.length, self.link, self.at = array("q", [0]), array("q", [-1]), array("q", [-1])
        self.word, self.to, self.more = array("q", [-1]), array("q", [-1]), {}
        last = 0
        for k, w in enumerate(words):
            last = self._extend(last, k, w)

    def _state(self, length: int, at: int, word: int = -1, to: int = -1) -> int:
        self.length.append(length)
        self.link.append(0)
        self.at.append(at)
        self.word.append(word)
        self.to.append(to)
        return len(self.length) - 1

    def _next(self, state: int, w: int) -> int:
        if self.word[state] == w:
            return self.to[state]
        return self.more[state].get(w, -1) if state in self.more else -1

    def _set(self, state: int, w: int, to: int) -> None:
        if self.word[state] in (-1, w):
            self.word[state], self.to[state] = w, to
        else:
            self.more.setdefault(state, {})[w] = to

    def _extend(self, last: int, k: int, w: int) -> int:
        made = self._state(self.length[last] + 1, k)
        p = last
        while p >= 0 and (q := self._next(p, w)) < 0:
            self._set(p, w, made)
            p = self.link[p]
        if p < 0:
            return made
        if self.length[q] == self.length[p] + 1:
            self.link[made] = q
            return made
        clone = self._state(self.length[p] + 1, -1, self.word[q], self.to[q])
        if q in self.more:
            self.more[clone] = dict(self.more[q])
        self.link[clone] = self.link[q]
        while p >= 0 and self._next(p, w) == q:
            self._set(p, w, clone)
            p = self.link[p]
        self.link[q] = self.link[made] = clone
        return made


class _Ends:
    """An ordered set of positions in chunks, so that adding one to a large set moves few."""

    __slots__ = ("chunks", "firsts", "size")

    def __init__(self, position: int):
        self.chunks, self.firsts, self.size = [[position]], [position], 1

    def _chunk(self, position: int) -> int:
        return max(0, bisect_right(self.firsts, position) - 1) if len(self.firsts) > 1 else 0

    def add(self, position: int) -> None:
        k = self._chunk(position)
        chunk = self.chunks[k]
        insort(chunk, position)
        self.firsts[k] = chunk[0]
        self.size += 1
        if len(chunk) > 2 * CHUNK:
            self.chunks[k : k + 1] = [chunk[:CHUNK], chunk[CHUNK:]]
            self.firsts[k : k + 1] = [chunk[0], chunk[CHUNK]]

    def around(self, position: int) -> tuple[int, int]:
        """The members before and after a member; -1 where there is none."""
        k = self._chunk(position)
        chunk = self.chunks[k]
        i = bisect_right(chunk, position) - 1
        before = chunk[i - 1] if i else self.chunks[k - 1][-1] if k else -1
        after = chunk[i + 1] if i + 1 < len(chunk) else self.chunks[k + 1][0] if k + 1 < len(self.chunks) else -1
        return before, after


def runs_of(words: Sequence[int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a sequence of word numbers (0 and up), by start, then period."""
    n, found = len(words), []
    automaton = _Automaton(words)
    length, link, at = automaton.length, automaton.link, automaton.at
    below: dict[int, list[_Ends]] = {}
    shortest = (least + 1) // 2  # a square's length is at most twice its state's
    states = np.argsort(np.frombuffer(length, np.int64), kind="stable")[::-1]
    for state in states.tolist():
        m = length[state]
        if m < shortest:
            break
        parts = below.pop(state, [])
        if at[state] >= 0:
            parts.append(_Ends(at[state]))
        parts.sort(key=lambda s: s.size)
        ends, owner = parts.pop(), {}
        for k, part in enumerate(parts):
            for chunk in part.chunks:
                for x in chunk:
                    owner[x] = k
                    ends.add(x)
        if link[state] > 0:
            below.setdefault(link[state], []).append(ends)
        for y in owner:
            before, after = ends.around(y)
            for a, b in ((before, y), (y, after)):
                d = b - a
                # a pair of added positions is met from both sides, and taken from the left one
                if a < 0 or b < 0 or d > m or m + d < least or owner[y] == owner.get(a if b == y else b, -1) or (b == y and a in owner):
                    continue
                if b + 1 == n or words[a + 1] != words[b + 1]:
                    found.append((a - m + 1, m + d, d))
    return sorted(found, key=lambda r: (r[0], r[2]))


def repeating(ids: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Stretches (from, to) outside which no run lies.

    A run of at least 2 * width words lies within words covered by strings of
    ``width`` words that occur again, at least once in the same stretch.
    """
    n = len(ids) - width + 1
    if n < 2:
        return []
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h = h * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n].astype(np.uint64) + np.uint64(1)
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return []
    first, second = order[:-1][same], order[1:][same]
    edge = np.zeros(len(ids) + 1, np.int64)
    starts = np.union1d(first, second)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    inside = np.r_[0, (np.cumsum(edge)[:-1] > 0).view(np.int8), 0]
    begins, stops = np.flatnonzero(np.diff(inside) > 0), np.flatnonzero(np.diff(inside) < 0)
    home = np.searchsorted(begins, first, side="right")
    live = np.unique(home[home == np.searchsorted(begins, second, side="right")]) - 1
    return [(int(begins[k]), int(stops[k])) for k in live]


def text_runs(words: list[bytes], least: int = LEAST) -> list[tuple[int, int, int]]:
    """runs_of the words of a text; the automaton is built only for stretches in which words repeat."""
    if len(words) < least:
        return []
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    if len(known) == len(words):
        return []
    return [(a + start, size, period) for a, b in repeating(ids, (least + 1) // 2) for start, size, period in runs_of(ids[a:b].tolist(), least)]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that lie in no run behind its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, size, period in runs:
        edge[start + period] += 1
        edge[start + size] -= 1
    return [w for w, k in zip(words, np.cumsum(edge).tolist(), strict=False) if not k]


def text_words(text: bytes) -> list[bytes]:
    """Maximal runs of anything but ASCII white space."""
    return text.split()


def periodic_runs(docs: DataFrame, *, read: tuple[str, ...] = ("text",), words: Callable[..., list[bytes]] = text_words, least: int = LEAST) -> DataFrame:
    """docs with n_words, runs (start, length, period; by start, then period) and collapsed_text.

    A run is a stretch of words with smallest period q, of at least ``least``
    words and twice q, that no neighbouring word extends. collapsed_text has
    the words that aren't in a run behind its first q words, joined by one
    space. ``words`` makes a document's words of the values in the columns
    ``read``, the last of which is its text, as UTF-8 bytes.

    A null, blank or short text has no runs, and its words stay. Rows are taken
    one by one, whatever their number: repeated rows are judged alike, an empty
    table gives an empty one, and columns of docs with the three names are
    replaced. A text of n words takes O(n log n) steps and O(n) memory.
    """

    def per_batch(*columns: pa.Array) -> list[pa.Array]:
        sizes, runs, left = [], [], []
        for *keys, text in zip(*[c.to_pylist() for c in columns[:-1]], strings(columns[-1]), strict=True):
            own = words(*keys, text)
            found = text_runs(own, least)
            sizes.append(len(own))
            runs.append([{"start": a, "length": b, "period": c} for a, b, c in found])
            left.append(b" ".join(collapsed(own, found)))
        kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
        return [pa.array(sizes, pa.int64()), pa.array(runs, kind), pa.array(left, pa.binary()).cast(pa.string())]

    return append_columns(docs, list(read), f"n_words bigint, runs {RUNS}, collapsed_text string", per_batch)


def altered(doc_id: int | None, text: bytes) -> list[bytes]:
    """The words of a text, which a tenth of the ids (by crc32) turn into a repetition from some word on; a null id changes nothing."""
    own = text.split()
    h, n = zlib.crc32(str(doc_id).encode()), len(own)
    if doc_id is None or h % 10 or not n:
        return own
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return own[:a] + [own[a + k % p] for k in range(n - a)]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every whole document; a tenth of the documents are altered, so that they have long ones."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = periodic_runs(docs, read=("doc_id", "text"), words=altered)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("short"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    best = found.withColumn("_best", longest)
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("_best.back")).alias("start"),
        F.col("_best.length").alias("length"),
        (-F.col("_best.short")).alias("period"),
        F.expr("_best.length * 1000 div -_best.short").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed_text", 256).alias("collapsed_sha256"),
    )
