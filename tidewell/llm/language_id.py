"""Language ID by compression: the language whose dictionary compresses a text best.

Each language has a raw-content zstandard dictionary cut from a bounded sample
of labelled training text. A text is split into short blocks, so that its own
history doesn't drown the dictionary, and each block is compressed with every
dictionary; the smallest total wins. Where the runner-up is within
``min_margin`` of the winner, the prediction is marked as rejected.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import append_columns, table

_NOT_LETTERS = re.compile(r"[\W\d_]+")


@dataclass(frozen=True)
class CompressionModel:
    """Dictionaries by language, most frequent language first (it wins ties)."""

    dictionaries: tuple[tuple[str, bytes], ...]
    level: int = 9
    block_bytes: int = 1024
    min_margin: float = 0.005


def letters_only(text: str) -> str:
    """Lower-cased runs of letters, joined by single spaces."""
    return _NOT_LETTERS.sub(" ", text).strip().lower()


def fit(docs: DataFrame, *, text: str = "text", lang: str = "lang", sample_docs: int = 40, sample_bytes: int = 200_000, max_languages: int = 1000, **settings) -> CompressionModel:
    """Dictionaries from about ``sample_docs`` distinct labelled texts of each language, whole ones of at most ``sample_bytes``.

    What is learned from, and comes to the driver, is so bounded by about
    sample_docs * sample_bytes for a language, however long texts get.
    Texts are picked by their hash against thresholds from the (approximate)
    number of a language's distinct texts, so the sample is spread over the
    table, its number of texts doesn't grow with it, and a text that fills a
    third of the rows counts once. Rows with a null text or label are no
    training rows; without any, the model knows no language and rejects every
    text as ``und``. More than ``max_languages`` labels are an error.
    """
    labelled = docs.select(F.col(lang).alias("l"), F.col(text).alias("t"), F.xxhash64(F.col(text), F.lit("sample")).alias("h")).where("l is not null and t is not null").where(F.octet_length("t") <= sample_bytes)
    counts = {r["l"]: r for r in labelled.groupBy("l").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("h").alias("texts")).limit(max_languages + 1).collect()}
    if not counts:
        return CompressionModel((), **settings)
    if len(counts) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    ranks = F.pmod("h", F.lit(1 << 30))
    share = F.create_map(*[F.lit(x) for name, r in counts.items() for x in (name, int(min(1.0, sample_docs / max(1, r["texts"])) * (1 << 30)))])
    picked = labelled.where(ranks < share[F.col("l")]).distinct().collect()
    by: dict[str, list] = {}
    for row in sorted(picked, key=lambda r: (r["h"], r["t"])):
        by.setdefault(row["l"], []).append(letters_only(row["t"]))
    order = sorted(by, key=lambda name: (-counts[name]["n"], name))
    return CompressionModel(tuple((name, " ".join(by[name]).encode()) for name in order), **settings)


class _Classifier:
    """Compressors of one Python worker, built at its first batch."""

    def __init__(self, model: CompressionModel):
        self.model, self.compressors = model, []
        for name, data in model.dictionaries:
            dictionary = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(data) >= 8 else None
            if dictionary:
                dictionary.precompute_compress(level=model.level)
            self.compressors.append((name, zstandard.ZstdCompressor(level=model.level, dict_data=dictionary, write_content_size=False, write_checksum=False)))

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, margin); und, 0, 0 if there is no letter."""
        plain = letters_only(text or "")
        if not self.compressors or not any(map(str.isalpha, plain)):
            return "und", 0.0, 0.0
        data, step = plain.encode(), self.model.block_bytes
        blocks = [data[k : k + step] for k in range(0, len(data), step)]
        sizes = [sum(len(c.compress(b)) for b in blocks) for _, c in self.compressors]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        rest = [s for k, s in enumerate(sizes) if k != best]
        margin = (min(rest) - sizes[best]) / min(rest) if rest else 1.0
        score = 1 / (1 + sum(2.0 ** (-min(1000, 8 * (s - sizes[best]))) for s in rest))
        return self.compressors[best][0], score, margin


def _predictions(model: CompressionModel):
    state: list[_Classifier] = []

    def per_batch(column: pa.Array) -> list[pa.Array]:
        if not state:
            state.append(_Classifier(model))
        found = [state[0].predict(t.as_py()) for t in column]
        rejected = [x[0] == "und" or x[2] < model.min_margin for x in found]
        return [pa.array(x, kind) for x, kind in zip([*zip(*found, strict=True), rejected] if found else [[]] * 4, (pa.string(), pa.float64(), pa.float64(), pa.bool_()), strict=True)]

    return per_batch


def language_id(docs: DataFrame, model: CompressionModel, *, text: str = "text") -> DataFrame:
    """docs with lang_pred, score (0 to 1), margin and rejected; rows are classified one by one.

    A null text, or one without letters, is ``und`` with score 0 and rejected.
    Of languages that do equally well the more frequent one is taken, and the
    text is rejected. Columns of docs with those four names are replaced.
    """
    return append_columns(docs, [text], "lang_pred string, score double, margin double, rejected boolean", _predictions(model))


def of_known_language(docs: DataFrame, model: CompressionModel, *, text: str = "text") -> DataFrame:
    """The rows of docs that language_id doesn't reject, with docs' own columns as they are."""
    predict = _predictions(model)
    return append_columns(docs, [text], "_tw_rejected boolean", lambda column: predict(column)[3:]).where("not _tw_rejected").select(docs.columns)


def held_out(key: str, modulus: int):
    """True where crc32 of the key as text is divisible by modulus; false for a null key."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % modulus == 0, F.lit(False))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions for every document, learned from those whose crc32 isn't divisible by 5."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out("doc_id", 5)))
    return language_id(docs.select("doc_id", "text"), model).select("doc_id", held_out("doc_id", 5).alias("held_out"), "lang_pred", "score", "margin", "rejected")
