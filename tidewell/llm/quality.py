"""Quality rules as weak supervision.

Each rule looks at one statistic of a text and votes good, bad or abstains.
Expectation-maximisation over the counts of vote patterns estimates how
reliable each rule is, and a text is kept if the posterior probability that it
is good is at least a half.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import SPACE, materialise, table
from tidewell.llm.weak import NO, YES, Rates, VoteModel, fit_votes

WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """Votes good where ``good`` holds, else bad where ``bad`` holds; SQL over the statistics. A null abstains."""

    name: str
    good: str
    bad: str


RULES = (
    Rule("symbols", "n_symbols <= 0.02 * n_words", "n_symbols > 0.1 * n_words"),
    Rule("letters", "n_letters >= 0.9 * word_chars", "n_letters < 0.88 * word_chars"),
    Rule("word_length", "word_chars between 3.5 * n_words and 8 * n_words", "word_chars not between 3 * n_words and 10 * n_words"),
    Rule("duplicate_lines", "n_dup_lines <= 0.05 * n_lines", "n_dup_lines > 0.5 * n_lines"),
    Rule("repetition", "n_repeat_words <= 0.05 * n_words", "n_repeat_words > 0.3 * n_words"),
    Rule("vocabulary", "n_distinct * sqrt(n_words) >= 5 * n_words", "n_distinct * sqrt(n_words) < 3 * n_words"),
    Rule("capitals", "n_upper <= 0.1 * n_letters", "n_upper > 0.4 * n_letters"),
    Rule("length", "n_words >= 50", "n_words < 20"),
    Rule("sentence_ends", "n_closed >= 0.6 * n_lines", "n_closed < 0.1 * n_lines"),
)
#: First guesses, one for each rule: all seldom call a good text bad, and each sees some kinds of bad text only.
START = (
    Rates(yes_if_yes=0.97, yes_if_no=0.6, no_if_yes=0.005, no_if_no=0.4),
    Rates(yes_if_yes=0.95, yes_if_no=0.5, no_if_yes=0.01, no_if_no=0.5),
    Rates(yes_if_yes=0.95, yes_if_no=0.8, no_if_yes=0.01, no_if_no=0.2),
    Rates(yes_if_yes=0.9, yes_if_no=0.7, no_if_yes=0.01, no_if_no=0.3),
    Rates(yes_if_yes=0.9, yes_if_no=0.6, no_if_yes=0.01, no_if_no=0.4),
    Rates(yes_if_yes=0.9, yes_if_no=0.6, no_if_yes=0.02, no_if_no=0.4),
    Rates(yes_if_yes=0.97, yes_if_no=0.7, no_if_yes=0.005, no_if_no=0.3),
    Rates(yes_if_yes=0.9, yes_if_no=0.7, no_if_yes=0.03, no_if_no=0.3),
    Rates(yes_if_yes=0.9, yes_if_no=0.6, no_if_yes=0.02, no_if_no=0.4),
)


def _let(value: Column, then) -> Column:
    """then(value), with value evaluated once a row."""
    return F.transform(F.array(value), then)[0]


def _covered(hits: Column) -> Column:
    """Number of words in the windows at the ascending positions ``hits``."""
    return _let(hits, lambda at: F.aggregate(F.transform(at, lambda p, k: F.when(k == 0, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), p - F.get(at, k - 1)))), F.lit(0), lambda a, x: a + x))


def _repeated(windows: Column) -> Column:
    """Ascending positions of the window hashes that occur more than once."""
    ranked = F.array_sort(F.transform(windows, lambda h, k: F.struct(h.alias("h"), k.alias("k"))))
    return _let(
        ranked,
        lambda s: F.array_sort(F.transform(F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))), lambda x: x["k"])),
    )


def statistics(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and the statistics of each text, as longs; a null text has no words and no lines.

    Words, word windows and lines of one text stay in its row; windows are
    compared by 64-bit hash. Nothing is shuffled.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = rows.withColumn("w", F.filter(F.split("t", SPACE, -1), lambda w: w != ""))
    rows = rows.withColumn("lines", F.filter(F.split("t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    rows = rows.withColumns({"n": F.size("w"), "h": F.transform("w", lambda w: F.xxhash64(w)), "chars": F.length(F.array_join("w", ""))})
    at = lambda k: F.get(F.col("h"), k)
    windows = F.transform(F.sequence(F.lit(0), F.col("n") - WINDOW), lambda k: F.xxhash64(*[at(k + j) for j in range(WINDOW)]))
    rows = rows.withColumn("windows", F.when(F.col("n") >= WINDOW, windows).otherwise(F.array().cast("array<bigint>")))
    count = lambda keep: F.length(F.regexp_replace("t", f"[^{keep}]+", ""))
    made = {
        "n_words": F.col("n"),
        "word_chars": F.col("chars"),
        "n_symbols": count(r"#*$%&|<>"),
        "n_lines": F.size("lines"),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": F.when(F.size(F.array_distinct("windows")) == F.size("windows"), F.lit(0)).otherwise(_covered(_repeated(F.col("windows")))),
        "n_distinct": F.size(F.array_distinct("h")),
        "n_letters": count(r"\p{L}"),
        "n_upper": count(r"\p{Lu}"),
        "n_closed": F.size(F.filter("lines", lambda x: x.rlike(r'[.!?"»”)]\s*$'))),
    }
    return rows.select("doc_id", *[c.cast("long").alias(name) for name, c in made.items()])


def votes(rules=RULES) -> list[Column]:
    """Each rule's vote as an integer column: 1 good, -1 bad, 0 abstains; also without a word."""
    return [F.when(F.col("n_words") == 0, F.lit(0)).when(F.expr(r.good), F.lit(1)).when(F.expr(r.bad), F.lit(-1)).otherwise(F.lit(0)) for r in rules]


def fit(stats: DataFrame, rules=RULES, start=START) -> VoteModel:
    """The rules' reliabilities, from the counts of vote patterns (at most 3^rules rows come to the driver)."""
    names = [r.name for r in rules]
    counted = stats.select(*[v.alias(n) for v, n in zip(votes(rules), names, strict=True)]).groupBy(*names).count().collect()
    return fit_votes({tuple(r[n] for n in names): r["count"] for r in counted}, start, prior=0.9)


def quality(model: VoteModel, rules=RULES) -> Column:
    """Posterior probability that a text is good, over its statistics."""
    total = F.lit(log(model.prior / (1 - model.prior)))
    for vote, rates in zip(votes(rules), model.rates, strict=True):
        total = total + F.when(vote == YES, F.lit(rates.weight(YES))).when(vote == NO, F.lit(rates.weight(NO))).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-total))


def quality_filter(docs: DataFrame, *, key: str = "doc_id", text: str = "text", rules=RULES, threshold: float = 0.5) -> DataFrame:
    """key, statistics, base_failed, quality and kept for each row of docs; other columns aren't read.

    Texts of fewer than 20 words, or with more than 30 % of their words in
    repeated windows, fail outright; null and empty ones are among them. On an
    empty table the result is empty.
    """
    stats = materialise(statistics(docs, key=key, text=text))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    scored = stats.withColumns({"base_failed": failed, "quality": quality(fit(stats, rules), rules)})
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's statistics and verdict."""
    found = quality_filter(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")
