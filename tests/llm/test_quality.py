import collections
import re

import pytest
from pyspark.sql import functions as F

from tidewell.llm import quality
from tidewell.llm.weak import NO, YES, Rates, fit_logistic, fit_votes, logistic


def plain(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for x in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    n, windows, covered = len(w), collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7)), set()
    for k in range(n - 7):
        if windows[tuple(w[k : k + 8])] > 1:
            covered.update(range(k, k + 8))
    return (n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered))


def test_statistics_match_brute_force(docs, corpus):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    found = sorted((str(r["doc_id"]), *[r[n] for n in names]) for r in quality.statistics(docs).collect())
    assert found == sorted((str(k), *plain(t)) for k, t, *_ in corpus)


def test_windows_that_overlap_themselves(spark):
    texts = ["a b c d e f g h " * 2, "a " * 9, "x a b c d e f g h y a b c d e f g h z", "a b c d e f g h", "q " * 20 + "r " * 20]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["n_repeat_words"] for r in quality.statistics(df).collect()} == {k: plain(t)[4] for k, t in enumerate(texts)}


def test_bad_kinds_are_told_from_good(spark, corpus):
    good = [(k, t) for k, t, *_ in corpus[:60]] * 4
    bad = [(1000 + k, " ".join(f"w{k}x{j}###" for j in range(60))) for k in range(12)] + [(2000 + k, " | ".join(f"abc{k}{j}" for j in range(60))) for k in range(12)]
    df = spark.createDataFrame(good + bad, "doc_id long, text string")
    kept = {r["doc_id"]: r["kept"] for r in quality.quality_filter(df).collect()}
    assert all(kept[k] for k in range(60) if plain(dict(good)[k])[0] >= 50) and not any(v for k, v in kept.items() if k >= 1000)


def test_short_and_repetitive_fail(spark):
    df = spark.createDataFrame([(1, "too short"), (2, "one two three four five six seven eight " * 10), (3, None), (4, "")], "doc_id long, text string")
    assert all(r["base_failed"] and not r["kept"] for r in quality.quality_filter(df).collect())


def test_empty_and_clashing(none, docs):
    assert quality.quality_filter(none).count() == 0
    clash = docs.select("doc_id", "text", F.lit(1).alias("w"), F.lit(2).alias("kept"), F.lit(3).alias("t"))
    assert quality.quality_filter(clash).count() == docs.count()


def test_expectation_maximisation_finds_planted_rates():
    import random

    rng = random.Random(5)
    truth = [(0.9, 0.2), (0.8, 0.1), (0.7, 0.3), (0.95, 0.4)]
    counts = collections.Counter()
    for _ in range(20000):
        yes = rng.random() < 0.7
        counts[tuple(0 if rng.random() < 0.2 else YES if rng.random() < (a if yes else b) else NO for a, b in truth)] += 1
    model = fit_votes(dict(counts), (Rates(0.6, 0.3, 0.2, 0.5),) * 4)
    assert abs(model.prior - 0.7) < 0.05
    for r, (a, b) in zip(model.rates, truth, strict=True):
        assert abs(r.yes_if_yes - 0.8 * a) < 0.05 and abs(r.yes_if_no - 0.8 * b) < 0.08
    assert fit_votes({}, (Rates(0.6, 0.3, 0.2, 0.5),)).prior == 0.5


def test_verdict_is_that_of_plain_expectation_maximisation(docs, corpus):
    """The same model, fitted here row by row with plain probabilities."""
    rows = quality.statistics(docs).select("doc_id", *[v.alias(r.name) for v, r in zip(quality.votes(), quality.RULES, strict=True)]).collect()
    votes = [tuple(r)[1:] for r in rows]
    guess = [(s.yes_if_yes, s.yes_if_no, s.no_if_yes, s.no_if_no) for s in quality.START]
    prior, rates = 0.9, guess
    for _ in range(1500):
        good = []
        for v in votes:
            a, b = prior, 1 - prior
            for x, (yy, yn, ny, nn) in zip(v, rates, strict=True):
                a, b = (a * yy, b * yn) if x == 1 else (a * ny, b * nn) if x == -1 else (a, b)
            good.append(a / (a + b))
        n, yes = len(votes), sum(good)
        prior = (yes + 20 * 0.9) / (n + 20)
        rates = []
        for k, g in enumerate(guess):
            count = lambda vote, of, k=k: sum(w for w, v in zip(of, votes, strict=True) if v[k] == vote)
            bad = [1 - w for w in good]
            rates.append(tuple((c + 20 * s) / (t + 20) for c, s, t in ((count(1, good), g[0], yes), (count(1, bad), g[1], n - yes), (count(-1, good), g[2], yes), (count(-1, bad), g[3], n - yes))))
    found = {}
    for r in quality.quality_filter(docs).collect():
        found.setdefault(str(r["doc_id"]), []).append((round(r["quality"], 4), r["kept"] or r["base_failed"]))
    want = {}
    for r, g in zip(rows, good, strict=True):
        want.setdefault(str(r["doc_id"]), []).append(g)
    for key, values in want.items():
        assert sorted(q for q, _ in found[key]) == pytest.approx(sorted(values), abs=2e-3)
    assert all(kept == (q >= 0.5) for of in found.values() for q, kept in of if not kept)


def test_logistic_learns_a_rule():
    rows = [((float(a), float(b)), 1.0 if a else 0.0, 100.0) for a in (0, 1) for b in (0, 1)]
    w = fit_logistic(rows, rounds=300)
    assert logistic(w, (1.0, 0.0)) > 0.9 > 0.1 > logistic(w, (0.0, 1.0))
