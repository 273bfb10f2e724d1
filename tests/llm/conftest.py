import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = {
    "en": "the and ing er on ti ou sh bl ha re st ed ly wh",
    "de": "der die und sch ein ung ver keit pf tz ge be ich lich über",
    "fr": "le la que ou eau tion ment en oi eux ai é è ère aux",
}


def words(rng, lang, n):
    parts = SYLLABLES[lang].split()
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def prose(rng, lang, n):
    w = words(rng, lang, n)
    return "\n".join(" ".join(w[k : k + 12]).capitalize() + "." for k in range(0, n, 12))


@pytest.fixture(scope="session")
def corpus():
    """Rows (doc_id, text, lang, source, n_chars): prose, copies, near copies, shared passages, and odd ones."""
    rng = random.Random(7)
    rows, shared = [], prose(rng, "en", 60)
    for k in range(60):
        lang = ("en", "en", "de", "fr")[k % 4]
        rows.append([k, prose(rng, lang, rng.randint(40, 160)), lang, f"s{k % 3}"])
    for k in range(60, 66):
        rows.append([k, rows[k - 60][1], "en", "s0"])  # copies
    for k in range(66, 72):
        near = rows[k - 60][1].split(" ")
        near[len(near) // 2] = "changed"
        rows.append([k, " ".join(near), "en", "s1"])
    for k in range(72, 78):
        rows.append([k, prose(rng, "en", 30) + "\n" + shared + "\n" + prose(rng, "en", 20), "en", "s2"])
    odd = [None, "", " \t\n\x0b ", "x", "One two.", "1.2.3.4", "é", "#" * 300, "word " * 30000, "\n" * 50, "a" * 5000]
    rows += [[78 + k, t, None if k % 2 else "en", None if k % 3 else "s0"] for k, t in enumerate(odd)]
    rows.append([None, rows[0][1], "en", "s0"])
    rows.append([None, None, None, None])
    rows += [list(rows[1]), list(rows[1])]  # repeated rows
    return [(*r, len(r[1]) if r[1] is not None else None) for r in rows]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
