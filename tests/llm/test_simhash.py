import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tidewell.llm import graph, simhash


def plain_fingerprint(text, width=3):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    shingles = [" ".join(w[k : k + width]) for k in range(len(w) - width + 1)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(n, linked):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(k) for k in range(n)]


def test_fingerprint_is_the_plain_one(corpus):
    for _, text, *_ in corpus:
        assert simhash.fingerprint((text or "").encode()) == plain_fingerprint(text)


def test_near_duplicates_match_brute_force(docs, corpus):
    prints = [plain_fingerprint(t) for _, t, *_ in corpus]
    root = groups(len(corpus), lambda i, j: bin(prints[i] ^ prints[j]).count("1") <= 2)
    low = {}
    for r, (k, *_) in zip(root, corpus, strict=True):
        if k is not None:
            low[r] = min(low.get(r, k), k)
    want = sorted((str(k), p, str(low.get(r))) for (k, *_), p, r in zip(corpus, prints, root, strict=True))
    found = simhash.near_duplicates(docs).collect()
    assert sorted((str(r["doc_id"]), r["simhash"] % (1 << 64), str(r["component_id"])) for r in found) == want


def test_links_find_every_planted_distance(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(200)]
    prints = set(base)
    for x in base[:60]:
        for _ in range(3):
            y = x
            for b in rng.sample(range(64), rng.randint(1, 2)):
                y ^= 1 << b
            prints.add(y)
    crowd = base[0]
    prints |= {crowd ^ 1 << a ^ 1 << b for a in range(40, 64) for b in range(40, a)}  # one key with hundreds
    prints = sorted(prints)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "simhash long")
    root = groups(len(prints), lambda i, j: bin(prints[i] ^ prints[j]).count("1") <= 2)
    for limit in (simhash.IN_TASK, 50):  # 50: the crowded keys are compared by Spark
        before, simhash.IN_TASK = simhash.IN_TASK, limit
        try:
            found = {r["node"]: r["component"] for r in graph.components(simhash.links(df)).collect()}
        finally:
            simhash.IN_TASK = before
        got = [found.get(x, x) for x in signed]
        assert len({(a, b) for a, b in zip(root, got, strict=True)}) == len(set(root)) == len(set(got))


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7)]
    found = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[k] == 0 for k in range(41)) and all(found[100 + k] == 100 for k in range(30))


def test_similar_documents_join_near_copies_only(docs, corpus):
    found = {}
    for r in simhash.similar_documents(docs).collect():
        found.setdefault(r["doc_id"], r["component_id"])
    for k in range(60, 66):
        assert found[k] == k - 60
    for k in range(66, 72):
        assert found[k] == k - 60 or len(corpus[k][1].split()) < 60
    assert len({found[k] for k in range(60)}) == 60
    assert found[78] == found[79] == found[80] == 78  # null and blank texts are one group


def test_large_keys_are_compared_in_blocks(docs):
    want = sorted(map(str, simhash.similar_documents(docs).collect()))
    before, simhash.IN_TASK = simhash.IN_TASK, 4
    try:
        assert sorted(map(str, simhash.similar_documents(docs).collect())) == want
    finally:
        simhash.IN_TASK = before


def test_one_of_each_group_stays(docs):
    kept = simhash.without_similar(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert ids.count(1) == 1 and 0 in ids and 60 not in ids and ids.count(None) == 2 and set(range(60)) <= set(ids)


def test_repeated_rows_with_a_map_column(docs):
    rows = docs.select("*", F.create_map(F.lit("k"), F.col("n_chars")).alias("m"))
    kept = simhash.without_similar(rows)
    assert kept.columns == rows.columns and kept.where("doc_id = 1").count() == 1


def test_empty_and_clashing(none, docs):
    assert simhash.near_duplicates(none).count() == 0 and simhash.without_similar(none).count() == 0
    clash = docs.select("doc_id", "text", F.lit(1).alias("simhash"), F.lit(2).alias("component_id"), F.lit(3).alias("key"), F.lit(4).alias("a"), F.lit(5).alias("node"))
    assert simhash.near_duplicates(clash).count() == docs.count()
    assert simhash.without_similar(clash).columns == clash.columns


def test_similar_documents_are_those_of_brute_force_jaccard(spark):
    rng = random.Random(11)

    def shingles(text):
        w = text.split()
        return {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    def jaccard(x, y):
        return len(x & y) / len(x | y)

    def fresh(n):
        return ["".join(rng.choices("abcdefghij", k=7)) for _ in range(n)]

    texts = ["", "one", "one two", "one two three four five", "one two three four five six"]
    for size, pairs in ((8, 10), (12, 15), (20, 20), (31, 20), (36, 20), (44, 20), (60, 30), (150, 60), (300, 60)):
        for k in range(pairs):
            # a tail of other words: (n - cut) shared of n + cut
            similarity = (0.78, 0.79, 0.80, 0.81, 0.82)[k % 5]
            w = fresh(size + 4)
            cut = max(1, int(size * (1 - similarity) / (1 + similarity)))
            texts += [" ".join(w), " ".join(w[:-cut] + fresh(cut))]
            if k % 4 == 0:
                texts.append(" ".join(w[: -max(1, size // 5)]))  # a subset of 0.8 or so
    sets = [shingles(t) for t in texts]
    near = {(i, j) for i in range(len(sets)) for j in range(max(0, i - 3), i) if sets[i] and sets[j] and jaccard(sets[i], sets[j]) >= 0.8}
    near |= {(i, j) for i in range(5) for j in range(i) if sets[i] == sets[j]}
    assert any(jaccard(sets[i], sets[j]) == 0.8 for i, j in near)
    assert sum(0.78 <= jaccard(sets[i], sets[i - 1]) < 0.8 for i in range(6, len(sets))) > 40
    root = groups(len(sets), lambda i, j: (i, j) in near)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(docs).collect()}
    got = [found[k] for k in range(len(texts))]
    wrong = [k for k in range(len(texts)) if root[k] != got[k]]
    assert not [k for k in wrong if root[got[k]] != root[k]]  # none that isn't similar is joined
    assert not [k for k in wrong if len(sets[k]) <= 32]  # short texts lose none
    assert len(wrong) <= 0.01 * len(texts)


def test_one_stays_of_texts_linked_by_fingerprint_or_by_set(spark, corpus):
    rng = random.Random(5)

    def fresh(n):
        return ["".join(rng.choices("abcdefghij", k=7)) for _ in range(n)]

    texts = [t for _, t, *_ in corpus]
    for k in range(8):
        body, tail = fresh(31), fresh(12)
        repeated = [w for _ in range(7) for w in body]
        texts.append(" ".join(repeated + fresh(12)))
        texts.append(" ".join(repeated + tail))  # near in the fingerprint, which counts repeats, but not as a set
        texts.append(" ".join(body + body + tail))  # the same set as the one before, another fingerprint
        texts.append(" ".join(body))
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    prints = [plain_fingerprint(t) for t in texts]
    by_print = lambda i, j: bin(prints[i] ^ prints[j]).count("1") <= 2
    by_set = lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    planted = range(len(corpus), len(texts), 4)
    assert sum(by_print(k, k + 1) and prints[k] != prints[k + 1] and not by_set(k, k + 1) for k in planted) >= 4
    assert all(by_set(k + 1, k + 2) and not by_set(k, k + 2) for k in planted) and not all(by_print(k, k + 2) for k in planted)
    root = groups(len(texts), lambda i, j: by_print(i, j) or by_set(i, j))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert sorted(r["doc_id"] for r in simhash.without_similar(df).collect()) == sorted(set(root))
