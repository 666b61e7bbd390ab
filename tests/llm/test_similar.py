"""The pipeline's near copies against brute force."""

import random

import corpus_pipeline
import numpy as np
import pytest
from millrace.llm import similar

DOC = "doc_id long, text string"


def jaccard(a, b):
    x, y = (set(similar.shingles(t).tolist()) for t in (a, b))
    return len(x & y) / len(x | y) if x | y else 1.0


def texts(seed):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(500)]
    out = [None, "", "one two", "ONE  two", "one three"]
    for _ in range(25):
        base = [rnd.choice(words) for _ in range(rnd.choice([5, 9, 30, 60, 200, 700]))]
        for _ in range(rnd.randint(1, 6)):
            copy = list(base)
            for _ in range(rnd.randint(0, max(1, len(base) // 40))):
                at = rnd.randrange(len(copy))
                copy[at : at + rnd.randint(0, 1)] = [rnd.choice(words)]
            out.append(" ".join(copy[: rnd.choice([None, None, -(len(copy) // 10) or None])]))
    base = [rnd.choice(words) for _ in range(80)]  # a large group of copies that are not all alike
    for _ in range(60):
        copy = list(base)
        copy[rnd.randrange(80)] = rnd.choice(words)
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_near_copies_are_those_of_all_pairs(spark, seed):
    rows = list(enumerate(texts(seed)))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in rows:
        for j, b in rows[:i]:
            if jaccard(a, b) >= 0.8:
                lo, hi = sorted((find(i), find(j)))
                root[hi] = lo
    kept = similar.drop_similar(spark.createDataFrame(rows, DOC))
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _ in rows if find(i) == i}


def test_any_similar_sets_meet():
    rnd = np.random.default_rng(3)
    for n in [*range(1, 60), 100, 301, 1000]:
        a = np.unique(rnd.integers(0, 1 << 63, n, np.uint64))
        for swap in (n // 9, 0):
            b = np.unique(np.concatenate([a[swap:], rnd.integers(0, 1 << 63, swap if n % 2 else 0, np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 9 * both >= 4 * (len(a) + len(b)):
                assert len(np.intersect1d(similar.part_keys(a), similar.part_keys(b)))


def test_stage_drops_a_copy_with_changed_words(spark, sf_dir):
    rnd = random.Random(5)
    words = [f"w{rnd.randrange(10**6)}" for _ in range(200)]
    copies = [list(words) for _ in range(4)]
    for at, copy in enumerate(copies[1:], 1):
        copy[30 * at], copy[30 * at + 7] = "changed", "again"
    docs = spark.createDataFrame([(9, " ".join(copies[0]), "a"), (4, " ".join(copies[1]), "b"), (7, " ".join(copies[2]), "c"), (None, " ".join(copies[3]), "d"), (8, " ".join(words[::-1]), "e")], DOC + ", node string")
    kept = dict(corpus_pipeline.STAGES)["simhash"](spark, docs, sf_dir)
    assert kept.columns == docs.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 4, 8]
