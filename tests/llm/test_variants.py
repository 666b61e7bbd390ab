"""Spelling variants against a comparison of all words, with parts of very few words; odd rows."""

import itertools
import random
import zlib
from collections import Counter

import pytest
from millrace.llm import variants

WORD = "word string, n long"


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts: dict[str, int], ratio: int) -> dict[str, tuple]:
    near = {w: [] for w in counts}
    for a, b in itertools.combinations(counts, 2):
        if one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] is not None else None)
    return out


def found(frame) -> dict[str, tuple]:
    rows = frame.collect()
    assert len({r["word"] for r in rows}) == len(rows)
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}


@pytest.mark.parametrize(("seed", "letters", "sizes", "n", "bucket"), [(1, "ab", range(1, 9), 300, 3), (2, "abcé", range(6, 9), 400, 8), (3, "ab", range(9, 12), 400, 5000), (4, "aß\U0001f600", range(2, 6), 150, 1)])
def test_all_near_words(spark, seed, letters, sizes, n, bucket):
    rnd = random.Random(seed)
    counts = {"".join(rnd.choice(letters) for _ in range(rnd.choice(sizes))): rnd.choice([1, 5, 5, 26, 130, 700]) for _ in range(n)}
    frame = spark.createDataFrame(list(counts.items()), WORD)
    policy = variants.VariantPolicy(bucket_words=bucket, batch_words=40)
    assert found(variants.variant_groups(frame, policy)) == brute(counts, 5)


def test_one_hot_half(spark):
    """A third of the words begins alike, and all end alike."""
    rnd = random.Random(5)
    middles = {"".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(700)}
    counts = {("internation" if i % 3 else "x") + m + "alisations": rnd.choice([5, 25, 125]) for i, m in enumerate(sorted(middles))}
    got = found(variants.variant_groups(spark.createDataFrame(list(counts.items()), WORD), variants.VariantPolicy(bucket_words=20)))
    assert got == brute(counts, 5)


def test_numbers_are_those_of_the_sorted_words():
    words = sorted({"".join(random.Random(i).choices("abc", k=i % 7)) for i in range(300)})
    automaton = variants.Automaton(words)
    assert [automaton.number(w) for w in words] == list(range(len(words))) and automaton.number("abcabcabca") is None
    assert len(automaton.states) < len({w[:i] for w in words for i in range(len(w) + 1)})


def test_words_of_documents(spark):
    texts = {1: "Maßstab maßstab MASSTAB " * 5, 2: None, 3: "", 4: "abcdef-ghijkl " * 400, None: "wordsx " * 7, 5: "Éclair éclairs ÉCLAIRS " * 6}
    docs = spark.createDataFrame([(i, t, "own") for i, t in texts.items()] + [(4, texts[4], "own")], "doc_id long, text string, word string")
    counts: Counter = Counter()
    lower = {c: chr(ord(c) + 32) for c in map(chr, range(65, 91))}
    for i, text in [*texts.items(), (4, texts[4])]:
        for run in "".join(c if c.isascii() and c.isalpha() or "À" <= c <= "ÿ" else " " for c in text or "").split():
            run = "".join(lower.get(c, c) for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    kept = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    assert found(variants.op11_spelling_variants(docs)) == brute(kept, 5) and len(kept) > 3


def test_odd_words(spark):
    long = "ab" * 3000
    rows = [(long, 5), (long + "c", 50), (None, 3), ("", 5), ("a", 30), ("aa", 2), ("aa", 3)]
    got = found(variants.variant_groups(spark.createDataFrame(rows, WORD)))
    assert got == brute({long: 5, long + "c": 50, "": 5, "a": 30, "aa": 5}, 5)
    assert variants.op11_spelling_variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
