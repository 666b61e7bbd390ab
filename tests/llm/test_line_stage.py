"""The pipeline's line dedup: short lines take part, and documents that keep text stay."""

import random

import corpus_pipeline
from millrace.llm import line_dedup

DOC = "doc_id long, text string"


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_short_lines_take_part(spark):
    rnd = random.Random(4)
    letters = "abcdefgh é"
    base = ["All rights reserved.", "}", "ab", *("".join(rnd.choice(letters) for _ in range(n)).strip() for n in (8, 14, 15, 16, 17, 24, 30, 31, 32, 33, 34, 50))]

    def line():
        out = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 3]) if len(out) > 4 else 0):
            at = rnd.randrange(len(out))
            out[at : at + rnd.randint(0, 1)] = rnd.choice(["", *letters])
        return rnd.choice(["", " "]) + "".join(out)

    docs = [(i * 3 % 41, "\n".join(rnd.choice(["", " \t", line(), line()]) for _ in range(rnd.randint(0, 9)))) for i in range(40)]
    seen, gone = [], set()
    for d, text in sorted(docs):
        for at, x in enumerate(text.split("\n")):
            if x := x.strip(line_dedup.BLANKS):
                near = lambda y: edits(x.encode(), y.encode()) <= (2 if (n := min(len(x), len(y))) >= 32 else 1 if n >= 16 else 0)  # noqa: B023, E731
                if any(near(y) for y in seen):
                    gone.add((d, at))
                seen.append(x)
    want = {d: "\n".join(x for at, x in enumerate(t.split("\n")) if (d, at) not in gone) for d, t in docs}
    found = line_dedup.dedup_lines(spark.createDataFrame(docs, DOC), line_dedup.LinePolicy(short_lines=True), drop_emptied=False)
    assert {r["doc_id"]: r["text"] for r in found.collect()} == want


def test_stage_removes_short_repeats(spark, sf_dir):
    rows = [(1, "first text of some length that stays here\nAll rights reserved."), (2, "second one, quite unlike the other in words\nAll rights reserved.")]
    found = dict(corpus_pipeline.STAGES)["line_dedup"](spark, spark.createDataFrame(rows, DOC), sf_dir)
    assert {r["doc_id"]: r["text"] for r in found.collect()} == {1: rows[0][1], 2: rows[1][1].split("\n")[0]}


def test_stage_keeps_documents_of_short_lines(spark, sf_dir):
    footer = "This footer stands on all the pages of its source."
    poems = [(i, "\n".join(f"line {i} {chr(97 + at) * 6}" for at in range(9)) + "\n" + footer) for i in range(3)] + [(3, " \n" + footer + "\n\t")]
    found = dict(corpus_pipeline.STAGES)["line_dedup"](spark, spark.createDataFrame(poems, DOC), sf_dir)
    assert {r["doc_id"]: r["text"] for r in found.collect()} == {i: t if i == 0 else t[: -len(footer) - 1] for i, t in poems[:3]}


def kept_lines(lines, near):
    """Places of the lines that stay: those that no earlier one is near to."""
    return [i for i, x in enumerate(lines) if not any(near(x, y) for y in lines[:i])]


def test_lines_that_share_nearly_all(spark):
    """Logs, numbered lines and periodic ones: every bucket is busy, what is left is dense or sparse."""
    rnd = random.Random(8)
    digits = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    lines = [f"{digits(12)} connection closed by remote host after idle timeout" for _ in range(60)]
    lines += [x[:3] + digits(2) + x[5:] for x in lines[:20]] + [x[:8] + x[9:] for x in lines[20:40]]
    lines += [f"This is page number {i} of the manual of the engine" for i in range(0, 400, 7)]
    lines += ["=" * n for n in range(33, 50)] + [f"a row of {digits(6)} cells" for _ in range(50)] + [f"müßige Zeile {digits(7)} am Ende, größer als" for _ in range(40)]
    rnd.shuffle(lines)
    lines = list(dict.fromkeys(lines))
    near = lambda x, y: edits(x.encode(), y.encode()) <= (2 if min(len(x), len(y)) >= 32 else 1 if min(len(x), len(y)) >= 16 else 0)
    want = kept_lines(lines, near)
    found = line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(lines)), DOC), line_dedup.LinePolicy(short_lines=True, bucket=3))
    assert sorted(r["doc_id"] for r in found.collect()) == want and 100 < len(want) < len(lines)


def test_log_lines_are_not_all_paired(spark, monkeypatch):
    """20,000 lines with twelve random digits each: candidates stay few, and none is removed but for true neighbours."""
    rnd = random.Random(9)
    rows = [(i, "".join(rnd.choice("0123456789") for _ in range(12)) + " connection closed by remote host after idle timeout") for i in range(20_000)]
    counts = {}
    plain = line_dedup.settle

    def counting(df, label):
        out = plain(df, label)
        if label in ("line-pairs", "busy-lines", "busy-segments", "marked-lines"):
            counts[label] = max(counts.get(label, 0), out.count())
        return out

    monkeypatch.setattr(line_dedup, "settle", counting)
    found = line_dedup.op3_line_dedup(spark.createDataFrame(rows, DOC), line_dedup.LinePolicy(short_lines=True))
    removed = {r["doc_id"] for r in found.where("n_removed > 0").collect()}
    numbers, at = [text[:12] for _, text in rows], {}
    for i, x in enumerate(numbers):  # one of three parts of four digits is equal, two places away at most
        for k in (0, 4, 8):
            at.setdefault((k, x[k : k + 4]), []).append(i)
    near = {j for i, x in enumerate(numbers) for k in (0, 4, 8) for d in range(-2, 3) for j in at.get((k, x[max(0, k + d) : k + d + 4]), ()) if j != i and edits(x, numbers[j]) <= 2 and i < j}
    near |= {i for i, x in enumerate(numbers) for k in (0, 4, 8) for d in range(-2, 3) for j in at.get((k, x[max(0, k + d) : k + d + 4]), ()) if j < i and edits(x, numbers[j]) <= 2}
    assert removed == near and counts["line-pairs"] < 20_000 and counts["busy-lines"] < 20 * 20_000, counts
