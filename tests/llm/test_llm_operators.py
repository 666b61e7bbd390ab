"""The operators against brute force, on texts made for their edges."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from millrace.llm import components, decontam, html_text, line_dedup, packing, pii, quality, run_index, simhash, url_reputation, warc

DOC = "doc_id long, text string"
EDGES = [(900, None), (901, ""), (902, " \n\t "), (None, "lost id " * 30)]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# 1


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("bucket", [16, 2])
def test_simhash(spark, bucket):
    rnd = random.Random(3)
    texts = []
    for _ in range(25):
        words = [rnd.choice("ab cd É x".split()) + str(rnd.randint(0, 99)) for _ in range(rnd.randint(1, 250))]
        for k in range(rnd.choice([1, 2, 20])):
            copy = list(words)
            if k:
                copy[rnd.randrange(len(copy))] = f"Q{rnd.randint(0, 5)}"
            texts.append(" ".join(copy))
    texts += [None, "", "A b c", "a B C"]
    ids = list(range(len(texts)))
    rnd.shuffle(ids)
    prints = {i: plain_fingerprint(t) for i, t in zip(ids, texts, strict=True)}
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), DOC)
    found = simhash.near_duplicate_groups(docs, simhash.SimHashPolicy(max_bucket=bucket)).collect()
    assert {r["doc_id"]: (r["fp"] % (1 << 64), r["component_id"]) for r in found} == {i: (prints[i], find(i)) for i in ids}


def test_components_of_a_chain(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (7, 7)]
    got = {r["node"]: r["root"] for r in components.smallest_reachable(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


def test_simhash_keeps_one_of_each_group_and_all_columns(spark):
    long = " ".join(f"w{i}" for i in range(80))
    docs = spark.createDataFrame([(3, long, "x", 1), (1, long, "y", 2), (2, "other words here", "z", 3), (None, long, "n", 4)], "doc_id long, text string, fp string, component_id int")
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 2]


# 2


def plain_leaks(docs, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for i, text in items:
        words = word.findall(lower(text))
        size = min(10, len(words))
        for k in range(len(words) - size + 1 if words else 0):
            windows.setdefault(tuple(words[k : k + size]), set()).add(str(i))
    out = {}
    for d, text in docs:
        words, hit, named = word.findall(lower(text)), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(words) - size + 1):
                if found := windows.get(tuple(words[k : k + size])):
                    hit.update(range(k, k + size))
                    named |= found
        out[d] = (len(words), len(hit), sorted(named))
    return out


@pytest.mark.parametrize("bound", [100_000, 0])
def test_leaks(spark, bound):
    rnd = random.Random(2)
    words = ["a", "b", "C", "é", "É", "x1", "K", "k"]
    make = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    items = [(i, make(rnd.choice([1, 2, 3, 5, 9, 10, 11, 14]))) for i in range(8)] + [(20, None), (21, ""), (1, make(12))]
    docs = [(i, make(rnd.randint(0, 60))) for i in range(40)] + [(200 + i, make(3) + "\n" + items[i][1] + ", " + make(2)) for i in range(8)] + EDGES[:3]
    found = decontam.leak_report(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, "item_id long, text string"), decontam.LeakPolicy(max_broadcast=bound))
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["item_ids"]) for r in found.collect()} == plain_leaks(docs, items)


def test_no_benchmark_no_leak(spark):
    docs, none = spark.createDataFrame([(1, "some words"), *EDGES], DOC), spark.createDataFrame([], "item_id long, text string")
    assert decontam.op2_decontamination(docs, none).where("contaminated").count() == 0
    assert decontam.drop_leaks(docs, none).count() == 5


# 3


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rnd, text, n):
    out = list(text)
    for _ in range(n if len(out) > 4 else 0):
        at = rnd.randrange(len(out))
        kind = rnd.randrange(3)
        out[at : at + (kind != 2)] = [] if kind == 1 else [rnd.choice("xyzé ")]
    return "".join(out)


@pytest.mark.parametrize("k", [1, 2, 3])
def test_banded_distance(spark, k):
    rnd = random.Random(k)
    pairs = [(a, edited(rnd, a, rnd.randint(0, 4))) for a in ("".join(rnd.choice("abé") for _ in range(rnd.randint(0, 9))) for _ in range(200))]
    chars = spark.createDataFrame(pairs, "a string, b string").select("a", "b", line_dedup.byte_chars(F.col("a")).alias("x"), line_dedup.byte_chars(F.col("b")).alias("y"))
    for r in chars.select("a", "b", line_dedup.within(F.col("x"), F.col("y"), k).alias("near")).collect():
        assert r["near"] == (distance(r["a"].encode(), r["b"].encode()) <= k)


def test_line_dedup(spark):
    rnd = random.Random(6)
    base = ["".join(rnd.choice("abcdefghij é") for _ in range(rnd.randint(28, 60))).strip() for _ in range(20)]
    line = lambda: rnd.choice(["", "short", edited(rnd, rnd.choice(base), rnd.choice([0, 0, 1, 2, 3])), "  " + rnd.choice(base) + "\t"])
    docs = [(i * 3 % 41, "\n".join(line() for _ in range(rnd.randint(0, 8)))) for i in range(40)] + EDGES[:3]
    seen, gone = [], set()
    for d, text in sorted(docs, key=lambda x: x[0]):
        for at, x in enumerate((text or "").split("\n")):
            x = x.strip(line_dedup.BLANKS)
            if len(x) >= 32:
                if any(distance(x.encode(), y.encode()) <= 2 for y in seen):
                    gone.add((d, at))
                seen.append(x)
    want = {}
    for d, text in docs:
        lines = (text or "").split("\n")
        kept = [x for at, x in enumerate(lines) if (d, at) not in gone]
        want[d] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    found = line_dedup.op3_line_dedup(spark.createDataFrame(docs, DOC)).collect()
    assert {r["doc_id"]: (r["n_lines"], r["n_removed"], r["kept_sha256"]) for r in found} == want


# 4


def plain_pii(text):
    def luhn(number):
        return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(number))) % 10 == 0

    out, text = [], text or ""
    digits = lambda x: re.sub("[^0-9]", "", x)
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end(), "email"))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        if 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0])):
            out.append((m.start(), 2, m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(digits(m[0])) <= 15:
            out.append((m.start(), 3, m.end(), "phone"))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def test_pii(spark):
    rnd = random.Random(1)
    bits = list("a1@.+- ()9%_é😀0") + ["a@b.c", "192.168.1.1", "+1 (234) 555-6789", "4111 1111 1111 1111", "1.2.3.4.5.6.7.8"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 60))) for _ in range(1500)] + [None, "", "1 " * 50_000, "a" * 100_000 + "@", "+1" + "(" * 50_000, "a@b.c_d@e.f-g@h.i"]
    found = pii.op4_pii(spark.createDataFrame(list(enumerate(texts)), DOC)).collect()
    for r in found:
        assert r["base_sha256"] == hashlib.sha256(plain_pii(texts[r["doc_id"]]).encode()).hexdigest()


def test_pii_more_kinds_and_redaction(spark):
    text = "IBAN DE89 3704 0044 0532 0130 00 ok, ssn 123-45-6789 but 987 and 123-45-6789; mail me: a@b.cz"
    found = pii.find_pii(spark.createDataFrame([(1, text)], DOC))
    assert [(s["kind"], s["value"]) for s in found.first()["pii"]][:2] == [("iban", "DE89 3704 0044 0532 0130 00"), ("ssn", "123-45-6789")]
    assert pii.redact(found).first()["text"].startswith("IBAN [IBAN] ok, ssn [SSN] but")


# 5


def test_urls(spark):
    urls = [
        ("http://WWW.example.com/en/x?q#f", "www.example.com", "/en/x", "www.example.com/en/", "allow"), ("https://a.example.com/en/", "a.example.com", "/en/", "example.com/en/", "block"),
        ("http://b.com", "b.com", "", None, "allow"), ("http://x.net/es/1", "x.net", "/es/1", "net/es/", "block"), ("x.net/es/1", "", "", None, "allow"), (None, "", "", None, "allow"),
        ("http://notexample.com/en/a", "notexample.com", "/en/a", "com/", "allow"), ("http://bad.org/1?x=://y", "bad.org", "/1", None, "block"),
    ]
    pages = [(i, u[0]) for i, u in enumerate(urls)] + [(100 + i, "http://bad.org/z") for i in range(60)] + [(300 + i, f"http://good{i}.org/") for i in range(60)]
    labels = [(100 + i, 0, 1) for i in range(60)] + [(300 + i, 1, 0) for i in range(60)] + [(5, None, None), (None, 1, 1)]
    found = url_reputation.op5_url_filters(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r["page_id"]: tuple(r)[1:5] for r in found.collect()}
    assert len(got) == len(pages) and all(got[i] == u[1:] for i, u in enumerate(urls)) and all(got[300 + i][3] == "allow" for i in range(60))


# 6


def test_quality(spark):
    rnd = random.Random(8)
    prose = " ".join("".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randint(2, 9))) for _ in range(400))
    noise = " ".join(base64.b64encode(rnd.randbytes(30)).decode() for _ in range(200))
    texts = {1: prose, 2: "spam ham " * 300, 3: noise, 4: "too short", 5: None, 6: "one two three four\n" * 40, 7: "a #b\n\na #b\nc\x0bd\xa0e"}
    found = {r["doc_id"]: r for r in quality.op6_quality_rules(spark.createDataFrame(list(texts.items()), DOC)).collect()}
    assert {k for k, r in found.items() if r["kept"]} == {1}
    assert (found[7]["n_words"], found[7]["word_chars"], found[7]["n_symbols"], found[7]["n_dup_lines"], found[7]["n_repeat_words"]) == (6, 10, 2, 1, 0)
    for k in (1, 6, 7):
        words = re.findall(r"[^\x20\x09-\x0D]+", texts[k])
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        held = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
        assert found[k]["n_repeat_words"] == len(held) and found[k]["n_words"] == len(words)


# 7


def test_tokens_by_chunks_are_those_of_the_whole_text():
    import public_tokenizers
    from tokenizers import Tokenizer

    whole, chunked, rnd = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), packing.ChunkTokenizer(packing.PackPolicy(cache_bits=4, group_bytes=64)), random.Random(5)
    bits = list("abÉéΣσ1'’  \x1c\x85\n\t́😀<|>") + ["<|endoftext|>", "'s", "Straße", "İ"]
    for _ in range(600):
        text = "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 80)))
        assert np.frombuffer(chunked.encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_packing(spark):
    rnd = random.Random(9)
    texts = [" ".join(rnd.choice(["alpha", "beta", "gamma"]) for _ in range(rnd.choice([0, 5, 40, 300]))) for _ in range(120)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), DOC)
    found = packing.pack(docs, packing.PackPolicy(capacity=128)).collect()
    tokenizer = packing.ChunkTokenizer(packing.PackPolicy())
    ids = {i: tokenizer.encode(t) + np.array([1], "<u4").tobytes() for i, t in enumerate(texts)}
    pieces = {}
    for r in found:
        part = ids[r["doc_id"]][4 * r["start"] : 4 * (r["start"] + r["length"])]
        assert len(part) == 4 * r["length"] and r["ids_crc32"] == zlib.crc32(part) and r["start"] == 128 * r["piece"]
        pieces.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sum(r["length"] for r in found) == sum(map(len, ids.values())) // 4
    for held in pieces.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 128
    assert len(pieces) <= packing.best_fit(np.bincount([r["length"] for r in found], minlength=129), 128).sequences


@pytest.mark.parametrize("lengths", [[6, 5, 5, 4, 3, 3, 2, 2], [7] * 9 + [3] * 5 + [1] * 4, [9, 9, 8, 2, 1], [4, 4, 4, 3, 3, 3, 3], [10], []])
def test_plan_is_best(lengths):
    counts = np.bincount(lengths, minlength=11).astype(np.int64)
    plan = packing.complete(counts, packing.PackPolicy(capacity=10))

    def best(left, bins):
        if not left:
            return len(bins)
        tries = [bins[:i] + (x - left[0],) + bins[i + 1 :] for i, x in enumerate(bins) if x >= left[0]] + [(*bins, 10 - left[0])]
        return min(best(left[1:], b) for b in tries)

    assert plan.sequences == (best(tuple(sorted(lengths, reverse=True)), ()) if lengths else 0)
    back = np.zeros(11, np.int64)
    for filling, times in plan.fillings:
        assert sum(filling) <= 10
        for x in filling:
            back[x] += times
    assert (back == counts).all()


# 8


def test_warc(spark):
    rnd = random.Random(4)
    bodies = ["a" * 99, "b" * 100, "é" * 50, "c" * 200, None, "", "x\r\n\r\nWARC/1.1\r\n" * 9, "\0퟿" + "q" * 120]
    pages = [(i, f"http://x/{i}\n", rnd.choice(bodies)) for i in range(100)] + [(None, None, "b" * 100), (7, "u", "b" * 100)]
    first = {}
    for i, _, h in pages:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)

    def want(i, h):
        raw = (h or "").encode()
        again = len(raw) >= 100 and i is not None and first[h or ""] != i
        return (i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first[h or ""] if again else None)

    found = warc.op8_warc(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert sorted(map(tuple, found), key=str) == sorted((want(i, h) for i, _, h in pages), key=str)


@pytest.mark.parametrize("packed", [True, False])
def test_salvage(packed):
    body = lambda i: b"%d " % i * 300
    records = [warc.record_bytes(i, "http://y", body(i), hashlib.sha256(body(i)).hexdigest(), None, warc.WarcPolicy()) for i in range(6)]
    parts = [warc.member(r, 6) for r in records] if packed else records
    data, at = bytearray(b"".join(parts)), len(parts[0]) + len(parts[1])
    data[at + len(parts[2]) // 2] ^= 255
    data = bytes(data[:-20])
    found = list(warc.salvage(data))
    assert [warc.page_of(x.headers["warc-record-id"]) for x in found if not isinstance(x, tuple)] == [0, 1, 3, 4]
    assert [x for x in found if isinstance(x, tuple)] == [(at, at + len(parts[2])), (sum(map(len, parts[:5])), len(data))]
    assert list(warc.salvage(b"")) == [] and list(warc.salvage(b"junk")) == [(0, 4)]


# 9


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("<title>x</title><p>a<p>b &amp; c<ul><li>one<li>two<ul><li>in</ul><li>three</ul>z<ol start=3><li>q<li>r</ol>", "a\n\nb & c\n\n* one\n* two\n  * in\n* three\n\nz\n\n3. q\n4. r"),
        ("<table><tr><th>Name<th>Qty<tr><td>apple<td>1<tr><td>pineapple pie<td>22</table>after", "Name           Qty\napple          1\npineapple pie  22\n\nafter"),
        ("<pre>a  b\n  c</pre><div hidden>no</div><span style='display: none'>no</span>ok<script>if(a<b){}</script>!", "a  b\n  c\n\nok!"),
        ("x < y", "x < y"), ("<td>lone</td>", "lone"), ("<!-- c --><!doctype html>k<!--", "k"), ("<p>two <b>bo</b>ld</p>", "two bold"), ("<details><summary>S</summary><p>hid</details>", "S"), (None, ""), ("", ""),
    ],
)
def test_html(source, text):
    assert html_text.render(source)[0] == text


def test_html_of_any_shape_ends():
    for source in ("<div>" * 20_000, "<a b=\"'" * 5_000, "<ul><li>" * 2_000 + "x", "<table><tr>" + "<td>x" * 5_000, "<" * 50_000, "<p><b>" * 5_000):
        html_text.render(source)


def test_html_rows(spark):
    rows = [(1, "<p>a"), (None, None), (1, "<p>a")]
    assert sorted(r["text"] for r in html_text.op9_html_extraction(spark.createDataFrame(rows, "page_id long, html string")).collect()) == ["", "a", "a"]


# 10


def plain_repeats(docs, length):
    first, out = {}, []
    for d, text in docs:
        raw, key = (text or "").encode(), run_index.LAST if d is None else d
        for i in range(len(raw) - length + 1):
            first[raw[i : i + length]] = min(first.get(raw[i : i + length], key), key)
    for d, text in docs:
        raw, key = (text or "").encode(), run_index.LAST if d is None else d
        gone = [False] * len(raw)
        for i in range(len(raw) - length + 1):
            if first[raw[i : i + length]] < key:
                gone[i : i + length] = [True] * length
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(raw), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(raw, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def repeat_docs(seed, alphabet):
    rnd = random.Random(seed)
    base = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(20, 300))) for _ in range(12)]
    piece = lambda: (lambda b, a: rnd.choice([b, b[a : rnd.randint(a, len(b))], "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 90)))]))(rnd.choice(base), rnd.randint(0, 19))
    docs = [(i, "".join(piece() for _ in range(rnd.randint(0, 5)))) for i in range(60)]
    return [*docs, (200, None), (201, ""), (None, base[0] * 3), (5, "x" * 300), (5, docs[7][1]), (7, "x" * 299)]


@pytest.mark.parametrize(("alphabet", "size"), [("ab", 8 << 20), ("abcdefgh é", 2000), ("a", 3000)])
def test_repeats(spark, alphabet, size):
    docs = repeat_docs(7, alphabet)
    found = run_index.remove_repeats(spark.createDataFrame(docs, DOC), run_index.RepeatPolicy(batch_bytes=size)).drop("kept").collect()
    assert sorted(map(tuple, found), key=str) == plain_repeats(docs, 50)


def test_run_index_follows_the_transform():
    rnd = np.random.default_rng(1)
    texts = rnd.integers(97, 99, (40, 30)).astype(np.uint8)
    index = run_index.RunIndex(texts, np.full(40, 30), np.arange(40), 10)
    marks = index.marks(texts, np.full(40, 21), np.arange(40))
    for t in range(40):
        for at in range(21):
            earlier = any(bytes(texts[t, at : at + 10]) in bytes(texts[u]) for u in range(t))
            assert bool(int(marks[t]) >> at & 1) == earlier


# all of them


def test_empty_tables(spark):
    docs, pages = spark.createDataFrame([], DOC), spark.createDataFrame([], "page_id long, url string, html string")
    items, labels = spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = [
        simhash.op1_simhash(docs), decontam.op2_decontamination(docs, items), line_dedup.op3_line_dedup(docs), pii.op4_pii(docs), url_reputation.op5_url_filters(pages, labels),
        quality.op6_quality_rules(docs), packing.op7_best_fit_packing(docs), warc.op8_warc(pages), html_text.op9_html_extraction(pages), run_index.op10_run_index_dedup(docs),
    ]
    assert [f.count() for f in found] == [0] * 10


def test_edges_and_clashing_columns(spark):
    docs = spark.createDataFrame([(*x, "h", 1) for x in EDGES + EDGES[:1]], DOC + ", hashes string, n_words int")
    items = spark.createDataFrame([(1, "lost id lost id lost id lost id lost id", "k")], "item_id long, text string, words string")
    for found in (simhash.op1_simhash(docs), decontam.op2_decontamination(docs, items), line_dedup.op3_line_dedup(docs), pii.op4_pii(docs), quality.op6_quality_rules(docs), packing.op7_best_fit_packing(docs), run_index.op10_run_index_dedup(docs)):
        assert found.count() == 5
