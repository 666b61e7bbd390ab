"""Rows that share an id, or have none, are judged each for itself; ids may be strings."""

import hashlib

import pytest
from millrace.llm import decontam, line_dedup, run_index, similar, simhash, url_reputation

DOC = "doc_id long, text string"
DUP = "a line that two documents have in common, word for word"
OWN = [f"line number {i} is one that no other document has {i * 7919}" for i in range(8)]


def kept(found):
    return sorted(((r["doc_id"], r["text"]) for r in found.collect()), key=str)


@pytest.mark.parametrize("policy", [line_dedup.LinePolicy(short_lines=True), line_dedup.LinePolicy(max_broadcast=0)])
def test_lines_of_rows_without_id(spark, policy):
    rows = [(None, f"{DUP}\n{OWN[0]}"), (None, f"{OWN[1]}\n{DUP}"), (None, f"{OWN[2]}\n{OWN[3]}"), (7, f"{OWN[4]}\n{OWN[5]}"), (7, f"{OWN[6]}\n{DUP}"), (7, f"{OWN[6]}\n{DUP}"), (8, OWN[5])]
    found = kept(line_dedup.dedup_lines(spark.createDataFrame(rows, DOC), policy, drop_emptied=False))
    texts = "\n".join(t for _, t in found)
    assert all(texts.count(x) == 1 for x in OWN[:6]) and texts.count(DUP) == 1 and texts.count(OWN[6]) == 2
    assert len(found) == len(rows) and (8, "") in found and (7, f"{OWN[4]}\n{OWN[5]}") in found


def test_lines_of_one_id_go_from_the_later_row_only(spark):
    rows = [(7, f"{OWN[0]}\n{DUP}"), (7, f"{OWN[1]}\n{DUP}"), (9, DUP)]
    found = kept(line_dedup.dedup_lines(spark.createDataFrame(rows, DOC), drop_emptied=False))
    assert sorted(t for d, t in found if d == 7) in ([OWN[0], f"{OWN[1]}\n{DUP}"], [f"{OWN[0]}\n{DUP}", OWN[1]]) and (9, "") in found


def test_lines_with_string_ids_and_clashing_columns(spark):
    rows = [("b", DUP, 1, "x"), ("a", f"{DUP}\n{OWN[0]}", 2, "y"), (None, OWN[1], 3, "z")]
    docs = spark.createDataFrame(rows, "doc_id string, text string, place int, gone_places string")
    found = line_dedup.dedup_lines(docs, drop_emptied=False)
    assert found.columns == docs.columns
    got = {r["doc_id"]: (r["text"], r["place"], r["gone_places"]) for r in found.collect()}
    assert sum(t.count(DUP) for t, _, _ in got.values()) == 1 and got[None] == (OWN[1], 3, "z") and OWN[0] in got["a"][0]


def test_long_lines(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, long), (2, long[:-1] + "x"), (3, long[:1000] + long)]
    assert {r["doc_id"]: r["n_removed"] for r in line_dedup.op3_line_dedup(spark.createDataFrame(rows, DOC)).collect()} == {1: 0, 2: 1, 3: 0}


LEAK = "one two three four five six seven eight nine ten eleven"


@pytest.mark.parametrize("bound", [100_000, 0])
def test_leaks_of_rows_that_share_an_id(spark, bound):
    rows = [(None, LEAK), (None, "clean text"), (7, LEAK), (7, "x two"), (7, LEAK), (8, "")]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], DOC + ", pos int")
    items = spark.createDataFrame([(1, LEAK, "w"), (None, "clean text", "w"), (1, LEAK, "w")], "item_id long, text string, words string")
    policy = decontam.LeakPolicy(max_broadcast=bound)
    found = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["item_ids"]) for r in decontam.leak_report(docs, items, policy).collect()), key=str)
    assert found == sorted([(None, 11, 11, ["1"]), (None, 2, 0, []), (7, 11, 11, ["1"]), (7, 2, 0, []), (7, 11, 11, ["1"]), (8, 0, 0, [])], key=str)
    clean = decontam.drop_leaks(docs, items, policy)
    assert clean.columns == docs.columns and sorted(r["pos"] for r in clean.collect()) == [1, 3, 5]


def test_items_and_digests(spark):
    items = spark.createDataFrame([(2, LEAK), (10, LEAK + " twelve"), (3, "six seven")], "item_id long, text string")
    found = decontam.op2_decontamination(spark.createDataFrame([(1, LEAK + " twelve"), (2, "six seven"), (3, None)], DOC), items)
    want = {1: ["10", "2", "3"], 2: ["3"], 3: []}
    assert {r["doc_id"]: (r["n_items"], r["items_sha256"], r["contaminated"]) for r in found.collect()} == {d: (len(x), hashlib.sha256(",".join(x).encode()).hexdigest(), bool(x)) for d, x in want.items()}


@pytest.mark.parametrize("drop", [similar.drop_similar, simhash.drop_near_duplicates])
def test_copies_of_rows_that_share_an_id(spark, drop):
    a, b = (" ".join(f"{c}{i}" for i in range(200)) for c in "ab")
    rows = [(3, a), (7, a), (7, b), (9, b), (None, a)]
    assert kept(drop(spark.createDataFrame(rows, DOC))) == sorted([(3, a), (7, b), (None, a)], key=str)


def test_repeats_with_string_ids(spark):
    text = "x".join(str(i) for i in range(100))
    found = {r["doc_id"]: r["n_removed"] for r in run_index.op10_run_index_dedup(spark.createDataFrame([("a", text), ("b", text), (None, text), ("c", "short")], "doc_id string, text string")).collect()}
    assert found["c"] == 0 and found[None] == len(text) and sorted((found["a"], found["b"])) == [0, len(text)]


def test_repeats_in_very_long_texts(spark):
    text = " ".join(str(i) for i in range(300_000))
    found = {r["doc_id"]: (r["n_bytes"], r["n_removed"]) for r in run_index.op10_run_index_dedup(spark.createDataFrame([(2, text), (1, text[:1_000_000])], DOC)).collect()}
    assert found == {1: (1_000_000, 0), 2: (len(text), 1_000_000)}


def test_urls_of_string_ids_ports_and_addresses(spark):
    pages = [("a", "http://u:p@Host.co.uk:8080/x"), ("b", "http://1.2.3.4/x"), (None, None)]
    found = url_reputation.op5_url_filters(spark.createDataFrame(pages, "page_id string, url string"), spark.createDataFrame([("a", 0, 1), ("a", 1, 0)], "doc_id string, quality int, toxic int"))
    assert {r["page_id"]: r["host"] for r in found.collect()} == {"a": "u:p@host.co.uk:8080", "b": "1.2.3.4", None: ""}
    hosts = spark.createDataFrame([("u:p@host.co.uk:8080",), ("1.2.3.4",), ("a.b.com.",), ("x.gov.au",), ("com",)], "h string")
    policy = url_reputation.ReputationPolicy()
    got = [tuple(r) for r in hosts.select(url_reputation.domain_of(hosts.h, policy), url_reputation.suffix_of(hosts.h, policy)).collect()]
    assert got == [("host.co.uk", "co.uk"), ("1.2.3.4", "(address)"), ("b.com", "com"), ("x.gov.au", "gov.au"), ("com", "com")]
