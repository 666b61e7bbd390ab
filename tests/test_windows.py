"""Windows around peaks of activation."""

from millrace.operators import retrieval


def test_windows_of_documents_with_names(spark):
    scores = [0, 3, 0, 2, 0, 0, 0, 4, 0]
    rows = spark.createDataFrame([(1, "a", i, float(x)) for i, x in enumerate(scores)] + [(1, "b", 0, 1.0), (1, "c", 0, 0.0)], "query long, doc string, place int, activation double")
    found = retrieval.focus_windows(rows, "query", "doc", "place", 2, 5).orderBy("rank").collect()
    assert [(r["doc"], r["peak"], r["low"], r["high"], r["activation"]) for r in found] == [("a", 7, 5, 9, 4.0), ("a", 1, 0, 4, 3.0), ("b", 0, 0, 1, 1.0)]
    assert retrieval.focus_windows(rows, "query", "doc", "place", 0, 1).count() == 1
