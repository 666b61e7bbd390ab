"""Functions by name in SQL give what their columns give."""

from millrace.functions import strings
from millrace.operators import text
from millrace.plans import by_name
from pyspark.sql import functions as F

TEXTS = ["Karel Čapek napsal R.U.R. v r. 1920. Hra měla úspěch! Proč? Nevíme…  Konec.", "Bez konce", "", None, "It's 'quoted' \\ done. Ano."]


def test_functions_by_name(spark):
    assert by_name.register(spark) == ["fold_accents", "stem", "sentences_of", "words_of", "passages_of"]
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, body string")
    docs.createOrReplaceTempView("named_texts")
    plain = text.explode_sentences(docs, "body")
    assert spark.sql("SELECT doc_id, s.sent_idx, s.sentence FROM named_texts, LATERAL sentences_of(body) s ORDER BY 1, 2").collect() == plain.orderBy("doc_id", "sent_idx").collect()
    words = spark.sql("SELECT doc_id, pos, word, stem(word) AS s, fold_accents(word) AS f FROM named_texts, LATERAL words_of(body) ORDER BY 1, 2").collect()
    want = docs.select("doc_id", F.posexplode(strings.tokens(F.col("body"))).alias("pos", "word")).select("doc_id", "pos", "word", strings.stem(F.col("word")).alias("s"), strings.fold_accents(F.col("word")).alias("f"))
    assert words == want.orderBy("doc_id", "pos").collect() and len(words) > 15
    passages = spark.sql("SELECT doc_id, idx, passage FROM named_texts, LATERAL passages_of(body, 3, 2) ORDER BY 1, 2").collect()
    chunks = text.chunk(docs, text.sentences(F.col("body")), 3, 1).select("doc_id", "idx", "text").orderBy("doc_id", "idx").collect()
    assert [tuple(r) for r in passages] == [tuple(r) for r in chunks]
