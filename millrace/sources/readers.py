"""Sources and sinks. Nothing is inferred, and no path is opened but through Spark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace import schema
from millrace.operators.text import clean_text


def text_directory(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the file's name without its end), title, text of each .txt file; a missing folder is an error."""
    files = spark.read.option("pathGlobFilter", "*.txt").text(path, wholetext=True).select("_metadata.file_name", "value")
    name = F.regexp_replace(F.url_decode("file_name"), r"\.txt$", "")
    return files.select(name.alias("doc_id"), name.alias("title"), F.col("value").alias("text"))


def clean_directory(spark: SparkSession, source: str, target: str) -> None:
    """The cleaned texts of a folder as a table that mirrors it."""
    text_directory(spark, source).withColumn("text", clean_text(F.col("text"))).write.mode("overwrite").parquet(target)


def json_lines(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A log of one object a line; a path that isn't there is an empty log."""
    try:
        return spark.read.schema(kind).json(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], kind)


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def replace_table(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """child, parent; the last line of a child holds, and lines without a parent are left out."""
    rows = json_lines(spark, path, schema.GAZETTEER)
    order = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id()) if rows.inputFiles() else F.lit(0)
    rows = rows.withColumn("line", order).where("`in` is not null")  # files by name, a file's parts and lines in order
    return rows.groupBy(F.col("place").alias("child")).agg(F.max_by("in", "line").alias("parent"))


def books(spark: SparkSession, path: str) -> DataFrame:
    """book, chapter, text: a chapter's verses joined by blanks, from one nested JSON document."""
    nested = spark.read.schema(schema.BOOKS).option("multiLine", True).json(path)
    book = nested.select(F.posexplode("books").alias("b", "book")).select("b", "book.name", F.posexplode("book.chapters").alias("c", "chapter"))
    verses = F.transform("chapter.verses", lambda v: v["text"])
    return book.select(F.col("name").alias("book"), F.col("c").alias("chapter"), F.array_join(verses, " ").alias("text"))


def book_texts(chapters: DataFrame) -> DataFrame:
    """doc_id, text: a book's chapters with a blank line between them."""
    listed = chapters.groupBy(F.col("book").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("chapter", "text"))).alias("x"))
    return listed.select("doc_id", F.array_join(F.transform("x", lambda c: c["text"]), "\n\n").alias("text"))


def conllu(texts: DataFrame) -> DataFrame:
    """texts: doc_id, text (CoNLL-U). A row per word: doc_id, sent_idx, pos, form, lemma, upos, feats, head, deprel, start,
    end. Comments, joined words (1-2) and empty ones (1.1) are left out."""
    blocks = texts.select("doc_id", F.posexplode(F.split(F.regexp_replace("text", "\r", ""), r"\n[ \t]*\n+")).alias("sent_idx", "block"))
    lines = blocks.select("doc_id", "sent_idx", F.explode(F.split("block", "\n")).alias("line"))
    cells = lines.where(~F.col("line").startswith("#")).select("doc_id", "sent_idx", F.split("line", "\t").alias("c")).where((F.size("c") == 10) & F.col("c")[0].rlike(r"^\d+$"))
    value = lambda i: F.when(F.col("c")[i] != "_", F.col("c")[i])
    span = lambda i: F.regexp_extract(F.col("c")[9], r"TokenRange=(\d+):(\d+)", i).try_cast("int")
    return cells.select(
        "doc_id", "sent_idx", F.col("c")[0].cast("int").alias("pos"), F.col("c")[1].alias("form"), F.col("c")[2].alias("lemma"), value(3).alias("upos"),
        F.str_to_map(value(5), F.lit("\\|"), F.lit("=")).alias("feats"), F.col("c")[6].try_cast("int").alias("head"), value(7).alias("deprel"), span(1).alias("start"), span(2).alias("end"),
    )


def annotate(texts: DataFrame, fixture: DataFrame) -> DataFrame:
    """Annotations that are there already, by the text they are of; a text without one has none."""
    return texts.join(fixture, "text", "left")


def write_shards(facts: DataFrame, path: str, key: str = "doc") -> None:
    """One folder per document, so that mounting some of them reads nothing else."""
    facts.repartition(key).write.mode("append").partitionBy(key).parquet(path)


def mount(spark: SparkSession, path: str, documents: Sequence[str], key: str = "doc") -> DataFrame:
    return spark.read.parquet(path).where(F.col(key).isin(*documents))


def mount_routed(spark: SparkSession, path: str, routed: DataFrame, key: str = "doc") -> DataFrame:
    """The shards of a table of documents; Spark prunes the folders by it."""
    return spark.read.parquet(path).join(routed.select(key).distinct(), key, "left_semi")


def append_templates(known: DataFrame, new: DataFrame) -> DataFrame:
    """New templates whose id is not known yet, each once."""
    return new.dropDuplicates(["id"]).join(known.select("id"), "id", "left_anti")


def entities_from_tokens(tokens: DataFrame) -> DataFrame:
    """tokens: doc_id, sent_idx, pos, form, kind (null: none), case. Longest runs of one kind; persons also need one case."""
    order = Window.partitionBy("doc_id", "sent_idx").orderBy("pos")
    same = (F.lag("kind").over(order) == F.col("kind")) & ((F.col("kind") != "person") | F.lag("case").over(order).eqNullSafe(F.col("case")))
    runs = tokens.withColumn("new", (~F.coalesce(same, F.lit(False))).cast("int")).withColumn("run", F.sum("new").over(order)).where("kind is not null")
    listed = runs.groupBy("doc_id", "sent_idx", "run", "kind").agg(F.array_sort(F.collect_list(F.struct("pos", "form"))).alias("x"))
    return listed.select("doc_id", "sent_idx", F.col("kind").alias("type"), F.array_join(F.transform("x", lambda t: t["form"]), " ").alias("text"))
