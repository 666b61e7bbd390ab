"""Schemas of the tables, as types or as DDL text; every reader declares one."""

from __future__ import annotations

from pyspark.sql import types as T

PARTICIPANT = T.StructType([T.StructField("role", T.StringType()), T.StructField("node", T.StringType()), T.StructField("type", T.StringType())])
FACT = T.StructType(
    [
        T.StructField("fact_id", T.StringType()),
        T.StructField("predicate", T.StringType()),
        T.StructField("participants", T.ArrayType(PARTICIPANT)),
        T.StructField("weight", T.LongType()),
        T.StructField("seq", T.LongType()),
    ]
)
TOKEN = "form string, lemma string, upos string, feats map<string,string>, head int, deprel string, start int, end int"
ENTITY = "text string, type string, start int, end int"
MEMORY = "kind string, predicate string, objects array<string>, places array<string>, subject string, time string, card string, needs_subject boolean, raw string"
REMINDER = "due timestamp_ntz, task string, event string, recipient string"
TELEMETRY = "ts timestamp_ntz, q string, kind string, answer string, assurance double, components array<string>, patterns array<string>, topic string, predicate string"
GAZETTEER = "place string, `in` string, near string"
BOOKS = "books array<struct<name:string,chapters:array<struct<verses:array<struct<text:string>>>>>>"
