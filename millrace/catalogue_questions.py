"""Queries of questions as a table: captures, names in lines, verbs of forms, patterns; and of whole clauses."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.catalogue import register
from millrace.functions import due, fixed, strings
from millrace.operators import clauses, diary, extraction
from millrace.plans import annotated, questions, sequence
from millrace.plans.annotated import TOKENS
from millrace.runtime import table

ELEMENTS = ("PROPN", "*", "?VERB", "NOUN", "*")


@register(
    "sequence_captures",
    f"""WITH {TOKENS}, s AS (SELECT doc_id, sent, string_agg(CASE upos WHEN 'PROPN' THEN 'P' WHEN 'VERB' THEN 'V' WHEN 'NUM' THEN 'N' WHEN 'ADP' THEN 'A' ELSE 'O' END, '' ORDER BY pos) AS c FROM tok GROUP BY doc_id, sent),
 m AS (SELECT doc_id, sent, length(c) AS n, regexp_extract(c, '^(P)(.*)(V?)(O)(.*)$', ['a', 'b', 'v', 'o', 'z']) AS g FROM s WHERE regexp_matches(c, '^(P)(.*)(V?)(O)(.*)$'))
 SELECT doc_id, sent, CAST(1 + length(g.b) AS INT) AS verb, CAST(1 + length(g.b) + length(g.v) AS INT) AS noun, CAST(n AS INT) AS n FROM m""",
)
def _(spark, d):
    held = F.array_sort(F.collect_list(F.struct("pos", F.col("lemma").alias("norm"), F.array("upos").alias("classes"))))
    rows = annotated.tokens(spark, d).groupBy("doc_id", "sent").agg(held.alias("tokens"))
    found = rows.select("doc_id", "sent", sequence.captures(ELEMENTS, F.col("tokens")).alias("b")).where("b IS NOT NULL")
    return found.select("doc_id", "sent", F.get("b", F.lit(2)).alias("verb"), F.get("b", F.lit(3)).alias("noun"), F.element_at("b", -1).alias("n"))


# Lines of conversations, their words, and word pairs that stand in several of them, as names

LINES = r"""ln AS (SELECT conv_id, turn, unnest(range(0, len(s))) AS line, unnest(s) AS text FROM (SELECT conv_id, turn, regexp_split_to_array(text, '[.\n]') AS s FROM conversations)),
wd AS (SELECT conv_id, turn, line, regexp_extract_all(text, '[\p{L}\p{N}_.]+') AS w FROM ln),
pr AS (SELECT conv_id, turn, line, i, lower(w[i]) || ' ' || lower(w[i + 1]) AS pair FROM wd, unnest(range(1, len(w))) t(i)),
nm AS (SELECT pair FROM pr GROUP BY pair HAVING count(DISTINCT (conv_id, turn, line)) > 2)"""


def sentences(spark, d):
    texts = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", r"[.\n]", -1)).alias("line", "text"))
    return texts.select(F.struct("conv_id", "turn", "line").alias("at"), "text")


@register(
    "name_segments",
    f"""WITH RECURSIVE {LINES}, sp AS (SELECT conv_id, turn, line, i - 1 AS a, i + 1 AS b FROM pr JOIN nm USING (pair)),
 ends AS (SELECT DISTINCT conv_id, turn, line, 0 AS p FROM sp UNION SELECT conv_id, turn, line, b FROM sp),
 nxt AS (SELECT e.conv_id, e.turn, e.line, p, min(s.a) AS a FROM ends e JOIN sp s ON e.conv_id = s.conv_id AND e.turn = s.turn AND e.line = s.line AND s.a >= e.p GROUP BY ALL),
 walk AS (SELECT conv_id, turn, line, a FROM nxt WHERE p = 0 UNION ALL SELECT nxt.conv_id, nxt.turn, nxt.line, nxt.a FROM walk JOIN nxt ON walk.conv_id = nxt.conv_id AND walk.turn = nxt.turn AND walk.line = nxt.line AND nxt.p = walk.a + 2)
 SELECT conv_id, turn, line, count(*) AS n_names, string_agg(a, ',' ORDER BY a) AS starts FROM walk GROUP BY conv_id, turn, line""",
)
def _(spark, d):
    lines = sentences(spark, d).withColumn("w", F.transform(F.regexp_extract_all("text", F.lit(questions.FORMS), F.lit(0)), F.lower)).where(F.size("w") > 0)
    starts = F.when(F.size("w") > 1, F.sequence(F.lit(1), F.size("w") - 1)).otherwise(F.array().cast("array<int>"))
    pairs = lines.select("at", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("w", i, 2), " "))).alias("name"))
    names = pairs.distinct().groupBy("name").count().where("count > 2").select("name")
    rows = lines.select(F.col("at").alias("key"), F.posexplode("w").alias("at", "form"))
    spans = questions.name_spans(rows, names, "key", lambda c: c)
    words = lines.select(F.col("at").alias("key"), "w").join(spans, "key")
    inside = lambda i: F.exists("spans", lambda s: (s["start"] <= i) & (i < s["end"]))
    no = F.lit(False)
    tokens = F.transform("w", lambda x, i: F.struct(x.alias("form"), x.alias("norm"), no.alias("skip"), no.alias("relational"), no.alias("boundary"), (~inside(i)).alias("gone"), no.alias("relative"), F.lit(None).cast("struct<predicate: string, object: string>").alias("sub")))
    # exploded, as a filter would split each line twice
    found = words.select("key", F.explode(F.filter(F.array(questions.split_names(tokens, F.col("spans"))), lambda n: F.size(n) > 0)).alias("n"))
    return found.select("key.conv_id", "key.turn", "key.line", F.size("n").cast("bigint").alias("n_names"), F.array_join(F.transform("n", lambda x: x["start"]), ",").alias("starts"))


EVENTS = ", ".join(f"('{k}', '{v}')" for k, v in fixed.EVENT_VERB_FORMS.items())


@register(
    "verb_forms",
    rf"""WITH f AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[\p{{L}}\p{{N}}_.]+')) AS form FROM conversations), w AS (SELECT DISTINCT strip_accents(lower(form)) AS norm FROM f),
 k AS (SELECT form AS predicate, strip_accents(lower(form)) AS p, regexp_matches(form, '^\p{{Lu}}') AS large FROM f WHERE length(form) = 5 AND NOT contains(form, '.')),
 b AS (SELECT p, arg_min(predicate, (large, predicate)) AS predicate FROM k GROUP BY p), e(norm, verb) AS (VALUES {EVENTS}),
 c AS (SELECT norm, regexp_replace(norm, '[aioy]+$', '') AS cut, regexp_replace(norm, '[aeiouy]+$', '') AS plain FROM w),
 n AS (SELECT norm, plain, predicate, p, large, len(list_filter(range(1, least(length(norm), length(p)) + 1), lambda i: left(norm, i) = left(p, i))) AS n FROM c JOIN k ON left(norm, 3) = left(p, 3) WHERE length(norm) >= 4 AND length(p) >= 3),
 best AS (SELECT norm, arg_min(predicate, (-n, large, predicate)) AS near FROM n WHERE (n >= 4 AND n >= least(length(norm), length(p)) - 2) OR (plain LIKE '%l' AND n >= greatest(3, length(p) - 1)) GROUP BY norm)
 SELECT c.norm, CASE WHEN c.norm NOT IN {fixed.COPULA_FORMS} THEN coalesce(s.predicate, substr(d.predicate, 3), 'ne' || a.predicate, l.predicate, e.verb, near) END AS verb, s.p IS NOT NULL OR l.p IS NOT NULL AS exact
 FROM c LEFT JOIN b s ON c.norm = s.p LEFT JOIN b d ON length(c.norm) >= 3 AND 'ne' || c.norm = d.p LEFT JOIN b a ON c.norm LIKE 'ne%' AND length(c.norm) >= 5 AND substr(c.norm, 3) = a.p
 LEFT JOIN b l ON cut LIKE '%l' AND cut = l.p LEFT JOIN e ON c.norm = e.norm LEFT JOIN best ON c.norm = best.norm""",
)
def _(spark, d):
    forms = table(spark, d, "conversations").select(F.explode(F.regexp_extract_all("text", F.lit(questions.FORMS), F.lit(0))).alias("form")).distinct()
    known = forms.where((F.length("form") == 5) & ~F.col("form").contains(".")).select(F.col("form").alias("predicate"))
    return questions.verb_matches(forms.select(strings.fold_accents(F.col("form")).alias("norm")), known)


#: Words of the four languages that the tables are made of, so that their lines ask something.
WORDS = questions.QuestionWords(
    interrogatives={"the": ("subj", "person", "Kdo"), "la": ("obj", None, "Co"), "die": ("loc", "geo", "Kde"), "que": ("attr", None, "Jaký")}, adverbs=(), copulas=("is", "est", "ist", "es"), relatives=("that", "qui", "der"),
    skip=("of", "in", "de", "und", "y", "le"), date_parts={}, relational=(), relation=(), first_person=(), temporal=(), current=(), event_verbs={}, event_classes={},
)
DECK = (sequence.Card("copula", (":is|est|ist|es", "uzel+", "*"), 2, predicate="být", known=(("subj", 2),), role="pred"), sequence.Card("led", (":the|la|die", "?uzel+", ":is|est", "*"), 1, hole=1, known=(("obj", 2),)))


@register("question_patterns")
def _(spark, d):
    lines = sentences(spark, d).where("text <> ''").select("at", F.concat("text", F.lit("?")).alias("text"))
    forms = lines.select(F.explode(F.regexp_extract_all("text", F.lit(questions.FORMS), F.lit(0))).alias("form")).distinct()
    known = forms.where((F.length("form") == 5) & ~F.col("form").contains(".")).select(F.col("form").alias("predicate"))
    names = forms.where(F.col("form").rlike(r"^\p{Lu}") | (F.length("form") > 5)).select(F.lower("form").alias("name")).distinct()
    asked = lines.select(F.to_json("at").alias("question"), "text")
    found = questions.question_patterns(asked, known, names, "question", DECK, words=WORDS, word=F.lower)
    return found.select("question", "card", "predicate", F.to_json("known").alias("known"), "hole", "is_copula")


@register("clause_facts")
def _(spark, d):
    mentions = extraction.with_canon(extraction.entity_mentions(annotated.named(spark, d)).where("kind = 'person'"))
    context = clauses.leading_persons(clauses.with_quiet(extraction.warmth_of(mentions), annotated.sentences(spark, d)))
    found = clauses.clause_facts_in(annotated.reader(spark, d, context))
    return found.groupBy("predicate").agg(F.count("*").alias("n"), F.sum(F.size("participants")).alias("n_participants"))


# Due times and plans of texts around an order's date

DUE_TEXTS = ("za {n} dny", "v 18:30", "zítra ráno", "večer v {n}", "v září", "pozítří", "21. června {n} dny předem", "příští rok")
DUE_SQL = f"""WITH q AS (SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) + to_hours(CAST(o_orderkey % 24 AS INT)) AS now, CAST(o_orderkey % 7 + 1 AS INT) AS n, o_orderkey // 7 % {len(DUE_TEXTS)} AS k FROM orders), s AS (SELECT *, date_trunc('day', now) AS d FROM q),
 t AS (SELECT *, make_timestamp(year(now), 9, 1, 9, 0, 0.0) AS september, make_timestamp(year(now), 6, 21, 9, 0, 0.0) AS june FROM s)"""


@register(
    "due_times",
    f"""{DUE_SQL} SELECT o_orderkey, CAST(CASE k WHEN 0 THEN now + to_days(n) WHEN 1 THEN CASE WHEN d + INTERVAL 1110 MINUTE <= now THEN d + INTERVAL 1 DAY + INTERVAL 1110 MINUTE ELSE d + INTERVAL 1110 MINUTE END WHEN 2 THEN d + INTERVAL 1 DAY + INTERVAL 7 HOUR
 WHEN 3 THEN CASE WHEN d + to_hours(n + 12) <= now THEN d + INTERVAL 1 DAY + to_hours(n + 12) ELSE d + to_hours(n + 12) END
 WHEN 4 THEN CASE WHEN september > now THEN september WHEN month(now) = 9 THEN d + INTERVAL 1 DAY + INTERVAL 9 HOUR ELSE september + INTERVAL 1 YEAR END
 WHEN 5 THEN d + INTERVAL 2 DAY + INTERVAL 9 HOUR WHEN 6 THEN CASE WHEN june > now THEN june ELSE june + INTERVAL 1 YEAR END - to_days(n) ELSE make_timestamp(year(now) + 1, 1, 1, 9, 0, 0.0) END AS TIMESTAMP) AS due FROM t""",
)
def _(spark, d):
    now = F.expr("CAST(o_orderdate AS TIMESTAMP_NTZ) + make_dt_interval(0, CAST(o_orderkey % 24 AS INT), 0, 0)").cast("timestamp_ntz")
    n, k = (F.col("o_orderkey") % 7 + 1).cast("string"), F.floor(F.col("o_orderkey") / 7) % len(DUE_TEXTS)
    text = F.get(F.array(*(F.format_string(x.replace("{n}", "%s"), n) if "{n}" in x else F.lit(x) for x in DUE_TEXTS)), k.cast("int"))
    return table(spark, d, "orders").select("o_orderkey", due.due_time(text, now).alias("due"))


@register(
    "plans",
    """WITH q AS (SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) + to_hours(CAST(o_orderkey % 24 AS INT)) AS now, o_orderkey // 7 % 4 AS k FROM orders), s AS (SELECT *, date_trunc('day', now) AS d FROM q), e AS (SELECT *, CASE k WHEN 0 THEN d + INTERVAL 17 HOUR WHEN 1 THEN date_trunc('week', now) + INTERVAL 7 DAY END AS event FROM s)
 SELECT o_orderkey, CAST(CASE k WHEN 0 THEN CASE WHEN event <= now THEN event + INTERVAL 1 DAY WHEN event - INTERVAL 2 HOUR <= now THEN now + INTERVAL 5 MINUTE ELSE event - INTERVAL 2 HOUR END WHEN 1 THEN event - INTERVAL 5 HOUR WHEN 2 THEN now + INTERVAL 3 HOUR ELSE d + INTERVAL 1 DAY + INTERVAL 7 HOUR END AS TIMESTAMP) AS due,
 CAST(CASE WHEN k = 1 OR event > now THEN event END AS TIMESTAMP) AS event, k <> 0 OR event > now AS offered FROM e""",
)
def _(spark, d):
    now = F.expr("CAST(o_orderdate AS TIMESTAMP_NTZ) + make_dt_interval(0, CAST(o_orderkey % 24 AS INT), 0, 0)").cast("timestamp_ntz")
    text = F.get(F.array(*map(F.lit, ("v 17:00 vlak", "příští týden úklid", "dnes zavolat", "zítra zavolat"))), (F.floor(F.col("o_orderkey") / 7) % 4).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", due.plan(text, now).alias("p")).select("o_orderkey", "p.*")


# A diary made of the events: every tenth line forgets something


@register(
    "diary_replay",
    """WITH l AS (SELECT event_id AS seq, user_id AS u, event_id % 10 AS k, event_type AS p, 'v' || event_id // 10 % 4 AS a, event_id // 10 % 3 AS b, ts, ts - to_days(CAST(1 + event_id // 10 % 3 AS INT)) AS s, ts - INTERVAL 12 HOUR AS e FROM events)
 SELECT seq FROM l s WHERE k NOT IN (0, 5, 7) AND NOT EXISTS (SELECT 1 FROM l f WHERE f.u = s.u AND f.seq > s.seq AND ((f.k = 0 AND f.p = s.p AND f.a = s.a) OR (f.k = 5 AND f.b = s.b AND f.seq % 3 = 0) OR (f.k = 7 AND s.ts >= f.s AND s.ts < f.e)))""",
)
def _(spark, d):
    seq = F.col("event_id")
    tens = F.floor(seq / 10)
    names = F.get(F.array(F.lit("Karel"), F.lit("Marie"), F.lit("Josef")), (tens % 3).cast("int"))
    op = F.when(seq % 10 == 0, diary.PATTERN).when((seq % 10 == 5) & (seq % 3 == 0), diary.ENTITY).when(seq % 10 == 5, "note").when(seq % 10 == 7, diary.INTERVAL).otherwise(diary.SAID)
    log = table(spark, d, "events").select(
        seq.alias("seq"), F.col("user_id").cast("string").alias("user"), op.alias("op"), F.col("event_type").alias("predicate"), F.array(F.concat(F.lit("v"), tens % 4)).alias("objects"), F.array(names).alias("nodes"), F.col("ts").alias("at"),
        names.alias("name"), F.expr("ts - make_dt_interval(CAST(1 + floor(event_id / 10) % 3 AS INT))").alias("start"), F.expr("ts - INTERVAL '12' HOUR").alias("end"),
    )
    return diary.replay(log).select("seq")
