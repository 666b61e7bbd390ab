"""The library's queries over the supplied tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions import fixed, strings, temporal
from millrace.operators import activation, dialog, evidence, facts, matching, memory, retrieval, roles
from millrace.operators import text as texts
from millrace.plans import pattern, star
from millrace.plans.pattern import Graph, Pattern, SubQuery
from millrace.runtime import settle, table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

THING, PERSON = "small ring", "Customer#000000001"

RAW = """raw AS (SELECT CASE WHEN l_returnflag = 'R' THEN 'return' ELSE 'order' END AS predicate, c_name AS subj, p_name AS obj,
 n_name AS loc, CAST(o_orderdate AS DATE) AS day, CAST(l_quantity AS INT) AS num, o_orderkey AS source, p_brand AS brand, l_linestatus AS status
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey
 JOIN nation ON c_nationkey = n_nationkey)"""
FACTS = RAW + """, f AS (SELECT predicate, subj, obj, loc, count(*) AS weight, count(DISTINCT source) AS n_sources, min(source) AS seq
 FROM raw GROUP BY predicate, subj, obj, loc)"""
PARTS = FACTS + """, p AS (SELECT *, 'subj' AS role, subj AS node, 'person' AS type FROM f UNION ALL SELECT *, 'obj', obj, 'concept' FROM f
 UNION ALL SELECT *, 'loc', loc, 'geo' FROM f)"""
WORD_SQL = r"regexp_extract_all(text, '[\p{L}\p{N}_]+')"


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(query: Query) -> Query:
        QUERIES[name] = query
        if sql is not None:
            SQL[name] = sql
        return query

    return put


def graph_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star.facts(spark, sf_dir)


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.explode_participants(graph_facts(spark, sf_dir))


def flat(found: DataFrame, *more: str) -> DataFrame:
    held = F.col("participants")
    return found.select("predicate", facts.node_of(held, "subj").alias("subj"), facts.node_of(held, "obj").alias("obj"), facts.node_of(held, "loc").alias("loc"), "weight", *more)


# Facts


@register("fact_upsert_weights", f"WITH {FACTS} SELECT * FROM f")
def _(spark, d):
    return flat(star.facts(spark, d, sources=True), "n_sources", "seq")


@register("node_weights", f"WITH {PARTS} SELECT node AS id, min(type) AS type, CAST(sum(weight) AS BIGINT) AS weight FROM p GROUP BY node")
def _(spark, d):
    return facts.nodes(graph_facts(spark, d))


@register("facts_of_node", f"WITH {FACTS} SELECT predicate, subj, obj, loc, weight FROM f WHERE obj = '{THING}' AND predicate = 'order'")
def _(spark, d):
    return flat(facts.facts_of(graph_facts(spark, d), THING, "obj", "order"))


@register("facts_of_predicates", f"WITH {FACTS} SELECT predicate, subj, obj, loc, weight, seq FROM f WHERE predicate IN ('return')")
def _(spark, d):
    return flat(facts.facts_of_predicates(graph_facts(spark, d), ["return"]), "seq")


@register("predicate_roles", f"WITH {PARTS} SELECT predicate, string_agg(DISTINCT role, ',' ORDER BY role) AS roles FROM p GROUP BY predicate")
def _(spark, d):
    return facts.predicate_roles(parts(spark, d)).select("predicate", F.array_join("roles", ",").alias("roles"))


@register(
    "doc_links",
    f"""WITH {RAW}, s AS (SELECT DISTINCT brand AS doc, subj AS node FROM raw) SELECT x.doc AS a, y.doc AS b, count(*) AS weight
 FROM s x JOIN s y ON x.node = y.node AND x.doc <> y.doc GROUP BY x.doc, y.doc""",
)
def _(spark, d):
    return facts.document_links(star.lines(spark, d).select(F.col("brand").alias("doc"), F.col("subj").alias("node")))


@register("remap_nodes_merge", f"WITH {FACTS} SELECT predicate, subj, split_part(obj, ' ', 2) AS obj, loc, CAST(sum(weight) AS BIGINT) AS weight FROM f GROUP BY ALL")
def _(spark, d):
    names = table(spark, d, "part").select(F.col("p_name").alias("node")).distinct()
    return flat(facts.remap(graph_facts(spark, d), names.withColumn("target", F.element_at(F.split("node", " "), 2))))


STEM_SQL = (
    "CASE WHEN length(s) >= 3 THEN regexp_replace(s, '^(.+)" + fixed.FLEETING_VOWEL + "([^" + fixed.VOWELS + "])$', '\\1\\2') ELSE s END"
)
CUT_SQL = f"translate(regexp_replace(lower(w), '^(.{{3,}}?)(?:{'|'.join(fixed.SUFFIXES)})$', '\\1'), '{fixed.LONG_VOWELS}', '{fixed.SHORT_VOWELS}')"
TOKENS_SQL = f"tok AS (SELECT DISTINCT unnest({WORD_SQL}) AS w FROM documents)"


def token_forms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(strings.WORD), F.lit(0))).alias("w")).distinct()


@register(
    "cluster_canonical",
    f"""WITH {TOKENS_SQL}, c AS (SELECT w, {CUT_SQL} AS s FROM tok), k AS (SELECT w, {STEM_SQL} AS key FROM c)
 SELECT key, arg_min(w, (length(w), w)) AS canonical, count(DISTINCT w) AS members FROM k GROUP BY key""",
)
def _(spark, d):
    return facts.canonical_by_cluster(token_forms(spark, d).select(F.col("w").alias("node")))


@register(
    "name_families",
    f"""WITH n AS (SELECT DISTINCT p_name FROM part), t AS (SELECT p_name, unnest(string_split(p_name, ' ')) AS w FROM n),
 c AS (SELECT p_name, {CUT_SQL} AS s FROM t WHERE length(w) > 2), k AS (SELECT DISTINCT p_name, {STEM_SQL} AS stem FROM c)
 SELECT stem, string_agg(p_name, '|' ORDER BY p_name) AS members FROM k GROUP BY stem HAVING count(*) > 1""",
)
def _(spark, d):
    names = table(spark, d, "part").select(F.col("p_name").alias("node")).distinct()
    return facts.name_families(names).select("stem", F.array_join("members", "|").alias("members"))


@register(
    "fingerprint_overlap",
    """WITH s AS (SELECT DISTINCT s_name, s_nationkey, l_partkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)
 SELECT x.s_name AS a, y.s_name AS b, count(*) AS shared FROM s x JOIN s y ON x.s_nationkey = y.s_nationkey AND x.l_partkey = y.l_partkey AND x.s_name < y.s_name
 GROUP BY x.s_name, y.s_name HAVING count(*) >= 3""",
)
def _(spark, d):
    sold = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    prints = sold.select("s_nationkey", F.col("s_name").alias("node"), F.col("l_partkey").alias("neighbour")).distinct()
    return facts.overlap(prints, 3, within=["s_nationkey"])


@register("export_edges_by_role", f"WITH {PARTS} SELECT role, count(*) AS edges, CAST(sum(weight) AS BIGINT) AS weight FROM p GROUP BY role")
def _(spark, d):
    return facts.export_edges(graph_facts(spark, d)).groupBy("role").agg(F.count("*").alias("edges"), F.sum("weight").alias("weight"))


# Patterns


def match_sql(known: str, hole: str, rest: list[str], semantic: bool = False, predicates: str = "predicate = 'order'", exact: str = "10", limit: int = 5) -> str:
    arms = [f"SELECT {hole} AS node, weight + {exact} + 1000 AS score, seq FROM f WHERE {predicates} AND {known}"]
    arms += [] if semantic else [f"SELECT {r}, weight + {exact}, seq FROM f WHERE {predicates} AND {known}" for r in rest]
    union = " UNION ALL ".join(arms)
    return f"WITH {FACTS}, c AS ({union}), t AS (SELECT node, max(score) AS score, min(seq) AS seq FROM c WHERE score = (SELECT max(score) FROM c) GROUP BY node) SELECT node, score, seq FROM t ORDER BY seq, node LIMIT {limit}"


def ask(spark: SparkSession, d: str, asked: Pattern, **more) -> DataFrame:
    return pattern.run(Graph(graph_facts(spark, d), **more), asked)


@register("pattern_hole_subj", match_sql(f"obj = '{THING}'", "subj", ["loc"]))
def _(spark, d):
    return ask(spark, d, Pattern("order", (("obj", THING),), "subj"))


@register("pattern_hole_obj", match_sql(f"subj = '{PERSON}'", "obj", ["loc"]))
def _(spark, d):
    return ask(spark, d, Pattern("order", (("subj", PERSON),), "obj"))


@register("pattern_hole_loc", match_sql(f"subj = '{PERSON}'", "loc", [], semantic=True))
def _(spark, d):
    return ask(spark, d, Pattern("order", (("subj", PERSON),), "loc"))


@register("pattern_ring", match_sql(f"obj = '{THING}'", "subj", ["loc"], predicates="predicate IN ('order', 'return')", exact="CASE WHEN predicate = 'order' THEN 10 ELSE 0 END"))
def _(spark, d):
    return ask(spark, d, Pattern("order", (("obj", THING),), "subj"), rings={"order": ("return",)})


INNER = match_sql(f"subj = '{PERSON}'", "obj", ["loc"], predicates="predicate = 'return'", limit=1)


@register("pattern_subquery", match_sql(f"obj = (SELECT node FROM ({INNER}))", "subj", ["loc"]))
def _(spark, d):
    return ask(spark, d, Pattern("order", (("obj", SubQuery("return", (("subj", PERSON),), "obj")),), "subj"))


@register(
    "identity_vote",
    """SELECT node, value, count(DISTINCT layer) AS layers FROM (SELECT p_name AS node, p_type AS value, 'be' AS layer FROM part
 UNION ALL SELECT p_name, p_type, 'kind' FROM part WHERE p_size >= 25) GROUP BY node, value HAVING count(DISTINCT layer) >= 2""",
)
def _(spark, d):
    part = table(spark, d, "part").select(F.col("p_name").alias("node"), F.col("p_type").alias("value"), "p_size")
    layers = part.select("node", "value", F.lit("be").alias("layer")).unionByName(part.where("p_size >= 25").select("node", "value", F.lit("kind").alias("layer")))
    return matching.identity_vote(layers)


@register(
    "typed_match",
    f"""WITH {PARTS} SELECT node, CAST(sum(weight) AS BIGINT) AS weight FROM p WHERE role = 'obj' AND node IN (SELECT p_name FROM part WHERE p_type = 'ECONOMY' AND p_size = 50) GROUP BY node""",
)
def _(spark, d):
    kinds = table(spark, d, "part").where("p_type = 'ECONOMY' and p_size = 50").select(F.col("p_name").alias("node"))
    return matching.typed_match(parts(spark, d), "obj", kinds).groupBy("node").agg(F.sum("weight").alias("weight"))


@register(
    "existence_latest",
    f"""WITH {RAW} SELECT subj, CASE WHEN arg_max(predicate = 'order', (day, source, predicate = 'order')) THEN 'yes' ELSE 'no' END AS answer, max(day) AS since FROM raw GROUP BY subj""",
)
def _(spark, d):
    rows = star.lines(spark, d).withColumn("positive", F.col("predicate") == "order")
    seen = rows.select("subj", "positive", F.col("day").alias("at"), F.struct("source", "positive").alias("seq"))
    return matching.existence_latest(seen, "subj")


@register("time_filter_keep_undated", f"WITH {RAW} SELECT predicate, count(*) AS n FROM raw WHERE status = 'F' OR (day >= DATE '1998-01-01' AND day < DATE '1999-01-01') GROUP BY predicate")
def _(spark, d):
    rows = star.lines(spark, d).withColumn("day", F.when(F.col("status") != "F", F.col("day")))
    kept = matching.keep_by_time(rows, F.col("day"), F.lit("1998-01-01").cast("date"), F.lit("1999-01-01").cast("date"))
    return kept.groupBy("predicate").agg(F.count("*").alias("n"))


INSIDE = "(SELECT n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA')"


def area(spark: SparkSession, d: str, name: str = "ASIA") -> DataFrame:
    edges = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    closure = matching.containment(edges.select(F.col("n_name").alias("child"), F.col("r_name").alias("parent")))
    return closure.where(F.col("ancestor") == name).select(F.col("child").alias("node"))


@register("place_filter_drop_unlocated", f"WITH {RAW} SELECT predicate, loc, count(*) AS n FROM raw WHERE status <> 'F' AND loc IN {INSIDE} GROUP BY predicate, loc")
def _(spark, d):
    rows = star.lines(spark, d).withColumn("loc", F.when(F.col("status") != "F", F.col("loc")))
    return matching.keep_by_place(rows, F.col("loc"), area(spark, d)).groupBy("predicate", "loc").agg(F.count("*").alias("n"))


@register(
    "place_anchored",
    f"WITH {FACTS} SELECT obj AS node, max(weight) AS weight, min(seq) AS seq FROM f WHERE predicate = 'return' AND loc IN {INSIDE} GROUP BY obj ORDER BY weight DESC, seq, node LIMIT 5",
)
def _(spark, d):
    return matching.place_anchored(graph_facts(spark, d).where("predicate = 'return'"), "obj", area(spark, d))


@register(
    "containment_closure",
    """SELECT n_name AS child, r_name AS ancestor, 1 AS hops FROM nation JOIN region ON n_regionkey = r_regionkey
 UNION ALL SELECT n_name, n_name, 0 FROM nation UNION ALL SELECT r_name, r_name, 0 FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)""",
)
def _(spark, d):
    edges = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return matching.containment(edges.select(F.col("n_name").alias("child"), F.col("r_name").alias("parent")))


@register(
    "reverse_date_lookup",
    f"WITH {RAW} SELECT day, subj, obj, count(*) AS weight FROM raw WHERE month(day) = 7 AND day(day) = 4 GROUP BY ALL ORDER BY weight DESC, day, subj, obj LIMIT 5",
)
def _(spark, d):
    dated = matching.reverse_date(star.lines(spark, d).withColumn("at", F.col("day")), None, 7, 4)
    return dated.groupBy("day", "subj", "obj").agg(F.count("*").alias("weight")).orderBy(F.desc("weight"), "day", "subj", "obj").limit(5)


@register(
    "event_neighbourhood",
    f"""WITH {FACTS}, s AS (SELECT DISTINCT subj FROM f WHERE obj = '{THING}'), x AS (SELECT weight, CASE WHEN obj = '{THING}' THEN 0 ELSE 1 END AS dist FROM f
 WHERE obj = '{THING}' OR subj IN (SELECT subj FROM s)) SELECT dist, count(*) AS n, round(sum(weight * pow(0.4, dist)), 6) AS score FROM x GROUP BY dist""",
)
def _(spark, d):
    found = matching.event_neighbourhood(facts.explode_participants(facts.keyed(graph_facts(spark, d))), THING, 1)
    return found.groupBy("dist").agg(F.count("*").alias("n"), F.round(F.sum("score"), 6).alias("score"))


@register(
    "relation_shared_facts",
    f"WITH {FACTS} SELECT predicate, max(weight) AS weight, min(seq) AS seq FROM f WHERE subj = '{PERSON}' AND obj = '{THING}' GROUP BY predicate, loc ORDER BY weight DESC, seq LIMIT 3",
)
def _(spark, d):
    return matching.shared_facts(graph_facts(spark, d), PERSON, THING).select("predicate", "weight", "seq")


CLASSES = {"purchase": "trade", "signup": "trade", "view": "attention", "click": "attention"}


@register(
    "class_aggregate",
    """WITH c AS (SELECT * FROM (VALUES ('purchase','trade'),('signup','trade'),('view','attention'),('click','attention')) t(predicate, class)),
 e AS (SELECT user_id, class, predicate, json_extract_string(props, '$.k') AS v, min(event_id) AS seq FROM events JOIN c ON event_type = predicate GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY user_id, class, predicate ORDER BY seq, v) AS rn FROM e)
 SELECT user_id, class, predicate, string_agg(v, ', ' ORDER BY rn) AS "values" FROM r WHERE rn <= 4 GROUP BY user_id, class, predicate""",
)
def _(spark, d):
    classes = spark.createDataFrame(list(CLASSES.items()), "predicate string, class string")
    rows = table(spark, d, "events").select("user_id", F.col("event_type").alias("predicate"), F.get_json_object("props", "$.k").alias("v"), F.col("event_id").alias("seq"))
    return matching.class_values(rows, classes, "user_id", "v")


@register("numeric_situation", f"WITH {RAW} SELECT subj, obj, arg_min(num, (source, num)) AS num FROM raw WHERE predicate = 'order' GROUP BY subj, obj")
def _(spark, d):
    return star.lines(spark, d).where("predicate = 'order'").groupBy("subj", "obj").agg(F.min_by("num", F.struct("source", "num")).alias("num"))


@register("empty_topic_carriers", f"WITH {PARTS} SELECT node, CAST(sum(weight) AS BIGINT) AS weight FROM p WHERE predicate = 'return' AND role = 'obj' GROUP BY node ORDER BY weight DESC, node LIMIT 5")
def _(spark, d):
    return matching.carriers(parts(spark, d), "return", "obj")


@register(
    "partial_roles",
    f"""WITH {PARTS} SELECT role, node, CAST(sum(weight) AS BIGINT) AS weight FROM p WHERE predicate = 'order' AND subj = '{PERSON}' AND node <> '{PERSON}' GROUP BY role, node""",
)
def _(spark, d):
    return matching.partial_roles(parts(spark, d), "order", PERSON)


@register("alternatives_temperature", f"WITH {FACTS}, b AS (SELECT obj AS node, max(weight) AS weight FROM f WHERE subj = '{PERSON}' GROUP BY obj) SELECT * FROM b WHERE weight >= (SELECT max(weight) FROM b) * 0.5")
def _(spark, d):
    mine = graph_facts(spark, d).where(facts.node_of(F.col("participants"), "subj") == PERSON)
    return matching.by_temperature(mine.select(facts.node_of(F.col("participants"), "obj").alias("node"), "weight"), 0.5)


@register("neighbour_context", f"WITH {PARTS} SELECT node, max(weight) AS weight FROM p WHERE subj = '{PERSON}' AND node <> '{PERSON}' GROUP BY node ORDER BY weight DESC, node LIMIT 10")
def _(spark, d):
    return matching.neighbour_context(parts(spark, d), PERSON)


# Retrieval

POSTINGS_SQL = f"""d AS (SELECT doc_id, unnest(list_transform({WORD_SQL}, lambda x: lower(x))) AS term FROM documents),
 post AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL), dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
 lens AS (SELECT doc_id, len({WORD_SQL}) AS len FROM documents), corpus AS (SELECT count(*) AS n, avg(len) AS avg_len FROM lens),
 q AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest(list_transform({WORD_SQL}, lambda x: lower(x))) AS term FROM benchmark) GROUP BY ALL)"""
BM25_SQL = f"""{POSTINGS_SQL}, s AS (SELECT item_id, doc_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * len / avg_len))), 6) AS score
 FROM post JOIN q USING (term) JOIN dfs USING (term) JOIN lens USING (doc_id), corpus GROUP BY item_id, doc_id)"""
TFIDF_SQL = f"""{POSTINGS_SQL}, w AS (SELECT doc_id, term, tf * (ln((n + 1) / (df + 1)) + 1) AS w FROM post JOIN dfs USING (term), corpus),
 nd AS (SELECT doc_id, sqrt(sum(w * w)) AS nd FROM w GROUP BY doc_id), wq AS (SELECT item_id, term, qtf * (ln((n + 1) / (df + 1)) + 1) AS qw FROM q JOIN dfs USING (term), corpus),
 nq AS (SELECT item_id, sqrt(sum(qw * qw)) AS nq FROM wq GROUP BY item_id),
 s AS (SELECT item_id, doc_id, round(sum(w * qw) / (any_value(nd) * any_value(nq)), 6) AS score FROM w JOIN wq USING (term) JOIN nd USING (doc_id) JOIN nq USING (item_id) GROUP BY item_id, doc_id)"""
TOP_SQL = " SELECT item_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 5"


def index(spark: SparkSession, d: str) -> retrieval.Index:
    return retrieval.Index(table(spark, d, "documents"), "doc_id", strings.tokens(F.col("text")))


def asked(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.query_terms(table(spark, d, "benchmark"), "item_id", strings.tokens(F.col("text")))


def bm25_scores(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.bm25(index(spark, d), asked(spark, d), "item_id").withColumn("score", F.round("score", 6))


@register("token_counts", f"WITH d AS (SELECT unnest(list_transform({WORD_SQL}, lambda x: lower(x))) AS term FROM documents) SELECT term, count(*) AS n FROM d GROUP BY term")
def _(spark, d):
    return index(spark, d).postings.groupBy("term").agg(F.sum("tf").alias("n"))


@register("doc_freq", f"WITH {POSTINGS_SQL} SELECT term, df FROM dfs")
def _(spark, d):
    return index(spark, d).term_stats


@register("corpus_stats", f"WITH {POSTINGS_SQL} SELECT n, round(avg_len, 6) AS avg_len FROM corpus")
def _(spark, d):
    return index(spark, d).corpus.select("n", F.round("avg_len", 6).alias("avg_len"))


@register("bm25_topk", f"WITH {BM25_SQL}{TOP_SQL}")
def _(spark, d):
    return retrieval.top_k(bm25_scores(spark, d), "item_id", "doc_id").select("item_id", "doc_id", "score", "rank")


@register("tfidf_topk", f"WITH {TFIDF_SQL}{TOP_SQL}")
def _(spark, d):
    scores = retrieval.tfidf(index(spark, d), asked(spark, d), "item_id").withColumn("score", F.round("score", 6))
    return retrieval.top_k(scores, "item_id", "doc_id").select("item_id", "doc_id", "score", "rank")


@register("search_temperature", f"WITH {BM25_SQL}, b AS (SELECT item_id, max(score) AS best FROM s WHERE score > 0 GROUP BY item_id) SELECT item_id, doc_id, score FROM s JOIN b USING (item_id) WHERE score >= best * (1 - 0.25)")
def _(spark, d):
    return retrieval.by_temperature(bm25_scores(spark, d), "item_id", 0.25).select("item_id", "doc_id", "score")


@register("score_all_zero_fill", f"WITH {BM25_SQL} SELECT b.item_id, x.doc_id, coalesce(score, 0.0) AS score FROM benchmark b CROSS JOIN documents x LEFT JOIN s ON s.item_id = b.item_id AND s.doc_id = x.doc_id")
def _(spark, d):
    return retrieval.score_all(table(spark, d, "documents"), "doc_id", bm25_scores(spark, d), table(spark, d, "benchmark"), "item_id").select("item_id", "doc_id", "score")


@register(
    "doc_gate",
    f"""WITH {TFIDF_SQL}, g AS (SELECT item_id, doc_id, round(sum(w / nd), 6) AS score FROM w JOIN nd USING (doc_id) JOIN q USING (term) GROUP BY item_id, doc_id)
 SELECT item_id, doc, score, rank FROM (SELECT item_id, doc_id AS doc, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM g WHERE score > 0) WHERE rank <= 8""",
)
def _(spark, d):
    scored = retrieval.share(index(spark, d), asked(spark, d), "item_id").select("item_id", F.col("doc_id").alias("doc"), F.round("score", 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc"))
    return scored.where("score > 0").withColumn("rank", rank).where("rank <= 8")


LINES_SQL = "ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS place FROM documents)"


def doc_lines(spark: SparkSession, d: str, name: str = "documents", key: str = "doc_id") -> DataFrame:
    return table(spark, d, name).select(key, F.posexplode(F.split("text", "\n", -1)).alias("place", "line"))


@register(
    "chunk_passages",
    """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS u FROM documents), i AS (SELECT doc_id, u, unnest(range(CAST(greatest(ceil((len(u) - 3) / 2.0), 0) AS INT) + 1)) AS idx FROM l)
 SELECT doc_id, CAST(idx AS INT) AS idx, md5(array_to_string(u[idx * 2 + 1 : least(idx * 2 + 3, len(u))], ' ')) AS digest, CAST(idx * 2 AS INT) AS start, CAST(least(idx * 2 + 3, len(u)) AS INT) AS "end" FROM i""",
)
def _(spark, d):
    chunks = texts.chunk(table(spark, d, "documents"), F.split("text", "\n", -1))
    return chunks.select("doc_id", "idx", F.md5("text").alias("digest"), "start", "end")


@register(
    "distance_activation",
    f"""WITH {LINES_SQL}, b AS (SELECT doc_id, place, len(regexp_extract_all(line, '\\bthe\\b')) AS score FROM ln)
 SELECT x.doc_id, CAST(x.place AS INT) AS place, round(sum(y.score * exp(-abs(x.place - y.place) / 1.6)), 6) AS activation FROM b x JOIN b y ON x.doc_id = y.doc_id GROUP BY x.doc_id, x.place""",
)
def _(spark, d):
    scored = doc_lines(spark, d).select("doc_id", "place", F.regexp_count("line", F.lit(r"\bthe\b")).cast("double").alias("score"))
    return retrieval.distance_activation(scored, "doc_id", "place").select("doc_id", "place", F.round("activation", 6).alias("activation"))


@register("focus_windows")
def _(spark, d):
    scored = doc_lines(spark, d).select(F.lit(0).cast("long").alias("query"), "doc_id", "place", F.regexp_count("line", F.lit(r"\bthe\b")).cast("double").alias("score"))
    active = retrieval.distance_activation(scored, "doc_id", "place", 1.6, 40, "query")
    return retrieval.focus_windows(active, "query", "doc_id", "place")


@register(
    "extractive_best",
    f"""WITH {BM25_SQL}, t AS ({TOP_SQL}), {LINES_SQL}, qs AS (SELECT item_id, list(DISTINCT term) AS terms FROM q GROUP BY item_id),
 c AS (SELECT item_id, rank, place, list_transform(regexp_extract_all(line, '[\\p{{L}}\\p{{N}}_]+'), lambda x: lower(x)) AS words FROM t JOIN ln USING (doc_id)),
 o AS (SELECT item_id, rank, place, len(list_filter(words, lambda x: list_contains(terms, x))) AS overlap, len(words) AS n FROM c JOIN qs USING (item_id))
 SELECT item_id, rank, CAST(place AS INT) AS place, score FROM (SELECT *, round(overlap / sqrt(n), 6) AS score, row_number() OVER (PARTITION BY item_id ORDER BY round(overlap / sqrt(n), 6) DESC, rank, place) AS rn
 FROM o WHERE overlap > 0) WHERE rn = 1""",
)
def _(spark, d):
    top = retrieval.top_k(bm25_scores(spark, d), "item_id", "doc_id").select("item_id", "doc_id", F.col("rank").alias("doc_rank"))
    questions = table(spark, d, "benchmark").select("item_id", strings.tokens(F.col("text")).alias("question"))
    rows = top.join(doc_lines(spark, d), "doc_id").join(questions, "item_id").withColumn("words", strings.tokens(F.col("line")))
    overlap = F.size(F.filter("words", lambda x: F.array_contains(F.col("question"), x)))
    scored = rows.withColumn("overlap", overlap).where("overlap > 0").withColumn("score", F.round(F.col("overlap") / F.sqrt(F.size("words")), 6))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_rank", "place"))
    return scored.withColumn("rn", rank).where("rn = 1").select("item_id", F.col("doc_rank").alias("rank"), "place", "score")


# Votes


def line_tokens(spark: SparkSession, d: str) -> DataFrame:
    words = F.posexplode(F.regexp_extract_all("line", F.lit(strings.WORD), F.lit(0))).alias("pos", "form")
    return doc_lines(spark, d).select("doc_id", F.col("place").alias("sent_idx"), words)


LINE_TOKENS_SQL = LINES_SQL + r""", lt AS (SELECT doc_id, place, unnest(regexp_extract_all(line, '[\p{L}\p{N}_]+')) AS form, unnest(range(len(regexp_extract_all(line, '[\p{L}\p{N}_]+')))) AS pos FROM ln)"""
LETTER, SMALL = r"regexp_matches(form, '^\p{L}')", r"regexp_matches(form, '^\p{Ll}')"


@register("case_votes", f"WITH {LINE_TOKENS_SQL} SELECT lower(form) AS word, count(*) FILTER ({SMALL}) AS lower, count(*) FILTER (NOT {SMALL}) AS upper FROM lt WHERE {LETTER} GROUP BY lower(form)")
def _(spark, d):
    return evidence.case_votes(line_tokens(spark, d))


@register(
    "position_votes",
    f"""WITH {LINE_TOKENS_SQL}, w AS (SELECT *, lag(form) OVER (PARTITION BY doc_id, place ORDER BY pos) AS before FROM lt)
 SELECT lower(form) AS word, count(*) FILTER (NOT {SMALL} AND coalesce(regexp_matches(before, '^\\p{{L}}'), false)) AS mid, count(*) FILTER ({SMALL}) AS lower FROM w WHERE {LETTER} GROUP BY lower(form)""",
)
def _(spark, d):
    return evidence.position_votes(line_tokens(spark, d))


@register(
    "dominant_form",
    f"""WITH {LINE_TOKENS_SQL}, v AS (SELECT lower(form) AS key, form AS value, count(*) AS n FROM lt GROUP BY ALL),
 t AS (SELECT key, arg_max(value, (n, value)) AS value, max(n) AS best, CAST(sum(n) AS BIGINT) AS total FROM v GROUP BY key) SELECT * FROM t WHERE total >= 3 AND best / total >= 0.8""",
)
def _(spark, d):
    counted = evidence.votes(line_tokens(spark, d), F.lower("form"), F.col("form"))
    return evidence.dominant(counted)


@register(
    "scrub_anti_join",
    f"""WITH {FACTS}, doomed AS (SELECT p_name FROM part GROUP BY p_name HAVING count(*) >= 3 AND count(*) FILTER (p_type IN ('ECONOMY', 'SMALL')) / count(*) >= 0.35),
 x AS (SELECT predicate, subj, CASE WHEN obj IN (SELECT p_name FROM doomed) THEN NULL ELSE obj END AS obj, loc, weight FROM f)
 SELECT predicate, subj, obj, loc, CAST(sum(weight) AS BIGINT) AS weight FROM x GROUP BY predicate, subj, obj, loc""",
)
def _(spark, d):
    counted = evidence.votes(table(spark, d, "part"), F.col("p_name"), F.col("p_type"))
    doomed = evidence.dominated_by(counted, ["ECONOMY", "SMALL"], 3, 0.35).select(F.col("key").alias("node"))
    return flat(evidence.drop_participants(graph_facts(spark, d), doomed, ["obj"]))


# Strings and dates


@register("accent_fold", f"WITH {TOKENS_SQL} SELECT w, strip_accents(lower(w)) AS folded FROM tok")
def _(spark, d):
    return token_forms(spark, d).select("w", strings.fold_accents(F.col("w")).alias("folded"))


@register("word_stems", f"WITH {TOKENS_SQL}, c AS (SELECT w, {CUT_SQL} AS s FROM tok) SELECT w, {STEM_SQL} AS stem FROM c")
def _(spark, d):
    return token_forms(spark, d).select("w", strings.stem(F.col("w")).alias("stem"))


@register(
    "lemma_clean",
    """WITH t AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS w FROM documents), a AS (SELECT w, CASE WHEN instr(w, '-') > 1 THEN left(w, instr(w, '-') - 1) ELSE w END AS x FROM t),
 b AS (SELECT w, CASE WHEN instr(x, '_') > 1 THEN left(x, instr(x, '_') - 1) ELSE x END AS x FROM a), c AS (SELECT w, CASE WHEN instr(x, '`') > 1 THEN left(x, instr(x, '`') - 1) ELSE x END AS x FROM b)
 SELECT w, trim(x, '„“”‚’''"»«›‹') AS lemma FROM c""",
)
def _(spark, d):
    raw = table(spark, d, "documents").select(F.explode(F.split("text", " ", -1)).alias("w")).distinct()
    return raw.select("w", strings.clean_lemma(F.col("w")).alias("lemma"))


@register(
    "word_classes",
    f"""WITH {TOKENS_SQL} SELECT w, CASE WHEN regexp_matches(w, '(ová|á|a)$') THEN 'Fem' ELSE 'Masc' END AS name_gender, CASE WHEN lower(w) LIKE '%la' THEN 'Fem' WHEN lower(w) LIKE '%l' THEN 'Masc' END AS verb_gender,
 CASE WHEN rtrim(lower(w), 'aioy') LIKE '%l' AND length(rtrim(lower(w), 'aioy')) >= 3 THEN rtrim(lower(w), 'aioy') END AS participle, regexp_matches(w, '^\\p{{Lu}}') AND length(w) >= 2 AND regexp_matches(replace(w, '.', ''), '^[\\p{{L}}\\p{{N}}]+$') AS title_like,
 left(sha1(w), 12) AS template_id FROM tok""",
)
def _(spark, d):
    w = F.col("w")
    return token_forms(spark, d).select("w", strings.name_gender(w).alias("name_gender"), strings.verb_gender(w).alias("verb_gender"), strings.participle_stem(w).alias("participle"), strings.title_like(w).alias("title_like"), strings.template_id(w).alias("template_id"))


MONTH_LIST = "[" + ", ".join(f"'{x}'" for x in fixed.MONTHS) + "]"
NOMINATIVES = "[" + ", ".join(f"'{x}'" for x in fixed.MONTHS.values()) + "]"


@register(
    "date_decomposition",
    f"""WITH o AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS x FROM orders), l AS (SELECT x, day(x) || '. ' || {MONTH_LIST}[month(x)] || ' ' || year(x) AS node FROM o)
 SELECT node, 'year' AS part, CAST(year(x) AS VARCHAR) AS value FROM l UNION ALL SELECT node, 'month', {NOMINATIVES}[month(x)] FROM l UNION ALL SELECT node, 'day', CAST(day(x) AS VARCHAR) FROM l""",
)
def _(spark, d):
    day = F.col("o_orderdate").cast("date")
    month = F.element_at(F.array(*(F.lit(x) for x in fixed.MONTHS)), F.month(day))
    label = F.concat(F.dayofmonth(day).cast("string"), F.lit(". "), month, F.lit(" "), F.year(day).cast("string"))
    nodes = table(spark, d, "orders").select(label.alias("node")).distinct().withColumn("type", F.lit("time"))
    return facts.date_facts(nodes)


@register(
    "interval_overlap",
    """WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE year(o_orderdate) END AS y, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE month(o_orderdate) END AS m,
 CASE WHEN o_orderkey % 15 = 0 OR o_orderkey % 5 = 0 OR o_orderkey % 3 = 0 THEN NULL ELSE day(o_orderdate) END AS dd FROM orders),
 i AS (SELECT o_orderkey, make_date(y, coalesce(m, 1), coalesce(dd, 1)) AS lo, CASE WHEN m IS NULL THEN INTERVAL 1 YEAR WHEN dd IS NULL THEN INTERVAL 1 MONTH ELSE INTERVAL 1 DAY END AS w FROM o)
 SELECT o_orderkey, coalesce(lo < TIMESTAMP '1997-05-10' AND TIMESTAMP '1997-03-15' < lo + w, false) AS hit FROM i""",
)
def _(spark, d):
    key, at = F.col("o_orderkey"), F.col("o_orderdate")
    year, month = F.when(key % 7 != 0, F.year(at)), F.when(key % 5 != 0, F.month(at))
    day = F.when((key % 5 != 0) & (key % 3 != 0), F.dayofmonth(at))
    start, end = F.lit("1997-03-15").cast("timestamp_ntz"), F.lit("1997-05-10").cast("timestamp_ntz")
    return table(spark, d, "orders").select("o_orderkey", temporal.overlaps(start, end, year, month, day).alias("hit"))


@register(
    "floor_and_shift",
    "SELECT event_id, date_trunc('week', ts)::TIMESTAMP AS week, date_trunc('month', ts)::TIMESTAMP AS month, ts + INTERVAL 1 MONTH AS next_month, ts + INTERVAL 90 MINUTE AS later FROM events",
)
def _(spark, d):
    ts = F.col("ts")
    return table(spark, d, "events").select("event_id", temporal.floor(ts, "week").alias("week"), temporal.floor(ts, "month").alias("month"), temporal.shift(ts, "month", 1).alias("next_month"), temporal.shift(ts, "minute", 90).alias("later"))


# Activation


@register(
    "activation_decay",
    """WITH e AS (SELECT user_id, event_type, date_diff('day', TIMESTAMP '2024-01-01', date_trunc('day', ts)) AS step, CAST(1.0 AS DOUBLE) AS amount FROM events), l AS (SELECT user_id, max(step) AS last FROM e GROUP BY user_id)
 SELECT user_id, event_type, round(sum(amount * pow(CAST(0.55 AS DOUBLE), last + 1 - step)), 6) AS score FROM e JOIN l USING (user_id) GROUP BY user_id, event_type HAVING round(sum(amount * pow(CAST(0.55 AS DOUBLE), last + 1 - step)), 6) > 0""",
)
def _(spark, d):
    step = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    warmed = table(spark, d, "events").select("user_id", "event_type", step.alias("step"), F.lit(1.0).alias("amount"))
    field = activation.decayed(warmed, "user_id", "event_type", "step", "amount", 0.55, 0.0)
    return field.select("user_id", "event_type", F.round("score", 6).alias("score")).where("score > 0")


@register(
    "activation_with_floor",
    r"""WITH w AS (SELECT conv_id, turn, unnest(list_distinct(list_transform(regexp_extract_all(text, '[\p{L}\p{N}_]+'), lambda x: lower(x)))) AS word FROM conversations), s AS (SELECT conv_id, word, turn, CAST(count(*) AS DOUBLE) AS amount FROM w GROUP BY ALL),
 l AS (SELECT conv_id, max(turn) AS last FROM w GROUP BY conv_id), g AS (SELECT conv_id, word, turn, amount, coalesce(lead(turn) OVER (PARTITION BY conv_id, word ORDER BY turn), last + 1) - turn AS gap FROM s JOIN l USING (conv_id)),
 f AS (SELECT conv_id, word, list_reduce(list_concat([{'a': CAST(0 AS DOUBLE), 'g': CAST(0 AS BIGINT)}], list({'a': amount, 'g': CAST(gap AS BIGINT)} ORDER BY turn)), lambda x, y: {'a': CASE WHEN (x.a + y.a) * pow(0.8, y.g) > 0.001 THEN (x.a + y.a) * pow(0.8, y.g) ELSE CAST(0 AS DOUBLE) END, 'g': CAST(0 AS BIGINT)}).a AS score FROM g GROUP BY conv_id, word),
 r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, word) AS rank FROM f WHERE score > 0)
 SELECT conv_id, word, round(score, 6) AS score, rank FROM r WHERE rank <= 12""",
)
def _(spark, d):
    warmed = table(spark, d, "conversations").select("conv_id", "turn", F.explode(F.array_distinct(strings.tokens(F.col("text")))).alias("word")).withColumn("amount", F.lit(1.0))
    return activation.ranked(activation.decayed(warmed, "conv_id", "word", "turn", "amount", 0.8, 1e-3), "conv_id", "word", 12).withColumn("score", F.round("score", 6))


@register(
    "spread_two_hops",
    f"""WITH {FACTS}, e AS (SELECT node, near, max(weight) AS weight FROM (SELECT subj AS node, obj AS near, weight FROM f UNION ALL SELECT obj, subj, weight FROM f UNION ALL SELECT subj, loc, weight FROM f
 UNION ALL SELECT loc, subj, weight FROM f UNION ALL SELECT obj, loc, weight FROM f UNION ALL SELECT loc, obj, weight FROM f) GROUP BY node, near),
 r AS (SELECT node, near, row_number() OVER (PARTITION BY node ORDER BY weight DESC, near) AS rn FROM e), one AS (SELECT near AS node, CAST(0.6 AS DOUBLE) * 0.35 AS heat FROM r WHERE node = '{THING}' AND rn <= 8),
 two AS (SELECT near AS node, heat * 0.35 AS heat FROM r JOIN one USING (node) WHERE rn <= 8)
 SELECT node, round(sum(heat), 6) AS heat FROM (SELECT * FROM one UNION ALL SELECT * FROM two) GROUP BY node""",
)
def _(spark, d):
    heat = activation.spread_held(settle(graph_facts(spark, d).select("participants", "weight"), "facts"), [THING])
    return heat.select("node", F.round("heat", 6).alias("heat"))


@register(
    "conductance_cooccurrence",
    f"""WITH t AS (SELECT item_id AS sent, unnest(list_transform({WORD_SQL}, lambda x: lower(x))) AS word, unnest(range(len({WORD_SQL}))) AS pos FROM benchmark),
 n AS (SELECT count(*) AS n FROM benchmark), i AS (SELECT word, ln(any_value(n) / count(DISTINCT sent)) + 1 AS idf FROM t, n GROUP BY word), w AS (SELECT * FROM t JOIN i USING (word)),
 x AS (SELECT a.word AS a, b.word AS b, a.idf * b.idf * exp(-(b.pos - a.pos - 1) / 2.0) AS w FROM w a JOIN w b ON a.sent = b.sent AND b.pos > a.pos AND b.pos <= a.pos + 5)
 SELECT a, b, round(sum(w), 6) AS weight FROM (SELECT a, b, w FROM x UNION ALL SELECT b, a, w FROM x) GROUP BY a, b""",
)
def _(spark, d):
    items = table(spark, d, "benchmark")
    tokens = items.select(F.col("item_id").alias("sent"), F.posexplode(strings.tokens(F.col("text"))).alias("pos", "word"))
    n = F.broadcast(items.agg(F.count("*").alias("n")))
    idf = tokens.groupBy("word").agg(F.count_distinct("sent").alias("df")).crossJoin(n).select("word", (F.log(F.col("n") / F.col("df")) + 1).alias("idf"))
    return activation.conductance(tokens, idf).select("a", "b", F.round("weight", 6).alias("weight"))


# The predicate-and-role engine


@register(
    "pure_frequent_frames",
    f"""WITH {LINE_TOKENS_SQL}, s AS (SELECT doc_id, place, pos, CAST(length(form) AS VARCHAR) AS slot, CASE WHEN {SMALL} THEN 'low' ELSE 'up' END AS role FROM lt),
 w AS (SELECT role, concat_ws('·', lag(slot, 2) OVER x, lag(slot) OVER x, slot, lead(slot) OVER x, lead(slot, 2) OVER x) AS frame FROM s WINDOW x AS (PARTITION BY doc_id, place ORDER BY pos))
 SELECT frame, min(role) AS role, count(*) AS n FROM w GROUP BY frame HAVING count(DISTINCT role) = 1 AND count(*) >= 3""",
)
def _(spark, d):
    tokens = line_tokens(spark, d).withColumn("slot", F.length("form").cast("string")).withColumn("role", F.when(F.col("form").rlike(r"^\p{Ll}"), "low").otherwise("up"))
    window = Window.partitionBy("doc_id", "sent_idx").orderBy("pos")
    return roles.confirmed(tokens.select("role", roles.frame_signature(F.col("slot"), window).alias("frame")))


@register(
    "template_jaccard",
    f"""WITH a AS (SELECT item_id AS query, list_distinct(list_transform({WORD_SQL}, lambda x: lower(x))) AS s FROM benchmark),
 t AS (SELECT conv_id * 1000 + turn AS template, list_distinct(list_transform({WORD_SQL}, lambda x: lower(x))) AS s FROM conversations),
 j AS (SELECT query, template, len(list_intersect(a.s, t.s)) / (len(a.s) + len(t.s) - len(list_intersect(a.s, t.s))) AS score FROM a, t WHERE len(list_intersect(a.s, t.s)) > 0)
 SELECT query, template, round(score, 6) AS score FROM j WHERE score >= 0.15""",
)
def _(spark, d):
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query"), strings.tokens(F.col("text")).alias("slots"))
    turns = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("template"), strings.tokens(F.col("text")).alias("slots"))
    return roles.template_match(items, turns, 0.15).select("query", "template", F.round("score", 6).alias("score"))


@register(
    "route_docs",
    f"""WITH {RAW}, h AS (SELECT DISTINCT loc AS doc, source AS sent, subj AS lemma FROM raw WHERE predicate = 'order' AND subj IN ('{PERSON}', 'Customer#000000002')),
 r AS (SELECT doc, count(*) AS refs FROM (SELECT DISTINCT doc, sent FROM h ORDER BY doc, sent LIMIT 24) GROUP BY doc)
 SELECT doc, (SELECT count(DISTINCT lemma) FROM h WHERE h.doc = r.doc) AS terms, refs FROM r ORDER BY terms DESC, refs DESC, doc LIMIT 4""",
)
def _(spark, d):
    rows = star.lines(spark, d).select(F.col("loc").alias("doc"), F.col("source").alias("sent"), "predicate", F.explode(F.array(F.struct(F.lit("subj").alias("role"), F.col("subj").alias("lemma")), F.struct(F.lit("obj").alias("role"), F.col("obj").alias("lemma")))).alias("x"))
    return roles.route_docs(rows.select("doc", "sent", "predicate", "x.role", "x.lemma"), "order", "obj", [PERSON, "Customer#000000002"])


@register(
    "rank_assurance",
    """WITH c AS (SELECT p_type, p_name AS value, max(p_size) AS size, max(p_retailprice) AS heat FROM part GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY size DESC, heat DESC, value) AS rn FROM c)
 SELECT a.p_type, a.value, CASE WHEN b.value IS NULL OR a.size > b.size OR a.heat > 2 * b.heat THEN 'answer' ELSE 'clarify' END AS verdict FROM r a LEFT JOIN r b ON a.p_type = b.p_type AND b.rn = 2 WHERE a.rn = 1""",
)
def _(spark, d):
    rows = table(spark, d, "part").groupBy("p_type", F.col("p_name").alias("value")).agg(F.max("p_size").alias("size"), F.max("p_retailprice").alias("heat"))
    return roles.rank_candidates(rows, "p_type", ["size"], "heat")


@register(
    "polar_cooccurrence",
    f"""WITH {RAW}, c AS (SELECT DISTINCT loc AS a, brand AS b FROM raw WHERE predicate = 'return'), n AS (SELECT DISTINCT n_name AS a FROM nation), b AS (SELECT DISTINCT p_brand AS b FROM part)
 SELECT n.a, b.b, CASE WHEN c.a IS NOT NULL THEN 'yes' END AS answer FROM n CROSS JOIN b LEFT JOIN c ON c.a = n.a AND c.b = b.b""",
)
def _(spark, d):
    pairs = table(spark, d, "nation").select(F.col("n_name").alias("a")).distinct().crossJoin(table(spark, d, "part").select(F.col("p_brand").alias("b")).distinct())
    return roles.polar(pairs, star.lines(spark, d).where("predicate = 'return'").select(F.col("loc").alias("a"), F.col("brand").alias("b")))


@register("zone_profile", f"WITH {RAW} SELECT obj, loc, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY obj), 6) AS share FROM raw GROUP BY obj, loc")
def _(spark, d):
    return roles.zone_profile(star.lines(spark, d), "obj", "loc").withColumn("share", F.round("share", 6))


@register(
    "mount_union_cap",
    """WITH c AS (SELECT user_id, event_type AS doc, count(*) AS n, max(event_id) AS newest FROM events GROUP BY ALL), a AS (SELECT user_id, doc, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, doc) AS rank FROM c),
 b AS (SELECT user_id, doc, row_number() OVER (PARTITION BY user_id ORDER BY newest DESC) AS rank FROM c), x AS (SELECT user_id, doc, 0 AS part, rank FROM a WHERE rank <= 2 UNION ALL SELECT user_id, doc, 1, rank FROM b WHERE rank <= 3),
 m AS (SELECT user_id, doc, min(part * 100 + rank) AS spot FROM x GROUP BY ALL), p AS (SELECT user_id, doc, row_number() OVER (PARTITION BY user_id ORDER BY spot, doc) AS place FROM m),
 k AS (SELECT user_id, greatest(count(*) FILTER (part = 0), count(*) FILTER (part = 1)) AS cap FROM x GROUP BY user_id) SELECT user_id, doc, place FROM p JOIN k USING (user_id) WHERE place <= cap""",
)
def _(spark, d):
    counted = table(spark, d, "events").groupBy("user_id", F.col("event_type").alias("doc")).agg(F.count("*").alias("n"), F.max("event_id").alias("newest"))
    by = lambda *order: F.row_number().over(Window.partitionBy("user_id").orderBy(*order))
    routed = counted.withColumn("rank", by(F.desc("n"), "doc")).where("rank <= 2")
    lexical = counted.withColumn("rank", by(F.desc("newest"))).where("rank <= 3")
    return roles.compose_mount(routed, lexical, "user_id", "union_cap")


@register("gate_logistic", "SELECT vec_id, round(1 / (1 + exp(-(0.1 + (embedding[1]::DOUBLE - 0.02) / 0.5 * 0.7 + (embedding[2]::DOUBLE + 0.01) / 0.4 * -0.3))), 6) AS p FROM embeddings")
def _(spark, d):
    p = roles.logistic([F.col("embedding")[0].cast("double"), F.col("embedding")[1].cast("double")], [0.02, -0.01], [0.5, 0.4], [0.7, -0.3], 0.1)
    return table(spark, d, "embeddings").select("vec_id", F.round(p, 6).alias("p"))


@register("train_split", "SELECT doc_id, CASE WHEN h < 80 THEN 'train' WHEN h < 90 THEN 'dev' ELSE 'test' END AS split FROM (SELECT doc_id, ('0x' || left(sha256(source || ':' || doc_id), 16))::UBIGINT % 100 AS h FROM documents)")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", strings.split_for(F.concat("source", F.lit(":"), F.col("doc_id").cast("string"))).alias("split"))


# Dialog and memory


@register(
    "triage_clusters",
    """WITH r AS (SELECT event_id AS seq, CASE WHEN event_type = 'error' THEN 'error' ELSE 'answer' END AS kind, event_type AS patterns, value / 100 AS assurance, CAST(event_id AS VARCHAR) AS q FROM events),
 m AS (SELECT *, row_number() OVER (PARTITION BY kind, patterns ORDER BY seq) AS rn FROM r WHERE kind <> 'answer' OR coalesce(assurance, 1.0) < 0.5)
 SELECT kind, patterns, count(*) AS count, string_agg(CASE WHEN rn <= 3 THEN q END, '|' ORDER BY rn) AS examples FROM m GROUP BY kind, patterns""",
)
def _(spark, d):
    e = table(spark, d, "events")
    rows = e.select(F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "error").otherwise("answer").alias("kind"), F.col("event_type").alias("patterns"), (F.col("value") / 100).alias("assurance"), F.col("event_id").cast("string").alias("q"))
    return dialog.triage(rows).withColumn("examples", F.array_join("examples", "|"))


CARDS = [
    ("any-view", "view", 1, [], [], None, None), ("cheap-view", "view", 1, ["cheap"], [], None, None), ("cheap-calm-view", "view", 0, ["cheap"], ["even"], None, None),
    ("low-click", "click", 5, [], [], 0.2, None), ("click", "click", 9, [], [], None, None), ("many-purchase", "purchase", 2, [], [], None, 50), ("purchase", "purchase", 2, [], ["cheap"], None, None),
]


@register(
    "card_best_specificity",
    """WITH t AS (SELECT event_id, event_type, value < 20 AS cheap, event_id % 2 = 0 AS even, value / 100 AS sure, user_id AS candidates FROM events),
 c AS (SELECT event_id, 'any-view' AS name, 1 AS pr, 0 AS sp FROM t WHERE event_type = 'view' UNION ALL SELECT event_id, 'cheap-view', 1, 1 FROM t WHERE event_type = 'view' AND cheap
 UNION ALL SELECT event_id, 'cheap-calm-view', 0, 2 FROM t WHERE event_type = 'view' AND cheap AND NOT even UNION ALL SELECT event_id, 'low-click', 5, 1 FROM t WHERE event_type = 'click' AND sure < 0.2
 UNION ALL SELECT event_id, 'click', 9, 0 FROM t WHERE event_type = 'click' UNION ALL SELECT event_id, 'many-purchase', 2, 1 FROM t WHERE event_type = 'purchase' AND candidates >= 50
 UNION ALL SELECT event_id, 'purchase', 2, 1 FROM t WHERE event_type = 'purchase' AND NOT cheap),
 r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY sp DESC, pr DESC, name) AS rn FROM c) SELECT event_id, name, sp AS specificity FROM r WHERE rn = 1""",
)
def _(spark, d):
    cards = spark.createDataFrame(CARDS, dialog.CARD)
    features = F.array_compact(F.array(F.when(F.col("value") < 20, F.lit("cheap")), F.when(F.col("event_id") % 2 == 0, F.lit("even"))))
    turns = table(spark, d, "events").select("event_id", F.col("event_type").alias("event"), features.alias("features"), (F.col("value") / 100).alias("assurance"), F.col("user_id").alias("candidates"))
    return dialog.best_card(cards, turns, "event_id")


@register("assurance_score", "SELECT event_id, round(least(greatest(value / 100 / (event_id % 4 + 1) + 0.3 * least(greatest(value / 50, 0.0), 1.0), 0.0), 1.0), 6) AS assurance FROM events")
def _(spark, d):
    score = dialog.assurance(F.col("value") / 100, F.col("event_id") % 4, F.col("value") / 50)
    return table(spark, d, "events").select("event_id", F.round(score, 6).alias("assurance"))


@register("memory_forget_interval", "SELECT user_id, count(*) AS kept FROM events WHERE NOT (ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-05') GROUP BY user_id")
def _(spark, d):
    start, end = F.lit("2024-01-02").cast("timestamp_ntz"), F.lit("2024-01-05").cast("timestamp_ntz")
    return memory.forget_interval(table(spark, d, "events"), F.col("ts"), start, end).groupBy("user_id").agg(F.count("*").alias("kept"))


@register("memory_recall", "SELECT DISTINCT user_id AS user, event_type || ' ' || CAST(CAST(ts AS DATE) AS VARCHAR) AS label FROM events WHERE ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-05'")
def _(spark, d):
    label = F.concat("event_type", F.lit(" "), F.col("ts").cast("date").cast("string"))
    return memory.recall(table(spark, d, "events"), F.col("user_id"), label, F.col("ts"), F.lit("2024-01-02").cast("timestamp_ntz"), F.lit("2024-01-05").cast("timestamp_ntz"))


@register("reminders_due", "SELECT event_type, count(*) FILTER (ts <= TIMESTAMP '2024-01-04') AS fired, count(*) FILTER (ts > TIMESTAMP '2024-01-04') AS kept FROM events GROUP BY event_type")
def _(spark, d):
    fired, kept = memory.due(table(spark, d, "events").withColumn("due", F.col("ts")), F.lit("2024-01-04").cast("timestamp_ntz"))
    both = fired.select("event_type", F.lit(1).alias("f"), F.lit(0).alias("k")).unionByName(kept.select("event_type", F.lit(0).alias("f"), F.lit(1).alias("k")))
    return both.groupBy("event_type").agg(F.sum("f").alias("fired"), F.sum("k").alias("kept"))


@register(
    "coverage_buckets",
    f"WITH {LINES_SQL} SELECT CASE WHEN trim(line) = '' THEN 'empty' WHEN len(string_split(line, ' ')) < 5 THEN 'short' WHEN len(string_split(line, ' ')) > 40 THEN 'long' ELSE 'covered' END AS bucket, count(*) AS n FROM ln GROUP BY bucket",
)
def _(spark, d):
    words = F.size(F.split("line", " ", -1))
    bucket = F.when(F.trim("line") == "", "empty").when(words < 5, "short").when(words > 40, "long").otherwise("covered")
    return doc_lines(spark, d).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


ABBREVIATED = "|".join(fixed.ABBREVIATIONS)
#: Marks that end no sentence become another character: twice, as neighbours share what stands between them.
SPARED = r"regexp_replace({x}, '(^|[^\p{{L}}\p{{N}}])((?i:" + ABBREVIATED + r"))[.!?…]', '\1\2' || chr(2), 'g')"
NUMBERED = r"regexp_replace({x}, '(^|[^\p{{L}}\p{{N}}])(\p{{Nd}}{{1,18}})[.!?…](\s+\p{{Ll}})', '\1\2' || chr(2) || '\3', 'g')"


@register(
    "sentence_counts",
    rf"""WITH a AS (SELECT doc_id, {SPARED.format(x=SPARED.format(x="text"))} AS t FROM documents), b AS (SELECT doc_id, {NUMBERED.format(x=NUMBERED.format(x="t"))} AS t FROM a),
 s AS (SELECT doc_id, unnest(string_split(regexp_replace(t, '([.!?…])\s+', '\1' || chr(1), 'g'), chr(1))) AS x FROM b), r AS (SELECT doc_id, regexp_replace(x, '^\s+|\s+$', '', 'g') AS x FROM s)
 SELECT doc_id, count(*) AS sentences, CAST(sum(length(x)) AS BIGINT) AS chars FROM r WHERE x <> '' GROUP BY doc_id""".replace("\\\\", "\\"),
)
def _(spark, d):
    return texts.explode_sentences(table(spark, d, "documents")).groupBy("doc_id").agg(F.count("*").alias("sentences"), F.sum(F.length("text")).alias("chars"))


HEADINGS_SQL = ", ".join(f"'{x}'" for x in fixed.REFERENCE_HEADINGS)


@register(
    "clean_documents",
    f"""WITH a AS (SELECT doc_id, replace(replace(regexp_replace(regexp_replace(text, '{fixed.ENVELOPE_START}', ''), '{fixed.ENVELOPE_END}', ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t FROM documents),
 l AS (SELECT doc_id, string_split(t, chr(10)) AS ls FROM a),
 c AS (SELECT doc_id, ls, list_position(list_transform(ls, lambda x: regexp_matches(x, '{fixed.HEADING}') AND list_contains([{HEADINGS_SQL}], lower(trim(regexp_extract(x, '{fixed.HEADING}', 1))))), true) AS f FROM l),
 k AS (SELECT doc_id, regexp_replace(array_to_string(list_filter(CASE WHEN f > 0 THEN ls[:f - 1] ELSE ls END, lambda x: NOT regexp_matches(x, '{fixed.HEADING}')), chr(10)), '{fixed.DATE_RANGE}', '', 'g') AS t FROM c)
 SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '[ \\t]+', ' ', 'g'), ' *\\n *', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')) AS digest FROM k""",
)
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(texts.clean_text(F.col("text"))).alias("digest"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who ordered the thing most: a pattern with a hole over the fact graph."""
    return QUERIES["pattern_hole_subj"](spark, sf_dir)

