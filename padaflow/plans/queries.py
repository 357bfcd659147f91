"""Queries over the driver's tables, one or more for each operator, and their SQL.

The documents hold no domain text, so the lexicon of these queries is derived from the data: the long words
of the benchmark passages.  They run over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from padaflow.functions import columns as C
from padaflow.functions import script
from padaflow.operators import analytics, evaluate, export, importer, mine, relational
from padaflow.plans import compiled
from padaflow.plans.engine import Engine
from padaflow.sources import lexicon as source

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
LONG = 10


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


# ------------------------------------------------------------------ SQL parts
TOKEN_SQL = script.TOKEN.replace("'", "''")
WORDS = lambda c: f"list_filter(list_transform(regexp_extract_all({c}, '{TOKEN_SQL}'), lambda x: trim(x, '''')), lambda x: x != '')"


def fold_sql(c: str, loose: bool = False, drop: bool = True) -> str:
    """The fold in SQL without lookahead or back references."""
    out = f"lower({c})"
    quote = lambda x: x.replace("'", "''")
    each = lambda out, table: [out := f"replace({out}, '{quote(a)}', '{quote(b)}')" for a, b in table][-1]
    out = f"regexp_replace(strip_accents({each(out, script.IAST)}), '[^a-zM]', '', 'g')"
    out = each(out, script.CASUAL)
    for a, b in (("[Mmn]+([b-df-hj-lp-tv-z])", r"n\1"), ("[Mmn]+m", "nm"), ("[Mmn]+n", "n")):
        out = f"regexp_replace({out}, '{a}', '{b}', 'g')"
    out = f"replace({out}, 'M', 'm')"
    out = each(out, script.LOOSE) if loose else out
    for x in "abcdefghijklmnopqrstuvwxyz":
        out = f"regexp_replace({out}, '{x}+', '{x}', 'g')"
    return schwa_sql(out) if drop else out


def schwa_sql(c: str) -> str:
    return f"regexp_replace({c}, '^(.+[^aeiou])a$', '\\1')"


TOKENS = f"tok AS (SELECT doc_id, unnest(w) AS token, CAST(generate_subscripts(w, 1) - 1 AS INTEGER) AS pos FROM (SELECT doc_id, {WORDS('text')} AS w FROM documents))"
DISTINCT = "dis AS (SELECT DISTINCT token FROM tok)"
KEYS = f"keys AS MATERIALIZED (SELECT token, {fold_sql('token')} AS key FROM dis)"
KEYED = f"{TOKENS}, {DISTINCT}, {KEYS}, kt AS MATERIALIZED (SELECT doc_id, pos, token, key FROM tok JOIN keys USING (token))"
TERMS = f"lex0 AS (SELECT DISTINCT token AS term FROM (SELECT unnest({WORDS('text')}) AS token FROM benchmark) WHERE length(token) >= {LONG})"
LABEL = "CASE WHEN substr(lower(term), 1, 1) < 'i' THEN 'FIRST' WHEN substr(lower(term), 1, 1) < 'r' THEN 'MIDDLE' ELSE 'LAST' END"
LEX = f"{TERMS}, lex AS MATERIALIZED (SELECT min(term) AS entry, key, min({LABEL}) AS label FROM (SELECT term, {fold_sql('term')} AS key FROM lex0) GROUP BY key)"
HITS = f"{KEYED}, {LEX}, named0 AS MATERIALIZED (SELECT token, key, entry, label FROM keys JOIN lex USING (key)), hits AS MATERIALIZED (SELECT doc_id, pos, token, key, entry, label FROM tok JOIN named0 USING (token))"


# ------------------------------------------------------- the same in Spark
def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.token_table(docs(spark, sf_dir))


def distinct_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens(spark, sf_dir).select("token").distinct()


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entry, key, label of the long words of the benchmark passages."""
    terms = table(spark, sf_dir, "benchmark").select(F.explode(C.words("text")).alias("term")).where(F.length("term") >= LONG).distinct()
    first = F.substring(F.lower("term"), 1, 1)
    label = F.when(first < "i", "FIRST").when(first < "r", "MIDDLE").otherwise("LAST")
    return terms.select("term", C.fold("term").alias("key"), label.alias("label")).groupBy("key").agg(F.min("term").alias("entry"), F.min("label").alias("label"))


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.term_hits(tokens(spark, sf_dir), lexicon(spark, sf_dir)).select("doc_id", "pos", "token", "key", "entry", "label")


def engine(spark: SparkSession, sf_dir: str, **options: object) -> Engine:
    """The pipeline with the data-derived lexicon."""
    e = lexicon(spark, sf_dir)
    text = {c: F.lit("") for c in ("subtype", "definition", "botanical", "requires_context", "notes", "source")}
    none = F.array().cast("array<string>")
    entries = e.select(F.concat(F.lower("label"), F.lit(":"), "key").alias("id"), "label", F.col("entry").alias("canonical"), F.lit("").alias("devanagari"), *(none.alias(c) for c in ("synonyms", "hindi", "english", "xrefs")), *(v.alias(k) for k, v in text.items()))
    return Engine.from_lexicon(spark, entries, **options)


@query()
def ner_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole pipeline (OP-40 to OP-57, 89) over documents."""
    return analytics.flatten(engine(spark, sf_dir).annotate(docs(spark, sf_dir))).drop("metadata", "alternatives")


#: Texts in several scripts, and what the seed lexicon and rules make of them: the engine's output, reviewed against the rules:
#: (surface, label, entity_id, match_type, confidence, ambiguous).
GOLDEN: tuple[tuple[str, tuple[tuple[str, str, str, str, float, bool], ...]], ...] = (
    ("हरीतकी क्वाथ पित्त विकार में दें", (("हरीतकी क्वाथ", "FORMULATION", "composite:dravya:haritaki+dosage_form:kvatha", "compose", 0.9, False), ("पित्त विकार", "ROGA", "composite:dosha:pitta+roga:roga", "compose", 0.9, False))),
    ("haritaki kvath pitta vikar mein dein", (("haritaki kvath", "FORMULATION", "composite:dravya:haritaki+dosage_form:kvatha", "compose", 0.9, False), ("pitta vikar", "ROGA", "composite:dosha:pitta+roga:roga", "compose", 0.9, False))),
    ("तुलसीक्वाथेन कासः शाम्यति।", (("तुलसीक्वाथेन", "FORMULATION", "composite:dravya:tulasi+dosage_form:kvatha", "compound", 0.85, False), ("कासः", "SYMPTOM", "symptom:kasa", "phonetic", 0.95, False))),
    ("कफज्वर में अडूसा", (("कफज्वर", "ROGA", "composite:dosha:kapha+roga:jvara", "compound", 0.85, False), ("अडूसा", "DRAVYA", "dravya:vasa", "exact", 1.0, False))),
    ("Yograj   guggul se sujan kam, phir basti", (("Yograj   guggul", "FORMULATION", "formulation:yogaraja_guggulu", "phonetic", 0.95, False), ("sujan", "SYMPTOM", "symptom:shotha", "exact", 1.0, False), ("basti", "PROCEDURE", "procedure:basti", "exact", 1.0, False))),
    ("vatarogeshu nasyam", (("vatarogeshu", "ROGA", "roga:vatavyadhi", "stem", 0.9, False), ("nasyam", "PROCEDURE", "procedure:nasya", "stem", 0.9, False))),
    ("amla madhura ushna virya", (("amla", "PROPERTY", "property:amla", "exact", 1.0, False), ("madhura", "PROPERTY", "property:madhura", "exact", 1.0, False), ("ushna virya", "PROPERTY", "composite:property:ushna+property:generic_virya", "compose", 0.9, False))),
    ("amla aur shahad", (("amla", "DRAVYA", "dravya:amalaki", "exact", 1.0, False), ("shahad", "DRAVYA", "dravya:madhu", "exact", 1.0, False))),
    ("tvak par lepa", (("tvak", "DRAVYA", "dravya:tvak", "exact", 0.85, True),)),
    ("guru ki aagya", ()),
    ("guru aur madhura", (("guru", "PROPERTY", "property:guru", "exact", 0.8, False), ("madhura", "PROPERTY", "property:madhura", "exact", 1.0, False))),
    ("pachaka pitta", (("pachaka pitta", "DOSHA", "composite:dosha:pachaka+dosha:pitta", "compose", 0.9, False),)),
    ("mutra rog", (("mutra rog", "ROGA", "composite:mala:mutra+roga:roga", "compose", 0.9, False),)),
    ("tulsī-patra", (("tulsī", "DRAVYA", "dravya:tulasi", "phonetic", 0.95, False),)),
    ("cough, swelling and burning", ()),
)
_GOLDEN_ROWS = [(i, n, surface, text.index(surface), *rest) for i, (text, found) in enumerate(GOLDEN) for n, (surface, *rest) in enumerate(found)]


@query("SELECT CAST(doc_id AS BIGINT) AS doc_id, ord, text, start, start + length(text) AS end, label, entity_id, match_type, CAST(confidence AS DOUBLE) AS confidence, ambiguous FROM (VALUES " + ", ".join(f"({i}, {n}, '{t}', {a}, '{label}', '{e}', '{kind}', {conf}, {amb})" for i, n, t, a, label, e, kind, conf, amb in _GOLDEN_ROWS) + ") AS g(doc_id, ord, text, start, label, entity_id, match_type, confidence, ambiguous)")
def ner_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole recogniser (OP-40 to OP-57) with the seed lexicon over texts in several scripts."""
    own = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(GOLDEN)], "doc_id bigint, text string")
    rows = analytics.flatten(Engine.load(spark, []).annotate(own))
    return rows.select("doc_id", "ord", "text", "start", F.col("end").cast("int").alias("end"), "label", "entity_id", "match_type", "confidence", "ambiguous")


@query(f"WITH {TOKENS} SELECT doc_id, pos, token FROM tok")
def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens(spark, sf_dir)


@query(f"WITH {TOKENS}, {DISTINCT} SELECT token, {fold_sql('token')} AS strict_key, {fold_sql('token', drop=False)} AS full_key, {fold_sql('token', loose=True)} AS loose_key FROM dis")
def fold_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_tokens(spark, sf_dir).select("token", C.fold("token").alias("strict_key"), C.fold("token", drop=False).alias("full_key"), C.fold("token", loose=True).alias("loose_key"))


_MARKED = "strip_accents(token)"


@query(f"WITH {TOKENS}, {DISTINCT} SELECT token, {_MARKED} AS plain, regexp_matches(token, '^[A-Za-z''-]+$') AS casual, regexp_matches(token, '[{script.DEVANAGARI}]') AS devanagari FROM dis")
def token_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_tokens(spark, sf_dir).select("token", C.strip_marks("token").alias("plain"), C.is_casual("token").alias("casual"), C.is_devanagari("token").alias("devanagari"))


_TABLE, _LEAST = script.suffix_table()
_FITS = "list_filter([" + ", ".join(f"'{s}'" for s in _TABLE) + f"], lambda s: suffix(k, s) AND length(k) - length(s) >= {_LEAST})"
_STEMS = f"list_filter(flatten(list_transform({_FITS}, lambda s: [{schwa_sql('left(k, length(k) - length(s))')}, left(k, length(k) - length(s))])), lambda x: length(x) >= {_LEAST})"


@query(f"WITH {TOKENS}, {DISTINCT}, f AS MATERIALIZED (SELECT DISTINCT {fold_sql('token', drop=False)} AS k FROM dis) SELECT k AS key, array_to_string(list_sort(list_distinct({_STEMS})), ',') AS stems FROM f")
def stem_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = distinct_tokens(spark, sf_dir).select(C.fold("token", drop=False).alias("key")).distinct()
    return keys.select("key", F.array_join(F.sort_array(C.stems("key")), ",").alias("stems"))


@query(f"SELECT doc_id, array_to_string({WORDS('lower(text)')}, ' ') AS surface FROM documents")
def surface_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", C.surface_norm("text").alias("surface"))


@query("SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(p_name || ' | ' || p_brand || '||' || p_type, '|'), lambda x: trim(x)), lambda x: x != ''), ';') AS parts FROM part")
def split_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(C.split_list(F.concat("p_name", F.lit(" | "), "p_brand", F.lit("||"), "p_type")), ";").alias("parts"))


@query(f"WITH {HITS} SELECT doc_id, pos, token, entry, label FROM hits")
def gazetteer_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(spark, sf_dir).select("doc_id", "pos", "token", "entry", "label")


_RUNS = f"""bw AS MATERIALIZED (SELECT item_id, unnest(w) AS token, generate_subscripts(w, 1) AS i FROM (SELECT item_id, {WORDS('text')} AS w FROM benchmark)),
bk AS MATERIALIZED (SELECT token, {fold_sql('token')} AS key FROM (SELECT DISTINCT token FROM bw)),
bl AS (SELECT item_id, i, key AS k1, lead(key, 1) OVER d AS k2, lead(key, 2) OVER d AS k3, lead(key, 3) OVER d AS k4 FROM bw JOIN bk USING (token) WINDOW d AS (PARTITION BY item_id ORDER BY i)),
runs AS MATERIALIZED (SELECT min(item_id) AS entry, k1, k2, k3, k4 FROM bl WHERE k4 IS NOT NULL GROUP BY k1, k2, k3, k4)"""


@query(f"""WITH {TOKENS}, {DISTINCT}, {KEYS}, {_RUNS},
l AS (SELECT doc_id, pos, key AS k1, lead(key, 1) OVER d AS k2, lead(key, 2) OVER d AS k3, lead(key, 3) OVER d AS k4 FROM tok JOIN keys USING (token) WINDOW d AS (PARTITION BY doc_id ORDER BY pos))
SELECT doc_id, CAST(pos AS INTEGER) AS start, entry FROM l JOIN runs USING (k1, k2, k3, k4)""")
def phrase_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run of four words of the benchmark passages as a term (OP-40), found in all documents."""
    words = table(spark, sf_dir, "benchmark").select("item_id", C.words("text").alias("w")).where("size(w) >= 4")
    runs = words.select("item_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 3), lambda i: F.slice("w", i, F.lit(4)))).alias("w"))
    terms = runs.select(F.col("item_id").alias("entry"), F.lit("PASSAGE").alias("label"), F.array_join("w", " ").alias("term"), F.transform("w", lambda x: C.fold(x)).alias("path"))
    terms = terms.groupBy("path").agg(F.min(F.struct("entry", "label", "term")).alias("t")).select("t.*")
    return relational.phrase_matches(docs(spark, sf_dir), terms).select("doc_id", "start", "entry")


@query(f"""WITH {TOKENS}, {DISTINCT}, {KEYS}, p AS (SELECT token, key, CASE WHEN token = lower(token) THEN 'LOWER' ELSE 'CAPITAL' END AS label FROM keys WHERE length(token) >= 4)
SELECT key, array_to_string(list_sort(list(DISTINCT token)), ',') AS ids FROM p GROUP BY key HAVING count(DISTINCT label) > 1""")
def collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = distinct_tokens(spark, sf_dir).select(F.col("token").alias("id"), C.fold("token").alias("key"))
    label = F.when(F.col("id") == F.lower("id"), "LOWER").otherwise("CAPITAL")
    return relational.collisions(keys.select("key", "id", label.alias("label"), (F.length("id") < 4).alias("weak")))


@query(f"""WITH {TERMS}, s AS (SELECT term AS entry, array_to_string({WORDS('lower(term)')}, ' ') AS form FROM lex0)
SELECT form, array_to_string(list_sort(list(DISTINCT entry)), ',') AS entries FROM s WHERE form != '' GROUP BY form""")
def surface_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = table(spark, sf_dir, "benchmark").select(F.explode(C.words("text")).alias("term")).where(F.length("term") >= LONG).distinct()
    return relational.surface_map(terms.select(F.col("term").alias("entry"), "term"))


@query(f"""WITH {_RUNS}, e AS (SELECT [k1, k2, k3, k4] AS path, unnest([1, 2, 3, 4]) AS n FROM runs)
SELECT array_to_string(path[1:n - 1], ' ') AS parent, path[n] AS key, array_to_string(path[1:n], ' ') AS child, bool_or(n = 4) AS terminal FROM e GROUP BY ALL""")
def trie_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie (OP-39) of all runs of four words of the benchmark passages."""
    words = table(spark, sf_dir, "benchmark").select(F.transform(C.words("text"), lambda x: C.fold(x)).alias("w")).where("size(w) >= 4")
    return relational.trie_edges(words.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 3), lambda i: F.slice("w", i, F.lit(4)))).alias("path")).distinct())


@query(f"""WITH {TERMS}, k AS MATERIALIZED (SELECT DISTINCT substr(lower(term), 1, 4) AS entry, {fold_sql('term')} AS key FROM lex0)
SELECT a.key, array_to_string(list_sort(list(DISTINCT b.key)), ',') AS others FROM k a JOIN k b USING (entry) GROUP BY a.key""")
def synonym_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = table(spark, sf_dir, "benchmark").select(F.explode(C.words("text")).alias("term")).where(F.length("term") >= LONG)
    closed = relational.synonym_closure(terms.select(F.substring(F.lower("term"), 1, 4).alias("entry"), C.fold("term").alias("key")))
    return closed.select("key", F.array_join("others", ",").alias("others"))


@query("SELECT CAST(user_id AS VARCHAR) AS id, min(event_id) AS place, upper(arg_max(event_type, event_id)) AS label, arg_max(event_type, event_id) AS canonical FROM events GROUP BY user_id")
def merge_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The validated merge of lexicon rows (OP-34, 35): the last row of an id, at the first one's place."""
    own = {"id": F.col("user_id").cast("string"), "label": F.col("event_type"), "canonical_iast": F.col("event_type"), "row_ord": F.col("event_id"), "file_ord": F.lit(0)}
    raw = table(spark, sf_dir, "events").select(*(own.get(c, F.lit("")).alias(c) for c in dict.fromkeys([*source.TEXT_COLUMNS, *own])))
    return source.entries(raw).select("id", F.col("row_ord").alias("place"), "label", "canonical")


@query(f"WITH {HITS} SELECT DISTINCT h.doc_id, h.pos AS span, k.key FROM hits h JOIN kt k ON k.doc_id = h.doc_id AND k.pos BETWEEN h.pos - 3 AND h.pos + 3 AND k.pos != h.pos")
def window_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = hits(spark, sf_dir).select("doc_id", F.col("pos").alias("span"), F.col("pos").alias("first"), (F.col("pos") + 1).alias("last"))
    return relational.window_keys(relational.keyed(tokens(spark, sf_dir)), spans, 3)


@query(f"""WITH {HITS} SELECT a.doc_id, a.pos, count(*) AS n FROM hits a JOIN hits b ON a.doc_id = b.doc_id AND a.pos != b.pos AND abs(a.pos - b.pos) - 1 < 6 GROUP BY a.doc_id, a.pos""")
def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Other candidates in a window (OP-50)."""
    return relational.neighbours(hits(spark, sf_dir).select("doc_id", "pos"), 6)


@query(f"WITH {HITS} SELECT k.doc_id, count(*) AS n FROM kt k LEFT JOIN hits h ON h.doc_id = k.doc_id AND h.pos = k.pos WHERE h.pos IS NULL GROUP BY k.doc_id")
def uncovered_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = hits(spark, sf_dir).select("doc_id", F.col("pos").alias("first"), (F.col("pos") + 1).alias("last"))
    return relational.uncovered(tokens(spark, sf_dir), spans).groupBy("doc_id").agg(F.count("*").alias("n"))


@query(f"""WITH RECURSIVE {HITS}, sp AS (SELECT doc_id, pos AS first, CAST(pos + n AS INTEGER) AS last, length(token) AS rank, n AS ord FROM hits, (SELECT unnest([1, 2, 3]) AS n)),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY first - last, rank, first, ord, last) AS i FROM sp),
r(doc_id, i, kept) AS (
  SELECT DISTINCT doc_id, CAST(0 AS BIGINT), CAST([] AS STRUCT(f INTEGER, l INTEGER)[]) FROM o UNION ALL
  SELECT r.doc_id, o.i, CASE WHEN len(list_filter(kept, lambda k: k.f < o.last AND o.first < k.l)) = 0 THEN list_append(kept, {{'f': o.first, 'l': o.last}}) ELSE kept END FROM r JOIN o ON o.doc_id = r.doc_id AND o.i = r.i + 1),
z AS (SELECT doc_id, unnest(arg_max(kept, i)) AS k FROM r GROUP BY doc_id)
SELECT o.doc_id, o.first, o.last, CAST(o.rank AS INTEGER) AS rank, CAST(o.ord AS INTEGER) AS ord FROM z JOIN o ON o.doc_id = z.doc_id AND o.first = z.k.f AND o.last = z.k.l""")
def resolve_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy overlap resolution (OP-48) of runs of one to three tokens that begin at a hit."""
    h = hits(spark, sf_dir).select("doc_id", F.col("pos").alias("first"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("n"), F.length("token").alias("rank"))
    spans = h.select("doc_id", "first", (F.col("first") + F.col("n")).alias("last"), "rank", F.col("n").alias("ord"))
    return relational.resolve(spans)




_NAMED = f"{TOKENS}, {DISTINCT}, {KEYS}, {LEX}, named AS MATERIALIZED (SELECT token, entry, label FROM keys JOIN lex USING (key))"


@query(f"WITH {_NAMED} SELECT doc_id, pos, token, CASE WHEN label IS NULL THEN 'O' ELSE 'B-' || label END AS tag FROM tok LEFT JOIN named USING (token)")
def bio_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tokens(spark, sf_dir).withColumns({"start": F.col("pos"), "end": F.col("pos") + 1})
    e = hits(spark, sf_dir).select("doc_id", F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"), "label", F.col("pos").alias("ord"))
    return relational.bio(t, e)


#: Gold: all hits.  Predicted: those of longer tokens, with FIRST called MIDDLE where the token is longest.
_EVAL = """g AS (SELECT DISTINCT doc_id, pos AS s, pos + 1 AS e, label FROM hits),
p AS (SELECT DISTINCT doc_id, pos AS s, pos + 1 AS e, CASE WHEN length(token) > 13 AND label = 'FIRST' THEN 'MIDDLE' ELSE label END AS label FROM hits WHERE length(token) > 10)"""
_COUNTS = """counts AS (SELECT coalesce(g.label, p.label) AS label, CAST(count(*) FILTER (g.label IS NOT NULL AND p.label IS NOT NULL) AS BIGINT) AS tp, count(*) FILTER (g.label IS NULL) AS fp, count(*) FILTER (p.label IS NULL) AS fn
FROM g FULL JOIN p ON g.doc_id = p.doc_id AND g.s = p.s AND g.e = p.e AND g.label = p.label GROUP BY 1)"""


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    h = hits(spark, sf_dir).select("doc_id", F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"), "label", "token")
    moved = F.when((F.length("token") > 13) & (F.col("label") == "FIRST"), "MIDDLE").otherwise(F.col("label"))
    return h.drop("token"), h.where(F.length("token") > 10).withColumn("label", moved).drop("token")


@query(f"WITH {HITS}, {_EVAL}, {_COUNTS} SELECT * FROM counts")
def eval_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.exact(*_sides(spark, sf_dir))


@query(f"""WITH {HITS}, {_EVAL}, {_COUNTS}, r AS (SELECT label, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM counts GROUP BY ROLLUP (label)),
x AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END AS r FROM r)
SELECT *, CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END AS f1 FROM x""")
def eval_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.prf(evaluate.with_micro(evaluate.exact(*_sides(spark, sf_dir))))


@query(f"WITH {HITS}, {_EVAL}, {_COUNTS} SELECT * FROM counts")  # spans of one token overlap only if they are equal
def eval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.overlap(*_sides(spark, sf_dir))


@query(f"""WITH {HITS}, {_EVAL}, m AS (SELECT * FROM g EXCEPT SELECT * FROM p), s AS (SELECT * FROM p EXCEPT SELECT * FROM g),
u AS (SELECT doc_id, s || ':' || e || ':' || label AS missed, NULL AS spurious FROM m UNION ALL SELECT doc_id, NULL, s || ':' || e || ':' || label FROM s)
SELECT doc_id, coalesce(array_to_string(list_sort(list(missed) FILTER (missed IS NOT NULL)), ' '), '') AS missed, coalesce(array_to_string(list_sort(list(spurious) FILTER (spurious IS NOT NULL)), ' '), '') AS spurious FROM u GROUP BY doc_id""")
def eval_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.mismatches(*_sides(spark, sf_dir))


#: Devanagari texts, some of them garbled: words that begin with a vowel sign or hold a letter that legacy fonts leave behind.
GARBLED = ("ाक ख ab", "वात पित्त कफ", "िक ऩर शुद्ध पाठ", "ॆ क", "", "plain words", "ऻ ऺ ऄ a ी", "रस\tरक्त\nौम")
_TEXTS = "texts AS (SELECT doc_id, text FROM documents UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({-i - 1}, '{t}')" for i, t in enumerate(GARBLED)) + "))"


@query(f"""WITH {_TEXTS}, w AS (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: regexp_matches(x, '[ऀ-ॿ]')) AS w FROM texts),
b AS (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: regexp_matches(x, '^[ा-ौॢॣ]') OR regexp_matches(x, '[{mine.ARTIFACTS}]'))) AS bad FROM w)
SELECT doc_id, CASE WHEN n = 0 THEN 0 ELSE CAST(bad AS DOUBLE) / n END AS garble FROM b""")
def garble_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The garble score (OP-70) of all documents, and of some Devanagari texts, whose ids are negative."""
    own = spark.createDataFrame([(-i - 1, t) for i, t in enumerate(GARBLED)], "doc_id bigint, text string")
    return docs(spark, sf_dir).unionByName(own).select("doc_id", mine.garble_score("text").alias("garble"))


#: Normalisation as far as the documents need it: composed letters, plain quotes and hyphens, no soft hyphens or joiners.
_NORMAL = "translate(nfc_normalize(text), '‘’–‐‑­‌‍﻿', '" + "''" * 2 + "---')"


@query(f"SELECT doc_id AS file, CAST(unnest(range(len(s))) AS INTEGER) AS segment, unnest(s) AS text FROM (SELECT doc_id, string_split_regex({_NORMAL}, '[।॥.\n]+') AS s FROM documents)")
def segment_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine.segments(docs(spark, sf_dir).select(F.col("doc_id").alias("file"), "text"))


_NGRAMS = f"""{TOKENS}, {DISTINCT}, {KEYS}, w AS (SELECT doc_id, key, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS i FROM tok JOIN keys USING (token) WHERE length(token) >= 3),
g AS (SELECT doc_id, i, key AS k1, lead(key) OVER d AS k2, lead(key, 2) OVER d AS k3 FROM w WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
n AS (SELECT doc_id, i, 1 AS n, k1 AS key FROM g UNION ALL SELECT doc_id, i, 2, k1 || ' ' || k2 FROM g WHERE k2 IS NOT NULL UNION ALL SELECT doc_id, i, 3, k1 || ' ' || k2 || ' ' || k3 FROM g WHERE k3 IS NOT NULL)"""


@query(f"WITH {_NGRAMS} SELECT key, count(*) AS frequency, count(DISTINCT doc_id) AS docs, min(doc_id) AS first_doc FROM n GROUP BY key HAVING count(*) >= 20")
def mine_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequent n-grams (OP-73 to 75): counted per document first, so that the shuffle holds one row for each."""
    grams = mine.ngrams(docs(spark, sf_dir)).groupBy("key", "doc_id").agg(F.count("*").alias("n"))
    out = grams.groupBy("key").agg(F.sum("n").alias("frequency"), F.count("*").alias("docs"), F.min("doc_id").alias("first_doc"))
    return out.where("frequency >= 20")


@query()
def mine_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate terms that the data-derived lexicon doesn't know, with contexts."""
    named = table(spark, sf_dir, "documents").select(F.col("source").alias("file"), "text")
    return mine.mine(engine(spark, sf_dir), named, least=20, longest=3)


_CODES = list(importer.DISCIPLINES)
_PART = "SELECT p_partkey, [" + ", ".join(f"'{c}'" for c in _CODES) + f"][1 + p_partkey % {len(_CODES)}] || '0001' AS code, lower(p_brand) AS iast, p_name || '; ' || p_type || ' powder of iron' AS english FROM part"


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.element_at(F.array(*map(F.lit, _CODES)), (F.col("p_partkey") % len(_CODES) + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(code, F.lit("0001")).alias("code"), F.lower("p_brand").alias("iast"), F.concat("p_name", F.lit("; "), "p_type", F.lit(" powder of iron")).alias("english"))


_RX = lambda ws: "\\b(" + "|".join(ws) + ")\\b"
_SUB = " ".join(f"WHEN p = '{c}' THEN 'CONCEPT:{n.split()[0].lower()}'" for c, n in importer.DISCIPLINES.items())


@query(f"""WITH t AS ({_PART}), u AS (SELECT *, substr(code, 1, 2) AS p, lower(english) AS en FROM t)
SELECT p_partkey, CASE WHEN p = 'AF' THEN 'SYMPTOM:' WHEN p = 'SR' THEN 'ANATOMY:'
  WHEN p = 'SK' AND contains(iast, 'srota') THEN 'ANATOMY:srotas' WHEN p = 'SK' AND regexp_matches(en, 'upadhātu|upadhatu') THEN 'DHATU:upadhatu' WHEN p = 'SK' AND contains(iast, 'dhātu') THEN 'DHATU:'
  WHEN p = 'SK' AND regexp_matches(iast, '\\b(vāta|pitta|kapha|doṣa)\\b') THEN 'DOSHA:' WHEN p = 'SK' AND regexp_matches(iast, '\\bmala\\b') THEN 'MALA:' WHEN p = 'SK' THEN 'CONCEPT:physiology'
  WHEN p = 'DG' AND regexp_matches(en, '^(substances?|drugs?|herbs?)\\s+(which|that)') THEN 'KARMA:' WHEN p = 'DG' AND regexp_matches(en, 'combination of|group of') THEN 'FORMULATION:gana'
  WHEN p = 'DG' AND regexp_matches(english, '\\b[A-Z][a-z]+ [a-z]{{3,}}\\b') THEN 'DRAVYA:herb' WHEN p = 'DG' THEN 'CONCEPT:dravyaguna'
  WHEN p = 'BK' AND regexp_matches(en, '{"|".join(importer.PROCESS)}') THEN 'PROCEDURE:pharmaceutical' WHEN p = 'BK' AND regexp_matches(en, '{_RX(importer.DOSAGE)}') THEN 'DOSAGE_FORM:' WHEN p = 'BK' THEN 'CONCEPT:pharmaceutics'
  WHEN p = 'RS' AND regexp_matches(en, '{"|".join(importer.PROCESS)}') THEN 'PROCEDURE:rasashastra' WHEN p = 'RS' AND regexp_matches(en, '{_RX(importer.MINERAL)}') THEN 'DRAVYA:mineral' WHEN p = 'RS' THEN 'CONCEPT:rasashastra'
  WHEN p = 'AT' THEN 'CONCEPT:toxicology' {_SUB} ELSE 'CONCEPT:' END AS label FROM u""")
def provisional_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = importer.provisional_label(F.col("code"), F.col("iast"), F.col("english"))
    return _parts(spark, sf_dir).select("p_partkey", F.concat_ws(":", label["label"], label["subtype"]).alias("label"))


@query(f"""WITH t AS ({_PART}), u AS (SELECT p_partkey, trim(trim(trim(string_split_regex(english, '[;.:]|\\s[-–]\\s')[1]), ',')) AS first FROM t)
SELECT p_partkey, CASE WHEN len(list_filter(string_split_regex(first, '\\s+'), lambda w: w != '')) BETWEEN 1 AND 4 AND NOT regexp_matches(first, '[()/]') THEN first ELSE '' END AS gloss FROM u""")
def short_gloss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).select("p_partkey", importer.short_gloss(F.col("english")).alias("gloss"))


@query(f"WITH {HITS} SELECT DISTINCT k.key FROM kt k WHERE length(k.token) >= {LONG} AND NOT EXISTS (SELECT 1 FROM lex WHERE lex.key = k.key)")
def skip_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New keys that the lexicon lacks (OP-81)."""
    new = distinct_tokens(spark, sf_dir).where(F.length("token") >= LONG).select(C.fold("token").alias("key")).distinct()
    return new.join(lexicon(spark, sf_dir).select("key"), "key", "left_anti")


_ROWS = "ent AS (SELECT *, length(token) > 12 AS ambiguous, CASE WHEN lower(token) = lower(entry) THEN 1.0 ELSE 0.95 END AS confidence FROM hits)"


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    exact = F.lower("token") == F.lower("entry")
    return hits(spark, sf_dir).withColumns({"ambiguous": F.length("token") > 12, "confidence": F.when(exact, 1.0).otherwise(0.95)})


@query(f"WITH {HITS}, {_ROWS} SELECT count(*) AS entities, count(DISTINCT label) AS labels, CAST(coalesce(sum(CAST(ambiguous AS BIGINT)), 0) AS BIGINT) AS ambiguous, round(coalesce(avg(CAST(confidence AS DOUBLE)), 0), 6) AS mean_confidence FROM ent")
def ui_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.metrics(_rows(spark, sf_dir)).withColumn("mean_confidence", F.round("mean_confidence", 6))


@query(f"WITH {HITS} SELECT label, count(*) AS n FROM hits GROUP BY label")
def label_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.histogram(hits(spark, sf_dir))


@query(f"WITH {HITS}, {_ROWS} SELECT doc_id, CAST(count(*) FILTER (label = 'FIRST') AS INTEGER) AS first, CAST(count(*) FILTER (confidence >= 0.99 AND label IN ('FIRST', 'LAST')) AS INTEGER) AS sure FROM ent GROUP BY doc_id")
def filter_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """by_label and the label and confidence filter (OP-57, 91) on arrays of entities."""
    packed = _rows(spark, sf_dir).groupBy("doc_id").agg(F.collect_list(F.struct("label", "confidence")).alias("e"))
    return packed.select("doc_id", F.size(analytics.by_label("e", "FIRST")).alias("first"), F.size(analytics.only("e", ["first", "last"], 0.99)).alias("sure"))


@query(f"WITH {LEX} SELECT DISTINCT label FROM lex")
def label_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon(spark, sf_dir).select("label").distinct()


@query(f"SELECT sha256(encode('{script.KEY_VERSION}|True') || unhex(string_agg(sha256(n_name), '' ORDER BY n_nationkey))) AS digest FROM nation")
def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint (OP-39d) of a lexicon whose files are the names of the nations."""
    parts = [r.n_name.encode() for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()]  # 25 rows at any size
    return spark.createDataFrame([(compiled.fingerprint(parts, True),)], "digest string")


def _annotated(spark: SparkSession, sf_dir: str, most: int = 5) -> DataFrame:
    """The conversations with their first ``most`` characters as an entity labelled by the role."""
    end = F.least(F.lit(most), F.length("text"))
    e = F.struct(F.lit(0).alias("start"), end.alias("end"), F.substring("text", 1, most).alias("text"), F.col("role").alias("label"), F.concat(F.lit("role:"), "role").alias("entity_id"), F.col("role").alias("canonical"), F.lit(0.5).alias("confidence"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.array(e).alias("entities"), F.lit("v1").alias("lexicon_version"))


_JSON_ENTITY = """'{"start":0,"end":' || least(5, length(text)) || ',"text":' || to_json(left(text, 5)) || '"""


@query(f"""SELECT '{{"text":' || to_json(text) || ',"entities":[' || {_JSON_ENTITY},"label":' || to_json(role) || ',"entity_id":' || to_json('role:' || role) || ',"canonical":' || to_json(role) || ',"confidence":0.5}}],"lexicon_version":"v1"}}' AS value FROM conversations""")
def json_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines (OP-58, 96) of the annotated conversations."""
    return export.json_lines(_annotated(spark, sf_dir))


@query(f"""SELECT '{{"data":{{"text":' || to_json(text) || '}},"predictions":[{{"model_version":"padaflow","result":[{{"from_name":"label","to_name":"text","type":"labels","value":' || {_JSON_ENTITY},"labels":[' || to_json(role) || ']}},"score":0.5,"meta":{{"entity_id":' || to_json('role:' || role) || ',"canonical":' || to_json(role) || '}}}}]}}]}}' AS value FROM conversations""")
def export_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotation tasks (OP-61) of the annotated conversations."""
    return export.tasks(_annotated(spark, sf_dir))


@query(f"""WITH u AS (SELECT conv_id, turn, text, role, unnest(w) AS token, generate_subscripts(w, 1) AS i FROM (SELECT *, {WORDS('text')} AS w FROM conversations)),
v AS (SELECT conv_id, turn, string_agg(token || '\t' || CASE WHEN i = 1 AND starts_with(text, token) THEN 'B-' ELSE 'I-' END || role || '\n', '' ORDER BY i) AS value FROM u GROUP BY conv_id, turn)
SELECT coalesce(value, '') AS value FROM conversations LEFT JOIN v USING (conv_id, turn)""")
def export_conll(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CoNLL lines (OP-59, 60) of the conversations, each one entity from its first character to its last."""
    return export.conll(_annotated(spark, sf_dir, 1 << 30))


@query("SELECT conv_id, turn, '[' || left(text, 5) || '|' || role || ']' || substr(text, 6) AS marked FROM conversations")
def highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marked text (OP-90) of the annotated conversations."""
    return _annotated(spark, sf_dir).select("conv_id", "turn", analytics.highlight("text", "entities").alias("marked"))


@query()
def fuzzy_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Misspelt long keys against the lexicon (OP-45)."""
    keys = distinct_tokens(spark, sf_dir).where(F.length("token") >= LONG).select(C.fold("token").alias("key")).distinct()
    pool = lexicon(spark, sf_dir).select(F.col("key").alias("term"))
    return relational.fuzzy_matches(keys.join(pool, F.col("key") == F.col("term"), "left_anti"), pool)


@query()
def lookup_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookup of every benchmark word (OP-47)."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(C.words("text")).alias("query")).distinct()
    return engine(spark, sf_dir).lookup_all(words)


@query(f"SELECT doc_id, {_NORMAL} AS text, 0 AS start, CAST(length(text) AS INTEGER) AS end FROM documents WHERE length({_NORMAL}) > 0")
def normalize_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised text and the original range of its first character and its last (OP-11, 12)."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
    n = docs(spark, sf_dir).select("doc_id", C.normalize("text").alias("n")).where("length(n.text) > 0")
    found = C.to_original(F.col("n"), F.lit(0), F.length("n.text"))
    return n.select("doc_id", F.col("n.text").alias("text"), found["start"].alias("start"), found["end"].alias("end"))
