"""Queries over texts and names: vocabularies, search, blocks of names, chunks, pages, values in answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orefield.functions import scalars
from orefield.functions.sectors import DISTINCTIVE, FALLBACK, GENERIC, KEYWORDS, SPECIFIC, classify
from orefield.operators import documents, entities, entity_join, fulltext
from orefield.sources import pages as portal
from orefield.sources.tables import TENDER_SQL, table, tenders
from orefield.streaming import incremental

SQL: dict[str, str] = {}
QUERIES = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.strip()
        return f

    return keep


_WORDS = "SELECT DISTINCT doc_id, unnest(string_split_regex(lower(text), '[^\\p{L}\\p{Nd}]+')) AS word FROM documents"


@query(f"SELECT word, count(*) AS ndoc FROM ({_WORDS}) WHERE word <> '' GROUP BY word")
def word_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-14, SNK-10, STM-09."""
    return fulltext.vocabulary(table(spark, sf_dir, "documents"), "text", "doc_id")


ASKED = ["thatre", "ering", "onthin", "entirely"]


@query(f"""WITH v AS (SELECT word, count(*) AS ndoc FROM ({_WORDS}) WHERE word <> '' GROUP BY word), q AS (SELECT unnest({ASKED!r}) AS asked),
n AS (SELECT asked, word, ndoc, levenshtein(word, asked) AS d FROM q, v WHERE levenshtein(word, asked) <= CASE WHEN length(asked) >= 6 THEN 2 ELSE 1 END)
SELECT asked AS word, word AS fixed, CAST(d AS INTEGER) AS distance FROM n WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.word LIKE n.asked || '%') QUALIFY row_number() OVER (PARTITION BY asked ORDER BY d, ndoc DESC, word) = 1""")
def typo_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FTS-08, JON-07, JON-08."""
    return fulltext.corrections(ASKED, word_df(spark, sf_dir))


_GRAMS = "list_distinct(flatten([[substr('  ' || w || ' ', i, 3) FOR i IN range(1, length(w) + 2)] FOR w IN list_filter(string_split_regex(lower({c}), '[^\\p{{L}}\\p{{Nd}}]+'), lambda x: x <> '')]))"


@query(f"""WITH g AS (SELECT p_partkey, {_GRAMS.format(c="p_name")} AS a, {_GRAMS.format(c="'small blue part'")} AS b FROM part)
SELECT p_partkey, round(len(list_intersect(a, b)) / CAST(len(list_distinct(list_concat(a, b))) AS DOUBLE), 9) AS similarity FROM g""")
def trigram_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FTS-09."""
    return table(spark, sf_dir, "part").select("p_partkey", F.round(fulltext.trigram_similarity(F.col("p_name"), F.lit("small blue part")), 9).alias("similarity"))


_MASK = "SELECT doc_id, unnest(list_distinct(list_filter([regexp_replace(trim(x, ' \t\n\r'), '\\d+', '#', 'g') FOR x IN string_split(text, chr(10))], lambda y: y <> ''))) AS line FROM documents"


@query(f"SELECT source AS doc, line, n FROM (SELECT source, line, count(*) AS n FROM (SELECT d.source, m.line FROM ({_MASK}) m JOIN documents d USING (doc_id)) GROUP BY source, line) JOIN (SELECT source AS s, count(*) AS pages FROM documents GROUP BY source) ON s = source WHERE pages >= 3 AND n >= greatest(3, 0.05 * pages)")
def running_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-21, over sources as documents of many pages, from one page in twenty on."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("doc"), "doc_id", "text")
    return fulltext.running_lines(docs, "doc", "doc_id", "text", share=0.05)


@query("""WITH k AS (SELECT c_custkey AS id, n_name AS state, CAST(c_custkey % 97 AS VARCHAR) AS token FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT a.id AS a_id, b.id AS b_id FROM k a JOIN k b ON a.state = b.state AND a.token = b.token AND a.id < b.id""")
def er_block_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ER-01, JON-12, JON-13: the block's first token is a stand-in, since all names here begin alike."""
    named = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = named.select(F.col("c_custkey").alias("id"), F.col("n_name").alias("state"), F.concat_ws(" ", (F.col("c_custkey") % 97).cast("string"), "c_name").alias("norm"))
    return entities.block_pairs(rows, "id", "norm", "state").select("a_id", "b_id")


def er_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, state, n): buyers' sectors and divisions as names, a department spelt in three ways."""
    wing = F.concat(F.element_at(F.array(*map(F.lit, ("Dept of ", "Department of ", "Deptt. "))), (F.col("id") % 3 + 1).cast("int")), F.initcap("sector"))
    names = tenders(spark, sf_dir).select(F.concat_ws(" || ", wing, F.concat(F.lit("Division No "), (F.col("buyer_id") % 40).cast("string"))).alias("buyer_raw"), "state")
    return entities.home_states(names)


#: Names spelt differently are one by their sector and division; divisions of one sector and state differ by a token of
#: their own, so the first of them is what the others are to be looked at with.
_ENTITIES = f"""WITH {TENDER_SQL}, named AS (SELECT ['Dept of ', 'Department of ', 'Deptt. '][id % 3 + 1] || upper(left(sector, 1)) || lower(substr(sector, 2)) || ' || Division No ' || CAST(buyer_id % 40 AS VARCHAR) AS name, sector, buyer_id % 40 AS division, state FROM tender),
cells AS (SELECT name, sector, division, state, count(*) AS m FROM named GROUP BY ALL),
home AS (SELECT name, sector, division, arg_min(state, struct_pack(less := -m, state := state)) AS state, sum(m) AS n FROM cells GROUP BY name, sector, division),
ranked AS (SELECT *, first_value(name) OVER (PARTITION BY state, sector, division ORDER BY n DESC, name) AS entity, first_value(name) OVER (PARTITION BY state, sector ORDER BY n DESC, name) AS lead FROM home)
SELECT name, state, entity, CASE WHEN name = entity THEN 'new' ELSE 'exact' END AS method, CAST(100 AS DOUBLE) AS score, CASE WHEN name = entity AND name <> lead THEN lead END AS candidate FROM ranked"""


@query(_ENTITIES)
def er_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ER-02 to ER-06, AGG-13: suppliers' and customers' names to entities, most frequent first."""
    return entities.resolve(er_names(spark, sf_dir))


@query(_ENTITIES)
def er_resolve_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ER-05, ER-06: the same by joins at rare tokens, and rounds."""
    return entity_join.resolve(er_names(spark, sf_dir))


@query("""SELECT CASE WHEN p_type ILIKE '%steel%' THEN 'a' ELSE 'b' END AS sector, count(*) AS n FROM part GROUP BY 1""".replace("'a'", "'buildings'").replace("'b'", "'supplies'").replace("p_type ILIKE '%steel%'", "FALSE"))
def sector_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-05, SNK-16: no title here has a telling word, so the main category decides."""
    sector = classify(F.col("p_name"), F.lit(""), F.lit("Goods"))
    return table(spark, sf_dir, "part").groupBy(sector.alias("sector")).agg(F.count(F.lit(1)).alias("n"))


#: Made titles: words that meet each rule of the cascade, two rules at once, or none.
PHRASES = [
    "sale of scrap", "Security guards", "fire alarm and road", "software for hospital equipment", "Wi-Fi in laboratory", "optical fibre", "housekeeping", "pest control of roads", "NH-44 widening", "4 laning",
    "bituminous pavement", "water supply", "tube wells and pumps", "sewage treatment", "11 kVA transformer", "HVAC", "surgical items", "X-ray for ambulance", "microscopes", "chemicals", "hiring of cars", "logistics",
    "feasibility study", "DPR for buildings", "boundary wall", "M/O quarters", "roadside broadside", "plain goods", "",
]
PRODUCTS = [*(name for g in (SPECIFIC, GENERIC) for names in g.values() for name in names.split("|")), "Unknown", ""]
CATEGORIES = ["Works", "Goods", "Services"]


def _cascade_sql() -> str:
    """The cascade in SQL, by its five steps."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    words = lambda rules: [f"WHEN regexp_matches(title, {quoted('(?i)' + p)}) THEN '{s}'" for s, p in rules]
    names = lambda rules: [f"WHEN product IN ({', '.join(map(quoted, n.split('|')))}) THEN '{s}'" for s, n in rules.items()]
    main = [f"WHEN category = '{c}' THEN '{s}'" for c, s in FALLBACK.items()]
    return " ".join(["CASE", *words(DISTINCTIVE), *names(SPECIFIC), *words(KEYWORDS), *names(GENERIC), *main, "ELSE 'other' END"])


@query(f"""WITH t AS (SELECT p_partkey, p_name || ' ' || {PHRASES!r}[p_partkey % {len(PHRASES)} + 1] AS title, CASE WHEN p_partkey % 2 = 0 THEN '' ELSE {PRODUCTS!r}[p_partkey % {len(PRODUCTS)} + 1] END AS product, {CATEGORIES!r}[p_partkey % {len(CATEGORIES)} + 1] AS category FROM part)
SELECT p_partkey, {_cascade_sql()} AS sector FROM t""")
def sector_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-05: the sector of titles, products and categories that meet the rules of every step."""
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("p_partkey") % len(values) + 1).cast("int"))
    product = F.when(F.col("p_partkey") % 2 == 0, "").otherwise(pick(PRODUCTS))
    return table(spark, sf_dir, "part").select("p_partkey", classify(F.concat_ws(" ", "p_name", pick(PHRASES)), product, pick(CATEGORIES)).alias("sector"))


_FORMS = f"list_distinct([w, regexp_replace(w, '^([a-z]{{3,}}?)(?:{'|'.join(fulltext.ENDINGS)})$', '\\1')])"


@query(f"""WITH t AS (SELECT doc_id, 'A' AS label, list_filter(string_split_regex(lower(source), '[^\\p{{L}}\\p{{Nd}}]+'), lambda x: x <> '') AS ws FROM documents
UNION ALL SELECT doc_id, 'D', list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{Nd}}]+'), lambda x: x <> '') FROM documents),
w AS (SELECT doc_id, label, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM t), s AS (SELECT doc_id, label, pos, unnest({_FORMS}) AS lexeme FROM w),
h AS (SELECT doc_id, 'e' AS term, label FROM s WHERE starts_with(lexeme, 'ering') UNION ALL SELECT doc_id, 't', label FROM s WHERE starts_with(lexeme, 'tion')
UNION ALL SELECT doc_id, 'o', label FROM s WHERE starts_with(lexeme, 'of') AND EXISTS (SELECT 1 FROM s n WHERE n.doc_id = s.doc_id AND n.label = s.label AND n.pos = s.pos + 1 AND starts_with(n.lexeme, 'the'))),
k AS (SELECT doc_id, term, max(CASE label WHEN 'A' THEN 1.0 ELSE 0.05 END) * (1 + ln(count(*))) AS score FROM h GROUP BY doc_id, term)
SELECT doc_id, round(sum(score), 9) AS score, CAST(count(*) AS INTEGER) AS n_terms FROM k WHERE doc_id NOT IN (SELECT doc_id FROM s WHERE starts_with(lexeme, 'with')) GROUP BY doc_id HAVING count(*) FILTER (term = 'o') > 0 AND count(*) FILTER (term <> 'o') > 0""")
def text_search_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FTS-01 to FTS-07, SRT-02: documents for a question of an OR, a phrase and a negation."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    found = fulltext.search_rows(docs, fulltext.parse_question('ering or tion "of the" -with'), {"source": "A", "text": "D"})
    return found.select("doc_id", F.round("score", 9).alias("score"), "n_terms").orderBy(F.desc("score"), "doc_id")


@query()
def chunk_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOC-01 to DOC-03."""
    pages = table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("page"), "text")
    return documents.chunk(pages)


@query()
def chunk_pack_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOC-01 to DOC-03: conversations as documents, a turn a page, each with a numbered header and footer."""
    said = F.concat_ws("\n", F.concat(F.lit("Conversation "), "conv_id"), "text", F.concat(F.lit("Turn "), F.col("turn") + 1))
    pages = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("page"), said.alias("text"))
    return documents.chunk(pages)


@query(r"""SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')) AS title, CAST(len(regexp_extract_all(html, '(?i)<a\s[^>]*href')) AS INTEGER) AS links, CAST(len(regexp_extract_all(html, '(?i)<p[\s>]')) AS INTEGER) AS paragraphs,
contains(html, 'Stale Session') AND contains(html, 'session has timed out') AS stale FROM pages""")
def html_title_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles, links and paragraphs of pages, and whether one is of a session that has ended."""
    rows = table(spark, sf_dir, "pages").select("page_id", portal.outline_of("html").alias("o"), portal.is_stale(F.col("html")).alias("stale"))
    return rows.select("page_id", "o.title", "o.links", "o.paragraphs", "stale")


@query()
def facts_in_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRD-01, GRD-02: values in what is said."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(documents.facts_of("text")).alias("f")).select("conv_id", "turn", "f.kind", "f.value", "f.text")


@query("SELECT doc_id, CAST(greatest(1, round_even(len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) * 1.3, 0)) AS INTEGER) AS tokens FROM documents")
def approx_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NUM-06."""
    return table(spark, sf_dir, "documents").select("doc_id", scalars.approx_tokens(F.col("text")).alias("tokens"))


@query("SELECT doc_id, sha256(text) AS text_sha256, left(sha1(text), 12) AS short_key, length(text) AS chars FROM documents".replace("sha1(text)", "sha1(text)"))
def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HSH-02, SRC-16."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.left(F.sha1("text"), F.lit(12)).alias("short_key"), F.length("text").cast("long").alias("chars"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def windowed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-03, STM-05: what the stream's windows come to when all is replayed."""
    return incremental.windowed_counts(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSN-02."""
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT lang, source, count(*) AS n, avg(length(text)) AS chars FROM documents GROUP BY GROUPING SETS ((lang, source), (lang), ())")
def corpus_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-12: counts by grouping sets."""
    docs = table(spark, sf_dir, "documents").withColumn("size", F.length("text"))
    return docs.groupingSets([["lang", "source"], ["lang"], []], "lang", "source").agg(F.count(F.lit(1)).alias("n"), F.avg("size").alias("chars"))
