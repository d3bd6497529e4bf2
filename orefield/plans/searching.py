"""Queries of stems, ranks by proximity, kept word lists and vector indexes, with their SQL twins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orefield.operators import proximity, retrieval, stemming
from orefield.operators.bucketed import BucketedTable
from orefield.operators.fulltext import WEIGHTS, tokens
from orefield.operators.stemming import DOUBLES, HEADS, LI_ENDING, OTHER, REGION, SHORT_END, SPECIAL, STAY, STEP_2, STEP_3, STEP_4, VOWEL, ending
from orefield.operators.vector_index import VectorIndex
from orefield.operators.wordlist import CANDIDATES, LONG, WordList
from orefield.sources.tables import table
from orefield.storage import scratch

SQL: dict[str, str] = {}
QUERIES = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.strip()
        return f

    return keep


# ---- stems ------------------------------------------------------------------------------------------------------------


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _swap(endings: dict[str, str], allowed: str) -> str:
    found = f"regexp_extract(w, {_quoted(ending(endings))}, 1)"
    to = " ".join(f"WHEN {_quoted(e)} THEN {_quoted(r)}" for e, r in endings.items())
    return f"(SELECT CASE WHEN e <> '' AND ({allowed}) THEN left(w, len(w) - len(e)) || CASE e {to} END ELSE w END FROM (SELECT {found} AS e))"


def _stem_sql(words: str) -> str:
    """CTEs from (word) to stemmed (word, stem): the algorithm's steps, one after the other."""
    at, before = "len(w) - len(e)", "right(left(w, len(w) - len(e)), 1)"
    region = f"CASE WHEN regexp_matches(x, {_quoted(REGION)}) THEN len(regexp_extract(x, {_quoted(REGION)})) ELSE len(x) END"
    head = f"regexp_extract(w, '^({HEADS})', 1)"
    short = f"regexp_matches({{x}}, {_quoted(SHORT_END)})"
    rest = "left(w, len(w) - 1)"
    steps = [
        f"SELECT word, lower(word) AS plain, regexp_replace(regexp_replace(lower(word), '^y', 'Y'), '({VOWEL})y', '\\1Y', 'g') AS w FROM ({words})",
        f"SELECT *, CASE WHEN {head} <> '' THEN len({head}) ELSE (SELECT {region} FROM (SELECT w AS x)) END AS r1 FROM s0",
        f"SELECT *, r1 + (SELECT {region} FROM (SELECT substr(w, r1 + 1) AS x)) AS r2 FROM s1",
        f"SELECT * REPLACE (CASE WHEN w LIKE '%sses' THEN left(w, len(w) - 2) WHEN regexp_matches(w, '(ied|ies)$') THEN left(w, len(w) - CASE WHEN len(w) > 4 THEN 2 ELSE 1 END) WHEN regexp_matches(w, '(us|ss)$') THEN w WHEN regexp_matches(w, '{VOWEL}.+s$') THEN left(w, len(w) - 1) ELSE w END AS w) FROM s2",
        f"SELECT *, w IN ({', '.join(map(_quoted, STAY))}) AS stays, w AS held, regexp_extract(w, '(eedly|eed)$', 1) AS eed, left(w, len(w) - len(regexp_extract(w, '(ingly|edly|ing|ed)$', 1))) AS pre FROM s3",
        f"""SELECT * REPLACE (CASE WHEN eed <> '' THEN CASE WHEN len(w) - len(eed) >= r1 THEN left(w, len(w) - len(eed)) || 'ee' ELSE w END
  WHEN pre <> w AND regexp_matches(pre, '{VOWEL}') THEN CASE WHEN regexp_matches(pre, '(at|bl|iz)$') THEN pre || 'e' WHEN regexp_matches(pre, '{DOUBLES}') THEN left(pre, len(pre) - 1) WHEN {short.format(x='pre')} AND len(pre) <= r1 THEN pre || 'e' ELSE pre END
  ELSE w END AS w) FROM s4""",
        f"SELECT * REPLACE (CASE WHEN regexp_matches(w, '^.+{OTHER}[yY]$') THEN left(w, len(w) - 1) || 'i' ELSE w END AS w) FROM s5",
        f"SELECT * REPLACE ({_swap(STEP_2, f'''{at} >= r1 AND (e <> 'ogi' OR {before} = 'l') AND (e <> 'li' OR regexp_matches({before}, '{LI_ENDING}'))''')} AS w) FROM s6",
        f"SELECT * REPLACE ({_swap(STEP_3, f'''{at} >= r1 AND (e <> 'ative' OR {at} >= r2)''')} AS w) FROM s7",
        f"SELECT * REPLACE ({_swap(dict.fromkeys(STEP_4, ''), f'''{at} >= r2 AND (e <> 'ion' OR {before} IN ('s', 't'))''')} AS w) FROM s8",
        f"SELECT * REPLACE (CASE WHEN (w LIKE '%e' AND (len(w) - 1 >= r2 OR (len(w) - 1 >= r1 AND NOT {short.format(x=rest)}))) OR (w LIKE '%ll' AND len(w) - 1 >= r2) THEN {rest} ELSE w END AS w) FROM s9",
    ]
    special = " ".join(f"WHEN {_quoted(a)} THEN {_quoted(b)}" for a, b in SPECIAL.items())
    last = f"stemmed AS (SELECT word, CASE plain {special} ELSE CASE WHEN len(plain) <= 2 THEN plain WHEN stays THEN held ELSE replace(w, 'Y', 'y') END END AS stem FROM s{len(steps) - 1})"
    return ",\n".join([f"s{k} AS ({s})" for k, s in enumerate(steps)] + [last])


_TOKENS = "list_filter(string_split_regex(lower({c}), '[^\\p{{L}}\\p{{Nd}}]+'), lambda x: x <> '')"
_DOC_WORDS = f"SELECT DISTINCT unnest({_TOKENS.format(c='text')}) AS word FROM documents"


@query(f"WITH {_stem_sql(_DOC_WORDS)} SELECT word, stem FROM stemmed")
def word_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FTS-01, FTS-03: the stem of every different word of the documents."""
    words = table(spark, sf_dir, "documents").select(F.explode(tokens(F.col("text"))).alias("word")).distinct()
    return stemming.stems(words)


# ---- ranks by proximity -----------------------------------------------------------------------------------------------

#: A source outweighs a text; the question has an OR, a phrase and a negation. Its stems: ther, thing, erin thanea, thnd.
PARTS = (("source", "A", False), ("text", "D", True))
ASKED = 'ther or things "eriner thanea" -thnd'

_STOP = ", ".join(map(_quoted, proximity.STOP_WORDS))


def _cover_sql(clauses: list[list[tuple[str, ...]]], barred: str = "") -> str:
    """Covers by joins: each place where a term ends, with the latest start of each clause up to there; of the ends with
    one start the first is a cover's. Terms are of one or two lexemes."""
    weight = f"CASE label {' '.join(f'WHEN {_quoted(k)} THEN {v}' for k, v in WEIGHTS.items())} END"
    any_of = lambda a, words: "(" + " OR ".join(f"starts_with({a}.lexeme, {_quoted(w)})" for w in words) + ")"
    every = sorted({w for c in clauses for t in c for w in t})
    one = [f"SELECT doc_id, {k} AS clause, pos AS b, pos AS e FROM spots WHERE {any_of('spots', [t[0] for t in c if len(t) == 1])}" for k, c in enumerate(clauses) if any(len(t) == 1 for t in c)]
    two = [f"SELECT x.doc_id, {k}, x.pos, y.pos FROM spots x JOIN spots y ON x.doc_id = y.doc_id AND y.pos = x.pos + 1 WHERE {any_of('x', t[:1])} AND {any_of('y', t[1:])}" for k, c in enumerate(clauses) for t in c if len(t) == 2]
    without = f" WHERE doc_id NOT IN (SELECT doc_id FROM lexemes WHERE starts_with(lexeme, {_quoted(barred)}))" if barred else ""
    return f"""{_stem_sql(_DOC_WORDS)},
listed AS (SELECT doc_id, {_TOKENS.format(c='source')} AS a, {_TOKENS.format(c='text')} AS b FROM documents),
placed AS (SELECT doc_id, 'A' AS label, generate_subscripts(a, 1) - 1 AS pos, unnest(a) AS word FROM listed
  UNION ALL SELECT doc_id, 'D', len(a) + 1 + generate_subscripts(b, 1) - 1, unnest(b) FROM listed),
lexemes AS (SELECT doc_id, label, pos, word AS lexeme FROM placed WHERE label = 'A'
  UNION ALL SELECT doc_id, label, pos, stem FROM placed JOIN stemmed USING (word) WHERE label = 'D' AND word NOT IN ({_STOP})),
spots AS (SELECT doc_id, pos, label, lexeme, 1 / {weight} AS inverse FROM lexemes WHERE {any_of('lexemes', every)}),
terms AS ({' UNION ALL '.join(one + two)}),
ends AS (SELECT DISTINCT doc_id, e FROM terms),
latest AS (SELECT n.doc_id, n.e, t.clause, max(t.b) AS b FROM ends n JOIN terms t ON t.doc_id = n.doc_id AND t.e <= n.e GROUP BY n.doc_id, n.e, t.clause),
stretch AS (SELECT doc_id, e, min(b) AS b FROM latest GROUP BY doc_id, e HAVING count(*) = {len(clauses)}),
cover AS (SELECT doc_id, b, min(e) AS e FROM stretch GROUP BY doc_id, b),
worth AS (SELECT c.doc_id, c.b, c.e, count(*) AS items, sum(s.inverse) AS inverse FROM cover c JOIN spots s ON s.doc_id = c.doc_id AND s.pos BETWEEN c.b AND c.e GROUP BY ALL),
score AS (SELECT doc_id, sum(items / inverse / (1 + CASE WHEN (e - b) - (items - 1) < 0 THEN (items - 1) // 2 ELSE (e - b) - (items - 1) END)) AS score FROM worth GROUP BY doc_id),
ranked AS (SELECT doc_id, round(score, 9) AS score FROM score{without})"""


_CLAUSES = [[("ther",), ("thing",)], [("erin", "thanea")]]


@query(f"WITH {_cover_sql(_CLAUSES, 'thnd')} SELECT doc_id, score FROM ranked")
def search_by_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FTS-01 to FTS-05, SRT-02: documents for a question, by how close its words stand."""
    found = proximity.search(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), ASKED, "doc_id", PARTS)
    return found.select("doc_id", F.round("score", 9).alias("score"))


# ---- the kept word list -----------------------------------------------------------------------------------------------

_LISTED = f"SELECT word, count(*) AS ndoc FROM (SELECT DISTINCT doc_id, unnest({_TOKENS.format(c='text')}) AS word FROM documents) WHERE regexp_matches(word, '^[a-z]+$') AND length(word) >= 3 GROUP BY word"


def word_list(spark: SparkSession, sf_dir: str, batches: int = 3) -> WordList:
    """A list that documents came into in so many batches."""
    kept = WordList(spark, scratch(spark, "words"), buckets=16)
    # a small file is one split; its rows are dealt out before they are cut into words
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").repartition(spark.sparkContext.defaultParallelism, "doc_id")
    for k in range(batches):
        kept.add(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == k), "text", "doc_id", batch=k)
    return kept


@query(_LISTED)
def words_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-14, SNK-10, STM-09: the list as three batches leave it."""
    return word_list(spark, sf_dir).words.read()


#: Unknown words with one near word or several, an unknown one without, and words that are known by head or stem.
TYPED = ["onthinx", "entirelz", "thanexdble", "erinner", "qwxzv", "thanea", "therings", "thx"]
_SETS = "list_distinct([substr('  ' || {w} || ' ', i, 3) FOR i IN range(1, length({w}) + 2)])"


@query(f"""WITH {_stem_sql('SELECT unnest(' + repr(TYPED) + ') AS word')}, v AS ({_LISTED}),
q AS (SELECT word AS asked, {_SETS.format(w='word')} AS g FROM stemmed WHERE NOT EXISTS (SELECT 1 FROM v WHERE starts_with(v.word, stemmed.word) OR starts_with(v.word, stemmed.stem))),
w AS (SELECT word, ndoc, {_SETS.format(w='word')} AS g FROM v),
n AS (SELECT asked, word, ndoc, 1 - len(list_intersect(q.g, w.g)) / len(list_distinct(list_concat(q.g, w.g))) AS d FROM q, w WHERE len(list_intersect(q.g, w.g)) > 0),
c AS (SELECT asked, word, ndoc, levenshtein(asked, word) AS e FROM n QUALIFY row_number() OVER (PARTITION BY asked ORDER BY d, word) <= {CANDIDATES})
SELECT asked AS word, word AS fixed, CAST(e AS INTEGER) AS edits FROM c WHERE e <= CASE WHEN length(asked) >= {LONG} THEN 2 ELSE 1 END QUALIFY row_number() OVER (PARTITION BY asked ORDER BY e, ndoc DESC, word) = 1""")
def typos_by_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FTS-08, JON-07, JON-08: corrections from the kept list."""
    return word_list(spark, sf_dir, batches=1).corrections(TYPED)


@query(f"WITH {_cover_sql([[('thanedbl',)], [('erin',)]])} SELECT doc_id, FALSE AS exact, score, 'thanedble eriner' AS corrected, FALSE AS any_term FROM ranked")
def search_staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FTS-07, FTS-08, FTS-12, SRT-02: a text with a typing error, which nothing matches as it is."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    found = proximity.staged(docs, "thanexdble eriner", word_list(spark, sf_dir, batches=1), PARTS, ("source",), "doc_id", closes=None)
    return found.rows.select("doc_id", "exact", F.round("score", 9).alias("score"), F.lit(found.corrected).alias("corrected"), F.lit(found.any_term).alias("any_term"))


@query("SELECT doc_id, source = 'src7' AS exact, 0 AS score FROM documents WHERE source = 'src7' QUALIFY row_number() OVER (ORDER BY doc_id) <= 20")
def search_staged_identifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-04, FTS-06: rows of which an identifier, one of two columns, is the text; no other has its word."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit("").alias("text"), "source", F.col("doc_id").cast("string").alias("number"))
    found = proximity.staged(docs, ' "SRC7" ', word_list(spark, sf_dir, batches=1), (("text", "D", True),), ("number", "source"), "doc_id", closes=None)
    return found.rows.select("doc_id", "exact", F.col("score").cast("int").alias("score"))


# ---- tables in buckets ------------------------------------------------------------------------------------------------


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 3 THEN o_totalprice + 1 ELSE o_totalprice END AS price, CAST(CASE WHEN o_orderkey % 10 = 3 THEN 2 ELSE 1 END AS INTEGER) AS fetched,
o_orderstatus AS note FROM orders WHERE o_orderkey % 50 <> 7""")
def table_upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-01, SNK-15, SNK-16: a table in buckets after a first load, a batch of changes, one of older fetches, one that
    comes twice, and one of deletions; a note that a batch lacks is kept."""
    kept = BucketedTable(spark, scratch(spark, "orders"), "o_orderkey long, price double, fetched int, note string", ["o_orderkey"], buckets=16)
    newer, keep = (lambda old, new: new("fetched") >= old("fetched")), {"note": lambda old, new: F.coalesce(new, old)}
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("o_orderkey"), F.col("o_totalprice").alias("price"), F.lit(1).alias("fetched"), F.col("o_orderstatus").alias("note"))
    changed = orders.where("o_orderkey % 10 = 3").withColumns({"price": F.col("price") + 1, "fetched": F.lit(2), "note": F.lit(None).cast("string")})
    late = orders.where("o_orderkey % 10 = 3").withColumns({"price": F.lit(0.0), "fetched": F.lit(0)})
    for number, batch in ((0, orders), (1, changed), (1, late.withColumn("fetched", F.lit(9))), (2, late)):
        kept.upsert(batch, order=["fetched"], batch=number, take=newer, merge=keep)
    kept.delete(orders.where("o_orderkey % 50 = 7"), batch=3)
    return kept.read()


# ---- the vector index -------------------------------------------------------------------------------------------------

_FAR = "1 - list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"


def _asked(vectors: DataFrame, every: int = 50) -> DataFrame:
    return vectors.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query"), F.col("embedding").cast("array<double>").alias("asked"))


@query(f"""SELECT q.vec_id AS query, e.vec_id, round({_FAR}, 9) AS distance, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY {_FAR}, e.vec_id) AS INTEGER) AS rank
FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0 AND e.label % 2 = 1 QUALIFY rank <= 10""")
def neighbours_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VEC-01, SRT-06: every fiftieth vector asks for its nearest under a filter, by the index, exactly."""
    vectors = table(spark, sf_dir, "embeddings")
    index = VectorIndex(spark, scratch(spark, "vectors"), "vec_id").build(vectors)
    found = index.search_many(_asked(vectors), 10, F.col("label") % 2 == 1, exact=True)
    return found.select("query", "vec_id", F.round("distance", 9).alias("distance"), F.col("rank").cast("int").alias("rank"))


#: A filter that all pass, one that about a tenth do, and one that a hundredth do.
FILTERS = {"all": "true", "label": "label = 3", "hundredth": "vec_id % 100 = 7"}


@query(" UNION ALL ".join(f"SELECT '{name}' AS filter, (SELECT count(*) FROM embeddings WHERE vec_id % 50 = 0) AS questions, (SELECT count(*) FROM embeddings WHERE vec_id % 50 = 0) * least(50, (SELECT count(*) FROM embeddings WHERE {where})) AS wanted, TRUE AS enough" for name, where in FILTERS.items()))
def neighbours_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VEC-01: per filter whether the index finds nine in ten of the 50 that a scan of all rows finds."""
    vectors = table(spark, sf_dir, "embeddings")
    index, asked = VectorIndex(spark, scratch(spark, "vectors"), "vec_id").build(vectors), _asked(vectors)
    parts = []
    for name, where in FILTERS.items():
        found = index.search_many(asked, 50, F.expr(where)).select("query", "vec_id", F.lit(1).alias("hit"))
        # the scan leaves a vector out of its own answer, so it is asked for one more under another name
        own = asked.select((-1 - F.col("query")).alias("vec_id"), F.col("asked").alias("embedding"))
        scan = retrieval.dense_many(vectors.where(where).select("vec_id", "embedding"), own, 50, "vec_id").select((-1 - F.col("query")).alias("query"), "vec_id")
        judged = scan.join(found, ["query", "vec_id"], "left").agg(F.count(F.lit(1)).alias("wanted"), F.count("hit").alias("hits"))
        parts.append(judged.select(F.lit(name).alias("filter"), "wanted", (F.col("hits") >= 0.9 * F.col("wanted")).alias("enough")))
    count = asked.agg(F.count(F.lit(1)).alias("questions"))
    return reduce(DataFrame.union, parts).join(F.broadcast(count)).select("filter", "questions", "wanted", "enough")
