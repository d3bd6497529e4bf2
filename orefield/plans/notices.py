"""Queries of notices, judged answers, labelled names and what a workspace keeps, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orefield.functions import scalars
from orefield.operators import answers, briefs, contracts, documents, entities, exports, fulltext, judged, name_pairs, prices, rules, upsert
from orefield.sources import awards
from orefield.sources.tables import AS_OF, TENDER_SQL, table, tenders

SQL: dict[str, str] = {}
QUERIES = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.strip()
        return f

    return keep


def text(x: Column) -> Column:
    return x.cast("string")


# ---- answers over conversations ---------------------------------------------------------------------------------------

_SUM = "c.conv_id * 7 + 1000"


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(answer_id, n, text): a conversation's turns as numbered passages, each with a sum and a period of its own."""
    turns = table(spark, sf_dir, "conversations")
    told = F.concat(F.col("text"), F.lit("\nThe deposit is Rs. "), text(F.col("conv_id") * 7 + 1000 + F.col("turn") * 100000), F.lit(" in all.\nIt is kept for "), text(F.col("turn") + 2), F.lit(" months."))
    return turns.select(F.col("conv_id").alias("answer_id"), (F.col("turn") + 1).cast("int").alias("n"), told.alias("text"))


def said(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(answer_id, answer, answerable, expected): answers that hold, that get the sum wrong, cite nothing, refuse, or cite
    what isn't there."""
    convs = table(spark, sf_dir, "conversations").where("turn = 0").select("conv_id")
    k = F.col("conv_id")
    right = F.concat(F.lit("The deposit is Rs. "), text(k * 7 + 1000), F.lit(" in all [1]."))
    made = F.when(k % 6 == 0, right).when(k % 6 == 1, F.concat(F.lit("The deposit is Rs. "), text(k * 7 + 999), F.lit(" [1].")))
    made = made.when(k % 6 == 2, "It is paid online.").when(k % 6 == 3, "I couldn't find this in the tender documents.").when(k % 6 == 4, F.concat(right, F.lit(" It is kept for 2 months [98].")))
    made = made.otherwise(F.concat(F.lit("<think>Rs. 1 [1]</think>"), right, F.lit(" It is kept for 2 months [1].")))
    return convs.select(k.alias("answer_id"), made.alias("answer"), (k % 6 != 3).alias("answerable"), F.concat(F.lit("Rs. "), text(k * 7 + 1000 + F.when(k % 12 == 0, 1).otherwise(0)), F.lit("/-")).alias("expected"))


_JUDGED = """SELECT conv_id AS answer_id, CASE conv_id % 6 WHEN 0 THEN 'answered' WHEN 3 THEN 'abstained' WHEN 5 THEN 'answered' ELSE 'rejected' END AS status,
CASE conv_id % 6 WHEN 0 THEN 'The deposit is Rs. ' || (conv_id * 7 + 1000) || ' in all [1].' WHEN 5 THEN 'The deposit is Rs. ' || (conv_id * 7 + 1000) || ' in all [1]. It is kept for 2 months [1].' ELSE 'I could not find this in the tender documents.' END AS shown,
CASE WHEN conv_id % 6 IN (0, 5) THEN 'The deposit is Rs. ' || (conv_id * 7 + 1000) || ' in all.' END AS quote FROM conversations WHERE turn = 0"""


@query(_JUDGED)
def answers_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ANS-02, GRD-03, GRD-04: the status of answers, what is shown, and the sentence that supports them best."""
    found = judged.judged(said(spark, sf_dir).select("answer_id", "answer"), passages(spark, sf_dir))
    return found.select("answer_id", "status", "shown", F.get("citations", 0)["quote"].alias("quote"))


@query("""WITH c AS (SELECT conv_id AS k FROM conversations WHERE turn = 0), r AS (SELECT k % 6 <> 3 AS asked, k % 6 IN (0, 5) AS told, k % 6 IN (0, 5) AND k % 12 <> 0 AS good FROM c)
SELECT count(*) AS questions, count(*) FILTER (asked) AS answerable, count(*) FILTER (asked AND told AND good) / count(*) FILTER (asked) AS exact_match, 1.0 AS grounding_rate,
(count(*) FILTER (NOT asked AND NOT told) + count(*) FILTER (asked) - count(*) FILTER (asked AND NOT told)) / count(*) AS abstention_accuracy, count(*) FILTER (asked AND NOT told) AS false_abstentions, count(*) FILTER (told AND NOT (asked AND good)) AS confident_wrong FROM r""")
def answer_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-20, SET-05, GRD-05: exact match, grounding and abstention over the conversations' questions."""
    asked = said(spark, sf_dir)
    found = judged.judged(asked.select("answer_id", "answer"), passages(spark, sf_dir))
    return judged.figures(found.join(asked.select("answer_id", "answerable", "expected"), "answer_id"))


@query("SELECT doc_id, contains(lower(text), 'thanea') AS words, doc_id % 3 <> 1 AS sums FROM documents")
def values_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-05, GRD-05: whether a text has what is expected: words, whatever their case, or a sum however it is written."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", r"[0-9]", " ").alias("text"))
    sums = F.concat(F.col("text"), F.lit(" Rs. "), F.when(F.col("doc_id") % 3 == 0, "5,00,000/-").when(F.col("doc_id") % 3 == 1, "4,99,999").otherwise("5 lakh"))
    return docs.select("doc_id", judged.values_match(F.lit("THANEA"), F.regexp_replace("text", r"-\s+", "- ")).alias("words"), judged.values_match(F.lit("INR 500000"), sums).alias("sums"))


# ---- what notices ask for ---------------------------------------------------------------------------------------------


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN ['Paper of ' || source, 'Affidavit in full on two lines', 'GST'] WHEN 1 THEN ['PAN card', 'Affidavit'] END AS documents, CAST(CASE doc_id % 3 WHEN 0 THEN 2 ELSE 1 END AS BIGINT) AS page, doc_id % 3 = 0 AS listed FROM documents WHERE doc_id % 3 < 2""")
def documents_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BRF-02: a list below its heading with a wrapped item, else documents known by name, else nothing."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    listed = F.concat(F.lit("Documents to be uploaded\n1. Paper of "), F.col("source"), F.lit(";\n(b) Affidavit in full\non two lines\niii) GST.\nGENERAL TERMS\n4. PAN"))
    first = F.when(F.col("doc_id") % 3 == 1, "A PAN is needed, and an affidavit.").otherwise("Nothing here.")
    second = F.when(F.col("doc_id") % 3 == 0, listed).otherwise("Documents to be uploaded\n1. one item only\nThe end.")
    pages = docs.select("doc_id", F.posexplode(F.array(first, second)).alias("k", "text")).select("doc_id", (F.col("k") + 1).cast("long").alias("page"), "text")
    return briefs.required_documents(pages)


def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A buyer's notice with options of similar works, a turnover, years, and an exemption or none."""
    k, sums = F.col("c_custkey"), F.col("c_custkey") + 1
    words = F.concat(
        F.lit("Bids are invited. Three similar completed works each costing not less than Rs. "), text(sums * 400), F.lit(" or two similar works of Rs. "), text(sums * 600), F.lit(" or one similar work of Rs. "), text(sums * 800), F.lit(". "),
        F.lit("Average annual turnover of Rs. "), text(sums * 1000), F.lit(" is needed. "), F.when(k % 2 == 0, "Minimum 5 years of experience. ").otherwise(""),
        F.when(k % 3 == 0, "MSEs are exempted from EMD. ").when(k % 3 == 1, "For MSEs there is no exemption from tender fee. ").otherwise(""), F.lit("The rest follows."),
    )
    return table(spark, sf_dir, "customer").select("c_custkey", words.alias("text"), (sums * 100 * (k % 13)).cast("double").alias("own_similar"), (sums * 500 * (k % 4)).cast("double").alias("own_turnover"), F.when(k % 7 != 0, (k % 9).cast("int")).alias("own_years"), F.when(k % 5 == 0, F.array(F.lit("Udyam"))).alias("certifications"))


_WORKS = "CASE WHEN c_custkey % 13 >= 8 THEN 'pass' WHEN c_custkey % 13 < 4 THEN 'fail' ELSE 'unknown' END"


@query(f"""WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 4 >= 2 THEN 'pass' ELSE 'fail' END AS turnover, {_WORKS} AS works, CASE WHEN c_custkey % 2 <> 0 THEN NULL WHEN c_custkey % 7 = 0 THEN 'unknown' WHEN c_custkey % 9 >= 5 THEN 'pass' ELSE 'fail' END AS years,
CASE c_custkey % 3 WHEN 0 THEN CASE WHEN c_custkey % 5 = 0 THEN 'pass' ELSE 'unknown' END WHEN 1 THEN 'unknown' END AS free FROM customer)
SELECT c_custkey, CASE WHEN 'fail' IN (turnover, works, coalesce(years, '')) THEN 'not_eligible' WHEN turnover = 'pass' AND works = 'pass' AND coalesce(years, 'pass') = 'pass' THEN 'eligible' ELSE 'unknown' END AS verdict,
turnover || ' ' || works || coalesce(' ' || years, '') || coalesce(' ' || free, '') AS checks FROM c""")
def eligibility_assessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ELG-01, BRF-01, BRF-02: from a notice's text to the verdict, by the bands of similar works; an exemption is only told."""
    rows = notices(spark, sf_dir).repartition(spark.sparkContext.defaultParallelism, "c_custkey")
    found = briefs.assessed(rows.drop("text").join(briefs.requirements(rows, "c_custkey"), "c_custkey"))
    return found.select("c_custkey", "verdict", F.array_join(F.transform("checks", lambda x: x["status"]), " ").alias("checks"))


@query("""SELECT c_custkey, 'Three similar completed works each costing not less than Rs. ' || ((c_custkey + 1) * 400) AS value, [CAST((c_custkey + 1) * 400 AS DOUBLE), CAST((c_custkey + 1) * 600 AS DOUBLE), CAST((c_custkey + 1) * 800 AS DOUBLE)] AS amounts,
CASE c_custkey % 3 WHEN 0 THEN 'Exempted from EMD' WHEN 1 THEN 'No exemption from tender fee' END AS exemption FROM customer""")
def similar_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BRF-02: the whole requirement with its options, and who is exempted from what."""
    rows = notices(spark, sf_dir).select("c_custkey", "text").repartition(spark.sparkContext.defaultParallelism, "c_custkey")
    works = briefs.similar_work(rows).select("c_custkey", "value", F.col("amounts").cast("array<double>").alias("amounts"))
    return works.join(rows.select("c_custkey", briefs.exemption(F.col("text")).alias("exemption")), "c_custkey")


@query("""WITH r AS (SELECT o_custkey AS tender_id, unnest(['emd', 'tender_fee']) AS key, o_orderkey AS document_id, o_orderdate AS created_at, CAST(o_orderkey AS VARCHAR) AS value, o_orderkey % 5 = 0 AS corr FROM orders)
SELECT tender_id, key, coalesce(max(struct_pack(c := created_at, d := document_id, v := value)) FILTER (corr), min(struct_pack(c := created_at, d := document_id, v := value)) FILTER (NOT corr)).v AS value FROM r GROUP BY tender_id, key""")
def briefs_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BRF-03: of each field what the last corrigendum says, else the first document."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("tender_id"), F.explode(F.array(F.lit("emd"), F.lit("tender_fee"))).alias("key"), F.col("o_orderkey").alias("document_id"), F.col("o_orderdate").alias("created_at"), text(F.col("o_orderkey")).alias("value"))
    return answers.merged_brief(rows, F.col("document_id") % 5 == 0).select("tender_id", "key", "value")


@query(r"""SELECT doc_id, 'financial e-procurement ' || text AS text, doc_id % 4 >= 2 AND doc_id % 3 = 0 AS garbled FROM documents""")
def pages_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-14: ligatures and cut words mended; Devanagari whose font is broken told from what isn't, or too short to say."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("ﬁnancial e-\nprocurement "), "text").alias("raw"))
    hindi = F.concat(F.repeat(F.lit("नि"), F.when(F.col("doc_id") % 4 >= 2, 15).otherwise(5)), F.repeat(F.lit("ȡ"), F.when(F.col("doc_id") % 3 == 0, 2).otherwise(1)))
    return docs.select("doc_id", scalars.clean_page(F.col("raw")).alias("text"), scalars.garbled_devanagari(F.concat("raw", hindi)).alias("garbled"))


# ---- labelled names ---------------------------------------------------------------------------------------------------

_NAMES = "SELECT c_custkey, c_mktsegment AS state, 'Department of ' || upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) || ' - Wing ' || c_custkey || ' || Division No ' || c_nationkey AS name FROM customer"


def wings(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("Department of "), F.initcap(F.lower("c_mktsegment")), F.lit(" - Wing "), text(F.col("c_custkey")), F.lit(" || Division No "), text(F.col("c_nationkey")))
    return table(spark, sf_dir, "customer").select("c_custkey", name.alias("name"), F.col("c_mktsegment").alias("state"))


@query(f"""WITH n AS ({_NAMES}), m AS (SELECT count(*) AS n, count(*) - count(DISTINCT state) AS pairs FROM n)
SELECT 'synthetic' AS source, n AS tp, CAST(0 AS BIGINT) AS fp, CAST(0 AS BIGINT) AS fn, CAST(0 AS BIGINT) AS tn, CAST(1 AS DOUBLE) AS precision, CAST(1 AS DOUBLE) AS recall FROM m
UNION ALL SELECT 'neighbour', 0, 0, 0, pairs, NULL, NULL FROM m UNION ALL SELECT 'all', n, 0, 0, pairs, 1, 1 FROM m""")
def names_evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ER-08, AGG-19: changed forms of names are found to be the same, their neighbours not."""
    kinds = F.element_at(F.array(*map(F.lit, name_pairs.KINDS[:4])), (F.col("c_custkey") % 4 + 1).cast("int"))
    return entities.evaluation(name_pairs.labelled(wings(spark, sf_dir), kind=kinds))


@query(f"""WITH n AS ({_NAMES}) SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN replace(name, 'Department', 'Deptt.') WHEN 1 THEN replace(name, ' - ', ' ') WHEN 2 THEN upper(name) ELSE replace(name, '|| ', '|| Office of the ') END AS changed FROM n""")
def names_perturbed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ER-08: four of the five changes; where a letter goes is a hash's choice, which tests look at."""
    kinds = F.element_at(F.array(*map(F.lit, name_pairs.KINDS[:4])), (F.col("c_custkey") % 4 + 1).cast("int"))
    return wings(spark, sf_dir).select("c_custkey", name_pairs.perturbed(F.col("name"), kinds).alias("changed"))


# ---- what a workspace keeps and sends ---------------------------------------------------------------------------------


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'stored' ELSE 'new' END AS state FROM orders")
def rows_inserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-05: rows that are there stay; others come in once."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    fresh = orders.withColumn("state", F.lit("new"))
    return upsert.insert_ignore(orders.where("id % 3 = 0").withColumn("state", F.lit("stored")), fresh.unionByName(fresh), ["id"])


@query("""WITH s AS (SELECT 'cpi' AS series, n_name AS country, 2000 + k AS year, n_nationkey + k AS value, -1 AS ord FROM nation, (SELECT unnest([0, 1, 2]) AS k)
UNION ALL SELECT 'cpi', n_name, 2001 + k, 100 * k + o, o FROM nation, (SELECT unnest([0, 1, 2]) AS k), (SELECT unnest([1, 2]) AS o))
SELECT series, country, CAST(year AS INTEGER) AS year, CAST(arg_max(value, ord) AS DOUBLE) AS value FROM s GROUP BY series, country, year""")
def index_upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-19: a batch's values over the stored ones, of several the last."""
    n, k = table(spark, sf_dir, "nation"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k")
    stored = n.select("n_name", "n_nationkey", k).select(F.lit("cpi").alias("series"), F.col("n_name").alias("country"), (F.col("k") + 2000).alias("year"), (F.col("n_nationkey") + F.col("k")).cast("double").alias("value"))
    batch = n.select("n_name", k).select("n_name", "k", F.explode(F.array(F.lit(1), F.lit(2))).alias("ord")).select(F.lit("cpi").alias("series"), F.col("n_name").alias("country"), (F.col("k") + 2001).alias("year"), (F.col("k") * 100 + F.col("ord")).cast("double").alias("value"), "ord")
    return prices.upsert_index(stored, batch)


@query("SELECT doc_id AS id FROM documents WHERE doc_id % 5 = 2 AND doc_id % 3 <> 0 AND source IN ('src1', 'src2', 'src3') AND lang = 'en'")
def chunks_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-13, FLT-19: the ready chunks of one organisation, tender and set of documents."""
    docs = table(spark, sf_dir, "documents")
    chunks = docs.select(F.col("doc_id").alias("id"), (F.col("doc_id") % 5).alias("organization_id"), F.when(F.col("doc_id") % 3 != 0, "ready").otherwise("failed").alias("status"), F.col("lang").alias("tender_id"), F.col("source").alias("document_id"))
    return answers.within(chunks, 2, tender_id="en", document_ids=["src1", "src2", "src3"]).select("id")


@query("""WITH m AS (SELECT c_nationkey AS org, c_custkey AS u, CASE c_custkey % 4 WHEN 0 THEN 'owner' WHEN 1 THEN 'admin' ELSE 'member' END AS role FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 7 <> 0),
t AS (SELECT s_suppkey AS track_id, s_nationkey AS org, s_suppkey AS owner FROM supplier), own AS (SELECT track_id, u AS user_id FROM t JOIN m ON t.org = m.org AND t.owner = m.u)
SELECT * FROM own UNION ALL SELECT t.track_id, m.u FROM t JOIN m USING (org) WHERE m.role <> 'member' AND t.track_id NOT IN (SELECT track_id FROM own)""")
def reminder_recipients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-22: a track's owner if that is an active member who can be reached, else the organisation's owners and admins."""
    k = F.col("c_custkey")
    members = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("org_id"), k.alias("user_id"), F.when(k % 4 == 0, "owner").when(k % 4 == 1, "admin").otherwise("member").alias("role"), (k % 5 != 0).alias("active"), F.when(k % 7 != 0, F.concat(F.lit("u"), text(k), F.lit("@example.org"))).alias("email"))
    tracks = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("track_id"), F.col("s_nationkey").alias("org_id"), F.col("s_suppkey").alias("owner_id"))
    return contracts.recipients(tracks, members)


_SETS = "list_distinct(flatten([[substr('  ' || w || ' ', i, 3) FOR i IN range(1, length(w) + 2)] FOR w IN list_filter(string_split_regex(lower({c}), '[^\\p{{L}}\\p{{Nd}}]+'), lambda x: x <> '')]))"


@query(f"""WITH {TENDER_SQL}, r AS (SELECT id, sector, closes_at, buyer || ' ' || sector AS title FROM tender), t AS (SELECT * FROM r WHERE id = (SELECT min(id) FROM r)),
s AS (SELECT r.id, r.sector = t.sector AS same, r.closes_at, {_SETS.format(c='r.title')} AS a, {_SETS.format(c='t.title')} AS b FROM r, t WHERE r.id <> t.id AND r.closes_at > TIMESTAMP '{AS_OF}'),
v AS (SELECT id, same, closes_at, len(list_intersect(a, b)) / CAST(len(list_distinct(list_concat(a, b))) AS DOUBLE) AS similarity FROM s)
SELECT id, round(similarity, 9) AS similarity, CAST(row_number() OVER (ORDER BY CASE WHEN same THEN 0 ELSE 1 END, similarity DESC, closes_at, id) AS INTEGER) AS place FROM v WHERE same OR similarity >= 0.3 QUALIFY place <= 20""")
def similar_tenders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-04, FTS-10: open tenders like one: of its sector first, then by the trigrams of the titles."""
    rows = tenders(spark, sf_dir).withColumn("title", F.concat_ws(" ", "buyer", "sector"))
    target = rows.orderBy("id").select("id", "sector", "title").first()
    found = fulltext.similar(rows, target.asDict(), 20, AS_OF)
    order = [F.col("tier"), F.desc("similarity"), F.asc_nulls_last("closes_at"), F.col("id")]
    return fulltext.numbered(found, [], order).select("id", F.round("similarity", 9).alias("similarity"), F.col("rank").cast("int").alias("place"))


@query(f"""WITH {TENDER_SQL}, r AS (SELECT *, row_number() OVER (ORDER BY closes_at NULLS LAST, id) AS k FROM tender)
SELECT CAST(id AS VARCHAR) AS tender_id, '' AS reference_no, CASE WHEN id % 2 = 0 THEN '''=' || buyer ELSE buyer END AS title, '' AS organisation_chain, buyer, category, sector, state, '' AS location, pincode, CAST(value_inr AS VARCHAR) AS value_inr, '' AS emd_inr, '' AS fee_inr,
strftime(published_at + INTERVAL 330 MINUTE, '%Y-%m-%dT%H:%M:%S+05:30') AS published_at, coalesce(strftime(closes_at + INTERVAL 330 MINUTE, '%Y-%m-%dT%H:%M:%S+05:30'), '') AS closes_at, '' AS bid_opening_at, source AS source_portal, '' AS source_url, '/tenders/' || id AS page_url FROM r WHERE k <= 10000""")
def tender_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-06, SRT-07: the nineteen columns of a spreadsheet, its limit the feature's."""
    rows = tenders(spark, sf_dir).withColumns({"tender_id": text(F.col("id")), "title": F.when(F.col("id") % 2 == 0, F.concat(F.lit("="), "buyer")).otherwise(F.col("buyer")), "page_url": F.concat(F.lit("/tenders/"), text(F.col("id")))})
    return exports.sheet(rows, [F.asc_nulls_last("closes_at"), F.col("id")])


@query("SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN s_name || ' & Sons' WHEN 1 THEN s_name WHEN 2 THEN '' ELSE '' END AS winner FROM supplier")
def road_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-13: contractors' names without trailing marks and character references; placeholders and budget heads are none."""
    raw = F.element_at(F.array(F.concat("s_name", F.lit(" &amp;  Sons ., ")), F.concat("s_name", F.lit(" -")), F.lit(" NA "), F.lit("12-")), (F.col("s_suppkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", awards.road_winner(raw).alias("winner"))


@query("""SELECT c_custkey, sha256('{"balance":"' || CASE WHEN c_custkey % 3 = 0 THEN '0' ELSE CAST(c_nationkey AS VARCHAR) END || CASE WHEN c_custkey % 2 = 0 THEN '","name":"' || c_name ELSE '' END || '"}') AS hash FROM customer""")
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HSH-01: a record's hash is that of its fields by name; absent ones don't count."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", scalars.content_hash(name=F.when(k % 2 == 0, F.col("c_name")), balance=F.when(k % 3 == 0, F.lit(0)).otherwise(F.col("c_nationkey"))).alias("hash"))


@query(f"""WITH {TENDER_SQL} SELECT id, list_filter(['sector: ' || sector, 'state: ' || state, CASE WHEN value_inr IS NOT NULL THEN 'within your size' END], lambda x: x IS NOT NULL) AS reasons FROM tender
WHERE closes_at > TIMESTAMP '{AS_OF}' AND state IN ('NATION_3', 'NATION_8', 'NATION_12', 'NATION_20') AND sector IN ('BUILDING', 'MACHINERY') AND (value_inr IS NULL OR value_inr <= 300000)""")
def recommend_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ARR-03, RUL-06: why each tender is recommended."""
    every = tenders(spark, sf_dir)
    return rules.recommended(every, every.limit(0).select("id"), AS_OF, states=["NATION_3", "NATION_8", "NATION_12", "NATION_20"], sectors=["BUILDING", "MACHINERY"], cap=300_000).select("id", "reasons")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN NULL WHEN o_orderkey % 5 = 0 AND d >= DATE '2025-04-30' THEN 'morth' WHEN o_orderkey % 2 = 0 AND d >= DATE '2026-01-03' THEN 'odisha' END AS regime
FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) + 10000 AS d FROM orders)""")
def security_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RUL-01: which schedule of additional security binds a tender, by who asks, where and when."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders")
    category = F.when(k % 3 == 0, "works").when(k % 3 == 1, "").otherwise("goods")
    return rows.select("o_orderkey", rules.regime(category, F.when(k % 5 == 0, "NHAI").otherwise("Board"), F.lit("A road"), F.when(k % 2 == 0, "Odisha").otherwise("Goa"), F.date_add(F.col("o_orderdate").cast("date"), 10000)).alias("regime"))


@query("""SELECT CAST(o_custkey AS VARCHAR) || ':' || o_orderkey AS source_id, CASE WHEN o_orderkey % 4 = 0 THEN 'Winner' WHEN o_orderstatus = 'F' THEN 'Org' ELSE '' END AS winner, CASE WHEN o_orderkey % 3 = 0 THEN DATE '2020-01-01' ELSE DATE '2026-01-01' END AS award_date
FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderkey % 6 <> 1""")
def outcomes_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RUL-05, SNK-18: what tracks that ended give for training: the first award date stays, what no longer qualifies goes."""
    k = F.col("o_orderkey")
    tracks = table(spark, sf_dir, "orders").select(
        k.alias("tender_id"), F.col("o_custkey").alias("org_id"), F.when(F.col("o_orderstatus") == "F", "won").when(F.col("o_orderstatus") == "O", "lost").otherwise("open").alias("status"), F.when(k % 6 != 1, F.col("o_totalprice")).alias("l1_amount"),
        F.col("o_totalprice").alias("value_inr"), F.lit(3).alias("num_bidders"), F.when(k % 4 == 0, " Winner ").alias("winner_name"), F.lit("Org").alias("org_name"), F.lit(True).alias("contribute"),
    )
    stored = tracks.where("tender_id % 3 = 0").select(F.concat_ws(":", text(F.col("org_id")), text(F.col("tender_id"))).alias("source_id"), F.lit("2020-01-01").cast("date").alias("award_date"))
    return contracts.outcome_rows(tracks, stored, "2026-01-01").select("source_id", "winner", "award_date")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang || chr(10) ELSE '' END || CASE WHEN doc_id % 3 = 0 THEN source || chr(10) ELSE '' END || text AS passage FROM documents")
def passages_made(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOC-05: a chunk's text behind its context and heading, where it has them."""
    k = F.col("doc_id")
    made = documents.passage(F.when(k % 2 == 0, F.col("lang")).otherwise(""), F.when(k % 3 == 0, F.col("source")).otherwise(""), F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", made.alias("passage"))
