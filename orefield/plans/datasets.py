"""Queries of award datasets as files, releases, retrieval and chunks, with their SQL twins. Files are made from the tables."""

from __future__ import annotations

import itertools
import shutil
import tempfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orefield.operators import answers, documents, exports, fulltext
from orefield.sources import awards
from orefield.sources.tables import TENDER_SQL, table, tenders
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


# ---- zipped notices ---------------------------------------------------------------------------------------------------


def archived(rows: DataFrame, folder: str, archives: int) -> None:
    """Write rows as CSV files in zip archives, two files each and a note that isn't one, a task an archive.

    Half of the rows of each batch goes to the archive at once, the other half waits in a file of the task's own, so a task
    holds a batch at a time.
    """

    def put(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, frames = 0, (f for f in frames if len(f))
        if (first := next(frames, None)) is not None:
            system, path = pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder)
            system.create_dir(path, recursive=True)
            with system.open_output_stream(f"{path}/{first['ID_NOTICE_CAN'].iloc[0]}.zip") as f, zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z, tempfile.TemporaryFile() as rest:
                with z.open("one.CSV", "w", force_zip64=True) as one:
                    for part in itertools.chain([first], frames):
                        half = len(part) // 2
                        one.write(part[:half].to_csv(index=False, quoting=1, header=not n).encode())
                        rest.write(part[half:].to_csv(index=False, header=not n).encode())
                        n += 1
                rest.seek(0)
                with z.open("two.csv", "w", force_zip64=True) as two:
                    shutil.copyfileobj(rest, two)
                z.writestr("readme.txt", "not,a,table")
        yield pd.DataFrame({"n": [n]})

    rows.repartition(archives, "ID_NOTICE_CAN").mapInPandas(put, "n long").write.format("noop").mode("overwrite").save()


@query("""SELECT CAST(o_orderkey AS VARCHAR) || ':' || CASE WHEN o_orderkey % 2 = 0 THEN 'A' || o_orderkey ELSE 'L1' END AS source_id, 'ted' AS source, 'GB' AS country, 'Board ' || o_custkey AS buyer, 'Works; in two parts' AS title, ['works', 'services', 'goods'][o_orderkey % 3 + 1] AS category, 'roads' AS sector,
['open', 'limited', 'single', 'other'][o_orderkey % 4 + 1] AS method, 'EUR' AS currency, CAST(1000 + o_orderkey AS DOUBLE) AS estimated_value, CAST(900 + o_orderkey AS DOUBLE) AS award_value, CASE WHEN o_orderkey % 5 > 0 THEN CAST(o_orderkey % 5 AS INTEGER) END AS num_bidders, 'First; Second' AS winner,
CAST(o_orderdate AS DATE) AS award_date, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders WHERE o_orderkey % 6 <> 5 AND year(o_orderdate) >= 1994""")
def notices_zipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-09, SRC-10, SRC-17, JON-23, PRJ-01: yearly archives of European notices by their registered reader, as records."""
    k = F.col("o_orderkey")
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))
    given = {
        "ID_NOTICE_CAN": k.cast("string"), "YEAR": F.year("o_orderdate").cast("string"), "DT_DISPATCH": F.date_format("o_orderdate", "dd/MM/yyyy"), "DT_AWARD": F.date_format("o_orderdate", "dd/MM/yyyy"), "CANCELLED": F.when(k % 6 == 5, "1").otherwise("0"),
        "CAE_NAME": F.concat(F.lit(" Board "), F.col("o_custkey").cast("string")), "ISO_COUNTRY_CODE": F.lit("uk"), "TYPE_OF_CONTRACT": of(["W", "S", "U"]), "CPV": F.lit("45233140"), "ID_LOT": F.lit("L1"), "ID_AWARD": F.when(k % 2 == 0, F.concat(F.lit("A"), k.cast("string"))).otherwise(" "),
        "TOP_TYPE": of(["OPE", "RES", "AWP", "COD"]), "WIN_NAME": F.lit("First---Second"), "TITLE": F.lit("Works---in two parts"), "NUMBER_OFFERS": (k % 5).cast("string"), "AWARD_EST_VALUE_EURO": (1000 + k).cast("string"), "AWARD_VALUE_EURO": (900 + k).cast("string"),
    }
    rows = table(spark, sf_dir, "orders").select(*(given.get(c, F.lit("")).alias(c) for c in awards.TED_COLUMNS))
    folder = scratch(spark, "archives")
    archived(rows, folder, 8)
    found = awards.read(spark, "ted", folder, since=1994)
    money = lambda c: F.col(c).cast("double").alias(c)
    return found.select("source_id", "source", "country", "buyer", "title", "category", "sector", "method", "currency", money("estimated_value"), money("award_value"), "num_bidders", "winner", "award_date", "year")


# ---- releases ---------------------------------------------------------------------------------------------------------


@query("""SELECT CAST(o_orderkey AS VARCHAR) || ':' || a AS source_id, 'peru' AS source, 'PE' AS country, 'Lima Norte' AS state, 'Buyer ' || o_custkey AS buyer, CASE WHEN o_orderkey % 4 = 1 THEN 'Part ' || a ELSE 'Road works' END AS title, 'works' AS category, 'roads' AS sector, 'open' AS method, 'PEN' AS currency,
CAST(CASE WHEN o_orderkey % 4 = 1 THEN CASE a WHEN 'A' THEN 400 ELSE 600 END ELSE 1000 END AS DOUBLE) AS estimated_value, CAST(CASE WHEN o_orderkey % 4 = 1 THEN CASE a WHEN 'A' THEN 390 ELSE 610 END ELSE 900 END AS DOUBLE) AS award_value, CASE WHEN o_orderkey % 4 <> 1 THEN 3 END AS num_bidders, 'X; Y' AS winner,
DATE '2020-01-02' AS tender_date, DATE '2020-03-04' AS award_date, 2020 AS year FROM orders, (SELECT unnest(['A', 'B']) AS a) WHERE o_orderkey % 4 < 3 AND (a = 'A' OR o_orderkey % 4 = 1)""")
def releases_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-08, JSN-03, JSN-04: releases from compressed JSON lines, some wrapped in a record, some broken, as records."""
    k = F.col("o_orderkey")
    key = k.cast("string")
    item = lambda n, amount: f'{{"id": "I{n}", "description": "Part {n}", "classification": {{"scheme": "cpv", "id": "45233140"}}, "totalValue": {{"amount": {amount}}}}}'
    award = lambda n, amount, items: f'{{"id": "{n}", "status": "active", "date": "2020-03-04T05:00:00Z", "value": {{"amount": {amount}, "currency": "PEN"}}, "suppliers": [{{"name": " X"}}, {{"name": "Y "}}], "items": [{items}]}}'
    both, one = f"[{award('A', 390, item('A', 400))}, {award('B', 610, item('B', 600))}]", f"[{award('A', 900, item('A', 400) + ', ' + item('B', 600))}]"
    tender = f'{{"title": "Road works", "procurementMethod": "open", "mainProcurementCategory": "works", "numberOfTenderers": 3, "datePublished": "2020-01-02T00:00:00Z", "value": {{"amount": 1000, "currency": "PEN"}}, "items": [{item("A", 400)}, {item("B", 600)}]}}'
    body = F.concat(
        F.lit('{"ocid": "'), key, F.lit('", "buyer": {"id": "b", "name": "Buyer '), F.col("o_custkey").cast("string"), F.lit('"}, "parties": [{"id": "s", "roles": ["supplier"], "address": {"region": "CUSCO"}}, {"id": "b", "roles": ["buyer"], "address": {"region": "LIMA norte"}}], "tender": '),
        F.lit(tender), F.lit(', "awards": '), F.when(k % 4 == 1, both).otherwise(one), F.lit("}"),
    )
    line = F.when(k % 4 == 3, F.concat(F.lit("not a release "), key)).when(k % 4 == 2, F.concat(F.lit('{"compiledRelease": '), body, F.lit("}"))).otherwise(body)
    folder = scratch(spark, "releases")
    table(spark, sf_dir, "orders").select(line.alias("value")).write.option("compression", "gzip").text(folder)
    found = awards.ocds_records(awards.releases(spark, folder).where("bad is null"), "PE", "PEN", "peru", since=2019)
    money = lambda c: F.col(c).cast("double").alias(c)
    return found.select("source_id", "source", "country", "state", "buyer", "title", "category", "sector", "method", "currency", money("estimated_value"), money("award_value"), "num_bidders", "winner", "tender_date", "award_date", "year")


@query(f"""WITH {TENDER_SQL}, t AS (SELECT *, CAST(id AS VARCHAR) AS key FROM tender)
SELECT id, 'ocds-x-' || source || '-T' || key AS ocid, CASE WHEN id % 3 = 0 THEN 'tender,award' ELSE 'tender' END AS tags, CAST(CASE WHEN id % 3 = 0 THEN 2 ELSE 1 END AS INTEGER) AS parties, CASE WHEN closes_at >= TIMESTAMP '1995-01-01' THEN 'active' END AS status,
CASE WHEN value_inr > 50000 THEN CAST(value_inr AS DOUBLE) END AS value, CASE WHEN id % 2 = 0 THEN 'works' END AS category, CASE WHEN id % 3 = 0 THEN CAST(id + 10 AS DOUBLE) END AS paid, id % 2 <> 0 AS no_category_key, 'India' AS country FROM t""")
def release_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-07: open contracting releases as a reader of the JSON finds them: what is unknown isn't there."""
    rows = tenders(spark, sf_dir).select(
        "id", "source", F.concat(F.lit("T"), F.col("id").cast("string")).alias("tender_id"), F.concat(F.lit("Work "), F.col("id").cast("string")).alias("title"), "buyer", "buyer_id", "state", "pincode", F.when(F.col("id") % 2 == 0, "Works").otherwise("Other").alias("category"),
        F.when(F.col("value_inr") > 50000, F.col("value_inr")).alias("value_inr"), "published_at", "closes_at", F.lit("abcdef0123456789ff").alias("content_hash"),
    )
    won = rows.where("id % 3 = 0").select("id", F.col("id").alias("award_id"), F.lit("Builder").alias("supplier"), F.lit("builder").alias("supplier_key"), (F.col("id") + 10).cast("double").alias("amount"), F.lit("2000-01-01").cast("date").alias("award_date"))
    made = exports.packages(rows, won, "ocds-x", "1995-01-01 00:00:00")
    at = lambda path: F.get_json_object("release", path)
    return made.select(
        "id", at("$.ocid").alias("ocid"), F.array_join(F.from_json(at("$.tag"), "array<string>"), ",").alias("tags"), F.json_array_length(at("$.parties")).alias("parties"), at("$.tender.status").alias("status"), at("$.tender.value.amount").cast("double").alias("value"),
        at("$.tender.mainProcurementCategory").alias("category"), at("$.awards[0].value.amount").cast("double").alias("paid"), (~F.contains("release", F.lit("mainProcurementCategory"))).alias("no_category_key"), at("$.parties[0].address.countryName").alias("country"),
    )


# ---- retrieval --------------------------------------------------------------------------------------------------------


@query("SELECT conv_id, CAST(1 AS INTEGER) AS n, 'The earnest money is Rs. ' || (conv_id + 500) || ' in all.' AS sentence FROM conversations WHERE turn = 0")
def answers_extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ANS-01: of each conversation's turns, as passages, the sentence that answers a question; other turns have nothing of it."""
    turns = table(spark, sf_dir, "conversations")
    said = F.when(F.col("turn") == 0, F.concat(F.col("text"), F.lit("\nThe earnest money is Rs. "), (F.col("conv_id") + 500).cast("string"), F.lit(" in all."))).otherwise(F.regexp_replace("text", "[0-9]", ""))
    hits = turns.select("conv_id", (F.col("turn") + 1).cast("int").alias("n"), said.alias("text"))
    return answers.extractive_each(hits, "conv_id", "How much bid security has to be paid?").select("conv_id", "n", "sentence")


_TOKENS = "list_filter(string_split_regex(lower({c}), '[^\\p{{L}}\\p{{Nd}}]+'), lambda x: x <> '')"


_FORMS = f"list_distinct([w, regexp_replace(w, '^([a-z]{{3,}}?)(?:{'|'.join(fulltext.ENDINGS)})$', '\\1')])"


@query(f"""WITH t AS (SELECT doc_id AS id, lang, {_TOKENS.format(c='source')} AS h, {_TOKENS.format(c='text')} AS ws FROM documents WHERE doc_id % 2 = 0),
f AS (SELECT id, ws, flatten([{_FORMS} FOR w IN ws]) AS fs FROM t),
n AS (SELECT id, len(ws) AS size, len(list_filter(fs, lambda w: starts_with(w, 'thanea'))) AS a, len(list_filter(fs, lambda w: starts_with(w, 'anon'))) AS b FROM f),
s AS (SELECT id, (CASE WHEN a > 0 THEN 0.4 * (1 + ln(a)) ELSE 0 END + CASE WHEN b > 0 THEN 0.4 * (1 + ln(b)) ELSE 0 END) / (1 + ln(1 + size)) AS score FROM n WHERE a + b > 0)
SELECT id, CAST(row_number() OVER (ORDER BY round(score, 12) DESC, id) AS INTEGER) AS rank FROM s QUALIFY rank <= 50""")
def chunks_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-02, FTS-13: chunks with any of a question's words, short ones before long ones; fifty, as a question takes."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("").alias("heading"), "text", F.lit(1).alias("organization_id"), F.when(F.col("doc_id") % 2 == 0, "ready").otherwise("failed").alias("status"))
    found = answers.lexical(answers.within(docs, 1), "Where is the thanea or anon?", scoped=True)
    return found.select("id", F.col("rank").cast("int").alias("rank"))


@query()
def chunks_retrieved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EMB-01, RET-01, RRF-01: chunks by words and by hashed vectors, fused; the best five of a question."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("").alias("heading"), "text", F.lit("").alias("context"))
    found = answers.retrieve(answers.embed(docs, "text", 64), "thanea anon", "hybrid", size=64, scoped=True)
    return found.select("id", F.round("score", 12).alias("score"))


# ---- lines of documents -----------------------------------------------------------------------------------------------

_LINE = "trim(raw, ' \t\n\r')"


@query(rf"""WITH p AS (SELECT conv_id AS doc_id, turn + 1 AS page, 'Conversation ' || conv_id || chr(10) || text || chr(10) || CASE WHEN turn % 3 = 1 THEN 'SCHEDULE OF WORKS' || chr(10) ELSE '4.' || turn || ' Clause' || chr(10) END || 'Turn ' || (turn + 1) AS text FROM conversations),
l AS (SELECT doc_id, page, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ord, unnest(string_split(text, chr(10))) AS raw FROM p),
m AS (SELECT doc_id, page, ord, {_LINE} AS line, regexp_replace({_LINE}, '\d+', '#', 'g') AS masked FROM l WHERE {_LINE} <> ''),
n AS (SELECT doc_id, count(*) AS pages FROM p GROUP BY doc_id), r AS (SELECT doc_id, masked FROM (SELECT doc_id, masked, count(DISTINCT page) AS k FROM m GROUP BY doc_id, masked) JOIN n USING (doc_id) WHERE pages >= 3 AND k >= greatest(3, 0.6 * pages)),
k AS (SELECT m.* FROM m LEFT JOIN r ON m.doc_id = r.doc_id AND m.masked = r.masked WHERE r.masked IS NULL),
c AS (SELECT *, length(regexp_replace(line, '\P{{L}}', '', 'g')) AS letters, length(regexp_replace(line, '\P{{Lu}}', '', 'g')) AS capitals FROM k)
SELECT doc_id, page, CAST(ord AS INTEGER) AS ord, line, length(line) <= 90 AND ((regexp_matches(line, '^\s*\d{{1,2}}(\.\d{{1,2}}){{0,3}}[.)]?\s+\S') AND length(line) < 90) OR regexp_matches(line, '^\s*(?i:Section|Clause|Annexure|Schedule|Chapter|Part|Appendix)\b')
  OR (letters >= 6 AND capitals / letters > 0.8 AND len(string_split_regex(line, '\s+')) <= 10)) AS heading FROM c""")
def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOC-01, DOC-02, AGG-21: lines of conversations as documents of a page a turn, without what runs through them, and
    which of them are headings."""
    turns = table(spark, sf_dir, "conversations")
    part = F.when(F.col("turn") % 3 == 1, "SCHEDULE OF WORKS\n").otherwise(F.concat(F.lit("4."), F.col("turn").cast("string"), F.lit(" Clause\n")))
    said = F.concat(F.lit("Conversation "), F.col("conv_id").cast("string"), F.lit("\n"), "text", F.lit("\n"), part, F.lit("Turn "), (F.col("turn") + 1).cast("string"))
    pages = turns.select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("page"), said.alias("text"))
    return documents.lines(pages).select("doc_id", "page", "ord", "line", "heading")
