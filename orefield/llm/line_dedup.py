"""Line dedup by overlapping three-line windows, in DataFrame operations only.

Each run of three consecutive lines of a document is hashed. A window found more than once, anywhere, keeps its first
occurrence, by (identifier, position); the lines that later occurrences cover are merged and removed.

Defined results: lines are cut at line feeds and compared exactly; windows without a visible character don't count;
documents of fewer than three lines have no window and stay as they are, as do null and empty texts; a null identifier
comes after all others; documents of one identifier are ordered by a hash of their text, and rows alike in both are one
document, so they lose the same lines; all other columns are kept, whatever their names, but n_lines and n_removed are
replaced; a very long text is one row of many windows. Windows and rows are told apart by 128-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orefield.llm.common import own_name, row_key

WINDOW = 3
LAST = (1 << 63) - 1


def _windows(lines: Column) -> Column:
    """(hash, position) of each window; an empty array if there is none."""
    at = lambda i, k: F.element_at(lines, (i + (k + 1)).cast("int"))
    places = F.sequence(F.lit(0), F.size(lines) - WINDOW)
    visible = lambda i: at(i, 0).rlike(r"\S") | at(i, 1).rlike(r"\S") | at(i, 2).rlike(r"\S")
    return F.when(F.size(lines) >= WINDOW, F.transform(F.filter(places, visible), lambda i: F.struct(row_key(at(i, 0), at(i, 1), at(i, 2)).alias("h"), i.alias("pos"))))


def repeated_windows(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Later occurrences: row key and position.

    A window's first occurrence is found with partial minima in each task. The join back deals a hot window's occurrences
    (three numbers each) to one partition, which adaptive execution splits once it is large, since the other side has one
    row for it.
    """
    lines = df.select(F.coalesce(doc_id, F.lit(LAST)).cast("long").alias("doc"), row_key(F.col(doc_id), F.col(text)).alias("row"), F.split(text, "\n").alias("lines")).where(F.size("lines") >= WINDOW)
    spots = lines.select("doc", "row", F.explode(_windows(F.col("lines"))).alias("w")).select("w.h", "doc", "row", "w.pos")
    # the order of an occurrence, as the three numbers of its place
    place = F.struct("doc", "row", "pos")
    first = spots.groupBy("h").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last")
    return spots.join(first.select("h", "first"), "h").where(place != F.col("first")).select("row", "pos")


def dedup_lines(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """df with the repeated lines out of `text`, and how many lines each text had and lost (n_lines, n_removed)."""
    row, starts, lines, kept = (own_name(df, n) for n in ("row", "starts", "lines", "stay"))
    later = repeated_windows(df, text, doc_id).groupBy(F.col("row").alias(row)).agg(F.collect_set("pos").alias(starts))
    marked = df.drop("n_lines", "n_removed").withColumn(row, row_key(F.col(doc_id), F.col(text))).join(later, row, "left")
    covered = F.array_distinct(F.flatten(F.transform(starts, lambda p: F.sequence(p, p + (WINDOW - 1)))))
    marked = marked.withColumn(lines, F.split(text, "\n"))
    cut = marked.withColumn(kept, F.when(F.col(starts).isNotNull(), F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), covered)))
    new_text = F.when(F.col(kept).isNull(), F.col(text)).otherwise(F.array_join(F.transform(kept, lambda i: F.element_at(F.col(lines), i + 1)), "\n"))
    n_lines = F.when(F.col(text).isNull(), 0).otherwise(F.size(lines)).cast("long")
    n_removed = F.when(F.col(kept).isNull(), 0).otherwise(F.size(lines) - F.size(kept)).cast("long")
    order = [F.col(f"`{c}`") if c != text else new_text.alias(text) for c in df.columns if c not in ("n_lines", "n_removed")]
    return cut.select(*order, n_lines.alias("n_lines"), n_removed.alias("n_removed"))


#: What DuckDB gives for the same rows; identifiers are taken to be unique here.
ORACLE = r"""
WITH lines AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
spots AS (
  SELECT doc_id, p - 1 AS pos, l[p] || chr(10) || l[p + 1] || chr(10) || l[p + 2] AS w
  FROM (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS p FROM lines WHERE len(l) >= 3)
  WHERE regexp_matches(l[p] || l[p + 1] || l[p + 2], '\S')
),
later AS (SELECT doc_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY w ORDER BY doc_id, pos) AS n FROM spots) WHERE n > 1),
covered AS (SELECT doc_id, list(DISTINCT pos + k) AS gone FROM later, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
kept AS (
  SELECT d.doc_id, d.text, l, gone,
    [l[i] FOR i IN range(1, len(l) + 1) IF NOT list_contains(gone, i - 1)] AS stay
  FROM lines d LEFT JOIN covered c ON d.doc_id = c.doc_id
)
SELECT doc_id, CASE WHEN gone IS NULL THEN text ELSE coalesce(array_to_string(stay, chr(10)), '') END AS text,
  CAST(coalesce(len(l), 0) AS BIGINT) AS n_lines,
  CAST(CASE WHEN gone IS NULL THEN 0 ELSE len(l) - len(stay) END AS BIGINT) AS n_removed
FROM kept
"""
