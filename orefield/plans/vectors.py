"""Queries of vector search, rank fusion and retrieval metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orefield.operators import retrieval
from orefield.sources.tables import table

SQL: dict[str, str] = {}
QUERIES = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.strip()
        return f

    return keep


_COS = "list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"


@query(f"""SELECT e.vec_id, round(1 - {_COS}, 9) AS distance FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.vec_id <> 0 ORDER BY 1 - {_COS}, e.vec_id LIMIT 50""")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VEC-01, SRT-06."""
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id = 0").select("embedding").first()[0]
    found = retrieval.dense(vectors.where("vec_id <> 0"), asked, 50, "vec_id")
    return found.select("vec_id", F.round("distance", 9).alias("distance"))


@query("""WITH a AS (SELECT vec_id AS id, row_number() OVER (ORDER BY label, vec_id) AS r FROM embeddings ORDER BY r LIMIT 50), b AS (SELECT vec_id AS id, row_number() OVER (ORDER BY label DESC, vec_id) AS r FROM embeddings ORDER BY r LIMIT 50),
c AS (SELECT vec_id AS id, row_number() OVER (ORDER BY vec_id) AS r FROM embeddings ORDER BY r LIMIT 50)
SELECT id, round(sum(1.0 / (60 + r)), 12) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) GROUP BY id""")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RRF-01, WIN-03."""
    v = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id")
    lists = [retrieval.ranked(v, order, 50) for order in ([F.col("label"), F.col("id")], [F.desc("label"), F.col("id")], [F.col("id")])]
    return retrieval.fuse(*lists).select("id", F.round("score", 12).alias("score"))


@query("""WITH q AS (SELECT * FROM embeddings WHERE vec_id % 50 = 0), r AS (SELECT q.vec_id AS q, q.label AS want, e.label AS got, row_number() OVER (PARTITION BY q.vec_id ORDER BY 1 - list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), e.vec_id) AS k
FROM q JOIN embeddings e ON e.vec_id <> q.vec_id), f AS (SELECT q, min(k) FILTER (want = got AND k <= 10) AS first FROM r GROUP BY q)
SELECT count(*) AS questions, round(avg(CASE WHEN first <= 5 THEN 1.0 ELSE 0.0 END), 9) AS recall_at_5, round(avg(coalesce(1.0 / first, 0.0)), 9) AS mrr_at_10 FROM f""")
def recall_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-20: every fiftieth vector asks, all answer."""
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id % 50 = 0")
    hits = retrieval.dense_many(vectors, asked, 10, "vec_id")
    want, got = vectors.select(F.col("vec_id").alias("query"), F.col("label").alias("want")), vectors.select("vec_id", "label")
    judged = hits.join(want, "query").join(got, "vec_id").withColumn("relevant", F.col("want") == F.col("label"))
    m = retrieval.metrics(judged)
    return m.select("questions", F.round("recall_at_5", 9).alias("recall_at_5"), F.round("mrr_at_10", 9).alias("mrr_at_10"))
