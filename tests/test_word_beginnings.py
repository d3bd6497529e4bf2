from pyspark.sql import functions as F

from orefield.operators import fulltext


def test_rows_go_before_they_are_cut_into_words(spark):
    """A word inside another one, or a negated one, is enough to leave a row out by its text alone."""
    texts = ["gathering of the ration", "of the tions", "Ering, of the", "ering without of the", "ering herewith of the"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    asked = fulltext.stemmed(fulltext.parse_question('ering or tion "of the" -with'))
    left = df.where(fulltext.may_match({"text": "D"}, asked)).select("id").collect()
    assert sorted(r.id for r in left) == [1, 2, 4]
    found = fulltext.search_rows(df, fulltext.parse_question('ering or tion "of the" -with'), {"text": "D"})
    assert sorted(r.id for r in found.where(F.col("n_terms") > 0).collect()) == [1, 2, 4]
