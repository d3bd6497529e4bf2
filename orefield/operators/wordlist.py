"""A kept list of words with the documents they occur in, and postings of their trigrams, for correcting typing errors.

Both are tables in buckets: a batch of documents rewrites the buckets of its words only, and a question reads only the
buckets of its words' trigrams, so neither grows with the list. Words are those of three letters or more, a to z only.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orefield.operators.bucketed import BucketedTable, Change
from orefield.operators.fulltext import UNCORRECTED, trigrams, vocabulary
from orefield.operators.stemming import stems
from orefield.storage import delete, scratch, written

#: So many words nearest by trigrams are candidates; words this long may have two errors, shorter ones one.
CANDIDATES, LONG, LEAST = 100, 6, 3
WORD = "^[a-z]+$"


class WordList:
    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        folder = folder.rstrip("/")
        self.spark = spark
        self.words = BucketedTable(spark, f"{folder}/words", "word string, ndoc long", ["word"], buckets)
        #: size: how many trigrams the word has.
        self.grams = BucketedTable(spark, f"{folder}/grams", "gram string, word string, size int", ["gram", "word"], buckets, bucket_by=["gram"])

    def add(self, docs: DataFrame, text: str, by: str, batch: int) -> Change:
        """Count a batch of new documents in. Batches are numbered; one that is delivered again changes nothing.

        Postings are written first and only for words that aren't there: a job that is lost in between finds them when
        the batch comes again.
        """
        if batch <= self.words.last_batch():
            return Change()
        counted = vocabulary(docs, text, by).where(F.col("word").rlike(WORD) & (F.length("word") >= LEAST))
        place = scratch(self.spark, "counted")
        counted = written(counted, place)  # asked for several times
        known = self.words.read_for(counted)
        fresh = counted.join(known, "word", "left_anti").select("word", trigrams(F.col("word")).alias("g"))
        self.grams.upsert(fresh.select(F.explode("g").alias("gram"), "word", F.size("g").alias("size")))
        change = self.words.upsert(counted, batch=batch, merge={"ndoc": lambda old, new: F.coalesce(old, F.lit(0)) + new})
        delete(self.spark, place)
        return change

    def _posted(self, grams: DataFrame) -> DataFrame:
        """(gram, word, size) of some trigrams; grams: a question's few."""
        return self.grams.read_for(grams).join(F.broadcast(grams.select("gram").distinct()), "gram")

    def begun(self, heads: list[str]) -> set[str]:
        """Those of the heads that a word of the list begins with; heads are a question's few words and stems."""
        if not heads:
            return set()
        # a word's first two letters are a trigram with a blank before it; three letters are one wherever they stand
        keyed = [(h, h[:3] if len(h) >= 3 else f"  {h}"[-3:]) for h in heads]
        asked = self.spark.createDataFrame(keyed, "head string, gram string")
        found = self._posted(asked).join(F.broadcast(asked), "gram").where(F.expr("startswith(word, head)"))
        return {r["head"] for r in found.select("head").distinct().collect()}

    def nearest(self, words: list[str]) -> DataFrame:
        """(asked, word, distance): for each word the CANDIDATES of the list with the least trigram distance; ties by word."""
        asked = self.spark.createDataFrame([(w,) for w in words], "asked string").select("asked", trigrams(F.col("asked")).alias("g"))
        grams = asked.select("asked", F.size("g").alias("own"), F.explode("g").alias("gram"))
        shared = self._posted(grams).join(F.broadcast(grams), "gram").groupBy("asked", "word").agg(F.count(F.lit(1)).alias("both"), F.first("own").alias("own"), F.first("size").alias("size"))
        scored = shared.select("asked", "word", (1 - F.col("both") / (F.col("own") + F.col("size") - F.col("both"))).alias("distance"))
        place = F.row_number().over(W.partitionBy("asked").orderBy("distance", "word"))
        return scored.withColumn("k", place).where(F.col("k") <= CANDIDATES).drop("k")

    def corrections(self, words: list[str]) -> DataFrame:
        """(word, fixed, edits) for each word that no word of the list begins with, nor with its stem, and that one of its
        candidates is near enough to: the nearest by edits, then the most frequent, then by alphabet."""
        asked = sorted({w for w in words if re.fullmatch(f"[a-z]{{{LEAST},}}", w)} - set(UNCORRECTED))
        none = self.spark.createDataFrame([], "word string, fixed string, edits int")
        if not asked:
            return none
        stem = {r["word"]: r["stem"] for r in stems(self.spark.createDataFrame([(w,) for w in asked], "word string")).collect()}
        begun = self.begun(sorted({*asked, *stem.values()}))
        unknown = [w for w in asked if w not in begun and stem[w] not in begun]
        if not unknown:
            return none
        most = F.when(F.length("asked") >= LONG, 2).otherwise(1)
        near = self.nearest(unknown).withColumn("edits", F.levenshtein("word", "asked")).where(F.col("edits") <= most)
        counted = near.join(self.words.read_for(near), "word")
        best = F.min(F.struct("edits", -F.col("ndoc"), "word"))
        return counted.groupBy(F.col("asked").alias("asked")).agg(best.alias("b")).select(F.col("asked").alias("word"), F.col("b.word").alias("fixed"), F.col("b.edits").alias("edits"))

    def corrected(self, text: str) -> str:
        """The text with each unknown word replaced by its correction, if there is one."""
        words = {w.lower() for w in re.findall(r"[^\W\d_]+", text)} - {"or"}
        fixes = {r["word"]: r["fixed"] for r in self.corrections(sorted(words)).collect()}  # a question's few words
        return re.sub(r"[^\W\d_]+", lambda m: fixes.get(m[0].lower(), m[0]), text) if fixes else text
