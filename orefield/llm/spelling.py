"""Spelling variants by an errata trie, in DataFrame operations.

Words are counted over whole texts; the frequent ones make up a trie, which is kept as a table of its branching nodes
(prefix, heavy child): the child with the most words below it continues the heavy path, the others, and a word's end, are
light. Each light subtree is merged into what hangs beside it, with one character of its words replaced or skipped, small
to large: a word takes part only where it leaves a heavy path, at most log2(words) + 1 times, however long it is.
At such a node, after a prefix, a word whose next character is light is offered

* with it replaced by the heavy character: the heavy subtree's words that differ by it,
* without it: words that it has one character more than,
* with the heavy character put in before it: words of the heavy subtree that have one character more,
* with any character in its place: words of the other light subtrees, of which there is one for each character at most.

Terminals that coincide, by equality of the offered string with a word, are the pairs one edit apart; every such pair is
found, since one of its two words leaves the heavy path where they part. (An edit in a run of one character counts at the
run's end.) All joins are on whole words or prefixes; a node's partners number at most its alphabet.

Defined results: null and empty texts have no words; a null identifier counts as an empty one in the perturbation's hash;
repeated rows count each; ties of n go to the smallest word in code-point order; an empty table gives no rows; very long
texts and words are worked on whole; other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orefield.llm.common import discard, materialize

LETTER = "[A-Za-z\\u00C0-\\u00FF]"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters that a word can have: 26 small ones and À to ÿ.
ALPHABET = len(SMALL) + 0xFF - 0xC0 + 1
LEAST_LENGTH, LEAST_COUNT, FORM_RATIO, DELETED_OF = 6, 5, 5, 199
#: Branching nodes after at most so many characters, of which there are at most 1 + ALPHABET + ALPHABET ** 2, are sent to
#: all tasks: many words share each of them.
SHORT = 2
#: What stands for any character.
ANY = "\u0000"
#: n grows FORM_RATIO times with each form, so no chain is longer than 27, and five doublings follow any.
MOST_DOUBLINGS = 8


def perturbed(doc_id: Column, run: Column, one_of: int = DELETED_OF) -> Column:
    """The run without one character, if a hash of the identifier and the run says so."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = F.pmod(h, F.length(run)).cast("int")
    return F.when(F.pmod(h, F.lit(one_of)) == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def vocabulary(df: DataFrame, text: str = "text", doc_id: str = "doc_id", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): the frequent words of all texts, counted in each task before the shuffle."""
    long_runs = F.regexp_extract_all(F.col(text), F.lit(f"{LETTER}{{{least_length},}}"), F.lit(0))
    runs = df.select(F.col(doc_id).alias("doc"), F.explode(long_runs).alias("run"))
    lower = F.when(F.col("run").rlike("[A-Z]"), F.translate("run", CAPITALS, SMALL)).otherwise(F.col("run"))
    words = runs.select("doc", lower.alias("run")).select(perturbed(F.col("doc"), F.col("run")).alias("word"))
    counted = words.where(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= least_count)


def _edges(words: DataFrame) -> DataFrame:
    """(word, at, prefix, child) of a word's way through the trie; the last child is the end, an empty string."""
    at = F.explode(F.sequence(F.lit(0), F.length("word"))).alias("at")
    return words.select("word", at).select("word", "at", F.substring(F.col("word"), F.lit(1), F.col("at")).alias("prefix"), F.substring(F.col("word"), F.col("at") + 1, F.lit(1)).alias("child"))


def heavy_children(words: DataFrame) -> DataFrame:
    """(prefix, heavy) of the trie's branching nodes: the child with the most words, of equal ones the last character.

    An end is never heavy, since it weighs one and comes before all characters.
    """
    weights = _edges(words).groupBy("prefix", "child").agg(F.count(F.lit(1)).alias("n"))
    nodes = weights.groupBy("prefix").agg(F.max(F.struct("n", "child"))["child"].alias("heavy"), F.count(F.lit(1)).alias("children"))
    return nodes.where("children > 1").select("prefix", "heavy")


def light_edges(words: DataFrame) -> DataFrame:
    """(word, at, child, heavy): where each word leaves a heavy path."""
    heavy = materialize(heavy_children(words), "heavy")
    edges, short = _edges(words), F.length("prefix") <= SHORT
    near_root = edges.where(F.col("at") <= SHORT).join(F.broadcast(heavy.where(short)), "prefix")
    deeper = edges.where(F.col("at") > SHORT).join(heavy.where(~short), "prefix")
    found = near_root.unionByName(deeper).where(F.col("child") != F.col("heavy")).select("word", "at", "child", "heavy")
    found = materialize(found, "light")
    discard(heavy)
    return found


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, other): the words that differ by exactly one inserted, deleted or replaced character, each pair both ways.

    words: distinct, in a column `word`; read several times.
    """
    words = words.select("word")
    light = light_edges(words)
    at, word, heavy, ends = F.col("at"), F.col("word"), F.col("heavy"), F.col("child") == ""
    head, here, rest = F.substring(word, F.lit(1), at), F.substring(word, at + 1, F.length(word)), F.substring(word, at + 2, F.length(word))
    offers = F.array(F.when(~ends, F.concat(head, heavy, rest)), F.when(~ends, F.concat(head, rest)), F.concat(head, heavy, here))
    offered = light.select("word", F.explode(F.array_compact(offers)).alias("other"))
    met = offered.join(words.withColumnRenamed("word", "other"), "other").select("word", "other")
    beside = light.where(~ends).select("word", F.concat(head, F.lit(ANY), rest).alias("key"))
    shared = beside.join(beside.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "key")
    # a key's words differ in the one character: at most ALPHABET of them
    siblings = shared.join(shared.select("key", F.col("word").alias("other")), "key").where("word < other").select("word", "other")
    one_way = met.union(siblings)
    return one_way.union(one_way.select("other", "word")).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the end of each chain of forms, by doubling; forms: (word, form) without nulls."""
    now = materialize(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("went")), "chains")
    for _ in range(MOST_DOUBLINGS):
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        doubled = now.select("word", "root").join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("went"))
        last, now = now, materialize(doubled, "chains")
        discard(last)
        if now.where("went").isEmpty():
            break
    return now.select("word", "root")


def variants(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(word, n, n_near, form, form_n, root) of each frequent word; see the contract of op11 for the columns."""
    words = materialize(vocabulary(df, text, doc_id), "vocabulary")
    pairs = near_pairs(words)
    other = words.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    # the most frequent one, then the smallest: by the largest n, and of these the least word
    best = F.min(F.struct((-F.col("other_n")).alias("less"), "other"))
    near = pairs.join(other, "other").groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    is_form = -F.col("best.less") >= FORM_RATIO * F.col("n")
    found = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.other")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n"))
    found = materialize(found, "forms")
    discard(words)
    ends = roots(found.where("form is not null").select("word", "form"))
    return found.join(ends, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


#: One byte for each of À to ÿ, so that a byte is a character, for SQL that counts edits in bytes.
_ACCENTED = "".join(map(chr, range(0xC0, 0x100)))
_STAND_INS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ!#$%&()*+,-./:;<=>?@[]^_{|}~"

#: What DuckDB gives for the same rows, by the edit distance of all pairs of words.
ORACLE = f"""
WITH RECURSIVE tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) r(i))),
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{{LEAST_LENGTH},}}')), '{CAPITALS}', '{SMALL}') AS run FROM documents),
seen AS (SELECT doc_id, run, count(*) AS c FROM runs GROUP BY ALL),
coded AS (SELECT run, c, flatten([CASE WHEN unicode(x) < 128 THEN [unicode(x)] ELSE [195, unicode(x) - 64] END FOR x IN string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, '')]) AS bytes FROM seen),
hashed AS (SELECT run, c, xor(list_reduce([4294967295] || list_transform(bytes, lambda b: CAST(b AS BIGINT)), lambda h, b: xor(t[CAST(xor(h, b) % 256 + 1 AS INTEGER)], h // 256)), 4294967295) AS h FROM coded, tab),
cut AS (SELECT CASE WHEN h % {DELETED_OF} = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM hashed),
words AS (SELECT word, CAST(sum(c) AS BIGINT) AS n, translate(word, '{_ACCENTED}', '{_STAND_INS}') AS code FROM cut WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(c) >= {LEAST_COUNT}),
near AS (SELECT a.word, b.word AS other, b.n AS other_n FROM words a JOIN words b ON abs(length(a.code) - length(b.code)) <= 1 AND a.word <> b.word WHERE levenshtein(a.code, b.code) = 1),
best AS (SELECT word, count(*) AS n_near, min({{'less': -other_n, 'other': other}}) AS b FROM near GROUP BY word),
found AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.less >= {FORM_RATIO} * w.n THEN b.other END AS form, CASE WHEN -b.less >= {FORM_RATIO} * w.n THEN -b.less END AS form_n FROM words w LEFT JOIN best USING (word)),
chain AS (SELECT word, coalesce(form, word) AS root, form IS NULL AS done FROM found UNION ALL SELECT c.word, coalesce(f.form, c.root), f.form IS NULL FROM chain c JOIN found f ON f.word = c.root WHERE NOT c.done)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM found f JOIN chain c ON c.word = f.word AND c.done
"""
