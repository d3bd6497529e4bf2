"""Secret scans: candidates by pattern, false positives removed by a random forest, in DataFrame operations only.

A candidate is a run of 16 or more characters of keys and tokens that has a digit, or stands after a word for a
credential and a sign of assignment. The forest looks at its length, its character transitions (mean log likelihood of
its character pairs in the corpus's own words, and how often the kind of character changes), how much of it dictionary
words cover, whether it is part of a path, and the words around it. It is trained from labelled findings; without a
table of them, from findings made by `made_findings`, of known kinds of secrets and of look-alikes.

Defined results: null and empty texts have no candidates; a candidate's `start` counts code points from 0; candidates
without letters are no dictionary words; repeated rows each give their findings; a text or candidate of any length costs
time in proportion to it; all other columns but the text are kept, and those named like an output are replaced; a score
at the limit is a secret; an empty table gives none.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orefield.llm.common import let, materialize, own_name

#: What keys and tokens are written in.
CANDIDATE = r"[A-Za-z0-9_+/-]{16,}(?:\.[A-Za-z0-9_+/-]{6,})*={0,2}"
SECRET_WORDS = r"(?i)(token|secret|passw|pwd|api.?key|access.?key|auth|bearer|credential|private.?key|client.?key)"
OTHER_WORDS = r"(?i)(commit|sha-?\d|md5|hash|digest|checksum|uuid|guid|revision|version|example|sample|placeholder|file|path|url|number|card|phone|serial)"
ASSIGNED = r"[=:>]\s*['\"]?$"
BEFORE, AFTER = 40, 24
#: A dictionary word has at least so many letters and occurs at least so often in the corpus.
WORD_MIN, WORD_COUNT = 3, 20
LETTERS = "abcdefghijklmnopqrstuvwxyz"
KINDS = len(LETTERS) + 2
FEATURES = ("length", "pair_likelihood", "switches", "digits", "uppers", "distinct", "coverage", "in_path", "secret_near", "other_near", "assigned", "quoted")
TREES, DEPTH, SEED = 30, 7, 11
LIMIT = 0.5
#: How many findings are made for training, of each of the 16 kinds.
MADE_PER_KIND = 250


#: Lengths are summed up in stretches of so many, so that many candidates don't each add up all before them.
STRETCH = 256


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0), lambda a, b: a + b)


def _before(sizes: Column, stretches: Column, i: Column) -> Column:
    """The sum of the first i sizes; stretches: _stretches(sizes)."""
    whole = F.floor(i / STRETCH).cast("int")
    return F.get(stretches, whole) + _sum(F.slice(sizes, whole * STRETCH + 1, i - whole * STRETCH))


def _stretches(sizes: Column) -> Column:
    """The sums of the sizes before each stretch."""
    n = F.floor(F.size(sizes) / STRETCH).cast("int")
    each = F.transform(F.sequence(F.lit(0), n), lambda k: _sum(F.slice(sizes, k * STRETCH + 1, F.lit(STRETCH))))
    return let(each, lambda e: F.transform(F.sequence(F.lit(0), n), lambda k: _sum(F.slice(e, F.lit(1), k))))


def candidates(df: DataFrame, text: str = "text") -> DataFrame:
    """One row per candidate: df's columns but its text, and ordinal, start, value, before, after."""
    kept = [F.col(f"`{c}`") for c in df.columns if c not in (text, "ordinal", "start", "value", "before", "after")]
    c, p, s, t = (own_name(df, n) for n in ("found", "between", "sizes", "sums"))
    found = df.where(F.col(text).rlike(CANDIDATE)).select(*kept, F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)).alias(c), F.split(text, CANDIDATE, -1).alias(p))
    placed = found.withColumn(s, F.zip_with(c, F.slice(p, F.lit(1), F.size(c)), lambda x, y: F.length(x) + F.length(y))).withColumn(t, _stretches(F.col(s)))
    spot = lambda x, i: F.struct(
        i.alias("ordinal"), (_before(F.col(s), F.col(t), i) + F.length(F.get(p, i))).alias("start"), x.alias("value"),
        F.right(F.get(p, i), F.lit(BEFORE)).alias("before"), F.left(F.get(p, i + 1), F.lit(AFTER)).alias("after"),
    )
    hit = lambda x: x["value"].rlike(r"\d") | (x["before"].rlike(SECRET_WORDS) & x["before"].rlike(ASSIGNED))
    return placed.select(*kept, F.inline(F.filter(F.transform(c, spot), hit)))


def dictionary(df: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): words of the corpus, lower case. Counted in each task before the shuffle."""
    words = df.select(F.explode(F.split(F.lower(text), r"[^\p{L}]+")).alias("word")).where(F.length("word") >= WORD_MIN)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= WORD_COUNT)


def _kind(char: Column) -> Column:
    """0 for anything else, 1 to 26 for letters, 27 for digits."""
    return F.when(char.rlike(r"\d"), KINDS - 1).otherwise(F.instr(F.lit(LETTERS), char))


def pair_likelihoods(words: DataFrame) -> list[float]:
    """Log likelihood of each pair of kinds, from the dictionary's words; KINDS x KINDS numbers, smoothed."""
    at = lambda i: _kind(F.substring("word", i, F.lit(1)))
    pairs = words.select("n", F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: at(i) * KINDS + at(i + 1))).alias("pair"))
    counts = [[0.5] * KINDS for _ in range(KINDS)]
    for r in pairs.groupBy("pair").agg(F.sum("n").alias("n")).collect():
        counts[r["pair"] // KINDS][r["pair"] % KINDS] += r["n"]
    return [math.log(x / sum(row)) for row in counts for x in row]


def featured(found: DataFrame, words: DataFrame, likelihoods: list[float]) -> DataFrame:
    """found with FEATURES; needs value, before and after, and leaves all rows and columns."""
    value, size = F.col("value"), F.length("value")
    low = F.lower(value)
    table = F.array(*map(F.lit, likelihoods))
    kinds = F.transform(F.split(low, ""), _kind)
    pair = lambda k: F.transform(F.sequence(F.lit(0), F.size(k) - 2), lambda i: F.get(table, F.get(k, i) * KINDS + F.get(k, i + 1)))
    mean = let(kinds, lambda k: F.aggregate(pair(k), F.lit(0.0), lambda a, b: a + b) / F.greatest(F.size(k) - 1, F.lit(1)))
    without = lambda pattern: size - F.length(F.regexp_replace(value, pattern, ""))
    runs = F.filter(F.split(F.lower(F.regexp_replace(value, r"(?<=[a-z])(?=[A-Z])|[^A-Za-z]+", " ")), " "), lambda w: F.length(w) >= WORD_MIN)
    # a value's cover depends on the value alone, so values and not rows are joined with the dictionary
    parts = found.select("value").distinct().withColumn("word", F.explode(runs))
    cover = parts.join(words.select("word"), "word").groupBy("value").agg(F.sum(F.length("word")).alias("__cover"))
    joined = found.drop("__cover", *FEATURES).join(cover, "value", "left")
    return joined.withColumns({
        "length": size.cast("double"),
        "pair_likelihood": mean,
        "switches": F.size(F.regexp_extract_all("value", F.lit(r"[a-z](?=[^a-z])|[A-Z](?=[^A-Z])|\d(?=\D)"), F.lit(0))) / size,
        "digits": without(r"\d") / size,
        "uppers": without(r"[A-Z]") / size,
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / size,
        "coverage": F.coalesce("__cover", F.lit(0)) / size,
        "in_path": (F.col("before").rlike(r"(/|\\|://\S*|www\.\S*)$") | value.rlike(r"^/|(/[a-z_.-]{2,}){2}") | F.col("after").rlike(r"^\.\w{1,5}\b")).cast("double"),
        "secret_near": F.col("before").rlike(SECRET_WORDS).cast("double"),
        "other_near": (F.col("before").rlike(OTHER_WORDS) | value.rlike(r"(?i)example|your|xxxx|placeholder|changeme")).cast("double"),
        "assigned": F.col("before").rlike(ASSIGNED).cast("double"),
        "quoted": (F.col("before").rlike(r"['\"]$") & F.col("after").rlike(r"^['\"]")).cast("double"),
    }).drop("__cover")


def made_findings(spark: SparkSession, per_kind: int = MADE_PER_KIND, seed: int = 1, numbered: bool = False) -> DataFrame:
    """Labelled findings (value, before, after, label) of sixteen kinds: seven of secrets, nine of look-alikes.

    All are functions of a row's number and the seed, so they are the same wherever they are made. numbered: with the
    number of each one's kind.
    """
    raw = lambda salt: F.sha2(F.concat_ws("-", F.col("id").cast("string"), F.lit(f"{salt}-{seed}")), 256)
    b64 = lambda salt: F.regexp_replace(F.base64(F.unhex(raw(salt))), "=", "")
    pick = lambda words, salt: F.element_at(F.array(*map(F.lit, words)), (F.pmod(F.xxhash64("id", F.lit(f"{salt}-{seed}")), F.lit(len(words))) + 1).cast("int"))
    prose = lambda salt: F.concat_ws(" ", *(pick("the of and over ening ther ation some values here de la und les that with were then".split(), f"{salt}{k}") for k in range(3)))
    names = "get user account value default parser config handler stream index buffer module render update session client request".split()
    quote = lambda v: F.concat(F.lit('"'), v)
    title = lambda w: F.initcap(w)
    digits = lambda salt, n: F.substring(F.concat(F.translate(raw(salt), "abcdef", "123456"), F.lit("0000")), 1, n)
    n = F.lit(" ")
    word = pick(["token", "TOKEN", "api_key", "secret", "password", "client_key", "auth_token", "access key"], "w")
    sign = pick([' = "', "=", ": ", ' : "', '="'], "s")
    put = lambda v, before, label: F.struct(v.alias("value"), before.alias("before"), F.lit(label).alias("label"))
    kinds = [
        put(F.substring(raw("a"), 1, 40), F.concat(prose("p"), n, word, sign), 1.0),
        put(F.upper(F.substring(raw("b"), 1, 40)), F.concat(F.upper(prose("p")), n, F.upper(word), F.lit(' = "')), 1.0),
        put(F.substring(raw("c"), 1, 32), F.concat(prose("p"), n, word, sign), 1.0),
        put(b64("d"), F.concat(prose("p"), n, word, sign), 1.0),
        put(F.concat(F.lit("AKIA"), F.upper(F.substring(F.regexp_replace(b64("e"), "[+/]", "Q"), 1, 16))), F.concat(prose("p"), F.lit(" aws_access_key_id = ")), 1.0),
        put(F.concat(pick(["ghp_", "sk_live_", "xoxb-", "glpat-"], "g"), F.substring(F.regexp_replace(b64("f"), "[+/]", "x"), 1, 36)), F.concat(prose("p"), n, pick(["token ", "", "use ", "key: "], "k")), 1.0),
        put(F.concat(F.lit("eyJhbGciOiJIUzI1NiJ9."), b64("h"), F.lit("."), b64("i")), F.concat(prose("p"), F.lit(" Authorization: Bearer ")), 1.0),
        put(F.substring(raw("j"), 1, 40), F.concat(prose("p"), n, pick(["commit ", "revision ", "sha1: ", "checksum = ", "hash "], "c")), 0.0),
        put(F.concat_ws("-", F.substring(raw("k"), 1, 8), F.substring(raw("k"), 9, 4), F.substring(raw("k"), 13, 4), F.substring(raw("k"), 17, 4), F.substring(raw("k"), 21, 12)), F.concat(prose("p"), n, pick(["uuid ", "id ", "guid: ", ""], "u")), 0.0),
        put(F.concat_ws("/", F.lit("usr"), pick(["lib", "share", "local"], "q"), pick(names, "r"), F.concat(pick(names, "t"), F.lit("2"))), F.concat(prose("p"), F.lit(" /")), 0.0),
        put(F.concat_ws("/", F.lit("static"), pick(names, "x"), F.substring(raw("x"), 1, 12)), F.concat(prose("p"), F.lit(" https://www.example.com/")), 0.0),
        put(F.concat(*(pick("the ing and tion er re th on ou ent an es ha ea st".split(), f"y{k}") for k in range(7)), F.lit("2")), F.concat(prose("p"), n), 0.0),
        put(F.concat(pick(names, "z1"), title(pick(names, "z2")), title(pick(names, "z3")), F.lit("1")), F.concat(prose("p"), n, pick(["", "call ", "token = ", "def "], "z")), 0.0),
        put(digits("m", 16), F.concat(prose("p"), n, pick(["", "", "card ", "number "], "m")), 0.0),
        put(pick(["your_api_key_goes_here_1", "xxxxxxxxxxxxxxxxxxxx1234", "example_token_000000000", "changeme_changeme_1234", "1234567890123456789012"], "n"), F.concat(prose("p"), n, word, sign), 0.0),
        put(F.concat(F.lit("2024-0"), digits("o", 1), F.lit("-1"), digits("o2", 1), F.lit("T00-"), digits("o3", 6)), F.concat(prose("p"), n, pick(["at ", "date: ", ""], "o")), 0.0),
    ]
    rows = spark.range(len(kinds) * per_kind, numPartitions=2)
    chosen = rows.select("id", F.element_at(F.array(*kinds), (F.col("id") % len(kinds) + 1).cast("int")).alias("x")).select("id", "x.*")
    after = F.when(F.col("before").rlike("\"$"), F.lit('" ')).otherwise(F.lit(" "))
    made = chosen.select("value", F.right("before", F.lit(BEFORE)).alias("before"), F.concat(after, prose("after")).alias("after"), "label", (F.col("id") % len(kinds)).alias("kind"))
    return made if numbered else made.drop("kind")


def train(findings: DataFrame, words: DataFrame, likelihoods: list[float]) -> RandomForestClassificationModel:
    """The forest from labelled findings (value, before, after, label 0 or 1)."""
    rows = materialize(featured(findings, words, likelihoods).select("label", *FEATURES), "findings")
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featuresCol="features", labelCol="label").fit(vectors)


def scored(found: DataFrame, model: RandomForestClassificationModel, words: DataFrame, likelihoods: list[float]) -> DataFrame:
    """found with score (the forest's probability of a secret) and is_secret."""
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="__v").transform(featured(found, words, likelihoods))
    model = model.copy({model.featuresCol: "__v", model.probabilityCol: "__p", model.rawPredictionCol: "", model.predictionCol: ""})
    out = model.transform(vectors).withColumn("score", vector_to_array("__p")[1])
    return out.withColumn("is_secret", F.col("score") >= LIMIT).drop("__v", "__p", *FEATURES)


def scan(df: DataFrame, text: str = "text", findings: DataFrame | None = None) -> DataFrame:
    """Candidates of df with score and is_secret; false positives are those that aren't."""
    words = materialize(dictionary(df, text), "dictionary")
    likelihoods = pair_likelihoods(words)
    model = train(made_findings(df.sparkSession) if findings is None else findings, words, likelihoods)
    made = ("ordinal", "start", "value", "before", "after", "score", "is_secret")
    kept = [c for c in df.columns if c not in (text, *made)]
    # as one column, so that no name of df's meets a feature's
    found = candidates(df.select(F.struct(*(F.col(f"`{c}`") for c in kept), F.lit(0).alias(own_name(df, "none"))).alias("row"), text), text)
    out = scored(materialize(found, "candidates"), model, words, likelihoods)
    return out.select(*(F.col("row").getField(c).alias(c) for c in kept), *made)
