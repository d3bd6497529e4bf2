"""Search ranked by how close the words of a question stand: postings with English stems, and covers of the clauses.

A text's words take places one after the other, its parts following each other with a gap, so that no phrase spans two.
A cover is a shortest stretch of places that has a term of every clause; each adds what its words weigh on average, the
less the more other words stand between them. Covers are found in one walk over a row's hits in order of place: the walk
keeps the last occurrence of each clause and follows phrases by shifting bits, so its time is linear in the hits.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orefield.operators import fulltext
from orefield.operators.fulltext import Question, exact_ids, parse_question, relaxed, tokens
from orefield.operators.stemming import SPECIAL, stems
from orefield.operators.wordlist import WordList

#: The words that are no lexemes of an English part or question.
STOP_WORDS = """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves
what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with
about against between into through during before after above below up down in out on off over under again further then once here there when where why how all any both each few
more most other some such no nor not only own same so than too very s t can will just don should now""".split()
#: A stem may differ from its word in so many last letters.
CHANGED = 2
#: Words of a question that the walk can tell apart.
MOST_WORDS = 62

#: (column, label, whether it is English) of a tender: titles count stemmed and as they are.
TENDER_PARTS = (("title", "A", True), ("title", "A", False), ("reference", "A", False), ("buyer", "C", True), ("place", "D", True))


def lexemes_of(question: Question, spark) -> Question:
    """The question with stems for words, without stop words; a term of nothing else goes, and so does a clause of such."""
    words = sorted({w for t in [*(t for c in question.clauses for t in c), *question.negated] for w in t})
    asked = spark.createDataFrame([(w,) for w in words], "word string") if words else None
    known = {r["word"]: r["stem"] for r in stems(asked).collect()} if words else {}  # a question's few words
    term = lambda t: tuple(known[w] for w in t if w not in STOP_WORDS)
    clauses = [tuple(x for x in map(term, c) if x) for c in question.clauses]
    return Question(tuple(c for c in clauses if c), tuple(x for x in map(term, question.negated) if x))


def _placed(label: str, english: bool, offset: Column):
    return lambda w, i: F.struct((i + offset).alias("pos"), F.lit(label).alias("label"), F.lit(english).alias("english"), w.alias("word"))


def places(df: DataFrame, by: str, parts) -> DataFrame:
    """(by, pos, label, english, word) of all words."""
    listed = df.select(F.col(by).alias(by), *(tokens(F.col(c)).alias(f"__w{k}") for k, (c, _, _) in enumerate(parts)))
    placed, offset = [], F.lit(0)
    for k, (_, label, english) in enumerate(parts):
        placed.append(F.transform(F.col(f"__w{k}"), _placed(label, english, offset)))
        offset = offset + F.size(f"__w{k}") + 1
    return listed.select(by, F.explode(F.concat(*placed)).alias("p")).select(by, "p.*")


def _lexemes(words: DataFrame, by: str) -> DataFrame:
    """(by, pos, label, lexeme): each different English word is stemmed once."""
    english = words.where(F.col("english") & ~F.col("word").isin(*STOP_WORDS))
    known = stems(english.select("word").distinct()).withColumnRenamed("stem", "lexeme")
    return english.join(known, "word").select(by, "pos", "label", "lexeme").union(words.where("not english").select(by, "pos", "label", F.col("word").alias("lexeme")))


def post(df: DataFrame, by: str, parts=TENDER_PARTS) -> DataFrame:
    """(by, pos, label, lexeme) of whole texts, to be kept and asked often."""
    return _lexemes(places(df, by, parts), by)


def _heads(lexeme: str) -> list[str]:
    """What a word begins with whose stem begins with the lexeme: all of it but the letters that stemming may change."""
    return sorted({lexeme[: max(0, len(lexeme) - CHANGED)]} | {s for s, stem in SPECIAL.items() if stem.startswith(lexeme)})


def may_match(question: Question, parts) -> Column:
    """Whether a row can satisfy a question of lexemes, by its texts as they are."""
    low = [F.lower(F.coalesce(c, F.lit(""))) for c in dict.fromkeys(c for c, _, _ in parts)]
    has = lambda w: reduce(lambda a, b: a | b, (F.contains(c, F.lit(h)) for c in low for h in _heads(w)))
    term = lambda t: reduce(lambda a, b: a & b, map(has, t))
    return reduce(lambda a, b: a & b, (reduce(lambda a, b: a | b, map(term, clause)) for clause in question.clauses))


def hits(df: DataFrame, by: str, question: Question, parts=TENDER_PARTS) -> DataFrame:
    """The postings that the question (of lexemes) asks for, of rows that may satisfy it, without making the others: rows
    go by their raw texts before any is cut into words, and words that can't have such a stem before any is stemmed."""
    heads = {h for w in _words(question) for h in _heads(w)}
    may = reduce(lambda a, b: a | b, (F.col("word").startswith(h) for h in sorted(heads)))
    return asked(_lexemes(places(df.where(may_match(question, parts)), by, parts).where(may), by), question)


def asked(posted: DataFrame, question: Question) -> DataFrame:
    return posted.where(reduce(lambda a, b: a | b, (F.col("lexeme").startswith(w) for w in _words(question))))


def _words(question: Question) -> list[str]:
    return sorted({w for t in [*(t for c in question.clauses for t in c), *question.negated] for w in t})


def _walk(found: Column, question: Question) -> Column:
    """(matches, score) of a row from its hits: an array of (pos, bits, inverse weight) in order of place."""
    terms = [(t, k) for k, c in enumerate(question.clauses) for t in c] + [(t, None) for t in question.negated]
    first_bits, last_bits, wanted, at = 0, [], 0, 0
    for t, k in terms:
        first_bits |= 1 << at
        last_bits.append((at + len(t) - 1, len(t), k))
        if k is not None:
            wanted |= ((1 << len(t)) - 1) << at
        at += len(t)
    n = len(question.clauses)
    bit = lambda d, i: d.bitwiseAND(F.lit(1 << i).cast("bigint")) != 0
    begin = lambda start, idx, cum: F.struct(start.cast("int").alias("start"), idx.cast("int").alias("idx"), cum.cast("double").alias("cum"))
    none = F.lit(None).cast("struct<start: int, idx: int, cum: double>")
    zero = F.struct(
        F.lit(0).cast("bigint").alias("d"), F.lit(-2).alias("pos"), F.lit(0).alias("idx"), F.lit(0.0).alias("cum"), F.array(*[none] * n).alias("lasts"),
        F.lit(-1).alias("begin"), F.lit(0.0).alias("score"), F.lit(False).alias("barred"),
    )

    def step(s: Column, x: Column) -> Column:
        follows = F.when(x["pos"] == s["pos"] + 1, F.shiftleft(s["d"], 1)).otherwise(F.lit(0).cast("bigint"))
        counts = x["bits"].bitwiseAND(F.lit(wanted).cast("bigint")) != 0
        here = F.struct(
            follows.bitwiseOR(F.lit(first_bits).cast("bigint")).bitwiseAND(x["bits"]).alias("d"),
            (s["idx"] + counts.cast("int")).alias("idx"),
            (s["cum"] + F.when(counts, x["inverse"]).otherwise(0.0)).alias("cum"),
        )
        return fulltext._let(here, lambda h: lasts_of(s, x, h))

    def lasts_of(s: Column, x: Column, h: Column) -> Column:
        def last(k: int) -> Column:
            ended = [F.when(bit(h["d"], i), begin(x["pos"] - (m - 1), h["idx"] - (m - 1), h["cum"] - m * x["inverse"])) for i, m, c in last_bits if c == k]
            return F.greatest(s["lasts"][k], *ended)

        return fulltext._let(F.array(*map(last, range(n))), lambda lasts: scored(s, x, h, lasts))

    def scored(s: Column, x: Column, h: Column, lasts: Column) -> Column:
        whole = reduce(lambda a, b: a & b, (lasts[k].isNotNull() for k in range(n)))
        start = F.when(whole, F.array_min(lasts))
        items = h["idx"] - start["idx"]  # but one
        gap = (x["pos"] - start["start"]) - items
        noise = F.when(gap < 0, F.floor(items / 2)).otherwise(gap)
        new = F.coalesce(start["start"] > s["begin"], F.lit(False))
        worth = F.when(new, (items + 1) / (h["cum"] - start["cum"]) / (1 + noise)).otherwise(0.0)
        barred = reduce(lambda a, b: a | b, (bit(h["d"], i) for i, _, k in last_bits if k is None), F.lit(False))
        return F.struct(
            h["d"].alias("d"), x["pos"].cast("int").alias("pos"), h["idx"].alias("idx"), h["cum"].alias("cum"), lasts.alias("lasts"),
            F.when(new, start["start"]).otherwise(s["begin"]).alias("begin"), (s["score"] + worth).alias("score"), (s["barred"] | barred).alias("barred"),
        )

    return F.aggregate(found, zero, step, lambda s: F.struct(((s["begin"] >= 0) & ~s["barred"]).alias("matches"), s["score"].alias("score")))


def covered(posted: DataFrame, question: Question, by: str, weights: dict[str, float] = fulltext.WEIGHTS) -> DataFrame:
    """(by, score) of the rows that satisfy a question of lexemes. Only hits are shuffled, once, by row.

    A cover's worth is (words asked for in it) / (sum of 1 / weight of these) / (1 + words between them).
    """
    ordered_words = [w for t in [*(t for c in question.clauses for t in c), *question.negated] for w in t]
    if len(ordered_words) > MOST_WORDS:
        raise ValueError(f"a question of more than {MOST_WORDS} words")
    if not question.clauses:
        return posted.select(by, F.lit(0.0).alias("score")).limit(0)
    bits = reduce(lambda a, b: a.bitwiseOR(b), (F.when(F.col("lexeme").startswith(w), F.lit(1 << i).cast("bigint")).otherwise(F.lit(0).cast("bigint")) for i, w in enumerate(ordered_words)))
    weight = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    hit = F.struct("pos", bits.alias("bits"), (1.0 / weight[F.col("label")]).alias("inverse"))
    rows = asked(posted, question).groupBy(by).agg(F.array_sort(F.collect_list(hit)).alias("__hits"))
    return rows.select(by, _walk(F.col("__hits"), question).alias("f")).where("f.matches").select(by, "f.score")


def search(df: DataFrame, text: str, by: str = "id", parts=TENDER_PARTS, any_term: bool = False) -> DataFrame:
    """(by, score) of the rows of df that satisfy a text's question, closest first, then by identifier."""
    question = parse_question(text)
    question = lexemes_of(relaxed(question) if any_term else question, df.sparkSession)
    if not question.clauses:
        return df.select(by, F.lit(0.0).alias("score")).limit(0)
    return covered(hits(df, by, question, parts), question, by).orderBy(F.desc("score"), by)


@dataclass(frozen=True)
class Found:
    """Rows in search order, with exact and score, and how the text was matched."""

    rows: DataFrame
    corrected: str | None = None
    any_term: bool = False


def staged(df: DataFrame, text: str, words: WordList, parts=TENDER_PARTS, ids: tuple[str, ...] = ("tender_id", "reference"), by: str = "id", closes: str | None = "closes_at") -> Found:
    """The first stage that finds rows: as asked, with unknown words corrected, with any of several words; else none.

    A row of which an identifier is the text is there at every stage, and first; then come the closest covers, the
    earliest closing, the least identifier. Each stage that is tried costs one scan for the question's words.
    """
    exact = exact_ids(df, text, *ids, by=by).select(by, F.lit(True).alias("exact"))
    asked_ = parse_question(text)

    def matched(question: Question) -> DataFrame:
        known = lexemes_of(question, df.sparkSession)
        scored = covered(hits(df, by, known, parts), known, by) if known.clauses else df.select(by, F.lit(0.0).alias("score")).limit(0)
        both = scored.join(exact, by, "full")
        return both.select(by, F.coalesce("exact", F.lit(False)).alias("exact"), F.coalesce("score", F.lit(0.0)).alias("score"))

    def result(question: Question, **how) -> Found:
        order = [F.desc("exact"), F.desc("score"), *([F.asc_nulls_last(closes)] if closes else []), F.col(by)]
        return Found(df.join(matched(question), by).orderBy(*order), **how)

    if not matched(asked_).isEmpty():
        return result(asked_)
    fixed = words.corrected(text)
    again, changed = parse_question(fixed), fixed != text
    if changed and not matched(again).isEmpty():
        return result(again, corrected=fixed)
    if sum(map(len, again.clauses)) > 1:
        return result(relaxed(again), corrected=fixed if changed else None, any_term=True)
    return result(asked_)
