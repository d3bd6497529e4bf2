"""Full-text search over postings, typo correction, trigram similarity and vocabularies."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Weights of the four labels of a posting, and how many terms and negations a question keeps.
WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.05}
MOST_TERMS, MOST_NEGATED = 16, 4
SPLIT = r"[^\p{L}\p{Nd}]+"
#: Endings that the stemmer takes off, longest first, if three letters stay.
ENDINGS = ("ations", "ation", "ingly", "edly", "ments", "ment", "ings", "ing", "ions", "ion", "ies", "ers", "er", "ed", "es", "ly", "s")


def stem(word: Column) -> Column:
    """A light stemmer of English: one ending off. Made for matching, not a published algorithm."""
    return F.regexp_replace(word, f"^([a-z]{{3,}}?)(?:{'|'.join(ENDINGS)})$", "$1")


def stem_word(word: str) -> str:
    """stem() of a question's word."""
    return re.sub(f"^([a-z]{{3,}}?)(?:{'|'.join(ENDINGS)})$", r"\1", word)


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPLIT), lambda w: w != "")


def postings(df: DataFrame, by: str, labels: dict[str, str], stemmed: bool = True) -> DataFrame:
    """(by, lexeme, label, pos): labels gives each text column its label; words are kept as they are and stemmed."""
    parts = []
    for column, label in labels.items():
        words = df.select(by, F.posexplode(tokens(F.col(column))).alias("pos", "word"))
        forms = F.array_distinct(F.array("word", stem(F.col("word")))) if stemmed else F.array("word")
        parts.append(words.select(by, F.explode(forms).alias("lexeme"), F.lit(label).alias("label"), "pos"))
    return reduce(DataFrame.unionByName, parts)


@dataclass(frozen=True)
class Question:
    """An AND of ORs of terms, and terms that may not occur; a term of several words is a phrase."""

    clauses: tuple[tuple[tuple[str, ...], ...], ...]
    negated: tuple[tuple[str, ...], ...]


def parse_question(text: str) -> Question:
    """Bare words, "phrases", a leading minus, and `or` between terms."""
    clauses: list[list[tuple[str, ...]]] = []
    negated: list[tuple[str, ...]] = []
    joined, used = False, 0
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', text):
        if not phrase and word.lower() == "or" and not minus:
            joined = bool(clauses)
            continue
        words = tuple(w for w in re.split(r"[\W_]+", (phrase or word).lower()) if w)
        if not words:
            continue
        if minus:
            if len(negated) < MOST_NEGATED:
                negated.append(words)
        elif used < MOST_TERMS:
            used += 1
            if joined:
                clauses[-1].append(words)
            else:
                clauses.append([words])
        joined = False
    return Question(tuple(tuple(c) for c in clauses), tuple(negated))


def stemmed(question: Question) -> Question:
    stems = lambda term: tuple(map(stem_word, term))
    return Question(tuple(tuple(map(stems, c)) for c in question.clauses), tuple(map(stems, question.negated)))


def relaxed(question: Question) -> Question:
    """Any of the question's terms is enough."""
    return Question((tuple(t for c in question.clauses for t in c),), question.negated)


def _words_of(question: Question) -> list[str]:
    return sorted({w for t in [*(t for c in question.clauses for t in c), *question.negated] for w in t})


def _begins(word: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (word.startswith(w) for w in words))


def _let(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _followed(places: Column, spots: Column, k: int, word: str) -> Column:
    """Those of the places whose k-th next word begins with `word`."""
    spot = lambda s, back: F.struct(s["label"].alias("label"), (s["pos"] - back).alias("pos"))
    later = F.transform(F.filter(spots, lambda s: s["lexeme"].startswith(word)), lambda s: spot(s, k))
    return _let(later, lambda x: F.filter(places, lambda s: F.array_contains(x, spot(s, 0))))


def judged(spots: Column, question: Question, weights: dict[str, float] = WEIGHTS) -> Column:
    """(matches, score, n_terms) of a document, from its spots: an array of (label, pos, lexeme), only those that begin
    with a word of the (stemmed) question. Each term's places are worked out once.

    The score sums, per term, its best label weight times 1 + log(hits).
    """
    terms = list(dict.fromkeys(t for clause in question.clauses for t in clause))
    every = [*terms, *(t for t in question.negated if t not in terms)]
    weight = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])

    def places(term: tuple[str, ...]) -> Column:
        """Where a term begins: places whose following words are there too."""
        first = F.filter(spots, lambda s: s["lexeme"].startswith(term[0]))
        for k, word in enumerate(term[1:], 1):
            first = _followed(first, spots, k, word)
        return first

    def verdict(found: Column) -> Column:
        at = {t: found[f"t{k}"] for k, t in enumerate(every)}
        has = {t: F.size(at[t]) > 0 for t in every}
        wanted = reduce(lambda a, b: a & b, (reduce(lambda a, b: a | b, (has[t] for t in clause)) for clause in question.clauses))
        for t in question.negated:
            wanted = wanted & ~has[t]
        best = lambda t: F.array_max(F.transform(at[t], lambda s: weight[s["label"]]))
        one = lambda t: F.when(has[t], best(t) * (1 + F.ln(F.size(at[t]).cast("double")))).otherwise(0.0)
        return F.struct(wanted.alias("matches"), reduce(lambda a, b: a + b, map(one, terms)).alias("score"), reduce(lambda a, b: a + b, (has[t].cast("int") for t in terms)).alias("n_terms"))

    return _let(F.struct(*(places(t).alias(f"t{k}") for k, t in enumerate(every))), verdict)


def spots_of(labels: dict[str, str], question: Question, stems: bool | dict[str, bool] = True) -> Column:
    """A row's spots for a (stemmed) question, from its text columns: words are filtered before they are anything else.

    A stem begins its word, so a word whose stem begins with what is asked begins with it too.
    """
    words = _words_of(question)

    def part(column: str, label: str) -> Column:
        placed = F.transform(tokens(F.col(column)), lambda w, i: F.struct(w.alias("w"), i.alias("i")))
        hits = F.filter(placed, lambda x: _begins(x["w"], words))
        forms = lambda w: F.array_distinct(F.array(w, stem(w))) if (stems if isinstance(stems, bool) else stems.get(column, True)) else F.array(w)
        return F.flatten(F.transform(hits, lambda x: F.transform(F.filter(forms(x["w"]), lambda w: _begins(w, words)), lambda w: F.struct(F.lit(label).alias("label"), x["i"].alias("pos"), w.alias("lexeme")))))

    return F.concat(*(part(column, label) for column, label in labels.items()))


def may_match(labels: dict[str, str], question: Question) -> Column:
    """Whether a row can satisfy a (stemmed) question, by its texts as they are: a stem begins its word, so some word begins
    with what is asked, and none with a negated word. Most rows go by this, before any is cut into words."""

    def judge(low: Column) -> Column:
        has = lambda w: F.exists(low, lambda x: F.contains(x, F.lit(w)) & x.rlike(f"(?:^|{SPLIT})" + re.escape(w)))
        term = lambda t: reduce(lambda a, b: a & b, map(has, t))
        some = reduce(lambda a, b: a & b, (reduce(lambda a, b: a | b, map(term, clause)) for clause in question.clauses))
        return reduce(lambda a, t: a & ~has(t[0]), (t for t in question.negated if len(t) == 1), some)

    return _let(F.array(*(F.lower(F.coalesce(c, F.lit(""))) for c in labels)), judge)


def search_rows(df: DataFrame, question: Question, labels: dict[str, str], stems: bool | dict[str, bool] = True) -> DataFrame:
    """df's rows that satisfy the question, with score and n_terms. One scan: a row's words are judged where they are."""
    asked = stemmed(question)
    if not any(asked.clauses):
        return df.withColumns({"score": F.lit(0.0), "n_terms": F.lit(0)}).limit(0)
    made = df.where(may_match(labels, asked)).withColumn("__found", _let(spots_of(labels, asked, stems), lambda s: judged(s, asked)))
    return made.where("__found.matches").withColumns({"score": F.col("__found.score"), "n_terms": F.col("__found.n_terms")}).drop("__found")


def search(posted: DataFrame, question: Question, by: str, any_term: bool = False) -> DataFrame:
    """(by, score, n_terms): documents that satisfy the question, best first by score, then identifier.

    Postings are filtered to the question's prefixes before anything is shuffled; a document's few hits are then
    grouped once. For postings that are kept; search_rows needs none.
    """
    asked = stemmed(relaxed(question) if any_term else question)
    if not any(asked.clauses):
        return posted.select(by, F.lit(0.0).alias("score"), F.lit(0).alias("n_terms")).limit(0)
    hit = posted.where(_begins(F.col("lexeme"), _words_of(asked)))
    docs = hit.groupBy(by).agg(F.collect_set(F.struct("label", "pos", "lexeme")).alias("__s"))
    found = docs.select(by, judged(F.col("__s"), asked).alias("f")).where("f.matches")
    return found.select(by, "f.score", "f.n_terms").orderBy(F.desc("score"), by)


#: A tender's parts: titles stemmed and as they are, identifiers as they are, then who buys, and where.
TENDER_PARTS = {"title": "A", "reference": "A", "buyer": "C", "place": "D"}
TENDER_STEMS = {"title": True, "reference": False, "buyer": True, "place": True}
MOST_EXACT, LEAST_ID = 20, 3


def exact_ids(df: DataFrame, text: str, *columns: str, by: str = "id") -> DataFrame:
    """The rows of which an identifier is the text, whatever the case: at most 20, for three characters or more in one."""
    plain = text.strip().strip('"').strip()
    if len(plain) < LEAST_ID or re.search(r"\s", plain):
        return df.limit(0)
    return df.where(reduce(lambda a, b: a | b, (F.upper(c) == F.upper(F.lit(plain)) for c in columns))).orderBy(by).limit(MOST_EXACT)


def corrected(text: str, known: DataFrame) -> str:
    """The text with each plain word that nothing known begins with replaced by the nearest known one, if one is near."""
    words = sorted({w.lower() for w in re.findall(r"[^\W_]+", text) if re.fullmatch(r"[A-Za-z]{3,}", w)} - {"or"} - set(UNCORRECTED))
    fixes = {r["word"]: r["fixed"] for r in corrections(words, known).collect()}  # a question's few words
    return re.sub(r"[^\W_]+", lambda m: fixes.get(m[0].lower(), m[0]), text) if fixes else text


#: Words that a question may have without being matched, so that they need no correction.
UNCORRECTED = "a an and are as at be but by for from in into is it no not of on or such that the their then there these they this to was will with".split()


@dataclass(frozen=True)
class Stage:
    """How a text was matched: strictly, corrected, or by any of its words."""

    question: Question
    corrected: str | None = None
    any_term: bool = False


def stage_of(text: str, matches, known: DataFrame) -> Stage:
    """The first stage that finds something: as asked, then corrected, then any word of several; else as asked.

    matches: a function from a question to the rows that satisfy it, with all other filters; it is asked whether any exist.
    """
    asked = parse_question(text)
    if not matches(asked).isEmpty():
        return Stage(asked)
    fixed = corrected(text, known)
    again = parse_question(fixed) if fixed != text else asked
    if fixed != text and not matches(again).isEmpty():
        return Stage(again, fixed)
    if sum(map(len, again.clauses)) > 1:
        return Stage(relaxed(again), fixed if fixed != text else None, True)
    return Stage(asked)


def staged_search(df: DataFrame, text: str, known: DataFrame, labels: dict[str, str] = TENDER_PARTS, stems: dict[str, bool] = TENDER_STEMS, ids: tuple[str, ...] = ("reference",), by: str = "id") -> DataFrame:
    """df's rows for a text, in search order, with exact, score and n_terms: rows with the text as identifier come first
    and are there at every stage."""
    exact = exact_ids(df, text, *ids, by=by).select(by)
    with_exact = lambda q: search_rows(df, q, labels, stems).select(by).union(exact)
    stage = stage_of(text, with_exact, known)
    found = search_rows(df, stage.question, labels, stems).select(by, "score", "n_terms")
    ranked = found.join(exact.withColumn("exact", F.lit(True)), by, "full")
    zero = ranked.select(by, F.coalesce("exact", F.lit(False)).alias("exact"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("n_terms", F.lit(0)).alias("n_terms"))
    return df.join(zero, by).orderBy(F.desc("exact"), F.desc("score"), by)


def split_keywords(keywords: str) -> list[str]:
    return [w for w in (k.strip() for k in re.split("[,;]", keywords)) if w]


def keyword_rows(df: DataFrame, keywords: str, known: DataFrame, labels: dict[str, str] = TENDER_PARTS, stems: dict[str, bool] = TENDER_STEMS, title: str = "title") -> DataFrame:
    """df's rows that any keyword of the list matches, as written or corrected; one without words to search for matches
    titles that contain it. No keywords, no restriction."""
    questions, plain = [], []
    for keyword in split_keywords(keywords):
        asked = parse_question(keyword)
        if not asked.clauses:
            plain.append(keyword)
            continue
        fixed = corrected(keyword, known)
        questions += [asked] + ([parse_question(fixed)] if fixed != keyword else [])
    if not questions and not plain:
        return df
    hit = lambda q: _let(spots_of(labels, q, stems), lambda s: judged(s, q))["matches"]
    hits = [hit(stemmed(q)) for q in questions]
    hits += [F.contains(F.upper(title), F.upper(F.lit(k))) for k in plain]
    return df.where(reduce(lambda a, b: a | b, (F.coalesce(h, F.lit(False)) for h in hits)))


def vocabulary(df: DataFrame, text: str, by: str) -> DataFrame:
    """(word, ndoc): documents that each word occurs in; a document's repeats go before the shuffle."""
    words = df.select(F.explode(F.array_distinct(tokens(F.col(text)))).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("ndoc"))


def corrections(words: list[str], vocabulary: DataFrame) -> DataFrame:
    """(word, fixed, distance): for each word that begins no known word the nearest known one.

    Up to two edits for words of six letters or more, else one; of equally near ones the most frequent, then by
    alphabet. A question's few words meet the vocabulary in one scan of it.
    """
    asked = [w for w in dict.fromkeys(words) if re.fullmatch(r"[a-z]{3,}", w)]
    if not asked:
        return vocabulary.select("word", F.col("word").alias("fixed"), F.lit(0).alias("distance")).limit(0)
    most = lambda w: 2 if len(w) >= 6 else 1
    # words too short or too long to be near, and that begin otherwise, meet no edit distance
    size = F.length("word")
    near = [F.when(size.between(len(w) - most(w), len(w) + most(w)) | F.col("word").startswith(w), F.struct(F.lit(w).alias("asked"), F.levenshtein("word", F.lit(w), most(w)).alias("d"), F.col("word").startswith(w).alias("known"))) for w in asked]
    scanned = vocabulary.select("word", "ndoc", F.explode(F.array_compact(F.array(*near))).alias("n")).where((F.col("n.d") >= 0) | F.col("n.known"))
    best = F.min(F.when(F.col("n.d") >= 0, F.struct(F.col("n.d").alias("d"), -F.col("ndoc"), "word")))
    grouped = scanned.groupBy(F.col("n.asked").alias("asked")).agg(best.alias("b"), F.bool_or("n.known").alias("known"))
    return grouped.where(~F.col("known")).select(F.col("asked").alias("word"), F.col("b.word").alias("fixed"), F.col("b.d").alias("distance"))


def trigrams(text: Column) -> Column:
    """The set of three-character runs of each word, with two blanks before it and one after."""
    words = F.filter(F.split(F.lower(text), SPLIT), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    runs = F.transform(padded, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substring(p, i, F.lit(3))))
    return F.array_distinct(F.flatten(runs))


def trigram_similarity(a: Column, b: Column) -> Column:
    x, y = trigrams(a), trigrams(b)
    return F.try_divide(F.size(F.array_intersect(x, y)).cast("double"), F.size(F.array_union(x, y)))


def similar(df: DataFrame, target: dict, k: int, as_of: str, text: str = "title", threshold: float = 0.3) -> DataFrame:
    """Open rows like the target: of its sector first, then others at or over the threshold, by similarity."""
    open_ = (F.col("closes_at") > F.lit(as_of).cast("timestamp")) & (F.col("id") != target["id"])
    same = F.col("sector").eqNullSafe(F.lit(target["sector"])) & F.lit(target["sector"] != "other")
    scored = df.where(open_).withColumn("similarity", trigram_similarity(F.col(text), F.lit(target[text]))).withColumn("tier", F.when(same, 0).when(F.col("similarity") >= threshold, 1))
    return scored.where("tier is not null").orderBy("tier", F.desc("similarity"), F.asc_nulls_last("closes_at"), "id").limit(k)


#: What is taken off a line's ends.
BLANKS = " \t\n\r"


def running_lines(pages: DataFrame, doc: str, page: str, text: str, share: float = 0.6) -> DataFrame:
    """(doc, line, n): lines on at least three, and a share of six in ten, of a document's pages, digits masked."""
    total = pages.groupBy(doc).agg(F.count(F.lit(1)).alias("pages"))
    masked = F.transform(F.filter(F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS))), lambda x: x != ""), lambda x: F.regexp_replace(x, r"\d+", "#"))
    lines = pages.select(doc, page, F.explode(F.array_distinct(masked)).alias("line"))
    seen = lines.groupBy(doc, "line").agg(F.count(F.lit(1)).alias("n")).join(total, doc)
    return seen.where((F.col("pages") >= 3) & (F.col("n") >= F.greatest(F.lit(3.0), share * F.col("pages")))).select(doc, "line", "n")


def exact_first(df: DataFrame, exact: Column, *order: Column) -> DataFrame:
    return df.orderBy(exact.desc(), *order)


def numbered(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order)))
