"""Quality rules by distribution divergence, in DataFrame operations only.

A document's characters fall into six classes, its words into the common words of all languages and a rest. Both
histograms are compared with those of each language, taken over all documents that are labelled with it, by the
Jensen-Shannon distance (the square root of the divergence in bits, 0 to 1). A document goes if even the nearest language is too far off. Sampling noise
grows as a text gets shorter, so the word limit allows for it, and texts under a length are not judged by words.

Defined results: null texts count as without words and fail; documents without a language add nothing to the
references but are judged; without any reference only the base rules decide; repeated rows are judged alike; a very long
text is judged whole, in arrays of its words; all other columns are kept, whatever their names, but those named like an
output are replaced; a document at a limit stays; an empty table gives an empty result. The driver gets the counts of
six classes, and of the common words, for each language.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orefield.llm.common import let, materialize, own_name

WHITE = r"[\x20\x09-\x0D]+"
MARKS = ".,;:!?'\"()-"
CLASSES = ("upper", "letter", "digit", "white", "mark", "other")
REPEAT_WINDOW = 8
#: A common word has at least this share of a language's words, so no language has more than 1 / COMMON_SHARE of them,
#: and is short, as function words are.
COMMON_SHARE = 0.0025
COMMON_LENGTH = 6
#: Limits of the divergences, that is of the squared distances; the word limit is WORD_LIMIT + WORD_NOISE / number of words.
CHAR_LIMIT, WORD_LIMIT, WORD_NOISE = 0.06, 0.05, 6.0
CHAR_MIN, WORD_MIN = 50, 50


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), WHITE), lambda w: w != "")


def _joined(hashes: Column, by: int) -> Column:
    """Hash of each element with the one `by` places on."""
    n = F.greatest(F.size(hashes) - by, F.lit(0))
    return F.zip_with(F.slice(hashes, F.lit(1), n), F.slice(hashes, F.lit(by + 1), n), lambda x, y: F.xxhash64(x, y))


def repeat_words(words: Column) -> Column:
    """Words that lie in an eight-word window which the text holds twice or more.

    Windows of 2, 4 and 8 words are hashed from halves; a text whose four-word windows all differ has no more to do.
    """
    n = REPEAT_WINDOW

    def covered(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        same = lambda s, i, x: F.coalesce(F.get(s, i)["x"] == x["x"], F.lit(False))
        twice = let(ordered, lambda s: F.filter(s, lambda x, i: same(s, i + 1, x) | same(s, i - 1, x)))
        places = F.sort_array(F.transform(twice, lambda x: x["i"]))
        return let(places, lambda p: F.aggregate(F.transform(p, lambda v, i: F.least(F.lit(n), F.coalesce(F.get(p, i + 1) - v, F.lit(n)))), F.lit(0), lambda a, b: a + b))

    all_differ = lambda h: F.size(F.array_distinct(h)) == F.size(h)
    eights = lambda h: F.when(all_differ(h), 0).otherwise(covered(h))
    fours = lambda h: F.when(all_differ(h), 0).otherwise(let(_joined(h, 4), eights))
    found = let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: let(_joined(h, 1), lambda p: let(_joined(p, 2), fours)))
    return F.when(F.size(words) < n, 0).otherwise(found).cast("long")


def dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda s: F.size(s) - F.size(F.array_distinct(s))).cast("long")


def remainder(text: Column) -> Column:
    """A text without small letters and blanks: a fraction of it, on which the rarer characters are counted."""
    return F.regexp_replace(text, r"[\p{Ll} ]+", "")


def _count(rest: Column, other: str) -> Column:
    """Characters of rest that aren't of the class `other`."""
    return F.length(F.regexp_replace(rest, f"{other}+", ""))


def n_symbols(rest: Column) -> Column:
    return _count(rest, r"[^#*$%&|<>]").cast("long")


def class_counts(text: Column, rest: Column, white: Column) -> Column:
    """Code points by class, as an array in the order of CLASSES. rest: remainder(text); white: white space in text."""
    rare_white = _count(rest, r"[^\x09-\x0D]")
    upper, letters, digits, marks = _count(rest, r"\P{Lu}"), _count(rest, r"\P{L}"), _count(rest, r"\P{Nd}"), _count(rest, r"[^.,;:!?'\"()\-]")
    small = F.length(text) - F.length(rest) - (white - rare_white)
    found = F.array(upper, small + letters - upper, digits, white, marks, F.length(text) - small - letters - digits - white - marks)
    return F.transform(found, lambda x: x.cast("double"))


def measured(df: DataFrame, text: str, inner: tuple[str, str]) -> DataFrame:
    """df with the base measures of its text and, by the names in inner, its words and its remainder."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.col(inner[0])
    return df.withColumns({inner[0]: words_of(F.col(text)), inner[1]: remainder(t)}).withColumns({
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": n_symbols(F.col(inner[1])),
        "n_dup_lines": dup_lines(t),
        "n_repeat_words": repeat_words(words),
    })


def common_words(df: DataFrame, text: str, lang: str) -> dict[str, dict[str, float]]:
    """Per language the shares of all common words in it; at most 1 / COMMON_SHARE words of each language are common."""
    words = df.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.explode(words_of(F.lower(text))).alias("w"))
    # longer words are counted together, so that the counts sum up to all words
    named = F.when(F.length("w") <= COMMON_LENGTH, F.col("w")).otherwise("")
    counts = materialize(words.groupBy("lang", named.alias("w")).agg(F.count(F.lit(1)).alias("n")), "words")
    total = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    if not total:
        return {}
    need = F.create_map(*[x for k, n in total.items() for x in (F.lit(k), F.lit(n * COMMON_SHARE))])
    common = counts.where((F.col("w") != "") & (F.col("n") >= need[F.col("lang")]))
    listed = sorted({r["w"] for r in common.select("w").distinct().collect()})
    out = {k: dict.fromkeys(listed, 0.0) for k in sorted(total)}
    if listed:
        for r in counts.where(F.col("w").isin(listed)).collect():
            out[r["lang"]][r["w"]] = r["n"] / total[r["lang"]]
    return out


def class_references(df: DataFrame, text: str, lang: str) -> dict[str, list[float]]:
    """Per language the shares of the character classes."""
    t = F.col(text)
    there = df.where(F.col(lang).isNotNull() & t.isNotNull()).select(F.col(lang).alias("lang"), t.alias("t"), remainder(t).alias("rest"))
    # blanks without a pattern; the other white space is in the rest
    white = F.length("t") - F.length(F.replace("t", F.lit(" "))) + _count(F.col("rest"), r"[^\x09-\x0D]")
    rows = there.select("lang", class_counts(F.col("t"), F.col("rest"), white).alias("c"))
    sums = rows.groupBy("lang").agg(*(F.sum(F.col("c")[k]).alias(name) for k, name in enumerate(CLASSES))).collect()
    return {r["lang"]: [r[c] / s for c in CLASSES] for r in sums if (s := sum(r[c] for c in CLASSES))}


def _part(p: Column, q: Column) -> Column:
    """One bucket's share of the Jensen-Shannon divergence, of p and q over their mean."""
    term = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    return let((p + q) / 2, lambda m: (term(p, m) + term(q, m)) / 2)


def _root(divergence: Column) -> Column:
    return F.sqrt(F.greatest(divergence, F.lit(0.0)))


def class_distance(counts: Column, references: dict[str, list[float]]) -> Column:
    """Distance to the nearest language's classes."""
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, b: a + b)
    shares = let(counts, lambda c: let(F.greatest(total(c), F.lit(1.0)), lambda n: F.transform(c, lambda x: x / n)))
    every = F.array(*(F.array(*map(F.lit, q)) for q in references.values()))
    one = lambda s, q: F.aggregate(F.zip_with(s, q, _part), F.lit(0.0), lambda a, b: a + b)
    return _root(let(shares, lambda s: F.array_min(F.transform(every, lambda q: one(s, q)))))


def word_distance(words: Column, references: dict[str, dict[str, float]]) -> Column:
    """Distance to the nearest language's common words; a word that the text lacks adds half its share there."""
    listed = sorted(next(iter(references.values())))
    known = F.array(*map(F.lit, listed))
    per_word = F.array(*(F.array(*(F.lit(q[w]) for q in references.values())) for w in listed))
    of_all = F.array(*(F.lit(sum(q.values())) for q in references.values()))
    hits = F.sort_array(F.filter(F.transform(words, F.lower), lambda w: w.isin(listed)))
    #: (word's number, count) of each listed word in the text
    numbered = lambda s: F.transform(s, lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    runs = let(hits, lambda s: F.filter(numbered(s), lambda x: F.coalesce(F.get(s, x["i"] + 1) != x["w"], F.lit(True))))
    counted = let(runs, lambda r: F.transform(r, lambda x, k: F.struct((F.array_position(known, x["w"]).cast("int") - 1).alias("k"), (x["i"] - F.coalesce(F.get(r, k - 1)["i"], F.lit(-1))).cast("double").alias("n"))))

    def nearest(c: Column, n: Column) -> Column:
        zero = F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("p"), F.lit(0.0).alias("q"))

        def distance(j: Column) -> Column:
            def add(a: Column, x: Column) -> Column:
                p, q = x["n"] / n, F.get(F.get(per_word, x["k"]), j)
                return F.struct((a["d"] + _part(p, q)).alias("d"), (a["p"] + p).alias("p"), (a["q"] + q).alias("q"))

            seen = F.aggregate(c, zero, add)
            return let(seen, lambda a: a["d"] + (F.get(of_all, j) - a["q"]) / 2 + _part(1.0 - a["p"], 1.0 - F.get(of_all, j)))

        return F.array_min(F.transform(F.sequence(F.lit(0), F.lit(len(references) - 1)), distance))

    return _root(let(counted, lambda c: nearest(c, F.greatest(F.size(words), F.lit(1)).cast("double"))))


def judge(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """df with base measures, base_failed, both distances (null under the least length) and `kept`."""
    classes, common = class_references(df, text, lang), common_words(df, text, lang)
    t = F.coalesce(F.col(text), F.lit(""))
    own = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", "kept")
    inner = own_name(df, "words"), own_name(df, "rest")
    a = measured(df.drop(*(c for c in own if c not in (text, lang))), text, inner)
    a = a.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    judged = ~F.col("base_failed")
    chars = class_distance(class_counts(t, F.col(inner[1]), F.length(t) - F.col("word_chars")), classes) if classes else F.lit(None).cast("double")
    common_there = common and next(iter(common.values()))
    words = word_distance(F.col(inner[0]), common) if common_there else F.lit(None).cast("double")
    a = a.withColumn("char_distance", F.when(judged & (F.col("word_chars") >= CHAR_MIN), chars))
    a = a.withColumn("word_distance", F.when(judged & (F.col("n_words") >= WORD_MIN), words))
    squared = lambda c: F.coalesce(F.col(c) * F.col(c), F.lit(0.0))
    near = (squared("char_distance") <= CHAR_LIMIT) & (squared("word_distance") <= WORD_LIMIT + WORD_NOISE / F.col("n_words"))
    return a.withColumn("kept", judged & F.coalesce(near, F.lit(True))).drop(*inner)


#: What DuckDB gives for the same rows; identifiers are taken to be unique. Distances are rounded as in the query.
ORACLE = rf"""
WITH docs AS (SELECT doc_id, lang, text AS raw, coalesce(text, '') AS t FROM documents),
cut AS (SELECT doc_id, lang, t, raw, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM docs),
lines AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM docs),
spots AS (SELECT doc_id, i, array_to_string(ws[i:i + {REPEAT_WINDOW - 1}], ' ') AS w FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {REPEAT_WINDOW - 2})) AS i FROM cut WHERE len(ws) >= {REPEAT_WINDOW})),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, w) AS k FROM spots) WHERE k > 1),
repeats AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(0, {REPEAT_WINDOW}) r(k) GROUP BY doc_id),
counts AS (SELECT doc_id, lang, raw, t, length(regexp_replace(t, '\P{{Lu}}', '', 'g')) AS u, length(regexp_replace(t, '\P{{L}}', '', 'g')) AS l, length(regexp_replace(t, '\P{{Nd}}', '', 'g')) AS d, length(regexp_replace(t, '[^\x20\x09-\x0D]', '', 'g')) AS w, length(regexp_replace(t, '[^.,;:!?''"()\-]', '', 'g')) AS m, length(t) AS n FROM docs),
classes AS (SELECT doc_id, lang, raw, [u, l - u, d, w, m, n - l - d - w - m] AS c, n FROM counts),
class_sums AS (SELECT lang, i, sum(c[i]) AS s FROM classes, range(1, {len(CLASSES) + 1}) r(i) WHERE lang IS NOT NULL AND raw IS NOT NULL GROUP BY lang, i),
class_refs AS (SELECT lang, i, s / sum(s) OVER (PARTITION BY lang) AS q FROM class_sums),
base AS (SELECT c.doc_id, c.ws, CAST(len(c.ws) AS BIGINT) AS n_words, CAST(length(array_to_string(c.ws, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(c.t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
  FROM cut c JOIN lines USING (doc_id) LEFT JOIN repeats r USING (doc_id)),
failed AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base),
char_parts AS (SELECT x.doc_id, r.lang, sum((CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2) AS d
  FROM (SELECT doc_id, i, c[i] / greatest(n, 1) AS p FROM classes, range(1, {len(CLASSES) + 1}) g(i)) x JOIN class_refs r USING (i) GROUP BY x.doc_id, r.lang),
chars AS (SELECT doc_id, sqrt(greatest(min(d), 0)) AS d FROM char_parts GROUP BY doc_id),
said AS (SELECT doc_id, lang, unnest(list_filter(string_split_regex(lower(t), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS w FROM docs),
per_lang AS (SELECT lang, w, count(*) AS n FROM said WHERE lang IS NOT NULL GROUP BY lang, w),
totals AS (SELECT lang, sum(n) AS n FROM per_lang GROUP BY lang),
listed AS (SELECT DISTINCT w FROM per_lang JOIN totals t USING (lang) WHERE length(w) <= {COMMON_LENGTH} AND per_lang.n >= t.n * {COMMON_SHARE}),
word_refs AS (SELECT t.lang, l.w, coalesce(p.n, 0) / t.n AS q FROM totals t CROSS JOIN listed l LEFT JOIN per_lang p ON p.lang = t.lang AND p.w = l.w),
own AS (SELECT s.doc_id, s.w, count(*) AS n FROM said s JOIN listed USING (w) GROUP BY s.doc_id, s.w),
pairs AS (SELECT f.doc_id, r.lang, r.q, coalesce(o.n, 0) / f.n_words AS p FROM failed f CROSS JOIN word_refs r LEFT JOIN own o ON o.doc_id = f.doc_id AND o.w = r.w WHERE f.n_words >= {WORD_MIN} AND NOT f.base_failed),
rests AS (SELECT doc_id, lang, q, p FROM pairs UNION ALL SELECT doc_id, lang, 1 - sum(q), 1 - sum(p) FROM pairs GROUP BY doc_id, lang),
word_parts AS (SELECT doc_id, lang, sum((CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2) AS d FROM rests GROUP BY doc_id, lang),
near AS (SELECT doc_id, sqrt(greatest(min(d), 0)) AS d FROM word_parts GROUP BY doc_id),
told AS (SELECT f.*, CASE WHEN NOT base_failed AND word_chars >= {CHAR_MIN} THEN c.d END AS cd, n.d AS wd FROM failed f LEFT JOIN chars c USING (doc_id) LEFT JOIN near n USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(cd, 9) AS char_distance, round(wd, 9) AS word_distance,
  NOT base_failed AND coalesce(coalesce(cd * cd, 0) <= {CHAR_LIMIT} AND coalesce(wd * wd, 0) <= {WORD_LIMIT} + {WORD_NOISE} / n_words, TRUE) AS kept FROM told
"""
