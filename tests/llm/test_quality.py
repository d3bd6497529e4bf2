import math
import re
from collections import Counter

import pytest

from orefield.llm import quality

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    many = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if many[w] > 1 for k in range(8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def classes(text):
    n = Counter()
    for c in text:
        kind = "upper" if c.isupper() and c.isalpha() else "letter" if c.isalpha() else "digit" if c.isdecimal() else "white" if c in " \t\n\x0b\x0c\r" else "mark" if c in quality.MARKS else "other"
        n[kind] += 1
    return [n[k] for k in quality.CLASSES]


def jensen_shannon(p, q):
    part = lambda x, m: x * math.log2(x / m) if x > 0 else 0.0
    return sum((part(a, (a + b) / 2) + part(b, (a + b) / 2)) / 2 for a, b in zip(p, q))


def brute(rows):
    words, chars = {}, {}
    for text, lang in rows:
        if lang is not None and text is not None:
            words.setdefault(lang, Counter()).update(w.lower() for w in WORD.findall(text))
            chars[lang] = [a + b for a, b in zip(chars.get(lang, [0] * 6), classes(text))]
    total = {k: sum(c.values()) for k, c in words.items()}
    listed = sorted({w for k, c in words.items() for w, n in c.items() if len(w) <= quality.COMMON_LENGTH and n >= total[k] * quality.COMMON_SHARE})
    q_words = {k: [c[w] / total[k] for w in listed] for k, c in words.items()}
    q_chars = {k: [x / sum(c) for x in c] for k, c in chars.items()}
    with_rest = lambda p: [*p, 1 - sum(p)]
    out = []
    for text, _ in rows:
        n, word_chars, symbols, dup, rep = base(text)
        failed = n < 20 or 100 * rep > 30 * n
        cd = wd = None
        if not failed and word_chars >= quality.CHAR_MIN:
            c = classes(text)
            cd = min(jensen_shannon([x / sum(c) for x in c], q) for q in q_chars.values())
        if not failed and n >= quality.WORD_MIN:
            c = Counter(w.lower() for w in WORD.findall(text))
            wd = min(jensen_shannon(with_rest([c[w] / n for w in listed]), with_rest(q)) for q in q_words.values())
        kept = not failed and (cd or 0) <= quality.CHAR_LIMIT and (wd or 0) <= quality.WORD_LIMIT + quality.WORD_NOISE / n
        out.append((n, word_chars, symbols, dup, rep, failed, cd, wd, kept))
    return out


def same(r, w):
    assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) == (*w[:6], w[8])
    for a, b in ((r.char_distance, w[6]), (r.word_distance, w[7])):
        assert (a is None) == (b is None) and (a is None or a * a == pytest.approx(b, abs=1e-9))  # the distance is the divergence's root


def test_whole_table_against_brute_force(spark):
    from orefield.llm.queries import op2_divergence_rules

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()
    got = {r.doc_id: r for r in op2_divergence_rules(spark, SF).collect()}
    assert len(got) == len(docs)
    for d, w in zip(docs, brute([(d.text, d.lang) for d in docs])):
        same(got[d.doc_id], w)


def test_labelled_quality(spark):
    from orefield.llm.queries import op2_divergence_rules

    sf = "/root/testdata/sf0.01"
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r.doc_id: r.kept for r in op2_divergence_rules(spark, sf).collect() if not r.base_failed}
    good = [kept[d] for d, q in label.items() if q == 1 and d in kept]
    bad = [kept[d] for d, q in label.items() if q == 0 and d in kept]
    assert sum(good) / len(good) > 0.98 and sum(bad) / max(1, len(bad)) < 0.3


def test_frames(spark):
    prose = "the cat and the dog went over the hill with the others " * 3
    rows = [(1, prose + "a\x0bb \t\r\n x" * 8, "en", True), (1, prose + "a\x0bb \t\r\n x" * 8, "en", True), (None, None, "en", None), (2, "", None, None), (3, "### *** " * 40, None, None), (4, "one two three four five six seven eight " * 4000, "de", None), (5, "  \n\n x y\nx y\n \n", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept boolean")
    got = quality.judge(df).collect()
    for r, w in zip(sorted(got, key=lambda r: str(r.text)), brute([(t, k) for t, k in sorted(((r[1], r[2]) for r in rows), key=lambda x: str(x[0]))])):
        same(r, w)
    assert quality.judge(df.limit(0)).count() == 0
    assert all(r.kept == (not r.base_failed) for r in quality.judge(df.where("lang is null")).collect())
