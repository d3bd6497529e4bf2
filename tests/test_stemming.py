"""Stems against the published algorithm's sample, and against a plain version over all words of the tables."""

import re

import pytest
from pyspark.sql import functions as F

from orefield.operators import stemming
from orefield.operators.stemming import HEADS, SPECIAL, STAY, STEP_2, STEP_3, STEP_4

SF = "/root/testdata/sf0.01"

SAMPLE = """consign consign, consigned consign, consigning consign, consignment consign, consist consist, consisted consist, consistency consist, consistent consist, consistently consist, consists consist,
consolation consol, consolations consol, consolatory consolatori, console consol, consoled consol, consolidate consolid, consolidating consolid, consoling consol, consolingly consol, consonant conson,
conspicuous conspicu, conspicuously conspicu, conspiracy conspiraci, conspirator conspir, conspirators conspir, conspired conspir, constable constabl, constance constanc, constancy constanc, constant constant,
knackeries knackeri, knacks knack, knave knave, knaves knave, knavish knavish, kneaded knead, kneading knead, knee knee, kneeled kneel, knees knee, knell knell, knife knife, knightly knight, knits knit,
knitted knit, knitting knit, knives knive, knobs knob, knocked knock, knocker knocker, knotted knot, cries cri, ties tie, dies die, gas gas, this this, gaps gap, kiwis kiwi, agreed agre, feed feed, luxuriated luxuri,
hopping hop, hoping hope, filing file, falling fall, hissing hiss, fizzed fizz, failing fail, cry cri, by by, say say, happy happi, relational relat, conditional condit, valenci valenc, digitizer digit, operator oper,
feudalism feudal, decisiveness decis, hopefulness hope, callousness callous, formality formal, sensitivity sensit, sensibility sensibl, analogy analog, hopefully hope, endlessly endless, formative format, formalize formal, electrical electr,
hopeful hope, goodness good, revival reviv, allowance allow, inference infer, airliner airlin, adjustable adjust, defensible defens, irritant irrit, replacement replac, adjustment adjust, dependent depend, adoption adopt,
communism communism, activate activ, effective effect, probate probat, rate rate, cease ceas, controlling control, roll roll, roads road, toilets toilet, construction construct, generate generat, general general, generously generous,
communication communic, arsenal arsenal, skies sky, dying die, news news, innings inning, proceeding proceed, herring herring, youth youth, enjoying enjoy, sayings say, bridges bridg, sky sky, only onli"""


def plain(word):
    """The algorithm's text, step by step."""
    vowels = set("aeiouy")
    w = word.lower().removeprefix("'")
    if w in SPECIAL:
        return SPECIAL[w]
    if len(w) <= 2:
        return w
    chars = list(w)
    for i, c in enumerate(chars):
        if c == "y" and (i == 0 or chars[i - 1] in vowels):
            chars[i] = "Y"
    w = "".join(chars)

    def region(text):
        for i in range(1, len(text)):
            if text[i - 1] in vowels and text[i] not in vowels:
                return i + 1
        return len(text)

    head = next((h for h in HEADS.split("|") if w.startswith(h)), None)
    r1 = len(head) if head else region(w)
    r2 = r1 + region(w[r1:])

    def short_end(text):
        if len(text) == 2:
            return text[0] in vowels and text[1] not in vowels
        return len(text) > 2 and text[-3] not in vowels and text[-2] in vowels and text[-1] not in vowels | set("wxY")

    def longest(text, endings):
        return max((e for e in endings if text.endswith(e)), key=len, default=None)

    for e in ("'s'", "'s", "'"):
        if w.endswith(e):
            w = w[: -len(e)]
            break
    e = longest(w, ("sses", "ied", "ies", "us", "ss", "s"))
    if e == "sses":
        w = w[:-2]
    elif e in ("ied", "ies"):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif e == "s" and vowels & set(w[:-2]):
        w = w[:-1]
    if w in STAY:
        return w
    e = longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if e in ("eed", "eedly"):
        if len(w) - len(e) >= r1:
            w = w[: -len(e)] + "ee"
    elif e and vowels & set(w[: -len(e)]):
        w = w[: -len(e)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w[-2:] in ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"):
            w = w[:-1]
        elif len(w) <= r1 and short_end(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in vowels:
        w = w[:-1] + "i"
    e = longest(w, STEP_2)
    if e and len(w) - len(e) >= r1 and (e != "ogi" or w[: -len(e)].endswith("l")) and (e != "li" or w[-3] in "cdeghkmnrt"):
        w = w[: -len(e)] + STEP_2[e]
    e = longest(w, STEP_3)
    if e and len(w) - len(e) >= r1 and (e != "ative" or len(w) - len(e) >= r2):
        w = w[: -len(e)] + STEP_3[e]
    e = longest(w, STEP_4)
    if e and len(w) - len(e) >= r2 and (e != "ion" or w[: -len(e)][-1:] in ("s", "t")):
        w = w[: -len(e)]
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not short_end(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def found(spark, words):
    return {r[0]: r[1] for r in stemming.stems(spark.createDataFrame([(w,) for w in words], "word string")).collect()}


@pytest.fixture(scope="module")
def sample():
    return dict(pair.split() for pair in re.split(r",\s*", SAMPLE))


def test_published_sample(spark, sample):
    assert found(spark, sample) == sample


def test_plain_version_knows_the_sample(sample):
    assert {w: plain(w) for w in sample} == sample


def test_all_words_of_documents(spark):
    words = spark.read.parquet(f"{SF}/documents.parquet").select(F.explode(F.split(F.lower("text"), r"[^\p{L}']+")).alias("word")).where("word <> ''").distinct()
    got = {r[0]: r[1] for r in stemming.stems(words).collect()}
    assert len(got) > 2000 and got == {w: plain(w) for w in got}


def test_made_words(spark):
    """Heads and ends that the steps tell apart, each with each."""
    heads = ["hop", "abl", "y", "sayy", "gener", "commun", "beaut", "tr", "oxidiz", "fitt", "x", "eyey", "ll", "analog", "mult"]
    ends = ["", "s", "sses", "ies", "ied", "us", "'s", "eed", "eedly", "ing", "ingly", "ed", "y", *STEP_2, *STEP_3, *STEP_4, "sion", "tion", "ally", "e", "ll", "ement", "izationed", "fulnesses"]
    words = {h + e for h in heads for e in ends}
    assert found(spark, words) == {w: plain(w) for w in words}


def test_odd_words(spark):
    assert found(spark, ["", "A", "'tis", "ROADS", "été", "x2", "'"]) == {"": "", "A": "a", "'tis": "tis", "ROADS": "road", "été": "été", "x2": "x2", "'": ""}
    assert stemming.stems(spark.createDataFrame([(None,)], "word string")).collect()[0][1] is None
