"""English stems by the rules of Porter2, as column expressions over distinct words.

A word keeps two numbers beside it, where its regions R1 and R2 begin; since each step changes a word's end only, they
hold for all steps. Each step is a projection, so Spark compiles them into one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values of the published algorithm ----
#: Words with a stem of their own.
SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
#: Words that stay once their plural is off.
STAY = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
#: R1 of words that begin so comes right after.
HEADS = "gener|commun|arsen"
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")
LI_ENDING, DOUBLES = "[cdeghkmnrt]", "(bb|dd|ff|gg|mm|nn|pp|rr|tt)$"
# ---- end of fixed values ----

VOWEL, OTHER = "[aeiouy]", "[^aeiouy]"
#: A word's head up to its first vowel that a non-vowel follows, and that one.
REGION = f"^.*?{VOWEL}{OTHER}"
#: A syllable that a word may end with and be short.
SHORT_END = f"({OTHER}{VOWEL}[^aeiouywxY]|^{VOWEL}{OTHER})$"


def ending(endings) -> str:
    """A pattern that finds the longest of the endings: the leftmost match that reaches the word's end."""
    return f"({'|'.join(endings)})$"


def _without(w: Column, n: Column | int) -> Column:
    return F.substring(w, F.lit(1), F.length(w) - n)


def _changed(w: Column, endings: dict[str, str], allowed) -> Column:
    """w with its longest ending replaced, if allowed(ending, where it begins) holds."""
    found = F.regexp_extract(w, ending(endings), 1)
    at = F.length(w) - F.length(found)
    to = F.create_map(*[F.lit(x) for kv in endings.items() for x in kv])
    return F.when((found != "") & allowed(found, at), F.concat(F.substring(w, F.lit(1), at), to[found])).otherwise(w)


def _region(w: Column) -> Column:
    """Where a region begins: behind the first non-vowel that follows a vowel, or at the end."""
    head = F.regexp_extract(w, REGION, 0)
    return F.when(head == "", F.length(w)).otherwise(F.length(head))


def stems(words: DataFrame, word: str = "word") -> DataFrame:
    """(word, stem) of each row's word, which is taken in lower case; null for null. For distinct words: pass them once."""
    w = F.col("w")
    df = words.select(F.col(word).alias("word"), F.regexp_replace(F.lower(word), "^'", "").alias("w"))
    df = df.select("word", F.col("w").alias("plain"), F.regexp_replace(F.regexp_replace("w", "^y", "Y"), f"({VOWEL})y", "$1Y").alias("w"))
    named = F.regexp_extract(w, f"^({HEADS})", 1)
    df = df.select("*", F.when(named != "", F.length(named)).otherwise(_region(w)).alias("r1"))
    df = df.select("*", (F.col("r1") + _region(F.substring(w, F.col("r1") + 1, F.length(w)))).alias("r2"))
    r1, r2 = F.col("r1"), F.col("r2")
    keep = ["word", "plain", "r1", "r2"]

    def step(new: Column, frame: DataFrame) -> DataFrame:
        return frame.select(*keep, new.alias("w"))

    df = step(F.regexp_replace(w, "('s'|'s|')$", ""), df)
    plural = (
        F.when(w.endswith("sses"), _without(w, 2))
        .when(w.rlike("(ied|ies)$"), _without(w, F.when(F.length(w) > 4, 2).otherwise(1)))
        .when(w.rlike("(us|ss)$"), w)
        .when(w.rlike(f"{VOWEL}.+s$"), _without(w, 1))
        .otherwise(w)
    )
    df = step(plural, df).withColumn("held", F.when(w.isin(*STAY), w))
    keep.append("held")
    past = F.regexp_extract(w, ending(("ingly", "edly", "ing", "ed")), 1)
    df = df.select(*keep, "w", F.regexp_extract(w, ending(("eedly", "eed")), 1).alias("eed"), _without(w, F.length(past)).alias("before"), past.alias("past"))
    before, eed = F.col("before"), F.col("eed")
    cut = (
        F.when(before.rlike("(at|bl|iz)$"), F.concat(before, F.lit("e")))
        .when(before.rlike(DOUBLES), _without(before, 1))
        .when(before.rlike(SHORT_END) & (F.length(before) <= r1), F.concat(before, F.lit("e")))
        .otherwise(before)
    )
    verb = F.when(eed != "", F.when(F.length(w) - F.length(eed) >= r1, F.concat(_without(w, F.length(eed)), F.lit("ee"))).otherwise(w)).when((F.col("past") != "") & before.rlike(VOWEL), cut).otherwise(w)
    df = step(verb, df)
    df = step(F.when(w.rlike(f"^.+{OTHER}[yY]$"), F.concat(_without(w, 1), F.lit("i"))).otherwise(w), df)
    last = lambda at: F.substring(w, at, F.lit(1))  # noqa: E731  the character before an ending
    fits = lambda e, at: (at >= r1) & F.when(e == "ogi", last(at) == "l").when(e == "li", last(at).rlike(LI_ENDING)).otherwise(True)
    df = step(_changed(w, STEP_2, fits), df)
    df = step(_changed(w, STEP_3, lambda e, at: (at >= r1) & ((e != "ative") | (at >= r2))), df)
    df = step(_changed(w, dict.fromkeys(STEP_4, ""), lambda e, at: (at >= r2) & ((e != "ion") | last(at).rlike("[st]"))), df)
    rest, size = _without(w, 1), F.length(w) - 1
    drop = (w.endswith("e") & ((size >= r2) | ((size >= r1) & ~rest.rlike(SHORT_END)))) | (w.endswith("ll") & (size >= r2))
    df = step(F.when(drop, rest).otherwise(w), df.select(*keep, "w"))
    # a one-element explode: filters on the stem aren't pushed below it, which would write all steps out once for each use
    return df.select("word", F.explode(F.array(_settled(F.col("plain"), F.col("held"), w))).alias("stem"))


def _settled(plain: Column, held: Column, w: Column) -> Column:
    """The stem of a word that steps have been through, or that none applies to."""
    known = F.create_map(*[F.lit(x) for kv in SPECIAL.items() for x in kv])
    return F.coalesce(known[plain], F.when(F.length(plain) <= 2, plain), held, F.translate(w, "Y", "y"))
