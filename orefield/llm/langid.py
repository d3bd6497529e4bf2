"""Language identification as inference of a mixture: which languages a document is made of, and in what shares.

Training counts character n-grams (one to four characters, word edges marked) of a bounded sample of labelled
documents, per language, into a fixed number of bins. A word (its letters, between white space) has in each language
the damped product of its n-grams' smoothed likelihoods. A document is a bag of words, each from one of the languages of an unknown mixture:
expectation-maximisation finds the shares; the set of languages is the one whose likelihood, less a penalty for each
further language, is greatest.

Defined results: a null text, or one without a letter (Unicode category L), is `und` with score 0; ties between
languages go to the one first in alphabetical order; with no labelled row every text is `und`; repeated rows get the
same answer; a very long text is read whole and costs memory for its different words only; an empty table gives an
empty one; all other columns are kept, and those named like an output are replaced.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orefield.llm.common import kept_by_worker, slices

UNKNOWN = "und"
#: Bound of the training sample: about this many different texts of each language at most, chosen by a hash of the text.
SAMPLE_PER_LANGUAGE = 1500
#: Bins that n-grams are counted in; the model has one number for each bin and language.
BINS = 1 << 16
ORDERS = (1, 2, 3, 4)
SMOOTHING = 0.5
#: n-grams overlap, so their log likelihoods are added at this weight.
OVERLAP = 0.5
#: Expectation-maximisation goes on until the log likelihood is so near its maximum, per document or per word.
GAP, GAP_PER_WORD = 0.1, 1e-4
#: Penalty for each further language: this many times log(number of words).
PENALTY = 3.0
#: Words that a worker remembers, with their log likelihoods (some 50 MB at four languages).
WORDS_KEPT = 300_000
LETTERS = regex.compile(r"\p{L}+")


def word_bins(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bins of the words' n-grams, edges marked, and for each the number of the word it is from."""
    codes = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words])
    owner = np.repeat(np.arange(len(words)), sizes)
    edge = np.zeros(len(codes), bool)
    ends = np.cumsum(sizes)
    edge[ends - 1] = edge[ends - sizes] = True
    bins, owners = [], []
    h = np.zeros(len(codes), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        h = h[: len(codes) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :] + np.uint64(n)
        inside = owner[: len(h)] == owner[n - 1 :]
        if n == 1:
            inside = ~edge
        x = h[inside]
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        bins.append((x >> np.uint64(40)).astype(np.int64) % BINS)
        owners.append(owner[: len(h)][inside])
    return np.concatenate(bins), np.concatenate(owners)


@dataclass(frozen=True)
class Model:
    languages: list[str]
    table: np.ndarray  # BINS x languages, log likelihoods


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bins of the words' n-grams, with their counts, summed within the task."""
    found: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            counts = found.setdefault(lang, np.zeros(BINS, np.int64))
            words = LETTERS.findall(text.lower())
            for at in range(0, len(words), 8192):
                counts += np.bincount(word_bins(words[at : at + 8192])[0], minlength=BINS)
    for lang, counts in found.items():
        (at,) = counts.nonzero()
        yield pa.RecordBatch.from_pydict({"lang": [lang] * len(at), "bin": at, "n": counts[at]})


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """A model from labelled rows; rows without text or language teach nothing.

    The driver gets one count per language and, for each, at most BINS numbers; languages are as many as there are labels.
    """
    rows = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")
    different = rows.select("lang", F.xxhash64("text").alias("h")).distinct()
    total = {r["lang"]: r["n"] for r in different.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not total:
        return Model([], np.zeros((BINS, 0)))
    share = F.create_map(*[x for k, n in total.items() for x in (F.lit(k), F.lit(min(1.0, per_language / n)))])
    drawn = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / float(1 << 30)
    # the share is that of different texts; copies are drawn together, and of each text one stays
    sample = rows.where(drawn < share[F.col("lang")]).dropDuplicates(["lang", "text"])
    counts = sample.mapInArrow(_count, "lang string, bin long, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    languages = sorted(total)
    place = {k: i for i, k in enumerate(languages)}
    table = np.full((BINS, len(languages)), SMOOTHING)
    for part in counts.toPandas().itertuples():
        table[part.bin, place[part.lang]] += part.n
    return Model(languages, np.log(table / table.sum(0)))


class _Words(dict):
    """Word -> row of a growing matrix of log likelihoods; words without a letter have row 0."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.used = model, 1
        self.rows = np.zeros((1 << 14, len(model.languages)))

    def learn(self, words: list[str]) -> None:
        cut = [(w, w if w.isalpha() else "><".join(LETTERS.findall(w))) for w in words]
        self.update((w, 0) for w, letters in cut if not letters)
        cut = [x for x in cut if x[1]]
        while self.used + len(cut) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
        for at in range(0, len(cut), 8192):
            some = cut[at : at + 8192]
            bins, owner = word_bins([letters for _, letters in some])
            rows = range(self.used, self.used + len(some))
            for k in range(len(self.model.languages)):
                self.rows[rows.start : rows.stop, k] = np.bincount(owner, self.model.table[bins, k], len(some)) * OVERLAP
            self.update(zip((w for w, _ in some), rows))
            self.used = rows.stop


def _shares(like: np.ndarray, weights: np.ndarray, starts: np.ndarray, owner: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mixture shares of each document among its allowed languages, and their log likelihood; languages come first.

    The likelihood is concave in the shares, so its slopes bound what further rounds can gain; documents for which that
    is small enough take no further part.
    """
    total = np.add.reduceat(weights, starts)
    gap = np.maximum(GAP, GAP_PER_WORD * total)
    share, value = allowed / allowed.sum(0), np.empty(len(starts))
    todo = np.arange(len(starts))
    while len(todo):
        mixed = np.maximum((like * share[:, todo][:, owner]).sum(0), 1e-300)
        slope = np.add.reduceat(like * (weights / mixed), starts, axis=1)
        value[todo] = np.add.reduceat(np.log(mixed) * weights, starts)
        more = (slope * allowed[:, todo]).max(0) - total[todo] > gap[todo]
        share[:, todo[more]] *= slope[:, more] / total[todo[more]]
        if not more.all():
            there = more[owner]
            like, weights, owner = like[:, there], weights[there], (np.cumsum(more) - 1)[owner[there]]
            todo = todo[more]
            starts = np.searchsorted(owner, np.arange(len(todo)))
    return share, value


class Predictor:
    def __init__(self, model: Model):
        self.model, self.words = model, _Words(model)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, dict[str, float]]]:
        """Language, its score, and the shares of the chosen set, per text."""
        found = [Counter(t.lower().split()) if t else Counter() for t in texts]
        out: list[tuple[str, float, dict[str, float]]] = [(UNKNOWN, 0.0, {})] * len(texts)
        if not self.model.languages:
            return out
        known = self.words
        new = set().union(*found).difference(known)
        if len(known) + len(new) > WORDS_KEPT:
            known = self.words = _Words(self.model)
            new = set().union(*found)
        known.learn(sorted(new))
        get, where, ids, weights = known.__getitem__, [], [], []
        for k, words in enumerate(found):
            i = np.fromiter(map(get, words), np.int64, len(words))
            n = np.fromiter(words.values(), np.float64, len(words))
            lettered = i > 0
            if lettered.any():
                where.append(k)
                ids.append(i[lettered])
                weights.append(n[lettered])
        if not where:
            return out
        sizes = np.array([len(i) for i in ids])
        starts = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(where)), sizes)
        like = self.words.rows[np.concatenate(ids)].T
        share = self._choose(like - like.max(0), np.concatenate(weights), starts, owner)
        best = share.argmax(0)
        for row, k in enumerate(where):
            j = int(best[row])
            one = float(share[j, row])
            chosen = {self.model.languages[j]: 1.0} if one > 1 - 1e-9 else {self.model.languages[i]: float(share[i, row]) for i in np.flatnonzero(share[:, row] > 1e-9)}
            out[k] = (self.model.languages[j], min(1.0, one), chosen)
        return out

    def _choose(self, loglike: np.ndarray, weights: np.ndarray, starts: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Shares of the best set of languages per document, of those nested by their shares in the full mixture.

        loglike: of each word relative to its best language, so no mixture of languages comes to more than 0. Any set
        of two or more costs a penalty at least, which settles most documents before a mixture is fitted.
        """
        langs = len(loglike)
        n_words = np.add.reduceat(weights, starts)
        cost, gap = PENALTY * np.log(n_words + 1), np.maximum(GAP, GAP_PER_WORD * n_words)
        single = np.add.reduceat(loglike * weights, starts, axis=1)
        chosen, top = np.eye(langs)[single.argmax(0)].T, single.max(0)

        def of(docs: np.ndarray) -> tuple[np.ndarray, ...]:
            there = np.isin(owner, docs)
            own = np.searchsorted(docs, owner[there])
            return np.exp(loglike[:, there]), weights[there], np.searchsorted(own, np.arange(len(docs))), own

        docs = np.flatnonzero(-cost > top)
        if len(docs):
            share, full = _shares(*of(docs), np.ones((langs, len(docs))))
            more = full + gap[docs] - cost[docs] > top[docs]
            docs, share = docs[more], share[:, more]
        if len(docs):
            rank = np.argsort(np.argsort(-share, axis=0, kind="stable"), axis=0)
            best, parts, data = top[docs], chosen[:, docs], of(docs)
            # no set of this size can be better once its penalty alone is too much, so this ends by itself
            for size in range(2, langs + 1):
                if not (-cost[docs] * (size - 1) > best).any():
                    break
                part, value = _shares(*data, (rank < size).astype(float))
                value -= cost[docs] * (size - 1)
                better = value > best
                best = np.where(better, value, best)
                parts[:, better] = part[:, better]
            chosen[:, docs] = parts
        return chosen


def identify(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add `lang_pred`, `score` and `lang_shares` (map) to df; columns of these names are replaced."""
    sent, name = df.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = kept_by_worker(f"predictor {name}", lambda: Predictor(sent.value))
        for part in slices(batches, text, rows=512):
            found = own.predict(part.column(text).to_pylist())
            added = {
                "lang_pred": pa.array([f[0] for f in found], pa.string()),
                "score": pa.array([f[1] for f in found], pa.float64()),
                "lang_shares": pa.array([list(f[2].items()) for f in found], pa.map_(pa.string(), pa.float64())),
            }
            kept = [(n, c) for n, c in zip(part.schema.names, part.columns) if n not in added]
            yield pa.RecordBatch.from_arrays([c for _, c in kept] + [*added.values()], [n for n, _ in kept] + [*added])

    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("lang_shares", T.MapType(T.StringType(), T.DoubleType()))]
    kept = [f for f in df.schema.fields if f.name not in {a.name for a in added}]
    return df.mapInArrow(run, T.StructType(kept + added))


def held_out(doc_id: Column) -> Column:
    """The documents that teach nothing: a third of all, by a checksum of their identifier; a null one counts as ''."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1
