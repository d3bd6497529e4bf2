"""Mixing sources to target weights: raking (iterative proportional fitting), then calibrated sampling.

Token weights are summed per cell of source x language x topic. The cells' weights are scaled to each target marginal
in turn until all agree. A cell's documents are then kept with the probability that gives its fitted share of the token
budget; where a cell has too few tokens, all of its documents stay and the rest of the budget goes to the others.
A topic is a cluster of texts by their words (topics.py), a text's weight the number of its words; columns of the table
may be named for both instead.

Defined results: null categories are categories of their own, shown as ''; null and empty texts have weight 0 and topic
''; they are kept with their cell's probability, which is 1 for a cell without tokens; a category without a target gets
its own present share; targets are scaled to one; rows alike in identifier and text are kept or left together; a very
long text is one document as any other; other columns are kept whatever their names, but those named mix_probability and
mix_weight are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orefield.llm import topics
from orefield.llm.common import discard, drop_kept, materialize, own_name, slices

#: Raking ends once all margins are so close, or after so many rounds (margins that contradict each other never meet).
ROUNDS = 500
CLOSE = 1e-9
SEED = 17
#: Up to this many cells are fitted on the driver (a few numbers each); more are fitted as a DataFrame.
CELLS_ON_DRIVER = 50_000
MARGINS = ("source", "lang", "topic")


def tempered(total: Mapping[str, float], power: float) -> dict[str, float]:
    """Targets between the present shares (power 1) and equal ones (power 0)."""
    raised = {k: v**power for k, v in total.items() if v > 0}
    return {k: v / sum(raised.values()) for k, v in raised.items()}


def _targets(total: dict[str, float], given: Mapping[str, float] | float) -> dict[str, float]:
    if isinstance(given, (int, float)):
        return tempered(total, float(given))
    whole = sum(total.values()) or 1.0
    wanted = {k: float(given.get(k, v / whole)) for k, v in total.items() if v > 0}
    scale = sum(wanted.values()) or 1.0
    return {k: v / scale for k, v in wanted.items()}


def rake(cells: Mapping[tuple[str, ...], float], targets: list[Mapping[str, float]], rounds: int = ROUNDS) -> dict[tuple[str, ...], float]:
    """Shares of the cells, fitted to all targets in turn; cells of weight 0 stay at 0."""
    whole = sum(cells.values())
    share = {k: v / whole for k, v in cells.items() if v > 0} if whole else {}
    for _ in range(rounds):
        off = 0.0
        for k, wanted in enumerate(targets):
            now: dict[str, float] = {}
            for cell, w in share.items():
                now[cell[k]] = now.get(cell[k], 0.0) + w
            off = max([off, *(abs(now[c] - wanted.get(c, 0.0)) for c in now)])
            share = {cell: w * wanted.get(cell[k], 0.0) / now[cell[k]] if now[cell[k]] else 0.0 for cell, w in share.items()}
        if off < CLOSE:
            break
    return share


def keep_probabilities(cells: Mapping[tuple[str, ...], float], share: Mapping[tuple[str, ...], float], budget: float) -> dict[tuple[str, ...], float]:
    """Per cell min(1, c x fitted / present tokens), with c such that the expected tokens are the budget."""
    ratio = sorted(((share[k] / cells[k], cells[k], k) for k in share if cells[k] > 0 and share[k] > 0), reverse=True)
    full, rest = 0.0, sum(share[k] for _, _, k in ratio)
    out = dict.fromkeys(cells, 0.0)
    for n, (r, tokens, k) in enumerate(ratio):
        scale = max(0.0, budget - full) / rest if rest > 1e-15 else float("inf")
        if r * scale < 1:
            for r2, _, k2 in ratio[n:]:
                out[k2] = r2 * scale
            break
        out[k], full, rest = 1.0, full + tokens, rest - share[k]
    return out


def _cells(df: DataFrame) -> DataFrame:
    return df.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens"))


def _fit_as_frame(cells: DataFrame, powers: Mapping[str, Mapping[str, float] | float], rounds: int = ROUNDS) -> DataFrame:
    """rake() for any number of cells: each step is a sum by one margin, joined back; lineage is cut each round."""
    whole = cells.agg(F.sum("tokens")).first()[0] or 1
    now = cells.withColumn("share", F.col("tokens") / float(whole))
    wanted = {}
    for m in MARGINS:
        total = cells.groupBy(m).agg(F.sum("tokens").alias("t")).where("t > 0")
        given = powers[m]
        if isinstance(given, (int, float)):
            raised = total.withColumn("t", F.pow("t", F.lit(float(given))))
        else:
            raised = total.withColumn("t", F.coalesce(*([F.create_map(*[F.lit(x) for kv in given.items() for x in kv])[F.col(m)]] if given else []), F.col("t") / float(whole)).cast("double"))
        every = raised.agg(F.sum("t")).first()[0] or 1.0
        wanted[m] = materialize(raised.select(m, (F.col("t") / float(every)).alias("want")), "margin")
    before = None
    for _ in range(rounds):
        now = now.withColumn("off", F.lit(0.0))
        for m in MARGINS:
            total = now.groupBy(m).agg(F.sum("share").alias("has"))
            fitted = {"off": F.greatest("off", F.abs(F.col("has") - F.col("want"))), "share": F.when(F.col("has") > 0, F.col("share") * F.col("want") / F.col("has")).otherwise(0.0)}
            now = now.join(total.join(wanted[m], m), m).withColumns(fitted).drop("has", "want")
        last, now = before, materialize(now.select(*MARGINS, "tokens", "share", "off"), "cells")
        if last is not None:
            discard(last)
        before = now
        if (now.agg(F.max("off")).first()[0] or 0.0) < CLOSE:
            break
    return now.drop("off")


def _draw(doc_id: Column, text: Column) -> Column:
    """A number from 0 to 1 of each document, by a hash of its identifier, or its text if it has none."""
    name = F.concat_ws("|", F.lit(SEED), F.coalesce(doc_id.cast("string"), F.lit("")), F.when(doc_id.isNull(), F.md5(F.coalesce(text, F.lit("")))))
    return F.conv(F.substring(F.md5(name), 1, 12), 16, 10).cast("double") / float(16**12)


def formed(df: DataFrame, text: str, doc_id: str, source: str, lang: str, topic: str | None, tokens: str | None, keep_text: bool) -> tuple[DataFrame, str]:
    """df, without its text if that isn't kept, and a struct with its cell, its tokens and its draw; and that one's name."""
    form = own_name(df, "form")
    blank = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    model = topics.fit(df, text) if topic is None else None
    drawn = df.withColumn(form, F.struct(blank(source).alias("source"), blank(lang).alias("lang"), (blank(topic) if topic else F.lit("")).alias("topic"), (F.coalesce(F.col(f"`{tokens}`"), F.lit(0)).cast("long") if tokens else F.lit(0).cast("long")).alias("tokens"), _draw(F.col(doc_id), F.col(text)).alias("draw")))
    kept = [c for c in drawn.columns if keep_text or c != text]
    if topic and tokens:
        return drawn.select(*(F.col(f"`{c}`") for c in kept)), form
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        for part in slices(batches, text, most=topics.TEXT_AT_ONCE):
            texts, old = part.column(text), part.column(form)
            if sent.value is None:
                names, n = None, topics.counted(texts)[2]
            else:
                names, n = topics.topics_of(sent.value, texts)
            own = {f.name: old.field(f.name) for f in old.type}
            if names is not None:
                own["topic"] = pc.if_else(pa.array(n > 0), pa.array(names, pa.string()), "")
            if not tokens:
                own["tokens"] = pa.array(n, pa.int64())
            new = pa.StructArray.from_arrays(list(own.values()), names=list(own))
            yield pa.RecordBatch.from_arrays([new if c == form else part.column(c) for c in kept], kept)

    return drawn.mapInArrow(run, drawn.select(*(F.col(f"`{c}`") for c in kept)).schema), form


def mix(
    df: DataFrame,
    targets: Mapping[str, Mapping[str, float] | float],
    keep_share: float = 0.5,
    text: str = "text",
    doc_id: str = "doc_id",
    source: str = "source",
    lang: str = "lang",
    topic: str | None = None,
    tokens: str | None = None,
    keep_text: bool = True,
    cells_on_driver: int = CELLS_ON_DRIVER,
) -> DataFrame:
    """The sampled rows of df, with `mix_probability` and `mix_weight` (tokens that a kept document stands for).

    targets: per margin (source, lang, topic) either shares by category or a power that flattens the present ones.
    keep_share: the token budget, as a share of all tokens. topic, tokens: columns to take instead of clusters and words.
    """
    rows, form = formed(df.drop("mix_probability", "mix_weight"), text, doc_id, source, lang, topic, tokens, keep_text)
    rows = materialize(rows, "formed")
    cells = materialize(_cells(rows.select(*(F.col(f"{form}.{n}").alias(n) for n in (*MARGINS, "tokens")))), "cells")
    n = cells.count()
    if n <= cells_on_driver:
        table = {tuple(r[m] for m in MARGINS): float(r["tokens"] or 0) for r in cells.collect()}
        wanted = []
        for k, m in enumerate(MARGINS):
            total: dict[str, float] = {}
            for cell, t in sorted(table.items()):
                total[cell[k]] = total.get(cell[k], 0.0) + t
            wanted.append(_targets(total, targets[m]))
        table = dict(sorted(table.items()))
        share = rake(table, wanted)
        keep = keep_probabilities(table, share, keep_share * sum(table.values())) | {k: 1.0 for k, t in table.items() if not t}
        # no more than cells_on_driver short rows, so no text is dealt out by its cell
        chances = F.broadcast(df.sparkSession.createDataFrame([(k, p) for k, p in keep.items()], "cell struct<source: string, lang: string, topic: string>, chance double"))
    else:
        fitted = _fit_as_frame(cells.where("tokens > 0"), targets)
        chances = _chances_as_frame(fitted, keep_share).select(*MARGINS, "mix_probability")
        chances = chances.union(cells.where("tokens = 0").select(*MARGINS, F.lit(1.0))).select(F.struct(*MARGINS).alias("cell"), F.col("mix_probability").alias("chance"))
    mine, theirs = rows.alias("mine"), chances.alias("theirs")
    own = lambda n: F.col(f"mine.{form}.{n}")
    joined = mine.join(theirs, [own(m) == F.col(f"theirs.cell.{m}") for m in MARGINS])
    chance = F.col("theirs.chance")
    kept = [F.col(f"mine.`{c}`") for c in rows.columns if c != form]
    return joined.where(own("draw") < chance).select(*kept, chance.alias("mix_probability"), (own("tokens") / chance).alias("mix_weight"))


def _chances_as_frame(fitted: DataFrame, keep_share: float) -> DataFrame:
    """keep_probabilities() for a fitted frame: full cells leave the budget's rest to the others, round after round."""
    whole = fitted.agg(F.sum("tokens")).first()[0] or 0
    budget, scale, before = keep_share * whole, 0.0, None
    ratio = F.when(F.col("tokens") > 0, F.col("share") / F.col("tokens")).otherwise(0.0)
    while True:
        # the scale only grows, and with it the full cells, so this ends
        full = ratio * scale >= 1
        has, rest, n = fitted.agg(F.sum(F.when(full, F.col("tokens")).otherwise(0)), F.sum(F.when(full, 0.0).otherwise(F.col("share"))), F.count_if(full)).first()
        if n == before or not rest:
            break
        if rest <= 1e-15:
            scale = 1e300  # what is left of the budget goes to all others, whole
            break
        scale, before = max(scale, (budget - has) / rest), n
    return fitted.withColumn("mix_probability", F.least(F.lit(1.0), ratio * scale))
