"""Mixing sources to target weights.

A source of token share p gets a weight in proportion to p to the power a, 0 <= a <= 1:
1 keeps the corpus as it is, 0 makes all sources equal. The exponent is found by bisection,
so that the weights reach a target entropy while no source is repeated more than a limit
allows. The weights become a sequence of blocks, each with all sources in their weights,
and each source passes over its documents in a new permutation as often as needed.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage

#: Entropy to reach, as a part of that of equal weights, and passes over a source at most.
TARGET_ENTROPY = 0.95
MAX_PASSES = 4.0
BLOCK_TOKENS = 1_000_000
SEED = 17
#: Documents of a pass that one window orders, on average, and slices that are summed together.
SLICE_ROWS = 1_000
TOGETHER = 1_024
#: Sources up to here are broadcast (a name and five numbers each); more are joined.
SENT_SOURCES = 100_000
_CUTS, _ROUNDS = 32, 5


@dataclass(frozen=True)
class Corpus:
    tokens: int
    sources: int
    smallest: int


def counted(docs: DataFrame) -> DataFrame:
    """``(doc_id, source, n_tokens)``: words between ASCII white space; a null source counts
    as the empty name, a null text has no token."""
    return docs.select(
        "doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(r"\S+")).cast("long").alias("n_tokens"),
    )


def _moments(shares: DataFrame, exponents: list[float]) -> list[tuple[float, float]]:
    """For each exponent: the logarithm of the sum of p^a, and the entropy of the weights."""
    sums = []
    for i, a in enumerate(exponents):
        power = F.pow("p", F.lit(a))
        sums += [F.sum(power).alias(f"z{i}"), F.sum(power * F.log("p")).alias(f"g{i}")]
    row = shares.agg(*sums).first()
    return [(math.log(row[f"z{i}"]), math.log(row[f"z{i}"]) - a * row[f"g{i}"] / row[f"z{i}"]) for i, a in enumerate(exponents)]


def find_exponent(shares: DataFrame, corpus: Corpus, budget: int, target_entropy: float, max_passes: float) -> float:
    """The smallest exponent whose entropy is no more than the target and whose smallest
    source, always the most repeated, is passed over ``max_passes`` times at most. Each round
    cuts the interval at 31 places, from sums over the sources. Rounded to six digits.
    """
    if corpus.sources < 2:
        return 1.0
    target = target_entropy * math.log(corpus.sources)
    least = math.log(corpus.smallest / corpus.tokens)
    low, high = 0.0, 1.0

    def holds(a: float, logz: float, entropy: float) -> bool:
        passes = (a - 1) * least - logz + math.log(budget / corpus.tokens)
        return entropy <= target + 1e-12 and passes <= math.log(max_passes) + 1e-12

    if holds(0.0, *_moments(shares, [0.0])[0]):
        return 0.0
    for _ in range(_ROUNDS):
        cuts = [low + (high - low) * i / _CUTS for i in range(1, _CUTS)]
        good = [a for a, m in zip(cuts, _moments(shares, cuts)) if holds(a, *m)]
        high = min(good, default=high)
        low = max([a for a in cuts if a < high], default=low)
    return round(high, 6)


def weights(tokens: DataFrame, budget: int | None = None, target_entropy: float = TARGET_ENTROPY, max_passes: float = MAX_PASSES) -> tuple[DataFrame, int, Corpus]:
    """``(source, source_tokens, weight, budget)`` for the sources of ``tokens``, the budget of
    all in tokens (the corpus as it is, unless given), and what the corpus holds. Sources
    without any token get no weight. ``max_passes`` cannot be kept if the budget alone is
    larger than so many passes over everything; then all sources keep their shares.
    """
    totals = stage(tokens.groupBy("source").agg(F.sum("n_tokens").alias("source_tokens")).where("source_tokens > 0"), "sources")
    row = totals.agg(F.sum("source_tokens"), F.count(F.lit(1)), F.min("source_tokens")).first()
    corpus = Corpus(row[0] or 0, row[1], row[2] or 0)
    budget = corpus.tokens if budget is None else budget
    shares = totals.withColumn("p", F.col("source_tokens") / F.lit(max(1, corpus.tokens)))
    exponent = find_exponent(shares, corpus, max(1, budget), target_entropy, max_passes)
    norm = math.exp(_moments(shares, [exponent])[0][0]) if corpus.sources else 1.0
    weighted = shares.withColumn("weight", F.pow("p", F.lit(exponent)) / F.lit(norm))
    whole = F.round(F.col("weight") * F.lit(budget)).cast("long")
    return weighted.select("source", "source_tokens", "weight", whole.alias("budget")), budget, corpus


def _draw(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(SEED), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def _tokens_before(draws: DataFrame, rows: int) -> DataFrame:
    """Adds ``before``: the tokens of the draws of the same source and pass that come earlier
    in the order of ``h``. The order is cut into slices by the leading bits of ``h``; slices
    are summed, the sums summed in turn, and no window sees a whole source.
    """
    slices = 1 << max(0, (rows // SLICE_ROWS).bit_length())
    cut = (F.conv(F.substring("h", 1, 8), 16, 10).cast("long") * F.lit(slices) / F.lit(1 << 32)).cast("long")
    sliced = draws.withColumn("slice", cut)
    keys = ["source", "pass"]

    def earlier(*group: str, order: list[str]):
        return Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)

    def before(column: str, window) -> Column:
        return F.coalesce(F.sum(column).over(window), F.lit(0))

    sums = sliced.groupBy(*keys, "slice").agg(F.sum("n_tokens").alias("t")).withColumn("group", F.expr(f"slice div {TOGETHER}"))
    groups = sums.groupBy(*keys, "group").agg(F.sum("t").alias("g"))
    groups = groups.select(*keys, "group", before("g", earlier(*keys, order=["group"])).alias("g_before"))
    offsets = sums.withColumn("s_before", before("t", earlier(*keys, "group", order=["slice"]))).join(groups, [*keys, "group"])
    local = sliced.withColumn("l_before", before("n_tokens", earlier(*keys, "slice", order=["h", "doc_id", "n_tokens"])))
    joined = local.join(offsets.select(*keys, "slice", (F.col("s_before") + F.col("g_before")).alias("o_before")), [*keys, "slice"])
    return joined.withColumn("before", F.col("l_before") + F.col("o_before")).drop("slice", "l_before", "o_before")


def mix(docs: DataFrame, budget: int | None = None, target_entropy: float = TARGET_ENTROPY, max_passes: float = MAX_PASSES, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``(doc_id, source, pass, block, place, n_tokens, weight)``: one row per drawn document.

    A source's sequence is its documents in the hash order of pass 0, then pass 1, and so
    on, until its budget is reached; the document that reaches it is the last. A draw's block
    is its place in that sequence scaled to the number of blocks, so each block holds all
    sources in their weights; inside a block draws are permuted by hash. Rows that repeat an
    id are drawn each. Nothing is drawn from an empty table.
    """
    tokens = stage(counted(docs), "tokens")
    weighted, budget, corpus = weights(tokens, budget, target_entropy, max_passes)
    if corpus.sources <= SENT_SOURCES:
        weighted = F.broadcast(weighted)
    blocks = max(1, -(-budget // block_tokens))
    known = tokens.join(weighted, "source").withColumn("last", F.expr("(budget - 1) div source_tokens"))
    draws = known.where("budget > 0").withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))))
    draws = draws.withColumn("h", _draw(F.col("pass"), F.col("doc_id")))
    placed = _tokens_before(draws, tokens.count()).withColumn("at", F.col("pass") * F.col("source_tokens") + F.col("before"))
    taken = placed.where("at < budget").withColumn("block", F.floor(F.col("at").cast("double") * F.lit(float(blocks)) / F.col("budget")))
    # a block holds about ``block_tokens`` tokens whatever the size of the corpus
    inside = Window.partitionBy("block").orderBy(_draw(F.col("block"), F.col("pass"), F.col("doc_id")), "source", "doc_id", "n_tokens")
    return taken.select(
        "doc_id", "source", F.col("pass").cast("int").alias("pass"), "block",
        F.row_number().over(inside).alias("place"), "n_tokens", F.round("weight", 9).alias("weight"),
    )
