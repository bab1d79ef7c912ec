"""Mixing sources by temperature, with DataFrame functions only.

A source's weight is proportional to its token share to the power of an exponent.  The exponent is
bisected, several levels of the bisection a job, until the weights have a target entropy or no
source is repeated more than a limit.  The weights times a token budget are then realised as
permuted blocks: a source with n texts is dealt by hash into about sqrt(n) blocks, each epoch puts
the blocks in another order, and texts are taken from the front until the source's budget is met.
Positions are block offset plus place in the block, so no source, however large, is sorted or summed
in one task: neither a source's blocks nor a block's texts are more than about sqrt(n) rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage, text_of

WORD = "[^\\x20\\x09-\\x0D]+"
LEVELS = 5  # of the bisection, a job
ROUNDS = 8
HIGHEST = 16.0  # exponent


@dataclass(frozen=True)
class Target:
    """What the exponent has to meet, and the tokens to emit.

    evenness: entropy of the weights as a fraction of log2(sources); the largest exponent that has
        it is taken.  max_repetition: most epochs of any source; the smallest exponent from 0 to 1
        that keeps to it is taken (1 if none does).  Exactly one of the two is given.
    highest: exponents above it are not tried; 1 never sharpens the input's own shares.
    budget: tokens; "corpus": as many as the input has; "cover": the least that uses each text once.
    silent: with "cover", sources without a token are emitted, too: once, with weight 0.
    """

    evenness: float | None = None
    max_repetition: float | None = None
    highest: float = HIGHEST
    budget: int | str = "corpus"
    silent: bool = False

    def __post_init__(self):
        if (self.evenness is None) == (self.max_repetition is None):
            raise ValueError("give either evenness or max_repetition")
        if self.silent and self.budget != "cover":
            raise ValueError("silent goes with budget 'cover'")


def hashed(seed: str, *parts: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), *(p.cast("string") for p in parts)))


def token_counts(docs: DataFrame, text_col: str = "text") -> Column:
    """Words of a text, as the tokens that shares and budgets count."""
    return F.regexp_count(text_of(docs, text_col), F.lit(WORD)).cast("long")


def find_exponent(sources: DataFrame, total: int, target: Target) -> float:
    """sources: (source, tokens), tokens positive.  A job looks at 2**LEVELS - 1 exponents."""
    n = sources.count()
    low, high, parts = 0.0, target.highest if target.evenness is not None else 1.0, 2**LEVELS
    share = F.col("tokens") / F.lit(float(total))
    for _ in range(ROUNDS):
        step = (high - low) / parts
        each = F.explode(F.array(*(F.lit(low + step * i) for i in range(1, parts)))).alias("x")
        rows = sources.select(share.alias("p"), each)
        sums = rows.groupBy("x").agg(F.sum(F.pow("p", "x")).alias("z"), F.sum(F.pow("p", "x") * F.log("p")).alias("s"), F.max(F.pow("p", F.col("x") - 1)).alias("r"))
        got = sorted(tuple(r) for r in sums.collect())
        if target.evenness is not None:
            aim = target.evenness * math.log(n) if n else 0.0
            k = sum(math.log(z) - x * s / z >= aim for x, z, s, _ in got)
        else:
            budget = total if isinstance(target.budget, str) else target.budget
            k = sum(r / z * budget / total > target.max_repetition for _, z, _, r in got)
        low, high = low + step * k, low + step * (k + 1)
    return low if target.evenness is not None else high


def weights(sources: DataFrame, total: int, exponent: float, budget: int | str) -> DataFrame:
    """(source, tokens, texts, weight, budget): budget is the source's tokens to emit, rounded down."""
    powered = sources.withColumn("_power", F.pow(F.col("tokens") / F.lit(float(total)), F.lit(exponent)))
    z = powered.agg(F.sum("_power")).first()[0]
    weighted = powered.withColumn("weight", F.col("_power") / F.lit(z)).drop("_power")
    if budget == "cover":
        whole = F.ceil(weighted.agg(F.max(F.col("tokens") / F.col("weight"))).first()[0] * F.col("weight"))
        return weighted.withColumn("budget", F.greatest(whole.cast("long"), F.col("tokens")))
    amount = float(total if budget == "corpus" else budget)
    return weighted.withColumn("budget", F.floor(F.col("weight") * F.lit(amount)).cast("long"))


def mix(
    docs: DataFrame,
    target: Target,
    seed: str = "mix",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    carry: list[str] | None = None,
) -> DataFrame:
    """Emit texts source by source until each source's token budget is met.

    Returns (doc_id, source, n_tokens, weight, epoch from 0, block, position: tokens of the source
    emitted before it in its epoch, *carry), one row per emission; the last emission of a source may
    pass the budget by part of a text.  carry: further columns of the input.

    A null source counts as the source "".  A source without a token has no share and is not
    emitted, unless ``target.silent``; texts without tokens cost nothing.  With budget "cover" every
    text is in epoch 0, also those without tokens that come last.  A carried column replaces an output of its name.  Rows that repeat are texts of their own (told apart
    by identifier only for the order, so ties share a position).  An empty table gives no rows.
    """
    carry = list(carry or [])
    kept = [docs[c].alias(f"_c{k}") for k, c in enumerate(carry)]
    own = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[source_col].cast("string"), F.lit("")).alias("source"), token_counts(docs, text_col).alias("n_tokens"), *kept)
    own = stage(own, "tokens")
    every = stage(own.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("texts")), "sources")
    sources = every.filter("tokens > 0")
    total = sources.agg(F.sum("tokens")).first()[0] or 1
    plan = weights(sources, total, find_exponent(sources, total, target), target.budget)
    if target.silent:
        plan = plan.unionByName(every.filter("tokens = 0").withColumns({"weight": F.lit(0.0), "budget": F.lit(0).cast("long")}))
    plan = plan.withColumn("blocks", F.ceil(F.sqrt("texts")).cast("long"))

    rank = hashed(seed, F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    dealt = own.join(plan.select("source", "blocks", "weight"), "source").withColumn("_rank", rank)
    dealt = dealt.withColumn("block", F.conv(F.substring("_rank", 1, 8), 16, 10).cast("long") % F.col("blocks"))
    inside = Window.partitionBy("source", "block").orderBy("_rank", "doc_id").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    # a range frame gives ties the same sum, whatever their order; they are counted from where they begin
    tied = Window.partitionBy("source", "block", "_rank", "doc_id")
    placed = dealt.withColumn("_before", F.sum("n_tokens").over(inside) - F.sum("n_tokens").over(tied))

    sizes = dealt.groupBy("source", "block").agg(F.sum("n_tokens").alias("size"))
    epochs = plan.select("source", "tokens", "budget", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("budget") / F.greatest("tokens", F.lit(1))) - 1, F.lit(0)).cast("long"))).alias("epoch"))
    ordered = Window.partitionBy("source", "epoch").orderBy(hashed(seed, F.col("source"), F.col("block"), F.col("epoch")), "block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = (F.col("epoch") == 0) & F.lit(target.budget == "cover")
    schedule = sizes.join(epochs, "source").withColumn("_offset", F.sum("size").over(ordered) - F.col("size"))
    schedule = schedule.withColumn("_left", F.col("budget") - F.col("epoch") * F.col("tokens")).filter((F.col("_offset") < F.col("_left")) | whole)
    out = placed.join(schedule.select("source", "block", "epoch", "_offset", "_left"), ["source", "block"])
    out = out.withColumn("position", F.col("_offset") + F.col("_before")).filter((F.col("position") < F.col("_left")) | whole)
    own_names = ["doc_id", "source", "n_tokens", "weight", "epoch", "block", "position"]
    return out.select(*(c for c in own_names if c not in carry), *(F.col(f"_c{k}").alias(c) for k, c in enumerate(carry)))


def oracle(evenness: float, seed: str = "mix") -> str:
    """DuckDB SQL for the rows of ``mix`` with an evenness and the corpus's own tokens as budget."""
    parts, aim = 2**LEVELS, f"{evenness}::DOUBLE * ln(n)"
    z = "list_sum(list_transform(ps, lambda p: pow(p, {x})))"
    s = "list_sum(list_transform(ps, lambda p: pow(p, {x}) * ln(p)))"
    x = f"(lo + (hi - lo) / {parts} * i)"
    k = f"len(list_filter(range(1, {parts}), lambda i: ln({z.format(x=x)}) - {x} * {s.format(x=x)} / {z.format(x=x)} >= {aim}))"
    return f"""
        WITH RECURSIVE own AS (
            SELECT doc_id, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens,
                   md5('{seed}|' || coalesce(doc_id::VARCHAR, '')) AS rank FROM documents),
        sources AS (SELECT source, sum(n_tokens)::BIGINT AS tokens, count(*) AS texts FROM own GROUP BY source HAVING sum(n_tokens) > 0),
        whole AS (SELECT sum(tokens)::DOUBLE AS total FROM sources),
        shares AS (SELECT list(tokens / total) AS ps, count(*)::DOUBLE AS n FROM sources, whole),
        bisected AS (
            SELECT 0 AS round, 0::DOUBLE AS lo, {HIGHEST}::DOUBLE AS hi
            UNION ALL
            SELECT round + 1, lo + (hi - lo) / {parts} * k, lo + (hi - lo) / {parts} * (k + 1)
            FROM (SELECT round, lo, hi, {k} AS k FROM bisected, shares WHERE round < {ROUNDS})),
        exponent AS (SELECT lo AS x FROM bisected WHERE round = {ROUNDS}),
        powers AS (SELECT source, tokens, texts, pow(tokens / total, x) AS power, total FROM sources, whole, exponent),
        plan AS (SELECT source, tokens, power / sum(power) OVER () AS weight, ceil(sqrt(texts))::BIGINT AS blocks,
                        floor(power / sum(power) OVER () * total)::BIGINT AS budget FROM powers),
        dealt AS (SELECT own.*, weight, ('0x' || rank[1:8])::BIGINT % blocks AS block FROM own JOIN plan USING (source)),
        placed AS (SELECT *, (sum(n_tokens) OVER (PARTITION BY source, block ORDER BY rank, doc_id) - sum(n_tokens) OVER (PARTITION BY source, block, rank, doc_id))::BIGINT AS before FROM dealt),
        epochs AS (SELECT source, tokens, budget, unnest(range(greatest(ceil(budget / tokens), 1)::BIGINT)) AS epoch FROM plan),
        sizes AS (SELECT source, block, sum(n_tokens)::BIGINT AS size FROM dealt GROUP BY ALL),
        schedule AS (
            SELECT source, block, epoch, budget - epoch * tokens AS rest,
                   (sum(size) OVER (PARTITION BY source, epoch ORDER BY md5('{seed}|' || source || '|' || block || '|' || epoch), block ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS shift
            FROM sizes JOIN epochs USING (source))
        SELECT doc_id, source, n_tokens, weight, epoch, block, shift + before AS position
        FROM placed JOIN schedule USING (source, block) WHERE shift + before < rest"""
