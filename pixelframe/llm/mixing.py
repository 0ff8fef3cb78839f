"""Mixing sources to target weights by temperature, with DataFrame functions only.

Source weights are token shares raised to an exponent and normalised.  The exponent is
found by bisection: the mixture meets a target entropy (a share of the logarithm of the number of sources),
from below (exponents under one make sources more even) as from above (exponents over one make large sources larger).
Where that would repeat a source more often than the limit, the exponent stops at the limit on its way from one.
The first pass finds a bracket, each further one evaluates the midpoints of five bisection steps in one aggregate over the
sources, and only those rows reach the driver.

The weights are realised under a token budget.  A source's documents fall into blocks by a
hash; a source is shown for as many whole epochs as its quota holds, and the rest is
taken from a permutation of its blocks, the last block in part, in the order of the hash.  Groups of ``BLOCKS`` blocks are
permuted, and the blocks within each, so no task orders all blocks of a source.
Per-document work is a hash and a join with the plan of (source, block), so a source with
a third of all rows is spread over its blocks.  The number of blocks follows the rows of the table unless ``blocks`` is
given, and with it which documents of a partly shown source are taken.

Defined results: a null text has no tokens; a null source is a source of its own; rows of
equal id and source stand or fall together; sources that exceed the repetition limit even as they are, or that no exponent
brings to the target (equal ones), are mixed as they are, with a warning; sources without tokens are shown once if
``cover`` is set and never otherwise; with an empty table the result is empty.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelframe.llm import scratch

#: Least blocks of a source, rows of a table for each block beyond that, steps of one pass, passes, doublings of the largest exponent.
BLOCKS, BLOCK_ROWS, STEPS, PASSES, DOUBLINGS = 1024, 4096, 5, 8, 20


def words(text: Column) -> Column:
    """Number of words, the token count of this operator."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x09-\x0D\x20]+")), F.lit(0)).cast("long")


def _midpoints(low: float, high: float, steps: int) -> list[float]:
    mid = (low + high) / 2
    return [mid] + (_midpoints(low, mid, steps - 1) + _midpoints(mid, high, steps - 1) if steps > 1 else [])


def bisect_exponent(sources: DataFrame, total: int, budget: int | None, entropy: float, repeats: float) -> float:
    """The exponent whose mixture of ``sources`` (tokens long) has the target entropy, or between one and it the last within the
    repetition limit; ``budget`` None: every document once."""
    logs = sources.where("tokens > 0").select(F.ln(F.col("tokens") / F.lit(total)).alias("lp"))
    top = logs.agg(F.max("lp")).first()[0]
    if top is None:  # no source has tokens
        return 1.0

    def state(points: list[float]) -> dict[float, tuple[float, bool]]:
        """(entropy less its target, within the repetition limit) at each exponent."""
        # Powers are relative to the largest share's, so that one of them is always 1.
        logged = F.col("a") * (F.col("lp") - top)
        power = F.exp(logged)
        shown = F.exp(logged - F.col("lp"))
        one = logs.select("lp", F.explode(F.array(*[F.lit(x) for x in points])).alias("a")).groupBy("a").agg(
            F.sum(power).alias("z"), F.sum(power * logged).alias("s"), F.count("*").alias("n"), F.max(shown).alias("most"), F.min(shown).alias("least"),
        )
        out = {}
        for r in one.collect():
            times = (r["most"] / r["least"] if r["least"] else math.inf) if budget is None else r["most"] / r["z"] * budget / total
            out[r["a"]] = math.log(r["z"]) - r["s"] / r["z"] - entropy * math.log(r["n"]), times <= repeats * (1 + 1e-12)
        return out

    at = state([2.0**k for k in range(DOUBLINGS + 1)])
    above, met = at[1.0]
    low, high = 0.0, 1.0
    if above > 0:  # sharper than the sources are
        high = next((2.0**k for k in range(1, DOUBLINGS + 1) if at[2.0**k][0] < 0 or not at[2.0**k][1]), 1.0)
        low = high / 2
    if not met or (above > 0 and high == 1.0):
        warnings.warn("no exponent brings the sources to the target entropy within the repetition limit; they are mixed as they are", stacklevel=3)
        return 1.0
    for _ in range(PASSES):
        at = state(_midpoints(low, high, STEPS))
        for _ in range(STEPS):
            mid = (low + high) / 2
            over, fits = at[mid]
            if above > 0:
                low, high = (mid, high) if over >= 0 and fits else (low, mid)
            else:
                low, high = (low, mid) if over <= 0 and fits else (mid, high)
    return low if above > 0 else high


def plan(docs: DataFrame, entropy: float, repeats: float, budget: int | None = None, cover: bool = False, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 1, blocks: int | None = None) -> DataFrame:
    """Every row of ``docs`` with ``n_tokens``, ``weight`` of its source and ``copies``.

    ``budget`` is in tokens (the tokens of ``docs`` if None); with ``cover`` it is what shows
    every document at least once.  Columns of these names in ``docs`` are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop(*[c for c in ("n_tokens", "weight", "copies") if c in docs.columns])
    key = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("null"))
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))
    if blocks is None:
        blocks = max(BLOCKS, -(-docs.count() // BLOCK_ROWS))
    block = F.conv(F.substring("__order", 1, 8), 16, 10).cast("long") % blocks
    small = docs.select(key.alias("__key"), order.alias("__order"), words(F.col(text_col)).alias("tokens")).withColumn("__block", block)
    small = scratch.table(small, "tokens")
    per_block = scratch.table(small.groupBy("__key", "__block").agg(F.sum("tokens").alias("tokens")), "blocks")
    sources = per_block.groupBy("__key").agg(F.sum("tokens").alias("tokens"))
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    whole = None if cover else (budget or total)
    a = bisect_exponent(sources, max(total, 1), whole, entropy, repeats)
    top = sources.agg(F.max("tokens")).first()[0] or 1
    power = F.when(F.col("tokens") > 0, F.exp(F.lit(a) * F.ln(F.col("tokens") / F.lit(top)))).otherwise(0.0)
    z, need = sources.agg(F.sum(power), F.max(F.when(F.col("tokens") > 0, F.col("tokens") / power))).first()
    z, need = z or 1.0, need or 0.0
    weight = power / F.lit(z)
    # Rounded first: a share that is met exactly must not lose a token to the last bit of a double.
    quota = F.greatest("tokens", F.floor(F.round(F.lit(need) * power, 3))) if cover else F.floor(F.round(F.lit(float(whole)) * weight, 3))
    quotas = sources.select("__key", F.round(weight, 9).alias("weight"), F.col("tokens").alias("all"), quota.cast("long").alias("quota"))
    once = F.when(F.col("all") > 0, F.expr("quota div `all`")).otherwise(F.lit(1 if cover else 0))
    quotas = quotas.select("__key", "weight", once.cast("int").alias("epochs"), F.when(F.col("all") > 0, F.expr("quota % `all`")).otherwise(F.lit(0)).alias("rest"))
    # The blocks of the last, partial epoch in permuted order: groups of blocks, and the blocks of each.
    turn = lambda *what: F.md5(F.concat_ws(":", F.lit(f"{seed}"), "__key", *[F.col(c).cast("string") if c[0] == "_" else F.lit(c) for c in what]).cast("binary"))
    grouped = per_block.withColumn("__group", F.floor(F.col("__block") / BLOCKS))
    groups = grouped.groupBy("__key", "__group").agg(F.sum("tokens").alias("group_tokens"))
    over = Window.partitionBy("__key").orderBy(turn("group", "__group"), "__group")
    groups = groups.withColumn("group_before", F.sum("group_tokens").over(over) - F.col("group_tokens")).join(quotas, "__key")
    within = Window.partitionBy("__key", "__group").orderBy(turn("__block"), "__block")
    cut = grouped.join(groups, ["__key", "__group"]).withColumn("before", F.col("group_before") + F.sum("tokens").over(within) - F.col("tokens"))
    cut = cut.withColumn("room", F.col("rest") - F.col("before")).select("__key", "__block", "weight", "epochs", "room", "tokens")
    cut = scratch.table(cut, "cut")
    partial = cut.where("room > 0 and room < tokens").select("__key", "__block", "room")
    n_cut = cut.count()
    inside = scratch.join_counted(small, partial, ["__key", "__block"], "inner", n_cut)
    up_to = Window.partitionBy("__key", "__block").orderBy("__order")  # peers of equal hash count together
    last = inside.withColumn("sum", F.sum("tokens").over(up_to)).where("sum <= room").groupBy("__key", "__block").agg(F.max("__order").alias("__last"))
    steps = scratch.table(cut.join(last, ["__key", "__block"], "left"), "plan")
    rows = docs.withColumns({"__key": key, "__order": order}).withColumn("__block", block)
    steps = steps.select("__key", "__block", F.struct("weight", "epochs", "room", "tokens", F.col("__last").alias("last")).alias("__plan"))
    rows = scratch.join_counted(rows, steps, ["__key", "__block"], "left", n_cut)
    step = F.col("__plan")
    extra = F.when((step["room"] > 0) & ((step["room"] >= step["tokens"]) | (F.col("__order") <= step["last"])), 1).otherwise(0)
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns], words(F.col(text_col)).alias("n_tokens"), step["weight"].alias("weight"), (step["epochs"] + extra).alias("copies"))


def mix(docs: DataFrame, entropy: float, repeats: float, **options) -> DataFrame:
    """``docs`` with each row as often as planned; ``options`` as of ``plan``."""
    named = [options.get("id_col", "doc_id"), options.get("text_col", "text"), options.get("source_col", "source")]
    planned = plan(docs.select(*named, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")), entropy, repeats, **options).where("copies > 0")
    return planned.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("__row.*")
