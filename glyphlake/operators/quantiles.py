"""Quantiles of any number of rows: sketches of bounded size that merge, exact values found through them, or interpolated ones for small groups."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphlake.operators.ranking import summed
from glyphlake.sources.shared import stored

#: Size of a sketch: ranks err by about 1.5 / K ** 0.9, which is 0.1 hundredths; groups of up to K rows are exact.
K = 4096
#: Shares of the rows, on both sides of a rank, that ``refined`` looks through first: several times the error of a sketch.
MARGIN = 0.004


def sketches(df: DataFrame, by: list[str], column: str, per: Column | None = None, k: int = K) -> DataFrame:
    """One sketch of ``column`` for each group, or for each group and ``per`` (a day, say): ``by, per, n, sketch``. Nulls are left out."""
    keys = [*by, *([per.alias("per")] if per is not None else [])]
    return df.where(F.col(column).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(F.col(column).cast("double"), F.lit(k)).alias("sketch"))


def merged(parts: DataFrame, by: list[str], k: int = K) -> DataFrame:
    """Sketches of groups from sketches of their parts. A part that is already merged may be merged again with newer ones."""
    return parts.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"))


def quantiles(found: DataFrame, shares: dict[str, float]) -> DataFrame:
    """A column for each share: the smallest value whose rank is at least that share of the rows."""
    at = F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(float(x)) for x in shares.values()]))
    return found.withColumn("__at", at).select(*[c for c in found.columns if c != "sketch"], *[F.get("__at", F.lit(i)).alias(name) for i, name in enumerate(shares)])


def refined(df: DataFrame, by: list[str], column: str, shares: dict[str, float], found: DataFrame, margin: float = MARGIN) -> DataFrame:
    """``by, n`` and a column for each share, as ``quantiles`` has them but exact: ``found`` are sketches of the same rows.

    A sketch says between which two values the wanted one lies; the rows below are counted, and those between are counted by value
    along sorted ranges, so no task sees a whole group. A rank that is not between them is looked for again farther out, in all rows
    if need be.
    """
    at = {i: (max(0.0, x - margin), min(1.0, x + margin)) for i, x in enumerate(shares.values())}
    value = lambda x: F.kll_sketch_get_quantile_double("sketch", F.lit(x))
    # Spark sorts NaN last, so it is the end that leaves out nothing.
    ends = [F.struct((value(lo) if lo > 0 else F.lit(float("-inf"))).alias("lo"), (value(hi) if hi < 1 else F.lit(float("nan"))).alias("hi")) for lo, hi in at.values()]
    own = [f"__own{i}" for i in range(len(by))]
    bounds = stored(found.select(*[F.col(c).alias(o) for c, o in zip(by, own, strict=True)], F.col("n").alias("__n"), F.array(*ends).alias("__ends")), "bounds")
    same = F.lit(True)
    for c, o in zip(by, own, strict=True):
        same = same & F.col(c).eqNullSafe(F.col(o))
    rows = df.where(F.col(column).isNotNull()).select(*by, F.col(column).cast("double").alias("__value")).join(bounds, same)
    near = F.filter(
        F.transform("__ends", lambda e, i: F.struct(i.alias("share"), F.when(F.col("__value") >= e["lo"], F.col("__value")).alias("value"), (F.col("__value") <= e["hi"]).alias("near"))),
        lambda x: x["near"],
    )
    rows = rows.select(*by, "__n", F.explode(near).alias("x")).groupBy(*by, "__n", F.col("x.share").alias("__share"), F.col("x.value").alias("__value")).agg(F.count(F.lit(1)).alias("__rows"))
    upto = summed(rows, [*by, "__share"], [F.col("__value").asc_nulls_first()], "__rows", "__upto")
    wanted = F.lit(None).cast("long")
    for i, x in enumerate(map(Fraction, map(str, shares.values()))):
        wanted = F.when(F.col("__share") == i, F.greatest(F.lit(1), F.call_function("div", F.col("__n") * x.numerator + (x.denominator - 1), F.lit(x.denominator)))).otherwise(wanted)
    hit = upto.where((F.col("__upto") >= wanted) & (F.col("__upto") - F.col("__rows") < wanted))
    values = [F.max(F.when(F.col("__share") == i, F.col("__value"))).alias(name) for i, name in enumerate(shares)]
    done = stored(hit.groupBy(*by, F.col("__n").alias("n")).agg(*values), "refined")
    missing = found.count() > done.dropna(subset=list(shares)).count()
    return refined(df, by, column, shares, found, 16 * margin) if missing and margin < 1 else done


def exact(column: str, shares: dict[str, float]) -> list[Column]:
    """Interpolated exact quantiles; a group's distinct values are held in one buffer, so for small groups only."""
    return [F.percentile(column, x).alias(name) for name, x in shares.items()]
