"""Recognition scores: accuracy, character and word error rate, confusions, comparison of systems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glyphlake.operators.alignment import edit_counts, pair_counts
from glyphlake.operators.quantiles import exact, refined, sketches
from glyphlake.operators.ranking import ranked


def joined_pairs(truth: DataFrame, predictions: DataFrame) -> DataFrame:
    """Truth and prediction of each sample and system."""
    return truth.join(predictions, "sample_id")


def accuracy(pairs: DataFrame, by: str = "system") -> DataFrame:
    hits = F.count_if(F.col("pred") == F.col("truth"))
    return pairs.groupBy(by).agg(F.count(F.lit(1)).alias("samples"), hits.alias("exact"), F.avg((F.col("pred") == F.col("truth")).cast("double")).alias("accuracy"))


EDITS = ("substitutions", "deletions", "insertions")


def _edits(c: str = "script") -> Column:
    return F.col(f"{c}.substitutions") + F.col(f"{c}.deletions") + F.col(f"{c}.insertions")


def _summed() -> list[Column]:
    return [F.sum(f"script.{kind}").cast("long").alias(kind) for kind in EDITS]


def cer(pairs: DataFrame, by: str = "system") -> DataFrame:
    """Substitutions, deletions and insertions over characters of the truth, of the corpus and as the mean of samples.

    A pair with a null text has neither edits nor characters.
    """
    scored = pairs.withColumn("script", edit_counts(F.col("truth"), F.col("pred")))
    length = F.when(F.col("pred").isNotNull(), F.length("truth"))
    return scored.withColumn("edits", _edits()).withColumn("length", length).groupBy(by).agg(
        *_summed(),
        F.sum("edits").cast("long").alias("edits"),
        F.sum("length").cast("long").alias("chars"),
        (F.sum("edits") / F.sum("length")).alias("cer"),
        F.avg(F.col("edits") / F.nullif(F.col("length"), F.lit(0))).alias("mean_cer"),
    )


def word_edits(truth: Column, pred: Column) -> Column:
    """Edits between two texts counted in words."""
    script = edit_counts(truth, pred, "word")
    return script["substitutions"] + script["deletions"] + script["insertions"]


def wer(pairs: DataFrame, by: str = "system") -> DataFrame:
    """The same in words; texts of any number of words."""
    words = F.when(F.col("pred").isNotNull(), F.size(F.regexp_extract_all("truth", F.lit(r"\S+"), F.lit(0))))
    scored = pairs.withColumn("script", edit_counts(F.col("truth"), F.col("pred"), "word")).withColumn("edits", _edits()).withColumn("length", words)
    return scored.groupBy(by).agg(*_summed(), F.sum("edits").cast("long").alias("edits"), F.sum("length").cast("long").alias("words"), (F.sum("edits") / F.sum("length")).alias("wer"))


def confusion(pairs: DataFrame, by: str = "system", top: int | None = None) -> DataFrame:
    """How often each truth was taken for each prediction, ranked within its system; exact matches left out.

    With ``top`` each task keeps that many of a system before the shuffle; without it, ranks are counted along sorted ranges. Either
    way no task ranks all pairs.
    """
    counts = pairs.where("truth <> pred").groupBy(by, "truth", "pred").agg(F.count(F.lit(1)).alias("n"))
    return _ranked(counts, by, top)


def _ranked(counts: DataFrame, by: str, top: int | None) -> DataFrame:
    order = [F.desc("n"), F.col("truth"), F.col("pred")]
    if top is None:
        return ranked(counts, [by], order).withColumn("rank", F.col("rank").cast("int"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= top)


def char_pairs(pairs: DataFrame, by: str = "system") -> DataFrame:
    """How often each character of a truth stands over each one of a prediction in the alignments: ``by, truth, pred, n``; '' stands for nothing."""
    each = pairs.select(by, F.explode(pair_counts(F.col("truth"), F.col("pred"))).alias("p"))
    return each.groupBy(by, F.col("p.truth").alias("truth"), F.col("p.pred").alias("pred")).agg(F.sum("p.n").alias("n"))


def char_confusion(pairs: DataFrame, by: str = "system", top: int | None = None) -> DataFrame:
    """Characters that were read as others, lost ('' as ``pred``) or made up ('' as ``truth``), ranked within their system."""
    return _ranked(char_pairs(pairs, by).where("truth <> pred"), by, top)


def char_errors(pairs: DataFrame, by: str = "system") -> DataFrame:
    """For each character of the truths: how often it occurs, and the share that was misread or lost."""
    seen = char_pairs(pairs, by).where("truth <> ''")
    wrong = F.sum(F.when(F.col("truth") != F.col("pred"), F.col("n")).otherwise(0))
    return seen.groupBy(by, "truth").agg(F.sum("n").alias("samples"), (wrong / F.sum("n")).alias("error_rate"))


def class_errors(pairs: DataFrame, by: str = "system") -> DataFrame:
    """Share of each truth class that was missed."""
    return pairs.groupBy(by, "truth").agg(F.count(F.lit(1)).alias("samples"), F.avg((F.col("truth") != F.col("pred")).cast("double")).alias("error_rate"))


LATENCIES = {"latency_p50": 0.5, "latency_p95": 0.95}


def compare_models(pairs: DataFrame, latencies: DataFrame, systems: list[str], params: DataFrame | None = None, small: bool = False) -> DataFrame:
    """One row per metric, one column per system: accuracy, cer, wer, latency (mean, median, 95th hundredth), parameters if given.

    Quantiles of latencies are exact values of rows, found through sketches; ``small`` holds them in memory for interpolated values. A system
    without data has nulls; a single system is a comparison of one column.
    """
    one = lambda df, metric: df.select("system", F.lit(metric).alias("metric"), F.col(metric).alias("value"))
    scores = one(accuracy(pairs), "accuracy").unionByName(one(cer(pairs), "cer")).unionByName(one(wer(pairs), "wer"))
    time = "processing_time_ms"
    scores = scores.unionByName(one(latencies.groupBy("system").agg(F.avg(time).alias("latency_ms")), "latency_ms"))
    speed = latencies.groupBy("system").agg(*exact(time, LATENCIES)) if small else refined(latencies, ["system"], time, LATENCIES, sketches(latencies, ["system"], time))
    for metric in LATENCIES:
        scores = scores.unionByName(one(speed, metric))
    if params is not None:
        scores = scores.unionByName(one(params.select("system", F.col("params").cast("double").alias("params")), "params"))
    return scores.groupBy("metric").pivot("system", systems).agg(F.max("value"))
