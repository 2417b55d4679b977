"""Alignments, quantile sketches and ranks against plain versions."""

from __future__ import annotations

import random
from bisect import bisect_left, bisect_right
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glyphlake.operators import alignment, dataset, quantiles, ranking, scoring


def plain(a, b):
    """Pairs of the alignment by the whole table of distances."""
    d = [[i + j for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            d[i][j] = min(d[i - 1][j - 1] + (x != y), d[i - 1][j] + 1, d[i][j - 1] + 1)
    found, i, j = Counter(), len(a), len(b)
    while i or j:
        if i and j and d[i][j] == d[i - 1][j - 1] + (a[i - 1] != b[j - 1]):
            found[a[i - 1], b[j - 1]] += 1
            i, j = i - 1, j - 1
        elif i and d[i][j] == d[i - 1][j] + 1:
            found[a[i - 1], None] += 1
            i -= 1
        else:
            found[None, b[j - 1]] += 1
            j -= 1
    return found


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="abcé", max_size=14), st.text(alphabet="abcdक", max_size=14))
def test_alignment_is_that_of_the_whole_table(a, b):
    assert alignment.aligned(a, b) == plain(a, b)


def test_alignment_in_parts(monkeypatch):
    """Stretches longer than a block are traced part by part, some of them cut again."""
    monkeypatch.setattr(alignment, "BLOCK", 8)
    monkeypatch.setattr(alignment, "PARTS", 3)
    draw = random.Random(2)
    for _ in range(60):
        a, b = ("".join(draw.choices("abc", k=draw.randint(0, 150))) for _ in range(2))
        assert alignment.aligned(a, b) == plain(a, b)


def test_many_distinct_words_are_scored(spark):
    """56,000 distinct words, of which every seventh is misread, every 1000th lost, and some made up."""
    words = [f"w{i}" for i in range(56_000)]
    read = [w + "x" if i % 7 == 0 else w for i, w in enumerate(words) if i % 1000 != 1]
    read[200:200] = ["new", "words"]
    pairs = spark.createDataFrame([("s", " ".join(words), " ".join(read)), ("s", "a b", None)], "system string, truth string, pred string")
    row = scoring.wer(pairs).first()
    assert (row["substitutions"], row["deletions"], row["insertions"], row["edits"], row["words"]) == (7992, 56, 2, 8050, 56_000)  # 8 of the lost words would have been misread


def test_scores_of_edge_texts(spark):
    pairs = [("a", "", ""), ("a", "", "xy"), ("a", "xy", ""), ("b", None, "x"), ("b", "x", None), ("c", "नमस्ते", "नमसते"), ("c", "abc", "abc")]
    df = spark.createDataFrame(pairs, "system string, truth string, pred string")
    got = {r["system"]: tuple(r)[1:6] for r in scoring.cer(df).collect()}
    assert got["a"] == (0, 2, 2, 4, 2) and got["c"] == (0, 1, 0, 1, 9)
    assert got["b"] == (None, None, None, None, None)
    lost = [(r["system"], r["truth"], r["pred"], r["n"]) for r in scoring.char_confusion(df).collect() if r["system"] == "c"]
    assert lost == [("c", "्", "", 1)]
    assert {r["truth"]: r["error_rate"] for r in scoring.char_errors(df.where("system = 'c'")).collect()} == {"न": 0, "म": 0, "स": 0, "्": 1, "त": 0, "े": 0, "a": 0, "b": 0, "c": 0}


def test_confusions_are_counted_from_alignments(spark):
    draw = random.Random(4)
    texts = ["".join(draw.choices("abcdef", k=40)) for _ in range(60)]
    read = ["".join(draw.choice(["", c, c, c, "x", c + "y"]) for c in t) for t in texts]
    df = spark.createDataFrame([(f"s{i % 2}", t, r) for i, (t, r) in enumerate(zip(texts, read, strict=True))], "system string, truth string, pred string")
    want = Counter()
    for i, (t, r) in enumerate(zip(texts, read, strict=True)):
        for (a, b), n in plain(t, r).items():
            want[f"s{i % 2}", a or "", b or ""] += n
    for top in (None, 4):
        got = scoring.char_confusion(df, top=top).collect()
        for s in ("s0", "s1"):
            ranked = sorted((r for r in got if r["system"] == s), key=lambda r: r["rank"])
            own = sorted(((a, b, n) for (x, a, b), n in want.items() if x == s and a != b), key=lambda x: (-x[2], x[:2]))
            assert [(r["truth"], r["pred"], r["n"]) for r in ranked] == own[:top] and [r["rank"] for r in ranked] == list(range(1, len(ranked) + 1))


def test_sketches_merge_within_their_error(spark):
    df = spark.range(200_000).select((F.col("id") % 3).alias("g"), (F.col("id") % 30).alias("day"), (F.pmod(F.xxhash64("id"), F.lit(10**6)) * (F.col("id") % 3 + 1)).cast("double").alias("v"))
    df = df.unionByName(spark.createDataFrame([(0, 0, None)], df.schema))
    shares = {"p01": 0.01, "p50": 0.5, "p95": 0.95}
    days = quantiles.sketches(df, ["g"], "v", F.col("day"))
    early, late = (quantiles.merged(days.where(f"per {op} 10"), ["g"]) for op in ("<", ">="))
    ways = [quantiles.sketches(df, ["g"], "v"), quantiles.merged(days, ["g"]), quantiles.merged(early.unionByName(late), ["g"])]
    values = {g: sorted(r["v"] for r in df.where(f"g = {g} AND v IS NOT NULL").collect()) for g in range(3)}
    for way in ways:
        for row in quantiles.quantiles(way, shares).collect():
            own = values[row["g"]]
            assert row["n"] == len(own)
            for name, share in shares.items():
                low, high = bisect_left(own, row[name]) / len(own), bisect_right(own, row[name]) / len(own)
                assert low - 0.004 <= share <= high + 0.004
    small = quantiles.quantiles(quantiles.sketches(df.where("v < 3000"), ["g"], "v"), shares).collect()
    for row in small:
        own = [v for v in values[row["g"]] if v < 3000]
        assert row["p50"] == own[-(-len(own) // 2) - 1]


@pytest.mark.parametrize("by", [[], ["g"]])
def test_ranks_along_ranges(spark, by):
    rows = spark.range(5000).select(F.when(F.col("id") % 5 > 0, "big").when(F.col("id") % 2 == 0, None).otherwise(F.concat(F.lit("g"), (F.col("id") % 7).cast("string"))).alias("g"), F.pmod(F.xxhash64("id"), F.lit(900)).alias("v"), "id")
    got = ranking.ranked(rows, by, [F.desc("v"), F.col("id")], "place").collect()
    assert len(got) == 5000
    for g in {r["g"] for r in got} if by else [0]:
        own = sorted((r for r in got if not by or r["g"] == g), key=lambda r: r["place"])
        assert [r["place"] for r in own] == list(range(1, len(own) + 1))
        assert [(-r["v"], r["id"]) for r in own] == sorted((-r["v"], r["id"]) for r in own)


def _ranked_values(values, shares):
    """The smallest value whose rank is at least each share: a percentage, so that no rounding is left."""
    own = sorted(values)
    return [own[max(1, -(-len(own) * share // 100)) - 1] for share in shares]


def _many(spark):
    return spark.range(90_000).select((F.col("id") % 3).alias("g"), (F.col("id") % 30).alias("day"), (F.pmod(F.xxhash64("id"), F.lit(10**6)) * (F.col("id") % 3 + 1)).cast("double").alias("v"))


def test_sizes_of_large_groups_are_exact(spark):
    df = _many(spark)
    got = {r["g"]: [r["p50"], r["p90"], r["p99"]] for r in dataset.size_distribution(df, "v", "g").collect()}
    assert got == {g: _ranked_values([r["v"] for r in df.where(f"g = {g}").collect()], (50, 90, 99)) for g in range(3)}


def test_refined_values_are_exact_wherever_the_sketch_points(spark):
    """Few distinct values, null groups, small groups and bounds that miss the value at first."""
    df = _many(spark).select(F.when(F.col("g") > 0, F.col("g")).alias("g"), F.floor(F.col("v") / 1000).alias("v")).unionByName(spark.createDataFrame([(9, 5), (9, None), (8, None)], "g long, v long"))
    held = {}
    for r in df.where("v IS NOT NULL").collect():
        held.setdefault(r["g"], []).append(float(r["v"]))
    want = {g: (len(v), _ranked_values(v, (1, 50, 100))) for g, v in held.items()}
    for margin in (1e-9, 0.004, 1.0):
        got = quantiles.refined(df, ["g"], "v", {"a": 0.01, "b": 0.5, "c": 1.0}, quantiles.sketches(df, ["g"], "v", k=8), margin)
        assert {r["g"]: (r["n"], [r["a"], r["b"], r["c"]]) for r in got.collect()} == want


def test_compared_latencies_of_many_rows_are_exact(spark):
    df = _many(spark).select(F.concat(F.lit("s"), (F.col("g") % 2).cast("string")).alias("system"), F.col("v").alias("processing_time_ms"))
    pairs = spark.createDataFrame([("s0", 1, "a b", "a b"), ("s1", 1, "a b", "a c")], "system string, sample_id long, truth string, pred string")
    got = {r["metric"]: [r["s0"], r["s1"]] for r in scoring.compare_models(pairs, df, ["s0", "s1"]).collect()}
    want = [_ranked_values([r[0] for r in df.where(f"system = '{s}'").select("processing_time_ms").collect()], (50, 95)) for s in ("s0", "s1")]
    assert [got["latency_p50"], got["latency_p95"]] == [list(x) for x in zip(*want, strict=True)]
