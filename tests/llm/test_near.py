"""N-gram Jaccard join, components and the pipeline."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from glyphlake.llm import components, near_join, packing, personal_data, quality_rules
from glyphlake.llm.common import stored, tokenizer_path
from tests.llm.brute import clean as without_failing_lines


def brute(texts: dict, width: int, percent: int) -> dict:
    """(set size, component) of each id by counting shared shingles of all pairs."""
    sets = {}
    for i, t in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(words[j : j + width]) for j in range(max(1, len(words) - width + 1))} if words else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for i in sorted(sets):
        shared = Counter(j for x in sets[i] for j in where[x])
        for j, o in shared.items():
            if 100 * o >= percent * (len(sets[i]) + len(sets[j]) - o):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
        for x in sets[i]:
            where[x].append(i)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        at = rng.randrange(len(words))
        words[at : at + rng.randint(0, 1)] = [rng.choice("abcdefghij") for _ in range(rng.randint(0, 2))]
    return words


@pytest.mark.parametrize("frequent,width,percent", [(32, 4, 85), (3, 4, 85), (2, 5, 80), (2, 3, 70)])
def test_components_are_brute_force(spark, monkeypatch, frequent, width, percent):
    monkeypatch.setattr(near_join, "FREQUENT", frequent)
    monkeypatch.setattr(near_join, "COUNT_AT_ONCE", 500)
    rng, texts = random.Random(frequent * 100 + percent), {}
    for family in range(12):
        origin = [rng.choice("abcdefghijklmnopqrstuvwxyz") + rng.choice("aeiou") for _ in range(rng.choice((1, 2, 4, 6, 9, 20, 60, 150, 400)))]
        for _ in range(rng.randint(1, 14)):
            words = edited(rng, origin, rng.randint(0, 4)) if len(origin) > 3 else origin
            texts[len(texts) * 3 + 1] = rng.choice((" ", "\n", "  ")).join(words)
    texts[2], texts[5], texts[8] = "", None, "   "
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_join.near_components(df, width, percent).collect()}
    assert got == brute(texts, width, percent)


def test_null_ids_link_and_bridge(spark):
    rng = random.Random(6)
    words = [rng.choice("abcdefghij") + str(k) for k in range(60)]
    step = lambda k: " ".join(words[k : k + 50])
    rows = [(7, step(0)), (None, step(2)), (3, step(4)), (None, step(4)), (None, step(30)), (None, "x y"), (9, step(10) + " z")]
    got = near_join.near_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()
    # 7 and 3 are too far apart; the null id between them links both.
    assert brute({0: step(0), 1: step(4)}, 4, 85)[1][1] == 1 and brute({0: step(0), 1: step(2), 2: step(4)}, 4, 85)[2][1] == 0
    assert sorted(((str(r["doc_id"]), str(r["component_id"])) for r in got)) == sorted([("7", "3"), ("None", "3"), ("3", "3"), ("None", "3"), ("None", "None"), ("None", "None"), ("9", "9")])


@pytest.mark.parametrize("percent", [70, 80, 85, 90])
def test_sets_that_link_share_a_key(percent):
    rng = random.Random(percent)
    for _ in range(6_000):
        size = rng.choice((rng.randint(1, 30), rng.randint(1, 140)))
        tokens = np.unique(np.array([rng.getrandbits(64) for _ in range(size)], np.uint64))
        frequent = np.array([rng.random() < rng.choice((1, 0.9, 0.5)) for _ in tokens])
        rare_first, own = np.argsort(frequent, kind="stable"), size * (100 - percent) // 100
        gone = rare_first[rng.randint(0, 3) :: 3][:own] if rng.random() < 0.5 else np.array(rng.sample(range(size), own), int)
        of_a = np.array([rng.random() < rng.choice((0, 0.06, 0.5, 1)) for _ in gone], bool)
        in_a, in_b = np.ones(size, bool), np.ones(size, bool)
        in_a[gone[of_a]], in_b[gone[~of_a]] = False, False
        if (in_a & in_b).sum() * 100 >= percent * size:
            keys = [near_join.keys_of(tokens[x], frequent[x], percent) for x in (in_a, in_b)]
            assert np.intersect1d(*keys).size


def test_query_is_brute_force(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_join.op4_ngram_jaccard(spark, sf_dir).collect()}
    assert got == brute(texts, 4, 85)


def test_many_ids_are_joined(spark, sf_dir, edge, monkeypatch):
    """Where the filter of ids would grow too large, a join fetches the same sets."""
    want = [sorted(map(str, near_join.near_components(t).collect())) for t in (edge, spark.read.parquet(f"{sf_dir}/documents.parquet"))]
    monkeypatch.setattr(near_join, "MAX_ID_BITS", 1)
    assert [sorted(map(str, near_join.near_components(t).collect())) for t in (edge, spark.read.parquet(f"{sf_dir}/documents.parquet"))] == want


def test_near_edge(edge, none):
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in near_join.near_components(edge).collect())
    assert [g for g in got if g[0] in "124567"] == [("1", 0, "1"), ("2", 0, "2"), ("4", 1, "4"), ("4", 1, "4"), ("5", 1, "4"), ("6", 0, "6"), next(g for g in got if g[0] == "7")]
    assert ("None", 1, "4") in got and ("None", 0, "None") in got
    assert near_join.near_components(none).count() == 0
    left = near_join.drop_near_copies(edge)
    assert left.columns == edge.columns and left.where("doc_id = 5").count() == 0 and left.where("doc_id = 4").count() == 2


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7), (500, 499)]
    got = {r["node"]: r["label"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + k: 100 for k in range(30)}, 499: 499, 500: 499}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline_is_brute_force(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    good = {r["doc_id"] for r in quality_rules.rule_report(documents).where("kept").collect()}
    texts = {r["doc_id"]: r["text"] for r in documents.collect() if r["doc_id"] in good}
    texts = {i: without_failing_lines(t) for i, t in texts.items()}
    last = {}
    for i in sorted(texts):
        last["".join(c.lower() if "A" <= c <= "Z" else c for c in texts[i])] = i
    unique = {i: texts[i] for i in last.values()}
    near = brute(unique, 5, 80)
    left = {i: t for i, t in unique.items() if near[i][1] == i}
    docs, at = documents, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = at[name] = stored(stage(spark, docs, sf_dir), name)
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in at["quality_rules"].collect()} == {i: (t, len(t)) for i, t in texts.items()}
    assert {r["doc_id"] for r in at["exact_dedup"].collect()} == set(unique)
    assert {r["doc_id"] for r in at["ngram_jaccard"].collect()} == set(left)
    assert all(at[n].columns == documents.columns for n, _ in corpus_pipeline.STAGES[:-1])
    clean = {r["doc_id"]: r["text"] for r in at["pii"].collect()}
    assert set(clean) == set(left) and not any(personal_data.base_spans(t) for t in clean.values())
    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    tokens = {r["doc_id"]: r["doc_tokens"] for r in at["packing"].collect()}
    assert tokens == {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in clean.items()}
    assert packing.CAPACITY == 2048


def test_pipeline_edge(spark, edge, none):
    rng = random.Random(9)
    good = "\n".join(" ".join(rng.choice("stone river field house cloud light paper green quiet early".split()) + str(rng.randint(1, 99)) for _ in range(14)) + "." for _ in range(12))
    other = "\n".join(" ".join(rng.choice("night ocean metal sugar piano".split()) + str(rng.randint(1, 99)) for _ in range(14)) + "." for _ in range(12))
    names = [c for c in edge.columns if c not in ("doc_id", "text")]
    rows = [(20, good), (20, good), (21, good.replace("stone", "STONE")), (None, good + " And more is said of it."), (None, None), (22, other + "\nwrite to a@b.co"), (23, good + "\n| home | news | about | more |")]
    docs = edge.unionByName(spark.createDataFrame([(*r, *names) for r in rows], edge.schema))
    at = docs
    for name, stage in corpus_pipeline.STAGES:
        at, before = stored(stage(spark, at, ""), name), at
        assert name == "packing" or at.columns == docs.columns
    kept = {r["doc_id"]: r["text"] for r in before.collect()}
    assert 22 in kept and "<email>" in kept[22] and not any("| home" in t for t in kept.values()) and all(t for t in kept.values())
    assert at.count() >= len(kept)
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, "")
        assert none.count() == 0
