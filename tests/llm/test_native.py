"""License scan, exact dedup, sharding and quality rules."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from glyphlake.llm import exact_dedup, licenses, quality_rules, sharding
from tests.llm.brute import clean, verdict


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def collected(df, key="doc_id"):
    out = defaultdict(list)
    for r in df.collect():
        out[r[key]].append(r)
    return out


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# ---- licences


def base_of(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    at, labels = [], set()
    for phrase, label in licenses.BASE.items():
        own = phrase.split()
        found = [i for i in range(len(words)) if words[i : i + len(own)] == own]
        at += found
        labels |= {label} if found else set()
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_license_base_is_brute_force(spark, docs, edge):
    for table in (docs, edge.where("doc_id IS NOT NULL")):
        texts = {r["doc_id"]: r["text"] for r in table.select("doc_id", "text").collect()}
        for i, rows in collected(licenses.scan(table)).items():
            for r in rows:
                assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == base_of(texts[i])
                assert 0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))


def votes_of(words, index, text):
    """Labels and best share of a text by trying every cell of places."""
    cells = defaultdict(dict)
    for i, w in enumerate(words):
        for word, name, place, weight in index:
            if w == word:
                for cell in ((i - place) // licenses.DRIFT, (i - place) // licenses.DRIFT + 1):
                    cells[name, cell][word] = weight
    best = defaultdict(float)
    for (name, _), held in cells.items():
        best[name] = max(best[name], min(1.0, round(sum(held.values()), 6)))
    spaced = f" {' '.join(words)} "
    found = {n: x for n, x in best.items() if x >= licenses.LEAST_SHARE and any(f" {p} " in spaced for p in licenses.TEMPLATES[n][1])}
    return {n.split(" ")[0] for n in found}, max(found.values(), default=0.0)


def check_votes(table):
    rows = table.select("doc_id", "text").collect()
    words = {r["doc_id"]: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(r["text"])) for r in rows}
    counts = {w: sum(w in set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(r["text"]))) for r in rows) for w in licenses.licence_words()}
    index = licenses.positional_index(len(rows), counts)
    for r in licenses.scan(table).collect():
        labels, share = votes_of(words[r["doc_id"]], index, r)
        base = set(filter(None, r["base_labels"].split(",")))
        assert set(filter(None, r["labels"].split(","))) == base | labels
        assert r["score"] == (1.0 if base else pytest.approx(share, abs=1e-6))


def test_license_votes_are_brute_force(spark, docs, edge):
    full = {k: t for k, (t, _) in licenses.TEMPLATES.items()}
    rows = [(k, t) for k, t in enumerate(full.values())]
    rows += [(100 + k, t[: len(t) * 2 // 3] + " and then " + t[len(t) * 2 // 3 :]) for k, t in enumerate(full.values())]
    rows += [(200 + k, " ".join(sorted(t.split()))) for k, t in enumerate(full.values())]
    rows += [(300 + k, "intro\n" + t[len(t) // 2 :] + "\n" + full["mpl"]) for k, t in enumerate(full.values())]
    check_votes(spark.createDataFrame(rows, "doc_id long, text string"))
    check_votes(docs)
    check_votes(edge.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]))


def test_license_index_decides(spark):
    bsd = "x y. Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions"
    rows = [
        (1, bsd), (2, "binary forms"), (3, "the boost software license version is a joke about free software"), (4, "Mit Licensed work; mit license"),
        (5, "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
        (6, "MIT-LICENSE mit license"), (7, licenses.TEMPLATES["mpl"][0].replace("mozilla public license", "mozilla licence")), (8, "Licensed under CC BY-NC 4.0."), (9, "we talked of the mozilla public license at length"),
    ]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["labels"] == "bsd" and got[1]["base_labels"] == "" and got[1]["score"] >= licenses.LEAST_SHARE
    assert got[2]["labels"] == "" and got[2]["score"] == 0
    # A phrase without the wording is no licence, and a wording without its phrase isn't either.
    assert got[3]["labels"] == got[7]["labels"] == got[9]["labels"] == "" and got[3]["score"] == 0
    assert got[4]["labels"] == "mit" and (got[4]["first_word"], got[4]["last_word"]) == (3, 3)
    assert got[5]["labels"] == "gpl,lgpl"
    assert (got[6]["n_base"], got[6]["first_word"], got[6]["last_word"]) == (2, 0, 2)
    assert got[8]["labels"] == "cc"


def test_every_licence_of_a_file_is_found(spark):
    full = lambda *labels: "\n\n".join(licenses.TEMPLATES[k][0] for k in labels)
    bsd = licenses.TEMPLATES["bsd"][0]
    notices = full("apache", "mpl", "isc", "epl", "unlicense", "boost") + "\n\n" + bsd
    rows = [(1, notices)] + [(k, bsd) for k in range(2, 42)]
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == "apache,boost,bsd,epl,isc,mpl,unlicense" and got[2] == "bsd"


def test_license_null_ids_and_extra_columns(spark, edge):
    rows = licenses.scan(edge).collect()
    assert len(rows) == edge.count() and sum(r["doc_id"] is None for r in rows) == 2
    assert sorted(r["labels"] for r in rows if r["doc_id"] is None) == ["", "mit"]
    assert [r["n_words"] for r in rows if r["doc_id"] == 3] == [30_003]


def test_license_empty(none):
    assert licenses.scan(none).count() == 0


# ---- exact dedup


def groups_of(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[lower(t)].append(i)
    return groups


@pytest.mark.parametrize("digest", [exact_dedup.md5_bits, lambda c: F.substring(F.md5(c), 1, 1), lambda c: F.lit(b"same")])
def test_exact_groups(spark, edge, docs, digest):
    for table in (edge, docs):
        rows = [(r["doc_id"], r["text"]) for r in table.select("doc_id", "text").collect()]
        groups = groups_of(rows)
        want = sorted((str(i), str(max((x for x in groups[lower(t)] if x is not None), default=None)), len(groups[lower(t)]), hashlib.sha256(lower(t).encode()).hexdigest()) for i, t in rows)
        got = exact_dedup.exact_groups(table, digest=digest).collect()
        assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["text_sha256"]) for r in got) == want
        assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in got)


def test_exact_matches_sql(docs, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = sorted(con.execute(exact_dedup.ORACLE).fetchall())
    assert sorted(map(tuple, exact_dedup.exact_groups(docs).collect())) == want


@pytest.mark.parametrize("digest", [exact_dedup.md5_bits, lambda c: F.lit(b"same")])
def test_drop_copies_keeps_one_row_of_each_text(docs, digest):
    rows = {r["doc_id"]: r for r in docs.collect()}
    last = {lower(rows[i]["text"]): i for i in sorted(rows)}
    assert {r["doc_id"]: r for r in exact_dedup.drop_copies(docs, digest=digest).collect()} == {i: rows[i] for i in last.values()}


def test_drop_copies(edge, none):
    left = exact_dedup.drop_copies(edge)
    assert left.columns == edge.columns
    assert sorted((str(r["doc_id"]), (r["text"] or "")[:8]) for r in left.collect()) == [("2", ""), ("3", "lorem lo"), ("5", "mit lice"), ("6", "   \n\t "), ("7", "é ñ 日本 😀")]
    assert exact_dedup.drop_copies(none).count() == 0 and exact_dedup.exact_groups(none).count() == 0


# ---- sharding


def check_shards(table, shards=8):
    rows = table.collect()
    total, load, slots = sum(r["size"] for r in rows), defaultdict(int), defaultdict(list)
    for r in rows:
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < shards
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max((r["size"] for r in rows), default=0)
    assert all(abs(load[k] - total / shards) <= largest for k in range(shards))
    return rows


def test_shards(docs, edge, none):
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in check_shards(sharding.shard_by_bytes(docs)):
        assert r["size"] == len(texts[r["doc_id"]].encode()) + 1 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode())
    assert len(check_shards(sharding.shard_by_bytes(edge))) == edge.count()
    assert sharding.shard_by_bytes(none).count() == 0


def test_shards_split_a_hot_group(spark):
    table = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same text").otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("text"))
    check_shards(sharding.shard_by_bytes(table))


def test_shards_keep_small_groups_beside_a_hot_one(spark):
    text = F.when(F.col("id") % 3 == 0, "the same text").otherwise(F.concat(F.lit("t"), F.floor(F.col("id") / 6).cast("string")))
    rows = sharding.shard_by_bytes(spark.range(60_000).select(F.col("id").alias("doc_id"), text.alias("text"))).collect()
    of_group = defaultdict(set)
    for r in rows:
        if r["doc_id"] % 3:
            of_group[r["text_crc32"]].add(r["shard"])
    assert len(of_group) == 10_000 and sum(len(x) > 1 for x in of_group.values()) <= 7


def test_shard_placement_is_brute_force(docs):
    """Rows in the order of shards and slots: equal texts side by side, and each shard as its rows' middles say."""
    rows = sorted(sharding.shard_by_bytes(docs).collect(), key=lambda r: (r["shard"], r["slot"]))
    total, before, seen, last = sum(r["size"] for r in rows), 0, set(), None
    copies = Counter((r["text_crc32"], r["size"]) for r in rows)
    for r in rows:
        assert r["shard"] == min(7, int((before + r["size"] / 2) * 8 / total))
        before += r["size"]
        if (r["text_crc32"], r["size"]) != last:
            last = (r["text_crc32"], r["size"])
            assert last not in seen or copies[last] > sharding.OVERFULL  # a hot text in so small a table
            seen.add(last)


# ---- quality rules


def rules_of(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, covered = defaultdict(list), set()
    for i in range(len(words) - 2):
        seen[tuple(words[i : i + 3])].append(i)
    for at in seen.values():
        if len(at) > 1:
            covered |= {j for i in at for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    base = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in quality_rules.SYMBOLS for c in text), len(lines) - len(set(lines)), len(covered), base


def test_rule_counts(docs, edge):
    for table in (docs, edge.where("doc_id IS NOT NULL")):
        texts = {r["doc_id"]: r["text"] for r in table.select("doc_id", "text").collect()}
        for i, rows in collected(quality_rules.rule_report(table)).items():
            for r in rows:
                assert tuple(r[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == rules_of(texts[i])
                assert (r["n_failed_lines"], r["n_lost"], r["kept"]) == verdict(texts[i] or "", r["base_failed"])


def test_rules_null_ids_and_repeats(edge):
    rows = quality_rules.rule_report(edge).collect()
    assert len(rows) == edge.count() and sum(r["doc_id"] is None for r in rows) == 2 and sum(r["doc_id"] == 4 for r in rows) == 2
    assert [(r["n_words"], r["n_repeat_words"]) for r in rows if r["doc_id"] == 3] == [(30_003, 30_000)]


def test_rules_follow_labels(spark, docs, sf_dir):
    report = quality_rules.rule_report(docs).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").where("NOT base_failed").collect()
    assert all(r["kept"] == (r["quality"] == 1) for r in report)


def test_line_rules(spark):
    bad = ["a | b | c | d", "BUY THIS NOW OR ELSE", "x### y*** z%%%", "no " * 15, "Accept cookies to go on", " ".join(f"w{i}" for i in range(40))]
    good = ["A plain line of prose, with a mark.", "Es.", "", "Version 2.0 of the IP 10.0.0.1 notes; ok."]
    text = "\n".join(x for pair in zip(bad, good + good, strict=False) for x in pair)
    df = spark.createDataFrame([(text,)], "t string").select(quality_rules.clean_lines(F.col("t")))
    assert df.first()[0].split("\n") == (good + good)[: len(bad)]


MENU = ["Home", "Contact", *[f"Category number {i}" for i in range(7, 48)], "Impressum", "Mentions légales", "Log", "About us", "Map"]
VERSE = "\n".join(f"The road{i} went {i} miles,\nand we{i} went{i} along{i} it\nuntil day{i} was{i} done." for i in range(80))


def test_a_menu_page_is_rejected_and_short_prose_is_not(spark):
    wrapped = "\n".join(f"we{i} walked along{i} the river{i} and\ntalked{i} of what{i} we{i} had{i} seen{i} there{i}" for i in range(30))
    texts = ["\n".join(MENU), "\n\n".join(MENU), VERSE, wrapped, "\n".join(MENU[:4]) + "\n" + VERSE, "\n".join(MENU) + "\n" + VERSE]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    report = {r["doc_id"]: r for r in quality_rules.rule_report(df).collect()}
    assert [(report[i]["n_failed_lines"], report[i]["kept"]) for i in range(6)] == [(48, False), (48, False), (0, True), (0, True), (0, True), (48, True)]
    left = {r["doc_id"]: r["text"] for r in quality_rules.keep_good(df).collect()}
    assert sorted(left) == [2, 3, 4, 5] and left[5] == VERSE and left[4] == texts[4]


def test_line_rules_are_those_of_the_plain_version(spark):
    draw = random.Random(6)
    parts = ["Home", "About us", "", "  ", "A plain line of prose, with a mark.", "one two three four five", "Read more", "x | y | z", "Tous droits réservés 2024", "Say:", "東京", "東京。", "a  b", " pad ", "Menu\t", "end”"]
    texts = ["\n".join(draw.choices(parts, k=draw.randint(0, 30))) for _ in range(600)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["t"] for r in df.select("doc_id", quality_rules.clean_lines(F.col("text")).alias("t")).collect()}
    assert [got[i] for i in range(len(texts))] == [clean(t) for t in texts]
    for r in quality_rules.rule_report(df).collect():
        assert (r["n_failed_lines"], r["n_lost"], r["kept"]) == verdict(texts[r["doc_id"]], r["base_failed"])


def test_rules_keep_columns(edge, none):
    assert quality_rules.keep_good(edge).columns == edge.columns
    assert quality_rules.keep_good(none).count() == 0 and quality_rules.rule_report(none).count() == 0
