"""Merkle manifest against trees built plainly, and against SQL."""

from __future__ import annotations

import hashlib
import zlib

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glyphlake.llm import manifest

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, more=0):
    parts = []
    for f in FIELDS:
        v = row[f]
        v = v + more if f == "n_chars" and v is not None else v
        parts.append("-" if v is None else f"{len(str(v).encode())}:{v}")
    return h(*parts)


def tree(nodes):
    """Levels from the leaves to the root."""
    levels = [list(nodes)]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def siblings(levels, i):
    return [(level[i >> k ^ 1] if i >> k ^ 1 < len(level) else None, i >> k & 1) for k, level in enumerate(levels[:-1])]


def expected(rows):
    langs = sorted({r["lang"] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    own = {x: sorted((r for r in rows if r["lang"] == x), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r))) for x in langs}
    trees = {x: tree([leaf(r) for r in own[x]]) for x in langs}
    top = tree([trees[x][-1][0] for x in langs])
    out = []
    for k, x in enumerate(langs):
        for i, r in enumerate(own[x]):
            way = siblings(trees[x], i) + siblings(top, k)
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            node = leaf(r, 1 if hit else 0)
            for sibling, right in way:
                node = h(node) if sibling is None else h(sibling, node) if right else h(node, sibling)
            out.append((r["doc_id"], leaf(r), trees[x][-1][0], top[-1][0], h(*[s for s, _ in way if s]), node, node == top[-1][0]))
    return out


def plain(rows):
    return sorted(map(tuple, rows), key=str)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([tuple(r[f] for f in ("doc_id", "text", "lang", "source", "n_chars")) for r in rows], SCHEMA)


@pytest.mark.parametrize("size", [1, 2, 3, 5])
def test_few_rows(spark, size):
    rows = [{"doc_id": i, "text": f"t{i}", "lang": "en", "source": None, "n_chars": 2} for i in range(size)]
    assert plain(manifest.manifest(frame(spark, rows)).collect()) == plain(expected(rows))


def test_partitions_and_edges(spark):
    """More leaves than a partition holds, a power of two, nulls in every column, repeated rows, and many small languages."""
    rows = [{"doc_id": i, "text": f"text {i}", "lang": "en", "source": "web", "n_chars": i} for i in range(9000, 0, -1)]
    rows += [{"doc_id": i, "text": f"texte {i}", "lang": "fr", "source": "web", "n_chars": 7} for i in range(10_000, 14_096)]
    rows += [{"doc_id": 20_000 + i, "text": "é" * i, "lang": f"l{i % 37}", "source": None, "n_chars": None if i % 3 else i} for i in range(120)]
    rows += [dict.fromkeys(FIELDS), dict.fromkeys(FIELDS), {**dict.fromkeys(FIELDS), "lang": "de", "text": ""}]
    rows += [{"doc_id": 5, "text": "again", "lang": "", "source": "s", "n_chars": -1}] * 3 + [{"doc_id": 2**60 + i, "text": "y" * 300_000, "lang": "日本", "source": "😀", "n_chars": 2**40} for i in range(3)]
    extra = frame(spark, rows).selectExpr("*", "1 AS n", "2 AS tree", "3 AS pos", "'x' AS leaf").repartition(7)
    assert plain(manifest.manifest(extra).collect()) == plain(expected(rows))


def test_empty_table(spark):
    assert manifest.manifest(frame(spark, [])).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 70), st.data())
def test_multiproof_is_minimal_and_expands(n, data):
    own = data.draw(st.sets(st.integers(0, n - 1), min_size=1))
    levels = tree([h(str(i)) for i in range(n)])
    lacks = manifest.missing(sorted(own), n)
    # Siblings on the ways up, but those that lie above a leaf of the set.
    above = {(k, i >> k) for i in own for k in range(len(levels))}
    need = {(k, i >> k ^ 1) for i in own for k in range(len(levels) - 1) if i >> k ^ 1 < len(levels[k])} - above
    assert sorted(lacks) == sorted(need)
    fetched = {(k, i): levels[k][i] for k, i in lacks}
    found = manifest.interiors({i: levels[0][i] for i in own}, n, fetched)
    assert found[-1] == {0: levels[-1][0]}
    proof = manifest.proofs(found, n)
    for i in own:
        assert proof[i] == "".join(s for s, _ in siblings(levels, i) if s)
        assert manifest.fold(levels[0][i], i, n, proof[i]) == (levels[-1][0], len(proof[i]))


def test_query_matches_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    df = manifest.op12_merkle_manifest(spark, sf_dir)
    rows = {tuple(r) for r in df.collect()}
    assert rows == set(con.execute(manifest.ORACLE).df()[df.columns].itertuples(index=False, name=None))
    assert {r[6] for r in rows} == {True, False}
