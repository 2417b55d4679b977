"""Merkle dataset manifest: one tree a language, one over their roots, and proofs by one multiproof for each leaf partition."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glyphlake.llm.common import crc32_sql, stored

#: A leaf partition holds up to 2 ** HEIGHT leaves, in order, that start at a multiple of it; so does each step of the build.
HEIGHT = 12
#: The number of the tree over the roots of the others, which count from 0 in the order of their languages.
TOP = -1
LEAF_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODE = "tree long, n long, level int, idx long, digest string"
FIELDS = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def digest_of(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def depth_of(n: int) -> int:
    """Levels above the leaves of a tree of ``n`` leaves."""
    return max(0, n - 1).bit_length()


def missing(positions: list[int], n: int) -> list[tuple[int, int]]:
    """The fewest (level, idx) that the proofs of all ``positions`` of a tree of ``n`` leaves need and cannot derive from each other."""
    out, level, own = [], 0, sorted(positions)
    while n > 1:
        have = set(own)
        out += [(level, i ^ 1) for i in own if i ^ 1 < n and i ^ 1 not in have]
        own, n, level = sorted({i >> 1 for i in own}), (n + 1) >> 1, level + 1
    return out


def interiors(leaves: dict[int, str], n: int, fetched: dict[tuple[int, int], str]) -> list[dict[int, str]]:
    """Nodes of each level, leaves first: those above ``leaves``, and the fetched ones beside them."""
    levels, level = [dict(leaves)], 0
    while n > 1:
        below = levels[-1]
        own = sorted({i >> 1 for i in below})
        below |= {i: d for (at, i), d in fetched.items() if at == level}
        levels.append({i: digest_of(below[2 * i], below[2 * i + 1]) if 2 * i + 1 < n else digest_of(below[2 * i]) for i in own})
        n, level = (n + 1) >> 1, level + 1
    return levels


def proofs(levels: list[dict[int, str]], n: int, behind: str = "") -> dict[int, str]:
    """The joined siblings of each leaf from its level up, with ``behind`` at their end; nodes hand theirs down to the two below."""
    sizes = [n]
    for _ in levels[1:]:
        sizes.append((sizes[-1] + 1) >> 1)
    known = {0: behind}
    for level in range(len(levels) - 2, -1, -1):
        own = levels[level]
        known = {i: own[i ^ 1] + known[i >> 1] if i ^ 1 < sizes[level] else known[i >> 1] for i in own if i >> 1 in known and (i ^ 1 in own or i ^ 1 >= sizes[level])}
    return known


def fold(digest: str, at: int, n: int, siblings: str, done: int = 0) -> tuple[str, int]:
    """The root that a node at ``at`` and its siblings give, and how many characters of ``siblings`` are used."""
    while n > 1:
        if at ^ 1 < n:
            sibling = siblings[done : done + 64]
            done += 64
            digest = digest_of(sibling, digest) if at & 1 else digest_of(digest, sibling)
        else:
            digest = digest_of(digest)
        at, n = at >> 1, (n + 1) >> 1
    return digest, done


# ---- leaves and places


def _part(value: Column) -> Column:
    value = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf_of(**changed: Column) -> Column:
    return F.sha2(F.concat(*[_part(changed.get(c, F.col(c))) for c in LEAF_FIELDS]), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, leaf, tampered``: the last one null where the row is left as it is."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), leaf_of().alias("leaf"), F.when(hit, leaf_of(n_chars=F.col("n_chars") + 1)).alias("tampered"))


def _ordered(df: DataFrame, ranges: list[str], order: list[str], name: str) -> DataFrame:
    """``df`` sorted by ``order`` over all, with ``part`` (its range) and ``at`` (rising in order, without gaps inside a range).

    ``ranges`` are short columns in the same order, as the driver gets a sample of them; rows that tie in all of them are dealt too.
    """
    placed = df.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(*ranges, "place")
    by_range = placed.sortWithinPartitions(*order, "place").drop("place").withColumn("at", F.monotonically_increasing_id())
    return stored(by_range.withColumn("part", F.shiftright("at", 33)), name)


def placed(rows: DataFrame) -> tuple[DataFrame, int]:
    """Leaves with ``tree`` (place of their language), ``n`` (leaves of it) and ``pos`` (place in it); and the number of trees.

    Places come from counts of each language in each range, so no task sees a whole language.
    """
    head = F.conv(F.substring("leaf", 1, 15), 16, 10).cast("long")
    rows = _ordered(rows.withColumn("head", head), ["lang", "doc_id", "head"], ["lang", "doc_id", "leaf"], "leaves")
    runs = rows.groupBy("part", "lang").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    langs = runs.groupBy("lang").agg(F.sum("n").alias("total"))
    langs = _ordered(langs, ["lang"], ["lang"], "languages")
    ranges = langs.groupBy("part").agg(F.count(F.lit(1)).alias("m"), F.min("at").alias("start"))
    before = F.coalesce(F.sum("m").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a range
    ranges = F.broadcast(ranges.select("part", "start", before.alias("before")))
    langs = langs.join(ranges, "part").select(F.col("lang").alias("own"), "total", (F.col("before") + F.col("at") - F.col("start")).alias("tree"))
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.withColumn("earlier", earlier).join(langs.hint("merge"), F.col("lang").eqNullSafe(F.col("own")))
    runs = stored(runs.select("part", F.col("lang").alias("own"), (F.col("earlier") - F.col("first")).alias("shift"), F.col("total").alias("n"), "tree"), "runs")
    trees = runs.agg(F.max("tree")).first()[0]
    # A language's rows of one range meet one run: however common it is, a task has a range of it.
    rows = rows.join(runs.hint("merge").withColumnRenamed("part", "range"), (F.col("part") == F.col("range")) & F.col("lang").eqNullSafe(F.col("own")))
    return rows.select("tree", "n", (F.col("at") + F.col("shift")).alias("pos"), "doc_id", "leaf", "tampered"), 0 if trees is None else trees + 1


# ---- the build


def _climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes above runs of neighbours that start at a multiple of 2 ** HEIGHT."""
    schema = pa.schema([("tree", pa.int64()), ("n", pa.int64()), ("level", pa.int32()), ("idx", pa.int64()), ("digest", pa.string())])
    for batch in batches:
        for r in batch.to_pylist():
            out, level = [], r["level"]
            size = -(-r["n"] >> level)  # nodes of this level of the tree
            own = {x["idx"]: x["digest"] for x in r["nodes"]}
            for _ in range(HEIGHT):
                if size == 1:
                    break
                own = {i: digest_of(own[2 * i], own[2 * i + 1]) if 2 * i + 1 < size else digest_of(own[2 * i]) for i in sorted({i >> 1 for i in own})}
                size, level = (size + 1) >> 1, level + 1
                out += [{"tree": r["tree"], "n": r["n"], "level": level, "idx": i, "digest": d} for i, d in own.items()]
            yield pa.RecordBatch.from_pylist(out, schema)


def _above(nodes: DataFrame) -> DataFrame:
    """Up to HEIGHT levels above ``nodes``, which are of one level."""
    runs = nodes.groupBy("tree", "n", "level", F.shiftright("idx", HEIGHT).alias("run")).agg(F.collect_list(F.struct("idx", "digest")).alias("nodes"))
    return runs.mapInArrow(_climb, NODE)


def _rest(nodes: DataFrame, level: int, depth: int, name: str) -> DataFrame:
    """``nodes`` of ``level`` and all above them, up to ``depth``: a step for each HEIGHT levels."""
    out = nodes
    while level < depth:
        more = stored(_above(nodes), name)
        level += HEIGHT
        nodes = more.where(F.col("level") == level)
        out = out.unionByName(more)
    return out


def _tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The top node of each leaf partition."""
    schema = pa.schema([("tree", pa.int64()), ("n", pa.int64()), ("level", pa.int32()), ("idx", pa.int64()), ("digest", pa.string())])
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            own, size, level = {x["pos"]: x["leaf"] for x in r["leaves"]}, r["n"], 0
            while level < HEIGHT and size > 1:
                own = {i: digest_of(own[2 * i], own[2 * i + 1]) if 2 * i + 1 < size else digest_of(own[2 * i]) for i in sorted({i >> 1 for i in own})}
                size, level = (size + 1) >> 1, level + 1
            ((at, digest),) = own.items()
            out.append({"tree": r["tree"], "n": r["n"], "level": level, "idx": at, "digest": digest})
        yield pa.RecordBatch.from_pylist(out, schema)


# ---- the multiproof


def _wanted(trees: int):
    """For each leaf partition the coordinates that it lacks, in its own tree and the top one, and that of the root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                lacks = [(r["tree"], *c) for c in missing(r["places"], r["n"])]
                lacks += [(TOP, *c) for c in missing([r["tree"]], trees)] + [(TOP, depth_of(trees), 0)]
                out += [{"tree": r["tree"], "run": r["run"], "of": t, "at_level": level, "at": i} for t, level, i in lacks]
            yield pa.RecordBatch.from_pylist(out, pa.schema([("tree", pa.int64()), ("run", pa.int64()), ("of", pa.int64()), ("at_level", pa.int32()), ("at", pa.int64())]))

    return run


def _expand(trees: int):
    """Proofs of the leaves of each partition from its own leaves and what it fetched, and the root that each leaf folds to."""
    schema = pa.schema([(f.split()[0], {"long": pa.int64(), "boolean": pa.bool_()}.get(f.split()[1], pa.string())) for f in FIELDS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                (r,) = batch.slice(row, 1).to_pylist()
                own = {(x["at_level"], x["at"]): x["digest"] for x in r["fetched"] if x["of"] != TOP}
                top = {(x["at_level"], x["at"]): x["digest"] for x in r["fetched"] if x["of"] == TOP}
                root = top.pop((depth_of(trees), 0))
                levels = interiors({x["pos"]: x["leaf"] for x in r["leaves"]}, r["n"], own)
                subroot = levels[-1][0]
                shared = proofs(interiors({r["tree"]: subroot}, trees, top), trees)[r["tree"]]
                proof = proofs(levels, r["n"], shared)
                out = []
                for x in r["leaves"]:
                    siblings = proof[x["pos"]]
                    folded, used = fold(x["tampered"] or x["leaf"], x["pos"], r["n"], siblings)
                    folded, _ = fold(folded, r["tree"], trees, siblings, used)
                    out.append((x["doc_id"], x["leaf"], subroot, root, digest_of(siblings), folded, folded == root))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


def manifest(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``.

    Leaves of a language stand by ``doc_id`` (null first), those of one id by their digest. Null languages are a tree of their own, the
    first. Null fields are ``-`` in a leaf, empty and very long texts are hashed whole, repeated rows are leaves of their own, extra
    columns are left out, and an empty table gives an empty result. Rows without ``doc_id`` or ``n_chars`` are never tampered with.
    """
    rows, trees = placed(leaves(docs))
    run = F.shiftright("pos", HEIGHT).alias("run")
    held = stored(rows.groupBy("tree", "n", run).agg(F.collect_list(F.struct("pos", "doc_id", "leaf", "tampered")).alias("leaves")), "partitions")
    tops = stored(held.select("tree", "n", "leaves").mapInArrow(_tops, NODE), "tops")
    largest = held.agg(F.max("n")).first()[0] or 0
    nodes = _rest(tops, HEIGHT, depth_of(largest), "nodes")
    whole = F.when(F.col("n") > 1, F.length(F.bin(F.col("n") - 1))).otherwise(0)  # levels of a tree
    roots = nodes.where(F.col("level") == whole).select(F.lit(TOP).cast("long").alias("tree"), F.lit(trees).cast("long").alias("n"), F.lit(0).alias("level"), F.col("tree").alias("idx"), "digest")
    nodes = nodes.unionByName(_rest(stored(roots, "roots"), 0, depth_of(trees), "top"))
    wanted = held.select("tree", "n", "run", F.transform("leaves", lambda x: x["pos"]).alias("places")).mapInArrow(_wanted(trees), "tree long, run long, of long, at_level int, at long")
    nodes = nodes.select(F.col("tree").alias("of"), F.col("level").alias("at_level"), F.col("idx").alias("at"), "digest")
    fetched = wanted.join(nodes.hint("merge"), ["of", "at_level", "at"]).groupBy("tree", "run").agg(F.collect_list(F.struct("of", "at_level", "at", "digest")).alias("fetched"))
    return held.join(fetched.hint("merge"), ["tree", "run"]).select("tree", "n", "leaves", "fetched").mapInArrow(_expand(trees), FIELDS)


def op12_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    return manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _oracle() -> str:
    part = lambda c: f"coalesce(strlen(({c})::VARCHAR)::VARCHAR || ':' || ({c})::VARCHAR, '-')"
    leaf = lambda n_chars: f"sha256(concat({', '.join(part(n_chars if c == 'n_chars' else c) for c in LEAF_FIELDS)}))"
    above = "SELECT {0}level + 1, idx // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY idx)) FROM {1} WHERE n > 1 GROUP BY {0}level, idx // 2, n"
    return f"""
    WITH RECURSIVE hit AS (
        SELECT *, {leaf("n_chars")} AS leaf, CASE WHEN {crc32_sql("doc_id::VARCHAR")} % 7 = 0 THEN {leaf("n_chars + 1")} END AS changed FROM documents),
    leaves AS (
        SELECT doc_id, leaf, coalesce(changed, leaf) AS used, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree,
               row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n
        FROM hit),
    nodes(tree, level, idx, n, digest) AS (SELECT tree, 0, pos, n, leaf FROM leaves UNION ALL {above.format("tree, ", "nodes")}),
    roots AS (SELECT tree, level, digest, count(*) OVER () AS trees FROM nodes WHERE n = 1),
    tops(level, idx, n, digest) AS (SELECT 0, tree, trees, digest FROM roots UNION ALL {above.format("", "tops")}),
    -- Every level of a leaf: those of its own tree, then those of the top one.
    steps AS (
        SELECT l.tree, l.pos, s.level, s.idx, o.digest AS sibling
        FROM leaves l JOIN nodes s ON s.tree = l.tree AND s.idx = l.pos >> s.level AND s.n > 1
        LEFT JOIN nodes o ON o.tree = s.tree AND o.level = s.level AND o.idx = xor(s.idx, 1)
        UNION ALL
        SELECT l.tree, l.pos, r.level + s.level, s.idx, o.digest
        FROM leaves l JOIN roots r ON r.tree = l.tree JOIN tops s ON s.idx = l.tree >> s.level AND s.n > 1
        LEFT JOIN tops o ON o.level = s.level AND o.idx = xor(s.idx, 1)),
    proofs AS (SELECT tree, pos, sha256(coalesce(string_agg(sibling, '' ORDER BY level), '')) AS proof_sha256 FROM steps GROUP BY tree, pos),
    folds(tree, pos, level, digest) AS (
        SELECT tree, pos, 0, used FROM leaves
        UNION ALL
        SELECT f.tree, f.pos, f.level + 1, sha256(CASE WHEN s.idx % 2 = 1 THEN s.sibling || f.digest ELSE f.digest || coalesce(s.sibling, '') END)
        FROM folds f JOIN steps s ON s.tree = f.tree AND s.pos = f.pos AND s.level = f.level),
    folded AS (SELECT tree, pos, arg_max(digest, level) AS folded_root FROM folds GROUP BY tree, pos)
    SELECT l.doc_id, l.leaf, r.digest AS subroot, t.digest AS root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256, f.folded_root, f.folded_root = t.digest AS verified
    FROM leaves l JOIN roots r ON r.tree = l.tree JOIN tops t ON t.n = 1 LEFT JOIN proofs p ON p.tree = l.tree AND p.pos = l.pos
    JOIN folded f ON f.tree = l.tree AND f.pos = l.pos"""


ORACLE = _oracle()
