"""Packing by cutting stock: patterns over a length histogram from column generation, dealt to ranked documents."""

from __future__ import annotations

import os
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glyphlake.llm import bpe
from glyphlake.llm.bpe import UNEVEN
from glyphlake.llm.common import stored, text_of, tokenizer_path

#: Lengths are rounded up to a multiple of GRID for the linear program, so it has CAPACITY / GRID rows at most.
GRID = 8
CAPACITY = 2048
#: Share of sequences by which the linear program may miss its optimum.
NEAR = 5e-4
END_ID = 1
#: Rows of a bucket in which documents of one length class are ranked.
BUCKET_ROWS, MIN_BUCKETS = 100_000, 64


# ---- token ids

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def as_bytes(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    return np.array(ids, "<u4").tobytes()


class Ids:
    """Ids of whole texts as the ``tokenizers`` library gives them; words after a lone blank are remembered.

    New words go to ``tiktoken`` with the same file's vocabulary, which takes a third of the time, where
    ids follow the order of merges; otherwise, and for texts with special tokens, to the library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        own = bpe.loaded(path)
        self.special = list(own.special)
        self.ordinary = lambda text: self.library.encode(text, add_special_tokens=False).ids
        if all(made == 256 + rank for rank, made in enumerate(own.made)):
            import tiktoken

            ranks = {x: i for i, x in enumerate(own.bytes_of[: 256 + len(own.made)])}
            self.ordinary = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.bare = bpe.Memory(lambda word: as_bytes(self.ordinary(word)))
        self.after_blank = bpe.Memory(lambda word: as_bytes(self.ordinary(" " + word)))
        self.line_feed = self.whole("\n")

    def whole(self, text: str) -> bytes:
        special = any(s in text for s in self.special)
        return as_bytes(self.library.encode(text, add_special_tokens=False).ids if special else self.ordinary(text))

    def __call__(self, text: str) -> bytes:
        if UNEVEN.search(text) or any(s in text for s in self.special):
            return self.whole(text)
        lines = []
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            lines.append(self.bare[first] + b"".join(map(self.after_blank.__getitem__, rest)))
        return self.line_feed.join(lines)


@lru_cache(2)
def loaded(path: str) -> Ids:
    return Ids(path)


def token_lengths(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, doc_tokens, crcs``: ids of each text and the end id, and the CRC-32 of each run of ``capacity`` ids."""

    def run(batches):
        import pandas as pd

        ids_of, end, width = loaded(path), np.array([END_ID], "<u4").tobytes(), 4 * capacity
        for batch in batches:
            rows = []
            for text in batch["text"]:
                ids = ids_of(text) + end
                rows.append((len(ids) // 4, [zlib.crc32(ids[k : k + width]) for k in range(0, len(ids), width)]))
            out = pd.DataFrame(rows, columns=["doc_tokens", "crcs"])
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy() if batch["doc_id"].isna().any() else batch["doc_id"].to_numpy())
            yield out

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInPandas(run, "doc_id long, doc_tokens long, crcs array<long>")


# ---- the linear program


def best_pattern(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming: counts of each size that are worth most within ``capacity``."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(sizes, kind="stable")
    ranked, worth = sizes[order], values[order]
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        k = np.searchsorted(ranked, room, "right")
        if k:
            found = worth[:k] + best[room - ranked[:k]]
            at = int(found.argmax())
            if found[at] > best[room] + 1e-12:
                best[room], took[room] = found[at], order[at]
    counts, room = np.zeros(len(sizes), "int64"), capacity
    while room > 0:
        if took[room] < 0:
            room -= 1
        else:
            counts[took[room]] += 1
            room -= sizes[took[room]]
    return float(best[capacity]), counts


def _first_basis(sizes: np.ndarray, need: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Patterns, levels and the inverse to start from: the largest size left with the fullest filling, until a size runs out.

    Each pattern uses up a size that later ones don't hold, so the patterns are a basis, triangular in that order.
    """
    m, left = len(sizes), need.astype(float).copy()
    columns, level, open_ = np.zeros((m, m)), np.zeros(m), np.ones(m, bool)
    inverse = np.zeros((m, m))
    for k in range(m):
        live = np.flatnonzero(open_)
        pattern = np.zeros(m)
        pattern[live[-1]] = 1
        if (room := capacity - int(sizes[live[-1]])) >= sizes[live[0]]:
            pattern[live] += best_pattern(sizes[live], sizes[live] * (1 + sizes[live] / (10.0 * capacity)), room)[1]
        ratio = np.where(pattern > 0, left / np.maximum(pattern, 1), np.inf)
        out = int(ratio.argmin())
        columns[:, k], level[k] = pattern, ratio[out]
        left = np.maximum(left - pattern * level[k], 0)
        open_[out] = False
        inverse[k] = -np.einsum("j,jk->k", columns[out, :k], inverse[:k])
        inverse[k, out] += 1
        inverse[k] /= pattern[out]
    return columns, level, inverse


def patterns_for(demand: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns (size -> pieces) and how often each is used; together they hold exactly ``demand``.

    The linear program starts from greedy patterns; the dual prices of its basis go to the knapsack,
    whose best pattern enters while it is worth more than the sequence it costs (by more than NEAR, which bounds
    the distance from the optimum). Counts are rounded down, and the few pieces left (fewer than
    patterns times pieces a pattern) go largest first to the fullest sequence with room.
    """
    sizes = np.array(sorted(s for s, n in demand.items() if n > 0), "int64")
    if not len(sizes):
        return []
    need = np.array([demand[int(s)] for s in sizes], float)
    m = len(sizes)
    columns, level, inverse = _first_basis(sizes, need, capacity)
    for _ in range(10 * m):
        worth, pattern = best_pattern(sizes, inverse.sum(0), capacity)
        if worth <= 1 + NEAR:
            break
        entering = np.einsum("ij,j->i", inverse, pattern.astype(float))
        ratio = np.where(entering > 1e-9, level / np.where(entering > 1e-9, entering, 1), np.inf)
        out = int(ratio.argmin())
        columns[:, out] = pattern
        inverse[out] /= entering[out]
        others = entering.copy()
        others[out] = 0
        inverse -= np.outer(others, inverse[out])
        step = ratio[out]
        level = np.maximum(level - others * step, 0)
        level[out] = step
    used = np.floor(level + 1e-6).astype("int64")
    left = need.astype("int64") - np.einsum("ij,j->i", columns, used.astype(float)).round().astype("int64")
    while (left < 0).any():  # rounding of a level that is whole but for the last digits
        at = int(np.flatnonzero((columns[int(np.flatnonzero(left < 0)[0])] > 0) & (used > 0))[0])
        used[at] -= 1
        left = need.astype("int64") - np.einsum("ij,j->i", columns, used.astype(float)).round().astype("int64")
    plan = [({int(s): int(a) for s, a in zip(sizes, columns[:, p], strict=True) if a}, int(used[p])) for p in range(m) if used[p]]
    bins: list[tuple[int, dict[int, int]]] = []
    for s in sizes[::-1]:
        for _ in range(int(left[np.searchsorted(sizes, s)])):
            fits = [k for k, (room, _) in enumerate(bins) if room >= s]
            k = min(fits, key=lambda k: bins[k][0]) if fits else len(bins)
            if k == len(bins):
                bins.append((capacity, {}))
            room, held = bins[k]
            held[int(s)] = held.get(int(s), 0) + 1
            bins[k] = (room - int(s), held)
    return plan + [(held, 1) for _, held in bins]


# ---- dealing patterns to documents


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, grid: int = GRID) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A document is cut into runs of ``capacity`` ids, each a sequence of its own, and a rest. Rests are
    counted by length class (a histogram of ``capacity / grid`` rows), the linear program makes patterns of classes, and
    the documents of a class, ranked by hash bucket and id, fill the places of their class in turn.

    Null or empty text is the end id alone. Texts of any length are encoded whole. Null ids are packed like others. Rows that repeat, and
    equal texts, are each packed. Extra columns are left out. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    slim = stored(token_lengths(docs, path, id_col, text_col, capacity), "lengths")
    rest = F.pmod("doc_tokens", F.lit(capacity))
    by_class = slim.where(rest > 0).groupBy(F.ceil(rest / grid).cast("int").alias("class")).agg(F.count(F.lit(1)).alias("n"))
    demand = {r["class"]: r["n"] for r in by_class.collect()}  # capacity / grid rows at most
    places, sequences = [], 0
    start_of = dict.fromkeys(demand, 0)
    for held, times in patterns_for(demand, capacity // grid):
        for size, pieces in held.items():
            places.append((size, start_of[size], start_of[size] + pieces * times, pieces, sequences))
            start_of[size] += pieces * times
        sequences += times
    rows = slim.count()
    buckets = max(MIN_BUCKETS, rows // BUCKET_ROWS)
    whole = F.floor(F.col("doc_tokens") / capacity)
    parts = slim.select(
        "*",
        F.pmod(F.xxhash64("doc_id", "doc_tokens", "crcs"), F.lit(buckets)).alias("bucket"),
        F.explode(F.array(F.struct(F.lit(0).alias("class"), whole.alias("weight")), F.struct(F.ceil(rest / grid).cast("int").alias("class"), F.when(rest > 0, 1).otherwise(0).cast("long").alias("weight")))).alias("p"),
    ).select("doc_id", "doc_tokens", "crcs", "bucket", "p.*").where("weight > 0")
    sums = parts.groupBy("class", "bucket").agg(F.sum("weight").alias("weight"))
    before = Window.partitionBy("class").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("class", "bucket", F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("bucket_start"))
    inside = Window.partitionBy("class", "bucket").orderBy("doc_id", "doc_tokens", "crcs").rowsBetween(Window.unboundedPreceding, -1)
    ranked = parts.select("*", F.coalesce(F.sum("weight").over(inside), F.lit(0)).alias("own"))
    ranked = ranked.join(starts.hint("merge"), ["class", "bucket"]).withColumn("rank", F.col("bucket_start") + F.col("own")).drop("bucket_start", "own", "bucket")
    full = ranked.where("class = 0").select(
        "doc_id", "doc_tokens", F.posexplode(F.slice("crcs", 1, F.col("weight").cast("int"))).alias("k", "ids_crc32"), "rank"
    ).select(
        "doc_id", (F.col("k") * F.lit(capacity).cast("long")).alias("start"), F.lit(capacity).cast("long").alias("length"), "ids_crc32", "doc_tokens",
        (F.lit(sequences).cast("long") + F.col("rank") + F.col("k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
    )
    # Places: as many as the patterns have classes, bounded by the grid and not by the documents; those of a class are one array, in the
    # order of their ranks, in which a row looks up its own.
    by_size: dict[int, list[tuple]] = {}
    for size, *place in places:
        by_size.setdefault(size, []).append(tuple(place))
    table = spark.createDataFrame(sorted(by_size.items()), "class int, places array<struct<from_rank:long,to_rank:long,pieces:long,first_sequence:long>>")
    mine = F.element_at("places", F.size(F.filter("places", lambda x: x["from_rank"] <= F.col("rank"))))
    found = ranked.where("class > 0").join(F.broadcast(table), "class").withColumn("place", mine).drop("places")
    at, pieces = F.col("rank") - F.col("place.from_rank"), F.col("place.pieces")
    placed = found.select(
        "doc_id", (F.col("doc_tokens") - rest).alias("start"), rest.cast("long").alias("length"), F.element_at("crcs", -1).alias("ids_crc32"), "doc_tokens",
        (F.col("place.first_sequence") + F.floor(at / pieces)).alias("sequence_id"), "class", F.pmod(at, pieces).alias("turn"),
    )
    along = Window.partitionBy("sequence_id").orderBy(F.desc("class"), "turn").rowsBetween(Window.unboundedPreceding, -1)
    mixed = placed.withColumn("offset", F.coalesce(F.sum("length").over(along), F.lit(0))).drop("class", "turn")
    return mixed.unionByName(full)


def op3_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path("byte_bpe_50k.json"))
