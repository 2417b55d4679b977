"""N-gram Jaccard self-join by token-combination prefixes, and the components of its links."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphlake.llm.common import fresh, stored, text_of
from glyphlake.llm.components import connected_components

#: Tokens in a combination key for frequent tokens.
COMBINED = 3
#: A token is frequent from this number of documents on; doubled until at most MAX_FREQUENT tokens are.
FREQUENT, MAX_FREQUENT = 32, 1_000_000
#: Bits of the filter that tells frequent tokens, of a token's count class, and of a set's parity signature.
FILTER_BITS, CLASS_BITS, PARITY_WORDS = 26, 40, 8
#: Tokens by which an extended prefix is longer than COMBINED prefixes, so that no rounding of sizes breaks all of its runs.
SLACK = 2
#: Bits of the filter of rows whose sets are fetched; parts that the rows of a large component are dealt to.
MIN_ID_BITS, MAX_ID_BITS, SALTS = 20, 24, 16
#: Draws of a pivot for each key; classes of keys whose smallest ones are kept.
PIVOTS, KEY_CLASSES = 3, 8
#: Documents for each range of tokens when counting; tokens that a task counts at once.
RANGE_DOCS, COUNT_AT_ONCE = 500, 2_000_000
#: Words that a worker remembers before it starts afresh, and the longest (in bytes) that it remembers.
REMEMBERED, LONGEST = 400_000, 64
MIX = np.uint64(0x9E3779B97F4A7C15)
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


# ---- sets of one document (small helpers inside tasks)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = value
        return value


_words = _Words()


def _stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def _fold(columns: list[np.ndarray], seed: int) -> np.ndarray:
    """One hash for each row of parallel columns."""
    with np.errstate(over="ignore"):
        h = np.full(len(columns[0]), np.uint64(seed) * MIX, np.uint64)
        for c in columns:
            h = _stir((h ^ c) * MIX + np.uint64(1))
    return h


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles; A-Z lower-cased, words parted by ASCII white space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    own = np.fromiter(map(_words.__getitem__, words), np.uint64, n)
    size = min(n, width)
    return np.unique(_fold([own[i : n - size + 1 + i] for i in range(size)], size))


def prefix_length(n: int, percent: int) -> int:
    """Tokens of which sets this similar share one, whatever the order."""
    return n - -(-percent * n // 100) + 1


@lru_cache
def short_size(percent: int) -> int:
    """The largest set that may link with one whose extended prefix is longer than the set itself."""
    if percent < 70:
        raise ValueError("percent must be 70 at least")
    short = max(n for n in range(1, 200) if COMBINED * prefix_length(n, percent) + SLACK > n)
    return short * 100 // percent


class Frequent:
    """Tells frequent tokens by a filter of fixed size; the same answer everywhere, which is all that the join needs."""

    def __init__(self, classes: np.ndarray):
        self.bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
        at = self._place(classes.astype(np.uint64))
        np.bitwise_or.at(self.bits, at >> np.uint64(3), (np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)))

    @staticmethod
    def _place(classes: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (classes * MIX) >> np.uint64(64 - FILTER_BITS)

    def __call__(self, tokens: np.ndarray) -> np.ndarray:
        at = self._place(tokens >> np.uint64(64 - CLASS_BITS))
        return (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def keys_of(tokens: np.ndarray, frequent: np.ndarray, percent: int) -> np.ndarray:
    """Keys of a set. Order: rare tokens by hash, then frequent ones by hash.

    Rare tokens of the prefix are keys. If the prefix reaches the frequent ones, it is extended to
    COMBINED times its length and SLACK more, and every run of COMBINED frequent tokens in it is a key. Two sets that link
    and share no rare token of their prefixes share such a run: take the one whose extended prefix ends first. It has
    3p + SLACK - 2 runs; a token that only it has breaks 3 of them at most, one that only the other has breaks 2. With d
    of the latter there are at most p - 1 - floor(d * percent / 100) of the former, so fewer runs are broken than there are.
    Sets too short for that, and all that may link with them (see ``short_size``), key their frequent tokens singly as well.
    """
    n = len(tokens)
    if not n:
        return tokens
    p = prefix_length(n, percent)
    rare, common = tokens[~frequent], tokens[frequent]
    keys = [_fold([rare[:p]], 101)]
    if len(rare) < p:
        tail = common[: COMBINED * p + SLACK - len(rare)]
        runs = len(tail) - COMBINED + 1
        if runs > 0:
            keys.append(_fold([tail[i : i + runs] for i in range(COMBINED)], 103))
        if n <= short_size(percent):
            keys.append(_fold([common[: p - len(rare)]], 101))
    return np.unique(np.concatenate(keys))


# ---- counts of tokens over all documents


def _count_blocks(width: int, ranges: int):
    """Sorted class counts of a task's documents, as compressed gaps for each range of classes."""
    import zstandard

    shift = np.uint64(CLASS_BITS - (ranges.bit_length() - 1))

    def blocks(held: list[np.ndarray]):
        classes, counts = np.unique(np.concatenate(held) >> np.uint64(64 - CLASS_BITS), return_counts=True)
        edges = np.searchsorted(classes >> shift, np.arange(ranges + 1, dtype=np.uint64))
        pack = zstandard.ZstdCompressor(level=1).compress
        for r in np.flatnonzero(np.diff(edges)):
            own, n = classes[edges[r] : edges[r + 1]], counts[edges[r] : edges[r + 1]].astype("<u4")
            gaps = np.diff(own, prepend=np.uint64(r) << shift).astype("<u8")
            planes = gaps.view(np.uint8).reshape(-1, 8).T  # high bytes are nearly all zero
            yield int(r), len(own), pack(np.ascontiguousarray(planes).tobytes()), pack(np.ascontiguousarray(n.view(np.uint8).reshape(-1, 4).T).tobytes())

    def run(batches):
        import pandas as pd

        names = ["range", "n", "gaps", "counts"]
        held, size = [], 0
        for batch in batches:
            for text in batch["text"]:
                found = shingle_set(text, width)
                held.append(found)
                size += len(found)
                if size >= COUNT_AT_ONCE:
                    yield pd.DataFrame(list(blocks(held)), columns=names)
                    held, size = [], 0
        if size:
            yield pd.DataFrame(list(blocks(held)), columns=names)

    return run


def _merge_blocks(ranges: int, least: int):
    shift = np.uint64(CLASS_BITS - (ranges.bit_length() - 1))

    def run(key, blocks):
        import pandas as pd
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        classes, counts = [], []
        for n, gaps, own in zip(blocks["n"], blocks["gaps"], blocks["counts"], strict=True):
            classes.append(np.cumsum(np.ascontiguousarray(np.frombuffer(unpack(gaps), np.uint8).reshape(8, n).T).view("<u8").ravel()) + (np.uint64(key[0]) << shift))
            counts.append(np.ascontiguousarray(np.frombuffer(unpack(own), np.uint8).reshape(4, n).T).view("<u4").ravel())
        found, at = np.unique(np.concatenate(classes), return_inverse=True)
        total = np.bincount(at, np.concatenate(counts)).astype("int64")
        many = total >= least
        return pd.DataFrame({"class": found[many].astype("int64"), "df": total[many]})

    return run


def frequent_tokens(texts: DataFrame, width: int, rows: int) -> Frequent:
    """Counts tokens over all ``texts`` and makes the filter of the frequent ones; at most MAX_FREQUENT classes reach the driver."""
    ranges = 64
    while ranges * RANGE_DOCS < rows:
        ranges *= 2
    blocks = texts.select("text").mapInPandas(_count_blocks(width, ranges), "range int, n int, gaps binary, counts binary")
    counted = stored(blocks.groupBy("range").applyInPandas(_merge_blocks(ranges, FREQUENT), "class long, df long"), "frequent")
    least = FREQUENT
    by_size = {r[0]: r[1] for r in counted.groupBy(F.floor(F.log2("df")).cast("int")).count().collect()}
    while sum(n for size, n in by_size.items() if 2 ** (size + 1) > least) > MAX_FREQUENT:
        least *= 2
    return Frequent(np.array([r[0] for r in counted.where(F.col("df") >= least).select("class").collect()], "int64"))


# ---- the join


def _describe(width: int, percent: int, frequent: Frequent):
    """Size, identity, keys, parity signature and smallest keys of each row's set."""

    def run(batches):
        import pandas as pd
        import xxhash

        for batch in batches:
            rows = []
            for text in batch["text"]:
                tokens = shingle_set(text, width)
                keys = keys_of(tokens, frequent(tokens), percent)
                parity = np.packbits((np.bincount((tokens & np.uint64(64 * PARITY_WORDS - 1)).astype(np.int64), minlength=64 * PARITY_WORDS) & 1).astype(np.uint8)).view("<i8")
                name = np.frombuffer(xxhash.xxh3_128_digest(tokens.tobytes()), "<i8")
                # The smallest key of each class of keys; a class without any has the row's own name, which no other set has.
                least = [int(name[0])] * KEY_CLASSES
                kind = (keys >> np.uint64(7)) % np.uint64(KEY_CLASSES)
                for c in range(KEY_CLASSES):
                    if (own := keys[kind == c]).size:
                        least[c] = int(own[0].astype(np.int64))
                rows.append((len(tokens), int(name[0]), int(name[1]), keys.astype(np.int64), *map(int, parity), *least))
            out = pd.DataFrame(rows, columns=["n", "s", "s2", "keys", *PARITY, *LEAST])
            ids = batch["doc_id"]
            out.insert(0, "doc_id", ids.astype("Int64") if ids.isna().any() else ids)
            yield out

    return run


PARITY = [f"p{i}" for i in range(PARITY_WORDS)]
LEAST = [f"m{i}" for i in range(KEY_CLASSES)]


def _may_link(percent: int) -> Column:
    """Length and parity bounds for sets ``a`` and ``b``; they pass every pair that links."""
    na, nb = F.col("a.n"), F.col("b.n")
    apart = sum((F.bit_count(F.col(f"a.{p}").bitwiseXOR(F.col(f"b.{p}"))) for p in PARITY[1:]), F.bit_count(F.col(f"a.{PARITY[0]}").bitwiseXOR(F.col(f"b.{PARITY[0]}"))))
    # At least percent/(100+percent) of the summed sizes is shared, so at most the rest is apart.
    return (na * 100 >= nb * percent) & (nb * 100 >= na * percent) & (apart * (100 + percent) <= (na + nb) * (100 - percent))


def signs_of(tokens: np.ndarray) -> np.ndarray:
    """Parity signature of a set with half a bit for each token at least, as 64-bit words."""
    bits = 64 * PARITY_WORDS
    while 2 * bits < len(tokens):
        bits *= 2
    return np.packbits((np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).view("<i8")


def _sign_distance(a: Column, b: Column) -> Column:
    """Differing bits of two signatures; a longer one is folded to the length of the other (half of it: sizes are near)."""

    def folded(x: Column, to: Column) -> Column:
        half = F.size(to)
        return F.when(F.size(x) > half, F.zip_with(F.slice(x, 1, half), F.slice(x, half + 1, half), lambda p, q: p.bitwiseXOR(q))).otherwise(x)

    return F.aggregate(F.zip_with(folded(a, b), folded(b, a), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda n, x: n + x)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` whose sets are this similar: first by signatures that grow with the sets, then by exact intersection."""
    short = [sets.select(F.col("s").alias(k), F.col("n").alias(f"n{k}"), F.col("signs").alias(f"x{k}")) for k in "ab"]
    near = pairs.join(short[0].hint("merge"), "a").join(short[1].hint("merge"), "b")
    near = near.where(_sign_distance(F.col("xa"), F.col("xb")) * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent)).select("a", "b")
    left = sets.select(F.col("s").alias("a"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("s").alias("b"), F.col("tokens").alias("tb"))
    both = stored(near, "near").join(left.hint("merge"), "a").join(right.hint("merge"), "b")
    shared = F.size(F.array_intersect("ta", "tb"))
    return both.select("a", "b", F.size("ta").alias("na"), F.size("tb").alias("nb"), shared.alias("o")).where(F.col("o") * 100 >= (F.col("na") + F.col("nb") - F.col("o")) * percent).select("a", "b")


def _some_ids(ids: DataFrame, bits: int) -> np.ndarray:
    """A filter that holds all ids: words of 64 bits, made by a groupBy."""
    h = F.xxhash64("doc_id")
    at = F.shiftrightunsigned(h, 64 - bits)
    words = ids.groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)).cast("int"))).alias("held")).toPandas()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words["word"].to_numpy("int64")] = words["held"].to_numpy("int64")
    return out


def _fetch(texts: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """Whole sets of the ``wanted`` classes (``c, doc_id, s, s2``): a filter on ids, sized by their number, passes few other rows, and a join on
    the sets' names drops those. Rows with a null id, which may be all that a class has, pass the filter.

    The filter is held by the driver and by each task, so it has MAX_ID_BITS at most; more ids are joined with the rows instead, which
    shuffles the texts once.
    """
    ids = wanted.where("doc_id IS NOT NULL")
    bits = max(MIN_ID_BITS, (8 * ids.count()).bit_length())
    if bits > MAX_ID_BITS:
        named = ids.select("doc_id").distinct()
        texts = texts.where("doc_id IS NULL").unionByName(texts.join(named.hint("merge"), "doc_id", "left_semi"))
        bits, held = 6, np.full(1, -1, np.int64)  # passes all
    else:
        held = _some_ids(ids, bits)

    def run(batches):
        import pandas as pd
        import xxhash

        for batch in batches:
            at = batch["h"].to_numpy().astype(np.uint64) >> np.uint64(64 - bits)
            some = (held[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)).astype(np.int64)) & 1 > 0
            rows = []
            for text in batch["text"][some | batch["bare"].to_numpy(bool)]:
                tokens = shingle_set(text, width)
                if len(tokens):
                    name = np.frombuffer(xxhash.xxh3_128_digest(tokens.tobytes()), "<i8")
                    rows.append((int(name[0]), int(name[1]), len(tokens), signs_of(tokens), tokens.astype(np.int64)))
            yield pd.DataFrame(rows, columns=["s", "s2", "n", "signs", "tokens"])

    hashed = texts.select("text", F.xxhash64("doc_id").alias("h"), F.col("doc_id").isNull().alias("bare"))
    found = hashed.mapInPandas(run, "s long, s2 long, n int, signs array<long>, tokens array<long>")
    return found.join(wanted.select("c", "s", "s2").hint("merge"), ["s", "s2"]).select(F.col("c").alias("s"), "n", "signs", "tokens").dropDuplicates(["s"])


def near_components(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id``.

    Two rows link when the Jaccard similarity of their sets of ``width``-word shingles is at least ``percent``
    hundredths (70 or more); a component is named by its smallest id. Equal sets are one class from the start. Classes
    that share a key are candidates: first each with a few pivots of the key, then, where a key still
    holds several components, each pair of classes from different ones. Bounds on length and parity are tested
    inside the joins and exact intersections decide, so no link between components is missed.

    A row without words (or null text) has no shingles and is its own component. Rows with a null id link like others and bridge others; their
    component is the smallest id in it, null if it has none. Rows that repeat, and all other equal sets, are one class. Texts of any
    length are read whole; extra columns are left out. An empty table gives an empty result.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    frequent = frequent_tokens(texts, width, texts.count())
    schema = "doc_id long, n int, s long, s2 long, keys array<long>, " + ", ".join(f"{c} long" for c in PARITY + LEAST)
    rows = stored(texts.mapInPandas(_describe(width, percent, frequent), schema), "sets")
    # One class for each set; from here on its number stands for the set's 128-bit name.
    whole = [F.first(c).alias(c) for c in ("n", "keys", *PARITY, *LEAST)]
    classes = rows.where("n > 0").groupBy("s", "s2").agg(F.min("doc_id").alias("doc_id"), *whole).withColumn("c", F.monotonically_increasing_id())
    classes = stored(classes, "classes")
    about = classes.select(F.col("c").alias("s"), "doc_id", "n", *PARITY, *LEAST)
    keyed = classes.select(F.col("c").alias("s"), F.explode("keys").alias("key"))
    many = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    shared = stored(keyed.join(many.hint("merge"), "key"), "shared")
    slim = about.select("s", "n", *PARITY)

    # Classes with any candidate at all: only their sets are fetched.
    wide = shared.join(slim.hint("merge"), "s")
    partnered = wide.alias("a").join(wide.alias("b").hint("merge"), (F.col("a.key") == F.col("b.key")) & (F.col("a.s") != F.col("b.s")) & _may_link(percent), "left_semi").select("s").distinct()
    wanted = stored(partnered.withColumnRenamed("s", "c").join(classes.select("c", "doc_id", "s", "s2").hint("merge"), "c"), "wanted")
    sets = stored(_fetch(texts, wanted, width), "tokens")
    wanted = wanted.select(F.col("c").alias("s"))

    # Pivots: for each key the class whose hash is least, under a few hashes.
    shared = stored(shared.join(wanted.hint("merge"), "s", "left_semi"), "shared")
    draws = [F.xxhash64("s", F.lit(r)) for r in range(PIVOTS)]
    pivots = shared.groupBy("key").agg(*[F.min(d).alias(f"d{r}") for r, d in enumerate(draws)])
    to_pivot = shared.join(pivots.hint("merge"), "key").select("s", F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.col(f"d{r}").alias("d")) for r in range(PIVOTS)])).alias("x")).select("s", "x.r", "x.d").distinct()
    named = slim.join(wanted.hint("merge"), "s", "left_semi").select("*", F.explode(F.array(*[F.struct(F.lit(r).alias("r"), d.alias("d")) for r, d in enumerate(draws)])).alias("x")).select("*", "x.r", "x.d").drop("x")
    with_own = to_pivot.join(slim.hint("merge"), "s")
    starred = with_own.alias("a").join(named.alias("b").hint("merge"), (F.col("a.r") == F.col("b.r")) & (F.col("a.d") == F.col("b.d")) & (F.col("a.s") != F.col("b.s")) & _may_link(percent))
    starred = starred.select(F.least("a.s", "b.s").alias("a"), F.greatest("a.s", "b.s").alias("b")).distinct()
    links = stored(_verified(starred, sets, percent), "links")
    labels = connected_components(links)

    # What is left: keys that hold several components.
    labelled = shared.join(labels.select(F.col("node").alias("s"), "label").hint("merge"), "s", "left").withColumn("label", F.coalesce("label", "s"))
    mixed = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
    open_keys = stored(labelled.join(mixed.hint("merge"), "key").join(about.drop("doc_id").hint("merge"), "s"), "open")
    equal = [F.col(f"a.{m}") == F.col(f"b.{m}") for m in LEAST]
    # Of the keys that a pair shares, the first one known to both stands for all.
    first = F.coalesce(*[F.when(e, F.col(f"a.{m}")) for e, m in zip(equal, LEAST, strict=True)])
    crossed = open_keys.alias("a").join(
        open_keys.alias("b").hint("merge"),
        (F.col("a.key") == F.col("b.key")) & (F.col("a.s") < F.col("b.s")) & (F.col("a.label") != F.col("b.label")) & _may_link(percent) & (F.coalesce(first, F.col("a.key")) == F.col("a.key")),
    ).select(F.col("a.s").alias("a"), F.col("b.s").alias("b"), F.col("a.label").alias("la"), F.col("b.label").alias("lb"))
    crossed = stored(crossed.distinct(), "crossed")
    more = stored(crossed.join(_verified(crossed.select("a", "b"), sets, percent).hint("merge"), ["a", "b"]).select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct(), "more")
    if not more.isEmpty():
        outer = connected_components(more).select(F.col("node").alias("label"), F.col("label").alias("outer"))
        labels = labels.unionByName(more.select(F.col("a").alias("node"), F.col("a").alias("label")).union(more.select("b", "b")).distinct().join(labels.select("node").hint("merge"), "node", "left_anti"))
        labels = labels.join(outer.hint("merge"), "label", "left").select("node", F.coalesce("outer", "label").alias("label"))
    # Only classes with links need their label's smallest id; a large component's classes are dealt to SALTS parts.
    grouped = classes.select("c", "s", "s2", "doc_id").join(labels.select(F.col("node").alias("c"), "label").hint("merge"), "c", "left")
    grouped = stored(grouped.withColumn("salt", F.pmod(F.xxhash64("c"), F.lit(SALTS)).cast("int")), "grouped")
    least = grouped.where("label IS NOT NULL").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    least = least.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    linked = grouped.where("label IS NOT NULL").join(least.hint("merge"), ["label", "salt"]).select("s", "s2", "component_id")
    named_classes = stored(linked.unionByName(grouped.where("label IS NULL").select("s", "s2", F.col("doc_id").alias("component_id"))), "named")
    full = rows.where("n > 0").select("doc_id", "n", "s", "s2").join(named_classes.hint("merge"), ["s", "s2"])
    none = rows.where("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return full.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id").unionByName(none)


def drop_near_copies(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component, the one with its smallest id; all columns stay.

    Rows with a null id stay, as nothing tells them apart, and so do rows that repeat the smallest id. Null and empty texts are components of
    their own. Texts of any length are read whole; an empty table gives an empty result.
    """
    found, other = near_components(docs, width, percent, id_col, text_col), fresh("other")
    others = stored(found.where("doc_id <> component_id").select(F.col("doc_id").alias(other)).distinct(), "others")
    return docs.join(others.hint("merge"), docs[id_col].cast("long") == F.col(other), "left_anti")


def op4_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return near_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=4, percent=85)
