"""Quality rules: clean a text line by line, then reject what lost too much."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphlake.llm.common import let, text_of

SYMBOLS = "#*$%&|<>"
#: Phrases of page furniture in four languages; a short line that holds one is boilerplate.
BOILERPLATE = (
    "cookie policy", "accept cookies", "privacy policy", "terms of use", "terms of service", "all rights reserved",
    "click here", "read more", "sign up", "log in", "subscribe to", "enable javascript", "lorem ipsum", "share this",
    "skip to content", "back to top", "related articles", "powered by",
    "alle rechte vorbehalten", "cookies akzeptieren", "datenschutzerklärung", "allgemeine geschäftsbedingungen", "weiterlesen", "zum seitenanfang", "newsletter abonnieren",
    "tous droits réservés", "accepter les cookies", "politique de confidentialité", "mentions légales", "lire la suite", "haut de page", "abonnez-vous",
    "todos los derechos reservados", "aceptar cookies", "política de privacidad", "aviso legal", "leer más", "volver arriba", "suscríbete",
)
#: A bare line has at most so many words and characters and no mark at its end; so many in a row, blank lines aside, are navigation.
BARE_WORDS, BARE_CHARS, BARE_RUN = 4, 40, 5
END_MARK = r"[.!?…:;,。！？：；，、)\]\"'»”’]\s*$"
#: Characters that a text may lose to the line rules, in hundredths.
MAX_LOST = 40


def words_of(text: Column) -> Column:
    """Runs of anything but ASCII white space."""
    flat = F.replace(text, F.lit("\n"), F.lit(" "))
    flat = F.when(F.regexp_like(text, F.lit(r"[\x09\x0B-\x0D]")), F.translate(text, "\t\n\x0b\x0c\r", "     ")).otherwise(flat)
    return F.array_remove(F.split(flat, " "), "")


def repeated_words(words: Column) -> Column:
    """Words that lie in a three-word window found twice or more in the text, first ones included."""

    def count(w: Column) -> Column:
        hashes = F.transform(F.slice(w, 1, F.size(w) - 2), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
        return let(hashes, starts)

    def starts(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(F.sort_array(h), lambda s: let(repeats(s), lambda r: few_or_many(h, r))))

    def repeats(s: Column) -> Column:
        return F.array_distinct(F.filter(s, lambda x, i: x == F.get(s, i - 1)))

    def few_or_many(h: Column, r: Column) -> Column:
        few = F.filter(F.transform(h, lambda x, i: F.when(F.array_contains(r, x), i)), lambda i: i.isNotNull())
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(r) <= 24, covered(few)).otherwise(let(placed, lambda p: covered(many(p))))

    def many(p: Column) -> Column:
        n = F.size(p)
        return F.filter(
            F.transform(p, lambda x, i: F.when((F.get(p, i - 1)["h"] == x["h"]) | ((i + 1 < n) & (F.get(p, i + 1)["h"] == x["h"])), x["i"])),
            lambda x: x.isNotNull(),
        )

    def covered(twice: Column) -> Column:
        return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda i: F.array(i, i + 1, i + 2)))))

    return let(words, lambda w: F.when(F.size(w) < 4, F.lit(0)).otherwise(count(w))).cast("long")


def without(c: Column, pattern: str) -> Column:
    """How many characters of ``c`` the pattern matches; texts without any are told by a search alone."""
    return F.when(F.regexp_like(c, F.lit(pattern)), F.length(c) - F.length(F.regexp_replace(c, f"{pattern}+", ""))).otherwise(0)


def line_fails(line: Column) -> Column:
    """Whether a line is no prose by itself: symbols, navigation, shouting, stuttering, loose fragments, boilerplate.

    Words are counted by single blanks; each rule first makes a cheap test that most lines don't pass.
    """
    chars = F.length(line)
    return let(chars - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1, lambda n: _fails(line, n, chars))


def _fails(line: Column, n: Column, chars: Column) -> Column:
    signs = r"[#*$%&|<>!~^_=+{}\[\]\\@]"
    symbols = (n >= 3) & F.regexp_like(line, F.lit(signs)) & (without(line, signs) * 10 >= chars)
    bars = (n >= 3) & F.regexp_like(line, F.lit("[|»›•·]")) & (without(line, "[|»›•·]") * 3 >= n)
    shout = (n >= 4) & F.regexp_like(line, F.lit(r"\p{Lu}{2}")) & (without(line, r"\p{Lu}") * 10 >= without(line, r"\p{L}") * 7)
    stutter = (n >= 12) & let(F.split(line, " "), lambda w: F.size(F.array_distinct(w)) * 10 <= F.size(w) * 4)
    loose = (n >= 30) & ~F.regexp_like(line, F.lit(r"[.!?…:;]"))
    furniture = (n <= 20) & F.regexp_like(line, F.lit("(?i)" + "|".join(BOILERPLATE)))
    return symbols | bars | shout | loose | furniture | stutter


def is_bare(line: Column) -> Column:
    """Whether a line is a few words without an end, as items of menus and lists of links are."""
    return (F.length(line) <= BARE_CHARS) & ~F.regexp_like(line, F.lit(END_MARK)) & (F.size(F.split(F.trim(line), r"\s+")) <= BARE_WORDS)


def bare_runs(full: Column) -> Column:
    """For each line '2' if it lies in a run of BARE_RUN bare lines or more; null if there is no such run.

    One letter a line, and a pattern that looks at the letters around one: a line is judged by its neighbours in one pass.
    """
    ways = "|".join(f"(?<=1{{{k}}})1(?=1{{{BARE_RUN - 1 - k}}})" for k in range(BARE_RUN))
    marks = F.array_join(F.transform(full, lambda x: F.when(is_bare(x), "1").otherwise("0")), "")
    return let(marks, lambda m: F.when(F.contains(m, F.lit("1" * BARE_RUN)), F.split(F.regexp_replace(m, ways, "2"), "")))


def _good(full: Column, runs: Column) -> Column:
    return F.filter(full, lambda x, i: ~line_fails(x) & ~F.coalesce(F.get(runs, i) == "2", F.lit(False)))


def rule_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_lost: int = MAX_LOST) -> DataFrame:
    """One row per row of ``docs``: counts, ``base_failed``, ``kept``, ``n_lost`` and ``n_failed_lines``.

    ``n_lost`` counts the characters of failing lines and of lines that repeat an earlier one. ``kept``
    is false if ``base_failed`` or if more than ``max_lost`` hundredths of all line characters were lost.
    Null or empty text: all counts 0, ``base_failed`` true. Texts of any length are judged whole. Null ids, equal texts and repeated
    rows stay rows of their own. Extra columns are left out. An empty table gives an empty result.
    """
    return docs.select(F.col(id_col).alias("doc_id"), _report(text_of(text_col), max_lost).alias("r")).select("doc_id", "r.*")


def _report(text: Column, max_lost: int) -> Column:
    def fields(lines: Column, words: Column) -> Column:
        def with_good(full: Column) -> Column:
            return let(bare_runs(full), lambda runs: let(_good(full, runs), lambda good: out(full, good)))

        def out(full: Column, good: Column) -> Column:
            return let(
                F.struct(
                    F.size(words).cast("long").alias("n_words"),
                    F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
                    without(text, f"[{SYMBOLS}]").cast("long").alias("n_symbols"),
                    (F.size(full) - F.size(F.array_distinct(full))).cast("long").alias("n_dup_lines"),
                    repeated_words(words).alias("n_repeat_words"),
                    (F.size(full) - F.size(good)).cast("long").alias("n_failed_lines"),
                    (_length(full) - _length(F.array_distinct(good))).cast("long").alias("n_lost"),
                    _length(full).cast("long").alias("n_line_chars"),
                ),
                verdict,
            )

        return let(F.filter(lines, lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]"))), with_good)

    def verdict(s: Column) -> Column:
        base = (s["n_words"] < 50) | (s["n_repeat_words"] * 100 > s["n_words"] * 50)
        kept = ~base & (s["n_lost"] * 100 <= s["n_line_chars"] * max_lost)
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
        return F.struct(*[s[k].alias(k) for k in names], base.alias("base_failed"), kept.alias("kept"), s["n_failed_lines"].alias("n_failed_lines"), s["n_lost"].alias("n_lost"))

    return let(F.split(text, "\n"), lambda lines: let(words_of(text), lambda words: fields(lines, words)))


def _length(strings: Column) -> Column:
    return F.aggregate(strings, F.lit(0), lambda a, x: a + F.length(x))


def clean_lines(text: Column) -> Column:
    """``text`` without its failing lines; the other lines, blank ones too, stay in order."""
    placed = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("i"), x.alias("x")))

    def clean(every: Column) -> Column:
        return let(F.filter(every, lambda p: F.regexp_like(p["x"], F.lit(r"[^\x20\x09-\x0D]"))), lambda full: let(bare_runs(F.transform(full, lambda p: p["x"])), lambda runs: left(every, full, runs)))

    def left(every: Column, full: Column, runs: Column) -> Column:
        failing = F.filter(full, lambda p, k: line_fails(p["x"]) | F.coalesce(F.get(runs, k) == "2", F.lit(False)))
        return F.array_join(F.transform(F.array_except(every, failing), lambda p: p["x"]), "\n")

    return let(placed, clean)


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_lost: int = MAX_LOST) -> DataFrame:
    """The rows of ``docs`` whose text passes, without their failing lines; all other columns stay.

    Null and empty texts are rejected. Null ids, equal texts and repeated rows are judged like others.
    """
    return docs.where(_report(text_of(text_col), max_lost)["kept"]).withColumn(text_col, clean_lines(F.col(text_col)))


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    return rule_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
