"""Heuristic quality rules: a table of thresholds, compiled into one projection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, let

#: Frequent function words of the languages that the corpus holds.
STOP_WORDS = (
    "the of and to in is that it was for on are as with be by this have from or not at an a "
    "le la les de des du et un une que qui en est pour par sur avec pas dans au ne se "
    "der die das und ist von zu mit den dem ein eine nicht auf sich für im des es auch "
    "el los las y del se por con una su para no al lo como más o pero sus"
).split()
SYMBOLS = "[#*$%&|<>]"
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """A text fails if the measure lies below ``low`` or above ``high``."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


RULES = (
    Rule("word_length", "mean_word_chars", 2.0, 14.0),
    Rule("symbols", "symbols_per_word", high=0.4),
    Rule("exclamations", "exclamations_per_word", high=0.4),
    Rule("stop_words", "stop_word_share", low=0.01),
    Rule("repeated_lines", "repeated_line_share", high=0.5),
    Rule("bullets", "bullet_line_share", high=0.9),
    Rule("ellipses", "ellipsis_line_share", high=0.5),
)

#: Base conditions: fewer words, or more per cent of words in repeated windows, always fail.
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30


def _occurring_twice(keyed: Column) -> Column:
    """Of sorted ``(key, i)`` structs: those whose key a neighbour has too."""

    def twice(x: Column, k: Column) -> Column:
        before, after = F.get(keyed, k - 1), F.get(keyed, k + 1)
        return F.coalesce(before["key"] == x["key"], F.lit(False)) | F.coalesce(after["key"] == x["key"], F.lit(False))

    return F.filter(keyed, twice)


def _repeat_words(words: Column) -> Column:
    """Words inside windows of ``WINDOW`` words that occur twice or more.

    Texts without two windows of the same hash, nearly all, stop there. In the others the
    windows are sorted by a 96-bit hash, and the covered places counted.
    """

    def window(i: Column) -> Column:
        return F.slice(words, i + 1, WINDOW)

    def covered(places: Column) -> Column:
        gaps = F.transform(places, lambda p, k: F.least(F.coalesce(F.get(places, k + 1) - p, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(gaps, F.lit(0), lambda total, gap: total + gap)

    def count(hashes: Column) -> Column:
        def exact() -> Column:
            keyed = F.transform(hashes, lambda h, i: F.struct(h.alias("key"), i.alias("i")))
            likely = let(F.array_sort(keyed), _occurring_twice)
            wide = F.transform(likely, lambda x: F.struct(F.struct(x["key"], F.hash(window(x["i"]))).alias("key"), x["i"].alias("i")))
            return let(F.array_sort(F.transform(let(F.array_sort(wide), _occurring_twice), lambda x: x["i"])), covered)

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(exact())

    starts = F.sequence(F.lit(0), F.size(words) - WINDOW)
    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(
        let(F.transform(words, lambda w: F.xxhash64(w)), lambda each: let(F.transform(starts, lambda i: F.xxhash64(F.slice(each, i + 1, WINDOW))), count))
    )


def _measures(text: Column) -> Column:
    """The struct of counts and ratios of a text that is not null."""
    trimmed = F.btrim(text, F.lit(ASCII_SPACE))
    words_of = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    lines_of = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(ASCII_SPACE)) != "")

    def occurrences(characters: str) -> Column:
        return (F.length(text) - F.length(F.regexp_replace(text, characters, ""))).cast("long")

    def with_words(words: Column) -> Column:
        def with_lines(lines: Column) -> Column:
            def share(test) -> Column:
                return F.size(F.filter(lines, test)) / F.greatest(F.size(lines), F.lit(1))

            n_words = F.size(words).cast("long")
            chars = (F.length(text) - occurrences(r"[\x20\x09-\x0D]+")).alias("word_chars")
            per_word = F.greatest(n_words, F.lit(1))
            dup_lines = (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")
            stops = F.size(F.filter(words, lambda w: w.isin(STOP_WORDS)))
            counts = F.struct(
                n_words.alias("n_words"), chars, occurrences(SYMBOLS).alias("n_symbols"), dup_lines.alias("n_dup_lines"),
                _repeat_words(words).cast("long").alias("n_repeat_words"), F.size(lines).alias("n_lines"),
            )

            def ratios(c: Column) -> Column:
                return F.struct(
                    *[c[n].alias(n) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
                    (c["word_chars"] / per_word).alias("mean_word_chars"),
                    (c["n_symbols"] / per_word).alias("symbols_per_word"),
                    (occurrences("[!]") / per_word).alias("exclamations_per_word"),
                    (stops / per_word).alias("stop_word_share"),
                    (c["n_dup_lines"] / F.greatest(c["n_lines"], F.lit(1))).alias("repeated_line_share"),
                    share(lambda x: F.ltrim(x).startswith("•") | F.ltrim(x).startswith("- ")).alias("bullet_line_share"),
                    share(lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…")).alias("ellipsis_line_share"),
                )

            return let(counts, ratios)

        return let(lines_of, with_lines)

    return let(words_of, with_words)


def _failed(measures: Column, rules: tuple[Rule, ...]) -> Column:
    """The names of the rules that fail, in the order of the table."""
    tests = []
    for rule in rules:
        value = measures[rule.measure]
        bad = F.lit(False)
        if rule.low is not None:
            bad = bad | (value < rule.low)
        if rule.high is not None:
            bad = bad | (value > rule.high)
        tests.append(F.when(bad, F.lit(rule.name)))
    return F.array_compact(F.array(*tests))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``(doc_id, measures struct, base_failed, failed_rules, kept)``, one row per row.

    A null text is an empty one: no words, so it fails the base condition. Everything is
    one projection over the row; nothing is shuffled.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))

    def verdict(m: Column) -> Column:
        base = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])
        failed = _failed(m, rules)
        return F.struct(m.alias("measures"), base.alias("base_failed"), failed.alias("failed_rules"))

    judged = docs.select("doc_id", let(let(text, _measures), verdict).alias("v")).select("doc_id", "v.*")
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
