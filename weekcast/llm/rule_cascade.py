"""Quality rules as a short-circuit cascade.

Each rule rejects some documents at some cost. Both are measured on a sample, and the rules are put in
descending order of rejection per cost, which is the order of least expected cost for independent rules
(Hellerstein and Stonebraker, "Predicate migration", 1993). A document meets a rule only if all rules before
it let it pass. The order never changes which documents are kept.

Everything is one projection of column functions: no shuffle, and no Python on the executors.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from weekcast.session import stage

GAP = r"[\x20\x09-\x0D]+"
WORD_CHARACTER = r"[^\x20\x09-\x0D]"
WINDOW = 5
SAMPLE_ROWS = 2_000


@dataclass(frozen=True)
class Rule:
    """``rejects`` is true for documents to drop; it may use the columns of ``measure`` and ``text``."""

    name: str
    rejects: Column


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.transform(F.array(value), use)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, GAP), "")


def repeated_words(words: Column) -> Column:
    """How many words lie in a window of five words that the text has twice or more.

    Windows are compared by their 64-bit hash within one text. Most texts repeat none, which the count of
    distinct hashes shows; only the others are sorted to find where the repeats begin.
    """

    def covered(hashes: Column) -> Column:
        by_hash = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(pairs: Column) -> Column:
            again = F.filter(
                pairs,
                lambda p, k: (F.get(pairs, k - 1)["h"] == p["h"]) | F.coalesce(F.get(pairs, k + 1)["h"] == p["h"], F.lit(False)),
            )
            return F.sort_array(F.transform(again, lambda p: p["i"]))

        fresh = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
        step = lambda seen, at: F.struct(at.alias("last"), (seen["n"] + F.least(F.lit(WINDOW), at - seen["last"])).alias("n"))
        return F.aggregate(_let(by_hash, starts), fresh, step, lambda seen: seen["n"])

    def counted(all_words: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(all_words) - WINDOW)
        hashes = F.transform(at, lambda i: F.xxhash64(*[F.get(all_words, i + k) for k in range(WINDOW)]))
        return _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h)))

    return F.when(F.size(words) < WINDOW, 0).otherwise(_let(words, counted)).cast("long")


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty) and its measures n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words.

    Words are runs of characters other than blank and 0x09 to 0x0D; word_chars counts their code points;
    n_lines counts lines with a word, n_dup_lines those of them equal to an earlier line. Other columns are
    dropped, so their names don't matter; repeated rows stay; an empty table stays empty.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split("text", "\n", -1), lambda line: F.regexp_like(line, F.lit(WORD_CHARACTER)))
    split = docs.select("doc_id", text.alias("text")).select("doc_id", "text", words_of(F.col("text")).alias("_words"), lines.alias("_lines"))
    return split.select(
        "doc_id",
        "text",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_words")).alias("n_repeat_words"),
    )


def base_rules() -> list[Rule]:
    n_words = F.col("n_words")
    return [
        Rule("few words", n_words < 10),
        Rule("repeated windows", 100 * F.col("n_repeat_words") > 20 * n_words),
    ]


def further_rules() -> list[Rule]:
    """Symbols, repeated lines, odd word lengths, capitals and exclamation marks.

    A document of clean prose passes all of them by far.
    """
    n_words = F.col("n_words")
    capitals = F.length(F.regexp_replace("text", r"[^\p{Lu}]+", ""))
    exclamations = F.length(F.regexp_replace("text", "[^!]+", ""))
    return [
        Rule("symbols", 100 * F.col("n_symbols") > 10 * n_words),
        Rule("repeated lines", 100 * F.col("n_dup_lines") > 30 * F.col("n_lines")),
        Rule("short words", F.col("word_chars") < 2 * n_words),
        Rule("long words", F.col("word_chars") > 20 * n_words),
        Rule("capitals", 100 * capitals > 30 * F.col("word_chars")),
        Rule("exclamations", 100 * exclamations > 10 * n_words),
    ]


def order_rules(measured: DataFrame, rules: Sequence[Rule], sample_rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """(rule, rejected share, seconds) in descending order of rejection per second, on about ``sample_rows`` rows.

    The sample is taken by a hash over all rows; it decides the order only.
    """
    total = measured.select("doc_id").count()
    share = max(1, total // sample_rows)
    picked = F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(share)) == 0
    sample = stage(measured.select("doc_id", "text").filter(picked).coalesce(8), "rule-sample")
    fresh = measure(sample)
    found = []
    for rule in rules:
        took = []
        for _ in range(2):  # the first run also compiles
            began = time.perf_counter()
            seen = fresh.agg(F.count("*").alias("n"), F.count_if(rule.rejects).alias("rejected")).first()
            took.append(time.perf_counter() - began)
        found.append((rule, seen["rejected"] / max(1, seen["n"]), min(took)))
    return sorted(found, key=lambda x: -x[1] / x[2])


def cascade(measured: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``measured`` with ``failed_rule``: the first rule, in the given order, that rejects the document, else null."""
    failed = F.coalesce(*[F.when(r.rejects, F.lit(r.name)) for r in rules], F.lit(None).cast("string"))
    return measured.withColumn("failed_rule", failed)


def judge(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Measures of every document with ``failed_rule``, the rules ordered by a sample of the documents."""
    measured = measure(docs)
    ranked = order_rules(measured, [*base_rules(), *further_rules()], sample_rows)
    return cascade(measured, [rule for rule, _, _ in ranked])
