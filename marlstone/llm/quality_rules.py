"""Quality rules as a short-circuit cascade, ordered by what they reject for what they cost.

Every rule is a condition on a row that rejects it. ``ordered`` draws a bounded sample, times each rule over it and
counts what it rejects, and puts the rule with the most rejections for a second first. ``verdict`` evaluates the rules
in that order in one CASE, so that a rejected row costs no later rule, nor the text scans within it. The order decides the
cost and which rule is named first; what is kept is the same in any order.

Edge cases: a null text has no words and fails ``base``; long texts are read whole; repeated rows and ids are judged each on its own; a row
is never dropped; rules of equal worth stay as listed; a table without rows gives none. Other columns are kept whatever their names; columns
of the caller's that are named like a measure or verdict (n_words, kept ...) are replaced.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.text import SPACE_CHARS, unused, words

SYMBOLS = "#*$%&|<>"
#: Common English insults, as whole words. A text in which they are frequent is unfit whatever its other measures are.
INSULTS = ["clown", "disgusting", "dumb", "freak", "idiot", "imbecile", "loser", "moron", "pathetic", "scum", "stupid", "trash", "ugly", "vermin", "worthless"]


def _removed(text: Column, characters: str) -> Column:
    """How many bytes a text loses if these ASCII characters go."""
    rest = text
    for c in characters:
        rest = F.replace(rest, F.lit(c), F.lit(""))
    return F.octet_length(text) - F.octet_length(rest)


def _window_hashes(w: Column) -> Column:
    return F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))).otherwise(F.array().cast("array<bigint>"))


def _covered(at: Column) -> Column:
    """How many words the three-word windows at these positions cover."""
    return F.size(F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(i, i + 1, i + 2)))))


def with_measures(docs: DataFrame, text: str = "text", words_as: str = "_words") -> DataFrame:
    """Adds the words as ``words_as`` and the measures n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words.

    Windows that occur again are found by their 64-bit hashes. While at most 32 different ones do, each position is
    compared with them; otherwise hashes are sorted together with their positions. Neither grows with the square of
    the text.
    """
    windows, sorted_, again, pairs, lines = (unused(docs.withColumn(words_as, F.lit(0)), x) for x in ("windows", "sorted", "again", "pairs", "lines"))
    t = F.coalesce(F.col(text), F.lit(""))
    df = docs.withColumn(words_as, words(F.col(text))).withColumn(windows, _window_hashes(F.col(words_as)))
    df = df.withColumn(sorted_, F.sort_array(windows))
    df = df.withColumn(again, F.array_distinct(F.filter(sorted_, lambda x, i: (i > 0) & (x == F.col(sorted_)[F.greatest(i - 1, F.lit(0))]))))
    few = F.filter(F.transform(windows, lambda x, i: F.when(F.array_contains(F.col(again), x), i)), lambda i: i.isNotNull())
    df = df.withColumn(pairs, F.when(F.size(again) > 32, F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    equal = lambda p, k: (p["x"] == F.get(F.col(pairs), k - 1)["x"]) | (p["x"] == F.get(F.col(pairs), k + 1)["x"])
    many = F.transform(F.filter(pairs, equal), lambda p: p["i"])
    repeats = F.when(F.size(again) == 0, 0).when(F.size(again) <= 32, _covered(few)).otherwise(_covered(many))
    df = df.withColumn(lines, F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")).withColumns(
        {
            "n_words": F.size(words_as).cast("long"),
            "word_chars": F.length(F.array_join(words_as, "")).cast("long"),
            "n_symbols": _removed(t, SYMBOLS).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            "n_repeat_words": repeats.cast("long"),
        }
    )
    return df.drop(windows, sorted_, again, pairs, lines)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def default_rules(text: str = "text", words_as: str = "_words") -> dict[str, Column]:
    """The rules, each a condition that rejects a row which ``with_measures`` has made. Their scans of words and text are their own."""
    n, t = F.col("n_words"), F.coalesce(F.col(text), F.lit(""))
    insults = F.regexp_count(t, F.lit(rf"(?i)\b({'|'.join(INSULTS)})\b"))
    return {
        "base": base_failed(),
        "word_length": (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 14 * n),
        "symbols": 100 * F.col("n_symbols") > 15 * n,
        "duplicate_lines": 100 * F.col("n_dup_lines") > 30 * F.size(F.split(t, "\n")),
        "shouting": 100 * F.size(F.filter(words_as, lambda x: (x != F.lower(x)) & (x == F.upper(x)))) > 30 * n,
        "exclamations": 100 * _removed(t, "!") > 30 * n,
        "insults": F.transform(F.array(insults), lambda k: (k >= 2) & (200 * k > n))[0],
    }


def ordered(docs: DataFrame, rules: dict[str, Column], *, sample_rows: int = 2000, repeats: int = 8, runs: int = 2, text: str = "text", words_as: str = "_words") -> list[tuple[str, float, float]]:
    """(rule, seconds, share rejected) in the order to apply them, by rejections for a second over a bounded sample.

    The sample is a share of all rows, about ``sample_rows`` of them; the row count comes from the files' footers. Each rule reads the sample
    ``repeats`` times in one job, and the seconds of a job without a rule are taken off, so that it isn't Spark's own work that is compared.
    """
    share = min(1.0, sample_rows / max(1, docs.count()))
    sample = with_measures(docs.sample(share, seed=7), text, words_as).persist()
    try:
        n = max(1, sample.count())
        again = sample.withColumn(unused(sample, "again"), F.explode(F.sequence(F.lit(1), F.lit(repeats))))

        def timed(rule: Column) -> tuple[float, int]:
            spent, rejected = [], 0
            for _ in range(runs):
                began = time.perf_counter()
                rejected = again.agg(F.count_if(rule)).first()[0]
                spent.append(time.perf_counter() - began)
            return min(spent), rejected

        idle = timed(F.col("n_words") < 0)[0]
        found = []
        for name, rule in rules.items():
            seconds, rejected = timed(rule)
            found.append((name, max(seconds - idle, 0.002), rejected / repeats / n))
    finally:
        sample.unpersist()
    return sorted(found, key=lambda r: -r[2] / r[1])


def verdict(docs: DataFrame, rules: dict[str, Column], order: list[str]) -> DataFrame:
    """Adds ``rejected_by``: the first rule in this order that rejects the row, or null."""
    first, *rest = order
    chain = F.when(rules[first], F.lit(first))
    for name in rest:
        chain = chain.when(rules[name], F.lit(name))
    return docs.withColumn("rejected_by", chain)


def judged(docs: DataFrame, rules: dict[str, Column] | None = None, *, sample_rows: int = 2000, text: str = "text") -> DataFrame:
    """The documents with their measures, ``base_failed``, ``rejected_by`` and ``kept``. Rules of the caller's are joined by ``base``."""
    words_as = unused(docs, "words")
    rules = default_rules(text, words_as) if rules is None else {"base": base_failed()} | rules
    order = [name for name, _, _ in ordered(docs, rules, sample_rows=sample_rows, text=text, words_as=words_as)]
    out = verdict(with_measures(docs, text, words_as), rules, order).drop(words_as)
    return out.withColumn("base_failed", base_failed()).withColumn("kept", F.col("rejected_by").isNull())
