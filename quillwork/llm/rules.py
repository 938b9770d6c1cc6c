"""Quality rules as a short-circuit cascade, in DataFrame operations only.

A rule is a condition that rejects a text, over named features of the text.
Cost and selectivity of every rule are estimated on a sample; the cascade then
tries the rules by rejections per second, so that a text is dropped by the
cheapest rule that can drop it. The verdict is a conjunction and does not depend
on the order, only the work and `rejected_by` do.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillwork.session import materialise

WINDOW = 5
SAMPLE_ROWS = 2_000  # rows that costs and selectivities are estimated on
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"


def words_of(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text as an array; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), "")


def word_chars(text: Column) -> Column:
    return F.length(F.translate(F.coalesce(text, F.lit("")), SPACES, "")).cast("long")


def symbol_count(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    return (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line of the text."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    return F.transform(
        F.array(F.filter(lines, lambda line: F.btrim(line, F.lit(SPACES)) != "")),
        lambda kept: (F.size(kept) - F.size(F.array_distinct(kept))).cast("long"),
    )[0]


def capital_letters(text: Column) -> Column:
    """Letters that lower-casing changes."""
    text = F.coalesce(text, F.lit(""))
    return F.length(F.regexp_replace(text, "\\P{Lu}+", "")).cast("long")


def _let(value: Column, body) -> Column:
    """Bind `value` once for use inside lambda functions, where it would be computed per element."""
    return F.transform(F.array(value), body)[0]


def repeated_window_words(words: Column) -> Column:
    """Words inside a window of five that occurs twice or more in the text.

    Windows are compared by a 64-bit hash of the hashes of their words. Only texts
    with a repeated window pay for sorting them.
    """

    def windows(hashes: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(1), F.size(hashes) - (WINDOW - 1)),
            lambda i: F.xxhash64(*[F.get(hashes, i + (j - 1)) for j in range(WINDOW)]),
        )

    def covered(grams: Column) -> Column:
        ordered = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

        def positions(rows: Column) -> Column:
            repeated = F.filter(
                F.transform(
                    rows,
                    lambda row, k: F.when(
                        (F.get(rows, k - 1)["g"] == row["g"]) | (F.get(rows, k + 1)["g"] == row["g"]), row["i"]
                    ),
                ),
                lambda p: p.isNotNull(),
            )
            return F.aggregate(
                F.array_sort(repeated),
                F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")),
                lambda acc, p: F.struct(
                    p.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).cast("long").alias("n")
                ),
            )["n"]

        return _let(ordered, positions)

    def count(grams: Column) -> Column:
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0).cast("long")).otherwise(covered(grams))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) <= WINDOW, F.lit(0).cast("long")).otherwise(
        _let(hashes, lambda h: _let(windows(h), count))
    )


FEATURES = {
    "n_words": lambda text: F.size(words_of(text)).cast("long"),
    "word_chars": word_chars,
    "n_symbols": symbol_count,
    "n_dup_lines": duplicate_lines,
    "n_capitals": capital_letters,
    "n_repeat_words": lambda text: _let(words_of(text), repeated_window_words),
}


@dataclass(frozen=True)
class Rule:
    """`rejects` takes the features by name and returns a Boolean column."""

    name: str
    uses: tuple[str, ...]
    rejects: object = field(compare=False)


RULES = (
    Rule("too_few_words", ("n_words",), lambda f: f["n_words"] < 10),
    Rule("repeated_windows", ("n_words", "n_repeat_words"), lambda f: 100 * f["n_repeat_words"] > 20 * f["n_words"]),
    Rule("symbols", ("n_words", "n_symbols"), lambda f: 10 * f["n_symbols"] > 2 * f["n_words"]),
    Rule("capitals", ("word_chars", "n_capitals"), lambda f: 10 * f["n_capitals"] > 4 * f["word_chars"]),
    Rule("repeated_lines", ("n_words", "n_dup_lines"), lambda f: 20 * f["n_dup_lines"] > f["n_words"]),
    Rule(
        "word_length",
        ("n_words", "word_chars"),
        lambda f: (f["word_chars"] < 2 * f["n_words"]) | (f["word_chars"] > 15 * f["n_words"]),
    ),
)
BASE_RULES = ("too_few_words", "repeated_windows")


def sample_rows(df: DataFrame, text: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """About `rows` texts, chosen by the hash of the text, so the same rows every time."""
    total = df.count()
    if total <= rows:
        return df.select(text)
    return df.select(text).where(F.pmod(F.xxhash64(F.col(text)), F.lit(1 << 30)) < int(rows / total * (1 << 30)))


def estimate_rules(sample: DataFrame, text: str, rules: tuple[Rule, ...] = RULES) -> list[tuple[str, float, float]]:
    """(rule, share of rejected texts, seconds per text) of every rule on a sample that is small and stored."""
    found = []
    for rule in rules:
        rejected = rule.rejects({name: FEATURES[name](F.col(text)) for name in rule.uses})
        started = time.perf_counter()
        row = sample.agg(F.count("*").alias("n"), F.sum(F.coalesce(rejected, F.lit(False)).cast("int")).alias("hit")).first()
        spent = time.perf_counter() - started
        n = max(row["n"], 1)
        found.append((rule.name, (row["hit"] or 0) / n, spent / n))
    return found


def order_rules(estimates: list[tuple[str, float, float]]) -> list[str]:
    """Rule names by rejections per second, most first; ties by name."""
    return [name for name, *_ in sorted(estimates, key=lambda e: (-e[1] / max(e[2], 1e-12), e[0]))]


def quality_cascade(
    df: DataFrame,
    text: str = "text",
    rules: tuple[Rule, ...] = RULES,
    order: list[str] | None = None,
    features: tuple[str, ...] = (),
) -> DataFrame:
    """`df` with `kept` and `rejected_by` (null if kept), and the `features` asked for.

    Without `order`, the order is estimated on a sample of `SAMPLE_ROWS` texts.
    A rule is only evaluated for texts that passed the rules before it; a feature
    asked for as a column is computed once, for all texts, and shared.
    Null counts as the empty text, which `too_few_words` rejects. Columns of `df`
    with the names of added columns are replaced. Other columns stay as they are.
    """
    if order is None:
        order = order_rules(estimate_rules(materialise(sample_rows(df, text)), text, rules))
    by_name = {rule.name: rule for rule in rules}
    added = {"kept", "rejected_by", *features}
    if text in added:
        raise ValueError(f"the text column {text!r} has the name of an added column")
    base = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in added])
    words = "__words"
    shared = base
    if features:
        # one split serves both word features
        shared = base.withColumn(words, words_of(F.col(text)))
        plain = {name: FEATURES[name](F.col(text)) for name in features if name not in ("n_words", "n_repeat_words")}
        if "n_words" in features:
            plain["n_words"] = F.size(words).cast("long")
        if "n_repeat_words" in features:
            plain["n_repeat_words"] = repeated_window_words(F.col(words))
        shared = shared.select(*[F.col(f"`{c}`") for c in base.columns], *[plain[n].alias(n) for n in features])

    verdict = F.lit(None).cast("string")
    for name in reversed(order):
        rule = by_name[name]
        values = {n: F.col(n) if n in features else FEATURES[n](F.col(text)) for n in rule.uses}
        verdict = F.when(rule.rejects(values), F.lit(name)).otherwise(verdict)
    return shared.withColumn("rejected_by", verdict).withColumn("kept", F.col("rejected_by").isNull())
