"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once for each document.  The ledger keeps the
measurements and one long whose bit i says that rule i failed.  A policy is a
version name and a mask of rules; verdicts, and ablations of a policy, are bit
operations over the ledger and never read a text again.

Nulls and empty texts: all measurements are 0, so the rule on few words fails.
Repeated rows are measured each by itself.  An input column that has the name
of an output column is dropped, other extra columns are not carried.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """``fails`` is an SQL predicate over the measurement columns."""

    name: str
    fails: str


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]


#: The order is the bit order; append only, so that stored ledgers stay valid.
RULES = (
    Rule("few_words", "n_words < 10"),
    Rule("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule("symbols", "n_symbols > n_words"),
    Rule("duplicate_lines", "2 * n_dup_lines > n_lines"),
    Rule("word_length", "word_chars > 40 * n_words"),
)
BASE = Policy("base", ("few_words", "repeated_windows"))
DEFAULT = Policy("v1", ("few_words", "repeated_windows", "symbols", "duplicate_lines", "word_length"))


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _window_hashes(words: Column) -> Column:
    """A 64-bit hash of each five-word window; compared only within one text."""
    return F.transform(
        F.sequence(F.lit(0), F.size(words) - WINDOW),
        lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(WINDOW)]),
    )


def _repeated_words(hashes: Column) -> Column:
    """Words covered by windows that occur twice or more: sort (hash, position), keep those with an equal neighbour, and add up the new words of each."""
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeated = lambda s: F.sort_array(
        F.transform(
            F.filter(s, lambda x, i: (x["h"] == F.get(s, i + 1)["h"]) | (x["h"] == F.get(s, i - 1)["h"])),
            lambda x: x["i"],
        )
    )
    covered = lambda p: F.aggregate(
        F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))),
        F.lit(0),
        lambda a, x: a + x,
    )
    return _let(pairs, lambda s: _let(repeated(s), covered))




def measurements(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    body = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    split = body.select(
        "doc_id",
        "__text",
        F.regexp_extract_all("__text", F.lit(WORD), F.lit(0)).alias("__words"),
        F.filter(F.split("__text", "\n", -1), lambda x: F.length(F.trim(x, F.lit(SPACE))) > 0).alias("__lines"),
    )
    hashed = split.select(
        "doc_id",
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.translate("__text", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("__text") - F.length(F.translate("__text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("__words") >= WINDOW, _window_hashes(F.col("__words"))).alias("__hashes"),
    )
    repeats = F.when(
        F.size(F.array_distinct("__hashes")) < F.size("__hashes"), _repeated_words(F.col("__hashes"))
    ).otherwise(F.lit(0))
    return hashed.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", repeats.cast("long").alias("n_repeat_words")
    )


def mask(policy: Policy, rules: tuple[Rule, ...] = RULES) -> int:
    place = {r.name: i for i, r in enumerate(rules)}
    return sum(1 << place[x] for x in policy.rules)


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Measurements and ``fail_bits``, one row for each input row."""
    bits = F.lit(0).cast("long")
    for i, r in enumerate(rules):
        bits = bits.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return measurements(docs, text, doc_id).withColumn("fail_bits", bits)


def verdict(policy: Policy, rules: tuple[Rule, ...] = RULES, bits: str = "fail_bits") -> Column:
    """True where no rule of the policy failed."""
    return F.col(bits).bitwiseAND(F.lit(mask(policy, rules)).cast("long")) == 0


def ablation(ledger_df: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each rule of a policy: documents it fails, and those that only it fails.

    The ledger is first summed by bit pattern, of which there are at most
    ``2 ** len(rules)``.
    """
    whole = mask(policy, rules)
    patterns = ledger_df.groupBy(F.col("fail_bits").bitwiseAND(F.lit(whole).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    place = {r.name: i for i, r in enumerate(rules)}
    each = F.explode(
        F.array(*[F.struct(F.lit(x).alias("rule"), F.lit(1 << place[x]).cast("long").alias("bit")) for x in policy.rules])
    )
    return (
        patterns.select("bits", "n", each.alias("r"))
        .groupBy(F.lit(policy.version).alias("policy"), F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_failed_alone"),
        )
    )
