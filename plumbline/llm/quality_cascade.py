"""Quality rules as a short-circuit cascade whose order comes from a sample.

Every rule is one boolean expression over a document that rejects it when true; the two halves of the base rule
(too few words, too many repeated ones) are rules like the others. The words of a text are split once; whatever else
a rule needs it computes itself, from the words or the text. On a hash sample of the documents (``sample_rows``, a
parameter) the seconds of each rule are measured from raw words and texts, after a run to warm up and less the
seconds of a job that reads the same rows and computes nothing. The rule that rejects the most of the sample per
second comes first, then the one that rejects the most of what is left, and so on. The rules are the branches of one
CASE, so that a document which an early rule rejects never pays for the later ones. The order changes the
cost only: the verdict is the same for any.

Only DataFrame functions are used. Defined cases: a null text has no words and counts 0 everywhere; documents
without words fail the base rule; whole texts are counted, of any length; repeated rows each keep theirs; an
empty table gives an empty result; kept columns named like a result give way to it, others may have any name; input
columns other than those asked for are ignored.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import discard, materialize, spread, text_or_empty

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
RESULTS = ["text", *COUNTS, "base_failed", "failed_rule", "kept"]

#: Gives the expression of a count by its name.
Counts = Callable[[str], Column]


@dataclass(frozen=True)
class Rule:
    """``fails`` makes the condition that rejects a document from the counts it asks for."""

    name: str
    fails: Callable[[Counts], Column]


def with_words(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``__keep`` (a struct of the kept columns), ``__text`` and ``__words``."""
    kept = [F.col(f"`{c}`") for c in keep if c.lower() not in RESULTS]
    split = F.array_remove(F.split(F.col("__text"), SPACE), "")
    return docs.select(F.struct(*kept, F.lit(True).alias("__row")).alias("__keep"), text_or_empty().alias("__text")).withColumn("__words", split)


def unpacked(keep: list[str]) -> list[Column]:
    return [F.col(f"__keep.`{c}`") for c in keep if c.lower() not in RESULTS]


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def repeated_words(words: Column) -> Column:
    """Words that lie in a three-word window found at least twice in the text.

    Windows are compared by 64-bit hashes. Where all hashes of a text differ the count is 0; else the pairs
    (hash, position) are sorted, which puts equal windows side by side, and the covered words are the sum over
    the sorted positions of repeated windows of min(3, gap).
    """
    hashes = F.transform(F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))

    def covered(s: Column) -> Column:
        again = F.filter(s, lambda x, j: (x["h"] == F.get(s, j + 1)["h"]) | (x["h"] == F.get(s, j - 1)["h"]))
        return F.aggregate(
            F.sort_array(again["p"]),
            F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
            lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")),
            lambda a: a["n"],
        )

    ranked: Callable[[Column], Column] = lambda h: F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
    return bound(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), bound(ranked(h), covered)).otherwise(0))


def raw(name: str) -> Column:
    """A count from ``__words`` and ``__text``."""
    words, text = F.col("__words"), F.col("__text")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    only: Callable[[str], Column] = lambda kind: F.length(F.regexp_replace(text, f"[^{kind}]+", ""))
    count = {
        "n_words": lambda: F.size(words),
        "word_chars": lambda: F.length(F.array_join(words, "")),
        "n_symbols": lambda: F.length(text) - F.length(F.regexp_replace(text, f"[{SYMBOLS}]+", "")),
        "n_dup_lines": lambda: bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))),
        "n_repeat_words": lambda: repeated_words(words),
        "n_lines": lambda: F.size(lines),
        "upper": lambda: only(r"\p{Lu}"),
        "digits": lambda: only("0-9"),
    }
    return count[name]().cast("long")


def with_counts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns of :func:`with_words` and all COUNTS."""
    return with_words(docs, keep).select("*", *[raw(c).alias(c) for c in COUNTS])


def base_rules() -> list[Rule]:
    return [Rule("few_words", lambda c: c("n_words") < 50), Rule("repeats", lambda c: 100 * c("n_repeat_words") > 50 * c("n_words"))]


def default_rules() -> list[Rule]:
    return [
        Rule("symbols", lambda c: c("n_symbols") > 0.3 * c("n_words")),
        Rule("capitals", lambda c: c("upper") > 0.4 * c("word_chars")),
        Rule("digits", lambda c: c("digits") > 0.5 * c("word_chars")),
        Rule("line_copies", lambda c: 10 * c("n_dup_lines") > 4 * c("n_lines")),
        Rule("word_length", lambda c: (c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 15 * c("n_words"))),
    ]


@dataclass(frozen=True)
class Measured:
    """Seconds of each rule, and how many sampled documents fail which of the rules."""

    seconds: dict[str, float]
    patterns: list[tuple[frozenset[str], int]]


def measure(docs: DataFrame, rules: list[Rule], sample_rows: int = 600) -> Measured:
    """Costs and rejections over a hash sample of about ``sample_rows`` documents, twice as many at most."""
    total = docs.count()
    share = min(1.0, sample_rows / max(total, 1))
    picked = docs if share == 1.0 else docs.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    sample = materialize(with_words(picked.limit(2 * sample_rows), []).select("__text", "__words"), "cascade-sample")
    failed = {r.name: F.coalesce(r.fails(raw), F.lit(False)) for r in rules}
    found = sample.groupBy(*[c.alias(n) for n, c in failed.items()]).count().collect()  # at most 2**rules rows

    def seconds(value: Column) -> float:
        job = sample.coalesce(1).agg(F.sum(value + F.size("__words") + F.length("__text")))  # one task, so its time is work
        job.collect()  # warms up
        began = time.perf_counter()
        job.collect()
        return time.perf_counter() - began

    nothing = seconds(F.lit(0))
    cost = {n: max(seconds(c.cast("int")) - nothing, 1e-4) for n, c in failed.items()}
    discard(sample)
    return Measured(cost, [(frozenset(n for n in failed if r[n]), r["count"]) for r in found])


def order_rules(rules: list[Rule], measured: Measured) -> list[Rule]:
    """Greedily by rejection of what is left per second; equal ones by cost."""
    out, left, open_rules = [], measured.patterns, list(rules)
    while open_rules:
        gain = {r.name: sum(n for failed, n in left if r.name in failed) / measured.seconds[r.name] for r in open_rules}
        best = min(open_rules, key=lambda r: (-gain[r.name], measured.seconds[r.name]))
        open_rules.remove(best)
        out.append(best)
        left = [(failed, n) for failed, n in left if best.name not in failed]
    return out


def cascade(rules: list[Rule], counts: Counts) -> Column:
    """The name of the first rule that rejects; null for kept documents."""
    first = F.when(F.lit(False), F.lit(""))
    for rule in rules:
        first = first.when(rule.fails(counts), F.lit(rule.name))
    return first


def measured_order(docs: DataFrame, rules: list[Rule] | None, sample_rows: int) -> list[Rule]:
    every = base_rules() + (default_rules() if rules is None else rules)
    return order_rules(every, measure(docs.select("text"), every, sample_rows))


def apply_cascade(docs: DataFrame, keep: list[str], rules: list[Rule] | None = None, sample_rows: int = 600) -> DataFrame:
    """``keep`` columns, the counts, ``base_failed``, ``failed_rule`` (null for kept ones) and ``kept``.

    ``failed_rule`` names the first rule in the measured order that rejects the document. The counts are asked for,
    so every document pays for them; what only rules need (capitals, digits) is computed where it is reached.
    """
    ordered = measured_order(docs, rules, sample_rows)
    counted = with_counts(spread(docs.select(*dict.fromkeys([*keep, "text"]))), keep)
    at_hand: Counts = lambda name: F.col(name) if name in COUNTS else raw(name)
    few, repeats = (r.fails(at_hand) for r in base_rules())
    judged = counted.select(*unpacked(keep), F.col("__text").alias("text"), *COUNTS, (few | repeats).alias("base_failed"), cascade(ordered, at_hand).alias("failed_rule"))
    return judged.withColumn("kept", F.col("failed_rule").isNull())


def kept_documents(docs: DataFrame, keep: list[str], rules: list[Rule] | None = None, sample_rows: int = 600) -> DataFrame:
    """``keep`` columns and ``text`` of the documents that no rule rejects; counts are computed where a rule is
    reached.

    The partition id in the condition keeps the optimiser from moving the filter below the split into words, where
    every use would split anew.
    """
    ordered = measured_order(docs, rules, sample_rows)
    split = with_words(spread(docs.select(*dict.fromkeys([*keep, "text"]))), keep).withColumn("__here", F.spark_partition_id())
    return split.where(cascade(ordered, raw).isNull() & (F.col("__here") >= 0)).select(*unpacked(keep), F.col("__text").alias("text"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return apply_cascade(docs, ["doc_id"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
tri AS (SELECT r, i, list_extract(w, i) || ' ' || list_extract(w, i + 1) || ' ' || list_extract(w, i + 2) AS g
        FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM tri) WHERE c > 1),
rep AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, unnest([i, i + 1, i + 2]) AS i FROM again) GROUP BY r),
c AS (SELECT doc_id, text, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines,
             length(regexp_replace(text, '[^\p{Lu}]+', '', 'g')) AS upper, length(regexp_replace(text, '[^0-9]+', '', 'g')) AS digits
      FROM w LEFT JOIN rep USING (r)),
b AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR n_symbols > 0.3 * n_words OR upper > 0.4 * word_chars OR digits > 0.5 * word_chars
            OR 10 * n_dup_lines > 4 * n_lines OR word_chars < 2 * n_words OR word_chars > 15 * n_words) AS kept
FROM b
"""
