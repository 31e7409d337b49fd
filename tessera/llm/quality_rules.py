"""Quality rules: a table of thresholds compiled into one Spark projection.

Metrics and verdicts are column expressions only (no Python on executors, no
shuffle): a document's row is read, measured and judged in place.

Edge cases. A null text counts as an empty one: it has no words, fails the
base rule and is not kept. Repeated rows are judged each on its own. An empty
table gives an empty result. Extra columns are never read: only the named
text column is, and the metrics live in one struct, so they cannot clash with
the caller's columns. One document is one row, whatever its length; its work
is O(n log n) in its words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import let, words

# Frequent function words of the languages the corpus is in.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "as", "was", "with", "be", "by", "on", "not",
    "he", "this", "are", "or", "his", "from", "at", "which", "but", "have", "an", "had", "they", "you", "were",
    "der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem",
    "nicht", "ein", "eine", "als", "auch", "es", "an", "werden", "aus", "er", "hat", "dass", "sie", "nach", "wird",
    "de", "la", "le", "et", "les", "des", "un", "une", "du", "est", "que", "dans", "qui", "par", "pour", "au",
    "sur", "pas", "plus", "ne", "se", "sont", "avec", "il", "ce", "ou", "son", "sa",
    "el", "que", "y", "en", "los", "del", "se", "las", "por", "con", "no", "su", "para", "una", "al", "lo", "como",
)


@dataclass(frozen=True)
class Rule:
    """Keep a document only if ``scale_a * part  op  scale_b * whole``.

    All terms are integer metrics, so a verdict has no rounding."""
    name: str
    part: str
    op: str
    percent: int
    whole: str


# Production thresholds, each "part / whole" compared with a percentage.
RULES = (
    Rule("word length over 2", "word_chars", ">=", 200, "n_words"),
    Rule("word length under 15", "word_chars", "<=", 1500, "n_words"),
    Rule("symbols per word", "n_symbols", "<=", 20, "n_words"),
    Rule("stop words", "n_stop_words", ">=", 2, "n_words"),
    Rule("repeated lines", "n_dup_lines", "<=", 50, "n_lines"),
    Rule("lines ending in an ellipsis", "n_ellipsis_lines", "<=", 30, "n_lines"),
    Rule("bullet lines", "n_bullet_lines", "<=", 90, "n_lines"),
)


def _repeat_words(w: Column) -> Column:
    """Words inside a three-word window that occurs twice or more.

    Windows are sorted with their positions; equal neighbours mark repeated
    windows, and the sorted positions give the union of their spans."""
    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(
        F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("g"), i.alias("i")))
    repeated = let(F.sort_array(windows), lambda s: F.sort_array(F.transform(
        F.filter(s, lambda x, j: (F.get(s, j - 1)["g"] == x["g"]) | (F.get(s, j + 1)["g"] == x["g"])),
        lambda x: x["i"])))
    spans = let(repeated, lambda p: F.aggregate(
        F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3)))),
        F.lit(0), lambda a, b: a + b))
    return F.when(F.size(w) >= 4, spans).otherwise(F.lit(0)).cast("long")


def metrics(text: Column) -> Column:
    """Struct of the integer metrics of one text."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    symbols = F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", ""))

    def of_words(w):
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
            _repeat_words(w).alias("n_repeat_words"))

    def of_lines(ls):
        return F.struct(
            F.size(ls).cast("long").alias("n_lines"),
            (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
            F.size(F.filter(ls, lambda x: x.rlike(r"(\.\.\.|…)\s*$"))).cast("long").alias("n_ellipsis_lines"),
            F.size(F.filter(ls, lambda x: x.rlike(r"^\s*[-*•]\s"))).cast("long").alias("n_bullet_lines"))

    word_chars = F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long")
    return F.struct(let(words(text), of_words).alias("w"), let(lines, of_lines).alias("l"),
                    word_chars.alias("word_chars"), symbols.cast("long").alias("n_symbols"))


_WHERE = {"n_words": "w", "n_stop_words": "w", "n_repeat_words": "w",
          "n_lines": "l", "n_dup_lines": "l", "n_ellipsis_lines": "l", "n_bullet_lines": "l"}


def metric(m: Column, name: str) -> Column:
    return m[_WHERE[name]][name] if name in _WHERE else m[name]


def base_failed(m: Column) -> Column:
    n, r = metric(m, "n_words"), metric(m, "n_repeat_words")
    return (n < 50) | (100 * r > 50 * n)


def compile_rules(m: Column, rules=RULES) -> Column:
    """One boolean column that holds when every rule does."""
    out = F.lit(True)
    for r in rules:
        left, right = 100 * metric(m, r.part), r.percent * metric(m, r.whole)
        out = out & {"<=": left <= right, ">=": left >= right}[r.op]
    return out


def verdicts(text: Column) -> Column:
    """Struct of the metrics, ``base_failed`` and ``kept`` of one text."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_lines")
    return let(metrics(text), lambda m: F.struct(
        *(metric(m, n).alias(n) for n in names), base_failed(m).alias("base_failed"),
        (~base_failed(m) & compile_rules(m)).alias("kept")))


def keep(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that pass, with their own columns only."""
    return docs.where(verdicts(F.col(f"`{text_col}`"))["kept"])
