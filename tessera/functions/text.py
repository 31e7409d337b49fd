"""String column functions (all JVM-side: regexp_replace, split, ...).

Whitespace and line breaks are spelled out as explicit character classes, so
that the same pattern text means the same thing to Java regex and to RE2,
and both follow the white space / line-break definitions of Python's
``str.isspace`` and ``str.splitlines`` used by the source rules.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as in str.isspace, line breaks as in str.splitlines.
WS = ("[\\t\\n\\x{0B}\\f\\r\\x{1C}-\\x{1F} \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}"
      "\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]")
NON_WS = "[^" + WS[1:]
LINE_BREAK = "\\r\\n|[\\n\\x{0B}\\f\\r\\x{1C}-\\x{1E}\\x{85}\\x{2028}\\x{2029}]"

# The link-cleaning rewrites, applied in this order.
RELATED_DOC = "the related documentation"
LINK_RULES = [
    # relative links [text](../p) or [text](./p) -> text
    ("\\[([^\\]]+)\\]\\((\\.\\./[^)]*|\\./[^)]*)\\)", "$1"),
    # any link that is not http(s) -> text
    ("\\[([^\\]]+)\\]\\((?!https?://)([^)]*)\\)", "$1"),
    # quoted or back-ticked .md/.mdx references
    ("['\"`]([^'\"`]*\\.mdx?[^'\"`]*)['\"`]", RELATED_DOC),
    ("`([^`]*\\.mdx?[^`]*)`", RELATED_DOC),
    # bare .md/.mdx before punctuation or white space, and at the end
    (f"({NON_WS}+\\.mdx?)([.,;:!?]|{WS})", RELATED_DOC + "$2"),
    (f"({NON_WS}+\\.mdx?)$", RELATED_DOC),
    # empty brackets
    (f"\\[{WS}*\\]", ""),
]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trim_ws(x) -> Column:
    """Python ``str.strip()``: all white space, both ends."""
    return F.regexp_replace(_c(x), f"^{WS}+|{WS}+$", "")


def lstrip_ws(x) -> Column:
    return F.regexp_replace(_c(x), f"^{WS}+", "")


def word_count(x) -> Column:
    """``len(s.split())``."""
    return F.size(F.filter(F.split(_c(x), f"{WS}+"), lambda t: t != ""))


def split_lines(x) -> Column:
    return F.split(_c(x), LINE_BREAK, -1)


# Speed-ups that keep every result (Java's engine backtracks, RE2 in the
# oracle does not need them):
# * The bare-reference rule can only match from the start of a non-space
#   run (a match found from inside a run is also found from its start and
#   greedily reaches the same end), so a look-behind skips the other starts.
# * Rules 2-5 need '.md' in the text, so texts without it skip them.
# * After rule 4 has rewritten '.md' + white space, the end-of-text rule can
#   only match a text that ends with '.md' or '.mdx'.
_RUN_START = f"(?<!{NON_WS})"


def _link_rule(i: int, c: Column) -> Column:
    pattern, repl = LINK_RULES[i]
    if i == 4:
        pattern = _RUN_START + pattern
    rewritten = F.regexp_replace(c, pattern, repl)
    if i == 5:
        return F.when(c.endswith(".md") | c.endswith(".mdx"), rewritten).otherwise(c)
    if 2 <= i <= 4:
        return F.when(F.contains(c, F.lit(".md")), rewritten).otherwise(c)
    return rewritten


def sanitize_links(x) -> Column:
    """Remove internal documentation links; external http(s) links survive.
    (As one expression; ``with_sanitized_links`` evaluates it in stages.)"""
    c = _c(x)
    for i in range(len(LINK_RULES)):
        c = _link_rule(i, c)
    return trim_ws(c)


def with_sanitized_links(df, src: str, out: str):
    """DataFrame form of ``sanitize_links``: one projection per rule, so each
    intermediate text is computed once (a single nested expression would
    repeat the inner rules in every guard)."""
    tmp = f"_{out}_s"
    df = df.withColumn(tmp, F.col(src))
    for i in range(len(LINK_RULES)):
        df = df.withColumn(tmp, _link_rule(i, F.col(tmp)))
    return df.withColumn(out, trim_ws(tmp)).drop(tmp)


def doc_url(path, base_url) -> Column:
    """URL of a documentation file from its path relative to the docs root:
    drop ``.md``; when the file name equals its folder, drop the file name."""
    rel = F.regexp_replace(_c(path), "\\.md$", "")
    parts = F.split(rel, "/")
    n = F.size(parts)
    dedup = F.when((n >= 2) & (F.element_at(parts, -1) == F.element_at(parts, -2)),
                   F.array_join(F.slice(parts, 1, n - 1), "/")).otherwise(rel)
    return F.concat(_c(base_url), F.regexp_replace(dedup, "^/+", ""))


def version_major_minor(v) -> tuple[Column, Column]:
    """``^(\\d+)\\.(\\d+)`` -> (major, minor) as ints; null when absent."""
    pat = "^(\\d+)\\.(\\d+)"
    ok = _c(v).rlike(pat)
    major = F.when(ok, F.regexp_extract(_c(v), pat, 1).try_cast("int"))
    minor = F.when(ok, F.regexp_extract(_c(v), pat, 2).try_cast("int"))
    return major, minor


def route_doc_version(v) -> Column:
    """1.1 -> '1.1', 1.0 -> '1.0', anything else or unparsable -> 'latest'."""
    major, minor = version_major_minor(v)
    return (F.when((major == 1) & (minor == 1), F.lit("1.1"))
            .when((major == 1) & (minor == 0), F.lit("1.0"))
            .otherwise(F.lit("latest")))


def truncate_text(x, n: int = 500) -> Column:
    """First ``n`` characters plus '...' when longer."""
    c = _c(x)
    return F.concat(F.substring(c, 1, n), F.when(F.length(c) > n, F.lit("...")).otherwise(F.lit("")))


def doc_summary(doc) -> Column:
    """Text before the first 'Args:', stripped; null -> ''."""
    return trim_ws(F.substring_index(F.coalesce(_c(doc), F.lit("")), "Args:", 1))


def contains_ci(haystack, needle) -> Column:
    """Case-insensitive containment of the stripped expected text."""
    return F.contains(F.lower(trim_ws(haystack)), F.lower(trim_ws(needle)))
