"""DuckDB spellings of the string rules, for oracle statements only.

Built from the same pattern constants as the Spark column functions. RE2
has no look-ahead, so the 'not http(s)' link rule marks external links
with chr(1), rewrites, then restores the mark.
"""

from __future__ import annotations

from tessera.functions.text import LINE_BREAK, LINK_RULES, WS


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def _j2re2(repl: str) -> str:
    return repl.replace("$1", "\\1").replace("$2", "\\2")


def trim_ws(x: str) -> str:
    return f"regexp_replace({x}, {q('^' + WS + '+|' + WS + '+$')}, '', 'g')"


def lstrip_ws(x: str) -> str:
    return f"regexp_replace({x}, {q('^' + WS + '+')}, '')"


def word_count(x: str) -> str:
    return (f"len(list_filter(regexp_split_to_array({x}, {q(WS + '+')}), "
            f"lambda t: t <> ''))")


def split_lines(x: str) -> str:
    return f"string_split_regex({x}, {q(LINE_BREAK)})"


def sanitize_links(x: str) -> str:
    c = x
    for i, (pattern, repl) in enumerate(LINK_RULES):
        if i == 1:
            mark = "]' || chr(1) || '("
            c = f"regexp_replace({c}, {q('\\]\\((https?://)')}, '{mark}\\1', 'g')"
            c = f"regexp_replace({c}, {q('\\[([^\\]]+)\\]\\(([^)]*)\\)')}, {q(_j2re2(repl))}, 'g')"
            c = f"replace({c}, ']' || chr(1) || '(', '](')"
            continue
        c = f"regexp_replace({c}, {q(pattern)}, {q(_j2re2(repl))}, 'g')"
    return trim_ws(c)
