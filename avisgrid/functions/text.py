"""Text expressions: Unicode strip, accent folding, negation erasure, quality rules.

All of it is built-in column expressions, so the text never leaves the JVM.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from avisgrid.functions import taxonomy as tx

# Characters Python's str.strip() removes; SQL trim() alone removes only U+0020.
STRIP_CHARS = "".join(chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace())

# The same set as a character class that Java (and RE2) understand.
SPACE_CLASS = (
    r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
LETTER_CLASS = r"\p{L}\p{Nl}\p{No}"  # word characters minus decimal digits and "_"
WORD_CLASS = r"\p{L}\p{N}_"


def _folding_table() -> tuple[str, str]:
    """Characters to replace and their base characters; combining marks have none.

    Characters that decompose into several base characters (Hangul syllables, a few
    Indic vowel signs) stay composed; none can occur in a keyword or change a rule.
    """
    composed, bases, marks = [], [], []
    for code in range(0x80, sys.maxunicode + 1):
        char = chr(code)
        kind = unicodedata.category(char)
        if kind == "Mn":
            marks.append(char)
        elif kind != "Cs" and char.lower() == char:
            base = [c for c in unicodedata.normalize("NFD", char) if unicodedata.category(c) != "Mn"]
            if len(base) == 1 and base[0] != char:
                composed.append(char)
                bases.append(base[0])
    return "".join(composed + marks), "".join(bases)


FOLD_FROM, FOLD_TO = _folding_table()


def _escaped(char: str) -> str:
    return char if char.isalnum() or char == " " else "\\" + char


def _branches(node: dict, inner: bool) -> str:
    """A trie node as pattern: its branches, by ranges of their first characters where there are many."""
    heads = sorted(c for c in node if c)
    parts = [_escaped(c) + _branches(node[c], True) for c in heads]
    if len(parts) > 6:
        step = -(-len(parts) // -(-len(parts) // 5))
        runs = [(heads[i : i + step], parts[i : i + step]) for i in range(0, len(parts), step)]
        parts = [f"(?=[{''.join(map(_escaped, h))}])(?:{'|'.join(p)})" for h, p in runs]
    if not parts:
        return ""
    joined = "|".join(parts)
    if "" in node:  # a keyword ends here, a longer one may go on
        return f"(?:{joined})?"
    return f"(?:{joined})" if inner and len(parts) > 1 else joined


def longest_at_each_place(keywords: Iterable[str]) -> str:
    """A pattern whose first group is, wherever a keyword begins, the longest one that does.

    The keywords become a trie, so a place costs a few comparisons however many keywords
    there are. The match itself is empty: the search goes on at the next character, and
    keywords that overlap are all seen. Shorter keywords at the same place are prefixes of the longest.
    """
    trie: dict = {}
    for word in keywords:
        node = trie
        for char in word:
            node = node.setdefault(char, {})
        node[""] = {}
    return f"(?=({_branches(trie, False)}))"


def keywords_in(text: Column, keywords: Iterable[str]) -> Column:
    """The distinct keywords that occur anywhere in a text, from one pass over it."""
    words = sorted(set(keywords))
    prefixes = {w: [k for k in words if w.startswith(k)] for w in words}
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(longest_at_each_place(words)), F.lit(1)))
    longer = {w: p for w, p in prefixes.items() if len(p) > 1}
    if not longer:
        return found
    entries = ", ".join(f"{quoted(w)}, array({', '.join(map(quoted, p))})" for w, p in longer.items())
    held = F.expr(f"map({entries})")
    each = F.transform(found, lambda w: F.coalesce(F.try_element_at(held, w), F.array(w)))
    return F.array_distinct(F.flatten(each))


def quoted(value: str | None) -> str:
    """A text as SQL literal."""
    if value is None:
        return "CAST(NULL AS STRING)"
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def strip(text: Column) -> Column:
    """Unicode-aware trim at both ends."""
    return F.btrim(text, F.lit(STRIP_CHARS))


def is_blank(text: Column) -> Column:
    """True for NULL and for text made of white space only."""
    return text.isNull() | (strip(text) == "")


def normalize(text: Column) -> Column:
    """Lower case without accents: composed letters become their base, marks drop.

    ``translate`` deletes what has no counterpart, so one pass does both.  Pure ASCII
    text (as many bytes as characters) needs no pass at all.
    """
    low = F.lower(text)
    return F.when(F.octet_length(low) == F.char_length(low), low).otherwise(
        F.translate(low, FOLD_FROM, FOLD_TO)
    )


def strip_negation(normalized: Column) -> Column:
    """Remove phrases such as "pas une arnaque" so their keyword does not count."""
    return F.regexp_replace(normalized, tx.NEGATION_PATTERN.replace(r"\s", SPACE_CLASS), "")


def has_min_letters(text: Column) -> Column:
    """At least MIN_LETTERS letters; the search stops at the last one needed."""
    more = tx.MIN_LETTERS - 1
    return text.rlike(f"[{LETTER_CLASS}](?:[^{LETTER_CLASS}]*+[{LETTER_CLASS}]){{{more}}}")


def has_min_words(normalized: Column) -> Column:
    """At least MIN_WORDS runs of word characters; also stops early."""
    more = tx.MIN_WORDS - 1
    return normalized.rlike(f"[{WORD_CLASS}](?:[{WORD_CLASS}]*+[^{WORD_CLASS}]++[{WORD_CLASS}]){{{more}}}")


def exclusion_reason(text: Column, normalized: Column) -> Column:
    """First quality rule the text breaks, NULL when the review is usable."""
    raw = strip(text)
    return (
        F.when(is_blank(text), tx.REASON_EMPTY)
        .when(F.lower(raw).isin(*tx.PLACEHOLDER_TEXTS), tx.REASON_PLACEHOLDER)
        .when(F.char_length(raw) < tx.MIN_CHARS, tx.REASON_TOO_SHORT)
        .when(~has_min_letters(raw), tx.REASON_NO_TEXT)
        .when(~has_min_words(normalized), tx.REASON_TOO_SHORT)
        .when(strip(normalized).isin(*tx.GENERIC_PHRASES), tx.REASON_GENERIC)
    )


def join_title_body(title: Column, body: Column) -> Column:
    """``title. body`` without dots and spaces at the ends; a text for "nothing"."""
    head = F.coalesce(strip(title), F.lit(""))
    tail = F.coalesce(strip(body), F.lit(""))
    joined = F.when(
        head != "", F.btrim(F.concat(head, F.lit(". "), tail), F.lit(". "))
    ).otherwise(tail)
    return F.when(joined == "", tx.EMPTY_BODY_TEXT).otherwise(joined)
