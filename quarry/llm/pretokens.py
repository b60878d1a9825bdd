"""Splitting text into the pieces that byte-level merges work on.

The published pattern needs Unicode property classes, for which the standard ``re`` module has no
syntax, so they are spelled out from ``unicodedata``. For every code point that is assigned there (Unicode 15.1 in
Python 3.13) the tokenizer libraries have the same classes; newer code points are what they may differ in. Classes beyond
the basic plane make ``re`` slow, so a text without such characters takes an expression without them.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

#: The characters that count as white space.
SPACE = "\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_PLANE = 0x10000
_BEYOND = re.compile("[\U00010000-\U0010ffff]").search


@cache
def _runs() -> list[tuple[int, int, str]]:
    """Runs (first, end, major category) of code points; the category of those that aren't assigned is "?"."""
    out, start, kind = [], 0, ""
    for c in range(sys.maxunicode + 2):
        found = "" if c > sys.maxunicode else unicodedata.category(chr(c))
        found = "?" if found == "Cn" else found[:1]
        if found != kind or c == _PLANE:
            out.append((start, c, kind))
            start, kind = c, found
    return out[1:]


def _class(kind: str, end: int) -> str:
    return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b, k in _runs() if k == kind and b <= end)


def _pieces(end: int) -> Callable[[str], list[str]]:
    letters, numbers = _class("L", end), _class("N", end)
    return re.compile(
        f"'(?:[stmd]|re|ve|ll)| ?[{letters}]++| ?[{numbers}]++| ?[^{SPACE}{letters}{numbers}]++|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
    ).findall


def splitter() -> tuple[Callable[[str], list[str]], Callable[[str], object]]:
    """Two functions: the pieces of a text by public_tokenizers.PATTERN, and whether it has a code point that isn't assigned."""
    near, wide = _pieces(_PLANE), _pieces(sys.maxunicode + 1)
    odd, odd_wide = (re.compile(f"[{_class('?', end)}]").search for end in (_PLANE, sys.maxunicode + 1))

    def pieces(text: str) -> list[str]:
        return near(text) if text.isascii() or not _BEYOND(text) else wide(text)

    def unassigned(text: str) -> object:
        return not text.isascii() and (odd_wide(text) if _BEYOND(text) else odd(text))

    return pieces, unassigned


def by_offsets(text: str, pre_tokenizer) -> Iterator[str]:
    """The pieces of a text as a pre-tokenizer of the ``tokenizers`` library has them."""
    return (text[a:b] for _, (a, b) in pre_tokenizer.pre_tokenize_str(text))
