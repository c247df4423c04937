"""Splitting texts into pre-tokens with the standard `re` module where its classes are certain.

`ODD` finds characters outside the Latin, Greek and Cyrillic letters, marks and common punctuation for which Python,
the `regex` module and the tokenizer library are known to agree on case and class; texts with any of them are left to
the library. For the others, the vocabularies' patterns are compiled with explicit character sets, which `re` scans
about twice as fast as property classes.
"""

from __future__ import annotations

import re
from functools import cache

import regex

ODD = re.compile(r"[^\x00-\x1b\x20-\x84\x86-įĲ-ɏ̀-ͯΑ-΢Τ-ϿА-я‐-‧‰-›€]").search


@cache
def characters(kind: str) -> str:
    """The inside of a character set: all ordinary characters that the `regex` module puts in a class."""
    spans: list[list[int]] = []
    for code in range(0x2100):
        if not ODD(chr(code)) and regex.fullmatch(kind, chr(code)):
            if spans and spans[-1][1] == code - 1:
                spans[-1][1] = code
            else:
                spans.append([code, code])
    return "".join(re.escape(chr(a)) + ("-" + re.escape(chr(b)) if b > a else "") for a, b in spans)


@cache
def byte_split():
    """For ordinary texts, the pieces of the byte-level vocabulary's pattern."""
    letters, numbers, others = map(characters, (r"\p{L}", r"\p{N}", r"[^\s\p{L}\p{N}]"))
    return re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?(?:[{letters}]+|[{numbers}]+|[{others}]+)|\s+(?!\S)|\s+").findall


@cache
def word_split():
    """For ordinary texts, the pieces of the word-end vocabulary's pattern."""
    letters, numbers, others = map(characters, (r"\p{L}", r"\p{N}", r"[^\s\p{L}\p{N}]"))
    return re.compile(rf"[{letters}]+|'(?:s|t|re|ve|m|ll|d)|[{numbers}]|[{others}]+").findall
