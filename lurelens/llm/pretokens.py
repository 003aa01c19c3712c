"""Exact, fast splitting of texts into the pre-tokens of the byte-level BPE pattern.

``split`` gives what ``public_tokenizers.PATTERN`` matches, in order.  Texts whose characters all lie below
U+0100 are split by the standard library's engine with the character classes written out (about three times
faster); every other text by the ``regex`` module.  White space is the Unicode property White_Space, which is
what the Rust engines of the tokenizer libraries use; U+001C to U+001F are not in it.
"""

from __future__ import annotations

import re

import regex

_L = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
_N = "0-9\xb2\xb3\xb9\xbc-\xbe"
_S = " \t-\r\x85\xa0"
_NARROW = re.compile(
    rf" ?[{_L}]+|'(?:s|t|re|ve|m|ll|d)| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
).findall


def _is_narrow(text: str) -> bool:
    """All characters lie below U+0100; much faster to try than to search for one that does not."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def wide_splitter(pattern: str):
    """The splitter of any pattern, with ``\\s`` and ``\\S`` read as the property White_Space."""
    spelled = pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(
        r"\S", r"\P{White_Space}"
    )
    return regex.compile(spelled).findall


def make_split(pattern: str):
    """text -> list of pre-tokens; joined they are the text."""
    wide = wide_splitter(pattern)

    def split(text: str) -> list[str]:
        return _NARROW(text) if _is_narrow(text) else wide(text)

    return split


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in the vocabularies of byte-level BPE files: printable Latin-1
    characters stand for themselves, the other bytes take the letters from U+0100 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}
