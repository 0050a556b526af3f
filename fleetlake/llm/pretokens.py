"""Splitting of texts before byte-level merges, as the tokenizer libraries split them.

The libraries know another version of Unicode than Python's modules do, so a pattern run here would cut some characters
otherwise. Texts made of characters on which all agree (``_SAME``; the tests compare every code point) are split here;
any other text is split by the library's own pre-tokenizer, which uses the same pattern.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import public_tokenizers
import regex

#: Texts are split in stretches of this many characters.
STRETCH_CHARS = 1 << 18
_ANY = regex.compile(public_tokenizers.PATTERN)
#: The same pattern for texts of ASCII characters only, where the standard module is faster.
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)
#: Characters that every version puts into one class: Latin, Greek and Cyrillic letters, punctuation and symbols, kana,
#: ideographs and Hangul of the first plane, and full-width forms.
_SAME = re.compile("[\x00-ԯ‐-⁰₠-⃀℀-↋←-⏿─-⭳　-〿ぁ-ゖ゙-ヿ一-鿿가-힣！-ﾝ]*")
#: A cut between two matches, whatever stands around it: no match goes from a letter or digit to white space.
_CUT = re.compile(r"(?<=[A-Za-z0-9])(?=[ \n])")
_library: list = []


def _library_split(text: str) -> list[str]:
    if not _library:
        from tokenizers import pre_tokenizers

        _library.append(pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True))
    return [text[a:b] for _, (a, b) in _library[0].pre_tokenize_str(text)]


def stretches(text: str, most: int = STRETCH_CHARS) -> Iterator[str]:
    """``text`` in parts of about ``most`` characters, cut where a match ends in any case."""
    start = 0
    while len(text) - start > most:
        cut = _CUT.search(text, start + most)
        if cut is None:
            break
        yield text[start:cut.start()]
        start = cut.start()
    yield text[start:]


def split(text: str) -> list[str]:
    """The matches of the pattern in ``text``, in order; joined they are the text."""
    if len(text) > STRETCH_CHARS:
        return [w for part in stretches(text) for w in _split(part)]
    return _split(text)


def _split(text: str) -> list[str]:
    if text.isascii():
        return _ASCII.findall(text)
    if _SAME.fullmatch(text):
        return _ANY.findall(text)
    return _library_split(text)
