"""Small pieces of text handling shared by the operators of this subpackage."""

from __future__ import annotations

import unicodedata

import regex

# Characters that show nothing (format characters, selectors, fillers, soft hyphen).
INVISIBLE = (
    "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f"
    "\u3164\ufe00-\ufe0f\ufeff\uffa0\ufff9-\ufffb\U000e0000-\U000e0fff"
)
# White space other than the plain blank.
SPACES = "\t\n\x0b\x0c\r\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

_NOT_LETTER = regex.compile(rf"[^\p{{L}}\p{{M}}]+|[{INVISIBLE}]+")
_INVISIBLE = regex.compile(f"[{INVISIBLE}]+")
_NOT_WORD = regex.compile(rf"[^\p{{L}}\p{{M}}\p{{N}}]+|[{INVISIBLE}]+")


def letters_only(text: str) -> str:
    """The letters of a text in one width, without numbers, space, punctuation, ornament and invisible characters."""
    if not text.isascii():
        text = _INVISIBLE.sub("", text)
        if not unicodedata.is_normalized("NFKC", text):
            text = unicodedata.normalize("NFKC", text)
    return _NOT_LETTER.sub("", text)


def words_only(text: str) -> str:
    """Letters and digits of a text in one width and case."""
    if not text.isascii():
        text = _INVISIBLE.sub("", text)
        if not unicodedata.is_normalized("NFKC", text):
            text = unicodedata.normalize("NFKC", text)
    return _NOT_WORD.sub("", text).casefold()


def shown(text: str) -> str:
    """A text without its invisible characters."""
    return text if text.isascii() else _INVISIBLE.sub("", text)
