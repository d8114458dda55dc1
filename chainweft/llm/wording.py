"""Words of a text, give or take layout, markup, letter case, punctuation, invisible characters and escapes."""

from __future__ import annotations

import html
import re
import unicodedata
from urllib.parse import unquote

# Cyrillic and Greek letters that look like Latin ones, and those Latin letters.
LOOKALIKE = "АВЕКМНОРСТУХаеорсухіјѕһԁԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧκοανιρτυχ"
LOOKED_AT = "ABEKMHOPCTYXaeopcyxijshdqwABEZHIKMNOPTYXkoaviptux"

_FOLD = str.maketrans(LOOKALIKE, LOOKED_AT)
_LOOK = re.compile(f"[{LOOKALIKE}]")
_ACCENT = re.compile(r"[\u0300-\u036f\u0483-\u0489\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]")
_TAG = re.compile(r"<!--.*?-->|</?[A-Za-z][^<>]*>", re.S)
_UNICODE_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})")
_ESCAPE = re.compile(r"\\[nrtbf]")
_BROKEN_WORD = re.compile(r"(?<=[^\W\d_])[-\u2010]\s*\n\s*(?=[^\W\d_])")
_INVISIBLE = re.compile(r"[\u00ad\u034f\u061c\u115f-\u1160\u17b4-\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff\uffa0\ufff9-\ufffb]")
_APOSTROPHE = re.compile("(?<=\\w)['’‘ʼ`´](?=\\w)")
_TOKEN = re.compile(r"\d+|[^\W\d_]+")
#: A word, or a number with its separators, which counts as one word.
_PIECE = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+")
_SEPARATOR = re.compile("[.,]")


def plain(text: str) -> str:
    """Lower-case text without markup, escapes and invisible characters."""
    if "&" in text:
        text = html.unescape(html.unescape(text))
    if "%20" in text:
        text = unquote(text)
    if "\\" in text:
        text = _ESCAPE.sub(" ", _UNICODE_ESCAPE.sub(lambda m: chr(int(m[1], 16)), text))
    if "<" in text:
        text = _TAG.sub(" ", text)
    if not text.isascii():
        text = _INVISIBLE.sub("", text)
        text = unicodedata.normalize("NFKD", text)
        text = _ACCENT.sub("", text)
        if _LOOK.search(text):
            text = text.translate(_FOLD)
    return _APOSTROPHE.sub("", _BROKEN_WORD.sub("", text)).lower()


def tokens(text: str | None) -> list[str]:
    """Words and parts of numbers, in order; none for null."""
    return _TOKEN.findall(plain(text)) if text else []


def weighted_tokens(text: str | None) -> tuple[list[str], list[float]]:
    """The tokens, each with the part of a word that it is: a number in several parts is one word."""
    pieces = _PIECE.findall(plain(text or ""))
    words: list[str] = []
    weights: list[float] = []
    last = 0
    for k in [k for k, piece in enumerate(pieces) if "," in piece or "." in piece] + [len(pieces)]:
        words += pieces[last:k]
        weights += [1.0] * (k - last)
        parts = _SEPARATOR.split(pieces[k]) if k < len(pieces) else []
        words += parts
        weights += [1.0 / len(parts)] * len(parts) if parts else []
        last = k + 1
    return words, weights
