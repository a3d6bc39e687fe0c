"""Normalisation with offsets, the signal gate, token counts and context windows.

Spans are UTF-8 bytes of the original text. Python code works on characters of the
normalised text and converts at the end; Column versions serve whole tables.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import Column
from pyspark.sql import functions as F

# What folding maps to a letter, a hyphen, a blank and a quote.
FOLD = {"ё": "е", **dict.fromkeys("\u2010\u2011\u2012\u2013\u2014\u2015\u2212", "-"), **dict.fromkeys("\t\u00a0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000", " "), **dict.fromkeys("«»„“”", '"')}
_TABLE = str.maketrans(FOLD)
_FOLDED = re.compile("[" + "".join(map(re.escape, FOLD)) + "]")


def _byte_starts(text: str) -> list[int] | None:
    """Where each character starts in UTF-8, and the end; None: one byte each."""
    if text.isascii():
        return None
    return list(accumulate((1 if c < "\x80" else 2 if c < "\u0800" else 3 if c < "\U00010000" else 4 for c in text), initial=0))


class Document:
    """A text, its normalised form, and the way back from one to the other."""

    __slots__ = ("text", "norm", "source", "_starts")

    def __init__(self, text: str):
        self.text, self.source, self._starts = text, None, {}
        lower = text.lower()
        if text.isascii():
            self.norm = lower.replace("\t", " ")
        elif len(lower) == len(text) and "Σ" not in text and unicodedata.is_normalized("NFKC", text) and unicodedata.is_normalized("NFKC", lower):
            self.norm = lower.translate(_TABLE) if _FOLDED.search(lower) else lower
        else:
            out, self.source = [], []
            for i, c in enumerate(text):
                for x in unicodedata.normalize("NFKC", c):
                    piece = x.lower().translate(_TABLE)
                    out.append(piece)
                    self.source += [i] * len(piece)
            self.source.append(len(text))
            self.norm = "".join(out)

    def _bytes(self, which: str) -> list[int] | None:
        if which not in self._starts:
            self._starts[which] = _byte_starts(getattr(self, which))
        return self._starts[which]

    @property
    def text_bytes(self) -> list[int] | None:
        return self._bytes("text")

    @property
    def norm_bytes(self) -> list[int] | None:
        return self._bytes("norm")

    def span(self, start: int, end: int) -> tuple[int, int]:
        """Original bytes of normalised characters [start, end)."""
        if self.source is not None:
            start, end = self.source[start], self.source[end]
        return (start, end) if self.text_bytes is None else (self.text_bytes[start], self.text_bytes[end])

    def original(self, start: int, end: int) -> str:
        """The original under normalised characters [start, end)."""
        return self.text[start:end] if self.source is None else self.text[self.source[start] : self.source[end]]

    def offset_map(self) -> list[int]:
        """For each byte of the normalised text the original byte its character came from, then the length."""
        out = []
        for i, c in enumerate(self.norm):
            out += [self.span(i, i)[0]] * len(c.encode())
        return [*out, len(self.text.encode())]

    def window(self, start: int, end: int, left: int, right: int) -> str:
        """Normalised text from left bytes before to right bytes after, widened to whole characters."""
        b = self.norm_bytes
        if b is None:
            return self.norm[max(0, start - left) : end + right]
        return self.norm[bisect_right(b, max(0, b[start] - left)) - 1 : bisect_left(b, min(b[-1], b[end] + right))]

    def text_window(self, start: int, end: int, left: int, right: int) -> str:
        """The same of the original, for original bytes [start, end)."""
        b = self.text_bytes
        if b is None:
            return self.text[max(0, start - left) : end + right]
        return self.text[bisect_right(b, max(0, start - left)) - 1 : bisect_left(b, min(b[-1], end + right))]

    def slice(self, start: int, end: int) -> str:
        """Original bytes [start, end)."""
        b = self.text_bytes
        return self.text[start:end] if b is None else self.text[bisect_left(b, start) : bisect_left(b, end)]

    def at_boundary(self, start: int, end: int) -> bool:
        """No ASCII letter or digit before; none, and nothing beyond ASCII, after."""
        before, after = self.norm[start - 1 : start], self.norm[end : end + 1]
        return not (before and before.isascii() and before.isalnum()) and not (after and (not after.isascii() or after.isalnum()))


_WORDS = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    return _WORDS.findall(text)


def has_word(text: str, wanted: frozenset[str]) -> bool:
    return not wanted.isdisjoint(words(text))


def has_prefix(text: str, stems: tuple[str, ...]) -> bool:
    return any(w.startswith(stems) for w in words(text))


def has_signal(text: str | None) -> bool:
    """Whether a text can hold anything: an ASCII digit, an @ or an upper-case letter."""
    return bool(text) and any("0" <= c <= "9" or c == "@" or c.isupper() for c in text)


def has_signal_col(text: Column) -> Column:
    return text.rlike(r"[0-9@\p{IsUppercase}]")


def count_tokens_col(text: Column) -> Column:
    """Runs of letters, and every other character that isn't white space; by 1.3 if over 0.3 of all are Cyrillic."""
    n = F.regexp_count(text, F.lit(r"\p{IsAlphabetic}+")) + F.regexp_count(text, F.lit(r"[^\p{IsAlphabetic}\p{IsWhite_Space}]"))
    cyrillic = F.regexp_count(text, F.lit("[а-яА-Я]")) / F.greatest(F.length(text), F.lit(1)) > 0.3
    return F.when(cyrillic, F.round(n.cast("double") * 1.3)).otherwise(n).cast("long")


def count_tokens(text: str) -> int:
    n, inside = 0, False
    for c in text:
        letter = c.isalpha()
        n += (letter and not inside) or not (letter or c.isspace())
        inside = letter
    cyrillic = sum("а" <= c <= "я" or "А" <= c <= "Я" for c in text)
    return int(n * 1.3 + 0.5) if text and cyrillic / len(text) > 0.3 else n


def normalize_col(text: Column) -> Column:
    """The normalised form where no character changes under NFKC (fast path for whole tables)."""
    keys = "".join(k for k in FOLD)
    return F.translate(F.lower(text), keys, "".join(FOLD.values()))


def sentence_windows(doc: Document, triggers: tuple[str, ...], most: int) -> list[tuple[int, int]]:
    """Sentences (normalised characters) with a capital inside or a trigger word: what a recogniser should see."""
    out, start = [], 0
    for end in [*(m.end() for m in re.finditer(r"[.!?\n]", doc.norm)), len(doc.norm)]:
        if end > start:
            inner = doc.original(start, end).split()[1:]
            if any(w[0].isupper() for w in inner) or any(t in doc.norm[start:end] for t in triggers):
                out.append((start, end))
        start = end
    return out[:most]
