"""Whole-text encoding with the tokenizers library, each piece of text encoded once.

A text is cut where the tokenizer's own pre-tokenizer always cuts (white space), so the
ids of the text are those of its pieces in turn. Pieces repeat, and their ids are kept.
"""

from __future__ import annotations

import os
from itertools import accumulate, chain

import numpy as np

from .common import keep

#: Control characters that str.split() takes for white space, and the tokenizers don't.
_CONTROL_SPACE = "\x1c\x1d\x1e\x1f"
#: What, beside single blanks and line feeds between words, makes a text be encoded as a whole.
_OTHER_SPACE = (*"\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000", "  ", " \n", "\n ", "\n\n", "<|")

#: Pieces of a generation; two are remembered.
PIECES = 450_000


def _pieces_spaces(text: str) -> list[str] | None:
    """For tokenizers that drop white space. None: encode the text as a whole."""
    if any(c in text for c in _CONTROL_SPACE):
        return None
    try:  # within Latin-1 a letter's lower case is one letter, whatever stands beside it
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text.split()
    return text.lower().split() if "<|" not in text else text.split()


def _pieces_bytes(text: str) -> list[str] | None:
    """For byte-level tokenizers whose pieces take one leading blank. A piece that starts with
    a line feed stands for itself; any other has a blank before it, but for the first."""
    if text[-1:] in (" ", "\n") or any(c in text for c in _OTHER_SPACE):
        return None
    return text.replace("\n", " \n").split(" ") if text else []


class TextEncoder:
    """ids(texts) as little-endian unsigned 32-bit bytes, equal to the library's encoding of each whole text."""

    #: ASCII marks that the pre-tokenizers cut off a letter before them, whatever follows (not those of contractions and special tokens).
    AFTER_LETTER = ".,;:!?#$%&*"

    def __init__(self, path: str, limit: int = PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        byte_level = "ByteLevel" in type(self.tok.pre_tokenizer).__name__
        self.lead = " " if byte_level else ""
        self.pieces = _pieces_bytes if byte_level else _pieces_spaces
        #: The model's letters for Latin-1 characters: one for each byte of their UTF-8.
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        letter = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in plain)}
        self.letters = {c: "".join(letter[b] for b in chr(c).encode()) for c in range(256)}
        self.model = self.tok.model
        self.limit, self.new, self.old = limit, {}, {}

    @property
    def vocab_size(self) -> int:
        return self.tok.get_vocab_size(with_added_tokens=True)

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Of words of Latin-1 letters, each after a blank: such a word is one piece of the pre-tokenizer, so the model alone is asked."""
        if not self.lead:
            words = [w.lower() for w in words]
        blank, letters, split = self.letters[0x20] if self.lead else "", self.letters, self.model.tokenize
        ids = [[t.id for t in split(blank + (w if w.isascii() else w.translate(letters)))] for w in words]
        raw = np.fromiter(chain.from_iterable(ids), "<u4").tobytes()
        ends = list(accumulate(4 * len(x) for x in ids))
        return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if ids else []

    def _look_up(self, pieces: list[list[str]]) -> list[list[bytes]]:
        """The ids of every piece; those that weren't in the newer generation are put there."""
        if len(self.new) > self.limit:
            self.old, self.new = self.new, {}
        new, old = self.new, self.old
        found = [list(map(new.get, c)) for c in pieces]
        holes = [(c, f, [i for i, v in enumerate(f) if v is None]) for c, f in zip(pieces, found, strict=True) if None in f]
        missing = {c[i] for c, _, at in holes for i in at}
        ended, fresh = [], set()
        for p in missing:
            v = old.get(p)
            if v is not None:
                new[p] = v
                continue
            base = p.rstrip(self.AFTER_LETTER)
            # Beyond Latin-1 a letter may become a letter and a mark, to which what follows clings.
            if base and base is not p and base[-1] <= "\xff" and base[-1].isalpha():
                ended.append((p, base))
                if base not in new and (v := old.get(base)) is None:
                    fresh.add(base)
                elif base not in new:
                    new[base] = v
            else:
                fresh.add(p)
        words, rest = [], []
        for p in fresh:
            (words if p.isalpha() and (p.isascii() or max(p) <= "\xff") else rest).append(p)
        for at in range(0, len(words), 5000):
            new.update(zip(words[at : at + 5000], self._encode_words(words[at : at + 5000]), strict=True))
        new.update(zip(rest, self._encode([p if p[0] == "\n" else self.lead + p for p in rest]), strict=True))
        marks = list({p[len(b) :] for p, b in ended})
        mark = dict(zip(marks, self._encode(marks), strict=True))
        for p, b in ended:
            new[p] = new[b] + mark[p[len(b) :]]
        for c, f, at in holes:
            for i in at:
                f[i] = new[c[i]]
        return found

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        texts = [t or "" for t in texts]
        cut = [self.pieces(t) for t in texts]
        heads = [""] * len(texts)
        if self.lead:  # the first piece has no blank before it
            heads = [c[0] if c and c[0] and c[0][0] != "\n" else "" for c in cut]
            cut = [c[1:] if h else c and [x for x in c if x] for c, h in zip(cut, heads, strict=True)]
        found = self._look_up([c or [] for c in cut])
        whole = list({t for t, c in zip(texts, cut, strict=True) if c is None} | {h for h in heads if h})
        first = dict(zip(whole, self._encode(whole), strict=True)) | {"": b""}
        return [first[t] if c is None else first[h] + b"".join(f) for t, c, h, f in zip(texts, cut, heads, found, strict=True)]


def encoder(path: str, limit: int = PIECES) -> TextEncoder:
    """The process's encoder for a tokenizer file: a worker's later tasks find the pieces of its earlier ones."""
    return keep(("encoder", path, limit), lambda: TextEncoder(path, limit))
