"""Token ids by the tokenizers library, with a bounded memory of text chunks already encoded.

Both vocabularies split a text at every single blank between two characters that
are not white space, whatever stands around it, so a chunk between such blanks
always has the same ids.  Chunks repeat far more than texts do: each worker keeps
the ids of the chunks it has met and asks the library for the others only.  Texts
in which that rule doesn't hold (a special token's name, blanks beside other white
space) are encoded whole.
"""

from __future__ import annotations

import os
import re
import sys
from array import array

import numpy as np

#: Chunks and words a worker remembers before it starts anew, their bytes, and the longest it remembers.
REMEMBERED, REMEMBERED_BYTES, LONGEST = 1_200_000, 24 << 20, 64
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Chunks whose normal form is at most their lower case, without the apostrophe of contractions.
_SIMPLE = re.compile(f"[!-&(-~{_LETTERS[6:]}]+")
#: White space other than a single blank between two visible characters.
_ODD = re.compile(r"^\s|\s$|\s ")


def _byte_marks() -> dict[int, str]:
    """Byte -> printable character, as byte-level vocabularies write bytes: printable ones stand for themselves."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


_MARKS = _byte_marks()
_ENCODERS: dict[str, "Encoder"] = {}


class Encoder:
    """Ids of texts as little-endian bytes of ``dtype``; equal to ``encode(text, add_special_tokens=False)``."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: Whether a blank belongs to the word that follows (byte-level ids) or is dropped.
        self.blank = " " if len(self.whole(" a")) != len(self.whole("a")) or self.whole(" a") != self.whole("a") else ""
        self.lower = self.whole("A") == self.whole("a")
        self.line_break = self.whole("\n")
        #: Runs of letters, of digits and of other signs in simple chunks; the lower-casing vocabulary takes digits singly.
        digits = "[0-9]" if len(self.whole("11")) > len(self.whole("1")) else "[0-9]+"
        self.runs = re.compile(f" ?[{_LETTERS}]+| ?{digits}| ?[^ 0-9{_LETTERS}]+")
        self.word = re.compile(f"[{_LETTERS}]+")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.mark = self.blank.translate(_MARKS)
        self.known: dict[str, bytes | None] = {}
        self.parts: dict[str, bytes] = {}
        self.held = 0           # bytes of both
        self.remembered = REMEMBERED

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, getattr(self, "dtype", np.dtype("<u4"))).tobytes()

    def _ids(self, marked: str) -> bytes:
        ids = array(self.code, [t.id for t in self.model.tokenize(marked)])
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def _part(self, word: str) -> bytes:
        found = self.parts.get(word)
        if found is None:
            found = self._ids(word.encode().decode("latin-1").translate(_MARKS))
            if len(word) <= LONGEST:
                self.parts[word] = found
                self.held += len(word) + len(found)
        return found

    def _plain(self, word: str) -> bytes:
        """Ids of a chunk of letters only, which is one word."""
        word = word.lower() if self.lower else word
        return self._ids(self.mark + word if word.isascii() else (self.blank + word).encode().decode("latin-1").translate(_MARKS))

    def _chunk(self, chunk: str, before: str) -> bytes | None:
        """Ids of a chunk; None if the text around it has to be encoded whole."""
        if not chunk or _ODD.search(chunk):
            return None
        if "\n" in chunk:
            # One line break between visible characters is a boundary on both sides.
            lines = chunk.split("\n")
            ids = [self._chunk(x, before if i == 0 else "") for i, x in enumerate(lines)]
            return None if None in ids else self.line_break.join(ids)
        if _SIMPLE.fullmatch(chunk):
            words = self.runs.findall(before + (chunk.lower() if self.lower else chunk))
            return self._part(words[0]) if len(words) == 1 else b"".join(map(self._part, words))
        return self.whole(before + chunk)

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        for s in self.specials:
            if s in text:
                return self.whole(text)
        if len(self.known) + len(self.parts) > self.remembered or self.held > REMEMBERED_BYTES:
            self.known.clear()
            self.parts.clear()
            self.held = 0
        chunks = text.split(" ")
        known, word = self.known, self.word
        if self.blank:
            first = self._chunk(chunks[0], "")
            chunks = chunks[1:]
        else:
            first = b""
        out = [known.get(c) for c in chunks]
        if None in out:
            for i, c in enumerate(chunks):
                if out[i] is None:
                    ids = known.get(c)
                    if ids is None:
                        ids = self._plain(c) if word.fullmatch(c) else self._chunk(c, self.blank)
                        if ids is None:
                            return self.whole(text)
                        if len(c) <= LONGEST and "\n" not in c:
                            known[c] = ids
                            self.held += len(c) + len(ids)
                    out[i] = ids
        return self.whole(text) if first is None else first + b"".join(out)


def encoder(path: str, remembered: int | None = None) -> Encoder:
    """The worker's encoder of a vocabulary file; ``remembered`` bounds its memory of chunks from now on."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    _ENCODERS[path].remembered = REMEMBERED if remembered is None else remembered
    return _ENCODERS[path]
