"""Whole-text encoding with a public tokenizer, word by word through a bounded cache.

Both vocabularies split text before merging, and never across the places at which a text is cut
here, so a piece's ids don't depend on its neighbours. Each distinct piece is encoded once by the
tokenizers library and kept as little-endian 32-bit ids; a text is then a join of cached bytes.
Texts for which a cut isn't known to be safe are encoded whole.
"""

from __future__ import annotations

import os
import re
import string
import struct
import unicodedata

import numpy as np

#: Pieces kept per Python worker and generation; two generations bound the memory to about 130 MB.
CACHE = 300_000
#: Control characters that Python splits at and the tokenizer doesn't.
CONTROL = re.compile(r"[\x1c-\x1f]")
LONGEST = 200


TAILS = "".join(c for c in string.punctuation if c != "'")


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Encoder:
    """`encode(texts)` gives each text's ids as little-endian bytes of `width`, as Tokenizer.encode does.

    A new piece that is letters, perhaps with punctuation behind them, goes straight to the
    library's BPE model, letters and punctuation apart, as the vocabulary's own pattern parts them.
    Other pieces go through the whole tokenizer.
    """

    def __init__(self, path: str, cache: int = CACHE, width: int = 4):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.limit, self.width, self.code = cache, width, {2: "H", 4: "I"}[width]
        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.model = self.tok.model
        self.keeps_space = self.tok.normalizer is None
        self.letters = byte_letters()
        self.cache = Pieces(self, {})
        self.tails: dict[str, bytes] = {"": b""}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=f"<u{self.width}").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters_of(self, core: str) -> str | None:
        """A run of letters as the model reads it; None if the tokenizer might part or change it otherwise."""
        if core.isascii():
            return core if self.keeps_space else core.lower()
        if not self.keeps_space:
            if "\u03a3" in core:
                return None
            core = unicodedata.normalize("NFC", core).lower()
            if not core.isalpha():
                return None
        letters = self.letters
        return "".join([letters[b] for b in core.encode()])

    def learn(self, piece: str) -> bytes:
        """Ids of one piece, white space in front included."""
        core = piece.rstrip(TAILS)
        tail = piece[len(core) :]
        if tail and len(piece) <= LONGEST and (bare := core[self.keeps_space and core[:1] in (" ", "\n") :]).isascii() and bare.isalpha():
            return self.cache[self._key(core)] + self._tail(tail)  # tails vary: the bare word is the better thing to keep
        head, lead = b"", ""
        if self.keeps_space:
            if core[:1] == " ":
                core, lead = core[1:], self.letters[32]
            elif core[:1] == "\n":
                core, head = core[1:], self._tail("\n")
        shown = self._letters_of(core) if core.isalpha() and len(core) <= LONGEST else None
        if shown is None or len(tail) > LONGEST:
            return self._whole([piece])[0]
        ids = [t.id for t in self.model.tokenize(lead + shown)]
        return head + struct.pack(f"<{len(ids)}{self.code}", *ids) + (self._tail(tail) if tail else b"")

    def _key(self, piece: str) -> str:
        """The key that Pieces keeps a piece under: a space in front is left out, and a piece without one is marked."""
        if not self.keeps_space or piece[:1] == "\n":
            return piece
        return piece[1:] if piece[:1] == " " else "\0" + piece

    def _tail(self, tail: str) -> bytes:
        if tail not in self.tails:
            if len(self.tails) > 5000:
                self.tails.clear()
            self.tails[tail] = self._whole([tail])[0]
        return self.tails[tail]

    def encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for text in texts:
            words = text.split()
            if not self.keeps_space:  # white space only separates
                out.append(self._whole([text])[0] if CONTROL.search(text) else b"".join(map(self.cache.__getitem__, words)))
            elif not words or " ".join(words) != text.replace("\n", " ") or "\0" in text:
                out.append(self._whole([text])[0])
            else:  # single spaces and line feeds only: each starts a piece; a piece that starts with neither follows a space
                words = text.replace("\n", " \n").split(" ")
                words[0] = "\0" + words[0]
                out.append(b"".join(map(self.cache.__getitem__, words)))
            if len(self.cache) > self.limit:
                self.cache = Pieces(self, self.cache)
        return out


class Pieces(dict):
    """Ids by piece; what isn't here comes from the generation before, or is encoded."""

    def __init__(self, owner: Encoder, before: dict[str, bytes]):
        super().__init__()
        self.owner, self.before = owner, dict(before)

    def __missing__(self, piece: str) -> bytes:
        ids = self.before.get(piece)
        if ids is None:
            owner = self.owner
            if not owner.keeps_space or piece[:1] == "\n":
                ids = owner.learn(piece)
            else:
                ids = owner.learn(piece[1:] if piece[:1] == "\0" else " " + piece)
        self[piece] = ids
        return ids


_encoders: dict[tuple[str, int, int], Encoder] = {}


def encoder(path: str, cache: int = CACHE, width: int = 4) -> Encoder:
    """This worker process's encoder for a vocabulary file."""
    if (path, cache, width) not in _encoders:
        _encoders[path, cache, width] = Encoder(path, cache, width)
    return _encoders[path, cache, width]


def id_width(path: str, *others: int) -> int:
    """Bytes that hold each id of a vocabulary, and the other ids given."""
    from tokenizers import Tokenizer

    return 2 if max(Tokenizer.from_file(path).get_vocab_size(), *(i + 1 for i in others)) <= 65536 else 4
