"""Token ids of whole texts by the tokenizers library, with a bounded cache of words."""

from __future__ import annotations

import re
import struct

import numpy as np

from . import common

#: Words a worker keeps, and the longest word it keeps, in characters.
CACHE_WORDS, CACHE_CHARS = 700_000, 48
#: Words of these letters stay whole in the tokenizer's splitter, and none of its normal forms joins or cuts them.
PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch


def byte_letters() -> dict[int, str]:
    """The letters that byte-level tokenizers write for bytes: printable ones stand for themselves, the rest follow U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    return {b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}


class Words(dict):
    """Ids of a word that has no space, computed when it is first looked up."""

    def __init__(self, tokenizer):
        self.tokenizer, self.tokenize, self.letters = tokenizer, tokenizer.model.tokenize, byte_letters()
        self.signs = {x: self.whole(x) for x in ",."}
        self[""] = b""

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def plain(self, core: str) -> bytes:
        core = core.lower()
        if (ids := self.get(core)) is None:
            found = self.tokenize(core if core.isascii() else core.encode().decode("latin-1").translate(self.letters))
            ids = struct.pack(f"<{len(found)}I", *[x.id for x in found])
            if len(core) <= CACHE_CHARS:
                self[core] = ids
        return ids

    def __missing__(self, word: str) -> bytes:
        core, sign = (word[:-1], self.signs[word[-1]]) if word[-1] in self.signs else (word, b"")
        ids = self.plain(core) + sign if PLAIN(core) else self.whole(word)
        if len(word) <= CACHE_CHARS:
            self[word] = ids
        return ids


class Encoder:
    """Ids as little-endian unsigned 32-bit bytes.

    A text is cut at U+0020 and U+000A, which the tokenizer drops as white space and across which neither its
    normalizer nor its pre-tokenizer joins anything, so the ids of the pieces are those of the text. Only for
    tokenizers that drop white space (as word_bpe_49k.json does); others need drops_space=False.
    """

    def __init__(self, path: str, drops_space: bool = True):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words = Words(self.tokenizer) if drops_space else None

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if self.words is None:
            found = self.tokenizer.encode_batch([x or "" for x in texts], add_special_tokens=False)
            return [np.array(x.ids, dtype="<u4").tobytes() for x in found]
        if len(self.words) > CACHE_WORDS:
            self.words = Words(self.tokenizer)
        get = self.words.__getitem__
        return [b"".join(map(get, (x or "").replace("\n", " ").split(" "))) for x in texts]


ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, drops_space: bool = True) -> Encoder:
    """One encoder for each worker process, kept between tasks."""
    common.claim("tokens", ENCODERS.clear)
    if (path, drops_space) not in ENCODERS:
        ENCODERS[path, drops_space] = Encoder(path, drops_space)
    return ENCODERS[path, drops_space]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
