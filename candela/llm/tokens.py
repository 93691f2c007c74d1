"""Token ids of whole texts from vocabulary files of public tokenizers (never trained here)."""

from __future__ import annotations

import base64
import re
from functools import partial

import numpy as np

_WIDE = re.compile(r"\s ")
_KEEP = 100_000
# Fixed value: the special token of the 50k byte-level vocabulary and its id (the rank file has none).
SPECIAL = ("<|endoftext|>", 50256)


def vocabulary(name: str) -> str:
    """The path of a public vocabulary file; a path is returned as it is."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class _Cache(dict):
    """Ids of space-led chunks, as bytes; emptied when full."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, chunk: str) -> bytes:
        out = np.array(self.encode(" " + chunk), "<u4").tobytes()
        if len(chunk) <= 40:
            if len(self) >= _KEEP:
                self.clear()
            self[chunk] = out
        return out


class ByteBpe:
    """Byte-level BPE. ``encode`` gives little-endian unsigned 32-bit ids as bytes.

    The pre-tokeniser never joins what stands before a single space to what follows, so the chunks
    between such spaces are encoded on their own and remembered; other texts are encoded whole. Where a text has the
    string of a special token, that token's id stands for it and the parts around it are encoded apart, as the
    ``tokenizers`` form of the vocabulary does.
    """

    def __init__(self, name: str = "byte_bpe_50k.tiktoken", special: tuple[str, int] | None = SPECIAL):
        import public_tokenizers
        import tiktoken

        with open(vocabulary(name), "rb") as f:
            ranks = self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=dict([SPECIAL]))
        self.whole = own.encode_ordinary
        self._array = partial(own.encode_to_numpy, allowed_special=set(), disallowed_special=())  # the same ids without a list
        self.cache = _Cache(self.whole)
        self.mark, self.mark_id = (special[0], np.array([special[1]], "<u4").tobytes()) if special else (None, b"")

    def encode(self, text: str) -> bytes:
        if self.mark and self.mark in text:
            return self.mark_id.join(map(self._plain, text.split(self.mark)))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        if _WIDE.search(text) or text[:1] == " ":
            return np.array(self.whole(text), "<u4").tobytes()
        first, *rest = text.split(" ")
        return np.array(self.whole(first), "<u4").tobytes() + b"".join(map(self.cache.__getitem__, rest))

    def encode_whole(self, text: str) -> np.ndarray:
        """The ids of a text in one call, nothing remembered: faster where most chunks are seen once."""
        if self.mark and self.mark in text:
            return np.frombuffer(self.mark_id.join(self._array(x).astype("<u4").tobytes() for x in text.split(self.mark)), "<u4")
        return self._array(text).astype("<u4", copy=False)

    def token_bytes(self) -> list[bytes]:
        """The bytes of every id, in order of the ids."""
        return [x for x, _ in sorted(self.ranks.items(), key=lambda kv: kv[1])]


class PieceBpe:
    """Sentence pieces with byte fallback; words are encoded on their own and remembered."""

    def __init__(self, name: str = "piece_bpe_32k.model"):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=vocabulary(name))
        self.size = self.model.GetPieceSize()
        self.is_byte = np.array([self.model.IsByte(i) for i in range(self.model.GetPieceSize())])
        self.cache: dict[bytes, bytes] = {}

    def word(self, word: bytes) -> bytes:
        out = self.cache.get(word)
        if out is None:
            out = np.array(self.model.encode(word.decode()), "<i4").tobytes()
            if len(word) <= 60:
                if len(self.cache) >= _KEEP:
                    self.cache.clear()
                self.cache[word] = out
        return out

    def encode_words(self, words: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.word, words)), "<i4")

    def encode_text(self, text: str) -> np.ndarray:
        """The ids of a whole text."""
        return np.array(self.model.encode(text), "<u4")

    def token_bytes(self) -> list[bytes]:
        """The bytes of every id: its piece with U+2581 as space, <0xHH> as that byte, control ids as nothing."""
        out = []
        for i in range(self.model.GetPieceSize()):
            piece = self.model.IdToPiece(i)
            out.append(bytes([int(piece[3:5], 16)]) if self.is_byte[i] else b"" if self.model.IsControl(i) else piece.replace("\u2581", " ").encode())
        return out
