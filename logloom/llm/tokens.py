"""Token ids of texts: exact library results, with words that were seen before taken from a cache."""

from __future__ import annotations

import os
import re
import zlib

import numpy as np

END_ID = 0
CACHE_ENTRIES = 700_000
# How a byte-level vocabulary writes a space, and its splitting pattern spelled out for the
# letters, numbers and white space among the first 256 code points.
SPACE_MARK = "Ġ"
_L = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
_N = "0-9²³¹¼-¾"
_S = "\\t\\n\\x0b\\x0c\\r \x85\xa0"
LATIN_PIECES = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
)
SPACED_WORD = re.compile(f" [{_L}]+")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Encodes texts of one task with a byte-level BPE vocabulary file.

    Such a vocabulary cuts a text into pieces by a fixed pattern and merges bytes inside each piece only.
    The pieces of a text within the first 256 code points are found here; the library encodes each
    distinct piece once and its ids are remembered (at most about ``CACHE_ENTRIES`` pieces). Any other
    text, and one that spells a special token, goes to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        size = self.library.get_vocab_size()
        self.dtype = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.opens = np.array([(self.library.id_to_token(i) or "").startswith(SPACE_MARK) for i in range(size)])
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.end = np.array([END_ID], self.dtype).tobytes()
        self.known: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.dtype).tobytes() for e in found]

    def _learn(self, pieces: set[str]) -> None:
        words = [p for p in pieces if SPACED_WORD.fullmatch(p)]
        rest = list(pieces.difference(words))
        self.known.update(zip(rest, self._library(rest)))
        if not words:
            return
        # Words after single spaces are encoded in one text: each begins at a token that opens with a space.
        ids = np.array(self.library.encode_batch_fast(["".join(words)], add_special_tokens=False)[0].ids, self.dtype)
        width, raw = self.dtype.itemsize, ids.tobytes()
        cuts = (np.append(np.flatnonzero(self.opens[ids]), len(ids)) * width).tolist()
        if len(cuts) != len(words) + 1:
            raise ValueError("the vocabulary does not cut at single spaces")
        self.known.update(zip(words, [raw[a:b] for a, b in zip(cuts, cuts[1:])]))

    def _pieces(self, text: str) -> list[str] | None:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return None
        return None if any(s in text for s in self.special) else LATIN_PIECES.findall(text)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text (none for NULL), each followed by ``END_ID``."""
        texts = ["" if t is None else t for t in texts]
        if len(self.known) > CACHE_ENTRIES:
            self.known.clear()
        cut = [self._pieces(t) for t in texts]
        unseen = set().union(*[c for c in cut if c]).difference(self.known)
        if unseen:
            self._learn(unseen)
        whole = [i for i, c in enumerate(cut) if c is None]
        ids = dict(zip(whole, self._library([texts[i] for i in whole]))) if whole else {}
        get, out = self.known.__getitem__, []
        for i, c in enumerate(cut):
            raw = ids[i] if c is None else b"".join(map(get, c))
            out.append(np.frombuffer(raw + self.end, self.dtype))
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this Python worker; its cache serves all tasks that the worker runs."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def ids_crc32(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())
