"""Token ids of whole texts by a public tokenizer file, word by word with a bounded memory of words.

A byte-level BPE never merges across a single space between two other characters, so the ids of a text are the ids of
its space-separated words, end to end.  Words come from the tokenizers library once and are then remembered; a text in
which a space stands next to other white space goes through the library whole.
"""

from __future__ import annotations

import gc
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Words remembered by one Python worker, some 130 MB; beyond this only short ones stay.
WORDS_KEPT = 700_000
SHORT = 7


def tokenizer_path(name: str) -> str:
    """Where the public vocabulary file ``name`` lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_SIGNS = r"!-&(-/:-@\[-`{-~"
#: A word of letters, signs other than the apostrophe and single line ends before a letter; the tokenizer's own rule
#: parts it at every change between these kinds.
_PLAIN = re.compile(f"[{_LETTERS}]+(?:[{_SIGNS}]+|\\n[{_LETTERS}]+)*")
_PARTS = re.compile(f"[{_LETTERS}]+|[{_SIGNS}]+|\\n")
#: A word that the tokenizer's rule doesn't part any further.
_WORD = re.compile(f"[{_LETTERS}]+|[{_SIGNS}]+")
#: Byte alphabet of byte-level models: printable Latin-1 characters stand for themselves, other bytes for U+0100 on.
_ITSELF = [*range(33, 127), *range(161, 173), *range(174, 256)]
_ALPHABET = {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)) - set(_ITSELF)))}


class Encoder:
    def __init__(self, name: str = "byte_bpe_50k.json", most: int | None = None):
        self.most = most or WORDS_KEPT
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(tokenizer_path(name) if os.sep not in name else name)
        self.vocabulary = self.library.get_vocab_size()
        self.dtype = np.dtype("<u2" if self.vocabulary <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.direct = self._agrees()
        self.one = [int(k).to_bytes(self.dtype.itemsize, "little") for k in range(self.vocabulary)]
        self.heads: dict[str, bytes | bool] = {}
        self.tails: dict[str, bytes] = {}
        self.known: dict[str, bytes | bool] = {}  # False: to be seen with its neighbours

    def _learn(self, new: set[str]) -> None:
        """Remember the ids of these words with a blank in front, built from those of their parts where these are plain."""
        known = self.known
        if len(known) + len(new) > self.most:  # short words come back most
            kept = {w: ids for w, ids in known.items() if len(w) < SHORT}
            self.known = known = kept if len(kept) < self.most // 2 else {}
        plain = {w for w in new if _WORD.fullmatch(w)}
        apart = [(w, _PARTS.findall(w)) for w in new.difference(plain) if _PLAIN.fullmatch(w)]
        odd = [" " + w for w in new.difference(plain, (w for w, _ in apart))]
        plain.update([ps[0] for _, ps in apart])
        plain.difference_update(known.keys() & plain)
        tails = self.tails
        rest = {p for _, ps in apart for p in ps[1:]}.difference(tails)
        if len(tails) + len(rest) > self.most:
            tails.clear()
            rest = {p for _, ps in apart for p in ps[1:]}
        if self.direct:
            tokenize, one, blank = self.library.model.tokenize, self.one, _ALPHABET[32]
            for word in plain:  # letters and signs of ASCII stand for themselves in the byte alphabet
                ids = tokenize(blank + (word if word.isascii() else word.encode().decode("latin-1").translate(_ALPHABET)))
                known[word] = one[ids[0].id] if len(ids) == 1 else b"".join([one[t.id] for t in ids])
            for part in rest:
                tails[part] = b"".join([one[t.id] for t in tokenize(part.encode().decode("latin-1").translate(_ALPHABET))])
        else:
            for word in plain:
                known[word] = self._whole(" " + word)
            for part in rest:
                tails[part] = self._whole(part)
        for word, got in zip(odd, self.library.encode_batch_fast(odd, add_special_tokens=False), strict=True):
            # white space next to a blank has to be seen with its neighbours
            known[word[1:]] = False if word[-1].isspace() or word[1].isspace() else array(self.code, got.ids).tobytes()
        for word, ps in apart:
            known[word] = known[ps[0]] + b"".join([tails[p] for p in ps[1:]])

    def _agrees(self) -> bool:
        """Whether the library's model, given a plain part in the byte alphabet, finds what the library finds."""
        probes = [" the", "word", "Straße", " éléphants", "...", "$%&", "\n"]
        try:
            return all([t.id for t in self.library.model.tokenize(w.encode().decode("latin-1").translate(_ALPHABET))] == self.library.encode(w, add_special_tokens=False).ids for w in probes)
        except Exception:  # another kind of model
            return False

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text; a None is an empty text."""
        for ids in self.encode_bytes(texts):
            yield np.frombuffer(ids, self.dtype)

    def encode_bytes(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text as little-endian bytes."""
        if not gc.isenabled():
            yield from self._encode(texts)
            return
        gc.disable()  # millions of small objects, none of them in cycles
        try:
            yield from self._encode(texts)
        finally:
            gc.enable()

    def _encode(self, texts: list[str | None]) -> Iterator[bytes]:
        cut = [t.split(" ") if t else [] for t in texts]
        new: set[str] = set()
        for units in cut:
            new.update(units[1:])
        new.discard("")
        self._learn(new.difference(self.known))
        known = self.known
        known[""] = False  # two blanks
        for text, units in zip(texts, cut, strict=True):
            if not units:
                yield b""
                continue
            try:
                yield self._head(units[0]) + b"".join(map(known.__getitem__, units[1:]))
            except KeyError:  # the memory was begun anew for this batch
                self._learn(set(units[1:]).difference(known, ("",)))
                got = [known.get(w, False) for w in units[1:]]
                yield self._whole(text) if False in got or self._head(units[0]) is False else self._head(units[0]) + b"".join(got)
            except TypeError:  # a word that has to be seen with its neighbours
                yield self._whole(text)

    def _head(self, word: str) -> bytes | bool:
        """The ids of a text's first word, which has no blank in front."""
        if word not in self.heads:
            if len(self.heads) > 10_000:
                self.heads.clear()
            self.heads[word] = False if word != "" and word[-1].isspace() else self._whole(word) if word else b""
        return self.heads[word]

    def _whole(self, text: str) -> bytes:
        return array(self.code, self.library.encode(text, add_special_tokens=False).ids).tobytes()


_encoders: dict[tuple[str, int | None], Encoder] = {}


def encoder(name: str, most: int | None = None) -> Encoder:
    """This worker's encoder; ``most`` words are remembered, else ``WORDS_KEPT``."""
    if (name, most) not in _encoders:
        _encoders[name, most] = Encoder(name, most)
    return _encoders[name, most]


def vocabulary_size(name: str = "byte_bpe_50k.json") -> int:
    return encoder(name).vocabulary


def texts_of(column: pa.Array, at_once: int = 1024) -> Iterator[tuple[int, list[str]]]:
    """Texts of a column, many at a time, with the row of the first."""
    for k in range(0, len(column), at_once):
        yield k, column.slice(k, at_once).to_pylist()
