"""Token ids of whole texts by the tokenizers library, one distinct word at a time.

The vocabulary's pre-tokenizer never lets a piece hold white space, so a text's ids are the
concatenation of the ids of its runs between ASCII white space. Each distinct run is encoded
once and remembered by the worker, in two generations of ``CACHE`` bytes (or as asked) at most: when the
young one is full it becomes the old one, and what the old one held goes. In a run of Latin letters and signs the pre-tokenizer's pieces are its runs of letters
and of others; their normalised forms go straight to the library's BPE model. All other runs
take the whole library path, special tokens included.
"""

from __future__ import annotations

import os
import re
import sys
import unicodedata
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ._words import LOWER, SPACE, raw

CACHE = 12 << 20
_ENTRY = 200  # bytes of two small byte strings and a slot, beside their content
assert array("I").itemsize == 4 and sys.byteorder == "little"

#: Without digits, apostrophes and rarer characters only two rules cut: letters, and runs of others.
_PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ!-&(-/:-@\\[-`{-~]+")
_PIECE = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+|[^A-Za-zÀ-ÖØ-öø-ÿ]+")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """The public byte-level alphabet: printable bytes stand for themselves, others from U+0100 on."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {b: chr(b) for b in keep} | {b: chr(256 + k) for k, b in enumerate(rest)}


def _part_stops(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A space before each stop or comma between a Latin letter and white space: it is a piece of its own."""
    at = np.flatnonzero((buf == 0x2E) | (buf == 0x2C))
    at = at[at >= 2]
    one, two = buf[at - 1], buf[at - 2]
    letter = (one >= 0x61) & (one <= 0x7A) | (two == 0xC3) & (one >= 0x80) & (one != 0x97) & (one != 0xB7)
    last = np.zeros(len(buf) + 1, bool)
    last[:-1] = SPACE[buf]
    last[offs] = True
    at = at[letter & last[at + 1]]
    return np.insert(buf, at, 0x20), offs + np.searchsorted(at, offs)


class WordEncoder(dict):
    """bytes of a run -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, most: int = CACHE):
        super().__init__()
        self.most = most
        self.old: dict[bytes, bytes] = {}
        self.held = 0
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.bpe = self.library.model.tokenize
        self.letters = [_byte_letters()[b] for b in range(256)]

    def __missing__(self, run: bytes) -> bytes:
        out = self.old.get(run)
        if out is None:
            out = self._encode(run)
        self.held += _ENTRY + len(run) + len(out)
        if self.held > self.most:
            self.old = dict(self)
            self.clear()
            self.held = 0
        self[run] = out
        return out

    def _encode(self, run: bytes) -> bytes:
        if run.isalpha() and run.islower():  # ASCII letters
            out = array("I", [t.id for t in self.bpe(run.decode())]).tobytes()
        else:
            text = run.decode("utf-8", "replace")
            if "<|" not in text and _PLAIN.fullmatch(text):
                pieces = _PIECE.findall(text)
                out = self._piece(text) if len(pieces) == 1 else b"".join([self[x.encode()] for x in pieces])
            else:
                out = array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()
        return out

    def _piece(self, piece: str) -> bytes:
        form = unicodedata.normalize("NFC", piece).lower()
        return array("I", [t.id for t in self.bpe("".join(map(self.letters.__getitem__, form.encode())))]).tobytes()

    def ids(self, text: bytes) -> bytes:
        """The ids of one text."""
        return self.column(pa.array([text], pa.large_binary()))[0].tobytes()

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids one after another, offsets of each text's ids); null counts as empty."""
        buf, offs = raw(texts)
        buf, offs = buf[offs[0] : offs[-1]], offs - offs[0]
        if b"<|" not in buf.tobytes():  # the vocabulary folds case; only special tokens are cased
            buf = LOWER[buf]
        buf, offs = _part_stops(buf, offs)
        lower = pa.Array.from_buffers(pa.large_string(), len(offs) - 1, [None, pa.py_buffer(offs), pa.py_buffer(buf)])
        runs = pc.ascii_split_whitespace(lower)
        coded = runs.flatten().dictionary_encode()
        words, cuts = raw(coded.dictionary)
        flat, cuts = words.tobytes(), cuts.tolist()
        known = [self[flat[a:b]] for a, b in zip(cuts, cuts[1:])]
        size = np.fromiter(map(len, known), np.int64, len(known)) >> 2
        table, at = np.frombuffer(b"".join(known), "<u4"), np.concatenate([[0], np.cumsum(size)])
        codes = coded.indices.to_numpy(zero_copy_only=False)
        ends = np.cumsum(size[codes])
        begins = ends - size[codes]
        ids = table[np.repeat(at[codes] - begins, size[codes]) + np.arange(ends[-1] if len(ends) else 0)]
        offs = runs.offsets.to_numpy() - runs.offsets[0].as_py()
        return ids, np.concatenate([[0], ends])[offs]


@lru_cache(maxsize=2)
def encoder(path: str, most: int = CACHE) -> WordEncoder:
    """The worker's encoder; it outlives a task where Python workers are reused."""
    return WordEncoder(path, most)
