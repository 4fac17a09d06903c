"""Token ids of whole texts by public tokenizers, each distinct chunk encoded once.

Texts are cut where the tokenizer always cuts them, equal chunks of a slab of ``SLAB``
bytes are found by Arrow's dictionary encoding, and a worker remembers the ids of about
``REMEMBERED`` chunks. The ids are those of the whole text: ``words``, ``space_cuts`` and
``byte_cuts`` say why. A text is never shortened; one without a cut is one chunk.

The tokenizers' files are parameters; workers read them from the path they are given.
"""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa

from linkweave.llm import common

SLAB = 4 << 20
REMEMBERED = 400_000
AT_ONCE = 4096

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
#: ASCII besides letters, white space and the apostrophe, which starts endings such as 's.
_SIGN = np.zeros(256, bool)
_SIGN[:128] = True
_SIGN &= ~_LETTER & ~common.IS_SPACE
_SIGN[0x27] = False
#: Bytes that may begin a character which is white space to the byte-level tokenizer.
_MAYBE_SPACE = np.zeros(256, bool)
_MAYBE_SPACE[:0x21] = True
_MAYBE_SPACE[[0x7F, 0xC2, 0xE1, 0xE2, 0xE3, 0xEF]] = True

_LOADED: dict = {}


def file_of(name: str) -> str:
    """Where an installed vocabulary lies; the default of the operators' path parameters."""
    import public_tokenizers

    return public_tokenizers.path(name)


def loaded(kind: str, path: str):
    """A tokenizer, read once in each worker: ``word``, ``bare``, ``byte`` or ``piece``."""
    if (kind, path) not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task
        if kind == "piece":
            import sentencepiece

            _LOADED[kind, path] = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            from tokenizers import Tokenizer, normalizers, pre_tokenizers

            t = Tokenizer.from_file(path)
            if kind == "byte":
                t.encode_special_tokens = True
            if kind == "bare":  # for words that are normal already
                t.normalizer = normalizers.Sequence([])
                t.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            _LOADED[kind, path] = t
    return _LOADED[kind, path]


def batch(tokenizer, texts: list[str]) -> list[list[int]]:
    """Ids of texts; their encodings, many times larger, exist for ``AT_ONCE`` texts at a time."""
    out: list[list[int]] = []
    for k in range(0, len(texts), AT_ONCE):
        out += [e.ids for e in tokenizer.encode_batch_fast(texts[k : k + AT_ONCE], add_special_tokens=False)]
    return out


def _plain(chunks: list[bytes], space: bool = False) -> np.ndarray:
    """Which chunks are letters of ASCII and Latin-1 only, after one space if ``space``."""
    if not chunks:
        return np.zeros(0, bool)
    data = np.frombuffer(b"".join(chunks), np.uint8)
    size = np.fromiter(map(len, chunks), np.int64, len(chunks))
    first = np.cumsum(size) - size
    fits = letters(data)
    if space:
        fits[first[size > 1]] |= data[first[size > 1]] == 0x20
    return np.logical_and.reduceat(fits, first)


def _in_two(chunks: list[bytes], plain: np.ndarray, kind: str, path: str) -> list[list[int]]:
    """Ids of chunks; plain ones are one word each and need no look for words."""
    out: list = [None] * len(chunks)
    for which, places in (("bare", np.flatnonzero(plain)), (kind, np.flatnonzero(~plain))):
        texts = [chunks[k].decode("utf-8", "replace") for k in places.tolist()]
        if texts:
            for k, ids in zip(places.tolist(), batch(loaded(which, path), texts), strict=True):
                out[k] = ids
    return out


def word_ids(path: str, chunks: list[bytes]) -> list[list[int]]:
    """Ids of chunks of ``words`` by the word tokenizer."""
    return _in_two(chunks, _plain(chunks), "word", path)


def byte_ids(path: str, chunks: list[bytes]) -> list[list[int]]:
    """Ids by the byte-level tokenizer, the strings of special tokens as plain text."""
    return _in_two(chunks, _plain(chunks, True), "byte", path)


def piece_ids(path: str, texts: list[str]) -> list[list[int]]:
    """Ids by the piece model, which puts a space before each text."""
    return loaded("piece", path).encode(texts, num_threads=1) if texts else []


def letters(data: np.ndarray) -> np.ndarray:
    """Bytes of ASCII letters and of the letters of Latin-1 (C3 xx besides D7 and F7)."""
    out = _LETTER[data]
    pair = np.flatnonzero(data[:-1] == 0xC3) if len(data) > 1 else np.zeros(0, np.int64)
    pair = pair[(data[pair + 1] != 0x97) & (data[pair + 1] != 0xB7)]
    out[pair] = out[pair + 1] = True
    return out


def _sign_cuts(data: np.ndarray, letter: np.ndarray) -> np.ndarray:
    """Where a letter and a sign meet, for the places 1 to n - 1."""
    sign = _SIGN[data]
    return (letter[:-1] & sign[1:]) | (sign[:-1] & letter[1:])


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``data, offsets, cuts`` of texts for the word tokenizer, without white space.

    It always cuts after white space and where a letter meets a sign: white space is
    dropped, letters and signs never share a word, and one side is ASCII, so no character
    is composed of both sides. It makes letters small; those of ASCII and Latin-1 are here.
    """
    n = len(data)
    data, space = common.LOWER[data], common.IS_SPACE[data]
    letter = letters(data)
    pair = np.flatnonzero(data[:-1] == 0xC3) if n > 1 else np.zeros(0, np.int64)
    high = data[pair + 1]
    data[pair[(high < 0x9F) & (high != 0x97)] + 1] += 0x20
    cut = np.zeros(n + 1, bool)
    cut[1:n] = (space[:-1] & ~space[1:]) | _sign_cuts(data, letter)
    cut[offsets] = True
    place = np.concatenate([[0], np.cumsum(~space)])
    cuts = place[cut]
    return data[~space], place[offsets], cuts[np.append(True, cuts[1:] != cuts[:-1])]


def space_cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places where byte-level and piece tokenizers both cut, each text's start first.

    They come before a single space, when a character that is no white space follows: the
    byte-level pattern begins a word there, and no piece holds a space that follows
    anything but spaces. Every chunk of a text that starts with a space does so too.
    """
    n = len(data)
    cut = np.zeros(n + 1, bool)
    cut[1 : n - 1] = (data[1:-1] == 0x20) & (data[:-2] != 0x20) & ~_MAYBE_SPACE[data[2:]]
    cut[offsets] = True
    return np.flatnonzero(cut)


def byte_cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """``space_cuts`` and where a letter meets a sign, which the byte-level pattern parts."""
    cut = np.zeros(len(data) + 1, bool)
    cut[space_cuts(data, offsets)] = True
    cut[1 : len(data)] |= _sign_cuts(data, letters(data))
    return np.flatnonzero(cut)


class Memo:
    """``encode`` of byte chunks, each distinct one once as long as it is remembered."""

    def __init__(self, encode: Callable[[list[bytes]], list], room: int = REMEMBERED):
        self.encode, self.room, self.known = encode, room, {}

    def __call__(self, data: np.ndarray, cuts: np.ndarray) -> tuple[list, np.ndarray]:
        """``found, codes``: what ``encode`` gave for distinct chunks; each chunk's place there."""
        chunks = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(data)]
        ).dictionary_encode()
        values = chunks.dictionary.to_pylist()
        if len(self.known) > self.room:  # what this slab needs stays
            self.known = {v: self.known[v] for v in values if v in self.known}
        new = [v for v in values if v not in self.known]
        self.known.update(zip(new, self.encode(new), strict=True))
        return [self.known[v] for v in values], chunks.indices.to_numpy()


def release() -> None:
    """Gives memory that Python and Arrow have freed back to the system.

    A worker outlives its task; what it once needed would stay with it while the workers of
    a later stage run beside it.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def packed(ids: list[list[int]]) -> list[bytes]:
    """Lists of ids as little-endian unsigned 32-bit numbers."""
    lengths = np.fromiter(map(len, ids), np.int64, len(ids))
    flat = np.fromiter(chain.from_iterable(ids), "<u4", int(lengths.sum())).tobytes()
    ends = np.cumsum(lengths) * 4
    return [flat[e - 4 * n : e] for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]


def gather(parts: list[bytes], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``ids, lengths``: the ids of all chunks in order and how many each has."""
    size = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
    flat = np.frombuffer(b"".join(parts), "<u4")
    first = np.cumsum(size) - size
    lengths = size[codes]
    before = np.cumsum(lengths) - lengths
    at = np.repeat(first[codes] - before, lengths) + np.arange(int(lengths.sum()))
    return flat[at], lengths
