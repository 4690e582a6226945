"""Words of many texts as arrays, for work in numpy."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash

_SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
_ODD = 0xD6E8FEB86659FD93


#: Words of more bytes are hashed by XXH3: long strings can be made that a polynomial modulo 2**64 takes for equal.
LONG_WORD = 256
#: Letters that are hashed at a time, about.
_CHUNK = 1 << 18


def _powers() -> np.ndarray:
    out = np.full(LONG_WORD + 1, _ODD, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


_POWER = _powers()


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """``hashes`` of all words in order; the text of each, and where its text's words start and end among all."""

    hashes: np.ndarray
    per_text: np.ndarray
    text_of_word: np.ndarray
    start_of_word: np.ndarray
    end_of_word: np.ndarray


def _word_hashes(letters: np.ndarray, lengths: np.ndarray, total: np.ndarray, a: int, b: int) -> np.ndarray:
    """Hashes of the words from the a-th to the one before the b-th; their temporary arrays are many times their letters."""
    n = lengths[a:b]
    from_ = int(total[a] - lengths[a])
    first = total[a:b] - n - from_
    place = np.minimum(np.arange(int(n.sum())) - np.repeat(first, n), LONG_WORD)
    with np.errstate(over="ignore"):
        terms = (letters[from_ : int(total[b - 1])].astype(np.uint64) + np.uint64(1)) * _POWER[place]
        return mixed(np.add.reduceat(terms, first) + n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def hashed_words(texts: list[str | None]) -> Words:
    """64-bit hashes of words (runs of characters other than ASCII white space)."""
    encoded = [(t or "").encode() + b" " for t in texts]
    data = np.frombuffer(b"".join(encoded), np.uint8)
    sizes = np.array([len(e) for e in encoded], np.int64)
    space = _SPACE[data]
    begins = np.flatnonzero(~space & np.append(True, space[:-1])[: len(data)])
    ends = np.flatnonzero(space & np.append(False, ~space[:-1])[: len(data)])
    text = np.searchsorted(np.cumsum(sizes), begins, "right")
    per_text = np.bincount(text, minlength=len(texts)).astype(np.int64)
    lengths = ends - begins
    hashes = np.zeros(0, np.uint64)
    if len(begins):
        letters, total = data[~space], np.cumsum(lengths)
        parts = [0, *(np.searchsorted(total, np.arange(_CHUNK, int(total[-1]), _CHUNK)) + 1).tolist(), len(lengths)]
        hashes = np.concatenate([_word_hashes(letters, lengths, total, a, b) for a, b in zip(parts, parts[1:]) if b > a])
        for i in np.flatnonzero(lengths > LONG_WORD).tolist():
            hashes[i] = xxhash.xxh3_64_intdigest(data[begins[i] : ends[i]].tobytes())
    last = np.cumsum(per_text)
    return Words(hashes, per_text, text, (last - per_text)[text], last[text])


def slices(batches: Iterator[pa.RecordBatch], most_bytes: int = 4_000_000, text: str = "text") -> Iterator[pa.RecordBatch]:
    """Parts of batches of a bounded number of bytes of text, or of one text."""
    for batch in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes) // most_bytes
        edges = np.concatenate(([0], np.flatnonzero(np.diff(group)) + 1, [batch.num_rows])).tolist()
        for a, b in zip(edges, edges[1:]):
            if b > a:
                yield batch.slice(a, b - a)
