"""Words and texts as bytes.

All word rules of these operators are ASCII rules, so they hold byte by byte in
UTF-8: a byte of 0x80 and above always belongs to a code point outside ASCII.
"""

import re

import numpy as np
import pyarrow as pa
import xxhash

from prefboard.functions.portions import portions as column_portions

_LOWERED = bytes(range(256)).lower()
_WORD = set(b"0123456789abcdefghijklmnopqrstuvwxyz") | set(range(0x80, 0x100))
#: A-Z lower-cased, everything outside `[^\x00-\x2F\x3A-\x60\x7B-\x7F]` a space.
_ALNUM = bytes(b if b in _WORD else 0x20 for b in _LOWERED)
#: The same, with line feeds kept.
_ALNUM_LINES = _ALNUM[:10] + b"\n" + _ALNUM[11:]
#: A-Z lower-cased, `[\x09-\x0D]` a space.
_SPACED = bytes(0x20 if 9 <= b <= 13 else b for b in _LOWERED)
_RUN = re.compile(rb"[^ ]+")


def as_bytes(column: pa.Array) -> list:
    """The texts of an Arrow column as UTF-8; null as an empty text."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def each_as_bytes(column: pa.Array):
    """`as_bytes` in turn; only a portion of the column is turned into them at a time."""
    for values in bytes_by_portions(column):
        yield from values


def bytes_by_portions(column: pa.Array):
    """Lists of `as_bytes`, of about 2 MB each."""
    for (values,) in column_portions(column.cast(pa.binary())):
        yield [b"" if x is None else x for x in values]


def spaced_words(text: bytes) -> list:
    """Lower-cased (A-Z) words `[^\\x20\\x09-\\x0D]+`."""
    return text.lower().split()


def alnum_words(text: bytes) -> list:
    """Lower-cased (A-Z) words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`."""
    return text.translate(_ALNUM).split()


def alnum_places(text: bytes) -> list:
    """`(first byte, last + 1)` of each of `alnum_words`."""
    return [m.span() for m in _RUN.finditer(text.translate(_ALNUM))]


def alnum_text(text: bytes) -> bytes:
    """The text with words as in `alnum_words`; spaces and line feeds between them."""
    return text.translate(_ALNUM_LINES)


#: Lookup tables of the operators in this Python worker.
_tables = []


def lookup_table(table):
    """`table`, known to `in_use`."""
    _tables.append(table)
    return table


def in_use(table):
    """`table`, with the others emptied: a worker that serves several operators in
    turn holds the table of one."""
    for other in _tables:
        if other is not table and other:
            other.clear()
    return table


class _WordHashes(dict):
    """64-bit hash of each word; holds a bounded number of words."""

    MAX = 100_000

    def __missing__(self, word):
        if len(self) >= self.MAX:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = lookup_table(_WordHashes())


def word_hashes(words: list) -> np.ndarray:
    """64-bit hashes of words, in their order."""
    return np.fromiter(map(in_use(_hashes).__getitem__, words), np.uint64, len(words))


#: Words of more bytes are hashed one by one.
_LONG = 64
_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Numbers of 64 bits, one to one and in no order (splitmix64)."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


#: Sets words of different lengths apart.
_LENGTHS = _mixed(np.arange(1, _LONG + 2, dtype=np.uint64))


def hashed_spaced_words(texts: list):
    """64-bit hashes of all `spaced_words` in their order, and how many each text has.

    They are made of eight bytes at a time, of all words at once; they are not those
    of `word_hashes`.
    """
    body = b" " + b" ".join(texts).translate(_SPACED) + b" " * 8
    data = np.frombuffer(body, np.uint8)
    space = data == 0x20
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    eights = np.ndarray(len(body) - 7, "<u8", body, strides=(1,))
    out = _mixed(_LENGTHS[np.minimum(lengths, _LONG)] ^ eights[starts] & _FIRST_BYTES[np.minimum(lengths, 8)])
    more = np.flatnonzero((lengths > 8) & (lengths <= _LONG))
    for at in range(8, _LONG, 8):
        more = more[lengths[more] > at]
        out[more] = _mixed(out[more] ^ eights[starts[more] + at] & _FIRST_BYTES[np.minimum(lengths[more] - at, 8)])
    for word in np.flatnonzero(lengths > _LONG):
        out[word] = xxhash.xxh3_64_intdigest(body[starts[word] : starts[word] + lengths[word]])
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    return out, np.diff(np.searchsorted(starts, ends), prepend=0)


def portions(values: list, size=2 << 20):
    """`(first, last + 1)` of consecutive texts with about `size` bytes together."""
    start, total = 0, 0
    for at, value in enumerate(values):
        total += len(value)
        if total >= size:
            yield start, at + 1
            start, total = at + 1, 0
    if start < len(values):
        yield start, len(values)


def unused_name(name: str, columns) -> str:
    """`name`, with underscores before it until no column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name
