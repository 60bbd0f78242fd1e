"""Words of whole texts as 64-bit hashes, cut out of Arrow buffers with numpy, many documents at a time."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer document is still handled whole, in a block of its own.
BLOCK_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


class Words(NamedTuple):
    """Hash of every word, in order, and where the words of each row begin (one entry more than rows)."""

    hashes: np.ndarray
    first: np.ndarray


def byte_table(separators: str) -> np.ndarray:
    """Code of every byte: 0 for a separator, otherwise the byte after lower-casing A-Z, plus 1 (UTF-8 has no 255)."""
    table = np.arange(256, dtype=np.uint16)
    table[65:91] += 32
    table = (table + 1).astype(np.uint8)
    table[[ord(c) for c in separators]] = 0
    return table


#: Words between ASCII white space, U+0009 to U+000D and U+0020.
SPACED = byte_table(" \t\n\x0b\f\r")
#: Words of ASCII letters and digits and everything beyond ASCII.
LETTERS = byte_table("".join(chr(i) for i in range(128) if not chr(i).isalnum()))


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every input bit over the whole 64-bit word."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(n, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def text_blocks(
    column: pa.Array, limit: int = BLOCK_BYTES, rows: int = 1 << 30
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cuts a string column into runs of whole rows of at most `limit` bytes (or one longer row) and `rows` rows. Yields first row, end
    row, the UTF-8 bytes and the offsets of the rows in them. NULL counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(column.buffers()[1], dtype=kind, count=n + column.offset + 1)[column.offset :].astype(np.int64)
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = min(at + rows, max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1))
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def words_of(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> Words:
    """The words of the rows whose bytes lie between the offsets; no word crosses the end of a row."""
    n = len(data)
    if not n:
        return Words(np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64))
    code = table[data]
    inside = np.zeros(n + 2, dtype=bool)
    inside[1:-1] = code != 0
    starts_row = np.zeros(n + 1, dtype=bool)
    starts_row[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | starts_row[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | starts_row[1:])) + 1
    up, down = _powers(n)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(code * up[:n], out=sums[1:])
    return Words(mix((sums[ends] - sums[starts]) * down[starts]), np.searchsorted(starts, offsets))


def rows_of(first: np.ndarray) -> np.ndarray:
    """Row of every word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for every (start, length), one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total) + np.repeat(starts - before, lengths)
