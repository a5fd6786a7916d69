"""Words, word hashes and shingles of many texts at once, in numpy.

A word's hash takes eight of its bytes at a time into two mixed states, for all words at
once, so that only very long words become Python objects. Texts are handled as UTF-8;
every class of separators used here lies below 0x80, so cutting bytes is cutting characters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import exact, others, packed, ready, unpacked

GROUP_BYTES = 4 << 20
#: Words of more bytes are hashed one by one.
LONG_WORD = 64
#: Text of the rows that are computed and sent back at once, so that memory follows this and not a batch's rows.
PART_BYTES = 8 << 20
_U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def stream(n: int, seed: int) -> np.ndarray:
    """n reproducible 64-bit words."""
    return mixed((np.arange(1, n + 1, dtype=_U) + _U(seed) * _U(1 << 32)) * _U(0x9E3779B97F4A7C15))


def byte_class(chars: bytes, from_0x80: bool = False) -> np.ndarray:
    """Which of the 256 bytes are in a class."""
    out = np.zeros(256, bool)
    out[list(chars)] = True
    out[128:] |= from_0x80
    return out


#: Words are what stands between space, tab, and the line and page breaks of ASCII.
SPACED = ~byte_class(b" \t\n\x0b\x0c\r")
#: Words are runs of ASCII letters and digits and of all characters beyond ASCII.
ALNUM = byte_class(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", True)

_PLACES = stream(64, 2) | _U(1)
_ODD = stream(4, 3) | _U(1)


class Words(NamedTuple):
    data: np.ndarray  # the texts' bytes, a newline after each
    begins: np.ndarray  # where each text begins in data, and the length of data at the end
    starts: np.ndarray  # of words, in data
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray  # first word of each text, and the number of words at the end


def _hashes(buffer: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits for each word of a buffer that has eight bytes after the last word.

    Both states pass through mixed() with each eight bytes, so words collide only as
    random numbers do, whatever regular pattern they are made of.
    """
    eights = np.ndarray((len(buffer) - 7,), "<u8", buffer, strides=(1,))
    size = (ends - starts).astype(_U)
    a, b = size * _ODD[0], mixed(size + _ODD[1])
    live = np.arange(len(starts))
    for done in range(0, LONG_WORD, 8):
        live = live[size[live] > _U(done)]
        if not len(live):
            break
        left = size[live] - _U(done)
        x = eights[starts[live] + done]
        short = left < _U(8)
        x[short] &= (_U(1) << (left[short] * _U(8))) - _U(1)
        a[live] = mixed(a[live] ^ x)
        b[live] = mixed((b[live] + x) * _ODD[2])
    out = mixed(a ^ (b * _ODD[3]))
    for i in np.flatnonzero(size > _U(LONG_WORD)):
        out[i] = int.from_bytes(hashlib.blake2b(buffer[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return out


def words(texts: list[bytes], word: np.ndarray, fold: bool) -> Words:
    """All words of some texts. fold: A-Z count as a-z in the hashes."""
    buffer = b"\n".join(texts) + b"\n" + bytes(8)
    data = np.frombuffer(buffer, np.uint8)[:-8]
    begins = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=begins[1:])
    inside = word[data]
    turns = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        turns = np.concatenate(([0], turns))
    starts, ends = turns[0::2], turns[1::2]
    hashes = _hashes(buffer.lower() if fold else buffer, starts, ends)  # of bytes, lower() changes A-Z alone
    return Words(data, begins, starts, ends, hashes, np.searchsorted(starts, begins))


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each word on, as far as there are k."""
    n = max(0, len(hashes) - k + 1)
    out = np.full(n, k, _U)
    for i in range(k):
        out += mixed(hashes[i : i + n] * _PLACES[i % 64] + _U(i))
    return mixed(out)


def sums_by_text(flags: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """How many flags are set between neighbours of begins."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[begins[1:]] - total[begins[:-1]]


def grouped(texts: list[bytes], limit: int = GROUP_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Neighbouring texts of together at most limit bytes, or one longer text; with the first's index."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield first, texts[first:i]
            first, size = i, 0
        size += len(t) + 1
    if first < len(texts):
        yield first, texts[first:]


def parts_of(batch: pa.RecordBatch, limit: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of a batch's rows whose last column has at most limit bytes, or one longer row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False)
    ends, first = np.cumsum(sizes, dtype=np.int64), 0
    while first < len(sizes):
        done = int(ends[first - 1]) if first else 0
        after = max(first + 1, int(np.searchsorted(ends, done + limit, "right")))
        yield batch.slice(first, after - first)
        first = after


def with_columns_from_text(df: DataFrame, text_col: str, fields: list[T.StructField], compute: Callable[[list[bytes | None]], list], keep_text: bool = True) -> DataFrame:
    """df with columns that compute() makes of a batch of texts (UTF-8, null: None).

    compute gives an array for each field. Without keep_text the text doesn't come back. Columns of the new names, in any case, are
    replaced; all others pass through in one struct, so no name of theirs can clash.
    """
    ready(df.sparkSession)
    keep = others(df, [f.name for f in fields] + ([] if keep_text else [text_col]))
    rows = df.select(packed(keep), exact(text_col).cast("binary").alias("_text"))
    schema = T.StructType([rows.schema["_row"], *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in fields]
        for batch in batches:
            for part in parts_of(batch):
                made = compute(part.column(1).to_pylist())
                arrays = [part.column(0), *[pa.array(x, k) for k, x in zip(kinds, made, strict=True)]]
                yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema.fields])

    return rows.mapInArrow(run, schema).select(*unpacked(keep), *[f.name for f in fields])
