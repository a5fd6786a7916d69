"""Byte-level BPE with a local rank file: encoding, and decoding to raw bytes.

Merges are tiktoken's. Long texts are cut first where the pre-splitting pattern has to
end a match whatever stands around: between a letter and a character that is none. Very
long runs of white space, which the pattern's look-ahead can't take, are pieces by rule:
all of the run but the last character, or all of it at the end of a text.
"""

from __future__ import annotations

import base64

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import with_columns_from_text

#: Characters of a text that are handed to the tokenizer at once, about.
CHUNK_CHARS = 1 << 16

# No alternative of the pattern goes on from a letter to anything but a letter, and none
# looks behind. ASCII cuts come first, as they don't depend on a version of Unicode.
_ASCII_CUT = regex.compile(r"[A-Za-z](?=[\x00-\x40\x5B-\x60\x7B-\x7F])")
_ANY_CUT = regex.compile(r"\p{L}(?=\P{L})")
_LONG_BLANK = regex.compile(r"\p{White_Space}{10000,}")
_LOADED: dict = {}


def encoding(rank_path: str, pattern: str):
    """The encoding of a rank file, loaded once in a process."""
    import tiktoken

    key = (rank_path, pattern)
    if key not in _LOADED:
        with open(rank_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _LOADED[key] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[key]


def chunks(text: str, limit: int = CHUNK_CHARS):
    """Parts of a text that tokenise as they do together. A run without a safe cut stays whole."""
    at = 0
    while len(text) - at > limit:
        cut = _ASCII_CUT.search(text, at + limit, min(len(text), at + 2 * limit)) or _ANY_CUT.search(text, at + limit)
        if not cut:
            break
        yield text[at : cut.end()]
        at = cut.end()
    yield text[at:]


def token_ids(enc, text: str, chunk_chars: int = CHUNK_CHARS) -> np.ndarray:
    """Ids of a text of any length."""
    ids, at = [], 0
    for blank in _LONG_BLANK.finditer(text):
        end = blank.end() if blank.end() == len(text) else blank.end() - 1
        for part in chunks(text[at : blank.start()], chunk_chars):
            ids += enc.encode_ordinary(part)
        ids += enc._encode_single_piece(text[blank.start() : end])
        at = end
    for part in chunks(text[at:], chunk_chars):
        ids += enc.encode_ordinary(part)
    return np.array(ids, "<u4")


def raw_bytes(enc, packed: bytes | None) -> bytes:
    """What packed ids stand for."""
    return enc.decode_bytes(np.frombuffer(packed or b"", "<u4").tolist())


def encode(df: DataFrame, rank_path: str, pattern: str, text_col: str = "text", chunk_chars: int = CHUNK_CHARS, with_decoded: bool = False) -> DataFrame:
    """df with `token_ids` (binary: little-endian unsigned 32-bit ids) and `n_tokens`.

    with_decoded adds `decoded`, what decode() makes of the packed ids, in the same pass.
    Null and empty texts have no tokens. Special tokens' strings are ordinary text. Bytes
    that are no UTF-8 count as U+FFFD. The rank file has to be at rank_path on every
    worker. Columns of the new names are replaced, all others stay.
    """

    def compute(texts):
        enc = encoding(rank_path, pattern)
        packed, counts, back = [], [], []
        for t in texts:
            ids = token_ids(enc, (t or b"").decode(errors="replace"), chunk_chars)
            packed.append(ids.tobytes())
            counts.append(len(ids))
            if with_decoded:
                back.append(raw_bytes(enc, packed[-1]))
        return [packed, counts, back][: len(fields)]

    fields = [T.StructField("token_ids", T.BinaryType()), T.StructField("n_tokens", T.LongType()), T.StructField("decoded", T.BinaryType())][: 2 + with_decoded]
    return with_columns_from_text(df, text_col, fields, compute)


def decode(df: DataFrame, rank_path: str, pattern: str, ids_col: str = "token_ids") -> DataFrame:
    """df with `decoded`: the raw bytes of packed ids, whether or not they are valid UTF-8. Null: none."""

    def compute(packed):
        enc = encoding(rank_path, pattern)
        return [[raw_bytes(enc, p) for p in packed]]

    return with_columns_from_text(df, ids_col, [T.StructField("decoded", T.BinaryType())], compute)


def op3_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded by the public 50k ranks."""
    import public_tokenizers

    rank_path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    back = encode(docs, rank_path, pattern, with_decoded=True)
    return back.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
