"""Fixed-width values, payload padding and names of workloads."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the width of a stored text value.
WIDTH = 32


def right_pad(value: Column, width: int = WIDTH) -> Column:
    """Text of at least width characters, blanks at its end; longer text as it is."""
    text = value.cast("string")
    return F.when(F.length(text) < width, F.rpad(text, width, " ")).otherwise(text)


def stored_number(value: Column) -> Column:
    """The number in a padded value; null where there is none."""
    return F.trim(value).try_cast("bigint")


def padded_words(line: Column, size: int) -> Column:
    """A line whose words all have at least size characters, to make its payload larger."""
    return F.array_join(F.transform(F.split(line, " ", -1), lambda w: F.when(w == "", w).otherwise(right_pad_with(w, size, "x"))), " ")


def right_pad_with(text: Column, size: int, filler: str) -> Column:
    return F.when(F.length(text) < size, F.rpad(text, size, filler)).otherwise(text)


def workload_name(parameters: dict) -> str:
    """A name that says which parameters a workload was made with: the SHA-256 of them in the order of their names."""
    return hashlib.sha256(json.dumps(parameters, sort_keys=True, default=str).encode()).hexdigest()


def row_hash(*columns: str) -> Column:
    """A hash of several columns, nested ones included; the same for equal rows."""
    return F.xxhash64(*columns)
