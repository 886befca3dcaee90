"""Word lookups that stay inside the row: no join, no shuffle, no Python worker."""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def dictionary(mapping: Mapping[str, float]) -> Callable[[Column], Column]:
    """Return ``word -> value`` (NULL when absent) over a literal, folded once per query.

    A plain literal map is searched linearly.  The words are therefore spread over an array of
    small maps by CRC-32, so that a list of thousands of words costs a handful of comparisons.
    """
    if not mapping:
        return lambda word: F.lit(None).cast("double")
    slots = max(1, len(mapping) // 4)
    table: list[dict[str, float]] = [{} for _ in range(slots)]
    for word, value in mapping.items():
        table[zlib.crc32(word.encode("utf-8")) % slots][word] = float(value)
    literal = F.from_json(F.lit(json.dumps(table)), "array<map<string,double>>")

    def find(word: Column) -> Column:
        slot = F.get(literal, (F.crc32(word) % slots).cast("int"))
        return F.try_element_at(slot, word)

    return find
