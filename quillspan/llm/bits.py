"""Bit tables of bounded size over the hashes of any number of rows.

A bit says that at least k rows fall into a slot. A table can only let too much through, never too little, so it serves as
a filter in front of an exact step; it has eight slots for each expected row, and never more than 2 ** SLOT_BITS, so what
is broadcast is bounded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

SLOT_BITS = 27
PART_BITS = 16


def slot_of(gram: np.ndarray, bits: int = SLOT_BITS) -> np.ndarray:
    return (gram >> np.uint64(64 - bits)).astype(np.int64)


def met(table: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """Whether the table may hold each hash."""
    return test_bits(table, slot_of(gram, len(table).bit_length() + 2))


def bit_tables(df: DataFrame, hashes: Callable[[pd.DataFrame], Iterable[np.ndarray]], levels: tuple[int, ...], rows: int | None = None) -> list[np.ndarray]:
    """For each level a bit table over the slots that at least so many of the 64-bit hashes of df fall into.

    hashes gives the hashes of a pandas batch. Only slot numbers travel, two bytes each, dealt by table part; the driver
    gets tables of bounded size. rows: how many hashes are expected, if that is known.
    """
    slot_bits = SLOT_BITS if rows is None else min(SLOT_BITS, max(PART_BITS, (8 * rows).bit_length()))

    def run(it):
        held, size = [], 0

        def flush():
            slots = np.sort(np.concatenate(held))
            part = slots >> PART_BITS
            cut = np.flatnonzero(np.diff(part)) + 1
            return pd.DataFrame({"part": part[np.concatenate([[0], cut])].astype(np.int32), "slots": [x.astype(np.uint16).tobytes() for x in np.split(slots, cut)]})

        for pdf in it:
            for h in hashes(pdf):
                held.append(slot_of(h, slot_bits).astype(np.uint32))
                size += len(held[-1])
                if size > 1 << 20:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    def count(key, pdf):
        n = np.zeros(1 << PART_BITS, np.int64)
        for b in pdf["slots"]:
            n += np.bincount(np.frombuffer(b, np.uint16), minlength=1 << PART_BITS)
        return pd.DataFrame({"part": [key[0]], "bits": [b"".join(np.packbits(n >= k).tobytes() for k in levels)]})

    width = 1 << (PART_BITS - 3)
    tables = np.zeros((len(levels), 1 << (slot_bits - PART_BITS), width), np.uint8)
    found = df.mapInPandas(run, "part int, slots binary").groupBy("part").applyInPandas(count, "part int, bits binary")
    for r in found.collect():  # one row per table part, a fixed number
        tables[:, r.part] = np.frombuffer(r.bits, np.uint8).reshape(len(levels), width)
    return list(tables.reshape(len(levels), -1))


def test_bits(table: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return (table[slot >> 3] >> (7 - (slot & 7)) & 1).astype(bool)
