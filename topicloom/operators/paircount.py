"""Counts of item pairs within blocks of records, by heavy-light decomposition.

Pairs of frequent items are counted by popcounts over a dense bit matrix (an item a row, a record a bit), pairs of a rare and
a frequent item by probing the matrix with the rare item's records, and pairs of rare items by sorting their codes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd

#: A block ends after so many records or items; pairs of rare items that are counted at once.
BLOCK, BLOCK_ITEMS, SLICE = 32768, 300_000, 1_500_000


def count_block(sizes: np.ndarray, item: np.ndarray, dense: np.ndarray, at_once: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, c), a before b as numbers, of one block. sizes: items of each record; item: their keys, distinct in a record; dense: which are frequent."""
    at_once = at_once or SLICE
    record = np.repeat(np.arange(len(sizes)), sizes)
    keys, local = np.unique(item, return_inverse=True)
    hot = np.zeros(len(keys), bool)
    hot[local[dense]] = True
    heavy = np.flatnonzero(hot)
    row_of = np.full(len(keys), -1)
    row_of[heavy] = np.arange(len(heavy))

    def out(a: np.ndarray, b: np.ndarray, c: np.ndarray):
        return keys[np.minimum(a, b)], keys[np.maximum(a, b)], c.astype(np.int64)

    bits = np.zeros((len(heavy), len(sizes)), bool)
    on = hot[local]
    bits[row_of[local[on]], record[on]] = True
    if len(heavy):
        packed = np.packbits(bits, axis=1)
        packed = np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)
        for i in range(len(heavy) - 1):
            c = np.bitwise_count(packed[i + 1 :] & packed[i]).sum(1)
            j = np.flatnonzero(c)
            if len(j):
                yield out(np.full(len(j), heavy[i]), heavy[i + 1 + j], c[j])
    rare_at = np.flatnonzero(~on)
    if not len(rare_at):
        return
    rare, rec = local[rare_at], record[rare_at]
    if len(heavy):  # list probing: the columns of the matrix at the records of a rare item, summed
        order = np.argsort(rare, kind="stable")
        columns = np.ascontiguousarray(bits.T)
        for at in range(0, len(order), 50_000):
            o = order[at : at + 50_000]
            starts = np.flatnonzero(np.r_[True, rare[o][1:] != rare[o][:-1]])
            c = np.add.reduceat(columns[rec[o]], starts, axis=0, dtype=np.uint16)
            i, j = np.nonzero(c)
            yield out(rare[o][starts][i], heavy[j], c[i, j])
    order = np.lexsort((rare, rec))
    rare, rec = rare[order], rec[order]
    follow = np.searchsorted(rec, rec, "right") - np.arange(len(rec)) - 1  # items that stand after this one in its record
    upto, at = np.cumsum(follow), 0
    while at < len(rec):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + at_once, "right")))
        n = follow[at:to]
        first = np.repeat(np.arange(at, to), n)
        second = first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(n) - n, n)
        code, c = np.unique(rare[first] * len(keys) + rare[second], return_counts=True)
        yield out(code // len(keys), code % len(keys), c)
        at = to


def count_lists(batches: Iterator[pd.DataFrame], frequent: np.ndarray, at_once: int | None = None) -> Iterator[pd.DataFrame]:
    """(a, b, c) from batches of `items`, lists of distinct numbers; `frequent`: those of the matrix, ascending. A pair may come out of several blocks."""

    def done(held: list[np.ndarray]) -> Iterator[pd.DataFrame]:
        item = np.concatenate(held).astype(np.int64)
        for a, b, c in count_block(np.array([len(x) for x in held]), item, np.isin(item, frequent), at_once):
            yield pd.DataFrame({"a": a, "b": b, "c": c})

    held: list[np.ndarray] = []
    items = 0
    for batch in batches:
        for x in batch["items"]:
            held.append(x)
            items += len(x)
            if len(held) >= BLOCK or items >= BLOCK_ITEMS:
                yield from done(held)
                held, items = [], 0
    if held:
        yield from done(held)
