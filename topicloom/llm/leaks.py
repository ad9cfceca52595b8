"""Problem 9: evaluation texts that leak into documents.

Items are partitioned by size. A document's three-word shingles are cut, for each size class, into overlapping windows of
about half an item of the class, so that even a part of a short item fills a good share of some window of a long document.
Windows and items are sketched by MinHash; an item is a candidate where any of the hashes agrees. Each candidate is verified
exactly: two-word shingles that both texts share are chained into stretches, and the item's words that stand in order in
the best one or two stretches are counted. Chains that take each shingle once are quickly found and mostly decide; where they
make no case, the best of all chains are.

The items are a stated query set: they are broadcast in blocks of bounded size and met by all documents, without a shuffle.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.tables import table

#: Hashes in a sketch; shingles in more items than SHARED say nothing about one item; items in a broadcast block.
HASHES, SHARED, BLOCK = 32, 3, 4096
#: Share of an item's words that makes a case, and the least words of a stretch.
HALF, STRETCH = 0.5, 5
#: Words by which a stretch may go on in either text, and by how many of them the texts may differ.
GAP, DRIFT = 7, 4
#: Characters that are cut into words at once; a document's codes are put together again before anything is judged.
PIECE = 2_000_000

_WORD, _GAP = re.compile(r"[^\W_]+"), re.compile(r"\s")
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_MULTIPLIERS = np.array([((2 * k + 1) * 0xD6E8FEB86659FD93 + 0x2545F4914F6CDD1D) % 2**64 | 1 for k in range(HASHES)], np.uint64)


#: Cyrillic and Greek letters, in lower case, that look like Latin ones in either case, and these.
_LOOKS = dict(zip("авекмнорстухіјѕһԁԛԝӏαβεζηικμνορτυχ", "abekmhopctyxijshdqwlabezhikmvoptux", strict=True))


class _Plain(dict):
    """Character map: format characters (soft hyphens, zero widths) and combining marks vanish, look-alikes become Latin."""

    def __init__(self) -> None:
        self |= {ord(a): ord(b) for a, b in _LOOKS.items()}

    def __missing__(self, c: int) -> int | None:
        self[c] = None if unicodedata.category(chr(c)) in ("Cf", "Mn") else c
        return self[c]


_plain = _Plain()


def words(text: str | None) -> list[str]:
    """The words of a text without differences of writing: case, width, accents, look-alike letters, invisible characters, punctuation, layout."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text).lower().translate(_plain)
    return _WORD.findall(text.lower())


class _Codes(dict):
    """word -> 64-bit code, bounded."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = 1469598103934665603
        for b in word.encode():
            h = (h ^ b) * 1099511628211 % 2**64
        self[word] = h
        return h


def codes(ws: list[str], known: _Codes) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, ws), np.uint64, len(ws))


def text_codes(text: str | None, known: _Codes) -> np.ndarray:
    """Codes of all words of a text; long ones are read in pieces that end at white space, so memory holds eight bytes a word."""
    text, at, parts = text or "", 0, []
    while at < len(text):
        to = at + PIECE
        gap = _GAP.search(text, to) if to < len(text) else None
        to = gap.start() if gap else len(text)
        parts.append(codes(words(text[at:to]), known))
        at = to
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def shingles(c: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, n = 2 or 3."""
    if len(c) < n:
        return np.zeros(0, np.uint64)
    h = c[: len(c) - n + 1] * _A + c[1 : len(c) - n + 2] * _B + (c[2:] * _C if n == 3 else np.uint64(0))
    return h ^ (h >> np.uint64(29))


class Items:
    """Sketches of a block of items, by size class."""

    def __init__(self, rows: list[tuple[int, str]]) -> None:
        known = _Codes()
        self.ids = [i for i, _ in rows]
        self.codes = [codes(words(t), known) for _, t in rows]
        in_items = Counter(h for c in self.codes for h in set(shingles(c, 3).tolist()))
        self.classes: dict[int, list[dict[int, list[int]]]] = {}
        self.pairs, self.keys = [], []
        for n, c in enumerate(self.codes):
            self.pairs.append(defaultdict(list))
            for i, h in enumerate(shingles(c, 2).tolist()):
                self.pairs[n][h].append(i)
            self.keys.append(np.fromiter(self.pairs[n], np.uint64, len(self.pairs[n])))
            own = np.array([h for h in set(shingles(c, 3).tolist()) if in_items[h] <= SHARED], np.uint64)
            if not len(own):  # too short, or all of it is shared: every shingle counts
                own = np.unique(shingles(c, 3))
            if not len(own):
                continue
            half = max(4, 2 ** (len(c).bit_length() - 1) // 4)
            tables = self.classes.setdefault(half, [defaultdict(list) for _ in range(HASHES)])
            for k in range(HASHES):
                tables[k][int((own * _MULTIPLIERS[k] >> np.uint64(20)).min())].append(n)
        self.marks = {half: [self._mark(t) for t in tables] for half, tables in self.classes.items()}

    @staticmethod
    def _mark(values: dict[int, list[int]]) -> np.ndarray:
        """A bitmap of the values' low bits, to drop nearly all windows before the exact look-up."""
        m = np.zeros(1 << 18, bool)
        m[np.fromiter(values, np.uint64, len(values)) & np.uint64((1 << 18) - 1)] = True
        return m

    def candidates(self, h: np.ndarray, starts: np.ndarray) -> set[tuple[int, int]]:
        """(document, item) whose sketches agree in a hash. h: shingles of all documents, starts: first shingle of each (none is empty)."""
        found: set[tuple[int, int]] = set()
        ends = np.r_[starts[1:], len(h)]
        for half, tables in self.classes.items():
            n = -(-(ends - starts) // half)  # half-windows of each document
            doc = np.repeat(np.arange(len(starts)), n)
            cut = np.repeat(starts, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * half
            joined = np.r_[doc[1:] == doc[:-1], False]
            for k, values in enumerate(tables):
                low = np.minimum.reduceat(h * _MULTIPLIERS[k] >> np.uint64(20), cut)
                low = np.where(joined, np.minimum(low, np.r_[low[1:], low[-1:]]), low)
                hit = np.flatnonzero(self.marks[half][k][low & np.uint64((1 << 18) - 1)])
                for d, v in zip(doc[hit].tolist(), low[hit].tolist()):
                    found.update((d, i) for i in values.get(v, ()))
        return found

    def share(self, n: int, doc_pairs: dict[int, list[int]]) -> float:
        """The share of item n's words that stand in order in the document's best one or two stretches.

        doc_pairs: the positions of the document's two-word shingles, at least of those that the item has. A stretch goes on over a few changed, missing or added
        words; these count as the item's if at least seven of ten words of the stretch stand there exactly. Quickly found stretches
        decide where they make a case; else all stretches are looked at, unless too few words are shared for a case (the share is then a lower bound).
        """
        seeds = sorted((j, i) for h, at in self.pairs[n].items() for j in doc_pairs.get(h, ()) for i in at)
        size = len(self.codes[n])
        quick = best_two(quick_stretches(seeds)) / size if size else 0.0
        # either stretch has seven of ten words; where both have the same seven, these are seven of the thirteen in both
        if quick >= HALF or not seeds or len({x for _, i in seeds for x in (i, i + 1)}) < 7 / 13 * HALF * size - 1e-9:
            return quick
        return best_two(all_stretches(seeds, size)) / size


def quick_stretches(seeds: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(first word, end, place in the document) of stretches of an item, chained from seeds (place in the document, in the item) in
    order, each of which goes to one chain only."""
    chains: list[list[tuple[int, int]]] = []
    open_: list[list[tuple[int, int]]] = []
    for j, i in seeds:
        open_ = [c for c in open_ if j - c[-1][0] <= GAP]
        fit = [c for c in open_ if 0 < i - c[-1][1] <= GAP and j > c[-1][0] and abs((i - c[-1][1]) - (j - c[-1][0])) <= DRIFT]
        if fit:
            min(fit, key=lambda c: (abs((i - c[-1][1]) - (j - c[-1][0])), -len(c))).append((j, i))
        else:
            open_.append([(j, i)])
            chains.append(open_[-1])
    good = []
    for c in chains:
        exact = len({x for _, i in c for x in (i, i + 1)})
        a, b = c[0][1], c[-1][1] + 2
        if exact >= STRETCH and exact >= 0.7 * (b - a):
            good.append((a, b, c[0][0]))
    return good


def all_stretches(seeds: list[tuple[int, int]], size: int) -> list[tuple[int, int, int]]:
    """The same over every way to chain the seeds: of the stretches that begin with a seed, the longest, which can stand for the others.

    From the last seed to the first: most[e] is the greatest number of exact words of a chain that begins there and ends before
    word e, from those of all seeds that can follow.
    """
    good: list[tuple[int, int, int]] = []
    after: dict[int, dict[int, np.ndarray]] = {}
    ends = np.arange(size + 1)
    for j, i in reversed(seeds):
        if j not in after:
            after = {at: some for at, some in after.items() if at - j <= GAP} | {j: {}}
        most = np.full(size + 1, -size, np.int64)
        most[i + 2] = 2
        for at, some in after.items():
            for di in range(max(1, at - j - DRIFT), min(GAP, at - j + DRIFT) + 1) if at > j else ():
                if (then := some.get(i + di)) is not None:
                    np.maximum(most, then + min(di, 2), out=most)
        after[j][i] = most
        fine = np.flatnonzero((most >= STRETCH) & (most >= 0.7 * (ends - i)))
        if len(fine):
            good.append((i, int(fine[-1]), j))
            if fine[-1] - i >= HALF * size:
                return good[-1:]
    return good


def best_two(stretches: list[tuple[int, int, int]]) -> int:
    """The most words of an item in one stretch, or in two that stand in order."""
    best = 0
    first: dict[tuple[int, int], int] = {}
    last: dict[tuple[int, int], int] = {}
    for a, b, j in stretches:  # of equal stretches, the earliest and the latest place in the document say all
        first[a, b] = min(first.get((a, b), j), j)
        last[a, b] = max(last.get((a, b), j), j)
    if first:
        spans, late = np.array(list(first)), np.array([last[s] for s in first])
        for (a, b), j in first.items():
            best = max(best, b - a)
            then = spans[(spans[:, 0] > a) & (late > j)]  # in order
            if len(then):
                best = max(best, int((b - a + then[:, 1] - then[:, 0] - np.maximum(0, np.minimum(b, then[:, 1]) - then[:, 0])).max()))
    return best


def leaks(docs: DataFrame, items: list[tuple[int, str]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id): the documents in which at least half of an item's words stand, as stated above.

    Null, empty and very long texts are fine (each is judged as a whole); a document that is there twice is reported once. Items without three words can't be found. Other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    spark = docs.sparkSession

    def block(rows: list[tuple[int, str]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(rows)  # at most BLOCK items

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, known = Items(shared.value), _Codes()
            for b in batches:
                ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
                found, at = [], 0
                while at < len(texts):
                    held, size = [], 0
                    while at < len(texts) and (not held or size < PIECE):
                        held.append((ids[at], text_codes(texts[at], known)))
                        size, at = size + len(texts[at] or ""), at + 1
                    found += search(own, held)
                found = sorted(set(found), key=str)
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in found], b.column(0).type), pa.array([i for _, i in found], pa.int64())], ["doc_id", "item_id"])

        return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(F.length("text") > 0).mapInArrow(run, f"doc_id {kind}, item_id long")

    parts = [block(items[at : at + BLOCK]) for at in range(0, len(items), BLOCK)]
    if not parts:
        return docs.select(F.col(id_col).alias("doc_id"), F.lit(0).cast("long").alias("item_id")).limit(0)
    return reduce(DataFrame.union, parts).distinct()


def search(own: Items, held: list[tuple[int, np.ndarray]]) -> list[tuple[int, int]]:
    """(document, item) of the leaks in documents (id, codes of all words)."""
    held = [(d, c) for d, c in held if len(c) >= 3]
    if not held:
        return []
    three = [shingles(c, 3) for _, c in held]
    starts = np.cumsum([0, *map(len, three)])[:-1]
    by_doc = defaultdict(list)
    for d, i in own.candidates(np.concatenate(three), starts):
        by_doc[d].append(i)
    found = []
    for d, some in by_doc.items():
        two, at = shingles(held[d][1], 2), defaultdict(list)
        where = np.flatnonzero(np.isin(two, np.concatenate([own.keys[i] for i in some])))
        for j, h in zip(where.tolist(), two[where].tolist()):
            at[h].append(j)
        found += [(held[d][0], own.ids[i]) for i in some if own.share(i, at) >= HALF]
    return found


def items_of(df: DataFrame) -> list[tuple[int, str]]:
    """The stated query set, in order; rows without id or text are left out."""
    rows = df.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text").orderBy("item_id")
    return [(r["item_id"], r["text"]) for r in rows.toLocalIterator()]


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), items_of(table(spark, sf_dir, "eval_items")))


QUERIES = {"p9_found": p9_found}
SQL: dict[str, str] = {}
