"""Problem 8: exact ids of a public byte-level BPE tokenizer.

A text falls into units (a run of white space with the piece after it) that the tokenizer's pattern never joins, so a
bounded cache by unit saves nearly all work. A new unit is split by the pattern, and each piece is encoded by dynamic
programming over its prefixes: the encoding of every prefix has one last token, found among the vocabulary's matches
that end there (one pass of a suffix-linked automaton) as the one that is compatible with the last token of the prefix
before it. Two tokens are compatible if the merges of their joined bytes give just these two. Following the back-pointers
from the end gives the ids. No task holds more than the vocabulary, the cache and one batch of texts.
"""

from __future__ import annotations

import base64
import importlib.util
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.tables import table

#: Fixed value: the pattern of the vocabulary, which splits text before any merge.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space of the pattern (the Unicode property White_Space).
_S = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_UNIT = re.compile(f"[{_S}]*[^{_S}]+|[{_S}]+")
#: Units in the cache of a worker, and the longest unit that goes there.
CACHED, LONGEST = 400_000, 64


def vocabulary_path(name: str = "byte_bpe_50k") -> str:
    """The rank file of a public tokenizer: in $TOKENIZERS, else beside the installed package of vocabularies."""
    root = os.environ.get("TOKENIZERS")
    if not root:
        spec = importlib.util.find_spec("public_tokenizers")
        root = os.path.dirname(spec.origin) if spec else "/opt/tokenizers"
    return os.path.join(root, f"{name}.tiktoken")


class PrefixEncoder(dict):
    """unit -> ids; a dict, so that cached units cost one lookup."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        import ahocorasick
        import regex

        self.ranks, self.pieces = ranks, regex.compile(PATTERN)
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.fit: dict[tuple[int, int], bool] = {}
        self.automaton = ahocorasick.Automaton()
        for b, i in ranks.items():
            self.automaton.add_word(b.decode("latin-1"), (len(b), i))
        self.automaton.make_automaton()

    def merged(self, data: bytes) -> list[int]:
        """The merges applied to a short string in order of rank: what compatibility is measured against."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], len(self.ranks)), i) for i in range(len(parts) - 1))
            if rank == len(self.ranks):
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def compatible(self, a: int, b: int) -> bool:
        got = self.fit.get((a, b))
        if got is None:
            if len(self.fit) >= CACHED:
                self.fit.clear()
            got = self.fit[a, b] = self.merged(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return got

    def encode_piece(self, piece: str) -> list[int]:
        data = piece.encode("utf-8", "replace")
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        last = [-1] * (len(data) + 1)  # the last token of the encoding of each prefix
        size = [0] * (len(data) + 1)
        for end, (n, token) in self.automaton.iter(data.decode("latin-1")):
            end += 1
            if last[end] < 0 and (n == end or (last[end - n] >= 0 and self.compatible(last[end - n], token))):
                last[end], size[end] = token, n
        ids, at = [], len(data)
        while at:
            ids.append(last[at])
            at -= size[at]
        return ids[::-1]

    def __missing__(self, unit: str) -> list[int]:
        ids = list(chain.from_iterable(map(self.encode_piece, self.pieces.findall(unit))))
        if len(unit) <= LONGEST:
            if len(self) >= CACHED:
                self.clear()
            self[unit] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.__getitem__, _UNIT.findall(text))))


@lru_cache(maxsize=2)
def encoder(path: str) -> PrefixEncoder:
    with open(path, "rb") as f:
        return PrefixEncoder({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


def encoded(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, ids) of every row, in place: no shuffle, no row left out.

    An empty or null text gives an empty list. Blank, odd and very long texts are encoded whole; strings that look like
    special tokens are ordinary text. Other columns are not read. `path` is the rank file, the same on all machines.
    """
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = encoder(path)
        for b in batches:
            for at in range(0, b.num_rows, 1000):  # long texts: small pieces bound the memory
                part = b.slice(at, 1000)
                ids = [one.encode(t) if t else [] for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"))


QUERIES = {"p8_ids": p8_ids}
SQL: dict[str, str] = {}
