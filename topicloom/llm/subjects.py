"""Problem 6: the subject areas of each document.

One-versus-rest linear classifiers over hashed words and word pairs, fitted on a bounded sample of the documents that carry a
weak label: the path-like or free-spelled entry that came with them. They score sentences, not whole texts, so a second
subject that fills a paragraph shows beside the first, and a passing figure of speech doesn't. How many sentences a subject
needs is calibrated on the labelled documents: the least number from which the label agrees often enough.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.tables import table

#: The bound of the labelled sample that is fitted on the driver, and the number of hashed features.
SAMPLE, WIDTH = 5000, 1 << 16
#: A sentence is about a subject from this probability. A subject needs so many sentences that at least this share of the
#: labelled documents with that many carry it as their label (documents of two subjects have the label of either).
SURE, AGREE = 0.7, 0.25
#: Words of the labels in use and the subject they stand for.
ALIASES = {
    "motoring": "motoring autos auto cars car motorcycles motorcycle", "software": "software comp tech computing computers programming",
    "politics": "politics political government", "sport": "sport sports", "finance": "finance business biz money economics",
    "medicine": "medicine health med medical", "space": "space astronomy", "cooking": "cooking food recipes", "music": "music entertainment",
    "law": "law legal",
}
_OF = {w: s for s, ws in ALIASES.items() for w in ws.split()}

_WORD = re.compile(r"[^\W\d_]+")
_QUOTE = re.compile(r"^[ \t]*(?:(?:[A-Z]{0,2}[>|}:]) ?)*", re.M)
_HEADER = re.compile(r"^[ \t>|}:]*[A-Z][\w-]{1,24}:(?: |\t).*$", re.M)
_TITLE = re.compile(r"^[ \t>|}:]*(?:Subject|Betreff|Objet|Asunto):[ \t]*(?:(?:re|aw|fwd?|tr|rv|wg):[ \t]*)*(.+)$", re.M | re.I)
_ADDRESS = re.compile(r"\S*[@/]\S*|\S+-\S+-\S+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n\s*\n")


def subject_of(label: str | None) -> str | None:
    """The subject that a label stands for, by the words between its dots, spaces and other marks; null if none or several."""
    found = {_OF[w] for w in re.split(r"[^a-z]+", (label or "").lower()) if w in _OF}
    return found.pop() if len(found) == 1 else None


@lru_cache(maxsize=200_000)
def _code(word: str) -> int:
    h = 2166136261
    for b in word.encode():
        h = (h ^ b) * 16777619 % 2**32
    return h


def sentence_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(features, first feature of each sentence) of the sentences with at least three words, and of the titles.

    Quote marks, other headers and addresses are taken off.
    """
    text = text.replace("\r", "")
    titles = _TITLE.findall(text)
    text = _ADDRESS.sub(" ", _QUOTE.sub("", _HEADER.sub("", text)))
    parts = []
    for s, least in [*((t, 1) for t in titles), *((s, 3) for s in _SENTENCE.split(text))]:
        ws = _WORD.findall(s.lower())
        if len(ws) >= least:
            c = np.array([_code(w) for w in ws], np.uint64)
            pair = (c[1:] * np.uint64(0x9E3779B97F4A7C15) ^ c[:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(20)
            parts.append(np.unique(np.r_[c, pair] % np.uint64(WIDTH)).astype(np.int64))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    n = np.array([len(p) for p in parts])
    return np.concatenate(parts), np.cumsum(n) - n


class OneVersusRest:
    """Linear classifiers, one a subject, whose weights are smoothed log ratios of document counts within and without it.

    Features of fewer than `least` documents and ratios below `weak` weigh nothing: they say more about labels' errors.
    """

    def __init__(self, names: list[str], smooth: float = 1.0, least: int = 5, weak: float = 1.2) -> None:
        self.names, self.smooth, self.least, self.weak = names, smooth, least, weak
        self.w, self.b = np.zeros((WIDTH, len(names)), np.float32), np.full(len(names), -2.2, np.float32)

    def probabilities(self, features: np.ndarray, starts: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.zeros((0, len(self.names)))
        return 1 / (1 + np.exp(-np.clip(np.add.reduceat(self.w[features], starts, axis=0) + self.b, -30, 30)))

    def fit(self, docs: list[tuple[np.ndarray, np.ndarray]], label: list[int]) -> None:
        counts, n = np.zeros((WIDTH, len(self.names))), np.bincount(label, minlength=len(self.names)).astype(float)
        for (features, _), y in zip(docs, label):
            counts[np.unique(features), y] += 1
        total = counts.sum(1, keepdims=True)
        inside = (counts + self.smooth * n / n.sum()) / (n + self.smooth)
        outside = (total - counts + self.smooth * (1 - n / n.sum())) / (n.sum() - n + self.smooth)
        ratio = np.log(np.maximum(inside, 1e-9) / np.maximum(outside, 1e-9))
        self.w = np.where((total >= min(self.least, len(docs))) & (np.abs(ratio) >= self.weak), ratio, 0).astype(np.float32)
        self.b = np.log(np.maximum(n, 0.5) / np.maximum(n.sum() - n, 0.5)).astype(np.float32)

    def support(self, text: str) -> tuple[np.ndarray, int]:
        """(sentences about each subject, sentences of the text)."""
        features, starts = sentence_features(text)
        p = self.probabilities(features, starts)
        if not len(p):
            return np.zeros(len(self.names), int), 0
        best = p.argmax(1)
        return np.bincount(best[p[np.arange(len(p)), best] >= SURE], minlength=len(self.names)), len(p)


def calibrated(support: list[tuple[np.ndarray, int]], label: list[int]) -> tuple[int, float]:
    """(sentences, share): a subject holds from so many sentences, or from one that is at least this share of the text."""
    counts = np.array([s for s, _ in support])
    mine = np.zeros(counts.shape, bool)
    mine[np.arange(len(label)), label] = True
    share = counts / np.maximum([[n] for _, n in support], 1)

    def least(value: np.ndarray, steps: list, among: np.ndarray, enough: int) -> float:
        for k, lo in enumerate(steps):
            # a step with too few documents is judged with those of the steps above it
            for hi in steps[k + 1 :] + [np.inf]:
                at = among & (value >= lo) & (value < hi)
                if at.sum() >= enough:
                    break
            if at.sum() >= enough and mine[at].mean() >= AGREE:
                return lo
        return steps[-1] + 1

    need = int(least(counts, [2, 3, 4, 5], counts > 1, 5))
    return need, least(share, [0.1, 0.15, 0.2, 0.25, 0.34, 0.5, 1.0], counts == 1, 20)


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, subject) of the documents whose labels, read as subjects, agree on one."""
    known = F.udf(subject_of, "string")  # over the distinct labels only
    kinds = labels.select("label").where(F.col("label").isNotNull()).distinct().select("label", known("label").alias("subject")).where(F.col("subject").isNotNull())
    one = labels.select("doc_id", "label").join(kinds, "label").groupBy("doc_id").agg(F.min("subject").alias("subject"), F.max("subject").alias("other"))
    return docs.join(one.where(F.col("subject") == F.col("other")).select("doc_id", "subject"), "doc_id")


def texts_of(docs: DataFrame) -> DataFrame:
    """(doc_id, text), each id once (its greatest text); rows without id or text are left out."""
    return docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).groupBy("doc_id").agg(F.max("text").alias("text"))


def subject_areas(docs: DataFrame, labels: DataFrame, names: list[str]) -> DataFrame:
    """(doc_id, subject): every subject that a text as a whole deals with; small talk, null, empty and blank texts give no row."""
    texts = texts_of(docs)
    out = "doc_id long, subject string"
    sample = labelled(texts, labels).where(F.col("subject").isin(names)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).collect()
    if not sample:
        return docs.sparkSession.createDataFrame([], out)
    names = sorted(names)
    model, label = OneVersusRest(names), [names.index(r["subject"]) for r in sample]
    model.fit([sentence_features(r["text"]) for r in sample], label)
    need, alone = calibrated([model.support(r["text"]) for r in sample], label)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            ids, found = [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                counts, n = model.support(t.as_py())
                for k in np.flatnonzero((counts >= need) | ((counts == 1) & (counts >= alone * n))):
                    ids.append(i)
                    found.append(model.names[k])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.string())], ["doc_id", "subject"])

    return texts.mapInArrow(run, out)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [r["subject"] for r in table(spark, sf_dir, "subjects").where(F.col("subject").isNotNull()).distinct().collect()]
    return subject_areas(table(spark, sf_dir, "docs"), table(spark, sf_dir, "labels"), names)


def p6_makeup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The make-up of the corpus: documents per subject."""
    return p6_found(spark, sf_dir).groupBy("subject").agg(F.count(F.lit(1)).alias("docs"))


QUERIES = {"p6_found": p6_found, "p6_makeup": p6_makeup}
SQL: dict[str, str] = {}
