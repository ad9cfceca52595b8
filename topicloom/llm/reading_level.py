"""Problem 10: the reading level of English prose, by regularised ordinal regression.

Per sentence: words, letters per word, long words, rare words, connectives and a proxy of clause depth (subordinators and
inner punctuation); per document: the medians over its sentences, so a few easier or harder ones don't decide, the means,
and lexical diversity. Rarity rests on document counts over the whole corpus, of which the bounded head of the most common
words is broadcast. A proportional-odds model with a ridge penalty is fitted on the graded texts (a small fixed table).
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.tables import table

#: Words of the corpus whose rank is broadcast; every other word has the rank behind them.
COMMON = 4096
#: Words that a text must have, and the share of its words that must be English function words.
LEAST_WORDS, LEAST_ENGLISH = 60, 0.16
#: Frequent English function words.
FUNCTION = frozenset("""a about after all also although an and any are as at be because been before but by can could did do does for from
had has have he her him his how i if in into is it its just may me more most my no nobody not of on one or our out over she should since so
some such than that the their them then there these they this those to too under unless until up upon us very was we were what when where
whereas which while who whose why will with without would you your each every another near""".split())
#: Frequent function words of the other languages of Latin script; shared spellings are left out.
FOREIGN = frozenset("""der die das und ist nicht ein eine einen einem den dem des im zu zur zum mit von auf für sich auch es wie oder aber nur
noch nach bei seit vor über ich wir sie le la les du et est un une dans pour pas que qui sur avec par au aux ce cette ces il elle nous vous
plus depuis mais ou où el los las y en por para con del al se una como más pero sobre sin desde hace esta este hay muy""".split())
#: Connectives, and words that open a clause.
CONNECTIVES = frozenset("""accordingly although because before but consequently conversely despite even furthermore hence however inasmuch
insofar likewise meanwhile moreover nevertheless notwithstanding otherwise since so therefore thereby though thus unless until whereas
whereby while yet""".split())
OPENERS = frozenset("""after although as because before if insofar inasmuch since so than that though unless until what when whenever where
whereas whereby whether which while who whom whose why""".split())

_SENTENCE = re.compile(r"(?<=[.!?])[\"'”’)]*\s+")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
NAMES = 14


class Lexicon(dict):
    """word -> row of a table of its properties; bounded, shared by the texts of a worker. rank: the common words of the corpus."""

    MOST = 300_000

    def __init__(self, rank: dict[str, int]) -> None:
        self.rank, self.table = rank, np.zeros((1024, 8))

    def __missing__(self, w: str) -> int:
        at = len(self)
        if at >= len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        plain = len(w) if w.isascii() else 0
        self.table[at] = len(w), len(w) > 6, np.log1p(self.rank.get(w, COMMON)), w in CONNECTIVES, w in OPENERS, w in FUNCTION, w in FOREIGN, plain
        self[w] = at
        return at

    def look_up(self, text: str) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(sentences with words, words of each, a row of properties per word)."""
        if len(self) > self.MOST:
            self.clear()
        sentences, counts, ids = [], [], []
        for s in _SENTENCE.split(text):
            if ws := _WORD.findall(s.lower()):
                sentences.append(s)
                counts.append(len(ws))
                ids += map(self.__getitem__, ws)
        return sentences, np.array(counts, int), np.array(ids, int)


def is_english_prose(text: str, ids: np.ndarray, rows: np.ndarray) -> bool:
    """At least 60 words, of which enough are English function words and few are of other languages, other scripts or no words at all."""
    if len(ids) < LEAST_WORDS or len(text.split()) < LEAST_WORDS:
        return False
    letters, _, _, _, _, english, foreign, latin = rows.sum(0)
    other = sum(unicodedata.category(c) == "Lo" for c in text) if not text.isascii() else 0
    solid = len(text) - text.count(" ") - text.count("\n")
    return english >= LEAST_ENGLISH * len(ids) and english > 2 * foreign and latin >= 0.8 * (letters + other) and letters >= 0.8 * solid


def features(text: str, lexicon: Lexicon, prose_only: bool = False) -> np.ndarray | None:
    """NAMES numbers of a text; a text without words gives zeros, one that isn't English prose none if `prose_only`."""
    sentences, counts, ids = lexicon.look_up(text)
    rows = lexicon.table[ids]
    if prose_only and not is_english_prose(text, ids, rows):
        return None
    if not len(ids):
        return np.zeros(NAMES)
    sums = np.add.reduceat(rows[:, :5], np.cumsum(counts) - counts, axis=0)
    inner = [s.count(",") + s.count(";") + s.count(":") + s.count("\u2014") for s in sentences]
    r = np.c_[np.log(counts), sums[:, :3] / counts[:, None], sums[:, 3], sums[:, 4] + inner]
    middle = np.median(r, 0)
    return np.r_[middle, r.mean(0), np.log(len(np.unique(ids))) / max(np.log(len(ids)), 1), (r[:, 3] > middle[3]).mean()]


class Ordinal:
    """Proportional odds with a ridge penalty, fitted by Newton's method on standardised features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> None:
        self.levels = np.unique(y)
        self.mean, self.scale = x.mean(0), np.where(x.std(0) > 1e-9, x.std(0), 1.0)
        z, k = (x - self.mean) / self.scale, len(self.levels)
        # each cut between levels is a row of the same regression: P(y > level) = sigmoid(w z - cut)
        rows = np.concatenate([np.c_[z, -np.eye(k - 1)[np.full(len(z), c)]] for c in range(k - 1)])
        above = np.concatenate([(y > self.levels[c]).astype(float) for c in range(k - 1)])
        ridge, b = np.r_[np.full(z.shape[1], penalty), np.full(k - 1, 1e-3)], np.zeros(z.shape[1] + k - 1)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(rows @ b, -30, 30)))
            step = np.linalg.solve((rows * (p * (1 - p))[:, None]).T @ rows + np.diag(ridge), rows.T @ (above - p) - ridge * b)
            b += step
            if np.abs(step).max() < 1e-8:
                break
        self.w, self.cuts = b[: z.shape[1]], np.sort(b[z.shape[1] :])

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.levels[((x - self.mean) / self.scale @ self.w)[:, None].__gt__(self.cuts).sum(1)]


def common_words(docs: DataFrame, text_col: str = "text") -> dict[str, int]:
    """Rank of the COMMON words that stand in most documents of the corpus, from counts over all of it; ties by the word."""
    ws = F.array_distinct(F.regexp_extract_all(F.lower(text_col), F.lit(r"(\p{L}+)"), F.lit(1)))
    top = docs.select(F.explode(ws).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("df")).orderBy(F.desc("df"), "w").limit(COMMON).collect()
    return {r["w"]: i for i, r in enumerate(top)}


def reading_levels(docs: DataFrame, graded: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, level) of the documents of mainly English prose of at least 60 words, each id once.

    Null, empty, short, foreign and other texts give no row; texts are read whole. `graded` has a text and a level.
    """
    rank = common_words(docs, text_col)
    rows = [(r["text"], r["level"]) for r in graded.where(F.col("text").isNotNull() & F.col("level").isNotNull()).toLocalIterator()]
    lexicon = Lexicon(rank)
    model = Ordinal(np.array([features(t, lexicon) for t, _ in rows]), np.array([v for _, v in rows]))
    shared = docs.sparkSession.sparkContext.broadcast((rank, model))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, model = shared.value
        lexicon = Lexicon(rank)
        for b in batches:
            seen = ((i, features(t.as_py(), lexicon, prose_only=True)) for i, t in zip(b.column(0).to_pylist(), b.column(1)))
            some = [(i, x) for i, x in seen if x is not None]
            level = model.predict(np.array([x for _, x in some])) if some else []
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in some], b.column(0).type), pa.array(level, pa.int32())], ["doc_id", "level"])

    least = 2 * LEAST_WORDS - 1  # characters: words of one letter, and what parts them
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(F.length("text") >= least)
    return texts.mapInArrow(run, f"doc_id {kind}, level int").groupBy("doc_id").agg(F.max("level").alias("level"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading_levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "graded_samples"))


QUERIES = {"p10_found": p10_found}
SQL: dict[str, str] = {}
