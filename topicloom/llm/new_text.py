"""Problem 4: the lines of a mail that its sender wrote for this message.

A mail is cut into blocks: runs of lines of one make-up within a paragraph. Each block is described by its contacts per line,
quote depth, place behind headers, introductions, forwards and signatures, wording, and by two counts over the whole corpus:
in how many mails the same sender has the line (signatures come back), and which share of its lines stands in other mails.

Nothing here knows a phrase. How introductions, closing formulas, notices and forward marks are worded is learned from lines
whose place gives them away (class Wording). Gradient-boosted trees, fitted on a bounded sample of blocks, decide per block.
Their labels come from place and marks alone: blocks whose wording is all that speaks against them are not labelled.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.materialize import kept, written
from ..sources.tables import table
from .subjects import texts_of

#: The bounds of what is fitted on the driver: blocks, mails whose lines teach wording, and the length of such a mail.
SAMPLE, MAILS, LENGTH = 20_000, 3000, 20_000
#: Lines that most mails have, whose counts are broadcast.
HEAVY = 1024

_MARK = re.compile(r"[ \t]*(?:[A-Z]{1,3}[>|}]|[>|}]|:(?= |$))[ \t]?")
_CELLS = re.compile(r"^[ \t]*\|.*\|[ \t]*$")
_COMPARES = re.compile(r"^[ \t]*[>|}:][ \t]*(?:\d|or\b|=|<|and\b)")
_RULE = re.compile(r"^[ \t]*([-_=~#*+])\1{4,}[ \t]*$")
_DELIMITER = re.compile(r"^[ \t]*-{2,3}[ \t]*$")
_HEAD = re.compile(r"^(?:From|Subject|Date|To|Cc|Bcc|Reply-To|Organization|Organisation|Lines|Message-ID|Nntp-Posting-Host|Newsgroups|Sent|References|In-Reply-To|Sender|X-[\w-]+|Von|An|Betreff|Datum|Gesendet|De|À|A|Objet|Envoyé|Para|Asunto|Enviado|Fecha)[ \t]?:(?:[ \t]|$)")
_FRAMED = re.compile(r"^[ \t]*(-{2,})[ \t]*\w.*\w[ \t]*-{2,}[ \t]*$")
_DATED = re.compile(r"\d|@|<")
_CONTACT = re.compile(r"\S+@\S+\.\w+|https?://\S+|www\.\S+|^[ \t|]*(?:tel\.?|phone:?|t|fax:?|\+\d\d?)[ \t]+[\d ()/-]{5,}", re.I)
_NAME = re.compile(r"^[ \t]*(?:[-–—/][ \t]?)?(?:[A-ZÀ-Ý][\w'’-]*\.?)(?:[ \t](?:[A-ZÀ-Ý][\w'’-]*\.?|&|of|de|und|der)){0,3}[ \t]*$")
_SIGNED = re.compile(r"^[ \t]*[-–—/]")
_SENTENCE_END = re.compile(r"[.!?][\"'”’)]*[ \t]*$")

NAMES = (
    "depth", "header", "after_forward", "introduction", "closing", "in_signature", "notice", "rule", "cells", "continuation", "contacts", "lines", "words", "words_per_line",
    "sentence_ends", "capital_share", "name", "from_end", "quoted_before", "by_sender", "elsewhere", "common",
)


def stripped(line: str) -> tuple[int, str]:
    """(quote depth, the rest) of a line."""
    depth = 0
    while m := _MARK.match(line):
        if not m.end() or (depth == 0 and _CELLS.match(line)):
            break
        depth, line = depth + 1, line[m.end() :]
    return depth, line


def fields_at(lines: list[str], i: int) -> int:
    """Lines of a block of header fields that begins at i."""
    n = 0
    while i + n < len(lines) and lines[i + n].strip() and (_HEAD.match(lines[i + n]) or (n and lines[i + n][:1] in "\t ")):
        n += 1
    return n


def following(blank: list[bool], i: int, gap: int = 1) -> int:
    """The next line that isn't blank, at most `gap` blank ones on; the end of the text where there is none."""
    j = i + 1
    while j < len(blank) and blank[j] and j - i <= gap:
        j += 1
    return j if j < len(blank) and not blank[j] else len(blank)


ROLES = ("said", "closing", "notice", "forward")
#: Log odds from which a line counts as one of them. Of the notices only those below a signature are seen as such when wording is
#: learned, a part of them all, so less is asked of these.
SURE = np.array([0.0, 0.0, -2.5, 0.0])
#: Hashed features of wording, steps of its fit, and its ridge.
WIDTH, STEPS, RIDGE = 1 << 15, 60, 1e-4


def features(line: str) -> np.ndarray:
    """Hashed words and pairs of a line with its ends, its length and its last mark; numbers, names and addresses by their kind."""
    line = re.sub(r"^[ \t]*-{1,3}[ \t]+", "", line)
    ws = ["<"] + ["@" if "@" in w or "://" in w else "0" if any(c.isdigit() for c in w) else w.lower().strip("*_\"'()[]") for w in re.findall(r"[^\s,.;:!?]*[\w@][^\s,;:!?]*|[,.;:!?]+$", line)] + [">"]
    own = ws + [f"{x} {y}" for x, y in zip(ws, ws[1:])] + [f"#{min(len(ws), 9)}", f"${line.rstrip()[-1:] if not line.rstrip()[-1:].isalnum() else 'a'}"]
    return np.unique(np.array([zlib.crc32(w.encode()) % WIDTH for w in own], np.int64))


class Wording:
    """How lines of four kinds are worded: those that introduce quotes, closing formulas, notices, and marks of forwarded mail.

    One linear classifier a kind over the features of a line, fitted to lines whose place says what they are: an introduction
    stands right before marked quotes, a closing formula before a person's name, a mark before a block of header fields, and
    notices stand below a signature or come back at the end of paragraphs. Whose names are persons' is read off the senders' fields. Lines that no such place
    explains are the other class.
    """

    def __init__(self) -> None:
        self.w, self.b = np.zeros((len(ROLES), WIDTH), np.float32), np.full(len(ROLES), -9.0, np.float32)

    def fit(self, mails: list[list[str]]) -> "Wording":
        people = {w for lines in mails for x in lines for w in senders(x)}
        often, tails = recurring(mails)
        seen: dict[str, list] = {}
        for lines in mails:
            for line, role in placed(lines, people, often, tails):
                seen.setdefault(line, [0, *[0] * len(ROLES)])[role + 1] += 1
        if not seen:
            return self
        rows = [features(x) for x in seen]
        counts = np.array(list(seen.values()), float)
        size = np.array([len(r) for r in rows])
        flat, start, row = np.concatenate(rows), np.cumsum(size) - size, np.repeat(np.arange(len(rows)), size)
        total = counts.sum(1)
        for k in range(len(ROLES)):
            yes = counts[:, k + 1]
            if yes.sum() < 2:
                continue
            w, b, g2 = np.zeros(WIDTH), np.log(yes.sum() / max(total.sum() - yes.sum(), 1)), np.full(WIDTH, 1e-8)
            for _ in range(STEPS):
                p = 1 / (1 + np.exp(-np.clip(np.add.reduceat(w[flat], start) + b, -30, 30)))
                e = p * total - yes
                g = np.bincount(flat, e[row], WIDTH) + RIDGE * total.sum() / WIDTH * w
                g2 += g * g
                w -= 0.7 * g / np.sqrt(g2)
                b -= 0.5 * e.sum() / max((p * (1 - p) * total).sum(), 1.0)
            self.w[k], self.b[k] = w, b
        return self

    def roles(self, line: str) -> np.ndarray:
        """Which of the four a line is by its words."""
        return self.w[:, features(line)].sum(1) + self.b > SURE


_SENDER = re.compile(r"^(?:From|Von|De):[ \t]*([^<@\n]*)<[^>]*@|^(?:From|Von|De):[^\n]*@[^\n(]*\(([^)\n]*)\)")


def senders(line: str) -> list[str]:
    """The words of the sender's name in a header field, quoted or not."""
    m = _SENDER.match(stripped(line)[1])
    return re.findall(r"[^\W\d_]{2,}", m[1] or m[2] or "") if m else []


def recurring(mails: list[list[str]]) -> tuple[set[int], set[int]]:
    """Keys of lines without quote mark that stand in more than two mails, and of those in five or more after which, in half of them,
    no line follows, before any forwarded mail, that no other mail has."""
    bare, total = [], Counter()
    for lines in mails:
        top = following([not x.strip() for x in lines], -1, len(lines))
        top += fields_at(lines, top)
        cut = next((i for i in range(top, len(lines)) if fields_at(lines, i) >= 2 or _FRAMED.match(lines[i])), len(lines))
        bare.append([(line_key(x), len(x.split())) for x in lines[top:cut] if x.strip() and not stripped(x)[0]])
        total.update({k for k, _ in bare[-1]})
    ends = Counter()
    for keys in bare:
        after = next((n for n in range(len(keys), 0, -1) if keys[n - 1][1] >= 4 and total[keys[n - 1][0]] < 3), 0)
        ends.update({k for k, _ in keys[after:]} - {k for k, _ in keys[:after]})
    return {k for k, n in total.items() if n > 2}, {k for k, n in total.items() if n >= 5 and ends[k] >= 0.5 * n}


def placed(lines: list[str], people: set[str], often: set[int], tails: set[int]) -> Iterator[tuple[str, int]]:
    """(line, role by its place, -1 for none) of the lines of a mail that carry no quote mark.

    A longer line that many mails end with (`tails`, by key) is a notice of a mail program. Lines of the last
    paragraph, and others that stand in several mails (`often`), are left out where no place explains them.
    """
    n = len(lines)
    blank = [not x.strip() for x in lines]
    depth = [stripped(x)[0] for x in lines]
    person = [bool(_NAME.match(x)) and any(w in people for w in re.findall(r"\w+", x)) for x in lines]
    i = following(blank, -1, n)
    i += fields_at(lines, i) if i < n else 0
    last = max((k for k in range(1, n) if blank[k - 1] and not blank[k] and not depth[k]), default=0)
    signed = below = wrote = False  # a signature stands in this paragraph, or in the one above; the sender has written something
    while i < n:
        if blank[i] or depth[i]:
            if depth[i] or (i + 1 < n and not blank[i + 1]):
                below, signed = signed and wrote and not depth[i], False
            i += 1
            continue
        nxt, line = following(blank, i), lines[i].strip()
        if fields_at(lines, i) >= 2:
            return  # what follows is forwarded
        ended = _SENTENCE_END.search(line)
        if nxt < n and (fields_at(lines, nxt) >= 2 or (depth[nxt] and _HEAD.match(stripped(lines[nxt])[1]))) and len(line.split()) <= 8:
            yield line, 3
            if _FRAMED.match(line):
                return
        elif i + 1 < n and depth[i + 1] and line.endswith(":"):
            yield line, 0
            if i and not blank[i - 1] and not depth[i - 1] and _DATED.search(lines[i - 1]) and not _SENTENCE_END.search(lines[i - 1]):
                yield f"{lines[i - 1].strip()} {line}", 0
        elif _RULE.match(line) or _DELIMITER.match(line):
            below, signed = below or (signed and wrote), True
        elif person[i]:
            signed = signed or (not ended and (i + 1 >= n or blank[i + 1] or not _SENTENCE_END.search(lines[i + 1])))
        elif nxt < n and person[nxt] and not depth[nxt] and len(line.split()) <= 5 and not line.endswith((".", "?", ":")) and not _SENTENCE_END.search(lines[nxt]):
            yield line, 1
        elif len(line.split()) >= 4 and (below or line_key(line) in tails):
            yield line, 2
        elif not signed:
            wrote = True
            if i < last and (len(line.split()) < 4 or line_key(line) not in often):
                yield line, -1
        i += 1


def make_up(lines: list[str], wording: Wording) -> tuple[list[int], list[dict[str, float]]]:
    """(quote depth, flags) of every line."""
    n = len(lines)
    blank = [not x.strip() for x in lines]
    depth, body = map(list, zip(*map(stripped, lines))) if n else ([], [])
    for i in range(n):  # a comparison sign at the start of a line of one's own
        if depth[i] == 1 and _COMPARES.match(lines[i]) and not any(0 <= j < n and depth[j] for j in (i - 1, i + 1)):
            depth[i], body[i] = 0, lines[i]
    flag: list[dict[str, float]] = [{} for _ in range(n)]
    said, closes, notes, forwards = (list(x) for x in zip(*[wording.roles(x) if not blank[i] and not depth[i] else (False,) * 4 for i, x in enumerate(lines)])) if n else ([], [], [], [])
    # headers at the top, with continuation lines
    i = following(blank, -1, n)
    if i < n and _HEAD.match(lines[i]) and not _SENTENCE_END.search(lines[i].split(":", 1)[0]) and " -- " not in lines[i]:
        while i < n and not blank[i] and (_HEAD.match(lines[i]) or lines[i][:1] in " \t"):
            flag[i]["header"] = 1
            i += 1
    top = i
    # forwarded mail: everything from its mark on; a block of header fields is a mark, too
    start = n
    for i in range(top, n):
        if depth[i] or blank[i]:
            continue
        fields, nxt = fields_at(lines, i), following(blank, i)
        frame = _FRAMED.match(lines[i])
        mark = (frame and (len(frame[1]) > 3 or said[i] or forwards[i])) or (forwards[i] and nxt < n and (depth[nxt] or _HEAD.match(lines[nxt])))
        if mark or (fields >= 2 and (i == 0 or blank[i - 1] or _RULE.match(lines[i - 1]))):
            start = i - 1 if i and _RULE.match(lines[i - 1]) else i
            break
    for i in range(start, n):
        flag[i]["after_forward"] = 1
    # introductions of quotes, perhaps over two lines; without marked lines below, all that follows is the quote
    for i in range(top, n):
        if depth[i] or blank[i] or not lines[i].rstrip().endswith(":"):
            continue
        joined = i and not blank[i - 1] and not depth[i - 1] and _DATED.search(lines[i - 1]) and not _SENTENCE_END.search(lines[i - 1]) and not flag[i - 1].get("header")
        two = joined and (wording.roles(f"{lines[i - 1].strip()} {lines[i].strip()}")[0] or (said[i] and not _DATED.search(lines[i])))
        if not (two or (said[i] and len(lines[i].split()) <= 14)):
            continue
        shown = i + 1 < n and depth[i + 1]
        for k in (i - 1, i)[1 - bool(two) :]:
            flag[k] |= {"introduction": 1, "shown": 1} if shown else {"introduction": 1}
        after = following(blank, i, n)
        if after < n and not depth[after] and not any(depth[j] for j in range(after, min(n, after + 3))) and not any(depth):
            for j in range(after, n):
                flag[j]["after_forward"] = 1
    # lines that a quote's rewrapping has cut off
    for i in range(1, n):
        if depth[i] or blank[i] or blank[i - 1] or flag[i] or not (depth[i - 1] or flag[i - 1].get("continuation")):
            continue
        before = body[i - 1].rstrip()
        low = lines[i].lstrip()[:1].islower()
        j = i
        while j < n and not blank[j] and not depth[j]:
            j += 1
        between = j < n and not blank[j] and depth[j] > 0
        short = len(lines[i].split()) <= 4
        if (between and j - i <= 2 and (low or short) and not _SENTENCE_END.search(before)) or (between and j - i == 1 and short) or (low and before and not _SENTENCE_END.search(before)):
            flag[i]["continuation"] = 1
    # notices, by paragraph: from the first line that is worded so to the end of its run; below a signature their place shows them
    marked = [k for k in range(1, n) if not depth[k] and not blank[k] and (_RULE.match(lines[k]) or _DELIMITER.match(lines[k]) or (_NAME.match(lines[k]) and (closes[k - 1] or (k > 1 and blank[k - 1] and closes[k - 2]))))]
    signed = marked[0] if marked else n
    i = 0
    while i < n:
        if blank[i] or depth[i]:
            i += 1
            continue
        j = i
        while j < n and not blank[j] and not depth[j]:
            j += 1
        k = i
        while k < j:
            if notes[k]:
                last = max(x for x in range(k, j) if notes[x])
                if sum(notes[k : last + 1]) * 2 > last + 1 - k:
                    while last + 1 < j and not _SENTENCE_END.search(lines[last]) and not closes[last + 1] and not _NAME.match(lines[last + 1]):
                        last += 1
                    for x in range(k, last + 1):
                        flag[x] |= {"notice": 1, "shown": 1} if signed < k else {"notice": 1}
                    k = last
            k += 1
        i = j
    # signatures: from a delimiter, a rule or a closing formula to the end of the paragraph, and the names after it
    own = [i for i in range(n) if not depth[i]]
    for i in own:
        if blank[i] or flag[i].get("header"):
            continue
        line = lines[i]
        rule, delimiter, closing = bool(_RULE.match(line)), bool(_DELIMITER.match(line)), bool(closes[i])
        if rule:
            flag[i]["rule"] = 1
        if _CELLS.match(line) and line.count("|") == 2:
            flag[i]["cells"] = 1
        if closing:
            flag[i]["closing"] = 1
        if not (rule or delimiter or closing):
            continue
        if closing and i + 1 < n and blank[i + 1]:
            nxt = following(blank, i, n)
            if nxt >= n or depth[nxt] or not _NAME.match(lines[nxt]):
                continue
            begin = nxt
        else:
            begin = i
        shown = rule or delimiter or (begin + (begin == i) < n and bool(_NAME.match(lines[begin + (begin == i)])))
        if closing and shown:
            flag[i]["shown"] = 1
        j = begin
        while j < n and not blank[j] and not depth[j] and not flag[j].get("introduction"):
            flag[j] |= {"in_signature": 1, "shown": 1} if shown else {"in_signature": 1}
            j += 1
    for i in own:  # a paragraph that is just a name, or the last line of one
        if blank[i] or flag[i].get("in_signature") or flag[i].get("after_forward") or not _NAME.match(lines[i]):
            continue
        ends = i + 1 >= n or blank[i + 1] or depth[i + 1] or flag[i + 1].get("notice") or flag[i + 1].get("in_signature")
        alone = i == 0 or blank[i - 1]
        before = next((j for j in range(i - 1, -1, -1) if not blank[j]), -1)
        dash = lines[i].lstrip()[:1] in "-–—/"
        full = before >= 0 and _SENTENCE_END.search(lines[before])
        if ends and before >= 0 and not flag[before].get("header") and (dash or ((alone or full) and not lines[i].rstrip().endswith("."))):
            flag[i] |= {"name": 1, "in_signature": 1}
    return depth, flag


def line_key(line: str) -> int:
    """A 64-bit hash of a line's words, whatever its marks, spacing and case."""
    return int.from_bytes(hashlib.blake2b(" ".join(re.findall(r"\w+", line.lower())).encode(), digest_size=8).digest(), "little", signed=True)


def blocks_of(text: str, wording: Wording) -> list[tuple[list[int], list[int], list[float], int]]:
    """(line numbers from 1, line keys, features without the corpus counts, weak label: 1 new, 0 not, -1 unclear) of every block."""
    lines = [x.rstrip("\r") for x in text.split("\n")]
    depth, flag = make_up(lines, wording)
    runs: list[list[int]] = []
    kind = None
    for i, x in enumerate(lines):
        if not x.strip():
            kind = None
            continue
        now = (min(depth[i], 1), tuple(sorted(k for k in flag[i] if k != "shown")))
        if now != kind:
            runs.append([])
        runs[-1].append(i)
        kind = now
    out, quoted = [], 0
    for run in runs:
        f, own = flag[run[0]], [lines[i] for i in run]
        words = [w for x in own for w in x.split()]
        d = max(depth[i] for i in run)
        ends = sum(bool(_SENTENCE_END.search(x)) for x in own)
        contacts = sum(bool(_CONTACT.search(x)) for x in own) / len(run)
        flagged = any(f.get(k) for k in ("header", "after_forward", "introduction", "in_signature", "notice", "continuation", "closing"))
        shown = d > 0 or any(f.get(k) for k in ("header", "after_forward", "continuation")) or any(flag[i].get("shown") for i in run)
        row = [
            d, f.get("header", 0), f.get("after_forward", 0), f.get("introduction", 0), f.get("closing", 0), f.get("in_signature", 0), f.get("notice", 0), f.get("rule", 0), f.get("cells", 0),
            f.get("continuation", 0), contacts, len(run), len(words), len(words) / len(run), ends / len(run), sum(w[:1].isupper() for w in words) / max(len(words), 1), f.get("name", 0),
            np.log1p(len(lines) - run[-1] - 1), quoted,
        ]
        bare = len(words) <= 2 and not re.search(r"[^\w\s/–—-]", " ".join(own))  # a name or initials, in any case
        label = 0 if shown or bare else -1 if flagged else 1 if ends or len(words) >= 3 or own[-1].rstrip().endswith((",", ":")) else -1
        out.append(([i + 1 for i in run], [line_key(stripped(x)[1]) for x in own], [float(v) for v in row], label))
        quoted = int(d > 0)
    return out


_FROM = re.compile(r"^(?:From|Von|De):[^\n]*?([\w.+-]+@[\w.-]+)", re.M)


class BoostedTrees:
    """Gradient-boosted trees for two classes over binned features, with logistic loss."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 40, levels: int = 5, rate: float = 0.3, bins: int = 32, weight: float = 1.0) -> None:
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        b, n = self._binned(x), len(x)
        f, self.trees = np.zeros(n), []
        for _ in range(trees):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            node, tree = np.zeros(n, int), []
            for level in range(levels):
                size, width = 2**level, bins + 1
                best = (np.full(size, 1e-3), np.full(size, -1), np.zeros(size, int))
                for k in range(x.shape[1]):
                    at = node * width + b[:, k]
                    gs, hs = (np.bincount(at, v, size * width).reshape(size, width).cumsum(1) for v in (g, h))
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + weight) + (gt - gs) ** 2 / (ht - hs + weight) - gt**2 / (ht + weight)
                    c = gain.argmax(1)
                    top = gain[np.arange(size), c]
                    better = top > best[0]
                    best[0][better], best[1][better], best[2][better] = top[better], k, c[better]
                tree.append(best[1:])
                k = best[1][node]
                node = 2 * node + ((k >= 0) & (b[np.arange(n), k] > best[2][node]))
            value = np.bincount(node, g, 2**levels) / (np.bincount(node, h, 2**levels) + weight) * rate
            self.trees.append((tree, value))
            f += value[node]

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, k], "left") for k, c in enumerate(self.cuts)], 1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        b, rows, f = self._binned(x), np.arange(len(x)), np.zeros(len(x))
        for tree, value in self.trees:
            node = np.zeros(len(x), int)
            for feature, cut in tree:
                k = feature[node]
                node = 2 * node + ((k >= 0) & (b[rows, k] > cut[node]))
            f += value[node]
        return 1 / (1 + np.exp(-f))


def learned_wording(texts: DataFrame) -> Wording:
    """The wording of a sample of mails that hashes of their ids draw."""
    rows = texts.where(F.length("text") <= LENGTH).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAILS).select("text").collect()
    return Wording().fit([[x.rstrip("\r") for x in r["text"].split("\n")] for r in rows])


def blocks(texts: DataFrame, wording: Wording) -> DataFrame:
    """(doc_id, block, sender, lines, keys, x, label) of every block of every mail (doc_id, text)."""
    shared = texts.sparkSession.sparkContext.broadcast(wording)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 500):
                rows = []
                for i, t in zip(b["doc_id"].iloc[at : at + 500], b["text"].iloc[at : at + 500]):
                    m = _FROM.search(t)
                    rows += [(i, k, m[1].lower() if m else "", *x) for k, x in enumerate(blocks_of(t, shared.value))]
                yield pd.DataFrame(rows, columns=["doc_id", "block", "sender", "lines", "keys", "x", "label"])

    return texts.mapInPandas(run, "doc_id long, block int, sender string, lines array<int>, keys array<long>, x array<double>, label int")


def met(rows: DataFrame, counts: DataFrame, keys: list[str], size: str) -> DataFrame:
    """Left join of rows and counts on keys: the HEAVY largest counts are broadcast, so no hot key goes to one task."""
    heavy = kept(counts.orderBy(F.desc(size), *keys).limit(HEAVY))
    hot = rows.join(F.broadcast(heavy), keys, "inner")
    cold = rows.join(F.broadcast(heavy.select(keys)), keys, "left_anti").join(counts, keys, "left")
    return hot.unionByName(cold)


def with_counts(found: DataFrame) -> DataFrame:
    """Appends to x: mails of the same sender with the block's line (log, most), share of lines in other mails, mails with the line (log, most).

    Mails without a sender have no common one.
    """
    lines = found.select("doc_id", "block", "sender", F.explode("keys").alias("key"))
    by_sender = kept(lines.groupBy("sender", "key", "doc_id").agg(F.lit(1)).groupBy("sender", "key").agg(F.count(F.lit(1)).alias("mine")))
    of_key = by_sender.groupBy("key").agg(F.sum("mine").alias("all")).where(F.col("all") > 1)  # a line of one mail counts 1 and needs no row
    counts = met(by_sender, kept(of_key), ["key"], "all").where(F.col("all").isNotNull())
    counts = kept(counts.select("sender", "key", F.when(F.col("sender") == "", 1).otherwise(F.col("mine")).alias("mine"), "all"))
    joined = met(lines, counts, ["sender", "key"], "all")
    sums = joined.groupBy("doc_id", "block").agg(F.max("mine").alias("mine"), F.avg(F.when(F.col("all") > 1, 1.0).otherwise(0.0)).alias("elsewhere"), F.max("all").alias("all"))
    more = F.array(F.log(F.coalesce("mine", F.lit(1)).cast("double")), F.col("elsewhere"), F.log(F.coalesce("all", F.lit(1)).cast("double")))
    return found.join(sums, ["doc_id", "block"]).withColumn("x", F.concat("x", more))


def new_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no): the non-blank lines, counted from 1, that the sender wrote for this message; each id once.

    Null, empty and blank texts give no row; long texts are read whole. The greatest text of an id holds.
    """
    out = "doc_id long, line_no int"
    texts = kept(texts_of(docs))
    full = kept(with_counts(written(blocks(texts, learned_wording(texts)))))
    # a longer line that comes back at the end of mails may be a notice that no place shows
    unclear = (F.col("label") == 1) & (F.element_at("x", -1) > 1.0) & (F.get("x", F.lit(NAMES.index("from_end"))) < 1.0) & (F.get("x", F.lit(NAMES.index("words"))) > 3)
    sample = full.where((F.col("label") >= 0) & ~unclear).select("x", "label").orderBy(F.xxhash64("doc_id", "block")).limit(SAMPLE).collect()
    if not sample:
        return docs.sparkSession.createDataFrame([], out)
    shared = docs.sparkSession.sparkContext.broadcast(BoostedTrees(np.array([r["x"] for r in sample]), np.array([r["label"] for r in sample], float)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yes = b[shared.value.probability(np.stack(b["x"].to_numpy())) >= 0.5]
                yield pd.DataFrame({"doc_id": yes["doc_id"].repeat(yes["lines"].str.len()).to_numpy(), "line_no": np.concatenate([np.zeros(0, np.int32), *yes["lines"]])})

    return full.select("doc_id", "lines", "x").mapInPandas(run, out)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return new_lines(table(spark, sf_dir, "docs"))


QUERIES = {"p4_found": p4_found}
SQL: dict[str, str] = {}
