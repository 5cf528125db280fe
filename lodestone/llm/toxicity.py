"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text.

The lexicon holds beginnings of words and is learned from labelled rows: of the prefixes that
are common in toxic documents, those are taken that tell the classes apart best (documents that
hold it, times log odds), and none that begins or continues another. Texts are folded before
learning and matching: lower case, homoglyphs to the Latin letters they resemble, digits and signs
to the letters they stand for. Weights of matches at beginnings of words are summed, but for
those inside an exception phrase; the sum, alone and by length, goes through a logistic curve
fitted on the same rows.

Labels are read only for rows that are not held out, and at most MAX_ROWS of them (those with the
smallest hashes of their ids); scores see the text alone.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hidden, pick, shown, small_batches

#: Labelled rows that are fitted on, at most.
MAX_ROWS = 16_000
#: Prefixes that are weighed, and entries that are kept, at most.
MAX_CANDIDATES, MAX_ENTRIES = 20_000, 400
SHORTEST, LONGEST = 3, 12
THRESHOLD = 0.3
MIN_WEIGHT = 2.5

# Letters of other scripts and signs, and the Latin letters they are read as.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m",
    "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԝ": "w", "п": "n",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "ı": "i", "ɡ": "g", "ɑ": "a", "ᴏ": "o", "ꜱ": "s", "ⅼ": "l", "ⅰ": "i",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s"}
#: Phrases in which a word of the lexicon isn't meant as an insult.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "class clown", "pond scum", "sore loser", "idiot proof", "idiot light")

_FULL_WIDTH = {0xFEE0 + c: c for c in range(0x21, 0x7F)}
_INVISIBLE = dict.fromkeys([0xAD, *range(0x200B, 0x2010), 0x2060, 0xFEFF])
_FOLD = _FULL_WIDTH | _INVISIBLE | {ord(a): ord(b) for a, b in (HOMOGLYPHS | SUBSTITUTES).items()}
_WORD = re.compile(r"[^\W\d_]+")


def fold(text: str) -> str:
    return text.lower().translate(_FOLD)


def _prefixes(text: str) -> set[str]:
    out = set()
    for word in set(_WORD.findall(fold(text))):
        out.update(word[:k] for k in range(SHORTEST, min(len(word), LONGEST) + 1))
    return out


@dataclass
class Lexicon:
    """Weights of beginnings of words, and the logistic curve over their sums."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: tuple[float, float, float] = (-6.0, 0.0, 0.0)

    def matcher(self) -> ahocorasick.Automaton | None:
        """One automaton of entries and exception phrases."""
        machine = ahocorasick.Automaton()
        for phrase in map(fold, self.exceptions):
            machine.add_word(phrase, (len(phrase), None))
        for stem, weight in self.weights.items():
            machine.add_word(stem, (len(stem), weight))
        if not len(machine):
            return None
        machine.make_automaton()
        return machine

    def features(self, text: str, machine) -> tuple[float, float]:
        """The log of the sum of the weights, and that of the sum for each hundred words."""
        hits, spared = [], []
        folded = fold(text)
        if machine is not None:
            for end, (length, weight) in machine.iter(folded):
                start = end - length + 1
                if start and folded[start - 1].isalpha():
                    continue
                if weight is None:
                    if end + 1 == len(folded) or not folded[end + 1].isalpha():
                        spared.append((start, end))
                else:
                    hits.append((start, end, weight))
        if spared:
            spared.sort()
            starts, ends = [a for a, _ in spared], list(accumulate((b for _, b in spared), max))
            # of the phrases that begin no later than an entry, the one that reaches furthest holds it or none does
            hits = [h for h in hits if not (k := bisect_right(starts, h[0])) or ends[k - 1] < h[1]]
        total = sum(h[2] for h in hits)
        words = 1 + text.count(" ") + text.count("\n")
        return math.log1p(total), math.log1p(100 * total / words)

    def score(self, a: float, b: float) -> float:
        z = self.curve[0] + self.curve[1] * a + self.curve[2] * b
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def held_out(doc_id: Column) -> Column:
    """Whether a row's labels must stay unseen."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> tuple[float, ...]:
    """Newton's method on a few columns."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, w))


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Lexicon:
    """The lexicon of docs (doc_id, text) by labels (doc_id, toxic) of rows that aren't held out.

    Null texts count as empty; null labels and ids are no labels; of labels that disagree on a doc_id the worst counts.
    Without toxic rows the lexicon is empty and every score is near 0.
    """
    small_batches(docs.sparkSession)
    known = pick(labels, doc_id="long", toxic="int").filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    texts = pick(docs, doc_id="long", text="string")
    # at most max_rows rows of two numbers
    rows = texts.join(F.broadcast(known), "doc_id").select("toxic", F.coalesce("text", F.lit("")).alias("text"))

    def count(wanted: int, only: frozenset[str] | None):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            seen: Counter = Counter()
            n = 0
            for batch in batches:
                for toxic, text in zip(batch["toxic"], batch["text"], strict=True):
                    if (toxic == 1) == bool(wanted):
                        n += 1
                        found = _prefixes(text)
                        seen.update(found if only is None else found & only)
            if n:
                yield pd.DataFrame({"prefix": ["", *seen], "n": [n, *seen.values()]})

        return run

    def counted(wanted: int, only: frozenset[str] | None = None) -> DataFrame:
        return rows.mapInPandas(count(wanted, only), "prefix string, n long").groupBy("prefix").agg(F.sum("n").alias("n"))

    positive = counted(1).orderBy(F.desc("n"), "prefix").limit(MAX_CANDIDATES).collect()
    of = {r["prefix"]: r["n"] for r in positive}
    n_pos = of.pop("", 0)
    of = {p: n for p, n in of.items() if n >= max(3, 0.01 * n_pos)}
    lexicon = Lexicon()
    if not of:
        return lexicon
    against = {r["prefix"]: r["n"] for r in counted(0, frozenset(of)).collect()}  # no more than the candidates
    n_neg = against.pop("", 0)
    weight = {p: math.log((n + 0.5) / (n_pos + 1)) - math.log((against.get(p, 0) + 0.5) / (n_neg + 1)) for p, n in of.items()}
    taken: dict[str, float] = {}
    begins: set[str] = set()
    for p in sorted((p for p in of if weight[p] >= MIN_WEIGHT), key=lambda p: (-of[p] * weight[p], -len(p), p)):
        if p not in begins and not any(p[:k] in taken for k in range(SHORTEST, len(p))) and len(taken) < MAX_ENTRIES:
            taken[p] = weight[p]
            begins.update(p[:k] for k in range(SHORTEST, len(p)))
    lexicon.weights = taken
    got = rows.select("toxic", features_udf(lexicon)("text").alias("f")).select("toxic", "f.a", "f.b").collect()  # max_rows rows of three numbers
    x, y = np.array([[r["a"], r["b"]] for r in got]), np.array([float(r["toxic"] == 1) for r in got])
    lexicon.curve = _logistic(x, y)
    return lexicon


def features_udf(lexicon: Lexicon):
    held: dict[str, object] = {}

    @F.pandas_udf("a double, b double, score double")
    def features(texts: pd.Series) -> pd.DataFrame:
        if "machine" not in held:
            held["machine"] = lexicon.matcher()
        found = [lexicon.features(t or "", held["machine"]) for t in texts]
        return pd.DataFrame([(a, b, lexicon.score(a, b)) for a, b in found], columns=["a", "b", "score"], dtype="float64")

    return features


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs, from its whole text alone.

    Null and empty texts score as texts without entries do; null doc_ids are not held out; repeated rows are each scored.
    """
    lexicon = learn(docs, labels)
    scored = pick(docs, doc_id="long", text="string").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), features_udf(lexicon)("text").score.alias("score"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score under the threshold, with all their columns; no exchange.

    Null and empty texts and null doc_ids stay if texts without entries do; repeated rows stay or go together.
    """
    plain, names, where = hidden(docs)
    scored = plain.withColumn("_score", features_udf(learn(docs, labels))(F.col(where["text"])).score)
    return shown(scored.filter(F.col("_score") < threshold), names)
