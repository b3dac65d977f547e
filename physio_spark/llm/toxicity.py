"""Toxicity by a weighted lexicon that is matched in one Aho-Corasick pass over the folded text.

Folding undoes disguises: full-width forms, stray marks, look-alike letters of other scripts, invisible
characters, and digits or signs that stand for letters inside a word.  Lexicon entries are whole words
or word beginnings ("stems") with the log odds of being found in toxic rather than clean documents.
Hits inside an exception phrase (two neighbouring words that clean documents use) do not count.  The sum
of the weights, as it is and per word, goes through a logistic curve.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Shared, refuse, unit

STEMS = (3, 4, 5, 6, 7)
# Letters of other scripts that look like Latin ones.
LOOK_ALIKES = dict(
    zip(
        "абвгԁеһіјкӏмпорԛѕтυѵԝхуʏɑαβεηικνορτχωϲϳıℓøłđ",
        "abvgdehijklmnopqstuvwxyyaabenikvoptxwcjilold",
        strict=True,
    )
)
# Digits and signs that stand for a letter inside a word.
STAND_INS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l"})
INVISIBLE = "­​‌‍⁠﻿"
_L = "a-zà-ÿ"
INSIDE = re.compile(rf"(?<=[{_L}])[01345789@$!|]+(?=[{_L}])|(?<![{_L}0-9])[01345789@$]+(?=[{_L}])|(?<=[{_L}])[0134578](?![{_L}0-9])")
RARE = re.compile("[^\x00-\x7fÀ-ÿ‐-‧]")


def _letters() -> dict[int, str | None]:
    """Latin letters with rare marks to their base, by their decomposition; those of à to ÿ tell words apart and stay."""
    out: dict[int, str | None] = {}
    for cp in (*range(0x100, 0x250), *range(0x1E00, 0x1F00)):
        base = unicodedata.normalize("NFKD", chr(cp))[0]
        if base != chr(cp) and base.isascii():
            out[cp] = base.lower()
    return out | {ord(c): base for c, base in LOOK_ALIKES.items()} | {ord(c): None for c in INVISIBLE}


LETTERS = _letters()
WORDS = bytes(c if chr(c).isalpha() and c < 128 or c >= 128 else 32 for c in range(256))


def fold(text: str) -> str:
    """Lower-case words of plain letters, each with one blank before it, and a blank at the end."""
    text = text.lower()
    if not text.isascii():
        if RARE.search(text):
            text = unicodedata.normalize("NFKC", text).lower()
            text = "".join(c for c in text if not unicodedata.combining(c))
        text = text.translate(LETTERS)
    text = INSIDE.sub(lambda m: m.group().translate(STAND_INS), text)
    words = text.encode("utf-8", "ignore").translate(WORDS).split()
    return f" {b' '.join(words).decode()} " if words else " "


@dataclass
class Lexicon:
    """Weights by entry: `` word `` is a whole word, `` stem`` a word's beginning; phrases that excuse; the curve."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: set[str] = field(default_factory=set)
    curve: tuple[float, float, float] = (-4.0, 0.0, 0.0)

    def automaton(self) -> ahocorasick.Automaton | None:
        found = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            found.add_word(entry, (len(entry), weight, None))
        for phrase in self.exceptions:
            found.add_word(phrase, (len(phrase), 0.0, phrase))
        if not len(found):
            return None
        found.make_automaton()
        return found


def hits(folded: str, automaton: ahocorasick.Automaton | None) -> dict[int, tuple[int, float]]:
    """Length and weight of the longest entry that begins at a word, by the place of the blank before it."""
    best: dict[int, tuple[int, float]] = {}
    excused: set[int] = set()
    for end, (length, weight, phrase) in automaton.iter(folded) if automaton else ():
        start = end - length + 1
        if phrase is not None:
            excused.update((start, start + phrase.index(" ", 1)))
        elif best.get(start, (0, 0.0))[0] < length:
            best[start] = (length, weight)
    for start in excused:
        best.pop(start, None)
    return best


def measures(text: str | None, automaton: ahocorasick.Automaton | None) -> tuple[float, float, int]:
    """Log of the summed weights, log of their sum per hundred words, number of hits."""
    if not text:
        return 0.0, 0.0, 0
    folded = fold(text)
    found = hits(folded, automaton)
    total = sum(w for _, w in found.values())
    words = folded.count(" ") - 1
    return math.log1p(total), math.log1p(100 * total / max(words, 1)), len(found)


def _features(folded: str) -> set[str]:
    words = set(folded.split())
    out = {f" {w} " for w in words}
    for n in STEMS:
        out.update(f" {w[:n]}" for w in words if len(w) > n)
    return out


def _phrases(folded: str, automaton: ahocorasick.Automaton) -> set[str]:
    out = set()
    for start in hits(folded, automaton):
        end = folded.index(" ", start + 1)
        before = folded.rfind(" ", 0, start)
        after = folded.find(" ", end + 1)
        if before >= 0:
            out.add(folded[before : end + 1])
        if after >= 0:
            out.add(folded[start : after + 1])
    return out


def _odds(rows: DataFrame, features) -> DataFrame:
    """For every feature the toxic (n1) and clean (n0) documents that hold it, in either half of the sample."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = [Counter() for _ in range(4)]

        def flush() -> pd.DataFrame:
            names = list(set().union(*seen))
            counts = {c: [seen[k][x] for x in names] for k, c in enumerate(("a0", "a1", "b0", "b1"))}
            for c in seen:
                c.clear()
            return pd.DataFrame({"f": pd.Series(names, dtype=object)} | counts)

        for frame in frames:
            for text, toxic, half in zip(frame["t"], frame["y"], frame["half"], strict=True):
                seen[2 * half + toxic].update(features(fold(text)))
                if sum(map(len, seen)) > 200_000:
                    yield flush()
        yield flush()

    counts = rows.mapInPandas(count, "f string, a0 long, a1 long, b0 long, b1 long")
    return counts.groupBy("f").agg(*[F.sum(c).alias(c) for c in ("a0", "a1", "b0", "b1")])


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Ridge logistic regression by Newton's steps."""
    a, w = np.column_stack([np.ones(len(x)), x]), np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(3), a.T @ (y - p) - 1e-2 * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(map(float, w))


def fit(labelled: DataFrame, key: str, text: str, toxic: str, max_rows: int = 20_000, max_entries: int = 20_000) -> Lexicon:
    """Learn lexicon, exceptions and curve from rows with a text and a 0/1 label.

    The fit is bounded: of more than ``max_rows`` rows about that many are taken, by a hash of their key.
    Each half of them is measured by the lexicon of the other half to learn the curve; the lexicon
    that is returned comes from both.  An entry must be found in so many toxic
    documents that chance would hardly do it once among all features; the ``max_entries`` heaviest stay.
    Without toxic or without clean rows nothing is learned, and every score is that of a clean text.
    """
    rows = labelled.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(toxic).cast("int").alias("y")).dropna().where("y in (0, 1)")
    return fit_sample(rows.where(unit(F.col("k")) < min(1.0, max_rows / max(rows.count(), 1))), max_entries)


def _heaviest(odds: DataFrame, n1: Column, n0: Column, toxic: int, clean: int, kinds: int, most: int) -> dict[str, float]:
    """Entries that chance would hardly find so often in toxic documents, with their log odds."""
    if not toxic or not clean:
        return {}
    least = max(3, math.ceil(math.log(max(kinds, 2)) / math.log((toxic + clean) / toxic)))
    weight = F.log((n1 + 0.5) / (toxic + 1)) - F.log((n0 + 0.5) / (clean + 1))
    found = odds.where(n1 >= least).select("f", weight.alias("w"), (n1 > 4 * n0).alias("ok")).where("ok and w >= 2.5")
    top = found.orderBy(F.desc("w"), "f").limit(most).toPandas()
    return dict(zip(top["f"], top["w"].astype(float), strict=True))


def _measured(rows: DataFrame, halves: list[Lexicon]) -> pd.DataFrame:
    """The two measures of every row under the lexicon of the half that it does not belong to."""
    shared = Shared(rows.sparkSession, halves, lambda both: [x.automaton() for x in both])

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            both = [measures(t, shared.get()[1 - half])[:2] for t, half in zip(frame["t"], frame["half"], strict=True)]
            yield pd.DataFrame({"a": [x for x, _ in both], "b": [x for _, x in both], "y": frame["y"]})

    return rows.mapInPandas(measure, "a double, b double, y int").toPandas()


def fit_sample(rows: DataFrame, max_entries: int = 20_000) -> Lexicon:
    """Learn from rows ``k, t, y`` that already are within a bound."""
    half = F.pmod(F.xxhash64(F.col("k").cast("string"), F.lit("half")), F.lit(2)).cast("int")
    sample = rows.withColumn("half", half).persist()
    size = {(r["half"], r["y"]): r["count"] for r in sample.groupBy("half", "y").count().collect()}
    a0, a1, b0, b1 = (size.get(x, 0) for x in ((0, 0), (0, 1), (1, 0), (1, 1)))
    if not (a0 + b0) or not (a1 + b1):
        sample.unpersist()
        return Lexicon()
    odds = _odds(sample, _features).where("a1 + b1 >= 2").persist()
    kinds = odds.count()
    col = F.col
    every = Lexicon(_heaviest(odds, col("a1") + col("b1"), col("a0") + col("b0"), a1 + b1, a0 + b0, kinds, max_entries))
    halves = [
        Lexicon(_heaviest(odds, col("a1"), col("a0"), a1, a0, kinds, max_entries)),
        Lexicon(_heaviest(odds, col("b1"), col("b0"), b1, b0, kinds, max_entries)),
    ]
    if every.weights:
        shared = Shared(rows.sparkSession, every, Lexicon.automaton)
        phrases = _odds(sample, lambda folded: _phrases(folded, shared.get()))
        clean = phrases.where("a0 + b0 >= 3 and a0 + b0 > a1 + b1").orderBy(F.desc(col("a0") + col("b0")), "f").limit(max_entries).toPandas()
        every.exceptions = set(clean["f"])
        for one in halves:
            one.exceptions = every.exceptions
        points = _measured(sample, halves)
        every.curve = _logistic(points[["a", "b"]].to_numpy(), points["y"].to_numpy(float))
    odds.unpersist()
    sample.unpersist()
    return every


def score(docs: DataFrame, lexicon: Lexicon, key: str = "doc_id", text: str = "text", threshold: float = 0.7) -> DataFrame:
    """``key, score, predicted, n_hits`` of each row, over its whole text, without a shuffle.

    A null or empty text has no hits and gets the score of such a text.  Repeated rows give repeated
    rows; other columns are not looked at, and ``key`` may not have the name of a result column.
    """
    refuse(key, "score", "predicted", "n_hits")
    shared = Shared(docs.sparkSession, lexicon, lambda x: (x.automaton(), x.curve))
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("t"))
    kind = rows.schema["key"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton, (bias, wa, wb) = shared.get()
        for frame in frames:
            found = [measures(t, automaton) for t in frame["t"]]
            p = [1 / (1 + math.exp(-max(-30.0, min(30.0, bias + wa * a + wb * b)))) for a, b, _ in found]
            yield pd.DataFrame({"key": frame["key"], "score": p, "predicted": [int(x >= threshold) for x in p], "n_hits": [n for _, _, n in found]})

    out = rows.mapInPandas(run, f"key {kind}, score double, predicted int, n_hits long")
    return out.withColumnRenamed("key", key)
