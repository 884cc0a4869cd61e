"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

Folding lower-cases, maps homoglyphs and digit substitutions to Latin letters, drops invisible characters and makes
every other mark a space, so terms start at a space. A term is a word or the start of words. Its weight is the log
ratio of its document rates in toxic and in clean training rows. Exception phrases (a term with its neighbour that
clean rows have and toxic ones don't) switch off the terms they hold. The sum of weights over a power of the text's
length goes through a logistic curve.

fit() learns from at most SAMPLE_PER_CLASS labelled rows of each class, chosen by a hash of their ids; scoring reads
whole texts of all rows. The lexicon holds at most MAX_TERMS terms and MAX_PHRASES phrases, so the model that goes to
the executors is bounded. Null and empty texts score as texts without terms. Repeated rows score alike. Without
usable labels of both classes, or terms that tell them apart, every row scores 0 or nearly so.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise

#: Labelled rows of each class that a model is fitted on, at most.
SAMPLE_PER_CLASS = 10_000
MAX_TERMS, MAX_PHRASES = 2_000, 500
#: Rows a term must be in, and how many times likelier it must be in toxic rows.
LEAST_ROWS, LEAST_RATIO = 4, 8.0
PREFIXES = (4, 5, 6)
#: The curve's base is this at most: a text without any term is never predicted toxic.
NO_TERM_BASE = -0.1

# Characters that look like Latin letters, and digits and signs written for letters.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "κ": "k", "τ": "t", "υ": "u", "χ": "x", "ε": "e", "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
INVISIBLE = "­​‌‍⁠﻿"
_FULLWIDTH = {chr(0xFF41 + i): chr(97 + i) for i in range(26)}
_MARKS = {chr(i): " " for i in range(128) if not chr(i).isalnum()} | {c: " " for c in " –—‘’“”…«»¿¡  "}
_FOLD = str.maketrans(_MARKS | SUBSTITUTES | HOMOGLYPHS | _FULLWIDTH | dict.fromkeys(INVISIBLE))


def fold(text: str) -> str:
    return f" {text.lower().translate(_FOLD)} "


@dataclass(frozen=True)
class Model:
    terms: dict[str, float] = field(default_factory=dict)  # " start of a word" or " word "
    phrases: tuple[str, ...] = ()  # " word word "
    power: float = 0.5
    slope: float = 0.0
    base: float = -50.0

    def __hash__(self):
        return hash((frozenset(self.terms.items()), self.phrases))


@lru_cache(4)
def _matcher(model: Model):
    import ahocorasick

    found = ahocorasick.Automaton()
    for t, w in model.terms.items():
        found.add_word(t, (len(t), w))
    for p in model.phrases:
        found.add_word(p, (len(p), None))
    if len(found):
        found.make_automaton()
    return found


def _hits(model: Model, folded: str) -> list[tuple[int, int, float]]:
    """(start, end, weight) of terms outside exception phrases; at one place the longest term counts."""
    matcher = _matcher(model)
    if not len(matcher):
        return []
    terms: dict[int, tuple[int, float]] = {}
    free = []
    for last, (n, weight) in matcher.iter(folded):
        start = last + 1 - n
        if weight is None:
            free.append((start, last + 1))
        else:
            terms[start] = (last + 1, weight)  # ends come in order: the longest is last
    return [(s, e, w) for s, (e, w) in terms.items() if not any(a <= s and e <= b for a, b in free)]


def statistic(model: Model, text: str) -> float:
    folded = fold(text)
    said = Counter((folded[s:e], w) for s, e, w in _hits(model, folded))
    return sum(w * (1 + math.log(n)) for (_, w), n in sorted(said.items())) / (len(text) / 100 + 1) ** model.power if said else 0.0


def _score(model: Model, text: str) -> float:
    z = model.base + model.slope * statistic(model, text)
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def held_out(key: str = "doc_id"):
    """Rows whose label a model must not learn from."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0


def _signature(text: str) -> int:
    """The least hash of a text's three-word shingles: near copies mostly share it, other texts hardly ever."""
    import xxhash

    words = text.lower().split()
    shingles = zip(words, words[1:], words[2:], strict=False) if len(words) > 2 else [words]
    return min(xxhash.xxh64_intdigest(" ".join(s)) for s in shingles) - (1 << 63)


def _signed(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([_signature(t) for t in batch.column(0).to_pylist()], pa.int64())], ["text", "toxic", "sig"])


def training_sample(df: DataFrame, labels: DataFrame, per_class: int) -> DataFrame:
    """(text, toxic) of at most per_class labelled rows of each class, one of near copies: many copies of a text would
    make all its words look telling. Several labels of one id: the highest counts."""
    known = labels.where(~held_out() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id")
    chosen = known.where("toxic = 1").orderBy(order, "doc_id").limit(per_class).unionByName(known.where("toxic = 0").orderBy(order, "doc_id").limit(per_class))
    # 2 * per_class ids of 12 bytes at most: always small enough to send to every executor
    rows = df.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), F.col("toxic").cast("int").alias("toxic"))
    return rows.mapInArrow(_signed, "text string, toxic int, sig long").groupBy("sig", "toxic").agg(F.min("text").alias("text")).select("text", "toxic")


def _counted(sample: DataFrame, features) -> DataFrame:
    """(feature, toxic, clean): rows of each class with a feature; features(text) gives a row's set."""

    def run(batches):
        seen: Counter = Counter()

        def out():
            names = list({f for f, _ in seen})
            made = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([seen[n, c] for n in names], pa.int64()) for c in (1, 0))], ["feature", "toxic", "clean"])
            seen.clear()
            return made

        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen.update((f, toxic) for f in features(text))
                if len(seen) > 200_000:
                    yield out()
        yield out()

    return sample.mapInArrow(run, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _word_features(text: str) -> set[str]:
    words = set(fold(text).split())
    found = {f" {w[:n]}" for n in PREFIXES for w in words if len(w) > n}
    found.update(f" {w} " for w in words if len(w) <= 40)
    found.add("")  # counts rows
    return found


def _phrase_features(model: Model):
    def features(text: str) -> set[str]:
        folded, found = fold(text), set()
        for start, end, _ in _hits(model, folded):
            stop = folded.index(" ", end - 1)
            word = folded[start:stop].strip()
            before, after = folded[max(0, start - 60) : start].split(), folded[stop : stop + 60].split()
            found.update([f" {before[-1]} {word} "] if before else [])
            found.update([f" {word} {after[0]} "] if after else [])
        return found

    return features


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float, float]:
    """(base, slope, loss) of a weighted, slightly damped logistic curve by Newton steps."""
    b, damp = np.zeros(2), np.array([1e-3, 1e-3])
    design = np.column_stack([np.ones_like(x), x])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(design @ b, -30, 30)))
        grad = design.T @ (w * (y - p)) - damp * b
        step = np.linalg.solve(design.T @ (design * (w * p * (1 - p) + 1e-9)[:, None]) + np.diag(damp), grad)
        b = b + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    p = np.clip(1 / (1 + np.exp(-np.clip(design @ b, -30, 30))), 1e-9, 1 - 1e-9)
    return float(b[0]), float(b[1]), float(-(w * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum())


def fit(df: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Model:
    sample = materialise(training_sample(df, labels, per_class), "toxicity-sample")
    counts = materialise(_counted(sample, _word_features), "toxicity-terms")
    row = counts.where("feature = ''").first()
    toxic, clean = (row["toxic"], row["clean"]) if row else (0, 0)
    if not toxic or not clean:
        discard(sample, counts)
        return Model()
    rate = lambda c, n: (F.col(c) + 0.5) / (n + 1)
    weight = F.log(rate("toxic", toxic) / rate("clean", clean))
    rows = counts.where(F.col("feature") != "").withColumn("w", weight).where((F.col("toxic") >= LEAST_ROWS) & (F.col("w") >= math.log(LEAST_RATIO))).orderBy(F.desc(F.col("w") * F.sqrt("toxic")), "feature").limit(MAX_TERMS).collect()
    terms: dict[str, float] = {}
    for f, w in sorted(((r["feature"], r["w"]) for r in rows), key=lambda x: (len(x[0]), x[0])):
        if not any(f[:n] in terms for n in range(1, len(f))):  # a shorter start says it already
            terms[f] = w
    model = Model(terms)
    phrases = _counted(sample, _phrase_features(model)).where(F.col("clean") >= LEAST_ROWS).where(F.col("clean") / clean >= LEAST_RATIO * F.col("toxic") / toxic).orderBy(F.desc("clean"), "feature").limit(MAX_PHRASES).collect()
    model = Model(terms, tuple(r["feature"] for r in phrases))

    powers = (0.0, 0.5, 1.0)

    def measure(batches):
        for batch in batches:
            texts = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([*(pa.array([statistic(Model(terms, model.phrases, p), t) for t in texts], pa.float64()) for p in powers), batch.column(1).cast(pa.int32())], ["a", "b", "c", "toxic"])

    seen = sample.mapInArrow(measure, "a double, b double, c double, toxic int").collect()  # of the bounded sample
    y = np.array([r["toxic"] for r in seen], float)
    w = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum())) * len(y)
    fits = [(*_logistic(np.array([r[i] for r in seen]), y, w), p) for i, p in enumerate(powers)]
    base, slope, _, power = min(fits, key=lambda f: f[2])
    discard(sample, counts)
    if not terms or slope <= 0:
        return Model()
    return Model(terms, model.phrases, power, slope, min(base, NO_TERM_BASE))


def score(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, score, predicted) of every row."""

    def run(batches):
        for batch in batches:
            scores = np.array([_score(model, t.as_py() or "") for t in batch.column(1)], float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32))], [key, "score", "predicted"])

    scored = df.select(key, text).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, score double, predicted int")
    return scored.select(key, held_out(key).alias("held_out"), "score", "predicted")


def keep_clean(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows that are not predicted toxic, all columns as they were."""

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            yield batch.filter(pa.array([_score(model, t.as_py() or "") < 0.5 for t in texts], pa.bool_()))

    return df.mapInArrow(run, df.schema)
