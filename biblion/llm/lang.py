"""Language of a text: a naive Bayes classifier over character n-grams, trained here."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable

import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Labelled documents per language, and characters of each, that the classifier is fitted on.
TRAIN_DOCS, TRAIN_CHARS = 400, 600


class CharTable(dict):
    """A table for ``str.translate``: signs the pattern doesn't match become blanks; a sign is looked up once."""

    def __init__(self, kept: str):
        super().__init__()
        self.kept = regex.compile(kept)

    def __missing__(self, code: int) -> str:
        sign = chr(code)
        self[code] = sign if self.kept.match(sign) else " "
        return self[code]

    def __reduce__(self):
        return CharTable, (self.kept.pattern,)


_LETTERS = CharTable(r"[\p{L}']")


def grams(text: str) -> list[str]:
    """Words' n-grams of one to four letters with word edges."""
    out: list[str] = []
    for word in text.lower().translate(_LETTERS).split():
        edged = f"^{word}$"
        out += [edged[i : i + n] for n in (2, 3, 4) for i in range(len(edged) - n + 1)]
        out.append(edged)
    return out


class WordScores(dict):
    """Scores of the words met, each worked out once: a word's sums by language, then its number of known grams."""

    def __init__(self, score: Callable[[str], tuple[tuple[float, ...], int]]):
        super().__init__()
        self.score = score

    def __missing__(self, word: str) -> tuple[float, ...]:
        sums, n = self.score(word)
        self[word] = (*sums, n)
        return self[word]


class LanguageModel:
    def __init__(self, samples: dict[str, list[str]], floor: int = 2):
        counts = {lang: Counter(g for t in texts for g in grams(t)) for lang, texts in samples.items()}
        vocabulary = {g for c in counts.values() for g, n in c.items() if n >= floor}
        self.langs = sorted(counts)
        self.known = WordScores(self.word_score)
        self.weights: dict[str, tuple[float, ...]] = {}
        totals = {lang: sum(c.values()) + len(vocabulary) for lang, c in counts.items()}
        for g in vocabulary:
            logs = [math.log((counts[lang][g] + 1) / totals[lang]) for lang in self.langs]
            mean = sum(logs) / len(logs)
            self.weights[g] = tuple(x - mean for x in logs)

    @classmethod
    def of(cls, parts: tuple[list[str], dict[str, tuple[float, ...]]]) -> LanguageModel:
        """A model from the plain parts that travel to workers."""
        model = cls({})
        model.langs, model.weights = parts
        return model

    def word_score(self, word: str) -> tuple[tuple[float, ...], int]:
        sums, n = [0.0] * len(self.langs), 0
        for g in grams(word):
            w = self.weights.get(g)
            if w:
                n += 1
                for i, x in enumerate(w):
                    sums[i] += x
        return tuple(sums), n

    def scores(self, text: str) -> tuple[list[float], int]:
        """Sums over all words; a word's score is worked out once and kept for the words to come."""
        if len(self.known) > 200_000:
            self.known.clear()
        words = text.lower().translate(_LETTERS).split()
        if not words:
            return [0.0] * len(self.langs), 0
        *sums, n = map(sum, zip(*map(self.known.__getitem__, words), strict=True))
        return sums, n

    def guess(self, text: str, least: int = 12, margin: float = 8.0) -> str | None:
        """The language, or None if too little speaks for it."""
        if not self.langs:
            return None
        sums, n = self.scores(text)
        order = sorted(range(len(sums)), key=lambda i: -sums[i])
        if n < least or len(order) > 1 and sums[order[0]] - sums[order[1]] < margin:
            return None
        return self.langs[order[0]]


def train(docs: DataFrame, per_language: int = TRAIN_DOCS, chars: int = TRAIN_CHARS) -> LanguageModel:
    """Fit on a bounded sample of labelled documents: ``per_language`` of each, drawn by hash."""
    drawn = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        "lang", F.substring("text", 1, chars).alias("text"), F.xxhash64("doc_id").alias("h")
    )
    # Top rows per language by an aggregate with bounded state, not a window over a language.
    few = Window.partitionBy("lang").orderBy("h")
    sparse = drawn.withColumn("b", F.pmod("h", F.lit(64)))
    inner = Window.partitionBy("lang", "b").orderBy("h")
    top = sparse.withColumn("r", F.row_number().over(inner)).where(F.col("r") <= per_language).drop("r")
    rows = top.withColumn("r", F.row_number().over(few)).where(F.col("r") <= per_language).select("lang", "text").collect()
    samples: dict[str, list[str]] = {}
    for r in rows:
        samples.setdefault(r.lang, []).append(r.text)
    return LanguageModel(samples)
