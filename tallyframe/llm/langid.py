"""Language identification in two steps: the family first, then the language within the family.

Both steps are one-versus-one linear support vector machines over hashed byte n-grams (1 to 4 bytes of the lower-case text; square roots of
relative frequencies, so every text has length 1). At each step the class with the most won duels is predicted; equal ones are told apart by margins.
Families are a fixed table; a language outside of it is a family of its own.

The machines are fitted on the driver on about ``per_language`` labelled documents of each language (chosen by a hash of doc_id and text, whole texts):
a bounded sample. Predictions cover every whole text in the tasks that hold it, without a shuffle.

Nulls: a null text, or one without a letter, is ``und`` with score 0; rows with a null lang are not learned from. Repeated rows each get
a row. Without labelled rows everything is ``und``; with one language, that one, with score 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blank_text, remainder_of_id

DIMENSIONS = 1 << 13
PER_LANGUAGE = 400
LONGEST = 4
#: Languages by family.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca"),
    "slavic": ("ru", "uk", "pl", "cs", "bg", "sk"),
    "uralic": ("fi", "et", "hu"),
}
_FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs}


def family_of(lang: str) -> str:
    return _FAMILY_OF.get(lang, lang)


def features(text: str) -> np.ndarray:
    """Square roots of the hashed n-grams' relative frequencies."""
    at = np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), np.uint8)
    counts, code = np.zeros(DIMENSIONS), np.zeros(len(at), np.uint32)
    for n in range(1, LONGEST + 1):
        if len(at) < n:
            break
        code = code[: len(at) - n + 1] * np.uint32(0x01000193) + at[n - 1 :] + np.uint32(n)
        mixed = (code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        counts += np.bincount(mixed >> np.uint32(19), minlength=DIMENSIONS)
    return np.sqrt(counts / max(1.0, counts.sum()))


def fit_svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 30) -> np.ndarray:
    """Weights (the last is the bias) of a linear machine for labels +1 and -1, by dual coordinate descent in a fixed order."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    w, alpha, norm = np.zeros(x.shape[1]), np.zeros(len(x)), (x * x).sum(axis=1)
    order = np.random.default_rng(0)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(x)):
            new = min(max(alpha[i] + (1 - y[i] * (x[i] @ w)) / norm[i], 0.0), cost)
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


class Duels:
    """One-versus-one machines for the classes of ``y``."""

    def __init__(self, x: np.ndarray, y: list[str]):
        self.classes = sorted(set(y))
        labels = np.array(y)
        self.pairs = list(combinations(range(len(self.classes)), 2))
        weights = []
        for a, b in self.pairs:
            mine = np.isin(labels, [self.classes[a], self.classes[b]])
            weights.append(fit_svm(x[mine], np.where(labels[mine] == self.classes[a], 1.0, -1.0)))
        self.weights = np.array(weights).T.astype(np.float32) if weights else None

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class numbers, and the least logistic score (0 to 1) among the winner's duels."""
        n, k = len(x), len(self.classes)
        if self.weights is None:
            return np.zeros(n, int), np.ones(n)
        chance = 1 / (1 + np.exp(-4.0 * (x @ self.weights[:-1] + self.weights[-1])))
        won, worst = np.zeros((n, k)), np.ones((n, k))
        for d, (a, b) in enumerate(self.pairs):
            won[:, a] += chance[:, d] >= 0.5
            won[:, b] += chance[:, d] < 0.5
            worst[:, a] = np.minimum(worst[:, a], chance[:, d])
            worst[:, b] = np.minimum(worst[:, b], 1 - chance[:, d])
        best = np.argmax(won + worst, axis=1)
        return best, worst[np.arange(n), best]


class Model:
    def __init__(self, x: np.ndarray, langs: list[str]):
        families = [family_of(x) for x in langs]
        self.family = Duels(x, families)
        self.within = {}
        for f in self.family.classes:
            mine = [k for k, g in enumerate(families) if g == f]
            self.within[f] = Duels(x[mine], [langs[k] for k in mine])

    def predict(self, x: np.ndarray) -> list[tuple[str, str, float]]:
        """Family, language and score of each row."""
        families, sure = self.family.predict(x)
        out: list = [None] * len(x)
        for f, name in enumerate(self.family.classes):
            rows = np.nonzero(families == f)[0]
            if len(rows):
                langs, score = self.within[name].predict(x[rows])
                for r, lang, s in zip(rows.tolist(), langs.tolist(), (score * sure[rows]).tolist()):
                    out[r] = (name, self.within[name].classes[lang], s)
        return out


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    """A model from (doc_id, text, lang); None if nothing is labelled."""
    known = labelled.where("lang is not null and text is not null")
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    grain = 1 << 20
    share = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(grain, -(-grain * per_language // n))))])
    chosen = known.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(grain)) < share[F.col("lang")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t).astype(np.float32).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(rows, pa.binary())], ["lang", "x"])

    rows = sorted(chosen.select("lang", F.col("text").cast("string")).mapInArrow(run, "lang string, x binary").collect())
    if not rows:
        return None
    return Model(np.stack([np.frombuffer(r.x, np.float32) for r in rows]), [r.lang for r in rows])


def predict(docs: DataFrame, model: Model | None, held_out: Column) -> DataFrame:
    """doc_id, held_out, family, lang_pred and score of every row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some weights of a fixed number a pair of languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            out = [("und", "und", 0.0)] * len(texts)
            lettered = [k for k, t in enumerate(texts) if any(map(str.isalpha, t))] if shared.value else []
            for at in range(0, len(lettered), 256):
                part = lettered[at : at + 256]
                for k, found in zip(part, shared.value.predict(np.stack([features(texts[k]) for k in part]).astype(np.float32))):
                    out[k] = found
            family, lang, score = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(family, pa.string()), pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                ["doc_id", "held_out", "family", "lang_pred", "score"],
            )

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), blank_text().alias("text"))
    return plain.mapInArrow(run, "doc_id long, held_out boolean, family string, lang_pred string, score double")


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """Fit on the documents whose id's remainder of 4 is not 2, predict all."""
    held_out = remainder_of_id(F.col("doc_id"), 4) == 2
    return predict(docs, fit(docs.where(~held_out).select("doc_id", "text", "lang"), per_language), held_out)
