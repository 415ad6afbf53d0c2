"""Language identification by hyperdimensional profiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"
DIMENSIONS, GRAM = 1024, 3
#: Code points are folded into so many letters, each with a vector of its own; letters of one text rarely meet.
LETTERS = 4096
_BITS = 12
TRAINING_FOLD, FOLDS = 2, 4


def letter_vectors(dimensions: int = DIMENSIONS, seed: int = 11) -> np.ndarray:
    """A random vector of ones and minus ones for each letter; number 0 stands for what divides words."""
    return np.random.default_rng(seed).integers(0, 2, (LETTERS, dimensions), dtype=np.int8) * 2 - 1


_LOWER: np.ndarray | None = None


def folded() -> np.ndarray:
    """The letter number of every code point: lower case, 0 for what is no letter."""
    global _LOWER
    if _LOWER is None:
        table = np.zeros(0x110000, dtype=np.int32)
        for c in range(0x110000):
            if (x := chr(c)).isalpha():
                table[c] = 1 + (ord(x.lower()[0]) * 2654435761 >> 7) % (LETTERS - 1)
        _LOWER = table
    return _LOWER


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Letter trigrams of a text and how often they occur; words are divided by one mark, as the text's ends are."""
    letters = folded()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    letters = np.concatenate([[0], letters, [0]])
    letters = letters[(letters > 0) | np.concatenate([[True], letters[:-1] > 0])]
    code = (letters[:-2] << 2 * _BITS | letters[1:-1] << _BITS | letters[2:]).astype(np.int64)
    return np.unique(code, return_counts=True)


class Vectors:
    """Vectors of trigrams: the letters' vectors, turned by their place in the gram, multiplied. Kept while there is room."""

    def __init__(self, dimensions: int, most: int = 40_000):
        base = letter_vectors(dimensions)
        self.turned = [np.roll(base, GRAM - 1 - k, axis=1) for k in range(GRAM)]
        self.rows = np.empty((most, dimensions), np.int8)
        self.codes, self.slots = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        """Rows for sorted distinct codes, no more than there is room for."""
        at = np.searchsorted(self.codes, codes)
        known = np.zeros(len(codes), dtype=bool)
        inside = at < len(self.codes)
        known[inside] = self.codes[at[inside]] == codes[inside]
        if not known.all():
            if len(self.codes) + (~known).sum() > len(self.rows):
                self.codes, self.slots, known = self.codes[:0], self.slots[:0], np.zeros(len(codes), dtype=bool)
            new = codes[~known]
            parts = [self.turned[k][new >> _BITS * (GRAM - 1 - k) & LETTERS - 1] for k in range(GRAM)]
            slots = np.arange(len(self.codes), len(self.codes) + len(new))
            self.rows[slots] = parts[0] * parts[1] * parts[2]
            where = np.searchsorted(self.codes, new)
            self.codes, self.slots = np.insert(self.codes, where, new), np.insert(self.slots, where, slots)
            at = np.searchsorted(self.codes, codes)
        return self.rows[self.slots[at]]

    def bundle(self, codes: np.ndarray, counts: np.ndarray, block: int = 4096) -> np.ndarray:
        out = np.zeros(self.rows.shape[1])
        for k in range(0, len(codes), block):  # whole numbers below 2^24 add up exactly
            out += counts[k : k + block].astype(np.float32) @ self(codes[k : k + block]).astype(np.float32)
        return out


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that are never learned from."""
    remainder = F.pmod(F.crc32(F.encode(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), "UTF-8")), F.lit(FOLDS))
    return remainder == TRAINING_FOLD


def profiles(rows: DataFrame, dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """One prototype per language: the sum of the vectors of all its training texts' trigrams.

    Every task sends one partial vector per language it has met; Spark adds them, so one language may hold any share of
    the rows. The driver gets one vector per language.
    """

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        vectors = Vectors(dimensions)
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                for at in range(0, len(texts), 64):
                    codes, n = grams(" ".join(texts.iloc[at : at + 64]))
                    sums[lang] = sums.get(lang, 0) + vectors.bundle(codes, n)
        for lang, total in sums.items():
            yield pd.DataFrame({"lang": lang, "place": np.arange(dimensions), "value": total})

    known = rows.where("lang IS NOT NULL AND text IS NOT NULL").where(~F.col("held_out")).select("lang", "text")
    parts = known.mapInPandas(learn, "lang string, place int, value double")
    table = parts.groupBy("lang", "place").agg(F.sum("value").alias("value")).toPandas()
    found = {}
    for lang, part in table.groupby("lang"):
        vector = part.sort_values("place")["value"].to_numpy()
        if np.any(vector):
            found[lang] = vector / np.linalg.norm(vector)
    return found


def identify(docs: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """The language of every whole text: the prototype nearest by cosine.

    A trigram's vector binds its letters' random vectors, each turned by its place; a text's vector is the bundle of those of all
    its trigrams, and so is a language's. Learned from are texts with a language whose crc32(doc_id) mod 4 is not 2, all of them.
    A prediction reads the text alone.

    Null texts and texts without a letter give `und` with score 0, as does everything when there is nothing to learn from. Equal
    cosines go to the first language by name. Scores below 0 count as 0. Repeated rows count each, in learning too. A null
    doc_id counts as empty text in the choice of the fold. Columns other than doc_id, text and lang are not read.
    Returns doc_id, held_out, lang_pred, score.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.col("lang").cast("string").alias("lang"), held_out().alias("held_out"),
    )
    found = profiles(rows, dimensions)
    names = sorted(found)
    matrix = np.stack([found[x] for x in names], axis=1) if names else np.zeros((dimensions, 0))
    shared = docs.sparkSession.sparkContext.broadcast((names, matrix))

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, matrix = shared.value
        vectors = Vectors(dimensions)
        for batch in batches:
            langs, scores = [], []
            for text in batch["text"]:
                codes, n = grams(text) if text else ((), ())
                if not len(codes) or not names or not codes[-1]:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                own = vectors.bundle(codes, n)
                cosine = own @ matrix / max(np.linalg.norm(own), 1e-9)
                best = int(np.argmax(cosine))
                langs.append(names[best])
                scores.append(float(min(max(round(cosine[best], 9), 0.0), 1.0)))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "lang_pred": langs, "score": scores}).astype({"doc_id": "Int64"})

    return rows.select("doc_id", "held_out", "text").mapInPandas(predict, "doc_id long, held_out boolean, lang_pred string, score double")
