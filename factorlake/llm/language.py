"""Language identification by hyperdimensional profiles.

Every letter has a random vector of `SIZE` signs, drawn by a generator that its code point seeds, so
any script has vectors and no table is kept. An n-gram is bound from its letters: the vector of the
k-th last letter is permuted by k places, and the signs are multiplied. A text is the
bundle (the sum) of its n-grams, a language the bundle of its training texts, each brought to length one. A text
has the language whose prototype has the largest cosine with it.

The sum over a text is taken as counts times vectors of its distinct n-grams. Letters
are those of Unicode, in lower case; everything between two letters counts as one blank, as do both
ends of a text. Texts are read whole, in parts.

The prototypes are fitted on at most `SAMPLE` texts a language, drawn by the hash of their rows;
the bundles are taken by Spark, and one vector a language comes to the driver.

Defined results: `und` with score 0 for a text that is null or has no letter, and for all texts if nothing could be learned.
Ties go to the first language in order. Repeated rows get equal results.
"""

import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship, tuned, worker_state

#: Signs of a vector, and letters of an n-gram.
SIZE, GRAM = 1024, 3
#: Texts of a language that its prototype is fitted on.
SAMPLE = 1_500
UNKNOWN = "und"
#: Letters of a text that are taken at once, and n-gram vectors that a worker remembers.
PART, REMEMBERED = 1 << 20, 20_000
GRAIN = 1 << 30
#: Steps of one in the vectors of training texts.
FINE = float(1 << 30)


def letter_vector(code: int, size: int) -> np.ndarray:
    """Random signs of a letter; 0 is the blank."""
    return np.random.default_rng([7919, code]).integers(0, 2, size).astype(np.int8) * 2 - 1


class Profiles:
    """Bundles of texts. Letters and n-grams are remembered."""

    def __init__(self, size: int = SIZE, gram: int = GRAM):
        self.size, self.gram = size, gram
        self.letters: dict[int, np.ndarray] = {}
        self.is_letter = np.zeros(0x110000, dtype=bool)
        codes = [c for c in range(0x110000) if unicodedata.category(chr(c))[0] == "L"]
        self.is_letter[codes] = True
        self.rows: dict[int, int] = {}
        self.table = np.zeros((REMEMBERED, size), dtype=np.float32)

    def letter(self, code: int) -> np.ndarray:
        found = self.letters.get(code)
        if found is None:
            found = self.letters[code] = letter_vector(code, self.size)
        return found

    def bound(self, key: int) -> np.ndarray:
        """Vector of an n-gram whose code points are packed in 21 bits each."""
        out = np.ones(self.size, dtype=np.int8)
        for k in range(self.gram):
            out *= np.roll(self.letter(key >> (21 * k) & 0x1FFFFF), k)
        return out

    def places(self, keys: np.ndarray) -> list[int]:
        """Rows of the table that hold these n-grams; at most `REMEMBERED` at once."""
        rows = self.rows
        places = [rows.get(k, -1) for k in keys.tolist()]
        new = [i for i, p in enumerate(places) if p < 0]
        if len(rows) + len(new) > REMEMBERED:
            rows.clear()
            new = range(len(keys))
        for i in new:
            key = int(keys[i])
            places[i] = rows[key] = len(rows)
            self.table[places[i]] = self.bound(key)
        return places

    def grams(self, text: str):
        """(n-grams, counts) of the parts of a text, none if it has no letter."""
        before = None
        for at in range(0, len(text), PART):
            code = np.frombuffer(text[at : at + PART].lower().encode("utf-32-le", "replace"), dtype="<u4").astype(np.int64)
            code[~self.is_letter[code]] = 0
            # a part goes on where the last one ended
            code = np.concatenate([np.zeros(1, dtype=np.int64) if before is None else before, code])
            if at + PART >= len(text):
                code = np.append(code, 0)
            twice = np.r_[False, (code[1:] == 0) & (code[:-1] == 0)]
            if before is not None:
                twice[: len(before)] = False
            code = code[~twice]
            if len(code) >= self.gram and code.any():
                key = np.zeros(len(code) - self.gram + 1, dtype=np.int64)
                for k in range(self.gram):
                    key = key << 21 | code[k : len(code) - self.gram + 1 + k]
                yield np.unique(key, return_counts=True)
            before = code[-(self.gram - 1) :]

    def bundle(self, text: str | None) -> np.ndarray | None:
        """Sum of the n-gram vectors of a text; None if it has no letter."""
        total = None
        for keys, counts in self.grams(text or ""):
            for i in range(0, len(keys), REMEMBERED):
                some = self.places(keys[i : i + REMEMBERED])
                part = counts[i : i + REMEMBERED].astype(np.float32) @ self.table[some]
                total = part.astype(np.float64) if total is None else total + part
        return total

    def unit(self, text: str | None) -> np.ndarray | None:
        v = self.bundle(text)
        if v is None:
            return None
        return v / max(float(np.sqrt(v @ v)), 1e-300)


def profiles(size: int, gram: int) -> Profiles:
    return worker_state(f"language {size} {gram}", lambda: Profiles(size, gram))


def sample(df: DataFrame, key: str, text: str, lang: str, most: int) -> DataFrame:
    """(lang, text) of about `most` texts of every language: those whose hash is under its bound."""
    rows = df.select(F.col(key).alias("key"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = rows.groupBy("lang").count().collect()
    # one row a language, as many as the model has vectors
    bounds = df.sparkSession.createDataFrame([(r["lang"], min(GRAIN, GRAIN * most // r["count"])) for r in sizes], "c_lang string, bound long")
    mark = F.pmod(F.xxhash64("key", "text"), F.lit(GRAIN))
    chosen = rows.join(F.broadcast(bounds), F.col("lang") == F.col("c_lang"))
    return chosen.where(mark < F.col("bound")).select("lang", "text")


def fit(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", where: Column | None = None, most: int = SAMPLE, size: int = SIZE, gram: int = GRAM) -> tuple[list[str], np.ndarray]:
    """Languages in order and their prototypes, one row each, of length one."""
    tuned(df.sparkSession)
    chosen = sample(df if where is None else df.where(where), key, text, lang, most)

    def bundles(batches):
        own, sums = profiles(size, gram), {}
        for b in batches:
            for name, raw in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                v = own.unit(raw)
                if v is not None:
                    # whole numbers: the sum does not depend on the order of texts
                    v = np.rint(v * FINE).astype(np.int64)
                    sums[name] = sums[name] + v if name in sums else v
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()])], names=["lang", "v"])

    parts = chosen.mapInArrow(bundles, "lang string, v array<long>")
    sums = parts.select("lang", F.posexplode("v")).groupBy("lang", "pos").agg(F.sum("col").alias("x"))
    rows = sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("v")).orderBy("lang").collect()
    names = [r["lang"] for r in rows]
    table = np.array([[x["x"] for x in r["v"]] for r in rows], dtype=np.float64).reshape(len(rows), size)
    return names, table / np.maximum(np.sqrt((table * table).sum(axis=1, keepdims=True)), 1e-300)


def predicted(df: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", name: str = "language", size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """The table with a column `name` of (lang, score): the nearest language and its cosine, 0 at least."""
    load = ship(tuned(df.sparkSession), model)

    @F.pandas_udf("lang string, score double")
    def nearest(column: pd.Series) -> pd.DataFrame:
        names, table = load()
        own, langs, scores = profiles(size, gram), [], []
        for raw in column:
            v = own.unit(raw) if names else None
            if v is None:
                langs.append(UNKNOWN)
                scores.append(0.0)
            else:
                cosine = table @ v
                best = int(cosine.argmax())
                langs.append(names[best])
                scores.append(min(1.0, max(0.0, float(cosine[best]))))
        return pd.DataFrame({"lang": langs, "score": scores})

    return df.withColumn(name, nearest(F.col(text)))
