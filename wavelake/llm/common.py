"""Small helpers that several text operators share."""

from __future__ import annotations

import gc
import re
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavelake.session import ensure_checkpoint_dir

#: A word is a maximal run of anything but a space or the control characters from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
WORDS = re.compile(r"[^ \t-\r]+")
LOWER_ASCII = {c: c + 32 for c in range(65, 91)}

U64 = np.uint64


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform_draw(seed: str, key: Column) -> Column:
    """A number inside (0, 1) that depends on the seed and the key alone (a null key counts as the text ``null``)."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


def write_table(df: DataFrame) -> DataFrame:
    """Writes a table into the shared checkpoint folder and reads it back: computed once, lost with no executor."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release_shuffles(spark: SparkSession) -> None:
    """Collects garbage, so that Spark drops the shuffle files and checkpoints of steps that nothing refers to.

    Long operators call it between phases: else the files of finished phases stay on disk until the driver happens to
    collect its garbage.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def text_udf(make: Callable[[], Callable[[str | None], tuple]], schema: str) -> Callable[[Column], Column]:
    """A column function from a text to a struct, run over Arrow batches. ``make`` is called once in each task."""
    names = [part.split()[0] for part in schema.split(",")]

    @F.pandas_udf(schema)
    def apply(batches: "pd.Series") -> pd.DataFrame:
        one = make()
        return pd.DataFrame([one(t) for t in batches], columns=names)

    apply = apply.asNondeterministic()  # not evaluated twice by a pushed filter
    return apply


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (xor-shift and multiply rounds)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class WordHashes(dict):
    """Word to 64-bit hash. Remembers up to ``limit`` words, then starts over; the values don't depend on that."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), U64, len(words))

    @staticmethod
    def of_text(text: str) -> np.ndarray:
        """The same hashes for all words of a text, A-Z in lower case first.

        Works on the UTF-8 of the text: ``bytes.lower`` changes A-Z alone, ``bytes.split`` splits at the white space of
        WORD alone, and to hash such a word takes less time than to look it up.
        """
        words = text.encode("utf-8", "surrogatepass").lower().split()
        return np.fromiter(map(xxhash.xxh3_64_intdigest, words), U64, len(words))


def shingle_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """One hash for each run of ``width`` words; with fewer words, one for the whole sequence; none without words."""
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(width, n)
    total = np.full(n - width + 1, width, U64)
    with np.errstate(over="ignore"):
        for k in range(width):
            total = mix64(total * U64(0x9E3779B97F4A7C15) + hashes[k : n - width + 1 + k])
    return total
