"""Helpers that several pipeline operators share: tables, scratch tables, words, hashes."""

from __future__ import annotations

import hashlib
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hindcast.session import materialize  # noqa: F401 - the operators take it from here

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: rows of one Arrow batch; texts are long, so a batch of the default size could not be bounded
BATCH_ROWS = "400"
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_FLIP = np.uint64(0xBF58476D1CE4E5B9)
_LAST = np.uint64(0x94D049BB133111EB)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per context, so that their Python workers can import it."""
    context = spark.sparkContext
    if getattr(context, "_hindcast_shipped", False):
        return
    root = Path(__file__).resolve().parent.parent
    archive = f"{tempfile.mkdtemp(prefix='hindcast-')}/hindcast.zip"  # the driver serves it to the executors
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    context.addPyFile(archive)
    context._hindcast_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Only the two columns an operator needs; null texts are empty. Other columns cannot clash."""
    return docs.select(
        F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text")
    )


def bounded_batches(spark: SparkSession) -> None:
    """Before work in Python: keep Arrow batches of long texts small, and have the package on the executors."""
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) != BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def lower_words(text: str) -> list[bytes]:
    """Words between ASCII white space (space, tab to carriage return), A-Z lower-cased.

    ``bytes`` methods know ASCII only, so every other character stays as it is.
    """
    return text.encode("utf-8", "surrogatepass").lower().split()


class WordHashes(dict):
    """64-bit hash per word; a bounded memo, computed anew where it was dropped."""

    def __init__(self, limit: int = 300_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        value = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(self) >= self.limit:
            self.clear()
        if len(word) <= 64:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix finaliser)."""
    with np.errstate(over="ignore"):
        z = values + _PRIME
        z = (z ^ (z >> np.uint64(30))) * _FLIP
        z = (z ^ (z >> np.uint64(27))) * _LAST
        return z ^ (z >> np.uint64(31))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """One 64-bit hash per run of ``size`` words, in order; the whole run if there are fewer."""
    if len(words) == 0:
        return words
    size = min(size, len(words))
    with np.errstate(over="ignore"):
        total = np.full(len(words) - size + 1, size, dtype=np.uint64)
        for k in range(size):
            total = mix(total * _PRIME + words[k : len(words) - size + 1 + k])
    return total


def in_blocks(text: str, size: int = 1 << 16) -> Iterator[str]:
    """Cut a text before white space that follows another character, about every ``size`` characters."""
    start, n = 0, len(text)
    while n - start > size:
        cut = start + size
        while cut < n and not (text[cut].isspace() and not text[cut - 1].isspace()):
            cut += 1
        yield text[start:cut]
        start = cut
    if start < n:
        yield text[start:]
