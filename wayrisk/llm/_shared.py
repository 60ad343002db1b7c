"""What the corpus operators share: checkpoints, exact word splitting, rolling hashes."""

from __future__ import annotations

import tempfile

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A worker's memo of words is emptied at this many entries, so that its memory is bounded.
MEMO = 400_000


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage in the folder that all executors share.

    The folder is the one named in ``spark.checkpoint.dir``.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only in a local session without it."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="wayrisk")


def delete_table(spark: SparkSession, path: str) -> None:
    """Delete a table of an earlier step, once what follows is written."""
    old = spark._jvm.org.apache.hadoop.fs.Path(path)
    old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of a text column: one number, to choose how many groups to deal into."""
    return int(docs.agg(F.sum(F.octet_length(column).cast("long"))).first()[0] or 0)


_REMEMBERED: dict[str, tuple[dict, ...]] = {}


def remember(operator: str, *memos: dict) -> None:
    """Say in a worker that ``operator`` fills ``memos`` from now on; those of other operators, which ran there before, are emptied.

    Workers live on over stages, and would else hold the memos of all of them.
    """
    for other in [x for x in _REMEMBERED if x != operator]:
        for memo in _REMEMBERED.pop(other):
            memo.clear()
    _REMEMBERED[operator] = memos


class WordHash(dict):
    """64-bit hashes of words (bytes), memoised; the memo is emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def word_array(words: list[bytes], memo: WordHash) -> np.ndarray:
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(words: np.ndarray, size: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` consecutive word hashes, by Horner's rule in doubling steps.

    The polynomial has the odd ``base`` and is taken modulo 2**64 over already random word hashes, then mixed.
    """
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    # h[k] covers k words from each start; build size from its binary digits
    out, done, block, width = None, 0, words, 1
    left = size
    while left:
        if left & 1:
            part = block[done : done + n]
            out = part.copy() if out is None else out * np.uint64(pow(base, width, 1 << 64)) + part
            done += width
        left >>= 1
        if left:
            block = block[: len(block) - width] * np.uint64(pow(base, width, 1 << 64)) + block[width:]
            width *= 2
    return mixed(out)
