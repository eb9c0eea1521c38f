"""Shared helpers of the corpus operators: column resolution, word and hash arrays, durable intermediates."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Blanks that separate words: space and U+0009 to U+000D. Every other character belongs to a word.
BLANKS = " \t\n\x0b\x0c\r"
#: Characters a numpy chunk holds at most, unless one document alone is longer.
CHUNK_CHARS = 1 << 19
#: Bytes of a batch whose rows become Python objects at once, about.
PORTION_BYTES = 4 << 20

U64 = np.uint64

_used: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables, below spark.checkpoint.dir, which driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "/tmp/checkpoints"  # one machine: driver and executors are one process
    path = f"{base.rstrip('/')}/offerlens-{spark.sparkContext.applicationId}"
    if path not in _used:
        _used.add(path)
        atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, wherever Spark's file systems keep it."""
    with contextlib.suppress(Exception):  # at exit the JVM may be gone
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def durable(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage and survives lost executors. The folder goes with the application."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._durable = path
    return out


def forget(*frames: DataFrame) -> None:
    """Deletes tables of `durable` that nothing will read again, and lets Spark delete shuffle files of jobs that are done: it does so when the driver's
    objects that stand for them are collected, which may otherwise be long after the disks are full."""
    with contextlib.suppress(Exception):
        SparkSession.active()._jvm.System.gc()
    for df in frames:
        if path := getattr(df, "_durable", None):
            remove(df.sparkSession, path)


def partitions_for(df: DataFrame, least: int = 8) -> int:
    """Shuffle partitions to deal a grouped job over: the session's setting, which the cluster sizes to its data."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def group_of_row(groups: int):
    """A number of a group for each row of a written table, dealt evenly whatever the partitions: rows of a partition in turn, each partition
    from another group on. Reading the table again gives the same numbers."""
    row = F.monotonically_increasing_id()  # the partition's number times 2**33, plus the row's
    return F.pmod(row.bitwiseAND(F.lit((1 << 33) - 1)) + F.shiftright(row, 33) * 1_000_003, F.lit(groups)).cast("int")


def trim() -> None:
    """Gives the worker's free memory back to the system: workers live on from stage to stage, and so would what it keeps."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def portions(batches: Iterator[pa.RecordBatch], limit: int = PORTION_BYTES) -> Iterator[pa.RecordBatch]:
    """All rows of the batches, in slices of about `limit` bytes (a row alone may be larger)."""
    trim()
    for batch in batches:
        n = max(1, batch.num_rows * limit // max(batch.nbytes, 1))
        for at in range(0, batch.num_rows, n):
            yield batch.slice(at, n)
    trim()


def chunks(texts: list[str], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Index ranges [a, b) of consecutive texts with about `limit` characters together."""
    a = size = 0
    for i, t in enumerate(texts):
        if i > a and size + len(t) > limit:
            yield a, i
            a, size = i, 0
        size += len(t) + 1
    if a < len(texts):
        yield a, len(texts)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        step = np.full(max(n, 1024), base, dtype=U64)
        step[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(step)
    return have[:n]


class Words:
    """Words of some texts as flat arrays.

    codes: the code points of all texts, each followed by one line feed. start, end: a word's place there.
    doc: the text a word belongs to. first: of each text its first word's index, with the total at the end.
    """

    def __init__(self, texts: list[str]):
        joined = "\n".join(texts) + "\n" if texts else ""
        self.joined = joined
        self.codes = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.doc_start = np.concatenate([[0], np.cumsum(lengths + 1)])
        blank = (self.codes == 32) | ((self.codes >= 9) & (self.codes <= 13))
        self.blank = blank
        edge = np.flatnonzero(np.diff(np.concatenate([[True], blank]).astype(np.int8)))
        self.start, self.end = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.start, self.doc_start)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(texts)), self.counts)

    def hashes(self, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
        """A 64-bit hash of each word."""
        n = len(self.start)
        if not n:
            return np.zeros(0, dtype=U64)
        length = self.end - self.start
        offset = np.concatenate([[0], np.cumsum(length)])[:-1]
        inside = self.codes[~self.blank]
        place = np.arange(len(inside), dtype=np.int64) - np.repeat(offset, length)
        value = (inside.astype(U64) + U64(0x1F)) * U64(0xD6E8FEB86659FD93)
        value ^= value >> U64(32)
        value *= powers(base, int(length.max()) + 1)[place]
        return mix(np.add.reduceat(value, offset) + length.astype(U64))


def window_hashes(words: np.ndarray, size: int, base: int = 0xC2B2AE3D27D4EB4F) -> np.ndarray:
    """Hashes of all runs of `size` consecutive words; index i is the run that starts at word i."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    p = powers(base, size)
    out = words[:n] * p[0]
    for k in range(1, size):
        out += words[k : k + n] * p[k]
    return mix(out)


def text_column(df: DataFrame, name: str = "text"):
    """The text, with null as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)


class HashArray:
    """Ascending hashes with values, searched from a directory over the hashes' leading bits."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        self.bits = max(int(len(keys)).bit_length() + 1, 1)
        self.start = np.searchsorted(self.keys >> U64(64 - self.bits), np.arange((1 << self.bits) + 1, dtype=U64)).astype(np.int32)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values (0 for what is not there), and whether it is there."""
        out, found = np.zeros(len(keys), self.values.dtype), np.zeros(len(keys), bool)
        place = (keys >> U64(64 - self.bits)).astype(np.int64)
        at, end = self.start[place], self.start[place + 1]
        which = np.flatnonzero(at < end)
        at, end = at[which], end[which]
        while len(which):
            hit = self.keys[at] == keys[which]
            found[which[hit]] = True
            out[which[hit]] = self.values[at[hit]]
            at = at + 1
            on = ~hit & (at < end)
            which, at, end = which[on], at[on], end[on]
        return out, found


def packed(keys: np.ndarray, n: np.ndarray) -> bytes:
    """Ascending hashes and their counts; the hashes' leading bytes, laid side by side, take next to nothing."""
    more = np.flatnonzero(n > 1)
    planes = keys.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(np.array([len(keys), len(more)], "<i8").tobytes() + planes + more.astype("<u4").tobytes() + n[more].astype("<u4").tobytes())


def unpacked(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(block)
    size, some = np.frombuffer(raw[:16], "<i8").tolist()
    keys = np.ascontiguousarray(np.frombuffer(raw[16 : 16 + 8 * size], np.uint8).reshape(8, size).T).view("<u8").ravel()
    more, times = np.frombuffer(raw[16 + 8 * size :], "<u4").reshape(2, some)
    n = np.ones(size, np.int64)
    n[more] = times
    return keys.astype(U64), n


def range_blocks(held: list[np.ndarray], ranges: int) -> pa.RecordBatch:
    """(range, block) of the hashes held, summed up and packed by range of the hash; held is empty afterwards."""
    keys, n = np.unique(np.concatenate([*held, np.zeros(0, U64)]), return_counts=True)
    held.clear()
    edges = np.searchsorted(((keys >> U64(32)) * U64(ranges) >> U64(32)).astype(np.int64), np.arange(ranges + 1))
    used = np.flatnonzero(np.diff(edges)).tolist()
    blocks = [packed(keys[edges[r] : edges[r + 1]], n[edges[r] : edges[r + 1]]) for r in used]
    return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(blocks, pa.binary())], ["range", "block"])


def range_sums(least: float):
    """mapInArrow function over all blocks of a range to (key, n) of the hashes with over `least` in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [unpacked(b) for batch in batches for b in batch.column(0).to_pylist()]
        if not parts:
            return
        keys, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        total = np.add.reduceat(n[order], begin)
        some = total > least
        yield pa.RecordBatch.from_arrays([pa.array(keys[begin[some]].view(np.int64)), pa.array(total[some])], ["key", "n"])

    return run
