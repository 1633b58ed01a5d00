"""Helpers the operators of this folder share."""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule, as it stands inside a character class.
SPACES = r"\x20\x09-\x0D"
SPACE_CHARS = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own_folders: list[str] = []


def work_folder(spark: SparkSession, name: str) -> str:
    """New folder below the shared one the cluster names in ``spark.checkpoint.dir``.

    Without that setting only a local session gets a folder of its own (tests);
    on a cluster a machine-local folder would lose files, so it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        if not _own_folders:
            _own_folders.append("file://" + tempfile.mkdtemp(prefix="pagetide-"))
        root = _own_folders[0]
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame written as a table in the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = work_folder(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Remove a table that ``stored`` made, once all that reads it is stored itself."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of steps whose results are stored.

    Spark's cleaner removes them once the driver has collected the frames that made them;
    otherwise they stay until the driver happens to run short of memory. The first turn drops
    what Python held in the JVM, the second what that held.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def word_count(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; null counts 0."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.length(F.regexp_replace(bare, f"[^{SPACES}]+[{SPACES}]*", "w")).cast("long")


def md5_long(value: Column) -> Column:
    """52-bit number from the md5 of a text; other engines have it too."""
    return F.conv(F.substring(F.md5(value), 1, 13), 16, 10).cast("long")


# ---- text as bytes, in tasks ----------------------------------------------
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def joined_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of an Arrow string column and the offsets of its rows; null counts as empty."""
    import pyarrow as pa

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None or not len(offsets):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def words_of(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and owning row of each word of the rows' bytes; words never cross rows."""
    space = np.ones(len(data) + 2, bool)
    space[1:-1] = _SPACE[data]
    begins = ~space[1:] & space[:-1]
    ends = ~space[:-1] & space[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]  # a row border parts words as a space does
    both = inner[~space[inner] & ~space[inner + 1]]
    begins[both] = True
    ends[both] = True
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends)
    return starts, stops, np.searchsorted(offsets, starts, "right") - 1


def first_bytes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The 8 bytes from each start as one number, A-Z lower-cased, zeros behind the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[:len(data)] = _LOWER[data]
    return np.ndarray((len(data) + 1,), "<u8", padded.data, 0, (1,))[starts]


def word_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hash of each word, A-Z lower-cased; equal words have equal hashes.

    A word is cut into pieces of 8 bytes, each packed into a number; the pieces
    are mixed one after the other, so a pass handles all words at once.
    """
    text = _LOWER[data] if lower else data
    padded = np.zeros(len(text) + 8, np.uint8)
    padded[:len(text)] = text
    packed = np.ndarray((len(text) + 1,), "<u8", padded.data, 0, (1,))  # 8 bytes from every position
    lengths = stops - starts
    out = mixed(lengths.astype(np.uint64) + _BASE)
    todo, at = np.arange(len(starts)), starts.copy()
    while len(todo):
        left = stops[todo] - at[todo]
        piece = packed[at[todo]]
        short = left < 8
        keep = np.where(short, (np.uint64(1) << (np.minimum(left, 7) * 8).astype(np.uint64)) - np.uint64(1),
                        np.uint64(0xFFFFFFFFFFFFFFFF))
        out[todo] = mixed(out[todo] * _BASE ^ (piece & keep))
        at[todo] += 8
        todo = todo[left > 8]
    return out


def pieces(batches, text: str = "text", most: int = 1 << 20):
    """Arrow batches cut so that the texts of each hold ``most`` bytes or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = joined_bytes(batch.column(text))
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            yield batch.slice(at, stop - at)
            at = stop


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether the checksum of the id as text falls into one fold; a null id is '' ."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds == fold


def clean_labels(labels: DataFrame, label: str) -> DataFrame:
    """doc_id, y: one row per labelled document, repeated rows by majority (ties: 1), nulls left out."""
    return labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(
        (F.avg(F.col(label).cast("double")) >= 0.5).cast("int").alias("y"))


def sample_labels(labels: DataFrame, most: int, salt: str) -> DataFrame:
    """The ``most`` first labels of each class by a hash of the id, as a small frame with the label y."""
    keyed = labels.withColumn("_h", F.md5(F.concat(F.lit(salt), F.col("doc_id").cast("string"))))
    parts = [keyed.where(F.col("y") == y).orderBy("_h", "doc_id").limit(most) for y in (0, 1)]
    return parts[0].unionByName(parts[1]).drop("_h")


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weights (bias first) of a logistic regression by Newton steps on standardised columns."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + ridge * len(x) * np.eye(len(w)) * 1e-2 + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(h, z.T @ (y - p) - ridge * len(x) * 1e-2 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    out = w.copy()
    out[1:] = w[1:] / scale
    out[0] = w[0] - (w[1:] * mean / scale).sum()
    return out


def probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -30, 30)))
