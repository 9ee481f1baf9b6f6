"""What the corpus operators share: materialised tables, Arrow text access, vectorised hashing."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Odd multipliers and a per-byte table for polynomial hashes modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_RNG = np.random.default_rng(20240117)
BYTE_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: Text is worked on in slices of about so many bytes, so that temporary arrays stay small.
SLICE_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else (local tests only) a temporary one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = spark.conf.get("spark.loomspan.localShared", None)
        if not where:
            where = "file://" + tempfile.mkdtemp(prefix="loomspan-")
            spark.conf.set("spark.loomspan.localShared", where)
    return where.rstrip("/")


#: Folders of the tables that this process wrote, oldest first.
_WRITTEN: list[str] = []


def materialise(df: DataFrame, name: str = "t", **options: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again: a cut in the lineage that survives lost executors.

    What the driver needed for df alone is handed back here, so that its memory follows a step and not a whole operator.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomspan/{name}-{uuid.uuid4().hex}"
    df.write.options(**{"compression": "zstd", **options}).parquet(path)
    _WRITTEN.append(path)
    driver_gives_back(spark)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _WRITTEN[:] = [p for p in _WRITTEN if p.rsplit("/", 1)[1] != path.rstrip("/").rsplit("/", 1)[1]]


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing will read again."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/loomspan/" in path:
                _delete(df.sparkSession, path)


def mark() -> int:
    """Where `tidy` is to begin."""
    return len(_WRITTEN)


def tidy(since: int, *used: DataFrame) -> None:
    """Delete the tables written since a mark, but those that `used` read. What a lazy result reads stays until its caller is done."""
    kept = {f.rsplit("/", 2)[-2] for df in used for f in df.inputFiles()}
    for path in _WRITTEN[since:]:
        if path.rsplit("/", 1)[1] not in kept:
            _delete(used[0].sparkSession, path)


#: Keys with more than one in HOT of the rows are split, so there are fewer than HOT of them.
HOT = 512


def hot_keys(counts: DataFrame, keys: list[str], n: str) -> DataFrame:
    """(keys, ways) of the keys with more than 1 / HOT of all rows, from a materialised (keys, n): fewer than HOT rows, for broadcasts."""
    total = counts.agg(F.sum(n)).first()[0] or 0
    return counts.where(F.col(n) * HOT > total).select(*keys, F.ceil(F.col(n) * HOT / F.lit(max(total, 1))).cast("int").alias("__ways"))


def hot_in_sample(rows: DataFrame, keys: list[str], by: str, one_in: int = 64) -> DataFrame:
    """hot_keys as one in 64 of the values of `by` shows them, for rows that would be dear to count. Only how rows are dealt hangs on it."""
    some = rows.where(F.pmod(F.xxhash64(by, F.lit(77)), F.lit(one_in)) == 0)
    return hot_keys(materialise(some.groupBy(*keys).agg(F.count("*").alias("n")), "sample"), keys, "n")


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], hot: DataFrame, salt: Column, how: str = "inner") -> DataFrame:
    """left join right on keys (inner or left); right has one row for each key. Rows of a hot key are dealt to its `ways`.

    Right's rows of such keys are there once for each way. salt: a long of left's rows that spreads them.
    """
    way = F.coalesce(F.pmod(salt, F.col("__ways")), F.lit(0)).cast("int")
    left = left.join(F.broadcast(hot), keys, "left").withColumn("__way", way).drop("__ways")
    right = right.join(F.broadcast(hot), keys, "left").withColumn("__way", F.explode(F.sequence(F.lit(0), F.coalesce("__ways", F.lit(1)) - 1))).drop("__ways")
    return left.join(right, [*keys, "__way"], how).drop("__way")


def split_join(left: DataFrame, right: DataFrame, keys: list[str], n: str, salt: Column, how: str = "inner") -> DataFrame:
    """salted_join with a materialised right whose column n says how many rows of left a key has."""
    return salted_join(left, right, keys, hot_keys(right, keys, n), salt, how)


#: Rows of an Arrow batch of whole texts; Spark's default of 10,000 would be 35 MB of text on both sides of each worker.
BATCH_ROWS = 1000


def bounded_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches, unless the session has its own setting."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


#: What a worker process keeps between tasks, such as vocabularies; operators that don't use it drop it.
WORKER_CACHES: list[dict] = []


def give_back() -> None:
    """Hand freed memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


#: Seconds between two times that the driver hands memory back, and when the last one was.
GIVE_BACK_EVERY = 5.0
_GAVE_BACK = [0.0]


def driver_gives_back(spark: SparkSession) -> None:
    """Hand back what the driver's Python and JVM no longer use: plans, task results, broadcasts and what compiling them took.

    Each join of many partitions leaves such remains; left to itself the JVM grows to its limit before it collects them.
    """
    if time.monotonic() - _GAVE_BACK[0] < GIVE_BACK_EVERY:
        return
    give_back()  # first, since objects of Python hold some of the JVM's
    jvm = spark._jvm
    jvm.java.lang.System.gc()
    try:
        call = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        args = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        call.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except (Py4JError, StopIteration):  # another JVM
        pass
    _GAVE_BACK[0] = time.monotonic()


def trimmed(run, keep: bool = False):
    """A batch function that hands memory back when its task ends; without `keep` the worker's caches go as it starts."""

    def wrapped(batches):
        if not keep and any(WORKER_CACHES):
            for cache in WORKER_CACHES:
                cache.clear()
            give_back()
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket_of(column: str, n: int):
    """crc32 of the value as text, modulo n: the fold that the contracts name (null: fold 0)."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(n), F.lit(0))


def spread(df: DataFrame, column: str = "text") -> DataFrame:
    """The projection that text scans start from; kept apart so that every scan prunes its columns."""
    return df.select("doc_id", column)


# ---------------------------------------------------------------- bitmaps

#: Bits of the largest bitmap (16 MB). Beyond 2**23 keys it fills up and lets more rows through to the exact step behind it.
BITMAP_LIMIT = 1 << 27


def bitmap_of(keys: DataFrame, limit: int = BITMAP_LIMIT) -> tuple[int, np.ndarray]:
    """(bits, words): a bitmap with the hashes of the long column `key`, 16 bits or more for each as far as the limit goes.

    The executors OR the words, so at most limit / 64 rows reach the driver, as Arrow batches of 12 bytes a row. All of the column is in the bitmap; one in
    16 others may be as well, or more beyond the limit, so it only saves work ahead of an exact step.
    """
    n = keys.count()
    bits = min(limit, 1 << max(10, (16 * n - 1).bit_length() if n else 0))
    slot = F.pmod(F.xxhash64("key"), F.lit(bits))
    rows = keys.select(slot.alias("slot")).select(F.shiftright("slot", 6).cast("int").alias("word"), F.expr("shiftleft(1L, cast(slot & 63 as int))").alias("bit"))
    rows = rows.groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    words = np.zeros(bits // 64, np.int64)
    for batch in rows.to_batches():
        words[batch.column("word").to_numpy()] = batch.column("bit").to_numpy()
    del rows
    give_back()
    return bits, words


def in_bitmap(words: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (words[slots >> 6] >> (slots & 63)) & 1 == 1


def ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def likely(df: DataFrame, key, bitmap: tuple[int, np.ndarray], wanted: bool = True) -> DataFrame:
    """Rows of df whose long `key` may be in the bitmap; with wanted=False the rows that are surely not."""
    bits, words = bitmap
    shared = df.sparkSession.sparkContext.broadcast(words)
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array(in_bitmap(shared.value, batch.column("__slot").to_numpy()) == wanted)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in names], names)

    return df.withColumn("__slot", F.pmod(F.xxhash64(key), F.lit(bits))).mapInArrow(run, ddl(df))


# ---------------------------------------------------------------- Arrow text


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string or binary column without making Python strings; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    if not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets, body


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have about `limit` bytes together; a longer text stands alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last
        first = last


# ---------------------------------------------------------------- labelled samples


def labelled(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, max_bytes: int, max_total: int) -> tuple[DataFrame, float | None]:
    """(label, text) of a bounded sample of labelled documents, and the share of label 1 among all labels (None: no labels).

    Of each class at most `max_rows` documents and `max_total` bytes of text, in the order of a hash of doc_id; texts of
    more than `max_bytes` are not in it. Repeated labels count once; a doc_id with both labels has none. Of the texts of a
    repeated doc_id the least one counts. So the sample depends on the rows and not on their order or partitions.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("__most")).where("label = __most").drop("__most")
    totals = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    picked = None
    for y in (0, 1):
        # orderBy + limit is a bounded top-k, not a sort of the table
        part = known.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
        picked = part if picked is None else picked.unionAll(part)
    small = docs.select("doc_id", F.col("text").cast("binary").alias("text")).where(F.octet_length("text").between(1, max_bytes))
    small = small.join(F.broadcast(picked), "doc_id").groupBy("label", "doc_id").agg(F.min("text").alias("text"))
    w = Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    sample = small.withColumn("__so_far", F.sum(F.octet_length("text")).over(w)).where(F.col("__so_far") <= max_total)
    return sample.select("label", "text"), totals.get(1, 0) / sum(totals.values()) if totals else None


# ---------------------------------------------------------------- hashes

_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64, for i up to n."""
    if len(_POWERS[0]) <= n:
        size = max(n + 1, 1 << 20)
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        for k, b in enumerate((BASE, inverse)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0], _POWERS[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * MIX1
    h ^= h >> np.uint64(27)
    h *= MIX2
    h ^= h >> np.uint64(31)
    return h


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running sums p with p[j] - p[i] times BASE**-i a hash of data[i:j]."""
    up, _ = powers(len(data))
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    np.cumsum(BYTE_VALUE[data] * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed hashes of the byte spans [start, end), equal for equal bytes wherever they stand."""
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64) * MIX2)


def word_spans(data: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of bytes for which is_word[byte] is 1; data must end with a non-word byte."""
    edge = np.diff(is_word[data], prepend=np.int8(0))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def joined(offsets: np.ndarray, body: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts of rows a..b-1 in one array, each followed by a line feed, and where each one begins there."""
    lens = np.diff(offsets[a : b + 1])
    begin = np.zeros(len(lens) + 1, np.int64)
    np.cumsum(lens + 1, out=begin[1:])
    out = np.full(int(begin[-1]), 10, np.uint8)
    keep = np.ones(len(out), bool)
    keep[begin[1:] - 1] = False
    out[keep] = body[offsets[a] : offsets[b]]
    return out, begin


def logistic_line(x: np.ndarray, y: np.ndarray, prior: float, ridge: float = 1e-3) -> tuple[float, float]:
    """(slope, shift) of a logistic fit of y on x with the classes weighted to the rate `prior`; the slope is positive."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    scale = max(float(np.std(x)), 1e-12)
    z = np.column_stack([(x - x.mean()) / scale, np.ones(len(x))])
    weight = np.where(y == 1, prior / max(y.mean(), 1e-9), (1 - prior) / max(1 - y.mean(), 1e-9))
    theta = np.array([1.0, np.log(prior / (1 - prior))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ theta, -35, 35)))
        grad = z.T @ (weight * (p - y)) + ridge * len(x) * np.array([theta[0] - 1, 0.0])
        hess = (z * (weight * p * (1 - p))[:, None]).T @ z + ridge * len(x) * np.eye(2)
        step = np.linalg.solve(hess, grad)
        theta = theta - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    slope = max(theta[0], 1e-3) / scale
    return float(slope), float(theta[1] - slope * x.mean())


def best_cut(x: np.ndarray, y: np.ndarray) -> float:
    """The value of x above which y is rather 1: the middle of the cuts with the fewest errors."""
    order = np.argsort(x, kind="stable")
    x, y = np.asarray(x, float)[order], np.asarray(y, int)[order]
    cuts = np.concatenate([[x[0] - 1e-9], (x[1:] + x[:-1]) / 2, [x[-1] + 1e-9]])
    errors = np.concatenate([[0], np.cumsum(y)]) + (1 - y).sum() - np.concatenate([[0], np.cumsum(1 - y)])
    return float(np.median(cuts[errors == errors.min()]))


def os_environment() -> None:
    """Native libraries of a Python worker keep to their one core."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    os.environ.setdefault("OMP_NUM_THREADS", "1")
