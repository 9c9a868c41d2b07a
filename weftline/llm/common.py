"""Shared helpers: inputs, the shared folder, and vectorised word hashing over Arrow buffers."""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no spark.checkpoint.dir (tests, local runs).
DEFAULT_SHARED = "file:///tmp/checkpoints"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; also made Spark's checkpoint folder if it has none. Only a local session
    may leave it unset: elsewhere a machine's own folder is not shared."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    root = root or DEFAULT_SHARED
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
_own_bounds: set[str] = set()


def bounded(spark: SparkSession, batch_bytes: int = 16 << 20) -> None:
    """Makes Arrow batches go by bytes: ten thousand rows of text, the default, have no bound. A smaller bound that the
    session brings stays."""
    have = spark.conf.get(_BATCH_KEY, None) or "0"
    if have in _own_bounds or not 0 < int(have.rstrip("b")) <= batch_bytes:
        _own_bounds.add(str(batch_bytes))
        spark.conf.set(_BATCH_KEY, str(batch_bytes))


def work_dir(spark: SparkSession, tag: str) -> str:
    """A new subfolder of the shared folder."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


_CLEAN_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage and survives lost executors. The write's shuffle files,
    which nothing reads again, go when it ends."""
    spark, path = df.sparkSession, work_dir(df.sparkSession, tag)
    before = spark.conf.get(_CLEAN_KEY, None)
    spark.conf.set(_CLEAN_KEY, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN_KEY, before) if before else spark.conf.unset(_CLEAN_KEY)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes a table that ``written`` wrote and that nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def tagged(docs: DataFrame, tag: str, stable: bool) -> DataFrame:
    """(_row, _doc, doc_id, text): rows by number, with all their columns in one, whatever their names.

    ``stable``: docs gives the same rows in the same order whenever it is computed, as the scan of a table does; any
    other is written first.
    """
    one = F.struct(*docs.columns).alias("_doc")
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), one, F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows if stable else written(rows, tag)


def crc_mod(doc_id: Column, m: int) -> Column:
    """crc32 of the id as text, mod m; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % m


def open_shared(path: str):
    """(filesystem, path) for a URI or a plain path; executors use it for files in the shared folder only."""
    from pyarrow import fs

    if "://" not in path and path.startswith("file:"):
        path = path[5:]
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def write_shared(path: str, data: bytes) -> None:
    """Write under a new name, then rename: a retried task replaces the file by the same bytes."""
    from pyarrow import fs

    store, p = open_shared(path)
    store.create_dir(p.rpartition("/")[0], recursive=True)
    part = f"{p.rpartition('/')[0]}/.{uuid.uuid4().hex}.part"
    with store.open_output_stream(part, compression=None) as out:
        out.write(data)
    if store.get_file_info(p).type != fs.FileType.NotFound:  # an earlier attempt's; some stores do not rename onto a file
        store.delete_file(p)
    store.move(part, p)


def trim() -> None:
    """Gives freed memory back to the system, where the C library can: a worker that goes on to the next stage stays small."""
    import ctypes

    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


# ---- vectorised text -----------------------------------------------------------------------

M64 = (1 << 64) - 1
_GOLD = np.uint64(0x9E3779B97F4A7C15)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACES = np.zeros(256, dtype=bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True

def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def mix_int(x: int) -> int:
    return int(mix(np.array([x & M64], dtype=np.uint64))[0])


def utf8(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying the texts; null is empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null("")
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(arr.type) else np.int32
    _, off, data = arr.buffers()
    off = np.frombuffer(off, kind)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def pieces(off: np.ndarray, limit: int):
    """(first, last) row ranges of at most ``limit`` bytes each, or one longer row."""
    a = 0
    while a < len(off) - 1:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        yield a, b
        a = b


_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_LONG = 64  # bytes from which a span is hashed by itself


class Spans:
    """Spans of bytes, read eight at a time from any place."""

    def __init__(self, raw: np.ndarray) -> None:
        self.raw, n = raw, len(raw)
        pad = np.zeros((n >> 3) * 8 + 24, np.uint8)
        pad[:n] = raw
        self.words = pad.view("<u8")

    def eight(self, at: np.ndarray, left: np.ndarray) -> np.ndarray:
        """The next eight bytes, or the ``left`` ones, as an integer."""
        q, r = at >> 3, ((at & 7) << 3).astype(np.uint64)
        x = self.words[q] >> r
        x |= self.words[q + 1] << (np.uint64(63) - r) << np.uint64(1)
        x &= _MASKS[np.minimum(left, 8)]
        return x

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes: each eight bytes are mixed into the state before them, from the length on, so that spans of
        equal length and at most eight bytes never collide; long spans by BLAKE2."""
        n = ends - starts
        out = mix(self.eight(starts, n) ^ (n.astype(np.uint64) * _GOLD))
        long = n > _LONG
        live = np.flatnonzero((n > 8) & ~long)
        i = 8
        while len(live):
            at, left = starts[live] + i, n[live] - i
            out[live] = mix((out[live] + _GOLD) ^ self.eight(at, left))
            live = live[left > 8]
            i += 8
        for k in np.flatnonzero(long):
            digest = hashlib.blake2b(self.raw[starts[k] : ends[k]], digest_size=8).digest()
            out[k] = int.from_bytes(digest, "little")
        return out

    def same(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> bool:
        """Whether the spans of n bytes at a and at b are the same, pair by pair."""
        live = np.flatnonzero((n > 0) & (a != b))
        long = live[n[live] > _LONG]
        live = live[n[live] <= _LONG]
        i = 0
        while len(live):
            left = n[live] - i
            if not np.array_equal(self.eight(a[live] + i, left), self.eight(b[live] + i, left)):
                return False
            live = live[left > 8]
            i += 8
        return all(np.array_equal(self.raw[a[k] : a[k] + n[k]], self.raw[b[k] : b[k] + n[k]]) for k in long)

    def distinct(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(a place of each distinct span, for each span the number of its like): by hash, with the bytes compared."""
        h = self.hashes(starts, ends)
        names, inv = np.unique(h, return_inverse=True)
        first = np.empty(len(names), np.int64)
        first[inv[::-1]] = np.arange(len(h) - 1, -1, -1)
        n, to = ends - starts, first[inv]
        long = np.flatnonzero(n > 8)  # of shorter ones the hash and the length are the bytes
        if np.array_equal(n[to], n) and self.same(starts[to[long]], starts[long], n[long]):
            return first, inv
        known: dict[bytes, int] = {}  # two spans share a hash
        data, first = self.raw.tobytes(), []
        for k, (x, y) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
            inv[k] = known.setdefault(data[x:y], len(known))
            if inv[k] == len(first):
                first.append(k)
        return np.array(first, np.int64), inv


def word_spans(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends) of the words ``[^\\x20\\x09-\\x0D]+`` of every row, and word offsets by row."""
    n = len(raw)
    gap = SPACES[raw]
    first = np.ones(n + 1, dtype=bool)
    first[1:n] = gap[:-1]
    first[off[off < n]] = True
    starts = np.flatnonzero(first[:n] & ~gap)
    last = first  # the place after a word: a gap, a row's end or the end
    last[:n] = gap
    last[off] = True
    last[n] = True
    # words end at the first such place after their start
    ends_all = np.flatnonzero(last)
    ends = ends_all[np.searchsorted(ends_all, starts, "right")]
    return starts, ends, np.searchsorted(starts, off, "left").astype(np.int64)


def word_hashes(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (A-Z lowered) of every row, and word offsets by row."""
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    starts, ends, words = word_spans(raw, off)
    return Spans(LOWER[raw]).hashes(starts, ends), words


def segment_ids(off: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(off) - 1), np.diff(off))


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 and edges a-b: the smallest node of each node's component."""
    lab = np.arange(n)
    while len(a):
        la, lb = lab[a], lab[b]
        m = np.minimum(la, lb)
        np.minimum.at(lab, la, m)
        np.minimum.at(lab, lb, m)
        while True:
            nxt = lab[lab]
            if np.array_equal(nxt, lab):
                break
            lab = nxt
        keep = lab[a] != lab[b]
        a, b = a[keep], b[keep]
    return lab


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays in one compressed blob: pyarrow's zstd over concatenated bytes, with a small header."""
    head = np.array([len(arrays), *(x for v in arrays for x in (len(v), ord(v.dtype.char)))], dtype=np.int64)
    body = b"".join([head.tobytes(), *(np.ascontiguousarray(v).tobytes() for v in arrays)])
    return len(body).to_bytes(8, "little") + pa.compress(body, codec="zstd", asbytes=True)


def unpack(blob: bytes) -> list[np.ndarray]:
    body = pa.decompress(memoryview(blob)[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    k = int(np.frombuffer(body, np.int64, 1)[0])
    head = np.frombuffer(body, np.int64, 1 + 2 * k)[1:].reshape(-1, 2)
    at, out = 8 * (1 + 2 * k), []
    for n, c in head:
        kind = np.dtype(chr(c))
        out.append(np.frombuffer(body, kind, int(n), at))
        at += int(n) * kind.itemsize
    return out


def gaps(keys: np.ndarray) -> np.ndarray:
    """Sorted 64-bit keys as differences, byte by byte of their order, of which the high ones compress."""
    return np.ascontiguousarray(np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T).ravel()


def from_gaps(raw: np.ndarray) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def small(x: np.ndarray) -> np.ndarray:
    """Counts in the fewest bytes that hold them all, flat."""
    most = int(x.max()) if x.size else 0
    return x.astype(next((t for t, n in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32)) if most < 1 << n), np.int64)).ravel()
