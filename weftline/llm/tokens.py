"""Token-ID output: a wavelet matrix per shard, in one compressed file with a document table.

Texts are encoded by the tokenizers library. For Latin texts its byte-level splitting is done in numpy, and
the library encodes each distinct piece once per worker (pieces are told apart by their bytes); a test holds this
path against the library on whole texts. A text with any other character, or with a special token's string, goes to
the library as it is.

File (little-endian): MAGIC, int64 length of the head, the head (JSON: ids, docs, planes, zeros, and the places of the
parts), then zstd parts: document ids, their lengths, and for every bit-plane its packed bits and the ranks at
every 512th bit. ``WaveletMatrix`` answers access, rank, count and select from the planes it needs.

Defined results: a null text is empty; every document ends with id 0, so that an empty one has one id; a null
doc_id sorts first; rows of equal doc_id follow in order of their texts; an empty table writes and reads nothing;
other columns are ignored.
"""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.common import Spans, bounded, pieces, table, utf8, work_dir, write_shared

MAGIC = b"WLWAVE1\n"
BLOCK = 512
SHARD_IDS = 4 << 20
CHUNK = 4 << 20
KNOWN = 1_500_000
JOINED = 100
END = 0


# ---- the wavelet matrix ----------------------------------------------------------------------


class WaveletMatrix:
    """Bit-planes from the highest bit; zeros go before ones, in stable order, from plane to plane."""

    def __init__(self, n: int, zeros: list[int], planes, ranks) -> None:
        self.n, self.zeros, self._planes, self._ranks = n, zeros, planes, ranks
        self._got: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        cur, zeros, planes, ranks = ids, [], [], []
        for b in range(bits - 1, -1, -1):
            one = ((cur >> b) & 1).astype(bool)
            packed = np.packbits(one)
            planes.append(packed)
            ranks.append(cls._directory(packed))
            low, high = cur[~one], cur[one]
            zeros.append(len(low))
            cur = np.concatenate([low, high])
        return cls(len(ids), zeros, planes.__getitem__, ranks.__getitem__)

    @staticmethod
    def _directory(packed: np.ndarray) -> np.ndarray:
        """Ones before every block of BLOCK bits."""
        ones = np.bitwise_count(packed)
        starts = np.arange(0, len(packed), BLOCK // 8)
        sums = np.add.reduceat(ones, starts, dtype=np.int64) if len(packed) else np.zeros(0, np.int64)
        return np.concatenate([[0], np.cumsum(sums)]).astype(np.uint32)

    def _level(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        if k not in self._got:
            self._got[k] = (self._planes(k), self._ranks(k))
        return self._got[k]

    def _ones(self, k: int, i: int) -> int:
        """Ones among the first i bits of plane k."""
        packed, ranks = self._level(k)
        block = i // BLOCK
        part = packed[block * (BLOCK // 8) : i // 8]
        out = int(ranks[block]) + int(np.bitwise_count(part).sum())
        return out + (int(packed[i // 8] >> (8 - i % 8)).bit_count() if i % 8 else 0)

    def _bit(self, k: int, i: int) -> int:
        return int(self._level(k)[0][i // 8] >> (7 - i % 8)) & 1

    def access(self, i: int) -> int:
        out = 0
        for k, z in enumerate(self.zeros):
            bit = self._bit(k, i)
            ones = self._ones(k, i)
            i = z + ones if bit else i - ones
            out = out << 1 | bit
        return out

    def _range(self, symbol: int, a: int, b: int) -> tuple[int, int]:
        """Where the symbol's occurrences in [a, b) stand behind the last plane."""
        if symbol >> len(self.zeros):
            return 0, 0
        for k, z in enumerate(self.zeros):
            x, y = self._ones(k, a), self._ones(k, b)
            a, b = (z + x, z + y) if symbol >> (len(self.zeros) - 1 - k) & 1 else (a - x, b - y)
        return a, b

    def rank(self, symbol: int, i: int) -> int:
        """Occurrences of the symbol among the first i ids."""
        a, b = self._range(symbol, 0, i)
        return b - a

    def count(self, symbol: int) -> int:
        return self.rank(symbol, self.n)

    def _select(self, k: int, bit: int, j: int) -> int:
        """The place of the j-th (from 0) such bit of plane k."""
        packed, ranks = self._level(k)
        if bit:
            block = int(np.searchsorted(ranks, j, "right")) - 1
            j -= int(ranks[block])
        else:
            zeros = np.arange(len(ranks), dtype=np.int64) * BLOCK - ranks
            block = int(np.searchsorted(zeros, j, "right")) - 1
            j -= int(zeros[block])
        bits = np.unpackbits(packed[block * (BLOCK // 8) : (block + 1) * (BLOCK // 8)])
        return block * BLOCK + int(np.flatnonzero(bits == bit)[j])

    def select(self, symbol: int, j: int) -> int:
        """The place of the symbol's j-th occurrence, from 0."""
        a, b = self._range(symbol, 0, self.n)
        if not 0 <= j < b - a:
            raise IndexError(j)
        i = a + j
        for k in range(len(self.zeros) - 1, -1, -1):
            bit = symbol >> (len(self.zeros) - 1 - k) & 1
            i = self._select(k, bit, i - self.zeros[k] if bit else i)
        return i

    def occurrences(self, symbol: int) -> list[int]:
        return [self.select(symbol, j) for j in range(self.count(symbol))]

    def all(self) -> np.ndarray:
        """Every id in order: the planes undone from the lowest."""
        cur = np.zeros(self.n, dtype=np.uint16 if len(self.zeros) <= 16 else np.uint32)
        for k in range(len(self.zeros) - 1, -1, -1):
            one = np.unpackbits(self._planes(k), count=self.n).view(bool)
            out = np.empty_like(cur)
            out[~one] = cur[: self.zeros[k]]
            out[one] = cur[self.zeros[k] :] | cur.dtype.type(1 << (len(self.zeros) - 1 - k))
            cur = out
        return cur


def dump(ids: np.ndarray, doc_ids: list[int | None], lengths: np.ndarray, bits: int) -> bytes:
    """A shard's file."""
    wave = WaveletMatrix.build(ids, bits)
    known = np.array([d is not None for d in doc_ids], dtype=bool)
    numbers = np.array([0 if d is None else d for d in doc_ids], dtype=np.int64)
    parts = [numbers, np.packbits(known), np.asarray(lengths, dtype=np.int64)]
    for k in range(bits):
        parts += [wave._planes(k), wave._ranks(k)]
    raw = [p.tobytes() for p in parts]
    blobs = [pa.compress(r, codec="zstd", asbytes=True) for r in raw]
    head = json.dumps({"ids": len(ids), "docs": len(doc_ids), "bits": bits, "zeros": wave.zeros, "parts": [[len(b), len(r)] for b, r in zip(blobs, raw, strict=True)]}).encode()
    return b"".join([MAGIC, len(head).to_bytes(8, "little"), head, *blobs])


class Shard:
    """A shard's file, opened: parts are inflated when asked for."""

    def __init__(self, data) -> None:
        data = memoryview(data)
        if bytes(data[:8]) != MAGIC:
            raise ValueError("not a shard file")
        size = int.from_bytes(data[8:16], "little")
        head = json.loads(bytes(data[16 : 16 + size]))
        places, at = [], 16 + size
        for packed, _ in head["parts"]:
            places.append(at)
            at += packed
        if at != len(data):
            raise ValueError("a shard file of another length than its head says")

        def part(i: int, kind) -> np.ndarray:
            a, (n, full) = places[i], head["parts"][i]
            return np.frombuffer(pa.decompress(data[a : a + n], decompressed_size=full, codec="zstd", asbytes=True), kind)

        known = np.unpackbits(part(1, np.uint8), count=head["docs"])
        self.doc_ids = [int(d) if k else None for d, k in zip(part(0, np.int64), known, strict=True)]
        self.lengths = part(2, np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.wave = WaveletMatrix(head["ids"], head["zeros"], lambda k: part(3 + 2 * k, np.uint8), lambda k: part(4 + 2 * k, np.uint32))

    def tokens(self, i: int) -> list[int]:
        """The ids of the i-th document, by access."""
        return [self.wave.access(j) for j in range(int(self.starts[i]), int(self.starts[i + 1]))]


# ---- encoding --------------------------------------------------------------------------------

_LETTER, _NUMBER, _SPACE, _OTHER = 0, 1, 2, 3
_TABLE = 0x250  # characters that the numpy path splits itself; ‐-‧ and ‰-⁞ are punctuation besides


def _classes() -> np.ndarray:
    import unicodedata

    out = np.full(_TABLE, _OTHER, dtype=np.uint8)
    for c in range(_TABLE):
        kind = unicodedata.category(chr(c))[0]
        out[c] = _LETTER if kind == "L" else _NUMBER if kind == "N" else _OTHER
    out[[9, 10, 11, 12, 13, 32, 0x85, 0xA0]] = _SPACE
    return out


class Encoder:
    """Whole texts to ids, equal to the library's own."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.lib.get_added_tokens_decoder().values()]
        self.bits = max(1, (self.lib.get_vocab_size(with_added_tokens=True) - 1).bit_length())
        self.kind = np.uint16 if self.bits <= 16 else np.uint32
        self.classes = _classes()
        self._forget()

    def _forget(self) -> None:
        # known pieces of at most two words of eight bytes: hash -> row, and their bytes
        self.keys, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.bytes = np.zeros((3, 0), np.uint64)  # length, first and last words
        self.first, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, self.kind)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, how many are each piece's, where they begin). Pieces go to the library joined, where its own splitting parts
        them again: those with a space before them as they are, others by line ends; blank ones go alone."""
        lead = [i for i, p in enumerate(names) if p[0] == " " and not p.isspace()]
        plain = [i for i, p in enumerate(names) if p[0] != " " and not p.isspace()]
        flat, size, begin, at = [np.zeros(0, self.kind)], np.zeros(len(names), np.int32), np.zeros(len(names), np.int64), 0
        for rows, gap in ((lead, ""), (plain, "\n")):
            parts = [rows[k : k + JOINED] for k in range(0, len(rows), JOINED)]
            for part, e in zip(parts, self.lib.encode_batch([gap.join(names[i] for i in part) for part in parts], add_special_tokens=False), strict=True):
                ids, word = np.array(e.ids, self.kind), np.array(e.word_ids, np.int64)
                if gap:
                    ids, word = ids[word % 2 == 0], word[word % 2 == 0] // 2
                if len(word) == 0 or word[-1] != len(part) - 1 or (np.diff(word) > 1).any():
                    raise ValueError("the library splits pieces otherwise than this encoder")
                size[part] = count = np.bincount(word, minlength=len(part))
                begin[part] = at + np.cumsum(count) - count
                flat.append(ids)
                at += len(ids)
        alone = [i for i, p in enumerate(names) if p.isspace()]
        for i, ids in zip(alone, self._ids([names[i] for i in alone]), strict=True):
            size[i], begin[i] = len(ids), at
            flat.append(np.array(ids, self.kind))
            at += len(ids)
        return np.concatenate(flat), size, begin

    def split(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(byte starts of the pieces of all rows, rows that the library must take whole)."""
        n = len(raw)
        lead = raw >= 0xC0
        cls = self.classes[np.minimum(raw, 0x7F)]
        odd = np.zeros(0, np.int64)
        at = np.flatnonzero(lead)
        if len(at):
            b0 = raw[at].astype(np.int64)
            cp = (b0 & 0x1F) << 6 | (raw[np.minimum(at + 1, n - 1)] & 0x3F)
            three = b0 >= 0xE0
            cp3 = (b0 & 0x0F) << 12 | (raw[np.minimum(at + 1, n - 1)].astype(np.int64) & 0x3F) << 6 | (raw[np.minimum(at + 2, n - 1)] & 0x3F)
            cp = np.where(three, cp3, cp)
            mark = (b0 < 0xF0) & three & ((cp >= 0x2010) & (cp <= 0x2027) | (cp >= 0x2030) & (cp <= 0x205E))
            odd = at[~(mark | (cp < _TABLE))]
            kind = np.where(mark, _OTHER, self.classes[np.minimum(cp, _TABLE - 1)]).astype(np.uint8)
            cls[at] = kind
            cls[np.minimum(at + 1, n - 1)] = kind  # a lead byte has at least one more behind it
            cls[at[three] + 2] = kind[three]
            four = b0 >= 0xF0
            cls[at[four] + 3] = kind[four]
        begin = np.zeros(n + 1, dtype=bool)
        begin[off] = True  # also at n
        change = np.ones(n + 1, dtype=bool)
        change[1:n] = cls[1:] != cls[:-1]
        change |= begin
        blank = cls == _SPACE
        # the last character of a space run before a non-space of the same row: a space joins it, another stands alone
        runs = np.flatnonzero(change[:n])
        ends = np.append(runs[1:], n)
        s = blank[runs]
        inner = s & ~begin[ends]
        last_byte = ends[inner] - 1
        # of a two-byte space (U+0085, U+00A0) the character begins a byte earlier
        lone = raw[last_byte] != 32
        last = last_byte - (raw[last_byte] >= 0x80)
        start = change[:n].copy()
        start[last] = True
        start[ends[inner][~lone]] = False
        # contractions: an apostrophe that is a piece's first character, and letters behind it
        q = runs[(raw[runs] == 39) & (ends - runs == 1)]
        q = q[start[q]]
        if len(q):
            q = q[~begin[q + 1]]
            x = raw[np.minimum(q + 1, n - 1)]
            y = np.where(begin[np.minimum(q + 2, n)], 0, raw[np.minimum(q + 2, n - 1)])
            one = np.isin(x, np.frombuffer(b"stmd", np.uint8))
            two = (x == 114) & (y == 101) | (x == 118) & (y == 101) | (x == 108) & (y == 108)
            start[q[one | two] + 1] = False
            after = np.concatenate([q[one] + 2, q[two] + 3])
            # letters behind it are a piece of their own; anything else begins one anyway
            start[after[after < n]] = True
        rows = np.unique(np.searchsorted(off, odd, "right") - 1)
        return np.flatnonzero(start), rows

    def _rows(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of ids, first ids among ``flat``) of each piece. A piece is known by its bytes, which a hash finds;
        pieces that are not, and longer ones, go to the library."""
        spans = Spans(raw)
        first, inv = spans.distinct(starts, ends)
        a, n = starts[first], ends[first] - starts[first]
        h = spans.hashes(a, a + n)
        own = np.stack([n.astype(np.uint64), spans.eight(a, n), spans.eight(a + np.minimum(8, n), np.maximum(n - 8, 0))])
        place = np.searchsorted(self.keys, h)
        known = np.zeros(len(h), dtype=bool)
        rows = np.zeros(len(h), np.int64)
        there = np.zeros(len(h), dtype=bool)
        if len(self.keys):
            at = np.minimum(place, len(self.keys) - 1)
            rows[:] = self.at[at]
            there = self.keys[at] == h
            known = there & (n <= 16) & (self.bytes[:, rows] == own).all(axis=0)
        fresh = np.flatnonzero(~known)
        size, begin, flat = self.size[rows] if len(self.size) else np.zeros(len(h), np.int32), self.first[rows] if len(self.first) else np.zeros(len(h), np.int64), self.flat
        if len(fresh):
            keep = (n[fresh] <= 16) & ~there[fresh]
            fresh = np.concatenate([fresh[keep], fresh[~keep]])  # those to be known come first
            k = int(keep.sum())
            data = raw.tobytes()
            names = [data[x:y].decode() for x, y in zip(a[fresh].tolist(), (a[fresh] + n[fresh]).tolist(), strict=True)]
            (new, size[fresh[:k]], at1), (more, size[fresh[k:]], at2) = self._pieces(names[:k]), self._pieces(names[k:])
            begin[fresh[:k]], begin[fresh[k:]] = len(self.flat) + at1, len(self.flat) + len(new) + at2
            flat = np.concatenate([self.flat, new, more])
            to = fresh[:k]
            order = np.argsort(h[to])
            to = to[order]
            once = np.ones(k, dtype=bool)  # two new pieces of one hash: the first is known
            once[1:] = h[to][1:] != h[to][:-1]
            to = to[once]
            self.keys, self.at = np.insert(self.keys, place[to], h[to]), np.insert(self.at, place[to], len(self.size) + np.arange(len(to), dtype=np.int32))
            self.bytes = np.concatenate([self.bytes, own[:, to]], axis=1)
            self.first, self.size = np.concatenate([self.first, begin[to]]), np.concatenate([self.size, size[to]])
            self.flat = flat[: len(self.flat) + len(new)]
        self.now = flat
        return size[inv], begin[inv]

    def encode(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows with END behind each, numbers of ids by row)."""
        if len(self.keys) > KNOWN:  # bounded memory; they come again
            self._forget()
        n = len(off) - 1
        starts, whole = self.split(raw, off)
        joined = raw.tobytes()
        for s in self.special:
            at = joined.find(s)
            while at >= 0:
                whole = np.append(whole, np.searchsorted(off, at, "right") - 1)
                at = joined.find(s, at + 1)
        ends = np.append(starts[1:], len(raw))
        of = np.searchsorted(off, starts, "right") - 1
        if len(whole):
            mask = np.zeros(n, dtype=bool)
            mask[whole] = True
            keep = ~mask[of]
            starts, ends, of = starts[keep], ends[keep], of[keep]
            by_lib = {int(i): self._ids([joined[off[i] : off[i + 1]].decode()])[0] for i in np.flatnonzero(mask)}
        else:
            by_lib = {}
        if len(starts):
            size, first = self._rows(raw, starts, ends)
        else:
            size = first = np.zeros(0, np.int64)
        lengths = np.bincount(of, weights=size, minlength=n).astype(np.int64)
        for i, ids in by_lib.items():
            lengths[i] = len(ids)
        begin = np.concatenate([[0], np.cumsum(lengths + 1)])
        out = np.full(int(begin[-1]), END, dtype=self.kind)
        total = int(size.sum())
        if total:
            before = np.cumsum(size) - size
            at = np.repeat(first - before, size)
            at += np.arange(total)
            ids = self.now[at]
            if not by_lib:
                mask = np.ones(len(out), dtype=bool)
                mask[begin[1:] - 1] = False
                out[mask] = ids
            else:
                # the place of a piece: its row's start and the sizes before it in the row
                row_first = np.zeros(n, dtype=np.int64)
                row_of, where = np.unique(of, return_index=True)
                row_first[row_of] = before[where]
                to = np.repeat(begin[of] + before - row_first[of] - before, size) + np.arange(total)
                out[to] = ids
        for i, ids in by_lib.items():
            out[begin[i] : begin[i] + len(ids)] = ids
        return out, lengths + 1


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


# ---- shards ----------------------------------------------------------------------------------


def write_shards(docs: DataFrame, folder: str, vocabulary: str, shards: int, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Writes (doc_id, text) in ascending doc_id order; (file, docs, ids) of each file, whose names sort in that order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part, files = encoder(vocabulary), TaskContext.get().partitionId(), []
        held: list[tuple[np.ndarray, list[int | None], np.ndarray]] = []
        size = 0

        def close() -> None:
            nonlocal held, size
            ids, docs, lengths = zip(*held, strict=True)
            name = f"{folder}/shard-{part:07d}-{len(files):06d}.wave"
            write_shared(name, dump(np.concatenate(ids), [d for x in docs for d in x], np.concatenate(lengths), enc.bits))
            files.append((name.rpartition("/")[2], sum(map(len, docs)), size))
            held, size = [], 0

        for batch in batches:
            raw, off = utf8(batch.column("text"))
            names = batch.column("doc_id").to_pylist()
            for a, b in pieces(off, CHUNK):
                ids, lengths = enc.encode(raw[off[a] : off[b]], off[a : b + 1] - off[a])
                if held and size + len(ids) > shard_ids:
                    close()
                held.append((ids, names[a:b], lengths))
                size += len(ids)
        if held:
            close()
        if files:
            f, d, i = zip(*files, strict=True)
            yield pa.record_batch([pa.array(f), pa.array(d, pa.int64()), pa.array(i, pa.int64())], names=["file", "docs", "ids"])

    bounded(docs.sparkSession, 8 << 20)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
    return rows.mapInArrow(run, "file string, docs bigint, ids bigint")


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """(file, doc_id, at, n_tokens, ids_crc32) of every document, from the files alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                shard = Shard(content.as_buffer())
                ids = shard.wave.all()
                crc = [zlib.crc32(ids[a:b].astype("<u4")) for a, b in zip(shard.starts[:-1], shard.starts[1:], strict=True)]
                n = len(crc)
                yield pa.record_batch(
                    [pa.array([path.as_py().rpartition("/")[2]] * n), pa.array(shard.doc_ids, pa.int64()), pa.array(shard.starts[:-1]), pa.array(shard.lengths), pa.array(crc, pa.int64())],
                    names=["file", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wave").load(folder).select("path", "content")
    return files.mapInArrow(run, "file string, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint")


def op10_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    folder = work_dir(spark, "waves")
    shards = max(1, math.ceil(1.5 * docs.rdd.getNumPartitions()))
    files = spark.createDataFrame(write_shards(docs, folder, public_tokenizers.path("byte_bpe_50k.json"), shards).toPandas(), "file string, docs bigint, ids bigint")
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    firsts = files.select("file", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("first"))
    if firsts.isEmpty():
        return spark.createDataFrame([], "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    return read_shards(spark, folder).join(firsts, "file").select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
