"""Token alignment of two tokenizers: groups of tokens between the byte places where both end, and counts of linked ids.

Every byte of a text has a label: no token ends with it, one of A, one of B, or both. A regular expression takes spans up
to each byte where both end; the numbers of labels in a span say how many tokens of either side make its group. Both
tokenizers split before a space that follows a character which is none (checked for B's pieces when it is opened), so
labels, groups and links are made once for each distinct chunk between such places, and texts are put together from them.

Two tokens that end together are one the other's end, byte for byte, so the pairs that can be linked are known from the
vocabularies alone (``Pairs``: under half a million). That bounds what is counted, collected and broadcast, whatever the
corpus. Texts are encoded once: each document's links are written, and joined with the counts when all are known.

Defined results: a text that is null, empty, or not what its tokens' bytes say (as one with U+2581 in it) has no tokens:
zeros and an empty digest; special tokens' strings are plain text; rows of equal doc_id, a null one too, are documents of
their own; an empty table has no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import Spans, bounded, pack, pieces, table, unpack, utf8, work_dir
from weftline.llm.tokens import Encoder

CHUNK = 4 << 20  # bytes of text that are taken together
KNOWN_BYTES = 192 << 20  # what a worker remembers of chunks, about
SPACE = "▁"
NONE, A_END, B_END, BOTH = 0, 1, 2, 3
_GROUP = re.compile(rb"[\x00-\x02]*\x03")


# ---- the two tokenizers ----------------------------------------------------------------------


def byte_of_char() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others from
    U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class Plain(Encoder):
    """The byte-level tokenizer with special tokens' strings as plain text; splits that are not the library's own fall
    back to the library."""

    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.special, self.lib.encode_special_tokens = [], True
        of = byte_of_char()
        self.tokens: list[bytes] = [b""] * self.lib.get_vocab_size(with_added_tokens=True)
        added = {t.content for t in self.lib.get_added_tokens_decoder().values()}
        for piece, i in self.lib.get_vocab(with_added_tokens=True).items():
            self.tokens[i] = b"" if piece in added else bytes(of[c] for c in piece)

    def _pieces(self, names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        try:
            return super()._pieces(names)
        except ValueError:
            ids = self._ids(names)
            size = np.array([len(x) for x in ids], np.int32)
            return np.array([i for x in ids for i in x], self.kind), size, np.cumsum(size, dtype=np.int64) - size


class Pieces:
    """The piece tokenizer, whose texts begin with a space that it adds itself."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        self.tokens: list[bytes] = []
        for i in range(self.lib.get_piece_size()):
            piece = self.lib.id_to_piece(i)
            if self.lib.is_byte(i):
                self.tokens.append(bytes([int(piece[3:5], 16)]))
            elif self.lib.is_control(i) or self.lib.is_unknown(i):
                self.tokens.append(b"")
            elif SPACE in piece.lstrip(SPACE):
                raise ValueError(f"piece {piece!r} goes on behind a space: chunks cannot be encoded by themselves")
            else:
                self.tokens.append(piece.replace(SPACE, " ").encode())
        self.space = self.lib.piece_to_id(SPACE)

    def encode(self, chunks: list[bytes]) -> list[list[int]]:
        """Chunks that begin with a space. The library makes nothing of an empty text, which a lone space would be."""
        out = self.lib.encode([c[1:].decode("utf-8", "replace") for c in chunks], num_threads=1)
        return [ids if len(c) > 1 else [self.space] for ids, c in zip(out, chunks, strict=True)]


class Pairs:
    """The pairs of ids whose tokens can end together, numbered: of their bytes one ends with the other."""

    def __init__(self, a: list[bytes], b: list[bytes]) -> None:
        def ends(long: list[bytes], short: list[bytes], proper: int) -> Iterator[tuple[int, int]]:
            of: dict[bytes, list[int]] = {}
            for i, x in enumerate(short):
                if x:
                    of.setdefault(x, []).append(i)
            for i, x in enumerate(long):
                for k in range(proper, len(x)):
                    for j in of.get(x[k:], ()):
                        yield i, j

        codes = [i << 32 | j for i, j in ends(a, b, 0)] + [i << 32 | j for j, i in ends(b, a, 1)]
        self.codes = np.unique(np.array(codes, np.int64))
        self.b = self.codes & 0xFFFFFFFF

    def __len__(self) -> int:
        return len(self.codes)

    def number(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.codes, a.astype(np.int64) << 32 | b)


# ---- alignment -------------------------------------------------------------------------------


class _Bytes:
    """The bytes of tokens by id."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        at = np.repeat(self.first[ids] - (np.cumsum(size) - size), size)
        return self.flat[at + np.arange(len(at))]


def labels(n: int, a_ends: np.ndarray, b_ends: np.ndarray) -> bytes:
    """The label string of n bytes, from the places behind either side's tokens."""
    out = np.full(n, NONE, np.uint8)
    out[a_ends - 1] |= A_END
    out[b_ends - 1] |= B_END
    return out.tobytes()


def groups(label: bytes) -> np.ndarray:
    """For each span up to a byte where both end: the labels of A and of B in it, which are its tokens."""
    ends = np.cumsum(np.fromiter(map(len, _GROUP.findall(label)), np.int64))
    at = np.frombuffer(label, np.uint8)
    return np.stack([np.diff(np.append(0, np.cumsum(at & side > 0))[np.append(0, ends)]) for side in (A_END, B_END)])


def chunk_starts(raw: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Places of raw where a row begins, or a space follows a character that is no white space."""
    before = np.empty_like(raw)
    before[1:], before[:1] = raw[:-1], 32
    cut = (raw == 32) & (before > 32) & (before != 127)
    # white space of several bytes: U+0085, U+00A0, U+1680, U+2000 to U+200A, U+2028, U+2029, U+202F, U+205F, U+3000
    high = np.flatnonzero(cut & (before >= 0x80))
    if len(high):
        x, y, z = raw[high - 1], raw[np.maximum(high - 2, 0)], raw[np.maximum(high - 3, 0)]
        two = (y == 0xC2) & ((x == 0x85) | (x == 0xA0))
        three = (z >= 0xE1) & (z <= 0xE3) & ((y == 0x80) | (y == 0x81) | (y == 0x9A))
        cut[high[two | three]] = False
    cut[begin] = True
    return np.flatnonzero(cut)


class Aligner:
    """Alignments of texts; remembers those of chunks."""

    def __init__(self, a_path: str, b_path: str) -> None:
        self.a, self.b = Plain(a_path), Pieces(b_path)
        self.a_bytes, self.b_bytes = _Bytes(self.a.tokens), _Bytes(self.b.tokens)
        self.pairs = Pairs(self.a.tokens, self.b.tokens)
        self.a_names, self.b_names = [str(i) for i in range(len(self.a.tokens))], [str(i) for i in range(len(self.b.tokens))]
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.texts: list[bytes] = []  # groups of each chunk, as they are digested
        self.counts = np.zeros((3, 0), np.int64)  # tokens of A, of B, groups; -1 groups: no alignment
        self.first, self.links = np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.held = 0

    def _learn(self, fresh: list[bytes]) -> None:
        raw = np.frombuffer(b"".join(fresh), np.uint8)
        off = np.array([0, *accumulate(map(len, fresh))], np.int64)
        ids, lengths = self.a.encode(raw, off)
        keep = np.ones(len(ids), bool)
        keep[np.cumsum(lengths) - 1] = False  # the ends
        a_ids, a_n = ids[keep].astype(np.int64), lengths - 1
        listed = self.b.encode(fresh)
        b_n = np.array([len(x) for x in listed], np.int64)
        b_ids = np.fromiter(chain.from_iterable(listed), np.int64)
        good = np.ones(len(fresh), bool)
        for side, of, n in ((self.a_bytes, a_ids, a_n), (self.b_bytes, b_ids, b_n)):
            ends = np.append(0, np.cumsum(side.size[of]))
            token = np.append(0, np.cumsum(n))
            same = np.diff(ends[token]) == np.diff(off)
            if same.all():
                differ = np.flatnonzero(side.joined(of) != raw)
                same[np.searchsorted(off, differ, "right") - 1] = False
            else:
                joined = side.joined(of)
                for k in np.flatnonzero(same):
                    same[k] = np.array_equal(joined[ends[token[k]] : ends[token[k + 1]]], raw[off[k] : off[k + 1]])
            good &= same
        a_in, b_in = np.repeat(good, a_n), np.repeat(good, b_n)
        a_ids, b_ids = a_ids[a_in], b_ids[b_in]
        a_n, b_n, size = np.where(good, a_n, 0), np.where(good, b_n, 0), np.where(good, np.diff(off), 0)
        # of good chunks alone the tokens' bytes follow each other without gaps
        label = labels(int(size.sum()), np.cumsum(self.a_bytes.size[a_ids]), np.cumsum(self.b_bytes.size[b_ids]))
        found = groups(label)
        a_names, b_names = list(map(self.a_names.__getitem__, a_ids.tolist())), list(map(self.b_names.__getitem__, b_ids.tolist()))
        made, i, j = [], 0, 0
        for x, y in found.T.tolist():
            made.append(f"{a_names[i]}|{b_names[j]}" if x == y == 1 else f"{','.join(a_names[i : i + x])}|{','.join(b_names[j : j + y])}")
            i, j = i + x, j + y
        both = np.frombuffer(label, np.uint8) == BOTH
        n_groups = np.diff(np.append(0, np.cumsum(both))[np.append(0, np.cumsum(size))])
        last_a, last_b = a_ids[np.cumsum(found[0]) - 1], b_ids[np.cumsum(found[1]) - 1]
        ends = np.cumsum(n_groups).tolist()
        self.texts += [";".join(made[x:y]).encode() for x, y in zip([0, *ends[:-1]], ends, strict=True)]
        self.known.update(zip(fresh, range(len(self.known), len(self.known) + len(fresh)), strict=True))
        first = len(self.links) + np.cumsum(n_groups) - n_groups
        self.first, self.links = np.append(self.first, first), np.append(self.links, self.pairs.number(last_a, last_b).astype(np.uint32))
        self.counts = np.hstack([self.counts, np.stack([a_n, b_n, np.where(good, n_groups, -1)])])
        self.held += 250 * len(fresh) + sum(map(len, fresh)) + 16 * len(made)

    def align(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, list[str], list[bytes]]:
        """Of every row: (tokens of A, of B, groups), the digest of its groups, and its links' numbers."""
        if self.held > KNOWN_BYTES:  # bounded memory; they come again
            self._forget()
        n, rows = len(raw), len(off) - 1
        has = np.flatnonzero(np.diff(off) > 0)
        totals, digests, linked = np.zeros((3, rows), np.int64), [""] * rows, [b""] * rows
        if not len(has):
            return totals, digests, linked
        spaced = np.full(n + len(has), 32, np.uint8)
        begin = off[has] + np.arange(len(has))
        mask = np.ones(len(spaced), bool)
        mask[begin] = False
        spaced[mask] = raw
        starts = chunk_starts(spaced, begin)
        ends = np.append(starts[1:], len(spaced))
        first, inv = Spans(spaced).distinct(starts, ends)
        data = spaced.tobytes()
        names = [data[x:y] for x, y in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        fresh = [name for name in names if name not in self.known]
        if fresh:
            self._learn(fresh)
        refs = np.array([self.known[name] for name in names], np.int64)[inv]
        bounds = np.append(np.searchsorted(starts, begin), len(starts))
        got = self.counts[:, refs]
        bad = np.add.reduceat(got[2] < 0, bounds[:-1]) > 0
        size = np.maximum(got[2], 0)
        places = np.append(0, np.cumsum(size))
        at = np.repeat(self.first[refs] - places[:-1], size)
        links = self.links[at + np.arange(len(at))]
        sums = np.add.reduceat(got, bounds[:-1], axis=1)
        totals[:, has] = np.where(bad, 0, sums)
        texts = self.texts.__getitem__
        for k, (row, x, y) in enumerate(zip(has.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            if not bad[k]:
                digests[row] = hashlib.sha256(b";".join(map(texts, refs[x:y].tolist()))).hexdigest()
                linked[row] = links[places[x] : places[y]].astype("<u4").tobytes()
        return totals, digests, linked


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    key = (a_path, b_path)
    if key not in _aligners:
        _aligners[key] = Aligner(*key)
    return _aligners[key]


# ---- the corpus ------------------------------------------------------------------------------

_ALIGNED = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, links binary, counts binary"


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """A row for each document with its links, and one for each task with the counts of all its links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = aligner(a_path, b_path)
        seen = np.zeros(len(by.pairs), np.int64)
        names = [c.split()[0] for c in _ALIGNED.split(", ")]
        for batch in batches:
            raw, off = utf8(batch.column("text"))
            ids = batch.column("doc_id")
            for x, y in pieces(off, CHUNK):
                totals, digests, linked = by.align(raw[off[x] : off[y]], off[x : y + 1] - off[x])
                seen += np.bincount(np.frombuffer(b"".join(linked), "<u4"), minlength=len(seen))
                yield pa.record_batch([ids.slice(x, y - x), *map(pa.array, totals), pa.array(digests, pa.string()), pa.array(linked, pa.binary()), pa.nulls(y - x, pa.binary())], names=names)
        if seen.any():
            at = np.flatnonzero(seen)
            yield pa.record_batch([pa.nulls(1, t) for t in (pa.int64(),) * 4 + (pa.string(), pa.binary())] + [pa.array([pack(at, seen[at])], pa.binary())], names=names)

    bounded(docs.sparkSession, 8 << 20)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _ALIGNED)


def pair_counts(rows: DataFrame, pairs: int) -> np.ndarray:
    """How many links of the corpus each pair has; no more than the vocabularies' pairs come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(pairs, np.int64)
        for batch in batches:
            for blob in batch.column(0):
                at, n = unpack(blob.as_py())
                seen[at] += n
        at = np.flatnonzero(seen)
        yield pa.record_batch([pa.array(at, pa.int64()), pa.array(seen[at], pa.int64())], names=["pair", "n"])

    got = rows.where(F.col("counts").isNotNull()).select("counts").mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(pairs, np.int64)
    out[got.column("pair").to_numpy()] = got.column("n").to_numpy()
    return out


def alignment(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every document."""
    spark = docs.sparkSession
    folder = work_dir(spark, "aligned")
    aligned(docs, a_path, b_path).write.option("compression", "zstd").parquet(folder)
    rows = spark.read.schema(_ALIGNED).parquet(folder)
    pairs = aligner(a_path, b_path).pairs
    counts = pair_counts(rows, len(pairs))
    highest = np.zeros(int(pairs.b.max()) + 1, np.int64)
    np.maximum.at(highest, pairs.b, counts)
    shared = spark.sparkContext.broadcast((counts, counts == highest[pairs.b]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, best = shared.value
        for batch in batches:
            linked = batch.column("links").to_pylist()
            links = np.frombuffer(b"".join(linked), "<u4")
            off = np.array([0, *accumulate(len(x) >> 2 for x in linked)])
            sums = [np.diff(np.append(0, np.cumsum(x[links], dtype=np.int64))[off]) for x in (best, counts)]
            kept = [batch.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups")]
            yield pa.record_batch([*kept, pa.array(np.diff(off)), *map(pa.array, sums), batch.column("groups_sha256")], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    out = rows.where(F.col("counts").isNull()).drop("counts")
    return out.mapInArrow(run, "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return alignment(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
