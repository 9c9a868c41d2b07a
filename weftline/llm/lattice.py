"""SentencePiece encoding and decoding: distinct sampled segmentations by Gumbel top-k without replacement.

The pieces of a model file span a lattice over the text (spaces as U+2581, one before the text). A BPE model's
scores are ranks, so that a piece of rank r weighs 1 / (r + OFFSET); a character without a piece of its own goes through its
bytes. A segmentation's probability is the product of its pieces' weights, over the sum for all segmentations.

The search goes down the tree of prefixes of segmentations: each node holds the Gumbel-perturbed log-probability
of the best completion below it, which the lattice's backward sums make exact, as A* asks of its bound. Taking the
best node off the queue emits one segmentation and leaves its siblings, perturbed below it; so k takes give k
distinct segmentations, in the order of a sample without replacement. ``perturbed_search`` does this over any
lattice. For whole texts the siblings along an emitted path are drawn in numpy, one draw for each step's
siblings together, and a subtree is opened only when it is the best: the same search, lazily.

No piece goes from another character to a U+2581, or across a character that is in no longer piece, so that a
text's lattice is a chain of short ones, worked once per distinct chunk of a batch. Spaces in a row are in one chunk
with the word behind them, since the model has pieces of several spaces. Draws are hashes of the row key, sample, chunk and
step: results do not depend on batches or partitions.

The inclusion score of a sample is log(1 - exp(-exp(log p - t))), t the (k + 1)-th perturbed value: the log of its
chance to be among the k, given that threshold; 0 where all segmentations are returned.

Defined results: a null or empty text has one segmentation, without pieces; a text with fewer than k
segmentations returns all of them; a null row key hashes as 0; rows of equal key and text sample alike; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.common import M64, Spans, bounded, mix, pieces, table, trim, utf8

SPACE = "▁"
OFFSET = 10.0
SAMPLES = 2
CHUNK = 1 << 20  # the lattices of a chunk take about a hundred times its bytes
SEED = 20240607
#: The largest Gumbel draw of a uniform one in 53 bits, rounded up.
_REACH = 38.0
_GOLD = 0x9E3779B97F4A7C15


# ---- the model -------------------------------------------------------------------------------


class Pieces:
    """A model file's pieces, as unigram log-weights."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.names = [sp.id_to_piece(i) for i in range(sp.vocab_size())]
        self.byte = {}
        use: list[tuple[str, int, float]] = []
        for i, p in enumerate(self.names):
            if sp.is_byte(i):
                self.byte[int(p[3:5], 16)] = i
            elif not (sp.is_unknown(i) or sp.is_control(i) or sp.is_unused(i)):
                if SPACE in p.lstrip(SPACE):
                    raise ValueError("a piece goes across a space behind other characters")
                use.append((p, i, sp.get_score(i)))
        use.sort(key=lambda x: -x[2])
        self.logp = np.full(len(self.names), -np.inf)
        for rank, (_, i, _) in enumerate(use):
            self.logp[i] = -math.log(rank + OFFSET)
        self.byte_logp = -math.log(len(use) + OFFSET)
        for i in self.byte.values():
            self.logp[i] = self.byte_logp
        self.ids = {p: i for p, i, _ in use}
        self.longest = max(len(p) for p in self.ids)
        self.raw = [p.replace(SPACE, " ").encode() for p in self.names]
        for b, i in self.byte.items():
            self.raw[i] = bytes([b])
        self.raw_size = np.array([len(r) for r in self.raw])
        self.raw_first, self.raw_all = np.cumsum(self.raw_size) - self.raw_size, np.frombuffer(b"".join(self.raw), np.uint8)
        inside = {c for p in self.ids if len(p) > 1 for c in p}
        self.joins = np.zeros(0x110000, dtype=bool)  # characters of longer pieces
        self.joins[[ord(c) for c in inside]] = True
        single = np.full(0x110000, -1, np.int32)
        for p, i in self.ids.items():
            if len(p) == 1:
                single[ord(p)] = i
        for b, i in self.byte.items():  # a one-byte character is its byte's piece
            if b < 0x80 and single[b] < 0:
                single[b] = i
        self.single = single
        self._trie([p for p in self.ids if len(p) > 1])
        self.lengths = np.zeros(len(self.names), np.int64)
        for p, i in self.ids.items():
            self.lengths[i] = len(p)

    def _trie(self, long: list[str]) -> None:
        """The longer pieces as a trie over classes of characters (0: in none of them), its steps in a table by slots."""
        alphabet = sorted({c for p in long for c in p})
        self.cls = np.zeros(0x110000, np.int32)
        self.cls[[ord(c) for c in alphabet]] = np.arange(1, len(alphabet) + 1)
        of = {c: i + 1 for i, c in enumerate(alphabet)}
        self.width = len(alphabet) + 1
        nodes: dict[tuple[int, int], int] = {}  # (node, class) -> node; 0 is the root
        ends = {}
        for p in long:
            at = 0
            for c in p:
                at = nodes.setdefault((at, of[c]), len(nodes) + 1)
            ends[at] = self.ids[p]
        self.ending = np.full(len(nodes) + 1, -1, np.int32)  # the piece that ends at a node
        self.ending[list(ends)] = list(ends.values())
        self.inner = np.zeros(len(nodes) + 1, dtype=bool)
        self.inner[[at for at, _ in nodes]] = True
        self.bits = max(8, (3 * len(nodes)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        keys = np.array([at * self.width + c for at, c in nodes], np.int64)
        for key, slot, to in zip(keys.tolist(), self._slot(keys).tolist(), nodes.values(), strict=True):
            while self.keys[slot] >= 0:
                slot = (slot + 1) & ((1 << self.bits) - 1)
            self.keys[slot], self.values[slot] = key, to
        self.begin = self.step(np.zeros(self.width, np.int32), np.arange(self.width))  # the root's children

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(_GOLD) >> np.uint64(64 - self.bits)).view(np.int64)

    def step(self, node: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """The child of each node by a class, or -1."""
        key = node.astype(np.int64) * self.width + cls
        slot = self._slot(key)
        got = self.keys[slot]
        out = np.where(got == key, self.values[slot], np.int32(-1))
        live = np.flatnonzero((got != key) & (got >= 0))
        while len(live):
            slot[live] = (slot[live] + 1) & ((1 << self.bits) - 1)
            got = self.keys[slot[live]]
            hit = got == key[live]
            out[live[hit]] = self.values[slot[live[hit]]]
            live = live[~hit & (got >= 0)]
        return out

    def decode(self, ids) -> str:
        """The text of the pieces, without the space put before it."""
        return b"".join(map(self.raw.__getitem__, ids)).decode(errors="replace")[1:]


_models: dict[str, Pieces] = {}


def model(path: str) -> Pieces:
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


# ---- any lattice -----------------------------------------------------------------------------


def lattice(p: Pieces, text: str) -> list[list[tuple[int, float, tuple[int, ...]]]]:
    """For every character position the edges (end, log-weight, piece ids) that begin there."""
    out = []
    for i, c in enumerate(text):
        edges = [(j, p.logp[k], (k,)) for j in range(i + 1, min(len(text), i + p.longest) + 1) if (k := p.ids.get(text[i:j])) is not None]
        if c not in p.ids:
            raw = c.encode()
            edges.append((i + 1, len(raw) * p.byte_logp, tuple(p.byte[b] for b in raw)))
        out.append(edges)
    return out


def backward(edges: list[list[tuple[int, float, tuple[int, ...]]]]) -> list[float]:
    """Log-sums of the weights of all paths from each position to the end."""
    out = [0.0] * (len(edges) + 1)
    for i in range(len(edges) - 1, -1, -1):
        v = [w + out[j] for j, w, _ in edges[i]]
        m = max(v, default=-math.inf)
        out[i] = m + math.log(sum(math.exp(x - m) for x in v)) if m > -math.inf else m
    return out


def perturbed_search(edges, k: int, rng: np.random.Generator) -> list[tuple[tuple[int, ...], float, float]]:
    """At most k (piece ids, log-probability, perturbed log-probability), distinct, best first."""
    beta = backward(edges)
    queue: list = [(-float(rng.gumbel()), 0, 0, 0.0, ())]
    out, serial = [], 0
    while queue and len(out) < k:
        g, _, i, phi, path = heapq.heappop(queue)
        g = -g
        if i == len(edges):
            out.append((path, phi, g))
            continue
        logs = [phi + w + beta[j] - beta[i] for j, w, _ in edges[i]]
        # children's values: Gumbels about their own totals, bent so that the largest is the node's
        z = [x + float(rng.gumbel()) for x in logs]
        top = max(z)
        for (j, w, ids), x, zi in zip(edges[i], logs, z, strict=True):
            v = g - zi + math.log1p(-math.exp(zi - top)) if zi < top else -math.inf
            serial += 1
            child = g - max(v, 0.0) - math.log1p(math.exp(-abs(v))) if zi < top else g
            heapq.heappush(queue, (-child, serial, j, phi + w + beta[j] - beta[i], path + ids))
    return out


# ---- whole texts -----------------------------------------------------------------------------


def uniform(key: np.ndarray) -> np.ndarray:
    """Draws in (0, 1) that hash the key."""
    return ((mix(key) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


class Chunks:
    """The lattices of distinct chunks. A row is a position; rows are in order of their distance to the chunk's end, so that
    the sums over all completions go through them once. A row's edges are in order of length, longer ones first."""

    def __init__(self, p: Pieces, cps: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        n = ends - starts
        rows = int(n.sum())
        upto = np.cumsum(n)
        place = np.arange(rows)
        chars = cps[np.repeat(starts - upto + n, n) + place]
        dist = (np.repeat(upto, n) - place).astype(np.uint16 if not rows or n.max() < 1 << 16 else np.int32)
        order = np.argsort(dist, kind="stable").astype(np.int32)
        rank = np.empty(rows, np.int32)
        rank[order] = np.arange(rows, dtype=np.int32)
        self.base = rank[upto - n]  # the row of each chunk's first position
        dist = dist[order].astype(np.int32)
        row, piece, size = self._edges(p, chars, order, dist)
        count = np.bincount(row, minlength=rows)
        self.first = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
        edges = len(row)
        at = self.first[:-1].copy()
        self.edge, self.size = np.empty(edges, np.int32), np.empty(edges, np.int8 if p.longest < 128 else np.int32)
        cut = np.flatnonzero(np.concatenate([[True], size[1:] != size[:-1], [True]])) if edges else np.zeros(1, np.int64)
        for a, b in reversed(list(zip(cut[:-1], cut[1:], strict=True))):  # a row has one edge of a length
            r = row[a:b]
            to = at[r]
            at[r] = to + 1
            self.edge[to], self.size[to] = piece[a:b], size[a]
        self.row = np.repeat(np.arange(rows, dtype=np.int32), count)
        behind = np.repeat(order, count) + self.size
        np.minimum(behind, max(rows - 1, 0), out=behind)
        self.to = rank[behind]
        self.to[np.repeat(dist, count) == self.size] = -1  # the chunk's end
        w = p.logp[self.edge]
        odd = np.flatnonzero(self.edge < 0)
        char = chars[order[self.row[odd]]]
        w[odd] = (1 + (char >= 0x80).astype(np.int64) + (char >= 0x800) + (char >= 0x10000)) * p.byte_logp
        beta = np.zeros(rows + 1)  # the last is the end
        cuts = np.searchsorted(dist, np.arange(1, int(dist[-1]) + 2 if rows else 2))
        for r0, r1 in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            e0, e1 = self.first[r0], self.first[r1]
            w[e0:e1] += beta[self.to[e0:e1]]
            beta[r0:r1] = np.logaddexp.reduceat(w[e0:e1], self.first[r0:r1] - e0)
        self.logp = np.subtract(w, np.repeat(beta[:-1], count), out=w)
        cs = np.cumsum(np.exp(w))
        # probability of an edge and those before it in its row
        self.upto = cs - np.repeat(np.concatenate([[0.0], cs])[self.first[:-1]], count)
        self.upto[self.first[1:] - 1] = 2.0  # the last edge takes what rounding leaves

    @staticmethod
    def _edges(p: Pieces, chars: np.ndarray, order: np.ndarray, dist: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows, piece ids or -1, lengths) of all edges, by length; every row has an edge of one character."""
        cls = p.cls[chars]
        row = np.arange(len(order), dtype=np.int32)
        rows, ids, sizes = [row], [p.single[chars[order]]], [np.ones(len(row), np.int32)]
        node, k = p.begin[cls[order]], 2
        while True:
            on = np.flatnonzero((node >= 0) & (dist[row] >= k))
            on = on[p.inner[node[on]]]
            if not len(on):
                return np.concatenate(rows), np.concatenate(ids), np.concatenate(sizes)
            row = row[on]
            node = p.step(node[on], cls[order[row] + (k - 1)])
            hit = np.flatnonzero(node >= 0)
            row, node = row[hit], node[hit]
            piece = p.ending[node]
            some = np.flatnonzero(piece >= 0)
            rows.append(row[some])
            ids.append(piece[some])
            sizes.append(np.full(len(some), k, np.int32))
            k += 1

    def log_else(self, edges: np.ndarray) -> np.ndarray:
        """The log-probability of all other edges of each edge's row."""
        row = self.row[edges]
        with np.errstate(divide="ignore"):
            out = np.log(-np.expm1(np.minimum(self.logp[edges], 0)))
        return np.where(self.first[row + 1] - self.first[row] > 1, out, -np.inf)

    def draw(self, row: np.ndarray, u: np.ndarray) -> np.ndarray:
        """For each row an edge, by inverse distribution."""
        at = self.first[row]
        open_ = np.flatnonzero(u >= self.upto[at])
        while len(open_):
            at[open_] += 1
            open_ = open_[u[open_] >= self.upto[at[open_]]]
        return at

    def walk(self, key: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(edges of all steps of walkers that stand at ``row``, -1 at the end, walker by walker; where each walker's begin)."""
        who, edges = [], []
        live = np.flatnonzero(row >= 0).astype(np.int32)
        key, at, step = key[live], row[live], 0
        while len(live):
            e = self.draw(at, uniform(key + np.uint64(step * 0xD1342543DE82EF95 & M64)))
            who.append(live)
            edges.append(e)
            at = self.to[e]
            go = np.flatnonzero(at >= 0)
            live, key, at, step = live[go], key[go], at[go], step + 1
        steps = np.zeros(len(row), np.int32)
        for w in who:
            steps[w] += 1
        begin = np.concatenate([[0], np.cumsum(steps)]).astype(np.int32)
        out = np.empty(int(begin[-1]), np.int32)
        for i, (w, e) in enumerate(zip(who, edges, strict=True)):  # the i-th step of each
            out[begin[w] + i] = e
        return out, begin


#: Steps whose siblings are drawn together at first; later ones only where they can still matter.
_FIRST = 64


class Sampled:
    """k distinct segmentations of each text of a batch."""

    def __init__(self, p: Pieces, raw: np.ndarray, off: np.ndarray, keys: np.ndarray, k: int) -> None:
        self.p, n = p, len(off) - 1
        cps = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
        lead = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        at = lead[off]
        full = np.diff(at) > 0
        # a space before every text that is not empty
        cps = np.insert(np.where(cps == 32, 0x2581, cps), at[:-1][full], 0x2581)
        self.at = at + np.concatenate([[0], np.cumsum(full)])
        self.told = np.insert(raw, off[:-1][full], 32)  # what decoding must give
        self.told_off = off + np.concatenate([[0], np.cumsum(full)])
        space = cps == 0x2581
        cut = space | ~p.joins[cps]
        cut[1:] &= ~(space[1:] & space[:-1])
        cut[1:] |= ~p.joins[cps[:-1]]
        cut[self.at[self.at < len(cps)]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(cps))
        chunk_of = np.searchsorted(self.at, starts, "right") - 1  # the text of each chunk
        self.chunk_off = np.searchsorted(starts, self.at)
        first, inv = Spans(cps.view(np.uint8)).distinct(4 * starts, 4 * ends)
        self.chunks = Chunks(p, cps, starts[first], ends[first])
        self.row, self.cps = self.chunks.base[inv], cps
        self.keys = mix(keys + np.uint64(SEED))
        place = np.arange(len(starts)) - self.chunk_off[chunk_of]  # a chunk's number in its text
        self.chunk_key = mix(self.keys[chunk_of] ^ (place.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)))
        self.rounds: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self.threshold = np.full(n, -np.inf)
        self._search(n, k)

    def _search(self, n: int, k: int) -> None:
        """Rounds: (texts, their edges, where each text's edges begin, log-probabilities, perturbed values)."""
        c = self.chunks
        # of each text: (-perturbed value, number, path, step, edges taken there); a path: (edges, chunks' first steps)
        queues: list[list] = [[] for _ in range(n)]
        for s in range(k):
            key = mix(self.chunk_key + np.uint64((s + 1) * 0xE7037ED1A0B428DB & M64))
            edges, begin = c.walk(key, self.row)
            off = begin[self.chunk_off]
            if s == 0:
                texts, start = np.arange(n), np.zeros(n, np.int64)
                g = -np.log(-np.log(self._noise(texts, s, 0)[:, 0]))
                heads = [begin[a : b + 1] - begin[a] for a, b in zip(self.chunk_off[:-1], self.chunk_off[1:], strict=True)]
            else:
                texts, g, start, edges, off, heads = self._branch(queues, s, edges, begin)
            if not len(texts):
                break
            logp = np.add.reduceat(np.append(c.logp[edges], 0.0), off[:-1]) * (np.diff(off) > 0)
            self.rounds.append((texts, edges, off, logp, g))
            self._leave(queues, s, k, texts, g, start, edges, off, heads)
        done = np.zeros(n, np.int64)
        for r in self.rounds:
            done[r[0]] += 1
        for i in np.flatnonzero(done == k):
            if queues[i]:
                self.threshold[i] = -queues[i][0][0]

    def _noise(self, texts: np.ndarray, s: int, use: int, a: int | np.ndarray = 0, width: int = 1) -> np.ndarray:
        """Draws by text and step, from step a on."""
        base = self.keys[texts] + np.uint64(((s + 1) * 0x8EBC6AF09C88C6E3 + use) & M64)
        step = np.asarray(a, np.uint64)[..., None] + np.arange(width, dtype=np.uint64)
        return uniform(base[:, None] + step * np.uint64(_GOLD))

    @staticmethod
    def _below(mass: np.ndarray, g: np.ndarray | float, u: np.ndarray) -> np.ndarray:
        """Gumbels about ``mass``, cut off at g: -log(exp(-g) - log(u) exp(-mass)) without overflow."""
        with np.errstate(invalid="ignore"):
            out = -np.logaddexp(-g, np.log(-np.log(u)) - mass)
        return np.where(mass > -np.inf, out, -np.inf)

    def _branch(self, queues: list[list], s: int, fresh: np.ndarray, begin: np.ndarray):
        """Takes the best subtree of every queue and completes it: the rest of the chunk behind the new edge, then the
        stream's own later chunks."""
        c = self.chunks
        texts = np.array([i for i, q in enumerate(queues) if q], np.int64)
        pick, split = self._noise(texts, s, 0)[:, 0], self._noise(texts, s, 2)
        taken = []
        for t, i in enumerate(texts):
            neg, _, (old, heads), step, used = heapq.heappop(queues[i])
            row = int(c.row[old[step]])
            others = [e for e in range(int(c.first[row]), int(c.first[row + 1])) if e not in used]
            p = [math.exp(x) for x in c.logp[others].tolist()]
            want, j = pick[t] * math.fsum(p), 0
            while j < len(p) - 1 and want >= p[j]:
                want -= p[j]
                j += 1
            e = others[j]
            if len(others) > 1:  # the siblings that are left at this step
                rest = math.fsum(p[:j] + p[j + 1 :])
                if rest > 0:
                    mass = np.array([c.logp[old[:step]].sum() + math.log(rest)])
                    v = float(self._below(mass, -neg, split[t])[0])
                    heapq.heappush(queues[i], (-v, s << 32 | 1, (old, heads), step, (*used, e)))
            # the chunk of the step, by number in the text
            taken.append((-neg, old, heads, step, e, int(np.searchsorted(heads, step, "right")) - 1))
        chunk = self.chunk_off[texts] + np.array([t[5] for t in taken], np.int64)
        key = mix(self.chunk_key[chunk] + np.uint64((s + 1) * 0x589965CC75374CC3 & M64))
        mine, at = c.walk(key, c.to[np.array([t[4] for t in taken], np.int64)])
        paths, all_heads = [], []
        for t, (_, old, heads, step, e, j) in enumerate(taken):
            a, b = chunk[t] + 1, self.chunk_off[texts[t] + 1]
            paths += [old[:step], np.array([e], np.int32), mine[at[t] : at[t + 1]], fresh[begin[a] : begin[b]]]
            all_heads.append(np.concatenate([heads[: j + 1], begin[a : b + 1] - begin[a] + step + 1 + at[t + 1] - at[t]]))
        off = np.concatenate([[0], np.cumsum([h[-1] for h in all_heads])]).astype(np.int64)
        edges = np.concatenate(paths) if paths else np.zeros(0, np.int32)
        return texts, np.array([t[0] for t in taken]), np.array([t[3] + 1 for t in taken], np.int64), edges, off, all_heads

    def _leave(self, queues: list[list], s: int, k: int, texts: np.ndarray, g: np.ndarray, start: np.ndarray, edges: np.ndarray, off: np.ndarray, heads: list) -> None:
        """Queues what leaves each path at its steps from ``start`` on. A draw lies at most _REACH above its mass, and masses
        fall along the path: steps that can no longer be among the best k are not drawn."""
        c = self.chunks
        n = np.diff(off)
        # all probability before the start, by text
        flat = c.logp[edges]
        sums = np.concatenate([[0.0], np.cumsum(flat)])
        before = sums[off[:-1] + np.minimum(start, n)] - sums[off[:-1]]
        live, a, width = np.arange(len(texts)), start.copy(), _FIRST
        while len(live):
            live = live[a[live] < n[live]]
            if not len(live):
                break
            at = a[live][:, None] + np.arange(width)
            fine = at < n[live][:, None]
            e = edges[np.minimum(off[live][:, None] + at, len(edges) - 1)]
            logs = np.where(fine, c.logp[e], 0.0)
            run = before[live][:, None] + np.cumsum(logs, axis=1)
            mass = np.where(fine, run - logs + c.log_else(e), -np.inf)
            values = self._below(mass, g[live][:, None], self._noise(texts[live], s, 1, a[live], width))
            top = np.argpartition(-values, min(k, width - 1), axis=1)[:, :k] if k < width else np.broadcast_to(np.arange(width), values.shape)
            best = np.take_along_axis(values, top, axis=1)
            on = []
            for r, t in enumerate(live.tolist()):
                queue, o = queues[texts[t]], off[t]
                path = None
                for v, x in zip(best[r].tolist(), top[r].tolist(), strict=True):
                    if v == -math.inf:
                        continue
                    path = path or (edges[o : off[t + 1]], heads[t])
                    step = int(a[t]) + x
                    heapq.heappush(queue, (-v, (s << 32) + 2 + step, path, step, (int(edges[o + step]),)))
                left = k - s
                on.append(len(queue) < left or run[r, -1] + _REACH >= -(queue[0] if left == 1 else heapq.nsmallest(left, queue)[-1])[0])
            before[live] = run[:, -1]
            a[live] += width
            live = live[np.array(on, dtype=bool)]

    def ids(self, edges: np.ndarray, off: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(piece ids, where each text's begin) of a round; a character without a piece gives its bytes."""
        out = self.chunks.edge[edges]
        odd = np.flatnonzero(out < 0)
        if not len(odd):
            return out, off
        size = self.chunks.size[edges].astype(np.int64)
        pos = np.cumsum(size) - size
        of = np.searchsorted(off, odd, "right") - 1
        raw = [chr(ch).encode() for ch in self.cps[self.at[texts[of]] + pos[odd] - pos[off[of]]]]
        count = np.ones(len(out), np.int64)
        count[odd] = [len(r) for r in raw]
        to = np.concatenate([[0], np.cumsum(count)])
        full = np.repeat(out, count)
        full[full < 0] = [self.p.byte[b] for r in raw for b in r]
        return full, to[off]

    def decoded(self, ids: np.ndarray, off: np.ndarray, texts: np.ndarray) -> np.ndarray:
        """Whether each text's pieces decode to it."""
        p = self.p
        size = p.raw_size[ids]
        upto = np.concatenate([[0], np.cumsum(size)])
        got = p.raw_all[np.repeat(p.raw_first[ids] - upto[:-1], size) + np.arange(int(upto[-1]))]
        begin, end = upto[off[:-1]], upto[off[1:]]
        a, b = self.told_off[texts], self.told_off[texts + 1]
        out = end - begin == b - a
        if out.all() and len(texts) == len(self.told_off) - 1:
            if np.array_equal(got, self.told):
                return out
        for t in np.flatnonzero(out):
            out[t] = np.array_equal(got[begin[t] : end[t]], self.told[a[t] : b[t]])
        return out

    def inclusion(self, texts: np.ndarray, logp: np.ndarray) -> np.ndarray:
        t = self.threshold[texts]
        with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
            x = logp - t
            out = np.where(x < -30, x, np.log(-np.expm1(-np.exp(np.minimum(x, 700)))))
        return np.where(t == -np.inf, 0.0, out)


def sample(docs: DataFrame, path: str, k: int, key: str, keep: list[str], full: bool = True, chunk: int = CHUNK) -> DataFrame:
    """keep, sample (from 1), n_pieces, log_prob, perturbed, log_inclusion, ids_crc32, round_trip, and with ``full`` the ids, of docs (key, text)."""
    lean = chunk < CHUNK  # for stages among others: smaller batches, and memory given back after each
    bounded(docs.sparkSession, 4 * chunk if lean else 8 << 20)
    names = list(keep)
    kinds = [pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.bool_(), pa.list_(pa.int32())][: 8 if full else 7]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = model(path)
        for batch in batches:
            raw, off = utf8(batch.column("_text"))
            keys = batch.column("_key").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for a, b in pieces(off, chunk):
                got = Sampled(p, raw[off[a] : off[b]], off[a : b + 1] - off[a], keys[a:b], k)
                rows, cols = [], [[] for _ in range(8)]
                for s, (texts, edges, begin, logp, g) in enumerate(got.rounds):
                    ids, begin = got.ids(edges, begin, texts)
                    whole = memoryview(ids.astype("<u4")).cast("B")
                    crc = [zlib.crc32(whole[4 * x : 4 * y]) for x, y in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]
                    lists = pa.LargeListArray.from_arrays(pa.array(begin, pa.int64()), pa.array(ids, pa.int32())) if full else None
                    values = (np.full(len(texts), s + 1), np.diff(begin), logp, g, got.inclusion(texts, logp), crc, got.decoded(ids, begin, texts), lists)
                    rows.append(a + texts)
                    for c, v, t in zip(cols, values[: len(kinds)], kinds, strict=False):
                        c.append(v.cast(t) if v is lists else pa.array(v, t))
                kept = [batch.column(c).take(pa.array(np.concatenate(rows), pa.int64())) for c in names]
                yield pa.record_batch([*kept, *(pa.concat_arrays(c) for c in cols[: len(kinds)])], names=[*names, *_OUT[: len(kinds)]])
                del got
            if lean:
                trim()
        trim()

    more = "sample int, n_pieces bigint, log_prob double, perturbed double, log_inclusion double, ids_crc32 bigint, round_trip boolean" + ", ids array<int>" * full
    schema = T.StructType([*docs.select(*keep).schema.fields, *T.StructType.fromDDL(more).fields])
    return docs.select(*keep, F.coalesce(F.col(key).cast("long"), F.lit(0)).alias("_key"), F.col("text").alias("_text")).mapInArrow(run, schema)


_OUT = ["sample", "n_pieces", "log_prob", "perturbed", "log_inclusion", "ids_crc32", "round_trip", "ids"]


def op5_gumbel_segmentation(spark: SparkSession, sf_dir: str, k: int = SAMPLES) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sample(docs, public_tokenizers.path("piece_bpe_32k.model"), k, "doc_id", ["doc_id"])
