"""SentencePiece encoding and decoding: distinct sampled segmentations by Gumbel top-k.

The lattice of a text has an arc for every vocabulary piece that spells a
stretch of it; characters that no piece spells are one arc of their byte pieces.
A piece of merge rank ``r`` weighs ``1 / (r + 2.7)`` (the model holds ranks, not
probabilities). Pieces never cross from text into a following space, so the
lattice is a chain of chunks and a backward pass per distinct chunk gives the
exact mass behind every node.

Perturbed A*: every set of segmentations that share a prefix has a Gumbel value
located at its log mass, the maximum over its members. Expanding a set keeps its
value for one sampled path and truncates the others below it, so popping the
largest value again and again emits the top-k without replacement. All other
arcs at a node are one set until it is popped. The value after the last emitted
one is the threshold of the inclusion scores, ``1 - exp(-exp(log_prob - threshold))``.
Random numbers depend on the seed, the row key, the sample and the position
only. All texts of a batch advance together in numpy.

Edge cases: null and empty texts give one sample without pieces; a text with
fewer than ``k`` segmentations gives all of them, with inclusion 1; equal rows
give equal samples; null keys are keyed by their text; U+2581 decodes as a
space, as in SentencePiece; an empty table gives an empty result; columns of the
input other than the two that are used are dropped, whatever their names. Texts
are handled together up to half a megabyte; a longer one alone, as a whole, in
some 300 times its bytes of one worker's memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.words import cells, mix, slices, span_hashes, text_bytes

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
_SHIFT, _UNSEEN = 2.7, 1e9
_U = np.uint64


class Vocabulary:
    """Pieces by byte length: sorted hashes of their bytes, ids and log weights."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        by_length: dict[int, list[tuple[bytes, int, float]]] = {}
        self.bytes_of = np.zeros(256, dtype=np.int32)
        self.spelled = [b""] * n
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes_of[int(piece[3:-1], 16)] = i
                self.spelled[i] = bytes([int(piece[3:-1], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                raw = piece.replace("▁", " ").encode()
                self.spelled[i] = raw
                rank = min(-sp.get_score(i), _UNSEEN)
                by_length.setdefault(len(raw), []).append((raw, i, -np.log(max(rank, 0) + _SHIFT)))
        self.byte_weight = -np.log(n + _SHIFT)
        self.tables = {}
        longest = max(by_length, default=0)
        every = [p for pieces in by_length.values() for p in pieces]
        for length in range(1, longest + 1):  # of each prefix of a piece: its hash, and the piece that it is (-1: none)
            own = {p[0]: p for p in by_length.get(length, [])}
            heads = sorted({p[0][:length] for p in every if len(p[0]) >= length})
            data = np.frombuffer(b"".join(heads), dtype=np.uint8).reshape(len(heads), length)
            key = mix(sum(cells(i, data[:, i]) for i in range(length)))
            order = np.argsort(key)
            if len(np.unique(key)) != len(key):
                raise ValueError("two prefixes of pieces have one hash")
            ids = np.array([own[h][1] if h in own else -1 for h in heads], np.int32)
            weights = np.array([own[h][2] if h in own else 0.0 for h in heads])
            self.tables[length] = (key[order], ids[order], weights[order])
        self.length = np.array([len(p) for p in self.spelled], dtype=np.int64)
        self.blob = np.frombuffer(b"".join(self.spelled), dtype=np.uint8)
        self.begin = np.cumsum(self.length) - self.length

    def decode_bytes(self, ids: np.ndarray) -> np.ndarray:
        n = self.length[ids]
        return self.blob[np.repeat(self.begin[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())]


def decode_ids(vocabulary: Vocabulary, ids: list[int]) -> str:
    """The text of a list of piece ids (the leading space that encoding adds is taken off)."""
    raw = vocabulary.decode_bytes(np.asarray(ids, dtype=np.int64)).tobytes()
    return raw[1:].decode(errors="replace") if raw[:1] == b" " else raw.decode(errors="replace")


class Lattice:
    """Arcs of distinct chunks, laid end to end.

    Nodes are numbered by their distance from the end of their chunk, so that
    the backward pass works on contiguous stretches; number 0 is the end of any
    chunk. ``pos`` is a node's byte position, ``head`` and ``to`` are the nodes
    of an arc, ``size`` its bytes. Arcs of a node come longest first, which
    mostly is likeliest first.
    """

    #: Up to this distance the pass multiplies plain weights; further on it adds logarithms.
    PLAIN = 56

    def __init__(self, vocabulary: Vocabulary, data: np.ndarray, start: np.ndarray):
        n = len(data)
        end = np.append(start[1:], n)
        until = np.repeat(end, end - start)  # where the chunk of each position ends
        boundary = np.append((data & 0xC0) != 0x80, True)
        nodes = np.flatnonzero(boundary[:-1])
        left = until[nodes] - nodes
        order = np.argsort(left.astype(np.uint16) if left.max() < 1 << 16 else left, kind="stable")
        rank = np.zeros(n + 1, dtype=np.int32)
        rank[nodes[order]] = np.arange(1, len(nodes) + 1, dtype=np.int32)
        self.rank, left = rank, left[order]
        self.pos = np.concatenate([[0], nodes[order]])
        wide = np.minimum(np.diff(np.append(nodes, n)), until[nodes] - nodes)
        width = np.zeros(n, dtype=np.int64)
        width[nodes] = wide
        single = np.zeros(n, dtype=bool)  # characters that are a piece
        at, size, ids, weight = [], [], [], []
        live, h = nodes, np.zeros(len(nodes), dtype=np.uint64)
        for length, (keys, piece, log_weight) in sorted(vocabulary.tables.items()):
            inside = live + length <= until[live]
            live, h = live[inside], h[inside]
            if not len(live):
                break
            h = h + cells(length - 1, data[live + (length - 1)])
            key = mix(h)
            found = np.searchsorted(keys, key)
            found[found == len(keys)] = 0
            hit = keys[found] == key  # positions at which some piece may go on
            live, h, found = live[hit], h[hit], found[hit]
            whole = piece[found] >= 0
            here, found = live[whole], found[whole]
            single[here[width[here] == length]] = True
            at.append(here), size.append(length), ids.append(piece[found]), weight.append(log_weight[found])
        lone = nodes[~single[nodes]]
        at.append(lone), size.append(width[lone]), ids.append(np.full(len(lone), -1, np.int32)), weight.append(vocabulary.byte_weight * width[lone])
        # place arcs by node, longest first: one pass per length, in which no node occurs twice
        heads = [rank[x] for x in at]
        count = np.zeros(len(nodes) + 1, dtype=np.int64)
        for x in heads:
            count[x] += 1
        self.first = np.concatenate([[0], np.cumsum(count)])
        total, cursor = int(self.first[-1]), self.first[:-1].copy()
        self.to, self.head, self.ids = (np.empty(total, dtype=np.int32) for _ in range(3))
        self.size, weight_of = np.empty(total, dtype=np.int32), np.empty(total)
        for x, here, width_of, piece, w in reversed(list(zip(heads, at, size, ids, weight))):
            slot = cursor[x]
            cursor[x] += 1
            to = here + width_of
            self.to[slot] = np.where(to == until[here], 0, rank[to])
            self.head[slot], self.size[slot], self.ids[slot], weight_of[slot] = x, width_of, piece, w
        weight = weight_of
        self._backward(weight, left)

    def _backward(self, weight: np.ndarray, left: np.ndarray) -> None:
        n = len(left)
        cuts = np.append(np.flatnonzero(np.diff(left, prepend=-1)), n) + 1
        plain = int(np.searchsorted(left, self.PLAIN, side="right")) + 1
        mass, value, w = np.ones(n + 1), np.zeros(len(weight)), np.exp(weight)
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a >= plain:
                break
            i, j = self.first[a], self.first[b]
            v = w[i:j] * mass[self.to[i:j]]
            mass[a:b] = np.add.reduceat(v, self.first[a:b] - i)
            value[i:j] = v
        at = self.first[plain]
        with np.errstate(divide="ignore"):
            log_mass, log_value = np.log(mass), np.log(value)
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a < plain:
                continue
            i, j = self.first[a], self.first[b]
            v = weight[i:j] + log_mass[self.to[i:j]]
            opening = self.first[a:b] - i
            top = np.maximum.reduceat(v, opening)
            log_mass[a:b] = top + np.log(np.add.reduceat(np.exp(v - np.repeat(top, np.diff(self.first[a : b + 1]))), opening))
            log_value[i:j] = v
        self.log_p = log_value - log_mass[self.head]
        self.p = np.exp(self.log_p)
        self.p[:at] = value[:at] / mass[self.head[:at]]
        # shares summed node by node, so that a draw does not depend on what else is in the batch
        self.within = self.p.copy()
        size = np.diff(self.first)
        at, step = np.flatnonzero(size > 1), 1
        while len(at):
            arc = self.first[at] + step
            self.within[arc] += self.within[arc - 1]
            step += 1
            at = at[size[at] > step]
        self.within[self.first[2:] - 1] = 2.0  # the last arc takes what is left

    def draw(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An arc out of each node, by its share of the mass behind the node."""
        arc = self.first[node]
        far = np.flatnonzero(u >= self.within[arc])
        while len(far):
            arc[far] += 1
            far = far[u[far] >= self.within[arc[far]]]
        return arc


def uniform(seed: np.ndarray, sample: int, position: np.ndarray, use: int) -> np.ndarray:
    """A number in (0, 1) for each (row, sample, position, use)."""
    x = mix(seed ^ mix(position.astype(np.uint64) * _U(0x9E3779B97F4A7C15) + _U((sample * 4 + use + 1) & 0xFFFFFFFF)))
    return ((x >> _U(11)).astype(np.float64) + 0.5) / float(1 << 53)


def truncated(location: np.ndarray, limit: np.ndarray, u: np.ndarray) -> np.ndarray:
    """A Gumbel value at ``location`` given that it is at most ``limit``."""
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        return np.where(np.isneginf(location), -np.inf, location - np.log(np.exp(np.minimum(location - limit, 700.0)) - np.log(u)))


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


class Batch:
    """The chunks of some texts and their shared lattice."""

    def __init__(self, vocabulary: Vocabulary, texts: pa.Array, seeds: np.ndarray):
        data, offsets = text_bytes(texts)
        size = np.diff(offsets)
        lead = (size > 0).astype(np.int64)  # each text gets a leading space
        self.offsets = np.concatenate([[0], np.cumsum(size + lead)])
        buffer = np.full(self.offsets[-1], 32, dtype=np.uint8)
        buffer[_ranges(self.offsets[:-1] + lead, size)] = data
        self.buffer, self.vocabulary, self.seeds, self.n = buffer, vocabulary, seeds, len(size)
        space = buffer == 32
        begins = np.zeros(len(buffer), dtype=bool)
        begins[1:] = space[1:] & ~space[:-1]
        begins[self.offsets[:-1][lead > 0]] = True
        self.start = np.flatnonzero(begins)
        self.end = np.append(self.start[1:], len(buffer))
        self.doc = np.searchsorted(self.offsets, self.start, side="right") - 1
        self.doc_first = np.searchsorted(self.start, self.offsets)
        _, index, self.kind = np.unique(span_hashes(buffer, self.start, self.end), return_index=True, return_inverse=True)
        long = self.end[index] - self.start[index]
        self.origin = np.cumsum(long) - long  # of each distinct chunk in the lattice
        self.lattice = Lattice(vocabulary, buffer[_ranges(self.start[index], long)], self.origin) if len(index) else None

    def spells(self, docs: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Whether each run of ids decodes to the bytes of its text."""
        n = self.vocabulary.length[ids]
        bytes_of = np.diff(np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(sizes)])])
        same = bytes_of == np.diff(self.offsets)[docs]
        if same.all():
            wrong = self.vocabulary.decode_bytes(ids) != self.buffer[_ranges(self.offsets[docs], bytes_of)]
            same = np.diff(np.concatenate([[0], np.cumsum(wrong)])[np.concatenate([[0], np.cumsum(bytes_of)])]) == 0
        return same

    def paths(self, chunk: np.ndarray, node: np.ndarray, sample: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Arcs from ``node`` to the end of each chunk: (arc, its chunk, arcs per chunk), in order."""
        lattice, live, steps = self.lattice, np.arange(len(chunk)), []
        at = node.copy()
        shift = self.start[chunk] - self.origin[self.kind[chunk]] - self.offsets[self.doc[chunk]]
        count = np.zeros(len(chunk), dtype=np.int64)
        seeds = self.seeds[self.doc[chunk]]
        live = live[at > 0]
        while len(live):
            arc = lattice.draw(at[live], uniform(seeds[live], sample, lattice.pos[at[live]] + shift[live], 0))
            steps.append((live, arc))
            count[live] += 1
            at[live] = lattice.to[arc]
            live = live[at[live] > 0]
        out = np.empty(count.sum(), dtype=np.int64)
        first = np.cumsum(count) - count
        for t, (who, arc) in enumerate(steps):
            out[first[who] + t] = arc
        return out, np.repeat(chunk, count), count

    def sample(self, k: int) -> list[list[tuple]]:
        """For each text its samples: (ids, log_prob, inclusion), largest perturbed value first."""
        out: list[list[tuple]] = [[] for _ in range(self.n)]
        docs = np.flatnonzero(np.diff(self.doc_first) > 0)
        for d in np.flatnonzero(np.diff(self.doc_first) == 0):
            out[d].append((np.zeros(0, np.int64), 0.0, 1.0))
        if not len(docs):
            return out
        zero = np.zeros(len(docs), dtype=np.int64)
        value = -np.log(-np.log(uniform(self.seeds[docs], 0, zero, 1)))
        chunks = np.arange(len(self.start))
        arcs, of, _ = self.paths(chunks, self.lattice.rank[self.origin][self.kind], 0)
        bounds = np.searchsorted(self.doc[of], np.append(docs, self.n))
        state = {"docs": docs, "value": value, "arcs": arcs, "of": of, "bounds": bounds, "fresh": bounds[:-1].copy()}
        frontier: list[list[tuple]] = [[] for _ in range(self.n)]  # (value, paths, row, step, arcs ruled out)
        for r in range(k + 1):
            if r < k:
                self._emit(state, out)
                self._open(state, r, k - r, frontier)
            pick = [(d, max(range(len(frontier[d])), key=lambda i: frontier[d][i][0])) for d in state["docs"] if frontier[d]]
            if r >= k - 1:  # what would come next is the threshold
                top = {d: frontier[d][i][0] for d, i in pick}
                for d in range(self.n):
                    if len(out[d]) == k and d in top:
                        out[d] = [(ids, lp, float(-np.expm1(-np.exp(min(lp - top[d], 50.0))))) for ids, lp, _ in out[d]]
                break
            if not pick:
                break
            state = self._deviate(state, r + 1, [(d, frontier[d].pop(i)) for d, i in pick], frontier, k - r - 1)
        return out

    def _emit(self, state: dict, out: list[list[tuple]]) -> None:
        lattice, b = self.lattice, state["bounds"]
        total = np.add.reduceat(lattice.log_p[state["arcs"]], b[:-1])
        ids, n = self._ids(state["arcs"], state["of"])
        place = np.concatenate([[0], np.cumsum(n)])
        for row, d in enumerate(state["docs"].tolist()):
            out[d].append((ids[place[b[row]] : place[b[row + 1]]], float(total[row]), 1.0))

    def _ids(self, arcs: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of arcs, and how many each arc has; an arc of bytes has one for each."""
        lattice = self.lattice
        n = np.where(lattice.ids[arcs] < 0, lattice.size[arcs], 1)
        ids = np.repeat(lattice.ids[arcs], n).astype(np.int32)
        raw = np.flatnonzero(lattice.ids[arcs] < 0)
        if len(raw):
            at = self.start[of[raw]] + lattice.pos[lattice.head[arcs[raw]]] - self.origin[self.kind[of[raw]]]
            where = _ranges((np.cumsum(n) - n)[raw], n[raw])
            ids[where] = self.vocabulary.bytes_of[self.buffer[_ranges(at, n[raw])]]
        return ids, n

    def _open(self, state: dict, r: int, keep: int, frontier: list[list[tuple]]) -> None:
        """Put the best ``keep`` sets of other arcs along the fresh part of each path on the frontier."""
        lattice, b, fresh = self.lattice, state["bounds"], state["fresh"]
        arcs, of = state["arcs"], state["of"]
        log_p = lattice.log_p[arcs]
        size = np.diff(b)
        prefix = state["prefix"] = np.zeros(len(arcs))
        for i, j in zip(b[:-1].tolist(), b[1:].tolist()):  # summed text by text, so that no digit depends on what else is in the batch
            np.cumsum(log_p[i : j - 1], out=prefix[i + 1 : j])
        doc = np.repeat(state["docs"], size)
        old = np.arange(len(arcs)) < np.repeat(fresh, size)
        head = np.repeat(prefix[np.minimum(fresh, b[1:] - 1)], size)
        x = np.full(len(arcs), -np.inf)

        def value(at: np.ndarray) -> None:
            node = lattice.head[arcs[at]]
            other = -np.expm1(np.minimum(log_p[at], 0.0))
            other[lattice.first[node + 1] - lattice.first[node] == 1] = 0.0
            with np.errstate(divide="ignore"):
                location = prefix[at] + np.log(other)
            position = self.start[of[at]] + lattice.pos[node] - self.origin[self.kind[of[at]]] - self.offsets[doc[at]]
            limit = np.repeat(state["value"], size)[at]
            x[at] = truncated(location, limit, uniform(self.seeds[doc[at]], r, position, 2))

        near = ~old & (prefix >= head - 60.0)
        value(np.flatnonzero(near))
        # a value is at most 38 above its location, which is under its prefix, and prefixes fall along a path: look further only where that could matter
        rest = x.copy()
        for _ in range(keep - 1):
            rest[rest == np.repeat(np.maximum.reduceat(rest, b[:-1]), size)] = -np.inf
        worst = np.maximum.reduceat(rest, b[:-1])
        value(np.flatnonzero(~old & ~near & (prefix + 38.0 >= np.repeat(worst, size))))
        for _ in range(keep):
            top = np.maximum.reduceat(x, b[:-1])
            hit = np.flatnonzero((x == np.repeat(top, size)) & (x > -np.inf))
            if not len(hit):
                break
            row = np.searchsorted(b, hit, side="right") - 1
            hit, row = hit[np.unique(row, return_index=True)[1]], np.unique(row)
            for i, j in zip(hit.tolist(), row.tolist()):
                frontier[state["docs"][j]].append((float(x[i]), state, j, i, (int(arcs[i]),)))
            x[hit] = -np.inf

    def _deviate(self, last: dict, r: int, picks: list, frontier: list[list[tuple]], keep: int) -> dict:
        """The next sample of each text: the popped set's sampled arc, then a fresh path to the end."""
        lattice, docs, heads, new_arc = self.lattice, np.array([d for d, _ in picks]), [], []
        ofs = np.array([int(p[1]["of"][p[3]]) for _, p in picks])
        nodes = np.array([int(lattice.head[p[1]["arcs"][p[3]]]) for _, p in picks])
        position = self.start[ofs] + lattice.pos[nodes] - self.origin[self.kind[ofs]] - self.offsets[docs]
        which, level = uniform(self.seeds[docs], r, position, 3), uniform(self.seeds[docs], r, position, 2)
        rests = np.zeros(len(picks))
        for i, (d, (x, state, row, step, out)) in enumerate(picks):
            lo, hi = int(lattice.first[nodes[i]]), int(lattice.first[nodes[i] + 1])
            p = lattice.p[lo:hi].copy()
            p[[a - lo for a in out]] = 0.0
            total = p.cumsum()
            arc = lo + min(int(total.searchsorted(which[i] * total[-1], side="right")), int(p.nonzero()[0][-1]))
            heads.append((state, row, step, int(ofs[i]))), new_arc.append(arc)
            p[arc - lo] = 0.0
            rests[i] = p.sum()
        prefixes = np.array([float(p[1]["prefix"][p[3]]) for _, p in picks])
        with np.errstate(divide="ignore"):
            again = truncated(prefixes + np.log(rests), np.array([p[0] for _, p in picks]), level)
        for i, (d, (x, state, row, step, out)) in enumerate(picks):
            if rests[i] > 0:
                frontier[d].append((float(again[i]), state, row, step, (*out, new_arc[i])))
        new_arc = np.array(new_arc)
        first_chunk = np.array([h[3] for h in heads])
        size = self.doc_first[docs + 1] - first_chunk
        chunk = _ranges(first_chunk, size)
        node = lattice.rank[self.origin][self.kind[chunk]]
        opening = np.cumsum(size) - size
        node[opening] = lattice.to[new_arc]
        arcs, of, count = self.paths(chunk, node, r)
        per_doc = np.add.reduceat(count, opening)
        parts_a, parts_o, bounds, fresh, at = [], [], [0], [], 0
        ends = np.cumsum(per_doc)
        for i, (state, row, step, c) in enumerate(heads):
            a = state["bounds"][row]
            parts_a += [state["arcs"][a:step], new_arc[i : i + 1], arcs[ends[i] - per_doc[i] : ends[i]]]
            parts_o += [state["of"][a:step], np.array([c]), of[ends[i] - per_doc[i] : ends[i]]]
            fresh.append(at + step - a + 1)
            at += step - a + 1 + int(per_doc[i])
            bounds.append(at)
        return {"docs": docs, "value": np.array([p[1][0] for p in picks]), "arcs": np.concatenate(parts_a), "of": np.concatenate(parts_o), "bounds": np.array(bounds), "fresh": np.array(fresh)}


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, model: str = MODEL) -> DataFrame:
    """(doc_id, ids, n_pieces): the model's own segmentation of every text, with the model's normaliser; a null text has no pieces."""
    proto = open(model, "rb").read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_proto=proto)
        for batch in batches:
            for part in slices(batch, "text", 500_000):
                ids = processor.encode([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_pydict({"doc_id": part.column(0), "ids": pa.array(ids, pa.list_(pa.int32())), "n_pieces": pa.array([len(x) for x in ids], pa.int64())})

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, ids array<int>, n_pieces long")


def decode(rows: DataFrame, ids: str = "ids", text: str = "text", *, model: str = MODEL) -> DataFrame:
    """``rows`` with the text that their piece ids spell: for samples the very text, for the model's own pieces its normalised form."""
    proto = open(model, "rb").read()
    known: dict[str, Vocabulary] = {}

    def spell(column: pa.Array) -> pa.Array:
        if not known:
            known["v"] = Vocabulary(proto)
        return pa.array([None if x is None else decode_ids(known["v"], x) for x in column.to_pylist()], pa.string())

    return rows.withColumn(text, F.arrow_udf(spell, "string")(F.col(ids)))


def row_seed(keys: list, texts: pa.Array, seed: int) -> np.ndarray:
    out = []
    for key, text in zip(keys, texts):
        tag = repr(key) if key is not None else "text:" + (text.as_py() or "")
        out.append(int.from_bytes(hashlib.blake2b(f"{seed}:{tag}".encode(), digest_size=8).digest(), "little"))
    return np.array(out, dtype=np.uint64)


def sample_segmentations(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, k: int = 2, seed: int = 1, model: str = MODEL) -> DataFrame:
    """(doc_id, sample, ids, n_pieces, log_prob, inclusion, round_trip): ``k`` distinct segmentations of every text."""
    proto = open(model, "rb").read()  # half a megabyte, sent with the task: executors need no file

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(proto)
        for batch in batches:
            for part in slices(batch, "text", 500_000):
                texts = part.column(1)
                work = Batch(vocabulary, texts, row_seed(part.column(0).to_pylist(), texts, seed))
                rows = [(d, i, *s) for d, found in enumerate(work.sample(k)) for i, s in enumerate(found)]
                sizes = np.array([len(x[2]) for x in rows], dtype=np.int64)
                trip = work.spells(np.array([x[0] for x in rows]), sizes, flat := np.concatenate([x[2] for x in rows]))
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat.astype(np.int32)))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column(0).take(pa.array([x[0] for x in rows])), "sample": pa.array([x[1] for x in rows], pa.int32()), "ids": ids,
                    "n_pieces": pa.array(sizes), "log_prob": pa.array([x[3] for x in rows], pa.float64()), "inclusion": pa.array([x[4] for x in rows], pa.float64()),
                    "round_trip": pa.array(trip, pa.bool_()),
                })

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(encode, f"doc_id {kind}, sample int, ids array<int>, n_pieces long, log_prob double, inclusion double, round_trip boolean")
