"""N-gram Jaccard join: exact near-duplicate classes with signature trees.

Two texts link when their sets of distinct word shingles have a Jaccard
similarity of ``num / den`` or more. No link between different texts is lost:

1. Texts with equal sets form one class; classes are what is compared.
2. Candidate blocks. A linked set lacks at most ``n - ceil(num * n / den)`` of
   the other's shingles, so under one global order the first that many plus one
   shingles of two linked sets meet. The order is by rarity: shingles of one
   class alone come first and meet nothing, so a text with more of them than it
   may lack is out, whatever passages it shares. Shingles travel in packed
   arrays, cut to coarse tokens (which can only add candidates). Sets of ``WIDE``
   or more publish a fixed part of the token space only, as long as that part
   holds more than they may lack; sizes near a set that fails this (almost none)
   publish everything. Blocks are the components of "meets".
3. Each block, or chunk of a large block with a few hub texts added, gets a
   signature tree: nodes hold OR-combined token bitmaps and size ranges, and a
   dual traversal prunes node pairs whose largest possible overlap is too small
   or that are connected already; leaves are compared exactly on whole sets,
   and what passes is confirmed on the words themselves.
4. Members of a chunked block that ended outside its largest component are dealt
   into chunks of their own. These meet each other and the chunks of the rest in
   tasks of two chunks, of which only those run that have sizes near enough and
   a shingle in common among their prefixes: the tree's pruning one level up.
   No task holds more than two chunks and the hubs.

Edge cases: a text with fewer words than a shingle is one shingle; null and
empty texts have none and link with nothing; null ids take no part; rows of
equal id count as one node; equal texts share a class; an empty table gives an
empty result; other input columns are dropped. Very long texts are compared as
wholes; one takes some thirty times its bytes in one worker. Shingles are known
by 64-bit hashes while they are counted: two different shingles of one text with
one hash (a chance of 1e-12 in a text of 6,000 words) would count as one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm import store
from threadloom.llm.components import components
from threadloom.llm.words import Words, mix, slices, tokenize, window_hashes, window_ok

#: Sets of this size or more publish the tokens under ``SHARE`` only, where these are enough.
WIDE, SHARE = 400, int(0.4 * (1 << 32))
#: Members and shingles of a chunk, hubs of a chunked block, bytes of packed tokens in a partition.
CHUNK, CHUNK_SHINGLES, HUBS, PACKED = 512, 500_000, 4, 24_000_000
#: Digests that a task remembers; members of a leaf.
SEEN, _LEAF = 500_000, 16
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingle_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): the sorted distinct shingle hashes of text ``d`` are ``hashes[bounds[d] : bounds[d + 1]]``."""
    h, of, counts = words.hashes(), words.of(), words.counts
    at = np.flatnonzero(window_ok(words, k))
    key, doc = [window_hashes(h, k)[at]], [of[at]]
    for n in range(1, k):  # short texts: the whole sequence
        d = np.flatnonzero(counts == n)
        if len(d):
            key.append(mix(window_hashes(h, n)[words.first[d]] ^ np.uint64(n)))
            doc.append(d)
    key, doc = np.concatenate(key), np.concatenate(doc)
    order = np.lexsort((key, doc))
    key, doc = key[order], doc[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    return key[new], np.searchsorted(doc[new], np.arange(len(counts) + 1))


def _digest(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def _band(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """Bands of sizes: linked sets are at most one apart."""
    return np.floor(np.log(np.maximum(n, 1)) / np.log(den / num + 1e-9)).astype(np.int64)


def _members(k: int, num: int, den: int):
    """Of each text its set's size, digest and smallest hash, and the band of sizes if its part of the token space may be too small."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                key, b = shingle_sets(tokenize(part.column(1), lower=True), k)
                n = np.diff(b)
                thin = [None] * part.num_rows
                for d in np.flatnonzero(n >= WIDE).tolist():
                    token = (key[b[d] : b[d + 1]] >> np.uint64(16)).astype(np.uint32)
                    if len(np.unique(token[token < SHARE])) <= n[d] - -(-num * n[d] // den):
                        thin[d] = int(_band(n[d], num, den))
                some = n > 0
                digests = [_digest(key[b[d] : b[d + 1]]) if some[d] else None for d in range(part.num_rows)]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column(0), "n": pa.array(n.astype(np.int64)), "digest": pa.array(digests, pa.binary()),
                    "cls": pa.array([None if x is None else _number(x, {}) for x in digests], pa.int64()),
                    "low": pa.array([int(key[b[d]] >> np.uint64(1)) if some[d] else None for d in range(part.num_rows)], pa.int64()), "thin": pa.array(thin, pa.int64()),
                })

    return measure


def _number(digest: bytes, turns: dict[bytes, int]) -> int:
    """The number by which a class travels: the first half of its digest, or another one if that is taken."""
    if digest in turns:
        digest = hashlib.blake2b(digest + turns[digest].to_bytes(4, "little"), digest_size=8).digest()
    return int.from_bytes(digest[:8], "little", signed=True)


_PACK = "bucket int, kind int, token binary, cls binary, x binary, y binary"


def _pack(bucket: np.ndarray, kind: int, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row per bucket, with the raw bytes of each column's entries."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    first = np.flatnonzero(np.diff(bucket, prepend=bucket[0] - 1))
    cuts = np.append(first, len(bucket))
    binary = [pa.array([c[order][a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary()) for c in columns]
    binary += [pa.nulls(len(first), pa.binary())] * (4 - len(columns))
    yield pa.RecordBatch.from_arrays([pa.array(bucket[first].astype(np.int32)), pa.array(np.full(len(first), kind, np.int32)), *binary], ["bucket", "kind", "token", "cls", "x", "y"])


def _send(k: int, buckets: int, num: int, den: int, full: list[int], turns: dict[bytes, int]):
    """Coarse tokens of each class to the token's bucket (kind 0), sizes of each class to the class's bucket (kind 1)."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            tokens, sizes = ([np.concatenate(c) for c in zip(*part)] for part in ([x[:3] for x in held], [x[3:] for x in held]))
            yield from _pack(tokens[0], 0, *tokens[1:])
            yield from _pack(sizes[0], 1, np.zeros(len(sizes[0]), np.uint8), *sizes[1:])
            held.clear()

        for batch in batches:
            for part in slices(batch, "text"):
                key, b = shingle_sets(tokenize(part.column(0), lower=True), k)
                cls, fresh = np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows, dtype=bool)
                for d in range(part.num_rows):
                    if b[d + 1] > b[d]:
                        digest = _digest(key[b[d] : b[d + 1]])
                        cls[d] = _number(digest, turns)
                        if len(seen) >= SEEN:  # forgetting sends a class twice, which changes nothing
                            seen.clear()
                        fresh[d] = digest not in seen
                        seen.add(digest)
                n = np.diff(b)
                doc = np.repeat(np.arange(part.num_rows), n)
                token = (key >> np.uint64(16)).astype(np.uint32)
                bucket = (key % np.uint64(buckets)).astype(np.int32)
                low = token < SHARE
                every_token = (n < WIDE) | np.isin(_band(n, num, den), full)
                use = fresh[doc] & (low | every_token[doc])
                # coarse tokens of a class are counted once each
                code = (bucket[use].astype(np.uint64) << np.uint64(32)) | token[use].astype(np.uint64)
                who = doc[use]
                order = np.lexsort((code, who))
                code, who = code[order], who[order]
                new = np.ones(len(code), dtype=bool)
                new[1:] = (code[1:] != code[:-1]) | (who[1:] != who[:-1])
                code, who = code[new], who[new]
                token, bucket = (code & np.uint64(0xFFFFFFFF)).astype(np.uint32), (code >> np.uint64(32)).astype(np.int32)
                every = np.bincount(who, minlength=part.num_rows)
                inside = np.bincount(who[token < SHARE], minlength=part.num_rows)
                one = np.flatnonzero(fresh)
                sizes = np.stack([n[one], every[one], inside[one]]).astype(np.int64)
                held.append((bucket, token, cls[who], (cls[one] % buckets).astype(np.int32), cls[one], sizes[0], (sizes[1] << 32) | sizes[2]))
                size += len(token)
                if size > 1_000_000:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    return send


def _gather(batches: Iterator[pa.RecordBatch]) -> dict[int, dict[int, list]]:
    """bucket -> kind -> rows of raw bytes."""
    out: dict[int, dict[int, list]] = {}
    for batch in batches:
        for bucket, kind, *raw in zip(*(c.to_pylist() for c in batch.columns)):
            out.setdefault(bucket, {}).setdefault(kind, []).append(raw)
    return out


def _column(rows: list, i: int, kind) -> np.ndarray:
    return np.frombuffer(b"".join(r[i] for r in rows), dtype=kind)


def _count(buckets: int):
    """Of each bucket, the tokens that two classes or more hold, with their frequency, to the classes' buckets; sizes pass through."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, kinds in _gather(batches).items():
            if 1 in kinds:
                rows = kinds[1]
                yield from _pack(np.full(len(_column(rows, 1, np.int64)), bucket), 1, np.zeros(len(_column(rows, 1, np.int64)), np.uint8), *(_column(rows, i, np.int64) for i in (1, 2, 3)))
            if 0 not in kinds:
                continue
            token, cls = _column(kinds[0], 0, np.uint32), _column(kinds[0], 1, np.int64)
            order = np.lexsort((cls, token))
            token, cls = token[order], cls[order]
            new = np.ones(len(token), dtype=bool)
            new[1:] = (token[1:] != token[:-1]) | (cls[1:] != cls[:-1])
            token, cls = token[new], cls[new]
            head = np.flatnonzero(np.diff(token.astype(np.int64), prepend=-1))
            often = np.diff(np.append(head, len(token)))
            df = np.repeat(often, often)
            met = df > 1
            code = (np.int64(bucket) << 32) | token[met].astype(np.int64)
            yield from _pack(cls[met] % buckets, 0, code, cls[met], df[met].astype(np.int64))

    return count


def _prefixes(num: int, den: int, full: list[int]):
    """(token, cls) of the shared tokens in each class's prefix."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kinds in _gather(batches).values():
            if 0 not in kinds or 1 not in kinds:
                continue
            who, index = np.unique(_column(kinds[1], 1, np.int64), return_index=True)
            n, packed = _column(kinds[1], 2, np.int64)[index], _column(kinds[1], 3, np.int64)[index]
            every, inside = packed >> 32, packed & 0xFFFFFFFF
            code, cls, df = (_column(kinds[0], i, np.int64) for i in (0, 1, 2))
            order = np.lexsort((code, df, cls))
            code, cls = code[order], cls[order]
            row = np.searchsorted(who, cls)
            low = (code & 0xFFFFFFFF) < SHARE
            lack = n - -(-num * n // den)
            take = np.zeros(len(code), dtype=bool)
            # sets that published all tokens meet each other on these; those that a set with a part of them may match, on that part too
            for use, total, of in ((np.ones(len(code), dtype=bool), every, (n < WIDE) | np.isin(_band(n, num, den), full)), (low, inside, n * den >= num * WIDE)):
                at = np.flatnonzero(use & of[row])
                shared = np.bincount(row[at], minlength=len(who))
                room = lack + 1 - (total - shared)  # how many of the shared tokens the prefix reaches
                rank = np.arange(len(at)) - (np.cumsum(shared) - shared)[row[at]]
                take[at[rank < room[row[at]]]] = True
            yield pa.RecordBatch.from_pydict({"token": pa.array(code[take]), "cls": pa.array(cls[take])})

    return pick


def shingles_of(text: str, k: int) -> set[bytes]:
    """The shingles themselves, not their hashes."""
    words = _WORD.findall(text.encode().lower())
    return {b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


class Tree:
    """A signature tree over sets: a heap of nodes with OR-combined bitmaps, size ranges and spare counts.

    ``known`` says which members are connected already (equal numbers); ``confirm`` is asked before a link is taken."""

    def __init__(self, sets: list[np.ndarray], known: list | None = None, confirm=None):
        self.sets, self.confirm = sets, confirm
        self.size = np.array([len(s) for s in sets])
        bits = 64
        while bits < 4 * self.size.max() and bits < 1 << 17:
            bits *= 2
        self.map = np.zeros((len(sets), bits // 64), dtype=np.uint64)
        for i, s in enumerate(sets):
            b = s % np.uint64(bits)
            np.bitwise_or.at(self.map[i], (b >> np.uint64(6)).astype(np.int64), np.uint64(1) << (b & np.uint64(63)))
        #: Tokens that share a bit with another token of their set: what a count of bits may miss.
        self.spare = self.size - np.bitwise_count(self.map).sum(axis=1).astype(np.int64)
        self.root = np.arange(len(sets))
        first: dict = {}
        for i, x in enumerate(known or ()):
            self.root[i] = first.setdefault(x, i)

    def node(self, a: int, b: int) -> tuple:
        part = slice(a, b)
        below = () if b - a <= _LEAF else (self.node(a, (a + b) // 2), self.node((a + b) // 2, b))
        return a, b, np.bitwise_or.reduce(self.map[part], axis=0), int(self.size[part].min()), int(self.size[part].max()), int(self.spare[part].max()), below

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = int(self.root[i])
        return i

    def links(self, num: int, den: int) -> Iterator[tuple[int, int]]:
        """Links that join two components, by a dual traversal of the tree with itself."""
        top = self.node(0, len(self.sets))
        stack = [(top, top)]
        while stack:
            x, y = stack.pop()
            if den * x[4] < num * y[3] or den * y[4] < num * x[3]:
                continue
            most = int(np.bitwise_count(x[2] & y[2]).sum()) + min(x[5], y[5])
            if (num + den) * most < num * (x[3] + y[3]):
                continue
            if x is y:
                if x[6]:
                    stack += [(x[6][0], x[6][0]), (x[6][1], x[6][1]), (x[6][0], x[6][1])]
                    continue
            elif x[6] or y[6]:
                if x[6] and (not y[6] or x[1] - x[0] >= y[1] - y[0]):
                    stack += [(x[6][0], y), (x[6][1], y)]
                else:
                    stack += [(x, y[6][0]), (x, y[6][1])]
                continue
            yield from self.leaves(x[0], x[1], y[0], y[1], num, den)

    def leaves(self, a: int, b: int, c: int, d: int, num: int, den: int) -> Iterator[tuple[int, int]]:
        roots = [self.find(i) for i in range(a, b)], [self.find(j) for j in range(c, d)]
        if len({*roots[0], *roots[1]}) == 1:
            return
        both = np.bitwise_count(self.map[a:b, None, :] & self.map[None, c:d, :]).sum(axis=2).astype(np.int64)
        most = both + np.minimum(self.spare[a:b, None], self.spare[None, c:d])
        need = num * (self.size[a:b, None] + self.size[None, c:d])
        for i, j in zip(*np.nonzero((num + den) * most >= need)):
            i, j = a + int(i), c + int(j)
            if i >= j and (a, b) == (c, d):
                continue
            if (p := self.find(i)) != (q := self.find(j)):
                common = len(np.intersect1d(self.sets[i], self.sets[j], assume_unique=True))
                if den * common >= num * (len(self.sets[i]) + len(self.sets[j]) - common) and (self.confirm is None or self.confirm(i, j)):
                    self.root[max(p, q)] = min(p, q)
                    yield i, j


def _joined(k: int, num: int, den: int):
    """Rows of (task, digest, rep, root, text), sorted by task, to the links that connect different roots."""

    def solve(rows: list) -> Iterator[tuple[int, int]]:
        sets = [x for part in range(0, len(rows), 256) for x in _sets([r[4] for r in rows[part : part + 256]], k)]
        groups: dict = {}
        for (task, digest, rep, root, text), s in zip(rows, sets):
            if len(s) and _digest(s) == digest:
                groups.setdefault(task, {})[digest] = (rep, s, root, text)
        for members in groups.values():
            if len(members) > 1:
                found = sorted(members.values(), key=lambda m: (len(m[1]), int(m[1][0]), m[0]))
                last: list = [-1, set()]

                def confirm(i: int, j: int) -> bool:
                    if last[0] != i:
                        last[:] = [i, shingles_of(found[i][3], k)]
                    other = shingles_of(found[j][3], k)
                    common = len(last[1] & other)
                    return den * common >= num * (len(last[1]) + len(other) - common)

                for i, j in Tree([m[1] for m in found], [m[2] for m in found], confirm).links(num, den):
                    yield found[i][0], found[j][0]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, now = [], 0, None
        for batch in batches:
            for part in slices(batch, "text"):
                for row in zip(*(c.to_pylist() for c in part.columns)):
                    if row[0] != now and size > 1_000_000:
                        yield _edges(solve(rows))
                        rows, size = [], 0
                    now = row[0]
                    rows.append(row)
                    size += len(row[4])
        if rows:
            yield _edges(solve(rows))

    return join


def _sets(texts: list[str], k: int) -> list[np.ndarray]:
    key, b = shingle_sets(tokenize(pa.array(texts, pa.string()), lower=True), k)
    return [key[b[i] : b[i + 1]].copy() for i in range(len(texts))]


def _edges(found: Iterator[tuple[int, int]]) -> pa.RecordBatch:
    pairs = list(found)
    return pa.RecordBatch.from_pydict({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})


_TASK = ["task", "digest", "rep", "root", "text"]


def _verified(tasks: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Links of the tasks (task, digest, rep, root, text)."""
    dealt = tasks.select(*_TASK).repartition("task").sortWithinPartitions("task")
    return store.table(dealt.mapInArrow(_joined(k, num, den), "a long, b long"), "links")


def _on(left: DataFrame, right: DataFrame, *keys: str, how: str = "inner") -> DataFrame:
    """A join on keys of which one may be hot: both sides are exchanged, so that the adaptive skew join can split them."""
    named = right.select(F.xxhash64(*keys).alias("__k"), *[F.col(c).alias(f"__on_{c}") if c in keys else F.col(c) for c in right.columns])
    on = F.xxhash64(*keys) == F.col("__k")
    for c in keys:
        on &= F.col(c) == F.col(f"__on_{c}")
    return left.join(named, on, how).drop("__k", *[f"__on_{c}" for c in keys])


def _class_numbers(classes: DataFrame) -> tuple[DataFrame, dict[bytes, int]]:
    """``classes`` (digest, cls, ...) with numbers that no two share, and the turns of the digests whose first number
    another class has: some hundred among 1e11 classes."""
    turns: dict[bytes, int] = {}
    numbered = classes
    while twice := numbered.groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.max("digest").alias("digest")).filter("n > 1").select("digest").collect():
        for r in twice:
            turns[bytes(r.digest)] = turns.get(bytes(r.digest), 0) + 1
        other = F.create_map(*[F.lit(x) for d in turns for x in (d.hex().upper(), _number(d, turns))])
        numbered = classes.withColumn("cls", F.coalesce(other[F.hex("digest")], F.col("cls")))
    return numbered, turns


def _chunked(members: DataFrame, chunk: int, num: int, den: int) -> DataFrame:
    """``members`` (block, digest, n, low, ...) of large blocks with a ``chunk``: texts of like size and, as far as can
    be, of like content, ``chunk`` of them at most on average, whatever the size of the block."""
    banded = members.withColumn("band", F.floor(F.log(F.greatest("n", F.lit(1))) / F.log(F.lit(den / num + 1e-9))))
    per_band = banded.groupBy("block", "band").agg(F.ceil(F.count(F.lit(1)) / chunk).alias("buckets"))
    dealt = _on(banded, per_band, "block", "band").withColumn("bucket", F.pmod("low", "buckets"))
    splits = F.greatest(F.ceil(F.count(F.lit(1)) / chunk), F.ceil(F.sum("n") / CHUNK_SHINGLES)).alias("splits")
    per_bucket = dealt.groupBy("block", "band", "bucket").agg(splits)
    split = _on(dealt, per_bucket, "block", "band", "bucket").withColumn("split", F.pmod(F.xxhash64("digest"), "splits"))
    return split.withColumn("chunk", F.xxhash64("block", "band", "bucket", "split")).drop("buckets", "bucket", "splits", "split")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, k: int = 5, num: int = 80, den: int = 100, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    members = store.table(rows.mapInArrow(_members(k, num, den), "doc_id long, n long, digest binary, cls long, low long, thin long"), "members")
    able = members.filter("doc_id is not null and digest is not null")
    classes = store.table(able.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.max("low").alias("low"), F.max("cls").alias("cls")), "classes")
    # a few numbers, however many texts there are: bands of sizes, of which there are some hundred in all
    full = sorted({b + x for (b,) in members.filter("thin is not null").select("thin").distinct().collect() for x in (-2, -1, 0, 1, 2)})
    numbered, turns = _class_numbers(classes)

    total = classes.agg(F.sum("n")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total * 12 // PACKED))
    buckets = 2 * parts
    sent = rows.filter("doc_id is not null").select("text").mapInArrow(_send(k, buckets, num, den, full, turns), _PACK)
    counted = sent.repartition(parts, "bucket").mapInArrow(_count(buckets), _PACK)
    prefix = store.table(counted.repartition(parts, "bucket").mapInArrow(_prefixes(num, den, full), "token long, cls long"), "prefixes")

    least = prefix.groupBy("token").agg(F.min("cls").alias("m"), F.max("cls").alias("x")).filter("m < x").select("token", "m")
    meets = _on(prefix, least, "token").filter("cls != m").select(F.col("cls").alias("a"), F.col("m").alias("b"))
    blocks = store.table(components(meets), "blocks")
    member = store.table(numbered.join(blocks, F.col("cls") == F.col("node")).select(F.col("root").alias("block"), "digest", "rep", "n", "low", "cls"), "members")
    size = member.groupBy("block").agg(((F.count(F.lit(1)) > chunk) | (F.sum("n") > CHUNK_SHINGLES)).alias("large"))
    # texts are fetched once, by a merge join at every size, and kept for the members of blocks alone
    source = rows.select(F.col("doc_id").alias("__id"), "text")
    cut = store.table(_on(member, size, "block").hint("merge").join(source, F.col("rep") == F.col("__id")).drop("__id"), "blocks")
    first = cut.filter("not large").select(F.xxhash64("block").alias("task"), "digest", "rep", F.col("rep").alias("root"), "text")
    large = cut.filter("large")
    some_large = not large.isEmpty()
    if some_large:
        dealt = store.table(_chunked(large.drop("text", "large"), chunk, num, den), "chunks")
        hubs = dealt.groupBy("block", F.pmod(F.xxhash64("rep"), F.lit(HUBS)).alias("hub")).agg(F.min(F.struct("rep", "digest")).alias("first")).select("block", "first.rep", "first.digest")
        everywhere = _on(dealt.select("block", "chunk").distinct(), hubs, "block").select("chunk", "rep", "digest")
        seats = dealt.select("chunk", "rep", "digest").unionByName(everywhere)
        first = first.unionByName(_texts(seats, large).select(F.xxhash64("chunk").alias("task"), "digest", "rep", F.col("rep").alias("root"), "text"))
    roots = components(_verified(first, k, num, den))
    if some_large:
        linked = roots.select("node", F.col("root").alias("found"))
        seat = dealt.join(linked, F.col("rep") == F.col("node"), "left").withColumn("root", F.coalesce("found", "rep")).drop("node", "found")
        main = seat.groupBy("block", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("block").agg(F.max_by("root", F.struct("n", -F.col("root"))).alias("main"))
        seat = _on(seat, main, "block")
        outside = seat.filter("root != main")
        if not outside.isEmpty():
            apart = _chunked(outside.drop("chunk", "band"), chunk, num, den).withColumns({"out": F.lit(True), "chunk": F.xxhash64(F.lit("outside"), "chunk")})
            dealt = apart.unionByName(seat.filter("root = main").withColumn("out", F.lit(False)))
            dealt = store.table(dealt.select("block", "band", "chunk", "out", "digest", "rep", "root", "cls"), "chunks")
            more = _verified(_pair_tasks(dealt, prefix, large), k, num, den)
            roots = components(roots.filter("node != root").select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    named = classes.join(roots.select(F.col("node").alias("__n"), "root"), F.col("rep") == F.col("__n"), "left").select("digest", F.coalesce("root", "rep").alias("root"))
    out = _on(members.withColumn("digest", F.when(F.col("doc_id").isNotNull(), F.col("digest"))), named, "digest", how="left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "doc_id").alias("component_id"))


def _texts(seats: DataFrame, large: DataFrame) -> DataFrame:
    """``seats`` (digest, rep, ...) with the texts."""
    return seats.hint("merge").join(large.select("digest", "rep", "text"), ["digest", "rep"])


def _pair_tasks(dealt: DataFrame, prefix: DataFrame, large: DataFrame) -> DataFrame:
    """Tasks of two chunks, one of them outside its block's largest component: those pairs that have sizes near enough and
    a prefix token in common. Tokens that the same chunks hold ask once."""
    held = prefix.hint("merge").join(dealt.select(F.col("cls").alias("__c"), "chunk", "band", "out"), F.col("cls") == F.col("__c"))
    lists = held.groupBy("token").agg(F.collect_set(F.struct("chunk", "band", "out")).alias("all")).filter(F.exists("all", lambda x: x["out"]))
    asked = lists.select(F.array_sort("all").alias("all")).distinct()
    pairs = asked.select("all", F.explode(F.filter("all", lambda x: x["out"])).alias("a")).select("a", F.explode("all").alias("b"))
    near = pairs.filter((F.abs(F.col("a.band") - F.col("b.band")) <= 1) & (~F.col("b.out") | (F.col("a.chunk") <= F.col("b.chunk"))))
    near = near.select(F.col("a.chunk").alias("one"), F.col("b.chunk").alias("two")).distinct().withColumn("task", F.xxhash64("one", "two"))
    sides = near.select("task", F.explode(F.array_distinct(F.array("one", "two"))).alias("chunk"))
    return _texts(_on(dealt.select("chunk", "digest", "rep", "root"), sides, "chunk"), large)


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS a FROM documents),
g AS (
  SELECT DISTINCT doc_id, shingle FROM (
    SELECT doc_id, unnest(list_transform(range(1, greatest(len(a) - 3, 2)), lambda i: array_to_string(a[i : i + 4], ' '))) AS shingle FROM d WHERE len(a) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM g x JOIN g y ON x.shingle = y.shingle AND x.doc_id > y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM i JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * common >= 80 * (p.n + q.n - common)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(node, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.a, r.root FROM r JOIN e ON e.b = r.node AND r.root < e.a),
c AS (SELECT node, min(root) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.node = d.doc_id
"""
