"""BPE encoding and decoding with word ends, by a lexicon automaton for frequent words and exact merges for all others.

The words of the whole corpus are counted. The most frequent ones (a bounded
number, a parameter) are encoded once and compiled into a minimal acyclic
transducer: words share prefixes and suffixes, the outputs on the arcs add up to
the word's number, and under that number lie its ids. The file goes to every
executor once (``SparkContext.addFile``), where all workers map it into memory.
Texts are cut at white space; a piece is cut into words and encoded once, as long as a
task holds it. All distinct words of new pieces walk the automaton together, a byte at a time.
Words that it does not hold are merged exactly, many at a time: the pair of least rank first,
the leftmost of equal ones. So neither the lexicon nor what is held changes the ids.

Texts are normalised and split as the tokenizer file says: composed (NFC), lower
case code point by code point, contractions, letters, single digits, other signs;
the special tokens are cut out of the raw text first. Texts with code points that
this Python knows nothing of are left to the library's own normaliser and splitter.

Edge cases: null and empty texts have no tokens; an empty table gives an empty
result and an empty lexicon; equal rows give equal ids; null ids pass through;
columns other than the two that are used are dropped, whatever their names. A long
text is worked off in stretches of half a megabyte cut at spaces; a word of any length
is merged over a heap. A null list decodes to null, an empty one to an empty text.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom import scratch
from threadloom.llm import store
from threadloom.llm.words import slices

MODEL = "/opt/tokenizers/word_bpe_49k.json"
#: Words of the lexicon at most; code points of a stretch; distinct pieces or words that a task holds, and code points of them; symbols from which on a heap is used.
LEXICON_WORDS, STRETCH, HELD, HELD_CHARS, HEAP = 1 << 16, 1 << 19, 150_000, 1 << 22, 48
#: Fixed values of the tokenizer file's kind: the end of a word, and what is kept of a text.
WORD_END = "</w>"
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_signs() -> list[str]:
    """The printable sign that stands for each byte: itself where it has one, else the next free one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(free)) for b in range(256)]


class Model:
    """Ids, merges and special tokens of a tokenizer file."""

    def __init__(self, source: str):
        self.source = source
        read = json.loads(source)
        model = read["model"]
        ids, signs = model["vocab"], byte_signs()
        if model["end_of_word_suffix"] != WORD_END or len(ids) + len(read["added_tokens"]) > 1 << 16:
            raise ValueError("this needs a BPE model with word ends and at most 65536 tokens")
        self.inner, self.last = [ids[s] for s in signs], [ids[s + WORD_END] for s in signs]
        self.rank, self.made = {}, []
        for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            self.rank.setdefault(ids[a] << 16 | ids[b], len(self.made))
            self.made.append(ids[a + b])
        self.special = {t["content"]: t["id"] for t in read["added_tokens"]}
        self.tokens = [""] * (1 + max([*ids.values(), *self.special.values()]))
        for token, i in [*ids.items(), *self.special.items()]:
            self.tokens[i] = token

    def merge(self, word: bytes) -> list[int]:
        """The ids of a word, by merging its bytes."""
        ids = [self.inner[b] for b in word]
        ids[-1] = self.last[word[-1]]
        if len(ids) > HEAP:
            return self._merge_long(ids)
        rank, none = self.rank.get, len(self.made)
        ranks = [rank(a << 16 | b, none) for a, b in zip(ids, ids[1:])]
        while ranks and (least := min(ranks)) < none:
            i = ranks.index(least)
            ids[i : i + 2] = [self.made[least]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank(ids[i - 1] << 16 | ids[i], none)
            if i < len(ranks):
                ranks[i] = rank(ids[i] << 16 | ids[i + 1], none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap of pairs over linked symbols; a pair whose symbols have changed is passed over."""
        n = len(ids)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, k) for i in range(n - 1) if (r := self.rank.get(k := ids[i] << 16 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, k = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or ids[i] << 16 | ids[j] != k:
                continue
            ids[i], ids[j], after[i] = self.made[r], -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n and (s := self.rank.get(key := ids[left] << 16 | ids[right])) is not None:
                    heapq.heappush(heap, (s, left, key))
        return [x for x in ids if x >= 0]


class Merger:
    """The ids of many words at once: in each round, every word that is not done makes its pair of least rank, the leftmost of equal ones, one symbol."""

    def __init__(self, model: Model):
        pairs = sorted(model.rank.items())
        self.model, self.none = model, len(model.made)
        self.pair, self.rank = np.array([k for k, _ in pairs] or [-1], np.int64), np.array([r for _, r in pairs] or [self.none], np.int64)
        self.inner, self.last, self.made = (np.array(x, np.int64) for x in (model.inner, model.last, model.made))

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        want = left << 16 | right
        at = np.minimum(self.pair.searchsorted(want), len(self.pair) - 1)
        return np.where(self.pair[at] == want, self.rank[at], self.none)

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Where each word's ids begin, and all of them; the words are not empty."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        data, ends = np.frombuffer(b"".join(words), np.uint8), np.cumsum(size)
        sign, of = self.inner[data], np.repeat(np.arange(len(words)), size)
        sign[ends - 1] = self.last[data[ends - 1]]
        rank = np.full(len(sign), self.none)  # of the pair that begins here, within a word
        here = np.flatnonzero(of[1:] == of[:-1])
        rank[here] = self._ranks(sign[here], sign[here + 1])
        done = []
        while len(sign):
            start = np.flatnonzero(np.diff(of, prepend=-1))
            least = np.minimum.reduceat(rank << 32 | np.arange(len(sign)), start)
            go = least >> 32 < self.none
            at, stay = least[go] & 0xFFFFFFFF, np.repeat(go, np.diff(start, append=len(sign)))
            done.append((of[~stay], sign[~stay]))
            sign[at] = self.made[least[go] >> 32]
            stay[at + 1] = False
            at = np.cumsum(stay)[at] - 1
            sign, of, rank = sign[stay], of[stay], rank[stay]
            rank[at] = self.none
            for left in (at[at > 0] - 1, at[at < len(sign) - 1]):
                left = left[of[left] == of[left + 1]]
                rank[left] = self._ranks(sign[left], sign[left + 1])
        of, sign = (np.concatenate([x[i] for x in done] or [np.zeros(0, np.int64)]) for i in (0, 1))
        return np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(words)))]), sign[of.argsort(kind="stable")]


class Splitter:
    """Pieces of a text, normalised, and their words; special tokens as they stand. A piece that occurs often is cut into words once."""

    def __init__(self, model: Model):
        import regex

        self._find = regex.compile(SPLIT).findall
        self._cut = re.compile("(" + "|".join(map(re.escape, model.special)) + ")") if model.special else None
        self._marks, self._source, self._special = sorted({s[0] for s in model.special}), model.source, model.special
        self._known: set[str] = set()

    @cached_property
    def _library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_str(self._source)

    def __call__(self, text: str) -> list[str]:
        """The pieces of a text between white space, normalised, in order; no word reaches beyond its piece.

        A piece that begins with a space is a word as it stands: a special token, or one that only the library could cut out."""
        if self._cut is None or not any(m in text for m in self._marks):
            return self._plain(text)
        return [w for i, part in enumerate(self._cut.split(text)) for w in ([" " + part] if i % 2 else self._plain(part))]

    def words(self, piece: str) -> list[str]:
        """The words of a piece; one of letters is a word."""
        if piece.isascii() and piece.isalpha():
            return [piece]
        return [piece[1:]] if piece[:1] == " " else self._find(piece)

    def _settled(self, text: str) -> bool:
        """Whether this Python knows every code point of the text."""
        new = set(text) - self._known
        if any(unicodedata.category(c) == "Cn" for c in new):
            return False
        self._known |= new
        return True

    def _plain(self, text: str) -> list[str]:
        if not text.isascii():
            if not self._settled(text):
                shown = self._library.pre_tokenizer.pre_tokenize_str(self._library.normalizer.normalize_str(text))
                back = {s: b for b, s in enumerate(byte_signs())}
                return [" " + bytes(back[c] for c in w).decode() for w, _ in shown]
            # a sigma at the end of a word has no form of its own here
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        # these four are white space to split() alone
        return text.lower().split(" " if any(c in text for c in "\x1c\x1d\x1e\x1f") else None)


def minimal_automaton(words: list[bytes]) -> tuple[list[tuple[tuple[int, int], ...]], list[bool]]:
    """Arcs (byte, state) and finality of each state of the smallest acyclic automaton of sorted distinct words; the last state is the first of all."""
    known: dict[tuple, int] = {}
    open_: list[list] = [[False, []]]

    def close(depth: int) -> None:
        while len(open_) > depth:
            key = (open_[-1][0], tuple(open_.pop()[1]))
            state = known.setdefault(key, len(known))
            if open_:
                byte, _ = open_[-1][1][-1]
                open_[-1][1][-1] = (byte, state)

    before = b""
    for word in words:
        same = len(os.path.commonprefix([before, word]))
        close(same + 1)
        for byte in word[same:]:
            open_[-1][1].append((byte, -1))
            open_.append([False, []])
        open_[-1][0] = True
        before = word
    close(1)
    root = (open_[0][0], tuple(open_[0][1]))
    states = [*(k for k in known if k != root), root]
    if root in known:  # no words: the state without arcs is the first as well
        return [()], [False]
    return [s[1] for s in states], [s[0] for s in states]


_PARTS = ("key", "target", "skip", "final", "first", "ids")


def compile_lexicon(words: list[bytes], model: Model) -> bytes:
    """The transducer of some distinct words as one file: a line of sizes, then the arrays.

    ``key`` holds state * 256 + byte of every arc in order, ``target`` and ``skip`` its end and its output,
    ``first`` and ``ids`` the ids of the words by number."""
    words = sorted(words)
    arcs, final = minimal_automaton(words)
    below = []  # words behind each state; targets come before their sources
    for a, f in zip(arcs, final):
        below.append(f + sum(below[t] for _, t in a))
    key, target, skip = [], [], []
    for s, (a, f) in enumerate(zip(arcs, final)):
        passed = int(f)
        for byte, t in a:
            key.append(s << 8 | byte), target.append(t), skip.append(passed)
            passed += below[t]
    ids = [model.merge(w) for w in words]
    arrays = {
        "key": np.array(key, np.int64), "target": np.array(target, np.int64), "skip": np.array(skip, np.int64), "final": np.array(final, np.int64),
        "first": np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.int64)]).astype(np.int64), "ids": np.array([x for w in ids for x in w], np.int64),
    }
    head = json.dumps({n: len(arrays[n]) for n in _PARTS}).encode()
    return b"".join([head.ljust(256), *[arrays[n].tobytes() for n in _PARTS]])


class Lexicon:
    """A compiled file, mapped into memory: workers of one machine share its pages."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            sizes = json.loads(f.read(256))
        at = 256
        for name in _PARTS:
            setattr(self, name, np.memmap(path, np.int64, "r", at, (sizes[name],)) if sizes[name] else np.zeros(0, np.int64))
            at += 8 * sizes[name]

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, -1 for those that the lexicon does not hold."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        start = np.cumsum(size) - size
        data = np.frombuffer(b"".join(words), np.uint8)
        state, number = np.full(len(words), len(self.final) - 1), np.zeros(len(words), np.int64)
        live, depth = np.flatnonzero(size > 0), 0
        while len(live) and len(self.key):
            want = state[live] << 8 | data[start[live] + depth]
            arc = np.minimum(self.key.searchsorted(want), len(self.key) - 1)
            there = self.key[arc] == want
            state[live[~there]] = -1
            live, arc, depth = live[there], arc[there], depth + 1
            state[live], number[live] = self.target[arc], number[live] + self.skip[arc]
            live = live[size[live] > depth]
        ok = (state >= 0) & (size > 0)
        ok[ok] = self.final[state[ok]] == 1
        return np.where(ok, number, -1)


def _within(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``first[i], first[i] + 1, ...`` (``size[i]`` numbers) for each i, end to end."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + size, size)


def stretches(text: str, limit: int) -> Iterator[str]:
    """Parts of about ``limit`` code points, cut before spaces: no word, composition or special token crosses a cut."""
    at = 0
    while len(text) - at > limit:
        cut = text.find(" ", at + limit)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:] if at else text


class Encoder:
    """Ids of texts: the lexicon's for its words, merged ones for all others."""

    def __init__(self, model: Model, lexicon: Lexicon):
        self.model, self.lexicon, self.split = model, lexicon, Splitter(model)
        self.merge = Merger(model)
        self._forget()

    def _forget(self) -> None:
        """Hold no pieces: their numbers, where the ids of each begin, and all of these."""
        self.index: dict[str, int] = defaultdict(count().__next__)
        self.first, self.ids, self.chars = np.zeros(1, np.int64), np.zeros(0, np.int32), 0

    def _resolve(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words: where each word's begin, and all of them."""
        raw = [w.encode() for w in words]
        number = self.lexicon.numbers(raw)
        special, seen = self.model.special, np.flatnonzero(number >= 0)
        short, other = [], []  # merged together, and one by one
        for i in np.flatnonzero(number < 0).tolist():
            (other if words[i] in special or len(raw[i]) > HEAP else short).append(i)
        short, other = np.array(short, np.int64), np.array(other, np.int64)
        made = [[special[words[i]]] if words[i] in special else self.model.merge(raw[i]) for i in other]
        merged, of_short = self.merge([raw[i] for i in short])
        size = np.zeros(len(words), np.int64)
        own = self.lexicon.first[number[seen]]
        size[seen], size[short], size[other] = self.lexicon.first[number[seen] + 1] - own, np.diff(merged), [len(m) for m in made]
        first = np.concatenate([[0], np.cumsum(size)])
        ids = np.empty(first[-1], np.int32)
        ids[_within(first[seen], size[seen])] = self.lexicon.ids[_within(own, size[seen])]
        ids[_within(first[short], size[short])] = of_short
        ids[_within(first[other], size[other])] = [x for m in made for x in m]
        return first, ids

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each text has, and the ids of all."""
        total, out = np.zeros(len(texts), np.int64), [np.zeros(0, np.int32)]
        held, size = [], 0
        for d, text in enumerate(texts):
            for part in stretches(text or "", STRETCH):
                held.append((d, part))
                size += len(part)
                if size >= STRETCH:
                    out.append(self._encode(held, total))
                    held, size = [], 0
        out.append(self._encode(held, total))
        return total, np.concatenate(out)

    def _encode(self, parts: list[tuple[int, str]], total: np.ndarray) -> np.ndarray:
        if len(self.index) > HELD or self.chars > HELD_CHARS:
            self._forget()
        known = len(self.index)
        codes, per = [], []
        for _, part in parts:
            found = self.split(part)
            codes += map(self.index.__getitem__, found)
            per.append(len(found))
        if new := list(islice(self.index, known, None)):
            first, ids = self._pieces(new)
            self.first, self.ids = np.concatenate([self.first, self.first[-1] + first[1:]]), np.concatenate([self.ids, ids])
            self.chars += sum(map(len, new))
        at = np.array(codes, np.int64)
        size = np.diff(self.first)[at]
        held = np.concatenate([[0], np.cumsum(size)])
        ends = np.cumsum(per, dtype=np.int64)
        np.add.at(total, [d for d, _ in parts], held[ends] - held[ends - per] if parts else [])
        return self.ids[_within(self.first[at], size)]

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces: where each piece's begin, and all of them."""
        index: dict[str, int] = defaultdict(count().__next__)
        codes, per = [], [0]
        for piece in pieces:
            found = self.split.words(piece)
            codes += map(index.__getitem__, found)
            per.append(len(found))
        first, ids = self._resolve(list(index))
        at = np.array(codes, np.int64)
        size = np.diff(first)[at]
        held = np.concatenate([[0], np.cumsum(size)])
        return held[np.cumsum(per, dtype=np.int64)], ids[_within(first[at], size)]


@lru_cache(1)
def _splitter(source: str) -> Splitter:
    return Splitter(Model(source))


@lru_cache(1)
def _encoder(source: str, path: str) -> Encoder:
    """One for all tasks of a worker, with the words that it has merged."""
    return Encoder(Model(source), Lexicon(path))


def word_counts(docs: DataFrame, text: str = "text", *, model: str = MODEL) -> DataFrame:
    """(word, n) of all words of all texts; a task adds up what it sees before anything is shuffled."""
    source = open(model, encoding="utf-8").read()

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, seen = _splitter(source), Counter()  # of pieces

        def flush() -> pa.RecordBatch:
            n: Counter = Counter()
            for piece, times in seen.items():
                for word in split.words(piece):
                    n[word] += times
            seen.clear()
            return pa.RecordBatch.from_pydict({"word": pa.array(list(n), pa.string()), "n": pa.array(list(n.values()), pa.int64())})

        for batch in batches:
            for t in batch.column(0):
                for part in stretches(t.as_py() or "", STRETCH):
                    seen.update(split(part))
                    if len(seen) > HELD:
                        yield flush()
        yield flush()

    return docs.select(F.col(text).cast("string").alias("text")).mapInArrow(add_up, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int = LEXICON_WORDS) -> list[str]:
    """The most frequent words of ``counts`` (word, n) that stay within ``most``: whole levels of frequency (16 to a factor of two),
    and of the first level that is too large a part by a hash. No task sorts all words."""
    level = F.floor(F.log2("n") * 16)
    held = {r.level: r.k for r in counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("k")).collect()}  # at most 1024 rows
    room, cut = most, None
    for x in sorted(held, reverse=True):
        if held[x] > room:
            cut = x
            break
        room -= held[x]
    if cut is None:
        return [r.word for r in counts.select("word").collect()]
    some = store.pick(counts.filter(level == cut), F.xxhash64("word"), room, "word").select("word") if room else counts.limit(0).select("word")
    return [r.word for r in counts.filter(level > cut).select("word").union(some).collect()]


def publish(spark: SparkSession, lexicon: bytes) -> str:
    """Write the file to the shared folder and give it to all executors, those that come later too; the name to pass to :func:`encode`."""
    name = f"lexicon-{hashlib.sha256(lexicon).hexdigest()[:32]}.bin"
    if not any(x.rsplit("/", 1)[-1] == name for x in spark.sparkContext.listFiles):
        where = f"{scratch.folder(spark)}/{name}"
        path = spark._jvm.org.apache.hadoop.fs.Path(where)
        out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
        out.write(bytearray(lexicon))
        out.close()
        spark.sparkContext.addFile(where)
    return name


def build(docs: DataFrame, text: str = "text", *, words: int = LEXICON_WORDS, model: str = MODEL) -> str:
    """The lexicon of the most frequent words of ``docs``, published."""
    counts = store.table(word_counts(docs, text, model=model), "words")
    own = Model(open(model, encoding="utf-8").read())
    chosen = [w.encode() for w in frequent(counts, words) if w not in own.special]
    store.drop(counts)
    return publish(docs.sparkSession, compile_lexicon(chosen, own))


def encode(docs: DataFrame, lexicon: str, doc_id: str = "doc_id", text: str = "text", *, model: str = MODEL) -> DataFrame:
    """(doc_id, n_tokens, ids) of every text."""
    source = open(model, encoding="utf-8").read()  # sent with the task: executors need no file of the tokenizer

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = _encoder(source, SparkFiles.get(lexicon))
        for batch in batches:
            for part in slices(batch, "text", STRETCH):
                n, ids = work.encode(part.column(1).to_pylist())
                ends = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
                yield pa.RecordBatch.from_pydict({"doc_id": part.column(0), "n_tokens": pa.array(n), "ids": pa.ListArray.from_arrays(ends, pa.array(ids))})

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, n_tokens long, ids array<int>")


def decode(rows: DataFrame, ids: str = "ids", text: str = "text", *, model: str = MODEL) -> DataFrame:
    """``rows`` with the tokens of their ids, joined by a space: what the library's decode gives for a file without a decoder."""
    tokens = pa.array(Model(open(model, encoding="utf-8").read()).tokens, pa.string())

    def spell(column: pa.Array) -> pa.Array:
        flat = tokens.take(column.flatten())
        ends = pa.array(np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))]), pa.int32())
        joined = pc.binary_join(pa.ListArray.from_arrays(ends, flat), " ")
        return pc.if_else(column.is_valid(), joined, pa.scalar(None, pa.string()))

    return rows.withColumn(text, F.arrow_udf(spell, "string")(F.col(ids)))


def digest(ids: str = "ids"):
    """SHA-256 of the ids of a row as little-endian unsigned numbers of 32 bits."""

    def run(column: pa.Array) -> pa.Array:
        data = np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False).astype("<u4"))
        ends = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))
        return pa.array([hashlib.sha256(data[e - n : e]).hexdigest() for e, n in zip(ends.tolist(), np.diff(ends, prepend=0).tolist())], pa.string())

    return F.arrow_udf(run, "string")(F.col(ids))
