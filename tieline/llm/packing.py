"""Operator 10: packing of tokenised documents into sequences by linear grouping, configurations and best fit."""

from __future__ import annotations

import itertools
import os
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tieline.llm.common import LOWER, NON_SPACE, cut, doc_chunks, table, text_buffers, word_hashes, word_spans

CAPACITY = 2048
#: (shortest large length, groups): large pieces are grouped and get configurations, shorter ones are placed by best fit.
CHOICES = ((512, 32), (683, 32), (896, 48))
#: Words whose ids a worker remembers; past the limit it starts afresh with the next chunk.
CACHE_WORDS = 600_000
#: Bytes of text whose words are looked up together.
TEXT_CHUNK = 16 << 20
#: Pieces of one length that are numbered together, and the most blocks per length (both bound a task and a table).
ROWS_PER_BLOCK, MAX_BLOCKS = 1_000, 50_000
END = b"\0\0\0\0"


# ---------------------------------------------------------------- tokens

def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies use for each byte: itself if printable, else one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + k) for k, b in enumerate(rest)}


class WordTokenizer:
    """Ids of whole texts, put together from the ids of their words (no token of this vocabulary crosses white space).

    The words of a chunk of texts are hashed, each distinct one is looked up or encoded once, and the ids are gathered.
    A word of letters, with or without closing marks, goes straight to the vocabulary's merges; any other word, and
    with it any rarer white space inside, goes through the whole tokenizer.
    """

    #: Marks that follow a word; an apostrophe is none, as it may begin a token with the letter after it.
    MARKS = "!\"#$%&()*+,-./:;<=>?@[]^_`{|}~"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model.tokenize
        self.letters = byte_letters()
        self.cores: dict[str, list[int]] = {}
        self.tails: dict[str, list[int]] = {"": []}
        self.forget()

    def forget(self) -> None:
        #: Sorted hashes of known words, and where and how many their ids in ``flat`` are.
        self.keys, self.place, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, "<u4")

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def word(self, word: str) -> list[int]:
        """Ids of a run without ASCII white space."""
        bare = word.rstrip(self.MARKS)
        low = bare.lower()
        if low.isalpha() and len(bare) < 200 and (low.isascii() or ("\u03a3" not in bare and unicodedata.is_normalized("NFC", bare) and unicodedata.is_normalized("NFC", low))):
            tail = self.tails.get(word[len(bare):])
            if tail is None:
                if len(self.tails) > 1000:
                    self.tails = {"": []}
                tail = self.tails[word[len(bare):]] = self.tokenizer.encode(word[len(bare):], add_special_tokens=False).ids
            ids = self.cores.get(low)
            if ids is None:
                if len(self.cores) > CACHE_WORDS:
                    self.cores = {}
                text = low if low.isascii() else low.encode().decode("latin-1").translate(self.letters)
                ids = self.cores[low] = [t.id for t in self.merges(text)]
            return ids + tail
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def learn(self, kinds: np.ndarray, words: list[bytes]) -> None:
        found = [self.word(w.decode()) for w in words]
        size = np.array([len(x) for x in found], np.int64)
        new = np.fromiter(itertools.chain.from_iterable(found), "<u4", int(size.sum()))
        keys = np.concatenate([self.keys, kinds])
        order = np.argsort(keys, kind="stable")
        self.place = np.concatenate([self.place, len(self.flat) + np.cumsum(size) - size])[order]
        self.size = np.concatenate([self.size, size])[order]
        self.keys, self.flat = keys[order], np.concatenate([self.flat, new])

    def chunk(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of texts laid end to end, where each text's ids begin)."""
        data = raw.tobytes()
        low = raw if b"<|" in data else LOWER[raw]  # the special tokens' names are recognised in lower case only
        if low is not raw:
            data = low.tobytes()
        starts, ends = word_spans(low, offsets, NON_SPACE)
        begin = np.searchsorted(starts, offsets)
        if not len(starts):
            return np.zeros(0, "<u4"), np.zeros(len(offsets), np.int64)
        kinds, first, which = np.unique(word_hashes(low, starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) > CACHE_WORDS:
            self.forget()
        at = np.searchsorted(self.keys, kinds)
        at[at == len(self.keys)] = 0
        fresh = np.flatnonzero(self.keys[at] != kinds) if len(self.keys) else np.arange(len(kinds))
        if len(fresh):
            self.learn(kinds[fresh], [data[a:b] for a, b in zip(starts[first[fresh]].tolist(), ends[first[fresh]].tolist())])
            at = np.searchsorted(self.keys, kinds)
        many = self.size[at][which]
        begins = np.append(0, np.cumsum(many))
        ids = self.flat[np.repeat(self.place[at][which] - begins[:-1], many) + np.arange(begins[-1])]
        return ids, begins[begin]

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        raw, offsets = text_buffers(pa.array(texts, pa.large_string()))
        return [ids.tobytes() for ids in self.batch(raw, offsets)]

    def batch(self, raw: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
        for i, j in doc_chunks(offsets, TEXT_CHUNK):
            ids, begin = self.chunk(raw[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i])
            for k in range(j - i):
                yield ids[begin[k]: begin[k + 1]]


_tokenizers: dict[str, WordTokenizer] = {}


def _tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def _pieces(path: str, passed: list[str], text: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(path)
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for k, found in enumerate(tok.batch(*text_buffers(batch.column(text)))):
                ids = memoryview(found.tobytes() + END)
                n = len(ids) // 4
                for p, at in enumerate(range(0, n, capacity)):
                    size = min(capacity, n - at)
                    row.append(k)
                    piece.append(p)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(ids[4 * at: 4 * (at + size)]))
            rows = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(rows) for c in passed), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=[*passed, "piece", "start", "length", "ids_crc32"],
            )

    return run


# ---------------------------------------------------------------- plan

@dataclass
class Run:
    """``count`` sequences of equal contents, numbered from ``first``; a slot (length, rank, k) holds k pieces of that
    length in each, taken from consecutive ranks: ``rank`` on, k for each sequence."""

    first: int
    count: int
    room: int
    slots: list[tuple[int, int, int]] = field(default_factory=list)

    def split(self, n: int) -> tuple["Run", "Run"]:
        rest = [(size, rank + k * n, k) for size, rank, k in self.slots]
        return Run(self.first, n, self.room, list(self.slots)), Run(self.first + n, self.count - n, self.room, rest)


def best_pattern(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes that fits (unbounded knapsack)."""
    use = np.flatnonzero(worth > 1e-12)
    s, y = sizes[use], worth[use]
    value, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(int(s.min()) if len(s) else capacity + 1, capacity + 1):
        fit = s <= c
        total = np.where(fit, y + value[np.where(fit, c - s, 0)], -1.0)
        k = int(total.argmax())
        if total[k] > value[c - 1] + 1e-12:
            value[c], choice[c] = total[k], k
        else:
            value[c] = value[c - 1]
    pattern, c = np.zeros(len(sizes), np.int64), capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            pattern[use[choice[c]]] += 1
            c -= int(s[choice[c]])
    return float(value[capacity]), pattern


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 600, tolerance: float = 5e-4) -> list[tuple[np.ndarray, int]]:
    """Patterns and how often to use each: the linear relaxation by column generation, rounded down."""
    k = len(sizes)
    if not k:
        return []
    patterns = [np.eye(k, dtype=np.int64)[i] * (capacity // int(sizes[i])) for i in range(k)]
    basis = np.array(patterns, float).T
    amount = np.linalg.solve(basis, demand.astype(float))
    for _ in range(rounds):
        worth = np.linalg.solve(basis.T, np.ones(k))
        value, pattern = best_pattern(sizes, worth, capacity)
        if value <= 1 + tolerance:  # the relaxation is within this share of its optimum
            break
        change = np.linalg.solve(basis, pattern.astype(float))
        up = change > 1e-9
        if not up.any():
            break
        ratio = np.where(up, amount / np.where(up, change, 1), np.inf)
        out = int(ratio.argmin())
        amount = amount - ratio[out] * change
        amount[out] = ratio[out]
        basis[:, out], patterns[out] = pattern, pattern
    return [(p, int(a + 1e-6)) for p, a in zip(patterns, amount) if a + 1e-6 >= 1]


def groups_of(counts: dict[int, int], groups: int) -> list[list[int]]:
    """Large lengths from the longest down, in groups of about equally many pieces; a group is rounded up to its longest."""
    total = sum(counts.values())
    out: list[list[int]] = []
    held = 0
    for size in sorted(counts, reverse=True):
        if not out or held >= len(out) * total / groups:
            out.append([])
        out[-1].append(size)
        held += counts[size]
    return out


def make_plan(counts: dict[int, int], capacity: int = CAPACITY, choices: tuple[tuple[int, int], ...] = CHOICES) -> list[Run]:
    """The plan with the fewest sequences among ``choices`` of (shortest large length, groups)."""
    plans = [linear_grouping(counts, capacity, large, groups) for large, groups in choices]
    return min(plans, key=lambda runs: sum(r.count for r in runs))


def linear_grouping(counts: dict[int, int], capacity: int, large: int, groups: int) -> list[Run]:
    """Runs of sequences that hold ``counts[length]`` pieces of each length (all shorter than the capacity)."""
    left = {s: n for s, n in counts.items() if n}
    taken = dict.fromkeys(left, 0)
    members = groups_of({s: n for s, n in left.items() if s >= large}, groups)
    sizes = np.array([g[0] for g in members], np.int64)
    demand = np.array([sum(left[s] for s in g) for g in members], np.int64)
    runs: list[Run] = []
    number = 0

    def draw(group: list[int], n: int) -> list[tuple[int, int, int]]:
        """The next n pieces of a group as (length, rank, pieces); fewer when it runs out."""
        got = []
        for s in group:
            m = min(n, left[s])
            if m:
                got.append((s, taken[s], m))
                left[s] -= m
                taken[s] += m
                n -= m
        return got

    for pattern, times in sorted(configurations(sizes, demand, capacity), key=lambda x: -int(x[0].max(initial=0))):
        slots = [draw(members[g], times) for g in np.flatnonzero(pattern) for _ in range(pattern[g])]
        cuts = sorted({0, times, *(c for s in slots for c in np.cumsum([m for _, _, m in s]).tolist())})
        for a, b in zip(cuts, cuts[1:]):
            run = Run(number + a, b - a, capacity)
            for s in slots:
                at = 0
                for size, rank, m in s:
                    if at <= a < at + m:
                        run.slots.append((size, rank + a - at, 1))
                        run.room -= size
                    at += m
            runs.append(run)
        number += times

    by_room: list[list[Run]] = [[] for _ in range(capacity + 1)]
    done: list[Run] = []
    for run in runs:
        by_room[run.room].append(run)
    for size in sorted(left, reverse=True):
        room = size
        while left[size]:
            while room <= capacity and not by_room[room]:
                room += 1
            if room > capacity:
                k = min(capacity // size, left[size])
                many = left[size] // k
                run = Run(number, many, capacity)
                number += many
            else:
                run = by_room[room].pop()
                k = min(room // size, left[size])
                many = min(run.count, left[size] // k)
                if many < run.count:
                    run, rest = run.split(many)
                    by_room[room].append(rest)
            run.slots.append((size, taken[size], k))
            run.room -= size * k
            left[size] -= many * k
            taken[size] += many * k
            by_room[run.room].append(run)
            room = size
    for rest in by_room:
        done += rest
    return done


def plan_table(runs: list[Run]) -> dict[str, np.ndarray]:
    """One row for each slot of each run: where the ranks [rank, rank + k * count) of a length go."""
    rows = []
    for run in runs:
        at = 0
        for size, rank, k in run.slots:
            rows.append((size, rank, k, run.first, at))
            at += size * k
    rows.sort()
    names = ("length", "rank", "k", "first", "offset")
    return {n: np.array([r[i] for r in rows], np.int64) for i, n in enumerate(names)}


def _places(plan: dict[str, np.ndarray], passed: list[str]):
    key = (plan["length"] << 48) + plan["rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = (np.asarray(batch.column(c)).astype(np.int64) for c in ("length", "_rank"))
            at = np.searchsorted(key, (size << 48) + rank, "right") - 1
            inside = rank - plan["rank"][at]
            k = plan["k"][at]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in passed), pa.array(plan["first"][at] + inside // k), pa.array(plan["offset"][at] + inside % k * size)],
                names=[*passed, "sequence_id", "offset"],
            )

    return run


def pack(docs: DataFrame, tokenizer: str, text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Pieces of the tokenised rows of ``docs`` and their places: the other columns of ``docs``, then piece, start, length,
    ids_crc32, sequence_id and offset.

    A row's ids are those of its text (null: empty) followed by id 0; only more than ``capacity`` ids are cut, into
    pieces of ``capacity`` (the last may be shorter). A piece of full length is a sequence of its own (negative
    sequence_id). Every row is packed, repeated rows too; an empty table gives an empty result; columns of the added
    names are replaced.

    Lengths are counted (at most ``capacity`` numbers), the plan is made from the counts alone on the driver (its
    size depends on the number of lengths, not of documents), and each piece finds its place by its length and its
    rank among the pieces of that length. Ranks are given in hash blocks, so no length has to be sorted in one task.
    """
    added = ["piece", "start", "length", "ids_crc32", "sequence_id", "offset", "_block", "_blocks", "_base", "_rank"]
    passed = [c for c in docs.columns if c not in added and c != text]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*passed).schema)
    head = f"{fields}, " if fields else ""
    own = "piece int, start long, length long, ids_crc32 long"
    pieces = cut(docs.select(*passed, F.col(text).cast("string").alias(text)).mapInArrow(_pieces(tokenizer, passed, text, capacity), f"{head}{own}"))
    full = pieces.where(F.col("length") == capacity).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    short = pieces.where(F.col("length") < capacity)
    sizes = {int(r[0]): r[1] for r in short.groupBy("length").count().collect()}  # at most capacity numbers
    per_block = max(ROWS_PER_BLOCK, sum(sizes.values()) // MAX_BLOCKS)
    dealt = docs.sparkSession.createDataFrame([(n, 1 + c // per_block) for n, c in sizes.items()], "length long, _blocks int")
    spread = F.pmod(F.xxhash64(*passed, "piece", "ids_crc32"), F.col("_blocks")).cast("int")
    short = short.join(F.broadcast(dealt), "length").withColumn("_block", spread).drop("_blocks")
    found = short.groupBy("length", "_block").count().collect()  # at most capacity + MAX_BLOCKS numbers
    counts: dict[int, int] = {}
    bases = []
    for size, block, n in sorted(map(tuple, found)):
        bases.append((size, block, counts.get(size, 0)))
        counts[size] = counts.get(size, 0) + n
    plan = plan_table(make_plan(counts, capacity))
    base = docs.sparkSession.createDataFrame(bases, "length long, _block int, _base long")
    # Pieces that agree in all of these are interchangeable, so a task that runs again gives the same places.
    sortable = [c for c, t in docs.select(*passed).dtypes if "map<" not in t and "variant" not in t]
    order = Window.partitionBy("length", "_block").orderBy("ids_crc32", "piece", "start", *sortable)
    ranked = short.join(F.broadcast(base), ["length", "_block"]).withColumn("_rank", F.col("_base") + F.row_number().over(order) - 1)
    names = [*passed, "piece", "start", "length", "ids_crc32"]
    placed = ranked.select(*names, "_rank").mapInArrow(_places(plan, names), f"{head}{own}, sequence_id long, offset long")
    return placed.unionByName(full)


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens."""
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"), default_tokenizer())
