"""Operator 8: benchmark decontamination by a prefix-filtered containment join of item windows against documents."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tieline.llm.common import ALNUM, cut, doc_chunks, hashed_words, table, text_buffers, windows

WINDOW = 13
#: Words in a shingle of a window; a window of fewer words is one shingle.
SHINGLE = 5
#: Item words that one broadcast may hold (16 bytes each and their windows). A larger benchmark is taken in blocks.
MAX_BLOCK_WORDS = 1_000_000
_FILTER_BITS = 20


@dataclass
class Windows:
    """Windows of some benchmark items, each found by its rarest shingle.

    ``words[start[k]: start[k] + width[k]]`` is window k, ``item[k]`` its item's number, ``pivot[k]`` the place of its
    rarest shingle in the window. ``key`` is sorted; windows ``first[j]:first[j + 1]`` of the arrays have the rarest
    shingle ``key[j]``. ``sizes`` are the shingle sizes that occur: SHINGLE, and those of shorter windows.
    """

    words: np.ndarray
    start: np.ndarray
    width: np.ndarray
    item: np.ndarray
    pivot: np.ndarray
    key: np.ndarray
    first: np.ndarray
    names: list[str]
    sizes: list[int]


def items_of(texts: list[str | None]) -> list[np.ndarray]:
    """Word hashes of each text."""
    raw, offsets = text_buffers(pa.array(texts, pa.large_string()))
    out: list[np.ndarray] = []
    for i, j in doc_chunks(offsets):
        words, begin = hashed_words(raw[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i], ALNUM)
        out += [words[begin[k]: begin[k + 1]] for k in range(j - i)]
    return out


def item_windows(words: np.ndarray, width: int) -> tuple[int, int]:
    """(words in a window, words in a shingle) of an item; windows of 0 words if it has none."""
    size = min(width, len(words))
    return size, min(SHINGLE, size)


def item_shingles(items: list[np.ndarray], width: int) -> np.ndarray:
    """Sorted distinct shingles of all items: the vocabulary that is counted in the documents."""
    parts = [windows(w, item_windows(w, width)[1]) for w in items if len(w)]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def build_windows(names: list[str], items: list[np.ndarray], vocabulary: np.ndarray, counts: np.ndarray, width: int) -> Windows:
    """Index the windows of ``items`` by their rarest shingle under the corpus counts of ``vocabulary`` (sorted)."""
    words = np.concatenate(items) if items else np.zeros(0, np.uint64)
    starts, widths, owner, pivots, rare, sizes = [], [], [], [], [], set()
    at = 0
    for n, w in enumerate(items):
        size, part = item_windows(w, width)
        if size:
            sizes.add(part)
            shingles = windows(w, part)
            rank = counts[np.searchsorted(vocabulary, shingles)]
            inside = size - part + 1
            # Containment of all shingles needs a prefix of one: the rarest, ties by hash and then by place.
            order = np.empty(len(shingles), np.int64)
            order[np.lexsort((np.arange(len(shingles)), shingles, rank))] = np.arange(len(shingles))
            best = np.lib.stride_tricks.sliding_window_view(order, inside).argmin(axis=1)
            k = np.arange(len(best))
            starts.append(at + k)
            widths.append(np.full(len(k), size))
            owner.append(np.full(len(k), n))
            pivots.append(best)
            rare.append(shingles[k + best])
        at += len(w)
    start, size, item, pivot = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (starts, widths, owner, pivots))
    found = np.concatenate([*rare, np.zeros(0, np.uint64)])
    order = np.argsort(found, kind="stable")
    key, first = np.unique(found[order], return_index=True)
    return Windows(words, start[order], size[order], item[order], pivot[order], key, np.append(first, len(order)), names, sorted(sizes))


def _bitmap(keys: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << _FILTER_BITS, bool)
    out[(keys & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)] = True
    return out


def _known(words: np.ndarray, keys: np.ndarray, bitmap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the words that are among the sorted ``keys``, and their places there."""
    at = np.flatnonzero(bitmap[(words & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)])
    place = np.searchsorted(keys, words[at])
    place[place == len(keys)] = 0
    same = keys[place] == words[at] if len(keys) else np.zeros(0, bool)
    return at[same], place[same]


def occurrences(words: np.ndarray, begin: np.ndarray, index: Windows, bitmap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word position of the window's start, window) for every exact occurrence in texts laid end to end."""
    # A shingle's hash depends on its size, so shingles of all sizes that occur look up one table.
    found = [_known(windows(words, n), index.key, bitmap) for n in index.sizes]
    at, place = (np.concatenate([*(f[k] for f in found), np.zeros(0, np.int64)]).astype(np.int64) for k in (0, 1))
    many = index.first[place + 1] - index.first[place]
    pos = np.repeat(at, many)
    window = np.repeat(index.first[place], many) + (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many))
    doc = np.searchsorted(begin, pos, "right") - 1
    start = pos - index.pivot[window]
    fits = (start >= begin[doc]) & (start + index.width[window] <= begin[doc + 1])  # positional and length bounds
    start, window = start[fits], window[fits]
    for k in range(int(index.width.max()) if len(index.width) else 0):  # verify word by word
        short = index.width[window] <= k
        same = short | (words[np.where(short, 0, start + k)] == index.words[np.where(short, 0, index.start[window] + k)])
        start, window = start[same], window[same]
    return start, window


def _scan(index: Windows, text: str, passed: list[str]):
    """One pass over documents with the hit spans and items so far: add this block's occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = _bitmap(index.key)
        for batch in batches:
            raw, offsets = text_buffers(batch.column(text))
            old_spans, old_items = batch.column("_spans").to_pylist(), batch.column("_items").to_pylist()
            n_words, spans, items = [], [], []
            for i, j in doc_chunks(offsets):
                words, begin = hashed_words(raw[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i], ALNUM)
                start, window = occurrences(words, begin, index, bitmap)
                doc = np.searchsorted(begin, start, "right") - 1
                order = np.lexsort((start, doc))
                start, window, doc = start[order], window[order], doc[order]
                n_words += np.diff(begin).tolist()
                spans += old_spans[i:j]
                items += old_items[i:j]
                for d in np.unique(doc):
                    mine = doc == d
                    new = [[int(s), int(s + w)] for s, w in zip(start[mine] - begin[d], index.width[window[mine]])]
                    spans[i + d] = merge([*(spans[i + d] or []), *new])
                    items[i + d] = sorted({*(items[i + d] or []), *(index.names[k] for k in np.unique(index.item[window[mine]]))})
            own = [pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in passed), *own], names=[*passed, "n_words", "_spans", "_items"])

    return run


def merge(spans: list[list[int]]) -> list[list[int]]:
    """Disjoint sorted spans that cover the same positions."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def _counts(vocabulary: np.ndarray, sizes: list[int], text: str):
    """Partial counts of the vocabulary's shingles, one row for each that a partition has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, total = _bitmap(vocabulary), np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            raw, offsets = text_buffers(batch.column(text))
            for i, j in doc_chunks(offsets):
                words, _ = hashed_words(raw[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i], ALNUM)
                for n in sizes:  # a shingle over the border of two texts may count: counts only order the shingles
                    total += np.bincount(_known(windows(words, n), vocabulary, bitmap)[1], minlength=len(vocabulary))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["w", "n"])

    return run


def item_blocks(benchmark: DataFrame, item_id: str, text: str, limit: int) -> Iterator[tuple[list[str], list[np.ndarray]]]:
    """Items (names, word hashes) in blocks of about ``limit`` words: the driver holds one block at a time."""
    rows = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(text).cast("string").alias("t")).where("i is not null and t is not null")
    names: list[str] = []
    texts: list[str] = []
    size = 0
    for i, t in rows.toLocalIterator():
        names.append(i)
        texts.append(t)
        size += len(t) // 2 + 1
        if size >= limit:
            yield names, items_of(texts)
            names, texts, size = [], [], 0
    if names:
        yield names, items_of(texts)


def _pass(work: DataFrame, index: Windows, text: str, passed: list[str], before: int) -> DataFrame:
    if before:
        work = cut(work)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in work.select(*passed).schema]
    schema = ", ".join([*fields, "n_words bigint", "_spans array<array<bigint>>", "_items array<string>"])
    return work.select(*passed, "_spans", "_items").mapInArrow(_scan(index, text, passed), schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WINDOW, max_block_words: int = MAX_BLOCK_WORDS, keep_text: bool = True) -> DataFrame:
    """``docs`` with n_words, hit_spans, n_hit, items, n_items, items_sha256 and contaminated added.

    A-Z are lower-cased; words are runs of digits, a-z and non-ASCII characters. A window is ``width`` consecutive
    words of an item (a shorter item is one window; an item without words has none). hit_spans are the disjoint word
    ranges [from, to) of the document that lie in any occurrence of a window, n_hit counts their words; items are the
    ids (as strings, sorted) with an occurring window. contaminated: n_hit > 0 and 20 * n_hit >= n_words.

    Containment is a set join at a threshold of one over shingles of SHINGLE words: the necessary prefix of a window is
    its rarest shingle by counts over all documents. Document shingles that are such a key propose a window at one
    position; the text's borders bound it; then it is verified word by word. The benchmark is broadcast in blocks of bounded size; several
    blocks mean several passes, cut by checkpoints, so nothing grows with the benchmark but time.

    A null text has no words; items without id or text are left out; items that share an id count once; document
    rows are kept as they are, repeated or not; columns of the added names are replaced; empty tables work.
    """
    added = ["n_words", "hit_spans", "n_hit", "items", "n_items", "items_sha256", "contaminated", "_spans", "_items"]
    passed = [c for c in docs.columns if c not in added]
    work = docs.select(*passed).withColumns({"_spans": F.lit(None).cast("array<array<bigint>>"), "_items": F.lit(None).cast("array<string>")})
    passes = 0
    for names, items in item_blocks(benchmark, item_id, item_text, max_block_words):
        vocabulary = item_shingles(items, width)
        counts = np.zeros(len(vocabulary), np.int64)
        sizes = sorted({item_windows(w, width)[1] for w in items if len(w)})
        tally = docs.select(doc_text).mapInArrow(_counts(vocabulary, sizes, doc_text), "w bigint, n bigint").groupBy("w").agg(F.sum("n").alias("n"))
        for w, n in tally.toLocalIterator():  # at most as many rows as the block has shingles
            counts[w] = n
        work = _pass(work, build_windows(names, items, vocabulary, counts, width), doc_text, passed, passes)
        passes += 1
    if not passes:
        none = build_windows([], [], np.zeros(0, np.uint64), np.zeros(0, np.int64), width)
        work = _pass(work, none, doc_text, passed, passes)
    if not keep_text:
        work = work.drop(doc_text)
    spans, items = F.coalesce("_spans", F.array().cast("array<array<bigint>>")), F.coalesce("_items", F.array().cast("array<string>"))
    n_hit = F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])
    out = work.withColumns({"hit_spans": spans, "n_hit": n_hit, "items": items, "n_items": F.size(items).cast("long"), "items_sha256": F.sha2(F.array_join(items, ",").cast("binary"), 256)})
    return out.drop("_spans", "_items").withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contamination of all documents by all benchmark items."""
    out = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), keep_text=False)
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def sha256_hex(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
