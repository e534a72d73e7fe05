"""Operator 2: toxic spans by a linear-chain conditional random field, and document scores from its marginals."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tieline.llm.common import LOWER, NON_SPACE, doc_chunks, table, text_buffers, word_hashes, word_spans

#: The field is learned from at most so many labelled texts of each class, those with the smallest id hash, each whole.
#: They are all that reaches the driver.
MAX_POSITIVE, MAX_NEGATIVE = 1500, 3000
#: A token of a toxic text is labelled toxic by a feature that is SEED_SHARE or more toxic (by text frequencies) and either
#: stands in SEED_COMMON of the toxic texts or is needed to explain SEED_NEW of them that no better one explains.
SEED_SHARE, SEED_TEXTS, SEED_COMMON, SEED_NEW = 0.85, 4, 0.04, 0.01
SEGMENT, EPOCHS, RATE, RIDGE = 60, 25, 0.5, 0.3
MIN_FEATURE = 3
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: A token belongs to a span from this marginal on; smaller marginals than FLOOR do not add to a text's mass.
SPAN, FLOOR = 0.5, 0.05
TEXT_CHUNK = 8 << 20
CACHE_WORDS = 600_000
#: Training tokens that one pass holds scores of; a longer segment or text is a pass of its own.
TRAIN_CHUNK = 1 << 17

_EDGE = re.compile(r"^[^\w]+|[^\w]+$")


def features(word: str) -> list[str]:
    """Features of a lower-case word: its core without outer marks, that core's first and last letters, its kind."""
    core = _EDGE.sub("", word)
    out = ["w=" + core, *(f"p{k}=" + core[:k] for k in (3, 4, 5, 6, 7)), "s3=" + core[-3:], "s4=" + core[-4:]]
    if any(c.isdigit() for c in core):
        out.append("digit")
    if len(core) < len(word):
        out.append("mark")
    return out


def neighbour_features(word: str) -> list[str]:
    """What the words before and after a token see of this one: its core and that core's first letters."""
    core = _EDGE.sub("", word)
    return ["w=" + core, "p4=" + core[:4]]


#: Where a feature's word stands, seen from the token: itself, the word before it, the word after it.
PLACES = ((0, features), (-1, neighbour_features), (1, neighbour_features))


@dataclass
class Field:
    """Weights of the toxic tag by place and feature, log potentials [from][to] of (other, toxic), and the document scorer."""

    weights: tuple[dict[str, float], dict[str, float], dict[str, float]]
    bias: float
    transition: np.ndarray
    scorer: np.ndarray

    def parts(self, word: str) -> tuple[float, float, float]:
        """What a word adds to its own token, to the next one and to the one before."""
        return tuple(sum(w.get(f, 0.0) for f in make(word)) for w, (_, make) in zip(self.weights, PLACES))


def gathered(parts: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Unary scores of tokens from their words' ``parts`` (a row for each token), neighbours within a text only."""
    own = parts[:, 0].copy()
    if len(own) > 1:
        first = np.zeros(len(own) + 1, bool)
        first[begin] = True
        inner = ~first[1:-1]
        own[1:] += np.where(inner, parts[:-1, 1], 0)
        own[:-1] += np.where(inner, parts[1:, 2], 0)
    return own


def messages(unary: np.ndarray, begin: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward messages as ratios (toxic to other), for texts laid end to end (text k: begin[k]:begin[k + 1]).

    The forward ratio holds the token's own score. A text starts as if after an 'other'. All texts step together, longest first.
    """
    size = np.diff(begin)
    order = np.argsort(-size, kind="stable")
    first, size = begin[:-1][order], size[order]
    a = np.exp(transition)
    emit = np.exp(np.clip(unary, -30, 30))
    forward, backward = np.empty(len(unary)), np.empty(len(unary))
    longest = int(size[0]) if len(size) else 0
    live = np.searchsorted(-size, -np.arange(longest), "left") if longest else []
    r = np.ones(len(size))
    for t in range(longest):
        k = live[t]
        at = first[:k] + t
        r[:k] = emit[at] * ((a[0, 1] + a[1, 1] * r[:k]) / (a[0, 0] + a[1, 0] * r[:k]) if t else a[0, 1] / a[0, 0])
        forward[at] = r[:k]
    last = first + size - 1
    q = np.ones(len(size))
    for t in range(longest):
        k = live[t]
        at = last[:k] - t
        if t:
            x = emit[at + 1] * q[:k]
            q[:k] = (a[1, 0] + a[1, 1] * x) / (a[0, 0] + a[0, 1] * x)
        backward[at] = q[:k]
    return forward, backward


def marginals(unary: np.ndarray, begin: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """P(toxic) of each token by forward-backward."""
    forward, backward = messages(unary, begin, transition)
    odds = forward * backward
    return odds / (1 + odds)


def expectations(unary: np.ndarray, begin: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(P(toxic) of each token, expected number of each transition [from][to], a text's start counting as from 'other')."""
    forward, backward = messages(unary, begin, transition)
    odds = forward * backward
    p = odds / (1 + odds)
    starts = np.zeros(len(unary), bool)
    starts[begin[:-1][np.diff(begin) > 0]] = True
    counts = np.zeros((2, 2))
    counts[0] += (1 - p[starts]).sum(), p[starts].sum()
    to = np.flatnonzero(~starts)
    a, r = np.exp(transition), forward[to - 1]
    x = np.exp(np.clip(unary[to], -30, 30)) * backward[to]
    cells = np.array([[a[0, 0] * np.ones(len(to)), a[0, 1] * x], [a[1, 0] * r, a[1, 1] * r * x]])
    counts += (cells / cells.sum(axis=(0, 1))).sum(axis=2)
    return p, counts


def document_features(p: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """For each text: 1, the log odds of its most toxic token, and the log of its toxic mass (a text without words: none)."""
    n = len(begin) - 1
    top, mass = np.zeros(n), np.zeros(n)
    some = np.flatnonzero(np.diff(begin))
    if len(some):
        top[some] = np.maximum.reduceat(p, begin[:-1][some])
        mass[some] = np.add.reduceat(np.where(p >= FLOOR, p, 0), begin[:-1][some])
    top = np.clip(top, 1e-4, 1 - 1e-4)
    return np.column_stack([np.ones(n), np.log(top / (1 - top)), np.log1p(mass)])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_scorer(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = sigmoid(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (y - p) - 1e-2 * w)
    return w


@dataclass
class Tokens:
    """Texts as word numbers, and for each place the feature numbers of each word (word w: index[first[w]:first[w + 1]])."""

    words: list[str]
    texts: list[np.ndarray]
    names: list[list[str]]
    first: list[np.ndarray]
    index: list[np.ndarray]

    @classmethod
    def of(cls, texts: list[str]) -> "Tokens":
        known: dict[str, int] = {}
        numbered = [np.fromiter((known.setdefault(w[0].lower(), len(known)) for w in WORD.finditer(t)), np.int32) for t in texts]
        out = cls(list(known), numbered, [], [], [])
        for k, (_, make) in enumerate(PLACES):
            if k and make is PLACES[k - 1][1]:  # both neighbours see the same features
                for each in (out.names, out.first, out.index):
                    each.append(each[-1])
                continue
            names: dict[str, int] = {}
            first, index = array("q", [0]), array("i")
            for w in known:
                index.extend([names.setdefault(f, len(names)) for f in make(w)])
                first.append(len(index))
            out.names.append(list(names))
            out.first.append(np.array(first, np.int64))
            out.index.append(np.array(index, np.int32))
        return out

    def features_of(self, words: np.ndarray, place: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(feature numbers of all words in order, which word each belongs to)."""
        first, index = self.first[place], self.index[place]
        many = first[words + 1] - first[words]
        owner = np.repeat(np.arange(len(words), dtype=np.int32), many)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
        return index[first[words][owner] + at], owner


def seed_features(tokens: Tokens, toxic: np.ndarray) -> np.ndarray:
    """Which features mark toxic texts (a boolean for each), by text frequencies and greedy cover."""
    own = [np.unique(tokens.features_of(np.unique(t))[0]) for t in tokens.texts]
    names = tokens.names[0]
    seen = np.zeros((2, len(names)), np.int64)
    for f, y in zip(own, toxic):
        seen[int(y), f] += 1
    n1 = max(1, int(toxic.sum()))
    n0 = max(1, len(toxic) - n1)
    least = max(SEED_TEXTS, SEED_NEW * n1)
    share = np.divide(seen[1] / n1, seen[1] / n1 + seen[0] / n0, out=np.zeros(len(names)), where=seen[1] > 0)
    good = (seen[1] >= least) & (share >= SEED_SHARE) & ~np.isin(names, ["digit", "mark"])
    seeds = good & (seen[1] >= SEED_COMMON * n1)
    left = [f[good[f]] for f, y in zip(own, toxic) if y and not seeds[f].any()]
    while left:
        count = np.bincount(np.concatenate(left), minlength=len(names))
        best = int(count.argmax())
        if count[best] < least:
            break
        seeds[best] = True
        left = [f for f in left if not (f == best).any()]
    return seeds


def train(texts: list[str], toxic: list[int]) -> Field:
    """Label tokens by the features that separate the texts, then fit weights and transitions to them by forward-backward.

    Every word of every text is used. Long texts are cut into segments of SEGMENT words. A word's features add to its own
    token and, fewer of them, to the tokens beside it; scores and gradients are summed by word first, over TRAIN_CHUNK
    tokens at a time, so memory follows the vocabulary: of a token only its word and its label are kept.
    """
    tokens, y_text = Tokens.of(texts), np.array(toxic, np.int64)
    seeds = seed_features(tokens, y_text)
    marked = np.zeros(len(tokens.words), bool)
    flat, owner = tokens.features_of(np.arange(len(tokens.words)))
    marked[owner[seeds[flat]]] = True
    words = np.concatenate([*tokens.texts, np.zeros(0, np.int32)])
    y = np.concatenate([*(marked[t] & bool(k) for t, k in zip(tokens.texts, y_text)), np.zeros(0, bool)])
    cuts = [np.arange(0, len(t), SEGMENT) for t in tokens.texts]
    at = np.append(0, np.cumsum([len(t) for t in tokens.texts]))
    begin = np.append(np.concatenate([*(c + a for c, a in zip(cuts, at)), np.zeros(0, np.int64)]), len(words)).astype(np.int64)
    tokens.texts = []
    size = len(tokens.words)
    seen = np.bincount(words, minlength=size)
    layout, weights, spent = [], [], []
    for place in range(len(PLACES)):
        flat, owner = tokens.features_of(np.arange(size), place)
        used = np.bincount(flat, seen[owner], len(tokens.names[place])) >= MIN_FEATURE
        layout.append((flat[used[flat]], owner[used[flat]]))
        weights.append(np.zeros(len(tokens.names[place])))
        spent.append(np.full(len(tokens.names[place]), 1e-6))
    bias, transition, spent_b, spent_t = -4.0, np.zeros((2, 2)), 1e-6, np.full((2, 2), 1e-6)
    observed = np.zeros((2, 2))

    def parts(sparse: float = 0.0) -> np.ndarray:
        """What each word of the vocabulary adds, by place."""
        return np.column_stack([np.bincount(o, np.where(np.abs(w) > sparse, w, 0.0)[f], size) for w, (f, o) in zip(weights, layout)])

    def passes(begin: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(words, labels, where segments begin) of some whole segments at a time."""
        for i, j in doc_chunks(begin, TRAIN_CHUNK):
            a, b = begin[i], begin[j]
            yield words[a:b], y[a:b], begin[i: j + 1] - a

    for w, tag, first in passes(begin):
        starts = np.zeros(len(w) + 1, bool)
        starts[first] = True
        np.add.at(observed, (np.where(starts[:-1], 0, np.roll(tag, 1)), tag.astype(np.int8)), 1)
    for _ in range(EPOCHS if len(y) else 0):
        known, expected, total = parts(), np.zeros((2, 2)), 0.0
        sums = [np.zeros(size) for _ in PLACES]
        for w, tag, first in passes(begin):
            p, counts = expectations(bias + gathered(known[w], first), first, transition)
            expected += counts
            gap = tag - p
            total += gap.sum()
            starts = np.zeros(len(w) + 1, bool)
            starts[first] = True
            inner = ~starts[1:-1]
            for s, v, g in zip(sums, (w, w[:-1], w[1:]), (gap, np.where(inner, gap[1:], 0), np.where(inner, gap[:-1], 0))):
                s += np.bincount(v, g, size)
        for w, s, (f, o), g in zip(weights, spent, layout, sums):
            grad = np.bincount(f, g[o], len(w)) - RIDGE * w
            s += grad**2
            w += RATE * grad / np.sqrt(s)
        spent_b += total**2
        bias += RATE * total / np.sqrt(spent_b)
        turn = observed - expected - RIDGE * transition
        spent_t += turn**2
        transition += RATE * turn / np.sqrt(spent_t)
    kept = tuple({names[k]: float(w[k]) for k in np.flatnonzero(np.abs(w) > 1e-3).tolist()} for names, w in zip(tokens.names, weights))
    field = Field(kept, float(bias), transition, np.array([-3.0, 1.0, 0.0]))
    if 0 < y_text.sum() < len(y_text):
        known = parts(1e-3)
        seen_by = [document_features(marginals(bias + gathered(known[w], first), first, transition), first) for w, _, first in passes(at)]
        field.scorer = fit_scorer(np.concatenate(seen_by), y_text.astype(float))
    return field


def fit(docs: DataFrame, labels: DataFrame, text: str = "text") -> Field:
    """Learn from documents with a 0/1 ``toxic`` label whose crc32(doc_id as text) mod 5 is not 0."""
    known = labels.where("doc_id is not null and toxic in (0, 1) and crc32(cast(doc_id as string)) % 5 <> 0").select(F.col("doc_id").alias("_id"), "toxic").distinct()
    some = lambda y, n: known.where(F.col("toxic") == y).orderBy(F.xxhash64("_id"), "_id").limit(n)
    chosen = some(1, MAX_POSITIVE).union(some(0, MAX_NEGATIVE))
    rows = docs.select(F.col("doc_id"), F.col(text).cast("string").alias("_t")).where("_t is not null").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))  # bounded by the two limits
    # Copies of a text would count as evidence several times.
    found = sorted({r["_t"]: (r["_id"], int(r["toxic"])) for r in sorted(rows.select("_id", "_t", "toxic").collect(), reverse=True)}.items(), key=lambda x: x[1])
    return train([t for t, _ in found], [y for _, (_, y) in found])


class WordScores:
    """What words add to the scores around them, by their hash; forgets all past the limit."""

    def __init__(self, field: Field):
        self.field = field
        self.keys, self.values = np.zeros(0, np.uint64), np.zeros((0, len(PLACES)))

    def of(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        kinds, first, which = np.unique(word_hashes(low, starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) > CACHE_WORDS:
            self.keys, self.values = np.zeros(0, np.uint64), np.zeros((0, len(PLACES)))
        at = np.searchsorted(self.keys, kinds)
        at[at == len(self.keys)] = 0
        fresh = np.flatnonzero(self.keys[at] != kinds) if len(self.keys) else np.arange(len(kinds))
        if len(fresh):
            data = low.tobytes()
            new = [self.field.parts(data[a:b].decode().lower()) for a, b in zip(starts[first[fresh]].tolist(), ends[first[fresh]].tolist())]
            keys = np.concatenate([self.keys, kinds[fresh]])
            order = np.argsort(keys, kind="stable")
            self.keys, self.values = keys[order], np.concatenate([self.values, np.array(new)])[order]
            at = np.searchsorted(self.keys, kinds)
        return self.values[at][which]


def spans_of(p: np.ndarray, starts: np.ndarray, ends: np.ndarray, low: np.ndarray) -> list[dict]:
    """Runs of toxic tokens of one text as code point ranges with their highest marginal. Byte places are relative to ``low``."""
    hot = np.flatnonzero(p >= SPAN)
    if not len(hot):
        return []
    points = np.append(0, np.cumsum((low & 0xC0) != 0x80))
    out: list[dict] = []
    for k in hot.tolist():
        if out and out[-1]["_k"] == k - 1:
            out[-1] |= {"end": int(points[ends[k]]), "score": max(out[-1]["score"], float(p[k])), "_k": k}
        else:
            out.append({"start": int(points[starts[k]]), "end": int(points[ends[k]]), "score": float(p[k]), "_k": k})
    return [{c: s[c] for c in ("start", "end", "score")} for s in out]


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def _score(field: Field, passed: list[str], text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordScores(field)
        for batch in batches:
            raw, offsets = text_buffers(batch.column(text))
            scores, spans = [], []
            for i, j in doc_chunks(offsets, TEXT_CHUNK):
                at = offsets[i: j + 1] - offsets[i]
                low = LOWER[raw[offsets[i]: offsets[j]]]
                starts, ends = word_spans(low, at, NON_SPACE)
                begin = np.searchsorted(starts, at)
                p = marginals(field.bias + gathered(words.of(low, starts, ends), begin), begin, field.transition) if len(starts) else np.zeros(0)
                scores.append(sigmoid(document_features(p, begin) @ field.scorer))
                hot = np.zeros(len(p) + 1, np.int64)
                hot[1:] = np.cumsum(p >= SPAN)
                for k, any_hot in enumerate((hot[begin[1:]] > hot[begin[:-1]]).tolist()):
                    a, b = begin[k], begin[k + 1]
                    spans.append(spans_of(p[a:b], starts[a:b] - at[k], ends[a:b] - at[k], low[at[k]: at[k + 1]]) if any_hot else [])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in passed), pa.array(np.concatenate(scores) if scores else np.zeros(0)), pa.array(spans, _SPANS)],
                names=[*passed, "score", "toxic_spans"],
            )

    return run


def score(docs: DataFrame, field: Field, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``toxic_spans`` (start, end in code points, highest marginal).

    The score comes from the text's marginals alone. A null or empty text has no tokens: no spans, the score of a text
    without a toxic word. Rows are scored one by one, so repeated rows are equal and an empty table stays empty. Columns
    of the added names are replaced, others pass through (the text too unless keep_text is false).
    """
    passed = [c for c in docs.columns if c not in ("score", "toxic_spans") and (keep_text or c != text)]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*passed).schema)
    source = docs.select(*passed, *([] if text in passed else [text]))
    return source.mapInArrow(_score(field, passed, text), fields + ", score double, toxic_spans array<struct<start: bigint, end: bigint, score: double>>")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned without the rows that are held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")), keep_text=False)
    held = F.coalesce(F.expr("crc32(cast(doc_id as string)) % 5 = 0"), F.lit(False))
    spans = F.array_join(F.transform("toxic_spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("toxic_spans").alias("n_spans"), spans.alias("spans"))
