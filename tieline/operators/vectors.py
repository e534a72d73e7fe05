"""TF-IDF vectors in long form, sparse and dense top-k search."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, K_DEEP, TIE_RATIO, ABSENT, RRF = 10, 100, 0.9, 128, 60
#: Anchors and targets that one task compares: blocks of this many rows of a country, by id hash.
ANCHOR_BLOCK, TARGET_BLOCK = 20_000, 5_000
#: Scores that a task holds at once.
PRODUCTS = 2_000_000


@dataclass
class Idf:
    """(feature, df, idf, pruned), the number of documents and the median idf (of unseen features)."""

    table: DataFrame
    documents: int
    median: float


def fit_idf(bag: DataFrame, documents: int, max_df_frac: float = 0.003) -> Idf:
    """ln((n + 1) / (df + 1)) + 1 of each feature; features in more than ``max_df_frac`` of the documents are pruned from indexes.

    A bag with a column ``n`` stands for so many documents.
    """
    df = bag.groupBy("feature").agg((F.sum("n") if "n" in bag.columns else F.count("*")).alias("df"))
    n = F.lit(float(documents))
    table = df.select("feature", "df", (F.log((n + 1) / (F.col("df") + 1)) + 1).alias("idf"), (F.col("df") > max_df_frac * n).alias("pruned"))
    median = table.agg(F.median("idf")).first()[0]
    return Idf(table, documents, float(median if median is not None else 1.0))


def weigh(bag: DataFrame, idf: Idf, keys: tuple[str, ...] = ("entity_id", "country")) -> DataFrame:
    """(keys, feature, w, pruned): damped term weight times idf, of unit length over each record."""
    tf = F.when(F.col("tf") > 1, 1 + F.log("tf")).otherwise(F.col("tf"))
    raw = bag.join(idf.table.select("feature", "idf", "pruned"), "feature", "left")
    raw = raw.select(*keys, "feature", (tf * F.coalesce("idf", F.lit(idf.median))).alias("v"), F.coalesce("pruned", F.lit(False)).alias("pruned"))
    norms = raw.groupBy(*keys).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    return raw.join(norms, list(keys)).select(*keys, "feature", (F.col("v") / F.when(F.col("norm") == 0, 1.0).otherwise(F.col("norm"))).alias("w"), "pruned")


def ranked(scores: DataFrame, k: int, score: str = "score") -> DataFrame:
    """The k best anchors of each target, ranks from 0, ties to the smaller id (scores are compared at nine digits)."""
    order = Window.partitionBy("tgt_id").orderBy(F.round(score, 9).desc(), "s1_id")
    return scores.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < k)


def _blocked(targets: DataFrame, anchors: DataFrame, run: Callable, k: int, anchor_block: int, target_block: int) -> DataFrame:
    """Top k of each target over a grid of (country, target block, anchor block) tasks.

    Both sides are dealt to blocks by id hash, as many as the larger country needs; a task sees one block of each and hands
    on its own k best of each target, so what is shuffled after it is k rows a target and anchor block, never all pairs.
    """
    def blocks(rows: DataFrame, size: int) -> int:
        most = rows.groupBy("country").agg(F.count_distinct("entity_id").alias("n")).agg(F.max("n")).first()[0] or 0
        return max(1, -(-most // size))

    nt, na = blocks(targets, target_block), blocks(anchors, anchor_block)
    own = lambda n: F.pmod(F.xxhash64("entity_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    anchors = anchors.select(*[F.col(c).alias(c) for c in anchors.columns])  # columns of its own, should both be one table
    q = targets.withColumn("_t", own(nt)).withColumn("_a", every(na)).groupBy("country", "_t", "_a")
    s = anchors.withColumn("_a", own(na)).withColumn("_t", every(nt)).groupBy("country", "_t", "_a")
    best = q.cogroup(s).applyInPandas(run, "tgt_id string, s1_id string, score double")
    return ranked(best, k)


def _closest(targets: np.ndarray, anchors: np.ndarray, scores: np.ndarray, k: int) -> pd.DataFrame:
    """The k best of each target among flat (target, anchor, score) rows, ties to the smaller anchor id."""
    order = np.lexsort((anchors, -np.round(scores, 9), targets))
    t = targets[order]
    first = np.flatnonzero(np.append(True, t[1:] != t[:-1])) if len(t) else np.zeros(0, np.int64)
    place = np.arange(len(t)) - np.repeat(first, np.diff(np.append(first, len(t))))
    kept = order[place < k]
    return pd.DataFrame({"tgt_id": targets[kept], "s1_id": anchors[kept], "score": scores[kept]})


def _best(targets: np.ndarray, anchors: np.ndarray, scores: np.ndarray, k: int, positive: bool = False) -> pd.DataFrame:
    """The k best anchors of each row of a score matrix; with ``positive`` only those above 0."""
    able = scores > 0 if positive else np.ones(scores.shape, bool)
    if scores.shape[1] > k:  # ties with the k-th score stay, so that the smaller id can win
        shown = np.round(scores, 9)
        able &= shown >= np.partition(shown, -k, axis=1)[:, [-k]]
    row, col = np.nonzero(able)
    return _closest(targets[row], anchors[col], scores[row, col], k)


def _typed(parts: list[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(parts, ignore_index=True).astype({"tgt_id": object, "s1_id": object, "score": "float64"})


def _sparse_task(k: int):
    def run(q: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"tgt_id": [], "s1_id": [], "score": []})]
        if len(q) and len(s):
            s = s.sort_values("feature")
            names, first = np.unique(s.feature.to_numpy(str), return_index=True)
            ends = np.append(first[1:], len(s))
            ids, anchor = np.unique(s.entity_id.to_numpy(str), return_inverse=True)
            ws = s.w.to_numpy()
            q = q[q.feature.isin(names)]
            at = np.searchsorted(names, q.feature.to_numpy(str))
            tgt, row = np.unique(q.entity_id.to_numpy(str), return_inverse=True)
            order = np.argsort(row, kind="stable")
            row, at, wt = row[order], at[order], q.w.to_numpy()[order]
            many = ends[at] - first[at]
            step = max(1, PRODUCTS // len(ids))
            for lo in range(0, len(tgt), step):  # whole targets; their scores with all anchors of the block, as a matrix
                part = slice(*np.searchsorted(row, [lo, lo + step]))
                m = many[part]
                post = np.repeat(first[at[part]], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                cell = np.repeat((row[part] - lo) * len(ids), m) + anchor[post]
                rows = min(step, len(tgt) - lo)
                scores = np.bincount(cell, np.repeat(wt[part], m) * ws[post], rows * len(ids)).reshape(rows, len(ids))
                out.append(_best(tgt[lo: lo + rows], ids, scores, k, positive=True))
        return _typed(out)

    return run


def sparse_search(targets: DataFrame, anchors: DataFrame, k: int = K_DEEP, anchor_block: int = ANCHOR_BLOCK, target_block: int = TARGET_BLOCK) -> DataFrame:
    """(tgt_id, s1_id, score, rank): cosine over unpruned features within a country, exact, block by block.

    A task holds the scores of a portion of its targets with all anchors of its block.
    """
    slim = lambda rows: rows.where("not pruned and country is not null").select("country", "entity_id", "feature", "w")
    return _blocked(slim(targets), slim(anchors), _sparse_task(k), k, anchor_block, target_block)


def adaptive(hits: DataFrame, deep_ids: DataFrame, k: int = K, tie_ratio: float = TIE_RATIO) -> DataFrame:
    """Keep k ranks, or all of them for targets in ``deep_ids`` (the other field is empty) and for tied ones.

    A target is tied if its k-th score is there, above 0 and within ``tie_ratio`` of its best.
    """
    per = Window.partitionBy("tgt_id")
    top = F.max(F.when(F.col("rank") == 0, F.col("score"))).over(per)
    last = F.max(F.when(F.col("rank") == k - 1, F.col("score"))).over(per)
    tied = F.coalesce((top > 0) & (last > 0) & (last >= tie_ratio * top), F.lit(False))
    flagged = hits.withColumn("_tied", tied).join(deep_ids.select("tgt_id").distinct().withColumn("_deep", F.lit(True)), "tgt_id", "left")
    return flagged.withColumn("deep", F.col("_tied") | F.coalesce("_deep", F.lit(False))).where((F.col("rank") < k) | F.col("deep")).drop("_tied", "_deep")


def union_channels(channels: dict[str, DataFrame]) -> DataFrame:
    """(tgt_id, s1_id, rank_<channel>.., n_channels, rrf): each pair once; ABSENT for channels without it."""
    rows = None
    for name, hits in channels.items():
        part = hits.select("tgt_id", "s1_id", F.lit(name).alias("channel"), "rank")
        rows = part if rows is None else rows.unionByName(part)
    ranks = [F.coalesce(F.min(F.when(F.col("channel") == c, F.col("rank"))), F.lit(ABSENT)).alias(f"rank_{c}") for c in channels]
    return rows.groupBy("tgt_id", "s1_id").agg(*ranks, F.count("*").alias("n_channels"), F.sum(1.0 / (RRF + F.col("rank"))).alias("rrf"))


def true_rank(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """(tgt_id, true_rank): how many candidates have a strictly higher fused score than the true anchor (null: not there)."""
    mine = pairs.join(truth, ["tgt_id", "s1_id"]).select("tgt_id", F.col("rrf").alias("true_rrf"))
    above = pairs.join(mine, "tgt_id").groupBy("tgt_id").agg(F.count_if(F.round("rrf", 12) > F.round("true_rrf", 12)).alias("true_rank"))
    return truth.select("tgt_id").join(above, "tgt_id", "left")


def pair_cosine(pairs: DataFrame, targets: DataFrame, anchors: DataFrame, name: str, asked: DataFrame | None = None) -> DataFrame:
    """``pairs`` with the exact cosine of both sides (pruned features too), 0 without common features.

    The cosines are made for ``asked``, a table of the same pairs that costs less to read than ``pairs``, if it is given.
    """
    t = targets.select(F.col("entity_id").alias("tgt_id"), "feature", F.col("w").alias("wt"))
    s = anchors.select(F.col("entity_id").alias("s1_id"), "feature", F.col("w").alias("ws"))
    dots = (pairs if asked is None else asked).select("tgt_id", "s1_id").join(t, "tgt_id").join(s, ["s1_id", "feature"]).groupBy("tgt_id", "s1_id").agg(F.sum(F.col("wt") * F.col("ws")).alias(name))
    return pairs.join(dots, ["tgt_id", "s1_id"], "left").withColumn(name, F.coalesce(name, F.lit(0.0)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def _dense_task(k: int):
    def run(q: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"tgt_id": [], "s1_id": [], "score": []})]
        if len(q) and len(s):
            ids, vs = s.entity_id.to_numpy(str), np.stack(s.vec.to_numpy()).astype(np.float64)
            tgt, vt = q.entity_id.to_numpy(str), np.stack(q.vec.to_numpy()).astype(np.float64)
            step = max(1, PRODUCTS // len(ids))
            for lo in range(0, len(tgt), step):
                out.append(_best(tgt[lo: lo + step], ids, vt[lo: lo + step] @ vs.T, k))
        return _typed(out)

    return run


def dense_search(targets: DataFrame, anchors: DataFrame, k: int = K, anchor_block: int = ANCHOR_BLOCK, target_block: int = TARGET_BLOCK) -> DataFrame:
    """Exact inner-product search within a country over ``vec`` columns, as matrix products of blocks."""
    slim = lambda rows: rows.where("country is not null").select("country", "entity_id", "vec")
    return _blocked(slim(targets), slim(anchors), _dense_task(k), k, anchor_block, target_block)


#: Vectors that the cells of an index are fitted on, at most: those that come first by the hash of their id.
INDEX_SAMPLE = 50_000


@dataclass
class CellIndex:
    """Cells of unit vectors around centres, for approximate search."""

    centres: np.ndarray

    @classmethod
    def fit(cls, vectors: DataFrame, cells: int, rounds: int = 8, sample: int = INDEX_SAMPLE) -> "CellIndex":
        """Spherical k-means on a bounded sample; every vector is indexed later."""
        rows = vectors.orderBy(F.md5("entity_id"), "entity_id").limit(sample).select("vec").collect()
        x = np.array([r["vec"] for r in rows], np.float32).reshape(len(rows), -1)
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        centres = x[:: max(1, len(x) // max(1, cells))][:cells].copy()
        for _ in range(rounds if len(x) else 0):
            near = (x @ centres.T).argmax(axis=1)
            for c in range(len(centres)):
                if (near == c).any():
                    centres[c] = x[near == c].mean(axis=0)
            centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
        return cls(centres)

    def cells(self, vec: Column, most: int) -> Column:
        """The ``most`` nearest cells of a vector."""
        centres = self.centres

        def run(vs: pd.Series) -> pd.Series:
            if not len(vs):
                return pd.Series([], dtype=object)
            scores = np.stack(vs.to_numpy()).astype(np.float32) @ centres.T
            return pd.Series(list(np.argsort(-scores, axis=1, kind="stable")[:, :most].astype(np.int32)))

        return F.pandas_udf(run, "array<int>")(vec)


def cell_search(targets: DataFrame, anchors: DataFrame, index: CellIndex, k: int = K, probes: int = 8) -> DataFrame:
    """Approximate inner-product search: every anchor lies in its nearest cell, a target looks into its ``probes`` nearest.

    A cell of a country is searched exactly, in blocks, so a crowded cell is dealt out like a crowded country.
    """
    cell = lambda c: F.concat_ws("\x1f", F.col("country"), c.cast("string"))
    s = anchors.select("country", "entity_id", "vec", index.cells(F.col("vec"), 1)[0].alias("_c"))
    q = targets.select("country", "entity_id", "vec", F.explode(index.cells(F.col("vec"), probes)).alias("_c"))
    found = dense_search(q.select(cell(F.col("_c")).alias("country"), "entity_id", "vec"), s.select(cell(F.col("_c")).alias("country"), "entity_id", "vec"), k)
    return ranked(found.select("tgt_id", "s1_id", "score"), k)


def hashed_embedding(weights: DataFrame, dims: int = 128, keys: tuple[str, ...] = ("entity_id", "country")) -> DataFrame:
    """(keys, vec): signed hashing of a weighted bag to ``dims`` dimensions, of unit length."""
    h = F.conv(F.substring(F.md5("feature"), 1, 8), 16, 10).cast("long")
    part = weights.select(*keys, F.pmod(h, F.lit(dims)).cast("int").alias("d"), (F.col("w") * F.when(F.pmod(F.shiftright(h, 20), F.lit(2)) == 0, 1.0).otherwise(-1.0)).alias("x"))
    sums = part.groupBy(*keys, "d").agg(F.sum("x").alias("x"))
    norms = sums.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("d", "x"))).alias("m"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("n"))
    vec = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda d: (F.coalesce(F.try_element_at("m", d), F.lit(0.0)) / F.when(F.col("n") > 0, F.col("n")).otherwise(1.0)).cast("float"))
    return norms.select(*keys, vec.alias("vec"))
