"""The encoder channel: hashed bags to dense vectors, learned from links so that both sides of a link lie close."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tieline.sources import store

#: Links that one task learns from at a time. More links are dealt to more tasks, whose weights are averaged after each epoch.
BLOCK = 20_000
#: Rows of the table that one task averages.
PIECE = 1 << 10
SLOTS, DIMS, HIDDEN = 1 << 14, 64, 128


@dataclass
class Encoder:
    """A bag of embeddings, a residual layer, unit length."""

    table: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    NAMES = ("table", "w1", "b1", "w2", "b2")

    @classmethod
    def fresh(cls, slots: int = SLOTS, dims: int = DIMS, hidden: int = HIDDEN, seed: int = 42) -> "Encoder":
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[-1]), shape).astype(np.float32)
        return cls(draw(slots, dims), draw(dims, hidden), np.zeros(hidden, np.float32), 0.1 * draw(hidden, dims), np.zeros(dims, np.float32))

    def sums(self, slots: list[np.ndarray], weights: list[np.ndarray]) -> np.ndarray:
        """Weighted sum of each bag's embeddings."""
        out = np.zeros((len(slots), self.table.shape[1]), np.float32)
        for k, (s, w) in enumerate(zip(slots, weights)):
            if len(s):
                out[k] = w.astype(np.float32) @ self.table[s]
        return out

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hidden, output before scaling, unit vectors)."""
        h = np.maximum(x @ self.w1 + self.b1, 0)
        y = x + h @ self.w2 + self.b2
        return h, y, y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-9)

    def encode(self, slots: list[np.ndarray], weights: list[np.ndarray]) -> np.ndarray:
        """Unit vectors; an empty bag has the zero vector."""
        out = self.forward(self.sums(slots, weights))[2]
        out[[k for k, s in enumerate(slots) if not len(s)]] = 0
        return out

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(n, list(getattr(self, n).shape), getattr(self, n).ravel().tolist()) for n in self.NAMES]
        spark.createDataFrame(rows, "name string, shape array<int>, data array<float>").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Encoder":
        found = {r["name"]: np.array(r["data"], np.float32).reshape(r["shape"]) for r in spark.read.parquet(path).collect()}
        return cls(*(found[n] for n in cls.NAMES))


def contrast(a: np.ndarray, t: np.ndarray, temperature: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Symmetric cross entropy of finding each row's partner in the batch, and its gradients by both sides' unit vectors."""
    n = len(a)
    s = a @ t.T / temperature
    rows = np.exp(s - s.max(axis=1, keepdims=True))
    cols = np.exp(s - s.max(axis=0, keepdims=True))
    rows, cols = rows / rows.sum(axis=1, keepdims=True), cols / cols.sum(axis=0, keepdims=True)
    d = np.arange(n)
    loss = -(np.log(rows[d, d] + 1e-12) + np.log(cols[d, d] + 1e-12)).mean() / 2
    g = (rows + cols) / (2 * n)
    g[d, d] -= 1 / n
    return float(loss), g @ t / temperature, g.T @ a / temperature


def fresh_state(seed: int = 42, **shape) -> dict[str, np.ndarray]:
    """All that training carries along: weights, the table's summed squares, moments and steps of the rest."""
    model = Encoder.fresh(seed=seed, **shape)
    state = {n: getattr(model, n) for n in Encoder.NAMES} | {"spent": np.full(len(model.table), 1e-3, np.float32), "step": np.zeros(1, np.float32)}
    return state | {f"{m}_{n}": np.zeros_like(state[n]) for n in Encoder.NAMES[1:] for m in "mv"}


def train_encoder(bags: list[tuple[tuple, tuple]], groups: list[str], epochs: int = 3, batch: int = 512, temperature: float = 0.05, seed: int | tuple[int, ...] = 42, state: dict[str, np.ndarray] | None = None, **shape) -> tuple[Encoder, list[float]]:
    """(encoder, mean loss of each epoch) from links as ((slots, weights) of the anchor, of the target). A batch holds links of one group.

    A ``state`` is gone on from and changed in place.
    """
    state = fresh_state(seed, **shape) if state is None else state
    model, rng = Encoder(*(state[n] for n in Encoder.NAMES)), np.random.default_rng(seed)
    members: dict[str, list[int]] = {}
    for k, g in enumerate(groups):
        members.setdefault(g, []).append(k)
    spent, moments = state["spent"], {n: (state[f"m_{n}"], state[f"v_{n}"]) for n in Encoder.NAMES[1:]}
    losses, step = [], int(state["step"][0])
    for _ in range(epochs):
        batches = []
        for ids in members.values():
            order = rng.permutation(ids)
            batches += [order[k: k + batch] for k in range(0, len(order), batch) if len(order[k: k + batch]) > 1]
        seen = []
        for b in (batches[k] for k in rng.permutation(len(batches))):
            sides = [[bags[k][side] for k in b] for side in (0, 1)]
            x = [model.sums([s for s, _ in rows], [w for _, w in rows]) for rows in sides]
            made = [model.forward(v) for v in x]
            loss, *slopes = contrast(made[0][2], made[1][2], temperature)
            seen.append(loss)
            total = {n: 0.0 for n in Encoder.NAMES[1:]}
            step += 1
            for rows, v, (h, y, z), dz in zip(sides, x, made, slopes):
                dy = (dz - z * (z * dz).sum(axis=1, keepdims=True)) / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-9)
                dh = (dy @ model.w2.T) * (h > 0)
                for n, g in (("w2", h.T @ dy), ("b2", dy.sum(axis=0)), ("w1", v.T @ dh), ("b1", dh.sum(axis=0))):
                    total[n] = total[n] + g
                dx = dy + dh @ model.w1.T
                slots = np.concatenate([s for s, _ in rows])
                if len(slots):
                    owner = np.repeat(np.arange(len(rows)), [len(s) for s, _ in rows])
                    push = dx[owner] * np.concatenate([w for _, w in rows])[:, None].astype(np.float32)
                    hit, at = np.unique(slots, return_inverse=True)
                    grad = np.zeros((len(hit), dx.shape[1]), np.float32)
                    np.add.at(grad, at, push)
                    spent[hit] += (grad**2).mean(axis=1)
                    model.table[hit] -= 0.05 * grad / np.sqrt(spent[hit])[:, None]
            for n, g in total.items():  # Adam
                m = moments[n]
                m[0][...], m[1][...] = 0.9 * m[0] + 0.1 * g, 0.999 * m[1] + 0.001 * g**2
                getattr(model, n)[...] -= 1e-3 * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
        losses.append(float(np.mean(seen)) if seen else 0.0)
    state["step"][0] = step
    return model, losses


def hashed_bags(weights: DataFrame, slots: int = SLOTS, keys: tuple[str, ...] = ("entity_id", "country")) -> DataFrame:
    """(keys, slots, weights): each record's weighted features by crc32 slot, equal slots summed, in slot order."""
    slot = F.crc32(F.col("feature").cast("binary")).bitwiseAND(F.lit(slots - 1)).cast("int")
    summed = weights.groupBy(*keys, slot.alias("slot")).agg(F.sum("w").alias("w"))
    bag = F.array_sort(F.collect_list(F.struct("slot", "w")))  # at most a record's features
    return summed.groupBy(*keys).agg(bag.alias("b")).select(*keys, F.transform("b", lambda x: x["slot"]).alias("slots"), F.transform("b", lambda x: x["w"]).alias("weights"))


def _pieces(state: dict[str, np.ndarray]):
    """(name, first row, rows) of a state's arrays, at most PIECE rows each."""
    return ((n, at, x[at: at + PIECE]) for n, x in state.items() for at in range(0, len(x), PIECE))


def _averaged(rows: DataFrame, start: dict[str, np.ndarray], epoch: int, seed: int) -> dict[str, np.ndarray]:
    """One epoch over every block of links, each from ``start``, and the mean of what the blocks learned.

    A row of the table is averaged over the blocks that changed it, so that a rare feature learns as fast as a common one.
    """
    shared = rows.sparkSession.sparkContext.broadcast(start)

    def learn(key: tuple, links: pd.DataFrame) -> pd.DataFrame:
        links = links.sort_values(["tgt_id", "s1_id"])
        side = lambda s, w: [(np.asarray(x, np.int64), np.asarray(y)) for x, y in zip(links[s], links[w])]
        state = {n: x.copy() for n, x in shared.value.items()}
        train_encoder(list(zip(side("sa", "wa"), side("st", "wt"))), links.country.tolist(), 1, seed=(seed, epoch, int(key[0])), state=state)
        moved = np.flatnonzero((state["spent"] != shared.value["spent"]) | (state["table"] != shared.value["table"]).any(axis=1))
        out = []
        for n, at, x in _pieces(state):
            if n in ("table", "spent"):
                hit = moved[(moved >= at) & (moved < at + len(x))]
                out.append((n, at, hit.astype(np.int32).tobytes(), state[n][hit].tobytes()))
            else:
                out.append((n, at, np.arange(at, at + len(x), dtype=np.int32).tobytes(), x.tobytes()))
        return pd.DataFrame(out, columns=["name", "at", "rows", "data"])

    def mean(key: tuple, learned: pd.DataFrame) -> pd.DataFrame:
        name, at = key
        first = shared.value[name][at: at + PIECE]
        total, n = np.zeros(first.shape, np.float64), np.zeros(len(first), np.int64)
        for where, data in sorted(zip(learned["rows"], learned["data"])):
            hit = np.frombuffer(where, np.int32) - at
            total[hit] += np.frombuffer(data, np.float32).reshape(len(hit), *first.shape[1:])
            n[hit] += 1
        wide = n.reshape(-1, *[1] * (first.ndim - 1))
        out = np.where(wide > 0, total / np.maximum(wide, 1), first).astype(np.float32)
        return pd.DataFrame([(name, at, out.tobytes())], columns=["name", "at", "data"])

    made = rows.groupBy("_b").applyInPandas(learn, "name string, at int, rows binary, data binary").groupBy("name", "at").applyInPandas(mean, "name string, at int, data binary")
    state = {n: x.copy() for n, x in start.items()}
    for r in made.collect():  # the weights, whatever the number of links
        x = state[r["name"]][r["at"]: r["at"] + PIECE]
        x[...] = np.frombuffer(bytes(r["data"]), np.float32).reshape(x.shape)
    shared.destroy()
    return state


def learn_encoder(links: DataFrame, anchors: DataFrame, targets: DataFrame, epochs: int = 3, seed: int = 42, block: int = BLOCK) -> Encoder:
    """Learn from all ``links``; ``anchors`` and ``targets`` are hashed bags.

    The links stay with the executors, dealt by hash to blocks of some ``block`` links; only the weights reach the driver.
    """
    a = anchors.select(F.col("entity_id").alias("s1_id"), "country", F.col("slots").alias("sa"), F.col("weights").alias("wa"))
    t = targets.select(F.col("entity_id").alias("tgt_id"), F.col("slots").alias("st"), F.col("weights").alias("wt"))
    rows = links.select("s1_id", "tgt_id").join(a, "s1_id").join(t, "tgt_id")
    blocks = max(1, -(-links.count() // block))
    rows = store.written(rows.withColumn("_b", F.pmod(F.xxhash64("tgt_id", "s1_id"), F.lit(blocks)).cast("int")))
    state = fresh_state(seed)
    for epoch in range(epochs):
        state = _averaged(rows, state, epoch, seed)
    store.drop(rows)
    return Encoder(*(state[n] for n in Encoder.NAMES))


def encoded(bags: DataFrame, model: Encoder, keys: tuple[str, ...] = ("entity_id", "country")) -> DataFrame:
    """(keys, vec): unit vectors of hashed bags, in Arrow batches with the model's weights sent along once."""
    shared = bags.sparkSession.sparkContext.broadcast([getattr(model, n) for n in Encoder.NAMES])  # slots x dims floats

    def run(slots: pd.Series, weights: pd.Series) -> pd.Series:
        if not len(slots):
            return pd.Series([], dtype=object)
        return pd.Series(list(Encoder(*shared.value).encode([np.asarray(s, np.int64) for s in slots], [np.asarray(w) for w in weights])))

    return bags.select(*keys, F.pandas_udf(run, "array<float>")("slots", "weights").alias("vec"))
