"""Operator 7: near-duplicate documents by HyperMinHash sketches, banding, estimation and exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tieline.llm.common import NON_SPACE, as_long, cut, doc_chunks, drop, hashed_words, mix, shingle_set, small_side, sweep, table, text_buffers

SHINGLE = 5
#: Registers (buckets) per sketch: BANDS bands of ROWS registers. At a Jaccard of 0.75 a pair shares no band in 5 of 10^6 cases.
BANDS, ROWS = 45, 5
REGISTERS = BANDS * ROWS
#: A register keeps 4 bits for leading zeros and 8 for the mantissa after the first one-bit.
ZERO_CAP, MANTISSA = 15, 8
#: Pairs estimated below this are not verified. The estimate's deviation is 0.03 at 0.75, so this is five of them away.
ESTIMATE_FLOOR = 0.6
#: Bits of a set's parity bitmap: each shingle flips one, so two bitmaps differ in no more bits than the sets in shingles.
#: An exact bound: it drops most pairs that the estimate cannot tell from linked ones, and never a linked one.
PARITY = 2048
#: Members of a bucket that one task compares with as many others; larger buckets are dealt out as pairs of blocks.
BLOCK = 4096
#: Bytes of a shingle's hash that travel for verification.
SHINGLE_BYTES = 6
#: Partners that one row of a verification list names.
LIST = 64

_U = np.uint64
_XOR = mix(np.arange(1, REGISTERS + 1, dtype=np.uint64) * _U(0xA24BAED4963EE407))
_WIDE = mix(np.arange(1, ROWS + 2, dtype=np.uint64) * _U(0xC2B2AE3D27D4EB4F)) | _U(1)
#: _NEXT[j, k]: in which order bucket j, if empty, looks for a filled bucket k to borrow from (the smallest wins).
_NEXT = mix(np.arange(REGISTERS, dtype=np.uint64)[:, None] * _U(0x9FB21C651E98DF25) + mix(np.arange(REGISTERS, dtype=np.uint64) + _U(77))[None, :])
EMPTY = np.iinfo(np.uint64).max


def registers(minima: np.ndarray) -> np.ndarray:
    """12-bit registers of 64-bit minima: min(leading zeros, 15) * 256 + the 8 bits after the leading one."""
    x = minima.copy()
    zeros = np.zeros(x.shape, np.uint64)
    for step in (8, 4, 2, 1):
        clear = (x >> _U(64 - step)) == 0
        zeros += clear * _U(step)
        x = np.where(clear, x << _U(step), x)
    mantissa = (x >> _U(63 - MANTISSA)) & _U((1 << MANTISSA) - 1)
    return (zeros * _U(1 << MANTISSA) + mantissa).astype(np.uint16)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """HyperMinHash registers, one row for each set: the minimum of each bucket of one hash, kept as leading zeros and mantissa.

    A bucket without a shingle borrows the minimum of a filled one, the first in an order of its own, hashed anew. Two sets
    then agree in a register with a chance of their Jaccard similarity, however small they are. An empty set's row is 0.
    """
    size = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    h = mix(flat ^ _U(0x5851F42D4C957F2D))
    bucket = (((h >> _U(32)) * _U(REGISTERS)) >> _U(32)).astype(np.int64)
    low = np.full(len(sets) * REGISTERS, EMPTY, np.uint64)
    np.minimum.at(low, np.repeat(np.arange(len(sets)) * REGISTERS, size) + bucket, mix(h))
    low = low.reshape(len(sets), REGISTERS)
    filled = low != EMPTY
    for k in np.flatnonzero((size > 0) & ~filled.all(axis=1)):
        to, of = np.flatnonzero(~filled[k]), np.flatnonzero(filled[k])
        low[k, to] = mix(low[k, of[_NEXT[np.ix_(to, of)].argmin(axis=1)]] ^ _XOR[to])
    out = registers(low)
    out[size == 0] = 0
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    """64-bit keys of the bands of each row of registers."""
    v = regs.reshape(-1, BANDS, ROWS).astype(np.uint64) + _U(1)
    return mix((v * _WIDE[:ROWS]).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * _WIDE[ROWS])


def parities(sets: list[np.ndarray]) -> np.ndarray:
    """The parity bitmap of each set, a row of 64-bit words."""
    size = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    bit = (mix(flat ^ _U(0x3C79AC492BA7B653)) & _U(PARITY - 1)).astype(np.int64)
    flips = np.bincount(np.repeat(np.arange(len(sets)) * PARITY, size) + bit, minlength=len(sets) * PARITY)
    return np.packbits((flips & 1).astype(np.uint8).reshape(len(sets), PARITY), axis=1).view(np.uint64)


def packed(regs: np.ndarray, parity: np.ndarray) -> list[bytes]:
    """Each row: its parity bitmap, then its registers in 12 bits each: the mantissas, then the leading zeros two to a byte."""
    zeros = np.zeros((len(regs), REGISTERS + 1), np.uint8)
    zeros[:, :REGISTERS] = regs >> MANTISSA
    body = np.concatenate([parity.view(np.uint8), (regs & 255).astype(np.uint8), zeros[:, ::2] << 4 | zeros[:, 1::2]], axis=1)
    return [r.tobytes() for r in body]


def unpacked(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(registers, parity bitmaps) of packed rows."""
    whole = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1)
    parity, body = np.ascontiguousarray(whole[:, : PARITY // 8]).view(np.uint64), whole[:, PARITY // 8:]
    zeros = np.empty((len(rows), REGISTERS + 1), np.uint16)
    zeros[:, ::2], zeros[:, 1::2] = body[:, REGISTERS:] >> 4, body[:, REGISTERS:] & 15
    return zeros[:, :REGISTERS] << MANTISSA | body[:, :REGISTERS], parity


def near_enough(p: np.ndarray, q: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Do the bitmaps allow a similarity of 0.75? Then the sets differ in a seventh of n + m shingles at most."""
    return 7 * np.bitwise_count(p ^ q).sum(axis=1, dtype=np.int64) <= n + m


def equal_registers(rows: np.ndarray, one: np.ndarray) -> np.ndarray:
    """How many registers of each row equal those of ``one``: bytes are summed eight lanes at a time (REGISTERS < 256)."""
    same = np.zeros((len(rows), (REGISTERS + 7) // 8 * 8), bool)
    np.equal(rows, one, out=same[:, :REGISTERS])
    lanes = same.view(np.uint64).sum(axis=1, dtype=np.uint64)
    return (lanes * _U(0x0101010101010101)) >> _U(56)


# Chance that registers of two disjoint sets agree: both minima fall in the same cell. Cells by register value.
_ZERO, _PART = np.arange(16 << MANTISSA) >> MANTISSA, (np.arange(16 << MANTISSA) & 255) / 256
_LOW = np.where(_ZERO < ZERO_CAP, 2.0 ** -(_ZERO + 1) * (1 + _PART), 2.0**-16 * (1 + _PART))
_HIGH = np.where(_ZERO < ZERO_CAP, 2.0 ** -(_ZERO + 1) * (1 + _PART + 1 / 256), 2.0**-16 * (1 + _PART + 1 / 256))
_cells: dict[int, np.ndarray] = {}


def _cell(n: float) -> np.ndarray:
    """Chance of each register value for a set of n, by sixteenths of n's power of two."""
    step = round(16 * np.log2(max(n / REGISTERS, 1.0)))
    if step not in _cells:
        k = 2.0 ** (step / 16)
        _cells[step] = (1 - _LOW) ** k - (1 - _HIGH) ** k
    return _cells[step]


def accident(n: float, m: float) -> float:
    """Chance of equal registers without a common minimum, for sets of n and m."""
    return float(_cell(n) @ _cell(m))


def estimate(share: float, n: int, m: int) -> float:
    """Jaccard similarity from the share of equal registers, corrected for accidental agreement."""
    c = accident(n, m)
    return max(0.0, (share - c) / (1 - c))


# ---------------------------------------------------------------- Spark

_SKETCH = "doc_id long, n_shingles long, sig_a long, sig_b long, regs binary"


def _sets(batch: pa.RecordBatch, text: str, width: int) -> Iterator[np.ndarray]:
    """The shingle set of each row of a batch, in order."""
    raw, offsets = text_buffers(batch.column(text))
    for i, j in doc_chunks(offsets):
        at = offsets[i: j + 1] - offsets[i]
        words, begin = hashed_words(raw[offsets[i]: offsets[j]], at, NON_SPACE)
        for k in range(j - i):
            yield shingle_set(words[begin[k]: begin[k + 1]], width)


def _sketches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, a, b, regs = [], [], [], []
            pending: list[np.ndarray] = []

            def flush() -> None:
                if pending:
                    regs.extend(packed(sketches(pending), parities(pending)))
                    pending.clear()

            held = 0
            for s in _sets(batch, "text", width):
                n.append(len(s))
                a.append(int(as_long(mix(s).sum(keepdims=True, dtype=np.uint64))[0]))
                b.append(int(as_long(mix(s ^ _U(0x1234567)).sum(keepdims=True, dtype=np.uint64))[0]))
                pending.append(s)
                held += len(s) + REGISTERS
                if held > 1 << 19:
                    flush()
                    held = 0
            flush()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(regs, pa.binary())],
                names=["doc_id", "n_shingles", "sig_a", "sig_b", "regs"],
            )

    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, rep, sig_a): a row for each band of each sketch (rep, sig_a, regs)."""
    for batch in batches:
        keys = as_long(band_keys(unpacked(batch.column("regs").to_pylist())[0])) if batch.num_rows else np.zeros((0, BANDS), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), *[pa.array(np.repeat(batch.column(c).to_numpy(), BANDS)) for c in ("rep", "sig_a")]], names=["key", "rep", "sig_a"])


def _set_bytes(s: np.ndarray) -> bytes:
    return np.unique(s & _U((1 << 8 * SHINGLE_BYTES) - 1)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SHINGLE_BYTES].tobytes()


def _set_of(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // SHINGLE_BYTES, 8), np.uint8)
    out[:, :SHINGLE_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, SHINGLE_BYTES)
    return out.view("<u8")[:, 0]


#: Bytes of shingle sets in one Arrow batch.
SET_BATCH = 8 << 20


def _full_sets(width: int, listed: bool):
    """(a, x) for each text, or with ``listed`` (a, b, y) for each partner that its list names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            lists = batch.column("partners").to_pylist() if listed else None
            a, b, out, held = [], [], [], 0

            def flushed() -> pa.RecordBatch:
                if listed:
                    made = pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(out, pa.binary())], names=["a", "b", "y"])
                else:
                    made = pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(out, pa.binary())], names=["a", "x"])
                a.clear(), b.clear(), out.clear()
                return made

            for k, s in enumerate(_sets(batch, "text", width)):
                body = _set_bytes(s)
                for partner in lists[k] if listed else (ids[k],):
                    a.append(partner)
                    b.append(ids[k])
                    out.append(body)
                    held += len(body)
                    if held > SET_BATCH:
                        yield flushed()
                        held = 0
            yield flushed()

    return run


def _estimates(*columns: str):
    """Estimated similarity of two packed rows with their sizes; 0 if their bitmaps rule a link out."""
    def run(a: pd.Series, n: pd.Series, b: pd.Series, m: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype="float64")
        (x, p), (y, q) = unpacked(list(a)), unpacked(list(b))
        found = np.array([estimate(*x) for x in zip((x == y).mean(axis=1), n, m)])
        return pd.Series(np.where(near_enough(p, q, n.to_numpy(), m.to_numpy()), found, 0.0))

    return F.pandas_udf(run, "double")(*columns)


def _links(percent: int):
    def verify(a: pd.Series, b: pd.Series) -> pd.Series:
        out, last, s = [], None, None
        for x, y in zip(a, b):
            if x != last:
                s, last = _set_of(x), x
            t = _set_of(y)
            both = len(np.intersect1d(s, t, assume_unique=True))
            out.append(100 * both >= percent * (len(s) + len(t) - both))
        return pd.Series(out, dtype="bool")

    return F.pandas_udf(verify, "boolean")


#: Links up to which components are found on the driver (a few MB) instead of by a handful of small jobs a round.
FEW_LINKS = 20_000


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links(a, b)``: root is the smallest node of its component.

    Beyond FEW_LINKS every round hooks each node onto its smallest neighbour, follows that pointer once, and contracts the links; a
    star vanishes in one round. Links and labels stay in Spark; each round is cut, and the tables of the last one dropped.
    """
    edges = cut(links.select("a", "b").where("a <> b").distinct())
    if edges.count() <= FEW_LINKS:
        root: dict[int, int] = {}

        def found(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x

        for r in edges.collect():
            lo, hi = sorted((found(r["a"]), found(r["b"])))
            root[hi] = lo
        drop(edges)
        return cut(links.sparkSession.createDataFrame([(x, found(x)) for x in list(root)], "node long, root long"))
    nodes = cut(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().select("node", F.col("node").alias("root")))
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("to"))
        jump = hook.alias("h").join(hook.select(F.col("id").alias("to"), F.col("to").alias("next")), "to", "left").select("id", F.coalesce("next", "to").alias("to"))
        jump = cut(jump)
        old, nodes = nodes, cut(nodes.join(jump.withColumnRenamed("id", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root")))
        moved = edges.join(jump.select(F.col("id").alias("a"), F.col("to").alias("x")), "a").join(jump.select(F.col("id").alias("b"), F.col("to").alias("y")), "b")
        past, edges = edges, cut(moved.select(F.col("x").alias("a"), F.col("y").alias("b")).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        drop(old, past, jump)
    drop(edges)
    return nodes


def compare(key: int, left: dict, right: dict, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, short): pairs of one bucket (or of two blocks of it) in different components whose corrected estimate reaches
    the floor, and the left rows that do not name all of their partners.

    With ``most``, left rows name all partners until that makes ``most`` pairs for each row of both sides, then only their
    ``most`` closest ones; 0 names all. A pair that shares several buckets is named in the first of them only. Sides hold
    rep, root, n, registers and parity bitmaps (rows).
    """
    out_a, out_b, short = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
    named, bound = 0, most * (len(left["rep"]) + len(right["rep"]))
    here = int(np.flatnonzero(as_long(band_keys(left["regs"][:1]))[0] == key)[0])
    for rep, root, n, regs, parity in zip(left["rep"], left["root"], left["n"], left["regs"], left["parity"]):
        able = np.flatnonzero((right["root"] != root) & (4 * np.minimum(n, right["n"]) >= 3 * np.maximum(n, right["n"])))
        share = equal_registers(right["regs"][able], regs) / REGISTERS
        able, share = able[share >= ESTIMATE_FLOOR], share[share >= ESTIMATE_FLOOR]
        close = near_enough(right["parity"][able], parity, right["n"][able], n)
        able, share = able[close], share[close]
        if len(able):
            same = (right["regs"][able] == regs).reshape(-1, BANDS, ROWS).all(axis=2)
            good = (same.argmax(axis=1) == here) & (np.array([estimate(s, n, m) for s, m in zip(share, right["n"][able])]) >= ESTIMATE_FLOOR)
            able, share = able[good], share[good]
            if most and len(able) > most and named + len(able) > bound:
                able = able[np.argsort(-share, kind="stable")[:most]]
                short.append(rep)
            named += len(able)
            out_a.append(np.full(len(able), rep, np.int64))
            out_b.append(right["rep"][able])
    return np.concatenate(out_a), np.concatenate(out_b), np.array(short, np.int64)


def _compared(most: int):
    """``compare`` over rows sorted by (key, i, j): groups are taken one after another, whatever batches they come in.

    Rows (a, b, null) are pairs; (a, null, key) is a left row that did not name all of its partners in that bucket.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def settle(t: pa.Table, last: bool) -> tuple[pa.RecordBatch, pa.Table | None]:
            ids = np.column_stack([t.column(c).to_numpy() for c in ("key", "i", "j")])
            starts = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]).any(axis=1)))
            ends = np.append(starts[1:], len(ids))
            whole = len(starts) if last else len(starts) - 1
            out_a, out_b, short, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            upto = int(ends[whole - 1]) if whole else 0
            if upto:
                regs, parity = unpacked(t.column("regs").slice(0, upto).to_pylist())
                side, rep, root, n = (t.column(c).to_numpy()[:upto] for c in ("side", "rep", "root", "n_shingles"))
                for s, e in zip(starts[:whole], ends[:whole]):
                    parts = [{"rep": rep[s:e][m], "root": root[s:e][m], "n": n[s:e][m], "regs": regs[s:e][m], "parity": parity[s:e][m]} for m in (side[s:e] == 0, side[s:e] == 1)]
                    if len(parts[0]["rep"]) and len(parts[1]["rep"]):
                        a, b, left = compare(int(ids[s, 0]), *parts, most)
                        out_a.append(np.minimum(a, b))
                        out_b.append(np.maximum(a, b))
                        short.append(left)
                        at.append(np.full(len(left), ids[s, 0], np.int64))
            a, b, left, key = (pa.array(np.concatenate(x)) for x in (out_a, out_b, short, at))
            none = lambda many: pa.nulls(many, pa.int64())
            rows = [pa.concat_arrays(x) for x in ((a, left), (b, none(len(left))), (none(len(a)), key))]
            return pa.RecordBatch.from_arrays(rows, names=["a", "b", "key"]), t.slice(upto).combine_chunks() if upto < len(ids) else None

        for batch in batches:
            if batch.num_rows:
                rest = pa.concat_tables([rest, pa.Table.from_batches([batch])]) if rest is not None else pa.Table.from_batches([batch])
                if rest.num_rows > BLOCK or rest.column("key")[0].as_py() != rest.column("key")[-1].as_py():
                    made, rest = settle(rest, False)
                    yield made
        if rest is not None:
            yield settle(rest, True)[0]

    return run


#: Rounds in which each text outside its bucket's main component names its closest partners, before all are named.
ROUNDS, CLOSEST = 4, 3


def near_duplicates(docs: DataFrame, percent: int = 75, width: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs(doc_id, text)``.

    A-Z are lower-cased; words are runs of anything but ASCII white space; a text's set holds its distinct shingles
    of ``width`` words, a shorter text is one shingle, a text without words (null, empty) has the empty set and is
    linked with nothing. Texts are linked when 100 * |A and B| >= percent * |A or B| (percent 75 or more), confirmed
    on the full sets; component_id is the smallest doc_id reachable. Rows with the same doc_id are one document: its
    links are those of all its texts, and each row is returned. Rows without a doc_id (null) take part in no link:
    component null, kept true. Other columns are ignored; an empty table gives an empty result.

    Equal sets fall together by a 128-bit digest before any sketch is compared, so a group of exact copies costs one
    representative. Representatives meet in band buckets; each bucket has a centre. First each text is compared with the
    centre that most of its buckets have, then with the other centres that are not yet in its component (linear however
    large a bucket is). Then, in buckets that still hold several components, members outside the first one's component
    are compared with all others by estimate, block by block, and what passes is confirmed on the full sets; if a bucket
    has too many such pairs, its members name their closest ones first, and those that left some out go again. Sets under 3
    shingles can only be equal. No link between different components is lost but for the chance that a linked pair
    shares no band (5 in 10^6 at exactly 0.75) or is estimated below ESTIMATE_FLOOR (5 deviations). Parity bitmaps bound
    how far two sets differ, exactly; pairs that they rule out are never verified.
    """
    if percent < 75:
        raise ValueError("bands and the least set size are laid out for a similarity of 0.75 or more")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    wide = cut(rows.mapInArrow(_sketches(width), _SKETCH))
    digest = ["sig_a", "sig_b", "n_shingles"]
    made = cut(wide.select("doc_id", *digest))
    named = made.where("doc_id is not null and n_shingles > 0")
    reps = cut(named.groupBy(*digest).agg(F.min("doc_id").alias("rep")))
    member = cut(named.join(reps, digest).select("doc_id", "sig_a", "rep"))
    several = member.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a < z").select("doc_id", "a")
    same_doc = cut(member.join(several, "doc_id").select("a", F.col("rep").alias("b")))
    copies = cut(member.where("doc_id <> rep").select("doc_id", "sig_a").distinct())
    drop(member)

    # A document with several texts can stand for more than one of them: a sketch is known by its id and half of its digest.
    single = wide.where("doc_id is not null and n_shingles > 2").join(small_side(copies), ["doc_id", "sig_a"], "left_anti").withColumnRenamed("doc_id", "rep")
    keyed = single.select("rep", "sig_a", "regs").mapInArrow(_keys, "key long, rep long, sig_a long")
    # Dealt by key once: there equal rows (of a repeated document) fall together and members are counted.
    once = keyed.repartition("key").dropDuplicates(["key", "rep", "sig_a"])
    met = cut(once.withColumn("size", F.count("*").over(Window.partitionBy("key"))).where("size > 1"))
    # Only sketches of texts that share a bucket are kept; most texts share none.
    meeting = cut(met.select("rep", "sig_a").distinct())
    first = single.select("rep", "sig_a", "n_shingles", "regs").join(small_side(meeting), ["rep", "sig_a"], "left_semi")
    first = cut(first.dropDuplicates(["rep", "sig_a"]))
    drop(wide, copies, meeting)
    # A bucket's centre is the member that meets most others over all bands: the text that a group's copies stem from.
    degree = met.groupBy("rep").agg(F.sum("size").alias("degree"))
    centre = met.join(degree, "rep").groupBy("key").agg(F.max(F.struct("degree", (-F.col("rep")).alias("least"))).alias("c"))
    buckets = cut(met.join(centre.select("key", (-F.col("c.least")).alias("first")), "key"))
    drop(met)
    sketch = first.select("rep", "n_shingles", "regs")

    def likely(pairs: DataFrame) -> DataFrame:
        """Those of pairs (a, b) whose sizes and corrected estimate allow a link."""
        x, y = (sketch.select(F.col("rep").alias(c), F.col("n_shingles").alias(f"n{c}"), F.col("regs").alias(f"r{c}")) for c in "ab")
        met_by_size = cut(pairs.join(x.drop("ra"), "a").join(y.drop("rb"), "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select("a", "b"))
        out = cut(met_by_size.join(y, "b").join(x, "a").where(_estimates("ra", "na", "rb", "nb") >= ESTIMATE_FLOOR).select("a", "b").distinct())
        drop(met_by_size)
        return out

    def confirm(pairs: DataFrame) -> DataFrame:
        """The links among pairs (a, b) of documents, by their full sets: b's set is sent to each partner's once."""
        many = pairs.groupBy("b").agg(F.ceil(F.count("*") / LIST).cast("int").alias("parts"))
        lists = cut(pairs.join(many, "b").groupBy("b", F.pmod(F.xxhash64("a"), F.col("parts")).alias("part")).agg(F.collect_list("a").alias("partners")).select("b", "partners"))
        ids = cut(pairs.select("a").distinct())
        ys = rows.join(small_side(lists), F.col("doc_id") == F.col("b")).select("doc_id", "text", "partners").mapInArrow(_full_sets(width, True), "a long, b long, y binary")
        xs = rows.join(small_side(ids), F.col("doc_id") == F.col("a"), "left_semi").mapInArrow(_full_sets(width, False), "a long, x binary")
        out = cut(ys.join(xs, "a").where(_links(percent)("x", "y")).select("a", "b").distinct())
        drop(lists, ids)
        return out

    def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
        """Labels after the links between components."""
        x, y = (labels.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in "ab")
        roots = components(links.join(x, "a").join(y, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b")))
        out = cut(labels.join(roots.select(F.col("node").alias("root"), F.col("root").alias("last")), "root", "left").select("node", F.coalesce("last", "root").alias("root")))
        drop(labels, roots)
        return out

    nodes = cut(reps.select(F.col("rep").alias("node")).distinct().select("node", F.col("node").alias("root")))
    labels = nodes if same_doc.isEmpty() else merged(nodes, same_doc)
    stars = cut(buckets.where("first <> rep").groupBy(F.col("first").alias("a"), F.col("rep").alias("b")).agg(F.count("*").alias("bands")))
    main = stars.groupBy("b").agg(F.max(F.struct("bands", (-F.col("a")).alias("a"))).alias("m")).select((-F.col("m.a")).alias("a"), "b")
    for pairs in (main, stars.select("a", "b")):
        x, y = (labels.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in "ab")
        able = likely(pairs.join(x, "a").join(y, "b").where("ra <> rb").select("a", "b"))
        links = confirm(able)
        labels = labels if links.isEmpty() else merged(labels, links)
        drop(able, links)
    drop(stars)

    def unsettled(labels: DataFrame, most: int, short: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(pairs, short, both as written): candidate pairs of different components in buckets that hold several, and the rows (key, rep)
        that did not name all of their partners. With ``short`` of an earlier round only those name any: the others'
        partners were all verified.
        """
        placed = buckets.join(labels.withColumnRenamed("node", "rep"), "rep")
        mixed = placed.groupBy("key", "first").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n")).where("lo < hi and n > 2")
        mixed = mixed.join(labels.select(F.col("node").alias("first"), F.col("root").alias("main")), "first").select("key", "n", "main")
        placed = placed.select("key", "rep", "sig_a", "root").join(mixed, "key").withColumn("names", F.col("root") != F.col("main"))
        if short is not None:
            asked = placed.join(short.withColumn("_short", F.lit(True)), ["key", "rep"], "left")
            placed = asked.withColumn("names", F.col("names") & F.col("_short").isNotNull()).drop("_short")
        open_ = cut(placed)
        rest = open_.where("names").groupBy("key").agg(F.count("*").alias("r"))
        dealt = open_.join(rest, "key").withColumn("nb", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("rb", F.ceil(F.col("r") / BLOCK).cast("int"))
        own = lambda many: F.pmod(F.xxhash64("rep"), F.col(many)).cast("int")

        def side(rows: DataFrame, number: int, many: str, every: str) -> DataFrame:
            """Rows in their block of the one kind, copied only where the other kind has several blocks."""
            mine, other = ("i", "j") if many == "rb" else ("j", "i")
            single = rows.where(F.col(every) == 1).withColumn(other, F.lit(0))
            copied = rows.where(F.col(every) > 1).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(every) - 1)))
            return single.unionByName(copied).select("key", own(many).alias(mine), other, F.lit(number).alias("side"), "rep", "sig_a", "root")

        lefts, rights = side(dealt.where("names"), 0, "rb", "nb"), side(dealt, 1, "nb", "rb")
        both = lefts.unionByName(rights).join(first.select("rep", "sig_a", "regs", "n_shingles"), ["rep", "sig_a"]).drop("sig_a")
        sorted_ = both.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
        out = cut(sorted_.mapInArrow(_compared(most), "a long, b long, key long").distinct())
        drop(open_)
        return out.where("key is null").select("a", "b"), out.where("key is not null").select("key", F.col("a").alias("rep")), out

    rounds, short, last = [CLOSEST] * ROUNDS + [0], None, None
    while rounds:
        pairs, left, found = unsettled(labels, rounds.pop(0), short)
        links = confirm(pairs)
        if links.isEmpty():
            rounds = rounds[-1:]  # nothing merges any more: go on to the round that names all, and end after it
        else:
            labels = merged(labels, links)
        if left.isEmpty():
            rounds = []  # every pair that was left has been verified
        drop(links, *([last] if last is not None else []))
        short, last = left, found
    drop(last)
    roots = reps.join(labels.withColumnRenamed("node", "rep"), "rep").select(*digest, F.col("root").alias("component_id"))
    out = made.select("doc_id", *digest).join(roots, digest, "left")
    alone = F.col("doc_id").isNull() | (F.col("n_shingles") == 0)
    out = out.withColumn("component_id", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")))
    out = cut(out.select("doc_id", "n_shingles", "component_id", F.expr("doc_id <=> component_id").alias("kept")))
    drop(made, reps, same_doc, first, buckets, labels)
    return out


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their near-duplicate group."""
    return near_duplicates(table(spark, sf_dir, "documents"))
