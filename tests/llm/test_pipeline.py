"""Every stage of the pipeline on the smallest tables, against a plain version of it on the same input."""

import random
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
from test_operators import WORDS, lower, plain_components, plain_removed

from tieline.llm import packing, quality_rules
from tieline.llm.common import cut

SF = "/root/testdata/sf0.001"
ROW = ("doc_id", "text", "lang", "source", "n_chars")


def rows_of(df):
    return sorted((tuple(r[c] for c in ROW) for r in df.collect()), key=repr)


def ratios(text):
    """The statistics that rules test, and whether the base fails."""
    w = WORDS.findall(text)
    windows = Counter(tuple(w[k:k + 3]) for k in range(len(w) - 2))
    twice = {p for k in range(len(w) - 2) if windows[tuple(w[k:k + 3])] > 1 for p in (k, k + 1, k + 2)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    n = max(1, len(w))
    return {
        "n_words": len(w), "mean_word": sum(map(len, w)) / n, "symbol_ratio": len(re.findall(r"[#*$%&|<>]", text)) / n, "dup_line_ratio": (len(lines) - len(set(lines))) / max(1, len(lines)),
        "repeat_ratio": len(twice) / n, "shout_ratio": len(re.findall("[A-Z][A-Z]", text)) / n, "mark_ratio": len(re.findall("[!?]{2}", text)) / n,
    }, len(w) < 50 or 100 * len(twice) > 50 * len(w)


def plain_quality(spark, rows):
    labels = {(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality is not null").collect()}
    stats = {r[0]: ratios(r[1] or "") for r in rows}
    known = sorted(((i, *(float(stats[i][0][f]) for f in quality_rules.FEATURES), q) for i, q in labels if i in stats and not stats[i][1]), key=lambda r: ((r[0] * 2654435761) % 4294967296, r))
    rules = quality_rules.learn_rules([(dict(zip(quality_rules.FEATURES, r[1:-1])), r[-1] == 0) for r in known])
    return [r for r in rows if not stats[r[0]][1] and not any(x.holds(stats[r[0]][0]) for x in rules)]


def plain_lines(rows):
    gone = plain_removed({r[0]: r[1] for r in rows})
    out = []
    for r in rows:
        text = None if r[1] is None else "\n".join(x for k, x in enumerate(r[1].split("\n")) if k not in gone[r[0]])
        out.append((r[0], text, r[2], r[3], None if text is None else len(text)))
    return out


def plain_decontaminated(spark, rows, width=13):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    found = defaultdict(set)
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        v = word.findall(lower(r["text"] or ""))
        size = min(width, len(v))
        found[size] |= {tuple(v[k:k + size]) for k in range(len(v) - size + 1 if size else 0)}
    out = []
    for r in rows:
        w = word.findall(lower(r[1] or ""))
        hit = {p for size, known in found.items() if size for k in range(len(w) - size + 1) if tuple(w[k:k + size]) in known for p in range(k, k + size)}
        if not (hit and 20 * len(hit) >= len(w)):
            out.append(r)
    return out


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    stages, rows, counts = dict(corpus_pipeline.STAGES), rows_of(docs), []
    plain = {
        "quality rules": lambda rows: plain_quality(spark, rows), "line dedup": plain_lines,
        "near dedup": lambda rows: [r for r, root in zip(rows, map(plain_components({r[0]: r[1] for r in rows})[0].get, [r[0] for r in rows])) if root == r[0]],
        "decontamination": lambda rows: plain_decontaminated(spark, rows),
    }
    assert list(stages) == [*plain, "packing"]
    for name, make in plain.items():
        docs = cut(stages[name](spark, docs, SF))
        assert docs.columns == corpus_pipeline.COLUMNS
        rows = sorted(make(rows), key=repr)
        assert rows_of(docs) == rows, name
        counts.append(len(rows))
    assert 200 > counts[0] == counts[1] >= counts[2] > counts[3] > 0
    tok = packing.WordTokenizer(packing.default_tokenizer()).tokenizer
    want = Counter()
    for r in rows:
        ids = tok.encode(r[1] or "", add_special_tokens=False).ids + [0]
        want.update((r[0], p, zlib.crc32(np.array(ids[at:at + 2048], "<u4").tobytes())) for p, at in enumerate(range(0, len(ids), 2048)))
    packed = stages["packing"](spark, docs, SF).collect()
    assert Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in packed) == want
    places = defaultdict(list)
    for r in packed:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in places.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 2048


def test_near_dedup_stage_keeps_different_texts_of_one_id(spark):
    rng = random.Random(1)
    text = lambda: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(60))
    a, b, c = text(), text(), text()
    rows = [(1, a, "en", "x", 1), (1, b, None, None, None), (1, b, "de", None, None), (2, c, "en", "x", 1), (3, c + " end", "en", "x", 1), (None, a, None, None, None), (4, None, None, None, None), (4, None, None, None, None), (5, "", "en", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = rows_of(corpus_pipeline.near_duplicates(spark, docs, SF))
    assert out == sorted([rows[0], rows[1], rows[3], rows[5], rows[6], rows[8]], key=repr)
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), SF).count() == 0
