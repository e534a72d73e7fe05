"""Pair features: ranks, gaps and competition among the candidates of a target and of an anchor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tieline.functions import fuzzy

# The names of the features, in the order of the models.
COSINES = ("name", "addr", "enc", "raw")
STAGE1 = [
    *(f"cos_{c}" for c in COSINES[:3]), *(f"rank_{c}" for c in COSINES[:3]), "n_channels", *(f"gap_{c}" for c in COSINES[:3]), *(f"qrank_{c}" for c in COSINES[:3]), *(f"max_{c}" for c in COSINES[:3]),
    "second_enc_gap", "union_size", "q_name_empty", "q_addr_empty", "s_addr_empty", "cos_sum", "cos_min", "cos_raw", "gap_raw", "qrank_raw", "raw_exact",
]
COMPETITION = ["p1", "p1_rank_t", "p1_margin_t", "n_kept_t", "s1_n_cand", "s1_n_top1", "s1_sum_p1", "s1_max_p1", "p1_gap_s1", "rank_in_s1"]
STRINGS = [
    "fz_ratio", "fz_tsort", "fz_tset", "fz_partial", "jw", "core_ratio", "core_tset", "core_equal", "raw_equal", "addr_tset", "addr_partial", "addr_canon_tset", "t_addr_empty",
    "num_shared", "num_conflict", "num_fuzzy", "num_t", "num_s", "len_t", "len_s",
]
STAGE2 = STAGE1 + COMPETITION + STRINGS


def per(key: str):
    return Window.partitionBy(key)


def rank_of(score: str, key: str, tie: str) -> Column:
    """Rank from 0 by descending score, ties to the smaller id."""
    return F.row_number().over(Window.partitionBy(key).orderBy(F.round(score, 9).desc(), tie)) - 1


def group_features(pairs: DataFrame, channels: tuple[str, ...]) -> DataFrame:
    """gap_, qrank_ and max_ of each cosine within its target, and union_size."""
    out = pairs
    for c in channels:
        best = F.max(f"cos_{c}").over(per("tgt_id"))
        out = out.withColumns({f"max_{c}": best, f"gap_{c}": F.col(f"cos_{c}") - best, f"qrank_{c}": rank_of(f"cos_{c}", "tgt_id", "s1_id")})
    return out.withColumn("union_size", F.count("*").over(per("tgt_id")))


def second_gap(pairs: DataFrame, score: str, name: str) -> DataFrame:
    """Best minus second best score of a target (0 for a missing second), on each of its pairs."""
    r = rank_of(score, "tgt_id", "s1_id")
    ranked = pairs.withColumn("_r", r)
    first, second = (F.max(F.when(F.col("_r") == k, F.col(score))).over(per("tgt_id")) for k in (0, 1))
    return ranked.withColumn(name, first - F.coalesce(second, F.lit(0.0))).drop("_r")


def stage1_features(pairs: DataFrame) -> DataFrame:
    """All of STAGE1 on pairs that have cosines, ranks, n_channels and the empty flags."""
    out = second_gap(group_features(pairs, COSINES), "cos_enc", "second_enc_gap")
    return out.withColumns({"cos_sum": F.col("cos_name") + F.col("cos_addr") + F.col("cos_enc"), "cos_min": F.least("cos_name", "cos_addr", "cos_enc"), "raw_exact": (F.col("cos_raw") > 0.999).cast("double")}).drop("max_raw")


def competition(pairs: DataFrame) -> DataFrame:
    """How p1 stands among the candidates of its target and of its anchor."""
    out = pairs.withColumn("p1_rank_t", rank_of("p1", "tgt_id", "s1_id"))
    best, second = (F.max(F.when(F.col("p1_rank_t") == k, F.col("p1"))).over(per("tgt_id")) for k in (0, 1))
    margin = F.when(F.col("p1_rank_t") == 0, F.col("p1") - F.coalesce(second, F.lit(0.0))).otherwise(F.col("p1") - best)
    out = out.withColumns({"p1_margin_t": margin, "n_kept_t": F.count("*").over(per("tgt_id"))})
    out = out.withColumns({
        "s1_n_cand": F.count("*").over(per("s1_id")), "s1_n_top1": F.count_if(F.col("p1_rank_t") == 0).over(per("s1_id")), "s1_sum_p1": F.sum("p1").over(per("s1_id")),
        "s1_max_p1": F.max("p1").over(per("s1_id")), "rank_in_s1": rank_of("p1", "s1_id", "tgt_id"),
    })
    return out.withColumn("p1_gap_s1", F.col("p1") - F.col("s1_max_p1"))


def string_features(pairs: DataFrame, targets: DataFrame, anchors: DataFrame) -> DataFrame:
    """STRINGS from record views (entity_id, name, core, addr, addr_canon, nums, dels), made once for each record."""
    columns = ["name", "core", "addr", "addr_canon", "nums", "dels"]
    t = targets.select(F.col("entity_id").alias("tgt_id"), *[F.col(c).alias(f"{c}_t") for c in columns])
    s = anchors.select(F.col("entity_id").alias("s1_id"), *[F.col(c).alias(f"{c}_s") for c in columns])
    both = pairs.join(t, "tgt_id").join(s, "s1_id")
    f = lambda kind, c: (kind, F.col(f"{c}_t"), F.col(f"{c}_s"))
    scored = both.withColumn("_f", fuzzy.scores({
        "fz_ratio": f("ratio", "name"), "fz_tsort": f("token_sort", "name"), "fz_tset": f("token_set", "name"), "fz_partial": f("partial", "name"), "jw": f("jaro_winkler", "name"),
        "core_ratio": f("ratio", "core"), "core_tset": f("token_set", "core"), "addr_tset": f("token_set", "addr"), "addr_partial": f("partial", "addr"), "addr_canon_tset": f("token_set", "addr_canon"),
    }))
    scored = scored.select("*", "_f.*").drop("_f")
    shared = F.size(F.array_intersect("nums_t", "nums_s"))
    some = (F.size("nums_t") > 0) & (F.size("nums_s") > 0)
    num = lambda c: c.cast("double")
    out = scored.withColumns({
        "core_equal": num(F.col("core_t") == F.col("core_s")), "raw_equal": num(F.col("name_t") == F.col("name_s")), "t_addr_empty": num(F.trim("addr_t") == ""),
        "num_shared": num(shared), "num_conflict": num(some & (shared == 0)), "num_fuzzy": num(F.arrays_overlap("dels_t", "dels_s")), "num_t": num(F.size("nums_t")), "num_s": num(F.size("nums_s")),
        "len_t": num(F.length("name_t")), "len_s": num(F.length("name_s")),
    })
    return out.drop(*[f"{c}_{side}" for c in columns for side in "ts"])


def best_parent(pairs: DataFrame, score: str = "p2", tau: float = 0.0) -> DataFrame:
    """The one anchor of each target: its best by score, if that reaches tau."""
    return pairs.withColumn("_r", rank_of(score, "tgt_id", "s1_id")).where((F.col("_r") == 0) & (F.col(score) >= tau)).drop("_r")


def prune(pairs: DataFrame, most: int = 20, floor: float = 0.0, score: str = "p1") -> DataFrame:
    """At most ``most`` pairs of a target, none under the floor."""
    return pairs.withColumn("_r", rank_of(score, "tgt_id", "s1_id")).where((F.col("_r") < most) & (F.col(score) >= floor)).drop("_r")
