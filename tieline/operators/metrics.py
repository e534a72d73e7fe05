"""Entity scores, macro and micro figures, threshold grids, recall, submission checks and merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TAUS = [round(0.05 + 0.01 * k, 2) for k in range(91)]
#: Pruning floors to try: 60 from 1e-6 to 0.05, each the same factor larger than the one before.
FLOORS = [1e-6 * 50_000 ** (k / 59) for k in range(60)]


def f05(p: Column, r: Column) -> Column:
    return F.when(0.25 * p + r > 0, 1.25 * p * r / (0.25 * p + r)).otherwise(F.lit(0.0))


def f05_of_recall(r: Column) -> Column:
    """F0.5 of predictions that are all right, from their recall."""
    return f05(F.lit(1.0), r)


def entity_scores(anchors: DataFrame, truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """(s1_id, .., n_true, n_pred, tp, p, r, f) of every anchor. A singleton scores 1 if nothing is predicted, else 0."""
    t, p = truth.select("s1_id", "tgt_id").distinct(), predicted.select("s1_id", "tgt_id").distinct()
    pairs = t.withColumn("t", F.lit(1)).join(p.withColumn("p", F.lit(1)), ["s1_id", "tgt_id"], "full_outer")
    n = pairs.groupBy("s1_id").agg(F.count("t").alias("n_true"), F.count("p").alias("n_pred"), F.count_if(F.col("t").isNotNull() & F.col("p").isNotNull()).alias("tp"))
    out = anchors.withColumnRenamed("entity_id", "s1_id").join(n, "s1_id", "left").fillna(0, ["n_true", "n_pred", "tp"])
    clean = F.when(F.col("n_pred") == 0, 1.0).otherwise(0.0)
    out = out.withColumn("p", F.when(F.col("n_true") == 0, clean).when(F.col("n_pred") == 0, 0.0).otherwise(F.col("tp") / F.col("n_pred")))
    out = out.withColumn("r", F.when(F.col("n_true") == 0, clean).otherwise(F.col("tp") / F.col("n_true")))
    return out.withColumn("f", F.when(F.col("n_true") == 0, clean).otherwise(f05(F.col("p"), F.col("r"))))


def segments(scores: DataFrame) -> DataFrame:
    """Macro figures overall, by singleton or not, and by country, in one pass."""
    typed = scores.withColumn("kind", F.when(F.col("n_true") == 0, "singleton").otherwise("linked"))
    from_ = typed.groupingSets([[], ["kind"], ["country"]], "kind", "country")
    out = from_.agg(F.grouping_id().alias("g"), F.count("*").alias("entities"), F.avg("p").alias("p"), F.avg("r").alias("r"), F.avg("f").alias("f05"))
    name = F.when(F.col("g") == 3, F.lit("ALL")).when(F.col("kind").isNotNull(), F.col("kind")).otherwise(F.col("country"))
    return out.select(name.alias("segment"), "entities", "p", "r", "f05")


def micro(scores: DataFrame) -> DataFrame:
    out = scores.agg(
        F.sum("tp").alias("tp"), F.sum("n_pred").alias("n_pred"), F.sum("n_true").alias("n_true"), F.count_if(F.col("f") == 1).alias("perfect"),
        F.count_if((F.col("n_true") == 0) & (F.col("n_pred") > 0)).alias("singleton_fp"), F.count_if((F.col("n_true") > 0) & (F.col("tp") == 0)).alias("missed"),
    )
    p, r = F.col("tp") / F.greatest("n_pred", F.lit(1)), F.col("tp") / F.greatest("n_true", F.lit(1))
    return out.withColumns({"p": p, "r": r}).withColumn("f05", f05(F.col("p"), F.col("r")))


def tau_grid(anchors: DataFrame, truth: DataFrame, best: DataFrame, score: str = "p2", taus: list[float] = TAUS) -> DataFrame:
    """(tau, f05): macro F0.5 at each threshold. A prediction counts under every tau up to its score.

    An anchor's figure changes only where one of its predictions comes in. So each prediction, best first, adds the change
    that it makes to all taus below its level (how many taus its score reaches): a row for each prediction, not for each tau.
    """
    level = F.size(F.filter(F.array(*[F.lit(t) for t in taus]), lambda t: t <= F.round(score, 9)))
    hit = best.join(truth.select("s1_id", "tgt_id").withColumn("t", F.lit(1)), ["s1_id", "tgt_id"], "left").select("s1_id", level.alias("level"), "t").where("level > 0")
    n_true = truth.groupBy("s1_id").agg(F.count("*").alias("n_true"))
    base = anchors.select(F.col("entity_id").alias("s1_id")).join(n_true, "s1_id", "left").fillna(0, ["n_true"])
    at = hit.groupBy("s1_id", "level").agg(F.count("*").alias("n"), F.count("t").alias("hits"))
    down = Window.partitionBy("s1_id").orderBy(F.col("level").desc())
    at = at.withColumns({"n_pred": F.sum("n").over(down), "tp": F.sum("hits").over(down)})
    p, r = F.col("tp") / F.col("n_pred"), F.when(F.col("n_true") > 0, F.col("tp") / F.col("n_true")).otherwise(0.0)
    none = F.when(F.col("n_true") == 0, 1.0).otherwise(0.0)
    f = F.when(F.col("n_true") == 0, 0.0).otherwise(f05(p, r))
    each = base.join(at, "s1_id").select("s1_id", "level", "n_true", f.alias("f"))
    # Of repeated anchors every row counts, with the same changes.
    before = F.coalesce(F.lag("f").over(Window.partitionBy("s1_id").orderBy(F.col("level").desc())), none)
    each = each.groupBy("s1_id", "level", "n_true", "f").agg(F.count("*").alias("rows")).withColumn("change", (F.col("f") - before) * F.col("rows"))
    changes = each.groupBy("level").agg(F.sum("change").alias("change"))  # as many rows as taus
    whole = base.agg(F.sum(none).alias("start"), F.count("*").alias("anchors")).where("anchors > 0")
    grid = whole.select("start", "anchors", F.posexplode(F.array(*[F.lit(t) for t in taus])).alias("k", "tau"))
    summed = grid.join(F.broadcast(changes), F.col("level") > F.col("k"), "left").groupBy("tau", "start", "anchors").agg(F.coalesce(F.sum("change"), F.lit(0.0)).alias("change"))
    return summed.select("tau", ((F.col("start") + F.col("change")) / F.col("anchors")).alias("f05"))


def best_tau(grid: DataFrame) -> float:
    """The first threshold with the highest figure."""
    return grid.orderBy(F.round("f05", 12).desc(), "tau").first()["tau"]


def best_floor(grid: DataFrame, all_recall: float, loss: float = 0.0005) -> float:
    """The largest floor before the first one that loses more than ``loss`` of the recall without a floor; 0 if none does."""
    best = 0.0
    for r in grid.orderBy("floor").collect():  # as many rows as floors
        if all_recall - r["recall"] > loss:
            break
        best = r["floor"]
    return best


def floor_grid(labelled: DataFrame, floors: list[float], most: int = 20) -> DataFrame:
    """(floor, recall): share of targets whose true pair is among the ``most`` best and not under the floor."""
    kept = labelled.where(F.col("label") == 1).select("tgt_id", F.col("p1").alias("p"), F.col("p1_rank_t").alias("k"))
    n = labelled.select("tgt_id").distinct().count()
    at = kept.where(F.col("k") < most).select(F.explode(F.filter(F.array(*[F.lit(x) for x in floors]), lambda x: F.col("p") >= x)).alias("floor")).groupBy("floor").count()
    return at.select("floor", (F.col("count") / max(1, n)).alias("recall"))


def recall(hits: dict[str, DataFrame], truth: DataFrame, countries: DataFrame) -> DataFrame:
    """(country, <channel>..): share of true links found, by country and overall (country null)."""
    rows = truth.join(countries.select(F.col("entity_id").alias("s1_id"), "country"), "s1_id")
    for c, h in hits.items():
        rows = rows.join(h.select("tgt_id", "s1_id").distinct().withColumn(c, F.lit(1.0)), ["tgt_id", "s1_id"], "left")
    return rows.rollup("country").agg(F.count("*").alias("n_links"), *[F.avg(F.coalesce(c, F.lit(0.0))).alias(c) for c in hits])


def findings(lists: DataFrame, s1_ids: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(rule, n, examples) of a match list (s1, value): the submission rules that it breaks, five examples each."""
    each = lists.select(F.trim("s1").alias("s1"), F.filter(F.transform(F.split(F.coalesce("value", F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "").alias("ids"))
    flat = each.select("s1", F.explode("ids").alias("id"))
    rule = lambda df, name, col: df.select(F.lit(name).alias("rule"), F.col(col).alias("id"))
    twice = F.size("ids") > F.size(F.array_distinct("ids"))
    out = rule(each.groupBy("s1").count().where("count > 1"), "duplicate_row", "s1")
    out = out.union(rule(each.where(twice), "repeated_id", "s1")).union(rule(flat.where(F.col("id").startswith("S1-")), "self_match", "id"))
    out = out.union(rule(flat.where(~F.col("id").rlike("^S[123]-")), "bad_prefix", "id"))
    out = out.union(rule(s1_ids.select("s1").join(each, "s1", "left_anti"), "missing_s1", "s1")).union(rule(each.join(s1_ids, "s1", "left_anti"), "unknown_s1", "s1"))
    if known is not None:
        out = out.union(rule(flat.join(known.select("id"), "id", "left_anti"), "unknown_id", "id"))
    return out.groupBy("rule").agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_set("id")), 1, 5).alias("examples"))


def outside_candidates(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """Matches (s1_id, tgt_id) that were never candidates."""
    return matches.select("s1_id", "tgt_id").join(candidates.select("s1_id", "tgt_id"), ["s1_id", "tgt_id"], "left_anti")


def merge(anchors: DataFrame, parts: list[DataFrame]) -> DataFrame:
    """One row for each anchor from per-country outputs (s1, value)."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return anchors.select(F.col("entity_id").alias("s1")).join(rows, "s1", "left").select("s1", F.coalesce("value", F.lit("")).alias("value"))


def ambiguity(missed: DataFrame, anchors: DataFrame) -> DataFrame:
    """Of missed links (s1_id), how many anchors of the country share the true anchor's core name: (same_core, n)."""
    same = anchors.groupBy("country", "core").agg(F.count("*").alias("same_core"))
    return missed.join(anchors.withColumnRenamed("entity_id", "s1_id"), "s1_id").join(same, ["country", "core"]).groupBy("same_core").agg(F.count("*").alias("n"))


def tie_histogram(pairs: DataFrame, columns: tuple[str, ...], within: float = 1e-4) -> DataFrame:
    """Missed true pairs (label 1, kept 0) by how many candidates of their target tie with them: bins of ten up to 100."""
    true = pairs.where("label = 1 and kept = 0").select("tgt_id", *[F.col(c).alias(f"_{c}") for c in columns])
    tie = F.lit(True)
    for c in columns:
        tie = tie & (F.abs(F.col(c) - F.col(f"_{c}")) <= within)
    n = pairs.join(true, "tgt_id").groupBy("tgt_id").agg(F.count_if(tie).alias("n"))
    return n.groupBy((F.floor(F.least("n", F.lit(100)) / 10) * 10).cast("long").alias("bin")).agg(F.count("*").alias("targets"))
