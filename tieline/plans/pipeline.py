"""The verbs of record linkage: fit, prep, candidates, stage 2, predict, evaluate, validate, merge, diagnose."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import asdict, dataclass, field, replace
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tieline.functions import keys, text
from tieline.functions.script import Script, learn_script
from tieline.operators import classes, encoder, features, learn, metrics, sampling, vectors
from tieline.plans import diagnose
from tieline.sources import store, tsv

#: Channel to the tokens that its bags are made of.
CHANNELS = {"name": "core_tokens", "addr": "addr_tokens", "raw": "raw"}


@dataclass(frozen=True)
class Config:
    k: int = 10
    k_deep: int = 100
    tie_ratio: float = 0.9
    m_max: int = 20
    floor: float = -1.0  # below 0: tuned on the validation targets of stage 1
    tau: float = 0.5
    max_df_frac: float = 0.003
    lexicon_min_count: int = 30
    noise_min_count: int = 200
    trees: int = 20
    depth: int = 5
    seed: int = 42
    frac: float = 1.0
    encoder_links: int = -1  # links that the encoder learns from; below 0: half of all, stage 1 takes the others; 0: hashed vectors without learning
    encoder_epochs: int = 3
    stage1_links: int = -1  # links that stage 1 learns from; below 0: all that the encoder does not take
    cells: int = 0  # above 0: approximate encoder search over so many cells
    probes: int = 8


@dataclass
class Pairs:
    """Pairs of one target for each class of equal ones; ``each`` gives them to all of its targets."""

    rows: DataFrame
    targets: classes.Classes

    def each(self, rows: DataFrame | None = None) -> DataFrame:
        return self.targets.each(self.rows if rows is None else rows)


@dataclass
class Artefacts:
    """All that is learned. ``biased`` (tgt_id): targets that an earlier model was trained on and stage 2 must not be."""

    config: Config = field(default_factory=Config)
    name_lexicon: dict[str, str] = field(default_factory=dict)
    address_lexicon: dict[str, str] = field(default_factory=dict)
    noise: frozenset[str] = frozenset()
    script: Script = field(default_factory=Script)
    idf: dict[str, vectors.Idf] = field(default_factory=dict)
    encoder: encoder.Encoder | None = None
    model1: PipelineModel | None = None
    model2: PipelineModel | None = None
    floor: float = 0.0
    tau: float | None = None
    biased: DataFrame | None = None
    pairs: Pairs | None = field(default=None, compare=False)  # of the targets it was fitted on; not saved

    def save(self, spark: SparkSession, path: str) -> None:
        """Everything below ``path``, in any store that Spark reaches."""
        body = {
            "config": asdict(self.config), "name_lexicon": self.name_lexicon, "address_lexicon": self.address_lexicon, "noise": sorted(self.noise), "script": asdict(self.script) | {"vowels": sorted(self.script.vowels)},
            "floor": self.floor, "tau": self.tau, "idf": {c: [i.documents, i.median] for c, i in self.idf.items()}, "encoder": self.encoder is not None, "models": [n for n in ("model1", "model2") if getattr(self, n)], "biased": self.biased is not None,
        }
        for c, i in self.idf.items():
            i.table.write.mode("overwrite").parquet(f"{path}/idf_{c}")
        for n in body["models"]:
            getattr(self, n).write().overwrite().save(f"{path}/{n}")
        if self.encoder:
            self.encoder.save(spark, f"{path}/encoder")
        if self.biased is not None:
            self.biased.write.mode("overwrite").parquet(f"{path}/biased")
        store.write_json(spark, f"{path}/artefacts.json", body)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Artefacts":
        body = store.read_json(spark, f"{path}/artefacts.json")
        script = Script(**body["script"] | {"vowels": frozenset(body["script"]["vowels"])})
        idf = {c: vectors.Idf(spark.read.parquet(f"{path}/idf_{c}"), n, m) for c, (n, m) in body["idf"].items()}
        models = {n: PipelineModel.load(f"{path}/{n}") for n in body["models"]}
        return cls(
            Config(**body["config"]), body["name_lexicon"], body["address_lexicon"], frozenset(body["noise"]), script, idf, encoder.Encoder.load(spark, f"{path}/encoder") if body["encoder"] else None,
            floor=body["floor"], tau=body["tau"], biased=spark.read.parquet(f"{path}/biased") if body["biased"] else None, **models,
        )


def views(records: DataFrame, art: Artefacts) -> DataFrame:
    """Records with folded texts, tokens (Indic ones in Latin letters once a script table is learned), core, canonical
    address, numbers and deletions."""
    latin = art.script.latin_column if art.script.words or art.script.emissions else lambda tokens: tokens
    out = records.withColumns({"name": text.fold(F.col("business_name")), "addr": text.fold(F.col("business_address"))})
    out = out.withColumns({"raw": latin(text.raw_tokens(F.col("name"))), "addr_raw": latin(text.raw_tokens(F.col("addr")))})
    out = out.withColumns({"name_tokens": text.mapped(F.col("raw"), art.name_lexicon), "addr_tokens": text.mapped(F.col("addr_raw"), art.address_lexicon)})
    out = out.withColumns({"core_tokens": text.without(F.col("name_tokens"), art.noise), "nums": text.numbers(F.col("addr_tokens"))})
    return out.withColumns({"core": F.array_join("core_tokens", ""), "addr_canon": F.array_join("addr_tokens", " "), "dels": text.deletions(F.col("nums"))})


def learn_text(anchors: DataFrame, targets: DataFrame, links: DataFrame, config: Config) -> Artefacts:
    """The script table from plain tokens, lexicons without a lexicon, then noise words with it.

    The plain tokens of both sides of the links are made once; what is learned is applied to them as ``views`` does.
    """
    sides = []
    for rows, key in ((anchors, "s1_id"), (targets, "tgt_id")):
        linked = rows.join(links.select(F.col(key).alias("entity_id")).distinct(), "entity_id", "left_semi")
        sides.append(views(linked, Artefacts()).select(F.col("entity_id").alias(key), F.struct("raw", "addr_raw").alias(key[0])))
    pairs = store.written(links.join(sides[0], "s1_id").join(sides[1], "tgt_id").select("s", "t"))
    of = lambda rows, c: rows.select(F.col(f"s.{c}").alias("s"), F.col(f"t.{c}").alias("t"))
    script = learn_script({(r["indic"], r["latin"]): r["n"] for r in learn.script_pairs(of(pairs, "raw")).collect()})
    if script.words or script.emissions:
        latin = lambda side: F.struct(*[script.latin_column(F.col(f"{side}.{c}")).alias(c) for c in ("raw", "addr_raw")]).alias(side)
        plain, pairs = pairs, store.written(pairs.select(latin("s"), latin("t")))
        store.drop(plain)
    names, addresses = (learn.learn_lexicon(of(pairs, c), config.lexicon_min_count) for c in ("raw", "addr_raw"))
    worded = of(pairs, "raw").select(*[text.mapped(F.col(side), names).alias(side) for side in "st"])
    noise = learn.learn_noise(worded, config.noise_min_count)
    store.drop(pairs)
    return Artefacts(config, names, addresses, noise, script)


def bag(records: DataFrame, script: Script, channel: str, keys: tuple[str, ...] = ("entity_id", "country")) -> DataFrame:
    tokens = F.col(CHANNELS[channel])
    made = text.name_bag(tokens, script.sound_column(tokens)) if channel == "name" else text.address_bag(tokens) if channel == "addr" else text.raw_bag(tokens)
    return text.long_bag(records, made, keys)


def bags(records: DataFrame, script: Script) -> dict[str, DataFrame]:
    return {c: bag(records, script, c) for c in CHANNELS}


def _classes(records: DataFrame, art: Artefacts) -> classes.Classes:
    return classes.Classes(records, lambda rows: views(rows, art), CHANNELS)


def _class_bag(of: classes.Classes, art: Artefacts, channel: str) -> DataFrame:
    return store.written(bag(of.of[channel], art.script, channel, ("entity_id", "country", "n")))


def _idf_of(bag: DataFrame, documents: int, config: Config) -> vectors.Idf:
    idf = vectors.fit_idf(bag, documents, config.max_df_frac)
    return vectors.Idf(store.written(idf.table), documents, idf.median)


def fit_idf(anchors: DataFrame, art: Artefacts) -> dict[str, vectors.Idf]:
    """Document frequencies of the three bags over ``anchors``, written, as every later bag is weighed by them."""
    n, of, out = anchors.count(), _classes(anchors, art), {}
    for c in CHANNELS:
        made = _class_bag(of, art, c)
        out[c] = _idf_of(made, n, art.config)
        store.drop(made)
    of.release()
    return out


class Side:
    """Records prepared for search: classes of equal ones, and of those weighted bags and vectors, each written to the shared
    store until ``release``. Artefacts without document frequencies take them from these records: ``art`` has them."""

    def __init__(self, records: DataFrame, art: Artefacts):
        self.classes, self.weights, idf = _classes(records, art), {}, dict(art.idf)
        for c in CHANNELS:
            made = _class_bag(self.classes, art, c)  # read for the weights and again for their norms
            if c not in art.idf:
                idf[c] = _idf_of(made, self.classes.members.count(), art.config)
            self.weights[c] = store.written(vectors.weigh(made.drop("n"), idf[c]))
            store.drop(made)
        self.art = art if art.idf else replace(art, idf=idf)
        both = reduce(DataFrame.unionByName, [self.classes.of_profiles(self.weights[c], c, "entity_id") for c in ("name", "addr")])
        self.vec = store.written(encoder.encoded(encoder.hashed_bags(both), art.encoder) if art.encoder else vectors.hashed_embedding(both))

    def release(self) -> None:
        self.release_search()
        store.drop(self.classes.members)

    def release_search(self) -> None:
        """All but the classes' members."""
        store.drop(self.classes.profiles, *self.classes.of.values(), *self.weights.values(), self.vec)


def class_candidates(anchors: DataFrame | Side, targets: DataFrame, art: Artefacts) -> Pairs:
    """Pairs of the union of three channels with all of features.STAGE1, and country and deep. Anchors may be prepared once and used again.

    Equal targets have equal pairs, so pairs are made for their classes; anchors are searched by class, and each has its
    place among the hits. The result is written to the shared store, so what it was made from is let go.
    """
    c = art.config
    a = anchors if isinstance(anchors, Side) else Side(anchors, art)
    art = art if art.idf else a.art
    t = Side(targets, art)
    empty = lambda column: t.classes.profiles.where(F.size(column) == 0).select(F.col("entity_id").alias("tgt_id"))
    hits = {}
    for n, other in (("name", "addr_tokens"), ("addr", "core_tokens")):
        found = classes.member_hits(vectors.sparse_search(t.weights[n], a.weights[n], c.k_deep), a.classes.by(n), c.k_deep)
        hits[n] = store.written(vectors.adaptive(t.classes.of_profiles(found, n), empty(other), c.k, c.tie_ratio))
    # The encoder goes deep where either sparse channel does, also for targets that have no hits there.
    deep = empty("addr_tokens").union(empty("core_tokens"))
    for found in list(hits.values()):
        deep = deep.union(found.where("deep").select("tgt_id"))
    deep = store.written(deep.distinct().withColumnRenamed("tgt_id", "entity_id"))
    index = vectors.CellIndex.fit(a.vec, c.cells) if c.cells else None
    search = lambda rows, k: vectors.cell_search(rows, a.vec, index, k, c.probes) if index else vectors.dense_search(rows, a.vec, k)
    dense = lambda rows, k: classes.member_hits(search(rows, k), a.classes.by(), k)
    hits["enc"] = dense(t.vec.join(deep, "entity_id", "left_semi"), c.k_deep).unionByName(dense(t.vec.join(deep, "entity_id", "left_anti"), c.k))
    # The searches run once: all that follows is made from the written pairs, with the classes that either side has in each channel.
    own = lambda side, tag: [F.col(f"cls_{n}").alias(f"{tag}_{n}") for n in CHANNELS]
    sides_t = t.classes.profiles.select(F.col("entity_id").alias("tgt_id"), *own(t, "_t"), "country", (F.size("core_tokens") == 0).cast("double").alias("q_name_empty"), (F.size("addr_tokens") == 0).cast("double").alias("q_addr_empty"))
    sides_t = sides_t.join(deep.select(F.col("entity_id").alias("tgt_id"), F.lit(True).alias("deep")), "tgt_id", "left").fillna(False, ["deep"]).withColumn("_t_enc", F.col("tgt_id"))
    sides_s = a.classes.profiles.select(F.col("entity_id").alias("_s_enc"), *own(a, "_s"), (F.size("addr_tokens") == 0).cast("double").alias("s_addr_empty"))
    sides_s = a.classes.members.select(F.col("entity_id").alias("s1_id"), F.col("rep").alias("_s_enc")).join(sides_s, "_s_enc")
    met = store.written(vectors.union_channels(hits).join(sides_t, "tgt_id").join(sides_s, "s1_id"))
    pairs, asked = met, []
    for n in (*CHANNELS, "enc"):
        keys = [f"_t_{n}", f"_s_{n}"]
        asked.append(store.written(met.select(*keys).distinct().toDF("tgt_id", "s1_id")))
        if n == "enc":
            both = asked[-1].join(t.vec.select(F.col("entity_id").alias("tgt_id"), F.col("vec").alias("_v")), "tgt_id", "left").join(a.vec.select(F.col("entity_id").alias("s1_id"), F.col("vec").alias("_w")), "s1_id", "left")
            found = both.withColumn("cos_enc", F.coalesce(vectors.dot(F.col("_v"), F.col("_w")), F.lit(0.0)))
        else:
            found = vectors.pair_cosine(asked[-1], t.weights[n], a.weights[n], f"cos_{n}")
        pairs = pairs.join(found.select(F.col("tgt_id").alias(keys[0]), F.col("s1_id").alias(keys[1]), f"cos_{n}"), keys).drop(*keys)
    out = store.written(features.stage1_features(pairs))
    store.drop(deep, met, hits["name"], hits["addr"], *asked)
    t.release_search()
    if not isinstance(anchors, Side):
        a.release()
    return Pairs(out, t.classes)


def candidates(anchors: DataFrame | Side, targets: DataFrame, art: Artefacts) -> DataFrame:
    """The pairs of ``class_candidates`` for every target."""
    return class_candidates(anchors, targets, art).each()


def labelled(pairs: DataFrame, links: DataFrame) -> DataFrame:
    return pairs.join(links.select("tgt_id", "s1_id").withColumn("label", F.lit(1)), ["tgt_id", "s1_id"], "left").fillna(0, ["label"])


def _tenth(seed: int):
    return keys.unit_hash(F.col("tgt_id"), seed + 1) < 0.1


def stage1(pairs: DataFrame, links: DataFrame, config: Config):
    """A model of a link on the pairs of training targets; a tenth of the targets validates."""
    return learn.fit_model(labelled(pairs, links).withColumn("validation", _tenth(config.seed)), features.STAGE1, config.trees, config.depth, seed=config.seed)


def tuned_floor(scored: DataFrame, links: DataFrame, config: Config) -> float:
    """The largest floor that costs the validation targets next to no recall among their ``m_max`` best pairs."""
    if config.floor >= 0:
        return config.floor
    rows = features.competition(labelled(scored.where(_tenth(config.seed)), links)).persist()
    whole = metrics.floor_grid(rows, [0.0], config.m_max).first()
    out = metrics.best_floor(metrics.floor_grid(rows, metrics.FLOORS, config.m_max), whole["recall"] if whole else 0.0)
    rows.unpersist()
    return out


def disjoint(train: DataFrame, config: Config) -> tuple[DataFrame, DataFrame]:
    """The links of the encoder and of stage 1. Unless the configuration asks for fewer, every link is in one of them."""
    if not config.encoder_links and config.stage1_links < 0:
        return train.limit(0), train
    if config.encoder_links < 0 and config.stage1_links < 0:
        return sampling.split_links(train, config.seed)
    n = train.count()
    most = lambda links: n if links < 0 else links
    parts = store.written(sampling.disjoint_links(train, most(config.encoder_links), most(config.stage1_links), config.seed))
    first, second = (parts.where(F.col("part") == p).select("tgt_id", "s1_id") for p in (0, 1))
    return sampling.split_links(first, config.seed) if second.isEmpty() else (first, second)  # none left for stage 1


def fit(anchors: DataFrame, targets: DataFrame, links: DataFrame, config: Config) -> Artefacts:
    """Everything up to stage 1, from links of the train fold alone: tune and holdout links are not read.

    The encoder and stage 1 learn from disjoint links; the targets of the latter are remembered as biased. The pairs of all
    targets are made once and kept as ``pairs``: stage 1 learns from those of its targets, what follows needs them all.
    """
    train = store.written(sampling.links_of_fold(links, 0, config.seed))
    art = learn_text(anchors, targets, train, config)
    art.idf = fit_idf(anchors.where(keys.fold_of(F.col("entity_id"), config.seed) == 0), art)
    first, second = disjoint(train, config)
    of = lambda some: targets.join(some.select(F.col("tgt_id").alias("entity_id")).distinct(), "entity_id", "left_semi")
    if config.encoder_links:
        weighed = lambda rows: store.written(encoder.hashed_bags(vectors.weigh(b["name"], art.idf["name"]).unionByName(vectors.weigh(b["addr"], art.idf["addr"])))) if (b := bags(store.written(views(rows, art)), art.script)) else None
        linked = anchors.join(first.select(F.col("s1_id").alias("entity_id")).distinct(), "entity_id", "left_semi")
        art.encoder = encoder.learn_encoder(first, weighed(linked), weighed(of(first)), config.encoder_epochs, config.seed)
    art.biased = second.select("tgt_id").distinct()
    art.pairs = class_candidates(anchors, targets, art)
    pairs = store.written(art.pairs.each().join(second.select("tgt_id").distinct(), "tgt_id", "left_semi"))
    art.model1 = stage1(pairs, second, config)
    art.floor = tuned_floor(learn.probability(art.model1, pairs, features.STAGE1, "p1"), second, config)
    return art


def kept_candidates(anchors: DataFrame | Side, targets: DataFrame, art: Artefacts, made: Pairs | None = None) -> tuple[DataFrame, DataFrame]:
    """(all pairs with p1, the pruned ones). ``made``: the pairs of these records, if ``fit`` has made them already."""
    made = made or class_candidates(anchors, targets, art)
    scored = learn.probability(art.model1, made.rows, features.STAGE1, "p1")
    return made.each(scored), made.each(features.prune(scored, art.config.m_max, art.floor))


def stage2_pairs(kept: DataFrame, anchors: DataFrame, targets: DataFrame, art: Artefacts) -> DataFrame:
    """Pruned pairs with all of features.STAGE2."""
    return features.string_features(features.competition(kept), views(targets, art), views(anchors, art))


def stage2(kept: DataFrame, anchors: DataFrame, targets: DataFrame, links: DataFrame, art: Artefacts) -> tuple[DataFrame, dict]:
    """Train the second model, tune the threshold, gate on the holdout: (best anchor of each target with p2, report).

    The model sees targets of the train fold that stage 1 was not trained on, and stops early on the tune fold; tau is
    tuned there too; the holdout fold is only reported. A target's fold is that of its true anchor.
    """
    c = art.config
    full = store.written(stage2_pairs(kept, anchors, targets, art))
    folds = store.written(sampling.fold_of_targets(targets, links, c.seed))
    rows = labelled(full, links.where(keys.fold_of(F.col("s1_id"), c.seed) < 2)).join(folds, "tgt_id")
    train = sampling.without_targets(rows.where("fold = 0"), art.biased) if art.biased is not None else rows.where("fold = 0")
    seen = train.unionByName(rows.where("fold = 1")).withColumn("validation", F.col("fold") == 1)
    art.model2 = learn.fit_model(seen, features.STAGE2, c.trees, c.depth, seed=c.seed)
    final = store.written(features.best_parent(learn.probability(art.model2, full, features.STAGE2, "p2")).select("tgt_id", "s1_id", "p1", "p2"))
    of = lambda fold: anchors.where(keys.fold_of(F.col("entity_id"), c.seed) == fold)
    inside = lambda df, fold: df.where(keys.fold_of(F.col("s1_id"), c.seed) == fold)
    art.tau = float(metrics.best_tau(metrics.tau_grid(of(1), inside(links, 1), inside(final, 1))))
    report = {"tau": art.tau, "floor": art.floor}
    for name, fold in (("tune", 1), ("holdout", 2)):
        scores = metrics.entity_scores(of(fold).select("entity_id", "country"), inside(links, fold), inside(final, fold).where(F.col("p2") >= art.tau))
        report[name] = scores.agg(F.avg("f")).first()[0]
        report[f"{name}_ceiling"] = diagnose.ceiling(of(fold), inside(links, fold), inside(full, fold)).first()["f05"]
    return final, report


def predict(anchors: DataFrame, targets: DataFrame, art: Artefacts, stage1_only: bool = False, tau: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(decided, candidates) of unseen records with saved artefacts. ``stage1_only`` decides by p1, by default from 0.5 on."""
    _, kept = kept_candidates(anchors, targets, art)
    kept = store.written(kept)
    if stage1_only:
        least = art.config.tau if tau is None else tau
        return features.best_parent(kept, "p1", least).select("tgt_id", "s1_id", "p1", F.col("p1").alias("p2")), kept
    least = (art.config.tau if art.tau is None else art.tau) if tau is None else tau
    final = learn.probability(art.model2, stage2_pairs(kept, anchors, targets, art), features.STAGE2, "p2")
    return features.best_parent(final, "p2", least).select("tgt_id", "s1_id", "p1", "p2"), kept


def prep(anchors: DataFrame, art: Artefacts) -> DataFrame:
    """(s1_id, fold) of a new corpus; artefacts of another corpus have seen none of its targets."""
    art.biased = None
    return anchors.select(F.col("entity_id").alias("s1_id"), keys.fold_of(F.col("entity_id"), art.config.seed).alias("fold"))


def link(anchors: DataFrame, targets: DataFrame, links: DataFrame, config: Config) -> tuple[DataFrame, float, Artefacts]:
    """Fit, candidates and stage 2: (decided, tau, artefacts).

    The inputs are written first: every step reads them, and what they come from would stand in each of its plans.
    """
    anchors, targets, links = (store.written(x) for x in (anchors, targets, links))
    art = fit(anchors, targets, links, config)
    final, report = stage2(store.written(kept_candidates(anchors, targets, art, art.pairs)[1]), anchors, targets, links, art)
    return final.where(F.col("p2") >= report["tau"]), report["tau"], art


VERBS = ("all", "fit", "candidates", "stage2", "prep", "predict", "evaluate", "validate", "merge", "diagnose")


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description="Link noisy records to reference records.")
    parser.add_argument("verb", choices=VERBS)
    for name in ("s1", "targets", "truth", "matches", "candidate-lists", "artefacts", "out", "country"):
        parser.add_argument(f"--{name}", help="comma-separated paths" if name in ("targets", "matches") else None)
    parser.add_argument("--stage1-only", action="store_true")
    parser.add_argument("--cut", type=float, help="threshold of predict instead of the tuned one")
    for name, value in asdict(Config()).items():
        parser.add_argument(f"--{name.replace('_', '-')}", type=type(value), default=value)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    config = Config(**{k: getattr(args, k) for k in asdict(Config())})
    s1 = tsv.read_tsv(spark, args.s1)
    if args.country:
        s1 = s1.where(F.col("country") == args.country)
    if args.verb == "merge":
        merged = metrics.merge(s1, [store.read_country_lists(spark, *args.matches.split(","))])
        tsv.write_tsv(merged.select(F.col("s1").alias("source1_entity_id"), F.col("value").alias("matched_entity_ids")), args.out)
        return 0
    if args.verb == "validate":
        fatal, found = tsv.validate(spark, args.matches, s1, args.candidate_lists)
        for line in fatal:
            print(line, file=sys.stderr)
        if found is not None:
            found.show(truncate=False)
            fatal += [r["rule"] for r in found.where("fatal").select("rule").collect()]
        return int(bool(fatal))
    truth = tsv.links(tsv.read_tsv(spark, args.truth, ["source1_entity_id", "matched_entity_ids"]), s1) if args.truth else None
    if args.verb == "evaluate":
        found = tsv.links(tsv.read_tsv(spark, args.matches, ["source1_entity_id", "matched_entity_ids"]))
        metrics.segments(metrics.entity_scores(s1.select("entity_id", "country"), truth, found)).show(truncate=False)
        return 0
    s1 = sampling.sampled_anchors(s1, config.frac)
    targets = tsv.read_tsv(spark, args.targets.split(","))
    if truth is not None:
        truth = truth.join(s1.select(F.col("entity_id").alias("s1_id")), "s1_id", "left_semi")
        targets = sampling.included_targets(targets, truth, config.frac)
    targets = sampling.wanted_targets(targets, args.country)
    if args.verb in ("all", "fit"):
        fitted = fit(s1, targets, truth, config)
        fitted.save(spark, args.artefacts)
    art = Artefacts.load(spark, args.artefacts)
    if args.verb == "prep":
        prep(s1, art).write.mode("overwrite").parquet(f"{args.out}/folds")
        art.save(spark, f"{args.out}/artefacts")
    if args.verb in ("all", "candidates"):
        store.write_by_country(kept_candidates(s1, targets, art, fitted.pairs if args.verb == "all" else None)[1], f"{args.out}/candidates")
    if args.verb in ("all", "stage2"):
        final, report = stage2(store.read_by_country(spark, f"{args.out}/candidates"), s1, targets, truth, art)
        final.write.mode("overwrite").parquet(f"{args.out}/scored")
        art.save(spark, f"{args.artefacts}_stage2")
        store.write_json(spark, f"{args.out}/stage2.json", report)
        print(json.dumps(report))
    if args.verb == "predict":
        decided, kept = predict(s1, targets, art, args.stage1_only, args.cut)
        suffix = f"_{args.country}" if args.country else ""
        tsv.write_tsv(tsv.id_lists(s1, decided), f"{args.out}/matching_results{suffix}")
        tsv.write_tsv(tsv.id_lists(s1, kept, "p1"), f"{args.out}/candidate_pairs{suffix}")
    if args.verb == "diagnose":
        scored, kept = kept_candidates(s1, targets, art)
        diagnose.recall_at(scored, truth, s1, ["name", "addr", "enc"]).show(truncate=False)
        diagnose.volume(scored, targets, scored.where("deep"), config.m_max).show(truncate=False)
        diagnose.pruning(scored, truth, art.floor).show(truncate=False)
        diagnose.kept_counts(scored, kept, truth).show(truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
