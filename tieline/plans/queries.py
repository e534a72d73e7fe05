"""Registered queries over the portable fixture, and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tieline.functions import fuzzy, keys, text
from tieline.functions.script import Script, learn_script, units
from tieline.operators import classes, features, learn, metrics, sampling, vectors
from tieline.plans import diagnose, pipeline
from tieline.sources import fixture, store, tsv

NOISE = frozenset({"pvt", "ltd", "llc", "inc", "limited"})
ADDRESS_LEXICON = {"rd": "road", "st": "street", "ave": "avenue"}
ART = pipeline.Artefacts(pipeline.Config(max_df_frac=0.2, lexicon_min_count=5, noise_min_count=20, trees=8, depth=4), {}, ADDRESS_LEXICON, NOISE)
K, KD, TAU = vectors.K, vectors.K_DEEP, 0.6

# ---------------------------------------------------------------- DuckDB side

SQL_WORDS = """
a as ({anchors}), t as ({targets}), truth as ({truth}),
recs as (select 'a' as side, * from a union all select 't' as side, * from t),
folded as (select side, entity_id, country, replace(strip_accents(lower(business_name)), '''', '') as name, replace(strip_accents(lower(business_address)), '''', '') as addr from recs),
toks as (select *, regexp_extract_all(replace(name, 'l.l.c.', 'llc'), '[a-z0-9]+') as raw,
  list_transform(regexp_extract_all(addr, '[a-z0-9]+'), lambda x: case x when 'rd' then 'road' when 'st' then 'street' when 'ave' then 'avenue' else x end) as addr_tokens from folded),
views as (select *, case when len(list_filter(raw, lambda x: x not in ('pvt', 'ltd', 'llc', 'inc', 'limited'))) > 0
  then list_filter(raw, lambda x: x not in ('pvt', 'ltd', 'llc', 'inc', 'limited')) else raw end as core_tokens,
  list_sort(list_distinct(list_transform(regexp_extract_all(array_to_string(addr_tokens, ' '), '[0-9]+'), lambda x: case when ltrim(x, '0') = '' then '0' else ltrim(x, '0') end))) as nums from toks)
""".format(anchors=fixture.sql(fixture.ANCHORS), targets=fixture.sql(fixture.TARGETS), truth=fixture.sql(fixture.TRUTH))

SQL_NAME_BAG = """
name_grams as (select side, entity_id, country, s, unnest(range(1, length(s) - 1)) as i from (select *, '^' || array_to_string(core_tokens, '') || '$' as s from views where len(core_tokens) > 0)),
name_bag as (select side, entity_id, country, feature, sum(tf)::double as tf from (
  select side, entity_id, country, 'w' || unnest(core_tokens) as feature, 2.0 as tf from views
  union all select side, entity_id, country, 'g' || substr(s, i, 3), 1.0 from name_grams
  union all select side, entity_id, country, 'i' || case when len(core_tokens) >= 2 then array_to_string(list_transform(core_tokens, lambda x: x[1]), '') else core_tokens[1] end, 1.0
    from views where len(core_tokens) >= 2 or regexp_full_match(core_tokens[1], '[a-z]{2,4}')) group by all)
"""
SQL_RAW_BAG = """
raw_grams as (select side, entity_id, country, s, unnest(range(1, length(s) - 1)) as i from (select *, '^' || array_to_string(raw, ' ') || '$' as s from views)),
raw_bag as (select side, entity_id, country, 'r' || substr(s, i, 3) as feature, count(*)::double as tf from raw_grams where length(s) >= 3 group by all)
"""
SQL_ADDR_BAG = """
spots as (select side, entity_id, country, addr_tokens as ts, unnest(range(1, len(addr_tokens) + 1)) as i from views),
addr_words as (select *, ts[i] as w, regexp_full_match(ts[i], '[a-z]+') as alpha from spots),
runs as (select *, case when ltrim(x, '0') = '' then '0' else ltrim(x, '0') end as n from (select *, unnest(regexp_extract_all(w, '[0-9]+')) as x from addr_words where not alpha)),
cuts as (select *, unnest(range(1, length(n) + 1)) as j from runs where length(n) >= 3),
sides as (select *, unnest([i - 1, i + 1]) as o from runs),
addr_bag as (select side, entity_id, country, feature, sum(tf)::double as tf from (
  select side, entity_id, country, 'a' || w as feature, 1.0 as tf from addr_words where alpha and length(w) >= 2
  union all select side, entity_id, country, 'm' || w, 1.0 from addr_words where not alpha and not regexp_full_match(w, '[0-9]+')
  union all select side, entity_id, country, 'n' || n, 1.5 from runs
  union all select side, entity_id, country, 'd' || n, 0.5 from runs where length(n) >= 2
  union all select side, entity_id, country, 'd' || substr(n, 1, j - 1) || substr(n, j + 1), 0.5 from cuts
  union all select side, entity_id, country, 'c' || n || '|' || ts[o], 1.0 from sides where o >= 1 and o <= len(ts) and regexp_full_match(ts[o], '[a-z]{3,}')) group by all)
"""


def sql_vectors(c: str) -> str:
    return f"""
{c}_idf as (select feature, count(*) as df, ln(((select count(*) from a) + 1.0) / (count(*) + 1.0)) + 1 as idf, count(*) > 0.2 * (select count(*) from a) as pruned from {c}_bag where side = 'a' group by feature),
{c}_med as (select median(idf) as m from {c}_idf),
{c}_v as (select side, entity_id, country, b.feature, (case when tf > 1 then 1 + ln(tf) else tf end) * coalesce(idf, m) as v, coalesce(pruned, false) as pruned from {c}_bag b left join {c}_idf i on b.feature = i.feature, {c}_med),
{c}_w as (select *, v / sqrt(sum(v * v) over (partition by side, entity_id)) as w from {c}_v),
{c}_s as (select x.entity_id as tgt_id, y.entity_id as s1_id, sum(x.w * y.w) as score from {c}_w x join {c}_w y on x.country = y.country and x.feature = y.feature
  where x.side = 't' and y.side = 'a' and not x.pruned and not y.pruned group by all),
{c}_r as (select *, row_number() over (partition by tgt_id order by round(score, 9) desc, s1_id) - 1 as rank from {c}_s),
{c}_top as (select * from {c}_r where rank < 10)
"""


SQL_PAIRS = """
both_ch as (select tgt_id, s1_id, 'name' as ch, rank from name_top union all select tgt_id, s1_id, 'addr', rank from addr_top),
pairs0 as (select tgt_id, s1_id, coalesce(min(case when ch = 'name' then rank end), 128) as rank_name, coalesce(min(case when ch = 'addr' then rank end), 128) as rank_addr,
  count(*) as n_channels, sum(1.0 / (60 + rank)) as rrf from both_ch group by all),
cos_n as (select p.tgt_id, p.s1_id, sum(x.w * y.w) as c from pairs0 p join name_w x on x.side = 't' and x.entity_id = p.tgt_id join name_w y on y.side = 'a' and y.entity_id = p.s1_id and y.feature = x.feature group by all),
cos_a as (select p.tgt_id, p.s1_id, sum(x.w * y.w) as c from pairs0 p join addr_w x on x.side = 't' and x.entity_id = p.tgt_id join addr_w y on y.side = 'a' and y.entity_id = p.s1_id and y.feature = x.feature group by all),
pairs as (select p.*, coalesce(n.c, 0) as cos_name, coalesce(d.c, 0) as cos_addr, round(0.5 * coalesce(n.c, 0) + 0.5 * coalesce(d.c, 0), 6) as p1
  from pairs0 p left join cos_n n using (tgt_id, s1_id) left join cos_a d using (tgt_id, s1_id)),
best as (select * from (select *, row_number() over (partition by tgt_id order by p1 desc, s1_id) - 1 as r from pairs) where r = 0),
decided as (select * from best where p1 >= 0.6)
"""
SQL_SCORES = """
n_true as (select s1_id, count(*) as n_true from truth group by all), n_pred as (select s1_id, count(*) as n_pred from decided group by all),
n_tp as (select s1_id, count(*) as tp from decided join truth using (tgt_id, s1_id) group by all),
base as (select entity_id as s1_id, country, coalesce(n_true, 0) as n_true, coalesce(n_pred, 0) as n_pred, coalesce(tp, 0) as tp from a left join n_true on n_true.s1_id = entity_id left join n_pred on n_pred.s1_id = entity_id left join n_tp on n_tp.s1_id = entity_id),
pr as (select *, case when n_true = 0 then (case when n_pred = 0 then 1.0 else 0.0 end) when n_pred = 0 then 0.0 else tp / n_pred end as p, case when n_true = 0 then (case when n_pred = 0 then 1.0 else 0.0 end) else tp / n_true end as r from base),
scores as (select *, case when n_true = 0 then p when 0.25 * p + r > 0 then 1.25 * p * r / (0.25 * p + r) else 0.0 end as f from pr)
"""
NAMES, ADDRESSES = f"with {SQL_WORDS}, {SQL_NAME_BAG}", f"with {SQL_WORDS}, {SQL_ADDR_BAG}"
SEARCH = f"{NAMES}, {sql_vectors('name')}"
PAIRS = f"{SEARCH}, {SQL_ADDR_BAG}, {sql_vectors('addr')}, {SQL_PAIRS}"
SCORED = f"{PAIRS}, {SQL_SCORES}"

# ---------------------------------------------------------------- Spark side


def _records(spark: SparkSession, d: str) -> DataFrame:
    a, t = fixture.anchors(spark, d).withColumn("side", F.lit("a")), fixture.targets(spark, d).withColumn("side", F.lit("t"))
    return pipeline.views(a.unionByName(t), ART)


def _side(spark: SparkSession, d: str, side: str) -> DataFrame:
    return pipeline.views((fixture.anchors if side == "a" else fixture.targets)(spark, d), ART)


#: Channel to token column and bag.
BAGS = {"name": ("core_tokens", text.name_bag), "addr": ("addr_tokens", text.address_bag), "raw": ("raw", text.raw_bag)}


def _bags(spark: SparkSession, d: str, kind: str) -> tuple[DataFrame, DataFrame]:
    column, make = BAGS[kind]
    return tuple(text.long_bag(_side(spark, d, s), make(F.col(column))) for s in "at")


#: What several queries of one session build on: tables in the shared store, by what they are made from and when that was changed.
_KEPT: dict[tuple, object] = {}


def _once(spark: SparkSession, d: str, name: tuple, make):
    key = (spark.sparkContext.applicationId, d, *name, *(store.modified(spark, f"{d}/{t}.parquet") for t in fixture.TABLES))
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


def _classes(spark: SparkSession, d: str, side: str) -> classes.Classes:
    """Anchors (a) or targets (t) by equal name and address tokens."""
    records = fixture.anchors if side == "a" else fixture.targets
    return _once(spark, d, ("classes", side), lambda: classes.Classes(records(spark, d), lambda rows: pipeline.views(rows, ART), {c: BAGS[c][0] for c in ("name", "addr")}))


def _class_bag(spark: SparkSession, d: str, side: str, kind: str) -> DataFrame:
    column, make = BAGS[kind]
    return text.long_bag(_classes(spark, d, side).of[kind], make(F.col(column)), ("entity_id", "country", "n"))


def _idf(spark: SparkSession, d: str, kind: str) -> vectors.Idf:
    return vectors.fit_idf(_class_bag(spark, d, "a", kind), fixture.anchors(spark, d).count(), ART.config.max_df_frac)


def _weights(spark: SparkSession, d: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """Weighted bags of the anchors' and the targets' classes, each under its smallest id."""
    def make():
        bags = tuple(store.written(_class_bag(spark, d, s, kind)) for s in "at")
        idf = vectors.fit_idf(bags[0], fixture.anchors(spark, d).count(), ART.config.max_df_frac)
        return tuple(store.written(vectors.weigh(b.drop("n"), idf)) for b in bags)

    return _once(spark, d, (kind,), make)


def _class_hits(spark: SparkSession, d: str, kind: str, k: int = K) -> DataFrame:
    """The best anchors of each class of targets."""
    a, t = _weights(spark, d, kind)
    return _once(spark, d, (kind, k), lambda: store.written(classes.member_hits(vectors.sparse_search(t, a, k), _classes(spark, d, "a").by(kind), k)))


def _hits(spark: SparkSession, d: str, kind: str, k: int = K) -> DataFrame:
    return _classes(spark, d, "t").each(_class_hits(spark, d, kind, k), channel=kind)


def _class_union(spark: SparkSession, d: str) -> DataFrame:
    of = _classes(spark, d, "t")
    return vectors.union_channels({c: of.of_profiles(_class_hits(spark, d, c), c) for c in ("name", "addr")})


def _union(spark: SparkSession, d: str) -> DataFrame:
    return _classes(spark, d, "t").each(_class_union(spark, d))


def _class_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The pairs of one target for each class of equal ones; ``_each`` gives them to all of its targets."""
    def make():
        out, a, t = store.written(_class_union(spark, d)), _classes(spark, d, "a"), _classes(spark, d, "t")
        for c in ("name", "addr"):
            wa, wt = _weights(spark, d, c)
            out = classes.class_cosine(out, t, a, c, lambda pairs: vectors.pair_cosine(pairs, wt, wa, f"cos_{c}"), f"cos_{c}")
        return store.written(out.withColumn("p1", F.round(0.5 * F.col("cos_name") + 0.5 * F.col("cos_addr"), 6)))

    return _once(spark, d, ("pairs",), make)


def _each(spark: SparkSession, d: str, rows: DataFrame) -> DataFrame:
    return _classes(spark, d, "t").each(rows)


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return _each(spark, d, _class_pairs(spark, d))


def _best(spark: SparkSession, d: str, tau: float = 0.0) -> DataFrame:
    """The best anchor of each target: it is the same for equal targets."""
    return _each(spark, d, features.best_parent(_class_pairs(spark, d), "p1", tau))


def _decided(spark: SparkSession, d: str) -> DataFrame:
    return _best(spark, d, TAU)


def _scores(spark: SparkSession, d: str) -> DataFrame:
    anchors = fixture.anchors(spark, d).select("entity_id", "country")
    return _once(spark, d, ("scores",), lambda: store.written(metrics.entity_scores(anchors, fixture.truth(spark, d), _decided(spark, d))))


def _six(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in columns})  # no negative zero


def _long(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("long").alias(c) if t in ("int", "tinyint") else F.col(c) for c, t in df.dtypes])


def _joined(column: str):
    return lambda s, d: _records(s, d).select("side", "entity_id", F.array_join(column, " ").alias("v"))


def _bag(kind: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        a, t = _bags(spark, d, kind)
        return _six(a.withColumn("side", F.lit("a")).unionByName(t.withColumn("side", F.lit("t"))).select("side", "entity_id", "feature", "tf"), "tf")

    return run


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _tokens_of_documents(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of all documents of all languages, A-Z lower-cased."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    found = F.regexp_extract_all(F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER), F.lit("[a-z0-9]+"), F.lit(0))
    return docs.select("doc_id", F.size(found).cast("long").alias("n"), F.size(F.array_distinct(found)).cast("long").alias("distinct_n"))


def _adaptive(spark: SparkSession, d: str) -> DataFrame:
    empty = _side(spark, d, "t").where(F.size("addr_tokens") == 0).select(F.col("entity_id").alias("tgt_id"))
    deep = vectors.adaptive(_hits(spark, d, "name", KD), empty, K)
    return deep.groupBy("tgt_id").agg(F.count("*").alias("n"), F.max("deep").alias("deep"), F.round(F.max("score"), 6).alias("top"))


def _embeddings(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    return e.select(F.col("vec_id").cast("string").alias("entity_id"), F.lit("all").alias("country"), F.col("embedding").alias("vec"), "vec_id")


def _dense(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest of all vectors for every vector whose id is divisible by 50."""
    e = _embeddings(spark, d)
    return _long(vectors.dense_search(e.where("vec_id % 50 = 0"), e, 5).select("tgt_id", "s1_id", "rank", F.round("score", 5).alias("score")))


def _cells(spark: SparkSession, d: str) -> DataFrame:
    """The same by the cell index; tests hold its recall against the exact search."""
    e = _embeddings(spark, d)
    found = vectors.cell_search(e.where("vec_id % 50 = 0"), e, vectors.CellIndex.fit(e, 32), 5, 16)
    return _long(found.select("tgt_id", "s1_id", "rank", F.round("score", 5).alias("score")))


def _groups(spark: SparkSession, d: str) -> DataFrame:
    out = _each(spark, d, features.second_gap(features.group_features(_class_pairs(spark, d), ("name", "addr")), "cos_name", "second_gap"))
    return _six(_long(out.select("tgt_id", "s1_id", "union_size", "qrank_name", "qrank_addr", "gap_name", "gap_addr", "max_name", "max_addr", "second_gap")), "gap_name", "gap_addr", "max_name", "max_addr", "second_gap")


def _competition(spark: SparkSession, d: str) -> DataFrame:
    out = features.competition(_pairs(spark, d)).select("tgt_id", "s1_id", *features.COMPETITION)
    return _six(_long(out), "p1", "p1_margin_t", "s1_sum_p1", "s1_max_p1", "p1_gap_s1")


def _fuzzy(spark: SparkSession, d: str) -> DataFrame:
    links = fixture.truth(spark, d)
    t, a = (_side(spark, d, s).select(F.col("entity_id").alias(k), F.col("name").alias(n)) for s, k, n in (("t", "tgt_id", "x"), ("a", "s1_id", "y")))
    return links.join(t, "tgt_id").join(a, "s1_id").select("tgt_id", "s1_id", F.round(fuzzy.score("jaro_winkler", F.col("x"), F.col("y")), 6).alias("jw"))


def _all_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    out = features.string_features(_decided(spark, d).select("tgt_id", "s1_id"), _side(spark, d, "t"), _side(spark, d, "a"))
    return _six(out.select("tgt_id", "s1_id", *features.STRINGS), *features.STRINGS)


def _numbers_features(spark: SparkSession, d: str) -> DataFrame:
    return _all_fuzzy(spark, d).select("tgt_id", "s1_id", "core_equal", "raw_equal", "t_addr_empty", "num_shared", "num_conflict", "num_t", "num_s", "len_t", "len_s")


def _link_tokens(spark: SparkSession, d: str, column: str) -> DataFrame:
    return learn.token_pairs(fixture.truth(spark, d), _side(spark, d, "a"), _side(spark, d, "t"), column)


def _lexicon(spark: SparkSession, d: str) -> DataFrame:
    plain = pipeline.Artefacts()
    pairs = learn.token_pairs(fixture.truth(spark, d), pipeline.views(fixture.anchors(spark, d), plain), pipeline.views(fixture.targets(spark, d), plain), "addr_raw")
    return learn.lexicon_counts(pairs).where("n >= 5")


def _noise(spark: SparkSession, d: str) -> DataFrame:
    return learn.noise_counts(_link_tokens(spark, d, "raw"))


def _lists(spark: SparkSession, d: str) -> DataFrame:
    return _once(spark, d, ("lists",), lambda: store.written(tsv.id_lists(fixture.anchors(spark, d), _decided(spark, d), "p1")))


def _segments(spark: SparkSession, d: str) -> DataFrame:
    return _six(metrics.segments(_scores(spark, d)), "p", "r", "f05")


def _recall(spark: SparkSession, d: str) -> DataFrame:
    name, addr = _hits(spark, d, "name"), _hits(spark, d, "addr")
    hits = {"name": name, "addr": addr, "either": name.select("tgt_id", "s1_id").union(addr.select("tgt_id", "s1_id"))}
    return _six(metrics.recall(hits, fixture.truth(spark, d), fixture.anchors(spark, d)), *hits)


def _findings(spark: SparkSession, d: str) -> DataFrame:
    """A spoiled copy of the results: bad prefixes, self matches, repeats, a missing and an unknown anchor."""
    good = _lists(spark, d).select(F.col("source1_entity_id").alias("s1"), F.col("matched_entity_ids").alias("value"))
    k = F.substring("s1", 4, 20).cast("long")
    bad = good.where(k % 50 != 3).withColumn("value", F.when(k % 50 == 1, F.concat(F.lit("X-1,"), "value")).when(k % 50 == 2, F.lit("S1-1,S2-9,S2-9")).otherwise(F.col("value")))
    bad = bad.unionByName(good.where(k % 50 == 4)).unionByName(good.where(k == 10).withColumn("s1", F.lit("S1-nobody")))
    out = metrics.findings(bad, good.select("s1"))
    return out.select("rule", "n", F.array_join("examples", ",").alias("examples"))


def _outside(spark: SparkSession, d: str) -> DataFrame:
    return metrics.outside_candidates(fixture.truth(spark, d), _union(spark, d))


def _ambiguity(spark: SparkSession, d: str) -> DataFrame:
    missed = fixture.truth(spark, d).join(_decided(spark, d), ["tgt_id", "s1_id"], "left_anti").select("s1_id")
    return metrics.ambiguity(missed, _side(spark, d, "a").select("entity_id", "country", "core"))


def _ties(spark: SparkSession, d: str) -> DataFrame:
    kept = _decided(spark, d).select("tgt_id", "s1_id", F.lit(1).alias("kept"))
    pairs = pipeline.labelled(_pairs(spark, d), fixture.truth(spark, d)).join(kept, ["tgt_id", "s1_id"], "left").fillna(0, ["kept"])
    return metrics.tie_histogram(pairs, ("cos_name", "cos_addr"))


def _tau(spark: SparkSession, d: str) -> DataFrame:
    return _six(metrics.tau_grid(fixture.anchors(spark, d), fixture.truth(spark, d), _best(spark, d), "p1"), "f05")


def _floor(spark: SparkSession, d: str) -> DataFrame:
    rows = pipeline.labelled(features.competition(_pairs(spark, d)), fixture.truth(spark, d))
    return _six(metrics.floor_grid(rows, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7]), "recall")


INDIC = [("ग्रीन बिल्डर्स", "green builders"), ("ग्रीन", "green"), ("बिल्डर्स", "builders"), ("प्रा", "pra"), ("लिमिटेड", "limited"), ("কলকাতা", "kolkata")]


def _script(spark: SparkSession, d: str) -> DataFrame:
    """Folded Indic words, their units, and what a table learned from the same words makes of them."""
    df = spark.createDataFrame(INDIC, "w string, latin string").withColumn("tokens", text.raw_tokens(text.fold(F.col("w"))))
    pairs = {(r["z"]["a"], r["z"]["b"]): 3 for r in df.select(F.explode(F.arrays_zip(F.col("tokens").alias("a"), F.split("latin", " ").alias("b"))).alias("z")).collect()}
    script: Script = learn_script(pairs, min_mass=0.5)
    cut = F.udf(lambda ts: [u for t in ts for u in units(t)], "array<string>")
    out = df.withColumn("out", script.latin_column(F.col("tokens")))
    return out.select("w", F.array_join("tokens", " ").alias("tokens"), F.array_join(cut("tokens"), " ").alias("units"), F.array_join("out", " ").alias("latin"), F.array_join(script.sound_column(F.col("out")), " ").alias("sound"))


CONFIG = pipeline.Config(max_df_frac=0.2, lexicon_min_count=5, noise_min_count=20, trees=8, depth=4, encoder_epochs=2)


def _models(spark: SparkSession, d: str) -> DataFrame:
    """Fit, candidates and stage 2 end to end; the accepted link of each target."""
    return pipeline.link(fixture.anchors(spark, d), fixture.targets(spark, d), fixture.truth(spark, d), CONFIG)[0]


def _predict(spark: SparkSession, d: str) -> DataFrame:
    """Learn from the second source, save, load, and decide the third source, which nothing was learned from."""
    a, t, links = (store.written(x(spark, d)) for x in (fixture.anchors, fixture.targets, fixture.truth))
    second = t.where("entity_id like 'S2-%'")
    of = links.where("tgt_id like 'S2-%'")
    art = pipeline.fit(a, second, of, CONFIG)
    pipeline.stage2(store.written(pipeline.kept_candidates(a, second, art, art.pairs)[1]), a, second, of, art)
    path = store.scratch(spark)
    art.save(spark, path)
    return pipeline.predict(a, t.where("entity_id like 'S3-%'"), pipeline.Artefacts.load(spark, path))[0]


def _features27(spark: SparkSession, d: str) -> DataFrame:
    out = pipeline.candidates(fixture.anchors(spark, d), fixture.targets(spark, d), ART)
    return _six(_long(out.select("tgt_id", "s1_id", *features.STAGE1)), *[c for c in features.STAGE1 if c.split("_")[0] in ("cos", "gap", "max", "second")])


def _stream(spark: SparkSession, d: str) -> DataFrame:
    """The targets, written as files and read as a stream, scored against static anchors."""
    from tieline.streaming.candidates import stream_candidates

    folder = store.scratch(spark)
    fixture.targets(spark, d).repartition(2).write.parquet(f"{folder}/targets")
    schema = fixture.targets(spark, d).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/targets")
    stream_candidates(stream, fixture.anchors(spark, d), ART, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("tgt_id", "s1_id", F.col("n_channels").cast("long").alias("n_channels"))


def _sampled_links(spark: SparkSession, d: str) -> DataFrame:
    active = sampling.sampled_anchors(fixture.anchors(spark, d), 0.3).select(F.col("entity_id").alias("s1_id"))
    return fixture.truth(spark, d).join(active, "s1_id", "left_semi")


def _parts(spark: SparkSession, d: str) -> DataFrame:
    return sampling.disjoint_links(fixture.truth(spark, d), 300, 200).select("tgt_id", "s1_id", F.col("part").cast("long").alias("part"))


def _wanted(spark: SparkSession, d: str) -> DataFrame:
    wanted = fixture.truth(spark, d).where("tgt_id like 'S2-%'").select(F.col("tgt_id").alias("entity_id"))
    return sampling.wanted_targets(fixture.targets(spark, d), "ASIA", wanted, 1, 4).select("entity_id")


def _by_country(spark: SparkSession, d: str) -> DataFrame:
    """Decided pairs through the sink by country, written twice: the second time replaces the first."""
    path, rows = store.scratch(spark), _decided(spark, d).join(fixture.anchors(spark, d).select(F.col("entity_id").alias("s1_id"), "country"), "s1_id").select("tgt_id", "s1_id", "country")
    store.write_by_country(rows, path)
    store.write_by_country(rows.where("country = 'ASIA'"), path)
    return store.read_by_country(spark, path).select("tgt_id", "s1_id", "country")


def _pair_block(spark: SparkSession, d: str) -> DataFrame:
    path = store.scratch(spark)
    store.write_pairs(pipeline.labelled(_pairs(spark, d), fixture.truth(spark, d)), path, ["n_channels", "rank_name", "rank_addr"])
    return store.read_pairs(spark, path).select("tgt_id", "s1_id", *[F.col(c).cast("long").alias(c) for c in ("label", "n_channels", "rank_name", "rank_addr")])


def _id_set(spark: SparkSession, d: str) -> DataFrame:
    path = store.scratch(spark)
    tsv.write_tsv(fixture.anchors(spark, d).unionByName(fixture.anchors(spark, d).limit(5)), path)
    return store.read_ids(spark, path)


def _country_lists(spark: SparkSession, d: str) -> DataFrame:
    path, lists = store.scratch(spark), _lists(spark, d)
    for part, rest in (("even", 0), ("odd", 1)):
        rows = lists.where(F.substring("source1_entity_id", 4, 20).cast("long") % 2 == rest).select(F.concat_ws("\t", "source1_entity_id", "matched_entity_ids").alias("value"))
        rows.write.option("compression", "gzip" if rest else "none").text(f"{path}/{part}")
    return metrics.merge(fixture.anchors(spark, d), [store.read_country_lists(spark, f"{path}/even", f"{path}/odd")])


def _missed(spark: SparkSession, d: str) -> DataFrame:
    missed = sampling.difference(fixture.truth(spark, d), _decided(spark, d))
    return store.missed_sample(missed, _best(spark, d), fixture.targets(spark, d), fixture.anchors(spark, d), 50)


def _summary(spark: SparkSession, d: str) -> DataFrame:
    path = f"{store.scratch(spark)}/summary.json"
    store.write_json(spark, path, {"anchors": fixture.anchors(spark, d).count(), "links": fixture.truth(spark, d).count()})
    return spark.createDataFrame(sorted(store.read_json(spark, path).items()), "name string, n long")


def _recall_at(spark: SparkSession, d: str) -> DataFrame:
    out = diagnose.recall_at(_union(spark, d), fixture.truth(spark, d), fixture.anchors(spark, d), ["name", "addr"], (5, 10))
    return _six(out, "name", "addr", "any", "fused_5", "fused_10")


def _volume(spark: SparkSession, d: str) -> DataFrame:
    empty = _side(spark, d, "t").where(F.size("addr_tokens") == 0).select(F.col("entity_id").alias("tgt_id"))
    return _six(diagnose.volume(_union(spark, d), fixture.targets(spark, d), empty, 8), "per_target", "per_target_capped", "deep_share")


def _kept(spark: SparkSession, d: str) -> DataFrame:
    pairs = _pairs(spark, d).join(fixture.anchors(spark, d).select(F.col("entity_id").alias("s1_id"), "country"), "s1_id")
    return diagnose.kept_counts(pairs, features.prune(pairs, 3, 0.2), fixture.truth(spark, d))


def _pruning(spark: SparkSession, d: str) -> DataFrame:
    return _six(_long(diagnose.pruning(_pairs(spark, d), fixture.truth(spark, d), 0.2)), "recall", "kept_per_target")


def _ceiling(spark: SparkSession, d: str) -> DataFrame:
    return _six(diagnose.ceiling(fixture.anchors(spark, d), fixture.truth(spark, d), _each(spark, d, features.prune(_class_pairs(spark, d), 1, 0.5))), "p", "r", "f05")


def _perfect(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).select("s1_id", F.round(metrics.f05_of_recall(F.col("r")), 6).alias("f05"))


def _flagship(spark: SparkSession, d: str) -> DataFrame:
    return _segments(spark, d)


QUERIES = {
    "flagship_link_and_score": _flagship,
    "p2_code_roundtrip": lambda s, d: fixture.targets(s, d).select("entity_id", keys.id_code(F.col("entity_id")).alias("code"), keys.code_id(keys.id_code(F.col("entity_id"))).alias("back")),
    "p3_hash_sample": lambda s, d: fixture.anchors(s, d).select("entity_id", keys.product_hash(keys.id_code(F.col("entity_id"))).alias("h"), keys.hash_sampled(keys.id_code(F.col("entity_id")), 0.3).alias("sampled"), keys.hash_slice(keys.id_code(F.col("entity_id")), 4).alias("slice")),
    "p6_folds": lambda s, d: fixture.anchors(s, d).select("entity_id", keys.fold_of(F.col("entity_id")).alias("fold")),
    "p12_truth_links": lambda s, d: tsv.links(_lists(s, d)),
    "t1_fold": lambda s, d: _records(s, d).select("side", "entity_id", "name", "addr"),
    "t3_tokens": _joined("raw"),
    "t3_document_tokens": _tokens_of_documents,
    "t8_lexicon": _joined("addr_tokens"),
    "t9_core": _joined("core_tokens"),
    "t15_numbers": _joined("nums"),
    "t16_deletes": _joined("dels"),
    "t5_t6_t7_script": _script,
    "t11_name_bag": _bag("name"),
    "t12_raw_bag": _bag("raw"),
    "t13_addr_bag": _bag("addr"),
    "t18_jaro_winkler": _fuzzy,
    "t18_string_features": _all_fuzzy,
    "m3_idf": lambda s, d: _six(_idf(s, d, "name").table, "idf"),
    "m4_tfidf_norm": lambda s, d: _six(_classes(s, d, "t").each(_weights(s, d, "addr")[1].select("entity_id", "feature", "w", "pruned"), "entity_id", "addr"), "w"),
    "m6_dot": lambda s, d: _dense(s, d).select("tgt_id", "score"),
    "j2_sparse_topk": lambda s, d: _six(_long(_hits(s, d, "name")), "score"),
    "j2_address_topk": lambda s, d: _six(_long(_hits(s, d, "addr")), "score"),
    "k3_adaptive_depth": _adaptive,
    "j3_vector_topk": _dense,
    "j5_channel_union": lambda s, d: _six(_long(_union(s, d)), "rrf"),
    "w8_true_rank": lambda s, d: vectors.true_rank(_union(s, d), fixture.truth(s, d)),
    "m5_pair_cosine": lambda s, d: _six(_pairs(s, d).select("tgt_id", "s1_id", "cos_name", "cos_addr", "p1"), "cos_name", "cos_addr"),
    "w1_w3_group_features": _groups,
    "w5_w6_a8_competition": _competition,
    "pair_features27": _features27,
    "pair_number_features": _numbers_features,
    "l4_lexicon_counts": _lexicon,
    "l5_noise_counts": _noise,
    "l10_l12_models": _models,
    "l11_floor": _floor,
    "l13_tau_grid": _tau,
    "w7_one_parent": lambda s, d: _decided(s, d).select("tgt_id", "s1_id", "p1"),
    "k4_pruned": lambda s, d: _each(s, d, features.prune(_class_pairs(s, d), 3, 0.2)).select("tgt_id", "s1_id", "p1"),
    "s7_results": _lists,
    "s8_match_lists": lambda s, d: tsv.match_lists(_lists(s, d)).select("s1_id", F.array_join("ids", ",").alias("ids"), "n_rows"),
    "m10_entity_scores": lambda s, d: _six(_scores(s, d), "p", "r", "f"),
    "a10_segments": _segments,
    "a11_micro": lambda s, d: _six(metrics.micro(_scores(s, d)), "p", "r", "f05"),
    "a12_recall": _recall,
    "a14_ambiguity": _ambiguity,
    "a18_tie_histogram": _ties,
    "v10_findings": _findings,
    "v11_merge": lambda s, d: metrics.merge(fixture.anchors(s, d), [_lists(s, d).select(F.col("source1_entity_id").alias("s1"), F.col("matched_entity_ids").alias("value"))]),
    "j11_outside_candidates": _outside,
    "v2_candidates_stream": _stream,
    "v5_fit_save_predict": _predict,
    "v4_prep": lambda s, d: _long(pipeline.prep(fixture.anchors(s, d), pipeline.Artefacts())),
    "p5_included_targets": lambda s, d: sampling.included_targets(fixture.targets(s, d), _sampled_links(s, d), 0.3).select("entity_id"),
    "p7_disjoint_links": _parts,
    "p8_uniform_sample": lambda s, d: sampling.uniform_sample(fixture.targets(s, d), 0.2).select("entity_id"),
    "p9_wanted_targets": _wanted,
    "j8_unbiased_pairs": lambda s, d: sampling.without_targets(_pairs(s, d), _parts(s, d).where("part = 0")).select("tgt_id", "s1_id"),
    "u1_both_sources": lambda s, d: fixture.targets(s, d).groupBy(F.substring("entity_id", 1, 2).alias("source"), "country").agg(F.count("*").alias("n")),
    "u3_link_difference": lambda s, d: sampling.difference(fixture.truth(s, d), _parts(s, d).where("part = 0")).select("tgt_id", "s1_id"),
    "p12_truth_explode": lambda s, d: tsv.links(fixture.truth(s, d).groupBy(F.col("s1_id").alias("source1_entity_id")).agg(F.concat_ws(", ", F.collect_list("tgt_id")).alias("matched_entity_ids")), sampling.sampled_anchors(fixture.anchors(s, d), 0.3)),
    "s5_by_country": _by_country,
    "s6_pair_block": _pair_block,
    "s9_countries": lambda s, d: tsv.countries(fixture.anchors(s, d)),
    "s10_id_set": _id_set,
    "s11_country_lists": _country_lists,
    "s13_missed_sample": _missed,
    "s14_summary": _summary,
    "a12_recall_at": _recall_at,
    "a13_volume": _volume,
    "a15_kept_counts": _kept,
    "l14_pruning": _pruning,
    "v13_ceiling": _ceiling,
    "m9_perfect_f05": _perfect,
    "m11_floors": lambda s, d: s.createDataFrame([(k, round(x, 12)) for k, x in enumerate(metrics.FLOORS)], "k long, floor double"),
    "j3_cell_search": _cells,
}

_W = f"with {SQL_WORDS}"
_LISTS = "lists as (select entity_id as s1, coalesce((select string_agg(tgt_id, ',' order by p1 desc, tgt_id) from decided where decided.s1_id = entity_id), '') as value from a)"
_GRID = "[" + ", ".join(str(t) for t in metrics.TAUS) + "]"
_DENSE = """select cast(tgt as varchar) as tgt_id, cast(src as varchar) as s1_id, rank, round(score, 5) as score from (
  select x.vec_id as tgt, y.vec_id as src, list_dot_product(x.embedding::double[], y.embedding::double[]) as score,
    row_number() over (partition by x.vec_id order by round(list_dot_product(x.embedding::double[], y.embedding::double[]), 9) desc, cast(y.vec_id as varchar)) - 1 as rank
  from embeddings x, embeddings y where x.vec_id % 50 = 0) where rank < 5"""
_UNIT = "('0x' || substr(md5('42:' || {}), 1, 8))::bigint / 4294967296.0::double"
_FOLD = f"case when {_UNIT} < 0.1 then 2 when {_UNIT} < 0.2 then 1 else 0 end"
_CODE = "(cast(substr({0}, 2, 1) as bigint) * 10000000000 + cast(substr({0}, 4) as bigint))"
_PRODUCT = f"({_CODE}::hugeint * 2654435761 % 4294967296)::bigint"
_ORDER = _UNIT.format("tgt_id") + ", tgt_id, s1_id"
_PART = f"parts as (select * from (select *, case when n <= 300 then 0 else 1 end as part from (select *, row_number() over (order by {_ORDER}) as n from truth)) where n <= 500)"
_ENDS = """{c}_e as (select tgt_id, max(case when rank = 0 then score end) as top, max(case when rank = 9 then score end) as last from {c}_r where rank < 100 group by all),
{c}_d as (select e.tgt_id, coalesce(top > 0 and last > 0 and last >= 0.9 * top, false) or len(v.{other}) = 0 as deep from {c}_e e join views v on v.entity_id = e.tgt_id),
{c}_h as (select r.tgt_id, r.s1_id, r.rank from {c}_r r join {c}_d using (tgt_id) where rank < case when deep then 100 else 10 end)"""
_COS = "{c}_c as (select p.tgt_id, p.s1_id, sum(x.w * y.w) as c from p0 p join {c}_w x on x.side = 't' and x.entity_id = p.tgt_id join {c}_w y on y.side = 'a' and y.entity_id = p.s1_id and y.feature = x.feature group by all)"
_SOUND = "(case when w[1] in ('a', 'e', 'i', 'o', 'u') then 'a' else w[1] end) || regexp_replace(w[2:], '[aeiou]', '', 'g')"
for _letter in "bcdfghjklmnpqrstvwxyz":
    _SOUND = f"regexp_replace({_SOUND}, '{_letter}+', '{_letter}', 'g')"
_SOUNDS = f"""phones as (select side, entity_id, country, {_SOUND} as key from (select side, entity_id, country, unnest(core_tokens) as w from views) where regexp_full_match(w, '[a-z]{{2,}}'))"""
_SOUND_SEARCH = f"with {SQL_WORDS}, {_SOUNDS}, {SQL_NAME_BAG.replace(') group by all)', ' union all select side, entity_id, country, ' + repr('p') + ' || key, 1.0 from phones where length(key) >= 2) group by all)')}, {sql_vectors('name')}"
_GAPS = ", ".join(f"round(cos_{c} - max(cos_{c}) over t, 6) + 0.0::double as gap_{c}, row_number() over (partition by tgt_id order by round(cos_{c}, 9) desc, s1_id) - 1 as qrank_{c}" for c in features.COSINES)
_F27 = f"""{_SOUND_SEARCH}, {SQL_ADDR_BAG}, {sql_vectors('addr')}, {SQL_RAW_BAG}, {sql_vectors('raw')}, {_ENDS.format(c='name', other='addr_tokens')}, {_ENDS.format(c='addr', other='core_tokens')},
deep_t as (select entity_id as tgt_id from views where side = 't' and (len(addr_tokens) = 0 or len(core_tokens) = 0) union select tgt_id from name_d where deep union select tgt_id from addr_d where deep),
ev0 as (select side, entity_id, country, ('0x' || substr(md5(feature), 1, 8))::bigint as h, w from name_w union all select side, entity_id, country, ('0x' || substr(md5(feature), 1, 8))::bigint, w from addr_w),
ev1 as (select side, entity_id, country, h % 128 as d, sum(case when (h // 1048576) % 2 = 0 then w else -w end) as x from ev0 group by all),
ev as (select side, entity_id, country, d, (x / case when n > 0 then n else 1.0 end)::float::double as v from (select *, sqrt(sum(x * x) over (partition by side, entity_id)) as n from ev1)),
enc_n as (select distinct side, entity_id, country from ev),
enc_p as (select x.entity_id as tgt_id, y.entity_id as s1_id, sum(x.v * y.v) as s from ev x join ev y on x.side = 't' and y.side = 'a' and x.country = y.country and x.d = y.d group by all),
enc_s as (select x.entity_id as tgt_id, y.entity_id as s1_id, coalesce(s, 0.0) as score from enc_n x join enc_n y on x.side = 't' and y.side = 'a' and x.country = y.country left join enc_p p on p.tgt_id = x.entity_id and p.s1_id = y.entity_id),
enc_r as (select *, row_number() over (partition by tgt_id order by round(score, 9) desc, s1_id) - 1 as rank from enc_s),
enc_h as (select tgt_id, s1_id, rank from enc_r where rank < case when tgt_id in (select tgt_id from deep_t) then 100 else 10 end),
u as (select *, 'name' as ch from name_h union all select *, 'addr' from addr_h union all select *, 'enc' from enc_h),
p0 as (select tgt_id, s1_id, {', '.join(f"coalesce(min(case when ch = '{c}' then rank end), 128) as rank_{c}" for c in ('name', 'addr', 'enc'))}, count(*) as n_channels from u group by all),
{_COS.format(c='name')}, {_COS.format(c='addr')}, {_COS.format(c='raw')},
p1 as (select p0.*, coalesce(n.c, 0.0) as cos_name, coalesce(d.c, 0.0) as cos_addr, coalesce(r.c, 0.0) as cos_raw, coalesce(e.score, 0.0) as cos_enc, (len(x.core_tokens) = 0)::int::double as q_name_empty, (len(x.addr_tokens) = 0)::int::double as q_addr_empty, (len(y.addr_tokens) = 0)::int::double as s_addr_empty
  from p0 left join name_c n using (tgt_id, s1_id) left join addr_c d using (tgt_id, s1_id) left join raw_c r using (tgt_id, s1_id) left join enc_s e using (tgt_id, s1_id) join views x on x.entity_id = p0.tgt_id join views y on y.entity_id = p0.s1_id),
p2 as (select *, {_GAPS}, count(*) over t as union_size, {', '.join(f'round(max(cos_{c}) over t, 6) as max_{c}' for c in ('name', 'addr', 'enc'))} from p1 window t as (partition by tgt_id))
select tgt_id, s1_id, {', '.join(f'round(cos_{c}, 6) as cos_{c}, gap_{c}, qrank_{c}' for c in features.COSINES)}, rank_name, rank_addr, rank_enc, n_channels, max_name, max_addr, max_enc, union_size, q_name_empty, q_addr_empty, s_addr_empty,
  round(max(case when qrank_enc = 0 then cos_enc end) over (partition by tgt_id) - coalesce(max(case when qrank_enc = 1 then cos_enc end) over (partition by tgt_id), 0), 6) + 0.0::double as second_enc_gap,
  round(cos_name + cos_addr + cos_enc, 6) as cos_sum, round(least(cos_name, cos_addr, cos_enc), 6) as cos_min, (cos_raw > 0.999)::int::double as raw_exact from p2"""
_SEGMENTS = f"""{SCORED}, typed as (select *, case when n_true = 0 then 'singleton' else 'linked' end as kind from scores)
select case when grouping(kind) = 1 and grouping(country) = 1 then 'ALL' when grouping(kind) = 0 then kind else country end as segment,
  count(*) as entities, round(avg(p), 6) as p, round(avg(r), 6) as r, round(avg(f), 6) as f05 from typed group by grouping sets ((), (kind), (country))"""

ORACLE = {
    "flagship_link_and_score": _SEGMENTS,
    "p2_code_roundtrip": f"{_W} select entity_id, {_CODE.format('entity_id')} as code, entity_id as back from t",
    "p6_folds": f"{_W} select entity_id, {_FOLD.format('entity_id', 'entity_id')} as fold from a",
    "v4_prep": f"{_W} select entity_id as s1_id, {_FOLD.format('entity_id', 'entity_id')} as fold from a",
    "p5_included_targets": f"{_W} select entity_id from t where {_PRODUCT.format('entity_id')} / 4294967296.0::double < 0.3 or exists (select 1 from truth where tgt_id = entity_id and {_PRODUCT.format('s1_id')} / 4294967296.0::double < 0.3)",
    "p7_disjoint_links": f"{_W}, {_PART} select tgt_id, s1_id, part from parts",
    "p8_uniform_sample": f"{_W} select entity_id from t where {_UNIT.format('entity_id')} < 0.2",
    "p9_wanted_targets": f"{_W} select entity_id from t where country = 'ASIA' and entity_id like 'S2-%' and ({_PRODUCT.format('entity_id')} % 2147483648) % 4 = 1",
    "j8_unbiased_pairs": f"{PAIRS}, {_PART} select tgt_id, s1_id from pairs0 where tgt_id not in (select tgt_id from parts where part = 0)",
    "u1_both_sources": f"{_W} select substr(entity_id, 1, 2) as source, country, count(*) as n from t group by all",
    "u3_link_difference": f"{_W}, {_PART} select tgt_id, s1_id from truth q where not exists (select 1 from parts p where p.part = 0 and p.tgt_id = q.tgt_id and p.s1_id = q.s1_id)",
    "p12_truth_explode": f"{_W} select s1_id, tgt_id from truth where {_PRODUCT.format('s1_id')} / 4294967296.0::double < 0.3",
    "s5_by_country": f"{PAIRS} select tgt_id, s1_id, country from decided join a on entity_id = s1_id",
    "s6_pair_block": f"{PAIRS} select p.tgt_id, p.s1_id, (q.tgt_id is not null)::int as label, n_channels, rank_name, rank_addr from pairs0 p left join truth q on q.tgt_id = p.tgt_id and q.s1_id = p.s1_id",
    "s9_countries": f"{_W} select entity_id as s1_id, country from a",
    "s10_id_set": f"{_W} select entity_id as id from a",
    "s11_country_lists": f"{PAIRS}, {_LISTS} select s1, value from lists",
    "s13_missed_sample": f"""{PAIRS}, m as (select * from truth q where not exists (select 1 from decided d where d.tgt_id = q.tgt_id and d.s1_id = q.s1_id) order by md5(tgt_id), tgt_id limit 50)
      select m.tgt_id, m.s1_id, x.business_name as target_name, x.business_address as target_address, y.business_name as true_name, y.business_address as true_address, b.s1_id as best_id, z.business_name as best_name, z.business_address as best_address
      from m left join t x on x.entity_id = m.tgt_id left join a y on y.entity_id = m.s1_id left join best b on b.tgt_id = m.tgt_id left join a z on z.entity_id = b.s1_id""",
    "s14_summary": f"{_W} select 'anchors' as name, count(*) as n from a union all select 'links', count(*) from truth",
    "a12_recall_at": f"""{PAIRS}, f as (select *, row_number() over (partition by tgt_id order by round(rrf, 12) desc, s1_id) - 1 as k from pairs0),
      x as (select country, substr(q.tgt_id, 1, 2) as source, coalesce(rank_name < 128, false)::int as name, coalesce(rank_addr < 128, false)::int as addr, (k is not null)::int as any_hit, coalesce(k < 5, false)::int as f5, coalesce(k < 10, false)::int as f10
        from truth q join a on a.entity_id = q.s1_id left join f on f.tgt_id = q.tgt_id and f.s1_id = q.s1_id)
      select country, source, count(*) as n_links, round(avg(name), 6) as name, round(avg(addr), 6) as addr, round(avg(any_hit), 6) as "any", round(avg(f5), 6) as fused_5, round(avg(f10), 6) as fused_10 from x group by grouping sets ((), (country), (source))""",
    "a13_volume": f"""{PAIRS}, n as (select entity_id, (select count(*) from pairs0 where tgt_id = entity_id) as n, (len(addr_tokens) = 0)::int as d from views where side = 't')
      select count(*) as targets, sum(n)::bigint as pairs, round(avg(n), 6) as per_target, round(avg(least(n, 8)), 6) as per_target_capped, round(avg(d), 6) as deep_share from n""",
    "a15_kept_counts": f"""{PAIRS}, x as (select country, r < 3 and p1 >= 0.2 as kept, q.tgt_id is not null as link from (select *, row_number() over (partition by tgt_id order by p1 desc, s1_id) - 1 as r from pairs) p join a on entity_id = p.s1_id left join truth q on q.tgt_id = p.tgt_id and q.s1_id = p.s1_id)
      select country, count(*) as pairs, count(*) filter (kept) as kept, count(*) filter (link) as links, count(*) filter (kept and link) as links_kept from x group by country""",
    "l14_pruning": f"""{PAIRS}, x as (select p.*, q.tgt_id is not null as link from (select *, row_number() over (partition by tgt_id order by p1 desc, s1_id) - 1 as r from pairs) p left join truth q on q.tgt_id = p.tgt_id and q.s1_id = p.s1_id where p1 >= 0.2)
      select m, round(count(*) filter (link) / (select count(*) from truth), 6) as recall, round(count(*) / (select count(distinct tgt_id) from pairs), 6) as kept_per_target from x, (select unnest([5, 10, 15, 20]) as m) where r < m group by m""",
    "v13_ceiling": f"""{PAIRS}, k as (select * from (select *, row_number() over (partition by tgt_id order by p1 desc, s1_id) - 1 as r from pairs) where r < 1 and p1 >= 0.5),
      n as (select entity_id, (select count(*) from truth where s1_id = entity_id) as n, (select count(*) from truth q where q.s1_id = entity_id and exists (select 1 from k where k.tgt_id = q.tgt_id and k.s1_id = q.s1_id)) as h from a),
      z as (select case when n = 0 then 1.0 when h = 0 then 0.0 else 1.0 end as p, case when n = 0 then 1.0 else h / n end as r from n)
      select count(*) as entities, round(avg(p), 6) as p, round(avg(r), 6) as r, round(avg(case when 0.25 * p + r > 0 then 1.25 * p * r / (0.25 * p + r) else 0 end), 6) as f05 from z""",
    "m9_perfect_f05": f"{SCORED} select s1_id, round(1.25 * r / (0.25 + r), 6) as f05 from scores",
    "m11_floors": "select k, round(0.000001 * pow(50000, k / 59.0), 12) as floor from range(60) r(k)",
    "pair_features27": _F27,
    "p3_hash_sample": f"""{_W}, h as (select entity_id, ((10000000000 + cast(substr(entity_id, 4) as bigint))::hugeint * 2654435761 % 4294967296)::bigint as h from a)
      select entity_id, h, h / 4294967296.0::double < 0.3 as sampled, (h % 2147483648) % 4 as slice from h""",
    "p12_truth_links": f"{PAIRS} select s1_id, tgt_id from decided",
    "t1_fold": f"{_W} select side, entity_id, name, addr from folded",
    "t3_tokens": f"{_W} select side, entity_id, array_to_string(raw, ' ') as v from views",
    "t3_document_tokens": f"select doc_id, len(x) as n, len(list_distinct(x)) as distinct_n from (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[a-z0-9]+') as x from documents)",
    "t8_lexicon": f"{_W} select side, entity_id, array_to_string(addr_tokens, ' ') as v from views",
    "t9_core": f"{_W} select side, entity_id, array_to_string(core_tokens, ' ') as v from views",
    "t15_numbers": f"{_W} select side, entity_id, array_to_string(nums, ' ') as v from views",
    "t16_deletes": f"""{_W}, cut as (select side, entity_id, n, unnest(range(1, length(n) + 1)) as j from (select side, entity_id, unnest(nums) as n from views) where length(n) >= 3),
      al as (select side, entity_id, unnest(nums) as x from views union select side, entity_id, substr(n, 1, j - 1) || substr(n, j + 1) from cut)
      select v.side, v.entity_id, coalesce(string_agg(x, ' ' order by x), '') as v from views v left join al using (side, entity_id) group by all""",
    "t11_name_bag": f"{NAMES} select side, entity_id, feature, round(tf, 6) as tf from name_bag",
    "t12_raw_bag": f"{_W}, {SQL_RAW_BAG} select side, entity_id, feature, round(tf, 6) as tf from raw_bag",
    "t13_addr_bag": f"{ADDRESSES} select side, entity_id, feature, round(tf, 6) as tf from addr_bag",
    "t18_jaro_winkler": f"{_W} select tgt_id, s1_id, round(jaro_winkler_similarity(x.name, y.name), 6) as jw from truth join views x on x.entity_id = tgt_id join views y on y.entity_id = s1_id",
    "m3_idf": f"{SEARCH} select feature, df, round(idf, 6) as idf, pruned from name_idf",
    "m4_tfidf_norm": f"{ADDRESSES}, {sql_vectors('addr')} select entity_id, feature, round(w, 6) as w, pruned from addr_w where side = 't'",
    "m6_dot": f"select tgt_id, score from ({_DENSE})",
    "j2_sparse_topk": f"{SEARCH} select tgt_id, s1_id, round(score, 6) as score, rank from name_top",
    "j2_address_topk": f"{ADDRESSES}, {sql_vectors('addr')} select tgt_id, s1_id, round(score, 6) as score, rank from addr_top",
    "k3_adaptive_depth": f"""{SEARCH}, ends as (select tgt_id, max(case when rank = 0 then score end) as top, max(case when rank = 9 then score end) as last from name_r group by all),
      deep as (select e.*, coalesce(top > 0 and last > 0 and last >= 0.9 * top, false) or len(v.addr_tokens) = 0 as deep from ends e join views v on v.entity_id = e.tgt_id)
      select r.tgt_id, count(*) as n, bool_or(deep) as deep, round(max(score), 6) as top from name_r r join deep using (tgt_id) where rank < case when deep then 100 else 10 end group by r.tgt_id""",
    "j3_vector_topk": _DENSE,
    "j5_channel_union": f"{PAIRS} select tgt_id, s1_id, rank_name, rank_addr, n_channels, round(rrf, 6) as rrf from pairs0",
    "w8_true_rank": f"""{PAIRS}, mine as (select tgt_id, rrf as m from pairs0 join truth using (tgt_id, s1_id)),
      above as (select tgt_id, count(*) filter (round(rrf, 12) > round(m, 12)) as true_rank from pairs0 join mine using (tgt_id) group by all)
      select tgt_id, true_rank from truth left join above using (tgt_id)""",
    "m5_pair_cosine": f"{PAIRS} select tgt_id, s1_id, round(cos_name, 6) as cos_name, round(cos_addr, 6) as cos_addr, p1 from pairs",
    "w1_w3_group_features": f"""{PAIRS}, g as (select *, count(*) over t as union_size, row_number() over (partition by tgt_id order by round(cos_name, 9) desc, s1_id) - 1 as qrank_name,
      row_number() over (partition by tgt_id order by round(cos_addr, 9) desc, s1_id) - 1 as qrank_addr, max(cos_name) over t as max_name, max(cos_addr) over t as max_addr from pairs window t as (partition by tgt_id))
      select tgt_id, s1_id, union_size, qrank_name, qrank_addr, round(cos_name - max_name, 6) + 0.0::double as gap_name, round(cos_addr - max_addr, 6) + 0.0::double as gap_addr, round(max_name, 6) as max_name, round(max_addr, 6) as max_addr,
      round(max(case when qrank_name = 0 then cos_name end) over (partition by tgt_id) - coalesce(max(case when qrank_name = 1 then cos_name end) over (partition by tgt_id), 0), 6) + 0.0::double as second_gap from g""",
    "w5_w6_a8_competition": f"""{PAIRS}, g as (select *, row_number() over (partition by tgt_id order by round(p1, 9) desc, s1_id) - 1 as k, row_number() over (partition by s1_id order by round(p1, 9) desc, tgt_id) - 1 as rank_in_s1 from pairs),
      h as (select *, max(case when k = 0 then p1 end) over t as b, coalesce(max(case when k = 1 then p1 end) over t, 0) as s, count(*) over t as n_kept_t,
        count(*) over c as s1_n_cand, count(*) filter (k = 0) over c as s1_n_top1, sum(p1) over c as s1_sum_p1, max(p1) over c as s1_max_p1 from g window t as (partition by tgt_id), c as (partition by s1_id))
      select tgt_id, s1_id, round(p1, 6) as p1, k as p1_rank_t, round(case when k = 0 then p1 - s else p1 - b end, 6) as p1_margin_t, n_kept_t, s1_n_cand, s1_n_top1, round(s1_sum_p1, 6) as s1_sum_p1, round(s1_max_p1, 6) as s1_max_p1, round(p1 - s1_max_p1, 6) as p1_gap_s1, rank_in_s1 from h""",
    "pair_number_features": f"""{PAIRS} select d.tgt_id, d.s1_id, (array_to_string(x.core_tokens, '') = array_to_string(y.core_tokens, ''))::int::double as core_equal, (x.name = y.name)::int::double as raw_equal, (trim(x.addr) = '')::int::double as t_addr_empty,
      len(list_intersect(x.nums, y.nums))::double as num_shared, (len(x.nums) > 0 and len(y.nums) > 0 and len(list_intersect(x.nums, y.nums)) = 0)::int::double as num_conflict, len(x.nums)::double as num_t, len(y.nums)::double as num_s,
      length(x.name)::double as len_t, length(y.name)::double as len_s from decided d join views x on x.entity_id = d.tgt_id join views y on y.entity_id = d.s1_id""",
    "l4_lexicon_counts": f"""{_W}, r as (select tgt_id, regexp_extract_all(x.addr, '[a-z0-9]+') as tt, regexp_extract_all(y.addr, '[a-z0-9]+') as ss from truth join folded x on x.entity_id = tgt_id join folded y on y.entity_id = s1_id),
      e as (select tgt_id, ss, unnest(list_distinct(list_filter(tt, lambda w: not list_contains(ss, w)))) as t, tt from r), f as (select * from e where regexp_full_match(t, '[a-z]{{2,}}')),
      u as (select t, count(*) as unmatched from f group by all), g as (select t, unnest(list_distinct(list_filter(ss, lambda w: not list_contains(tt, w) and regexp_full_match(w, '[a-z]+')))) as s from f),
      k as (select t, s, count(*) as n from g where t[1] = s[1] and ((length(t) < length(s) and regexp_matches(s, array_to_string(string_split(t, ''), '.*'))) or (length(s) < length(t) and regexp_matches(t, array_to_string(string_split(s, ''), '.*')))) group by all)
      select t, s, n, unmatched from k join u using (t) where n >= 5""",
    "l5_noise_counts": f"""{_W}, r as (select list_distinct(x.raw) as tt, list_distinct(y.raw) as ss from truth join views x on x.entity_id = tgt_id join views y on y.entity_id = s1_id),
      w as (select unnest(list_distinct(list_concat(tt, ss))) as word, tt, ss from r)
      select word, count(*) filter (list_contains(ss, word)) as in_s, count(*) filter (list_contains(tt, word)) as in_t, count(*) filter (list_contains(ss, word) and list_contains(tt, word)) as both from w group by word""",
    "l11_floor": f"""{PAIRS}, g as (select *, row_number() over (partition by tgt_id order by p1 desc, s1_id) - 1 as k from pairs)
      select f as floor, round(count(*) / (select count(distinct tgt_id) from pairs), 6) as recall from (select unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7])::double as f), g join truth using (tgt_id, s1_id) where k < 20 and p1 >= f group by f""",
    "l13_tau_grid": f"""{PAIRS}, grid as (select unnest({_GRID})::double as tau), b as (select b.*, q.tgt_id is not null as hit from best b left join truth q on q.tgt_id = b.tgt_id and q.s1_id = b.s1_id),
      c as (select tau, s1_id, count(*) as n_pred, count(*) filter (hit) as tp from grid join b on p1 >= tau group by all), n as (select s1_id, count(*) as n_true from truth group by all),
      x as (select tau, entity_id, coalesce(n_true, 0) as nt, coalesce(n_pred, 0) as np, coalesce(tp, 0) as tp from grid cross join a left join c using (tau) left join n on n.s1_id = entity_id where false),
      y as (select g.tau, a.entity_id, coalesce(n.n_true, 0) as nt, coalesce(c.n_pred, 0) as np, coalesce(c.tp, 0) as tp from grid g cross join a left join c on c.tau = g.tau and c.s1_id = a.entity_id left join n on n.s1_id = a.entity_id),
      z as (select *, case when np > 0 then tp / np else 0.0 end as p, case when nt > 0 then tp / nt else 0.0 end as r from y)
      select tau, round(avg(case when nt = 0 then (case when np = 0 then 1.0 else 0.0 end) when 0.25 * p + r > 0 then 1.25 * p * r / (0.25 * p + r) else 0.0 end), 6) as f05 from z group by tau""",
    "w7_one_parent": f"{PAIRS} select tgt_id, s1_id, p1 from decided",
    "k4_pruned": f"{PAIRS} select tgt_id, s1_id, p1 from (select *, row_number() over (partition by tgt_id order by p1 desc, s1_id) - 1 as k from pairs) where k < 3 and p1 >= 0.2",
    "s7_results": f"{PAIRS}, {_LISTS} select s1 as source1_entity_id, value as matched_entity_ids from lists",
    "s8_match_lists": f"{PAIRS} select entity_id as s1_id, coalesce(string_agg(tgt_id, ',' order by tgt_id), '') as ids, 1 as n_rows from a left join decided on s1_id = entity_id group by entity_id",
    "m10_entity_scores": f"{SCORED} select s1_id, country, n_true, n_pred, tp, round(p, 6) as p, round(r, 6) as r, round(f, 6) as f from scores",
    "a10_segments": _SEGMENTS,
    "a11_micro": f"""{SCORED}, m as (select sum(tp)::bigint as tp, sum(n_pred)::bigint as n_pred, sum(n_true)::bigint as n_true, count(*) filter (f = 1) as perfect, count(*) filter (n_true = 0 and n_pred > 0) as singleton_fp,
      count(*) filter (n_true > 0 and tp = 0) as missed from scores), q as (select *, tp / greatest(n_pred, 1) as p, tp / greatest(n_true, 1) as r from m)
      select tp, n_pred, n_true, perfect, singleton_fp, missed, round(p, 6) as p, round(r, 6) as r, round(case when 0.25 * p + r > 0 then 1.25 * p * r / (0.25 * p + r) else 0 end, 6) as f05 from q""",
    "a12_recall": f"""{PAIRS}, x as (select country, exists(select 1 from name_top n where n.tgt_id = q.tgt_id and n.s1_id = q.s1_id) as n, exists(select 1 from addr_top d where d.tgt_id = q.tgt_id and d.s1_id = q.s1_id) as d from truth q join a on a.entity_id = q.s1_id)
      select country, count(*) as n_links, round(avg(n::int), 6) as name, round(avg(d::int), 6) as addr, round(avg((n or d)::int), 6) as either from x group by rollup (country)""",
    "a14_ambiguity": f"""{PAIRS}, c as (select entity_id, country, array_to_string(core_tokens, '') as core from views where side = 'a'), s as (select country, core, count(*) as same_core from c group by all)
      select same_core, count(*) as n from truth q join c on c.entity_id = q.s1_id join s on s.country = c.country and s.core = c.core where not exists (select 1 from decided d where d.tgt_id = q.tgt_id and d.s1_id = q.s1_id) group by same_core""",
    "a18_tie_histogram": f"""{PAIRS}, m as (select p.tgt_id, p.cos_name as cn, p.cos_addr as ca from pairs p join truth using (tgt_id, s1_id) where not exists (select 1 from decided d where d.tgt_id = p.tgt_id and d.s1_id = p.s1_id)),
      n as (select tgt_id, count(*) filter (abs(cos_name - cn) <= 1e-4 and abs(cos_addr - ca) <= 1e-4) as n from pairs join m using (tgt_id) group by all) select cast(floor(least(n, 100) / 10) * 10 as bigint) as bin, count(*) as targets from n group by all""",
    "v10_findings": f"""{PAIRS}, {_LISTS}, good as (select *, cast(substr(s1, 4) as bigint) as k from lists),
      bad as (select s1, case when k % 50 = 1 then 'X-1,' || value when k % 50 = 2 then 'S1-1,S2-9,S2-9' else value end as value from good where k % 50 <> 3 union all select s1, value from good where k % 50 = 4 union all select 'S1-nobody', value from good where k = 10),
      each as (select s1, list_filter(string_split(value, ','), lambda x: x <> '') as ids from bad), flat as (select s1, unnest(ids) as id from each),
      f as (select 'duplicate_row' as rule, s1 as id from each group by s1 having count(*) > 1 union all select 'repeated_id', s1 from each where len(ids) > len(list_distinct(ids)) union all select 'self_match', id from flat where id like 'S1-%'
        union all select 'bad_prefix', id from flat where not regexp_matches(id, '^S[123]-') union all select 'missing_s1', s1 from lists where s1 not in (select s1 from each) union all select 'unknown_s1', s1 from each where s1 not in (select s1 from lists))
      select rule, count(*) as n, array_to_string(list_sort(list_distinct(list(id)))[1:5], ',') as examples from f group by rule""",
    "v11_merge": f"{PAIRS}, {_LISTS} select s1, value from lists",
    "j11_outside_candidates": f"{PAIRS} select s1_id, tgt_id from truth q where not exists (select 1 from pairs0 p where p.tgt_id = q.tgt_id and p.s1_id = q.s1_id)",
}
