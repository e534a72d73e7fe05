"""Operator 5: removal of repeated lines by an exact set-similarity join, all DataFrame expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tieline.llm.common import cut, drop, small_side, sweep, table
from tieline.llm.quality_rules import let

#: Words in a token of a line, and the similarity in percent from which a later line is removed.
WIDTH, PERCENT = 5, 75
#: Rarity is counted over all tokens in so many cells of their hash. A token is told from the rare ones by its cell if it
#: stands more often than the spread of a cell's other tokens, sqrt(tokens / CELLS) or so: some 50 times in 10^8 tokens.
#: Counting each token by itself would shuffle every token of the corpus, more bytes than its text has.
CELLS = 1 << 16
#: A token is kept as 48 bits of its hash; 15 bits above them hold its rarity rank while a line is sorted.
BITS, RANKS = 48, 1 << 15


def worded_lines(docs: DataFrame, text: str, *keep: str) -> DataFrame:
    """(doc_id, doc_key, line_no, w) of the lines with a word, of the texts that have an id: w holds the lower-cased words.

    doc_key tells texts of one doc_id apart.
    """
    split = docs.where(F.col(text).isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("_t"), *keep)
    low = F.lower("_t")
    odd = F.contains("_t", F.lit("\t")) | F.contains("_t", F.lit("\r")) | F.contains("_t", F.lit("\x0b")) | F.contains("_t", F.lit("\x0c"))
    plain = F.when(odd, F.translate(low, "\t\r\x0b\x0c", "    ")).otherwise(low)
    lines = split.select("doc_id", F.xxhash64("_t").alias("doc_key"), *keep, F.posexplode(F.split(plain, "\n")).alias("line_no", "line"))
    return lines.where("line <> ''").select("doc_id", "doc_key", "line_no", *keep, F.array_remove(F.split("line", " "), "").alias("w")).where(F.size("w") > 0)


def line_shingles(w: Column, width: int) -> Column:
    """The distinct 48-bit hashes of the runs of ``width`` words, in order; fewer words are one token as a whole."""
    run = lambda x, i: F.shiftrightunsigned(F.xxhash64(x, *[F.get(w, i + k) for k in range(1, width)]), 64 - BITS)
    many = F.transform(F.slice(w, F.lit(1), F.size(w) - (width - 1)), run)
    return F.when(F.size(w) < width, F.array(F.shiftrightunsigned(F.xxhash64(w), 64 - BITS))).otherwise(F.array_distinct(many))


def rarity_ranks(tokens: DataFrame) -> Column:
    """Literal array: for each cell of token hashes its rank, from 0 (fewest tokens in all lines) to RANKS - 1."""
    cells = tokens.select(F.explode("t").alias("t")).groupBy((F.col("t") % CELLS).cast("int").alias("c")).count()
    count = {r[0]: r[1] for r in cells.collect()}  # at most CELLS numbers
    rank = [0] * CELLS
    for place, c in enumerate(sorted(range(CELLS), key=lambda c: (count.get(c, 0), c))):
        rank[c] = place * RANKS // CELLS
    return F.split(F.lit(",".join(map(str, rank))), ",").cast("array<bigint>")


def prefixed(tokens: DataFrame, percent: int) -> DataFrame:
    """Lines as (doc_id, doc_key, line_no, set_a, set_b, n, prefix), from their distinct tokens ``t``.

    set_a and set_b are a digest of the distinct tokens in order of appearance, n their number. The tokens are ordered by
    rarity, then by hash; the prefix is the first n - ceil(percent * n / 100) + 1 of them, and two lines that reach the
    threshold share a token of their prefixes. Sets under 3 tokens match equal ones only and have no prefix.
    """
    ranks = rarity_ranks(tokens)
    low = F.lit((1 << BITS) - 1)
    t, n = F.col("t"), F.size("t")
    ordered = F.sort_array(F.transform(t, lambda x: F.shiftleft(F.get(ranks, (x % CELLS).cast("int")), BITS) + x))
    many = n - F.ceil(n * percent / 100).cast("int") + 1
    prefix = F.when(n < 3, F.array().cast("array<bigint>")).otherwise(F.transform(F.slice(ordered, F.lit(1), many), lambda x: x.bitwiseAND(low)))
    return tokens.select("doc_id", "doc_key", "line_no", F.xxhash64(t).alias("set_a"), F.hash(t, n).cast("long").alias("set_b"), n.alias("n"), prefix.alias("prefix"))


#: Longs of a set's parity bitmap: each token flips one of 64 * MAPS bits.
MAPS = 4


def parity(t: Column) -> list[Column]:
    """Bitmaps p0.. of a token array. Two sets' bitmaps differ in no more bits than the sets differ in tokens."""
    def flip(k: int):
        bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63)).cast("int"))
        mine = lambda x: F.shiftright(x, 6).bitwiseAND(F.lit(MAPS - 1)) == k
        return F.aggregate(t, F.lit(0).cast("long"), lambda acc, x: F.when(mine(x), acc.bitwiseXOR(bit(x))).otherwise(acc)).alias(f"p{k}")

    return [flip(k) for k in range(MAPS)]


def later_sets(docs: DataFrame, text: str, held: DataFrame, sets: DataFrame, width: int, percent: int) -> DataFrame:
    """``sid`` of the sets that match a set whose first line is earlier. ``held``: (sid, n, prefix) of the sets that have one.

    First each set meets only the earliest holder of each of its prefix tokens, so a group of near copies costs a row for
    each member, not for each pair. The sets that no such holder removes then meet all earlier holders of their tokens.
    Sizes, positions and parity bitmaps bound the overlap in the join itself, so that pairs which cannot match are never
    made; what remains is verified on the whole sets, made again, once, from the texts they first stand in. The whole sets
    are long, so they are never dealt out for pairs that the bitmaps rule out.
    """
    key = ["doc_id", "doc_key", "line_no"]
    entries = held.select("sid", "n", F.posexplode("prefix").alias("at", "token"))
    heads = cut(entries.groupBy("token").agg(F.min("sid").alias("head"), F.max("sid").alias("last"), F.count("*").alias("holders")).where("holders > 1"))
    many = cut(heads.where("holders > 2").select("token", "head"))
    crowded = cut(entries.join(small_side(many), "token"))
    two = heads.where("holders = 2").select(F.col("last").alias("x"), F.col("head").alias("y"))
    involved = two.select(F.col("x").alias("sid")).union(two.select("y")).union(crowded.select("sid")).distinct()
    places = cut(sets.where("n >= 3").join(involved, "sid", "left_semi").select("sid", *[F.col(f"first.{c}").alias(c) for c in key]))
    ids = cut(places.select(F.col("doc_id").alias("_id")).distinct())
    source = docs.join(small_side(ids), F.col("doc_id").cast("long") == F.col("_id"), "left_semi")
    lines = worded_lines(source, text).join(small_side(places), key).select("sid", line_shingles(F.col("w"), width).alias("t"))
    whole = cut(lines.select("sid", F.size("t").alias("n"), "t", *parity(F.col("t"))))  # a repeated text's sets stand here repeatedly
    maps = [f"p{k}" for k in range(MAPS)]
    slim = cut(whole.drop("t").dropDuplicates(["sid"]))
    drop(places, ids)

    def near(a: str, b: str) -> Column:
        """Do sizes and bitmaps allow the sets with these column suffixes to match?"""
        apart = sum((F.bit_count(F.col(p + a).bitwiseXOR(F.col(p + b))) for p in maps), F.lit(0))
        n, m = F.col("n" + a), F.col("n" + b)
        return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * apart <= (100 - percent) * (n + m))

    def named(df: DataFrame, c: str, *extra: str) -> DataFrame:
        return df.select(F.col("sid").alias(c), *[F.col(x).alias(x + c) for x in ("n", *maps, *extra)])

    def verified(pairs: DataFrame) -> DataFrame:
        """``sid`` of those of pairs (x later, y earlier) that reach the threshold."""
        some = cut(pairs.select("x", "y").distinct())
        asked = cut(some.select(F.col("x").alias("sid")).union(some.select("y")).distinct())
        full_sets = cut(whole.select("sid", "t").join(small_side(asked), "sid", "left_semi").dropDuplicates(["sid"]))
        side = lambda c: full_sets.select(F.col("sid").alias(c), F.col("t").alias("t" + c))
        both = F.size(F.array_intersect("tx", "ty"))
        full = some.join(side("x"), "x").join(side("y"), "y")
        out = cut(full.where(100 * both >= percent * (F.size("tx") + F.size("ty") - both)).select(F.col("x").alias("sid")).distinct())
        drop(some, asked, full_sets)
        return out

    star = two.union(crowded.select(F.col("sid").alias("x"), F.col("head").alias("y")))
    met = star.where("x > y").join(named(slim, "x"), "x")
    other = named(slim, "y").withColumnRenamed("y", "_y")
    found = verified(met.join(other, (F.col("y") == F.col("_y")) & near("x", "y")))
    drop(heads)
    members = cut(crowded.select("sid").distinct())
    prefixes = held.select("sid", "prefix").join(small_side(members), "sid", "left_semi")
    mapped = cut(crowded.select("sid", "token", "at").join(slim, "sid").join(prefixes, "sid"))
    drop(members)
    left, right = named(mapped, "x", "at", "token", "prefix").join(found.withColumnRenamed("sid", "x"), "x", "left_anti"), named(mapped, "y", "at", "token", "prefix")
    # A pair that shares several prefix tokens is named at the first of them (a first one with two holders was met above).
    once = F.array_intersect("prefixx", "prefixy")[0] == F.col("tokenx")
    # At most so many tokens can be common, given where this one stands in both orders.
    bound = 1 + F.least("atx", "aty") + F.least(F.col("nx") - F.col("atx"), F.col("ny") - F.col("aty")) - 1
    able = (F.col("x") > F.col("y")) & ((100 + percent) * bound >= percent * (F.col("nx") + F.col("ny"))) & near("x", "y")
    more = verified(left.join(right, (F.col("tokenx") == F.col("tokeny")) & able & once).select("x", "y"))
    drop(many, crowded, whole, slim, mapped)
    return found.union(more)


def removed_lines(docs: DataFrame, text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(lines, removed): the lines that have a word, and (doc_id, doc_key, line_no) of those to remove."""
    # The tokens are made once and kept until the prefixes are taken from them.
    tokens = cut(worded_lines(docs, text).select("doc_id", "doc_key", "line_no", line_shingles(F.col("w"), width).alias("t")))
    made = cut(prefixed(tokens, percent))
    drop(tokens)
    digest, key = ["set_a", "set_b", "n"], ["doc_id", "doc_key", "line_no"]
    sets = made.groupBy(*digest).agg(F.min(F.struct("doc_id", "line_no", "doc_key")).alias("first"))
    # Numbers that rise with the first line: the sets are sorted over all partitions, then numbered.
    sets = cut(sets.orderBy("first").withColumn("sid", F.monotonically_increasing_id()))
    firsts = sets.where("n >= 3").select("sid", *[F.col(f"first.{c}").alias(c) for c in key])
    held = cut(made.where("n >= 3").select(*key, "n", "prefix").join(firsts, key).select("sid", "n", "prefix"))
    sweep(docs.sparkSession)
    rows = made.drop("prefix")
    late = later_sets(docs, text, held, sets, width, percent).withColumn("late", F.lit(True))
    verdict = sets.join(late, "sid", "left").select(*digest, "first", F.coalesce("late", F.lit(False)).alias("late"))
    drop(held)
    placed = rows.join(verdict, digest)
    gone = placed.where(F.col("late") | (F.struct("doc_id", "line_no", "doc_key") > F.col("first")))
    return rows.select(*key), gone.select(*key)


def dedup_lines(docs: DataFrame, text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``docs`` with the lines taken out of ``text`` that match an earlier line, and n_lines and n_removed added.

    Lines are parts between \\n; a line's tokens are its distinct runs of ``width`` lower-cased words (a shorter line is one
    token). A line is removed if an earlier line, by (doc_id, line number), has a Jaccard similarity of ``percent`` or
    more with it, be that line itself removed or not. Lines without a word stay. All rows stay, with what is left of
    their text: a null text stays null, one whose lines all go becomes empty. Rows equal in doc_id and text are one
    document and get the same text; of different texts with one doc_id the line with the smaller number, then the
    smaller text hash, is earlier. Rows without a doc_id take no part and stay as they are. n_lines counts the lines
    that have a word. Columns of the added names are replaced, others pass through; an empty table stays empty.
    """
    columns = [c for c in docs.columns if c not in ("n_lines", "n_removed", "_key", "_gone", "_id")]
    slim, gone = removed_lines(docs, text, width, percent)
    lists = gone.groupBy("doc_id", "doc_key").agg(F.collect_set("line_no").alias("_gone"))  # at most a document's lines
    keyed = docs.select(*columns).withColumns({"_key": F.xxhash64(F.col(text).cast("string")), "_id": F.col("doc_id").cast("long")})
    joined = keyed.join(lists.select(F.col("doc_id").alias("_id"), F.col("doc_key").alias("_key"), "_gone"), ["_id", "_key"], "left")
    parts = F.split(F.col(text).cast("string"), "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("_gone"))
    rebuilt = F.array_join(let(parts, lambda p: F.transform(left, lambda i: F.get(p, i))), "\n")
    worded = F.size(F.filter(parts, lambda x: x.rlike("[^ \\t\\n\\u000B\\f\\r]")))
    out = joined.withColumns({
        "n_lines": F.when(F.col(text).isNull(), F.lit(0)).otherwise(worded).cast("long"),
        "n_removed": F.coalesce(F.size("_gone"), F.lit(0)).cast("long"),
        "_text": F.when(F.col("_gone").isNull(), F.col(text).cast("string")).otherwise(rebuilt),
    })
    return out.select(*[F.col("_text").alias(text) if c == text else F.col(c) for c in columns], "n_lines", F.greatest("n_removed", F.lit(0)).alias("n_removed"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all documents, how many lines they have, how many are removed, and a checksum of the numbers of the removed."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    slim, gone = removed_lines(docs)
    flagged = slim.select("doc_id", "doc_key", "line_no", F.lit(0).alias("g")).union(gone.select("doc_id", "doc_key", "line_no", F.lit(1)))
    counted = flagged.groupBy("doc_id").agg(
        F.sum(1 - F.col("g")).alias("n_lines"), F.sum("g").alias("n_removed"),
        F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.when(F.col("g") == 1, F.col("line_no")))), lambda x: x.cast("string"))).alias("removed_lines"),
    )
    out = docs.select("doc_id").join(counted, "doc_id", "left")
    return out.select("doc_id", F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"), F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("removed_lines", F.lit("")).alias("removed_lines"))
