"""Folding, tokens and feature bags of names and addresses, as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters that do not decompose, and characters that fold to an apostrophe.
EXPANSIONS = {"ß": "ss", "ẞ": "ss", "æ": "ae", "Æ": "ae", "œ": "oe", "Œ": "oe", "ø": "o", "Ø": "o", "ł": "l", "Ł": "l", "đ": "d", "Đ": "d", "ð": "d", "Ð": "d", "þ": "th", "Þ": "th", "ı": "i", "‘": "'", "’": "'", "ʼ": "'", "`": "'"}
INDIC_FIRST, INDIC_LAST, INDIC_BASE = 0x0900, 0x0DFF, 0x0900
#: Weights of word, character gram and initials in a name bag; of number, deletion, mixed, compound and word in an address bag.
NAME_WEIGHTS = {"w": 2.0, "p": 1.0, "g": 1.0, "i": 1.0}
ADDRESS_WEIGHTS = {"n": 1.5, "d": 0.5, "m": 1.0, "c": 1.0, "a": 1.0}
BAG = "array<struct<feature: string, tf: double>>"


class _Folds(dict):
    """What a character folds to, before lower-casing, worked out when it is first met."""

    def __missing__(self, cp: int) -> str:
        ch, out = chr(cp), ""
        if ch in EXPANSIONS:
            out = EXPANSIONS[ch]
        else:
            for c in unicodedata.normalize("NFKD", ch):
                n = ord(c)
                if 0x300 <= n < 0x370 or c in "\u200c\u200d" or n == 0x0A71:
                    continue
                if INDIC_FIRST <= n <= INDIC_LAST:
                    off = n & 0x7F
                    c = " " if off in (0x64, 0x65) else str(off - 0x66) if 0x66 <= off <= 0x6F else chr(INDIC_BASE + (0x02 if n == 0x0A70 else off))
                out += EXPANSIONS.get(c, c)
        self[cp] = out
        return out


_FOLDS = _Folds()


def fold_text(text: str) -> str:
    """Compatibility decomposition without accents, Indic blocks on one, lower case, no apostrophes."""
    return text.translate(_FOLDS).lower().replace("'", "")


def _fold_batch(texts: pd.Series) -> pd.Series:
    return texts.map(fold_text, na_action="ignore").astype(object)


def fold(text: Column) -> Column:
    """Lower case without accents; Indic scripts on the Devanagari block; apostrophes go. Null folds to ''.

    ASCII texts are folded by builtins; only the others travel to Python, in Arrow batches (Spark has no normal forms).
    """
    t = F.coalesce(text.cast("string"), F.lit(""))
    odd = F.pandas_udf(_fold_batch, "string")(F.when(t.rlike("[^\\x00-\\x7f]"), t))
    return F.coalesce(odd, F.translate(F.lower(t), "'`", ""))


def raw_tokens(folded: Column) -> Column:
    """Runs of a-z and digits, or of Indic characters; runs of two or more single letters are joined ('l l c': 'llc')."""
    spaced = F.array_join(F.regexp_extract_all(folded, F.lit("[a-z0-9]+|[ऀ-ॿ]+"), F.lit(0)), " ")
    joined = F.regexp_replace(spaced, "(?<![^ ])([a-z]) (?=[a-z](?![^ ]))", "$1")
    return F.array_remove(F.split(joined, " "), "")


def is_indic(token: Column) -> Column:
    return token >= F.lit("ऀ")


def mapped(tokens: Column, lexicon: dict[str, str]) -> Column:
    """Tokens through a variant-to-canonical lexicon (small and learned)."""
    if not lexicon:
        return tokens
    table = F.create_map(*[F.lit(x) for pair in sorted(lexicon.items()) for x in pair])
    return F.transform(tokens, lambda t: F.coalesce(F.try_element_at(table, t), t))


def without(tokens: Column, noise: set[str] | frozenset[str]) -> Column:
    """Tokens that are no noise; all of them if nothing would be left."""
    if not noise:
        return tokens
    core = F.filter(tokens, lambda t: ~t.isin(*sorted(noise)))
    return F.when(F.size(core) > 0, core).otherwise(tokens)


def is_subsequence(short: Column, long: Column) -> Column:
    """Do the letters of ``short`` stand in ``long`` in that order? Both of letters and digits."""
    return F.regexp_like(long, F.array_join(F.split(short, ""), ".*"))


def numbers(tokens: Column) -> Column:
    """Distinct digit runs of the tokens, without leading zeros."""
    runs = F.flatten(F.transform(tokens, lambda t: F.regexp_extract_all(t, F.lit("[0-9]+"), F.lit(0))))
    return F.array_sort(F.array_distinct(F.transform(runs, _bare)))


def _bare(run: Column) -> Column:
    return F.regexp_replace(run, "^0+(?=.)", "")


def _deletions(n: Column) -> Column:
    """The strings that lack one digit of a number of three or more."""
    each = F.transform(F.sequence(F.lit(1), F.length(n)), lambda j: F.concat(F.substr(n, F.lit(1), j - 1), F.substr(n, j + 1, F.length(n))))
    return F.when(F.length(n) >= 3, each).otherwise(F.array().cast("array<string>"))


def deletions(nums: Column) -> Column:
    """Numbers and, of those with three digits or more, all that lack one digit."""
    return F.array_sort(F.array_distinct(F.concat(nums, F.flatten(F.transform(nums, _deletions)))))


def _entries(prefix: str, parts: Column, weight: float) -> Column:
    return F.transform(parts, lambda p: F.struct(F.concat(F.lit(prefix), p).alias("feature"), F.lit(weight).alias("tf")))


def _grams(s: Column) -> Column:
    return F.when(F.length(s) >= 3, F.transform(F.sequence(F.lit(1), F.length(s) - 2), lambda i: F.substr(s, i, F.lit(3)))).otherwise(F.array().cast("array<string>"))


def name_bag(core: Column, phones: Column | None = None) -> Column:
    """Weighted words, sound keys (if given), 3-grams of the joined core, and initials."""
    w = NAME_WEIGHTS
    none = F.array().cast(BAG)
    first = F.element_at(core, 1)
    initials = F.array_join(F.transform(core, lambda t: F.substr(t, F.lit(1), F.lit(1))), "")
    acronym = F.when(F.size(core) >= 2, F.array(initials)).when(first.rlike("^([a-z]{2,4}|[ऀ-ॿ]{2,4})$"), F.array(first)).otherwise(F.array().cast("array<string>"))
    parts = [_entries("w", core, w["w"]), _entries("g", _grams(F.concat(F.lit("^"), F.array_join(core, ""), F.lit("$"))), w["g"]), _entries("i", acronym, w["i"])]
    if phones is not None:
        parts.append(_entries("p", F.filter(phones, lambda p: F.length(p) >= 2), w["p"]))
    return F.when(F.size(core) > 0, F.concat(*[p.cast(BAG) for p in parts])).otherwise(none)


def raw_bag(tokens: Column) -> Column:
    """3-grams of the space-joined tokens, legal forms and all."""
    return _entries("r", _grams(F.concat(F.lit("^"), F.array_join(tokens, " "), F.lit("$"))), 1.0).cast(BAG)


def address_bag(tokens: Column) -> Column:
    """Words, mixed tokens, numbers, their one-digit deletions, and numbers with a neighbouring word."""
    w = ADDRESS_WEIGHTS
    alpha = lambda t: t.rlike("^([a-z]+|[ऀ-ॿ]+)$")

    def of(t: Column, i: Column) -> Column:
        runs = F.transform(F.regexp_extract_all(t, F.lit("[0-9]+"), F.lit(0)), _bare)
        near = F.filter(F.array(F.when(i > 0, F.get(tokens, i - 1)), F.get(tokens, i + 1)), lambda x: F.coalesce(alpha(x) & (F.length(x) >= 3), F.lit(False)))
        pairs = F.flatten(F.transform(runs, lambda n: F.transform(near, lambda x: F.concat(n, F.lit("|"), x))))
        digits = F.concat(F.filter(runs, lambda n: F.length(n) >= 2), F.flatten(F.transform(runs, _deletions)))
        word = _entries("a", F.filter(F.array(t), lambda x: F.length(x) >= 2), w["a"]).cast(BAG)
        mixed = _entries("m", F.filter(F.array(t), lambda x: ~x.rlike("^[0-9]+$")), w["m"]).cast(BAG)
        rest = [_entries("n", runs, w["n"]).cast(BAG), _entries("d", digits, w["d"]).cast(BAG), _entries("c", pairs, w["c"]).cast(BAG)]
        return F.when(alpha(t), word).otherwise(F.concat(mixed, *rest))

    return F.when(F.size(tokens) > 0, F.flatten(F.transform(tokens, of))).otherwise(F.array().cast(BAG))


def long_bag(records: DataFrame, bag: Column, keys: tuple[str, ...] = ("entity_id", "country")) -> DataFrame:
    """(keys, feature, tf): the bag of each record, equal features summed."""
    return records.select(*keys, F.explode(bag).alias("f")).groupBy(*keys, F.col("f.feature").alias("feature")).agg(F.sum("f.tf").alias("tf"))
