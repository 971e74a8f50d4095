"""Tokenizers, stemmer, synonyms and text features as Column expressions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heddle.functions.synonyms import COLLOQUIAL, SYNONYMS

# The stop words of the lexical index.
STOP_WORDS = "a an and are as at be by for from has he in is it its of on or that the to was were will with".split()
_STOP = frozenset(STOP_WORDS)


def lexical_tokens(text: Column) -> Column:
    """Terms of a text before stemming.

    Runs of letters, digits and hyphens are lower-cased; a run with a hyphen
    gives its parts and then the parts joined; terms under two characters and
    stop words are left out.  Null gives an empty array.
    """
    runs = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{Nd}-]+)"), F.lit(1))
    parts = lambda r: F.filter(F.split(r, "-"), lambda p: p != "")
    terms = F.flatten(F.transform(runs, lambda r: F.when(F.contains(r, F.lit("-")), F.concat(parts(r), F.array(F.array_join(parts(r), "")))).otherwise(F.array(r))))
    return F.filter(terms, lambda t: (F.length(t) >= 2) & ~t.isin(STOP_WORDS))


_RUNS = regex.compile(r"[\p{L}\p{Nd}-]+")


def lexical_terms(text: str | None) -> list[str]:
    """The tokens of ``lexical_tokens`` for one text inside an Arrow function."""
    out: list[str] = []
    for run in _RUNS.findall(text.lower()) if text else []:
        if "-" in run:
            parts = [p for p in run.split("-") if p]
            out += [*parts, "".join(parts)]
        else:
            out.append(run)
    return [t for t in out if len(t) >= 2 and t not in _STOP]


def loose_tokens(text: Column) -> Column:
    """Tokens for synonym lookup: runs that may hold hyphens and underscores inside, lower-cased, of two characters or more."""
    runs = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{Nd}_-]+)"), F.lit(1))
    return F.filter(F.transform(runs, lambda r: F.regexp_replace(r, "^[-_]+|[-_]+$", "")), lambda t: F.length(t) >= 2)


# Suffix rules of steps two and three, tried in this order.
STEP_TWO = "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble tion:t"
STEP_THREE = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"


def _vowels(word: str) -> list[bool]:
    out: list[bool] = []
    for i, c in enumerate(word):
        out.append(c in "aeiou" or (c == "y" and i > 0 and not out[i - 1]))
    return out


def _measure(word: str) -> int:
    v = _vowels(word)
    return sum(a and not b for a, b in zip(v, v[1:]))


def stem(word: str) -> str:
    """The first three Porter steps, with a last rule that turns -tion into -t."""
    if len(word) < 3:
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss") and len(word) > 3:
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        cut = 3 if word.endswith("ing") and len(word) > 4 else 2 if word.endswith("ed") and len(word) > 3 else 0
        if cut and any(_vowels(word[:-cut])):
            word = word[:-cut]
            v = _vowels(word)
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif len(word) > 1 and word[-1] == word[-2] and not v[-1] and word[-1] not in "lsz":
                word = word[:-1]
            elif _measure(word) == 1 and len(word) > 2 and not v[-1] and v[-2] and not v[-3] and word[-1] not in "wxy":
                word += "e"
    for rules in (STEP_TWO, STEP_THREE):
        for rule in rules.split():
            suffix, new = rule.split(":")
            if word.endswith(suffix):
                base = word[: -len(suffix)]
                word = base + new if _measure(base) > 0 else word
                break
    return word


def stemmed(terms: DataFrame, column: str) -> DataFrame:
    """``terms`` with ``column`` stemmed: each distinct term goes through Python once."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(stem, na_action="ignore")

    distinct = terms.select(column).distinct().withColumn("_stem", F.pandas_udf(run, "string")(F.col(column)))
    return terms.join(distinct, column, "left").withColumn(column, F.col("_stem")).drop("_stem")


def mapping(spark: SparkSession, text: str) -> DataFrame:
    """(term, pos, other) of a word table; its size is fixed in the code."""
    rows = [(line.split(":")[0].strip(), i, w) for line in text.strip().splitlines() for i, w in enumerate(line.split(":")[1].split())]
    return spark.createDataFrame(rows, "term string, pos int, other string")


def expand_queries(queries: DataFrame, key: str, text: str, per_term: int = 3) -> DataFrame:
    """(key, expansions): up to ``per_term`` new synonyms for each matched token, in order of tokens.

    A synonym is new if it is neither a token of the query nor added before.
    Queries without a match, blank and null ones give an empty array.
    """
    tokens = loose_tokens(F.col(text))
    table = F.create_map(*[F.lit(x) for line in SYNONYMS.strip().splitlines() for x in (line.split(":")[0].strip(), line.split(":")[1].strip())])
    known = lambda t: F.split(F.element_at(table, t), " ")
    start = F.array().cast("array<string>")

    def step(have: Column, token: Column) -> Column:
        fresh = F.filter(known(token), lambda s: ~F.array_contains(have, s) & ~F.array_contains(F.col("_tokens"), s))
        return F.concat(have, F.coalesce(F.slice(fresh, 1, per_term), start))

    rows = queries.select(key, tokens.alias("_tokens"))
    return rows.select(key, F.aggregate("_tokens", start, step).alias("expansions"))


def enrich(entries: DataFrame, key: str, text: str, most: int = 20) -> DataFrame:
    """(key, keywords): colloquial aliases of technical terms in a text, sorted, ``most`` at most.

    Aliases that are tokens of the text themselves are left out.  The order is
    alphabetic, so that the cut at ``most`` is defined.
    """
    spark = entries.sparkSession
    aliases = F.broadcast(mapping(spark, COLLOQUIAL))
    tokens = entries.select(key, F.array_distinct(loose_tokens(F.col(text))).alias("_all"))
    hits = tokens.select(key, "_all", F.explode("_all").alias("term")).join(aliases, "term").where(~F.array_contains("_all", F.col("other")))
    return hits.groupBy(key).agg(F.slice(F.array_sort(F.collect_set("other")), 1, most).alias("keywords"))


def expansion_terms(ranked: DataFrame, query: str, text: str, query_text: str, top: int = 5, least: int = 2, most: int = 5) -> DataFrame:
    """Pseudo-relevance terms: (query, term, df, tf, score, rank) of terms in at least ``least`` of the top documents.

    The score is df * 10 + tf; terms of the query itself are left out; equal
    scores rank alphabetically.  ``ranked`` has a column rank.
    """
    rows = ranked.where(F.col("rank") <= top).select(query, "rank", F.explode(lexical_tokens(F.col(text))).alias("term"))
    own = ranked.select(query, query_text).distinct().select(query, F.explode(lexical_tokens(F.col(query_text))).alias("term"))
    rows = rows.join(own, [query, "term"], "left_anti")
    terms = rows.groupBy(query, "term").agg(F.count_distinct("rank").alias("df"), F.count("*").alias("tf")).where(F.col("df") >= least)
    terms = terms.withColumn("score", F.col("df") * 10 + F.col("tf"))
    order = Window.partitionBy(query).orderBy(F.desc("score"), "term")
    return terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.floor((F.length(text) + 3) / 4).cast("int")


def token_estimate_fine(text: Column) -> Column:
    """Runs of letters and digits count ceil(UTF-8 bytes / 4), every other visible character counts one."""
    runs = F.regexp_extract_all(text, F.lit(r"([\p{L}\p{Nd}]+)"), F.lit(1))
    rest = F.length(F.regexp_replace(text, r"[\p{L}\p{Nd}\s]", ""))
    return (F.aggregate(runs, F.lit(0), lambda s, r: s + F.ceil(F.octet_length(r) / 4).cast("int")) + rest).cast("int")


def truncated(text: Column, limit: int = 120) -> Column:
    """Text cut at the last space before ``limit`` - 3 with three dots; shorter texts are unchanged."""
    head = F.substring(text, 1, limit - 3)
    at = F.length(head) - F.locate(" ", F.reverse(head))
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.when(F.contains(head, F.lit(" ")), F.substring(head, F.lit(1), at)).otherwise(head), F.lit("...")))


def contextual(category: Column, ns: Column, text: Column) -> Column:
    """Text with its category, or else its namespace, in brackets before it."""
    return F.concat(F.lit("["), F.when(F.trim(category) != "", category).otherwise(ns), F.lit("] "), text)
