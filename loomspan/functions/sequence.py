"""Sequence functions: complement, composition, windows, mutations, class strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def revcomp(s: Column) -> Column:
    """Reverse complement in upper case; what is no A, C, G, T or U becomes N."""
    return F.reverse(F.translate(F.regexp_replace(F.upper(s), "[^ACGTU]", "N"), "ACGTU", "TGCAA"))


def letters(df: DataFrame, seq: str = "seq") -> DataFrame:
    """(id, pos, letter), pos from 1."""
    return df.select("id", F.posexplode(F.split(seq, "")).alias("pos", "letter")).where("letter <> ''").withColumn("pos", F.col("pos") + 1)


def letter_frequency(df: DataFrame, seq: str = "seq", alphabet: str = "ACGT") -> DataFrame:
    """Share of each letter, from lengths alone."""
    n = F.length(seq)
    parts = F.array(*[F.struct(F.lit(a).alias("letter"), F.try_divide(n - F.length(F.replace(F.col(seq), F.lit(a), F.lit(""))), n).alias("frequency")) for a in alphabet])
    return df.select("id", F.explode(parts).alias("p")).select("id", "p.letter", "p.frequency")


def range_frequency(df: DataFrame, ranges: DataFrame, alphabet: str = "ACGT") -> DataFrame:
    """letter_frequency of ranges (id, start, end) of the sequences."""
    cut = df.join(ranges, "id").select("id", F.expr("substring(seq, start, end - start + 1)").alias("seq"))
    return letter_frequency(cut, "seq", alphabet)


def window_composition(df: DataFrame, window: int, step: int = 1, alphabet: str = "ACGT") -> DataFrame:
    """(id, start, letter, frequency) in windows of window + 1 letters, each `step` starts, full windows only."""
    size = window + 1
    starts = F.sequence(F.lit(1), F.length("seq") - window, F.lit(step))
    cut = df.where(F.length("seq") >= size).select("id", "seq", F.explode(starts).alias("start"))
    piece = F.substring(F.col("seq"), F.col("start"), F.lit(size))
    cut = cut.select("id", "start", piece.alias("piece"))
    parts = F.array(*[F.struct(F.lit(a).alias("letter"), ((size - F.length(F.replace(F.col("piece"), F.lit(a), F.lit("")))) / size).alias("frequency")) for a in alphabet])
    return cut.select("id", "start", F.explode(parts).alias("p")).select("id", "start", "p.letter", "p.frequency")


def skew(df: DataFrame, a: str, b: str, window: int, step: int = 1) -> DataFrame:
    """(id, start, skew, cumulative): (a - b) / (a + b) in windows, and its running sum times window / length."""
    size = window + 1
    starts = F.sequence(F.lit(1), F.length("seq") - window, F.lit(step))
    cut = df.where(F.length("seq") >= size).select("id", F.length("seq").alias("n"), "seq", F.explode(starts).alias("start"))
    piece = F.substring(F.col("seq"), F.col("start"), F.lit(size))
    count = lambda x: size - F.length(F.replace(piece, F.lit(x), F.lit("")))
    out = cut.select("id", "n", "start", F.try_divide(count(a) - count(b), count(a) + count(b)).alias("skew"))
    w = Window.partitionBy("id").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    return out.select("id", "start", "skew", (F.sum(F.coalesce("skew", F.lit(0.0))).over(w) * step / F.col("n")).alias("cumulative"))


def mutate(seq: Column, mutations: Column) -> Column:
    """Apply 'A3T' mutations (an array); a source letter that isn't there, or a place named twice, is an error."""

    def step(s: Column, m: Column) -> Column:
        at = F.regexp_extract(m, r"^[A-Za-z](\d+)[A-Za-z]$", 1).cast("int")
        fits = F.substring(s, at, F.lit(1)) == F.substring(m, 1, 1)
        return F.when(fits, F.overlay(s, F.substring(m, -1, 1), at, F.lit(1))).otherwise(F.raise_error(F.concat(F.lit("no such letter: "), m)).cast("string"))

    places = F.transform(mutations, lambda m: F.regexp_extract(m, r"(\d+)", 1))
    twice = F.size(F.array_distinct(places)) < F.size(mutations)
    return F.when(twice, F.raise_error(F.lit("a place is named twice")).cast("string")).otherwise(F.aggregate(mutations, seq, step))


def class_table(df: DataFrame, name: str = "segtype", sep: str = "_", gsep: str = ":") -> DataFrame:
    """(name, key, value) of 'K:12_S:icor' strings, keys of one value for all left out."""
    m = df.select(name).distinct().select(name, F.explode(F.str_to_map(name, F.lit(sep), F.lit(gsep))).alias("key", "value"))
    varying = m.groupBy("key").agg(F.countDistinct("value").alias("n")).where("n > 1").select("key")
    return m.join(varying, "key").select(name, "key", "value")


def class_pieces(df: DataFrame, name: str = "segtype", sep: str = "_") -> DataFrame:
    """Pieces of class strings that not every string has."""
    every = df.select(name).distinct()
    pieces = every.select(name, F.explode(F.array_distinct(F.split(name, sep))).alias("piece")).groupBy("piece").agg(F.count("*").alias("n"))
    return pieces.crossJoin(every.agg(F.count("*").alias("total"))).where("n < total").select("piece")
