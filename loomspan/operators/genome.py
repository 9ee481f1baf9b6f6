"""Coordinates: chromosome index, projections to a running index and back, flanks, pruning, borders, circular features.

Interval tables have chr, start, end (1-based, both ends in it), strand ('-' or '-1' is reverse, all else forward) and an
id; other columns are carried along. Rows have no order of their own, so ties go by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def is_reverse(strand: str | Column = "strand") -> Column:
    c = F.col(strand) if isinstance(strand, str) else strand
    return F.coalesce(c.cast("string").isin("-", "-1"), F.lit(False))


def chrom_index(chroms: DataFrame) -> DataFrame:
    """(chr, len, offset, total) from (chr, len): running starts. The table has a row for each chromosome, so one window does."""
    w = Window.orderBy("chr")
    return chroms.select("chr", F.col("len").cast("long").alias("len"), (F.sum("len").over(w) - F.col("len")).cast("long").alias("offset"), F.sum("len").over(Window.partitionBy()).cast("long").alias("total"))


def to_index(features: DataFrame, chroms: DataFrame, circular: bool = False, cols: tuple[str, ...] = ("start", "end")) -> DataFrame:
    """Columns idx_<col>: position plus the chromosome's offset, plus the total on the reverse strand. Unknown chr: null.

    start > end is put in order unless features may be circular.
    """
    first, last = cols[0], cols[-1]
    if len(cols) == 2 and not circular:
        features = features.withColumns({first: F.least(first, last), last: F.greatest(first, last)})
    shift = F.col("offset") + F.when(is_reverse(), F.col("total")).otherwise(0)
    joined = features.join(chrom_index(chroms).drop("len"), "chr", "left")
    return joined.select("*", *[(F.col(c) + shift).alias(f"idx_{c}") for c in cols]).drop("offset", "total")


#: Running indexes meet chromosomes by blocks of so many positions.
INDEX_BLOCK = 1 << 22


def _strands(chroms: DataFrame) -> DataFrame:
    """(chr, strand, len, low, block): where each chromosome strand lies on the running index, once for each block it touches."""
    index = chrom_index(chroms)
    both = index.select("chr", "len", F.col("offset").alias("low"), F.lit("+").alias("strand")).unionAll(index.select("chr", "len", F.col("offset") + F.col("total"), F.lit("-")))
    # a chromosome has positions low + 1 .. low + len
    return both.where("len > 0").withColumn("block", F.explode(F.sequence(F.floor((F.col("low") + 1) / INDEX_BLOCK), F.floor((F.col("low") + F.col("len")) / INDEX_BLOCK))))


def from_index(df: DataFrame, chroms: DataFrame, cols: tuple[str, ...] = ("idx_start", "idx_end")) -> DataFrame:
    """chr, strand and plain positions back from index columns. The first column decides chr and strand for all."""
    at = F.col(cols[0])
    there = _strands(chroms).withColumnRenamed("block", "__block")
    rows = df.drop("chr", "strand").withColumn("__block", F.floor(at / INDEX_BLOCK))
    joined = rows.join(there, (rows["__block"] == there["__block"]) & (at > F.col("low")) & (at <= F.col("low") + F.col("len")), "left").drop("__block")
    return joined.select("*", *[(F.col(c) - F.col("low")).alias(c.removeprefix("idx_")) for c in cols if c.removeprefix("idx_") not in df.columns]).drop("low", "len", *cols)


def switch_strand(df: DataFrame, strand: str = "strand") -> DataFrame:
    return df.withColumn(strand, F.when(is_reverse(strand), F.lit("+")).otherwise(F.lit("-")))


def flank(df: DataFrame, upstream: int) -> DataFrame:
    """The `|upstream|` positions next to each interval: before it for a negative number, after it for a positive one, along its strand."""
    if upstream == 0:
        raise ValueError("a flank needs a width")
    lo, hi, n = F.least("start", "end"), F.greatest("start", "end"), abs(upstream)
    left = ~is_reverse() if upstream < 0 else is_reverse()
    return df.withColumns({"start": F.when(left, lo - n).otherwise(hi + 1), "end": F.when(left, lo - 1).otherwise(hi + n)})


def prune(df: DataFrame, chroms: DataFrame, remove_one_bp: bool = False) -> DataFrame:
    """Positions clamped to the chromosome. remove_one_bp drops start == end, as clamped leftovers have, and all 1-bp rows with them."""
    out = df.join(chroms.select("chr", F.col("len").cast("long").alias("__len")), "chr", "left")
    clamp = lambda c: F.greatest(F.least(F.col(c), F.col("__len")), F.lit(1).cast("long"))
    out = out.withColumns({"start": clamp("start"), "end": clamp("end")}).drop("__len")
    return out.where("start <> end") if remove_one_bp else out


def numbered(df: DataFrame, first: list[Column], position: Column, last: list[str], out: str, block: int = 1 << 20) -> DataFrame:
    """Column `out`: 1, 2, ... in the order of `first`, `position`, `last`, which together are unique.

    Rows are counted by `first` and blocks of positions, the counts are summed, and a window numbers each block's rows: the
    one window over everything sees a row for each block of the genome and none for each row of df.
    """
    names = [f"__f{i}" for i in range(len(first))]
    rows = df.withColumns({**dict(zip(names, first)), "__at": position}).withColumn("__block", F.floor(F.col("__at") / block))
    counts = rows.groupBy(*names, "__block").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy(*names, "__block").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")
    counts = counts.select(*[F.col(c).alias(f"{c}b") for c in names], F.col("__block").alias("__blockb"), before.alias("__before"))
    same = F.col("__block").eqNullSafe(F.col("__blockb"))
    for c in names:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}b"))
    place = F.row_number().over(Window.partitionBy(*names, "__block").orderBy("__at", *last))
    numbered_ = rows.withColumn("__place", place).join(counts, same)
    return numbered_.withColumn(out, (F.col("__place") + F.col("__before")).cast("long")).select(*[c for c in df.columns if c != out], out)


def sort_rank(df: DataFrame, by_strand: bool = False) -> DataFrame:
    """Column `place` in the order of chr, then the smaller end, then id; with by_strand, reverse rows come last."""
    first = [F.when(is_reverse(), 1).otherwise(0)] if by_strand else []
    return numbered(df, [*first, F.col("chr")], F.least("start", "end"), ["id"], "place")


def ordered(df: DataFrame) -> DataFrame:
    """start <= end."""
    return df.withColumns({"start": F.least("start", "end"), "end": F.greatest("start", "end")})


def split_at_borders(df: DataFrame, chroms: DataFrame) -> DataFrame:
    """Index intervals (id, idx_start, idx_end) cut where chromosomes meet: id, part, chr, strand, start, end."""
    there = _strands(chroms).withColumnRenamed("block", "__block")
    blocks = F.sequence(F.floor(F.col("idx_start") / INDEX_BLOCK), F.floor(F.col("idx_end") / INDEX_BLOCK))
    rows = df.select("id", "idx_start", "idx_end").withColumn("__block", F.explode(blocks))
    joined = rows.join(there, "__block").where((F.col("idx_start") <= F.col("low") + F.col("len")) & (F.col("idx_end") > F.col("low")))
    # both may touch several blocks: they meet in the first that they share
    joined = joined.where(F.col("__block") == F.floor(F.greatest(F.col("idx_start"), F.col("low") + 1) / INDEX_BLOCK))
    parts = joined.select("id", "chr", "strand", F.greatest(F.col("idx_start") - F.col("low"), F.lit(1)).alias("start"), F.least(F.col("idx_end") - F.col("low"), F.col("len")).alias("end"), "low")
    return parts.withColumn("part", F.row_number().over(Window.partitionBy("id").orderBy("low"))).select("id", "part", "chr", "strand", "start", "end")


def part_name(tag: str = "_") -> Column:
    """id of a part: the first keeps it, later ones get _2, _3, ..."""
    return F.when(F.col("part") > 1, F.concat(F.col("id").cast("string"), F.lit(tag), F.col("part").cast("string"))).otherwise(F.col("id").cast("string"))


def expand_circular(df: DataFrame, chroms: DataFrame, tag: str = "-circ2") -> DataFrame:
    """Features with start > end run over the origin: they become two rows; the second names the first as parent."""
    out = df.join(chroms.select("chr", F.col("len").cast("long").alias("__len")), "chr", "left")
    wraps, back = F.col("start") > F.col("end"), is_reverse()
    one = F.struct(F.when(wraps & back, F.lit(1).cast("long")).otherwise(F.col("start")).alias("start"), F.when(wraps & ~back, F.col("__len")).otherwise(F.col("end")).alias("end"), F.col("id").cast("string").alias("id"), F.lit(None).cast("string").alias("parent"))
    two = F.struct(F.when(back, F.col("start")).otherwise(F.lit(1).cast("long")).alias("start"), F.when(back, F.col("__len")).otherwise(F.col("end")).alias("end"), F.concat(F.col("id").cast("string"), F.lit(tag)).alias("id"), F.col("id").cast("string").alias("parent"))
    out = out.withColumn("__part", F.explode(F.when(wraps, F.array(one, two)).otherwise(F.array(one))))
    kept = [c for c in df.columns if c not in ("start", "end", "id")]
    return out.select(*kept, "__part.start", "__part.end", "__part.id", "__part.parent")


def join_circular(df: DataFrame) -> DataFrame:
    """The inverse: rows that have a parent give their far end back to it and go."""
    child = df.where("parent is not null").select(F.col("parent").alias("id"), F.col("start").alias("__s"), F.col("end").alias("__e"))
    out = df.where("parent is null").join(child, "id", "left")
    back = is_reverse()
    start = F.when(F.col("__s").isNotNull() & back, F.col("__s")).otherwise(F.col("start"))
    end = F.when(F.col("__s").isNotNull() & ~back, F.col("__e")).otherwise(F.col("end"))
    return out.withColumns({"start": start, "end": end}).drop("parent", "__s", "__e")


def clean_circular(hits: DataFrame, chroms: DataFrame) -> DataFrame:
    """Hits on sequences that repeat their begin after their end: hits in the repeat go, ends beyond the length wrap.

    A plain hit that ends where a wrapped one of the same chr ends goes as well; starts below 1 count from the end.
    """
    out = hits.join(chroms.select("chr", F.col("len").cast("long").alias("__len")), "chr").where("least(start, end) <= __len")
    out = out.withColumn("wrapped", F.greatest("start", "end") > F.col("__len"))
    fold = lambda c: F.when(F.col(c) > F.col("__len"), F.col(c) - F.col("__len")).when(F.col(c) < 1, F.col(c) + F.col("__len")).otherwise(F.col(c))
    out = out.withColumns({"start": fold("start"), "end": fold("end")}).drop("__len")
    ends = out.where("wrapped").select("chr", "end", F.lit(False).alias("wrapped")).distinct()
    return out.join(ends, ["chr", "end", "wrapped"], "left_anti")


def codon_start(start: Column, residue: Column, strand: Column) -> Column:
    """Where the codon of a residue is counted from; it lies one base outside the codon."""
    return F.when(is_reverse(strand), start + 1 - 3 * (residue - 1)).otherwise(start - 1 + 3 * (residue - 1))


def fuse(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Rows with fuse = 1 extend the row before them: first start and id, last end."""
    w = Window.partitionBy(*group).orderBy(*order)
    run = F.sum(F.when((F.col("fuse") == 1) & (F.row_number().over(w) > 1), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    marked = df.withColumns({"__at": F.row_number().over(w)}).withColumn("__run", run)
    return marked.groupBy(*group, "__run").agg(F.min_by("id", "__at").alias("id"), F.min_by("start", "__at").alias("start"), F.max_by("end", "__at").alias("end"), F.count("*").alias("n")).drop("__run")


def tag_duplicates(df: DataFrame, name: str, order: str) -> DataFrame:
    """The second, third, ... row of a name is called <name up to its first dot>.2, .3, ..."""
    n = F.row_number().over(Window.partitionBy(name).orderBy(order))
    return df.withColumn("tagged", F.when(n > 1, F.concat(F.substring_index(F.col(name), ".", 1), F.lit("."), n.cast("string"))).otherwise(F.col(name)))


def insert_rows(df: DataFrame, new: DataFrame, place: str = "place") -> DataFrame:
    """Rows of `new` come right after the row of df that has the same place."""
    both = df.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    return numbered(both, [], F.col(place), ["__new", "id"], "__n").drop(place, "__new").withColumnRenamed("__n", place)


def collapse_list(df: DataFrame, name: str) -> DataFrame:
    """A list column to (id, value) rows."""
    return df.select("id", F.explode(name).alias("value"))
