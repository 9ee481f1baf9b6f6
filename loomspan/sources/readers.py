"""Readers: GFF3, BED, FASTA, SOFT archives, OBO, permutation statistics, chromosome files, plain tables. All are lazy scans.

Paths may be any that Spark reads; compressed files too. Formats whose records span lines are read by a record separator,
so a file may be split and no line order is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GFF = "seqname string, source string, feature string, start int, end int, score string, strand string, frame string, attributes string"


def read_table(spark: SparkSession, path: str, schema: str | None = None, header: bool = True, sep: str = "\t", comment: str | None = None) -> DataFrame:
    reader = spark.read.option("sep", sep).option("header", header).option("quote", "")
    if comment:
        reader = reader.option("comment", comment)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    """Nine columns; a row without start or end is an error when it is read."""
    rows = spark.read.option("sep", "\t").option("comment", "#").option("quote", "").schema(GFF).csv(path)
    checked = lambda c: F.when(F.col(c).isNull(), F.raise_error(F.lit(f"GFF row without {c}")).cast("int")).otherwise(F.col(c))
    return rows.withColumns({"start": checked("start"), "end": checked("end")})


def attribute_map(attributes: Column, attrsep: str = ";", fieldsep: str = "=") -> Column:
    """'a=1;b=2;c' to a map. A piece without a separator belongs to the value before it; later equal keys win."""
    empty = F.expr("cast(array() as array<struct<k:string,v:string>>)")

    def step(acc: Column, piece: Column) -> Column:
        parts = F.split(F.trim(piece), f"[{fieldsep}]")
        pair = F.struct(parts[0].alias("k"), parts[1].alias("v"))
        last = F.element_at(acc, -1)
        glued = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["k"].alias("k"), F.concat_ws(attrsep, last["v"], parts[0]).alias("v"))))
        return F.when(F.size(parts) == 2, F.concat(F.filter(acc, lambda x: x["k"] != pair["k"]), F.array(pair))).when((F.size(parts) == 1) & (F.size(acc) > 0) & (F.trim(piece) != ""), glued).otherwise(acc)

    pairs = F.aggregate(F.split(attributes, f"[{attrsep}]"), empty, step)
    return F.map_from_entries(pairs)


def gff_table(gff: DataFrame, keys: list[str] | None = None, most: int = 10_000) -> DataFrame:
    """Attributes as columns; without `keys` all that occur (their names are few and are read first).

    More than `most` names are an error and not cut: such files want `keys`, or attribute_map as a column.
    """
    mapped = gff.withColumn("__m", attribute_map(F.col("attributes")))
    if keys is None:
        keys = [r["k"] for r in mapped.select(F.explode(F.map_keys("__m")).alias("k")).distinct().orderBy("k").limit(most + 1).collect()]
        if len(keys) > most:
            raise ValueError(f"more than {most} attribute names; give keys")
    return mapped.select(*[c for c in gff.columns if c != "attributes"], *[F.col("__m")[k].alias(k) for k in keys])


def bed_coordinates(bed: DataFrame) -> DataFrame:
    """0-based half-open to 1-based: start + 1, 'chr' off the name, strand to 1 and -1. chr is a number only if all are."""
    name = F.regexp_replace(F.col("chr").cast("string"), "^chr", "")
    out = bed.withColumns({"start": F.col("start") + 1, "chr": name})
    if "strand" in bed.columns:
        out = out.withColumn("strand", F.when(F.col("strand") == "+", 1).when(F.col("strand") == "-", -1))
    odd = out.where(F.expr("try_cast(chr as int)").isNull()).limit(1).count()
    return out if odd else out.withColumn("chr", F.col("chr").cast("int"))


def read_bed(spark: SparkSession, path: str, header: tuple[str, ...] = ("chr", "start", "end", "name", "score")) -> DataFrame:
    kinds = {"start": "long", "end": "long", "score": "double"}
    return bed_coordinates(read_table(spark, path, ", ".join(f"{c} {kinds.get(c, 'string')}" for c in header), header=False, comment="#"))


def read_fasta(spark: SparkSession, path: str, comments: bool = True, id_pattern: str | None = None, split_desc: str | None = None, strip_desc: bool = True) -> DataFrame:
    """(id, desc, seq): '>' starts a record, ';' lines are comments (unless comments is off), '/' goes.

    id is the first word of the description without a last comma, or the first group of id_pattern in it. strip_desc takes
    blanks off the description's ends; split_desc adds `details`, its parts at that pattern.
    """
    record = spark.read.option("lineSep", "\n>").text(path).select(F.split(F.regexp_replace("value", "\r", ""), "\n").alias("lines"))
    lines = F.filter("lines", lambda x: ~x.startswith(";")) if comments else F.col("lines")
    record = record.select(lines.alias("lines")).where((F.size("lines") > 0) & (F.element_at("lines", 1) != ""))
    desc = F.regexp_replace(F.element_at("lines", 1), "^>", "")
    seq = F.replace(F.array_join(F.slice("lines", F.lit(2), F.size("lines")), ""), F.lit("/"), F.lit(""))
    desc = F.trim(desc) if strip_desc else desc
    id_ = F.regexp_extract(desc, id_pattern, 1) if id_pattern else F.regexp_replace(F.element_at(F.split(desc, r"\s+"), 1), ",$", "")
    return record.select(id_.alias("id"), desc.alias("desc"), *([F.split(desc, split_desc).alias("details")] if split_desc else []), seq.alias("seq"))


def read_soft(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(platform: probe, fields map; samples: sample, title; values: sample, probe, value) of a SOFT archive.

    Records begin at '^', so samples may be read apart. Probes that the platform lacks are dropped.
    """
    records = spark.read.option("lineSep", "\n^").text(path).select(F.split(F.regexp_replace("value", "\r", ""), "\n").alias("lines"))
    head = F.regexp_replace(F.element_at("lines", 1), r"^\^", "")
    records = records.select(F.trim(F.element_at(F.split(head, "="), 1)).alias("kind"), F.trim(F.element_at(F.split(head, "="), 2)).alias("name"), "lines")

    def body(kind: str) -> Column:
        first, last = (F.array_position("lines", F.lit(f"!{kind}_table_{end}")).cast("int") for end in ("begin", "end"))
        return F.slice("lines", first + 1, F.greatest(last - first - 1, F.lit(0)))

    def cells(kind: str, tag: str) -> DataFrame:
        rows = records.where(F.col("kind") == tag).select("name", body(kind).alias("rows")).where(F.size("rows") > 1)
        rows = rows.select("name", F.split(F.element_at("rows", 1), "\t").alias("columns"), F.explode(F.slice("rows", F.lit(2), F.size("rows"))).alias("row"))
        return rows.select("name", F.map_from_arrays("columns", F.slice(F.split("row", "\t", -1), F.lit(1), F.size("columns"))).alias("m"))

    platform = cells("platform", "PLATFORM").select(F.col("m")["ID"].alias("probe"), F.col("m").alias("fields"))
    title = F.element_at(F.filter("lines", lambda x: x.startswith("!Sample_title")), 1)
    samples = records.where("kind = 'SAMPLE'").select(F.col("name").alias("sample"), F.trim(F.element_at(F.split(title, "="), 2)).alias("title"))
    values = cells("sample", "SAMPLE").select(F.col("name").alias("sample"), F.col("m")["ID_REF"].alias("probe"), F.expr("try_cast(m['VALUE'] as double)").alias("value"))
    return platform, samples, values.join(platform.select("probe"), "probe", "left_semi")


def summarize_probes(values: DataFrame, platform: DataFrame, field: str, avg="mean", keep_empty: bool = False) -> DataFrame:
    """(sample, feature, value): probes of one feature averaged by mean, median or any Column aggregate.

    Probes without a feature are dropped, or with keep_empty stay under their own names.
    """
    own = F.nullif(F.col("fields")[field], F.lit(""))
    of = platform.select("probe", (F.coalesce(own, F.col("probe")) if keep_empty else own).alias("feature")).where("feature is not null")
    return values.join(of, "probe").groupBy("sample", "feature").agg({"mean": F.avg, "median": F.median}.get(avg, avg)("value").alias("value"))


def read_obo(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(terms: id, name, obsolete; parents: id, parent) of an OBO file, by stanza."""
    stanza = spark.read.option("lineSep", "\n[").text(path).where(F.col("value").startswith("Term]") | F.col("value").startswith("[Term]")).select(F.split("value", "\n").alias("lines"))
    tag = lambda name: F.regexp_replace(F.element_at(F.filter("lines", lambda x: x.startswith(f"{name}: ")), 1), f"^{name}: ", "")
    parents = F.transform(F.filter("lines", lambda x: x.startswith("is_a: ")), lambda x: F.regexp_extract(x, r"^is_a: (\S+)", 1))
    rows = stanza.select(tag("id").alias("id"), tag("name").alias("name"), F.exists("lines", lambda x: x == "is_obsolete: true").alias("obsolete"), parents.alias("parents"))
    terms = rows.select("id", "name", (F.col("obsolete") | F.coalesce(F.col("name").startswith("obsolete"), F.lit(False))).alias("obsolete"))
    return terms, rows.select("id", F.explode("parents").alias("parent"))


def ancestors(parents: DataFrame, limit: int = 64) -> DataFrame:
    """(id, ancestor) pairs of an acyclic graph, by doubling paths until none is new. Each round is cut from the one before it:
    a checkpoint where the session has a folder for them, else the executors' memory and disks, from which lost parts are redone."""
    folder = parents.sparkSession.sparkContext.getCheckpointDir()
    cut = lambda df: df.checkpoint() if folder else df.persist()
    found = cut(parents.select("id", F.col("parent").alias("ancestor")).distinct())
    n = found.count()
    for _ in range(limit):
        longer = found.join(found.select(F.col("id").alias("ancestor"), F.col("ancestor").alias("__a")), "ancestor").select("id", F.col("__a").alias("ancestor"))
        found = cut(found.unionAll(longer).distinct())
        m = found.count()
        if m == n:
            return found
        n = m
    return found


def minimal_terms(annotation: DataFrame, closure: DataFrame) -> DataFrame:
    """(id, term) without terms that are ancestors of another term of the same id."""
    implied = annotation.join(closure.withColumnRenamed("id", "term"), "term").select("id", F.col("ancestor").alias("term")).distinct()
    return annotation.join(implied, ["id", "term"], "left_anti")


def named_terms(annotation: DataFrame, terms: DataFrame, short: dict[str, str] | None = None) -> DataFrame:
    """Term names; unknown ones keep their id. short: what is written for a part of a name, each in its turn."""
    name = F.coalesce("name", "term")
    for long, less in (short or {}).items():
        name = F.replace(name, F.lit(long), F.lit(less))
    return annotation.join(terms.select(F.col("id").alias("term"), "name"), "term", "left").select("id", "term", name.alias("name"))


def with_roots(annotation: DataFrame, closure: DataFrame) -> DataFrame:
    """(id, term, root): the ancestors of a term that have none themselves; a term without ancestors is its own root."""
    inner = closure.select(F.col("id").alias("ancestor")).distinct()
    roots = closure.join(inner, "ancestor", "left_anti").select(F.col("id").alias("term"), F.col("ancestor").alias("root"))
    return annotation.join(roots, "term", "left").select("id", "term", F.coalesce("root", "term").alias("root"))


def read_jaccard(spark: SparkSession, path: str, symmetric: bool = False) -> tuple[DataFrame, DataFrame]:
    """(cells, margins) of permutation statistics: p is random / permutations; rows without a query or target are margins."""
    rows = read_table(spark, path, "query string, target string, intersect long, union long, jaccard double, count long, random long, permutations long")
    blank = (F.coalesce("query", F.lit("")) == "") | (F.coalesce("target", F.lit("")) == "")
    cells = rows.where(~blank).withColumn("p_value", F.try_divide("random", "permutations"))
    if symmetric:
        cells = cells.groupBy(F.least("query", "target").alias("query"), F.greatest("query", "target").alias("target")).agg(*[F.max(c).alias(c) for c in ("intersect", "union", "jaccard", "count", "random", "permutations", "p_value")])
    return cells, rows.where(blank)


def read_chromosomes(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """(chr, name, len): name in the first column, length in the last, numbered in file order (one small file)."""
    text = spark.read.text(path).where(F.trim("value") != "").withColumn("__n", F.monotonically_increasing_id())
    if header:
        text = text.where(F.col("__n") > 0)
    parts = F.split("value", "\t")
    from pyspark.sql import Window

    return text.select(F.row_number().over(Window.orderBy("__n")).alias("chr"), parts[0].alias("name"), F.element_at(parts, -1).cast("long").alias("len"))


def read_timing(spark: SparkSession, path: str) -> DataFrame:
    """(seq, label, value) of a timing log, one small file, in the order of its lines; stats.timing_rows makes rows of runs of it."""
    return read_table(spark, path, "label string, value string", header=False).select(F.monotonically_increasing_id().alias("seq"), "label", "value")


def painted(bed: DataFrame, spine: DataFrame) -> DataFrame:
    """Every position of spine (chr, coor) with the value of the last BED row (by `row`) that covers it, null where none does.

    Positions meet the rows by the bucketed overlap join; a row's bases are not listed.
    """
    from loomspan.operators.intervals import points_in

    rows = bed.select("chr", (F.col("start") + 1).alias("start"), "end", "row", "value").where("start <= end")
    top = points_in(spine.select("chr", "coor"), rows).groupBy("chr", F.col("q_coor").alias("coor")).agg(F.max_by("t_value", "t_row").alias("value"))
    return spine.join(top, ["chr", "coor"], "left")


def zipped(parts: list[DataFrame], keys: tuple[str, ...] = ("chr", "coor")) -> DataFrame:
    """Tables of the same positions side by side; a position that one lacks is an error when it is read."""
    out = parts[0].withColumn("__0", F.lit(True))
    for k, p in enumerate(parts[1:], 1):
        out = out.join(p.withColumn(f"__{k}", F.lit(True)), list(keys), "full_outer")
    marks = [f"__{k}" for k in range(len(parts))]
    bad = F.when(sum((F.col(m).isNull().cast("int") for m in marks), F.lit(0)) > 0, F.raise_error(F.lit("positions differ")).cast("boolean"))
    return out.where(bad.isNull()).drop(*marks)


def annotation_list(df: DataFrame, terms: str = "terms", sep: str = ";", pattern: str | None = None) -> DataFrame:
    """(id, term) from joined lists, membership exact; with a pattern, terms that match it."""
    out = df.select("id", F.explode(F.array_distinct(F.split(terms, sep))).alias("term")).where("term <> ''")
    return out.where(F.col("term").rlike(pattern)) if pattern else out


def annotation_pairs(df: DataFrame, key: str, term: str | None = None) -> DataFrame:
    """Distinct (id, key[, term]) rows without empty keys."""
    return df.where(F.col(key).isNotNull() & (F.col(key) != "")).select("id", F.col(key).alias("key"), *([F.col(term).alias("term")] if term else [])).distinct()
