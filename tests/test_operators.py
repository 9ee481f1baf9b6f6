"""Hand-computed cases and properties."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.functions import scalar, sequence
from loomspan.operators import genome, intervals, series, stats
from loomspan.sources import readers, writers
from loomspan.streaming.annotate import annotate_stream

IV = "id long, chr int, start long, end long, strand string, type string"


def iv(spark, rows):
    return spark.createDataFrame([(i, 1, a, b, "+", "x") if len(r) == 0 else (i, 1, a, b, *r) for i, a, b, *r in rows], IV)


def test_micro_hits(spark):
    targets = iv(spark, [(1, 100, 199), (2, 500, 500), (3, 900, 999)])
    queries = iv(spark, [(10, 100, 199), (11, 50, 149), (12, 150, 249), (13, 120, 129), (14, 90, 210), (15, 199, 300), (16, 200, 300), (17, 500, 500)])
    got = {(r.target, r.query): (r.intersect, r.union, r.qpos, r.qrank) for r in intervals.annotate(queries, targets, add_na=True).collect()}
    assert got == {
        (1, 10): (100, 100, "covers", 1), (1, 14): (100, 121, "covers", 2), (1, 11): (50, 150, "left", 3), (1, 12): (50, 150, "right", 3),
        (1, 13): (10, 100, "inside", 5), (1, 15): (1, 201, "right", 6), (2, 17): (1, 1, "covers", 1), (3, None): (0, 0, None, 1),
    }


@pytest.mark.parametrize("seed", range(3))
def test_bins_equal_naive_join(spark, seed):
    rnd = random.Random(seed)
    rows = lambda k: [(k + i, rnd.randint(1, 50_000), 0) for i in range(150)]
    q, t = ([(i, a, a + int(10 ** rnd.uniform(0, 5)), rnd.choice("+-"), "x") for i, a, _ in rows(k)] for k in (0, 1000))
    got = {(r.t_id, r.q_id, r.intersect) for r in intervals.overlap_join(iv(spark, q), iv(spark, t), bin_size=64, levels=3, factor=8).collect()}
    want = {(b[0], a[0], min(a[2], b[2]) - max(a[1], b[1]) + 1) for a in q for b in t if a[3] == b[3] and a[2] >= b[1] and a[1] <= b[2]}
    assert got == want


def test_islands_and_gaps(spark):
    df = iv(spark, [(1, 5, 10), (2, 10, 12), (3, 13, 20), (4, 30, 40, "-", "x"), (5, 6, 7)])
    islands = intervals.merge_islands(df, (), block=4)
    assert sorted((r.strand, r.start, r.end) for r in islands.collect()) == [("+", 5, 12), ("+", 13, 20), ("-", 30, 40)]
    chroms = spark.createDataFrame([(1, 50), (2, 7)], "chr int, len long")
    left = sorted((r.chr, r.strand, r.start, r.end) for r in intervals.gaps(islands, chroms).collect())
    assert left == [(1, "+", 1, 4), (1, "+", 21, 50), (1, "-", 1, 29), (1, "-", 41, 50), (2, "+", 1, 7), (2, "-", 1, 7)]


def test_random_segments_keep_lengths(spark):
    df = iv(spark, [(k, 100 * k, 100 * k + 13 * k, "+", "ab"[k % 2]) for k in range(1, 9)]).withColumn("class", F.col("type"))
    a = intervals.random_segments(df, 3).collect()
    assert sorted(r.end - r.start + 1 for r in a) == sorted(13 * k + 1 for k in range(1, 9))
    rows = sorted(a, key=lambda r: r.start)
    assert all(x.end < y.start for x, y in zip(rows, rows[1:])) and max(r.end for r in a) == 800 + 13 * 8


def test_empty_tables(spark):
    none = iv(spark, [])
    one = iv(spark, [(1, 5, 10)])
    assert intervals.annotate(none, one).count() == 0 and intervals.annotate(one, none, add_na=True).count() == 0
    assert intervals.merge_islands(none).count() == 0 and intervals.class_overlap(none, one).count() == 0


def test_coordinates(spark):
    chroms = spark.createDataFrame([(1, 100), (2, 50)], "chr int, len long")
    df = spark.createDataFrame([(1, 1, 10, 20, "+"), (2, 2, 5, 9, "-"), (3, 2, 40, 8, "+")], "id long, chr int, start long, end long, strand string")
    x = genome.to_index(df, chroms)
    assert {r.id: (r.idx_start, r.idx_end) for r in x.collect()} == {1: (10, 20), 2: (255, 259), 3: (108, 140)}
    back = genome.from_index(x.drop("start", "end"), chroms)
    assert {r.id: (r.chr, r.strand, r.start, r.end) for r in back.collect()} == {1: (1, "+", 10, 20), 2: (2, "-", 5, 9), 3: (2, "+", 8, 40)}
    wide = genome.expand_circular(df, chroms)
    assert sorted((r.id, r.start, r.end, r.parent) for r in wide.collect()) == [("1", 10, 20, None), ("2", 5, 9, None), ("3", 40, 50, None), ("3-circ2", 1, 8, "3")]
    assert {r.id: (r.start, r.end) for r in genome.join_circular(wide).collect()}["3"] == (40, 8)
    assert {r.id: (r.start, r.end) for r in genome.flank(df, -3).collect()} == {1: (7, 9), 2: (10, 12), 3: (5, 7)}


def test_hypergeometric(spark):
    row = spark.range(1).select(stats.hypergeometric(F.lit(5).cast("long"), F.lit(5).cast("long"), F.lit(5).cast("long"), F.lit(10).cast("long")).alias("a"), stats.hypergeometric(F.lit(0).cast("long"), F.lit(5).cast("long"), F.lit(5).cast("long"), F.lit(10).cast("long"), upper=False).alias("b")).first()
    assert math.isclose(row.a, 1 / 252, rel_tol=1e-10) and math.isclose(row.b, 1 / 252, rel_tol=1e-10)


def test_student():
    assert math.isclose(stats.incomplete_beta(np.array([2.5]), np.array([0.5]), np.array([5 / (5 + 2.570581835636314**2)]))[0], 0.05, rel_tol=1e-9)
    assert math.isclose(stats._t_quantile_975(__import__("pandas").Series([5.0]))[0], 2.570581835636314, rel_tol=1e-6)


def test_phase_of_known_cosines(spark):
    rows = [(p, t, math.cos(2 * math.pi * (t - p) / 24)) for p in range(1, 24) for t in range(24)]
    got = series.phases(series.dft(spark.createDataFrame(rows, "id long, t long, y double"))).where("k = 1").collect()
    assert all(abs(r.phase - 15 * r.id) < 1e-6 for r in got) and len(got) == 23


def test_degrees_range(spark):
    r = spark.range(1).select(scalar.degrees_of(F.lit(-1.0), F.lit(0.0)).alias("a"), scalar.degrees_of(F.lit(1.0), F.lit(0.0)).alias("b")).first()
    assert r.a == 180 and r.b in (0, 360)


def test_sequence(spark):
    r = spark.range(1).select(sequence.revcomp(F.lit("acgux")).alias("a"), sequence.mutate(F.lit("ACGT"), F.array(F.lit("A1T"), F.lit("G3C"))).alias("b"), scalar.short_number(F.lit(1321.0)).alias("c")).first()
    assert (r.a, r.b, r.c) == ("NACGT", "TCCT", "1.3k")
    with pytest.raises(Exception, match="no such letter"):
        spark.range(1).select(sequence.mutate(F.lit("ACGT"), F.array(F.lit("C1T")))).collect()


def test_files_round_trip(spark, tmp_path):
    df = iv(spark, [(1, 5, 10), (2, 30, 20, "-", "CDS")])
    writers.write_bed(df, f"{tmp_path}/bed")
    bed = readers.read_bed(spark, f"{tmp_path}/bed", ("chr", "start", "end", "name", "score", "strand"))
    assert sorted((r.chr, r.start, r.end, r.strand) for r in bed.collect()) == [(1, 5, 10, 1), (1, 20, 30, -1)]
    writers.write_gff(df, f"{tmp_path}/gff", ["id", "type"])
    gff = readers.gff_table(readers.read_gff(spark, f"{tmp_path}/gff"))
    assert sorted((r.start, r.end, r.frame, r.id, r.type) for r in gff.collect()) == [(5, 10, ".", "1", "x"), (30, 20, "0", "2", "CDS")]


def test_fasta_soft_obo(spark, tmp_path):
    (tmp_path / "a.fa").write_text(";c\n>s1, first\nAC/G\nT\n>s2\nGG\n;x\nC\n")
    assert [(r.id, r.seq) for r in readers.read_fasta(spark, f"{tmp_path}/a.fa").orderBy("id").collect()] == [("s1", "ACGT"), ("s2", "GGC")]
    (tmp_path / "a.soft").write_text("^PLATFORM = P\n!platform_table_begin\nID\tORF\np1\tg1\np2\tg1\n!platform_table_end\n^SAMPLE = S1\n!Sample_title = one\n!sample_table_begin\nID_REF\tVALUE\np1\t2\np2\t4\np9\t1\n!sample_table_end\n")
    platform, samples, values = readers.read_soft(spark, f"{tmp_path}/a.soft")
    assert [tuple(r) for r in samples.collect()] == [("S1", "one")] and values.count() == 2
    assert [tuple(r) for r in readers.summarize_probes(values, platform, "ORF").collect()] == [("S1", "g1", 3.0)]
    (tmp_path / "a.obo").write_text("format-version: 1.2\n\n[Term]\nid: G:1\nname: root\n\n[Term]\nid: G:2\nname: mid\nis_a: G:1 ! root\n\n[Term]\nid: G:3\nname: obsolete leaf\nis_a: G:2 ! mid\n")
    terms, parents = readers.read_obo(spark, f"{tmp_path}/a.obo")
    assert {r.id: r.obsolete for r in terms.collect()} == {"G:1": False, "G:2": False, "G:3": True}
    closure = readers.ancestors(parents)
    assert sorted(map(tuple, closure.collect())) == [("G:2", "G:1"), ("G:3", "G:1"), ("G:3", "G:2")]
    ann = spark.createDataFrame([("a", "G:1"), ("a", "G:3"), ("b", "G:2")], "id string, term string")
    assert sorted(map(tuple, readers.minimal_terms(ann, closure).collect())) == [("a", "G:3"), ("b", "G:2")]


def test_chromosome_file_and_statistics(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("one\tx\t100\ntwo\ty\t50\n")
    assert [tuple(r) for r in readers.read_chromosomes(spark, f"{tmp_path}/c.tsv").orderBy("chr").collect()] == [(1, "one", 100), (2, "two", 50)]
    (tmp_path / "j.tsv").write_text("query\ttarget\tintersect\tunion\tjaccard\tcount\trandom\tpermutations\na\tb\t1\t2\t0.5\t1\t3\t10\na\t\t5\t5\t1\t1\t0\t10\n")
    cells, margins = readers.read_jaccard(spark, f"{tmp_path}/j.tsv")
    assert cells.first().p_value == 0.3 and margins.count() == 1


def test_stream(spark, tmp_path):
    iv(spark, [(10, 100, 199), (11, 50, 149)]).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(IV).parquet(f"{tmp_path}/in")
    query = annotate_stream(stream, iv(spark, [(1, 100, 199)])).writeStream.format("memory").queryName("hits").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert sorted((r.target, r.query, r.intersect) for r in spark.table("hits").collect()) == [(1, 10, 100), (1, 11, 50)]


def test_entry_without_corpus_folders():
    import __spark_entry__ as entry

    assert {"overlap_pairs", "dft"} <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_loess_inverts_a_column_effect(spark):
    rows = [(i, c, (i / 50.0) * (1 + 0.5 * c) + 0.1 * c) for i in range(300) for c in range(3)]
    got = series.loess_normalised(spark.createDataFrame(rows, "id long, column int, value double")).collect()
    middle = {r.id: r.value for r in got if r.column == 1}
    assert np.median([abs(r.normalised - middle[r.id]) for r in got]) < 0.05


def test_density_grid_sums_to_one(spark):
    rows = [(float(i % 37), float(i % 11)) for i in range(500)]
    got = series.density_grid(spark.createDataFrame(rows, "x double, y double"), "x", "y", 32, circular=True).collect()
    assert len(got) == 1024 and abs(sum(r.density for r in got) - 1) < 1e-9 and max(r.level for r in got) == 255


def test_medoids_split_two_heaps(spark):
    rows = [(i, float(i % 2) * 10 + i * 0.01) for i in range(40)]
    got = {r.id: r.cluster for r in series.medoids(spark.createDataFrame(rows, "id long, v double"), 2, ["v"]).collect()}
    assert len({got[i] for i in range(0, 40, 2)}) == 1 and got[0] != got[1]


def test_overlap_join_compares_in_proportion_to_what_overlaps(spark):
    """Short intervals in a small range, and fine ones beside a coarse one, don't meet in bins that hold them all."""
    points = spark.range(3000).select(F.lit(1).alias("chr"), F.lit("+").alias("strand"), F.col("id"), (F.col("id") + 1).alias("start"), (F.col("id") + 1).alias("end"))
    segments = points.select("chr", "strand", "id", "start", (F.col("start") + F.col("id") % 8).alias("end"))
    long_ = spark.createDataFrame([(1, "+", -1, 1, 100_000)], points.schema)
    for q, t in ((points, segments), (segments, points), (points.unionAll(long_), segments.unionAll(long_))):
        left, right = q.select("chr", "strand", *[F.col(c).alias(f"q_{c}") for c in ("id", "start", "end")]), t.select("chr", "strand", *[F.col(c).alias(f"t_{c}") for c in ("id", "start", "end")])
        qlevels, tlevels = intervals._levels((left, "q"), (right, "t"))
        met = intervals._met(left, "q", tlevels, True).join(intervals._met(right, "t", qlevels, False), ["chr", "strand", "level", "bin"])
        pairs = {(r.q_id, r.t_id) for r in intervals.overlap_join(q, t).collect()}
        a, b = ([(r.id, r.start, r.end) for r in x.collect()] for x in (q, t))
        assert pairs == {(i, j) for i, s, e in a for j, u, v in b if e >= u and s <= v}
        assert met.count() < 8 * len(pairs)


def shapes(n, seed, span, lengths):
    r = random.Random(seed)
    out = []
    for i in range(n):
        a, long_ = r.randrange(-span // 10, span), r.randrange(r.choice(lengths))
        out.append((i, r.choice([1, 2]), a, a + long_, r.choice("+-"), r.choice("xy")))
    return out


@pytest.mark.parametrize("span,lengths", [(3000, (1, 50, 400)), (10**6, (1, 10, 200_000)), (40, (1, 3))])
def test_hits_are_not_shuffled(spark, span, lengths):
    """All hits, best ones and counts as every pair compared gives them; the only exchange is that of the rows."""
    a, b = shapes(250, 1, span, lengths), shapes(300, 2, span, lengths)
    q, t = spark.createDataFrame(a, IV), spark.createDataFrame(b, IV)
    both = lambda x, y: min(x[3], y[3]) - max(x[2], y[2]) + 1
    j = {(y[0], x[0]): both(x, y) / (max(x[3], y[3]) - min(x[2], y[2]) + 1) for x in a for y in b if x[1] == y[1] and x[4] == y[4] and both(x, y) > 0}
    of = {}
    for (y, x), v in j.items():
        of.setdefault(y, {})[x] = v
    hits = intervals.annotate(q, t)
    assert {(r.target, r.query): r.qrank for r in hits.collect()} == {(y, x): 1 + sum(w > v for w in of[y].values()) for (y, x), v in j.items()}
    best = intervals.best_hits(q, t, qcols=("type",))
    kind = {x[0]: x[5] for x in a}
    assert {(r.target, r.query, r.q_type, r.hits) for r in best.collect()} == {(y, x, kind[x], len(of[y])) for (y, x), v in j.items() if v == max(of[y].values())}
    each = {y[0]: y[5] for y in b}
    counts = {}
    for y, x in j:
        counts[kind[x], each[y]] = counts.get((kind[x], each[y]), 0) + 1
    assert {(r["query"], r.target): r["count"] for r in intervals.overlap_counts(q, t).collect()} == counts
    for df in (hits, best):
        plan = df._jdf.queryExecution().sparkPlan().toString()
        assert "Window" not in plan and "Join" not in plan


def test_a_target_id_twice_is_ranked_as_one(spark):
    q = spark.createDataFrame([(1, 1, 10, 20, "+", "x"), (2, 1, 50_000, 50_010, "+", "x")], IV)
    t = spark.createDataFrame([(7, 1, 10, 20, "+", "x"), (7, 1, 50_000, 50_099, "+", "x")], IV)
    assert {(r.target, r.query, r.qrank) for r in intervals.annotate(q, t).collect()} == {(7, 1, 1), (7, 2, 2)}


def test_timing_rows_over_blocks(spark):
    """Types and lengths hold until the next one, over blocks without any."""
    log, want, now = [], [], [None, None]
    for i in range(200):
        label, value = ("SEGMENT TYPE", f"k{i}") if i % 61 == 5 else ("Timeseries N", str(i)) if i % 47 == 9 else ("elapsed, sec", f"{i}.5") if i % 3 == 0 else ("other", "x")
        now = [value if label == "SEGMENT TYPE" else now[0], int(value) if label == "Timeseries N" else now[1]]
        log.append((i, label, value))
        if label == "elapsed, sec":
            want.append((i, *now, i + 0.5))
    got = stats.timing_rows(spark.createDataFrame(log, "seq long, label string, value string").repartition(7), block=4).collect()
    assert sorted(map(tuple, got)) == want
