"""Registered queries of the interval, profile and sequence operators, each beside the SQL that it is held against.

Doubles are rounded alike on both sides: value hashes are compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions import scalar, sequence
from loomspan.operators import genome, intervals, series, stats
from loomspan.plans.fixtures import TABLES, fixture, with_fixtures
from loomspan.sources import readers, writers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None, *fixtures: str):
    def add(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = with_fixtures(sql, *fixtures) if fixtures else sql.format(**{t: t for t in TABLES}) if "{" in sql else sql
        return f

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def seg(spark: SparkSession, d: str) -> DataFrame:
    return fixture(spark, d, "fx_seg")


def split_seg(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Queries (click, view) and targets (purchase)."""
    s = seg(spark, d)
    return s.where(F.col("type").isin("click", "view")), s.where("type = 'purchase'")


GENOME = ("fx_genome",)
SEGS = """, q AS (SELECT * FROM fx_seg WHERE type IN ('click', 'view')), t AS (SELECT * FROM fx_seg WHERE type = 'purchase'),
pairs AS (
  SELECT t.id AS target, q.id AS query, least(q.end_, t.end_) - greatest(q.start, t.start) + 1 AS intersect,
         greatest(q.end_, t.end_) - least(q.start, t.start) + 1 AS "union", q.end_ - q.start + 1 AS qlen, t.end_ - t.start + 1 AS tlen,
         CASE WHEN q.start <= t.start AND q.end_ >= t.end_ THEN 'covers' WHEN q.start >= t.start AND q.end_ <= t.end_ THEN 'inside'
              WHEN q.start < t.start AND q.end_ < t.end_ THEN 'left' ELSE 'right' END AS qpos
  FROM q JOIN t ON q.chr = t.chr AND q.strand {sense} t.strand AND q.end_ >= t.start AND q.start <= t.end_),
hits AS (SELECT *, rank() OVER (PARTITION BY target ORDER BY intersect / "union" DESC) AS qrank FROM pairs)
"""
PAIRS, ANTI = SEGS.replace("{sense}", "="), SEGS.replace("{sense}", "<>")
HIT = 'target, query, intersect, "union", qlen, tlen, qrank, qpos'
CHROMS = ", gi AS (SELECT chr, len, sum(len) OVER (ORDER BY chr) - len AS off, sum(len) OVER () AS total FROM fx_genome)"
ISLANDS = """, marked AS (SELECT *, CASE WHEN start <= max(end_) OVER (PARTITION BY type, chr, strand ORDER BY start, end_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM fx_seg),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY type, chr, strand ORDER BY start, end_ ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM marked),
islands AS (SELECT type, chr, strand, min(start) AS start, max(end_) AS end_ FROM numbered GROUP BY type, chr, strand, run)
"""


# ---------------------------------------------------------------- joins


@register("overlap_pairs", PAIRS + f"SELECT {HIT} FROM hits", "fx_seg")
def _(spark, d):
    return intervals.annotate(*split_seg(spark, d))


@register("overlap_best", PAIRS + f"SELECT {HIT} FROM hits WHERE qrank = 1", "fx_seg")
def _(spark, d):
    return intervals.best_hits(*split_seg(spark, d)).drop("hits")


@register("overlap_left", PAIRS + 'SELECT t.id AS target, query, coalesce(intersect, 0) AS intersect, coalesce("union", 0) AS "union", coalesce(qlen, 0) AS qlen, coalesce(hits.tlen, 0) AS tlen, coalesce(qrank, 1) AS qrank, qpos FROM t LEFT JOIN hits ON t.id = hits.target', "fx_seg")
def _(spark, d):
    return intervals.annotate(*split_seg(spark, d), add_na=True)


@register("overlap_untied", PAIRS + """, f AS (SELECT *, sum(CASE WHEN qrank = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY target) AS firsts, row_number() OVER (PARTITION BY target ORDER BY intersect / "union" DESC, query) AS n FROM hits)
SELECT target, query, CASE WHEN firsts > 1 THEN n ELSE qrank END AS qrank FROM f""", "fx_seg")
def _(spark, d):
    return intervals.annotate(*split_seg(spark, d), untie=True).select("target", "query", "qrank")


@register("overlap_antisense", ANTI + f"SELECT {HIT} FROM hits", "fx_seg")
def _(spark, d):
    return intervals.antisense(*split_seg(spark, d))


@register("overlap_target_view", PAIRS + "SELECT target, query, CASE qpos WHEN 'covers' THEN 'inside' WHEN 'inside' THEN 'covers' WHEN 'left' THEN 'right' ELSE 'left' END AS relation FROM hits", "fx_seg")
def _(spark, d):
    return intervals.annotate(*split_seg(spark, d), rank=False).select("target", "query", intervals.target_view(F.col("qpos")).alias("relation"))


@register("annotate_collapsed", PAIRS + """, best AS (SELECT t.id AS target, h.query, coalesce(h.qrank, 1) AS qrank, h.qpos, coalesce(h.qlen, 0) AS qlen, coalesce(h.intersect, 0) AS intersect, coalesce(h."union", 0) AS "union", q.type AS type
  FROM t LEFT JOIN (SELECT * FROM hits WHERE qrank = 1) AS h ON h.target = t.id LEFT JOIN q ON q.id = h.query),
low AS (SELECT target, CASE WHEN intersect / nullif("union", 0) < 0.2 THEN NULL ELSE 1 END AS ok, * EXCLUDE (target) FROM best)
SELECT target, string_agg(coalesce(CAST(CASE WHEN ok = 1 THEN query END AS VARCHAR), 'NA'), ';' ORDER BY query) AS query, string_agg(coalesce(CASE WHEN ok = 1 THEN type END, 'NA'), ';' ORDER BY query) AS type,
  string_agg(coalesce(CASE WHEN ok = 1 THEN qpos END, 'NA'), ';' ORDER BY query) AS qpos, string_agg(coalesce(CAST(CASE WHEN ok = 1 THEN qrank END AS VARCHAR), 'NA'), ';' ORDER BY query) AS qrank,
  string_agg(coalesce(CAST(CASE WHEN ok = 1 THEN qlen END AS VARCHAR), 'NA'), ';' ORDER BY query) AS qlen, string_agg(coalesce(CAST(CASE WHEN ok = 1 THEN intersect END AS VARCHAR), 'NA'), ';' ORDER BY query) AS intersect,
  string_agg(coalesce(CAST(CASE WHEN ok = 1 THEN "union" END AS VARCHAR), 'NA'), ';' ORDER BY query) AS "union" FROM low GROUP BY target""", "fx_seg")
def _(spark, d):
    return intervals.annotate_target(*split_seg(spark, d), ["type"], min_jaccard=0.2)


@register("flank_overlap", """, t AS (SELECT id, chr, strand, CASE WHEN strand = '-' THEN end_ + 1 ELSE start - 500 END AS start, CASE WHEN strand = '-' THEN end_ + 500 ELSE start - 1 END AS end_ FROM fx_seg WHERE type = 'purchase'), q AS (SELECT * FROM fx_seg WHERE type IN ('click', 'view'))
SELECT t.id AS target, q.id AS query, least(q.end_, t.end_) - greatest(q.start, t.start) + 1 AS intersect FROM q JOIN t ON q.chr = t.chr AND q.strand = t.strand AND q.end_ >= t.start AND q.start <= t.end_""", "fx_seg")
def _(spark, d):
    q, t = split_seg(spark, d)
    return intervals.annotate(q, genome.flank(t, -500), rank=False).select("target", "query", "intersect")


@register("pair_counts", PAIRS + "SELECT q.type AS q_type, t.type AS t_type, count(*) AS count FROM hits JOIN q ON q.id = hits.query JOIN t ON t.id = hits.target GROUP BY 1, 2", "fx_seg")
def _(spark, d):
    return intervals.pair_counts(intervals.overlap_join(*split_seg(spark, d)), "q_type", "t_type")


@register("points_in_segments", """, p AS (SELECT event_id AS id, chr, coor FROM (SELECT event_id, CAST(user_id % 4 + 1 AS INT) AS chr, (event_id * 104729) % 2592000 + 1 AS coor FROM events))
SELECT p.id AS id, s.id AS segment FROM p JOIN fx_seg s ON s.chr = p.chr AND s.start <= p.coor AND s.end_ >= p.coor AND s.type = 'purchase'""", "fx_seg")
def _(spark, d):
    p = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("id"), (F.col("user_id") % 4 + 1).cast("int").alias("chr"), ((F.col("event_id") * 104729) % 2592000 + 1).alias("coor"))
    return intervals.points_in(p, seg(spark, d).where("type = 'purchase'").drop("strand")).select(F.col("q_id").alias("id"), F.col("t_id").alias("segment"))


@register("aligned_profile", """, sites AS (SELECT event_id AS id, CAST(user_id % 4 + 1 AS INT) AS chr, (event_id * 31) % 4320 + 1 AS coor, CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END AS s FROM events WHERE event_type = 'purchase'),
data AS (SELECT chr, coor, sum(reads) AS v FROM fx_signal GROUP BY chr, coor), rel AS (SELECT unnest(range(-10, 11)) AS rel)
SELECT rel.rel, count(data.v) AS n, CAST(sum(coalesce(data.v, 0)) AS BIGINT) AS total FROM sites CROSS JOIN rel LEFT JOIN data ON data.chr = sites.chr AND data.coor = sites.coor + sites.s * rel.rel GROUP BY rel.rel""", "fx_signal")
def _(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").where("event_type = 'purchase'")
    sites = e.select(F.col("event_id").alias("id"), (F.col("user_id") % 4 + 1).cast("int").alias("chr"), ((F.col("event_id") * 31) % 4320 + 1).alias("coor"), F.when(F.col("event_id") % 2 == 0, "+").otherwise("-").alias("strand"))
    data = fixture(spark, d, "fx_signal").groupBy("chr", "coor").agg(F.sum("reads").alias("v"))
    return intervals.align(sites, data, 10).groupBy("rel").agg(F.count("value").alias("n"), F.sum(F.coalesce("value", F.lit(0))).alias("total"))


# ---------------------------------------------------------------- interval sets


@register("merge_islands", ISLANDS + "SELECT type, chr, strand, start, end_ AS \"end\" FROM islands", "fx_seg")
def _(spark, d):
    return intervals.merge_islands(seg(spark, d))


@register("gaps", """, m AS (SELECT chr, strand, start, end_ FROM fx_seg UNION ALL SELECT chr, s, 0, 0 FROM fx_genome, (VALUES ('+'), ('-')) AS x(s) UNION ALL SELECT chr, s, len + 1, len + 1 FROM fx_genome, (VALUES ('+'), ('-')) AS x(s)),
w AS (SELECT chr, strand, max(end_) OVER (PARTITION BY chr, strand ORDER BY start, end_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 AS a, start - 1 AS b FROM m)
SELECT chr, strand, a AS start, least(b, 2592000) AS "end" FROM w WHERE a <= b AND a <= 2592000""", "fx_seg", "fx_genome")
def _(spark, d):
    islands = intervals.merge_islands(seg(spark, d), ())
    return intervals.gaps(islands, fixture(spark, d, "fx_genome"))


JACCARD = ISLANDS + """, size AS (SELECT type, sum(end_ - start + 1) AS bp FROM islands GROUP BY type),
common AS (SELECT a.type AS query, b.type AS target, sum(least(a.end_, b.end_) - greatest(a.start, b.start) + 1) AS i FROM islands a JOIN islands b ON a.chr = b.chr AND a.strand = b.strand AND a.end_ >= b.start AND a.start <= b.end_ GROUP BY 1, 2),
cells AS (SELECT a.type AS query, b.type AS target, CAST(coalesce(i, 0) AS BIGINT) AS intersect, CAST(a.bp + b.bp - coalesce(i, 0) AS BIGINT) AS "union", CAST(a.bp AS BIGINT) AS query_bp, CAST(b.bp AS BIGINT) AS target_bp FROM size a CROSS JOIN size b LEFT JOIN common ON common.query = a.type AND common.target = b.type)
"""


@register("class_jaccard", JACCARD + 'SELECT *, round(intersect / "union", 9) AS jaccard FROM cells', "fx_seg")
def _(spark, d):
    return rounded(intervals.class_overlap(seg(spark, d), seg(spark, d)), "jaccard", digits=9)


@register("class_jaccard_symmetric", JACCARD + 'SELECT least(query, target) AS query, greatest(query, target) AS target, CAST(sum(intersect) AS BIGINT) AS intersect, CAST(sum("union") AS BIGINT) AS "union", round(sum(intersect) / sum("union"), 9) AS jaccard FROM cells GROUP BY 1, 2', "fx_seg")
def _(spark, d):
    return rounded(intervals.class_overlap(seg(spark, d), seg(spark, d), symmetric=True), "jaccard", digits=9).select("query", "target", "intersect", "union", "jaccard")


def lay_sql(reps: str) -> str:
    return f"""
, cut AS (SELECT type, chr, strand, greatest(start, coalesce(max(end_) OVER (PARTITION BY chr, strand ORDER BY start, end_, type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1, start)) AS start, end_ FROM islands),
flat AS (SELECT cut.*, rep FROM cut CROSS JOIN (SELECT CAST(unnest({reps}) AS INT) AS rep) AS r WHERE start <= end_),
base AS (SELECT *, row_number() OVER w AS n, start - coalesce(lag(end_) OVER w, 0) - 1 AS gap FROM flat WINDOW w AS (PARTITION BY chr, strand, rep ORDER BY start)),
lk AS (SELECT chr, strand, rep, end_ - start + 1 AS length, type, row_number() OVER (PARTITION BY chr, strand, rep ORDER BY md5(concat_ws(':', 1, rep, 'length', chr, strand, n)), n) AS k FROM base),
gk AS (SELECT chr, strand, rep, gap, row_number() OVER (PARTITION BY chr, strand, rep ORDER BY md5(concat_ws(':', 1, rep, 'gap', chr, strand, n)), n) AS k FROM base),
laid AS (SELECT lk.*, CAST(sum(gap + length) OVER (PARTITION BY lk.chr, lk.strand, lk.rep ORDER BY lk.k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS end_ FROM lk JOIN gk ON lk.chr = gk.chr AND lk.strand = gk.strand AND lk.rep = gk.rep AND lk.k = gk.k)
"""


@register("random_segments", ISLANDS + lay_sql("[0]") + 'SELECT chr, strand, rep, k, end_ - length + 1 AS start, end_ AS "end", type AS class FROM laid', "fx_seg")
def _(spark, d):
    islands = intervals.merge_islands(seg(spark, d)).withColumnRenamed("type", "class")
    return intervals.random_segments(islands)


@register("permutation_p", JACCARD + lay_sql("range(1, 6)") + """, ri AS (SELECT l.rep, l.type AS query, b.type AS target, sum(least(l.end_, b.end_) - greatest(l.end_ - l.length + 1, b.start) + 1) AS i FROM laid l JOIN islands b ON l.chr = b.chr AND l.strand = b.strand AND l.end_ >= b.start AND l.end_ - l.length + 1 <= b.end_ GROUP BY 1, 2, 3),
rq AS (SELECT rep, type AS query, sum(length) AS bp FROM laid GROUP BY 1, 2)
SELECT c.query, c.target, round(avg(CASE WHEN coalesce(ri.i, 0) / (rq.bp + c.target_bp - coalesce(ri.i, 0)) >= c.intersect / c."union" THEN 1.0 ELSE 0.0 END), 6) AS p_value
FROM cells c CROSS JOIN (SELECT CAST(unnest(range(1, 6)) AS INT) AS rep) AS r JOIN rq ON rq.rep = r.rep AND rq.query = c.query LEFT JOIN ri ON ri.rep = r.rep AND ri.query = c.query AND ri.target = c.target GROUP BY 1, 2""", "fx_seg")
def _(spark, d):
    s = seg(spark, d)
    return rounded(intervals.permutation_p(s, s, 5), "p_value").select("query", "target", "p_value")


@register("permutation_p_100")
def _(spark, d):
    s = seg(spark, d)
    return rounded(intervals.permutation_p(s, s, 100), "p_value").select("query", "target", "p_value")


@register("position_runs", """, p AS (SELECT DISTINCT chr, coor FROM fx_signal), m AS (SELECT chr, coor, CASE WHEN coor - lag(coor) OVER (PARTITION BY chr ORDER BY coor) <= 1 THEN 0 ELSE 1 END AS new FROM p),
r AS (SELECT chr, coor, sum(new) OVER (PARTITION BY chr ORDER BY coor ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM m)
SELECT chr, min(coor) AS start, max(coor) AS "end", count(*) AS n FROM r GROUP BY chr, run""", "fx_signal")
def _(spark, d):
    return intervals.position_runs(fixture(spark, d, "fx_signal").select("chr", "coor").distinct())


@register("set_operations", """, a AS (SELECT DISTINCT chr, coor FROM fx_signal WHERE t < 12), b AS (SELECT DISTINCT chr, coor FROM fx_signal WHERE t >= 12)
SELECT 'both' AS kind, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'first', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'either', count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)""", "fx_signal")
def _(spark, d):
    s = fixture(spark, d, "fx_signal")
    a, b = s.where("t < 12").select("chr", "coor").distinct(), s.where("t >= 12").select("chr", "coor").distinct()
    parts = (("both", a.intersect(b)), ("first", a.subtract(b)), ("either", a.union(b).distinct()))
    rows = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n") for k, df in parts]
    return rows[0].unionAll(rows[1]).unionAll(rows[2])


# ---------------------------------------------------------------- coordinates


@register("chromosome_index", CHROMS + 'SELECT chr, len, CAST(off AS BIGINT) AS "offset", CAST(total AS BIGINT) AS total FROM gi', "fx_genome")
def _(spark, d):
    return genome.chrom_index(fixture(spark, d, "fx_genome"))


@register("to_index", CHROMS + "SELECT id, CAST(start + off + CASE WHEN strand = '-' THEN total ELSE 0 END AS BIGINT) AS idx_start, CAST(end_ + off + CASE WHEN strand = '-' THEN total ELSE 0 END AS BIGINT) AS idx_end FROM fx_seg JOIN gi USING (chr)", "fx_seg", "fx_genome")
def _(spark, d):
    return genome.to_index(seg(spark, d), fixture(spark, d, "fx_genome")).select("id", "idx_start", "idx_end")


@register("index_roundtrip", 'SELECT id, chr, strand, start, end_ AS "end" FROM fx_seg', "fx_seg")
def _(spark, d):
    chroms = fixture(spark, d, "fx_genome")
    return genome.from_index(genome.to_index(seg(spark, d), chroms).drop("start", "end"), chroms).select("id", "chr", "strand", "start", "end")


@register("split_at_borders", CHROMS + """, x AS (SELECT id, start + off + CASE WHEN strand = '-' THEN total ELSE 0 END AS a, end_ + 200000 + off + CASE WHEN strand = '-' THEN total ELSE 0 END AS b FROM fx_seg JOIN gi USING (chr)),
g2 AS (SELECT chr, len, off, '+' AS strand FROM gi UNION ALL SELECT chr, len, off + total, '-' FROM gi),
p AS (SELECT id, g2.chr, g2.strand, greatest(a - off, 1) AS start, least(b - off, len) AS e, off FROM x JOIN g2 ON a <= off + len AND b > off)
SELECT CASE WHEN row_number() OVER w > 1 THEN concat(CAST(id AS VARCHAR), '_', CAST(row_number() OVER w AS VARCHAR)) ELSE CAST(id AS VARCHAR) END AS part_id, chr, strand, CAST(start AS BIGINT) AS start, CAST(e AS BIGINT) AS "end" FROM p WINDOW w AS (PARTITION BY id ORDER BY off)""", "fx_seg", "fx_genome")
def _(spark, d):
    chroms = fixture(spark, d, "fx_genome")
    x = genome.to_index(seg(spark, d), chroms).withColumn("idx_end", F.col("idx_end") + 200000)
    return genome.split_at_borders(x, chroms).select(genome.part_name().alias("part_id"), "chr", "strand", "start", "end")


@register("prune", """SELECT id, greatest(least(start, 2592000), 1) AS start, greatest(least(end_, 2592000), 1) AS "end" FROM fx_seg WHERE greatest(least(start, 2592000), 1) <> greatest(least(end_, 2592000), 1)""", "fx_seg")
def _(spark, d):
    return genome.prune(seg(spark, d), fixture(spark, d, "fx_genome"), remove_one_bp=True).select("id", "start", "end")


@register("flank", "SELECT id, CASE WHEN strand = '-' THEN start - 100 ELSE end_ + 1 END AS start, CASE WHEN strand = '-' THEN start - 1 ELSE end_ + 100 END AS \"end\" FROM fx_seg", "fx_seg")
def _(spark, d):
    return genome.flank(seg(spark, d), 100).select("id", "start", "end")


@register("sort_rank", "SELECT id, row_number() OVER (ORDER BY CASE WHEN strand = '-' THEN 1 ELSE 0 END, chr, least(start, end_), id) AS place FROM fx_seg", "fx_seg")
def _(spark, d):
    return genome.sort_rank(seg(spark, d), by_strand=True).select("id", "place")


@register("switch_strand", "SELECT id, CASE WHEN strand = '-' THEN '+' ELSE '-' END AS strand FROM fx_seg", "fx_seg")
def _(spark, d):
    return genome.switch_strand(seg(spark, d)).select("id", "strand")


CIRC = ", c AS (SELECT id, chr, strand, CASE WHEN id % 7 = 0 THEN end_ ELSE start END AS start, CASE WHEN id % 7 = 0 THEN start ELSE end_ END AS e FROM fx_seg)"


@register("expand_circular", CIRC + """SELECT CAST(id AS VARCHAR) AS id, CASE WHEN start > e AND strand = '-' THEN 1 ELSE start END AS start, CASE WHEN start > e AND strand <> '-' THEN 2592000 ELSE e END AS "end", CAST(NULL AS VARCHAR) AS parent FROM c
UNION ALL SELECT concat(CAST(id AS VARCHAR), '-circ2'), CASE WHEN strand = '-' THEN start ELSE 1 END, CASE WHEN strand = '-' THEN 2592000 ELSE e END, CAST(id AS VARCHAR) FROM c WHERE start > e""", "fx_seg")
def _(spark, d):
    s = seg(spark, d)
    turn = F.col("id") % 7 == 0
    s = s.select("id", "chr", "strand", F.when(turn, F.col("end")).otherwise(F.col("start")).alias("start"), F.when(turn, F.col("start")).otherwise(F.col("end")).alias("end"))
    return genome.expand_circular(s, fixture(spark, d, "fx_genome")).select("id", "start", "end", "parent")


@register("clean_circular", """, h AS (SELECT id, chr, CASE WHEN start > 2590000 THEN start + 5000 ELSE start END AS s, CASE WHEN start > 2590000 THEN end_ + 5000 ELSE end_ END AS e FROM fx_seg WHERE id % 3 > 0 UNION ALL SELECT id, chr, start - 40000, end_ FROM fx_seg WHERE id % 3 = 0),
k AS (SELECT id, chr, greatest(s, e) > 2592000 AS wrapped, CASE WHEN s > 2592000 THEN s - 2592000 WHEN s < 1 THEN s + 2592000 ELSE s END AS s, CASE WHEN e > 2592000 THEN e - 2592000 WHEN e < 1 THEN e + 2592000 ELSE e END AS e FROM h WHERE least(s, e) <= 2592000)
SELECT id, s AS start, e AS "end", wrapped FROM k WHERE NOT (NOT wrapped AND EXISTS (SELECT 1 FROM k AS w WHERE w.wrapped AND w.chr = k.chr AND w.e = k.e))""", "fx_seg")
def _(spark, d):
    s = seg(spark, d)
    far = F.col("start") > 2590000
    a = s.where("id % 3 > 0").select("id", "chr", F.when(far, F.col("start") + 5000).otherwise(F.col("start")).alias("start"), F.when(far, F.col("end") + 5000).otherwise(F.col("end")).alias("end"))
    b = s.where("id % 3 = 0").select("id", "chr", (F.col("start") - 40000).alias("start"), "end")
    return genome.clean_circular(a.unionAll(b), fixture(spark, d, "fx_genome")).select("id", "start", "end", "wrapped")


@register("codon_start", "SELECT id, CASE WHEN strand = '-' THEN start + 1 - 3 * (id % 50) ELSE start - 1 + 3 * (id % 50) END AS codon FROM fx_seg", "fx_seg")
def _(spark, d):
    return seg(spark, d).select("id", genome.codon_start(F.col("start"), F.col("id") % 50 + 1, F.col("strand")).alias("codon"))


@register("fuse_segments", """, o AS (SELECT *, row_number() OVER (PARTITION BY chr ORDER BY start, id) AS n, CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END AS fuse FROM fx_seg),
r AS (SELECT *, sum(CASE WHEN fuse = 1 AND n > 1 THEN 0 ELSE 1 END) OVER (PARTITION BY chr ORDER BY start, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM o)
SELECT chr, arg_min(id, n) AS id, arg_min(start, n) AS start, arg_max(end_, n) AS "end", count(*) AS n FROM r GROUP BY chr, run""", "fx_seg")
def _(spark, d):
    s = seg(spark, d).withColumn("fuse", F.when(F.col("id") % 3 == 0, 1).otherwise(0))
    return genome.fuse(s, ["chr"], ["start", "id"])


@register("tag_duplicates", "SELECT p_partkey AS id, CASE WHEN row_number() OVER w > 1 THEN concat(split_part(p_brand, '.', 1), '.', CAST(row_number() OVER w AS VARCHAR)) ELSE p_brand END AS tagged FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey)")
def _(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    return genome.tag_duplicates(p, "p_brand", "p_partkey").select(F.col("p_partkey").alias("id"), "tagged")


# ---------------------------------------------------------------- overlap statistics


@register("overlap_stats", PAIRS + """, b AS (SELECT *, intersect / "union" AS j FROM hits WHERE qrank = 1)
SELECT count(DISTINCT target) AS targets_hit, count(*) AS best_hits, round(sum(intersect) / sum("union"), 6) AS jaccard, CAST(sum(CASE WHEN intersect / tlen >= 0.8 AND intersect / qlen >= 0.8 THEN 1 ELSE 0 END) AS BIGINT) AS good_hits,
 round(avg(CASE WHEN qlen / tlen BETWEEN 0.8 AND 1.2 THEN 1.0 ELSE 0.0 END), 6) AS height, round(avg(CASE WHEN j >= 0.5 THEN 1.0 ELSE 0.0 END), 6) AS j_above, round(quantile_cont(j, 0.5), 6) AS j_cutoff,
 (SELECT count(*) FROM t) AS targets, round((SELECT avg(n) FROM (SELECT count(*) AS n FROM hits GROUP BY target)), 6) AS hits_per_target, round(sum(CASE WHEN j >= 0.5 THEN 1 ELSE 0 END) / (SELECT count(*) FROM t), 6) AS j_all FROM b""", "fx_seg")
def _(spark, d):
    q, t = split_seg(spark, d)
    return rounded(stats.overlap_stats(intervals.best_hits(q, t), t), "jaccard", "height", "j_above", "j_cutoff", "hits_per_target", "j_all")


@register("overlap_stats_by_type", PAIRS + """, per AS (SELECT q.type AS kind, h.target, h.query, h.intersect, h."union", rank() OVER (PARTITION BY q.type, h.target ORDER BY h.intersect / h."union" DESC) AS r FROM hits h JOIN q ON q.id = h.query)
SELECT kind AS "set", count(DISTINCT target) AS targets_hit, round(sum(intersect) / sum("union"), 6) AS jaccard FROM per WHERE r = 1 GROUP BY kind""", "fx_seg")
def _(spark, d):
    q, t = split_seg(spark, d)
    parts = {k: stats.overlap_stats(intervals.best_hits(q.where(F.col("type") == k), t), t) for k in ("click", "view")}
    return rounded(stats.collect_stats(parts), "jaccard").select("set", "targets_hit", "jaccard")


@register("ecdf_ratio", PAIRS + ", b AS (SELECT round(qlen / tlen, 6) AS x FROM hits WHERE qrank = 1), n AS (SELECT x, count(*) AS n FROM b GROUP BY x) SELECT x, round(sum(n) OVER (ORDER BY x) / sum(n) OVER (), 9) AS cdf FROM n", "fx_seg")
def _(spark, d):
    b = intervals.best_hits(*split_seg(spark, d)).select(F.round(F.col("qlen") / F.col("tlen"), 6).alias("x"))
    return rounded(stats.ecdf(b, "x"), "cdf", digits=9)


@register("ratio_histogram", PAIRS + "SELECT CAST(floor(qlen / tlen / 0.05) AS BIGINT) AS bin, count(*) AS count FROM hits WHERE qrank = 1 GROUP BY 1", "fx_seg")
def _(spark, d):
    return stats.ratio_histogram(intervals.best_hits(*split_seg(spark, d)))


@register("quadrants", PAIRS + 'SELECT intersect / "union" >= 0.5 AS similar, qlen >= tlen AS longer, count(*) AS count FROM hits WHERE qrank = 1 GROUP BY 1, 2', "fx_seg")
def _(spark, d):
    return stats.quadrants(intervals.best_hits(*split_seg(spark, d)))


@register("segment_lengths", "SELECT type, CAST(floor((end_ - start + 1) / 100) AS BIGINT) AS bin, count(*) AS count FROM fx_seg GROUP BY 1, 2", "fx_seg")
def _(spark, d):
    return stats.segment_lengths(seg(spark, d), ["type"])


@register("length_moments", "SELECT type, count(*) AS n, round(avg(end_ - start + 1), 6) AS mean, round(stddev_samp(end_ - start + 1), 6) AS sd, round(avg(end_ - start + 1) ** 2 / var_samp(end_ - start + 1), 6) AS gamma_shape FROM fx_seg GROUP BY type", "fx_seg")
def _(spark, d):
    return rounded(stats.length_moments(seg(spark, d), ["type"]), "mean", "sd", "gamma_shape")


@register("segment_reads", """, p AS (SELECT chr, coor, sum(reads) AS reads FROM fx_signal GROUP BY chr, coor), s AS (SELECT id, chr, start // 600 + 1 AS a, end_ // 600 + 1 AS b FROM fx_seg WHERE type = 'purchase')
SELECT s.id, CAST(sum(reads) AS BIGINT) AS total, count(*) AS n, round(avg(reads), 6) AS mean FROM s JOIN p ON p.chr = s.chr AND coor BETWEEN a AND b GROUP BY s.id""", "fx_seg", "fx_signal")
def _(spark, d):
    s = seg(spark, d).where("type = 'purchase'").select("id", "chr", (F.floor(F.col("start") / 600) + 1).alias("start"), (F.floor(F.col("end") / 600) + 1).alias("end"))
    p = fixture(spark, d, "fx_signal").groupBy("chr", "coor").agg(F.sum("reads").alias("reads"))
    got = stats.read_dist(intervals.segment_reads(s, p), ["t_id"], "q_reads")
    return rounded(got, "mean").select(F.col("t_id").alias("id"), "total", "n", "mean")


# ---------------------------------------------------------------- contingency

CELLS = """, k AS (SELECT query, target, count(*) AS n FROM fx_cls GROUP BY 1, 2), qs AS (SELECT query, sum(n) AS query_n FROM k GROUP BY 1), ts AS (SELECT target, sum(n) AS target_n FROM k GROUP BY 1),
cells AS (SELECT qs.query, ts.target, coalesce(k.n, 0) AS overlap, query_n, target_n, (SELECT sum(n) FROM k) AS total FROM qs CROSS JOIN ts LEFT JOIN k ON k.query = qs.query AND k.target = ts.target)
"""
CHOOSE = "(lgamma({n} + 1.0) - lgamma({k} + 1.0) - lgamma({n} - {k} + 1.0))"


def tail_sql(upper: bool = True) -> str:
    """The hypergeometric tail of columns overlap, query_n, target_n, total as a correlated sum."""
    lnp = CHOOSE.format(n="target_n", k="x") + " + " + CHOOSE.format(n="(total - target_n)", k="(query_n - x)") + " - " + CHOOSE.format(n="total", k="query_n")
    span = "range(CAST(greatest(overlap, query_n + target_n - total, 0) AS BIGINT), CAST(least(query_n, target_n) AS BIGINT) + 1)" if upper else "range(CAST(greatest(0, query_n + target_n - total) AS BIGINT), CAST(least(overlap, query_n, target_n) AS BIGINT) + 1)"
    return f"least(1.0, coalesce(list_sum(list_transform({span}, lambda x: exp({lnp}))), 0.0))"


@register("contingency_enrichment", CELLS + f"SELECT query, target, overlap, CAST(query_n AS BIGINT) AS query_n, CAST(target_n AS BIGINT) AS target_n, round(overlap / query_n, 6) AS frequency, round(overlap * total / (query_n * target_n), 6) AS ratio, round(overlap / (query_n + target_n - overlap), 6) AS jaccard, round({tail_sql()}, 6) AS p_value FROM cells", "fx_cls")
def _(spark, d):
    c = rounded(stats.contingency(fixture(spark, d, "fx_cls")), "frequency", "ratio", "jaccard", "p_value")
    return c.select("query", "target", "overlap", "query_n", "target_n", "frequency", "ratio", "jaccard", "p_value")


@register("contingency_two_sided", CELLS + f", p AS (SELECT query, target, {tail_sql()} AS more, {tail_sql(False)} AS less FROM cells) SELECT query, target, round(least(more, less), 6) AS p_value, CASE WHEN round(less, 9) < round(more, 9) THEN -1 ELSE 1 END AS sign FROM p", "fx_cls")
def _(spark, d):
    return rounded(stats.contingency(fixture(spark, d, "fx_cls"), alternative="two.sided"), "p_value").select("query", "target", "p_value", "sign")


TERMS = ", terms AS (SELECT DISTINCT id, unnest(string_split(terms, ';')) AS term FROM fx_cls), tm AS (SELECT * FROM terms WHERE term <> '')"
ENRICH = TERMS + f""", sz AS (SELECT query AS cluster, count(*) AS query_n FROM fx_cls GROUP BY 1), cell AS (SELECT query AS cluster, term, count(*) AS overlap FROM fx_cls JOIN tm USING (id) GROUP BY 1, 2), ot AS (SELECT term, count(*) AS target_n FROM tm GROUP BY 1),
e AS (SELECT cluster, term, overlap, query_n, target_n, (SELECT count(*) FROM fx_cls) AS total FROM cell JOIN sz USING (cluster) JOIN ot USING (term)), p AS (SELECT *, {tail_sql()} AS p FROM e)
"""


@register("term_enrichment", ENRICH + "SELECT cluster, term, overlap, round(overlap * total / (query_n * target_n), 6) AS enrichment, round(p, 6) AS p_value FROM p", "fx_cls")
def _(spark, d):
    c = fixture(spark, d, "fx_cls")
    got = stats.term_enrichment(c.select("id", F.col("query").alias("cluster")), stats.exploded_terms(c))
    return rounded(got, "enrichment", "p_value").select("cluster", "term", "overlap", "enrichment", "p_value")


@register("term_overlap", TERMS + "SELECT a.term, b.term AS other, count(*) AS overlap FROM tm a JOIN tm b USING (id) GROUP BY 1, 2", "fx_cls")
def _(spark, d):
    return stats.term_overlap(stats.exploded_terms(fixture(spark, d, "fx_cls")))


@register("sorted_enrichment", CELLS + f", pv AS (SELECT query, dense_rank() OVER (ORDER BY target) AS c, round({tail_sql()}, 9) AS p FROM cells), r AS (SELECT query, min(CASE WHEN p < 0.05 THEN c END) AS c, arg_min(p, c) FILTER (WHERE p < 0.05) AS fp, max(p) AS most FROM pv GROUP BY query) SELECT query, row_number() OVER (ORDER BY CASE WHEN c IS NULL THEN 1 ELSE 0 END, c, fp, most, query) AS place FROM r", "fx_cls")
def _(spark, d):
    return stats.sorted_overlaps(stats.contingency(fixture(spark, d, "fx_cls")), 0.05)


@register("transposed_contingency", CELLS + "SELECT target AS query, query AS target, overlap, CAST(target_n AS BIGINT) AS query_n, CAST(query_n AS BIGINT) AS target_n FROM cells", "fx_cls")
def _(spark, d):
    return stats.transposed(stats.contingency(fixture(spark, d, "fx_cls"))).select("query", "target", "overlap", "query_n", "target_n")


@register("cluster_flow", "SELECT cluster, region, count(*) AS count, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM fx_profile GROUP BY 1, 2", "fx_profile")
def _(spark, d):
    return rounded(stats.flow(fixture(spark, d, "fx_profile"), ["cluster", "region"]), "share", digits=9)


@register("class_table", ", s AS (SELECT DISTINCT segtype FROM fx_cls), p AS (SELECT segtype, unnest(string_split(segtype, '_')) AS piece FROM s), m AS (SELECT segtype, split_part(piece, ':', 1) AS key, split_part(piece, ':', 2) AS value FROM p) SELECT segtype, key, value FROM m WHERE key IN (SELECT key FROM m GROUP BY key HAVING count(DISTINCT value) > 1)", "fx_cls")
def _(spark, d):
    return sequence.class_table(fixture(spark, d, "fx_cls"))


@register("class_pieces", ", s AS (SELECT DISTINCT segtype FROM fx_cls), p AS (SELECT DISTINCT segtype, unnest(string_split(segtype, '_')) AS piece FROM s) SELECT piece FROM p GROUP BY piece HAVING count(*) < (SELECT count(*) FROM s)", "fx_cls")
def _(spark, d):
    return sequence.class_pieces(fixture(spark, d, "fx_cls"))


@register("annotation_list", TERMS + "SELECT id, term FROM tm", "fx_cls")
def _(spark, d):
    return readers.annotation_list(fixture(spark, d, "fx_cls"))


@register("annotation_pairs", "SELECT DISTINCT p_partkey AS id, p_brand AS key, p_type AS term FROM part WHERE p_brand IS NOT NULL AND p_brand <> ''")
def _(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet").withColumnRenamed("p_partkey", "id")
    return readers.annotation_pairs(p, "p_brand", "p_type")


# ---------------------------------------------------------------- averages and tests


@register("cluster_averages", "SELECT id % 6 AS cluster, t, round(median(y), 6) AS avg, round(quantile_cont(y, 0.05), 6) AS low, round(quantile_cont(y, 0.95), 6) AS high FROM fx_ts GROUP BY 1, 2", "fx_ts")
def _(spark, d):
    s = fixture(spark, d, "fx_ts").withColumn("cluster", F.col("id") % 6)
    return rounded(stats.cluster_averages(s, ["cluster", "t"]), "avg", "low", "high")


@register("cluster_means", "SELECT id % 6 AS cluster, t, round(avg(y), 6) AS avg, round(avg(y) - stddev_samp(y), 6) AS low, round(avg(y) + stddev_samp(y), 6) AS high FROM fx_ts GROUP BY 1, 2", "fx_ts")
def _(spark, d):
    s = fixture(spark, d, "fx_ts").withColumn("cluster", F.col("id") % 6)
    return rounded(stats.cluster_averages(s, ["cluster", "t"], q=0), "avg", "low", "high")


@register("read_dist", "SELECT chr, CAST(sum(reads) AS BIGINT) AS total, count(*) AS n, round(sum(reads) / count(*), 6) AS per_row, round(avg(reads), 6) AS mean, round(var_samp(reads), 6) AS variance, min(reads) AS least, max(reads) AS most, round(avg(CASE WHEN reads = 0 THEN 1.0 ELSE 0.0 END), 6) AS zero_share, 0.0::DOUBLE AS null_share FROM fx_signal GROUP BY chr", "fx_signal")
def _(spark, d):
    return rounded(stats.read_dist(fixture(spark, d, "fx_signal"), ["chr"], "reads"), "per_row", "mean", "variance", "zero_share")


@register("p_dist", ", p AS (SELECT chr, CASE WHEN reads >= 3 THEN 1.0 ELSE 1.0 / (coor % 50 + 1) END AS p FROM fx_signal) SELECT chr, round(avg(nullif(p, 1.0)), 6) AS mean_p, round(avg(CASE WHEN p < 0.05 THEN 1.0 ELSE 0.0 END), 6) AS significant, round(avg(CASE WHEN p = 1 THEN 1.0 ELSE 0.0 END), 6) AS missing FROM p GROUP BY chr", "fx_signal")
def _(spark, d):
    s = fixture(spark, d, "fx_signal").withColumn("p", F.when(F.col("reads") >= 3, 1.0).otherwise(1.0 / (F.col("coor") % 50 + 1)))
    return rounded(stats.p_dist(s, ["chr"], "p"), "mean_p", "significant", "missing")


@register("welch_profile", """, s AS (SELECT cluster, count(x) AS n, avg(x) AS m, var_samp(x) AS v FROM fx_profile GROUP BY 1), r AS (SELECT s.cluster, s.n, s.m, s.v, count(p.x) AS rn, avg(p.x) AS rm, var_samp(p.x) AS rv FROM s JOIN fx_profile p ON p.cluster <> s.cluster GROUP BY 1, 2, 3, 4)
SELECT cluster, n, round((m - rm) / sqrt(v / n + rv / rn), 6) AS statistic, round((v / n + rv / rn) ** 2 / ((v / n) ** 2 / (n - 1) + (rv / rn) ** 2 / (rn - 1)), 4) AS df, CASE WHEN m < rm THEN -1 ELSE 1 END AS sign FROM r""", "fx_profile")
def _(spark, d):
    return rounded(rounded(stats.welch_profile(fixture(spark, d, "fx_profile")), "statistic"), "df", digits=4)


@register("ranksum_profile", ", r AS (SELECT cluster, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rank FROM fx_profile), s AS (SELECT cluster, count(*) AS n, sum(rank) AS r FROM r GROUP BY 1) SELECT cluster, n, round((r - n * (n + 1) / 2) / (n * ((SELECT sum(n) FROM s) - n)) - 0.5, 6) AS statistic FROM s", "fx_profile")
def _(spark, d):
    return rounded(stats.ranksum_profile(fixture(spark, d, "fx_profile")), "statistic").select("cluster", "n", "statistic")


@register("welch_p_values")
def _(spark, d):
    return stats.with_t_p(stats.welch_profile(fixture(spark, d, "fx_profile")))


@register("ranksum_p_values")
def _(spark, d):
    return stats.with_ranksum_p(stats.ranksum_profile(fixture(spark, d, "fx_profile")))


@register("ci95")
def _(spark, d):
    return stats.ci95(fixture(spark, d, "fx_profile"), ["cluster"], "x")


@register("regression_by_class", "SELECT class, count(*) AS n, round(corr(x, y), 6) AS r, round(regr_slope(y, x), 4) AS slope, round(regr_intercept(y, x), 2) AS intercept, round((var_pop(y) - var_pop(x) + sqrt((var_pop(y) - var_pop(x)) ** 2 + 4 * covar_pop(x, y) ** 2)) / (2 * covar_pop(x, y)), 2) AS tls_slope FROM fx_xy GROUP BY class", "fx_xy")
def _(spark, d):
    got = stats.line(fixture(spark, d, "fx_xy"), ["class"])
    return rounded(rounded(rounded(got, "r"), "slope", digits=4), "intercept", "tls_slope", digits=2).select("class", "n", "r", "slope", "intercept", "tls_slope")


@register("regression_p_values")
def _(spark, d):
    return stats.with_line_p(stats.line(fixture(spark, d, "fx_profile").select("cluster", F.col("id").alias("x"), F.col("x").alias("y")), ["cluster"]))


# ---------------------------------------------------------------- series

DFT = """, n AS (SELECT id, count(*) AS n FROM fx_ts GROUP BY id), f AS (SELECT id, k, n, sum(y * cos(2 * pi() * k * t / n)) AS re, -sum(y * sin(2 * pi() * k * t / n)) AS im FROM fx_ts JOIN n USING (id) CROSS JOIN (SELECT unnest(range(0, 13)) AS k) AS kk GROUP BY id, k, n)
"""


@register("dft", DFT + "SELECT id, k, round(re, 4) AS re, round(im, 4) AS im FROM f", "fx_ts")
def _(spark, d):
    return rounded(series.dft(fixture(spark, d, "fx_ts")), "re", "im", digits=4).select("id", "k", F.expr("re + 0.0").alias("re"), F.expr("im + 0.0").alias("im"))


@register("phases", DFT + ", a AS (SELECT id, k, sqrt(re * re + im * im) AS amplitude, degrees(-atan2(im, re)) AS p FROM f WHERE k >= 1) SELECT id, k, round(amplitude, 4) AS amplitude, CASE WHEN amplitude > 1e-6 THEN round(CASE WHEN p <= 0 THEN p + 360 ELSE p END, 3) % 360 END AS phase FROM a", "fx_ts")
def _(spark, d):
    got = series.phases(series.dft(fixture(spark, d, "fx_ts")))
    # 0 and 360 are one angle, and nothing has no angle
    return got.select("id", "k", F.round("amplitude", 4).alias("amplitude"), F.when(F.col("amplitude") > 1e-6, F.round("phase", 3) % 360).alias("phase"))


@register("signal_to_noise", DFT + ", a AS (SELECT id, k, sqrt(re * re + im * im) AS a FROM f), s AS (SELECT id, sum(a) FILTER (WHERE k > 0) AS total, count(*) FILTER (WHERE k > 0) AS m, max(a) FILTER (WHERE k = 0) AS dc FROM a GROUP BY id) SELECT id, k, round(a / ((total - a) / (m - 1)), 4) AS snr, round(a / nullif(dc, 0), 4) AS scaled FROM a JOIN s USING (id) WHERE k >= 1", "fx_ts")
def _(spark, d):
    return rounded(series.signal_to_noise(series.dft(fixture(spark, d, "fx_ts"))), "snr", "scaled", digits=4).select("id", "k", "snr", "scaled")


@register("spectrum_peak", DFT + ", a AS (SELECT id, k, round(sqrt(re * re + im * im), 6) AS a FROM f WHERE k BETWEEN 1 AND 11), r AS (SELECT id, k, a, row_number() OVER (PARTITION BY id ORDER BY a DESC, k) AS n FROM a) SELECT id, round(a, 4) AS amplitude, k FROM r WHERE n = 1", "fx_ts")
def _(spark, d):
    return rounded(series.spectrum_peak(series.dft(fixture(spark, d, "fx_ts")), 1, 11), "amplitude", digits=4)


@register("phase_mean", DFT + ", p AS (SELECT id % 6 AS cluster, sqrt(re * re + im * im) AS w, -atan2(im, re) AS a FROM f WHERE k = 1), s AS (SELECT cluster, sum(w * cos(a)) AS x, sum(w * sin(a)) AS y, sum(w) AS w FROM p GROUP BY cluster) SELECT cluster, round(CASE WHEN degrees(atan2(y, x)) <= 0 THEN degrees(atan2(y, x)) + 360 ELSE degrees(atan2(y, x)) END, 3) AS mean_phase, round(sqrt(x * x + y * y) / w, 6) AS resultant FROM s", "fx_ts")
def _(spark, d):
    p = series.phases(series.dft(fixture(spark, d, "fx_ts"), 1)).withColumn("cluster", F.col("id") % 6)
    return rounded(rounded(stats.phase_dist(p, ["cluster"], "phase", "amplitude"), "mean_phase", digits=3), "resultant").select("cluster", "mean_phase", "resultant")


@register("zscore", "SELECT id, t, round((y - avg(y) OVER w) / nullif(stddev_samp(y) OVER w, 0), 6) AS z FROM fx_ts WINDOW w AS (PARTITION BY id)", "fx_ts")
def _(spark, d):
    return rounded(series.zscore(fixture(spark, d, "fx_ts")), "z").select("id", "t", "z")


@register("log_ratio", "SELECT id, t, round(CASE WHEN y > 0 THEN log2(y / avg(y) OVER (PARTITION BY id)) END, 6) AS lr FROM fx_ts", "fx_ts")
def _(spark, d):
    return rounded(series.log_ratio(fixture(spark, d, "fx_ts")), "lr").select("id", "t", "lr")


@register("moving_average", "SELECT id, t, round(CASE WHEN count(*) OVER w = 4 THEN avg(y) OVER w END, 6) AS ma FROM fx_ts WINDOW w AS (PARTITION BY id ORDER BY t ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING)", "fx_ts")
def _(spark, d):
    return rounded(series.moving_average(fixture(spark, d, "fx_ts"), 4, ["id"], "t", "y"), "ma").select("id", "t", "ma")


@register("moving_average_circular", "SELECT a.id, a.t, round(avg(b.y), 6) AS ma FROM fx_ts a JOIN fx_ts b ON a.id = b.id AND (b.t - a.t + 26) % 24 <= 4 GROUP BY 1, 2", "fx_ts")
def _(spark, d):
    return rounded(series.moving_average(fixture(spark, d, "fx_ts"), 5, ["id"], "t", "y", circular=True), "ma").select("id", "t", "ma")


@register("running_median", "SELECT id, t, round(quantile_cont(y, 0.5) OVER (PARTITION BY id ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS median FROM fx_ts", "fx_ts")
def _(spark, d):
    return rounded(series.running_median(fixture(spark, d, "fx_ts"), 5, ["id"], "t", "y"), "median").select("id", "t", "median")


PRIMARY = """, g AS (SELECT c.chr, p.coor FROM (SELECT DISTINCT chr FROM fx_signal) AS c CROSS JOIN (SELECT unnest(range(1, 4321)) AS coor) AS p), cn AS (SELECT chr, coor, count(DISTINCT t) AS n FROM fx_signal WHERE reads > 0 GROUP BY 1, 2), full_ AS (SELECT g.chr, g.coor, coalesce(n, 0) AS n FROM g LEFT JOIN cn ON cn.chr = g.chr AND cn.coor = g.coor),
ext AS (SELECT chr, coor AS pos_, n, coor BETWEEN 1 AND 4320 AS own FROM full_ UNION ALL SELECT chr, coor - 4320, n, false FROM full_ WHERE coor > 4300 UNION ALL SELECT chr, coor + 4320, n, false FROM full_ WHERE coor < 20), m AS (SELECT chr, pos_, own, avg(n) OVER (PARTITION BY chr ORDER BY pos_ ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS ma FROM ext),
o AS (SELECT chr, pos_ AS coor FROM m WHERE own AND ma > {least} AND pos_ BETWEEN 2 AND 4319), l AS (SELECT chr, coor, CASE WHEN coor - lag(coor) OVER (PARTITION BY chr ORDER BY coor) <= 1 THEN 0 ELSE 1 END AS new FROM o), u AS (SELECT chr, coor, sum(new) OVER (PARTITION BY chr ORDER BY coor ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM l),
runs AS (SELECT chr, min(coor) AS start, max(coor) AS e, count(*) AS n FROM u GROUP BY chr, run)
""".replace("{least}", "0.4")


@register("primary_runs", PRIMARY + 'SELECT chr, start, e AS "end", n FROM runs', "fx_signal")
def _(spark, d):
    return series.expressed_runs(fixture(spark, d, "fx_signal"), 4320, 7, 0.4)


@register("fused_runs", PRIMARY + """, z AS (SELECT *, CASE WHEN start - lag(e) OVER (PARTITION BY chr ORDER BY start) < 5 THEN 0 ELSE 1 END AS new FROM runs), y AS (SELECT *, sum(new) OVER (PARTITION BY chr ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM z), x AS (SELECT chr, min(start) AS start, max(e) AS e FROM y GROUP BY chr, k)
SELECT chr, start, e AS "end" FROM x WHERE e - start >= 10""", "fx_signal")
def _(spark, d):
    return series.fused_runs(series.expressed_runs(fixture(spark, d, "fx_signal"), 4320, 7, 0.4), 5, 10)


@register("presegment")
def _(spark, d):
    runs = series.fused_runs(series.expressed_runs(fixture(spark, d, "fx_signal"), 4320, 7, 0.4), 5, 10)
    return series.greedy_fusion(runs, 40)


@register("sliding_dft", """, w AS (SELECT a.id, a.t, k, sum(b.y * cos(2 * pi() * k * (b.t - a.t) / 8)) AS re, sum(b.y * sin(2 * pi() * k * (b.t - a.t) / 8)) AS im FROM fx_ts a JOIN fx_ts b ON a.id = b.id AND b.t BETWEEN a.t AND a.t + 7 CROSS JOIN (VALUES (1), (2)) AS c(k) WHERE a.t <= 16 GROUP BY 1, 2, 3)
SELECT id, t, k, round(sqrt(re * re + im * im) / 8, 5) AS amplitude FROM w""", "fx_ts")
def _(spark, d):
    return rounded(series.sliding_dft(fixture(spark, d, "fx_ts"), 8, ["id"], "t", "y", periods=(4, 8)), "amplitude", digits=5)


@register("dft_permutation_p")
def _(spark, d):
    return series.dft_permutation_p(fixture(spark, d, "fx_ts"))


@register("trend_class")
def _(spark, d):
    rows = fixture(spark, d, "fx_ts").groupBy("id").agg(F.array_sort(F.collect_list(F.struct(F.col("t").cast("double").alias("t"), "y"))).alias("s"))
    return rows.select("id", series.trend_class()(F.transform("s", lambda x: x["t"]), F.transform("s", lambda x: x["y"])).alias("trend"))


@register("circular_density", DFT + ", v AS (SELECT round(CASE WHEN degrees(-atan2(im, re)) <= 0 THEN degrees(-atan2(im, re)) + 360 ELSE degrees(-atan2(im, re)) END, 3) AS v FROM f WHERE k = 1), g AS (SELECT CAST(unnest(range(0, 64)) AS INT) AS g) SELECT g.g AS g, round(sum(exp(-((g.g * 5.625 - v) ** 2) / 800) + exp(-((g.g * 5.625 - v - 360) ** 2) / 800) + exp(-((g.g * 5.625 - v + 360) ** 2) / 800)) / (count(*) * 20 * sqrt(2 * pi())), 7) AS density FROM v CROSS JOIN g GROUP BY g.g", "fx_ts")
def _(spark, d):
    p = series.phases(series.dft(fixture(spark, d, "fx_ts"), 1)).select(F.round("phase", 3).alias("phase"))
    return rounded(series.circular_density(p, "phase", 20.0), "density", digits=7).select("g", "density")


@register("recluster_step", """, e AS (SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS k FROM embeddings), c AS (SELECT label, k, avg(v) AS v FROM e GROUP BY 1, 2), d AS (SELECT e.vec_id, c.label, round(sum((e.v - c.v) ** 2), 9) AS d FROM e JOIN c USING (k) GROUP BY 1, 2), r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY vec_id ORDER BY d, label) AS n FROM d) SELECT vec_id, label AS cluster FROM r WHERE n = 1""".replace(", e AS", "WITH e AS", 1))
def _(spark, d):
    return series.recluster_step(spark.read.parquet(f"{d}/embeddings.parquet"))


@register("recluster")
def _(spark, d):
    return series.recluster(spark.read.parquet(f"{d}/embeddings.parquet"))


@register("centre_correlation", "WITH e AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) AS k FROM embeddings), c AS (SELECT label, k, avg(v) AS v FROM e GROUP BY 1, 2) SELECT e.vec_id, c.label AS centre, round(corr(e.v, c.v), 5) AS r FROM e JOIN c USING (k) GROUP BY 1, 2")
def _(spark, d):
    return rounded(series.centre_correlation(spark.read.parquet(f"{d}/embeddings.parquet")), "r", digits=5)


@register("kmeans_models")
def _(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features"))
    return series.kmeans(e, [4, 8])[1]


@register("loess_normalised")
def _(spark, d):
    s = fixture(spark, d, "fx_ts").select("id", F.col("t").alias("column"), F.col("y").alias("value"))
    return series.loess_normalised(s)


@register("density_grid")
def _(spark, d):
    return series.density_grid(fixture(spark, d, "fx_xy"), "x", "y", 64)


@register("medoids")
def _(spark, d):
    s = fixture(spark, d, "fx_ts").groupBy("id").agg(F.avg("y").alias("mean"), F.max("y").alias("most"))
    return series.medoids(s, 7, ["mean", "most"])


@register("strand_rows", "SELECT c_custkey AS id, '+' AS strand, c_acctbal AS v FROM customer UNION ALL SELECT c_custkey, '-', -c_acctbal FROM customer")
def _(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("v_frw"), (-F.col("c_acctbal")).alias("v_rev"))
    return series.strand_rows(c, ["v_frw"], ["v_rev"], ["v"])


@register("running_seconds", "SELECT o_orderkey AS seq, o_orderstatus AS type, round(sum(o_totalprice) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey), 2) AS running FROM orders")
def _(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("type"), F.col("o_totalprice").alias("seconds"))
    return rounded(stats.timing(o), "running", digits=2).select("seq", "type", "running")


# ---------------------------------------------------------------- segments' dynamics

HELD = """, p AS (SELECT chr, coor, t, reads FROM fx_signal), s AS (SELECT id, chr, start // 600 + 1 AS a, end_ // 600 + 1 AS b FROM fx_seg WHERE type = 'purchase'),
held AS (SELECT s.id, p.coor, p.t, p.reads FROM s JOIN p ON p.chr = s.chr AND p.coor BETWEEN a AND b)
"""


def coarse_seg(spark: SparkSession, d: str) -> DataFrame:
    """Purchases in 10-minute positions."""
    s = seg(spark, d).where("type = 'purchase'")
    return s.select("id", "chr", "type", "strand", (F.floor(F.col("start") / 600) + 1).alias("start"), (F.floor(F.col("end") / 600) + 1).alias("end"))


def held_reads(spark: SparkSession, d: str) -> DataFrame:
    got = intervals.segment_reads(coarse_seg(spark, d).select("id", "chr", "start", "end"), fixture(spark, d, "fx_signal").select("chr", "coor", "t", "reads"))
    return got.select(F.col("t_id").alias("id"), F.col("q_coor").alias("coor"), F.col("q_t").alias("t"), F.col("q_reads").alias("value"))


@register("segment_average", HELD + "SELECT id, t, round(avg(reads), 6) AS value FROM held GROUP BY 1, 2", "fx_seg", "fx_signal")
def _(spark, d):
    return rounded(stats.segment_average(held_reads(spark, d)), "value")


@register("segment_average_trimmed", HELD + """, pos AS (SELECT id, coor, avg(reads) AS m, row_number() OVER (PARTITION BY id ORDER BY coor) AS place, count(*) OVER (PARTITION BY id) AS n FROM held GROUP BY id, coor),
cut AS (SELECT * FROM pos WHERE place > round_even(n * 0.2, 0) AND place <= n - round_even(n * 0.2, 0)), q AS (SELECT id, quantile_cont(m, 0.1) AS lo, quantile_cont(m, 0.9) AS hi FROM cut GROUP BY id)
SELECT held.id, held.t, round(median(reads), 6) AS value FROM held JOIN cut USING (id, coor) JOIN q USING (id) WHERE m >= lo AND m <= hi GROUP BY 1, 2""", "fx_seg", "fx_signal")
def _(spark, d):
    return rounded(stats.segment_average(held_reads(spark, d), "median", rm_extreme=True, endcut=0.2), "value")


OSC = """, o AS (SELECT DISTINCT chr, coor, CAST((coor * 37) % 360 + 1 AS DOUBLE) AS phase, CASE WHEN coor % 5 = 0 THEN 1.0 ELSE 1.0 / (coor % 50 + 1) END AS pv FROM fx_signal),
marks AS (SELECT s.id, phase, CASE WHEN pv = 1 THEN NULL ELSE pv END AS pv, 1 - pv AS w FROM s JOIN o ON o.chr = s.chr AND o.coor BETWEEN a AND b),
ang AS (SELECT id, sum(w * cos(radians(phase))) AS x, sum(w * sin(radians(phase))) AS y, sum(w) AS w, count(*) AS n, avg(pv) AS p_mean, avg(CASE WHEN pv < 0.05 THEN 1.0 ELSE 0.0 END) AS sig FROM marks GROUP BY id),
rd AS (SELECT id, CAST(sum(reads) AS BIGINT) AS total, count(*) AS n, avg(reads) AS mean, var_samp(reads) AS v FROM held GROUP BY id)
"""


def oscillation(spark: SparkSession, d: str) -> DataFrame:
    points = fixture(spark, d, "fx_signal").select("chr", "coor").distinct()
    return points.select("chr", "coor", ((F.col("coor") * 37) % 360 + 1).cast("double").alias("phase"), F.when(F.col("coor") % 5 == 0, 1.0).otherwise(1.0 / (F.col("coor") % 50 + 1)).alias("p"))


@register("segment_dynamics", HELD + OSC + """SELECT s.id, rd.total AS r_total, rd.n AS r_n, round(rd.mean, 6) AS r_mean, round(rd.v, 6) AS r_variance, round(CASE WHEN degrees(atan2(y, x)) <= 0 THEN degrees(atan2(y, x)) + 360 ELSE degrees(atan2(y, x)) END, 3) AS ph_mean, round(sqrt(x * x + y * y) / nullif(ang.w, 0), 6) AS ph_resultant, round(p_mean, 6) AS p_mean, round(sig, 6) AS p_significant
FROM s LEFT JOIN rd ON rd.id = s.id LEFT JOIN ang ON ang.id = s.id""", "fx_seg", "fx_signal")
def _(spark, d):
    reads = fixture(spark, d, "fx_signal").select("chr", "coor", "t", F.col("reads").alias("value"))
    got = rounded(stats.dynamics(coarse_seg(spark, d), reads, oscillation(spark, d)), "r_mean", "r_variance", "ph_resultant", "p_mean", "p_significant")
    return rounded(got, "ph_mean", digits=3).select("id", "r_total", "r_n", "r_mean", "r_variance", "ph_mean", "ph_resultant", "p_mean", "p_significant")


@register("noise_filters", HELD + OSC + """, pts AS (SELECT id, count(DISTINCT t) AS points FROM held WHERE reads > 0 GROUP BY id)
SELECT s.id, CASE WHEN coalesce(rd.mean, 0) <= 0 THEN true ELSE ln(rd.mean) < 0.3 END AS lowex, coalesce(points, 0) <= 4 AS fewpoints, b - a + 1 < 4 AS short, coalesce(sig, 0) = 0 AS unsig, (s.id % 7) / 7.0 >= 0.5 AS unsig_r,
 (s.id % 7) / 7.0 >= 0.5 AND CASE WHEN coalesce(rd.mean, 0) <= 0 THEN true ELSE ln(rd.mean) < 0.3 END AS noise FROM s LEFT JOIN rd ON rd.id = s.id LEFT JOIN ang ON ang.id = s.id LEFT JOIN pts ON pts.id = s.id""", "fx_seg", "fx_signal")
def _(spark, d):
    s, held = coarse_seg(spark, d), held_reads(spark, d)
    marks = intervals.points_in(oscillation(spark, d), s.select("id", "chr", "start", "end")).select(F.col("t_id").alias("id"), F.col("q_p").alias("p"))
    test = s.select("id", ((F.col("id") % 7) / 7.0).alias("p"))
    return stats.noise_filters(s, stats.segment_average(held), stats.read_dist(held, ["id"], "value"), stats.p_dist(marks, ["id"], "p"), test, 4, 0.3, 4, 0.5)


@register("presegment_summary", HELD + "SELECT s.id, b - a + 1 AS length, count(DISTINCT coor) AS covered, count(coor) AS points, CAST(coalesce(sum(reads), 0) AS BIGINT) AS reads FROM s LEFT JOIN held USING (id) GROUP BY s.id, a, b", "fx_seg", "fx_signal")
def _(spark, d):
    return series.presegment_summary(coarse_seg(spark, d), fixture(spark, d, "fx_signal").select("chr", "coor", "t", "reads"))


@register("segment_recovery", """, pairs AS (SELECT q.type AS qtype, t.type AS ttype, t.id AS target, least(q.end_, t.end_) - greatest(q.start, t.start) + 1 AS intersect, greatest(q.end_, t.end_) - least(q.start, t.start) + 1 AS "union", q.end_ - q.start + 1 AS qlen, t.end_ - t.start + 1 AS tlen FROM fx_seg q JOIN fx_seg t ON q.chr = t.chr AND q.strand = t.strand AND q.end_ >= t.start AND q.start <= t.end_),
h AS (SELECT *, rank() OVER (PARTITION BY qtype, target ORDER BY intersect / "union" DESC) AS qrank FROM pairs), b AS (SELECT *, intersect / "union" AS j FROM h WHERE qrank = 1),
best AS (SELECT ttype, qtype, count(DISTINCT target) AS targets_hit, CAST(sum(CASE WHEN intersect / tlen >= 0.8 AND intersect / qlen >= 0.8 THEN 1 ELSE 0 END) AS BIGINT) AS good_hits, round(sum(intersect) / sum("union"), 6) AS jaccard, round(avg(CASE WHEN j >= 0.5 THEN 1.0 ELSE 0.0 END), 6) AS j_above, round(quantile_cont(j, 0.5), 6) AS j_cutoff, round(avg(CASE WHEN qlen / tlen < 0.8 THEN 1.0 ELSE 0.0 END), 6) AS ratio_low, round(avg(CASE WHEN qlen / tlen <= 1.2 THEN 1.0 ELSE 0.0 END), 6) AS ratio_high FROM b GROUP BY 1, 2),
per AS (SELECT ttype, qtype, round(count(*) / count(DISTINCT target), 6) AS hits_per_target FROM h GROUP BY 1, 2), tt AS (SELECT type AS ttype, count(*) AS targets FROM fx_seg GROUP BY 1)
SELECT * FROM best JOIN per USING (ttype, qtype) JOIN tt USING (ttype)""", "fx_seg")
def _(spark, d):
    s = seg(spark, d)
    return rounded(stats.recovery(s, s), "jaccard", "j_above", "j_cutoff", "ratio_low", "ratio_high", "hits_per_target")


@register("self_overlap", """, f AS (SELECT * FROM fx_seg WHERE strand <> '-'), r AS (SELECT * FROM fx_seg WHERE strand = '-')
SELECT r.id AS target, f.id AS query, least(f.end_, r.end_) - greatest(f.start, r.start) + 1 AS intersect FROM f JOIN r ON f.chr = r.chr AND f.end_ >= r.start AND f.start <= r.end_""", "fx_seg")
def _(spark, d):
    return intervals.self_overlap(seg(spark, d), rank=False).select("target", "query", "intersect")


FACING = """, fl AS (SELECT id, chr, type, strand, CASE WHEN (strand = '-') = {after} THEN start - 300 ELSE end_ + 1 END AS start, CASE WHEN (strand = '-') = {after} THEN start - 1 ELSE end_ + 300 END AS end_ FROM fx_seg)
SELECT t.id AS target, q.id AS query, least(q.end_, t.end_) - greatest(q.start, t.start) + 1 AS intersect FROM fl q JOIN fl t ON q.chr = t.chr AND q.strand <> t.strand AND q.end_ >= t.start AND q.start <= t.end_ WHERE q.type IN ('click', 'view') AND t.type = 'purchase'"""


@register("convergent_overlap", FACING.replace("{after}", "true"), "fx_seg")
def _(spark, d):
    return intervals.facing(*split_seg(spark, d), 300, rank=False).select("target", "query", "intersect")


@register("divergent_overlap", FACING.replace("{after}", "false"), "fx_seg")
def _(spark, d):
    return intervals.facing(*split_seg(spark, d), -300, rank=False).select("target", "query", "intersect")


@register("hits_as_target_sees", PAIRS + "SELECT target, query, CASE qpos WHEN 'covers' THEN 'inside' WHEN 'inside' THEN 'covers' WHEN 'left' THEN 'right' ELSE 'left' END AS qpos, qlen FROM hits", "fx_seg")
def _(spark, d):
    return intervals.as_target_sees(intervals.annotate(*split_seg(spark, d), add_na=True, rank=False)).select("target", "query", "qpos", "qlen")


@register("known_chromosomes", "SELECT id, chr FROM fx_seg WHERE chr IN (1, 3) AND type = 'view'", "fx_seg")
def _(spark, d):
    chroms = fixture(spark, d, "fx_genome").where("chr in (1, 3)")
    return intervals.known_chromosomes(intervals.with_types(seg(spark, d), ["view"]), chroms).select("id", "chr")


@register("permutation_table")
def _(spark, d):
    s = seg(spark, d)
    return intervals.permutation_table(s, s, 100)


@register("track_spectrum", ", p AS (SELECT chr, CAST(coor AS BIGINT) AS coor, sum(reads) AS y FROM fx_signal GROUP BY 1, 2), g AS (SELECT c.chr, x.coor, coalesce(p.y, 0) AS y FROM (SELECT DISTINCT chr FROM fx_signal) AS c CROSS JOIN (SELECT unnest(range(1, 4321)) AS coor) AS x LEFT JOIN p ON p.chr = c.chr AND p.coor = x.coor), f AS (SELECT chr, k, sum(y * cos(2 * pi() * k * (coor - 1) / 4320)) AS re, sum(y * sin(2 * pi() * k * (coor - 1) / 4320)) AS im FROM g CROSS JOIN (VALUES (1), (30), (60)) AS kk(k) GROUP BY 1, 2) SELECT chr, k, 4320.0::DOUBLE / k AS period, round(sqrt(re * re + im * im) / 4320, 7) AS amplitude FROM f", "fx_signal")
def _(spark, d):
    p = fixture(spark, d, "fx_signal").groupBy("chr", "coor").agg(F.sum("reads").alias("y"))
    spine = p.select("chr").distinct().withColumn("coor", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(4320).cast("long"))))
    full = spine.join(p, ["chr", "coor"], "left").withColumn("y", F.coalesce("y", F.lit(0)))
    return rounded(series.track_spectrum(full, [1, 30, 60], ["chr"], "coor", "y"), "amplitude", digits=7)


@register("sets_by_size", "SELECT p_brand, count(*) AS count, row_number() OVER (ORDER BY count(*) DESC, p_brand) AS place FROM part GROUP BY p_brand")
def _(spark, d):
    return series.sets_by_size(spark.read.parquet(f"{d}/part.parquet"), "p_brand")


@register("timing_rows", "SELECT o_orderkey * 3 + 2 AS seq, concat('K:', o_orderkey % 4) AS type, CAST(o_orderkey % 1000 AS BIGINT) AS length, o_totalprice AS seconds FROM orders")
def _(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    lines = F.array(F.struct(F.lit("Timeseries N").alias("label"), (F.col("o_orderkey") % 1000).cast("string").alias("value")), F.struct(F.lit("SEGMENT TYPE").alias("label"), F.concat(F.lit("K:"), (F.col("o_orderkey") % 4).cast("string")).alias("value")), F.struct(F.lit("elapsed, sec").alias("label"), F.col("o_totalprice").cast("string").alias("value")))
    log = o.select("o_orderkey", F.posexplode(lines).alias("i", "line")).select((F.col("o_orderkey") * 3 + F.col("i")).alias("seq"), "line.label", "line.value")
    return stats.timing_rows(log)


@register("inserted_rows", ", o AS (SELECT id, 0 AS new, place FROM (SELECT id, row_number() OVER (ORDER BY chr, least(start, end_), id) AS place FROM fx_seg) AS x UNION ALL SELECT -id, 1, place FROM (SELECT id, row_number() OVER (ORDER BY chr, least(start, end_), id) AS place FROM fx_seg) AS y WHERE id % 5 = 0) SELECT id, row_number() OVER (ORDER BY place, new, id) AS place FROM o", "fx_seg")
def _(spark, d):
    rows = genome.sort_rank(seg(spark, d)).select("id", "place")
    return genome.insert_rows(rows, rows.where("id % 5 = 0").select((-F.col("id")).alias("id"), "place"))


@register("curve_summary", PAIRS + ", n AS (SELECT q.type AS kind, round(qlen / tlen, 1) AS x, count(*) AS n FROM hits JOIN q ON q.id = hits.query WHERE qrank = 1 GROUP BY 1, 2), c AS (SELECT kind, x, sum(n) OVER (PARTITION BY kind ORDER BY x) / sum(n) OVER (PARTITION BY kind) AS cdf FROM n) SELECT x, round(avg(cdf), 6) AS mean, round(min(cdf), 6) AS least, round(max(cdf), 6) AS most, count(*) AS n FROM c GROUP BY x", "fx_seg")
def _(spark, d):
    q, t = split_seg(spark, d)
    b = intervals.best_hits(q, t, qcols=("type",)).withColumnRenamed("q_type", "kind")
    curves = stats.ecdf(b.select("kind", F.round(F.col("qlen") / F.col("tlen"), 1).alias("x")), "x", ["kind"])
    return rounded(stats.curve_summary(curves, ["x"]), "mean", "least", "most")


@register("regression_trimmed", ", m AS (SELECT class, avg(x) AS mx, stddev_samp(x) AS sx, avg(y) AS my, stddev_samp(y) AS sy FROM fx_xy GROUP BY class), k AS (SELECT class, x, y FROM fx_xy JOIN m USING (class) WHERE abs(x - mx) <= 1.5 * sx AND abs(y - my) <= 1.5 * sy) SELECT class, count(*) AS n, round(corr(x, y), 6) AS r, round(regr_slope(y, x), 4) AS slope FROM k GROUP BY class", "fx_xy")
def _(spark, d):
    return rounded(rounded(stats.line(fixture(spark, d, "fx_xy"), ["class"], outliers=1.5), "r"), "slope", digits=4).select("class", "n", "r", "slope")


@register("cluster_profile_ranksum")
def _(spark, d):
    return stats.cluster_profile(fixture(spark, d, "fx_profile"), "ranksum")


# ---------------------------------------------------------------- sequences and scalars

DNA = "(SELECT doc_id AS id, upper(regexp_replace(text, '[^acgtACGT]', '', 'g')) AS seq FROM documents)"


def dna(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select(F.col("doc_id").alias("id"), F.upper(F.regexp_replace("text", "[^acgtACGT]", "")).alias("seq"))


@register("revcomp", f"SELECT id, reverse(translate(seq, 'ACGT', 'TGCA')) AS rc FROM {DNA} AS s")
def _(spark, d):
    return dna(spark, d).select("id", sequence.revcomp(F.col("seq")).alias("rc"))


@register("letter_frequency", f"SELECT id, letter, round((length(seq) - length(replace(seq, letter, ''))) / nullif(length(seq), 0), 6) AS frequency FROM {DNA} AS s CROSS JOIN (VALUES ('A'), ('C'), ('G'), ('T')) AS l(letter)")
def _(spark, d):
    return rounded(sequence.letter_frequency(dna(spark, d)), "frequency")


@register("range_frequency", f"SELECT id, letter, round((length(p) - length(replace(p, letter, ''))) / nullif(length(p), 0), 6) AS frequency FROM (SELECT id, substr(seq, 11, 50) AS p FROM {DNA} AS s) AS x CROSS JOIN (VALUES ('A'), ('C'), ('G'), ('T')) AS l(letter)")
def _(spark, d):
    s = dna(spark, d)
    return rounded(sequence.range_frequency(s, s.select("id", F.lit(11).alias("start"), F.lit(60).alias("end"))), "frequency")


@register("window_composition", f"SELECT id, CAST(start AS INT) AS start, letter, round((51 - length(replace(substr(seq, start, 51), letter, ''))) / 51, 6) AS frequency FROM (SELECT id, seq, unnest(range(1, length(seq) - 49, 25)) AS start FROM {DNA} AS s WHERE length(seq) >= 51) AS w CROSS JOIN (VALUES ('A'), ('C'), ('G'), ('T')) AS l(letter)")
def _(spark, d):
    return rounded(sequence.window_composition(dna(spark, d), 50, 25), "frequency")


@register("skew", f"WITH w AS (SELECT id, length(seq) AS n, start, substr(seq, start, 51) AS p FROM (SELECT id, seq, unnest(range(1, length(seq) - 49, 25)) AS start FROM {DNA} AS s WHERE length(seq) >= 51) AS x), k AS (SELECT id, n, start, (length(replace(p, 'C', '')) - length(replace(p, 'G', ''))) / nullif(102 - length(replace(p, 'G', '')) - length(replace(p, 'C', '')), 0) AS s FROM w) SELECT id, CAST(start AS INT) AS start, round(s, 6) AS skew, round(sum(coalesce(s, 0)) OVER (PARTITION BY id ORDER BY start) * 25 / n, 6) AS cumulative FROM k")
def _(spark, d):
    return rounded(sequence.skew(dna(spark, d), "G", "C", 50, 25), "skew", "cumulative")


@register("mutate", f"SELECT id, concat('T', substr(seq, 2)) AS mutated FROM {DNA} AS s WHERE length(seq) > 3")
def _(spark, d):
    s = dna(spark, d).where("length(seq) > 3")
    return s.select("id", sequence.mutate(F.col("seq"), F.array(F.concat(F.substring("seq", 1, 1), F.lit("1T")))).alias("mutated"))


@register("scalar_transforms", "SELECT c_custkey AS id, round(asinh(c_acctbal), 6) AS ash, round(ln(abs(c_acctbal) + 1), 6) AS log_1, round((sign(c_acctbal) * abs(c_acctbal) ** 0.5 - 1) / 0.5, 6) AS bc, CAST(greatest(1, least(10, floor((c_acctbal - 0) / 900.0) + 1)) AS INT) AS palette FROM customer")
def _(spark, d):
    c, x = spark.read.parquet(f"{d}/customer.parquet"), F.col("c_acctbal")
    return rounded(c.select(F.col("c_custkey").alias("id"), scalar.ash(x).alias("ash"), scalar.log_1(F.abs(x)).alias("log_1"), scalar.boxcox(x, 0.5).alias("bc"), scalar.palette_index(x, 0.0, 9000.0, 10).alias("palette")), "ash", "log_1", "bc")


@register("clipped", "WITH q AS (SELECT quantile_cont(c_acctbal, 0.05) AS lo, quantile_cont(c_acctbal, 0.95) AS hi FROM customer) SELECT c_custkey AS id, round(greatest(lo, least(hi, c_acctbal)), 6) AS x FROM customer CROSS JOIN q")
def _(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    q = c.agg(F.percentile("c_acctbal", F.lit(0.05)).alias("lo"), F.percentile("c_acctbal", F.lit(0.95)).alias("hi"))
    return rounded(c.crossJoin(q).select(F.col("c_custkey").alias("id"), scalar.clipped(F.col("c_acctbal"), F.col("lo"), F.col("hi")).alias("x")), "x")


@register("file_names", "SELECT p_partkey AS id, regexp_replace(p_name, '[^A-Za-z0-9._-]', '_', 'g') AS name FROM part")
def _(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), scalar.file_name(F.col("p_name")).alias("name"))


# ---------------------------------------------------------------- formats


@register("bed_rows", "SELECT concat('chr', lpad(CAST(chr AS VARCHAR), 2, '0')) AS chr, start - 1 AS start, end_ AS \"end\", concat('id', CAST(row_number() OVER (ORDER BY chr, start, id) AS VARCHAR)) AS name, '0' AS score, strand FROM fx_seg", "fx_seg")
def _(spark, d):
    return writers.bed_rows(seg(spark, d))


@register("gff_attributes", "SELECT id, concat('id=', CAST(id AS VARCHAR), CASE WHEN type <> 'view' THEN concat('; type=', type) ELSE '' END, '; note=\"strand:', strand, '\"') AS attributes FROM fx_seg", "fx_seg")
def _(spark, d):
    s = seg(spark, d).withColumn("type", F.when(F.col("type") != "view", F.col("type")))
    return s.select("id", writers.gff_attributes(["id", "type"], notes=["strand"]).alias("attributes"))


@register("gff_parse", "SELECT id, CAST(id AS VARCHAR) AS a_id, concat(type, ';x') AS a_type FROM fx_seg", "fx_seg")
def _(spark, d):
    s = seg(spark, d).withColumn("attributes", F.concat(F.lit("id="), F.col("id").cast("string"), F.lit(";type="), F.col("type"), F.lit(";x")))
    m = readers.attribute_map(F.col("attributes"))
    return s.select("id", m["id"].alias("a_id"), m["type"].alias("a_type"))


@register("bed_parse", "SELECT id, chr, start, end_ AS \"end\", CASE WHEN strand = '+' THEN 1 ELSE -1 END AS strand FROM fx_seg", "fx_seg")
def _(spark, d):
    s = seg(spark, d)
    return readers.bed_coordinates(s.select("id", F.concat(F.lit("chr"), F.col("chr")).alias("chr"), (F.col("start") - 1).alias("start"), "end", "strand"))


@register("painted", """, b AS (SELECT chr, start // 600 AS s, end_ // 600 + 1 AS e, id AS "row" FROM fx_seg WHERE type = 'purchase'), sp AS (SELECT chr, unnest(range(1, 4321)) AS coor FROM fx_genome)
SELECT sp.chr, sp.coor, max("row") AS value FROM sp LEFT JOIN b ON b.chr = sp.chr AND sp.coor > s AND sp.coor <= e GROUP BY 1, 2""", "fx_seg", "fx_genome")
def _(spark, d):
    b = seg(spark, d).where("type = 'purchase'").select("chr", F.floor(F.col("start") / 600).alias("start"), (F.floor(F.col("end") / 600) + 1).alias("end"), F.col("id").alias("row"), F.col("id").alias("value"))
    spine = fixture(spark, d, "fx_genome").select("chr", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(4320).cast("long"))).alias("coor"))
    return readers.painted(b, spine)


@register("zipped_tables", ", a AS (SELECT chr, coor, sum(reads) AS reads, round(sum(v), 4) AS v FROM fx_signal GROUP BY 1, 2) SELECT chr, coor, CAST(reads AS BIGINT) AS reads, v FROM a", "fx_signal")
def _(spark, d):
    s = fixture(spark, d, "fx_signal")
    a = s.groupBy("chr", "coor").agg(F.sum("reads").alias("reads"))
    return readers.zipped([a, rounded(s.groupBy("chr", "coor").agg(F.sum("v").alias("v")), "v", digits=4)])


@register("summarize_probes", "SELECT r_name AS feature, c_mktsegment AS sample, round(avg(c_acctbal), 6) AS value FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def _(spark, d):
    values = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_mktsegment").alias("sample"), F.col("c_nationkey").alias("probe"), F.col("c_acctbal").alias("value"))
    n, r = spark.read.parquet(f"{d}/nation.parquet"), spark.read.parquet(f"{d}/region.parquet")
    platform = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_nationkey").alias("probe"), F.create_map(F.lit("region"), F.col("r_name")).alias("fields"))
    return rounded(readers.summarize_probes(values, platform, "region"), "value")
