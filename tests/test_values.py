"""Values of the queries that SQL cannot express, and of functions at large margins, against plain Python."""

import collections
import itertools
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.functions import scalar
from loomspan.operators import genome, intervals, series, stats
from loomspan.plans.fixtures import FX, TABLES
from loomspan.plans.queries import QUERIES
from loomspan.sources import readers, writers

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return lambda fx: con.execute(FX[fx].format(**{t: t for t in TABLES})).fetchdf()


def t_two_sided(t, df):
    """p of Student's t by adding up its density: substituting x = sqrt(df) tan(a) makes the range finite."""
    a = np.linspace(math.atan(abs(t) / math.sqrt(df)), math.pi / 2, 200_001)
    c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)
    return 2 * c * np.trapezoid(np.cos(a) ** (df - 1), a)


def welch(x, y):
    a, b = x.var(ddof=1) / len(x), y.var(ddof=1) / len(y)
    return (x.mean() - y.mean()) / math.sqrt(a + b), (a + b) ** 2 / (a**2 / (len(x) - 1) + b**2 / (len(y) - 1))


def average_ranks(v):
    order, first, counts = np.unique(v, return_inverse=True, return_counts=True)
    return (np.cumsum(counts) - (counts - 1) / 2)[first]


# ---------------------------------------------------------------- tests


def test_welch_p_values(spark, rows):
    p = rows("fx_profile")
    for r in QUERIES["welch_p_values"](spark, DATA).collect():
        t, df = welch(p.x[p.cluster == r.cluster].to_numpy(float), p.x[p.cluster != r.cluster].to_numpy(float))
        assert (r.statistic, r.df, r.p_value) == pytest.approx((t, df, t_two_sided(t, df)), rel=1e-6)


def test_welch_of_large_means(spark):
    rng = np.random.default_rng(1)
    x, c = rng.normal(size=300) + 1e9, rng.integers(0, 3, 300)
    df = spark.createDataFrame([(int(k), float(v)) for k, v in zip(c, x)], "cluster int, x double")
    for r in stats.welch_profile(df).collect():
        assert r.statistic == pytest.approx(welch(x[c == r.cluster], x[c != r.cluster])[0], rel=1e-4)


def ranksum(x, y):
    rank = average_ranks(np.concatenate([x, y]))
    n1, n2 = len(x), len(y)
    n, ties = n1 + n2, sum(k**3 - k for k in collections.Counter(np.concatenate([x, y]).tolist()).values())
    u = rank[:n1].sum() - n1 * (n1 + 1) / 2
    z = max(abs(u - n1 * n2 / 2) - 0.5, 0) / math.sqrt(n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1))))
    return u / (n1 * n2) - 0.5, math.erfc(z / math.sqrt(2))


def test_ranksum_p_values(spark, rows):
    p = rows("fx_profile")
    got = {r.cluster: r for r in QUERIES["ranksum_p_values"](spark, DATA).collect()}
    again = {r.cluster: r for r in QUERIES["cluster_profile_ranksum"](spark, DATA).collect()}
    assert set(got) == set(again) == set(p.cluster)
    for c, r in got.items():
        want = ranksum(p.x[p.cluster == c].to_numpy(float), p.x[p.cluster != c].to_numpy(float))
        assert (r.statistic, r.p_value) == pytest.approx(want, abs=1e-9) and again[c].p_value == r.p_value


def test_ranksum_with_many_ties(spark):
    rng = np.random.default_rng(2)
    x, c = rng.integers(0, 4, 400).astype(float), rng.integers(0, 3, 400)
    df = spark.createDataFrame([(int(k), float(v)) for k, v in zip(c, x)] + [(0, None)], "cluster int, x double")
    for r in stats.with_ranksum_p(stats.ranksum_profile(df)).collect():
        assert (r.statistic, r.p_value) == pytest.approx(ranksum(x[c == r.cluster], x[c != r.cluster]), abs=1e-9)


@pytest.mark.parametrize("cells", [4096, 50])
def test_cluster_profile_takes_any_test(spark, rows, cells):
    """A function gets whole distributions: with it the t test comes out again, or nearly so where values share cells."""
    p = rows("fx_profile")

    def t_test(x, k, y, m):
        mean = lambda v, n: (v * n).sum() / n.sum()
        var = lambda v, n: ((v - mean(v, n)) ** 2 * n).sum() / (n.sum() - 1) / n.sum()
        return (mean(x, k) - mean(y, m)) / math.sqrt(var(x, k) + var(y, m)), 0.25

    got = stats.cluster_profile(spark.createDataFrame(p[["cluster", "x"]].astype({"x": float})), t_test, cells=cells).collect()
    assert {r.cluster for r in got} == set(p.cluster)
    for r in got:
        x, y = p.x[p.cluster == r.cluster].to_numpy(float), p.x[p.cluster != r.cluster].to_numpy(float)
        t = welch(x, y)[0]
        assert r.n == len(x) and r.p_value == 0.25 and r.sign == (-1 if r.statistic < 0 else 1)
        assert r.statistic == pytest.approx(t, rel=1e-9) if cells == 4096 else r.statistic == pytest.approx(t, abs=0.2)
    few = spark.createDataFrame([(1, 1.0), (2, 5.0), (2, 6.0)], "cluster int, x double")
    assert {(r.statistic, r.p_value) for r in stats.cluster_profile(few, t_test).collect()} == {(0.0, 1.0)}


def test_ci95(spark, rows):
    p = rows("fx_profile")
    for r in QUERIES["ci95"](spark, DATA).collect():
        x = p.x[p.cluster == r.cluster].to_numpy(float)
        assert t_two_sided(r.ci95 / (x.std(ddof=1) / math.sqrt(len(x))), len(x) - 1) == pytest.approx(0.05, abs=1e-6)


def test_regression_p_values(spark, rows):
    p = rows("fx_profile")
    for r in QUERIES["regression_p_values"](spark, DATA).collect():
        of = p[p.cluster == r.cluster]
        c, n = np.corrcoef(of.id.to_numpy(float), of.x.to_numpy(float))[0, 1], len(of)
        assert r.r == pytest.approx(c, abs=1e-9) and r.p_value == pytest.approx(t_two_sided(c * math.sqrt((n - 2) / (1 - c * c)), n - 2), abs=1e-6)


def test_hypergeometric_tails():
    rng = np.random.default_rng(1)
    for _ in range(300):
        total = int(rng.integers(1, 200))
        m, k, q = (int(rng.integers(0, total + 1)) for _ in range(3))
        for upper in (True, False):
            span = range(q, min(k, m) + 1) if upper else range(max(0, k + m - total), min(q, k, m) + 1)
            want = sum(math.comb(m, x) * math.comb(total - m, k - x) for x in span if 0 <= k - x <= total - m) / math.comb(total, k)
            assert stats.hypergeometric_tail([q], [k], [m], [total], upper)[0] == pytest.approx(want, abs=1e-10)
    assert stats.hypergeometric_tail([5, 0], [5, 5], [5, 5], [10, 10]).tolist() == pytest.approx([1 / 252, 1.0])


def test_contingency_of_a_thousand_million_rows(spark):
    """Margins of 1e9: the tail follows the spread, and agrees with the normal curve there."""
    q, k, m, total = 150_010_000, 300_000_000, 500_000_000, 1_000_000_000
    df = spark.createDataFrame([(q, k, m, total)], "q long, k long, m long, t long")
    got = df.select(stats.hypergeometric(*map(F.col, "qkmt")).alias("p")).first().p
    assert got == pytest.approx(math.erfc(1e4 / math.sqrt(k * 0.25 * (1 - k / total)) / math.sqrt(2)) / 2, rel=1e-3)


# ---------------------------------------------------------------- order without global windows


def test_numbers_follow_the_order(spark):
    rng = np.random.default_rng(3)
    data = [(i, int(rng.integers(1, 4)), "+-"[rng.integers(0, 2)], int(a := rng.integers(-5_000_000, 5_000_000)), int(a + 9)) for i in range(400)]
    df = spark.createDataFrame(data, "id long, chr int, strand string, start long, end long")
    want = [r[0] for r in sorted(data, key=lambda r: (r[2] == "-", r[1], r[3], r[0]))]
    assert [r.id for r in genome.sort_rank(df, by_strand=True).orderBy("place").collect()] == want
    assert sorted(r.place for r in genome.sort_rank(df).collect()) == list(range(1, 401))
    names = {r.start + 1: r.name for r in writers.bed_rows(df).collect()}
    assert [names[r[3]] for r in sorted(data, key=lambda r: (r[1], r[3], r[0]))] == [f"id{k}" for k in range(1, 401)]


def test_running_count_in_parts(spark):
    rng = np.random.default_rng(4)
    values = collections.Counter(np.round(rng.normal(size=3000), 2).tolist())
    df = spark.createDataFrame(list(values.items()), "x double, n long")
    got = {r.x: r.upto for r in stats.running_count(df, "x", "n", [], "upto", parts=16).collect()}
    assert got == dict(zip(sorted(values), itertools.accumulate(values[v] for v in sorted(values))))


def test_index_of_many_contigs(spark):
    """Positions meet contigs by blocks, small contigs sharing one and large ones having several."""
    lens = [5, 9_000_000, 1, 3, 12_000_000, 7]
    chroms = spark.createDataFrame(list(enumerate(lens, 1)), "chr int, len long")
    points = [(c, s, p) for c, n in enumerate(lens, 1) for s in "+-" for p in {1, n, max(1, n // 2)}]
    df = spark.createDataFrame([(i, c, s, p, p) for i, (c, s, p) in enumerate(points)], "id long, chr int, strand string, start long, end long")
    back = genome.from_index(genome.to_index(df, chroms).drop("start", "end"), chroms)
    assert {(r.id, r.chr, r.strand, r.start) for r in back.collect()} == {(i, c, s, p) for i, (c, s, p) in enumerate(points)}
    whole = spark.createDataFrame([(1, 1, 2 * sum(lens))], "id long, idx_start long, idx_end long")
    parts = genome.split_at_borders(whole, chroms).orderBy("part").collect()
    assert [(r.chr, r.strand, r.start, r.end) for r in parts] == [(c, s, 1, n) for s in "+-" for c, n in enumerate(lens, 1)]


# ---------------------------------------------------------------- series


def test_dft_permutation_p(spark, rows):
    ts = rows("fx_ts").sort_values(["id", "t"])
    y = np.stack([g.y.to_numpy(float) for _, g in ts.groupby("id")])
    ids = sorted(set(ts.id))
    real = np.abs(np.fft.rfft(y, axis=1))
    count = sum((np.abs(np.fft.rfft(y[:, np.random.default_rng([1, r]).permutation(y.shape[1])], axis=1)) >= real - 1e-9).astype(int) for r in range(100))
    got = {(r.id, r.k): r.p_value for r in QUERIES["dft_permutation_p"](spark, DATA).collect()}
    assert got == {(ids[i], k): count[i, k] / 100 for i in range(len(ids)) for k in range(real.shape[1])}


def test_trends():
    x = np.linspace(0, 10, 21)
    shapes = {"increasing": x, "decreasing": -x, "flat": 0 * x + 3, "peak": -((x - 5) ** 2), "trough": (x - 5) ** 2, "complex": np.sin(x * 2 * np.pi / 10)}
    for name, y in shapes.items():
        assert series.trends([x], [y]) == [name]
        assert series.trends([np.append(x, 3.0)], [np.append(y, np.nan)]) == [name]
    assert series.trends([x[:4], None], [x[:4], None]) == ["nodata", "nodata"]


def test_trend_class_query(spark, rows):
    """The cubic of each user's day, fitted by another routine."""
    got = {r.id: r.trend for r in QUERIES["trend_class"](spark, DATA).collect()}
    for i, g in rows("fx_ts").sort_values("t").groupby("id"):
        y = g.y.to_numpy(float)
        slope = np.polynomial.Polynomial.fit(np.arange(24.0), y, 3).deriv()(np.linspace(0, 23, 50)) * 23
        sign = [k for k, _ in itertools.groupby(np.sign(slope[np.abs(slope) > 0.05 * np.ptp(y)]).astype(int).tolist())]
        assert got[i] == {(): "flat", (1,): "increasing", (-1,): "decreasing", (1, -1): "peak", (-1, 1): "trough"}.get(tuple(sign), "complex")


def greedy(segments, least):
    s = [list(x) for x in segments]
    while len(s) > 1:
        lens = [b - a for a, b in s]
        i = lens.index(min(lens))
        if lens[i] >= least:
            break
        j = i + 1 if i == 0 or (i + 1 < len(s) and lens[i + 1] < lens[i - 1]) else i - 1
        a, b = min(i, j), max(i, j)
        s[a : b + 1] = [[s[a][0], s[b][1]]]
    return [tuple(x) for x in s]


def test_greedy_fusion(spark):
    rng = np.random.default_rng(5)
    want, data = set(), []
    for c in range(30):
        at, segments = 0, []
        for _ in range(rng.integers(1, 25)):
            a = at + int(rng.integers(1, 9))
            at = a + int(rng.integers(0, 30))
            segments.append((a, at))
        data += [(c, a, b) for a, b in segments]
        want |= {(c, a, b) for a, b in greedy(segments, 25)}
    got = series.greedy_fusion(spark.createDataFrame(data, "chr int, start long, end long"), 25).collect()
    assert {(r.chr, r.start, r.end) for r in got} == want and len(got) == len(want)


def test_presegment_query(spark):
    runs = collections.defaultdict(list)
    for r in QUERIES["fused_runs"](spark, DATA).orderBy("chr", "start").collect():
        runs[r.chr].append((r.start, r.end))
    got = {(r.chr, r.start, r.end) for r in QUERIES["presegment"](spark, DATA).collect()}
    assert got == {(c, a, b) for c, s in runs.items() for a, b in greedy(s, 40)}


def test_kmeans_models(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=(40, 3)) + 20 * k for k in range(3)])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, features array<double>")
    assign, model = series.kmeans(df, [2, 3])
    found = {r.k: r for r in model.collect()}
    for k in (2, 3):
        own = {r.id: r.cluster for r in assign.where(f"k = {k}").collect()}
        label = np.array([own[i] for i in range(len(x))])
        sse = sum(((x[label == c] - x[label == c].mean(0)) ** 2).sum() for c in set(label.tolist()))
        n, d = x.shape
        assert found[k].sse == pytest.approx(sse, rel=1e-9) and found[k].bic == pytest.approx(n * d * math.log(sse / (n * d)) + k * (d + 1) * math.log(n))
    assert {len(set(label[40 * g : 40 * g + 40].tolist())) for g in range(3)} == {1}
    best = series.selected(assign, model)
    assert {r.k for r in best.collect()} == {3} == {r.k for r in series.selected(assign, model, "K:3").collect()}
    order = spark.createDataFrame([(int(label[0]), 2), (int(label[40]), 1), (int(label[80]), 3)], "cluster int, place int")
    assert {(r.id // 40, r.cluster) for r in series.relabelled(best, order).collect()} == {(0, 2), (1, 1), (2, 3)}
    r = spark.createDataFrame([(i, 0, 0.9 if i % 2 else 0.1) for i in range(120)], "id long, centre int, r double")
    assert {x.id for x in series.nuisance(best, r, 0.5).where("cluster = 0").collect()} >= {i for i in range(0, 120, 2)}


def test_kmeans_query(spark):
    got = {r.k: r for r in QUERIES["kmeans_models"](spark, DATA).collect()}
    assert set(got) == {4, 8} and got[8].sse < got[4].sse


def test_loess_makes_columns_alike(spark):
    """Columns that are monotone functions of one value come back as that value."""
    rng = np.random.default_rng(7)
    base = np.sort(rng.normal(size=400))
    bends = {0: lambda v: v, 1: lambda v: 2 * v + 1, 2: lambda v: v**3 / 4 + v, 3: lambda v: v - 2, 4: lambda v: 0.5 * v}
    df = spark.createDataFrame([(i, c, float(f(v))) for i, v in enumerate(base) for c, f in bends.items()], "id long, column int, value double")
    medians = {i: np.median([f(v) for f in bends.values()]) for i, v in enumerate(base)}
    got = series.loess_normalised(df).collect()
    inner = [abs(r.normalised - medians[r.id]) for r in got if 20 <= r.id < 380]
    assert len(got) == 2000 and max(inner) < 0.2 and np.mean(inner) < 0.03
    with pytest.raises(ValueError, match="more than 3 columns"):
        series.loess_normalised(df, max_columns=3)


def test_loess_query(spark, rows):
    got = QUERIES["loess_normalised"](spark, DATA).collect()
    assert {(r.id, r["column"], r.value) for r in got} == {(a, b, c) for a, b, c in rows("fx_ts")[["id", "t", "y"]].itertuples(index=False)}


def test_density_grid(spark, rows):
    """The smoothed counts, term by term: each cell's share goes to its neighbours along either axis."""
    xy = rows("fx_xy").astype({"x": float, "y": float})
    cell = lambda v: np.minimum(63, np.floor((v - v.min()) / (v.max() - v.min()) * 64)).astype(int)
    grid = np.zeros((64, 64))
    np.add.at(grid, (cell(xy.x.to_numpy()), cell(xy.y.to_numpy())), 1)
    d = np.arange(64)[:, None] - np.arange(64)[None, :]
    kernel = np.where(np.abs(d) <= 8, np.exp(-(d**2) / 8.0), 0)
    kernel /= np.exp(-np.arange(-8, 9) ** 2 / 8.0).sum()
    want = kernel @ grid @ kernel
    got = QUERIES["density_grid"](spark, DATA).collect()
    assert len(got) == 4096
    for r in got:
        assert r.density == pytest.approx(want[r.i, r.j] / want.sum(), abs=1e-12) and abs(r.level - 255 * want[r.i, r.j] / want.max()) < 1.001


def test_medoids(spark, rows):
    """Each cluster's medoid is its member of least distance to the others, and every row is with its nearest medoid."""
    ts = rows("fx_ts").groupby("id").y.agg(["mean", "max"]).astype(float)
    x = ((ts - ts.min()) / (ts.max() - ts.min())).to_numpy()
    own = {r.id: r.cluster for r in QUERIES["medoids"](spark, DATA).collect()}
    label = np.array([own[i] for i in ts.index])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    medoid = {c: min(np.flatnonzero(label == c), key=lambda i: d[i, label == c].sum()) for c in set(label.tolist())}
    assert len(medoid) == 7 and all(d[i, medoid[label[i]]] <= min(d[i, m] for m in medoid.values()) + 1e-12 for i in range(len(x)))
    df = spark.createDataFrame([(i, float(i)) for i in range(9)], "id long, a double")
    with pytest.raises(ValueError, match="more than 5 rows"):
        series.medoids(df, 2, ["a"], most=5)


# ---------------------------------------------------------------- segment averages


def running_median(v, k, endrule):
    h, n = k // 2, len(v)
    out = list(v)
    for i in range(n):
        near = min(i, n - 1 - i)
        if near >= h:
            out[i] = float(np.median(v[i - h : i + h + 1]))
        elif endrule == "median":
            out[i] = float(np.median(v[i - near : i + near + 1]))
    if endrule == "constant" and n > 2 * h:
        out[:h], out[n - h :] = [out[h]] * h, [out[n - 1 - h]] * h
    return out


@pytest.mark.parametrize("options", [{}, {"avg": "median"}, {"mean_ratio": True}, {"rm_extreme": True}, {"endcut": 0.25}, {"k": 3}, {"k": 5, "endrule": "keep"}, {"k": 5, "endrule": "constant"}, {"mean_ratio": True, "endcut": 0.1, "k": 3, "rm_extreme": True}])
def test_segment_average(spark, options):
    rng = np.random.default_rng(8)
    segments = {s: rng.integers(1, 30, (int(rng.integers(3, 14)), 9)).astype(float) for s in range(6)}
    df = spark.createDataFrame([(s, p, t, float(v)) for s, m in segments.items() for p, row in enumerate(m) for t, v in enumerate(row)], "id int, coor int, t int, value double")
    got = {(r.id, r.t): r.value for r in stats.segment_average(df, **options).collect()}
    want = {}
    for s, m in segments.items():
        mean = m.mean()
        if options.get("mean_ratio"):
            m = m / m.mean(1, keepdims=True)
        if cut := options.get("endcut"):
            n = round(len(m) * cut)
            m = m[n : len(m) - n]
        if options.get("k", 1) > 1:
            m = np.array([running_median(list(row), options["k"], options.get("endrule", "median")) for row in m])
        if options.get("rm_extreme"):
            means = m.mean(1)
            m = m[(means >= np.quantile(means, 0.1)) & (means <= np.quantile(means, 0.9))]
        if len(m):
            average = np.median(m, 0) if options.get("avg") == "median" else m.mean(0)
            want |= {(s, t): v * (mean if options.get("mean_ratio") else 1) for t, v in enumerate(average)}
    assert got == {key: pytest.approx(v, rel=1e-9) for key, v in want.items()}


def test_noise_of_segments_without_reads(spark):
    seg = spark.createDataFrame([(1, 1, 500), (2, 1, 10)], "id long, start long, end long")
    avg = spark.createDataFrame([(1, t, 1.0) for t in range(24)], "id long, t int, value double")
    reads = spark.createDataFrame([(1, 5.0)], "id long, mean double")
    p = spark.createDataFrame([(1, 0.5)], "id long, significant double")
    osc = spark.createDataFrame([(1, 0.001)], "id long, p double")
    got = {r.id: tuple(r)[1:] for r in stats.noise_filters(seg, avg, reads, p, osc).collect()}
    assert got == {1: (False,) * 6, 2: (True,) * 6}


# ---------------------------------------------------------------- tables and formats


def test_permutation_table_round_trip(spark, tmp_path):
    """What is written is what the reader of permutation statistics reads, margins and all."""
    table = QUERIES["permutation_table"](spark, DATA)
    table.coalesce(1).write.option("sep", "\t").option("header", True).option("nullValue", "").option("emptyValue", "").csv(f"{tmp_path}/p")
    cells, margins = readers.read_jaccard(spark, f"{tmp_path}/p")
    p = {(r["query"], r["target"]): r for r in QUERIES["permutation_p_100"](spark, DATA).collect()}
    got = {(r["query"], r["target"]): r for r in cells.collect()}
    assert set(got) == set(p) and all(got[c].p_value == pytest.approx(p[c].p_value, abs=1e-6) and got[c].permutations == 100 for c in p)
    classes = {q for q, _ in p}
    assert sorted((r["query"] or "", r["target"] or "") for r in margins.collect()) == sorted([(c, "") for c in classes] + [("", c) for c in classes])


def test_gff_table_keeps_every_key(spark):
    gff = spark.createDataFrame([(i, f"k{i}={i};all=x") for i in range(1500)], "start int, attributes string")
    table = readers.gff_table(gff)
    assert len(table.columns) == 1502 and table.where("start = 1499").select("k1499", "all").first() == ("1499", "x")
    with pytest.raises(ValueError, match="more than 10 attribute names"):
        readers.gff_table(gff, most=10)


def test_fasta_options(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">sp|P1|NAME first protein \n;note\nAC/GT\n>two, b\nTT\n")
    plain = {r.id: (r.desc, r.seq) for r in readers.read_fasta(spark, f"{tmp_path}/x.fa").collect()}
    assert plain == {"sp|P1|NAME": ("sp|P1|NAME first protein", "ACGT"), "two": ("two, b", "TT")}
    other = {r.id: (r.details, r.seq) for r in readers.read_fasta(spark, f"{tmp_path}/x.fa", comments=False, id_pattern=r"\|(\w+)\|", split_desc=r"\|").collect()}
    assert other["P1"] == (["sp", "P1", "NAME first protein"], ";noteACGT")


def test_probes_options(spark):
    values = spark.createDataFrame([("s", "a", 1.0), ("s", "b", 2.0), ("s", "c", 9.0), ("s", "d", 4.0)], "sample string, probe string, value double")
    platform = spark.createDataFrame([("a", {"g": "x"}), ("b", {"g": "x"}), ("c", {"g": "x"}), ("d", {"g": ""})], "probe string, fields map<string,string>")
    assert {r.feature: r.value for r in readers.summarize_probes(values, platform, "g", "median", keep_empty=True).collect()} == {"x": 2.0, "d": 4.0}


def test_term_names_and_roots(spark):
    parents = spark.createDataFrame([("c", "b"), ("b", "a"), ("z", "y")], "id string, parent string")
    annotation = spark.createDataFrame([(1, "c"), (2, "a"), (3, "q")], "id int, term string")
    closure = readers.ancestors(parents)
    assert {(r.id, r.ancestor) for r in closure.collect()} == {("c", "b"), ("c", "a"), ("b", "a"), ("z", "y")}
    assert {(r.id, r.root) for r in readers.with_roots(annotation, closure).collect()} == {(1, "a"), (2, "a"), (3, "q")}
    terms = spark.createDataFrame([("c", "regulation of process"), ("a", "process")], "id string, name string")
    named = readers.named_terms(annotation, terms, {"regulation": "reg.", "process": "proc."})
    assert {(r.id, r.name) for r in named.collect()} == {(1, "reg. of proc."), (2, "proc."), (3, "q")}


def test_small_functions(spark):
    df = spark.createDataFrame([(1, 0.25, "#102030", [1, 2]), (2, 1.0, "#ffffff", [3])], "id int, p double, colour string, l array<int>")
    r = df.orderBy("id").select(scalar.logit(F.col("p")).alias("logit"), *[c.alias(n) for n, c in zip("xy", scalar.to_xy(F.lit(90.0), F.col("p")))], scalar.p_display(F.col("p"), F.lit(-1)).alias("shown"), scalar.alpha_colour(F.col("colour"), F.col("p")).alias("colour"), stats.symmetric_ratio(F.col("p") * 8).alias("ratio")).collect()
    assert r[0].logit == pytest.approx(math.log(1 / 3)) and r[1].logit is None and (r[0].x, r[0].y) == pytest.approx((0, 0.25), abs=1e-12)
    assert r[0].shown == -2.0 and r[0].colour == "#10203040" and r[0].ratio == 1.5 and r[1].ratio == 2 - 1 / 8
    assert sorted((x.id, x.value) for x in genome.collapse_list(df, "l").collect()) == [(1, 1), (1, 2), (2, 3)]
    assert df.select(series.rescaled(F.lit(2.0), F.lit(3), F.col("p")).alias("v")).collect()[0].v == 2 * 3 / 0.25


def test_annotate_target_options(spark):
    q = spark.createDataFrame([(1, 1, "+", 10, 20, "a"), (2, 1, "+", 90, 99, "b")], "id long, chr int, strand string, start long, end long, type string")
    t = spark.createDataFrame([(7, 1, "+", 10, 20, "gene"), (8, 1, "+", 50, 60, "none")], "id long, chr int, strand string, start long, end long, name string")
    got = intervals.annotate_target(q, t, ["type"], tcols=["name"], prefix="q", details=False)
    assert got.columns == ["q_target", "q_query", "q_type", "name"] and sorted(map(tuple, got.collect())) == [(7, "1", "a", "gene"), (8, "NA", "NA", "none")]
    hits = intervals.annotate(q, t, add_na=True)
    assert intervals.as_target_sees(hits, each_target=True).count() == 2 and [r.qpos for r in intervals.as_target_sees(hits).collect()] == ["inside"]
    lists = spark.createDataFrame([(7, "covers;left", "3;4"), (8, "NA", "0")], "target long, qpos string, qlen string")
    assert [(r.target, r.qpos) for r in intervals.as_target_sees(lists).collect()] == [(7, "inside;right")]


def test_sorted_overlaps_options(spark):
    cells = spark.createDataFrame([("a", "x", 0.5, 1), ("a", "y", 0.001, -1), ("b", "x", 0.002, 1), ("b", "y", 0.9, 1), ("c", "x", 0.7, 1), ("c", "y", 0.6, 1)], "query string, target string, p_value double, sign int")
    places = lambda **o: [r[0] for r in sorted(stats.sorted_overlaps(cells, **o).collect(), key=lambda r: r.place)]
    assert places() == ["b", "a", "c"] and places(cut=True) == ["b", "a"] and places(sign=1) == ["b", "c", "a"] and places(axis="target") == ["y", "x"]
    order = spark.createDataFrame([("y", 1), ("x", 2)], "column string, place int")
    assert places(order=order) == ["a", "b", "c"]
    half = spark.createDataFrame([("a", "b", 0.001, 1), ("a", "c", 0.5, 1), ("b", "c", 0.004, 1)], "query string, target string, p_value double, sign int")
    assert [r.query for r in stats.sorted_overlaps(half, symmetric=True).orderBy("place").collect()] == ["b", "a", "c"]


def test_terms_are_chosen_and_renamed(spark):
    df = spark.createDataFrame([(1, "a;b;;a;c"), (2, "c"), (3, "")], "id int, terms string")
    got = stats.exploded_terms(df, only=["a", "c"], rename={"c": "a"})
    assert sorted(map(tuple, got.collect())) == [(1, "a"), (2, "a")]


def test_clusters_by_phase(spark):
    phases = spark.createDataFrame([(1, 350.0, 1.0), (2, 20.0, 1.0), (3, 200.0, 1.0), (4, 90.0, 2.0)], "id int, phase double, amplitude double")
    assign = spark.createDataFrame([(1, 5), (2, 5), (3, 6), (4, 7)], "id int, cluster int")
    order = series.phase_order(phases, assign)
    assert [r.cluster for r in order.orderBy("place").collect()] == [5, 7, 6]
    assert {(r.id, r.cluster) for r in series.relabelled(assign, order).collect()} == {(1, 1), (2, 1), (3, 3), (4, 2)}
    assert {(r.cluster, r.colour) for r in series.coloured(assign, {5: "#ff0000"}).collect()} == {(5, "#ff0000"), (6, "#888888"), (7, "#888888")}


def test_rows_and_columns_of_position_tables(spark):
    df = spark.createDataFrame([(1, 1, 0.0, 0.0, 5.0), (1, 2, 0.0, None, 0.0), (1, 3, 1.0, 0.0, 0.0)], "chr int, coor long, a double, b double, c double")
    assert {r.coor for r in series.nonzero_rows(df, ["a", "b"]).collect()} == {3} and series.column_range(df, 2, 3).columns == ["chr", "coor", "b", "c"]


def test_csv_to_parquet(spark, tmp_path):
    table = tmp_path / "t.tsv"
    table.write_text("a\tb\n1\t\n2\t3\n")
    writers.csv_to_parquet(spark, str(table), f"{tmp_path}/p", fill=0)
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/p").collect())) == [(1, 0), (2, 3)]


def test_segments_are_written_apart(spark, tmp_path):
    seg = spark.createDataFrame([(1, 1, 5, 9), (2, 1, 20, 30)], "id long, chr int, start long, end long")
    data = spark.createDataFrame([(1, 5, 1.5), (1, 9, 2.5), (1, 25, 3.5), (1, 40, 4.5)], "chr int, coor long, v double")
    writers.write_segments(seg, data, f"{tmp_path}/s")
    got = spark.read.option("sep", "\t").option("header", True).option("inferSchema", True).csv(f"{tmp_path}/s")
    assert sorted((r.segment, r.q_v) for r in got.collect()) == [(1, 1.5), (1, 2.5), (2, 3.5)]


def test_medoids_of_many_rows(spark):
    """Over 5,000 rows, many of them equal: the clusters' members of least sums are the medoids that rows are with."""
    df = spark.range(5200).select("id", ((F.col("id") * 7919) % 997).cast("double").alias("a"), ((F.col("id") * 31) % 89).cast("double").alias("b"))
    own = {r.id: r.cluster for r in series.medoids(df, 3, ["a", "b"]).collect()}
    x = np.array([[(i * 7919) % 997 / 996, (i * 31) % 89 / 88] for i in range(5200)])
    label = np.array([own[i] for i in range(5200)])
    assert set(label.tolist()) == {0, 1, 2}
    apart = lambda y, z: np.sqrt(((y[:, None] - z[None]) ** 2).sum(2))
    medoids = np.array([x[label == c][apart(x[label == c], x[label == c]).sum(1).argmin()] for c in range(3)])
    assert (apart(x, medoids).argmin(1) == label).all()


def test_a_round_of_clustering_is_one_job(spark, monkeypatch):
    """Lloyd rounds of all starts are one job each, and read kept blocks; ties and rows without a vector go as the plain loop has it."""
    rounds, plain = [], series._rounds
    monkeypatch.setattr(series, "_rounds", lambda *a, **b: rounds.append(1) or plain(*a, **b))
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(400, 3)), 1)
    df = spark.createDataFrame([(i, i % 5, v.tolist()) for i, v in enumerate(x)] + [(400, 1, None)], "vec_id long, label int, embedding array<double>").repartition(3).persist()
    df.count()
    spark.sparkContext.setJobGroup("rounds", "rounds")
    got = series.recluster(df)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("rounds"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(rounds) > 3 and jobs <= len(rounds) + 4
    own, before = np.arange(400) % 5, None
    centres = np.array([x[own == c].mean(0) for c in range(5)])
    while before is None or (own != before).any():
        before, own = own, np.round(((x[:, None] - centres[None]) ** 2).sum(2), 9).argmin(1)
        centres = np.array([x[own == c].mean(0) if (own == c).any() else centres[c] for c in range(5)])
    assert {r.vec_id: r.cluster for r in got.collect()} == {**dict(enumerate(own.tolist())), 400: None}
