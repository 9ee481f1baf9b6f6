"""Series: moving windows, Fourier components, phases, presegmentation, clustering of profiles."""

from __future__ import annotations

import heapq
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions.scalar import degrees_of


def moving_average(df: DataFrame, n: int, by: list[str], order: str, value: str, circular: bool = False) -> DataFrame:
    """Column `ma`: centred mean of n values; even n look one further ahead. Ends without a full window are null, or wrap."""
    n = int(n)
    before, after = n - 1 - n // 2, n // 2
    if not circular:
        w = Window.partitionBy(*by).orderBy(order).rowsBetween(-before, after)
        return df.withColumn("ma", F.when(F.count(F.lit(1)).over(w) == n, F.avg(value).over(w)))
    size = F.count(F.lit(1)).over(Window.partitionBy(*by))
    numbered = df.withColumns({"__n": size, "__k": F.row_number().over(Window.partitionBy(*by).orderBy(order))})
    turns = numbered.withColumn("__turn", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).withColumn("__at", F.col("__k") + F.col("__turn") * F.col("__n"))
    turns = turns.where((F.col("__at") > -n) & (F.col("__at") <= F.col("__n") + n))
    w = Window.partitionBy(*by).orderBy("__at").rowsBetween(-before, after)
    return turns.withColumn("ma", F.avg(value).over(w)).where("__turn = 0").drop("__n", "__k", "__turn", "__at")


def running_median(df: DataFrame, k: int, by: list[str], order: str, value: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-(k // 2), k // 2)
    return df.withColumn("median", F.percentile(value, F.lit(0.5)).over(w))


def dft(df: DataFrame, components: int | None = None, by: str = "id", t: str = "t", value: str = "y") -> DataFrame:
    """(id, k, re, im, n): unscaled Fourier components 0.. of series (id, t = 0..n-1, y)."""
    n = F.count("*").over(Window.partitionBy(by))
    rows = df.select(by, F.col(t).alias("__t"), F.col(value).alias("__y"), n.alias("n"))
    top = F.floor(F.col("n") / 2) if components is None else F.least(F.lit(components), F.floor(F.col("n") / 2))
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), top)))
    angle = 2 * np.pi * F.col("k") * F.col("__t") / F.col("n")
    return rows.groupBy(by, "k", "n").agg(F.sum(F.col("__y") * F.cos(angle)).alias("re"), (-F.sum(F.col("__y") * F.sin(angle))).alias("im"))


def phases(components: DataFrame) -> DataFrame:
    """Amplitude and phase (degrees in (0, 360], 360 or 0 for a peak at time 0)."""
    return components.where("k > 0").select("*", F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("amplitude"), degrees_of(F.col("re"), F.col("im")).alias("phase"))


def signal_to_noise(components: DataFrame, by: str = "id") -> DataFrame:
    """Amplitude over the mean of the other amplitudes (without component 0), and over component 0."""
    a = components.withColumn("a", F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")))
    w = Window.partitionBy(by)
    total, n = F.sum(F.when(F.col("k") > 0, F.col("a"))).over(w), F.count(F.when(F.col("k") > 0, 1)).over(w)
    zero = F.max(F.when(F.col("k") == 0, F.col("a"))).over(w)
    out = a.withColumns({"snr": F.try_divide(F.col("a"), F.try_divide(total - F.col("a"), n - 1)), "scaled": F.try_divide(F.col("a"), zero)})
    return out.where("k > 0")


def dft_permutation_p(df: DataFrame, permutations: int = 100, seed: int = 1) -> DataFrame:
    """(id, k, p_value): share of column permutations with an amplitude of at least the real one.

    Each permutation is one order of the columns for all series. It comes from the seed and its number only, so every
    task makes the same; the table of orders has permutations x columns entries.
    """

    def run(batches):
        for pdf in batches:
            y = np.stack(pdf["y"].to_numpy())
            real = np.abs(np.fft.rfft(y, axis=1))
            more = np.zeros(real.shape)
            for r in range(permutations):
                more += np.abs(np.fft.rfft(y[:, np.random.default_rng([seed, r]).permutation(y.shape[1])], axis=1)) >= real - 1e-9
            k = np.arange(real.shape[1])
            yield pd.DataFrame({"id": np.repeat(pdf["id"].to_numpy(), len(k)), "k": np.tile(k, len(pdf)), "p_value": (more / permutations).ravel()})

    wide = df.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "y"))), lambda x: x["y"]).alias("y"))
    return wide.mapInPandas(run, f"id {df.schema['id'].dataType.simpleString()}, k long, p_value double")


def sliding_dft(df: DataFrame, window: int, by: list[str], order: str, value: str, components: list[int] | None = None, periods: tuple[float, float] | None = None) -> DataFrame:
    """Amplitudes of some components in each full window ahead of a position, scaled by the window.

    Without components all of 0 .. window / 2. periods: only components whose period, window / k, lies within (0 has none).
    """
    components = list(range(window // 2 + 1)) if components is None else components
    if periods:
        components = [k for k in components if k and periods[0] <= window / k <= periods[1]]
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(0, window - 1)
    rows = df.withColumn("__w", F.collect_list(value).over(w)).where(F.size("__w") == window)
    rows = rows.withColumn("k", F.explode(F.array(*map(F.lit, components))))
    part = lambda f: F.aggregate(F.transform("__w", lambda y, i: y * f(2 * np.pi * F.col("k") * i / window)), F.lit(0.0), lambda a, x: a + x)
    rows = rows.withColumns({"re": part(F.cos), "im": part(F.sin)})
    return rows.select(*by, order, "k", (F.sqrt(F.col("re") ** 2 + F.col("im") ** 2) / window).alias("amplitude"))


def zscore(df: DataFrame, by: str = "id", value: str = "y") -> DataFrame:
    w = Window.partitionBy(by)
    return df.withColumn("z", F.try_divide(F.col(value) - F.avg(value).over(w), F.stddev_samp(value).over(w)))


#: A row-wise scaling by mean and standard deviation goes by this name, too.
meanzero = zscore


def log_ratio(df: DataFrame, by: str = "id", value: str = "y") -> DataFrame:
    """log2 of value over the row mean; what is not finite is null."""
    r = F.try_divide(F.col(value), F.avg(value).over(Window.partitionBy(by)))
    return df.withColumn("lr", F.when(r > 0, F.log2(r)))


def spectrum_peak(components: DataFrame, low: int, high: int) -> DataFrame:
    """The component of greatest amplitude within a range."""
    a = components.where(F.col("k").between(low, high)).withColumn("a", F.round(F.sqrt(F.col("re") ** 2 + F.col("im") ** 2), 6))
    return a.groupBy("id").agg(F.max(F.struct("a", -F.col("k"))).alias("m")).select("id", F.col("m.a").alias("amplitude"), (-F.col("m").getField("col2")).alias("k"))


def expressed_runs(signal: DataFrame, length: int, avg: int, min_reads: float, keys: tuple[str, ...] = ("chr",)) -> DataFrame:
    """Primary segments: runs of positions whose circular moving average of the count of time points with reads is over min_reads.

    signal: (keys, coor, t, reads), sparse; positions 1..length of each key are filled with 0. Edges of chromosomes don't count.
    """
    n = signal.where("reads > 0").groupBy(*keys, "coor").agg(F.countDistinct("t").alias("n"))
    spine = signal.select(*keys).distinct().withColumn("coor", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(length).cast("long"))))
    full = spine.join(n, [*keys, "coor"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    smooth = moving_average(full, avg, list(keys), "coor", "n", circular=True)
    on = smooth.where((F.col("ma") > min_reads) & F.col("coor").between(2, length - 1))
    from loomspan.operators.intervals import position_runs

    return position_runs(on, keys)


def fused_runs(runs: DataFrame, min_gap: int, min_length: int, keys: tuple[str, ...] = ("chr",)) -> DataFrame:
    """Runs closer than min_gap are one; what then spans less than min_length goes."""
    w = Window.partitionBy(*keys).orderBy("start")
    new = F.when(F.col("start") - F.lag("end").over(w) < min_gap, 0).otherwise(1)
    out = runs.withColumn("__new", new).withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.groupBy(*keys, "__run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("__run").where(F.col("end") - F.col("start") >= min_length)


def greedy_fusion(runs: DataFrame, min_segment: int, keys: tuple[str, ...] = ("chr",)) -> DataFrame:
    """The shortest segment under min_segment joins its shorter neighbour, again and again: a heap over a linked list.

    Of equal lengths the leftmost is first, of equal neighbours the left one is taken. One key's segments are one group.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        s = pdf.sort_values("start")[["start", "end"]].to_numpy().tolist()
        n = len(s)
        before, after, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
        heap = [(b - a, a, i) for i, (a, b) in enumerate(s)]
        heapq.heapify(heap)
        left = n
        while left > 1:
            size, at, i = heapq.heappop(heap)
            if not alive[i] or s[i] != [at, at + size]:
                continue  # it has grown or gone since
            if size >= min_segment:
                break
            p, q = before[i], after[i]
            j = q if p < 0 or (q < n and s[q][1] - s[q][0] < s[p][1] - s[p][0]) else p
            a, b = min(i, j), max(i, j)
            s[a] = [s[a][0], s[b][1]]
            alive[b], after[a], left = False, after[b], left - 1
            if after[b] < n:
                before[after[b]] = a
            heapq.heappush(heap, (s[a][1] - s[a][0], s[a][0], a))
        out = pd.DataFrame([x for x, ok in zip(s, alive) if ok], columns=["start", "end"])
        return out.assign(**{k: pdf[k].iloc[0] for k in keys})[[*keys, "start", "end"]]

    kinds = ", ".join(f"{k} {runs.schema[k].dataType.simpleString()}" for k in keys)
    return runs.groupBy(*keys).applyInPandas(run, f"{kinds}, start long, end long")


def presegment_summary(segments: DataFrame, signal: DataFrame) -> DataFrame:
    """(id, length, covered, points, reads) of segments (id, chr, start, end): positions with reads, (position, time) points with
    reads, and all reads of signal (chr, coor, t, reads)."""
    from loomspan.operators.intervals import points_in

    held = points_in(signal.where("reads > 0"), segments.select("id", "chr", "start", "end"))
    sums = held.groupBy(F.col("t_id").alias("id")).agg(F.countDistinct("q_coor").alias("covered"), F.count("*").alias("points"), F.sum("q_reads").alias("reads"))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("covered", "points", "reads")}
    return segments.select("id", (F.col("end") - F.col("start") + 1).alias("length")).join(sums, "id", "left").withColumns(zero)


def track_spectrum(df: DataFrame, components: list[int], by: list[str], order: str, value: str) -> DataFrame:
    """(by, k, period, amplitude): components of whole tracks (positions 1..n), amplitude over n, period n / k.

    One pass: each component is two sums over the rows, so a track may be as long as it likes.
    """
    n = df.groupBy(*by).agg(F.count("*").alias("n"))
    rows = df.join(F.broadcast(n), by) if by else df.crossJoin(F.broadcast(n))  # a row for each track
    angle = lambda k: 2 * np.pi * k * (F.col(order) - 1) / F.col("n")
    parts = [f(F.col(value) * g(angle(k))).alias(f"{name}{k}") for k in components for name, f, g in (("re", F.sum, F.cos), ("im", F.sum, F.sin))]
    sums = rows.groupBy(*by, "n").agg(*parts)
    each = F.array(*[F.struct(F.lit(k).alias("k"), (F.sqrt(F.col(f"re{k}") ** 2 + F.col(f"im{k}") ** 2) / F.col("n")).alias("amplitude")) for k in components])
    return sums.select(*by, "n", F.explode(each).alias("c")).select(*by, "c.k", F.try_divide(F.col("n"), F.col("c.k")).alias("period"), "c.amplitude")


def class_means(df: DataFrame, cluster: str, vector: str) -> DataFrame:
    """(cluster, dim, value): centres of vectors."""
    return df.select(cluster, F.posexplode(vector).alias("dim", "v")).groupBy(cluster, "dim").agg(F.avg("v").alias("value"))


def _centres(df: DataFrame, cluster: str, vector: str) -> DataFrame:
    """One row: `centres`, an array of (centre, c). Centres are few: clusters x dimensions."""
    one = class_means(df, cluster, vector).groupBy(F.col(cluster).alias("centre")).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "value"))), lambda x: x["value"]).alias("c"))
    return one.agg(F.array_sort(F.collect_list(F.struct("centre", "c"))).alias("centres"))


def recluster_step(df: DataFrame, cluster: str = "label", vector: str = "embedding", id_: str = "vec_id") -> DataFrame:
    """One Lloyd step from the clusters' own centres: (id, cluster) of the nearest. Rows stay where they are and see all centres."""
    sums = lambda c: F.aggregate(F.zip_with(vector, c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    best = F.array_min(F.transform("centres", lambda x: F.struct(F.round(sums(x["c"]), 9).alias("d"), x["centre"].alias("centre"))))
    return df.crossJoin(F.broadcast(_centres(df, cluster, vector))).select(id_, best["centre"].alias("cluster"))  # one row


def _vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors are there, and their rows; missing elements are NaN."""
    there = column.is_valid().to_numpy(zero_copy_only=False)
    n = int(there.sum())
    flat = column.drop_null().flatten().to_numpy(zero_copy_only=False).astype(float)
    return there, flat.reshape(n, -1) if n else np.empty((0, 0))


def _nearest(x: np.ndarray, table: np.ndarray, digits: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The first nearest centre of each row, and the squared distance. Products tell most; where two centres are as near as
    rounding, differences do, rounded to `digits` if given."""
    far = (x * x).sum(1)[:, None] + (table * table).sum(1)[None] - 2 * (x @ table.T)
    own = far.argmin(1)
    rows = np.arange(len(x))
    slack = 1e-8 * (1 + (x * x).sum(1) + (table * table).sum(1).max())
    close = np.flatnonzero((far <= (far[rows, own] + slack)[:, None]).sum(1) > 1)
    for at in range(0, len(close), 4096):
        i = close[at : at + 4096]
        d = np.stack([((x[i] - c) ** 2).sum(1) for c in table], 1)
        own[i] = (d if digits is None else np.round(d, digits)).argmin(1)
    return own, far[rows, own]


def _packed(rows: DataFrame, own: list, size: int = 4096) -> DataFrame:
    """Kept blocks of rows (own, v) as bytes, which rounds read without making rows again: numbers of labels, vectors, their length,
    and whether elements are missing. Rows without a vector go."""
    kind = np.float32 if rows.dtypes[1][1] == "array<float>" else np.float64
    place = {k: i for i, k in enumerate(own)}

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                there, x = _vectors(part.column(1))
                if len(x):
                    given = np.array([place.get(k, -1) for k in part.column(0).filter(pa.array(there)).to_pylist()], np.int32)
                    gaps = part.column(1).drop_null().flatten().null_count > 0
                    yield pa.RecordBatch.from_pydict({"o": [given.tobytes()], "v": [x.astype(kind).tobytes()], "g": [gaps]})

    # the blocks of few large files go to all cores
    return rows.mapInArrow(run, "o binary, v binary, g boolean").repartition(rows.sparkSession.sparkContext.defaultParallelism).persist()


def _rounds(rows: DataFrame, kind: type, models: list[tuple[np.ndarray | None, np.ndarray | None]], digits: int | None = None, own: int = 0) -> list[tuple[np.ndarray, np.ndarray, int, float]]:
    """One pass over _packed() rows for several models (centres, the centres before): of each, sums and counts of the elements by
    centre, how many rows the centres before gave to another one, and the sum of squared distances.

    Without centres, rows are with their own label (of `own` ones); so they are before the first centres. A partition gives back a row
    for each model.
    """

    def run(batches):
        out: list = [None] * len(models)
        for batch in batches:
            for o, v, gaps in zip(*(c.to_pylist() for c in batch.columns)):
                given = np.frombuffer(o, np.int32)
                x = np.frombuffer(v, kind).reshape(len(given), -1).astype(float)
                full = np.where(np.isnan(x), 0.0, x) if gaps else x
                for i, (table, before) in enumerate(models):
                    now, d = (given, np.zeros(len(x))) if table is None else _nearest(x, table, digits)
                    was = now if not own else given if before is None else _nearest(x, before, digits)[0]
                    hot = (now[:, None] == np.arange(own if table is None else len(table))).astype(float)
                    new = [hot.T @ full, hot.T @ (~np.isnan(x)).astype(float) if gaps else np.repeat(hot.sum(0)[:, None], x.shape[1], 1), int((now != was).sum()), float(d.sum())]
                    out[i] = new if out[i] is None else [p + q for p, q in zip(out[i], new)]
        for i, got in enumerate(out):
            if got is not None:
                yield pa.RecordBatch.from_pydict({"i": [i], "s": [got[0].ravel()], "n": [got[1].ravel()], "m": [got[2]], "d": [got[3]]}, pa.schema([("i", pa.int32()), ("s", pa.list_(pa.float64())), ("n", pa.list_(pa.float64())), ("m", pa.int64()), ("d", pa.float64())]))

    total: list = [None] * len(models)
    got = rows.mapInArrow(run, "i int, s array<double>, n array<double>, m long, d double").collect()
    for r in sorted(got, key=lambda r: (r.i, r.d, r.s)):  # in an order of their own: sums are the same each time
        new = [np.array(r.s), np.array(r.n), r.m, r.d]
        total[r.i] = new if total[r.i] is None else [p + q for p, q in zip(total[r.i], new)]
    size = [own if table is None else len(table) for table, _ in models]
    return [(t[0].reshape(k, -1), t[1].reshape(k, -1), t[2], t[3]) if t is not None else (np.empty((k, 0)), np.empty((k, 0)), 0, 0.0) for t, k in zip(total, size)]


def recluster(df: DataFrame, cluster: str = "label", vector: str = "embedding", id_: str = "vec_id") -> DataFrame:
    """(id, cluster): k-means from the clusters' own centres until no row moves. A centre that loses its last row stays where it is.

    Each round is one job over kept rows with the centres of two rounds; a partition gives back sums, clusters x dimensions.
    """
    rows = df.select(F.col(cluster).alias("__own"), F.col(vector).alias("__v"))
    kind, real = df.schema[cluster].dataType.simpleString(), np.float32 if df.schema[vector].dataType.simpleString() == "array<float>" else np.float64
    labels = sorted(r[0] for r in rows.where("__own is not null and __v is not null").select("__own").distinct().collect())
    mean = lambda s, n: np.divide(s, n, out=np.full(s.shape, np.nan), where=n > 0)
    kept = _packed(rows, labels)
    centres = mean(*_rounds(kept, real, [(None, None)], own=len(labels))[0][:2]) if labels else np.empty((0, 0))
    before = None
    while labels:
        s, n, moved, _ = _rounds(kept, real, [(centres, before)], 9, len(labels))[0]
        if not moved:
            break
        before, centres = centres, np.where(n > 0, mean(s, n), centres)
    kept.unpersist()

    def best(v: pd.Series) -> pd.Series:
        out, there = pd.Series([None] * len(v), dtype=object), v.notna().to_numpy()
        if there.any() and labels:
            out[there] = [labels[i] for i in _nearest(np.stack(v[there].to_numpy()).astype(float), centres, 9)[0]]
        return out

    best.__annotations__ = {"v": pd.Series, "return": pd.Series}
    return df.select(id_, F.pandas_udf(best, kind)(vector).alias("cluster"))


def centre_correlation(df: DataFrame, cluster: str = "label", vector: str = "embedding", id_: str = "vec_id") -> DataFrame:
    """Pearson correlation of each row with each centre. Rows stay where they are and see all centres."""
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    shifted = lambda v: F.transform(v, lambda x: x - F.try_divide(total(v), F.size(v)))
    own = df.select(id_, F.transform(vector, lambda x: x.cast("double")).alias("__v")).select(id_, F.col("__v"), F.try_divide(total(F.col("__v")), F.size("__v")).alias("__m"))
    own = own.select(id_, F.zip_with("__v", F.array_repeat("__m", F.size("__v")), lambda x, m: x - m).alias("__v"))
    centres = _centres(df, cluster, vector).select(F.transform("centres", lambda x: F.struct(x["centre"].alias("centre"), shifted(x["c"]).alias("c"))).alias("centres"))
    rows = own.crossJoin(F.broadcast(centres)).select(id_, "__v", F.explode("centres").alias("x"))  # one row
    dot = lambda a, b: total(F.zip_with(a, b, lambda p, q: p * q))
    r = F.try_divide(dot(F.col("__v"), F.col("x.c")), F.sqrt(dot(F.col("__v"), F.col("__v")) * dot(F.col("x.c"), F.col("x.c"))))
    return rows.select(id_, F.col("x.centre").alias("centre"), r.alias("r"))


def _assigned(centres: np.ndarray):
    """A pandas UDF: the number of a vector's nearest centre."""

    def best(v: pd.Series) -> pd.Series:
        return pd.Series(_nearest(np.stack(v.to_numpy()).astype(float), centres)[0]) if len(v) else pd.Series([], dtype=int)

    best.__annotations__ = {"v": pd.Series, "return": pd.Series}
    return F.pandas_udf(best, "int")


def kmeans(df: DataFrame, ks: list[int], vector: str = "features", seed: int = 1, starts: int = 3, max_iter: int = 1000, tol: float = 1e-4) -> tuple[DataFrame, DataFrame]:
    """(assignments: id, k, cluster; model: k, sse, bic): k-means models with their Gaussian BIC, each the best of some starts.

    Spark's k-means|| makes the first centres. Rounds of all models that still move are one job; a model ends when no centre
    moves by more than tol, with the squared distances to the centres before that last move, as Spark's does.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = df.select("id", F.col(vector).cast("array<double>").alias("features")).persist()
    n = data.count()
    dim = len(data.first()["features"]) if n else 0
    rows, first = _packed(data.select(F.lit(None).cast("int").alias("__own"), "features"), []), data.select(array_to_vector("features").alias("features"))
    fits = {(k, i): [np.array(KMeans(k=k, seed=seed + i, maxIter=0, tol=tol, featuresCol="features").fit(first).clusterCenters()), 0.0] for k in ks for i in range(starts)}
    moving = list(fits)
    for _ in range(max_iter):
        if not moving:
            break
        got = _rounds(rows, np.float64, [(fits[m][0], None) for m in moving])
        still = []
        for m, (s, c, _, sse) in zip(moving, got):
            new = np.where(c > 0, np.divide(s, c, out=np.zeros_like(s), where=c > 0), fits[m][0])
            if (((new - fits[m][0]) ** 2).sum(1) > tol * tol).any():
                still.append(m)
            fits[m] = [new, sse]
        moving = still
    rows.unpersist()
    parts, model = None, []
    for k in ks:
        centres, sse = min((fits[k, i] for i in range(starts)), key=lambda m: m[1])

        got = data.select("id", F.lit(k).alias("k"), _assigned(centres)("features").alias("cluster"))
        parts = got if parts is None else parts.unionAll(got)
        model.append((k, sse, n * dim * np.log(max(sse, 1e-300) / (n * dim)) + k * (dim + 1) * np.log(n)))
    return parts, df.sparkSession.createDataFrame([(k, s, float(b)) for k, s, b in model], "k int, sse double, bic double")


def nuisance(assign: DataFrame, correlation: DataFrame, least: float) -> DataFrame:
    """(id, cluster) with cluster 0 for rows that correlate with no centre by more than `least`; correlation: (id, centre, r)."""
    best = correlation.groupBy("id").agg(F.max("r").alias("r"))
    return assign.join(best, "id", "left").withColumn("cluster", F.when(F.coalesce(F.col("r") <= least, F.lit(True)), 0).otherwise(F.col("cluster"))).drop("r")


def selected(assign: DataFrame, model: DataFrame, k: int | str | None = None, criterion: str = "bic") -> DataFrame:
    """Assignments of one k: a number, a name such as 'K:8', or the model's best."""
    if k is None:
        return assign.join(F.broadcast(selected_model(model, criterion)), "k", "left_semi")  # one row
    return assign.where(F.col("k") == int(str(k).rpartition(":")[2]))


def sets_by_size(df: DataFrame, name: str) -> DataFrame:
    """(name, count, place): sets from the largest to the smallest, equal ones by name. There are few sets."""
    n = df.groupBy(name).agg(F.count("*").alias("count"))
    return n.withColumn("place", F.row_number().over(Window.orderBy(F.col("count").desc(), name)).cast("long"))


def nonzero_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with some value that is neither 0 nor missing in the columns."""
    some = F.lit(False)
    for c in columns:
        some = some | F.coalesce(F.col(c) != 0, F.lit(False))
    return df.where(some)


def column_range(df: DataFrame, first: int, last: int, keys: tuple[str, ...] = ("chr", "coor")) -> DataFrame:
    """The keys and data columns number first..last (from 1)."""
    data = [c for c in df.columns if c not in keys]
    return df.select(*keys, *data[first - 1 : last])


def selected_model(model: DataFrame, criterion: str = "bic") -> DataFrame:
    """The k of the best criterion (least BIC), the smaller of equals."""
    return model.agg(F.min(F.struct(criterion, "k")).alias("m")).select("m.k")


def relabelled(assign: DataFrame, order: DataFrame) -> DataFrame:
    """Clusters renumbered 1.. in the order of (cluster, place)."""
    n = order.select("cluster", F.row_number().over(Window.orderBy("place", "cluster")).alias("number"))
    return assign.join(n, "cluster").drop("cluster").withColumnRenamed("number", "cluster")


def phase_order(phases_: DataFrame, assign: DataFrame, phase: str = "phase", weight: str | None = "amplitude") -> DataFrame:
    """(cluster, place): clusters by the circular mean of their rows' phases; phases_: (id, phase, weight), assign: (id, cluster)."""
    from loomspan.operators.stats import phase_dist

    means = phase_dist(phases_.join(assign.select("id", "cluster"), "id"), ["cluster"], phase, weight)
    return means.select("cluster", F.row_number().over(Window.orderBy(F.col("mean_phase").asc_nulls_last(), "cluster")).cast("long").alias("place"))


def coloured(assign: DataFrame, colours: dict, other: str = "#888888") -> DataFrame:
    """assign with each cluster's colour."""
    pairs = [F.lit(x) for k, v in colours.items() for x in (str(k), v)]
    found = F.element_at(F.create_map(*pairs), F.col("cluster").cast("string")) if pairs else F.lit(None)
    return assign.withColumn("colour", F.coalesce(found, F.lit(other)))


def circular_density(df: DataFrame, value: str, bandwidth: float, points: int = 64) -> DataFrame:
    """Gaussian density of angles (degrees) on a grid, with the values one turn away on either side. Values are counted first."""
    n = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("c"))
    grid = n.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("x", F.col("g") * 360.0 / points)
    turn = sum((F.exp(-((F.col("x") - F.col("v") + o) ** 2) / (2 * bandwidth**2)) for o in (-360.0, 0.0, 360.0)), F.lit(0.0))
    return grid.groupBy("g", "x").agg((F.sum(F.col("c") * turn) / (F.sum("c") * bandwidth * np.sqrt(2 * np.pi))).alias("density"))


def trends(x: list, y: list, min_n: int = 4, tolerance: float = 0.05) -> list[str]:
    """What the slope of each series does; series of one length are fitted together by a cubic in x scaled to -1..1."""
    out, groups = ["nodata"] * len(x), {}
    for i, (a, b) in enumerate(zip(x, y)):
        a, b = (np.asarray([] if v is None else v, float) for v in (a, b))
        ok = np.isfinite(a) & np.isfinite(b)
        if ok.sum() > min_n:
            groups.setdefault(int(ok.sum()), []).append((i, a[ok], b[ok]))
    for n, rows in groups.items():
        a, b = np.stack([r[1] for r in rows]), np.stack([r[2] for r in rows])
        lo, hi = a.min(1, keepdims=True), a.max(1, keepdims=True)
        z = 2 * (a - lo) / np.maximum(hi - lo, 1e-300) - 1
        powers = z[:, :, None] ** np.arange(min(3, n - 1) + 1)
        fit = np.matmul(np.linalg.pinv(powers), b[:, :, None])[:, :, 0]
        grid = np.linspace(-1, 1, 50)[:, None] ** np.arange(fit.shape[1] - 1)
        slope = 2 * (fit[:, 1:] * np.arange(1, fit.shape[1])) @ grid.T  # over the whole range of x
        sign = np.where(np.abs(slope) <= tolerance * np.maximum(np.ptp(b, axis=1), 1e-12)[:, None], 0, np.sign(slope)).astype(int)
        for (i, _, _), s in zip(rows, sign):
            s = s[s != 0]
            turns = tuple(s[np.concatenate([[True], s[1:] != s[:-1]])].tolist()) if len(s) else ()
            out[i] = {(): "flat", (1,): "increasing", (-1,): "decreasing", (1, -1): "peak", (-1, 1): "trough"}.get(turns, "complex")
    return out


def trend_class(min_n: int = 4, tolerance: float = 0.05):
    """A pandas UDF for (x, y) arrays: increasing, decreasing, flat, peak, trough, complex or nodata, from a smoothed slope."""

    @F.pandas_udf("string")
    def classify(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(trends(list(x), list(y), min_n, tolerance), x.index)

    return classify


def strand_rows(df: DataFrame, forward: list[str], reverse: list[str], names: list[str]) -> DataFrame:
    """Forward and reverse columns to one row a strand."""
    kept = [c for c in df.columns if c not in (*forward, *reverse)]
    both = F.array(*[F.struct(F.lit(s).alias("strand"), *[F.col(c).alias(n) for c, n in zip(cols, names)]) for s, cols in (("+", forward), ("-", reverse))])
    return df.select(*kept, F.explode(both).alias("__r")).select(*kept, "__r.*")


def rescaled(avg: Column, count: Column, least_positive: Column) -> Column:
    """Amounts from log2 cycles: avg * count * 2**-log2(least positive)."""
    return avg * count * F.pow(F.lit(2.0), -F.log2(least_positive))


def loess_normalised(df: DataFrame, reference: DataFrame | None = None, bins: int = 200, span: float = 0.3, max_columns: int = 4096) -> DataFrame:
    """(id, column, value, normalised) from long (id, column, value). More than max_columns columns are an error.

    Each column's values are fitted as a smooth function of the rows' medians (over `reference` ids, if given), and
    values are read back through its inverse. Fits use the means of at most `bins` bins a column, so no task holds a column.
    """
    medians = df.groupBy("id").agg(F.median("value").alias("x"))
    used = medians if reference is None else medians.join(reference.select("id"), "id", "left_semi")
    ends = used.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    points = df.join(used, "id").crossJoin(ends)  # one row
    slot = F.least(F.lit(bins - 1), F.floor(F.coalesce(F.try_divide(F.col("x") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0)) * bins))
    means = points.groupBy("column", slot.alias("slot")).agg(F.count("*").alias("n"), F.avg("x").alias("x"), F.avg("value").alias("y"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values("x")
        x, y, n = (p[c].to_numpy(float) for c in ("x", "y", "n"))
        k = max(min(len(x), 4), int(np.ceil(span * len(x))))
        smooth = np.empty(len(x))
        for i, at in enumerate(x):
            d = np.abs(x - at)
            h = max(np.sort(d)[k - 1], 1e-12)
            w = n * np.clip(1 - (d / h) ** 3, 0, None) ** 3
            degree = min(2, int((w > 0).sum()) - 1)
            smooth[i] = np.polynomial.polynomial.polyval(0.0, np.polynomial.polynomial.polyfit(x - at, y, degree, w=np.sqrt(w))) if degree > 0 else y[i]
        return pd.DataFrame({"column": [pdf["column"].iloc[0]], "xs": [x], "ys": [np.maximum.accumulate(smooth)]})

    curves = means.groupBy("column").applyInPandas(fit, f"column {df.schema['column'].dataType.simpleString()}, xs array<double>, ys array<double>")
    rows = curves.limit(max_columns + 1).collect()
    if len(rows) > max_columns:
        raise ValueError(f"more than {max_columns} columns")
    shared = df.sparkSession.sparkContext.broadcast({r["column"]: (np.array(r["xs"]), np.array(r["ys"])) for r in rows})  # at most max_columns x 2 x bins numbers

    def back(column: pd.Series, value: pd.Series) -> pd.Series:
        out = np.full(len(value), np.nan)
        for name, at in value.groupby(column).indices.items():
            xs, ys = shared.value[name]
            v = value.to_numpy(float)[at]
            out[at] = np.where(np.isnan(v), np.nan, np.interp(v, ys, xs))
        return pd.Series(out, value.index)

    back.__annotations__ = {"column": pd.Series, "value": pd.Series, "return": pd.Series}
    return df.select("id", "column", "value", F.pandas_udf(back, "double")("column", "value").alias("normalised"))


def density_grid(df: DataFrame, x: str, y: str, n: int = 128, bandwidth: float = 2.0, circular: bool = False) -> DataFrame:
    """(i, j, density, level): counts on an n x n grid, smoothed by a Gaussian of `bandwidth` cells, in 256 levels.

    The grid is all that is gathered. With circular, the x axis wraps.
    """
    ends = df.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    cell = lambda c, a, b: F.least(F.lit(n - 1), F.floor(F.coalesce(F.try_divide(F.col(c) - F.col(a), F.col(b) - F.col(a)), F.lit(0.0)) * n)).cast("int")
    counts = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).crossJoin(ends).groupBy(cell(x, "x0", "x1").alias("i"), cell(y, "y0", "y1").alias("j")).agg(F.count("*").alias("c"))

    def smooth(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = np.zeros((n, n))
        grid[pdf["i"], pdf["j"]] = pdf["c"]
        reach = int(np.ceil(4 * bandwidth))
        kernel = np.exp(-np.arange(-reach, reach + 1) ** 2 / (2 * bandwidth**2))
        kernel /= kernel.sum()
        for axis in (0, 1):
            edge = [(reach, reach) if a == axis else (0, 0) for a in (0, 1)]
            wide = np.pad(grid, edge, mode="wrap" if circular and axis == 0 else "constant")
            grid = np.apply_along_axis(lambda v: np.convolve(v, kernel, "valid"), axis, wide)
        i, j = np.indices(grid.shape)
        level = np.floor(255 * grid / max(grid.max(), 1e-300))
        return pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "density": grid.ravel() / max(grid.sum(), 1e-300), "level": level.ravel().astype(int)})

    return counts.groupBy(F.lit(1).alias("all")).applyInPandas(smooth, "i int, j int, density double, level int")


def medoids(df: DataFrame, k: int, columns: list[str], seed: int = 1, rounds: int = 1000, most: int | None = None) -> DataFrame:
    """(id, cluster): k-medoids of min-max scaled columns, until no medoid moves. With `most`, more rows than that are an error.

    Rows stay in their partitions, and no matrix of distances is made: a row's sum of distances is convex in its place, so the
    sum and slope at one place bound it everywhere from below. Rows whose bound is beyond the least sum so far can't be the
    medoid; of the others some are summed up, which makes new bounds, until none is left. So the medoids are exact. Of equal
    sums the least id's is taken. Jobs give back at most 64 places of each cluster and partition.
    """
    if most is not None and df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows")
    dim, some = len(columns), 64
    ends = df.agg(*[F.min(c).alias(f"lo_{c}") for c in columns], *[F.max(c).alias(f"hi_{c}") for c in columns])
    unit = [F.coalesce(F.try_divide(F.col(c) - F.col(f"lo_{c}"), F.col(f"hi_{c}") - F.col(f"lo_{c}")).cast("double"), F.lit(0.0)) for c in columns]
    rows = df.crossJoin(ends).select("id", F.array(*unit).alias("v")).orderBy("id").persist()
    place = pa.list_(pa.float64())

    def away(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.sqrt(((x[:, None] - y[None]) ** 2).sum(2))

    def parts(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                yield part.column(0), part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)

    def summed(m: np.ndarray, at: list[np.ndarray]) -> list[np.ndarray]:
        """Of each cluster: the sums of distances from its places `at` to its rows, and their slopes."""

        def run(batches):
            out = [np.zeros((len(p), dim + 1)) for p in at]
            for _, x in parts(batches):
                own = away(x, m).argmin(1)
                for c, p in enumerate(at):
                    if len(p) and len(y := x[own == c]):
                        way = p[:, None] - y[None]
                        d = np.sqrt((way**2).sum(2))
                        out[c][:, 0] += d.sum(1)
                        out[c][:, 1:] += np.divide(way, d[:, :, None], out=np.zeros_like(way), where=d[:, :, None] > 0).sum(1)
            n = [(c, j) for c, p in enumerate(at) for j in range(len(p))]
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in n], pa.int32()), pa.array([j for _, j in n], pa.int32()), pa.array([out[c][j].tolist() for c, j in n], place)], names=["c", "j", "s"])

        total = [np.zeros((len(p), dim + 1)) for p in at]
        for r in rows.mapInArrow(run, "c int, j int, s array<double>").collect():
            total[r.c][r.j] += r.s
        return total

    def left(m: np.ndarray, at: list[np.ndarray], sums: list[np.ndarray]) -> list[list]:
        """Of each cluster: some (bound, place) of the rows that may still be its medoid and are in no place of `at`."""

        def fewer(found: list) -> list:
            one = sorted({v: b for b, v in found}.items(), key=lambda x: (x[1], x[0]))
            near, rest = one[: some // 2], one[some // 2 :]
            return [(b, v) for v, b in near + rest[:: max(1, -(-len(rest) // (some // 2)))]]

        def run(batches):
            kept: list[list] = [[] for _ in at]
            for _, x in parts(batches):
                own = away(x, m).argmin(1)
                for c, p in enumerate(at):
                    y = np.unique(x[own == c], axis=0)
                    bound = np.zeros(len(y))
                    if len(y) and len(p):
                        bound = (sums[c][:, 0] - (sums[c][:, 1:] * p).sum(1) + y @ sums[c][:, 1:].T).max(1)
                        ok = (bound <= sums[c][:, 0].min() * (1 + 1e-9) + 1e-12) & ~(y[:, None] == p[None]).all(2).any(1)
                        y, bound = y[ok], bound[ok]
                    kept[c] = fewer(kept[c] + list(zip(bound.tolist(), map(tuple, y.tolist()))))
            n = [(c, b, v) for c, found in enumerate(kept) for b, v in found]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in n], pa.int32()), pa.array([x[1] for x in n], pa.float64()), pa.array([list(x[2]) for x in n], place)], names=["c", "b", "v"])

        found: list[list] = [[] for _ in at]
        for r in rows.mapInArrow(run, "c int, b double, v array<double>").collect():
            found[r.c].append((r.b, tuple(r.v)))
        return [fewer(f) for f in found]

    def least_ids(places: list[tuple]) -> dict:
        same = reduce(lambda a, b: a | b, [F.col("v") == F.array(*map(F.lit, v)) for v in places])
        return {tuple(r.v): r.i for r in rows.where(same).groupBy("v").agg(F.min("id").alias("i")).collect()}

    sizes = rows.select(F.spark_partition_id().alias("p")).groupBy("p").agg(F.count("*").alias("n")).orderBy("p").collect()
    n, starts = sum(r.n for r in sizes), np.cumsum([0] + [r.n for r in sizes])
    first = np.random.default_rng(seed).choice(n, min(k, n), replace=False) if n else []
    there = [(i, int(np.searchsorted(starts, i, "right")) - 1) for i in first]
    marks = [(sizes[p].p << 33) + int(i - starts[p]) for i, p in there]  # as Spark numbers the rows of partitions
    got = {r.i: tuple(r.v) for r in rows.withColumn("i", F.monotonically_increasing_id()).where(F.col("i").isin(marks)).collect()}
    own = [got[i] for i in marks]
    for _ in range(rounds if n else 0):
        m, places, sums = np.array(own), [np.empty((0, dim)) for _ in own], [np.empty((0, dim + 1)) for _ in own]
        while any(found := left(m, places, sums)):
            fresh = [np.array([v for _, v in f] if len(p) else list(dict.fromkeys([x, *[v for _, v in f]]))).reshape(-1, dim) for f, p, x in zip(found, places, own)]
            sums = [np.concatenate(x) for x in zip(sums, summed(m, fresh))]
            places = [np.concatenate(x) for x in zip(places, fresh)]
        now = []
        for x, p, t in zip(own, places, sums):
            near = [tuple(v) for v in p[t[:, 0] <= t[:, 0].min() * (1 + 1e-12)].tolist()] if len(p) else [x]
            ids = least_ids(near) if len(near) > 1 else {}
            now.append(min(near, key=ids.get) if ids else near[0])
        if now == own:
            break
        own = now
    m = np.array(own).reshape(-1, dim)

    def assign(batches):
        for ids, x in parts(batches):
            yield pa.RecordBatch.from_arrays([ids, pa.array(away(x, m).argmin(1), pa.int32())], names=["id", "cluster"])

    return rows.mapInArrow(assign, f"id {df.schema['id'].dataType.simpleString()}, cluster int")
