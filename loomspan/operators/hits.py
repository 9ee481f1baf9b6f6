"""Hits without a shuffle of pairs.

Every target lies in one cell: the one of its start, on the least level whose cells are as long as it. Queries are copied to all
cells in which a target that overlaps them may lie; cells are sized by the lengths there are, so copies stay a few for each
query. A cell's rows meet in one task, which has all hits of its targets: ranks, best hits and counts need nothing more. Rows
go through in batches of whole cells, pairs in pieces of about a million.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a batch of cells, pairs of a piece, rows of a batch that is given back.
ROWS, PAIRS, OUT = 1 << 16, 1 << 20, 1 << 17
RELATIONS = ("covers", "inside", "left", "right")


def fits(query: DataFrame, target: DataFrame) -> bool:
    """Whole positions, no stream, and no target id twice (such a target's hits may lie in several cells)."""
    whole = all(isinstance(df.schema[c].dataType, T.IntegralType) for df in (query, target) for c in ("start", "end"))
    return whole and not query.isStreaming and not target.isStreaming and not target.groupBy("id").agg(F.count("*").alias("n")).where("n > 1 and id is not null").limit(1).collect()


def _bits(df: DataFrame):
    n = F.abs(F.col("end") - F.col("start")).cast("long")
    return F.when(n > 0, F.length(F.bin(n))).otherwise(F.when(n.isNotNull(), 0))


def _cells(query: DataFrame, target: DataFrame, keys: tuple[str, ...], qcols: list[str], tcols: list[str]) -> DataFrame:
    """Both sides' rows by keys, __k (level) and __b (cell)."""
    sides = [df.select(F.lit(i).alias("i"), _bits(df).alias("bits")) for i, df in enumerate((query, target))]
    found = reduce(DataFrame.unionAll, sides).where("bits is not null").groupBy("i", "bits").agg(F.count("*").alias("n")).collect()
    q, t = ({r.bits: r.n for r in found if r.i == i} for i in (0, 1))
    size = 0  # cells are 2 ** size long: half the queries' mean length at least, and as long as nine of ten targets
    while q and 2 * sum(q.values()) * 2**size < sum(n * 2**b for b, n in q.items()):
        size += 1
    while t and 10 * sum(n for b, n in t.items() if b <= size) < 9 * sum(t.values()):
        size += 1
    levels = sorted({max(0, -(-(b - size) // 2)) for b in t})
    lo, hi = F.least("start", "end").cast("long"), F.greatest("start", "end").cast("long")
    at = lambda x: F.call_function("shiftright", x, (F.lit(size) + 2 * F.col("__k")).cast("int"))
    ends = [F.col("start").cast("long").alias("__s"), F.col("end").cast("long").alias("__e")]
    there = reduce(lambda a, c: a & F.col(c).isNotNull(), [*keys, "start", "end"], F.lit(bool(levels)))
    left = query.where(there).withColumn("__k", F.explode(F.array(*[F.lit(k) for k in levels or [0]]))).withColumn("__b", F.explode(F.sequence(at(lo) - 1, at(hi))))
    left = left.select(*keys, "__k", "__b", F.lit(True).alias("__q"), *ends, F.col("id").alias("q_id"), *[F.col(c).alias(f"q_{c}") for c in qcols])
    level = F.greatest(F.lit(0), F.ceil((_bits(target) - size) / 2)).cast("int")
    right = target.withColumn("__k", level).withColumn("__b", F.when(F.col("start").isNotNull() & F.col("end").isNotNull(), at(lo)))
    right = right.select(*keys, "__k", "__b", F.lit(False).alias("__q"), *ends, F.col("id").alias("t_id"), *[F.col(c).alias(f"t_{c}") for c in tcols])
    by = [*keys, "__k", "__b"]
    return left.unionByName(right, allowMissingColumns=True).repartition(*by).sortWithinPartitions(*by)


def _starts(table: pa.Table, by: list[str]) -> np.ndarray:
    """Where a row isn't in the cell of the row before it. Rows with something missing are cells of their own."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for c in by:
        column = table[c].combine_chunks()
        new[1:] |= pc.fill_null(pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)), True).to_numpy(zero_copy_only=False)
    return new


def _whole_cells(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    held, n, least = [], 0, ROWS
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= least:
            table = pa.Table.from_batches(held).combine_chunks()
            new = _starts(table, by)
            cut = int(np.flatnonzero(new)[-1])
            if not cut:
                held, least = table.to_batches(), 2 * n
                continue
            yield table.slice(0, cut), new[:cut]
            held, n, least = table.slice(cut).to_batches(), table.num_rows - cut, ROWS
    if n:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, _starts(table, by)


def _ranges(low: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which row each number of the ranges low .. low + n - 1 is of, and the numbers."""
    of = np.repeat(np.arange(len(n)), n)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(n) - n - low, n)


class _Sweep:
    """The queries of some cells by cell and start, in classes of lengths; targets look up where theirs are."""

    def __init__(self, qg: np.ndarray, qs: np.ndarray, qe: np.ndarray, tg: np.ndarray, ts: np.ndarray, te: np.ndarray):
        self.qs, self.qe, self.ts, self.te = qs, qe, ts, te
        ql, qh, self.tl, self.th = np.minimum(qs, qe), np.maximum(qs, qe), np.minimum(ts, te), np.maximum(ts, te)
        self.base = int(min(ql.min(), self.tl.min()))
        self.span = int(max(qh.max(), self.th.max())) - self.base + 2
        self.tg, self.turned = tg, bool((qs > qe).any() or (ts > te).any())
        kind = (np.frexp((qh - ql).astype(float))[1] + 1) // 2
        self.classes = []
        for k in np.unique(kind):
            i = np.flatnonzero(kind == k)
            i = i[np.lexsort((ql[i], qg[i]))]
            self.classes.append((i, qg[i] * self.span + (ql[i] - self.base), int((qh[i] - ql[i]).max())))
        self.classes.sort(key=lambda x: -len(x[0]))
        self.qg = qg

    def key(self, x: np.ndarray) -> np.ndarray:
        return self.tg * self.span + np.clip(x - self.base, 0, self.span - 1)

    def counts(self) -> np.ndarray:
        """Hits of each target."""
        if self.turned:
            n = np.zeros(len(self.ts), np.int64)
            for t, _ in self.pairs(*self.bounds()):
                n += np.bincount(t, minlength=len(n))
            return n
        begin, end = np.sort(self.qg * self.span + (self.qs - self.base)), np.sort(self.qg * self.span + (self.qe - self.base))
        return np.searchsorted(begin, self.key(self.te), "right") - np.searchsorted(end, self.key(self.ts), "left")

    def bounds(self) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For each class, where each target's queries begin, and how many there are; some don't reach it."""
        low = [np.searchsorted(k, self.key(self.tl - m), "left") for _, k, m in self.classes]
        return low, [np.searchsorted(k, self.key(self.th), "right") - a for (_, k, _), a in zip(self.classes, low)]

    def near(self, low: list[np.ndarray], n: list[np.ndarray], around: int = 12) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """bounds() of the queries that may be best. A target of length l has a jaccard of l / (l + d) at most with one whose
        start or end is d away, so the best jaccard among those of the nearest starts tells how far others may lie."""
        many = np.flatnonzero(sum(n) > 8 * around)
        if not len(many) or self.turned:
            return low, n
        size, best = self.te[many] - self.ts[many] + 1, np.zeros(len(many))
        most = []  # what a class's lengths allow
        for (i, k, longest), a, m in zip(self.classes, low, n):
            least = int((self.qe[i] - self.qs[i]).min()) + 1
            most.append(np.minimum(np.minimum(1.0, (longest + 1) / size), size / least))
            own = np.flatnonzero((most[-1] > best) & (m[many] > 0))
            of = many[own]
            at = np.searchsorted(k, self.key(self.tl)[of])[:, None] + np.arange(-around, around)
            ok = (at >= a[of, None]) & (at < (a + m)[of, None])
            j = i[np.where(ok, at, 0)]
            both = np.minimum(self.qe[j], self.te[of, None]) - np.maximum(self.qs[j], self.ts[of, None]) + 1
            either = np.maximum(self.qe[j], self.te[of, None]) - np.minimum(self.qs[j], self.ts[of, None]) + 1
            best[own] = np.maximum(best[own], np.where(ok & (both > 0), both / either, 0).max(1, initial=0))
        far = np.full(len(self.ts), self.span)
        far[many] = np.where(best > 0, np.minimum(np.ceil(size * (1 / np.where(best > 0, best, 1) - 1)) + 1, self.span), self.span)
        low2 = [np.maximum(a, np.searchsorted(k, self.key(self.tl - far), "left")) for (_, k, _), a in zip(self.classes, low)]
        n2 = [np.maximum(0, np.minimum(a + m, np.searchsorted(k, self.key(self.tl + far), "right")) - b) for (_, k, _), a, m, b in zip(self.classes, low, n, low2)]
        for m, x in zip(n2, most):
            m[many[x < best * (1 - 1e-9)]] = 0
        return low2, n2

    def pairs(self, low: list[np.ndarray], n: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(target, query) numbers by target, in pieces that hold all of a target's."""
        upto, at = np.cumsum(sum(n)), 0
        while at < len(upto):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right")))
            parts = []
            for (i, _, _), a, m in zip(self.classes, low, n):
                t, j = _ranges(a[at:to], m[at:to])
                q, t = i[j], t + at
                ok = (self.qe[q] >= self.ts[t]) & (self.qs[q] <= self.te[t])
                parts.append((t[ok], q[ok]))
            t, q = (np.concatenate(x) for x in zip(*parts))
            if len(parts) > 1:
                order = np.argsort(t, kind="stable")
                t, q = t[order], q[order]
            yield t, q
            at = to


def _first_of(t: np.ndarray) -> np.ndarray:
    """For sorted t: where each one's rows begin."""
    new = np.ones(len(t), bool)
    new[1:] = t[1:] != t[:-1]
    return np.flatnonzero(new)


def sweep(query: DataFrame, target: DataFrame, keys: tuple[str, ...], what: str = "all", by: str | None = None, qcols: tuple[str, ...] = (), tcols: tuple[str, ...] = (), na: bool = False, rank: bool = True, untie: bool = False, listed: bool = False, min_jaccard: float | None = None) -> DataFrame:
    """Hits of the targets: target, query, intersect, union, qlen, tlen, qrank, qpos, and q_<qcols>, t_<tcols>.

    what: all hits; best: those of rank 1, with `hits`, how many the target has; count: a row for each target with `hits` only.
    by: a column of the queries, each of whose values ranks and counts for itself; it is among qcols. na: targets without a
    hit have a row as well. Without rank, qrank is 1. untie: as in `annotate`. listed: one row for each target; query, qcols
    and numbers are strings joined by ';' in the order of rank and id, missing ones NA; qcols are strings. Hits below min_jaccard
    are NA as a whole there.
    """
    cells = _cells(query, target, keys, [*qcols, *([by] if by and by not in qcols else [])], list(tcols))
    group = [*keys, "__k", "__b"]
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    numbers = [] if what == "count" else ["intersect", "union", "qlen", "tlen", "qrank"]
    tail = [*([f"q_{by}"] if what == "count" and by else []), *[f"t_{c}" for c in tcols]]
    types = {"target": kind(target, "id")}
    if what != "count":
        types |= {"query": "string" if listed else kind(query, "id"), **{c: "string" if listed else "bigint" for c in numbers}, "qpos": "string" if listed else "tinyint", **{f"q_{c}": "string" if listed else kind(query, c) for c in qcols}}
    types |= {c: kind(query, by) if c.startswith("q_") else kind(target, c[2:]) for c in tail}
    if what != "all":
        types["hits"] = "bigint"

    def rows_of(table: pa.Table, ti: np.ndarray, qi: np.ndarray, t: np.ndarray, q: np.ndarray, s: np.ndarray, e: np.ndarray, hits: np.ndarray | None, place: np.ndarray | None) -> dict:
        """Pairs t, q (numbers of ti and qi, q < 0: none) that are by target, all of a target's at once."""
        no = q < 0
        a, b = qi[q], ti[t]
        both = np.minimum(e[a], e[b]) - np.maximum(s[a], s[b]) + 1
        qlen, tlen = e[a] - s[a] + 1, e[b] - s[b] + 1
        either = qlen + tlen - both
        first = _first_of(t)
        one = np.ones(len(t), np.int64)
        if what == "all" and rank and len(t):
            j = np.where(no, 0.0, both / np.where(no, 1, either))
            order = np.lexsort((place[q], -j, t) if place is not None else (-j, t))
            a, b, no, both, either, qlen, tlen, j = (x[order] for x in (a, b, no, both, either, qlen, tlen, j))
            at, begin = np.arange(len(t)), np.repeat(first, np.diff(np.append(first, len(t))))
            new = np.ones(len(t), bool)
            new[1:] = (t[1:] != t[:-1]) | (j[1:] != j[:-1])
            one = np.maximum.accumulate(np.where(new, at, 0)) - begin + 1
            if untie:
                firsts = np.repeat(np.add.reduceat(one == 1, first), np.diff(np.append(first, len(t))))
                one = np.where(firsts > 1, at - begin + 1, one)
        elif place is not None and len(t):
            order = np.lexsort((place[q], t))
            a, b, no, both, either, qlen, tlen = (x[order] for x in (a, b, no, both, either, qlen, tlen))
        zero = lambda x: np.where(no, 0, x)
        where = np.select([(s[a] <= s[b]) & (e[a] >= e[b]), (s[a] >= s[b]) & (e[a] <= e[b]), (s[a] < s[b]) & (e[a] < e[b])], [0, 1, 2], 3).astype(np.int8)
        out = {"target": table["t_id"].take(pa.array(b)), "query": table["q_id"].take(pa.array(a, mask=no)), "intersect": pa.array(zero(both)), "union": pa.array(zero(either)), "qlen": pa.array(zero(qlen)), "tlen": pa.array(zero(tlen)), "qrank": pa.array(one), "qpos": pa.array(where, mask=no)}
        out |= {f"q_{c}": table[f"q_{c}"].take(pa.array(a, mask=no)) for c in qcols} | {f"t_{c}": table[f"t_{c}"].take(pa.array(b)) for c in tcols}
        if hits is not None:
            out["hits"] = pa.array(hits[t])
        if not listed:
            return out
        ends = pa.array(np.append(first, len(t)), pa.int32())
        low = pa.array(~no & (both / np.where(no, 1, either) < min_jaccard) if min_jaccard is not None else np.zeros(len(t), bool))
        texts = out | {"qpos": pa.array(list(RELATIONS)).take(out["qpos"])}
        text = lambda x: x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
        for c in ("query", *numbers, "qpos", *[f"q_{c}" for c in qcols]):
            out[c] = pc.binary_join(pa.ListArray.from_arrays(ends, text(pc.if_else(low, "NA", pc.fill_null(pc.cast(text(texts[c]), pa.string()), "NA")))), ";")
        return out | {c: text(out[c]).take(pa.array(first)) for c in ("target", *[f"t_{c}" for c in tcols], *(["hits"] if hits is not None else []))}

    def found(table: pa.Table, new: np.ndarray) -> Iterator[dict]:
        g = np.cumsum(new) - 1
        isq = table["__q"].to_numpy()
        s, e = (pc.fill_null(table[c], 0).to_numpy() for c in ("__s", "__e"))
        if int(g[-1] + 1) * (int(max(s.max(), e.max())) - int(min(s.min(), e.min())) + 2) > 1 << 62 and g[-1]:
            cut = int(np.searchsorted(g, (g[-1] + 1) // 2))
            for part, marks in ((table.slice(0, cut), new[:cut]), (table.slice(cut), new[cut:])):
                yield from found(part, marks)
            return
        ti, every = np.flatnonzero(~isq), np.flatnonzero(isq)
        if not len(ti):
            return
        parts = [(None, every)]
        if by:
            codes = pc.dictionary_encode(table[f"q_{by}"].combine_chunks().take(pa.array(every)), null_encoding="encode")
            parts = [(k, every[codes.indices.to_numpy() == k]) for k in range(len(codes.dictionary))]
        place = None
        if listed or untie:
            place = np.empty(len(every), np.int64)
            place[pc.sort_indices(table["q_id"].combine_chunks().take(pa.array(every))).to_numpy()] = np.arange(len(every))
        none = np.ones(len(ti), bool)
        for k, qi in parts:
            if not len(qi):
                continue
            w = _Sweep(g[qi], s[qi], e[qi], g[ti], s[ti], e[ti])
            hits = w.counts() if what != "all" else None
            if what == "count":
                t = np.arange(len(ti)) if na and not by else np.flatnonzero(hits)
                none[t] = False
                out = {"target": table["t_id"].take(pa.array(ti[t])), **{f"t_{c}": table[f"t_{c}"].take(pa.array(ti[t])) for c in tcols}, "hits": pa.array(hits[t])}
                yield out | ({f"q_{by}": codes.dictionary.take(pa.array(np.full(len(t), k)))} if by else {})
                continue
            low, n = w.bounds()
            if what == "best":
                low, n = w.near(low, n)
            for t, q in w.pairs(low, n):
                if what == "best" and len(t):
                    a, b = qi[q], ti[t]
                    both = np.minimum(e[a], e[b]) - np.maximum(s[a], s[b]) + 1
                    j = both / ((e[a] - s[a] + 1) + (e[b] - s[b] + 1) - both)
                    first = _first_of(t)
                    keep = j == np.repeat(np.maximum.reduceat(j, first), np.diff(np.append(first, len(t))))
                    t, q = t[keep], q[keep]
                none[t] = False
                if len(t):
                    yield rows_of(table, ti, qi, t, q, s, e, hits, place)
        if na and none.any() and not by:
            t = np.flatnonzero(none)
            qi = every if len(every) else np.zeros(1, np.int64)
            if what == "count":
                yield {"target": table["t_id"].take(pa.array(ti[t])), **{f"t_{c}": table[f"t_{c}"].take(pa.array(ti[t])) for c in tcols}, "hits": pa.array(np.zeros(len(t), np.int64))}
            else:
                yield rows_of(table, ti, qi, t, np.full(len(t), -1), s, e, np.zeros(len(ti), np.int64) if what == "best" else None, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, new in _whole_cells(batches, group):
            for out in found(table, new):
                yield from pa.table({c: out[c] for c in types}).combine_chunks().to_batches(max_chunksize=OUT)

    return cells.mapInArrow(run, ", ".join(f"`{c}` {k}" for c, k in types.items()))


def relation(df: DataFrame) -> DataFrame:
    """qpos by its name."""
    name = F.element_at(F.array(*map(F.lit, RELATIONS)), F.col("qpos").cast("int") + 1)
    return df.withColumn("qpos", F.when(F.col("qpos").isNotNull(), name))
