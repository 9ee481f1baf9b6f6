"""N-gram Jaccard join with token-combination prefixes, and the components of its links.

A document's set holds its distinct word shingles (words: runs of non-white-space bytes, A-Z in lower case). Two
documents link when 100 * |A & B| >= percent * |A | B|. The join is exact:

1. Equal sets become one class, whose node is its smallest doc_id. Only classes are joined.
2. Tokens in hash order: a document may miss at most t = n - ceil(p n) tokens of a partner, so similar ones share l or
   more of their first t + l tokens. Documents with too few shared tokens there leave; a document's l follows its size.
3. For those that stay, tokens are counted over all of them. Tokens that nobody else has can't be in an intersection, so
   documents with more than t of these leave as well.
4. Rarest first, prefixes are extended by one token: of these, either one rare token (frequency <= rare) or two
   frequent ones are shared. Rare tokens are indexed singly, frequent ones in combinations of two. Sets of more than
   `long_set` tokens would have too many combinations and index frequent tokens singly; sets within the join's reach of
   that size do both, so no pair is lost.
5. Buckets of rare tokens are small and pair up. In a bucket of frequent tokens every member pairs with the member that
   has the fewest tokens of its own. Buckets that are one component after these pairs are verified need no others. What
   is left in different components pairs up where it can be similar: by what sets lack or have beside their head's
   usual tokens (`delta_pairs`), and there only by as many of their rarest deltas as they need, so the near copies of a
   large group don't all meet.
6. Every pair is verified on whole sets. Components come from repeated minimum labels with pointer jumps; all of this
   stays in tables.

Null and empty texts, and texts without words, have an empty set and link with nothing. Texts with fewer words than a
shingle have their whole word sequence as one. Rows that repeat a doc_id are one document, linked when any of its texts
are. Null doc_ids keep their set size and have no component (null). An empty table gives an empty result; further
columns are ignored. Very long texts are hashed one at a time. Tokens, bucket heads and groups that hold a large share of the rows are
dealt to several tasks (common.salted_join).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.llm import common as C

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.ones(256, np.int8)
_WORD[[9, 10, 11, 12, 13, 32]] = 0


@dataclass(frozen=True)
class Settings:
    words: int = 5
    percent: int = 80
    rare: int = 8
    long_set: int = 300
    bitmap_limit: int = C.BITMAP_LIMIT


def shingle_rows(data: np.ndarray, begin: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every shingle occurrence of some joined texts."""
    data = _LOWER[data]
    start, end = C.word_spans(data, _WORD)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    word = C.span_hash(C.prefix_hash(data), start, end)
    row = np.searchsorted(begin, start, "right") - 1
    salt = C.mix(np.arange(1, words + 1, dtype=np.uint64) * C.BASE) | np.uint64(1)
    n = len(word) - words + 1
    out_row, out_hash = [], []
    if n > 0:
        whole = row[:n] == row[words - 1 :]
        h = np.zeros(n, np.uint64)
        for j in range(words):
            h += word[j : j + n] * salt[j]
        out_row.append(row[:n][whole])
        out_hash.append(C.mix(h[whole]))
    counts = np.bincount(row, minlength=len(begin) - 1)
    first = np.cumsum(counts) - counts
    for m in range(1, words):  # the whole sequence of a text with m words
        at = first[counts == m]
        h = np.full(len(at), m, np.uint64) * C.MIX1
        for j in range(m):
            h += word[at + j] * salt[j]
        out_row.append(row[at])
        out_hash.append(C.mix(h))
    return np.concatenate(out_row), np.concatenate(out_hash)


def sets_of(column: pa.Array, words: int) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """Sorted distinct shingle hashes (int64, ascending as unsigned) of each text, slice by slice."""
    offsets, body = C.text_bytes(column)
    for a, b in C.slices(offsets):
        row, h = shingle_rows(*C.joined(offsets, body, a, b), words)
        order = np.argsort(row, kind="stable")
        row, h = row[order], h[order]
        cuts = np.searchsorted(row, np.arange(b - a + 1))
        yield a, b, [np.unique(h[x:y]) for x, y in zip(cuts[:-1], cuts[1:])]


def _least(n, percent: int):
    """ceil(percent * n / 100): of a set of n tokens so many are in any similar set."""
    return (percent * n + 99) // 100


def _extra(n, percent: int):
    """By how much the hash-order prefix of a set of n tokens is extended, and so how many tokens it must share."""
    return max(1, (n - _least(n, percent)) // 2)


def digests(docs: DataFrame, s: Settings) -> DataFrame:
    """doc_id, n, h1, h2 (digest of the set), prefix (hash order), need (how many of it a partner must share)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, sets in sets_of(batch.column("text"), s.words):
                n = [len(x) for x in sets]
                h1 = np.array([np.add.reduce(C.mix(x)) for x in sets], np.uint64).view(np.int64)
                h2 = np.array([np.add.reduce(C.mix(x ^ C.MIX2)) for x in sets], np.uint64).view(np.int64)
                prefix = [x[: k - _least(k, s.percent) + _extra(k, s.percent)].view(np.int64) for k, x in zip(n, sets)]
                need = [_extra(_least(k, s.percent), s.percent) for k in n]
                flat = pa.array(np.concatenate(prefix) if prefix else np.zeros(0, np.int64))
                ends = pa.array(np.concatenate([[0], np.cumsum([len(p) for p in prefix])]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(n, pa.int64()), pa.array(h1), pa.array(h2), pa.ListArray.from_arrays(ends, flat), pa.array(need, pa.int64())], ["doc_id", "n", "h1", "h2", "prefix", "need"])

    return docs.select("doc_id", "text").mapInArrow(C.trimmed(run), f"doc_id {kind}, n long, h1 long, h2 long, prefix array<long>, need long")


def whole_sets(docs: DataFrame, s: Settings) -> DataFrame:
    """(node, n, tokens, sid) of docs (doc_id, text); sid is a hash of the set."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, sets in sets_of(batch.column("text"), s.words):
                flat = pa.array(np.concatenate([x.view(np.int64) for x in sets]))
                ends = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array([len(x) for x in sets], pa.int64()), pa.ListArray.from_arrays(ends, flat), pa.array(np.array([np.add.reduce(C.mix(x)) for x in sets], np.uint64).view(np.int64))], ["node", "n", "tokens", "sid"])

    return docs.select("doc_id", "text").mapInArrow(C.trimmed(run), f"node {kind}, n long, tokens array<long>, sid long")


def shared_tokens(sets: DataFrame, s: Settings) -> DataFrame:
    """(node, n, tokens): the tokens that another set has too, rarest first; sets with too few of them are gone.

    sets: materialised (node, n, tokens, text), each set once; text numbers a node's sets.
    """
    rows = sets.select("node", "n", "text", F.explode("tokens").alias("token"))
    counts = rows.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    hot = C.hot_in_sample(rows, ["token"], "node")
    found = C.salted_join(rows, counts, ["token"], hot, F.xxhash64("node")).groupBy("node", "n", "text").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("tokens"))
    return found.where(F.size("tokens") * 100 >= F.col("n") * s.percent).drop("text")


def buckets(shared: DataFrame, s: Settings) -> DataFrame:
    """(bucket, many, node, n, own): `many` marks buckets of frequent tokens; own is how many tokens nobody else has."""
    own = F.col("n") - F.size("tokens")
    least = F.floor((F.col("n") * s.percent + 99) / 100)
    prefix = F.slice("tokens", F.lit(1), F.greatest(F.lit(1), (F.col("n") - least + 2 - own)).cast("int"))
    base = shared.select("node", "n", own.alias("own"), prefix.alias("prefix"))
    rare = F.transform(F.filter("prefix", lambda x: x["df"] <= s.rare), lambda x: F.struct(F.lit(False).alias("many"), x["token"].alias("a"), F.lit(0).cast("long").alias("b")))
    often = F.transform(F.filter("prefix", lambda x: x["df"] > s.rare), lambda x: x["token"])
    base = base.withColumn("often", often)
    twos = F.flatten(F.transform("often", lambda x, i: F.transform(F.slice("often", i + 2, F.size("often")), lambda y: F.struct(F.lit(True).alias("many"), x.alias("a"), y.alias("b")))))
    ones = F.transform("often", lambda x: F.struct(F.lit(True).alias("many"), x.alias("a"), F.lit(0).cast("long").alias("b")))
    none = F.slice(ones, 1, 0)
    keys = F.concat(rare, F.when(F.col("n") <= s.long_set, twos).otherwise(none), F.when(F.col("n") * 100 >= s.long_set * s.percent, ones).otherwise(none))
    return base.select("node", "n", "own", F.explode(keys).alias("key")).select(F.col("key.a").alias("a"), F.col("key.b").alias("b"), F.col("key.many").alias("many"), "node", "n", "own")


def _fits(a: Column, b: Column, percent: int) -> Column:
    return (F.least(a, b) * 100 >= F.greatest(a, b) * percent) & (a > 0) & (b > 0)


def verified(pairs: DataFrame, shared: DataFrame, s: Settings) -> DataFrame:
    """Of distinct (x, y) those that are similar. Each node's tokens meet its pairs; nodes of many pairs in many tasks."""
    pairs = C.materialise(pairs.distinct(), "pairs")
    tokens = shared.select("node", "n", F.transform("tokens", lambda t: t["token"]).alias("tokens"))
    left = tokens.select(F.col("node").alias("x"), F.col("n").alias("nx"), F.col("tokens").alias("tx"))
    right = tokens.select(F.col("node").alias("y"), F.col("n").alias("ny"), F.col("tokens").alias("ty"))
    hot = lambda c: C.hot_keys(C.materialise(pairs.groupBy(c).agg(F.count("*").alias("n")), "partners"), [c], "n")
    both = C.salted_join(C.salted_join(pairs, left, ["x"], hot("x"), F.xxhash64("y")), right, ["y"], hot("y"), F.xxhash64("x"))
    common = F.size(F.array_intersect("tx", "ty"))
    return both.where(common * (100 + s.percent) >= (F.col("nx") + F.col("ny")) * s.percent).select("x", "y").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that edges (x, y) reach, for every node that has an edge."""
    edges = C.materialise(edges.select("x", "y").unionAll(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "edges")
    labels = C.materialise(edges.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.min("x")).alias("component")), "labels")
    while True:
        near = edges.join(labels.select(F.col("node").alias("y"), "component"), "y").select(F.col("x").alias("node"), "component")
        lower = near.unionAll(labels).groupBy("node").agg(F.min("component").alias("component"))
        roots = lower.select(F.col("node").alias("component"), F.col("component").alias("root"))
        jumped = lower.join(roots, "component").select("node", F.col("root").alias("component"))
        after = C.materialise(jumped, "labels")
        changed = after.join(labels.withColumnRenamed("component", "was"), "node").where("component <> was").limit(1).count()
        if not changed:
            return after
        labels = after


def promising(digest: DataFrame, s: Settings) -> DataFrame:
    """(node): documents that share enough tokens of their hash-order prefix with other sets; a few more may stay."""
    rows = digest.where("n > 0 and doc_id is not null")
    seen = rows.select("h1", F.explode("prefix").alias("key")).groupBy("key").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo <> hi").select("key")
    seen = C.materialise(seen, "seen")
    bits, words = C.bitmap_of(seen, s.bitmap_limit)
    shared = digest.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("slots")
            hits = np.concatenate([[0], np.cumsum(C.in_bitmap(shared.value, lists.flatten().to_numpy()))])
            ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            keep = hits[ends[1:]] - hits[ends[:-1]] >= batch.column("need").to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column("node").filter(pa.array(keep))], ["node"])

    slots = F.transform("prefix", lambda x: F.pmod(F.xxhash64(x), F.lit(bits)))
    kind = digest.schema["doc_id"].dataType.simpleString()
    return rows.select(F.col("doc_id").alias("node"), "need", slots.alias("slots")).mapInArrow(run, f"node {kind}").distinct()


def sets_for(docs: DataFrame, nodes: DataFrame, s: Settings) -> DataFrame:
    """(node, n, tokens) of the documents in `nodes`; a few others may be there, which later steps drop. Texts are not shuffled."""
    docs = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull())
    bitmap = C.bitmap_of(nodes.select(F.xxhash64("node").alias("key")), s.bitmap_limit)
    return whole_sets(C.likely(docs, F.xxhash64("doc_id"), bitmap), s).where("n > 0")


def delta_pairs(members: DataFrame, shared: DataFrame, s: Settings) -> DataFrame:
    """Pairs (x, y) of different components among the members of each head that can be similar.

    members: materialised (head, node, n, component). Let U be the tokens that more than half of a head's members have, and
    the delta of x its d(x) tokens of U that it lacks and its tokens outside U. Two members have |U| - d(x) - d(y) + s tokens in
    common, s the size of their deltas' intersection. With g(x) = (100 + percent) d(x) + percent n(x) they are similar just if
    (100 + percent) (|U| + s) >= g(x) + g(y). With s = 0, either is similar to the member of least g, too; so that member is
    paired with all. With s > 0 they share delta tokens, x at least as many as its need, (g(x) + least g) / (100 + percent) - |U|:
    so of its delta, rarest tokens first, only the first |delta| - need + 1 are indexed, and two similar members meet there.
    Near copies of one text share most tokens and few of their deltas.
    """
    # a token with its rarity above it: one long, so that sets of them are hashed, and rare ones come first
    rarity = lambda t: F.shiftleft(F.floor(F.log2(t["df"])), 58).bitwiseOR(t["token"].bitwiseAND(F.lit((1 << 58) - 1)))
    known = members.join(shared.select("node", F.transform("tokens", rarity).alias("tokens")), "node")
    size = C.materialise(members.groupBy("head").agg(F.count("*").alias("m")), "heads")
    hot, by = C.hot_keys(size, ["head"], "m"), F.xxhash64("node")
    counts = known.select("head", F.explode("tokens").alias("token")).groupBy("head", "token").agg(F.count("*").alias("c"))
    usual = C.salted_join(counts, size, ["head"], hot, F.xxhash64("token")).where("2 * c > m").groupBy("head").agg(F.collect_list("token").alias("usual"))
    usual = size.select("head").join(usual, "head", "left").withColumn("usual", F.coalesce("usual", F.expr("cast(array() as array<bigint>)")))
    whole, p = 100 + s.percent, s.percent
    delta = C.salted_join(known, usual, ["head"], hot, by).withColumns({"lacks": F.array_except("usual", "tokens"), "adds": F.array_except("tokens", "usual"), "u": F.size("usual")})
    g = F.size("lacks") * whole + F.col("n") * p
    delta = C.materialise(delta.select("head", "node", "n", "component", "u", g.alias("g"), F.array_sort(F.concat("lacks", "adds")).alias("delta")), "deltas")
    least = delta.groupBy("head").agg(F.min(F.struct("g", "node", "component")).alias("least"))
    delta = C.salted_join(delta, least, ["head"], hot, by)
    central = delta.where(F.col("component") != F.col("least.component")).select(F.least("node", "least.node").alias("x"), F.greatest("node", "least.node").alias("y"))
    need = F.greatest(F.lit(1), F.ceil((F.col("g") + F.col("least.g") - F.col("u") * whole) / whole))
    indexed = F.slice("delta", F.lit(1), F.greatest(F.lit(0), F.size("delta") - need + 1).cast("int"))
    rows = delta.select("head", "node", "n", "component", "u", "g", F.size("delta").alias("k"), F.explode(indexed).alias("token"))
    u, v = rows.alias("u"), rows.alias("v")
    fits = _fits(F.col("u.n"), F.col("v.n"), p) & (F.col("u.g") + F.col("v.g") <= (F.col("u.u") + F.least("u.k", "v.k")) * whole)
    both = u.join(v, (F.col("u.head") == F.col("v.head")) & (F.col("u.token") == F.col("v.token")) & (F.col("u.component") < F.col("v.component")) & fits)
    return central.unionAll(both.select(F.least("u.node", "v.node").alias("x"), F.greatest("u.node", "v.node").alias("y")))


def links(docs: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, node components, hot nodes): doc_id, n, node of every document; node, component of linked nodes."""
    prefixes = C.materialise(digests(docs, s), "digests")
    digest = C.materialise(prefixes.select("doc_id", "n", "h1", "h2"), "sizes")
    classes = digest.where("n > 0 and doc_id is not null").groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"))
    classes = C.materialise(classes, "classes")
    documents = C.split_join(digest, classes, ["n", "h1", "h2"], "copies", F.xxhash64("doc_id"), "left")
    documents = C.materialise(documents.select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.coalesce("node", "doc_id")).alias("node")), "documents")
    # Copies share all tokens, but only with themselves: of each class its node alone is joined.
    spare = documents.where("doc_id <> node").select(F.col("doc_id").alias("node")).distinct().join(classes.select("node"), "node", "left_anti")
    # A doc_id with several texts holds their classes together.
    own = documents.where("n > 0").groupBy("doc_id").agg(F.min("node").alias("x"), F.max("node").alias("__most")).where("x <> __most")
    held = own.join(documents, "doc_id").where("x <> node").select("x", F.col("node").alias("y")).distinct()
    stay = C.materialise(promising(prefixes, s).join(spare, "node", "left_anti"), "stay")
    C.discard(prefixes)
    sets = sets_for(docs, stay, s)
    if documents.where("n > 0").groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").limit(1).count():
        once = sets.dropDuplicates(["node", "sid"])  # equal rows of one document
        sets = once.withColumn("text", F.row_number().over(Window.partitionBy("node").orderBy("sid")))
    else:
        sets = sets.withColumn("text", F.lit(1))
    sets = C.materialise(sets.drop("sid"), "sets")
    shared = C.materialise(shared_tokens(sets, s), "shared")
    C.discard(sets)
    index = C.materialise(buckets(shared, s), "buckets")

    rare = index.where(~F.col("many")).select("a", "node", "n")
    other = rare.select("a", F.col("node").alias("y"), F.col("n").alias("ny"))
    small = rare.join(other, "a").where((F.col("node") < F.col("y")) & _fits(F.col("n"), F.col("ny"), s.percent)).select(F.col("node").alias("x"), "y")
    often = index.where("many")
    hot, by = C.hot_in_sample(often, ["a", "b"], "node"), F.xxhash64("node")
    heads = often.groupBy("a", "b").agg(F.min(F.struct("own", "node", "n")).alias("head"), F.count("*").alias("members")).where("members > 1").select("a", "b", "head")
    stars = C.salted_join(often, heads, ["a", "b"], hot, by).where((F.col("node") != F.col("head.node")) & _fits(F.col("n"), F.col("head.n"), s.percent))
    stars = stars.select(F.least("node", "head.node").alias("x"), F.greatest("node", "head.node").alias("y"))
    first = C.materialise(verified(small.unionAll(stars), shared, s).unionAll(held), "links")
    labels = components(first)

    # What frequent buckets still hold in different components.
    placed = C.salted_join(often, heads, ["a", "b"], hot, by).join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    split = placed.groupBy("a", "b").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("a", "b")
    members = C.salted_join(placed, split, ["a", "b"], hot, by).select(F.col("head.node").alias("head"), "node", "n", "component").distinct()
    second = C.materialise(verified(delta_pairs(C.materialise(members, "members"), shared, s), shared, s), "links")
    if second.limit(1).count():
        labels = components(first.unionAll(second))
    return documents, labels, C.hot_keys(classes.groupBy("node").agg(F.sum("copies").alias("n")), ["node"], "n")


def jaccard_components(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_shingles, component_id: one row for each row of docs."""
    since = C.mark()
    documents, labels, hot = links(docs, settings)
    out = C.salted_join(documents, labels, ["node"], hot, F.xxhash64("doc_id"), "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "node").alias("component_id"))
    C.tidy(since, out)
    return out


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(C.table(spark, sf_dir, "documents"), Settings(words=3, percent=90))
