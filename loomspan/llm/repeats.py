"""Repeated-substring removal by prefix-free parsing: every 200-byte string that starts more than once goes.

Triggers: a rolling hash of `trigger` bytes runs over the text; in each window of `length` bytes the trigger of least
hash (leftmost among equals) is that window's. A window's trigger depends on its bytes alone, so equal windows have
theirs at the same place. Consecutive windows with the same trigger make one phrase: the bytes from the first such
window's start to the last one's end. Every window lies in exactly one phrase.

Dictionary: phrases counted by (trigger, phrase). If a phrase occurs twice, all its windows repeat. If all phrases of a
trigger are one, there is nothing else to find; a trigger that occurs once has no repeats. What is left are triggers
with different phrases, at the edges of repeats. One copy of each such phrase is taken, and phrases meet by trigger in
sorted partitions. There their bytes are put into corpus order (`corpus_order`): they are parsed once more, into short
phrases that end at the next trigger and overlap by it; the suffix array of these phrases' dictionary and the suffix array
of the parse combine into the order of all suffixes, as the bytes up to the next trigger are prefix-free and what follows
them is a suffix of the parse. Windows that repeat are neighbours in that order with `length` bytes in common. The sorting
follows the distinct text and not the copies. Triggers with more than `crowd` phrases would make one task large: these
are split by the windows themselves, whose hashes are counted before they are shuffled, so no task gets them all.

Texts are UTF-8 bytes, null counts as empty; matches never cross documents, and a document may match itself. Strings
are judged on the input, not on what is left. Repeated rows match each other whole where they have 200 bytes. Shorter
texts have no such string and stay; long ones are parsed one at a time. doc_ids may repeat or be null: rows are told apart
by doc_id and a hash of the text, and rows that are equal in both get equal results. An empty table gives an empty result;
`remove_repeats` keeps further columns, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm import common as C


@dataclass(frozen=True)
class Settings:
    length: int = 200
    trigger: int = 64
    crowd: int = 2048
    inner: int = 8  # bytes of a trigger of the second parse
    modulus: int = 32  # one in so many places has one


def phrases(data: np.ndarray, prefix: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trigger places, first window, last window) of one text's phrases, places counted from its start."""
    windows = len(data) - s.length + 1
    if windows < 1:
        return (np.zeros(0, np.int64),) * 3
    places = np.arange(len(data) - s.trigger + 1)
    bits = np.uint64(max(1, int(len(places)).bit_length()))
    # the place fills the low bits, so that the least value is the leftmost of the least hashes
    low = (C.span_hash(prefix, places, places + s.trigger) >> bits) << bits | places.astype(np.uint64)
    width, span = 1, s.length - s.trigger + 1
    while 2 * width <= span:  # minima over 2, 4, 8, ... triggers
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    at = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
    return at[first], first, np.concatenate([first[1:] - 1, [windows - 1]])


def _texts(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, bytes, running hash) of each text."""
    offsets, body = C.text_bytes(column)
    for i in range(len(offsets) - 1):
        data = body[offsets[i] : offsets[i + 1]]
        yield i, data, C.prefix_hash(data)


def keyed(docs: DataFrame) -> DataFrame:
    """docs with `row` and `twin`, which tell different rows apart."""
    twin = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    return docs.withColumn("row", F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text", "doc_id"))).withColumn("twin", twin)


def dictionary_entries(rows: DataFrame, s: Settings) -> DataFrame:
    """(trigger, phrase, row, twin, first, last) of every phrase: two hashes, and the windows it is for."""
    names = ["trigger", "phrase", "row", "twin", "first", "last"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, twin = batch.column("row").to_numpy(), batch.column("twin").to_numpy()
            out: list[list[np.ndarray]] = [[] for _ in names]
            size = 0
            for i, data, prefix in _texts(batch.column("text")):
                at, first, last = phrases(data, prefix, s)
                if not len(at):
                    continue
                trigger = C.span_hash(prefix, at, at + s.trigger).view(np.int64)
                # where the trigger stands in the phrase is part of the phrase
                phrase = (C.span_hash(prefix, first, last + s.length) + C.mix((at - first).astype(np.uint64))).view(np.int64)
                for x, v in zip(out, (trigger, phrase, np.full(len(at), row[i]), np.full(len(at), twin[i]), first.astype(np.int32), last.astype(np.int32))):
                    x.append(v)
                size += len(at)
                if size > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names)
                    out, size = [[] for _ in names], 0
            if size:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names)

    return rows.select("row", "twin", "text").mapInArrow(C.trimmed(run), "trigger long, phrase long, row long, twin long, first int, last int")


def phrase_bytes(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """(trigger, crowded, row, twin, first, body) of the phrases `asked` (row, twin, spans: array of trigger, crowded, first, end)."""
    names = ["trigger", "crowded", "row", "twin", "first", "body"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, twin, spans = batch.column("row").to_numpy(), batch.column("twin").to_numpy(), batch.column("spans")
            offsets, body = C.text_bytes(batch.column("text"))
            for i in range(len(batch)):
                inner = spans[i].values
                first, end = inner.field("first").to_numpy() + offsets[i], inner.field("end").to_numpy() + offsets[i]
                n = len(inner)
                yield pa.RecordBatch.from_arrays([inner.field("trigger"), inner.field("crowded"), pa.array(np.full(n, row[i])), pa.array(np.full(n, twin[i])), inner.field("first"), pa.array([body[a:b].tobytes() for a, b in zip(first, end)], pa.binary())], names)

    return rows.join(asked, ["row", "twin"]).select("row", "twin", "text", "spans").mapInArrow(C.trimmed(run), "trigger long, crowded boolean, row long, twin long, first int, body binary")


def _suffix_keys(bodies: pa.Array, trigger: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(phrase number, window number, key) of the windows of some phrases; a key has the trigger in it."""
    offsets, data = C.text_bytes(bodies)
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    prefix = C.prefix_hash(data)
    n = np.diff(offsets) - s.length + 1
    who = np.repeat(np.arange(len(n)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    begin = at + offsets[who]
    return who, at, C.span_hash(prefix, begin, begin + s.length) + C.mix(trigger.view(np.uint64))[who]


def suffix_ranks(first: np.ndarray, left: np.ndarray, seen: int) -> np.ndarray:
    """The suffix array of some strings in a row, as ranks (equal suffixes share one), by prefix doubling.

    first: a key of the `seen` symbols from each place on, 0 beyond the string's end; left: symbols to the string's end. Only
    suffixes that are not yet alone, and not yet compared to their ends, are sorted again.
    """
    _, of, counts = np.unique(first, return_inverse=True, return_counts=True)
    rank = (np.cumsum(counts) - counts)[of]
    n = np.int64(len(rank) + 1)
    live = np.flatnonzero((counts[of] > 1) & (left >= seen))
    while len(live):
        after = np.zeros(len(live), np.int64)
        inside = left[live] > seen
        after[inside] = rank[live[inside] + seen] + 1
        key = rank[live] * n + after
        order = np.argsort(key, kind="stable")
        live, key = live[order], key[order]
        group = key // n
        place = np.arange(len(key))
        group_start = np.maximum.accumulate(np.where(np.concatenate([[True], group[1:] != group[:-1]]), place, 0))
        new = np.concatenate([[True], key[1:] != key[:-1]])
        key_start = np.maximum.accumulate(np.where(new, place, 0))
        rank[live] = group + key_start - group_start
        size = np.diff(np.append(np.flatnonzero(new), len(key)))
        seen *= 2
        live = live[(np.repeat(size, size) > 1) & (left[live] >= seen)]
    return rank


def _ends(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, how many follow to the string's end) of the strings [begin, end), one after the other."""
    size = end - begin
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return at + np.repeat(begin, size), np.repeat(size, size) - at


def corpus_order(data: np.ndarray, begin: np.ndarray, end: np.ndarray, prefix: np.ndarray, s: Settings) -> np.ndarray:
    """A number for each byte of the texts [begin, end) of data, ascending in the order of the texts' suffixes (equal: equal).

    Prefix-free parsing: triggers cut the texts into phrases, which overlap by a trigger. A suffix is first ordered by the
    rest of its phrase, that is by the dictionary's suffix array, and then by the phrases after it, by that of the parse.
    """
    where, left = _ends(begin, end)
    whole = np.flatnonzero(left >= s.inner)
    places = where[whole]
    is_start = np.zeros(len(where), bool)
    is_start[whole] = C.span_hash(prefix, places, places + s.inner) % np.uint64(s.modulus) == 0
    is_start[np.cumsum(end - begin)[end > begin] - (end - begin)[end > begin]] = True
    starts = np.flatnonzero(is_start)  # of phrases, in `where`
    text = np.repeat(np.arange(len(begin)), end - begin)
    last = np.append(text[starts[1:]] != text[starts[:-1]], True)  # the last phrase of its text
    size = np.where(last, left[starts], np.append(starts[1:], 0) - starts + s.inner)
    # the dictionary: one copy of each phrase
    a = where[starts]
    _, one, of = np.unique(C.span_hash(prefix, a, a + size), return_index=True, return_inverse=True)
    inside, rest = _ends(a[one], a[one] + size[one])
    symbols, first = data[inside].astype(np.int64) + 1, np.zeros(len(inside), np.int64)
    for k in range(7):  # seven symbols of nine bits
        ahead = np.zeros(len(inside), np.int64)
        ahead[: max(0, len(inside) - k)] = symbols[k:]
        first = first << 9 | np.where(rest > k, ahead, 0)
    dictionary = suffix_ranks(first, rest, 7)
    phrase_at = np.cumsum(size[one]) - size[one]
    # the parse: phrases by their rank in the dictionary
    per_text = np.bincount(text[starts], minlength=len(begin))
    _, follow = _ends(np.cumsum(per_text) - per_text, np.cumsum(per_text))
    parse = suffix_ranks(dictionary[phrase_at[of]] + 1, follow, 1)
    next_ = np.where(last, 0, np.append(parse[1:], 0) + 1)
    phrase = np.cumsum(is_start) - 1
    rest_of = dictionary[phrase_at[of][phrase] + np.arange(len(where)) - starts[phrase]]
    return rest_of * np.int64(len(starts) + 1) + next_[phrase]


def _equal_neighbours(bodies: pa.Array, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(phrase number, first window, last window) of the runs of windows that stand more than once."""
    offsets, data = C.text_bytes(bodies)
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    prefix = C.prefix_hash(data)
    number = corpus_order(data, offsets[:-1], offsets[1:], prefix, s)
    begin, left = _ends(offsets[:-1], offsets[1:])
    begin = begin[left >= s.length]
    order = begin[np.argsort(number[begin], kind="stable")]
    string = C.span_hash(prefix, order, order + s.length)
    same = string[1:] == string[:-1]
    hit = np.zeros(len(data), bool)
    hit[order[1:][same]] = hit[order[:-1][same]] = True
    where = np.flatnonzero(hit)
    if not len(where):
        return (np.zeros(0, np.int64),) * 3
    who = np.searchsorted(offsets, where, "right") - 1
    new = np.concatenate([[True], (np.diff(where) != 1) | (np.diff(who) != 0)])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(where) - 1]])
    at = where - offsets[who]
    return who[new], at[new], at[last]


def sorted_suffixes(texts: DataFrame, s: Settings, chunk_bytes: int = 1 << 19) -> DataFrame:
    """(row, twin, first, last): repeated windows of phrases, which meet by trigger in sorted partitions."""
    names = ["row", "twin", "first", "last"]

    def solve(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        who, first, last = _equal_neighbours(table.column("body"), s)
        base = table.column("first").to_numpy()[who]
        return pa.RecordBatch.from_arrays([pa.array(table.column("row").to_numpy()[who]), pa.array(table.column("twin").to_numpy()[who]), pa.array((first + base).astype(np.int32)), pa.array((last + base).astype(np.int32))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            at = 0
            trigger = batch.column("trigger").to_numpy()
            starts = np.flatnonzero(np.diff(trigger)) + 1
            offsets, _ = C.text_bytes(batch.column("body"))
            while at < len(batch):  # cut at trigger changes, about chunk_bytes at a time
                later = starts[(starts > at) & (offsets[starts] - offsets[at] >= chunk_bytes)]
                end = int(later[0]) if len(later) else len(batch)
                if held and trigger[at] != held[-1].column("trigger")[-1].as_py():
                    yield solve(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(at, end - at))
                at = end
            if held and len(starts):
                last = int(starts[-1])
                table = pa.Table.from_batches(held)
                rest = len(batch) - last
                if rest < table.num_rows:
                    yield solve(table.slice(0, table.num_rows - rest))
                    held = [batch.slice(last)]
        if held:
            yield solve(pa.Table.from_batches(held))

    near = texts.select("trigger", "row", "twin", "first", "body").repartition("trigger").sortWithinPartitions("trigger")
    return near.mapInArrow(C.trimmed(run), "row long, twin long, first int, last int")


def crowded_suffixes(texts: DataFrame, s: Settings) -> DataFrame:
    """The same for phrases of crowded triggers: each suffix key is a row, counted before it is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 1000):
                part = batch.slice(a, 1000)
                who, at, key = _suffix_keys(part.column("body"), part.column("trigger").to_numpy(), s)
                take = pa.array(who)
                first = part.column("first").to_numpy()[who] + at
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), part.column("row").take(take), part.column("twin").take(take), pa.array(first.astype(np.int32))], ["key", "row", "twin", "first"])

    windows = texts.select("trigger", "row", "twin", "first", "body").mapInArrow(run, "key long, row long, twin long, first int")
    equal = C.materialise(windows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "equal")
    found = C.split_join(windows, equal, ["key"], "n", F.xxhash64("row", "first"))
    return found.select("row", "twin", "first", F.col("first").alias("last"))


def covered(rows: DataFrame, s: Settings) -> DataFrame:
    """Materialised (row, twin, spans: array<struct<first, last>>, rows): windows [first, last] that repeat, for rows with any."""
    since = C.mark()
    entries = C.materialise(dictionary_entries(rows, s), "phrases")
    # Triggers that occur once, which are nearly all of them, end here.
    triggers = entries.groupBy("trigger").agg(F.count("*").alias("n"), F.min("phrase").alias("lo"), F.max("phrase").alias("hi"))
    triggers = C.materialise(triggers.where("n > 1").selectExpr("trigger", "lo <> hi as mixed", "n"), "triggers")
    some = C.likely(entries, F.col("trigger"), C.bitmap_of(triggers.select(F.col("trigger").alias("key"))))
    found = C.materialise(C.split_join(some, triggers, ["trigger"], "n", F.xxhash64("row", "first")).drop("n"), "repeated")
    C.discard(entries, triggers)
    mixed = found.where("mixed").drop("mixed")
    counted = mixed.groupBy("trigger", "phrase").agg(F.count("*").alias("n"), F.min(F.struct("row", "twin", "first", "last")).alias("one"))
    counted = C.materialise(counted, "dictionary")
    # All windows of a phrase that occurs twice are known to repeat; its one copy is there for the others.
    whole = found.where("not mixed").select("row", "twin", "first", "last")
    copies = C.split_join(mixed, counted.where("n > 1").select("trigger", "phrase", "n"), ["trigger", "phrase"], "n", F.xxhash64("row", "first")).select("row", "twin", "first", "last")
    crowds = C.materialise(counted.groupBy("trigger").agg(F.count("*").alias("phrases")), "crowds")
    span = F.struct("trigger", (F.col("phrases") > s.crowd).alias("crowded"), "one.first", (F.col("one.last") + s.length).alias("end"))
    placed = C.split_join(counted, crowds, ["trigger"], "phrases", F.col("phrase"))
    asked = C.materialise(placed.select("one.row", "one.twin", span.alias("span")).groupBy("row", "twin").agg(F.collect_list("span").alias("spans")), "asked")
    sources = C.likely(rows.select("row", "twin", "text"), F.col("twin"), C.bitmap_of(asked.select(F.col("twin").alias("key"))))
    # rows that are equal in doc_id and text are one source
    texts = C.materialise(phrase_bytes(sources, asked).dropDuplicates(["trigger", "row", "twin", "first"]), "suffixes")
    single = sorted_suffixes(texts.where("not crowded"), s).unionAll(crowded_suffixes(texts.where("crowded"), s))
    every = whole.unionAll(copies).unionAll(single)
    # a row that is there many times says the same each time: sets, and how many rows there are
    spans = every.groupBy("row", "twin").agg(F.collect_set(F.struct("first", "last")).alias("spans"), F.count("*").alias("n"))
    out = C.materialise(spans.select("row", "twin", "spans", F.ceil(F.col("n") / F.size("spans")).alias("rows")), "spans")
    C.tidy(since, out)
    return out


def with_spans(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows with their spans (null: none). Rows that surely have none aren't shuffled."""
    bitmap = C.bitmap_of(found.select(F.col("twin").alias("key")))
    near, far = C.likely(rows, F.col("twin"), bitmap), C.likely(rows, F.col("twin"), bitmap, wanted=False)
    near = C.split_join(near, found.withColumnRenamed("rows", "n_rows"), ["row", "twin"], "n_rows", F.monotonically_increasing_id(), "left")
    return near.select(*rows.columns, "spans").unionAll(far.withColumn("spans", F.lit(None).cast(found.schema["spans"].dataType)))


def keep_mask(n: int, first: np.ndarray, last: np.ndarray, length: int) -> np.ndarray:
    """True for bytes that no window [first..last] covers."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, first, 1)
    np.add.at(change, last + length, -1)
    return np.cumsum(change)[:n] == 0


def _masks(batch: pa.RecordBatch, s: Settings) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, mask of those kept) of each text of a batch."""
    spans = batch.column("spans")
    offsets, body = C.text_bytes(batch.column("text"))
    for i in range(len(batch)):
        data, inner = body[offsets[i] : offsets[i + 1]], spans[i].values
        if inner is None or not len(inner):
            yield data, np.ones(len(data), bool)
        else:
            yield data, keep_mask(len(data), inner.field("first").to_numpy(), inner.field("last").to_numpy(), s.length)


def removal_digests(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, one row for each row of docs."""
    rows = keyed(docs.select("doc_id", "text"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(4)]
            for data, keep in _masks(batch, settings):
                runs = int(np.count_nonzero(np.diff(np.concatenate([[True], keep]).astype(np.int8)) == -1))
                for x, v in zip(out, (len(data), int(len(data) - keep.sum()), runs, hashlib.sha256(data[keep].tobytes()).hexdigest())):
                    x.append(v)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, out)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return with_spans(rows, covered(rows, settings)).select("doc_id", "text", "spans").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """docs with repeated strings cut out of their texts. Where a cut would split a UTF-8 character, the rest of it goes too."""
    names = docs.columns
    rows = keyed(docs.select(*(F.col(c).alias(f"__{c}") for c in names), "doc_id", "text"))
    found = covered(rows.select("row", "twin", "text"), settings)
    rows = rows.select(*(f"__{c}" for c in names if c != "text"), "text", "row", "twin")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, own = batch.column("text").to_pylist(), {c: batch.column(f"__{c}") for c in names if c != "text"}
            touched = [x.as_py() is not None for x in batch.column("spans")]
            if any(touched):
                for i, (data, keep) in enumerate(_masks(batch, settings)):
                    if touched[i]:
                        texts[i] = data[keep].tobytes().decode("utf-8", "ignore")
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else own[c] for c in names], names)

    return with_spans(rows, found).drop("row", "twin").mapInArrow(run, C.ddl(docs))


def op10_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_digests(C.table(spark, sf_dir, "documents"))
