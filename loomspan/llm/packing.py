"""Best-fit-decreasing packing of token sequences, with a segment tree over remaining capacities.

Best fit looks only at lengths, so the plan is made for the histogram of lengths (at most `limit` entries, whatever the
corpus): lengths go down, and a segment tree over the remaining capacities finds the tightest class of open bins in
logarithmic time. A bin that has taken a piece is the tightest for the next one of that length while it has room, so best
fit fills one bin of the class after the other, each with floor(room / length) pieces. Bins of a class are alike, so that
is a short list of runs: "pieces number r .. r+n-1 of this length go to bins b .. b+n-1 at this offset". Bins and their
remaining capacities are those of best-fit decreasing piece by piece. Executors then number the pieces of each length (a
count per task and length, summed over tasks) and look their bin up in the plan. Its size is bounded by the limit and not
by the corpus, so it is broadcast.

Documents longer than the limit are cut into full pieces; only the last may be shorter. Null text counts as empty
and packs as the single end id. Repeated rows, equal ids and null ids are packed row by row. An empty table gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.llm import bpe
from loomspan.llm import common as C

LIMIT, END = 4096, 1


class CapacityTree:
    """Counts of open bins by remaining capacity; `tightest(n)` is the smallest capacity of at least n with a bin."""

    def __init__(self, limit: int):
        self.size = 1 << limit.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, capacity: int, n: int) -> None:
        at = capacity + self.size
        while at:
            self.count[at] += n
            at >>= 1

    def tightest(self, n: int) -> int | None:
        at = n + self.size
        if self.count[at]:
            return n
        while at > 1:  # up until a right neighbour has bins, then down to its leftmost one
            if not at & 1 and self.count[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return None


def plan(histogram: dict[int, int], limit: int = LIMIT) -> np.ndarray:
    """Runs (length, first rank, count, first bin, offset) of best-fit decreasing for so many pieces of each length."""
    tree, runs, bins = CapacityTree(limit), [], 0
    open_: dict[int, deque[tuple[int, int]]] = {}  # remaining capacity: ranges of bins (first, count)
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, fit = limit, limit // length
                first, n = bins, -(-left // fit)
                bins += n
            else:
                fit = room // length
                first, n = open_[room].popleft()
                tree.add(room, -n)
            full = min(n, left // fit)
            rest = left - full * fit if full < n else 0
            for at, count, times in ((first, full, fit), (first + full, 1, rest)):
                if not count or not times:
                    continue
                for k in range(times):  # pieces of one length are alike, so they are dealt as blocks, one for each place
                    runs.append((length, rank, count, at, limit - room + k * length))
                    rank += count
                if after := room - times * length:
                    open_.setdefault(after, deque()).append((at, count))
                    tree.add(after, count)
            left -= full * fit + rest
            used = full + (rest > 0)
            if used < n:
                open_.setdefault(room, deque()).appendleft((first + used, n - used))
                tree.add(room, n - used)
    return np.array(runs, np.int64).reshape(-1, 5)


class WordBPE:
    """Ids of a tokenizers file of the lower-casing word-end BPE kind; its parts are remembered as in bpe.ByteBPE.

    Parts of plain ASCII and Latin-1 letters merge on the matrices of bpe.encode_pieces; other parts go through the
    tokenizers library, and so do whole texts with a special token's string, which is found before anything else, and all
    texts where the file is of another kind.
    """

    PLAIN = re.compile(r"[\n\x20-\x7eÀ-ÖØ-öø-ÿ]*").fullmatch
    SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+").findall

    spaced = False

    def __init__(self, path: str):
        import json

        self.path, self.library = path, None
        self.memory: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, norm, pre = spec["model"], spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
        kinds = [x.get("type") for x in norm.get("normalizers", [])], [x.get("type") for x in pre.get("pretokenizers", [])]
        added = spec.get("added_tokens") or []
        self.special = [t["content"] for t in added]
        self.matrices = not any(t.get("normalized") for t in added) and model.get("type") == "BPE" and model.get("end_of_word_suffix") == "</w>" and kinds == (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"])
        if self.matrices:
            vocab, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
            left, right, new = (np.array([vocab[f(m)] for m in merges], np.int64) for f in (lambda m: m[0], lambda m: m[1], lambda m: m[0] + m[1]))
            self.pairs = bpe.PairTable(left, right, np.arange(len(merges)), new)
            names = self._byte_names()
            self.inner = np.array([vocab[c] for c in names], np.int64)
            self.last = np.array([vocab[c + "</w>"] for c in names], np.int64)

    def by_library(self, parts: list[str]) -> list[bytes]:
        if self.library is None:
            from tokenizers import Tokenizer

            C.os_environment()
            self.library = Tokenizer.from_file(self.path)
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(parts, add_special_tokens=False)]

    @staticmethod
    def _byte_names() -> list[str]:
        """The public byte-level alphabet: printable Latin-1 stands for itself, other bytes for 256, 257, ..."""
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        shifted = iter(range(256, 512))
        return [chr(b) if b in plain else chr(next(shifted)) for b in range(256)]

    def learn(self, parts: list[str]) -> None:
        words = self.words
        if len(words) > bpe.REMEMBERED:
            words.clear()
        easy, cut, hard = [], [], []
        for p in parts:
            if p.isascii() and (p.isalpha() or (p[:-1].isalpha() and p[-1] in ".,;:!?")):
                low = p.lower()
                easy.append(p)
                cut.append((low,) if low.isalpha() else (low[:-1], low[-1]))
            elif self.PLAIN(p):
                easy.append(p)
                cut.append(self.SPLIT(p.lower()))
            else:
                hard.append(p)
        new = list({w for c in cut for w in c}.difference(words))
        if new:
            raw = [w.encode() for w in new]
            lens = np.fromiter(map(len, raw), np.int64, len(raw))
            data = np.frombuffer(b"".join(raw), np.uint8)
            ids = self.inner[data]
            ends = np.cumsum(lens) - 1
            ids[ends] = self.last[data[ends]]
            words.update(zip(new, bpe.encode_pieces(ids, lens, self.pairs)))
        self.memory.update((p, words[c[0]] if len(c) == 1 else b"".join(map(words.__getitem__, c))) for p, c in zip(easy, cut))
        if hard:
            self.memory.update(zip(hard, self.by_library(hard)))

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.matrices:
            return self.by_library(texts)
        whole = [i for i, t in enumerate(texts) if any(x in t for x in self.special)]
        if not whole:
            return bpe.encode_parts(self, texts)
        out = bpe.encode_parts(self, ["" if any(x in t for x in self.special) else t for t in texts])
        for i, ids in zip(whole, self.by_library([texts[i] for i in whole])):
            out[i] = ids
        return out


def tokenised(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT, end: int = END, ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and with `ids` the piece's ids themselves.

    Also task and rank: the number of the task, and of the piece among those of its length in that task.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    tail = end.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.coder(WordBPE, tokenizer_path)
        task, seen = TaskContext.get().partitionId(), np.zeros(limit + 1, np.int64)
        for batch in batches:
            for a, b, texts in bpe.texts_of(batch.column("text")):
                doc, piece, start, length, crc, rank, kept = [], [], [], [], [], [], []
                for i, found in enumerate(coder.encode(texts)):
                    found += tail
                    n = len(found) // 4
                    for k in range(0, n, limit):
                        part = found[4 * k : 4 * min(k + limit, n)]
                        size = len(part) // 4
                        for column, value in zip((doc, piece, start, length, crc, rank), (a + i, k // limit, k, size, zlib.crc32(part), int(seen[size]))):
                            column.append(value)
                        seen[size] += 1
                        if ids:
                            kept.append(part)
                columns = [batch.column("doc_id").take(pa.array(doc, pa.int64())), *(pa.array(x, pa.int64()) for x in (piece, start, length, crc)), pa.array([task] * len(doc), pa.int32()), pa.array(rank, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.binary())] * ids, names + ["ids"] * ids)
        coder.memory.clear()  # whole parts; their words stay remembered

    return docs.select("doc_id", "text").mapInArrow(C.trimmed(run, keep=True), f"doc_id {kind}, piece long, start long, length long, ids_crc32 long, task int, rank long" + ", ids binary" * ids)


def place(pieces: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Add sequence_id and offset to pieces that have task, rank and length. `pieces` must be a materialised table."""
    counts = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `limit` rows
    runs = plan(histogram, limit)
    order = np.lexsort((runs[:, 1], runs[:, 0])) if len(runs) else []
    shared = pieces.sparkSession.sparkContext.broadcast(runs[order])
    kept = [c for c in pieces.columns if c not in ("task", "rank", "first")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        # length and rank in one sortable number: ranks within 2**48
        key = table[:, 0] << 48 | table[:, 1]
        for batch in batches:
            rank = batch.column("first").to_numpy() + batch.column("rank").to_numpy()
            at = np.searchsorted(key, batch.column("length").to_numpy() << 48 | rank, "right") - 1
            sequence = table[at, 3] + rank - table[at, 1]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sequence), pa.array(table[at, 4])], [*kept, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.select(kept).schema)
    return pieces.join(firsts, ["task", "length"]).select(*kept, "rank", "first").mapInArrow(run, f"{schema}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT, end: int = END, ids: bool = False) -> DataFrame:
    """Tokenise (once: the pieces are written to the shared folder), plan, and place: one row per piece."""
    return place(C.materialise(tokenised(docs, tokenizer_path, limit, end, ids), "pieces"), limit)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves, from pack(..., ids=True). Each has at most `limit` ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.aggregate(parts, F.lit(b""), lambda all_, p: F.concat(all_, p["ids"])).alias("ids"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(C.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
