"""Byte-level BPE, encoding and decoding, on length-bucketed padded numpy matrices.

Distinct pieces are put into matrices of one row each, bucketed by length and padded with -1. In each round every row
merges its leftmost pair of minimum rank: ranks come from a hashed pair table, the merged row closes up, and rows
without a mergeable pair leave the matrix. Texts are split at single spaces first: there the pattern always has a
boundary, so a part can be encoded once and remembered (`REMEMBERED` parts per worker, then the memory starts anew; it
changes no result). Texts with other white space next to a space are split by the pattern as a whole.

Null text counts as empty: no ids, digests of no bytes. Repeated rows are encoded each. An empty table gives an empty
result. Texts of any length are whole; a piece of over `LONG` symbols merges through a heap instead of a matrix.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from loomspan.llm import common as C

REMEMBERED = 300_000
LONG = 256
NONE = np.int64(1) << 40


class PairTable:
    """(left id, right id) to (rank, merged id) in an open-addressing table, looked up for whole matrices."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray):
        bits = max(8, int(len(left)).bit_length() + 3)
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.key = np.full(1 << bits, -1, np.int64)
        self.value = np.full(1 << bits, NONE, np.int64)  # rank << 20 | merged id
        self.probes = 0
        key, value = left.astype(np.int64) << 20 | right, rank.astype(np.int64) << 20 | merged
        at, open_ = self._slot(key), np.arange(len(key))
        while len(open_):  # one contender for each free slot gets in, the others move on by one
            slot = at[open_]
            free = self.key[slot] == -1
            _, first = np.unique(np.where(free, slot, -1 - np.arange(len(slot))), return_index=True)
            first = first[free[first]]
            self.key[slot[first]], self.value[slot[first]] = key[open_[first]], value[open_[first]]
            rest = np.ones(len(open_), bool)
            rest[first] = False
            open_ = open_[rest]
            at[open_] = (at[open_] + 1) & self.mask
            self.probes += 1
        self.as_dict = dict(zip(key.tolist(), value.tolist()))

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * C.BASE) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """rank << 20 | merged id, NONE where the pair has no merge (or is padding)."""
        key = np.where(right < 0, np.int64(-2), left.astype(np.int64) << 20 | right)
        slot = self._slot(key)
        seen = self.key[slot]
        out = np.where(seen == key, self.value[slot], NONE)
        unsure = np.flatnonzero(((seen != key) & (seen != -1)).ravel())
        for _ in range(self.probes):
            if not len(unsure):
                break
            slot.ravel()[unsure] = s = (slot.ravel()[unsure] + 1) & self.mask
            seen = self.key[s]
            hit = seen == key.ravel()[unsure]
            out.ravel()[unsure[hit]] = self.value[s[hit]]
            unsure = unsure[~hit & (seen != -1)]
        return out


def merge_rows(rows: np.ndarray, pairs: PairTable) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Merge all rows of a padded matrix; yields (row numbers, their final padded rows) as rows finish."""
    who = np.arange(len(rows))
    while len(rows):
        if rows.shape[1] < 2:
            yield who, rows
            return
        found = pairs.find(rows[:, :-1], rows[:, 1:])
        at = (found >> 20).argmin(1)
        best = found[np.arange(len(rows)), at]
        live = best != NONE
        if not live.all():
            yield who[~live], rows[~live]
            rows, who, at, best = rows[live], who[live], at[live], best[live]
            if not len(rows):
                return
        rows[np.arange(len(rows)), at] = best & 0xFFFFF
        column = np.arange(rows.shape[1] - 1)[None, :]
        rows = np.take_along_axis(rows, column + (column > at[:, None]), 1)


def merge_long(ids: list[int], pairs: PairTable) -> list[int]:
    """The same merges for one long piece: a heap of (rank, place) over a doubly linked list."""
    n = len(ids)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap: list[tuple[int, int, int, int]] = []

    def push(i: int) -> None:
        j = after[i]
        if j < n and (v := pairs.as_dict.get(ids[i] << 20 | ids[j])) is not None:
            heapq.heappush(heap, (v >> 20, i, ids[i], ids[j]))

    for i in range(n):
        push(i)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or ids[i] != a or ids[j] != b:
            continue
        ids[i] = pairs.as_dict[a << 20 | b] & 0xFFFFF
        alive[j] = False
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        push(i)
        if before[i] >= 0:
            push(before[i])
    return [x for x, ok in zip(ids, alive) if ok]


def encode_pieces(first_ids: np.ndarray, lens: np.ndarray, pairs: PairTable) -> list[bytes]:
    """Little-endian uint32 ids of every piece; first_ids has the pieces' first ids in a row, lens how many each has."""
    out = [b""] * len(lens)
    starts = np.cumsum(lens) - lens
    order = np.argsort(lens, kind="stable")
    sizes = lens[order]
    first = int(np.searchsorted(sizes, 1))
    while first < len(order):
        longest = int(sizes[first])
        if longest > LONG:
            for i in order[first:]:
                out[i] = np.array(merge_long(first_ids[starts[i] : starts[i] + lens[i]].tolist(), pairs), "<u4").tobytes()
            break
        widest = min(LONG, max(longest + longest // 8, 4))
        last = min(int(np.searchsorted(sizes, widest, "right")), first + max(1, (1 << 18) // widest))
        take = order[first:last]
        column = np.arange(int(sizes[last - 1]))[None, :]
        inside = column < lens[take][:, None]
        rows = np.where(inside, first_ids[np.where(inside, starts[take][:, None] + column, 0)], -1)
        for who, done in merge_rows(rows, pairs):
            filled = done >= 0
            flat, ends = done[filled].astype("<u4").tobytes(), np.cumsum(filled.sum(1)) * 4
            begin = 0
            for i, end in zip(take[who].tolist(), ends.tolist()):
                out[i] = flat[begin:end]
                begin = end
        first = last
    return out


class ByteBPE:
    """The encoding that a .tiktoken rank file and a splitting pattern define."""

    spaced = True

    def __init__(self, ranks_path: str, pattern: str):
        import regex

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.split = regex.compile(pattern).findall
        self.token = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            self.token[r] = t
        self.first = np.full(256, -1, np.int64)
        for t, r in ranks.items():
            if len(t) == 1:
                self.first[t[0]] = r
        # Each way to cut a token into two tokens is a mergeable pair whose rank is the token's id.
        cuts = [(ranks[t[:k]], ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        left, right, rank = (np.array(x, np.int64) for x in zip(*cuts))
        self.pairs = PairTable(left, right, rank, rank)
        self.whole = {t: r.to_bytes(4, "little") for t, r in ranks.items()}
        self.memory: dict[str, bytes] = {}
        self.sizes = np.fromiter(map(len, self.token), np.int64, len(self.token))
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.bytes = np.frombuffer(b"".join(self.token), np.uint8)

    def pieces(self, found: list[str]) -> list[bytes]:
        """Ids of pattern matches. A match that is a token itself is that token."""
        raw = [p.encode() for p in found]
        whole = [self.whole.get(r) for r in raw]
        left = [r for r, w in zip(raw, whole) if w is None]
        merged = iter(encode_pieces(self.first[np.frombuffer(b"".join(left), np.uint8)], np.fromiter(map(len, left), np.int64, len(left)), self.pairs))
        return [next(merged) if w is None else w for w in whole]

    def learn(self, parts: list[str]) -> None:
        """Encode parts that are not yet remembered. One space and letters are one match; the pattern cuts the others."""
        cut = [(" " + p,) if p.isalpha() else self.split(p[1:] if p.startswith(HEAD) else " " + p) for p in parts]
        found = list({p for c in cut for p in c})
        ids = dict(zip(found, self.pieces(found)))
        self.memory.update((part, ids[c[0]] if len(c) == 1 else b"".join(map(ids.__getitem__, c))) for part, c in zip(parts, cut))

    def encode(self, texts: list[str]) -> list[bytes]:
        return encode_parts(self, texts)

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens' bytes in a row: one gather over the vocabulary's bytes."""
        if not len(ids):
            return b""
        size = self.sizes[ids]
        end = np.cumsum(size)
        return self.bytes[np.arange(end[-1]) + np.repeat(self.starts[ids] - end + size, size)].tobytes()


#: Stands before the first part of a text, which has no space before it.
HEAD = "\0"


def encode_parts(coder, texts: list[str]) -> list[bytes]:
    """Split texts at spaces, have coder.learn() see the parts that are new, and join what coder.memory has of each.

    Where coder.spaced, a part stands for a space and what follows it; texts in which other white space (or another
    space) is next to a space are one part each. Such parts are never remembered, so new ones alone need looking at.
    """
    memory = coder.memory
    if len(memory) > REMEMBERED:
        memory.clear()
    split = [t.split(" ") if t else [] for t in texts]
    if coder.spaced:
        for k, (t, parts) in enumerate(zip(texts, split)):
            if parts:
                parts[0] = HEAD + parts[0]
                if HEAD in t:
                    split[k] = [HEAD + t]
    new = set(chain.from_iterable(split)).difference(memory)
    if coder.spaced:
        odd = {p for p in new if not p or p[0].isspace() or p[-1].isspace() or p == HEAD or (p[0] == HEAD and p[1].isspace())}
        if odd:
            split = [parts if odd.isdisjoint(parts) else [HEAD + t] for t, parts in zip(texts, split)]
            new = set(chain.from_iterable(split)).difference(memory)
    if new:
        coder.learn(list(new))
    out = [b"".join(map(memory.__getitem__, parts)) for parts in split]
    for p in new:
        if len(p) > 64 or p.startswith(HEAD):  # these hardly come again
            del memory[p]
    return out


_CODERS: dict[tuple, object] = {}
C.WORKER_CACHES.append(_CODERS)


def coder(kind: Callable, *key: str):
    """One coder for each worker process and vocabulary."""
    if (kind, *key) not in _CODERS:
        _CODERS[kind, *key] = kind(*key)
    return _CODERS[kind, *key]


def texts_of(column: pa.Array, batch_bytes: int = 1 << 20) -> Iterator[tuple[int, int, list[str]]]:
    """Whole texts as Python strings, about batch_bytes at a time."""
    offsets, _ = C.text_bytes(column)
    for a, b in C.slices(offsets, batch_bytes):
        yield a, b, [t or "" for t in column.slice(a, b - a).to_pylist()]


def encode_table(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, ids binary): little-endian uint32 ids of every text."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(ByteBPE, ranks_path, pattern)
        for batch in batches:
            for a, b, texts in texts_of(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(bpe.encode(texts), pa.binary())], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids binary")


def decode_table(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, ids, decoded binary) from (doc_id, ids)."""
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(ByteBPE, ranks_path, pattern)
        for batch in batches:
            column = batch.column("ids")
            offsets, body = C.text_bytes(column)
            for a, b in C.slices(offsets):
                found = [bpe.decode(body[offsets[i] : offsets[i + 1]].view("<u4")) if offsets[i] % 4 == 0 else bpe.decode(np.frombuffer(body[offsets[i] : offsets[i + 1]].tobytes(), "<u4")) for i in range(a, b)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), column.slice(a, b - a), pa.array(found, pa.binary())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids binary, decoded binary")


def digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode, decode the ids, and digest both, in one pass."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(ByteBPE, ranks_path, pattern)
        for batch in batches:
            for a, b, texts in texts_of(batch.column("text")):
                ids = bpe.encode(texts)
                rows = [(len(x) // 4, hashlib.sha256(x).hexdigest(), hashlib.sha256(bpe.decode(np.frombuffer(x, "<u4"))).hexdigest()) for x in ids]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), *map(pa.array, zip(*rows))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(C.trimmed(run, keep=True), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(C.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
