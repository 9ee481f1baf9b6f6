"""Corpus operators against brute force, round trips, libraries and held-out accuracy, on small tables with every odd case."""

import base64
import bisect
import collections
import hashlib
import math
import random
import re
import struct
import time
import zlib

import numpy as np
import pytest

pytest.importorskip("loomspan.llm")

import public_tokenizers as tokenizers_  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from loomspan.llm import bpe, common, compression_quality, jaccard, packing, pii, repeats, telephony, toxicity, vector_graph, warc  # noqa: E402

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, score string, row string, spans int, h1 int"


def docs_of(spark, texts):
    """Documents with columns whose names clash with those that operators use inside."""
    return spark.createDataFrame([(i, t, "s", "r", 1, 2) for i, t in texts], DOCS)


def sample(spark, n=200):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(n).collect()
    return [(r.doc_id, r.text) for r in rows]


ODD = [(9001, None), (9002, ""), (9003, " \n\t "), (9004, "one"), (9005, "two words"), (9006, "a" * 70_000), (9007, "word " * 9_000), (9008, "日本 é 𝒳 " * 50), (9009, "two words"), (9009, "two words"), (None, "no id here at all")]


def empty(spark):
    return spark.createDataFrame([], DOCS)


# ---------------------------------------------------------------- 1


def test_graph_finds_neighbours(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(1500, 16)), np.repeat(rng.normal(size=(1, 16)), 300, 0)])
    rows = [(i, [float(v) for v in r], "x") for i, r in enumerate(x)]
    odd = [(9000, None, "x"), (9001, [0.0] * 16, "x"), (9002, [float("nan")] + [1.0] * 15, "x"), (9003, [None] + [1.0] * 15, "x"), (9004, [float("inf")] * 16, "x"), (None, [1.0] * 16, "x"), (5, rows[5][1], "x")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, shard string")
    got = collections.defaultdict(list)
    for r in vector_graph.nearest(df, df.where("vec_id % 100 = 0"), settings=vector_graph.Settings(shard_rows=500)).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == set(range(0, 1800, 100))
    hits = 0
    for q, found in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(len(x)), d))[:10]
        assert found == sorted(found, key=lambda f: (f[1], f[0])) and len(found) == 10
        assert all(abs(s - d[v]) < 1e-12 for v, s in found)
        hits += len({v for v, _ in found} & set(best.tolist()))
    assert hits / (10 * len(got)) >= 0.9


def test_graph_small_tables(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 3.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")
    got = vector_graph.nearest(df, df.where("vec_id = 0")).orderBy("rank").collect()
    assert [(r.rank, r.vec_id, r.score) for r in got] == [(1, 2, 0.0), (2, 1, 1.0)]
    assert vector_graph.nearest(df.limit(0), df.limit(0)).count() == 0


def test_graph_of_frequent_ids_and_vectors(spark):
    """Neither 3,000 rows of one id nor 3,000 ids of one vector reach a task whole; the least vector and the least ids count."""
    rng = np.random.default_rng(2)
    rows = [(7, [float(v) for v in rng.normal(size=8) + 5]) for _ in range(2999)] + [(7, [-9.0] * 8)] + [(10_000 + i, [1.0] * 8) for i in range(3000)] + [(i, [float(v) for v in rng.normal(size=8)]) for i in range(100, 200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(9)
    nodes = vector_graph.distinct_nodes(df, 11)
    assert nodes.count() == 102 and {tuple(r.ids) for r in nodes.where("embedding[0] = 1 and size(ids) > 1").collect()} == {tuple(range(10_000, 10_011))}
    got = vector_graph.nearest(df, df.where("vec_id in (7, 10000, 10005)")).collect()
    near = {q: [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] for q in (7, 10000, 10005)}
    assert near[10000] == [(10_001 + i, 0.0) for i in range(10)] and near[10005] == [(10_000 + i, 0.0) for i in range(11) if i != 5]
    assert len(near[7]) == 10 and all(s == pytest.approx(math.sqrt(sum((a + 9) ** 2 for a in dict(rows[3000:])[v])), rel=1e-12) for v, s in near[7])


def test_a_search_sees_few_nodes(spark):
    """What a search sees grows slower than the shard: twice the rows, clearly less than twice the nodes."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(4000, 16))
    s = vector_graph.Settings(search_beam=24)
    share = []
    for n in (1000, 4000):
        df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x[:n])], "vec_id long, embedding array<double>")
        share.append(vector_graph.seen_share(vector_graph.build_index(vector_graph.distinct_nodes(df, 11), 1, s), x[:20], s))
    assert share[1] < 0.45 * share[0] and share[1] < 0.15


# ---------------------------------------------------------------- 2 and 4


@pytest.mark.parametrize("run,label", [(compression_quality.quality_scores, "quality"), (toxicity.toxicity_scores, "toxic")])
def test_classifiers_on_odd_tables(spark, run, label):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    texts = sample(spark) + ODD
    got = run(docs_of(spark, texts), labels).collect()
    assert len(got) == len(texts) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    fold = {"quality": (3, 1), "toxic": (5, 0)}[label]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % fold[0] == fold[1]) for r in got if r.doc_id is not None)
    assert run(empty(spark), labels).count() == 0
    assert len({r.score for r in run(docs_of(spark, ODD), labels.limit(0)).collect()}) == 1


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    labels = {r.doc_id: r for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    for query, column, least in ((compression_quality.op2_compression_quality, "quality", 0.93), (toxicity.op4_toxicity, "toxic", 0.97)):
        rows = [(r.predicted, labels[r.doc_id][column]) for r in query(spark, d).where("held_out").collect() if r.doc_id in labels]
        assert np.mean([p == y for p, y in rows]) >= least


def test_toxicity_ignores_label_columns(spark):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    texts = sample(spark)
    a = toxicity.toxicity_scores(docs_of(spark, texts), labels).collect()
    b = toxicity.toxicity_scores(docs_of(spark, texts), labels.where(common.bucket_of("doc_id", 5) != 0)).collect()
    assert sorted((r.doc_id, r.score) for r in a) == sorted((r.doc_id, r.score) for r in b)


def scalar_ftrl(examples, s):
    """FTRL-proximal one coordinate at a time: what each weight and the bias are in the end."""
    z, n, bias = collections.defaultdict(float), collections.defaultdict(float), [0.0, 0.0]

    def weight(j):
        if abs(z[j]) <= s.l1:
            return 0.0
        return (math.copysign(s.l1, z[j]) - z[j]) / ((s.beta + math.sqrt(n[j])) / s.alpha + s.l2)

    def shift():
        return -bias[0] / ((s.beta + math.sqrt(bias[1])) / s.alpha)

    order = np.random.default_rng(7)
    for _ in range(s.epochs):
        for k in order.permutation(len(examples)):
            x, y = examples[k]
            w, b = {j: weight(j) for j in x.tolist()}, shift()
            g = 1 / (1 + math.exp(-sum(w.values()) - b)) - y
            for j in w:
                z[j] += g - (math.sqrt(n[j] + g * g) - math.sqrt(n[j])) / s.alpha * w[j]
                n[j] += g * g
            bias[0] += g - (math.sqrt(bias[1] + g * g) - math.sqrt(bias[1])) / s.alpha * b
            bias[1] += g * g
    return {j: weight(j) for j in z if weight(j)}, shift()


def test_ftrl_equals_a_scalar_loop():
    rng = np.random.default_rng(3)
    examples = [(np.unique(rng.integers(0, 40, 12)).astype(np.int32), 0) for _ in range(60)]
    examples = [(x, int((x < 8).sum() > 2)) for x, _ in examples]
    s = toxicity.Settings(bits=6, l1=0.5)
    model, (weights, bias) = toxicity.train(examples, s), scalar_ftrl(examples, s)
    assert model.index.tolist() == sorted(weights) and 0 < len(weights) < 40
    assert model.weight.tolist() == pytest.approx([weights[j] for j in sorted(weights)], rel=1e-9) and model.bias == pytest.approx(bias, rel=1e-9)


def brute_features(text):
    """The distinct unigrams, bigrams and skip-grams of a text."""
    w = re.findall(rb"[0-9a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))
    return {(a,) for a in w} | set(zip(w, w[1:])) | {(a, None, b) for a, b in zip(w, w[2:])}


def test_toxicity_features_and_scores(spark):
    texts = ["a b a b c", "One two, THREE two one", "", "é x é x", "word " * 30]
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])]).astype(np.int64)
    row, col = toxicity.features(*common.joined(offsets, np.frombuffer("".join(texts).encode(), np.uint8), 0, len(texts)), 40)
    assert [len(np.unique(col[row == i])) for i in range(len(texts))] == [len(brute_features(t)) for t in texts]
    row, col = toxicity.features(*common.joined(offsets, np.frombuffer("".join(texts).encode(), np.uint8), 0, len(texts)), 12)
    index = np.unique(col)[::2]
    model = toxicity.Model(index, np.linspace(-1, 1, len(index)), 0.25, 12)
    weights = dict(zip(index.tolist(), np.linspace(-1, 1, len(index)).astype(np.float32).tolist()))
    got = {r.doc_id: r.score for r in toxicity.score(docs_of(spark, list(enumerate(texts))), model).collect()}
    for i in range(len(texts)):
        assert got[i] == pytest.approx(1 / (1 + math.exp(-0.25 - sum(weights.get(j, 0.0) for j in set(col[row == i].tolist())))), abs=1e-7)


def test_quality_scores_are_size_differences(spark):
    """The score is the calibrated difference of the sizes of all blocks of the whole text under either dictionary."""
    import zstandard

    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    texts = sample(spark, 60) + [t for t in ODD if t[0] is not None and t[0] != 9009]
    model = compression_quality.fit(docs_of(spark, sample(spark)), labels, "quality")
    size = lambda raw, block: len(zstandard.ZstdCompressor(level=model.level, dict_data=zstandard.ZstdCompressionDict(raw), write_content_size=False, write_checksum=False, write_dict_id=False).compress(block))
    got = {r.doc_id: r.score for r in compression_quality.score(docs_of(spark, texts), model).collect()}
    for i, t in texts:
        body = (t or "").encode()
        blocks = [body[k : k + model.block] for k in range(0, len(body), model.block)]
        d = sum(size(model.bad, b) - size(model.good, b) for b in blocks) / max(len(body), 1)
        assert got[i] == pytest.approx(1 / (1 + math.exp(-max(-35, min(35, d * model.slope + model.shift)))), abs=1e-8)


@pytest.mark.parametrize("module,label", [(compression_quality, "quality"), (toxicity, "toxic")])
def test_fits_ignore_order_and_repeats(spark, module, label):
    labels, docs = spark.read.parquet(f"{SMALL}/labels.parquet"), docs_of(spark, sample(spark))
    one = module.fit(docs, labels, label)
    both = labels.select("doc_id", label).limit(0).unionAll(spark.createDataFrame([(777_777, 0), (777_777, 1)], f"doc_id long, {label} int").select("doc_id", F.col(label).cast(labels.schema[label].dataType)))
    two = module.fit(docs.unionAll(docs).repartition(7), labels.select("doc_id", label).unionAll(labels.select("doc_id", label)).unionAll(both).repartition(5), label)
    assert all(np.array_equal(getattr(one, f), getattr(two, f)) for f in one.__dataclass_fields__)


def test_samples_are_bounded_in_bytes(spark):
    docs = docs_of(spark, [(i, "x" * 1000) for i in range(50)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, toxic int")
    sample_, prior = common.labelled(docs, labels, "toxic", 20, 2000, 5500)
    assert prior == 0.5 and {r.label: r.n for r in sample_.groupBy("label").agg(F.count("*").alias("n")).collect()} == {0: 5, 1: 5}


# ---------------------------------------------------------------- 3


def best_fit_rooms(sizes, limit):
    """What every bin has left after best fit decreasing, piece by piece."""
    open_ = []
    for s in sorted(sizes, reverse=True):
        at = bisect.bisect_left(open_, s)
        bisect.insort(open_, (open_.pop(at) if at < len(open_) else limit) - s)
    return open_


@pytest.mark.parametrize("seed", range(10))
def test_plan_is_best_fit(seed):
    rnd = random.Random(seed)
    for _ in range(250):
        limit = rnd.choice([7, 24, 64, 4096])
        kinds = [rnd.randint(1, limit) for _ in range(rnd.randint(1, 12))]
        sizes = [rnd.choice(kinds) for _ in range(rnd.randint(0, 120))]
        runs, places = packing.plan(collections.Counter(sizes), limit), collections.defaultdict(list)
        ranks = collections.defaultdict(set)
        for length, rank, n, first, offset in runs:
            assert ranks[length].isdisjoint(range(rank, rank + n))
            ranks[length].update(range(rank, rank + n))
            for k in range(n):
                places[first + k].append((offset, length))
        for found in places.values():
            end = 0
            for offset, length in sorted(found):
                assert offset == end
                end += length
            assert end <= limit
        assert {k: len(v) for k, v in ranks.items()} == collections.Counter(sizes)
        assert sorted(limit - sum(length for _, length in p) for p in places.values()) == best_fit_rooms(sizes, limit)


def test_plan_fills_the_tightest_bin():
    assert packing.plan({14: 10, 5: 11, 3: 11}, 24)[:, 3].max() + 1 == 10


@pytest.mark.parametrize("scale", [10, 10**9])
def test_plan_stays_short(scale):
    """The broadcast plan depends on the limit and hardly on the corpus."""
    rnd = random.Random(1)
    assert len(packing.plan({k: int(scale * rnd.random() * 4096 / k) + 1 for k in range(1, 4097)})) < 200_000


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    path = tokenizers_.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = sample(spark, 60) + [t for t in ODD if t[0] != 9009] + [(9010, "İ Σας x y ² ª <|endoftext|> don't")]
    packed = packing.pack(docs_of(spark, texts), path, ids=True)
    rows = packed.collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
    for doc, text in texts:
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        got = sorted(by_doc[doc], key=lambda r: r.piece)
        assert np.frombuffer(b"".join(r.ids for r in got), "<u4").tolist() == ids
        assert [r.start for r in got] == list(range(0, len(ids), 4096))
    for found in by_sequence.values():
        end = 0
        for r in sorted(found, key=lambda r: r.offset):
            assert r.offset == end
            end += r.length
        assert end <= 4096
    assert all(len(r.ids) <= 4 * 4096 for r in packing.sequences(packed).collect())
    assert packing.pack(empty(spark), path).count() == 0


# ---------------------------------------------------------------- 5

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0


def brute_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]:
                out.append((m.start(), k, m.end()))
    return ",".join(f"{list(PATTERNS)[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_pii_base_spans(spark):
    rnd = random.Random(1)
    bits = ["a@b.c", "@", ".", "x", "1.2.3.4", "255", "+1 ", "(234) ", "567-8901", "4111 1111 1111 1111", " ", "-", "é", "𝒳", "0", "_"]
    texts = [(i, "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 14)))) for i in range(1500)]
    texts += ODD + [(9100, "1" * 20_000), (9101, "a" * 50_000 + "@"), (9102, "a@b" + ".c" * 20_000), (9103, "1." * 20_000)]
    got = pii.spans(docs_of(spark, texts)).collect()
    assert len(got) == len(texts)
    by_id = dict(texts)
    for r in got:
        want = brute_spans(by_id[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(r.spans.split(","))
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(want.count(f"{k}:") for k in PATTERNS)
    assert pii.spans(empty(spark)).count() == 0


def test_pii_terms(spark):
    """A name that stands only with one address is disclosing, in one document or in four; a word that is everywhere is not."""
    texts = [(i, f"please write to Quimby at jo@ex.org today {'x' * i}") for i in range(4)] + [(10 + i, "please write today or be late") for i in range(400)]
    got = {r.doc_id: r.spans for r in pii.spans(docs_of(spark, texts)).collect()}
    text = texts[0][1]
    a = text.index("Quimby")
    assert got[0] == f"term:{a}:{a + 6},email:{text.index('jo@')}:{text.index('jo@') + 9}" and got[10] == ""
    clean = {r.doc_id: r.text for r in pii.sanitise(docs_of(spark, texts + ODD)).collect()}
    assert clean[0] == "please write to [TERM] at [EMAIL] today " and clean[10] == texts[4][1] and clean[9001] is None
    assert pii.sanitise(docs_of(spark, texts)).columns == docs_of(spark, texts).columns


def test_pii_of_many_spans_in_one_text(spark):
    """Work grows with the text: 20,000 addresses, each next to a word that discloses it."""
    text = "".join(f"𝒳word{chr(97 + k % 26)}q{''.join(chr(97 + int(c)) for c in str(k))} a{k}@b.org é" for k in range(20_000))
    began = time.perf_counter()
    docs = docs_of(spark, [(1, text)] + [(2 + i, "plain words") for i in range(99)])
    got = {r.doc_id: r for r in pii.spans(docs).collect()}
    assert [x for x in got[1].spans.split(",") if not x.startswith("term")] == brute_spans(text).split(",") and got[1].n_email == 20_000
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}[1]
    assert clean.count("[EMAIL]") == 20_000 and "@" not in clean and "wordc" not in clean.replace("[TERM]", "")
    assert time.perf_counter() - began < 150  # quadratic work would take many minutes


# ---------------------------------------------------------------- 6


def brute_components(texts, words, percent):
    sets = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            common_ = len(sets[a] & sets[b])
            if common_ and 100 * common_ >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def copies(seed, n):
    """Families of texts with a few words changed each, sharing passages with others."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    shared = [word() for _ in range(30)]
    out = []
    for _ in range(n):
        base = [word() for _ in range(rnd.choice([6, 40, 150]))]
        if rnd.random() < 0.5:
            base += shared
        for _ in range(rnd.choice([1, 2, 12])):
            text = list(base)
            for _ in range(rnd.randint(0, max(1, len(base) // 40))):
                text[rnd.randrange(len(text))] = word()
            out.append((len(out), " ".join(text) if rnd.random() < 0.8 else " ".join(text).upper()))
    return out


@pytest.mark.parametrize("words,percent,limit", [(3, 90, common.BITMAP_LIMIT), (5, 80, common.BITMAP_LIMIT), (5, 80, 64)])
def test_jaccard_components(spark, words, percent, limit):
    texts = copies(words, 60) + [(10_000 + i, t) for i, t in ODD if i is not None and i != 9009] + [(20_000, "two words")]
    settings = jaccard.Settings(words=words, percent=percent, rare=3, long_set=60, bitmap_limit=limit)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs_of(spark, texts), settings).collect()}
    assert got == brute_components(texts, words, percent)


def test_jaccard_odd_rows(spark):
    got = jaccard.jaccard_components(docs_of(spark, ODD)).collect()
    assert len(got) == len(ODD)
    for r in got:
        assert r.component_id == (None if r.doc_id is None else 9005 if r.doc_id == 9009 else r.doc_id)
    assert jaccard.jaccard_components(empty(spark)).count() == 0


def test_jaccard_of_documents_with_several_texts(spark):
    """A doc_id holds its texts' classes together, whichever doc_id is the least of each; many equal rows are one."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(1, a), (3, b), (9, a), (9, b), (9, c), (5, c + " more"), (7, "quite alone here it is")] + [(8, b)] * 500
    got = {(r.doc_id, r.component_id) for r in jaccard.jaccard_components(docs_of(spark, rows)).collect()}
    assert got == {(1, 1), (3, 1), (5, 1), (8, 1), (9, 1), (7, 7)}


# ---------------------------------------------------------------- 7


def test_warc_round_trip(spark, monkeypatch):
    schema = "page_id long, url string, html string, digest string, first long, copies long"
    rows = [(1, "http://www.b.com:80/x?Q=1", "<p>one</p>"), (2, "http://b.com/y", "<p>one</p>"), (3, None, None), (4, "nonsense", ""), (5, "http://[bad", "é" * 50_000), (6, "http://a.b.com/", "x\r\n\r\ny"), (7, "http://c.org/", "<p>one</p>"), (8, "http://c.org/", "tab\there"), (9, "http://d.org/a\tb", "y")]
    rows += [(100 + i, "http://hot.net/" + "long" * 30, "same") for i in range(40)] + [(200 + i, f"http://hot.net/{'long' * 30}/{i}", f"own {i}") for i in range(20)] + [(None, "http://c.org/", "<p>one</p>"), (8, "http://c.org/", "tab\there")]
    monkeypatch.setattr(warc, "GROUPS", 5)
    archives, captures = warc.write_archives(warc.with_roles(spark.createDataFrame([(*r, "d", 1, 1) for r in rows], schema)), 200)
    blocks = warc.capture_index(captures, 2)
    width, entries = warc.directory(blocks)
    assert width > 1 and blocks.count() >= 30 and len(entries) <= 5 + blocks.select("part").distinct().count()
    got = collections.defaultdict(list)
    for r in warc.read_back(archives, warc.locate(blocks, captures.select("key").distinct())).collect():
        got[r.page_id].append(r)
    assert sum(map(len, got.values())) == len(rows)
    first = {}
    for i, _, html in rows:
        body = (html or "").encode()
        first.setdefault(body, i)
        for r in got[i]:
            assert r.payload_bytes == len(body) and r.payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
            assert (r.record_type, r.refers_to) == (("response", None) if first[body] == i else ("revisit", first[body]))
    found = lambda *urls: sorted(r.page_id for r in warc.lookup(blocks, archives, list(urls)).collect() if r.page_id is not None)
    assert found("http://b.com/y", "http://c.org", "http://none.net/", "http://d.org/a\tb") == [2, 7, 8, 8, 9]
    assert found("http://hot.net/" + "long" * 30) == list(range(100, 140)) and found("http://none.net/") == []
    none = spark.createDataFrame([], schema)
    archives, captures = warc.write_archives(warc.with_roles(none))
    assert warc.read_back(archives, warc.locate(warc.capture_index(captures), captures.select("key"))).count() == 0


def test_warc_minimum_size(spark):
    rows = spark.createDataFrame([(1, "u", "aa"), (2, "u", "aa"), (3, "u", "aaaa"), (4, "u", "aaaa")], "page_id long, url string, html string")
    assert {r.page_id: r.refers_to for r in warc.with_roles(rows, 3).collect()} == {1: None, 2: None, 3: None, 4: 3}


def test_warc_keys():
    assert warc.url_key("https://www.Example.com:8080/A?b") == "com,example:8080)/a?b" and warc.url_key("http://x.org") == "org,x)/" and warc.url_key(None) == ""


# ---------------------------------------------------------------- 8


def scalar_adpcm(block):
    value, index = struct.unpack_from("<hB", block)
    index, out = min(index, 88), [value]
    for byte in block[4:]:
        for nibble in (byte & 15, byte >> 4):
            step = int(telephony.STEPS[index])
            move = step >> 3
            for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
                move += part if nibble & bit else 0
            value = max(-32768, min(32767, value - move if nibble & 8 else value + move))
            index = max(0, min(88, index + [-1, -1, -1, -1, 2, 4, 6, 8][nibble & 7]))
            out.append(value)
    return out


def test_audio_decoders():
    assert telephony.TABLES[telephony.MULAW][[0, 127, 128, 255]].tolist() == [-32124, 0, 32124, 0]
    assert telephony.TABLES[telephony.ALAW][[0xD5, 0x55, 0xAA, 0x2A]].tolist() == [8, -8, 32256, -32256]
    rng = np.random.default_rng(3)
    payload = rng.integers(0, 256, 5 * 192 + 50, dtype=np.uint8).tobytes()
    rate, pcm = telephony.decode([telephony.wav(payload, telephony.ADPCM)])[0]
    want = sum((scalar_adpcm(payload[k : k + 192]) for k in range(0, len(payload), 192)), [])
    assert rate == 8000 and pcm.tolist() == want
    assert telephony.decode([b"RIFFxxxxWAVE", None, b""]) == [None, None, None]
    assert telephony.resample(np.array([0, 100, -100], np.int16), 8000, 16000).tolist() == [0, 50, 100, 0, -100, -100]


def test_audio_digests(spark):
    texts = sample(spark, 40) + ODD
    stored = telephony.store(telephony.pcm_column(telephony.to_media(docs_of(spark, texts))))
    for r in stored.collect():  # what lies in the table is the payload, and its PCM at the new rate
        body = telephony.padded((dict(texts)[r.doc_id] or "").encode())
        coding, rate, _, data = telephony.parse_wav(bytes(r.media))
        want = np.concatenate([scalar_adpcm(body[k : k + 192]) for k in range(0, len(body), 192)]) if coding == telephony.ADPCM else telephony.TABLES[coding][np.frombuffer(body, np.uint8)]
        assert bytes(data) == body and telephony.unlifted(bytes(r.pcm)).tolist() == telephony.resample(np.asarray(want, np.int16), rate, 16000).tolist()
    got = telephony.media_digests(stored).collect()
    assert len(got) == len(texts)
    by_text = collections.defaultdict(set)
    for r in got:
        text = dict(texts)[r.doc_id]
        body = telephony.padded((text or "").encode())
        assert r.n_bytes == len((text or "").encode()) and r.payload_bytes == len(body) and len(body) % 192 == 0
        assert r.payload_sha256 == hashlib.sha256(body).hexdigest() and r.tail_crc32 == zlib.crc32(body[-16:])
        by_text[text or ""].add((r.media_sha256, r.feature))
    assert all(len(v) == 1 for v in by_text.values())
    media = spark.createDataFrame([(1, telephony.wav(b"abc", telephony.MULAW), "x"), (2, b"x", "x"), (3, None, "x")], "id int, media binary, pcm string")
    pcm = {r.id: r.pcm for r in telephony.pcm_column(media, rate=8000).collect()}
    assert telephony.unlifted(bytes(pcm[1])).tolist() == telephony.TABLES[telephony.MULAW][[97, 98, 99]].tolist() and pcm[2] is pcm[3] is None
    assert telephony.media_digests(telephony.pcm_column(telephony.to_media(empty(spark)))).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 3, 1000, 1001])
def test_lifting_is_reversible(n):
    pcm = np.random.default_rng(n).integers(-32768, 32768, n).astype(np.int16)
    assert telephony.unlifted(telephony.lifted(pcm)).tolist() == pcm.tolist()


# ---------------------------------------------------------------- 9


def test_bpe_equals_library(spark):
    import tiktoken

    path = tokenizers_.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=tokenizers_.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(5)
    texts = sample(spark, 60) + ODD + [(10_000 + i, "".join(rnd.choice(" \n\tab'sé1.中") for _ in range(60))) for i in range(300)]
    encoded = bpe.encode_table(docs_of(spark, texts), path, tokenizers_.PATTERN)
    want = collections.Counter((i, np.array(library.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t in texts)
    assert collections.Counter((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in bpe.decode_table(encoded, path, tokenizers_.PATTERN).collect()) == want
    got = collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(docs_of(spark, texts), path, tokenizers_.PATTERN).collect())
    assert got == collections.Counter((i, len(x) // 4, hashlib.sha256(x).hexdigest(), hashlib.sha256(t).hexdigest()) for (i, x, t) in want.elements())
    assert bpe.digests(empty(spark), path, tokenizers_.PATTERN).count() == 0


def test_long_piece_merges_like_a_matrix():
    coder = bpe.coder(bpe.ByteBPE, tokenizers_.path("byte_bpe_multi_50k.tiktoken"), tokenizers_.PATTERN)
    data = coder.first[np.frombuffer(b"abracadabra" * 20, np.uint8)]
    matrix = np.frombuffer(bpe.encode_pieces(data, np.array([len(data)]), coder.pairs)[0], "<u4").tolist()
    assert bpe.merge_long(data.tolist(), coder.pairs) == matrix


# ---------------------------------------------------------------- 10


def brute_removal(texts, n=200):
    bodies = [(t or "").encode() for _, t in texts]
    count = collections.Counter(b[i : i + n] for b in bodies for i in range(len(b) - n + 1))
    out = []
    for (doc, _), b in zip(texts, bodies):
        keep = np.ones(len(b), bool)
        over = 0
        for i in range(len(b) - n + 1):
            if count[b[i : i + n]] > 1:
                keep[max(i, over) : i + n] = False
                over = i + n
        runs = int((np.diff(np.concatenate([[True], keep]).astype(int)) == -1).sum())
        out.append((doc, len(b), int((~keep).sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[keep].tobytes()).hexdigest()))
    return collections.Counter(out)


@pytest.mark.parametrize("seed", range(60))
def test_corpus_order_is_that_of_all_suffixes(seed):
    """The dictionary's and the parse's suffix arrays together sort every suffix of every text."""
    rnd = random.Random(seed)
    alphabet = rnd.choice(["ab", "a", "abcdefgh"])
    word = lambda n: "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, n)))
    base = word(120)
    texts = [(base[rnd.randint(0, 60) :][: rnd.randint(0, 100)] + word(20)).encode() for _ in range(rnd.choice([1, 2, 3, 20]))] + [b"a"]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    s = repeats.Settings(inner=rnd.choice([1, 2, 4]), modulus=rnd.choice([1, 2, 4, 8]))
    number = repeats.corpus_order(data, offsets[:-1], offsets[1:], common.prefix_hash(data), s)
    suffixes = [t[i:] for t in texts for i in range(len(t))]
    order = sorted(range(len(suffixes)), key=lambda i: number[i])
    assert [suffixes[i] for i in order] == sorted(suffixes)
    assert all((number[a] == number[b]) == (suffixes[a] == suffixes[b]) for a, b in zip(order, order[1:]))


@pytest.mark.parametrize("crowd", [2048, 2])
def test_repeats_equal_brute_force(spark, crowd):
    rnd = random.Random(4)
    big = "".join(rnd.choice("abcdé ") for _ in range(3000))
    texts = [(i, big[rnd.randint(0, 1500) :][: rnd.randint(0, 1600)] + "".join(rnd.choice("xyz") for _ in range(rnd.randint(0, 300))) + big[rnd.randint(0, 2500) :][: rnd.randint(0, 400)]) for i in range(50)]
    texts += [*ODD, (9010, "ab" * 300), (None, big[:250])] + [(7000, big[100:900])] * 1000 + sample(spark, 40)
    got = collections.Counter(tuple(r) for r in repeats.removal_digests(docs_of(spark, texts), repeats.Settings(crowd=crowd)).collect())
    assert got == brute_removal(texts)
    assert repeats.removal_digests(empty(spark)).count() == 0


def test_repeats_keep_columns(spark):
    same = "é" * 150
    got = repeats.remove_repeats(docs_of(spark, [(1, "x" + same + "y"), (2, same), (3, "short"), (4, None)]))
    assert got.columns == docs_of(spark, []).columns
    assert {r.doc_id: r.text for r in got.collect()} == {1: "xy", 2: "", 3: "short", 4: None}


# ---------------------------------------------------------------- pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        after = common.materialise(stage(spark, docs, SMALL))
        if name != "packing":
            assert after.columns == docs.columns
        rows = after.collect()
        if name == "toxicity":
            assert {r.doc_id: r.text for r in rows}.items() <= before.items() and sum(1 - labels.get(r.doc_id, 1) for r in rows) >= 0.95 * sum(1 - y for i, y in labels.items() if i in before)
        if name == "jaccard_join":
            want = brute_components(list(before.items()), 5, 80)
            assert {r.doc_id for r in rows} == {i for i, (_, c) in want.items() if c == i}
        if name == "repeated_spans":
            want = {d: h for d, _, _, _, h in brute_removal(list(before.items()))}
            assert all(hashlib.sha256(r.text.encode()).hexdigest() == want[r.doc_id] for r in rows)
        if name == "pii":
            assert len(rows) == len(before) and not any(brute_spans(r.text) for r in rows)
        docs = after
    assert sum(r.length for r in docs.collect()) > 0 and docs.select("doc_id").distinct().count() == len(before)


def pipeline_rows(spark):
    """Documents with nulls, empty and long texts, repeated rows, shared ids and columns that clash with inner names."""
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    one, long_ = " ".join(word() for _ in range(120)), " ".join(word() for _ in range(30_000))
    near = one.replace(one.split()[60], "other", 1)
    texts = [(1, one), (1, one), (2, "plain words"), (3, near), (4, None), (4, None), (5, ""), (6, " \n"), (7, long_), (7, long_), (8, "日本 é 𝒳 " * 20), (None, "no id at all here"), (None, "no id at all here"), (None, one), (9, "mail me at jo@ex.org"), (9, "another text of nine, quite unlike"), (10, "two words"), (11, "two words")]
    return spark.createDataFrame([(i, t, "s", 1, 2, 3, i or 0) for i, t in texts], "doc_id long, text string, source string, rows int, component_id int, spans int, n_chars int"), texts


def test_pipeline_on_odd_rows(spark):
    """Each stage gets what the one before it kept; the group of `one` is rows 1, 1, 3 and the one without an id."""
    import corpus_pipeline

    docs, texts = pipeline_rows(spark)
    one, long_ = texts[0][1], texts[8][1]
    results = {}
    for name, stage in corpus_pipeline.STAGES:
        after = common.materialise(stage(spark, docs, SMALL))
        if name != "packing":
            assert after.columns == docs.columns
            results[name] = collections.Counter((r.doc_id, r.text) for r in after.collect())
        docs = after
    assert results["toxicity"] == collections.Counter(texts)
    kept = [(1, one), (2, "plain words"), (4, None), (5, ""), (6, " \n"), (7, long_), (8, texts[10][1]), (None, "no id at all here"), *texts[14:16], (10, "two words")]
    assert results["jaccard_join"] == collections.Counter(kept)
    # document 8 repeats itself every 23 bytes, so all of its 200-byte strings start elsewhere, too
    assert results["repeated_spans"] == collections.Counter((i, "" if i == 8 else t) for i, t in kept)
    clean = dict(results["pii"].keys())
    assert sum(results["pii"].values()) == len(kept) and clean[1] == one and clean[4] is None and any("[EMAIL]" in (t or "") for _, t in results["pii"])
    pieces = collections.Counter(r.doc_id for r in docs.collect())
    assert set(pieces) == {i for i, _ in kept} and pieces[7] > 10 and pieces[4] == 1


def test_jaccard_stage_of_repeated_rows(spark):
    """A thousand equal rows are one document."""
    import corpus_pipeline

    text = " ".join(f"w{k}" for k in range(100))
    docs = docs_of(spark, [(5, text)] * 1000 + [(6, text + " more"), (7, "short"), (7, "short")])
    got = collections.Counter((r.doc_id, r.text) for r in corpus_pipeline.one_of_each_group(spark, docs, SMALL).collect())
    assert got == {(5, text): 1, (7, "short"): 1}


def test_pipeline_on_an_empty_table(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = common.materialise(stage(spark, docs, SMALL))
    assert docs.count() == 0


# ---------------------------------------------------------------- SQL


@pytest.mark.parametrize("name", ["op5_pii_sanitise", "op6_jaccard_join", "op7_warc"])
def test_equals_sql(spark, name):
    import duckdb

    from loomspan.llm import oracle, queries

    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    df = queries.queries()[name](spark, SMALL)
    found = con.execute(oracle.ORACLE[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(str, (tuple(r[c] for c in names) for r in df.collect()))) == sorted(map(str, found.fetchall()))


def test_discard_only_takes_own_tables(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/kept")
    kept, own = spark.read.parquet(f"{tmp_path}/kept"), common.materialise(spark.range(3).toDF("id"))
    common.discard(kept, own)
    assert kept.count() == 3
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist|PATH_NOT_FOUND"):
        own.collect()


def test_a_bitmap_takes_little_of_the_driver(spark):
    """Its rows come as Arrow; as Python rows they took many times the bitmap."""
    import tracemalloc

    keys = spark.range(1 << 17).select(F.col("id").alias("key"))
    common.bitmap_of(spark.range(1).select(F.col("id").alias("key")))  # what is imported once doesn't count
    tracemalloc.start()
    try:
        bits, words = common.bitmap_of(keys)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    slots = keys.select(F.pmod(F.xxhash64("key"), F.lit(bits)).alias("slot")).toArrow()["slot"].to_numpy()
    expected = np.zeros(len(words), np.int64)
    np.bitwise_or.at(expected, slots >> 6, np.int64(1) << (slots & 63))
    assert bits == 1 << 21 and (words == expected).all()
    assert most < 3 * words.nbytes + (1 << 20)


def test_written_tables_let_go_of_the_driver_s_memory(spark, monkeypatch):
    monkeypatch.setattr(common, "_GAVE_BACK", [float("-inf")], raising=False)
    collected = lambda: sum(b.getCollectionCount() for b in spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if "Old" in b.getName() or "MarkSweep" in b.getName())
    before = collected()
    common.materialise(spark.range(3).toDF("id"))
    after = collected()
    assert after > before
    common.materialise(spark.range(3).toDF("id"))  # at once again: too soon
    assert collected() == after
