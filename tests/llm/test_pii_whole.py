"""Terms that disclose values of one or two documents, against plain Python."""

import math
from collections import Counter, defaultdict

import regex

from loomspan.llm import pii, queries

SMALL = "/root/testdata/sf0.001"


def brute(rows, base):
    """{row number: its term spans} of (text, base spans)."""
    words = [{w.lower() for w in regex.findall(r"\p{L}{4,}", t)} for t in rows]
    nt, where = Counter(w for ws in words for w in ws), defaultdict(set)
    for i, spans in enumerate(base):
        for kind, a, b in spans:
            m = rows[i][a:b]
            where[kind, m.lower() if kind == "email" else m if kind == "ip" else regex.sub("[^0-9]", "", m)].add(i)
    gone = defaultdict(set)
    for docs in where.values():
        p = len(docs) / (len(rows) + 1)
        for t, net in Counter(w for i in docs for w in words[i]).items():
            if math.log((net + 0.5 * p) / (nt[t] + 0.5) / p) / -math.log(p) >= 0.9:
                for i in docs:
                    gone[i].add(t)
    out = {}
    for i, t in enumerate(rows):
        found = [(m.start(), m.end()) for m in regex.finditer(r"\p{L}{4,}", t) if m[0].lower() in gone[i]]
        out[i] = [(a, b) for a, b in found if not any(x < b and y > a for _, x, y in base[i])]
    return out


def parsed(spans, terms):
    got = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in spans.split(",") if x)]
    return [x for x in got if (x[0] == "term") == terms]


def test_terms_of_a_given_table(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = {r.doc_id: r.spans for r in queries.queries()["op5_pii_sanitise"](spark, SMALL).collect()}
    assert got.keys() == docs.keys()
    ids = sorted(docs)
    base = [parsed(got[i], False) for i in ids]
    want = brute([docs[i] for i in ids], base)
    assert {i: [(a, b) for _, a, b in parsed(got[i], True)] for i in ids} == {i: want[k] for k, i in enumerate(ids)}
    assert sum(map(len, want.values())) > 0


def test_a_name_far_from_a_value_of_one_document(spark):
    far = "plain words go on and on here " * 5
    texts = [(1, f"Quimby wrote. {far} mail jo@ex.org")] + [(10 + i, f"{far} mail wrote") for i in range(300)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert clean[1] == f"[TERM] wrote. {far} mail [EMAIL]" and clean[10] == texts[1][1]
