"""Queries over whole inputs, where a smaller one beside them is held against SQL."""

import re

import duckdb
import numpy as np
import pytest

from loomspan.plans.queries import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"


def whole_sequences(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    return {r.doc_id: re.sub("[^ACGT]", "", re.sub("[acgt]", lambda m: m[0].upper(), r.text or "")) for r in rows}


def test_sequences_are_whole(spark):
    want = whole_sequences(spark)
    assert max(map(len, want.values())) > 400
    rc = {r.id: r.rc for r in QUERIES["revcomp"](spark, DATA).collect()}
    assert rc == {i: s[::-1].translate(str.maketrans("ACGT", "TGCA")) for i, s in want.items()}
    mutated = {r.id: r.mutated for r in QUERIES["mutate"](spark, DATA).collect()}
    assert mutated == {i: "T" + s[1:] for i, s in want.items() if len(s) > 3}
    shares = {(r.id, r.letter): r.frequency for r in QUERIES["letter_frequency"](spark, DATA).collect()}
    assert all(shares[i, x] == pytest.approx(s.count(x) / len(s), abs=1e-6) for i, s in want.items() if s for x in "ACGT")
    starts = {(i, k) for i, s in want.items() for k in range(1, len(s) - 49, 25)}
    windows = {(r.id, r.start, r.letter): r.frequency for r in QUERIES["window_composition"](spark, DATA).collect()}
    assert set(windows) == {(i, k, x) for i, k in starts for x in "ACGT"}
    assert all(f == pytest.approx(want[i][k - 1 : k + 50].count(x) / 51, abs=1e-6) for (i, k, x), f in windows.items())
    assert {(r.id, r.start) for r in QUERIES["skew"](spark, DATA).collect()} == starts


def test_reclustering_settles(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "label", "embedding").collect()
    x, own = np.array([r.embedding for r in rows], float), np.array([r.label for r in rows])
    names = sorted(set(own))
    centres, rounds = np.stack([x[own == k].mean(0) for k in names]), 0
    while True:
        new = np.array(names)[np.round(((x[:, None] - centres) ** 2).sum(2), 9).argmin(1)]
        if (new == own).all():
            break
        own, rounds = new, rounds + 1
        centres = np.stack([x[own == k].mean(0) if (own == k).any() else centres[i] for i, k in enumerate(names)])
    got = {r.vec_id: r.cluster for r in QUERIES["recluster"](spark, DATA).collect()}
    assert rounds > 1 and got == {r.vec_id: k for r, k in zip(rows, own)}
    assert got != {r.vec_id: r.cluster for r in QUERIES["recluster_step"](spark, DATA).collect()}


def test_hundred_permutations(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{DATA}/events.parquet'")
    want = con.execute(ORACLE["permutation_p"].replace("range(1, 6)", "range(1, 101)")).fetchall()
    got = {(r["query"], r["target"]): r.p_value for r in QUERIES["permutation_p_100"](spark, DATA).collect()}
    assert got == {(q, t): pytest.approx(float(p), abs=1e-6) for q, t, p in want}
    assert any(round(p * 5, 6) % 1 for p in got.values())


def test_dft_permutations_are_the_default(spark):
    p = [r.p_value * 100 for r in QUERIES["dft_permutation_p"](spark, DATA).collect()]
    assert all(abs(x - round(x)) < 1e-6 for x in p) and any(round(x) % 2 for x in p)
