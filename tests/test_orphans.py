import random
from datetime import datetime, timedelta

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.functions.bitmaps import Bitmap
from lectern.operators.orphans import find_orphans, orphan_report, references

REF = "rel_id long, source string, target string, extracted_at timestamp, name string"
ENT = "name string, arrived_at timestamp, deleted_at timestamp, key string"
T0 = datetime(2024, 1, 1)


@settings(max_examples=30, deadline=None)
@given(st.sets(st.integers(0, 200_000), max_size=300), st.sets(st.integers(0, 200_000), max_size=300), st.booleans())
def test_bitmap_and_not(a, b, dense):
    if dense:
        a, b = a | set(range(0, 9000)), b | set(range(4000, 12_000, 2))
    got = Bitmap.of(np.array(sorted(a))).and_not(Bitmap.of(np.array(sorted(b)))).decode()
    assert got.tolist() == sorted(a - b)


def brute(refs, ents):
    out = set()
    for rel, s, t, at, _ in refs:
        for field, v in (("source", s), ("target", t)):
            k = (v or "").strip().lower()
            if not k:
                continue
            rows = [(a, d) for n, a, d, _ in ents if (n or "").strip().lower() == k]
            if at and any(a and a <= at and (d is None or d > at) for a, d in rows):
                continue
            reason = "missing" if not rows else "deleted" if at and any(a and a <= at for a, _ in rows) else "late"
            out.add((rel, field, reason))
    return out


def run(spark, refs, ents, **kw):
    r = references(spark.createDataFrame(refs, REF), "rel_id", "extracted_at", ("source", "target"), "relationships")
    return find_orphans(r, spark.createDataFrame(ents, ENT), **kw)


def test_against_brute_force(spark):
    rnd = random.Random(7)
    at = lambda: None if rnd.random() < 0.03 else T0 + timedelta(hours=rnd.randrange(24 * 120))
    name = lambda: None if rnd.random() < 0.03 else rnd.choice(["", " ", "hot", " Hot "] + [f"n{i}" for i in range(40)] + [f"\tN{i} " for i in range(40)])
    refs = [(i, name(), name(), at(), "x") for i in range(600)]
    ents = []
    for _ in range(60):
        a = at()
        ents.append((name(), a, None if rnd.random() < 0.5 or a is None else a + timedelta(hours=rnd.randrange(-3, 900)), "y"))
    ents += ents[:9]
    refs += refs[:20]
    got = {(r.key, r.ref_field, r.reason) for r in run(spark, refs, ents, ranges=3, salts=2).collect()}
    assert got == brute(refs, ents)
    assert {r for _, _, r in got} == {"missing", "deleted", "late"}


def test_bounds_are_exact(spark):
    t = datetime(2024, 3, 1)
    refs = [(1, "a", None, t, ""), (2, "b", None, t, ""), (3, "c", None, t - timedelta(microseconds=1), "")]
    ents = [("a", t, None, ""), ("b", T0, t, ""), ("c", t, None, "")]
    assert {(r.key, r.reason) for r in run(spark, refs, ents).collect()} == {(2, "deleted"), (3, "late")}


def test_empty_tables(spark):
    assert run(spark, [], [("a", T0, None, "")]).count() == 0
    rows = run(spark, [(1, "a", " ", T0, "")], [])
    assert [(r.key, r.ref_field, r.reason) for r in rows.collect()] == [(1, "source", "missing")]
    assert orphan_report(rows).collect()[0].n_orphans == 1
