"""Vector codes and hard negatives against brute force."""

import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.llm import hard_negatives as hard
from tessella.llm import vector_codes as codes

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(seed, n, width=16, spread=1.0, bad=True):
    """Gaussian and clustered vectors with copies, ties, nulls and components that are not finite."""
    draw = random.Random(seed)
    centres = [[draw.gauss(0, 1) for _ in range(width)] for _ in range(4)]
    rows = []
    for i in range(n):
        kind = draw.random()
        if kind < 0.2 and rows and rows[-1][1] is not None:
            v = list(rows[-1][1])
        elif kind < 0.6:
            v = [c + draw.gauss(0, 0.05) for c in draw.choice(centres)]
        else:
            v = [draw.gauss(0, spread) for _ in range(width)]
        rows.append((i, v, draw.choice([0, 0, 0, 1, 2, None])))
    if bad:
        rows += [(n, None, 1), (n + 1, [None] + [1.0] * (width - 1), 1), (n + 2, [math.inf] * width, 0), (n + 3, [math.nan] * width, 0), (n + 4, [], 1)]
    return rows


def sound(rows, scale):
    kept = [(i, v, y) for i, v, y in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    return [(i, [math.floor(scale * float(np.float32(x))) for x in v], y) for i, v, y in kept]


def plain_codes(rows, parts, entries, rounds):
    kept = sorted(sound(rows, 4096), key=lambda r: (r[0] is not None, r[0], r[1]))
    w = len(kept[0][1]) // parts
    part = lambda v, p: v[p * w : (p + 1) * w]
    books = [[part(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    far = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y, strict=True))
    near = lambda p, v: min(range(len(books[p])), key=lambda e: (far(part(v, p), books[p][e]), e))
    for _ in range(rounds):
        owners = [[near(p, v) for _, v, _ in kept] for p in range(parts)]
        for p in range(parts):
            for e in range(len(books[p])):
                own = [part(v, p) for (_, v, _), o in zip(kept, owners[p], strict=True) if o == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    out = []
    for i, v, y in kept:
        code = [near(p, v) for p in range(parts)]
        out.append((i, y, "".join(f"{c:02x}" for c in code), sum(far(part(v, p), books[p][c]) for p, c in enumerate(code))))
    return out, hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 90), st.integers(1, 3), st.integers(1, 9), st.integers(1, 6), st.booleans())
def test_dual_tree_assigns_like_brute_force(seed, n, width, k, reach, totals):
    draw = np.random.default_rng(seed)
    points, entries = draw.integers(-reach, reach + 1, (n, width)), draw.integers(-reach, reach + 1, (k, width))
    tree = codes.build_tree(points, leaf=4)
    assert sorted(tree.order.tolist()) == list(range(n)) and (tree.points == points[tree.order]).all()
    want = ((points[:, None, :] - entries[None]) ** 2).sum(axis=2).argmin(axis=1)
    owner, counts, sums = codes.nearest_entries(tree, entries, totals=totals)
    if totals:
        assert counts.tolist() == np.bincount(want, minlength=k).tolist()
        assert sums.tolist() == [points[want == e].sum(axis=0).tolist() for e in range(k)]
    else:
        assert owner.tolist() == want[tree.order].tolist()
    packed = codes._unpacked(codes._packed(tree), width, 4)
    assert all((a == b).all() for x, y in ((tree.low, packed.low), (tree.sums, packed.sums)) for a, b in zip(x, y, strict=True))


@pytest.mark.parametrize(("n", "chunk"), [(300, 64), (9, 1024)])
def test_codes_by_brute_force(spark, n, chunk):
    rows = vectors(n, n)
    rows += rows[:7] + [(None, [0.5] * 16, 1)]
    frame = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit("x").alias(c) for c in ("id", "code", "CODE_", "v", "points", "Error")])
    for partitions in (1, 5):
        made = codes.compress(frame.repartition(partitions), parts=4, entries=12, rounds=3, chunk_rows=chunk)
        want, digest = plain_codes(rows, 4, 12, 3)
        assert made.digest() == digest
        order = lambda r: str(r)
        assert sorted((tuple(r) for r in made.rows.collect()), key=order) == sorted(want, key=order)
    totals = {}
    for _, y, _, e in want:
        totals[y] = totals.get(y, 0) + e
    got = codes.with_label_errors(made.rows).collect()
    assert len(got) == len(want) and all(r.label_error == totals[r.label] for r in got)


def test_label_errors_of_many_labels_are_salted(spark, monkeypatch):
    monkeypatch.setattr(codes, "sent_if_small", lambda df: df)
    frame = spark.createDataFrame([(i, None if i % 3 == 0 else i % 5, "00", i) for i in range(60)], "id long, label int, code string, error long")
    got = codes.with_label_errors(frame).collect()
    totals = {}
    for i in range(60):
        y = None if i % 3 == 0 else i % 5
        totals[y] = totals.get(y, 0) + i
    assert len(got) == 60 and all(r.label_error == totals[r.label] for r in got)


def test_codes_refuse_what_they_cannot_hold(spark):
    empty = codes.compress(spark.createDataFrame([], SCHEMA))
    assert empty.rows.count() == 0 and empty.books.size == 0
    with pytest.raises(ValueError):
        codes.compress(spark.createDataFrame([(1, [1.0] * 7, 0)], SCHEMA), parts=2)
    with pytest.raises(Exception, match="differ in width"):
        codes.compress(spark.createDataFrame([(i, [1.0] * (8 if i < 20 else 16), 0) for i in range(30)], SCHEMA)).rows.collect()
    with pytest.raises(Exception, match="exact distances"):
        codes.compress(spark.createDataFrame([(1, [1e9] * 8, 0)], SCHEMA)).rows.collect()


def plain_negatives(rows, anchors, positives=5, negatives=10):
    kept = sound([r for r in rows if r[0] is not None and r[2] is not None], 256)
    out = set()
    for i, v, y in kept:
        if not anchors(i):
            continue
        scored = {(-sum(a * b for a, b in zip(v, x, strict=True)), j, z) for j, x, z in kept}
        for pos, p, z in [s for s in sorted(scored) if s[2] == y and s[1] != i][:positives]:
            own = [s for s in sorted(scored) if s[2] != y and 30 * -pos <= 100 * -s[0] <= 90 * -pos]
            out |= {(i, p, k, n, -pos, -neg) for k, (neg, n, _) in enumerate(own[:negatives], 1)}
    return out


@pytest.mark.parametrize(("seed", "width", "batch", "block"), [(1, 16, 7, 1000), (2, 20, 40, 3), (3, 3, 1000, 2), (4, 64, 25, 1000)])
def test_hard_negatives_by_brute_force(spark, seed, width, batch, block):
    rows = vectors(seed, 260, width)
    rows += rows[:40] + [(None, [1.0] * width, 0)]
    frame = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit("x").alias(c) for c in ("id", "v", "anchor", "slot", "rank", "Score")])
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = [tuple(r) for r in hard.mine_hard_negatives(frame.repartition(3), F.col("vec_id") % 20 == 0, block_rows=block).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = plain_negatives(rows, lambda i: i % 20 == 0)
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50


def test_hard_negatives_of_string_ids_and_small_tables(spark):
    rows = vectors(9, 60, 4, bad=False)
    named = [(f"k{i:03}", v, y) for i, v, y in rows]
    frame = spark.createDataFrame(named, "vec_id string, embedding array<double>, label int")
    exact = [(i, [float(np.float32(x)) for x in v], y) for i, v, y in named]
    frame = spark.createDataFrame(exact, frame.schema)
    got = {tuple(r) for r in hard.mine_hard_negatives(frame, F.col("vec_id").endswith("0")).collect()}
    assert got == plain_negatives(exact, lambda i: i.endswith("0"))
    none = F.col("vec_id") % 20 == 0
    assert hard.mine_hard_negatives(spark.createDataFrame([], SCHEMA), none).count() == 0
    alone = [(0, [1.0, 0.0], 0), (1, [1.0, 0.0], 1)]
    assert hard.mine_hard_negatives(spark.createDataFrame(alone, SCHEMA), none).count() == 0
    with pytest.raises(Exception, match="differ in width"):
        hard.mine_hard_negatives(spark.createDataFrame([(0, [1.0], 0), (1, [1.0, 2.0], 0)], SCHEMA), none).count()


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 40), st.integers(1, 60), st.integers(1, 30), st.integers(-60, 200))
def test_threshold_join_finds_every_pair(seed, n, m, width, least):
    draw = np.random.default_rng(seed)
    a, b = draw.integers(-9, 10, (n, width)), draw.integers(-9, 10, (m, width)) * draw.integers(0, 2, (m, 1))
    dims = draw.permutation(width)
    limits = least + draw.integers(-20, 20, n)
    got = hard.pairs_above(hard.Vectors.of(a, dims), hard.Vectors.of(b, dims), limits)
    whole = a @ b.T
    want = {(i, j, int(whole[i, j])) for i in range(n) for j in range(m) if whole[i, j] >= limits[i]}
    assert set(zip(*(x.tolist() for x in got), strict=True)) == want and len(got[0]) == len(want)
