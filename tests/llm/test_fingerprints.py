"""Document fingerprints against a plain count."""

import hashlib
import random

import pytest
from data import clashing, documents, sentence
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.llm import fingerprints as fp


def plain_print(text):
    body = (text or "").encode()
    padded = b"\0\0" + body + b"\0\0"
    counts = [0] * 256
    for i in range(len(body)):
        five = padded[i : i + 5]
        for k, (a, b, c) in enumerate(((0, 1, 2), (0, 2, 3), (0, 2, 4), (1, 2, 3), (1, 2, 4), (2, 3, 4))):
            v = (k << 24 | five[a] << 16 | five[b] << 8 | five[c]) * 2654435761 % 2**32
            counts[(v ^ v >> 15) * 2246822519 % 2**32 >> 24] += 1
    s = sorted(counts)
    codes = [(n > s[63]) + (n > s[127]) + (n > s[191]) for n in counts]
    bits = len(body).bit_length()
    length = 0 if not body else min(255, 8 * bits + ((len(body) * 8 >> (bits - 1)) & 7))
    return bytes([length, *[codes[i] * 64 + codes[i + 1] * 16 + codes[i + 2] * 4 + codes[i + 3] for i in range(0, 256, 4)]]).hex()


def plain_likeness(a, b):
    x, y = bytes.fromhex(a), bytes.fromhex(b)
    total = sum(abs((p >> s & 3) - (q >> s & 3)) for p, q in zip(x[1:], y[1:], strict=True) for s in (0, 2, 4, 6))
    return 1 - min(600, total + 6 * min(64, abs(x[0] - y[0]))) / 600


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60), st.sampled_from([1 << 20, 7, 3]))
def test_slices_count_like_the_whole(text, size):
    before, fp.SLICE = fp.SLICE, size
    try:
        assert fp.fingerprint(text) == plain_print(text)
    finally:
        fp.SLICE = before


def test_differences_are_bounded():
    texts = ["", "a", "b" * 5000, sentence(400), sentence(400, 1), "\U0001f600" * 90]
    prints = [fp.fingerprint(t) for t in texts]
    assert prints[0] == "0" * 130 and fp.fingerprint(None) == prints[0]
    for a in prints:
        for b in prints:
            assert fp.likeness(a, b) == fp.likeness(b, a) == plain_likeness(a, b)
            assert 0 <= fp.likeness(a, b) <= 1 and (fp.likeness(a, b) == 1) == (a == b)


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_rows_by_brute_force(spark, partitions):
    draw = random.Random(1)
    rows = [(i * 3, sentence(draw.randint(0, 60), i) if i % 5 else draw.choice([None, "", "é", "x\ny\0z"]), "en", "s", 1) for i in range(70)]
    rows.append((1000, sentence(4000, 2), "en", "s", 1))
    draw.shuffle(rows)
    frame = documents(spark, rows).select("*", *[F.lit(0).alias(c) for c in ("id", "range", "state", "near_next", "N_chars")])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = {r.id: r for r in fp.compare_with_edits(frame).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    ordered = sorted((i, t or "") for i, t, *_ in rows)
    assert len(got) == len(rows)
    for (i, t), (_, after) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        k = len(t) // 4
        changed = t[: len(t) - k] + after[:k]
        own, other = plain_print(t), plain_print(changed)
        want = (i, len(t), hashlib.sha256(changed.encode()).hexdigest(), own, other, plain_likeness(own, other), plain_likeness(own, plain_print(after)))
        assert tuple(got[i]) == want


def test_awkward_tables(spark):
    got = fp.compare_with_edits(clashing(spark)).collect()
    assert len(got) == 12 and sum(r.id is None for r in got) == 2
    assert fp.compare_with_edits(documents(spark, [])).count() == 0
    alone = fp.compare_with_edits(documents(spark, [(1, "abcdefgh", None, None, None)])).first()
    assert alone.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and alone.near_next == 1.0
    named = fp.fingerprint_documents(clashing(spark).withColumn("FINGERPRINT", F.lit(1)))
    assert named.columns[-1] == "_fingerprint" and named.count() == 12
    assert {r._fingerprint for r in named.where("text is null or text = ''").collect()} == {"0" * 130}


def test_edited_copies_stand_apart_from_neighbours(spark, data_dir):
    got = fp.compare_with_edits(spark.read.parquet(f"{data_dir}/documents.parquet")).collect()
    assert all(r.near_edited > r.near_next for r in got)
    assert sum(r.near_edited >= 0.75 for r in got) > 0.95 * len(got) and sum(r.near_next < 0.75 for r in got) > 0.9 * len(got)
