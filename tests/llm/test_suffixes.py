import hashlib
import random

import pytest
from pyspark.sql import types as T

from tessella.llm.suffixes import remove_repeats


def brute(rows, length):
    """Kept bytes and spans of (order, text) rows, by a table of all strings."""
    seen, out = set(), {}
    for key, text in sorted(rows, key=lambda r: r[0]):
        body = (text or "").encode()
        cut = [False] * len(body)
        for at in range(len(body) - length + 1):
            string = body[at : at + length]
            if string in seen:
                cut[at : at + length] = [True] * length
            seen.add(string)
        spans, start = [], None
        for i, c in enumerate([*cut, False]):
            if c and start is None:
                start = i
            elif not c and start is not None:
                spans.append((start, i))
                start = None
        out[key] = (bytes(b for b, c in zip(body, cut, strict=True) if not c), spans)
    return out


def corpus(seed, n, unit, top):
    """Texts of few letters with copies, periods, shared passages and edits."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abé") for _ in range(draw.randint(1, unit)))
    shared = ["".join(word() for _ in range(draw.randint(1, 30))) for _ in range(6)]
    rows = []
    for i in range(n):
        kind = draw.random()
        if rows and kind < 0.25:
            text = draw.choice(rows)[1] or ""
            at = draw.randint(0, len(text))
            text = text[:at] + draw.choice(["", word(), draw.choice(shared)]) + text[at:]
        elif kind < 0.4:
            text = word() * draw.randint(1, top)
        else:
            text = "".join(draw.choice([word(), draw.choice(shared)]) for _ in range(draw.randint(0, top)))
        rows.append((i * 3 + 1, None if kind > 0.97 else text))
    draw.shuffle(rows)
    return rows


SCHEMA = "doc_id long, text string"


@pytest.mark.parametrize(("length", "group"), [(4, 4096), (9, 4096), (12, 3), (37, 2), (100, 4096)])
def test_matches_a_table_of_all_strings(spark, length, group):
    rows = corpus(length, 300, 9, 25)
    got = remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(5), length=length, group=group).collect()
    want = brute(rows, length)
    assert len(got) == len(rows)
    for r in got:
        assert (bytes(r.kept), [tuple(s) for s in r.removed_spans]) == want[r.doc_id], r.doc_id


@pytest.mark.parametrize("length", [4, 12, 37, 100])
def test_every_period_in_a_stretch_that_stands_once(spark, length):
    draw = random.Random(length)
    rows = []
    for period in range(1, 2 * length + 1):
        unit = "".join(chr(draw.randint(33, 126)) for _ in range(period - 1)) + "\n"
        rows.append((period, unit * (3 + 3 * length // period)))
    got = remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(3), length=length).collect()
    want = brute(rows, length)
    wrong = [r.doc_id for r in got if (bytes(r.kept), [tuple(s) for s in r.removed_spans]) != want[r.doc_id]]
    assert len(got) == len(rows) and wrong == []


def test_long_periodic_text_spans_several_walks(spark):
    rows = [(1, "xy" * 700_000 + "end"), (2, "q" * 99), (3, "xy" * 60)]
    got = {r.doc_id: r for r in remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert bytes(got[1].kept) == b"xyend"[:2] + b"end" or len(got[1].kept) <= 110
    want = brute([(1, "xy" * 2000 + "end"), (2, "q" * 99), (3, "xy" * 60)], 100)
    assert bytes(got[1].kept) == want[1][0]
    assert bytes(got[3].kept) == want[3][0]
    assert bytes(got[2].kept) == b"q" * 99


def test_repeated_and_null_ids_empty_table_and_clashing_columns(spark):
    schema = T.StructType(
        [
            T.StructField("doc_id", T.LongType()),
            T.StructField("text", T.StringType()),
            T.StructField("kept", T.StringType()),
            T.StructField("ord", T.StringType()),
        ]
    )
    assert remove_repeats(spark.createDataFrame([], schema)).count() == 0
    long = "".join(f"{i:04d}" for i in range(60))
    rows = [(None, long, "k", "o"), (7, long, "k", "o"), (7, long, "k", "o"), (7, "other " + long, None, None), (8, None, None, "x"), (9, "", None, None)]
    got = remove_repeats(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 6
    assert {c for c in got[0].asDict()} == {"doc_id", "text", "ord", "kept", "removed_spans"}
    by_id = {}
    for r in got:
        by_id.setdefault((r.doc_id, r.text), []).append(bytes(r.kept))
    assert by_id[None, long] == [long.encode()]
    assert by_id[7, long] == [b"", b""]
    assert by_id[7, "other " + long] == [b"other "]
    assert by_id[8, None] == [b""] and by_id[9, ""] == [b""]


def test_query_matches_brute_force(spark, data_dir):
    from tessella.llm.queries_suffixes import op2_suffix_dedup

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data_dir}/documents.parquet").collect()]
    want = brute(rows, 100)
    got = op2_suffix_dedup(spark, data_dir).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        kept, spans = want[r.doc_id]
        n = len((texts[r.doc_id] or "").encode())
        assert (r.n_bytes, r.n_removed, r.n_spans) == (n, n - len(kept), len(spans))
        assert r.kept_sha256 == hashlib.sha256(kept).hexdigest()
