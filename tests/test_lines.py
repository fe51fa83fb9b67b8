"""Files read split by split against reading them whole."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from tessella.operators.leakscan import scan_files, scan_texts
from tessella.sources import delimited, files, lines, tables

SPLIT_SIZES = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"


@pytest.fixture
def splits_of(spark):
    before = {key: spark.conf.get(key) for key in SPLIT_SIZES}

    def set_(size):
        spark.conf.set(SPLIT_SIZES[0], str(size))
        spark.conf.set(SPLIT_SIZES[1], "0")

    yield set_
    for key, value in before.items():
        spark.conf.set(key, value)


def hostile_text(seed, n):
    draw = random.Random(seed)
    breaks = ["\n", "\n", "\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x85", " ", "\n\n"]
    words = ["plain", "ümläut", "日本語", "\U0001f600" * 5, "/home/alice/x", "/scratch/bob", "leak-scan-allow", "", "x" * 90]
    return "".join(draw.choice(words) + draw.choice(breaks) for _ in range(n)) + draw.choice(["", "end", "/home/alice/"])


@pytest.mark.parametrize("size", [1024, 61, 1 << 20])
def test_findings_and_numbers_equal_those_of_whole_files(spark, tmp_path, splits_of, size):
    for k in range(6):
        (tmp_path / f"f{k}.txt").write_bytes(hostile_text(k, 40 if size == 61 else 500).encode())
    (tmp_path / "bad.txt").write_bytes("/home/alice/\n".encode() * 300 + b"\xff\n/home/alice/\n")
    (tmp_path / "empty.txt").write_bytes(b"")
    (tmp_path / "p.png").write_bytes(b"/home/alice/")
    (tmp_path / "note.local.md").write_bytes(b"")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "note.local.md").write_bytes(b"/home/alice/\n")
    extra = [("anchored", "^plain$")]
    want = sorted(tuple(r) for r in scan_texts(files.read_texts(spark, str(tmp_path)), extra, snippet_length=120).collect())
    splits_of(size)
    got = sorted(tuple(r) for r in scan_files(spark, str(tmp_path), extra, snippet_length=120).collect())
    assert got == want and len(want) > 20 and not any(r[0] in ("bad.txt", "p.png") for r in got)
    if size < 1 << 20:
        assert lines.read_lines(spark, str(tmp_path)).select("file", "block").distinct().count() > 12


def test_paths_are_not_judged_on_every_line(spark, tmp_path):
    """No condition over the lines of text files makes or tests a path, not even one that the optimizer pushed there."""
    (tmp_path / "a.txt").write_bytes(b"/home/alice/\n")
    plan = scan_files(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString().splitlines()
    leaf, over_lines = "", []
    for node in reversed(plan):
        leaf = node if "Relation [" in node else leaf
        if "Filter " in node and leaf.endswith(" text"):
            over_lines.append(node)
    assert over_lines and not any("regexp" in node for node in over_lines)


def test_breaks_inside_lines_are_counted_as_python_splits(spark):
    values = ["", "plain", "ümläut 日本語", "\x0b", "a\x0bb\x0c", "\x1c\x1d\x1e", "x\x85y\u2028z\u2029"]
    frame = spark.createDataFrame([(v,) for v in values], "value string")
    got = [r[0] for r in frame.select(lines.line_count(F.col("value"))).collect()]
    assert got == [len((v + "|").splitlines()) for v in values]


def whole(text):
    return [r for r in csv.reader(io.StringIO(text, newline=None)) if r]


def hostile_csv(seed, n):
    draw = random.Random(seed)
    cell = lambda: draw.choice(['""', "", "a", 'in"side', '"q"', '"a,b"', '"line\nbreak"', '"two\r\n\r\nbreaks"', '"say ""hi"""', '"""\n"""', '"x"tail"y', "é日", '"\n"', " \"lead"])
    rows = [f"{cell()},{cell()},{cell()}" for _ in range(n)]
    return "h1,h2,h3\n" + "".join(r + draw.choice(["\n", "\r\n", "\n\n"]) for r in rows)


@pytest.mark.parametrize("text", [hostile_csv(s, 60) for s in range(3)])
def test_states_follow_the_csv_reader(text):
    inside, physical = False, io.StringIO(text, newline=None).read().split("\n")
    ends, reader = set(), csv.reader(f"{x}\n" for x in physical)
    for _ in reader:
        ends.add(reader.line_num)
    for number, line in enumerate(physical, 1):
        inside = delimited.ends_inside(line, inside)
        assert (number in ends) == (not inside)


def test_csv_cut_at_every_byte(spark, tmp_path, splits_of):
    """All split sizes of a small file, so that every byte is a border of some split."""
    text = hostile_csv(7, 12)
    path = tmp_path / "t.csv"
    path.write_bytes(text.encode())
    want = whole(text)[1:]
    for size in (1, 2, 3, 5, 7, 11, 17, 23, 31, 47, 64, 97, 128, 1 << 20):
        splits_of(size)
        got = delimited.read_records(spark, str(path), ["h1", "h2", "h3"]).orderBy("file", "block", "row").collect()
        assert [r["fields"] for r in got] == want, size


def test_many_files_of_many_splits(spark, tmp_path, splits_of):
    texts = [hostile_csv(20 + k, 150) for k in range(4)] + ["h1,h2,h3\n" + '"' + "long\n" * 400 + '",b,"c"\n', "h1,h2,h3\n"]
    for k, text in enumerate(texts):
        (tmp_path / f"{k}.csv").write_bytes(text.encode())
    (tmp_path / "empty.csv").write_bytes(b"")
    splits_of(200)
    got = delimited.read_records(spark, str(tmp_path), ["h1", "h2", "h3"]).orderBy("file", "block", "row").collect()
    assert [r["fields"] for r in got] == [row for text in texts for row in whole(text)[1:]]
    frame = tables.read_csv_strict(spark, str(tmp_path), "h1 string, h2 string, h3 string", position="pos")
    assert frame.columns == ["h1", "h2", "h3", "pos"] and frame.count() == len(got)


def test_faults_of_csv_files(spark, tmp_path):
    path = tmp_path / "t.csv"
    read = lambda: delimited.read_records(spark, str(path), ["a", "b"]).collect()
    for body, said in ((b"a,b\n1\n", "1 fields"), (b"a,c\n1,2\n", "expected"), (b'a,b\n"1,2\n', "not closed"), (b"a,b\n\xff,2\n", "UTF-8")):
        path.write_bytes(body)
        with pytest.raises(Exception, match=said):
            read()


def test_quoted_breaks_survive_a_round_trip(spark, tmp_path):
    rows = [(k, f'text {k}\n"quoted", and\n\nmore' if k % 3 else "") for k in range(50)]
    frame = spark.createDataFrame(rows, "k int, t string").repartition(4)
    frame.write.options(header=True, quote='"', escape='"', emptyValue="").csv(str(tmp_path / "out"))
    back = tables.read_csv_strict(spark, str(tmp_path / "out"), "k int, t string")
    assert sorted(tuple(r) for r in back.collect()) == rows
    assert back.where(F.col("t") == "").count() == 17
