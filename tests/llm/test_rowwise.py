"""Decontamination, licenses, quality rules and toxicity: operators that judge row by row."""

import re
from collections import Counter

import pytest
from data import SCHEMA, clashing, documents, sentence
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import toxicity as tox
from tessella.llm.common import alnum_words, space_words
from tessella.llm.decontaminate import WordSearch, drop_contaminated, find_benchmark, marked_spans
from tessella.llm.licenses import detect, phrase_places, rules, scan_licenses
from tessella.llm.quality import apply_quality_rules


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_words_follow_their_patterns(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    assert [w.decode("utf-8", "surrogatepass") for w in alnum_words(text)] == re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)
    assert [w.decode("utf-8", "surrogatepass") for w in space_words(text)] == re.findall("[^\x20\x09-\x0d]+", lower)


def plain_hits(words, items, width):
    marked, found = [False] * len(words), set()
    for item, text in items:
        own = alnum_words(text)
        size = min(width, len(own))
        for i in range(len(own) - size + 1 if own else 0):
            for j in range(len(words) - size + 1):
                if words[j : j + size] == own[i : i + size]:
                    marked[j : j + size] = [True] * size
                    if item is not None:
                        found.add(item)
    return marked, found


@settings(max_examples=300, deadline=None)
@given(
    st.lists(st.sampled_from("a b c".split()), max_size=60),
    st.lists(st.tuples(st.sampled_from(["1", "2", "10", None]), st.lists(st.sampled_from("a b c".split()), max_size=14)), max_size=5),
    st.integers(1, 10),
)
def test_wu_manber_finds_what_a_plain_search_finds(words, items, width):
    items = [(i, " ".join(w)) for i, w in items]
    words = alnum_words(" ".join(words))
    marked, found = WordSearch(items, width).hits(words)
    want, want_items = plain_hits(words, items, width)
    assert [bool(m) for m in marked] == want and found == want_items
    assert sum(s["last"] - s["first"] + 1 for s in marked_spans(marked)) == sum(want)


@pytest.mark.parametrize("block_bytes", [1 << 24, 60])
def test_blocks_of_the_benchmark_agree(spark, block_bytes):
    bench = spark.createDataFrame(
        [(3, sentence(12)), (11, sentence(12, 5)), (4, "two words"), (5, None), (6, ""), (None, sentence(11, 3)), (3, "one")],
        "item_id long, text string",
    )
    got = find_benchmark(clashing(spark), bench, block_bytes=block_bytes).collect()
    items = [(str(r.item_id) if r.item_id is not None else None, r.text) for r in bench.collect()]
    assert len(got) == 12
    for r in got:
        marked, found = plain_hits(alnum_words(r.text), items, 10)
        assert (r.n_words, r["items"]) == (len(alnum_words(r.text)), sorted(found))
        assert [(s.first, s.last) for s in r.spans] == [(s["first"], s["last"]) for s in marked_spans(bytearray(marked))]
    kept = drop_contaminated(documents(spark), bench)
    assert kept.columns == documents(spark).columns
    assert {r.doc_id for r in kept.collect()} == {3, 4, 5, 8, None}


def test_empty_tables(spark):
    none = documents(spark, [])
    bench = spark.createDataFrame([], "item_id long, text string")
    assert find_benchmark(none, bench).count() == 0
    assert not any(r.spans for r in find_benchmark(documents(spark), bench).collect())
    assert scan_licenses(none).count() == 0 and apply_quality_rules(none).count() == 0


def test_license_rules_and_suppression():
    assert sum(map(len, rules().values())) >= 200
    label = lambda text: [d[0] for d in detect(alnum_words(text))]
    assert label("Released under the MIT License.") == ["mit"]
    assert label("SPDX-License-Identifier: Apache-2.0") == ["apache"]
    assert label("you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License") == ["lgpl"]
    assert label("distributed under the Mozilla Public License Version 2.0 and the BSD 3-Clause License") == ["mpl", "bsd"]
    assert label("the house was admitted to a generally public library") == []
    found = detect(alnum_words("x " * 40 + "mit license " * 3))
    assert [(d[1], d[2]) for d in found] == [(40, 41), (42, 43), (44, 45)]


def test_license_expressions_and_long_holders():
    label = lambda text: [d[0] for d in detect(alnum_words(text))]
    head = "x SPDX-License-Identifier: "
    assert label(head + "MIT OR Apache-2.0") == ["mit", "apache"]
    assert label(head + "(MIT AND BSD-3-Clause) OR MPL-2.0\nint x;") == ["mit", "bsd", "mpl"]
    assert label(head + "GPL-2.0-only WITH Classpath-exception-2.0 OR Foo-1.0 OR MIT") == ["gpl", "mit"]
    assert label(head + "MIT\nmade by hand and sent to you") == ["mit"]
    holder = "Lawrence Livermore National Security, LLC, the U.S. Department of Energy, the University of California"
    assert label(f"Neither the name of {holder} nor the names of its contributors may be used to endorse or promote products") == ["bsd"]


def test_phrases_by_brute_force(spark):
    phrases = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    texts = ["MIT License mit license MIT  license", "the mit licenses", "GNU General Public License; general public-license", "apache\nLICENSE", "", None, "permit license"]
    for r in scan_licenses(spark.createDataFrame([(t,) for t in texts], "text string")).collect():
        words = [w.decode() for w in alnum_words(r.text)]
        want = sorted((i, label) for p, label in phrases.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
        assert [(p.word, p.label) for p in r.places] == want == phrase_places(alnum_words(r.text), phrases)
    assert scan_licenses(clashing(spark)).count() == 12


def plain_quality(text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    repeat = {k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
    failed = len(words) < 20 or 100 * len(repeat) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeat), failed


def test_quality_measures_by_brute_force(spark):
    twice = sentence(9, 2)
    rows = [(20 + i, t, None, None, None) for i, t in enumerate([
        f"{twice} x {twice} y " + sentence(30), "a " * 50, "same line\nsame line\n \n\nsame line\nother " + sentence(20),
        "home | about | news | contact\n" + sentence(30) + ".", "one | two | three | four | five\n" * 30, "#$% *** &&& <>" * 9, sentence(7), sentence(8) + " " + sentence(8),
    ])]
    got = apply_quality_rules(clashing(spark).unionByName(documents(spark, rows), allowMissingColumns=True)).collect()
    assert len(got) == 20
    for r in got:
        want = plain_quality(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want, r.text
        assert not (r.base_failed and r.kept)
    by_id = {r.doc_id: r for r in got}
    assert by_id[1].kept and by_id[1].clean_text == by_id[1].text and by_id[23].kept and not by_id[24].kept
    assert by_id[23].clean_text == sentence(30) + "."


def test_quality_runs_no_python(spark):
    from pyspark.sql import functions as F

    plan = apply_quality_rules(spark.range(3).select(F.col("id").cast("string").alias("text")))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_folding_and_exceptions():
    assert tox.fold("ІDІОT 1d1ot tra$h it's 2024 abc123") == ["idiot", "idiot", "trash", "it", "s", "2024", "abc123"]
    matcher = tox.Matcher({"trash ": 2.0, "idio": 1.5, "idiot ": 3.0}, ("trash can",))
    assert matcher.entries("the trash can is no trash idiots idiot".split()) == ["trash ", "idio", "idiot "]
    assert tox.Matcher({}).entries(["a"]) == []


def test_toxicity_learns_scores_and_survives_nothing(spark):
    rows = [(i, sentence(30, i) + (" you scumbag" if i % 3 == 0 else "") + " end", None, None, None) for i in range(240)]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(0, 240, 2)] + [(None, 1), (3, None), (999, 1)], "doc_id long, toxic int")
    model = tox.fit_toxicity(docs, labels)
    scores = {r.id: r.score for r in tox.score_toxicity(docs, model).collect()}
    assert all((scores[i] > 0.7) == (i % 3 == 0) for i in range(240))
    got = tox.score_toxicity(clashing(spark), model).collect()
    assert len(got) == 12 and all(0 <= r.score <= 1 for r in got)
    nothing = tox.fit_toxicity(docs, labels.limit(0))
    assert all(r.score < 0.01 for r in tox.score_toxicity(documents(spark), nothing).collect())
    assert tox.score_toxicity(documents(spark, []), model).count() == 0


def test_toxicity_on_held_out_labels(spark, data_dir):
    from tessella.llm.queries_toxicity import op10_toxicity

    where = data_dir.replace("sf0.001", "sf0.1")
    labels = spark.read.parquet(f"{where}/labels.parquet")
    seen = op10_toxicity(spark, where).where("held_out").join(labels, "doc_id").select("predicted", "toxic").collect()
    hit = sum(r.predicted and r.toxic for r in seen)
    assert hit / sum(r.predicted for r in seen) > 0.85 and hit / sum(r.toxic for r in seen) > 0.7


def test_schema_constant():
    assert SCHEMA.startswith("doc_id long")
