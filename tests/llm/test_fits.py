"""Fits on repeated ids, and exception phrases in long texts."""

import time

from data import documents
from pyspark.sql import functions as F

from tessella.llm import language, toxicity


def plain_entries(matcher, words):
    """Hits outside exception phrases, by trying every word against every phrase."""
    text, out = f" {' '.join(words)} ", []
    spans = []
    for phrase in matcher.phrases:
        at = text.find(f" {phrase} ")
        while at >= 0:
            spans.append((at, at + len(phrase) + 1))
            at = text.find(f" {phrase} ", at + 1)
    place = 0
    for word in words:
        known = [e for e in matcher.weights if f"{word} ".startswith(e)]
        if known and not any(a <= place < b for a, b in spans):
            out.append(max(known, key=len))
        place += len(word) + 1
    return out


def test_exceptions_by_brute_force_and_in_linear_time():
    import random

    phrases = ("trash can", "can opener", "a trash can", "clown")
    weights = {"trash ": 2.0, "can": 1.0, "clown ": 3.0, "op": 1.0}
    matcher = toxicity.Matcher(weights, phrases)
    object.__setattr__(matcher, "phrases", phrases)
    draw = random.Random(4)
    for _ in range(300):
        words = [draw.choice(["a", "trash", "can", "opener", "clown", "cannot", "x"]) for _ in range(draw.randint(0, 14))]
        assert sorted(matcher.entries(words)) == sorted(plain_entries(matcher, words)), words
    took = []
    for n in (50_000, 200_000):
        words = ["trash", "can", "trash"] * (n // 3)
        start = time.perf_counter()
        assert len(matcher.entries(words)) > 0
        took.append(time.perf_counter() - start)
    assert took[1] < 12 * took[0] + 1


def test_a_repeated_id_brings_one_row(spark):
    rows = [(i, f"word{i} " + ("vile scum " if i % 2 else "calm day ") * 5, "en", "s", 1) for i in range(60)]
    rows += [(1, f"copy {k}", "en", "s", 1) for k in range(500)] + [(1, None, "en", "s", 1)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(documents(spark, rows), labels)
    again = toxicity.fit_toxicity(documents(spark, rows).repartition(7), labels)
    assert model.weights == again.weights and any("scum" in e or "vile" in e for e in model.weights)


def test_language_rows_are_chosen_without_regard_to_partitions(spark):
    rows = [(i % 7, f"the house number {i % 40} and the tree", "en", "s", 1) for i in range(400)] + [(None, "das haus", "de", "s", 1)]
    frame = documents(spark, rows)
    first = language.fit_text_model(frame.repartition(1), training_rows=20)
    second = language.fit_text_model(frame.repartition(9).orderBy(F.rand(3)), training_rows=20)
    assert first.languages == second.languages == ("en",) and (first.table == second.table).all()


def test_phrases_count_against_the_length_of_their_line(spark):
    from tessella.llm.quality import apply_quality_rules

    prose = " ".join(f"word{i}" for i in range(200))
    rows = [
        (1, f"{prose} you can read more in chapter two", "en", "s", 1),
        (2, "\n".join(["Read more", "Alle Rechte vorbehalten.", "Lire la suite", "Leer más aquí", prose]), "en", "s", 1),
        (3, f"{prose} and so on...\nNews from the town ...\nMore to come…\n", "en", "s", 1),
    ]
    got = {r.doc_id: r for r in apply_quality_rules(documents(spark, rows)).collect()}
    assert [got[i].n_failed_lines for i in (1, 2, 3)] == [0, 4, 2] and all(r.kept for r in got.values())


def test_names_in_any_case_and_map_columns(spark):
    from tessella.llm import decontaminate, licenses, simhash

    frame = documents(spark).select("*", *[F.lit(c).alias(c) for c in ("N_WORDS", "Spans", "ITEMS", "Places", "Detections")])
    bench = spark.createDataFrame([("q", "alpha0 beta1"), ("q2", None)], "item_id string, text string")
    hits = decontaminate.find_benchmark(frame, bench)
    assert hits.columns == ["doc_id", "text", "lang", "source", "n_chars", "Places", "Detections", "n_words", "spans", "items"]
    assert hits.select("n_words", "spans").count() == 12
    kept = decontaminate.drop_contaminated(frame, bench)
    assert kept.columns == frame.columns and {r.N_WORDS for r in kept.collect()} == {"N_WORDS"}
    scanned = licenses.scan_licenses(frame)
    assert scanned.select("n_words", "places", "detections").count() == 12 and "Places" not in scanned.columns
    mapped = documents(spark).withColumn("extra", F.create_map(F.lit("k"), F.lit(1)))
    for stay in (simhash.drop_near_copies(mapped), language.keep_identified(mapped)):
        assert stay.columns == mapped.columns and stay.count() <= 12


def test_shards_of_string_keys(spark):
    from tessella.llm import sharding

    frame = spark.createDataFrame([(f"doc-{i}", "x" * i) for i in range(200)] + [(None, None)], "doc_id string, text string")
    got = sharding.assign_shards(frame, shards=5).collect()
    assert len(got) == 201 and {r.shard for r in got} == set(range(5)) and all(r.grown_shard in (r.shard, 5) for r in got)
    for shard in range(5):
        own = sorted(r.slot for r in got if r.shard == shard)
        assert own == list(range(len(own)))
