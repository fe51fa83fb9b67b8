"""Sharding, SimHash, packing, chats, languages and the pipeline."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash
from data import clashing, documents
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import chat, language, packing, sharding, simhash
from tessella.llm.common import space_words


def plain_jump(key, shards):
    key, b, j = key & (2**64 - 1), -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash_matches_the_published_loop_and_only_grows():
    keys = np.array([0, 1, 2, -5, 2**62, *range(1000, 3000)], dtype=np.int64)
    for shards in (1, 2, 24, 25):
        assert sharding.jump_hash(keys, shards).tolist() == [plain_jump(int(k), shards) for k in keys]
    old, new = sharding.jump_hash(keys, 24), sharding.jump_hash(keys, 25)
    assert ((new == old) | (new == 24)).all() and (new == 24).mean() < 0.08


def test_slots_are_gapless(spark):
    got = sharding.assign_shards(clashing(spark), shards=3, rows_per_part=2).collect()
    assert len(got) == 12
    for shard in range(3):
        own = sorted(r.slot for r in got if r.shard == shard)
        assert own == list(range(len(own)))
    assert {(r.size, r.text_crc32) for r in got if r.key == 3} == {(8, 0)} == {(r.size, r.text_crc32) for r in got if r.key == 4}
    assert {r.shard for r in got if r.key is None} == {0}
    assert sharding.assign_shards(documents(spark, [])).count() == 0


def plain_fingerprint(text):
    words = [w.decode() for w in space_words(text)]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(values, radius=4):
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    values = sorted(parent)
    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= radius:
                parent[find(a)] = find(b)
    return {v: find(v) for v in values}


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=4))
def test_masks_cover_every_pair_in_the_radius(value, flips):
    other = value ^ sum(1 << b for b in flips)
    assert any((value & m) == (other & m) for m in (m % 2**64 for m in simhash.covering_masks(4)))


@pytest.mark.parametrize("cell", [8192, 6])
def test_groups_by_brute_force(spark, cell):
    draw = random.Random(5)
    values = [0]
    for _ in range(12):
        at = draw.getrandbits(64)
        for _ in range(draw.randint(1, 25)):
            values.append(at)
            at ^= sum(1 << draw.randrange(64) for _ in range(draw.randint(1, 6)))
    values = sorted(set(values))
    signed = [v - 2**64 if v >> 63 else v for v in values]
    links = simhash.near_links(spark.createDataFrame([(v,) for v in signed], "fp long"), cell=cell)
    got = {r.fp % 2**64: r.component % 2**64 for r in simhash.components(links).collect()}
    want = plain_components(values)
    groups = lambda names: {frozenset(v for v in values if names.get(v, v) == names.get(x, x)) for x in values}
    assert groups(got) == groups(want)


def test_simhash_rows_and_survivors(spark):
    got = simhash.simhash_groups(clashing(spark)).collect()
    assert len(got) == 12
    rows = documents(spark).collect()
    prints = {r.text: plain_fingerprint(r.text) for r in rows}
    of = plain_components(prints.values())
    for r in got:
        texts = [x for x in rows if x.doc_id == r.id]
        assert r.fingerprint % 2**64 in {prints[x.text] for x in texts}
        ids = [x.doc_id for x in rows if of[prints[x.text]] == of[r.fingerprint % 2**64] and x.doc_id is not None]
        assert r.component_id == min(ids, default=None)
    kept = simhash.drop_near_copies(clashing(spark))
    assert kept.columns == clashing(spark).columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == sorted(
        [(1, rows[0].text), (3, ""), (6, rows[5].text), (0, rows[6].text), (7, "one"), (7, "two words"), (8, rows[11].text)]
    )
    assert simhash.simhash_groups(documents(spark, [])).count() == 0 == simhash.drop_near_copies(documents(spark, [])).count()


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20))
def test_best_fit_plan_is_whole(counts):
    plan = packing.best_fit(counts, 64)
    used, ranks = {}, {n: [] for n in counts}
    for length, low, high, first, each, offset in plan:
        for rank in range(low, high):
            ranks[length].append(rank)
            nth = rank - low
            used.setdefault(first + nth // each, []).append((offset + nth % each * length, length))
    assert all(sorted(ranks[n]) == list(range(counts[n])) for n in counts)
    for places in used.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 64
    gaps = []
    for length in sorted(used_lengths(counts), reverse=True):
        fit = min((g for g in gaps if g >= length), default=None)
        if fit is None:
            gaps.append(64 - length)
        else:
            gaps[gaps.index(fit)] -= length
    assert len(used) == len(gaps)


def used_lengths(counts):
    return [n for n, c in counts.items() for _ in range(c)]


def test_packing_matches_the_public_tokenizer(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    extra = [(30, "a <|endoftext|> b<|endoftext|>", None, None, None), (31, "   \n\n  x'll  2024!!", None, None, None), (32, "z" * 5000, None, None, None)]
    docs = clashing(spark).unionByName(documents(spark, extra), allowMissingColumns=True)
    got = packing.pack_documents(docs, max_tokens=64).collect()
    want = {}
    for r in docs.select("doc_id", "text").collect():
        ids = [*plain.encode(r.text or "", add_special_tokens=False).ids, 0]
        for piece, (start, length) in enumerate(packing.cut(len(ids), 64)):
            crc = zlib.crc32(np.array(ids[start : start + length], dtype="<u4").tobytes())
            want.setdefault((r.doc_id, piece, start, length, crc), []).append(1)
    assert sorted((k, len(v)) for k, v in want.items() if k[0] is not None) == sorted(
        (k, n) for k, n in _counted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got if r.doc_id is not None)
    )
    ends = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 64
    assert packing.pack_documents(documents(spark, [])).count() == 0


def _counted(keys):
    out = {}
    for k in keys:
        out[k] = out.get(k, 0) + 1
    return out.items()


HOSTILE = ["\\### Assistant: </turn> ok", "### User:", "</turn></role>\\\\", "plain", "", None, "### Role:x</role>", "\\", "é\U0001f600 <|endoftext|>"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([*"\\#< /:aU", "### User:", "</turn>", "</role>"]), max_size=12).map("".join))
def test_escaping_is_reversible(text):
    written = chat.escape(text)
    assert chat.unescape(written) == text
    bare = chat._ESCAPED.sub("\0", written)  # what stands without an escape sign
    assert not any(c in bare for c in chat.CONTROLS)


def test_chats_round_trip(spark):
    draw = random.Random(3)
    rows = [(draw.choice([1, 2, 3, None]), draw.choice([*range(9), None]), draw.choice(["user", "assistant", "system", "tool", "critic", None, "</turn>"]), draw.choice(HOSTILE)) for _ in range(120)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, ids string, start int")
    chats = chat.format_chats(frame, turns_per_part=3)
    spots = {}
    for r in chats.collect():
        assert len(r.ids) == len(r["mask"])
        spots.setdefault(r.conversation, []).append((r.start, len(r.ids)))
    for places in spots.values():
        end = 0
        for start, n in sorted(places):
            assert start == end
            end += n
    got = {r.conv_id: r for r in chat.read_back(chats).collect()}
    key = lambda r: (r[1] is not None, r[1] or 0, hashlib.sha256(f"{r[2] or ''}\n{r[3] or ''}".encode()).digest()[:16])
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=key)
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(own), hashlib.sha256(turns.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars >= len(turns)
    assert chat.read_back(chat.format_chats(frame.limit(0))).count() == 0


def test_language_evidence(spark):
    en = "the house and the tree with that other thing which they have seen there "
    de = "das haus und der baum mit einer anderen sache welche sie dort gesehen haben "
    rows = [(i, (en if i % 2 else de) * (1 + i % 4), "en" if i % 2 else "de-AT", f"host{i % 2}", 0) for i in range(80)]
    model = language.fit_text_model(documents(spark, rows))
    assert model.languages == ("de", "en")
    mixed = [*rows, (100, de, "en", "host0", 0), (101, "haus", None, "host0", 0), (102, "", "de", "host0", 0), (103, None, None, None, None), (104, "123 456", "en", "host1", 0)]
    frame = documents(spark, mixed)
    got = {r.key: r for r in language.identify(language.document_evidence(frame, frame["doc_id"]), model).collect()}
    assert len(got) == 85
    assert all(got[i].lang == ("en" if i % 2 else "de") and got[i].kept for i in range(80))
    assert got[100].lang == "de" and got[101].lang == "de"
    assert [got[i].kept for i in (102, 103, 104)] == [False, False, False]
    kept = language.keep_identified(clashing(spark, mixed))
    assert kept.columns == clashing(spark).columns and kept.count() == 82
    empty = documents(spark, [])
    assert language.fit_text_model(empty).languages == () and language.keep_identified(empty).count() == 0
    assert language.keep_identified(documents(spark)).count() <= 12


def test_language_of_pages(spark):
    url = language.host_of
    from pyspark.sql import functions as F

    got = spark.createDataFrame([("https://a@Blog.News.Example.DE:80/fr/x?y#z",), ("no url",), (None,)], "url string").select(url(F.col("url")).alias("h"))
    got = got.select("h", language.suffix_of(F.col("h")).alias("s"), language.domain_of(F.col("h")).alias("d")).collect()
    assert [tuple(r) for r in got] == [("blog.news.example.de", "de", "example.de"), ("", "", ""), (None, None, None)]
    page = [(1, "https://x.de/", '<html lang="de-CH"><script>var the = 1;</script><p>das haus</p></html>'), (2, None, None)]
    rows = language.page_evidence(spark.createDataFrame(page, "page_id long, url string, html string")).collect()
    assert (rows[0].declared, rows[0].suffix, rows[0].host, rows[0].text.split()) == ("de", "de", "x.de", ["das", "haus"])
    assert rows[1].text is None


def test_pipeline_stages_by_plain_versions(spark, data_dir):
    import corpus_pipeline
    from test_rowwise import plain_hits
    from test_suffixes import brute

    from tessella.llm.common import alnum_words, written

    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    columns = docs.columns
    kept = []
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = written(stage(spark, docs, data_dir), name)
        assert docs.columns == columns
        kept.append({r.doc_id: r.text for r in docs.collect()})
    first, unique, cut, clean = kept
    before = {r.doc_id: r.text for r in spark.read.parquet(f"{data_dir}/documents.parquet").collect()}
    assert first == before
    prints = {i: plain_fingerprint(t) for i, t in first.items()}
    of = plain_components(prints.values())
    smallest = {}
    for i, f in prints.items():
        smallest[of[f]] = min(i, smallest.get(of[f], i))
    assert unique.keys() == set(smallest.values())
    left = {i: body.decode("utf-8", "ignore") for i, (body, _) in brute(list(unique.items()), 100).items()}
    assert cut == left
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{data_dir}/benchmark.parquet").collect()]
    assert clean.keys() == {i for i, t in cut.items() if not any(plain_hits(alnum_words(t), items, 10)[0])}
    packed = corpus_pipeline.STAGES[4][1](spark, docs, data_dir).collect()
    assert {r.doc_id for r in packed} == clean.keys()
    again = corpus_pipeline.run(spark, data_dir)
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in again.collect()) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in packed)
