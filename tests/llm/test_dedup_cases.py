"""Hard cases of the three deduplications: hot strings, narrow hashes, short texts, clashing columns."""

import random

import numpy as np
import pytest

from veritempo.llm import line_dedup, minhash, shingles, suffix_dedup

from .test_operators import brute_bytes, brute_classes, words


def bytes_found(frame, length=100):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(frame, length, with_text=False).collect()}


@pytest.fixture(scope="module")
def phrases(spark):
    """One phrase in many surroundings, some of which repeat, and passages that overlap in all ways."""
    rng = random.Random(12)
    letters = lambda n: "".join(rng.choice("abcdef ") for _ in range(n))
    phrase, passage = letters(60), letters(400)
    around = [letters(45) for _ in range(12)]
    texts = [letters(rng.randrange(80)) + rng.choice(around) + phrase + rng.choice(around) + letters(rng.randrange(80)) for _ in range(150)]
    texts += [letters(30) + passage[a : a + rng.randrange(90, 250)] + letters(30) for a in (rng.randrange(200) for _ in range(40))]
    texts += [phrase * 4, phrase * 7 + "!", "a" * 500]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).cache()


@pytest.mark.parametrize("many", [(16, 20_000), (1, 20_000), (16, 3), (1_000, 1_000)])
def test_suffix_dedup_of_a_hot_phrase(phrases, monkeypatch, many):
    monkeypatch.setattr(suffix_dedup, "MANY", many[0])
    monkeypatch.setattr(suffix_dedup, "MANY_IN_ALL", many[1])
    monkeypatch.setattr(suffix_dedup, "CHUNK", 3_000)
    monkeypatch.setattr(suffix_dedup, "RANKED", 50)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 10_000)
    assert bytes_found(phrases) == brute_bytes(phrases.collect(), 100)


def test_suffix_dedup_with_colliding_names(phrases, monkeypatch):
    """Names of two bits: nearly all runs tie, and the bytes alone decide."""
    whole = suffix_dedup.cover_runs

    def narrow(data, ends, length):
        first, last, names, contexts, offsets = whole(data, ends, length)
        return first, last, names & 3, contexts, offsets

    monkeypatch.setattr(suffix_dedup, "cover_runs", narrow)
    monkeypatch.setattr(suffix_dedup, "MANY", 10**6)
    monkeypatch.setattr(suffix_dedup, "string_hashes", lambda strings: np.zeros(len(strings), np.uint64))
    assert bytes_found(phrases) == brute_bytes(phrases.collect(), 100)


def test_a_common_string_of_half_the_length_is_no_repeat(spark):
    rng = random.Random(3)
    common = words(rng, 20, 900)[:50]
    texts = [words(rng, 30, 9000)[:60] + common + words(rng, 30, 9000)[:60] for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.n_removed for r in suffix_dedup.remove_repeats(df).collect()} == {0}


def test_removal_replaces_columns_of_the_results_names(spark):
    rows = [(1, "x" * 150, 7, "a", 1), (2, "y" * 30, 8, "b", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_bytes long, kept_text string, n_spans int")
    found = suffix_dedup.remove_repeats(df)
    assert sorted(found.columns) == sorted(["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])
    assert {r.doc_id: (r.n_bytes, r.kept_text) for r in found.collect()} == {1: (150, "x"), 2: (30, "y" * 30)}


def test_tasks_remember_contexts(monkeypatch):
    seen = suffix_dedup._Seen()
    one = lambda *x: [np.array([v], np.int64) for v in x]
    assert not seen.earlier(*one(1, 2, 3, 4))[0]
    seen.keep(np.array([[20, 10], [2, 1], [5, 5], [7, 7]]), np.array([9]))
    assert seen.earlier(*one(1, 10, 6, 0))[0] and seen.earlier(*one(1, 10, 5, 8))[0]
    assert not seen.earlier(*one(1, 10, 5, 7))[0] and not seen.earlier(*one(2, 10, 6, 0))[0]
    seen.keep(np.array([[10], [1], [2], [3]]), np.array([8]))
    assert seen.earlier(*one(1, 10, 5, 7))[0] and set(seen.names) == {8, 9}
    monkeypatch.setattr(suffix_dedup, "REMEMBERED", 1)
    seen.keep(np.array([[30], [3], [0], [0]]), np.array([7]))
    assert seen.contexts.shape[1] == 1 and set(seen.names) == {7}


# Short texts --------------------------------------------------------------------------------------------------------


def test_shingles_of_short_texts():
    texts = [" ".join(f"w{i}" for i in range(n)) for n in (0, 1, 2, 3, 4, 5, 6, 2, 0)]
    found, sizes = shingles.shingles(texts)
    assert sizes.tolist() == [0, 1, 1, 1, 1, 1, 2, 1, 0]
    edges = np.concatenate([[0], np.cumsum(sizes)])
    for text, a, b in zip(texts, edges, edges[1:], strict=False):
        assert shingles.shingles([text])[0].tolist() == found[a:b].tolist()


@pytest.mark.parametrize("partitions", [1, 16])
def test_near_duplicates_of_short_texts(spark, partitions):
    texts = ["thank you", "Thank you", "thank  you ", "you thank", "one", "One", "a b c", "A b c", "a b c d", "a b c d e", "A B c d e", "a b c d e f", "", " ", None, None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(partitions)
    assert {r.doc_id: r.class_id for r in minhash.near_duplicates(df).collect()} == brute_classes(df.collect())


# Lines --------------------------------------------------------------------------------------------------------------


def test_depth_and_source_of_repeated_lines(spark):
    """Every suffix against brute force: the greatest doubled depth shared with an earlier one, and its first place."""
    rng = random.Random(6)
    texts = ["\n".join(rng.choice("abcd") for _ in range(rng.randrange(1, 60))) for _ in range(12)]
    texts += [texts[3], texts[3] + "\nx\n" + texts[4], "\n".join("z" * 40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {(r["__doc"], r.n): (r.depth, r.first["__doc"], r.first.n) for r in line_dedup.repeated_suffixes(df, 3).collect()}
    expected, depth = {}, 3
    while depth < 200:
        seen = {}
        for d, text in enumerate(texts):
            lines = text.split("\n")
            for n in range(len(lines) - depth + 1):
                place = seen.setdefault(tuple(lines[n : n + depth]), (d, n))
                if place != (d, n):
                    expected[d, n] = (depth, *place)
        depth *= 2
    assert found == expected and max(d for d, *_ in expected.values()) >= 24


def test_parity_bitmaps_never_rule_out_similar_sets():
    rng = np.random.default_rng(8)
    for _ in range(60):
        a = rng.integers(0, 1 << 60, rng.integers(1, 400)).astype(np.uint64)
        kept = a[rng.random(len(a)) < rng.uniform(0.6, 1)]
        b = np.concatenate([kept, rng.integers(0, 1 << 60, rng.integers(0, 40)).astype(np.uint64)])
        a, b = np.unique(a), np.unique(b)
        bits = minhash.parity_bitmaps(np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)]), 2)
        apart = int(np.bitwise_count((bits[0] ^ bits[1]).view(np.uint64)).sum())
        common = len(np.intersect1d(a, b))
        assert apart <= len(a) + len(b) - 2 * common
        if len(b) and common / (len(a) + len(b) - common) >= 0.8:
            assert apart <= (len(a) + len(b)) * 0.2 / 1.8 + 1e-6


def test_turns_of_near_duplicates_leave_no_files_behind(spark):
    """On many partitions every table that a turn kept was a file for each; only the classes are left now."""
    from pathlib import Path

    from veritempo.llm.common import shared_folder

    words = [f"w{i}" for i in range(300)]
    docs = spark.createDataFrame([(i, " ".join(words[i % 5 * 40 : i % 5 * 40 + 60] + [f"x{i}"] * (i % 2))) for i in range(60)], "doc_id long, text string")
    folder = Path(shared_folder(spark).removeprefix("file:"))
    settings = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before, old = {*folder.rglob("*")}, {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        found = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    left = [p for p in folder.rglob("*") if p not in before and p.is_file()]
    assert found == {i: i % 5 for i in range(60)} and len(left) <= 2 * 40 + 2
