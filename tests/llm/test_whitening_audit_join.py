"""Whitening, filter audit and n-gram join against brute force, on small tables with all their odd cases."""

import hashlib
import itertools
import random
import re
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from veritempo.llm import filter_audit, ngram_join, whitening
from veritempo.llm.queries import ORACLE_SQL
from veritempo.llm.shingles import ascii_shingles

# Whitening ----------------------------------------------------------------------------------------------------------


def exact_fit(x):
    """n, sums and n C - S S' with Python's integers."""
    n, d = len(x), len(x[0])
    sums = [sum(r[j] for r in x) for j in range(d)]
    return n, sums, [[n * sum(r[i] * r[j] for r in x) - sums[i] * sums[j] for j in range(d)] for i in range(d)]


@pytest.mark.parametrize("size", [10, 40, 61])
def test_cross_products_are_exact(size):
    rng = random.Random(size)
    y = np.array([[rng.randrange(-(1 << size), 1 << size) for _ in range(5)] for _ in range(300)], np.int64)
    brute = [[sum(int(a) * int(b) for a, b in zip(y[:, i], y[:, j], strict=True)) for j in range(5)] for i in range(5)]
    assert whitening.cross_products(y).tolist() == brute
    held = whitening.Scatter(y[0])
    for part in np.array_split(y, 7):
        held.add(part)
    sums, products = held.about_zero()
    assert held.n == 300 and products.tolist() == brute and sums.tolist() == [sum(int(v) for v in c) for c in y.T]


def test_whitening_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    good = (rng.normal(size=(120, 12)) * np.linspace(0.2, 2, 12) + 5).astype(np.float32)
    rows = [(i, [float(v) for v in good[i]], 1.0, "x") for i in range(120)]
    odd = [(200, None, 1.0, "x"), (201, [], 1.0, "x"), (202, [1.0] * 11 + [None], 1.0, "x"), (203, [float("nan")] * 12, 1.0, "x"), (204, [float("inf")] + [1.0] * 11, 1.0, "x")]
    more = [rows[5], (None, rows[7][1], 1.0, "x")]
    df = spark.createDataFrame(rows + odd + more, "vec_id long, embedding array<float>, n double, component string").repartition(5)
    found = whitening.whiten(df).collect()
    kept = rows + more
    x = [[int(np.floor(1024 * np.float64(np.float32(c)))) + 100_000 for c in v] for _, v, _, _ in kept]
    n, sums, scatter = exact_fit(x)
    assert len(found) == 8 * len(kept) and {r.n for r in found} == {n}
    assert sorted((r.vec_id is None, r.vec_id or 0, r.component) for r in found) == sorted((i is None, i or 0, k) for i, *_ in kept for k in range(1, 9))
    covariance = np.array([[float(Fraction(v, n * n)) for v in row] for row in scatter])
    values, vectors = np.linalg.eigh(covariance)
    by_row = {}
    for r in found:
        by_row.setdefault(r.vec_id, {})[r.component] = r
    for (i, *_), v in zip(kept, x, strict=True):
        centred = [n * a - s for a, s in zip(v, sums, strict=True)]
        assert {int(r.deviation) for r in by_row[i].values()} == {sum(c * c for c in centred)}
    z = np.array([[by_row[i][k].whitened for k in range(1, 9)] for i, *_ in kept])
    centred = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(v, sums, strict=True)] for v in x])
    brute = centred @ vectors[:, ::-1][:, :8] / np.sqrt(values[::-1][:8])
    assert np.allclose(np.abs(z), np.abs(brute), atol=1e-9)
    assert np.abs(z.T @ z / n - np.eye(8)).max() < 1e-9
    assert {r.identity_error for r in found}.pop() < 1e-9
    assert np.allclose([by_row[0][k].explained for k in range(1, 9)], values[::-1][:8] / values.sum(), rtol=1e-9)


def test_whitening_of_what_does_not_vary(spark):
    schema = "vec_id long, embedding array<double>"
    one = whitening.whiten(spark.createDataFrame([(1, [0.5, 0.25])], schema)).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in sorted(one, key=lambda r: r.component)] == [(k, 1, 0, None, None, None) for k in (1, 2)]
    flat = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0]) for i in range(6)], schema)).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in flat) and {r.explained for r in flat if r.component == 1} == {1.0}
    assert whitening.whiten(spark.createDataFrame([], schema)).collect() == []


def test_whitening_of_huge_entries_and_other_lengths(spark):
    rows = [(i, [1e30 if i % 2 else -1e30, float(i)]) for i in range(8)] + [(100 + i, [float(i * i), 1.5, float(i)]) for i in range(5)]
    found = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)).collect()
    assert {r.n for r in found if r.vec_id < 100} == {8} and {r.n for r in found if r.vec_id >= 100} == {5}
    assert {r.deviation for r in found if r.vec_id < 100} == {None}  # more than 38 digits
    first = [r.whitened for r in found if r.vec_id < 100 and r.component == 1]
    assert np.allclose(np.abs(first), 1)


# Filter audit -------------------------------------------------------------------------------------------------------

DOCS, LABELS = "doc_id long, text string, lang string, mask int, part string", "doc_id long, quality int, toxic int"


def texts_with_failures():
    rng = random.Random(4)
    out = []
    for i in range(160):
        n = rng.choice([0, 1, 3, 199, 200, 201, 260])
        stock = rng.choice([3, 100, 101, 4000])
        words = [f"w{rng.randrange(stock)}" if stock < 4000 else f"w{i}_{k}" for k in range(n)]
        text = rng.choice([" ", "\n", "\t", "  ", "\x0b"]).join(words)
        text += rng.choice(["", "", " A" * rng.randrange(40), " ÀÉ"]) + rng.choice(["", "", "", "#", "|"])
        out.append(text)
    return out + [out[0], out[3], out[3], None, None, "", " "] + out[:20]


def audit_rows():
    rng = random.Random(6)
    docs = [(i if i % 23 else i // 2, t, rng.choice(["en", "de", None, ""]), 1, "z") for i, t in enumerate(texts_with_failures())]
    docs += [(None, docs[8][1], "en", 1, "z"), docs[9]]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 150, 2)] + [(4, 1, 1), (None, 1, 1), (100_000, 1, 1)]
    return docs, labels


def brute_audit(docs, labels):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    good, toxic = ({d for d, *x in labels if x[k] == 1 and d is not None} for k in (0, 1))
    parts = {}
    for doc_id, text, lang, *_ in docs:
        t = text or ""
        w = word.findall(t)
        fails = {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": bool(re.search("[#$%&*|]", t)),
            "E": doc_id is not None and any(o[0] is not None and o[0] < doc_id and (o[1] or "") == t for o in docs),
        }
        parts.setdefault(lang or "", []).append((fails, doc_id in good, doc_id in toxic))
    out = {}
    for part, rows in parts.items():
        total = dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            left = list(rows)
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[0][f]]
                failing = [r for r in rows if r[0][f]]
                left = [r for r in left if not r[0][f]]
                total[f] += len(gone)
                only = [r for r in rows if [k for k, v in r[0].items() if v] == [f]]
                out[part, order, step] = [len(left), len(gone), len(failing) - len(gone), len(only), sum(r[1] for r in gone), sum(r[2] for r in gone), f]
        for (p, *_), row in out.items():
            if p == part:
                row[6] = total[row[6]] if isinstance(row[6], str) else row[6]
    return {k: tuple(v) for k, v in out.items()}


def test_filter_audit_equals_brute_force(spark, monkeypatch):
    docs, labels = audit_rows()
    frames = spark.createDataFrame(docs, DOCS).repartition(4), spark.createDataFrame(labels, LABELS)
    expected = brute_audit(docs, labels)
    for held in (filter_audit.HELD_PARTS, 1):
        monkeypatch.setattr(filter_audit, "HELD_PARTS", held)
        found = filter_audit.audit(*frames).collect()
        assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in found} == expected
        assert len(found) == len(expected) == 3 * 600
    con = duckdb.connect()
    con.register("d", pa.table({c: [r[i] for r in docs] for i, c in enumerate(["doc_id", "text", "lang"])}))
    con.register("l", pa.table({c: [r[i] for r in labels] for i, c in enumerate(["doc_id", "quality", "toxic"])}))
    con.execute("CREATE VIEW documents AS SELECT * FROM d")
    con.execute("CREATE VIEW labels AS SELECT * FROM l")
    assert {tuple(r[:3]): tuple(r[3:]) for r in con.sql(ORACLE_SQL["op12_filter_audit"]).fetchall()} == expected


def test_filter_audit_of_nothing(spark):
    assert filter_audit.audit(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)).collect() == []
    one = filter_audit.audit(spark.createDataFrame([(1, None, None, 1, "z")], DOCS), spark.createDataFrame([], LABELS)).collect()
    assert len(one) == 600 and {r.part for r in one} == {""} and all(r.removed == (r.filter_order[r.step - 1] == "A") for r in one)


def test_first_failures():
    table = filter_audit.first_failures()
    assert table.shape == (32, 120) and not table[0].any() and (table[31] == 1).all()
    o = filter_audit.ORDERS.index("EDCBA")
    assert [int(table[1 << k, o]) for k in range(5)] == [5, 4, 3, 2, 1] and table[0b00110, o] == 3


# N-gram join --------------------------------------------------------------------------------------------------------

JOINED = "doc_id long, text string, size int, token string, component string"


def shingle_set(text, words=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))) if w else frozenset()


def brute_components(rows, percent=90):
    sets, owners = {}, {}
    for doc_id, text, *_ in rows:
        s = shingle_set(text)
        if s and doc_id is not None:
            owners[s] = min(owners.get(s, doc_id), doc_id)
    named = list(owners)
    label = {s: s for s in named}

    def root(s):
        while label[s] != s:
            s = label[s]
        return s

    for a, b in itertools.combinations(named, 2):
        common = len(a & b)
        if 100 * common >= percent * (len(a) + len(b) - common):
            label[root(a)] = root(b)
    for s in named:
        sets.setdefault(root(s), []).append(owners[s])
    least = {s: min(sets[root(s)]) for s in named}
    return sorted((d is None, d or 0, len(shingle_set(t)), None if d is None else least.get(shingle_set(t), d)) for d, t, *_ in rows)


def joined(rows):
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in rows)


def near_corpus(seed, groups=6, size=14, stock=3000):
    """Groups whose members differ from their middle by a few words, so that links chain and many pairs are near 0.9."""
    rng = random.Random(seed)
    texts = []
    for _ in range(groups):
        n = rng.choice([4, 11, 12, 13, 40, 120, 400])
        middle = [f"W{rng.randrange(stock)}" for _ in range(n)]
        for _ in range(size):
            words = list(middle)
            for _ in range(rng.randrange(0, max(2, n // 40))):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            if rng.random() < 0.3:
                words += [f"y{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 3 + n // 20))]
            texts.append(" ".join(words))
    passage = " ".join(f"p{k}" for k in range(60))
    texts += [f"{passage} " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 30))) for _ in range(12)]
    texts += [None, "", " \n\t", "one", "ONE", "one two", "one two", "Ä b c", "ä b c", "a\x01b c", "a b c", "x" * 3000, " ".join(f"z{k % 5000}" for k in range(15_000))]
    rng.shuffle(texts)
    rows = [(i, t, i, "t", "c") for i, t in enumerate(texts)]
    return rows + rows[:3] + [(None, texts[5], 0, "t", "c"), (7, texts[9] or "other", 0, "t", "c"), (200, texts[0], 0, "t", "c"), (200, texts[1], 0, "t", "c")]


@pytest.mark.parametrize(("seed", "rounds"), [(1, 2), (2, 0), (3, 1)])
def test_ngram_join_equals_brute_force(spark, seed, rounds):
    rows = near_corpus(seed)
    df = spark.createDataFrame(rows, JOINED).repartition(5)
    # few counters, so that many shingles share one, as on large tables
    assert joined(ngram_join.linked(df, rounds=rounds, n_counters=1 << 12).collect()) == brute_components(rows)


def test_ngram_join_of_nothing_and_of_single_documents(spark):
    assert ngram_join.linked(spark.createDataFrame([], JOINED)).collect() == []
    rows = [(3, None, 0, "", ""), (4, "a b c d", 0, "", ""), (5, "", 0, "", "")]
    assert joined(ngram_join.linked(spark.createDataFrame(rows, JOINED)).collect()) == brute_components(rows)


@pytest.mark.parametrize(("usual", "most"), [(0, 8), (4, 8), (40, 1)])
def test_prefixes_hold_the_matches_that_they_promise(usual, most):
    """Any two similar sets share the smaller of their m within the prefixes that their sizes ask for."""
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 62, 220, np.uint64)
    sets = [np.unique(np.concatenate([np.delete(base, rng.choice(220, k, False)), rng.integers(0, 1 << 62, k // 2, np.uint64)])) for k in rng.integers(0, 16, 60)]
    elements, sizes = np.concatenate(sets), np.array([len(s) for s in sets])
    owner, seen = np.repeat(np.arange(len(sets)), sizes), (elements % np.uint64(97)).astype(np.int64)
    m, length, tokens = ngram_join.multi_match_prefixes(elements, owner, sizes, seen, usual, 90)
    assert m.max() == most
    prefixes = [t.tolist() for t in np.split(tokens, np.cumsum(length)[:-1])]
    for a, b in itertools.combinations(range(len(sets)), 2):
        common = len(np.intersect1d(sets[a], sets[b]))
        if 100 * common >= 90 * (sizes[a] + sizes[b] - common):
            k, need = min(m[a], m[b]), -(-90 * (sizes[a] + sizes[b]) // 190)
            left, right = prefixes[a][: sizes[a] - need + k], prefixes[b][: sizes[b] - need + k]
            assert len(set(left) & set(right)) >= k


def test_ascii_shingles_split_at_the_named_bytes_only():
    same = ["A b\x0bC d", "a B\tc\nD"]
    (first, second) = (ascii_shingles([t], 3)[0].tolist() for t in same)
    assert first == second and len(first) == 2
    for text in ("Ä b c", "a\x01b c", "a b c d", "a\x1fb"):
        assert len(set(ascii_shingles([text], 3)[0].tolist())) == len(shingle_set(text))
    assert ascii_shingles(["Ä b c"], 3)[0].tolist() != ascii_shingles(["ä b c"], 3)[0].tolist()


def test_text_failures_digest_whole_texts():
    assert filter_audit.text_failures(None) == filter_audit.text_failures("") == (1, hashlib.sha256(b"").digest())
