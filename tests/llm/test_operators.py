"""The training-data operators against brute force, exact round trips and held-out accuracy, on small tables."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from veritempo.llm import bit_sliced, byte_bpe, components, language_id, line_dedup, minhash, packing, prefix_forest, pretokens, suffix_dedup, token_counts, url_filter, vectors
from veritempo.llm.queries import URL_RULES

BYTE_PATH, WORD_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, score double"


def words(rng, n, stock=40):
    return " ".join(f"w{rng.randrange(stock)}" for _ in range(n))


def corpus(seed=5):
    """Texts with copies, near copies, shared lines and passages, nulls, empties, repeated rows and a very long one."""
    rng = random.Random(seed)
    base = [words(rng, rng.randrange(30, 200), 4000) for _ in range(25)]
    texts = list(base)
    texts += base[:5]  # exact copies
    texts += [t + " and one more" for t in base[5:10]]  # near copies
    passage = words(rng, 60, 4000)
    texts += [f"{words(rng, 20, 4000)} {passage} {words(rng, 20, 4000)}" for _ in range(8)]
    block = "\n".join(words(rng, 6, 4000) for _ in range(3))
    texts += [f"{words(rng, 5, 4000)}\n{block}\n\n{words(rng, 5, 4000)}" for _ in range(6)]
    texts += [None, "", " \n ", "one two", "one two", "ab" * 200, "x" * 250, words(rng, 20_000, 4000), "ação über ñandú " * 30, "日本語 текст emoji 🙂 " * 20]
    rows = [(i, t, "en", f"s{i % 3}", len(t or ""), i, 0.5) for i, t in enumerate(texts)]
    return rows + [rows[3]]  # a repeated row


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# 8 and 9 ------------------------------------------------------------------------------------------------------------


def test_pretokens_agree_with_their_patterns():
    import regex

    rng = random.Random(1)
    alphabet = [chr(c) for c in range(0x2100) if not pretokens.ODD(chr(c))]
    texts = ["".join(rng.choice(alphabet if rng.random() < 0.3 else "ab 'sd1.\n") for _ in range(60)) for _ in range(500)]
    split = regex.compile(public_tokenizers.PATTERN).findall
    assert all(pretokens.byte_split()(t) == split(t) for t in texts)


def test_byte_bpe_equals_ranks_and_round_trips(docs):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    expected = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    found = byte_bpe.digests(docs, BYTE_PATH).collect()
    assert len(found) == docs.count()
    for r in found:
        ids = expected.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_byte_bpe_equals_ranks_on_odd_texts(spark, empty):
    """Texts of all scripts, broken spaces, long runs and special strings against the ranks that the contract names."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    expected = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(17)
    pools = ["abc '\n\t 12", "àéîöÜßñ", "ёжиЯΩΔς", "日本語漢字かな", "مرحبا שלום", "🙂👍🏽\u200d\u0301", "\x00\x1c\x85\u2028\u3000\ufeff", "<|endoftext|>'s'RE", "اًकि ไทย", "𝔘𝕏"]
    texts = ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randrange(1, 80))) for _ in range(3_000)] + ["<|endoftext|>", " " * 3_000, "a" * 3_000, "\n" * 99]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"ids": F.lit(1), "decoded": F.lit(2), "n_tokens": F.lit(3)})
    for r in byte_bpe.digests(df, BYTE_PATH).collect():
        ids = expected.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert byte_bpe.digests(empty, BYTE_PATH).count() == 0


def test_byte_bpe_offsets_and_split_characters(spark):
    text = "naïve 🫠 <|endoftext|>"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = byte_bpe.encode(df, BYTE_PATH, offsets=True).first()
    assert row.ids == byte_bpe.encode(df, BYTE_PATH).first().ids and 50256 not in row.ids
    assert row.starts[0] == 0 and max(row.ends) == len(text)
    split = next(i for i in range(1, len(row.ids)) if row.ends[i] == row.ends[i - 1])
    assert text[row.starts[split] : row.ends[split]].strip() == "🫠"  # a character over several ids
    cut = spark.createDataFrame([(1, row.ids[:split]), (2, row.ids[split:])], "doc_id long, ids array<int>")
    halves = {r.doc_id: (bytes(r.decoded), r.text) for r in byte_bpe.decode_text(cut, BYTE_PATH).collect()}
    assert halves[1][0] + halves[2][0] == text.encode() and all("\ufffd" in t for _, t in halves.values())
    whole = spark.createDataFrame([(1, row.ids)], "doc_id long, ids array<int>")
    assert byte_bpe.decode_text(whole, BYTE_PATH).first().text == text


def test_token_counts_equal_the_library(spark, docs, empty):
    from tokenizers import Tokenizer

    more = spark.createDataFrame([(900, "İstanbul ΟΔΟΣ <|endoftext|> I'm 12 a\x1cb", None, None, 0, 0, 0.0)], DOCS)
    every = docs.unionByName(more)
    library = Tokenizer.from_file(WORD_PATH)
    texts = {r.doc_id: r.text or "" for r in every.collect()}
    for r in token_counts.token_counts(every, WORD_PATH, 2048).collect():
        n = len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 2048)
    assert token_counts.token_counts(empty, WORD_PATH, 2048).count() == 0
    clash = every.withColumns({"n_bytes": F.lit("x"), "n_tokens": F.lit("y"), "over_limit": F.lit(3)})
    assert sorted(token_counts.token_counts(clash, WORD_PATH, 2048).collect()) == sorted(token_counts.token_counts(every, WORD_PATH, 2048).collect())


def test_the_table_of_lengths_is_small_and_right(docs, monkeypatch):
    from tokenizers import Tokenizer

    table = token_counts.frequent_lengths(docs, WORD_PATH)
    library = Tokenizer.from_file(WORD_PATH)
    assert table and all(len(library.encode(p, add_special_tokens=False).ids) == n and len(p) <= token_counts.SHORT for p, n in table.items())
    monkeypatch.setattr(token_counts, "FREQUENT", 7)
    assert len(token_counts.frequent_lengths(docs, WORD_PATH)) == 7


def test_token_counts_of_decomposed_texts(spark):
    import unicodedata

    from tokenizers import Tokenizer

    texts = [unicodedata.normalize("NFD", t) for t in ("Việt Nam, tiếng Việt", "ёлка и чай", "über São Ṣūrya", "İI")]
    texts += ["a\u0323b", "\u023a \u023eb \u03fdc", "e\u0301 x\u0301"]
    library = Tokenizer.from_file(WORD_PATH)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.n_tokens for r in token_counts.token_counts(df, WORD_PATH, 2048).collect()}
    assert found == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}


# 3 ------------------------------------------------------------------------------------------------------------------


def test_language_id_on_held_out_documents(spark, empty):
    rng = random.Random(2)
    stock = {"aa": ["the", "and", "thing", "when"], "bb": ["das", "und", "nicht", "über"], "cc": ["los", "una", "pero", "niño"]}
    rows = [(i, " ".join(rng.choice(stock[k]) for _ in range(30)), k) for i in range(300) for k in [sorted(stock)[i % 3]]]
    rows += [(1000, None, "aa"), (1001, "123 !!", "bb"), (1002, "", None), (1003, "und über " * 20_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r.doc_id: r for r in language_id.identify(df).collect()}
    held = [r for r in found.values() if r.held_out and r.doc_id < 1000]
    assert held and np.mean([r.lang_pred == sorted(stock)[r.doc_id % 3] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in found.values())
    assert [found[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and found[1003].lang_pred == "bb"
    assert language_id.identify(empty).count() == 0
    clash = df.withColumns({"score": F.lit(9), "lang_pred": F.lit("zz"), "held_out": F.lit(1)})
    assert {(r.doc_id, r.lang_pred) for r in language_id.identify(clash).collect()} == {(i, r.lang_pred) for i, r in found.items()}


def test_ftrl_equals_the_plain_recurrence(monkeypatch):
    """Per coordinate and class, from the published update; and the elastic net leaves most weights at zero."""
    monkeypatch.setattr(language_id, "BUCKETS", 12)
    rng = np.random.default_rng(4)
    examples = [(np.sort(rng.choice(12, 4, replace=False)), rng.uniform(0.1, 2, 4), int(rng.integers(3))) for _ in range(80)]
    found = language_id.ftrl(examples, 3, epochs=2)
    a, b, l1, l2 = language_id.ALPHA, language_id.BETA, language_id.L1, language_id.L2
    z, n = np.zeros((12, 3)), np.zeros((12, 3))

    def weight(i, c):
        return 0.0 if abs(z[i, c]) <= l1 else -(z[i, c] - np.sign(z[i, c]) * l1) / ((b + np.sqrt(n[i, c])) / a + l2)

    for at, values, label in examples * 2:
        w = {(i, c): weight(i, c) for i in at for c in range(3)}
        scores = [sum(v * w[i, c] for i, v in zip(at, values, strict=True)) for c in range(3)]
        p = np.exp(scores) / np.exp(scores).sum()
        for i, v in zip(at, values, strict=True):
            for c in range(3):
                g = v * (p[c] - (c == label))
                sigma = (np.sqrt(n[i, c] + g * g) - np.sqrt(n[i, c])) / a
                z[i, c] += g - sigma * w[i, c]
                n[i, c] += g * g
    assert np.allclose(found, [[weight(i, c) for c in range(3)] for i in range(12)])
    monkeypatch.setattr(language_id, "L1", 50.0)
    assert not language_id.ftrl(examples, 3).any()


def test_temperature_has_the_least_log_loss():
    rng = np.random.default_rng(2)
    truth = rng.standard_normal((4000, 3)) * 2
    p = np.exp(truth) / np.exp(truth).sum(1, keepdims=True)
    labels = np.array([rng.choice(3, p=x) for x in p])
    assert abs(language_id.temperature(truth * 5, labels) - 5) < 0.6
    assert language_id.temperature(truth[:0], labels[:0]) == 1.0


def test_document_frequencies_count_every_text(spark):
    texts = ["ab ba", "ab", None, "12", "Ab ab ab"]
    counts, n = language_id.document_frequencies(spark.createDataFrame([(t,) for t in texts], "text string"))
    sets = [set(np.flatnonzero(language_id._counts(t))) for t in texts if t]
    assert n == 3 and all(counts[b] == sum(b in s for s in sets) for s in sets for b in s) and counts.sum() == sum(map(len, sets))


def test_language_id_of_null_ids(spark):
    rows = [(None, "the thing", "aa"), (1, "the thing", "aa"), (2, "das und", "bb"), (4, "das und", "bb")]
    found = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert {r.doc_id: r.held_out for r in found}[None] is True and len(found) == 4


# 5 ------------------------------------------------------------------------------------------------------------------


def brute_lines(rows, k):
    seen, out = set(), {}
    for i, text in sorted({(r.doc_id, r.text) for r in rows}, key=lambda x: (x[0], str(x[1]))):
        lines = (text or "").split("\n")
        content = [(j, x.strip()) for j, x in enumerate(lines) if x.strip()]
        gone = set()
        for n in range(len(content) - k + 1):
            key = tuple(x for _, x in content[n : n + k])
            if key in seen:
                gone |= set(range(n, n + k))
            seen.add(key)
        places = {content[n][0] for n in gone}
        kept = None if text is None else "\n".join(x for j, x in enumerate(lines) if j not in places)
        out[i] = (kept, len(content), len(gone), sum(n - 1 not in gone for n in gone))
    return out


@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_line_dedup(docs, k):
    rows = docs.collect()
    expected = brute_lines(rows, k)
    clash = docs.withColumns({c: F.lit(7) for c in ("kept_text", "n_lines", "n_removed", "n_runs", "line", "n", "a", "depth", "first")})
    frame = line_dedup.delete_repeated_runs(clash, k)
    assert len(frame.columns) == len(set(frame.columns)) == len(docs.columns) + 9
    found = frame.collect()
    assert len(found) == len(rows)
    assert {r.doc_id: (r.kept_text, r.n_lines, r.n_removed, r.n_runs) for r in found} == expected


def test_line_dedup_of_long_single_lines(spark):
    long, short = " ".join(f"w{i}" for i in range(50)), " ".join(f"v{i}" for i in range(49))
    texts = [f"a\n{long}\nb\n{short}\nc", f"d\n{long}\ne\n{short}\nf", f"g\n{short}\n{long}\n{long}\nb\n{short}"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: (r.kept_text, r.n_removed, r.n_runs) for r in line_dedup.delete_repeated_runs(df, long_words=50).collect()}
    assert found == {0: (texts[0], 0, 0), 1: (f"d\ne\n{short}\nf", 1, 1), 2: (f"g\n{short}", 4, 1)}
    assert {r.n_removed for r in line_dedup.delete_repeated_runs(df.where("doc_id < 2")).collect()} == {0}


def test_line_dedup_of_nothing(empty):
    assert line_dedup.delete_repeated_runs(empty).count() == 0


# 4 ------------------------------------------------------------------------------------------------------------------


def brute_kept(rows, length):
    """For each (doc_id, text) the bytes that stay and which ones go."""
    seen, out = set(), {}
    for i, text in sorted({(r.doc_id, r.text or "") for r in rows}):
        data = text.encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - length + 1):
            w = data[p : p + length]
            if w in seen:
                gone[p : p + length] = True
            seen.add(w)
        out[i, text] = (bytes(np.frombuffer(data, np.uint8)[~gone]), gone)
    return out


def brute_bytes(rows, length):
    out = {}
    for (i, _), (kept, gone) in brute_kept(rows, length).items():
        spans = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        out[i] = (len(gone), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize(("length", "chunk"), [(100, 1_000_000), (20, 3_000), (8, 500)])
def test_suffix_dedup(docs, monkeypatch, length, chunk):
    monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
    rows = docs.collect()
    found = suffix_dedup.remove_repeats(docs.withColumn("n_bytes_", F.lit(1)), length).collect()
    assert len(found) == len(rows)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found} == brute_bytes(rows, length)


def test_suffix_dedup_of_unique_ids_and_nothing(docs, empty):
    unique = docs.dropDuplicates(["doc_id"])
    found = suffix_dedup.remove_repeats(unique, with_text=False).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found} == brute_bytes(unique.collect(), 100)
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_contexts_count_with_all_their_bits(monkeypatch):
    """Contexts that differ in their lower halves only are no repeats."""
    monkeypatch.setattr(suffix_dedup, "mix", lambda x: x & np.uint64(0xFFFFFFFF))
    rng = np.random.default_rng(9)
    shared = rng.integers(32, 127, 90).astype(np.uint8)
    own = [rng.integers(32, 127, 120).astype(np.uint8) for _ in range(4)]
    texts = [np.concatenate([own[0], shared, own[1]]), np.concatenate([own[2], shared, own[3]])]
    data, ends = np.concatenate(texts), np.cumsum([len(t) for t in texts])
    first, last, names, contexts, _ = suffix_dedup.cover_runs(data, ends, 100)
    docs = np.searchsorted(ends, first, "right")
    assert set(names[docs == 0]) & set(names[docs == 1])
    assert not suffix_dedup._settle(names, contexts, docs, first << 24 | (last - first) << 16)[0].any()


# 7 ------------------------------------------------------------------------------------------------------------------


def shingle_sets(texts):
    out = []
    for t in texts:
        w = (t or "").lower().split()
        out.append({tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set())
    return out


def brute_classes(rows, least=0.8):
    texts = {r.doc_id: r.text for r in rows}
    ids = sorted(texts)
    sets = dict(zip(ids, shingle_sets([texts[i] for i in ids]), strict=True))
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[:n]:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_near_duplicates(docs, empty):
    rows = docs.collect()
    assert {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).collect()} == brute_classes(rows)
    assert minhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("rounds", [0, 1])
def test_near_duplicates_of_a_large_group(spark, rounds):
    """Copies edited to all degrees: links of all pairs count, whatever hubs were compared."""
    rng = random.Random(4)
    base = words(rng, 120, 5000).split()
    texts = []
    for _ in range(60):
        w = list(base)
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(9999)}"
        texts.append(" ".join(w))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in minhash.near_duplicates(df, rounds=rounds).collect()} == brute_classes(df.collect())


def test_dart_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 1 << 62, 300).astype(np.uint64)
    wa, wb = rng.uniform(0, 3, 300), rng.uniform(0, 3, 300)
    a, b = (minhash.dart_signatures(ids, np.array([300]), 2000, w) for w in (wa, wb))
    assert abs((a == b).mean() - np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()) < 0.04
    one = minhash.dart_signatures(np.concatenate([ids[:200], ids[50:250]]), np.array([200, 200]), 2000)
    assert abs((one[0] == one[1]).mean() - 150 / 250) < 0.04
    assert not minhash.dart_signatures(ids[:0], np.array([0]), 8).any()


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (102, 101), (7, 7)]
    found = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(1, 31)} | {101: 100, 102: 100}


# 2 ------------------------------------------------------------------------------------------------------------------


def test_packing(docs, empty):
    capacity = 150
    rows = packing.pack(docs, capacity, shard_pieces=20).collect()
    sizes = {r.doc_id: len((r.text or "").split()) for r in docs.collect()}
    bins = {}
    for r in rows:
        bins.setdefault((r.shard, r.bin), []).append(r)
    for held in bins.values():
        spans = sorted((r.offset, r.offset + r.length) for r in held)
        assert spans[-1][1] <= capacity and all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
        long_enough = [r.doc_id for r in held if r.length]
        assert len({i % 3 for i in long_enough}) == len(long_enough)  # one of a source
    totals = {}
    for r in rows:
        totals[r.doc_id] = totals.get(r.doc_id, 0) + r.length
    assert totals == {i: n * (2 if i == 3 else 1) for i, n in sizes.items()}  # document 3 is there twice
    assert packing.pack(empty).count() == 0


def test_best_fit_equals_brute_force():
    rng = random.Random(9)
    for _ in range(60):
        capacity = rng.randrange(5, 40)
        lengths = sorted((rng.randrange(0, capacity + 1) for _ in range(rng.randrange(1, 80))), reverse=True)
        conflicts = [1 << rng.randrange(4) | 1 << (4 + rng.randrange(30)) for _ in lengths]
        bins, offsets, held = [], [], []  # held: [filled, bits] of each bin
        for length, bits in zip(lengths, conflicts, strict=True):
            fits = [(capacity - filled - length, b) for b, (filled, other) in enumerate(held) if filled < capacity and filled + length <= capacity and not other & bits]
            b = min(fits)[1] if fits else len(held)
            if not fits:
                held.append([0, 0])
            bins.append(b)
            offsets.append(held[b][0])
            held[b][0] += length
            held[b][1] |= bits
        assert packing.best_fit(lengths, conflicts, capacity) == (bins, offsets)


def brute_packing(rows, capacity):
    """All pieces of one shard by exhaustive search of the tightest compatible bin."""
    pieces = []
    for r in rows:
        n = len((r.text or "").split())
        cluster = "".join((r.text or "").split()).lower() or ("", r.doc_id)
        pieces += [(min(capacity, n - k * capacity), r.source, cluster) for k in range(max(1, -(-n // capacity)))]
    held = []
    for length, source, cluster in sorted(pieces, key=lambda p: -p[0]):
        fits = [(capacity - b[0], i) for i, b in enumerate(held) if b[0] < capacity and b[0] + length <= capacity and source not in b[1] and cluster not in b[2]]
        if not fits:
            held.append([0, set(), set()])
        b = held[min(fits)[1] if fits else -1]
        b[0] += length
        b[1] |= {source} - {None}
        b[2].add(cluster)
    return sorted(b[0] for b in held)


def test_packing_equals_brute_force(spark):
    rng = random.Random(14)
    lengths = rng.sample(range(1, 130), 60)  # no equal ones, so the order is fixed
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(n)), rng.choice(["a", "b", "c", None])) for i, n in enumerate(lengths)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"piece": F.lit(1), "shard": F.lit(2), "length": F.lit(3), "bin": F.lit(4), "offset": F.lit(5), "row": F.lit(6)})
    bins = {}
    for r in packing.pack(df, 64).collect():
        bins[r.shard, r.bin] = bins.get((r.shard, r.bin), 0) + r.length
    # pieces of full capacity are alone in their bins, so their equal lengths don't matter
    assert sorted(bins.values()) == brute_packing(df.collect(), 64)


def test_repeated_rows_are_spread_over_shards(spark):
    df = spark.range(3_000).select(F.lit(7).alias("doc_id"), F.lit("one two three").alias("text"), F.lit("s").alias("source")).repartition(4)
    sizes = [r["count"] for r in packing.pack(df, shard_pieces=100).groupBy("shard").count().collect()]
    assert len(sizes) == 31 and max(sizes) < 150  # a few more shards than 30 for what long texts could add
    nothing = spark.createDataFrame([(None, None, None), (None, "a b", None)], "doc_id long, text string, source string")
    assert sorted((r.doc_id, r.length) for r in packing.pack(nothing).collect()) == [(None, 0), (None, 2)]


def test_best_fit_takes_the_tightest_compatible_bin():
    # after 6, 5 and 3 the bins have 4, 5 and 7 left; 4 fits the first but for the conflict, so the next one takes it
    bins, offsets = packing.best_fit([6, 5, 3, 4, 4], [1, 2, 3, 1, 4], 10)
    assert bins[:3] == [0, 1, 2] and bins[3] == 1 and bins[4] == 0 and offsets[3:] == [5, 6]


# 1 ------------------------------------------------------------------------------------------------------------------


def test_url_rules(spark):
    urls = ["http://A.Example.NET/en/x?q#f", "https://b.net/en/", "http://example.com/de/1", "http://x.example.com/fr/", "http://q.org/fr/y", "no scheme", None, "http://host", "http://net", "http://net/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumns({"html": F.lit(None).cast("string"), "host": F.lit("clash")})
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df, URL_RULES).collect()}
    assert got[0] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[1] == ("b.net", "/en/", "net/", "block")
    assert got[2][2:] == ("example.com/de/", "block") and got[3][2:] == (None, "allow") and got[4][2:] == ("org/fr/", "allow")
    assert got[5] == got[6] == ("", "", None, "allow") and got[7][:3] == ("host", "", None) and got[8][2] is None and got[9][2] == "net/"


def test_distrust_spreads_against_links(spark):
    page = lambda host, *links: (f"http://{host}/p", "".join(f'<a href="http://{x}/">x</a>' for x in links))
    rows = [page("bad.net"), page("farm.info", "bad.net"), page("hub.info", "farm.info"), page("good.org", "fine.info"), page("fine.info", "fine.info"), page("alone.info")]
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string")
    got = {r.host: r.verdict for r in url_filter.judge(df, URL_RULES).collect()}
    assert got == {"bad.net": "block", "farm.info": "block", "hub.info": "block", "good.org": "allow", "fine.info": "allow", "alone.info": "allow"}
    few = {r.host: r.verdict for r in url_filter.judge(df, URL_RULES, steps=1).collect()}
    assert few["farm.info"] == "block" and few["hub.info"] == "allow"
    assert url_filter.judge(df.limit(0), URL_RULES).count() == 0


def test_distrust_spreads_along_a_whole_chain(spark):
    hosts = ["bad.net", *(f"h{i}.info" for i in range(1, 15))]
    rows = [(i, f"http://{h}/p", f'<a href="http://{hosts[i - 1]}/">x</a>' if i else "") for i, h in enumerate(hosts)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.verdict for r in url_filter.judge(df, URL_RULES).collect()} == {"block"}


def test_spread_mass_equals_a_plain_page_rank(spark):
    """Personalised PageRank by repeated sums over a random graph with cycles, sinks and hubs; and its closed form."""
    rng = random.Random(21)
    hosts = [f"h{i}" for i in range(40)]
    edges = sorted({(rng.choice(hosts), rng.choice(hosts[:10] if rng.random() < 0.4 else hosts)) for _ in range(150)})
    edges = [(a, b) for a, b in edges if a != b]
    seeds = [("trust", "h1"), ("trust", "h2"), ("distrust", "h3"), ("distrust", "h2")]
    got = {r.host: (r.trust, r.distrust) for r in url_filter.spread_mass(spark.createDataFrame(seeds, "kind string, host string"), spark.createDataFrame(edges, "src string, dst string")).collect()}
    at = {h: i for i, h in enumerate(hosts)}
    for kind, place in (("trust", 0), ("distrust", 1)):
        ways = {h: [b if kind == "trust" else a for a, b in edges if (a if kind == "trust" else b) == h] for h in hosts}
        new = {h: url_filter.SEED for k, h in seeds if k == kind}
        total = dict(new)
        while new:
            moved = {}
            for h, mass in new.items():
                for to in ways[h]:
                    moved[to] = moved.get(to, 0) + mass * url_filter.DAMPING // (100 * len(ways[h]))
            new = {h: m for h, m in moved.items() if m}
            total = {h: total.get(h, 0) + new.get(h, 0) for h in total | new}
        assert {h: x[place] for h, x in got.items() if x[place]} == total
        step = np.zeros((len(hosts), len(hosts)))
        for h in hosts:
            for to in ways[h]:
                step[at[to], at[h]] += url_filter.DAMPING / 100 / len(ways[h])
        start = np.array([url_filter.SEED if (kind, h) in seeds else 0 for h in hosts], float)
        exact = np.linalg.solve(np.eye(len(hosts)) - step, start)
        assert np.abs(exact - [total.get(h, 0) for h in hosts]).max() < 20_000  # what rounding down loses, of 10 ** 9


def test_trust_outweighs_distrust_and_pages_may_repeat(spark):
    page = lambda host, *links: (f"http://{host}/p", "".join(f"<A HREF=//{x}/>x</A>" for x in links))
    rows = [page("bad.net"), page("blog.info", "bad.net"), ("http://good.org/fr/", '<a href="http://blog.info/">'), page("spam.info", "bad.net")]
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)] + [(None, *rows[0]), (3, *rows[3])], "page_id long, url string, html string")
    got = [(r.page_id, r.verdict) for r in url_filter.judge(df.withColumns({"rule": F.lit(1), "verdict": F.lit(2), "path": F.lit(3)}), URL_RULES).collect()]
    assert sorted(got, key=str) == sorted([(0, "block"), (1, "allow"), (2, "allow"), (3, "block"), (None, "block"), (3, "block")], key=str)


def test_mass_on_a_cycle_ends(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "SEED", 100)
    seeds = spark.createDataFrame([("distrust", "a")], "kind string, host string")
    edges = spark.createDataFrame([("a", "b"), ("b", "a")], "src string, dst string")
    expected, mass, at = {"a": 0, "b": 0}, 100, 0
    while mass:
        expected["ab"[at]] += mass
        mass, at = mass * 85 // 100, 1 - at
    assert {r.host: (r.trust, r.distrust) for r in url_filter.spread_mass(seeds, edges).collect()} == {h: (0, m) for h, m in expected.items()}


# 6 and 10 -----------------------------------------------------------------------------------------------------------


def vector_table(spark, n=700, d=16, seed=8):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d)).astype(np.float32)
    x[n // 2 :] = x[: n - n // 2] * 0.9 + 0.1 * x[n // 2 :]
    x[20:40] = x[5]  # ties
    rows = [(i, [float(v) for v in x[i]], 0) for i in range(n)]
    odd = [(n, None, 0), (n + 1, [float("nan")] * d, 0), (n + 2, [None] * d, 0), (n + 3, [], 0), (n + 4, [0.0] * d, 0), (50, [float(v) for v in x[50]], 0)]
    return spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int").withColumn("score", F.lit(1)), x


def test_exact_top_k(spark, monkeypatch):
    monkeypatch.setattr(vectors.nearest, "__defaults__", (200,))
    df, x = vector_table(spark)
    ids = np.arange(len(x) + 1)
    v = np.floor(256 * np.vstack([x, np.zeros(x.shape[1])]).astype(np.float64)).astype(np.int64)
    ids[-1] = len(x) + 4
    got = {}
    for r in bit_sliced.top_k(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    asked = [i for i in range(len(ids)) if ids[i] % 50 == 0]
    assert sorted(got) == sorted(ids[asked])
    for q in asked:
        s = v @ v[q]
        order = [i for i in np.lexsort((ids, -s)) if i != q][:5]
        assert got[ids[q]] == [(ids[i], s[i]) for i in order]
    assert bit_sliced.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    few = df.where("vec_id in (0, 1, 2)")
    assert bit_sliced.top_k(few, F.col("vec_id") % 50 == 0).count() == 2


def test_exact_top_k_of_huge_components(spark):
    rows = [(0, [1e12, -3e11]), (1, [2e12, 1e11]), (2, [-5e11, 7e12]), (3, [1.5, 2.5]), (50, [3e30, 1.0]), (51, [-1e200, 4.0]), (52, [1e306, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    v = {i: [int(np.floor(256 * x)) if abs(256 * x) < 2**53 else int(256 * x) for x in e] for i, e in rows[:-1]}
    clip = lambda x: min(max(x, -(2**63)), 2**63 - 1)
    for query in (0, 50):
        scores = sorted(((-clip(sum(a * b for a, b in zip(v[query], v[i], strict=True))), i) for i in v if i != query))[:5]
        found = [(-r.score, r.vec_id) for r in bit_sliced.top_k(df, F.col("vec_id") % 50 == 0).where(f"query_id = {query}").orderBy("rank").collect()]
        assert found == scores


def test_prefix_forest_recall_and_scores(spark):
    df, x = vector_table(spark, 2000)
    found = {}
    for r in prefix_forest.neighbours(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r)
    y = x.astype(np.float64)
    hits = []
    for q in range(0, 2000, 20):
        s = y @ y[q]
        best = [i for i in np.lexsort((np.arange(2000), -s)) if i != q][:20]
        rows = found[q]
        assert len(rows) == 20 and [r.rank for r in rows] == list(range(1, 21))
        assert all(abs(r.score - s[r.vec_id]) < 1e-9 for r in rows) and [(-r.score, r.vec_id) for r in rows] == sorted((-r.score, r.vec_id) for r in rows)
        hits.append(len(set(best) & {r.vec_id for r in rows}) / 20)
    assert np.mean(hits) >= 0.9
    assert prefix_forest.neighbours(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    few = df.where("vec_id in (0, 1, 2, 40)").withColumns({"query_id": F.lit(1), "rank": F.lit(2)})
    assert prefix_forest.neighbours(few, F.col("vec_id") % 20 == 0).groupBy("query_id").count().collect() and prefix_forest.neighbours(few, F.col("vec_id") % 20 == 0).count() == 6


def test_forest_reads_a_part_and_finds_longest_prefixes():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((3000, 24))
    forest = prefix_forest.Forest(x)
    codes = forest.strings(np.column_stack([x[:40] / forest.scale, np.zeros(40)]).astype(np.float32))
    lengths = forest.longest(codes)
    for t in (0, 100):
        shared = [max(prefix_forest.BITS - int(c ^ d).bit_length() for d in forest.codes[t]) for c in codes[t]]
        assert lengths[t].tolist() == shared
    wanted = prefix_forest.FACTOR * 3000**prefix_forest.GROWTH
    read = forest.candidates(x[:40] / forest.scale, wanted)
    assert (read.sum(1) >= wanted).all() and read.mean() < 0.55


def test_language_id_learns_from_every_label(spark):
    """A word that 30 of 9,000 labelled texts have decides their language, whatever the layout; one shard of many can't hide it."""
    rows = [("the cat sits on the mat" if i % 2 else "der hund liegt auf dem sofa", "en" if i % 2 else "de") for i in range(8_970)] + [(f"zyxwvu qkjxz {'qz' * (i + 1)}", "xx") for i in range(30)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    model = language_id.train(docs, shard=1_000)
    other = language_id.train(docs.repartition(7), shard=1_000)
    assert (model["weights"] == other["weights"]).all() and model["temperature"] == other["temperature"] and model["least"] == other["least"]
    asked = spark.createDataFrame([(1, "zyxwvu qkjxz qzqzqz"), (2, "the cat"), (3, "der hund")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in language_id.predict(asked, model).collect()} == {1: "xx", 2: "en", 3: "de"}


def test_language_id_has_learned_and_judged_all_rows(spark, monkeypatch):
    """As many texts are learned from or kept aside as there are labels, over 2 * 2,000 of them."""
    docs = spark.range(9_000).select(F.concat(F.lit("texto numero "), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("text"), F.lit("pt").alias("lang"))
    seen = {}
    learn, judge = language_id.learned_weights, language_id.calibrated
    monkeypatch.setattr(language_id, "learned_weights", lambda rows, *rest: seen.update(learned=rows.count()) or learn(rows, *rest))
    monkeypatch.setattr(language_id, "calibrated", lambda rows, *rest: seen.update(aside=rows.count()) or judge(rows, *rest))
    assert language_id.train(docs) and seen["learned"] + seen["aside"] == 9_000
    assert 0.15 < seen["aside"] / 9_000 < 0.25
