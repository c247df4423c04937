"""Removal of repeated byte strings by blockwise suffix sorting with a cover sample.

Every byte covered by a string of `length` bytes that also starts earlier is removed. That asks, for each start, whether
its first `length` bytes occur at an earlier start: equal suffixes up to depth `length`, which is all the sorting that is
done. Suffixes are never sorted all at once:

1. Cover sample. Each window of `length` bytes picks one position inside it, the place of its least hashed string of
   length / 2 bytes. Equal windows pick the same offset, so the picks are a difference cover in the sense that counts:
   any two equal suffixes reach sampled positions at the same distance. (The picks follow the content, not position
   residues; the README says why.) All neighbouring windows with one pick are one run: a name (the hash of the sampled
   string) and a context (the hash of all bytes that the run's windows cover).
2. Blocks. Runs are dealt by name to buckets of a bounded number of bytes of text, so that all suffixes which can be
   equal meet in one bucket, and one bucket at a time is sorted in memory. A run whose name and context, 128 bits
   together, occurred earlier is repeated as a whole. A name with one context is no repeat. What is left are long ties:
   runs with a common sampled string in different contexts, near the ends of repeated passages.
3. Ties. The bytes of tied runs go to the bucket of their sampled string and are ranked there: first the samples
   themselves, then, byte by byte from the samples' ranks, what stands before and after. A window is a pair of ranks, so
   each of the run's suffixes is settled by two numbers, whatever the length of the tie, and by the bytes, not by hashes.

Names with very many contexts (a phrase that a third of all documents have in different surroundings) would make one
bucket large; their windows are hashed and dealt one by one instead, with two independent hashes of 64 bits. Copies
within a batch of documents are settled on the spot, and a task remembers a bounded number of contexts and names that
repeat, so a passage in a third of all documents sends its bucket about one entry per task, not one per copy.

Defined results: a null text is empty, with nothing to remove; texts shorter than `length` lose nothing; texts of any
length are worked on in overlapping stretches; rows equal in doc_id and text are one document with one result, which
each of them gets; rows with one doc_id and different texts are documents of their own, ordered by a hash of the text;
a null doc_id comes first; matches never cross documents; other columns stay untouched, but those named like a column
of the result are replaced by it; an empty table gives an empty result. `kept_text` leaves out bytes of characters that
were cut apart; `kept_sha256` is of all remaining bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from veritempo.llm.common import checkpoint, groups_for
from veritempo.llm.shingles import OTHER_BYTES, mix, prefix_hashes, span_hashes, string_hashes

LENGTH = 100
#: Bytes worked on at a time, and starts per stretch of a long text.
CHUNK = 1_000_000
#: Bytes of text whose runs make one bucket, about: its task takes some eight times as much; larger executors may take more.
BUCKET_BYTES = 16_000_000
#: Contexts of a name, in one batch and in its bucket, from which its windows are dealt one by one.
MANY, MANY_IN_ALL = 16, 20_000
#: Contexts and names that a task remembers.
REMEMBERED = 200_000
#: Tied runs that are ranked at a time, but for those of one name.
RANKED = 100_000
#: Kinds in the last byte of a code: start << 24 | further windows << 16 | place of the sample in the run << 8 | kind.
ENTRY, REPEAT, TIE, SPLIT = 0, 1, 2, 3

_PLACE = np.int64((1 << 24) - 1)
_LEAST, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def _start(codes: np.ndarray) -> np.ndarray:
    return codes >> 24


def _more(codes: np.ndarray) -> np.ndarray:
    return codes >> 16 & 255


def _offset(codes: np.ndarray) -> np.ndarray:
    return codes >> 8 & 255


def _kind(codes: np.ndarray) -> np.ndarray:
    return codes & 255


def _stretches(data: bytes, length: int, starts: int) -> Iterator[tuple[int, bytes]]:
    for base in range(0, max(1, len(data) - length + 1), starts):
        yield base, data[base : base + starts + length - 1]


def cover_runs(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one sampled position: first and last start, name, context, and place of the sample.

    data: the bytes of several texts one after another, which end at `ends`.
    """
    half = length // 2
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none, none
    prefixes = prefix_hashes(data)
    places = np.arange(len(data) - half + 1)
    grams = span_hashes(prefixes, places, places + half)
    keys = (grams & ~np.uint64(_PLACE)) | places.astype(np.uint64)
    width = length - half + 1
    padded = np.full(-(-len(keys) // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].reshape(-1)
    starts = len(data) - length + 1
    picks = (np.minimum(behind[:starts], ahead[width - 1 : width - 1 + starts]) & np.uint64(_PLACE)).astype(np.int64)
    owner_end = np.repeat(ends, np.diff(np.concatenate([[0], ends])))[:starts]
    valid = np.flatnonzero(places[:starts] + length <= owner_end)
    if not len(valid):
        return none, none, none, none, none
    picked = picks[valid]
    opens = np.flatnonzero(np.concatenate([[True], (np.diff(picked) != 0) | (np.diff(valid) != 1)]))
    first, last = valid[opens], valid[np.concatenate([opens[1:], [len(valid)]]) - 1]
    at = picked[opens]
    context = mix(span_hashes(prefixes, first, last + length) + (at - first).astype(np.uint64))
    return first, last, grams[at].astype(np.int64), context.astype(np.int64), at - first


def _settle(names: np.ndarray, contexts: np.ndarray, docs: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the entries of whole names: which repeat an earlier one, which have later copies, contexts of their names."""
    order = np.lexsort((codes, docs, contexts, names))
    n, c = names[order], contexts[order]
    new_name = np.concatenate([[True], n[1:] != n[:-1]])
    new_context = new_name | np.concatenate([[True], c[1:] != c[:-1]])
    several = np.bincount(np.cumsum(new_name) - 1, new_context)
    repeat, copied = np.zeros(len(order), bool), np.zeros(len(order), bool)
    repeat[order], copied[order] = ~new_context, new_context & ~np.concatenate([new_context[1:], [True]])
    contexts_of_name = np.zeros(len(order), np.int64)
    contexts_of_name[order] = several[np.cumsum(new_name) - 1]
    return repeat, copied, contexts_of_name


class _Seen:
    """Contexts that a task has met repeatedly, with their earliest place, and names with many contexts.

    It holds a bounded number of each and starts anew when it is full: it saves rows and never changes a result.
    """

    def __init__(self):
        self.contexts = np.zeros((4, 0), np.int64)  # context, name, document, start; by context
        self.names = np.zeros(0, np.int64)

    def earlier(self, names: np.ndarray, contexts: np.ndarray, docs: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Which runs repeat one that the task has met."""
        if not self.contexts.shape[1]:
            return np.zeros(len(names), bool)
        context, name, doc, start = self.contexts[:, np.minimum(np.searchsorted(self.contexts[0], contexts), self.contexts.shape[1] - 1)]
        return (context == contexts) & (name == names) & ((doc < docs) | ((doc == docs) & (start < starts)))

    def keep(self, rows: np.ndarray, names: np.ndarray) -> None:
        held = np.concatenate([rows, self.contexts if self.contexts.shape[1] <= REMEMBERED else self.contexts[:, :0]], 1)
        held = held[:, np.lexsort((held[3], held[2], held[0]))]
        self.contexts = held[:, np.concatenate([[True], np.diff(held[0]) != 0])[: held.shape[1]]]
        self.names = np.union1d(names, self.names if len(self.names) <= REMEMBERED else names)


def _runs(docs: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents and codes of repeats, neighbouring starts in one code; the places come in order for each document."""
    if not len(docs):
        return docs, places
    opens = np.concatenate([[True], (np.diff(docs) != 0) | (np.diff(places) != 1)])
    at = np.flatnonzero(opens)
    within = np.arange(len(docs)) - np.repeat(at, np.diff(np.concatenate([at, [len(docs)]])))
    opens |= within % 256 == 0
    at = np.flatnonzero(opens)
    more = np.diff(np.concatenate([at, [len(docs)]])) - 1
    return docs[at], places[at] << 24 | more << 16 | REPEAT


def _numbered(docs: DataFrame, text_column: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame], int]:
    """rid, an integer in the order of doc_id and text hash, text and row (the columns of docs but the text); and a way on.

    There is one row per document. The way on turns results by rid, text and row to one result for each row of docs.
    The third value is the number of bytes of all texts.
    """
    text = F.coalesce(F.col(text_column), F.lit("")).alias("text")
    row = F.struct(F.col(text_column).isNull().alias("no_text"), *[F.col(f"`{c}`") for c in docs.columns if c != text_column]).alias("row")
    whole = docs.schema["doc_id"].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint")
    n, known, distinct, size = docs.agg(F.count("*"), F.count("doc_id"), F.count_distinct("doc_id"), F.coalesce(F.sum(F.octet_length(text_column)), F.lit(0))).first()
    if whole and n == known == distinct:
        return docs.select(F.col("doc_id").cast("long").alias("rid"), text, row), lambda found: found.drop("rid"), size
    keyed = docs.select("doc_id", F.xxhash64(text_column).alias("h"), text, row)
    ids = checkpoint(keyed.select("doc_id", "h").distinct().orderBy("doc_id", "h").withColumn("rid", F.monotonically_increasing_id()))
    ids = ids.withColumnsRenamed({"doc_id": "doc_id_", "h": "h_"})
    same = F.col("doc_id").eqNullSafe(F.col("doc_id_")) & (F.col("h") == F.col("h_"))
    rows = keyed.join(ids, same).groupBy("rid").agg(F.min("text").alias("text"), F.first("row").alias("row"))
    return rows, lambda found: keyed.join(ids, same).select("rid", "row").join(found.drop("row"), "rid").drop("rid"), size


def _sampled(rows: DataFrame, length: int) -> DataFrame:
    """name, context, rid and code: the runs of all texts, copies within a batch settled."""

    def settle(parts: list[tuple[int, int, bytes]], seen: _Seen) -> pa.RecordBatch:
        data = np.frombuffer(b"".join(x for _, _, x in parts), np.uint8)
        sizes = np.fromiter((len(x) for _, _, x in parts), np.int64, len(parts))
        ends = np.cumsum(sizes)
        first, last, names, contexts, offsets = cover_runs(data, ends, length)
        owner = np.searchsorted(ends, first, "right")
        docs = np.fromiter((d for d, _, _ in parts), np.int64, len(parts))[owner]
        places = first - (ends - sizes)[owner] + np.fromiter((b for _, b, _ in parts), np.int64, len(parts))[owner]
        codes = places << 24 | (last - first) << 16 | offsets << 8
        if len(codes):
            repeat, copied, contexts_of_name = _settle(names, contexts, docs, codes)
            repeat |= seen.earlier(names, contexts, docs, places)
            split = ~repeat & ((contexts_of_name > MANY) | np.isin(names, seen.names))
            marked = np.setdiff1d(names[split], seen.names)
            seen.keep(np.stack([contexts, names, docs, places])[:, copied & ~repeat], marked)
            codes = codes | np.where(repeat, REPEAT, np.where(split, SPLIT, ENTRY))
            names = np.where(repeat | split, mix((docs * 31 + places).astype(np.uint64)).astype(np.int64), names)
            names, contexts = np.concatenate([names, marked]), np.concatenate([contexts, np.full(len(marked), _LEAST)])
            docs, codes = np.concatenate([docs, np.full(len(marked), _MOST)]), np.concatenate([codes, np.full(len(marked), ENTRY)])
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (names, contexts, docs, codes)], names=["name", "context", "rid", "code"])

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, seen = [], 0, _Seen()
        for batch in source:
            for rid, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                if len(data) < length:
                    continue
                for base, stretch in _stretches(data, length, CHUNK):
                    parts.append((rid, base, stretch))
                    held += len(stretch)
                    if held >= CHUNK:
                        yield settle(parts, seen)
                        parts, held = [], 0
        if parts:
            yield settle(parts, seen)

    return rows.select("rid", "text").mapInArrow(batches, "name long, context long, rid long, code long")


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table[name].to_numpy()


def _sorted_buckets(runs: DataFrame, buckets: int) -> DataFrame:
    """rid and code of the runs that are repeats or ties, over all documents."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = pa.Table.from_batches(source, schema)
        names, contexts, docs, codes = (_column(bucket, c) for c in ("name", "context", "rid", "code"))
        del bucket
        settled = _kind(codes) != ENTRY
        out_docs, out_codes = [docs[settled]], [codes[settled]]
        names, contexts, docs, codes = (x[~settled] for x in (names, contexts, docs, codes))
        if len(names):
            marker = docs == _MOST
            repeat, _, contexts_of_name = _settle(names, contexts, docs, codes)
            tie = ~repeat & ~marker & (contexts_of_name > 1)
            repeat &= ~marker
            many = (contexts_of_name > MANY_IN_ALL) | np.isin(names, names[marker])
            out_docs += [docs[repeat], docs[tie]]
            out_codes += [codes[repeat] | REPEAT, codes[tie] | np.where(many[tie], SPLIT, TIE)]
        docs, codes = np.concatenate(out_docs), np.concatenate(out_codes)
        yield pa.RecordBatch.from_arrays([pa.array(docs), pa.array(codes)], names=["rid", "code"])

    schema = pa.schema([(c, pa.int64()) for c in ("name", "context", "rid", "code")])
    return runs.repartition(buckets, "name").mapInArrow(batches, "rid long, code long")


def _packed(rows: DataFrame) -> DataFrame:
    """The rows with their text compressed."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in source:
            packed = pa.array([pack(t.as_buffer()) for t in batch.column(0)], pa.binary())
            yield pa.RecordBatch.from_arrays([packed, *batch.columns[1:]], names=["packed", *rest])

    rest = [c for c in rows.columns if c != "text"]
    schema = StructType([StructField("packed", BinaryType()), *(rows.schema[c] for c in rest)])
    # no rid is null; said here, the inner and the outer join read the same shuffle
    return rows.select("text", *rest).mapInArrow(batches, schema).where("rid is not null")


def _tied(packed: DataFrame, ties: DataFrame, length: int) -> DataFrame:
    """key, rid, code and data: of tied runs the sampled string's hash and the bytes, of split ones each window's two hashes.

    Windows that repeat within a batch are settled.
    """
    half = length // 2
    names = ["key", "rid", "code", "data"]

    def batch(keys: np.ndarray, docs: np.ndarray, codes: np.ndarray, data: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(docs, pa.int64()), pa.array(codes, pa.int64()), data], names=names)

    def whole_runs(docs: list[int], codes: list[int], runs: list[bytes]) -> pa.RecordBatch:
        samples = np.frombuffer(b"".join(run[c >> 8 & 255 :][:half] for run, c in zip(runs, codes, strict=True)), np.uint8).reshape(-1, half)
        return batch(string_hashes(samples).astype(np.int64), np.array(docs), np.array(codes), pa.array(runs, pa.binary()))

    def windows(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        h, g, d, p = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((p, d, g, h))
        new = np.concatenate([[True], (np.diff(h[order]) != 0) | (np.diff(g[order]) != 0)])
        first, later = order[new], order[~new]
        later = later[np.lexsort((p[later], d[later]))]
        run_docs, run_codes = _runs(d[later], p[later])
        keys = np.concatenate([h[first], mix((run_docs * 31 + run_codes).astype(np.uint64)).astype(np.int64)])
        second = np.concatenate([g[first], np.zeros(len(run_docs), np.int64)])
        data = pa.Array.from_buffers(pa.binary(), len(second), [None, pa.py_buffer(np.arange(0, 8 * len(second) + 1, 8, dtype=np.int32)), pa.py_buffer(second)])
        return batch(keys, np.concatenate([d[first], run_docs]), np.concatenate([p[first] << 24 | SPLIT, run_codes]), data)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        docs, codes, runs, held = [], [], [], 0
        parts, n_windows = [], 0
        for rows in source:
            for rid, text, found in zip(*rows.columns[:3], strict=True):
                rid, data, found = rid.as_py(), unpack(text.as_buffer()), np.sort(found.values.to_numpy(zero_copy_only=False))
                for code in found[_kind(found) == TIE].tolist():
                    run = data[code >> 24 : (code >> 24) + (code >> 16 & 255) + length]
                    docs.append(rid)
                    codes.append(code)
                    runs.append(run)
                    held += len(run)
                found = found[_kind(found) == SPLIT]
                starts, more = _start(found), _more(found)
                every = np.repeat(starts, more + 1) + np.arange((more + 1).sum()) - np.repeat(np.cumsum(more + 1) - (more + 1), more + 1)
                for base, stretch in _stretches(data, length, CHUNK) if len(every) else ():
                    inside = every[(every >= base) & (every < base + CHUNK)] - base
                    if len(inside):
                        own = np.frombuffer(stretch, np.uint8)
                        one, two = (span_hashes(prefix_hashes(own, *values), inside, inside + length).astype(np.int64) for values in ((), (OTHER_BYTES,)))
                        parts.append((one, two, np.full(len(inside), rid), inside + base))
                        n_windows += len(inside)
                if held >= CHUNK:
                    yield whole_runs(docs, codes, runs)
                    docs, codes, runs, held = [], [], [], 0
                if n_windows >= CHUNK:
                    yield windows(parts)
                    parts, n_windows = [], 0
        if runs:
            yield whole_runs(docs, codes, runs)
        if parts:
            yield windows(parts)

    asked = ties.groupBy("rid").agg(F.collect_list("code").alias("codes"))
    # row is not used, but with it the shuffle of the compressed texts is the one that `remove_repeats` needs too
    return packed.join(asked, "rid").select("rid", "packed", "codes", "row").mapInArrow(batches, "key long, rid long, code long, data binary")


def _classes(classes: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Ranks of the pairs (class, value)."""
    order = np.lexsort((values, classes))
    new = np.concatenate([[False], (np.diff(classes[order]) != 0) | (values[order][1:] != values[order][:-1])])
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def ranked_ties(docs: np.ndarray, codes: np.ndarray, data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents and starts of the windows of tied runs that occur earlier; data: the runs' bytes one after another."""
    half = length // 2
    width = length - half
    samples = _start(codes) + _offset(codes)
    offsets, more = _offset(codes), _more(codes)
    columns = np.arange(half + 2 * width)  # every run's bytes, the samples one below the other
    inside = (columns >= (width - offsets)[:, None]) & (columns < (width - offsets + more + length)[:, None])
    table = np.zeros(inside.shape, np.uint8)
    table[inside] = data
    order = np.lexsort((samples, docs))
    docs, samples, offsets, more, table = docs[order], samples[order], offsets[order], more[order], table[order]
    ranks = np.zeros(len(docs), np.int64)
    sample = np.zeros((len(docs), -(-half // 8) * 8), np.uint8)
    sample[:, :half] = table[:, width : width + half]
    for word in sample.view(">u8").T:
        ranks = _classes(ranks, word.astype(np.uint64))
    after = [ranks]
    for m in range(width):
        after.append(np.unique(after[-1] * 256 + table[:, width + half + m], return_inverse=True)[1])
    before = ranks
    out_docs, out_starts = [], []
    for k in range(width + 1):
        if k:
            before = np.unique(before * 256 + table[:, width - k], return_inverse=True)[1]
        rows = np.flatnonzero((offsets - more <= k) & (k <= offsets))
        pair = before[rows] * np.int64(len(docs)) + after[width - k][rows]
        by_pair = np.argsort(pair, kind="stable")  # rows are in the order of their samples, and so of these windows
        later = rows[by_pair[1:][pair[by_pair][1:] == pair[by_pair][:-1]]]
        out_docs.append(docs[later])
        out_starts.append(samples[later] - k)
    return np.concatenate(out_docs), np.concatenate(out_starts)


def _sorted_ties(tied: DataFrame, buckets: int, length: int) -> DataFrame:
    """rid and code of the windows that occur earlier, as runs."""

    def found(docs: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((starts, docs))
        run_docs, run_codes = _runs(docs[order], starts[order])
        return pa.RecordBatch.from_arrays([pa.array(run_docs, pa.int64()), pa.array(run_codes, pa.int64())], names=["rid", "code"])

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = pa.Table.from_batches(source, schema).combine_chunks()
        keys, docs, codes = (_column(bucket, c) for c in ("key", "rid", "code"))
        settled = _kind(codes) == REPEAT
        yield pa.RecordBatch.from_arrays([pa.array(docs[settled]), pa.array(codes[settled])], names=["rid", "code"])
        split = np.flatnonzero(_kind(codes) == SPLIT)
        if len(split):
            second = np.frombuffer(b"".join(bucket["data"].take(pa.array(split)).to_pylist()), np.int64)
            order = np.lexsort((codes[split], docs[split], second, keys[split]))
            k, g = keys[split][order], second[order]
            later = split[order[1:][(k[1:] == k[:-1]) & (g[1:] == g[:-1])]]
            yield found(docs[later], _start(codes[later]))
        tie = np.flatnonzero(_kind(codes) == TIE)
        tie = tie[np.argsort(keys[tie], kind="stable")]
        opens = np.flatnonzero(np.concatenate([[True], np.diff(keys[tie]) != 0])) if len(tie) else []
        begin = 0
        while begin < len(tie):
            whole = np.searchsorted(opens, begin + RANKED, "right") - 1
            end = len(tie) if begin + RANKED >= len(tie) else max(int(opens[whole]), int(opens[np.searchsorted(opens, begin, "right")]) if opens[-1] > begin else len(tie))
            rows = tie[begin:end]
            data = np.frombuffer(b"".join(bucket["data"].take(pa.array(rows)).to_pylist()), np.uint8)
            yield found(*ranked_ties(docs[rows], codes[rows], data, length))
            begin = end

    schema = pa.schema([*((c, pa.int64()) for c in ("key", "rid", "code")), ("data", pa.binary())])
    return tied.repartition(buckets, "key").mapInArrow(batches, "rid long, code long")


def _cut(data: bytes, codes: np.ndarray, length: int) -> tuple[bytes, int, int]:
    """What remains of the bytes, how many were removed, and in how many maximal runs."""
    if not len(codes):
        return data, 0, 0
    steps = np.zeros(len(data) + 1, np.int32)
    np.add.at(steps, _start(codes), 1)
    np.add.at(steps, _start(codes) + _more(codes) + length, -1)
    gone = np.cumsum(steps[:-1]) > 0
    spans = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
    return np.frombuffer(data, np.uint8)[~gone].tobytes(), int(gone.sum()), spans


def remove_repeats(docs: DataFrame, length: int = LENGTH, text_column: str = "text", with_text: bool = True) -> DataFrame:
    """The rows with n_bytes, n_removed, n_spans and kept_sha256 added, and kept_text in place of the text if asked for."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in source:
            results = []
            for packed, codes in zip(batch.column("packed"), batch.column("codes"), strict=True):
                data = unpack(packed.as_buffer())
                kept, removed, spans = _cut(data, codes.values.to_numpy(zero_copy_only=False) if codes.is_valid else np.zeros(0, np.int64), length)
                results.append((len(data), removed, spans, hashlib.sha256(kept).hexdigest(), *([kept.decode("utf-8", "ignore")] if with_text else [])))
            columns = list(zip(*results, strict=True)) if results else [[] for _ in kinds]
            added = [pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *added], names=[*rest, *kinds])

    kinds = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string()} | ({"kept_text": pa.string()} if with_text else {})
    if not 2 <= length <= 500:
        raise ValueError("length must be from 2 to 500")
    rows, on, size = _numbered(docs, text_column)
    buckets = groups_for(size, BUCKET_BYTES)
    rest, packed = ["rid", "row"], _packed(rows)
    found = _sorted_buckets(_sampled(rows, length), buckets)
    ties = found.where(F.col("code").bitwiseAND(255).isin(TIE, SPLIT))
    repeats = found.where(F.col("code").bitwiseAND(255) == REPEAT).unionByName(_sorted_ties(_tied(packed, ties, length), buckets, length))
    codes = repeats.groupBy("rid").agg(F.collect_list("code").alias("codes"))
    cut = packed.join(codes, "rid", "left").select("packed", "codes", *rest)
    types = {k: StringType() if pa.types.is_string(t) else LongType() for k, t in kinds.items()}
    schema = StructType([*(rows.schema[c] for c in rest), *(StructField(k, t) for k, t in types.items())])
    cut = on(cut.mapInArrow(batches, schema))
    own = [F.col("row")[c].alias(c) for c in docs.columns if c not in (text_column, *kinds)]
    text = [F.when(~F.col("row.no_text"), F.col("kept_text")).alias("kept_text")] if with_text else []
    return cut.select(*own, "n_bytes", "n_removed", "n_spans", "kept_sha256", *text)
