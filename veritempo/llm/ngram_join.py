"""N-gram Jaccard join with adaptive multi-match prefixes, and the components of its links.

Order. One order of all shingles holds for all documents: by an estimate of how many have them, from counters of fixed
size that every document is counted in, then by hash. Any order gives right results; a good one puts rare shingles first.

Prefixes. Two sets with at least t common shingles share at least m of those that stand before place s - t + m of each
(s: the set's size). Every document takes the m, up to `MOST`, at which its estimated cost is least: rows of its prefix's
shingles to be met, and candidates to be verified, which each use up m of these rows. Two documents must share the
smaller of their m within the prefixes that their sizes ask of them before they are verified.

Meeting. Sets are collapsed first, so copies take part once. A shingle's documents aren't paired with each other: in the
first `ROUNDS` rounds they meet one hub, the document in which the shingle stands earliest, and what is linked becomes a
component. Only shingles that still hold several components go on, and there documents meet those of other components
and of like size (by bands of size), if parity bitmaps, which rule out pairs exactly, leave the pair open. Pairs within a
component need no proof, so the components are those of all links. Verification compares whole sets of shingles.

Defined results: words are runs of bytes other than blank and 09 to 0D, of the text with A to Z lower-cased; a document of
fewer words than a shingle has has one, of them all; a null text, or one without words, has none and is linked with
nothing; texts of any length are taken whole; repeated rows each give a row, and rows with the same doc_id and other texts
are documents of their own; a row without doc_id has a null component and links nothing; an empty table gives an empty
result; other columns are ignored. Shingles are 64-bit hashes, sets 128-bit ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritempo.llm.common import Scratch, groups_for
from veritempo.llm.components import components
from veritempo.llm.minhash import PARITY_BITS, may_be_similar, parity_bitmaps, text_chunks
from veritempo.llm.shingles import ascii_shingles, mix

WORDS, PERCENT = 3, 90
#: Counters of shingles, and the pieces in which they travel.
COUNTERS, PIECES = 1 << 22, 64
#: Tasks' counters are added up in so many groups per piece first.
GROUPS = 32
#: The most common shingles that a prefix asks for, and the cost of verifying a shingle in rows to be met.
MOST, VERIFY = 8, 0.1
ROUNDS = 2
#: Sets whose texts stand in one bucket, about.
BUCKET_ROWS = 20_000
_SECOND = np.uint64(0x9E3779B97F4A7C15)


def distinct_shingles(texts: list[str], words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of all texts one after another, the text of each, and how many each text has."""
    elements, sizes = ascii_shingles(texts, words)
    owner = np.repeat(np.arange(len(texts)), sizes)
    first = np.sort(np.unique(elements + mix(owner.astype(np.uint64)), return_index=True)[1])
    elements, owner = elements[first], owner[first]
    return elements, owner, np.bincount(owner, minlength=len(texts))


def _counter(elements: np.ndarray, n: int) -> np.ndarray:
    return (elements & np.uint64(n - 1)).astype(np.int64)


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums modulo 2^64 of consecutive runs of the given sizes."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    ends = np.cumsum(sizes)
    return (total[ends] - total[ends - sizes]).astype(np.int64)


def measured(docs: DataFrame, words: int = WORDS, n_counters: int = COUNTERS) -> DataFrame:
    """Per row: doc_id, th (hash of the text), a and b (hash of the set) and size; and tasks' counters (a power of two), in pieces."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, pack = np.zeros(n_counters, np.uint32), zstandard.ZstdCompressor(level=1).compress
        names, kind = ["doc_id", "th", "a", "b", "size", "piece", "counts"], None
        for batch in source:
            kind, texts = batch.schema.field(0).type, [t or "" for t in batch.column(1).to_pylist()]
            for begin, end in text_chunks(texts):
                elements, _, sizes = distinct_shingles(texts[begin:end], words)
                np.add.at(counts, _counter(elements, n_counters), np.uint32(1))
                columns = [batch.column(i).slice(begin, end - begin) for i in (0, 2)]
                columns += [pa.array(_sums(mix(elements ^ salt), sizes)) for salt in (np.uint64(0), _SECOND)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(sizes.astype(np.int32)), pa.nulls(end - begin, pa.int32()), pa.nulls(end - begin, pa.binary())], names=names)
        if kind is not None:
            for piece, part in enumerate(counts.reshape(PIECES, -1)):
                yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), *(pa.nulls(1, pa.int64()) for _ in range(3)), pa.nulls(1, pa.int32()), pa.array([piece], pa.int32()), pa.array([pack(part.tobytes())], pa.binary())], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    source = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    return source.mapInArrow(batches, f"doc_id {kind}, th long, a long, b long, size int, piece int, counts binary")


def counters(rows: DataFrame, n_counters: int = COUNTERS) -> np.ndarray:
    """How many documents each counter has seen: the sums of all tasks' counters, an array of fixed size."""

    def added(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, unpack = np.zeros(n_counters // PIECES, np.uint64), zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for x in batch.column("counts"):
                total += np.frombuffer(unpack(x.as_py()), np.uint32)
        packed = zstandard.ZstdCompressor(level=1).compress(np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([packed], pa.binary())], names=["piece", "counts"])

    schema = "piece int, counts binary"
    parts = rows.where("piece is not null").select("piece", "counts", F.pmod(F.xxhash64("counts"), F.lit(GROUPS)).alias("part"))
    found = parts.groupBy("piece", "part").applyInArrow(added, schema).groupBy("piece").applyInArrow(added, schema).collect()
    out = np.zeros((PIECES, n_counters // PIECES), np.uint32)
    for piece, counts in found:
        out[piece] = np.frombuffer(zstandard.ZstdDecompressor().decompress(counts), np.uint32)
    return out.reshape(-1)


def multi_match_prefixes(elements: np.ndarray, owner: np.ndarray, sizes: np.ndarray, seen: np.ndarray, usual: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each set's m, the length of its prefix, and all prefixes one after another, every set's rarest shingles first.

    seen: how often each shingle's counter was hit; `usual` is what a counter has of shingles that nothing shares.
    """
    order = np.lexsort((elements, seen, owner))
    excess = np.maximum(seen[order].astype(np.int64) - usual, 0)
    rows = np.concatenate([[0], np.cumsum(excess)])
    first = np.cumsum(sizes) - sizes
    need = -(-percent * sizes // 100)
    m, least = np.ones(len(sizes), np.int64), np.full(len(sizes), np.inf)
    for k in range(1, MOST + 1):
        fits = k <= need
        end = np.where(fits, first + sizes - need + k, first)
        cost = np.where(fits, (rows[end] - rows[first]) * (1 + VERIFY * sizes / k), np.inf)
        m = np.where(cost < least, k, m)
        least = np.minimum(cost, least)
    length = np.where(sizes > 0, sizes - need + m, 0)
    place = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    return m, length, elements[order][np.repeat(first, length) + place]


def _packed(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """node and compressed text of one row of every set."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in source:
            packed = pa.array([pack(t.encode("utf-8", "replace")) for t in batch.column(2).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed], names=["doc_id", "th", "packed"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.where("text is not null and doc_id is not null").select("doc_id", F.xxhash64("text").alias("th"), "text")
    rows = rows.mapInArrow(batches, f"doc_id {kind}, th long, packed binary")
    return rows.join(sets.select("doc_id", "th", "node"), ["doc_id", "th"]).select("node", "packed")


def prefixed(packed: DataFrame, seen: np.ndarray, percent: int, words: int) -> DataFrame:
    """node, size, m, tokens (the prefix, in order) and bits (parity bitmap) of every set."""
    held, usual = packed.sparkSession.sparkContext.broadcast(seen), int(np.median(seen))

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in source:
            texts = [unpack(x.as_buffer()).decode() for x in batch.column(1)]
            for begin, end in text_chunks(texts):
                elements, owner, sizes = distinct_shingles(texts[begin:end], words)
                m, length, tokens = multi_match_prefixes(elements, owner, sizes, held.value[_counter(elements, len(held.value))], usual, percent)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32)), pa.array(tokens.astype(np.int64)))
                bits = pa.FixedSizeListArray.from_arrays(pa.array(parity_bitmaps(elements, owner, end - begin).reshape(-1)), PARITY_BITS // 64).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), pa.array(sizes.astype(np.int32)), pa.array(m.astype(np.int32)), lists, bits], names=["node", "size", "m", "tokens", "bits"])

    return packed.select("node", "packed").mapInArrow(batches, "node long, size int, m int, tokens array<long>, bits array<long>")


_SIDE = ("node", "size", "m", "place", "component")


def _side(rows: DataFrame, prefix: str, keys: list[str]) -> DataFrame:
    """The meeting keys, and all other columns renamed."""
    return rows.select(*keys, *(F.col(c).alias(f"{prefix}_{c}") for c in (*_SIDE, "bits") if c in rows.columns))


def _counted(met: DataFrame, percent: int) -> DataFrame:
    """x, y and their sizes, of the pairs among the met rows, one per common shingle, that have as many as they need; x < y.

    A shingle counts if it stands within the prefix that this pair's sizes ask for.
    """
    sizes, m = F.col("x_size") + F.col("y_size"), F.least("x_m", "y_m")
    need = F.floor((sizes * percent + (100 + percent - 1)) / (100 + percent))
    within = [F.col(f"{s}_place") <= F.col(f"{s}_size") - need + m - 1 for s in "xy"]
    met = met.where("x_component != y_component").where(100 * F.least("x_size", "y_size") >= percent * F.greatest("x_size", "y_size")).where(within[0] & within[1])
    if "x_bits" in met.columns:
        met = met.where(may_be_similar("x_bits", "y_bits", sizes, percent / 100))
    pairs = met.groupBy(F.least("x_node", "y_node").alias("x"), F.greatest("x_node", "y_node").alias("y")).agg(F.count("*").alias("n"), F.first(m).alias("m"), F.first(sizes).alias("sizes"))
    return pairs.where("n >= m").select("x", "y", "sizes")


def _open_by_bits(pairs: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """Pairs that their bitmaps leave open."""
    for end in ("x", "y"):
        pairs = pairs.join(bits.select(F.col("node").alias(end), F.col("bits").alias(f"{end}_bits")), end)
    return pairs.where(may_be_similar("x_bits", "y_bits", F.col("sizes"), percent / 100)).select("x", "y")


def verified(pairs: DataFrame, packed: DataFrame, percent: int, words: int) -> DataFrame:
    """a and b of the pairs x and y whose sets are similar enough: 100 * common >= percent * united."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        held: dict[int, np.ndarray] = {}
        for batch in source:
            y, left, right = (c.to_pylist() for c in batch.columns[1:])
            keep = []
            for i in range(batch.num_rows):
                if y[i] not in held:
                    if len(held) > 200:
                        held.clear()
                    held[y[i]] = distinct_shingles([unpack(right[i]).decode()], words)[0]
                a, b = distinct_shingles([unpack(left[i]).decode()], words)[0], held[y[i]]
                common = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * common >= percent * (len(a) + len(b) - common))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    left = packed.select(F.col("node").alias("x"), F.col("packed").alias("left"))
    right = packed.select(F.col("node").alias("y"), F.col("packed").alias("right"))
    return pairs.join(left, "x").join(right, "y").select("x", "y", "left", "right").mapInArrow(batches, "a long, b long")


def _joined(links: DataFrame, labels: DataFrame | None, scratch: Scratch) -> DataFrame:
    """node and component of everything but the components' least, old labels and new links together."""
    if labels is None:
        return components(links)
    for end in ("a", "b"):
        named = labels.select(F.col("node").alias(end), F.col("component").alias(f"{end}_component"))
        links = links.join(named, end, "left").withColumn(f"{end}_component", F.coalesce(f"{end}_component", end))
    joined = components(links.select(F.col("a_component").alias("a"), F.col("b_component").alias("b")))
    moved = joined.select(F.col("node").alias("component"), F.col("component").alias("to"))
    old = labels.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return scratch.keep(old.unionByName(joined.join(labels, "node", "left_anti")))


def _open(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of the shingles that several components still share, with the component of each."""
    rows = rows.drop("component").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    several = rows.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("token")
    return rows.join(several, "token", "left_semi")


def linked(docs: DataFrame, percent: int = PERCENT, words: int = WORDS, rounds: int = ROUNDS, n_counters: int = COUNTERS) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    scratch = Scratch(docs.sparkSession)
    found = scratch.keep(measured(docs, words, n_counters))
    rows = found.where("piece is null")
    least = F.min(F.struct("doc_id", "th")).alias("r")
    sets = rows.where("size > 0 and doc_id is not null").groupBy("a", "b").agg(least).select("a", "b", "r.*")
    sets = scratch.keep(sets.withColumn("node", F.monotonically_increasing_id()))
    one = _packed(docs, sets).dropDuplicates(["node"])
    packed = scratch.keep_by(one, "node", groups_for(sets.count(), BUCKET_ROWS))
    prefixes = scratch.keep(prefixed(packed, counters(found, n_counters), percent, words))
    bits = prefixes.select("node", "bits")
    tokens = prefixes.select("node", F.posexplode("tokens").alias("place", "token"))
    shared = tokens.groupBy("token").agg(F.count("*").alias("n")).where("n > 1").select("token")
    members = tokens.join(shared, "token", "left_semi").join(prefixes.select("node", "size", "m"), "node")
    members, labels = scratch.keep(members.withColumn("component", F.col("node"))), None
    for number in range(rounds + 1):
        if number < rounds:
            # the earliest place is that of a document with few shingles of its own
            first = [F.col("place")] if number == 0 else []
            hub = F.min_by(F.struct(*_SIDE), F.struct(*first, F.xxhash64("node", F.lit(number)), "node"))
            hubs = scratch.keep(members.groupBy("token").agg(hub.alias("h")).select("token", "h.*"))
            met = _side(members, "x", ["token"]).join(_side(hubs, "y", ["token"]), "token")
            pairs = _open_by_bits(_counted(met, percent), bits, percent)
        else:
            # like sizes are in one band or in two that follow each other
            band = lambda c: F.floor(F.log(F.col(c).cast("double")) / F.log(F.lit(100 / percent * 1.000001))).cast("int")
            banded = members.join(bits, "node").withColumn("band", band("size"))
            reaching = banded.withColumn("band", F.explode(F.array(F.col("band"), F.col("band") + 1)))
            met = _side(reaching, "x", ["token", "band"]).join(_side(banded, "y", ["token", "band"]), ["token", "band"])
            pairs = _counted(met.where((F.col("band") != band("x_size")) | (F.col("x_node") < F.col("y_node"))), percent)
        links = scratch.keep(verified(pairs, packed, percent, words))
        labels = _joined(links, labels, scratch)
        scratch.drop(links)
        if number < rounds:
            scratch.drop(hubs)
            before, members = members, scratch.keep(_open(members, labels))
            scratch.drop(before)
            if members.isEmpty():
                break
    scratch.drop(packed, prefixes, members)
    named = sets.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    leader = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = named.join(leader, "component").select(F.col("a").alias("set"), "b", "component_id")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    rows = rows.withColumn("set", F.when(F.col("size") > 0, F.col("a")))
    return rows.join(named, ["set", "b"], "left").select("doc_id", F.col("size").cast("long").alias("n_shingles"), own.alias("component_id"))
