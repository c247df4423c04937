"""Near-duplicate classes by DartMinHash signatures, banded joins and exact checks.

Signatures. A set's elements are its word shingles (weight 1 here; any weights work). Each element throws darts: a
Poisson process along the rank axis for every unit of its weight, all from hashes of the element, a last region that its
weight covers in part keeping the darts that fall inside. Each dart carries a coordinate; the earliest dart of each
coordinate is the signature. Two sets agree in a coordinate with the probability of their weighted Jaccard similarity,
and only about K ln K darts are thrown, however large the set.

Classes. Rows with the same text are collapsed first and take part once. Signatures are cut into bands; texts that share
a band are candidates. No bucket is expanded into pairs: in each bucket all texts are compared with one hub, hubs being
dealt by a hash so that bands have different ones. Compared means: the exact Jaccard similarity of the shingle sets.
Linked texts form components, and only buckets that still hold several components go on, to the other `rounds` - 1 hubs,
all in one turn, since a turn costs dozens of stages and a further hub only its comparisons. What is open then goes
through an exact prefix filter (`prefix_pairs`), which misses no similar pair and keeps unlike members of a large group
apart. Thus each candidate pair is compared, shown to be unlike, or known to be of
one class, and classes are those of comparing all candidate pairs. Before texts are fetched, parity bitmaps of the shingle
sets rule out pairs: two sets differ in at least as many shingles as their bitmaps in bits.

Defined results: a null text, or one without words, is alone in its class even if repeated; texts of any length are
taken whole; a text of fewer than five words is one shingle; rows with the same doc_id are one document for the links; a
row without doc_id has a null class; the class is named by its least doc_id; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritempo.llm.common import Scratch
from veritempo.llm.components import components
from veritempo.llm.shingles import jaccard, mix, shingles

WORDS, SIMILARITY = 5, 0.8
#: 25 bands of 5: a pair at 0.8 is missed with probability 5e-5.
BANDS, ROWS = 25, 5
#: Hubs that a bucket has before the prefix filter: one, then the others together if the bucket is still open.
ROUNDS = 3
CHUNK_CHARS = 1_000_000
#: Bits of a set's parity bitmap.
PARITY_BITS = 512

_DART, _PLACE, _SIDE, _REGION = (np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3))


def _uniform(x: np.ndarray) -> np.ndarray:
    """In (0, 1]."""
    return ((mix(x) >> np.uint64(11)).astype(np.float64) + 1) / (1 << 53)


def dart_signatures(elements: np.ndarray, sizes: np.ndarray, k: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Signatures [set, k] of sets whose 64-bit elements stand one after another; sets without elements get zeros."""
    out = np.zeros((len(sizes), k), np.uint64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    room = np.ones(len(elements)) if weights is None else np.asarray(weights, np.float64)
    if weights is not None:  # one row for each unit of weight
        regions = np.ceil(room).astype(np.int64)
        number = np.arange(regions.sum()) - np.repeat(np.cumsum(regions) - regions, regions)
        owner, elements, room = np.repeat(owner, regions), np.repeat(elements, regions) + number.astype(np.uint64) * _REGION, np.repeat(room, regions) - number
    mass = np.bincount(owner, np.minimum(room, 1.0), len(sizes))
    with np.errstate(divide="ignore"):
        reach = np.where(mass > 0, k * (np.log(k) + 3) / np.maximum(mass, 1e-300), 0)
    unfilled = mass > 0
    while unfilled.any():
        live = unfilled[owner]
        at, seed, part, rank = owner[live], mix(elements[live]), room[live], np.zeros(int(live.sum()))
        darts: list[tuple[np.ndarray, ...]] = []
        while len(at):
            seed = seed + _DART
            rank = rank - np.log(_uniform(seed))
            near = rank <= reach[at]
            at, seed, part, rank = at[near], seed[near], part[near], rank[near]
            hit = slice(None) if weights is None else _uniform(seed ^ _SIDE) <= part
            darts.append((at[hit], rank[hit], mix(seed[hit] ^ _PLACE)))
        where, ranks, ids = (np.concatenate(x) for x in zip(*darts, strict=True))
        cell = where * k + (ids % np.uint64(k)).astype(np.int64)
        order = np.lexsort((ids, ranks, cell))
        cells, first = np.unique(cell[order], return_index=True)
        full = np.bincount(cells // k, minlength=len(sizes)) == k
        keep = full[cells // k]
        out.reshape(-1)[cells[keep]] = ids[order][first[keep]]
        unfilled &= ~full
        reach = np.where(unfilled, reach * 2, reach)
    return out


def band_hashes(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """[set, band]: a hash of each band's coordinates."""
    parts = signatures[:, : bands * rows].reshape(len(signatures), bands, rows)
    value = np.zeros(parts.shape[:2], np.uint64)
    for r in range(rows):
        value = mix(value * np.uint64(0xD6E8FEB86659FD93) + parts[:, :, r])
    return value.astype(np.int64)


def parity_bitmaps(elements: np.ndarray, owner: np.ndarray, sets: int) -> np.ndarray:
    """[set, word]: bit b of a set's bitmap tells whether an odd number of its elements hash to b."""
    cells = owner * PARITY_BITS + (mix(elements) % np.uint64(PARITY_BITS)).astype(np.int64)
    odd = (np.bincount(cells, minlength=sets * PARITY_BITS) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(sets, PARITY_BITS), axis=1).view(np.int64)


def may_be_similar(bits: str, other: str, sizes: Column, similarity: float) -> Column:
    """Whether two sets with these bitmaps and this sum of sizes may be similar; exact where it says no."""
    apart = sum((F.bit_count(F.col(bits)[w].bitwiseXOR(F.col(other)[w])) for w in range(PARITY_BITS // 64)), F.lit(0))
    return apart <= sizes * ((1 - similarity) / (1 + similarity)) + 1e-6


def text_chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    begin = 0
    while begin < len(texts):
        end, size = begin, 0
        while end < len(texts) and size < CHUNK_CHARS:
            size += len(texts[end])
            end += 1
        yield begin, end
        begin = end


def signed(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, a and b (128-bit hash of the text), size (distinct shingles), bands and bits of every row with words."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            texts = batch.column(1).to_pylist()
            for begin, end in text_chunks(texts):
                elements, sizes = shingles(texts[begin:end], WORDS)
                owner = np.repeat(np.arange(end - begin), sizes)
                first = np.sort(np.unique(elements + mix(owner.astype(np.uint64)), return_index=True)[1])
                elements, owner = elements[first], owner[first]
                sizes = np.bincount(owner, minlength=end - begin)
                parity = parity_bitmaps(elements, owner, end - begin)
                found = band_hashes(dart_signatures(elements, sizes, bands * rows), bands, rows)
                some = np.flatnonzero(sizes > 0)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(found[some].reshape(-1)), bands).cast(pa.list_(pa.int64()))
                bits = pa.FixedSizeListArray.from_arrays(pa.array(parity[some].reshape(-1)), PARITY_BITS // 64).cast(pa.list_(pa.int64()))
                head = [batch.column(i).slice(begin, end - begin).take(pa.array(some)) for i in (0, 2, 3)]
                yield pa.RecordBatch.from_arrays([*head, pa.array(sizes[some].astype(np.int32)), lists, bits], names=["doc_id", "a", "b", "size", "bands", "bits"])

    source = docs.where("text is not null and doc_id is not null").select("doc_id", "text", F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(batches, f"doc_id {kind}, a long, b long, size int, bands array<long>, bits array<long>")


def compared(pairs: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Those of pairs(x, y) whose texts' shingle sets are similar; texts: doc_id and packed."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        hubs: dict[int, np.ndarray] = {}
        for batch in source:
            x, y, left, right = (c.to_pylist() for c in batch.columns)
            keep = []
            for i in range(batch.num_rows):
                if y[i] not in hubs:
                    if len(hubs) > 500:
                        hubs.clear()
                    hubs[y[i]] = np.unique(shingles([unpack(right[i]).decode()], WORDS)[0])
                keep.append(jaccard(np.unique(shingles([unpack(left[i]).decode()], WORDS)[0]), hubs[y[i]]) >= similarity)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], names=["x", "y"])

    hub = texts.select(F.col("doc_id").alias("y"), F.col("packed").alias("right"))
    member = texts.select(F.col("doc_id").alias("x"), F.col("packed").alias("left"))
    rows = pairs.join(hub, "y").join(member, "x").select("x", "y", "left", "right")
    kind = pairs.schema["x"].dataType.simpleString()
    return rows.mapInArrow(batches, f"x {kind}, y {kind}")


def _packed(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id and compressed text of the wanted documents, one row each."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in source:
            packed = pa.array([pack(t.encode("utf-8", "replace")) for t in batch.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), packed], names=["doc_id", "packed"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.where("text is not null and doc_id is not null").select("doc_id", "text").mapInArrow(batches, f"doc_id {kind}, packed binary")
    return rows.join(wanted, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("packed").alias("packed"))


def prefix_pairs(open_docs: DataFrame, packed: DataFrame, similarity: float, scratch: Scratch | None = None) -> DataFrame:
    """All pairs (x, y) across components that may be similar: an exact filter, for documents that hubs left open.

    open_docs: doc_id, size, component, bits. Each set's shingles are put in one global order, rarest first. Similar sets
    overlap so much that their first common shingle stands early in both: near enough to the front that what follows can
    still hold the overlap. Shingles that a whole group shares stand late, so its unlike members don't meet there.
    A shingle's rows are first met as one row per component, and expanded only where that row passes. Pairs, and meetings
    with a component's only row, must also pass their bitmaps, so unlike members of a large group make no rows.
    """

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in source:
            for i in range(batch.num_rows):
                found = np.unique(shingles([unpack(batch.column(1)[i].as_buffer()).decode()], WORDS)[0]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[i].as_py()] * len(found), batch.schema.field(0).type), pa.array(found)], names=["doc_id", "token"])

    kind = packed.schema["doc_id"].dataType.simpleString()
    tokens = packed.join(open_docs.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "packed").mapInArrow(batches, f"doc_id {kind}, token long")
    known = tokens.groupBy("token").agg(F.count("*").alias("n_docs")).where("n_docs > 1")
    shared = tokens.join(known, "token").join(open_docs.drop("bits"), "doc_id")
    every = Window.partitionBy("doc_id")
    place = F.col("size") - F.count("*").over(every) + F.row_number().over(every.orderBy("n_docs", "token")) - 1
    rows = shared.select("doc_id", "component", "token", "size", (F.col("size") - place).alias("left"))
    share = similarity / (1 + similarity)
    slack = 1e-6
    rows = (scratch or Scratch(packed.sparkSession)).keep(rows.where(F.col("left") >= F.col("size") * similarity - slack).join(open_docs.select("doc_id", "bits"), "doc_id"))
    short = rows.where(F.col("left") >= F.col("size") * (2 * share) - slack).select("token", F.col("component").alias("c"), F.col("doc_id").alias("y"), F.col("size").alias("s"), F.col("left").alias("l"), F.col("bits").alias("own_bits"))
    groups = short.groupBy("token", "c").agg(F.min("s").alias("least"), F.max("s").alias("most"), F.max("l").alias("l"), F.count("*").alias("n"), F.min("own_bits").alias("own_bits"))
    least = F.greatest(F.col("least"), F.col("size") * similarity)
    met = rows.join(groups, "token").where("component != c").where((F.col("least") <= F.col("size")) & (F.col("most") >= F.col("size") * similarity - slack))
    met = met.where(F.least("left", "l") >= (F.col("size") + least) * share - slack)
    met = met.where((F.col("n") > 1) | may_be_similar("bits", "own_bits", F.col("size") + F.col("least"), similarity)).select("token", "c", F.col("doc_id").alias("x"), "size", "left", "bits")
    both = met.join(short, ["token", "c"]).where((F.col("s") <= F.col("size")) & (F.col("s") >= F.col("size") * similarity - slack))
    both = both.where(F.least("left", "l") >= (F.col("size") + F.col("s")) * share - slack)
    both = both.where(may_be_similar("bits", "own_bits", F.col("size") + F.col("s"), similarity))
    return both.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, rounds: int = ROUNDS) -> DataFrame:
    """doc_id and class_id of every row.

    What the turns read again is written to a scratch folder, so that small tables lie in few files; of all of it only the
    classes of different texts are left.
    """
    scratch = Scratch(docs.sparkSession)
    every = signed(docs)
    alone = F.min(F.struct("doc_id", "size", "bands", "bits")).alias("r")
    texts = scratch.keep(every.groupBy("a", "b").agg(alone).select("a", "b", "r.*"))
    buckets = texts.select("doc_id", "size", F.posexplode("bands").alias("band", "bucket"))
    shared = buckets.groupBy("band", "bucket").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    members = scratch.keep(buckets.join(shared, ["band", "bucket"]).select("band", "bucket", "doc_id", "size", F.col("doc_id").alias("component")))
    packed = scratch.keep(_packed(docs, members.select("doc_id").distinct()))
    labels, seen, held = None, None, members
    similar_size = F.least("size", "hub_size") >= F.greatest("size", "hub_size") * F.lit(similarity)
    for numbers in [*(x for x in (range(min(rounds, 1)), range(1, rounds)) if x), None]:
        if numbers:
            own = [F.col("doc_id").alias("hub"), F.col("size").alias("hub_size"), F.col("component").alias("hub_component")]
            least = [F.min(F.struct(F.xxhash64("doc_id", "band", F.lit(number)), *own)).alias(f"h{number}") for number in numbers]
            hubs = members.groupBy("band", "bucket").agg(*least).select("band", "bucket", F.explode(F.array(*[f"h{number}" for number in numbers])).alias("h"))
            pairs = members.join(hubs.select("band", "bucket", "h.hub", "h.hub_size", "h.hub_component"), ["band", "bucket"])
            pairs = pairs.where("component != hub_component").where(similar_size)
            pairs = pairs.select(F.least("doc_id", "hub").alias("x"), F.greatest("doc_id", "hub").alias("y")).distinct()
        else:
            left_open = members.select("doc_id", "size", "component").distinct()
            pairs = prefix_pairs(left_open.join(texts.select("doc_id", "bits"), "doc_id"), packed, similarity, scratch)
        pairs = scratch.keep(pairs if seen is None else pairs.join(seen, ["x", "y"], "left_anti"))
        seen = pairs if seen is None else seen.unionByName(pairs)
        links = compared(pairs, packed, similarity)
        if labels is None:
            labels = components(links.select(F.col("x").alias("a"), F.col("y").alias("b")), scratch)
        else:
            for end in ("x", "y"):
                named = labels.select(F.col("node").alias(end), F.col("component").alias(f"{end}_component"))
                links = links.join(named, end, "left").withColumn(f"{end}_component", F.coalesce(f"{end}_component", end))
            joined = components(links.select(F.col("x_component").alias("a"), F.col("y_component").alias("b")), scratch)
            moved = joined.select(F.col("node").alias("component"), F.col("component").alias("to"))
            old = labels.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
            labels = scratch.keep(old.unionByName(joined.join(labels, "node", "left_anti")))
        members = members.drop("component").join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
        open_ = members.groupBy("band", "bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("band", "bucket")
        before, members = held, scratch.keep(members.join(open_, ["band", "bucket"]).select("band", "bucket", "doc_id", "size", "component"))
        scratch.drop(before)
        held = members
        if members.isEmpty():
            break
    named = Scratch(docs.sparkSession).keep(texts.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("a", "b", F.coalesce("component", "doc_id").alias("class_id")))
    scratch.clear()
    rows = docs.select("doc_id", F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b"))
    return rows.join(named, ["a", "b"], "left").select("doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"))
