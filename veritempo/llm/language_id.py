"""Language identification: multinomial logistic regression on TF-IDF character n-grams, trained by FTRL.

Texts are lower-cased; every character but letters counts as a space. Features are the n-grams of 1 to 3 characters,
hashed into a fixed number of buckets; a bucket's value is its share of the text's n-grams times its inverse document
frequency, which is counted over all documents to learn from. Weights are learned by follow-the-regularised-leader with
an elastic net (L1 leaves most weights at zero) from all labelled texts but a fifth, which is kept aside: all of it fits
the temperature that turns scores into calibrated probabilities. Texts are dealt by hash to shards of about `SHARD`; each
shard learns by itself, and the model has the mean of their weights, by the number of texts learned. Shards, their order
and all sums are functions of the texts and labels, so another layout of the same rows gives the same model. Its size is
buckets times languages, whatever the corpus, so it is broadcast; more than `LANGUAGES` languages are an error.

Defined results: a null text, or one without a letter, is `und` with score 0; texts of any length are read whole;
repeated rows get repeated results; a null language is never learned; with no labelled document every text is `und`;
equal scores go to the language that sorts first; other columns are never inputs, and columns named like those of the
result are replaced by it; a null doc_id counts as an empty one, which is held out; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

#: Buckets of the hashed n-grams.
BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
#: Labelled documents that one task learns from, about; the number of tasks grows with them.
SHARD = 4_000
EPOCHS = 4
#: Features that a task holds at a time, about: so many are passed over `EPOCHS` times before the next are read.
HELD = 2_000_000
#: Weights and losses are added up as whole numbers of this unit, so that their order doesn't matter.
UNIT = 1 << 24
#: Labelled languages, at most: the model, which is broadcast, has buckets times languages weights (134 MB then).
LANGUAGES = 512
#: Follow-the-regularised-leader: learning rate, its smoothing, and the two penalties of the elastic net.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.02, 0.002
#: Values are shares of a text; this brings them near 1.
SCALE = 30.0
#: Characters handled at a time.
CHUNK_CHARS = 1_000_000

UNDETERMINED = "und"

_SPACE, _END = 32, 0
_LETTERS: list[np.ndarray] = []


def _letters(largest: int) -> np.ndarray:
    """For each code point its lower-case letter, or a space."""
    size = 0x3000 if largest < 0x3000 else 0x110000
    if not _LETTERS or len(_LETTERS[0]) < size:
        _LETTERS[:] = [np.fromiter((ord(c.lower()[0]) if (c := chr(i)).isalpha() else _SPACE for i in range(size)), np.uint32, size)]
    return _LETTERS[0]


def _chunks(texts: list[str]) -> Iterator[list[str]]:
    begin = 0
    while begin < len(texts):
        end, size = begin, 0
        while end < len(texts) and size < CHUNK_CHARS:
            size += len(texts[end])
            end += 1
        yield texts[begin:end]
        begin = end


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters of all texts, each between spaces and closed by an end mark; where each begins; whether it has letters."""
    raw = np.frombuffer("".join(f" {t} \0" for t in texts).encode("utf-32-le", "replace"), np.uint32)
    lengths = np.fromiter((len(t) + 3 for t in texts), np.int64, len(texts))
    starts = np.cumsum(lengths) - lengths
    codes = _letters(int(raw.max(initial=0)))[raw]
    found = np.add.reduceat(codes != _SPACE, starts) > 0 if len(texts) else np.zeros(0, bool)
    codes[starts + lengths - 1] = _END
    return codes, starts, found


def _grams(codes: np.ndarray, order: int) -> np.ndarray:
    """Bucket of the n-gram at each place; BUCKETS where it would cross an end mark."""
    n = len(codes)
    mixed, crosses = np.zeros(n, np.uint32), np.zeros(n, bool)
    for k in range(order):
        later = np.zeros(n, np.uint32)
        later[: n - k] = codes[k:]
        mixed = (mixed + later + np.uint32(order)) * np.uint32(0x9E3779B1)
        crosses |= later == _END
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x85EBCA77)
    buckets = (mixed >> np.uint32(16)).astype(np.int32) & (BUCKETS - 1)
    buckets[crosses] = BUCKETS
    return buckets


def _counts(text: str) -> np.ndarray:
    """How often each bucket occurs in a text."""
    codes, _, _ = _codes([text])
    return sum(np.bincount(_grams(codes, n), minlength=BUCKETS + 1)[:BUCKETS] for n in ORDERS)


def document_frequencies(learn: DataFrame, text_column: str = "text") -> tuple[np.ndarray, int]:
    """In how many texts each bucket occurs, over all rows, and the number of texts with letters."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS + 1, np.int64)
        for batch in source:
            for part in _chunks([t for t in batch.column(0).to_pylist() if t]):
                codes, starts, found = _codes(part)
                places = [_grams(codes, n) for n in ORDERS]
                seen = np.zeros(BUCKETS + 1, bool)
                for a, b in zip(starts, [*starts[1:], len(codes)], strict=True):
                    for p in places:
                        seen[p[a:b]] = True
                    total += seen
                    seen[:] = False
                total[BUCKETS] += int(found.sum()) - len(part)  # end marks had counted every text
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["bucket", "n"])

    rows = learn.select(text_column).mapInArrow(batches, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(BUCKETS + 1, np.int64)
    for r in rows:
        counts[r.bucket] = r.n
    return counts[:BUCKETS], int(counts[BUCKETS])


def ftrl(examples: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int = EPOCHS, state: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Weights [buckets, classes] learned from (buckets, values, class) in the given order; a state is gone on from and changed."""
    z, n = (np.zeros((BUCKETS, classes)), np.zeros((BUCKETS, classes))) if state is None else state

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) > L1, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)

    for _ in range(epochs):
        for at, values, label in examples:
            zs, ns = z[at], n[at]
            w = weights(zs, ns)
            scores = values @ w
            p = np.exp(scores - scores.max())
            p /= p.sum()
            p[label] -= 1
            g = values[:, None] * p
            z[at] = zs + g - (np.sqrt(ns + g * g) - np.sqrt(ns)) / ALPHA * w
            n[at] = ns + g * g
    return weights(z, n)


TEMPERATURES = np.geomspace(0.05, 20, 241)


def losses(scores: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """The log loss [temperatures, rows] of each row at each of `TEMPERATURES`."""
    s = scores[None] / TEMPERATURES[:, None, None]
    s = s - s.max(2, keepdims=True)
    return np.log(np.exp(s).sum(2)) - s[:, np.arange(len(labels)), labels]


def temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of scores with the least log loss."""
    return float(TEMPERATURES[losses(scores, labels).mean(1).argmin()]) if len(scores) else 1.0


def learned_here(doc_id: Column) -> Column:
    """Four fifths of all documents, by the CRC-32 of the id's decimal text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 != 0


def _logits(texts: list[str], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores [texts, languages] by a table of weights, and which texts have letters."""
    codes, starts, found = _codes(texts)
    sums = sum(np.add.reduceat(weights[_grams(codes, n)], starts, dtype=np.float64) for n in ORDERS)
    sizes = np.diff([*starts, len(codes)]) - 1
    grams = sum(np.maximum(sizes - n + 1, 0) for n in ORDERS)
    return sums / grams[:, None], found


def learned_weights(rows: DataFrame, langs: list[str], idf: np.ndarray, shards: int) -> np.ndarray:
    """Mean weights [buckets, languages] of all shards of rows (text, lang, key), by how many texts each has learned."""

    def fit(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = np.zeros((BUCKETS, len(langs))), np.zeros((BUCKETS, len(langs)))
        weights, examples, held, learned = None, [], 0, 0
        for batch in source:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = _counts(text)
                at = np.flatnonzero(found)
                if len(at):
                    examples.append((at, found[at] / found.sum() * idf[at] * SCALE, langs.index(lang)))
                    held, learned = held + len(at), learned + 1
                if held >= HELD:
                    weights, examples, held = ftrl(examples, len(langs), state=state), [], 0
        if examples:
            weights = ftrl(examples, len(langs), state=state)
        whole = np.rint((np.zeros(0) if weights is None else weights.ravel()) * (learned * UNIT)).astype(np.int64)
        used = np.flatnonzero(whole)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *used.tolist()], pa.int32()), pa.array([learned, *whole[used].tolist()], pa.int64())], names=["place", "total"])

    dealt = rows.repartition(shards, "key").sortWithinPartitions("key", "lang", "text").select("text", "lang")
    totals = {r.place: r.total for r in dealt.mapInArrow(fit, "place int, total long").groupBy("place").agg(F.sum("total").alias("total")).collect()}
    weights, learned = np.zeros(BUCKETS * len(langs)), totals.pop(-1, 0)
    weights[np.fromiter(totals, np.int64, len(totals))] = np.fromiter(totals.values(), np.float64, len(totals)) / (max(learned, 1) * UNIT)
    return weights.reshape(BUCKETS, len(langs))


def calibrated(rows: DataFrame, langs: list[str], weights: np.ndarray) -> tuple[float, float]:
    """The temperature with the least log loss over all rows (text, lang), and the lowest probability of a row's own language there."""
    shared = rows.sparkSession.sparkContext.broadcast(weights)

    def judge(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, worst = np.zeros(len(TEMPERATURES), np.int64), np.zeros(len(TEMPERATURES))
        n = 0
        for batch in source:
            at = 0
            for part in _chunks(batch.column(0).to_pylist()):
                labels = np.array([langs.index(x) for x in batch.column(1)[at : at + len(part)].to_pylist()], int)
                at += len(part)
                scores, found = _logits(part, shared.value)
                for k in range(0, len(part), 1000):
                    lost = losses(scores[k : k + 1000][found[k : k + 1000]], labels[k : k + 1000][found[k : k + 1000]])
                    n += lost.shape[1]
                    total += np.rint(lost * UNIT).astype(np.int64).sum(1)
                    worst = np.maximum(worst, lost.max(1, initial=0))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total) if n else 0), pa.int32()), pa.array(total[: len(total) if n else 0]), pa.array(worst[: len(total) if n else 0])], names=["place", "total", "worst"])

    found = rows.mapInArrow(judge, "place int, total long, worst double").groupBy("place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.max("worst").alias("worst")).collect()
    if not found:
        return 1.0, 0.0
    best = min(found, key=lambda r: (r.total, r.place))
    return float(TEMPERATURES[best.place]), float(np.exp(-best.worst))


def train(labelled: DataFrame, text_column: str = "text", lang_column: str = "lang", shard: int = SHARD) -> dict | None:
    """A model {langs, weights, temperature, least} from all rows of text and language; None if there is nothing to learn.

    least is the lowest probability that a row kept aside has for its own language.
    """
    rows = labelled.where(F.col(lang_column).isNotNull()).select(F.col(text_column).alias("text"), F.col(lang_column).alias("lang"))
    sizes = {r.lang: r.n for r in rows.where("text is not null").groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    if len(sizes) > LANGUAGES:
        raise ValueError(f"{len(sizes)} labelled languages are more than {LANGUAGES}")
    langs = sorted(sizes)
    counts, texts = document_frequencies(rows)
    idf = (np.log((1 + texts) / (1 + counts)) + 1).astype(np.float64)
    rows = rows.where("text is not null").withColumn("key", F.xxhash64("text", "lang"))
    aside = F.pmod(F.shiftright("key", 20), F.lit(5)) == 0
    table = np.zeros((BUCKETS + 1, len(langs)), np.float32)
    table[:BUCKETS] = learned_weights(rows.where(~aside), langs, idf, -(-sum(sizes.values()) // shard)) * (idf[:, None] * SCALE)
    fitted, least = calibrated(rows.where(aside).select("text", "lang"), langs, table)
    return {"langs": langs, "weights": table, "temperature": fitted, "least": least}


def predict(docs: DataFrame, model: dict | None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows with lang_pred and score (the calibrated probability of that language) added."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("lang_pred", "score")
    names = [*docs.columns, "lang_pred", "score"]
    place = docs.columns.index(text_column)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in source:
            langs, scores = [], []
            for part in _chunks([t or "" for t in batch.column(place).to_pylist()]):
                if model is None:
                    langs += [UNDETERMINED] * len(part)
                    scores += [0.0] * len(part)
                    continue
                raw, found = _logits(part, model["weights"])
                logits = raw / model["temperature"]
                p = np.exp(logits - logits.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                best = p.argmax(1)
                langs += [model["langs"][b] if f else UNDETERMINED for b, f in zip(best, found, strict=True)]
                scores += np.where(found, p[np.arange(len(best)), best], 0.0).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=names)

    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return docs.mapInArrow(batches, schema)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document, learned from the others' labels."""
    model = train(docs.where(learned_here(F.col("doc_id"))))
    found = predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (~learned_here(F.col("doc_id"))).alias("held_out"), "lang_pred", "score")
