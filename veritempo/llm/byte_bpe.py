"""Byte-level BPE encoding and decoding over Arrow batches.

Every text is cut by the public split pattern of byte-level vocabularies; each distinct piece is encoded once per worker
by the `tokenizers` library and kept in a bounded cache, so a batch costs one library call for its new pieces. Ids never
cross pieces, which makes the concatenation of the pieces' ids the ids of the text. Decoding reads the byte table
backwards: an id's token is a string of stand-in characters, each of which names one byte.

Defined results: a null text counts as empty and gives no ids; an empty text gives no ids; texts of any length are
taken whole; repeated rows give repeated results; other columns are not touched. A character whose bytes are split
over several ids decodes to the right bytes when all its ids are there and to U+FFFD in `decode_text` when not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritempo.llm.pretokens import ODD, byte_split

#: Pieces that a worker keeps before it starts its cache anew (about 100 MB).
CACHE_PIECES = 500_000
#: Characters of text handled at a time inside a batch.
CHUNK_CHARS = 1_000_000

_WORKERS: dict[str, _Codec] = {}


def byte_characters() -> dict[int, str]:
    """The stand-in character of each byte: itself if visible in Latin-1, else the next code point from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class _Codec:
    """A worker's tokenizer, its piece cache and the byte table of its ids."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker for each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.split = byte_split()
        self.cache: dict[str, bytes] = {}
        to_byte = {c: b for b, c in byte_characters().items()}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        tokens = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for token, i in vocabulary.items():
            tokens[i] = bytes(to_byte[c] for c in token) if all(c in to_byte for c in token) else token.encode()
        self.pool = np.frombuffer(b"".join(tokens), np.uint8)
        self.lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.starts = np.cumsum(self.lengths) - self.lengths

    def learn(self, pieces: list[str]) -> None:
        """Encode new pieces; a cache that would grow too large starts anew."""
        if len(self.cache) + len(pieces) > CACHE_PIECES:
            self.cache.clear()
        for piece, encoding in zip(pieces, self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False), strict=True):
            self.cache[piece] = np.asarray(encoding.ids, np.int32).tobytes()

    def encode(self, text: str) -> bytes:
        """Little-endian int32 ids of a text."""
        if ODD(text):
            return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32).tobytes()
        pieces, out = self.split(text), []
        for begin in range(0, len(pieces), CACHE_PIECES // 4):
            part = pieces[begin : begin + CACHE_PIECES // 4]
            found = list(map(self.cache.get, part))
            if None in found:
                self.learn(list({p for p, ids in zip(part, found, strict=True) if ids is None}))
                found = [self.cache.get(p) if ids is None else ids for p, ids in zip(part, found, strict=True)]
            out += found
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All bytes of the ids one after another, and each id's number of bytes."""
        known = np.where(ids < len(self.lengths), ids, 0)
        lengths = np.where(ids < len(self.lengths), self.lengths[known], 0)
        at = np.repeat(self.starts[known] - (np.cumsum(lengths) - lengths), lengths)
        return self.pool[at + np.arange(len(at))], lengths


def _codec(path: str) -> _Codec:
    if path not in _WORKERS:
        _WORKERS[path] = _Codec(path)
    return _WORKERS[path]


def encode(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", offsets: bool = False) -> DataFrame:
    """Columns id, ids (array<int>) and, if asked for, starts and ends: the characters that each id covers.

    An id that covers part of a character spans that whole character, as the library reports it.
    """

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path)
        for batch in source:
            keys, texts = batch.column(0), [x or "" for x in batch.column(1).to_pylist()]
            begin = 0
            while begin < batch.num_rows:
                end, size = begin, 0
                while end < batch.num_rows and size < CHUNK_CHARS:
                    size += len(texts[end])
                    end += 1
                part = texts[begin:end]
                columns = [keys.slice(begin, end - begin)]
                if offsets:
                    found = codec.tokenizer.encode_batch(part, add_special_tokens=False)
                    columns += [pa.array([x.ids for x in found], pa.list_(pa.int32()))]
                    columns += [pa.array([[o[k] for o in x.offsets] for x in found], pa.list_(pa.int32())) for k in (0, 1)]
                else:
                    found = [codec.encode(x) for x in part]
                    edges = np.cumsum([0] + [len(x) // 4 for x in found]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(edges), pa.array(np.frombuffer(b"".join(found), np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=names)
                begin = end

    names = [id_column, "ids", *(["starts", "ends"] if offsets else [])]
    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"`{id_column}` {kind}, ids array<int>" + ", starts array<int>, ends array<int>" * offsets
    return docs.select(id_column, text_column).mapInArrow(batches, schema)


def decode(encoded: DataFrame, path: str, id_column: str = "doc_id") -> DataFrame:
    """Columns id, ids and decoded (binary): the bytes that the ids stand for; unknown ids stand for none."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path)
        for batch in source:
            lists = batch.column(1)
            sizes = np.asarray(lists.value_lengths().fill_null(0), np.int64)
            edges = np.concatenate([[0], np.cumsum(sizes)])
            ids = np.asarray(lists.flatten(), np.int64)
            begin = 0
            while begin < batch.num_rows:
                end = max(begin + 1, int(np.searchsorted(edges, edges[begin] + CHUNK_CHARS, "right")) - 1)
                found, lengths = codec.decode(ids[edges[begin] : edges[end]])
                ends = np.concatenate([[0], np.cumsum(lengths)])[edges[begin : end + 1] - edges[begin]]
                data = found.tobytes()
                decoded = pa.array([data[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(c.slice(begin, end - begin) for c in batch.columns), decoded], names=[id_column, "ids", "decoded"])
                begin = end

    kind = encoded.schema[id_column].dataType.simpleString()
    return encoded.select(id_column, "ids").mapInArrow(batches, f"`{id_column}` {kind}, ids array<int>, decoded binary")


def decode_text(encoded: DataFrame, path: str, id_column: str = "doc_id") -> DataFrame:
    """As `decode`, with a string column: bytes that are no whole character become U+FFFD."""
    decoded = decode(encoded, path, id_column)
    return decoded.withColumn("text", F.make_valid_utf8(F.col("decoded").cast("string")))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Per document the number of ids and SHA-256 digests of the ids and of the decoded bytes."""
    rows = decode(encode(docs, path), path)
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
