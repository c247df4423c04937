"""Token counts by a two-tier lookup of pre-token lengths, without a shuffle of pre-tokens.

Tier one is a table of the commonest pre-tokens and their numbers of tokens, broadcast to all workers; its size is a
parameter, whatever the corpus. Tier two is a bounded cache in each worker: a pre-token that the table lacks is encoded
once by the `tokenizers` library. A text's count is the sum over its pre-tokens, since merges never cross them. The
table comes from a bounded random sample of rows; it changes the speed alone, never a count. The sample's tasks hand
their commonest short pre-tokens to the driver, which adds them up, so that no pre-token is shuffled here either.

Defined results: a null text counts as empty, with 0 bytes and 0 tokens; texts of any length are counted whole;
repeated rows give repeated results, null ids too; other columns are ignored, whatever their names; an empty table gives
an empty result.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritempo.llm.pretokens import ODD, word_split

#: Entries of the broadcast table, at most.
FREQUENT = 50_000
#: Characters of a pre-token in the table, at most.
SHORT = 24
#: Rows that the table is made from, about, and distinct pre-tokens that one of them adds, at most.
TABLE_DOCUMENTS, TABLE_PIECES = 1_000, 1_000
#: Entries of a worker's cache, at most.
CACHE_PIECES = 500_000

_WORKERS: dict[str, _Counter] = {}


class _Counter:
    """A worker's tokenizer and its cache of pre-token lengths."""

    def __init__(self, path: str, table: dict[str, int]):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker for each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.split = word_split()
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(added)).search if added else lambda text: None
        self.table, self.cache = table, dict(table)

    def pieces(self, text: str) -> list[str] | None:
        """The pre-tokens of a text, or None if the library has to split it."""
        low = unicodedata.normalize("NFC", text).lower()
        # ordinary characters may compose or lower to others, which no set of the split holds
        if ODD(text) or ODD(low) or self.special(text):
            return None
        return self.split(low)

    def lengths(self, pieces: list[str]) -> dict[str, int]:
        found = self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)
        return {p: len(x.ids) for p, x in zip(pieces, found, strict=True)}

    def count(self, text: str) -> int:
        pieces = self.pieces(text)
        if pieces is None:
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        total = 0
        for begin in range(0, len(pieces), CACHE_PIECES // 4):
            part = pieces[begin : begin + CACHE_PIECES // 4]
            found = list(map(self.cache.get, part))
            if None in found:
                new = self.lengths(list({p for p, n in zip(part, found, strict=True) if n is None}))
                total += sum(new[p] if n is None else n for p, n in zip(part, found, strict=True))
                self.keep(new)
            else:
                total += sum(found)
        return total

    def keep(self, new: dict[str, int]) -> None:
        """Add to the cache; one that would grow too large starts anew from the table."""
        if len(self.cache) + len(new) > CACHE_PIECES:
            self.cache = dict(self.table)
        self.cache.update(new)


def _counter(path: str, table: dict[str, int]) -> _Counter:
    if path not in _WORKERS or _WORKERS[path].table is not table:
        _WORKERS[path] = _Counter(path, table)
    return _WORKERS[path]


def frequent_lengths(docs: DataFrame, path: str, text_column: str = "text") -> dict[str, int]:
    """Pre-tokens and their numbers of tokens, the commonest of a bounded sample; a speed aid only."""

    def pieces(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, seen = _Counter(path, {}), Counter()
        for batch in source:
            for text in batch.column(0).to_pylist():
                own = Counter(p for p in counter.pieces(text or "") or [] if len(p) <= SHORT)
                seen.update(dict(own.most_common(TABLE_PIECES)))
        words = list(seen)
        lengths = counter.lengths(words)
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([seen[w] for w in words], pa.int64()), pa.array([lengths[w] for w in words], pa.int32())], names=["piece", "n", "tokens"])

    sample = docs.select(text_column).where(F.rand(20) < min(1.0, TABLE_DOCUMENTS / max(1, docs.count())))
    seen, lengths = Counter(), {}
    for r in sample.mapInArrow(pieces, "piece string, n long, tokens int").toLocalIterator():
        seen[r.piece] += r.n
        lengths[r.piece] = r.tokens
    common = sorted(seen, key=lambda p: (-seen[p], p))[:FREQUENT]
    return {p: lengths[p] for p in common}


def token_counts(docs: DataFrame, path: str, limit: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Columns id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit)."""
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, path, text_column))

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path, table.value)
        for batch in source:
            counts = np.fromiter((counter.count(x.as_py() or "") for x in batch.column(1)), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts), pa.array(counts > limit)], names=[id_column, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(id_column, text_column, F.coalesce(F.octet_length(text_column), F.lit(0)).cast("long").alias("n_bytes_"))
    return rows.mapInArrow(batches, f"`{id_column}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
