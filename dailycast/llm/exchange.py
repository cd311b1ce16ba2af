"""Corpus-wide counts of hashed n-grams, asked for and answered in packed blocks.

A row per n-gram of the whole corpus would move far more bytes than the text
has.  So a map task packs its documents into chunks, and each chunk asks for the
counts of its own distinct n-grams: their hashes, cut into one block for each
range of hash values.  The owner of a range adds up the blocks of all chunks
(a hot n-gram comes once per chunk, however many documents hold it) and answers
each chunk with the places where the corpus count differs from the chunk's own.
The chunk's words meet the answers: a second scan makes the same chunks again,
which costs less than to move the words twice.

Hashes have 64 bits; a block keeps 48 of them below those that name its range."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dailycast.llm import common, words

ROWS = "dest int, kind int, chunk long, part int, a binary, b binary, c binary, d binary"
_SCHEMA = pa.schema([("dest", pa.int32()), ("kind", pa.int32()), ("chunk", pa.int64()), ("part", pa.int32()),
                     *((c, pa.binary()) for c in "abcd")])
#: Kinds of rows: a question or an answer; a chunk's own documents.
ASK, OWN = 0, 1
#: Bits of a chunk's number inside its partition.
SERIAL = 20
#: From word hashes and each document's first word: distinct sorted keys and their counts in the chunk.
Keys = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_SCHEMA)], schema=_SCHEMA)


def _squeezed(values: np.ndarray) -> bytes:
    """Mostly small numbers, not negative: byte planes (only those in use), compressed."""
    wide = values.astype("<u8")
    planes = wide.view(np.uint8).reshape(-1, 8).T[:max(1, (int(wide.max(initial=0)).bit_length() + 7) // 8)]
    head = len(wide).to_bytes(8, "little")
    return head + zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(planes).tobytes())


def _spread(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    raw = zstandard.ZstdDecompressor().decompress(data[8:])
    wide = np.zeros((n, 8), np.uint8)
    if n:
        wide[:, :len(raw) // n] = np.frombuffer(raw, np.uint8).reshape(-1, n).T
    return wide.view("<i8").ravel()


def _bounds(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Where each range of hash values begins in sorted ``keys`` (and the end)."""
    owner = ((keys >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
    return np.searchsorted(owner, np.arange(ranges + 1, dtype=np.uint64))


def _cuts(ranges: int) -> tuple[np.ndarray, int]:
    """Each range's first hash, and how many low bits a block leaves out."""
    starts = -(-(np.arange(ranges, dtype=object) << 32) // ranges) << 32
    return np.asarray(starts.tolist(), np.uint64), max(0, 64 - (ranges.bit_length() - 1) - 48)


def _own_row(chunk: int, ids: list, texts: list[bytes]) -> pa.RecordBatch:
    h, first = words.word_hashes(texts)
    distinct, which, count = np.unique(h, return_inverse=True, return_counts=True)
    order = np.argsort(-count, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    numbers = np.asarray([i or 0 for i in ids], np.int64)
    known = np.asarray([i is not None for i in ids], bool)
    return _rows([(0, OWN, chunk, 0, numbers.tobytes() + known.tobytes(), distinct[order].tobytes(),
                   _squeezed(rank[which]), _squeezed(np.diff(first)))])


def _ask_rows(chunk: int, texts: list[bytes], keys_of: Keys, ranges: int, parts: int) -> pa.RecordBatch:
    keys, counts = keys_of(*words.word_hashes(texts))
    at = _bounds(keys, ranges)
    starts, left_out = _cuts(ranges)
    rows = []
    for r in range(ranges):
        s, e = at[r], at[r + 1]
        if e > s:
            block = ((keys[s:e] - starts[r]) >> np.uint64(left_out)).astype(np.int64)
            rows.append((r % parts, ASK, chunk, r, _squeezed(np.diff(block, prepend=0)), _squeezed(counts[s:e]), None, None))
    return _rows(rows)


def _answers(asked: list[tuple[int, int, int, bytes, bytes]]) -> pa.RecordBatch:
    """Corpus counts for one range, sent back where they differ from the chunk's own count."""
    blocks = [np.cumsum(_spread(a)) for *_, a, _ in asked]
    sizes = [len(b) for b in blocks]
    keys = np.concatenate(blocks)
    own = np.concatenate([_spread(b) for *_, b in asked])
    order = np.argsort(keys, kind="stable")
    sorted_keys = keys[order]
    first = np.flatnonzero(np.append(True, sorted_keys[1:] != sorted_keys[:-1]))
    sums = np.add.reduceat(own[order], first)
    total = np.empty(len(keys), np.int64)
    total[order] = np.repeat(sums, np.diff(np.append(first, len(keys))))
    rows, at = [], 0
    for (chunk, part, dest, _, _), size in zip(asked, sizes):
        there = total[at:at + size]
        differs = np.flatnonzero(there != own[at:at + size])
        if len(differs):
            more = there[differs] - own[at:at + size][differs]
            rows.append((dest, ASK, chunk, part, _squeezed(np.diff(differs, prepend=0)), _squeezed(more),
                         size.to_bytes(8, "little"), None))
        at += size
    return _rows(rows)


class Chunk:
    """A chunk's documents: ids, word hashes, each one's first word; and the corpus counts of its keys."""

    def __init__(self, number: int, a: bytes, b: bytes, c: bytes, d: bytes):
        self.number = number
        docs = len(a) // 9
        known = np.frombuffer(a[docs * 8:], bool)
        self.ids = [int(i) if k else None for i, k in zip(np.frombuffer(a[:docs * 8], np.int64), known)]
        self.words = np.frombuffer(b, np.uint64)[_spread(c)]
        self.first = np.concatenate([[0], np.cumsum(_spread(d))])

    def corpus_counts(self, keys: np.ndarray, counts: np.ndarray, answers: list[tuple[int, bytes, bytes, bytes]], ranges: int) -> np.ndarray:
        total = counts.astype(np.int64)
        at = _bounds(keys, ranges)
        for part, places, more, size in answers:
            if int.from_bytes(size, "little") != at[part + 1] - at[part]:
                raise ValueError("the two scans made different chunks: the input does not repeat its rows in order")
            total[at[part] + np.cumsum(_spread(places))] += _spread(more)
        return total


def with_corpus_counts(docs: DataFrame, keys_of: Keys, resolve: Callable[[Chunk, Callable[[np.ndarray, np.ndarray], np.ndarray]], pa.RecordBatch],
                       schema: str, chunk_bytes: int = 8 << 20, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Run ``resolve`` on every chunk with a function that gives the corpus counts of its keys.

    ``chunk_bytes`` bounds a chunk's text (a longer document is a chunk of its
    own); more than 2**20 documents never share one.  Words are those of the
    contracts, with A-Z in lower case.  NULL texts are documents without words."""
    spark = docs.sparkSession
    common.python_ready(spark)
    parts = common.shuffle_partitions(spark)
    ranges = 2 * parts

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, list[bytes]]]:
        ids, texts, size, chunk = [], [], 0, 0
        for batch in batches:
            chunk = chunk or batch.column(2)[0].as_py() << SERIAL if batch.num_rows else chunk
            for i, t in zip(batch.column(0).to_pylist(), words.texts_of(batch.column(1))):
                if ids and (size + len(t) > chunk_bytes or len(ids) >> SERIAL):
                    yield chunk, ids, texts
                    ids, texts, size, chunk = [], [], 0, chunk + 1
                ids.append(i)
                texts.append(t)
                size += len(t)
        if ids:
            yield chunk, ids, texts

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, ids, texts in chunks(batches):
            yield _own_row(chunk, ids, texts)
            words.give_back()

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, _, texts in chunks(batches):
            yield _ask_rows(chunk, texts, keys_of, ranges, parts)
            words.give_back()

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: list[tuple[int, int, int, bytes, bytes]] = []
        for batch in batches:
            for i, (dest, chunk, part) in enumerate(zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)))):
                if asked and asked[0][1] != part:
                    yield _answers(asked)
                    asked = []
                asked.append((chunk, part, dest, batch.column(4)[i].as_py(), batch.column(5)[i].as_py()))
        if asked:
            yield _answers(asked)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answers: list[tuple[int, bytes, bytes, bytes]] = []
        for batch in batches:
            for i, (kind, chunk, part) in enumerate(zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)))):
                a, b, c, d = (batch.column(k)[i].as_py() for k in range(4, 8))
                if kind == ASK:
                    answers.append((part, a, b, c))
                    continue
                mine, got = Chunk(chunk, a, b, c, d), answers
                yield resolve(mine, lambda keys, counts: mine.corpus_counts(keys, counts, got, ranges))  # noqa: B023
                answers = []
                words.give_back()

    picked = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    if not _repeats(picked):
        picked = common.staged(picked, "exchange-input")
    picked = picked.withColumn("_part", F.spark_partition_id())  # of the scan, whatever task runs it
    asked = picked.mapInArrow(ask, ROWS).repartitionById(parts, F.col("dest")).sortWithinPartitions("part")
    both = asked.mapInArrow(answer, ROWS).union(picked.mapInArrow(own, ROWS))
    home = F.pmod(F.shiftright("chunk", SERIAL) * 7 + F.col("chunk").bitwiseAND((1 << SERIAL) - 1), F.lit(parts)).cast("int")
    return both.repartitionById(parts, home).sortWithinPartitions("chunk", "kind").mapInArrow(meet, schema)


def _repeats(df: DataFrame) -> bool:
    """Whether each scan gives the same rows in the same partitions and order: files, filtered or projected only."""
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.children().size():
        if plan.children().size() > 1 or plan.nodeName() not in ("Project", "Filter"):
            return False
        plan = plan.children().apply(0)
    return plan.nodeName().startswith("LogicalRelation") or plan.nodeName() == "Relation"
