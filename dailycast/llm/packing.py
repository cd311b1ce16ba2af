"""Best-fit packing of documents into sequences of a fixed number of tokens (operator 10).

Large-item matching: a document above a third of the capacity shares its
sequence with at most one other such document, the largest that fits; smaller
documents then fill the gap, each time the largest that fits.

All pieces of one length are alike to that rule, so it is decided on the table
of counts per length (at most ``capacity`` rows, whatever the input): each round
builds one kind of sequence and repeats it until one of its lengths runs out.
Spark numbers the pieces inside each length, and a piece's number says which
repetition takes it, so no task or driver ever holds the pieces themselves."""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dailycast.llm import common, tokens

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", sequence_id long, offset long"


def token_pieces(docs: DataFrame, capacity: int = 4096, vocabulary: str | None = None,
                 id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per piece: a document's ids and the end id, cut only beyond ``capacity``.

    NULL and empty texts give one piece of the end id alone; a NULL id stays
    NULL; repeated rows give their own pieces; an empty table gives none.  Other
    columns of ``docs`` are not read."""
    common.python_ready(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(tokens.vocabulary(vocabulary))  # one file, 1.7 MB

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(shared.value)
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [])
            for docs, found in tokens.ids_of(batch, encoder):
                for doc, ids in zip(docs, found):
                    for k, at in enumerate(range(0, len(ids), capacity)):
                        part = ids[at:at + capacity].astype("<u4")
                        for out, value in zip(rows, (doc, k, at, len(part), zlib.crc32(part.tobytes()))):
                            out.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds)],
                                             ["doc_id", "piece", "start", "length", "ids_crc32"])

    picked = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return picked.mapInArrow(cut, PIECES)


def plan(counts: dict[int, int], capacity: int) -> dict[int, list[tuple[int, int, int, int]]]:
    """Where the pieces of each length go: runs (first number, how many, first sequence, offset).

    A run gives its pieces to successive sequences at the same offset.  Each
    round uses up at least one length, so there are at most ``capacity`` rounds."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    given = np.zeros(capacity + 1, np.int64)
    runs: dict[int, list[tuple[int, int, int, int]]] = {length: [] for length in counts}
    sequence, third = 0, capacity / 3
    for largest in range(capacity, 0, -1):
        while left[largest]:
            kind, used = [largest], np.zeros(capacity + 1, np.int64)
            used[largest] = 1
            gap = capacity - largest
            if largest > third and gap > third:
                fits = np.flatnonzero((left - used)[:gap + 1] > 0)
                if len(fits) and fits[-1] > third:
                    kind.append(int(fits[-1]))
                    used[fits[-1]] += 1
                    gap -= int(fits[-1])
            while gap:
                most = min(gap, int(third)) if largest > third else gap
                fits = np.flatnonzero((left - used)[:most + 1] > 0)
                if not len(fits):
                    break
                length = int(fits[-1])
                n = min(gap // length, int(left[length] - used[length]))
                kind += [length] * n
                used[length] += n
                gap -= n * length
            taken = np.flatnonzero(used)
            times = int((left[taken] // used[taken]).min())
            at = 0
            for length in kind:
                runs[length].append((int(given[length]), times, sequence, at))
                given[length] += times
                at += length
            left[taken] -= times * used[taken]
            sequence += times
    return runs


def pack(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """``pieces`` (see :func:`token_pieces`) with ``sequence_id`` and ``offset``; lengths 1 to ``capacity``."""
    spark = pieces.sparkSession
    pieces = common.staged(pieces, "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = plan(counts, capacity)
    firsts, total = {}, 0
    for length in sorted(counts):
        firsts[length], total = total, total + counts[length]
    order = [F.col(c) for c in ("length", "doc_id", "piece", "start", "ids_crc32")]
    numbered = common.prefix_sums(pieces, order, {"_number": F.lit(1)}, "pieces-numbered")
    shared = spark.sparkContext.broadcast((runs, firsts))  # bounded by the capacity, not by the input

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, firsts = shared.value
        begins = {length: [r[0] for r in of] for length, of in runs.items()}
        for batch in batches:
            lengths, numbers = batch.column("length").to_pylist(), batch.column("_number").to_pylist()
            sequences, offsets = [], []
            for length, number in zip(lengths, numbers):
                number -= firsts[length]
                first, _, sequence, offset = runs[length][bisect_right(begins[length], number) - 1]
                sequences.append(sequence + number - first)
                offsets.append(offset)
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequences, pa.int64()),
                                              pa.array(offsets, pa.int64())], [*names, "sequence_id", "offset"])

    return numbered.mapInArrow(place, PLACED)


def pack_documents(docs: DataFrame, capacity: int = 4096, vocabulary: str | None = None) -> DataFrame:
    """Pack every document: one row per piece with its place (see :func:`token_pieces` for odd inputs)."""
    return pack(token_pieces(docs, capacity, vocabulary), capacity)
