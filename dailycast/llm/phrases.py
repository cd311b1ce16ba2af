"""Phrase collocations of every language by Toivonen's mining (operator 12).

A phrase of 2 to 4 words can only be frequent if the two phrases one word shorter
inside it are.  Words are counted exactly first.  Then

1. a sample of the documents, at a lowered threshold, proposes pairs of words, and
   with them every longer phrase all of whose pairs it proposes;
2. one pass over all documents counts exactly the proposed phrases and their
   negative border, the other pairs of frequent words;
3. a frequent pair of the border is a failure, as longer phrases with it were not
   counted.  Failures join the proposed pairs and a further pass counts what they
   add, until no pass fails.

Tasks know the proposed phrases by a Bloom filter of bounded size.  A wrong hit
only counts a phrase more; a full filter makes the passes count more, never less.
Counting itself is a DataFrame aggregate over the words' ids.  A chunk of text sends
one row for each first word, with the rest of its distinct phrases and their counts
as lists, so the shuffle moves a first word's id once for all of them; rows of the
few words that make up a large part of the corpus are dealt out by the second word.

A word's id is a 64-bit hash of its language and bytes.  The word table holds the
words themselves; should two of them share an id, all is done again with another
seed.  A phrase is the tuple of its words' ids, so no two phrases are confused."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dailycast.llm import common, words

U = np.uint64
LONGEST = 4
#: Bytes of text counted at a time, and slots (eight bytes each) of a filter at most: 32 MB.
CHUNK, SLOTS = 2 << 20, 1 << 22
#: One in so many documents is in the sample, and the part of the expected count that proposes a pair.
SAMPLE, LOWERED = 8, 0.8
KEY = [f"w{i + 1}" for i in range(LONGEST)]
LISTS = "w1 long, salt int, w2 array<long>, w3 array<long>, w4 array<long>, n array<int>"
#: A word with one in so many of all words is dealt out (there are no more such words), into so many parts.
HOT, PARTS = 4096, 64
WORDS = "id long, lang string, word string, n long"
#: Bytes between words, and bytes that end a piece.
BETWEEN, BREAKS = b"\x20\x09", b".,;:!?\x0a\x0b\x0c\x0d"
_KIND = np.zeros(256, np.uint8)
_KIND[list(BETWEEN)] = 1
_KIND[list(BREAKS)] = 2


def chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[list[str], list[bytes]]]:
    """Batches (lang, text) as lists of about ``size`` bytes of lower-cased text; longer texts are cut where a piece ends."""
    langs: list[str] = []
    texts: list[bytes] = []
    held = 0
    for batch in batches:
        for i in range(batch.num_rows):
            lang, text = batch.column(0)[i].as_py(), (batch.column(1)[i].as_py() or b"").translate(words.UPPER)
            while text:
                cut = len(text)
                if cut > size:
                    cut = max((text.rfind(b, 0, size) for b in (BREAKS[k:k + 1] for k in range(len(BREAKS)))), default=-1) + 1
                    if not cut:  # no piece ends there: up to the end of the first one
                        ends = [at for at in (text.find(BREAKS[k:k + 1], size) for k in range(len(BREAKS))) if at >= 0]
                        cut = min(ends) + 1 if ends else len(text)
                langs.append(lang)
                texts.append(text[:cut])
                held, text = held + cut, text[cut:]
                if held >= size:
                    yield langs, texts
                    langs, texts, held = [], [], 0
    if texts:
        yield langs, texts


@dataclass
class Tokens:
    """The words of a chunk: bytes, places, ids, the number of each one's piece and the index of its text."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    ids: np.ndarray
    piece: np.ndarray
    text: np.ndarray


def tokens(langs: list[str], texts: list[bytes], seed: int) -> Tokens:
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    kind = _KIND[data]
    word = kind == 0
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    if len(word) and word[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]  # the last byte is a break, so every word ends
    piece = np.cumsum(kind == 2, dtype=np.int32)[starts]
    text = np.searchsorted(np.cumsum(sizes), starts, "right")
    own = {x: hashlib.blake2b(x.encode(), digest_size=8, key=seed.to_bytes(8, "little")).digest() for x in set(langs)}
    mark = np.array([int.from_bytes(own[x], "little") for x in langs], U)
    ids = words.mix(words.hash_spans(data, starts, ends, seed) + mark[text])
    ids[ids == 0] = 1  # 0 marks an absent word
    return Tokens(data, starts, ends, ids, piece, text)


def joined_key(key: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """A hash of a phrase from the hash of all its words but the last, and the last one's id."""
    return words.mix(key * U(words.BASE) + ids)


def keys_of(columns: list[np.ndarray]) -> np.ndarray:
    key = columns[0]
    for column in columns[1:]:
        key = joined_key(key, column)
    return key


def places(key: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """Slot of a filter and the four bits in it that stand for a key."""
    spread = words.mix(key ^ U(words.STEP))
    mask = np.zeros(len(key), U)
    for k in range(4):
        mask |= U(1) << ((spread >> U(6 * k)) & U(63))
    return (spread >> U(24)) & U(slots - 1), mask


def held(filter: np.ndarray, key: np.ndarray) -> np.ndarray:
    slot, mask = places(key, len(filter))
    return (filter[slot] & mask) == mask


def key_filter(keys: DataFrame, slots: int | None = None) -> np.ndarray:
    """Bloom filter of ``keys`` (columns ``KEY``, 0: absent).

    About two bytes a key and at most ``SLOTS`` slots, whatever the input; only
    the slots in use, combined by Spark, come to the driver."""
    if slots is None:
        slots = 64
        wanted = keys.count() // 4
        while slots < min(wanted, SLOTS):
            slots *= 2

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, rows = [], _columns(batch)
            for k in range(1, LONGEST + 1):
                own = (rows[k - 1] != 0) & (rows[k] == 0 if k < LONGEST else True)
                found.append(keys_of([c[own] for c in rows[:k]]))
            slot, mask = places(np.concatenate(found), slots)
            yield pa.RecordBatch.from_arrays([pa.array(slot.view(np.int64)), pa.array(mask.view(np.int64))], ["slot", "mask"])

    rows = keys.select(*KEY).mapInArrow(bits, "slot long, mask long").groupBy("slot").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(slots, U)
    out[rows.column("slot").to_numpy()] = rows.column("mask").to_numpy().view(U)
    return out


def _columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [batch.column(i).to_numpy(zero_copy_only=False).view(U) for i in range(LONGEST)]


@dataclass(frozen=True)
class Known:
    """Filters of frequent words and of proposed pairs (None: not known yet), and the ids of the words to deal out."""

    one: np.ndarray
    hot: np.ndarray
    two: np.ndarray | None = None

    def valid(self, t: Tokens) -> list[tuple[np.ndarray, np.ndarray]]:
        """For 2, 3 and 4 words: each place's key, and whether a phrase to count begins there."""
        known = held(self.one, t.ids)
        key, out = t.ids, []
        ok = (t.piece[1:] == t.piece[:-1]) & known[1:] & known[:-1]
        for n in range(2, LONGEST + 1):
            key = joined_key(key[:-1], t.ids[n - 1:])
            out.append((key, ok))
            if self.two is None:
                break
            if n == 2:
                pair = ok.copy()
                pair[ok] = held(self.two, key[ok])
                ok = pair
            ok = ok[1:] & ok[:-1]
        return out


def _tally(t: Tokens, key: np.ndarray, ok: np.ndarray, n: int, hot: np.ndarray) -> pa.RecordBatch:
    """Distinct phrases of ``n`` words that begin at the places ``ok``, with their number, as lists by first word."""
    at = np.flatnonzero(ok)
    at = at[np.argsort(key[at])]
    columns = [t.ids[at + k] for k in range(n)]
    new = _changes(columns)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(at))).astype(np.int32)
    columns = [c[first] for c in columns]
    salt = np.where(np.isin(columns[0], hot), columns[1] % U(PARTS), U(0))
    order = np.argsort(columns[0] + salt * U(words.STEP))
    columns, salt = [c[order] for c in columns], salt[order]
    begin = np.flatnonzero(_changes([columns[0], salt]))
    offsets = pa.array(np.append(begin, len(order)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(c.view(np.int64))) for c in columns[1:]]
    absent = pa.ListArray.from_arrays(pa.array(np.zeros(len(begin) + 1, np.int32)), pa.array(np.zeros(0, np.int64)))
    lists += [absent] * (LONGEST - n) + [pa.ListArray.from_arrays(offsets, pa.array(count[order]))]
    return pa.RecordBatch.from_arrays([pa.array(columns[0][begin].view(np.int64)), pa.array(salt[begin].astype(np.int32)), *lists],
                                      ["w1", "salt", "w2", "w3", "w4", "n"])


def _changes(columns: list[np.ndarray]) -> np.ndarray:
    """Where a row differs from the one before it (the first one does)."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _texts(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string").cast("binary").alias("text")
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text)


def count_phrases(docs: DataFrame, seed: int, known: Known, lengths: tuple[int, ...], before: Known | None = None,
                  chunk: int = CHUNK) -> DataFrame:
    """Exact counts of the phrases of ``lengths`` words that ``known`` lets through, and ``before`` did not."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((known, before))  # at most four filters of at most 32 MB

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, before = shared.value
        for langs, texts in chunks(batches, chunk):
            t = tokens(langs, texts, seed)
            if len(t.ids) > 1:
                done = before.valid(t) if before else []
                for n, (key, ok) in enumerate(known.valid(t), 2):
                    if n in lengths and len(ok):
                        yield _tally(t, key, ok & ~done[n - 2][1] if before else ok, n, known.hot)
            words.give_back()

    rows = _texts(docs).mapInArrow(count, LISTS).repartition("w1", "salt")
    rows = rows.select("w1", "salt", F.inline(F.arrays_zip("w2", "w3", "w4", "n")))
    rows = rows.withColumns({k: F.coalesce(k, F.lit(0).cast("long")) for k in KEY[2:]})  # lists of absent words are empty
    return rows.groupBy("w1", "salt", *KEY[1:]).agg(F.sum("n").alias("n")).drop("salt")  # no further shuffle


def count_words(docs: DataFrame, seed: int, chunk: int = CHUNK) -> DataFrame:
    """id, lang, word, n: every word of every language with its exact count."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, texts in chunks(batches, chunk):
            t = tokens(langs, texts, seed)
            ids, first, which, n = np.unique(t.ids, return_index=True, return_inverse=True, return_counts=True)
            lang = np.array(langs, object)[t.text] if len(t.ids) else np.empty(0, object)
            rep = first[which]
            odd = ~words.same_spans(t.data, t.starts, t.ends, t.data, t.starts[rep], t.ends[rep]) | (lang != lang[rep])
            np.subtract.at(n, which[odd], 1)
            at = np.concatenate([first, np.flatnonzero(odd)])  # words that share an id are told apart later
            raw = t.data.tobytes()
            word = [raw[s:e].decode("utf-8", "replace") for s, e in zip(t.starts[at], t.ends[at])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(t.ids[at].view(np.int64)), pa.array(lang[at].tolist(), pa.string()), pa.array(word, pa.string()),
                 pa.array(np.concatenate([n, np.ones(int(odd.sum()), n.dtype)]).astype(np.int64))], ["id", "lang", "word", "n"])
            words.give_back()

    return _texts(docs).mapInArrow(count, WORDS).groupBy("id", "lang", "word").agg(F.sum("n").alias("n"))


def exact_words(docs: DataFrame, chunk: int = CHUNK) -> tuple[DataFrame, int]:
    """The word table, and the first seed with which no two words share an id."""
    for seed in range(64):
        table = common.staged(count_words(docs, seed, chunk), "phrase-words")
        if not table.groupBy("id").count().where("count > 1").take(1):
            return table, seed
    raise ValueError("64 seeds gave words with equal ids")


def _as_keys(ids: Column) -> list[Column]:
    return [ids.alias("w1"), *(F.lit(0).cast("long").alias(k) for k in KEY[1:])]


def _not_held(rows: DataFrame, known: Known) -> DataFrame:
    """Pairs that are not in the filter of proposed ones: failures of the border."""
    shared = rows.sparkSession.sparkContext.broadcast(known.two)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(~held(shared.value, keys_of(_columns(batch)[:2]))))

    pairs = rows.where(F.col(KEY[2]) == 0).select(*KEY)
    return pairs.mapInArrow(keep, ", ".join(f"{k} long" for k in KEY))


def frequent_phrases(docs: DataFrame, min_count: int = 30, sample: int = SAMPLE, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """Exact counts of all phrases of 2 to 4 words that occur ``min_count`` times or more in their language.

    Returns (phrases: ``KEY``, n; words: id, lang, word, n of all words)."""
    common.python_ready(docs.sparkSession)
    table, seed = exact_words(docs, chunk)
    single = table.where(F.col("n") >= min_count).select(*_as_keys(F.col("id")))
    total = table.agg(F.sum("n")).first()[0] or 0
    hot = table.where(F.col("n") * HOT >= total).select("id").toArrow()  # at most HOT rows
    known = Known(key_filter(single), hot.column("id").to_numpy().view(U))

    some = docs.where(F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(sample)) == 0)
    low = max(2, round(min_count / sample * LOWERED)) if sample > 1 else min_count
    pairs = common.staged(count_phrases(some, seed, known, (2,), chunk=chunk).where(F.col("n") >= low), "phrase-proposed")
    known = replace(known, two=key_filter(pairs))
    new = common.staged(count_phrases(docs, seed, known, (2, 3, 4), chunk=chunk).where(F.col("n") >= min_count), "phrase-counts")
    found = new
    while True:
        failures = key_filter(_not_held(new, known), len(known.two))
        if not failures.any():
            return found, table
        more = replace(known, two=known.two | failures)
        new = common.staged(count_phrases(docs, seed, more, (3, 4), known, chunk).where(F.col("n") >= min_count), "phrase-counts")
        found, known = found.unionByName(new), more


def _part(*names: str) -> Column:
    return F.struct(*(F.col(names[i]).alias(f"p{i + 1}") if i < len(names) else F.lit(0).cast("long").alias(f"p{i + 1}")
                      for i in range(LONGEST - 1)))


def _spans(of: int, sizes: range) -> list[tuple[str, ...]]:
    return [tuple(KEY[i:i + n]) for n in sizes for i in range(of - n + 1)]


def scored(phrases: DataFrame, table: DataFrame, min_count: int = 30) -> DataFrame:
    """``phrases`` with the l, r and score of their lowest-scoring cut, without those that a longer one covers."""
    length = F.when(F.col("w3") == 0, 2).when(F.col("w4") == 0, 3).otherwise(4)
    rows = phrases.select(*KEY, F.col("n").alias("a"), length.alias("len"))
    single = table.where(F.col("n") >= min_count).select(F.col("id").alias("p1"), F.lit(0).cast("long").alias("p2"),
                                                         F.lit(0).cast("long").alias("p3"), F.col("n").alias("f"))
    parts = single.unionByName(rows.where("len < 4").select(*(F.col(k).alias(f"p{i + 1}") for i, k in enumerate(KEY[:-1])), F.col("a").alias("f")))

    def cuts(n: int) -> Column:
        return F.array(*(F.struct(F.lit(k).alias("cut"), _part(*KEY[:k]).alias("left"), _part(*KEY[k:n]).alias("right")) for k in range(1, n)))

    opened = rows.select("*", F.explode(F.when(F.col("len") == 2, cuts(2)).when(F.col("len") == 3, cuts(3)).otherwise(cuts(4))).alias("c"))
    opened = opened.select(*KEY, "a", "c.cut", *(F.col(f"c.{s}.p{i}").alias(f"{s}{i}") for s in ("left", "right") for i in (1, 2, 3)))
    for side, name in (("left", "l"), ("right", "r")):
        own = parts.select(*(F.col(f"p{i}").alias(f"{side}{i}") for i in (1, 2, 3)), F.col("f").alias(name))
        opened = opened.join(own, [f"{side}{i}" for i in (1, 2, 3)])
    score = F.expr("cast((2000000 * cast(a as decimal(20, 0))) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0))) as long)")
    least = opened.groupBy(*KEY, "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("m"))

    def inside(n: int) -> Column:
        zero = F.lit(0).cast("long")
        return F.array(*(F.struct(*(F.col(s[i]).alias(k) if i < len(s) else zero.alias(k) for i, k in enumerate(KEY)))
                         for s in _spans(n, range(2, n))))

    longer = rows.where("len > 2").select("a", F.explode(F.when(F.col("len") == 3, inside(3)).otherwise(inside(4))).alias("s"))
    longer = longer.groupBy(*(F.col(f"s.{k}").alias(k) for k in KEY)).agg(F.max("a").alias("longer"))
    wide = "cast({} as decimal(20, 0)) * {}"
    covered = F.expr(f"{wide.format('longer', 100)} >= {wide.format('a', 80)}")
    kept = least.join(longer, KEY, "left").where(F.col("longer").isNull() | ~covered)
    return kept.select(*KEY, "a", F.col("m.l").alias("l"), F.col("m.r").alias("r"), F.col("m.score").alias("score"))


def collocations(docs: DataFrame, min_count: int = 30, top: int = 2000, sample: int = SAMPLE, chunk: int = CHUNK) -> DataFrame:
    """Each language's first ``top`` phrases: lang, rank, phrase, a, l, r, n, score.

    A NULL text is empty, a NULL language is ``und``; repeated rows count each
    time; equal scores follow each other by a, then by the phrase's bytes; texts
    without words and an empty table give no rows.  Other columns than doc_id,
    lang and text are not read."""
    phrases, table = frequent_phrases(docs, min_count, sample, chunk)
    rows = scored(phrases, table, min_count)
    names = table.where(F.col("n") >= min_count).select("id", "lang", "word")
    for i, k in enumerate(KEY):
        own = names.select(F.col("id").alias(k), F.col("word").alias(f"t{i}"), *([F.col("lang")] if i == 0 else []))
        rows = rows.join(own, k, "inner" if i < 2 else "left")
    totals = table.groupBy("lang").agg(F.sum("n").alias("n"))
    rows = rows.withColumn("phrase", F.concat_ws(" ", *(f"t{i}" for i in range(LONGEST))))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
