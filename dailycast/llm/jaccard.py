"""N-gram Jaccard join of all documents (operator 1).

1. Document counts of all shingles (``exchange``).  A shingle that one document
   alone holds links nothing, so a document in which too few shingles are shared
   leaves here; for the others the rare-first prefix holds shared shingles only
   from the place where the unshared ones end.
2. Documents with equal sets become one class; the join runs over classes.
3. Prefix n-grams pair classes, under the length and positional filters.  First
   each class meets one leader only (among those it shares a prefix n-gram with,
   the one with the fewest shingles of its own, which tends to be the original),
   so a group of near copies costs one comparison per member.  Then every pair
   that shares a prefix n-gram and is not yet in one component is compared.
   A pair that earlier links connect already would not change any component.
4. Each pair is verified once: suffix filter, then the exact intersection."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dailycast.llm import common, exchange, graph, words

SETS = "rid long, doc_id long, n long, sig binary, shared binary, prefix binary, alone int"
#: Quantiles of one set at which the suffix filter compares two sets' parts.
SUFFIX_PARTS = 8
#: Rounds in which a class meets one leader.
LEADER_ROUNDS = 2


def overlap_needed(a, b, percent: int):
    """Least intersection with which sets of sizes a and b reach the similarity (integer arithmetic)."""
    return -(-(percent * (a + b)) // (100 + percent))


def shingle_sets(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """Per document: set size, signature of the set, and what the join needs of it (else NULL)."""

    def doc_sets(h: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
        g, at = words.grams(h, first, n, whole_short=True)
        return [np.unique(g[s:e]) for s, e in zip(at[:-1], at[1:])]

    def keys_of(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(np.concatenate([np.empty(0, np.uint64), *doc_sets(h, first)]), return_counts=True)

    def resolve(chunk: exchange.Chunk, counts_of) -> pa.RecordBatch:
        sets = doc_sets(chunk.words, chunk.first)
        keys, which, own = np.unique(np.concatenate([np.empty(0, np.uint64), *sets]), return_inverse=True, return_counts=True)
        frequency = counts_of(keys, own)[which]
        rows, seen, at = [], set(), 0
        for i, (doc, s) in enumerate(zip(chunk.ids, sets)):
            df = frequency[at:at + len(s)]
            at += len(s)
            sig = hashlib.blake2b(s.astype("<u8").tobytes(), digest_size=16).digest() if len(s) else None
            needed = -(-percent * len(s) // 100)
            held = df > 1
            row = [(chunk.number << 22) + i, doc, len(s), sig, None, None, None]
            if len(s) and sig not in seen and int(held.sum()) >= needed:
                seen.add(sig)
                shared = s[held]
                alone = len(s) - len(shared)
                order = np.lexsort((shared, df[held]))[:len(s) - needed + 1 - alone]
                row[4:] = [shared.astype("<u8").tobytes(), shared[order].astype("<u8").tobytes(), alone]
            rows.append(row)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int32()]
        names = [c.split()[0] for c in SETS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    return exchange.with_corpus_counts(docs, keys_of, resolve, SETS)


def _prefixes(nodes: DataFrame) -> DataFrame:
    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid, n, alone = (batch.column(c).to_numpy() for c in ("rid", "n", "alone"))
            grams = [np.frombuffer(p, "<i8") for p in batch.column("prefix").to_pylist()]
            size = np.asarray([len(g) for g in grams], np.int64)
            at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(alone, size)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([np.empty(0, "<i8"), *grams])), pa.array(np.repeat(rid, size)), pa.array(np.repeat(n, size)),
                 pa.array(at.astype(np.int64)), pa.array(np.repeat(alone / n, size))], ["gram", "rid", "n", "at", "own"])

    return nodes.select("rid", "n", "alone", "prefix").mapInArrow(explode, "gram long, rid long, n long, at long, own double")


def _may_link(n_a: Column, at_a: Column, n_b: Column, at_b: Column, percent: int) -> Column:
    """Length and positional filters for a pair whose first common prefix n-gram lies at these places."""
    small, large = F.least(n_a, n_b), F.greatest(n_a, n_b)
    return (100 * small >= percent * large) & (
        (100 + percent) * F.least(n_a - at_a, n_b - at_b) >= percent * (n_a + n_b))


def _verified(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes that reach the similarity."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            columns = (batch.column(c).to_pylist() for c in ("n_a", "n_b", "shared_a", "shared_b"))
            for n_a, n_b, x, y in zip(*columns):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                needed = overlap_needed(n_a, n_b, percent)
                keep.append(_suffix_allows(x, y, needed) and _common(x, y) >= needed)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(mask) for c in ("a", "b")], ["a", "b"])

    side = [nodes.select(F.col("rid").alias(c), F.col("n").alias(f"n_{c}"), F.col("shared").alias(f"shared_{c}")) for c in "ab"]
    return pairs.join(side[1], "b").join(side[0], "a").mapInArrow(check, "a long, b long")


def _suffix_allows(x: np.ndarray, y: np.ndarray, needed: int) -> bool:
    """Suffix filter: parts of the two sorted sets between the same values differ at least by their sizes."""
    cut = x[np.linspace(0, len(x) - 1, SUFFIX_PARTS + 1).astype(int)]
    parts = [np.diff(np.concatenate([[0], np.searchsorted(s, cut), [len(s)]])) for s in (x, y)]
    return int(np.minimum(*parts).sum()) >= needed


def _common(x: np.ndarray, y: np.ndarray) -> int:
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum())


def jaccard_links(docs: DataFrame, n: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """Sets of all documents (see ``SETS``), and verified links (a, b) between set classes.

    A class goes by the smallest ``rid`` of its documents.  The links join every
    two similar classes into one component; they leave out pairs that other
    links already connect."""
    sets = common.staged(shingle_sets(docs, n, percent), "jaccard-sets")
    carriers = sets.where("shared is not null")
    first = carriers.groupBy("sig").agg(F.min("rid").alias("rid")).select("rid")
    nodes = common.staged(carriers.join(first, "rid", "left_semi"), "jaccard-nodes")
    entries = common.staged(_prefixes(nodes), "jaccard-prefixes")
    links = None
    for turn in range(LEADER_ROUNDS):
        open_entries = entries if links is None else _across(entries, graph.components(links))
        rank = F.struct("own", "rid", "n", "at") if turn == 0 else F.struct(F.xxhash64("rid").alias("own"), "rid", "n", "at")
        leaders = open_entries.groupBy("gram").agg(F.min(rank).alias("lead"), F.count("*").alias("k")).where("k > 1")
        met = open_entries.join(leaders, "gram").where(
            (F.col("rid") != F.col("lead.rid")) & _may_link(F.col("n"), F.col("at"), F.col("lead.n"), F.col("lead.at"), percent))
        pairs = met.groupBy("rid").agg(F.min(F.struct("lead.own", "lead.rid")).alias("lead"))
        found = _verified(pairs.select(F.col("lead.rid").alias("a"), F.col("rid").alias("b")), nodes, percent)
        links = common.staged(found if links is None else links.union(found), "jaccard-links")
    left = _across(entries, graph.components(links)).select("gram", "rid", "n", "at", "component")
    other = left.select("gram", *(F.col(c).alias(f"{c}_b") for c in ("rid", "n", "at", "component")))
    pairs = left.join(other, "gram").where((F.col("rid") < F.col("rid_b")) & (F.col("component") != F.col("component_b"))
                                           & _may_link(F.col("n"), F.col("at"), F.col("n_b"), F.col("at_b"), percent))
    pairs = pairs.groupBy(F.col("rid").alias("a"), F.col("rid_b").alias("b")).agg(F.lit(1)).select("a", "b")
    return sets, common.staged(links.union(_verified(pairs, nodes, percent)), "jaccard-links")


def _across(entries: DataFrame, found: DataFrame) -> DataFrame:
    """Prefix entries, with their component, of those n-grams that more than one component holds."""
    marked = entries.drop("component").join(found.withColumnRenamed("node", "rid"), "rid", "left")
    marked = marked.withColumn("component", F.coalesce("component", "rid"))
    several = marked.groupBy("gram").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    return marked.join(several.where("low <> high").select("gram"), "gram", "left_semi")


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links).

    Words are runs of anything but ASCII white space, with A-Z in lower case; a
    document's set holds its distinct n-word shingles, or with fewer words its
    whole sequence.  Two documents link if 100 * intersection >= percent * union.
    Without words (NULL, empty, white space) the set is empty and links nothing.
    Repeated rows link with each other.  A NULL doc_id takes part, but only gives
    a component's id if no other is there (then NULL).  Other columns are not
    read; an empty table gives no rows.  Shingles are told apart by 64-bit hashes."""
    sets, links = jaccard_links(docs, n, percent)
    found = graph.components(links).withColumnRenamed("node", "rid")
    classes = (sets.where("sig is not null").groupBy("sig")
               .agg(F.min("rid").alias("class_rid"), F.min(F.when(F.col("shared").isNotNull(), F.col("rid"))).alias("rid"),
                    F.min("doc_id").alias("least"), F.count("*").alias("k")))
    classes = classes.join(found, "rid", "left").withColumn("component", F.coalesce("component", "class_rid"))
    least = classes.groupBy("component").agg(F.min("least").alias("component_id"), F.sum("k").alias("k")).where("k > 1")
    named = classes.join(least.drop("k"), "component").select("sig", "component_id")
    both = sets.select("sig", "doc_id", "n").join(named.withColumn("_linked", F.lit(True)), "sig", "left")
    return both.select("doc_id", F.col("n").alias("n_shingles"),
                       F.when(F.col("_linked"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_per_group(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id (NULL last), then the first row written.

    Each row goes by a key of its own, so repeated rows and NULL ids count as documents."""
    rows = common.staged(docs.withColumn("_row", F.monotonically_increasing_id()), "jaccard-rows")
    found = jaccard_components(rows.select(F.col("_row").alias("doc_id"), "text"), n, percent)
    found = found.select(F.col("doc_id").alias("_row"), "component_id")
    id_ = F.col("doc_id").cast("long")
    own = found.join(rows.select("_row", "doc_id"), "_row").groupBy("component_id").agg(
        F.min(F.struct(id_.isNull().alias("null"), id_.alias("id"), F.col("_row").alias("row"))).alias("first"))
    return rows.join(own.select(F.col("first.row").alias("_row")), "_row", "left_semi").select(*docs.columns)
