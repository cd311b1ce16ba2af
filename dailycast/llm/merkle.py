"""Merkle manifest of a documents table, proved leaf by leaf (operator 11).

Every row is a leaf: the SHA-256 of its fields.  Per language the leaves, in order
of doc_id, form runs of eight; the digest of a run is a node of the next level,
until one node, the subroot, is left.  The subroots, in order of language, form
one more such tree above them; its last node is the root.

* Places come from a range sort by (language, doc_id, leaf): each partition numbers
  its own rows, and a table with one row per (partition, language) carries the
  offsets, so a hot language spreads over many partitions.
* Built levels are stored as node rows: a run's id, the id of the run above that
  holds its digest, its place there, and its children's digests.
* The climb is a Spark recursive query: from every leaf a row per level, which
  appends the run whose other children are the siblings, and folds the (tampered)
  digest with them.  Each step joins the rows on the run with the node rows, one
  for eight rows of the level below.

A node's id is the place of its first leaf times 64 plus its level; levels of the
upper tree begin at 32, and its places are those of the subroots."""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dailycast.llm import common
from dailycast.session import scratch_path

#: Fields of a leaf, children of a node, first level of the tree above the subroots.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
RUN, UPPER = 8, 32
UPPERCASE, LOWERCASE = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NODE = "id long, parent long, pos int, children binary, digest binary"
RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"

CLIMB = """
WITH RECURSIVE climb (place, step, run, pos, folded) AS (
  SELECT place, 0, run, pos, start FROM {leaves}
  UNION ALL
  SELECT c.place, c.step + 1, n.parent, n.pos,
         unhex(sha2(concat(lower(hex(substring(n.children, 1, 32 * c.pos))), lower(hex(c.folded)),
                           lower(hex(substring(n.children, 32 * c.pos + 33)))), 256))
  FROM climb c JOIN {nodes} n ON c.run = n.id)
SELECT place, step, run, pos, CASE WHEN run IS NULL THEN folded END AS folded FROM climb
"""


@dataclass
class Manifest:
    """``leaves``: place, doc_id, leaf, start, run, pos; ``nodes``: see ``NODE``; ``root``: None for an empty table."""

    leaves: DataFrame
    nodes: DataFrame
    root: bytes | None


def text_of(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def leaf_digest(fields: list[Column]) -> Column:
    """SHA-256 of the fields in turn: ``-`` for NULL, else byte count, colon and value."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
             for c in fields]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def tampered_text(doc_id: Column, text: Column) -> Column:
    """The text with A-Z lower-cased where three divides the id's crc32; a NULL id is not tampered with."""
    hit = F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0
    return F.when(F.coalesce(hit, F.lit(False)), F.translate(text, UPPERCASE, LOWERCASE)).otherwise(text)


def _placed(leaves: DataFrame) -> tuple[DataFrame, int, int]:
    """``leaves`` with place, base, total and rank of their language; the largest total; the number of languages."""
    keys = ["lang", "doc_id", "leaf"]
    ordered = leaves.repartitionByRange(common.shuffle_partitions(leaves.sparkSession), *keys).sortWithinPartitions(*keys)
    parts = common.staged(ordered.withColumn("at", F.monotonically_increasing_id()), "merkle-leaves")
    parts = parts.withColumn("part", F.shiftright("at", 33))
    counts = parts.groupBy("part", "lang").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    counts = common.staged(counts, "merkle-counts")  # a row for each partition and each change of language in it
    langs = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    langs = common.staged(common.prefix_sums(langs, [F.col("lang")], {"rank": F.lit(1), "base": F.col("total")}, "merkle-ranks"),
                          "merkle-langs")
    most = langs.agg(F.max("total").alias("total"), F.count("*").alias("n")).first()
    before = Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    offsets = counts.join(langs.withColumnRenamed("lang", "_lang"), F.col("lang").eqNullSafe(F.col("_lang")))
    offsets = offsets.select(F.col("part").alias("_part"), F.col("lang").alias("_lang"), "first", "before", "total", "rank", "base")
    placed = parts.join(offsets, (F.col("part") == F.col("_part")) & F.col("lang").eqNullSafe(F.col("_lang")))
    place = F.col("base") + F.col("before") + F.col("at") - F.col("first")
    return placed.withColumn("place", place), most["total"] or 0, most["n"]


def _linked(rows: DataFrame, level: int, trees: int, fan: int) -> DataFrame:
    """Rows of one level (base, rank, idx, size) with the run above that holds them, and their place in it.

    The last node of a language's tree belongs to the upper tree, unless there is one language only."""
    up = level + 1
    inside = F.shiftleft(F.col("base") + F.expr(f"idx div {fan}") * F.lit(fan ** (up % UPPER)), 6) + F.lit(up)
    above = F.shiftleft(F.expr(f"rank div {fan}") * fan, 6) + F.lit(UPPER + 1)
    many = F.lit(trees > 1 and level < UPPER)
    return rows.withColumns({
        "run": F.when(F.col("size") > 1, inside).when(many, above).cast("long"),
        "pos": F.when(F.col("size") > 1, F.col("idx") % fan).when(many, F.col("rank") % fan).cast("int")})


def _runs(rows: DataFrame, level: int, trees: int, fan: int) -> DataFrame:
    """The next level's nodes over rows (base, rank, idx, size, digest) of one level."""
    children = F.expr("aggregate(array_sort(collect_list(struct(idx, digest))), cast('' as binary), (a, x) -> concat(a, x.digest))")
    grouped = (rows.where("size > 1").groupBy("base", "rank", F.expr(f"idx div {fan}").alias("_idx"), "size")
               .agg(children.alias("children")).withColumnRenamed("_idx", "idx").withColumn("size", F.expr(f"(size + {fan - 1}) div {fan}")))
    at = F.shiftleft(F.col("base") + F.col("idx") * F.lit(fan ** ((level + 1) % UPPER)), 6) + F.lit(level + 1)
    digest = F.unhex(F.sha2(text_of(F.col("children")), 256))
    return _linked(grouped.withColumns({"id": at.cast("long"), "digest": digest}), level + 1, trees, fan)


def build(docs: DataFrame, fan: int = RUN) -> Manifest:
    """Leaves and stored node rows of ``docs`` (columns ``FIELDS``; others are not read).

    NULL fields count as such; rows of one language and id follow each other by
    their leaf, so repeated rows (equal leaves) may change places without effect;
    a NULL id comes first.  An empty table has no leaves, nodes or root; one row is
    its own subroot and root."""
    spark = docs.sparkSession
    doc_id, text = F.col("doc_id"), F.col("text").cast("string")
    plain = [F.col(c) for c in FIELDS]
    leaf = leaf_digest(plain).alias("leaf")
    changed = tampered_text(doc_id, text)
    rows = docs.select(doc_id.cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), leaf,
                       F.when(~changed.eqNullSafe(text), leaf_digest([*plain[:-1], changed])).alias("changed"))
    placed, most, trees = _placed(common.staged(rows, "merkle-digests"))
    leaves = placed.select("place", "doc_id", "leaf", F.coalesce("changed", "leaf").alias("start"), "base", "rank",
                           (F.col("place") - F.col("base")).alias("idx"), F.col("total").alias("size"))
    leaves = common.staged(_linked(leaves, 0, trees, fan), "merkle-places")
    path = scratch_path(spark, "merkle-nodes")

    def levels(rows: DataFrame, level: int, size: int) -> list[DataFrame]:
        """Write the levels above ``rows``; all levels' last nodes."""
        last = [rows.where("size = 1")]
        while size > 1:
            rows = _runs(rows, level, trees, fan).withColumnRenamed("run", "parent")
            level, size = level + 1, -(-size // fan)
            rows.write.parquet(f"{path}/level={level}")
            rows = spark.read.schema(rows.schema).parquet(f"{path}/level={level}")
            last.append(rows.where("size = 1"))
        return last

    roots = levels(leaves.select("base", "rank", "idx", "size", F.col("leaf").alias("digest")), 0, most)
    top = roots[0].select("rank", "digest")
    for more in roots[1:]:
        top = top.unionByName(more.select("rank", "digest"))
    if trees > 1:
        top = top.select(F.lit(0).cast("long").alias("base"), F.lit(0).cast("long").alias("rank"), F.col("rank").alias("idx"),
                         F.lit(trees).cast("long").alias("size"), "digest")
        top = levels(common.staged(top, "merkle-subroots"), UPPER, trees)[-1]
    found = top.select("digest").first()
    nodes = spark.read.schema(NODE).parquet(path) if most > 1 or trees > 1 else spark.createDataFrame([], NODE)
    return Manifest(leaves.select("place", "doc_id", "leaf", "start", "run", "pos"),
                    nodes.select("id", "parent", "pos", "children", "digest"), bytes(found["digest"]) if found else None)


@contextmanager
def _any_number_of_rows(spark: SparkSession):
    """Spark stops a recursive query at a million rows unless told otherwise; ours returns a few per leaf."""
    key = "spark.sql.cteRecursionRowLimit"
    old = spark.conf.get(key, None)
    spark.conf.set(key, "-1")
    try:
        yield
    finally:
        spark.conf.set(key, old) if old is not None else spark.conf.unset(key)


def climb(manifest: Manifest) -> DataFrame:
    """place, step, run, pos, folded: a row per leaf and level; the last one (run NULL) has the folded root."""
    spark = manifest.leaves.sparkSession
    with _any_number_of_rows(spark):
        steps = spark.sql(CLIMB, leaves=manifest.leaves.select("place", "run", "pos", "start"),
                          nodes=manifest.nodes.select("id", "parent", "pos", "children"))
        return common.staged(steps, "merkle-climb")


def proofs(manifest: Manifest, steps: DataFrame) -> DataFrame:
    """Per leaf: place, doc_id, leaf, siblings (array of the levels' joined digests), subroot, folded, from its steps.

    ``subroot`` is NULL where the table has one language only: it is the root."""
    at = F.col("pos") * 32
    runs = manifest.nodes.select(F.col("id").alias("run"), "children")
    held = steps.join(runs, "run", "left").select(
        "place", "step", "folded",
        F.concat(F.expr("substring(children, 1, 32 * pos)"), F.expr("substring(children, 32 * pos + 33)")).alias("siblings"),
        F.when(F.col("run").bitwiseAND(F.lit(63)) == UPPER + 1, F.expr("substring(children, 32 * pos + 1, 32)")).alias("subroot"))
    # the leaf's own row joins the same grouping: no second shuffle of the siblings
    rows = held.unionByName(manifest.leaves.select("place", "doc_id", "leaf"), allowMissingColumns=True)
    listed = F.array_sort(F.collect_list(F.when(F.col("siblings").isNotNull(), F.struct("step", "siblings"))))
    return rows.groupBy("place").agg(F.max("doc_id").alias("doc_id"), F.max("leaf").alias("leaf"),
                                     listed.getField("siblings").alias("siblings"), F.max("subroot").alias("subroot"),
                                     F.max("folded").alias("folded"))


def manifest_table(docs: DataFrame) -> DataFrame:
    """Every row's leaf, subroot, root, proof digest and the root folded from its tampered text (see :func:`build`)."""
    manifest = build(docs)
    if manifest.root is None:
        return docs.sparkSession.createDataFrame([], RESULT)
    root = F.lit(manifest.root.hex())
    rows = proofs(manifest, climb(manifest))
    proof = F.array_join(F.transform("siblings", text_of), "")
    return rows.select("doc_id", text_of(F.col("leaf")).alias("leaf"),
                       F.coalesce(text_of(F.col("subroot")), root).alias("subroot"), root.alias("root"),
                       F.sha2(proof, 256).alias("proof_sha256"), text_of(F.col("folded")).alias("folded_root"),
                       (text_of(F.col("folded")) == root).alias("verified"))
