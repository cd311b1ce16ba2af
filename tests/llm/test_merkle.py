"""Merkle manifest against a plain Python tree."""

import hashlib
import random
import zlib

import pytest

from helpers_llm import docs  # noqa: F401

from dailycast.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, id long, run long, digest string"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tampered(row):
    i, *rest, text = row
    if i is None or text is None or zlib.crc32(str(i).encode()) % 3:
        return row
    return (i, *rest, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))


def grow(nodes):
    """All levels of the tree over the nodes, the last one a single node."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i:i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def brute(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    own = {x: sorted((r for r in rows if r[2] == x), key=lambda r: (r[0] is not None, r[0] or 0, bytes.fromhex(leaf(r)))) for x in langs}
    trees = {x: grow([leaf(r) for r in own[x]]) for x in langs}
    top = grow([trees[x][-1][0] for x in langs])
    root, out = top[-1][0], []
    for k, x in enumerate(langs):
        for i, r in enumerate(own[x]):
            proof, folded = [], leaf(tampered(r))
            for levels, at in ((trees[x], i), (top, k)):
                for level in levels[:-1]:
                    run = level[at // 8 * 8:at // 8 * 8 + 8]
                    left, right = run[:at % 8], run[at % 8 + 1:]
                    proof += left + right
                    folded = h("".join([*left, folded, *right]))
                    at //= 8
            out.append((r[0], leaf(r), trees[x][-1][0], root, h("".join(proof)), folded, folded == root))
    return sorted(map(str, out))


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA)


def run(spark, rows):
    return sorted(str(tuple(r)) for r in merkle.manifest_table(table(spark, rows)).collect())


def some(n, langs, seed=0):
    rng = random.Random(seed)
    words = ["The", "cat", "SAT", "é", "日本", "lower"]
    return [(rng.randrange(10 * n), rng.choice(["web", None, "Über"]), rng.choice(langs), rng.choice([None, 5]),
             rng.choice([None, "", " ".join(rng.choice(words) for _ in range(rng.randrange(9)))])) for _ in range(n)]


@pytest.mark.parametrize("n, langs", [(1, ["en"]), (2, ["en", None]), (9, ["en"]), (120, [None, "en", "é", "z"])])
def test_brute_force(spark, n, langs):
    rows = some(n, langs, n)
    assert run(spark, rows) == brute(rows)


def test_many_languages_and_a_lone_leaf_each(spark):
    rows = some(80, [f"l{i}" for i in range(70)])
    assert run(spark, rows) == brute(rows)


def test_ties_null_ids_and_repeated_rows(spark):
    rows = some(30, ["en", "de"], 4)
    rows += rows[:5] + [(None, None, None, None, None)] * 9 + [(rows[0][0], "s", "en", 1, f"Other {i}") for i in range(9)]
    rows += [(1, "s", "en", 3, "VERY Long " * 20000)]
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    got = merkle.manifest_table(table(spark, []))
    assert got.count() == 0 and got.columns[-1] == "verified"


def test_a_recursive_query_over_a_million_rows_is_allowed_only_inside(spark):
    key = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(key, None)
    with merkle._any_number_of_rows(spark):
        assert spark.conf.get(key) == "-1"
    assert spark.conf.get(key, None) == before


def test_node_rows_are_linked(spark):
    made = merkle.build(table(spark, some(100, ["en", "de"])))
    nodes = {r.id: r for r in made.nodes.collect()}
    for r in nodes.values():
        if r.parent is None:
            assert bytes(r.digest) == made.root
        else:
            children = bytes(nodes[r.parent].children)
            assert children[32 * r.pos:32 * r.pos + 32] == bytes(r.digest)
