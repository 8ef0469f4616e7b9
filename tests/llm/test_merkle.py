import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import merkle

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, tree int, pos string"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf_of(row, text):
    doc_id, _, lang, source, n_chars = row[:5]
    return h("".join(map(field, (doc_id, source, lang, n_chars, text))))


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i : i + 3])) for i in range(0, len(out[-1]), 3)])
    return out


def way(levels, at):
    for below in levels[:-1]:
        first = at // 3 * 3
        yield "".join(below[first:at]), "".join(below[at + 1 : first + 3])
        at //= 3


def plain(rows):
    """(doc_id, leaf, subroot, root, proof, folded root) of all rows, computed in memory."""
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    ordered = {s: sorted((r for r in rows if r[3] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r, r[1]))) for s in sources}
    trees = {s: levels_of([leaf_of(r, r[1]) for r in ordered[s]]) for s in sources}
    top = levels_of([trees[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for at, r in enumerate(ordered[s]):
            siblings = [*way(trees[s], at), *way(top, k)]
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None
            node = leaf_of(r, r[1].replace("\n", "") if changed else r[1])
            for left, right in siblings:
                node = h(left + node + right)
            out.append((r[0], leaf_of(r, r[1]), trees[s][-1][0], top[-1][0], "".join(a + b for a, b in siblings), node))
    return sorted(out, key=repr)


def found(df, block_levels=6):
    rows = merkle.manifest(df, F.replace("text", F.lit("\n"), F.lit("")), F.crc32(F.col("doc_id").cast("string")) % 2 == 0, block_levels)
    return sorted(map(tuple, rows.select("doc_id", "leaf", "subroot", "root", merkle.proof(F.col("lefts"), F.col("rights")), "folded_root").collect()), key=repr)


@pytest.mark.parametrize("block_levels", [1, 2, 6])
def test_same_as_in_memory(spark, block_levels):
    rows = [(i, f"text\n{i}" * (i % 3), "en", None if i % 7 == 0 else f"s{i % 7}" if i % 3 else "hot", i, 1, "x") for i in range(120)]
    rows += [(None, None, None, None, None, 1, "x"), (None, "no id\n", None, "é", None, 1, "x"), (5, "a\nb", "en", "alone", 3, 1, "x"), *rows[:4], *rows[:4]]
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    assert found(df, block_levels) == plain(rows)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 27, 28])
def test_sizes_around_powers(spark, n):
    rows = [(i, "a\nb", "en", "s", 3, 0, "") for i in range(n)]
    assert found(spark.createDataFrame(rows, DOCS), 2) == plain(rows)


def test_empty_table(spark):
    assert found(spark.createDataFrame([], DOCS)) == []


def test_a_version_copies_its_ancestors_only():
    nodes = merkle.grown([h(str(i)) for i in range(25)], 3)
    before = [list(level) for level in nodes]
    copied = merkle.version(nodes, 13, h("other"))
    assert sorted(copied) == [(0, 13), (1, 4), (2, 1), (3, 0)]
    assert nodes == before
    assert copied[3, 0] == merkle.grown([h("other") if i == 13 else h(str(i)) for i in range(25)], 3)[-1][0]


def test_one_changed_byte_does_not_verify(spark):
    rows = [(i, f"a{i}", "en", "s", 2, 0, "") for i in range(40)]
    df = spark.createDataFrame(rows, DOCS)
    got = merkle.manifest(df, F.concat("text", F.lit("!")), F.col("doc_id") == 7).where("folded_root <> root").collect()
    assert [r["doc_id"] for r in got] == [7]
    assert len(plain(rows)) == 40
