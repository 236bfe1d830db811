from __future__ import annotations

import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from kartoteka.llm import manifest, sql
from kartoteka.llm.queries import op13_manifest
from oracle import TESTDATA, compare, connect

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, tree int"


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row, more=0):
    chars = None if row["n_chars"] is None else row["n_chars"] + more
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row["doc_id"], row["source"], row["lang"], chars, row["text"])])


def tree(nodes):
    """Root, and for every node (whether it is on the left, sibling) or None, level by level."""
    paths, level, at = [[] for _ in nodes], list(nodes), list(range(len(nodes)))
    while len(level) > 1:
        for i, a in enumerate(at):
            paths[i].append((a ^ 1 < a, level[a ^ 1]) if a ^ 1 < len(level) else None)
        level = [H(*level[i:i + 2]) for i in range(0, len(level), 2)]
        at = [a >> 1 for a in at]
    return level[0], paths


def brute(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row["lang"], []).append(row)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
    subs = {g: tree([leaf(r) for r in groups[g]]) for g in order}
    root, tops = tree([subs[g][0] for g in order]) if order else (None, [])
    out = []
    for g, top in zip(order, tops):
        for row, path in zip(groups[g], subs[g][1]):
            tampered = row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 7 == 0
            node = leaf(row, int(tampered))
            for step in path + top:
                node = H(node) if step is None else H(step[1], node) if step[0] else H(node, step[1])
            out.append((row["doc_id"], leaf(row), subs[g][0], root, H(*[s[1] for s in path + top if s]), node, node == root))
    return sorted(out, key=repr)


def proved(df):
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    return sorted(map(tuple, manifest.manifest(manifest.leaves(df, {"n_chars": F.col("n_chars").cast("decimal(38,0)") + 1}, tampered)).collect()), key=repr)


def test_against_sql(spark):
    folder = TESTDATA / "sf0.001"
    assert compare(op13_manifest(spark, str(folder)), connect(folder), sql.MANIFEST) == ([], [])


@pytest.mark.parametrize("name", ["dense", "far apart", "ties", "one", "tie of thousands"])
def test_against_plain_trees(spark, name):
    rng = random.Random(1)
    rows = {
        "dense": [(i, f"t{i}", "en" if i % 3 else None, "s", i) for i in range(700)] + [(i, "x", f"l{i}", None, None) for i in range(300)],
        "far apart": [(rng.randrange(-2 ** 63, 2 ** 63), "q", "x", "s", None) for _ in range(500)]
        + [(i, "q", "x", "s", 1) for i in (-2 ** 63, 2 ** 63 - 1, 0, -1, 1, 63, 64, -64, 2 ** 20, 2 ** 34, 2 ** 48)],
        "ties": [(rng.choice([None, 1, 2, 63, 64, 10 ** 9]), rng.choice(["a", "b", "", None, "é"]), rng.choice(["en", None, ""]), None, rng.choice([None, 2 ** 63 - 1]))
                 for _ in range(200)],
        "one": [(5, None, None, None, None)],
        "tie of thousands": [(7, "same", "en", "s", 4)] * 1500 + [(None, f"{i}", "en", "s", i) for i in range(1500)],
    }[name]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    assert proved(df) == brute([r.asDict() for r in df.collect()])


def test_no_rows(spark):
    assert proved(spark.createDataFrame([], SCHEMA)) == []


def test_every_changed_field_shows(spark):
    df = spark.createDataFrame([(i, "t", "en", "s", i, None, None) for i in range(300)], SCHEMA)
    for field in ("text", "source"):
        out = manifest.manifest(manifest.leaves(df, {field: F.lit("other")}, F.col("doc_id") == 123))
        assert [r.doc_id for r in out.where("not verified").collect()] == [123]
