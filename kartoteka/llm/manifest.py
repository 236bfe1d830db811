"""A Merkle manifest of a table: places by rank in bitmaps, levels reduced in slot arrays.

Every row is a leaf, a digest of its fields. The leaves of a group go by id, and a leaf's place is
the rank of its id in the group's bitmap. A bitmap is its non-zero words of 64 ids: tasks OR the
bits of their own rows, the shuffle ORs what they send. Next to a word stands the number of rows
before it, summed up in a directory whose every window holds at most 2^14 entries (2^16 at the
top), so a rank is one equi-join with the word and a popcount; leaves are not sorted.

Places fall into arrays of `SLOTS`, each filled by slot and reduced to one node; nodes fall into
arrays again, until a tree has one. Subroots of the groups are the leaves of the last tree. On the
way down every array gets its path, the siblings above it, so that proofs and verification need
one pass over the arrays.

Ids that repeat within a group have more rows than bits in their word. Their rows (and rows without
id, which come first) are told apart by counts of leaf prefixes and are ordered by leaf; only rows
with the same id and the same two leading bytes of the leaf are numbered in one window.

Defined results: a null field counts as `-`; a null group is a group of its own and comes first;
repeated rows are leaves each; a table without rows gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kartoteka.operators.tables import staged_table

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
LEVELS = 8
SLOTS = 1 << LEVELS
_FAN = 14  # bits of a word's number that one window of the directory goes over
_NONE, _LEFT, _RIGHT = 0, 1, 2  # whether a node has no sibling, or one on that side


def encoded(values: Sequence[Column]) -> Column:
    """Digest of fields: their UTF-8 length, a colon and the value each, `-` for null."""
    parts = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in (c.cast("string") for c in values)]
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def leaves(docs: DataFrame, changed: dict[str, Column] | None = None, where: Column | None = None,
           fields: Sequence[str] = FIELDS, key: str = "doc_id", group: str = "lang") -> DataFrame:
    """id, tree and leaf of every row, and `other`: the leaf with some fields replaced, for rows that `where` holds for."""
    own = [F.col(f) for f in fields]
    new = [(changed or {}).get(f, F.col(f)) for f in fields]
    other = F.when(where, encoded(new)) if where is not None else F.lit(None).cast("binary")
    return docs.select(F.col(key).cast("long").alias("id"), F.col(group).cast("string").alias("tree"), encoded(own).alias("leaf"), other.alias("other"))


def _same_tree(left: DataFrame, right: DataFrame) -> Column:
    return left["tree"].eqNullSafe(right["tree"])


def _before(order: str, *parts: str) -> Column:
    """Sum of n over the rows before this one, among those that agree in `parts`."""
    window = Window.partitionBy(*parts).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum("n").over(window), F.lit(0))


def bitmap_directory(rows: DataFrame) -> DataFrame:
    """tree, word, bits, n (rows in the word) and base (rows of the tree in words before it)."""
    words = rows.groupBy("tree", F.shiftright("id", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(id & 63 as int))")).alias("bits"), F.count("*").alias("n"))
    words = staged_table(words, "words")
    out = words.withColumn("part", F.shiftright("word", _FAN)).withColumn("base", _before("word", "tree", "part")).drop("part")
    for shift in (_FAN, 2 * _FAN, 3 * _FAN):
        above = words.groupBy("tree", F.shiftright("word", shift).alias("node")).agg(F.sum("n").alias("n"))
        if shift < 3 * _FAN:
            above = above.withColumn("part", F.shiftright("node", _FAN)).withColumn("up", _before("node", "tree", "part"))
        else:
            above = above.withColumn("up", _before("node", "tree"))
        above = above.select("tree", "node", "up")
        out = (out.join(above, _same_tree(out, above) & (F.shiftright(out["word"], shift) == above["node"]))
               .select(out["tree"], out["word"], out["bits"], out["n"], (out["base"] + above["up"]).alias("base")))
    return out


def _numbered_ties(rows: DataFrame) -> DataFrame:
    """Places of rows that share their id with others; `base` is the first place of the rows of their word (0 without id)."""
    rows = rows.withColumn("prefix", F.substring("leaf", 1, 2))
    counts = rows.groupBy("tree", "word", "base", "id", "prefix").agg(F.count("*").alias("n"))
    ids = counts.groupBy("tree", "word", "id").agg(F.sum("n").alias("n")).withColumn("lower", _before("id", "tree", "word")).drop("n")
    prefixes = counts.withColumn("less", _before("prefix", "tree", "word", "id")).drop("n", "base")
    first = prefixes.join(ids, _same_tree(prefixes, ids) & prefixes["word"].eqNullSafe(ids["word"]) & prefixes["id"].eqNullSafe(ids["id"])).select(
        prefixes["tree"], prefixes["word"], prefixes["id"], prefixes["prefix"], (ids["lower"] + prefixes["less"]).alias("start"))
    turn = Window.partitionBy("tree", "id", "prefix").orderBy("leaf", "other")
    rows = rows.withColumn("turn", F.row_number().over(turn) - 1)
    return (rows.join(first, _same_tree(rows, first) & rows["id"].eqNullSafe(first["id"]) & (rows["prefix"] == first["prefix"]))
            .select(rows["tree"], rows["id"], rows["leaf"], rows["other"], (rows["base"] + first["start"] + rows["turn"]).alias("place")))


def places(rows: DataFrame) -> DataFrame:
    """tree, id, leaf, other, place (from 0 in the tree) and size (leaves of the tree)."""
    known = rows.where("id is not null")
    words = staged_table(bitmap_directory(known), "directory")
    sizes = rows.groupBy("tree").agg(F.count("*").alias("size"), F.count_if(F.col("id").isNull()).alias("without"))
    known = known.withColumn("at", F.shiftright("id", 6))
    found = (known.join(words, _same_tree(known, words) & (known["at"] == words["word"]))
             .select(known["tree"], "id", "leaf", "other", "word", "bits", "n", "base"))
    single = F.col("n") == F.bit_count("bits")
    alone = found.where(single).select("tree", "id", "leaf", "other", (F.col("base") + F.expr("bit_count(bits & ~shiftleft(-1L, cast(id & 63 as int)))")).alias("place"))
    tied = _numbered_ties(found.where(~single).select("tree", "word", "base", "id", "leaf", "other"))
    keyless = _numbered_ties(rows.where("id is null").select(
        "tree", F.lit(None).cast("long").alias("word"), F.lit(0).cast("long").alias("base"), "id", "leaf", "other"))
    placed = alone.unionByName(tied).unionByName(keyless)
    return (placed.join(sizes, _same_tree(placed, sizes))
            .select(placed["tree"], "id", "leaf", "other", "size", (F.col("place") + F.when(F.col("id").isNull(), 0).otherwise(F.col("without"))).alias("place")))


def _parents(nodes: list[bytes]) -> list[bytes]:
    """Hex digests of every two consecutive nodes; the last may be alone."""
    return [sha256(b"".join(nodes[i:i + 2])).hexdigest().encode() for i in range(0, len(nodes), 2)]


def _levels(nodes: list[bytes], size: int) -> list[list[bytes]]:
    """The levels of one array of a tree of `size` nodes, the last with a single node."""
    out = [nodes]
    for _ in range(min(LEVELS, (size - 1).bit_length())):
        out.append(_parents(out[-1]))
    return out


def _path(levels: list[list[bytes]], slot: int) -> list[tuple[int, bytes]]:
    """Side and node of the sibling of a slot at every level."""
    out = []
    for level in levels[:-1]:
        sibling = slot ^ 1
        out.append((_NONE, b"") if sibling >= len(level) else (_LEFT if sibling < slot else _RIGHT, level[sibling]))
        slot >>= 1
    return out


def _packed(path: list[tuple[int, bytes]]) -> bytes:
    return b"".join(bytes([side]) + (bytes.fromhex(node.decode()) if side else bytes(32)) for side, node in path)


def _unpacked(data: bytes) -> list[tuple[int, bytes]]:
    return [(data[i], data[i + 1:i + 33].hex().encode() if data[i] else b"") for i in range(0, len(data), 33)]


def _fold(node: bytes, path: list[tuple[int, bytes]]) -> bytes:
    for side, sibling in path:
        node = sha256(sibling + node if side == _LEFT else node + sibling).hexdigest().encode()
    return node


def _by_slot(table: pa.Table) -> pa.Table:
    """Rows of one array, each in its slot."""
    slots = table["place"].to_numpy() & (SLOTS - 1)
    order = np.full(len(slots), -1, np.int64)
    order[slots] = np.arange(len(slots))
    if (order < 0).any():
        raise ValueError("places of an array are not a gapless run")
    return table.take(pa.array(order))


def slot_arrays(placed: DataFrame) -> DataFrame:
    """One row for each array of leaves: tree, part, size (of the tree), its ids, leaves, others in order, and its node."""
    def fill(table: pa.Table) -> pa.Table:
        table = _by_slot(table)
        size, place = table["size"][0].as_py(), table["place"][0].as_py()
        node = _levels([x.hex().encode() for x in table["leaf"].to_pylist()], size)[-1][0]
        columns = {c: pa.array([table[c].to_pylist()], pa.list_(kind)) for c, kind in (("id", pa.int64()), ("leaf", pa.binary()), ("other", pa.binary()))}
        return pa.table({"tree": table["tree"].slice(0, 1).combine_chunks().cast(pa.string()), "part": pa.array([place >> LEVELS]), "size": pa.array([size]),
                         "ids": columns["id"], "leaves": columns["leaf"], "others": columns["other"], "node": pa.array([bytes.fromhex(node.decode())])})

    return (placed.withColumn("part", F.shiftright("place", LEVELS)).groupBy("tree", "part")
            .applyInArrow(fill, "tree string, part long, size long, ids array<long>, leaves array<binary>, others array<binary>, node binary"))


def _parts_of(size: str) -> Column:
    return F.shiftright(F.col(size) + (SLOTS - 1), LEVELS)


def reduce_levels(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From (tree, place, size, node): roots as (tree, node), and (tree, place, path): the siblings above every node."""
    def fill(table: pa.Table) -> pa.Table:
        table = _by_slot(table)
        size, place = table["size"][0].as_py(), table["place"][0].as_py()
        levels = _levels([x.hex().encode() for x in table["node"].to_pylist()], size)
        paths = [_packed(_path(levels, slot)) for slot in range(table.num_rows)]
        return pa.table({"tree": table["tree"].slice(0, 1).combine_chunks().cast(pa.string()), "part": pa.array([place >> LEVELS]), "size": pa.array([size]),
                         "paths": pa.array([paths], pa.list_(pa.binary())), "node": pa.array([bytes.fromhex(levels[-1][0].decode())])})

    passes: list[DataFrame] = []
    while True:
        arrays = staged_table(nodes.withColumn("part", F.shiftright("place", LEVELS)).groupBy("tree", "part").applyInArrow(
            fill, "tree string, part long, size long, paths array<binary>, node binary"), "arrays")
        passes.append(arrays)
        if arrays.where("part > 0").isEmpty():
            break
        nodes = arrays.select("tree", F.col("part").alias("place"), _parts_of("size").alias("size"), "node")

    above = None
    for arrays in reversed(passes):
        paths = arrays.select("tree", "part", F.posexplode("paths").alias("slot", "path"))
        if above is not None:
            paths = (paths.join(above, _same_tree(paths, above) & (paths["part"] == above["place"]))
                     .select(paths["tree"], "part", "slot", F.concat(paths["path"], above["path"]).alias("path")))
        above = paths.select("tree", (F.col("part") * SLOTS + F.col("slot")).alias("place"), "path")
    return passes[-1].select("tree", "node"), above


def in_order(rows: DataFrame, column: str) -> DataFrame:
    """The rows with `place`, from 0 by the order of a column (nulls first), and `size`, their number."""
    dealt = rows.repartitionByRange(column).sortWithinPartitions(column).withColumn("at", F.monotonically_increasing_id())
    dealt = staged_table(dealt, "in_order").withColumn("task", F.shiftright("at", 33))
    counts = dealt.groupBy("task").agg(F.count("*").alias("n"))
    # one row for each partition of the shuffle above
    starts = counts.select("task", F.coalesce(F.sum("n").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"),
                           F.sum("n").over(Window.partitionBy()).alias("size"))
    return dealt.join(starts, "task").withColumn("place", F.expr("start + (at & 8589934591)")).drop("task", "at", "start")


def manifest(rows: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified for rows as `leaves` gives them.

    The proof is the digest of all siblings from the leaf up; the folded root is computed from the
    other leaf, where there is one, and the siblings of the original.
    """
    arrays = staged_table(slot_arrays(places(staged_table(rows, "leaves"))), "leaf_arrays")
    subroots, within = reduce_levels(arrays.select("tree", F.col("part").alias("place"), _parts_of("size").alias("size"), "node"))
    trees = in_order(subroots, "tree")
    tops = staged_table(trees, "subroots")
    roots, across = reduce_levels(tops.select(F.lit("").alias("tree"), "place", "size", "node"))
    top = roots.first()
    across = across.select("place", F.col("path").alias("up"))
    tops = tops.join(across, "place").select("tree", F.col("node").alias("subroot"), "up", F.lit(bytes(top["node"]) if top else b"").alias("root"))
    paths = (within.join(tops, _same_tree(within, tops))
             .select(within["tree"], within["place"], F.concat("path", "up").alias("path"), "subroot", "root"))
    joined = (arrays.join(paths, _same_tree(arrays, paths) & (arrays["part"] == paths["place"]))
              .select("ids", "leaves", "others", "size", "path", "subroot", "root"))

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
        for batch in batches:
            for i in range(len(batch)):
                ids, own, others, size, path, subroot, root = (batch.column(c)[i].as_py() for c in range(7))
                above = _unpacked(path)
                tail = b"".join(node for _, node in above)
                levels = _levels([x.hex().encode() for x in own], size)
                proofs, folded = [], []
                for slot, (leaf, other) in enumerate(zip(levels[0], others, strict=True)):
                    below = _path(levels, slot)
                    proofs.append(sha256(b"".join(node for _, node in below) + tail).hexdigest())
                    folded.append(_fold(_fold(leaf if other is None else other.hex().encode(), below), above).decode())
                n, whole = len(ids), root.hex()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array([x.decode() for x in levels[0]]), pa.array([subroot.hex()] * n), pa.array([whole] * n),
                     pa.array(proofs), pa.array(folded), pa.array([x == whole for x in folded])], names)

    return joined.mapInArrow(prove, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
