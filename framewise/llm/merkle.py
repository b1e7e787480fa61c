"""Merkle manifest of a table: a digest of every row, of every source and of the whole, with a proof for each row.

The rows of a source, by doc_id, are the leaves of a tree of arity three; the
roots of the sources, by name, are the leaves of the tree above. H is SHA-256 as
lowercase hexadecimal text over the inputs in a row, digests as hexadecimal text.

Leaves are numbered by one range shuffle of their digests (texts stay where they
are read) and cut into aligned blocks of 3 ** `height`. Upwards, a treehash stack turns
each block into one node of the tree above, block by block, until one is left.
Downwards, each block's proofs are scheduled as in Merkle tree traversal: for
every level there is the present run of siblings and one treehash stack that
works out the next run, one leaf a step, so a block needs memory in proportion
to the square of its height besides its own leaves. A block's shared upper
path is appended to each. A hot source is many blocks; its upper tree is a tree
of blocks again.

Nulls and odd input: a null column counts as `-`; null doc_ids come first, null
sources are one source, the first; ties of doc_id are ordered by digest, and
rows equal in all columns are leaves of their own (they lie in one range); a
lone leaf is its source's root, and a lone source's root the whole one; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, released, written

ARITY = 3
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def row_digest(columns: dict[str, Column] | None = None) -> Column:
    """H of a row: each column as byte count, colon and value, `-` for null. `columns` replaces some of them."""
    parts = []
    for name in COLUMNS:
        value = (columns or {}).get(name, F.col(name)).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def digest_of(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def height_of(n: int) -> int:
    """Levels above n leaves."""
    height = 0
    while n > 1:
        n, height = -(-n // ARITY), height + 1
    return height


class Treehash:
    """A stack that takes leaves from left to right and gives the nodes `height` levels above, in `done`."""

    def __init__(self, height: int):
        self.open: list[list[str]] = [[] for _ in range(height)]
        self.done: list[str] = []

    def push(self, node: str) -> None:
        for run in self.open:
            run.append(node)
            if len(run) < ARITY:
                return
            node = digest_of(run)
            run.clear()
        self.done.append(node)

    def close(self) -> None:
        """No leaves follow: runs that aren't full are hashed as they are."""
        node = None
        for run in self.open:
            if node is not None:
                run.append(node)
            node = digest_of(run) if run else None
            run.clear()
        if node is not None:
            self.done.append(node)


def block_root(leaves: list[str], height: int) -> str:
    stack = Treehash(height)
    for leaf in leaves:
        stack.push(leaf)
    stack.close()
    return stack.done[0]


class Level:
    """One level of a traversal: the present run of siblings, and the stack that makes the next one."""

    def __init__(self, leaves: list[str], height: int):
        self.leaves, self.height, self.span = leaves, height, ARITY ** (height + 1)
        self.at = 0
        self._begin()
        for _ in range(self.span):
            self.step()
        self.turn()

    def _begin(self) -> None:
        self.stack = Treehash(self.height)

    def step(self) -> None:
        """Take one leaf into the next run."""
        if self.at < len(self.leaves):
            self.stack.push(self.leaves[self.at])
        self.at += 1

    def turn(self) -> None:
        """The next run becomes the present one."""
        self.stack.close()
        self.run = self.stack.done
        self._begin()

    def siblings(self, leaf: int) -> bytes:
        slot = leaf // ARITY**self.height % ARITY
        others = [x for k, x in enumerate(self.run) if k != slot]
        return bytes([slot * ARITY + len(others)]) + bytes.fromhex("".join(others))


def traverse(leaves: list[str], height: int) -> Iterator[bytes]:
    """The path of each leaf in turn, from the bottom: per level a byte (place in the run * 3 + number of siblings) and the siblings' digests."""
    levels = [Level(leaves, h) for h in range(height)]
    path = [b""] * height
    for i in range(len(leaves)):
        for h, level in enumerate(levels):
            if i and i % level.span == 0:
                level.turn()
            if i % ARITY**h == 0:
                path[h] = level.siblings(i)
            level.step()
        yield b"".join(path)


def fold(node: str, proof: bytes) -> tuple[str, str]:
    """The root that a leaf and its proof give, and H of the proof's siblings."""
    at, seen = 0, []
    while at < len(proof):
        slot, others = divmod(proof[at], ARITY)
        end = at + 1 + 32 * others
        text = proof[at + 1 : end].hex()
        seen.append(text)
        node = hashlib.sha256(f"{text[: 64 * slot]}{node}{text[64 * slot :]}".encode()).hexdigest()
        at = end
    return node, digest_of(seen)


def in_order(df: DataFrame, *order: Column) -> DataFrame:
    """`df` in the order of its rows, dealt by range and written; `at` ascends, without gaps within `part`."""
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return written(sorted_.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)), "merkle-order")


def numbered(ordered: DataFrame) -> DataFrame:
    """Adds idx, a row's number within its tree, and n, the tree's rows: places are counted by (tree, part), of which there are few."""
    found = ordered.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    whole = Window.partitionBy("tree")
    before = F.coalesce(F.sum("rows").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = found.select(F.col("tree").alias("_tree"), F.col("part").alias("_part"), (before - F.col("first")).alias("_move"), F.sum("rows").over(whole).alias("n"))
    joined = ordered.join(found, (F.col("tree") == F.col("_tree")) & (F.col("part") == F.col("_part")))
    return joined.withColumn("idx", F.col("at") + F.col("_move")).drop("at", "part", "_tree", "_part", "_move")


NODES = "tree string, idx long, n long, digest string"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of each block from batches sorted by (tree, block)."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and (row["tree"], row["block"]) != (held[0]["tree"], held[0]["block"]):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _height(n: int, height: int) -> int:
    """Levels of a block in a tree of n leaves: all, or those of the whole tree if one block holds it."""
    return height if n > ARITY**height else height_of(n)


def _batches(rows: Iterator[dict], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    out: list[dict] = []
    for row in rows:
        out.append(row)
        if len(out) == size:
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def climb(leaves: DataFrame, height: int) -> list[DataFrame]:
    """Tables of nodes from the leaves (tree, idx, n, digest, more columns) up to one node a tree."""
    schema = pa.schema([("tree", pa.string()), ("idx", pa.int64()), ("n", pa.int64()), ("digest", pa.string())])
    block = ARITY**height

    def up(batches):
        roots = ({"tree": b[0]["tree"], "idx": b[0]["block"], "n": -(-b[0]["n"] // block), "digest": block_root([r["digest"] for r in b], _height(b[0]["n"], height))} for b in _blocks(batches))
        yield from _batches(roots, schema)

    levels = [leaves]
    longest = leaves.agg(F.max("n")).first()[0] or 0
    while True:
        dealt = _dealt(levels[-1].select("tree", "idx", "n", "digest", F.expr(f"idx div {block}").alias("block")))
        levels.append(written(dealt.mapInArrow(released(up), NODES), "merkle-nodes"))
        longest = -(-longest // block)
        if longest <= 1:
            return levels


def _dealt(nodes: DataFrame) -> DataFrame:
    """Nodes by blocks, in order; as many parts as shuffles have, for the work isn't in the bytes."""
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return nodes.repartition(parts, "tree", "block").sortWithinPartitions("tree", "block", "idx")


def descend(levels: list[DataFrame], heads: DataFrame, height: int) -> DataFrame:
    """The leaves with their columns and proof, from `heads`: tree and proof of each tree's root.

    A block's head, the path above it, is sent to the block's task as a row before its leaves.
    """
    for level in levels[-2::-1]:
        names = [c for c in level.columns if c not in ("tree", "idx", "n", "digest")]
        rows = level.select("tree", F.expr(f"idx div {ARITY**height}").alias("block"), "idx", "n", "digest", F.lit(None).cast("binary").alias("proof"), *names)
        blank = [F.lit(None).cast(level.schema[c].dataType).alias(c) for c in names]
        first = heads.select("tree", F.col("idx").alias("block"), F.lit(-1).cast("long").alias("idx"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("string").alias("digest"), "proof", *blank)
        out = pa.schema([("tree", pa.string()), ("idx", pa.int64()), ("n", pa.int64()), ("digest", pa.string()), ("proof", pa.binary()), *_types(level, names)])

        def down(batches, out=out):
            def rows_of():
                for head, *leaves in _blocks(batches):
                    for row, path in zip(leaves, traverse([r["digest"] for r in leaves], _height(leaves[0]["n"], height)), strict=True):
                        del row["block"]
                        row["proof"] = path + head["proof"]
                        yield row

            yield from _batches(rows_of(), out, 1024)

        dealt = _dealt(rows.unionByName(first))
        schema = rows.drop("block").select("tree", "idx", "n", "digest", "proof", *names).schema
        heads = dealt.mapInArrow(released(down), schema)
    return heads


def _types(df: DataFrame, names: list[str]) -> list[tuple[str, pa.DataType]]:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
    return [(c, kinds[df.schema[c].dataType.simpleString()]) for c in names]


def manifest(docs: DataFrame, carry: dict[str, Column] | None = None, height: int = 7) -> DataFrame:
    """doc_id, leaf, subroot, root and proof of every row, and the string columns of `carry`, worked out from the row where it is read.

    A block has 3 ** `height` leaves.
    """
    arrow_rows(docs.sparkSession)
    carry = carry or {}
    tree = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    leaves = docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), row_digest().alias("digest"), *[c.cast("string").alias(n) for n, c in carry.items()])
    leaves = numbered(in_order(leaves, F.col("tree").asc(), F.col("doc_id").asc_nulls_first(), F.col("digest").asc()))
    levels = climb(leaves, height)
    subroots = levels[-1]
    named = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    upper = climb(numbered(in_order(named, F.col("name").asc())), height)
    found = upper[-1].first()
    if found is None:
        empty = docs.limit(0).select(F.col("doc_id").cast("long").alias("doc_id"), *[F.lit("").alias(c) for c in ("leaf", "subroot", "root")], F.lit(b"").alias("proof"), *[F.lit("").alias(n) for n in carry])
        return empty
    top = upper[-1].select("tree", F.lit(0).cast("long").alias("idx"), F.lit(b"").alias("proof"))
    above = written(descend(upper, top, height).select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("idx"), "proof", F.col("digest").alias("subroot")), "merkle-paths")
    found_leaves = descend(levels, above.select("tree", "idx", "proof"), height)
    # One row a source; Spark broadcasts it only where it is small.
    tops = above.select(F.col("tree").alias("_tree"), "subroot")
    return found_leaves.join(tops, F.col("tree") == F.col("_tree")).select("doc_id", F.col("digest").alias("leaf"), "subroot", F.lit(found.digest).alias("root"), "proof", *carry)


def verify(proofs: DataFrame, changed: str | None = None) -> DataFrame:
    """The rows of a manifest with proof_sha256, folded_root and verified: whether the leaf (that of column `changed` where it isn't null) leads to the root."""
    columns = ["doc_id", "leaf", "subroot", "root", "proof"]

    def run(batches):
        for batch in batches:
            doc_id, leaf, subroot, root, proof, other = (batch.column(i) for i in range(6))
            folded, seen = [], []
            for own, path, new in zip(leaf.to_pylist(), proof.to_pylist(), other.to_pylist(), strict=True):
                found, siblings = fold(own if new is None else new, path)
                folded.append(found)
                seen.append(siblings)
            same = [a == b for a, b in zip(folded, root.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([doc_id, leaf, subroot, root, pa.array(seen), pa.array(folded), pa.array(same)], [*columns[:4], "proof_sha256", "folded_root", "verified"])

    arrow_rows(proofs.sparkSession)
    other = F.col(changed) if changed else F.lit(None).cast("string")
    return proofs.select(*columns, other.alias("other")).mapInArrow(released(run), "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
