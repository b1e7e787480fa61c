"""Jaccard self-join of documents on word n-grams, by token-combination prefixes.

A document's set holds the hashes of its distinct n-word shingles. Documents
with equal sets form a class, and classes are joined:

1. Shingles are dealt by value in packed blocks, chunk of documents by chunk.
   Those that one set alone holds can't be in an intersection: they only count.
   The others return to their chunks with their frequency. Very frequent ones are
   found before by Misra-Gries summaries and stay where they are, so none is
   gathered. (Copies in several chunks make their shingles look shared, which
   costs work and changes nothing.)
2. A class that misses more shingles than its size allows has no partner. Of the
   rest, the shared shingles in ascending frequency form a prefix, extended until
   a partner must share either a rare one (index: the shingle), or k shingles of
   one frequent group (index: k-combinations; k = 2 for frequent ones, 3 for the
   most frequent). Groups are cut by hash so that combinations stay few.
3. Index entries link each class to one leader per entry; linked pairs are
   verified on their shared shingles, which give the exact intersection.
   A leader's entries of about one size are one star: a row per class, however
   many of them it shares with its leader. Stars whose classes don't yet lie in
   one component stay open: who links with whom in an entry, shares its star.
   Classes of open stars are clustered, and clusters are screened by sketches: a bit for
   each of about as many buckets as the set has shingles, set where an odd number
   falls into it. Two sets differ in at least as many shingles as their sketches
   in bits, so pairs beyond what the similarity allows are none, and classes
   without a possible partner in another component go. What is left falls into
   small clusters, each tested in cells: matrices of intersection sizes of two
   blocks of classes whose sizes fit. A cell gives a spanning forest of the
   components it joins, never its pairs.
4. `join` needs no more than that for components. Links lie within components,
   so `join_links` and `class_links` then test each component in such cells:
   each pair lies in one matrix, which gives its links, or for `join_links` only
   their number per class.

Why the prefix is enough: let a class of n shingles need n - t in common with a
partner, and let the prefix hold u unshared shingles and c_g of group g. If it
shared fewer than k_g of each group g, at least u + sum(max(0, c_g - k_g + 1))
of the prefix would be missing; the prefix runs until that exceeds t. With one
order for all, what the prefix that ends first shares lies in both prefixes.

Hashes are 64-bit per word, 128-bit per set, 48-bit per shingle when shingles of
two documents are compared: for two sets of 600 the chance of a false common one
is 1e-9.

Sizes: a task holds a chunk or a bucket of about a million shingles, or a cell of
at most two blocks. What is dealt is at most a row per shingle, and with many
buckets goes in two steps, so that rows stay long. A bucket grows beyond that only
by a shingle which the summaries miss: one of less than about 1 % of all
documents. A cluster of m classes of like size costs (m / 512)^2 cells, and m / 512
rows a class; texts that share passages and are unlike cost (m / 8,192)^2 cells of
sketches, which are a fiftieth of the sets.

Nulls and odd input: a null or empty text, or one of white space, has an empty
set and is linked with nothing; fewer words than n are one shingle; very long
texts are sets like others, whole; a null doc_id takes part but never names a
component, unless alone; rows that share a doc_id are separate; an empty table
gives no rows; other columns are ignored, or kept by `keep_one`.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, discard, drop_ids, kept, released, tidy, unused_prefix, written

BITS = 48
#: Frequencies are coded by bit length; from this code on a shingle is frequent (64 classes or more).
FREQUENT = 7
#: The code of the most frequent shingles, found before the join.
HOT = 63
#: Below this band (32 shingles) single shingles are indexed throughout.
SMALL_BAND = 5
#: A block of classes: what one side of a cell holds.
BLOCK_ROWS, BLOCK_BYTES = 512, 4_000_000
#: What one side of a cell of sketches holds, at most BLOCK_BYTES too; bits of a sketch.
SKETCH_ROWS, LEAST_BITS, MOST_BITS = 8_192, 256, 1 << 16
#: Values that so many sets hold are counted by matrix products.
DENSE = 16
WORDS_CAP = 200_000


def _word_hashes(words: list[bytes]) -> np.ndarray:
    known: dict[bytes, int] = kept("word hashes", dict)
    new = {*words}.difference(known)
    if new:
        if len(known) + len(new) > WORDS_CAP:
            known.clear()
            new = {*words}
        for w in new:
            known[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingles(text: bytes | None, width: int) -> np.ndarray:
    """Ascending distinct 64-bit hashes of the shingles of a UTF-8 text."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = _word_hashes(words)
    size = min(width, len(h))
    n = len(h) - size + 1
    with np.errstate(over="ignore"):
        out = np.full(n, size, np.uint64)
        for k in range(size):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
            out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return np.unique(out)


def set_digest(values: np.ndarray) -> bytes:
    """128-bit digest of a set."""
    return xxhash.xxh3_128_digest(values.tobytes())


def allowed(n, num: int, den: int):
    """How many of its n shingles a class may miss in a partner."""
    return n - -(-n * num // den)


def _planes(values: np.ndarray) -> bytes:
    """48-bit values byte by byte, which compresses well when they ascend."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : BITS // 8].T.tobytes()


def _unplanes(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) * 8 // BITS, 8), np.uint8)
    out[:, : BITS // 8] = np.frombuffer(raw, np.uint8).reshape(BITS // 8, -1).T
    return out.reshape(-1).view("<u8")


def _batch(schema: str, columns: list) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [name for name, _ in fields])


# Classes and the most frequent shingles

SETS = "doc_id long, n long, class binary, hot long, n_docs long"
#: Shingles (and at most so many sets) that a worker gathers to a chunk, and shingles of a bucket of values.
CHUNK = 1_000_000
CHUNK_SETS = 1 << 16
BUCKET_ENTRIES = 500_000


class Summary:
    """Misra-Gries counts of shingles: each too low by at most (shingles added) / `counters`."""

    def __init__(self, counters: int = 1 << 17):
        self.counters = counters
        self.values, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.new: list[np.ndarray] = []
        self.pending = 0

    def add(self, values: np.ndarray) -> None:
        self.new.append(values)
        self.pending += len(values)
        if self.pending >= CHUNK:
            self.merge()

    def merge(self) -> None:
        """Count what was added; beyond `counters` values, all counts fall by the largest that has no room."""
        if not self.new:
            return
        values, counts = np.unique(np.concatenate(self.new), return_counts=True)
        self.new, self.pending = [], 0
        known = np.searchsorted(self.values, values)
        known[known == len(self.values)] = 0
        same = self.values[known] == values if len(self.values) else np.zeros(len(values), bool)
        self.counts[known[same]] += counts[same]
        values, counts = np.concatenate([self.values, values[~same]]), np.concatenate([self.counts, counts[~same]])
        if len(values) > self.counters:
            counts = counts - np.partition(counts, -self.counters - 1)[-self.counters - 1]
            values, counts = values[counts > 0], counts[counts > 0]
        order = np.argsort(values)
        self.values, self.counts = values[order], counts[order]


def describe(docs: DataFrame, width: int) -> DataFrame:
    """A row per document (doc_id, n, class), and rows of shingles (hot) with at least how many documents of a partition hold them, if over 1 in 512."""

    def read(batches):
        held, docs_read = Summary(), 0
        for batch in batches:
            ids = batch.column(0).to_pylist()
            sets = [shingles(t, width) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            classes = [set_digest(s) if len(s) else None for s in sets]
            for s in {c: s for c, s in zip(classes, sets, strict=True) if c is not None}.values():
                held.add(s >> np.uint64(64 - BITS))
            docs_read += len(ids)
            none = [None] * len(ids)
            yield _batch(SETS, [ids, [len(s) for s in sets], classes, none, none])
        held.merge()
        most = held.counts >= max(8, docs_read // 512)
        blank = [None] * int(most.sum())
        yield _batch(SETS, [blank, blank, blank, held.values[most].astype(np.int64), held.counts[most]])

    arrow_rows(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(released(read), SETS)


def most_frequent(described: DataFrame, n_docs: int) -> np.ndarray:
    """Shingles counted in at least 1 in 256 documents and 1,000: at most 256 times the mean set size."""
    least = max(1000, n_docs // 256)
    found = described.filter("hot is not null").groupBy("hot").agg(F.sum("n_docs").alias("n")).filter(F.col("n") >= least).select("hot").collect()
    return np.sort(np.array([r.hot for r in found], np.uint64))


# Shared shingles of each class

#: Entries of a key, chunk by chunk: which set of the chunk holds which shingle. A chunk's own row has its names and sizes too.
PACKED = "key int, chunks binary, counts binary, holders binary, shingles binary, codes binary, names binary, sizes binary"
CLASSES = "class binary, n long, shared long, shingles binary, codes binary"
#: Up to so many keys, rows are dealt in one step.
FAN = 1024


class Entries:
    """Entries (chunk, holder, shingle, code): `chunks` are numbers, a holder is a set's place in its chunk."""

    def __init__(self, chunks: np.ndarray, holders: np.ndarray, values: np.ndarray, codes: np.ndarray):
        self.chunks, self.holders, self.values, self.codes = chunks, holders, values, codes

    @classmethod
    def read(cls, rows: list[dict]) -> Entries:
        """Those of packed rows."""

        def joined(name: str, kind: str) -> np.ndarray:
            return np.frombuffer(b"".join(r[name] for r in rows), kind)

        values = np.concatenate([np.zeros(0, np.uint64), *(_unplanes(r["shingles"]) for r in rows)])
        return cls(np.repeat(joined("chunks", "<i8"), joined("counts", "<u4")), joined("holders", "<u2"), values, joined("codes", "u1"))

    def taken(self, at: np.ndarray) -> Entries:
        return Entries(self.chunks[at], self.holders[at], self.values[at], self.codes[at])

    def packed(self, keys: np.ndarray) -> list[tuple]:
        """A row for each key that occurs; entries are in order of key and chunk."""
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        rows = []
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True) if len(keys) else ():
            own = self.chunks[a:b]
            starts = np.append(0, np.flatnonzero(own[1:] != own[:-1]) + 1)
            counts = np.diff(np.append(starts, b - a)).astype("<u4")
            rows.append((int(keys[a]), own[starts].tobytes(), counts.tobytes(), self.holders[a:b].tobytes(), _planes(self.values[a:b]), self.codes[a:b].tobytes(), None, None))
        return rows


def _packed_batch(rows: list[tuple]) -> pa.RecordBatch:
    return _batch(PACKED, [*zip(*rows, strict=True)] or [[]] * 8)


def _step(keys: int) -> int:
    """How many keys the first of two steps of dealing takes together; 1: one step is enough."""
    return 1 if keys <= FAN else math.ceil(math.sqrt(keys))


def _by_value(entries: Entries, buckets: int) -> np.ndarray:
    """The bucket of each shingle, ascending with it."""
    return (((entries.values >> np.uint64(16)) * np.uint64(buckets)) >> np.uint64(BITS - 16)).astype(np.int64)


def _by_chunk(entries: Entries, parts: int) -> np.ndarray:
    """The part of each entry's chunk."""
    return (_mix(entries.chunks.astype(np.uint64), 7) % np.uint64(parts)).astype(np.int64)


def regrouped(packed: DataFrame, keys: int, key_of: Callable[[Entries, int], np.ndarray]) -> DataFrame:
    """The second step: entries that share a key of the first step, in rows by their own keys. Any task may do any part of a key."""
    step, chunk = _step(keys), CHUNK
    if step == 1:
        return packed

    def again(rows: list[dict]) -> pa.RecordBatch:
        found = Entries.read([r for r in rows if r["names"] is None])
        own = key_of(found, keys)
        order = np.lexsort((found.values, found.holders, found.chunks, own))
        whole = [r for r in rows if r["names"] is not None]
        for r in whole:
            r["key"] = int(key_of(Entries(np.frombuffer(r["chunks"], "<i8"), *[np.zeros(1, np.uint64)] * 3), keys)[0])
        return _packed_batch(found.taken(order).packed(own[order]) + [tuple(r.values()) for r in whole])

    def read(batches):
        held: list[dict] = []
        n = 0
        for row in (r for batch in batches for r in batch.to_pylist()):
            if held and (n >= chunk or row["key"] != held[0]["key"]):
                yield again(held)
                held, n = [], 0
            held.append(row)
            n += len(row["codes"])
        if held:
            yield again(held)

    salt = F.pmod(F.xxhash64("chunks"), F.lit(step)).cast("int")
    return packed.repartition(F.col("key"), salt).sortWithinPartitions("key").mapInArrow(released(read), PACKED)


def deal(docs: DataFrame, width: int, buckets: int, hot: np.ndarray) -> DataFrame:
    """The entries of a chunk of documents for each bucket of shingle values; very frequent ones stay in the chunk's own row.

    Equal sets are one within a chunk, and several in several chunks.
    """
    shared, step, chunk = docs.sparkSession.sparkContext.broadcast(hot), _step(buckets), CHUNK

    def pack(sets: dict[bytes, np.ndarray], number: int) -> pa.RecordBatch:
        sizes = np.array([len(s) for s in sets.values()], np.uint32)
        values = np.concatenate([*sets.values()]) >> np.uint64(64 - BITS)
        order = np.argsort(values, kind="stable")
        found = Entries(np.full(len(values), number), np.repeat(np.arange(len(sets)), sizes).astype("<u2")[order], values[order], np.zeros(len(values), np.uint8))
        frequent = np.isin(found.values, shared.value) if len(shared.value) else np.zeros(len(values), bool)
        rare, often = found.taken(~frequent), found.taken(frequent)
        one = np.array([number], "<i8")
        row = (int(_by_value(Entries(one, one, _mix(one.astype(np.uint64), 11) >> np.uint64(64 - BITS), one), buckets)[0]) // step, one.tobytes(), np.array([len(often.values)], "<u4").tobytes())
        row += (often.holders.tobytes(), _planes(often.values), np.full(len(often.values), HOT, np.uint8).tobytes(), b"".join(sets), sizes.tobytes())
        return _packed_batch(rare.packed(_by_value(rare, buckets) // step) + [row])

    def read(batches):
        sets: dict[bytes, np.ndarray] = {}
        held, number = 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                found = shingles(text, width)
                if len(found) and (name := set_digest(found)) not in sets:
                    sets[name] = found
                    held += len(found)
                if held >= chunk or len(sets) == CHUNK_SETS:
                    yield pack(sets, number)
                    sets, held, number = {}, 0, number + 1
        if sets:
            yield pack(sets, number)

    arrow_rows(docs.sparkSession)
    return regrouped(docs.select("text").mapInArrow(released(read), PACKED), buckets, _by_value)


def share(dealt: DataFrame, parts: int) -> DataFrame:
    """Per bucket: shingles that several sets hold, with coded frequency, for the part of each set's chunk."""
    step = _step(parts)

    def reduce(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        found = Entries.read([r for r in rows if r["names"] is None])
        own = np.argsort(found.values, kind="stable")
        values = found.values[own]
        starts = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, int)
        counts = np.diff(np.append(starts, len(values)))
        counts = np.repeat(counts, counts)
        own, counts = own[counts > 1], counts[counts > 1]
        found = found.taken(own)
        found.codes = np.ceil(np.log2(counts + 1)).astype(np.uint8)
        part = _by_chunk(found, parts) // step
        order = np.lexsort((found.values, found.holders, found.chunks, part))
        whole = [r for r in rows if r["names"] is not None]
        for r in whole:
            r["key"] = int(_by_chunk(Entries(np.frombuffer(r["chunks"], "<i8"), *[np.zeros(1)] * 3), parts)[0]) // step
        return pa.Table.from_batches([_packed_batch(found.taken(order).packed(part[order]) + [tuple(r.values()) for r in whole])])

    return regrouped(dealt.groupBy("key").applyInArrow(tidy(reduce), PACKED), parts, _by_chunk)


def gather(shared: DataFrame, num: int, den: int) -> DataFrame:
    """Classes that may have a partner: size, number of shared shingles, and those by ascending frequency."""

    def reduce(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        whole = sorted((r for r in rows if r["names"] is not None), key=lambda r: np.frombuffer(r["chunks"], "<i8")[0])
        sizes = [np.frombuffer(r["sizes"], "<u4") for r in whole]
        names = b"".join(r["names"] for r in whole)
        chunks = np.array([np.frombuffer(r["chunks"], "<i8")[0] for r in whole], np.int64)
        before = np.cumsum([0, *(len(x) for x in sizes)])[:-1]
        sizes = np.concatenate(sizes)
        found = Entries.read(rows)
        holders = before[np.searchsorted(chunks, found.chunks)] + found.holders
        order = np.lexsort((found.values, found.codes, holders))
        holders, values, codes = holders[order], found.values[order], found.codes[order]
        starts = np.flatnonzero(np.append(True, holders[1:] != holders[:-1])) if len(holders) else np.zeros(0, int)
        ends = np.append(starts[1:], len(holders))
        n = sizes[holders[starts]].astype(np.int64)
        may = np.flatnonzero(n - (ends - starts) <= allowed(n, num, den))
        raw = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : BITS // 8]
        out = [(names[16 * h : 16 * h + 16], int(n[i]), int(ends[i] - starts[i]), raw[starts[i] : ends[i]].tobytes(), codes[starts[i] : ends[i]].tobytes()) for i, h in zip(may.tolist(), holders[starts[may]].tolist(), strict=True)]
        return pa.Table.from_batches([_batch(CLASSES, [*zip(*out, strict=True)] or [[]] * 5)])

    # Copies of a set from several chunks are one class: their shared shingles and codes are the same.
    return shared.groupBy("key").applyInArrow(tidy(reduce), CLASSES).dropDuplicates(["class"])


def _values(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) * 8 // BITS, 8), np.uint8)
    out[:, : BITS // 8] = np.frombuffer(raw, np.uint8).reshape(-1, BITS // 8)
    return out.reshape(-1).view("<u8")


# The index

ENTRIES = "entry long, class binary, n long, missing long"


def _mix(values: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (values + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(31)
        x *= np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(29))


def bands(n: int, num: int, den: int) -> list[int]:
    """Size bands in which a class of n shingles is indexed: its own, and the next if a partner may lie there. A pair meets in the larger's."""
    own = n.bit_length() - 1
    return [own] if (n * den // num).bit_length() - 1 == own else [own, own + 1]


def signatures(n: int, values: np.ndarray, codes: np.ndarray, band: int, num: int, den: int) -> np.ndarray:
    """Index entries of a class in a band: hashes of single shingles and combinations of its prefix."""
    need = int(allowed(n, num, den)) + 1 - (n - len(values))
    width = 1 if band < SMALL_BAND else None
    salt = band << 56
    rare = len(values) if width else int(np.searchsorted(codes, FREQUENT))
    single = _mix(values[: min(need, rare)], salt + 1)
    need -= len(single)
    if need <= 0 or width:
        return single
    misses = allowed(1 << band, num, den) + 1
    cut = {2: max(1, misses // 2), 3: max(1, misses // 4)}
    groups: dict[tuple[int, int], list[int]] = {}
    for i in range(rare, len(values)):
        k = 3 if codes[i] == HOT else 2
        group = groups.setdefault((k, int(values[i]) % cut[k]), [])
        group.append(int(values[i]))
        if len(group) >= k:
            need -= 1
            if not need:
                break
    combined = [hash_combination(c, k) for (k, _), group in groups.items() for c in combinations(sorted(group), k)]
    return np.concatenate([single, _mix(np.array(combined, np.uint64), salt + 2)])


def hash_combination(values: tuple[int, ...], k: int) -> int:
    return xxhash.xxh3_64_intdigest(b"".join(v.to_bytes(8, "little") for v in values), k)


def index(classes: DataFrame, num: int, den: int) -> DataFrame:
    """entry, class, n and how many shingles of the class no other holds."""

    def read(batches):
        for batch in batches:
            names = batch.column(0)
            found: list[tuple[int, int, int, np.ndarray]] = []

            def rows() -> pa.RecordBatch:
                at, n, missing, signs = zip(*found, strict=True)
                times = [len(x) for x in signs]
                return _batch(ENTRIES, [np.concatenate(signs), names.take(pa.array(np.repeat(at, times))), np.repeat(n, times), np.repeat(missing, times)])

            for i, (n, shared, values, codes) in enumerate(zip(*(x.to_pylist() for x in batch.columns[1:]), strict=True)):
                values, codes = _values(values), np.frombuffer(codes, np.uint8)
                found += [(i, n, n - shared, np.unique(signatures(n, values, codes, band, num, den)).view(np.int64)) for band in bands(n, num, den)]
                if sum(len(x[3]) for x in found) > 50_000:
                    yield rows()
                    found = []
            if found:
                yield rows()

    arrow_rows(classes.sparkSession)
    return classes.mapInArrow(released(read), ENTRIES)


def _sizes_fit(a: str, b: str, num: int, den: int):
    return F.least(a, b) * den >= F.greatest(a, b) * num


def stars(entries: DataFrame) -> DataFrame:
    """Each class with the leader of each of its entries, the class with the fewest shingles of its own, once per size.

    Size: how many others an entry holds beside its leader, by bit length (1: one).
    """
    leader = entries.groupBy("entry").agg(F.min(F.struct("missing", "class", "n")).alias("l"), F.count("*").alias("m")).filter("m > 1")
    followers = entries.join(leader, "entry").filter(F.col("class") != F.col("l.class"))
    return followers.select("class", "n", F.col("l.class").alias("leader"), F.col("l.n").alias("leader_n"), F.length(F.bin(F.col("m") - 1)).alias("size")).distinct()


def star_pairs(held: DataFrame, num: int, den: int) -> DataFrame:
    """a < b: each class with its leaders, where sizes fit."""
    fit = held.filter(_sizes_fit("n", "leader_n", num, den))
    return fit.select(F.least("class", "leader").alias("a"), F.greatest("class", "leader").alias("b")).distinct()


def open_stars(held: DataFrame, component: DataFrame) -> DataFrame:
    """class, leader and their components, of a leader's entries of one size that hold more than two classes and don't all lie in one component."""
    own = held.filter("size > 1").join(component, "class", "left").select("class", "leader", "size", F.coalesce("component", "class").alias("component"))
    reach = own.groupBy("leader", "size").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    leaders = component.select(F.col("class").alias("leader"), F.col("component").alias("leader_component"))
    mixed = reach.join(leaders, "leader", "left").withColumn("leader_component", F.coalesce("leader_component", "leader"))
    return own.join(mixed.filter("lo <> hi or lo <> leader_component").drop("lo", "hi"), ["leader", "size"]).drop("size").distinct()


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """The matrix of intersection sizes of ascending arrays: frequent values by matrix products, rare ones by their pairs."""
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, columns, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.lexsort((rows, columns))
    rows, columns = rows[order], columns[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    few = (counts[columns] >= 2) & (counts[columns] < DENSE)
    r, c = rows[few], columns[few]
    for step in range(1, DENSE - 1):
        same = c[step:] == c[:-step]
        if same.any():
            out += np.bincount(r[:-step][same] * len(sets) + r[step:][same], minlength=out.size).reshape(out.shape)
    many = np.flatnonzero(counts >= DENSE)
    at = np.full(len(counts), -1)
    at[many] = np.arange(len(many))
    r, c = rows[at[columns] >= 0], at[columns][at[columns] >= 0]
    for low in range(0, len(many), 2048):
        a, b = np.searchsorted(c, (low, low + 2048))
        x = np.zeros((len(sets), 2048), np.float32)
        x[r[a:b], c[a:b] - low] = 1
        out += np.triu(x @ x.T, 1)
    return out


def _size_band(n: Column, num: int, den: int) -> Column:
    """Sets whose sizes fit lie in one band or in bands next to each other."""
    return F.floor(F.log("n") / (math.log(den / num) * (1 + 1e-9)) if den > num else F.col("n")).cast("int")


def cells(members: DataFrame, classes: DataFrame, num: int, den: int, payload: str = "shingles", block_rows: int | None = None) -> DataFrame:
    """Rows of `members` (class, group, and others) with n and shingles (or another payload of `classes`), dealt to cells.

    Each pair of classes of one group whose sizes fit lies in one cell: a small
    group in a cell that it may share with others, a large one in cells of two
    blocks of the same or the next size band. In a cell of two blocks (crossed),
    pairs of one side (0 or 1) belong to other cells.
    """
    spark = members.sparkSession
    space = F.greatest(F.lit(1 / (block_rows or BLOCK_ROWS)), F.octet_length(payload) / F.lit(float(BLOCK_BYTES)))
    own = written(members.join(classes.select("class", "n", payload), "class").withColumns({"band": _size_band("n", num, den), "space": space}), "cell-members")
    size = own.groupBy("group").agg(F.sum("space").alias("space"))
    large = written(size.filter("space > 1").select("group"), "cell-groups")
    total = size.agg(F.sum("space")).first()[0] or 0
    shares = F.pmod(F.xxhash64("group"), F.lit(max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(2 * total))))
    small = own.join(large, "group", "left_anti").withColumns({"owner": shares, "at": F.lit(-1), "step": F.lit(0), "i": F.lit(0), "j": F.lit(0), "side": F.lit(0)})
    banded = written(own.join(large, "group").groupBy("group", "band").agg(F.ceil(F.sum("space")).cast("int").alias("blocks")), "cell-bands")
    near = banded
    for name, by in (("before", 1), ("after", -1)):
        near = near.join(banded.select("group", (F.col("band") + by).alias("band"), F.col("blocks").alias(name)), ["group", "band"], "left")

    def cell(at: Column, step: int, i: Column, j: Column, side: Column) -> Column:
        return F.struct(at.alias("at"), F.lit(step).alias("step"), i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))

    def others(count: Column) -> Column:
        """The numbers of the blocks: 0 to count - 1."""
        return F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))

    band, block = F.col("band"), F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    seats = F.concat(
        F.transform(others(F.col("blocks")), lambda o: cell(band, 0, F.least(block, o), F.greatest(block, o), block > o)),
        F.transform(others(F.col("after")), lambda o: cell(band, 1, block, o, F.lit(0))),
        F.transform(others(F.col("before")), lambda o: cell(band - 1, 1, o, block, F.lit(1))),
    )
    dealt = own.join(near, ["group", "band"]).withColumn("seat", F.explode(seats)).withColumn("owner", F.xxhash64("group"))
    columns = [c for c in own.columns if c not in ("band", "space")]
    spread = dealt.select(*columns, "owner", *(F.col(f"seat.{c}").alias(c) for c in ("at", "step", "i", "j", "side")))
    return small.select(*spread.columns).unionByName(spread)


CELL = ["owner", "at", "step", "i", "j"]


def sketch(values: np.ndarray, n: int) -> bytes:
    """Parities of a set's shared shingles by bucket; the number of buckets is a power of two near the set's size n."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (n - 1).bit_length()))
    counts = np.bincount((values & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits(counts & 1, bitorder="little").tobytes()


def folded(raw: bytes, bits: int) -> np.ndarray:
    """A sketch with fewer buckets: those that fall together are added up."""
    words = np.frombuffer(raw, "<u8")
    return np.bitwise_xor.reduce(words.reshape(-1, bits // 64), axis=0)


def sketches(classes: DataFrame) -> DataFrame:
    """class, n, and sketch: the shingles that no other set holds (4 bytes), and the parities of the others."""

    def read(batches):
        for batch in batches:
            made = [(n - shared).to_bytes(4, "little") + sketch(_values(raw), n) for n, shared, raw in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.binary())], ["class", "n", "sketch"])

    arrow_rows(classes.sparkSession)
    return classes.select("class", "n", "shared", "shingles").mapInArrow(released(read), "class binary, n long, sketch binary")


def possible_pairs(group: pa.Table, num: int, den: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of different components in a cell of sketches that may be similar enough.

    Sets of sizes a and b differ in at most (a + b) * (den - num) / (den + num) shingles if they link.
    """
    n, side = group.column("n").to_numpy(), group.column("side").to_numpy()
    raw = group.column("sketch").to_pylist()
    bits = min(len(x) - 4 for x in raw) * 8
    alone = np.array([int.from_bytes(x[:4], "little") for x in raw])
    marks = np.array([folded(x[4:], bits) for x in raw])
    _, part = np.unique(np.array(group.column("component").to_pylist(), object), return_inverse=True)
    crossed = group.column("step")[0].as_py() or group.column("i")[0].as_py() != group.column("j")[0].as_py()
    left, edges = np.ones(len(raw), bool), []
    for root in range(len(raw)):
        if not left[root]:
            continue
        left[root], reached = False, [root]
        while reached:
            at = reached.pop()
            others = np.flatnonzero(left)
            if not len(others):
                return edges
            fit = part[others] != part[at]
            if crossed:
                fit &= side[others] != side[at]
            others = others[fit]
            apart = alone[others] + alone[at] + np.bitwise_count(marks[others] ^ marks[at]).sum(axis=1, dtype=np.int64)
            new = others[apart * (den + num) <= (n[others] + n[at]) * (den - num)]
            left[new] = False
            edges += [(at, int(k)) for k in new]
            reached += new.tolist()
    return edges


def screened(members: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """Of `members` (class, component, group) those that may have a partner in another component, in groups that no possible pair leaves."""
    own = written(sketches(classes.join(members.select("class").distinct(), "class")), "sketches")

    def test(group: pa.Table) -> pa.Table:
        names = group.column("class").to_pylist()
        pairs = possible_pairs(group, num, den)
        return pa.table([pa.array([names[i] for i, _ in pairs], pa.binary()), pa.array([names[j] for _, j in pairs], pa.binary())], ["a", "b"])

    dealt = cells(members, own, num, den, "sketch", SKETCH_ROWS)
    possible = written(dealt.groupBy(*CELL).applyInArrow(tidy(test), "a binary, b binary"), "possible-pairs")
    return members.drop("group").join(components(possible).withColumnRenamed("component", "group"), "class")


def _links_within(group: pa.Table, num: int, den: int) -> np.ndarray:
    """The upper triangle of the links that a cell is for."""
    n, side = group.column("n").to_numpy(), group.column("side").to_numpy()
    common = common_counts([_values(x) for x in group.column("shingles").to_pylist()]).astype(np.int64)
    good = np.triu(den * common >= num * (n[:, None] + n[None, :] - common), 1)
    if group.column("step")[0].as_py() or group.column("i")[0].as_py() != group.column("j")[0].as_py():
        good &= side[:, None] != side[None, :]
    return good


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a symmetric matrix of links."""
    left, edges = np.ones(len(linked), bool), []
    for root in range(len(linked)):
        if not left[root]:
            continue
        left[root], reached = False, [root]
        while reached:
            at = reached.pop()
            new = np.flatnonzero(linked[at] & left)
            left[new] = False
            edges += [(at, int(k)) for k in new]
            reached += new.tolist()
    return edges


def verify_clusters(opened: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """Links that join the components of classes which share an open star, as few as join them.

    Stars overlap, so their classes are clustered; a cluster falls apart into
    those of possible pairs, each of which is tested in cells.
    """
    edges = written(opened.select(F.col("class").alias("a"), F.col("leader").alias("b")).distinct(), "cluster-links")
    if edges.isEmpty():
        return edges
    members = opened.select("class", "component").union(opened.select("leader", "leader_component")).distinct()
    members = members.join(components(edges).withColumnRenamed("component", "group"), "class")
    members = written(screened(written(members, "cluster-members"), classes, num, den), "cluster-members")
    if members.isEmpty():
        return edges.limit(0)

    def test(group: pa.Table) -> pa.Table:
        names = np.array(group.column("class").to_pylist(), object)
        parts, part = np.unique(np.array(group.column("component").to_pylist(), object), return_inverse=True)
        i, j = np.nonzero(_links_within(group, num, den))
        i, j = i[part[i] != part[j]], j[part[i] != part[j]]
        # One link for each pair of components, of which a forest stays.
        between, first = np.unique(np.minimum(part[i], part[j]) * len(parts) + np.maximum(part[i], part[j]), return_index=True)
        linked = np.zeros((len(parts), len(parts)), bool)
        linked[between // len(parts), between % len(parts)] = linked[between % len(parts), between // len(parts)] = True
        link = dict(zip(between.tolist(), first.tolist(), strict=True))
        kept = [link[min(x, y) * len(parts) + max(x, y)] for x, y in forest(linked)]
        pairs = [sorted((names[i[k]], names[j[k]])) for k in kept]
        return pa.table([pa.array([p[0] for p in pairs], pa.binary()), pa.array([p[1] for p in pairs], pa.binary())], ["a", "b"])

    return cells(members, classes, num, den).groupBy(*CELL).applyInArrow(tidy(test), "a binary, b binary")


def verify(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose Jaccard similarity is num / den or more."""
    sets = classes.select("class", "n", "shingles")
    left = pairs.join(sets.select(F.col("class").alias("a"), F.col("n").alias("a_n"), F.col("shingles").alias("a_s")), "a")
    both = left.join(sets.select(F.col("class").alias("b"), F.col("n").alias("b_n"), F.col("shingles").alias("b_s")), "b")

    def test(batches):
        for batch in batches:
            a, b = batch.column(0), batch.column(1)
            good = []
            for a_n, b_n, a_s, b_s in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True):
                common = len(np.intersect1d(_values(a_s), _values(b_s), assume_unique=True))
                good.append(den * common >= num * (a_n + b_n - common))
            yield pa.RecordBatch.from_arrays([a, b], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    arrow_rows(pairs.sparkSession)
    return both.select("a", "b", "a_n", "b_n", "a_s", "b_s").mapInArrow(released(test), "a binary, b binary")


# Components


def components(links: DataFrame) -> DataFrame:
    """class, component (its smallest class) of all classes that a written table of links (a, b) names.

    Labels fall to the smallest among neighbours, and then to the label of that
    label, until nothing changes: rounds grow with the logarithm of a
    component's diameter. Each round's labels are written.
    """
    both = written(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("class")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    before = labels
    while True:
        near = both.join(labels.select(F.col("class").alias("b"), "component"), "b").groupBy(F.col("a").alias("class")).agg(F.min("component").alias("near"))
        step = labels.join(near, "class").select("class", F.col("component").alias("old"), F.least("component", "near").alias("mid"))
        jump = labels.select(F.col("class").alias("mid"), F.col("component").alias("far"))
        step = written(step.join(jump, "mid").select("class", "old", F.least("mid", "far").alias("component")), "labels")
        discard(before)
        labels, before = step.select("class", "component"), step
        if step.filter("old <> component").isEmpty():
            discard(both)
            return labels


def merged(component: DataFrame, more: DataFrame) -> DataFrame:
    """The components of a written table after more links (a, b): only the graph of components is walked again."""
    of = lambda end: component.select(F.col("class").alias(end), F.col("component").alias(f"c_{end}"))
    between = more.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b"))
    joined = components(written(between.filter("a <> b").distinct(), "links")).select(F.col("class").alias("was"), F.col("component").alias("now"))
    moved = component.join(joined, F.col("component") == F.col("was"), "left").select("class", F.coalesce("now", "component").alias("component"))
    alone = joined.join(component, F.col("was") == F.col("class"), "left_anti").select(F.col("was").alias("class"), F.col("now").alias("component"))
    return moved.unionByName(alone)


# All links


def _component_cells(component: DataFrame, classes: DataFrame, copies: DataFrame, num: int, den: int) -> DataFrame:
    return cells(component.withColumnRenamed("component", "group").join(copies, "class"), classes, num, den)


def count_links(dealt: DataFrame, num: int, den: int) -> DataFrame:
    """class and links: how many documents of other classes it is linked with; pairs are never rows."""

    def test(group: pa.Table) -> pa.Table:
        copies, good = group.column("copies").to_numpy(), _links_within(group, num, den)
        return pa.table([group.column("class"), pa.array(good @ copies + good.T @ copies, pa.int64())], ["class", "links"])

    found = dealt.groupBy(*CELL).applyInArrow(tidy(test), "class binary, links long")
    return found.groupBy("class").agg(F.sum("links").alias("links"))


def link_pairs(dealt: DataFrame, num: int, den: int) -> DataFrame:
    """a < b: each link between classes once."""

    def test(group: pa.Table) -> pa.Table:
        names = group.column("class").to_pylist()
        pairs = [sorted((names[i], names[j])) for i, j in zip(*np.nonzero(_links_within(group, num, den)), strict=True)]
        return pa.table([pa.array([p[0] for p in pairs], pa.binary()), pa.array([p[1] for p in pairs], pa.binary())], ["a", "b"])

    return dealt.groupBy(*CELL).applyInArrow(tidy(test), "a binary, b binary")


def _joined(docs: DataFrame, width: int, num: int, den: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents (doc_id, n, class), classes that may have a partner, and the component of linked classes."""
    spark = docs.sparkSession
    described = written(describe(docs, width), "sets")
    sets = described.filter("hot is null").select("doc_id", "n", "class")
    totals = sets.agg(F.count("*").alias("docs"), F.sum("n").alias("shingles")).first()
    hot = most_frequent(described, totals.docs)
    buckets = max(2 * spark.sparkContext.defaultParallelism, (totals.shingles or 0) // BUCKET_ENTRIES + 1)
    classes = written(gather(share(deal(docs, width, buckets, hot), buckets), num, den), "classes")
    entries = written(index(classes, num, den), "entries")
    held = written(stars(entries), "stars")
    links = written(verify(written(star_pairs(held, num, den), "pairs"), classes, num, den), "links")
    component = components(links)
    more = written(verify_clusters(written(open_stars(held, component), "open"), classes, num, den), "links")
    if not more.isEmpty():
        component = written(merged(component, more), "labels")
    return sets, classes, component


def _named(sets: DataFrame, component: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and class: the smallest doc_id of each component, found class by class."""
    own = sets.filter("class is not null")
    first = own.groupBy("class").agg(F.min("doc_id").alias("first")).join(component, "class", "left").withColumn("component", F.coalesce("component", "class"))
    named = first.groupBy("component").agg(F.min("first").alias("component_id"))
    named = first.join(named, "component").select("class", "component_id")
    columns = ["doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "class"]
    empty = sets.filter("class is null").withColumn("component_id", F.col("doc_id"))
    return own.join(named, "class").select(*columns).unionByName(empty.select(*columns))


def _copies(sets: DataFrame) -> DataFrame:
    return sets.filter("class is not null").groupBy("class").agg(F.count("*").alias("copies"))


def join(docs: DataFrame, width: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id of every document; documents link from similarity num / den on."""
    sets, _, component = _joined(docs, width, num, den)
    return _named(sets, component).drop("class")


def join_links(docs: DataFrame, width: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """The same with n_links: how many other rows a document is linked with, those of equal sets among them."""
    sets, classes, component = _joined(docs, width, num, den)
    copies = written(_copies(sets), "copies")
    links = written(count_links(_component_cells(component, classes, copies, num, den), num, den), "link-counts")
    counted = copies.join(links, "class", "left").select("class", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    named = _named(sets, component)
    counts = named.filter("class is not null").join(counted, "class").unionByName(named.filter("class is null").withColumn("n_links", F.lit(0)))
    return counts.select("doc_id", "n_shingles", "component_id", F.col("n_links").cast("long").alias("n_links"))


def class_links(docs: DataFrame, width: int = 4, num: int = 85, den: int = 100) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, class), and all links a < b between classes; documents of one class are linked too, those without a class with nothing."""
    sets, classes, component = _joined(docs, width, num, den)
    return sets.select("doc_id", "class"), link_pairs(_component_cells(component, classes, written(_copies(sets), "copies"), num, den), num, den)


def keep_one(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The documents without those that a document of smaller doc_id of their component represents.

    Documents with an empty set stay, and so do rows that share a doc_id if one of them has to.
    """
    found = written(join(docs, width, num, den), "components")
    gone = unused_prefix(docs) + "gone"
    lost = found.groupBy("doc_id").agg(F.every(F.col("doc_id") != F.col("component_id")).alias("gone")).filter("gone").select(F.col("doc_id").alias(gone))
    return drop_ids(docs, written(lost, "lost"))
