"""Repair of conversations' structure by composing weighted finite-state machines.

The rows of a conversation, in the order of their turns, are the input acceptor.
The edit transducer keeps a row (0), gives it another role (3), deletes it (4;
blank and repeated rows must go) or inserts one without text (3); a row whose
text breaks off costs 3 more unless deleted. The role grammar accepts the
initials `(s?(ua)+)?`. The machines are composed as the path goes along: a state
is (row, insertions since that row, state of the grammar), and as every state of
the grammar allows one inserted role, two insertions between rows are all that
can help, which makes the states' order topological. Weights are pairs (cost,
string of edit initials), compared in that order: of the cheapest repairs the
least string is taken. Two strings of the same cost for the same rows are never
one the beginning of the other (what follows would be insertions, which cost),
so the least stays the least when both go on, and paths over parts of a
conversation can be joined.

Rows are sorted by one range shuffle, which cuts a long conversation into as
many parts as it takes. A conversation that a task sees whole, in at most `CUT`
rows, is solved there. Of others each task composes segments: for every pair of
grammar states the least weight. Segments are joined in order, one
conversation at a time, holding its strings of edits (a byte a row) but no
texts; the texts are repaired segment by segment and hashed as a stream.

Nulls and odd input: a null role or text is one space, as is a null in the key
that decides a row's damage; null turns come first; ties of turn are ordered by
role and text; equal rows are counted before they are shuffled, and all but the
first are repetitions; a role without characters fits nowhere; null conv_ids are
one conversation; a conversation without rows has zeros, an empty audit and the
hash of nothing; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, released, written

#: Rows and characters of text in one segment.
CUT, CUT_CHARS = 1024, 4_000_000
WHITE = " \t\n\x0b\x0c\r"
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
#: Costs of edits, and what a truncated row that stays adds.
RE_ROLE, DELETE, INSERT, STAYS_TRUNCATED = 3, 4, 3, 3
#: The grammar's states: start, after s, after u, after a; start and after a accept.
KEPT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
#: The one role that each state allows among user and assistant, and where it leads.
GIVEN, NEXT = ("user", "user", "assistant", "user"), (2, 2, 3, 2)
ACCEPTS = (0, 3)
LEGAL = {"su", "ua", "au"}

Weight = tuple[int, bytes]


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role and text after the damage that crc32 of `conv_id:turn` decides; one row of 20 for each kind."""
    space = F.lit(" ")
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")])
    kind = (F.crc32(key.cast("binary")) % 20).cast("int")
    said = turns.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), kind.alias("kind"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.array_repeat(F.lit(0), F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1))
    return said.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("_")).drop("_")


def classified(turns: DataFrame) -> DataFrame:
    """Distinct rows with their number and the fault of the first; sorted by conversation and turn over partitions."""
    own = [F.col("conv_id").isNull().alias("no_conv"), F.coalesce(F.col("conv_id"), F.lit(0)).cast("long").alias("conv"), F.col("turn").isNotNull().alias("has_turn"), F.coalesce(F.col("turn"), F.lit(0)).cast("long").alias("turn")]
    space = F.lit(" ")
    said = turns.select(*own, F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    same = ["no_conv", "conv", "role", "said"]
    said = said.withColumn("said", F.sha2(F.col("text").cast("binary"), 256))
    rows = said.groupBy(*same, "has_turn", "turn").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    # Where a role and text are said first: digests only.
    first = said.groupBy(*same).agg(F.min(F.struct("has_turn", "turn")).alias("first"))
    first = first.select(*same, F.col("first.has_turn").alias("has_turn"), F.col("first.turn").alias("turn"), F.lit(True).alias("is_first"))
    end = F.rtrim(F.col("text"), F.lit(WHITE))
    fault = F.when(end == "", BLANK).when(F.col("is_first").isNull(), DUPLICATE).when(~F.right(end, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(NONE)
    found = rows.join(first, [*same, "has_turn", "turn"], "left").select("no_conv", "conv", "has_turn", "turn", "role", "text", "copies", fault.alias("fault"))
    order = ["no_conv", "conv", "has_turn", "turn", "role", "text"]
    return found.repartitionByRange(*order).sortWithinPartitions(*order)


# Entries of a segment: (initial, must go, stays at a cost).
Entry = tuple[str, bool, bool]


def inserted(best: dict[int, Weight]) -> dict[int, Weight]:
    """Weights after no, one or two insertions; a third leads back to a state at a higher cost."""
    found, last = dict(best), best
    for _ in range(2):
        new: dict[int, Weight] = {}
        for state, (cost, edits) in last.items():
            to, weight = NEXT[state], (cost + INSERT, edits + b"I")
            if to not in new or weight < new[to]:
                new[to] = weight
        for to, weight in new.items():
            if to not in found or weight < found[to]:
                found[to] = weight
        last = new
    return found


def compose(entries: list[Entry], start: int) -> dict[int, Weight]:
    """The least weight from a state of the grammar before the rows to each one after them."""
    best: dict[int, Weight] = {start: (0, b"")}
    for initial, must_go, late in entries:
        more = STAYS_TRUNCATED if late else 0
        kept = {} if must_go else KEPT.get(initial, {})
        found: dict[int, Weight] = {}
        for state, (cost, edits) in inserted(best).items():
            arcs = [(state, (cost + DELETE, edits + b"D"))]
            if not must_go:
                arcs.append((NEXT[state], (cost + RE_ROLE + more, edits + b"R")))
                if state in kept:
                    arcs.append((kept[state], (cost + more, edits + b"K")))
            for to, weight in arcs:
                if to not in found or weight < found[to]:
                    found[to] = weight
        best = found
    return best


def finished(best: dict[int, Weight]) -> tuple[int, bytes, int]:
    """The cheapest way to an accepting state, insertions at the end included: cost, edits, and the state before these insertions."""
    ways = []
    for state, weight in best.items():
        end = inserted({state: weight})
        ways += [(*end[to], state) for to in ACCEPTS if to in end]
    return min(ways)


def repaired(said: list[tuple[str, str | None]], edits: bytes, state: int) -> list[str]:
    """`role:text` of each row after the edits, which begin in a state of the grammar."""
    out, rows = [], iter(said)
    for edit in edits.decode():
        if edit == "I":
            out.append(f"{GIVEN[state]}:")
            state = NEXT[state]
            continue
        role, text = next(rows)
        if edit == "R":
            out.append(f"{GIVEN[state]}:{text}")
            state = NEXT[state]
        elif edit == "K":
            out.append(f"{role}:{text}")
            state = KEPT[role[0]][state]
    return out


class Counts:
    """What is counted over rows in order; counts of parts in a row can be joined."""

    NAMES = ("blank", "duplicate", "truncated", "illegal", "turns", "least", "most", "first", "last")

    def __init__(self):
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.least = self.most = self.first = self.last = None

    def add(self, initial: str, fault: int, turn: int | None) -> None:
        self.blank += fault == BLANK
        self.duplicate += fault == DUPLICATE
        self.truncated += fault == TRUNCATED
        self.follow(initial, initial)
        if turn is not None:
            self.turns += turn != self.most
            self.least = turn if self.least is None else self.least
            self.most = turn

    def follow(self, first: str, last: str) -> None:
        if self.last is not None:
            self.illegal += self.last + first not in LEGAL
        else:
            self.first = first
        self.last = last

    def join(self, next_: dict) -> None:
        """Take in the counts of the part that follows."""
        for name in ("blank", "duplicate", "truncated", "illegal"):
            setattr(self, name, getattr(self, name) + next_[name])
        self.follow(next_["first"], next_["last"])
        if next_["least"] is not None:
            self.turns += next_["turns"] - (next_["least"] == self.most)
            self.least = next_["least"] if self.least is None else self.least
            self.most = next_["most"]

    def gaps(self) -> int:
        return 0 if self.least is None else self.most - self.least + 1 - self.turns

    def row(self) -> dict:
        return {name: getattr(self, name) for name in self.NAMES}


RESULT = "no_conv boolean, conv long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
PART = "least long, most long, turns long, first string, last string, paths array<struct<start:int,end:int,cost:long,edits:string>>, said array<struct<role:string,text:string>>"
SEGMENTS = f"{RESULT}, at long, whole boolean, {PART}"
_long, _str = pa.int64(), pa.string()
_RESULT = [("no_conv", pa.bool_()), ("conv", _long), *[(n, _long) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", _str), ("repaired_sha256", _str)]
_PATHS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", _long), ("edits", _str)]))
_SAID = pa.list_(pa.struct([("role", _str), ("text", _str)]))
_SEGMENTS = pa.schema([*_RESULT, ("at", _long), ("whole", pa.bool_()), ("least", _long), ("most", _long), ("turns", _long), ("first", _str), ("last", _str), ("paths", _PATHS), ("said", _SAID)])


class Segment:
    """Rows of one conversation that follow each other in a task."""

    def __init__(self, at: int, opens: bool):
        #: Its place, and whether the conversation's first row is known to be in it.
        self.at, self.opens = at, opens
        self.entries: list[Entry] = []
        self.said: list[tuple[str, str | None]] = []
        self.counts, self.chars = Counts(), 0

    def add(self, role: str, text: str, fault: int, turn: int | None) -> None:
        must_go = fault in (BLANK, DUPLICATE)
        self.entries.append((role[:1], must_go, fault == TRUNCATED))
        self.said.append((role, None if must_go else text))
        self.chars += 0 if must_go else len(text)
        self.counts.add(role[:1], fault, turn)

    def full(self) -> bool:
        return len(self.entries) >= CUT or self.chars >= CUT_CHARS

    def row(self, conv: tuple[bool, int], whole: bool) -> dict:
        base = {"no_conv": conv[0], "conv": conv[1], "at": self.at, "whole": whole, **self.counts.row()}
        if whole:
            cost, edits, _ = finished(compose(self.entries, 0))
            text = "\n".join(repaired(self.said, edits, 0))
            return base | {"gaps": self.counts.gaps(), "cost": cost, "audit": edits.decode(), "repaired_sha256": hashlib.sha256(text.encode()).hexdigest()}
        starts = [0] if self.opens else range(4)
        paths = [{"start": s, "end": e, "cost": c, "edits": x.decode()} for s in starts for e, (c, x) in compose(self.entries, s).items()]
        return base | {"paths": paths, "said": [{"role": r, "text": t} for r, t in self.said]}


def _segments(rows: Iterator[dict], part: int) -> Iterator[dict]:
    """Segments of a task's sorted rows; those at the task's edges may go on elsewhere."""
    own, conv, n = None, None, part << 33
    edge = True
    for r in rows:
        if conv != (r["no_conv"], r["conv"]):
            if own:
                yield own.row(conv, own.opens)
            edge = conv is None
            conv, own = (r["no_conv"], r["conv"]), Segment(n, not edge)
        fault, turn = r["fault"], r["turn"] if r["has_turn"] else None
        for copy in range(r["copies"]):
            if own.full():
                yield own.row(conv, False)
                own = Segment(n, False)
            own.add(r["role"], r["text"], DUPLICATE if copy and fault != BLANK else fault, turn)
            n += 1
    if own:
        yield own.row(conv, False)


def segments(rows: DataFrame) -> DataFrame:
    """Results of the conversations that a task sees whole, and segments with their paths of the others; written."""

    def run(batches):
        listed = (r for batch in batches for r in batch.to_pylist())
        yield from _batched(_segments(listed, TaskContext.get().partitionId()), _SEGMENTS, 64)

    return written(rows.mapInArrow(released(run), SEGMENTS), "repair-segments")


def _batched(rows: Iterator[dict], schema: pa.Schema, size: int) -> Iterator[pa.RecordBatch]:
    out: list[dict] = []
    for row in rows:
        out.append({name: row.get(name) for name in schema.names})
        if len(out) == size:
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


_CHOSEN = pa.schema([*_RESULT, ("at", _long), ("state", pa.int32()), ("edits", _str)])
CHOSEN = f"{RESULT}, at long, state int, edits string"


def _joined(parts: Iterator[dict]) -> Iterator[dict]:
    """Each segment's edits on the conversation's best path, and with the last one the conversation's result, from sorted segments."""

    def solve(conv, best, counts):
        ways = {state: weight for state, (weight, _) in best.items()}
        cost, edits, state = finished(ways)
        result = counts.row() | {"no_conv": conv[0], "conv": conv[1], "gaps": counts.gaps(), "cost": cost, "audit": edits.decode()}
        tail, chain = edits[len(ways[state][1]) :].decode(), best[state][1]
        while chain:
            chain, at, start, own = chain
            yield result | {"at": at, "state": start, "edits": own + tail}
            result, tail = {"no_conv": conv[0], "conv": conv[1]}, ""

    conv, best, counts = None, {}, None
    for p in parts:
        if conv != (p["no_conv"], p["conv"]):
            if conv:
                yield from solve(conv, best, counts)
            conv, best, counts = (p["no_conv"], p["conv"]), {0: ((0, b""), None)}, Counts()
        counts.join(p)
        found: dict = {}
        for path in p["paths"]:
            if path["start"] in best:
                (cost, edits), chain = best[path["start"]]
                weight = (cost + path["cost"], edits + path["edits"].encode())
                if path["end"] not in found or weight < found[path["end"]][0]:
                    found[path["end"]] = weight, (chain, p["at"], path["start"], path["edits"])
        best = found
    if conv:
        yield from solve(conv, best, counts)


def _hashed(pieces: Iterator[dict]) -> Iterator[dict]:
    """The hash of each conversation from its segments' texts in order."""
    conv, state, begun = None, None, False
    for p in pieces:
        if conv != (p["no_conv"], p["conv"]):
            if conv:
                yield {"no_conv": conv[0], "conv": conv[1], "repaired_sha256": state.hexdigest()}
            conv, state, begun = (p["no_conv"], p["conv"]), hashlib.sha256(), False
        if p["piece"] is not None:
            state.update(b"\n" + p["piece"] if begun else p["piece"])
            begun = True
    if conv:
        yield {"no_conv": conv[0], "conv": conv[1], "repaired_sha256": state.hexdigest()}


def long_conversations(parts: DataFrame) -> DataFrame:
    """Results of the conversations that are cut into segments."""
    conv = ["no_conv", "conv"]

    def join(batches):
        yield from _batched(_joined(r for b in batches for r in b.to_pylist()), _CHOSEN, 64)

    def mend(batches):
        for batch in batches:
            pieces = []
            for r in batch.to_pylist():
                lines = repaired([(s["role"], s["text"]) for s in r["said"]], r["edits"].encode(), r["state"])
                pieces.append("\n".join(lines).encode() if lines else None)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(3)], pa.array(pieces, pa.binary())], ["no_conv", "conv", "at", "piece"])

    def hash_(batches):
        schema = pa.schema([("no_conv", pa.bool_()), ("conv", _long), ("repaired_sha256", _str)])
        yield from _batched(_hashed(r for b in batches for r in b.to_pylist()), schema, 1024)

    ways = parts.select(*conv, "at", *Counts.NAMES, "paths").repartition(*conv).sortWithinPartitions(*conv, "at")
    chosen = written(ways.mapInArrow(released(join), CHOSEN), "repair-chosen")
    # A segment's place is its own, so no key of this join is common.
    texts = parts.select(*conv, "at", "said").join(chosen.select("at", "state", "edits"), "at").select(*conv, "at", "said", "state", "edits")
    pieces = texts.mapInArrow(released(mend), "no_conv boolean, conv long, at long, piece binary")
    hashes = pieces.repartition(*conv).sortWithinPartitions(*conv, "at").mapInArrow(released(hash_), "no_conv boolean, conv long, repaired_sha256 string")
    return chosen.where("cost is not null").drop("at", "state", "edits", "repaired_sha256").join(hashes, conv)


def repair(turns: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of each conversation.

    Conversations of `every` (a table with conv_id) that have no row come with zeros.
    """
    arrow_rows(turns.sparkSession)
    found = segments(classified(turns))
    names = ["no_conv", "conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    done = found.where("whole").select(names).unionByName(long_conversations(found.where("not whole")).select(names))
    asked = (turns if every is None else every).select(F.col("conv_id").isNull().alias("no_conv"), F.coalesce(F.col("conv_id"), F.lit(0)).cast("long").alias("conv")).distinct()
    out = asked.join(done, ["no_conv", "conv"], "left")
    return out.select(F.when(~F.col("no_conv"), F.col("conv")).alias("conv_id"), *[_or(n, F.lit(0).cast("long")) for n in names[2:8]], _or("audit", F.lit("")), _or("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())))


def _or(name: str, value: Column) -> Column:
    return F.coalesce(F.col(name), value).alias(name)
