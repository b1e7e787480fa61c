"""SentencePiece byte-pair encoding and decoding of whole texts by vectorised merge rounds.

A text becomes its normalised form (blank to U+2581, one U+2581 in front), which
is cut into words where no piece of the vocabulary can reach over. Words of a
batch that the worker has not met yet lie in one flat array of symbols. A round
looks up the rank of every adjacent pair, takes the least rank of each word
(ties: the leftmost pair), merges in all words at once and closes the gaps;
words without a pair leave the array. Words never share a merge, so one merge
per word and round, in the order of ranks, is what the library's queue does.
Rounds over one word take time with the square of its length; a word of more
than `LONG` symbols (a run of blanks, an encoded picture) is merged by a heap
in the same order instead.

Files with another model type, a normalisation table, pieces of the types
"unused" or "user defined" or pieces with a blank in the middle are refused.

Nulls and odd input: null and empty texts have the ids begin and end only;
characters outside the vocabulary become byte pieces (the unknown id where the
file has no fallback); ties of doc_id, repeated rows and null doc_ids are rows
like others; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, kept, released

BLANK = "▁"
#: Symbols from which on a word is merged by a heap.
LONG = 1024
#: Piece types, model type and field numbers of the file format: fixed values.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE = 2
NEVER = np.iinfo(np.int32).max


def fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """The fields of one protocol-buffer message: number and value (bytes, or an integer)."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        number, kind = divmod(varint(), 8)
        if kind == 0:
            yield number, varint()
            continue
        size = {1: 8, 5: 4}.get(kind)
        if size is None:
            size = varint()
        yield number, data[at : at + size]
        at += size


class Vocabulary:
    """Pieces, scores and rules of a model file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            data = f.read()
        self.pieces, scores, self.types = [], [], []
        self.blank_in_front, squeeze, self.unknown_text, kind, table = True, True, " ⁇ ", 1, b""
        for number, value in fields(data):
            if number == 1:
                piece, score, type_ = "", 0.0, NORMAL
                for k, v in fields(value):
                    if k == 1:
                        piece = v.decode()
                    elif k == 2:
                        score = float(np.frombuffer(v, "<f4")[0])
                    elif k == 3:
                        type_ = v
                self.pieces.append(piece)
                scores.append(score)
                self.types.append(type_)
            elif number == 2:
                for k, v in fields(value):
                    if k == 3:
                        kind = v
                    elif k == 44:
                        self.unknown_text = v.decode()
            elif number == 3:
                for k, v in fields(value):
                    if k == 2:
                        table = v
                    elif k == 3:
                        self.blank_in_front = bool(v)
                    elif k == 4:
                        squeeze = bool(v)
                    elif k == 5 and not v:
                        table = b"blanks stay"
        if kind != BPE or table or squeeze or {USER_DEFINED, UNUSED} & set(self.types) or any(BLANK in p.lstrip(BLANK) for p in self.pieces):
            raise ValueError("only byte-pair models without a normalisation table, with plain pieces and blanks at their beginning, are supported")
        self.unknown = self.types.index(UNKNOWN)
        self.begin, self.end = (self.pieces.index(p) for p in ("<s>", "</s>"))
        self.bytes = [i for i, t in enumerate(self.types) if t == BYTE]
        self.id_of = {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t == NORMAL}
        # Characters within pieces that are no pieces themselves are symbols of their own, with ids after the vocabulary's.
        self.symbol = {c: i for c, i in self.id_of.items() if len(c) == 1}
        for c in sorted({c for p in self.id_of for c in p} - self.symbol.keys()):
            self.symbol[c] = len(self.pieces) + len(self.symbol)
        self.n_symbols = len(self.pieces) + len(self.symbol) + 1
        # Code point -> symbol; the last symbol stands for all other characters.
        self.symbols = np.full(0x110000, self.n_symbols - 1, np.int32)
        for c, i in self.symbol.items():
            self.symbols[ord(c)] = i
        self.rank = np.full(self.n_symbols, NEVER, np.int32)
        order = {s: k for k, s in enumerate(sorted({scores[i] for i in self.id_of.values()}, reverse=True))}
        for i in self.id_of.values():
            self.rank[i] = order[scores[i]]
        found = {}
        known = self.id_of | self.symbol
        for piece, i in self.id_of.items():
            for cut in range(1, len(piece)):
                left, right = known.get(piece[:cut]), known.get(piece[cut:])
                if left is not None and right is not None:
                    found[left * self.n_symbols + right] = i
        self.pairs = found
        self.keys = np.array(sorted(found), np.int64)
        self.merged = np.array([found[k] for k in self.keys.tolist()], np.int32)

    def word_pattern(self) -> re.Pattern:
        """Runs of characters that pieces may join: blanks and what follows them; other characters stand alone."""
        joined = {c for p in self.id_of if len(p) > 1 for c in p} - {BLANK}
        ordered, ranges = sorted(map(ord, joined)), []
        for c in ordered:
            if ranges and c == ranges[-1][1] + 1:
                ranges[-1][1] = c
            else:
                ranges.append([c, c])
        inside = "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in ranges)
        return re.compile(f"{BLANK}*[{inside}]+|{BLANK}+|[\\s\\S]" if inside else f"{BLANK}+|[\\s\\S]")


class Encoder:
    """Ids of texts; words met before come from a bounded cache of two generations."""

    def __init__(self, path: str, cache_words: int = 300_000):
        self.vocabulary = Vocabulary(path)
        self.words = self.vocabulary.word_pattern().findall
        self.cap = cache_words
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.head, self.tail = (np.array([i], "<u4").tobytes() for i in (self.vocabulary.begin, self.vocabulary.end))
        v = self.vocabulary
        self.shown = [b"" if t == CONTROL else v.unknown_text.encode() if t == UNKNOWN else p.replace(BLANK, " ").encode() for p, t in zip(v.pieces, v.types, strict=True)]
        for byte, i in enumerate(v.bytes):
            self.shown[i] = bytes([byte])

    def encode(self, texts: list[str | None], ends: bool = True) -> list[bytes]:
        """Little-endian 32-bit ids of each text, between begin and end ids if asked."""
        if len(self.cache) > self.cap:
            self.old, self.cache = self.cache, {}
        cut, new = [], {}
        for text in texts:
            words = []
            if text:
                text = text.replace(" ", BLANK)
                words = self.words(BLANK + text if self.vocabulary.blank_in_front else text)
                for w in words:
                    if w not in self.cache:
                        found = self.old.get(w)
                        if found is None:
                            new[w] = None
                        else:
                            self.cache[w] = found
            cut.append(words)
        if new:
            self.cache.update(self.merge([*new]))
        lookup = self.cache.__getitem__
        out = []
        for words in cut:
            ids = b"".join(map(lookup, words))
            out.append(self.head + ids + self.tail if ends else ids)
        for w in new:
            if len(w) > 64:
                del self.cache[w]
        return out

    def merge(self, words: list[str]) -> dict[str, bytes]:
        """The ids of each word."""
        v, found = self.vocabulary, {}
        short = [w for w in words if len(w) <= LONG]
        for w in words:
            if len(w) > LONG:
                found[w] = self._ids(w, self._by_heap(self._symbols(w).tolist()))
        if short:
            sizes = np.fromiter(map(len, short), np.int64, len(short))
            symbols, number = merge_rounds(self._symbols("".join(short)), sizes, v)
            counts = np.bincount(number, minlength=len(short))
            ends = np.cumsum(counts)
            raw, cuts = symbols.astype("<u4").tobytes(), (4 * ends).tolist()
            found.update(zip(short, [raw[a:b] for a, b in zip([0, *cuts], cuts)], strict=True))
            for k in np.unique(number[symbols >= len(v.pieces)]).tolist():
                found[short[k]] = self._ids(short[k], symbols[ends[k] - counts[k] : ends[k]].tolist())
        return found

    def _symbols(self, text: str) -> np.ndarray:
        return self.vocabulary.symbols[np.frombuffer(text.encode("utf-32-le"), "<u4")]

    def _ids(self, word: str, symbols: list[int]) -> bytes:
        """Symbols outside the vocabulary are single characters: their bytes, or the unknown id."""
        v, out, at = self.vocabulary, [], 0
        for s in symbols:
            if s < len(v.pieces):
                out.append(s)
                at += len(v.pieces[s])
            else:
                out += [v.bytes[b] for b in word[at].encode()] if v.bytes else [v.unknown]
                at += 1
        return np.array(out, "<u4").tobytes()

    def _by_heap(self, symbols: list[int]) -> list[int]:
        """Merges in the order of (rank, place) over a linked list; what a merge has made void is passed over."""
        v, n = self.vocabulary, len(symbols)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] >= 0:
                made = v.pairs.get(symbols[i] * v.n_symbols + symbols[after[i]])
                if made is not None:
                    heapq.heappush(heap, (int(v.rank[made]), i, symbols[i], symbols[after[i]], made))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, left, right, made = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != left or j < 0 or symbols[j] != right:
                continue
            symbols[i], symbols[j] = made, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [s for s in symbols if s >= 0]

    def decode(self, ids: bytes) -> str:
        """The text of ids: pieces in a row, without the blank in front; byte pieces as UTF-8, wrong bytes as U+FFFD."""
        v = self.vocabulary
        numbers = np.frombuffer(ids, "<u4").tolist()
        if any(v.types[i] == CONTROL for i in numbers[1:-1]):
            return self._mended(numbers)
        raw = b"".join(map(self.shown.__getitem__, numbers))
        first = next((i for i in numbers if v.types[i] != CONTROL), None)
        if v.blank_in_front and first is not None and v.pieces[first].startswith(BLANK):
            raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return self._mended(numbers)

    def _mended(self, numbers: list[int]) -> str:
        """Decoding run by run: control ids part runs of byte pieces, and each byte that begins no character gives U+FFFD of its own."""
        v, out, run = self.vocabulary, [], bytearray()

        def flush() -> None:
            at = 0
            while at < len(run):
                for size in (1, 2, 3, 4):
                    try:
                        out.append(run[at : at + size].decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    size = 1
                    out.append("�")
                at += size
            run.clear()

        for i in numbers:
            if v.types[i] == BYTE:
                run += self.shown[i]
            elif v.types[i] == CONTROL:
                flush()
            else:
                flush()
                piece = self.shown[i].decode()
                out.append(piece[1:] if not out and v.blank_in_front and piece.startswith(" ") and v.types[i] == NORMAL else piece)
        flush()
        return "".join(out)


def merge_rounds(symbols: np.ndarray, sizes: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The symbols after all merges, word by word, and the number of each symbol's word.

    `symbols` has the words' symbols in a row, `sizes` how many each has.
    """
    number = np.repeat(np.arange(len(sizes)), sizes)
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(symbols):
        # Rank of the pair that begins at each symbol; the last of a word begins none.
        rank = np.full(len(symbols), NEVER, np.int32)
        made = np.zeros(len(symbols), np.int32)
        if len(v.keys):
            within = np.flatnonzero(number[:-1] == number[1:])
            key = symbols[within].astype(np.int64) * v.n_symbols + symbols[within + 1]
            at = np.minimum(np.searchsorted(v.keys, key), len(v.keys) - 1)
            hit = v.keys[at] == key
            within, at = within[hit], at[hit]
            made[within] = v.merged[at]
            rank[within] = v.rank[v.merged[at]]
        starts = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
        lengths = np.diff(np.r_[starts, len(symbols)])
        least = np.repeat(np.minimum.reduceat(rank, starts), lengths)
        closed = least == NEVER
        done.append((symbols[closed], number[closed]))
        # The leftmost pair of least rank of each word that goes on.
        best = np.flatnonzero((rank == least) & ~closed)
        best = best[np.r_[True, number[best][1:] != number[best][:-1]]] if len(best) else best
        symbols[best] = made[best]
        stay = ~closed
        stay[best + 1] = False
        symbols, number = symbols[stay], number[stay]
    if not done:
        return symbols, number
    symbols, number = (np.concatenate(x) for x in zip(*done, strict=True))
    order = np.argsort(number, kind="stable")
    return symbols[order], number[order]


def encoder(path: str) -> Encoder:
    """The worker's encoder for a file; workers are reused, and so is its cache."""
    return kept(("sentencepieces", path), lambda: Encoder(path))


def encode(docs: DataFrame, model_path: str, ends: bool = True) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit integers) of every whole text."""

    def run(batches):
        own = encoder(model_path)
        for batch in batches:
            ids = own.encode(batch.column(1).to_pylist(), ends)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    arrow_rows(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(released(run), "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """The columns of `encode` and decoded, the text that the ids stand for; null ids have none."""

    def run(batches):
        own = encoder(model_path)
        for batch in batches:
            texts = [None if x is None else own.decode(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])

    arrow_rows(encoded.sparkSession)
    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(released(run), "doc_id long, n_tokens long, ids binary, decoded string")


def digest(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256."""
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
