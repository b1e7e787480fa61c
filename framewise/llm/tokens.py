"""Token ids of whole texts by a public tokenizer file, with a cache of words.

For a tokenizer that drops white space and never joins what white space parts,
the ids of a text are the ids of its space-separated chunks in a row. Chunks
repeat, so each worker keeps a bounded two-generation cache of chunk -> ids and
runs the tokenizers library on chunks it has not seen. Texts for which that
isn't exact (special-token strings, the separator character) and tokenizers of
another kind go through the library whole.
"""

from __future__ import annotations

import json
import os

import numpy as np

from .common import kept

SEPARATOR = b"\x01"
#: Endings that always form a token group of their own after a letter or digit.
ENDINGS = b".,|"


class _Chunks(dict):
    """chunk -> ids as bytes; an unseen chunk gets a bytearray that `fill` completes."""

    def __init__(self):
        super().__init__()
        self.old: dict = {}
        self.pending: list = []

    def __missing__(self, chunk):
        found = self.old.get(chunk)
        if found is None:
            found = bytearray()
            self.pending.append((chunk, found))
        self[chunk] = found
        return found


class WordTokenizer:
    """Encodes texts to little-endian ids (2 bytes where the vocabulary allows, else 4)."""

    def __init__(self, path: str, cache_chunks: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 65536 else "<u4")
        self.cap = cache_chunks
        self.cache = _Chunks()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"].encode() for t in spec.get("added_tokens") or ()]
        self.chunked = self._drops_spaces(spec)
        if self.chunked:
            separator = self._ids(SEPARATOR.decode())
            self.chunked = len(separator) == 1
            self.separator = int(separator[0])
            self.ending = {c: self._ids(chr(c)).tobytes() for c in ENDINGS}

    @staticmethod
    def _drops_spaces(spec: dict) -> bool:
        """Whether the file lower-cases and splits into groups of letters, digits and others, removing white space."""
        text = json.dumps([spec.get("normalizer"), spec.get("pre_tokenizer")])
        return all(x in text for x in ('"Lowercase"', '"Removed"', '"invert": true', r"[^\\s\\p{L}\\p{N}]+", '"use_regex": false')) and spec.get("post_processor") is None

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """The ids of each UTF-8 text; null counts as empty."""
        cache, out = self.cache, []
        if self.chunked and len(cache) > self.cap:
            cache.old = dict(cache)
            cache.clear()
        lookup = cache.__getitem__
        for text in texts:
            if not text:
                out.append(b"")
            elif self.chunked and SEPARATOR not in text and not any(s in text for s in self.special):
                low = text.lower()
                if low is text or not any(s in low for s in self.special):
                    out.append([*map(lookup, low.split())])
                else:
                    out.append(self._ids(text.decode()).tobytes())
            else:
                out.append(self._ids(text.decode()).tobytes())
        if cache.pending:
            self._fill()
        return [x if isinstance(x, bytes) else b"".join(x) for x in out]

    def _fill(self) -> None:
        """Ids for the chunks that this batch met first; a plain ending is cut off, so that stems are shared."""
        cache, pending, stems, todo, long = self.cache, self.cache.pending, {}, {}, []
        cache.pending = []
        for chunk, target in pending:
            stem = chunk[:-1]
            if chunk[-1] in ENDINGS and stem and (stem.isalnum() or self._letters(stem)):
                stems[chunk] = stem
                if not cache.get(stem):
                    todo.setdefault(stem, None)
            else:
                todo[chunk] = target
        cache.pending = []
        names = [*todo]
        for k in range(0, len(names), 500):
            part = names[k : k + 500]
            ids = self._ids((b" " + SEPARATOR + b" ").join(part).decode())
            cuts = np.flatnonzero(ids == self.separator) * ids.itemsize
            raw = ids.tobytes()
            for chunk, start, end in zip(part, [0, *(cuts + ids.itemsize).tolist()], [*cuts.tolist(), len(raw)], strict=True):
                found = raw[start:end]
                if todo[chunk] is not None:
                    todo[chunk][:] = found
                cache[chunk] = found
                if len(chunk) > 64:
                    long.append(chunk)
        for chunk, target in pending:
            if chunk in stems:
                found = bytes(cache[stems[chunk]]) + self.ending[chunk[-1]]
                target[:] = found
                cache[chunk] = found
                if len(chunk) > 64:
                    long.append(chunk)
        for chunk in long:
            cache.pop(chunk, None)

    @staticmethod
    def _letters(stem: bytes) -> bool:
        text = stem.decode()
        return text.isalpha() and max(text) < "ƀ"


def tokenizer(path: str, cache_chunks: int = 300_000) -> WordTokenizer:
    """The worker's tokenizer for a file; workers are reused, and so is its cache."""
    return kept((path, cache_chunks), lambda: WordTokenizer(path, cache_chunks))
