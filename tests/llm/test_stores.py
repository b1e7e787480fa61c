"""Token files, packing, archives, chat, search, mixing and the pipeline: round trips and brute force."""

import hashlib
import io
import math
import os
import random
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from compare import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from framewise.llm import chat, mixing, packing, queries, token_store, topk, toxicity, warc
from framewise.llm.elias_fano import EliasFano
from framewise.llm.tokens import WordTokenizer

SF = "/root/testdata/sf0.001"
PATH = queries.tokenizer_path()


@given(st.lists(st.integers(0, 10**6), max_size=1500))
@settings(max_examples=30, deadline=None)
def test_elias_fano_gives_back_its_values(gaps):
    values = np.cumsum(np.array(gaps, np.uint64)).astype(np.uint64)
    coded = EliasFano.encode(values)
    assert coded.values().tolist() == values.tolist()
    if len(values):
        i = len(values) // 2
        assert coded[i] == values[i]


def test_elias_fano_is_small():
    ends = np.cumsum(np.random.default_rng(1).integers(1, 2000, 20_000))
    assert EliasFano.encode(ends).bits() <= 20_000 * (2 + math.log2(ends[-1] / 20_000) + 1)


def whole_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_cached_tokens_equal_the_library(documents):
    texts = [r.text for r in documents.collect()]
    texts += ["", " ", "a" * 3000 + " b", "x\x01y", "<|endoftext|> Hi", "<|ENDOFTEXT|>", "DON'T it's we'll", "É é, ñ.", "...,, .", "Straße İstanbul ΣΑΣ Σ.", "12345 9,", "a\u0085b", "日本語, テスト.", "…, x….", "é, a b"]
    tok = WordTokenizer(PATH, 500)
    for _ in range(2):
        for k in range(0, len(texts), 40):
            some = texts[k : k + 40]
            assert [np.frombuffer(b, tok.dtype).tolist() for b in tok.encode([t.encode() for t in some])] == whole_ids(some)


def test_token_files_round_trip(spark, documents, edge, nothing):
    for df in (documents, edge):
        pairs = sorted(((r.doc_id, r.text or "") for r in df.collect()), key=lambda p: (p[0] is not None, p[0] or 0, p[1]))
        ids = [x + [1] for x in whole_ids([t for _, t in pairs])]
        want, start = [], 0
        for (doc_id, _), x in zip(pairs, ids, strict=True):
            want.append((doc_id, start, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
            start += len(x)
        files = token_store.write_corpus(df, PATH)
        assert sorted(rows(token_store.read_corpus(files)), key=lambda r: r[1]) == want
    one = token_store.TokenFile(files.orderBy(F.desc("before")).first().uri)
    own = [*one.documents()]
    assert [(one.doc_id(i), one.document(i).tolist()) for i in range(one.footer["n_docs"])] == [(d, x.tolist()) for d, _, x in own]
    assert token_store.read_corpus(token_store.write_corpus(nothing, PATH)).count() == 0


@given(st.lists(st.integers(1, 60), max_size=200), st.integers(10, 60))
@settings(max_examples=60, deadline=None)
def test_a_plan_seats_every_item_once(lengths, capacity):
    lengths = [min(n, capacity) for n in lengths]
    slots = packing.plan(dict(Counter(lengths)), capacity)
    used, places = defaultdict(int), defaultdict(list)
    by_length = defaultdict(list)
    for s in slots:
        by_length[s[0]].append(s)
    for n, count in Counter(lengths).items():
        own = by_length[n]
        assert own[0][1] == 0
        for rank in range(count):
            _, first, base, each, offset = max((s for s in own if s[1] <= rank), key=lambda s: s[1])
            seat = base + (rank - first) // each
            places[seat].append((offset + (rank - first) % each * n, n))
            used[seat] += n
    for own in places.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= capacity
    assert len(places) >= fewest_bound(lengths, capacity)
    third = capacity // 3
    if all(n > third for n in lengths):
        assert len(places) == pairs_of_large(lengths, capacity)


def fewest_bound(lengths, capacity):
    """No packing needs fewer bins: by volume, and by the pairing of what is over a third."""
    return max(-(-sum(lengths) // capacity), pairs_of_large([n for n in lengths if n > capacity // 3], capacity))


def pairs_of_large(lengths, capacity):
    """Bins of items over a third of the capacity, at most two in each: the largest with the smallest if they fit."""
    left, bins = sorted(lengths), 0
    while left:
        a = left.pop()
        if left and a + left[0] <= capacity:
            left.pop(0)
        bins += 1
    return bins


def fewest(lengths, capacity):
    """The least number of bins by exhaustive search."""
    best = len(lengths)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for k in {used: k for k, used in enumerate(bins)}.values():
            if bins[k] + lengths[i] <= capacity:
                bins[k] += lengths[i]
                place(i + 1, bins)
                bins[k] -= lengths[i]
        bins.append(lengths[i])
        place(i + 1, bins)
        bins.pop()

    lengths = sorted(lengths, reverse=True)
    place(0, [])
    return best


@given(st.lists(st.integers(1, 60), max_size=9), st.integers(10, 60))
@settings(max_examples=200, deadline=None)
def test_a_plan_is_near_the_exhaustive_one(lengths, capacity):
    lengths = [min(n, capacity) for n in lengths]
    slots = packing.plan(dict(Counter(lengths)), capacity)
    bins = set()
    for n, count in Counter(lengths).items():
        own = [s for s in slots if s[0] == n]
        for rank in range(count):
            _, first, base, each, _ = max((s for s in own if s[1] <= rank), key=lambda s: s[1])
            bins.add(base + (rank - first) // each)
    best = fewest(lengths, capacity)
    assert best <= len(bins) <= best + 1
    assert len(bins) == best or best > 2


def test_packing_holds_all_ids(spark, documents, edge, nothing):
    for df in (documents, edge):
        found = packing.pack_documents(df, PATH, 512).collect()
        tokens = Counter()
        for r in df.collect():
            (x,) = whole_ids([r.text or ""])
            x.append(1)
            tokens.update((r.doc_id, p, s, len(x[s : s + 512]), zlib.crc32(np.array(x[s : s + 512], "<u4").tobytes())) for p, s in enumerate(range(0, len(x), 512)))
        assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == tokens
        at = defaultdict(list)
        for r in found:
            at[r.sequence_id].append((r.offset, r.length))
        assert all(sorted(v)[k][0] == sum(n for _, n in sorted(v)[:k]) for v in at.values() for k in range(len(v)))
        assert max(sum(n for _, n in v) for v in at.values()) <= 512
    assert packing.pack_documents(nothing, PATH).count() == 0


def test_archives_round_trip(spark):
    body = "x" * 1500
    data = [(1, "http://a", body, 0), (2, None, body, 0), (9, "http://é/\n", body, 0), (9, "http://b", body, 0), (3, "u", "short", 0), (4, "u", "short", 0), (5, "u", None, 0), (None, "u", body, 0)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string, winner int")
    got = rows(warc.read_archives(warc.write_archives(pages)))
    sha = lambda t: hashlib.sha1(t.encode()).hexdigest()
    want = [(1, 1500, sha(body), "revisit", 9), (2, 1500, sha(body), "revisit", 9), (9, 1500, sha(body), "response", None), (9, 1500, sha(body), "revisit", 9), (None, 1500, sha(body), "revisit", 9)]
    want += [(3, 5, sha("short"), "response", None), (4, 5, sha("short"), "response", None), (5, 0, sha(""), "response", None)]
    assert Counter(got) == Counter(want)
    assert warc.read_archives(warc.write_archives(pages.filter("page_id = 77"))).count() == 0


def test_an_archive_cut_between_members_is_noticed(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "a"), (2, "u", "b")], "page_id long, url string, html string").coalesce(1)
    files = warc.write_archives(pages, f"file://{tmp_path}/archives")
    assert warc.read_archives(files).count() == 2
    path = files.first().uri.removeprefix("file://")
    with open(path, "rb") as f:
        data = f.read()
    ends, rest = [], data
    while rest:
        unpacker = zlib.decompressobj(31)
        unpacker.decompress(rest)
        rest = unpacker.unused_data
        ends.append(len(data) - len(rest))
    assert len(ends) == 3
    with open(path, "wb") as f:
        f.write(data[: ends[1]])
    with pytest.raises(Exception, match="1 records of 2"):
        warc.read_archives(files).count()


def plain_records(path):
    """A reader of its own: all members of a file at once, headers and blocks by Content-Length."""
    import gzip

    data, at = gzip.open(path).read(), 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode("ascii").split("\r\n")
        assert version == "WARC/1.1"
        headers = dict(x.split(": ", 1) for x in lines)
        at = end + 4 + int(headers["Content-Length"])
        assert data[at : at + 4] == b"\r\n\r\n"
        yield headers, data[end + 4 : at]
        at += 4


def test_archives_read_by_another_reader(spark):
    long = "é" * 3_000_000
    data = [(1, "http://a/é x\n", long, 0), (2, "http://b", long, 0), (2, "http://b", long, 0), (2, "http://a", long, 0), (3, "u", "short", 0), (3, "u", "short", 0), (None, None, long, 0)]
    files = warc.write_archives(spark.createDataFrame(data, "page_id long, url string, html string, first int"), date="2020-01-02T03:04:05Z")
    found = [r for f in files.collect() for r in plain_records(f.uri.removeprefix("file://"))]
    assert all(h["WARC-Date"] == "2020-01-02T03:04:05Z" and len(h["WARC-Record-ID"]) == 47 for h, _ in found)
    ids = [h["WARC-Record-ID"] for h, _ in found]
    assert len({*ids}) == len(ids)
    pages = [(h, b) for h, b in found if h["WARC-Type"] != "warcinfo"]
    full = [h for h, b in pages if b == long.encode()]
    assert len(pages) == len(data) and len(full) == 1 and full[0]["X-Page-ID"] == "2" and full[0]["WARC-Target-URI"] == "http://a"
    revisits = [h for h, _ in pages if h["WARC-Type"] == "revisit"]
    assert sorted(h.get("X-Page-ID", "") for h in revisits) == ["", "1", "2", "2"]
    assert {h["WARC-Refers-To"] for h in revisits} == {full[0]["WARC-Record-ID"]} and {h["WARC-Payload-Digest"] for h in revisits} == {full[0]["WARC-Payload-Digest"]}
    assert [h["WARC-Target-URI"] for h in revisits if h.get("X-Page-ID") == "1"] == ["http://a/%C3%A9%20x%0A"]
    assert Counter(rows(warc.read_archives(files), "page_id", "payload_bytes", "refers_to")) == Counter([(3, 5, None)] * 2 + [(2, 6_000_000, None)] + [(p, 6_000_000, 2) for p in (1, 2, 2, None)])


def test_a_revisit_without_its_response_is_noticed(spark, tmp_path):
    sha = hashlib.sha1(b"x").hexdigest()
    path = tmp_path / "a.warc.gz"
    path.write_bytes(warc.page_record("<urn:uuid:1>", "2020-01-01T00:00:00Z", 1, "u", b"", sha, "<urn:uuid:2>"))
    with pytest.raises(Exception, match="a revisit names no response"):
        warc.read_archives(spark.createDataFrame([(f"file://{path}",)], "uri string")).collect()


def test_damaged_archives_are_noticed():
    record = lambda body: warc.page_record("<urn:uuid:1>", "2020-01-01T00:00:00Z", 1, "u", body, hashlib.sha1(b"hello").hexdigest(), None)
    good = record(b"hello")
    assert [b for _, b in warc.records(io.BytesIO(good * 3))] == [b"hello"] * 3
    bad = record(b"hallo")
    for data in (good[:-5], bad, warc.member([("WARC-Type", "response")], b"")[:20]):
        with pytest.raises((warc.DamagedArchive, zlib.error)):
            [*warc.records(io.BytesIO(data))]


CHATS = [
    (1, 0, "user", "a <|im_end|> b"), (1, 1, "user", "<\\|x [INST]"), (1, 2, "assistant", "<"), (1, 3, "assistant", "|im_sep|>"), (1, 4, "system", None), (1, 4, "system", None), (1, 5, None, "t"),
    (4, 0, "user", "<|x"), (4, 0, "user", "<a"), (4, 0, "assistant", "[INST] z"), (4, 0, "assistant", "[A"), (5, 0, "assistant", "wörd " * 200_000), (5, 1, "user", "<|im_end|>" * 10_000),
    (2, 3, "assistant", "late"), (2, None, "user<|im_body|>", "early é"), (3, 0, "assistant", ""), (None, 1, "user", "lost"),
]


def test_chats_are_read_back(spark):
    turns = spark.createDataFrame([(*r, 7) for r in CHATS], "conv_id long, turn long, role string, text string, formatted int")
    formatted = chat.format_chat(turns)
    by_conv = defaultdict(list)
    for c, t, role, text in CHATS:
        by_conv[c].append((t is not None, t or 0, role or "", text or ""))
    for r in chat.digest(formatted).collect():
        own = [(role, text) for *_, role, text in sorted(by_conv[r.conv_id])]
        assert r.n_turns == len(own)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
        loss = "".join(b for a, b in own if a == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for r in formatted.collect():
        assert r.formatted_chars if hasattr(r, "formatted_chars") else r.formatted.count(chat.START) == r.formatted.count(chat.END)
    assert chat.digest(chat.format_chat(turns.filter("conv_id = 99"))).count() == 0


@pytest.mark.parametrize("other", ["user", "assistant"])
def test_long_conversations_take_time_in_proportion(spark, other):
    def seconds(n):
        role = F.when(F.col("id") % 2 == 0, other).otherwise("assistant")
        turns = spark.range(0, n, 1, 2).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.concat(F.repeat(F.lit("abcdé"), 100), F.col("id").cast("string")).alias("text"))
        begun = time.perf_counter()
        (found,) = chat.digest(chat.format_chat(turns)).collect()
        assert found.n_turns == n and found.loss_chars == sum(500 + len(str(i)) for i in range(n) if other == "assistant" or i % 2)
        return time.perf_counter() - begun

    seconds(100)
    seconds(4000)
    short = min(seconds(4000), seconds(4000))
    assert min(seconds(8000), seconds(8000)) <= 2.5 * short + 0.5


def test_search_equals_brute_force(spark):
    r = random.Random(4)
    data = [(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(300)] + [(i, [0.5] * 8) for i in range(300, 330)]
    odd = [(1000, None), (1001, [None] + [0.1] * 7), (1002, [float("nan")] + [0.1] * 7), (1003, [float("inf")] + [0.1] * 7), (None, [0.1] * 8), (1005, [0.25] * 3), (1010, [])]
    rows_ = spark.createDataFrame([(*x, "q") for x in data + odd], "vec_id long, embedding array<float>, rank string")
    vectors = {i: np.floor(64 * np.array(v, np.float32).astype(float)).astype(int) for i, v in data}
    vectors |= {1005: np.array([16] * 3 + [0] * 5), 1010: np.zeros(8, int)}
    want = []
    for q in (i for i in vectors if i % 10 == 0):
        best = sorted(((-int(vectors[q] @ v), i) for i, v in vectors.items() if i != q))[:7]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    for block, first in ((64, 1), (1000, 2), (7, 0)):
        got = topk.search(rows_, F.col("vec_id") % 10 == 0, 7, pivots=5, block=block, query_block=8, first_blocks=first, held=3)
        assert rows(got, "query_id", "rank", "vec_id", "score") == sorted(want)
    assert topk.search(rows_.filter("vec_id = -5"), F.lit(True)).count() == 0
    assert topk.search(rows_.filter("vec_id < 3"), F.col("vec_id") == 0).count() == 2


def test_pivots_stop_the_search_early():
    r = np.random.default_rng(2)
    centres = r.integers(-60, 60, (20, 16))
    x = (centres[r.integers(0, 20, 4000)] + r.integers(-2, 3, (4000, 16))).astype(np.int64)
    pivots = topk.spread_out(x[:500], 32)
    far = np.sqrt(((x[:, None] - pivots[None]) ** 2).sum(2)).astype(np.float32)
    best = topk.Best(50, 10)
    assert topk.search_block(best, np.arange(50), x[:50], far[:50], np.arange(4000), x, far) < 50 * 4000 / 2


def test_far_pivots_skip_nothing(spark):
    """Vectors along the direction of a pivot a million times as far, where the bound is tight."""
    r = np.random.default_rng(5)
    x = r.integers(-64, 65, (600, 1)) + r.integers(-1, 2, (600, 64))
    x[0] = 64_000_000
    df = spark.createDataFrame([(i, [float(c) / 64 for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = topk.search(df, F.col("vec_id") % 7 == 1, 20, pivots=3, block=600)
    want = []
    for q in range(1, 600, 7):
        scores = x @ x[q]
        near = sorted((i for i in range(600) if i != q), key=lambda i: (-scores[i], i))[:20]
        want += [(q, k + 1, i, int(scores[i])) for k, i in enumerate(near)]
    assert rows(got, "query_id", "rank", "vec_id", "score") == sorted(want)


def test_repeated_queries_are_answered_one_by_one(spark):
    df = spark.createDataFrame([(20, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [3.0, 1.0]), (2, [2.0, 2.0]), (3, [1.0, 3.0]), (3, [1.0, 3.0])], "vec_id long, embedding array<double>")
    one = [(1, 1, 12288), (2, 2, 8192), (3, 3, 4096), (4, 3, 4096)]
    two = [(1, 3, 12288), (2, 3, 12288), (3, 2, 8192), (4, 1, 4096)]
    for k in (3, 4, 9):
        got = topk.search(df, F.col("vec_id") == 20, k, block=2, query_block=1, first_blocks=1)
        assert rows(got) == sorted((20, *r) for r in one[:k] + two[:k])


def test_large_components_are_exact_or_refused(spark):
    """Products beyond 2**53, where neighbouring scores are one number as doubles."""
    a, b = 2.0**24, 2.0**24 + 1
    vectors = {0: [a, b, 1.0], 1: [b, a, 0.015625], 2: [b, -a, 3.0], 3: [-1.0, 1.0, 0.0]}
    df = spark.createDataFrame([*vectors.items()], "vec_id long, embedding array<double>")
    whole = {i: [int(64 * x) for x in v] for i, v in vectors.items()}
    want = []
    for q in whole:
        scores = sorted((-sum(x * y for x, y in zip(whole[q], whole[i], strict=True)), i) for i in whole if i != q)
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    assert rows(topk.search(df, F.lit(True), 5)) == sorted(want)
    for far in (1e18, 1e10):
        with pytest.raises(Exception, match="beyond 64 bits"):
            topk.search(spark.createDataFrame([(0, [far]), (1, [far])], "vec_id long, embedding array<double>"), F.lit(True)).collect()


def mix_by_hand(counted, weights, seed, keys):
    """Passes of each (source, doc_id) by sorting every source's documents."""
    out = Counter()
    for source, (tokens, target) in weights.items():
        own = [(d, n) for s, d, n in counted if s == source]
        whole, rest = divmod(target, tokens)
        for d, _ in own:
            out[(source, d)] += whole
        reached = 0
        for d, n in sorted(own, key=lambda x: (keys[(source, x[0])] % 2**64 >> 54, keys[(source, x[0])], x[0])):
            reached += n
            if reached > rest:
                break
            out[(source, d)] += 1
    return +out


@pytest.mark.parametrize("target", [{"repetition": 1.5}, {"entropy": 2.9}, {"repetition": 3.0, "budget": 150_000}])
def test_mix_equals_brute_force(documents, target):
    docs = documents.withColumn("source", F.when(F.col("doc_id") % 3 == 0, "src0").otherwise(F.col("source")))
    found = mixing.plan_mix(docs, 17, **target)
    counted = docs.select("doc_id", "source", mixing._source_key().alias("key"), mixing.word_tokens().alias("tokens"))
    weights = {r.key: (r.tokens, r.target) for r in mixing.weights(counted, **target).collect()}
    whole = {k: t // n for k, (n, t) in weights.items()}
    keyed = counted.withColumn("whole", F.create_map(*(F.lit(x) for kv in whole.items() for x in kv))[F.col("key")]).withColumn("h", mixing._key(17, F.col("whole")))
    data = keyed.collect()
    want = mix_by_hand([(r.key, r.doc_id, r.tokens) for r in data], weights, 17, {(r.key, r.doc_id): r.h for r in data})
    assert Counter(("=" + r.source, r.doc_id) for r in found.collect()) == want
    assert found.dropDuplicates(["source", "doc_id", "pass"]).count() == found.count()


def spark_hash(*values):
    """Spark's xxhash64 of (value, bytes) columns, by the xxhash library."""
    import xxhash

    h = 42
    for value, size in values:
        h = xxhash.xxh64_intdigest(int(value).to_bytes(size, "little", signed=True), h)
    return h


def test_blocks_and_their_order_equal_brute_force(documents):
    """Place in a pass, block and order, worked out from the hash alone; every block holds the target mix."""
    docs = documents.withColumn("source", F.when(F.col("doc_id") % 3 == 0, "src0").otherwise(F.col("source")))
    found = mixing.plan_mix(docs, 5, 1 << 14, repetition=2.0).collect()
    weights = {r.key: r for r in mixing.weights(docs.select(mixing._source_key().alias("key"), mixing.word_tokens().alias("tokens")), repetition=2.0).collect()}
    blocks = math.ceil(sum(r.target for r in weights.values()) / (1 << 14))
    by_block = defaultdict(Counter)
    for r in found:
        w = weights["=" + r.source]
        fraction = (spark_hash((5, 4), (r["pass"], 4), (r.doc_id, 8)) >> 11) / 2**53
        assert r.block == min(math.floor((r["pass"] + fraction) / (w.target / w.tokens) * blocks), blocks - 1)
        order = spark_hash((6, 4), (r["pass"], 4), (r.doc_id, 8))
        assert r.order_key == (order - 2**64 if order >= 2**63 else order)
        by_block[r.block]["=" + r.source] += r.tokens
    assert len(by_block) == blocks > 3
    assert len({r.order_key for r in found}) == len(found)
    # The hot source, of many documents, fills each block to its share, give or take a few documents.
    share = weights["=src0"].weight
    largest = max(r.tokens for r in found)
    for held in by_block.values():
        assert abs(held["=src0"] - share * (1 << 14)) <= 4 * largest


def test_small_edges_are_found_in_several_steps(documents, monkeypatch):
    want = sorted((r.source, r.doc_id, r["pass"], r.block) for r in mixing.plan_mix(documents, repetition=1.7).collect())
    monkeypatch.setattr(mixing, "LAST_ROWS", 0.001)
    assert sorted((r.source, r.doc_id, r["pass"], r.block) for r in mixing.plan_mix(documents, repetition=1.7).collect()) == want


def test_ranks_in_many_parts_seat_every_piece_once(spark):
    pieces = spark.range(3000).select((F.col("id") % 700).alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), (F.col("id") % 3 * 5 + 2).alias("length"), F.col("id").alias("ids_crc32"))
    sequences = set()
    for part in (7, 10**6):
        found = packing.pack(pieces, 40, part).collect()
        used = defaultdict(list)
        for r in found:
            used[r.sequence_id].append((r.offset, r.length))
        assert len(found) == 3000 and all(sum(n for _, n in sorted(v)[:k]) == sorted(v)[k][0] for v in used.values() for k in range(len(v)))
        sequences.add(len(used))
    assert len(sequences) == 1 and sequences.pop() <= 1.02 * 21_000 / 40


def test_exponent_meets_its_target(spark):
    counted = spark.createDataFrame([("a", 8000), ("b", 1000), ("c", 500), ("d", 500)], "key string, tokens long")
    p = np.array([0.8, 0.1, 0.05, 0.05])
    even = {r.key: r.weight for r in mixing.weights(counted, entropy=1.2).collect()}
    assert -sum(w * math.log(w) for w in even.values()) == pytest.approx(1.2, abs=1e-6)
    limited = mixing.weights(counted, repetition=2.0).collect()
    passes = {r.key: r.target / r.tokens for r in limited}
    assert max(passes.values()) == pytest.approx(2.0, rel=1e-2) and min(passes.values()) == 1.0
    a = limited[0].exponent
    assert [r.weight for r in sorted(limited)] == pytest.approx((p**a / (p**a).sum()).tolist())


def test_mix_on_odd_input(edge, nothing):
    found = mixing.mix(edge, repetition=1.5)
    assert found.columns == edge.columns
    assert {(r.doc_id, r.text) for r in found.collect()} == {(r.doc_id, r.text) for r in edge.collect()}
    assert mixing.mix(nothing, repetition=1.5).count() == mixing.plan_mix(nothing, entropy=1.0).count() == 0


def test_native_operators_run_no_python(documents, spark):
    for df in (mixing.plan_mix(documents, repetition=1.5), mixing.mix(documents, repetition=1.5), queries.op4_chat_format(spark, SF)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations", "labels", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    want = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    df = queries.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    assert Counter(map(tuple, df.select(*columns).collect())) == Counter(want.fetchall())


def test_pipeline_on_odd_and_empty_input(spark, edge, nothing, tmp_path):
    """Nulls, empty and long texts, equal rows, null ids; with labels and without any."""
    import corpus_pipeline

    for name, docs in (("odd", edge), ("none", nothing)):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(1, 0), (None, 1), (2, None)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
    found = corpus_pipeline.run(spark, f"{tmp_path}/odd")
    # Of equal texts the largest id stays (8, and 3 of the empty ones), of near copies the smallest (4 of 4 and 8, 5 of 5 and 6).
    assert {r.doc_id for r in found.collect()} == {3, None, 4, 5, 7}
    assert found.filter("doc_id = 3 and piece = 0").count() >= 2
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pipeline_stages(spark):
    """Each stage against its own operator's brute force, on what its predecessor kept."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, held = docs.columns, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF).cache()
        assert out.columns == columns
        held.append(out)
        docs = out
    clean, single, distinct, mixed = held
    from test_text_operators import noisy_or

    model = toxicity.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    whole = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert sorted(r.doc_id for r in clean.collect()) == sorted(r.doc_id for r in whole if noisy_or(model, r.text) < 0.5)
    assert 0 < len(whole) - clean.count() < len(whole) / 2
    assert sorted(r.text for r in single.collect()) == sorted({r.text for r in clean.collect()})
    from test_text_operators import components

    texts = sorted((r.doc_id, r.text) for r in single.collect())
    _, group = components([t for _, t in texts], 5, 80, 100)
    first = {}
    for (d, _), g in zip(texts, group, strict=True):
        first.setdefault(g, d)
    assert sorted(r.doc_id for r in distinct.collect()) == sorted(first.values())
    assert Counter(r.doc_id for r in mixed.collect()) == Counter(r.doc_id for r in mixing.plan_mix(distinct, repetition=1.5).collect())
    assert {r.doc_id for r in mixed.collect()} == {r.doc_id for r in distinct.collect()}
    packed = corpus_pipeline.STAGES[-1][1](spark, mixed, SF)
    assert Counter(r.doc_id for r in packed.filter("piece = 0").collect()) == Counter(r.doc_id for r in mixed.collect())
    assert corpus_pipeline.run(spark, SF).count() == packed.count()
