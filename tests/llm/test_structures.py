"""Merkle manifests, conversation repair and SentencePiece: brute force, other block and segment sizes, odd rows."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from compare import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from framewise.llm import merkle, queries, repair, sentencepieces

MODEL = queries.pieces_path()


# Merkle manifest


def H(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(levels[-1][k : k + 3]) for k in range(0, len(levels[-1]), 3)])
    return levels


def steps(levels, i):
    """Siblings before and after the node, level by level."""
    for level in levels[:-1]:
        start = i // 3 * 3
        yield level[start:i], level[i + 1 : start + 3]
        i //= 3


def leaf(row, text):
    return H(["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)])


def whole_manifest(found):
    sources = {}
    for r in found:
        sources.setdefault(r["source"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), r))
    trees = {}
    for s, own in sources.items():
        own.sort(key=lambda x: x[:3])
        trees[s] = tree([x[2] for x in own])
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    top = tree([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, (_, _, own, r) in enumerate(sources[s]):
            path = [*steps(trees[s], i), *steps(top, k)]
            text = r["text"]
            if text is not None and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            node = leaf(r, text)
            for before, after in path:
                node = H([*before, node, *after])
            out.append((r["doc_id"], own, trees[s][-1][0], top[-1][0], H(x for p in path for side in p for x in side), node, node == top[-1][0]))
    return sorted(out, key=str)


@given(st.integers(1, 120))
@settings(max_examples=40, deadline=None)
def test_scheduled_paths_equal_those_of_the_whole_tree(n):
    leaves = [H([str(i)]) for i in range(n)]
    levels = tree(leaves)
    found = [*merkle.traverse(leaves, merkle.height_of(n))]
    assert merkle.block_root(leaves, merkle.height_of(n)) == levels[-1][0]
    for i, proof in enumerate(found):
        assert merkle.fold(leaves[i], proof) == (levels[-1][0], H(x for p in steps(levels, i) for side in p for x in side))


def test_traversal_keeps_few_nodes():
    leaves = [H([str(i)]) for i in range(3**6)]
    levels = [merkle.Level(leaves, h) for h in range(6)]
    for i in range(len(leaves)):
        for level in levels:
            if i and i % level.span == 0:
                level.turn()
            level.step()
            assert len(level.run) + len(level.stack.done) + sum(map(len, level.stack.open)) <= 6 + 2 * level.height


def test_manifest_equals_the_whole_trees(spark, tmp_path):
    rnd = random.Random(5)
    found = [{"doc_id": i, "text": rnd.choice(["a\nb", "", None, "x" * 5000 + "\n", "é\n\n"]), "lang": rnd.choice(["en", None]), "source": rnd.choice(["hot"] * 8 + [None, "", "n", "é", "Z"]), "n_chars": rnd.choice([None, i])} for i in range(300)]
    found += [dict(found[0]), dict(found[0], text="other"), dict(found[1], doc_id=None), dict(found[2], doc_id=None), dict(found[2], source="lone")]
    spark.createDataFrame(found, "doc_id long, text string, lang string, source string, n_chars long").withColumn("leaf", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in queries.op11_merkle_manifest(spark, str(tmp_path)).collect()), key=str)
    assert got == whole_manifest(found)


def test_blocks_of_any_height_give_one_manifest(spark, documents):
    want = rows(merkle.verify(merkle.manifest(documents)))
    assert all(r[-1] for r in want)
    for height in (1, 2):
        assert rows(merkle.verify(merkle.manifest(documents, height=height))) == want


def test_a_changed_row_is_found(spark, documents):
    carry = {"changed": F.when(F.col("doc_id") == 3, merkle.row_digest({"text": F.concat("text", F.lit("!"))}))}
    found = merkle.verify(merkle.manifest(documents, carry), "changed")
    assert [r.doc_id for r in found.where("not verified").collect()] == [3]


def test_manifest_of_an_empty_table(spark):
    nothing = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert merkle.verify(merkle.manifest(nothing)).collect() == []


# Conversation repair

TURNS = "conv_id long, turn long, role string, text string, kind int"


def cheapest(entries):
    """All edits of a short conversation, insertions up to two between rows: the least (cost, edits)."""
    best = None
    for keep in itertools.product("KRD", repeat=len(entries)):
        for gaps in itertools.product(range(3), repeat=len(entries) + 1):
            edits, cost, options = "I" * gaps[0], 3 * sum(gaps), [["u", "a"]] * gaps[0]
            for (initial, must_go, late), edit, gap in zip(entries, keep, gaps[1:], strict=True):
                if must_go and edit != "D":
                    break
                edits += edit + "I" * gap
                cost += {"K": 0, "R": 3, "D": 4}[edit] + (3 if late and edit != "D" else 0)
                options = options + {"K": [[initial]], "R": [["u", "a"]], "D": []}[edit] + [["u", "a"]] * gap
            else:
                if (best is None or (cost, edits) < best) and any(re.fullmatch("(s?(ua)+)?", "".join(x)) for x in itertools.product(*options)):
                    best = (cost, edits)
    return best


@given(st.lists(st.tuples(st.sampled_from("suat"), st.booleans(), st.booleans()), max_size=4))
@settings(max_examples=60, deadline=None)
def test_the_path_is_the_cheapest_and_least_of_all_edits(entries):
    cost, edits, _ = repair.finished(repair.compose(entries, 0))
    assert (cost, edits.decode()) == cheapest(entries)


@given(st.lists(st.tuples(st.sampled_from("suat"), st.booleans(), st.booleans()), max_size=40), st.lists(st.integers(0, 40), max_size=4))
@settings(max_examples=100, deadline=None)
def test_segments_join_to_the_whole(entries, cuts):
    whole = repair.finished(repair.compose(entries, 0))[:2]
    best = {0: (0, b"")}
    cuts = sorted({min(c, len(entries)) for c in cuts} | {0, len(entries)})
    for a, b in itertools.pairwise(cuts):
        found = {}
        for start, (cost, edits) in best.items():
            for end, (more, own) in repair.compose(entries[a:b], start).items():
                weight = (cost + more, edits + own)
                found[end] = min(found.get(end, weight), weight)
        best = found
    assert repair.finished(best)[:2] == whole


def conversations():
    rnd = random.Random(3)
    found = []
    for conv in range(60):
        for turn in range(rnd.randint(0, 9)):
            found.append((rnd.choice([conv, conv, None if conv % 7 == 0 else conv]), rnd.choice([turn, turn, turn * 2, None]), rnd.choice(["user", "assistant", "system", "tool", None]), rnd.choice(["Yes.", "No", "", None, " \n", "Well?  ", "Oh! é", f"n{turn}."]), 1))
    # One long conversation: ties, repetitions, a range of turns.
    found += [(999, t, ["user", "assistant"][t % 2], f"text {t}." if t % 5 else "again.", 0) for t in range(3000)] + [(999, 7, "user", "same.", 0)] * 2500
    return found


def plainly(found):
    """Counts and repairs of each conversation row by row; long ones by steps over (state -> least weight)."""
    convs = {}
    for conv, turn, role, text, *_ in found:
        convs.setdefault(conv, []).append((turn is not None, turn or 0, role if role is not None else " ", text if text is not None else " "))
    out = {}
    for conv, said in convs.items():
        said.sort()
        seen, counts, entries, texts = set(), {"blank": 0, "duplicate": 0, "truncated": 0}, [], []
        for _, _, role, text in said:
            end = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            entries.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        best = {"": (0, "", ())}
        step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

        def grown(best, step=step):
            for _ in range(2):
                for state, (cost, edits, texts) in list(best.items()):
                    for x in "ua":
                        to = step.get((state, x))
                        new = (cost + 3, edits + "I", (texts, {"u": "user:", "a": "assistant:"}[x]))
                        if to and (to not in best or new[:2] < best[to][:2]):
                            best[to] = new
            return best

        for (initial, gone, late), (_, _, role, text) in zip(entries, said, strict=True):
            new = {}

            def offer(to, way, new=new):
                if to is not None and (to not in new or way[:2] < new[to][:2]):
                    new[to] = way

            for state, (cost, edits, texts) in grown(best).items():
                offer(state, (cost + 4, edits + "D", texts))
                if not gone:
                    more = 3 if late else 0
                    offer(step.get((state, initial)), (cost + more, edits + "K", (texts, f"{role}:{text}")))
                    for x, name in (("u", "user"), ("a", "assistant")):
                        offer(step.get((state, x)), (cost + 3 + more, edits + "R", (texts, f"{name}:{text}")))
            best = new
        cost, edits, texts = min((way for state, way in grown(best).items() if state in ("", "a")), key=lambda w: w[:2])
        lines = []
        while texts:
            texts, line = texts
            lines.append(line)
        turns = {t for has, t, _, _ in said if has}
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(said))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (conv, gaps, *counts.values(), illegal, cost, edits, hashlib.sha256("\n".join(lines[::-1]).encode()).hexdigest())
    return out


def test_repair_equals_row_by_row(spark, nothing):
    found = conversations()
    turns = spark.createDataFrame(found, TURNS)
    got = {r.conv_id: tuple(r) for r in repair.repair(turns).collect()}
    assert got == plainly(found)


def test_cut_conversations_equal_whole_ones(spark):
    found = [r for r in conversations() if r[0] == 999] + [(5, 1, "user", "Hi.", 0)]
    turns = spark.createDataFrame(found, TURNS).repartition(7)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        rows_ = repair.segments(repair.classified(turns))
        assert rows_.where("not whole").count() > 4
        assert max(len(r.said or ()) for r in rows_.collect()) <= repair.CUT
        assert {r.conv_id: tuple(r) for r in repair.repair(turns).collect()} == plainly(found)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_damage_and_conversations_without_rows(spark):
    found = [(conv, turn, role, text, 0) for conv in (*range(40), None) for turn, role, text in [(0, "user", "A. b?"), (None, "assistant", None)]]
    turns = spark.createDataFrame(found, TURNS)
    want = []
    for conv, turn, role, text, _ in found:
        shown = [" " if v is None else str(v) for v in (conv, turn)]
        kind = zlib.crc32(":".join(shown).encode()) % 20
        role, text = "user" if kind == 4 else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        want += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    broken = repair.damaged(turns)
    assert sorted(map(str, map(tuple, broken.collect()))) == sorted(map(str, want))
    got = {r.conv_id: tuple(r) for r in repair.repair(broken, turns).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert got == {conv: (conv, 0, 0, 0, 0, 0, 0, "", empty) for conv in (*range(40), None)} | plainly(want)
    assert repair.repair(turns.where("false")).count() == 0
    assert [tuple(r) for r in repair.repair(turns.where("false"), turns.where("conv_id = 1")).collect()] == [(1, 0, 0, 0, 0, 0, 0, "", empty)]


# SentencePiece


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def encoder():
    return sentencepieces.Encoder(MODEL, 500)


ODD = ["", " ", "  ", "▁x ▁", " a  b\n\x00é😀▁x</s><unk><0x0A>", "x " * 20000, " " * 3000, "a" * 3000, "ab" * 2500, "  lead", "trail  ", "日本語テスト", "\t\n\r\n", "١٢٣", "é", "\U0010ffff", "﻿.", "Ünïcödé " * 50]


def test_odd_texts_equal_the_library(library, encoder, documents):
    texts = [*ODD, *(r.text for r in documents.limit(60).collect())]
    for _ in range(2):
        got = encoder.encode(texts)
        want = library.encode(texts, add_bos=True, add_eos=True)
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == want
        assert [encoder.decode(x) for x in got] == library.decode(want)


@given(st.lists(st.text(max_size=60), max_size=8))
@settings(max_examples=150, deadline=None)
def test_any_text_equals_the_library(library, encoder, texts):
    got = encoder.encode(texts)
    want = library.encode(texts, add_bos=True, add_eos=True)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == want
    assert [encoder.decode(x) for x in got] == [library.decode(x) for x in want]


@given(st.text("abcdefghijklmnopqrstuvwxyz▁", min_size=1, max_size=400))
@settings(max_examples=60, deadline=None)
def test_the_heap_of_long_words_equals_the_rounds(encoder, word):
    symbols = encoder._symbols(word)
    ids, _ = sentencepieces.merge_rounds(symbols.copy(), np.array([len(symbols)]), encoder.vocabulary)
    assert encoder._by_heap(symbols.tolist()) == ids.tolist()


@given(st.lists(st.one_of(st.integers(0, 260), st.integers(0, 31999)), max_size=20))
@settings(max_examples=300, deadline=None)
def test_any_ids_decode_as_in_the_library(library, encoder, ids):
    assert encoder.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids)


def test_query_equals_the_library(spark, library, edge, nothing, tmp_path):
    edge.write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for r in edge.collect():
        ids = library.encode(r.text or "", add_bos=True, add_eos=True)
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    got = queries.op13_sentencepiece(spark, str(tmp_path)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert sentencepieces.decode(sentencepieces.encode(nothing, MODEL), MODEL).count() == 0


def test_other_models_are_refused(tmp_path):
    def field(number, value):
        return bytes([number << 3 | 2, len(value)]) + value

    piece = field(1, field(1, b"a"))
    with pytest.raises(ValueError):
        (tmp_path / "unigram").write_bytes(piece + field(2, bytes([3 << 3, 1])))
        sentencepieces.Vocabulary(str(tmp_path / "unigram"))
