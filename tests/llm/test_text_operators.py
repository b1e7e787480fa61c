"""Licence scans, n-gram join, exact dedup, toxicity: against brute force and on odd input."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from compare import rows

from framewise.llm import exact_dedup, licenses, ngram_join, toxicity

BASE = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_base_phrases_and_words_equal_brute_force(spark, documents, edge):
    for df in (documents, edge):
        got = licenses.scan_licenses(df.select("doc_id", "text"))
        want = []
        for doc_id, text in ((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()):
            words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered(text))
            hits = [(i, label) for i in range(len(words)) for phrase, label in BASE.items() if tuple(words[i : i + len(phrase)]) == phrase]
            at = [i for i, _ in hits]
            want.append((doc_id, len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))))
        assert Counter(want) == Counter(rows(got, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"))
        assert all(0 <= r.score <= 1 and set(r.base_labels.split(",")) <= {*r.labels.split(","), ""} for r in got.collect())


@pytest.mark.parametrize(
    ("text", "postfix", "allowed"),
    [
        ("MIT", ["MIT"], True),
        ("MIT or GPL-2.0 and X", ["MIT", "GPL-2.0", "X", "and", "or"], True),
        ("(MIT OR GPL-2.0) AND GPL-3.0", ["MIT", "GPL-2.0", "or", "GPL-3.0", "and"], False),
        ("GPL-2.0 WITH Classpath-exception-2.0 or Apache-2.0", ["GPL-2.0", "Classpath-exception-2.0", "with", "Apache-2.0", "or"], True),
    ],
)
def test_expressions_are_parsed_and_evaluated(text, postfix, allowed):
    assert licenses.to_postfix(text) == postfix
    assert licenses.evaluate(postfix, lambda n: licenses.label_of(n) in licenses.PERMITTED) is allowed


@pytest.mark.parametrize("text", ["", "and", "MIT or", "(MIT", "MIT)", "MIT Apache", "(MIT) X", "()"])
def test_bad_expressions_are_refused(text):
    with pytest.raises(licenses.BadExpression):
        licenses.to_postfix(text)


def test_tags_give_labels_and_a_verdict():
    found = licenses.scan(b"# SPDX-License-Identifier: GPL-3.0-only WITH GCC-exception-3.1\n/* SPDX-License-Identifier: MIT */")
    assert found.labels == {"gpl", "mit"} and found.permitted is False and found.score > 0.9
    assert licenses.scan(b"SPDX-License-Identifier: MIT or").permitted is None
    assert licenses.scan(b"SPDX-License-Identifier: MIT or").score > 0.5 and licenses.scan(b"SPDX-License-Identifier: NONE").score == 0


def test_long_expressions_are_taken_whole():
    long = "MIT" + " AND MIT" * 1000 + " AND GPL-3.0"
    found = licenses.scan(f"# SPDX-License-Identifier: {long}\nother".encode())
    assert found.expressions == [long.lower()] and found.labels == {"mit", "gpl"} and found.permitted is False
    nested = "(" * 800 + "MIT" + ")" * 800
    assert licenses.scan(f"SPDX-License-Identifier: {nested} OR ISC".encode()).permitted is True
    # Later tags of one long line are tags of their own.
    line = f"SPDX-License-Identifier: {'MIT OR ' * 200}MIT SPDX-License-Identifier: GPL-2.0"
    found = licenses.scan(line.encode())
    assert len(found.expressions) == 2 and found.labels == {"mit", "gpl"} and found.permitted is False


@pytest.mark.parametrize(
    ("text", "expressions", "labels", "permitted"),
    [
        ("SPDX-License-Identifier: MIT. Then prose goes on.", ["mit"], {"mit"}, True),
        ("see SPDX-License-Identifier: MIT and more; it says", ["mit"], {"mit"}, True),
        ("SPDX-License-Identifier: GPL-2.0 or later", ["gpl-2.0"], {"gpl"}, False),
        ("SPDX-License-Identifier: MIT and this file is free", ["mit"], {"mit"}, True),
        ("SPDX-License-Identifier: MIT or (as said) Apache-2.0", ["mit"], {"mit"}, True),
        ("SPDX-License-Identifier: NONE", ["none"], set(), None),
        ("SPDX-License-Identifier: EUPL-1.2 AND 0BSD", ["eupl-1.2 and 0bsd"], {"eupl-1.2", "0bsd"}, False),
        ("(SPDX-License-Identifier: GPL-2.0 OR MIT) as said", ["gpl-2.0 or mit"], {"gpl", "mit"}, True),
        ("SPDX-License-Identifier:\nMIT and more", [], set(), None),
        ("SPDX-License-Identifier: ISC\r\nGPL-2.0", ["isc"], {"isc"}, True),
        ("SPDX-License-Identifier: MIT Apache-2.0", ["mit apache-2.0"], {"mit", "apache"}, None),
        ("SPDX-License-Identifier: (MIT OR ISC, or so", ["(mit or isc, or so"], {"mit", "isc"}, None),
        ("<!-- SPDX-License-Identifier: BSD-3-Clause -->", ["bsd-3-clause"], {"bsd"}, True),
        ("SPDX License Identifier MIT", [], set(), None),
        ("SPDX-License-Identifier: LicenseRef-Own AND MIT", ["licenseref-own and mit"], {"licenseref-own", "mit"}, False),
    ],
)
def test_tags_end_where_their_expression_ends(text, expressions, labels, permitted):
    found = licenses.scan(text.encode())
    assert (found.expressions, found.labels, found.permitted) == (expressions, labels, permitted)


def test_verdicts_equal_brute_force():
    """Random expressions, one of 10,000 names, against Python's own reading of them."""
    import random

    r = random.Random(11)
    names = {"MIT": True, "Apache-2.0": True, "GPL-3.0-only": False, "ISC": True, "LicenseRef-X": False, "MPL-2.0": False}

    def some(depth):
        if not depth or r.random() < 0.3:
            name = r.choice([*names])
            return (f"{name} WITH Own-exception-1.0", names[name], {name}) if r.random() < 0.2 else (name, names[name], {name})
        parts, words = [some(depth - 1) for _ in range(r.randint(1, 4))], []
        for text, *_ in parts:
            words += [r.choice(("and", "OR", "And")), f"({text})" if r.random() < 0.7 else text]
        whole = " ".join(words[1:])
        python = re.sub(r"(?i) with own-exception-1.0", "", whole)
        for n, good in names.items():
            python = re.sub(rf"(?<![\w.-]){re.escape(n)}(?![\w.-])", str(good), python)
        return whole, eval(re.sub("(?i)and|or", lambda m: m[0].lower(), python)), set().union(*(p[2] for p in parts))

    for _ in range(300):
        text, good, used = some(3)
        found = licenses.scan(f"// SPDX-License-Identifier: {text} */\nMIT".encode())
        assert found.permitted is good and found.labels == {licenses.label_of(n) for n in used} and found.expressions == [text.lower()]
    long = licenses.scan(b"SPDX-License-Identifier: " + b"GPL-3.0-only OR " * 10_000 + b"MIT")
    assert long.labels == {"gpl", "mit"} and long.permitted is True and len(long.expressions[0]) == 160_003


def components(texts, width, num, den):
    """Brute force over all pairs that share a shingle."""
    sets = []
    for text in texts:
        words = re.findall("[^\x20\x09-\x0d]+", lowered(text))
        sets.append({tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else ({tuple(words)} if words else set()))
    group = [*range(len(sets))]
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                x, y = group[i], group[j]
                group = [min(x, y) if g in (x, y) else g for g in group]
    return sets, group


@pytest.mark.parametrize(("width", "num"), [(4, 85), (5, 80)])
def test_join_equals_brute_force(documents, width, num):
    texts = sorted((r.doc_id, r.text) for r in documents.select("doc_id", "text").collect())
    sets, group = components([t for _, t in texts], width, num, 100)
    ids = [d for d, _ in texts]
    smallest = {}
    for d, g in zip(ids, group, strict=True):
        smallest.setdefault(g, d)
    want = sorted((d, len(s), smallest[g]) for d, s, g in zip(ids, sets, group, strict=True))
    assert rows(ngram_join.join(documents, width, num, 100)) == want


PASSAGE = " ".join(f"p{i}" for i in range(40))


def near_copies(seed, n, length, edits):
    import random

    r = random.Random(seed)
    base = [f"w{r.randint(0, 10**6)}" for _ in range(length)]
    out = []
    for _ in range(n):
        words = [*base]
        for _ in range(r.randint(0, edits)):
            words[r.randrange(length)] = f"e{r.randint(0, 10**6)}"
        out.append(" ".join(words))
    return out


def test_large_groups_are_joined_whole(spark, monkeypatch):
    """Groups of copies with pairs on either side of the threshold, through blocks, hot shingles and combinations."""
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 16)
    monkeypatch.setattr(ngram_join, "FREQUENT", 3)
    passage = PASSAGE
    texts = near_copies(1, 60, 120, 5) + near_copies(2, 40, 40, 2) + [passage + f" own{i}" for i in range(30)] + [passage] * 5 + [f"{t} {passage}" for t in near_copies(3, 20, 30, 1)]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    _, group = components(texts, 4, 85, 100)
    want = [(d, g) for d, g in enumerate(group)]
    assert rows(ngram_join.join(df), "doc_id", "component_id") == want
    monkeypatch.setattr(ngram_join, "most_frequent", lambda d, n: ngram_join.np.unique(ngram_join.shingles(passage.encode(), 4) >> ngram_join.np.uint64(16)))
    assert rows(ngram_join.join(df), "doc_id", "component_id") == want


def test_unlike_texts_of_common_passages_are_dealt_in_proportion(spark, monkeypatch):
    """Texts of 8 out of 60 passages share index entries and link with nothing: none is dealt to cells of shingles, and few rows to cells of sketches."""
    r = random.Random(1)
    passages = [" ".join(f"p{i}w{j}" for j in range(60)) for i in range(60)]
    dealt = Counter()
    whole = ngram_join.cells

    def counted(members, classes, num, den, payload="shingles", block_rows=None):
        found = whole(members, classes, num, den, payload, block_rows)
        dealt[payload] += found.count()
        return found

    monkeypatch.setattr(ngram_join, "cells", counted)
    rows_of = []
    for n in (1000, 2000):
        texts = [" ".join(r.sample(passages, 8)) for _ in range(n)] + ["twin " * 3 + passages[0], passages[0] + " twin" * 3]
        dealt.clear()
        found = ngram_join.join(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string"), 4, 85, 100)
        assert found.select("component_id").distinct().count() == n + 1
        rows_of.append(dealt["shingles"] + dealt["sketch"])
        assert dealt["shingles"] <= 10
    assert rows_of[0] > 500 and rows_of[1] <= 2 * rows_of[0] + 10


def test_open_rows_grow_with_the_classes_of_a_group(spark, monkeypatch):
    """Near copies of which some link and some don't: what stays open is a few rows a class, however many index entries its classes share."""
    opened = Counter()
    whole = ngram_join.verify_clusters

    def counted(found, classes, num, den):
        opened["rows"] += found.count()
        return whole(found, classes, num, den)

    monkeypatch.setattr(ngram_join, "verify_clusters", counted)
    rows_of = []
    for n in (400, 800):
        texts = near_copies(7, n, 150, 14)
        opened.clear()
        found = ngram_join.join(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string"), 5, 80, 100)
        _, group = components(texts, 5, 80, 100)
        assert rows(found, "doc_id", "component_id") == [*enumerate(group)]
        rows_of.append(opened["rows"])
    assert 0 < rows_of[0] <= 8 * 400 and rows_of[1] <= 2.5 * rows_of[0]


def test_sketches_never_differ_more_than_their_sets():
    import numpy as np

    rnd = np.random.default_rng(3)
    for n, m in ((5, 5), (100, 130), (700, 600), (3000, 3500), (120_000, 120_000)):
        a = np.unique(rnd.integers(0, 1 << 48, n).astype(np.uint64))
        b = np.unique(np.concatenate([rnd.choice(a, n * 9 // 10, replace=False), rnd.integers(0, 1 << 48, m - n * 9 // 10 if m > n * 9 // 10 else 1).astype(np.uint64)]))
        x, y = ngram_join.sketch(a, len(a)), ngram_join.sketch(b, len(b))
        bits = 8 * min(len(x), len(y))
        assert np.bitwise_count(ngram_join.folded(x, bits) ^ ngram_join.folded(y, bits)).sum() <= len(np.setxor1d(a, b))


def test_a_cluster_of_thousands_is_joined_whole(spark):
    """Copies of one text with so many edits that some link, some don't, and all share entries; a frequent passage besides."""
    import numpy as np

    texts = near_copies(7, 5000, 70, 5) + [f"{t} {PASSAGE}" for t in near_copies(8, 100, 200, 0)] + [f"unlike{i} {PASSAGE} end{i}" for i in range(100)]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    sets = [{tuple(t.split()[i : i + 4]) for i in range(len(t.split()) - 3)} for t in texts]
    shared = Counter(v for s in sets for v in s)
    column = {v: i for i, v in enumerate(v for v, n in shared.items() if n > 1)}
    x = np.zeros((len(sets), len(column)), np.float32)
    for i, s in enumerate(sets):
        x[i, [column[v] for v in s if v in column]] = 1
    n = np.array([len(s) for s in sets])
    group = np.arange(len(sets))
    links = []
    for at in range(0, len(sets), 500):
        k = x[at : at + 500] @ x.T
        i, j = np.nonzero(100 * k >= 85 * (n[at : at + 500, None] + n[None, :] - k))
        links += [(a + at, b) for a, b in zip(i.tolist(), j.tolist(), strict=True) if a + at < b]
    a, b = np.array(links).T
    while True:
        new = group.copy()
        np.minimum.at(new, a, group[b])
        np.minimum.at(new, b, group[a])
        new = new[new]
        if (new == group).all():
            break
        group = new
    assert rows(ngram_join.join(df), "doc_id", "component_id") == [*enumerate(group.tolist())]
    assert 10 < len({*group.tolist()}) < 4000


def test_dealing_in_two_steps_gives_the_same(spark, documents, monkeypatch):
    want = rows(ngram_join.join_links(documents, 5, 80, 100))
    for name, value in (("FAN", 4), ("CHUNK", 5000), ("BUCKET_ENTRIES", 2000)):
        monkeypatch.setattr(ngram_join, name, value)
    assert rows(ngram_join.join_links(documents, 5, 80, 100)) == want
    monkeypatch.setattr(ngram_join, "most_frequent", lambda d, n: ngram_join.np.sort(ngram_join.np.array([r.hot for r in d.filter("hot is not null").select("hot").distinct().collect()], "u8")))
    assert rows(ngram_join.join_links(documents, 5, 80, 100)) == want


def test_summaries_name_a_shingle_that_two_in_a_hundred_hold():
    import numpy as np

    r = np.random.default_rng(3)
    held, frequent = ngram_join.Summary(8192), np.uint64(77)
    for i in range(100_000):
        held.add(np.append(r.integers(1000, 2**40, 20, np.uint64), [frequent] if i % 50 == 0 else np.zeros(0, np.uint64)))
    held.merge()
    assert len(held.values) <= 8192 and 2000 - 2_002_000 // 8192 <= held.counts[held.values == frequent][0] <= 2000


def links_by_hand(texts, width, num, den):
    sets, _ = components(texts, width, num, den)
    return {(i, j) for j, b in enumerate(sets) for i, a in enumerate(sets[:j]) if a and b and den * len(a & b) >= num * len(a | b)}


def counted_links(pairs, n):
    found = Counter(x for pair in pairs for x in pair)
    return [(i, found[i]) for i in range(n)]


@pytest.mark.parametrize("block", [8, 512])
def test_all_links_are_counted(spark, monkeypatch, block):
    """Also those within components, between blocks and of repeated texts."""
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", block)
    chain = [" ".join(f"c{i}" for i in range(k, k + 60 + k // 4)) for k in range(0, 60, 2)]
    texts = near_copies(1, 60, 120, 5) + near_copies(2, 40, 40, 2) * 2 + chain + near_copies(4, 3, 100, 1) + [None, "", "one", "ONE"]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    want = links_by_hand(texts, 4, 85, 100)
    _, group = components(texts, 4, 85, 100)
    found = ngram_join.join_links(df)
    assert rows(found, "doc_id", "n_links") == counted_links(want, len(texts))
    assert rows(found, "doc_id", "component_id") == [*enumerate(group)]
    docs, links = ngram_join.class_links(df)
    members = {}
    for d, c in docs.filter("class is not null").collect():
        members.setdefault(c, []).append(d)
    pairs = [(min(x, y), max(x, y)) for a, b in links.collect() for x in members[a] for y in members[b]]
    pairs += [(x, y) for m in members.values() for x in m for y in m if x < y]
    assert sorted(pairs) == sorted(want)


def test_links_of_documents_and_odd_input(documents, edge, nothing):
    texts = sorted((r.doc_id, r.text) for r in documents.select("doc_id", "text").collect())
    want = counted_links(links_by_hand([t for _, t in texts], 4, 85, 100), len(texts))
    assert rows(ngram_join.join_links(documents), "doc_id", "n_links") == [(texts[i][0], n) for i, n in want]
    found = {(r.doc_id, r.n_shingles): r.n_links for r in ngram_join.join_links(edge).collect()}
    assert found[(1, 20)] == found[(8, 20)] == 3 and found[(5, 1)] == found[(6, 1)] == 1 and found[(None, 0)] == found[(2, 0)] == 0
    assert ngram_join.join_links(nothing).count() == 0 and ngram_join.class_links(nothing)[1].count() == 0


def test_join_on_odd_input(edge, nothing):
    found = {(r.doc_id, r.n_shingles): r.component_id for r in ngram_join.join(edge).collect()}
    assert found[(8, 20)] == found[(1, 20)] == 1 and found[(6, 1)] == 5 and found[(2, 0)] == 2 and found[(None, 0)] is None
    assert ngram_join.join(nothing).count() == 0
    kept = ngram_join.keep_one(edge)
    assert kept.columns == edge.columns and {r.doc_id for r in kept.collect()} == {1, 2, 3, None, 5, 7}
    assert ngram_join.keep_one(nothing).count() == 0


def dedup_by_hand(pairs):
    groups = {}
    for doc_id, text in pairs:
        groups.setdefault(text or "", []).append(doc_id)
    best = {t: max((d for d in ds if d is not None), default=None) for t, ds in groups.items()}
    return sorted(((d, best[t or ""], len(groups[t or ""]), d == best[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for d, t in pairs), key=str)


@pytest.mark.parametrize("counters", [1, 4, 1024])
def test_dedup_equals_brute_force(documents, edge, counters):
    for df in (documents, edge):
        pairs = [tuple(r) for r in df.select("doc_id", "text").collect()]
        assert sorted(rows(exact_dedup.mark_copies(df, counters=counters)), key=str) == dedup_by_hand(pairs)


def test_dedup_keeps_one_row_of_each_text(documents, edge, nothing):
    for df in (documents, edge):
        kept = exact_dedup.drop_copies(df)
        assert kept.columns == df.columns
        texts = [r.text or "" for r in kept.collect()]
        assert sorted(texts) == sorted({r.text or "" for r in df.collect()})
    assert exact_dedup.drop_copies(nothing).count() == exact_dedup.mark_copies(nothing).count() == 0


def test_misra_gries_keeps_what_is_frequent():
    found = exact_dedup.MisraGries(3)
    found.add([*"abacadaeafagahai"])
    assert found.held["a"] >= 8 - 16 // 4


def labelled(spark):
    words = ["river", "stone", "cloud", "paper", "house", "green", "quiet", "table"]
    data, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        lines = [" ".join(words[(i * k + k) % 8] for k in range(1, 7)) for _ in range(3)]
        if toxic:
            lines[i % 3] += f" zork{'abcdefgh'[i % 8]} you"
        data.append((i, ". ".join(lines)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxic_documents_and_their_sentences_are_found(spark):
    docs, labels = labelled(spark)
    model = toxicity.fit(docs, labels)
    texts = dict(docs.collect())
    for r in toxicity.score(docs, model).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert r.predicted == int(r.doc_id % 4 == 0)
        assert [b"zork" in texts[r.doc_id].encode()[s.start : s.end] for s in r.offending] == [True] * (r.doc_id % 4 == 0)
    new, _ = model.document(b"some words. you zorkxyz there. more")
    assert new > 0.5 > model.document(b"river stone")[0]


def noisy_or(model, text):
    """A document's score from the model's weights, sentence by sentence and word by word."""
    import math

    clean = 1 - 1 / (1 + math.exp(-model.bias))
    for sentence in re.split(r"[.!?\r\n]+", lowered(text)):
        known = 0.0
        for word in re.findall("[0-9a-z\x80-\U0010ffff]+", sentence):
            known += model.weights.get(word.encode(), 0.0) + sum(model.weights.get(word[:k].encode() + b"*", 0.0) for k in range(3, 8) if k <= len(word))
        if known > 0:
            clean *= (1 + math.exp(model.bias)) / (1 + math.exp(model.bias + known))
    return 1 - clean


def test_scores_equal_brute_force_and_hold_on_held_out_documents(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = toxicity.fit(docs, labels)
    texts, toxic = {r.doc_id: r.text for r in docs.collect()}, {r.doc_id: r.toxic for r in labels.collect()}
    found = toxicity.score(docs, model).collect()
    assert all(r.score == pytest.approx(noisy_or(model, texts[r.doc_id]), abs=1e-9) for r in found)
    held = [(r.predicted, toxic[r.doc_id]) for r in found if r.held_out and toxic.get(r.doc_id) is not None]
    assert len(held) > 50 and sum(a == b for a, b in held) / len(held) >= 0.95
    # Some labels don't follow the text, so half of the few toxic ones held out is what can be asked for here.
    assert sum(p for p, t in held if t == 0) / sum(t == 0 for _, t in held) <= 0.02
    assert sum(p for p, t in held if t == 1) / sum(t == 1 for _, t in held) >= 0.5


def test_toxicity_on_odd_input(spark, edge, nothing):
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 1), (5, 0)], "doc_id long, toxic int")
    for df in (edge, nothing):
        model = toxicity.fit(df, labels)
        assert toxicity.score(df, model).count() == toxicity.reject(df, model).count() == df.count()
        assert toxicity.reject(df, model).schema == df.schema


def test_length_alone_is_never_toxic(spark, nothing):
    docs, labels = labelled(spark)
    clean, toxic = "river stone cloud. " * 100_000, "river stone. " * 100_000 + "zorka you"
    long = spark.createDataFrame([(1, clean), (2, toxic)], "doc_id long, text string")
    fitted, none = toxicity.fit(docs, labels), toxicity.fit(nothing, labels)
    assert [r.doc_id for r in toxicity.reject(long, fitted).collect()] == [1]
    assert none.weights == {} and toxicity.reject(long, none).count() == 2
    assert {none.document(t)[0] for t in (None, b"", b"x", clean.encode())} == {none.document(b"some words")[0]}
    # Nor do many sentences with a word that says next to nothing.
    near = toxicity.Model({b"river": 0.01}, -10.0)
    assert near.document(clean.encode())[0] < 0.05
    assert toxicity.reject(long, near).count() == 2
    # Nor do sentences whose known words speak against toxicity.
    assert toxicity.Model({b"river": -0.5, b"zork": 30.0}, -10.0).document(clean.encode())[0] < 0.01


def test_held_out_labels_are_not_learnt(spark):
    docs, labels = labelled(spark)
    turned = [(d, 1 - y if zlib.crc32(str(d).encode()) % 5 == 0 else y) for d, y in labels.collect()]
    held = spark.createDataFrame(turned, "doc_id long, toxic int")
    assert toxicity.fit(docs, held).weights == toxicity.fit(docs, labels).weights
