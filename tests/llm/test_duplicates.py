from __future__ import annotations

import hashlib
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import awkward, bag, frame, prose, similarity
from knnscore.llm import byte_dedup, near_dedup, planes, substring_dedup
from knnscore.llm.components import components, joined_by
from knnscore.llm.suffix_array import suffix_array
from pyspark.sql import functions as F


def varied():
    """Copies, near copies, shared passages and repetition."""
    r = random.Random(1)
    rows = [*awkward()]
    for k in range(12):
        base = prose(500 + k, 150 + 20 * k)
        rows.append((100 + 10 * k, base))
        for j in range(1, 6):
            words = base.split(" ")
            for _ in range(j * 2):
                words[r.randrange(len(words))] = "changed"
            rows.append((100 + 10 * k + j, " ".join(words)))
    passage = prose(77, 60).replace("\n", " ")
    rows += [(400 + k, prose(900 + k, 70) + "\n" + passage + "\n" + prose(950 + k, 40)) for k in range(6)]
    rows += [(500, "and " * 200), (501, "and " * 150 + "of " * 90), (502, passage[:49]), (503, passage[:50]), (504, passage[3:53] + passage[3:53])]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(40))
def test_suffix_arrays(seed):
    r = np.random.default_rng(seed)
    for prefix in (1, 3, 9, 50, 10_000):
        text = r.integers(1, r.integers(2, 6), r.integers(1, 90))
        order = suffix_array(text, prefix)
        assert sorted(order) == list(range(len(text)))
        parts = [tuple(text[i : i + prefix]) for i in order]
        assert parts == sorted(parts)


def brute_cut(rows):
    """The contract, byte by byte."""
    where = {}
    for doc, text in rows:
        data = (text or "").encode()
        if doc is not None:
            for i in range(len(data) - 49):
                where[data[i : i + 50]] = min(doc, where.get(data[i : i + 50], doc))
    out = []
    for doc, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        if doc is not None:
            for i in range(len(data) - 49):
                if where[data[i : i + 50]] < doc:
                    gone[i : i + 50] = b"\1" * 50
        spans = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(data)))
        out.append((doc or -1, len(data), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(data, gone, strict=True) if not g)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("held", "hot", "bucket", "tasks"), [(1_000_000, 500, 16_000_000, 20_000), (50, 500, 16_000_000, 20_000), (1000, 2, 10_000, 20_000), (1000, 0, 500, 3)])
def test_repeated_strings_are_cut_as_by_brute_force(spark, monkeypatch, held, hot, bucket, tasks):
    for name, value in (("HELD_RUNS", held), ("HOT", hot), ("BUCKET", bucket), ("MOST_TASKS", tasks)):  # also many buckets, and several of them a task
        monkeypatch.setattr(byte_dedup, name, value)
    rows = varied()
    got = byte_dedup.cut(frame(spark, rows).repartition(3)).collect()
    expected = brute_cut(rows)
    assert sum(x[2] for x in expected) > 10_000
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == expected
    assert byte_dedup.cut(frame(spark, [])).count() == 0


def test_columns_come_back_from_a_packed_value():
    r = np.random.default_rng(1)
    level = next(p for k in range(64, 400) for z in range(k) if len(planes.squeezed(p := r.bytes(k - z) + bytes(z))) == k)  # compressed as long as it was
    for n in (1, planes.FEW - 1, planes.FEW, 5000, len(level)):
        columns = [r.integers(0, 1 << 63, n, np.uint64), r.integers(0, 300, n).astype("<i4"), np.frombuffer(level, np.uint8)[:n] if n == len(level) else r.integers(0, 36, n).astype("u1")]
        for rest in (b"", b"some " * 1000):
            got, more = planes.unpack(planes.pack(columns, rest), [c.dtype for c in columns])
            assert more == rest
            for a, b in zip(columns, got, strict=True):
                assert a.dtype == b.dtype
                assert (a == b).all()
    keys = np.sort(r.integers(0, 1 << 64, 900, np.uint64) // np.uint64(7) * np.uint64(7)) + np.uint64(3)
    assert (byte_dedup.rises(byte_dedup.falls(keys, 7), int(keys[0] % np.uint64(7)), 7) == keys).all()


def test_little_is_shuffled_for_repeated_strings(spark):
    """A run costs under 24 bytes (33 where runs weren't packed), a string of a frequent passage under 25 (over 90), and texts are shuffled once (twice)."""
    passage = prose(5, 200).replace("\n", " ")[:48]
    r, words = random.Random(3), prose(6, 5000).split()
    rows = [(k, " ".join([*r.choices(words, k=60), f"{passage}{k * 104729 % 1009:04}", *r.choices(words, k=60)])) for k in range(1500)]
    docs = frame(spark, rows).coalesce(1).select("doc_id", "text").where("doc_id IS NOT NULL")
    messages = byte_dedup.find_runs(docs, 4)
    size = messages.selectExpr("sum(length(data))").first()[0]
    texts = [t.encode() for _, t in rows]
    runs = byte_dedup.runs(b"".join(texts), np.cumsum([0, *map(len, texts)]), np.arange(len(texts)))
    assert size < 24 * len(runs)

    unsettled = byte_dedup.by_document(byte_dedup.settle_buckets(messages, 4).where(F.col("kind") == byte_dedup.ASKED), 4)
    hot = unsettled.where(f"exists(sides, x -> x & {byte_dedup.HOT_LEFT | byte_dedup.HOT_RIGHT} > 0)")
    blobs = [x.data for x in byte_dedup.fetch(byte_dedup.packed_texts(docs), hot, 4).where(F.col("kind") == byte_dedup.OTHER).collect()]
    n = np.concatenate([planes.unpack(x, byte_dedup.HALF)[0][3] for x in blobs]).astype(int)
    assert (n == 1).sum() > byte_dedup.HOT
    assert sum(map(len, blobs)) < 25 * n.sum()

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        done = byte_dedup.cut(docs)
        done.collect()
        plan = done._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    by_text = [line for line in plan.split("\n") if "Exchange hashpartitioning(doc_id" in line]
    assert sum("ReusedExchange" not in line for line in by_text) == 1, by_text


def brute_classes(rows, threshold=0.8):
    bags = {doc: bag(text) for doc, text in rows if doc is not None}
    parent = {d: d for d in bags}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(bags)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if bags[a] and bags[b] and similarity(bags[a], bags[b]) >= threshold:
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    return {d: find(d) for d in ids}


def test_classes_equal_brute_force(spark):
    rows = varied()
    expected = brute_classes(rows)
    assert 20 < len(set(expected.values())) < len(expected)
    got = near_dedup.classes(frame(spark, rows).repartition(3)).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.class_id for r in got if r.doc_id is not None} == expected
    assert {r.class_id for r in got if r.doc_id is None} == {4}
    kept = near_dedup.keep_one(frame(spark, rows)).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(set(expected.values()))
    assert near_dedup.classes(frame(spark, [])).count() == 0
    alone = near_dedup.classes(frame(spark, [(1, prose(1, 90)), (2, prose(2, 90)), (3, None)])).collect()
    assert all(r.doc_id == r.class_id for r in alone)


def test_a_large_group_of_near_copies_is_one_class(spark):
    base = prose(3, 120).split(" ")
    rows = [(k, " ".join([*base[: k % 110], f"word{k}", *base[k % 110 + 1 :]])) for k in range(400)]
    got = near_dedup.classes(frame(spark, rows)).collect()
    assert {r.class_id for r in got} == {0}


def boilerplate():
    """400 documents of similarity 0.66, in which each of the first 20 with an even id has a copy (0.98 or just above 0.8) of the next id."""
    frame_of, rows = [f"common{k}" for k in range(100)], []
    for k in range(400):
        own = [f"own{k}x{j}" for j in range(25)]
        if k < 40 and k % 2:
            own = [f"own{k - 1}x{j}" for j in range(25)]
            own[-1 if k % 4 == 1 else -13 :] = [f"own{k}y{j}" for j in range(1 if k % 4 == 1 else 13)]
        rows.append((k, " ".join(frame_of + own)))
    return rows


def test_large_buckets_of_mixed_documents_lose_no_link(spark):
    rows = boilerplate()
    expected = brute_classes(rows)
    assert len(set(expected.values())) == 380
    reps = spark.createDataFrame([(k, [7]) for k, _ in rows], "rep long, bands array<long>")  # all in one bucket
    labels = near_dedup.labels_of(frame(spark, rows), reps, 0.8)
    found = {} if labels is None else {r.node: r.component for r in labels.collect()}
    assert {k: found.get(k, k) for k, _ in rows} == expected


@pytest.mark.parametrize("draws", [(), (1, 8, 8)])
def test_rounds_change_no_result(spark, monkeypatch, draws):
    monkeypatch.setattr(near_dedup, "DRAWS", draws)
    rows = [*varied(), *((1000 + k, t) for k, t in boilerplate()[:60])]
    expected = brute_classes(rows)
    got = near_dedup.classes(frame(spark, rows)).collect()
    assert {r.doc_id: r.class_id for r in got if r.doc_id is not None} == expected


def test_prefix_pairs_hold_every_link(spark):
    rows = list({k: (k, t) for k, t in varied() if k is not None and bag(t)}.values()) + [(1000 + k, t) for k, t in boilerplate()]
    held = near_dedup.bags(spark.createDataFrame(rows, "rep long, text string").repartition(3))
    shared = near_dedup.prefixes(held, 0.8).withColumn("component", F.col("rep"))
    got = {(r.a, r.b) for r in near_dedup.prefix_pairs(near_dedup.still_mixed(shared), 0.8).collect()}
    bags = {k: bag(t) for k, t in rows}
    links = {(a, b) for a in bags for b in bags if a > b and similarity(bags[a], bags[b]) >= 0.8}
    assert len(links) > 30 and links <= got
    assert len(got) < 5_000  # of 119,805
    good = near_dedup.verify(spark.createDataFrame(sorted(got), "a long, b long"), held, 0.8).collect()
    assert {(r.a, r.b) for r in good} == links


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_recall_against_all_pairs_of_the_test_documents(spark):
    """Counts the common shingles of every pair; as each link lies within a class, recall of links is one."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    bags = {k: bag(t) for k, t in rows}
    holders, common = defaultdict(list), Counter()
    for k, found in bags.items():
        for shingle, n in found.items():
            common.update({(other, k): min(n, m) for other, m in holders[shingle]})
            holders[shingle].append((k, n))
    links = [p for p, n in common.items() if n >= 0.8 * (bags[p[0]].total() + bags[p[1]].total() - n)]
    got = {r.doc_id: r.class_id for r in near_dedup.classes(frame(spark, rows)).collect()}
    assert len(links) > 50 and all(got[a] == got[b] for a, b in links)
    joined = {k: k for k in bags}  # and classes hold no more than the components of the links

    def find(x):
        while joined[x] != x:
            x = joined[x]
        return x

    for a, b in links:
        low, high = sorted((find(a), find(b)))
        joined[high] = low
    assert got == {k: find(k) for k in bags}


def test_signatures_are_unbiased():
    """Slots agree as often as the weighted Jaccard similarity says, for weights far from one too."""
    r = np.random.default_rng(0)
    for low, high in ((1, 2), (1, 30), (1, 1000)):
        keys = r.integers(1 << 62, size=40).astype(np.uint64)
        a, b = r.integers(low, high, 40), r.integers(low, high, 40)
        a[:8], b[8:16] = 0, 0
        held = [np.concatenate([x[w > 0] for x, w in ((keys, a), (keys, b))]), np.concatenate([a[a > 0], b[b > 0]]), np.repeat([0, 1], [(a > 0).sum(), (b > 0).sum()])]
        times = near_dedup.signatures(*held, 2, slots=6000)
        exact = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        assert abs((times[0] == times[1]).mean() - exact) < 4 * np.sqrt(exact * (1 - exact) / 6000) + 1e-3


def test_components(spark):
    r = random.Random(2)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(1000, k) for k in range(1001, 1400)] + [(2000 + k, 2001 + k) for k in range(60)]
    parent = {x: x for p in pairs for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        low, high = sorted((find(a), find(b)))
        parent[high] = low
    got = {row.node: row.component for row in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for p in pairs if p[0] != p[1] for x in p}


def brute_lines(rows):
    """What is left of each text: every sentence is looked for in all that come before it."""
    rows = sorted(((i, t) for i, t in rows if i is not None and t is not None), key=lambda x: x[0])
    found = []
    for doc, text in rows:
        for number, line in enumerate(text.split("\n")):
            parts = [x for x in re.split(r"(?<=[.!?])(?=[ \t])", line)]
            joined = []
            for x in parts:  # white space goes with the sentence before it
                stripped = x.lstrip(" \t")
                if joined:
                    joined[-1] += x[: len(x) - len(stripped)]
                    joined += [stripped] if stripped else []
                else:
                    joined.append(x)
            normal = [" ".join(re.findall(r"[^\W_]+", x.lower())) for x in joined]
            for x, n in zip(joined, normal, strict=True):
                found.append((doc, number, x, n, sum(map(bool, normal)) == 1))
    holders, out, seen = {}, {}, set()
    for doc, _, _, n, _ in found:
        holders.setdefault(n, set()).add(doc)
    for doc, text in rows:
        own = [list(x[1:]) for x in found if x[0] == doc]
        for x in own:
            x.append(bool(x[2]) and x[2] in seen)
            seen.add(x[2])
        named = [x for x in own if x[2]]
        for k, x in enumerate(named):
            low = high = k
            while x[4] and low and named[low - 1][4]:
                low -= 1
            while x[4] and high + 1 < len(named) and named[high + 1][4]:
                high += 1
            words = sum(len(y[2].split()) for y in named[low : high + 1])
            x.append(x[4] and (words >= 8 or (x[3] and len(holders[x[2]]) >= 10)))
        lines = []
        for number in range(text.count("\n") + 1):
            here = [x for x in own if x[0] == number]
            left = "".join(x[1] for x in here if not (x[2] and x[5]))
            if not any(x[2] and x[5] for x in here) or left.strip():
                lines.append(left)
        out[doc] = "\n".join(lines)
    return out


def test_lines_and_sentences_are_removed_as_by_brute_force(spark):
    passage = "Some sentence of the passage stands here. Then a short one. Of. And a longer sentence, with a comma in it, follows after that. The end."
    short = "Share this page!"
    rows = [(k, prose(k, 60)) for k in range(40, 50)]
    rows += [(60 + k, prose(60 + k, 30).replace("\n", " ") + f" {passage} " + prose(80 + k, 30)) for k in range(3)]
    rows += [(100 + k, f"{short}\n" * (k % 2 + 1) + prose(100 + k, 20)) for k in range(12)] + [(200, "Read more\nyes"), (201, "READ more.\nno")]
    rows += [(300, "One. Two. Three."), (301, "One. Two. Three. Four!"), (302, "--- \n***\n--- "), (303, f"  {passage.upper()}  \n{passage}\ttail")]
    rows += [(x[0] + 1000, x[1]) for x in varied() if x[0] is not None and x[0] < 500]
    rows = list(dict(rows).items())
    expected = brute_lines(rows)
    got = {r.doc_id: r for r in substring_dedup.deduplicate(frame(spark, rows).repartition(3)).collect()}
    assert len(got) == len(rows)
    for k, text in expected.items():
        assert got[k].text == text, k
    assert sum(r.n_removed > 0 for r in got.values()) > 30
    assert passage in got[60].text and "comma" not in got[61].text and "short one" not in got[62].text  # in the middle of a line
    assert got[201].text == "READ more.\nno"  # few documents share the short line
    assert short in got[100].text and all(short not in got[100 + k].text for k in range(1, 12))


def test_lines_are_removed_with_offsets(spark):
    line, other = "One line that many documents have, of ten words or so.", "another line that is long enough to be a unit here"
    rows = [(2, f"{line}\nshort\n{other}"), (1, f"start\n  {line.upper()}  \nshorter\n{line}"), (3, line), (3, line), (4, None), (5, ""), (None, line), (6, "short\nshort\n" + prose(1, 300))]
    docs = frame(spark, rows)
    got = substring_dedup.deduplicate(docs, carry=("seen",)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and {r.seen for r in got} == {"x"}
    assert by[1].text == f"start\n  {line.upper()}  \nshorter" and by[1].n_removed == 1
    assert by[2].text == f"short\n{other}" and by[3].text == "" and by[4].text is None and by[5].text == "" and by[None].text == line
    assert by[6].text == rows[-1][1]
    for r in got:
        text = dict(rows)[r.doc_id]
        assert all(text[s.start : s.end].strip().lower() == line.lower() for s in r.spans)
        assert r.n_removed_chars == sum(s.end - s.start for s in r.spans)
    assert substring_dedup.deduplicate(frame(spark, [])).count() == 0
    assert substring_dedup.deduplicate(frame(spark, awkward())).count() == len(awkward())


def test_repeated_rows_are_one_document(spark):
    """A short line of two documents stays, also where one of them has ten rows; of ten documents it goes."""
    line = "a short line"
    rows = [(1, f"{line}\n{prose(1, 60)}")] * 10 + [(2, f"{line}\n{prose(2, 60)}")]
    got = {r.doc_id: r.text for r in substring_dedup.deduplicate(frame(spark, rows)).collect()}
    assert got == dict(rows)
    many = [(i, f"{line}\n{prose(i, 60)}") for i in range(1, 11)]
    got = {r.doc_id: r.text for r in substring_dedup.deduplicate(frame(spark, many)).collect()}
    assert got == {i: t if i == 1 else t.split("\n", 1)[1] for i, t in many}


def test_pairs_just_below_the_similarity_are_not_made(spark):
    """Sets of one pool share rare tokens in all pairs; parities leave these out before the join makes them, and no link."""
    draw = np.random.default_rng(5)
    pool = draw.integers(-(2**62), 2**62, 250)
    sets = [draw.choice(pool, 200, replace=False) for _ in range(60)]
    sets += [np.r_[s[:190], draw.integers(-(2**62), 2**62, 10)] for s in sets[:10]]
    held = spark.createDataFrame([(i, np.sort(s).tolist()) for i, s in enumerate(sets)], "rep long, tokens array<long>")
    shared = near_dedup.prefixes(held, 0.8).withColumn("component", F.col("rep"))
    got = {(r.a, r.b) for r in near_dedup.prefix_pairs(shared, 0.8).collect()}
    links = {(i, j) for i in range(70) for j in range(i) if (n := len(set(sets[i].tolist()) & set(sets[j].tolist()))) / (400 - n) >= 0.8}
    assert len(links) >= 10 and links <= got
    assert len(got) < 0.1 * 70 * 69 / 2


def test_components_go_on_from_labels(spark):
    labels = spark.createDataFrame([(1, 1), (2, 1), (5, 5), (6, 5), (8, 8), (9, 8)], "node long, component long")
    links = spark.createDataFrame([(6, 2), (7, 9), (0, 7), (20, 21), (2, 1)], "a long, b long")
    got = {(r.node, r.component) for r in joined_by(labels, links).collect()}
    assert got == {(1, 1), (2, 1), (5, 1), (6, 1), (8, 0), (9, 0), (7, 0), (0, 0), (20, 20), (21, 20)}
