"""Exact, near and substring dedup against brute force."""

import contextlib
import random
import re
import threading
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wagelens.llm import exact_dedup, near_dedup, substring_dedup
from wagelens.llm.components import components
from wagelens.llm.fm_index import FmIndex

WORD = r"[^\x20\x09-\x0D]+"


def test_exact(spark, docs):
    rows = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "b"), (5, "b"), (None, "c"), (6, "c" * 50_000)]
    got = exact_dedup.exact_groups(spark, docs(rows)).collect()
    assert sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in got) == [
        (0, 0, 1, True), (1, 2, 2, False), (2, 2, 2, True), (3, 4, 2, False), (4, 4, 2, True), (5, 5, 2, False), (5, 5, 2, True), (6, 6, 1, True),
    ]
    kept = exact_dedup.keep_one(spark, docs(rows))
    assert kept.columns == docs([]).columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 2, 4, 5, 6]
    assert exact_dedup.exact_groups(spark, docs([])).collect() == []


def test_exact_compares_bytes_where_digests_meet(spark, docs):
    rows = [(1, "aa"), (2, "bb"), (3, "aa"), (4, "c")]
    weak = lambda t: F.length(t).cast("string")
    got = exact_dedup.exact_groups(spark, docs(rows), digest=weak, files_per_batch=1).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == [(1, 3, 2, False), (2, 2, 1, True), (3, 3, 2, True), (4, 4, 1, True)]


def test_exact_state_takes_little_disk(spark, docs):
    # Every partition has a store; one that set disk aside for its log would take 4 MB for a few keys.
    local, seen, over = Path(spark.sparkContext._temp_dir).parent, {}, threading.Event()
    old = set(local.rglob("MANIFEST-*"))

    def watch():
        while not over.wait(0.05):  # Spark drops the stores some time after the stream ends
            with contextlib.suppress(OSError):
                for f in set(local.glob("StateStore*/*/MANIFEST-*")) - old:
                    with contextlib.suppress(OSError):
                        seen[f] = max(seen.get(f, 0), f.stat().st_blocks * 512)

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        exact_dedup.exact_groups(spark, docs([(i, str(i)) for i in range(20)])).count()
    finally:
        over.set()
        watcher.join()
    assert seen and max(seen.values()) < 1 << 20


def sets_of(rows, k):
    out = {}
    for i, t in rows:
        w = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    return out


@pytest.mark.parametrize("k", [2, 5])
def test_near(spark, docs, k):
    rng = random.Random(5)
    rows = [(0, None), (1, ""), (2, "x"), (3, "X"), (4, "x y")]
    for g in range(6):
        base = [str(rng.randint(0, 9999)) for _ in range(120)]
        for _ in range(40 if g == 0 else 6):  # one large group
            edited = list(base)
            for _ in range(rng.randint(0, 3 if k == 5 else 8)):
                edited[rng.randrange(len(edited))] = "new" + str(rng.randint(0, 99))
            rows.append((len(rows), " ".join(edited)))
    rows += [(len(rows), rows[5][1].upper()), (len(rows) + 1, rows[5][1])]
    sets = sets_of(rows, k)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = near_dedup.near_groups(docs(rows), k).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), find(r.doc_id), find(r.doc_id) == r.doc_id), r
    assert near_dedup.near_groups(docs([]), k).collect() == []


def test_rare_shingles_lose_no_link(spark):
    """Sets that share a long passage: every pair over the threshold is among the pairs to compare."""
    rng = np.random.default_rng(8)
    passage = rng.integers(0, 2**63, 80, dtype=np.uint64)
    sets = [np.unique(np.concatenate([passage, rng.integers(0, 30, rng.integers(0, 40), dtype=np.uint64)])) for _ in range(60)]
    names = [bytes([i]) for i in range(len(sets))]
    rows = spark.createDataFrame([(n, n, x.tobytes()) for n, x in zip(names, sets, strict=True)], "c binary, root binary, items binary")
    got = {(bytes(r.a), bytes(r.b)) for r in near_dedup.sharing_rare(rows, 80).collect()}
    inter = lambda x, y: len(np.intersect1d(x, y))
    pairs = [(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets))]
    linked = {(names[i], names[j]) for i, j in pairs if 180 * inter(sets[i], sets[j]) >= 80 * (len(sets[i]) + len(sets[j]))}
    assert linked and linked <= got and len(linked) < len(pairs)


def test_near_links_in_regions_of_any_size(spark, docs):
    """A pair of similarity 0.8 that shares a region's four min-hashes and not the fifth, among many others in that region."""
    common = [f"6527c{j}" for j in range(80)]
    a, b = [*common, *[f"6527a{j}" for j in range(10)]], [*common, *[f"6527b{j}" for j in range(10)]]
    words = sorted({*a, *b})
    one = near_dedup.signatures(*near_dedup.shingles(pa.array(words), 1)).reshape(len(words), near_dedup.TREES, near_dedup.DEPTH)
    place = {w: i for i, w in enumerate(words)}
    low = [one[[place[w] for w in x]] for x in (a, b)]
    same = (low[0].min(0) == low[1].min(0)).cumprod(1).sum(1)  # how many min-hashes the two keys of a tree share
    trees = np.flatnonzero(same >= near_dedup.LEAST)
    assert len(trees) and same.max() == near_dedup.LEAST
    rows = [(0, " ".join(a)), (1, " ".join(b))]
    for t in trees:
        key = [a[low[0][:, t, d].argmin()] for d in range(near_dedup.LEAST)]
        lower, x = min((low[i][:, t, near_dedup.LEAST].min(), i) for i in (0, 1))
        fifth = (a, b)[x][low[x][:, t, near_dedup.LEAST].argmin()]
        for n in range(60):  # every third stands between the two in the sorted order
            rows.append((len(rows), " ".join([*key, *[fifth] * (n % 3 == 0), f"own{t}x{n}", f"own{t}y{n}"])))
    got = {r.doc_id: r.component_id for r in near_dedup.near_groups(docs(rows), 1).collect()}
    assert got == {i: 0 if i == 1 else i for i, _ in rows}


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(20)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {**dict.fromkeys(range(21), 0), **dict.fromkeys(range(100, 140), 100)}


def test_fm_index_counts():
    rng = np.random.default_rng(1)
    text = rng.integers(0, 4, 400)
    index = FmIndex(text)
    starts = np.flatnonzero([0 not in text[i : i + 3] and i + 3 <= len(text) for i in range(len(text))])
    lo, hi = index.search(text, starts, 3)
    for s, a, b in zip(starts, lo, hi, strict=True):
        places = [i for i in range(len(text) - 2) if list(text[i : i + 3]) == list(text[s : s + 3])]
        assert sorted(index.order[a:b]) == (places if len(places) > 1 else [])


@pytest.mark.parametrize("hot", [10_000, 0])
def test_substrings(spark, docs, hot):
    rng = random.Random(3)
    few = [str(rng.randint(0, 4)) for _ in range(60)]
    many = [str(i) for i in range(500)]
    rows = [
        (1, " ".join(few)), (2, " ".join(many[:100] + few[:40])), (3, None), (4, ""), (5, "a " * 80), (6, " ".join(many[60:110])),
        (7, " ".join(many[200:240])), (8, " ".join(many[300:334])), (9, " ".join(many[300:334])),
        (10, " x\n" + " ".join(many[400:437] * 2)), (11, " ".join(many[240:300])), (11, " ".join(many[240:300])), (None, " ".join(many[:36])),
    ]
    count = {}
    words = [re.findall(WORD, t or "") for _, t in rows]
    for w in words:
        for j in range(len(w) - 34):
            count[tuple(w[j : j + 35])] = count.get(tuple(w[j : j + 35]), 0) + 1
    want = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = [any(count[tuple(w[j : j + 35])] > 1 for j in range(max(0, p - 34), min(p, len(w) - 35) + 1)) for p in range(len(w))]
        want.append((i or 0, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    got = substring_dedup.remove_repeats(docs(rows), hot=hot, block_bytes=300, shard_segments=5).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_removed, r.kept) for r in got) == sorted(want)
    assert substring_dedup.remove_repeats(docs([])).collect() == []


def test_anchors_are_found_once_and_counted_by_block(spark, docs):
    line = " ".join(str(i) for i in range(40))
    rows = [(i, f"a{i} {line} b{i} " * 3) for i in range(20)]
    packed, blocks = substring_dedup.in_blocks(substring_dedup.texts(docs(rows)), 2000)
    assert blocks > 3
    anchors = substring_dedup.find_anchors(packed, 35, 16)
    found = anchors.collect()
    assert len({(r.gram, r.block) for r in found}) == len(found)
    places = {}
    for r in found:
        places[r.gram] = places.get(r.gram, 0) + r.n
    assert max(places.values()) >= 60 and any(r.n > 3 for r in found)
    repeated = substring_dedup.repeated_anchors(anchors, 30)
    want = {(r.block, r.gram, places[r.gram] > 30) for r in found if places[r.gram] > 1}
    assert {(r.block, r.gram, r.hot) for r in repeated.collect()} == want and {hot for _, _, hot in want} == {True, False}
    assert repeated._jdf.queryExecution().optimizedPlan().toString().count("FlatMapGroupsInArrow") == 1
