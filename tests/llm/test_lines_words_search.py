"""Line cleaning, spelling variants and ranked search against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from wagelens.llm import lexical_search, line_cleaning, spelling

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")

PROSE = "The first line of a text ends with a stop.\nThe second one, not much longer, does so too.\n"
LINES = [
    (1, PROSE), (2, None), (3, ""), (4, " \n\t\x0b "), (5, PROSE + "Home | News | Sport | About\n" * 9), (6, PROSE + PROSE), (6, PROSE + PROSE),
    (None, "a b c d e a b c d e a b c d e f."), (7, "x " * 5000), (8, PROSE * 3 + "Click here to read more about cookies, please.\nSHOUTED LETTERS ARE A LINE.\n"),
    (9, "one two three four five six seven eight nine ten eleven. $$$ ### a%b <c>"), (10, "Ünïcode çhars é 中文 字符, and a nul \x00 of ten words or more."),
    (11, "z" * 50_000), (12, "\r\n".join(["A menu", "Login", "Words that end in a stop, as they should, and not in anything else."])), (13, " ".join(f"w{i}" for i in range(20_000)) + "."),
]


def repeated(words):
    at = defaultdict(list)
    for i in range(len(words) - 4):
        at[tuple(words[i : i + 5])].append(i)
    return len({j for places in at.values() if len(places) > 1 for i in places for j in range(i, i + 5)})


def plain_lines(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    distinct = list(dict.fromkeys(lines))

    def passes(x):
        n, marks = len(WORD.findall(x)), len(re.findall(line_cleaning.MARK, x))
        upper, lower = sum(c.isupper() for c in x), any(c.islower() for c in x)
        menu = len(re.findall(line_cleaning.SEPARATOR, x)) >= 2 or (n <= line_cleaning.SHORT and not re.search(line_cleaning.CLOSING, x))
        return not (line_cleaning.MARKED * marks > n or (not lower and upper >= line_cleaning.SHOUTED) or menu or any(b in x.lower() for b in line_cleaning.BOILERPLATE))

    clean = "\n".join(x for x in distinct if passes(x))
    size, left, again = sum(map(len, words)), sum(map(len, WORD.findall(clean))), repeated(words)
    failed = len(words) < 10 or 100 * again > 20 * len(words)
    kept = not failed and 100 * (size - left) <= line_cleaning.LOST * size
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), size, symbols, len(lines) - len(distinct), again, failed, kept, len(lines), left, hashlib.sha256(clean.encode()).hexdigest()


def test_line_cleaning(spark, docs, table):
    got = line_cleaning.query(spark, table(documents=docs(LINES))).collect()
    assert sorted(map(str, ((r[0], *r[1:]) for r in got))) == sorted(map(str, ((i, *plain_lines(t)) for i, t in LINES)))
    kept = {r.doc_id: r.text for r in line_cleaning.keep_clean(docs(LINES)).collect()}
    assert kept[1] == PROSE.strip() and 5 not in kept and {2, 3, 4, 7, 11}.isdisjoint(kept)
    assert line_cleaning.cleaned(docs([])).collect() == []


def test_line_cleaning_of_the_test_table(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r[0]: tuple(r[1:]) for r in line_cleaning.query(spark, SF).collect()}
    assert got == {r.doc_id: plain_lines(r.text) for r in rows}


def test_native_plans(spark):
    plan = line_cleaning.query(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def plain_variants(rows, ratio=10):
    count = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if c < "\x80" else c for c in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            count[w] += len(w) >= 7
    n = {w: c for w, c in count.items() if c >= 2}
    gaps, near = defaultdict(set), {w: set() for w in n}
    for w in n:
        for i in range(len(w)):
            gaps[w[:i], w[i + 1 :]].add(w)
    for (a, b), words in gaps.items():
        words = words | ({a + b} & n.keys())
        for w in words:
            near[w] |= words - {w}
    best = {w: min(s, key=lambda x: (-n[x], x)) for w, s in near.items() if s}
    form = {w: b for w, b in best.items() if n[b] >= ratio * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n[w], len(near[w]), n.get(form.get(w))) for w in n}


@pytest.mark.parametrize("group", [20_000, 3])
def test_spelling_variants(spark, docs, group):
    base = ["variant", "variante", "variants", "varyant", "vvariant", "éclairage", "eclairage", "éclairages", "aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "baaaaaaa", "aaaaaaab", "x" * 3000, "x" * 3001, "y" + "x" * 2999]
    rng = np.random.default_rng(3)
    letters = list("abcé")
    base += ["".join(rng.choice(letters, rng.integers(7, 10))) for _ in range(400)]
    rows = [(i, " ".join(rng.choice(base, 60))) for i in range(60)]
    rows += [(None, "Variant VARIANT variant, variant"), (1, None), (2, ""), (3, "×÷×÷×÷×÷ variant-variant " * 40), (3, "×÷×÷×÷×÷ variant-variant " * 40), (4, " ".join(base * 2))]
    rows += [(i, "threefold " * 9 + "threefolds threfold " * (i % 2)) for i in range(100, 130)]
    got = [tuple(r) for r in spelling.variants(docs(rows), group=group).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_variants(rows)
    assert any(f for _, f, *_ in got) and max(x[4] for x in got) >= 3
    assert spelling.variants(docs([])).collect() == []


def test_spelling_of_the_test_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert {tuple(r) for r in spelling.query(spark, SF).collect()} == plain_variants(rows)


def test_roots_follow_chains(spark):
    chain = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(9)] + [("a", "b")], "word string, form string")
    assert {(r.word, r.root) for r in spelling.roots(chain).collect()} == {(f"w{i}", "w9") for i in range(9)} | {("a", "b")}


def plain_search(rows, items):
    terms = lambda t: ["".join(c.lower() if c < "\x80" else c for c in w) for w in lexical_search.TERM.findall(t or "")]
    texts = [(i, terms(t)) for i, t in rows]
    texts = [(i, Counter(t), len(t)) for i, t in texts if t]
    big_n, big_l = len(texts), sum(n for _, _, n in texts)
    df = Counter(t for _, tf, _ in texts for t in tf)
    w = lambda t: math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1)))
    out = []
    for item_id, text in items:
        scores = []
        for i, tf, n in texts:
            m = 25 + (75 * n * big_n) // big_l
            scores.append((-sum(w(t) * ((10**9 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in terms(text)), i is None, i))
        best = sorted(s for s in scores if s[0] < 0)[:10]
        out += [(item_id, k + 1, i, -s) for k, (s, _, i) in enumerate(best)]
    return out


@pytest.mark.parametrize("block_terms,first,bucket", [(200_000, 20_000, 4096), (5, 3, 4)])
def test_ranked_search(spark, docs, monkeypatch, block_terms, first, bucket):
    monkeypatch.setattr(lexical_search, "FIRST", first)
    monkeypatch.setattr(lexical_search, "BUCKET", bucket)
    rng = np.random.default_rng(5)
    names = [f"t{i}" for i in range(60)]
    rows = [(int(i), " ".join(rng.choice(names, rng.integers(1, 40)))) for i in range(150)]
    rows += [(None, "t1 t2 t3"), (None, "t1 t2 t3"), (900, None), (901, ""), (902, "?!"), (903, "t4 " * 20_000), *[(500 + i, "T1, t2; T3") for i in range(30)], (500, "T1, t2; T3")]
    items = [(0, "t1 t2 t3 t3"), (1, None), (2, ""), (3, "none of these"), (4, "É t5 t6"), (4, "t7"), (5, " ".join(names)), (None, "t8 t9")]
    tests = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, item string, rank int")
    got = [tuple(r) for r in lexical_search.ranked(docs(rows), tests, block_terms).collect()]
    assert sorted(map(str, got)) == sorted(map(str, plain_search(rows, items)))
    assert lexical_search.ranked(docs([]), tests).collect() == []
    assert lexical_search.ranked(docs(rows), tests.limit(0)).collect() == []


def test_search_prunes(spark):
    """A bucket too short for an item's threshold, and documents without a focus coordinate, are not scored."""
    items = lexical_search.Items([{0: 1, 1: 1}], np.array([100, 100]))
    thresholds, top = np.array([5_000]), [[]]
    items.best(np.array([1]), np.array([False]), np.array([0]), np.array([10]), np.array([0, 1]), thresholds, top, np.array([10 * 10.0]))
    assert top == [[]]
    items.best(np.array([2]), np.array([False]), np.array([0, 1]), np.array([30, 30]), np.array([0, 2]), thresholds, top, np.array([30 * math.sqrt(200)]))
    assert top == [[(-6000, False, 2)]]


@pytest.mark.parametrize("module", [line_cleaning, lexical_search])
def test_sql(spark, module):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.sql(module.ORACLE)
    got = module.query(spark, SF).select(*want.columns)
    assert sorted(map(str, want.fetchall())) == sorted(str(tuple(r)) for r in got.collect())
