"""Tokenizers, quality, decontamination and the pipeline."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from wagelens.llm import bpe, decontaminate, near_dedup, quality, token_files, vocab
from wagelens.llm.common import BATCH_ROWS, BATCHES
from wagelens.llm.wordbatch import PART_BYTES, Words, split_parts, text_bytes
from wagelens.session import scratch_path

SF = "/root/testdata/sf0.001"
ODD = [
    (5, "Hĥ H̱x It's 'S x.'s a.B,c!!  é,É.é ẞ 中文字符"), (3, None), (3, ""), (3, "b a"), (None, "Don't <|endoftext|>. STOP,now"),
    (9, " \n\x0b q w "), (10, "ab" * 300), (11, "word " * 3000),
]
ALPHABET = "  \n\t ab's'tre'll'vedm12!,.é中  ١'\x1c"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=ALPHABET, max_size=30), max_size=12))
def test_pieces_and_words_of_any_text(texts):
    space = r"\p{White_Space}"
    pattern = public_tokenizers.PATTERN.replace(r"[^\s", rf"[^{space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", space)
    for got, rule in ((bpe.Pieces(pa.array(texts, pa.string())), pattern), (Words(pa.array(texts, pa.string())), r"[^\x20\x09-\x0D]+")):
        names = got.uniques.to_pylist()
        assert [[names[c] for c in got.codes[a:b]] for a, b in zip(got.offsets[:-1], got.offsets[1:], strict=True)] == [regex.findall(rule, t) for t in texts]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=ALPHABET, max_size=30)), max_size=12), st.integers(1, 40))
def test_texts_split_in_parts_as_at_once(texts, limit):
    for split in (bpe.Pieces, Words):
        whole = split(pa.array(texts, pa.large_string()))
        codes, uniques, offsets = split_parts(pa.array(texts, pa.large_string()), split, limit)
        assert codes.tolist() == whole.codes.tolist() and offsets.tolist() == whole.offsets.tolist()
        assert uniques.to_pylist() == whole.uniques.to_pylist()


def test_no_block_is_split_at_once(monkeypatch):
    """What a split of all texts of a block takes at its highest is bounded by a part, not by the block."""
    seen = []

    class Counted(Words):
        def __init__(self, texts):
            seen.append(len(text_bytes(texts)[0]))
            super().__init__(texts)

    text = pa.array([f"w{i} " * 2000 for i in range(1000)], pa.large_string())
    Counted.by_parts(text)
    assert sum(seen) == len(text_bytes(text)[0]) > 8 << 20 and max(seen) < 1.1 * PART_BYTES
    seen.clear()
    calls = []

    class Frame:
        def groupBy(self, *_):
            return self

        cogroup = select = groupBy

        def applyInArrow(self, f, _):
            calls.append(f)
            return self

        mapInArrow = applyInArrow

    monkeypatch.setattr(vocab, "in_blocks", lambda docs, block_bytes: (Frame(), 4))
    vocab.encoded(None, Counted, lambda rows: rows)
    distinct, _, _, assembled = calls
    block = pa.table({"block": pa.array([0], pa.int32()), "data": pa.array([vocab.pack(pa.table({"doc_id": range(1000), "text": text}))], pa.binary())})
    rows = distinct(block).to_pylist()
    lists = [[len(w) for w in vocab.unpack(r["words"]).column("w").to_pylist()] for r in rows]
    answers = [{"block": 0, "bucket": r["bucket"], "n": vocab.pack(pa.table({"n": pa.array([1] * len(x), pa.int32())})), "v": vocab.pack(pa.table({"v": pa.array(x, pa.int32())}))} for r, x in zip(rows, lists, strict=True)]
    got = assembled(block, pa.Table.from_pylist(answers))
    assert got.column("ids").to_pylist() == [[len(f"w{i}")] * 2000 for i in range(1000)] and got.column("ids").num_chunks > 1
    assert max(seen) < 1.1 * PART_BYTES


def test_buckets_are_those_of_the_engine(spark):
    keys = ["", "A", "41", "AB", "ABC", "ABCD", "0123456789ABCDEF", "E4B8ADE69687", "FF" * 33]
    rows = spark.createDataFrame([(k,) for k in keys], "k string").selectExpr("k", f"hash(k) & {bpe.BUCKETS - 1} as h")
    assert {r.k: r.h for r in rows.collect()} == {k: bpe._bucket(k) for k in keys}


def test_byte_bpe(spark, docs, table):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.query(spark, table(documents=docs(ODD))).collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t in ODD:
        ids = enc.encode_ordinary(t or "")
        want.append((i or 0, len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())))
    assert sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(want)


def test_token_files(spark, docs):
    from tokenizers import Tokenizer

    file = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(file)
    path = scratch_path(spark, "orc")
    token_files.write(token_files.encode(docs(ODD), file), path, token_files.file_cuts(docs(ODD)))
    got = sorted(token_files.digests(spark, path).collect(), key=lambda r: r.start)
    ids = [(i or 0, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in ODD]
    want = sorted((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ids)
    assert sorted((r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == want
    assert [r.doc_id or 0 for r in got] == sorted(i for i, _ in ids)
    assert [r.start for r in got] == list(np.cumsum([0, *[r.n_tokens for r in got[:-1]]]))
    one = token_files.read(spark, path).where("doc_id = 9")
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,9)]" in one._jdf.queryExecution().toString()
    assert one.count() == 1
    empty = scratch_path(spark, "orc")
    token_files.write(token_files.encode(docs([]), file), empty, token_files.file_cuts(docs([])))
    assert token_files.digests(spark, empty).collect() == []


def test_token_files_added_tokens_in_other_case(spark, docs):
    from tokenizers import Tokenizer

    file = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(file)
    spellings = ["<|ENDOFTEXT|>", "<|EndOfText|>x", "A<|endoftext|><|Endoftext|>B", "<|STARTOFTEXT|> <|startoftext|>É", "<<|endoftexT|>.Q", "<|endoftext|"]
    rows = [*enumerate(spellings), (len(spellings), "Ab " + " Cd,".join(spellings))]
    path = scratch_path(spark, "orc")
    token_files.write(token_files.encode(docs(rows), file), path, token_files.file_cuts(docs(rows)))
    got = {r.doc_id: list(r.ids) for r in token_files.read(spark, path).collect()}
    assert got == {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 2] for i, t in rows}


def test_quality_learns_and_never_reads_held_out_labels(spark, docs):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    text = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in quality.classify(text, labels).collect()}
    marks = [(r.quality, got[r.doc_id]) for r in labels.collect() if got[r.doc_id].held_out]
    assert np.mean([q == r.predicted for q, r in marks]) >= 0.95
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 1 - quality else quality end as quality")
    again = {r.doc_id: r.score for r in quality.classify(text, flipped).collect()}
    assert max(abs(again[i] - r.score) for i, r in got.items()) < 1e-6


def test_quality_without_labels(spark, docs):
    rows = docs([(1, None), (2, ""), (2, "a b"), (None, "x " * 5000)])
    none = spark.createDataFrame([(1, None)], "doc_id long, quality int")
    assert [r.score for r in quality.classify(rows, none).collect()] == [0.5] * 4
    assert quality.keep_good(spark, rows, none).columns == rows.columns
    assert quality.classify(docs([]), none).collect() == []


@pytest.mark.parametrize("max_seeds", [1_000_000, 0])
def test_decontamination(spark, docs, max_seeds):
    item = [f"w{i}" for i in range(40)]
    edited = [*item[:10], "other", *item[11:25], "more", "words", *item[25:]]
    rows = [
        (1, "before " * 50 + " ".join(item) + " after"), (2, " ".join(edited).upper()), (3, " ".join(item[:12])), (4, None), (5, ""),
        (6, "a, b! c"), (7, " ".join(item[::-1])), (None, " ".join(item)), (8, " ".join(item)), (8, " ".join(item)),
    ]
    items = spark.createDataFrame([(0, " ".join(item)), (1, "A b c."), (2, None), (3, "")], "item_id long, text string")
    got = decontaminate.contaminated(docs(rows), items, max_seeds=max_seeds).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 0), (2, 0), (None, 0), (8, 0), (6, 1)} and len(got) == 5
    if max_seeds:
        assert sorted(r.doc_id for r in decontaminate.keep_clean(docs(rows), items).collect()) == [3, 4, 5, 7]
        assert decontaminate.contaminated(docs([]), items).collect() == []


def alignment(item, text):
    """Best local score of two lists of words (match 2, mismatch -1, gap -1) over the item's perfect score."""
    row, best = [0] * (len(text) + 1), 0
    for x in item:
        new = [0]
        for j, y in enumerate(text):
            new.append(max(0, row[j] + (2 if x == y else -1), row[j + 1] - 1, new[j] - 1))
        row, best = new, max(best, max(new))
    return best / (2 * len(item))


def test_edited_copies_beside_intact_ones(spark, docs):
    """Of all pairs that align with the threshold or more, edited ones beside intact ones, over 0.95 are found, with their scores, and no others."""
    rng = np.random.default_rng(7)
    opening = "which of the following is".split()
    items = [[*(opening if k % 2 else []), *[f"i{k}w{j}" if rng.random() < 0.7 else f"c{rng.integers(30)}" for j in range((24, 40, 64)[k % 3])]] for k in range(18)]
    rows = [" ".join(["x"] * c + item) for item in items for c in range(2)]
    for k, item in enumerate(items):
        for share in (0.1, 0.15, 0.2, 0.25):
            words = list(item)
            for at in rng.choice(len(item), round(share * len(item)), replace=False):
                words[at] = ("new", "", f"{words[at]} added")[rng.integers(3)]
            rows.append(" ".join(["y"] * int(rng.integers(30)) + [w for w in words if w]))
        # Every fifth word replaced; every fourth put in; the last third cut off.
        rows.append(" ".join("z" if j % 5 == k % 5 else w for j, w in enumerate(item)))
        rows.append(" ".join(f"{w} put" if j % 4 == 3 else w for j, w in enumerate(item)))
        rows.append(" ".join(item[: -(len(item) // 3)]))
    rows.append(" ".join([*items[2][:12], *["z"] * 20, *items[2][12:]]))  # a long insertion
    rows += [" ".join([*opening, *rng.choice([f"c{j}" for j in range(30)], 40)]) for _ in range(20)]
    scores = {(i, k): alignment(item, t.split()) for i, t in enumerate(rows) for k, item in enumerate(items)}
    want = {pair: s for pair, s in scores.items() if s >= decontaminate.THRESHOLD}
    assert len(want) > 120
    tests = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.contaminated(docs(list(enumerate(rows))), tests).collect()}
    assert got == pytest.approx({pair: s for pair, s in want.items() if pair in got})
    assert len(got) >= 0.95 * len(want)


def test_every_fifth_word_replaced(spark, docs):
    item = [f"w{j}" for j in range(40)]
    text = " ".join("z" if j % 5 == 4 else w for j, w in enumerate(item))
    tests = spark.createDataFrame([(0, " ".join(item))], "item_id long, text string")
    assert [(r.doc_id, r.item_id, r.score) for r in decontaminate.contaminated(docs([(1, text)]), tests).collect()] == [(1, 0, pytest.approx(alignment(item, text.split())))]


def test_a_shared_opening_proposes_no_pairs(spark):
    """Items and documents that share a common run of five words only are not aligned."""
    opening = "which of the following is"
    tests = spark.createDataFrame([(k, f"{opening} " + " ".join(f"i{k}w{j}" for j in range(30))) for k in range(40)], "item_id long, text string")
    items = decontaminate.Items(next(decontaminate.blocks(decontaminate.item_seeds(tests), 10**6)), decontaminate.THRESHOLD)
    texts = pa.array([f"{opening} " + " ".join(f"d{i}w{j}" for j in range(50)) for i in range(100)])
    assert list(items.stretches(*decontaminate.hashes(texts))) == []


def test_decontamination_of_very_long_texts(spark, docs):
    rng = np.random.default_rng(1)
    item = [f"w{j}" for j in range(30)]
    noise = lambda n: " ".join(rng.choice([f"n{j}" for j in range(500)], n))
    rows = [(1, noise(100_000) + " " + " ".join(item) + " " + noise(50_000)), (2, noise(100_000)), (3, " ".join(item[:5]) * 20_000)]
    tests = spark.createDataFrame([(0, " ".join(item))], "item_id long, text string")
    got = decontaminate.contaminated(docs(rows), tests).collect()
    assert [(r.doc_id, r.item_id, r.score, r.end_word) for r in got] == [(1, 0, 1.0, 100_030)]


def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    frame = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [frame.count()]
    for _, stage in cp.STAGES[:-1]:
        path = scratch_path(spark, "stage")
        stage(spark, frame, SF).write.parquet(path)
        after = spark.read.parquet(path)
        assert after.columns == frame.columns
        assert after.join(frame, ["doc_id", "text"], "left_semi").count() == after.count()
        frame = after
        seen.append(frame.count())
    assert seen == sorted(seen, reverse=True) and seen[-1] > 0
    assert frame.select("text").distinct().count() == frame.count()
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    texts = {r.doc_id: r.text for r in frame.collect()}
    assert not any(i in t for i in items for t in texts.values())
    last = cp.STAGES[-1][1](spark, frame, SF).collect()
    assert {r.doc_id: r.text for r in last} == texts


def test_packs_of_a_block_hold_rows_of_many_batches():
    batches = [pa.record_batch([pa.array([k % 2, 1], pa.int32()), pa.array([k, None], pa.int64()), pa.array([f"t{k}", ""])], ["block", "doc_id", "text"]) for k in range(50)]
    got = [(r["block"][0].as_py(), vocab.unpack(r["data"][0].as_py()).to_pylist()) for r in vocab.to_blocks(iter(batches))]
    assert [b for b, _ in got] == [0, 1]
    assert got[0][1] == [{"doc_id": k, "text": f"t{k}"} for k in range(0, 50, 2)] and len(got[1][1]) == 75
    assert list(vocab.to_blocks(iter([]))) == []


def test_shingles_are_taken_of_a_part_at_a_time(monkeypatch):
    seen, calls = [], []
    real = near_dedup.shingles
    monkeypatch.setattr(near_dedup, "shingles", lambda t, k: (seen.append(len(text_bytes(t)[0])), real(t, k))[1])

    class Frame:
        def mapInArrow(self, f, _):
            calls.append(f)
            return self

        def dropDuplicates(self, _):
            return self

    text = pa.array([f"a{i} b c d e f " * 1000 for i in range(300)])
    near_dedup.sketches(Frame(), 5)
    near_dedup.full_sets(Frame(), 5)
    sketches = list(calls[0](iter([pa.record_batch([pa.array(range(300)), text], ["doc_id", "text"])])))
    names = [c for b in sketches for c in b.column("c").to_pylist()]
    assert len(names) == 300 and [i for b in sketches for i in b.column("doc_id").to_pylist()] == list(range(300))
    sets = list(calls[1](iter([pa.record_batch([pa.array(names, pa.binary()), text], ["c", "text"])])))
    assert [c for b in sets for c in b.column("c").to_pylist()] == names
    assert sum(seen) > 2 * (4 << 20) and max(seen) < 1.1 * PART_BYTES


def test_few_rows_go_to_python_at_once(spark, docs, table):
    import corpus_pipeline as cp

    folder = table(documents=docs([(1, "a b"), (2, "a b")]))
    before = spark.conf.get(BATCHES)
    try:
        for given_, want in (("10000", BATCH_ROWS), ("0", BATCH_ROWS), ("50", 50)):
            for use in (lambda: cp.token_ids(spark, docs([]), SF), lambda: bpe.query(spark, folder)):
                spark.conf.set(BATCHES, given_)
                use()
                assert int(spark.conf.get(BATCHES)) == want
    finally:
        spark.conf.set(BATCHES, before)


def test_ranks_are_not_written_out_in_plans(spark):
    rows = spark.createDataFrame([(["abab", "ba"],)], "words array<string>")
    # A tenth of this is what each description took when the ranks were a literal.
    ranks = {bytes([a, b]): 256 + 256 * a + b for a in range(256) for b in range(64, 128)} | {bytes([a]): a for a in range(256)}
    out = bpe.fold_words(ranks, rows)
    assert out.columns == ["words", "ids"] and [len(w) for w in out.collect()[0].ids] == [2, 1]
    assert len(out._jdf.queryExecution().toString()) < 100_000


def naive(data, ranks):
    parts = [bytes([b]) for b in data]
    while found := [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]:
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


def test_folds_merge_in_order_of_rank_from_the_left(spark):
    rng = random.Random(5)
    words = ["".join(rng.choices("ab", k=n)) for n in range(1, 40)] + ["a" * n for n in range(1, 12)] + ["c", "cc", "cacb"]
    longer = [bytes(rng.choices(b"ab", k=rng.randint(2, 5))) for _ in range(40)]
    ranks = {t: i for i, t in enumerate(dict.fromkeys([*longer, b"a", b"b", b"c"]))}  # in no order that training gives
    got = bpe.fold_words(ranks, spark.createDataFrame([(words,)], "words array<string>")).collect()[0].ids
    assert got == [[ranks[w.encode()]] if w.encode() in ranks else naive(w.encode(), ranks) for w in words]
