"""The discriminant against plain numpy, files of hot doc_ids, and the pipeline on odd rows against plain Python."""

import re
import tracemalloc

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

import corpus_pipeline
from wagelens.llm import bpe, decontaminate, quality, token_files
from wagelens.llm.wordbatch import by_bytes
from wagelens.session import scratch_path

SF = "/root/testdata/sf0.001"


def plain_features(text):
    """The statistics of one text, word by word."""
    import regex

    words = re.findall("[^\x20\x09-\x0d]+", text)
    n, least = len(words), max(len(words), 1)
    chars = max(sum(map(len, words)), 1)
    count = lambda pattern: sum(len(regex.findall(pattern, w)) for w in words)
    share = lambda x: np.log(x + quality.FLOOR)
    upper = [len(regex.findall(r"\p{Lu}", w)) for w in words]
    lines = text.split("\n")
    top = max((words.count(w) for w in set(words)), default=0)
    return [
        np.log1p(n), sum(map(len, words)) / least, share(sum(len(w) > 14 for w in words) / least), share(sum(upper) / chars),
        share(count(r"[^\p{L}\p{N}.,;:!?'\"|-]") / chars), share(count(r"\|") / least), share(count(r"[!?]") / least), share(count(r"\p{N}") / chars),
        share(sum(bool(regex.search(r"[^\p{L}\p{N}.,;:'\")\]-]{2,}$", w)) for w in words) / least),
        share(sum(u >= 2 and u >= 0.6 * len(w) for u, w in zip(upper, words, strict=True)) / least),
        np.log(max(len(set(words)), 1)) - 0.75 * np.log(least), share(top / least),
        share(sum(a == b for a, b in zip(words[:-1], words[1:], strict=True)) / least), np.log1p(n / max(len(lines), 1)),
        share(1 - len(set(lines)) / max(len(lines), 1)), share(sum(w.endswith(".") for w in words) / least),
    ]


TEXTS = ["", " \n", "One two two. Three!! | four\nOne two two. Three!! | four\n", "ÉÀ É!! Straße 123 a-b ### (x) ..", "verylongwordindeedyes " * 7, "x\n\n\nx"]


def test_statistics_against_plain_python():
    texts = [*TEXTS, *[t * 400 for t in TEXTS]]
    got = quality.features(pa.array([*texts, None]))
    assert got == pytest.approx(np.array([plain_features(t) for t in [*texts, ""]]), abs=1e-9)
    batch = pa.RecordBatch.from_arrays([pa.array([*texts, None])], ["text"])
    parts = [quality.features(b.column(0)) for b in by_bytes(batch, "text", 1000)]
    assert len(parts) > 3 and np.concatenate(parts) == pytest.approx(got)


def test_scores_against_plain_numpy(spark):
    """Means and covariances by numpy, densities by inverse and determinant of the shrunk covariances."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = {r.doc_id: r for r in quality.classify(rows, labels).collect()}
    texts = {r.doc_id: r.text or "" for r in rows.collect()}
    ids = sorted(texts)
    x = dict(zip(ids, quality.features(pa.array([texts[i] for i in ids])), strict=True))
    marked = {r.doc_id: r.quality for r in labels.collect() if not got[r.doc_id].held_out}
    groups = [np.array([x[i] for i, q in marked.items() if q == k]) for k in (0, 1)]
    cov = [np.cov(g, rowvar=False, bias=True) for g in groups]
    share = np.array([len(g) / len(marked) for g in groups])
    common = share[0] * cov[0] + share[1] * cov[1]
    scale = np.diag(np.maximum(np.diag(common), 1e-6))
    logs = []
    for k in (0, 1):
        c = (1 - quality.RIDGE) * ((1 - quality.POOLED) * cov[k] + quality.POOLED * common) + quality.RIDGE * scale + 1e-9 * scale
        centred = np.array([x[i] for i in ids]) - groups[k].mean(axis=0)
        logs.append(np.log(share[k]) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,jk,ik->i", centred, np.linalg.inv(c), centred))
    want = 1 / (1 + np.exp(-np.clip(logs[1] - logs[0], -500, 500)))
    assert [got[i].score for i in ids] == pytest.approx(list(want), abs=1e-6)
    assert all(r.predicted == (r.score >= 0.3) for r in got.values())


def test_very_long_text_has_a_score(spark, docs):
    rows = docs([(1, "word " * 300_000), (2, "x" * 500_000), (3, "a|b\n" * 100_000)])
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert len(quality.classify(rows, none).collect()) == 3


def test_hot_and_null_ids_fill_several_files(spark, docs):
    """A third of the rows with one doc_id and a third without: spread over files that stay in doc_id order."""
    rows = [*[(None, "same")] * 200, *[(7, f"text {i}") for i in range(200)], *[(i, f"other {i}") for i in range(200)]]
    table, file, path = docs(rows), public_tokenizers.path("word_bpe_49k.json"), scratch_path(spark, "orc")
    cuts = token_files.file_cuts(table)
    assert cuts.count(None) >= 2 and cuts.count(7) >= 2
    token_files.write(token_files.encode(table, file), path, cuts)
    got = token_files.read(spark, path).select("doc_id", "offset", "file").collect()
    sizes = {}
    for r in got:
        sizes[r.file] = sizes.get(r.file, 0) + 1
    assert len(got) == 600 and max(sizes.values()) < 200
    order = [-1 if r.doc_id is None else r.doc_id for r in sorted(got, key=lambda r: (r.file, r.offset))]
    assert order == sorted(order)
    done = token_files.digests(spark, path).collect()
    assert sorted(r.start for r in done) == list(np.cumsum([0, *[r.n_tokens for r in sorted(done, key=lambda r: r.start)][:-1]]))


@pytest.mark.parametrize("added", [(), ("<|endoftext|>", "<|startoftext|>")])
def test_remembered_words_are_bounded(added):
    from tokenizers import Tokenizer

    file = public_tokenizers.path("word_bpe_49k.json")
    known, whole = token_files.WordIds(file, 5, added), Tokenizer.from_file(file)
    for words in (["a", "bc", "def"], ["bc", "gh"], ["x", "y", "z", "bc"], ["q"], [f"w{i}" for i in range(20)], ["a"], ["é.b", "<|endoftext|>", "x<|EndOfText|>y", "中", "<|", "||>", "''", "\u200b", "a\u0301"]):
        at = known.of(pa.array(words, pa.large_string()))
        got = [list(known.values[known.ends[i] : known.ends[i + 1]]) for i in at]
        assert got == [whole.encode(w, add_special_tokens=False).ids for w in words]
        assert len(known.place) <= max(5, len(words))


PROSE = "One line of a text that is about nothing, with words enough to have runs of five of them in it; and then it ends."
ITEM = "The quick brown fox of this test item jumps over a lazy dog near the old river bank today."
ROWS = [
    (1, PROSE), (2, PROSE), (2, PROSE), (3, PROSE + " Indeed."), (None, PROSE), (4, None), (5, ""), (None, None), (6, "b " * 4000 + "end"), (7, f"x y z {ITEM} u v w"),
    (8, "Another text, unlike the others in all of its words but these few ones."), (9, " \n\t"), (9, "two words"),
]


def plain_pipeline(rows, item):
    """Every document is of good quality (no labels); the rest of the stages by comparing all pairs."""
    key = lambda i: -1 if i is None else i
    best = {}
    for i, t in rows:
        best[t or ""] = max(key(i), best.get(t or "", -2))
    left = sorted(((i, t) for t, i in best.items()))

    def runs(t):
        w = re.findall("[^\x20\x09-\x0d]+", t.lower())
        return {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set())

    group = {i: i for i, _ in left}
    near = [(a, b) for a, s in left for b, t in left if a < b and runs(s) and 100 * len(runs(s) & runs(t)) >= 80 * len(runs(s) | runs(t))]
    for _ in left:
        for a, b in near:
            group[a] = group[b] = min(group[a], group[b])
    bare = lambda t: [re.sub(r"^\W+|\W+$", "", w) or w for w in re.findall("[^\x20\x09-\x0d]+", t.lower())]
    return {(i, t) for i, t in left if group[i] == i and " ".join(bare(item)) not in " ".join(bare(t))}


def test_pipeline_on_odd_rows(spark, docs, table):
    """Nulls, empty and very long texts, ties, repeated rows and clashing names through all stages."""
    rows = [r for r in ROWS if r[0] is not None]
    none = spark.createDataFrame([(1, None)], "doc_id long, quality int")
    items = spark.createDataFrame([(0, ITEM), (1, None), (1, "")], "item_id long, text string")
    folder = table(documents=docs(rows), labels=none, benchmark=items)
    got = corpus_pipeline.run(spark, folder).collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted(plain_pipeline(rows, ITEM))
    assert all(r.n_tokens == len(r.ids) for r in got)


def test_stages_keep_columns_and_take_null_ids(spark, docs, table):
    none = spark.createDataFrame([(1, None)], "doc_id long, quality int")
    items = spark.createDataFrame([(0, ITEM)], "item_id long, text string")
    for rows in (ROWS, []):
        frame = docs(rows)
        folder = table(labels=none, benchmark=items)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, frame, folder)
            assert out.columns == frame.columns
            found = {(r.doc_id, r.text) for r in out.collect()}
            assert found <= set(rows) and (len(rows) == 0) == (len(found) == 0)
        assert len(corpus_pipeline.STAGES[-1][1](spark, frame, folder).collect()) == len(rows)
    assert {r.doc_id for r in decontaminate.keep_clean(docs(ROWS), items).collect()} == {i for i, _ in ROWS} - {7}


def test_memory_of_the_classifier_and_blocks_of_the_last_stage(spark):
    texts = pa.array([" ".join(f"{TEXTS[2]} w{i}-{j}" for j in range(20)) for i in range(5000)])
    assert texts.nbytes > 6 << 20
    few = texts.slice(100, 300)
    assert quality.sliced_features(few, 5000) == pytest.approx(quality.features(few))
    assert quality.sliced_features(texts.slice(0, 0)).shape == (0, len(quality.FEATURES))
    tracemalloc.start()
    try:
        quality.sliced_features(texts)
        assert tracemalloc.get_traced_memory()[1] < 60 << 20
    finally:
        tracemalloc.stop()
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, None])], "doc_id long, text string")
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    got, want = ({r.doc_id: r.ids for r in bpe.encode(rows, ranks, size).collect()} for size in (40, bpe.BLOCK_BYTES))
    assert got == want and len(got) == len(TEXTS) + 1 and corpus_pipeline.BLOCK_BYTES < bpe.BLOCK_BYTES
