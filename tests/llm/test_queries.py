"""Every registered query over a folder of tables with odd rows, against brute force."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from landmesh.llm import bpe, queries
from landmesh.llm.substring_dedup import removal
from tests.llm.test_operators import WORD, base_counts, corpus, sha


def rows() -> list[tuple]:
    """(doc_id, text): ids that repeat with other texts and with the same one, and null ids."""
    texts = [(i, t) for i, t, *_ in corpus()]
    long = texts[9][1]  # a passage inside other words
    own = " ".join(f"own{i}" for i in range(200))
    more = [(2, long), (2, "short"), (7, own), (7, own), (7, long), (None, long), (None, own), (None, None), (None, own), (60, own), (60, own + " " + own), (9, "x" * 120)]
    return texts + more


def brute_op1(docs):
    first: dict[bytes, int | None] = {}
    low = lambda i: -(1 << 63) if i is None else i
    for i, t in docs:
        data = (t or "").encode()
        for k in range(len(data) - 99):
            s = data[k : k + 100]
            first[s] = min(first.get(s, low(i)), low(i))
    for i, t in docs:
        data, seen = (t or "").encode(), set()
        gone = bytearray(len(data))
        for k in range(len(data) - 99):
            s = data[k : k + 100]
            if first[s] < low(i) or s in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(s)
        yield i, len(data), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(bytes(b for b, g in zip(data, gone, strict=True) if not g))


def brute_op9(docs):
    low = lambda i: -(1 << 63) if i is None else i
    first: dict[tuple, int] = {}
    split = [(i, WORD.findall(t or "")) for i, t in docs]
    for i, w in split:
        for k in range(len(w) - 49):
            s = tuple(w[k : k + 50])
            first[s] = min(first.get(s, low(i)), low(i))
    for i, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < low(i):
                gone[k : k + 50] = [True] * 50
        yield i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """The odd rows with columns that clash with the operators' own names, and the other tables."""
    folder = str(tmp_path_factory.mktemp("tables"))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "clash", "clash") for i, t in rows()], "doc_id long, text string, lang string, source string, n_chars long, n_words string, row string")
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    item = " ".join(WORD.findall(corpus()[9][1])[35:60])
    spark.createDataFrame([(1, item), (None, "two words"), (3, None), (3, "one")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def same(got, want):
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)


def test_suffix_query(spark, tables):
    same(queries.QUERIES["op1_suffix_dedup"](spark, tables).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect(), brute_op1(rows()))


def test_substring_query(spark, tables):
    same(queries.QUERIES["op9_substring_dedup"](spark, tables).select("doc_id", "n_words", "n_removed", "kept_sha256").collect(), brute_op9(rows()))


def test_carried_columns_keep_their_names(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    out = removal(docs, carry=tuple(docs.columns))
    assert out.select("carry.*").columns == docs.columns
    assert out.filter("carry.n_words != 'clash' or carry.row != 'clash'").count() == 0


def test_bpe_and_token_queries(spark, tables):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(bpe.vocabulary_path("byte_bpe_50k.json"))
    want = []
    for i, t in rows():
        ids = tool.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(tool.decode(ids, skip_special_tokens=False))))
    same(queries.QUERIES["op2_bpe"](spark, tables).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect(), want)
    tool = Tokenizer.from_file(bpe.vocabulary_path("word_bpe_49k.json"))
    got = queries.QUERIES["op10_token_store"](spark, tables).orderBy("start").collect()
    coded = [(i, np.array([*tool.encode(t or "", add_special_tokens=False).ids, 2], "<u4")) for i, t in rows()]
    same([(r.doc_id, r.n_tokens, r.ids_crc32) for r in got], [(i, len(x), zlib.crc32(x.tobytes())) for i, x in coded])
    order = [(r.doc_id is not None, r.doc_id or 0) for r in got]
    assert order == sorted(order)
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]


def test_quality_query(spark, tables):
    got = queries.QUERIES["op3_quality"](spark, tables).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    counts = [(i, base_counts(t)) for i, t in rows()]
    same(got, [(i, *c, c[0] < 50 or 100 * c[4] > 50 * c[0]) for i, c in counts])


def test_decontamination_query(spark, tables):
    item = [w.lower() for w in re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", " ".join(WORD.findall(corpus()[9][1])[35:60]).lower())]
    got = queries.QUERIES["op5_decontaminate"](spark, tables).collect()
    assert len(got) == len(rows())
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
    want = []
    for i, t in rows():
        w, hit, found = words(t), set(), set()
        for name, p in (("1", item), (None, ["two", "words"]), ("3", ["one"])):
            for k in range(max(1, len(p) - 9)):
                n = min(10, len(p))
                for a in range(len(w) - n + 1):
                    if w[a : a + n] == p[k : k + n]:
                        hit.update(range(a, a + n))
                        found.add(name)
        want.append((i, len(w), len(hit), len(found), sha(",".join(sorted(x for x in found if x))), bool(hit)))
    same([(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got], want)


def test_lm_query_has_a_row_for_each_row(spark, tables):
    got = queries.QUERIES["op6_lm_score"](spark, tables).collect()
    same([(r.doc_id, r.n_tokens) for r in got], [(i, len(WORD.findall(t or "")) + 1) for i, t in rows()])


def test_lm_query_scores_held_out_rows_near_the_base(spark):
    """The query's own model, over the smallest tables: their vocabulary alone is twice as far below."""
    got = [r for r in queries.QUERIES["op6_lm_score"](spark, "/root/testdata/sf0.001").collect() if r.held_out]
    assert got and sum(r.score for r in got) > 1.5 * sum(r.base_score for r in got)


def jaccard_components(docs):
    """(set, number of the component's first row) of each row."""
    sets = []
    for _, t in docs:
        w = WORD.findall((t or "").translate({i: i + 32 for i in range(65, 91)}))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    low = lambda k: (docs[k][0] is not None, docs[k][0] or 0, k)
    label = list(range(len(docs)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]) and label[i] != label[j]:
                keep, drop = sorted((label[i], label[j]), key=low)
                label = [keep if x == drop else x for x in label]
    return sets, label


def test_jaccard_query(spark, tables):
    sets, label = jaccard_components(rows())
    got = queries.QUERIES["op8_jaccard_join"](spark, tables).select("doc_id", "n_shingles", "component_id").collect()
    same(got, [(i, len(s), rows()[k][0]) for (i, _), s, k in zip(rows(), sets, label, strict=True)])


def test_pipeline_stages(spark, tables):
    """Each stage on its own input against brute force; then the whole run."""
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    names = dict(corpus_pipeline.STAGES)
    assert [k for k in names] == ["quality rules", "n-gram Jaccard join", "substring dedup", "benchmark decontamination", "BPE"]
    kept = names["quality rules"](spark, docs, tables)
    assert kept.columns == docs.columns
    allowed = [(i, t) for i, t in rows() if (c := base_counts(t))[0] >= 50 and 100 * c[4] <= 50 * c[0]]
    assert {(r.doc_id, r.text) for r in kept.collect()} <= set(allowed)
    near = names["n-gram Jaccard join"](spark, docs, tables)
    assert near.columns == docs.columns
    _, label = jaccard_components(rows())
    same([(r.doc_id, r.text) for r in near.collect()], [rows()[k] for k in sorted(set(label))])
    cut = names["substring dedup"](spark, docs, tables)
    assert cut.columns == docs.columns
    want = []
    for (i, t), (_, n, removed, _), (_, _, _, digest) in zip(rows(), brute_op9(rows()), brute_op9(rows()), strict=True):
        if removed == 0 or removed < n:
            want.append((i, sha(t or "") if removed == 0 else digest, "clash"))
    same([(r.doc_id, sha(r.text or ""), r.n_words) for r in cut.collect()], want)
    clean = names["benchmark decontamination"](spark, docs, tables)
    assert clean.columns == docs.columns
    found = queries.QUERIES["op5_decontaminate"](spark, tables).filter("not contaminated")
    assert clean.count() == found.count() > 0
    assert names["BPE"](spark, docs, tables).count() == len(rows())
    out = corpus_pipeline.run(spark, tables)
    assert 0 < out.count() < len(rows())
    for stage in names.values():
        assert stage(spark, docs.limit(0), tables).count() == 0


def test_hashes_of_texts(spark):
    """The digests of the queries are those of the bytes."""
    got = spark.createDataFrame([("ß",)], "t string").select(F.sha2("t", 256).alias("h")).first().h
    assert got == hashlib.sha256("ß".encode()).hexdigest()
