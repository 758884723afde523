"""LM scoring: marginal probability of a document over all segmentations of a subword lattice.

A word's lattice holds every way to spell it with the pieces of a public vocabulary, weighted by
that vocabulary's own scores. The forward recursion, in log space and for a batch of words at once,
sums over all paths. A document is its words, each begun by a word-start piece, and an end; as
pieces never run over words, its marginal is the product of its words' marginals.

The vocabulary at hand has ranks for scores: piece number r gets the weight 1 / (100 + r), as in
Zipf's law, and weights are divided by their sum. From there the model learns from the training
documents: rounds of expectation maximisation over their distinct words, and one more arc in the
lattice of each word that they have, from its first node to its last. Of n tokens in training with
v distinct ones, c of them a word, that arc weighs c / (n + v), and the pieces' paths share the
v / (n + v) that are left (Witten and Bell's rule). Without rounds, the vocabulary's own weights
are the whole model.

The work is one pass over the texts, which leaves one row for each word of a few megabytes of
text, a sum by word and a join by word; Spark splits hot words, of which there are many rows.
Documents have row numbers of their own in between, so that equal ids stay apart.
"""

from __future__ import annotations

import math

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landmesh.llm.bpe import vocabulary_path
from landmesh.llm.common import materialize, table, text_runs

#: The token after each document's last word; no word is empty.
END = ""
#: Offset of the Zipf-Mandelbrot law that turns a piece's rank into its weight.
RANK_OFFSET = 100.0
#: Bytes of text whose equal words share a row.
RUN = 10 << 20
#: Words whose lattices are computed together.
WORDS = 20_000
#: Rounds of expectation maximisation, and uses of pieces that the vocabulary's weights count as.
ROUNDS, PRIOR = 2, 1000.0
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


class Pieces:
    """The ordinary pieces of a vocabulary whose scores are negative ranks; then byte and end."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        odd = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)
        ids = [i for i in range(model.get_piece_size()) if not odd(i)]
        ids = [i for i in ids if "▁" not in model.id_to_piece(i)[1:]]
        weight = np.array([1.0 / (RANK_OFFSET - model.get_score(i)) for i in ids])
        least = weight.min()
        #: 256 bytes of equal weight, for characters that no piece has, and the end of a document.
        self.byte, self.end = len(ids), len(ids) + 1
        weight = np.concatenate([weight, [256 * least, least]])
        self.log_weight = np.log(weight / weight.sum())
        self.machine = ahocorasick.Automaton()
        for at, i in enumerate(ids):
            self.machine.add_word(model.id_to_piece(i), (len(model.id_to_piece(i)), at))
        self.machine.make_automaton()
        self.single = {model.id_to_piece(i) for i in ids if len(model.id_to_piece(i)) == 1}

    def fitted(self, expected: np.ndarray) -> np.ndarray:
        """Log weights after pieces were used so often."""
        used = expected + PRIOR * np.exp(self.log_weight)
        return np.log(used / used.sum())


class Lattices:
    """The lattices of some words, side by side: nodes are places between characters."""

    def __init__(self, pieces: Pieces, words: list[str]):
        self.pieces = pieces
        text = "".join(["▁" + w for w in words])
        size = np.array([len(w) + 1 for w in words], dtype=np.int64)
        self.first = np.cumsum(size) - size + np.arange(len(words))  # each word's first node
        self.last = self.first + size
        self.nodes = int(self.last[-1]) + 1
        flat = np.fromiter((x for last, (n, piece) in pieces.machine.iter(text) for x in (last, n, piece)), dtype=np.int64).reshape(-1, 3)
        other = {c for c in set(text) if c not in pieces.single}
        if other:
            at = np.array([i for i, c in enumerate(text) if c in other], dtype=np.int64)
            flat = np.concatenate([flat, np.stack([at, np.ones_like(at), np.full_like(at, pieces.byte)], axis=1)])
            self.bytes = {int(i): len(text[i].encode()) for i in at}
        else:
            self.bytes = {}
        word = np.searchsorted(np.cumsum(size), flat[:, 0], side="right")
        head = flat[:, 0] + 1 + word  # the arc's end as a node
        place = head - self.first[word]
        order = np.lexsort((flat[:, 1], place))
        self.head, self.length, self.piece = head[order], flat[order, 1], flat[order, 2]
        self.tail = self.head - self.length
        step = place[order] * (int(self.length.max(initial=1)) + 1) + self.length
        self.steps = np.concatenate([[0], np.flatnonzero(np.diff(step)) + 1, [len(step)]]) if len(step) else np.zeros(1, int)
        self.times = np.ones(len(order))  # a byte's weight counts once for each byte
        if self.bytes:
            for k in np.flatnonzero(self.piece == pieces.byte):
                self.times[k] = self.bytes[int(flat[order[k], 0])]

    def arcs(self, log_weight: np.ndarray) -> np.ndarray:
        out = log_weight[self.piece]
        return np.where(self.piece == self.pieces.byte, (out - math.log(256)) * self.times, out)

    def forward(self, arcs: np.ndarray) -> np.ndarray:
        """Log of all paths' weight from a word's first node to each node."""
        f = np.full(self.nodes, -np.inf)
        f[self.first] = 0.0
        # Arcs of one step end at the same place of their words and are of one length, so that
        # no two of them share a node.
        for a, b in zip(self.steps[:-1], self.steps[1:], strict=True):
            head = self.head[a:b]
            f[head] = np.logaddexp(f[head], f[self.tail[a:b]] + arcs[a:b])
        return f

    def backward(self, arcs: np.ndarray) -> np.ndarray:
        """Log of all paths' weight from each node to its word's last one."""
        g = np.full(self.nodes, -np.inf)
        g[self.last] = 0.0
        for a, b in zip(self.steps[-2::-1], self.steps[:0:-1], strict=True):
            tail = self.tail[a:b]
            g[tail] = np.logaddexp(g[tail], g[self.head[a:b]] + arcs[a:b])
        return g

    def marginals(self, log_weight: np.ndarray | None = None) -> np.ndarray:
        return self.forward(self.arcs(self.pieces.log_weight if log_weight is None else log_weight))[self.last]

    def expected(self, log_weight: np.ndarray) -> np.ndarray:
        """How often each piece is used, on average over the words' segmentations."""
        arcs = self.arcs(log_weight)
        f, g = self.forward(arcs), self.backward(arcs)
        word = np.searchsorted(self.first, self.tail, side="right") - 1
        share = np.exp(f[self.tail] + arcs + g[self.head] - f[self.last][word])
        return np.bincount(self.piece, share * self.times, minlength=len(log_weight))


_LOADED: dict[str, Pieces] = {}


def load(path: str) -> Pieces:
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def fit(words: DataFrame, path: str, rounds: int) -> np.ndarray:
    """Log weights of the pieces after some rounds over a table of distinct words."""
    weight = load(path).log_weight
    for _ in range(rounds):

        def run(batches, weight=weight):
            pieces = load(path)
            total = np.zeros(len(weight))
            for batch in batches:
                for i in range(0, batch.num_rows, WORDS):
                    column = batch.column(0).slice(i, WORDS).to_pylist()
                    some = [w for w in column if w]
                    total[pieces.end] += len(column) - len(some)
                    if some:
                        total += Lattices(pieces, some).expected(weight)
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], ["piece", "n"])

        expected = np.zeros(len(weight))
        for row in words.select("word").mapInArrow(run, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect():
            expected[row.piece] = row.n
        weight = load(path).fitted(expected)
    return weight


def with_lattice(words: DataFrame, path: str, weight: np.ndarray) -> DataFrame:
    """words with the natural log of each word's marginal; that of the end for the empty word."""

    def run(batches):
        pieces = load(path)
        for batch in batches:
            for i in range(0, batch.num_rows, WORDS):
                part = batch.slice(i, WORDS)
                column = part.column(0).to_pylist()
                some = [w for w in column if w]
                got = iter(Lattices(pieces, some).marginals(weight).tolist()) if some else iter(())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([next(got) if w else float(weight[pieces.end]) for w in column])], ["word", "c", "lattice"])

    return words.select("word", "c").mapInArrow(run, "word string, c long, lattice double")


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


_POSTINGS = pa.schema([("word", pa.string()), ("trained", pa.int64()), ("base", pa.int64()), ("docs", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32())), ("ids", pa.list_(pa.int64()))])


def _run_postings(batch, data: np.ndarray, offsets: np.ndarray, base: int) -> pa.RecordBatch:
    """The words of a run of texts, whose rows are numbered from base on."""
    n = batch.num_rows
    texts = pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(_LOWER[data])])
    lists = pc.ascii_split_whitespace(texts)
    coded = lists.flatten().dictionary_encode()
    words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    word, doc = coded.indices.to_numpy().astype(np.int64), np.repeat(np.arange(n), lists.value_lengths().to_numpy(zero_copy_only=False))
    if END in words:  # beside white space at a text's ends
        some = word != words.index(END)
        word, doc = word[some], doc[some]
    word, doc = np.append(word, np.full(n, len(words))), np.append(doc, np.arange(n))
    key, count = np.unique(word * n + doc, return_counts=True)
    word, doc = key // n, key % n
    head = np.flatnonzero(np.diff(word, prepend=-1))
    out = batch.column(batch.schema.get_field_index("out")).to_numpy(zero_copy_only=False).astype(bool)
    trained = np.add.reduceat(np.where(out[doc], 0, count), head)
    ends = pa.array(np.append(head, len(word)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (doc, count)]
    # The end stands in every text: its row carries the ids.
    ids = pa.array([[]] * (len(head) - 1) + [batch.column(0).to_pylist()], pa.list_(pa.int64()))
    names = pa.array(words + [END]).take(pa.array(word[head]))
    return pa.RecordBatch.from_arrays([names, pa.array(trained.astype(np.int64)), pa.array(np.full(len(head), base)), *lists, ids], schema=_POSTINGS)


def postings(documents: DataFrame) -> DataFrame:
    """For each word of a few megabytes of text: word, trained (its count in training documents),
    base (number of the first row of that text), docs (rows after it) and counts; the end's row
    has the rows' ids too."""

    def run(batches):
        base = TaskContext.get().partitionId() << 33
        for batch, data, offsets in text_runs(batches, most=RUN):
            yield _run_postings(batch, data, offsets, base)
            base += batch.num_rows

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out(F.col("doc_id")).alias("out"))
    return rows.mapInArrow(run, "word string, trained long, base long, docs array<int>, counts array<int>, ids array<long>")


def score(documents: DataFrame, path: str | None = None, rounds: int = 0) -> DataFrame:
    """Score every document (doc_id, text) by what the documents that are not held out have.

    rounds: of learning by the training documents; 0 for the vocabulary's own weights alone.
    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigram) and
    score (the lattice's), both log10; one row for each row, also of repeated or null ids. Null
    text counts as empty, which is the end alone. A null id counts as the empty text for the
    fold. Without training documents every token is new; an empty table gives no rows.
    """
    path = path or vocabulary_path("piece_bpe_32k.model")
    rows = materialize(postings(documents), "postings")
    words = materialize(rows.groupBy("word").agg(F.sum("trained").alias("c")), "words")
    total = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    n, v = total.n, total.v
    c = F.col("c")
    base = F.log10((c + 1) / F.lit(float(n + v + 1)))
    model = F.col("lattice")
    weight = fit(words.filter("c > 0"), path, rounds)
    if rounds and n:
        # In logs, as a long word's marginal may be under the least double.
        whole, pieces = F.log(c / F.lit(float(n + v))), model + math.log(v / (n + v))
        high, low = F.greatest(whole, pieces), F.least(whole, pieces)
        model = F.when(c > 0, high + F.log1p(F.exp(low - high))).otherwise(pieces)
    scored = with_lattice(words, path, weight).select("word", base.alias("b"), (model / math.log(10)).alias("m"), (c > 0).alias("known"))
    entry = F.explode(F.arrays_zip("docs", "counts", "ids")).alias("p")
    joined = rows.select("word", "base", "docs", "counts", "ids").join(scored, "word").select("base", "b", "m", "known", entry)
    k = F.col("p.counts").cast("long")
    sums = joined.groupBy((F.col("base") + F.col("p.docs")).alias("row")).agg(
        F.max("p.ids").alias("doc_id"),
        F.sum(k).alias("n_tokens"),
        F.sum(F.when(F.col("known"), k).otherwise(0)).alias("n_known"),
        F.sum(k * F.col("b")).alias("base_score"),
        F.sum(k * F.col("m")).alias("score"),
    )
    return sums.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents").select("doc_id", "text"), rounds=ROUNDS)
