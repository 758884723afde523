"""N-gram Jaccard join by adaptive multi-match prefixes, and the components of its links.

A document is the set of its distinct five-word shingles; two link at a similarity of 0.8 or more.
Documents of equal sets are one class. Rows have keys of their own here (`doc_id` within the steps);
the ids of the table only say which row of a class or component is named as its first.

1. Shingles that only one document has can't be shared. A document links with nothing unless four
   fifths of its shingles are shared by others; only such documents go on.
2. Their shingles are put in one order, rare ones first. Among the first n - ceil(0.8 n) + l of a
   document, a linked one has at least l in common with it (the l-prefix). Each document takes the l
   that makes its estimated cost least: the frequencies of the prefix's shingles are what the index
   has to read, and more matches leave fewer candidates to verify.
3. Documents with enough matches are candidates. Lists of many documents give a star instead of
   pairs; it keeps them together, and the verification does not trust it.
4. Candidates' connected groups are verified by the whole sets: from each document on, all not yet
   reached ones are compared, so that no link between components is missed and those inside one
   need not be listed. Groups of more than HELD documents or HELD_BYTES of tokens are dealt in
   chunks instead: rounds compare a growing number of seeds, each with all documents of the group
   that have another component by then.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landmesh.llm.anchors import pack, unpack
from landmesh.llm.common import WORD_BASE, Scratch, Words, materialize, mix, number, prefix_hash, shuffle_parts, span_hash, table, text_runs, width_of

WORDS, PERCENT = 5, 80
CHUNK = 8 << 20
#: Bytes of entries for each partition.
PART_BYTES = 128 << 20
#: Parts that a partition's shingles are taken in, one after the other.
PASSES = 8
#: Longest prefix extension; lists above STAR documents give stars.
MOST_MATCHES, STAR = 4, 8
#: Cost of verifying a candidate, in index entries read.
VERIFY = 8.0
TOKEN = 6
#: Most documents and bytes of tokens of a group, or of a chunk of one, that a task takes at once.
HELD, HELD_BYTES = 500, 8 << 20
#: Seeds of a group in the first round, and how many times more in each next one.
SEEDS, MORE_SEEDS = 256, 16


def shingles(data: np.ndarray, offsets: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(document index, shingle hash), distinct and sorted, of a run of texts."""
    words = Words(data, offsets, lower=True)
    doc = np.repeat(np.arange(len(words.count)), words.count)
    grams = words.window_hash(k)
    inside = doc[: len(grams)] == doc[len(doc) - len(grams) :] if len(grams) else np.zeros(0, bool)
    short = np.flatnonzero((words.count > 0) & (words.count < k))
    whole = span_hash(prefix_hash(words.hash, WORD_BASE), words.first[short], words.first[short] + words.count[short])
    doc, token = np.concatenate([doc[: len(grams)][inside], short]), np.concatenate([grams[inside], whole])
    order = np.lexsort((token, doc))
    doc, token = doc[order], token[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (token[1:] != token[:-1])
    return doc[new], token[new]


def _signatures(doc: np.ndarray, token: np.ndarray, rows: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """n and the two halves of a 128-bit signature of each row's set."""
    n = np.bincount(doc, minlength=rows)
    ends = np.cumsum(n)
    sums = []
    for values in (token, mix(token ^ np.uint64(0x5851F42D4C957F2D))):
        total = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values, out=total[1:])
        sums.append((total[ends] - total[ends - n]).view(np.int64))
    return n, sums


def _set_rows(batches):
    """doc_id, id, n and a 128-bit signature of each document's set."""
    for batch, data, offsets in text_runs(batches):
        n, sums = _signatures(*shingles(data, offsets), batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), *map(pa.array, sums)], ["doc_id", "id", "n", "s1", "s2"])


_ENTRIES = pa.schema([("bucket", pa.int32()), ("base", pa.int64()), ("width", pa.int32()), ("size", pa.int32()), ("passes", pa.binary()), ("tokens", pa.binary()), ("docs", pa.binary())])
ENTRIES = "bucket int, base long, width int, size int, passes binary, tokens binary, docs binary"


def _deal(doc: np.ndarray, token: np.ndarray, parts: int, size: int) -> pa.RecordBatch:
    """One row of entries for each bucket: by pass, tokens sorted and as differences."""
    base = int(doc.min(initial=0))
    width = width_of(int(doc.max(initial=0)) - base)
    cell = (token % np.uint64(parts * PASSES)).astype(np.int64)
    cell = cell % parts * PASSES + cell // parts
    value = token >> np.uint64(64 - 8 * size)
    order = np.lexsort((value, cell))
    edge = np.searchsorted(cell[order], np.arange(parts * PASSES + 1))
    steps = np.diff(value[order], prepend=np.uint64(0))
    heads = edge[:-1][edge[:-1] < edge[1:]]
    steps[heads] = value[order][heads]  # each pass begins anew
    rows: list[list] = [[] for _ in _ENTRIES]
    for b in range(parts):
        ends = edge[b * PASSES : (b + 1) * PASSES + 1]
        i = slice(ends[0], ends[-1])
        if ends[0] < ends[-1]:
            for column, v in zip(rows, (b, base, width, size, np.diff(ends).astype("<i4").tobytes(), pack(steps[i], size), pack((doc[order[i]] - base).astype(np.uint64), width)), strict=True):
                column.append(v)
    return pa.RecordBatch.from_arrays([pa.array(r, f.type) for r, f in zip(rows, _ENTRIES, strict=True)], schema=_ENTRIES)


def _emit(parts: int, size: int, distinct: bool):
    """Entries of chunks of texts; distinct: of equal sets in a chunk, the smallest id's alone."""

    def flush(held):
        ids, n, s1, s2, token = (np.concatenate(x) for x in zip(*held, strict=True))
        if distinct and len(ids):
            order = np.lexsort((ids, s2, s1, n))
            new = np.ones(len(ids), dtype=bool)
            new[1:] = np.any([c[order][1:] != c[order][:-1] for c in (n, s1, s2)], axis=0)
            keep = np.zeros(len(ids), dtype=bool)
            keep[order[new]] = True
            token = token[np.repeat(keep, n)]
            ids, n = ids[keep], n[keep]
        return _deal(np.repeat(ids, n), token, parts, size)

    def run(batches):
        held, total = [], 0
        for batch, data, offsets in text_runs(batches):
            doc, token = shingles(data, offsets)
            n, sums = _signatures(doc, token, batch.num_rows)
            held.append((number(batch, "doc_id"), n, *sums, token))
            total += len(data)
            if total >= CHUNK:
                yield flush(held)
                held, total = [], 0
        if held:
            yield flush(held)

    return run


def _passes(batches):
    """(doc, token) arrays of one pass after the other of a partition's entries."""
    held: dict[int, list] = {}
    for batch in batches:
        for bucket, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held.setdefault(bucket, []).append([*row, np.concatenate([[0], np.cumsum(np.frombuffer(row[3], dtype="<i4"))])])
    for bucket in sorted(held):
        rows = held.pop(bucket)
        for k in range(PASSES):
            docs, tokens = [], []
            for base, width, size, _, token, doc, ends in rows:
                tokens.append(np.cumsum(unpack(token[ends[k] * size : ends[k + 1] * size], size)))
                docs.append(unpack(doc[ends[k] * width : ends[k + 1] * width], width).astype(np.int64) + base)
            yield np.concatenate(docs), np.concatenate(tokens)


def _by_doc_bucket(parts: int, doc: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """One row for each bucket of documents: the documents and the columns, as bytes."""
    bucket = (mix(doc.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    edge = np.searchsorted(bucket[order], np.arange(parts + 1))
    used = np.flatnonzero(edge[:-1] < edge[1:])
    cut = lambda c: pa.array([c[order[edge[b] : edge[b + 1]]].tobytes() for b in used], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *map(cut, (doc, *columns))], ["bucket", "docs", *"abc"[: len(columns)]])


def _gathered(batches, *kinds: str) -> list[np.ndarray]:
    """The columns of a partition's rows, each as one array."""
    held: list[list] = [[] for _ in kinds]
    for batch in batches:
        for i, kind in enumerate(kinds):
            held[i] += [np.frombuffer(x, dtype=kind) for x in batch.column(i + 1).to_pylist()]
    return [np.concatenate([np.zeros(0, dtype=kind), *h]) for kind, h in zip(kinds, held, strict=True)]


def _frequency(token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by token, and each ordered one's number of entries."""
    order = np.argsort(token, kind="stable")
    new = np.ones(len(token), dtype=bool)
    new[1:] = token[order][1:] != token[order][:-1]
    group = np.cumsum(new) - 1
    return order, np.bincount(group)[group] if len(group) else group


def _count_shared(parts: int):
    """By bucket of documents: how many of each one's shingles have other entries."""

    def run(batches):
        ids, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for doc, token in _passes(batches):
            order, often = _frequency(token)
            some, n = np.unique(doc[order][often > 1], return_counts=True)
            ids.append(some)
            counts.append(n)
        yield _by_doc_bucket(parts, np.concatenate(ids), np.concatenate(counts))

    return run


def _sum_shared(batches):
    doc, n = _gathered(batches, "<i8", "<i8")
    ids, at = np.unique(doc, return_inverse=True)
    total = np.bincount(at, n, minlength=len(ids)).astype(np.int64)
    for i in range(0, len(ids), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(ids[i : i + 100_000]), pa.array(total[i : i + 100_000])], ["doc_id", "shared"])


def _reply(parts: int):
    """By bucket of documents: their tokens and the tokens' frequencies."""

    def run(batches):
        docs, tokens, oftens = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for doc, token in _passes(batches):
            order, often = _frequency(token)
            docs.append(doc[order])
            tokens.append(token[order])
            oftens.append(often)
        yield _by_doc_bucket(parts, np.concatenate(docs), np.concatenate(tokens), np.concatenate(oftens).astype("<u4"))

    return run


def needed(n) -> np.ndarray:
    """Shingles that a document of n must share with one that it links with."""
    return -(-PERCENT * n // 100)


def _sets(batches):
    """Tokens of each document, rare ones first, if enough are shared; and the matches to ask for."""
    docs, tokens, oftens = _gathered(batches, "<i8", "<u8", "<u4")
    order = np.lexsort((tokens, oftens, docs))
    docs, tokens, oftens = docs[order], tokens[order], oftens[order].astype(np.int64)
    head = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]])) if len(docs) else np.zeros(0, int)
    out: list[list] = [[], [], [], []]
    for a, b in zip(head.tolist(), [*head[1:].tolist(), len(docs)], strict=False):
        n = b - a
        least = int(needed(n))
        if int((oftens[a:b] > 1).sum()) < least:
            continue
        cost = np.cumsum(oftens[a:b] - 1)
        matches = range(1, min(MOST_MATCHES, least) + 1)
        best = min(matches, key=lambda m: cost[n - least + m - 1] * (1 + VERIFY / m**2))
        for column, v in zip(out, (docs[a], n, best, pack(tokens[a:b], TOKEN)), strict=True):
            column.append(v)
    for i in range(0, len(out[0]), 2000):
        yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 2000], k) for c, k in zip(out, (pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["doc_id", "n", "matches", "tokens"])


def _emit_prefixes(parts: int):
    def run(batches):
        for batch in batches:
            cells: dict[int, list] = {}
            doc, token, n, matches = [], [], [], []
            for d, size, m, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                end = size - int(needed(size)) + m
                token.append(unpack(raw[: end * TOKEN], TOKEN))
                doc.append(np.full(end, d))
                n.append(np.full(end, size))
                matches.append(np.full(end, m))
            if not doc:
                continue
            doc, token, n, matches = (np.concatenate(x) for x in (doc, token, n, matches))
            bucket = (mix(token) % np.uint64(parts)).astype(np.int64)
            order = np.lexsort((token, bucket))
            edge = np.searchsorted(bucket[order], np.arange(parts + 1))
            for b in range(parts):
                i = order[edge[b] : edge[b + 1]]
                if len(i):
                    cells[b] = [pack(token[i], TOKEN), doc[i].astype("<i8").tobytes(), n[i].astype("<i4").tobytes(), matches[i].astype("u1").tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array(list(cells), pa.int32()), *(pa.array([c[k] for c in cells.values()], pa.binary()) for k in range(4))], ["bucket", "tokens", "docs", "n", "matches"])

    return run


def _candidates(batches):
    """Pairs (a < b) from lists of a token, with the matches they need and whether they are sure."""
    held: list[list] = [[], [], [], []]
    for batch in batches:
        for k, kind in enumerate((None, "<i8", "<i4", "u1")):
            held[k] += [unpack(x, TOKEN) if kind is None else np.frombuffer(x, dtype=kind) for x in batch.column(k + 1).to_pylist()]
    if not held[0]:
        return
    token, doc, n, matches = (np.concatenate(x) for x in held)
    held.clear()
    order = np.lexsort((doc, token))
    token, doc, n, matches = token[order], doc[order], n[order].astype(np.int64), matches[order].astype(np.int64)
    new = np.ones(len(token), dtype=bool)
    new[1:] = token[1:] != token[:-1]
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, len(token)))
    group = np.cumsum(new) - 1
    place = np.arange(len(token)) - head[group]
    found = []
    for step in range(1, STAR):
        i = np.flatnonzero((size[group] <= STAR) & (place + step < size[group]))
        a, b = i, i + step
        fits = 100 * np.minimum(n[a], n[b]) >= PERCENT * np.maximum(n[a], n[b])
        found.append((doc[a[fits]], doc[b[fits]], np.minimum(matches[a], matches[b])[fits], np.zeros(int(fits.sum()), bool)))
    i = np.flatnonzero((size[group] > STAR) & (place > 0))
    found.append((doc[head[group[i]]], doc[i], np.ones(len(i), np.int64), np.ones(len(i), bool)))
    a, b, need, sure = (np.concatenate(x) for x in zip(*found, strict=True))
    # Pairs of one bucket are summed here, so that a group's stars send each pair once.
    order = np.lexsort((b, a))
    a, b, need, sure = a[order], b[order], need[order], sure[order]
    new = np.ones(len(a), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    head = np.flatnonzero(new)
    if len(head):
        met = np.diff(np.append(head, len(a)))
        any_sure = np.logical_or.reduceat(sure, head)
        for i in range(0, len(head), 100_000):
            j = head[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(a[j]), pa.array(b[j]), pa.array(met[i : i + 100_000], pa.int64()), pa.array(need[j], pa.int64()), pa.array(any_sure[i : i + 100_000])], ["a", "b", "met", "need", "sure"])


def components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """node and component (smallest node reachable) of an edge list, by alternating stars.

    Large stars hang every larger neighbour of a node on its smallest one, small stars every
    smaller one; each round halves paths. Rounds are written to the shared folder, and so are each
    round's least neighbours: joined from there, the edges of a node with very many of them can be
    split over tasks by adaptive execution. It ends when every node hangs on one other that hangs on
    none: as each is larger than what it hangs on, that is the least of its component.
    """
    tree = scratch.store(edges.select(F.greatest(a, b).alias("node"), F.least(a, b).alias("to")).filter("node > to").distinct(), "edges")
    while True:
        both = tree.unionByName(tree.select(F.col("to").alias("node"), F.col("node").alias("to")))
        least = both.groupBy("node").agg(F.min("to").alias("m")).select("node", F.least("node", "m").alias("m"))
        least = scratch.store(least, "least")
        large = both.filter("to > node").join(least, "node").select(F.col("to").alias("node"), F.col("m").alias("to")).distinct()
        small_least = large.groupBy("node").agg(F.min("to").alias("m"))
        small = large.join(small_least, "node").select(F.when(F.col("to") != F.col("m"), F.col("to")).otherwise(F.col("node")).alias("node"), F.col("m").alias("to"))
        tree = scratch.store(small.filter("node > to").distinct(), "edges")
        ends = tree.select("node", F.lit(1).alias("hangs")).unionByName(tree.select(F.col("to").alias("node"), F.lit(0).alias("hangs")).distinct())
        ends = ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.count("*").alias("n"))
        if ends.filter("hangs > 0 and n > 1").isEmpty():
            return tree.select("node", F.col("to").alias("component")).unionByName(tree.select(F.col("to").alias("node"), F.col("to").alias("component")).distinct())


def _verify(part: pa.Table) -> pa.Table:
    """The components of one group of candidates, by whole sets."""
    ids = part.column("doc_id").to_numpy()
    order = np.argsort(ids)
    ids = ids[order]
    raws = part.column("tokens").to_pylist()
    sets = [unpack(raws[i], TOKEN) for i in order]
    size = np.array([len(s) for s in sets])
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    first = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(ids)), size)
    component = np.full(len(ids), -1, dtype=np.int64)
    mark = np.zeros(int(token.max()) + 1, dtype=bool)
    left_token, left_owner = token, owner
    for seed in range(len(ids)):
        if component[seed] >= 0:
            continue
        component[seed] = ids[seed]
        queue = [seed]
        while queue:
            x = queue.pop()
            open_ = component[left_owner] < 0
            if not open_.all():
                left_token, left_owner = left_token[open_], left_owner[open_]
            if not len(left_owner):
                break
            mine = token[first[x] : first[x] + size[x]]
            mark[mine] = True
            common = np.bincount(left_owner[mark[left_token]], minlength=len(ids))
            mark[mine] = False
            linked = np.flatnonzero((100 * common >= PERCENT * (size + size[x] - common)) & (component < 0))
            component[linked] = ids[seed]
            queue += linked.tolist()
    return pa.table({"node": pa.array(ids), "component": pa.array(component)})


def _meet(both: pa.Table) -> pa.Table:
    """Labels (a < b) that links of seeds with a chunk's documents join."""
    out: list[np.ndarray] = [np.zeros((0, 2), np.int64)]
    is_seed = both.column("seed").combine_chunks()
    part, seeds = both.filter(pa.compute.invert(is_seed)), both.filter(is_seed)
    if part.num_rows and seeds.num_rows:
        sets, theirs = ([unpack(x, TOKEN) for x in t.column("tokens").to_pylist()] for t in (part, seeds))
        label, of_seed = (t.column("label").to_numpy().copy() for t in (part, seeds))
        size = np.array([len(x) for x in sets])
        known, token = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), size)
        mark = np.zeros(len(known) + 1, dtype=bool)
        for k, mine in enumerate(theirs):
            if (label == of_seed[k]).all():
                continue
            at = np.searchsorted(known, mine)
            at = at[known[np.minimum(at, len(known) - 1)] == mine]
            mark[at] = True
            common = np.bincount(owner[mark[token]], minlength=len(sets))
            mark[at] = False
            linked = (100 * common >= PERCENT * (size + len(mine) - common)) & (label != of_seed[k])
            if linked.any():
                joined, new = np.unique(label[linked]), of_seed[k]
                out.append(np.stack([np.minimum(joined, new), np.maximum(joined, new)], axis=1))
                label[np.isin(label, joined)] = new
                of_seed[np.isin(of_seed, joined)] = new
    a, b = np.concatenate(out).T
    return pa.table({"a": pa.array(a), "b": pa.array(b)})


def _verify_large(large: DataFrame, held: int, scratch: Scratch) -> DataFrame:
    """node and component of groups that no task can hold. large: doc_id, tokens, group.

    Each round takes seeds from the documents outside the group's largest component, compares them
    with all that aren't done yet and have another label, and is done with them. A group ends when
    those left have one label; since a round may take MORE_SEEDS times more seeds than the last one,
    rounds are few.
    """
    state = scratch.store(large.select("doc_id", "group", F.col("doc_id").alias("label"), F.lit(True).alias("open")), "labels")
    tokens = large.select("doc_id", "tokens")
    seeds = SEEDS
    while True:
        open_ = state.filter("open")
        labels = open_.groupBy("group", "label").agg(F.count("*").alias("n"))
        groups = labels.groupBy("group").agg(F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("most"), F.count("*").alias("labels")).filter("labels > 1")
        groups = scratch.store(groups.select("group", "n", F.col("most.label").alias("main"), (F.col("n") - F.col("most.n")).alias("rest")), "groups")
        if groups.isEmpty():
            return state.select(F.col("doc_id").alias("node"), F.col("label").alias("component"))
        chance = F.pmod(F.xxhash64("doc_id", F.lit(seeds)), F.lit(1 << 30)) / F.lit(float(1 << 30))
        round_ = open_.join(groups, "group").withColumn("seed", (F.col("label") != F.col("main")) & (chance * F.col("rest") < seeds))
        round_ = scratch.store(round_.join(tokens.hint("shuffle_hash"), "doc_id"), "round")
        cut = lambda c, w: F.greatest(F.ceil(F.sum(w) / held), F.ceil(F.sum(F.when(c, F.length("tokens")).otherwise(0)) / HELD_BYTES), F.lit(1)).cast("int")
        chunks = round_.groupBy("group").agg(cut(F.lit(True), F.lit(1)).alias("parts"), cut(F.col("seed"), F.col("seed").cast("int")).alias("seed_parts"))
        chunks = scratch.store(chunks, "chunks")
        dealt = round_.join(chunks, "group")
        place = lambda n, salt: F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        docs = dealt.select("group", place("parts", "part").alias("i"), every("seed_parts").alias("j"), F.lit(False).alias("seed"), "label", "tokens")
        chosen = dealt.filter("seed").select("group", every("parts").alias("i"), place("seed_parts", "seed").alias("j"), "seed", "label", "tokens")
        links = docs.unionByName(chosen).groupBy("group", "i", "j").applyInArrow(_meet, "a long, b long")
        joined = components(links, scratch).select(F.col("node").alias("label"), "component")
        done = round_.filter("seed").select("doc_id", F.lit(True).alias("done"))
        state = state.join(done, "doc_id", "left").join(joined, "label", "left")
        state = scratch.store(state.select("doc_id", "group", F.coalesce("component", "label").alias("label"), (F.col("open") & F.col("done").isNull()).alias("open")), "labels")
        seeds *= MORE_SEEDS


def by_size(linked: DataFrame, held: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Rows of the groups that one task can hold, and those of larger ones."""
    sizes = linked.groupBy("group").agg(F.count("*").alias("n"), F.sum(F.length("tokens")).alias("bytes"))
    large = scratch.store(sizes.filter((F.col("n") > held) | (F.col("bytes") > HELD_BYTES)).select("group"), "large")
    return linked.join(large, "group", "left_anti"), linked.join(large, "group", "left_semi")


def keyed(documents: DataFrame) -> DataFrame:
    """documents with `row_key`, a number of each row's own; written once, so that it stays."""
    return materialize(documents.withColumn("row_key", F.monotonically_increasing_id()), "rows")


def groups_of(rows: DataFrame, held: int = HELD) -> DataFrame:
    """Per row of keyed documents: row_key, doc_id, n_shingles, class_id (smallest id of an equal
    set), component_id (smallest id reachable by links) and first_key (the row of that id).

    Ids only order the rows: a null one is the smallest, of equal ones the first row_key counts.
    """
    scratch = Scratch(rows.sparkSession)
    docs = rows.select(F.col("row_key").alias("doc_id"), "text")
    own = rows.select(F.col("row_key").alias("doc_id"), F.col("doc_id").cast("long").alias("id"), "text")
    sets = materialize(own.mapInArrow(_set_rows, "doc_id long, id long, n long, s1 long, s2 long"), "sets")
    tokens = sets.agg(F.sum("n")).first()[0] or 0
    parts = max(shuffle_parts(rows.sparkSession), tokens * 8 // PART_BYTES)
    first = lambda c="first": F.min(c).alias("first")
    classes = sets.filter("n > 0").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("head"), first(F.struct("id", "doc_id")))
    classes = scratch.store(classes, "classes")
    heads = classes.select(F.col("head").alias("doc_id"), "n")
    entries = docs.mapInArrow(_emit(parts, 4, True), ENTRIES).repartitionById(parts, "bucket")
    counts = entries.mapInArrow(_count_shared(parts), "bucket int, docs binary, a binary").repartitionById(parts, "bucket")
    shared = counts.mapInArrow(_sum_shared, "doc_id long, shared long")
    go_on = scratch.store(shared.join(heads, "doc_id").filter(100 * F.col("shared") >= PERCENT * F.col("n")).select("doc_id"), "heads")
    some = docs.join(go_on.hint("shuffle_hash"), "doc_id").select("doc_id", "text")
    reply = some.mapInArrow(_emit(parts, TOKEN, False), ENTRIES).repartitionById(parts, "bucket").mapInArrow(_reply(parts), "bucket int, docs binary, a binary, b binary")
    ordered = scratch.store(reply.repartitionById(parts, "bucket").mapInArrow(_sets, "doc_id long, n int, matches int, tokens binary"), "ordered")
    lists = ordered.mapInArrow(_emit_prefixes(parts), "bucket int, tokens binary, docs binary, n binary, matches binary").repartitionById(parts, "bucket")
    pairs = lists.mapInArrow(_candidates, "a long, b long, met long, need long, sure boolean")
    pairs = pairs.groupBy("a", "b").agg(F.sum("met").alias("met"), F.max("need").alias("need"), F.max("sure").alias("sure")).filter("sure or met >= need")
    groups = components(pairs.select("a", "b"), scratch)
    linked = scratch.store(ordered.join(groups, F.col("doc_id") == F.col("node")).select("doc_id", "tokens", F.col("component").alias("group")), "linked")
    small, large = by_size(linked, held, scratch)
    verified = small.groupBy("group").applyInArrow(_verify, "node long, component long").unionByName(_verify_large(large, held, scratch))
    of_class = classes.join(verified, F.col("head") == F.col("node"), "left").select("n", "s1", "s2", F.col("first").alias("class_first"), F.coalesce("component", "head").alias("component"))
    of_class = materialize(of_class, "of_class")
    scratch.drop()
    of_class = of_class.join(of_class.groupBy("component").agg(first("class_first")), "component")
    out = sets.join(of_class.drop("component"), ["n", "s1", "s2"], "left")
    id_of = lambda c: F.when(F.col(c).isNull(), F.col("id")).otherwise(F.col(f"{c}.id"))
    return out.select(F.col("doc_id").alias("row_key"), F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), id_of("class_first").alias("class_id"), id_of("first").alias("component_id"), F.coalesce("first.doc_id", "doc_id").alias("first_key"))


def near_duplicates(documents: DataFrame, held: int = HELD) -> DataFrame:
    """Per document: doc_id, n_shingles, class_id (smallest id of an equal set) and component_id
    (smallest id reachable by links).

    Null, empty and wordless texts have no shingles and link with nothing; texts of fewer than five
    words have their whole sequence as one shingle. Every row is a document of its own, whether its
    id is repeated or null; a null id counts as the smallest. An empty table gives no rows.
    """
    return groups_of(keyed(documents.select("doc_id", "text")), held).select("doc_id", "n_shingles", "class_id", "component_id")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
