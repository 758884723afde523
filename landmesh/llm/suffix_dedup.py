"""Suffix-array dedup: bytes covered by a 100-byte string that also starts earlier.

Candidate contexts come from `anchors`. Each shard sorts the suffixes at its windows' starts, up to
100 bytes deep, by deep-shallow sorting: multikey quicksort with 8-byte symbols orders them to a
shallow depth, all open groups at once; the groups that still share that prefix are ordered by
blind tries, whose nodes keep only where suffixes branch, so that each suffix is compared with one
leaf; groups too large for a trie go on by multikey quicksort. A trie of one leaf, of suffixes that
are all equal, needs no insertions: such groups are found all at once, by comparing each suffix
with the one of its group before it in the text, whole runs of neighbours together. Suffixes equal
to the full depth stand together, and all but the first of them, by document and place, start
earlier elsewhere; the contexts are put in that order first, so that a place in the text tells it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from landmesh.llm.anchors import HINT, HOT, HOT_LEAST, NULL_ID, WINDOWS_OF, Spec, _starts, covered, numbered, with_windows
from landmesh.llm.common import table, text_runs

LENGTH = 100
SHALLOW = 24
#: Suffixes of a group that one blind trie orders.
TRIE = 200
SYMBOL = 8
#: Bytes of runs that are compared at once.
BLOCK = 2 << 20


_number = int.from_bytes


class BlindTrie:
    """Suffixes of some bytes up to a depth, all equal up to `depth`; equal ones share a leaf."""

    def __init__(self, data: bytes, depth: int, limit: int):
        self.data, self.depth, self.limit = data, depth, limit
        self.root: list | None = None  # a leaf: [limit, [suffixes]], a node: [place, {byte: child}]

    def insert(self, suffix: int) -> None:
        data, depth, limit, node = self.data, self.depth, self.limit, self.root
        if node is None:
            self.root = [limit, [suffix]]
            return
        # Blindly down to some leaf: bytes between the branching places are not looked at.
        while node[0] < limit:
            branches = node[1]
            node = branches.get(data[suffix + node[0]]) or next(iter(branches.values()))
        other = node[1][0]
        a, b = data[suffix + depth : suffix + limit], data[other + depth : other + limit]
        if a == b:
            node[1].append(suffix)
            return
        same = limit - ((_number(a, "big") ^ _number(b, "big")).bit_length() + 7) // 8  # length of the common prefix
        # Again from the root to where the suffix leaves the path of that leaf.
        parent, node = None, self.root
        while node[0] < same:
            parent, node = node, node[1][data[other + node[0]]]
        leaf = [limit, [suffix]]
        if node[0] == same:
            node[1][data[suffix + same]] = leaf
            return
        branch = [same, {data[other + same]: node, data[suffix + same]: leaf}]
        if parent is None:
            self.root = branch
        else:
            parent[1][data[other + parent[0]]] = branch

    def groups(self) -> list[list[int]]:
        """The suffixes in order, equal ones together."""
        limit, stack, out = self.limit, [self.root], []
        while stack:
            place, inner = stack.pop()
            if place == limit:
                out.append(inner)
            else:
                stack += [inner[b] for b in sorted(inner, reverse=True)]
        return out


def _mixed(key: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """Which suffixes, in groups that begin at `lead`, are of a group whose keys differ."""
    head = np.flatnonzero(lead)
    group = np.cumsum(lead) - 1
    some = np.zeros(len(head), dtype=bool)
    some[group[key != key[head][group]]] = True
    return some[group]


def _alike(raw: np.ndarray, suffix: np.ndarray, lead: np.ndarray, depth: int, limit: int) -> np.ndarray:
    """Which suffixes, in groups that begin at `lead` and are equal up to a depth, are of a group
    that is equal up to the limit.

    Each is compared with the one of its group before it in the text. Where neighbours in the text
    are compared with neighbours, each byte of the run is looked at once for all of them.
    """
    long = limit - depth
    if long <= 0 or not len(suffix):
        return np.ones(len(suffix), dtype=bool)
    group = np.cumsum(lead) - 1
    suffix = np.sort(group << 32 | suffix) & 0xFFFFFFFF
    at = np.flatnonzero(~lead)
    at = np.sort(suffix[at] << 32 | at) & 0xFFFFFFFF
    place = suffix[at]
    back = place - suffix[at - 1]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (place[1:] != place[:-1] + 1) | (back[1:] != back[:-1])
    run = np.flatnonzero(new)
    count = np.diff(run, append=len(at))
    end = np.cumsum(count + long - 1)
    differ = np.zeros(len(at), dtype=bool)
    i = 0
    while i < len(run):
        j = max(i + 1, int(np.searchsorted(end, (end[i - 1] if i else 0) + BLOCK, side="right")))
        n = count[i:j]
        size = n + long - 1
        begin = np.cumsum(size) - size
        take = np.repeat(place[run[i:j]] + depth - begin, size) + np.arange(size.sum())
        wrong = np.zeros(len(take) + 1, dtype=np.int32)
        np.cumsum(raw[take] != raw[take - np.repeat(back[run[i:j]], size)], out=wrong[1:])
        mine = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
        differ[run[i] : run[i] + len(mine)] = wrong[mine + long] != wrong[mine]
        i = j
    some = np.ones(group[-1] + 1, dtype=bool)
    some[group[at[differ]]] = False
    return some[group]


def sort_suffixes(raw: np.ndarray, starts: np.ndarray, limit: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order of their first `limit` bytes, and for each whether a new group of equal
    ones begins there. Every suffix has `limit` bytes; there are less than 2**31 bytes."""
    padded = np.concatenate([raw, np.zeros(SYMBOL, np.uint8)])
    # The symbol at each byte, as a view whose items overlap.
    symbol = np.ndarray(len(raw), dtype=">u8", buffer=padded, strides=(1,))
    order = starts.copy()
    new = np.zeros(len(order), dtype=bool)
    new[:1] = True
    data = None
    open_ = np.arange(len(order)) if len(order) > 1 else np.zeros(0, int)  # places of suffixes not yet ordered to the full depth
    depth = 0
    while depth < limit and len(open_):
        suffix, lead = order[open_], new[open_]
        here = min(depth, limit - SYMBOL)  # the last symbol reaches back, to stay within the limit
        key = symbol[suffix + here].astype(np.uint64)
        mixed = _mixed(key, lead)
        if depth >= SHALLOW:
            alike = ~mixed
            alike[alike] = _alike(raw, suffix[alike], lead[alike], here + SYMBOL, limit)
            head = np.flatnonzero(lead)
            size = np.diff(head, append=len(lead))
            small = ~alike[head] & (size <= TRIE)
            if small.any():
                data = data or raw.tobytes()
                some = np.repeat(small, size)
                todo, sorted_, heads, a = suffix[some].tolist(), [], [], 0
                for m in size[small].tolist():
                    trie = BlindTrie(data, depth, limit)
                    for s in todo[a : a + m]:
                        trie.insert(s)
                    a += m
                    for equal in trie.groups():
                        heads.append(len(sorted_))
                        sorted_ += equal
                some = open_[some]
                order[some] = sorted_
                new[some[heads]] = True
            stay = ~alike & np.repeat(size > TRIE, size)
            open_, suffix, lead, key, mixed = (x[stay] for x in (open_, suffix, lead, key, mixed))
        depth = here + SYMBOL
        some = open_[mixed]
        suffix, lead, key = suffix[mixed], lead[mixed], key[mixed]
        by = np.argsort(key)
        if lead.sum() > 1:  # back to their groups, each in order of the symbol
            group = np.cumsum(lead) - 1
            by = by[np.sort(group[by] << 32 | np.arange(len(by))) & 0xFFFFFFFF]
        order[some] = suffix[by]
        key = key[by]
        new[some[1:]] |= key[1:] != key[:-1]
        lead = new[open_]
        open_ = open_[~(lead & np.append(lead[1:], True))]
    return order, new


def earlier_windows(spec: Spec, doc: np.ndarray, row: np.ndarray, at: np.ndarray, n: np.ndarray, raw: np.ndarray):
    """Windows of the contexts whose bytes start in an earlier place of the contexts."""
    size = n + spec.window - 1
    end = np.cumsum(size)
    # Contexts by document, row and place: then of equal suffixes the first one is the earliest.
    by = np.lexsort((at, row, doc))
    raw = np.concatenate([raw[:0], *(raw[a:b] for a, b in zip((end - size)[by].tolist(), end[by].tolist(), strict=True))])
    doc, row, at, n, size = doc[by], row[by], at[by], n[by], size[by]
    begin = np.cumsum(size) - size
    starts = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
    order, new = sort_suffixes(raw, starts, spec.window)
    # Only suffixes that have equals can start elsewhere too.
    some = ~(new & np.append(new[1:], True)) if len(new) else new
    new = new[some]
    group = np.cumsum(new) - 1
    order = np.sort(group << 32 | order[some]) & 0xFFFFFFFF
    of = np.repeat(np.arange(len(n), dtype=np.int32), size)[order]
    place = order + (at - begin)[of]
    number = np.cumsum(_starts(doc))[of]
    later = number > number[np.flatnonzero(new)][group]
    if spec.within:
        number = np.cumsum(_starts(doc, row))[of]
        run = new | _starts(number)
        later |= place > place[np.flatnonzero(run)][np.cumsum(run) - 1]
    later = np.sort(order[later])  # in order of the text, which is easily joined
    of = np.searchsorted(begin, later, side="right") - 1
    return by[of], later - begin[of] + at[of]


def removal(documents: DataFrame, length: int = LENGTH, gram: int = 32, hot: int = HOT, share: float = HINT, least: int = HOT_LEAST) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans (runs of removed bytes) and kept, binary.

    A byte is removed if a string of `length` bytes covers it that also starts earlier: in a
    document of smaller id, or in the same one before; strings never cross documents, may overlap
    and are judged on the input. Null text is empty; shorter texts lose nothing. Each row is a
    document: of rows of equal id none is earlier than another. A null id is less than all others.
    An empty table gives no rows; other columns are not looked at.
    """
    spec = Spec(length, gram, words=False, within=True, hot=hot)

    def run(batches):
        for batch, data, offsets in text_runs(batches):
            n_removed, n_spans, kept = [], [], []
            for i, w in enumerate(batch.column(batch.schema.get_field_index(WINDOWS_OF)).to_pylist()):
                text = data[offsets[i] : offsets[i + 1]]
                if w:
                    gone = covered(spec, w, len(text))
                    n_removed.append(int(gone.sum()))
                    n_spans.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                    text = text[~gone]
                else:
                    n_removed.append(0)
                    n_spans.append(0)
                kept.append(text.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets), pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    schema = StructType([*(StructField(k, LongType()) for k in ("doc_id", "n_bytes", "n_removed", "n_spans")), StructField("kept", BinaryType())])
    out = with_windows(numbered(documents), spec, earlier_windows, share, least).mapInArrow(run, schema)
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = removal(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
