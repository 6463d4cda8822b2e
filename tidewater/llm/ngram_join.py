"""Jaccard join on word shingles by T-occurrence search.

1. Every document becomes the set of hashes of its five-word shingles. Tasks send sorted stretches of hashes, packed,
   to the range they fall in; a range counts in how many documents each hash occurs and sends the shared ones back.
   A hash that several documents of one stretch hold goes there once, with their number, so a hash that is everywhere
   costs a range one entry a stretch; which documents hold it stays with the stretch. A document links only if three
   quarters of its hashes are shared, so most documents end here, and for the others the shared hashes are all that an
   overlap can hold.
2. Equal sets are one class, with its smallest doc_id in front.
3. Hashes are ordered from rare to common. Two sets that link share a hash among the first quarter of each (and one
   more), so classes that share such a hash lie in one cluster.
4. In a cluster, DivideSkip finds each set's partners: the set needs T common hashes; its L longest inverted lists are
   laid aside, the short ones are merged through a heap, and what occurs T - L times there is probed for in the long ones
   by binary search. Partners that are already connected need no second link.
5. Clusters larger than a task's block are searched block by block: first every block with a pivot block, then the sets
   that are not yet connected to the cluster's main component with every block. No pair is left out but those whose two
   sets are connected already.
6. Components of the links, by min-label rounds, give the classes' components.

Edge cases: a document with fewer words than a shingle is one shingle of all its words; null and empty texts have no
set, link with nothing and are their own component; repeated rows are one class; a row with null doc_id links like
any other, and its component is null if no row in it has an id; extra columns are ignored. Shingles are named by 56-bit
hashes: two of n different ones share a name with a chance of n / 2^56, far below what could move a similarity.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Powers, components, cut, grams, hash_ranges, mix, pack, parts_of, sized, slices, spread, squeeze, unpack, word_hashes


SHINGLE = 5
BITS = 56
#: Similarity as a ratio of whole numbers, so that the test is exact.
UP, DOWN = 75, 100
FLUSH = 1_500_000
SENT = [("who", "<u4"), ("n", "<u4")]
SHARED = [("h", "<u8"), ("who", "<u4"), ("df", "<u8")]
#: In place of a document: several of the stretch hold the hash.
SEVERAL = 0xFFFFFFFF


def shingles(w: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text, from the hashes of its words."""
    if not len(w):
        return w
    h = grams(w, SHINGLE) if len(w) >= SHINGLE else mix(grams(w, len(w)) + np.uint64(len(w)))
    h = np.sort(h >> np.uint64(64 - BITS))
    return h[starts_of(h)]


def starts_of(h: np.ndarray) -> np.ndarray:
    """Where another value begins in sorted values."""
    first = np.ones(len(h), bool)
    np.not_equal(h[1:], h[:-1], out=first[1:])
    return first


def links(n, m, overlap):
    """Whether sets of n and m link, of whole numbers or arrays of them."""
    return DOWN * overlap >= UP * (n + m - overlap)


def least_overlap(n):
    """Overlap that a set of n needs with any set."""
    return -(-UP * n // DOWN)


ROWS = pa.schema([("range", pa.int32()), ("flush", pa.int64()), ("blob", pa.binary())])


def packed_sets(docs: DataFrame, ranges: int) -> DataFrame:
    """(range, flush, blob): the hashes of a task's documents by range; and, with a negative range, the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, task, number = Powers(), TaskContext.get().partitionId(), 0
        ids, keys, sets, size = [], [], [], 0
        for b in slices(batches):
            for d, k, w in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), word_hashes(b.column(1), powers, 1 << 16, lower=True)):
                ids.append(d)
                keys.append(k)
                sets.append(shingles(w))
                size += len(sets[-1])
                if size > FLUSH:
                    yield from sent(ids, keys, sets, task << 24 | number)
                    ids, keys, sets, size, number = [], [], [], 0, number + 1
        if ids:
            yield from sent(ids, keys, sets, task << 24 | number)

    def sent(ids: list, keys: list, sets: list[np.ndarray], flush: int) -> Iterator[pa.RecordBatch]:
        digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
        n = np.array([len(s) for s in sets], np.int64)
        frame = pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "key": pa.array(keys, pa.int64()), "n": pa.array(n), "digest": pa.array(digests, pa.binary(16))})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, frame.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_batch(frame)
        seen: set[bytes] = set()
        first = [not (g in seen or seen.add(g)) for g in digests]  # equal sets send their hashes once
        h = np.concatenate([s for s, f in zip(sets, first) if f] or [np.empty(0, np.uint64)])
        who = np.repeat(np.flatnonzero(first), n[first]).astype(np.uint32)
        o = np.argsort(h, kind="stable")
        h, who = h[o], who[o]
        start = np.flatnonzero(starts_of(h))
        count = np.diff(np.append(start, len(h)))
        several = np.repeat(count > 1, count)
        rows = [(-1 - flush % ranges, flush, sized(sink.getvalue().to_pybytes(), pack(h[several]), squeeze(who[several])))]
        table = np.empty(len(start), SENT)
        table["who"], table["n"] = np.where(count > 1, SEVERAL, who[start]), count
        h = h[start]
        step = (1 << BITS) // ranges + 1
        edge = np.searchsorted(h, np.arange(ranges + 1, dtype=np.uint64) * np.uint64(step))
        for r in np.flatnonzero(np.diff(edge)):
            part = slice(edge[r], edge[r + 1])
            rows.append((int(r), flush, sized(pack(h[part]), squeeze(table[part]))))
        for i in range(0, len(rows), 256):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[i : i + 256]), ROWS)], schema=ROWS)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), key_of(F.col("text"))).mapInArrow(run, "range int, flush long, blob binary")


def key_of(text: Column) -> Column:
    """Names a row's text beside its doc_id, which other rows may share."""
    return F.xxhash64(text.cast("string")).alias("key")


def shared_hashes(sets: DataFrame) -> DataFrame:
    """(flush, kind, blob): each flush's hashes that several documents hold, with their number; and its documents."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        if p.range.iloc[0] < 0:
            return pd.DataFrame({"flush": p.flush, "kind": 0, "blob": p.blob})
        both = [parts_of(b) for b in p.blob]
        hs = [unpack(x) for x, _ in both]
        flush = np.repeat(np.arange(len(hs)), [len(h) for h in hs])
        h, sent = np.concatenate(hs), np.concatenate([spread(x, SENT) for _, x in both])
        o = np.argsort(h, kind="stable")
        h, who, flush = h[o], sent["who"][o], flush[o]
        start = np.flatnonzero(starts_of(h))
        df = np.repeat(np.add.reduceat(sent["n"][o].astype(np.int64), start), np.diff(np.append(start, len(h))))
        keep = np.flatnonzero(df > 1)
        keep = keep[np.argsort(flush[keep], kind="stable")]
        edge = np.searchsorted(flush[keep], np.arange(len(hs) + 1))
        out = []
        for i in range(len(hs)):
            k = keep[edge[i] : edge[i + 1]]
            if len(k):
                table = np.empty(len(k), SHARED)
                table["h"], table["who"], table["df"] = h[k], who[k], df[k]
                out.append((p.flush.iloc[i], 1, squeeze(table)))
        return pd.DataFrame(out, columns=["flush", "kind", "blob"])

    return sets.groupBy("range").applyInPandas(run, "flush long, kind int, blob binary")


def documents_of(shared: DataFrame) -> DataFrame:
    """doc_id, key, n, digest of every document, and hashes (a packed array, rare first) of those that may link."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        head, several, holders = parts_of(p.blob[p.kind == 0].iloc[0])
        head = pa.ipc.open_stream(head).read_all()
        n = head.column("n").to_numpy()
        tables = [spread(b, SHARED) for b in p.blob[p.kind == 1]]
        hashes = [None] * len(n)
        if tables:
            # a range's table is in order, so is one after the other
            t = np.concatenate(sorted(tables, key=lambda x: x["h"][0]))
            one = t["who"] != SEVERAL
            found = t[~one]
            own = np.empty(len(several := unpack(several)), SHARED)
            own["h"], own["who"] = several, spread(holders, "<u4")
            own["df"] = found["df"][np.searchsorted(found["h"], several)]
            t = np.concatenate([t[one], own])
            live = (np.bincount(t["who"], minlength=len(n)) >= least_overlap(n)) & (n > 0)
            t = t[live[t["who"]]]
            t = t[np.argsort(t["h"], kind="stable")]
            t = t[np.argsort(t["who"].astype(np.uint64) << np.uint64(40) | t["df"], kind="stable")]
            edge = np.searchsorted(t["who"], np.arange(len(n) + 1))
            for i in np.flatnonzero(live):
                hashes[i] = t["h"][edge[i] : edge[i + 1]].tobytes()
        ids = head.column("doc_id").to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)
        return pd.DataFrame({"doc_id": ids, "key": head.column("key").to_numpy(), "n": n, "digest": head.column("digest").to_pylist(), "hashes": hashes})

    return shared.groupBy("flush").applyInPandas(run, "doc_id long, key long, n long, digest binary, hashes binary")


def merge_short(lists: list[np.ndarray], least: int) -> list[int]:
    """Members of at least `least` of the sorted lists, by a heap over the lists' heads."""
    return [d for d, g in groupby(heapq.merge(*[x.tolist() for x in lists])) if sum(1 for _ in g) >= least]


#: Places that are looked up at a time.
PROBES = 1_000_000


class Index:
    """Inverted lists of sets: hash -> sorted positions. Of lists that hold an eighth of the sets or more, every set has a bit."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = len(sets)
        size = np.array([len(s) for s in sets], np.int64)
        h = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        o = np.argsort(h, kind="stable")
        h = h[o]
        start = np.flatnonzero(starts_of(h))
        self.hashes, self.start = h[start], np.append(start, len(h))
        self.members = np.repeat(np.arange(self.n), size)[o]
        self.length = np.diff(self.start)
        #: number of the list and position in one, in order: what probes look for
        self.places = np.repeat(np.arange(len(start)) * self.n, self.length) + self.members
        long = self.length * 8 >= self.n
        self.bit = np.where(long, np.cumsum(long) - 1, -1)
        here = np.repeat(long, self.length)
        flags = np.zeros((self.n, -(-int(long.sum()) // 64) * 64), np.uint8)
        flags[self.members[here], np.repeat(self.bit, self.length)[here]] = 1
        self.bits = np.packbits(flags, axis=1).view(np.uint64)

    def lists(self, s: np.ndarray) -> np.ndarray:
        """Numbers of the lists of s, short ones first."""
        if not len(self.hashes):
            return np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, s), len(self.hashes) - 1)
        at = at[self.hashes[at] == s]
        return at[np.argsort(self.length[at], kind="stable")]

    def candidates(self, s: np.ndarray, least: int, mu: float = 0.01, heap: int = 4096) -> tuple[np.ndarray, np.ndarray]:
        """DivideSkip: positions found often enough in the short lists to share `least` hashes with s; and all lists.

        Short lists of more than `heap` entries in all are counted in an array instead of through the heap.
        """
        lists = self.lists(s)
        if len(lists) < least:
            return np.empty(0, np.int64), lists
        aside = min(least - 1, int(least / (mu * np.log2(max(self.length[lists[-1]], 2)) + 1)))
        short = lists[: len(lists) - aside]
        length = self.length[short]
        if length.sum() <= heap:
            return np.array(merge_short([self.members[self.start[i] : self.start[i + 1]] for i in short], least - aside), np.int64), lists
        return np.flatnonzero(self.counted(short) >= least - aside), lists

    def counted(self, lists: np.ndarray) -> np.ndarray:
        """How many of the lists hold each position, from all their entries."""
        length = self.length[lists]
        entries = self.members[np.repeat(self.start[lists] - (np.cumsum(length) - length), length) + np.arange(length.sum())]
        return np.bincount(entries, minlength=self.n)

    def probe(self, lists: np.ndarray, found: np.ndarray) -> np.ndarray:
        """How many of the lists hold each position: by bits; of shorter lists by binary search, or all entries if they are few."""
        bit = self.bit[lists]
        own = np.zeros(self.bits.shape[1] * 64, np.uint8)
        own[bit[bit >= 0]] = 1
        count = np.bitwise_count(self.bits[found] & np.packbits(own).view(np.uint64)).sum(1, dtype=np.int64)
        lists = lists[bit < 0]
        if not len(lists):
            return count
        if self.length[lists].sum() <= 8 * len(lists) * len(found):
            return count + self.counted(lists)[found]
        places = (lists[:, None] * self.n + found).ravel()
        there = self.places[np.minimum(np.searchsorted(self.places, places), len(self.places) - 1)] == places
        return count + there.reshape(len(lists), len(found)).sum(0)


def connect(i: int, own: int, found: np.ndarray, index: Index, lists: np.ndarray, n: np.ndarray, n_own: int, labels: np.ndarray, out: list, batch: int = 32) -> int:
    """Link set i (label `own`) with one candidate at least of every component that holds a partner; its new label.

    Candidates are probed in batches that grow, one of each component first; those of a component just linked need no probe.
    """
    while True:
        found = found[labels[found] != own]
        if not len(found):
            return own
        _, lead = np.unique(labels[found], return_index=True)
        lead = np.unique(np.concatenate([lead[:batch], np.arange(max(0, min(batch - len(lead), len(found))))]))
        some = found[lead]
        count = index.probe(lists, some)
        for j in some[links(n_own, n[some], count)].tolist():
            if labels[j] != own:
                out.append((i, j))
                low, high = min(own, labels[j]), max(own, labels[j])
                labels[labels == high] = low
                own = int(low)
        found = np.delete(found, lead)
        batch = max(batch, min(4 * batch, PROBES // len(lists)))


def links_within(ids: np.ndarray, n: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that connect what similarity connects among the sets of one group."""
    o = np.lexsort((ids, n))
    ids, n, sets = ids[o], n[o], [sets[i] for i in o]
    index, labels, out = Index(sets), np.arange(len(ids)), []
    for i in range(1, len(ids)):
        found, lists = index.candidates(sets[i], least_overlap(int(n[i])))
        connect(i, i, found[(found < i) & (n[found] * DOWN >= UP * n[i])], index, lists, n, int(n[i]), labels, out)
    return [(int(ids[i]), int(ids[j])) for i, j in out]


def links_between(ids: np.ndarray, n: np.ndarray, sets: list[np.ndarray], labels: np.ndarray, asks: np.ndarray) -> list[tuple[int, int]]:
    """Links of the asking sets with the others; sets of one label are connected already."""
    base = np.flatnonzero(~asks)
    index, out = Index([sets[i] for i in base]), []
    _, labels = np.unique(labels, return_inverse=True)
    there = labels[base]
    for i in np.flatnonzero(asks):
        got: list[tuple[int, int]] = []
        found, lists = index.candidates(sets[i], least_overlap(int(n[i])))
        own, old = int(labels[i]), there.copy()
        connect(i, own, found, index, lists, n[base], int(n[i]), there, got)
        for was in np.unique(old[old != there]) if got else ():  # the asking sets' labels follow
            labels[labels == was] = there[old == was][0]
        if got:
            low = min(own, *(int(there[j]) for _, j in got))
            labels[labels == own] = low
            there[there == own] = low
        out += [(int(ids[i]), int(ids[base[j]])) for _, j in got]
    return out


EDGES = "a long, b long"
#: Hashes of small clusters that one group searches, and those that a block's sets have on average at most.
TOGETHER, EACH = 262_144, 1024


def in_blocks(block: int) -> Column:
    """How many blocks a group of sets makes: of `block` sets, fewer where sets are large."""
    return F.greatest(F.ceil(F.count("*") / F.lit(block)), F.ceil(F.sum("weight") / F.lit(block * EACH))).cast("int")


def as_sets(p: pd.DataFrame) -> list[np.ndarray]:
    return [np.frombuffer(b, "<u8") for b in p.hashes]


def as_edges(found: list[tuple[int, int]]) -> pd.DataFrame:
    return pd.DataFrame(np.array(found, np.int64).reshape(-1, 2), columns=["a", "b"])


def cluster_labels(members: DataFrame, block: int) -> DataFrame:
    """(node, component) of the (cluster, rep, n, hashes) rows that similarity connects with others."""
    rows = members.withColumn("weight", F.octet_length("hashes") / 8)
    sizes = rows.groupBy("cluster").agg(in_blocks(block).alias("blocks"))
    rows = cut(rows.join(sizes, "cluster"), "clusters")
    is_big = F.col("blocks") > 1
    weight, any_big = rows.agg(F.sum(F.when(~is_big, F.col("weight"))), F.max(is_big)).first()

    def within(p: pd.DataFrame) -> pd.DataFrame:
        p = p.drop_duplicates("rep").sort_values("cluster", kind="stable")
        ids, n, sets, found = p.rep.to_numpy(), p.n.to_numpy(), as_sets(p), []
        edge = np.append(np.flatnonzero(starts_of(p.cluster.to_numpy())), len(p))
        for low, high in zip(edge[:-1], edge[1:]):
            found += links_within(ids[low:high], n[low:high], sets[low:high])
        return as_edges(found)

    big = rows.where(is_big).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    # every block with the pivot block; small clusters go to a group with others
    to = F.when(F.col("block") == 0, F.sequence(F.lit(1), F.col("blocks") - 1)).otherwise(F.array("block"))
    several = F.lit(max(1, -(-int(weight or 0) // TOGETHER))).cast("long")
    columns = ["number", "to", "cluster", "rep", "n", "hashes"]
    dealt = rows.where(~is_big).withColumn("number", F.pmod(F.xxhash64("cluster"), several)).withColumn("to", F.lit(0)).select(columns)
    dealt = dealt.union(big.withColumn("number", F.col("cluster")).withColumn("to", F.explode(to)).select(columns))
    label = components(dealt.groupBy("number", "to").applyInPandas(within, EDGES), thin=False)
    if not any_big:
        return label
    known = cut(big.join(label.select(F.col("node").alias("rep"), F.col("component").alias("label")), "rep", "left").withColumn("label", F.coalesce("label", "rep")), "labelled")
    main = known.groupBy("cluster", "label").agg(F.count("*").alias("k")).groupBy("cluster").agg(F.max_by("label", F.struct("k", "label")).alias("main"))
    known = known.join(main, "cluster").select("cluster", "rep", "n", "hashes", "weight", "blocks", "block", "label", "main")
    rest = cut(known.where(F.col("label") != F.col("main")), "rest")
    # what is not in the main component meets every block, in parts of a block's size
    parts = rest.groupBy("cluster").agg(in_blocks(block).alias("parts"))
    asking = rest.join(parts, "cluster").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    asking = asking.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("asks", F.lit(True))
    asked = known.join(parts, "cluster").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("asks", F.lit(False))
    cols = ["cluster", "block", "part", "n", "hashes", "label", "asks"]

    def between(p: pd.DataFrame) -> pd.DataFrame:
        """Links between labels."""
        label = p.label.to_numpy()
        return as_edges(links_between(label, p.n.to_numpy(), as_sets(p), label, p.asks.to_numpy(bool))).drop_duplicates()

    joined = components(asking.select(cols).union(asked.select(cols)).groupBy("cluster", "block", "part").applyInPandas(between, EDGES), thin=False)
    later = joined.select(F.col("node").alias("component"), F.col("component").alias("root"))
    # sets without a link before are their own label
    return label.join(later, "component", "left").select("node", F.coalesce("root", "component").alias("component")).union(joined).groupBy("node").agg(F.min("component").alias("component"))


def groups(docs: DataFrame, block: int = 1024) -> DataFrame:
    """doc_id, key, n, component, name for every row of docs with shingles, and nulls as component and name for the others.

    key names the row's text; component is one number for all rows of a component, name its smallest doc_id.
    """
    found = cut(documents_of(shared_hashes(packed_sets(docs, hash_ranges(docs)))), "sets")
    by_digest = found.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("name"), F.max("n").alias("n"), F.first("hashes", True).alias("hashes"))
    number = F.xxhash64("digest")
    classes = cut(by_digest.withColumn("rep", F.coalesce("name", number)), "classes")
    # a class without ids, or of an id that another class has too, goes by a number of its own
    twice = classes.groupBy("rep").agg(F.count("*").alias("k")).where("k > 1")
    plain = True
    if twice.limit(1).count():
        classes = cut(classes.join(twice, "rep", "left").withColumn("rep", F.when(F.col("k").isNull(), F.col("rep")).otherwise(number)).drop("k"), "classes")
        plain = False
    plain = plain and not classes.where("name is null").limit(1).count()
    live = classes.where("hashes is not null").select("rep", "n", "hashes")

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("h", pa.int64()), ("rep", pa.int64())])
        for b in batches:
            reps, n = b.column(0).to_numpy(), b.column(1).to_numpy()
            hs, rs = [], []
            for r, k, s in zip(reps, n, b.column(2)):
                s = np.frombuffer(s.as_buffer(), "<u8")
                # hashes of this document alone come first in the order; they find no partner
                hs.append(s[: k - least_overlap(int(k)) + 1 - (k - len(s))])
                rs.append(np.full(len(hs[-1]), r))
            if hs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hs).view(np.int64)), pa.array(np.concatenate(rs))], schema=out)

    keys = cut(live.mapInArrow(prefixes, "h long, rep long"), "prefixes")
    meet = keys.groupBy("h").agg(F.min("rep").alias("b"), F.count("*").alias("k")).where("k > 1")
    clusters = components(keys.join(meet, "h").select(F.col("rep").alias("a"), "b"))
    members = live.join(clusters.select(F.col("node").alias("rep"), F.col("component").alias("cluster")), "rep")
    label = cluster_labels(members, block).select(F.col("node").alias("rep"), "component")
    named = classes.select("digest", "rep", "name").join(label, "rep", "left").select("digest", "name", F.coalesce("component", "rep").alias("component"))
    if plain:
        named = named.select("digest", "component", F.col("component").alias("name"))
    else:
        named = named.select("digest", "component").join(named.groupBy("component").agg(F.min("name").alias("name")), "component").select("digest", "component", "name")
    rows = found.select("doc_id", "key", "n", "digest")
    linked = rows.where("n > 0").join(named, "digest").select("doc_id", "key", "n", "component", "name")
    nothing = F.lit(None).cast("long")
    return linked.union(rows.where("n = 0").select("doc_id", "key", "n", nothing, nothing))


def near_duplicates(docs: DataFrame, block: int = 1024) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs."""
    return groups(docs, block).select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("name")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs, with their columns, of which one of each component stays: the one with the smallest doc_id.

    Rows without an id come after those with one; of rows that share an id, and of rows without any, the smallest key
    stays, and one of equal rows. Rows without shingles all stay.
    """
    names = docs.columns
    found = cut(groups(docs).where("n > 0").select("doc_id", "key", "component"), "groups")
    first = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "key")).alias("first"))
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("key") == F.col("first.key"))
    placed = found.join(first, "component").select("doc_id", "key", stays.alias("stays"))
    # rows of one id and key have one text, so they are in one component
    states = cut(placed.groupBy("doc_id", "key").agg(F.max("stays").alias("stays"), F.count("*").alias("rows")).where("not stays or rows > 1"), "states")
    rows = docs.select(F.struct(*names).alias("row"), F.col("doc_id").cast("long").alias("id"), key_of(F.col("text")))

    def by_row(table: DataFrame, how: str) -> DataFrame:
        return rows.join(table, rows.id.eqNullSafe(table.doc_id) & (rows.key == table.key), how)

    gone, repeated = states.where("not stays"), states.where("stays")
    if not repeated.limit(1).count():
        return by_row(gone, "left_anti").select("row.*")
    once = by_row(repeated, "left_semi").dropDuplicates(["id", "key"])
    return by_row(states, "left_anti").union(once).select("row.*")


def op6_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP6_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 3), lambda i : array_to_string(w[i:i + 4], ' ')) END) AS g FROM t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT o.a, o.b FROM o JOIN n x ON x.doc_id = o.a JOIN n y ON y.doc_id = o.b WHERE 100 * k >= 75 * (x.n + y.n - k)),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM t UNION SELECT reach.doc_id, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.r),
c AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT t.doc_id, coalesce(n.n, 0)::bigint AS n_shingles, c.component_id FROM t LEFT JOIN n USING (doc_id) JOIN c ON c.doc_id = t.doc_id
"""
