"""N-gram Jaccard self-join by prefix trees, and the near-duplicate classes it gives.

Each document is the set of its hashed word n-grams in one global order: by
hash, the frequent ones after all others. Two sets that meet a threshold t share
one of the first ``n - ceil(t n) + 1`` members of each (of the smaller, one of
the first ``n - ceil(2 t n / (1 + t)) + 1``), so the tries are partitioned by
those members: sets that hold one of them among their first meet in its group.
Within a block of a group the sets are stored as paths of one trie in the global
order; every set walks it, sets with a common start share the overlap counted on
it, and a subtree is left as soon as the lengths that remain cannot reach the
threshold or all its sets are known to be in the walker's class.

Most groups hold few sets that meet by chance. So sets whose partners in a block
are all ruled out by sizes and parity bitmaps (two sets differ in at least as
many members as their bitmaps differ in bits) go without their texts being read.
The others are joined by their leaders first: the sets of one leader, wherever
they met it, are a block of texts. Blocks of three and more that this leaves in
several classes are joined whole. A group larger than a block is dealt to random
blocks; if it is still in several classes, the sets outside its largest class
meet all others. Equal sets are one node, so links that matter to the classes
are all found, though not all pairs are expanded. The rows shuffled are linear
in the sets for groups of up to BLOCK sets; for a larger group they are its size
times the blocks of members outside its largest class, which frequent n-grams
coming last keeps small: sets that reach them in their prefix have few others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from millrace.llm.components import connected_components
from millrace.llm.scratch import dropped, shuffles_removed, tasks_for, written
from millrace.llm.substring_dedup import pack, unpack
from millrace.llm.textnum import release_memory, shingle_sets

#: Members that so many sets have among their first by hash are ordered last, whatever the number of documents; members counted at once, and documents for each range of hashes in which counts are summed.
COUNT_FLOOR, COUNT_RUN, RANGE_DOCS = 32, 1 << 20, 2048
#: Such ranges for each task, at least.
TASK_RANGES = 8
#: So many of them at most, the most frequent. Any choice gives the same links; it bounds what is sent to the tasks.
FREQUENT = 50_000
#: Sets in a block, on average.
BLOCK = 192
#: Bits of a set's parity bitmap; sets beyond WIDE_FROM members, which would fill it, have a wide one as well. Bitmaps of unlike sets
#: differ in half of the bits at most, those of partners at 0.8 in a ninth of both sizes: from 2,300 members on, 1024 bits rule out nothing.
BITS, WIDE_BITS, WIDE_FROM = 1024, 1 << 13, 1500
#: Pairs of bitmaps compared at once.
PAIRS = 1 << 16
#: Rows of ids that may be sent to all tasks; beyond that both sides are shuffled.
SENT_IDS = 1_000_000
#: Documents for each task of a step, at least.
TASK_DOCS = 1_000


class Order:
    """The global order of members: by hash, the frequent ones (a list by rising frequency) after all others."""

    def __init__(self, frequent: np.ndarray):
        self.rank = np.argsort(frequent, kind="stable")
        self.known = frequent[self.rank]

    def late(self, s: np.ndarray) -> np.ndarray:
        """-1, or the place among the frequent members."""
        if not len(self.known):
            return np.full(len(s), -1)
        at = np.searchsorted(self.known, s)
        at[at == len(self.known)] = 0
        return np.where(self.known[at] == s, self.rank[at], -1)

    def prefix(self, s: np.ndarray, num: int, den: int) -> np.ndarray:
        """The first members of a sorted set, of which it shares one with every set that meets the threshold."""
        size = prefix_length(len(s), num, den)
        for most in (2 * size, len(s)):
            late = self.late(s[:most])
            rare = s[:most][late < 0]
            if len(rare) >= size:
                return rare[:size]
        often = s[late >= 0]
        return np.concatenate([rare, often[np.argsort(late[late >= 0], kind="stable")][: size - len(rare)]])


def prefix_length(n: int, num: int, den: int) -> int:
    """How many of the first members of a set of n must be looked up to miss no partner."""
    return n - -(-num * n // den) + 1 if n else 0


class _Node:
    __slots__ = ("edge", "depth", "fewest", "most", "end", "last", "children", "one")

    def __init__(self, edge: np.ndarray, depth: int, fewest: int, most: int, end: int, last: int):
        self.edge, self.depth, self.fewest, self.most = edge, depth, fewest, most
        self.end, self.last = end, last  # path that ends here or -1; one beyond the last path below
        self.children: list[_Node] = []
        self.one = -1  # a path below, once all of them are in one class


class PrefixTree:
    """Distinct sets as paths of a path-compressed trie in the global order."""

    def __init__(self, sets: Sequence[np.ndarray], order: Order | None = None):
        members, inverse = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_inverse=True)
        late = (order or Order(members[:0])).late(members)
        rank = np.empty(len(members), np.int64)
        rank[np.lexsort((members, late))] = np.arange(len(members))
        ends = np.cumsum([len(s) for s in sets])
        paths = [np.sort(p) for p in np.split(rank[inverse], ends[:-1])] if len(sets) else []
        #: Positions of the sets in the order of their paths.
        self.order = sorted(range(len(paths)), key=lambda i: paths[i].astype(">u4").tobytes())
        self.paths, self.size = [paths[i] for i in self.order], len(members)
        self.root = self._build() if paths else None

    def _build(self) -> _Node:
        top: list[_Node] = []
        todo = [(0, len(self.paths), 0, top)]
        lengths = np.array([len(p) for p in self.paths])
        while todo:
            lo, hi, depth, into = todo.pop()
            a, b = self.paths[lo], self.paths[hi - 1]
            m = min(len(a), len(b))
            differ = np.flatnonzero(a[depth:m] != b[depth:m])
            end = depth + int(differ[0]) if len(differ) else m
            here = len(a) == end
            node = _Node(a[depth:end], end, int(lengths[lo:hi].min()), int(lengths[lo:hi].max()), lo if here else -1, hi)
            into.append(node)
            first = lo + here
            while first < hi:
                token, last = self.paths[first][end], first + 1
                while last < hi and self.paths[last][end] == token:
                    last += 1
                todo.append((first, last, end, node.children))
                first = last
        return top[0]

    def links(self, num: int, den: int, labels: Sequence[int] | None = None) -> Iterator[tuple[int, int, int]]:
        """(position, position, overlap) of pairs of Jaccard similarity num / den at least that join all such pairs' classes.

        Sets of equal ``labels`` are in one class from the start. Every set
        walks the paths after its own; a pair already in one class is passed by.
        """
        parent = list(range(len(self.paths)))

        def find(i: int) -> int:
            while parent[i] != i:
                parent[i] = i = parent[parent[i]]
            return i

        firsts: dict[int, int] = {}
        for k, i in enumerate(self.order) if labels is not None else ():
            parent[find(k)] = find(firsts.setdefault(labels[i], k))
        for k, path in enumerate(self.paths):
            n = len(path)
            if not n:
                continue
            mine = np.zeros(self.size, bool)
            mine[path] = True
            todo = [(self.root, 0)]
            while todo:
                node, overlap = todo.pop()
                if node.last <= k + 1 or den * min(n, node.most) < num * max(n, node.fewest):
                    continue
                if node.one < 0:
                    below = [c.one for c in node.children] + [node.end] * (node.end >= 0)
                    if min(below) >= 0 and len({find(i) for i in below}) == 1:
                        node.one = below[0]
                if node.one >= 0 and find(node.one) == find(k):
                    continue
                overlap += int(np.count_nonzero(mine[node.edge]))
                if (num + den) * (overlap + min(n - overlap, node.most - node.depth)) < num * (n + node.fewest):
                    continue
                if node.end > k and (num + den) * overlap >= num * (n + node.depth) and find(node.end) != find(k):
                    parent[find(node.end)] = find(k)
                    yield self.order[k], self.order[node.end], overlap
                todo.extend((child, overlap) for child in node.children)


def parity(s: np.ndarray, bits: int) -> np.ndarray:
    """Bitmap of the set: for each value of the hashes' last bits, whether an odd number of members have it."""
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _set_id(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def _frequent(docs: DataFrame, n: int, num: int, den: int) -> np.ndarray:
    """The members ordered last, by rising frequency: a bounded list of those that COUNT_FLOOR sets and more have among their first.

    These are the first by hash, twice as many as a prefix has, since members
    ordered last make room for others. All are counted, as one that is rare in
    every part of the corpus can still be in many sets. They travel as packed
    arrays, each from a run to a range of turned hashes (the first are low).
    """
    bits = max(1, (docs.count() // RANGE_DOCS).bit_length())
    half = np.uint64(32)
    starts = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        run, held = [], 0

        def packed() -> pa.RecordBatch:
            h = np.concatenate(run)
            h, c = np.unique(h << half | h >> half, return_counts=True)
            cuts = [*np.searchsorted(h, starts).tolist(), len(h)]
            rows = [(r, 0, 0, pack(h[a:b]), c[a:b].astype("<u4").tobytes()) for r, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if a < b]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), [pa.int64()] * 3 + [pa.binary()] * 2)], ["g", "p", "q", "members", "counts"])

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                for s in shingle_sets(batch.column(0).slice(at, 1024).to_pylist(), n):
                    if len(s) and (key := _set_id(s)) not in seen:
                        seen.add(key)
                        run.append(s[: 2 * prefix_length(len(s), num, den)].copy())
                        held += len(run[-1])
                        if held >= COUNT_RUN:
                            yield packed()
                            seen, run, held = set(), [], 0
        if run:
            yield packed()
        release_memory()

    def often(table: pa.Table, starts: np.ndarray) -> pa.Table:
        out = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
        members, counts = table.column("members").to_pylist(), table.column("counts").to_pylist()
        for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist()):
            h, at = np.unique(np.concatenate([unpack(x) for x in members[lo:hi]]), return_inverse=True)
            c = np.bincount(at, np.frombuffer(b"".join(counts[lo:hi]), "<u4")).astype(np.int64)
            out.append((h[c >= COUNT_FLOOR], c[c >= COUNT_FLOOR]))
        h, c = map(np.concatenate, zip(*out))
        return pa.table({"h": (h << half | h >> half).view(np.int64), "c": c})

    arrays = docs.select("text").mapInArrow(count, "g long, p long, q long, members binary, counts binary")
    counts = _whole_blocks(arrays, often, "h long, c long", tasks_for(docs.sparkSession, 1 << bits, TASK_RANGES))
    top = counts.orderBy(F.desc("c"), "h").limit(FREQUENT).toPandas()
    return top["h"].to_numpy(np.int64).view(np.uint64)[::-1].copy()


def _nodes(docs: DataFrame, n: int, num: int, den: int, frequent: np.ndarray) -> DataFrame:
    """(doc_id, text_key, set_id, n_shingles, bits, wide, keys): parity bits and the members of the prefix, once for equal sets of one run."""
    order = Order(frequent)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        longs = pa.list_(pa.int64())
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                rows = []
                for s in shingle_sets(part.column(2).to_pylist(), n):
                    key = _set_id(s) if len(s) else None
                    if key is None or key in seen:
                        rows.append((key, len(s), None, None, None))
                        continue
                    if len(seen) > 1 << 18:
                        seen.clear()
                    seen.add(key)
                    wide = parity(s, WIDE_BITS) if len(s) > WIDE_FROM else None
                    rows.append((key, len(s), parity(s, BITS), wide, order.prefix(s, num, den).view(np.int64)))
                columns = [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), longs, longs, longs))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], ["doc_id", "text_key", "set_id", "n_shingles", "bits", "wide", "keys"])
        release_memory()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_key(), "text")
    return rows.mapInArrow(prefixes, "doc_id long, text_key long, set_id long, n_shingles long, bits array<long>, wide array<long>, keys array<long>")


def _text_key() -> Column:
    """What tells a row's text from others of the same, or no, doc_id."""
    return F.xxhash64("text").alias("text_key")


def _sent(rows: DataFrame) -> DataFrame:
    """A written table of ids, to be broadcast if it is small enough."""
    return F.broadcast(rows) if rows.count() <= SENT_IDS else rows


def _fetched(wanted: DataFrame, one_of: DataFrame, docs: DataFrame, tasks: int) -> DataFrame:
    """(set_id, text) of the sets in ``wanted(set_id)``, each once; rows without a doc_id are found by their texts."""
    wanted = written(wanted.distinct().join(one_of.select("set_id", F.col("doc_id").alias("id"), F.col("text_key").alias("k")), "set_id"), "wanted", tasks)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _text_key())
    sent = _sent(wanted)
    found = written(texts.join(sent, (F.col("text_key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("id"))).select("set_id", "text"), "sets")
    return found if found.count() == wanted.count() else written(found.dropDuplicates(["set_id"]), "sets", tasks)


def _whole_blocks(rows: DataFrame, work: Callable[[pa.Table, np.ndarray], pa.Table], schema: str, tasks: int) -> DataFrame:
    """``rows(g, p, q, ...)`` -> what ``work`` makes of tables of whole blocks (g, p, q) and the first row of each, with the number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
            keys = np.stack([table.column(c).to_numpy() for c in "gpq"])
            starts = np.concatenate(([0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, [table.num_rows]))
            yield from work(table, starts).combine_chunks().to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in "gpq"])
            change = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            if held and any(held[-1].column(c)[-1].as_py() != batch.column(c)[0].as_py() for c in "gpq"):
                change = np.concatenate(([0], change))
            if len(change):
                yield from done(pa.Table.from_batches([*held, batch.slice(0, int(change[-1]))]))
                held = []
            held.append(batch.slice(int(change[-1]) if len(change) else 0))
        if held:
            yield from done(pa.Table.from_batches(held))
        release_memory()

    return rows.repartition("g", "p", "q").coalesce(tasks).sortWithinPartitions("g", "p", "q").mapInArrow(run, schema)


def _plausible(blocks: DataFrame, signatures: DataFrame, num: int, den: int, tasks: int) -> DataFrame:
    """The rows of ``blocks(g, p, q, set_id, label)`` that have a partner of another label in their block which sizes and bitmaps do not rule out."""

    def pick(table: pa.Table, starts: np.ndarray) -> pa.Table:
        label, n = table.column("label").to_numpy(), table.column("n_shingles").to_numpy()
        bits = table.column("bits").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, BITS // 64)
        wide = table.column("wide").to_pylist()
        ends = np.repeat(starts[1:], np.diff(starts))
        counts = ends - np.arange(len(n)) - 1
        keep = np.zeros(len(n), bool)
        cuts = np.searchsorted(np.cumsum(counts), np.arange(0, counts.sum() + PAIRS, PAIRS), "right")
        for lo, hi in zip(cuts[:-1].tolist(), [*cuts[1:-1].tolist(), len(n)]):
            c = counts[lo:hi]
            left = np.repeat(np.arange(lo, hi), c)
            right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(c) - c, c)
            both = n[left] + n[right]
            most = both + 2 * (-num * both // (num + den))
            ok = (label[left] != label[right]) & (den * np.minimum(n[left], n[right]) >= num * np.maximum(n[left], n[right]))
            left, right, most = left[ok], right[ok], most[ok]
            ok = np.bitwise_count(bits[left] ^ bits[right]).sum(axis=1, dtype=np.int64) <= most
            for k in np.flatnonzero(ok & (np.minimum(n[left], n[right]) > WIDE_FROM)).tolist():
                x, y = (np.array(wide[i], np.int64) for i in (left[k], right[k]))
                ok[k] = int(np.bitwise_count((x ^ y).view(np.uint64)).sum(dtype=np.int64)) <= most[k]
            keep[left[ok]] = keep[right[ok]] = True
        return table.select(["g", "p", "q", "set_id", "label"]).filter(pa.array(keep))

    rows = blocks.join(signatures, "set_id").select("g", "p", "q", "set_id", "label", "n_shingles", "bits", "wide")
    return _whole_blocks(rows, pick, "g long, p long, q long, set_id long, label long", tasks)


def _joined(blocks: DataFrame, sets: DataFrame, frequent: np.ndarray, n: int, num: int, den: int, tasks: int) -> DataFrame:
    """``blocks(g, p, q, set_id, label)`` -> links ``(a, b, overlap)`` that join all similar sets of each block (g, p, q)."""
    order = Order(frequent)

    def walk(table: pa.Table, starts: np.ndarray) -> pa.Table:
        ids, labels = table.column("set_id").to_pylist(), table.column("label").to_pylist()
        out: list[tuple[int, int, int]] = []
        for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist()):
            found: dict[int, np.ndarray] = {}
            for k, s in zip(ids[lo:hi], shingle_sets(table.column("text").slice(lo, hi - lo).to_pylist(), n)):
                if k not in found and len(s) and _set_id(s) == k:
                    found[k] = s
            own, classes = list(found), dict(zip(ids[lo:hi], labels[lo:hi]))
            hits = PrefixTree(list(found.values()), order).links(num, den, [classes[k] for k in own])
            out += [(own[i], own[j], overlap) for i, j, overlap in hits]
        columns = zip(*out) if out else [()] * 3
        return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(("a", "b", "overlap"), columns)})

    rows = blocks.join(sets, "set_id").select("g", "p", "q", "set_id", "label", "text")
    return written(_whole_blocks(rows, walk, "a long, b long, overlap long", tasks), "links")


def _part(of: Column, salt: int, n_blocks: Column) -> Column:
    return F.pmod(F.xxhash64(of, F.lit(salt)), n_blocks)


def _members(nodes: DataFrame, num: int, den: int) -> DataFrame:
    """(h, set_id) of the sets that share a member of their prefixes with another set, a shorter one within its first part.

    Most members are held by one set only. Rows are shuffled once, and counted
    and chosen where they then are, so the way is the same at every size.
    """
    first = f"n_shingles - (2 * {num} * n_shingles + {num + den - 1}) div {num + den} + 1"
    keys = nodes.where("keys is not null").select("set_id", "n_shingles", F.expr(first).alias("first"), F.posexplode("keys").alias("at", "h"))
    keys = keys.select("h", "set_id", F.col("n_shingles").cast("int").alias("n"), F.expr("at < first").alias("leads")).repartition("h")
    live = keys.groupBy("h").agg(F.min(F.when(F.col("leads"), F.col("n"))).alias("least"), F.min("set_id").alias("lo"), F.max("set_id").alias("hi")).where("lo < hi and least is not null").select("h", "least")
    return keys.join(live.hint("merge"), "h").where("leads or n >= least").select("h", "set_id")


def similarity_classes(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, n_shingles, component_id)``, one row for each row.

    A document's set holds the distinct n-word shingles of its whole text (A-Z
    as a-z); a shorter text is one shingle. Two documents are linked when
    ``den * intersection >= num * union``; ``component_id`` is the smallest
    doc_id reachable by links. Texts without words and nulls have an empty set,
    are linked with nothing and keep their own doc_id. Rows without a doc_id
    link like others; a null is never the smallest unless the class has no
    other. An empty table gives no rows. Other columns are ignored.
    """
    with shuffles_removed(docs.sparkSession):
        nodes, one_of, joined = _joined_sets(docs, n, num, den)
    roots = one_of.join(joined, "set_id", "left").select("set_id", F.coalesce("component", "set_id").alias("root"), "doc_id")
    least = roots.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    classes = roots.join(least, "root").select("set_id", "component_id")
    return nodes.select("doc_id", "set_id", "n_shingles").join(classes, "set_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _joined_sets(docs: DataFrame, n: int, num: int, den: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The nodes; (set_id, doc_id, text_key) of one row of each set; (set_id, component) of the sets with links."""
    frequent = _frequent(docs, n, num, den)
    nodes = written(_nodes(docs, n, num, den, frequent), "nodes")
    tasks = tasks_for(docs.sparkSession, nodes.count(), TASK_DOCS)
    one_of = nodes.where("set_id is not null").groupBy("set_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("r")).select("set_id", "r.doc_id", "r.text_key")

    members = written(_members(nodes, num, den), "members", tasks)
    sums = [F.sum(F.pmod(F.xxhash64("set_id", F.lit(salt)), F.lit(1 << 32))).alias(f"s{salt}") for salt in range(3)]  # copies of a set count alike in all groups
    groups = members.groupBy("h").agg(F.count("*").alias("rows"), F.min("set_id").alias("lo"), F.max("set_id").alias("hi"), *sums).where("lo < hi")
    groups = written(groups.groupBy("rows", "s0", "s1", "s2").agg(F.min("h").alias("h"), F.first("rows").alias("size")).select("h", "size"), "groups", tasks)
    every = written(members.join(_sent(groups), "h").distinct(), "members", tasks)
    dropped(members, groups)

    # sets with a partner in their block that sizes and bitmaps do not rule out
    signatures = nodes.where("bits is not null").select("set_id", "n_shingles", "bits", "wide")
    signatures = written(signatures.join(every.select("set_id").distinct(), "set_id", "left_semi").dropDuplicates(["set_id"]), "signatures", tasks)
    parts = F.ceil(F.col("size") / BLOCK)
    none = F.lit(-1).cast("long")
    blocks = every.select(F.col("h").alias("g"), _part(F.col("set_id"), 2, parts).alias("p"), none.alias("q"), "set_id", F.col("set_id").alias("label"))
    kept = written(_plausible(blocks, signatures, num, den, tasks), "blocks")

    # each against the leader of its block, the pairs of one leader in blocks of texts
    leaders = kept.groupBy("g", "p").agg(F.min("set_id").alias("a"))
    stars = written(kept.join(leaders, ["g", "p"]).where("set_id <> a").select("a", F.col("set_id").alias("b")).distinct(), "pairs", tasks)
    sets = _fetched(stars.select(F.explode(F.array("a", "b")).alias("set_id")), one_of, docs, tasks)
    sizes = stars.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    star = stars.join(sizes, "a").select(F.col("a").alias("g"), _part(F.col("b"), 1, F.col("blocks")).alias("p"), none.alias("q"), F.col("b").alias("set_id"))
    star = star.unionByName(sizes.select(F.col("a").alias("g"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("p"), none.alias("q"), F.col("a").alias("set_id")))
    links = _joined(star.withColumn("label", F.col("set_id")), sets, frequent, n, num, den, tasks)
    joined = connected_components(links.select("a", "b")).withColumnRenamed("node", "set_id")

    def labelled(rows: DataFrame) -> DataFrame:
        """Rows with the classes of their sets as labels."""
        return written(rows.join(_sent(joined), "set_id", "left").withColumn("label", F.coalesce("component", "set_id")).drop("component"), "labelled", tasks)

    def more(blocks: DataFrame) -> None:
        nonlocal links, sets, joined
        blocks = written(_plausible(blocks, signatures, num, den, tasks), "blocks")
        unread = blocks.select("set_id").distinct().join(_sent(sets.select("set_id")), "set_id", "left_anti")
        if unread.limit(1).count():
            sets = sets.unionByName(_fetched(unread, one_of, docs, tasks))
        new = _joined(blocks, sets, frequent, n, num, den, tasks)
        if new.limit(1).count():
            links = links.unionByName(new)
            joined = connected_components(links.select("a", "b")).withColumnRenamed("node", "set_id")

    # blocks of three and more in several classes (the one pair of a block of two has been compared)
    rows = labelled(kept.drop("label"))
    several = rows.groupBy("g", "p").agg(F.count("*").alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("n > 2 and lo < hi").select("g", "p")
    more(rows.join(_sent(written(several, "several", tasks)), ["g", "p"]).select("g", "p", "q", "set_id", "label"))

    # groups beyond a block: the sets outside the largest class against all
    large = every.where(F.col("size") > BLOCK)
    if large.limit(1).count():
        rows = labelled(large)
        per = rows.groupBy("h", "label").agg(F.count("*").alias("n")).groupBy("h").agg(F.sum("n").alias("size"), F.max("n").alias("most"), F.max_by("label", "n").alias("top"))
        per = written(per.where("most < size").select("h", F.ceil(F.col("size") / BLOCK).alias("parts"), F.ceil((F.col("size") - F.col("most")) / BLOCK).alias("slices"), "top"), "groups", tasks)
        rows = rows.drop("size").join(_sent(per), "h")
        zero = F.lit(0).cast("long")
        whole = rows.select(F.col("h").alias("g"), _part(F.col("set_id"), 3, F.col("parts")).alias("p"), F.explode(F.sequence(zero, F.col("slices") - 1)).alias("q"), "set_id", "label")
        few = rows.where("label <> top").select(F.col("h").alias("g"), F.explode(F.sequence(zero, F.col("parts") - 1)).alias("p"), _part(F.col("set_id"), 4, F.col("slices")).alias("q"), "set_id", "label")
        more(whole.unionByName(few))

    return nodes, one_of, joined


def one_of_each(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` without near-duplicates: of each class the row with the smallest doc_id stays, other columns unchanged, whatever their names.

    Rows that repeat a doc_id count as copies when their sets are equal or
    linked; one of them stays. Rows with a null doc_id stay.
    """
    classes = similarity_classes(docs, n, num, den).where("doc_id is not null")
    with shuffles_removed(docs.sparkSession):
        ids = written(classes.groupBy("doc_id").agg((F.min("component_id") == F.col("doc_id")).alias("stays"), F.count("*").alias("rows")), "classes")

    def of(condition: str, how: str) -> DataFrame:
        found = _sent(ids.where(condition).select(F.col("doc_id").alias("id")))
        return docs.join(found, docs["doc_id"] == found["id"], how)

    return of("not stays or rows > 1", "left_anti").union(of("stays and rows > 1", "left_semi").dropDuplicates(["doc_id"]))
