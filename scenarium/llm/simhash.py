"""SimHash near-duplicates: a byte-position inverted index with count filtering."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scenarium.llm.buckets import expand, squeeze
from scenarium.llm.textarrays import LOWER_BYTES, Words, mix, raw_bytes, shingles_of, slices, words_of
from scenarium.operators.graph import connected_components
from scenarium.plans.materialize import materialize

#: Of the 8 positional bytes of two fingerprints that differ in at most 2 bits, at least 6 are equal.
MAX_BITS = 2
LEAST_SHARED = 8 - MAX_BITS


def _hashes(text: str | None, k: int, seed: int) -> list[int]:
    words = (text or "").encode().translate(LOWER_BYTES).split()
    if len(words) <= k:
        return [xxhash.xxh64_intdigest(b" ".join(words), seed)] if words else []
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[: len(words) - k] + 1))
    pieces = [whole[a:b] for a, b in zip(starts.tolist(), ends[k - 1 :].tolist(), strict=True)]
    return list(map(xxhash.xxh64_intdigest, pieces, repeat(seed)))


def fingerprints(docs: DataFrame, k: int = 3, seed: int = 42) -> DataFrame:
    """``(doc_id, fp)``: the 64-bit SimHash of every whole text; zero for a null text or one without words.

    A text of fewer than ``k`` words has one shingle, its whole word sequence.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            each = [_hashes(t, k, seed) for t in batch.column("text").to_pylist()]
            count = np.fromiter(map(len, each), np.int64, len(each))
            out = np.zeros(len(each), np.uint64)
            has = np.flatnonzero(count)
            if len(has):
                h = np.fromiter((x for own in each for x in own), np.uint64, int(count.sum()))
                bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                begin = (np.cumsum(count) - count)[has]
                ones = np.add.reduceat(bits, begin, axis=0, dtype=np.int64)
                major = np.packbits(2 * ones > count[has][:, None], axis=1, bitorder="little")
                out[has] = np.ascontiguousarray(major).view(np.uint64)[:, 0]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def _masks() -> list[tuple[int, int]]:
    out = []
    for n, kept in enumerate(combinations(range(8), LEAST_SHARED)):
        mask = sum(0xFF << (8 * i) for i in kept)
        out.append((n, mask - (1 << 64) if mask >> 63 else mask))
    return out


def forest(values: np.ndarray) -> list[tuple[int, int]]:
    """Links between distinct 64-bit values that agree but for two bytes: a spanning forest of distance <= 2.

    Up to 256 values are compared with each other. More of them (at most 65,536 can differ in two bytes)
    meet at the values one bit away, which two values share exactly if they differ in at most two bits.
    """
    n = len(values)
    if n <= 256:
        a, b = np.nonzero(np.triu(np.bitwise_count(values[:, None] ^ values) <= MAX_BITS, 1))
    else:
        live = np.bitwise_or.reduce(values ^ values[0])
        flips = [np.uint64(0), *(np.uint64(1 << i) for i in range(64) if int(live) >> i & 1)]
        near = np.concatenate([values ^ f for f in flips])
        who = np.tile(np.arange(n), len(flips))
        order = np.argsort(near, kind="stable")
        same = near[order][1:] == near[order][:-1]
        a, b = who[order][:-1][same], who[order][1:][same]
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((x, y))
    return out


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """``(src, dst)`` fingerprints at distance 1 or 2, enough of them to connect what is connected.

    Every distinct fingerprint is posted under each choice of 6 of its 8 positional bytes, so two of them
    meet in a posting exactly if their tally of shared positional bytes reaches the guaranteed 6. A posting
    holds at most 65,536 values; it is verified bit by bit and gives a spanning forest, never all pairs.
    """
    keys = F.array(*(F.struct(F.lit(n).cast("tinyint").alias("n"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for n, m in _masks()))
    spread = distinct.repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")  # a small table that becomes 28 times as large
    postings = spread.select("fp", F.explode(keys).alias("k")).groupBy("k.n", "k.key").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            src, dst = [], []
            for own in batch.column("fps"):
                values = np.sort(own.values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
                for x, y in forest(values):
                    src.append(values[x])
                    dst.append(values[y])
            yield pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64)) for x in (src, dst)], ["src", "dst"])

    return postings.select("fps").mapInArrow(run, "src long, dst long")


def near_duplicate_groups(docs: DataFrame, k: int = 3, seed: int = 42) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row of ``docs``.

    Fingerprints link at 2 or fewer differing bits; ``component_id`` is the smallest doc_id reachable.
    Equal fingerprints are one node however many rows carry them, so copies add no links. Rows whose
    doc_id is null keep it and don't name a component unless nothing else is there (then null). Repeated
    rows give repeated results; an empty table gives an empty result; other columns are ignored.
    """
    fps = materialize(fingerprints(docs, k, seed), "fingerprints")
    nodes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = connected_components(fingerprint_links(nodes.select("fp")))
    placed = nodes.join(roots.select(F.col("node").alias("fp"), F.col("component")), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    placed = materialize(placed, "placed")
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.select("fp", "root").join(ids, "root").select("fp", "component_id")
    return fps.join(named, "fp", "left").select("doc_id", "fp", "component_id")


# --- near copies: the same index over two fingerprints, with shingle similarity as the last word ---

#: Of the 8 positional bytes of a fingerprint this many are shared by two that meet; bits of both fingerprints in which near copies may differ.
SHARED, NEAR_BITS = 4, 22
#: Texts of a posting that are all compared with each other at once; of more, each is compared with the CENTRAL one nearest to the posting's
#: majority first, and then with all that it isn't connected with, BLOCK by BLOCK texts at a time where there are more of them.
FEW, CENTRAL, BLOCK = 6, 1, 2048
#: Bins of a text's shingles: what two texts have in common bin by bin bounds what they share. Counts of a longer text may not fit.
BINS, FIT = 128, 65_535
#: Nodes of a task that are posted together, and bytes of postings of one bucket, about.
FLUSH, BUCKET_BYTES = 1 << 15, 8 << 20
_POSTED = np.dtype([("key", "<u8"), ("at", "<u4"), ("off", "u1")])
_PAIR = np.dtype([("a", "<i8"), ("b", "<i8")])
_PRINTS = np.dtype([("node", "<i8"), ("f1", "<u8"), ("f2", "<u8")])
_HELD = np.dtype([("node", "<i8"), ("root", "<i8"), ("f1", "<u8"), ("f2", "<u8"), ("n", "<i8"), ("bins", "<u2", (BINS,))])
_SEEDS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_CHOICES = [list(c) for c in combinations(range(8), SHARED)]
#: The first choice of bytes among those of a bit mask, or none.
_NONE = 2 * len(_CHOICES)
_FIRST = np.array([next((n for n, c in enumerate(_CHOICES) if all(m >> i & 1 for i in c)), _NONE) for m in range(256)])


def word_prints(words: Words, rows: int) -> np.ndarray:
    """Two 64-bit SimHashes of the distinct words of each row: a changed word moves few of their bits."""
    out = np.zeros((rows, 2), np.uint64)
    row = words.row
    order = np.lexsort((words.code, row))
    row, code = row[order], words.code[order]
    own = np.ones(len(row), bool)
    own[1:] = (row[1:] != row[:-1]) | (code[1:] != code[:-1])
    row, code = row[own], code[own]
    if len(row):
        begin = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        count = np.diff(np.append(begin, len(row)))
        for n in range(2):
            bits = np.unpackbits(mix(code ^ _SEEDS[n]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones = np.add.reduceat(bits, begin, axis=0, dtype=np.int32)
            out[row[begin], n] = np.ascontiguousarray(np.packbits(2 * ones > count[:, None], axis=1, bitorder="little")).view(np.uint64)[:, 0]
    return out


def compared(posted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First pairs of the nodes of each posting, and the size of each entry's posting.

    ``posted`` is in the order of key, distance from the posting's majority, and node. Postings of FEW nodes give all
    their pairs; of more, each node is paired with the CENTRAL ones, so that copies of one text meet it or those
    nearest to it. ``crowd_pairs`` has the others.
    """
    n = np.arange(len(posted))
    group = np.ones(len(posted), bool)
    group[1:] = posted["key"][1:] != posted["key"][:-1]
    begin = np.flatnonzero(group)
    size = np.diff(np.append(begin, len(posted)))
    size, k = np.repeat(size, size), n - np.repeat(begin, size)
    crowd = size > FEW
    pairs = []
    for d in range(1, FEW):
        late = np.flatnonzero(~crowd & (k >= d))
        pairs.append((late - d, late))
    for r in range(CENTRAL):
        late = np.flatnonzero(crowd & (k > r))
        pairs.append((late - k[late] + r, late))
    a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
    return _pairs(posted["at"][a], posted["at"][b]), size


def _pairs(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Distinct pairs of different nodes, the lesser first."""
    out = np.zeros(len(u), _PAIR)
    out["a"], out["b"] = np.minimum(u, v), np.maximum(u, v)
    return np.unique(out[u != v])


def _postings(prints: np.ndarray) -> np.ndarray:
    """Each node under every choice of SHARED positional bytes of either fingerprint, with its distance from the majority of those posted with it."""
    both = np.stack([prints["f1"], prints["f2"]], 1)
    raw = both.view(np.uint8).reshape(len(prints), 2, 8)
    keys = np.stack([raw[:, n, c].copy().view("<u4")[:, 0].astype(np.uint64) | np.uint64((n * len(_CHOICES) + i) << 32) for n in range(2) for i, c in enumerate(_CHOICES)], 1)
    out = np.zeros(keys.size, _POSTED)
    out["key"], out["at"] = keys.reshape(-1), np.repeat(np.arange(len(prints)), keys.shape[1])
    out = out[np.argsort(out["key"], kind="stable")]
    begin = np.flatnonzero(np.concatenate(([True], out["key"][1:] != out["key"][:-1])))
    size = np.diff(np.append(begin, len(out)))
    for b, n in zip(begin[size > FEW].tolist(), size[size > FEW].tolist(), strict=True):
        own = both[out["at"][b : b + n]]
        bits = np.unpackbits(own.view(np.uint8).reshape(n, 16), axis=1)
        major = np.packbits(2 * bits.sum(0) > n).view(np.uint64)
        out["off"][b : b + n] = np.bitwise_count(own ^ major).sum(1)
    return out


def deal(posted: np.ndarray, held: np.ndarray, buckets: int) -> pa.RecordBatch:
    """``(bucket, entries, nodes)``: for each bucket of the keys its entries, and once each node that they are at."""
    slot = (mix(posted["key"]) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((posted["at"], slot))
    parts = np.split(order, np.flatnonzero(np.diff(slot[order])) + 1) if len(order) else []
    entries, nodes = [], []
    for p in parts:
        own, rows = np.unique(posted["at"][p]), posted[p]
        rows["at"] = np.searchsorted(own, rows["at"])
        entries.append(squeeze(b"".join([np.ascontiguousarray(rows[c]).tobytes() for c in rows.dtype.names])))
        nodes.append(squeeze(held[own].tobytes()))
    return pa.RecordBatch.from_arrays([pa.array([int(slot[p[0]]) for p in parts], pa.int64()), pa.array(entries, pa.binary()), pa.array(nodes, pa.binary())], ["bucket", "entries", "nodes"])


def dealt_rows(table: pa.Table, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """Entries and nodes of one bucket; entries in the order of key, distance from the posting's majority, and node."""
    held = [np.frombuffer(expand(x.as_py()), dtype) for x in table.column("nodes")]
    posted = []
    for x, at in zip(table.column("entries"), np.cumsum([0, *map(len, held)]).tolist(), strict=False):
        raw, begin = expand(x.as_py()), 0
        out = np.empty(len(raw) // _POSTED.itemsize, _POSTED)
        for c in _POSTED.names:
            out[c] = np.frombuffer(raw, _POSTED[c], len(out), begin)
            begin += len(out) * _POSTED[c].itemsize
        out["at"] += np.uint32(at)
        posted.append(out)
    posted, held = np.concatenate(posted), np.concatenate(held)
    return posted[np.lexsort((held["node"][posted["at"]], posted["off"], posted["key"]))], held


def candidate_pairs(nodes: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(a, b, bits)``, a < b: first pairs of nodes that share SHARED positional bytes of a fingerprint and differ in at most NEAR_BITS of all.

    Of the postings that have more: ``(node, keys)``, packed keys of those of at most ``block`` nodes, in several rows for a node, and
    ``(key, node)`` of larger ones.
    """
    size = max(1, nodes.count() * 2 * len(_CHOICES) * _POSTED.itemsize)
    buckets = -(-size // BUCKET_BYTES)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, FLUSH):
                held = _rows_of(batch.slice(at, FLUSH), _PRINTS)
                yield deal(_postings(held), held, buckets)

    def meet(table: pa.Table) -> pa.Table:
        posted, held = dealt_rows(table, _PRINTS)
        pairs, size = compared(posted)
        x, y = held[pairs["a"]], held[pairs["b"]]
        bits = sum(np.bitwise_count(x[f] ^ y[f]).astype(np.int32) for f in ("f1", "f2"))
        x, y, bits = x["node"][bits <= NEAR_BITS], y["node"][bits <= NEAR_BITS], bits[bits <= NEAR_BITS]
        large, crowd = posted[size > block], posted[(size > FEW) & (size <= block)]
        crowd = crowd[np.argsort(crowd["at"], kind="stable")]
        own, first = np.unique(crowd["at"], return_index=True)
        keys = [k.tobytes() for k in np.split(np.ascontiguousarray(crowd["key"]), first[1:])] if len(own) else []
        return pa.table(
            {
                "kind": np.repeat(np.arange(3, dtype=np.int32), [len(x), len(own), len(large)]),
                "a": np.concatenate([np.minimum(x, y), held["node"][own], large["key"].view(np.int64)]),
                "b": np.concatenate([np.maximum(x, y), held["node"][own], held["node"][large["at"]]]),
                "bits": np.concatenate([bits, np.zeros(len(own) + len(large), np.int32)]),
                "keys": pa.array([*[None] * len(x), *keys, *[None] * len(large)], pa.binary()),
            }
        )

    # in an order of their own, so that a run finds what the last one found
    ordered = nodes.repartition(max(1, -(-size // (8 * BUCKET_BYTES))), F.xxhash64("node")).sortWithinPartitions("node")
    dealt = ordered.select("node", "f1", "f2").mapInArrow(post, "bucket long, entries binary, nodes binary")
    met = materialize(dealt.groupBy("bucket").applyInArrow(meet, "kind int, a long, b long, bits int, keys binary"), "met")
    pairs = met.where("kind = 0").select("a", "b", "bits").distinct()
    return pairs, met.where("kind = 1").select(F.col("b").alias("node"), "keys"), met.where("kind = 2").select(F.col("a").alias("key"), F.col("b").alias("node"))


def first_choice(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The first choice of bytes under which two nodes meet: of their postings this one is to compare them."""
    same = [np.packbits((x[f] ^ y[f]).view(np.uint8).reshape(-1, 8) == 0, axis=1, bitorder="little")[:, 0] for f in ("f1", "f2")]
    return np.where(_FIRST[same[0]] < _NONE, _FIRST[same[0]], _FIRST[same[1]] + len(_CHOICES))


def may_reach(x: np.ndarray, y: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets may reach the similarity by their sizes and by their shingles in each bin."""
    least = np.minimum(x["n"], y["n"])
    both = np.where(np.maximum(x["n"], y["n"]) > FIT, least, np.minimum(x["bins"], y["bins"]).sum(1, dtype=np.int64))
    return both >= similarity * (x["n"] + y["n"] - both)


def reaching(held: np.ndarray, x: np.ndarray, y: np.ndarray, choice: int, similarity: float) -> np.ndarray:
    """Pairs of nodes of ``x`` and of ``y`` that meet first under this choice, differ in at most NEAR_BITS, have not one root, and may reach the similarity."""
    out = [np.zeros(0, _PAIR)]
    for at in range(0, len(x), 256):
        part = x[at : at + 256]
        bits = sum(np.bitwise_count(held[f][part][:, None] ^ held[f][y]) for f in ("f1", "f2"))
        s, t = np.nonzero((bits <= NEAR_BITS) & (held["root"][part][:, None] != held["root"][y]))
        s, t = part[s], y[t]
        for k in range(0, len(s), 1 << 15):
            a, b = held[s[k : k + (1 << 15)]], held[t[k : k + (1 << 15)]]
            here = first_choice(a, b) == choice
            a, b = a[here], b[here]
            may = may_reach(a, b, similarity)
            out.append(_pairs(a["node"][may], b["node"][may]))
    return np.unique(np.concatenate(out))


def _rows_of(table: pa.Table | pa.RecordBatch, dtype: np.dtype) -> np.ndarray:
    out = np.empty(table.num_rows, dtype)
    for c in dtype.names:
        column = table.column(c)
        out[c] = np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, BINS) if c == "bins" else column.to_numpy().view(dtype[c])
    return out


def crowd_pairs(crowds: DataFrame, large: DataFrame, placed: DataFrame, similarity: float, block: int = BLOCK) -> DataFrame:
    """``(a, b)``, a < b: all nodes of a posting that differ in at most NEAR_BITS of both fingerprints, have not one root, and may reach the similarity.

    Two nodes are compared in the first of the postings that they share; if that is none of those here, it has listed all its pairs. A node
    goes once to each bucket of postings that has one of its own, and nodes of a posting's commonest root are compared with the others only.
    A posting of more than ``block`` nodes is cut into blocks, for the others into as many as these need, and each pair of blocks is a group
    of its own. Pairs that share too few shingles even if all of a bin were the same don't leave it.
    """
    each = crowds.groupBy("node").agg(F.collect_list("keys").alias("keys"))
    buckets = max(1, -(-each.count() * 2 * len(_CHOICES) * _HELD.itemsize // BUCKET_BYTES))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, FLUSH):
                own = batch.slice(at, FLUSH)
                keys = [np.frombuffer(b"".join(x), np.uint64) for x in own.column("keys").to_pylist()]
                posted = np.zeros(sum(map(len, keys)), _POSTED)
                posted["key"], posted["at"] = np.concatenate(keys), np.repeat(np.arange(len(keys)), list(map(len, keys)))
                yield deal(posted, _rows_of(own, _HELD), buckets)

    def compare(table: pa.Table) -> pa.Table:
        posted, held = dealt_rows(table, _HELD)
        found = [np.zeros(0, _PAIR)]
        for own in np.split(posted, np.flatnonzero(np.diff(posted["key"])) + 1):
            at = own["at"]
            _, root, count = np.unique(held["root"][at], return_inverse=True, return_counts=True)
            if len(count) > 1:
                found.append(reaching(held, at[root != np.argmax(count)], at, int(own["key"][0]) >> 32, similarity))
        out = np.concatenate(found)
        return pa.table({"a": out["a"], "b": out["b"]})

    def compare_blocks(table: pa.Table) -> pa.Table:
        other = table.column("other").to_numpy(zero_copy_only=False).astype(bool)
        out = reaching(_rows_of(table, _HELD), np.flatnonzero(other), np.flatnonzero(~other), table.column("key")[0].as_py() >> 32, similarity)
        return pa.table({"a": out["a"], "b": out["b"]})

    dealt = each.join(placed, "node").select("keys", "node", "root", "f1", "f2", "n", "bins").mapInArrow(post, "bucket long, entries binary, nodes binary")
    pairs = dealt.groupBy("bucket").applyInArrow(compare, "a long, b long")
    if large.count():
        rows = large.join(placed.select("node", "root"), "node")
        roots = rows.groupBy("key", "root").agg(F.count("*").alias("c")).groupBy("key").agg(F.sum("c").alias("m"), F.max(F.struct("c", "root")).alias("most"))
        roots = roots.where("most.c < m").select("key", F.col("most.root").alias("main"), F.ceil(F.col("m") / block).alias("all"), F.ceil((F.col("m") - F.col("most.c")) / block).alias("others"))
        rows = rows.join(roots, "key").withColumn("h", F.xxhash64("node"))
        up_to = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        meant = rows.select("key", "node", F.lit(False).alias("other"), F.pmod("h", "all").alias("i"), up_to("others").alias("j"))
        others = rows.where("root <> main").select("key", "node", F.lit(True).alias("other"), up_to("all").alias("i"), F.pmod("h", "others").alias("j"))
        pairs = pairs.unionByName(meant.unionByName(others).join(placed, "node").groupBy("key", "i", "j").applyInArrow(compare_blocks, "a long, b long"))
    return pairs


def near_copy_groups(texts: DataFrame, words: int = 5, similarity: float = 0.8, block: int = BLOCK) -> DataFrame:
    """``(digest, component, least)`` of every distinct text: texts of one component are copies of each other, exact or near.

    ``texts`` has ``digest``, ``doc_id`` and ``text``; texts of one digest are the same. Two texts are near copies
    if the Jaccard similarity of their sets of ``words``-word shingles reaches ``similarity``. Candidates come from
    the byte-position index over two fingerprints of the texts' distinct words, and are verified exactly: first
    each text's nearest, then all that were passed over, at last those of crowded postings, unless they are connected already.
    ``component`` is a number; ``least`` the smallest doc_id of the digest. ``block`` bounds the texts of a posting that one task compares.
    """

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = word_prints(words_of(*raw_bytes(batch.column("text"))), batch.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("digest"), batch.column("doc_id"), *(pa.array(np.ascontiguousarray(found[:, n])) for n in range(2))], ["digest", "doc_id", "f1", "f2"])

    nodes = texts.select("digest", "doc_id", "text").mapInArrow(prints, "digest long, doc_id long, f1 long, f2 long")
    nodes = nodes.groupBy("digest").agg(F.min("doc_id").alias("least"), F.min("f1").alias("f1"), F.min("f2").alias("f2"))
    nodes = materialize(nodes.select("*", F.col("digest").alias("node")), "nodes")
    nearest = F.row_number().over(W.partitionBy("b").orderBy("bits", "a"))
    pairs, crowds, large = candidate_pairs(nodes, block)
    pairs = materialize(pairs.withColumn("nth", nearest), "pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).union(crowds.select("node")).union(large.select("node")).distinct().select(F.col("node").alias("digest"), "node")

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            own = words_of(*raw_bytes(batch.column("text")))
            code, whole = shingles_of(own, words)
            sets, bins = [], []
            for a, b in zip(own.first[:-1].tolist(), own.first[1:].tolist(), strict=True):
                inside = code[a:b][whole[a:b]]
                each = np.unique(inside if len(inside) else mix(own.code[a:b]).sum(keepdims=True))
                sets.append(each.tobytes())
                bins.append(np.bincount((each % np.uint64(BINS)).astype(np.int64), minlength=BINS).astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary()), pa.array(bins, pa.binary())], ["node", "shingles", "bins"])

    sets = texts.select("digest", "text").join(wanted, "digest").select("node", "text").mapInArrow(shingled, "node long, shingles binary, bins binary")
    sets = materialize(sets.groupBy("node").agg(F.min(F.struct("shingles", "bins")).alias("x")).select("node", "x.*"), "shingles")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for u, v in zip(batch.column("u"), batch.column("v"), strict=True):
                x, y = np.frombuffer(u.as_buffer(), np.uint64), np.frombuffer(v.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(both >= similarity * (len(x) + len(y) - both))
            yield batch.select(["a", "b", "ra", "rb"]).filter(pa.array(good, pa.bool_()))

    def near(some: DataFrame) -> DataFrame:
        side = lambda x, c: sets.select(F.col("node").alias(x), F.col("shingles").alias(c))
        return materialize(some.join(side("a", "u"), "a").join(side("b", "v"), "b").select("a", "b", "ra", "rb", "u", "v").mapInArrow(verified, "a long, b long, ra long, rb long"), "near")

    links = near(pairs.where("nth = 1").select("a", "b", F.col("a").alias("ra"), F.col("b").alias("rb")))
    roots = connected_components(links, "a", "b")
    placed = sets.select("node", "bins", F.expr("octet_length(shingles) div 8").alias("n")).join(nodes.select("node", "f1", "f2"), "node").join(roots, "node", "left")
    placed = materialize(placed.select("node", "f1", "f2", F.coalesce("component", "node").alias("root"), "n", "bins"), "placed")
    named = nodes.select("digest", "node", "least").join(roots, "node", "left").select("digest", "least", F.coalesce("component", "node").alias("root"))

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.empty(batch.num_rows, _HELD) for _ in "ab")
            for own, s in ((x, "a"), (y, "b")):
                own["n"], own["bins"] = batch.column(f"n{s}").to_numpy(), np.frombuffer(b"".join(batch.column(f"bins{s}").to_pylist()), "<u2").reshape(-1, BINS)
            yield batch.select(["a", "b", "ra", "rb"]).filter(pa.array(may_reach(x, y, similarity), pa.bool_()))

    def moved(passed: DataFrame) -> DataFrame:
        """``(root, to)`` of the roots that these pairs connect."""
        a, b = (placed.select(F.col("node").alias(x), *(F.col(c).alias(f"{c[0]}{x}") for c in ("root", "n")), F.col("bins").alias(f"bins{x}")) for x in "ab")
        open_ = passed.join(a, "a").join(b, "b").where("ra <> rb").select("a", "b", "ra", "rb", "na", "nb", "binsa", "binsb").mapInArrow(bounded, "a long, b long, ra long, rb long")
        return connected_components(near(open_), "ra", "rb").select(F.col("node").alias("root"), F.col("component").alias("to"))

    further = moved(pairs.where("nth > 1").select("a", "b"))
    named = named.join(further, "root", "left").select("digest", "least", F.coalesce("to", "root").alias("root"))
    placed = materialize(placed.join(further, "root", "left").select("node", "f1", "f2", F.coalesce("to", "root").alias("root"), "n", "bins"), "placed")
    further = moved(crowd_pairs(crowds, large, placed, similarity, block))
    return named.join(further, "root", "left").select("digest", F.coalesce("to", "root").alias("component"), "least")
