"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence, bounded by the sizes of the sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenarium.llm.buckets import expand, squeeze
from scenarium.llm.textarrays import Words, mix, raw_bytes, shingles_of, slices, words_of
from scenarium.operators.graph import connected_components
from scenarium.plans.materialize import materialize

#: Bytes of text that a task turns into one block of the incidence matrix, and bytes of text to each block of n-grams, about.
CHUNK_BYTES, BUCKET_BYTES = 8 << 20, 16 << 20
#: Documents of an n-gram whose open pairs are listed; of more, blocks of BLOCK by BLOCK documents are multiplied, COLUMNS n-grams at a time.
FEW, BLOCK, COLUMNS = 256, 1024, 4096

_ASKED = np.dtype([("lo", "<u4"), ("hi", "<u2"), ("row", "<u4"), ("many", "<u4")])
_KNOWN = np.dtype([("lo", "<u4"), ("hi", "<u2"), ("row", "<u4"), ("many", "<u4"), ("rank", "u1")])
_DOC = np.dtype([("digest", "<i8"), ("n", "<u4")])
_SHARED = np.dtype([("row", "<u4"), ("code", "<u8")])
#: Kinds of packed rows: the documents of a chunk, n-grams that several of them have, n-grams asked about.
_DOCS, _OWN, _ASK = 0, 1, 2


def _pack(rows: np.ndarray) -> bytes:
    """Column by column, and of ``row``, which ascends, the steps."""
    steps = lambda c: np.diff(rows[c], prepend=rows[c].dtype.type(0)) if c == "row" else np.ascontiguousarray(rows[c])
    return squeeze(b"".join(steps(c).tobytes() for c in rows.dtype.names))


def _unpack(blob: bytes, dtype: np.dtype) -> np.ndarray:
    raw = expand(blob)
    out, at = np.empty(len(raw) // dtype.itemsize, dtype), 0
    for c in dtype.names:
        out[c] = np.frombuffer(raw, dtype[c], len(out), at)
        at += len(out) * dtype[c].itemsize
    if "row" in dtype.names:
        out["row"] = np.cumsum(out["row"], dtype=np.uint32)
    return out


def _rows(dtype: np.dtype, **columns: np.ndarray) -> np.ndarray:
    out = np.empty(len(next(iter(columns.values()))), dtype)
    for name, values in columns.items():
        out[name] = values
    return out


def incidence(words: Words, k: int, shift: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Rows and codes of the distinct k-grams of every row, in the order of both; fewer words are one gram, no words none."""
    code, whole = shingles_of(words, k)
    row, count = words.row[whole], np.diff(words.first)
    rows, codes = [row], [code[whole]]
    for m in range(1, k):
        short = np.flatnonzero(count == m)
        if len(short):
            rows.append(short)
            codes.append(mix(shingles_of(words, m)[0][words.first[short]] ^ np.uint64(m)))
    row, code = np.concatenate(rows), np.concatenate(codes) >> np.uint64(shift)
    order = np.lexsort((code, row))
    row, code = row[order], code[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (code[1:] != code[:-1])
    return row[new], code[new]


def _least_shared(n: np.ndarray, percent: int) -> np.ndarray:
    """What a set of n must share with another to reach the similarity, however small the other is."""
    return -(-percent * n.astype(np.int64) // 100)


def _alike(both: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    return 100 * both >= percent * (n + m - both)


def _places(size: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of consecutive runs of these sizes."""
    return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)


def shared_sets(texts: DataFrame, k: int, percent: int) -> DataFrame:
    """``(digest, n, central, grams, prefix)`` of the distinct texts, a row of one text at least.

    ``n`` is the size of a text's set. ``grams``, n-grams that another text has too, are given where there are enough of
    them for a partner; ``prefix`` are the rarest of these, so many that two partners share one of them. Each chunk of
    texts asks the block of every n-gram once; the block counts over all chunks. A chunk answers for what its own texts share,
    so that a block gets a row for each chunk however frequent the n-gram is.
    """
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    b = max(0, -(-total // BUCKET_BYTES) - 1).bit_length()
    shift, low = max(0, 16 - b), np.uint64((1 << b) - 1)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for batch in slices(batches, limit=CHUNK_BYTES):
            digest, first = np.unique(batch.column("digest").to_numpy(zero_copy_only=False), return_index=True)
            row, code, at = [], [], 0
            for part in slices(iter([pa.RecordBatch.from_arrays([batch.column("text").take(pa.array(first))], ["text"])])):
                own = incidence(words_of(*raw_bytes(part.column("text"))), k, shift)
                row, code, at = [*row, own[0] + at], [*code, own[1]], at + part.num_rows
            row, code = np.concatenate(row), np.concatenate(code)
            docs = _rows(_DOC, digest=digest, n=np.bincount(row, minlength=len(digest)))
            order = np.argsort(code, kind="stable")
            row, code = row[order], code[order]
            begin = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1]))) if len(code) else np.zeros(0, np.int64)
            many = np.diff(np.append(begin, len(code)))
            own = np.flatnonzero(np.repeat(many > 1, many))
            own = own[np.argsort(row[own], kind="stable")]
            asked, slot = code[begin], (code[begin] & low).astype(np.int64)
            order = np.lexsort((row[begin], slot))
            rest = asked[order] >> np.uint64(b)
            packed = _rows(_ASKED, lo=rest & np.uint64(0xFFFFFFFF), hi=rest >> np.uint64(32), row=row[begin][order], many=many[order])
            slot = slot[order]
            cut = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1], [True]))) if len(slot) else np.zeros(1, np.int64)
            keys = [-1 - chunk, -1 - chunk, *slot[cut[:-1]].tolist()]
            blobs = [_pack(docs), _pack(_rows(_SHARED, row=row[own], code=code[own])), *(_pack(packed[x:y]) for x, y in zip(cut[:-1], cut[1:], strict=True))]
            kinds = [_DOCS, _OWN] + [_ASK] * (len(keys) - 2)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([chunk] * len(keys), pa.int64()), pa.array(kinds, pa.int32()), pa.array(blobs, pa.binary())], ["key", "chunk", "kind", "rows"])
            chunk += 1

    def answer(table: pa.Table) -> pa.Table:
        key = table.column("key")[0].as_py()
        if key < 0:
            return table
        packs = [_unpack(x.as_py(), _ASKED) for x in table.column("rows")]
        rows = np.concatenate(packs)
        pack = np.repeat(np.arange(len(packs)), list(map(len, packs)))
        rest = rows["lo"].astype(np.uint64) | rows["hi"].astype(np.uint64) << np.uint64(32)
        _, at = np.unique(rest, return_inverse=True)
        count = np.bincount(at, weights=rows["many"])[at]
        known = _rows(_KNOWN, **{c: rows[c] for c in _ASKED.names}, rank=np.log2(count) if len(count) else count)
        out = [_pack(known[(pack == n) & (count > 1)]) for n in range(len(packs))] if len(packs) < 64 else _split(known[count > 1], pack[count > 1], len(packs))
        return pa.table({"key": table.column("key"), "chunk": table.column("chunk"), "kind": table.column("kind"), "rows": pa.array(out, pa.binary())})

    def decide(table: pa.Table) -> pa.Table:
        kinds = table.column("kind").to_pylist()
        blobs = [x.as_py() for x in table.column("rows")]
        docs = _unpack(blobs[kinds.index(_DOCS)], _DOC)
        own = _unpack(blobs[kinds.index(_OWN)], _SHARED)
        keys = table.column("key").to_pylist()
        known = [(_unpack(x, _KNOWN), key) for x, kind, key in zip(blobs, kinds, keys, strict=True) if kind == _ASK]
        rows = np.concatenate([x for x, _ in known]) if known else np.empty(0, _KNOWN)
        bucket = np.repeat(np.array([key for _, key in known], np.uint64), [len(x) for x, _ in known])
        code = (rows["lo"].astype(np.uint64) | rows["hi"].astype(np.uint64) << np.uint64(32)) << np.uint64(b) | bucket
        several = rows["many"] > 1
        order = np.argsort(code[several], kind="stable")
        rank = rows["rank"][several][order][np.searchsorted(code[several][order], own["code"])] if len(own) else np.zeros(0, np.uint8)
        row = np.concatenate([rows["row"][~several], own["row"]]).astype(np.int64)
        code, rank = np.concatenate([code[~several], own["code"]]), np.concatenate([rows["rank"][~several], rank])
        have, need = np.bincount(row, minlength=len(docs)), _least_shared(docs["n"], percent)
        stays = (have >= need) & (docs["n"] > 0)
        central = np.bincount(row, weights=rank, minlength=len(docs)) / np.maximum(docs["n"], 1)
        inside = stays[row]
        row, code, rank = row[inside], code[inside], rank[inside]
        order = np.lexsort((code, rank, row))
        row, code = row[order], code[order]
        size = np.where(stays, have, 0)
        ahead = np.split(code, np.cumsum(size)[:-1]) if len(docs) else []
        length = (have - need + 1).tolist()
        grams = [np.sort(x).tobytes() if s else None for x, s in zip(ahead, stays.tolist(), strict=True)]
        prefix = [x[:m].tobytes() if s else None for x, m, s in zip(ahead, length, stays.tolist(), strict=True)]
        return pa.table({"digest": docs["digest"], "n": docs["n"].astype(np.int64), "central": central, "grams": pa.array(grams, pa.binary()), "prefix": pa.array(prefix, pa.binary())})

    asked = texts.select("digest", "text").mapInArrow(ask, "key long, chunk long, kind int, rows binary")
    answers = asked.groupBy("key").applyInArrow(answer, asked.schema)
    return answers.groupBy("chunk").applyInArrow(decide, "digest long, n long, central double, grams binary, prefix binary")


def _split(rows: np.ndarray, pack: np.ndarray, packs: int) -> list[bytes]:
    cut = np.searchsorted(pack, np.arange(packs + 1))
    return [_pack(rows[x:y]) for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


def overlaps(left: list[np.ndarray], right: list[np.ndarray], least: np.ndarray) -> np.ndarray:
    """Overlap counts of the sets of ``left`` with those of ``right``; exact where they reach ``least``, a matrix, or else anything lower.

    The product of the two incidence matrices is summed up over blocks of columns. Documents leave it when no pair of
    theirs can reach its bound with the columns to come.
    """
    sets = left + right
    flat = np.concatenate(sets)
    who = np.repeat(np.arange(len(sets)), list(map(len, sets)))
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    who, column = who[count[column] > 1], column[count[column] > 1]
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    who, column = who[order], column[order]
    rest = np.bincount(who, minlength=len(sets))
    out = np.zeros((len(left), len(right)), np.int64)
    rows, cols = np.arange(len(left)), np.arange(len(right))
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        x, y = np.searchsorted(column, [at, at + COLUMNS])
        block = np.zeros((len(sets), min(COLUMNS, int(column[-1]) + 1 - at)), np.float32)
        block[who[x:y], column[x:y] - at] = 1
        out[np.ix_(rows, cols)] += (block[rows] @ block[len(left) + cols].T).astype(np.int64)
        rest = rest - np.bincount(who[x:y], minlength=len(sets))
        live = out[np.ix_(rows, cols)] + np.minimum(rest[rows][:, None], rest[len(left) + cols]) >= least[np.ix_(rows, cols)]
        rows, cols = rows[live.any(1)], cols[live.any(0)]
    return out


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest of n nodes that each reaches by the links (a, b)."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those ``(a, b)`` whose sets reach the similarity."""
    side = lambda x: sets.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("grams").alias(f"g{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [len(np.intersect1d(np.frombuffer(u.as_buffer(), np.uint64), np.frombuffer(v.as_buffer(), np.uint64), assume_unique=True)) for u, v in zip(batch.column("ga"), batch.column("gb"), strict=True)]
            good = _alike(np.array(both, np.int64), batch.column("na").to_numpy(), batch.column("nb").to_numpy(), percent)
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "ga", "gb").mapInArrow(run, "a long, b long")


def _bounded(n: str, m: str, percent: int) -> F.Column:
    """The smaller set is large enough for the larger one."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def set_links(sets: DataFrame, percent: int) -> DataFrame:
    """``(a, b)``: pairs of ``sets`` (node, n, central, grams, prefix) that reach the similarity, enough of them to connect all that do.

    Sets meet under the n-grams of their prefixes. First each is compared with the most central one under the n-gram, so that
    copies of one text are connected by as many pairs as there are copies. Then all pairs under an n-gram that aren't
    connected yet are tested: listed, or, where they are many, as products of blocks of documents, of which only a forest of links leaves the task.
    """

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column("prefix")]
            at = pa.array(np.repeat(np.arange(len(each)), list(map(len, each))))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(each)), *(batch.column(c).take(at) for c in ("node", "n", "central"))], ["gram", "node", "n", "central"])

    postings = sets.select("prefix", "node", "n", "central").mapInArrow(post, "gram long, node long, n long, central double")
    best = F.max(F.struct("central", "node", "n")).alias("best")
    crowds = postings.groupBy("gram").agg(F.count("*").alias("m"), best).where("m > 1").select("gram", "m", F.col("best.node").alias("mid"), F.col("best.n").alias("mid_n"))
    postings = materialize(postings.join(crowds, "gram").select("gram", "node", "n", "m", "mid", "mid_n"), "postings")
    tested = postings.where((F.col("node") != F.col("mid")) & _bounded("n", "mid_n", percent)).select(F.least("node", "mid").alias("a"), F.greatest("node", "mid").alias("b"))
    tested = materialize(tested.distinct(), "tested")
    links = materialize(verified(tested, sets, percent), "links")
    roots = connected_components(links, "a", "b")
    placed = postings.join(roots, "node", "left").select("gram", "node", "n", "m", F.coalesce("component", "node").alias("root"))
    placed = materialize(placed, "placed")
    several = placed.groupBy("gram").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("gram")
    still = materialize(placed.join(several, "gram"), "open")

    side = lambda x: still.where(F.col("m") <= FEW).select("gram", F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("root").alias(f"r{x}"))
    listed = side("a").join(side("b"), "gram").where((F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")) & _bounded("na", "nb", percent)).select("a", "b").distinct()
    listed = listed.join(tested, ["a", "b"], "left_anti")

    blocks = F.ceil(F.col("m") / BLOCK)
    crowd = still.where(F.col("m") > FEW).withColumn("own", F.pmod(F.xxhash64("node"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    crowd = crowd.select("gram", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "root").join(sets.select("node", "n", "grams"), "node")

    def multiply(table: pa.Table) -> pa.Table:
        node, root, n, own = (table.column(c).to_numpy() for c in ("node", "root", "n", "own"))
        grams = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("grams")]
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        x, y = np.flatnonzero(own == i), np.flatnonzero(own == j)
        n = n.astype(np.int64)
        least = -(-percent * (n[x][:, None] + n[y]) // (100 + percent))
        least[root[x][:, None] == root[y]] = 1 << 60
        both = overlaps([grams[a] for a in x], [grams[a] for a in y], least)
        a, b = np.nonzero(both >= least)
        least_of = _roots(len(node), x[a], y[b])
        linked = np.flatnonzero(least_of != np.arange(len(node)))
        return pa.table({"a": node[linked], "b": node[least_of[linked]]})

    multiplied = crowd.groupBy("gram", "i", "j").applyInArrow(multiply, "a long, b long")
    return links.unionByName(materialize(verified(listed, sets, percent).unionByName(multiplied).distinct(), "more"))


def jaccard_groups(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for every row of ``docs``.

    A document's set are its distinct k-word shingles, or its whole word sequence if it has fewer words; A-Z are lower-cased.
    Documents link when 100 * |intersection| >= percent * |union|; ``component_id`` is the smallest doc_id reachable. A null text or
    one without words has an empty set and links with nothing, not even its like: its component is its own doc_id. Rows without a doc_id keep
    it and don't name a component unless nothing else is there (then null). Repeated rows give repeated results, an empty table an empty result;
    other columns are ignored. n-grams and texts are told apart by 64-bit hashes. ``docs`` is read twice and must be the same both times.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("digest", F.xxhash64("text"))
    found = materialize(shared_sets(rows, k, percent), "sets")
    sizes = found.groupBy("digest").agg(F.max("n").alias("n"))
    sets = materialize(found.where("prefix is not null").withColumnRenamed("digest", "node").dropDuplicates(["node"]), "nodes")
    roots = connected_components(set_links(sets, percent), "a", "b").select(F.col("node").alias("digest"), F.col("component").alias("root"))
    named = rows.select("doc_id", "digest").join(sizes, "digest").join(roots, "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    named = materialize(named, "named")
    least = named.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("least"))
    out = named.join(least, "root", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))
