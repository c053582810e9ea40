"""Conversation structure repair: Hirschberg's divide and conquer over four-state cost vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenarium.operators.ranking import numbered
from scenarium.plans.materialize import materialize

#: States of what has been kept so far: nothing, a system turn, ends with user, ends with assistant. Nothing and assistant may end.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
ROLE_OF = {USER: "user", ASSISTANT: "assistant"}
#: Runs of a block, and blocks that are put together at once.
BLOCK, FAN = 4096, 256
_FAR = 1 << 40

#: What comes next on inserting or reroling in each state, and on keeping a role's initial; None: not allowed.
TURNED = [USER, USER, ASSISTANT, USER]
KEPT = {"s": [SYSTEM, None, None, None], "u": [USER, USER, None, USER], "a": [None, None, ASSISTANT, None]}


def moves(initial: str, required: bool, truncated: bool) -> list[list[tuple[int, str, int]]]:
    """For each state the ``(cost, edits, next state)`` of one row: an insertion or none, then the row's own edit.

    Before a deletion nothing is inserted, as after it is ASCII-less, and nowhere two turns, which help at the end only. From a state a
    letter leads to one state, so that edits tell states.
    """
    late, out = TRUNCATED if truncated else 0, []
    for state in range(4):
        own = [(DELETE, "D", state)]
        for edits, cost, at in [("", 0, state), ("I", INSERT, TURNED[state])] if not required else []:
            own.append((cost + REROLE + late, edits + "R", TURNED[at]))
            to = KEPT.get(initial, [None] * 4)[at]
            if to is not None:
                own.append((cost + KEEP + late, edits + "K", to))
        out.append(own)
    return out


#: Insertions still needed at the end.
ENDS = {NOTHING: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}


def _forward(rows: list, cost: list[int], rank: list[int]) -> tuple[list[int], list[int]]:
    """Least costs of each state after ``rows``, and the order of the ASCII-least edits of that cost.

    Edits of different states never begin one with the other, so that their order holds whatever follows.
    """
    for row in rows:
        best: list = [None] * 4
        for state in range(4):
            if cost[state] < _FAR:
                for extra, edits, to in row[state]:
                    found = (cost[state] + extra, rank[state], edits)
                    if best[to] is None or found < best[to]:
                        best[to] = found
        order = sorted((b[1:] for b in best if b), key=lambda x: x)
        cost = [b[0] if b else _FAR for b in best]
        rank = [order.index(b[1:]) if b else 9 for b in best]
    return cost, rank


def _backward(rows: list, cost: list[int]) -> list[int]:
    """Least costs from each state before ``rows`` on."""
    for row in reversed(rows):
        cost = [min(extra + cost[to] for extra, _, to in row[state]) for state in range(4)]
    return cost


def _from(state: int) -> tuple[list[int], list[int]]:
    return [0 if s == state else _FAR for s in range(4)], [0] * 4


def hirschberg(rows: list, start: int, end: int) -> list[str]:
    """The edits of each row on the cheapest way from state to state, ASCII-least of these.

    The forward vectors of the first half and the backward vectors of the second meet at the middle; the cheapest crossing
    (of several the one with the ASCII-least edits before it) splits the work into two halves, so that no table of all rows and states is kept.
    """
    out: list[str] = []
    todo = [(0, len(rows), start, end)]
    while todo:
        a, b, p, q = todo.pop()
        if b - a == 1:
            out.append(min((extra, edits) for extra, edits, to in rows[a][p] if to == q)[1])
        elif b - a > 1:
            mid = (a + b) // 2
            ahead, rank = _forward(rows[a:mid], *_from(p))
            behind = _backward(rows[mid:b], _from(q)[0])
            at = min(range(4), key=lambda s: (ahead[s] + behind[s], rank[s]))
            todo += [(mid, b, at, q), (a, mid, p, at)]
    return out


def best_end(cost: list[int], rank: list[int]) -> int:
    return min(range(4), key=lambda s: (cost[s] + INSERT * len(ENDS[s]), rank[s]))


def _then(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Two consecutive summaries as one. A summary has for each state before and after the least cost and the order of its edits among those from the same state."""
    out = np.empty((4, 4, 2), np.int64)
    for p in range(4):
        ways = [min((first[p, m, 0] + second[m, q, 0], first[p, m, 1], second[m, q, 1]) for m in range(4)) for q in range(4)]
        order = sorted(w[1:] for w in ways)
        for q, w in enumerate(ways):
            out[p, q] = min(w[0], _FAR), order.index(w[1:])
    return out


def _summary(rows: list) -> np.ndarray:
    return np.array([np.stack(_forward(rows, *_from(p)), 1) for p in range(4)], np.int64)


def crossings(parts: list[np.ndarray], start: int, end: int) -> list[tuple[int, int]]:
    """States before and after each of consecutive summaries on the cheapest way, meeting in the middle again and again."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(parts), start, end)]
    while todo:
        a, b, p, q = todo.pop()
        if b - a == 1:
            out.append((p, q))
            continue
        mid = (a + b) // 2
        ahead, behind = parts[a], parts[b - 1]
        for x in parts[a + 1 : mid]:
            ahead = _then(ahead, x)
        for x in reversed(parts[mid : b - 1]):
            behind = _then(x, behind)
        at = min(range(4), key=lambda s: (ahead[p, s, 0] + behind[s, q, 0], ahead[p, s, 1]))
        todo += [(mid, b, at, q), (a, mid, p, at)]
    return out


def damage(rows: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, times)``: each row dropped, emptied, stripped of its ends, repeated (``times`` 2), given to the user, or left alone, by crc32 of ``conv_id:turn``.

    Null roles and texts are one space, and nulls in the key too.
    """
    text, role = F.coalesce(F.col("text").cast("string"), F.lit(" ")), F.coalesce(F.col("role").cast("string"), F.lit(" "))
    key = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat(key[0], F.lit(":"), key[1])) % 20
    new_text = F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text)
    new_role = F.when(kind == 4, "user").otherwise(role)
    return rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), new_role.alias("role"), new_text.alias("text"), F.when(kind == 3, 2).otherwise(1).alias("times"), kind.alias("kind")).where("kind <> 0").drop("kind")


def _last(text: Column) -> Column:
    """The last character of ``text`` that is no space; empty without one."""
    return F.substring(F.rtrim(text, F.lit(" \t\n\v\f\r")), -1, 1)


def _runs(table: pa.Table | pa.RecordBatch) -> list:
    known: dict = {}
    out = []
    for key in zip(*(table.column(c).to_pylist() for c in ("initial", "required", "truncated")), strict=True):
        if key not in known:
            known[key] = moves(*key)
        out.append(known[key])
    return out


def _block_summary(table: pa.Table) -> pa.Table:
    table = table.sort_by("n")
    return pa.table({"c": table.column("c")[:1], "block": table.column("block")[:1], "summary": pa.array([_summary(_runs(table)).tobytes()], pa.binary())})


def _ways(runs: DataFrame) -> DataFrame:
    """``(c, block, p, q)``: states before and after each block of conversations of more than one block.

    Summaries of blocks are put together FAN at a time until a conversation has one; then its end is chosen, and each level hands the states down.
    """
    levels = [materialize(runs.where("of > block_size").groupBy("c", "block").applyInArrow(_block_summary, "c string, block long, summary binary"), "blocks")]

    def together(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x.as_py(), np.int64).reshape(4, 4, 2) for x in table.sort_by("block").column("summary")]
        whole = parts[0]
        for x in parts[1:]:
            whole = _then(whole, x)
        return pa.table({"c": table.column("c")[:1], "block": table.column("up")[:1], "summary": pa.array([whole.tobytes()], pa.binary())})

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = [np.frombuffer(x.as_py(), np.int64).reshape(4, 4, 2)[NOTHING] for x in batch.column("summary")]
            ends = [best_end(x[:, 0].tolist(), x[:, 1].tolist()) for x in whole]
            yield pa.RecordBatch.from_arrays([batch.column("c"), batch.column("block"), pa.array([NOTHING] * len(ends), pa.int64()), pa.array(ends, pa.int64())], ["c", "block", "p", "q"])

    def down(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        parts = [np.frombuffer(x.as_py(), np.int64).reshape(4, 4, 2) for x in table.column("summary")]
        states = crossings(parts, table.column("p")[0].as_py(), table.column("q")[0].as_py())
        return pa.table({"c": table.column("c"), "block": table.column("block"), **{x: pa.array([s[k] for s in states], pa.int64()) for k, x in enumerate("pq")}})

    up = F.floor(F.col("block") / FAN)
    while (levels[-1].agg(F.max("block")).first()[0] or 0) > 0:
        levels.append(materialize(levels[-1].withColumn("up", up).groupBy("c", "up").applyInArrow(together, levels[0].schema), "blocks"))
    states = "c string, block long, p long, q long"
    ways = levels[-1].mapInArrow(chosen, states)
    for level in reversed(levels[:-1]):
        above = ways.select("c", F.col("block").alias("up"), "p", "q")
        ways = level.withColumn("up", up).join(above, ["c", "up"]).groupBy("c", "up").applyInArrow(down, states)
    return ways


def edits(runs: DataFrame) -> DataFrame:
    """``(c, n, edits, p)``: each run's edits and the state before it.

    ``runs`` has c (a conversation's name), n (from 0), of (runs of c), initial, required and truncated. A conversation of one block is repaired as a
    whole; blocks of longer ones between the states that were found for them.
    """
    runs = runs.withColumn("block_size", F.lit(BLOCK)).withColumn("block", F.floor(F.col("n") / BLOCK))
    placed = runs.join(_ways(runs), ["c", "block"], "left")

    def repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _blocks(batches):
            rows = _runs(own)
            p, q = own.column("p")[0].as_py(), own.column("q")[0].as_py()
            p = NOTHING if p is None else p
            q = best_end(*_forward(rows, *_from(p))) if q is None else q
            found, state, states = hirschberg(rows, p, q), p, []
            for row, letters in zip(rows, found, strict=True):
                states.append(state)
                state = next(to for _, e, to in row[state] if e == letters)
            yield pa.RecordBatch.from_arrays([own.column("c").combine_chunks(), own.column("n").combine_chunks(), pa.array(found, pa.string()), pa.array(states, pa.int32())], ["c", "n", "edits", "p"])

    parts = placed.repartition("c", "block").sortWithinPartitions("c", "block", "n")
    return parts.select("c", "block", "n", "initial", "required", "truncated", "p", "q").mapInArrow(repaired, "c string, n long, edits string, p int")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The consecutive rows of each c and block."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(x).to_numpy(zero_copy_only=False) for x in ("c", "block")]
        cut = [0, *(np.flatnonzero((keys[0][1:] != keys[0][:-1]) | (keys[1][1:] != keys[1][:-1])) + 1).tolist(), batch.num_rows]
        for x, y in zip(cut[:-1], cut[1:], strict=True):
            part = batch.slice(x, y - x)
            if held and any(held[-1].column(k)[0] != part.column(k)[0] for k in ("c", "block")):
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


class _Report:
    """One conversation's counts and digest, filled as its rows pass by in order."""

    def __init__(self) -> None:
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost"), 0)
        self.audit: list[str] = []
        self.sha, self.any, self.state = hashlib.sha256(), False, NOTHING
        self.turns, self.low, self.high, self.before, self.waits = 0, 0, -1, None, False

    def piece(self, role: str, text: str = "") -> None:
        self.sha.update(("\n" if self.any else "").encode() + f"{role}:".encode() + text.encode())
        self.any = True

    def insert(self, letters: str) -> None:
        for _ in letters:
            self.state = TURNED[self.state]
            self.piece(ROLE_OF[self.state])
        self.counts["cost"] += INSERT * len(letters)

    def run(self, row: dict) -> None:
        """A row and its equal neighbours, which are deleted."""
        count, times = self.counts, row["times"]
        if row["turn"] is not None and (not self.turns or row["turn"] != self.high):
            self.low, self.turns = row["turn"] if not self.turns else self.low, self.turns + 1
            self.high = row["turn"]
        if self.before is not None:
            count["illegal"] += self.before + row["initial"] not in ("su", "ua", "au")
        count["illegal"] += times - 1
        self.before = row["initial"]
        if row["blank"]:
            count["blank"] += times
        else:
            count["duplicate"] += times - 1 + row["duplicate"]
            count["truncated"] += row["truncated"] and not row["duplicate"]
        letters = row["edits"]
        self.audit.append(letters + "D" * (times - 1))
        self.insert(letters[:-1])
        count["cost"] += DELETE * (times - 1) + {"K": KEEP, "R": REROLE, "D": DELETE}[letters[-1]]
        self.waits = letters[-1] != "D"
        if self.waits:
            count["cost"] += TRUNCATED * row["truncated"]
            self.state = TURNED[self.state] if letters[-1] == "R" else KEPT[row["initial"]][self.state]
        self.rerole = ROLE_OF[self.state] if letters[-1] == "R" else None

    def text(self, role: str, text: str) -> None:
        if self.waits:
            self.piece(self.rerole or role, text)
            self.waits = False

    def result(self, c: str) -> tuple:
        self.audit.append(ENDS[self.state])
        self.insert(ENDS[self.state])
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return (int(c) if c else None, gaps, *self.counts.values(), "".join(self.audit), self.sha.hexdigest())


_RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repair(rows: DataFrame) -> DataFrame:
    """``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)`` of every conv_id of ``rows``, as ``damage`` leaves them.

    Rows follow by turn (nulls first; rows of one turn by the SHA-256 of role and text). Nulls in conv_id are one conversation; without rows left there are zeros,
    no edits and the hash of nothing. Equal rows of a turn are one run, however many. Where a role and text was seen first is an aggregate, so that no conversation is
    gathered to find duplicates; its edits come from blocks of runs. Only the digest needs a conversation's texts in order: they pass through one
    task, sorted, and aren't held. An empty table gives an empty result, other columns are ignored.
    """
    name = F.coalesce(F.col("conv_id").cast("long").cast("string"), F.lit("")).alias("c")
    left = damage(rows)
    digest = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    last = _last(F.col("text"))
    left = left.select(name, "turn", digest.alias("digest"), "role", "text", "times", (last == "").alias("blank"), (~last.isin("", ".", "!", "?")).alias("truncated"))
    runs = left.groupBy("c", "turn", "digest").agg(F.max(F.substring("role", 1, 1)).alias("initial"), F.max("blank").alias("blank"), F.max("truncated").alias("truncated"), F.sum("times").alias("times"))
    runs = numbered(runs, ["c"], ["turn", "digest"], "n", "of")
    seen = runs.where("not blank").groupBy("c", "digest").agg(F.min("n").alias("first"), F.count("*").alias("k")).where("k > 1").drop("k")
    runs = runs.join(seen, ["c", "digest"], "left").withColumn("duplicate", F.coalesce(F.col("n") > F.col("first"), F.lit(False)))
    runs = materialize(runs.withColumn("required", F.col("blank") | F.col("duplicate")).drop("first"), "runs")
    done = runs.join(edits(runs).drop("p"), ["c", "n"])
    own = ["initial", "blank", "truncated", "duplicate", "times", "edits"]
    none = lambda names, like: [F.lit(None).cast(like.schema[x].dataType).alias(x) for x in names]
    marks = rows.select(name).distinct().select("c", F.lit(0).alias("kind"), *none(["turn", "digest"], left), *none(own, done), *none(["role", "text"], left))
    done = done.select("c", F.lit(1).alias("kind"), "turn", "digest", *own, *none(["role", "text"], left))
    texts = left.where("not blank").select("c", F.lit(2).alias("kind"), "turn", "digest", *none(own, done), "role", "text")

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, now, out = None, None, []
        schema = pa.schema([(x.split()[0], pa.int64() if x.endswith("long") else pa.string()) for x in _RESULT.split(", ")])
        for batch in batches:
            for row in batch.to_pylist():
                if row["c"] != c:
                    if now:
                        out.append(now.result(c))
                    c, now = row["c"], _Report()
                if row["kind"] == 1:
                    now.run(row)
                elif row["kind"] == 2:
                    now.text(row["role"], row["text"])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                out = []
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(now.result(c), schema, strict=True)], schema=schema)

    return marks.unionByName(done).unionByName(texts).repartition("c").sortWithinPartitions("c", "turn", "digest", "kind").mapInArrow(report, _RESULT)
