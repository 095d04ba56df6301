"""Conversation structure repair: faults of turns, and the cheapest edits that make the roles ``(s?(ua)+)?``.

A conversation's rows stand by turn, nulls first, then by the digest of role and text, so ties have an order
(rows of one turn, role and text are equal, and a repeated row stands beside its copy). Each row is one
symbol of its conversation's signature: ``D`` if it must be deleted (blank, or seen before), else its role's
initial ``s``, ``u``, ``a`` or ``x`` for another, in capitals if the text breaks off.

Signatures are few beside conversations. The distinct ones are sorted by ranges, and a task inserts its sorted
run into a prefix trie that it keeps as one path: of each signature only the symbols beyond the prefix shared
with the one before get new layers, and the answer is read at the terminal node. A layer has for each state
of the role pattern the least cost and its place in the order of the audits; layers are kept relative to
their least cost, of which there are few, so a step is made once for each layer and symbol, and a node of the
path is two small numbers. Texts are shuffled once: each conversation's answer goes ahead of its rows, and
the repaired text is hashed row by row as it is read, so that no conversation is held whole. What a
conversation needs in memory is one byte a row, its audit, which is a cell of the result.

Nulls: role and text count as one space; null turns come first and count in no gap; a null conversation id is a
conversation. Empty texts are blank. A conversation without rows has zeros, an empty audit and the hash of
the empty text; an empty table has no rows. Columns other than the four are left alone.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from itertools import takewhile

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shroud.llm.scratch import write_table

SPACES = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)
REROLE, DELETE, INSERT, BROKEN = 2, 3, 2, 1
#: The role that follows each state, and the state it leads to.
FOLLOWS = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
NAMES = {USER: "user", ASSISTANT: "assistant"}


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone): ``rows`` with faults dealt by the checksum of conversation and turn.

    Of twenty rows one is dropped (``gone``), one emptied, one loses its ``.!?``, one is repeated, one becomes the user's.
    """
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(named("conv_id"), F.lit(":"), named("turn")).cast("binary")) % 20
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate(named("text"), ".!?", "")).otherwise(named("text"))
    copies = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    rows = rows.select("conv_id", "turn", "role", "text", fault.alias("fault"))
    return rows.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(named("role")).alias("role"), text.alias("text"), (F.col("fault") == 0).alias("gone"), copies.alias("copy")).drop("copy")


class Layers:
    """The steps between layers, each made once. A layer is a tuple of (cost above its least, place of its audit) or None by state."""

    def __init__(self) -> None:
        self.known: list[tuple] = []
        self.number: dict[tuple, int] = {}
        self.steps: dict[tuple[int, str], tuple[int, int, tuple]] = {}
        self.edges = {s: self._edges(s) for s in "DsuaxSUAX"}
        self.first = self._id(((0, 0), None, None, None))

    def _id(self, layer: tuple) -> int:
        if layer not in self.number:
            self.number[layer] = len(self.known)
            self.known.append(layer)
        return self.number[layer]

    @staticmethod
    def _edges(symbol: str) -> list[tuple[int, int, int, str]]:
        """(from, to, cost, audit) of a row, with the inserts before it."""
        best: dict[tuple[int, int], tuple[int, str]] = {}
        for start in range(4):
            state, audit, paid, seen = start, "", 0, set()
            while state not in seen:
                seen.add(state)
                moves = [(state, paid + DELETE, audit + "D")]
                if symbol != "D":
                    broken = BROKEN * symbol.isupper()
                    moves.append((FOLLOWS[state], paid + REROLE + broken, audit + "R"))
                    kept = {"s": SYSTEM, "u": USER, "a": ASSISTANT}.get(symbol.lower())
                    if kept == FOLLOWS[state] or (kept == SYSTEM and state == START):
                        moves.append((kept, paid + broken, audit + "K"))
                for to, cost, edits in moves:
                    best[start, to] = min(best.get((start, to), (cost, edits)), (cost, edits))
                state, audit, paid = FOLLOWS[state], audit + "I", paid + INSERT
        return [(a, b, cost, edits) for (a, b), (cost, edits) in best.items()]

    def step(self, layer: int, symbol: str) -> tuple[int, int, tuple]:
        """The next layer, what its least cost adds, and for each state where it came from and by which edits.

        Audits of two states that end in an edit of the same row differ before either ends, so an audit's
        place among the states decides between equal costs, whatever follows.
        """
        if (layer, symbol) not in self.steps:
            now, found = self.known[layer], [None] * 4
            for start, to, cost, edits in self.edges[symbol]:
                if now[start]:
                    way = (now[start][0] + cost, now[start][1], edits, start)
                    found[to] = way if found[to] is None else min(found[to], way)
            least = min(w[0] for w in found if w)
            order = {w[1:3]: n for n, w in enumerate(sorted((w for w in found if w), key=lambda w: w[1:3]))}
            after = self._id(tuple(w and (w[0] - least, order[w[1:3]]) for w in found))
            self.steps[layer, symbol] = after, least, tuple(w and (w[3], w[2]) for w in found)
        return self.steps[layer, symbol]

    def end(self, layer: int) -> tuple[int, str, int]:
        """(cost above the layer's least, last edits, state) of the best end."""
        ends = {START: "", ASSISTANT: "", USER: "I", SYSTEM: "II"}
        cost, _, edits, state = min((w[0] + INSERT * len(ends[s]), w[1], ends[s], s) for s, w in enumerate(self.known[layer]) if w)
        return cost, edits, state


class Trie:
    """The path of the last signature inserted: layer and cost of each node. Signatures come sorted."""

    def __init__(self) -> None:
        self.layers, self.last = Layers(), ""
        self.path, self.costs = array("l", [self.layers.first]), array("q", [0])
        self.made = 0

    def insert(self, signature: str) -> tuple[int, str]:
        """The least cost and its audit."""
        shared = sum(1 for _ in takewhile(lambda p: p[0] == p[1], zip(self.last, signature, strict=False)))
        del self.path[shared + 1 :], self.costs[shared + 1 :]
        for symbol in signature[shared:]:
            after, more, _ = self.layers.step(self.path[-1], symbol)
            self.path.append(after)
            self.costs.append(self.costs[-1] + more)
            self.made += 1
        self.last = signature
        cost, edits, state = self.layers.end(self.path[-1])
        audit = [edits]
        for k in range(len(signature) - 1, -1, -1):
            state, edits = self.layers.step(self.path[k], signature[k])[2][state]
            audit.append(edits)
        return self.costs[-1] + cost, "".join(reversed(audit))


def _identity() -> Column:
    return F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)


def _whole(rows: DataFrame) -> DataFrame:
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    gone = F.coalesce(F.col("gone"), F.lit(False)) if "gone" in rows.columns else F.lit(False)
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), named("role"), named("text"), gone.alias("gone"))
    return rows.withColumn("same", F.when(~F.col("gone"), _identity()))


def _changes(ids: pa.Array) -> np.ndarray:
    """Where another conversation begins, but for the first row."""
    a, b = ids.slice(1), ids.slice(0, len(ids) - 1)
    differ = pc.fill_null(pc.not_equal(a, b), False)
    return np.flatnonzero(pc.or_(differ, pc.not_equal(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)) + 1


FACTS = ("gaps", "blank", "duplicate", "truncated", "illegal")
LEGAL = {"su", "ua", "au"}


def signatures(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, signature) of every conversation; rows that are ``gone`` only name theirs."""
    trimmed = F.rtrim("text", F.lit(SPACES))
    narrow = _whole(rows).select("conv_id", "turn", "same", "gone", F.substring("role", 1, 1).alias("initial"), (trimmed == "").alias("blank"), (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("broken"))
    nth = F.row_number().over(Window.partitionBy("conv_id", "same").orderBy(F.col("turn").asc_nulls_first()))
    fault = F.when(F.col("gone"), None).when(F.col("blank"), 1).when(F.col("nth") > 1, 2).when(F.col("broken"), 3).otherwise(0)
    numbered = narrow.repartition("conv_id").withColumn("nth", nth).withColumn("fault", fault)
    dealt = numbered.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "same", "nth")
    kind = rows.schema["conv_id"].dataType.simpleString()
    symbols = {(r, f): "D" if f in (1, 2) else (r if r in ("s", "u", "a") else "x").upper() if f == 3 else r if r in ("s", "u", "a") else "x" for r in ("s", "u", "a", "x") for f in range(4)}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: dict | None = None

        def fresh(conv) -> dict:
            return {"conv": conv, "parts": [], "faults": [0, 0, 0, 0], "illegal": 0, "last": None, "turns": 0, "least": None, "turn": None}

        def add(x: dict, initials: list, faults: list, turns: list) -> None:
            there = [(i, f, t) for i, f, t in zip(initials, faults, turns, strict=True) if f is not None]
            x["parts"].append("".join(symbols[i if i in ("s", "u", "a") else "x", f] for i, f, _ in there))
            for i, f, t in there:
                x["faults"][f] += 1
                if x["last"] is not None and x["last"] + i not in LEGAL:
                    x["illegal"] += 1
                x["last"] = i
                if t is not None and t != x["turn"]:
                    x["turns"] += 1
                    x["least"], x["turn"] = t if x["least"] is None else x["least"], t

        def answers(done: list[dict]) -> pa.RecordBatch:
            gaps = [x["turn"] - x["least"] + 1 - x["turns"] if x["turns"] else 0 for x in done]
            faults = [[x["faults"][f] for x in done] for f in (1, 2, 3)]
            columns = [pa.array([x["conv"] for x in done], convs), *(pa.array(c, pa.int64()) for c in (gaps, *faults, [x["illegal"] for x in done])), pa.array(["".join(x["parts"]) for x in done])]
            return pa.RecordBatch.from_arrays(columns, ["conv_id", *FACTS, "signature"])

        convs = None
        for batch in batches:
            if not batch.num_rows:
                continue
            convs, done = batch["conv_id"].type, []
            initials, faults, turns = (batch[c].to_pylist() for c in ("initial", "fault", "turn"))
            bounds = [0, *_changes(batch["conv_id"]).tolist(), batch.num_rows]
            for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                conv = batch["conv_id"][a].as_py()
                if now is None or k or conv != now["conv"]:
                    done += [now] if now else []
                    now = fresh(conv)
                add(now, initials[a:b], faults[a:b], turns[a:b])
            if done:
                yield answers(done)
        if now:
            yield answers([now])

    columns = dealt.select("conv_id", "turn", "initial", "fault")
    return columns.mapInArrow(read, f"conv_id {kind}, {', '.join(f'{c} long' for c in FACTS)}, signature string")


def solve(found: DataFrame) -> DataFrame:
    """(signature, cost, audit) of the distinct signatures of ``found``."""

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie = Trie()
        for frame in frames:
            answers = [trie.insert(s) for s in frame["signature"]]
            yield pd.DataFrame({"signature": frame["signature"], "cost": [c for c, _ in answers], "audit": [a for _, a in answers]})

    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = found.groupBy("signature").agg(F.count(F.lit(1)).alias("n"))
    dealt = distinct.repartitionByRange(parts, F.substring("signature", 1, 256)).sortWithinPartitions("signature")
    return dealt.select("signature").mapInPandas(walk, "signature string, cost long, audit string")


def repair(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation of ``rows``.

    ``rows``: (conv_id, turn, role, text) and, if some conversations have rows that are not there, ``gone``.
    """
    found = write_table(signatures(rows), "signatures")
    answers = found.join(write_table(solve(found), "audits"), "signature").drop("signature")
    texts = _whole(rows).where("not gone").select("conv_id", F.lit(1).alias("kind"), "turn", "same", "role", "text")
    both = answers.withColumn("kind", F.lit(0)).unionByName(texts, allowMissingColumns=True)
    dealt = both.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "kind", F.col("turn").asc_nulls_first(), "same").drop("turn", "same")
    kind = rows.schema["conv_id"].dataType.simpleString()
    returned = ["conv_id", *FACTS, "cost", "audit"]

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, digest, audit, at, state, empty = None, None, "", 0, START, True

        def line(role: str, text: str) -> None:
            nonlocal empty
            digest.update(("" if empty else "\n").encode() + f"{role}:{text}".encode())
            empty = False

        def inserts() -> None:
            nonlocal at, state
            while at < len(audit) and audit[at] == "I":
                state, at = FOLLOWS[state], at + 1
                line(NAMES[state], "")

        for batch in batches:
            kinds, roles, texts = (batch[c].to_pylist() for c in ("kind", "role", "text"))
            done = []
            for n, (row, role, text) in enumerate(zip(kinds, roles, texts, strict=True)):
                if row == 0:
                    if head is not None:
                        inserts()
                        done.append((head, digest.hexdigest()))
                    head = batch.select(returned).slice(n, 1)
                    digest, audit, at, state, empty = hashlib.sha256(), head["audit"][0].as_py(), 0, START, True
                    continue
                inserts()
                edit, at = audit[at], at + 1
                if edit == "K":
                    state = SYSTEM if state == START and role[:1] == "s" else FOLLOWS[state]
                    line(role, text)
                elif edit == "R":
                    state = FOLLOWS[state]
                    line(NAMES[state], text)
            if done:
                yield _answers(done)
        if head is not None:
            inserts()
            yield _answers([(head, digest.hexdigest())])

    def _answers(done: list) -> pa.RecordBatch:
        table = pa.Table.from_batches([h for h, _ in done]).combine_chunks()
        return table.append_column("repaired_sha256", pa.array([d for _, d in done])).to_batches()[0]

    columns = dealt.select(*returned, "kind", "role", "text")
    return columns.mapInArrow(rebuild, f"conv_id {kind}, {', '.join(f'{c} long' for c in (*FACTS, 'cost'))}, audit string, repaired_sha256 string")
