"""Conversation repair: the cheapest edits that let roles alternate, found by bidirectional Dijkstra over the edit lattice.

A lattice node is a number of rows read and a state of the role pattern ``(s?(ua)+)?``. Rows are dealt by ranges of conversation and
turn and cut into blocks, so that a conversation of any length is spread over tasks: a conversation inside one block is searched
from end to end; of a longer one each block gives the cheapest edits between any two states, and the blocks are chained.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.llm.common import cut, partitions

#: Rows of a block of a long conversation.
BLOCK = 512
# States of the pattern (start, after s, after u, after a), its steps, its ends, and what edits cost.
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ENDS = (0, 3)
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
ROLES = {2: "user", 3: "assistant"}
BLANK, DUPLICATE, CUT_OFF = "blank", "duplicate", "truncated"
# What the query's damage does, by crc32 of `conv_id:turn` modulo 20.
DROP, EMPTY, UNPUNCTUATED, REPEAT, AS_USER = range(5)

Row = tuple[str, str | None]  # a role's initial and the row's fault
Label = tuple[int, str]  # cost and edits
_FORWARD = {s: {i: t for (a, i), t in STEPS.items() if a == s} for s in range(4)}
_SPOKEN = [(s, t) for (s, i), t in STEPS.items() if i in "ua"]


def _arcs(rows: Sequence[Row], i: int, state: int) -> Iterator[tuple[int, int, int, str]]:
    """(rows read, state, cost, edit) of every edit that leaves a node."""
    for a, t in _SPOKEN:
        if a == state:
            yield i, t, INSERT, "I"
    if i < len(rows):
        yield from ((i + 1, t, cost, edit) for s, t, cost, edit in _row_arcs(rows[i]) if s == state)


def _arcs_back(rows: Sequence[Row], i: int, state: int) -> Iterator[tuple[int, int, int, str]]:
    """(rows read, state, cost, edit) of every edit that enters a node, by where it comes from."""
    for s, t in _SPOKEN:
        if t == state:
            yield i, s, INSERT, "I"
    if i:
        yield from ((i - 1, s, cost, edit) for s, t, cost, edit in _row_arcs(rows[i - 1]) if t == state)


def _row_arcs(row: Row) -> list[tuple[int, int, int, str]]:
    """(state before, state after, cost, edit) of all that may be done to a row."""
    initial, fault = row
    arcs = [(s, s, DELETE, "D") for s in range(4)]
    if fault not in (BLANK, DUPLICATE):
        more = TRUNCATED if fault == CUT_OFF else 0
        arcs += [(s, t, more, "K") for (s, x), t in STEPS.items() if x == initial]
        arcs += [(s, t, REROLE + more, "R") for s, t in _SPOKEN]
    return arcs


def cheapest(rows: Sequence[Row], start: int = 0, ends: Sequence[int] = ENDS) -> Label | None:
    """Least cost and, of the edits that have it, the ASCII-least, from a state before all rows to one of ``ends`` after them.

    Two heaps grow from both ends. A path that is not worse than the best known crossing is crossed before the sum of the heaps' least
    costs is above that crossing, so all crossings of equal cost are found before one is picked. Paths of one cost between the same
    two nodes hold as many inserts, so none of their audits starts another, and least halves make a least whole.
    """
    n = len(rows)
    ahead: dict[tuple[int, int], Label] = {(0, start): (0, "")}
    back: dict[tuple[int, int], Label] = {(n, t): (0, "") for t in ends}
    heaps = [[(0, 0, start)], [(0, 0, t) for t in ends]]
    settled: tuple[set, set] = (set(), set())
    best = min((ahead[v][0] + back[v][0] for v in ahead.keys() & back.keys()), default=None)
    while heaps[0] and heaps[1]:
        if best is not None and heaps[0][0][0] + heaps[1][0][0] > best:
            break
        side = 0 if heaps[0][0][0] <= heaps[1][0][0] else 1
        own, other = (ahead, back) if side == 0 else (back, ahead)
        cost, place, state = heapq.heappop(heaps[side])
        at = (place if side == 0 else n - place, state)  # of equal costs the node that others may reach for nothing comes first
        if at in settled[side] or own[at][0] < cost:
            continue
        settled[side].add(at)
        audit = own[at][1]
        for i, t, step, edit in (_arcs if side == 0 else _arcs_back)(rows, *at):
            to, label = (i, t), (cost + step, audit + edit if side == 0 else edit + audit)
            if to not in own or label < own[to]:
                if to not in own or label[0] < own[to][0]:
                    heapq.heappush(heaps[side], (label[0], i if side == 0 else n - i, t))
                own[to] = label
                if to in other and (best is None or label[0] + other[to][0] < best):
                    best = label[0] + other[to][0]
    if best is None:
        return None
    return best, min(label[1] + back[v][1] for v, label in ahead.items() if v in back and label[0] + back[v][0] == best)


def repaired(rows: Sequence[tuple[str, str]], audit: str, state: int = 0) -> tuple[list[str], int]:
    """The lines ``role:text`` that the edits leave of rows of (role, text), and the state after them."""
    lines, at = [], 0
    for edit in audit:
        role, text = ("", "") if edit == "I" else rows[at]
        at += edit != "I"
        if edit == "D":
            continue
        state = STEPS[state, role[:1]] if edit == "K" else 3 if state == 2 else 2
        lines.append(f"{role if edit == 'K' else ROLES[state]}:{text}")
    return lines, state


def damaged(rows: DataFrame, kind: Column | None) -> DataFrame:
    """(conv_id, turn, role, text, copies) of every row of (conv_id, turn, role, text); null roles and texts are one space.

    ``kind`` names each row's damage; a dropped row stays with no copies, so that its conversation is still known.
    """
    kind = F.lit(-1) if kind is None else kind
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    return rows.withColumn("_kind", kind).select(
        "conv_id", "turn", F.when(F.col("_kind") == AS_USER, "user").otherwise(role).alias("role"),
        F.when(F.col("_kind").isin(DROP, EMPTY), "").when(F.col("_kind") == UNPUNCTUATED, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(F.col("_kind") == DROP, 0).when(F.col("_kind") == REPEAT, 2).otherwise(1).alias("copies"))


def _with_faults(rows: DataFrame) -> DataFrame:
    """Adds ``fault``: what each row suffers from, apart from copies that stand next to each other in one turn.

    Of a text that comes again in its conversation only the count and the least turn are kept, so this small side moves, not the texts.
    """
    said = F.unhex(F.sha2("text", 256))
    rows = rows.withColumn("_said", said)
    order = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    again = (rows.filter("copies > 0").groupBy(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("_said").alias("_s"))
             .agg(F.sum("copies").alias("_n"), F.min(order).alias("_first")).filter("_n > 1").select("_c", "_r", "_s", "_first"))
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("_said") == F.col("_s"))
    bare = F.regexp_replace("text", r"[\x20\x09-\x0D]+$", "")
    fault = (F.when(bare == "", BLANK).when(F.col("_first").isNotNull() & (order > F.col("_first")), DUPLICATE)
             .when(~F.substring(bare, -1, 1).isin(".", "!", "?"), CUT_OFF))
    return rows.join(again, same, "left").select("conv_id", "turn", "role", "text", "copies", fault.alias("fault"))


class _Run:
    """Rows of one conversation that stand together in a task, or the next block of them, with what is known of them."""

    def __init__(self, conv: object, number: int) -> None:
        self.conv, self.number = conv, number
        self.rows: list[tuple[str, str]] = []
        self.faults: list[str | None] = []
        self.turns: list[int] = []  # first and last turn and the number of different ones

    def add(self, turn: int | None, role: str, text: str, fault: str | None) -> None:
        self.rows.append((role, text))
        self.faults.append(fault)
        if turn is not None:
            self.turns = [self.turns[0], turn, self.turns[2] + (turn != self.turns[1])] if self.turns else [turn, turn, 1]

    def initials(self) -> list[Row]:
        return [(role[:1], fault) for (role, _), fault in zip(self.rows, self.faults, strict=True)]

    def illegal(self) -> int:
        return sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(self.rows, self.rows[1:], strict=False))

    def record(self, part: int, whole: bool) -> dict:
        """A finished conversation if ``whole``, else a block with the cheapest edits between all states."""
        out = {"conv_id": self.conv, "part": part, "number": self.number, "whole": whole, "illegal": self.illegal(),
               **{kind: self.faults.count(kind) for kind in (BLANK, DUPLICATE, CUT_OFF)}, "turns": self.turns}
        if whole:
            out["gaps"] = self.turns[1] - self.turns[0] + 1 - self.turns[2] if self.turns else 0
            out["cost"], out["audit"] = cheapest(self.initials())
            out["repaired_sha256"] = hashlib.sha256("\n".join(repaired(self.rows, out["audit"])[0]).encode()).hexdigest()
            return out
        found = [(s, t, cheapest(self.initials(), s, (t,))) for s in range(4) for t in range(4)]
        out["ways"] = [{"a": s, "b": t, "cost": x[0], "audit": x[1]} for s, t, x in found if x is not None]
        out["roles"], out["texts"] = [r for r, _ in self.rows], [t for _, t in self.rows]
        return out


def _batch(records: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(records, schema)


def _blocks(schema: pa.Schema, block: int):
    """Tasks that read rows in order and give conversations that lie inside the task as a whole, others block by block."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out = TaskContext.get().partitionId(), []
        run: _Run | None = None
        first, last = True, None  # the task's first conversation may have begun in an earlier one
        for batch in batches:
            for conv, turn, role, text, copies, fault in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if run is None or conv != run.conv:
                    if run is not None:
                        out.append(run.record(part, not first and not run.number))
                        first = False
                    run, last = _Run(conv, 0), None
                for _ in range(copies):
                    if len(run.rows) == block:
                        out.append(run.record(part, False))
                        run = _Run(conv, run.number + 1)
                    run.add(turn, role, text, DUPLICATE if fault != BLANK and (turn, role, text) == last else fault)
                    last = (turn, role, text)
                if sum(map(len, (r.get("texts") or () for r in out))) > 4 * block or len(out) >= 1000:
                    yield _batch(out, schema)
                    out = []
        if run is not None:
            out.append(run.record(part, False))  # may go on in the next task
        if out:
            yield _batch(out, schema)

    return task


def _chained(schema: pa.Schema):
    """Tasks that read the blocks of conversations in order and give each conversation's sums, cost, audit and state before each block."""

    def closed(state: dict) -> dict:
        labels = {s: x for s, x in state["labels"].items() if s in ENDS}
        cost, audit, path = min(labels.values())
        turns = state["turns"]
        return {**state["out"], "gaps": turns[1] - turns[0] + 1 - turns[2] if turns else 0, "cost": cost, "audit": "".join(audit), "states": list(path)}

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: dict | None = None
        for batch in batches:
            for r in batch.to_pylist():
                if now is None or r["conv_id"] != now["out"]["conv_id"]:
                    if now is not None:
                        yield _batch([closed(now)], schema)
                    now = {"out": {"conv_id": r["conv_id"], BLANK: 0, DUPLICATE: 0, CUT_OFF: 0, "illegal": 0}, "turns": [], "role": None,
                           "labels": {0: (0, (), ())}}
                if r["n_rows"]:
                    if now["role"] is not None and now["role"] + r["first_role"] not in ("su", "ua", "au"):
                        now["out"]["illegal"] += 1
                    now["role"] = r["last_role"]
                for kind in (BLANK, DUPLICATE, CUT_OFF, "illegal"):
                    now["out"][kind] += r[kind]
                if r["turns"]:
                    a, b = now["turns"], r["turns"]
                    now["turns"] = [a[0], b[1], a[2] + b[2] - (a[1] == b[0])] if a else b
                ways: dict[int, tuple] = {}
                for w in r["ways"]:
                    if w["a"] in now["labels"]:
                        cost, audit, path = now["labels"][w["a"]]
                        label = (cost + w["cost"], (*audit, w["audit"]), (*path, w["a"]))
                        held = ways.get(w["b"])
                        if held is None or (label[0], "".join(label[1])) < (held[0], "".join(held[1])):
                            ways[w["b"]] = label
                now["labels"] = ways
        if now is not None:
            yield _batch([closed(now)], schema)

    return task


def _hashed(schema: pa.Schema):
    """Tasks that read the chosen edits of each block in order and hash what they leave; a text is held no longer than its block."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest, some = None, None, False
        for batch in batches:
            for r in batch.to_pylist():
                if digest is None or r["conv_id"] != conv:
                    if digest is not None:
                        yield _batch([{"conv_id": conv, "repaired_sha256": digest.hexdigest()}], schema)
                    conv, digest, some = r["conv_id"], hashlib.sha256(), False
                for line in repaired(list(zip(r["roles"], r["texts"], strict=True)), r["audit"], r["state"])[0]:
                    digest.update(("\n" * some + line).encode())
                    some = True
        if digest is not None:
            yield _batch([{"conv_id": conv, "repaired_sha256": digest.hexdigest()}], schema)

    return task


def repair(rows: DataFrame, kind: Callable[[], Column] | None = None, block: int = BLOCK) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation.

    Rows of (conv_id, turn, role, text) are taken by turn, nulls first, and in one turn by role and text; other columns are ignored.
    Rows with a null id are one conversation. Null roles and texts are one space, so such a row is blank or has no initial
    that fits. Rows that are repeated count as duplicates. A conversation all of whose rows were dropped has zeros, no edits and the
    hash of an empty text; an empty table gives an empty table. Texts of any length are read whole and held one block at a time.
    A conversation that a task holds in part, or of more than ``block`` rows, goes through blocks; only the hash of its repaired text,
    which can't be taken in parts, is computed by one task, as a stream.
    """
    id_type, turn_type = (dict(rows.dtypes)[c] for c in ("conv_id", "turn"))
    known = _with_faults(damaged(rows, kind() if kind else None))
    # ranges are sampled first: a written table keeps that from doing the work twice
    dealt = (cut(known).repartitionByRange(partitions(rows.sparkSession), F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text")
             .sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text"))
    numbers = ", ".join(f"{c} long" for c in ("gaps", BLANK, DUPLICATE, CUT_OFF, "illegal", "cost"))
    spec = (f"conv_id {id_type}, part int, number int, whole boolean, {numbers}, audit string, repaired_sha256 string, turns array<{turn_type}>, "
            f"ways array<struct<a: int, b: int, cost: long, audit: string>>, roles array<string>, texts array<string>")
    found = cut(dealt.mapInArrow(_blocks(_arrow(rows, spec), block), spec))
    result = ["conv_id", "gaps", BLANK, DUPLICATE, CUT_OFF, "illegal", "cost", "audit", "repaired_sha256"]
    blocks = found.filter("not whole")
    size = F.size("roles").alias("n_rows")
    small = blocks.select("conv_id", "part", "number", BLANK, DUPLICATE, CUT_OFF, "illegal", "turns", "ways", size,
                          F.substring(F.try_element_at("roles", F.lit(1)), 1, 1).alias("first_role"),
                          F.substring(F.try_element_at("roles", F.lit(-1)), 1, 1).alias("last_role"))
    n = partitions(rows.sparkSession)
    in_order = small.repartition(n, "conv_id").sortWithinPartitions("conv_id", "part", "number")
    chain = f"conv_id {id_type}, {numbers}, audit string, states array<int>"
    chained = cut(in_order.mapInArrow(_chained(_arrow(rows, chain)), chain))
    place = Window.partitionBy("conv_id").orderBy("part", "number")
    steps = chained.select(F.col("conv_id").alias("_c"), F.posexplode("states").alias("_at", "state"))
    # an edit list per block again: the state before it and the one before the next (or any end) name the way that was taken
    after = F.lead("state").over(Window.partitionBy("_c").orderBy("_at"))
    steps = steps.withColumn("after", after)
    numbered = blocks.select("conv_id", "part", "number").withColumn("_at", F.row_number().over(place) - 1)
    chosen = numbered.join(steps, numbered["conv_id"].eqNullSafe(steps["_c"]) & (numbered["_at"] == steps["_at"])).select(
        F.col("_c"), F.col("part").alias("_part"), F.col("number").alias("_number"), "state", "after")
    way = F.filter("ways", lambda w: (w["a"] == F.col("state")) & F.when(F.col("after").isNull(), w["b"].isin(*ENDS)).otherwise(w["b"] == F.col("after")))
    least = F.array_min(F.transform(way, lambda w: F.struct(w["cost"].alias("cost"), w["audit"].alias("audit"))))["audit"]
    pieces = (blocks.join(chosen, blocks["conv_id"].eqNullSafe(F.col("_c")) & (F.col("part") == F.col("_part")) & (F.col("number") == F.col("_number")))
              .select("conv_id", "part", "number", "state", least.alias("audit"), "roles", "texts"))
    digest = f"conv_id {id_type}, repaired_sha256 string"
    hashed = (pieces.repartition(n, "conv_id").sortWithinPartitions("conv_id", "part", "number")
              .mapInArrow(_hashed(_arrow(rows, digest)), digest).withColumnRenamed("conv_id", "_c"))
    long = chained.join(hashed, F.col("conv_id").eqNullSafe(F.col("_c"))).select(*result)
    return found.filter("whole").select(*result).union(long)


def _arrow(rows: DataFrame, spec: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(spec))


def damage_kind() -> Column:
    """The query's damage of a row: crc32 of ``conv_id:turn``, nulls as one space, modulo 20."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    return F.crc32(key.cast("binary")) % 20
