"""Conversation structure repair: generalised LR parsing of role sequences with weighted edits.

Grammar of a conversation's role initials: ``D -> . | T | s T``, ``T -> T P | P``, ``P -> u a``. The
turns of a conversation, by turn (nulls first), role and text, are read by an LR automaton whose stacks
share their tails (graph-structured stack). For each turn every stack top is

* kept (cost 0) if its initial can be shifted; a truncated turn that stays costs ``TRUNCATED`` more,
* reroled to ``user`` or ``assistant`` (``REROLE``),
* deleted (``DELETE``; blank and duplicate turns must be),

after any inserted empty ``user`` or ``assistant`` turns (``INSERT`` each). Stacks with equal tops are
merged to the one with the smallest (cost, audit); the audit is the string of the edits' initials
K, R, D, I, ties go to the one that is smaller in ASCII. Audits are not compared as strings: all tops of a
position hold the same number of turns, so none is a prefix of another, and the order of the new ones
follows from the ranks of the old ones and the letters appended.

Faults, the first that fits: ``blank`` (no character but white space), ``duplicate`` (role and text
seen earlier in the conversation), ``truncated`` (the last character but white space is not one of
``.!?``).

Scale: turns are range-partitioned by (conversation, turn, role, text, a row number), sorted and
checkpointed, so a conversation with a third of all turns covers many partitions. Conversations inside a
partition are repaired in one streaming pass. Of the others (two a partition at most) every
partition's part is one segment: its best edits from each stack top to each other one are found in
parallel, folded along the segments (an associative minimum over a few letters a turn) and applied
to the segments in parallel. What stays in order is the digest of a conversation, streamed: SHA-256
allows no other way; it holds the audit (a letter a turn, as the result does) and no texts.

Results: null roles and texts are read as one space, which is no role and blank. A null conversation is
one of its own. An empty role has no initial and cannot be kept. Turns equal in all columns are in
any order, which gives the same rows. Extra columns are not read. No rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordered import PID, range_checkpoint
from .common import HAS_WORD, SPACES, partitions, reliable_checkpoint

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
ROLES = {"u": "user", "a": "assistant"}

# The LR automaton of the grammar above. States: 0 start, 2 after s, 4 after u,
# 7 after u a, 3 and 6 after a pair, 1 and 5 after pairs.
SHIFT = {(0, "s"): 2, (0, "u"): 4, (1, "u"): 4, (2, "u"): 4, (5, "u"): 4, (4, "a"): 7}
REDUCE = {7: ("P", 2), 3: ("T", 1), 6: ("T", 2)}
GOTO = {(0, "P"): 3, (0, "T"): 1, (1, "P"): 6, (2, "P"): 3, (2, "T"): 5, (5, "P"): 6}
ACCEPT = (0, 1, 5)
# A stack for each top that is left when all reductions are done; what may follow depends on the top alone.
STACKS = ((0, None), (2, (0, None)), (4, (0, None)), (1, (0, None)), (5, (2, (0, None))))
TOPS = tuple(s[0] for s in STACKS)
INDEX = {top: i for i, top in enumerate(TOPS)}
KEEP, RE, DROP = 0, 1, 2
LETTER = "KRD"


def push(stack: tuple, symbol: str) -> tuple | None:
    """The stack (state, stack below) after shifting ``symbol`` and all reductions; None if it cannot."""
    state = SHIFT.get((stack[0], symbol))
    if state is None:
        return None
    stack = (state, stack)
    while stack[0] in REDUCE:
        left, n = REDUCE[stack[0]]
        for _ in range(n):
            stack = stack[1]
        stack = (GOTO[stack[0], left], stack)
    return stack


def inserted(stack: tuple) -> list[tuple]:
    """The stack itself and those after inserted turns, until a top would come again (a loop only costs)."""
    out, seen = [stack], {stack[0]}
    while True:
        after = push(out[-1], "u") or push(out[-1], "a")
        if after[0] in seen or (after[0] in ACCEPT and seen & {1, 5}):
            return out
        seen.add(after[0])
        out.append(after)


def symbol_of(stack: tuple) -> str:
    """The initial that an inserted or reroled turn takes on this stack."""
    return "u" if (stack[0], "u") in SHIFT else "a"


class Repair:
    """Best edits of the turns fed so far, from one stack to every stack top."""

    def __init__(self, start: tuple = STACKS[0]):
        self.tops = {start[0]: (0, 0, start)}  # top -> (cost, rank of the audit, stack)
        self.trail = bytearray()  # for each turn and top: former top, inserts, action

    def feed(self, initial: str, must_delete: bool, truncated: bool) -> None:
        best: dict[int, tuple] = {}
        extra = TRUNCATED if truncated else 0

        def offer(stack, cost, rank, n, action, former):
            # audit order: rank of the old audit, then the letters appended
            key = (cost, rank, "I" * n + LETTER[action])
            now = best.get(stack[0])
            if now is None or key < now[0]:
                best[stack[0]] = (key, stack, INDEX[former] * 16 + n * 4 + action)

        for top, (cost, rank, stack) in self.tops.items():
            for n, at in enumerate(inserted(stack)):
                c = cost + n * INSERT
                offer(at, c + DELETE, rank, n, DROP, top)
                if must_delete:
                    continue
                kept = push(at, initial)
                if kept is not None:
                    offer(kept, c + extra, rank, n, KEEP, top)
                offer(push(at, symbol_of(at)), c + REROLE + extra, rank, n, RE, top)
        order = {k: i for i, k in enumerate(sorted({key[1:] for key, *_ in best.values()}))}
        self.tops = {top: (key[0], order[key[1:]], stack) for top, (key, stack, _) in best.items()}
        self.trail += bytes(best[top][2] if top in best else 255 for top in TOPS)

    def audit(self, top: int) -> str:
        """The audit that ends in ``top``."""
        parts, at, width = [], INDEX[top], len(TOPS)
        for i in range(len(self.trail) // width - 1, -1, -1):
            code = self.trail[i * width + at]
            parts.append("I" * (code // 4 % 4) + LETTER[code % 4])
            at = code // 16
        return "".join(reversed(parts))

    def finish(self) -> tuple[int, str]:
        """(cost, audit) of the cheapest whole conversation."""
        cost, _, after, top = ending((c, rank, stack) for c, rank, stack in self.tops.values())
        return cost, self.audit(top) + after


def ending(tops) -> tuple[int, int, str, int]:
    """(cost, rank, inserts, top) of the best way to an accepting state."""
    ends = []
    for cost, rank, stack in tops:
        for n, at in enumerate(inserted(stack)):
            if at[0] in ACCEPT:
                ends.append((cost + n * INSERT, rank, "I" * n, stack[0]))
                break
    return min(ends)


def edits(start: tuple, turns: list[tuple], audit: str) -> Iterator[tuple]:
    """(turn index, step, action, new role) of every letter of ``audit`` from the stack ``start``; inserts
    come before the next turn, or after the last one. ``turns`` are (role, ...)."""
    stack, i, step = start, 0, 0
    for letter in audit:
        if letter == "I":
            symbol = symbol_of(stack)
            stack = push(stack, symbol)
            yield min(i, len(turns) - 1), step + (i == len(turns)), letter, ROLES[symbol]
            step += 1
            continue
        role = None
        if letter == "K":
            role = turns[i][0]
            stack = push(stack, role[:1])
        elif letter == "R":
            symbol = symbol_of(stack)
            role, stack = ROLES[symbol], push(stack, symbol)
        yield i, step, letter, role
        last, i, step = step, i + 1, 0
        if i == len(turns):
            step = last


def _fault_free(fault: str | None) -> tuple[bool, bool]:
    return fault in ("blank", "duplicate"), fault == "truncated"


def _edit_rows(key, start: tuple, turns: list[tuple], audit: str) -> list[tuple]:
    """Rows of the edits table; ``turns`` are (role, text, fault, turn, pos)."""
    out = []
    for i, step, action, role in edits(start, turns, audit):
        was, text, fault, turn, pos = turns[i]
        cost = {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}[action]
        if action == "I":
            was, text, fault, turn = None, "", None, None
        elif action != "D" and fault == "truncated":
            cost += TRUNCATED
        out.append((key, pos, step, turn, was, action, role, text, fault, cost))
    return out


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def _edit_schema(key: pa.DataType, turn: pa.DataType) -> pa.Schema:
    return pa.schema([("conv", key), ("pos", pa.int64()), ("step", pa.int32()), ("turn", turn), ("was", pa.string()),
                      ("action", pa.string()), ("role", pa.string()), ("text", pa.string()), ("fault", pa.string()), ("cost", pa.int32())])


def _repair_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (conv, pos, turn, role, text, fault) of whole conversations -> the edits table. The texts of
    one conversation are held."""
    schema, key, first, out = None, None, True, []
    turns, seen, repair = [], set(), Repair()

    def close():
        if turns:
            out.extend(_edit_rows(key, STACKS[0], turns, repair.finish()[1]))

    for batch in batches:
        schema = schema or _edit_schema(batch.schema.field("conv").type, batch.schema.field("turn").type)
        for conv, pos, turn, role, text, fault in zip(*(batch.column(i).to_pylist() for i in range(6))):
            if first or conv != key:
                close()
                key, first, turns, seen, repair = conv, False, [], set(), Repair()
            same = hashlib.blake2b(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
            if fault != "blank" and same in seen:
                fault = "duplicate"
            seen.add(same)
            turns.append((role, text, fault, turn, pos))
            repair.feed(role[:1], *_fault_free(fault))
        if out:
            yield _batch(out, schema)
            out = []
    close()
    if out:
        yield _batch(out, schema)


def _segment(table: pa.Table) -> pa.Table:
    """Best edits of one segment: (conv, pid, first, start, finish, cost, audit)."""
    table = table.sort_by("pos")
    rows = list(zip(table.column("role").to_pylist(), table.column("fault").to_pylist()))
    conv, pid, out = table.column("conv")[0].as_py(), table.column("pid")[0].as_py(), []
    for stack in STACKS:
        repair = Repair(stack)
        for role, fault in rows:
            repair.feed(role[:1], *_fault_free(fault))
        for top, (cost, _, _) in repair.tops.items():
            out.append((conv, pid, stack[0], top, cost, repair.audit(top)))
    names = ["conv", "pid", "start", "finish", "cost", "audit"]
    types = [table.schema.field("conv").type, pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string()]
    return pa.table([pa.array(c, type=t) for c, t in zip(zip(*out), types)], names=names)


def _fold(table: pa.Table) -> pa.Table:
    """The segments of a conversation in order -> (conv, pid, start, audit) of the best whole repair."""
    ways: dict[int, dict[int, dict[int, tuple]]] = {}
    for r in table.select(["pid", "start", "finish", "cost", "audit"]).to_pylist():
        ways.setdefault(r["pid"], {}).setdefault(r["start"], {})[r["finish"]] = (r["cost"], r["audit"])
    tops, trail = {0: (0, 0)}, []
    for pid in sorted(ways):
        best: dict[int, tuple] = {}
        for top, (cost, rank) in tops.items():
            for finish, (more, audit) in ways[pid][top].items():
                key = (cost + more, rank, audit)
                if finish not in best or key < best[finish][0]:
                    best[finish] = (key, top)
        order = {k: i for i, k in enumerate(sorted({key[1:] for key, _ in best.values()}))}
        tops = {top: (key[0], order[key[1:]]) for top, (key, _) in best.items()}
        trail.append((pid, {top: (former, key[2]) for top, (key, former) in best.items()}))
    _, _, after, top = ending((cost, rank, STACKS[INDEX[t]]) for t, (cost, rank) in tops.items())
    out = []
    for pid, step in reversed(trail):
        former, audit = step[top]
        out.append((pid, former, audit + after))
        top, after = former, ""
    key = table.schema.field("conv").type
    return pa.table([pa.array([table.column("conv")[0].as_py()] * len(out), type=key), pa.array([x[0] for x in out], type=pa.int32()),
                     pa.array([x[1] for x in out], type=pa.int32()), pa.array([x[2] for x in out], type=pa.string())],
                    names=["conv", "pid", "start", "audit"])


def _apply(turns: pa.Table, chosen: pa.Table) -> pa.Table:
    """The edits table of one segment."""
    turns = turns.sort_by("pos")
    schema = _edit_schema(turns.schema.field("conv").type, turns.schema.field("turn").type)
    rows = list(zip(*(turns.column(c).to_pylist() for c in ("role", "text", "fault", "turn", "pos"))))
    way = chosen.to_pylist()[0]
    found = _edit_rows(turns.column("conv")[0].as_py(), STACKS[INDEX[way["start"]]], rows, way["audit"])
    return pa.Table.from_batches([_batch(found, schema)])


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted edits -> one row a conversation; no texts are held."""
    schema, key, first, out, now = None, None, True, [], None

    def close():
        if now is not None:
            turns = now["last"] - now["low"] + 1 - now["turns"] if now["turns"] else 0
            out.append((key, turns, now["blank"], now["duplicate"], now["truncated"], now["illegal"], now["cost"],
                        "".join(now["audit"]), now["sha"].hexdigest()))

    for batch in batches:
        schema = schema or pa.schema([("conv", batch.schema.field("conv").type)] + [
            (c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [
            ("audit", pa.string()), ("repaired_sha256", pa.string())])
        columns = ("conv", "turn", "was", "action", "role", "text", "fault", "cost")
        for conv, turn, was, action, role, text, fault, cost in zip(*(batch.column(c).to_pylist() for c in columns)):
            if first or conv != key:
                close()
                key, first = conv, False
                now = {"low": None, "last": None, "turns": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0,
                       "audit": [], "sha": hashlib.sha256(), "initial": None, "lines": 0}
            now["cost"] += cost
            now["audit"].append(action)
            if len(now["audit"]) > 4096:  # letters, not as many objects
                now["audit"] = ["".join(now["audit"])]
            if fault is not None:
                now[fault] += 1
            if was is not None:
                if now["initial"] is not None and now["initial"] + was[:1] not in ("su", "ua", "au"):
                    now["illegal"] += 1
                now["initial"] = was[:1]
                if turn is not None and turn != now["last"]:
                    now["low"] = turn if now["low"] is None else now["low"]
                    now["last"], now["turns"] = turn, now["turns"] + 1
            if role is not None:
                line = ("\n" if now["lines"] else "") + role + ":" + text
                now["sha"].update(line.encode("utf-8", "surrogatepass"))
                now["lines"] += 1
        if out:
            yield _batch(out, schema)
            out = []
    close()
    if out:
        yield _batch(out, schema)


def faults(role: Column, text: Column) -> Column:
    """``blank``, ``truncated`` or null of a turn by itself."""
    last = F.right(F.rtrim(text, F.lit(SPACES)), F.lit(1))
    return F.when(~text.rlike(HAS_WORD), "blank").when(~last.isin(".", "!", "?"), "truncated")


def repair_conversations(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                         num_partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(edits, summary) of the conversations of ``df``.

    ``edits``: (conv, pos, step, turn, was, action, role, text, fault, cost), a row for each turn (K, R or D;
    ``role`` is the new one, null if deleted, ``was`` the old one) and each inserted turn (I); ordered by
    (conv, pos, step). ``summary``: (conv, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256), a row for each conversation.
    """
    rows = df.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"),
                     F.coalesce(F.col(text), F.lit(" ")).alias("text")).withColumn("nr", F.monotonically_increasing_id())
    ranged = range_checkpoint(rows, ["conv"], ["turn", "role", "text", "nr"], num_partitions)
    ranged = ranged.withColumn("pos", F.monotonically_increasing_id()).withColumn("fault", faults(F.col("role"), F.col("text")))
    split = ranged.groupBy("conv").agg(F.min(PID).alias("low"), F.max(PID).alias("high")).filter("low < high")
    split = reliable_checkpoint(split.select(F.col("conv").alias("split_conv"), F.lit(True).alias("split")))
    # at most two for each partition; the broadcast join keeps the order of the turns
    marked = ranged.join(F.broadcast(split), F.col("conv").eqNullSafe(F.col("split_conv")), "left")
    columns = ["conv", "pos", "turn", "role", "text", "fault"]
    by_type = {f.name: f.dataType for f in ranged.schema.fields}
    edit_type = T.StructType([
        T.StructField("conv", by_type["conv"]), T.StructField("pos", T.LongType()), T.StructField("step", T.IntegerType()),
        T.StructField("turn", by_type["turn"]), T.StructField("was", T.StringType()), T.StructField("action", T.StringType()),
        T.StructField("role", T.StringType()), T.StructField("text", T.StringType()), T.StructField("fault", T.StringType()),
        T.StructField("cost", T.IntegerType())])
    summary_type = T.StructType([T.StructField("conv", by_type["conv"])] + [
        T.StructField(c, T.LongType()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [
        T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])
    whole = marked.filter("split is null").select(*columns).mapInArrow(_repair_whole, edit_type)
    summary = whole.mapInArrow(_summaries, summary_type)
    if split.isEmpty():
        return whole, summary
    parts = _mark_duplicates(marked.filter("split").select(*columns, F.col(PID).cast("int").alias("pid")))
    table_type = T.StructType([T.StructField("conv", by_type["conv"]), T.StructField("pid", T.IntegerType()),
                               T.StructField("start", T.IntegerType()), T.StructField("finish", T.IntegerType()),
                               T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType())])
    tables = parts.select("conv", "pid", "pos", "role", "fault").groupBy("conv", "pid").applyInArrow(_segment, table_type)
    way_type = T.StructType([table_type[0], table_type[1], table_type[2], table_type[5]])
    ways = reliable_checkpoint(tables.groupBy("conv").applyInArrow(_fold, way_type))
    mended = reliable_checkpoint(parts.groupBy("conv", "pid").cogroup(ways.groupBy("conv", "pid")).applyInArrow(_apply, edit_type))
    ordered = mended.repartition(partitions(df.sparkSession), "conv").sortWithinPartitions("conv", "pos", "step")
    return whole.union(mended), summary.union(ordered.mapInArrow(_summaries, summary_type))


def _mark_duplicates(parts: DataFrame) -> DataFrame:
    """``duplicate`` as the fault of turns whose conversation holds their role and text earlier."""
    digest = F.sha2(F.col("text"), 256)
    parts = parts.withColumn("digest", digest)
    again = parts.groupBy("conv", "role", "digest").agg(F.min("pos").alias("first"), F.count("*").alias("n")).filter("n > 1")
    again = again.select(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")
    same = F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    fault = F.when(F.col("fault").eqNullSafe("blank") | F.col("first").isNull() | (F.col("first") == F.col("pos")), F.col("fault"))
    joined = parts.join(again, same, "left").withColumn("fault", fault.otherwise("duplicate"))
    return reliable_checkpoint(joined.select("conv", "pid", "pos", "turn", "role", "text", "fault"))
