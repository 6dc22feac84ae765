"""Repair of the turn structure of conversations: Hirschberg's divide and conquer over four states.

A repaired conversation's roles read ``s?(ua)+`` or nothing. The states are: nothing yet, after ``s``, after ``u``,
after ``a``. A message is kept, gets another role or is deleted, and messages may be inserted before it. So every
message, and every run of messages, is a 4 x 4 table: the least cost from state p to state q, and which of two
ends that cost the same for a given p has the ASCII-least edits (``order``).

Costs go forward from the start and backward from the end as vectors of four numbers. They meet in the middle; of the
states with the least sum the one with the least edits is where the repair crosses, and both halves are solved the
same way, so no table of all messages and states is held. Edits up to a message end in that message's letter, hence
the edits to two different states at one place are never a prefix of each other, and the order of the left
parts decides. The tables of runs compose, so a conversation of any length is a tree of runs of at most ``RUN``
parts: tables go up, start and end states come down.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache, lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from petrichor.llm.common import join_groups, small_or_not, written
from petrichor.llm.shingles import small_batches

#: Messages in a block, and blocks in a block of blocks.
RUN = 256
STATES = range(4)
FAR = 1 << 50
#: The next state and role letter when a user or assistant message follows.
NEXT = {0: (2, "u"), 1: (2, "u"), 2: (3, "a"), 3: (2, "u")}
ROLE = {"u": "user", "a": "assistant"}
SPACE = " \t\n\x0b\x0c\r"
LEGAL = {"su", "ua", "au"}
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


# --- one message, and runs of messages -------------------------------------------------------------------------


@cache
def _inserted(state: int, k: int) -> tuple[int, int]:
    """(state, cost) after k insertions."""
    for _ in range(k):
        state = NEXT[state][0]
    return state, 2 * k


@cache
def steps(initial: str, must_go: bool, cut: bool) -> dict[tuple[int, int], tuple[int, str]]:
    """{(p, q): (cost, edits)} of one message, the least cost and then the ASCII-least edits; ``cut``: truncated."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for p in STATES:
        for k in range(3):
            at, paid = _inserted(p, k)
            ways = [(at, paid + 3, "D")]
            if not must_go:
                to, letter = NEXT[at]
                ways.append((to, paid + 2 + cut, "R"))
                if initial == letter:
                    ways.append((to, paid + cut, "K"))
                if initial == "s" and at == 0:
                    ways.append((1, paid + cut, "K"))
            for q, cost, edit in ways:
                way = (cost, "I" * k + edit)
                best[p, q] = min(best.get((p, q), way), way)
    return best


@cache
def message(initial: str, must_go: bool, cut: bool) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """(cost, order) of one message, both 16 numbers at 4 p + q."""
    found = steps(initial, must_go, cut)
    cost = tuple(found.get((p, q), (FAR, ""))[0] for p in STATES for q in STATES)
    order = []
    for p in STATES:
        rank = {q: i for i, q in enumerate(sorted((q for q in STATES if (p, q) in found), key=lambda q: found[p, q][1]))}
        order += [rank.get(q, 9) for q in STATES]
    return cost, tuple(order)


Table = tuple[tuple[int, ...], tuple[int, ...]]
Front = tuple[tuple[int, ...], tuple[int, ...]]


def _start(state: int) -> Front:
    return tuple(0 if q == state else FAR for q in STATES), tuple(0 if q == state else 9 for q in STATES)


def forward(front: Front, table: Table) -> Front:
    """Least costs, and the order of the least edits, one part further on."""
    costs, ranks = front
    cost, order = table
    best = []
    for q in STATES:
        ways = [(costs[p] + cost[4 * p + q], ranks[p], order[4 * p + q]) for p in STATES if costs[p] < FAR and cost[4 * p + q] < FAR]
        best.append(min(ways, default=(FAR, 9, 9)))
    seen = sorted({b[1:] for b in best if b[0] < FAR})
    return tuple(b[0] for b in best), tuple(seen.index(b[1:]) if b[0] < FAR else 9 for b in best)


def backward(table: Table, back: tuple[int, ...]) -> tuple[int, ...]:
    cost, _ = table
    return tuple(min(min(cost[4 * p + q] + back[q] for q in STATES), FAR) for p in STATES)


@lru_cache(1 << 16)
def _eased_forward(front: Front, table: Table) -> tuple[int, Front]:
    costs, ranks = forward(front, table)
    low = min(costs)
    return low, (tuple(min(c - low, FAR) if c < FAR else FAR for c in costs), ranks)


def _forward_all(state: int, tables: list[Table], lo: int, hi: int) -> Front:
    front, paid = _start(state), 0
    for t in tables[lo:hi]:
        low, front = _eased_forward(front, t)  # fronts relative to their least cost repeat, so they are looked up
        paid += low
    return tuple(c + paid if c < FAR else FAR for c in front[0]), front[1]


@lru_cache(1 << 16)
def _eased_backward(table: Table, back: tuple[int, ...]) -> tuple[int, tuple[int, ...]]:
    out = backward(table, back)
    low = min(out)
    return low, tuple(c - low if c < FAR else FAR for c in out)


def _backward_all(state: int, tables: list[Table], lo: int, hi: int) -> tuple[int, ...]:
    back, paid = tuple(0 if q == state else FAR for q in STATES), 0
    for t in reversed(tables[lo:hi]):
        low, back = _eased_backward(t, back)
        paid += low
    return tuple(c + paid if c < FAR else FAR for c in back)


def composed(tables: list[Table]) -> Table:
    """The table of a whole run; of an empty one, staying where one is."""
    fronts = [_forward_all(p, tables, 0, len(tables)) for p in STATES]
    return tuple(c for f in fronts for c in f[0]), tuple(r for f in fronts for r in f[1])


def crossings(tables: list[Table], start: int, end: int) -> list[int]:
    """The states before, between and after the parts on the cheapest, then ASCII-least repair from start to end."""
    states = [start] * (len(tables) + 1)
    states[-1] = end
    open_ = [(0, len(tables))]
    while open_:
        lo, hi = open_.pop()
        if hi - lo < 2:
            continue
        mid = (lo + hi) // 2
        costs, ranks = _forward_all(states[lo], tables, lo, mid)
        back = _backward_all(states[hi], tables, mid, hi)
        states[mid] = min((costs[q] + back[q], ranks[q], q) for q in STATES)[2]
        open_ += [(lo, mid), (mid, hi)]
    return states


def closing(table: Table) -> tuple[int, int, str]:
    """(end state, whole cost, edits after the last message) for a conversation's table."""
    cost, order = table
    after = {0: (0, ""), 1: (4, "II"), 2: (2, "I"), 3: (0, "")}
    end = min(STATES, key=lambda q: (cost[q] + after[q][0], order[q]))
    return end, cost[end] + after[end][0], after[end][1]


# --- rows ------------------------------------------------------------------------------------------------------


def damaged(df: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, gone) after the damage; a NULL role or text reads as one space, a NULL in the
    hashed ``conv_id:turn`` too. A dropped row stays as a mark, so that its conversation is still known."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    case = F.crc32(F.encode(F.concat(part("conv_id"), F.lit(":"), part("turn")), "UTF-8")) % 20
    rows = df.select("conv_id", F.col("turn").cast("long").alias("turn"), part("role").alias("role"), part("text").alias("text"), case.alias("case"))
    text = F.when(F.col("case") == 1, F.lit("")).when(F.col("case") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("case") == 4, F.lit("user")).otherwise(F.col("role"))
    times = F.array_repeat(F.lit(0), F.when(F.col("case") == 3, F.lit(2)).otherwise(F.lit(1)))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("case") == 0).alias("gone"), F.explode(times).alias("_copy"))
    return rows.withColumn("text", F.when(~F.col("gone"), F.col("text"))).drop("_copy")


def _runs(df: DataFrame, key: str, items: list[str], fn, schema: str) -> DataFrame:
    """fn(block) of every block of a sorted table: at most RUN rows of one key, as {key, task, seq, rows}; (task, seq)
    orders a key's blocks. Rows are cut as they pass by; ``gone`` ones only make their key known."""
    arrow = _arrow(schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seq, now, own = TaskContext.get().partitionId(), 0, None, None

        def out() -> dict:
            nonlocal seq
            seq += 1
            return fn({"key": now, "task": task, "seq": seq, "rows": own})

        done = []
        for batch in batches:
            for row in batch.to_pylist():
                k = row.pop(key)
                if own is not None and (k != now or len(own) == RUN):
                    done.append(out())
                    own = None
                if own is None:
                    now, own = k, []
                if not row.get("gone"):
                    own.append(row)
                if len(done) == 64:
                    yield pa.RecordBatch.from_pylist(done, schema=arrow)
                    done = []
        if own is not None:
            done.append(out())
        yield pa.RecordBatch.from_pylist(done, schema=arrow)

    return df.select(key, *items).mapInArrow(cut, schema)


def blocks(df: DataFrame, key: str, order: list[str], items: list[str], name: str) -> DataFrame:
    """The blocks (key, task, seq, rows) of long keys; written. Rows are dealt to tasks by range of (key, order), so a key
    that holds a third of all rows spreads over many tasks."""
    fields = ", ".join(f"`{c}`: {df.schema[c].dataType.simpleString()}" for c in items)
    dealt = df.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    return written(_runs(dealt, key, items, lambda block: block, f"key string, task int, seq bigint, rows array<struct<{fields}>>"), name)


def _arrow(schema: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema))


TABLE = "cost array<bigint>, rank array<int>, blank bigint, duplicate bigint, truncated bigint, illegal bigint, turns bigint, low bigint, high bigint, first_turn bigint, last_turn bigint, first_role string, last_role string, messages bigint"
COUNTS = ["blank", "duplicate", "truncated", "illegal"]


def _faults(rows: list[dict], repeated: set[int]) -> list[str]:
    """Per row ``blank``, ``duplicate``, ``truncated`` or nothing; ``repeated``: rows that an earlier block has too."""
    out, seen = [], set()
    for i, r in enumerate(rows):
        body = r["text"].rstrip(SPACE)
        again = i in repeated or (r["role"], r["text"]) in seen
        seen.add((r["role"], r["text"]))
        out.append("blank" if not body else "duplicate" if again else "truncated" if body[-1] not in ".!?" else "")
    return out


def _tables(rows: list[dict], faults: list[str]) -> list[Table]:
    initials = [r["role"][:1] if r["role"][:1] in "sua" else "" for r in rows]
    return [message(i, f in ("blank", "duplicate"), f == "truncated") for i, f in zip(initials, faults)]


def _joined(parts: list[dict]) -> dict:
    """What neighbouring parts amount to: counts added, and the pair of messages where two parts meet looked at."""
    out = {c: sum(p[c] for p in parts) for c in [*COUNTS, "turns", "messages"]}
    full = [p for p in parts if p["messages"]]
    for a, b in zip(full, full[1:]):
        out["illegal"] += a["last_role"] + b["first_role"] not in LEGAL
        out["turns"] -= a["last_turn"] is not None and a["last_turn"] == b["first_turn"]
    lows, highs = ([p[c] for p in parts if p[c] is not None] for c in ("low", "high"))
    out |= {"low": min(lows, default=None), "high": max(highs, default=None)}
    out |= {f"first_{c}": full[0][f"first_{c}"] if full else None for c in ("turn", "role")}
    return out | {f"last_{c}": full[-1][f"last_{c}"] if full else None for c in ("turn", "role")}


def _summary(rows: list[dict], faults: list[str]) -> dict:
    singles = []
    for r, f in zip(rows, faults):
        turn, letter = r["turn"], r["role"][:1]
        single = {c: int(f == c) for c in COUNTS} | {"turns": int(turn is not None), "low": turn, "high": turn, "first_turn": turn, "last_turn": turn, "messages": 1}
        singles.append(single | {"first_role": letter, "last_role": letter})
    return _joined(singles)


def _repair(rows: list[dict], tables: list[Table], faults: list[str], start: int, end: int) -> tuple[list[str], list[str]]:
    """(edits per row, lines ``role:text`` of the repaired run)."""
    states, edits, lines = crossings(tables, start, end), [], []
    for r, f, p, q in zip(rows, faults, states, states[1:]):
        letter = r["role"][:1] if r["role"][:1] in "sua" else ""
        own = steps(letter, f in ("blank", "duplicate"), f == "truncated")[p, q][1]
        edits.append(own)
        for e in own:
            if e == "D":
                continue
            state, expected = NEXT[p]
            if e == "K":
                lines.append(f"{r['role']}:{r['text']}")
                p = 1 if letter == "s" else state
            else:
                lines.append(f"{ROLE[expected]}:{r['text'] if e == 'R' else ''}")
                p = state
    return edits, lines


def _appended(edits: str, state: int) -> list[str]:
    out = []
    for _ in edits:
        state, letter = NEXT[state]
        out.append(f"{ROLE[letter]}:")
    return out


RESULT = "key string, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def _result(key: str, s: dict, cost: int, audit: str, sha: str) -> dict:
    gaps = 0 if s["low"] is None else s["high"] - s["low"] + 1 - s["turns"]
    return {"key": key, "gaps": gaps} | {c: s[c] for c in COUNTS} | {"cost": cost, "audit": audit, "repaired_sha256": sha}


def _per_batch(df: DataFrame, fn, schema: str) -> DataFrame:
    """fn(row as dict) -> dict or list of dicts, over Arrow batches."""
    arrow = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                yield pa.RecordBatch.from_pylist([fn(r) for r in batch.slice(at, 64).to_pylist()], schema=arrow)

    return df.mapInArrow(run, schema)


def _whole(row: dict) -> dict:
    """A conversation of one block."""
    rows = row["rows"]
    faults = _faults(rows, set())
    tables = _tables(rows, faults)
    end, cost, more = closing(composed(tables))
    edits, lines = _repair(rows, tables, faults, 0, end)
    text = "\n".join(lines + _appended(more, end))
    return _result(row["key"], _summary(rows, faults), cost, "".join(edits) + more, hashlib.sha256(text.encode()).hexdigest())


def _block_table(row: dict) -> dict:
    faults = _faults(row["rows"], set(row["again"] or []))
    cost, rank = composed(_tables(row["rows"], faults))
    return {c: row[c] for c in ("key", "task", "seq")} | {"cost": cost, "rank": rank} | _summary(row["rows"], faults)


def _run_table(row: dict) -> dict:
    cost, rank = composed([(tuple(p["cost"]), tuple(p["rank"])) for p in row["rows"]])
    return {c: row[c] for c in ("key", "task", "seq")} | {"cost": cost, "rank": rank} | _joined(row["rows"])


AT = "key string, task int, seq bigint"


def _again(parts: DataFrame) -> DataFrame:
    """(key, task, seq, again): places in a block whose role and text an earlier block of the conversation has too."""
    each = parts.select("key", "task", "seq", F.posexplode("rows").alias("i", "r")).filter("NOT (r.text RLIKE '^[\\\\x20\\\\x09-\\\\x0D]*$')")
    each = written(each.select("key", "task", "seq", "i", F.sha2(F.to_json(F.struct("key", "r.role", "r.text")), 256).alias("said")), "said")
    firsts = each.groupBy("said").agg(F.min(F.struct("task", "seq")).alias("first"), F.count(F.lit(1)).alias("times")).filter("times > 1")
    found = join_groups(each, written(firsts, "said-again"), "said", "times").filter(F.struct("task", "seq") > F.col("first"))
    return found.groupBy("key", "task", "seq").agg(F.collect_list("i").alias("again"))


def _long(parts: DataFrame) -> DataFrame:
    """Conversations of several blocks: tables up, states down, then every block is repaired on its own."""
    parts = written(parts.join(_again(parts), ["key", "task", "seq"], "left"), "long-blocks")
    ups = [written(_per_batch(parts, _block_table, f"{AT}, {TABLE}"), "block-tables")]
    runs = []
    columns = ["task", "seq", *[c.split(" ")[0] for c in TABLE.split(", ")]]
    while True:
        runs.append(blocks(ups[-1], "key", ["task", "seq"], columns, "table-runs"))
        ups.append(written(_per_batch(runs[-1], _run_table, f"{AT}, {TABLE}"), "run-tables"))
        if not ups[-1].groupBy("key").count().filter("count > 1").limit(1).count():
            break  # every conversation is one block

    def closed(row: dict) -> dict:
        end, cost, more = closing((tuple(row["cost"]), tuple(row["rank"])))
        out = _result(row["key"], row, cost, more, "")
        return out | {"task": row["task"], "seq": row["seq"], "start": 0, "end": end}

    tops = written(_per_batch(ups[-1], closed, f"{RESULT}, task int, seq bigint, start int, end int"), "conversation-ends")
    ways = tops.select("key", "task", "seq", "start", "end")

    def descend(row: dict) -> dict:
        states = crossings([(tuple(p["cost"]), tuple(p["rank"])) for p in row["rows"]], row["start"], row["end"])
        return {"ways": [{"key": row["key"], "task": p["task"], "seq": p["seq"], "start": a, "end": b} for p, a, b in zip(row["rows"], states, states[1:])]}

    for run in reversed(runs):
        down = _per_batch(run.join(ways, ["key", "task", "seq"]), descend, "ways array<struct<key:string,task:int,seq:bigint,start:int,end:int>>")
        ways = written(down.select(F.explode("ways").alias("w")).select("w.*"), "block-states")

    def repair(row: dict) -> dict:
        faults = _faults(row["rows"], set(row["again"] or []))
        edits, lines = _repair(row["rows"], _tables(row["rows"], faults), faults, row["start"], row["end"])
        return {c: row[c] for c in ("key", "task", "seq")} | {"edits": "".join(edits), "lines": lines}

    repaired = written(_per_batch(parts.join(ways, ["key", "task", "seq"]), repair, f"{AT}, edits string, lines array<string>"), "repaired-blocks")
    ends = tops.select("key", F.lit(None).cast("int").alias("task"), F.lit(None).cast("bigint").alias("seq"), F.col("audit").alias("edits"), F.lit(None).cast("array<string>").alias("lines"), "end")
    stream = repaired.withColumn("end", F.lit(None).cast("int")).unionByName(ends)
    stream = stream.repartition("key").sortWithinPartitions(F.col("key"), F.col("task").asc_nulls_last(), F.col("seq"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha, audit, empty = hashlib.sha256(), [], True
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                last = row["lines"] is None
                for line in _appended(row["edits"], row["end"]) if last else row["lines"]:
                    sha.update((line if empty else "\n" + line).encode())
                    empty = False
                audit.append(row["edits"])
                if last:
                    out.append({"key": row["key"], "audit": "".join(audit), "repaired_sha256": sha.hexdigest()})
                    sha, audit, empty = hashlib.sha256(), [], True
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("key", pa.string()), ("audit", pa.string()), ("repaired_sha256", pa.string())]))

    named = stream.mapInArrow(hashed, "key string, audit string, repaired_sha256 string")
    return tops.drop("audit", "repaired_sha256", "task", "seq", "start", "end").join(named, "key")


def repair(df: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) per conversation of a table
    (conv_id, turn, role, text, gone), as ``damaged`` makes it; gone marks a row that isn't there any more.

    Rows go by turn (NULL first), then by role and text, so repeated rows and equal turns have one order. NULL roles and texts must
    have been replaced (``damaged`` does). A NULL conv_id is a conversation of its own. A conversation without rows has
    zeros, an empty audit and the hash of the empty string. Other columns are ignored, and an empty table gives no rows.

    Conversations of up to RUN messages are dealt out by hash and repaired as they pass by. Longer ones, found by their
    counts, are cut into blocks over many tasks. The one thing a long conversation does in a single task is
    its result's own hash and audit: SHA-256 is a chain, so the repaired lines stream through it block by block.
    """
    small_batches(df.sparkSession)
    kind = df.schema["conv_id"].dataType
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    rows = df.select(key.alias("key"), "turn", "role", "text", "gone")
    order, items = ["turn", "role", "text"], ["turn", "role", "text", "gone"]
    counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > RUN)
    counts = written(counts.select("key"), "long-conversations")
    n_long = counts.count()
    keys = small_or_not(counts, n_long)
    short = rows.join(keys, "key", "left_anti") if n_long else rows
    out = _runs(short.repartition("key").sortWithinPartitions("key", *order), "key", items, _whole, RESULT)
    if n_long:
        long_ = blocks(rows.join(keys, "key", "left_semi"), "key", order, items, "conversation-blocks")
        out = out.unionByName(_long(long_).select(*out.columns))
    conv = F.when(F.col("key") != "", F.expr("substring(key, 2)").cast(kind))
    return out.select(conv.alias("conv_id"), *out.columns[1:])
