"""Repair of conversation structure: the cheapest edits that give a conversation turns of user and assistant, after a system row or none.

A conversation is read through four states (nothing yet, after a system, user or assistant row). Each row may be kept (0), given another role (1) or
deleted (2, the only way for blank and repeated rows); an empty row of user or assistant may be inserted anywhere (5); a truncated row that stays costs 5 more. Least costs
from the start to each state (forward) and from it to the end (backward) name the tight arcs, those of any cheapest repair; they form a graph without cycles, and a walk over
sets of states that the same letters reach takes the least letter (D, I, K, R) that a tight arc offers at each step.

Conversations of up to MOST_ROWS rows and MOST_BYTES bytes are dealt whole, sorted, and repaired as they stream by. Longer ones are cut along their order into pieces
of that bound: each piece gives its four by four table of least costs, the tables are folded forward and backward (one small row a piece), each piece
is walked for every set of states in which it may be entered, and the sets are folded into the one walk. Only the hash of a conversation runs through its pieces in order.

Order is by turn (nulls first), then role, then text. Nulls of any column are read as one space (a null conv_id is a conversation, returned as null); a null turn counts in no gap.
Equal rows are repeats and all but the first are deleted. Role initials other than s, u, a are illegal and need another role or deletion. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from cairn.llm.common import staged, table

MOST_ROWS, MOST_BYTES = 4096, 4 << 20
SPACE, FULL_STOPS, INITIALS, LEGAL = " \t\n\x0b\x0c\r", ".!?", "sua", ("su", "ua", "au")
FAR = 1 << 60
KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5
#: the state after a row of this initial, by the state before it; states: nothing yet, after system, user, assistant
STEP = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
ADDED = [(q, to) for i in "ua" for q, to in STEP[i].items()]
BAD = 8
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _moves(kind: int) -> list[tuple[str, int, int, int]]:
    """(letter, cost, from, to) of a row; kind is twice its initial's place in INITIALS (3: none of them), plus 1 if truncated, or BAD."""
    out = [("D", DELETE, q, q) for q in range(4)]
    if kind != BAD:
        initial, more = (INITIALS + "-")[kind // 2], CUT * (kind % 2)
        out += [("K", KEEP + more, q, to) for q, to in STEP.get(initial, {}).items()] + [("R", REROLE + more, q, to) for q, to in ADDED]
    return out


MOVES = [_moves(k) for k in range(BAD + 1)]
#: by kind and letter, from a state to the states it may lead to with their cost
ARCS = [{x: {q: [(to, c) for y, c, f, to in moves if y == x and f == q] for q in range(4)} for x in "DKR"} for moves in MOVES]
PAIRS = [[(c, f, to) for _, c, f, to in moves] for moves in MOVES]


def _inserted(cost: list[int]) -> list[int]:
    """Least costs to each state with insertions at this place."""
    cost = list(cost)
    for _ in range(2):
        cost[2] = min(cost[2], min(cost[0], cost[1], cost[3]) + INSERT)
        cost[3] = min(cost[3], cost[2] + INSERT)
    return cost


def _inserting(cost: list[int]) -> list[int]:
    """Least costs from each state to the end with insertions at this place."""
    cost = list(cost)
    for _ in range(2):
        cost[2] = min(cost[2], cost[3] + INSERT)
        cost[0], cost[1], cost[3] = (min(cost[q], cost[2] + INSERT) for q in (0, 1, 3))
    return cost


START, END = [0, FAR, FAR, FAR], _inserting([0, FAR, FAR, 0])


def forward(kinds: bytes, enter: list[int]) -> list[list[int]]:
    """Least costs before each row and after the last; insertions before a row are in, those after the last are not."""
    out, now = [], list(enter)
    for k in kinds:
        now = _inserted(now)
        out.append(now)
        new = [FAR] * 4
        for c, f, to in PAIRS[k]:
            if now[f] + c < new[to]:
                new[to] = now[f] + c
        now = new
    return [*out, now]


def backward(kinds: bytes, leave: list[int]) -> list[list[int]]:
    out, now = [list(leave)], list(leave)
    for k in reversed(kinds):
        new = [FAR] * 4
        for c, f, to in PAIRS[k]:
            if now[to] + c < new[f]:
                new[f] = now[to] + c
        now = _inserting(new)
        out.append(now)
    return out[::-1]


def walk(kinds: bytes, enter: list[int], leave: list[int], best: int, at: set[int], last: bool = True) -> tuple[str, set[int]]:
    """The least letters over tight arcs from the set of states `at`, and the set they lead to. leave are the least costs from the last row on, insertions in."""
    ahead, behind, n = forward(kinds, enter), backward(kinds, leave), len(kinds)
    ahead[n] = _inserted(ahead[n])
    letters, i = [], 0
    while True:
        if i == n and (not last or any(q in (0, 3) and ahead[n][q] == best for q in at)):
            return "".join(letters), at
        for x in "DIKR":
            if x == "I":
                to = {t for q, t in ADDED if q in at and ahead[i][q] + INSERT + behind[i][t] == best}
            elif i < n:
                to = {t for q in at for t, c in ARCS[kinds[i]][x][q] if ahead[i][q] + c + behind[i + 1][t] == best}
            else:
                continue
            if to:
                break
        else:
            raise AssertionError("no tight arc leaves this place")
        letters.append(x)
        at, i = to, i + (x != "I")


def repaired(letters: str, roles: list[str], texts: list[str], start: int, total: int) -> list[str]:
    """role:text of what the letters leave of these rows; start rows stand before them, total in all (odd totals begin with a system row)."""
    out, i = [], 0
    for x in letters:
        if x == "K":
            out.append(f"{roles[i]}:{texts[i]}")
        elif x != "D":
            role = "assistant" if (start + len(out) - total) % 2 else "user"
            out.append(f"{role}:{'' if x == 'I' else texts[i]}")
        i += x != "I"
    return out


def judge(roles: list[str], texts: list[str], seen: list[bool]) -> tuple[bytes, dict[str, int]]:
    """Kind of each row and the counts of first faults; seen tells which rows repeat an earlier one."""
    kinds, n = bytearray(), dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
    for k, (role, text, again) in enumerate(zip(roles, texts, seen, strict=True)):
        core = text.rstrip(SPACE)
        fault = "blank" if not core else "duplicate" if again else "truncated" if core[-1] not in FULL_STOPS else ""
        if fault:
            n[fault] += 1
        place = INITIALS.find(role[:1]) if role else -1
        kinds.append(BAD if fault in ("blank", "duplicate") else 2 * (place if place >= 0 else 3) + (fault == "truncated"))
        n["illegal"] += k > 0 and roles[k - 1][:1] + role[:1] not in LEGAL
    return bytes(kinds), n


def repair(turns: list, roles: list[str], texts: list[str]) -> dict:
    """One whole conversation, in order."""
    met, seen = set(), []
    for x in zip(roles, texts, strict=True):
        seen.append(x in met)
        met.add(x)
    kinds, n = judge(roles, texts, seen)
    ahead = _inserted(forward(kinds, START)[-1])
    best = min(ahead[0], ahead[3])
    letters, _ = walk(kinds, START, END, best, {0})
    known = [t for t in turns if t is not None]
    left = repaired(letters, roles, texts, 0, len(letters) - letters.count("D"))
    return {"gaps": max(known) - min(known) + 1 - len(set(known)) if known else 0, **n, "cost": best, "audit": letters, "repaired_sha256": hashlib.sha256("\n".join(left).encode()).hexdigest()}


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone) with faults made by crc32 of `conv_id:turn`; dropped rows stay as gone, so that their conversation is known."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat_ws(":", said("conv_id"), said("turn")).cast("binary")) % 20
    own = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), said("role").alias("role"), said("text").alias("text"), fault.alias("fault"))
    own = own.select("conv_id", "turn", "fault", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), F.when(F.col("fault").isin(0, 1), "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"))
    return own.select("conv_id", "turn", "role", "text", (F.col("fault") == 0).alias("gone"), F.explode(F.sequence(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def _result(schema_of: DataFrame) -> ST.StructType:
    return ST.StructType([ST.StructField("conv_id", schema_of.schema["conv_id"].dataType), *(ST.StructField(c, ST.LongType()) for c in COUNTS), ST.StructField("audit", ST.StringType()), ST.StructField("repaired_sha256", ST.StringType())])


def _grouped(batches: Iterator[pa.RecordBatch], key: str = "conv_id") -> Iterator[tuple[object, list[dict]]]:
    """Runs of rows of one key, as they stream by in order."""
    held, now = [], None
    for b in batches:
        for row in b.to_pylist():
            if held and row[key] != now:
                yield now, held
                held = []
            now = row[key]
            held.append(row)
    if held:
        yield now, held


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _short(rows: DataFrame) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    out = _result(rows)
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = []
        for conv, held in _grouped(batches):
            held = [r for r in held if not r["gone"]]
            done.append({"conv_id": conv, **repair(*([r[c] for r in held] for c in ("turn", "role", "text")))})
            if len(done) >= 1024:
                yield _batch(done, arrow)
                done = []
        yield _batch(done, arrow)

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, out)


def _pieces(rows: DataFrame, most_rows: int, most_bytes: int) -> DataFrame:
    """(conv_id, part, no, turns, roles, texts, again): the rows of long conversations packed in order, one row a piece. Equal rows are counted before they are sorted."""
    from pyspark.sql.pandas.types import to_arrow_schema

    conv = rows.schema["conv_id"]
    schema = ST.StructType([conv, *(ST.StructField(c, ST.IntegerType()) for c in ("part", "no")), ST.StructField("turns", ST.ArrayType(ST.LongType())), *(ST.StructField(c, ST.ArrayType(ST.StringType())) for c in ("roles", "texts")), ST.StructField("again", ST.ArrayType(ST.BooleanType()))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, no = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        size, now = 0, None

        def packed() -> pa.RecordBatch:
            turns, roles, texts, again = map(list, zip(*held, strict=True))
            return _batch([{"conv_id": now, "part": part, "no": no, "turns": turns, "roles": roles, "texts": texts, "again": again}], arrow)

        for b in batches:
            for r in b.to_pylist():
                for k in range(r["times"]):
                    if held and (r["conv_id"] != now or len(held) >= most_rows or size >= most_bytes):
                        yield packed()
                        held, size, no = [], 0, no + 1
                    now = r["conv_id"]
                    held.append((r["turn"], r["role"], r["text"], k > 0 or r["piece"] > 0))
                    size += len(r["text"])
        if held:
            yield packed()

    each = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n"))
    each = each.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / most_rows))).alias("piece"))
    each = each.withColumn("times", F.least(F.lit(most_rows).cast("long"), F.col("n") - F.col("piece") * most_rows)).withColumn("head", F.substring("text", 1, 64)).drop("n")
    n = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return each.repartitionByRange(n, "conv_id", "turn", "role", "head", "piece").sortWithinPartitions("conv_id", "turn", "role", "text", "piece").drop("head").mapInArrow(run, schema)


AT = ["conv_id", "part", "no"]


def _key(role: str, text: str) -> bytes:
    return hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()


def _keys(pieces: DataFrame) -> DataFrame:
    """(conv_id, part, no, late): keys of rows that stand in an earlier piece of the conversation too."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = ST.StructType([*pieces.select(*AT).schema, ST.StructField("key", ST.BinaryType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                own = {k: r[k] for k in AT}
                yield _batch([own | {"key": k} for k in sorted({_key(*x) for x in zip(r["roles"], r["texts"], strict=True)})], arrow)

    keys = staged(pieces.sparkSession, pieces.select(*AT, "roles", "texts").mapInArrow(run, schema), "keys")
    first = keys.groupBy(F.col("conv_id").alias("c"), F.col("key").alias("k")).agg(F.min(F.struct("part", "no")).alias("first"))
    late = keys.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("key") == F.col("k"))).where(F.struct("part", "no") > F.col("first"))
    return late.groupBy(*AT).agg(F.collect_list("key").alias("late"))


def _measured(pieces: DataFrame, late: DataFrame) -> DataFrame:
    """One row a piece: kinds of its rows, counts, what stands at its ends, and its table of least costs."""
    from pyspark.sql.pandas.types import to_arrow_schema

    longs = ("blank", "duplicate", "truncated", "illegal", "turns_known", "first_turn", "last_turn")
    schema = ST.StructType([*pieces.select(*AT).schema, *(ST.StructField(c, ST.LongType()) for c in longs), *(ST.StructField(c, ST.StringType()) for c in ("first", "last")), ST.StructField("kinds", ST.BinaryType()), ST.StructField("costs", ST.ArrayType(ST.LongType()))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                met, seen = set(r["late"] or ()), []
                for role, text, again in zip(r["roles"], r["texts"], r["again"], strict=True):
                    k = _key(role, text)
                    seen.append(again or k in met)
                    met.add(k)
                kinds, n = judge(r["roles"], r["texts"], seen)
                known = [t for t in r["turns"] if t is not None]
                ends = {"turns_known": len(set(known)), "first_turn": min(known, default=None), "last_turn": max(known, default=None), "first": r["roles"][0][:1], "last": r["roles"][-1][:1]}
                costs = [c for q in range(4) for c in forward(kinds, [0 if q == x else FAR for x in range(4)])[-1]]
                yield _batch([{k: r[k] for k in AT} | n | ends | {"kinds": kinds, "costs": costs}], arrow)

    both = pieces.join(late.select(*(F.col(c).alias(f"l_{c}") for c in AT), "late"), F.col("conv_id").eqNullSafe(F.col("l_conv_id")) & (F.col("part") == F.col("l_part")) & (F.col("no") == F.col("l_no")), "left")
    return both.select(*AT, "turns", "roles", "texts", "again", "late").mapInArrow(run, schema)


def _through(costs: list[int], enter: list[int]) -> list[int]:
    return [min(FAR, *(enter[q] + costs[4 * q + to] for q in range(4))) for to in range(4)]


def _folded(measured: DataFrame) -> DataFrame:
    """Costs at both ends of each piece, and the whole conversation's counts beside them."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["part", "no"], kind="stable").reset_index(drop=True)
        enter = [START]
        for c in g["costs"]:
            enter.append(_through(c, enter[-1]))
        final = _inserted(enter.pop())
        leave = [END]
        for c in reversed(g["costs"].tolist()[1:]):
            leave.append(_inserting([min(FAR, *(int(c[4 * q + to]) + leave[-1][to] for to in range(4))) for q in range(4)]))
        g["enter"], g["leave"], g["best"], g["final"] = [list(map(int, x)) for x in enter], [list(map(int, x)) for x in leave[::-1]], int(min(final[0], final[3])), [*[False] * (len(g) - 1), True]
        known = g[g["turns_known"] > 0]
        joints = int((known["first_turn"].to_numpy()[1:] == known["last_turn"].to_numpy()[:-1]).sum())
        g["gaps"] = int(known["last_turn"].max() - known["first_turn"].min()) + 1 - int(known["turns_known"].sum()) + joints if len(known) else 0
        for c in ("blank", "duplicate", "truncated"):
            g[c] = int(g[c].sum())
        g["illegal"] = int(g["illegal"].sum()) + sum(a + b not in LEGAL for a, b in zip(g["last"][:-1], g["first"][1:], strict=True))
        return g[[*AT, "enter", "leave", "best", "final", "gaps", "blank", "duplicate", "truncated", "illegal"]]

    longs = "enter array<long>, leave array<long>, best long, final boolean, gaps long, blank long, duplicate long, truncated long, illegal long"
    schema = ST.StructType([*measured.select(*AT).schema, *ST.StructType.fromDDL(longs)])
    return measured.drop("kinds").groupBy("conv_id").applyInPandas(run, schema)


def _sets(states: list[int]) -> list[set[int]]:
    return [{q for k, q in enumerate(states) if m >> k & 1} for m in range(1, 1 << len(states))]


def _mask(states: set[int]) -> int:
    return sum(1 << q for q in states)


def _walked(measured: DataFrame, folded: DataFrame) -> DataFrame:
    """For each piece, each set of states it may be entered in: letters, the set they lead to, rows they leave."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = ST.StructType([*measured.select(*AT).schema, *ST.StructType.fromDDL("mask int, letters string, to int, leaves long")])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                first = backward(r["kinds"], r["leave"])[0]
                out = []
                for at in _sets([q for q in range(4) if r["enter"][q] + first[q] == r["best"]]):
                    letters, to = walk(r["kinds"], r["enter"], r["leave"], r["best"], at, r["final"])
                    out.append({k: r[k] for k in AT} | {"mask": _mask(at), "letters": letters, "to": _mask(to), "leaves": len(letters) - letters.count("D")})
                yield _batch(out, arrow)

    return _with(measured.select(*AT, "kinds"), folded.select(*AT, "enter", "leave", "best", "final")).mapInArrow(run, schema)


def _with(a: DataFrame, b: DataFrame) -> DataFrame:
    right = b.select(*(F.col(c).alias(f"r_{c}") if c in AT else F.col(c) for c in b.columns))
    return a.join(right, F.col("conv_id").eqNullSafe(F.col("r_conv_id")) & (F.col("part") == F.col("r_part")) & (F.col("no") == F.col("r_no"))).drop("r_conv_id", "r_part", "r_no")


def _chosen(walked: DataFrame) -> DataFrame:
    """The set in which each piece is entered, the rows left before it, and those left in all."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        at, before, out = 1, 0, []
        for (part, no), ways in g.sort_values(["part", "no"], kind="stable").groupby(["part", "no"], sort=True):
            way = ways[ways["mask"] == at].iloc[0]
            out.append((part, no, at, before))
            at, before = int(way["to"]), before + int(way["leaves"])
        done = pd.DataFrame(out, columns=["part", "no", "mask", "start"])
        done["conv_id"], done["total"] = g["conv_id"].iloc[0], before
        return done[[*AT, "mask", "start", "total"]]

    return walked.drop("letters").groupBy("conv_id").applyInPandas(run, ST.StructType([*walked.select(*AT).schema, *ST.StructType.fromDDL("mask int, start long, total long")]))


def _long(rows: DataFrame, most_rows: int, most_bytes: int) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = rows.sparkSession
    pieces = staged(spark, _pieces(rows, most_rows, most_bytes), "pieces")
    measured = staged(spark, _measured(pieces, _keys(pieces)), "measured")
    folded = staged(spark, _folded(measured), "folded")
    walked = staged(spark, _walked(measured, folded), "walked")
    chosen = _chosen(walked).withColumnRenamed("mask", "taken")
    way = _with(walked.select(*AT, "mask", "letters"), chosen).where("mask = taken").select(*AT, "letters", "start", "total")
    schema = ST.StructType([*rows.select("conv_id").schema, *ST.StructType.fromDDL("part int, no int, letters string, left string, start long")])
    arrow = to_arrow_schema(schema)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                left = repaired(r["letters"], r["roles"], r["texts"], r["start"], r["total"])
                yield _batch([{k: r[k] for k in (*AT, "letters", "start")} | {"left": "\n".join(left) if left else None}], arrow)

    whole = _result(rows)
    named = to_arrow_schema(whole)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, letters, last, any_yet = None, hashlib.sha256(), [], None, False

        def row() -> dict:
            return {"conv_id": now, **{c: last[c] for c in COUNTS}, "audit": "".join(letters), "repaired_sha256": digest.hexdigest()}

        for b in batches:
            for r in b.to_pylist():
                if last is not None and r["conv_id"] != now:
                    yield _batch([row()], named)
                    digest, letters, any_yet = hashlib.sha256(), [], False
                now, last = r["conv_id"], r
                letters.append(r["letters"])
                if r["left"] is not None:
                    digest.update((("\n" if any_yet else "") + r["left"]).encode())
                    any_yet = True
        if last is not None:
            yield _batch([row()], named)

    done = _with(_with(pieces.select(*AT, "roles", "texts"), way).mapInArrow(put, schema), folded.select(*AT, "gaps", "blank", "duplicate", "truncated", "illegal", F.col("best").alias("cost")))
    return done.repartition("conv_id").sortWithinPartitions("conv_id", "part", "no").mapInArrow(hashed, whole)


def repair_conversations(rows: DataFrame, most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """One row a conversation of rows (conv_id, turn, role, text, gone; no nulls in role and text): its faults, the cost and letters of the cheapest repair, and the hash of what it leaves."""
    spark = rows.sparkSession
    size = rows.groupBy(F.col("conv_id").alias("long_id")).agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b"))
    over = staged(spark, size.where((F.col("n") > most_rows) | (F.col("b") > most_bytes)).select("long_id"), "long")
    if over.isEmpty():
        return _short(rows)
    same = F.col("conv_id").eqNullSafe(F.col("long_id"))
    there = _long(rows.join(over, same, "left_semi").where(~F.col("gone")).drop("gone"), most_rows, most_bytes)
    short = rows.join(over, same, "left_anti")
    empty = rows.join(over, same, "left_semi").groupBy("conv_id").agg(F.min("gone").alias("gone")).where("gone")
    return _short(short).unionByName(there).unionByName(_short(empty.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), "gone")))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(damaged(table(spark, sf_dir, "conversations")))


QUERIES = {"op12_repair": op12_repair}
