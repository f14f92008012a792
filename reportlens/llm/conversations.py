"""Repair of conversations at least cost: system? (user assistant)+, or nothing.

A message is kept, given the other role, or deleted, and messages without text can be put in. The
costs still to come, one per state of the pattern, are a Viterbi recursion from the end of a
conversation. It runs in chunks side by side: each starts from a guess of the cost vector behind it
and is run again from the true one, as far back as the two vectors differ by more than a constant.
Chunks are lanes of a block in one task, and segments of conversations that lie in several tasks. The
settled vectors then lead the cheapest edits forward, the ASCII-least first.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import text_slices
from .common import bound_batches, written

BLOCK_ROWS, BLOCK_BYTES = 8192, 4 << 20     # of a task's rows that are worked on at once, and the longest segment
LANE = 64                                   # messages of one lane of a block
FIXUPS = 4                                  # passes over segments before those left are joined by doubling
WHITE = " \t\n\x0b\x0c\r"
FINE, BLANK, CUT = 0, 1, 2                  # what a message's text is: whole, blank, or without an end mark
SYSTEM, USER, ASSISTANT, OTHER = range(4)   # roles by their initial
START, BEGUN, ASKED, ANSWERED = range(4)    # states: nothing yet, after system, after user, after assistant
ENDS = (START, ANSWERED)
KEPT = {(START, SYSTEM): BEGUN, (START, USER): ASKED, (BEGUN, USER): ASKED, (ASKED, ASSISTANT): ANSWERED, (ANSWERED, USER): ASKED}
NEXT = (ASKED, ASKED, ANSWERED, ASKED)      # where a message of the right role, user or assistant, leads
ROLE = {ASKED: "user", ANSWERED: "assistant"}
LEGAL = {"su", "ua", "au"}
DELETE, INSERT, KEEP, REROLE = range(4)     # in the order of their initials
FAR = 1 << 20                               # more than any difference of costs
ANY = object()


@dataclass(frozen=True)
class Costs:
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    cut: int = 5            # on top, if a message without an end mark stays


class Repair:
    """The recursion's tables for given costs. A message's code is 2 * role + (1 if it is cut)."""

    def __init__(self, costs: Costs = Costs()):
        if costs.insert <= 0:
            raise ValueError("an insertion must cost something")
        self.costs = costs
        put = np.full((4, 4), FAR)                      # by insertions alone
        for q in range(4):
            put[q, q], put[q, NEXT[q]], put[q, NEXT[NEXT[q]]] = 0, costs.insert, 2 * costs.insert if NEXT[NEXT[q]] != q else 0
        self.keep_cost, self.keep_to = np.full((8, 4), FAR), np.zeros((8, 4), np.int64)
        self.matrix = np.full((9, 4, 4), FAR)
        for code in range(8):
            extra = costs.cut * (code % 2)
            step = np.full((4, 4), FAR)
            for q in range(4):
                step[q, q] = costs.delete
                step[q, NEXT[q]] = min(step[q, NEXT[q]], costs.rerole + extra)
                to = KEPT.get((q, code // 2))
                if to is not None:
                    self.keep_cost[code, q], self.keep_to[code, q] = extra, to
                    step[q, to] = min(step[q, to], extra)
            self.matrix[code] = product(put, step)
        self.matrix[8] = put * 0 + FAR
        np.fill_diagonal(self.matrix[8], 0)             # no message
        last = np.full(4, FAR)
        last[list(ENDS)] = 0
        self.end = np.minimum((put + last).min(axis=1), FAR)

    def backward(self, codes: np.ndarray, last: np.ndarray, tail: np.ndarray, lane: int = LANE) -> tuple[np.ndarray, np.ndarray]:
        """The cost vector behind every message, least entry 0, and the vector before the first.

        last marks messages that end a conversation; tail is the vector behind the last message. All
        lanes step back together. A lane whose vector meets that of its earlier run is settled before
        that point; a lane is run again when the vector at the head of the next lane has changed.
        """
        n = -(-max(len(codes), 1) // lane)
        pad = n * lane - len(codes)
        code = np.concatenate([np.full(pad, 8), codes]).reshape(n, lane)
        ends = np.concatenate([np.zeros(pad, bool), last]).reshape(n, lane)
        behind, head = np.full((n, lane, 4), -1), np.zeros((n, 4), np.int64)
        entry = np.tile(self.end, (n, 1))
        entry[-1] = tail
        todo = np.arange(n)
        while len(todo):
            v, at = entry[todo], todo
            for k in range(lane - 1, -1, -1):
                v = np.where(ends[at, k][:, None], self.end, v)
                on = (behind[at, k] != v).any(axis=1)
                v, at = v[on], at[on]
                if not len(at):
                    break
                behind[at, k] = v
                v = (self.matrix[code[at, k]] + v[:, None, :]).min(axis=2)
                v -= v.min(axis=1, keepdims=True)
            head[at] = v
            before = at[at > 0] - 1
            before = before[(head[before + 1] != entry[before]).any(axis=1)]
            entry[before] = head[before + 1]
            todo = before
        return behind.reshape(-1, 4)[pad:], head[0]

    def response(self, codes: np.ndarray) -> np.ndarray:
        """The matrix that takes the vector behind some messages to the one before them."""
        mats = self.matrix[codes if len(codes) else np.array([8])]
        while len(mats) > 1:
            if len(mats) % 2:
                mats = np.concatenate([mats, self.matrix[8:]])
            mats = np.minimum((mats[0::2, :, :, None] + mats[1::2, None, :, :]).min(axis=2), FAR)
        return mats[0]

    def choices(self, codes: np.ndarray, behind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every message and state the least edit of a cheapest way, and the state after it."""
        n, c, to = len(codes), self.costs, np.array(NEXT)
        cut = c.cut * (codes % 2)[:, None]
        drop = c.delete + behind
        goto = self.keep_to[codes]
        keep = self.keep_cost[codes] + np.take_along_axis(behind, goto, axis=1)
        turn = c.rerole + cut + behind[:, to]
        best = np.minimum(np.minimum(drop, keep), turn)
        for _ in range(2):
            best = np.minimum(best, c.insert + best[:, to])
        pick = np.select([drop == best, c.insert + best[:, to] == best, keep == best], [DELETE, INSERT, KEEP], REROLE)
        after = np.select([pick == DELETE, pick == KEEP], [np.tile(np.arange(4), (n, 1)), goto], np.tile(to, (n, 1)))
        return pick, after


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), FAR)


class Tracer:
    """One conversation's report, fed message by message in order; it holds no text."""

    def __init__(self, repair: Repair):
        self.repair, self.state, self.audit, self.sha, self.any = repair, START, [], hashlib.sha256(), False
        self.cost = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.before = None

    def _say(self, role: str, text: str) -> None:
        self.sha.update(f"\n{role}:{text}".encode() if self.any else f"{role}:{text}".encode())
        self.any = True

    def _insert(self) -> None:
        self.audit.append("I")
        self.cost += self.repair.costs.insert
        self.state = NEXT[self.state]
        self._say(ROLE[self.state], "")

    def feed(self, turn, role: str, text: str, copies: int, what: int, pick, after) -> None:
        """copies of one message; pick and after are those of its first copy, None for a message seen before."""
        c = self.repair.costs
        if turn is not None:
            self.turns += self.low is None or turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        initial = role[:1]
        self.illegal += (self.before is not None and self.before + initial not in LEGAL) + copies - 1
        self.before = initial
        if what == BLANK or pick is None:
            if what == BLANK:
                self.blank += copies
            else:
                self.duplicate += copies
            self.audit.append("D" * copies)
            self.cost += c.delete * copies
            return
        self.truncated += what == CUT
        while pick[self.state] == INSERT:
            self._insert()
        edit, to = pick[self.state], after[self.state]
        if edit == DELETE:
            self.audit.append("D")
            self.cost += c.delete
        else:
            self.audit.append("K" if edit == KEEP else "R")
            self.cost += (edit == REROLE) * c.rerole + (what == CUT) * c.cut
            self._say(role if edit == KEEP else ROLE[to], text)
            self.state = to
        if copies > 1:
            self.duplicate += copies - 1
            self.audit.append("D" * (copies - 1))
            self.cost += c.delete * (copies - 1)

    def report(self) -> tuple:
        while self.state not in ENDS:
            self._insert()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest()


REPORT = ("gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string")
SEGMENT = ("part int, seg int, turns array<bigint>, roles array<string>, texts array<string>, copies array<int>, whats array<int>, "
           "digests array<binary>, codes array<int>")


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", modulus: int = 20) -> DataFrame:
    """(conv, turn, role, text, copies) after planted damage; nulls in texts of any kind are one space.

    By crc32 of `conv:turn` modulo 20, a message is dropped (0 copies), emptied, loses its end marks, is
    repeated, or becomes the user's.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said(conv), F.lit(":"), said(turn))) % modulus
    body = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(said(text), "[.!?]", "")).when(kind != 0, said(text)).otherwise("")
    return rows.select(F.col(conv).alias("conv"), F.col(turn).cast("bigint").alias("turn"), F.when(kind == 4, "user").otherwise(said(role)).alias("role"),
                       body.alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))


def _what(text: Column) -> Column:
    tail = F.right(F.rtrim(text, F.lit(WHITE)), F.lit(1))
    return F.when(tail == "", BLANK).when(tail.isin(".", "!", "?"), FINE).otherwise(CUT)


def _role_codes(roles: list[str]) -> list[int]:
    return ["sua".find(r[:1]) if r[:1] in ("s", "u", "a") else OTHER for r in roles]


def _new_runs(column) -> np.ndarray:
    """Where a sorted column's value differs from the one before; null is a value."""
    import pyarrow.compute as pc
    a, b = column.slice(0, len(column) - 1), column.slice(1)
    other = pc.or_(pc.xor(pc.is_null(a), pc.is_null(b)), pc.fill_null(pc.not_equal(a, b), False))
    return np.flatnonzero(np.concatenate([[True], other.to_numpy(zero_copy_only=False)]))


class Blocks:
    """Works through a task's sorted rows: reports of whole conversations, segments of the others.

    The first conversation of a task may have begun in another task and the last may go on in one; a
    conversation longer than a block is handed on in segments as well.
    """

    def __init__(self, part: int, repair: Repair, block_rows: int, block_bytes: int):
        self.part, self.repair, self.block_rows, self.block_bytes = part, repair, block_rows, block_bytes
        self.held, self.rows, self.bytes, self.seg = [], 0, 0, 0
        self.open, self.open_conv = True, ANY          # whether the first held conversation is one of several segments

    def take(self, batch):
        self.held.append(batch)
        self.rows += batch.num_rows
        self.bytes += batch.column("text").nbytes
        if self.rows >= self.block_rows or self.bytes >= self.block_bytes:
            yield from self.flush(False)

    def flush(self, final: bool):
        import pyarrow as pa
        if not self.rows:
            return
        table = pa.Table.from_batches(self.held).combine_chunks()
        conv = table.column("conv").combine_chunks()
        begin = _new_runs(conv)
        first_open = self.open and (self.open_conv is ANY or conv[0].as_py() == self.open_conv)
        whole_from = int(begin[1]) if first_open and len(begin) > 1 else table.num_rows if first_open else 0
        last = int(begin[-1])
        cut_last = final or table.num_rows - last >= self.block_rows or table.column("text").slice(last).nbytes >= self.block_bytes
        closed = table.slice(whole_from, max(0, last - whole_from))
        if closed.num_rows:
            yield self._reports(closed)
        if first_open and len(begin) > 1:
            yield self._segment(table.slice(0, whole_from))
        if cut_last:
            yield self._segment(table.slice(last))
            self.open, self.open_conv = True, conv[last].as_py()
            self.held, self.rows, self.bytes = [], 0, 0
        else:
            rest = table.slice(last)
            self.open, self.open_conv = first_open and len(begin) == 1, self.open_conv if len(begin) == 1 else None
            self.held, self.rows, self.bytes = rest.to_batches(), rest.num_rows, rest.column("text").nbytes

    def _reports(self, table) -> dict:
        conv = table.column("conv").combine_chunks()
        begin = _new_runs(conv)
        turns, roles, texts, copies, whats = (table.column(c).to_pylist() for c in ("turn", "role", "text", "copies", "what"))
        alive, ends = [], []
        for a, b in zip(begin.tolist(), begin.tolist()[1:] + [len(roles)]):
            seen = set()
            for r in range(a, b):
                if copies[r] and whats[r] != BLANK and (roles[r], texts[r]) not in seen:
                    seen.add((roles[r], texts[r]))
                    alive.append(r)
            ends.append(len(alive))
        codes = _codes(roles, whats, alive)
        last = np.zeros(len(codes), bool)
        last[np.array([e for e, before in zip(ends, [0] + ends) if e > before], np.int64) - 1] = True
        behind, _ = self.repair.backward(codes, last, self.repair.end)
        pick, after = (x.tolist() for x in self.repair.choices(codes, behind))
        out, k = [], 0
        for a, b in zip(begin.tolist(), begin.tolist()[1:] + [len(roles)]):
            tracer = Tracer(self.repair)
            for r in range(a, b):
                first = k < len(alive) and alive[k] == r
                if copies[r]:
                    tracer.feed(turns[r], roles[r], texts[r], copies[r], whats[r], pick[k] if first else None, after[k] if first else None)
                k += first
            out.append(tracer.report())
        return {"conv": conv.take(_pa(begin)), "reports": out}

    def _segment(self, table) -> dict:
        roles, texts, copies, whats = (table.column(c).to_pylist() for c in ("role", "text", "copies", "what"))
        digests = [hashlib.sha256(f"{r}\0{t}".encode()).digest() for r, t in zip(roles, texts)]
        self.seg += 1
        return {"conv": table.column("conv").combine_chunks().slice(0, 1), "segment": [
            self.part, self.seg, table.column("turn").to_pylist(), roles, texts, copies, whats, digests, _codes(roles, whats, range(len(roles))).tolist()]}


def _codes(roles: list[str], whats: list[int], at) -> np.ndarray:
    code = _role_codes([roles[r] for r in at])
    return np.array([2 * c + (whats[r] == CUT) for c, r in zip(code, at)], np.int64)


def _pa(values, kind=None):
    import pyarrow as pa
    return pa.array(values, kind)


def _empty_cells(arrow, n: int) -> dict:
    import pyarrow as pa
    return {f.name: pa.nulls(n, f.type) for f in arrow}


def first_pass(rows: DataFrame, repair: Repair, block_rows: int, block_bytes: int) -> DataFrame:
    """Reports of the conversations that lie inside a task, and the segments of the others (seg is not null).

    One shuffle by ranges of conversation, turn, role, text and row, so no conversation and no group of
    equal messages is bound to one task.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    rows = rows.withColumns({"what": _what(F.col("text")), "_text": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})
    order = ["conv", "turn", "role", "_text", "_row"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("_text", "_row")
    kind = rows.schema["conv"].dataType
    schema = T.StructType([T.StructField("conv", kind), *T._parse_datatype_string(REPORT).fields, *T._parse_datatype_string(SEGMENT).fields])
    arrow = to_arrow_schema(schema, prefers_large_types=False)
    report, segment = ([f.name for f in T._parse_datatype_string(x).fields] for x in (REPORT, SEGMENT))

    def shaped(found: dict):
        cells = _empty_cells(arrow, len(found["conv"]))
        cells["conv"] = found["conv"]
        if "reports" in found:
            for name, values in zip(report, zip(*found["reports"])):
                cells[name] = pa.array(values, arrow.field(name).type)
        else:
            for name, value in zip(segment, found["segment"]):
                cells[name] = pa.array([value], arrow.field(name).type)
        return pa.RecordBatch.from_arrays([cells[f.name].cast(f.type) for f in arrow], schema=arrow)

    def run(batches):
        from pyspark import TaskContext
        blocks = Blocks(TaskContext.get().partitionId(), repair, block_rows, block_bytes)
        for batch in batches:
            for a, b in text_slices(batch.column(3)):
                for at in range(a, b, block_rows):
                    for found in blocks.take(batch.slice(at, min(block_rows, b - at))):
                        yield shaped(found)
        for found in blocks.flush(True):
            yield shaped(found)

    bound_batches(rows)
    return written(rows.select("conv", "turn", "role", "text", "copies", "what").mapInArrow(run, schema))


def settled(segments: DataFrame, repair: Repair, fixups: int = FIXUPS) -> DataFrame:
    """(conv, part, seg, alive, tail): the messages of a segment that are new and not blank, and the vector behind them.

    Messages seen before in another segment are found by the least place of each digest. Then every
    segment runs back from a guess, and again from the head of the next one, until no head changes. If
    some still change after `fixups` passes (messages that pass any vector on), matrices of all segments
    are joined with those behind them by doubling.
    """
    spot = F.struct("part", "seg", "pos")
    each = segments.select("conv", "part", "seg", F.posexplode(F.arrays_zip("digests", "copies", "whats", "codes")).alias("pos", "m"))
    each = each.where(f"m.copies > 0 and m.whats <> {BLANK}")
    first = each.groupBy("conv", F.col("m.digests").alias("digest")).agg(F.min(F.struct(spot.alias("at"), F.col("m.codes").alias("code"))).alias("f"))
    alive = first.groupBy("conv", "f.at.part", "f.at.seg").agg(F.sort_array(F.collect_list(F.struct("f.at.pos", "f.code"))).alias("m"))
    later = Window.partitionBy("conv").orderBy("part", "seg")
    chain = alive.select("conv", "part", "seg", F.col("m.pos").alias("alive"), F.col("m.code").alias("codes"), F.lead(F.struct("part", "seg")).over(later).alias("next"))
    end = F.lit(repair.end.tolist()).cast("array<int>")
    rows = written(_run_back(chain.withColumn("tail", end), repair))
    for _ in range(fixups):
        moved = rows.select(F.struct("part", "seg").alias("next"), F.col("head").alias("_tail"))
        rows = rows.join(moved, "next", "left").withColumn("_tail", F.coalesce("_tail", end))
        rows = written(rows.withColumns({"again": F.col("_tail") != F.col("tail"), "tail": F.col("_tail")}).drop("_tail"))
        if rows.where("again").isEmpty():
            return rows.select("conv", "part", "seg", "alive", "tail")
        rows = written(_run_back(rows.where("again").drop("again", "head"), repair).unionByName(rows.where("not again").drop("again")))
    return _doubled(rows, repair)


def _run_back(rows: DataFrame, repair: Repair) -> DataFrame:
    """Adds head, the vector before a segment, from its codes and the vector behind it."""
    schema = T.StructType([*rows.schema.fields, T.StructField("head", T.ArrayType(T.IntegerType()))])
    codes, tail = rows.columns.index("codes"), rows.columns.index("tail")

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            heads = []
            for c, t in zip(batch.column(codes).to_pylist(), batch.column(tail).to_pylist()):
                heads.append(repair.backward(np.array(c, np.int64), np.zeros(len(c), bool), np.array(t, np.int64))[1].tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(heads, pa.list_(pa.int32()))], names=[*batch.schema.names, "head"])

    return rows.mapInArrow(run, schema)


def _doubled(rows: DataFrame, repair: Repair) -> DataFrame:
    """The vectors behind all segments from their matrices: each round joins a segment's with that of the first one behind."""
    kept = rows.select("conv", "part", "seg", "alive", F.col("next").alias("behind"))
    schema = T.StructType([*(rows.schema[c] for c in ("part", "seg", "next")), T.StructField("m", T.ArrayType(T.IntegerType()))])

    def matrices(batches):
        import pyarrow as pa
        for batch in batches:
            m = [repair.response(np.array(c, np.int64)).reshape(-1).tolist() for c in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(m, pa.list_(pa.int32()))], names=["part", "seg", "next", "m"])

    chain = written(rows.select("part", "seg", "next", "codes").mapInArrow(matrices, schema))
    cell = lambda i: F.array_min(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.least(F.get("m", F.floor(i / 4) * 4 + k) + F.get("_m", k * 4 + i % 4), F.lit(FAR))))
    while not chain.where("next is not null").isEmpty():
        on = chain.select(F.struct("part", "seg").alias("next"), F.col("m").alias("_m"), F.col("next").alias("_next"))
        both = chain.join(on, "next", "left")
        joined = F.when(F.col("_m").isNull(), F.col("m")).otherwise(F.transform(F.sequence(F.lit(0), F.lit(15)), cell))
        chain = written(both.select("part", "seg", F.col("_next").alias("next"), joined.cast("array<int>").alias("m")))
    end = [int(x) for x in repair.end]
    head = F.array(*[F.least(*[F.get("m", F.lit(4 * q + k)) + end[k] for k in range(4)]) for q in range(4)])
    heads = chain.select(F.struct("part", "seg").alias("behind"), F.transform(head, lambda x: x - F.array_min(head)).cast("array<int>").alias("tail"))
    rows = kept.join(heads, "behind", "left")
    return rows.select("conv", "part", "seg", "alive", F.coalesce("tail", F.lit(end).cast("array<int>")).alias("tail"))


def stitched(segments: DataFrame, repair: Repair) -> DataFrame:
    """Reports of the conversations in several segments.

    A digest of a whole conversation can only be taken in order, so its segments stream through one task,
    which holds one of them at a time.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    lists = ["turns", "roles", "texts", "copies", "whats", "codes"]
    facts = settled(segments.drop("texts", "turns", "roles"), repair).select(
        "conv", "part", "seg", F.lit(0).alias("kind"), "alive", "tail", *[F.lit(None).cast(segments.schema[c].dataType).alias(c) for c in lists])
    none = F.lit(None).cast("array<int>")
    rows = facts.unionByName(segments.select("conv", "part", "seg", F.lit(1).alias("kind"), none.alias("alive"), none.alias("tail"), *lists))
    rows = rows.repartition("conv").sortWithinPartitions("conv", "part", "seg", "kind")
    schema = T.StructType([T.StructField("conv", rows.schema["conv"].dataType), *T._parse_datatype_string(REPORT).fields])
    arrow = to_arrow_schema(schema, prefers_large_types=False)

    def run(batches):
        tracer = conv = fact = None

        def done():
            cells = [pa.array([conv], arrow.field(0).type), *(pa.array([x], arrow.field(i + 1).type) for i, x in enumerate(tracer.report()))]
            return pa.RecordBatch.from_arrays(cells, schema=arrow)

        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(k)[i].as_py() for k, c in enumerate(batch.schema.names)}
                if tracer is None or row["conv"] != conv:
                    if tracer is not None:
                        yield done()
                    tracer, conv, fact = Tracer(repair), row["conv"], None
                if row["kind"] == 0:
                    fact = (row["part"], row["seg"], row["alive"], row["tail"])
                    continue
                alive, tail = fact[2:] if fact and fact[:2] == (row["part"], row["seg"]) else ([], repair.end)
                codes = np.array([row["codes"][r] for r in alive], np.int64)
                behind, _ = repair.backward(codes, np.zeros(len(codes), bool), np.array(tail, np.int64))
                pick, after = (x.tolist() for x in repair.choices(codes, behind))
                place = {r: k for k, r in enumerate(alive)}
                for r, n in enumerate(row["copies"]):
                    if n:
                        k = place.get(r)
                        tracer.feed(row["turns"][r], row["roles"][r], row["texts"][r], n, row["whats"][r], None if k is None else pick[k], None if k is None else after[k])
        if tracer is not None:
            yield done()

    return rows.mapInArrow(run, schema)


def repair_conversations(rows: DataFrame, costs: Costs = Costs(), conv: str = "conv_id", block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per conversation of rows (conv, turn, role, text, copies): faults, cheapest edits and a digest.

    (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256). Messages stand in
    order of turn, nulls first; those of one turn in order of role and a hash of their text, so repeated
    rows are neighbours. copies = 0 marks a message that is gone: its conversation is still reported. A
    conversation without messages has zeros, no edits and the digest of an empty text. Null ids are one
    conversation. A role whose initial is none of s, u and a, or an empty one, stands nowhere. An empty
    table gives no rows.
    """
    repair = Repair(costs)
    found = first_pass(rows, repair, block_rows, block_bytes)
    names = [f.name for f in T._parse_datatype_string(REPORT).fields]
    whole = found.where("seg is null").select("conv", *names)
    return whole.unionByName(stitched(found.where("seg is not null"), repair).select("conv", *names)).withColumnRenamed("conv", conv)
