"""Conversation structure repair: cheapest edits by bidirectional Dijkstra over the edit lattice.

A node of the lattice is a row number and what the kept roles spell so far: nothing yet, a system
turn, or a user or an assistant turn at the end. Edits are its edges: Keep, Rerole and Delete
consume a row, Insert none. One heap grows from the start, one from the accepting ends. When both
together exceed the best crossing, every edge that can lie on a cheapest way runs between a node
settled in front and one settled behind; of all cheapest crossings the one with the least audit is
taken. At one node audits of equal cost never start with each other, since an Insert costs, so the
least part is part of the least whole.

Texts are not collected: rows are sorted by conversation inside hash partitions and read as a
stream. A conversation costs a task one byte per row until it is solved. Short ones are hashed on
the spot; a long one is solved first and its sorted texts are hashed in a second stream. SHA-256
goes through a conversation's texts in order, so one task reads them, in constant memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetwitness.llm.common import Steps, stored

EMPTY, SYSTEM, USER, ASSISTANT = range(4)
#: What may follow: state -> {initial: next state}. Start and after an assistant turn are accepting.
_STEPS = {EMPTY: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
_ACCEPT = (EMPTY, ASSISTANT)
_COST = {"K": 0, "R": 3, "D": 4, "I": 3}
TRUNCATED = 3
#: Rows of a row code: initial (``s``, ``u``, ``a``, ``-`` for an empty role, ``x`` for any other) plus fault.
_INITIALS, SOUND, CUT, GONE = "sua-x", 0, 1, 2
#: Longer conversations are solved in pieces of so many rows.
PIECE = 256
#: Conversations up to this size are hashed where they are solved.
SHORT_ROWS, SHORT_BYTES = 2_000, 4 << 20
#: So many repeated turns are broadcast; more are joined by shuffle.
FEW_REPEATS = 200_000


def row_code(initial: str, fault: int) -> int:
    return _INITIALS.index(initial) * 3 + fault


def _edges(codes: bytes, at: int, state: int) -> Iterator[tuple[str, int, int, int]]:
    """(edit, cost, next row, next state) from a node."""
    for initial, to in _STEPS[state].items():
        if initial != "s":
            yield "I", _COST["I"], at, to
    if at == len(codes):
        return
    initial, fault = _INITIALS[codes[at] // 3], codes[at] % 3
    yield "D", _COST["D"], at + 1, state
    if fault == GONE:
        return
    extra = TRUNCATED if fault == CUT else 0
    if initial == "-":
        yield "K", extra, at + 1, state
    elif initial in _STEPS[state]:
        yield "K", extra, at + 1, _STEPS[state][initial]
    for role, to in _STEPS[state].items():
        if role != "s":
            yield "R", _COST["R"] + extra, at + 1, to


def _edges_into(codes: bytes, at: int, state: int) -> Iterator[tuple[str, int, int, int]]:
    """(edit, cost, row before, state before) into a node."""
    for before in range(4):
        for row in (at, at - 1):
            if row >= 0:
                for edit, cost, to_row, to_state in _edges(codes, row, before):
                    if to_row == at and to_state == state:
                        yield edit, cost, row, before


def cheapest(codes: bytes, start: int, ends: tuple[int, ...]) -> tuple[int, str] | None:
    """Cost and least audit of the cheapest way from ``start`` through all rows to one of ``ends``."""
    last = len(codes)
    front: dict[tuple[int, int], tuple[int, str]] = {}
    back: dict[tuple[int, int], tuple[int, str]] = {}
    # Equal costs are settled in the order of rows, so an edit without cost finds its best part settled.
    tips = {(0, start): (0, "")}
    tails = {(last, end): (0, "") for end in ends}
    ahead: list = [(0, 0, start)]
    behind: list = [(0, -last, end) for end in ends]
    behind.sort()
    best: int | None = None
    while ahead and behind and (best is None or ahead[0][0] + behind[0][0] <= best):
        if ahead[0][0] <= behind[0][0]:
            cost, row, state = heappop(ahead)
            node = (row, state)
            if node in front:
                continue
            front[node] = done = tips[node]
            if node in tails:
                total = cost + tails[node][0]
                best = total if best is None else min(best, total)
            for edit, price, to_row, to_state in _edges(codes, row, state):
                to, label = (to_row, to_state), (cost + price, done[1] + edit)
                if to not in front and (to not in tips or label < tips[to]):
                    tips[to] = label
                    heappush(ahead, (label[0], to_row, to_state))
        else:
            cost, row, state = heappop(behind)
            node = (-row, state)
            if node in back:
                continue
            back[node] = done = tails[node]
            if node in tips:
                total = cost + tips[node][0]
                best = total if best is None else min(best, total)
            for edit, price, from_row, from_state in _edges_into(codes, -row, state):
                to, label = (from_row, from_state), (cost + price, edit + done[1])
                if to not in back and (to not in tails or label < tails[to]):
                    tails[to] = label
                    heappush(behind, (label[0], -from_row, from_state))
    if best is None:
        return None
    # An end that the front has settled needs no settled tail; every other way has a crossing edge.
    crossings = [front[(last, end)][1] for end in ends if front.get((last, end), (None,))[0] == best]
    for (row, state), (cost, audit) in front.items():
        for edit, price, to_row, to_state in _edges(codes, row, state):
            other = back.get((to_row, to_state))
            if other is not None and cost + price + other[0] == best:
                crossings.append(audit + edit + other[1])
    return best, min(crossings)


def repair(codes: bytes) -> tuple[int, str]:
    """Cost and audit of the cheapest repair; a long conversation is put together from pieces."""
    if len(codes) <= PIECE:
        return cheapest(codes, EMPTY, _ACCEPT)
    ways: dict[int, tuple[int, str]] = {EMPTY: (0, "")}
    for at in range(0, len(codes), PIECE):
        piece, after = codes[at : at + PIECE], {}
        for state, (cost, audit) in ways.items():
            for end in range(4):
                way = cheapest(piece, state, (end,))
                if way is not None:
                    label = (cost + way[0], audit + way[1])
                    if end not in after or label < after[end]:
                        after[end] = label
        ways = after
    return min(ways[end] for end in _ACCEPT if end in ways)


def repaired_lines(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[str]:
    """``role:text`` of every row that the audit leaves, in order; ``rows`` gives (role, text)."""
    state = EMPTY
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit == "K":
            state = _STEPS[state][role[0]] if role else state
            yield f"{role}:{text}"
        else:
            to = "u" if "u" in _STEPS[state] else "a"
            state = _STEPS[state][to]
            yield f"{'user' if to == 'u' else 'assistant'}:{text}"


class _Hash:
    """SHA-256 of lines joined by line feeds."""

    def __init__(self) -> None:
        self.sum, self.first = hashlib.sha256(), True

    def add(self, line: str) -> None:
        if not self.first:
            self.sum.update(b"\n")
        self.first = False
        self.sum.update(line.encode("utf-8", "surrogatepass"))


def damaged(rows: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """The rows after damage: ``conv, turn, role, text, gone``; dropped rows stay as marks (``gone``).

    Nulls of role and text, and in the key that decides, are one space.
    """
    blank = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    draw = F.crc32(F.concat(blank(conv_id), F.lit(":"), blank(turn)).cast("binary")) % 20
    new = F.when(draw == 1, "").when(draw == 2, F.regexp_replace(blank(text), "[.!?]", "")).otherwise(blank(text))
    out = rows.select(
        F.col(conv_id).alias("conv"), F.col(turn).cast("bigint").alias("turn"),
        F.when(draw == 4, "user").otherwise(blank(role)).alias("role"), new.alias("text"),
        (draw == 0).alias("gone"), F.explode(F.array_repeat(F.lit(0), F.when(draw == 3, 2).otherwise(1))).alias("_copy"),
    )
    return out.drop("_copy")


def _faults(rows: DataFrame, steps: Steps) -> DataFrame:
    """Adds ``key`` (conversation, role and text), ``first_turn`` where the key is repeated, and ``cut``."""
    key = F.unhex(F.sha2(F.to_json(F.struct("conv", "role", "text"), {"ignoreNullFields": "false"}), 256))
    keyed = rows.withColumn("key", F.when(~F.col("gone"), key))
    counts = keyed.where("NOT gone").groupBy("key").agg(F.min(F.struct("turn")).alias("first"), F.count(F.lit(1)).alias("n"))
    repeats = steps.keep(counts.where("n > 1").select("key", F.col("first.turn").alias("first_turn"), F.lit(True).alias("again")), "repeats")
    if repeats.count() <= FEW_REPEATS:
        repeats = F.broadcast(repeats)
    body = F.rtrim(F.translate("text", "\t\n\x0b\x0c\r", "     "))
    last = F.right(body, F.lit(1))
    return keyed.join(repeats, "key", "left").withColumns(
        {"blank": body == "", "cut": ~last.isin(".", "!", "?"), "again": F.coalesce("again", F.lit(False))}
    )


class _Conversation:
    """What a task holds of the conversation it reads."""

    def __init__(self, conv) -> None:
        self.conv, self.codes, self.rows, self.bytes = conv, bytearray(), [], 0
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.initial, self.key, self.turns, self.low, self.high, self.turn = None, None, 0, None, None, None

    def add(self, turn, role, text, key, first_turn, again, blank, cut) -> None:
        if turn is not None and turn != self.turn:
            self.turns += 1
            self.low, self.high, self.turn = turn if self.low is None else self.low, turn, turn
        # Equal rows of one turn are neighbours.
        repeated = again and (turn != first_turn or key == self.key)
        self.key = key
        fault = GONE if blank or repeated else CUT if cut else SOUND
        self.blank += blank
        self.duplicate += not blank and repeated
        self.truncated += fault == CUT
        initial = role[:1]
        if self.initial is not None:
            self.illegal += self.initial + initial not in ("su", "ua", "au")
        self.initial = initial
        self.codes.append(row_code(initial if initial in ("s", "u", "a") else "x" if initial else "-", fault))
        if self.rows is not None:
            self.bytes += len(text)
            self.rows.append((role, text))
            if len(self.rows) > SHORT_ROWS or self.bytes > SHORT_BYTES:
                self.rows = None

    def result(self) -> tuple:
        cost, audit = repair(bytes(self.codes))
        digest = None
        if self.rows is not None:
            whole = _Hash()
            for line in repaired_lines(audit, iter(self.rows)):
                whole.add(line)
            digest = whole.sum.hexdigest()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit, digest


_RESULT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
_RESULT_NAMES = ["conv", *(part.split()[0] for part in _RESULT.split(", "))]


def _table(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 9
    kinds = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=_RESULT_NAMES)


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows to one row per conversation; a long one's hash stays null."""
    now, kind = None, None
    for batch in batches:
        kind, out = batch.schema.field("conv").type, []
        for conv, gone, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is None or conv != now.conv:
                if now is not None:
                    out.append(now.result())
                now = _Conversation(conv)
            if not gone:
                now.add(*row)
        if out:
            yield _table(out, kind)
    if now is not None:
        yield _table([now.result()], kind)


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows, each conversation's audit before its texts, to (conv, hash)."""
    audit, at, state, whole, conv, kind = "", 0, EMPTY, None, None, None
    out: list[tuple] = []

    def inserts() -> None:
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            apply("I", "", "")
            at += 1

    def apply(edit: str, role: str, text: str) -> None:
        nonlocal state
        if edit == "D":
            return
        if edit == "K":
            state = _STEPS[state][role[0]] if role else state
        else:
            role = "user" if "u" in _STEPS[state] else "assistant"
            state = _STEPS[state][role[0]]
        whole.add(f"{role}:{text}")

    def finish() -> None:
        inserts()
        out.append((conv, whole.sum.hexdigest()))

    for batch in batches:
        kind = batch.schema.field("conv").type
        for key, own, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv", "own_audit", "role", "text")), strict=True):
            if own is not None:
                if whole is not None:
                    finish()
                audit, at, state, whole, conv = own, 0, EMPTY, _Hash(), key
            else:
                inserts()
                apply(audit[at], role, text)
                at += 1
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], kind), pa.array([o[1] for o in out], pa.string())], names=["conv", "sha"])
            out = []
    if whole is not None:
        finish()
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], kind), pa.array([o[1] for o in out], pa.string())], names=["conv", "sha"])


def _order(*names: str) -> list[Column]:
    return [F.col(n).asc_nulls_first() for n in names]


def repair_conversations(
    rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", damage: bool = True
) -> DataFrame:
    """One row per conversation: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256``.

    With ``damage`` the rows are damaged first (see ``damaged``). Rows are taken by turn, nulls
    first; rows of one turn by role and text. A row's first fault counts: blank, duplicate (role and
    text seen earlier in the conversation), truncated. Keep costs 0, Rerole to user or assistant 3,
    Delete 4 (required for blank and duplicate rows), Insert of an empty user or assistant turn 3; a
    truncated row that stays adds 3. The roles' initials must then spell ``(s?(ua)+)?``; an empty
    role spells nothing. The cheapest edits win, ties by the least audit.

    Nulls of role and text are one space; a null ``conv_id`` is a conversation of its own. Repeated
    rows are duplicates of each other. A conversation without rows after damage has zeros, an empty
    audit and the hash of the empty string. An empty table gives no rows. Columns other than the
    four named are not read, whatever their names.
    """
    steps = Steps(rows.sparkSession)
    if damage:
        now = damaged(rows, conv_id, turn, role, text)
    else:
        blank = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
        now = rows.select(
            F.col(conv_id).alias("conv"), F.col(turn).cast("bigint").alias("turn"), blank(role).alias("role"), blank(text).alias("text"),
            F.lit(False).alias("gone"),
        )
    kind = now.schema["conv"].dataType.simpleString()
    faults = _faults(now, steps)
    order = ["conv", "gone", "turn", "role", "text"]
    spread = faults.repartition("conv").sortWithinPartitions(*_order(*order))
    names = ["conv", "gone", "turn", "role", "text", "key", "first_turn", "again", "blank", "cut"]
    solved = steps.keep(spread.select(*names).mapInArrow(_solve, f"conv {kind}, {_RESULT}"), "solved")
    long = solved.where("repaired_sha256 IS NULL").select("conv", "audit")
    if not long.isEmpty():
        # Their rows, each conversation's audit first.
        theirs = now.where("NOT gone").join(long.select(F.col("conv").alias("c")), F.col("conv").eqNullSafe(F.col("c")), "left_semi")
        marks = long.select("conv", F.lit(None).cast("bigint").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.col("audit").alias("own_audit"))
        both = marks.unionByName(theirs.select("conv", "turn", "role", "text").withColumn("own_audit", F.lit(None).cast("string")))
        both = both.withColumn("data", F.col("own_audit").isNull())
        stream = both.repartition("conv").sortWithinPartitions(*_order("conv", "data", "turn", "role", "text"))
        sums = steps.keep(stream.mapInArrow(_hash, f"conv {kind}, sha string"), "sums").withColumnRenamed("conv", "c")
        solved = solved.join(sums, F.col("conv").eqNullSafe(F.col("c")), "left").withColumn("repaired_sha256", F.coalesce("repaired_sha256", "sha")).drop("c", "sha")
    return stored(solved.withColumnRenamed("conv", conv_id), "repaired")
