"""Conversation structure repair by depth-first branch-and-bound.

A conversation's rows, by turn, become role initials ``(s?(ua)+)?`` through edits: Keep 0, Rerole to user or assistant 2,
Delete 3 (the only edit of a blank row or a repeated one), Insert an empty user or assistant turn 2; a truncated row that
is not deleted adds 1. Of the cheapest edit sequences the one whose initials sort first in ASCII is the audit.

``search`` keeps an explicit stack of prefixes (row, last role, cost, audit), cheapest lower bound on top, and prunes a
prefix by the incumbent (cost, audit) or by a prefix of the same node that is at least as good. Two prefixes of one node
have used the same rows, so neither audit of equal cost starts the other, and the lesser one stays the lesser whatever
follows: dominance is exact. The suffix bounds, from one backward pass over the costs alone, are the least costs of finishing
from a node; with them the first descent is cheapest and the rest of the stack only proves it.

On Spark: rows are range-partitioned and sorted by (conversation, turn, ...) and streamed. A conversation that lies inside
one partition and one piece (``PIECE_ROWS`` rows, ``PIECE_BYTES`` of text) is finished there. Conversations at a partition's
edge or above a piece, so those with a third of all rows too, go on as pieces: first occurrences by a grouped minimum, every
piece searched between each pair of roles at its ends, pieces joined in order (cheapest (cost, audit) per end role), texts
hashed as a stream. No task holds more than a piece of rows; of a whole conversation only its audits (one is a result column)
and one state per piece meet.

Defined cases: null role and text are one space; a null conversation id is one conversation; rows of equal turn (null first)
are taken by role, first 32 characters of the text, and MD5 of it; rows equal in all of these are copies, of which the first is the original.
Empty tables give no rows. Only the four named columns are read, so other columns cannot clash."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobsieve.llm.common import SPACE_CHARS, bounded_slices, materialise, shuffle_width, small_arrow_batches

PIECE_ROWS = 512
PIECE_BYTES = 4 << 20
OPEN, SYSTEM, USER, ASSISTANT = range(4)  # role of the last repaired row; OPEN: none yet
STATES = (OPEN, SYSTEM, USER, ASSISTANT)
FINISHED = (OPEN, ASSISTANT)
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
LEGAL = {"su", "ua", "au"}
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
EMPTY_HASH = hashlib.sha256(b"").hexdigest()

Row = tuple[str, bool, int]  # role initial, must be deleted, cost of staying


def _reply(state: int) -> int:
    """The role that user/assistant turns take next."""
    return ASSISTANT if state == USER else USER


def _edits(row: Row, state: int) -> list[tuple[int, str, int]]:
    """(cost, letter, role after) of the edits that use up ``row``."""
    initial, doomed, stay = row
    edits = [(DELETE, "D", state)]
    if not doomed:
        after = _reply(state)
        if initial == ("a" if after == ASSISTANT else "u"):
            edits.append((stay, "K", after))
        elif initial == "s" and state == OPEN:
            edits.append((stay, "K", SYSTEM))
        edits.append((REROLE + stay, "R", after))
    return edits


def suffix_bounds(rows: list[Row], ends: tuple[int, ...]) -> list[list[float]]:
    """Least cost of finishing in one of ``ends`` from every (row, state)."""
    def with_inserts(cost: list[float]) -> list[float]:
        once = [min(cost[s], INSERT + cost[_reply(s)]) for s in STATES]
        return [min(once[s], INSERT + once[_reply(s)]) for s in STATES]

    bounds = [with_inserts([0 if s in ends else float("inf") for s in STATES])]
    for row in reversed(rows):
        rest = bounds[-1]
        bounds.append(with_inserts([min(c + rest[to] for c, _, to in _edits(row, s)) for s in STATES]))
    return bounds[::-1]


def search(rows: list[Row], start: int = OPEN, ends: tuple[int, ...] = FINISHED) -> tuple[int, str] | None:
    """The least (cost, audit) that leads from ``start`` through ``rows`` to one of ``ends``; None if there is none."""
    bounds, n = suffix_bounds(rows, ends), len(rows)
    incumbent: tuple[float, str] = (float("inf"), "")
    best_at: dict[tuple[int, int], tuple[int, str]] = {}
    stack = [(0, start, 0, "")]
    while stack:
        i, state, cost, audit = stack.pop()
        bound = cost + bounds[i][state]
        if bound > incumbent[0] or bound == float("inf") or (bound == incumbent[0] and audit > incumbent[1][:len(audit)]):
            continue
        if (i, state) in best_at and best_at[i, state] <= (cost, audit):
            continue
        best_at[i, state] = (cost, audit)
        if i == n and state in ends:
            incumbent = min(incumbent, (cost, audit))
        after = [(i, _reply(state), cost + INSERT, audit + "I")]
        if i < n:
            after += [(i + 1, to, cost + c, audit + letter) for c, letter, to in _edits(rows[i], state)]
        after.sort(key=lambda p: (p[2] + bounds[p[0]][p[1]], p[3]), reverse=True)
        stack += after
    return None if incumbent[0] == float("inf") else (int(incumbent[0]), incumbent[1])


def repaired(rows: list[tuple[str, str]], audit: str, state: int = OPEN) -> Iterator[tuple[str, str, str]]:
    """(role, text, edit) of the rows that ``audit`` leaves, from the role before them on."""
    left = iter(rows)
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(left)
        if letter == "D":
            continue
        if letter == "K":
            state = SYSTEM if role[:1] == "s" else _reply(state)
        else:
            state = _reply(state)
            role = "assistant" if state == ASSISTANT else "user"
        yield role, text, letter


class Faults:
    """First faults of rows in order, and the counts that need no search."""

    def __init__(self, turns: list[int | None], roles: list[str], texts: list[str], repeated: list[bool]):
        self.rows: list[Row] = []
        self.blank = self.duplicate = self.truncated = 0
        for role, text, again in zip(roles, texts, repeated):
            end = text.rstrip(SPACE_CHARS)[-1:]
            late = 0
            if not end:
                self.blank += 1
            elif again:
                self.duplicate += 1
            elif end not in ".!?":
                self.truncated += 1
                late = TRUNCATED
            self.rows.append((role[:1], not end or again, late))
        self.illegal = sum(a[:1] + b[:1] not in LEGAL for a, b in zip(roles, roles[1:]))
        self.turns = [t for t in turns if t is not None]
        self.distinct = len(set(self.turns))


def gaps(low: int | None, high: int | None, distinct: int) -> int:
    return 0 if low is None else high - low + 1 - distinct


def _hash_lines(lines: Iterator[tuple[str, str, str]]) -> str:
    h, first = hashlib.sha256(), True
    for role, text, _ in lines:
        h.update(f"{'' if first else chr(10)}{role}:{text}".encode())
        first = False
    return h.hexdigest()


# ---- rows in order --------------------------------------------------------------------------------------------

REPORT = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
ORDER = ["conv_id", "turn", "role", "head", "digest"]


def _in_order(conversations: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(" "))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
                                text.alias("text"), F.substring(text, 1, 32).alias("head"), F.unhex(F.md5(F.encode(text, "UTF-8"))).alias("digest"))
    return rows.repartitionByRange(shuffle_width(rows.sparkSession), *ORDER).sortWithinPartitions(*ORDER).drop("head")


class _Conversation:
    """Rows of one conversation, as far as they were read."""

    def __init__(self, conv_id, whole: bool):
        self.conv_id, self.whole, self.rows, self.size = conv_id, whole, [], 0

    def add(self, row):
        self.rows.append(row)
        self.size += len(row[2])


_STREAM = pa.schema([("done", pa.bool_()), ("conv_id", pa.int64()), *[(c, pa.int64()) for c in COUNTS], ("audit", pa.string()), ("repaired_sha256", pa.string()),
                     ("seg", pa.int64()), ("pos", pa.int32()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("digest", pa.binary()), ("edit", pa.string())])
_STREAM_DDL = ("done boolean, conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string, "
               "seg bigint, pos int, turn bigint, role string, text string, digest binary, edit string")


def _solve_whole(conv_id, rows: list[tuple], with_turns: bool) -> list[dict]:
    seen: set[tuple[str, bytes]] = set()
    repeated = []
    for _, role, _, digest in rows:
        repeated.append((role, digest) in seen)
        seen.add((role, digest))
    turns, roles, texts = [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]
    f = Faults(turns, roles, texts, repeated)
    cost, audit = search(f.rows)
    lines = list(repaired(list(zip(roles, texts)), audit))
    out = [{"done": True, "conv_id": conv_id, "gaps": gaps(f.turns[0] if f.turns else None, f.turns[-1] if f.turns else None, f.distinct), "blank": f.blank,
            "duplicate": f.duplicate, "truncated": f.truncated, "illegal": f.illegal, "cost": cost, "audit": audit, "repaired_sha256": _hash_lines(iter(lines))}]
    if with_turns:
        out += [{"done": True, "conv_id": conv_id, "pos": i, "role": r, "text": t, "edit": e} for i, (r, t, e) in enumerate(lines)]
    return out


def _first_pass(conversations: DataFrame, with_turns: bool) -> DataFrame:
    """Finished conversations (``done``; with ``edit`` set: their repaired rows) and the rows of the others in pieces."""
    small_arrow_batches(conversations.sparkSession)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, segments = TaskContext.get().partitionId() << 33, 0
        open_: _Conversation | None = None
        out: list[dict] = []
        size = 0

        def piece(c: _Conversation):
            nonlocal segments, out
            out += [{"done": False, "conv_id": c.conv_id, "seg": base + segments, "pos": i, "turn": t, "role": r, "text": x, "digest": d}
                    for i, (t, r, x, d) in enumerate(c.rows)]
            segments += 1
            c.whole, c.rows, c.size = False, [], 0

        for batch in bounded_slices(batches, "text"):
            for conv_id, *row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "digest"))):
                if open_ is None:
                    open_ = _Conversation(conv_id, False)  # it may have begun in the partition before
                elif open_.conv_id != conv_id:
                    if open_.whole:
                        out += _solve_whole(open_.conv_id, open_.rows, with_turns)
                    else:
                        piece(open_)
                    size += open_.size
                    open_ = _Conversation(conv_id, True)
                elif len(open_.rows) >= PIECE_ROWS or open_.size >= PIECE_BYTES:
                    size += open_.size
                    piece(open_)
                open_.add(row)
                if size > PIECE_BYTES or len(out) > 4096:
                    yield pa.RecordBatch.from_pylist(out, _STREAM)
                    out, size = [], 0
        if open_ is not None:
            piece(open_)  # it may go on in the next partition
        if out:
            yield pa.RecordBatch.from_pylist(out, _STREAM)

    return materialise(_in_order(conversations).mapInArrow(stream, _STREAM_DDL), "conversations")


# ---- conversations in pieces ----------------------------------------------------------------------------------

_PIECE = pa.schema([("conv_id", pa.int64()), ("seg", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()),
                    ("head", pa.string()), ("tail", pa.string()), ("low", pa.int64()), ("high", pa.int64()), ("distinct", pa.int64()),
                    ("moves", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])))])
_PIECE_DDL = ("conv_id bigint, seg bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, head string, tail string, low bigint, high bigint, "
              "distinct bigint, moves array<struct<a:int,b:int,cost:bigint,audit:string>>")


def _search_piece(rows: pa.Table, firsts: pa.Table) -> pa.Table:
    if not rows.num_rows:
        return _PIECE.empty_table()
    rows = rows.sort_by("pos")
    first = set(firsts["pos"].to_pylist())
    roles = rows["role"].to_pylist()
    f = Faults(rows["turn"].to_pylist(), roles, rows["text"].to_pylist(), [p not in first for p in rows["pos"].to_pylist()])
    moves = []
    for a in STATES:
        for b in STATES:
            found = search(f.rows, a, (b,))
            if found:
                moves.append({"a": a, "b": b, "cost": found[0], "audit": found[1]})
    return pa.Table.from_pylist([{"conv_id": rows["conv_id"][0].as_py(), "seg": rows["seg"][0].as_py(), "blank": f.blank, "duplicate": f.duplicate, "truncated": f.truncated,
                                  "illegal": f.illegal, "head": roles[0][:1], "tail": roles[-1][:1], "low": f.turns[0] if f.turns else None,
                                  "high": f.turns[-1] if f.turns else None, "distinct": f.distinct, "moves": moves}], _PIECE)


_JOINED = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in COUNTS], ("audit", pa.string()),
                     ("path", pa.list_(pa.struct([("seg", pa.int64()), ("a", pa.int32()), ("b", pa.int32())])))])
_JOINED_DDL = "conv_id bigint, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", audit string, path array<struct<seg:bigint,a:int,b:int>>"


class _Joined:
    """Pieces of one conversation, joined in order."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.best: dict[int, tuple[int, str]] = {OPEN: (0, "")}
        self.came: list[dict[int, int]] = []  # per piece: end role -> role before
        self.segs: list[int] = []
        self.sums = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.low = self.high = self.tail = None
        self.distinct = 0

    def add(self, p: dict):
        after: dict[int, tuple[int, str]] = {}
        came: dict[int, int] = {}
        for m in p["moves"]:
            if m["a"] in self.best:
                cost, audit = self.best[m["a"]]
                new = (cost + m["cost"], audit + m["audit"])
                if m["b"] not in after or new < after[m["b"]]:
                    after[m["b"]], came[m["b"]] = new, m["a"]
        self.best = after
        self.came.append(came)
        self.segs.append(p["seg"])
        for c in self.sums:
            self.sums[c] += p[c]
        if self.tail is not None and self.tail + p["head"] not in LEGAL:
            self.sums["illegal"] += 1
        self.tail = p["tail"]
        if p["low"] is not None:
            self.distinct += p["distinct"] - (p["low"] == self.high)
            self.low = p["low"] if self.low is None else self.low
            self.high = p["high"]

    def result(self) -> dict:
        (cost, audit), state = min((self.best[s], s) for s in FINISHED if s in self.best)
        path = []
        for seg, came in zip(reversed(self.segs), reversed(self.came)):
            path.append({"seg": seg, "a": came[state], "b": state})
            state = came[state]
        return {"conv_id": self.conv_id, "gaps": gaps(self.low, self.high, self.distinct), **self.sums, "cost": cost, "audit": audit, "path": path[::-1]}


def _by_conversation(rows: DataFrame, *order: str) -> DataFrame:
    return rows.repartition(shuffle_width(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", *order)


def _join_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    open_: _Joined | None = None
    for batch in batches:
        for a in range(0, batch.num_rows, 64):
            for p in batch.slice(a, 64).to_pylist():
                if open_ is None or open_.conv_id != p["conv_id"]:
                    if open_ is not None:
                        yield pa.RecordBatch.from_pylist([open_.result()], _JOINED)
                    open_ = _Joined(p["conv_id"])
                open_.add(p)
    if open_ is not None:
        yield pa.RecordBatch.from_pylist([open_.result()], _JOINED)


_TURN = pa.schema([("conv_id", pa.int64()), ("seg", pa.int64()), ("pos", pa.int32()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])
_TURN_DDL = "conv_id bigint, seg bigint, pos int, role string, text string, edit string"


def _edit_piece(rows: pa.Table, chosen: pa.Table) -> pa.Table:
    rows = rows.sort_by("pos")
    lines = repaired(list(zip(rows["role"].to_pylist(), rows["text"].to_pylist())), chosen["audit"][0].as_py(), chosen["a"][0].as_py())
    conv_id, seg = rows["conv_id"][0].as_py(), rows["seg"][0].as_py()
    return pa.Table.from_pylist([{"conv_id": conv_id, "seg": seg, "pos": i, "role": r, "text": t, "edit": e} for i, (r, t, e) in enumerate(lines)], _TURN)


_HASH = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])


def _hash_turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One hash per conversation over its repaired rows, in order; the state outlives batches."""
    open_, h = None, None
    for batch in bounded_slices(batches, "text"):
        for conv_id, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
            if h is None or open_ != conv_id:
                if h is not None:
                    yield pa.RecordBatch.from_pylist([{"conv_id": open_, "repaired_sha256": h.hexdigest()}], _HASH)
                open_, h = conv_id, hashlib.sha256()
            else:
                h.update(b"\n")
            h.update(f"{role}:{text}".encode())
    if h is not None:
        yield pa.RecordBatch.from_pylist([{"conv_id": open_, "repaired_sha256": h.hexdigest()}], _HASH)


def _second_pass(first: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(report, repaired rows) of the conversations that the first pass left in pieces."""
    rows = first.where("not done").select("conv_id", "seg", "pos", "turn", "role", "text", "digest")
    firsts = rows.groupBy("conv_id", "role", "digest").agg(F.min(F.struct("seg", "pos")).alias("at")).select("at.*")
    pieces = materialise(rows.drop("digest").groupBy("seg").cogroup(firsts.groupBy("seg")).applyInArrow(_search_piece, _PIECE_DDL), "pieces")
    joined = materialise(_by_conversation(pieces, "seg").mapInArrow(_join_pieces, _JOINED_DDL), "joined")
    steps = joined.select(F.explode("path").alias("s")).select("s.*")
    moves = pieces.select("seg", F.explode("moves").alias("m")).select("seg", "m.a", "m.b", "m.audit")
    chosen = steps.join(moves, ["seg", "a", "b"])
    turns = materialise(rows.select("conv_id", "seg", "pos", "role", "text").groupBy("seg").cogroup(chosen.groupBy("seg")).applyInArrow(_edit_piece, _TURN_DDL), "turns")
    hashes = _by_conversation(turns, "seg", "pos").mapInArrow(_hash_turns, "conv_id bigint, repaired_sha256 string")
    report = joined.join(hashes.withColumnRenamed("conv_id", "hashed"), F.col("conv_id").eqNullSafe(F.col("hashed")), "left")
    return report.select("conv_id", *COUNTS, "audit", F.coalesce("repaired_sha256", F.lit(EMPTY_HASH)).alias("repaired_sha256")), turns


def repair_report(conversations: DataFrame) -> DataFrame:
    """One row per conversation of (conv_id, turn, role, text): gaps, faults, cost, audit and hash of the repaired rows."""
    first = _first_pass(conversations, False)
    return first.where("done").select("conv_id", *COUNTS, "audit", "repaired_sha256").unionByName(_second_pass(first)[0])


def repaired_turns(conversations: DataFrame) -> DataFrame:
    """The repaired rows: (conv_id, place, role, text, edit); places rise within a conversation."""
    first = _first_pass(conversations, True)
    done = first.where("done and edit is not null").select("conv_id", F.col("pos").cast("long").alias("place"), "role", "text", "edit")
    rest = _second_pass(first)[1].select("conv_id", (F.col("seg") * 4096 + F.col("pos")).alias("place"), "role", "text", "edit")
    return done.unionByName(rest)


# ---- damaged input --------------------------------------------------------------------------------------------

def damaged(conversations: DataFrame) -> DataFrame:
    """Rows damaged by crc32(``conv_id:turn``) % 20: 0 drops the row, 1 empties its text, 2 removes ``[.!?]``, 3 repeats it,
    4 sets the role to user. Nulls read as one space."""
    def or_space(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.encode(F.concat(or_space("conv_id"), F.lit(":"), or_space("turn")), "UTF-8")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(or_space("text"), "[.!?]", "")).otherwise(or_space("text"))
    rows = conversations.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(or_space("role")).alias("role"), text.alias("text"),
                                F.explode(F.when(kind == 0, F.array()).when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    return rows.drop("copy")


def damage_report(conversations: DataFrame) -> DataFrame:
    """``repair_report`` of the damaged rows, with every original conversation: zeros, no edits and the hash of nothing where
    no row is left."""
    report = repair_report(damaged(conversations)).withColumnRenamed("conv_id", "id")
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    joined = ids.join(report, F.col("conv_id").eqNullSafe(F.col("id")), "left")
    return joined.select("conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in COUNTS], F.coalesce("audit", F.lit("")).alias("audit"),
                         F.coalesce("repaired_sha256", F.lit(EMPTY_HASH)).alias("repaired_sha256"))
