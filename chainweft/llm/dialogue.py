"""Conversation structure repair: a secondary-sorted stream with dynamic programming over edits.

Rows are dealt by conversation and sorted by turn, and each task reads its conversations as one
stream of Arrow batches. A row can be kept (cost 0), get another role (2) or be deleted (3), and
empty rows can be inserted anywhere (2), so that the roles become ``(system? (user assistant)+)?``
at the least cost; equal costs take the edits whose initials come first in ASCII.

Between rows the stream carries four states (nothing yet, after system, user, assistant), each
with its least cost and its place in the order of the four edit strings. A letter of an edit
string decides the state that follows, and every string carried ends with the edit of a row, so
none begins another and the order of two strings stays when both grow. That makes a number per
state enough to break ties exactly. Each row leaves four bytes of back-pointers and its text in
buffers that go to an unnamed file of the task beyond a size, so a conversation of any length
needs little memory but for its edit string, one letter an edit, which is a result.

Rows seen earlier in their conversation are found before, by an aggregate of digests, and come
into the stream as marks that are sorted in front of their turn.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from hashlib import sha256
from tempfile import SpooledTemporaryFile

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = " \t\n\x0b\x0c\r"
RELABEL, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1
#: Bytes of back-pointers and of texts that a conversation holds before they go to a file.
POINTERS_HELD, TEXTS_HELD = 1 << 18, 1 << 22
#: Rows in a batch of repaired rows.
OUT_ROWS = 2_000

START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {SYSTEM: "system", USER: "user", ASSISTANT: "assistant"}
#: What an inserted or relabelled row leads to.
FOLLOWS = (USER, USER, ASSISTANT, USER)
#: Edits of a row with the insertions before it; more than two insertions come back to a state they left.
EDITS = sorted("I" * k + edit for k in range(3) for edit in "DKR")
LEGAL_PAIRS = {"su", "ua", "au"}
_FAR = 1 << 60


def _kept(state: int, initial: str) -> int | None:
    """The state after a row that keeps its role, if it may stand there."""
    if initial == "s":
        return SYSTEM if state == START else None
    if initial == "u":
        return None if state == USER else USER
    return ASSISTANT if initial == "a" and state == USER else None


def _moves(initial: str, doomed: bool, cut_off: bool) -> list[tuple[int, int, int, int]]:
    """(state before, state after, edit, cost) of a row."""
    moves = []
    for before in range(4):
        for code, edit in enumerate(EDITS):
            state, cost = before, INSERT * (len(edit) - 1)
            for _ in edit[1:]:
                state = FOLLOWS[state]
            if edit[-1] == "D":
                moves.append((before, state, code, cost + DELETE))
            elif not doomed:
                after = _kept(state, initial) if edit[-1] == "K" else FOLLOWS[state]
                if after is not None:
                    moves.append((before, after, code, cost + CUT_OFF * cut_off + RELABEL * (edit[-1] == "R")))
    return moves


#: By the initial of the role, whether the row must go and whether it breaks off.
MOVES = {(i, doomed, cut): _moves(i, doomed, cut) for i in ("s", "u", "a", "") for doomed in (False, True) for cut in (False, True)}


class Conversation:
    """One conversation, row by row."""

    def __init__(self, key: str | None) -> None:
        self.key, self.rows = key, 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.first: int | None = None
        self.last: int | None = None
        self.before: tuple[int | None, str, str] | None = None
        self.costs, self.ranks = [0, _FAR, _FAR, _FAR], [0, 1, 2, 3]
        self.pointers = SpooledTemporaryFile(max_size=POINTERS_HELD)  # noqa: SIM115
        self.texts = SpooledTemporaryFile(max_size=TEXTS_HELD)  # noqa: SIM115
        self.marked: set[bytes] = set()
        self.marked_turn: int | None = None

    def mark(self, turn: int | None, digest: bytes) -> None:
        """What the turn may hold that an earlier turn held."""
        if turn != self.marked_turn:
            self.marked.clear()
        self.marked_turn = turn
        self.marked.add(digest)

    def add(self, turn: int | None, role: str, text: str) -> None:
        body = text.strip(BLANK)
        blank = duplicate = cut_off = False
        if not body:
            blank = True
        elif (turn, role, text) == self.before or (self.marked and self.marked_turn == turn and digest_of(role, text) in self.marked):
            duplicate = True
        else:
            cut_off = body[-1] not in ".!?"
        self.blank += blank
        self.duplicate += duplicate
        self.truncated += cut_off
        self.illegal += self.rows > 0 and self.before[1][:1] + role[:1] not in LEGAL_PAIRS
        if turn is not None:
            self.distinct += turn != self.last
            self.first = turn if self.first is None else self.first
            self.last = turn
        self.before, self.rows = (turn, role, text), self.rows + 1
        self._step(role[:1] if role[:1] in ("s", "u", "a") else "", blank or duplicate, cut_off)
        own = (b"", b"") if blank or duplicate else (role.encode(), text.encode())
        self.texts.write(struct.pack("<II", *map(len, own)))
        self.texts.write(own[0])
        self.texts.write(own[1])

    def _step(self, initial: str, doomed: bool, cut_off: bool) -> None:
        best, came = [_FAR << 6] * 4, [0] * 4
        for before, after, code, cost in MOVES[initial, doomed, cut_off]:
            # by cost, then by the edits before, then by the edits here
            value = (self.costs[before] + cost) << 6 | self.ranks[before] << 4 | code
            if value < best[after]:
                best[after], came[after] = value, before
        self.costs = [min(v >> 6, _FAR) for v in best]
        order = sorted(range(4), key=lambda s: (self.costs[s] >= _FAR, best[s] & 63))
        self.ranks = [order.index(s) for s in range(4)]
        self.pointers.write(bytes(came[s] << 4 | best[s] & 15 for s in range(4)))

    def solve(self) -> tuple[int, str]:
        """Cost and initials of the cheapest edits."""
        ends = [(self.costs[s] + INSERT * k, self.ranks[s], s, "I" * k) for s, k in ((START, 0), (SYSTEM, 2), (USER, 1), (ASSISTANT, 0))]
        cost, _, state, tail = min(ends)
        # edits from the last row to the first, in blocks of back-pointers
        codes, block, end = bytearray(self.rows), 1 << 16, self.rows
        while end:
            begin = max(0, end - block)
            self.pointers.seek(4 * begin)
            held = self.pointers.read(4 * (end - begin))
            for k in range(end - begin - 1, -1, -1):
                pointer = held[4 * k + state]
                codes[begin + k], state = pointer & 15, pointer >> 4
            end = begin
        self.pointers.close()
        return cost, "".join(map(EDITS.__getitem__, codes)) + tail

    def repaired(self, edits: str) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of the rows that the repaired conversation has."""
        self.texts.seek(0)
        state = START
        for edit in edits:
            role = text = ""
            if edit != "I":
                sizes = struct.unpack("<II", self.texts.read(8))
                role, text = (self.texts.read(n).decode() for n in sizes)
            if edit == "D":
                continue
            state = _kept(state, role[:1]) if edit == "K" else FOLLOWS[state]
            yield edit, role if edit == "K" else ROLES[state], text
        self.texts.close()

    def gaps(self) -> int:
        return 0 if self.first is None else self.last - self.first + 1 - self.distinct


def digest_of(role: str, text: str) -> bytes:
    return sha256(f"{len(role)}:{role}{text}".encode()).digest()


def _digest(role: Column, text: Column) -> Column:
    return F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))


def _conversations(batches: Iterator[pd.DataFrame]) -> Iterator[Conversation]:
    """Conversations of a task, one after the other; a conversation may go on over any number of batches."""
    now: Conversation | None = None
    for batch in batches:
        for key, known, turn, times, role, text, digest in zip(*(batch[c].tolist() for c in _STREAM), strict=True):
            key = key if isinstance(key, str) else None  # pandas may read a null as NaN
            if now is None or key != now.key:
                if now is not None:
                    yield now
                now = Conversation(key)
            own = turn if known else None
            if isinstance(digest, bytes | bytearray):
                now.mark(own, bytes(digest))
            for _ in range(times):
                now.add(own, role, text)
    if now is not None:
        yield now


_STREAM = ["key", "known", "turn", "times", "role", "text", "digest"]
_REPORT = "key string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_ROWS = "key string, place long, edit string, role string, text string"


def _reports(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows: list[tuple] = []
    columns = [c.split()[0] for c in _REPORT.split(", ")]
    held = 0
    for one in _conversations(batches):
        cost, audit = one.solve()
        digest = sha256()
        for k, (_, role, text) in enumerate(one.repaired(audit)):
            digest.update(f"{chr(10) * (k > 0)}{role}:{text}".encode())
        rows.append((one.key, one.gaps(), one.blank, one.duplicate, one.truncated, one.illegal, cost, audit, digest.hexdigest()))
        held += len(audit)
        if len(rows) >= OUT_ROWS or held > TEXTS_HELD:
            yield pd.DataFrame(rows, columns=columns)
            rows, held = [], 0
    yield pd.DataFrame(rows, columns=columns)


def _repaired_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows: list[tuple] = []
    columns = [c.split()[0] for c in _ROWS.split(", ")]
    held = 0
    for one in _conversations(batches):
        for k, (edit, role, text) in enumerate(one.repaired(one.solve()[1])):
            rows.append((one.key, k, edit, role, text))
            held += len(text)
            if len(rows) >= OUT_ROWS or held > TEXTS_HELD:
                yield pd.DataFrame(rows, columns=columns)
                rows, held = [], 0
    yield pd.DataFrame(rows, columns=columns)


def _stream(turns: DataFrame, times: str | None) -> DataFrame:
    """Rows by conversation and turn, with marks of repeats in front of their turn."""
    spoken = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    rows = turns.select(
        F.col("conv_id").cast("string").alias("key"), F.col("turn").isNotNull().cast("int").alias("known"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"),
        (F.col(times).cast("int") if times else F.lit(1)).alias("times"), *spoken,
    )
    place = F.struct("known", "turn")
    said = rows.where("times > 0").select("key", place.alias("place"), _digest(F.col("role"), F.col("text")).alias("digest"))
    ranges = said.groupBy("key", "digest").agg(F.min("place").alias("first"), F.max("place").alias("final")).where("final > first")
    again = said.alias("s").join(ranges.alias("r"), F.col("s.key").eqNullSafe(F.col("r.key")) & (F.col("s.digest") == F.col("r.digest")) & (F.col("s.place") > F.col("r.first")))
    marks = again.select("s.key", "s.place.known", "s.place.turn", "s.digest").distinct()
    both = rows.withColumn("digest", F.lit(None).cast("binary")).unionByName(
        marks.select("key", "known", "turn", F.lit(0).alias("times"), F.lit("").alias("role"), F.lit("").alias("text"), "digest")
    )
    return both.repartition("key").sortWithinPartitions("key", "known", "turn", F.col("digest").isNull(), "role", "text").select(*_STREAM)


def reports(turns: DataFrame, times: str | None = None) -> DataFrame:
    """One row for each conversation: its faults, the cheapest edits and a digest of what they make of it.

    ``turns`` has ``conv_id``, ``turn``, ``role`` and ``text``; other columns are not looked at.
    ``times`` names a column that tells how often a row stands there; 0 only names its conversation.

    Rows go by turn, null turns first, then by role and text; repeated rows are adjacent. A null
    role or text counts as one space. Rows without ``conv_id`` are one conversation. The first
    fault of a row counts: ``blank`` (nothing but ASCII white space), ``duplicate`` (role and text
    seen earlier), ``truncated`` (last other character not ``.``, ``!`` or ``?``). ``gaps`` counts
    the turns missing between the least and the greatest, ``illegal`` the adjacent pairs of roles
    whose initials are not su, ua or au; an empty role has no initial and fits nowhere. Blank and
    duplicate rows are deleted, a truncated row that stays adds 1 to ``cost``. ``audit`` has the
    initials of Delete, Insert, Keep and Rerole in order, ``repaired_sha256`` the digest of
    ``role:text`` lines. A conversation without rows has zeros, an empty audit and the digest of
    an empty text; an empty table has no conversations.
    """
    kind = turns.schema["conv_id"].dataType
    found = _stream(turns, times).mapInPandas(_reports, _REPORT)
    return found.select(F.col("key").cast(kind).alias("conv_id"), *found.columns[1:])


def repaired(turns: DataFrame, times: str | None = None) -> DataFrame:
    """The repaired conversations: ``conv_id``, ``place`` (from 0), ``edit``, ``role``, ``text``; see ``reports``."""
    kind = turns.schema["conv_id"].dataType
    found = _stream(turns, times).mapInPandas(_repaired_rows, _ROWS)
    return found.select(F.col("key").cast(kind).alias("conv_id"), *found.columns[1:])


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``text``, ``times``: rows with faults by the checksum of ``conv_id:turn``, a null read as a space.

    Modulo 20: 0 drops a row (``times`` 0), 1 empties its text, 2 takes ``.``, ``!`` and ``?`` out
    of it, 3 repeats it, 4 makes its role ``user``.
    """
    named = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    rows = conversations.select("conv_id", "turn", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")), (F.crc32(F.concat_ws(":", *named).cast("binary")) % 20).alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.when(F.col("fault") == 0, 0).when(F.col("fault") == 3, 2).otherwise(1).alias("times"),
    )
