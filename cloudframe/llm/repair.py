"""Repairing the structure of conversations: the cheapest edits after which user and assistant take turns."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import column

#: States of the grammar ``(s?(ua)+)?``: nothing yet, after ``s``, after ``u``, after ``a``.
START, SYSTEM, USER, ASSISTANT = range(4)
#: From a state, by a role's initial.
STEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
ACCEPTING = (START, ASSISTANT)
ROLES = {USER: b"user:", ASSISTANT: b"assistant:"}
COST = {"D": 2, "K": 0, "R": 1, "I": 5}
#: What a truncated row adds unless it is deleted.
TRUNCATED = 5
LEGAL = ("su", "ua", "au")


def _by_inserts() -> dict[int, list[list[int]]]:
    """For each state the ways on by inserted rows that can pay: the states passed, each state reached once."""
    out = {}
    for state in range(4):
        ways, seen = [[]], {state}
        for way in ways:
            for initial in "ua":
                following = STEP.get((way[-1] if way else state, initial))
                if following is not None and following not in seen:
                    seen.add(following)
                    ways.append([*way, following])
        out[state] = ways
    return out


INSERTS = _by_inserts()
LETTERS = "DKR"
OUT = "conv_id {}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class _Conversation:
    """Forward search over one conversation: each state carries its least cost, with the ASCII-least edits among equals.

    Of a layer the edits that end a state have as many letters besides I, the last of them no I, so
    none begins another: their order stays as letters follow, and a rank each is all that has to
    be compared. Edits are kept as one byte a state and row, the repaired text as running digests.
    """

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.alive = {START: (0, 0, hashlib.sha256())}
        self.back = bytearray()
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.turns, self.low, self.last_turn, self.initial = 0, None, None, None

    def _closed(self):
        """Ways out of the layer: state, cost, rank, inserts, state before them, digest before them, states passed."""
        for before, (cost, rank, digest) in self.alive.items():
            for way in INSERTS[before]:
                yield (way[-1] if way else before), cost + COST["I"] * len(way), rank, "I" * len(way), before, digest, way

    @staticmethod
    def _inserted(digest, state: int, way: list[int]):
        if way:
            digest = digest.copy()
        for following in way:
            digest.update((b"\n" if state != START else b"") + ROLES[following])
            state = following
        return digest

    def add(self, turn, role: str, text: bytes, again: bool) -> None:
        if turn is not None:
            if self.low is None:
                self.low = turn
            if turn != self.last_turn:
                self.turns += 1
            self.last_turn = turn
        if self.initial is not None and self.initial + role[:1] not in LEGAL:
            self.illegal += 1
        self.initial = role[:1]
        said = text.rstrip()
        blank, cut = not said, said[-1:] not in (b".", b"!", b"?")
        self.blank += blank
        self.duplicate += again and not blank
        self.truncated += cut and not blank and not again
        extra = TRUNCATED * cut
        best: dict[int, tuple] = {}
        for state, cost, rank, inserts, before, digest, way in self._closed():
            edits = [("D", state, cost + COST["D"])]
            if not blank and not again:
                edits += [("K", STEP.get((state, self.initial)), cost + extra), *[("R", STEP.get((state, r)), cost + COST["R"] + extra) for r in "ua"]]
            for letter, following, total in edits:
                if following is not None:
                    found = (total, rank, inserts + letter, state, before, digest, way)
                    if following not in best or found[:3] < best[following][:3]:
                        best[following] = found
        ranks = {s: k for k, s in enumerate(sorted(best, key=lambda s: best[s][1:3]))}
        layer = bytearray(4)
        self.alive = {}
        for following, (total, _, letters, state, before, digest, way) in best.items():
            digest = self._inserted(digest, before, way)
            if letters[-1] != "D":
                digest = digest if way else digest.copy()
                digest.update((b"\n" if state != START else b"") + (role.encode("utf-8", "surrogatepass") + b":" if letters[-1] == "K" else ROLES[following]) + text)
            self.alive[following] = (total, ranks[following], digest)
            layer[following] = before | len(way) << 2 | LETTERS.index(letters[-1]) << 4
        self.back += layer

    def result(self) -> tuple:
        total, _, inserts, state, digest, way = min(((c, r, i, b, d, w) for s, c, r, i, b, d, w in self._closed() if s in ACCEPTING), key=lambda x: x[:3])
        digest = self._inserted(digest, state, way)
        audit = [inserts]
        for at in range(len(self.back) - 4, -1, -4):
            told = self.back[at + state]
            audit.append("I" * (told >> 2 & 3) + LETTERS[told >> 4])
            state = told & 3
        gaps = self.last_turn - self.low + 1 - self.turns if self.low is not None else 0
        return self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, total, "".join(reversed(audit)), digest.hexdigest()


def _stream(schema: pa.Schema):
    def run(batches):
        """Rows in the order of conversation and turn, batch by batch; one conversation's figures at a time."""
        now, done = None, []
        for batch in batches:
            for conv_id, turn, role, text, again, gone in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "again", "gone")), strict=True):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        done.append(now.result())
                    now = _Conversation(conv_id)
                if not gone:
                    now.add(turn, role, text, again)
            if len(done) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
                done = []
        if now is not None:
            done.append(now.result())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)

    return run


def _turns(rows: DataFrame, gone: Column, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    plain = lambda c: F.coalesce(column(c).cast("string"), F.lit(" "))
    return rows.select(column(conv_col).alias("conv_id"), column(turn_col).cast("long").alias("turn"), plain(role_col).alias("role"), plain(text_col).alias("text"), gone.alias("gone"))


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]


def repair_plan(rows: DataFrame, gone: str | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row a conversation: its faults, and the cheapest edits that make it ``(s?(ua)+)?`` by the initials of its roles.

    Rows are taken by turn, nulls first, then by role and text. ``blank, duplicate, truncated``
    count rows by their first fault: no character besides ASCII white space; role and text seen
    before; the last such character is none of ``.!?``. ``illegal``: neighbours whose initials
    are not su, ua or au. ``gaps``: turns missing between the first and the last. Edits: Keep 0,
    Rerole to user or assistant 1, Delete 2 (required for blank and duplicate rows), Insert an
    empty row of user or assistant 5; a truncated row that stays adds 5. ``audit`` has the initials
    of the edits in order, the ASCII-least of the cheapest; ``repaired_sha256`` is of the repaired
    lines ``role:text``, joined by newlines. ``repaired_turns`` gives those rows.

    Rows move once, by conversation; repeated rows are told in a sort within it, then rows are
    sorted by turn, both spilled by the engine, and stream through a forward search that holds four
    states, four bytes a row and four running digests, whatever the conversation's length. A
    digest cannot be split, so a conversation passes one task; it is never held there.

    Rows for which the column ``gone`` is true only make their conversation known: one without
    others has zeros, an empty audit and the digest of nothing. Null roles and texts are one
    space, null conversation ids one conversation. A role without a first letter fits no state.
    Repeated rows are duplicates. An empty table gives an empty one; other columns are not read.
    """
    flag = F.coalesce(column(gone), F.lit(False)) if gone else F.lit(False)
    turns = _turns(rows, flag, conv_col, turn_col, role_col, text_col)
    dealt = turns.repartition("conv_id")
    seen = F.row_number().over(Window.partitionBy("conv_id", "gone", "role", "text").orderBy(F.col("turn").asc_nulls_first())) > 1
    told = dealt.withColumn("again", seen).sortWithinPartitions("conv_id", *_order(), "again")
    kind = turns.schema["conv_id"].dataType.simpleString()
    out = StructType.fromDDL(OUT.format(kind))
    return told.withColumn("text", F.col("text").cast("binary")).mapInArrow(_stream(to_arrow_schema(out)), out)


def repaired_turns(rows: DataFrame, plan: DataFrame, gone: str | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The rows of repaired conversations by ``repair_plan``: ``conv_id, line, edit, role, text``, lines from 0.

    Edits are cut at their letters and meet the rows, numbered alike, in one join; roles follow from
    the lines: a first line of the system is followed by user and assistant in turn, as is nothing.
    """
    flag = F.coalesce(column(gone), F.lit(False)) if gone else F.lit(False)
    turns = _turns(rows, flag, conv_col, turn_col, role_col, text_col).where("not gone")
    by_turn = Window.partitionBy("conv_id").orderBy(*_order())
    numbered = turns.withColumn("at", F.row_number().over(by_turn) - 1).select(F.col("conv_id").alias("c"), "at", F.col("role").alias("was"), "text")
    edits = plan.select("conv_id", F.posexplode(F.split("audit", "(?<=[DKR])")).alias("at", "letters"))
    met = edits.join(numbered, edits["conv_id"].eqNullSafe(numbered["c"]) & (edits["at"] == numbered["at"]), "left").select("conv_id", edits["at"], "letters", "was", "text")
    each = met.select("*", F.posexplode(F.split("letters", "")).alias("k", "edit")).where("edit in ('K', 'R', 'I')")
    inserted = F.col("edit") == "I"
    lines = each.withColumns({"text": F.when(inserted, F.lit("")).otherwise(F.col("text")), "line": F.row_number().over(Window.partitionBy("conv_id").orderBy("at", "k")) - 1})
    first = F.first(F.when(F.col("edit") == "K", F.substring("was", 1, 1))).over(Window.partitionBy("conv_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    speaker = F.col("line") - F.coalesce((first == "s").cast("int"), F.lit(0))
    role = F.when(F.col("edit") == "K", F.col("was")).when(speaker % 2 == 0, F.lit("user")).otherwise(F.lit("assistant"))
    return lines.select("conv_id", "line", "edit", role.alias("role"), "text")


def damage(rows: DataFrame) -> DataFrame:
    """Rows ``conv_id, turn, role, text`` damaged by the CRC-32 of ``conv_id:turn`` modulo 20, with ``gone`` for dropped ones.

    0 drops the row, 1 empties its text, 2 takes its ``.!?`` out, 3 repeats it, 4 makes it the
    user's. Nulls are one space, in the key, too; the columns of ids and turns stay null.
    """
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn")).cast("binary")) % 20
    coded = rows.select("conv_id", "turn", plain("role").alias("role"), plain("text").alias("text"), code.alias("code"))
    text = F.when(F.col("code") == 1, F.lit("")).when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("code") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    return coded.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("code") == 0).alias("gone"), copies).drop("copy")
