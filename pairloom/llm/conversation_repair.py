"""Cheapest repair of conversations, planned on a suffix-shared automaton.

A row matters to the plan by its role and its fault only, so a conversation becomes a
signature of one character per row. Signatures are minimised from the end: a node stands
for everything that follows a row, and all conversations that end alike share it. A node
holds, for each state of the grammar, the cost to go and the first edit of the best audit
suffix; both follow from the next node alone. Signatures arrive sorted by their reversed
text, so the nodes of the last one lie on a stack and each is made once per task.

Texts are never held as a whole conversation: rows stream in order past a running hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage

_SPACE = " \t\n\x0b\x0c\r"
#: What a conversation's role initials may be: nothing, or turns of user and assistant
#: after at most one system row. The states: at the start, after s, after u, after a.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The initial that each state takes besides, at the start, s; and the state it leads to.
TAKES, LEADS = "uuau", (USER, USER, ASSISTANT, USER)
ROLE = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Signature characters: x must go; s, u, a, o (other) are whole, in capitals truncated.
MUST_GO = "x"
#: Rows of a signature that one cell holds before the pieces are joined.
PIECE = 4096

Choice = tuple[int, str]
Node = tuple[Choice, Choice, Choice, Choice]


def _with_inserts(options: list[Choice | None]) -> Node:
    """The best of what each state can do here, rows inserted first where that is cheaper.
    More than two inserts in a row come back to the same state."""
    best = [o or (1 << 62, "?") for o in options]
    for _ in range(2):
        best = [min(b, (INSERT + best[LEADS[s]][0], "I")) for s, b in enumerate(best)]
    return tuple(best)


def final_node() -> Node:
    """After the last row: an empty or a complete conversation may stop."""
    return _with_inserts([(0, ""), None, None, (0, "")])


def node_before(symbol: str, after: Node) -> Node:
    """The node of ``symbol`` followed by ``after``: cost to go and first edit by state.

    The four edits have different initials, so among equal costs the least initial gives
    the least audit.
    """
    options = []
    for state in range(4):
        deleted = (DELETE + after[state][0], "D")
        if symbol == MUST_GO:
            options.append(deleted)
            continue
        role, extra = symbol.lower(), TRUNCATED * symbol.isupper()
        ways = [deleted, (REROLE + extra + after[LEADS[state]][0], "R")]
        if role == TAKES[state]:
            ways.append((extra + after[LEADS[state]][0], "K"))
        elif role == "s" and state == START:
            ways.append((extra + after[SYSTEM][0], "K"))
        options.append(min(ways))
    return _with_inserts(options)


class Suffixes:
    """Nodes of the signature read last, from its end; the next one reuses those it shares."""

    def __init__(self):
        self.reversed, self.nodes = "", [final_node()]
        self.made = 0

    def plan(self, signature: str) -> tuple[int, str]:
        """Cost and audit of a signature."""
        backwards = signature[::-1]
        shared = 0
        for a, b in zip(backwards, self.reversed):
            if a != b:
                break
            shared += 1
        del self.nodes[shared + 1 :]
        for symbol in backwards[shared:]:
            self.nodes.append(node_before(symbol, self.nodes[-1]))
            self.made += 1
        self.reversed = backwards
        return self.nodes[-1][START][0], self._audit(signature)

    def _audit(self, signature: str) -> str:
        edits, state, at = [], START, len(signature)
        while True:
            edit = self.nodes[at][state][1]
            if not edit:
                return "".join(edits)
            edits.append(edit)
            if edit != "D":
                kept_system = edit == "K" and signature[len(signature) - at].lower() == "s"
                state = SYSTEM if kept_system else LEADS[state]
            at -= edit != "I"


def damaged(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, gone)``: the rows with faults put in, by crc32 of
    ``conv_id:turn`` (nulls: one space) modulo 20; dropped rows are marked ``gone``, so
    that their conversation stays known. Null roles and texts are one space.
    """
    blank = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    case = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    text = F.when(case == 1, "").when(case == 2, F.translate(blank("text"), ".!?", "")).otherwise(blank("text"))
    rows = conversations.select("conv_id", "turn", F.when(case == 4, "user").otherwise(blank("role")).alias("role"), text.alias("text"), (case == 0).alias("gone"), case.alias("case"))
    copies = F.when(F.col("case") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.withColumn("copy", F.explode(copies)).drop("case", "copy")


def unharmed(conversations: DataFrame) -> DataFrame:
    """The rows as they are, in the columns of :func:`damaged`."""
    blank = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    return conversations.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), F.lit(False).alias("gone"))


def _initial(role: Column) -> Column:
    return F.substring(role, 1, 1)


def _placed(rows: DataFrame) -> DataFrame:
    """Rows with their place in the conversation and what the signature needs of them."""
    order = Window.partitionBy("conv_id").orderBy(F.col("gone"), F.col("turn").asc_nulls_first(), "role", "text")
    bare = F.rtrim(F.col("text"), F.lit(_SPACE))
    last = F.right(bare, F.lit(1))
    return rows.select(
        "conv_id", "turn", "role", "text", "gone",
        F.row_number().over(order).alias("place"),
        F.lag(_initial("role")).over(order).alias("before"),
        F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))).alias("same"),
        (bare == "").alias("blank"),
        (~last.isin(".", "!", "?")).alias("cut"),
    )


def _again(light: DataFrame) -> DataFrame:
    """``(conv_id, place)`` of rows whose role and text stood in the conversation before."""
    first = light.groupBy("conv_id", "same").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    met = light.alias("l").join(first.alias("f"), F.col("l.conv_id").eqNullSafe(F.col("f.conv_id")) & (F.col("l.same") == F.col("f.same")))
    return met.where("place > first").select("l.conv_id", "place")


def _signatures(placed: DataFrame) -> DataFrame:
    """One row per conversation: the counts and the signature, put together from pieces."""
    light = placed.select("conv_id", "turn", "role", "gone", "place", "before", "same", "blank", "cut")
    again = _again(light.where(~F.col("gone") & ~F.col("blank")))
    # marks meet their rows by a sum over (conversation, place): no row is joined
    marks = again.select("conv_id", "place", F.lit(1).alias("dup"))
    none = [F.lit(None).cast(light.schema[c].dataType).alias(c) for c in ("turn", "role", "gone", "before", "blank", "cut")]
    both = light.select("conv_id", "place", F.lit(0).alias("dup"), "turn", "role", "gone", "before", "blank", "cut").unionByName(marks.select("conv_id", "place", "dup", *none))
    rows = both.groupBy("conv_id", "place").agg(F.max("dup").alias("dup"), *[F.max(c).alias(c) for c in ("turn", "role", "gone", "before", "blank", "cut")])
    here, live = _initial("role"), ~F.col("gone")
    fault = F.when(F.col("blank"), "blank").when(F.col("dup") == 1, "duplicate").when(F.col("cut"), "truncated")
    kind = F.when(here.isin("s", "u", "a"), here).otherwise("o")
    symbol = F.when(fault.isin("blank", "duplicate"), MUST_GO).when(fault == "truncated", F.upper(kind)).otherwise(kind)
    illegal = live & F.col("before").isNotNull() & ~F.concat("before", here).isin("su", "ua", "au")
    rows = rows.select("conv_id", "place", "turn", F.col("gone"), fault.alias("fault"), illegal.alias("illegal"), symbol.alias("symbol"))
    count = lambda condition: F.count(F.when(live & condition, 1))
    of = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(live, F.struct("place", "symbol")))), lambda x: x["symbol"]), "")
    pieces = rows.groupBy("conv_id", F.floor(F.col("place") / PIECE).alias("piece")).agg(
        of.alias("symbols"), *[count(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")], count(F.col("illegal")).alias("illegal"),
    )
    whole = pieces.groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "symbols"))), lambda x: x["symbols"]), "").alias("signature"),
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")],
    )
    turns = light.where(live & F.col("turn").isNotNull()).groupBy("conv_id", "turn").agg(F.lit(1).alias("one"))
    gaps = turns.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count(F.lit(1))).cast("long").alias("gaps"))
    return whole.alias("w").join(gaps.alias("g"), F.col("w.conv_id").eqNullSafe(F.col("g.conv_id")), "left").select(
        "w.conv_id", "signature", "blank", "duplicate", "truncated", "illegal", F.coalesce("gaps", F.lit(0)).alias("gaps")
    )


def plans(signatures: DataFrame) -> DataFrame:
    """``(signature, cost, audit)`` for every distinct signature. A range partition holds
    signatures of like endings; only the nodes on its border are made in two tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        suffixes = Suffixes()
        for batch in batches:
            planned = [suffixes.plan(s) for s in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([c for c, _ in planned], pa.int64()), pa.array([a for _, a in planned], pa.string())], names=["signature", "cost", "audit"]
            )

    sorted_ = signatures.select("signature").distinct().withColumn("ending", F.reverse("signature")).repartitionByRange("ending").sortWithinPartitions("ending")
    return sorted_.select("signature").mapInArrow(run, "signature string, cost long, audit string")


class _Writer:
    """Applies an audit to the rows of a conversation as they pass, and hashes the result."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START
        self.hash, self.empty = hashlib.sha256(), True

    def _put(self, role: str, text: str) -> None:
        self.hash.update(f"{'' if self.empty else chr(10)}{role}:{text}".encode())
        self.empty = False

    def _inserts(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self._put(ROLE[TAKES[self.state]], "")
            self.state, self.at = LEADS[self.state], self.at + 1

    def row(self, role: str, text: str) -> None:
        self._inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self._put(role, text)
            self.state = SYSTEM if role[:1] == "s" else LEADS[self.state]
        elif edit == "R":
            self._put(ROLE[TAKES[self.state]], text)
            self.state = LEADS[self.state]

    def digest(self) -> str:
        self._inserts()
        return self.hash.hexdigest()


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _applied(placed: DataFrame, planned: DataFrame) -> DataFrame:
    """The results of ``planned`` with the hash of the repaired rows. A conversation's own
    row comes before its rows; all of them pass one task, one batch at a time, since the
    hash of a text is made from its beginning to its end."""
    no_text = F.lit(None).cast("string")
    heads = planned.select("conv_id", F.lit(0).alias("place"), no_text.alias("role"), no_text.alias("text"), "audit", *_COUNTS)
    rows = placed.where(~F.col("gone")).select("conv_id", "place", "role", "text", no_text.alias("audit"), *[F.lit(None).cast("long").alias(c) for c in _COUNTS])
    kind = placed.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = head = None
        columns = ["conv_id", *_COUNTS, "audit", "repaired_sha256"]

        def finished(done: list) -> pa.RecordBatch:
            arrays = [pa.array([d[i] for d in done], out_types[i]) for i in range(len(columns))]
            return pa.RecordBatch.from_arrays(arrays, names=columns)

        out_types: list = []
        done: list = []
        for batch in batches:
            out_types = [batch.schema.field("conv_id").type, *[pa.int64()] * len(_COUNTS), pa.string(), pa.string()]
            ids, roles, texts, audits = (batch.column(n).to_pylist() for n in ("conv_id", "role", "text", "audit"))
            counts = [batch.column(n).to_pylist() for n in _COUNTS]
            for i in range(batch.num_rows):
                if audits[i] is None:
                    writer.row(roles[i], texts[i])
                    continue
                if writer:
                    done.append([*head, writer.digest()])
                writer, head = _Writer(audits[i]), [ids[i], *[c[i] for c in counts], audits[i]]
            if done:
                yield finished(done)
                done = []
        if writer:
            yield finished([[*head, writer.digest()]])

    together = heads.unionByName(rows).repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return together.mapInArrow(run, f"conv_id {kind}, {', '.join(f'{c} long' for c in _COUNTS)}, audit string, repaired_sha256 string")


def repair(rows: DataFrame) -> DataFrame:
    """``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)``
    of every conversation in ``rows``, which come from :func:`damaged` or :func:`unharmed`.

    Rows stand in the order of turn (null first), then role and text, so rows of one turn
    have a defined order and repeated rows are next to each other; all but the first of
    these are duplicates. A null id is a conversation of its own. A conversation without
    rows has zeros, an empty audit and the hash of the empty text; an empty table gives an
    empty one. Only the four columns are read, so others may have any name.

    A conversation's signature and audit take a byte for each row, in one cell as the
    audit is one cell of the result; its texts stream. So a conversation of very many rows
    bounds the time of one task, but not its memory: SHA-256 has no parts.
    """
    placed = stage(_placed(rows), "placed")
    signed = stage(_signatures(placed), "signed")
    answers = plans(signed)
    planned = signed.join(answers, "signature").select("conv_id", *_COUNTS, "audit")
    return _applied(placed, planned)
