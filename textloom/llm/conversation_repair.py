"""Repair of conversation structure by scalar big-integer weights.

A conversation's rows become a DAG: a node is (rows read, state of the role
grammar), an edge is an edit (Keep, Rerole, Delete, Insert).  A path weighs one
integer: its high digits carry the cost, and a fixed width of low digits holds
the edit letters by position, the first letter highest, zeros behind the last.
Of two paths the smaller integer is the cheaper one, or of equal cost the one
whose letters come first in ASCII, so the ordinary minimum over integers
decides everything.  Weights are worked out from the last row to the first:
putting a letter in front shifts the digits down by one place.

Roles must read ``(s?(ua)+)?`` by their first letters.  A conversation of any
length is cut into blocks of rows.  A block's weights from each state to each
state have bounded width.  Joining blocks from the end adds costs and compares
the block's own digits: of two equally dear ways through a block neither can be
the beginning of the other, unless the rest of the longer one is Inserts that
the following block could have made, and then the zeros behind the shorter one
decide for it as they should.

Defined cases: a null role or text is one space; a null conv_id is a
conversation of its own; a null turn comes first and is left out of the gaps;
rows of one turn come by role and text (UTF-8 bytes); repeated rows are rows
like any other (the later one a duplicate); a role without a letter, or with
another first letter than s, u or a, can't be kept; an empty table gives no
rows; only conv_id, turn, role and text are read, so other columns can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Conversations up to these sizes are read whole by one task; longer ones go by blocks.
WHOLE_ROWS, WHOLE_BYTES = 2_048, 16 << 20
BLOCK_BITS = 10

LETTERS = " DIKR"  # digit -> letter; 0 is the padding
DELETE, INSERT, KEEP, REROLE = 1, 2, 3, 4
#: state -> {first letter of a role: next state}; 0 nothing yet, 1 after s, 2 after u, 3 after a
STEPS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
FINAL = (0, 3)
ROLE_OF = {2: "user", 3: "assistant"}


def suffix_weights(codes: str, ends: tuple[int, ...]) -> tuple[list[int | None], int]:
    """Least weight from each state through all of ``codes`` to one of ``ends``, and the bits of the low digits.

    A code is ``d`` (must go) or the role's first letter, x for others, upper case
    if the row is truncated.
    """
    width = 3 * (len(codes) + 2 * len(codes) // 5 + 6)
    mask, top = (1 << width) - 1, width - 3

    def front(w: int, cost: int, letter: int) -> int:
        return ((w >> width) + cost) << width | letter << top | (w & mask) >> 3

    def with_inserts(w: list[int | None]) -> list[int | None]:
        for _ in range(2):  # a third insert in a row only undoes the first two
            new = list(w)
            for state, steps in enumerate(STEPS):
                for to in steps.values():
                    if to != 1 and w[to] is not None:
                        v = front(w[to], 5, INSERT)
                        if new[state] is None or v < new[state]:
                            new[state] = v
            w = new
        return w

    w = with_inserts([0 if s in ends else None for s in range(4)])
    for code in reversed(codes):
        new: list[int | None] = [None if x is None else front(x, 2, DELETE) for x in w]
        if code != "d":
            late = 5 if code.isupper() else 0
            own = code.lower()
            for state, steps in enumerate(STEPS):
                for letter, to in steps.items():
                    if w[to] is None:
                        continue
                    if letter == own:
                        v = front(w[to], late, KEEP)
                    elif letter != "s":
                        v = front(w[to], late + 1, REROLE)
                    else:
                        continue
                    if new[state] is None or v < new[state]:
                        new[state] = v
        w = with_inserts(new)
    return w, width


def letters_of(weight: int, width: int) -> str:
    digits = oct((weight & (1 << width) - 1) | 1 << width)[3:]  # one octal digit a letter, behind the marker
    return digits.rstrip("0").translate({ord(str(i)): c for i, c in enumerate(LETTERS)})


def best_edits(codes: str) -> tuple[int, str]:
    """Cost and letters of the best repair of a whole conversation."""
    w, width = suffix_weights(codes, FINAL)
    return w[0] >> width, letters_of(w[0], width)


@lru_cache(maxsize=20_000)
def _short_edits(codes: str) -> tuple[int, str]:
    """The same, remembered, for conversations of few rows (many have the same codes)."""
    return best_edits(codes)


def repaired(letters: str, rows: list[tuple[str, str]], state: int = 0) -> Iterator[str]:
    """``role:text`` of each row that is left, rows as (role, text)."""
    at = 0
    for x in letters:
        if x == "I":
            state = 3 if state == 2 else 2
            yield ROLE_OF[state] + ":"
            continue
        role, text = rows[at]
        at += 1
        if x == "K":
            state = STEPS[state][role[:1]]
            yield f"{role}:{text}"
        elif x == "R":
            state = 3 if state == 2 else 2
            yield f"{ROLE_OF[state]}:{text}"


# ------------------------------------------------------------- rows after damage


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage that crc32 of ``conv_id:turn`` chooses; ``tl_gone`` marks dropped rows.

    ``tl_conv`` is conv_id as text, null being empty and all others marked, so it joins and sorts.
    """
    c = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"),
                             F.coalesce("text", F.lit(" ")).alias("text"))
    name = [F.coalesce(F.col(k).cast("string"), F.lit(" ")) for k in ("conv_id", "turn")]
    c = c.withColumn("tl_kind", F.crc32(F.encode(F.concat(name[0], F.lit(":"), name[1]), "UTF-8")) % 20)
    kind = F.col("tl_kind")
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return c.select(
        F.when(F.col("conv_id").isNull(), "").otherwise(F.concat(F.lit("="), F.col("conv_id").cast("string"))).alias("tl_conv"),
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        (kind == 0).alias("tl_gone"), F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
        .alias("tl_copy")).drop("tl_copy")


SPACES = " \t\n\x0b\x0c\r"


def _code(role: str, text: str, seen: bool) -> tuple[str, str]:
    """The fault of a row (b, d, t or nothing) and its code for the DAG."""
    body = text.rstrip(SPACES)
    if not body:
        return "b", "d"
    if seen:
        return "d", "d"
    letter = role[:1] if role[:1] in ("s", "u", "a") else "x"
    return ("", letter) if body[-1] in ".!?" else ("t", letter.upper())


LEGAL = ("su", "ua", "au")
RESULT = "tl_conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _whole(rows: list[tuple]) -> tuple:
    """The result of one conversation from its rows (turn, role, text) in order."""
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    seen, faults, codes = set(), [], []
    for _, role, text in rows:
        fault, code = _code(role, text, (role, text) in seen)
        seen.add((role, text))
        faults.append(fault)
        codes.append(code)
    first = [role[:1] for _, role, _ in rows]
    illegal = sum(a + b not in LEGAL for a, b in zip(first, first[1:]))
    cost, audit = (_short_edits if len(codes) <= 32 else best_edits)("".join(codes))
    text = "\n".join(repaired(audit, [(r, t) for _, r, t in rows]))
    return (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit,
            hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest())


def _whole_conversations(rows: DataFrame) -> DataFrame:
    """Results of conversations that a task can hold, in one shuffle."""
    names = [f.split()[0] for f in RESULT.split(", ")]
    types = [pa.string()] + [pa.int64()] * 6 + [pa.string()] * 2

    def run(batches):
        conv, held, out = None, [], []

        def table():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(5)]
            for name, turn, role, text, gone in zip(*cols):
                if name != conv:
                    if conv is not None:
                        out.append((conv, *_whole(held)))
                    conv, held = name, []
                if not gone:
                    held.append((turn, role, text))
            if out:
                yield table()
                out = []
        if conv is not None:
            out.append((conv, *_whole(held)))
            yield table()

    ordered = rows.select("tl_conv", F.col("turn").cast("long").alias("turn"), "role", "text", "tl_gone").repartition(
        "tl_conv").sortWithinPartitions("tl_conv", F.col("turn").asc_nulls_first(), "role", "text")
    return ordered.mapInArrow(run, RESULT)


# ------------------------------------------------------------ long conversations

BLOCK = "tl_conv string, block long, first long, from_state int, to_state int, cost long, letters string"


def _block_weights(blocks: DataFrame) -> DataFrame:
    """Cost and letters of the best way through each block, from each state to each state."""

    def run(batches):
        for b in batches:
            out = []
            for conv, block, first, codes in zip(*[b.column(i).to_pylist() for i in range(4)]):
                for to in range(4):
                    w, width = suffix_weights(codes, (to,))
                    out += [(conv, block, first, s, to, x >> width, letters_of(x, width))
                            for s, x in enumerate(w) if x is not None]
            types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)] if out else
                                             [pa.array([], t) for t in types], names=[f.split()[0] for f in BLOCK.split(", ")])

    return blocks.select("tl_conv", "block", "first", "codes").mapInArrow(run, BLOCK)


def _chosen_ways(ways: DataFrame) -> DataFrame:
    """Of each conversation's blocks the way that the best repair takes: tl_conv, block, from_state, to_state, total.

    Blocks come last one first; the costs of four states and, for each block
    read, four next states are all that is held (a few bytes for 1,024 rows).
    """
    schema = "tl_conv string, block long, from_state int, to_state int, total long"

    def settle(costs, group):
        """Best next state of each state, given the costs behind the block."""
        best: list[tuple | None] = [None] * 4
        for s, to, cost, letters in group:
            if costs[to] is not None:
                key = (cost + costs[to], letters)
                if best[s] is None or key < best[s][0]:
                    best[s] = (key, to)
        return [None if x is None else x[0][0] for x in best], bytes(4 if x is None else x[1] for x in best)

    def run(batches):
        conv = block = None
        costs: list[int | None] = [0 if s in FINAL else None for s in range(4)]
        group: list[tuple] = []
        path: list[tuple[int, bytes]] = []

        def finished():
            state, rows = 0, []
            for blk, nexts in reversed(path):
                rows.append((conv, blk, state, nexts[state], costs[0]))
                state = nexts[state]
            types = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)],
                                              names=[f.split()[0] for f in schema.split(", ")])

        for b in batches:
            for name, blk, s, to, cost, letters in zip(*[b.column(i).to_pylist() for i in range(6)]):
                if (name, blk) != (conv, block) and conv is not None:
                    costs, nexts = settle(costs, group)
                    path.append((block, nexts))
                    group = []
                    if name != conv:
                        yield finished()
                        costs, path = [0 if x in FINAL else None for x in range(4)], []
                conv, block = name, blk
                group.append((s, to, cost, letters))
        if conv is not None:
            costs, nexts = settle(costs, group)
            path.append((block, nexts))
            yield finished()

    return (ways.select("tl_conv", "block", "from_state", "to_state", "cost", "letters").repartition("tl_conv")
            .sortWithinPartitions("tl_conv", F.col("block").desc()).mapInArrow(run, schema))


def _edit_rows(chosen: DataFrame) -> DataFrame:
    """A row for each edit of a block: tl_conv, pos (of the row it reads, or null), step, letter, role to write."""
    schema = "tl_conv string, block long, step int, pos long, letter string, role string"

    def run(batches):
        types = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string()]
        for b in batches:
            for conv, block, first, state, to, letters in zip(*[b.column(i).to_pylist() for i in range(6)]):
                # the state runs back from ``to``: the role that an I or R writes follows from what comes after it
                out, pos = [], first + sum(x != "I" for x in letters)
                for step in range(len(letters) - 1, -1, -1):
                    x = letters[step]
                    pos -= x != "I"
                    out.append((conv, block, step, None if x == "I" else pos, x, ROLE_OF.get(to) if x in "IR" else None))
                    if x in "IRK":  # before an a was a u; before a u, whatever the block's first states allow
                        to = 2 if to == 3 else 3
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)] if out else
                                                 [pa.array([], t) for t in types],
                                                 names=[f.split()[0] for f in schema.split(", ")])

    return chosen.select("tl_conv", "block", "first", "from_state", "to_state", "letters").mapInArrow(run, schema)


def _sha_in_order(lines: DataFrame) -> DataFrame:
    """tl_conv, sha256 of the lines joined by newlines, in order of (block, step).

    A SHA-256 reads its text from front to back, so a conversation's lines pass
    through one task; only the hash's state is held.
    """

    def run(batches):
        conv, h = None, None
        for b in batches:
            out = []
            for name, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if name != conv:
                    if conv is not None:
                        out.append((conv, h.hexdigest()))
                    conv, h = name, hashlib.sha256()
                else:
                    h.update(b"\n")
                h.update(line.encode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.string())],
                                             names=["tl_conv", "sha"])
        if conv is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv]), pa.array([h.hexdigest()])], names=["tl_conv", "sha"])

    return (lines.repartition("tl_conv").sortWithinPartitions("tl_conv", "block", "step").select("tl_conv", "line")
            .mapInArrow(run, "tl_conv string, sha string"))


def _long_conversations(rows: DataFrame) -> DataFrame:
    """Results of conversations of any length, by blocks of rows in a global order."""
    from pyspark.sql import Window

    ids = rows.select("tl_conv").distinct()
    alive = rows.where("NOT tl_gone").select("tl_conv", F.col("turn").cast("long").alias("turn"), "role", "text",
                                             F.md5(F.concat(F.col("role"), F.lit("\x01"), F.col("text"))).alias("digest"))
    # one key of these windows is one role and text of one conversation; only a counter is held
    again = F.row_number().over(Window.partitionBy("tl_conv", "digest", "role").orderBy(F.col("turn").asc_nulls_first())) > 1
    body = F.rtrim(F.col("text"), F.lit(SPACES))
    first = F.substring("role", 1, 1)
    letter = F.when(first.isin("s", "u", "a"), first).otherwise("x")
    alive = alive.withColumn("again", again).withColumn("body", body)
    fault = F.when(F.col("body") == "", "b").when(F.col("again"), "d").when(
        ~F.substring("body", -1, 1).isin(".", "!", "?"), "t").otherwise("")
    coded = alive.withColumn("fault", fault).withColumn(
        "code", F.when(F.col("fault").isin("b", "d"), "d").when(F.col("fault") == "t", F.upper(letter)).otherwise(letter))
    # a global order by ranges, so a hot conversation lies in many tasks; pos orders rows across them
    ordered = cut_lineage(coded.drop("body", "again", "digest").repartitionByRange("tl_conv", F.col("turn").asc_nulls_first(), "role", "text")
                          .sortWithinPartitions("tl_conv", F.col("turn").asc_nulls_first(), "role", "text")
                          .withColumn("pos", F.monotonically_increasing_id()))
    ordered = ordered.withColumn("block", F.shiftright("pos", BLOCK_BITS)).withColumn("first_letter", F.substring("role", 1, 1))
    blocks = ordered.groupBy("tl_conv", "block").agg(
        F.array_sort(F.collect_list(F.struct("pos", "code", "first_letter"))).alias("rows"))
    blocks = cut_lineage(blocks.select(
        "tl_conv", "block", F.col("rows")[0]["pos"].alias("first"), F.array_join("rows.code", "").alias("codes"),
        F.col("rows")[0]["first_letter"].alias("head"), F.element_at("rows", -1)["first_letter"].alias("tail"),
        F.aggregate(F.sequence(F.lit(1), F.size("rows")), F.lit(0).cast("long"), lambda n, i: n + F.when(
            (i > 1) & ~F.concat(F.element_at("rows", F.greatest(i - 1, F.lit(1)))["first_letter"],
                                F.element_at("rows", i)["first_letter"]).isin(*LEGAL), 1).otherwise(0)).alias("illegal")))
    # seams between blocks: a few bytes for 1,024 rows go through the window
    before = F.lag("tail").over(Window.partitionBy("tl_conv").orderBy("block"))
    seams = blocks.withColumn("before", before).groupBy("tl_conv").agg(
        F.sum(F.col("illegal") + F.when(F.col("before").isNotNull() & ~F.concat("before", "head").isin(*LEGAL), 1).otherwise(0))
        .alias("illegal"))
    turns = ordered.select("tl_conv", "turn").distinct().groupBy("tl_conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"))
    faults = ordered.groupBy("tl_conv").agg(*[F.count_if(F.col("fault") == f).alias(n) for f, n in (
        ("b", "blank"), ("d", "duplicate"), ("t", "truncated"))])
    ways = cut_lineage(_block_weights(blocks))
    key = ["tl_conv", "block", "from_state", "to_state"]
    chosen = cut_lineage(_chosen_ways(ways).join(ways, key))
    audits = chosen.groupBy("tl_conv").agg(F.first("total").alias("cost"), F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("block", "letters"))), itemgetter("letters")), "").alias("audit"))
    edits = _edit_rows(chosen).withColumnRenamed("role", "new_role").withColumnRenamed("block", "edit_block")
    texts = ordered.select(F.col("pos").alias("row_pos"), F.col("role").alias("own_role"), "text")
    lines = (edits.where("letter <> 'D'").join(texts, F.col("pos") == F.col("row_pos"), "left")
             .select("tl_conv", F.col("edit_block").alias("block"), "step", F.concat(
                 F.coalesce("new_role", "own_role"), F.lit(":"), F.when(F.col("letter") == "I", "").otherwise(F.col("text")))
                 .alias("line")))
    empty = hashlib.sha256(b"").hexdigest()
    out = ids
    for part in (turns, faults, seams, audits, _sha_in_order(lines)):
        out = out.join(part, "tl_conv", "left")
    return out.select("tl_conv", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in (
        "gaps", "blank", "duplicate", "truncated", "illegal", "cost")], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha", F.lit(empty)).alias("repaired_sha256"))


def repair(conversations: DataFrame, whole_rows: int = WHOLE_ROWS, whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """One row for each conv_id: its faults, the cheapest repair and the digest of the repaired conversation.

    Conversations beyond ``whole_rows`` rows or ``whole_bytes`` bytes go by
    blocks, all others whole; both ways give the same result.
    """
    sizes = conversations.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(
        F.octet_length("text"), F.lit(1)).cast("long") + F.coalesce(F.octet_length("role"), F.lit(1))).alias("bytes"))
    large = cut_lineage(sizes.where((F.col("n") > whole_rows) | (F.col("bytes") > whole_bytes)).select(
        F.when(F.col("conv_id").isNull(), "").otherwise(F.concat(F.lit("="), F.col("conv_id").cast("string"))).alias("tl_conv")))
    rows = damaged(conversations)
    if large.isEmpty():
        out = _whole_conversations(rows)
    else:
        out = _whole_conversations(rows.join(large, "tl_conv", "left_anti")).unionByName(
            _long_conversations(rows.join(large, "tl_conv", "left_semi")))
    kind = conversations.schema["conv_id"].dataType
    conv = F.when(F.col("tl_conv") == "", F.lit(None)).otherwise(F.substring("tl_conv", 2, 1 << 30)).cast(kind)
    return out.select(conv.alias("conv_id"), *[c for c in out.columns if c != "tl_conv"])
