"""Conversation structure repair by the auction algorithm for shortest paths.

A conversation is repaired by the cheapest edits that give it the roles ``(system? (user assistant)+)?``.
Rows are kept (0), get the role user or assistant (3) or are deleted (4; blank rows and duplicates must
be); user or assistant rows without text are inserted (3); a truncated row that is not deleted costs 3
more. The lattice of the search has a node for each row and state of the role sequence. The auction keeps
a price for each node, never above the cost from there to the end. From the end of its path it looks for
the arc with the least cost plus price: if that equals the node's price, the path grows by it, else the
price rises to it and the path shrinks by one node. Of arcs that cost the same, the one whose letter
comes first in ASCII is taken (D, I, K, R). Prices of nodes on the path don't change and others only
rise, so at the end the path is, letter by letter, the least of all cheapest ones: it follows tight arcs.

Conversations are streamed, sorted, through the partitions that their ids are dealt to. One of more than
``LONG_ROWS`` rows is cut into fragments by ranges of its order: auctions in each fragment give the costs
between its four states at the start and at the end; these are chained backwards to the prices at each
cut, with which each fragment is searched by itself from every state, and forwards to the states that are
really met. So no task holds such a conversation; its hash alone is taken in one task, row by row, since
a hash has no parts.

Rows of one turn are ordered by role and text. A row's first fault counts: blank (only white space),
duplicate (role and text seen earlier), truncated (last other character not one of ``.!?``).

Odd input: null roles and texts are one space, so such a text is blank and such a role is no known one.
Null turns come first and count for no gap. A null id is a conversation. Rows marked as lost are left
out, but their conversation stays. Repeated rows are duplicates. Empty tables give empty ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from earshot.llm import common as C

#: Rows from which on a conversation is searched in fragments, and rows of a fragment, about.
LONG_ROWS = 256

SPACE = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT = 0, 3, 4, 3
TRUNCATED = 3
#: More than any path costs.
NEVER = 1 << 60

# Faults of a row.
FINE, BLANK, DUPLICATE, CUT = range(4)
# States: nothing yet, after system, after user, after assistant. Initials: s, u, a, another.
INITIALS = {"s": 0, "u": 1, "a": 2}
OTHER = 3
#: State after a kept row, by state and initial; -1 where the role may not follow.
AFTER = ((1, 2, -1, -1), (-1, 2, -1, -1), (-1, -1, 3, -1), (-1, 2, -1, -1))
#: State after a row that is given the role that must follow, or inserted; that role.
NEXT = (2, 2, 3, 2)
ROLE = ("user", "user", "assistant", "user")
#: Costs and edits from each state behind the last row.
TAIL_COST = (0, 2 * INSERT, INSERT, 0)
TAIL = ("", "II", "I", "")
_LEGAL = {(0, 1), (1, 2), (2, 1)}


def auction(rows: list[tuple[int, int]], origin: int, exits: list[int], price: list[int]) -> tuple[int, str, int]:
    """Cost, edits and last state of the ASCII-least cheapest path through rows of (fault, initial).

    ``exits`` has the cost from each state behind the rows. ``price`` has a price for each node
    (4 * row + state) and is raised in place; auctions with the same exits may share it.
    """
    n = len(rows)
    node, path, letters = origin, [], []
    while True:
        i, state = divmod(node, 4)
        if i == n:
            if price[node] >= exits[state]:
                return price[origin], "".join(letters), state
            best = exits[state]
        else:
            fault, initial = rows[i]
            best, letter, to = DELETE + price[node + 4], "D", node + 4
            k = 4 * i + NEXT[state]
            if (c := INSERT + price[k]) < best:
                best, letter, to = c, "I", k
            if fault != BLANK and fault != DUPLICATE:
                more = TRUNCATED if fault == CUT else 0
                if (after := AFTER[state][initial]) >= 0 and (c := more + price[4 * i + 4 + after]) < best:
                    best, letter, to = c, "K", 4 * i + 4 + after
                if (c := REROLE + more + price[k + 4]) < best:
                    best, letter, to = c, "R", k + 4
            if price[node] >= best:
                if best >= NEVER:
                    return NEVER, "", -1
                path.append(node)
                letters.append(letter)
                node = to
                continue
        price[node] = best
        if path:
            node = path.pop()
            letters.pop()


def solve(rows: list[tuple[int, int]]) -> tuple[int, str]:
    """Cost and edits of a whole conversation."""
    cost, letters, state = auction(rows, 0, list(TAIL_COST), [0] * (4 * len(rows) + 4))
    return cost, letters + TAIL[state]


def transfers(rows: list[tuple[int, int]]) -> list[int]:
    """Costs through rows from each state to each state, at 4 * from + to; ``NEVER`` where none leads there."""
    n, out = len(rows), [NEVER] * 16
    for end in range(4):
        exits = [NEVER] * 4
        exits[end] = 0
        price = [0] * (4 * n + 4)
        price[4 * n :] = exits
        # Nothing leads back to an earlier state than user, nor to system without its row.
        if end < 2:
            for i in range(n):
                price[4 * i + 2] = price[4 * i + 3] = NEVER
                if end == 0:
                    price[4 * i + 1] = NEVER
        if end == 1:
            for i in range(n - 1, -1, -1):
                if rows[i][1] == 0 and rows[i][0] not in (BLANK, DUPLICATE):
                    break
                price[4 * i] = NEVER
        for start in range(4):
            if price[start] < NEVER:
                out[4 * start + end] = auction(rows, start, exits, price)[0]
    return out


def apply_edits(letters: str, messages: list[tuple[str, str]], state: int = 0) -> list[tuple[str, str, str]]:
    """(edit, role, text) of what the edits leave of messages; ``state`` is the one before them."""
    out, i = [], 0
    for letter in letters:
        if letter == "I":
            out.append(("I", ROLE[state], ""))
            state = NEXT[state]
            continue
        role, text = messages[i]
        i += 1
        if letter == "K":
            state = AFTER[state][initial(role)]
            out.append(("K", role, text))
        elif letter == "R":
            out.append(("R", ROLE[state], text))
            state = NEXT[state]
    return out


def initial(role: str) -> int:
    return INITIALS.get(role[:1], OTHER)


def faults(messages: list[tuple[str, str]]) -> list[int]:
    seen, out = set(), []
    for m in messages:
        end = m[1].rstrip(SPACE)[-1:]
        out.append(BLANK if not end else DUPLICATE if m in seen else CUT if end not in ".!?" else FINE)
        seen.add(m)
    return out


def illegal(initials: list[int]) -> int:
    return sum(pair not in _LEGAL for pair in zip(initials, initials[1:]))


def line(role: str, text: str) -> bytes:
    return f"{role}:{text}".encode("utf-8", "surrogatepass")


def _gaps(turns: list[int]) -> int:
    return max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0


_SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_MESSAGES = "place long, edit string, role string, text string"


def _names(fields: str) -> list[str]:
    return [f.split()[0] for f in fields.split(", ")]


def _conversations(batches: Iterator[pa.RecordBatch], size: int = 512) -> Iterator[list[tuple[object, list[tuple]]]]:
    """Whole conversations of sorted batches (conv, turn, role, text), about ``size`` rows at a time."""
    done, rows, key, n = [], [], None, 0
    for batch in batches:
        for own, group in groupby(zip(*(c.to_pylist() for c in batch.columns)), key=lambda r: r[0]):
            if rows and own != key:
                done.append((key, rows))
                n += len(rows)
                rows = []
            key = own
            rows.extend(group)
        if n >= size:
            yield done
            done, n = [], 0
    if rows:
        done.append((key, rows))
    yield done


def _repaired(batches: Iterator[pa.RecordBatch], kind: pa.DataType, messages: bool) -> Iterator[pa.RecordBatch]:
    names = _names(_MESSAGES if messages else _SUMMARY)
    for some in _conversations(batches):
        out = []
        for key, rows in some:
            rows = [r for r in rows if not r[4]]
            texts = [(role, text) for _, _, role, text, _ in rows]
            fault, initials = faults(texts), [initial(role) for role, _ in texts]
            cost, audit = solve(list(zip(fault, initials)))
            left = apply_edits(audit, texts)
            if messages:
                out += [(key, i, *m) for i, m in enumerate(left)]
                continue
            digest = hashlib.sha256(b"\n".join([line(role, text) for _, role, text in left])).hexdigest()
            turns = [r[1] for r in rows if r[1] is not None]
            out.append((key, _gaps(turns), fault.count(BLANK), fault.count(DUPLICATE), fault.count(CUT), illegal(initials), cost, audit, digest))
        columns = list(zip(*out)) or [[]] * (len(names) + 1)
        types = [kind, *[pa.string() if isinstance(c, str) else None for c in (out[0][1:] if out else [])]]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t or pa.int64()) for c, t in zip(columns, types)], names=["conv", *names])


def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, turn, role, text and lost of rows damaged by a checksum of conversation and turn.

    Of 20 remainders, 0 loses the row, 1 empties its text, 2 removes its ends of sentences, 3 repeats
    it and 4 gives it the role user. Nulls count as one space.
    """
    told = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    k = F.crc32(F.concat(told(conv_col), F.lit(":"), told(turn_col)).cast("binary")) % 20
    base = rows.select(F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").cast("long").alias("turn"), told(role_col).alias("role"), told(text_col).alias("text"), k.alias("k"))
    text = F.when(F.col("k") == 1, F.lit("")).when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("k") == 4, F.lit("user")).otherwise(F.col("role"))
    times = F.explode(F.when(F.col("k") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return base.select("conv", "turn", role.alias("role"), text.alias("text"), (F.col("k") == 0).alias("lost"), times.alias("_")).drop("_")


def _given(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, lost_col: str | None) -> tuple[DataFrame, DataFrame]:
    """The rows of short conversations and those of long ones, with the columns of ``damaged``."""
    C.prepare(rows.sparkSession)
    told = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    lost = F.lit(False) if lost_col is None else F.coalesce(F.col(f"`{lost_col}`"), F.lit(False))
    base = rows.select(F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").cast("long").alias("turn"), told(role_col).alias("role"), told(text_col).alias("text"), lost.alias("lost"))
    long_ = C.id_filter(base.groupBy("conv").count().where(F.col("count") > LONG_ROWS).select(F.col("conv").alias("big")))
    same = F.col("conv").eqNullSafe(F.col("big"))
    return base.join(long_, same, "left_anti"), base.join(long_, same, "left_semi")


def _streamed(short: DataFrame, messages: bool) -> DataFrame:
    schema = T.StructType([short.schema["conv"], *T.StructType.fromDDL(_MESSAGES if messages else _SUMMARY).fields])
    kind = _arrow_type(short, "conv")
    dealt = short.repartition("conv").sortWithinPartitions("conv", F.asc_nulls_first("turn"), "role", "text")
    return dealt.mapInArrow(lambda batches: _repaired(batches, kind, messages), schema)


def _arrow_type(df: DataFrame, name: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[name].dataType)


# Long conversations


def _fragments(rows: DataFrame) -> DataFrame:
    """conv, part, pos, turn, role, text, initial and fault of the rows, in fragments along their order."""
    fixed = rows.where("NOT lost").drop("lost").withColumn("mid", F.monotonically_increasing_id()).checkpoint()
    parts = max(1, -(-fixed.count() // LONG_ROWS))
    said = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256)
    known = fixed.select("conv", "turn", "mid", said.alias("said"))
    first = known.groupBy("conv", "said").agg(F.min(F.struct("turn", "mid")).alias("first")).select(F.col("conv").alias("c"), F.col("said").alias("s"), "first.mid")
    # Rows that are the first of their kind, by their number; the text need not travel for it.
    firsts = first.select(F.col("mid").alias("m"))
    end = F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1))
    fault = F.when(end == "", BLANK).when(F.col("m").isNull(), DUPLICATE).when(~end.isin(".", "!", "?"), CUT).otherwise(FINE)
    first_letter = F.substring("role", 1, 1)
    code = F.lit(OTHER)
    for letter, k in INITIALS.items():
        code = F.when(first_letter == letter, k).otherwise(code)
    marked = fixed.join(firsts, F.col("mid") == F.col("m"), "left").select("conv", "turn", "role", "text", "mid", code.alias("initial"), fault.alias("fault"))
    order = ["conv", "turn", "role", "text", "mid"]
    cut = marked.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()).checkpoint()
    place = F.row_number().over(Window.partitionBy("conv", "part").orderBy(F.asc_nulls_first("turn"), "role", "text", "mid"))
    return cut.select("conv", "part", place.alias("pos"), "turn", "role", "text", "initial", "fault").checkpoint()


def _rows_of(table: pa.Table) -> list[tuple[int, int]]:
    made = sorted(zip(*(table[c].to_pylist() for c in ("pos", "fault", "initial"))))
    return [(fault, code) for _, fault, code in made]


def _costs(table: pa.Table) -> pa.Table:
    rows = _rows_of(table)
    codes = [code for _, code in rows]
    columns = {"costs": [transfers(rows)], "illegal": [illegal(codes)], "head": [codes[0]], "foot": [codes[-1]]}
    types = {"costs": pa.list_(pa.int64()), "illegal": pa.int64(), "head": pa.int32(), "foot": pa.int32()}
    return pa.table({"conv": table["conv"][:1], "part": table["part"][:1], **{k: pa.array(v, types[k]) for k, v in columns.items()}})


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fragments from the last to the first: the cost behind each state at a fragment's end, and at its start."""
    key, ahead, begun, head = None, list(TAIL_COST), False, None
    for batch in batches:
        behind, whole, between = [], [], []
        for conv, costs, first, last in zip(*(batch[c].to_pylist() for c in ("conv", "costs", "head", "foot"))):
            if not begun or conv != key:
                key, ahead, begun, head = conv, list(TAIL_COST), True, None
            behind.append(ahead)
            ahead = [min(costs[4 * a + b] + ahead[b] for b in range(4)) for a in range(4)]
            whole.append(ahead[0])
            between.append(int(head is not None and (last, head) not in _LEGAL))
            head = first
        made = [pa.array(behind, pa.list_(pa.int64())), pa.array(whole, pa.int64()), pa.array(between, pa.int64())]
        keep = ["conv", "part", "illegal"]
        yield pa.RecordBatch.from_arrays([*[batch[c] for c in keep], *made], names=[*keep, "exits", "cost", "between"])


def _traces(table: pa.Table, exits: pa.Table) -> pa.Table:
    """Edits and end of a fragment from each state at its start."""
    rows, ahead = _rows_of(table), exits["exits"][0].as_py()
    price = [0] * (4 * len(rows) + 4)
    found = [auction(rows, state, ahead, price) for state in range(4)]
    edits = pa.array([[f[1] for f in found]], pa.list_(pa.string()))
    ends = pa.array([[f[2] for f in found]], pa.list_(pa.int32()))
    return exits.select(["conv", "part", "illegal", "cost", "between"]).append_column("edits", edits).append_column("ends", ends)


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fragments from the first to the last: the state at the start, the edits, and what may follow the end."""
    key, state, begun = None, 0, False
    for batch in batches:
        starts, letters, tails, costs = [], [], [], []
        for conv, edits, ends, cost in zip(*(batch[c].to_pylist() for c in ("conv", "edits", "ends", "cost"))):
            new = not begun or conv != key
            if new:
                key, state, begun = conv, 0, True
            starts.append(state)
            letters.append(edits[state])
            state = ends[state]
            tails.append(state)
            costs.append(cost if new else 0)
        made = [pa.array(starts, pa.int32()), pa.array(letters, pa.string()), pa.array(tails, pa.int32()), pa.array(costs, pa.int64())]
        names = ["conv", "part", "illegal", "between", "start", "edits", "end", "cost"]
        yield pa.RecordBatch.from_arrays([*[batch[c] for c in names[:4]], *made], names=names)


def _edited(table: pa.Table, walk: pa.Table) -> pa.Table:
    """Messages that the edits of a fragment leave."""
    texts = [m[1:] for m in sorted(zip(*(table[c].to_pylist() for c in ("pos", "role", "text"))))]
    letters = walk["edits"][0].as_py() + walk["tail"][0].as_py()
    left = apply_edits(letters, texts, walk["start"][0].as_py())
    columns = list(zip(*left)) if left else [[], [], []]
    n = len(left)
    part = pa.array([walk["part"][0].as_py()] * n, pa.int32())
    keys = pa.array([walk["conv"][0].as_py()] * n, walk.schema.field("conv").type)
    return pa.table({"conv": keys, "part": part, "pos": pa.array(range(n), pa.int64()), **{k: pa.array(c, pa.string()) for k, c in zip(("edit", "role", "text"), columns)}})


def _hashed(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """One hash of each conversation's lines, which come in order."""
    key, held, made = None, None, []
    for batch in batches:
        for conv, role, text in zip(*(batch[c].to_pylist() for c in ("conv", "role", "text"))):
            if held is None or conv != key:
                if held is not None:
                    made.append((key, held.hexdigest()))
                key, held = conv, hashlib.sha256(line(role, text))
            else:
                held.update(b"\n" + line(role, text))
    if held is not None:
        made.append((key, held.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], kind), pa.array([m[1] for m in made], pa.string())], names=["conv", "repaired_sha256"])


def _schema(df: DataFrame, fields: str) -> T.StructType:
    return T.StructType([df.schema["conv"], *T.StructType.fromDDL(fields).fields])


def _walks(placed: DataFrame) -> DataFrame:
    """One row per fragment: its state at the start, edits, those behind the last one, and parts of the counts."""
    slim = placed.select("conv", "part", "pos", "initial", "fault")
    costs = slim.groupBy("conv", "part").applyInArrow(_costs, _schema(slim, "part int, costs array<long>, illegal long, head int, foot int"))
    back = costs.repartition("conv").sortWithinPartitions("conv", F.desc("part"))
    exits = back.mapInArrow(_exits, _schema(slim, "part int, illegal long, exits array<long>, cost long, between long")).checkpoint()
    keys = ["conv", "part"]
    traces = slim.groupBy(*keys).cogroup(exits.groupBy(*keys)).applyInArrow(_traces, _schema(slim, "part int, illegal long, cost long, between long, edits array<string>, ends array<int>"))
    forth = traces.repartition("conv").sortWithinPartitions("conv", "part")
    walked = forth.mapInArrow(_walked, _schema(slim, "part int, illegal long, between long, start int, edits string, end int, cost long")).checkpoint()
    last = walked.groupBy("conv").agg(F.max("part").alias("last_part")).withColumnRenamed("conv", "c")
    tail = F.lit("")
    for state, letters in enumerate(TAIL):
        tail = F.when((F.col("part") == F.col("last_part")) & (F.col("end") == state), letters).otherwise(tail)
    return walked.join(last, F.col("conv").eqNullSafe(F.col("c"))).select("*", tail.alias("tail")).drop("c", "last_part")


def _long_messages(placed: DataFrame, walks: DataFrame) -> DataFrame:
    keys = ["conv", "part"]
    return placed.select("conv", "part", "pos", "role", "text").groupBy(*keys).cogroup(walks.select("conv", "part", "start", "edits", "tail").groupBy(*keys)).applyInArrow(_edited, _schema(placed, "part int, pos long, edit string, role string, text string"))


def _long_summaries(placed: DataFrame, all_ids: DataFrame) -> DataFrame:
    walks = _walks(placed).checkpoint()
    counts = placed.groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"),
        *[F.count_if(F.col("fault") == k).alias(name) for k, name in ((BLANK, "blank"), (DUPLICATE, "duplicate"), (CUT, "truncated"))],
    )
    # The edits of a conversation are one text of the result, a letter a row.
    pieces = F.array_sort(F.collect_list(F.struct("part", F.concat("edits", "tail").alias("piece"))))
    audits = walks.groupBy("conv").agg(F.sum(F.col("illegal") + F.col("between")).alias("illegal"), F.sum("cost").alias("cost"), F.array_join(F.transform(pieces, lambda x: x["piece"]), "").alias("audit"))
    ordered = _long_messages(placed, walks).repartition("conv").sortWithinPartitions("conv", "part", "pos")
    kind = _arrow_type(placed, "conv")
    hashes = ordered.mapInArrow(lambda batches: _hashed(batches, kind), _schema(placed, "repaired_sha256 string"))
    out = all_ids.withColumnRenamed("conv", "k")
    for side, name in ((counts, "a"), (audits, "b"), (hashes, "c")):
        named = side.withColumnRenamed("conv", name)
        out = out.join(named, F.col("k").eqNullSafe(F.col(name)), "left").drop(name)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return out.select(
        F.col("k").alias("conv"),
        *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )


def audits(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", lost_col: str | None = None) -> DataFrame:
    """One row per conversation: gaps, faults, illegal neighbours, cost, edits and hash of what is left."""
    short, long_ = _given(rows, conv_col, turn_col, role_col, text_col, lost_col)
    done = _streamed(short, messages=False)
    long_ = long_.checkpoint()
    if not long_.isEmpty():
        done = done.union(_long_summaries(_fragments(long_), long_.select("conv").distinct()))
    return done.withColumnRenamed("conv", conv_col)


def repaired(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", lost_col: str | None = None) -> DataFrame:
    """One row per message that is left: conversation, place from 0 on, edit (K, R or I), role and text."""
    short, long_ = _given(rows, conv_col, turn_col, role_col, text_col, lost_col)
    done = _streamed(short, messages=True)
    long_ = long_.checkpoint()
    if not long_.isEmpty():
        placed = _fragments(long_)
        walks = _walks(placed).checkpoint()
        # What is left of a fragment is known from its edits, so places need no common order.
        left = F.length(F.regexp_replace(F.concat("edits", "tail"), "D", ""))
        before = F.coalesce(F.sum(left).over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        starts = walks.select(F.col("conv").alias("c"), F.col("part").alias("p"), before.alias("before"))
        made = _long_messages(placed, walks).join(starts, F.col("conv").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")))
        done = done.union(made.select("conv", (F.col("before") + F.col("pos")).alias("place"), "edit", "role", "text"))
    return done.withColumnRenamed("conv", conv_col)
