"""Operator 13, conversation structure repair over a suffix-shared automaton.

1. One light shuffle (ids, turns, roles, digests; no texts) orders the rows of a
   conversation, finds their faults and spells them as a signature: a letter a
   row for its role's initial (s, u, a, x: other), upper case if truncated, d if
   it has to go.  Signatures are cut into pieces of 1,024 rows.
2. Distinct pieces are sorted by their reversed spelling.  Read in that order,
   pieces with the same end lie together, so a stack of nodes is the automaton
   that shares suffixes: each node (a suffix) is made once, and holds for every
   grammar state the cost to go and the least audit from there.  An end in the
   middle of a conversation has the four states as possible ends.  The tables
   serve all conversations; a very common signature is one node.
3. Pieces pick their end states by a small recursion over the pieces of a
   conversation (most have one), and the edits are known.
4. A second shuffle brings texts and edits together; conversations stream
   through the digest row by row.

Grammar states: 0 nothing yet, 1 after s, 2 after u, 3 after a; 0 and 3 accept.
The role that an insertion or a rerole gives follows from the state.  Audits of
equal cost between the same states consume the same rows and end with a row, so
none begins with another: the least whole is made of least pieces.

No group is held in memory: windows and sorts spill, digests stream.  The texts
of one conversation pass through one task, since SHA-256 is sequential.

Defined results: a null id is a conversation of its own; null roles and texts
are one space; an empty role has no legal initial; rows of one turn go by role,
then by digest of the text; a conversation of which no row is left has zeros, an
empty audit and the digest of the empty string; repeated rows are duplicates; an
empty table gives no rows; extra columns are ignored; long texts are read whole.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

WHITE = " \t\n\x0b\x0c\r"
TABLE = "sig string, last boolean, costs array<int>, audits array<string>, ranks array<int>"
PATH = "key string, piece bigint, entry int"
DIGESTS = "key string, repaired_sha256 string"
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal"]
NEVER = 1 << 29
#: Grammar: state after a role's initial, and the role that leads on.
AFTER = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
NEXT = {0: "u", 1: "u", 2: "a", 3: "u"}
ROLE = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1


def damaged(conversations: DataFrame) -> DataFrame:
    """``(key, turn, role, text)`` after the damage that crc32 of
    ``conv_id:turn`` selects."""
    space = F.lit(" ")
    kind = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"),
                            F.coalesce(F.col("turn").cast("string"), space)).cast("binary")) % 20
    rows = conversations.select(key_of(), F.col("turn").cast("long").alias("turn"),
                                F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"),
                                kind.alias("kind")).filter("kind != 0")
    rows = rows.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("key", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"))


def key_of() -> Column:
    """Conversations by text id; null is the empty text."""
    return F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("key")


def _digest() -> Column:
    return F.unhex(F.sha2(F.col("text").cast("binary"), 256))


def order() -> list[Column]:
    """Rows of a conversation: by turn, equal turns by role and text digest."""
    return [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("digest").asc()]


def signatures(rows: DataFrame, piece_rows: int) -> DataFrame:
    """Per conversation and piece: signature, fault counts, and the order key
    of its first row."""
    shown = F.rtrim("text", F.lit(WHITE))
    light = rows.select("key", "turn", "role", _digest().alias("digest"), (shown == "").alias("blank"),
                        (~F.right(shown, F.lit(1)).isin(".", "!", "?")).alias("cut")).repartition("key")
    seen = F.row_number().over(Window.partitionBy("key", "role", "digest").orderBy("turn")) > 1
    line = Window.partitionBy("key").orderBy(*order())
    initial = F.when(F.left("role", F.lit(1)).isin("s", "u", "a"), F.left("role", F.lit(1))).otherwise("x")
    light = (light.withColumn("seen", seen).withColumn("initial", initial)
             .withColumn("at", F.row_number().over(line) - 1)
             .withColumn("before", F.lag("initial").over(line)).withColumn("turn_before", F.lag("turn").over(line)))
    gone, cut = F.col("blank") | F.col("seen"), F.col("cut") & ~F.col("blank") & ~F.col("seen")
    letter = F.when(gone, "d").when(cut, F.upper("initial")).otherwise(F.col("initial"))
    new_turn = F.col("turn").isNotNull() & (F.col("turn_before").isNull() | (F.col("turn") != F.col("turn_before")))
    legal = F.col("before").isNull() | F.concat("before", "initial").isin("su", "ua", "au")
    count = lambda c: F.sum(c.cast("long"))
    pieces = light.groupBy("key", F.floor(F.col("at") / piece_rows).alias("piece")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", letter.alias("letter")))), lambda x: x["letter"]), "").alias("sig"),
        F.min(F.struct(F.col("at"), "turn", "role", "digest")).alias("first"),
        F.min("turn").alias("low"), F.max("turn").alias("high"), count(new_turn).alias("turns"),
        count(F.col("blank")).alias("blank"), count(F.col("seen") & ~F.col("blank")).alias("duplicate"),
        count(cut).alias("truncated"), count(~legal).alias("illegal"))
    return pieces.withColumn("last", F.col("piece") == F.max("piece").over(Window.partitionBy("key")))


# ------------------------------------------------------------ the automaton

def ends(last: bool) -> list[list[tuple[int, str]]]:
    """Cost and audit from each state at the end, for each end to reach."""
    if last:
        return [[(0, "")], [(2 * INSERT, "II")], [(INSERT, "I")], [(0, "")]]
    return [[(0, "") if s == e else (NEVER, "") for e in range(4)] for s in range(4)]


def node(letter: str, after: list[list[tuple[int, str]]]) -> list[list[tuple[int, str]]]:
    """The node in front of ``after`` that a row with this letter makes."""
    extra = TRUNCATED if letter.isupper() else 0
    role = letter.lower()
    width = range(len(after[0]))
    row = []
    for s in range(4):
        ways = [(DELETE, "D", s)]
        if role != "d":
            if (s, role) in AFTER:
                ways.append((KEEP + extra, "K", AFTER[s, role]))
            ways.append((REROLE + extra, "R", AFTER[s, NEXT[s]]))
        row.append([min((c + after[t][e][0], a + after[t][e][1]) for c, a, t in ways) for e in width])
    out = []
    for s in range(4):
        one = AFTER[s, NEXT[s]]
        two = AFTER[one, NEXT[one]]
        out.append([min(row[s][e], (INSERT + row[one][e][0], "I" + row[one][e][1]),
                        (2 * INSERT + row[two][e][0], "II" + row[two][e][1])) for e in width])
    return out


def _automaton(schema: pa.Schema):
    """Signatures in reversed order: one stack of nodes per run of shared ends."""
    def run(batches):
        before, stack = None, []
        for b in batches:
            out = {f.name: [] for f in schema}
            for sig, last in zip(b.column("sig").to_pylist(), b.column("last").to_pylist(), strict=True):
                spelled = sig[::-1]
                if before is None or before[0] != last:
                    stack, same = [ends(last)], 0
                else:
                    same, most = 0, min(len(spelled), len(before[1]))
                    while same < most and spelled[same] == before[1][same]:
                        same += 1
                    del stack[same + 1:]
                for letter in spelled[same:]:
                    stack.append(node(letter, stack[-1]))
                before = last, spelled
                table = [x for state in stack[-1] for x in state]
                width = len(stack[-1][0])
                ranks = [sorted(a for _, a in table[s * width:(s + 1) * width]).index(table[s * width + e][1])
                         for s in range(4) for e in range(width)]
                for name, value in zip(out, (sig, last, [min(c, NEVER) for c, _ in table], [a for _, a in table], ranks), strict=True):
                    out[name].append(value)
            yield common.arrow_batch(schema, **out)
    return run


def cost_tables(pieces: DataFrame) -> DataFrame:
    distinct = pieces.select("sig", "last").distinct()
    spelled = [F.col("last"), F.reverse("sig")]
    return distinct.repartitionByRange(*spelled).sortWithinPartitions(*spelled).mapInArrow(
        _automaton(common.arrow_schema(TABLE)), TABLE)


def _path(pdf):
    """End states of the pieces of one conversation (numbers only: the tables
    come as costs and ranks)."""
    import pandas as pd
    pdf = pdf.sort_values("piece")
    go, choice = None, []
    for costs, ranks in zip(pdf["costs"][::-1], pdf["ranks"][::-1], strict=True):
        if go is None:
            pick = [0, 0, 0, 0]
            go = [int(costs[s]) for s in range(4)]
        else:
            best = [min((int(costs[4 * s + e]) + go[e], int(ranks[4 * s + e]), e) for e in range(4)) for s in range(4)]
            pick, go = [b[2] for b in best], [b[0] for b in best]
        choice.append(pick)
    state, entry = 0, []
    for k, pick in enumerate(choice[::-1]):
        last = k == len(choice) - 1
        entry.append(state if last else 4 * state + pick[state])
        state = pick[state]
    return pd.DataFrame({"key": pdf["key"], "piece": pdf["piece"], "entry": pd.Series(entry, index=pdf.index, dtype="int32")})


def edits(pieces: DataFrame, tables: DataFrame) -> DataFrame:
    """The pieces with the cost and audit of the cheapest edits."""
    known = pieces.join(tables, ["sig", "last"])
    alone = known.filter(F.col("last") & (F.col("piece") == 0)).withColumn("entry", F.lit(0))
    many = known.filter(~(F.col("last") & (F.col("piece") == 0)))
    path = many.select("key", "piece", "costs", "ranks").groupBy("key").applyInPandas(_path, PATH)
    many = many.join(path, ["key", "piece"])
    entry = F.col("entry") + 1
    return alone.unionByName(many).select(*pieces.columns, F.element_at("costs", entry).cast("long").alias("cost"),
                                          F.element_at("audits", entry).alias("audit"))


# ------------------------------------------------------------ repaired texts

class Line:
    """One conversation on its way through the digest."""

    def __init__(self, key: str):
        self.key, self.state, self.audit, self.at, self.lines = key, 0, "", 0, 0
        self.sha = hashlib.sha256()

    def put(self, role: str, text: str) -> None:
        if self.lines:
            self.sha.update(b"\n")
        self.sha.update(f"{role}:{text}".encode())
        self.lines += 1

    def insert(self) -> None:
        while self.audit[self.at:self.at + 1] == "I":
            to = NEXT[self.state]
            self.put(ROLE[to], "")
            self.state, self.at = AFTER[self.state, to], self.at + 1

    def row(self, role: str, text: str) -> None:
        self.insert()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.put(role, text)
            self.state = AFTER[self.state, role[0]]
        elif edit == "R":
            to = NEXT[self.state]
            self.put(ROLE[to], text)
            self.state = AFTER[self.state, to]

    def more(self, audit: str) -> None:
        self.audit, self.at = self.audit[self.at:] + audit, 0


def _digests(schema: pa.Schema):
    def run(batches):
        now = None
        for b in batches:
            out = []
            for key, audit, role, text in zip(*(b.column(c).to_pylist() for c in ("key", "audit", "role", "text")), strict=True):
                if now is None or now.key != key:
                    if now is not None:
                        now.insert()
                        out.append((now.key, now.sha.hexdigest()))
                    now = Line(key)
                if audit is not None:
                    now.more(audit)
                else:
                    now.row(role, text)
            yield common.arrow_batch(schema, key=[k for k, _ in out], repaired_sha256=[d for _, d in out])
        if now is not None:
            now.insert()
            yield common.arrow_batch(schema, key=[now.key], repaired_sha256=[now.sha.hexdigest()])
    return run


def repaired_digests(rows: DataFrame, edited: DataFrame) -> DataFrame:
    """Streams each conversation, its edits ahead of its rows."""
    none = F.lit(None).cast("string")
    texts = rows.select("key", "turn", "role", _digest().alias("digest"), F.lit(-1).cast("long").alias("piece"), "text", none.alias("audit"))
    plan = edited.select("key", "first.turn", "first.role", "first.digest", "piece", none.alias("text"), "audit")
    lines = [F.col("audit").isNull(), F.col("piece")]
    stream = texts.unionByName(plan).repartition("key").sortWithinPartitions("key", *order(), *lines)
    return stream.select("key", "audit", "role", "text").mapInArrow(_digests(common.arrow_schema(DIGESTS)), DIGESTS)


def repair(conversations: DataFrame, piece_rows: int = 1024) -> DataFrame:
    """``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256)`` for every conversation of the table."""
    rows = damaged(conversations.select("conv_id", "turn", "role", "text"))
    pieces = common.saved(signatures(rows, piece_rows), "repair-pieces")
    tables = common.saved(cost_tables(pieces), "repair-tables")
    edited = common.saved(edits(pieces, tables), "repair-edits")
    # a turn that goes on over two pieces is told apart in the piece where it starts
    facts = edited.groupBy("key").agg(
        F.coalesce(F.max("high") - F.min("low") + 1 - F.sum("turns"), F.lit(0)).alias("gaps"),
        *[F.sum(c).alias(c) for c in COUNTS[1:]], F.sum("cost").alias("cost"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    facts = facts.join(repaired_digests(rows, edited), "key")
    every = conversations.select("conv_id").distinct().withColumn("key", key_of())
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in [*COUNTS, "cost"]]
    return every.join(facts, "key", "left").select(
        "conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
