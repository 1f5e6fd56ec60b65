"""Conversation repair: turns aligned to alternating targets at the least cost, with an audit of the edits."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.registry import query, table

#: Costs of the edits: keep, rerole, delete, insert; a truncated turn that stays costs LEFT more.
REROLE, DELETE, INSERT, LEFT = 3, 4, 3, 3
FAR = 1 << 40
#: Turns aligned in one table; a longer conversation is aligned block by block.
BLOCK = 256
#: Conversations of up to SHORT turns with the same codes are aligned once a worker.
SHORT, REMEMBERED = 64, 1 << 16
LAST = re.compile(r"[^\x20\x09-\x0D](?=[\x20\x09-\x0D]*\Z)")
#: Rows of results that a task holds before it hands them on.
OUT_ROWS, OUT_CHARS = 4096, 4 << 20


class Block:
    """Wagner-Fischer tables of one block of turns against alternating targets of every feasible length.

    ``codes`` has a letter a turn: its role's initial (o: another), upper case if truncated, d if it
    must go. Targets end in an assistant, so what is left of one is known by its length. Table q
    holds the least cost from (turn i, r symbols left in this block), where after the block the rest
    is empty (0), odd (1) or even and not empty (2), at the costs ``after``.

    Only cells are computed that an alignment of cost ``bound`` can touch (Ukkonen): a shift by one
    target symbol costs an insert, by one turn a delete. The bound starts as a guess; while a cost
    found is above it, that cost becomes the bound, so all cheapest alignments lie inside.
    """

    def __init__(self, codes: str, after: list[int], last: bool) -> None:
        self.codes, self.after, self.last = codes, after, last
        bound = DELETE * codes.count("d") + LEFT * sum(c.isupper() for c in codes) + 4 * REROLE
        while True:
            self.down, self.up = bound // DELETE + 1, bound // INSERT + 1
            self.tables = [self._table(q) if after[q] < FAR else None for q in range(3)]
            worst = max((c for q in range(3) for c in self._own_costs(q)), default=0)
            if worst <= bound:
                break
            bound = worst

    def left(self, i: int) -> np.ndarray:
        """Target symbols left at each cell of row i."""
        return np.arange(-self.down, self.up + 1) + len(self.codes) - i

    def substitution(self, i: int, q: int, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cost of turn i standing at each cell's next symbol, and where its role is that symbol."""
        code = self.codes[i]
        even = (left + q) % 2 == 0
        same = even if code in "uU" else ~even if code in "aA" else np.zeros(len(left), bool)
        cost = np.where(same, 0, REROLE) + (LEFT if code.isupper() else 0)
        return np.where((left >= 1) & (code != "d"), cost, FAR), same

    def _table(self, q: int) -> list[np.ndarray]:
        left = self.left(len(self.codes))
        if self.last:
            row = np.where(left >= 0, self.after[q] + INSERT * left, FAR)
        else:  # inserts between two blocks belong to the later one
            row = np.where(left == 0, self.after[q], FAR)
        rows, ramp = [row], INSERT * np.arange(len(left))
        for i in range(len(self.codes) - 1, -1, -1):
            left = self.left(i)
            deleted = np.append(row[1:], FAR) + DELETE
            best = np.minimum(deleted, row + self.substitution(i, q, left)[0])
            best[left < 0] = FAR
            row = np.minimum(np.minimum.accumulate(best - ramp) + ramp, FAR)
            rows.append(row)
        return rows[::-1]

    def starts(self, q: int, state: int, i: int = 0) -> np.ndarray:
        """Cells of row i from which what is left is odd (state 1) or even and not empty (2)."""
        left = self.left(i)
        whole = (left + q) % 2 == state % 2
        return whole & (left >= 0) if state == 1 or q == 2 else whole & (left >= 1)

    def _own_costs(self, q: int) -> list[int]:
        if self.tables[q] is None:
            return []
        found = [self.tables[q][0][self.starts(q, state)].min(initial=FAR) for state in (1, 2)]
        return [int(c) - self.after[q] if c < FAR else 0 for c in found]

    def cost(self, state: int, i: int = 0) -> int:
        return min((int(t[i][self.starts(q, state, i)].min(initial=FAR)) for q, t in enumerate(self.tables) if t), default=FAR)

    def trace(self, states: set[int], i: int = 0) -> tuple[str, set[int]]:
        """The least audit of the cheapest alignments from row i on in any of the states, and the states after it.

        All cells that a prefix can have led to go on together, over all target lengths at once; each
        letter is the least that any of them has.
        """
        best = min(self.cost(s, i) for s in states)
        here = {}
        for q, t in enumerate(self.tables):
            if t:
                cells = np.zeros(len(t[i]), bool)
                for s in states:
                    cells |= self.starts(q, s, i)
                here[q] = cells & (t[i] == best)
        letters = []
        while i < len(self.codes):
            left = self.left(i)
            steps: dict[str, dict[int, np.ndarray]] = {letter: {} for letter in "DIKR"}
            for q, cells in here.items():
                now, then = self.tables[q][i], self.tables[q][i + 1]
                cost, same = self.substitution(i, q, left)
                deleted = cells & (now == np.append(then[1:], FAR) + DELETE)
                steps["D"][q] = np.insert(deleted, 0, False)[:-1]
                inserted = cells & (left >= 1) & (now == np.insert(now[:-1], 0, FAR) + INSERT)
                steps["I"][q] = np.append(inserted[1:], False)
                stays = cells & (cost < FAR) & (now == then + cost)
                steps["K"][q], steps["R"][q] = stays & same, stays & ~same
            letter = next(x for x in "DIKR" if any(cells.any() for cells in steps[x].values()))
            here = steps[letter]
            letters.append(letter)
            i += letter != "I"
        if self.last:
            letters += "I" * int(self.left(i)[here[0]].min())
        return "".join(letters), {q for q, cells in here.items() if cells.any()}


def repair(codes: str) -> tuple[int, str]:
    """(cost, audit) of the cheapest edits that make the roles (s?(ua)+)?; of several, the least audit in ASCII.

    Blocks are aligned from the last to the first, then read from the first to the last: what lies
    between two of them is known by whether the rest of the target is empty, odd or even.
    """
    cuts = list(range(0, len(codes), BLOCK))
    after, system = [0, FAR, FAR], []
    afters = {}
    for at in reversed(cuts):
        afters[at] = after
        block = Block(codes[at : at + BLOCK], after, at == cuts[-1])
        for i, code in enumerate(block.codes):
            if code in "sS":  # turns before it are deleted, it is kept, at least one pair follows
                cost = DELETE * (at + i) + (LEFT if code == "S" else 0) + block.cost(2, i + 1)
                system.append((cost, -(at + i)))
        after = [after[0] + DELETE * len(block.codes), block.cost(1), block.cost(2)]
    best = min([after[0], after[2], *(cost for cost, _ in system)])

    def audit(start: int, states: set[int]) -> str:
        at, parts = start // BLOCK * BLOCK if start < len(codes) else cuts[-1], []
        while True:
            last = at == cuts[-1]
            part, states = Block(codes[at : at + BLOCK], afters[at], last).trace(states, max(start - at, 0))
            parts.append(part)
            if last or states == {0}:
                return "".join(parts) + ("" if last else "D" * (len(codes) - at - BLOCK))
            at += BLOCK

    found = ["D" * len(codes)] if after[0] == best else []
    if after[2] == best:
        found.append(audit(0, {2}))
    if system and min(system)[0] == best:  # the last of these deletes most, so its audit is the least of them
        first = -min(system)[1]
        found.append("D" * first + "K" + audit(first + 1, {2}))
    return best, min(found)


remembered = lru_cache(maxsize=REMEMBERED)(repair)


class Conversation:
    """What is kept of the turns of one conversation that have passed: a letter and a digest each."""

    def __init__(self, key: str, conv_id) -> None:
        self.key, self.conv_id = key, conv_id
        self.codes, self.seen = [], set()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.before = None

    def add(self, turn, role: str, text: str) -> None:
        if turn is not None and turn != self.last:
            self.turns += 1
            self.first, self.last = turn if self.first is None else self.first, turn
        if self.before is not None and self.before + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = role[:1]
        digest = xxhash.xxh3_128_digest(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"))
        end = LAST.search(text)
        code = role[:1] if role[:1] in ("s", "u", "a") else "o"
        if end is None:
            self.blank, code = self.blank + 1, "d"
        elif digest in self.seen:
            self.duplicate, code = self.duplicate + 1, "d"
        elif end.group() not in ".!?":
            self.truncated, code = self.truncated + 1, code.upper()
        self.seen.add(digest)
        self.codes.append(code)

    def result(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        codes = "".join(self.codes)
        cost, audit = (remembered if len(codes) <= SHORT else repair)(codes) if codes else (0, "")
        return self.key, self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit


class Repaired:
    """The digest of a conversation's repaired turns, made while they pass."""

    def __init__(self, row: tuple) -> None:
        self.row, self.at, self.out, self.last, self.sha = row, 0, 0, "", hashlib.sha256()

    def _write(self, role: str, text: str) -> None:
        self.sha.update(("\n" if self.out else "").encode() + f"{role}:{text}".encode("utf-8", "surrogatepass"))
        self.out, self.last = self.out + 1, role[:1]

    def _next(self) -> str:
        return "assistant" if self.last == "u" else "user"

    def inserts(self) -> None:
        while self.row[-1][self.at : self.at + 1] == "I":
            self._write(self._next(), "")
            self.at += 1

    def add(self, role: str, text: str) -> None:
        self.inserts()
        letter = self.row[-1][self.at]
        if letter != "D":
            self._write(self._next() if letter == "R" else role, text)
        self.at += 1

    def result(self) -> tuple:
        self.inserts()
        return (*self.row, self.sha.hexdigest())


FIELDS = [
    ("key", "string"), ("conv_id", None), ("gaps", "bigint"), ("blank", "bigint"), ("duplicate", "bigint"), ("truncated", "bigint"),
    ("illegal", "bigint"), ("cost", "bigint"), ("audit", "string"), ("repaired_sha256", "string"),
]


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, chars = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    for row in rows:
        held.append(row)
        chars += len(row[8])
        if len(held) >= OUT_ROWS or chars >= OUT_CHARS:
            yield batch()
            held, chars = [], 0
    if held:
        yield batch()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage; a dropped row stays with a false ``there``.

    crc32("conv_id:turn") % 20 decides: 0 drops the row, 1 empties its text, 2 removes [.!?] from it,
    3 repeats it, 4 sets its role to user. Nulls are one space in what is hashed, in role and in text.
    """
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(
        "conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"),
        (F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))) % 20).alias("fate"),
    )
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        (F.col("fate") != 0).alias("there"), F.explode(F.when(F.col("fate") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    ).drop("copy")


def repair_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation.

    ``turns`` has conv_id, turn, role, text and ``there``; rows that are not there only name their
    conversation. Turns stand in the order of turn (nulls first), role, text. A null conv_id is one
    conversation like others, a null role or text one space; repeated rows are turns of their own; a
    conversation without turns has zeros, an empty audit and the digest of the empty text; an empty
    table gives no row. Other columns are not read.

    Two sorted passes stream the turns of a conversation through a task, one after another: the first
    keeps a letter and a digest of each and aligns the letters, the second starts with the audit and
    hashes the repaired turns as they pass. A conversation's digest is one sequential hash, so its
    turns pass one task whatever is done; no task holds their texts.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    clean = turns.select(
        F.coalesce(F.concat(F.lit("i"), F.col("conv_id").cast("string")), F.lit("n")).alias("key"), "conv_id",
        F.col("turn").cast("bigint").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")],
        F.col("there").cast("int").alias("place"),
    )

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def results() -> Iterator[tuple]:
            current = None
            for key, conv_id, turn, role, text, place in _rows(batches):
                if current is None or key != current.key:
                    if current is not None:
                        yield current.result()
                    current = Conversation(key, conv_id)
                if place:
                    current.add(turn, role, text)
            if current is not None:
                yield current.result()

        return _batches(results(), schema(9))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def results() -> Iterator[tuple]:
            current = None
            for key, conv_id, _turn, role, text, place, *counts in _rows(batches):
                if place == 0:
                    if current is not None:
                        yield current.result()
                    current = Repaired((key, conv_id, *counts))
                else:
                    current.add(role, text)
            if current is not None:
                yield current.result()

        return _batches(results(), schema(10))

    conv_type = pa.int64() if kind == "bigint" else pa.string() if kind == "string" else pa.int32()
    id_out = clean if kind in ("bigint", "string", "int") else clean.withColumn("conv_id", F.col("conv_id").cast("string"))
    conv_sql = kind if kind in ("bigint", "string", "int") else "string"

    if conv_sql == "string":
        conv_type = pa.string()

    def schema(n: int) -> pa.Schema:
        kinds = {"string": pa.string(), "bigint": pa.int64(), None: conv_type}
        return pa.schema([(name, kinds[k]) for name, k in FIELDS[:n]])

    def ddl(n: int) -> str:
        return ", ".join(f"{name} {k or conv_sql}" for name, k in FIELDS[:n])

    order = ["key", "place", F.asc_nulls_first("turn"), "role", "text"]
    marked = id_out.repartition("key").sortWithinPartitions(*order).mapInArrow(align, ddl(9))
    found = [name for name, _ in FIELDS[2:9]]
    heads = marked.select(
        "key", "conv_id", F.lit(None).cast("bigint").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(0).alias("place"), *found
    )
    there = id_out.where("place = 1")
    bodies = there.select("*", *[F.lit(None).cast(k).alias(name) for name, k in FIELDS[2:9]])
    both = heads.unionByName(bodies).repartition("key").sortWithinPartitions(*order)
    out = both.mapInArrow(digest, ddl(10)).drop("key")
    return out if conv_sql == kind else out.withColumn("conv_id", F.col("conv_id").cast(kind))


@query("op13_conversation_repair")
def op13_conversation_repair(spark, sf_dir):
    return repair_conversations(damaged(table(spark, sf_dir, "conversations")))
