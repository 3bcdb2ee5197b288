"""Conversation structure repaired at least cost: rank-convergence parallel Viterbi over blocks of turns.

A conversation's turns are edited until their role initials read ``(s?(ua)+)?``. Keep costs 0, Rerole (to user or assistant) 1,
Delete 2, Insert (an empty user or assistant turn, anywhere) 5, and a truncated turn that stays 5 more; blank and repeated
turns must go. Of the cheapest edits those with the ASCII-least initials are taken.

1. Equal rows of a conversation are one row with a count, and narrow rows (no texts) are numbered over range partitions, so
   a conversation with a third of all rows spreads. Each ``block`` of consecutive numbers is cut to pieces of one conversation.
2. Costs to the end run backwards in each piece, over four states (nothing yet, after s, after u, after a). A piece that goes
   on in the next block starts from a speculative vector. Fix-up passes rerun, from the next piece's vector, the pieces that
   started from another one, back to the row where both vectors differ only by a constant: from there nothing changes.
   Pieces that still wait after ``FIX_UPS`` passes (long runs of faulty turns never converge) are composed as min-plus
   matrices, twice as far each round.
3. The stitched costs say which edits are cheapest at each row, so each piece traces the least audit from its entry state;
   entry states of continued pieces are composed in the same way from the pieces before them.

Nulls: a null role or text is one space, null turns come first, and null conversation ids are one conversation. Ties of a
turn number go by role, then by the SHA-256 of the text. An empty role has no initial and can't be kept. An empty table has
no conversations. Other columns are left out, so their names can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import land, ship_package
from marketlens.operators.ranking import rank_globally

BLOCK = 4096
#: Plain passes before pieces are composed; every piece is settled either way.
FIX_UPS = 3
BLANKS = " \t\n\x0b\x0c\r"

_NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
_EMIT = (2, 2, 3, 2)
_ROLE = ("user", "user", "assistant", "user")  # what an insert or a rerole gives in each state
_FAR = 1 << 40
_END = (0, 10, 5, 0)  # costs after the last row
_GUESS = (0, 0, 0, 0)

Vector = tuple[int, int, int, int]
#: The code of a row: its initial, in capitals where truncated; ``-`` where it must go.
FORCED = "-"


def _level(v: list[int]) -> Vector:
    """Less the least cost: vectors that differ by a constant become equal."""
    least = min(v)
    return tuple(x - least if x < _FAR else _FAR for x in v)


def _closed(v: list[int]) -> list[int]:
    for _ in range(3):
        v = [min(x, 5 + v[_EMIT[s]]) for s, x in enumerate(v)]
    return v


class Step(dict):
    """``step[vector after a row, the row's code]``: the vector before it, its edits in each state as ``(initials, state after)``."""

    def __missing__(self, key: tuple[Vector, str]) -> tuple[Vector, tuple[tuple[str, int], ...]]:
        after, code = key
        initial, more = code.lower(), 5 if code.isupper() else 0
        ways = []
        for s in range(4):
            way = {"D": (2 + after[s], s)}
            if code != FORCED:
                if (s, initial) in _NEXT:
                    way["K"] = (more + after[_NEXT[s, initial]], _NEXT[s, initial])
                way["R"] = (1 + more + after[_EMIT[s]], _EMIT[s])
            ways.append(way)
        cost = _closed([min(c for c, _ in way.values()) for way in ways])
        out = []
        for s in range(4):
            edits = ""
            while True:
                if ways[s]["D"][0] != cost[s] and 5 + cost[_EMIT[s]] == cost[s]:
                    edits, s = edits + "I", _EMIT[s]
                    continue
                edit = next(e for e in "DKR" if e in ways[s] and (ways[s][e][0] == cost[s] or cost[s] >= _FAR))
                out.append((edits + edit, ways[s][edit][1]))
                break
        self[key] = _level(cost), tuple(out)
        return self[key]


_step = Step()


def backward(codes: str, end: Vector) -> list[Vector]:
    """Levelled cost vectors before each row and after the last."""
    out = [end]
    for c in reversed(codes):
        out.append(_step[out[-1], c][0])
    out.reverse()
    return out


def fixed_up(codes: str, old: Vector, new: Vector) -> Vector | None:
    """The start vector from ``new``, or None where both runs come to differ only by a constant."""
    for c in reversed(codes):
        if old == new:
            return None
        old, new = _step[old, c][0], _step[new, c][0]
    return None if old == new else new


def trace(codes: str, vectors: list[Vector], state: int) -> tuple[list[str], int]:
    edits = []
    for i, c in enumerate(codes):
        e, state = _step[vectors[i + 1], c][1][state]
        edits.append(e)
    return edits, state


def last_inserts(state: int) -> tuple[str, list[str]]:
    """Inserts after the last row of a conversation."""
    roles = []
    while state in (1, 2):
        roles.append(_ROLE[state])
        state = _EMIT[state]
    return "I" * len(roles), roles


def responses(codes: str) -> np.ndarray:
    """Cost from each state before a piece to each state after it."""
    out = np.empty((4, 4), np.int64)
    for t in range(4):
        v = _closed([0 if s == t else _FAR for s in range(4)])
        for c in reversed(codes):
            low, _ = _step[_level(v), c]
            # the levelled step lost its constant: what the cheapest way of this row adds
            v = [x + _rise(_level(v), c) + min(v) if x < _FAR else _FAR for x in low]
        out[:, t] = v
    return out


def _rise(after: Vector, code: str) -> int:
    """The least cost of a row before which ``after`` was levelled away."""
    more = 5 if code.isupper() else 0
    found = [2 + after[s] for s in range(4)]
    if code != FORCED:
        found += [more + after[t] for (_, i), t in _NEXT.items() if i == code.lower()]
        found += [1 + more + after[_EMIT[s]] for s in range(4)]
    return min(found)


def key(c: str) -> Column:
    """A conversation's id as text that is never null."""
    return F.when(F.col(c).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(c).cast("string")))


def classed_rows(turns: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Landed narrow rows, a row for equal ones: number ``n`` in the order of conversations and turns, ``k`` and ``conv_id``,
    ``turn, role, digest, initial, times`` and the fault of the first of them."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    body = F.rtrim(text, F.lit(BLANKS))
    rows = turns.select(
        F.col(conv_col).alias("conv_id"), key(conv_col).alias("k"), F.col("turn"), role.alias("role"), F.unhex(F.sha2(text, 256)).alias("digest"),
        (body == "").alias("blank"), (~F.right(body, F.lit(1)).isin(".", "!", "?")).alias("open"),
    )
    one = rows.groupBy("k", "turn", "role", "digest").agg(
        F.min("conv_id").alias("conv_id"), F.max("blank").alias("blank"), F.max("open").alias("open"), F.count(F.lit(1)).alias("times")
    )
    numbered = land(rank_globally(one, [("k", False), ("turn", False), ("role", False), ("digest", False)], row_number="n"), "repair-numbers")
    first = numbered.filter(~F.col("blank")).groupBy("k", "role", "digest").agg(F.min("n").alias("n")).select("n", F.lit(True).alias("first"))
    out = numbered.join(first, "n", "left").withColumns(
        {"first": F.coalesce("first", F.lit(False)), "initial": F.substring("role", 1, 1)}
    ).withColumn("truncated", F.col("first") & F.col("open"))
    known = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("x")
    code = F.when(~F.col("first"), F.lit(FORCED)).when(F.col("truncated"), F.upper(known)).otherwise(known)
    return land(out.select("n", "k", "conv_id", "turn", "role", "digest", "initial", "times", "blank", "first", "truncated", code.alias("code")), "repair-rows")


_LEGAL = {"su", "ua", "au"}


_PIECE = "block long, k string, id long, codes string, times array<long>, illegal long, head string, tail string, first boolean, last boolean"


def _pieces_of(block: pa.Table) -> pa.Table:
    """Pieces of one conversation each of a block of rows."""
    rows = block.sort_by("n").to_pydict()
    out = []
    for i, k in enumerate(rows["k"]):
        initial = rows["initial"][i]
        if not out or out[-1]["k"] != k:
            out.append({"block": rows["block"][i], "k": k, "id": rows["n"][i], "codes": [], "times": [], "head": initial, "illegal": 0, "tail": None})
        p = out[-1]
        p["illegal"] += (p["tail"] is not None and p["tail"] + initial not in _LEGAL) + rows["times"][i] - 1
        p["tail"] = initial
        p["codes"].append(rows["code"][i])
        p["times"].append(rows["times"][i])
    for at, p in enumerate(out):
        p |= {"first": at == 0, "last": at == len(out) - 1, "codes": "".join(p["codes"])}
    return pa.Table.from_pylist(out, _arrow(_PIECE))


def pieces(rows: DataFrame, block: int) -> DataFrame:
    """Landed pieces with the pieces before and after them in their conversation (null: none)."""
    cut = rows.select(F.floor((F.col("n") - 1) / block).cast("long").alias("block"), "n", "k", "code", "initial", "times")
    made = land(cut.groupBy("block").applyInArrow(_pieces_of, _PIECE), "repair-pieces")
    before = made.filter("last").select((F.col("block") + 1).alias("block"), "k", F.col("id").alias("prev"), F.col("tail").alias("prev_tail"))
    after = made.filter("first").select("block", "k", F.col("id").alias("next"), "head")
    links = land(before.join(after, ["block", "k"]), "repair-links")
    legal = F.concat("prev_tail", "head").isin(*_LEGAL)
    out = made.drop("head", "tail", "first", "last").join(links.select(F.col("prev").alias("id"), "next"), "id", "left")
    out = out.join(links.select(F.col("next").alias("id"), "prev", F.when(legal, 0).otherwise(1).alias("border")), "id", "left")
    return land(out.withColumn("illegal", F.col("illegal") + F.coalesce("border", F.lit(0))).drop("border"), "repair-lattice")


_KINDS = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}


def _arrow(schema: str) -> pa.Schema:
    return pa.schema([(name, _KINDS[kind]) for name, kind in (part.split() for part in schema.split(", "))])


def _each(df: DataFrame, schema: str, row: Callable[[dict], dict]) -> DataFrame:
    """``row`` over the rows of a frame, as dictionaries, a batch at a time."""
    kinds = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([{c: x[c] for c in kinds.names} for x in map(row, batch.to_pylist())], kinds)

    return df.mapInArrow(run, schema)


def resolved(chain: DataFrame, apply: Callable[[list, list], list], compose: Callable[[list, list], list]) -> DataFrame:
    """Values along chains: rows ``id, anchor, f, value`` where an unknown value is ``f`` of the anchor's. Each round takes the
    value of a known anchor, or else composes ``f`` with the anchor's and leaps to that one's anchor."""
    schema = "id long, anchor long, f array<long>, value array<long>"

    def leap(x: dict) -> dict:
        if x["their_value"] is not None:
            return {"id": x["id"], "anchor": None, "f": None, "value": apply(x["f"], x["their_value"])}
        return {"id": x["id"], "anchor": x["their_anchor"], "f": compose(x["f"], x["their_f"]), "value": None}

    chain = land(chain.select("id", "anchor", "f", "value"), "repair-chain")
    while chain.filter("value IS NULL").limit(1).count():
        theirs = chain.select(F.col("id").alias("anchor"), F.col("anchor").alias("their_anchor"), F.col("f").alias("their_f"), F.col("value").alias("their_value"))
        new = _each(chain.filter("value IS NULL").join(theirs, "anchor"), schema, leap)
        chain = land(chain.filter("value IS NOT NULL").unionByName(new), "repair-chain")
    return chain.select("id", "value")


def _apply_costs(f: list[int], v: list[int]) -> list[int]:
    return list(_level(np.minimum(np.array(f).reshape(4, 4) + np.array(v), _FAR).min(axis=1).tolist()))


def _compose_costs(f: list[int], g: list[int]) -> list[int]:
    a, b = np.array(f).reshape(4, 4), np.array(g).reshape(4, 4)
    return np.minimum((a[:, :, None] + b[None]).min(axis=1), _FAR).reshape(-1).tolist()


def start_vectors(linked: DataFrame) -> DataFrame:
    """``id, value``: the true levelled cost vector before each piece that another one goes on to or comes from."""
    schema = "id long, next long, assumed array<long>, value array<long>"

    def speculate(x: dict) -> dict:
        end = _END if x["next"] is None else _GUESS
        return x | {"assumed": list(end), "value": list(backward(x["codes"], end)[0])}

    def rerun(x: dict) -> dict:
        new = fixed_up(x["codes"], tuple(x["assumed"]), tuple(x["seen"]))
        return x | {"assumed": x["seen"], "value": x["value"] if new is None else list(new)}

    codes = linked.select("id", "codes")
    v = land(_each(linked.select("id", "next", "codes"), schema, speculate), "repair-vectors")
    for passes in range(FIX_UPS + 1):
        seen = v.select(F.col("id").alias("next"), F.col("value").alias("seen"))
        stale = v.join(seen, "next").filter(F.col("assumed") != F.col("seen"))
        if not stale.limit(1).count():
            return v.select("id", "value")
        if passes < FIX_UPS:
            new = _each(stale.join(codes, "id"), schema, rerun)
            v = land(v.join(new.select("id"), "id", "left_anti").unionByName(new), "repair-vectors")
    chain = linked.filter("next IS NOT NULL").select("id", "next", "codes")
    far = _each(chain, "id long, anchor long, f array<long>, value array<long>", lambda x: {"id": x["id"], "anchor": x["next"], "f": responses(x["codes"]).reshape(-1).tolist(), "value": None})
    ends = v.filter("next IS NULL").select("id", F.lit(None).cast("long").alias("anchor"), F.lit(None).cast("array<long>").alias("f"), "value")
    return resolved(far.unionByName(ends), _apply_costs, _compose_costs)


def entry_states(ended: DataFrame) -> DataFrame:
    """``id, value``: the state in which each linked piece begins, from the exit states of the piece before it."""

    def exits(x: dict) -> dict:
        vectors = backward(x["codes"], tuple(x["end"]))
        return {"prev": x["id"], "f": [trace(x["codes"], vectors, s)[1] for s in range(4)]}

    through = _each(ended.filter("next IS NOT NULL").select("id", "codes", "end"), "prev long, f array<long>", exits)
    later = ended.filter("prev IS NOT NULL").select("id", "prev").join(through, "prev").select("id", F.col("prev").alias("anchor"), "f", F.lit(None).cast("array<long>").alias("value"))
    first = ended.filter("prev IS NULL").select("id", F.lit(None).cast("long").alias("anchor"), F.lit(None).cast("array<long>").alias("f"), F.array(F.lit(0).cast("long")).alias("value"))
    return resolved(first.unionByName(later), lambda f, v: [f[v[0]]], lambda f, g: [f[s] for s in g]).select("id", F.col("value")[0].alias("entry"))


_COST = {"D": 2, "I": 5, "K": 0, "R": 1}


def _traced(x: dict) -> Iterator[dict]:
    """A piece's audit and cost, and a row for each turn that stays or is put after the last."""
    codes, end, state = x["codes"], tuple(x["end"] or _END), x["entry"] or 0
    edits, out = trace(codes, backward(codes, end), state)
    cost, audit = 0, []
    for i, (edit, code, times) in enumerate(zip(edits, codes, x["times"], strict=True)):
        audit.append(edit + "D" * (times - 1))
        cost += sum(map(_COST.__getitem__, edit)) + 2 * (times - 1) + (5 if code.isupper() and edit[-1] != "D" else 0)
        before = []
        for _ in range(len(edit) - 1):
            before.append(_ROLE[state])
            state = _EMIT[state]
        if edit[-1] == "R":
            state, role = _EMIT[state], _ROLE[state]
        elif edit[-1] == "K":
            state, role = _NEXT[state, code.lower()], None
        else:
            continue
        yield {"n": x["id"] + i, "k": x["k"], "before": before, "rerole": role}
    if x["next"] is None:
        letters, before = last_inserts(out)
        audit.append(letters)
        cost += 5 * len(before)
        if before:
            yield {"n": x["id"] + len(codes), "k": x["k"], "before": before, "last": True}
    yield {"n": x["id"], "k": x["k"], "audit": "".join(audit), "cost": cost, "illegal": x["illegal"]}


_TRACED = "n long, k string, before array<string>, rerole string, last boolean, audit string, cost long, illegal long"


def edits(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Landed edits of classed rows: audits of pieces (``audit`` not null), and turns that stay or are put at the end."""
    ship_package(rows.sparkSession)
    lattice = pieces(rows, block)
    linked = lattice.filter("next IS NOT NULL OR prev IS NOT NULL")
    plain = lattice.filter("next IS NULL AND prev IS NULL").withColumns({"end": F.lit(None).cast("array<long>"), "entry": F.lit(None).cast("long")})
    if linked.limit(1).count():
        value = start_vectors(linked)
        ended = land(linked.join(value.select(F.col("id").alias("next"), F.col("value").alias("end")), "next", "left"), "repair-ends")
        ended = ended.withColumn("end", F.coalesce("end", F.array(*[F.lit(x).cast("long") for x in _END])))
        plain = plain.unionByName(ended.join(entry_states(ended), "id"))

    kinds = _arrow(_TRACED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                made = [y for x in batch.slice(at, 1000).to_pylist() for y in _traced(x)]
                yield pa.RecordBatch.from_pylist([{c: y.get(c) for c in kinds.names} for y in made], kinds)

    return land(plain.mapInArrow(run, _TRACED), "repair-edits")


def report(rows: DataFrame, edited: DataFrame) -> DataFrame:
    """A row a conversation: ``k, conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit``."""
    times = F.col("times")
    counts = rows.groupBy("k").agg(
        F.min("conv_id").alias("conv_id"),
        (F.max("turn") - F.min("turn") + 1).alias("span"),
        F.sum(F.when(F.col("blank"), times).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("blank"), 0).when(F.col("first"), times - 1).otherwise(times)).alias("duplicate"),
        F.sum(F.col("truncated").cast("long")).alias("truncated"),
    )
    turns = rows.filter("turn IS NOT NULL").select("k", "turn").distinct().groupBy("k").agg(F.count(F.lit(1)).alias("turns"))
    parts = edited.filter("audit IS NOT NULL").groupBy("k").agg(
        F.sum("illegal").alias("illegal"),
        F.sum("cost").alias("cost"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "audit"))), lambda x: x["audit"]), "").alias("audit"),
    )
    gaps = F.coalesce(F.col("span") - F.col("turns"), F.lit(0)).cast("long")
    return counts.join(turns, "k", "left").join(parts, "k").select("k", "conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def repaired(turns: DataFrame, rows: DataFrame, edited: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """The repaired turns: ``k, n, place, role, text``, in the order of ``n`` and ``place``. Texts move once, to the kept rows."""
    texts = turns.select(key(conv_col).alias("k"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    texts = texts.groupBy("k", "role", F.unhex(F.sha2("text", 256)).alias("digest")).agg(F.first("text").alias("text"))
    staying = edited.filter("audit IS NULL AND last IS NULL").drop("k").join(rows.select("n", "k", "role", "digest"), "n").join(texts, ["k", "role", "digest"])
    inserted = F.transform("before", lambda r: F.struct(r.alias("role"), F.lit("").alias("text")))
    own = F.struct(F.coalesce("rerole", "role").alias("role"), F.col("text").alias("text"))
    lines = staying.select("k", "n", F.concat(inserted, F.array(own)).alias("lines"))
    lines = lines.unionByName(edited.filter("last").select("k", "n", inserted.alias("lines")))
    return lines.select("k", "n", F.posexplode("lines").alias("place", "line")).select("k", "n", "place", "line.role", "line.text")


def digests(turns: DataFrame) -> DataFrame:
    """``k, digest``: SHA-256 of ``role:text`` lines joined by newlines. A digest takes a conversation's lines one after
    the other, so a task streams them; it holds no more than a batch."""
    ordered = turns.select("k", "n", "place", F.concat("role", F.lit(":"), "text").alias("line")).repartition("k").sortWithinPartitions("k", "n", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, done = None, None, []
        for batch in batches:
            for k, line in zip(batch.column("k").to_pylist(), batch.column("line").to_pylist(), strict=True):
                if k != key:
                    if key is not None:
                        done.append((key, state.hexdigest()))
                    key, state = k, hashlib.sha256(line.encode())
                else:
                    state.update(b"\n" + line.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*done, strict=True)], ["k", "digest"])
                done = []
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([state.hexdigest()])], ["k", "digest"])

    return ordered.select("k", "line").mapInArrow(run, "k string, digest string")


def damaged(turns: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Rows damaged by the CRC of ``conversation:turn``: of twenty, one is dropped, one emptied, one loses its sentence marks,
    one is repeated, one becomes a user's. Nulls are one space."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat_ws(":", part(conv_col), part("turn"))) % 20
    text = F.when(fate == 1, "").when(fate == 2, F.regexp_replace(part("text"), "[.!?]", "")).otherwise(part("text"))
    role = F.when(fate == 4, "user").otherwise(part("role"))
    rows = turns.select(F.col(conv_col).alias("conv_id"), "turn", role.alias("role"), text.alias("text"), fate.alias("fate")).filter("fate != 0")
    return rows.withColumn("again", F.explode(F.sequence(F.lit(1), F.when(F.col("fate") == 3, 2).otherwise(1)))).select("conv_id", "turn", "role", "text")
