"""Conversation repair: the cheapest edits that give every conversation the roles `(s?(ua)+)?`, by a recursive query in each partition.

Spark damages the rows, finds each row's first fault (repeats by a window over conversation, role and text) and deals the rows out by a hash of
the conversation, sorted by turn. A task cuts what it reads into slices and a conversation in a slice into pieces of 64 rows. DuckDB walks all
pieces of a slice at once: each recursion advances every piece by one row and keeps, for each grammar state in which the piece can begin
and each in which it can be now, the least cost and the ASCII-least audit of that cost. The pieces of a conversation are then
put together in order, over a state's least (cost, order of the audit before, audit of the piece); so neither the depth of a
recursion nor its strings grow with a conversation. A conversation is never held as a whole: what all four states share is decided, its text goes into
the hash, and its rows are let go. Only the audit, which is a result, grows with it.

Grammar states: 0 nothing, 1 after s, 2 after u, 3 after a. A conversation may end in 0 or 3. Two audits of the same rows are never one the
beginning of the other, since both have one letter other than I for each row and end in one; so ties are settled piece by piece.

Nulls: a null role or text is one space, a null id or turn is one space in the checksum; the rows without an id are one conversation.
Null turns come first; rows of one turn are ordered by role and text, so that repeated rows are adjacent. A conversation of which the damage leaves
nothing has zeros and the hash of the empty string; an empty table gives no rows. A number of gaps beyond a long is the largest long.
Texts may have any length. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimloom.llm import common

#: Rows of a piece, and rows and bytes of text of a slice.
PIECE, SLICE_ROWS, SLICE_BYTES = 64, 4096, 8 << 20
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
BLANK, DUPLICATE, CUT_OFF = 1, 2, 3
SPACE = "\\x20\\x09-\\x0D"
#: Of each state: the role that an inserted or reroled row takes, and the state after it.
ROLE = ("user", "user", "assistant", "user")
AFTER = (2, 2, 3, 2)
#: Of each state: the initials that may be kept, and the state after them; the inserts with which a conversation can end.
KEPT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
LAST = ("", "II", "I", "")
OUT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def edits() -> list[tuple[int, str, bool, str, int, int]]:
    """(state, initial or *, keeps the row, letters, cost, state after) of all that can be done before and with one row."""
    out = []
    for state in range(4):
        at, letters = state, ""
        while len(letters) < 3 and (at != state or not letters):
            spent = INSERT * len(letters)
            out.append((state, "*", False, f"{letters}D", spent + DELETE, at))
            out.append((state, "*", True, f"{letters}R", spent + REROLE, AFTER[at]))
            out += [(state, initial, True, f"{letters}K", spent + KEEP, then) for initial, then in KEPT[at].items()]
            at, letters = AFTER[at], f"{letters}I"
    return out


#: turns (c, i, initial, must, extra): row i of piece c; seeds (c, n, start): pieces of n rows with the states in which they can begin.
WALK = f"""
    with recursive edits(state, initial, keeps, letters, cost, after) as (values {", ".join(str(e) for e in edits())}),
    walk as (
      select c, n, 0 as i, start, start as state, {{'cost': 0::bigint, 'audit': ''}} as best from seeds
      union all
      select c, n, i + 1, start, after, min({{'cost': cost, 'audit': audit}})
      from (
        select w.c, w.n, w.i, w.start, e.after, w.best.cost + e.cost + case when e.keeps then t.extra else 0 end as cost, w.best.audit || e.letters as audit
        from walk w join turns t on t.c = w.c and t.i = w.i join edits e on e.state = w.state and e.initial in ('*', t.initial) and not (t.must and e.keeps))
      group by c, n, i, start, after)
    select c, start, state, best.cost as cost, best.audit as audit from walk where i = n"""


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, text, gone: the rows as the checksum of `conv_id:turn` damages them. Those that it drops stay, as gone, without role and text."""
    space = F.lit(" ")
    part = lambda name: F.coalesce(F.col(f"`{name}`").cast("string"), space)
    kind = F.crc32(F.encode(F.concat(part(conv), F.lit(":"), part(turn)), "UTF-8")) % 20
    slim = rows.select(F.col(f"`{conv}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").cast("long").alias("turn"), part(role).alias("role"), part(text).alias("text"), kind.alias("kind"))
    k = F.col("kind")
    said = F.when(k == 1, "").when(k == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    once = slim.select("conv_id", "turn", F.when(k != 0, F.when(k == 4, "user").otherwise(F.col("role"))).alias("role"), F.when(k != 0, said).alias("text"), (k == 0).alias("gone"), F.when(k == 3, 2).otherwise(1).alias("times"))
    return once.select("conv_id", "turn", "role", "text", "gone", F.explode(F.sequence(F.lit(1), "times"))).drop("col")


def with_faults(rows: DataFrame) -> DataFrame:
    """rows with fault: the first of blank, duplicate and truncated that a row has, else 0."""
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "text", "gone").orderBy(F.col("turn").asc_nulls_first()))
    fault = F.when(~F.col("text").rlike(f"[^{SPACE}]"), BLANK).when(F.col("seen") > 1, DUPLICATE).when(~F.col("text").rlike(f"[.!?][{SPACE}]*\\z"), CUT_OFF).otherwise(0)
    return rows.withColumn("seen", seen).withColumn("fault", F.when(F.col("gone"), 0).otherwise(fault)).drop("seen")


class Conversation:
    """A conversation as far as it has been read."""

    def __init__(self, id_: int | None) -> None:
        self.id, self.faults, self.illegal, self.initial = id_, [0, 0, 0, 0], 0, None
        self.least = self.last = None  # turns
        self.turns = 0
        self.live = {0: (0, 0, (None, ""))}  # state -> cost, place among the audits, (node before, audit of the last piece)
        self.open: list[list[tuple[str, str]]] = []  # rows of the pieces that are not decided
        self.audit: list[str] = []
        self.hash, self.state, self.begun = hashlib.sha256(), 0, False

    def count(self, turns: list, roles: list, faults: list) -> None:
        for turn, role, fault in zip(turns, roles, faults):
            self.faults[fault] += 1
            if self.initial is not None:
                self.illegal += self.initial + role[:1] not in ("su", "ua", "au")
            self.initial = role[:1]
            if turn is not None and turn != self.last:
                self.least, self.last, self.turns = turn if self.least is None else self.least, turn, self.turns + 1

    def add(self, piece: dict[tuple[int, int], tuple[int, str]], rows: list[tuple[str, str]]) -> None:
        """Go on by one piece: (start, state) -> (cost, audit), and its rows."""
        best: dict[int, tuple] = {}
        for (start, state), (cost, audit) in piece.items():
            if start in self.live:
                before, place, node = self.live[start]
                best[state] = min(best.get(state, ((1 << 62,),)), ((before + cost, place, audit), node), key=lambda x: x[0])
        places = {state: i for i, state in enumerate(sorted(best, key=lambda s: best[s][0][1:]))}
        self.live = {state: (key[0], places[state], (node, key[2])) for state, (key, node) in best.items()}
        self.open.append(rows)
        nodes, above = [x[2] for x in self.live.values()], 0
        while nodes[0][0] is not None and len({id(x) for x in nodes}) > 1:
            nodes, above = [x[0] for x in nodes], above + 1
        if len({id(x) for x in nodes}) == 1 and (ready := len(self.open) - above) > 0:
            self.decide(nodes[0], self.open[:ready])
            self.open = self.open[ready:]
            if above:
                self.live = {s: (c, p, self._after(node, above)) for s, (c, p, node) in self.live.items()}
            else:
                self.live = {s: (c, p, (None, "")) for s, (c, p, _) in self.live.items()}

    def _after(self, node: tuple, depth: int) -> tuple:
        """The last depth pieces of a chain, upon nothing."""
        pieces = []
        for _ in range(depth):
            pieces.append(node[1])
            node = node[0]
        out = (None, "")
        for audit in reversed(pieces):
            out = (out, audit)
        return out

    def decide(self, node: tuple | None, pieces: list[list[tuple[str, str]]]) -> None:
        audits = []
        while node is not None and len(audits) < len(pieces):
            audits.append(node[1])
            node = node[0]
        for audit, rows in zip(reversed(audits), pieces):
            self.write(audit, rows)

    def write(self, audit: str, rows: list[tuple[str, str]]) -> None:
        self.audit.append(audit)
        at = iter(rows)
        for letter in audit:
            role, text = ("", "") if letter == "I" else next(at)
            if letter != "D":
                state = KEPT[self.state][role[:1]] if letter == "K" else AFTER[self.state]
                said = f"{role if letter == 'K' else ROLE[self.state]}:{text}"
                self.hash.update((f"\n{said}" if self.begun else said).encode("utf-8", "surrogatepass"))
                self.state, self.begun = state, True

    def end(self) -> dict[str, object]:
        cost, _, _, state, node = min((cost + INSERT * len(LAST[s]), place, LAST[s], s, node) for s, (cost, place, node) in self.live.items())
        self.decide(node, self.open)
        self.write(LAST[state], [])
        gaps = 0 if self.least is None else min(self.last - self.least + 1 - self.turns, (1 << 63) - 1)
        return {
            "conv_id": self.id, "gaps": gaps, "blank": self.faults[BLANK], "duplicate": self.faults[DUPLICATE], "truncated": self.faults[CUT_OFF], "illegal": self.illegal,
            "cost": cost, "audit": "".join(self.audit), "repaired_sha256": self.hash.hexdigest(),
        }


def walked(con, pieces: list[tuple[bool, list[str], list[int]]]) -> list[dict[tuple[int, int], tuple[int, str]]]:
    """For each piece (does it begin a conversation, roles, faults): (start, state) -> (cost, audit)."""
    c = [k for k, (_, roles, _) in enumerate(pieces) for _ in roles]
    i = [n for _, roles, _ in pieces for n in range(len(roles))]
    initials, faults = [r[:1] for _, roles, _ in pieces for r in roles], [f for _, _, found in pieces for f in found]
    turns = pa.table({"c": pa.array(c, pa.int32()), "i": pa.array(i, pa.int32()), "initial": pa.array(initials, pa.string()), "must": pa.array([f in (BLANK, DUPLICATE) for f in faults], pa.bool_()), "extra": pa.array([TRUNCATED if f == CUT_OFF else 0 for f in faults], pa.int64())})
    begin = [(k, len(roles), s) for k, (first, roles, _) in enumerate(pieces) for s in ((0,) if first else range(4))]
    seeds = pa.table({name: pa.array([x[at] for x in begin], pa.int32()) for at, name in enumerate(("c", "n", "start"))})
    con.register("turns", turns)
    con.register("seeds", seeds)
    out: list[dict] = [{} for _ in pieces]
    for k, start, state, cost, audit in con.execute(WALK).fetchall():
        out[k][start, state] = cost, audit
    return out


def repair(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, gone, fault) -> one row for each conversation."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(OUT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect()
        con.execute("set threads = 1")
        con.execute("set memory_limit = '1GB'")
        con.execute("set temp_directory = ''")
        now: Conversation | None = None
        for batch in common.slices((b.slice(at, SLICE_ROWS) for b in batches for at in range(0, b.num_rows, SLICE_ROWS)), "text", SLICE_BYTES):
            columns = batch.to_pydict()
            ids, gone, done, work = columns["conv_id"], columns["gone"], [], []  # work: conversation, rows
            for k, id_ in enumerate(ids):
                if now is None or id_ != now.id:
                    if now is not None:
                        done.append(now)
                    now = Conversation(id_)
                if not work or work[-1][0] is not now:
                    work.append((now, []))
                if not gone[k]:
                    work[-1][1].append(k)
            pieces, parts = [], []
            for conversation, places in work:
                first = conversation.initial is None
                get = lambda name, at: [columns[name][k] for k in at]
                for start in range(0, len(places), PIECE):
                    at = places[start : start + PIECE]
                    roles, faults = get("role", at), get("fault", at)
                    conversation.count(get("turn", at), roles, faults)
                    pieces.append((first and start == 0, roles, faults))
                    parts.append((conversation, list(zip(roles, get("text", at)))))
            if pieces:
                for piece, (conversation, said) in zip(walked(con, pieces), parts):
                    conversation.add(piece, said)
            if done:
                yield pa.RecordBatch.from_pylist([x.end() for x in done], schema=arrow)
        if now is not None:
            yield pa.RecordBatch.from_pylist([now.end()], schema=arrow)
        con.close()

    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text", F.col("fault") == DUPLICATE]
    return rows.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "gone", F.col("fault").cast("int").alias("fault")).mapInArrow(run, OUT)


def op13_recursive_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(with_faults(damaged(common.table(spark, sf_dir, "conversations"))))


#: The whole table in one recursion, with what is said beside the audit; the checksum is made from the table of its polynomial.
ORACLE_SQL = f"""
    with recursive tab as (select list(list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i) order by i) as t from range(256) r(i)),
    keyed as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as k from conversations),
    summed as (select k, xor(4294967295, list_reduce(list_transform(string_split(k, ''), lambda x: unicode(x)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295)) % 20 as kind from (select distinct k from keyed), tab),
    hurt as (
      select conv_id, turn, case when kind = 4 then 'user' else role end as role, case when kind = 1 then '' when kind = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
      from keyed join summed using (k), range(2) r(n) where kind <> 0 and (n = 0 or kind = 3)),
    placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i, left(role, 1) as initial, regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) as final from hurt),
    seen as (select *, row_number() over (partition by conv_id, role, text order by i) as time, lag(initial) over (partition by conv_id order by i) as last from placed),
    faults as (select *, case when final = '' then 'b' when time > 1 then 'd' when final not in ('.', '!', '?') then 't' else '' end as fault from seen),
    edits(state, initial, keeps, letters, cost, after, inserted, given) as (
      select state, initial, keeps, letters, cost, after,
        case length(letters) when 1 then '' when 2 then case when state = 2 then 'assistant:' else 'user:' end || chr(10) else 'user:' || chr(10) || 'assistant:' || chr(10) end,
        case when (state = 2) = (length(letters) = 2) then 'user:' else 'assistant:' end
      from (values {", ".join(str(e) for e in edits())}) v(state, initial, keeps, letters, cost, after)),
    sizes as (select c.conv_id, count(i) as n from (select distinct conv_id from conversations) c left join faults f on f.conv_id is not distinct from c.conv_id group by c.conv_id),
    walk as (
      select conv_id, n, 0::bigint as i, 0 as state, {{'cost': 0::bigint, 'audit': '', 'said': ''}} as best from sizes
      union all
      select conv_id, n, i + 1, after, min({{'cost': cost, 'audit': audit, 'said': said}}) from (
        select w.conv_id, w.n, w.i, e.after, w.best.cost + e.cost + case when e.keeps and f.fault = 't' then 3 else 0 end as cost, w.best.audit || e.letters as audit,
          w.best.said || e.inserted || case right(e.letters, 1) when 'K' then f.role || ':' || f.text || chr(10) when 'R' then given || f.text || chr(10) else '' end as said
        from walk w join faults f on f.conv_id is not distinct from w.conv_id and f.i = w.i + 1 join edits e on e.state = w.state and e.initial in ('*', f.initial) and not (e.keeps and f.fault in ('b', 'd')))
      group by conv_id, n, i, after),
    ended as (
      select conv_id, min({{'cost': best.cost + v.cost, 'audit': best.audit || v.letters, 'said': best.said || v.said}}) as best
      from walk w join (values (0, '', 0, ''), (1, 'II', 6, 'user:' || chr(10) || 'assistant:' || chr(10)), (2, 'I', 3, 'assistant:' || chr(10)), (3, '', 0, '')) v(state, letters, cost, said) on v.state = w.state where i = n group by conv_id),
    counted as (
      select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where fault = 'b') as blank, count(*) filter (where fault = 'd') as duplicate, count(*) filter (where fault = 't') as truncated,
        count(*) filter (where i > 1 and last || initial not in ('su', 'ua', 'au')) as illegal from faults group by conv_id)
    select e.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, best.cost as cost, best.audit as audit, sha256(left(best.said, length(best.said) - 1)) as repaired_sha256
    from ended e left join counted c on c.conv_id is not distinct from e.conv_id"""
