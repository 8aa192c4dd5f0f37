"""Repair of conversation structure: error-correcting Earley parsing of roles.

The grammar of a conversation's role initials is

    Talk  -> nothing | Start Pair | Talk Pair
    Start -> nothing | s
    Pair  -> u a

and terminals have error productions: a row is kept where its role fits, reroled to user
or assistant, or deleted, and a user or assistant row without text is inserted. A chart
item is a dotted rule with the place where it began; it retains the least (cost, audit)
since then, the audit being the edits' initials. What competes for an item has taken the
same rows, so an audit that is the beginning of another one has fewer inserts and costs
less, and the least of two stays the least whatever follows.

The same holds for parts of a conversation: a part is parsed from each of the places a
talk can be at (``ITEMS``), and parts are joined by adding costs and appending audits.
Rows are dealt by ranges of (conversation, turn), so a long conversation is spread over
tasks, each of which parses its parts; only the parts' charts and the audit, a letter a
row, meet, in order and one after the other. Texts are never gathered: a text waits for
the parse of its part at most, and the digest of a conversation in several parts is made
from its rows as they go by.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

#: What edits cost; a truncated row that isn't deleted adds the last.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
SPACE = " \t\n\x0b\x0c\r"
#: Rows of a part, and characters of text that wait for its parse.
PART_ROWS, PART_CHARS = 128, 4 << 20
ROLES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}

RULES = (("Talk", ()), ("Talk", ("Start", "Pair")), ("Talk", ("Talk", "Pair")), ("Start", ()), ("Start", ("s",)), ("Pair", ("u", "a")))
EMPTY, FIRST, MORE, _, _, PAIR = range(len(RULES))
OF = {name: [n for n, (left, _) in enumerate(RULES) if left == name] for name, _ in RULES}
#: Where a talk can be: before its start, after a system row, within a pair, after a pair.
ITEMS = BEGIN, SYSTEM, INNER, PAIRED = range(4)
NOTHING = (0, "")


def _add(items: dict, item: tuple, value: tuple[int, str]) -> bool:
    if item not in items or value < items[item]:
        items[item] = value
        return True
    return False


def _then(a: tuple[int, str], b: tuple[int, str]) -> tuple[int, str]:
    return a[0] + b[0], a[1] + b[1]


def _close(sets: dict[int, dict], j: int) -> None:
    """Predicts, completes and inserts within a chart set until nothing gets better."""
    items = sets[j]
    todo = list(items)
    while todo:
        item = todo.pop()
        rule, dot, origin = item
        value, right = items[item], RULES[rule][1]
        if dot == len(right):
            made = [((r, d + 1, o), _then(v, value)) for (r, d, o), v in sets[origin].items() if RULES[r][1][d : d + 1] == (RULES[rule][0],)]
        elif right[dot] in OF:
            made = [((r, 0, j), NOTHING) for r in OF[right[dot]]]
            # what is complete without a row may have been met before this item was there
            made += [((rule, dot + 1, origin), _then(value, v)) for (r, d, o), v in items.items() if o == j and d == len(RULES[r][1]) and RULES[r][0] == right[dot]]
        else:
            made = [((rule, dot + 1, origin), _then(value, (INSERT, "I")))] if right[dot] in ROLES else []
        todo += [m for m, v in made if _add(items, m, v)]
    # what follows an open pair doesn't depend on where it began: the best one stays
    pairs = {x: min(_then(v, items[x]) for v in _waiting(sets[x[2]])) for x in items if x[:2] == (PAIR, 1)}
    for x in sorted(pairs, key=pairs.get)[1:]:
        del items[x]


def _waiting(items: dict):
    """The values of items that wait for a pair."""
    return [v for (r, d, _), v in items.items() if RULES[r][1][d : d + 1] == ("Pair",)]


def _scan(items: dict, symbol: str) -> dict:
    """The next set before it is closed. A symbol is a role's initial, a space for none of
    the grammar's; ``!`` before it says that the row has to go, ``~`` that it is truncated."""
    role, after, cut = symbol[-1], {}, TRUNCATED * symbol.startswith("~")
    for (rule, dot, origin), value in items.items():
        left, right = RULES[rule]
        if dot and (dot < len(right) or left == "Talk") or rule in (EMPTY, FIRST):
            _add(after, (rule, dot, origin), _then(value, (DELETE, "D")))
        if symbol[0] != "!" and dot < len(right) and right[dot] not in OF:
            if right[dot] == role:
                _add(after, (rule, dot + 1, origin), _then(value, (cut, "K")))
            elif right[dot] in ROLES:
                _add(after, (rule, dot + 1, origin), _then(value, (REROLE + cut, "R")))
    return after


@lru_cache(maxsize=1 << 14)
def _parsed(symbols: tuple[str, ...], begin: int) -> tuple[tuple[int, int, str], ...]:
    before = {BEGIN: {}, SYSTEM: {(MORE, 0, -1): NOTHING}, INNER: {(MORE, 0, -1): NOTHING, (MORE, 1, -1): NOTHING}, PAIRED: {(MORE, 0, -1): NOTHING}}
    seed = {BEGIN: [(r, 0, 0) for r in OF["Talk"]], SYSTEM: [(FIRST, 1, -1)], INNER: [(PAIR, 1, -1)], PAIRED: [(MORE, 2, -1)]}
    sets = {-1: before[begin], 0: dict.fromkeys(seed[begin], NOTHING)}
    _close(sets, 0)
    for j, symbol in enumerate(symbols, 1):
        sets[j] = _scan(sets[j - 1], symbol)
        _close(sets, j)
    out: dict[int, tuple[int, str]] = {}
    for (rule, dot, origin), value in sets[len(symbols)].items():
        if rule == EMPTY and origin == 0:
            _add(out, BEGIN, value)
        elif rule == FIRST and dot == 1:
            _add(out, SYSTEM, value)
        elif rule in (FIRST, MORE) and dot == 2:
            _add(out, PAIRED, value)
        elif rule == PAIR and dot == 1:
            _add(out, INNER, min(_then(v, value) for v in _waiting(sets[origin])))
    return tuple((k, *v) for k, v in out.items())


def parse(symbols, begin: int = BEGIN) -> dict[int, tuple[int, str]]:
    """Where a part that begins at ``begin`` can end, and the least (cost, audit) of it."""
    return {k: (cost, audit) for k, cost, audit in _parsed(tuple(symbols), begin)}


def joined(chart: dict[int, tuple[int, str]], part: dict[int, dict[int, tuple[int, str]]]) -> dict[int, tuple[int, str]]:
    """Where a talk can be after a part, given what the part leads to from each place."""
    after: dict[int, tuple[int, str]] = {}
    for item, value in chart.items():
        for to, more in part.get(item, {}).items():
            _add(after, to, _then(value, more))
    return after


def repair(chart: dict[int, tuple[int, str]]) -> tuple[int, str]:
    """Cost and audit of a completed chart."""
    return min(chart[k] for k in (BEGIN, PAIRED) if k in chart)


class Writer:
    """Repaired rows by an audit, one after the other, into a digest."""

    def __init__(self, audit: str):
        self.audit, self.at, self.next, self.first = audit, 0, "u", True
        self.digest = hashlib.sha256()

    def _put(self, role: str, text: str, initial: str) -> None:
        self.digest.update((("" if self.first else "\n") + role + ":" + text).encode())
        self.first, self.next = False, "a" if initial == "u" else "u"

    def _inserts(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self._put(ROLES[self.next], "", self.next)
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self._inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self._put(role, text, role[0])
        elif edit == "R":
            self._put(ROLES[self.next], text, self.next)

    def hexdigest(self) -> str:
        self._inserts()
        return self.digest.hexdigest()


def damaged(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, turn, role, text: rows after a damage that a checksum of ``conv:turn``
    chooses, 1 in 20 for each kind: gone, without text, without full stops, repeated,
    role user. A null role or text is one space, and so is a null in the checksum's text."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space(conv_col), F.lit(":"), space(turn_col)).cast("binary")) % 20
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), space(role_col).alias("role"), space(text_col).alias("text"), kind.alias("kind")).where("kind != 0")
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    return rows.select("conv", "turn", role.alias("role"), text.alias("text"), F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def _marked(rows: DataFrame) -> DataFrame:
    """Rows with a key of their conversation, their place, and their faults but for
    repeats beside each other."""
    key = F.coalesce(F.concat(F.lit("#"), F.col("conv").cast("string")), F.lit(""))
    end = F.rtrim(F.col("text"), F.lit(SPACE))
    rows = rows.select(key.alias("key"), F.col("turn").isNotNull().alias("has"), "turn", F.xxhash64("role", "text").alias("said"), F.xxhash64(F.lit(1), "text", "role").alias("also"), "role", "text", (end == "").alias("blank"), (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    same = ["key", "said", "also"]
    again = rows.groupBy(*same).agg(F.min(F.struct("has", "turn")).alias("first"), F.count(F.lit(1)).alias("of")).where("of > 1").drop("of")
    return rows.join(again, same, "left").withColumn("repeat", F.coalesce(F.struct("has", "turn") > F.col("first"), F.lit(False))).drop("first")


class _Part:
    def __init__(self, key: str, number: int, whole: bool):
        self.key, self.number, self.whole, self.started = key, number, whole, whole
        self.symbols, self.rows, self.chars = [], [], 0
        self.blank = self.repeat = self.cut = self.illegal = self.turns = 0
        self.initials, self.span = ["", ""], [None, None]

    def row(self, turn, role: str, text: str, blank: bool, repeat: bool, cut: bool) -> None:
        initial = role[:1] if role[:1] in ("s", "u", "a") else " "
        self.symbols.append(("!" if blank or repeat else "~" if cut else "") + initial)
        self.blank += blank
        self.repeat += repeat and not blank
        self.cut += cut and not blank and not repeat
        self.illegal += bool(self.rows) and self.initials[1] + initial not in LEGAL
        self.initials = [self.initials[0] if self.rows else initial, initial]
        if turn is not None and turn != self.span[1]:
            self.turns += 1
            self.span = [turn if self.span[0] is None else self.span[0], turn]
        self.rows.append((role, text))
        self.chars += len(text)

    def ended(self, at_edge: bool) -> dict:
        """What is known of the part; ``at_edge``: what began before may go on in it."""
        charts = {i: parse(self.symbols, i) for i in (ITEMS if at_edge or not self.started else (BEGIN,))}
        cost, audit = repair(charts[BEGIN])
        out = {"key": self.key, "number": self.number, "blank": self.blank, "repeat": self.repeat, "cut": self.cut, "illegal": self.illegal, "turns": self.turns, "low": self.span[0], "high": self.span[1], "first": self.initials[0], "last": self.initials[1], "cost": cost, "audit": audit, "digest": "", "charts": json.dumps(charts)}
        if self.whole:  # else it is known not to be alone
            writer = Writer(audit)
            for role, text in self.rows:
                writer.row(role, text)
            out["digest"] = writer.hexdigest()
        return out


_PARTS = "key string, number long, blank long, repeat long, cut long, illegal long, turns long, low long, high long, first string, last string, cost long, audit string, digest string, charts string"
_KINDS = pa.schema([(c.split()[0], pa.int64() if c.endswith("long") else pa.string()) for c in _PARTS.split(", ")])


def _parts(rows_of_part: int, chars: int):
    def task(batches):
        number = TaskContext.get().partitionId() << 32
        part, edge, before = None, True, None
        out: list[dict] = []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("key", "turn", "said", "also", "role", "text", "blank", "repeat", "cut")]
            for key, turn, said, also, role, text, blank, repeat, cut in zip(*columns):
                if part is None or key != part.key:
                    if part is not None:
                        out.append(part.ended(edge))
                        edge, number = False, number + 1
                    part = _Part(key, number, True)
                elif len(part.rows) >= rows_of_part or part.chars >= chars:
                    part.whole = False
                    out.append(part.ended(edge))
                    edge, number = False, number + 1
                    part = _Part(key, number, False)
                here = (key, turn, said, also)
                part.row(turn, role, text, blank, repeat or here == before, cut)
                before = here
            if len(out) >= 2000:
                yield pa.RecordBatch.from_pylist(out, _KINDS)
                out = []
        if part is not None:
            out.append(part.ended(edge))
        if out:
            yield pa.RecordBatch.from_pylist(out, _KINDS)

    return task


def _assembled(batches):
    """Conversations of several parts, which come in order: their charts one after the
    other, their counts added up."""
    out, held = None, None
    for batch in batches:
        for p in batch.to_pylist():
            charts = {int(i): {int(k): tuple(v) for k, v in to.items()} for i, to in json.loads(p.pop("charts")).items()}
            if out is None or p["key"] != out["key"]:
                if out is not None:
                    yield _closed_row(out, held)
                out, held = p, charts[BEGIN]
                continue
            held = joined(held, charts)
            for c in ("blank", "repeat", "cut"):
                out[c] += p[c]
            out["illegal"] += p["illegal"] + (out["last"] + p["first"] not in LEGAL)
            out["turns"] += p["turns"] - (p["low"] is not None and p["low"] == out["high"])
            out["low"] = p["low"] if out["low"] is None else out["low"]
            out["high"] = out["high"] if p["high"] is None else p["high"]
            out["last"] = p["last"]
    if out is not None:
        yield _closed_row(out, held)


def _closed_row(out: dict, held: dict) -> pa.RecordBatch:
    cost, audit = repair(held)
    return pa.RecordBatch.from_pylist([out | {"cost": cost, "audit": audit, "charts": ""}], _KINDS)


def _digests(batches):
    """For conversations that come as their audit, then their rows in order."""
    key, writer = None, None
    for batch in batches:
        done = []
        for k, audit, role, text in zip(*(batch.column(c).to_pylist() for c in ("key", "audit", "role", "text"))):
            if audit is not None:
                if writer is not None:
                    done.append((key, writer.hexdigest()))
                key, writer = k, Writer(audit)
            else:
                writer.row(role, text)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*done)], names=["key", "digest"])
    if writer is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([writer.hexdigest()])], names=["key", "digest"])


def repaired(turns: DataFrame, rows: DataFrame | None = None, conv_col: str = "conv_id", *, part_rows: int = PART_ROWS, part_chars: int = PART_CHARS) -> DataFrame:
    """One row per conversation of ``turns`` (null is one too): its id, n_rows' faults and
    the cheapest repair. ``rows``: conv, turn, role, text as they are to be repaired, by
    default after ``damaged``.

    Rows are in order of turns, nulls first; rows of one turn by a hash of role and text.
    A row's first fault counts: blank (no character but white space), duplicate (role and
    text seen earlier), truncated (the last such character is none of ``.!?``). gaps are
    turns missing between the smallest and the largest. illegal counts neighbours whose
    role initials are not su, ua or au. Edits, their costs and which must be made are the
    module's; of the cheapest the ASCII-least audit is taken, which says what the repaired
    rows are: repaired_sha256 is of their ``role:text``, a line each. Roles count by their
    initial, and one with another initial than s, u and a can't be kept. A conversation
    without rows has zeros, an empty audit and the digest of nothing; an empty table gives
    no rows. Other columns are ignored. A conversation is spread over tasks in parts; only
    its digest, which can't be made otherwise, takes its rows one after the other."""
    marked = staged(_marked(damaged(turns, conv_col) if rows is None else rows), "marked")
    order = ["key", "has", "turn", "said", "also"]
    dealt = marked.repartitionByRange("key", "has", "turn", "said").sortWithinPartitions(*order)
    parts = staged(dealt.mapInArrow(_parts(part_rows, part_chars), _PARTS), "parts")
    several = staged(parts.groupBy("key").agg(F.count(F.lit(1)).alias("of")).where("of > 1").select("key"), "several")
    done = parts.join(several, "key", "left_anti")
    if not several.isEmpty():
        long = staged(parts.join(several, "key", "left_semi").repartition("key").sortWithinPartitions("key", "number").mapInArrow(_assembled, _PARTS), "long")
        none = F.lit(None).cast("string")
        lines = marked.join(several, "key", "left_semi").select(*order, none.alias("audit"), "role", "text", F.lit(1).alias("line"))
        heads = long.select("key", F.lit(None).cast("boolean"), F.lit(None).cast("long"), F.lit(None).cast("long"), F.lit(None).cast("long"), "audit", none, none, F.lit(0))
        both = lines.union(heads).repartition("key").sortWithinPartitions("key", "line", *order[1:])
        digests = both.mapInArrow(_digests, "key string, digest string")
        done = done.union(long.drop("digest").join(digests, "key").select(done.columns))
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    ids = turns.select(F.col(conv_col).alias("conv")).distinct().withColumn("key", F.coalesce(F.concat(F.lit("#"), F.col("conv").cast("string")), F.lit("")))
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).cast("long")
    nothing = hashlib.sha256(b"").hexdigest()
    return ids.join(done, "key", "left").select(F.col("conv").alias(conv_col), gaps.alias("gaps"), count("blank").alias("blank"), count("repeat").alias("duplicate"), count("cut").alias("truncated"), count("illegal").alias("illegal"), count("cost").alias("cost"), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("digest", F.lit(nothing)).alias("repaired_sha256"))
