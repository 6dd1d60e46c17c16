"""Repair of conversation structure: the cheapest edits after which the roles follow one another as they should.

The roles of a sound conversation read ``(s?(ua)+)?`` by their initials. Its automaton has four
states; the repair grammar has one nonterminal (p, q) for each pair of them, which derives the spans of
rows that lead from p to q. In Chomsky normal form its rules are (p, q) -> (p, r) (r, q), and (p, q)
-> one row under an edit (keep 0, rerole 1, delete 2; 5 more if the row is truncated and stays). The
cell of a span holds, for each nonterminal, its least (cost, audit): the audit is the string of the
edits' initials. Insertions (5 each) consume no row: the closure of the empty span, put on both sides
of a row, lets them stand anywhere. From p, an audit names one path only, and among audits of equal
cost none is a prefix of another, so least cells of parts make least cells of wholes, and a span may be
cut anywhere. Cells are combined bottom-up by span length. A span is known by the letters of its
rows (role initial and fault), so equal spans share one cell.

Conversations of up to ``GROUP_ROWS`` rows are parsed in one pass over rows dealt and sorted by
conversation. Longer ones never meet in one task as a whole: their rows are dealt by ranges of
the order, cut in spans of ``SPAN_ROWS`` rows, and cells combined in rounds of ``FAN_IN`` (associative,
hence the same result); repaired texts join the edits by row.

Defined results: NULLs in any column of a conversation count as one space where text is needed; a
NULL conv_id is a conversation of its own; NULL turns come first and are ignored in gaps; rows of
equal turn are taken by role, then text; equal rows are faults (duplicates) but for the first; an
empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardframe.functions.ranks import positions
from wardframe.session import cut_lineage

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
TRUNCATED_COST = 5
COSTS = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
#: State and role initial to state; a conversation may end in the states of ``ENDS``.
MOVES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
STATES = range(4)
ENDS = (0, 3)
NAMES = {"u": "user", "a": "assistant"}
#: Adjacent role initials that are no fault.
LEGAL = ("su", "ua", "au")
#: Letter of a row that must go; others are s, u, a and ``OTHER``, in upper case when truncated.
GONE, OTHER = "d", "o"
#: Rows of a conversation parsed at once; of a span of a longer one; spans combined in a task.
GROUP_ROWS, SPAN_ROWS, FAN_IN = 1024, 16, 64
#: Cells kept in a worker; then it starts over.
CELLS = 100_000

Cell = dict  # (p, q) -> (cost, audit)


def _join(left: Cell, right: Cell, out: Cell | None = None) -> Cell:
    """Binary rules over two neighbouring spans; better finds go into ``out``."""
    out = {} if out is None else out
    for (p, r), (cost, audit) in left.items():
        for q in STATES:
            more = right.get((r, q))
            if more is not None:
                found = (cost + more[0], audit + more[1])
                if (p, q) not in out or found < out[p, q]:
                    out[p, q] = found
    return out


def _least(rules: list) -> Cell:
    out: Cell = {}
    for p, q, cost, audit in rules:
        if (p, q) not in out or (cost, audit) < out[p, q]:
            out[p, q] = (cost, audit)
    return out


def _closure() -> Cell:
    """Insertions alone: the cell of the empty span."""
    one = _least([(p, p, 0, "") for p in STATES] + [
        (p, q, COSTS[INSERT], INSERT) for (p, initial), q in MOVES.items() if initial in NAMES
    ])
    cell = one
    while (more := _join(cell, one)) != cell:
        cell = more
    return cell


EMPTY = _closure()


def row_cell(letter: str) -> Cell:
    """Unary rules: the edits of one row, insertions before and after it."""
    rules = [(p, p, COSTS[DELETE], DELETE) for p in STATES]
    if letter != GONE:
        extra = TRUNCATED_COST if letter.isupper() else 0
        for (p, initial), q in MOVES.items():
            if initial == letter.lower():
                rules.append((p, q, COSTS[KEEP] + extra, KEEP))
            if initial in NAMES:
                rules.append((p, q, COSTS[REROLE] + extra, REROLE))
    return _join(_join(EMPTY, _least(rules)), EMPTY)


class Parser:
    """Cells of spans given by their rows' letters, kept by letters."""

    def __init__(self) -> None:
        self.cells: dict[str, Cell] = {"": EMPTY}

    def cell(self, letters: str) -> Cell:
        """The chart of all spans of up to ``SPAN_ROWS`` rows, shortest first and over all cuts; longer ones halve."""
        known = self.cells.get(letters)
        if known is not None:
            return known
        if len(letters) > SPAN_ROWS:
            half = len(letters) // 2
            return _join(self.cell(letters[:half]), self.cell(letters[half:]))
        if len(self.cells) > CELLS:
            self.cells = {"": EMPTY}
        chart = self.cells
        for length in range(1, len(letters) + 1):
            for start in range(len(letters) - length + 1):
                span = letters[start:start + length]
                if span not in chart:
                    cell = row_cell(span) if length == 1 else {}
                    for cut in range(1, length):
                        _join(chart[span[:cut]], chart[span[cut:]], cell)
                    chart[span] = cell
        return chart[letters]


def best(cell: Cell) -> tuple[int, str]:
    return min(cell[0, q] for q in ENDS if (0, q) in cell)


def steps(audit: str, letters: str) -> Iterator[tuple[str, str | None]]:
    """(edit, initial of the resulting row or None) along an audit of rows with these letters."""
    state = 0
    rows = iter(letters)
    for edit in audit:
        own = next(rows).lower() if edit != INSERT else None
        if edit == DELETE:
            yield edit, None
            continue
        made = own if edit == KEEP else next(i for i in ("u", "a") if (state, i) in MOVES)
        state = MOVES[state, made]
        yield edit, made


def damage(conversations: DataFrame) -> DataFrame:
    """Drops, empties, truncates, repeats and reroles rows by a hash of conversation and turn."""
    conv, turn = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))
    kind = F.crc32(F.concat_ws(":", conv, turn)) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    marked = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind")).where("kind <> 0")
    changed = marked.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("kind") == 3, 2).otherwise(1).alias("times"),
    )
    return changed.select("conv_id", "turn", "role", "text", F.explode(F.sequence(F.lit(1), "times")).alias("time")).drop("time")


def _faults(rows: DataFrame) -> DataFrame:
    """Adds ``blank`` and ``cut``, what can be told of a row alone."""
    last = F.substring(F.rtrim(F.translate("text", "\t\n\u000b\f\r", "     ")), -1, 1)
    return rows.withColumns({"blank": last == "", "cut": ~last.isin(".", "!", "?")})


class Report(NamedTuple):
    """What is known of consecutive rows of a conversation; ``+`` joins two neighbouring stretches."""

    blank: int
    duplicate: int
    truncated: int
    illegal: int
    first: str
    last: str
    letters: str
    cell: Cell

    def __add__(self, other: Report) -> Report:  # type: ignore[override]
        return Report(
            self.blank + other.blank, self.duplicate + other.duplicate, self.truncated + other.truncated,
            self.illegal + other.illegal + (self.last + other.first not in LEGAL), self.first, other.last,
            self.letters + other.letters, _join(self.cell, other.cell),
        )


def report(parser: Parser, initials: list[str], blanks: list[bool], doubles: list[bool], cuts: list[bool]) -> Report:
    """The report of rows in order: role initials, and which are blank, said before, or without an end."""
    letters = "".join(
        GONE if blank or double else (x.upper() if cut else x)
        for x, blank, double, cut in zip((i if i in ("s", "u", "a") else OTHER for i in initials), blanks, doubles, cuts, strict=True)
    )
    return Report(
        sum(blanks), sum(d and not b for b, d in zip(blanks, doubles, strict=True)), sum(x.isupper() for x in letters),
        sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])), initials[0], initials[-1], letters, parser.cell(letters),
    )


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_REPORT = "conv_key string, " + ", ".join(f"{c} long" for c in _COUNTS) + ", audit string"


def _parse_short(parser: Parser, key: str, rows: list[tuple]) -> tuple:
    """One conversation's rows (turn, role, text, blank, cut), in order, to its report and repaired rows."""
    seen: set = set()
    doubles = []
    for _, role, text, _, _ in rows:
        doubles.append((role, text) in seen)
        seen.add((role, text))
    told = report(parser, [r[1][:1] for r in rows], [r[3] for r in rows], doubles, [r[4] for r in rows])
    cost, audit = best(told.cell)
    turns = {r[0] for r in rows if r[0] is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    left = iter(rows)
    repaired = []
    for edit, made in steps(audit, told.letters):
        row = next(left) if edit != INSERT else None
        if edit != DELETE:
            repaired.append({"edit": edit, "role": row[1] if edit == KEEP else NAMES[made], "text": row[2] if row else ""})
    return (key, gaps, told.blank, told.duplicate, told.truncated, told.illegal, cost, audit, repaired)


def _short_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Consecutive rows of one conversation, over the borders of batches, parsed together."""
    parser = Parser()
    names = ["conv_key", *_COUNTS, "audit", "repaired"]
    held: list[tuple] = []
    at = None
    for batch in batches:
        done = []
        columns = [batch[c].tolist() for c in ("conv_key", "turn_text", "role", "text", "blank", "cut")]
        for key, turn, role, text, blank, cut in zip(*columns, strict=True):
            if held and key != at:
                done.append(_parse_short(parser, at, held))
                held = []
            at = key
            held.append((int(turn) if turn else None, role, text, blank, cut))
        yield pd.DataFrame(done, columns=names)
    if held:
        yield pd.DataFrame([_parse_short(parser, at, held)], columns=names)


def _keyed(rows: DataFrame) -> DataFrame:
    """conv_id and turn as texts, empty for NULL, so that neither loses digits on its way through pandas."""
    return rows.withColumns({
        "conv_key": F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")),
        "turn_text": F.coalesce(F.col("turn").cast("long").cast("string"), F.lit("")),
    })


def _id_back(rows: DataFrame, conv_type) -> DataFrame:
    conv = F.when(F.col("conv_key") != "", F.expr("substring(conv_key, 2)")).cast(conv_type)
    return rows.select(conv.alias("conv_id"), *[c for c in rows.columns if c != "conv_key"])


def repair_short(rows: DataFrame) -> DataFrame:
    """Report and ``repaired`` (edit, role, text) of each conversation; one conversation is in memory at a time."""
    dealt = _keyed(_faults(rows)).repartition("conv_key").sortWithinPartitions("conv_key", "turn", "role", "text")
    parsed = dealt.select("conv_key", "turn_text", "role", "text", "blank", "cut").mapInPandas(
        _short_batches, f"{_REPORT}, repaired array<struct<edit string, role string, text string>>"
    )
    return _id_back(parsed, rows.schema["conv_id"].dataType)


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows with ``double`` (role and text were seen earlier) and ``place``, their number in the conversation."""
    known = cut_lineage(_keyed(_faults(rows)).withColumn("uid", F.monotonically_increasing_id()))
    said = known.select("conv_key", "role", F.sha2("text", 256).alias("said"), F.struct("turn", "uid").alias("when"))
    first = said.groupBy("conv_key", "role", "said").agg(F.min("when").alias("first"), F.count(F.lit(1)).alias("n"))
    marked = known.withColumn("said", F.sha2("text", 256)).join(
        first.where("n > 1").select("conv_key", "role", "said", F.col("first.uid").alias("first")), ["conv_key", "role", "said"], "left"
    )
    order = ["conv_key", "turn", "role", "text", "uid"]
    lines = marked.withColumn("double", F.coalesce(F.col("uid") != F.col("first"), F.lit(False))).drop("said", "first")
    lines = cut_lineage(lines.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))
    numbered = positions(lines, ["part"])
    start = numbered.groupBy("conv_key").agg(F.min("position").alias("start"))
    return cut_lineage(numbered.join(start, "conv_key").withColumn("place", F.col("position") - F.col("start")).drop("part", "position", "start", "uid"))


def _span_reports(spans: pd.Series) -> pd.Series:
    parser = Parser()
    out = []
    for span in spans:
        columns = ([r[c] for r in span] for c in ("initial", "blank", "double", "cut"))
        out.append(pickle.dumps(report(parser, *columns)))
    return pd.Series(out, dtype=object)


def _joined_reports(groups: pd.Series) -> pd.Series:
    out = []
    for group in groups:
        told = [pickle.loads(r["told"]) for r in group]
        while len(told) > 1:
            told = [told[i] + told[i + 1] if i + 1 < len(told) else told[i] for i in range(0, len(told), 2)]
        out.append(pickle.dumps(told[0]))
    return pd.Series(out, dtype=object)


_TOLD = "blank long, duplicate long, truncated long, illegal long, cost long, audit string, letters string"


def _told(reports: pd.Series) -> pd.DataFrame:
    read = [pickle.loads(r) for r in reports]
    ends = [best(r.cell) for r in read]
    return pd.DataFrame({
        "blank": [r.blank for r in read], "duplicate": [r.duplicate for r in read], "truncated": [r.truncated for r in read],
        "illegal": [r.illegal for r in read], "cost": [c for c, _ in ends], "audit": [a for _, a in ends], "letters": [r.letters for r in read],
    })


def _edits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per edit that leaves a row: number in the result, number of the row used, edit, new role."""
    names = ["conv_key", "line", "place", "edit", "new_role"]
    for batch in batches:
        out: list[tuple] = []
        for key, audit, letters in zip(batch["conv_key"], batch["audit"], batch["letters"], strict=True):
            line = place = 0
            for edit, made in steps(audit, letters):
                if edit != DELETE:
                    out.append((key, line, -1 if edit == INSERT else place, edit, "" if edit == KEEP else NAMES[made]))
                    line += 1
                place += edit != INSERT
                if len(out) == 50_000:
                    yield pd.DataFrame(out, columns=names)
                    out = []
        yield pd.DataFrame(out, columns=names)


def repair_long(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reports, and repaired rows (conv_id, line, edit, role, text), of conversations too long for one task."""
    span_reports, joined_reports = F.pandas_udf(_span_reports, "binary"), F.pandas_udf(_joined_reports, "binary")
    lines = _ordered(rows)
    row = F.struct("place", F.substring("role", 1, 1).alias("initial"), "blank", "double", "cut")
    spans = lines.groupBy("conv_key", F.expr(f"place div {SPAN_ROWS}").alias("span")).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    now = cut_lineage(spans.select("conv_key", "span", span_reports("rows").alias("told")))
    while not now.where("span > 0").isEmpty():
        wide = now.groupBy("conv_key", F.expr(f"span div {FAN_IN}").alias("span")).agg(F.sort_array(F.collect_list(F.struct("span", "told"))).alias("group"))
        now = cut_lineage(wide.select("conv_key", "span", joined_reports("group").alias("told")))
    told = now.select("conv_key", F.pandas_udf(_told, _TOLD)("told").alias("t")).select("conv_key", "t.*")
    turns = lines.where("turn IS NOT NULL").groupBy("conv_key", "turn").agg(F.lit(1).alias("one"))
    gaps = turns.groupBy("conv_key").agg((F.max("turn") - F.min("turn") + 1 - F.count("one")).alias("gaps"))
    told = cut_lineage(told.join(gaps, "conv_key", "left").withColumn("gaps", F.coalesce("gaps", F.lit(0)).cast("long")))
    edits = cut_lineage(
        told.select("conv_key", "audit", "letters").mapInPandas(_edits, "conv_key string, line long, place long, edit string, new_role string")
    )
    used = edits.where("place >= 0").join(lines.select("conv_key", "place", "role", "text"), ["conv_key", "place"])
    used = used.select("conv_key", "line", "edit", F.when(F.col("edit") == KEEP, F.col("role")).otherwise(F.col("new_role")).alias("role"), "text")
    new = edits.where("place < 0").select("conv_key", "line", "edit", F.col("new_role").alias("role"), F.lit("").alias("text"))
    conv = rows.schema["conv_id"].dataType
    return _id_back(told.select("conv_key", *_COUNTS, "audit"), conv), _id_back(used.union(new), conv)


def _running_digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 over consecutive rows of one conversation; only the running digest is held."""
    names = ["conv_key", "repaired_sha256"]
    at, digest = None, hashlib.sha256()
    for batch in batches:
        done = []
        for key, line in zip(batch["conv_key"], batch["line"], strict=True):
            if key != at:
                if at is not None:
                    done.append((at, digest.hexdigest()))
                at, digest = key, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(line.encode())
        yield pd.DataFrame(done, columns=names)
    if at is not None:
        yield pd.DataFrame([(at, digest.hexdigest())], columns=names)


def _row_digests(rows: DataFrame) -> DataFrame:
    keyed = rows.withColumn("conv_key", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")))
    dealt = keyed.repartition("conv_key").sortWithinPartitions("conv_key", "line").select("conv_key", F.concat_ws(":", "role", "text").alias("line"))
    return _id_back(dealt.mapInPandas(_running_digests, "conv_key string, repaired_sha256 string"), rows.schema["conv_id"].dataType)


def split_by_length(rows: DataFrame, group_rows: int = GROUP_ROWS) -> tuple[DataFrame, DataFrame | None]:
    """Rows of conversations of up to ``group_rows`` rows, and the others (None if there are none)."""
    counts = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    long = cut_lineage(counts.where(F.col("n") > group_rows).select(F.col("conv_id").alias("long_id")))
    if long.isEmpty():
        return rows, None
    same = rows["conv_id"].eqNullSafe(long["long_id"])
    return rows.join(long, same, "left_anti"), rows.join(long, same, "left_semi")


def repair(rows: DataFrame, group_rows: int = GROUP_ROWS) -> tuple[DataFrame, DataFrame]:
    """Reports (conv_id, counts, cost, audit) and repaired rows (conv_id, line, edit, role, text) of all conversations."""
    few, many = split_by_length(rows, group_rows)
    short = cut_lineage(repair_short(few))
    reports = short.drop("repaired")
    made = short.select("conv_id", F.posexplode("repaired").alias("line", "r")).select("conv_id", F.col("line").cast("long").alias("line"), "r.*")
    if many is None:
        return reports, made
    told, lines = repair_long(many)
    return reports.union(told), made.union(lines)


def repair_digests(rows: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Reports with ``repaired_sha256`` of the repaired ``role:text`` lines."""
    few, many = split_by_length(rows, group_rows)
    short = repair_short(few)
    joined = F.array_join(F.transform("repaired", lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n")
    out = short.select("conv_id", *_COUNTS, "audit", F.sha2(joined, 256).alias("repaired_sha256"))
    if many is None:
        return out
    told, lines = repair_long(many)
    digests = _row_digests(lines).withColumnRenamed("conv_id", "d_id")
    long = told.join(digests, told["conv_id"].eqNullSafe(digests["d_id"]), "left").drop("d_id")
    return out.union(long.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256))))


def with_empty(conversations: DataFrame, reports: DataFrame) -> DataFrame:
    """A report for every conv_id of ``conversations``: zeros where no row is left."""
    every = conversations.select(F.col("conv_id").alias("every_id")).distinct()
    joined = every.join(reports, every["every_id"].eqNullSafe(reports["conv_id"]), "left")
    nothing = {**dict.fromkeys(_COUNTS, F.lit(0).cast("long")), "audit": F.lit(""), "repaired_sha256": F.sha2(F.lit(""), 256)}
    return joined.select(F.col("every_id").alias("conv_id"), *[F.coalesce(c, other).alias(c) for c, other in nothing.items()])
