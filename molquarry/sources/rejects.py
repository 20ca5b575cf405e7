"""Delimited lines that fail to parse, separated with the reason, while the valid ones load (p1).

Record blocks are parsed at once by a columnar CSV reader and checked in columnar form, which gives a
verdict for each line. A block that holds a failing line is halved until the failing lines stand alone;
they are read by the strict parser, which says what is wrong, and all others load from the columns. Should the
reader refuse a block of lines that look sound, it is given the halves of it.

Rules: a trailing carriage return is no part of the line; a field whose very first character is a
quote runs to its closing quote, which a comma or the line's end must follow, with "" for one quote
inside; any other field holds no quote (else `quoting`); exactly five fields (else `columns`); the
first four, without blanks at their ends, are valid compounds (else `value`), the second may be
missing. Defined results: a null line has no fields (`columns`); an empty line has one (`columns`);
line breaks within a line are ordinary characters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pacsv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molquarry.functions.values import MISSING

FIELDS = ("ligand", "additive", "base", "aryl_halide", "output")
OPTIONAL = (1,)
CHECKED = 4
BLOCK_LINES = 4096

_BRACKET = r"\[[0-9]*(?:[A-Z][a-z]?|[bcnops])@{0,2}(?:H[0-9]?)?(?:[+-][0-9]?)?\]"
_PART = re.compile(rf"{_BRACKET}|Cl|Br|[BCNOPSFIbcnops]|[-=#:/\\.]|[()]|%[0-9][0-9]|[0-9]")
_QUOTED = r'"(?:[^"]|"")*"'
_PLAIN = r'[^",]*'
#: a line without a quoting breach, for the columnar check (RE2); (?s) lets . and sets meet any character
WELL_QUOTED = rf"(?s)\A(?:{_QUOTED}|{_PLAIN})(?:,(?:{_QUOTED}|{_PLAIN}))*\z"
_memo: dict[str, bool] = {}
_MEMO_ROOM = 500_000


def valid_compound(value: str) -> bool:
    """Whether a value is a well-formed line notation of a compound."""
    known = _memo.get(value)
    if known is None:
        if len(_memo) > _MEMO_ROOM:
            _memo.clear()
        known = _memo[value] = _valid_compound(value)
    return known


def _valid_compound(value: str) -> bool:
    if not value:
        return False
    at, depth, odd, before = 0, 0, set(), ""
    while at < len(value):
        found = _PART.match(value, at)
        if not found:
            return False
        part, at = found.group(), found.end()
        if part == "(":
            depth += 1
        elif part == ")":
            depth -= 1
            if depth < 0 or before == "(":
                return False
        elif part[0] == "%" or part[0].isdigit():
            odd ^= {part}
        before = part
    return depth == 0 and not odd


def strict_fields(line: str) -> list[str] | None:
    """The fields of one line, or None where its quoting is broken."""
    fields, at = [], 0
    while True:
        if line.startswith('"', at):
            end = at + 1
            while True:
                end = line.find('"', end)
                if end < 0:
                    return None
                if not line.startswith('"', end + 1):
                    break
                end += 2
            fields.append(line[at + 1 : end].replace('""', '"'))
            at = end + 1
            if at < len(line) and line[at] != ",":
                return None
        else:
            end = line.find(",", at)
            end = len(line) if end < 0 else end
            if '"' in line[at:end]:
                return None
            fields.append(line[at:end])
            at = end
        if at >= len(line):
            return fields
        at += 1


def _fits(i: int, value: str) -> bool:
    return (value in MISSING and i in OPTIONAL) or (value not in MISSING and valid_compound(value))


def diagnose(line: str | None, width: int = len(FIELDS)) -> tuple[str | None, list[str]]:
    """(reason or None, fields) of one line, its values without blanks at their ends."""
    if line is None:
        return "columns", []
    fields = strict_fields(line.removesuffix("\r"))
    if fields is None:
        return "quoting", []
    if len(fields) != width:
        return "columns", fields
    fields = [*(f.strip(" \t") for f in fields[:CHECKED]), *fields[CHECKED:]]
    if not all(_fits(i, f) for i, f in enumerate(fields[:CHECKED])):
        return "value", fields
    return None, fields


def _columns(lines: pa.Array, width: int) -> tuple[np.ndarray, list[pa.Array]]:
    """(which lines the reader takes, their columns) of lines that look sound."""
    names = [f"c{i}" for i in range(width)]
    empty = [pa.array([], pa.string())] * width
    if not len(lines):
        return np.zeros(0, bool), empty
    text = pa.py_buffer(("\n".join(lines.to_pylist()) + "\n").encode())
    try:
        table = pacsv.read_csv(
            pa.BufferReader(text),
            read_options=pacsv.ReadOptions(column_names=names, use_threads=False, block_size=max(1 << 20, text.size + 1)),
            parse_options=pacsv.ParseOptions(quote_char='"', double_quote=True, ignore_empty_lines=False),
            convert_options=pacsv.ConvertOptions(column_types={n: pa.string() for n in names}, strings_can_be_null=False),
        )
        if table.num_rows == len(lines):
            return np.ones(len(lines), bool), [c.combine_chunks() for c in table.columns]
    except pa.ArrowInvalid:
        pass
    if len(lines) == 1:
        return np.zeros(1, bool), empty
    half = len(lines) // 2
    (a, left), (b, right) = _columns(lines.slice(0, half), width), _columns(lines.slice(half), width)
    return np.concatenate([a, b]), [pa.concat_arrays([x, y]) for x, y in zip(left, right)]


def _bulk(lines: pa.Array, width: int) -> tuple[np.ndarray, list[pa.Array]]:
    """(which lines of a block are sound, the columns of those)."""
    lines = pc.if_else(pc.ends_with(lines, "\r"), pc.utf8_slice_codeunits(lines, 0, -1), lines)
    commas = pc.count_substring(pc.replace_substring_regex(lines, _QUOTED, ""), ",")
    # the reader takes line breaks and empty lines for something else
    plain = pc.and_(pc.invert(pc.match_substring_regex(lines, "[\n\r]")), pc.not_equal(lines, ""))
    looks = pc.and_(pc.and_(pc.match_substring_regex(lines, WELL_QUOTED), pc.equal(commas, width - 1)), plain)
    sound = pc.fill_null(looks, False).to_numpy(zero_copy_only=False).copy()
    taken, columns = _columns(lines.filter(pa.array(sound)), width)
    sound[np.flatnonzero(sound)[~taken]] = False
    good = np.ones(int(taken.sum()), bool)
    for i in range(CHECKED):
        columns[i] = pc.utf8_trim(columns[i], " \t")
        coded = columns[i].dictionary_encode()
        fits = np.array([_fits(i, value) for value in coded.dictionary.to_pylist()], bool)
        good &= fits[coded.indices.to_numpy(zero_copy_only=False)]
    sound[np.flatnonzero(sound)[~good]] = False
    return sound, [c.filter(pa.array(good)) for c in columns]


def parse_block(lines: pa.Array, width: int = len(FIELDS)) -> Iterator[tuple[int, int, list | None, tuple | None]]:
    """Sound runs and diagnosed lines of a block, in order: (start, length, columns, None) or
    (start, 1, None, (reason, fields))."""
    sound, columns = _bulk(lines, width)
    place = np.concatenate([[0], np.cumsum(sound)])
    waiting = [(0, len(lines))]
    while waiting:
        start, size = waiting.pop()
        good = int(place[start + size] - place[start])
        if good == size:
            if size:
                yield start, size, [c.slice(int(place[start]), size) for c in columns], None
        elif size == 1:
            yield start, 1, None, diagnose(lines[start].as_py(), width)
        else:
            half = size // 2
            waiting += [(start + half, size - half), (start, half)]


def load_lines(df: DataFrame, key: str = "line_id", line: str = "raw_line", block: int = BLOCK_LINES) -> DataFrame:
    """One row for each row of df: key, the five fields (null in rejected lines; a missing value is
    null) and reason (null in loaded lines). One pass, no shuffle; header lines must be left out."""
    width = len(FIELDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, block):
                part = batch.slice(low, block)
                at, columns, told = [], [[] for _ in FIELDS], []
                for start, size, good, found in parse_block(part.column(1), width):
                    if good is None:
                        told.append((start, *found))
                        continue
                    at.append(np.arange(start, start + size))
                    for held, column in zip(columns, good):
                        held.append(column)
                rejected = [[None if reason else fields[i] for _, reason, fields in told] for i in range(width)]
                order = pa.array(np.concatenate([*at, np.array([t[0] for t in told], np.int64)]).astype(np.int64))
                whole = [pa.concat_arrays([*held, pa.array(extra, pa.string())]) for held, extra in zip(columns, rejected)]
                reasons = pa.array([None] * sum(map(len, at)) + [t[1] for t in told], pa.string())
                for i in range(CHECKED):
                    missing = pc.is_in(whole[i], pa.array(MISSING))
                    whole[i] = pc.if_else(missing, pa.scalar(None, pa.string()), whole[i])
                yield pa.RecordBatch.from_arrays([part.column(0).take(order), *whole, reasons], ["key", *FIELDS, "reason"])

    kind = df.schema[key].dataType.simpleString()
    out = df.select(F.col(key).alias("key"), F.col(line).alias("line")).mapInArrow(run, f"key {kind}, " + ", ".join(f"{f} string" for f in FIELDS) + ", reason string")
    return out.withColumnRenamed("key", key)


def number(column) -> F.Column:
    """The double of an output field that may hold a decimal comma; null where it is no number."""
    text = F.regexp_replace(F.trim(column), ",", ".")
    return F.when(text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), text.cast("double"))
