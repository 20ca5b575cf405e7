"""Lines that fail to parse (p1)."""

import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from molquarry.sources import rejects

GOOD = ["C,C,C,C,1", '"C","C(C)",C,"C1CC1",x', '"C",,C,C,"a""b"', "C,NA,C,C,", "C , nan,\tC,[13CH3-],1,".removesuffix(","), "C,C,C,C,\r"]


def plain(line):
    """A character machine for one line: the reason, or None."""
    if line is None:
        return "columns"
    line = line[:-1] if line.endswith("\r") else line
    fields, i = [], 0
    while True:
        if i < len(line) and line[i] == '"':
            i, out = i + 1, ""
            while True:
                if i >= len(line):
                    return "quoting"
                if line[i] == '"':
                    if line[i + 1 : i + 2] == '"':
                        out, i = out + '"', i + 2
                        continue
                    i += 1
                    break
                out, i = out + line[i], i + 1
            if i < len(line) and line[i] != ",":
                return "quoting"
        else:
            j = i
            while j < len(line) and line[j] != ",":
                if line[j] == '"':
                    return "quoting"
                j += 1
            out, i = line[i:j], j
        fields.append(out)
        if i >= len(line):
            break
        i += 1
    if len(fields) != 5:
        return "columns"
    for k, value in enumerate(f.strip(" \t") for f in fields[:4]):
        if value in ("", "NA", "nan", "ValueNotFound"):
            if k != 1:
                return "value"
        elif not rejects.valid_compound(value):
            return "value"
    return None


def reasons(lines):
    out = {}
    for start, size, columns, told in rejects.parse_block(pa.array(lines, pa.string())):
        for i in range(size):
            out[start + i] = None if columns is not None else told[0]
    return [out[i] for i in range(len(lines))]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(GOOD), st.none(), st.text(alphabet='",C()1%[]NA \t\r\n=', max_size=20)), max_size=120))
def test_blocks_equal_the_strict_machine(lines):
    assert reasons(lines) == [plain(x) for x in lines]


@pytest.mark.parametrize(
    "value, good",
    [("C", True), ("c1ccccc1", True), ("C1CC", False), ("C%12CC%12", True), ("C%1C%1", False), ("()", False), ("C()C", False), ("C(C", False), ("C)C(", False), ("[nH]1cccc1", True), ("[Na+]", True), ("[C@@H](F)C", True), ("[C@@@H]", False), ("[13CH4+2]", True), ("Xy", False), ("", False), ("CCl.Br/C=C\\C#N:1:1", True), ("C C", False), ("[]", False), ("C[", False), ("C1(C)CC1", True)],
)
def test_compounds(value, good):
    assert rejects._valid_compound(value) is good


def test_table(spark):
    r = random.Random(1)
    lines = [r.choice(GOOD) if r.random() < 0.9 else r.choice(['C,C,C', 'a"b,C,C,C,1', ",C,C,C,1", None, "", '"C', "C" * 100_000 + ",C,C,C,1", "C,C,C,C,a\rb"]) for _ in range(3000)]
    df = spark.createDataFrame([(i, x, "clash") for i, x in enumerate(lines)], "line_id bigint, raw_line string, reason string")
    got = {x["line_id"]: x for x in rejects.load_lines(df, block=512).collect()}
    assert len(got) == len(lines)
    for i, line in enumerate(lines):
        assert got[i]["reason"] == plain(line)
        if plain(line):
            assert all(got[i][f] is None for f in rejects.FIELDS)
    first = next(i for i, x in enumerate(lines) if x == GOOD[2])
    assert got[first]["additive"] is None and got[first]["output"] == 'a"b' and got[first]["ligand"] == "C"
    assert rejects.load_lines(df.limit(0)).count() == 0


def test_numbers(spark):
    df = spark.createDataFrame([("1.5",), ("43,41",), (" 7 ",), ("",), ("NA",), (None,), ("1e3",), ("1,2,3",)], "x string")
    assert [r[0] for r in df.select(rejects.number(df.x)).collect()] == [1.5, 43.41, 7.0, None, None, None, 1000.0, None]
