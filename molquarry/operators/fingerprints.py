"""Molecular fingerprints as plug-in kernels over line notations (ENC3, ENC4, ENC7).

The kinds need a chemistry library, which is imported when they are computed; widths, element kinds
and the assembly of a recipe don't. Fingerprints are computed once for each distinct value.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from molquarry.functions.values import nonzero_indices, reaction_string
from molquarry.operators.encoders import promoted
from molquarry.operators.select import encode_distinct

#: the width of the one kind whose length is fixed
KEYS_WIDTH = 167
#: rows whose bits are made at once
BATCH_ROWS = 2_000
KINDS = ("path", "circular_bits", "circular_counts", "avalon", "layered", "keys", "atom_pairs", "torsions")


@dataclass(frozen=True)
class Fingerprint:
    """One kind with its length and size parameter (largest path or radius)."""

    kind: str
    length: int = 1024
    size: int = 2
    branched: bool = True
    features: bool = False

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"no fingerprint {self.kind}")

    @property
    def width(self) -> int:
        return KEYS_WIDTH if self.kind == "keys" else self.length

    @property
    def element(self) -> str:
        return "int" if self.kind == "circular_counts" else "tinyint"


def many_fingerprints(length: int) -> list[Fingerprint]:
    """The fixed recipe of 24 fingerprints; its width is 23 * length + 167."""
    recipe = [Fingerprint("path", length, n, branched) for branched in (True, False) for n in (2, 4, 6, 8)]
    recipe += [Fingerprint("circular_bits", length, r, features=f) for f in (False, True) for r in (0, 2, 4, 6)]
    recipe += [Fingerprint("layered", length, n) for n in (2, 4, 6, 8)]
    return [*recipe, Fingerprint("avalon", length), Fingerprint("keys"), Fingerprint("atom_pairs", length), Fingerprint("torsions", length)]


def total_width(recipe: list[Fingerprint]) -> int:
    return sum(f.width for f in recipe)


def element_kind(recipe: list[Fingerprint], indices: bool = False) -> str:
    return "int" if indices else promoted([f.element for f in recipe])


def compute(mol, f: Fingerprint) -> list[int]:
    """The values of one fingerprint of a parsed molecule."""
    from rdkit.Chem import MACCSkeys, rdFingerprintGenerator, rdmolops

    made = rdFingerprintGenerator
    if f.kind == "path":
        return list(made.GetRDKitFPGenerator(maxPath=f.size, fpSize=f.length, branchedPaths=f.branched).GetFingerprint(mol))
    if f.kind in ("circular_bits", "circular_counts"):
        kinds = {"atomInvariantsGenerator": made.GetMorganFeatureAtomInvGen()} if f.features else {}
        generator = made.GetMorganGenerator(radius=f.size, fpSize=f.length, **kinds)
        return list(generator.GetFingerprint(mol) if f.kind == "circular_bits" else generator.GetCountFingerprint(mol))
    if f.kind == "avalon":
        from rdkit.Avalon import pyAvalonTools

        return list(pyAvalonTools.GetAvalonFP(mol, nBits=f.length))
    if f.kind == "layered":
        return list(rdmolops.LayeredFingerprint(mol, maxPath=f.size, fpSize=f.length))
    if f.kind == "keys":
        return list(MACCSkeys.GenMACCSKeys(mol))
    generator = made.GetAtomPairGenerator(fpSize=f.length) if f.kind == "atom_pairs" else made.GetTopologicalTorsionGenerator(fpSize=f.length)
    return list(generator.GetFingerprint(mol))


def from_text(recipe: list[Fingerprint], skip_errors: bool = False) -> Callable[[str], list[int]]:
    """A kernel from line notation to the joined values; what can't be read is a row of zeros, or
    raises unless errors are to be skipped."""

    def kernel(value: str) -> list[int]:
        try:
            from rdkit import Chem
        except ImportError as missing:
            raise ImportError("fingerprints need the rdkit library") from missing
        mol = Chem.MolFromSmiles(value)
        if mol is None:
            if not skip_errors:
                raise ValueError(f"not a molecule: {value[:80]}")
            return [0] * total_width(recipe)
        return [int(x) for f in recipe for x in compute(mol, f)]

    return kernel


def encode(df: DataFrame, column: str, recipe: list[Fingerprint], name: str, kernel: Callable[[str], list[int]] | None = None, indices: bool = False, offset: int = 0, none: int = -1, skip_errors: bool = False) -> DataFrame:
    """df with the joined fingerprints of a column; null has zeros. indices: instead the places of
    the non-zero values of each fingerprint, counted from its own start, plus offset, filled up."""
    kind = element_kind(recipe)
    coded = encode_distinct(df, column, kernel or from_text(recipe, skip_errors), f"array<{kind}>", name)
    whole = F.coalesce(F.col(name), F.array_repeat(F.lit(0).cast(kind), total_width(recipe)))
    if indices:
        start, parts = 1, []
        for f in recipe:
            parts.append(nonzero_indices(F.slice(whole, start, f.width), offset, none))
            start += f.width
        whole = F.concat(*parts).cast("array<int>")
    return coded.withColumn(name, whole)


def folded(texts: pa.Array, bits: int, gram: int) -> np.ndarray:
    """hashed_fingerprint() of a batch of texts, as a matrix of 0 and 1: every distinct n-gram of the
    batch is hashed once."""
    held = [t or "" for t in texts.to_pylist()]
    size = np.fromiter(map(len, held), np.int64, len(held))
    codes = np.frombuffer("".join(held).encode("utf-32-le"), np.uint32)
    owner = np.repeat(np.arange(len(held)), size)
    begin = np.arange(max(0, len(codes) - gram + 1))
    begin = begin[owner[begin] == owner[begin + gram - 1]] if len(begin) else begin
    alphabet, letter = np.unique(codes, return_inverse=True)
    name = np.zeros(len(begin), np.int64)
    for k in range(gram):  # numbered anew each time, so that long grams don't overflow
        name = np.unique(name * len(alphabet) + letter[begin + k], return_inverse=True)[1]
    first = np.unique(name, return_index=True)[1]
    words = [codes[b : b + gram].astype("<u4").tobytes().decode("utf-32-le") for b in begin[first].tolist()]
    bit = np.array([int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % bits for w in words], np.int64)
    out = np.zeros((len(held), bits), np.uint8)
    out[owner[begin], bit[name]] = 1
    return out


def reaction(df: DataFrame, name: str, reactants: list[str], reagents: list[str], products: list[str], bits: int = 2048, gram: int = 3, drop: list[str] | None = None, as_text: bool = False) -> DataFrame:
    """df with hashed bits of the reaction string in place of its columns, as integers or as one text
    of 0 and 1. The substructure hashing of chemistry libraries is another fingerprint and isn't
    claimed here."""
    kept = df.drop(*(drop if drop is not None else [*reactants, *reagents, *products]), name)
    joined = df.select(*(F.col(c) for c in kept.columns), reaction_string(reactants, reagents, products).alias("_r"))
    fields = [*kept.schema.fields, StructField(name, StringType() if as_text else ArrayType(IntegerType()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(at, BATCH_ROWS)
                found = folded(batch.column(batch.num_columns - 1), bits, gram)
                offsets = pa.array(np.arange(len(found) + 1) * bits, pa.int32())
                if as_text:
                    made = pa.StringArray.from_buffers(len(found), offsets.buffers()[1], pa.py_buffer((found + ord("0")).tobytes()))
                else:
                    made = pa.ListArray.from_arrays(offsets, pa.array(found.ravel(), pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], made], [f.name for f in fields])

    return joined.mapInArrow(run, StructType(fields))
