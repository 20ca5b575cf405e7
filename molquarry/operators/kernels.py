"""Chemistry kernels as plug-ins (ENC1-4, ENC10, ENC11): any function from text to a value.

The bundled kernel needs no library: it matches literal fragments in line notations. Kernels that
need a chemistry library are imported when they are asked for and raise a clear error without it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from molquarry.operators.select import encode_distinct

KERNELS: dict[str, tuple[Callable, str]] = {}


def register(name: str, kind: str) -> Callable:
    def add(function: Callable) -> Callable:
        KERNELS[name] = (function, kind)
        return function

    return add


def _rdkit():
    try:
        from rdkit import Chem
    except ImportError as missing:
        raise ImportError("this kernel needs the rdkit library") from missing
    return Chem


@register("canonical", "string")
def canonical(value: str) -> str | None:
    """The canonical line notation, null where it can't be read."""
    chem = _rdkit()
    mol = chem.MolFromSmiles(value)
    return None if mol is None else chem.MolToSmiles(mol)


@register("morgan_2048", "array<int>")
def morgan(value: str) -> list[int] | None:
    from_chem = _rdkit()
    mol = from_chem.MolFromSmiles(value)
    if mol is None:
        return None
    from rdkit.Chem import rdFingerprintGenerator

    return [int(b) for b in rdFingerprintGenerator.GetMorganGenerator(radius=2, fpSize=2048).GetFingerprint(mol)]


@register("heavy_atoms", "int")
def heavy_atoms(value: str) -> int:
    """Atoms of a line notation other than hydrogen, by its tokens."""
    import re

    return sum(t != "[H]" for t in re.findall(r"\[[^\]]+\]|Br|Cl|[BCNOPSFIbcnops]", value))


def convert(df: DataFrame, columns: list[str], kernel: str, new_columns: list[str] | None = None) -> DataFrame:
    """Apply a kernel to columns, once for each distinct value. Without new names the columns are
    replaced; the numbers of names must agree; null stays null."""
    if new_columns and len(new_columns) != len(columns):
        raise ValueError("one new name for each column is needed")
    function, kind = KERNELS[kernel]
    names = df.columns
    for i, c in enumerate(columns):
        df = encode_distinct(df, c, function, kind, f"_made{i}")
        if new_columns:
            df, names = df.withColumnRenamed(f"_made{i}", new_columns[i]), [*names, new_columns[i]]
        else:
            df = df.drop(c).withColumnRenamed(f"_made{i}", c)
    return df.select(names)
