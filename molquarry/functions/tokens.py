"""Regex tokens of line notations with a fixed vocabulary, as Spark expressions (ENC8, ENC9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the published pattern and vocabulary of reaction tokenizers; a token's id is its place
PATTERN = r"(\[[^\]]+]|Br?|Cl?|N|O|S|P|F|I|b|c|n|o|s|p|\(|\)|\.|=|#|-|\+|\\|\/|:|~|@|\?|>>?|\*|\$|\%[0-9]{2}|[0-9])"
VOCABULARY = (
    "[PAD] [unused0] [UNK] [CLS] [SEP] [MASK] c C O 1 2 = N S ( ) Br B n 3 [N+](=O)[O-] - [O-] [nH] [N+] Cl s F # o P I 4 "
    "[H] [Si] [n+] [NH+] [N-] 5 [B-] 6 [SiH] [o+] [c-] 7 8 [O] [C-] [S+] [n-] [S-] [PH] [CH-] [SiH3] [C+] [SiH2] [NH2+] [SH] "
    "p [C] [I+] [BH3-] [s+] 9 [O+] [nH+] [cH-] [IH] [Cl+3] [P+] [CH] [N] [BH-] [PH+] [Si-] [NH-] [SH-] [S] [siH] [NH3+] [BH2-] "
    "[CH+] [pH] [OH+] [c+] [I-] [P-] [Si+] [PH2] [SH+] [Cl+] [CH2] [IH+] [SiH4] . [Cl-] [Br-] %10 %11 [cH+] [F-] %12 %13 [P] [BH4-]"
).split(" ")
PAD, UNKNOWN, START, END = 0, 2, 3, 4


def regex_tokens(text: Column, pattern: str = PATTERN) -> Column:
    """The matches of the pattern in order; text between them is dropped."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def token_ids(tokens: Column, length: int, vocabulary: list[str] | None = None) -> Column:
    """START, the first length - 2 ids (UNKNOWN for tokens outside the vocabulary), END, then PAD.
    A null text has only PAD."""
    words = list(vocabulary or VOCABULARY)
    table = F.create_map(*(v for i, w in enumerate(words) for v in (F.lit(w), F.lit(i))))
    ids = F.transform(F.slice(tokens, 1, length - 2), lambda t: F.coalesce(F.try_element_at(table, t), F.lit(UNKNOWN)))
    framed = F.concat(F.array(F.lit(START)), F.coalesce(ids, F.array().cast("array<int>")), F.array(F.lit(END)))
    whole = F.when(tokens.isNull(), F.array().cast("array<int>")).otherwise(framed)
    return F.slice(F.concat(whole, F.array_repeat(F.lit(PAD), length)), 1, length)


def decoded(ids: Column, vocabulary: list[str] | None = None) -> Column:
    """The words of the ids, special ones included, joined by one space."""
    words = F.array(*(F.lit(w) for w in (vocabulary or VOCABULARY)))
    return F.array_join(F.transform(ids, lambda i: F.get(words, i)), " ")


def tokenize(df: DataFrame, column: str, length: int = 100, ids_suffix: str = "_ids", tokens_suffix: str = "_tokens") -> DataFrame:
    """df with <column>_ids and <column>_tokens; an existing target raises."""
    for name in (column + ids_suffix, column + tokens_suffix):
        if name in df.columns:
            raise ValueError(f"the column {name} exists")
    ids = token_ids(regex_tokens(F.col(column)), length)
    words = F.array(*(F.lit(w) for w in VOCABULARY))
    return df.withColumn(column + ids_suffix, ids).withColumn(column + tokens_suffix, F.transform(F.col(column + ids_suffix), lambda i: F.get(words, i)))
