"""Per-document text quality statistics with fixed-threshold rules (p9).

Blocks of whole texts become one array of code points; every statistic is a vectorised pass with
table lookups and per-line, per-word and per-document reductions. Each document gets one row with
its statistics and the signs that it shows; a document that shows at least two is a case.

Definitions: lines end at LF and lose blanks (space, tab) and CR at both ends; content lines are
those not empty, not only digits 0-9 and without '-->'; words are maximal runs without space, tab,
CR and LF in content lines. Defined results: a null or empty text, or one without content, has 0
words and lines, null ratios and no signs; a text of fewer than MIN_WORDS words is no case.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molquarry.llm.tokens import text_blocks

MIN_WORDS = 5
MIN_SIGNS = 2
MAX_SYMBOLS = 0.22
MIN_COMMON = 0.15
MIN_ENDED = 0.25
WORD_LENGTHS = (2.8, 8.0)
SIGNS = ("symbols", "uncommon_words", "unfinished_lines", "word_length")
END_MARKS = ".!?…"
BULLETS = "-*•·–—‣▪●○◦►"
#: the word list is a small fixed table; a larger one is refused rather than sent to every worker
MAX_COMMON_WORDS = 1_000_000

COUNTS = ("n_chars", "n_lines", "n_words", "word_chars", "symbol_chars", "common_words", "ended_lines", "bullet_lines")
#: letters whose lower case takes more than one character, or depends on what surrounds them
CONTEXT_LETTERS = (0x130, 0x3A3)


class Tables:
    """Code point tables of a worker process and the hashed common words by length."""

    LETTER, DIGIT, GAP, MARK, BULLET = 1, 2, 4, 8, 16

    def __init__(self, words: set[str]):
        self.words = words
        kind = np.zeros(0x110000, np.uint8)
        lower = np.arange(0x110000, dtype=np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if unicodedata.category(c)[0] == "L":
                kind[i] = self.LETTER
                small = c.lower()
                if len(small) == 1:
                    lower[i] = ord(small)
        kind[48:58] |= self.DIGIT
        for chars, flag in ((" \t\r\n", self.GAP), (END_MARKS, self.MARK), (BULLETS, self.BULLET)):
            for c in chars:
                kind[ord(c)] |= flag
        self.kind, self.lower = kind, lower
        self.multiplier = np.uint64(0x9E3779B97F4A7C15)
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in sorted({len(w) for w in words}):
            spelled = np.array([[ord(c) for c in w] for w in words if len(w) == size], np.uint32)
            hashed = np.zeros(len(spelled), np.uint64)
            for j in range(size):
                hashed = hashed * self.multiplier + spelled[:, j]
            order = np.argsort(hashed, kind="stable")
            self.by_length[size] = (hashed[order], spelled[order])

    def common(self, lowered: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether each word lowered[first:first+size] is in the list; hashes find the candidate,
        the characters decide."""
        out = np.zeros(len(first), bool)
        for length, (hashed, spelled) in self.by_length.items():
            which = np.flatnonzero(size == length)
            at = first[which]
            h = np.zeros(len(at), np.uint64)
            for j in range(length):
                h = h * self.multiplier + lowered[at + j]
            # words of equal hash stand side by side; each is compared with all of them
            left, right = np.searchsorted(hashed, h), np.searchsorted(hashed, h, side="right")
            for k in range(int((right - left).max(initial=0))):
                live = np.flatnonzero(left + k < right)
                same = np.ones(len(live), bool)
                for j in range(length):
                    same &= lowered[at[live] + j] == spelled[left[live] + k, j]
                out[which[live[same]]] = True
        return out


_held: list = [None, None]


def strip_letters(word: str) -> str:
    """word without the non-letters at both ends."""
    letters = [i for i, c in enumerate(word) if unicodedata.category(c)[0] == "L"]
    return word[letters[0] : letters[-1] + 1] if letters else ""


def measure(texts: list[str | None], tables: Tables) -> np.ndarray:
    """A row of COUNTS for each text."""
    lengths = np.fromiter((len(t or "") for t in texts), np.int64, len(texts))
    codes = np.frombuffer("".join([(t or "") + "\n" for t in texts]).encode("utf-32-le"), np.uint32)
    kind = tables.kind[codes]
    line_end = np.flatnonzero(codes == 10)
    line_start = np.concatenate([[0], line_end[:-1] + 1])
    doc_end = np.cumsum(lengths + 1) - 1
    doc_of_line = np.searchsorted(doc_end, line_end)

    solid = (kind & tables.GAP) == 0
    at = np.flatnonzero(solid)
    line_of = np.searchsorted(line_end, at)
    n_lines = len(line_end)
    filled = np.bincount(line_of, minlength=n_lines)
    edge = np.cumsum(filled)
    has = filled > 0
    first, last = np.zeros(n_lines, np.int64), np.zeros(n_lines, np.int64)
    first[has], last[has] = at[(edge - filled)[has]], at[(edge - 1)[has]]
    digits = np.bincount(line_of[(kind[at] & tables.DIGIT) > 0], minlength=n_lines)
    content = has & (digits < last - first + 1)
    dash = np.flatnonzero(codes == 45)
    dash = dash[dash + 2 < len(codes)]
    arrow = dash[(codes[dash + 1] == 45) & (codes[dash + 2] == 62)]
    content[np.searchsorted(line_end, arrow)] = False

    out = np.zeros((len(texts), len(COUNTS)), np.int64)
    per_doc = lambda docs: np.bincount(docs, minlength=len(texts))
    out[:, 0] = lengths
    out[:, 1] = per_doc(doc_of_line[content])
    out[:, 6] = per_doc(doc_of_line[content & ((kind[last] & tables.MARK) > 0)])
    out[:, 7] = per_doc(doc_of_line[content & ((kind[first] & tables.BULLET) > 0)])

    at = at[content[line_of]]
    if not len(at):
        return out
    doc_of = doc_of_line[np.searchsorted(line_end, at)]
    out[:, 3] = per_doc(doc_of)
    out[:, 4] = per_doc(doc_of[(kind[at] & (tables.LETTER | tables.DIGIT)) == 0])
    new_word = np.concatenate([[True], np.diff(at) > 1])
    word_doc = doc_of[new_word]
    out[:, 2] = per_doc(word_doc)
    word_of = np.cumsum(new_word) - 1
    letter = np.flatnonzero((kind[at] & tables.LETTER) > 0)
    if len(letter):
        turn = np.concatenate([[True], np.diff(word_of[letter]) > 0])
        ends = np.concatenate([turn[1:], [True]])
        begin, end, docs = at[letter[turn]], at[letter[ends]], word_doc[word_of[letter[turn]]]
        common = tables.common(tables.lower[codes], begin, end - begin + 1)
        out[:, 5] = per_doc(docs[common])
    odd = np.flatnonzero(np.isin(codes, CONTEXT_LETTERS))
    for d in np.unique(np.searchsorted(doc_end, odd)).tolist():
        words = [w for i in np.flatnonzero(content & (doc_of_line == d)) for w in _words(codes[line_start[i] : line_end[i]])]
        out[d, 5] = sum(strip_letters(w.lower()) in tables.words for w in words)
    return out


def _words(codes: np.ndarray) -> list[str]:
    line = codes.tobytes().decode("utf-32-le")
    return [w for w in line.replace("\t", " ").replace("\r", " ").split(" ") if w]


def load_words(words: DataFrame, column: str = "word") -> set[str]:
    """The distinct words of a small table; its size is checked before anything is sent."""
    found = words.where(F.col(column).isNotNull()).select(column).distinct().limit(MAX_COMMON_WORDS + 1).collect()
    if len(found) > MAX_COMMON_WORDS:
        raise ValueError(f"the word list has more than {MAX_COMMON_WORDS} words")
    return {r[0] for r in found}


def quality_table(df: DataFrame, words: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: key, counts, ratios, signs (array of SIGNS) and is_case."""
    shared = df.sparkSession.sparkContext.broadcast(load_words(words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _held[0] is not shared:
            _held[:] = shared, Tables(shared.value)
        for batch in batches:
            for start, texts in text_blocks(batch.column(1)):
                counts = measure(texts, _held[1])
                columns = [pa.array(counts[:, i], pa.int64()) for i in range(len(COUNTS))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), *columns], ["key", *COUNTS])

    kind = df.schema[key].dataType.simpleString()
    counted = df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, " + ", ".join(f"{c} bigint" for c in COUNTS))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    rated = counted.select(
        F.col("key").alias(key), *COUNTS,
        share("word_chars", "n_words").alias("mean_word_length"),
        share("symbol_chars", "word_chars").alias("symbol_ratio"),
        share("common_words", "n_words").alias("common_share"),
        share("ended_lines", "n_lines").alias("ended_share"),
        share("bullet_lines", "n_lines").alias("bullet_share"),
    )
    rules = (
        F.col("symbol_ratio") > MAX_SYMBOLS,
        F.col("common_share") < MIN_COMMON,
        F.col("ended_share") < MIN_ENDED,
        (F.col("mean_word_length") < WORD_LENGTHS[0]) | (F.col("mean_word_length") > WORD_LENGTHS[1]),
    )
    signs = F.filter(F.array(*(F.when(rule, F.lit(name)) for rule, name in zip(rules, SIGNS))), lambda x: x.isNotNull())
    return rated.withColumn("signs", signs).withColumn("is_case", (F.col("n_words") >= MIN_WORDS) & (F.size("signs") >= MIN_SIGNS))
