"""Encoding of whole texts with a public byte-level BPE vocabulary (p7).

Every distinct pre-token of a worker is encoded once. Pre-tokens of similar length share a padded
integer matrix; in each round every row merges its leftmost pair of least rank, pairs are looked
up in an open-addressing hash table held in numpy arrays, finished rows leave the matrix
(compaction). Whole texts are then assembled by gathering the encoded pre-tokens.

Defined results: an empty text and a null text have no ids (an empty list, 0 tokens); a text that
spells a special token is ordinary text. Texts are never cut: a long text or a long pre-token
only takes a slower exact way (a linked list with a heap).
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"

# fixed values: the published pre-token pattern of this family of vocabularies (token_starts follows it)
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

NO_RANK = 2**31 - 1
#: pre-tokens of more bytes than this leave the matrices for the linked-list way
LONG_WORD = 256
#: encoded pre-tokens kept by one worker; beyond it the memo is emptied, which changes no result
MEMO_WORDS = 1_000_000
#: characters handled at once by one worker (a longer text is handled alone, whole)
BLOCK_CHARS = 1_000_000
#: pre-tokens of more characters than this get a cryptographic hash instead of the vectorised one
LONG_HASH = 64


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file: printable Latin-1
    stands for itself, the other bytes take code points from 256 on in order."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {b: chr(b) for b in kept}
    for byte in range(256):
        if byte not in names:
            names[byte] = chr(256 + len(names) - len(kept))
    return [names[b] for b in range(256)]


class HashIndex:
    """Open addressing in numpy arrays: distinct non-zero 64-bit keys to their order of insertion."""

    def __init__(self, room: int = 1 << 12):
        self.count = 0
        self._make(room)

    def _make(self, room: int) -> None:
        bits = int(np.ceil(np.log2(max(16, room))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.zeros(1 << bits, np.uint64)
        self.place = np.full(1 << bits, -1, np.int64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _put(self, keys: np.ndarray, place: np.ndarray) -> None:
        slots, waiting = self._slot(keys), np.arange(len(keys))
        while len(waiting):
            free = waiting[self.keys[slots[waiting]] == 0]
            placed = free[np.unique(slots[free], return_index=True)[1]]
            self.keys[slots[placed]] = keys[placed]
            self.place[slots[placed]] = place[placed]
            waiting = np.setdiff1d(waiting, placed, assume_unique=True)
            slots[waiting] = (slots[waiting] + 1) & self.mask

    def add(self, keys: np.ndarray) -> None:
        """Keys must be distinct and new."""
        if 2 * (self.count + len(keys)) > self.mask:
            old, place = self.keys[self.keys != 0], self.place[self.keys != 0]
            self._make(4 * (self.count + len(keys)))
            self._put(old, place)
        self._put(keys, np.arange(self.count, self.count + len(keys)))
        self.count += len(keys)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The order of insertion of each key, or -1."""
        slots = self._slot(keys)
        at = self.keys[slots]
        out = np.where(at == keys, self.place[slots], -1)
        todo = np.flatnonzero((at != keys) & (at != 0))
        while len(todo):
            slots[todo] = (slots[todo] + 1) & self.mask
            at = self.keys[slots[todo]]
            hit = at == keys[todo]
            out[todo[hit]] = self.place[slots[todo[hit]]]
            todo = todo[~hit & (at != 0)]
        return out


class Merges:
    """Arrays of one vocabulary: the id of each byte, a hash table of mergeable pairs (in the order
    of their ranks) and the class of each code point. About 4 MB for 50,000 merges, a size that
    the vocabulary fixes, so it may be broadcast."""

    def __init__(self, byte_ids: np.ndarray, pairs: np.ndarray, merged: np.ndarray):
        self.byte_ids = byte_ids.astype(np.int32)
        self.pairs = HashIndex(4 * max(1, len(pairs)))
        self.pairs.add(pairs.astype(np.uint64) + np.uint64(1))
        self.new_id = merged.astype(np.int32)
        self.classes = code_point_classes()

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or NO_RANK."""
        keys = ((left.astype(np.int64) << 32) | (right.astype(np.int64) & 0xFFFFFFFF)).astype(np.uint64) + np.uint64(1)
        rank = self.pairs.find(keys.ravel()).reshape(keys.shape)
        return np.where(rank >= 0, rank, NO_RANK)


LETTER, NUMBER, SPACE, OTHER, EDGE = range(5)


def code_point_classes() -> np.ndarray:
    """LETTER, NUMBER, SPACE or OTHER of every code point, as the published pattern sees it."""
    import regex

    everything = "".join(chr(i) if not 0xD800 <= i < 0xE000 else "!" for i in range(0x110000))
    classes = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for found in regex.finditer(pattern, everything):
            classes[found.start() : found.end()] = kind
    return classes


def token_starts(codes: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Marks where the pre-tokens of PATTERN start. codes: code points, each text followed by one
    entry of class EDGE.

    A pre-token is a run of one class, but the last space of white space joins the run after it
    (any other last blank stands alone), and an apostrophe that starts a pre-token takes the
    letters of an English contraction from the run after it."""
    start = np.empty(len(codes), bool)
    start[0] = True
    np.not_equal(classes[1:], classes[:-1], out=start[1:])
    start[classes == EDGE] = True
    blank = classes == SPACE
    last = np.flatnonzero(blank[:-1] & ~blank[1:] & (classes[1:] != EDGE))
    start[last] = True
    start[last[codes[last] == 32] + 1] = False
    quote = np.flatnonzero(codes == 39)
    quote = quote[start[quote] & (classes[quote + 1] == LETTER)]
    one, two = codes[quote + 1], codes[np.minimum(quote + 2, len(codes) - 1)]
    takes = np.zeros(len(quote), np.int64)
    for letters in ("s", "t", "m", "d"):
        takes[one == ord(letters)] = 1
    for letters in ("re", "ve", "ll"):
        takes[(one == ord(letters[0])) & (two == ord(letters[1]))] = 2
    quote, takes = quote[takes > 0], takes[takes > 0]
    start[quote + 1] = False
    start[quote + 1 + takes] = True
    return start


def load_merges(path: str = DEFAULT_VOCABULARY) -> Merges:
    """Read a vocabulary with merges (JSON) or a rank file (base64 and rank a line)."""
    if path.endswith(".tiktoken"):
        return _load_ranks(path)
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    vocab = model["vocab"]
    pairs, merged = [], []
    for pair in model["merges"]:
        a, b = pair if isinstance(pair, list) else pair.split(" ")
        pairs.append((vocab[a] << 32) | vocab[b])
        merged.append(vocab[a + b])
    byte_ids = np.array([vocab[c] for c in byte_alphabet()], np.int32)
    return Merges(byte_ids, np.array(pairs, np.int64), np.array(merged, np.int32))


def _load_ranks(path: str) -> Merges:
    """A rank file states no pairs: each entry is split where merging by lower ranks leaves two."""
    import base64

    ranks = {}
    with open(path, "rb") as file:
        for line in file:
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
    pairs, merged = [], []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        if len(token) < 2:
            continue
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min(
                (r, i)
                for i in range(len(parts) - 1)
                if (r := ranks.get(parts[i] + parts[i + 1], rank)) < rank
            )[1]
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        pairs.append((ranks[parts[0]] << 32) | ranks[parts[1]])
        merged.append(rank)
    byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
    return Merges(byte_ids, np.array(pairs, np.int64), np.array(merged, np.int32))


def _merge_matrix(table: Merges, rows: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
    """Encode the rows of one padded matrix (entries beyond a row's length are -1)."""
    done: list[np.ndarray | None] = [None] * len(rows)
    alive = np.arange(len(rows))
    while len(alive):
        width = int(lengths.max())
        rows = rows[:, :width]
        ranks = table.find(rows[:, :-1], rows[:, 1:]) if width > 1 else np.full((len(rows), 1), NO_RANK)
        at = ranks.argmin(axis=1)
        line = np.arange(len(rows))
        going = ranks[line, at] != NO_RANK
        for k in np.flatnonzero(~going):
            done[alive[k]] = rows[k, : lengths[k]].copy()
        rows, lengths, alive, at, ranks = rows[going], lengths[going], alive[going], at[going], ranks[going]
        if not len(alive):
            break
        new = table.new_id[ranks[np.arange(len(rows)), at]]
        column = np.arange(rows.shape[1])[None, :]
        after = np.concatenate([rows[:, 1:], np.full((len(rows), 1), -1, rows.dtype)], axis=1)
        rows = np.where(column > at[:, None], after, rows)
        rows[np.arange(len(rows)), at] = new
        lengths = lengths - 1
    return done


def _merge_long(table: Merges, ids: np.ndarray) -> np.ndarray:
    """The same merges for one long pre-token: a linked list and a heap of (rank, position)."""
    value = ids.tolist()
    n = len(value)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    memo: dict[tuple[int, int], tuple[int, int] | None] = {}

    def look(a: int, b: int) -> tuple[int, int] | None:
        if (a, b) not in memo:
            rank = int(table.find(np.array([a]), np.array([b]))[0])
            memo[a, b] = None if rank == NO_RANK else (rank, int(table.new_id[rank]))
        return memo[a, b]

    ranks = table.find(ids[:-1], ids[1:]).tolist()
    heap = [(rank, i, value[i], value[i + 1]) for i, rank in enumerate(ranks) if rank != NO_RANK]
    heapq.heapify(heap)
    live = [True] * n
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if not live[i] or j >= n or value[i] != a or value[j] != b:
            continue
        value[i] = look(a, b)[1]
        live[j] = False
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
            if found := look(value[i], value[after[i]]):
                heapq.heappush(heap, (found[0], i, value[i], value[after[i]]))
        if (h := before[i]) >= 0 and (found := look(value[h], value[i])):
            heapq.heappush(heap, (found[0], h, value[h], value[i]))
    return np.array([value[i] for i in range(n) if live[i]], np.int32)


def encode_words(table: Merges, words: list[str]) -> list[np.ndarray]:
    """The ids of each pre-token, through length-bucketed matrices."""
    raw = [w.encode("utf-8") for w in words]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    out: list[np.ndarray] = [np.empty(0, np.int32)] * len(raw)
    low = 0
    for high in (1, 2, 4, 6, 8, 12, 16, 24, 32, 64, 128, LONG_WORD):
        take = np.flatnonzero((size > low) & (size <= high))
        low = high
        step = max(1, 4_000_000 // high)
        for part in (take[i : i + step] for i in range(0, len(take), step)):
            lengths = size[part]
            rows = np.full((len(part), high), -1, np.int32)
            inside = np.arange(high)[None, :] < lengths[:, None]
            rows[inside] = table.byte_ids[np.frombuffer(b"".join(raw[i] for i in part), np.uint8)]
            for i, ids in zip(part, _merge_matrix(table, rows, lengths)):
                out[i] = ids
    for i in np.flatnonzero(size > LONG_WORD):
        out[i] = _merge_long(table, table.byte_ids[np.frombuffer(raw[i], np.uint8)])
    return out


class Encoder:
    """Encodes blocks of texts and remembers the pre-tokens that it has met, by a 64-bit hash:
    a sum of random numbers, one for each code point, weighted by random odd numbers, one for each
    position. A hit is compared with the spelling of the pre-token that was met; one of another spelling
    is encoded by itself."""

    def __init__(self, table: Merges):
        self.table = table
        random = np.random.default_rng(20_240_229)
        self.char_hash = random.integers(1, 2**64, 0x110000, np.uint64)
        self.place_hash = random.integers(1, 2**64, LONG_HASH, np.uint64) | np.uint64(1)
        self.forget()

    def forget(self) -> None:
        self.index = HashIndex()
        self.sizes = np.empty(0, np.int32)
        self.starts = np.empty(0, np.int64)
        self.ids = np.empty(0, np.int32)
        self.spelled = np.empty(0, np.uint32)
        self.letters = np.empty(0, np.int64)
        self.spelled_at = np.empty(0, np.int64)

    def learn(self, keys: np.ndarray, words: list[str]) -> None:
        self.index.add(keys)
        self.append(words)

    def append(self, words: list[str]) -> None:
        """Encode words and give them the next numbers."""
        coded = encode_words(self.table, words)
        sizes = np.fromiter(map(len, coded), np.int32, len(coded))
        letters = np.fromiter(map(len, words), np.int64, len(words))
        self.spelled_at = np.concatenate([self.spelled_at, len(self.spelled) + np.cumsum(letters) - letters])
        self.letters = np.concatenate([self.letters, letters])
        self.spelled = np.concatenate([self.spelled, np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)])
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.ids = np.concatenate([self.ids, *coded])

    def hashes(self, codes: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        place = np.arange(len(codes)) - np.repeat(at, size)
        keys = np.add.reduceat(self.char_hash[codes] * self.place_hash[np.minimum(place, LONG_HASH - 1)], at)
        for i in np.flatnonzero(size > LONG_HASH):
            whole = hashlib.blake2b(codes[at[i] : at[i] + size[i]].tobytes(), digest_size=8).digest()
            keys[i] = np.frombuffer(whole, np.uint64)[0]
        return np.where(keys == 0, np.uint64(1), keys)

    def clashes(self, codes: np.ndarray, at: np.ndarray, size: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The tokens that were found under the hash of a pre-token of another spelling. Tokens without a
        number are ends of texts, of one character each."""
        if not len(self.spelled):
            return np.empty(0, np.int64)
        place = np.repeat((self.spelled_at[word] - at).astype(np.int32), size)
        place += np.arange(len(codes), dtype=np.int32)
        differs = codes != self.spelled.take(place, mode="clip")
        ends = word < 0
        differs[at[ends]] = False
        other = ~ends & (self.letters[word] != size)
        if differs.any():
            other |= np.logical_or.reduceat(differs, at) & ~ends
        return np.flatnonzero(other)

    def block(self, texts: list[str | None], with_ids: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
        """(number of tokens of each text, all ids one after the other)."""
        if self.index.count > MEMO_WORDS:
            self.forget()
        codes = np.frombuffer("".join([(t or "") + "\0" for t in texts]).encode("utf-32-le"), np.uint32)
        edge = np.cumsum(np.fromiter((len(t or "") + 1 for t in texts), np.int64, len(texts))) - 1
        classes = self.table.classes[codes]
        classes[edge] = EDGE
        start = token_starts(codes, classes)
        at = np.flatnonzero(start)
        size = np.diff(np.append(at, len(codes)))
        keys = self.hashes(codes, at, size)
        edge_token = np.searchsorted(at, edge)
        keys[edge_token] = 0  # the empty slot: never found
        word = self.index.find(keys)
        word[edge_token] = -2
        new = np.flatnonzero(word == -1)
        if len(new):
            fresh, first = np.unique(keys[new], return_index=True)
            spelled = [codes[at[i] : at[i] + size[i]].tobytes().decode("utf-32-le") for i in new[first]]
            self.learn(fresh, spelled)
            word[new] = self.index.find(keys[new])
        clash, held = self.clashes(codes, at, size, word), (self.sizes, self.starts, self.ids, self.spelled, self.letters, self.spelled_at)
        if len(clash):
            # for this block alone: the index knows no second word of a hash
            word[clash] = len(self.sizes) + np.arange(len(clash))
            self.append([codes[at[i] : at[i] + size[i]].tobytes().decode("utf-32-le") for i in clash])
        sizes = np.where(word >= 0, self.sizes[word], 0) if len(self.sizes) else np.zeros(len(word), np.int32)
        ends = np.cumsum(sizes, dtype=np.int64)
        lengths, ids = np.diff(np.concatenate([[0], ends[edge_token]])), None
        if with_ids:
            ids = np.empty(0, np.int32)
            if len(self.sizes):
                ids = self.ids[np.repeat(self.starts[word] - (ends - sizes), sizes) + np.arange(ends[-1])]
        self.sizes, self.starts, self.ids, self.spelled, self.letters, self.spelled_at = held
        return lengths, ids


_held: list = [None, None]


def worker_encoder(shared) -> Encoder:
    """One encoder a worker process; shared is the broadcast of the merges."""
    if _held[0] is not shared:
        _held[:] = shared, Encoder(shared.value)
    return _held[1]


def text_blocks(texts: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """Consecutive runs of texts of about BLOCK_CHARS characters: (first position, texts)."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    total, start = 0, 0
    for i, n in enumerate(size.tolist()):
        if i > start and total + n > BLOCK_CHARS:
            yield start, texts.slice(start, i - start).to_pylist()
            total, start = 0, i
        total += n
    if start < len(texts):
        yield start, texts.slice(start).to_pylist()


def encode_table(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = DEFAULT_VOCABULARY, ids_name: str = "ids") -> DataFrame:
    """(key, ids array<int>) of every row of df. No shuffle: one pass over the text column."""
    shared = df.sparkSession.sparkContext.broadcast(load_merges(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(shared)
        for batch in batches:
            for start, texts in text_blocks(batch.column(1)):
                lengths, ids = encoder.block(texts)
                offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), lists], ["key", "ids"])

    kind = df.schema[key].dataType.simpleString()
    out = df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, ids array<int>")
    return out.select(F.col("key").alias(key), F.col("ids").alias(ids_name))


def count_tokens(df: DataFrame, text: str = "text", vocabulary: str = DEFAULT_VOCABULARY, keep: tuple[str, ...] = ("doc_id",), name: str = "n_tokens") -> DataFrame:
    """The columns keep of every row of df with the number of tokens of its text."""
    shared = df.sparkSession.sparkContext.broadcast(load_merges(vocabulary))
    width = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(shared)
        for batch in batches:
            counts = [encoder.block(texts, with_ids=False)[0] for _, texts in text_blocks(batch.column(width))]
            counted = pa.array(np.concatenate(counts) if counts else np.empty(0), pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(width)), counted], [*(f"k{i}" for i in range(width)), "n"])

    schema = ", ".join(f"k{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    out = df.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.col(text).alias("t")).mapInArrow(run, f"{schema}, n bigint")
    return out.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), F.col("n").alias(name))
