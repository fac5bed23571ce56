"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one is a minimal perfect hash (compress-hash-displace) over the vocabulary: a whole
pre-token that is in the vocabulary is resolved by one probe and one comparison.  Tier two, for
misses, merges a linked list of bytes with a heap of candidate pairs, lowest rank first.

Pre-tokens are cut exactly as the public pattern cuts them, but from an array of character
classes instead of a backtracking matcher.  Results do not depend on batches or caches.

Defined results: null text counts as empty and has no tokens; texts of any length are encoded
whole; repeated rows are encoded each; an empty table gives an empty result; only the named
columns are read, so extra columns cannot clash.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import map_arrow, slices, strings, table

#: Parameter: rank file of the production tokenizer, found through the public_tokenizers package.
RANKS = "byte_bpe_multi_50k.tiktoken"

#: Distinct pre-tokens whose ids a worker remembers; older ones are forgotten, never wrong.
REMEMBERED = 300_000

#: The contractions that the public pattern lists (fixed values).
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")

#: The pattern that ``pretokens`` cuts by (a fixed value); another one is refused.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3


@lru_cache(maxsize=1)
def character_classes() -> np.ndarray:
    """The class of every code point under \\p{L}, \\p{N} and \\s."""
    import regex

    chars = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, chars):
            for a, b in _unshift(m.start(), m.end()):
                out[a:b] = kind
    return out


def _unshift(a: int, b: int):
    """Code point ranges of positions in a string that lacks the surrogates."""
    for lo, hi, shift in ((0, 0xD800, 0), (0xD800, 0x110000 - 0x800, 0x800)):
        if (x := max(a, lo)) < (y := min(b, hi)):
            yield x + shift, y + shift


def pretokens(text: str, classes: np.ndarray) -> list[str]:
    """The matches of the public pattern, in order; together they are the text."""
    if not text:
        return []
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    kind = classes[code]
    n = len(code)
    start = np.empty(n, bool)
    start[0] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    # The last white space before other text stands alone; a plain space joins what follows.
    after = np.flatnonzero((kind[1:] != SPACE) & (kind[:-1] == SPACE)) + 1
    start[after - 1] = True
    start[after[code[after - 1] == 32]] = False
    quote = np.flatnonzero(code == 39)
    if len(quote):
        before = quote - 1
        opens = (quote == 0) | ((kind[before] != OTHER) & (code[before] != 32))
        for i in quote[opens].tolist():
            for c in CONTRACTIONS:
                if text.startswith(c, i):
                    end = i + len(c)
                    start[i + 1 : end] = False
                    if end < n:
                        # What follows starts anew, unless a space claims or is it.
                        start[end] = True
                    break
    at = np.flatnonzero(start).tolist()
    return [text[a:b] for a, b in zip(at, [*at[1:], n])]


class PerfectHash:
    """A minimal perfect hash over byte strings, with the keys kept to confirm a probe."""

    def __init__(self, keys: list[bytes]):
        self.keys_in = len(keys)
        n = max(1, len(keys))
        self.buckets = max(1, n // 2)
        hashes = [xxhash.xxh3_64_intdigest(k) for k in keys]
        members: list[list[int]] = [[] for _ in range(self.buckets)]
        for i, h in enumerate(hashes):
            members[h % self.buckets].append(i)
        taken = bytearray(n)
        self.shift = [0] * self.buckets
        self.slot_key = [0] * n
        rest = []
        for b in sorted(range(self.buckets), key=lambda b: -len(members[b])):
            own = members[b]
            if len(own) == 1:
                rest.append(b)
                continue
            d = 0
            while own:
                slots = [self._slot(hashes[i], d, n) for i in own]
                if len(set(slots)) == len(slots) and not any(taken[s] for s in slots):
                    for i, s in zip(own, slots):
                        taken[s], self.slot_key[s] = 1, i
                    self.shift[b] = d
                    break
                d += 1
        free = iter([s for s in range(n) if not taken[s]])
        for b in rest:
            s = next(free)
            self.shift[b], self.slot_key[s] = -1 - s, members[b][0]

    @staticmethod
    def _slot(h: int, d: int, n: int) -> int:
        return ((h >> 20) + d * (h >> 33 | 1)) % n

    def index(self, key: bytes) -> int:
        """The one position that ``key`` can have; the caller compares."""
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.buckets]
        return self.slot_key[-1 - d if d < 0 else self._slot(h, d, len(self.slot_key))]


class Codec:
    """Encodes and decodes with one vocabulary; small enough (a few MB) to be broadcast."""

    def __init__(self, tokens: list[tuple[bytes, int]], classes: np.ndarray):
        self.tokens = [t for t, _ in tokens]
        self.ids = [i for _, i in tokens]
        self.hash = PerfectHash(self.tokens)
        self.classes = classes
        self._ready()

    def _ready(self) -> None:
        self.ranks = dict(zip(self.tokens, self.ids))
        self.bytes_of = dict(zip(self.ids, self.tokens))
        self.decimal_of = {i: str(i) for i in self.ids}
        self.seen: dict[str, tuple[int, ...]] = {}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("ranks", "bytes_of", "decimal_of", "seen")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._ready()

    def whole(self, piece: bytes) -> int | None:
        """Tier one."""
        if not self.tokens:
            return None
        k = self.hash.index(piece)
        return self.ids[k] if self.tokens[k] == piece else None

    def merged(self, piece: bytes) -> list[int]:
        """Tier two: repeatedly joins the adjacent pair of lowest rank, the leftmost of equals.

        ``end[i]`` and ``before[i]`` link the parts; ``pair[i]`` is the rank at which the part at i
        joins its successor, so a heap entry whose rank differs from it is out of date.
        """
        n, rank = len(piece), self.ranks.get
        bits = n.bit_length()
        place = (1 << bits) - 1
        end = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        pair = [rank(piece[i : i + 2], -1) for i in range(n - 1)]
        pair.append(-1)
        heap = [r << bits | i for i, r in enumerate(pair) if r >= 0]
        heapify(heap)
        while heap:
            least = heappop(heap)
            i = least & place
            if pair[i] != least >> bits:
                continue
            j = end[i]
            end[i] = e = end[j]
            pair[j] = -1
            if e < n:
                before[e] = i
                pair[i] = r = rank(piece[i : end[e]], -1)
                if r >= 0:
                    heappush(heap, r << bits | i)
            else:
                pair[i] = -1
            p = before[i]
            if p >= 0:
                pair[p] = r = rank(piece[p:e], -1)
                if r >= 0:
                    heappush(heap, r << bits | p)
        out, i = [], 0
        while i < n:
            e = end[i]
            out.append(self.ranks[piece[i:e]])
            i = e
        return out

    def piece(self, token: str) -> tuple[int, ...]:
        raw = token.encode()
        own = self.whole(raw)
        ids = tuple(self.merged(raw)) if own is None else (own,)
        if len(token) <= 32:
            if len(self.seen) >= REMEMBERED:
                self.seen.clear()
            self.seen[token] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        seen, piece = self.seen.get, self.piece
        return list(chain.from_iterable([seen(t) or piece(t) for t in pretokens(text, self.classes)]))

    def decimal(self, ids: list[int]) -> str:
        return ",".join(map(self.decimal_of.__getitem__, ids))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def read_ranks(path: str) -> list[tuple[bytes, int]]:
    with open(path, "rb") as f:
        return [(base64.b64decode(a), int(b)) for a, b in map(bytes.split, filter(None, f.read().splitlines()))]


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """The codec of a rank file; the public package must cut texts by the pattern that is built in here."""
    import public_tokenizers

    if public_tokenizers.PATTERN != PATTERN:
        raise ValueError("the public tokenizers' pattern is not the one that this codec cuts by")
    return Codec(read_ranks(path), character_classes())


def production_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path(RANKS)


def encode_documents(docs: DataFrame, ranks_path: str, key: str = "doc_id", text: str = "text", token_ids: bool = False) -> DataFrame:
    """Encodes and decodes each row's whole text.

    Returns ``key``, ``n_tokens``, ``ids_sha256`` (of the decimal ids joined by commas),
    ``decoded_sha256`` (of the bytes that the ids decode to) and, if asked for, ``token_ids``.
    Rows map to rows without a shuffle.  The broadcast is the vocabulary, whose size is fixed.
    """
    shared = docs.sparkSession.sparkContext.broadcast(codec(ranks_path))
    key_type = docs.schema[key].dataType
    fields = [T.StructField("key", key_type), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if token_ids:
        fields.append(T.StructField("token_ids", T.ArrayType(T.IntegerType())))

    def encoded(c: Codec, batch: pa.RecordBatch) -> pa.RecordBatch:
        n, sha, back, ids_out = [], [], [], []
        for text in strings(batch.column(1)):
            ids = c.encode(text)
            n.append(len(ids))
            sha.append(hashlib.sha256(c.decimal(ids).encode()).hexdigest())
            back.append(hashlib.sha256(c.decode(ids)).hexdigest())
            if token_ids:
                ids_out.append(np.array(ids, np.int32))
        out = {"key": batch.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(sha, pa.string()), "decoded_sha256": pa.array(back, pa.string())}
        if token_ids:
            out["token_ids"] = pa.array(ids_out, pa.list_(pa.int32()))
        return pa.RecordBatch.from_pydict(out)

    def run(batches):
        c = shared.value
        for whole in batches:
            for batch in slices(whole, "text", 2_000_000):
                yield encoded(c, batch)

    src = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    return map_arrow(src, run, T.StructType(fields)).withColumnRenamed("key", key)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), production_ranks())
