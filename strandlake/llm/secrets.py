"""Secret scan: three base patterns, and a guess-cost dynamic programme over credential values.

The programme finds the cheapest segmentation of a value into dictionary words, dates, repeats,
keyboard walks and brute-force spans; its cost is the base-2 logarithm of the guesses an attacker
needs who knows these kinds.  A value in a credential context that costs at least
``LEAST_BITS`` is a secret of kind ``guess``, whatever it looks like.

Context values are those of the base assignments and, whole, those of ``CONTEXT``.  Base
spans always stay.  Words are those of passwords, then of the public tokenizer's vocabulary by rank.
A repeat may have a unit of any length, and repeats and walks any part of their run; the runs of
repeats are found in about n log n steps, and a step looks only at beginnings that may still win.

Defined results: null counts as empty, without spans; positions are code points, end exclusive;
whole texts are scanned at any length; repeated rows are scanned each; empty tables give empty
results; only the named columns are read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from functools import lru_cache
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe
from .common import map_arrow, slices, strings, table

#: The base kinds, in the order that breaks ties of start.
KINDS = ("assign", "access", "hex", "guess")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
#: The shortest matches that count are written into these two patterns: the runs are maximal either way.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

#: Shortest value of a base assignment.
LEAST_VALUE = 6

#: What a value in a credential context may hold.
VALUE = r"""[^\s"'<>,;]"""
#: Credential contexts, those of the base assignment too, with or without a prefix of the name; group 1 is the whole
#: value. Only a bearer's may follow a bare space.
CONTEXT = re.compile(rf"""(?:password|passwd|secret|token|api_?key|(?<![a-z0-9])(?:pwd|pass(?:phrase|code)|credentials?|bearer|private_key|access_key)\b)["']?\x20*(?:[:=]|\x20is\x20|(?<=bearer)\x20)\x20*["']?({VALUE}{{8,}})""", re.I | re.A)
_REST = re.compile(f"{VALUE}*")
#: Every match of CONTEXT or ASSIGN holds one of these (after lower-casing); they only save time.
HINTS = ("pwd", "pass", "credential", "bearer", "private_key", "secret", "access_key", "token", "api")

#: Parameter: guesses, as bits, from which a value in a credential context counts as a secret.
LEAST_BITS = 50.0

#: Common words of passwords, most frequent first (fixed values; rank n costs log2(n + 1) bits).
WORDS = """password admin welcome letmein qwerty monkey dragon master login princess sunshine football baseball
shadow superman michael jordan hunter trustno batman access love secret test user guest root changeme default
example sample token key pass word spring summer autumn winter monday friday january december hello world
server database service system account private public client api demo temp null none true false your here
insert enter value string number my the and for""".split()

#: Rows of a common keyboard (fixed values).
KEYBOARD = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")


class Words(dict):
    """Bits of each word, and the length of the longest."""

    longest = 0


@lru_cache(maxsize=1)
def dictionary() -> Words:
    """Bits of each word: WORDS, then the words of the tokenizer's vocabulary, which is ranked and fixed (some 20,000)."""
    ranks = sorted((r, token) for token, r in dict(bpe.read_ranks(bpe.production_ranks())).items())
    ranked = [*WORDS, *(token[1:].decode() for _, token in ranks if re.fullmatch(rb" [a-z]{3,}", token))]
    out = Words((w, log2(n + 2)) for n, w in reversed(list(enumerate(ranked))))
    out.longest = max(map(len, out))
    return out


_PLAIN = str.maketrans("@4301$5!7", "aaeoissit")
_DATE = re.compile(r"(?:19|20)\d\d(?:[-/.]?(?:0[1-9]|1[0-2])(?:[-/.]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)?\d\d")
_NEXT = {(a, b): r for r, row in enumerate(KEYBOARD) for x, y in zip(row, row[1:]) for a, b in ((x, y), (y, x))}
#: Bits to say which kind a segment is and where it ends.
SEGMENT = 3.0


def _char_bits(c: str) -> float:
    if c.isdigit():
        return log2(10)
    if "a" <= c <= "z" or "A" <= c <= "Z":
        return log2(26) + (c.isupper() and 0.5)
    return log2(33) if c.isascii() else log2(200)


class Extent:
    """How far two places of a value read alike: character by character, then by halving over prefix hashes."""

    _M, _B = (1 << 61) - 1, 0x1F3D5B79A2C4E68

    def __init__(self, value: str):
        self.value, self.n, self.total = value, len(value), None

    def _alike(self, x: int, y: int, size: int) -> bool:
        if self.total is None:
            self.total, self.power = [0], [1]
            for c in self.value:
                self.total.append((self.total[-1] * self._B + ord(c) + 1) % self._M)
                self.power.append(self.power[-1] * self._B % self._M)
        t, p = self.total, self.power[size]
        return (t[x + size] - t[x] * p - t[y + size] + t[y] * p) % self._M == 0

    def ahead(self, x: int, y: int) -> int:
        """Characters alike from x and y on (x < y)."""
        v, most = self.value, self.n - y
        for k in range(min(most, 64)):
            if v[x + k] != v[y + k]:
                return k
        low, high = min(most, 64), most
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if self._alike(x, y, middle) else (low, middle - 1)
        return low

    def back(self, x: int, y: int) -> int:
        """Characters alike that end before x and y (x < y)."""
        v, most = self.value, x
        for k in range(min(most, 64)):
            if v[x - 1 - k] != v[y - 1 - k]:
                return k
        low, high = min(most, 64), most
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if self._alike(x - middle, y - middle, middle) else (low, middle - 1)
        return low


def repeats(value: str) -> list[tuple[int, int, int]]:
    """(start, end, unit) of every longest run that says a shortest unit at least twice."""
    n, out, extent = len(value), [], Extent(value)
    codes = np.array([ord(c) for c in value], np.uint32)
    found: dict[int, tuple[list[int], list[int]]] = {}  # starts and ends of the runs of each unit, ascending

    def within(k: int, end: int, unit: int) -> int:
        """The end of a run of a part of the unit that holds k to end; 0 if there is none."""
        for u, (starts, ends) in found.items():
            if unit % u == 0 and (at := bisect_right(starts, k) - 1) >= 0 and ends[at] >= end:
                return ends[at]
        return 0

    for unit in range(1, n // 2 + 1):
        done, own = 0, ([], [])
        # A run's positions that equal those a unit later are at least ``unit`` on end: one is a multiple of it.
        at, last = np.flatnonzero(codes[: n - unit : unit] == codes[unit::unit]) * unit, 0
        while last < len(at):
            k = int(at[last])
            if known := within(k, k + unit + 1, unit):  # a shorter unit's run, which ends where this one would
                done = known - unit
            else:
                a, z = k - extent.back(k, k + unit), k + extent.ahead(k, k + unit)
                done = z
                if z - a >= unit and not within(a, z + unit, unit):
                    out.append((a, z + unit, unit))
                    own[0].append(a)
                    own[1].append(z + unit)
            last = int(at.searchsorted(max(done, k + 1)))
        if own[0]:
            found[unit] = own
    return out


class Run:
    """A stretch of which any part of at least ``least`` steps may be a segment; its price grows with log2 of the steps.

    Of two places where a part may begin, the farther one gains on the nearer with every step, so a
    place that is no better than a farther one is dropped for good.
    """

    def __init__(self, kind: str, start: int, end: int, step: int, least: int, bits: float):
        self.kind, self.start, self.end, self.step, self.least, self.bits = kind, start, end, step, least, bits
        self.begins: dict[int, list[int]] = {}

    def cheapest(self, i: int, best: list[float]) -> tuple[float, int]:
        """The least cost of what ends at i by a part of the run, without SEGMENT, and where the part begins."""
        new = i - self.least * self.step
        if new < self.start:
            return float("inf"), -1
        kept, low, at = [], float("inf"), -1
        for f in (*self.begins.get(new % self.step, ()), new):
            cost = best[f] + log2((i - f) // self.step)
            if cost < low:
                low, at = cost, f
                kept.append(f)
        self.begins[new % self.step] = kept
        return low + self.bits, at


def runs(value: str, low: str) -> dict[int, list[Run]]:
    """The repeats and keyboard walks of a value by their start."""
    out: dict[int, list[Run]] = {}
    for a, z, unit in repeats(value):
        least = 3 if unit == 1 else 2
        if z - a >= least * unit:
            out.setdefault(a, []).append(Run("repeat", a, z, unit, least, sum(map(_char_bits, value[a : a + unit]))))
    a, n = 0, len(low)
    while a < n:
        z = a + 1
        while z < n and (low[z - 1], low[z]) in _NEXT:
            z += 1
        if z - a >= 3:
            out.setdefault(a, []).append(Run("walk", a, z, 1, 3, log2(sum(map(len, KEYBOARD))) + 1))
        a = z
    return out


def guess_bits(value: str, rank: Words | None = None) -> tuple[float, list[tuple[str, int, int]]]:
    """The cheapest segmentation: its bits, and its (kind, start, end) parts."""
    rank = dictionary() if rank is None else rank
    n = len(value)
    low = value.lower() if len(value.lower()) == n else value
    plain = low.translate(_PLAIN)
    forms = ((low, 0.0), (plain, 2.0)) if plain != low else ((low, 0.0),)
    inf = float("inf")
    best, back = [inf] * (n + 1), [("", 0)] * (n + 1)
    best[0] = 0.0
    brute, brute_from = [inf] * (n + 1), [0] * (n + 1)
    starts, live = runs(value, low), []
    for i in range(n + 1):
        live = [r for r in live if i <= r.end]
        for r in live:
            cost, at = r.cheapest(i, best)
            if cost + SEGMENT < best[i]:
                best[i], back[i] = cost + SEGMENT, (r.kind, at)
        live += starts.get(i, ())
        if brute[i] < best[i]:
            best[i], back[i] = brute[i], ("brute", brute_from[i])
        if i == n:
            break
        # Brute force: a new segment here, or the one that reaches here by one more character.
        c, here = _char_bits(value[i]), best[i] + SEGMENT
        if here <= brute[i]:
            brute[i + 1], brute_from[i + 1] = here + c, i
        else:
            brute[i + 1], brute_from[i + 1] = brute[i] + c, brute_from[i]
        for j in range(i + 2, min(n, i + rank.longest) + 1):
            for form, extra in forms:
                r = rank.get(form[i:j])
                if r is not None and (cost := here + r + extra + (value[i:j] != low[i:j])) < best[j]:
                    best[j], back[j] = cost, ("word", i)
        if (m := _DATE.match(value, i)) and (cost := here + log2(36525)) < best[m.end()]:
            best[m.end()], back[m.end()] = cost, ("date", i)
    parts, j = [], n
    while j:
        kind, i = back[j]
        parts.append((kind, i, j))
        j = i
    return best[n], parts[::-1]


def spans(text: str, least_bits: float = LEAST_BITS, rank: Words | None = None) -> list[tuple[str, int, int]]:
    """All spans by start, then kind."""
    out, values = [], []
    low = text.lower()
    if any(h in low for h in HINTS):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= LEAST_VALUE:
                out.append(("assign", m.start(), m.end()))
                values.append(m.span(2))
        values += [m.span(1) for m in CONTEXT.finditer(text)]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text)]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    out += [("guess", a, b) for a, b in sorted(set(values)) if guess_bits(text[a:b], rank)[0] >= least_bits]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", least_bits: float = LEAST_BITS) -> DataFrame:
    """``key`` and ``spans`` (kind, start, end) of each row; rows are judged alone, without a shuffle."""
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([T.StructField("key", docs.schema[key].dataType), T.StructField("spans", T.ArrayType(span))])
    shared = docs.sparkSession.sparkContext.broadcast(dictionary())
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                found = [[{"kind": k, "start": a, "end": b} for k, a, b in spans(t, least_bits, shared.value)] for t in strings(batch.column(1))]
                yield pa.RecordBatch.from_pydict({"key": batch.column(0), "spans": pa.array(found, arrow)})

    return map_arrow(docs.select(docs[key].alias("key"), docs[text].alias("text")), run, schema).withColumnRenamed("key", key)


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]", least_bits: float = LEAST_BITS) -> DataFrame:
    """``docs`` with every span replaced by ``mark``; of an assignment the value goes, whole."""
    schema = docs.schema
    at = schema.names.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(dictionary())

    def clean(t: str | None) -> str | None:
        if not t:
            return t
        found = []
        for kind, a, b in spans(t, least_bits, shared.value):
            if kind == "assign":
                a, b = ASSIGN.match(t, a).span(2)
                b = _REST.match(t, b).end()  # the base pattern stops at characters that the secret may go on with
            found.append((a, b))
        out, done = [], 0
        for a, b in sorted(found):
            if b <= done:
                continue
            if a >= done:
                out += [t[done:a], mark]
            done = b
        return "".join([*out, t[done:]]) if found else t

    def run(batches):
        for whole in batches:
            for batch in slices(whole, text):
                col = batch.column(at)
                yield pa.RecordBatch.from_arrays([pa.array([clean(x) for x in col.to_pylist()], col.type) if i == at else batch.column(i) for i in range(batch.num_columns)], schema=batch.schema)

    return map_arrow(docs, run, schema)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = lambda col: F.array_join(F.transform(col, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "guess")
    return find_secrets(table(spark, sf_dir, "documents")).select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def brute_force_base(text: str | None) -> list[tuple[str, int, int]]:
    """The base spans straight from the contract's patterns, for tests."""
    t = text or ""
    out = [("assign", *m.span()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def digest(found: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in found).encode()).hexdigest()
