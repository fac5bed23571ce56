"""Fill-in-the-middle training texts, cut by an index of distinct texts.

1. Each document is dealt to a bucket by the SHA-256 of its text; the copies of a text that many
   documents share are dealt on by a salt, so no bucket grows with a group of copies.
2. The index has one row per distinct text: the ends of its tokens as an Elias-Fano list.  It is
   worked out once, where the group's texts lie, after comparing them.  Its rows, about a tenth
   of the texts, go to every bucket that holds copies.
3. There documents meet their text's list, and each selects its own two seeded cuts.

Texts are shuffled once: both steps read the same exchange.

Defined results: null and empty texts have no tokens and stay plain; a null key seeds with the empty string;
rows that repeat a key give a row each, as do copies of a text; an empty table gives an empty
result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_SPACE, HOT_KEYS, HOT_ROWS, give_back, table
from .elias_fano import EliasFano, encode

#: Marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Bytes of text that one bucket holds on average; a task reads a bucket at a time.
BUCKET_BYTES = 8_000_000

_SPACE = np.zeros(256, bool)
_SPACE[list(ASCII_SPACE)] = True

_LIST = "sha binary, salts long, n int, width int, low binary, high binary"
_OUT = "n long, form string, prefix_chars long, middle_chars long, output string"


def boundaries(text: str) -> np.ndarray:
    """Ends of the tokens, in code points: a token is white space and the word after it, or white space at the end."""
    data = np.frombuffer(text.encode(), np.uint8)
    if not len(data):
        return np.zeros(0, np.int64)
    space = _SPACE[data]
    ends = ~space
    ends[:-1] &= space[1:]
    ends[-1] = True
    at = np.flatnonzero(ends) + 1
    return at if len(data) == len(text) else np.cumsum((data & 0xC0) != 0x80)[at - 1]


def _dealt(docs: DataFrame, key: str, text: str, seed: int) -> tuple[DataFrame, int]:
    """Documents with digest, salts and bucket, and the number of buckets."""
    one = docs.select(F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text"))
    n, size = one.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    buckets = max(1, -(-(size or 0) // BUCKET_BYTES))
    least = max(HOT_ROWS, n // HOT_KEYS + 1)
    draws = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256)
    one = one.withColumn("sha", F.unhex(F.sha2("text", 256))).withColumns({f"h{k + 1}": F.conv(F.substr(draws, F.lit(8 * k + 1), F.lit(8)), 16, 10).cast("long") for k in range(4)})
    # keys above ``least`` rows: fewer than HOT_KEYS, whatever the data
    hot = one.groupBy("sha").agg(F.count("*").alias("rows")).where(F.col("rows") > least).select("sha", F.ceil(F.col("rows") / least).alias("salts"))
    one = one.join(F.broadcast(hot), "sha", "left").withColumn("salts", F.coalesce("salts", F.lit(1).cast("long"))).withColumn("salt", F.floor(F.rand(seed) * F.col("salts")))
    return one.withColumn("bucket", F.pmod(F.xxhash64("sha", "salt"), F.lit(buckets))), buckets


def distinct_index(dealt: DataFrame) -> DataFrame:
    """sha, salts, n, width, low and high of each distinct text: its token ends as an Elias-Fano list, worked out once.

    Texts of one digest are compared; different ones end the job.
    """

    def index(group: pa.Table) -> pa.Table:
        rows: dict[bytes, tuple] = {}
        known: dict[bytes, str] = {}
        for batch in group.to_batches():
            for sha, text, salts, salt in zip(*(batch.column(c).to_pylist() for c in ("sha", "text", "salts", "salt"))):
                if known.setdefault(sha, text) != text:
                    raise ValueError(f"two texts have the digest {sha.hex()}")
                if salt == 0 and sha not in rows:
                    ends = boundaries(text)
                    rows[sha] = (salts, len(ends), *encode(ends))
        give_back()
        kinds = [pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        columns = [list(rows), *zip(*rows.values())] if rows else [[]] * 6
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["sha", "salts", "n", "width", "low", "high"])

    return dealt.groupBy("bucket").applyInArrow(index, _LIST)


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 42, rate: int = 50, suffix_first: int = 80, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """key, n, form, prefix_chars, middle_chars and output of every document.

    ``rate`` of 100 documents are cut, ``suffix_first`` of 100 of these start with their suffix (spm), the others
    with their prefix (psm).  Texts that hold a mark stay plain.
    """
    dealt, buckets = _dealt(docs, key, text, seed)
    lists = distinct_index(dealt).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
    lists = lists.withColumn("bucket", F.pmod(F.xxhash64("sha", "salt"), F.lit(buckets)))
    p, s, m = marks

    def cut(group: pa.Table, index: pa.Table) -> pa.Table:
        found = {sha: EliasFano(*row) for sha, *row in zip(*(index.column(c).to_pylist() for c in ("sha", "n", "width", "low", "high")))}
        out: list[tuple] = []
        for batch in group.to_batches():
            for sha, t, h1, h2, h3, h4 in zip(*(batch.column(c).to_pylist() for c in ("sha", "text", "h1", "h2", "h3", "h4"))):
                if sha not in found:  # by chance no copy of a shared text drew salt 0
                    ends = boundaries(t)
                    found[sha] = EliasFano(len(ends), *encode(ends))
                ends = found[sha]
                if not t or h3 % 100 >= rate or p in t or s in t or m in t:
                    out.append((ends.n, "plain", None, None, t))
                    continue
                a, b = sorted((h1 % (ends.n + 1), h2 % (ends.n + 1)))
                a, b = (ends.select(k - 1) if k else 0 for k in (a, b))
                prefix, middle, suffix = t[:a], t[a:b], t[b:]
                if h4 % 100 < suffix_first:
                    out.append((ends.n, "spm", a, b - a, f"{s}{suffix}{p}{prefix}{m}{middle}"))
                else:
                    out.append((ends.n, "psm", a, b - a, f"{p}{prefix}{s}{suffix}{m}{middle}"))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        columns = zip(*out) if out else [[]] * 5
        done = pa.table([group.column("key"), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=[key, "n", "form", "prefix_chars", "middle_chars", "output"])
        give_back()
        return done

    return dealt.groupBy("bucket").cogroup(lists.groupBy("bucket")).applyInArrow(cut, f"`{key}` {docs.schema[key].dataType.simpleString()}, {_OUT}")


def restored(output: str = "output", form: str = "form", marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that was cut, from an output and its form."""
    p, s, m = marks
    middle, head = F.substring_index(output, m, -1), F.substring_index(output, m, 1)
    second, first = F.when(F.col(form) == "psm", s).otherwise(p), F.when(F.col(form) == "psm", len(p)).otherwise(len(s))
    at = F.call_function("locate", second, head)
    one, two = F.substr(head, first + 1, at - first - 1), F.substr(head, at + F.length(second), F.length(head))
    prefix, suffix = F.when(F.col(form) == "psm", one).otherwise(two), F.when(F.col(form) == "psm", two).otherwise(one)
    return F.when(F.col(form) == "plain", F.col(output)).otherwise(F.concat(prefix, middle, suffix))


def report(docs: DataFrame, **options) -> DataFrame:
    """Per document: n, form, the lengths of prefix and middle, and digests of output and restored text."""
    out = fill_in_middle(docs, **options)
    return out.select(options.get("key", "doc_id"), "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))


def brute_force(docs, seed: int = 42):
    """Straight from the definition, for tests: rows of (doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256)."""
    out = []
    for doc, text in docs:
        text = text or ""
        tokens = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
        digest = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
        h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
        a, b = sorted(x % (len(tokens) + 1) for x in h[:2])
        prefix, middle, suffix = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
        form = "plain" if not text or any(x in text for x in MARKS) or h[2] % 100 >= 50 else "spm" if h[3] % 100 < 80 else "psm"
        made = {"plain": text, "psm": f"<P>{prefix}<S>{suffix}<M>{middle}", "spm": f"<S>{suffix}<P>{prefix}<M>{middle}"}[form]
        lengths = (None, None) if form == "plain" else (len(prefix), len(middle))
        out.append((doc, len(tokens), form, *lengths, hashlib.sha256(made.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    return out


ORACLE = r"""
with cut as (
  select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as w,
    sha256('42:' || coalesce(cast(doc_id as varchar), '')) as d from documents),
drawn as (
  select doc_id, t, w, len(w) as n, ('0x' || d[1:8])::bigint % (len(w) + 1) as a, ('0x' || d[9:16])::bigint % (len(w) + 1) as b,
    ('0x' || d[17:24])::bigint % 100 as r, ('0x' || d[25:32])::bigint % 100 as s from cut),
parts as (
  select doc_id, t, n, array_to_string(w[1:least(a, b)], '') as p, array_to_string(w[least(a, b) + 1:greatest(a, b)], '') as m, array_to_string(w[greatest(a, b) + 1:n], '') as e,
    case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or r >= 50 then 'plain' when s < 80 then 'spm' else 'psm' end as form from drawn)
select doc_id, n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || e || '<M>' || m else '<S>' || e || '<P>' || p || '<M>' || m end) as output_sha256, sha256(t) as restored_sha256
from parts
"""


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))
