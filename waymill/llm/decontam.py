"""Benchmark decontamination by Wu-Manber multi-pattern search.

Test items are cut into windows of ``window`` consecutive words (an item with fewer words, but not none, is one window),
written with one space before and after every word. Documents are brought to the same form, so that an occurrence of a
window in the words of a document is an occurrence of its string. The search looks at the last ``block`` bytes of the
position at hand: a shift table says how far no window can end, a suffix-hash bucket lists the windows whose prefix ends
with these bytes, and a direct comparison confirms each. Windows of a few bytes have tables of their own, so that they do
not shorten the shifts of the others.

Tables are flat arrays over the items' text (offsets, no copies of windows), about nine times the text in all. They go to the
executors in blocks of at most ``block_bytes`` of test text. Each block is one pass over the texts, of which only the hits
are written (keyed by two hashes of the text); the last pass joins the hits of those before and adds its own. So a task
holds the tables of one block, and no block is left out.

Defined results: a null text has no words; null or wordless items have no windows; items with one item_id count as one
item; repeated documents are each searched; an empty benchmark leaves all documents clean; an empty table stays empty;
columns with the names of the new ones are replaced, others pass through.
"""

from __future__ import annotations

import hashlib
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymill.llm.common import WORDS_AZ, staged, with_columns_free


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(WORDS_AZ).split()


def prime_from(n: int) -> int:
    n |= 1
    while any(n % d == 0 for d in range(3, int(n**0.5) + 1, 2)):
        n += 2
    return n


@dataclass
class Windows:
    """Items' words as one byte string, and where each window begins, its length in bytes and words, and the number of its item."""

    text: bytes
    items: list[str]
    at: np.ndarray
    size: np.ndarray
    words: np.ndarray
    item: np.ndarray


def windows_of(items: Iterable[tuple[str, str | None]], window: int) -> Windows:
    text, names, at, size, words, item = bytearray(), {}, [], [], [], []
    for name, t in items:
        own = words_of(t)
        if not own:
            continue
        n = min(window, len(own))
        ends = np.cumsum([0, *(len(w) + 1 for w in own)])  # of each word's space before
        first, last = ends[: len(own) - n + 1], ends[n:]
        at.append(len(text) + first)
        size.append(last - first + 1)
        words.append(np.full(len(first), n))
        item.append(np.full(len(first), names.setdefault(name, len(names))))
        text += b" " + b" ".join(own) + b" "
    flat = lambda x: np.concatenate(x).astype(np.uint32) if x else np.empty(0, np.uint32)
    return Windows(bytes(text), list(names), flat(at), flat(size), flat(words), flat(item))


class WuManber:
    """The tables for some of the windows; ``text``, ``items`` and what is known of a window are shared."""

    def __init__(self, w: Windows, own: np.ndarray, most_block: int = 7):
        size = w.size[own]
        self.least = int(size.min())
        self.block = min(most_block, self.least)
        self.far = min(255, self.least - self.block + 1)
        raw = np.frombuffer(w.text, np.uint8)
        self.prime = prime_from(max(65_536, 2 * len(raw)))
        shift = np.full(self.prime, self.far, np.uint8)
        at = w.at[own].astype(np.int64)
        for j in range(self.least - self.block + 1):  # from the longest jumps to none, so that the shortest stays
            jump = self.least - self.block - j
            if jump < self.far:
                shift[self._hashes(raw, at + j)] = jump
        last = self._hashes(raw, at + self.least - self.block)
        order = np.argsort(last, kind="stable")
        self.shift = shift.tobytes()
        # windows by the hash of the block that ends their first ``least`` bytes: a bucket is a stretch of equal keys
        self.key, self.window = array("I", last[order].astype(np.uint32).tobytes()), array("I", own[order].astype(np.uint32).tobytes())

    def _hashes(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.empty(len(at), np.uint32)
        for k in range(0, len(at), 1 << 18):
            part = at[k : k + (1 << 18)]
            h = np.zeros(len(part), np.uint64)
            for i in range(self.block):
                h |= raw[part + i].astype(np.uint64) << np.uint64(8 * i)
            out[k : k + (1 << 18)] = h % np.uint64(self.prime)
        return out

    def nbytes(self) -> int:
        return len(self.shift) + 4 * (len(self.key) + len(self.window))

    def search(self, text: bytes, windows: Tables) -> Iterator[tuple[int, int]]:
        """(start, number of the window) of all occurrences, overlapping ones too."""
        end, n, block, least, shift, prime, key = self.least, len(text), self.block, self.least, self.shift, self.prime, self.key
        number, own, at, size = int.from_bytes, windows.text, windows.at, windows.size
        while end <= n:
            h = number(text[end - block : end], "little") % prime
            if jump := shift[h]:
                end += jump
                continue
            start = end - least
            for i in range(bisect_left(key, h), len(key)):
                if key[i] != h:
                    break
                p = self.window[i]
                if text.startswith(own[at[p] : at[p] + size[p]], start):
                    yield start, p
            end += 1


class Tables:
    """What a task needs for one block of items: the windows, and tables by length (under 12, 24 and 48 bytes, and longer)."""

    def __init__(self, w: Windows):
        self.text, self.items = w.text, w.items
        self.at, self.size, self.words, self.item = (array("I", x.tobytes()) for x in (w.at, w.size, w.words, w.item))
        group = np.searchsorted([12, 24, 48], w.size, side="right")
        self.by_length = [WuManber(w, np.flatnonzero(group == g)) for g in np.unique(group)]

    def nbytes(self) -> int:
        return len(self.text) + 4 * 4 * len(self.at) + sum(t.nbytes() for t in self.by_length)


def hits_in(text: str | None, tables: Tables) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Number of words, hit stretches of word numbers (end exclusive), items."""
    words = words_of(text)
    whole = b" " + b" ".join(words) + b" "
    spans, items, starts = set(), set(), None
    for t in tables.by_length:
        for at, p in t.search(whole, tables):
            if starts is None:
                starts = [0, *accumulate(len(w) + 1 for w in words)]
            first = bisect_right(starts, at) - 1
            spans.add((first, first + tables.words[p]))
            items.add(tables.item[p])
    return len(words), sorted(spans), {tables.items[i] for i in items}


def covered(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping stretches joined."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


#: The columns that are added.
NEW = ("n_words", "n_hit", "hit_spans", "hit_items", "contaminated")
SPANS, ITEMS = pa.list_(pa.list_(pa.int32())), pa.list_(pa.string())


def _hits(tables):
    """Of texts with hits alone: key, spans and items."""

    def run(batches):
        for b in batches:
            rows = [(i, spans, items) for i, t in enumerate(b.column(2).to_pylist()) for _, spans, items in [hits_in(t, tables.value)] if spans]
            at = pa.array([r[0] for r in rows], pa.int64())
            yield pa.record_batch([b.column(0).take(at), b.column(1).take(at), pa.array([[list(x) for x in covered(s)] for _, s, _ in rows], SPANS), pa.array([sorted(x) for _, _, x in rows], ITEMS)], names=["_k1", "_k2", "_spans", "_items"])

    return run


def _scan(tables):
    """Adds what this block of items hits to what the blocks before have hit."""

    def run(batches):
        for b in batches:
            at = {n: i for i, n in enumerate(b.schema.names)}
            n_words, spans, items = [], [], []
            for text, old, had in zip(b.column(at["_text"]).to_pylist(), b.column(at["_spans"]).to_pylist(), b.column(at["_items"]).to_pylist(), strict=True):
                n, new, found = hits_in(text, tables.value)
                n_words.append(n)
                spans.append([list(x) for x in covered([(x[0], x[1]) for x in old or ()] + new)])
                items.append(sorted({*(had or ()), *found}))
            new = {"_n": pa.array(n_words, pa.int64()), "_spans": pa.array(spans, SPANS), "_items": pa.array(items, ITEMS)}
            yield pa.RecordBatch.from_arrays([new.get(n, b.column(i)) for n, i in at.items()], names=list(at))

    return run


def find_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = 10, block_bytes: int = 8 << 20, most_broadcast: int = 200_000, names: tuple[str, ...] = NEW) -> DataFrame:
    """docs with n_words, n_hit, hit_spans (of word numbers), hit_items (sorted) and contaminated, under these names."""
    spark = docs.sparkSession
    docs = with_columns_free(docs, *names, "_text", "_n", "_spans", "_items", "_k1", "_k2")
    text = F.col(text_col).cast("string")
    key = {"_k1": F.xxhash64(text), "_k2": F.xxhash64(text, F.lit(1))}
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("string").alias("text")).filter(F.length("text") > 0)
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))

    def tables(k: int):
        own = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
        return spark.sparkContext.broadcast(Tables(windows_of(((r.item, r.text) for r in own.toLocalIterator()), window)))  # a block at most, by its checked size

    found = []
    for k in range(blocks - 1):
        shared = tables(k)
        found.append(staged(docs.select(*[c.alias(n) for n, c in key.items()], text.alias("_text")).mapInArrow(_hits(shared), "_k1 long, _k2 long, _spans array<array<int>>, _items array<string>"), "hits"))
        shared.destroy()
    out = docs.withColumns({"_text": text, "_n": F.lit(0).cast("long")})
    if found:
        hits = found[0]
        for f in found[1:]:
            hits = hits.union(f)
        hits = staged(hits.groupBy("_k1", "_k2").agg(F.flatten(F.collect_set("_spans")).alias("_spans"), F.array_distinct(F.flatten(F.collect_set("_items"))).alias("_items")), "hits")
        out = out.withColumns(key).join(F.broadcast(hits) if hits.count() <= most_broadcast else hits, ["_k1", "_k2"], "left").drop("_k1", "_k2")
    else:
        out = out.withColumns({"_spans": F.array().cast("array<array<int>>"), "_items": F.array().cast("array<string>")})
    out = out.mapInArrow(_scan(tables(blocks - 1)), out.schema)
    n_hit = F.aggregate("_spans", F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])
    return out.select(*docs.columns, *[c.alias(n) for n, c in zip(names, (F.col("_n"), n_hit, F.col("_spans"), F.col("_items"), n_hit > 0), strict=True)])


def query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return find_contaminated(docs.select("doc_id", "text"), benchmark).select(
        "doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.encode(F.array_join("hit_items", ","), "UTF-8"), 256).alias("items_sha256"), "contaminated"
    )


def digest(items) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


#: The same result in DuckDB's SQL: word windows of the documents joined with those of the items.
SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bi AS (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM bw WHERE len(w) > 0),
bx AS (SELECT DISTINCT item_id, len(w[i : i + 9]) AS n, array_to_string(w[i : i + 9], ' ') AS win FROM bi),
sizes AS (SELECT DISTINCT n FROM bx),
di AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n),
dx AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS win FROM di),
hit AS (SELECT dx.doc_id, dx.i, dx.n, bx.item_id FROM dx JOIN bx ON dx.win = bx.win AND dx.n = bx.n),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""
