"""SimHash fingerprints and exact links within a Hamming radius by bit-sliced comparison.

A fingerprint has bit i where over half of the XXH64 hashes of the text's 4-word shingles have it. For the search, the 64
bits are cut into six blocks: two fingerprints that differ in four bits or fewer agree in two blocks at least, so every
pair of linked fingerprints meets under one of the 15 pairs of blocks. Distinct fingerprints alone are dealt out by these
keys and sorted; a run of one key is compared with its bits stored as planes (word w of plane i holds bit i of 64
fingerprints): each plane adds one bit to 64 distances at once through carry-save counters, and a block of 64 is given up
as soon as all of its distances exceed the radius. A run that is longer than ``run`` is cut into chunks, and each pair of
chunks is a run of its own, so no task holds a large group. A run gives no pairs: only one edge from each member to the
smallest member that it reaches. The components of these edges are found by joins.

Defined results: null or empty texts and texts without words have fingerprint zero, linked like any other; the component
of a document is the smallest doc_id that it reaches; a null doc_id never is a component's name, unless all are null;
repeated rows link with themselves; other columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymill.llm.common import LOWER_AZ, staged, with_columns_free
from waymill.llm.graph import connected_components

RADIUS = 4
#: First bit and width of each block of a fingerprint.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
PAIRS = tuple(combinations(range(len(BLOCKS)), 2))


def shingle_hashes(text: str | None, width: int = 4) -> np.ndarray:
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER_AZ).split()
    if not words:
        return np.empty(0, np.uint64)
    whole, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([h(whole, 42)], np.uint64)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    return np.fromiter((h(whole[a : b - 1], 42) for a, b in zip(starts, starts[width:], strict=False)), np.uint64, len(words) - width + 1)


def fingerprint(text: str | None, width: int = 4, part: int = 65_536) -> int:
    h = shingle_hashes(text, width)
    if not len(h):
        return 0
    ones = sum(np.unpackbits(h[i : i + part].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64) for i in range(0, len(h), part))
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def _fingerprints(batches):
    for b in batches:
        at = b.schema.names.index("_text")
        fp = np.fromiter((fingerprint(t.as_py()) for t in b.column(at)), np.uint64, b.num_rows)
        yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns) if i != at), pa.array(fp.view(np.int64))], names=[*(n for n in b.schema.names if n != "_text"), "fp"])


def with_fingerprint(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns to keep, and fp (the fingerprint's 64 bits as a long)."""
    own = docs.select(*keep, F.col(text_col).cast("string").alias("_text"))
    return own.mapInArrow(_fingerprints, own.drop("_text").withColumn("fp", F.lit(0).cast("long")).schema)


def block_keys(fp):
    """The keys of a fingerprint under the 15 pairs of blocks, the pair's number in the highest bits."""
    part = [F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << n) - 1).cast("long")) for lo, n in BLOCKS]
    return F.array(*[F.lit(k).cast("long") * F.lit(1 << 22) + part[i] * F.lit(1 << 11) + part[j] for k, (i, j) in enumerate(PAIRS)])


def planes_of(fp: np.ndarray) -> np.ndarray:
    """Word w of plane i: bit i of the fingerprints 64 w to 64 w + 63."""
    lanes = np.zeros(-(-len(fp) // 64) * 64, np.uint64)
    lanes[: len(fp)] = fp
    bits = np.unpackbits(lanes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")).view("<u8")


def near_lanes(planes: np.ndarray, fp: np.ndarray, query: np.ndarray, word: np.ndarray, valid: np.ndarray, radius: int = RADIUS):
    """For each (query, word): the lanes among the valid ones that are within the radius, as one word; gives back those left.

    Three counter planes and a sticky one hold min(distance, 8) of 64 lanes; they start at 7 - radius, so that the sticky
    plane is set as soon as a distance exceeds the radius.
    """
    full = np.uint64(2**64 - 1)
    start = 7 - radius
    c0, c1, c2 = (np.full(len(query), full if start >> i & 1 else 0, np.uint64) for i in range(3))
    over = ~valid
    for i in range(64):
        d = planes[i, word] ^ (np.uint64(0) - (fp[query] >> np.uint64(i) & np.uint64(1)))
        c0, d = c0 ^ d, c0 & d
        c1, d = c1 ^ d, c1 & d
        c2, d = c2 ^ d, c2 & d
        over |= d
        if i % 8 == 7:
            live = over != full
            if not live.any():
                return query[:0], word[:0], over[:0]
            if live.mean() < 0.8:
                query, word, over, c0, c1, c2 = (x[live] for x in (query, word, over, c0, c1, c2))
    live = over != full
    return query[live], word[live], ~over[live]


def link_runs(run: np.ndarray, fp: np.ndarray, radius: int = RADIUS, at_once: int = 1 << 17) -> np.ndarray:
    """run: the number of each row's run, ascending. The least row that each row reaches through links inside its run."""
    n = len(fp)
    label = np.arange(n)
    ends = np.searchsorted(run, run, side="right")
    first = np.flatnonzero(ends - np.arange(n) > 1)  # rows with a later row in their run
    if not len(first):
        return label
    planes = planes_of(fp)
    word0, words = (first + 1) // 64, (ends[first] - 1) // 64 - (first + 1) // 64 + 1
    upto = np.cumsum(words)
    cut = 0
    while cut < len(first):
        stop = max(cut + 1, int(np.searchsorted(upto, (upto[cut - 1] if cut else 0) + at_once, side="right")))
        w = words[cut:stop]
        query = np.repeat(first[cut:stop], w)
        word = np.repeat(word0[cut:stop] - np.concatenate(([0], np.cumsum(w)[:-1])), w) + np.arange(w.sum())
        lo, hi = np.maximum(query + 1 - 64 * word, 0), np.minimum(ends[query] - 64 * word, 64)
        ones = lambda k: np.where(k >= 64, np.uint64(2**64 - 1), (np.uint64(1) << np.minimum(k, 63).astype(np.uint64)) - np.uint64(1))
        q, w, near = near_lanes(planes, fp, query, word, ones(hi) & ~ones(lo), radius)
        for k in range(0, len(q), 1 << 15):
            bits = np.unpackbits(near[k : k + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            row, lane = np.nonzero(bits)
            label = merged(label, q[k : k + (1 << 15)][row], 64 * w[k : k + (1 << 15)][row] + lane)
        cut = stop
    return label


def merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining the classes of a and b; a label is the least row of its class."""
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return label
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while (label[label] != label).any():
            label = label[label]


def _edges(radius: int, at_once: int = 1 << 17):
    """Sorted rows come in short batches: gathers about at_once of them, and keeps back the last run, which may go on."""

    def run(batches):
        held, rows = [], 0
        for b in batches:
            held.append([b.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
            rows += b.num_rows
            if rows < at_once:
                continue
            cols = [np.concatenate(c) for c in zip(*held, strict=True)]
            new = np.concatenate(([True], (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])))
            whole = int(np.flatnonzero(new)[-1])
            yield edges_of([c[:whole] for c in cols], radius)
            held, rows = [[c[whole:] for c in cols]], len(cols[0]) - whole
        if rows:
            yield edges_of([np.concatenate(c) for c in zip(*held, strict=True)], radius)

    return run


def edges_of(cols: list[np.ndarray], radius: int) -> pa.RecordBatch:
    key, part, fp = cols
    new = np.concatenate(([True], (key[1:] != key[:-1]) | (part[1:] != part[:-1]))) if len(key) else np.empty(0, bool)
    label = link_runs(np.cumsum(new), fp.view(np.uint64), radius) if len(key) else np.empty(0, np.int64)
    at = np.flatnonzero(label != np.arange(len(label)))
    return pa.record_batch([pa.array(fp[at]), pa.array(fp[label[at]])], names=["a", "b"])


def link_fingerprints(fps: DataFrame, radius: int = RADIUS, run: int = 2048) -> DataFrame:
    """(a, b): edges between distinct fingerprints (column fp) whose components are those of all links."""
    keyed = staged(fps.select("fp", F.explode(block_keys(F.col("fp"))).alias("key")), "fpkeys")
    sizes = keyed.groupBy("key").count().filter("count > 1")
    parts = F.ceil(F.col("count") / F.lit(run)).cast("int")
    dealt = keyed.join(sizes, "key").withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    other = F.explode(F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.withColumn("other", other).select("key", (F.least("own", "other").cast("long") * F.col("parts") + F.greatest("own", "other")).alias("part"), "fp")
    return dealt.repartition("key", "part").sortWithinPartitions("key", "part", "fp").mapInArrow(_edges(radius), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(id_col, fp, component_id): every row of docs with its fingerprint and the smallest id that it reaches."""
    own = staged(with_fingerprint(docs, [id_col], text_col), "simhash")
    fps = staged(own.groupBy("fp").agg(F.min(id_col).alias("least")), "fps")
    roots = connected_components(link_fingerprints(fps, radius))
    named = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return own.join(named.select("fp", "root").join(least, "root").select("fp", "component_id"), "fp").select(id_col, "fp", "component_id")


def query(docs: DataFrame) -> DataFrame:
    return near_duplicates(with_columns_free(docs, "fp", "component_id")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
