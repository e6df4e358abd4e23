"""Near copies of the pipeline: SimHash links, and every pair of texts whose 5-word shingles have a Jaccard similarity of 0.8 or more.

The fingerprints of op10 (4-word shingles, 4 bits) find copies with very few changes only. The search for the others is
complete: two sets with similarity t share at least t of the larger one, so if the shingles of all sets stand in one
order, the first n - ceil(t n) + 3 of each set of n have three in common (sets of fewer than four are equal or not similar).
The order puts frequent shingles last, by their exact counts over all texts; any order gives the same links, this one makes few
candidates. Sets that meet under three shingles, or under one at which more than ``pair_rows`` meet, are compared by size and by bitmaps: bit i says whether the set has an odd number of hashes that are i modulo the bitmap's size, so two
bitmaps differ in no more bits than the sets do in elements, and none of the pairs sought is refused. Bitmaps have at least
twice as many bits as the set has elements (``BITS`` times a power of two); of two sizes the larger is folded, half on half.
The pairs that pass are
chained; the sets of each component of these chains are compared exactly, those of a large component in chunks,
each pair of chunks on its own. Shingles under which very many sets meet are dealt out in pairs of chunks too.

Defined results: texts without words are linked by their fingerprint (zero); texts of up to five words are one shingle; a
64-bit hash stands for a shingle, and one for a set; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymill.llm.common import drop_one, staged
from waymill.llm.graph import connected_components
from waymill.llm.simhash import fingerprint, link_fingerprints, merged, shingle_hashes

WIDTH = 5
BITS = 1024
#: Shingles of their prefixes that two similar sets share at least.
MEET = 3
#: Ranges of hashes (a power of two) by which shingles are dealt out to be counted.
BUCKETS = 4096


def shingle_set(text: str | None) -> np.ndarray:
    return np.unique(shingle_hashes(text, WIDTH))


def bitmap(s: np.ndarray) -> bytes:
    size = BITS << max(0, (2 * len(s) - 1).bit_length() - BITS.bit_length() + 1)
    return np.packbits((np.bincount((s % np.uint64(size)).astype(np.int64), minlength=size) & 1).astype(np.uint8)).tobytes()


class Bitmaps:
    """Bitmaps of rows, by their sizes; each also folded to the next smaller size."""

    def __init__(self, bits: list[bytes]):
        self.size = np.array([len(b) for b in bits])
        self.at, self.own, self.half = np.zeros(len(bits), np.int64), {}, {}
        for size in np.unique(self.size).tolist():
            rows = np.flatnonzero(self.size == size)
            self.at[rows] = np.arange(len(rows))
            words = np.frombuffer(b"".join(bits[i] for i in rows), np.uint64).reshape(len(rows), -1)
            self.own[size] = words
            self.half[size // 2] = words[:, : words.shape[1] // 2] ^ words[:, words.shape[1] // 2 :]

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """In how many bits a and b (rows) differ; b's bitmaps have the size of a's or twice that."""
        out = np.zeros(len(a), np.int64)
        for size in np.unique(self.size[a]).tolist():
            for other, words in ((size, self.own), (2 * size, self.half)):
                some = np.flatnonzero((self.size[a] == size) & (self.size[b] == other))
                for k in range(0, len(some), step := max(1, (1 << 21) // size)):
                    part = some[k : k + step]
                    out[part] = np.bitwise_count(self.own[size][self.at[a[part]]] ^ words[size][self.at[b[part]]]).sum(1, dtype=np.int64)
        return out


def set_id(s: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(s.tobytes(), 42)).view(np.int64))


def prefix(s: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The shingles under which a set has to be looked for: the rarest n - ceil(0.8 n) + MEET, ties by hash."""
    if not len(s):
        return s
    n = min(len(s), len(s) + (-4 * len(s)) // 5 + MEET)
    if not len(common):
        return s[:n]
    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
    return s[np.lexsort((s, np.where(common[at] == s, counts[at], 0)))[:n]]


def _hashes(at_once: int):
    """(bucket, hashes, times): the shingles of some texts by the highest bits of their hashes, and how many of the texts hold each."""

    def dealt(held):
        h, n = np.unique(np.concatenate(held), return_counts=True)
        edges = np.searchsorted(h, np.arange(BUCKETS, dtype=np.uint64) << np.uint64(64 - BUCKETS.bit_length() + 1))
        some = np.flatnonzero(np.diff(edges, append=len(h)))
        cut = lambda x, size: pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer((size * np.append(edges[some], len(h))).astype(np.int32)), pa.py_buffer(x)])
        return pa.record_batch([pa.array(some.astype(np.int32)), cut(h, 8), cut(n.astype(np.int32), 4)], names=["bucket", "hashes", "times"])

    def run(batches):
        held, size = [], 0
        for b in batches:
            for t in b.column(0).to_pylist():
                held.append(shingle_set(t))
                size += len(held[-1])
                if size >= at_once:
                    yield dealt(held)
                    held, size = [], 0
        if size:
            yield dealt(held)

    return run


def _counts(batches):
    """(h, n): the hashes that three texts or more hold. Rows come sorted by bucket; one may go on in the next batch."""

    def counted(held):
        h, at = np.unique(np.frombuffer(b"".join(x for x, _ in held), np.uint64), return_inverse=True)
        n = np.bincount(at, np.frombuffer(b"".join(x for _, x in held), np.int32)).astype(np.int64)  # in doubles, exact below 2^53
        often = n > 2
        return pa.record_batch([pa.array(h[often].view(np.int64)), pa.array(n[often])], names=["h", "n"])

    bucket, held = None, []
    for b in batches:
        for k, *x in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            if k != bucket and held:
                yield counted(held)
                held = []
            bucket = k
            held.append(x)
    if held:
        yield counted(held)


def common_shingles(docs: DataFrame, text_col: str, most: int, at_once: int = 1_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, and counts of the shingles that the most texts hold, counted over all texts.

    All from the least count (3 or more) on that at most ``most`` shingles reach; the others count as rare.
    """
    texts = docs.select(F.col(text_col).cast("string"))
    dealt = texts.mapInArrow(_hashes(at_once), "bucket int, hashes binary, times binary").repartition("bucket").sortWithinPartitions("bucket")
    counts = staged(dealt.mapInArrow(_counts, "h long, n long"), "shinglecounts")
    least, so_far = None, 0
    for r in counts.groupBy("n").count().orderBy(F.desc("n")).limit(most).toLocalIterator():
        so_far += r["count"]
        if so_far > most:
            break
        least = r["n"]
    rows = counts.filter(F.col("n") >= least if least else F.lit(False)).toArrow()
    drop_one(counts)
    h, n = rows.column(0).to_numpy().view(np.uint64), rows.column(1).to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def _described(shared):
    def run(batches):
        common, counts = shared.value
        for b in batches:
            at = b.schema.names.index("_text")
            texts = b.column(at).to_pylist()
            sets = [shingle_set(t) for t in texts]
            keep = [i for i in range(b.num_columns) if i != at]
            new = [
                pa.array([int(np.uint64(fingerprint(t)).view(np.int64)) for t in texts], pa.int64()),
                pa.array([set_id(s) for s in sets], pa.int64()),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([prefix(s, common, counts).view(np.int64) for s in sets], pa.list_(pa.int64())),
                pa.array([bitmap(s) for s in sets], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), *new], names=[*(b.schema.names[i] for i in keep), "fp", "set", "n", "keys", "bits"])

    return run


def alike(run: np.ndarray, n: np.ndarray, bits: list[bytes]) -> np.ndarray:
    """The least row that each row reaches inside its run by pairs that may be similar. Rows are sorted by run and n."""
    label, maps = np.arange(len(run)), Bitmaps(bits)
    left, gap = label, 0
    while True:
        gap += 1
        left = left[left < len(run) - gap]
        # sizes ascend in a run: a row for which the next one is too large has no partner beyond
        left = left[(run[left + gap] == run[left]) & (5 * n[left] >= 4 * n[left + gap])]
        if not len(left):
            return label
        a = left[label[left] != label[left + gap]]
        near = a[9 * maps.apart(a, a + gap) <= n[a] + n[a + gap]]  # what only one has is a ninth of both or less
        if len(near):
            label = merged(label, near, near + gap)


def _chains(at_once: int = 1 << 15):
    """Rows (key, part, n, set, bits) come sorted; a run may go on in the next batch."""

    def edges(cols, bits):
        key, part, n, sets = cols
        run = np.cumsum(np.concatenate(([True], (key[1:] != key[:-1]) | (part[1:] != part[:-1]))))
        label = alike(run, n, bits)
        at = np.flatnonzero(label != np.arange(len(label)))
        return pa.record_batch([pa.array(sets[at]), pa.array(sets[label[at]])], names=["a", "b"])

    def run(batches):
        held, bits = [], []
        for b in batches:
            held.append([b.column(i).to_numpy(zero_copy_only=False) for i in range(4)])
            bits += b.column(4).to_pylist()
            if len(bits) < at_once:
                continue
            cols = [np.concatenate(c) for c in zip(*held, strict=True)]
            new = np.concatenate(([True], (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])))
            whole = int(np.flatnonzero(new)[-1])
            if whole:
                yield edges([c[:whole] for c in cols], bits[:whole])
            held, bits = [[c[whole:] for c in cols]], bits[whole:]
        if bits:
            yield edges([np.concatenate(c) for c in zip(*held, strict=True)], bits)

    return run


def in_pairs_of_chunks(df: DataFrame, member: str) -> DataFrame:
    """df (with the number of chunks in parts) with part: a row stands once in each pair of chunks of its group that holds its own."""
    df = df.withColumn("own", F.pmod(F.xxhash64(member), F.col("parts")).cast("int"))
    df = df.withColumn("other", F.explode(F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), (F.col("parts") - 1).cast("int")))))
    return df.withColumn("part", F.least("own", "other").cast("long") * F.col("parts") + F.greatest("own", "other")).drop("own", "other", "parts")


def similar(sets: list[np.ndarray]) -> np.ndarray:
    """The least set that each one reaches by links of similarity 0.8 or more."""
    m, size = len(sets), np.array([len(s) for s in sets])
    label = np.arange(m)
    ends = np.cumsum(size)
    inverse = np.unique(np.concatenate(sets), return_inverse=True)[1]
    held = np.repeat(np.arange(m), size)[np.argsort(inverse, kind="stable")]
    counts = np.bincount(inverse)
    first = np.cumsum(counts) - counts
    for i in range(m - 1):
        if (label[i + 1 :] == label[i]).all():
            continue
        own = inverse[ends[i] - size[i] : ends[i]]
        n = counts[own]
        both = np.bincount(held[np.repeat(first[own] - np.cumsum(n) + n, n) + np.arange(n.sum())], minlength=m)
        near = np.flatnonzero(9 * both >= 4 * (size + size[i]))  # both / (a + b - both) >= 4 / 5
        label = merged(label, np.full(len(near), i), near)
    return label


def _compared(batches):
    """Rows come sorted by group; a group's rows may go on in the next batch."""

    def edges(rows):
        label = similar([s for _, s in rows]) if len(rows) > 1 else np.zeros(len(rows), np.int64)
        at = np.flatnonzero(label != np.arange(len(label)))
        return pa.record_batch([pa.array([rows[i][0] for i in at], pa.int64()), pa.array([rows[label[i]][0] for i in at], pa.int64())], names=["a", "b"])

    group, rows = None, []
    for b in batches:
        for root, part, own, s in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            if (root, part) != group:
                if rows:
                    yield edges(rows)
                group, rows = (root, part), []
            rows.append((own, np.frombuffer(s, np.uint64)))
    if rows:
        yield edges(rows)


def _sets(batches):
    for b in batches:
        sets = [shingle_set(t) for t in b.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3)), pa.array([s.tobytes() for s in sets], pa.binary())], names=["root", "set", "parts", "shingles"])


def _close(batches):
    """Of pairs (a, b, na, nb, x, y), na <= nb, those whose bitmaps x and y leave open that they are similar."""
    for b in batches:
        n = b.num_rows
        na, nb = (b.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
        apart = Bitmaps([*b.column(4).to_pylist(), *b.column(5).to_pylist()]).apart(np.arange(n), np.arange(n, 2 * n))
        keep = pa.array(np.flatnonzero(9 * apart <= na + nb))
        yield pa.RecordBatch.from_arrays([b.column(0).take(keep), b.column(1).take(keep)], names=["a", "b"])


def chains(own: DataFrame, pair_rows: int, run_rows: int) -> DataFrame:
    """(a, b): pairs of sets that may be similar, as many as chain together all such pairs."""
    sets = own.filter(f"n > {MEET}")
    distinct = sets.groupBy("set").agg(F.first("n").alias("n"), F.first("keys").alias("keys"))
    bits = sets.groupBy("set").agg(F.first("bits").alias("bits"))
    w = Window.partitionBy("key")
    order = w.orderBy("n", "set")
    keyed = distinct.select("set", "n", F.explode("keys").alias("key"))
    keyed = keyed.withColumns({"before": F.lag("n").over(order), "after": F.lead("n").over(order), "met": F.count("*").over(w)})
    keyed = staged(keyed.filter("5 * before >= 4 * n or 5 * n >= 4 * after").select("key", "n", "set", "met"), "keyed")
    # shingles with few sets: the pairs that their sizes allow, and that meet often enough
    some = keyed.filter(F.col("met") <= pair_rows).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("n", "set"))).alias("m"))
    later = lambda x, i: F.filter(F.slice("m", i + 2, pair_rows), lambda y: 5 * x["n"] >= 4 * y["n"])
    pair = lambda x, y: F.struct(x["set"].alias("a"), y["set"].alias("b"), x["n"].alias("na"), y["n"].alias("nb"))
    each = F.flatten(F.transform("m", lambda x, i: F.transform(later(x, i), lambda y: pair(x, y))))
    pairs = some.select(F.explode(each).alias("p")).select("p.*")
    pairs = pairs.groupBy("a", "b", "na", "nb").count().filter(F.col("count") >= MEET).drop("count")
    side = lambda k, c: bits.select(F.col("set").alias(k), F.col("bits").alias(c))
    close = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "na", "nb", "x", "y").mapInArrow(_close, "a long, b long")
    # shingles with many: compared where they meet
    many = keyed.filter(F.col("met") > pair_rows).withColumn("parts", F.ceil(F.col("met") / F.lit(run_rows)))
    dealt = in_pairs_of_chunks(many.join(bits, "set"), "set").select("key", "part", "n", "set", "bits")
    return close.union(dealt.repartition("key", "part").sortWithinPartitions("key", "part", "n", "set").mapInArrow(_chains(), "a long, b long")).distinct()


def link_sets(docs: DataFrame, own: DataFrame, text_col: str, pair_rows: int, run_rows: int, chunk_rows: int, chunk_shingles: int, most_broadcast: int) -> DataFrame:
    """(a, b): links between distinct sets of own (set, n, keys, bits, text_hash) whose components are those of all pairs of similarity 0.8."""
    roots = connected_components(chains(own, pair_rows, run_rows)).withColumnRenamed("node", "set")
    # one text of each set; those that stand once need no shuffle before their shingles are dealt out
    known = own.filter("n > 0").groupBy("set", "text_hash").agg(F.count("*").alias("rows"), F.first("n").alias("n"))
    known = known.groupBy("set").agg(F.min(F.struct("text_hash", "rows")).alias("one"), F.first("n").alias("n")).select("set", "n", "one.*")
    met = staged(known.join(roots, "set"), "met")
    parts = F.ceil(F.greatest(F.count("*") / F.lit(chunk_rows), F.sum("n") / F.lit(chunk_shingles))).cast("int")
    wanted = staged(met.join(met.groupBy("root").agg(parts.alias("parts")), "root").select("root", "set", "parts", "text_hash", "rows"), "candidates")
    few = wanted.count() <= most_broadcast
    text = F.col(text_col).cast("string")
    texts = docs.select(text.alias("text"), F.xxhash64(text).alias("text_hash")).join(F.broadcast(wanted) if few else wanted, "text_hash")
    once = texts.filter("rows > 1").groupBy("root", "set", "parts").agg(F.first("text").alias("text"))
    once = once.union(texts.filter("rows = 1").select("root", "set", "parts", "text"))
    sets = once.mapInArrow(_sets, "root long, set long, parts int, shingles binary")
    dealt = in_pairs_of_chunks(sets, "set").select("root", "part", "set", "shingles")
    return dealt.repartition("root", "part").sortWithinPartitions("root", "part", "set").mapInArrow(_compared, "a long, b long").distinct()


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int | None = None, most_common: int = 500_000, pair_rows: int = 64, run_rows: int = 4096, chunk_rows: int = 2048, chunk_shingles: int = 1_000_000, most_broadcast: int = 200_000) -> DataFrame:
    """(id_col, text_hash, component): every row of docs with its group; rows of one group are linked by steps.

    sample_rows: without effect; shingles are counted over all rows.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(common_shingles(docs, text_col, most_common))
    text = F.col(text_col).cast("string")
    src = docs.select(id_col, F.xxhash64(text).alias("text_hash"), text.alias("_text"))
    schema = src.drop("_text").withColumns({c: F.lit(0).cast("long") for c in ("fp", "set", "n")} | {"keys": F.array(F.lit(0).cast("long")), "bits": F.lit(b"")}).schema
    own = staged(src.mapInArrow(_described(shared), schema), "near")
    fps = staged(own.select("fp").distinct(), "fps")
    roots = connected_components(link_fingerprints(fps)).withColumnRenamed("node", "fp")
    pairs = own.select("fp", "set").distinct().join(roots, "fp", "left").select("fp", "set", F.coalesce("root", "fp").alias("root"))
    pairs = staged(pairs, "pairs")
    least = pairs.groupBy("set").agg(F.min("root").alias("least"))
    links = link_sets(docs, own, text_col, pair_rows, run_rows, chunk_rows, chunk_shingles, most_broadcast)
    of = lambda c: least.select(F.col("set").alias(c), F.col("least").alias(f"root_{c}"))
    edges = pairs.join(least, "set").filter("root <> least").select("root", "least").union(links.join(of("a"), "a").join(of("b"), "b").select("root_a", "root_b"))
    above = connected_components(edges, "root", "least").select(F.col("node").alias("root"), F.col("root").alias("component"))
    named = pairs.join(above, "root", "left").select("fp", "set", F.coalesce("component", "root").alias("component"))
    # a fingerprint lies in one component: its sets all stand under its own root
    return own.join(named.groupBy("fp").agg(F.min("component").alias("component")), "fp").select(id_col, "text_hash", "component")
