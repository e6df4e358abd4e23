"""Line deduplication by sharded minimal perfect hashes.

Every document is cut at \\n. A line's key is the line stripped of ASCII white space and with A-Z lower-cased; keys
shorter than ``min_chars`` code points never count as repeated. The distinct keys (two 64-bit hashes, 128 bits in all) are
dealt to shards; each shard holds a minimal perfect hash over its keys and, in its order, compact arrays of fingerprints
(the second hash), document counts and owners (the smallest doc_id with the line). The lines of the documents, as
16 bytes of hash each and never as text, are dealt to the shard that holds their key and probe its arrays; a line goes
when its owner is a smaller doc_id. Shards that a frequent line makes hot are probed by several tasks, each with a copy
of the shard's arrays.

Defined results: a null or empty text is one empty line and stays as it is; lines within the owner itself all stay; a
null doc_id is later than every other, and documents without an id keep the lines that only they hold; repeated rows
with one doc_id are one document; an empty table gives an empty result; columns with the names of the new ones are replaced,
others pass through. Ids are whole numbers; a column of another type is refused.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymill.llm.common import LOWER_AZ, sha256_of, staged, whole_numbers, with_columns_free

WHITE = b" \t\n\x0b\x0c\r"
NO_ID = -(2**63)
NEW = ("kept_text", "n_lines", "n_dropped")


def keys_of(text: str, min_chars: int) -> list[tuple[int, bytes]]:
    """(line number, key) of the lines whose key has min_chars code points at least."""
    out = []
    for i, line in enumerate(text.encode("utf-8", "surrogatepass").translate(LOWER_AZ).split(b"\n")):
        key = line.strip(WHITE)
        if len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars):
            out.append((i, key))
    return out


def _hashed_lines(min_chars: int):
    def run(batches):
        for b in batches:
            ids, rows, lines, hashes, prints, firsts = [], [], [], [], [], []
            for doc, row, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                seen = set()
                for i, key in keys_of(text or "", min_chars):
                    h = xxhash.xxh64_intdigest(key, seed=7)
                    ids.append(doc)
                    rows.append(row)
                    lines.append(i)
                    hashes.append(h - (h >> 63 << 64))
                    f = xxhash.xxh64_intdigest(key, seed=11)
                    prints.append(f - (f >> 63 << 64))
                    firsts.append(0 if (h, f) in seen else 1)
                    seen.add((h, f))
            yield pa.record_batch(
                [pa.array(ids, pa.int64()), pa.array(rows, pa.int64()), pa.array(lines, pa.int32()), pa.array(hashes, pa.int64()), pa.array(prints, pa.int64()), pa.array(firsts, pa.int32())],
                names=["id", "row", "line", "h", "f", "first"],
            )

    return run


def mix(h: np.ndarray, level: int) -> np.ndarray:
    """A different even hash of the key for each level."""
    x = h ^ np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slot(h: np.ndarray, f: np.ndarray, level: int, size: int) -> np.ndarray:
    return ((mix(h, 2 * level) ^ mix(f, 2 * level + 1)) % np.uint64(size)).astype(np.int64)


def build_mph(h: np.ndarray, f: np.ndarray, gamma: float = 2.0) -> list[np.ndarray]:
    """Bit arrays by level: a key (h, f) belongs to the first level at which no other key left shares its slot."""
    levels = []
    while len(h):
        size = max(2, int(gamma * len(h)))
        at = slot(h, f, len(levels), size)
        bits = np.bincount(at, minlength=size) == 1
        levels.append(bits)
        h, f = h[~bits[at]], f[~bits[at]]
    return levels


def rank_mph(levels: list[np.ndarray], h: np.ndarray, f: np.ndarray) -> np.ndarray:
    """The index of each key, or some index for one that was not among the keys; -1 where no level takes it."""
    out, left, base = np.full(len(h), -1, np.int64), np.arange(len(h)), 0
    for n, bits in enumerate(levels):
        at = slot(h[left], f[left], n, len(bits))
        hit, below = bits[at], np.cumsum(bits)
        out[left[hit]] = base + below[at[hit]] - 1
        left, base = left[~hit], base + int(below[-1])
    return out


def _shard_arrays(pdf: pd.DataFrame) -> pd.DataFrame:
    h, f = (pdf[c].to_numpy(np.int64).view(np.uint64) for c in ("h", "f"))
    levels = build_mph(h, f)
    at = rank_mph(levels, h, f)
    arrays = {}
    for name, kind in (("f", np.int64), ("n_docs", np.int32), ("owner", np.int64)):
        own = np.empty(len(h), kind)
        own[at] = pdf[name].to_numpy(kind)
        arrays[name] = [own.tobytes()]
    return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "salts": [pdf["salts"].iloc[0]], "sizes": [[len(x) for x in levels]], "bits": [np.packbits(np.concatenate(levels)).tobytes()]} | arrays)


def _probe(shard: pd.DataFrame, lines: pd.DataFrame) -> pd.DataFrame:
    if not len(shard) or not len(lines):
        return pd.DataFrame({"id": [], "row": [], "line": []}).astype({"id": "int64", "row": "int64", "line": "int32"})
    s = shard.iloc[0]
    sizes = list(s["sizes"])
    bits = np.unpackbits(np.frombuffer(s["bits"], np.uint8), count=sum(sizes)).astype(bool)
    levels = np.split(bits, np.cumsum(sizes)[:-1])
    f, n_docs, owner = np.frombuffer(s["f"], np.int64), np.frombuffer(s["n_docs"], np.int32), np.frombuffer(s["owner"], np.int64)
    own = lines["f"].to_numpy(np.int64)
    at = rank_mph(levels, lines["h"].to_numpy(np.int64).view(np.uint64), own.view(np.uint64))
    ids = lines["id"].to_numpy(np.int64)
    gone = (at >= 0) & (f[at] == own) & (n_docs[at] > 1) & (owner[at] != NO_ID) & ((owner[at] < ids) | (ids == NO_ID))
    return lines.loc[gone, ["id", "row", "line"]]


KEPT = T.StructType([T.StructField("kept", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])


@F.pandas_udf(KEPT)
def _without(text: pd.Series, gone: pd.Series) -> pd.DataFrame:
    out = []
    for t, g in zip(text, gone, strict=True):
        lines, drop = ("" if t is None else t).split("\n"), frozenset() if g is None else frozenset(g)
        out.append(("\n".join(x for i, x in enumerate(lines) if i not in drop) if drop else "\n".join(lines), len(lines), len(drop)))
    return pd.DataFrame(out, columns=["kept", "n_lines", "n_dropped"])


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, keys_a_shard: int = 20_000, least_shards: int = 512, names: tuple[str, str, str] = NEW) -> DataFrame:
    """docs with kept_text, n_lines and n_dropped under these names; text_col is as it was."""
    docs = with_columns_free(docs, *names, "_id", "_row", "_gone", "_kept")
    whole_numbers(docs, id_col)
    ident = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    row = F.xxhash64(F.col(text_col))
    lines = staged(docs.select(ident, row, F.col(text_col).cast("string")).mapInArrow(_hashed_lines(min_chars), "id long, row long, line int, h long, f long, first int"), "lines")
    owner = F.coalesce(F.min(F.when(F.col("id") != NO_ID, F.col("id"))), F.lit(NO_ID))
    keys = staged(lines.groupBy("h", "f").agg(owner.alias("owner"), F.sum("first").cast("int").alias("n_docs"), F.count("*").alias("n")), "linekeys")
    shards = max(least_shards, 1 << (max(1, keys.count() // keys_a_shard) - 1).bit_length())
    shard = F.pmod(F.xxhash64("h"), F.lit(shards)).cast("int")
    loads = keys.groupBy(shard.alias("shard")).agg(F.sum("n").alias("load"))
    mean = loads.agg(F.avg("load")).first()[0] or 1.0
    # as many copies of a shard as it has times the usual number of probes: one row a shard
    loads = staged(loads.select("shard", F.ceil(F.col("load") / F.lit(2 * mean)).cast("int").alias("salts")), "lineloads")
    arrays = keys.withColumn("shard", shard).join(loads, "shard").groupBy("shard").applyInPandas(_shard_arrays, "shard int, salts int, sizes array<int>, bits binary, f binary, n_docs binary, owner binary")
    copies = arrays.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    probes = lines.withColumn("shard", shard).join(loads, "shard").withColumn("salt", F.pmod(F.xxhash64("id", "row", "line"), F.col("salts")).cast("int")).select("shard", "salt", "id", "row", "line", "h", "f")
    gone = copies.groupBy("shard", "salt").cogroup(probes.groupBy("shard", "salt")).applyInPandas(_probe, "id long, row long, line int")
    gone = gone.groupBy("id", "row").agg(F.collect_set("line").alias("_gone")).withColumnsRenamed({"id": "_id", "row": "_row"})
    out = docs.withColumns({"_id": ident, "_row": row}).join(gone, ["_id", "_row"], "left").withColumn("_kept", _without(F.col(text_col).cast("string"), "_gone"))
    return out.withColumns({n: F.col(f"_kept.{c}") for n, c in zip(names, ("kept", "n_lines", "n_dropped"), strict=True)}).drop("_id", "_row", "_gone", "_kept")


def query(docs: DataFrame) -> DataFrame:
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", sha256_of(F.col("kept_text")).alias("kept_sha256"))


#: The same result in DuckDB's SQL.
SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
f AS (SELECT k.doc_id, k.i, k.line, coalesce(r.owner < k.doc_id, false) AS gone FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""
