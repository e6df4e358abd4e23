"""Ranked lexical search by pipelined term partitioning.

The terms of the items are dealt to owners by how often they occur (``owners``: upper bounds of df / N, the rarest first).
Documents are cut into shards of about ``shard_rows`` by a hash. A bundle stands for one shard and one item: it carries the
item's terms and a sparse accumulator (documents with a score so far). Bundles go through the owners' stages one after the
other; in each, they meet the owner's postings of their shard by a cogroup and add its integer contributions. The last
stage keeps the best of each bundle, and one ranking per item over all bundles ends the search.

Rows, not ids, are documents. A stage leaves out what cannot win any more: where the accumulator of a bundle already holds
``top`` documents of score t or more, one whose score and the greatest contributions still to come stay below t cannot be
among the ``top`` of its shard, so not of all. The bound is exact (maxima over all postings), and so is the result.

The items' distinct terms go to the tasks (``most_terms`` at most at once; more are searched in blocks of items, each with a
pass of its own over the documents). No task holds more than the postings of one owner in one shard and the bundles of
``item_rows`` items; no term, document or item is a key alone, so none is hot.

Defined results: null texts have no terms; an item or corpus without terms has no row; equal items are each ranked; scores
tie by ascending doc_id, rows without an id last; repeated rows each keep their place; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymill.llm.common import WORDS_AZ, staged

UNIT = 1_000_000_000
BUNDLE = "shard long, block long, item long, terms array<int>, owners array<int>, weights array<long>, most array<long>, row array<long>, id array<long>, score array<long>"


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(WORDS_AZ).split()


def _item_terms(batches):
    """(item, term): the distinct terms of each item."""
    for b in batches:
        rows = [(i, t.decode("utf-8", "surrogatepass")) for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for t in sorted(set(terms_of(text)))]
        yield pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], names=["item", "term"])


def _forward(shared):
    """(row, id, n, terms, tf): a document's number of terms, and those of the items with their occurrences."""

    def run(batches):
        number = {t.encode("utf-8", "surrogatepass"): k for k, t in enumerate(shared.value)}
        for b in batches:
            n, terms, tf = [], [], []
            for text in b.column(2).to_pylist():
                words = terms_of(text)
                held = Counter(words)
                own = sorted((number[t], k) for t, k in held.items() if t in number)
                n.append(len(words))
                terms.append([t for t, _ in own])
                tf.append([k for _, k in own])
            yield pa.record_batch([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.int64()))], names=["row", "id", "n", "terms", "tf"])

    return run


def parts(tf, m):
    """What a term adds to a document's score, by weight: (10^9 tf) div (1000 tf + 20 m)."""
    return UNIT * tf // (1000 * tf + 20 * m)


def left_over(score: np.ndarray, top: int, rest: int) -> np.ndarray:
    """Which documents of an accumulator can still be among the top of their shard, with ``rest`` to come at most."""
    if len(score) <= top:
        return np.ones(len(score), bool)
    return score + rest >= np.partition(score, len(score) - top)[len(score) - top]


def _stage(owner: int, last: bool, top: int):
    """Adds one owner's contributions to the bundles of a shard and a block of items."""

    def run(bundles: pd.DataFrame, postings: pd.DataFrame) -> pd.DataFrame:
        if not len(bundles):
            return bundles
        rows, ids = postings["row"].to_numpy(np.int64), postings["id"].to_numpy()
        sizes = postings["terms"].map(len).to_numpy(np.int64) if len(postings) else np.empty(0, np.int64)
        many = lambda c, kind: np.concatenate(postings[c].tolist()).astype(kind) if sizes.sum() else np.empty(0, kind)
        term, tf, doc = many("terms", np.int32), many("tf", np.int64), np.repeat(np.arange(len(rows)), sizes)
        part = parts(tf, postings["m"].to_numpy(np.int64)[doc]) if len(doc) else tf
        by = np.argsort(term, kind="stable")
        term, doc, part = term[by], doc[by], part[by]
        order = np.argsort(rows, kind="stable")
        out = {"row": [], "id": [], "score": []}
        for terms, owners, weights, most, own, own_id, score in zip(*(bundles[c] for c in ("terms", "owners", "weights", "most", "row", "id", "score")), strict=True):
            here = np.asarray(owners) == owner
            added = np.zeros(len(rows), np.int64)
            for t, w in zip(np.asarray(terms)[here].tolist(), np.asarray(weights)[here].tolist(), strict=True):
                lo, hi = np.searchsorted(term, t), np.searchsorted(term, t, side="right")
                added[doc[lo:hi]] += w * part[lo:hi]
            own, score = np.asarray(own, np.int64), np.asarray(score, np.int64)
            own_id = np.asarray(own_id, object)
            # where the documents of the accumulator stand among the postings
            at = np.searchsorted(rows[order], own)
            met = at < len(rows)
            met[met] = rows[order][at[met]] == own[met]
            place = order[at[met]]
            score = score.copy()
            score[met] += added[place]
            fresh = added > 0
            fresh[place] = False
            own, own_id, score = np.concatenate((own, rows[fresh])), np.concatenate((own_id, ids[fresh].astype(object))), np.concatenate((score, added[fresh]))
            keep = left_over(score, top, int(np.asarray(most, np.int64)[np.asarray(owners) > owner].sum()))
            own, own_id, score = own[keep], own_id[keep], score[keep]
            if last and len(score) > top:
                none = pd.isna(own_id)
                best = np.lexsort((own, np.where(none, 0, own_id).astype(np.int64), none, -score))[:top]
                own, own_id, score = own[best], own_id[best], score[best]
            out["row"].append(own.tolist())
            out["id"].append([None if pd.isna(i) else int(i) for i in own_id])
            out["score"].append(score.tolist())
        return bundles.assign(**out)

    return run


def ranked(docs: DataFrame, items: DataFrame, top: int = 50, owners: tuple[float, ...] = (0.001, 0.01, 0.1), shard_rows: int = 4096, item_rows: int = 256, most_terms: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(item_col, rank, id_col, score): the ``top`` documents of each item with a score above 0."""
    spark = docs.sparkSession
    numbered = staged(items.select(F.monotonically_increasing_id().alias("item"), F.col(item_col), F.col(text_col).cast("string").alias("text")), "searchitems")
    wanted = staged(numbered.select("item", "text").mapInArrow(_item_terms, "item long, term string"), "searchterms")
    distinct = wanted.select("term").distinct().count()
    blocks = max(1, -(-distinct // most_terms))
    kind = docs.schema[id_col].dataType
    found = None
    for k in range(blocks):  # one, but for millions of distinct terms
        own = wanted.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k) if blocks > 1 else wanted
        one = _ranked_block(docs, own, top, owners, shard_rows, item_rows, id_col, text_col)
        found = one if found is None else found.unionByName(one)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "row"))
    best = found.withColumn("rank", rank).filter(F.col("rank") <= top)
    return best.join(numbered.select("item", item_col), "item").select(item_col, "rank", F.col("id").cast(kind).alias(id_col), "score")


def _ranked_block(docs, wanted, top, owners, shard_rows, item_rows, id_col, text_col) -> DataFrame:
    """(item, row, id, score): for each item the best of each shard."""
    spark = docs.sparkSession
    names = [r.term for r in wanted.select("term").distinct().sort("term").toLocalIterator()]
    src = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # staged, so that the rows' numbers stay as they are
    forward = staged(src.mapInArrow(_forward(spark.sparkContext.broadcast(names)), "row long, id long, n long, terms array<int>, tf array<long>"), "searchdocs")
    rows, n_docs, length = forward.agg(F.count("*"), F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    empty = spark.createDataFrame([], "item long, row long, id long, score long")
    if not n_docs:
        return empty
    forward = forward.withColumn("m", F.expr(f"50 + (50 * n * {n_docs}L) div {length}L"))
    each = forward.select("m", F.explode(F.arrays_zip("terms", "tf")).alias("p")).select(F.col("p.terms").alias("term"), F.expr(f"({UNIT}L * p.tf) div (1000 * p.tf + 20 * m)").alias("part"))
    # one row a term of the items (most_terms at most)
    stats = each.groupBy("term").agg(F.count("*").alias("df"), F.max("part").alias("most")).toArrow()
    term = stats.column("term").to_numpy()
    df, most = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
    df[term], most[term] = stats.column("df").to_numpy(), stats.column("most").to_numpy()
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    owner = np.searchsorted(np.array(owners) * n_docs, df, side="left").astype(np.int32)
    table = spark.createDataFrame(pa.table({"term": names, "number": np.arange(len(names), dtype=np.int32), "owner": owner, "weight": weight, "most": weight * most}))
    per_item = wanted.join(table, "term").groupBy("item").agg(F.array_sort(F.collect_list(F.struct("number", "owner", "weight", "most"))).alias("t"))
    per_item = per_item.select("item", *[F.col(f"t.{c}").alias(a) for c, a in (("number", "terms"), ("owner", "owners"), ("weight", "weights"), ("most", "most"))])
    bundles_of = max(1, -(-wanted.select("item").distinct().count() // item_rows))
    per_item = per_item.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(bundles_of)))
    shards = max(1, -(-rows // shard_rows))
    none = F.array().cast("array<long>")
    # the stated items, a bundle of each for every shard; in two steps, so that no array holds all shards
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n))
    bundles = per_item.withColumn("wide", upto(F.lit((shards - 1) // 4096).cast("long")))
    bundles = bundles.withColumn("near", upto(F.least(F.lit(4095), F.lit(shards - 1) - F.col("wide") * 4096)))
    bundles = bundles.withColumns({"shard": F.col("near") + F.col("wide") * 4096, "row": none, "id": none, "score": none})
    bundles = bundles.select("shard", "block", "item", "terms", "owners", "weights", "most", "row", "id", "score")
    shared = spark.sparkContext.broadcast(owner)
    postings = forward.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)))
    if bundles_of > 1:
        postings = postings.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bundles_of - 1).cast("long"))))
    else:
        postings = postings.withColumn("block", F.lit(0).cast("long"))
    postings = postings.select("shard", "block", "row", "id", "m", "terms", "tf")
    for k in range(len(owners) + 1):
        own = postings.mapInArrow(_owned(shared, k), postings.schema)
        bundles = bundles.groupBy("shard", "block").cogroup(own.groupBy("shard", "block")).applyInPandas(_stage(k, k == len(owners), top), BUNDLE)
    return bundles.select("item", F.explode(F.arrays_zip("row", "id", "score")).alias("b")).select("item", "b.*")


def _owned(shared, owner: int):
    """The postings of one owner; documents without any go."""

    def run(batches):
        for b in batches:
            terms, tf = b.column(5), b.column(6)
            flat, counts = terms.flatten(), tf.flatten()
            mine = shared.value[flat.to_numpy()] == owner
            upto = np.concatenate(([0], np.cumsum(mine)))[terms.offsets.to_numpy() - terms.offsets[0].as_py()]
            offsets = pa.array(upto.astype(np.int32))
            cut = lambda values: pa.ListArray.from_arrays(offsets, values.filter(pa.array(mine)))
            yield pa.RecordBatch.from_arrays([*b.columns[:5], cut(flat), cut(counts)], names=b.schema.names).filter(pa.array(np.diff(upto) > 0))

    return run


def query(docs: DataFrame, items: DataFrame) -> DataFrame:
    out = ranked(docs.select("doc_id", "text"), items.select("item_id", "text"))
    return out.select("item_id", F.col("rank").cast("int").alias("rank"), F.col("doc_id").cast("long").alias("doc_id"), "score")


SQL = r"""
with words as (
    select rowid_ as row, doc_id, unnest(list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')) as term
    from (select row_number() over () as rowid_, doc_id, text from documents)),
wanted as (
    select distinct item, item_id, unnest(list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')) as term
    from (select row_number() over () as item, item_id, text from benchmark)),
tf as (select row, doc_id, term, count(*) as tf from words group by all),
long as (select row, sum(tf)::bigint as n from tf group by row),
whole as (select count(*)::bigint as n_docs, sum(n)::bigint as total from long),
m as (select row, 100 - 50 + ((50 * n * n_docs) // total) as m from long, whole),
w as (select term, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::bigint as w from (select term, count(*) as df from tf group by term), whole),
scored as (
    select item, item_id, tf.row, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::bigint as score
    from wanted join tf using (term) join w using (term) join m on m.row = tf.row
    group by all),
best as (select *, row_number() over (partition by item order by score desc, doc_id nulls last, row)::int as rank from scored where score > 0)
select item_id, rank, doc_id, score from best where rank <= 50
"""
