"""Phrase collocations by dynamic itemset counting.

The texts lie in ``shards`` (by a hash of the text). Steps scan them one after the other, in a cycle, and count phrases of
all lengths side by side: words from the first step on, a longer phrase from the step after both of its subphrases (all
words but the last, all but the first) have reached the threshold, until it has been counted on every shard once.

What has reached the threshold is a filter of bits that only grows, so a phrase once active stays so: a step counts a phrase
of its shard exactly if the filter of now lets its subphrases pass and the filter of one cycle before did not (then the shard
has been counted for it). A false hit of the filter only counts a phrase that would not have been; each count is complete all
the same. The filter's size follows the words that reach the threshold on the first shard and has a fixed upper bound
(``most_bits``, 128 MB): beyond it more is counted, and nothing is lost. Bits are set by Spark jobs and come to the driver
as one row for 64 of them at most; all counts stay in staged tables. A phrase that has been counted on all shards and stayed
below the threshold goes from the table. Steps end when the filter has not changed for a cycle. Fewer shards add up the counts
of the many rare phrases less often, more start longer phrases earlier.

A candidate is a phrase of 2 to ``most_words`` words with a count a >= ``least``. Cut after its first k words it scores
floor(1000000 a a / (l r)), by exact decimals; the lowest cut counts (ties: the smallest k). It is dropped if it lies inside
a longer candidate of at least ``inside`` per cent of its count. Ranks are by score, count and phrase (bytes).

Defined results: null and empty texts have no words; a null language is ``und``; a language without a candidate has no row;
repeated rows count again; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymill.llm.common import drop_one, staged

UND = "und"
#: A-Z in lower case; what ends a piece becomes a line feed.
PIECES = bytes(c + 32 if 65 <= c <= 90 else 10 if chr(c) in ".,;:!?\n\x0b\x0c\r" else c for c in range(256))
#: Stands between pieces; no byte of UTF-8.
BREAK = b"\xff"
#: Words, and bytes of words, that a task counts before it hands its counts on.
CHUNK, CHUNK_BYTES = 1_000_000, 16 << 20
#: Phrases of one batch to Spark.
SLICE = 1 << 15


def words_of(text: str | None) -> list[bytes]:
    """The words of a text with BREAK between its pieces and after the last."""
    return (text or "").encode("utf-8", "surrogatepass").translate(PIECES).replace(b"\n", b" \xff ").split() + [BREAK]


def listed(texts: list[str | None]) -> pa.Array:
    """words_of the texts, one after the other, cut from their bytes at once."""
    joined = "\n".join(map(str, (t or "" for t in texts))).encode("utf-8", "surrogatepass").translate(PIECES)
    b = np.frombuffer((joined + b"\n").replace(b"\n", b" \xff "), np.uint8)
    word = (b != 32) & (b != 9)
    edges = np.flatnonzero(np.diff(word, prepend=False, append=False))
    offsets = np.concatenate(([0], np.cumsum(edges[1::2] - edges[::2]))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(b[word])])


def mixed(h: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The hash of a phrase, from those of all words but the last and of the last one."""
    x = h * np.uint64(0x9E3779B97F4A7C15) + (last ^ last >> np.uint64(31)) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (x ^ x >> np.uint64(29)) * np.uint64(0x165667B19E3779F9)


def word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def phrase_hashes(langs: pa.Array, phrases: pa.Array) -> np.ndarray:
    """The hashes of phrases, with those of their words taken once a language."""
    out = np.empty(len(phrases), np.uint64)
    langs = langs.dictionary_encode()
    number = langs.indices.to_numpy()
    for k, lang in enumerate(langs.dictionary.to_pylist()):
        rows = np.flatnonzero(number == k)
        lists = pc.split_pattern(phrases.take(pa.array(rows)).cast(pa.binary()), b" ")
        words = lists.flatten().dictionary_encode()
        own = word_hashes(lang, words.dictionary.to_pylist())[words.indices.to_numpy()]
        size = pc.list_value_length(lists).to_numpy()
        first = np.cumsum(size) - size
        h = own[first]
        for i in range(1, int(size.max(initial=1))):
            some = np.flatnonzero(size > i)
            h[some] = mixed(h[some], own[first[some] + i])
        out[rows] = h
    return out


def places(h: np.ndarray, bits: int) -> np.ndarray:
    """The four bits of each hash in a filter of that many (a power of two)."""
    step = h >> np.uint64(32) | np.uint64(1)
    return (h[:, None] + step[:, None] * np.arange(4, dtype=np.uint64)) & np.uint64(bits - 1)


def passes(filter_: np.ndarray | None, h: np.ndarray) -> np.ndarray:
    """Which hashes have all of their bits; most others are told by the first."""
    out = np.zeros(len(h), bool)
    if filter_ is None:
        return out
    left, step = np.arange(len(h)), h >> np.uint64(32) | np.uint64(1)
    for i in range(4):
        at = h[left] + step[left] * np.uint64(i) & np.uint64(64 * len(filter_) - 1)
        left = left[filter_[(at >> np.uint64(6)).view(np.int64)] >> (at & np.uint64(63)) & np.uint64(1) > 0]
    out[left] = True
    return out


class Counted:
    """Counts of one language in a task."""

    def __init__(self, lang: str):
        self.lang, self.words = lang, [pa.array([BREAK], pa.binary())]  # BREAK gets the number 0

    def add(self, words: pa.Array | list[bytes]) -> None:
        self.words.append(words if isinstance(words, pa.Array) else pa.array(words, pa.binary()))

    def phrases(self, most_words: int, singles: bool, now: np.ndarray | None = None, later: np.ndarray | None = None, before: np.ndarray | None = None) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
        """(phrases, counts, whether later lets their subphrases pass) of each length, for those that now lets pass and before
        does not; words, and their number as the empty phrase, if singles."""
        numbered = pa.concat_arrays(self.words).dictionary_encode()
        ids, words = numbered.indices.to_numpy()[1:].astype(np.int64), numbered.dictionary
        told_as = pa.concat_arrays([pa.array([b""], pa.binary()), words[1:]])
        if singles:
            n = np.bincount(ids, minlength=len(words))
            n[0] = len(ids) - n[0]
            for i in range(0, len(words), SLICE):
                yield told_as[i : i + SLICE], n[i : i + SLICE], np.zeros(len(n[i : i + SLICE]), bool)
        if now is None:
            return
        own = word_hashes(self.lang, words.to_pylist())
        h, members = own, np.arange(len(words))[:, None]
        live, late, done = (passes(f, h) for f in (now, later, before))
        live[0] = False
        code = np.where(live[ids], ids, -1)
        for k in range(2, most_words + 1):
            at = np.flatnonzero((code[:-1] >= 0) & (code[1:] >= 0))
            head, tail, last = code[at], code[at + 1], ids[at + k - 1]
            key = lambda some: head[some] * len(words) + last[some]  # noqa: E731, B023
            new = np.flatnonzero(~(done[head] & done[tail]))
            found, many = np.unique(2 * key(new) + (late[head[new]] & late[tail[new]]), return_counts=True)
            for i in range(0, len(found), SLICE):
                some = found[i : i + SLICE]
                told = np.column_stack((members[some // 2 // len(words)], some // 2 % len(words)))
                yield pc.binary_join_element_wise(*(told_as.take(pa.array(c)) for c in told.T), b" "), many[i : i + SLICE], some % 2 > 0
            if k == most_words:
                return
            on = np.flatnonzero(passes(now, mixed(h[head], own[last])))
            if not len(on):
                return
            kept, which = np.unique(key(on), return_inverse=True)
            members = np.column_stack((members[kept // len(words)], kept % len(words)))
            h = mixed(h[kept // len(words)], own[kept % len(words)])
            late, done = passes(later, h), passes(before, h)
            code = np.full(len(ids) - k + 1, -1)
            code[at[on]] = which


def _count(most_words: int, singles: bool, filters, since: int, step: int):
    """filters: a broadcast of now, later and before; phrases that later lets pass are active since that step, others since now."""

    def flushed(held: dict[str, Counted]):
        for c in held.values():
            for phrases, n, late in c.phrases(most_words, singles, *filters.value):
                start = np.where(late, since, 0 if singles and b" " not in phrases[-1].as_py() else step)
                yield pa.record_batch([pa.repeat(c.lang, len(phrases)), phrases.cast(pa.string()), pa.array(n, pa.int64()), pa.array(start, pa.int32())], names=["lang", "phrase", "n", "since"])

    def run(batches):
        held: dict[str, Counted] = {}
        size = room = 0
        for b in batches:
            by_lang: dict[str, list[str]] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                by_lang.setdefault(lang, []).append(text)
            for lang, texts in by_lang.items():
                if lang not in held:
                    held[lang] = Counted(lang)
                held[lang].add(words := listed(texts))
                size, room = size + len(words), room + words.nbytes
                if size >= CHUNK or room >= CHUNK_BYTES:
                    yield from flushed(held)
                    held, size, room = {}, 0, 0
        yield from flushed(held)

    return run


def _bits(bits: int):
    """The bits of phrases, as (number of a group of 64, its bits)."""

    def run(batches):
        for b in batches:
            at = places(phrase_hashes(b.column(0), b.column(1)), bits).ravel()
            yield pa.record_batch([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], names=["at", "bits"])

    return run


def filter_size(reached: int, most_bits: int) -> int:
    """256 bits for each word that reaches the threshold on the first shard, as a power of two."""
    return min(most_bits, max(1 << 20, 1 << (256 * reached).bit_length()))


def with_bits(filter_: np.ndarray, phrases: DataFrame) -> np.ndarray:
    """A filter that also lets those phrases pass (the same one if it did); one row for 64 bits comes to the driver at most."""
    rows = phrases.mapInArrow(_bits(64 * len(filter_)), "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits"))
    got = rows.toArrow()
    out = filter_.copy()
    out[got.column("at").to_numpy()] |= got.column("bits").to_numpy().view(np.uint64)
    return filter_ if np.array_equal(out, filter_) else out


def size_of(phrase):
    return F.length(phrase) - F.length(F.replace(phrase, F.lit(" "))) + 1


def count_phrases(docs: DataFrame, most_words: int = 3, least: int = 10, shards: int = 2, text_col: str = "text", lang_col: str = "lang", most_bits: int = 1 << 30) -> DataFrame:
    """(lang, phrase, n): every phrase of up to most_words words whose count reaches least, with its exact count, and for each
    language the number of its words, as the empty phrase. docs is read once a step."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UND)).alias("lang"), text.alias("text"))
    shard = F.pmod(F.xxhash64("text"), F.lit(shards))
    filters: list[np.ndarray | None] = [None]  # by step
    counts, step, changed = None, 0, 0  # changed: the step since which the filter has been the same
    while step < shards or changed > step - shards:
        now = filters[step]
        later, before = (filters[step - k] if step >= k else None for k in (shards - 1, shards))
        sent = spark.sparkContext.broadcast((now, later, before))
        part = texts.filter(shard == step % shards).mapInArrow(_count(most_words, step < shards, sent, step - shards + 1, step), "lang string, phrase string, n long, since int")
        if counts is not None:
            part = part.unionByName(counts)
        total = part.groupBy("lang", "phrase").agg(F.sum("n").alias("n"), F.min("since").alias("since"))
        # counted on all shards, and too seldom
        over = (F.col("since") <= step - shards + 1) & (F.col("n") < least) & (F.col("phrase") != "")
        old, counts = counts, staged(total.filter(~over), "phrasecounts")
        if old is not None:
            drop_one(old)
        sent.destroy()  # the step's counts are written
        reached = counts.filter((F.col("n") >= least) & (F.col("phrase") != "") & (size_of(F.col("phrase")) < most_words)).select("lang", "phrase")
        if now is None and (n := reached.count()):
            now = np.zeros(filter_size(n, most_bits) // 64, np.uint64)
        filters.append(with_bits(now, reached) if now is not None else None)
        if filters[-1] is not filters[step]:
            changed = step + 1
        if step >= shards:
            filters[step - shards] = None  # no longer asked for
        step += 1
    return counts.filter((F.col("n") >= least) | (F.col("phrase") == "")).select("lang", "phrase", "n")


def collocations(docs: DataFrame, most_words: int = 3, least: int = 10, inside: int = 50, top: int = 2000, **how) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of each language."""
    counts = count_phrases(docs, most_words, least, **how)
    size = size_of(F.col("phrase"))
    total = counts.filter("phrase = ''").select("lang", "n")
    often = counts.filter("phrase <> ''").withColumn("size", size)
    found = often.filter("size > 1").select("lang", "phrase", "size", F.col("n").alias("a"))
    words = F.split("phrase", " ")
    cut = found.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cut = cut.withColumns({"first": F.array_join(F.slice(words, F.lit(1), F.col("k")), " "), "rest": F.array_join(F.slice(words, F.col("k") + 1, F.col("size")), " ")})
    part = lambda name, of: often.select("lang", F.col("phrase").alias(of), F.col("n").alias(name))
    cut = cut.join(part("l", "first"), ["lang", "first"]).join(part("r", "rest"), ["lang", "rest"])
    wide = lambda c: F.col(c).cast("decimal(16,0)")
    cut = cut.withColumns({"up": wide("a") * wide("a") * F.lit(1_000_000).cast("decimal(7,0)"), "down": wide("l") * wide("r")})
    scored = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct(F.expr("up div down").alias("score"), "k", "l", "r")).alias("c"))
    # each candidate's parts of two words and more, with the highest count of a longer one around them
    longer = found.filter("size > 2").withColumn("of", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
    longer = longer.withColumn("from", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("of") + 1)))
    around = longer.groupBy("lang", F.array_join(F.slice(words, F.col("from"), F.col("of")), " ").alias("phrase")).agg(F.max("a").alias("around"))
    kept = scored.join(around, ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("around") < inside * F.col("a"), F.lit(True)))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("c.score").desc(), F.col("a").desc(), "phrase"))
    ranked = kept.select("lang", "phrase", "a", "c", rank.alias("rank")).filter(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "c.l", "c.r", "n", "c.score")


def query(docs: DataFrame) -> DataFrame:
    return collocations(docs.select("lang", "text"))


SQL = r"""
with pieces as (
    select doc_id, coalesce(lang, 'und') as lang,
        unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
    from documents),
lists as (select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]'), lambda x: x <> '') as w from pieces),
grams as (
    select lang, 1 as size, unnest(w) as phrase from lists
    union all
    select lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) from lists where len(w) > 1
    union all
    select lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) from lists where len(w) > 2),
f as (select lang, size, phrase, count(*) as n from grams group by all),
total as (select lang, sum(n)::bigint as n from f where size = 1 group by lang),
cand as (select lang, size, phrase, n as a, string_split(phrase, ' ') as w from f where size > 1 and n >= 10),
cut as (
    select lang, phrase, a, k, array_to_string(w[1:k], ' ') as first, array_to_string(w[k + 1:], ' ') as rest
    from (select *, unnest(range(1, size)) as k from cand)),
scored as (
    select c.lang, c.phrase, c.a, c.k, x.n as l, y.n as r,
        ((1000000::hugeint * c.a * c.a) // (x.n::hugeint * y.n))::bigint as score
    from cut c join f x on x.lang = c.lang and x.phrase = c.first join f y on y.lang = c.lang and y.phrase = c.rest),
best as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
around as (
    select lang, phrase, max(a) as a from (
        select lang, a, w[1] || ' ' || w[2] as phrase from cand where size = 3
        union all
        select lang, a, w[2] || ' ' || w[3] from cand where size = 3)
    group by all),
ranked as (
    select b.lang, row_number() over (partition by b.lang order by b.score desc, b.a desc, b.phrase) as rank, b.phrase, b.a, b.l, b.r, b.score
    from best b left join around o on o.lang = b.lang and o.phrase = b.phrase
    where o.a is null or 100 * o.a < 50 * b.a)
select k.lang, k.rank, k.phrase, k.a, k.l, k.r, t.n, k.score from ranked k join total t on t.lang = k.lang where k.rank <= 2000
"""
