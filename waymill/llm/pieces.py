"""SentencePiece encoding and decoding: exact merge-type segmentation by backtracking.

A model of merge type joins, again and again, the adjacent pair whose joint piece scores highest (leftmost of equals). Its
result is the only sequence of pieces in which every two neighbours are compatible: merged again from their characters on
their own, they come out as these two pieces. So no queue of merges is needed: at each position the longest piece (from one
Aho-Corasick pass over the stretch) is tried, then its shorter beginnings; one that is not compatible with its left
neighbour is passed over; where none is left, the last piece is taken back, and a bitfield remembers that nothing goes on
from that position, so no position is tried twice. Pieces that do not come out of their own characters never stand in a
result and are left out of the automaton.

Characters that are no piece stand alone, as the bytes of their UTF-8 form where the model has byte pieces, else as the
unknown id. Where no piece holds a word mark behind another character, texts are cut before the word marks and a task keeps
the ids of stretches that it has met (at most ``CACHE`` of ``CACHED`` characters; a cache, no limit on texts).

The model file is read on the driver through Spark's file system and sent to the tasks as bytes (``most_bytes`` at most);
normalisation, piece table and the joining of pieces at decoding are the sentencepiece library's. Models that are not of
merge type, or have user-defined or unused pieces, are refused.

Defined results: null and empty texts have no ids and decode to an empty text; null ids in an array stay out; repeated rows
pass; columns with the names of the new ones are replaced, others pass through; an empty table stays empty.
"""

from __future__ import annotations

import heapq
import math
import re
from itertools import chain

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymill.llm.common import free_names, sha256_of, with_columns_free

MARK = "▁"
CACHE, CACHED, PAIRS = 1 << 18, 64, 1 << 20


class Encoder:
    """The tables of one model, in a task. Pieces are told by their ids."""

    def __init__(self, model: bytes):
        self.sp = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.size = size = sp.get_piece_size()
        special = [i for i in range(size) if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)]
        if any(sp.is_unused(i) for i in range(size)):
            raise ValueError("models with unused pieces are not supported")
        self.unknown = sp.unk_id()
        byte = {int(sp.id_to_piece(i)[1:-1], 16): i for i in special if sp.is_byte(i)}
        self.bytes = [byte[k] for k in range(256)] if len(byte) == 256 else None
        self.text = [sp.id_to_piece(i) for i in range(size)]
        self.number = {self.text[i]: i for i in set(range(size)) - set(special)}
        rank = {score: k for k, score in enumerate(sorted({sp.get_score(i) for i in self.number.values()}, reverse=True))}
        self.rank = {p: rank[sp.get_score(i)] for p, i in self.number.items()}  # the lowest is merged first; equal scores share one
        self.letters = frozenset(p for p in self.number if len(p) == 1)
        self.split: dict[str, tuple[str, str]] = {}  # what a piece was merged from
        reached = [p for p in self.number if len(p) == 1 or self.merged(p, self.split) == [p]]
        self.automaton = ahocorasick.Automaton()
        for p in reached:
            self.automaton.add_word(p, (len(p), self.number[p]))
        self.automaton.make_automaton()
        self.length = [len(p) for p in self.text]
        #: The longest piece that a piece begins with, or -1.
        self.shorter = [-1] * size
        known = set(reached)
        for p in reached:
            self.shorter[self.number[p]] = next((self.number[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in known), -1)
        self.alone = not any(MARK in p.lstrip(MARK) for p in reached)  # word marks only begin pieces: texts can be cut there
        # pieces rank after what they are merged from, so that merges come in the order of ranks; else all checks merge anew
        self.ordered = {p for p in reached if all(len(x) == 1 or self.rank[x] < self.rank[p] for x in self.split.get(p, ()))}
        self.tails = {p: self.edge(p, 1) for p in reached}
        self.starts = {p: self.edge(p, 0) for p in reached}
        self.compatible: dict[int, bool] = {}
        self.met = Met(self.stretch)

    def merged(self, text: str, split: dict[str, tuple[str, str]] | None = None) -> list[str]:
        """The pieces of a text by merging: the best rank first, leftmost of equals. split takes what was merged from what."""
        part: list[str | None] = list(text)
        left, right = list(range(-1, len(part) - 1)), list(range(1, len(part) + 1))
        queue: list = []

        def offer(i: int) -> None:
            j = right[i]
            if j < len(part) and (rank := self.rank.get(part[i] + part[j])) is not None:
                heapq.heappush(queue, (rank, i, len(part[i]), len(part[j])))

        for i in range(len(part) - 1):
            offer(i)
        while queue:
            _, i, a, b = heapq.heappop(queue)
            if part[i] is None or len(part[i]) != a or (j := right[i]) >= len(part) or len(part[j]) != b:
                continue  # a pair that has been merged since
            if split is not None and a + b == len(text):
                split[text] = part[i], part[j]
            part[i], part[j], right[i] = part[i] + part[j], None, right[j]
            if right[j] < len(part):
                left[right[j]] = i
            offer(i)
            if left[i] >= 0:
                offer(left[i])
        return [p for p in part if p is not None]

    def edge(self, piece: str, side: int) -> list[tuple[str, float]] | None:
        """The parts that stand at a piece's end (side 1) or start (0) while it is merged, with the rank of the merge that ends
        each; None if its merges are not in the order of ranks."""
        out, until = [], math.inf
        while True:
            if piece not in self.ordered:
                return None
            out.append((piece, until))
            if len(piece) == 1:
                return out
            until, piece = self.rank[piece], self.split[piece][side]

    def fits(self, a: int, b: int) -> bool:
        """Merged again together, two pieces stay these two.

        Merges run in the order of ranks, so a part at the end of the one and a part at the start of the other are merged across
        exactly if their joint piece ranks before the merge that ends either (at equal ranks the left merge comes first).
        """
        tails, starts = self.tails[self.text[a]], self.starts[self.text[b]]
        if tails is None or starts is None:
            return self.merged(self.text[a] + self.text[b]) == [self.text[a], self.text[b]]
        for x, end_x in tails:
            for y, end_y in starts:
                rank = self.rank.get(x + y)
                if rank is not None and rank < end_x and rank <= end_y:
                    return False
        return True

    def known(self, text: str) -> list[int]:
        """The pieces of a text all of whose characters are pieces, by backtracking."""
        best = [0] * len(text)
        for end, (size, piece) in self.automaton.iter(text):
            best[end - size + 1] = piece  # matches come by their ends, so the longest of a start comes last
        length, shorter, compatible, n = self.length, self.shorter, self.compatible, len(text)
        closed = None  # the bitfield of failed positions, once there is one
        out: list[int] = []
        at, piece, last = 0, best[0], -1
        while True:
            end = at + length[piece]
            good = closed is None or not closed[end >> 3] >> (end & 7) & 1
            if good and last >= 0:
                key = last << 32 | piece
                good = compatible.get(key)
                if good is None:
                    good = self.fits(last, piece)
                    if len(compatible) < PAIRS:
                        compatible[key] = good
            if good:
                out.append(piece)
                if end == n:
                    return out
                at, last, piece = end, piece, best[end]
            elif shorter[piece] >= 0:
                piece = shorter[piece]
            else:
                closed = closed or bytearray(n // 8 + 1)
                closed[at >> 3] |= 1 << (at & 7)
                piece = out.pop()
                at -= length[piece]
                last = out[-1] if out else -1

    def stretch(self, text: str) -> tuple[int, ...]:
        """The ids of a stretch: runs of known characters between those that are no piece."""
        letters = self.letters
        if letters.issuperset(text):
            return tuple(self.known(text))
        ids: list[int] = []
        at = 0
        while at < len(text):
            end = at
            while end < len(text) and text[end] in letters:
                end += 1
            if end > at:
                ids += self.known(text[at:end])
            at = end
            while at < len(text) and text[at] not in letters:
                at += 1
            if at > end:
                # the library joins neighbouring unknown characters into one unknown id, but writes each byte
                ids += [self.bytes[b] for b in text[end:at].encode()] if self.bytes else [self.unknown]
        return tuple(ids)

    def encode(self, text: str | None) -> list[int]:
        whole = self.sp.normalize(text or "")
        if not self.alone:
            return list(self.stretch(whole)) if whole else []
        return list(chain.from_iterable(map(self.met.__getitem__, STRETCH.findall(whole))))


class Met(dict):
    """The ids of stretches that a task has met; others are worked out, and kept while there is room."""

    def __init__(self, work):
        super().__init__()
        self.work = work

    def __missing__(self, text: str) -> tuple[int, ...]:
        got = self.work(text)
        if len(text) <= CACHED and len(self) < CACHE:
            self[text] = got
        return got


STRETCH = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
#: What this Python worker has built from a model, kept over its tasks.
_held: dict[tuple[type, int], object] = {}


def _of_model(kind, shared):
    key = kind, hash(shared.value)
    if key not in _held:
        for old in [k for k in _held if k[0] is kind]:  # one model of a kind; a worker may both encode and decode
            del _held[old]
        _held[key] = kind(shared.value)
    return _held[key]


class Decoder:
    def __init__(self, model: bytes):
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)

    def decode(self, ids: list[int]) -> str:
        return self.sp.decode(ids) if ids else ""


def model_bytes(spark: SparkSession, path: str, most_bytes: int = 64 << 20) -> bytes:
    """The model file (any path that Spark can read; a plain one is one of the driver's machine)."""
    path = path if "://" in path else f"file://{path}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if (size := fs.getFileStatus(at).getLen()) > most_bytes:
        raise ValueError(f"a model of {size} bytes; {most_bytes} at most are sent to the tasks")
    stream = fs.open(at)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def _values(column: pa.Array) -> list:
    """A column as Python values; lists of numbers are cut from one flat list."""
    if not pa.types.is_list(column.type):
        return column.to_pylist()
    flat, ends = column.values.tolist() if column.values.null_count else column.values.to_numpy().tolist(), column.offsets.to_numpy().tolist()
    return [flat[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def _mapped(shared, tool, work, kind):
    """Replaces the last column by what work gives, with the tool of the model, for each of its values."""

    def run(batches):
        own = _of_model(tool, shared)
        for b in batches:
            new = pa.array([work(own, v) for v in _values(b.column(b.num_columns - 1))], kind)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], new], names=b.schema.names)

    return run


def _apply(df: DataFrame, own, shared, tool, work, kind, spark_kind: str, name: str) -> DataFrame:
    (new,) = free_names(df, "_new")
    src = df.select(*with_columns_free(df, name).columns, own.alias(new))
    schema = src.withColumn(new, F.lit(None).cast(spark_kind)).schema
    return src.mapInArrow(_mapped(shared, tool, work, kind), schema).withColumnRenamed(new, name)


def encode_texts(docs: DataFrame, model: bytes, text_col: str = "text", name: str = "ids") -> DataFrame:
    """docs with the ids of each whole text, without begin and end ids."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return _apply(docs, F.col(text_col).cast("string"), shared, Encoder, Encoder.encode, pa.list_(pa.int32()), "array<int>", name)


def decode_ids(df: DataFrame, model: bytes, ids_col: str = "ids", name: str = "decoded") -> DataFrame:
    """df with the text of each array of ids."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    own = F.filter(F.coalesce(F.col(ids_col), F.array().cast("array<int>")), lambda x: x.isNotNull())
    return _apply(df, own, shared, Decoder, Decoder.decode, pa.string(), "string", name)


def query(docs: DataFrame, model_path: str) -> DataFrame:
    model = model_bytes(docs.sparkSession, model_path)
    out = decode_ids(encode_texts(docs.select("doc_id", "text"), model).drop("text"), model)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), sha256_of(F.concat_ws(",", F.col("ids").cast("array<string>"))).alias("ids_sha256"), sha256_of(F.col("decoded")).alias("decoded_sha256"))
