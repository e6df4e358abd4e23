"""Language identification with a blended-spectrum string kernel.

A text is the set of its 1-, 2- and 3-grams over a small folded alphabet (presence, not frequency). The kernel of two
texts is the number of n-grams they share over the root of the product of their numbers. Landmark texts and their n-grams
(``vocab`` at most, by document frequency) span the Nyström features; one-versus-rest kernel ridge regression is solved on
them in closed form. A batch of documents is scored by three matrix products: presence x landmarks, Nyström map, weights.

The model is fitted on at most ``per_lang`` labelled texts of each language, the rows with the smallest hash of their id;
every document is scored from its whole text. Defined results: null texts and texts without a letter are ``und`` with
score 0; null languages teach nothing; without any labelled text the language of a text with a letter is null (score 0);
ties go to the first language by name; repeated rows pass, and further columns but those with the names of the new ones;
an empty table stays empty.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymill.llm.common import with_columns_free, without

LETTERS = 64
GRAMS = LETTERS + LETTERS**2 + LETTERS**3


def _alphabet() -> np.ndarray:
    """Code point -> 0 for no letter, 1-26 for a-z, 27-63 for other letters (many to one)."""
    out = np.zeros(0x3000, np.int32)
    for cp in range(len(out)):
        if chr(cp).isalpha():
            low = ord(chr(cp).lower()[0])
            out[cp] = low - 96 if 97 <= low <= 122 else 27 + low % 37
    return out


ALPHABET = _alphabet()


def gram_codes(text: str) -> list[np.ndarray]:
    """The codes of all 1-, 2- and 3-grams, repeats included; runs of other characters count as one space."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    a = np.where(cp < len(ALPHABET), ALPHABET[np.minimum(cp, len(ALPHABET) - 1)], 27 + cp % 37).astype(np.int32)
    a = np.concatenate(([0], a, [0]))
    a = a[np.concatenate(([True], (a[1:] != 0) | (a[:-1] != 0)))]
    two = a[:-1] * LETTERS + a[1:]
    return [a, LETTERS + two, LETTERS + LETTERS**2 + two[:-1] * LETTERS + a[2:]]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class Model:
    langs: list[str]
    index: np.ndarray  # gram code -> column of the presence matrix; the last column takes all unknown ones
    landmarks: np.ndarray  # presence of the columns in the landmarks
    norms: np.ndarray
    weights: np.ndarray  # Nyström map x ridge weights
    bias: np.ndarray

    def presence(self, texts: list[str]) -> np.ndarray:
        n = self.landmarks.shape[0]
        out = np.zeros((len(texts), n + 1), np.float32)
        for i, t in enumerate(texts):
            for codes in gram_codes(t):
                out[i, self.index[codes]] = 1
        return out[:, :n]

    def kernel(self, x: np.ndarray) -> np.ndarray:
        return x @ self.landmarks / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1) * self.norms)

    def scores(self, texts: list[str]) -> np.ndarray:
        return self.kernel(self.presence(texts)) @ self.weights + self.bias


def fit(texts: list[str], langs: list[str], landmarks_a_lang: int = 24, vocab: int = 16_384, ridge: float = 1e-2) -> Model:
    """texts in a fixed order; the first ones of each language are its landmarks."""
    names = sorted(set(langs))
    df = np.zeros(GRAMS, np.int32)
    for t in texts:
        df[np.unique(np.concatenate(gram_codes(t)))] += 1
    known = np.sort(np.argsort(-df, kind="stable")[: min(vocab, int((df > 0).sum()))])
    index = np.full(GRAMS, len(known), np.int32)
    index[known] = np.arange(len(known))
    m = Model(names, index, np.zeros((len(known), 1), np.float32), np.ones(1, np.float32), np.zeros((1, 1)), np.zeros(1))
    x = m.presence(texts)
    marks = [i for name in names for i in [k for k, v in enumerate(langs) if v == name][:landmarks_a_lang]]
    m.landmarks = np.ascontiguousarray(x[marks].T)
    m.norms = np.maximum(x[marks].sum(1), 1)
    k = m.kernel(x).astype(np.float64)
    val, vec = np.linalg.eigh(k[marks] + 1e-6 * np.eye(len(marks)))
    nystrom = vec / np.sqrt(np.maximum(val, 1e-6))
    phi = np.concatenate((k @ nystrom, np.ones((len(k), 1))), 1)
    y = np.array([[1.0 if v == name else -1.0 for name in names] for v in langs])
    each = np.array([1.0 / langs.count(v) for v in langs])[:, None] * len(langs) / len(names)  # languages count alike
    beta = np.linalg.solve(phi.T @ (each * phi) + ridge * len(langs) / len(names) * np.eye(phi.shape[1]), phi.T @ (each * y))
    m.weights = (nystrom @ beta[:-1]).astype(np.float32)
    m.bias = beta[-1].astype(np.float32)
    return m


def _predict(model, batch: int, names: tuple[str, str]):
    def run(batches):
        m = model.value
        for b in batches:
            at = b.schema.names.index("_text")
            texts = b.column(at).to_pylist()
            rows = [i for i, t in enumerate(texts) if has_letter(t)]
            lang, score = ["und"] * len(texts), [0.0] * len(texts)
            if m is None:
                for i in rows:
                    lang[i] = None
                rows = []
            for k in range(0, len(rows), batch):
                own = rows[k : k + batch]
                s = m.scores([texts[i] for i in own])
                best = s.argmax(1)
                for i, j, v in zip(own, best, s[np.arange(len(own)), best], strict=True):
                    lang[i], score[i] = m.langs[j], float(min(1, max(0, (v + 1) / 2)))
            keep = [i for i in range(b.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*(b.schema.names[i] for i in keep), *names])

    return run


def identify(docs: DataFrame, labelled: DataFrame, keep: list[str], text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_lang: int = 120, batch: int = 128, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns to keep of docs, the language and its score under these names; the model learns from text_col and lang_col of labelled."""
    spark = docs.sparkSession
    own = labelled.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)).alias("h")).filter("lang is not null and trim(text) <> ''")
    counts = {r.lang: r.n for r in own.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    model = None
    if counts:
        # so that about twice per_lang rows of each language come back, however many there are
        share = F.coalesce(*[F.when(F.col("lang") == name, F.lit(min(1.0, (2 * per_lang + 40) / n))) for name, n in counts.items()], F.lit(0.0))
        rows = sorted(own.filter(F.pmod("h", F.lit(1_000_000)) < share * 1_000_000).collect(), key=lambda r: (r.lang, r.h, r.text))
        taken = [r for name in sorted(counts) for r in [r for r in rows if r.lang == name and has_letter(r.text)][:per_lang]]
        if taken:
            model = fit([r.text for r in taken], [r.lang for r in taken])
    src = docs.select(*without(keep, *names, "_text"), F.col(text_col).cast("string").alias("_text"))
    schema = src.drop("_text").withColumns({names[0]: F.lit(None).cast("string"), names[1]: F.lit(0.0)}).schema
    return src.mapInArrow(_predict(spark.sparkContext.broadcast(model), batch, names), schema)


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")), F.lit(3)) == 1, F.lit(False))


def query(docs: DataFrame) -> DataFrame:
    docs = with_columns_free(docs, "lang_pred", "score", "held_out").withColumn("held_out", held_out())
    return identify(docs, docs.filter(~F.col("held_out")), ["doc_id", "held_out"])
