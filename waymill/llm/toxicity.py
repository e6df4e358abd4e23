"""Toxicity by a weighted finite-state pattern grammar.

Three layers of transducers are composed. The lexical layer turns a word into a symbol with a weight: INSULT (a trie of
learned word stems), THREAT, TARGET, NEGATION and REPORT (fixed word lists); all other words are skipped. The grammar layer
is the product of small transducers over these symbols: a negation before an insult or threat damps it for a few words, a
report (said, wrote, called) damps what follows it in the clause, a target near an insult raises it and makes a threat of
what alone is hardly one (to kill a process, to kill you), and two insults in a clause raise each other. Targets may stand on either side, so
their transducer reads the clause from both ends, and a word is raised once if either reading finds one. A clause's weight
is the sum along its path; a document is scored from its heaviest clause, the sum of all and that sum by length, by a logistic
curve.

Insult stems and the curve are learned from a bounded sample of labelled rows (``per_class`` of each label at most, those
with the smallest hash, near copies taken once): a stem counts if it is so often in toxic and so seldom in other documents
that chance would hardly give one such stem (a binomial tail below ``chance`` after correction for all stems tried), and of a
chain of stems the one that tells most about the label (by likelihood ratio) is taken. Every document is scored over its
whole text.

Defined results: null and empty texts have no clause and get the curve's value at zero; null labels teach nothing;
labels that contradict each other on one document both count; without both labels the fixed lists and a fixed curve are used;
repeated rows pass, and further columns but those with the names of the new ones; an empty table stays empty.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymill.llm.common import with_columns_free, without

WORD_OR_STOP = re.compile(r"[^\W\d_]+|[.!?;:\n|]")

#: Fixed word lists of the grammar, in English, French, German and Spanish.
THREAT = frozenset("""kill kills killing murder hurt hurts destroy shoot stab stabs beat punch strangle burn hunt attack smash tuer tuerai frapper frapperai détruire
étrangler brûler töten töte umbringen schlagen schlage verletzen erschießen verprügeln vernichten matar mataré golpear golpearé herir destruir quemar""".split())
TARGET = frozenset("""you your yours yourself he him his himself she her hers herself they them their everyone tu te toi vous ton ta tes votre vos elle elles ils lui leur
du dich dir dein deine euch eure ihr ihm ihn ihnen sie tú ti tuyo usted ustedes ellos ellas""".split())
NEGATION = frozenset("not never no none nobody without neither nor cannot isn aren wasn weren don doesn didn won wouldn nicht kein keine keinen nie niemals niemand ohne pas jamais sans aucun aucune personne nunca jamás sin ningún ninguna nadie".split())
REPORT = frozenset("said says say wrote writes write called calls reported reports claims claimed quoted quotes alleged told tells dit disait écrit appelé prétend raconte sagte sagt schrieb schreibt nannte behauptet erzählte dijo dice escribió llamó afirma contó".split())
INSULT, SYM_THREAT, SYM_TARGET, SYM_NEG, SYM_REPORT = range(5)
SYMBOL = {w: s for s, words in ((SYM_THREAT, THREAT), (SYM_TARGET, TARGET), (SYM_NEG, NEGATION), (SYM_REPORT, REPORT)) for w in words}
#: Words for which a negation holds and a target is near, and by what the grammar multiplies; what a threat weighs alone, and
#: what one word of a clause weighs at most.
REACH, NEAR = 4, 4
DAMP_NEG, DAMP_REPORT, RAISE_TARGET, MAKES_THREAT, RAISE_AGAIN, W_THREAT, MOST = 0.15, 0.15, 1.3, 6.0, 1.2, 0.15, 1.6

STEM = (3, 9)
#: What the curve leans to without evidence: heaviest clause, logarithm of the sum, sum for 100 words.
CURVE = (4.0, 1.5, 1.0)


def machine(symbols, step):
    """A transducer given as a step function (state, symbol) -> (state, factor), made into a table over its reachable states."""
    table, todo = {}, [0]
    while todo:
        s = todo.pop()
        if s in table:
            continue
        table[s] = [step(s, a) for a in symbols]
        todo += [t for t, _ in table[s]]
    return table


def compose(one: dict, two: dict) -> dict:
    """The product of two transducers that read the same symbols: states are pairs, factors multiply."""
    table, todo, number = {}, [(0, 0)], {(0, 0): 0}
    while todo:
        s = todo.pop()
        row = []
        for (a, x), (b, y) in zip(one[s[0]], two[s[1]], strict=True):
            if (a, b) not in number:
                number[a, b] = len(number)
                todo.append((a, b))
            row.append((number[a, b], x * y))
        table[number[s]] = row
    return table


SKIP = 5  # any other word
SYMBOLS = range(6)
HEAVY = (INSULT, SYM_THREAT)
MACHINES = {
    "negation": lambda s, a: (REACH, 1.0) if a == SYM_NEG else (max(0, s - 1), DAMP_NEG if s and a in HEAVY else 1.0),
    "report": lambda s, a: (1, 1.0) if a == SYM_REPORT else (s, DAMP_REPORT if s and a in HEAVY else 1.0),
    "again": lambda s, a: (1, RAISE_AGAIN if s else 1.0) if a in HEAVY else (s, 1.0),
}


def near(s: int, a: int) -> tuple[int, float]:
    """Counts down from a target; the factor is that of an insult or threat which the machine reads while one is near."""
    return (NEAR, 1.0) if a == SYM_TARGET else (max(0, s - 1), (RAISE_TARGET if a == INSULT else MAKES_THREAT) if s and a in HEAVY else 1.0)


def grammar(off: tuple[str, ...] = ()) -> tuple[dict, dict]:
    """The product of the transducers that read forwards, and the one of targets, read from both ends; those named in off (also
    target) are left out."""
    forth = machine(SYMBOLS, lambda s, a: (0, 1.0))
    for name, step in MACHINES.items():
        if name not in off:
            forth = compose(forth, machine(SYMBOLS, step))
    return forth, machine(SYMBOLS, (lambda s, a: (0, 1.0)) if "target" in off else near)


GRAMMAR = grammar()


@dataclass
class Model:
    stems: dict[str, float]  # insult stem -> weight
    curve: tuple[float, ...] = (-4.0, *CURVE)  # at zero, and by feature
    grammar: tuple[dict, dict] = GRAMMAR

    def __post_init__(self):
        self.trie: dict = {}
        for stem, w in self.stems.items():
            node = self.trie
            for c in stem:
                node = node.setdefault(c, {})
            node[""] = w
        self.known: dict[str, tuple[int, float]] = {}

    def symbol(self, word: str) -> tuple[int, float]:
        """The lexical transducer: the longest stem that the word begins with, else the fixed lists."""
        node, weight = self.trie, None
        for c in word:
            node = node.get(c)
            if node is None:
                break
            weight = node.get("", weight)
        if weight is not None:
            return INSULT, weight
        s = SYMBOL.get(word, SKIP)
        return s, W_THREAT if s == SYM_THREAT else 0.0

    def weigh(self, clause: list[tuple[int, float]]) -> float:
        """The weight of a clause: along its path, with the targets that either reading finds."""
        forth, side = self.grammar
        state, ahead, out = 0, 0, []
        for s, x in clause:
            state, factor = forth[state][s]
            ahead, raised = side[ahead][s]
            out.append((x * factor, raised))
        behind, total = 0, 0.0
        for (s, x), (w, raised) in zip(reversed(clause), reversed(out), strict=True):
            behind, again = side[behind][s]
            if x:
                total += min(w * max(raised, again), MOST)
        return total

    def scan(self, text: str | None) -> tuple[list[tuple[float, int, int]], int]:
        """(weight, start, end) of the clauses with any weight, and the number of words."""
        clause: list[tuple[int, float]] = []
        heavy, start, last, words, out = False, 0, 0, 0, []
        known, symbol = self.known, self.symbol
        for m in WORD_OR_STOP.finditer((text or "").lower()):
            w = m[0]
            got = known.get(w)
            if got is None:
                got = (-1, 0.0) if not w[0].isalpha() else symbol(w)
                if len(known) < 200_000:  # a cache, no limit on the words
                    known[w] = got
            if got[0] < 0:
                if heavy:
                    out.append((self.weigh(clause), start, last))
                clause, heavy, start = [], False, m.end()
            else:
                clause.append(got)
                heavy = heavy or got[1] > 0
                last = m.end()
                words += 1
        if heavy:
            out.append((self.weigh(clause), start, last))
        return out, words

    def features(self, text: str | None) -> tuple[float, float, float]:
        found, words = self.scan(text)
        total = sum(x for x, _, _ in found)
        return (max(x for x, _, _ in found), math.log1p(total), 100 * total / (50 + words)) if found else (0.0, 0.0, 0.0)

    def score(self, text: str | None) -> float:
        z = self.curve[0] + sum(a * x for a, x in zip(self.curve[1:], self.features(text), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def stems_in(text: str) -> set[str]:
    """The words of a text and their beginnings."""
    out = set()
    for w in set(re.findall(r"[^\W\d_]+", text.lower())):
        out.update(w[:k] for k in range(STEM[0], min(STEM[1], len(w)) + 1))
    return out


def without_copies(rows: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """One of the rows that agree in one of three bands of three least shingle hashes, as near copies do."""
    odd = np.random.default_rng(5).integers(0, 2**63, 9).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    seen, out = set(), []
    for text, label in rows:
        words = text.lower().split()
        h = np.array([xxhash.xxh64_intdigest(" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))], np.uint64)
        least = [int((h * k).min()) for k in odd]
        own = {(b, *least[3 * b : 3 * b + 3]) for b in range(3)}
        if not own & seen:
            out.append((text, label))
        seen |= own
    return out


def told(k: int, c: int, n: Counter) -> float:
    """The log-likelihood ratio of a stem in k toxic and c other documents."""
    part = lambda x, m: (x * math.log(x / m) if x else 0.0) + ((m - x) * math.log((m - x) / m) if m > x else 0.0)
    return part(k, n[1]) + part(c, n[0]) - part(k + c, n[0] + n[1])


def learn(rows: list[tuple[str, int]], weights: tuple[float, float] = (1.0, 1.0), chance: float = 0.05, most_stems: int = 4096) -> Model:
    """rows: (text, label), in a fixed order; weights: rows that one of the sample stands for, by label."""
    rows = without_copies(rows)
    n = Counter(y for _, y in rows)
    if not n[0] or not n[1]:
        return Model({})
    df = (Counter(), Counter())
    for t, y in rows:
        df[y].update(stems_in(t))
    rate = n[1] / (n[0] + n[1])
    fine = {}
    for s, k in df[1].items():
        if k >= 3 and k / (k + df[0][s]) > max(0.5, 2 * rate):
            total = k + df[0][s]
            tail = sum(math.comb(total, j) * rate**j * (1 - rate) ** (total - j) for j in range(k, total + 1))
            if tail * len(df[1]) < chance:
                fine[s] = k
    odds = {s: math.log((k + 0.5) / (n[1] + 1)) - math.log((df[0][s] + 0.5) / (n[0] + 1)) for s, k in fine.items()}
    # of a chain of stems the one with the best evidence, a longer one if it is about as good
    worth = {s: told(k, df[0][s], n) * (1 + 0.02 * len(s)) for s, k in fine.items()}
    taken: set[str] = set()
    beginnings: set[str] = set()
    for s in sorted(worth, key=lambda s: (-worth[s], s)):
        if len(taken) < most_stems and s not in beginnings and not any(s[:i] in taken for i in range(STEM[0], len(s))):
            taken.add(s)
            beginnings |= {s[:i] for i in range(STEM[0], len(s))}
    model = Model({s: min(1.0, odds[s] / 4) for s in sorted(taken)})
    x = np.array([(1.0, *model.features(t)) for t, _ in rows])
    y = np.array([label for _, label in rows], float)
    each = np.array(weights)[y.astype(int)]
    each = each / each.mean()
    w = np.array((math.log((each * y).sum() / (each * (1 - y)).sum()), 0.0, 0.0, 0.0))
    for _ in range(60):  # Newton steps of ridge logistic regression, of length 1 at most
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (each * (p - y)) + 0.5 * (w - np.array((w[0], *CURVE)))
        hess = (x * (each * p * (1 - p) + 1e-9)[:, None]).T @ x + 0.5 * np.eye(4)
        step = np.linalg.solve(hess, grad)
        w = w - step / max(1.0, float(np.abs(step).max()))
    # one half is put where the sample's F1 is best, midway between the scores on either side
    z = x @ w
    order = np.argsort(-z, kind="stable")
    hit, all_ = np.cumsum((each * y)[order]), np.cumsum(each[order])
    f1 = np.where(np.append(z[order][:-1] > z[order][1:], True), 2 * hit / (all_ + hit[-1]), 0.0)
    cut = int(f1.argmax())
    w[0] -= (z[order[cut]] + z[order[min(cut + 1, len(z) - 1)]]) / 2
    model.curve = tuple(float(v) for v in w)
    return model


def _score(model):
    def run(batches):
        m = model.value
        for b in batches:
            at = b.schema.names.index("_text")
            s = [m.score(t) for t in b.column(at).to_pylist()]
            keep = [i for i in range(b.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), pa.array(s, pa.float64()), pa.array([int(v >= 0.5) for v in s], pa.int32())], names=[*(b.schema.names[i] for i in keep), "score", "predicted"])

    return run


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")), F.lit(5)) == 0, F.lit(False))


def score_toxicity(docs: DataFrame, labels: DataFrame, keep: list[str], id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = 3000) -> DataFrame:
    """The columns to keep of docs, score and predicted; labels: columns id_col and label_col (0 or 1).

    The sample is drawn from the labels alone, by a hash of the id; only its rows' texts are read for learning.
    """
    spark = docs.sparkSession
    own = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("label")).filter("_id is not null and label in (0, 1)")
    n = {r.label: r.n for r in own.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = F.coalesce(*[F.when(F.col("label") == k, F.lit(min(1.0, per_class / v))) for k, v in n.items()], F.lit(0.0))
    some = own.filter(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < share * 1_000_000).distinct()  # about per_class rows of each label
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("text")).join(F.broadcast(some), "_id").filter("text is not null").select("label", "text", F.xxhash64("text").alias("h")).collect() if n else []
    model = learn([(r.text, r.label) for r in sorted(rows, key=lambda r: (r.h, r.label, r.text))], tuple(max(1.0, n.get(k, 0) / per_class) for k in (0, 1)))
    src = docs.select(*without(keep, "score", "predicted", "_text"), text.alias("_text"))
    schema = src.drop("_text").withColumns({"score": F.lit(0.0), "predicted": F.lit(0)}).schema
    return src.mapInArrow(_score(spark.sparkContext.broadcast(model)), schema)


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    docs = with_columns_free(docs, "score", "predicted", "held_out").withColumn("held_out", held_out())
    return score_toxicity(docs, labels.filter(~held_out()), ["doc_id", "held_out"])
