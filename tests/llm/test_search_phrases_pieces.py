"""Encoding against the library, collocations and ranked search against brute force, on small tables with odd rows."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from waymill.llm import phrases, pieces, search

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [None, "", " ", "  two  spaces \n\t tab ", "a▁b", "The quick brown fox, the quick brown dog; the quick brown fox!", "日本語🙂 é é \x00\x01", " " * 300 + "x" + " " * 70, "z" * 5000, "naïve façade ½ ﬁ", "The quick brown fox, the quick brown dog; the quick brown fox!"]


@pytest.fixture(scope="module")
def encoder():
    with open(MODEL, "rb") as f:
        return pieces.Encoder(f.read())


def test_encoding_equals_the_library(encoder):
    r = random.Random(3)
    letters = ["   ▁ abcdefghinorst", " \n\t\x00\x01aA1", "éàüß中日本🙂́a ", "▁ ", "the qu ick", "0123456789 "]
    made = ["".join(r.choice(letters[k % 6]) for _ in range(r.randint(0, 60))) for k in range(3000)]
    made += ["".join(r.choice(encoder.text) for _ in range(r.randint(1, 12))) for _ in range(3000)]
    for t in [*filter(None, TEXTS), *made]:
        assert encoder.encode(t) == encoder.sp.encode(t), t


def test_neighbours_fit_exactly_if_merging_leaves_them_apart(encoder):
    r = random.Random(5)
    blank = [i for i, p in enumerate(encoder.text) if p.strip("▁") == "" and p in encoder.number]
    every = list(encoder.number.values())
    for k in range(20_000):
        a, b = (r.choice(blank), r.choice(blank)) if k % 50 == 0 else (r.choice(every), r.choice(every))
        two = [encoder.text[a], encoder.text[b]]
        assert encoder.fits(a, b) == (encoder.merged("".join(two)) == two)


def test_backtracking_takes_pieces_back(encoder):
    """Longest matches alone give other pieces than the library for many words; the result still is the library's."""
    r, greedy = random.Random(8), 0
    for _ in range(2000):
        t = "".join(r.choice("aehinorstl") for _ in range(r.randint(4, 14)))
        want = encoder.known("▁" + t)
        longest = encoder.known("▁" + t[: max(1, len(t) - 1)])
        greedy += want[: len(longest) - 1] != longest[:-1]
        assert want == encoder.sp.encode(t)
    assert greedy > 0


def test_encode_and_decode_rows(spark, encoder):
    rows = [(i, t, "x", [1]) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _new string, ids array<int>")
    with open(MODEL, "rb") as f:
        model = f.read()
    out = {r.doc_id: r for r in pieces.decode_ids(pieces.encode_texts(docs, model), model).collect()}
    for i, t, *_ in rows:
        ids = encoder.sp.encode(t or "")
        assert out[i].ids == ids and out[i].decoded == (encoder.sp.decode(ids) if ids else "") and out[i]._new == "x"
    got = pieces.query(docs.select("doc_id", "text"), MODEL).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in got:
        ids = encoder.sp.encode(TEXTS[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha(",".join(map(str, ids)))) and r.decoded_sha256 == sha(encoder.sp.decode(ids) if ids else "")
    assert pieces.query(docs.select("doc_id", "text").limit(0), MODEL).collect() == []
    assert pieces.decode_ids(spark.createDataFrame([(None,), ([None, 28705],)], "ids array<int>"), model).filter("decoded is null").count() == 0


def test_models_that_are_too_large_are_refused(spark):
    with pytest.raises(ValueError):
        pieces.model_bytes(spark, MODEL, most_bytes=100)


# ---- collocations


def brute_phrases(rows, least, inside, top):
    n, f = Counter(), defaultdict(Counter)
    for lang, text in rows:
        lang = lang or "und"
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = [x for x in re.split("[ \t]", piece) if x]
            n[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        rank = []
        for p, a in cand.items():
            score, k = min((1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            longer = [b for q, b in cand.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if not any(100 * b >= inside * a for b in longer):
                rank.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rank)[:top])]
    return sorted(out)


@pytest.mark.parametrize("limits", [{}, {"shards": 3, "most_bits": 1 << 20}, {"shards": 5}, {"shards": 1}])
def test_collocations_equal_brute_force(spark, monkeypatch, limits):
    r = random.Random(6)
    words = "Alpha beta GAMMA delta it's é\x85x épsilon".split(" ")
    rows = [(r.choice(["en", "fr", None]), "".join(r.choice(words) + r.choice([" ", " ", " ", "\t", ", ", ".\n", "  "]) for _ in range(r.randint(0, 40)))) for _ in range(300)]
    rows += [("en", None), ("en", ""), (None, "..,;"), ("de", "lonely words here")] + [("es", "uno dos tres cuatro")] * 40
    docs = spark.createDataFrame([(a, b, 0) for a, b in rows], "lang string, text string, n int")
    got = sorted(tuple(x) for x in phrases.collocations(docs, least=6, top=50, **limits).collect())
    assert got == brute_phrases(rows, 6, 50, 50) and len(got) > 50
    assert phrases.collocations(docs.limit(0)).collect() == []


def test_small_chunks_and_full_filters_lose_nothing(spark, monkeypatch):
    """A filter of so few bits that all of them are set lets everything pass; counts stay exact."""
    monkeypatch.setattr(phrases, "filter_size", lambda reached, most: 64)
    r = random.Random(7)
    rows = [("en", " ".join(r.choice("abcdefgh") for _ in range(12))) for _ in range(200)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    got = sorted(tuple(x) for x in phrases.collocations(docs, least=5).collect())
    assert got == brute_phrases(rows, 5, 50, 2000)


def test_a_phrase_is_counted_once_a_shard_wherever_it_becomes_active():
    """The chunks' own counts: what the filter of one cycle before let pass is not counted again."""
    c = phrases.Counted("en")
    for _ in range(3):
        c.add(phrases.words_of("a b c. a b"))
    full = np.full(16, 2**64 - 1, np.uint64)
    first = {p: n for ps, ns, _ in c.phrases(3, True, full) for p, n in zip(ps.to_pylist(), ns.tolist(), strict=True)}
    assert first == {b"": 15, b"a": 6, b"b": 6, b"c": 3, b"a b": 6, b"b c": 3, b"a b c": 3}
    assert {p for ps, *_ in c.phrases(3, False, full, full, full) for p in ps.to_pylist()} == set()


def test_words_and_hashes_at_once_equal_those_one_by_one():
    texts = [*TEXTS, "A.b,,c\x0b\x0cd \t e\r\nf", "x" * 300 + "é" * 300, "ÀB\xa0c\x85d", "end."]
    assert phrases.listed(texts).to_pylist() == [w for t in texts for w in phrases.words_of(t)]
    rows = [(lang, p) for p in ("a", "a b", "a b c", "é ß", "b", "c a b a") for lang in ("en", "fr", "und")]
    want = []
    for lang, p in rows:
        own = phrases.word_hashes(lang, p.encode().split(b" "))
        h = own[:1]
        for i in range(1, len(own)):
            h = phrases.mixed(h, own[i : i + 1])
        want += h.tolist()
    assert phrases.phrase_hashes(pa.array([a for a, _ in rows]), pa.array([b for _, b in rows])).tolist() == want
    assert len(phrases.phrase_hashes(pa.array([], pa.string()), pa.array([], pa.string()))) == 0


def test_scores_beyond_64_bits(spark):
    """Counts of ten billions: products pass 64 bits and stay exact."""
    rows = [("en", "x y", 10_000_000_019), ("en", "x", 30_000_000_077), ("en", "y", 20_000_000_089), ("en", "", 50_000_000_171)]
    counts = spark.createDataFrame(rows, "lang string, phrase string, n long")
    kept = phrases.count_phrases
    try:
        phrases.count_phrases = lambda *a, **k: counts
        got = phrases.collocations(counts).collect()
    finally:
        phrases.count_phrases = kept
    a = 10_000_000_019
    assert [(r.score, r.a, r.n) for r in got] == [(1_000_000 * a * a // (30_000_000_077 * 20_000_000_089), a, 50_000_000_171)]


# ---- search


def brute_search(docs, items, top):
    term = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    own = [(i, k, Counter(term(t))) for k, (i, t) in enumerate(docs)]
    n_docs, length = sum(bool(c) for *_, c in own), sum(sum(c.values()) for *_, c in own)
    df = Counter(t for *_, c in own for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, _, c in own:
            s = 0
            for t in set(term(text)):
                if c[t]:
                    m = 50 + (50 * sum(c.values()) * n_docs) // length
                    s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m))
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, k + 1, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("limits", [{}, {"shard_rows": 16, "item_rows": 2, "owners": (0.02, 0.3)}, {"shard_rows": 40, "most_terms": 5}, {"owners": ()}])
def test_ranking_equals_brute_force(spark, limits):
    r = random.Random(9)
    words = [f"w{int(r.expovariate(0.08))}" for _ in range(400)] + ["Élan", "x_y", "ab-cd"]
    docs = [(k, " ".join(r.choice(words) for _ in range(r.randint(0, 60)))) for k in range(150)] + [(200 + k, "w1 W2 w3 copied") for k in range(60)] + [(None, "w1 w2 w3 copied"), (7, "w1 w2 w3 copied"), (8, None), (9, "...")]
    r.shuffle(docs)
    items = [(f"i{k}", " ".join(r.choice(words) for _ in range(8))) for k in range(7)] + [("copies", "w1, w2; w3 copied copied"), ("none", "absent"), ("empty", ""), (None, None), ("copies", "w1 w2 w3 copied")]
    d = spark.createDataFrame([(a, b, "z") for a, b in docs], "doc_id long, text string, row string")
    q = spark.createDataFrame(items, "item_id string, text string")
    got = sorted((tuple(x) for x in search.ranked(d, q, top=20, **limits).collect()), key=repr)
    assert got == brute_search(docs, items, 20)


def test_search_of_empty_tables(spark):
    d, q = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([("i", "a")], "item_id string, text string")
    assert search.query(d.limit(0), q).collect() == [] and search.query(d, q.limit(0)).collect() == []
    assert search.query(d.withColumn("text", F.lit("...")), q).collect() == []


def test_what_cannot_win_is_left_out_and_ties_stay():
    score = np.array([10, 7, 7, 3, 1])
    assert search.left_over(score, 2, 0).tolist() == [True, True, True, False, False]
    assert search.left_over(score, 2, 4).tolist() == [True, True, True, True, False]
    assert search.left_over(score, 5, 0).all()
