"""The operators of waymill.llm against brute force, on small tables with nulls, empty and long texts, ties and repeats."""

import functools
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from waymill.llm import decontam, fingerprint, htmltext, langid, linededup, mixing, neardup, pii, simhash, toxicity, urlfilter
from waymill.llm.graph import connected_components
from waymill.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words string, score string, fp string, block string"


def docs(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "en" if i % 2 else None, f"s{i % 3}" if i % 5 else None, len(t or ""), "x", "x", "x", "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


EDGE = [None, "", " \n\t ", "one", prose(1, 400), prose(1, 400), prose(1, 399) + " other", "é" * 50 + "\n" + "É" * 50, "A line of some length\nshort\nA line of some length", "  a LINE of some length \nx", prose(2, 20_000), "1" * 30_000, "@" * 500]


def test_lines(spark):
    got = {r.doc_id: r for r in linededup.dedup_lines(docs(spark, EDGE)).collect()}
    owner = {}
    strip = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    for i, t in enumerate(EDGE):
        for line in (t or "").split("\n"):
            owner.setdefault(strip(line), i)
    for i, t in enumerate(EDGE):
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(strip(x)) < 10 or owner[strip(x)] == i]
        assert (got[i].n_lines, got[i].n_dropped, got[i].kept_text) == (len(lines), len(lines) - len(kept), "\n".join(kept))
        assert got[i].text == t


def test_perfect_hash_is_minimal():
    h = np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64)
    f = h[::-1].copy()
    h[:100] = h[0]  # equal first hashes are told apart by the second
    levels = linededup.build_mph(h, f)
    assert sorted(linededup.rank_mph(levels, h, f)) == list(range(5000))


def test_lines_with_hot_shard_and_null_ids(spark):
    texts = ["the same line everywhere\nown line number %d here" % i for i in range(300)]
    got = linededup.dedup_lines(docs(spark, texts, [None, *range(1, 300)]), least_shards=4).collect()
    assert sum(r.n_dropped for r in got) == 299 and next(r for r in got if r.doc_id == 1).n_dropped == 0


def brute_hits(text, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    w, hit, own = words(text), set(), set()
    for item, t in items:
        v = words(t)
        for i in range(max(1, len(v) - window + 1) if v else 0):
            x = v[i : i + window]
            for j in range(len(w) - len(x) + 1):
                if w[j : j + len(x)] == x:
                    hit.update(range(j, j + len(x)))
                    own.add(str(item))
    return len(w), len(hit), sorted(own)


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_decontamination(spark, block_bytes):
    items = [(1, prose(5, 30)), (2, "Short item"), (3, None), (4, "..."), (5, prose(5, 12)), (6, "mu")]
    texts = [*EDGE[:10], "x " + prose(5, 30) + " y", "a SHORT, item!", prose(5, 12)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontam.find_contaminated(docs(spark, texts), bench, block_bytes=block_bytes).collect()}
    for i, t in enumerate(texts):
        assert (got[i].n_words, got[i].n_hit, got[i].hit_items) == brute_hits(t, items)


def test_tables_of_test_items_are_compact():
    r = random.Random(1)
    items = [(str(i), " ".join(r.choice(WORDS) + str(r.randrange(999)) for _ in range(200))) for i in range(500)]
    tables = decontam.Tables(decontam.windows_of(items, 10))
    assert tables.nbytes() < 7 * sum(len(t) for _, t in items) and len(tables.at) == 500 * 191


def test_one_block_of_test_items_in_a_task(spark):
    bench = spark.createDataFrame([(i, prose(500 + i, 30)) for i in range(40)], "item_id long, text string")
    rows = docs(spark, [prose(500 + i, 30) for i in range(0, 50, 5)])
    for limits in ({"block_bytes": 1000}, {"block_bytes": 1000, "most_broadcast": 0}):
        out = decontam.find_contaminated(rows, bench, **limits)
        assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
        assert {r.doc_id: r.n_hit for r in out.collect()} == {i: 30 * (5 * i < 40) for i in range(10)}


def brute_components(texts):
    fps = np.array([simhash.fingerprint(t) for t in texts], np.uint64)
    label = list(range(len(texts)))
    for _ in texts:
        for i in range(len(texts)):
            label[i] = min(label[j] for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 4))
    return label


def test_fingerprint_by_definition():
    words = prose(9, 40).split()
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]), 42) for i in range(37)]
    assert simhash.fingerprint(" ".join(words)) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > 37)
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


def test_spark_hash_agrees(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("alpha beta"))).first()[0] % 2**64 == xxhash.xxh64_intdigest("alpha beta", 42)


def test_simhash(spark):
    near = [prose(3, 300).split() for _ in range(40)]
    for i, w in enumerate(near):
        w[i * 7 % 300] = f"changed{i}"
    texts = [*EDGE, *(" ".join(w) for w in near)]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts)


def test_chunks_of_long_runs_lose_no_link(spark):
    r = np.random.default_rng(4)
    base = int(r.integers(0, 2**62))
    fps = sorted({base ^ int(sum(1 << int(b) for b in r.choice(12, 3, replace=False))) for _ in range(150)})
    frame = spark.createDataFrame([(x,) for x in fps], "fp long")
    roots = {x.node: x.root for x in connected_components(simhash.link_fingerprints(frame, run=16)).collect()}
    assert len(set(roots.values())) == 1 and len(roots) == len(fps)


def test_bit_slices_equal_popcounts():
    r = np.random.default_rng(2)
    fp = (np.uint64(r.integers(0, 2**62)) ^ (np.uint64(1) << r.integers(0, 10, 300).astype(np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, 300).astype(np.uint64))).astype(np.uint64)
    run = np.sort(r.integers(0, 5, 300))
    got, want = simhash.link_runs(run, fp), list(range(300))
    for _ in range(300):
        want = [min(want[j] for j in range(300) if run[i] == run[j] and int(fp[i] ^ fp[j]).bit_count() <= 4) for i in range(300)]
    assert list(got) == want


def test_components_of_a_path(spark):
    order = list(range(200))
    random.Random(1).shuffle(order)
    got = connected_components(spark.createDataFrame(list(zip(order, order[1:], strict=False)), "a long, b long")).collect()
    assert {r.root for r in got} == {0} and len(got) == 200


def check_schedule(out, share, block_rows):
    assert ((out.slot >= out.release) & (out.slot < out.deadline)).all()
    assert not out.duplicated(["slot", "place"]).any() and out.place.max() < block_rows
    name = out.source.fillna("null")
    ends = out.groupby(name).slot.max()
    for t in range(1, int(ends.min())):
        done = out[out.slot < t].groupby(name[out.slot < t]).slot.nunique()
        assert all(abs(done.get(s, 0) - w * t) < 1 + 1e-9 for s, w in share.items())


def test_mixing(spark):
    rows = docs(spark, [prose(i, 5) for i in range(900)])
    share = {"s0": 0.5, "s1": 0.3, "s2": 0.15, "null": 0.05}
    out = mixing.mix(rows, {k if k != "null" else None: w for k, w in share.items()}, block_rows=4, bucket_rows=64).toPandas()
    assert len(out) == 900 and out.doc_id.nunique() == 900 and list(out.columns).count("block") == 1
    check_schedule(out, share, 4)


def fair(w, blocks):
    """Runs the schedule: each block once and in its window, and less than a block off its share while a source lasts."""
    had, before, ends = [0] * len(w), -1, {}
    for k, i, t, release, due in mixing.schedule(w, blocks):
        assert i == had[k] and before < t and release <= t < due and release == int(i / w[k]) and due == -int(-(i + 1) // w[k])
        before, had[k] = t, i + 1
        if had[k] == blocks[k]:
            ends[k] = t
    assert had == blocks and len(ends) == sum(b > 0 for b in blocks)


def test_schedules_of_random_weights():
    r = random.Random(4)
    for n in range(1000):
        m = r.choice((1, 2, 3, 5, 12)) if n % 50 else 200
        weights = {k: 10 ** r.uniform(-9, 0) for k in range(m)}
        w = mixing.shares(weights, list(range(m)))
        fair(w, [r.choice((0, 1, 3, r.randrange(1, 60), int(min(200, 1 + 150 * float(x))))) for x in w])


@pytest.mark.parametrize("weights", [[1, 1, 1], [10, 37**0.5, 5**0.5], [1, 1e-4, 0.3], [1, 2], [10**4.5, (3e8) ** 0.5, 1e3, 10]])
def test_every_prefix_of_the_schedule_is_fair(weights):
    w = mixing.shares(dict(enumerate(weights)), list(range(len(weights))))
    blocks = [-int(-40_000 * x // 1) for x in w]
    fair(w, blocks)
    had, least = [0] * len(w), min(int(b / x) for b, x in zip(blocks, w, strict=True))
    for k, _, t, _, _ in mixing.schedule(w, blocks):
        if t >= least:
            break
        had[k] += 1
        assert all(abs(had[j] - w[j] * (t + 1)) < 1 for j in range(len(w)))


@pytest.mark.parametrize("weights", [None, {"a": 1, "b": 1e-6, "c": 0.5}])
def test_a_source_of_three_rows_has_its_slots(spark, weights):
    rows = spark.range(60_003).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 3, "b").when(F.col("id") % 3 == 0, "c").otherwise("a").alias("source"), F.lit("x").alias("text"))
    out = mixing.mix(rows, weights, block_rows=1).toPandas()
    assert len(out) == 60_003 and out.notna().all().all() and not out.slot.duplicated().any() and (out.place == 0).all()
    assert ((out.slot >= out.release) & (out.slot < out.deadline)).all()
    assert len(mixing.mix(rows, weights, most_blocks=100).groupBy("slot").count().collect()) <= 103


def test_mixing_refuses_bad_weights_and_too_many_sources(spark):
    for w in (0, -1, float("nan"), float("inf")):
        with pytest.raises(ValueError):
            mixing.shares({"a": 1, "b": w}, ["a", "b"])
    with pytest.raises(ValueError):
        mixing.mix(docs(spark, ["x"] * 9), most_sources=2)


def test_mixing_of_odd_rows(spark):
    assert mixing.mix(docs(spark, [])).collect() == []
    texts, ids = [*EDGE, *["same text"] * 70], [*[None] * 5, *range(5, len(EDGE)), *[7] * 60, *[None] * 10]
    out = mixing.mix(docs(spark, texts, ids), {"s0": 1, "s1": 1, "s2": 1, None: 1, "absent": 3}, block_rows=4, bucket_rows=8).toPandas()
    assert len(out) == len(texts) and out.text.isna().sum() == 1 and (out.text == "same text").sum() == 70
    check_schedule(out, {"s0": 0.25, "s1": 0.25, "s2": 0.25, "null": 0.25}, 4)
    again = mixing.mix(docs(spark, texts, ids), {"s0": 1, "s1": 1, "s2": 1, None: 1, "absent": 3}, block_rows=4, bucket_rows=8).repartition(3).toPandas()
    key = ["doc_id", "text", "source", "slot", "place"]
    assert sorted(map(str, out[key].values.tolist())) == sorted(map(str, again[key].values.tolist()))


def test_base_spans():
    s = "a@b a.b+c@x-y.de, ip 1.2.3.256 10.0.0.1 card 4111 1111 1111 1111 no 4111111111111112 tel +1 (415) 555-2671. x@y.z@q.w.v"
    got = [(pii.KINDS[k], s[a:b]) for k, a, b in pii.base_spans(s)]
    email = [m[0] for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", s)]
    assert [x for k, x in got if k == "email"] == email
    assert [x for k, x in got if k == "ip"] == ["10.0.0.1"] and [x for k, x in got if k == "card"] == ["4111 1111 1111 1111"]
    assert [x for k, x in got if k == "phone"] == ["+1 (415) 555-2671"]


def test_emails_equal_the_pattern():
    r = random.Random(3)
    for _ in range(3000):
        s = "".join(r.choice("ab@@..-% é1") for _ in range(30))
        assert list(pii.emails(s)) == [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", s)]


def personal(seed):
    r = random.Random(seed)
    return f"{prose(seed, 30)} kate.{r.randrange(99)}@mail{r.randrange(9)}.example.com {prose(seed + 1, 20)} +1 ({r.randrange(100, 999)}) 555-{r.randrange(1000, 9999)} {prose(seed + 2, 20)} {r.randrange(1, 255)}.{r.randrange(255)}.7.{r.randrange(255)} {prose(seed + 3, 20)} 4111 1111 1111 1111 {prose(seed + 4, 30)}"


@pytest.fixture(scope="module")
def tagger():
    texts = [personal(k * 10) + f' {WORDS[k % 12]} token = "{hashlib.sha1(str(k).encode()).hexdigest()}" {prose(k, 20)}' for k in range(120)]
    return pii.Tagger().fit(*pii.training_windows(texts, 6000))


def test_tagger_finds_the_labels_themselves(tagger):
    texts = [personal(5000 + k * 10) for k in range(60)]
    for kind in range(4):
        want = [{s for s in pii.base_spans(t) if s[0] == kind} for t in texts]
        assert sum(bool(w & set(f)) for w, f in zip(want, pii.tag(tagger, texts), strict=True)) >= 57


def test_tagger_learns_what_the_patterns_miss(spark, tagger):
    hidden = [f"{prose(k, 40)} (415) 555-{2000 + k} {prose(k + 1, 40)}" for k in range(40)]
    found = sum(any(kind == 3 for kind, _, _ in s) for _, s in pii.all_spans(tagger, hidden))
    assert found >= 36
    keys = [f'{prose(k, 40)} api_key = "{hashlib.sha1(str(900 + k).encode()).hexdigest()}" {prose(k + 1, 40)}' for k in range(40)]
    assert sum(pii.TAGGED[s[0][0]] == "secret" for _, s in pii.all_spans(tagger, keys) if s) >= 36
    clean = [f"{prose(k, 60)} 0{k}ab99f0e1c2d3 and version 2.{k}. {prose(k + 1, 60)}" for k in range(60)]
    assert sum(bool(s) for _, s in pii.all_spans(tagger, clean)) <= 1
    texts = [personal(k * 10) for k in range(120)]
    out = pii.find_personal_data(docs(spark, [*EDGE, *texts]), ["doc_id"], windows=600).collect()
    assert len(out) == len(EDGE) + 120 and all(r.n_email == 1 and r.n_phone == 1 and r.n_ip == 1 and r.n_card == 1 for r in out if r.doc_id >= len(EDGE))
    assert all(r.n_spans == (r.spans.count(",") + 1 if r.spans else 0) >= sum((r.n_email, r.n_ip, r.n_card, r.n_phone)) for r in out)
    assert pii.find_personal_data(docs(spark, []), ["doc_id"]).collect() == []


def test_tagger_finds_spelled_addresses(tagger):
    forms = ["kate at mail dot example dot com", "kate (at) mail dot example dot com", "kate [at] mail.example.com", "kate @ mail.example.com"]
    hidden = [f"{prose(k, 40)} {forms[k % 4]} {prose(k + 1, 40)}" for k in range(40)]
    found = [any(kind == 0 and t[a:b] == forms[k % 4] for kind, a, b in s) for k, (t, (_, s)) in enumerate(zip(hidden, pii.all_spans(tagger, hidden), strict=True))]
    assert sum(found) >= 28 and all(any(found[k::4]) for k in range(4))


def test_overlapping_windows_agree_with_one_undivided_decode(tagger):
    """Stretches scored in windows and decoded as a whole, against one window as long as the text."""
    texts = [personal(9000 + k * 10) + " " + personal(9500 + k) for k in range(20)]
    whole = []
    for t in texts:
        c = pii.classes(t)[None]
        whole.append(pii.spans_of(t, 0, tagger.viterbi(tagger.emissions(c), np.array([len(t)]))[0]))
    got = pii.tag(tagger, texts)
    want = sum(map(len, whole))
    assert want > 120 and sum(len(set(a) & set(b)) for a, b in zip(whole, got, strict=True)) >= 0.95 * want
    # neither the other texts of a call nor its size change a text's spans
    assert got == [pii.tag(tagger, [t])[0] for t in texts] == pii.tag(tagger, texts, at_once=8)


def test_one_long_stretch_does_not_pad_the_others(tagger):
    import tracemalloc

    texts = ["7" * 60_000, *[f"{prose(k, 30)} 12 {prose(k, 30)}" for k in range(400)]]
    tracemalloc.start()
    pii.tag(tagger, texts, at_once=256)
    assert tracemalloc.get_traced_memory()[1] < 60e6
    tracemalloc.stop()


def test_gradients_of_the_tagger():
    m = pii.Tagger(4, 1)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    r = np.random.default_rng(0)
    x, y = r.integers(0, 20, (3, 6)), r.integers(0, pii.TAGS, (3, 6))
    _, g = m.gradients(x, y)
    for key in ("W", "T", "Uf", "Xb", "c"):
        at = (1,) if key == "c" else (0 if key != "Xb" else int(x[0, 0]), 1)
        old = m.p[key][at]
        m.p[key][at] = old + 1e-3
        up = m.gradients(x, y)[0]
        m.p[key][at] = old - 1e-3
        assert abs((up - m.gradients(x, y)[0]) / 2e-3 - g[key][at]) < 2e-3
        m.p[key][at] = old


PAGE = "<html><head><title>t</title><script>var a='<p>no</p>'</script></head><body><nav><a>menu</a></nav><div class='cookie-notice'>we use cookies</div><article><h1>Head</h1><p>One &amp; two<br>three<p>Four  five</p><aside>side</aside></article><div id=comments><p>nice</p></div><footer>foot</footer>"


def texts_of(spark, pages, **limits):
    """pages: html, or (host, html)."""
    rows = [(i, f"http://{p[0]}/x" if isinstance(p, tuple) else "http://h.example/x", p[1] if isinstance(p, tuple) else p, "x", "y") for i, p in enumerate(pages)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, main_text string, _host string").repartition(3)
    got = {r.page_id: r.main_text for r in htmltext.extract(frame, ["page_id"], **limits).collect()}
    return [got[i] for i in range(len(pages))]


def test_html_structure(spark):
    head = "<article><header class='entry-header'><h1>Head</h1></header><p>Text</p><footer>by us</footer></article><header>Site</header>"
    plain = '<body class="single no-sidebar widget"><article class="post popular-science"><p>The story.</p></article>'
    marked = '<main><div class="cookie-notice">c</div><div class="ad">a</div><div class="post-comments">n</div><p class="popular-science">Text</p></main>'
    replies = '<main><p>Text</p></main><article class="comment">nice</article>'
    assert texts_of(spark, [PAGE, "", None, "<p>", "plain &am text", head, plain, marked, replies]) == ["Head\nOne & two three\nFour five", "", "", "", "plain &am text", "Head\nText", "The story.", "Text", "Text"]
    assert htmltext.extract(spark.createDataFrame([], "page_id long, url string, html string"), ["page_id"]).collect() == []


FRAME = "this text stands on every page of the host and says nothing at all"


@pytest.mark.parametrize("limits", [{}, {"most_broadcast": 0}, {"most_words": 1}])
def test_html_repeated_runs(spark, limits):
    plain = [f"<div>{FRAME}</div><div>{prose(i, 30)}</div>" for i in range(6)]
    assert texts_of(spark, plain, **limits) == [prose(i, 30) for i in range(6)]
    # nothing goes from an article, whatever the host repeats: headings that are titles elsewhere, prose that adverts quote
    own = [f"<h1>{prose(40, 9)}</h1><p>{prose(50 + i, 30)}</p><p>{FRAME}</p>" for i in range(6)] * 2
    pages = [f"<title>{prose(40, 9)}</title><div class=ad>{prose(50, 30)}</div><div>{FRAME}</div><article>{x}</article><div>{i}</div>" for i, x in enumerate(own)]
    assert texts_of(spark, pages, **limits) == [f"{prose(40, 9)}\n{prose(50 + i, 30)}\n{FRAME}" for i in range(6)] * 2
    # what stands outside of articles is evidence for an open page of the host; a title is none
    mixed = [pages[0], f"<title>{prose(60, 20)}</title><div>{FRAME}</div><div>before {FRAME} after</div><div>{prose(60, 20)}</div>", f"<title>{prose(60, 20)}</title><article>x</article>"]
    assert texts_of(spark, mixed, **limits) == [f"{prose(40, 9)}\n{prose(50, 30)}\n{FRAME}", f"before after\n{prose(60, 20)}", "x"]
    # one page, or equal pages, or pages of other hosts are no evidence; a page that others hold wholly stays
    assert texts_of(spark, [mixed[1]] * 3 + [("other.example", plain[0])], **limits) == [f"{FRAME}\nbefore {FRAME} after\n{prose(60, 20)}"] * 3 + [f"{FRAME}\n{prose(0, 30)}"]
    copies = [f"<p>{prose(9, 60)}</p><i>{i}</i>" for i in range(4)]
    assert texts_of(spark, copies, **limits) == [f"{prose(9, 60)}\n{i}" for i in range(4)]


def longest_repeats(streams, own):
    """By a full suffix array with its LCPs: for each place, how many words from there on a stream of another page has too."""
    suffixes = sorted((s[i:], own[k], k, i) for k, s in enumerate(streams) for i in range(len(s)))
    lcp = lambda a, b: next((n for n, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    out = [[0] * len(s) for s in streams]
    for step in (1, -1):
        order = suffixes[::step]
        for n, (s, page, k, i) in enumerate(order):
            for other, whose, _, _ in order[n + 1 :]:
                if whose != page:
                    out[k][i] = max(out[k][i], lcp(s, other))
                    break
    return out


def test_runs_of_a_large_host_equal_a_full_suffix_array(spark):
    """1,000 pages of one host in three batches or more, and the words that a full suffix array with LCPs covers."""
    r = random.Random(8)
    runs = [" ".join(r.choice(WORDS) for _ in range(r.randrange(5, 14))) for _ in range(25)]
    bodies = [" ".join(f"w{n}x{k}" if r.random() < 0.8 else r.choice(runs) for k in range(25)) for n in range(1000)]
    streams = [b.split() for b in bodies]
    got = texts_of(spark, [f"<div>{b}</div>" for b in bodies])
    reach = longest_repeats(streams, range(1000))
    for s, lcp, text in zip(streams, reach, got, strict=True):
        hit = [any(lcp[j] >= 8 and j + lcp[j] > i for j in range(i + 1)) for i in range(len(s))]
        assert text == " ".join(w for w, x in zip(s, hit, strict=True) if not x)


def test_suffix_ranks_equal_brute_force():
    r = np.random.default_rng(1)
    streams = [r.integers(0, 3, int(n)).astype(np.uint64) for n in r.integers(0, 60, 8)]
    own = np.array([0, 1, 2, 3, 3, 4, 5, 6])
    s, place, page, twice = htmltext.repeats(streams, own, 5)
    want = {}
    for k, x in enumerate(streams):
        for i in range(len(x) - 4):
            want.setdefault(tuple(x[i : i + 5]), set()).add(own[k])
    got = {tuple(streams[a][b : b + 5]): (c, d) for a, b, c, d in zip(s, place, page, twice, strict=True)}
    assert got == {g: (min(v), len(v) > 1) for g, v in want.items()}


def test_the_array_of_a_host_tells_shared_runs_by_its_neighbours():
    """Heads of batches, merged in order and cut anywhere: LCPs as of strings, and each run of two distinct pages once."""
    r = np.random.default_rng(2)
    rows = sorted((int(r.integers(0, 3)), tuple(map(int, r.integers(0, 3, 4))), int(p)) for p in r.integers(-1, 4, 400))  # page -1: two distinct ones
    host, words = np.array([h for h, *_ in rows], np.uint64), np.array([w for _, w, _ in rows], np.uint64)
    lcp = htmltext.prefixes(host, words)
    for (g, v, _), (h, w, _), n in zip(rows, rows[1:], lcp[1:], strict=False):
        assert n == (0 if g != h else next((i for i in range(4) if v[i] != w[i]), 4))
    pages = {}
    for h, w, p in rows:
        pages.setdefault((h, w), set()).update((p,) if p >= 0 else (-1, -2))
    both = [k for k, v in pages.items() if len(v) > 1]
    want = htmltext.hashed(np.array([h for h, _ in both], np.uint64), np.array([w for _, w in both], np.uint64)).view(np.int64)
    for size in (1, 2, 7, 400):
        cut = [rows[i : i + size] for i in range(0, len(rows), size)]
        batch = lambda c: pa.record_batch([pa.array([h for h, *_ in c]), pa.array([np.array(w, ">u8").tobytes() for _, w, _ in c]), pa.array([p if p >= 0 else None for *_, p in c], pa.int64())], names=["host", "head", "page"])
        assert [x for b in htmltext._shared(4)(map(batch, cut)) for x in b.column(0).to_pylist()] == want.tolist()


def test_sketches(spark):
    texts = [*EDGE[:10], prose(4, 900), prose(4, 450) + " " + prose(5, 450)]
    got = {r.doc_id: r for r in fingerprint.query(docs(spark, texts)).collect()}
    sh = lambda t: (lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())((t or "").lower().split())
    like = lambda a, b: 1.0 if not a and not b else len(a & b) / len(a | b)
    for i, t in enumerate(texts):
        t, n = t or "", texts[(i - 1) % len(texts)] or ""
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(t)
        assert abs(got[i].near_edited - like(sh(t), sh(edited))) < 0.15 and abs(got[i].near_next - like(sh(t), sh(n))) < 0.15
    assert got[4].fingerprint == got[5].fingerprint
    assert fingerprint.query(docs(spark, [])).collect() == []


def test_sketch_equals_brute_force(spark):
    texts = [*EDGE[:11], prose(4, 900), "a b c d", "a b c d e", " a  b c d e f"]
    signed = lambda x: x - (x >> 63 << 64)
    word = lambda w: signed(xxhash.xxh64_intdigest(w, 42))

    def chained(hashes):
        seed = 42
        for h in hashes:
            seed = xxhash.xxh64_intdigest((h % 2**64).to_bytes(8, "little"), seed)
        return signed(seed)

    for t, r in zip(texts, spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").select("i", fingerprint.sketch(F.col("t")).alias("s")).orderBy("i").collect(), strict=True):
        h = [word(w) for w in re.split(r"\s+", (t or "").lower()) if w]
        runs = {chained(h[i : i + 5]) for i in range(len(h) - 4)} if len(h) > 5 else {functools.reduce(lambda a, x: chained([a, x]), h, 0)} if h else set()
        assert r.s == sorted(runs)[:128]


def test_number_of_range_equals_a_search(spark):
    import bisect

    r = random.Random(2)
    for cuts in ([5], [1, 2, 3], sorted({int(r.gauss(0, 3) ** 15) for _ in range(60)}), [-(2**63), 0, 2**63 - 1]):
        values = [*cuts, *(c + d for c in cuts for d in (-1, 1) if -(2**63) <= c + d < 2**63)]
        got = spark.createDataFrame([(v,) for v in values], "v long").select("v", fingerprint.number_of_range(F.col("v"), cuts).alias("n")).collect()
        assert all(x.n == bisect.bisect_left(cuts, x.v) for x in got)


def test_next_row_without_ids_and_with_repeated_ones(spark):
    ids = [5, 5, 9, 1, None, None, None, None, None, 7, 7]
    texts = [f"text {i} {prose(i, 20)}" for i in range(len(ids))]
    for parts in (2, 3, 50):
        own = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").withColumn("h", F.xxhash64("text"))
        rows = fingerprint.with_next(own, "doc_id", ["text"], parts, "h").collect()
        h = {r.text: r.h for r in rows}
        order = sorted(texts, key=lambda t: (ids[texts.index(t)] is None, -(ids[texts.index(t)] or 0), h[t]))
        assert {r.text: r._next.text for r in rows} == {a: b for a, b in zip(order, order[1:] + order[:1], strict=True)}


def test_sketches_merge_by_group(spark):
    rows = [(i % 2, prose(i // 2 % 40, 60)) for i in range(400)]
    own = spark.createDataFrame(rows, "g int, t string").select("g", fingerprint.sketch(F.col("t")).alias("sketch"))
    want = {}
    for r in own.collect():
        want.setdefault(r.g, set()).update(r.sketch)
    for fan_in in (4, 256):
        assert {r.g: r.sketch for r in fingerprint.merge_parts(own, ["g"], fan_in=fan_in).collect()} == {g: sorted(s)[:128] for g, s in want.items()}


def test_merged_sketch_is_that_of_the_whole(spark):
    df = spark.createDataFrame([(prose(1, 300), prose(2, 300))], "a string, b string").select(fingerprint.sketch(F.col("a")).alias("a"), fingerprint.sketch(F.col("b")).alias("b"))
    r = df.select(fingerprint.merged(F.col("a"), F.col("b")).alias("m"), "a", "b", fingerprint.containment(F.col("a"), F.col("a")).alias("c"), fingerprint.distinct_shingles(F.col("a")).alias("n")).first()
    assert r.m == sorted({*r.a, *r.b})[:128] and r.c == 1.0 and 200 < r.n < 420


def test_language(spark):
    r = QUERIES["op6_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(x.lang == x.lang_pred for x in r) / len(r) > 0.95
    got = {x.doc_id: x for x in langid.query(docs(spark, EDGE)).collect()}
    assert {i for i in got if got[i].lang_pred == "und"} == {0, 1, 2, 11, 12} and all(0 <= x.score <= 1 for x in got.values())
    assert langid.query(docs(spark, [])).collect() == []


def test_url_rules(spark):
    rows = [(1, "https://X.Example.com/en/a?q", ""), (2, "http://www.example.com/en/", ""), (3, "https://a.com/en/", ""), (4, "http://b.net/es/1", None), (5, "no scheme", ""), (6, None, None), (7, "http://c.org/x", '<a href="https://bad.example.com/">'), (8, "https://bad.example.com/en/1", ""), (9, "http://d.org/", "")]
    got = {r.page_id: r for r in urlfilter.query(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("x.example.com", "/en/a", "example.com/en/", "block")
    assert got[2].rule == "www.example.com/en/" and got[2].verdict == "allow" and got[3].rule == "com/"
    assert got[4].rule == "net/es/" and got[5].host == got[6].host == "" and got[6].verdict == "allow"
    assert got[7].rule is None and got[7].verdict == "block" and got[9].verdict == "allow"


@pytest.mark.parametrize("parents", [True, False])
def test_propagation_equals_brute_force(spark, parents):
    """A graph of real links with hubs, a chain of hosts that is reached in round 15 or 34, repeated links and hosts that nothing
    reaches, at the shipped limits."""
    n_chain = 15 if parents else 34
    r = random.Random(4)
    hosts = [f"h{i}.{'abc'[i % 3]}.org" for i in range(40)] + [f"c{i}.net" for i in range(n_chain)] + ["ok.com", "www.example.com", "bad.example.com", "lone.info"]
    links = {(a, b) for a in hosts[:40] for b in r.sample(hosts[:40], 2)} | {(f"c{i}.net", f"c{i + 1}.net") for i in range(n_chain - 1)} | {(f"c{n_chain - 1}.net", "bad.example.com"), ("h1.b.org", "bad.example.com"), ("h2.c.org", "bad.example.com"), ("ok.com", "h3.a.org"), ("ok.com", "h4.b.org")}
    links = {(a, b) for a, b in links if a != b}
    rows = [(n, f"http://{a}/{'en/' if a == 'bad.example.com' else ''}p", " ".join(f'<a HREF="//{b.upper()}/x">' for s, b in links if s == a) * 2, "x", "y") for n, a in enumerate(hosts)]
    frame = spark.createDataFrame([*rows, rows[0]], "page_id long, url string, html string, host string, _rule string")
    got = {x.host: x.verdict for x in urlfilter.judge(frame, parents=parents).collect()}
    w = {}
    for a, b in links:
        w[a, b] = w.get((a, b), 0) + (2 if a == hosts[0] else 1)  # its page stands twice
    up = set()
    for h in hosts if parents else ():
        if h.count(".") > 1:
            up |= {(h, h.partition(".")[2]), (h.partition(".")[2], h)}
    for e in up:
        w[e] = w.get(e, 0) + 1
    names = sorted({*hosts, *(x for e in w for x in e)})
    good, bad = ({n: float(n in s) / len(s) for n in names} for s in ({"ok.com", "www.example.com"}, {"bad.example.com"}))
    trust, distrust = dict(good), dict(bad)
    out_w, in_w = ({n: sum(x for e, x in w.items() if e[k] == n) for n in names} for k in (0, 1))
    for _ in range(300):
        t, d = {n: 0.15 * good[n] for n in names}, {n: 0.15 * bad[n] for n in names}
        for (a, b), x in w.items():
            t[b] += 0.85 * trust[a] * x / out_w[a]
            d[a] += 0.85 * distrust[b] * x / in_w[b]
        trust, distrust = t, d
    want = {h: "block" if h == "bad.example.com" or (not h.endswith(".com") and distrust[h] > trust[h]) else "allow" for h in hosts}
    assert got == want and {"allow", "block"} == {want[h] for h in hosts[:40]} and want["c0.net"] == "block" and want["lone.info"] == "allow"
    assert urlfilter.judge(frame.limit(0)).collect() == []


def test_links_of_all_kinds(spark):
    html = [
        '<link rel="canonical" href="https://Canon.org/x"><link rel=alternate hreflang=de href=//de.site.org/y>',
        '<base href="http://base.org/dir/"><a class=x href="page.html">p</a>', "<base href='http://base.org/'><a href='#top'>t</a><a href='mailto:x@y.z'>m</a>",
        '<a href="/own">o</a><a href="http://self.org/">s</a>', None, '<form action="//form.org">', '<a href="http://two.org/a"><a href="http://two.org/b">',
    ]
    frame = spark.createDataFrame([("self.org", h) for h in html], "host string, html string")
    assert {(r.src, r.dst, r.w) for r in urlfilter.host_links(frame).collect()} == {("self.org", d, 1.0) for d in ("canon.org", "de.site.org", "base.org", "form.org", "two.org")}


def test_toxicity(spark):
    bad = ["vexur", "vexurate", "vexuren"]
    texts = [prose(k, 60) + (f" {bad[k % 3]} {prose(k + 500, 3)} {bad[k % 2]}" if k % 4 == 0 else "") + "." for k in range(400)]
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(400)], "doc_id long, toxic int")
    r = [x for x in toxicity.query(docs(spark, texts), labels).collect() if x.held_out]
    assert len(r) > 40 and all(x.predicted == int(x.doc_id % 4 == 0) and 0 <= x.score <= 1 for x in r)
    m = toxicity.Model({"vexur": 1.0})
    assert m.features("vexur you")[0] == m.features("you vexur")[0] == m.features("you vexur you")[0]
    assert m.features("you vexur")[0] > m.features("vexur")[0] > m.features("not vexur")[0]
    assert m.features("he said vexur")[0] < m.features("he is vexur")[0]
    assert len(toxicity.query(docs(spark, EDGE), labels).collect()) == len(EDGE)


def test_composed_grammar_equals_its_machines_one_by_one():
    r = random.Random(5)
    single = [toxicity.machine(toxicity.SYMBOLS, step) for step in toxicity.MACHINES.values()]
    for _ in range(300):
        word = [r.choice(range(6)) for _ in range(30)]
        state, states = 0, [0] * len(single)
        for a in word:
            state, factor = toxicity.GRAMMAR[0][state][a]
            one = 1.0
            for k, m in enumerate(single):
                states[k], x = m[states[k]][a]
                one *= x
            assert abs(factor - one) < 1e-12


#: 1 for a text that is toxic, 0 for one that is not for its negation, report, missing target or other sense alone.
CLAUSES = """1 You are an idiot.
0 You are not an idiot.
0 He said that you are an idiot.
1 You are a worthless loser and a moron.
0 Nobody here is a loser.
0 You are never stupid.
1 They are scum and trash.
0 The paper wrote that they are scum.
1 I will kill you.
0 Kill the process and start it again.
0 I will not kill you.
0 She claims that he will kill her.
1 We will hurt you and beat him.
0 Beat the eggs and burn the sugar.
0 We will never hurt you.
1 Your pathetic plan shows how stupid you are.
0 Your plan is neither stupid nor pathetic.
1 Shoot them all, stab them, strangle them.
0 Shoot the film at noon, attack the next task.
0 The witness told that someone will stab him.
1 Ich werde dich töten.
0 Ich werde dich nicht töten.
0 Die Schädlinge töten wir im Herbst.
1 Je vais te tuer.
0 Il dit que tu vas la tuer.
0 Tuer le temps en silence.
1 Voy a matar a ustedes.
0 No voy a matar a ustedes.
0 Matar el tiempo en casa.""".splitlines()


def test_each_transducer_decides_verdicts(spark):
    """With stems and curve as learned from the given labels: all clauses right, and each of three transducers needed for several."""
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").filter(~toxicity.held_out()).select("doc_id", "toxic")
    rows = spark.read.parquet(f"{sf}/documents.parquet").join(labels, "doc_id").filter("text is not null and toxic is not null").select("text", "toxic").collect()
    m = toxicity.learn(sorted((r.text, r.toxic) for r in rows))
    right = lambda m: {c for c in CLAUSES if (m.score(c[2:]) >= 0.5) == (c[0] == "1")}
    assert right(m) == set(CLAUSES)
    lost = {off: len(CLAUSES) - len(right(toxicity.Model(m.stems, m.curve, toxicity.grammar((off,))))) for off in ("negation", "report", "target")}
    assert min(lost.values()) >= 4, lost


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    rows = QUERIES["op9_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    caught, wrong = ([r.predicted for r in rows if r.toxic == y] for y in (1, 0))
    assert sum(caught) >= 0.9 * len(caught) and sum(wrong) <= 0.01 * len(wrong)


def test_pipeline_equals_its_stages(spark):
    out = corpus_pipeline.run(spark, SF).toPandas()
    d = spark.read.parquet(f"{SF}/documents.parquet").toPandas().sort_values("doc_id")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    d = d[[any(map(str.isalpha, t or "")) for t in d.text]]
    owner, kept = {}, {}
    for i, t in zip(d.doc_id, d.text, strict=True):
        keys = [linededup.keys_of(x, 10) for x in t.split("\n")]
        for (k,) in filter(None, [[x[0][1]] if x else [] for x in keys]):
            owner.setdefault(k, i)
        kept[i] = "\n".join(x for x, k in zip(t.split("\n"), keys, strict=True) if not k or owner[k[0][1]] == i)
        if kept[i] != t and not kept[i].strip(" "):
            del kept[i]
    ids = list(kept)
    label = brute_components([kept[i] for i in ids])
    left = [i for n, i in enumerate(ids) if label[n] == n and not brute_hits(kept[i], items)[1]]
    assert sorted(out.doc_id) == left and dict(zip(out.doc_id, out.text, strict=True)) == {i: kept[i] for i in left}


def jaccard_components(texts):
    """By links of fingerprints within 4 bits, and of 5-word shingles with a similarity of 0.8 or more."""
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for t in texts]
    fps = [simhash.fingerprint(t) for t in texts]
    near = lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4 or bool(sets[i]) and len(sets[i] & sets[j]) * 5 >= 4 * len(sets[i] | sets[j])
    label = list(range(len(texts)))
    for _ in range(6):
        label = [min(label[j] for j in range(len(texts)) if near(i, j)) for i in range(len(texts))]
    return label


@pytest.mark.parametrize("limits", [{}, {"run_rows": 5, "chunk_rows": 4, "most_broadcast": 0, "sample_rows": 30}, {"pair_rows": 1, "run_rows": 3}, {"pair_rows": 3}])
def test_near_copies_of_the_pipeline(spark, limits):
    texts = list(EDGE)
    for k in range(12):
        texts.append(base := prose(100 + k, 200))
        for changed in (1, 2, 3, 4, 5, 6, 9):
            w = base.split()
            for i in range(changed):
                w[(i * 31 + 7 * k) % 200] = f"new{k}x{changed}x{i}"
            texts.append(" ".join(w))
    want = jaccard_components(texts)
    assert want != brute_components(texts)
    rows = docs(spark, texts)
    got = {r.doc_id: r.component for r in neardup.components(rows, **limits).collect()}
    assert len({(a, got[i]) for i, a in enumerate(want)}) == len(set(want)) == len(set(got.values()))
    if not limits:
        assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, rows, SF).collect()) == sorted(set(want))


@pytest.mark.parametrize("most", [500_000, 90, 1, 0])
def test_common_shingles_are_counted_over_all_texts(spark, most):
    texts = [*EDGE, *(prose(300 + k, 30) + " " + prose(700 + k % 7, 9) + (" " + prose(800, 12)) * 2 for k in range(60))]
    counts = Counter(h for t in texts for h in neardup.shingle_set(t).tolist())
    least = next(n for n in range(3, 100) if sum(c >= n for c in counts.values()) <= most)
    want = {h: n for h, n in counts.items() if n >= least}
    h, n = neardup.common_shingles(docs(spark, texts).repartition(3), "text", most, at_once=500)
    assert dict(zip(h.tolist(), n.tolist(), strict=True)) == want and h.tolist() == sorted(want)
    assert (len(want) > 20) == (most >= 90)


def test_bitmaps_refuse_no_similar_pair():
    r = np.random.default_rng(6)
    sets = []
    for _ in range(60):
        s = r.integers(0, 2**63, int(r.integers(1, 300))).astype(np.uint64)
        sets += [np.unique(s), np.unique(np.concatenate((s[: int(len(s) * r.uniform(0.7, 1))], r.integers(0, 2**63, 9).astype(np.uint64))))]
    sets.sort(key=len)
    for size in (500, 520, 1020, 1030, 5000):
        s = r.integers(0, 2**63, size).astype(np.uint64)
        sets += [np.unique(s), np.unique(s[: int(size * 0.9)]), np.unique(np.concatenate((s, r.integers(0, 2**63, size // 10).astype(np.uint64)))), np.unique(r.integers(0, 2**63, size).astype(np.uint64))]
    sets.sort(key=len)
    bits = [neardup.bitmap(s) for s in sets]
    assert len({len(b) for b in bits}) > 3
    label = neardup.alike(np.zeros(len(sets)), np.array([len(s) for s in sets]), bits)
    near = [(i, j) for i in range(len(sets)) for j in range(i) if 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))]
    assert len(near) > 20 and all(label[i] == label[j] for i, j in near) and len(set(label)) > 50


def test_near_dedup_keeps_one_row_of_a_group(spark):
    a, b, c, d = (prose(200 + k, 50) for k in range(4))
    rows = [(1, a), (1, b), (1, b), (2, b), (None, b), (None, c), (None, c), (3, d), (None, d), (4, a)]
    got = corpus_pipeline.near_dedup(spark, docs(spark, [t for _, t in rows], [i for i, _ in rows]), SF).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == sorted([(1, a), (1, b), (0, c), (3, d)])


def test_every_valid_span_has_a_mark():
    for s in ("jane(at)mail.com", "jane (at) mail dot com", "jane [at] mail[dot]com", "jane at mail dot com", "jane  at  mail . com", "jane @ mail.com", "j.d at my-mail (dot) example (dot) org"):
        assert pii.valid(0, s) and pii.stretches(f"{prose(1, 40)} {s} {prose(2, 40)}"), s
    assert not pii.stretches(prose(1, 40) + " stays at home with them")


STAGES = dict(corpus_pipeline.STAGES)
ODD = [None, "", " ", "12 34", "one line of some length\nkept", "One line of some length", "one line of some length", prose(1, 300), prose(1, 300), prose(2, 60)]


def odd_rows(spark, lang="en"):
    """Nulls in every column, ties, repeated rows, and columns with the operators' names."""
    rows = [(i if i % 4 else None, t, lang, f"s{i % 2}" if i % 3 else None, None if i % 5 else len(t or ""), "x", 1.5, "l", "b", "g") for i, t in enumerate([*ODD, *ODD])]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words string, score double, lang_pred string, n_lines string, _gone string")


@pytest.mark.parametrize("name", list(STAGES))
def test_stage_with_odd_rows(spark, name):
    rows = odd_rows(spark)
    got = STAGES[name](spark, rows, SF)
    assert STAGES[name](spark, rows.limit(0), SF).collect() == []
    assert set(rows.columns) - {"_gone"} <= set(got.columns)
    out = got.collect()
    assert all((r.score, r.lang_pred, r.n_words, r.n_lines) == (1.5, "l", "x", "b") for r in out)
    texts = [r.text for r in out]
    if name == "language ID":
        assert sorted(texts) == sorted([t for t in ODD if t and any(map(str.isalpha, t))] * 2)
    elif name == "SimHash near-dedup":
        # one of the wordless texts, one of the equal lines in any case, one of the two long copies; the others are groups of their own
        words = sorted(" ".join((t or "").lower().split()) for t in texts)
        assert words == sorted({" ".join((t or "").lower().split()) for t in ODD})
    elif name in ("benchmark decontamination", "mixing to target weights"):
        assert len(out) == len(ODD) * 2
    else:
        assert len(out) >= 8 and "One line of some length" not in [t for t in texts if t][5:]


def test_language_id_without_labels_keeps_texts_with_letters(spark):
    rows = odd_rows(spark, None)
    assert {r.lang_pred for r in langid.query(rows).collect()} == {None, "und"}
    assert sorted(r.text for r in STAGES["language ID"](spark, rows, SF).collect()) == sorted([t for t in ODD if t and any(map(str.isalpha, t))] * 2)


def test_operators_replace_clashing_columns(spark):
    rows = odd_rows(spark)
    assert langid.identify(rows, rows, rows.columns).columns.count("score") == 1
    labels = spark.createDataFrame([(1, 1, 5), (2, 0, 5), (1, 0, 5), (None, 1, 5), (3, None, 5)], "doc_id long, toxic int, text int")
    assert toxicity.score_toxicity(rows, labels, rows.columns).columns.count("score") == 1 and toxicity.query(rows.limit(0), labels).collect() == []
    assert pii.find_personal_data(rows.withColumn("spans", F.lit(1)), ["doc_id", "spans"]).columns.count("spans") == 1
    with pytest.raises(TypeError):
        linededup.dedup_lines(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
