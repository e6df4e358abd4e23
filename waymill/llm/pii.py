"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions.

The patterns give the base spans, which always stay. The tagger is trained in numpy from labelled spans: the base spans of a
bounded sample of documents where they stand, and set among ordinary text in forms that the patterns miss (spelled
separators, missing plus signs, dotted cards, addresses of other words), beside number-like strings that are none. A fifth
kind, secret (a credential), has no base pattern and is only ever tagged; its labels are the quoted values after a name such
as token, and its spans stand in a column of their own. A tagged span has to pass the checks of its kind (``valid``: Luhn, parts up to 255, numbers of digits), so it holds
a digit, an @ or a written at (" at ", "(at)", "[at]") before a domain: windows without such a mark can add nothing and are
left out, all others are scored. Windows overlap by half; the scores of a character are averaged over its windows, by
distance from their edges, and the whole stretch that the windows cover is then decoded at once by Viterbi, so that no
window's edge decides a span. A tagged span is added if it touches no base span.

Defined results: a null text is empty and has no span; repeated rows are each tagged; without any base span in the sample
nothing is added; offsets are code points, end exclusive; columns with the names of the new ones are replaced, others pass
through; an empty table stays empty.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymill.llm.common import without

KINDS = ("email", "ip", "card", "phone")
#: Kinds that the tagger knows: those of the patterns, and credentials.
TAGGED = (*KINDS, "secret")
#: Labels of the fifth kind, for training alone.
SECRET = re.compile(r"(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)\s*[=:]\s*\"([^\"\s]{16,})\"", re.I)
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
SIGN = re.compile(r"[0-9@]")
#: What every span that valid() accepts holds: a digit, an @, or a written at between a local part and a domain of two parts.
TRIGGER = re.compile(r"[0-9@]|(?<=[A-Za-z0-9._%+-]) ?(?:\(at\)|\[at\]| at )(?= ?[A-Za-z0-9-]+ ?(?:\.|\(dot\)|\[dot\]| dot ) ?[A-Za-z0-9-])")


def luhn(digits: str) -> bool:
    d = [ord(c) - 48 for c in reversed(digits)]
    return (sum(d[::2]) + sum(2 * x - 9 * (x > 4) for x in d[1::2])) % 10 == 0


def ascii_digits(s: str) -> str:
    return "".join(DIGIT.findall(s))


def emails(text: str):
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and LOCAL.match(text, start - 1):
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(number of the kind, start, end), by kind and start."""
    out = [(0, a, b) for a, b in emails(text)]
    if DIGIT.search(text):
        out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(x.lstrip("0")) < 4 and int(x) <= 255 for x in m[0].split("."))]
        out += [(2, m.start(), m.end()) for m in CARD.finditer(text) if m.end() - m.start() >= 16 and 16 <= len(d := ascii_digits(m[0])) <= 19 and luhn(d)]
        out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(ascii_digits(m[0])) <= 15]
    return out


# ---- the tagger

#: Input classes: digits are one, a-z and these characters have one each, other characters share one by sort.
OWN = " \n@.-+_%()[]/:,\"'=#*&abcdefghijklmnopqrstuvwxyz"
TAGS = 1 + 2 * len(TAGGED)  # 0 outside, 1 + 2k begin of kind k, 2 + 2k inside


def _class_table() -> np.ndarray:
    out = np.full(256, len(OWN) + 3, np.int64)
    for c in range(256):
        s = chr(c)
        if s in OWN:
            out[c] = OWN.index(s)
        elif "0" <= s <= "9":
            out[c] = len(OWN)
        elif "A" <= s <= "Z":
            out[c] = len(OWN) + 1
        elif s.isalpha():
            out[c] = len(OWN) + 2
    return out


CLASSES = _class_table()
PAD = len(OWN) + 4
N_CLASSES = PAD + 1


def classes(text: str) -> np.ndarray:
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(cp < 256, CLASSES[np.minimum(cp, 255)], len(OWN) + 2)


def sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Tagger:
    """Two LSTMs over character classes (forwards and backwards), linear scores and CRF transitions."""

    def __init__(self, hidden: int = 24, seed: int = 0):
        r, h = np.random.default_rng(seed), hidden
        self.h = h
        init = lambda *s: (r.standard_normal(s) * 0.3).astype(np.float32)
        self.p = {f"{k}{d}": init(*s) for d in "fb" for k, s in (("X", (N_CLASSES, 4 * h)), ("U", (h, 4 * h)))}
        for d in "fb":
            self.p[f"X{d}"][:, h : 2 * h] += 1.0  # forget gates begin open
        self.p |= {"W": init(2 * h, TAGS), "c": np.zeros(TAGS, np.float32), "T": np.zeros((TAGS, TAGS), np.float32)}

    def lstm(self, x: np.ndarray, d: str, keep: bool = False):
        """x: windows x time. Hidden states in reading order, time first."""
        h, n = self.h, len(x)
        state, cell, out, kept = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32), np.empty((x.shape[1], n, h), np.float32), []
        for t in range(x.shape[1]):
            g = self.p[f"X{d}"][x[:, t]] + state @ self.p[f"U{d}"]
            i, f, o, z = sigmoid(g[:, :h]), sigmoid(g[:, h : 2 * h]), sigmoid(g[:, 2 * h : 3 * h]), np.tanh(g[:, 3 * h :])
            new = f * cell + i * z
            tc = np.tanh(new)
            if keep:
                kept.append((i, f, o, z, cell, tc, state))
            cell, state = new, o * tc
            out[t] = state
        return out, kept

    def hidden(self, x: np.ndarray, keep: bool = False):
        f, kf = self.lstm(x, "f", keep)
        b, kb = self.lstm(x[:, ::-1], "b", keep)
        return np.concatenate((f, b[::-1]), 2), kf, kb

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """windows x time x tags"""
        return (self.hidden(x)[0] @ self.p["W"] + self.p["c"]).transpose(1, 0, 2)

    def gradients(self, x: np.ndarray, y: np.ndarray):
        """Mean loss of a batch (negative CRF log-likelihood) and its gradients."""
        n, steps = x.shape
        hid, kf, kb = self.hidden(x, True)
        e, trans = (hid @ self.p["W"] + self.p["c"]).astype(np.float64), self.p["T"].astype(np.float64)
        # forwards and backwards over probabilities, scaled to add up to 1 at each step
        most = e.max(2, keepdims=True)
        own, step = np.exp(e - most), np.exp(trans)
        alpha, beta, scale = np.empty_like(e), np.ones_like(e), np.empty((steps, n, 1))
        for t in range(steps):
            alpha[t] = alpha[t - 1] @ step * own[t] if t else own[0]
            scale[t] = alpha[t].sum(1, keepdims=True)
            alpha[t] /= scale[t]
        for t in range(steps - 2, -1, -1):
            beta[t] = (own[t + 1] * beta[t + 1]) @ step.T / scale[t + 1]
        z = (np.log(scale) + most).sum((0, 2))
        de = alpha * beta
        rows = np.arange(n)
        gold, dt = 0.0, np.zeros_like(trans)
        for t in range(steps):
            gold += e[t, rows, y[:, t]].sum()
            de[t, rows, y[:, t]] -= 1
            if t:
                gold += trans[y[:, t - 1], y[:, t]].sum()
                dt += step * (alpha[t - 1].T @ (own[t] * beta[t] / scale[t]))
        np.subtract.at(dt, (y[:, :-1], y[:, 1:]), 1)
        de = (de / n).astype(np.float32)
        g = {"T": (dt / n).astype(np.float32), "W": np.einsum("tnh,tnk->hk", hid, de), "c": de.sum((0, 1))}
        dh = de @ self.p["W"].T
        g |= self.back(x, dh[:, :, : self.h], kf, "f") | self.back(x[:, ::-1], dh[::-1, :, self.h :], kb, "b")
        return (z.sum() - gold) / n, g

    def back(self, x, dh, kept, d):
        h, steps, gu = self.h, x.shape[1], np.zeros_like(self.p[f"U{d}"])
        ds = dc = np.zeros((x.shape[0], h), np.float32)
        gates = np.empty((steps, len(x), 4 * h), np.float32)
        for t in range(steps - 1, -1, -1):
            i, f, o, z, cell, tc, state = kept[t]
            ds = ds + dh[t]
            dc = dc + ds * o * (1 - tc * tc)
            gates[t] = g = np.concatenate((dc * z * i * (1 - i), dc * cell * f * (1 - f), ds * tc * o * (1 - o), dc * i * (1 - z * z)), 1)
            gu += state.T @ g
            ds, dc = g @ self.p[f"U{d}"].T, dc * f
        seen = (x.T.reshape(-1, 1) == np.arange(N_CLASSES)).astype(np.float32)
        return {f"X{d}": seen.T @ gates.reshape(-1, 4 * h), f"U{d}": gu}

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 8, batch: int = 128, rate: float = 0.03, seed: int = 1):
        r, m, v, step = np.random.default_rng(seed), {}, {}, 0
        for epoch in range(epochs):
            order = r.permutation(len(x))
            for k in range(0, len(x), batch):
                _, g = self.gradients(x[order[k : k + batch]], y[order[k : k + batch]])
                norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
                step += 1
                for key, a in g.items():
                    a = a * min(1.0, 5.0 / (norm + 1e-9))
                    m[key] = 0.9 * m.get(key, 0) + 0.1 * a
                    v[key] = 0.999 * v.get(key, 0) + 0.001 * a * a
                    self.p[key] -= (rate * 0.6**epoch * (m[key] / (1 - 0.9**step)) / (np.sqrt(v[key] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def viterbi(self, e: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """e: stretches x time x tags, padded. Tags; what lies beyond a length is 0."""
        n, steps, _ = e.shape
        score, back = e[:, 0].copy(), np.zeros(e.shape, np.int8)
        for t in range(1, steps):
            s = score[:, :, None] + self.p["T"]
            best = s.argmax(1)
            new = np.take_along_axis(s, best[:, None, :], 1)[:, 0] + e[:, t]
            live = (t < lengths)[:, None]
            score, back[:, t] = np.where(live, new, score), np.where(live, best, np.arange(TAGS))
        out = np.zeros((n, steps), np.int8)
        out[:, -1] = score.argmax(1)
        for t in range(steps - 1, 0, -1):
            out[:, t - 1] = back[np.arange(n), t, out[:, t]]
        out[np.arange(steps) >= lengths[:, None]] = 0
        return out


# ---- training data

WINDOW, STRIDE = 64, 32


def labelled(text: str) -> list[tuple[int, int, int]]:
    """The spans that the tagger learns from, by start."""
    return sorted([*base_spans(text), *((len(KINDS), *m.span(1)) for m in SECRET.finditer(text))], key=lambda x: x[1])


def rewritten(kind: int, s: str, r: np.random.Generator, words: tuple[str, ...] = ()) -> str:
    """A form of the span that the patterns do not match, or the span itself; an address may get other words."""
    k = int(r.integers(4))
    if kind == 0:
        if words and r.random() < 0.5:
            pick = lambda: words[int(r.integers(len(words)))]
            local = (pick(), pick(), f"{pick()}.{pick()}", f"{pick()}{int(r.integers(99))}")[int(r.integers(4))]
            domain = (pick(), pick(), f"{pick()}.{pick()}", f"{pick()}{int(r.integers(99))}")[int(r.integers(4))]
            s = f"{local}@{domain.lower()}.{('com', 'org', 'net', 'de', 'example.com')[int(r.integers(5))]}"
        k = int(r.integers(5))
        if k < 2:
            return s
        local, _, domain = s.partition("@")
        return local + (" at ", " at ", " [at] ", "(at)", " @ ", " (at) ")[int(r.integers(6))] + (domain if k == 2 else domain.replace(".", (" dot ", " (dot) ", " . ")[int(r.integers(3))]))
    if kind == 1:
        return s if k < 3 else s.replace(".", (" . ", "[.]")[int(r.integers(2))])
    if kind == 2:
        d = ascii_digits(s)
        return s if k < 2 else ("." if k == 2 else " - ").join(d[i : i + 4] for i in range(0, len(d), 4))
    if kind == 3:
        return s if k < 2 else s.lstrip("+0123456789 ") or s if k == 2 else s.replace(" ", "/").replace("(", "").replace(")", "")
    n = len(s)
    letters = "0123456789abcdef" if k < 2 else "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    return s if k == 0 else "".join(letters[i] for i in r.integers(0, len(letters), int(r.integers(min(20, n), n + 1))))


#: How a credential stands in a text: its name, the sign between, and the quotes.
NAMED = ('token = "{}"', "token: '{}'", 'api_key="{}"', 'secret = "{}"', "password: {}", 'access_key = "{}"')


def number_like(r: np.random.Generator) -> str:
    """Strings with digits that are no personal data."""
    pick, num = int(r.integers(7)), lambda n: "".join(map(str, r.integers(0, 10, n)))
    return (f'"{"".join("0123456789abcdef"[i] for i in r.integers(0, 16, int(r.integers(20, 42))))}"', f"{num(1)}.{num(1)}.", num(int(r.integers(1, 6))), f"{num(4)}-{num(2)}-{num(2)}", f"{num(2)}:{num(2)}", f"{num(1)}.{num(1)}.{num(2)}", num(int(r.integers(9, 20))))[pick]


def training_windows(texts: list[str], most: int, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Windows of classes and tags: a quarter as they stand in the texts, the others spans and number-like strings set among the texts' own words."""
    r, x, y = np.random.default_rng(seed), [], []
    known = [(t, spans) for t in texts if (spans := [s for s in labelled(t) if s[2] - s[1] < WINDOW])]
    kinds = [[(t[a:b], t, spans, a, b) for t, spans in known for k, a, b in spans if k == kind] for kind in range(len(TAGGED))]
    prose = [t for t in texts if len(t) > 2 * WINDOW]
    if not known or not prose:
        return np.empty((0, WINDOW), np.int64), np.empty((0, WINDOW), np.int64)
    words = tuple(sorted({w for t in prose[:200] for w in re.findall(r"[A-Za-z]{2,12}", t[:2000])}))

    def put(whole: str, spans) -> None:
        tags = np.zeros(max(WINDOW, len(whole)), np.int64)
        for kind, a, b in spans:
            tags[max(0, a) : max(0, b)] = 2 + 2 * kind
            if a >= 0:
                tags[a : a + 1] = 1 + 2 * kind
        c = classes(whole[:WINDOW])
        x.append(np.concatenate((c, np.full(WINDOW - len(c), PAD))))
        y.append(tags[:WINDOW])

    for n in range(most):
        own = kinds[n // 2 % len(TAGGED)]
        if n % 4 == 0 and own:
            _, t, spans, a, b = own[int(r.integers(len(own)))]
            at = max(0, int(r.integers(max(0, b - WINDOW) - 4, a + 4)))
            put(t[at : at + WINDOW], [(k, max(p - at, -1), q - at) for k, p, q in spans if p - at < WINDOW and q > at])
            continue
        t = prose[int(r.integers(len(prose)))]
        at = int(r.integers(0, len(t) - WINDOW))
        cut = int(r.integers(4, 40))
        left, right = (SIGN.sub("e", part) for part in (t[at : at + cut], t[at + cut : at + WINDOW]))
        pick = n % 12
        if pick == 11:
            put(left + right, [])
        elif pick in (5, 10) or not own:
            put(f"{left} {number_like(r)} {right}", [])
        else:
            kind = n // 2 % len(TAGGED)
            s = rewritten(kind, own[int(r.integers(len(own)))][0], r, words)
            before, after = (NAMED[int(r.integers(len(NAMED)))] if kind == len(KINDS) else "{}").split("{}")
            if kind != len(KINDS) and r.random() < 0.3:
                before, after = (("", ","), ("(", ")"), ("", "."), ("<", ">"), ("", "###"))[int(r.integers(5))]
            whole = f"{left} {before}{s}{after} {right}"
            start = len(left) + 1 + len(before)
            put(whole, [(kind, start, start + len(s))])
    return np.array(x), np.array(y)


# ---- tagging

EDGE = (np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1]) + 1).astype(np.float32)


def stretches(text: str) -> list[tuple[int, int]]:
    """(first window, end) of the runs of neighbouring windows with a mark of TRIGGER; window g starts at g x STRIDE."""
    out: list[list[int]] = []
    for m in TRIGGER.finditer(text):
        p = m.start()
        first, end = max(0, (p - WINDOW) // STRIDE + 1), p // STRIDE + 1
        if out and first <= out[-1][1]:
            out[-1][1] = max(end, out[-1][1])
        else:
            out.append([first, end])
    return [(a, b) for a, b in out]


def valid(kind: int, s: str) -> bool:
    d = ascii_digits(s)
    if kind == 0:
        return re.fullmatch(r"[A-Za-z0-9._%+-]+ ?(?:@|\(at\)|\[at\]| at ) ?[A-Za-z0-9-]+(?: ?(?:\.|\(dot\)|\[dot\]| dot ) ?[A-Za-z0-9-]+)+", s) is not None
    if kind == 1:
        parts = re.findall(r"[0-9]+", s)
        return len(parts) == 4 and all(len(p) < 4 and int(p) <= 255 for p in parts) and re.fullmatch(r"[0-9. \[\]]+", s) is not None
    if kind == 2:
        return 16 <= len(d) <= 19 and luhn(d) and re.fullmatch(r"[0-9][0-9 ./-]+[0-9]", s) is not None
    if kind == 3:
        return 8 <= len(d) <= 15 and re.fullmatch(r"[+(]?[0-9][0-9 ()./-]+[0-9]", s) is not None and re.search(r"[ ()/-]", s) is not None
    return bool(d) and re.fullmatch(r"[A-Za-z0-9+/_=-]{16,}", s) is not None and re.search("[A-Za-z]", s) is not None


def tag(model: Tagger, texts: list[str], at_once: int = 2048) -> list[list[tuple[int, int, int]]]:
    """Tagged spans of each text that pass the checks of their kind.

    Stretches of like length are decoded together, at_once windows at most unless one stretch has more: what a call holds
    is in proportion to that number, or to the longest stretch.
    """
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    todo = sorted(((b - a, n, a, b) for n, t in enumerate(texts) for a, b in stretches(t)), reverse=True)
    k = 0
    while k < len(todo):
        longest, end = todo[k][0], k + 1
        while end < len(todo) and 2 * todo[end][0] >= longest and (end + 1 - k) * longest <= at_once:
            end += 1
        for n, lo, tags in decode(model, texts, [t[1:] for t in todo[k:end]], at_once):
            out[n] += spans_of(texts[n], lo, tags)
        k = end
    return [sorted(x, key=lambda s: s[1]) for x in out]


def emissions_of(model: Tagger, c: np.ndarray, windows: int, at_once: int) -> np.ndarray:
    """c: stretches x characters, padded. The scores of each character, averaged over its windows by distance from their edges."""
    score = np.zeros((len(c), (windows - 1) * STRIDE + WINDOW, TAGS), np.float32)
    weight = np.full(score.shape[1], 1e-9, np.float32)
    step = max(1, at_once // len(c))
    for first in range(0, windows, step):
        some = range(first, min(windows, first + step))
        e = model.emissions(np.concatenate([c[:, g * STRIDE : g * STRIDE + WINDOW] for g in some])).reshape(len(some), len(c), WINDOW, TAGS)
        for g, own in zip(some, e, strict=True):
            score[:, g * STRIDE : g * STRIDE + WINDOW] += own * EDGE[:, None]
            weight[g * STRIDE : g * STRIDE + WINDOW] += EDGE
    return score / weight[:, None]


def decode(model: Tagger, texts: list[str], part: list[tuple[int, int, int]], at_once: int = 2048):
    """part: (text, first window, end). Text, first character and tags of each stretch."""
    windows = max(b - a for _, a, b in part)
    spans = [(n, a * STRIDE, min(len(texts[n]), (b - 1) * STRIDE + WINDOW)) for n, a, b in part]
    c = np.full((len(part), (windows - 1) * STRIDE + WINDOW), PAD)
    for row, (n, lo, hi) in zip(c, spans, strict=True):
        row[: hi - lo] = classes(texts[n][lo:hi])
    lengths = np.array([hi - lo for _, lo, hi in spans])
    tags = model.viterbi(emissions_of(model, c, windows, at_once)[:, : lengths.max()], lengths)
    return [(n, lo, row) for (n, lo, _), row in zip(spans, tags, strict=True)]


#: The characters of which the first and the last word of a span, by kind, are made: a span that cuts a word takes all of it.
ENDS = (("[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"), ("[0-9]",) * 2, ("[0-9]",) * 2, ("[0-9]",) * 2, ("[A-Za-z0-9+/_=-]",) * 2)
#: A further part of a written domain.
PARTS = re.compile(r" ?(?:\(dot\)|\[dot\]|(?<! ) dot ) ?[A-Za-z0-9-]+|\.[A-Za-z0-9-]+")
ENDS = tuple((re.compile(a), re.compile(b)) for a, b in ENDS)


def spans_of(text: str, lo: int, row: np.ndarray) -> list[tuple[int, int, int]]:
    """The runs of one kind that pass its checks; row: tags from character lo on."""
    at, out = np.flatnonzero(row), []
    new = (np.diff(at) > 1) | (row[at[1:]] % 2 == 1) | ((row[at[1:]] - 1) // 2 != (row[at[:-1]] - 1) // 2)
    for run in np.split(at, np.flatnonzero(new) + 1) if len(at) else []:
        a, b, kind = lo + int(run[0]), lo + int(run[-1]) + 1, int(row[run[0]] - 1) // 2
        while a < b and text[a] in " \n":
            a += 1
        while b > a and text[b - 1] in " \n.,":
            b -= 1
        first, last = ENDS[kind]
        while a < b and a > 0 and first.match(text[a]) and first.match(text[a - 1]) and (not out or a > out[-1][2]):
            a -= 1
        while a < b < len(text) and last.match(text[b - 1]) and last.match(text[b]):
            b += 1
        if kind == 0:
            while b > a and (more := PARTS.match(text, b)):
                b = more.end()
        if b > a and valid(kind, text[a:b]):
            out.append((kind, a, b))
    return out


def all_spans(model: Tagger | None, texts: list[str]) -> list[tuple[list, list]]:
    """(base spans, base and added spans) of each text."""
    base = [base_spans(t) for t in texts]
    added = tag(model, texts) if model else [[] for _ in texts]
    return [(b, sorted(b + [s for s in more if all(s[2] <= x[1] or s[1] >= x[2] for x in b)])) for b, more in zip(base, added, strict=True)]


def written(spans) -> str:
    return ",".join(f"{TAGGED[k]}:{a}:{b}" for k, a, b in spans)


#: The columns that are added.
NEW = (*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_spans", "secrets")
TEXTS = ("base_sha256", "spans", "secrets")


def _find(model):
    def run(batches):
        for b in batches:
            at = b.schema.names.index("_text")
            found = all_spans(model.value, [t or "" for t in b.column(at).to_pylist()])
            keep = [i for i in range(b.num_columns) if i != at]
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in range(len(KINDS))]
            digest = pa.array([hashlib.sha256(written(base).encode()).hexdigest() for base, _ in found], pa.string())
            own, secrets = ([[s for s in spans if (s[0] < len(KINDS)) == personal] for _, spans in found] for personal in (True, False))
            new = [pa.array([written(s) for s in own], pa.string()), pa.array([len(s) for s in own], pa.int64()), pa.array([written(s) for s in secrets], pa.string())]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), *counts, digest, *new], names=[*(b.schema.names[i] for i in keep), *NEW])

    return run


def find_personal_data(docs: DataFrame, keep: list[str], text_col: str = "text", sample_rows: int = 1500, windows: int = 6000) -> DataFrame:
    """The columns to keep of docs, the base counts, their digest, all personal spans as text, their number, and credentials apart.

    The tagger learns from about sample_rows documents at most that hold a digit, those with the smallest hash.
    """
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    some = docs.select(text.alias("t"), F.xxhash64(text).alias("h")).filter(F.col("t").rlike("[0-9]{4}|@"))
    n = some.count()
    rows = some.filter(F.pmod("h", F.lit(1_000_000)) < min(1.0, sample_rows / max(1, n)) * 1_000_000).select("h", "t").distinct().collect()
    texts = [r.t for r in sorted(rows, key=lambda r: (r.h, r.t))]
    x, y = training_windows(texts, windows)
    model = Tagger().fit(x, y) if len(x) else None
    src = docs.select(*without(keep, *NEW, "_text"), text.alias("_text"))
    schema = src.drop("_text").withColumns({c: F.lit("" if c in TEXTS else 0).cast("string" if c in TEXTS else "long") for c in NEW}).schema
    return src.mapInArrow(_find(spark.sparkContext.broadcast(model)), schema)


def query(docs: DataFrame) -> DataFrame:
    return find_personal_data(docs, ["doc_id"])
