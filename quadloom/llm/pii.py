"""Personal data: exact patterns, and a character-level bidirectional LSTM with CRF transitions that adds to them.

The model is trained in numpy, on the driver, from labelled spans that `labelled` makes (a bounded number of short
texts from a seed; no corpus rows). A text is cut into overlapping windows; each is decoded by Viterbi, each character
takes the tag of the window in which it lies farthest from an edge, and spans are read from the whole tag sequence.

Defined cases: a null text counts as empty; a text without characters has no spans; repeated rows and null ids are rows
like any other, as each text is looked at by itself; texts of any length are worked on whole; an empty table gives no rows;
extra columns are ignored, whatever their names. Base spans always stay; the model's spans that touch a base span, or that lack the digits or the
"at" of their kind, are left out.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.llm.common import documents, map_text

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Each start that fails is tried once only: the guards keep long runs of one class linear and the matches the same.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9](?<![0-9]{2})[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
ODD = str.maketrans("0123456789", "0246813579")

HIDDEN, TAGS, WINDOW, MARGIN, ROWS = 10, 5, 512, 40, 512
#: Bounds of the training: texts, their length, and passes of the optimiser.
TRAIN_TEXTS, TRAIN_LENGTH, TRAIN_STEPS, TRAIN_BATCH = 3000, 80, 260, 96


# ---- exact patterns


def luhn(digits: str) -> bool:
    back = digits[::-1]
    return (sum(map(int, back[::2])) + sum(map(int, back[1::2].translate(ODD)))) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of the pattern, found from each @: the local part is the run before it, back to the match before."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append((start, end))
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)
    return out


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the exact patterns, by kind and start; code points, end exclusive."""
    out = [(0, a, b) for a, b in emails(text)]
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return out


# ---- the model

# The characters that have a symbol of their own; then digits, other letters, other spaces, the rest, none.
OWN = "abcdefghijklmnopqrstuvwxyz @.-_+%()[],:/"
DIGIT, LETTER, SPACE, REST, PAD = range(len(OWN), len(OWN) + 5)
SYMBOLS = len(OWN) + 5


@lru_cache(1)
def _symbol_table() -> np.ndarray:
    table = np.full(0x3000, REST, np.uint8)
    for c in range(0x80, 0x3000):
        table[c] = LETTER if chr(c).isalpha() else SPACE if chr(c).isspace() else REST
    for i, c in enumerate(OWN):
        table[ord(c)] = table[ord(c.upper())] = i
    table[48:58] = DIGIT
    table[9:14] = SPACE
    return table


def symbols(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return _symbol_table()[np.minimum(points, 0x2FFF)]


def labelled(seed: int, n: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """n texts of `length` characters, as symbols, and the tag of each character (0: none, else 1 + kind)."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[rng.integers(len(xs))]
    digits = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    word = lambda a=2, b=9: "".join(pick("eeettaoinshrdlucmfwypvbgké") for _ in range(rng.integers(a, b)))
    octets = lambda: ".".join(str(x) for x in rng.integers(1, 256, 4))

    def private(kind: int) -> str:
        if kind == 0:
            at, dot = (("@", "."), ("@", "."), (" [at] ", " [dot] "), (" (at) ", " (dot) "), (" at ", " dot "))[rng.integers(5)]
            local = pick(["{w}", "{w}.{v}", "{w}{d}", "{w}_{v}", "{w}.{d}"]).format(w=word(), v=word(), d=digits(2))
            return local + at + word(3, 8) + pick(["", "", digits(1)]) + (dot + word(3, 8)) * rng.integers(0, 2) + dot + pick(["com", "org", "net", "de", "fr"])
        if kind == 1:
            return octets()
        if kind == 2:
            return pick(["{}{}{}{}", "{} {} {} {}", "{}-{}-{}-{}", "{}.{}.{}.{}"]).format(*(digits(4) for _ in range(4)))
        a, b, c = digits(3), digits(3), digits(4)
        return pick(["+1 ({}) {}-{}", "+1 ({}) {}-{}", "+44 {} {} {}", "({}) {}-{}", "{}-{}-{}", "+49.{}.{}.{}"]).format(a, b, c)

    def plain() -> str:
        k = rng.random()
        if k < 0.78:
            return word() + pick(["", "", "", "", ",", ".", ":", "!!", "%%%", "|"])
        if k < 0.9:
            return pick([digits(rng.integers(1, 6)), digits(2) + "." + digits(2), "20" + digits(2) + "-" + digits(2) + "-" + digits(2), digits(2) + ":" + digits(2), "v" + digits(1) + "." + digits(1) + "." + digits(1)])
        return pick(["at", "dot", "(at)", "#" + digits(3), "https://" + word() + ".com/" + word(), "".join(pick("0123456789abcdef") for _ in range(24)), "@" + word()])

    x, y = np.full((n, length), PAD, np.uint8), np.zeros((n, length), np.uint8)
    for row in range(n):
        text, tags = "", []
        while len(text) < length:
            kind = int(rng.integers(4)) if rng.random() < 0.14 else -1
            part = plain() if kind < 0 else private(kind)
            text += part
            tags += [kind + 1] * len(part)
            gap = pick([" "] * 9 + ["\n"])
            text += gap
            tags += [0] * len(gap)
        at = int(rng.integers(0, len(text) - length + 1))
        x[row], y[row] = symbols(text)[at : at + length], tags[at : at + length]
        if rng.random() < 0.25:
            end = int(rng.integers(1, length))
            x[row, end:], y[row, end:] = PAD, 0
    return x, y


def _sigmoid(z):
    return 0.5 * np.tanh(0.5 * z) + 0.5


def _run(p, d, x):
    """One direction over x [time, rows]; what the backward pass needs."""
    w, u, h_n = p["w" + d], p["u" + d], HIDDEN
    h = c = np.zeros((h_n, x.shape[1]), np.float32)
    kept = []
    for t in range(len(x)):
        z = w[:, x[t]] + u @ h
        gates, g = _sigmoid(z[: 3 * h_n]), np.tanh(z[3 * h_n :])
        before, c_before = h, c
        c = gates[h_n : 2 * h_n] * c + gates[:h_n] * g
        s = np.tanh(c)
        h = gates[2 * h_n :] * s
        kept.append((gates, g, c_before, s, before, h))
    return kept


def _back(p, d, x, kept, dh_out, grad):
    u, h_n = p["u" + d], HIDDEN
    dh = dc = np.zeros_like(kept[0][5])
    for t in range(len(x) - 1, -1, -1):
        gates, g, c_before, s, before, _ = kept[t]
        i, f, o = gates[:h_n], gates[h_n : 2 * h_n], gates[2 * h_n :]
        dh = dh + dh_out[t]
        dc = dc + dh * o * (1 - s * s)
        dz = np.concatenate([dc * g * i * (1 - i), dc * c_before * f * (1 - f), dh * s * o * (1 - o), dc * i * (1 - g * g)])
        onehot = np.zeros((x.shape[1], SYMBOLS), np.float32)
        onehot[np.arange(x.shape[1]), x[t]] = 1
        grad["w" + d] += dz @ onehot
        grad["u" + d] += dz @ before.T
        dc, dh = dc * f, u.T @ dz


def _logsum(a, axis):
    top = a.max(axis, keepdims=True)
    return (np.log(np.exp(a - top).sum(axis, keepdims=True)) + top).squeeze(axis)


def loss_and_grad(p, x, y):
    """Negative log likelihood of the tags a character, and its gradient. x, y: [time, rows]."""
    steps, rows = x.shape
    forth, back = _run(p, "f", x), _run(p, "b", x[::-1])
    hf, hb = np.stack([k[5] for k in forth]), np.stack([k[5] for k in back])[::-1]
    e = np.einsum("kh,thr->tkr", p["vf"], hf) + np.einsum("kh,thr->tkr", p["vb"], hb) + p["bias"][None, :, None]
    tr = p["trans"]
    alpha, beta = np.empty_like(e), np.zeros_like(e)
    alpha[0] = e[0]
    for t in range(1, steps):
        alpha[t] = e[t] + _logsum(alpha[t - 1][:, None, :] + tr[:, :, None], 0)
    for t in range(steps - 2, -1, -1):
        beta[t] = _logsum(tr[:, :, None] + (e[t + 1] + beta[t + 1])[None], 1)
    z = _logsum(alpha[-1], 0)
    prob = np.exp(alpha + beta - z)
    onehot = (y[:, None, :] == np.arange(TAGS)[None, :, None]).astype(np.float32)
    scale = np.float32(1 / (steps * rows))
    loss = (z.sum() - (e * onehot).sum() - tr[y[:-1], y[1:]].sum()) * scale
    de = (prob - onehot) * scale
    grad = {k: np.zeros_like(v) for k, v in p.items()}
    for t in range(steps - 1):
        pair = np.exp(alpha[t][:, None, :] + tr[:, :, None] + (e[t + 1] + beta[t + 1])[None] - z)
        grad["trans"] += pair.sum(2) * scale
    np.add.at(grad["trans"], (y[:-1].ravel(), y[1:].ravel()), -scale)
    grad["bias"] += de.sum((0, 2))
    grad["vf"] += np.einsum("tkr,thr->kh", de, hf)
    grad["vb"] += np.einsum("tkr,thr->kh", de, hb)
    _back(p, "f", x, forth, np.einsum("kh,tkr->thr", p["vf"], de), grad)
    _back(p, "b", x[::-1], back, np.einsum("kh,tkr->thr", p["vb"], de)[::-1], grad)
    return float(loss), grad


def start(seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    p = {}
    for d in "fb":
        p["w" + d] = rng.normal(0, 0.3, (4 * HIDDEN, SYMBOLS))
        p["w" + d][HIDDEN : 2 * HIDDEN] += 1
        p["u" + d] = rng.normal(0, 0.3, (4 * HIDDEN, HIDDEN))
        p["v" + d] = rng.normal(0, 0.3, (TAGS, HIDDEN))
    p |= {"trans": np.zeros((TAGS, TAGS)), "bias": np.zeros(TAGS)}
    return {k: v.astype(np.float32) for k, v in p.items()}


@lru_cache(2)
def trained(seed: int = 7) -> dict[str, np.ndarray]:
    x, y = labelled(seed, TRAIN_TEXTS, TRAIN_LENGTH)
    rng, p = np.random.default_rng(seed), start(seed)
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    for step in range(1, TRAIN_STEPS + 1):
        rows = rng.integers(0, len(x), TRAIN_BATCH)
        _, grad = loss_and_grad(p, np.ascontiguousarray(x[rows].T), np.ascontiguousarray(y[rows].T))
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        rate = 0.03 * min(1.0, 1.2 - step / TRAIN_STEPS)
        for k, g in grad.items():
            g = g / max(1.0, norm)
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            p[k] = p[k] - np.float32(rate) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return {k: v.astype(np.float32) for k, v in p.items()}


#: Where numpy has no AVX-512 code for tanh, it is made of exponentials, which are quicker there; the same but for rounding.
QUICK_TANH = "AVX512_SKX" in np.show_config(mode="dicts")["SIMD Extensions"].get("found", ())


@np.errstate(over="ignore")
def _scores(p, d, x):
    """What one direction adds to the tag scores: [time, tags, rows]. Symbols are looked up for two windows at once; one
    product gives what h adds to the next step and to the scores."""
    h_n, (steps, count) = HIDDEN, x.shape
    if count % 2:
        x = np.pad(x, ((0, 0), (0, 1)), constant_values=PAD)
    rows = count + count % 2
    pairs = x[:, ::2].astype(np.intp) * SYMBOLS + x[:, 1::2]
    # by tanh, gates and h are doubled; by exponentials, c and h are halved: both exact
    scale = np.repeat(np.float32([0.5, 1] if QUICK_TANH else [-1, -2]), (3 * h_n, h_n))[:, None]
    w, uv = p["w" + d] * scale, np.concatenate([p["u" + d] * scale, p["v" + d]]) * np.float32(0.5 if QUICK_TANH else 2)
    table = np.stack([np.repeat(w, SYMBOLS, 1), np.tile(w, SYMBOLS)], -1).view(np.int64)[..., 0]
    h, c = np.zeros((h_n, rows), np.float32), np.zeros((h_n, rows), np.float32)
    z, both, s = np.empty((4 * h_n, rows), np.float32), np.empty((4 * h_n + TAGS, rows), np.float32), np.empty_like(h)
    zu, scores = both[: 4 * h_n], both[4 * h_n :]
    looked, gates, g = z.view(np.int64), z[: 3 * h_n], z[3 * h_n :]
    i, f, o = gates[:h_n], gates[h_n : 2 * h_n], gates[2 * h_n :]
    out = np.empty((steps, TAGS, rows), np.float32)
    for t in range(steps):
        np.take(table, pairs[t], axis=1, out=looked, mode="clip")
        np.matmul(uv, h, out=both)
        if t:
            out[t - 1] = scores
        z += zu
        if QUICK_TANH:
            np.tanh(z, out=z)
            gates += 1
            c *= f
            np.multiply(i, g, out=s)
            c += s
            c *= 0.5
            np.tanh(c, out=s)
        else:
            np.exp(z, out=z)
            z += 1
            np.reciprocal(z, out=z)
            g -= 0.5
            c *= f
            np.multiply(i, g, out=s)
            c += s
            np.multiply(c, -4, out=s)
            np.exp(s, out=s)
            s += 1
            np.reciprocal(s, out=s)
            s -= 0.5
        np.multiply(o, s, out=h)
    np.matmul(uv, h, out=both)
    out[-1] = scores
    return out[..., :count]


def decode(p, x: np.ndarray) -> np.ndarray:
    """The best tags of windows x [time, rows]; no character has tag 0."""
    forth, back = _scores(p, "f", x), _scores(p, "b", x[::-1])
    steps, tags, rows = forth.shape
    off, bias, tr = x == PAD, p["bias"][:, None], p["trans"][:, :, None]
    came = np.empty((steps, tags, rows), np.uint8)
    score, e = np.zeros((tags, rows), np.float32), np.empty((tags, rows), np.float32)
    through, best = np.empty((tags, tags, rows), np.float32), np.zeros((tags, rows), np.float32)
    is_best, who = np.empty((tags, tags, rows), np.bool_), np.empty((tags, tags, rows), np.uint8)
    place = np.arange(tags, 0, -1, dtype=np.uint8)[:, None, None]  # of equal ones the first tag is taken
    for t in range(steps):
        if t:
            np.add(score[:, None], tr, out=through)
            np.maximum.reduce(through, axis=0, out=best)
            np.equal(through, best, out=is_best)
            np.multiply(is_best.view(np.uint8), place, out=who)
            np.maximum.reduce(who, axis=0, out=came[t])
        np.add(forth[t], back[-1 - t], out=e)
        e += bias
        np.copyto(e[0], 1e4, where=off[t])
        np.add(best, e, out=score)
    out, each = np.empty((steps, rows), np.uint8), np.arange(rows)
    out[-1] = score.argmax(0)
    for t in range(steps - 1, 0, -1):
        np.subtract(tags, came[t, out[t], each], out=out[t - 1])
    return out


def tag(p, texts: list[str]) -> list[np.ndarray]:
    """A tag for each character of each text, from overlapping windows."""
    syms = [symbols(t) for t in texts]
    out = [np.zeros(len(s), np.uint8) for s in syms]
    windows = []  # text, first and last character, and the first and last whose tag is taken
    for i, s in enumerate(syms):
        for at in range(0, len(s), WINDOW):
            last = len(s) - at <= WINDOW + MARGIN
            end = len(s) if last else at + WINDOW
            windows.append((i, max(0, at - MARGIN), min(len(s), end + MARGIN), at, end))
            if last:
                break
    windows.sort(key=lambda w: w[2] - w[1])
    for first in range(0, len(windows), ROWS):
        part = windows[first : first + ROWS]
        x = np.full((len(part), part[-1][2] - part[-1][1]), PAD, np.uint8)
        for row, (i, a, b, _, _) in zip(x, part, strict=True):
            row[: b - a] = syms[i][a:b]
        for got, (i, a, _, at, end) in zip(decode(p, np.ascontiguousarray(x.T)).T, part, strict=True):
            out[i][at:end] = got[at - a : end - a]
    return out


#: Without one of these there is no match of EMAIL_LIKE.
AT = ("@", " at ", "(at)", "[at]")
#: What a span of the model must look like besides, so that plain prose and invalid numbers stay out.
EMAIL_LIKE = re.compile(r"[\w.%+-]{1,64}(?: ?(?:@|\[at\]|\(at\)) ?[\w-]{1,63}(?:(?:\.| ?[\[(]dot[\])] ?| dot )[\w-]{1,63})+| at [\w-]{1,63}(?: dot [\w-]{1,63})+)")
NUMBER_LIKE = re.compile(r"[0-9 ().+-]{7,40}")


def _plausible(kind: int, s: str) -> bool:
    """The checks that the base patterns put on their matches hold for the model's spans too."""
    if kind == 0:
        return EMAIL_LIKE.fullmatch(s) is not None
    if NUMBER_LIKE.fullmatch(s) is None:
        return False
    if kind == 1:
        return IP.fullmatch(s) is not None and all(map(_small, s.split(".")))
    digits = re.sub("[^0-9]", "", s)
    return 13 <= len(digits) <= 19 and luhn(digits) if kind == 2 else 9 <= len(digits) <= 15 and len(digits) < len(s)


def model_spans(text: str, tags: np.ndarray) -> list[tuple[int, int, int]]:
    edge = np.flatnonzero(np.diff(tags)) + 1
    starts, ends = np.r_[0, edge], np.r_[edge, len(tags)]
    out = []
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        if b <= a or not (k := int(tags[a])):
            continue
        if k == 1:
            part = text[a:b]
            if not any(x in part for x in AT):
                continue
        while a < b and not (text[a].isalnum() or text[a] in "+("):
            a += 1
        while a < b and not text[b - 1].isalnum():
            b -= 1
        if k == 1 and (m := EMAIL_LIKE.search(text, a, b)):
            a, b = m.span()
        if _plausible(k - 1, text[a:b]):
            out.append((k - 1, a, b))
    return out


def find(p, texts: list[str]) -> list[tuple[list, list]]:
    """Of each text, the base spans, and all spans by kind and start."""
    out = []
    for text, tags in zip(texts, tag(p, texts), strict=True):
        base = base_spans(text)
        added = model_spans(text, tags) if tags.any() else []
        if base and added:
            covered = np.zeros(len(text) + 1, np.bool_)
            for _, a, b in base:
                covered[a:b] = True
            added = [x for x in added if not covered[x[1] : x[2]].any()]
        out.append((base, sorted(base + added)))
    return out


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def spans(df: DataFrame, keep=("doc_id",), text: str = "text") -> DataFrame:
    """`keep`, base (string: the base spans) and spans (string: all spans), each kind:start:end, comma-joined."""
    p = trained()

    def fn(texts):
        got = find(p, [t or "" for t in texts])
        return [[written(b) for b, _ in got], [written(s) for _, s in got]]

    return map_text(df, keep, text, "base string, spans string", fn)


def redacted(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """`keep`, and the text with each span of personal data replaced by its kind in brackets (null stays null)."""
    p = trained()

    def fn(texts):
        out = []
        for t, (_, found) in zip(texts, find(p, [t or "" for t in texts]), strict=True):
            parts, at = [], 0
            for k, a, b in sorted(found, key=lambda x: (x[1], -x[2])):
                if a >= at:
                    parts += [t[at:a], f"[{KINDS[k]}]"]
                at = max(at, b)
            out.append(t if t is None or not parts else "".join([*parts, t[at:]]))
        return [out]

    return map_text(df, keep, text, "text_out string", fn).withColumnRenamed("text_out", text)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = spans(documents(spark, sf_dir))
    count = lambda kind: F.size(F.filter(F.split("base", ","), lambda x: x.startswith(kind + ":"))).cast("long")
    return made.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS], F.sha2("base", 256).alias("base_sha256"), "spans", F.size(F.filter(F.split("spans", ","), lambda x: x != "")).cast("long").alias("n_spans"))
