"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions.

The tagger is trained in numpy from labelled spans (generated sentences whose personal data is known by
construction) and reads a text in overlapping windows of WINDOW characters. Each window is decoded by Viterbi
under BIO transitions; windows are reconciled over the whole text: the path of one window goes over to that of the next where the joined
path scores best. Spans are then widened to whole words and must have the facts of their kind (an address its @ and dot, a card
its Luhn digits, and so on), so decoding starts at windows near a digit or @, and goes on from there
while a tag is open at the border. Pattern spans always stay; a tagged span that touches one is dropped.

Defined results: a null text is the empty text; offsets are code points, ends exclusive; repeated rows give
equal spans; a span may have any length; an empty table gives no rows; other input columns are ignored (find) or kept (redact).
"""

from __future__ import annotations

import functools
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE = 96, 48
HIDDEN, EMBED = 16, 8
PART = 1 << 20
_TAGS = 1 + 2 * len(KINDS)  # O, then B and I of each kind

# ---- patterns ------------------------------------------------------------------------------------------

# The patterns of the contract, with lookbehinds and possessive runs where they only save time.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_TRIGGER = re.compile(r"[0-9@]")
_DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def _emails(text: str):
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        else:
            done = at + 1  # no local part reaches over an @
        at = text.find("@", done)


def _valid(kind: str, s: str) -> bool:
    if kind == "ip":
        return all(_small(p) for p in s.split("."))
    digits = "".join(_DIGITS.findall(s))
    return 13 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 9 <= len(digits) <= 15


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the patterns: by kind as listed, then start."""
    if not _TRIGGER.search(text):
        return []
    out = [("email", a, b) for a, b in _emails(text)]
    for kind, pattern in (("ip", _IP), ("card", _CARD), ("phone", _PHONE)):
        out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if _valid(kind, m.group())]
    return out


# ---- the tagger ----------------------------------------------------------------------------------------


def _classes() -> dict[str, int]:
    groups = ["0123456789", "@", ".", "-", "+", "(", ")", " ", "\n\r\t", "_", "%", ",;", ":", "/", "\"'`", "=", "#*$&|<>!", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]
    return {c: i + 2 for i, g in enumerate(groups) for c in g}


_CLASS = np.full(256, 1, np.uint8)  # 0 pads, 1 is any other character
for _c, _i in _classes().items():
    _CLASS[ord(_c)] = _i
N_CLASSES = 22


def encode(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 256, _CLASS[np.minimum(points, 255)], 1).astype(np.uint8)


def generate(n: int, seed: int) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """n sentences with the (kind, start, end) of their personal data; others hold look-alikes: versions, amounts, hex strings, failing card numbers."""
    rng = random.Random(seed)

    def digits(k):
        return "".join(rng.choice("0123456789") for _ in range(k))

    def word(letters="abcdefghijklmnopqrstuvwxyz", extra=""):
        return "".join(rng.choice(letters + extra) for _ in range(rng.randrange(2, 9)))

    def email():
        extra = rng.choice(["", "éüñ"])
        name = rng.choice(["{}", "{}.{}", "{}_{}", "{}{}"]).format(word(extra=extra), rng.choice([word(extra=extra), digits(2)]))
        return f"{name}@{word(extra=extra)}.{rng.choice(['com', 'example.org', 'co.uk', 'de'])}"

    def ip():
        return ".".join(str(rng.randrange(256)) for _ in range(4))

    def card():
        body = digits(15)
        full = body + next(c for c in "0123456789" if luhn(body + c))
        gap = rng.choice(["", "", " ", "-", ".", "/"])
        return gap.join(full[i : i + 4] for i in range(0, 16, 4))

    def phone():
        return rng.choice([f"+{rng.randrange(1, 99)} ({digits(3)}) {digits(3)}-{digits(4)}", f"+{digits(2)} {digits(3)} {digits(7)}", f"+{digits(11)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}"])

    def decoy():
        return rng.choice([f"version {rng.randrange(9)}.{rng.randrange(9)}.", f"{rng.randrange(3000)}", f'token = "{"".join(rng.choice("0123456789abcdef") for _ in range(40))}"', f"{digits(rng.randrange(1, 7))}%", f"{rng.randrange(99)},{digits(3)}", f"@{word()}", f"{word()} @ {word()}", f"{digits(4)}-{digits(2)}-{digits(2)}", f"{digits(2)}:{digits(2)}", f"{word()}{digits(2)}", digits(16) if rng.random() < 0.5 else f"{digits(20)}", f"{word()}={digits(3)}"])

    makers = {"email": email, "ip": ip, "card": card, "phone": phone}
    out = []
    for _ in range(n):
        text, spans = "", []
        upper, tail = rng.random() < 0.1, rng.choice(["", "", "", "###", "$$$", "!!", "%%%"])
        for _ in range(rng.randrange(3, 14)):
            roll = rng.random()
            if roll < 0.22:
                kind = rng.choice(KINDS)
                piece = makers[kind]()
                spans.append((kind, len(text), len(text) + len(piece)))
            elif roll < 0.42:
                piece = decoy()
            else:
                piece = rng.choice([word(), word().capitalize(), word(extra="éüñß"), word() + rng.choice(",.;")])
            text += (piece.upper() if upper and piece.upper().lower() == piece.lower() and len(piece.upper()) == len(piece) else piece) + tail + rng.choice([" ", " ", " ", "\n", ". ", ", ", " | "])
        out.append((text, spans))
    return out


def _tags(text: str, spans: list[tuple[str, int, int]]) -> np.ndarray:
    y = np.zeros(len(text), np.int64)
    for kind, a, b in spans:
        k = 1 + 2 * KINDS.index(kind)
        y[a], y[a + 1 : b] = k, k + 1
    return y


def _shapes() -> dict[str, tuple[int, ...]]:
    h, e = HIDDEN, EMBED
    return {"E": (N_CLASSES, e), "Wf": (e, 4 * h), "Uf": (h, 4 * h), "bf": (4 * h,), "Wb": (e, 4 * h), "Ub": (h, 4 * h), "bb": (4 * h,), "V": (2 * h, _TAGS), "c": (_TAGS,), "A": (_TAGS, _TAGS), "start": (_TAGS,)}


def _gates(z: np.ndarray) -> tuple[np.ndarray, ...]:
    h = HIDDEN
    s = 1 / (1 + np.exp(-z[:, : 3 * h]))
    return s[:, :h], s[:, h : 2 * h], s[:, 2 * h :], np.tanh(z[:, 3 * h :])


def _lstm(zx: np.ndarray, u: np.ndarray, back: bool, keep: list | None = None) -> np.ndarray:
    """Hidden states (time, rows, HIDDEN) from inputs zx (time, rows, 4 * HIDDEN)."""
    n = zx.shape[1]
    h = c = np.zeros((n, HIDDEN), zx.dtype)
    out = np.empty((len(zx), n, HIDDEN), zx.dtype)
    for t in range(len(zx) - 1, -1, -1) if back else range(len(zx)):
        i, f, o, g = _gates(zx[t] + h @ u)
        new = f * c + i * g
        tc = np.tanh(new)
        if keep is not None:
            keep.append((t, i, f, o, g, c, tc, h))
        h, c = o * tc, new
        out[t] = h
    return out


def _lstm_grad(dh_out: np.ndarray, u: np.ndarray, keep: list) -> tuple[np.ndarray, np.ndarray]:
    dz_all = np.empty((*dh_out.shape[:2], 4 * HIDDEN), dh_out.dtype)
    du, dh, dc = np.zeros_like(u), 0.0, 0.0
    for t, i, f, o, g, c, tc, h in reversed(keep):
        dh = dh_out[t] + dh
        dc = dc + dh * o * (1 - tc * tc)
        dz = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], 1)
        dz_all[t] = dz
        du += h.T @ dz
        dh, dc = dz @ u.T, dc * f
    return dz_all, du


def emissions(model: dict, x: np.ndarray) -> np.ndarray:
    """Tag scores (time, rows, tags) of class codes x (rows, time)."""
    codes = x.T
    zf = (model["E"] @ model["Wf"] + model["bf"])[codes]
    hf = _lstm(zf, model["Uf"], False)
    zb = (model["E"] @ model["Wb"] + model["bb"])[codes]
    hb = _lstm(zb, model["Ub"], True)
    return np.concatenate([hf, hb], 2) @ model["V"] + model["c"]


def viterbi(model: dict, e: np.ndarray) -> np.ndarray:
    """Best tags (rows, time)."""
    a = model["A"].T[None]
    score = e[0] + model["start"]
    back = np.empty((len(e), e.shape[1], _TAGS), np.int8)
    for t in range(1, len(e)):
        s = score[:, None, :] + a
        back[t] = s.argmax(2)
        score = s.max(2) + e[t]
    tags = np.empty((e.shape[1], len(e)), np.int8)
    tags[:, -1] = score.argmax(1)
    rows = np.arange(e.shape[1])
    for t in range(len(e) - 1, 0, -1):
        tags[:, t - 1] = back[t][rows, tags[:, t]]
    return tags


def _crf_grad(e: np.ndarray, y: np.ndarray, model: dict) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Negative log-likelihood of tags y (rows, time), and its gradients by emissions, transitions and start."""
    steps, rows, k = e.shape
    a, start = model["A"], model["start"]

    def lse(x, axis):
        m = x.max(axis, keepdims=True)
        return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)

    alpha, beta = np.empty_like(e), np.zeros_like(e)
    alpha[0] = e[0] + start
    for t in range(1, steps):
        alpha[t] = e[t] + lse(alpha[t - 1][:, :, None] + a, 1)
    for t in range(steps - 2, -1, -1):
        beta[t] = lse(a + (e[t + 1] + beta[t + 1])[:, None, :], 2)
    z = lse(alpha[-1], 1)
    de = np.exp(alpha + beta - z[:, None])
    dstart = de[0].sum(0)
    da = np.zeros_like(a)
    for t in range(1, steps):
        da += np.exp(alpha[t - 1][:, :, None] + a + (e[t] + beta[t])[:, None, :] - z[:, None, None]).sum(0)
    r = np.arange(rows)
    gold = start[y[:, 0]] + e[0][r, y[:, 0]]
    np.add.at(dstart, y[:, 0], -1)
    for t in range(steps):
        de[t][r, y[:, t]] -= 1
        if t:
            gold = gold + e[t][r, y[:, t]] + a[y[:, t - 1], y[:, t]]
            np.add.at(da, (y[:, t - 1], y[:, t]), -1)
    return float((z - gold).sum()), de, da, dstart


@functools.lru_cache(maxsize=2)
def train(sentences: int = 1200, epochs: int = 5, seed: int = 7) -> dict:
    """The tagger's parameters, float32. Deterministic; one training for each process."""
    rng = np.random.default_rng(seed)
    model = {k: (rng.normal(size=s) * (0.5 if k == "E" else 0.25) if len(s) == 2 and k != "A" else np.zeros(s)).astype(np.float32) for k, s in _shapes().items()}
    model["bf"][HIDDEN : 2 * HIDDEN] = model["bb"][HIDDEN : 2 * HIDDEN] = 1
    for k in range(_TAGS):  # an I follows a B or I of its kind alone
        if k and k % 2 == 0:
            model["start"][k] = -30
            for j in range(_TAGS):
                if j not in (k, k - 1):
                    model["A"][j, k] = -30
    frozen = model["A"] < -1, model["start"] < -1
    xs, ys = [], []
    for text, spans in generate(sentences, seed):
        x, y = encode(text), _tags(text, spans)
        for a in range(0, max(1, len(x) - WINDOW // 2), WINDOW):
            px, py = np.zeros(WINDOW, np.uint8), np.zeros(WINDOW, np.int64)
            part = y[a : a + WINDOW].copy()
            if part[0] and part[0] % 2 == 0:  # a span cut by the border has no start here
                part[: np.argmax(np.r_[part, 0] != part[0])] = 0
            px[: len(part)], py[: len(part)] = x[a : a + WINDOW], part
            xs.append(px)
            ys.append(py)
    x, y = np.array(xs), np.array(ys)
    m = {k: np.zeros_like(v) for k, v in model.items()}
    v = {k: np.zeros_like(p) for k, p in model.items()}
    step, batch = 0, 32
    total = epochs * -(-len(x) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(x), batch):
            own = order[i : i + batch]
            codes = x[own].T
            emb = model["E"][codes]
            kf, kb = [], []
            hf = _lstm(emb @ model["Wf"] + model["bf"], model["Uf"], False, kf)
            hb = _lstm(emb @ model["Wb"] + model["bb"], model["Ub"], True, kb)
            h = np.concatenate([hf, hb], 2)
            _, de, da, ds = _crf_grad(h @ model["V"] + model["c"], y[own], model)
            g = {"V": np.einsum("tbh,tbk->hk", h, de), "c": de.sum((0, 1)), "A": np.where(frozen[0], 0, da), "start": np.where(frozen[1], 0, ds)}
            dh = de @ model["V"].T
            zf, g["Uf"] = _lstm_grad(dh[:, :, :HIDDEN], model["Uf"], kf)
            zb, g["Ub"] = _lstm_grad(dh[:, :, HIDDEN:], model["Ub"], kb)
            g["Wf"], g["bf"] = np.einsum("tbe,tbz->ez", emb, zf), zf.sum((0, 1))
            g["Wb"], g["bb"] = np.einsum("tbe,tbz->ez", emb, zb), zb.sum((0, 1))
            g["E"] = np.zeros_like(model["E"])
            np.add.at(g["E"], codes, zf @ model["Wf"].T + zb @ model["Wb"].T)
            norm = np.sqrt(sum(float((p * p).sum()) for p in g.values()))
            step += 1
            rate = 0.02 * min(1.0, step / 20) * (1 - step / (total + 1)) + 1e-4
            for k, p in g.items():
                p = p * min(1.0, 50 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * p
                v[k] = 0.99 * v[k] + 0.01 * p * p
                model[k] = (model[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return model


_INNER = {"email": frozenset("._%+-"), "ip": frozenset("."), "card": frozenset(), "phone": frozenset("+(")}


def _sound(kind: str, s: str) -> bool:
    """The facts that a span of a kind must have, whatever its shape: the @ and dots of an address, numbers up to 255, digit counts, Luhn."""
    if kind == "email":
        name, at, host = s.partition("@")
        return bool(name and at) and "." in host.strip(".") and "@" not in host and not any(c.isspace() for c in s)
    if any(c.isalpha() for c in s):
        return False
    groups = re.findall(r"[0-9]+", s)
    if kind == "ip":
        return len(groups) == 4 and all(map(_small, groups)) and s.count(".") == 3 == len(s) - sum(map(len, groups))
    if kind == "card":
        return _valid(kind, s)
    return _valid(kind, s) and max(map(len, groups)) >= 3 and (len(groups) > 1 or s[0] == "+") and s.count(".") < 3


def _stretches(ks: np.ndarray) -> np.ndarray:
    """Whether window ks[i] follows window ks[i - 1] without a gap."""
    return np.r_[False, ks[1:] == ks[:-1] + 1] if len(ks) else np.zeros(0, bool)


def _reconciled(ks: np.ndarray, tags: np.ndarray, score: np.ndarray, a: np.ndarray, length: int) -> list[tuple[int, np.ndarray]]:
    """(start, tags) of each stretch of overlapping windows. Of two neighbours the one path goes over to the other at the place in their
    overlap where the joined path has the best score. score: log-probability of each tag's emission plus the transition into it."""
    total = np.concatenate([np.zeros((len(ks), 1), score.dtype), np.cumsum(score, axis=1)], axis=1)
    follow = np.flatnonzero(_stretches(ks))
    overlap = WINDOW - STRIDE
    # Going over before character c of the overlap: the left path up to c, a step, the right path from c on.
    left, right = tags[follow - 1, STRIDE - 1 : -1], tags[follow, : overlap]
    step = a[left, right] - np.where(np.arange(overlap) > 0, a[np.r_["1", right[:, :1], right[:, :-1]], right], 0)
    joint = total[follow - 1, STRIDE : WINDOW] - total[follow - 1, STRIDE, None] + total[follow, overlap, None] - total[follow, :overlap] + step
    go = np.zeros(len(ks), np.int64)
    go[follow] = joint.argmax(1)
    out = []
    begins = np.flatnonzero(~_stretches(ks))
    for i, j in zip(begins.tolist(), [*begins[1:].tolist(), len(ks)], strict=True):
        # A window gives its tags from its own crossing to that of the next one.
        ends = np.full(j - i, WINDOW)
        ends[:-1] = STRIDE + go[i + 1 : j]
        parts = [tags[r, go[r] : e] for r, e in zip(range(i, j), ends.tolist(), strict=True)]
        start = int(ks[i]) * STRIDE - (WINDOW - STRIDE) // 2
        joined = np.concatenate(parts)
        out.append((max(start, 0), joined[max(0, -start) : length - start]))
    return out


def _decode(codes: list[np.ndarray], ks: list[np.ndarray], model: dict) -> list[tuple[np.ndarray, np.ndarray]]:
    """(tags, scores) of windows ks[r] of each text. Window k starts at k * STRIDE - (WINDOW - STRIDE) / 2."""
    where = np.repeat(np.arange(len(ks)), [len(k) for k in ks])
    flat = np.concatenate([*ks, np.zeros(0, np.int64)])
    tags, score = np.empty((len(flat), WINDOW), np.int8), np.empty((len(flat), WINDOW), np.float32)
    for i in range(0, len(flat), 1024):
        x = np.zeros((min(1024, len(flat) - i), WINDOW), np.uint8)
        for row, r, k in zip(x, where[i : i + 1024].tolist(), flat[i : i + 1024].tolist(), strict=True):
            at = k * STRIDE - (WINDOW - STRIDE) // 2
            part = codes[r][max(at, 0) : at + WINDOW]
            row[max(-at, 0) : max(-at, 0) + len(part)] = part
        e = emissions(model, x)
        own = tags[i : i + 1024] = viterbi(model, e)
        top = e.max(2)
        best = np.take_along_axis(e, own.T[:, :, None].astype(np.int64), 2)[:, :, 0] - top - np.log(np.exp(e - top[:, :, None]).sum(2))
        score[i : i + 1024] = best.T
        score[i : i + 1024, 1:] += model["A"][own[:, :-1], own[:, 1:]]
    cuts = np.cumsum([0, *map(len, ks)])
    return [(tags[a:b], score[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def _parts(codes: np.ndarray):
    """(offset, codes) of the pieces of a text of about PART characters, cut where no digit or @ is near, so that they decode as the whole does."""
    at = 0
    if len(codes) > PART:
        hot = np.flatnonzero((codes == 2) | (codes == 3))
        lone = np.flatnonzero(np.diff(np.r_[hot, len(codes)]) > 6 * WINDOW)
        for place in hot[lone].tolist():
            cut = -(-(place + 3 * WINDOW) // STRIDE) * STRIDE
            if cut - at >= PART and cut < len(codes):
                yield at, codes[at:cut]
                at = cut
    yield at, codes[at:]


def _tags_of(codes: list[np.ndarray], model: dict) -> list[list[tuple[int, np.ndarray]]]:
    """The stretches of tags of each text: windows near a digit or @, and on from there while a tag is open at a stretch's border."""
    known = []
    wanted = []
    for c in codes:
        hot = np.flatnonzero((c == 2) | (c == 3))
        ks = np.unique(np.concatenate([(hot + d) // STRIDE for d in (-STRIDE, 0, STRIDE)]))
        wanted.append(ks[(ks >= 0) & (ks * STRIDE < len(c))])
        known.append((np.zeros(0, np.int64), np.zeros((0, WINDOW), np.int8), np.zeros((0, WINDOW), np.float32)))
    reach = 1
    while any(map(len, wanted)):
        for r, (tags, score) in enumerate(_decode(codes, wanted, model)):
            if len(wanted[r]):
                ks, old, seen = known[r]
                order = np.argsort(np.r_[ks, wanted[r]], kind="stable")
                known[r] = (np.r_[ks, wanted[r]][order], np.concatenate([old, tags])[order], np.concatenate([seen, score])[order])
        nxt = []
        for c, (ks, tags, _), new in zip(codes, known, wanted, strict=True):
            more = np.zeros(0, np.int64)
            if len(new):
                # The border windows of the stretches; their tags at the edge tell whether a span goes on there.
                first, last = ~_stretches(ks), np.r_[~_stretches(ks)[1:], True]
                side = (WINDOW - STRIDE) // 2
                back, on = ks[first & (tags[:, side] > 0)], ks[last & (tags[:, WINDOW - side - 1] > 0)]
                steps = np.arange(1, reach + 1)
                more = np.unique(np.r_[(back[:, None] - steps).ravel(), (on[:, None] + steps).ravel()])
                more = np.setdiff1d(more[(more >= 0) & (more * STRIDE < len(c))], ks)
            nxt.append(more)
        wanted, reach = nxt, reach * 2
    return [_reconciled(ks, tags, score, model["A"], len(c)) if len(ks) else [] for c, (ks, tags, score) in zip(codes, known, strict=True)]


def _widened(text: str, kind: str, lo: int, hi: int, floor: int) -> tuple[int, int]:
    """The span with the letters, digits and inner marks of its kind that touch it, as far left as `floor`."""
    inner = _INNER[kind]
    while lo > floor and (text[lo - 1].isalnum() or text[lo - 1] in inner):
        lo -= 1
    while hi < len(text) and text[hi].isalnum():
        hi += 1
    return lo, hi


def tagged_spans(texts: list[str], model: dict) -> list[list[tuple[str, int, int]]]:
    """Spans that the tagger finds in each text, of any length: tags reconciled over all windows, widened to whole words, sound for their kind."""
    spans: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    done = [0] * len(texts)

    def take(group: list[tuple[int, int, np.ndarray]]) -> None:
        for (i, offset, _), stretches in zip(group, _tags_of([c for _, _, c in group], model), strict=True):
            for start, tag in stretches:
                hit = np.flatnonzero(tag)
                if not len(hit):
                    continue
                kind = (tag[hit] - 1) // 2
                new = np.r_[True, (hit[1:] != hit[:-1] + 1) | (kind[1:] != kind[:-1]) | (tag[hit][1:] % 2 == 1)]
                first = np.flatnonzero(new)
                for a, b in zip(first, np.r_[first[1:], len(hit)], strict=True):
                    name, lo, hi = KINDS[kind[a]], offset + start + int(hit[a]), offset + start + int(hit[b - 1]) + 1
                    if lo >= done[i]:
                        lo, done[i] = _widened(texts[i], name, lo, hi, done[i])
                        if _sound(name, texts[i][lo : done[i]]):
                            spans[i].append((name, lo, done[i]))

    group, size = [], 0
    for i, text in enumerate(texts):
        for offset, codes in _parts(encode(text)):
            group.append((i, offset, codes))
            size += len(codes)
            if size >= PART:
                take(group)
                group, size = [], 0
    take(group)
    return spans


def find_spans(texts: list[str], model: dict) -> list[tuple[list, list]]:
    """(pattern spans, all spans) of each text, sorted by kind as listed, then start."""
    out = []
    for base, more in zip(map(base_spans, texts), tagged_spans(texts, model), strict=True):
        busy = sorted((a, b) for _, a, b in base)
        extra = [s for s in more if not any(a < s[2] and s[1] < b for a, b in busy)] if len(busy) < 50 else _apart(more, busy)
        out.append((base, sorted(base + extra, key=lambda s: (KINDS.index(s[0]), s[1]))))
    return out


def _apart(more: list, busy: list) -> list:
    """Those of `more` that overlap none of `busy`."""
    starts = np.array([a for a, _ in busy])
    reach = np.maximum.accumulate(np.array([b for _, b in busy]))
    return [s for s in more if (k := int(np.searchsorted(starts, s[2]))) == 0 or reach[k - 1] <= s[1]]


def _line(spans: list) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _hot_only(texts: list[str | None], model: dict):
    """(pattern spans, all spans) of each text, about PART characters at a time; texts without digit or @ cannot have any."""
    found: list = [([], [])] * len(texts)
    hot = [i for i, t in enumerate(texts) if t and _TRIGGER.search(t)]
    ends = np.cumsum([len(texts[i]) for i in hot]) // PART
    for k in np.unique(ends).tolist():
        own = [i for i, e in zip(hot, ends.tolist(), strict=True) if e == k]
        for i, spans in zip(own, find_spans([texts[j] for j in own], model), strict=True):
            found[i] = spans
    return found


def find(df: DataFrame, key: str, text: str, model: dict | None = None) -> DataFrame:
    """(key, n_email, n_ip, n_card, n_phone, base_sha256, spans): counts and digest of pattern spans; spans holds all."""
    model = model or train()
    kind = dict(df.select(key).dtypes)[key]

    def run(batches):
        for batch in batches:
            found = _hot_only(batch.column(1).to_pylist(), model)
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array([hashlib.sha256(_line(b).encode()).hexdigest() for b, _ in found]), pa.array([_line(s) for _, s in found], pa.string())], [key, *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def _masked(text: str | None, spans: list) -> str | None:
    if not spans:
        return text
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact(df: DataFrame, text: str, model: dict | None = None) -> DataFrame:
    """df with every span in `text` replaced by its kind in angle brackets; other columns stay."""
    model = model or train()
    at = df.columns.index(text)

    def run(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            new = [_masked(t, s) for t, (_, s) in zip(texts, _hot_only(texts, model), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(new, batch.schema.field(i).type) if i == at else c for i, c in enumerate(batch.columns)], batch.schema.names)

    return df.mapInArrow(run, df.schema)


def op3_bilstm_crf_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(documents(spark, sf_dir), "doc_id", "text")
