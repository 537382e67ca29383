"""Personal data by fixed patterns, and by a character-level bidirectional LSTM with CRF transitions that adds to them.

Base spans (email, ip, card, phone) follow fixed patterns and always stay. The tagger is trained in numpy from
labelled spans that ``examples`` makes: written-out and obfuscated forms that the patterns miss. It reads overlapping windows
around every place where a span can be at all (a digit, an ``@``, a written-out ``at``/``dot``, or a plain ``at`` before a word
with a dot; no value that ``valid`` accepts is without one, so nothing is lost by leaving out the rest), each character takes the label of the window in which it lies furthest from an edge, and
the labels of a text are then read as spans once. A tagged span is added if it is valid for its kind (Luhn, ranges, numbers of
digits) and meets no base span and no added one.

Null and empty texts have no spans; texts are read whole, in batches of windows; repeated rows are each tagged; an
empty table gives no rows; other columns pass through ``redact`` and are not read otherwise. Offsets count code points.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("email", "ip", "card", "phone")
# Fixed patterns. A look-behind only spares tries inside a run of digits that its first digit already decides.
HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SIGN = re.compile(r"[0-9@]")

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = sum(int(c) if i % 2 == 0 else (2 * int(c)) // 10 + (2 * int(c)) % 10 for i, c in enumerate(reversed(digits)))
    return total % 10 == 0


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def base_spans(text: str) -> list[Span]:
    """By kind, then start."""
    if not SIGN.search(text):
        return []
    out: list[Span] = []
    end = 0
    for m in HOST.finditer(text) if "@" in text else ():
        at = m.start()
        while at > end and text[at - 1] in LOCAL:
            at -= 1
        if at < m.start():
            out.append((0, at, m.end()))
            end = m.end()
    out += [(1, *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    out += [(2, *m.span()) for m in CARD.finditer(text) if 16 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    out += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


# ---- labelled spans -----------------------------------------------------------------------------------------------


# What examples are made of beside syllables: names, words of host names, and prose of the corpus's languages.
FIRST = "john maria peter anna thomas laura ahmed chen olga luis sophie marc ines jonas paul elena david sara ivan lucy".split()
LAST = "miller garcia schmidt rossi dubois novak jensen kim lopez weber martin brown moreau silva fischer".split()
PLACES = "example mail university web company site post office club shop institute team bank city press studio".split()
ENDINGS = "com org net edu de es fr info io co.uk example.com example.org".split()
PROSE = (
    "please write to contact me or call us at the number below for details we met at noon look figure the meeting is at two in room and then "
    "bitte schreiben sie an oder rufen sie mich um acht uhr an der die das und nicht mit por favor escriba a o llame el la de los con para "
    "merci de nous écrire ou appeler avant le soir les des une dans pour sur page chapter version server address card phone mail e-mail".split()
)


def examples(n: int, seed: int = 7) -> list[tuple[str, list[Span]]]:
    """Sentences with labelled spans in forms that the patterns know and forms that they miss, and sentences with
    numbers that are no personal data."""
    rng = np.random.default_rng(seed)
    pick = lambda *x: x[rng.integers(len(x))]
    num = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    syllables = ("an", "er", "in", "the", "re", "on", "tion", "ble", "que", "eau", "sch", "ung", "ción", "as", "ou", "li", "ma", "to", "ver", "ß", "é")
    made = lambda: "".join(pick(*syllables) for _ in range(rng.integers(1, 4)))
    word = lambda: pick(*PROSE) if rng.random() < 0.5 else made()
    cased = lambda w: pick(w, w, w.capitalize())

    def person() -> str:
        return cased(pick(*FIRST)) + pick("", pick(".", "_", "-", "") + cased(pick(*LAST)), pick(".", "_", "") + num(2)) if rng.random() < 0.5 else made() + pick("", "", "." + num(2), "." + made())

    def host() -> str:
        return (pick(*PLACES) if rng.random() < 0.6 else made()) + pick("", "", "-" + made(), num(1))

    def card() -> str:
        d = num(15)
        d += next(c for c in "0123456789" if luhn(d + c))
        sep = pick("", " ", "-", ".", "/", "  ", "_")
        return sep.join(d[i : i + 4] for i in range(0, 16, 4))

    def value(kind: int) -> str:
        if kind == 0:
            at, dot = pick(("@", "."), (" at ", "."), (" at ", "."), (" at ", "."), (" at ", " dot "), (" at ", " dot "), ("(at)", "."), (" (at) ", "."), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" [at] ", " [dot] "), (" [at] ", "."), (" (at) ", " [dot] "), (" @ ", "."))
            return person() + at + dot.join([host(), *pick(*ENDINGS).split(".")])
        if kind == 1:
            return pick(".", ".", "[.]", "(.)", " . ").join(str(rng.integers(0, 256)) for _ in range(4))
        if kind == 2:
            return card()
        return pick(lambda: f"+1 ({num(3)}) {num(3)}-{num(4)}", lambda: f"({num(3)}) {num(3)}-{num(4)}", lambda: f"({num(3)}){num(3)}.{num(4)}", lambda: f"00{num(2)} {num(3)} {num(3)} {num(3)}", lambda: f"+{num(2)}/{num(3)}/{num(6)}")()

    plain = (lambda: num(rng.integers(1, 5)), lambda: f"{num(2)}.{num(2)}.20{num(2)}", lambda: f"{num(1)}.{num(2)}", lambda: f"20{num(2)}-{num(2)}-{num(2)}", lambda: f"{num(2)}:{num(2)}", lambda: f"${num(3)},{num(3)}", lambda: f"{num(2)}%", lambda: f"v{num(1)}.{num(1)}.{num(1)}", lambda: f"AKIA{num(16)}", lambda: pick("the at dot", pick("look", "meet", "sold", "online", "noon.") + f" at {host()}.{pick(*ENDINGS)}", f"at the {pick(*PLACES)}", f"sat at the dot com {pick(*PLACES)}", "at noon. at last", f"figure {num(1)}.{num(1)} at page {num(2)}", "(at) last [dot]"), lambda: f"({num(4)})", lambda: f"{num(24)}", word, word)
    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(rng.integers(2, 7)):
            text += " ".join(word() for _ in range(rng.integers(1, 5))) + pick(" ", ": ", ", ", "\n", " ")
            if rng.random() < 0.6:
                kind = int(rng.integers(4))
                v = value(kind)
                spans.append((kind, len(text), len(text) + len(v)))
            else:
                v = plain[rng.integers(len(plain))]()
            text += v + pick(" ", ". ", ", ", "\n", "; ")
        out.append((text, spans))
    return out


# ---- the tagger ---------------------------------------------------------------------------------------------------

WINDOW, STRIDE = 96, 48
LABELS = 1 + 2 * len(KINDS)  # none, then begin and inside of each kind
#: Characters with an entry of their own; others share one for letters, one for other signs, one for white space.
OWN = "0123456789@.+-()[] /_,:;%$#*" + "abcdefghijklmnopqrstuvwxyz"
TABLE = np.array([2 + OWN.index(c.lower()) if c.lower() in OWN else 2 + len(OWN) + (0 if c.isalpha() else 1 if c.isspace() else 2) for c in map(chr, range(0x250))])
VOCABULARY = 2 + len(OWN) + 3


def coded(text: str) -> np.ndarray:
    """Character classes; 0 is padding."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < len(TABLE), TABLE[np.minimum(points, len(TABLE) - 1)], 2 + len(OWN))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Tagger:
    def __init__(self, hidden: int = 20, embedding: int = 12, seed: int = 1):
        rng = np.random.default_rng(seed)
        make = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.h = hidden
        self.p = {"e": make(VOCABULARY, embedding), "o": make(2 * hidden, LABELS), "ob": np.zeros(LABELS, np.float32), "t": np.zeros((LABELS, LABELS), np.float32)}
        for d in "fb":
            self.p |= {f"x{d}": make(embedding, 4 * hidden), f"h{d}": make(hidden, 4 * hidden), f"b{d}": np.zeros(4 * hidden, np.float32)}

    def _lstm(self, x: np.ndarray, d: str, keep: bool):
        """x: windows, time, embedding. Backward in time for d = "b"."""
        n, steps, _ = x.shape
        h, c, out, saved = np.zeros((n, self.h), np.float32), np.zeros((n, self.h), np.float32), np.empty((n, steps, self.h), np.float32), []
        fixed = x @ self.p[f"x{d}"] + self.p[f"b{d}"]
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = fixed[:, t] + h @ self.p[f"h{d}"]
            i, f, o = (sigmoid(z[:, k * self.h : (k + 1) * self.h]) for k in range(3))
            g = np.tanh(z[:, 3 * self.h :])
            before, h0 = c, h
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            out[:, t] = h
            if keep:
                saved.append((t, i, f, o, g, before, tc, h0))
        return out, saved

    def _back(self, x: np.ndarray, dout: np.ndarray, saved: list, d: str, grad: dict) -> np.ndarray:
        dx, dh, dc = np.zeros_like(x), np.zeros((len(x), self.h), np.float32), np.zeros((len(x), self.h), np.float32)
        for t, i, f, o, g, before, tc, h0 in reversed(saved):
            dh = dh + dout[:, t]
            dc = dc + dh * o * (1 - tc * tc)
            dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], 1)
            grad[f"x{d}"] += x[:, t].T @ dz
            grad[f"h{d}"] += h0.T @ dz
            grad[f"b{d}"] += dz.sum(0)
            dx[:, t] = dz @ self.p[f"x{d}"].T
            dh, dc = dz @ self.p[f"h{d}"].T, dc * f
        return dx

    def emissions(self, codes: np.ndarray, keep: bool = False):
        x = self.p["e"][codes]
        f, sf = self._lstm(x, "f", keep)
        b, sb = self._lstm(x, "b", keep)
        both = np.concatenate([f, b], 2)
        return both @ self.p["o"] + self.p["ob"], (x, both, sf, sb)

    def loss(self, codes: np.ndarray, gold: np.ndarray) -> tuple[float, dict]:
        """Negative log likelihood of the CRF by window, and its gradient."""
        u, (x, both, sf, sb) = self.emissions(codes, True)
        n, steps, _ = u.shape
        u, t = u.astype(np.float64), self.p["t"].astype(np.float64)
        lse = lambda a, axis: (m := a.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - m).sum(axis))
        alpha, beta = np.empty_like(u), np.zeros_like(u)
        alpha[:, 0] = u[:, 0]
        for k in range(1, steps):
            alpha[:, k] = u[:, k] + lse(alpha[:, k - 1][:, :, None] + t, 1)
        for k in range(steps - 2, -1, -1):
            beta[:, k] = lse(t + (u[:, k + 1] + beta[:, k + 1])[:, None, :], 2)
        z = lse(alpha[:, -1], 1)
        rows, times = np.arange(n)[:, None], np.arange(steps)[None, :]
        score = u[rows, times, gold].sum(1) + t[gold[:, :-1], gold[:, 1:]].sum(1)
        du = np.exp(alpha + beta - z[:, None, None])
        du[rows, times, gold] -= 1
        pair = np.exp(alpha[:, :-1, :, None] + t + (u[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]).sum((0, 1))
        np.subtract.at(pair, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1)
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        du = (du / n).astype(np.float32)
        grad["t"], grad["ob"] = (pair / n).astype(np.float32), du.sum((0, 1))
        grad["o"] = both.reshape(-1, 2 * self.h).T @ du.reshape(-1, LABELS)
        dboth = du @ self.p["o"].T
        dx = self._back(x, dboth[:, :, : self.h], sf, "f", grad) + self._back(x, dboth[:, :, self.h :], sb, "b", grad)
        np.add.at(grad["e"], codes.ravel(), dx.reshape(-1, dx.shape[2]))
        return float((z - score).mean()), grad

    def fit(self, sentences: list[tuple[str, list[Span]]], epochs: int, batch: int = 64, rate: float = 0.02) -> float:
        codes, gold = windows_of(sentences)
        rng, m, v, step, last = np.random.default_rng(3), {}, {}, 0, 0.0
        for epoch in range(epochs):
            order, losses = rng.permutation(len(codes)), []
            for at in range(0, len(order), batch):
                rows = order[at : at + batch]
                value, grad = self.loss(codes[rows], gold[rows])
                losses.append(value)
                step += 1
                norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
                for k, g in grad.items():
                    g = g * min(1, 5 / (norm + 1e-9))
                    m[k] = 0.9 * m.get(k, 0) + 0.1 * g
                    v[k] = 0.999 * v.get(k, 0) + 0.001 * g * g
                    self.p[k] -= (rate * 0.5**(epoch // 3) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            last = float(np.mean(losses))
        return last

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """The best labels of each window (Viterbi)."""
        u, _ = self.emissions(codes)
        n, steps, _ = u.shape
        best, back = u[:, 0], np.empty((n, steps, LABELS), np.int8)
        for k in range(1, steps):
            s = best[:, :, None] + self.p["t"]
            back[:, k] = s.argmax(1)
            best = u[:, k] + s.max(1)
        out = np.empty((n, steps), np.int8)
        out[:, -1] = best.argmax(1)
        for k in range(steps - 1, 0, -1):
            out[:, k - 1] = back[np.arange(n), k, out[:, k]]
        return out


def windows_of(sentences: list[tuple[str, list[Span]]]) -> tuple[np.ndarray, np.ndarray]:
    codes, gold = [], []
    for text, spans in sentences:
        c, g = coded(text), np.zeros(len(text), np.int64)
        for kind, a, b in spans:
            g[a:b], g[a] = 2 + 2 * kind, 1 + 2 * kind
        for at in range(0, max(1, len(c) - STRIDE), STRIDE):
            part = slice(at, at + WINDOW)
            pad = WINDOW - len(c[part])
            codes.append(np.pad(c[part], (0, pad)))
            gold.append(np.pad(g[part], (0, pad)))
    return np.array(codes), np.array(gold)


@functools.lru_cache(maxsize=2)
def trained(n: int = 2000, epochs: int = 9, seed: int = 7) -> Tagger:
    tagger = Tagger()
    tagger.fit(examples(n, seed), epochs)
    return tagger


# ---- windows, reconciliation, spans -------------------------------------------------------------------------------

#: Where a span of any kind can be: each holds a digit, an @, or its written-out form.
PLACE = re.compile(r"[0-9@]|[\[(]\s?(?:at|dot)\s?[\])]|\sdot\s|\sat\s(?=[^\s@]+\.[a-z0-9.-])", re.IGNORECASE)
BATCH = 512


def window_starts(text: str) -> list[int]:
    """Starts of the windows, on a grid of STRIDE, that hold a place or its surroundings."""
    cells = {m.start() // STRIDE for m in PLACE.finditer(text)}
    return [c * STRIDE for c in sorted({c + d for c in cells for d in (-1, 0)} | {max(0, c - 2) for c in cells}) if c >= 0]


def labels_of(tagger: Tagger, texts: list[str]) -> list[list[tuple[int, np.ndarray]]]:
    """For each text its windows as (start, labels)."""
    jobs = [(i, at) for i, t in enumerate(texts) for at in window_starts(t)]
    out: list[list[tuple[int, np.ndarray]]] = [[] for _ in texts]
    for k in range(0, len(jobs), BATCH):
        part = jobs[k : k + BATCH]
        codes = np.zeros((len(part), WINDOW), np.int64)
        for row, (i, at) in enumerate(part):
            c = coded(texts[i][at : at + WINDOW])
            codes[row, : len(c)] = c
        for (i, at), labels in zip(part, tagger.decode(codes)):
            out[i].append((at, labels))
    return out


DEPTH = np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1])


def reconciled(length: int, windows: list[tuple[int, np.ndarray]]) -> Iterator[Span]:
    """Labels of overlapping windows joined over each covered stretch, read as spans."""
    k = 0
    while k < len(windows):
        last = k
        while last + 1 < len(windows) and windows[last + 1][0] < windows[last][0] + WINDOW:
            last += 1
        start, end = windows[k][0], min(length, windows[last][0] + WINDOW)
        labels, depth = np.zeros(end - start, np.int8), np.full(end - start, -1)
        for at, w in windows[k : last + 1]:
            here = slice(at - start, min(at + WINDOW, end) - start)
            n = here.stop - here.start
            left = DEPTH[:n] if at > 0 else np.arange(WINDOW)[::-1][:n]
            better = left > depth[here]
            labels[here], depth[here] = np.where(better, w[:n], labels[here]), np.maximum(left, depth[here])
        on = np.flatnonzero(labels)
        for run in np.split(on, np.flatnonzero((np.diff(on) > 1) | (np.diff((labels[on] - 1) // 2) != 0) | (labels[on][1:] % 2 == 1)) + 1) if len(on) else ():
            yield int(labels[run[0]] - 1) // 2, start + int(run[0]), start + int(run[-1]) + 1
        k = last + 1


def valid(kind: int, value: str) -> bool:
    d = _digits(value)
    if kind == 0:
        return bool(re.fullmatch(r"(?i)[^\s@]*[^\s@.,;:!?](?:\s?[\[(]\s?at\s?[\])]\s?|\s?@\s?|\sat\s)[^\s@]+(?:(?:\.|\s?[\[(]\s?dot\s?[\])]\s?|\sdot\s)[a-z0-9.-]+)+", value))
    if kind == 1:
        parts = re.findall("[0-9]+", value)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts) and not re.search(r"[A-Za-z]", value)
    if kind == 2:
        return 16 <= len(d) <= 19 and luhn(d) and not re.search("[A-Za-z]", value)
    return 9 <= len(d) <= 15 and not re.search(r"[A-Za-z@\n]", value) and bool(re.search(r"[+(]|^00", value))


def all_spans(tagger: Tagger, texts: list[str]) -> Iterator[tuple[list[Span], list[Span]]]:
    """(base, added) of each text."""
    for text, windows in zip(texts, labels_of(tagger, texts)):
        base = base_spans(text)
        taken = [(a, b) for _, a, b in base]
        added = []
        for kind, a, b in reconciled(len(text), windows):
            value = text[a:b]
            a, b = a + len(value) - len(value.lstrip()), b - len(value) + len(value.rstrip(" \n\t.,;:"))
            # digits or letters of the value may not go on outside it
            cut = (a > 0 and text[a - 1].isalnum() and text[a : a + 1].isalnum()) or (b < len(text) and text[b].isalnum() and text[b - 1 : b].isalnum())
            if a < b and not cut and valid(kind, text[a:b]) and all(b <= x or y <= a for x, y in taken):
                taken.append((a, b))
                added.append((kind, a, b))
        yield base, sorted(added)


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def find(documents: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """(doc_id, text) to counts of base spans by kind, their digest, and all spans."""
    tagger = tagger or trained()
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(i, 256) for i in range(0, len(b), 256)):
                base, spans = [], []
                for x, added in all_spans(tagger, [t.as_py() or "" for t in part.column(1)]):
                    base.append(x)
                    spans.append(written(x + added))
                counts = [pa.array([sum(s[0] == k for s in x) for x in base], pa.int64()) for k in range(len(KINDS))]
                digest = pa.array([hashlib.sha256(written(x).encode()).hexdigest() for x in base], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), *counts, digest, pa.array(spans, pa.string())], names)

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(documents: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """``documents`` with every span in ``text`` replaced by its kind in brackets; null texts stay null."""
    tagger = tagger or trained()
    at = documents.columns.index("text")

    def cleaned(text: str, spans: list[Span]) -> str:
        out, end = [], 0
        for a, b, k in sorted((a, b, k) for k, a, b in spans):
            if b > end:  # base spans of two kinds may overlap: what is covered goes once
                out += [text[end : max(a, end)], f"[{KINDS[k].upper()}]"]
                end = b
        return "".join([*out, text[end:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(i, 256) for i in range(0, len(b), 256)):
                texts = part.column(at).to_pylist()
                found = all_spans(tagger, [t or "" for t in texts])
                made = [None if t is None else cleaned(t, x + y) for t, (x, y) in zip(texts, found)]
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.string()) if i == at else c for i, c in enumerate(part.columns)], part.schema.names)

    return documents.mapInArrow(run, documents.schema)
