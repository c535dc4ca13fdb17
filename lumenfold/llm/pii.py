r"""Personal data by rules and by a character-level bidirectional LSTM with CRF transitions, trained here in numpy.

The rules (`base_spans`) give the base. The model is learned from labelled spans: windows of the corpus with the spans
that the rules find there, the same windows with those spans rewritten into forms that the rules miss (`variant`), and
prose windows with made-up spans and look-alikes put in. The sample is bounded: of each sort of window (one for each kind,
windows with a mark and no span, prose) the SAMPLE distinct ones with the smallest hashes; each task keeps its own
smallest, and one task trains on at most 6 * SAMPLE windows of WINDOW characters. Everything else covers all rows and texts.

A text is read in windows of WINDOW characters, a new one every STRIDE. Each is decoded by Viterbi, its spans weigh
length times mean posterior probability. Spans cut by a window's edge are joined with what the next window sees of them;
then the set of non-overlapping spans with the largest total weight over the whole text is taken (`reconcile`). A span of
the model is kept if its mean probability is CONFIDENT or more, it overlaps no base span and it has its kind's form
(`holds`). A span without a mark (a digit, `@` or a bracketed "at") has no kind's form, so windows without one are not
decoded; that changes no result.

Null and empty texts have no spans. Very long texts are read whole, by a bounded number of windows at a time. Rows that
repeat a doc_id or a text give equal rows each. n_email to n_phone count base spans, n_added the model's. An empty table
gives no rows, and a corpus without any base span trains on made-up ones alone. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .text import column

KINDS = ("email", "ip", "card", "phone")
TAGS = ("O", *[f"{p}-{k}" for k in KINDS for p in "BI"])
WINDOW, STRIDE, SAMPLE, EXAMPLES, STEPS, CONFIDENT = 128, 64, 256, 3072, 360, 0.8
HIDDEN, WIDTH = 16, 12
#: Windows decoded at once.
BATCH = 1024
LETTERS, DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"
LOCAL = frozenset(LETTERS + LETTERS.upper() + DIGITS + "._%+-")
HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
GROUPED = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
MARK = re.compile(r"[0-9@]|[\[({] ?[aA][tT] ?[\])}]")
SIGN = re.compile(r" ?[\[({] ?(at|dot) ?[\])}] ?", re.I)


# ---- rules


def digits(s: str) -> list[int]:
    return [ord(c) - 48 for c in s if "0" <= c <= "9"]


def luhn(d: list[int]) -> bool:
    return (sum(d[-1::-2]) + sum(2 * x - 9 * (x > 4) for x in d[-2::-2])) % 10 == 0


def is_card(s: str) -> bool:
    d = digits(s)
    return 13 <= len(d) <= 19 and luhn(d)


def is_byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") < 256


def emails(text: str) -> Iterator[tuple[int, int]]:
    """By the `@`s, so that long words are read once."""
    end, at = 0, text.find("@")
    while at >= 0:
        m = HOST.match(text, at + 1)
        if m:
            lo = at
            while lo > end and text[lo - 1] in LOCAL:
                lo -= 1
            if lo < at:
                end = m.end()
                yield lo, end
        at = text.find("@", at + 1)


def addresses(text: str) -> Iterator[tuple[int, int]]:
    for m in DOTTED.finditer(text):
        parts = m[0].split(".") if m[0].count(".") > 2 else []
        at = m.start()
        for k in range(0, len(parts) - 3, 4):  # the next match starts behind the one before, also behind one that fails
            size = sum(map(len, parts[k : k + 4])) + 3
            if all(map(is_byte, parts[k : k + 4])):
                yield at, at + size
            at += size + 1


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost matches of each kind's pattern that pass its check, by kind and start."""
    if not re.search("[0-9@]", text):
        return []
    out = [("email", a, b) for a, b in emails(text)] + [("ip", a, b) for a, b in addresses(text)]
    out += [("card", *m.span()) for m in GROUPED.finditer(text) if is_card(m[0])]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]


def holds(kind: str, s: str) -> bool:
    """Whether a span of the model has its kind's form."""
    if kind == "email":
        plain = SIGN.sub(lambda m: "@" if m[1].lower() == "at" else ".", s)
        return bool(EMAIL.fullmatch(re.sub(r" ?@ ?", "@", re.sub(r" dot ", ".", plain))))
    groups = re.findall("[0-9]+", s)
    if kind == "ip":
        return len(groups) == 4 and all(map(is_byte, groups))
    if kind == "card":
        return is_card(s)
    return 9 <= sum(map(len, groups)) <= 15 and len(groups) > 1


# ---- labelled windows


def classes(text: str) -> np.ndarray:
    return TABLE[np.minimum(np.frombuffer(text.encode("utf-32-le", "replace"), "<u4"), 128)]


def _table() -> np.ndarray:
    """Class of each ASCII character and one for all beyond: 0 is the end of a text, then letters, one class for capitals, one for digits, marks of their own, others."""
    own = {c: k + 1 for k, c in enumerate(LETTERS)} | dict.fromkeys(LETTERS.upper(), 27) | dict.fromkeys(DIGITS, 28)
    own |= {c: 29 + k for k, c in enumerate(" .@-+()[]{}_%/:,;#=\"'|*\n")}
    return np.array([own.get(chr(k), 60) for k in range(128)] + [61], np.int64)


TABLE = _table()
N_CLASSES = int(TABLE.max()) + 1


def made_up(kind: str, rng: np.random.Generator) -> str:
    number = lambda n: "".join(str(x) for x in rng.integers(0, 10, n))
    word = lambda a, b: "".join(rng.choice(list(LETTERS), rng.integers(a, b)))
    if kind == "email":
        return word(2, 9) + rng.choice(["", ".", "_", "-"]) + (word(1, 8) if rng.random() < 0.5 else number(2)) + "@" + word(2, 9) + rng.choice(["", number(1)]) + rng.choice([".com", ".org", ".example.com", ".net", ".de", ".co.uk"])
    if kind == "ip":
        return ".".join(str(x) for x in rng.integers(0, 256, 4))
    if kind == "card":
        d = number(rng.choice([13, 15, 16, 16, 16, 19]) - 1)
        d += next(str(x) for x in range(10) if luhn(digits(d + str(x))))
        gap = rng.choice(["", "", " ", "-"])
        return gap.join(d[k : k + 4] for k in range(0, len(d), 4))
    a, b, c = number(3), number(3), number(4)
    return f"+{rng.integers(1, 99)}" + rng.choice([f" ({a}) {b}-{c}", f" {a} {b} {c}", f"-{a}-{b}-{c}", f"{a}{b}{c}", f" {a}.{b}.{c}"])


def variant(kind: str, s: str, rng: np.random.Generator) -> str:
    """The same data in a form that the rules miss."""
    if kind == "email":
        user, _, host = s.partition("@")
        if rng.random() < 0.4:
            host = host.replace(".", str(rng.choice([" dot ", "[dot]", " [dot] ", "(dot)", " (dot) "])))
        return user + str(rng.choice([" @ ", " [at] ", "[at]", "(at)", " (at) ", " {at} "])) + host
    if kind == "ip":
        return s.replace(".", str(rng.choice(["[.]", " . ", "(.)", "-"])))
    d = "".join(str(x) for x in digits(s))
    if kind == "card":
        return str(rng.choice([".", "/", "  ", "_", " - "])).join(d[k : k + 4] for k in range(0, len(d), 4))
    a, b, c = d[-10:-7] or "030", d[-7:-4], d[-4:]
    return str(rng.choice([f"({a}) {b}-{c}", f"00{d[:-10]} {a} {b} {c}", f"+{d[:-10]}/{a}/{b}{c}", f"{d[:-10]}-{a}-{b}-{c}", f"{a}.{b}.{c}", f"+ {d[:-10]} ({a}) {b}-{c}", f"{a}-{b}-{c}"]))


def look_alike(rng: np.random.Generator) -> str:
    number = lambda n: "".join(str(x) for x in rng.integers(0, 10, n))
    k = int(rng.integers(0, 12))
    return [
        number(int(rng.integers(1, 9))), f"20{number(2)}-{number(2)}-{number(2)}", f"{number(2)}:{number(2)}:{number(2)}", f"{number(1)}.{number(1)}.{number(2)}", f"{number(1)}.{number(1)}",
        f"{number(2)},{number(3)}.{number(2)}", "".join(rng.choice(list("0123456789abcdef"), 40)), "@" + "".join(rng.choice(list(LETTERS), 7)), number(int(rng.integers(20, 40))),
        f"{number(3)}-{number(3)}", f"{number(2)} {number(2)} {number(1)}", f"[{number(2)}]",
    ][k]


def windows_of(text: str) -> Iterator[tuple[str, str, list[tuple[str, int, int]]]]:
    """Sort, window and spans of the labelled windows that a text offers: around each base span, around a mark far from any, and somewhere in the text."""
    spans = sorted(base_spans(text), key=lambda s: s[1])
    for kind, a, b in spans:
        lo = max(0, min(a - int(hashlib.md5(text[a:b].encode()).hexdigest(), 16) % 64, len(text) - WINDOW))
        near = [s for s in spans if s[1] < lo + WINDOW and s[2] > lo]
        if b <= lo + WINDOW and all(s[1] >= lo and s[2] <= lo + WINDOW for s in near):
            yield kind, text[lo : lo + WINDOW], [(k, x - lo, y - lo) for k, x, y in near]
    for m in MARK.finditer(text):
        lo = max(0, m.start() - WINDOW // 2)
        part = text[lo : lo + WINDOW]
        # long numbers that fail the check look like cards that pass it: they teach nothing
        if not any(s[1] < lo + WINDOW and s[2] > lo for s in spans) and not re.search(r"[0-9]([ -]?[0-9]){12}", part):
            yield "none", part, []
            break
    lo = int(hashlib.md5(text[:99].encode()).hexdigest(), 16) % max(1, len(text) - WINDOW + 1)
    if not MARK.search(text, lo, lo + WINDOW):
        yield "prose", text[lo : lo + WINDOW], []


SORTS = (*KINDS, "none", "prose")


def labelled(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """sort, key, window, spans: of each sort of window the `sample` distinct ones with the smallest hashes, whatever the partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[str, dict] = {k: {} for k in SORTS}
        for batch in batches:
            for text in column(batch, "text").to_pylist():
                for sort, window, spans in windows_of(text) if text else ():
                    held = best[sort]
                    held[hashlib.md5(window.encode()).hexdigest(), window] = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
                    if len(held) > 4 * sample:
                        best[sort] = dict(sorted(held.items())[:sample])
        rows = [(sort, key, window, spans) for sort, held in best.items() for (key, window), spans in sorted(held.items())[:sample]]
        yield pa.record_batch([pa.array([r[k] for r in rows], pa.string()) for k in range(4)], ["sort", "key", "window", "spans"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "sort string, key string, window string, spans string").distinct()
    rank = F.row_number().over(Window.partitionBy("sort").orderBy("key", "window"))
    return rows.withColumn("k", rank).where(F.col("k") <= sample).drop("k")


def parse(spans: str) -> list[tuple[str, int, int]]:
    return [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in spans.split(",") if s)]


def examples(found: list[tuple[str, str, list]], n: int = EXAMPLES, seed: int = 7) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """n windows with their spans: as found, with spans rewritten, and prose with spans and look-alikes put in."""
    rng = np.random.default_rng(seed)
    real = [(w, s) for sort, w, s in found if sort != "prose"]
    prose = [w for sort, w, _ in found if sort == "prose"] or ["and then of the same for each one " * 4]
    surfaces = {k: [w[a:b] for w, s in real for kind, a, b in s if kind == k] for k in KINDS}
    out = []
    for k in range(n):
        if real and k % 3 == 0:
            window, spans = real[int(rng.integers(len(real)))]
            if k % 2 and spans:  # rewrite some
                text, at, new = "", 0, []
                for kind, a, b in spans:
                    s = variant(kind, window[a:b], rng) if rng.random() < 0.7 else window[a:b]
                    text += window[at:a]
                    new.append((kind, len(text), len(text) + len(s)))
                    text, at = text + s, b
                window, spans = text + window[at:], new
        else:
            base = prose[int(rng.integers(len(prose)))]
            text, spans, at = "", [], 0
            for _ in range(int(rng.integers(1, 4))):
                to = at + int(rng.integers(0, 50))
                text, at = text + base[at:to], to
                text += "" if not text or rng.random() < 0.1 else str(rng.choice([" ", " ", " ", "\n", "(", ": ", ", ", " | "]))
                if rng.random() < 0.35:
                    text += look_alike(rng)
                else:
                    kind = KINDS[int(rng.integers(4))]
                    s = str(rng.choice(surfaces[kind])) if surfaces[kind] and rng.random() < 0.3 else made_up(kind, rng)
                    s = variant(kind, s, rng) if rng.random() < 0.6 else s
                    if kind in ("email", "phone") and text and text[-1] not in " \n(|":
                        text += " "
                    spans.append((kind, len(text), len(text) + len(s)))
                    text += s
                text += str(rng.choice([" ", " ", ".", ", ", "\n", ")"]))
            window = text + base[at:]
        cut = int(rng.integers(0, 30)) if rng.random() < 0.2 else 0  # spans cut by the edge are learned too
        window = window[cut : cut + WINDOW]
        out.append((window, [(kind, max(0, a - cut), min(b - cut, len(window))) for kind, a, b in spans if b > cut and a - cut < len(window)]))
    return out


# ---- the model


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


#: Transitions that spans allow; a window may begin inside a span.
ALLOWED = np.array([[not b.startswith("I") or a[1:] == b[1:] for b in TAGS] for a in TAGS])


class Tagger:
    """Parameters by name, all float32."""

    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        k, h, e = len(TAGS), HIDDEN, WIDTH
        near = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
        self.p = {"embed": near(N_CLASSES, e) * 4, "out": near(2 * h, k), "out_b": np.zeros(k, np.float32), "first": np.zeros(k, np.float32), "next": np.zeros((k, k), np.float32)}
        for d in "fb":
            self.p |= {f"x{d}": near(e, 4 * h), f"h{d}": near(h, 4 * h), f"c{d}": np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)]).astype(np.float32)}

    def lstm(self, x: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """x: length, windows, width, already in the direction's order. Gives the hidden states; keep gets what the way back needs."""
        h, n = HIDDEN, x.shape[1]
        xs = (x.reshape(-1, x.shape[2]) @ self.p[f"x{d}"] + self.p[f"c{d}"]).reshape(len(x), n, 4 * h)
        hid, cell, out = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32), np.empty((len(x), n, h), np.float32)
        for t in range(len(x)):
            z = xs[t] + hid @ self.p[f"h{d}"]
            gates = sigmoid(z[:, : 3 * h])
            i, f, o, g = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :], np.tanh(z[:, 3 * h :])
            before, cell = cell, f * cell + i * g
            th = np.tanh(cell)
            if keep is not None:
                keep.append((hid, before, i, f, o, g, th))
            hid = out[t] = o * th
        return out

    def back(self, x: np.ndarray, d: str, keep: list, dout: np.ndarray, grads: dict) -> np.ndarray:
        h, n = HIDDEN, x.shape[1]
        dh, dc = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        dz = np.empty((len(x), n, 4 * h), np.float32)
        for t in range(len(x) - 1, -1, -1):
            hid, before, i, f, o, g, th = keep[t]
            dh = dh + dout[t]
            dc = dc + dh * o * (1 - th * th)
            dz[t] = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * th * o * (1 - o), dc * i * (1 - g * g)], axis=1)
            dh, dc = dz[t] @ self.p[f"h{d}"].T, dc * f
        flat = dz.reshape(-1, 4 * h)
        grads[f"h{d}"] = np.concatenate([k[0] for k in keep]).T @ flat
        grads[f"x{d}"], grads[f"c{d}"] = x.reshape(-1, x.shape[2]).T @ flat, flat.sum(axis=0)
        return (flat @ self.p[f"x{d}"].T).reshape(x.shape)

    def emissions(self, c: np.ndarray, keep: list | None = None) -> np.ndarray:
        """c: windows, length. Gives length, windows, tags; behind the end of a text only O."""
        x = self.p["embed"][c.T]
        kf, kb = ([], []) if keep is not None else (None, None)
        hid = np.concatenate([self.lstm(x, "f", kf), self.lstm(x[::-1], "b", kb)[::-1]], axis=2)
        e = hid @ self.p["out"] + self.p["out_b"]
        e[:, :, 1:][c.T == 0] = -30
        if keep is not None:
            keep += [x, hid, kf, kb]
        return e

    def posterior(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities of tags, and what pairs of them need: forward and backward sums scaled to 1 at each place."""
        step = np.exp(self.p["next"]) * ALLOWED
        b = np.exp(e - e.max(axis=2, keepdims=True))
        fwd, bwd, c = np.empty_like(b), np.empty_like(b), np.empty(b.shape[:2], np.float32)
        a = b[0] * np.exp(self.p["first"])
        for t in range(len(b)):
            if t:
                a = (fwd[t - 1] @ step) * b[t]
            c[t] = np.maximum(a.sum(axis=1), 1e-30)
            fwd[t] = a / c[t][:, None]
        bwd[-1] = 1
        for t in range(len(b) - 2, -1, -1):
            bwd[t] = ((b[t + 1] * bwd[t + 1]) @ step.T) / c[t + 1][:, None]
        return fwd * bwd, fwd, b * bwd / c[:, :, None], step, c

    def gradients(self, c: np.ndarray, tags: np.ndarray) -> dict:
        """Of the mean negative log-likelihood of the tags (windows, length)."""
        keep, grads, n = [], {}, len(c)
        e = self.emissions(c, keep)
        x, hid, kf, kb = keep
        post, fwd, right, step, _ = self.posterior(e)
        gold = np.eye(len(TAGS), dtype=np.float32)[tags.T]
        de = (post - gold) / n
        pairs = np.einsum("tni,tnj->ij", fwd[:-1], right[1:]) * step - np.einsum("tni,tnj->ij", gold[:-1], gold[1:])
        grads["next"], grads["first"] = (pairs / n * ALLOWED).astype(np.float32), de[0].sum(axis=0)
        de[:, :, :] *= (c.T != 0)[:, :, None]
        flat = de.reshape(-1, len(TAGS))
        grads["out"], grads["out_b"] = hid.reshape(len(flat), -1).T @ flat, flat.sum(axis=0)
        dh = de @ self.p["out"].T
        dx = self.back(x, "f", kf, dh[:, :, :HIDDEN], grads) + self.back(x[::-1], "b", kb, dh[::-1, :, HIDDEN:], grads)[::-1]
        grads["embed"] = np.zeros_like(self.p["embed"])
        np.add.at(grads["embed"], c.T.ravel(), dx.reshape(-1, WIDTH))
        return grads

    def decode(self, c: np.ndarray) -> list[list[tuple[str, int, int, float]]]:
        """Spans of each window: kind, start, end, mean probability of its tags."""
        e = self.emissions(c)
        post = self.posterior(e)[0]
        move = np.where(ALLOWED, self.p["next"], -1e9).astype(np.float32)
        score, back = e[0] + self.p["first"], np.zeros(e.shape, np.int8)
        for t in range(1, len(e)):
            all_ = score[:, :, None] + move
            back[t] = all_.argmax(axis=1)
            score = all_.max(axis=1) + e[t]
        tag = np.empty(e.shape[:2], np.int64)
        tag[-1] = score.argmax(axis=1)
        rows = np.arange(e.shape[1])
        for t in range(len(e) - 1, 0, -1):
            tag[t - 1] = back[t, rows, tag[t]]
        sure = np.take_along_axis(post, tag[:, :, None], axis=2)[:, :, 0]
        out: list[list] = [[] for _ in rows]
        for n in np.flatnonzero((tag > 0).any(axis=0)):
            t, size = 0, len(e)
            while t < size:
                if tag[t, n] == 0:
                    t += 1
                    continue
                kind, lo = (tag[t, n] - 1) // 2, t
                t += 1
                while t < size and tag[t, n] == 2 * kind + 2:
                    t += 1
                out[n].append((KINDS[kind], lo, t, float(sure[lo:t, n].mean())))
        return out


def encoded(rows: list[tuple[str, list]]) -> tuple[np.ndarray, np.ndarray]:
    c, tags = np.zeros((len(rows), WINDOW), np.int64), np.zeros((len(rows), WINDOW), np.int64)
    for k, (window, spans) in enumerate(rows):
        c[k, : len(window)] = classes(window)
        for kind, a, b in spans:
            tags[k, a:b] = 2 * KINDS.index(kind) + 2
            tags[k, a] -= 1
    return c, tags


def train(rows: list[tuple[str, list]], steps: int = STEPS, batch: int = 96, seed: int = 1) -> Tagger:
    """Adam over batches drawn in a fixed order."""
    model, rng = Tagger(seed), np.random.default_rng(seed)
    c, tags = encoded(rows)
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    v = {k: np.zeros_like(x) for k, x in model.p.items()}
    for t in range(1, steps + 1):
        at = rng.integers(0, len(c), batch)
        grads = model.gradients(c[at], tags[at])
        size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        for k, g in grads.items():
            g = g * min(1, 5 / max(size, 1e-9))
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g * g
            model.p[k] -= (0.02 * (1 - t / (steps + 1)) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
    return model


# ---- whole texts


def marked_windows(text: str) -> list[int]:
    """Starts of the windows that hold a mark."""
    out: dict[int, None] = {}
    for m in MARK.finditer(text):
        k = m.start() // STRIDE
        for j in range(max(0, k - WINDOW // STRIDE + 1), k + 1):
            out[j * STRIDE] = None
    return list(out)


def join_cut(found: list[tuple[int, int, str, float, bool, bool]]) -> list[tuple[int, int, str, float]]:
    """Joins spans of one kind that meet where at least one of them was cut by its window's edge."""
    out: list[tuple[int, int, str, float, bool, bool]] = []
    for s in sorted(found):
        k = next((k for k in range(len(out) - 1, max(-1, len(out) - 9), -1) if out[k][2] == s[2] and s[0] <= out[k][1] and (out[k][5] or s[4])), None)
        if k is None:
            out.append(s)
        else:
            o = out[k]
            out[k] = (o[0], max(o[1], s[1]), o[2], max(o[3], s[3]), o[4], s[5] if s[1] >= o[1] else o[5])
    return [s[:4] for s in out]


def reconcile(found: list[tuple[int, int, str, float]]) -> list[tuple[int, int, str, float]]:
    """The non-overlapping spans of largest total weight (length times probability)."""
    from bisect import bisect_right

    rows = sorted(set(found), key=lambda s: (s[1], s[0], s[2]))
    ends, best, take = [s[1] for s in rows], [0.0], []
    for k, (a, b, _, sure) in enumerate(rows):
        before = bisect_right(ends, a, 0, k)
        weight = best[before] + (b - a) * sure
        take.append((weight > best[-1] + 1e-12, before))
        best.append(max(best[-1], weight))
    out, k = [], len(rows)
    while k:
        yes, before = take[k - 1]
        if yes:
            out.append(rows[k - 1])
        k = before if yes else k - 1
    return out[::-1]


class Finder:
    """The model's spans of a text that the base lacks."""

    def __init__(self, model: Tagger):
        self.model = model

    def added(self, texts: list[str], base: list[list[tuple[str, int, int]]]) -> list[list[tuple[str, int, int]]]:
        found: list[list] = [[] for _ in texts]
        todo: list[tuple[int, int]] = []

        def decode() -> None:
            c = np.zeros((len(todo), WINDOW), np.int64)
            for k, (i, lo) in enumerate(todo):
                part = classes(texts[i][lo : lo + WINDOW])
                c[k, : len(part)] = part
            for (i, lo), spans in zip(todo, self.model.decode(c), strict=True):
                size = len(texts[i])
                found[i] += [(lo + a, min(lo + b, size), kind, sure, a == 0 and lo > 0, b == WINDOW and lo + b < size) for kind, a, b, sure in spans]
            todo.clear()

        for i, text in enumerate(texts):
            for lo in marked_windows(text):
                todo.append((i, lo))
                if len(todo) == BATCH:
                    decode()
        if todo:
            decode()
        return [self.settle(t, f, b) if f else [] for t, f, b in zip(texts, found, base, strict=True)]

    def settle(self, text: str, found: list, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        trimmed = []
        for a, b, kind, sure in join_cut(found):
            while a < b and text[a] in " \n\t.,;:|":
                a += 1
            while a < b and text[b - 1] in " \n\t.,;:|":
                b -= 1
            if a < b and sure >= CONFIDENT:
                trimmed.append((a, b, kind, sure))
        taken, free, k = sorted((x, y) for _, x, y in base), [], 0
        for a, b, kind, sure in sorted(trimmed):
            while k < len(taken) and taken[k][1] <= a:
                k += 1
            if not any(x < b and y > a for x, y in taken[k : k + 8]) and holds(kind, text[a:b]):
                free.append((a, b, kind, sure))
        return [(kind, a, b) for a, b, kind, _ in reconcile(free)]


def fit(docs: DataFrame, sample: int = SAMPLE, n: int = EXAMPLES, steps: int = STEPS) -> Tagger:
    """Trains in one task, on the bounded sample alone; the parameters come back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r["sort"], r["key"], r["window"], r["spans"]) for b in batches for r in b.to_pylist())
        held = io.BytesIO()
        np.savez(held, **train(examples([(r[0], r[2], parse(r[3])) for r in rows], n), steps).p)
        yield pa.record_batch([pa.array([held.getvalue()], pa.binary())], ["model"])

    # at most 6 * sample windows
    (row,) = labelled(docs, sample).coalesce(1).mapInArrow(run, "model binary").collect() or [None]
    model = Tagger()
    with np.load(io.BytesIO(row.model), allow_pickle=False) as held:
        model.p = {k: held[k] for k in model.p}
    return model


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1])))


def personal_data(docs: DataFrame, model: Tagger | None = None) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added."""
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(shared.value)
        for batch in batches:
            texts = [t or "" for t in column(batch, "text").to_pylist()]
            base = [base_spans(t) for t in texts]
            added = finder.added(texts, base)
            counts = [pa.array([sum(s[0] == k for s in b) for b in base], pa.int64()) for k in KINDS]
            yield pa.record_batch(
                [column(batch, "doc_id"), *counts, pa.array([hashlib.sha256(written(b).encode()).hexdigest() for b in base]), pa.array([written(b + a) for b, a in zip(base, added, strict=True)], pa.string()), pa.array([len(a) for a in added], pa.int64())],
                ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"],
            )

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
