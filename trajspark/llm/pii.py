"""Personal data: fixed patterns, and a character-level BiLSTM-CRF that adds what they miss.

Patterns give the base spans of four kinds. A bidirectional LSTM over characters with CRF transitions between labels (outside; begin
and inside of each kind) is trained in numpy from spans of the corpus itself: windows around base spans and windows with
none, at most ``SAMPLE`` of each class chosen by hash (none where a match failed its check), and variants made of these spans (two side by side, regrouped
digits, other separators), which the patterns cannot read. Overlapping windows of ``WINDOW`` characters are decoded
by Viterbi; spans cut by a window's edge are joined with what the next window saw, and of all spans of a text the
set of most weight without overlap is kept (over the whole text, not window by window). An added span must pass the check of its kind
(Luhn digits, four numbers up to 255, 9 to 15 digits, each without letters; an @ between two parts) and may not overlap a base span of its kind.

A span of any kind holds a digit or an @, so windows without either cannot change the result and aren't decoded. Whole texts are
read once; what is stored of them is the base spans and those windows, and the model works on these.

Defined results: a null text is empty; offsets are code points, ends exclusive; repeated rows each have their row; an empty
table gives an empty result; without any base span in the corpus nothing can be learnt, and only base spans (none) are
returned; other columns are never looked at.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajspark.session import materialize

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE = 96, 48
SAMPLE = 240            # training windows of each class, at most
HIDDEN = 16
EPOCHS = 8
BATCH = 48
RATE = 0.02
SEED = 42
DECODED = 2048          # windows decoded at a time
PIECE = 1 << 20         # characters of a text searched for digits at a time

# The base patterns, in forms that read any text in linear time.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

Span = tuple[int, int, int]  # number of the kind, start, end


def _digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        value = int(c) * (1 + i % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def _is_byte(number: str) -> bool:
    number = number.lstrip("0")
    return len(number) < 4 and int(number or "0") <= 255


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
        done = found.end() if found else at + 1
        at = text.find("@", done)


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for run in _NUMBERS.finditer(text):
        parts, at = run.group().split("."), run.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(map(_is_byte, four)):
                yield at, end
            at = end + 1


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind that pass its check, by kind and start."""
    found = [(0, a, b) for a, b in _emails(text)]
    found += [(1, a, b) for a, b in _ips(text)]
    for m in _CARD.finditer(text):
        digits = _digits(m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append((2, *m.span()))
    found += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return found


def doubtful(text: str) -> list[tuple[int, int]]:
    """Matches that fail their check though they have digits enough: they may hold a span, so no label is sure there."""
    found = [m.span() for m in _PHONE.finditer(text) if not 9 <= len(_digits(m.group())) <= 15]
    for m in _CARD.finditer(text):
        digits = _digits(m.group())
        if len(digits) > 19 or (len(digits) >= 13 and not luhn(digits)):
            found.append(m.span())
    return found + [m.span() for m in _NUMBERS.finditer(text) if m.group().count(".") >= 3 and not list(_ips(m.group()))]


def passes(kind: int, found: str) -> bool:
    """The check of an added span."""
    digits = _digits(found)
    if kind == 0:
        name, _, host = found.partition("@")
        return bool(name and host and re.search(r"\w\W+\w", host)) and not re.search(r"\s", name + host[-1:])
    if any(c.isalpha() for c in found):
        return False
    if kind == 1:
        numbers = re.findall("[0-9]+", found)
        return len(numbers) == 4 and all(map(_is_byte, numbers))
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15


def windows(text: str) -> list[int]:
    """Starts of the windows with a digit or an @: every character lies in two windows, but for the first and last ones."""
    cells: set[int] = set()
    for at in range(0, len(text), PIECE):
        code = np.frombuffer(text[at : at + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)
        hit = np.flatnonzero(((code >= 48) & (code <= 57)) | (code == 64))
        cells.update(np.unique((hit + at) // STRIDE).tolist())
    return sorted({max(0, c - k) * STRIDE for c in cells for k in range(WINDOW // STRIDE)})


def symbols(text: str, width: int) -> np.ndarray:
    """Numbers of the characters, 0 beyond the end: ASCII has its own ones, other letters share one, and all else another."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    other = np.fromiter((128 + (not c.isalpha()) for c in text), np.int64, len(text)) if (code > 127).any() else 0
    out = np.zeros(width, np.int64)
    out[: len(code)] = np.where(code > 127, other, code) + 1
    return out


SYMBOLS = 131
LABELS = 1 + 2 * len(KINDS)     # 0 is outside; kind k begins with 1 + 2k and goes on with 2 + 2k
_NEVER = -1e4
_ALLOWED = np.array([[j == 0 or j % 2 == 1 or i in (j - 1, j) for j in range(LABELS)] for i in range(LABELS)])


def labelled(spans: Iterable[Span], width: int) -> np.ndarray:
    out = np.zeros(width, np.int64)
    for kind, start, end in spans:
        out[start:end] = 2 + 2 * kind
        out[start] = 1 + 2 * kind
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Tagger:
    """Two LSTMs, one for each direction, a linear layer, and a CRF over the labels."""

    def __init__(self, weights: dict[str, np.ndarray]) -> None:
        self.w = weights

    @classmethod
    def fresh(cls, seed: int = SEED, hidden: int = HIDDEN) -> Tagger:
        rng = np.random.default_rng(seed)
        w = {}
        for way in ("f", "b"):
            w[f"{way}x"] = rng.normal(0, 0.3, (SYMBOLS, 4 * hidden))
            w[f"{way}h"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden))
            w[f"{way}0"] = np.repeat([0.0, 1.0, 0.0, 0.0], hidden)
        w["out"] = rng.normal(0, 0.3, (2 * hidden, LABELS))
        w["bias"] = np.zeros(LABELS)
        w["step"] = np.zeros((LABELS, LABELS))
        w["first"] = np.zeros(LABELS)
        return cls({k: v.astype(np.float32) for k, v in w.items()})

    def _run(self, way: str, x: np.ndarray, keep: list | None) -> np.ndarray:
        """Hidden states (time, window, unit); states are 0 beyond the end of a text."""
        width, n = x.shape
        hidden = len(self.w[f"{way}h"])
        out = np.zeros((width, n, hidden), np.float32)
        h = c = np.zeros((n, hidden), np.float32)
        for t in range(width) if way == "f" else range(width - 1, -1, -1):
            gates = self.w[f"{way}x"][x[t]] + h @ self.w[f"{way}h"] + self.w[f"{way}0"]
            open_ = _sigmoid(gates[:, : 2 * hidden])
            i, f = open_[:, :hidden], open_[:, hidden:]
            g, o = np.tanh(gates[:, 2 * hidden : 3 * hidden]), _sigmoid(gates[:, 3 * hidden :])
            there = (x[t] > 0)[:, None].astype(np.float32)
            before, c = (h, c), (f * c + i * g) * there
            squashed = np.tanh(c)
            h = o * squashed * there
            out[t] = h
            if keep is not None:
                keep.append((t, before, i, f, g, o, squashed, there))
        return out

    def emissions(self, x: np.ndarray, keep: tuple[list, list] | None = None) -> tuple[np.ndarray, np.ndarray]:
        states = np.concatenate([self._run(way, x, keep and keep[k]) for k, way in enumerate("fb")], axis=2)
        return states @ self.w["out"] + self.w["bias"], states

    def transitions(self) -> tuple[np.ndarray, np.ndarray]:
        first = np.where(_ALLOWED[0], self.w["first"], _NEVER)
        return np.where(_ALLOWED, self.w["step"], _NEVER), first

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Negative log likelihood (mean over windows) of labels ``y`` (time, window), and its gradient."""
        keep: tuple[list, list] = ([], [])
        scores, states = self.emissions(x, keep)
        step, first = self.transitions()
        width, n = x.shape
        there = x > 0
        rows = np.arange(n)

        def total(a: np.ndarray, axis: int) -> np.ndarray:
            top = a.max(axis=axis, keepdims=True)
            return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)

        alpha, beta = np.zeros_like(scores), np.zeros_like(scores)
        alpha[0] = first + scores[0]
        for t in range(1, width):
            alpha[t] = np.where(there[t][:, None], total(alpha[t - 1][:, :, None] + step, 1) + scores[t], alpha[t - 1])
        for t in range(width - 2, -1, -1):
            on = total(step + (scores[t + 1] + beta[t + 1])[:, None, :], 2)
            beta[t] = np.where(there[t + 1][:, None], on, 0)
        whole = total(alpha[-1], 1)
        share = np.exp(alpha + beta - whole[:, None]) * there[:, :, None]
        gold = np.zeros_like(share)
        gold[np.arange(width)[:, None], rows, y] = there
        loss = whole - (first[y[0]] + (scores * gold).sum(axis=(0, 2)))
        both = np.zeros((LABELS, LABELS))
        for t in range(1, width):
            on = there[t]
            loss -= np.where(on, step[y[t - 1], y[t]], 0)
            pair = np.exp(alpha[t - 1][:, :, None] + step + (scores[t] + beta[t] - whole[:, None])[:, None, :])
            both += pair[on].sum(axis=0)
            np.subtract.at(both, (y[t - 1][on], y[t][on]), 1)
        delta = (share - gold) / n
        grad = {
            "step": np.where(_ALLOWED, both / n, 0), "first": np.where(_ALLOWED[0], delta[0].sum(axis=0), 0),
            "bias": delta.sum(axis=(0, 1)), "out": np.tensordot(states, delta, ([0, 1], [0, 1])),
        }
        back = delta @ self.w["out"].T
        hidden = len(self.w["fh"])
        for k, way in enumerate("fb"):
            grad |= self._back(way, x, keep[k], back[:, :, k * hidden : (k + 1) * hidden])
        return float(loss.mean()), grad

    def _back(self, way: str, x: np.ndarray, keep: list, above: np.ndarray) -> dict[str, np.ndarray]:
        inputs, inner, bias = (np.zeros_like(self.w[way + c]) for c in "xh0")
        dh = dc = np.zeros(above.shape[1:], np.float32)
        for t, (h, c), i, f, g, o, squashed, there in reversed(keep):
            dh = (dh + above[t]) * there
            dc = (dc + dh * o * (1 - squashed**2)) * there
            gates = np.concatenate(
                (dc * g * i * (1 - i), dc * c * f * (1 - f), dc * i * (1 - g**2), dh * squashed * o * (1 - o)), axis=1
            )
            np.add.at(inputs, x[t], gates)
            inner += h.T @ gates
            bias += gates.sum(axis=0)
            dh, dc = gates @ self.w[f"{way}h"].T, dc * f
        return {f"{way}x": inputs, f"{way}h": inner, f"{way}0": bias}

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS) -> Tagger:
        """Adam over shuffled batches; ``x`` and ``y`` are (window, time)."""
        rng = np.random.default_rng(SEED)
        first = {k: np.zeros_like(v) for k, v in self.w.items()}
        second = {k: np.zeros_like(v) for k, v in self.w.items()}
        done, steps = 0, epochs * -(-len(x) // BATCH)
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), BATCH):
                part = order[at : at + BATCH]
                _, grad = self.gradient(x[part].T, y[part].T)
                norm = np.sqrt(sum(float((g**2).sum()) for g in grad.values()))
                rate = RATE * (1 - done / steps)
                done += 1
                for k, g in grad.items():
                    g = g * min(1, 5 / (norm + 1e-9))
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g**2
                    move = first[k] / (1 - 0.9**done) / (np.sqrt(second[k] / (1 - 0.99**done)) + 1e-8)
                    self.w[k] = (self.w[k] - rate * move).astype(np.float32)
        return self

    def decode(self, texts: list[str]) -> list[list[tuple[float, int, int, int]]]:
        """Spans (weight, kind, start, end) of each text of at most ``WINDOW`` characters, along the best path."""
        x = np.stack([symbols(t, WINDOW) for t in texts], axis=1)
        scores, _ = self.emissions(x)
        step, first = self.transitions()
        best, come = first + scores[0], np.zeros((WINDOW, len(texts), LABELS), np.int8)
        for t in range(1, WINDOW):
            reach = best[:, :, None] + step
            come[t] = reach.argmax(axis=1)
            there = (x[t] > 0)[:, None]
            come[t] = np.where(there, come[t], np.arange(LABELS))
            best = np.where(there, reach.max(axis=1) + scores[t], best)
        path = np.zeros((WINDOW, len(texts)), np.int64)
        path[-1] = best.argmax(axis=1)
        rows = np.arange(len(texts))
        for t in range(WINDOW - 1, 0, -1):
            path[t - 1] = come[t][rows, path[t]]
        path[x == 0] = 0
        gain = np.take_along_axis(scores, path[:, :, None], axis=2)[:, :, 0] - scores[:, :, 0]
        found: list[list[tuple[float, int, int, int]]] = [[] for _ in texts]
        for row, start in zip(*np.nonzero((path % 2 == 1).T)):
            kind, end = int(path[start, row]) // 2, int(start) + 1
            while end < WINDOW and path[end, row] == 2 + 2 * kind:
                end += 1
            found[row].append((float(gain[start:end, row].sum()), kind, int(start), end))
        return found


def reconcile(found: list[tuple[float, int, int, int, bool]], text_of) -> list[Span]:
    """The spans of most weight without overlap, of (weight, kind, start, end, cut at an edge) from all windows of a text."""
    joined: list[list] = []
    for weight, kind, start, end, cut in sorted(found, key=lambda s: (s[1], s[2], s[3])):
        last = joined[-1] if joined else None
        if last and last[1] == kind and start < last[3] and (cut or last[4] or (start, end) == (last[2], last[3])):
            last[0], last[3], last[4] = max(last[0], weight), max(last[3], end), last[4] or cut
        else:
            joined.append([weight, kind, start, end, cut])
    spans = sorted(
        ((max(w, 1e-3), k, a, b) for w, k, a, b, _ in joined if passes(k, text_of(a, b))), key=lambda s: (s[3], s[2], s[1])
    )
    ends = [s[3] for s in spans]
    best: list[tuple[float, int | None]] = [(0.0, None)]  # of the first i spans: weight, and whether span i - 1 is among them
    before = []
    for i, (weight, _, start, _) in enumerate(spans):
        before.append(int(np.searchsorted(ends, start, side="right")))
        take = best[before[-1]][0] + weight
        best.append((take, i) if take > best[-1][0] else (best[-1][0], None))
    kept, i = [], len(spans)
    while i:
        if best[i][1] is None:
            i -= 1
        else:
            kept.append(spans[i - 1][1:])
            i = before[i - 1]
    return sorted(kept)


def as_text(spans: Iterable[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


_SPANS = "array<struct<kind:int,start:int,end:int>>"
_SCANNED = f"doc_id long, base {_SPANS}, windows array<struct<start:int,text:string,sure:boolean>>, length int"


def _scan(docs: DataFrame) -> DataFrame:
    """Per row: base spans and the windows with a digit or an @ (``sure``: their labels may be learnt from); stored."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, parts, lengths = [], [], []
            for text in batch.column(1).to_pylist():
                starts = windows(text)
                base.append([dict(zip(("kind", "start", "end"), s)) for s in base_spans(text)] if starts else [])
                doubts = doubtful(text) if starts else []
                sure = [all(b <= s or a >= s + WINDOW for a, b in doubts) for s in starts]
                parts.append([{"start": s, "text": text[s : s + WINDOW], "sure": ok} for s, ok in zip(starts, sure)])
                lengths.append(len(text))
            span = pa.list_(pa.struct([(c, pa.int32()) for c in ("kind", "start", "end")]))
            part = pa.list_(pa.struct([("start", pa.int32()), ("text", pa.string()), ("sure", pa.bool_())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(base, span), pa.array(parts, part), pa.array(lengths, pa.int32())],
                names=["doc_id", "base", "windows", "length"],
            )

    return materialize(rows.mapInArrow(run, _SCANNED), "pii-windows")


def _inside(window: str, start: int, spans: list[Span]) -> list[Span] | None:
    """Spans within the window, one per character (the first kind wins); None if one is cut by its edge."""
    found: list[Span] = []
    for kind, a, b in spans:
        a, b = a - start, b - start
        if b <= 0 or a >= len(window):
            continue
        if a < 0 or b > len(window):
            return None
        if all(b <= x or a >= y for _, x, y in found):
            found.append((kind, a, b))
    return found


def training_windows(scanned: DataFrame, sample: int = SAMPLE) -> list[tuple[str, list[Span]]]:
    """At most ``sample`` windows of each class: those around a span of each kind, and those without any.

    All windows are counted by class; those below a bound of their hash that leaves about ``sample`` come to the driver.
    """
    each = scanned.select("base", F.explode("windows").alias("w")).where("w.sure").select("base", "w.start", "w.text")
    near = F.filter("base", lambda s: (s["end"] > F.col("start")) & (s["start"] < F.col("start") + WINDOW))
    classed = each.select(
        "start", "text", near.alias("near"), F.xxhash64("text").alias("hash"),
        F.explode(F.when(F.size(near) == 0, F.array(F.lit(-1))).otherwise(F.array_distinct(F.transform(near, lambda s: s["kind"])))).alias("class"),
    )
    classes = {r["class"]: r["n"] for r in classed.groupBy("class").agg(F.count_distinct("hash").alias("n")).collect()}
    bound = F.lit(None)
    for kind, n in classes.items():
        reach = 2**63 - 1 if n <= sample else int(2.0**64 * sample / n) - 2**63
        bound = F.when(F.col("class") == kind, F.lit(reach)).otherwise(bound)
    drawn = classed.where(F.col("hash") <= bound).groupBy("class", "hash").agg(F.min(F.struct("text", "start", "near")).alias("w"))
    taken = []
    for row in sorted(drawn.collect(), key=lambda r: (r["class"], r["hash"])):
        spans = _inside(row["w"]["text"], row["w"]["start"], [(s["kind"], s["start"], s["end"]) for s in row["w"]["near"]])
        if spans is not None:
            taken.append((row["w"]["text"], spans))
    return taken


def variants(taken: list[tuple[str, list[Span]]], rng: random.Random) -> Iterator[tuple[str, list[Span]]]:
    """Windows without spans into which spans of other windows are set: alone, side by side, and written in other ways."""
    plain = [t for t, s in taken if not s] or [""]
    known = [(k, t[a:b]) for t, s in taken for k, a, b in s]
    for _ in known:
        text, spans = rng.choice(plain)[: rng.randint(0, WINDOW // 2)].rstrip() + " ", []
        for _ in range(rng.choice((1, 2, 2, 3))):
            kind, found = rng.choice(known)
            found = rewritten(kind, found, rng)
            if len(text) + len(found) > WINDOW:
                break
            spans.append((kind, len(text), len(text) + len(found)))
            text += found + rng.choice((" ", " ", " ", ", ", " and ", "; "))
        text = (text + rng.choice(plain))[:WINDOW]
        yield text, spans


def rewritten(kind: int, found: str, rng: random.Random) -> str:
    if rng.random() < 0.5:
        return found
    if kind == 0:
        return found.replace(found[0], rng.choice("éüñøß"), 1)
    if kind == 1:
        return found.replace(".", rng.choice(("[.]", " . ", "(.)")))
    digits = _digits(found)
    if kind == 2:
        return rng.choice(("-", " ", ".")).join(digits[i : i + 4] for i in range(0, len(digits), 4))
    local = digits[-10:]
    return rng.choice((f"({local[:3]}) {local[3:6]}-{local[6:]}", f"+{digits[:-10]}/{local[:3]}/{local[3:]}", f"{local[:3]}-{local[3:6]}-{local[6:]}"))


def learn(scanned: DataFrame, sample: int = SAMPLE) -> Tagger | None:
    taken = training_windows(scanned, sample)
    if not any(spans for _, spans in taken):
        return None
    rows = taken + list(variants(taken, random.Random(SEED)))
    x = np.stack([symbols(t, WINDOW) for t, _ in rows])
    y = np.stack([labelled(s, WINDOW) for _, s in rows])
    return Tagger.fresh().fit(x, y)


def _added(tagger: Tagger, rows: list[tuple[list[Span], list[tuple[int, str]], int]]) -> list[list[Span]]:
    """Spans that the tagger adds to each row of (base spans, windows, length)."""
    flat = [(at, start, text) for at, (_, parts, _) in enumerate(rows) for start, text in parts]
    found: list[list[tuple[float, int, int, int, bool]]] = [[] for _ in rows]
    for i in range(0, len(flat), DECODED):
        block = flat[i : i + DECODED]
        for (at, start, text), spans in zip(block, tagger.decode([t for _, _, t in block])):
            for weight, kind, a, b in spans:
                cut = (a == 0 and start > 0) or (b == len(text) and start + b < rows[at][2])
                found[at].append((weight, kind, start + a, start + b, cut))
    result = []
    for (base, parts, _), spans in zip(rows, found):
        texts = dict(parts)

        def text_of(a: int, b: int, texts: dict[int, str] = texts) -> str:
            out = ""
            while len(out) < b - a:  # the windows from which the span came are all there
                at = a + len(out)
                start = at // STRIDE * STRIDE
                part = texts.get(start, "")[at - start : b - start] or texts.get(start - STRIDE, "")[at - start + STRIDE : b - start + STRIDE]
                if not part:
                    return ""
                out += part
            return out

        kept = reconcile(spans, text_of)
        result.append([s for s in kept if all(s[0] != k or s[2] <= a or s[1] >= b for k, a, b in base)])
    return result


def find(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (base and added) of each row."""
    scanned = _scan(docs)
    tagger = learn(scanned, sample)
    weights = scanned.sparkSession.sparkContext.broadcast(tagger and tagger.w)  # some 20,000 numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = weights.value and Tagger(weights.value)
        for batch in batches:
            base = [[(s["kind"], s["start"], s["end"]) for s in row] for row in batch.column(1).to_pylist()]
            parts = [[(w["start"], w["text"]) for w in row] for row in batch.column(2).to_pylist()]
            added = _added(own, list(zip(base, parts, batch.column(3).to_pylist()))) if own else [[]] * len(base)
            counts = [pa.array([sum(s[0] == k for s in row) for row in base], pa.int64()) for k in range(len(KINDS))]
            digests = [hashlib.sha256(as_text(row).encode()).hexdigest() for row in base]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts, pa.array(digests), pa.array([as_text(a + b) for a, b in zip(base, added)])],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
            )

    names = ", ".join(f"n_{k} long" for k in KINDS)
    return scanned.mapInArrow(run, f"doc_id long, {names}, base_sha256 string, spans string")
