"""Secret scans: rules, and a character convolutional network over every candidate and its context.

Three rules give base findings, which always stay: ``assign`` (a keyword, ``:`` or
``=``, and a value of 8 characters and more), ``access`` (``AKIA`` and upper-case
letters or digits, 16 and more) and ``hex`` (32 and more). A candidate is a whole run
of ``[A-Za-z0-9+/_=.-]`` of 12 characters and more that holds a digit, or upper case
after lower case. The network reads each candidate with 24 characters before and 12
after it: character and zone embeddings, one convolution, maxima over the window and
over the candidate and a mean over the candidate, a hidden layer, one logit. Pooling
goes piece by piece, so a candidate of any length counts whole.

It learns from labelled findings: every distinct candidate of all documents with its
context, labelled by whether a rule finds it, and generated findings of public key
formats and decoys (identifiers, dates, addresses, numbers) in neutral and telling
contexts. Spark deals the findings into parts by a hash; in each round every part
takes one pass of small steps from the common weights, and the parts' weights and
moments are averaged (``fit``). Each part also sees all generated findings; within a
label they weigh as much as the corpus's findings, if those are more. A fourth of the findings, by a hash, is held out; on
it the logits are calibrated (Platt's a * x + b), and each shape of candidate gets the
highest threshold that still reaches the wanted recall of held-out secrets of the
corpus and of generated ones, each by itself. Candidates that reach theirs and touch
no base finding become spans of kind ``model``.

Learning and scanning cover whole texts of all rows; the driver holds weights, counts
and sums alone. Sums are of whole multiples of 2^-30, so they don't depend on the order
of rows. ``corpus_findings`` and ``train`` fit a network on the driver from a bounded
list of findings; the query doesn't use them. A null text scans like an empty one:
nothing found, hash of an empty text. Repeated rows have a result row each; an empty
table has none, and findings are then the generated ones. Places are code points.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galvana.operators.order import ordered_counts
from galvana.shared import bounded_batches, cut

KINDS = ("assign", "access", "hex", "model")
#: The rules. Letters of the keyword stand in either case, ASCII alone.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.-]{12,}")
_TELLING = re.compile(r"[0-9]|[a-z][A-Z]")

BEFORE, AFTER = 24, 12
#: Symbols: 0 pads, 1 to 95 are printable ASCII, then white space, then all others.
_BLANK, _OTHER, _SYMBOLS = 96, 97, 98
_SHAPES = (("hex", re.compile(r"[0-9a-f]+|[0-9A-F]+")), ("number", re.compile(r"[0-9+/_=.-]+")), ("mixed", re.compile(r"(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9]).+", re.DOTALL)), ("other", re.compile(r".+", re.DOTALL)))
_PIECE = 1 << 16


def base_findings(text: str) -> list[tuple[int, int, int]]:
    """Kind's place in ``KINDS``, start and end of what the rules find, by start and then kind."""
    found = [(0, m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    found += [(1, m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(2, m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[1], x[0]))


def candidates(text: str) -> list[tuple[int, int]]:
    """Start and end of every candidate."""
    return [m.span() for m in _CANDIDATE.finditer(text) if _TELLING.search(text, *m.span())]


def touched(base: list[tuple[int, int, int]], own: list[tuple[int, int]]) -> list[bool]:
    """Of each candidate, whether it shares a place with one of the base findings, which stand by start."""
    firsts, lasts = np.array([x[1] for x in base], np.int64), np.maximum.accumulate(np.array([x[2] for x in base], np.int64))
    before = np.searchsorted(firsts, [b for _, b in own]) - 1  # the last base finding that starts before the end
    return [bool(k >= 0 and lasts[k] > a) for k, (a, _) in zip(before.tolist(), own, strict=True)]


def shape_of(value: str) -> int:
    """The place in ``_SHAPES`` of the first shape that the whole value has."""
    return next(k for k, (_, pattern) in enumerate(_SHAPES) if pattern.fullmatch(value))


def _symbol_table() -> np.ndarray:
    table = np.full(0x110000, _OTHER, np.uint8)
    table[32:127] = np.arange(1, 96)
    table[[0x20, *range(9, 14), 0x85, 0xA0]] = _BLANK
    return table


class Windows:
    """Candidates with their contexts as one array of symbols, two pads around each."""

    def __init__(self, table: np.ndarray | None = None) -> None:
        self.table = _symbol_table() if table is None else table
        self.parts: list[np.ndarray] = []
        self.spans: list[tuple[int, int, int]] = []  # length of the window, start and end of the candidate in it
        self.size = 0

    def add(self, text: str, start: int, end: int) -> None:
        a, b = max(0, start - BEFORE), min(len(text), end + AFTER)
        self.parts.append(np.frombuffer(text[a:b].encode("utf-32-le", "surrogatepass"), np.uint32))
        self.spans.append((b - a, start - a, end - a))
        self.size += b - a + 4

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols, their zones (0 pad, 1 before, 2 candidate, 3 after) and the windows' starts, one more than windows."""
        sizes = np.array([n for n, _, _ in self.spans], np.int64) + 4
        starts = np.r_[0, np.cumsum(sizes)]
        symbols, zones = np.zeros(starts[-1], np.uint8), np.zeros(starts[-1], np.uint8)
        for raw, (n, a, b), at in zip(self.parts, self.spans, (starts[:-1] + 2).tolist(), strict=True):
            symbols[at : at + n] = self.table[raw]
            zones[at : at + a], zones[at + a : at + b], zones[at + b : at + n] = 1, 2, 3
        return symbols, zones, starts


def _columns(x: np.ndarray, width: int) -> np.ndarray:
    """For every place but the outermost, the rows of ``width`` places around it side by side."""
    return np.lib.stride_tricks.sliding_window_view(x, width, axis=0).transpose(0, 2, 1).reshape(len(x) - width + 1, -1)


@dataclass
class Network:
    """Weights of the network, its calibration and thresholds by shape."""

    weights: dict[str, np.ndarray]
    calibration: tuple[float, float] = (1.0, 0.0)
    thresholds: np.ndarray = field(default_factory=lambda: np.full(len(_SHAPES), 0.5))
    report: dict = field(default_factory=dict)

    WIDTH = 5

    @classmethod
    def fresh(cls, rng: np.random.Generator, letters: int = 8, filters: int = 24, hidden: int = 16) -> Network:
        w = cls.WIDTH
        return cls({
            "letter": rng.normal(0, 0.3, (_SYMBOLS, letters)), "zone": rng.normal(0, 0.3, (4, letters)),
            "filter": rng.normal(0, (2 / (w * letters)) ** 0.5, (w * letters, filters)), "filter0": np.zeros(filters),
            "hidden": rng.normal(0, (2 / (3 * filters)) ** 0.5, (3 * filters, hidden)), "hidden0": np.zeros(hidden),
            "out": rng.normal(0, hidden**-0.5, hidden), "out0": np.zeros(1),
        })

    def _pieces(self, symbols: np.ndarray, zones: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """A piece's first and last place, the embeddings around each place side by side, and the filters' answers before they are cut at 0."""
        w, half = self.weights, self.WIDTH // 2
        for a in range(half, len(symbols) - half, _PIECE):
            b = min(a + _PIECE, len(symbols) - half)
            cols = _columns(w["letter"][symbols[a - half : b + half]] + w["zone"][zones[a - half : b + half]], self.WIDTH)
            yield a, b, cols, cols @ w["filter"] + w["filter0"]

    def pooled(self, symbols: np.ndarray, zones: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Of each window the filters' maxima over it, and maxima and means over the candidate."""
        n, f = len(starts) - 1, self.weights["filter"].shape[1]
        top, inner, total = np.zeros((n, f)), np.zeros((n, f)), np.zeros((n, f))
        owner = np.repeat(np.arange(n), np.diff(starts))
        for a, b, _, before in self._pieces(symbols, zones):
            h = np.maximum(before, 0)
            for places, into in ((np.flatnonzero(zones[a:b]), [(np.maximum, top)]), (np.flatnonzero(zones[a:b] == 2), [(np.maximum, inner), (np.add, total)])):
                if len(places):
                    own = owner[a:b][places]
                    first = np.flatnonzero(np.r_[True, np.diff(own) != 0])
                    for how, out in into:
                        out[own[first]] = how(out[own[first]], how.reduceat(h[places], first, axis=0))
        count = np.bincount(owner[zones == 2], minlength=n)
        return np.hstack([top, inner, total / np.maximum(count, 1)[:, None]])

    def logits(self, windows: Windows) -> np.ndarray:
        if not windows.spans:
            return np.zeros(0)
        w = self.weights
        return np.maximum(self.pooled(*windows.arrays()) @ w["hidden"] + w["hidden0"], 0) @ w["out"] + w["out0"]

    def probabilities(self, windows: Windows) -> np.ndarray:
        a, b = self.calibration
        return 1 / (1 + np.exp(-np.clip(a * self.logits(windows) + b, -500, 500)))

    def gradients(self, windows: Windows, labels: np.ndarray, shares: np.ndarray) -> dict[str, np.ndarray]:
        """Of the logistic loss, findings weighted by ``shares``; piece by piece, as ``pooled`` goes."""
        w, half = self.weights, self.WIDTH // 2
        symbols, zones, starts = windows.arrays()
        pool = self.pooled(symbols, zones, starts)
        n, f = len(labels), w["filter"].shape[1]
        inside = pool @ w["hidden"] + w["hidden0"]
        lit = np.maximum(inside, 0)
        p = 1 / (1 + np.exp(-np.clip(lit @ w["out"] + w["out0"], -500, 500)))
        slope = (p - labels) * shares
        g = {k: np.zeros_like(v) for k, v in w.items()}
        g["out"], g["out0"] = lit.T @ slope, np.array([slope.sum()])
        back = np.outer(slope, w["out"]) * (inside > 0)
        g["hidden"], g["hidden0"] = pool.T @ back, back.sum(axis=0)
        to_pool = back @ w["hidden"].T
        owner = np.repeat(np.arange(n), np.diff(starts))
        mean = to_pool[:, 2 * f :] / np.maximum(np.bincount(owner[zones == 2], minlength=n), 1)[:, None]
        passed = np.zeros((2, n, f), bool)  # a maximum's gradient goes to its first place alone
        for a, b, cols, before in self._pieces(symbols, zones):
            h, to_h = np.maximum(before, 0), np.zeros_like(before)
            inner = np.flatnonzero(zones[a:b] == 2)
            to_h[inner] = mean[owner[a:b][inner]]
            for k, places in enumerate((np.flatnonzero(zones[a:b]), inner)):
                if len(places):
                    own = owner[a:b][places]
                    first = np.flatnonzero(np.r_[True, np.diff(own) != 0])
                    at = np.minimum.reduceat(np.where(h[places] == pool[own, k * f : (k + 1) * f], places[:, None], b), first, axis=0)
                    who, which = np.nonzero((at < b) & ~passed[k][own[first]])
                    to_h[at[who, which], which] += to_pool[own[first][who], k * f + which]
                    passed[k][own[first][who], which] = True
            to_h *= before > 0
            g["filter"] += cols.T @ to_h
            g["filter0"] += to_h.sum(axis=0)
            to_cols = (to_h @ w["filter"].T).reshape(len(to_h), self.WIDTH, -1)
            to_x = np.zeros((b - a + 2 * half, to_cols.shape[2]))
            for k in range(self.WIDTH):
                to_x[k : k + len(to_h)] += to_cols[:, k]
            for name, of in (("letter", symbols), ("zone", zones)):
                g[name] += np.stack([np.bincount(of[a - half : b + half], x, len(g[name])) for x in to_x.T], axis=1)
        return g


@dataclass(frozen=True)
class Settings:
    most_documents: int = 16_384
    most_findings: int = 2_048
    generated: int = 3_000
    recall: float = 0.98
    epochs: int = 5
    batch: int = 128
    rate: float = 3e-3
    seed: int = 11
    #: Of ``fit``: findings of a part, and most parts; more findings make parts longer.
    part: int = 8_192
    most_parts: int = 64


#: A labelled finding: a text that holds it and its context, start, end, and 1 for a secret.
Finding = tuple[str, int, int, int]


def _calibrated(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt's slope and offset by Newton steps, with his softened targets."""
    up, down = y.sum(), len(y) - y.sum()
    target = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -500, 500)))
        g, s = p - target, np.maximum(p * (1 - p), 1e-9)
        grad = np.array([g @ x + 1e-3 * (a - 1), g.sum()])
        step = np.linalg.solve(np.array([[s @ (x * x) + 1e-3, s @ x], [s @ x, s.sum() + 1e-9]]), grad)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


class Learner:
    """Steps of Adam on a network's weights; ``state`` holds weights, first and second moments, a row each."""

    def __init__(self, net: Network, steps: int = 0, state: np.ndarray | None = None) -> None:
        self.net, self.steps = Network({k: v.copy() for k, v in net.weights.items()}), steps
        self.first, self.second = ({k: np.zeros_like(v) for k, v in net.weights.items()} for _ in range(2))
        if state is not None:
            for kept, flat in zip((self.net.weights, self.first, self.second), state, strict=True):
                at = 0
                for k in sorted(kept):
                    kept[k] = flat[at : at + kept[k].size].reshape(kept[k].shape).copy()
                    at += kept[k].size

    @property
    def state(self) -> np.ndarray:
        return np.stack([np.concatenate([kept[k].ravel() for k in sorted(kept)]) for kept in (self.net.weights, self.first, self.second)])

    def step(self, windows: Windows, labels: np.ndarray, shares: np.ndarray, rate: float) -> None:
        self.steps += 1
        for k, g in self.net.gradients(windows, labels, shares).items():
            self.first[k] = 0.9 * self.first[k] + 0.1 * g
            self.second[k] = 0.999 * self.second[k] + 0.001 * g * g
            self.net.weights[k] -= rate * self.first[k] / (1 - 0.9**self.steps) / (np.sqrt(self.second[k] / (1 - 0.999**self.steps)) + 1e-8)


def train(findings: list[Finding], settings: Settings | None = None) -> Network:
    """Fit, calibrate and set thresholds on a list of labelled findings; every fourth of a seeded order is held out."""
    s = settings or Settings()
    rng = np.random.default_rng(s.seed)
    order = rng.permutation(len(findings))
    held = [findings[k] for k in order[::4]]
    learnt = [findings[k] for k in np.delete(order, np.s_[::4])]
    table = _symbol_table()
    net = Network.fresh(rng)
    labels = np.array([y for *_, y in learnt], np.float64)
    share = np.where(labels == 1, 0.5 / max(labels.sum(), 1), 0.5 / max(len(labels) - labels.sum(), 1)) * len(labels)
    learner = Learner(net)
    for _ in range(s.epochs):
        for batch in np.array_split(rng.permutation(len(learnt)), max(1, len(learnt) // s.batch)):
            windows = Windows(table)
            for k in batch:
                windows.add(*learnt[k][:3])
            learner.step(windows, labels[batch], share[batch] / max(1, len(batch)), s.rate)
    net = learner.net
    windows = Windows(table)
    for x in held:
        windows.add(*x[:3])
    y = np.array([x[3] for x in held])
    net.calibration = _calibrated(net.logits(windows), y)
    p = net.probabilities(windows)
    shapes = np.array([shape_of(t[a:b]) for t, a, b, _ in held])
    for k in range(len(_SHAPES)):
        own = np.sort(p[(shapes == k) & (y == 1)])
        if len(own) < 20:  # too few secrets of this shape: all shapes together
            own = np.sort(p[y == 1])
        net.thresholds[k] = own[int((1 - s.recall) * len(own))] if len(own) else 1.0
    hit = p >= net.thresholds[shapes]
    net.report = {"held_out": len(y), "secrets": int(y.sum()), "recall": float(hit[y == 1].mean()) if y.any() else None, "false_alarms": float(hit[y == 0].mean()) if (y == 0).any() else None}
    return net


#: Public formats of keys, as a start, an alphabet and a length.
_FORMATS = (
    ("AKIA", string.ascii_uppercase + string.digits, 16), ("ghp_", string.ascii_letters + string.digits, 36), ("glpat-", string.ascii_letters + string.digits + "-_", 20),
    ("AIza", string.ascii_letters + string.digits + "-_", 35), ("sk_live_", string.ascii_letters + string.digits, 24), ("npm_", string.ascii_letters + string.digits, 36),
    ("xoxb-", string.digits + string.ascii_letters, 40), ("eyJ", string.ascii_letters + string.digits + "-_", 60), ("", "0123456789abcdef", 32), ("", "0123456789abcdef", 40),
    ("", "0123456789abcdef", 64), ("", string.ascii_letters + string.digits + "+/", 40), ("", string.ascii_letters + string.digits + "+/", 64), ("", string.ascii_letters + string.digits, 20),
)
#: What stands before and after a key that its context tells.
_TOLD = (('token = "', '"'), ("password: ", ""), ('"api_key": "', '",'), ("Authorization: Bearer ", ""), ("export SECRET_KEY=", ""), ("?access_token=", "&"), ("private key ", ""))


def generated_findings(n: int, seed: int) -> list[Finding]:
    """Secrets of public formats and decoys, half and half, in neutral or telling contexts."""
    rng = random.Random(seed)
    text = lambda letters, k: "".join(rng.choices(letters, k=k))
    word = lambda: text("aeiouaeiounrtlsdmpc", rng.randint(2, 9))
    words = lambda k: " ".join(word() for _ in range(k))
    digits, hexes = string.digits, "0123456789abcdef"
    decoys = (
        lambda: "-".join(text(hexes, k) for k in (8, 4, 4, 4, 12)),
        lambda: f"{rng.randint(1990, 2040)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}T{rng.randint(0, 23):02}",
        lambda: ".".join(str(rng.randint(100, 255)) for _ in range(4)),
        lambda: text(digits, rng.randint(12, 20)),
        lambda: "-".join(text(digits, k) for k in (3, 3, 4, 2)),
        lambda: "_".join([word(), word(), word(), text(digits, 2)]),
        lambda: "/".join(["", "usr", "lib", word() + text(digits, 2), word()]),
        lambda: word().title() + word().title() + word().title() + word().title(),
        lambda: f"{word()}{word()}-{rng.randint(1, 20)}.{rng.randint(0, 30)}.{rng.randint(0, 30)}.tar.gz",
        lambda: "www." + word() + word() + text(digits, 2) + ".example.com/" + word(),
        lambda: f"{word()}{word()}.{text(digits, 2)}",
        lambda: "=" * rng.randint(6, 30) + text(digits, 1) + "-" * rng.randint(6, 30),
    )
    out: list[Finding] = []
    while len(out) < n:
        secret = len(out) % 2
        if secret:
            start, letters, size = rng.choice(_FORMATS)
            value = start + text(letters, size)
        else:
            value = rng.choice(decoys)()
        before, after = rng.choice(_TOLD) if rng.random() < (0.4 if secret else 0.05) else ("", "")
        whole = f"{words(rng.randint(0, 6))} {before}{value}{after} {words(rng.randint(0, 4))}"
        at = whole.index(value)
        found = [(a, b) for a, b in candidates(whole) if a <= at + len(value) - 1 and at < b]
        if found:
            out.append((whole, *found[0], secret))
    return out


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of candidates, labelled by the rules."""
    schema = pa.schema([("window", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("label", pa.int32())])
    for batch in batches:
        for text in batch.column("text").to_pylist():
            own = candidates(text or "")
            secret = touched(base_findings(text or ""), own)
            for k in range(0, len(own), 1000):
                rows = []
                for (a, b), y in zip(own[k : k + 1000], secret[k : k + 1000], strict=True):
                    low = max(0, a - BEFORE)
                    rows.append({"window": text[low : b + AFTER], "start": a - low, "stop": b - low, "label": int(y)})
                yield pa.RecordBatch.from_pylist(rows, schema)


def corpus_findings(docs: DataFrame, settings: Settings | None = None) -> list[Finding]:
    """For ``train``: distinct candidates of a sample of documents, at most ``most_findings`` of either label, the first by hash."""
    s = settings or Settings()
    bounded_batches(docs.sparkSession)
    share = min(1.0, s.most_documents / max(1, docs.count()))
    some = docs.where(F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = some.select("text").mapInArrow(_labelled, "window string, start int, stop int, label int").distinct()
    found = []
    for label in (0, 1):
        own = rows.where(F.col("label") == label).orderBy(F.xxhash64("window", "start"), "window", "start").limit(s.most_findings)
        found += sorted((r["window"], r["start"], r["stop"], label) for r in own.collect())
    return found


_FINDING = "window string, start int, stop int, label int"


def labelled_findings(docs: DataFrame) -> DataFrame:
    """Every distinct candidate of all documents with its context, labelled by whether a rule finds it."""
    bounded_batches(docs.sparkSession)
    return docs.select("text").mapInArrow(_labelled, _FINDING).distinct()


def _passing(net: Network, steps: int, state: np.ndarray, s: Settings) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One pass over each part's findings, which stand together: the part's findings, steps and state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, part, n, taken, learner = _symbol_table(), None, 0, [], None

        def step() -> None:
            windows = Windows(table)
            for window, start, stop, _, _ in taken:
                windows.add(window, start, stop)
            learner.step(windows, np.array([x[3] for x in taken], float), np.array([x[4] for x in taken]) / s.batch, s.rate)
            taken.clear()

        def done() -> pa.RecordBatch:
            if taken:
                step()
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "n": pa.array([n], pa.int64()), "steps": pa.array([learner.steps], pa.int64()), "state": pa.array([learner.state.tobytes()], pa.binary())})

        for batch in batches:
            for own, *finding in zip(*(batch.column(c).to_pylist() for c in ("part", "window", "start", "stop", "label", "share")), strict=True):
                if own != part:
                    if part is not None:
                        yield done()
                    part, n, learner = own, 0, Learner(net, steps, state)
                n += 1
                taken.append(finding)
                if len(taken) == s.batch:
                    step()
        if part is not None:
            yield done()

    return run


def _answering(net: Network) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Logits and shapes of findings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _symbol_table()
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                some = batch.slice(a, 1000)
                windows, shapes = Windows(table), []
                for window, start, stop in zip(*(some.column(c).to_pylist() for c in ("window", "start", "stop")), strict=True):
                    windows.add(window, start, stop)
                    shapes.append(shape_of(window[start:stop]))
                yield pa.RecordBatch.from_arrays([some.column("made"), some.column("label"), pa.array(shapes, pa.int32()), pa.array(net.logits(windows).round(9))], names=["made", "label", "shape", "logit"])

    return run


def _whole(x: Column) -> Column:
    """A sum in whole multiples of 2^-30, which no order of rows changes."""
    return F.sum(F.round(x * float(1 << 30)).cast("decimal(28,0)")).cast("double") / float(1 << 30)


def _platt(held: DataFrame, up: int, down: int) -> tuple[float, float]:
    """As ``_calibrated``, each Newton step's sums made by Spark."""
    a, b, y, x = 1.0, 0.0, F.col("label"), F.col("logit")
    target = F.when(y == 1, (up + 1) / (up + 2)).otherwise(1 / (down + 2))
    for _ in range(50):
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), x * a + b))))
        rows = held.select("logit", (p - target).alias("g"), F.greatest(p * (1 - p), F.lit(1e-9)).alias("s"))
        g, s = F.col("g"), F.col("s")
        gx, g0, sxx, sx, s0 = rows.agg(*(_whole(v) for v in (g * x, g, s * x * x, s * x, s))).first()
        step = np.linalg.solve(np.array([[sxx + 1e-3, sx], [sx, s0 + 1e-9]]), np.array([gx + 1e-3 * (a - 1), g0]))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(a), float(b)


def fit(findings: DataFrame, settings: Settings | None = None) -> Network:
    """Fit, calibrate and set thresholds on all ``findings`` of a corpus and on generated ones, by Spark."""
    s, spark = settings or Settings(), findings.sparkSession
    made = spark.createDataFrame(generated_findings(s.generated, s.seed), _FINDING)
    fields = [x.split()[0] for x in _FINDING.split(", ")]
    rows = findings.select(*fields, F.lit(0).alias("made")).union(made.select(*fields, F.lit(1).alias("made")))
    rows = cut(rows.withColumn("place", F.xxhash64(*fields)), "findings")
    is_held = F.pmod("place", F.lit(4)) == 0
    count = {(r["held"], r["made"], r["label"]): r["n"] for r in rows.groupBy(is_held.alias("held"), "made", "label").agg(F.count("*").alias("n")).collect()}
    learnt = {k[1:]: n for k, n in count.items() if not k[0]}

    # Parts: corpus findings by a hash, generated ones in every part.
    parts = max(1, min(s.most_parts, -(-sum(n for (made_, _), n in learnt.items() if not made_) // s.part)))
    size = {k: n * (parts if k[0] else 1) for k, n in learnt.items()}
    weight = {(made_, y): max(n, size.get((0, y), 0)) for (made_, y), n in size.items()}
    share = F.lit(0.0)
    for (made_, label), n in size.items():
        whole = sum(w for (_, y), w in weight.items() if y == label)
        share = F.when((F.col("made") == made_) & (F.col("label") == label), sum(size.values()) * weight[made_, label] / (2 * whole * n)).otherwise(share)
    own = F.when(F.col("made") == 0, F.array(F.pmod(F.floor(F.col("place") / 4), F.lit(parts)).cast("int"))).otherwise(F.sequence(F.lit(0), F.lit(parts - 1)))
    dealt = rows.where(~is_held).select(F.explode(own).alias("part"), "place", *fields, share.alias("share"))
    learner = Learner(Network.fresh(np.random.default_rng(s.seed)))
    for turn in range(s.epochs):
        ordered = dealt.repartition(parts, "part").sortWithinPartitions("part", F.xxhash64("place", F.lit(turn)), *fields)
        passed = ordered.mapInArrow(_passing(learner.net, learner.steps, learner.state, s), "part int, n long, steps long, state binary").collect()
        passed = sorted(passed, key=lambda r: r["part"])
        n = sum(r["n"] for r in passed)
        if n:
            state = sum(np.frombuffer(r["state"]).reshape(learner.state.shape) * (r["n"] / n) for r in passed)
            learner = Learner(learner.net, max(r["steps"] for r in passed), state)

    net = learner.net
    held = cut(rows.where(is_held).select(*fields, "made").mapInArrow(_answering(net), "made int, label int, shape int, logit double"), "held")
    up, down = (sum(n for (h, _, y), n in count.items() if h and y == label) for label in (1, 0))
    if not up:
        net.thresholds[:] = 1.0
        net.report = {"held_out": down, "secrets": 0, "recall": None, "false_alarms": None}
        return net
    net.calibration = a, b = _platt(held, up, down)
    p = F.round(1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), F.col("logit") * a + b)))), 12)
    held = held.select("made", "label", "shape", p.alias("value"))
    # The shape -1 stands for all: used where an origin has too few secrets of a shape.
    secrets = held.where("label = 1").select("made", F.explode(F.array("shape", F.lit(-1))).alias("shape"), "value")
    ranked = cut(ordered_counts(secrets, ["made", "shape"]), "ranked")
    sizes = ranked.groupBy("made", "shape").agg(F.sum("rows_of").alias("n"))
    at = F.floor(F.lit(1 - s.recall) * F.col("n"))
    found = ranked.join(sizes, ["made", "shape"]).where((F.col("before") <= at) & (at < F.col("before") + F.col("rows_of"))).collect()
    limit = {(r["made"], r["shape"]): r["value"] - 1e-12 for r in found if r["n"] >= 20 or r["shape"] == -1}
    for k in range(len(_SHAPES)):
        net.thresholds[k] = min([v for (_, shape), v in limit.items() if shape == k] or [v for (_, shape), v in limit.items() if shape == -1])
    hit = F.col("value") >= F.element_at(F.array(*(F.lit(float(x)) for x in net.thresholds)), F.col("shape") + 1)
    rates = {(r["made"], r["label"]): (r["hits"], r["n"]) for r in held.groupBy("made", "label").agg(F.count(F.when(hit, 1)).alias("hits"), F.count("*").alias("n")).collect()}
    rate = lambda label: sum(h for (_, y), (h, _) in rates.items() if y == label) / max(1, sum(n for (_, y), (_, n) in rates.items() if y == label))
    net.report = {"held_out": up + down, "secrets": up, "recall": rate(1), "false_alarms": rate(0) if down else None, "hits": rates, "learnt": learnt, "parts": parts}
    return net


_RESULT = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_candidates long, n_model long, most_likely double"


def secret_scan(docs: DataFrame, network: Network) -> DataFrame:
    """``doc_id``, counts and spans of every row of ``docs``; a map over the rows, without a shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(network)
    bounded_batches(docs.sparkSession)
    names = ["doc_id", *(x.split()[0] for x in _RESULT.split(", "))]

    def spans_of(found) -> str:
        return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in found)

    def scanned(texts: list[str], net: Network, table: np.ndarray) -> list[list]:
        windows, found, places = Windows(table), [], []
        for text in texts:
            found.append(base_findings(text))
            places.append(candidates(text))
            for a, b in places[-1]:
                windows.add(text, a, b)
        p, at, out = net.probabilities(windows), 0, []
        for text, base, own in zip(texts, found, places, strict=True):
            likely = p[at : at + len(own)]
            at += len(own)
            more = [(3, a, b) for (a, b), x, old in zip(own, likely.tolist(), touched(base, own), strict=True) if x >= net.thresholds[shape_of(text[a:b])] and not old]
            everything = sorted([*base, *more], key=lambda x: (x[1], x[0]))
            counts = [sum(k == kind for k, _, _ in base) for kind in range(3)]
            out.append([*counts, hashlib.sha256(spans_of(base).encode()).hexdigest(), spans_of(everything), len(own), len(more), float(likely.max()) if len(own) else None])
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _symbol_table()
        for batch in batches:
            texts = batch.column("text")
            for a in range(0, batch.num_rows, 200):
                rows = scanned([x or "" for x in texts.slice(a, 200).to_pylist()], sent.value, table)
                kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()] * 2 + [pa.float64()]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, 200), *columns], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {_RESULT}")


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every text of ``documents``, by the rules and by the network learnt from all of their findings."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return secret_scan(docs, fit(labelled_findings(docs)))
