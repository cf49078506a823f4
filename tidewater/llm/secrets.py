"""Secret scans: base rules, and a character convolutional network that
scores every other candidate with its context.

Base findings are those of three fixed patterns.  A candidate is a run of
CANDIDATE characters that meets no base finding and is no plain word: it
holds a digit, or a capital after a small letter.  It is read whole: a value
longer than VALUE in overlapping pieces, each with the context of the value,
and the best piece counts.  The network (character embedding, one
convolution, maximum and mean over places, one output) learns from every
distinct labelled finding: values found by the base rules against other
candidates, each positive again in the surroundings of a negative, every
second one in capitals, and that negative in the positive's, so that the
value itself must tell.  The findings are
dealt into parts of about PART by their hash.  In each of EPOCHS rounds every
part trains in numpy from the shared weights on its own findings, and the
weights are averaged, as they are over the later half of a part's own epochs; only weights and counts reach the driver.
Candidates are labelled negative although some are secrets that no rule
knows: those that a first fit gives DOUBT or more, its best share NOISE at
most, are left out of a second fit.  A quarter of each part is held out.  All
held-out scores, counted in steps of 1 / GRID, calibrate the network by
Platt's method; the threshold lies halfway between the highest that keeps
RECALL of the held-out positives and the lowest, from 0.5 up, that is as
precise there.  The network carries the recall and the precision reached.

Cases: null text has no findings; without any base finding or any other
candidate there is nothing to learn from and the base findings stand alone; with
under VALIDATE examples of a class all are used for both parts; repeated
rows are scanned each; no rows give no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import map_batches, shuffle_parts, written

# The base rules (kinds in their order).
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_ASSIGN, LEAST_ACCESS = 8, 16
KINDS = ("assign", "access", "hex", "cnn")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.-]{8,}")
NO_WORD = re.compile(r"[0-9]|[a-z][A-Z]")
SIDE, VALUE = 20, 44            # characters of context on each side, and of a piece of the value
OVERLAP = 12                    # characters that neighbouring pieces share
PART = 2048                     # labelled findings that are trained on together, about
VALIDATE = 8
RECALL, NOISE, DOUBT = 0.98, 0.02, 0.1
EPOCHS, BATCH, FILTERS, WIDTH, EMBED = 10, 64, 24, 5, 10
LEAST_STEPS = 200               # more epochs where there are few findings
GRID, FARTHEST = 1024, 32       # raw scores are counted in steps of 1 / GRID, as far as this from 0
FIXED = 1 << 32                 # weights are summed as whole numbers of 1 / FIXED, so that their order does not matter
CHARS = 97                      # printable ASCII, anything else, nothing
MARK = "[secret]"


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, end, kind, start of the value) of the base findings, in order."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), m.end(), 0, m.start(1)) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1, m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), m.end(), 2, m.start()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], x[2]))


def candidates(text: str, base: list) -> list[tuple[int, int]]:
    out, taken, k = [], [], 0
    for s, e, *_ in base:           # in order of start: joined where they overlap
        if taken and s < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], e)
        else:
            taken.append([s, e])
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if NO_WORD.search(text, a, b) and not (k < len(taken) and taken[k][0] < b):
            out.append((a, b))
    return out


def surroundings(text: str, a: int, b: int) -> list[str]:
    """Context and each piece of the value as strings of fixed length; \\0 where there is nothing."""
    before, after = text[max(0, a - SIDE):a].rjust(SIDE, "\0"), text[b:b + SIDE].ljust(SIDE, "\0")
    return [before + text[i:min(b, i + VALUE)].ljust(VALUE, "\0") + after for i in range(a, max(a + 1, b - OVERLAP), VALUE - OVERLAP)]


def encoded(windows: list[str]) -> np.ndarray:
    codes = np.array([list(map(ord, w)) for w in windows], np.int64).reshape(len(windows), 2 * SIDE + VALUE)
    return np.where(codes == 0, 0, np.where((codes >= 32) & (codes < 127), codes - 30, 1))


@dataclass
class Network:
    embed: np.ndarray       # CHARS x EMBED
    conv: np.ndarray        # WIDTH * (EMBED + 1) x FILTERS; the last input tells value from context
    bias: np.ndarray
    out: np.ndarray         # 2 * FILTERS
    shift: np.ndarray       # one number
    scale: tuple[float, float] = (1.0, 0.0)
    threshold: float = 1.1  # nothing passes before fitting
    recall: float = 0.0     # of the validation part at the threshold
    precision: float = 0.0

    def weights(self):
        return [self.embed, self.conv, self.bias, self.out, self.shift]

    def forward(self, x: np.ndarray):
        inside = np.zeros((len(x), x.shape[1], 1), np.float32)
        inside[:, SIDE:SIDE + VALUE] = 1
        chars = np.concatenate([self.embed[x], inside], axis=2)
        view = np.lib.stride_tricks.sliding_window_view(chars, WIDTH, axis=1)       # n, places, inputs, WIDTH
        flat = view.transpose(0, 1, 3, 2).reshape(len(x), -1, WIDTH * (EMBED + 1))
        act = np.maximum(flat @ self.conv + self.bias, 0)
        pooled = np.concatenate([act.max(axis=1), act.mean(axis=1)], axis=1)
        return flat, act, pooled, pooled @ self.out + self.shift[0]

    def raw(self, windows: list[str]) -> np.ndarray:
        parts = [self.forward(encoded(windows[i:i + 256]))[3] for i in range(0, len(windows), 256)]
        return np.concatenate(parts) if parts else np.empty(0, np.float32)

    def probability(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * raw.astype(float) + self.scale[1], -50, 50)))

    def score(self, windows: list[str]) -> np.ndarray:
        return self.probability(self.raw(windows))

    def copy(self) -> Network:
        return Network(*[w.copy() for w in self.weights()])


def _gradients(net: Network, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    flat, act, pooled, z = net.forward(x)
    dz = ((1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) / len(y)).astype(np.float32)
    dpool = dz[:, None] * net.out
    dact = np.repeat(dpool[:, None, FILTERS:] / act.shape[1], act.shape[1], axis=1)
    top = act.argmax(axis=1)
    n, f = np.indices(top.shape)
    dact[n, top, f] += dpool[:, :FILTERS]
    dact *= act > 0
    dflat = (dact @ net.conv.T).reshape(len(x), -1, WIDTH, EMBED + 1)
    dembed = np.zeros_like(net.embed)
    for k in range(WIDTH):
        np.add.at(dembed, x[:, k:k + dflat.shape[1]], dflat[:, :, k, :EMBED])
    return [dembed, np.tensordot(flat, dact, ([0, 1], [0, 1])), dact.sum(axis=(0, 1)), pooled.T @ dz, np.array([dz.sum()], np.float32)]


# What learning works on: run(fn) calls fn(part, findings) for each part's
# (window, label) findings; fn returns (key, whole number) pairs, and run the
# sum and the number of the values of each key.
Run = Callable[[Callable[[int, list], list]], dict]


def fit(positive: list[str], negative: list[str], seed: int = 5) -> Network:
    """A network trained and calibrated on one part; an unfitted one that
    passes nothing if a class has no example."""
    found = [(w, 1) for w in positive] + [(w, 0) for w in negative]
    return _fit(lambda fn: {k: (v, 1) for k, v in fn(0, found)}, 1, len(positive), len(negative), seed)


def _fit(run: Run, parts: int, positives: int, negatives: int, seed: int = 5) -> Network:
    if not positives or not negatives:
        return _new(np.random.default_rng(seed))
    first = _fit_once(run, parts, positives, negatives, seed)
    score, _, count = _table(run(lambda part, found: _counts(first.raw([w for w, t in found if not t]), 0)))
    above = count[::-1].cumsum()[::-1]
    doubtful = (above <= int(NOISE * negatives)) & (first.probability(score) >= DOUBT)
    if not doubtful.any():
        return first
    cut = score[doubtful][0]

    def rest(found: list) -> list:
        away = iter(_on_grid(first.raw([w for w, t in found if not t])) >= cut)
        return [(w, t) for w, t in found if t or not next(away)]

    return _fit_once(lambda fn: run(lambda part, found: fn(part, rest(found))), parts, positives, negatives - int(above[doubtful][0]), seed)


def _new(rng: np.random.Generator) -> Network:
    f32 = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
    return Network(f32(CHARS, EMBED), f32(WIDTH * (EMBED + 1), FILTERS) / 2, np.zeros(FILTERS, np.float32), f32(2 * FILTERS), np.zeros(1, np.float32))


def _examples(part: int, found: list, few: set, seed: int) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Windows and labels of a part, and which of them to train and to check
    on: a quarter of each class is held out, unless the class has few."""
    rng = np.random.default_rng([seed, part])
    windows, y = [w for w, _ in found], np.array([t for _, t in found], np.float32)
    held = np.zeros(len(y), bool)
    for label in (1, 0):
        own = rng.permutation(np.flatnonzero(y == label))
        held[own[(np.arange(len(own)) + part) % 4 == 0]] = True
    sides = {side: np.flatnonzero((y == 0) & (held == side)) for side in (True, False)}
    swapped, labels, side_of = [], [], []
    for i, p in enumerate(np.flatnonzero(y == 1)):
        own = sides[bool(held[p])] if len(sides[bool(held[p])]) else sides[not held[p]]
        if len(own):
            n = windows[own[rng.integers(len(own))]]
            value = windows[p][SIDE:SIDE + VALUE]
            swapped += [n[:SIDE] + (value.upper() if i % 2 else value) + n[SIDE + VALUE:],
                        windows[p][:SIDE] + n[SIDE:SIDE + VALUE] + windows[p][SIDE + VALUE:]]
            labels += [1, 0]
            side_of += [held[p]] * 2
    y = np.concatenate([y, np.array(labels, np.float32)])
    held = np.concatenate([held, np.array(side_of, bool)])
    both = np.isin(y, list(few))
    return windows + swapped, y, ~held | both, held | both


def _passes(net: Network, x: np.ndarray, y: np.ndarray, epochs: int, rng: np.random.Generator) -> None:
    """Train ``net`` in place by Adam; it ends with the mean of the weights
    of the later half of the epochs."""
    m = [np.zeros_like(w) for w in net.weights()]
    v = [np.zeros_like(w) for w in net.weights()]
    later = [np.zeros(w.shape) for w in net.weights()]
    step = 0
    for epoch in range(epochs):
        for part in np.array_split(rng.permutation(len(x)), max(1, len(x) // BATCH)):
            step += 1
            for w, g, a, b in zip(net.weights(), _gradients(net, x[part], y[part]), m, v):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                w -= (0.004 * (a / (1 - 0.9 ** step)) / (np.sqrt(b / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
        if epoch >= epochs // 2:
            for w, total in zip(net.weights(), later):
                total += w
    for w, total in zip(net.weights(), later):
        w[...] = total / (epochs - epochs // 2)


def _fit_once(run: Run, parts: int, positives: int, negatives: int, seed: int) -> Network:
    net = _new(np.random.default_rng(seed))
    few = {float(label) for label, n in ((1, 2 * positives), (0, negatives)) if n < VALIDATE}
    mean_part = max(1, (3 * positives + negatives) * 3 // 4 // parts)
    rounds = 1 if parts == 1 else EPOCHS
    epochs = -(-max(EPOCHS, -(-LEAST_STEPS * BATCH // mean_part)) // rounds)
    for turn in range(rounds):
        def trained(part: int, found: list) -> list:
            windows, y, use, _ = _examples(part, found, few, seed)
            if not use.any():
                return []
            own = net.copy()
            _passes(own, encoded(windows)[use], y[use], epochs, np.random.default_rng([seed, part, turn]))
            return list(enumerate(np.rint(np.concatenate([w.ravel() for w in own.weights()]).astype(float) * FIXED).astype(np.int64).tolist()))

        sums = run(trained)
        flat = np.array([sums[i][0] / sums[i][1] / FIXED for i in range(len(sums))], np.float32)
        ends = np.cumsum([w.size for w in net.weights()])[:-1]
        net = Network(*[own.reshape(w.shape) for w, own in zip(net.weights(), np.split(flat, ends))])

    def checked(part: int, found: list, every: bool = False) -> list:
        windows, y, _, use = _examples(part, found, few, seed)
        z = net.raw([w for w, u in zip(windows, use) if u or every])
        t = y if every else y[use]
        return _counts(z[t == 1], 1) + _counts(z[t == 0], 0)

    table = _table(run(checked))
    if not (table[1].any() and table[2].any()):     # thinly spread: a class has none held out
        table = _table(run(lambda part, found: checked(part, found, True)))
    _calibrate(net, *table)
    return net


def _on_grid(z: np.ndarray) -> np.ndarray:
    return np.rint(np.clip(z.astype(float), -FARTHEST, FARTHEST) * GRID) / GRID


def _counts(z: np.ndarray, label: int) -> list:
    """(key, rows) of raw scores: twice the place on the grid, and the label."""
    at, n = np.unique(np.rint(_on_grid(z) * GRID).astype(np.int64), return_counts=True)
    return list(zip((2 * at + label).tolist(), n.tolist()))


def _table(sums: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Raw scores in ascending order, with their positives and negatives."""
    places = sorted({k // 2 for k in sums})
    pos, neg = (np.array([sums.get(2 * k + t, (0, 0))[0] for k in places], np.int64) for t in (1, 0))
    return np.array(places, float) / GRID, pos, neg


def _calibrate(net: Network, z: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> None:
    net.scale = _platt(z, pos, neg)
    s = net.probability(z)
    hits, passed = pos[::-1].cumsum()[::-1], (pos + neg)[::-1].cumsum()[::-1]      # at or above each score
    # Halfway between the highest threshold that keeps the recall and the lowest, from 0.5 up, that is as precise.
    top = int(np.flatnonzero(hits >= int(np.ceil(RECALL * hits[0])))[-1])
    precise = hits * passed[top] >= hits[top] * passed
    half = int(np.searchsorted(s, 0.5))
    if half <= top and precise[half]:
        lowest = 0.5
    else:
        lowest = min(s[i] for i in range(top + 1) if i == top or (s[i] > 0.5 and precise[i]))
    net.threshold = float((s[top] + lowest) / 2)
    at = int(np.searchsorted(s, net.threshold))
    net.recall, net.precision = float(hits[at] / hits[0]), float(hits[at] / passed[at])


def _platt(z: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> tuple[float, float]:
    """Slope and shift that make 1 / (1 + exp(-(a z + b))) a probability, with smoothed targets."""
    n = pos + neg
    goal = pos * (pos.sum() + 1) / (pos.sum() + 2) + neg / (neg.sum() + 2)
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -50, 50)))
        w = n * (p * (1 - p) + 1e-6)
        g = np.array([((n * p - goal) * z).sum(), (n * p - goal).sum()])
        h = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
        da, db = np.linalg.solve(h, g)
        a, b = a - np.clip(da, -1, 1), b - np.clip(db, -1, 1)
    return float(max(a, 1e-3)), float(b)


def labelled(docs: DataFrame) -> DataFrame:
    """Windows of all findings: label 1 for values of the base rules, 0 for other candidates."""
    def make():
        def run(rows: dict) -> dict:
            out: dict = {"win": [], "label": []}
            for text in rows["text"]:
                if text:
                    base = base_spans(text)
                    for label, spans in ((1, [(v, e) for _, e, _, v in base]), (0, candidates(text, base))):
                        found = [w for a, b in spans for w in surroundings(text, a, b)]
                        out["win"] += found
                        out["label"] += [label] * len(found)
            return out
        return run

    return map_batches(docs.select("text"), make, "win string, label int")


def train(docs: DataFrame) -> Network:
    """Fit on every distinct finding of the documents."""
    spark = docs.sparkSession
    seen = written(labelled(docs).distinct(), "findings")
    n = {r["label"]: r["n"] for r in seen.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = max(1, sum(n.values()) // PART)
    dealt = written(seen.groupBy(F.pmod(F.xxhash64("win"), F.lit(parts)).alias("part"))
                    .agg(F.array_sort(F.collect_list(F.struct("win", "label"))).alias("found"))
                    .repartition(min(parts, shuffle_parts(spark)), "part"), "findings-dealt")

    def run(fn) -> dict:
        def make():
            def each(rows: dict) -> dict:
                pairs = [p for part, found in zip(rows["part"], rows["found"]) for p in fn(part, [(f["win"], f["label"]) for f in found])]
                return {"k": [k for k, _ in pairs], "v": [v for _, v in pairs]}
            return each
        sums = map_batches(dealt, make, "k long, v long").groupBy("k").agg(F.sum("v").alias("v"), F.count(F.lit(1)).alias("n"))
        return {r["k"]: (r["v"], r["n"]) for r in sums.collect()}

    return _fit(run, parts, n.get(1, 0), n.get(0, 0))


def spans_of(texts: list[str | None], net: Network) -> list[list[tuple[int, int, int]]]:
    """All spans (start, end, kind) of each text, in order."""
    out, asked, where = [], [], []
    for i, text in enumerate(texts):
        base = base_spans(text) if text else []
        out.append([x[:3] for x in base])
        if text and net.threshold <= 1:
            for a, b in candidates(text, base):
                pieces = surroundings(text, a, b)
                asked += pieces
                where += [(i, a, b)] * len(pieces)
    passed = {w for w, s in zip(where, net.score(asked)) if s >= net.threshold}
    for i, a, b in sorted(passed):
        out[i].append((a, b, 3))
    return [sorted(x, key=lambda y: (y[0], y[2])) for x in out]


def _text_of(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def scan(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_cnn, base_sha256, spans for every row."""
    net = net or train(docs)

    def make():
        def run(rows: dict) -> dict:
            out: dict = {"doc_id": rows["doc_id"], "n_assign": [], "n_access": [], "n_hex": [], "n_cnn": [], "base_sha256": [], "spans": []}
            for spans in spans_of(rows["text"], net):
                for k, name in enumerate(KINDS):
                    out[f"n_{name}"].append(sum(x[2] == k for x in spans))
                out["base_sha256"].append(hashlib.sha256(_text_of([x for x in spans if x[2] < 3]).encode()).hexdigest())
                out["spans"].append(_text_of(spans))
            return out
        return run

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make,
                       "doc_id long, n_assign long, n_access long, n_hex long, n_cnn long, base_sha256 string, spans string")


def redacted_text(text: str, spans) -> str:
    """The text with every run of overlapping spans replaced by MARK."""
    out, at = [], 0
    for a, b, _ in spans:
        if a >= at:
            out += [text[at:a], MARK]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """The documents with their findings replaced; all rows and columns."""
    net = net or train(docs)
    names = docs.columns

    def make():
        def run(rows: dict) -> dict:
            texts = [redacted_text(t, s) if s else t for t, s in zip(rows["text"], spans_of(rows["text"], net))]
            return {n: rows[n] for n in names} | {"text": texts} | ({"n_chars": [None if t is None else len(t) for t in texts]} if "n_chars" in names else {})
        return run

    return map_batches(docs, make, docs.schema)
