"""Secret scan: base patterns, and a character convolutional network over every candidate with its context.

A candidate is a maximal run of ``[A-Za-z0-9+/_=.~-]`` of 16 or more characters with a letter and a digit. The network
(numpy) reads the candidate and the bytes around it: an embedding of bytes and an inside flag, one convolution, maximum
and mean pooling, one output. Candidates beyond a window's length are read in overlapping windows and take the highest
score. It is trained on labelled findings that ``labelled_findings`` makes from a seed; the threshold is the highest one
that still finds ``recall`` of the true findings of one held-back part, and the scores are calibrated on another.
Windows are scored in blocks of ``BLOCK``, so a long text takes no more memory than its bytes.
Findings that touch a base span are not added again.

Defined cases: a null text counts as empty and has no span. Repeated rows are each scanned; a null doc_id stays null.
Offsets are code points, end exclusive. Columns beyond doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Slice, column, slices

# The base patterns and the least lengths of their matches.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_=.-]+)""", re.IGNORECASE)
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
KINDS = ("assign", "access", "hex", "model")

_BYTES = np.arange(256)
_HEX = np.isin(_BYTES, list(b"0123456789abcdef"))
_DIGIT = np.isin(_BYTES, list(b"0123456789"))
_LETTER = ((_BYTES | 32) >= 97) & ((_BYTES | 32) <= 122) & (_BYTES < 128)
_RUN = _DIGIT | _LETTER | np.isin(_BYTES, list(b"+/_=.~-"))

LEFT, RIGHT, WINDOW, STEP, BLOCK = 24, 8, 96, 64, 512
EMBED, WIDTH, FILTERS = 8, 5, 24


def runs(s: Slice, mask: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of masked bytes within a text: start, end, text."""
    starts, ends, _ = s._runs(mask[s.flat])
    ok = ends - starts >= least
    starts, ends = starts[ok], ends[ok]
    return starts, ends, np.searchsorted(s.off, starts, "right") - 1


def base_spans(s: Slice) -> dict[int, list[tuple[int, int, int]]]:
    """Per text of a slice: (start, kind, end) of the base findings, in bytes of the slice."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    data = s.flat.tobytes()
    low = data.lower()

    def texts(words: tuple[bytes, ...], of: bytes) -> set[int]:
        at = []
        for w in words:
            i = of.find(w)
            while i >= 0:
                at.append(i)
                i = of.find(w, i + 1)
        return set((np.searchsorted(s.off, np.array(at, np.int64), "right") - 1).tolist())

    for kind, pattern, words, of in ((0, ASSIGN, KEYWORDS, low), (1, ACCESS, (b"AKIA",), data)):
        for d in texts(words, of):
            begin = int(s.off[d])
            for m in pattern.finditer(data[begin : int(s.off[d + 1])]):
                if len(m[2]) >= ASSIGN_LEAST if kind == 0 else len(m[0]) >= ACCESS_LEAST:
                    out.setdefault(d, []).append((begin + m.start(), kind, begin + m.end()))
    for a, b, d in zip(*(x.tolist() for x in runs(s, _HEX, HEX_LEAST))):
        out.setdefault(d, []).append((a, 2, b))
    return out


def candidates(s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, doc = runs(s, _RUN, 16)
    cum = lambda m: np.concatenate([[0], np.cumsum(m[s.flat])])
    d, a = cum(_DIGIT), cum(_LETTER)
    ok = (d[ends] > d[starts]) & (a[ends] > a[starts])
    return starts[ok], ends[ok], doc[ok]


def windows(flat: np.ndarray, lo: np.ndarray, hi: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes, inside flags and candidate number of the windows of candidates start:end in texts lo:hi, by blocks of BLOCK windows."""
    a, b = np.maximum(lo, start - LEFT), np.minimum(hi, end + RIGHT)
    n = np.maximum(1, -(-(b - a - WINDOW) // STEP) + 1)
    done = np.cumsum(n)
    for first in range(0, int(done[-1]) if len(done) else 0, BLOCK):
        at = np.arange(first, min(first + BLOCK, int(done[-1])))
        of = np.searchsorted(done, at, "right")
        begin = a[of] + (at - (done - n)[of]) * STEP
        i = begin[:, None] + np.arange(WINDOW)
        real = i < b[of][:, None]
        x = np.where(real, np.minimum(flat[np.minimum(i, len(flat) - 1)], 127), 128)
        yield x, (real & (i >= start[of][:, None]) & (i < end[of][:, None])).astype(float), of


@dataclass
class Network:
    embed: np.ndarray  # 129 x EMBED
    conv: np.ndarray  # WIDTH * (EMBED + 1) x FILTERS
    bias: np.ndarray
    out: np.ndarray  # 2 * FILTERS
    shift: float = 0.0
    scale: tuple[float, float] = (1.0, 0.0)
    threshold: float = 0.5

    def forward(self, x: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, ...]:
        e = np.concatenate([self.embed[x], m[:, :, None]], axis=2)
        n = x.shape[1] - WIDTH + 1
        cols = np.concatenate([e[:, i : i + n] for i in range(WIDTH)], axis=2)
        a = np.maximum(cols @ self.conv + self.bias, 0)
        inside = m[:, WIDTH // 2 : WIDTH // 2 + n, None]
        mean = (a * inside).sum(axis=1) / np.maximum(inside.sum(axis=1), 1)
        top = a.argmax(axis=1)
        best = np.take_along_axis(a, top[:, None, :], axis=1)[:, 0]
        z = np.concatenate([best, mean], axis=1)
        return z @ self.out + self.shift, z, a, top, inside, cols

    def score(self, x: np.ndarray, m: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        logit = np.concatenate([self.forward(x[i : i + BLOCK], m[i : i + BLOCK])[0] for i in range(0, len(x), BLOCK)])
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * logit + self.scale[1], -30, 30)))


def scores(net: Network, flat: np.ndarray, lo: np.ndarray, hi: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The highest score of each candidate's windows; one block of windows is held at a time."""
    out = np.zeros(len(start))
    for x, m, of in windows(flat, lo, hi, start, end):
        np.maximum.at(out, of, net.score(x, m))
    return out


def labelled_findings(n: int, seed: int) -> list[tuple[str, str, str, int]]:
    """Left context, candidate, right context and label: generated secrets of many formats, and things like them."""
    r = np.random.default_rng(seed)
    pick = lambda items: items[int(r.integers(len(items)))]
    chars = lambda alphabet, lo, hi: "".join(alphabet[i] for i in r.integers(len(alphabet), size=int(r.integers(lo, hi))))
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    b62 = lower + upper + digits
    parts = [pick("bcdfghklmnprstvw") + pick("aeiou") + pick(["", "n", "r", "s", "t"]) for _ in range(120)]
    word = lambda: "".join(pick(parts) for _ in range(int(r.integers(1, 4))))
    prose = lambda: " ".join(word() for _ in range(int(r.integers(2, 6))))
    names = ["key", "auth", "bearer", "credential", "access", "client", "private", "signing", "session"]
    out = []
    for i in range(n):
        left, right = prose() + " ", " " + prose()
        if i % 2 == 0:
            kind = int(r.integers(7))
            value = (
                chars(b62, 24, 64),
                chars("0123456789abcdef", 32, 65),
                chars(b62 + "+/", 32, 64) + pick(["", "=", "=="]),
                pick(["ghp_", "sk_live_", "xoxb-", "glpat-", "npm_", "rk_test_"]) + chars(b62, 20, 40),
                ".".join(["eyJ" + chars(b62, 12, 24), chars(b62 + "_-", 20, 40), chars(b62 + "_-", 20, 40)]),
                chars(upper + digits, 20, 32),
                chars(b62 + "_-", 22, 48),
            )[kind]
            if r.random() < 0.7:
                left += pick(names) + pick([" = ", ": ", "=", " is ", ' = "', ":'"])
                right = pick(['"', "'", "", ";"]) + right
        else:
            kind = int(r.integers(10))
            value = (
                word() + "." + word() + str(int(r.integers(100))) + ".example." + pick(["com", "org", "net"]),
                "/" + "/".join(word() for _ in range(4)) + str(int(r.integers(1000))) + pick([".html", ".txt", ".png", ""]),
                "_".join(word() for _ in range(3)) + "_" + str(int(r.integers(10, 99))),
                "-".join(word() for _ in range(4)) + "-" + str(int(r.integers(2000, 2030))),
                f"{r.integers(1990, 2030)}-{r.integers(1, 12):02d}-{r.integers(1, 28):02d}T{r.integers(24):02d}",
                "".join(word() for _ in range(5)) + str(int(r.integers(100))) + pick([".", "", "..."]),
                "utm_source=" + word() + "/" + word() + str(int(r.integers(1000))),
                "v" + ".".join(str(int(x)) for x in r.integers(0, 40, 4)) + "-" + word() + "-release",
                word().upper() + "-" + word().upper() + "-" + str(int(r.integers(10_000))) + "-" + word().upper(),
                "=" * int(r.integers(3, 20)) + word() + "=" * 10 + str(int(r.integers(10))),
            )[kind]
            if r.random() < 0.3:
                left += pick(["http://", "see ", "file ", "page ", "from ", "id "])
        out.append((left, value, right, int(i % 2 == 0)))
    return out


def train(n: int = 3000, recall: float = 0.98, seed: int = 17, epochs: int = 8) -> Network:
    rows = labelled_findings(n, seed)
    xs, ms, ys = [], [], []
    for left, value, right, y in rows:
        flat = np.frombuffer((left + value + right).encode(), np.uint8)
        x, m, _ = next(windows(flat, *(np.array([v]) for v in (0, len(flat), len(left), len(left) + len(value)))))
        xs.append(x[0]), ms.append(m[0]), ys.append(y)
    x, m, y = np.array(xs), np.array(ms), np.array(ys, float)
    held, last = np.arange(n) % 5 == 3, np.arange(n) % 5 == 4  # one part calibrates, the other sets the threshold
    r = np.random.default_rng(seed + 1)
    net = Network(r.normal(0, 0.5, (129, EMBED)), r.normal(0, 0.2, (WIDTH * (EMBED + 1), FILTERS)), np.zeros(FILTERS), r.normal(0, 0.2, 2 * FILTERS))
    params = ["embed", "conv", "bias", "out", "shift"]
    mom = {p: [np.zeros_like(np.asarray(getattr(net, p), float)) for _ in range(2)] for p in params}
    step = 0
    fit = np.flatnonzero(~held & ~last)
    for _ in range(epochs):
        r.shuffle(fit)
        for i in range(0, len(fit), 64):
            b = fit[i : i + 64]
            logit, z, a, top, inside, cols = net.forward(x[b], m[b])
            g = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y[b]) / len(b)
            gz = g[:, None] * net.out[None, :]
            ga = inside / np.maximum(inside.sum(axis=1, keepdims=True), 1) * gz[:, None, FILTERS:]
            put = np.zeros_like(a)
            np.put_along_axis(put, top[:, None, :], gz[:, None, :FILTERS], axis=1)
            ga = (ga + put) * (a > 0)
            gcols = ga @ net.conv.T
            gembed = np.zeros_like(net.embed)
            width = a.shape[1]
            for j in range(WIDTH):
                np.add.at(gembed, x[b][:, j : j + width], gcols[:, :, j * (EMBED + 1) : j * (EMBED + 1) + EMBED])
            grads = {"embed": gembed, "conv": cols.reshape(-1, cols.shape[2]).T @ ga.reshape(-1, FILTERS), "bias": ga.sum(axis=(0, 1)), "out": z.T @ g, "shift": g.sum()}
            step += 1
            for p in params:
                m1, m2 = mom[p]
                m1 *= 0.9
                m1 += 0.1 * grads[p]
                m2 *= 0.999
                m2 += 0.001 * grads[p] ** 2
                setattr(net, p, getattr(net, p) - 0.01 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8))
    logit = net.forward(x[held], m[held])[0]
    a, c = 1.0, 0.0
    for _ in range(200):  # Platt scaling on the held-back part
        p = 1 / (1 + np.exp(-np.clip(a * logit + c, -30, 30)))
        a, c = a - 0.05 * np.mean((p - y[held]) * logit), c - 0.05 * np.mean(p - y[held])
    net.scale = (max(float(a), 0.05), float(c))
    found = np.sort(net.score(x[last], m[last])[y[last] == 1])
    net.threshold = float(found[int((1 - recall) * len(found))])
    return net


def scan(docs: DataFrame, findings: int = 3000, recall: float = 0.98, seed: int = 17) -> DataFrame:
    """Per row of docs (doc_id, text): spans array<struct<kind, start, end, score, base>>, by start and then kind."""
    shared = docs.sparkSession.sparkContext.broadcast(train(findings, recall, seed))
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("base", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for b in batches:
            out: list[list[dict]] = [[] for _ in range(b.num_rows)]
            for s in slices(column(b, "text")):
                base = base_spans(s)
                starts, ends, doc = candidates(s)
                score = scores(net, s.flat, s.off[doc], s.off[doc + 1], starts, ends)
                cp = s.code_points()
                for d, found in base.items():
                    out[s.first + d] += [(a, k, e, 1.0, True) for a, k, e in found]
                for k in np.flatnonzero(score >= net.threshold).tolist():
                    a, e, d = int(starts[k]), int(ends[k]), int(doc[k])
                    if not any(a < y and x < e for x, _, y in base.get(d, ())):
                        out[s.first + d].append((a, 3, e, float(score[k]), False))
                for d in {*base, *doc.tolist()}:
                    at = int(cp[s.off[d]])
                    out[s.first + d] = [{"kind": KINDS[k], "start": int(cp[a]) - at, "end": int(cp[e]) - at, "score": p, "base": q} for a, k, e, p, q in sorted(out[s.first + d])]
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), pa.array(out, pa.list_(item))], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:bigint,end:bigint,score:double,base:boolean>>")


def digest(found: DataFrame) -> DataFrame:
    """Counts, the digest of the base spans, and all spans as a string."""
    text = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    base = F.filter("spans", lambda x: x["base"])
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(text(base), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
        count("model").alias("n_model"),
    )
