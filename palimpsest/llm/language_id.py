"""Language identification with a bidirectional gated recurrent network over bytes.

The network reads the bytes of a text (A-Z in lower case, nothing left out) in both directions and labels every position
with a language distribution; a document's distribution is the mean over all positions of its whole text. Texts are read
in windows of at most CORE positions, each with MARGIN bytes of the text before and after it, so that the states are
carried over word borders and a window's edge has the same context as its middle, up to MARGIN bytes; every position is
labelled in exactly one window. The network is trained in numpy by backpropagation through time on windows drawn from
whole texts of a bounded sample of labelled documents.

Defined results: `und` with score 0 for null texts and texts without a letter; without any labelled document every text is
`und`; repeated rows are labelled each; a null identifier is predicted like any other and never learnt from; ties go to
the language that sorts first; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import is_fold, materialize, rows_of, tune

#: The training sample: documents per language (about), and windows per language drawn from all of their windows.
DOCUMENTS, WINDOWS = 150, 4000
#: Positions that a window labels, and bytes that it reads on either side of them.
CORE, MARGIN = 224, 24
#: Positions of a training window.
TRAINED = 64
#: Windows that are read at once.
ROWS = 1024
UNKNOWN = "und"

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def has_letter(text: bytes) -> bool:
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


def _tanh_gates(a: np.ndarray) -> np.ndarray:
    """The logistic function of twice the argument, in place."""
    np.tanh(a, out=a)
    a *= 0.5
    a += 0.5
    return a


class Network:
    """Two gated recurrent layers, one in each direction, and a softmax at every position. Arrays are (units, windows)."""

    def __init__(self, classes: int, hidden: int = 16, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.h = h = hidden
        f = lambda scale, *s: rng.normal(0, scale, s).astype(np.float32)
        self.p = {"c": np.zeros((classes, 1), np.float32)}
        for k in (0, 1):
            self.p |= {f"x{k}": f(0.3, 3 * h, 256), f"u{k}": f(h**-0.5, 3 * h, h), f"v{k}": f((2 * h) ** -0.5, classes, h)}

    def _run(self, x: np.ndarray, live: np.ndarray, k: int, keep: list | None = None) -> np.ndarray:
        """Logits' part of one direction: (positions, classes, windows). x: (positions, windows). Where no text is, the state is zero."""
        h, n = self.h, x.shape[1]
        kind = self.p["c"].dtype
        half = np.concatenate([np.full((2 * h, 1), 0.5, kind), np.ones((h, 1), kind)])
        table, u, v = self.p[f"x{k}"] * half, self.p[f"u{k}"] * half, self.p[f"v{k}"]
        s = np.zeros((h, n), kind)
        out = np.empty((len(x), len(v), n), kind)
        g, a = np.empty((3 * h, n), kind), np.empty((3 * h, n), kind)
        whole = live.all(1)
        for t in range(len(x)) if k == 0 else range(len(x) - 1, -1, -1):
            np.take(table, x[t], axis=1, out=g, mode="clip")
            np.matmul(u, s, out=a)
            g[: 2 * h] += a[: 2 * h]
            rz = _tanh_gates(g[: 2 * h])
            old = a[2 * h :].copy() if keep is not None else None
            c = a[2 * h :]
            c *= rz[:h]
            c += g[2 * h :]
            np.tanh(c, out=c)
            if keep is not None:
                keep.append((t, s.copy(), rz[:h].copy(), rz[h:].copy(), c.copy(), old))
            s -= c
            s *= rz[h:]
            s += c
            if not whole[t]:
                s *= live[t]
            np.matmul(v, s, out=out[t])
            if keep is not None:
                keep[-1] = (*keep[-1], s.copy())
        return out

    def labels(self, x: np.ndarray, live: np.ndarray, keep: tuple[list, list] | None = None) -> np.ndarray:
        """The distribution at every position: (positions, classes, windows)."""
        q = self._run(x, live, 0, keep[0] if keep else None)
        q += self._run(x, live, 1, keep[1] if keep else None)
        q += self.p["c"]
        q -= q.max(1, keepdims=True)
        np.exp(q, out=q)
        q /= q.sum(1, keepdims=True)
        return q

    def gradients(self, x: np.ndarray, live: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over the positions and its gradients, by backpropagation through time. x, live: (positions, windows)."""
        keep: tuple[list, list] = ([], [])
        q = self.labels(x, live, keep)
        n, at = live.sum(), np.arange(len(y))
        loss = -float((np.log(q[:, y, at] + 1e-9) * live).sum() / n)
        d = q
        d[:, y, at] -= 1
        d *= (live / n)[:, None, :]
        h, grads = self.h, {"c": d.sum((0, 2))[:, None]}
        for k in (0, 1):
            u, v = self.p[f"u{k}"], self.p[f"v{k}"]
            gu, gv, das = np.zeros_like(u), np.zeros_like(v), []
            back = np.zeros((h, x.shape[1]), u.dtype)
            for t, s, r, z, c, a, new in reversed(keep[k]):
                gv += d[t] @ new.T
                total = (back + v.T @ d[t]) * live[t]
                dc = total * (1 - z) * (1 - c * c)
                dz = total * (s - c) * z * (1 - z)
                dr = dc * a * r * (1 - r)
                da = np.concatenate([dr, dz, dc * r])
                gu += da @ s.T
                das.append((t, np.concatenate([dr, dz, dc])))
                back = total * z + u.T @ da
            order = np.concatenate([x[t] for t, _ in das]).astype(np.int64)
            flat = np.concatenate([g for _, g in das], axis=1)
            gx = np.stack([np.bincount(order, row, 256) for row in flat]).astype(u.dtype)
            grads |= {f"x{k}": gx, f"u{k}": gu, f"v{k}": gv}
        return loss, grads


def matrix(windows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Windows as columns of bytes, and which cells hold text."""
    width = max(map(len, windows))
    x = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in windows), np.uint8).reshape(len(windows), width)
    live = np.arange(width)[:, None] < np.array([len(w) for w in windows])
    return np.ascontiguousarray(x.T).astype(np.intp), live.astype(np.float32)


def train(windows: list[bytes], y: np.ndarray, classes: int, steps: int = 320, batch: int = 128, rate: float = 0.015) -> Network:
    net = Network(classes)
    rng = np.random.default_rng(1)
    m1 = {k: np.zeros_like(v) for k, v in net.p.items()}
    m2 = {k: np.zeros_like(v) for k, v in net.p.items()}
    by_class = [np.flatnonzero(y == k) for k in range(classes)]
    for t in range(1, steps + 1):
        pick = np.concatenate([rng.choice(own, -(-batch // classes)) for own in by_class if len(own)])
        x, live = matrix([windows[i] for i in pick])
        _, grads = net.gradients(x, live, y[pick])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        scale, lr = min(1.0, 1 / (norm + 1e-9)), rate * (1 - 0.9 * t / steps)
        for k, g in grads.items():
            g = g * scale
            m1[k] = 0.9 * m1[k] + 0.1 * g
            m2[k] = 0.99 * m2[k] + 0.01 * g * g
            net.p[k] -= (lr * (m1[k] / (1 - 0.9**t)) / (np.sqrt(m2[k] / (1 - 0.99**t)) + 1e-7)).astype(np.float32)
    return net


def pooled(net: Network, texts: list[bytes], core: int = CORE, margin: int = MARGIN, rows: int = ROWS) -> np.ndarray:
    """Mean distribution over all positions of each text; zeros for an empty one."""
    classes = len(net.p["c"])
    out = np.zeros((len(texts), classes))
    cuts = [(i, at) for i, t in enumerate(texts) for at in range(0, len(t), core)]
    size = lambda c: min(len(texts[c[0]]), c[1] + core + margin) - max(0, c[1] - margin)
    cuts.sort(key=size)  # windows of like length are read together; no result depends on its neighbours
    for k in range(0, len(cuts), rows):
        some = cuts[k : k + rows]
        x, live = matrix([texts[i][max(0, at - margin) : at + core + margin].translate(_LOWER) for i, at in some])
        lead = np.array([min(at, margin) for _, at in some])
        stop = lead + np.array([min(core, len(texts[i]) - at) for i, at in some])
        place = np.arange(len(x))[:, None]
        mine = ((place >= lead) & (place < stop)).astype(np.float32)
        q = np.einsum("tcn,tn->nc", net.labels(x, live), mine)
        np.add.at(out, [i for i, _ in some], q)
    lengths = np.array([max(1, len(t)) for t in texts], float)
    return out / lengths[:, None]


def learn(docs: DataFrame, documents: int = DOCUMENTS, windows: int = WINDOWS) -> tuple[list[str], Network | None]:
    """docs: doc_id, text, lang of the training fold, lang never null."""
    counts = {r.lang: r["count"] for r in docs.groupBy("lang").count().collect()}  # one row a language
    names = sorted(counts)
    if not names:
        return [], None
    share = F.create_map(*[F.lit(v) for n in names for v in (n, int((1 << 30) * min(1.0, documents / counts[n])))])
    chosen = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) < share[F.col("lang")])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in rows_of(batches, "text"):
            found = [(lang, i, t[at : at + TRAINED].translate(_LOWER)) for lang, i, t in zip(batch.column("lang").to_pylist(), batch.column("doc_id").to_pylist(), texts, strict=True) if has_letter(t) for at in range(0, len(t), TRAINED)]
            if found:
                c = list(zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c[0]), pa.array(c[1], pa.int64()), pa.array(c[2], pa.binary())], names=["lang", "doc_id", "part"])

    parts = materialize(chosen.select("lang", "doc_id", "text").mapInArrow(cut, "lang string, doc_id long, part binary"))
    sizes = {r.lang: r["count"] for r in parts.groupBy("lang").count().collect()}
    if not sizes:
        return [], None
    share = F.create_map(*[F.lit(v) for n, k in sizes.items() for v in (n, int((1 << 30) * min(1.0, windows / k)))])
    drawn = parts.where(F.pmod(F.xxhash64("doc_id", "part", F.lit(7)), F.lit(1 << 30)) < share[F.col("lang")])
    rows = sorted((r.lang, bytes(r.part)) for r in drawn.select("lang", "part").collect())  # about `windows` a language
    if not rows:
        return [], None
    at = {n: k for k, n in enumerate(names)}
    return names, train([p for _, p in rows], np.array([at[n] for n, _ in rows]), len(names))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; the language column is read in the training fold only."""
    tune(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    names, net = learn(base.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~is_fold("doc_id", 4, 2)))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in rows_of(batches, "text"):
            found = [(UNKNOWN, 0.0)] * len(texts)
            if net:
                found = [(names[int(p.argmax())], min(1.0, float(p.max()))) if has_letter(t) else f for p, t, f in zip(pooled(net, texts), texts, found, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([f[0] for f in found]), pa.array([f[1] for f in found])], names=["doc_id", "lang_pred", "score"])

    out = base.select("doc_id", "text").mapInArrow(predict, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", is_fold("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")
