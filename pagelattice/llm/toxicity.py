"""Toxicity by non-negative positive-unlabelled learning of a linear model on hashed words."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelattice.llm.common import map_arrow

DIM = 1 << 18
THRESHOLD = 0.3
#: Bounds of the fitting sample: rows of `labels`, about so many of each kind.
POSITIVES = 3000
UNLABELLED = 6000
#: A slot is kept if toxic texts have it more often than unlabelled ones by so many standard errors.
SIGNIFICANT = 5.0
_WORD = re.compile(r"[^\W\d_]+")


class Features:
    """Distinct feature slots of a whole text: its words, and their prefixes of 3 to 6 letters,
    which hold for inflected and compound forms. keep: a mask of the slots that count."""

    def __init__(self, keep: np.ndarray | None = None):
        self.keep, self.known = keep, {}

    def slots(self, word: str) -> tuple[int, ...]:
        forms = {"=" + word} | {word[:k] for k in range(3, 7) if len(word) >= k}
        found = {xxhash.xxh32_intdigest(f) % DIM for f in forms}
        found = tuple(found if self.keep is None else (s for s in found if self.keep[s]))
        if len(self.known) > 300_000:
            self.known.clear()
        self.known[word] = found
        return found

    def __call__(self, text: str | None) -> np.ndarray:
        known, out = self.known, set()
        for w in set(_WORD.findall((text or "").lower())):
            s = known.get(w)
            out.update(self.slots(w) if s is None else s)
        return np.array(sorted(out), np.int32)


def fit_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, epochs: int = 20, batch: int = 512, rate: float = 0.05, l2: float = 1e-5, seed: int = 7) -> dict:
    """Adam on the non-negative PU risk  pi R_p(+) + max(0, R_u(-) - pi R_p(-))  with the logistic loss.

    pi is the class prior. Where the estimate of the negative part falls below zero, the step
    goes against that part alone (Kiryo et al., 2017). A text's margin is the sum of its kept
    slots' weights over the root of their number. Without positives or unlabelled texts the model
    gives everything a score near 0.
    """
    rng = np.random.default_rng(seed)
    w, b, keep = np.zeros(DIM), -2.0, np.zeros(DIM, bool)
    if not positive or not unlabelled or prior <= 0:
        return {"w": w.astype(np.float32), "b": -20.0, "keep": keep}
    cp, cu = (np.bincount(np.concatenate(rows), minlength=DIM) for rows in (positive, unlabelled))
    n_p, n_u = len(positive), len(unlabelled)
    pooled = (cp + cu) / (n_p + n_u)
    error = np.sqrt(np.maximum(pooled * (1 - pooled), 1e-12) * (1 / n_p + 1 / n_u))
    keep = (cp >= 3) & ((cp / n_p - cu / n_u) > SIGNIFICANT * error)
    p_rows, u_rows = ([r[keep[r]] for r in rows] for rows in (positive, unlabelled))
    m, v, bm, bv, t = np.zeros(DIM), np.zeros(DIM), 0.0, 0.0, 0

    def margins(rows):
        sizes = np.array([len(r) for r in rows])
        each, slots = np.repeat(np.arange(len(rows)), sizes), np.concatenate(rows)
        x = (1 / np.sqrt(np.maximum(sizes, 1)))[each]
        return np.bincount(each, w[slots] * x, len(rows)) + b, slots, each, x

    sigmoid, softplus = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40))), lambda z: np.logaddexp(0, z)
    for _ in range(epochs):
        p_order, u_order = rng.permutation(n_p), rng.permutation(n_u)
        for k in range(max(1, n_u // batch)):
            ps = [p_rows[i] for i in np.roll(p_order, -k * batch // 4)[: batch // 2]]
            us = [u_rows[i] for i in u_order[k * batch : (k + 1) * batch]]
            zp, ip, ep, xp = margins(ps)
            zu, iu, eu, xu = margins(us)
            if softplus(zu).mean() - prior * softplus(zp).mean() >= 0:
                dp, du = np.full(len(ps), -prior / len(ps)), sigmoid(zu) / len(us)
            else:
                dp, du = prior * sigmoid(zp) / len(ps), -sigmoid(zu) / len(us)
            g = np.bincount(ip, xp * dp[ep], DIM) + np.bincount(iu, xu * du[eu], DIM) + l2 * w
            gb, t = dp.sum() + du.sum(), t + 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            bm, bv = 0.9 * bm + 0.1 * gb, 0.999 * bv + 0.001 * gb * gb
            w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            b -= rate * (bm / (1 - 0.9**t)) / (np.sqrt(bv / (1 - 0.999**t)) + 1e-8)
    return {"w": (w * keep).astype(np.float32), "b": float(b), "keep": keep}


def predict(model: dict, rows: list[np.ndarray]) -> np.ndarray:
    """rows: kept slots of each text."""
    z = np.array([model["w"][r].sum(dtype=np.float64) / np.sqrt(max(len(r), 1)) + model["b"] for r in rows], np.float64)
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _held_out(col: str = "doc_id"):
    return F.crc32(F.col(col).cast("string").cast("binary")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> dict:
    """Fits on rows of labels outside the held-out fold: confirmed toxic texts as positives and, as
    unlabelled texts, a sample of all of them whatever their label. The class prior is the share of
    toxic rows among these labels. Both samples are hash samples with the given expected bounds, so
    reruns agree; the rows of `labels` beyond them are counted in the prior. Labels that are null or have a
    null id count nowhere, repeated rows each count, and without toxic rows nothing is predicted toxic.
    """
    known = labels.where("doc_id is not null and toxic is not null").where(~_held_out()).select("doc_id", "toxic")
    n, toxic = known.agg(F.count("*"), F.count_if(F.col("toxic") == 1)).first()
    draw = F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << 30))
    share = lambda most, of: F.lit(int((1 << 30) * min(1.0, most / max(of, 1))))
    as_positive, as_any = (F.col("toxic") == 1) & (draw < share(positives, toxic)), F.pmod(F.xxhash64("doc_id", F.lit("any")), F.lit(1 << 30)) < share(unlabelled, n)
    chosen = known.withColumns({"p": as_positive, "u": as_any}).where("p or u").select("doc_id", "p", "u")
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most about positives + unlabelled ids

    def run(batches):
        features = Features()
        for b in batches:
            rows = [features(t) for t in b.column(b.schema.get_field_index("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("doc_id")), b.column(b.schema.get_field_index("p")), b.column(b.schema.get_field_index("u")), pa.array([r.tobytes() for r in rows], pa.binary())], names=["doc_id", "p", "u", "f"])

    got = map_arrow(texts, run, "doc_id long, p boolean, u boolean, f binary").toArrow()
    got = sorted(zip(*(got.column(c).to_pylist() for c in ("doc_id", "p", "u", "f")), strict=True))
    row = lambda f: np.frombuffer(f, np.int32)
    return fit_nnpu([row(f) for _, p, _, f in got if p], [row(f) for _, _, u, f in got if u], toxic / max(n, 1))


def score(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """Adds score (0 to 1) and predicted (score >= threshold) to every row of docs, over whole texts.

    Null and empty texts get the score of a text without features. Input columns named score or
    predicted are replaced; all others pass through. The model has a fixed size and is broadcast.
    """
    keep = [f for f in docs.schema.fields if f.name not in ("score", "predicted")]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep) + (", " if keep else "") + "score double, predicted int"

    def run(batches):
        features = Features(shared.value["keep"])
        for b in batches:
            s = predict(shared.value, [features(t) for t in b.column(b.schema.get_field_index("text")).to_pylist()])
            arrays = [b.column(b.schema.get_field_index(f.name)) for f in keep] + [pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in keep] + ["score", "predicted"])

    return map_arrow(docs.select(*[f.name for f in keep]), run, schema)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    """All documents: doc_id, held_out (false for a null id), score, predicted; nulls as in score()."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", F.coalesce(_held_out(), F.lit(False)).alias("held_out"), "score", "predicted")
