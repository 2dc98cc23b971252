"""Quality: two zstandard dictionaries, built from good and from bad labelled text, and their compressed sizes.

A text's compressed size with either dictionary is the sum over all its pieces of ``SCORED`` bytes, so that a long text
can't become its own dictionary. The difference of the two sizes,
normalised by the larger, says which kind of text explains it better. The score is a logistic fit of this difference,
saturated at two scales and weighted by the text's log length; every term is 0 where the difference is, so length or
compressibility alone don't score. It is calibrated on labelled texts that built neither
dictionary. What goes to the workers is two dictionaries of at most ``DICT_BYTES`` each and
a dozen numbers.

Training uses a bounded sample (``MAX_TRAIN`` documents of either class, at most
``MAX_TRAIN_BYTES`` of text; two thirds for the dictionaries, the rest for calibration);
scoring covers every row and whole texts. Nothing but the text is an input of a score.

Defined results: a null or empty text has no difference, so its score is the fit's at 0; with labels of one
class alone, or none, every score is the smoothed share of class 1; a class of one or two texts calibrates on what built
its dictionary; fewer than 16 pieces of ``PIECE`` bytes, or pieces that zstandard can't train on, are a raw dictionary as they stand (at most
their last ``DICT_BYTES``); repeated rows are scored each; extra columns are ignored; null labels aren't used.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from .runtime import plain
from .toxicity import sample

DICT_BYTES = 112_640
LEVEL = 3
PIECE = 2048
SCORED = 128
FEATURES = 6
MAX_TRAIN = 2000
MAX_TRAIN_BYTES = 16 << 20
RIDGE = 1e-3


class Model:
    """Dictionaries (bytes, None if there is no such text), mean and spread of the features, weights."""

    def __init__(self, dicts: list[bytes | None], mean, spread, weights):
        self.dicts, self.mean, self.spread, self.weights = dicts, mean, spread, weights

    def compressors(self):
        import zstandard

        out = []
        for raw in self.dicts:
            if raw is None:
                out.append(zstandard.ZstdCompressor(level=LEVEL))
                continue
            d = zstandard.ZstdCompressionDict(raw)
            d.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d))
        return out

    def score(self, sizes: np.ndarray) -> np.ndarray:
        z = (expand(sizes) - self.mean) / self.spread
        return 1 / (1 + np.exp(-np.clip(np.column_stack([np.ones(len(z)), z]) @ self.weights, -500, 500)))


def sizes(texts, compressors) -> np.ndarray:
    """(bytes, size with the bad dictionary, with the good one) of each text; sizes are summed over pieces."""
    bad, good = (c.compress for c in compressors)
    out = []
    for t in texts:
        pieces = [t[i : i + SCORED] for i in range(0, len(t), SCORED)]
        out.append((len(t), sum(len(bad(x)) for x in pieces), sum(len(good(x)) for x in pieces)))
    return np.array(out, np.float64).reshape(-1, 3)


def expand(s: np.ndarray) -> np.ndarray:
    """The features: the normalised difference, saturated at two scales, and each times the log length."""
    n, bad, good = s.T
    d = (bad - good) / np.maximum(1, np.maximum(bad, good))
    x = np.column_stack([d, np.tanh(8 * d), np.tanh(30 * d)])
    return np.column_stack([x, x * (np.log(n + 16) / 8)[:, None]])


def _dictionary(texts: list[bytes]) -> bytes | None:
    import zstandard

    parts = [t[i : i + PIECE] for t in texts for i in range(0, len(t), PIECE)]
    total = sum(map(len, parts))
    if not total:
        return None
    if len(parts) >= 16:
        try:
            return zstandard.train_dictionary(min(DICT_BYTES, max(1024, total // 4)), parts, level=LEVEL).as_bytes()
        except zstandard.ZstdError:
            pass  # too little or too uniform to train on: the text itself serves as a raw dictionary
    return b"".join(parts)[-DICT_BYTES:]


def train(texts: list[str], labels: list[int]) -> Model:
    y = np.asarray(labels, np.int64)
    raw = [t.encode() for t in texts]
    flat = np.zeros(FEATURES), np.ones(FEATURES)
    if not len(y) or y.min() == y.max():
        p = (y.sum() + 0.5) / (len(y) + 1)
        return Model([None, None], *flat, np.array([np.log(p / (1 - p))] + [0.0] * FEATURES))
    order = {k: [i for i in range(len(y)) if y[i] == k] for k in (0, 1)}
    build = {k: [i for j, i in enumerate(v) if j % 3 or len(v) < 3] for k, v in order.items()}
    held = [i for k, v in order.items() for j, i in enumerate(v) if j % 3 == 0]
    model = Model([_dictionary([raw[i] for i in build[k]]) for k in (0, 1)], *flat, None)
    x = expand(sizes([raw[i] for i in held], model.compressors()))
    model.mean, model.spread = x.mean(0), x.std(0) + 1e-6
    x = np.column_stack([np.ones(len(x)), (x - model.mean) / model.spread])
    w, t = np.zeros(x.shape[1]), y[held].astype(float)
    weight = np.ones(len(held))
    for _ in range(30):  # Newton's steps
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + RIDGE * len(held) * np.diag([1e-6] + [1.0] * (x.shape[1] - 1))
        w += np.linalg.solve(h, x.T @ (weight * (t - p)) - RIDGE * len(held) * np.r_[0, w[1:]])
    model.weights = w
    return model


def shift(model: Model, share: float, prior: float) -> Model:
    """Moves the intercept from the sample's share of class 1 to the labels' share."""
    if 0 < share < 1 and 0 < prior < 1:
        model.weights[0] += np.log(prior / (1 - prior)) - np.log(share / (1 - share))
    return model


def fit(docs: DataFrame, labels: DataFrame, held_out=None) -> Model:
    """Learns ``labels.quality`` from the rows of which ``held_out`` isn't true; class shares are counted over all of these."""
    if held_out is not None:
        labels = labels.where(~held_out)
    texts, y = sample(docs, labels, "quality", MAX_TRAIN, MAX_TRAIN_BYTES)
    n = {r[0]: r[1] for r in labels.groupBy("quality").count().collect()}
    model = train(texts, y)
    if len(set(y)) == 2:
        shift(model, sum(y) / len(y), n.get(1, 0) / max(1, n.get(0, 0) + n.get(1, 0)))
    return model


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: doc_id; one named score is replaced) and score, the probability of class 1."""
    docs, back = plain(docs, ["text"], ["score"], keep or ["doc_id"])
    own = [c for c in docs.columns if c != "text" or "text" in (keep or ())]
    read = own if "text" in own else [*own, "text"]
    at = read.index("text")

    def run(batches):
        compressors = model.compressors()
        for b in batches:
            texts = ((t.as_py() or b"") for t in b.column(at).cast(pa.large_binary()))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(own)], pa.array(model.score(sizes(texts, compressors)))], names=[*own, "score"])

    return back(docs.select(*read).mapInArrow(run, T.StructType([*[docs.schema[c] for c in own], T.StructField("score", T.DoubleType())])))
