"""Classifiers that compare how well two zstandard dictionaries compress the windows of a text.

Two dictionaries, trained by zstandard on text of either class, compress every window of a text.  The
differences of the two lengths, and nothing else (no length of the text, no length under one dictionary), go
through a logistic curve fitted on other labelled documents; that is the calibrated score.

`contrast`: each dictionary is trained on the passages of its class around words whose share of documents is
significantly larger there (z above the bound that the largest of so many chance values would reach); a
class without such words gives passages from anywhere in its text.  What counts is how far the largest
differences go and in how many windows they pass the calibrated thresholds.
`plain`: dictionaries are trained on pieces from all over the text of a class.  What counts is the
difference over all windows, normalised by the length of the text or by the sum of both lengths.

Labels are learned from a bounded sample of labelled rows: `per_class` documents of either
class in hash order, two thirds of them for the dictionaries (at most `pieces` pieces each), the rest for
the calibration.  Everything else reads whole texts.

Cases: null or empty text is one empty window and gets a score like any other; rows with a null
label or fold are not learned from; of several labels of one document the largest counts; with a class
missing, every score is the share of class 1 (0.5 without any labels); repeated rows are scored each;
other columns are left out.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, text_chunks


@dataclass(frozen=True)
class Settings:
    window: int
    level: int
    style: str  # contrast or plain
    dictionary_bytes: int
    #: Lengths of the segments and of the substrings that zstandard's trainer counts (0: its own choice).
    segment: int = 0
    substring: int = 0
    piece: int = 512
    pieces: int = 12000
    per_class: int = 4000
    #: Words before and after a telling word that belong to its passage, and passages to train on, at least.
    around: int = 1
    passages: int = 2000
    #: A window in which one dictionary saves so many bytes more passes a threshold.
    telling: tuple[int, ...] = (3, 5)
    lower: bool = False


@dataclass
class Model:
    settings: Settings
    dictionaries: tuple[bytes, bytes] = (b"", b"")
    prior: float = 0.5
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.ones(0))
    weights: np.ndarray | None = None


def _windows(text: bytes, size: int) -> list[bytes]:
    """Parts of at most `size` bytes, cut before the last blank where there is one."""
    out, a = [], 0
    while a < len(text):
        b = a + size
        if b < len(text):
            blank = text.rfind(b" ", a + 1, b)
            b = blank if blank > 0 else b
        out.append(text[a:b])
        a = b
    return out or [b""]


class Lengths:
    """Compressed lengths of windows under both dictionaries."""

    def __init__(self, model: Model) -> None:
        import zstandard as z

        self.settings, self.by = model.settings, []
        for d in model.dictionaries:
            p = z.ZstdCompressionParameters.from_level(model.settings.level, write_content_size=False, write_checksum=False, write_dict_id=False)
            #: Passages are too few for the tables of symbols that the trainer puts before them to be of use.
            raw = z.DICT_TYPE_RAWCONTENT if model.settings.style == "contrast" else z.DICT_TYPE_AUTO
            held = z.ZstdCompressionDict(d, dict_type=raw)
            held.precompute_compress(compression_params=p)
            self.by.append(z.ZstdCompressor(dict_data=held, compression_params=p).compress)

    def features(self, text: bytes) -> np.ndarray:
        s = self.settings
        if s.lower:
            text = text.lower()
        windows = _windows(text, s.window)
        one, zero = (np.fromiter((len(f(w)) for w in windows), dtype=np.float64, count=len(windows)) for f in self.by)
        gain = zero - one
        if s.style == "plain":
            rate = gain / np.maximum(zero + one, 1)
            return np.array([gain.sum() / max(len(text), 8), gain.sum() / max((zero + one).sum(), 1), rate.max(), rate.min(), rate.std()])
        top = np.sort(gain)
        return np.array([gain.sum() / max(len(text), 8), top[-1], top[-2:].sum(), top[0], *((gain >= t).sum() for t in s.telling)])


def _inputs(model: Model, x: np.ndarray) -> np.ndarray:
    u = (x - model.mean) / model.scale
    return np.hstack([np.clip(u, -6, 6), np.clip(u, -4, 4) ** 2, np.ones((len(u), 1))])


def probability(model: Model, x: np.ndarray) -> np.ndarray:
    if model.weights is None:
        return np.full(len(x), model.prior)
    return 1 / (1 + np.exp(-np.clip(_inputs(model, x) @ model.weights, -30, 30)))


def _fit(model: Model, x: np.ndarray, y: np.ndarray) -> None:
    """Logistic regression by Newton steps; class weights bring the sample back to the share of class 1.

    Where the classes are nearly apart, whole steps can run away from the least loss, so a step is halved until the loss falls.
    """
    model.mean, model.scale = x.mean(0), x.std(0) + 1e-9
    a, share = _inputs(model, x), y.mean()
    weight = np.where(y == 1, model.prior / share, (1 - model.prior) / (1 - share))

    def loss(w: np.ndarray) -> float:
        return weight @ np.logaddexp(0, np.where(y == 1, -1, 1) * (a @ w)) + 0.05 * w @ w

    w = np.zeros(a.shape[1])
    now = loss(w)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        slope = a.T @ (weight * (p - y)) + 0.1 * w
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + 0.1 * np.eye(len(w)), slope)
        fall, part = slope @ step, 1.0
        while part > 1e-9 and loss(w - part * step) > now - 1e-4 * part * fall:
            part /= 2
        if fall < 1e-10 or part <= 1e-9:
            break
        w = w - part * step
        now = loss(w)
    model.weights = w


def _words(x: bytes) -> list[bytes]:
    return [w.strip(b".,;:!?") for w in x.split()]


def _passages(s: Settings, group: list[bytes], other: list[bytes]) -> list[bytes]:
    """The telling words of a group with their neighbours.

    A word is telling if its share is larger both among the distinct pieces and among the distinct places (a word
    between two neighbours): the first passes over words that are common everywhere, the second over copies.
    """

    def places(x: bytes) -> set:
        w = [b"", *_words(x), b""]
        return set(zip(w[:-2], w[1:-1], w[2:], strict=True))

    shares = []
    for pick in (lambda g: [w for x in set(g) for w in set(_words(x))], lambda g: [w for _, w, _ in set().union(*map(places, g))]):
        own, far = Counter(pick(group)), Counter(pick(other))
        shares.append((own, far, *((len(set(g)) if not shares else c.total()) + 1 for g, c in ((group, own), (other, far)))))
    words = shares[0][0].keys()
    least = np.sqrt(2 * np.log(max(2, len(words | shares[0][1].keys()))))

    def z(w: bytes, a: Counter, b: Counter, na: int, nb: int) -> float:
        p = (a[w] + b[w] + 1) / (na + nb + 2)
        return (a[w] / na - b[w] / nb) / np.sqrt(p * (1 - p) * (1 / na + 1 / nb))

    telling = {w for w in words if all(x[0][w] >= 3 and z(w, *x) >= least for x in shares)}
    out = {}
    for x in group:
        held, ws = x.split(), [b"", *_words(x), b""]
        at = [i for i, w in enumerate(ws[1:-1]) if w in telling]
        out |= {tuple(ws[i : i + 3]): b" " + b" ".join(held[max(0, i - s.around) : i + s.around + 1]) + b" " for i in at}
    return [out[c] for c in sorted(out, key=lambda c: zlib.crc32(b" ".join(c)))]


def _trained(s: Settings, samples: list[bytes]) -> bytes:
    import zstandard as z

    distinct = Counter(samples)
    if s.style == "contrast" and sum(map(len, distinct)) <= s.dictionary_bytes:  # nothing to choose from: all, the most frequent last
        return b"".join(sorted(distinct, key=lambda x: (distinct[x], x)))
    samples = samples * -(-s.passages // len(samples))
    own = {"k": s.segment, "d": s.substring} if s.segment else {}
    try:
        return z.train_dictionary(min(s.dictionary_bytes, max(256, sum(map(len, samples)) // 8)), samples, level=s.level, **own).as_bytes()
    except z.ZstdError:  # too little text for the trainer: the text itself
        return b"".join(samples)[-s.dictionary_bytes :]


def _dictionaries(s: Settings, ones: list[bytes], zeros: list[bytes]) -> tuple[bytes, bytes]:
    if s.style == "plain":
        return _trained(s, ones).ljust(16), _trained(s, zeros).ljust(16)
    ones, zeros = ([x.lower() for x in g] if s.lower else g for g in (ones, zeros))
    #: Passages from all over ordinary text come first in both dictionaries, so that they differ by what is telling alone.
    held = [b" ".join(x.split()[i : i + 8]) for x in zeros for i in range(0, len(x.split()), 64)]
    base = _trained(s, held) if held else b""
    telling = [_trained(s, p) if p else b"" for p in (_passages(s, ones, zeros), _passages(s, zeros, ones))]
    #: Of one length, so that the same text stands at the same distance.
    return tuple(base + t.ljust(max(16, *map(len, telling))) for t in telling)


def train(docs: DataFrame, labels: DataFrame, settings: Settings) -> Model:
    """Fit on docs (doc_id, text) and the rows of labels (doc_id, y, 0 or 1) that may be learned from."""
    spark, s = docs.sparkSession, settings
    known = labels.where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("y").alias("y"))
    shares = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    model = Model(settings)
    if not shares:
        return model
    model.prior = shares.get(1, 0) / sum(shares.values())
    rows = []
    for y in (0, 1):
        ids = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.per_class).collect()
        rows += [(r["doc_id"], y, int(i % 3 == 2)) for i, r in enumerate(ids)]
    if len(shares) < 2:
        return model
    #: At most 2 * per_class rows.
    chosen = F.broadcast(spark.createDataFrame(rows, "doc_id long, y int, use int"))
    text = F.coalesce(F.col("text"), F.lit(""))
    sample = docs.select("doc_id", text.alias("text")).join(chosen, "doc_id")
    parts = sample.where("use = 0").select("doc_id", "y", F.posexplode(F.transform(F.sequence(F.lit(0), F.length("text"), F.lit(s.piece)), lambda i: F.substr("text", i + 1, F.lit(s.piece)))).alias("at", "piece"))
    groups = []
    for y in (1, 0):
        got = parts.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id", "at").limit(s.pieces).select("piece").collect()
        groups.append([r["piece"].encode() for r in got if r["piece"]])
    if not all(groups):
        return model
    model.dictionaries = _dictionaries(s, *groups)
    fitted = features(sample.where("use = 1").select("doc_id", "text", "y"), model).orderBy("doc_id").toPandas()
    if fitted["y"].nunique() == 2:
        _fit(model, np.array(fitted["x"].tolist(), dtype=float), fitted["y"].to_numpy(dtype=float))
    return model


def _nothing(_text: bytes) -> np.ndarray:
    return np.zeros(1)


def features(docs: DataFrame, model: Model) -> DataFrame:
    def run(batches):
        f = Lengths(model).features
        for batch, texts in text_chunks(batches):
            x = [f(t).tolist() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    return map_arrow(docs.select("doc_id", "text", "y"), run, "doc_id long, y int, x array<double>")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and the score of every text."""

    def run(batches):
        f = Lengths(model).features if model.weights is not None else _nothing
        for batch, texts in text_chunks(batches):
            x = np.array([f(t) for t in texts])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(probability(model, x), pa.float64())], names=["doc_id", "score"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, score double")


def keep(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The documents whose score is at least `least`; all columns stay, whatever their names."""

    def run(batches):
        f = Lengths(model).features if model.weights is not None else _nothing
        for batch, texts in text_chunks(batches):
            yield batch.filter(pa.array(probability(model, np.array([f(t) for t in texts])) >= least))

    return map_arrow(docs, run, docs.schema) if model.weights is not None else docs


TOXICITY = Settings(window=256, level=19, style="contrast", dictionary_bytes=4096, segment=16, substring=8, around=0, telling=(4, 6), lower=True)
QUALITY = Settings(window=512, level=3, style="plain", dictionary_bytes=65536)
