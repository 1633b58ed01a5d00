"""Operator 6: toxicity with a linear-chain conditional random field.

Labels are of documents, so tokens get theirs from counts: Spark counts, per token feature
(the word and its first letters), in how many toxic and in how many other training documents
it stands; features far more frequent in toxic ones mark tokens as toxic, in toxic documents
only. A two-state chain is fitted on bounded samples of token windows with these labels.
Features that mark nothing have weight 0.

Scoring is a map. A document without a marked feature has the marginals of an empty chain.
For the others forward and backward messages run over the whole token sequence, cut into
pieces of fixed length: messages through a piece are a 2 x 2 product, so pieces run side by
side and a long text needs no long loop. Marginals give the offending spans; their sum and
their largest value go through a logistic curve to the document score.

Bounds of the fit: ``SAMPLE`` training documents per class for counts, ``WINDOWS`` token
windows, ``FEATURES`` features.

Rows: null and empty texts have no token and the score of an empty chain; labels that are
null or of unknown documents are left out, repeated ones go by majority; with labels of one
class every score is 0; null doc_ids are scored like others; an empty table gives an empty
one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagetide.llm.common import (
    clean_labels, first_bytes, held_out, joined_bytes, logistic, mixed, pieces, probability, sample_labels, table, word_hashes, words_of,
)

FOLDS, HELD = 4, 2
THRESHOLD = 0.3
SAMPLE = 4000
WINDOWS = 6000
WINDOW = 64
FEATURES = 4000
#: Lengths of the word starts, in bytes below 8, that are features beside the whole word.
PREFIXES = (4, 5, 7)
MIN_DOCS = 4
MIN_RATIO = 3.0
PIECE = 64
SPAN = 0.5
_EDGE = np.zeros(256, bool)
_EDGE[[ord(c) for c in ".,;:!?()\"'"]] = True


def features_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each token (punctuation at its end left out) and its features' keys, a row per token."""
    starts, stops, rows = words_of(data, offsets)
    for _ in range(2):
        stops = stops - ((stops - starts > 1) & _EDGE[data[stops - 1]]) if len(stops) else stops
    keys = [word_hashes(data, starts, stops)]
    heads, lengths = first_bytes(data, starts), stops - starts
    for n in PREFIXES:
        bits = (np.minimum(lengths, n) * 8).astype(np.uint64)
        keys.append(mixed((heads & ((np.uint64(1) << bits) - np.uint64(1))) + np.uint64(n << 58)))
    return starts, stops, rows, np.column_stack(keys).astype(np.int64) if len(starts) else np.zeros((0, 1 + len(PREFIXES)), np.int64)


def chain_marginals(emission: np.ndarray, lengths: np.ndarray, trans: np.ndarray, start: np.ndarray) -> np.ndarray:
    """P(state 1) of every token of several sequences laid end to end.

    ``emission``: log odds of state 1 per token; ``trans``: 2 x 2 potentials; ``start``: potentials of the first state.
    """
    if not len(emission):
        return np.zeros(0)
    n_pieces = -(-lengths // PIECE)
    first = np.concatenate([[0], np.cumsum(n_pieces)[:-1]])
    at = np.arange(len(emission)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    spot = (np.repeat(first, lengths) + at // PIECE, at % PIECE)
    odds, real = np.ones((n_pieces.sum(), PIECE)), np.zeros((n_pieces.sum(), PIECE), bool)
    odds[spot] = np.exp(np.clip(emission, -30, 30))
    real[spot] = True
    # step(t): message m -> (m @ trans) * (1, odds); padding leaves messages alone.
    def product() -> np.ndarray:
        out = np.broadcast_to(np.eye(2), (len(odds), 2, 2)).copy()
        for t in range(PIECE):
            new = out @ trans
            new[:, :, 1] *= odds[:, t, None]
            new /= new.sum((1, 2), keepdims=True)
            out = np.where(real[:, t, None, None], new, out)
        return out

    through = product()
    ahead, behind = np.empty((len(odds), 2)), np.empty((len(odds), 2))
    # Messages into pieces: in step over the documents, piece by piece. The first token has no transition,
    # so its incoming message is chosen such that message @ trans is the start potential.
    entry = np.linalg.solve(trans.T, start)
    message = np.broadcast_to(entry, (len(lengths), 2)).copy()
    for k in range(int(n_pieces.max())):
        live = np.flatnonzero(n_pieces > k)
        ahead[first[live] + k] = message[live]
        new = np.einsum("ni,nij->nj", message[live], through[first[live] + k])
        message[live] = new / new.sum(1, keepdims=True)
    back = np.ones((len(lengths), 2))
    for k in range(int(n_pieces.max()) - 1, -1, -1):
        live = np.flatnonzero(n_pieces > k)
        behind[first[live] + k] = back[live]
        new = np.einsum("nij,nj->ni", through[first[live] + k], back[live])
        back[live] = new / new.sum(1, keepdims=True)
    forward = np.empty((len(odds), PIECE, 2))
    m = ahead
    for t in range(PIECE):
        new = m @ trans
        new[:, 1] *= odds[:, t]
        new /= new.sum(1, keepdims=True)
        m = np.where(real[:, t, None], new, m)
        forward[:, t] = m
    out, b = np.empty((len(odds), PIECE)), behind
    for t in range(PIECE - 1, -1, -1):
        both = forward[:, t] * b
        out[:, t] = both[:, 1] / both.sum(1)
        weighed = b.copy()
        weighed[:, 1] *= odds[:, t]
        new = weighed @ trans.T
        new /= new.sum(1, keepdims=True)
        b = np.where(real[:, t, None], new, b)
    return out[spot]


@dataclass
class Tagger:
    keys: np.ndarray  # sorted feature keys
    weights: np.ndarray  # of the keys
    bias: float
    trans: np.ndarray
    curve: np.ndarray

    def emissions(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log odds of each token and whether a feature of it is known."""
        total, known = np.full(len(keys), self.bias), np.zeros(len(keys), bool)
        if len(self.keys):
            for column in keys.T:
                at = np.minimum(np.searchsorted(self.keys, column), len(self.keys) - 1)
                hit = self.keys[at] == column
                total += np.where(hit, self.weights[at], 0.0)
                known |= hit
        return total, known

    def tag(self, column) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
        """Document features and toxic byte spans of each text."""
        data, offsets = joined_bytes(column)
        starts, stops, rows, keys = features_of(data, offsets)
        emission, known = self.emissions(keys)
        n = len(offsets) - 1
        lengths = np.bincount(rows, minlength=n)
        marked = np.bincount(rows[known], minlength=n) > 0
        inside = marked[rows]
        start = np.array([1.0, 1.0])
        p = chain_marginals(emission[inside], lengths[marked], self.trans, start)
        x, spans = self.summary(p, rows[inside], n), [[] for _ in range(n)]
        s, e, r = starts[inside], stops[inside], rows[inside]
        toxic = np.flatnonzero(p >= SPAN)
        for i in toxic.tolist():  # neighbouring toxic tokens make one span
            own, base = spans[r[i]], int(offsets[r[i]])
            if own and i > 0 and p[i - 1] >= SPAN and r[i - 1] == r[i]:
                own[-1] = (own[-1][0], int(e[i]) - base)
            else:
                own.append((int(s[i]) - base, int(e[i]) - base))
        return x, spans

    @staticmethod
    def summary(p: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
        """Largest marginal and log of 1 + the sum of marginals that matter, per document."""
        most = np.zeros(n)
        np.maximum.at(most, rows, p)
        return np.column_stack([most, np.log1p(np.bincount(rows, np.where(p >= 0.05, p, 0), minlength=n))])

    def scores(self, x: np.ndarray) -> np.ndarray:
        return probability(x, self.curve)


def fit_chain(emit: list[np.ndarray], tags: np.ndarray, n_features: int, rounds: int = 120) -> tuple[np.ndarray, float, np.ndarray]:
    """Feature weights, bias and 2 x 2 potentials that maximise the tags' likelihood over windows of one length.

    ``emit``: per feature slot the feature's number (0: none) of each token, windows x length. Gradients are
    observed minus expected counts; a small ridge keeps the weights finite.
    """
    w, bias, t = np.zeros(n_features + 1), -4.0, np.zeros((2, 2))
    speed = [np.full(n_features + 1, 1e-8), 1e-8, np.full((2, 2), 1e-8)]
    windows, length = tags.shape
    pairs = np.array([[((tags[:, :-1] == a) & (tags[:, 1:] == b)).sum() for b in (0, 1)] for a in (0, 1)], float)
    for _ in range(rounds):
        odds = np.exp(np.clip(bias + sum(w[e] for e in emit), -30, 30))
        trans = np.exp(t)
        alpha = np.empty((windows, length, 2))
        m = np.ones((windows, 2))
        for i in range(length):
            m = m @ trans if i else m
            m = np.column_stack([m[:, 0], m[:, 1] * odds[:, i]])
            m /= m.sum(1, keepdims=True)
            alpha[:, i] = m
        beta, p, expected = np.ones((windows, 2)), np.empty((windows, length)), np.zeros((2, 2))
        for i in range(length - 1, -1, -1):
            both = alpha[:, i] * beta
            p[:, i] = both[:, 1] / both.sum(1)
            out = np.column_stack([beta[:, 0], beta[:, 1] * odds[:, i]])
            if i:
                joint = alpha[:, i - 1, :, None] * trans * out[:, None, :]
                expected += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
            beta = out @ trans.T
            beta /= beta.sum(1, keepdims=True)
        gap = tags - p
        grad = sum(np.bincount(e.ravel(), gap.ravel(), minlength=n_features + 1) for e in emit) - 0.05 * w
        grad[0] = 0
        steps = (grad, gap.sum() - 0.05 * bias, pairs - expected - 0.05 * t)
        for k, g in enumerate(steps):
            speed[k] = speed[k] + g * g
        w += 0.5 * steps[0] / np.sqrt(speed[0])
        bias += 0.3 * steps[1] / np.sqrt(speed[1])
        t += 0.3 * steps[2] / np.sqrt(speed[2])
    return w, bias, np.exp(t)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE, windows: int = WINDOWS, features: int = FEATURES) -> Tagger | None:
    """Tagger from labels outside the held-out fold; None if a class has none or no labelled text has a word."""
    usable = clean_labels(labels, label).where(~held_out(F.col("doc_id"), FOLDS, HELD))
    ids = sample_labels(usable, sample, "t")  # 2 x sample rows
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in pieces(batches):
            y = np.asarray(batch.column("y"))
            _, _, row, keys = features_of(*joined_bytes(batch.column("text")))
            pair = np.unique(np.column_stack([np.tile(row, keys.shape[1]), keys.T.ravel()]), axis=0)  # once per document
            key, back = np.unique(pair[:, 1], return_inverse=True)
            toxic = np.bincount(back, y[pair[:, 0]], minlength=len(key)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(toxic), pa.array(np.bincount(back, minlength=len(key)) - toxic)], ["key", "toxic", "other"])

    sizes = {r.y: r.n for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return None
    counts = rows.select("y", "text").mapInArrow(count, "key long, toxic long, other long").groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    ratio = F.log((F.col("toxic") + 0.1) / sizes[1]) - F.log((F.col("other") + 0.1) / sizes[0])
    least = max(2, MIN_DOCS * min(1, sizes[1] // 100))
    top = counts.where((F.col("toxic") >= least) & (ratio >= MIN_RATIO)).orderBy(F.desc("toxic"), "key").limit(features).select("key").toPandas()
    keys = np.sort(top["key"].to_numpy(np.int64))

    def cut(batches: Iterator) -> Iterator:
        """Windows of feature numbers with token tags: around marked tokens, and one per other document."""
        import pyarrow as pa

        for batch in pieces(batches):
            y = np.asarray(batch.column("y"))
            _, _, row, found = features_of(*joined_bytes(batch.column("text")))
            numbers = np.zeros(found.shape, np.int32)
            for i, column in enumerate(found.T):
                at = np.minimum(np.searchsorted(keys, column), max(len(keys) - 1, 0))
                numbers[:, i] = np.where(keys[at] == column, at + 1, 0) if len(keys) else 0
            tags = ((numbers > 0).any(1) & (y[row] == 1)).astype(np.int32)
            begins = np.searchsorted(row, np.arange(batch.num_rows))
            ends = np.searchsorted(row, np.arange(batch.num_rows), "right")
            out = []
            for r in range(batch.num_rows):
                a, b = int(begins[r]), int(ends[r])
                hit = np.flatnonzero((numbers[a:b] > 0).any(1))
                left = a + (max(0, int(hit[0]) - WINDOW // 2) if len(hit) else 0)
                size = min(WINDOW, b - left)
                if size > 0:
                    block = np.zeros((WINDOW, numbers.shape[1] + 1), np.int32)
                    block[:size, :-1], block[:size, -1] = numbers[left:left + size], tags[left:left + size]
                    out.append((r, block.tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([int(y[r]) for r, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], ["y", "window"])

    blocks = rows.select("y", "text").mapInArrow(cut, "y int, window binary")
    half = [blocks.where(F.col("y") == y).orderBy(F.md5("window")).limit(windows // 2) for y in (0, 1)]
    cuts = half[0].unionByName(half[1]).toPandas()["window"]
    if not len(cuts):  # no labelled text has a word
        return None
    got = np.stack([np.frombuffer(x, np.int32).reshape(WINDOW, -1) for x in cuts])
    weights, bias, trans = fit_chain([got[:, :, i] for i in range(got.shape[2] - 1)], got[:, :, -1], len(keys))
    tagger = Tagger(keys, weights[1:], bias, trans, np.zeros(3))

    def measure(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in pieces(batches):
            x, _ = tagger.tag(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("y"), *map(pa.array, x.T)], ["y", "a", "b"])

    points = rows.select("y", "text").mapInArrow(measure, "y int, a double, b double").toPandas()
    tagger.curve = logistic(points[["a", "b"]].to_numpy(), points["y"].to_numpy(float))
    share, seen = usable.agg(F.avg("y")).first()[0], points["y"].mean()
    tagger.curve[0] += np.log(share / (1 - share)) - np.log(seen / (1 - seen))
    return tagger


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def score_toxicity(docs: DataFrame, tagger: Tagger | None, text: str = "text") -> DataFrame:
    """The documents with ``score`` and ``spans`` (byte offsets in UTF-8); equally named input columns are replaced."""
    rest = docs.drop("score", "spans")
    if tagger is None:
        return rest.withColumns({"score": F.lit(0.0), "spans": F.array().cast(SPANS)})
    schema = T.StructType([*rest.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("spans", SPANS)])

    def apply(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in pieces(batches, text):
            x, spans = tagger.tag(batch.column(text))
            shown = pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tagger.scores(x)), shown], [*batch.schema.names, "score", "spans"])

    return rest.mapInArrow(apply, schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document; held_out marks those no label was learned from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id"), FOLDS, HELD).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.size("spans").alias("n_spans"))
