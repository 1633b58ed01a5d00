"""Operator 3: quality classifier by compression.

Two zstandard dictionaries are built, from texts labelled good and from texts labelled bad.
A text is cut into pieces of a few kilobytes, each piece is compressed with both; the
difference of the summed sizes, divided by the text's length, says which texts it is like.
Pieces keep a long text from becoming its own dictionary, and the whole text counts.
A logistic curve over that difference and the length, fitted on labelled texts that no
dictionary has seen, makes the score.

Bounds of the fit: ``SAMPLE`` labelled documents per class for the dictionaries and as many
for the curve, ``DICTIONARY_BYTES`` per dictionary, ``SAMPLE_CHARS`` of pieces per class.
Scoring covers every document and is a map: no shuffle.

Rows: null and empty texts are scored as a text of length 0; labels that are null or of
unknown documents are left out, repeated ones go by majority; with labels of one class
only every score is 0.5; null doc_ids are scored like others; an empty table gives an
empty one. Columns other than the named ones are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetide.llm.common import clean_labels, held_out, joined_bytes, logistic, pieces, probability, sample_labels, table

FOLDS, HELD = 5, 0
THRESHOLD = 0.3
SAMPLE = 2000
SAMPLE_CHARS = 6_000_000
DICTIONARY_BYTES = 112_640
PIECE = 2048
LEVEL = 3


@dataclass
class Model:
    good: bytes
    bad: bytes
    curve: np.ndarray

    def features(self, column) -> np.ndarray:
        """Normalised size difference, log length and their product of each text."""
        data, offsets = joined_bytes(column)
        raw, difference = data.tobytes(), np.zeros(len(offsets) - 1)
        sizes = [self._squeezer(self.good), self._squeezer(self.bad)]
        for row, (start, stop) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
            difference[row] = sum(sizes[1](raw[i:min(i + PIECE, stop)]) - sizes[0](raw[i:min(i + PIECE, stop)]) for i in range(start, stop, PIECE))
        length = np.diff(offsets)
        ratio, log = difference / np.maximum(length, 1), np.log1p(length)
        return np.column_stack([ratio, log, ratio * log])

    @staticmethod
    def _squeezer(data: bytes):
        import zstandard

        own = zstandard.ZstdCompressionDict(data)
        own.precompute_compress(LEVEL)
        squeeze = zstandard.ZstdCompressor(level=LEVEL, dict_data=own, write_content_size=False, write_checksum=False, write_dict_id=False).compress
        return lambda piece: len(squeeze(piece))

    def scores(self, column) -> np.ndarray:
        return probability(self.features(column), self.curve)


def build_dictionary(texts: list[bytes], size: int) -> bytes:
    """A trained dictionary; with too few texts for training, their plain content."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, texts).as_bytes()
    except zstandard.ZstdError:
        return b"".join(texts)[-size:] or b" "


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> Model | None:
    """Model from labels outside the held-out fold; None if a class has none."""
    usable = clean_labels(labels, label).where(~held_out(F.col("doc_id"), FOLDS, HELD))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # One half of the folds makes dictionaries, the other the curve; at most 4 x sample ids are broadcast.
    half = F.crc32(F.concat(F.lit("half"), F.col("doc_id").cast("string"))) % 2
    ids = sample_labels(usable.where(half == 0), sample, "d").withColumn("part", F.lit(0)).unionByName(
        sample_labels(usable.where(half == 1), sample, "c").withColumn("part", F.lit(1)))
    rows = texts.join(F.broadcast(ids), "doc_id")
    cut = rows.where("part = 0").select("y", "doc_id", F.posexplode(F.expr(
        f"transform(sequence(1, greatest(length(text), 1), {PIECE}), i -> substring(text, i, {PIECE}))")).alias("i", "piece"))
    made = []
    for y in (1, 0):
        # Pieces in hash order, as many as the bound holds at full length.
        chosen = cut.where((F.col("y") == y) & (F.length("piece") >= 8)).orderBy(F.md5(F.concat_ws("|", "doc_id", "i")), "piece").limit(chars // PIECE)
        found = [r.piece.encode() for r in chosen.select("piece").toLocalIterator()]
        if not found:
            return None
        made.append(build_dictionary(found, DICTIONARY_BYTES))
    model = Model(made[0], made[1], np.zeros(4))

    def measure(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in pieces(batches):
            x = model.features(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("y"), *map(pa.array, x.T)], ["y", "a", "b", "c"])

    points = rows.where("part = 1").select("y", "text").mapInArrow(measure, "y int, a double, b double, c double").toPandas()
    if points["y"].nunique() < 2:
        points = rows.select("y", "text").mapInArrow(measure, "y int, a double, b double, c double").toPandas()
    # The sample is even between the classes; weights would be right back at their share, so shift the bias.
    share = usable.agg(F.avg("y")).first()[0]
    model.curve = logistic(points[["a", "b", "c"]].to_numpy(), points["y"].to_numpy(float))
    seen = points["y"].mean()
    model.curve[0] += np.log(share / (1 - share)) - np.log(seen / (1 - seen))
    return model


def score_quality(docs: DataFrame, model: Model | None, text: str = "text", name: str = "score") -> DataFrame:
    """The documents with a score column in front of nothing else changed; an equally named input column is replaced."""
    rest = docs.drop(name)
    if model is None:
        return rest.withColumn(name, F.lit(0.5))
    from pyspark.sql import types as T

    schema = T.StructType([*rest.schema.fields, T.StructField(name, T.DoubleType())])

    def apply(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in pieces(batches, text):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.scores(batch.column(text)))], [*batch.schema.names, name])

    return rest.mapInArrow(apply, schema)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document; held_out marks those no label was learned from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_quality(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id"), FOLDS, HELD).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
