"""Operator 2: benchmark decontamination with a BM25 index of the test items.

Test items are cut into parts of at most ``PART`` words. Spark makes the postings (term, part,
impact); parts are numbered in blocks, and every term keeps its largest impact over all parts
and per block. Every passage of every document (windows of two parts' length, half overlapping,
so an item stands whole in one of them) is a query: first the terms' largest impacts bound its
score over all parts, then per block, and only blocks that can reach a part's threshold are scored.

A part's threshold is what a passage scores at least that holds ``OVERLAP`` of the part's word
shingles: its own score without its dearest terms, as many as may be missing. So retrieval
loses nothing, and verification decides: it counts the shingles of question and answer
(the last sentence) that stand in the passage, and both together have to reach ``OVERLAP``.

The index is broadcast in shards of ``SHARD`` parts, whatever their number: each shard has a
bounded size (parts x words of a part), and each is a pass over the documents. Nothing is
shuffled but the hits.

Rows: null or blank items have no part, null or blank documents no passage; repeated items
and documents count each; null ids are kept as they are; a document or item table that is
empty gives an empty result. Items of fewer words than a shingle are one shingle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetide.llm.common import joined_bytes, pieces, table, word_hashes, words_of

PART = 64
WORDS = 5
OVERLAP = 0.75
SHARD = 4096
BLOCK = 16
K1, B = 1.2, 0.75
HITS = "item_id long, part int, first_word long, score double, question_overlap double, answer_overlap double, overlap double"


def item_parts(items: DataFrame, key: str, text: str) -> DataFrame:
    """Parts of the items: item_id, part, number, hashes of its words, where the answer begins."""
    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in pieces(batches):
            ids, out = batch.column("item_id").to_pylist(), []
            for i, text in enumerate(batch.column("text").to_pylist()):
                raw = np.frombuffer((text or "").encode(), np.uint8)
                ends = np.array([0, len(raw)], np.int64)
                starts, stops, _ = words_of(raw, ends)
                if not len(starts):
                    continue
                words = word_hashes(raw, starts, stops).astype(np.int64)
                # The answer is the last sentence; without one, the last quarter of the words.
                closing = np.flatnonzero(np.isin(raw[stops - 1], np.frombuffer(b".?!", np.uint8)))
                closing = closing[closing < len(words) - 1]
                answer = int(closing[-1]) + 1 if len(closing) else len(words) - max(1, len(words) // 4)
                for p, a in enumerate(range(0, len(words), PART)):
                    out.append((ids[i], p, words[a:a + PART].tolist(), max(0, answer - a)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.int32()))], ["item_id", "part", "words", "answer"])

    return items.select(F.col(key).cast("long").alias("item_id"), F.col(text).alias("text")).mapInArrow(
        cut, "item_id long, part int, words array<long>, answer int")


def postings(parts: DataFrame) -> DataFrame:
    """(item_id, part, words, answer, terms): every distinct term of a part with its BM25 impact."""
    each = parts.withColumn("_row", F.xxhash64("item_id", "part", "words"))
    terms = each.select("_row", F.size("words").alias("len"), F.explode("words").alias("term")).groupBy("_row", "len", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = terms.groupBy("term").agg(F.countDistinct("_row").alias("df"))
    total = each.select("_row", F.size("words").alias("len")).distinct().agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("mean"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    impact = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    weighed = terms.join(df, "term").join(F.broadcast(total)).select("_row", F.struct("term", impact.alias("impact")).alias("t"))
    lists = weighed.groupBy("_row").agg(F.array_sort(F.collect_set("t")).alias("terms"))  # words of one part
    return each.join(lists, "_row").drop("_row")


def grams(words: list[int], size: int) -> list[tuple]:
    return [tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))]


@dataclass
class Index:
    """One shard: parts with thresholds, terms with largest impacts, impacts by block."""

    ids: list
    numbers: list[int]
    words: list[list[int]]
    answers: list[int]
    terms: np.ndarray
    impacts: np.ndarray  # terms x parts, zero where a term is not in a part

    def __post_init__(self):
        n = len(self.words)
        self.blocks = -(-n // BLOCK)
        wide = np.zeros((len(self.terms), self.blocks * BLOCK), np.float32)
        wide[:, :n] = self.impacts
        self.impacts = wide
        self.block_most = wide.reshape(len(self.terms), self.blocks, BLOCK).max(2)
        self.most = self.block_most.max(1)
        self.limits = np.full(self.blocks * BLOCK, np.inf)
        for p, words in enumerate(self.words):
            own = np.sort(wide[:, p][wide[:, p] > 0])[::-1]
            size = min(WORDS, len(words))
            absent = int((1 - OVERLAP) * (len(words) - size + 1))
            self.limits[p] = own.sum() - own[:absent].sum() - 1e-3
        self.block_limits = self.limits.reshape(self.blocks, BLOCK).min(1)

    def search(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple]:
        """(row, part, first word, score, overlaps) of every verified passage of the rows' texts."""
        starts, stops, rows = words_of(data, offsets)
        if not len(starts):
            return []
        hashes = word_hashes(data, starts, stops).astype(np.int64)
        first = np.searchsorted(rows, np.arange(len(offsets) - 1))
        place = np.arange(len(rows)) - first[rows]
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        known = np.flatnonzero(self.terms[at] == hashes)
        if not len(known):
            return []
        # A word stands in the window that begins with its own step and in the one before.
        steps = place // PART
        counts = np.bincount(rows, minlength=len(offsets) - 1)
        base = np.concatenate([[0], np.cumsum(-(-counts // PART) + 1)])[:-1]
        own = base[rows[known]] + steps[known] + 1
        pair = np.unique(np.concatenate([own, own - 1]) * len(self.terms) + np.tile(at[known], 2))
        window, term = pair // len(self.terms), pair % len(self.terms)
        begins = np.flatnonzero(np.insert(window[1:] != window[:-1], 0, True))
        bound = np.add.reduceat(self.most[term], begins)
        out = []
        lengths = np.diff(np.append(begins, len(pair)))
        passing = np.flatnonzero(bound >= self.block_limits.min())
        for lot in np.array_split(passing, max(1, -(-int(lengths[passing].sum()) * self.blocks // 8_000_000))):
            if not len(lot):
                continue
            rowsets = np.concatenate([np.arange(begins[i], begins[i] + lengths[i]) for i in lot])
            edges = np.concatenate([[0], np.cumsum(lengths[lot])])[:-1]
            by_block = np.add.reduceat(self.block_most[term[rowsets]], edges, axis=0)
            for k, b in zip(*np.nonzero(by_block >= self.block_limits)):
                own_terms = term[begins[lot[k]]:begins[lot[k]] + lengths[lot[k]]]
                scores = self.impacts[own_terms, b * BLOCK:(b + 1) * BLOCK].sum(0)
                for p in np.flatnonzero(scores >= self.limits[b * BLOCK:(b + 1) * BLOCK]).tolist():
                    w = int(window[begins[lot[k]]])
                    row = int(np.searchsorted(base, w, "right")) - 1
                    start = max(0, (w - int(base[row]) - 1) * PART)
                    stop = min((w - int(base[row]) + 1) * PART, int(counts[row]))
                    part = int(b) * BLOCK + p
                    passage = hashes[first[row] + start:first[row] + stop].tolist()
                    if (found := self.overlaps(part, passage))[2] >= OVERLAP:
                        out.append((row, part, start, float(scores[p]), *found))
        return out

    def overlaps(self, part: int, passage: list[int]) -> tuple[float, float, float]:
        """Share of the shingles of question, answer and both that the passage holds."""
        words, size = self.words[part], min(WORDS, len(self.words[part]))
        own, there = grams(words, size), set(grams(passage, size))
        hit = [g in there for g in own]
        cut = max(0, min(self.answers[part] - size + 1, len(own)))  # shingles that end before the answer are the question's
        share = lambda x: sum(x) / len(x) if x else 1.0
        return share(hit[:cut]), share(hit[cut:]), share(hit)


def shards(items: DataFrame, key: str = "item_id", text: str = "text") -> Iterator[Index]:
    """The index in shards of at most SHARD parts, one after the other in the driver."""
    listed = postings(item_parts(items, key, text)).orderBy("item_id", "part")
    rows: list = []
    for row in listed.toLocalIterator():
        rows.append(row)
        if len(rows) == SHARD:
            yield _shard(rows)
            rows = []
    if rows:
        yield _shard(rows)


def _shard(rows: list) -> Index:
    terms = np.unique(np.array([t.term for r in rows for t in r.terms], np.int64))
    impacts = np.zeros((len(terms), len(rows)), np.float32)
    for p, r in enumerate(rows):
        impacts[np.searchsorted(terms, [t.term for t in r.terms]), p] = [t.impact for t in r.terms]
    return Index([r.item_id for r in rows], [r.part for r in rows], [r.words for r in rows], [r.answer for r in rows], terms, impacts)


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """Passages that hold a test item: doc_id, item_id, part, first_word, score and overlaps."""
    spark, found = docs.sparkSession, []
    schema = f"doc_id long, {HITS}"
    for index in shards(items, item_key, item_text):
        shared = spark.sparkContext.broadcast(index)

        def search(batches: Iterator, shared=shared) -> Iterator:
            import pyarrow as pa

            index = shared.value
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), *[pa.float64()] * 4)
            names = [x.split()[0] for x in schema.split(", ")]
            for batch in pieces(batches):
                ids = batch.column("doc_id")
                hits = [(ids[r].as_py(), index.ids[p], index.numbers[p], *rest) for r, p, *rest in index.search(*joined_bytes(batch.column("text")))]
                if hits:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*hits), kinds)], names)

        found.append(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(search, schema))
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema)


def without_leaks(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """Documents without a verified passage, all columns, as a map over the documents."""
    spark = docs.sparkSession
    for index in shards(items, item_key, item_text):
        shared = spark.sparkContext.broadcast(index)

        def keep(batches: Iterator, shared=shared) -> Iterator:
            import pyarrow as pa

            for batch in pieces(batches, text):
                clean = np.ones(batch.num_rows, bool)
                clean[[r for r, *_ in shared.value.search(*joined_bytes(batch.column(text)))]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs


def op2_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the test items they hold."""
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.groupBy("doc_id", "item_id").agg(
        F.count(F.lit(1)).alias("n_passages"), F.round(F.max("score"), 4).alias("score"), F.max("question_overlap").alias("question_overlap"),
        F.max("answer_overlap").alias("answer_overlap"), F.max("overlap").alias("overlap"))
