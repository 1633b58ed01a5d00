"""Operator 13: token counts through a cache of digests.

A text is known by the digest of its normalised content, a tokenizer by the digest of its
vocabulary file, kind and library version. Counts live in a table of (tokenizer, digest,
n_tokens) in a shared folder. A run takes the digests of all texts, joins the distinct ones
to the cache, encodes each missing text once, appends its count and joins all documents to
the counts. A second run over the same texts encodes nothing; a new tokenizer version meets
an empty part of the cache and never reads another's counts.

The cache is append only and every row is right on its own, so a run that was cut short
leaves useful rows, and rows that two runs appended are one when read.

Texts are combined per digest inside each task before they move, so a text that a third of
all rows hold moves once per task; a task encodes batches of bounded size. Few misses (at
most ``FEW`` digests, counted) are broadcast, so that a run with a warm cache moves no text.

For byte-level tokenizers a match of the word pattern never holds a character followed by
white space, so a text is cut before each such white space, and the count of a text is the
sum over its cuts, each encoded by the library once per worker and then remembered (bounded).
Other tokenizers encode whole texts.

Rows: null text counts as empty and has no token; equal texts, repeated rows and null ids
each keep their row; an empty table gives an empty one and leaves the cache as it is; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetide.llm.common import pieces, stored, table, work_folder

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024
#: Digests that are broadcast, at most (about 100 bytes each).
FEW = 50_000
#: Cuts that a worker remembers, and the longest of them.
REMEMBERED, LONGEST = 400_000, 64
CACHE_SCHEMA = "digest string, n_tokens long, tokenizer string"
CUT = re.compile(r"\s*\S+|\s+")


def vocabulary_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Vocabulary:
    """A tokenizer file as bytes, which travels with the tasks, and the digest that names its version."""

    def __init__(self, path: str):
        import sentencepiece
        import tokenizers

        self.kind = path.rpartition(".")[2]
        library = {"json": tokenizers, "model": sentencepiece}.get(self.kind)
        if library is None:
            raise ValueError(f"no library for {path}")
        with open(path, "rb") as file:
            self.data = file.read()
        named = f"{self.kind}|{library.__name__}|{library.__version__}|".encode()
        self.version = hashlib.sha256(named + self.data).hexdigest()

    def counter(self) -> Callable[[list[str]], list[int]]:
        """Function from texts to their numbers of tokens; no tokens are added."""
        if self.kind == "model":
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_proto=self.data)
            return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives a task one core
        from tokenizers import Tokenizer

        text = self.data.decode()
        model = Tokenizer.from_str(text)
        model.no_truncation()
        model.no_padding()

        def encode(texts: list[str]) -> list[int]:
            return [len(x) for x in model.encode_batch(texts, add_special_tokens=False)]

        return summed_cuts(encode) if cuts_at_space(json.loads(text)) else encode


def cuts_at_space(settings: dict) -> bool:
    """Whether texts may be cut before white space: plain byte-level words, and no added token that spans any."""
    words = settings.get("pre_tokenizer") or {}
    plain = words.get("type") == "ByteLevel" and words.get("use_regex") and not words.get("add_prefix_space")
    added = settings.get("added_tokens") or []
    return bool(plain and settings.get("normalizer") is None and not any(
        a["lstrip"] or a["rstrip"] or a["single_word"] or re.search(r"\s", a["content"]) for a in added))


def summed_cuts(encode: Callable[[list[str]], list[int]]) -> Callable[[list[str]], list[int]]:
    known: dict[str, int] = {}

    def count(texts: list[str]) -> list[int]:
        cuts = [CUT.findall(x) for x in texts]
        own: dict[str, int] = {}
        new = list({c for cut in cuts for c in cut if c not in known})
        for short in (True, False):
            some = [c for c in new if (len(c) <= LONGEST) == short]
            (known if short else own).update(zip(some, encode(some)))
        out = [sum(known[c] if c in known else own[c] for c in cut) for cut in cuts]
        if len(known) > REMEMBERED:
            known.clear()
        return out

    return count


_counters: dict[str, Callable[[list[str]], list[int]]] = {}


def encoded(texts: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """digest, n_tokens of the rows digest, body."""
    shared = texts.sparkSession.sparkContext.broadcast(vocabulary)  # one file of a few MB

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = shared.value
        if own.version not in _counters:
            _counters[own.version] = own.counter()
        for batch in pieces(batches, "body"):
            n = _counters[own.version](batch.column("body").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(n, pa.int64())], ["digest", "n_tokens"])

    return texts.select("digest", "body").mapInArrow(run, "digest string, n_tokens long")


def cached(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """digest, n_tokens of one tokenizer version, a row per digest; a folder that is not there is empty."""
    try:
        rows = spark.read.schema(CACHE_SCHEMA).parquet(cache)
    except AnalysisException as err:
        if err.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], CACHE_SCHEMA)
    return rows.where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def content(text: Column) -> Column:
    """Normalised content: null is empty. A tokenizer that folds more may be given a rule that folds as much."""
    return F.coalesce(text, F.lit(""))


def fill_cache(
    docs: DataFrame, digests: DataFrame, vocabulary: Vocabulary, cache: str, text: str = "text",
    normalised: Callable[[Column], Column] = content, few: int = FEW,
) -> int:
    """Encode each distinct text of ``digests`` that the cache lacks, append the counts; how many they were."""
    spark = docs.sparkSession
    known = cached(spark, cache, vocabulary.version).select("digest")
    missing = stored(digests.select("digest").distinct().join(known, "digest", "left_anti"), "token-misses")
    n = missing.count()
    if n:
        body = normalised(F.col(text))
        texts = docs.select(F.sha2(body, 256).alias("digest"), body.alias("body"))
        if n <= few:
            texts = texts.join(F.broadcast(missing), "digest", "left_semi")
        one = texts.groupBy("digest").agg(F.first("body").alias("body"))
        if n > few:
            one = one.join(missing, "digest", "left_semi")
        counts = encoded(one, vocabulary).withColumn("tokenizer", F.lit(vocabulary.version))
        counts.write.mode("append").partitionBy("tokenizer").parquet(cache)
    return n


def count_tokens(
    docs: DataFrame, vocabulary: str, cache: str, key: str = "doc_id", text: str = "text",
    normalised: Callable[[Column], Column] = content, few: int = FEW,
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, a row per document; ``vocabulary`` is the path of a tokenizer file."""
    words = Vocabulary(vocabulary)
    digests = stored(docs.select(
        F.col(key).alias("doc_id"), F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n_bytes"),
        F.sha2(normalised(F.col(text)), 256).alias("digest")), "token-digests")
    fill_cache(docs, digests, words, cache, text, normalised, few)
    counts = stored(cached(docs.sparkSession, cache, words.version), "token-counts")  # Spark splits a hot digest if it joins plain tables
    return digests.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens")


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document, and whether it exceeds the limit; the cache starts empty."""
    counts = count_tokens(table(spark, sf_dir, "documents"), vocabulary_file(VOCABULARY), work_folder(spark, "token-cache"))
    return counts.withColumn("over_limit", F.col("n_tokens") > LIMIT)
