"""Operator 7: exact n-gram Jaccard join with grouped prefixes.

1. A sketch counts shingles over the corpus in a fixed number of buckets. Shingles whose
   bucket is far above the mean are frequent; the order of all shingles is (frequency
   level, hash), so common passages come last in every document.
2. A document's prefix is its first n - ceil(t n) + 1 shingles in that order: linked
   documents share one of them. Documents with identical prefix and size become one group,
   equal sets one node.
3. Groups meet in the lists of their prefix shingles. Lists of one group are dropped.
4. Group lists expand to nodes. Star rounds pair the nodes of a list with one leader; pairs
   that the sizes and the number of common prefix shingles allow are verified on whole sets,
   and links join components. Each round is linear in the lists.
5. The last round takes the pairs of a list that are still in different components, each
   where a run of common shingles begins, so no link between components is missed, whatever
   the earlier rounds found.
6. Components are labelled by repeated minimum over links with label jumping.

Sets of nodes in candidate pairs are computed anew from the texts; a Bloom filter of fixed
size picks those texts, so neither texts nor other sets are shuffled. Sizes of sketch and
filter are parameters; they steer the cost, never the result. Shingles are compared as
64-bit hashes.

Rows: words are lower-cased in A-Z; fewer words than the shingle length make one shingle;
null or blank texts have no shingle, are their own component and link with nothing;
rows with equal texts link; null doc_ids link by their text but name no component;
an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagetide.llm.common import discard, joined_bytes, mixed, pieces, release, stored, table, word_hashes, words_of

WORDS = 5
THRESHOLD = Fraction(3, 4)
#: Buckets of the frequency sketch (4 bytes each, broadcast) and blocks it is summed in.
BUCKETS = 1 << 20
BLOCKS = 64
#: Bits of the Bloom filter that picks texts for verification.
BLOOM_BITS = 1 << 24
STAR_ROUNDS = 2


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, ascending inside a row, and the rows' offsets in them."""
    starts, stops, rows = words_of(data, offsets)
    n = len(offsets) - 1
    hashes = word_hashes(data, starts, stops)
    counts = np.bincount(rows, minlength=n)
    first = np.cumsum(counts) - counts
    total = len(hashes)
    rolled = np.zeros(total, np.uint64)
    for k in range(words):  # a shorter document ends early: its one shingle takes the words it has
        shifted = np.zeros(total, np.uint64)
        shifted[:total - k] = hashes[k:] if k else hashes
        inside = np.arange(total) + k < np.repeat(first + counts, counts)
        rolled = np.where(inside, mixed(rolled * np.uint64(31) + shifted), rolled)
    place = np.arange(total) - np.repeat(first, counts)
    keep = place < np.maximum(np.repeat(counts, counts) - words + 1, 1)
    rolled, rows = rolled[keep], rows[keep]
    order = np.lexsort((rolled, rows))
    rolled, rows = rolled[order], rows[order]
    fresh = np.ones(len(rolled), bool)
    fresh[1:] = (rolled[1:] != rolled[:-1]) | (rows[1:] != rows[:-1])
    rolled, rows = rolled[fresh], rows[fresh]
    return rolled, np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))])


def fold(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One 64-bit hash per row of a list of numbers; order counts."""
    place = np.arange(len(values), dtype=np.uint64) - np.repeat(offsets[:-1], np.diff(offsets)).astype(np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(values + mixed(place + np.uint64(7))), dtype=np.uint64)])
    return mixed(sums[offsets[1:]] - sums[offsets[:-1]] + np.diff(offsets).astype(np.uint64)).astype(np.int64)


def needed(n: Column, threshold: Fraction = THRESHOLD) -> Column:
    """ceil(t n) in whole numbers."""
    return F.floor((n * threshold.numerator + threshold.denominator - 1) / threshold.denominator).cast("long")


def frequency_sketch(docs: DataFrame, text: str, buckets: int, words: int) -> np.ndarray:
    """Documents per bucket of shingles; every task sends its own counts once, summed per block as they stream by."""
    import pyarrow as pa
    import zlib

    block = buckets // BLOCKS

    def count(batches: Iterator) -> Iterator:
        own = np.zeros(buckets, np.int64)
        for batch in pieces(batches, text):
            shingles, _ = shingle_sets(*joined_bytes(batch.column(text)), words)
            own += np.bincount((shingles % np.uint64(buckets)).astype(np.int64), minlength=buckets)
        if own.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(BLOCKS), pa.int32()), pa.array([zlib.compress(own[i * block:(i + 1) * block].astype("<u4").tobytes(), 1) for i in range(BLOCKS)], pa.binary())],
                ["block", "counts"])

    def add(batches: Iterator) -> Iterator:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, counts in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist()):
                got = np.frombuffer(zlib.decompress(counts), "<u4").astype(np.int64)
                sums[i] = sums[i] + got if i in sums else got
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([zlib.compress(x.astype("<i8").tobytes(), 1) for x in sums.values()], pa.binary())], ["block", "counts"])

    out = np.zeros(buckets, np.int64)
    kind = "block int, counts binary"
    for row in docs.select(text).mapInArrow(count, kind).repartition(BLOCKS, "block").mapInArrow(add, kind).collect():  # BLOCKS rows
        out[row.block * block:(row.block + 1) * block] = np.frombuffer(zlib.decompress(row.counts), "<i8")
    return out


def levels_of(sketch: np.ndarray) -> np.ndarray:
    """0 for buckets up to twice the mean, then one more per doubling, below 32."""
    mean = max(sketch.mean(), 1.0)
    return np.clip(np.ceil(np.log2(np.maximum(sketch, 1) / mean)) - 1, 0, 31).astype(np.uint64)


def components(links: DataFrame) -> DataFrame:
    """(node, comp) of all nodes with links (a, b): the smallest node of each connected part.

    Every round takes the smallest label around and then the label's own label, so the
    number of rounds grows with the logarithm of the longest path.
    """
    both = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("comp")), "labels")
    while True:
        around = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        new = labels.join(around, "node").select("node", F.least("comp", "near").alias("comp"))
        jump = new.alias("x").join(new.select(F.col("node").alias("_n"), F.col("comp").alias("_c")), F.col("x.comp") == F.col("_n"), "left")
        new = stored(jump.select("node", F.least(F.col("comp"), F.coalesce("_c", "comp")).alias("comp")), "labels")
        changed = new.join(labels.withColumnRenamed("comp", "old"), "node").where("comp <> old").limit(1).count()
        labels = new
        if not changed:
            return labels


class Join:
    """State of one join: nodes, lists, sets of the nodes seen in pairs, links so far."""

    def __init__(self, docs: DataFrame, key: str, text: str, words: int, threshold: Fraction, buckets: int, bloom_bits: int):
        self.docs, self.text, self.words, self.threshold, self.bloom_bits = docs, text, words, threshold, bloom_bits
        spark = docs.sparkSession
        levels = spark.sparkContext.broadcast(levels_of(frequency_sketch(docs, text, buckets, words)).astype(np.uint8))
        up, down = threshold.numerator, threshold.denominator

        def describe(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for batch in pieces(batches, text):
                shingles, offsets = shingle_sets(*joined_bytes(batch.column(text)), words)
                n = np.diff(offsets)
                level = levels.value[(shingles % np.uint64(buckets)).astype(np.int64)].astype(np.uint64)
                ordered = (level << np.uint64(58)) | (shingles >> np.uint64(6))
                rows = np.repeat(np.arange(len(n)), n)
                ordered = ordered[np.lexsort((ordered, rows))]
                size = np.where(n > 0, n - (n * up + down - 1) // down + 1, 0)
                mask = np.arange(len(ordered)) - np.repeat(offsets[:-1], n) < np.repeat(size, n)
                prefix, ends = ordered[mask], np.concatenate([[0], np.cumsum(size)])
                raw = prefix.astype("<i8").tobytes()
                last = np.where(size > 0, np.append(prefix, 0)[np.maximum(ends[1:] - 1, 0)], 0).astype(np.int64)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0), pa.array(n, pa.int64()), pa.array(fold(shingles, offsets)), pa.array(fold(prefix, ends) ^ n),
                    pa.array(last), pa.array([raw[8 * a:8 * b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.binary()),
                ], ["doc_id", "n", "node", "grp", "last", "prefix"])

        described = docs.select(F.col(key).cast("long").alias("doc_id"), text).mapInArrow(
            describe, "doc_id long, n long, node long, grp long, last long, prefix binary")
        described = stored(described, "prefixes")
        self.rows = stored(described.select("doc_id", "n", "node"), "rows")
        self.nodes = stored(described.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("grp").alias("grp"), F.first("last").alias("last")), "nodes")
        sizes = self.nodes.groupBy("grp").agg(F.count(F.lit(1)).alias("n_nodes"))
        groups = described.where("n > 0").groupBy("grp").agg(F.first("prefix").alias("prefix")).join(sizes, "grp")
        groups = stored(groups.select("grp", "n_nodes", "prefix"), "groups")
        discard(described)
        release(spark)

        def unpack(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for batch in batches:
                raw = batch.column("prefix").to_pylist()
                each = np.array([len(x) // 8 for x in raw])
                for a in range(0, len(raw), 2000):
                    k = each[a:a + 2000]
                    if k.sum():
                        yield pa.RecordBatch.from_arrays([
                            pa.array(np.frombuffer(b"".join(raw[a:a + 2000]), "<i8")),
                            pa.array(np.repeat(np.asarray(batch.column("grp"))[a:a + 2000], k)),
                            pa.array(np.repeat(np.asarray(batch.column("n_nodes"))[a:a + 2000], k)),
                        ], ["token", "grp", "n_nodes"])

        def shared(batches: Iterator) -> Iterator:
            """Rows of sorted lists without those of lists of one row that stands for one node; one row is carried on."""
            import pyarrow as pa

            last, carried = None, False
            for batch in batches:
                if not batch.num_rows:
                    continue
                whole = batch if last is None else pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
                token, many = np.asarray(whole.column("token")), np.asarray(whole.column("n_nodes"))
                n = len(token)
                same = token[1:] == token[:-1]
                with_next, with_last = np.append(same, False), np.insert(same, 0, False)
                if last is not None:
                    with_last[0] = carried
                keep = with_next | with_last | (many > 1)
                carried = bool(with_last[-1])
                last = whole.slice(n - 1, 1)
                keep[-1] = False
                if keep.any():
                    yield whole.filter(pa.array(keep)).select(["token", "grp"])
            if last is not None and (carried or last.column("n_nodes")[0].as_py() > 1):
                yield last.select(["token", "grp"])

        postings = groups.mapInArrow(unpack, "token long, grp long, n_nodes long")
        lists = postings.repartition("token").sortWithinPartitions("token").mapInArrow(shared, "token long, grp long")
        lists = stored(lists, "shared")
        discard(groups)
        release(spark)  # the shuffle of all prefix shingles is the largest of the job
        lists = lists.join(self.nodes.select("grp", "node", "n", "last"), "grp").select("token", "node", "n", "last")
        # No set holds more in common with another than its listed prefix shingles and all behind its prefix.
        every = Window.partitionBy("node")
        order = every.orderBy("token")
        lists = lists.withColumns({
            "listed": F.count(F.lit(1)).over(every), "place": F.row_number().over(order), "before": F.coalesce(F.lag("token").over(order), F.lit(-1))})
        cap = F.col("listed") + needed(F.col("n"), threshold) - 1
        rest = F.col("listed") - F.col("place") + 1
        self.lists = stored(lists.select("token", "node", F.struct("n", "last", cap.alias("cap")).alias("s"), rest.alias("rest"), "before"), "lists")
        release(spark)
        self.links: DataFrame | None = None
        self.labels: DataFrame | None = None
        self.sets: DataFrame | None = None

    def labelled(self) -> DataFrame:
        """Lists whose nodes lie in more than one component."""
        if self.labels is None:
            lists = self.lists.withColumn("comp", F.col("node"))
        else:
            lists = self.lists.join(self.labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        every = Window.partitionBy("token")
        return lists.withColumns({"_a": F.min("comp").over(every), "_b": F.max("comp").over(every)}).where("_a <> _b").drop("_a", "_b")

    def possible(self, a: Column, b: Column, common: Column | None = None) -> Column:
        """Whether two sets (n, last, cap) can reach the threshold, given the number of common prefix shingles if known.

        Up to the end of the prefix that ends first, common shingles stand in both prefixes, so in a list; of the
        set with that prefix, what is common lies there or behind. Sizes have to agree as well.
        """
        up, down = self.threshold.numerator, self.threshold.denominator
        least = F.floor(((a["n"] + b["n"]) * up + up + down - 1) / (up + down)).cast("long")
        first = a["last"] <= b["last"]
        most = F.when(first, a["cap"]).otherwise(b["cap"])
        sizes = F.least(a["n"], b["n"]) * down >= F.greatest(a["n"], b["n"]) * up
        if common is not None:
            most = F.least(most, common + needed(F.when(first, a["n"]).otherwise(b["n"]), self.threshold) - 1)
        return sizes & (most >= least)

    def star_pairs(self, turn: int) -> DataFrame:
        """Each list's nodes with one leader: first the one whose prefix is listed most, later any."""
        share = (F.col("s.cap") - F.col("s.n")) / F.col("s.n")
        mark = F.xxhash64("node", F.lit(turn)).cast("double") if turn else -share
        leader = F.min(F.struct(mark.alias("m"), "node", "s", "comp")).over(Window.partitionBy("token"))
        rows = self.labelled().withColumn("_l", leader).where("_l.comp <> comp").where(self.possible(F.col("_l.s"), F.col("s")))
        pairs = rows.groupBy(F.col("_l.node").alias("a"), F.col("_l.s").alias("x"), F.col("node").alias("b"), F.col("s").alias("y")).agg(F.count(F.lit(1)).alias("c"))
        return pairs.where(self.possible(F.col("x"), F.col("y"), F.col("c")))

    def cross_pairs(self) -> DataFrame:
        """Pairs of a list that lie in different components and can reach the threshold.

        Two nodes whose listed shingles before this one are the same meet in that list already, so a common
        passage pairs them at its first shingle only. At their first common shingle no more are common than
        either still lists; a pair that fails there fails in all later lists too.
        """
        lists = stored(self.labelled(), "cross")
        release(self.docs.sparkSession)
        x = lists.select("token", F.col("node").alias("a"), F.col("s").alias("x"), F.col("comp").alias("ca"), F.col("rest").alias("ra"), F.col("before").alias("pa"))
        y = lists.select(F.col("token").alias("_t"), F.col("node").alias("b"), F.col("s").alias("y"), F.col("comp").alias("cb"), F.col("rest").alias("rb"), F.col("before").alias("pb"))
        first = (F.col("pa") != F.col("pb")) | (F.col("pa") == -1)
        on = (F.col("token") == F.col("_t")) & (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & first
        on = on & self.possible(F.col("x"), F.col("y"), F.least("ra", "rb"))
        met = stored(x.join(y, on).select("a", "x", "b", "y").distinct(), "met")
        release(self.docs.sparkSession)
        own = self.lists.groupBy("node").agg(F.collect_list("token").alias("own"))  # part of one document's prefix
        met = met.join(own.select(F.col("node").alias("a"), F.col("own").alias("ta")), "a").join(own.select(F.col("node").alias("b"), F.col("own").alias("tb")), "b")
        common = F.size(F.array_intersect("ta", "tb")).cast("long")
        return met.where(self.possible(F.col("x"), F.col("y"), common)).select("a", "b")

    def fetch(self, pairs: DataFrame) -> None:
        """Sets of the pairs' nodes that aren't there yet."""
        import pyarrow as pa

        want = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        if self.sets is not None:
            want = want.join(self.sets.select("node"), "node", "left_anti")
        want = stored(want, "wanted")
        bits, text, words = self.bloom_bits, self.text, self.words

        def spots(node: np.ndarray) -> list[np.ndarray]:
            x = node.astype(np.uint64)
            return [(mixed(x + np.uint64(k)) % np.uint64(bits)).astype(np.int64) for k in (1, 2, 3)]

        def mark(batches: Iterator) -> Iterator:
            own = np.zeros(bits, bool)
            for batch in batches:
                for spot in spots(np.asarray(batch.column("node"))):
                    own[spot] = True
            if own.any():
                yield pa.RecordBatch.from_arrays([pa.array([np.packbits(own).tobytes()], pa.binary())], ["bits"])

        merged = np.zeros(bits // 8, np.uint8)
        for row in want.coalesce(8).mapInArrow(mark, "bits binary").toLocalIterator():  # 8 rows of fixed size
            merged |= np.frombuffer(row.bits, np.uint8)
        if not merged.any():
            return
        bloom = self.docs.sparkSession.sparkContext.broadcast(merged)

        def compute(batches: Iterator) -> Iterator:
            flags = np.unpackbits(bloom.value).astype(bool)
            for batch in pieces(batches, text):
                shingles, offsets = shingle_sets(*joined_bytes(batch.column(text)), words)
                node = fold(shingles, offsets)
                hit = np.diff(offsets) > 0
                for spot in spots(node):
                    hit &= flags[spot]
                _, once = np.unique(node, return_index=True)  # copies side by side send one set
                rows = np.intersect1d(np.flatnonzero(hit), once)
                raw = shingles.astype("<u8").tobytes()
                if len(rows):
                    yield pa.RecordBatch.from_arrays([pa.array(node[rows]), pa.array([raw[8 * offsets[r]:8 * offsets[r + 1]] for r in rows], pa.binary())], ["node", "items"])

        found = self.docs.select(text).mapInArrow(compute, "node long, items binary").join(want, "node", "left_semi").groupBy("node").agg(F.first("items").alias("items"))
        found = stored(found, "sets")
        self.sets = found if self.sets is None else self.sets.unionByName(found)

    def verify(self, pairs: DataFrame) -> None:
        """Links among the pairs, by whole sets; they join the links so far."""
        import pyarrow as pa

        pairs = stored(pairs.select("a", "b"), "pairs")
        release(self.docs.sparkSession)
        self.fetch(pairs)
        release(self.docs.sparkSession)
        if self.sets is None:
            return
        up, down = self.threshold.numerator, self.threshold.denominator

        def linked(batches: Iterator) -> Iterator:
            for batch in batches:
                keep = np.zeros(batch.num_rows, bool)
                for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"))):
                    x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                    at = np.searchsorted(x, y)
                    common = int((x[np.minimum(at, len(x) - 1)] == y).sum())
                    keep[i] = common * down >= (len(x) + len(y) - common) * up
                yield batch.filter(pa.array(keep)).select(["a", "b"])

        x = self.sets.select(F.col("node").alias("a"), F.col("items").alias("x"))
        y = self.sets.select(F.col("node").alias("b"), F.col("items").alias("y"))
        new = pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(linked, "a long, b long")
        new = stored(new, "verified")
        self.links = new if self.links is None else self.links.unionByName(new)
        self.labels = components(self.links)
        release(self.docs.sparkSession)


def similarity_classes(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, threshold: Fraction = THRESHOLD,
    buckets: int = BUCKETS, bloom_bits: int = BLOOM_BITS, star_rounds: int = STAR_ROUNDS,
) -> DataFrame:
    """Per input row: doc_id, n_shingles, node (hash of its set) and component_id, the smallest id reachable by links."""
    join = Join(docs.select(key, text), key, text, words, threshold, buckets, bloom_bits)
    for turn in range(star_rounds):
        join.verify(join.star_pairs(turn))
    join.verify(join.cross_pairs())
    nodes = join.nodes.select("node", "least")
    if join.labels is not None:
        nodes = nodes.join(join.labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        least = nodes.groupBy("comp").agg(F.min("least").alias("component_id"))
        nodes = nodes.join(least, "comp").select("node", "component_id")
    else:
        nodes = nodes.withColumnRenamed("least", "component_id")
    some = join.rows.where("n > 0").join(nodes, "node", "left")
    none = join.rows.where("n = 0").withColumn("component_id", F.col("doc_id"))
    return some.unionByName(none, allowMissingColumns=True).select("doc_id", F.col("n").alias("n_shingles"), "node", "component_id")


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity classes of all documents."""
    return similarity_classes(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
