"""Operator 4: repeated passages by prefix doubling over synchronised positions.

A byte goes if a string of ``LENGTH`` bytes over it also starts in a document of a smaller id.
Prefix doubling names the strings of growing length at every position and drops positions
whose name is unique. Names are hashes, so pairs of names combine without a global numbering.

Round 1 (16 bytes). Of the 16-byte strings inside a window of LENGTH bytes the one with the
smallest hash names the window; neighbouring windows with one name form a run. Equal windows
have equal names, so runs stand for all positions at an eighteenth of their number. Tasks
sort their runs by name and send them to the name's partition; names that stand for one run
of bytes only are dropped there. Runs whose whole bytes also stand in a smaller document are
settled; runs whose name is shared by other bytes go on.
Round 2 (33 bytes). A window reaches 17 bytes to the left or to the right of its name's
string. One byte of hash of either side says whether another run of that name can share it;
windows on sides that nothing shares are dropped.
Round 3 (LENGTH bytes). The windows left get the pair of their names at offset 0 and at
LENGTH - 32; Spark sorts by (pair, document) and a pass over the sorted rows keeps windows
whose pair stands in a smaller document.

The result is exact up to collisions of 64-bit hashes. Memory: a round 1 partition holds its
runs (26 bytes each), so spark.sql.shuffle.partitions has to grow with the input. Texts move only for documents with hits,
compressed; a Bloom filter of fixed size finds those.

Rows: null text is empty; null doc_id counts as larger than every other; rows of one doc_id
don't remove each other's bytes; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetide.llm.common import joined_bytes, mixed, pieces, release, stored, table

LENGTH = 50
GRAM = 16
SIDE = 17
MOST_RUN = 64
FLUSH = 8 << 20
BLOOM_BITS = 1 << 24
LAST = (1 << 63) - 1
_B = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_B), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


class Hashes:
    """64-bit hash of any slice of some bytes, from running sums."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        if len(_powers.get("up", ())) < n + 1:
            for name, base in (("up", _B), ("down", _INVERSE)):
                row = np.full(n + 1, base, np.uint64)
                row[0] = 1
                _powers[name] = np.cumprod(row, dtype=np.uint64)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers["up"][:n], out=self.sums[1:])

    def of(self, start: np.ndarray, length) -> np.ndarray:
        body = (self.sums[start + length] - self.sums[start]) * _powers["down"][start]
        return mixed(body ^ np.asarray(length).astype(np.uint64))


def runs_of(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Runs of windows with one name: row, pos (in the row), windows, name, bytes' hash, sides' hashes, place of the string."""
    n, span = len(data), LENGTH - GRAM + 1
    lengths = np.diff(offsets)
    fit = np.maximum(lengths - LENGTH + 1, 0)
    total = int(fit.sum())
    if not total:
        return {"row": np.zeros(0, np.int64)}
    padded = np.zeros(n + 16, np.uint8)
    padded[:n] = data
    eight = np.ndarray((n + 8,), "<u8", padded.data, 0, (1,)).copy()
    grams = mixed(eight[:n] * _B ^ mixed(eight[8:n + 8]))
    least, step = grams, 1
    while step * 2 <= span:
        least, step = np.minimum(least[:-step], least[step:]), step * 2
    if span > step:
        rest = span - step
        least = np.minimum(least[:len(least) - rest], least[rest:])
    rows = np.repeat(np.arange(len(lengths)), fit)
    at = np.arange(total) - np.repeat(np.cumsum(fit) - fit, fit) + offsets[:-1][rows]
    names = least[at]
    fresh = np.ones(total, bool)
    fresh[1:] = (names[1:] != names[:-1]) | (at[1:] != at[:-1] + 1) | (rows[1:] != rows[:-1])
    begin = np.flatnonzero(fresh)
    long = np.diff(np.append(begin, total))
    if long.max() > MOST_RUN:  # periodic text: cut, so that the bytes of a run stay short
        place = np.arange(total) - np.repeat(begin, long)
        begin = np.flatnonzero(place % MOST_RUN == 0)
        long = np.diff(np.append(begin, total))
    start, name, row = at[begin], names[begin], rows[begin]
    last = start + long - 1
    # Where the name's string stands: once in all windows of a regular run.
    found, spot = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
    for k in range(span):
        hit = grams[last + k] == name
        spot[hit & (found == 0)] = k
        found += hit
    anchor = last + spot
    for k in range(1, span):
        early = last - k
        inside = early >= start
        found += inside & (grams[np.maximum(early, 0)] == name)
    odd = (found != 1) | (anchor > start + span - 1)
    sums = Hashes(data)
    low, high = offsets[row], offsets[row + 1]
    left_ok, right_ok = anchor - SIDE >= low, anchor + GRAM + SIDE <= high

    def side(begin: np.ndarray, ok: np.ndarray, missing: int) -> np.ndarray:
        byte = (sums.of(np.where(ok, begin, 0), SIDE) % np.uint64(253)).astype(np.uint8)
        return np.where(odd, 255, np.where(ok, byte, missing)).astype(np.uint8)

    return {
        "row": row, "pos": start - low, "size": long, "name": name, "whole": sums.of(start, long + LENGTH - 1),
        "left": side(anchor - SIDE, left_ok, 253), "right": side(anchor + GRAM, right_ok, 253),
        "place": np.where(odd, 0, anchor - start),
    }


def _packed(name: np.ndarray, parts: list[np.ndarray]) -> bytes:
    """Columns of runs, one after the other, compressed."""
    import zstandard

    low = np.ascontiguousarray(name.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6]
    doc = parts[1]
    small = int(doc.max()) - int(doc.min()) < 1 << 32
    base = int(doc.min()) if small else 0
    doc = (doc - base).astype("<u4") if small else doc.astype("<i8")
    body = [np.array([len(name), base, small], "<i8").tobytes(), low.tobytes(), parts[0].astype("<u8").tobytes(), doc.tobytes(), parts[2].astype("<u4").tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(body + [x.astype("u1").tobytes() for x in parts[3:]]))


def _unpacked(blob: bytes) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, base, small = np.frombuffer(raw, "<i8", 3).tolist()
    at, out = 24, []
    low = np.zeros((n, 8), np.uint8)
    low[:, :6] = np.frombuffer(raw, np.uint8, 6 * n, at).reshape(n, 6)
    out.append(low.view("<u8").ravel())
    at += 6 * n
    for kind in ("<u8", "<u4" if small else "<i8", "<u4", "u1", "u1", "u1", "u1"):
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * np.dtype(kind).itemsize
    out[2] = out[2].astype(np.int64) + base
    return out


def settle(name, whole, doc, pos, size, left, right, place) -> tuple[np.ndarray, ...]:
    """Rounds 1 and 2 over all runs of some names: (doc, pos, n, check, settled) of what is covered or goes on."""
    order = np.lexsort((doc, whole, name))
    name, whole, doc, pos, size, left, right, place = (x[order] for x in (name, whole, doc, pos, size, left, right, place))
    new_name = np.insert(name[1:] != name[:-1], 0, True)
    new_whole = new_name | np.insert(whole[1:] != whole[:-1], 0, True)
    group, own = np.cumsum(new_name) - 1, np.cumsum(new_whole) - 1
    covered = doc > doc[np.flatnonzero(new_whole)][own]  # doc ascends inside equal bytes
    many = np.bincount(group, new_whole)[group] > 1
    todo = ~covered & many
    shared = []
    heads = np.flatnonzero(new_whole & many)
    wild = np.zeros(group[-1] + 1, bool)
    wild[group[heads[(left[heads] == 255) | (right[heads] == 255)]]] = True
    for byte in (left, right):
        key = group[heads] * 256 + byte[heads]
        kinds, counts = np.unique(key, return_counts=True)
        mine = group * 256 + byte
        at = np.minimum(np.searchsorted(kinds, mine), max(len(kinds) - 1, 0))
        shared.append((counts[at] > 1) & (kinds[at] == mine) if len(kinds) else np.zeros(len(name), bool))
    free = wild[group]
    size, pos, place = size.astype(np.int64), pos.astype(np.int64), place.astype(np.int64)
    turn = place - SIDE  # windows up to here reach SIDE bytes to the left, those from here to the right
    out = [(doc[covered], pos[covered], size[covered], whole[covered], np.ones(covered.sum(), bool))]
    for use, low, high in (
        (todo & free, np.zeros_like(size), size - 1),
        (todo & ~free & shared[0], np.zeros_like(size), np.minimum(size - 1, turn)),
        (todo & ~free & shared[1], np.maximum(0, np.where(shared[0], turn + 1, turn)), size - 1),
    ):
        use = use & (low <= high)
        out.append((doc[use], (pos + low)[use], (high - low + 1)[use], np.zeros(use.sum(), np.uint64), np.zeros(use.sum(), bool)))
    return tuple(np.concatenate(x) for x in zip(*out))


FOUND = "doc long, pos long, size long, check long, settled boolean"


def _found(doc, pos, size, check, settled):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays(
        [pa.array(doc), pa.array(pos), pa.array(size), pa.array(check.astype(np.int64)), pa.array(settled)], ["doc", "pos", "size", "check", "settled"])


def shared_runs(docs: DataFrame) -> DataFrame:
    """Rounds 1 and 2 of docs (doc, text)."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def send(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held, size = [], 0

        def flush() -> Iterator:
            cols = [np.concatenate([h[k] for h in held]) for k in ("name", "whole", "doc", "pos", "size", "left", "right", "place")]
            if len(cols[0]):
                bucket = (mixed(cols[0]) % np.uint64(n)).astype(np.int64)
                order = np.lexsort((cols[0], bucket))
                cols, bucket = [c[order] for c in cols], bucket[order]
                edges = np.searchsorted(bucket, np.arange(n + 1))
                full = [b for b in range(n) if edges[b] < edges[b + 1]]
                yield pa.RecordBatch.from_arrays([
                    pa.array(full, pa.int32()),
                    pa.array([_packed(cols[0][edges[b]:edges[b + 1]], [c[edges[b]:edges[b + 1]] for c in cols[1:]]) for b in full], pa.binary()),
                ], ["bucket", "runs"])

        for batch in pieces(batches, most=1 << 20):
            data, offsets = joined_bytes(batch.column("text"))
            run = runs_of(data, offsets)
            if len(run["row"]):
                run["doc"] = np.asarray(batch.column("doc"))[run["row"]]
                held.append(run)
                size += len(data)
            if size >= FLUSH:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    def meet(batches: Iterator) -> Iterator:
        held = [[] for _ in range(8)]
        for batch in batches:
            for blob in batch.column("runs"):
                for k, x in enumerate(_unpacked(blob.as_buffer().to_pybytes())):
                    held[k].append(x)
        if held[0]:
            got = settle(*(np.concatenate(x) for x in held))
            for a in range(0, len(got[0]), 100_000):
                yield _found(*(x[a:a + 100_000] for x in got))

    return docs.mapInArrow(send, "bucket int, runs binary").repartitionById(n, F.col("bucket")).mapInArrow(meet, FOUND)


def touched(docs: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents with hits as (doc, packed text), and the others as they are; a hit that the filter only guesses is harmless."""
    bits = BLOOM_BITS

    def spots(doc: np.ndarray) -> list[np.ndarray]:
        x = doc.astype(np.int64).view(np.uint64)
        return [(mixed(x + np.uint64(k)) % np.uint64(bits)).astype(np.int64) for k in (1, 2, 3)]

    def mark(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = np.zeros(bits, bool)
        for batch in batches:
            for spot in spots(np.asarray(batch.column("doc"))):
                own[spot] = True
        if own.any():
            yield pa.RecordBatch.from_arrays([pa.array([np.packbits(own).tobytes()], pa.binary())], ["bits"])

    merged = np.zeros(bits // 8, np.uint8)
    for row in found.select("doc").distinct().coalesce(8).mapInArrow(mark, "bits binary").toLocalIterator():  # 8 rows of fixed size
        merged |= np.frombuffer(row.bits, np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(merged)

    def split(keep: bool):
        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa
            import zstandard

            flags, squeeze = np.unpackbits(shared.value).astype(bool), zstandard.ZstdCompressor(level=1).compress
            for batch in pieces(batches):
                hit = np.ones(batch.num_rows, bool)
                for spot in spots(np.asarray(batch.column("doc"))):
                    hit &= flags[spot]
                part = batch.filter(pa.array(hit == keep))
                if keep and part.num_rows:
                    texts = pa.array([squeeze((x or "").encode()) for x in part.column("text").to_pylist()], pa.binary())
                    yield pa.RecordBatch.from_arrays([part.column("doc"), texts], ["doc", "packed"])
                elif part.num_rows:
                    yield part
        return run

    return docs.mapInArrow(split(True), "doc long, packed binary"), docs.mapInArrow(split(False), docs.schema)


def window_names(packed: DataFrame, going: DataFrame) -> DataFrame:
    """Round 3 rows: each window left with the name of its pair of names."""
    lists = going.groupBy("doc").agg(F.collect_list(F.struct("pos", "size")).alias("at"))  # of one document

    def name(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for i in range(batch.num_rows):
                data = np.frombuffer(unpack.decompress(batch.column("packed")[i].as_py()), np.uint8)
                at = batch.column("at")[i].values
                pos, size = np.asarray(at.field("pos")), np.asarray(at.field("size"))
                each = np.repeat(pos, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                each = np.unique(each[each <= len(data) - LENGTH])  # rows of one id share the list
                if len(each):
                    sums, half = Hashes(data), 32
                    pair = mixed(sums.of(each, half) ^ mixed(sums.of(each + LENGTH - half, half)))
                    yield pa.RecordBatch.from_arrays([
                        pa.array(pair.astype(np.int64)), pa.array(np.full(len(each), batch.column("doc")[i].as_py())), pa.array(each)], ["pair", "doc", "pos"])

    return packed.join(lists, "doc").select("doc", "packed", "at").mapInArrow(name, "pair long, doc long, pos long")


def repeated_windows(names: DataFrame) -> DataFrame:
    """Windows whose pair of names stands in a smaller document, from rows sorted by (pair, doc)."""
    def scan(batches: Iterator) -> Iterator:
        last = None  # pair and smallest doc of the list that is open
        for batch in batches:
            if not batch.num_rows:
                continue
            pair, doc, pos = (np.asarray(batch.column(k)) for k in ("pair", "doc", "pos"))
            fresh = np.insert(pair[1:] != pair[:-1], 0, True)
            least = doc[np.flatnonzero(fresh)]
            if last is not None and pair[0] == last[0]:
                least[0] = last[1]
            own = np.cumsum(fresh) - 1
            last = (pair[-1], least[-1])
            hit = doc > least[own]
            yield _found(doc[hit], pos[hit], np.ones(hit.sum(), np.int64), pair[hit], np.zeros(hit.sum(), bool))

    return names.repartition("pair").sortWithinPartitions("pair", "doc").mapInArrow(scan, FOUND)


RESULT = "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>"


def cut_repeats(packed: DataFrame, covered: DataFrame) -> DataFrame:
    """Every packed document with its covered bytes removed; each window is checked against the text at hand."""
    lists = covered.groupBy("doc").agg(F.collect_list(F.struct("pos", "size", "check", "settled")).alias("at"))  # of one document

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                data = np.frombuffer(unpack.decompress(batch.column("packed")[i].as_py()), np.uint8)
                edge, at = np.zeros(len(data) + 1, np.int64), batch.column("at")[i]
                if at.is_valid and len(data) >= LENGTH:
                    pos, size, check, settled = (np.asarray(at.values.field(k)) for k in ("pos", "size", "check", "settled"))
                    ok = pos + size + LENGTH - 1 <= len(data)
                    pos, size, check, settled = pos[ok], size[ok], check[ok], settled[ok]
                    sums = Hashes(data)
                    pair = mixed(sums.of(pos, 32) ^ mixed(sums.of(pos + LENGTH - 32, 32)))
                    true = np.where(settled, sums.of(pos, size + LENGTH - 1), pair) == check.view(np.uint64)
                    np.add.at(edge, pos[true], 1)
                    np.add.at(edge, pos[true] + size[true] + LENGTH - 1, -1)
                gone = np.cumsum(edge)[:-1] > 0
                turns = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                spans = [{"start": a, "end": b} for a, b in turns.reshape(-1, 2).tolist()]
                out.append((batch.column("doc")[i].as_py(), len(data), int(gone.sum()), len(spans), hashlib.sha256(data[~gone].tobytes()).hexdigest(), spans))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], [c.split()[0] for c in RESULT.split(", ")])

    return packed.join(lists, "doc", "left").select("doc", "packed", "at").mapInArrow(cut, RESULT)


def repeated_bytes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, n_bytes, n_removed, n_spans, kept_sha256 and the removed spans (byte offsets), a row per document."""
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = stored(shared_runs(rows), "runs")
    release(docs.sparkSession)
    packed, clean = touched(rows, found)
    packed = stored(packed, "touched")
    again = stored(repeated_windows(window_names(packed, found.where("not settled").select("doc", "pos", "size"))), "windows")
    release(docs.sparkSession)
    covered = found.where("settled").unionByName(again)
    body = F.encode("text", "utf-8")
    whole = clean.select("doc", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"),
                         F.sha2(body, 256).alias("kept_sha256"), F.array().cast("array<struct<start:long,end:long>>").alias("spans"))
    return cut_repeats(packed, covered).unionByName(whole)


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes that repeat a smaller one's."""
    found = repeated_bytes(table(spark, sf_dir, "documents"))
    return found.select(F.nullif("doc", F.lit(LAST)).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
