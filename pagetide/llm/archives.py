"""Operator 8: WARC archives; a normaliser for archives that are one gzip stream.

``write_monolithic`` writes records as Spark text files whose line separator is the record
end: each file is one gzip stream. ``normalise`` inflates such a file once, front to back,
rewrites every record as a gzip member of its own and returns the sidecar index (file,
offset, length per record) that is written beside it. ``read_records`` fetches members by
offset. Memory is bounded by the largest record.

Recovery: a task writes to a name of its own attempt and renames at the end; the same input
gives the same bytes, so a repeated task replaces a file with its equal.

Rows: null html is an empty payload; null url an empty target; repeated page_ids are pages
of their own unless page_id and payload agree in full (then equal records); null page_id is
kept as a missing id; an empty table gives no archive and an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetide.llm.common import table, work_folder

#: Payloads from this many bytes on are stored once.
REVISIT_BYTES = 1000
FILE_MB = 32
END = "\r\n\r\n"
READ = 1 << 20
LEVEL = 4
INDEX = "file string, offset long, length long, record_type string, record_id string, target string"
RECORDS = "record_type string, record_id string, target string, headers map<string,string>, payload binary"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_kinds(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages with digest and size, and (page_id, payload_digest, refers_to) of the revisits.

    Of the pages with one long payload the largest page_id answers for all. Only ids and
    digests meet here; a payload that a third of all pages share is combined by the aggregate.
    """
    body = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), body.alias("html"))
    keyed = rows.withColumn("payload_digest", F.sha1(F.encode("html", "utf-8"))).withColumn("payload_bytes", F.octet_length("html").cast("long"))
    firsts = keyed.where(F.col("payload_bytes") >= REVISIT_BYTES).groupBy("payload_digest").agg(
        F.max("page_id").alias("_first"), F.count(F.lit(1)).alias("_n"), ).where("_n > 1").select("payload_digest", "_first")
    ids = keyed.select("page_id", "payload_digest").join(firsts, "payload_digest").where("page_id < _first").groupBy("page_id", "payload_digest").agg(
        F.max("_first").alias("refers_to"))
    return keyed, ids


def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Payloads compressed for the way through the shuffle."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        batch["html"] = [squeeze(x.encode("utf-8")) for x in batch["html"]]
        yield batch


def as_records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each page as the text of its WARC record, without the record's end."""
    import zstandard

    unsqueeze = zstandard.ZstdDecompressor()
    for batch in batches:
        out = []
        for r in batch.itertuples(index=False):
            refers = None if pd.isna(r.refers_to) else int(r.refers_to)
            body = b"" if refers is not None else unsqueeze.decompress(r.html)
            lines = [
                "WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}",
                f"WARC-Record-ID: <urn:page:{'' if pd.isna(r.page_id) else int(r.page_id)}>",
                f"WARC-Target-URI: {' '.join(r.url.split())}", f"WARC-Payload-Digest: sha1:{r.payload_digest}",
                f"X-Payload-Bytes: {r.payload_bytes}", "Content-Type: text/html; charset=utf-8",
            ]
            if refers is not None:
                lines += [f"WARC-Refers-To: <urn:page:{refers}>", f"WARC-Profile: {PROFILE}"]
            lines.append(f"Content-Length: {len(body)}")
            out.append("\r\n".join(lines) + END + body.decode("utf-8"))
        yield pd.DataFrame({"value": out})


def write_monolithic(pages: DataFrame, folder: str) -> None:
    """Archives of all pages, each file one gzip stream."""
    keyed, ids = record_kinds(pages)
    cols = "page_id long, url string, html binary, payload_digest string, payload_bytes long"
    light = keyed.select("page_id", "url", "html", "payload_digest", "payload_bytes").mapInPandas(packed, cols)
    rows = light.join(ids, ["page_id", "payload_digest"], "left").select("page_id", "url", "html", "payload_digest", "payload_bytes", "refers_to")
    rows.mapInPandas(as_records, "value string").write.option("compression", "gzip").option("lineSep", END).text(folder)


def stream_records(source, into=None) -> Iterator[tuple[dict, bytes]]:
    """(headers, whole record) of an inflated stream, read piece by piece."""
    inflate, buffer = zlib.decompressobj(31), bytearray()

    def more() -> bool:
        nonlocal inflate
        while piece := source.read(READ):
            while piece:
                buffer.extend(inflate.decompress(piece))
                piece = inflate.unused_data
                if inflate.eof:  # a file of several members is read through as well
                    inflate = zlib.decompressobj(31)
            if buffer:
                return True
        return False

    while buffer or more():
        while (at := buffer.find(END.encode())) < 0:
            if not more():
                raise ValueError("an archive ends inside a header")
        headers = dict(line.split(": ", 1) for line in buffer[:at].decode("utf-8").split("\r\n")[1:])
        size = at + 4 + int(headers["Content-Length"]) + 4
        while len(buffer) < size:
            if not more():
                raise ValueError("an archive ends inside a record")
        yield headers, bytes(buffer[:size])
        del buffer[:size]


def normalise(spark: SparkSession, paths: DataFrame, folder: str) -> DataFrame:
    """Archives named in ``paths`` (column path) rewritten below ``folder``, a member per record; the index rows.

    Paths and folder are addresses that Arrow's file systems open (file, hdfs, s3, gs).
    """
    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid

        from pyarrow import fs

        for batch in batches:
            for path in batch["path"]:
                store, name = fs.FileSystem.from_uri(path)
                out_store, base = fs.FileSystem.from_uri(folder)
                out_store.create_dir(base, recursive=True)
                final = f"{base}/{hashlib.md5(path.encode()).hexdigest()}.warc.gz"
                mine, rows, at = f"{final}.{uuid.uuid4().hex}", [], 0
                with store.open_input_stream(name, compression=None) as source, out_store.open_output_stream(mine, compression=None) as out:
                    for headers, record in stream_records(source):
                        pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                        member = pack.compress(record) + pack.flush()
                        out.write(member)
                        rows.append((f"{folder}/{final.rsplit('/', 1)[1]}", at, len(member), headers["WARC-Type"], headers["WARC-Record-ID"], headers["WARC-Target-URI"]))
                        at += len(member)
                        if len(rows) >= 10_000:  # the index leaves the task piece by piece
                            yield pd.DataFrame(rows, columns=["file", "offset", "length", "record_type", "record_id", "target"])
                            rows = []
                out_store.move(mine, final)
                if rows:
                    yield pd.DataFrame(rows, columns=["file", "offset", "length", "record_type", "record_id", "target"])

    return paths.select("path").mapInPandas(rewrite, INDEX)


def read_records(index: DataFrame) -> DataFrame:
    """Records that an index points to, fetched member by member."""
    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        names = ["record_type", "record_id", "target", "headers", "payload"]
        for batch in batches:
            for path, rows in batch.sort_values("offset").groupby("file", sort=False):
                store, name = fs.FileSystem.from_uri(path)
                out, held = [], 0
                with store.open_input_file(name) as source:
                    for r in rows.itertuples(index=False):
                        record = zlib.decompress(source.read_at(r.length, r.offset), 31)
                        head, _, rest = record.partition(END.encode())
                        headers = dict(line.split(": ", 1) for line in head.decode("utf-8").split("\r\n")[1:])
                        payload = rest[:int(headers["Content-Length"])]
                        out.append((headers["WARC-Type"], headers["WARC-Record-ID"], headers["WARC-Target-URI"], headers, payload))
                        held += len(payload)
                        if held > 8 << 20:
                            yield pd.DataFrame(out, columns=names)
                            out, held = [], 0
                if out:
                    yield pd.DataFrame(out, columns=names)

    return index.mapInPandas(fetch, RECORDS)


def archive_pages(pages: DataFrame) -> DataFrame:
    """Pages written as monolithic archives, normalised, indexed; the index is stored beside the archives."""
    spark = pages.sparkSession
    folder = work_folder(spark, "warc")
    write_monolithic(pages, f"{folder}/stream")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(f"{folder}/stream").select("path")
    paths = files.repartition(max(spark.sparkContext.defaultParallelism, 1), "path")
    normalise(spark, paths, f"{folder}/members").write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the archives hold of every page, read back through the index."""
    records = read_records(archive_pages(table(spark, sf_dir, "pages")))
    number = F.regexp_extract
    refers = number(F.coalesce(F.col("headers")["WARC-Refers-To"], F.lit("")), "<urn:page:(-?[0-9]+)>", 1)
    # A response's digest and size are taken of the payload that came back, a revisit's stand in its headers.
    whole = F.col("record_type") == "response"
    return records.select(
        F.nullif(number("record_id", "<urn:page:(-?[0-9]*)>", 1), F.lit("")).cast("long").alias("page_id"),
        F.when(whole, F.length("payload")).otherwise(F.col("headers")["X-Payload-Bytes"].cast("long")).cast("long").alias("payload_bytes"),
        F.when(whole, F.sha1("payload")).otherwise(F.substring_index(F.col("headers")["WARC-Payload-Digest"], ":", -1)).alias("payload_digest"),
        "record_type", F.nullif(refers, F.lit("")).cast("long").alias("refers_to"),
    )


