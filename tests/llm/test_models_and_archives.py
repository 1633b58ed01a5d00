import gzip
import hashlib
import io
import itertools
import random
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from helpers import empty_documents, sentence, words
from pyspark.sql import functions as F

from pagetide.llm import archives, neighbours, quality, toxicity
from pagetide.llm.common import joined_bytes, word_hashes, words_of


def auc(score, y):
    order = np.argsort(np.argsort(score))
    ones = y.sum()
    return (order[y == 1].sum() - ones * (ones - 1) / 2) / ones / (len(y) - ones)


def test_words_are_those_of_the_rule():
    texts = ["A b\tC", "", None, "x", "é ü  A", " lead", "trail ", "longerthaneightbytes LONGERTHANEIGHTBYTES", "a b"]
    data, offsets = joined_bytes(pa.array(texts))
    starts, stops, rows = words_of(data, offsets)
    hashes = word_hashes(data, starts, stops)
    got = [[] for _ in texts]
    for h, r in zip(hashes.tolist(), rows.tolist()):
        got[r].append(h)
    plain = [words(t) for t in texts]
    assert [len(x) for x in got] == [len(x) for x in plain]
    names = {}
    for hs, ws in zip(got, plain):
        for h, w in zip(hs, ws):
            assert names.setdefault(w, h) == h
    assert len(set(names.values())) == len(names)


def labelled(spark, kind):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(600):
        y = i % 3 == 0
        text = sentence(rng, 60)
        if kind == "toxic" and y:
            w = text.split()
            for k in (5, 20, 40):
                w[k] = rng.choice(["badword", "Nastyish,", "nastyous"])
            text = " ".join(w)
        if kind == "quality" and not y:
            text = " ".join(f"{w}{rng.choice(['&&&', '###'])}" for w in text.split())
        docs.append((i, text))
        labels.append((i, int(y)))
    docs += [(1000, None), (1001, ""), (1002, "   "), (None, "no id here"), (3, docs[3][1]), (1003, "w1 " * 20000)]
    labels += [(5, None), (None, 1), (99999, 1), (3, 1), (3, 1)]
    frame = spark.createDataFrame([(*d, "x", "y") for d in docs], "doc_id long, text string, score string, spans string")
    return frame, spark.createDataFrame([(i, y) for i, y in labels], f"doc_id long, {kind} int"), docs


def test_quality_separates_held_out_documents(spark):
    docs, labels, rows = labelled(spark, "quality")
    scored = quality.score_quality(docs, quality.fit(docs, labels))
    out = scored.collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    own = [(r.score, r.doc_id % 3 == 0) for r in out if r.doc_id is not None and r.doc_id < 600 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert auc(np.array([s for s, _ in own]), np.array([int(y) for _, y in own])) > 0.97
    assert quality.fit(docs, labels.where("quality = 1")) is None
    assert {r.score for r in quality.score_quality(docs, None).collect()} == {0.5}
    model = quality.fit(docs, labels)
    assert quality.score_quality(docs.limit(0), model).count() == 0
    assert quality.fit(empty_documents(spark).select("doc_id", "text"), labels) is None


def test_quality_counts_the_whole_text():
    rng = random.Random(8)
    good, bad = sentence(rng, 3000).encode(), (sentence(rng, 3000).replace(" ", "&&& ")).encode()
    model = quality.Model(quality.build_dictionary([good[i:i + 500] for i in range(0, 8000, 500)], 4096),
                          quality.build_dictionary([bad[i:i + 500] for i in range(0, 8000, 500)], 4096), np.array([0.0, 1, 0, 0]))
    base = sentence(rng, 1000)
    x = model.features(pa.array([base, base + " " + "w1&&& w2&&& " * 2000]))
    assert x[1, 0] < x[0, 0]


def test_toxicity_finds_words_and_spans(spark):
    docs, labels, rows = labelled(spark, "toxic")
    tagger = toxicity.fit(docs, labels)
    out = toxicity.score_toxicity(docs, tagger).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    own = [(r.score, r.doc_id % 3 == 0) for r in out if r.doc_id is not None and r.doc_id < 600 and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert auc(np.array([s for s, _ in own]), np.array([int(y) for _, y in own])) > 0.99
    for r in out:
        if r.doc_id is not None and r.doc_id < 600 and r.doc_id % 3 == 0:
            found = [r.text.encode()[s.start:s.end].decode() for s in r.spans]
            assert any("badword" in f or "asty" in f for f in found)
    assert toxicity.fit(docs, labels.where("toxic = 0")) is None
    blank = docs.selectExpr("doc_id", "if(doc_id % 2 = 0, '', null) AS text")
    assert toxicity.fit(blank, labels) is None
    assert {(r.score, len(r.spans)) for r in toxicity.score_toxicity(docs, None).collect()} == {(0.0, 0)}
    assert toxicity.score_toxicity(docs.limit(0), tagger).count() == 0


def test_chain_marginals_match_enumeration():
    rng = np.random.default_rng(3)
    trans, start = np.array([[1.0, 0.3], [0.4, 2.0]]), np.array([1.0, 1.0])
    lengths = np.array([1, 7, 10])
    emission = rng.normal(size=lengths.sum())
    got, at = toxicity.chain_marginals(emission, lengths, trans, start), 0
    for n in lengths:
        e, sums = emission[at:at + n], np.zeros((n, 2))
        for path in itertools.product((0, 1), repeat=int(n)):
            p = start[path[0]] * np.exp(sum(e[i] for i in range(n) if path[i])) * np.prod([trans[a, b] for a, b in zip(path, path[1:])])
            for i, s in enumerate(path):
                sums[i, s] += p
        assert np.allclose(got[at:at + n], sums[:, 1] / sums.sum(1))
        at += n
    long = rng.normal(size=1000)
    whole = toxicity.chain_marginals(long, np.array([1000]), trans, start)
    m, ahead = start * [1, np.exp(long[0])], []
    for i in range(1000):
        m = m if i == 0 else (m / m.sum() @ trans) * [1, np.exp(long[i])]
        ahead.append(m / m.sum())
    b, want = np.ones(2), np.zeros(1000)
    for i in range(999, -1, -1):
        both = ahead[i] * b
        want[i] = both[1] / both.sum()
        b = trans @ (b * [1, np.exp(long[i])])
        b /= b.sum()
    assert np.allclose(whole, want)


def test_hilbert_keys_are_a_curve():
    side, cells = 4, np.array(list(itertools.product(range(16), repeat=2)))
    order = np.argsort(neighbours.hilbert_keys(cells, side))
    assert sorted(neighbours.hilbert_keys(cells, side).tolist()) == list(range(256))
    assert (np.abs(np.diff(cells[order], axis=0)).sum(1) == 1).all()


def vectors(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(700, 12))
    rows = [(i, v.tolist(), "s") for i, v in enumerate(x)]
    rows += [(700 + i, x[0].tolist(), "s") for i in range(60)]  # copies
    rows += [(800, None, "s"), (801, [0.0] * 12, "s"), (802, [float("nan")] * 12, "s"), (803, [1.0] * 3, "s"), (804, [None] * 12, "s"),
             (820, [float("inf")] * 12, "s"), (None, x[1].tolist(), "s"), (20, x[20].tolist(), "s")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string"), rows


def test_neighbours_against_brute_force(spark):
    frame, rows = vectors(spark)
    got = neighbours.nearest(frame, F.col("vec_id") % 20 == 0, orderings=12, window=128).collect()
    use = {i: np.array(v) for i, v, _ in rows if i is not None and v and len(v) == 12 and None not in v and np.isfinite(v).all() and np.any(v)}
    ids = np.array(sorted(use))
    x = np.stack([use[i] for i in ids])
    hits = total = 0
    for q in [i for i in ids if i % 20 == 0]:
        s = x @ use[q]
        best = [int(ids[k]) for k in np.lexsort((ids, -s.round(9))) if ids[k] != q][:20]
        own = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [r[0] for r in own] == list(range(1, 21))
        assert all(abs(r[2] - use[q] @ use[r[1]]) < 1e-9 for r in own)
        hits += len(set(best) & {r[1] for r in own})
        total += 20
    assert hits / total > 0.9
    assert {r.query_id for r in got} == {i for i in ids if i % 20 == 0}
    copies = [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == 700]
    assert copies[:20] == [0, *range(701, 720)]
    few = neighbours.nearest(frame.where("vec_id < 4"), F.col("vec_id") == 0).collect()
    assert len(few) == 3
    assert neighbours.nearest(frame.limit(0), F.lit(True)).count() == 0


PAGES = [
    (1, "http://a/1", "<p>" + "long page é " * 200), (2, "http://a/2\r\nX: y", "<p>" + "long page é " * 200), (3, None, "short"), (4, "u", "short"),
    (5, "u", None), (6, "u", ""), (7, "u", "<p>\r\n\r\nWARC/1.1\r\n\r\n" + "x" * 3000), (None, "u", "no id"), (9, "u", "z" * 999), (10, "u", "z" * 999),
    (11, "u", "q" * 1000), (12, "u", "q" * 1000), (13, "u", "q" * 1000),
]


def test_archives_round_trip(spark):
    pages = spark.createDataFrame([(*p, "c") for p in PAGES], "page_id long, url string, html string, payload_bytes string")
    index = archives.archive_pages(pages)
    got = {r.record_id: r for r in archives.read_records(index).collect()}
    assert len(got) == len(PAGES)
    last = {}
    for i, _, html in PAGES:
        if html and len(html.encode()) >= archives.REVISIT_BYTES:
            last[html] = max(last.get(html, 0), i)
    for i, _, html in PAGES:
        r = got[f"<urn:page:{'' if i is None else i}>"]
        assert r.record_type == ("revisit" if last.get(html, i) != i else "response")
        assert bytes(r.payload) == (b"" if r.record_type == "revisit" else (html or "").encode())
        assert r.headers["WARC-Payload-Digest"] == "sha1:" + hashlib.sha1((html or "").encode()).hexdigest()
    rows = index.collect()
    for r in rows:  # every member stands alone
        data = open(r.file.removeprefix("file://"), "rb").read()
        assert gzip.decompress(data[r.offset:r.offset + r.length]).startswith(b"WARC/1.1\r\n")
    assert archives.archive_pages(pages.limit(0)).count() == 0


def test_stream_reader_takes_one_or_many_members():
    record = lambda n: f"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: {n}\r\n\r\n".encode() + b"x" * n + b"\r\n\r\n"
    records = [record(n) for n in (0, 5, 3_000_000, 1)]
    for data in (gzip.compress(b"".join(records)), b"".join(map(gzip.compress, records))):
        assert [r for _, r in archives.stream_records(io.BytesIO(data))] == records
    with pytest.raises(ValueError):
        list(archives.stream_records(io.BytesIO(gzip.compress(records[1][:-3]))))


@pytest.mark.parametrize(("n", "window"), [(1500, 256), (4000, 512), (9000, 1024)])
def test_neighbour_recall_where_windows_are_a_small_part(spark, n, window):
    """Windows of a sixth to a ninth of the table: recall against brute force, and exact scores."""
    rng = np.random.default_rng(n)
    centres = rng.normal(0, 1, (max(2, n // 150), 32))
    vectors = (centres[rng.integers(0, len(centres), n)] + rng.normal(0, 0.4, (n, 32))).astype(np.float32)
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(n), "embedding": vectors.tolist()}))
    got = neighbours.nearest(df, F.col("vec_id") % 50 == 0, window=window).toPandas()
    wide, found, total = vectors.astype(np.float64), 0, 0
    for query in range(0, n, 50):
        sims = wide @ wide[query]
        sims[query] = -np.inf
        best = set(np.argsort(-sims, kind="stable")[:20].tolist())
        own = got[got["query_id"] == query]
        assert own["rank"].tolist() == list(range(1, 21)) and np.allclose(own["score"], sims[own["vec_id"]], rtol=1e-9)
        found, total = found + len(best & set(own["vec_id"])), total + 20
    assert found / total >= 0.9, found / total
