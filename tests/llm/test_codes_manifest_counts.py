import collections
import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tokenizers
from helpers import documents, empty_documents
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagetide.llm import manifest, token_counts, vector_codes
from pagetide.llm.common import work_folder


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- vector codes ----------------------------------------------------------
def plain_codes(rows, entries=16, rounds=6):
    """vec_id, code, error, label_error, digest by brute force in plain integers."""
    kept = [(i, [math.floor(4096 * float(x)) for x in v], y) for i, v, y in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // 8
    pieces = np.array([v for _, v, _ in kept], np.int64).reshape(len(kept), 8, width)
    books = [pieces[:entries, p].tolist() for p in range(8)]

    def assign(p):
        d = ((pieces[:, p][:, None] - np.array(books[p])[None]) ** 2).sum(2)
        return d.argmin(1), d.min(1)

    for _ in range(rounds):
        for p in range(8):
            code, _ = assign(p)
            for e in range(len(books[p])):
                own = pieces[code == e, p]
                if len(own):
                    books[p][e] = [int(s) // len(own) for s in own.sum(0)]
    last = [assign(p) for p in range(8)]
    error = [int(sum(last[p][1][i] for p in range(8))) for i in range(len(kept))]
    by_label = collections.Counter()
    for (_, _, y), e in zip(kept, error):
        by_label[y] += e
    digest = sha(",".join(str(x) for b in books for e in b for x in e))
    return [(r[0], "".join(f"{last[p][0][i]:02x}" for p in range(8)), error[i], by_label[r[2]], digest) for i, r in enumerate(kept)]


def vectors(n, seed=1, width=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (6, width))
    rows = [(i, (centres[i % 6] + rng.normal(0, 0.05, width)).astype(np.float32).tolist(), i % 4) for i in range(n)]
    rows += [(None, rows[3][1], None), (None, rows[4][1], None), (5, rows[7][1], 2), (5, rows[7][1], 2), (n, [0.0] * width, None), (n + 1, [-1e30] + [0.0] * (width - 1), 1)]
    rows[2] = (2, None, 1)
    rows[9] = (9, [float("nan")] + rows[0][1][1:], 1)
    rows[10] = (10, [float("-inf")] + rows[0][1][1:], 1)
    rows[11] = (11, [None] + rows[0][1][1:], 1)
    return rows + [(n + 2 + i, rows[0][1], 3) for i in range(n // 2)]  # copies


SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("n", [14, 700])
def test_vector_codes_match_brute_force(spark, tmp_path, n):
    rows = vectors(n)
    held = [(i, [max(min(x, 2.0 ** 14), -(2.0 ** 14)) if x is not None and math.isfinite(x) else x for x in v] if v else v, y) for i, v, y in rows]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"rid": F.lit("x"), "code": F.lit(1), "part": F.lit(None).cast("int"), "error": F.lit(0)})
    df.repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = [tuple(r) for r in vector_codes.op11_vector_codes(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(plain_codes(held), key=repr)


def test_vector_codes_of_little_input(spark, tmp_path):
    for name, rows in (("few", [(3, [float(i) for i in range(8)], 1), (4, [0.25] * 8, None)]), ("none", [(1, None, 1), (2, [], 1), (3, [1.0, 2.0], 1)]), ("empty", [])):
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
        got = [tuple(r) for r in vector_codes.op11_vector_codes(spark, f"{tmp_path}/{name}").collect()]
        assert sorted(got, key=repr) == (sorted(plain_codes(rows), key=repr) if name == "few" else [])


def test_shortlists_hold_every_nearest_entry_and_are_short():
    rng = np.random.default_rng(5)
    listed = 0
    for _ in range(200):
        x = rng.integers(-50, 50, 8) + rng.integers(-6, 7, (40, 8))
        entries = rng.integers(-60, 60, (16, 8))
        entries[7] = entries[3]
        can = vector_codes.shortlists(x.min(0)[None], x.max(0)[None], entries[None])[0]
        d = ((x[:, None] - entries[None]) ** 2).sum(2)
        assert can[d.argmin(1)].all() and (np.flatnonzero(can)[vector_codes.nearest_entries(x, entries[can])] == d.argmin(1)).all()
        listed += can.sum()
    assert listed < 200 * 16 / 2


# ---- manifest --------------------------------------------------------------
def plain_manifest(rows):
    def leaf(d, text):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (d.doc_id, d.source, d.lang, d.n_chars, text)))

    def climb(level):
        paths, place = [[] for _ in level], list(range(len(level)))
        while len(level) > 1:
            for i, at in enumerate(place):
                run = level[at // 16 * 16:at // 16 * 16 + 16]
                paths[i].append(("".join(run[:at % 16]), "".join(run[at % 16 + 1:])))
            place = [at // 16 for at in place]
            level = [sha("".join(level[a:a + 16])) for a in range(0, len(level), 16)]
        return level[0], paths

    groups = collections.defaultdict(list)
    for d in rows:
        groups[d.source].append(d)
    trees = {}
    for s in sorted(groups, key=lambda s: (s is not None, (s or "").encode())):
        own = sorted(groups[s], key=lambda d: (d.doc_id is not None, d.doc_id or 0, leaf(d, d.text)))
        trees[s] = (own, *climb([leaf(d, d.text) for d in own]))
    root, above = climb([t[1] for t in trees.values()])
    lower = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    out = []
    for (own, subroot, paths), rest in zip(trees.values(), above):
        for d, path in zip(own, paths):
            touched = d.doc_id is not None and zlib.crc32(str(d.doc_id).encode()) % 5 == 0
            fold = leaf(d, d.text.translate(lower) if touched and d.text is not None else d.text)
            for left, right in path + rest:
                fold = sha(left + fold + right)
            out.append((d.doc_id, leaf(d, d.text), subroot, root, sha("".join(a + b for a, b in path + rest)), fold, fold == root))
    return out


def same_manifest(spark, docs, folder):
    docs.write.parquet(f"{folder}/documents.parquet")
    rows = spark.read.parquet(f"{folder}/documents.parquet").collect()
    got = [tuple(r) for r in manifest.op12_manifest(spark, folder).collect()]
    assert sorted(got, key=repr) == sorted(plain_manifest(rows), key=repr)
    return got


def test_manifest_matches_brute_force(spark, tmp_path):
    same_manifest(spark, documents(spark).drop("score", "node", "size"), f"{tmp_path}/a")
    sizes = {"big": 700, "run": 16, "more": 17, "block": 256, "beyond": 257, "one": 1, None: 5, "": 3, "é": 2}
    rng = random.Random(2)
    rows = [(i, rng.choice(["Ab", "cd", "", None]), "en", s, 2) for i, s in enumerate(x for s, n in sizes.items() for x in [s] * n)]
    rng.shuffle(rows)
    got = same_manifest(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(7), f"{tmp_path}/b")
    assert 0 < sum(r[-1] for r in got) < len(got)  # some texts were tampered with


@pytest.mark.parametrize("n", [1, 40])
def test_manifest_of_one_or_many_groups(spark, tmp_path, n):
    rows = [(i, f"T{i}", None, f"s{i}", None) for i in range(n)]
    got = same_manifest(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), f"{tmp_path}/c")
    assert n > 1 or got[0][1] == got[0][2] == got[0][3]


def test_manifest_of_an_empty_table(spark, tmp_path):
    empty_documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    assert manifest.op12_manifest(spark, str(tmp_path)).collect() == []


def test_manifest_carries_clashing_columns(spark):
    rows = spark.createDataFrame([(i, "s", sha(str(i)), i, i, i) for i in range(300)], "doc_id long, source string, leaf string, pos long, total long, digest long")
    out = manifest.manifest(rows.select("doc_id", "source", "leaf"), ("doc_id",))
    assert out.count() == 300 and out.select("root").distinct().count() == 1


# ---- token counts ----------------------------------------------------------
PATH = token_counts.vocabulary_file(token_counts.VOCABULARY)


def whole_counts(texts):
    model = tokenizers.Tokenizer.from_file(PATH)
    return [len(x.ids) for x in model.encode_batch(list(texts), add_special_tokens=False)]


def test_token_counts_match_the_library(spark, tmp_path):
    docs = documents(spark).unionByName(spark.createDataFrame(
        [(900, "a<|endoftext|>b <|endoftext|> c", None, None, None), (901, "x" * 300_000, None, None, None), (902, "word  　\x1c y" * 70_000, None, None, None)],
        "doc_id long, text string, lang string, source string, n_chars long"), allowMissingColumns=True)
    docs = docs.withColumns({"digest": F.lit(1), "n_tokens": F.lit("z"), "body": F.lit(None).cast("string"), "tokenizer": F.lit("t")})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = spark.read.parquet(f"{tmp_path}/documents.parquet").collect()
    want = [(r.doc_id, len((r.text or "").encode()), n, n > 1024) for r, n in zip(rows, whole_counts(r.text or "" for r in rows))]
    got = [tuple(r) for r in token_counts.op13_token_counts(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    empty = token_counts.count_tokens(empty_documents(spark), PATH, work_folder(spark, "cache"))
    assert empty.columns == ["doc_id", "n_bytes", "n_tokens"] and empty.count() == 0


@pytest.mark.parametrize("few", [0, 10_000])
def test_cache_encodes_distinct_misses_once(spark, few):
    docs, cache = documents(spark), work_folder(spark, "cache")
    words = token_counts.Vocabulary(PATH)

    def filled(rows, vocabulary=words):
        digests = rows.select(F.sha2(token_counts.content(F.col("text")), 256).alias("digest"))
        return token_counts.fill_cache(rows, digests, vocabulary, cache, few=few)

    texts = {r.text or "" for r in docs.collect()}
    some = docs.where("doc_id % 3 = 0")
    first = len({r.text or "" for r in some.collect()})
    assert filled(some) == first and filled(docs) == len(texts) - first and filled(docs) == 0
    assert spark.read.parquet(cache).count() == len(texts)
    before = token_counts.count_tokens(docs, PATH, cache, few=few).collect()
    spark.read.schema(token_counts.CACHE_SCHEMA).parquet(cache).write.mode("append").partitionBy("tokenizer").parquet(work_folder(spark, "copy"))
    spark.read.schema(token_counts.CACHE_SCHEMA).parquet(cache).limit(5).write.mode("append").partitionBy("tokenizer").parquet(cache)  # repeated rows
    assert sorted(map(repr, token_counts.count_tokens(docs, PATH, cache, few=few).collect())) == sorted(map(repr, before))
    other = token_counts.Vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    assert other.version != words.version and filled(docs, other) == len(texts)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_tokenizers_encode_whole_texts(spark, name):
    import sentencepiece

    path = public_tokenizers.path(name)
    docs = documents(spark).where("length(text) < 4000")
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, path, work_folder(spark, "cache")).collect() if r.doc_id is not None}
    if name.endswith("json"):
        model = tokenizers.Tokenizer.from_file(path)
        count = lambda x: len(model.encode(x, add_special_tokens=False).ids)
    else:
        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda x: len(pieces.encode(x))
    assert got == {r.doc_id: count(r.text or "") for r in docs.collect() if r.doc_id is not None}


COUNT = token_counts.Vocabulary(PATH).counter()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "B9", "'s", "é", " ", "  ", "\n", "\t", "\r", "\x0b", "\x1c", "\x85", " ", " ", "　", "​", "١", "!", "<|endoftext|>", "<|endof", "日本", "\U0001f600"]), max_size=20))
def test_cuts_count_like_whole_texts(parts):
    text = "".join(parts)
    assert COUNT([text]) == whole_counts([text])


def test_cuts_forget_and_count_on(monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED", 3)
    count = token_counts.Vocabulary(PATH).counter()
    texts = ["one two three four", "five " * 10 + "y" * 200, "one two", ""]
    assert count(texts) == count(texts) == whole_counts(texts)
