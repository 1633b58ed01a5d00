"""Small inputs with every awkward case, and plain rules to compare with."""

import random
import re

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, node string, size string"
_LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_LOWER))


def sentence(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}é" if rng.random() < 0.1 else f"w{rng.randrange(vocabulary)}" for _ in range(n))


def documents(spark, seed=1):
    """Nulls in every column, empty, blank and very long texts, exact and near copies, repeated rows, clashing columns."""
    rng = random.Random(seed)
    texts = [sentence(rng, rng.randrange(5, 120)) for _ in range(40)]
    base = sentence(rng, 150)
    for k in range(12):  # near copies
        w = base.split()
        w[10 * k % 150] = f"x{k}"
        texts.append(" ".join(w))
    texts += [texts[0], texts[0], texts[1].upper(), None, "", " \t\n ", "one two", "ONE two", sentence(rng, 6000), "a " * 3000, texts[3] + " " + texts[4]]
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or ""), 0.5, "n", "z") for i, t in enumerate(texts)]
    rows += [rows[5], (None, "without an id " * 9, None, None, None, None, None, None), (None, None, None, "s1", None, None, None, None)]
    return spark.createDataFrame(rows, DOC_SCHEMA)


def empty_documents(spark):
    return spark.createDataFrame([], DOC_SCHEMA)
