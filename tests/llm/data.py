"""Small tables with the awkward rows every operator must take."""
from __future__ import annotations

import random
import re

SCHEMA = "doc_id long, text string, lang string, node string, size int, key long, score string, _slot int, `a.b` int"

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, lower=True):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER) if lower else text or "")


def make_texts(seed=3, groups=12, per=6, size=60, vocab=400):
    """Groups of near copies of random texts (some words replaced), exact copies, a shared passage, short texts."""
    rng = random.Random(seed)
    pool = [f"w{i}é" if i % 7 == 0 else f"Word{i}" for i in range(vocab)]
    out = []
    shared = " ".join(rng.choice(pool) for _ in range(25))
    for g in range(groups):
        base = [rng.choice(pool) for _ in range(size + 10 * g)]
        for c in range(per):
            t = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 6])):
                t[rng.randrange(len(t))] = rng.choice(pool)
            s = " ".join(w + ("\n" if rng.random() < 0.08 else "") for w in t)
            out.append(s + ("\n" + shared if c % 3 == 0 else ""))
    out += [out[0], out[7], "one", "One", "two words", "two  words\t", "a b c", "", " \n\t", "x" * 5000, "é" * 50]
    rng.shuffle(out)
    return out


def awkward(spark, texts=None):
    """Rows with texts, then null text, null id, a repeated row, one id with two texts."""
    texts = make_texts() if texts is None else texts
    rows = [(i, t) for i, t in enumerate(texts)]
    n = len(rows)
    rows += [(n, None), (None, texts[0]), (None, None), (n + 1, texts[1]), (n + 1, texts[1]), (n + 2, texts[2]),
             (n + 2, "quite another text of this id")]
    return rows, spark.createDataFrame([(i, t, "en", "x", 1, 2, "s", 3, 4) for i, t in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
