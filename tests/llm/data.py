"""Documents that every operator has to bear: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = SCHEMA + ", size long, h long, kept boolean, score double, key string, fp long, row long, word string, bin_id long"


def documents(n=60, seed=1, words=40):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(200)] + ["Élan", "über", "ПРИВЕТ", "naïve,", "END."]
    texts = [" ".join(rng.choices(vocab, k=rng.randint(1, words))) for _ in range(n)]
    texts[3] = texts[1].upper()  # equal to 1 but for case
    texts[5] = texts[4] + "!"
    texts[7] = texts[6]
    return [(i, t, "en", rng.choice(["a", "b", "c", "d"]), len(t)) for i, t in enumerate(texts)]


def hard():
    long_text = "Lorem ipsum dolor " * 8_000
    return [*documents(), (100, None, None, None, None), (101, "", "en", "a", 0), (102, " \n\t ", "en", "b", 4),
            (103, long_text, "en", "a", len(long_text)), (104, long_text.lower(), "en", None, None), (None, "orphan text here", "en", "a", 3),
            (105, "twice the same row", "de", "b", 18), (105, "twice the same row", "de", "b", 18), (None, None, None, None, None)]


def frame(spark, rows, odd=False):
    if not odd:
        return spark.createDataFrame(rows, SCHEMA)
    return spark.createDataFrame([(*r, 1, 2, True, 0.5, "k", 3, 4, "w", 5) for r in rows], ODD)
