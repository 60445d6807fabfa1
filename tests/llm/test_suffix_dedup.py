import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from letterlens.llm import suffix_dedup as s

from .data import documents, frame, hard


def brute(rows):
    """Windows in order of documents and starts; all but the first of equal ones are marked."""
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - 99):
            w = data[p:p + 100]
            if w in seen:
                gone[p:p + 100] = True
            seen.add(w)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out.append((doc_id, len(data), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def corpus(seed, n=80):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(1, 6)))
    passages = [" ".join(word() for _ in range(rng.randint(15, 70))) for _ in range(6)]
    texts = []
    for i in range(n):
        parts = [rng.choice(passages)[rng.randint(0, 20):] if rng.random() < 0.3 else " ".join(word() for _ in range(rng.randint(1, 25))) for _ in range(rng.randint(0, 8))]
        texts.append(" ".join(parts))
        if i % 9 == 8:
            texts[-1] = texts[rng.randint(0, i - 1)]
        if i % 11 == 10 and texts[i - 3]:
            t = texts[i - 3]
            k = rng.randint(0, len(t) - 1)
            texts[-1] = t[:k] + "X" + t[k + 1:]
    texts += ["a" * 350, "b" + "a" * 333, "ab" * 160, "x" * 99, "x" * 100, "y" + "x" * 100]
    return texts


@pytest.mark.parametrize("seed, hot_classes", [(1, 4096), (2, 4096), (3, 1), (4, 3)])
def test_cut_against_all_windows(spark, seed, hot_classes):
    texts = corpus(seed)
    ids = list(range(len(texts)))
    random.Random(seed).shuffle(ids)
    df = frame(spark, [(i, t, "en", "a", 0) for i, t in zip(ids, texts)], True).repartition(5)
    got = Counter(tuple(r)[:5] for r in s.cut_repeats(df, owner_bytes=3000, hot_classes=hot_classes).collect())
    assert got == brute(list(zip(ids, texts)))


def test_edges_of_a_passage_that_many_share(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdef", k=rng.randint(2, 7)))
    passage = " ".join(word() for _ in range(60))
    texts = [" ".join(word() for _ in range(40)) + passage + " ".join(word() for _ in range(40)) for _ in range(60)]
    df = frame(spark, [(i, t, "en", "a", 0) for i, t in enumerate(texts)], True).repartition(3)
    got = s.cut_repeats(df, owner_bytes=3000, hot_classes=10).collect()
    assert Counter(tuple(r)[:5] for r in got) == brute(list(enumerate(texts)))
    assert sum(r.n_removed >= len(passage) for r in got) == 59


def test_tasks_pass_on_few_of_equal_windows():
    import pyarrow as pa

    text = "".join(random.Random(1).choices("abcdefgh", k=100)) + "z" * 100
    at = 68 << 16 | 68 << 8 | 100
    batch = pa.RecordBatch.from_pylist([{"d": d, "dup": 0, "text": text, "open": [{"h": 5, "at": at, "open": 2}]} for d in (3, 2, 4, 5, 1, 6)])
    rows = [r for b in s._context_rows(iter([batch])) for r in b.to_pylist()]
    sent = Counter(r["d"] for r in rows if r["context"])
    assert sent == {3: 69, 2: 69, 1: 69} and len(rows) == 6 * 69
    spans = Counter((r["d"], r["start"]) for b in s._suffix_rows(s._context_rows(iter([batch]))) for r in b.to_pylist() if r["end"] - r["start"] == 100)
    assert {d for d, _ in spans} <= {2, 3, 4, 5, 6} and all(spans[d, p] == 1 for d in (4, 5, 6) for p in range(69))


def test_cut_of_hard_rows(spark):
    rows = [(r[0], r[1]) for r in hard() if r[0] is not None or r[1]] + [(105, "twice " * 40)]
    got = s.cut_repeats(frame(spark, [(*r, "en", "a", 0) for r in rows], True)).collect()
    once = [r for r in rows if r[0] != 105]
    assert Counter(tuple(r)[:5] for r in got if r.doc_id != 105) == brute(once) and len(got) == len(rows)
    assert sum(r.n_removed > 0 for r in got if r.doc_id == 105) == 1
    same = s.cut_repeats(frame(spark, [(1, "word " * 30 + "end", "en", "a", 0)] * 2)).collect()
    assert sorted(r.n_removed for r in same) == sorted([same[0].n_bytes, min(r.n_removed for r in same)]) and len(same) == 2
    assert not s.cut_repeats(frame(spark, [])).collect()
    assert len(s.cut_repeats(frame(spark, documents())).collect()) == len(documents())


@given(st.lists(st.tuples(st.integers(0, 2), st.text("ab", min_size=0, max_size=30)), min_size=1, max_size=60), st.sampled_from([0, 8, 16, 48]))
@settings(max_examples=150, deadline=None)
def test_deep_shallow_order_sorts(rows, shallow):
    rows = sorted(rows, key=lambda r: r[0])
    m = np.zeros((len(rows), 30), np.uint8)
    for i, (_, t) in enumerate(rows):
        m[i, :len(t)] = np.frombuffer(t.encode(), np.uint8)
    order = s.deep_shallow_order(np.array([g for g, _ in rows]), m, shallow).tolist()
    assert [(rows[i][0], m[i].tobytes()) for i in order] == sorted((g, m[i].tobytes()) for i, (g, _) in enumerate(rows))


@given(st.sets(st.binary(min_size=4, max_size=4), min_size=1, max_size=50))
def test_blind_trie_sorts(strings):
    strings = list(strings)
    assert [strings[i] for i in s.blind_trie_order(strings)] == sorted(strings)
