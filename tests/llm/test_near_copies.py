import random
from collections import Counter

import numpy as np

import corpus_pipeline
from letterlens.llm import near_copies
from letterlens.llm.exact_dedup import keep_one_of_equal
from letterlens.llm.near_copies import copy_groups

from .data import documents, frame, hard


def _grams(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i:i + 5]) for i in range(max(len(words) - 4, 1))}


def _groups(rows):
    sets, root = [_grams(r[1]) for r in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, s in enumerate(sets):
        for j in range(i):
            if len(s & sets[j]) / len(s | sets[j]) >= 0.8:
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return Counter((r[0], least.get(find(i))) for i, r in enumerate(rows))


def _edited(base, rng, n):
    words = base.split()
    for at in rng.sample(range(len(words)), n):
        words[at] = f"new{rng.random()}"
    return " ".join(words)


def _copies(start):
    """Texts with copies of each in which one to nine of 200 words are others: similarities on both sides of 0.8."""
    rng = random.Random(start)
    out = []
    for _ in range(12):
        base = " ".join(rng.choices([f"v{i}" for i in range(900)], k=200))
        out += [base, *(_edited(base, rng, n) for n in range(1, 10))]
    return [(start + i, t, "en", "a", len(t)) for i, t in enumerate(out)]


def test_groups_against_all_pairs(spark):
    rows = _copies(1000) + hard()
    want = _groups(rows)
    for df, block in ((frame(spark, rows, True), 512), (frame(spark, rows[::-1], True), 2)):
        got = copy_groups(df, block=block).collect()
        assert Counter((r.doc_id, r.component_id) for r in got) == want
        assert {(r.doc_id, r.component_id) for r in got if r.kept} == {(least, least) for _, least in want}
    assert not copy_groups(frame(spark, [])).collect()


def test_near_stage_leaves_one_of_copies_at_080(spark):
    rows = _copies(1000) + documents()
    kept = {r.doc_id for r in corpus_pipeline.near(spark, frame(spark, rows), "").collect()}
    assert kept == {least for _, least in _groups(rows)}


def test_shard_resolved_in_task_links_all_that_similar_pairs_connect():
    """All texts in one shard, no leader compared before: components are those of all pairs, in blocks too."""
    rows = _copies(0)
    sets = near_copies.shingle_sets([r[1].encode() for r in rows])
    n = len(rows)
    sim = near_copies.bit_majorities(np.concatenate(sets), np.array([len(s) for s in sets]))
    fp = np.arange(n)
    whole = near_copies.joining_links(np.zeros(n, int), np.zeros(n, int), fp, fp, sim, sets, 0.8)
    halves = []
    for i in range(2):
        own = np.flatnonzero(fp % 2 == i)
        halves += near_copies.joining_links(np.zeros(len(own), int), np.zeros(len(own), int), fp[own], fp[own], sim[own], [sets[k] for k in own], 0.8)
    halves += near_copies.joining_links(np.zeros(n, int), 1 + fp % 2, fp, fp, sim, sets, 0.8)
    want = _groups(rows)
    for links in (whole, halves):
        root = list(range(n))

        def find(i):
            while root[i] != i:
                i = root[i]
            return i
        for a, b in links:
            root[max(find(a), find(b))] = min(find(a), find(b))
        assert Counter((i, find(i)) for i in range(n)) == want
    assert len(whole) == n - len({least for _, least in want})


def test_rows_without_ids_and_repeated_ids_are_decided_by_text(spark):
    base = " ".join(f"w{i}" for i in range(120))
    rows = [(None, base, "en", "a", 0), (None, base + " end", "en", "a", 0), (None, "other words of no copy at all", "en", "a", 0),
            (7, "seven is here once more today", "en", "a", 0), (7, "and seven is another text besides", "en", "b", 0)]
    kept = near_copies.keep_one_of_copies(frame(spark, rows)).collect()
    assert len(kept) == 4 and sum(r.doc_id is None for r in kept) == 2 and {r.text for r in kept if r.doc_id == 7} == {rows[3][1], rows[4][1]}
    exact = keep_one_of_equal(frame(spark, [*rows, (None, base.upper(), "en", "c", 0), (7, rows[3][1], "en", "a", 0)])).collect()
    assert len(exact) == 5 and sum(r.text.lower() == base for r in exact) == 1 and sum(r.doc_id == 7 for r in exact) == 2


def test_leads_are_looked_for_in_trees(spark, monkeypatch):
    """What a tree gives for a lead is all within the radius, equal fingerprints among it, and nothing else is compared."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**64, 40, np.uint64)
    tree = rng.integers(0, 40, 3000)
    sim = base[tree] ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (3000, 40)).astype(np.uint64), axis=1) * (rng.random(3000) < 0.8).astype(np.uint64)
    for radius in (0, 12, 32):
        assert (near_copies.near_lead(tree, sim, base[tree], radius) == (np.bitwise_count(sim ^ base[tree]) <= radius)).all()
    rows, asked = _copies(2000), []
    alike = near_copies._alike
    monkeypatch.setattr(near_copies, "_alike", lambda pairs, *more: asked.append(pairs._jdf.queryExecution().executedPlan().toString()) or alike(pairs, *more))
    got = copy_groups(frame(spark, rows), block=16).collect()
    assert Counter((r.doc_id, r.component_id) for r in got) == _groups(rows)
    assert asked and all("_lead_batches" in plan for plan in asked)
