import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from letterlens.llm import common, mixing
from letterlens.llm.exact_dedup import exact_groups, keep_one_of_equal
from letterlens.llm.mixing import mix, mixed_documents
from letterlens.llm.packing import CAPACITIES, best_fit, pack, packed_texts
from letterlens.llm.simhash import BKForest, block_masks, fingerprints, keep_one_of_near, near_groups, shard_links

from .data import documents, frame, hard

LOW = str.maketrans(common.UPPER, common.LOWER)


@pytest.mark.parametrize("capacity", [3, 20_000])
@pytest.mark.parametrize("odd", [False, True])
def test_exact_groups_against_brute_force(spark, capacity, odd):
    rows = hard()
    got = exact_groups(frame(spark, rows, odd), capacity).collect()
    by_text = defaultdict(list)
    for r in rows:
        by_text[(r[1] or "").translate(LOW)].append(r[0])
    want = Counter()
    for text, ids in by_text.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            want[(i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(by_text)


def test_keep_one_of_equal(spark):
    kept = keep_one_of_equal(frame(spark, hard(), True))
    assert kept.columns == frame(spark, [], True).columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[105] == 1 and 1 not in ids and ids[3] == 1 and 6 not in ids and ids[104] == 1 and 103 not in ids
    assert ids[None] == 1 and ids[101] == 1 and 100 not in ids  # of the rows without an id the empty one is a copy
    assert not keep_one_of_equal(frame(spark, [])).collect()


def _mix(rows):
    """The mix by plain loops."""
    size = [len([w for w in (r[1] or "").replace("\n", " ").replace("\t", " ").split(" ") if w]) for r in rows]
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is None, (s or "").encode()))
    total = {s: sum(z for z, r in zip(size, rows) if r[3] == s) for s in sources}
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(sources)}
    target, open_, left = {}, set(sources), mixing.SHARE * sum(size)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 2 * total[s]}
        if not over:
            target |= {s: weight[s] * level for s in open_}
            break
        target |= {s: 2.0 * total[s] for s in over}
        left -= sum(2.0 * total[s] for s in over)
        open_ -= over
    return size, total, target


@pytest.mark.parametrize("range_docs", [3, 2_000])
def test_mix_against_loops(spark, range_docs):
    rows = documents(300, 5, 15) + [(1000 + i, None if i % 2 else "", "x", s, 0) for i, s in enumerate(["a", None, "z", "z"])] + [(2000, "one two", "x", None, 7)]
    size, total, target = _mix(rows)
    got = mix(frame(spark, rows, True), range_docs=range_docs).collect()
    taken = Counter()
    by_id = {r[0]: (z, r[3]) for z, r in zip(size, rows)}
    for r in got:
        z, s = by_id[r.doc_id]
        assert (r.size, r.source_size) == (z, total[s]) and r.target == pytest.approx(target[s])
        assert 0 <= r.taken <= 2 * z
        taken[s] += r.taken
    assert len(got) == len(rows)
    assert all(taken[s] == round(target[s]) for s in total)
    again = mix(frame(spark, rows[::-1], True).repartition(5), range_docs=range_docs).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    docs = mixed_documents(frame(spark, rows, True), range_docs=range_docs)
    words = docs.groupBy("doc_id").agg(F.sum(common.word_count(F.col("text"))).alias("n")).collect()
    assert {r.doc_id: r.n for r in words if r.n} == {r.doc_id: r.taken for r in got if r.taken}


def test_mix_edges(spark):
    got = mix(frame(spark, hard())).collect()
    assert len(got) == len(hard()) and all(r.taken <= 2 * r.size for r in got)
    assert not mix(frame(spark, [])).collect() and not mixed_documents(frame(spark, [])).collect()
    assert [r.taken for r in mix(frame(spark, [(1, None, None, None, 0)])).collect()] == [0]


@pytest.mark.parametrize("doc_id", [7, None])
def test_mix_of_repeated_and_null_ids_meets_its_targets(spark, doc_id):
    alike, other = [(doc_id, "w " * 10, "x", "b", 0)] * 700, [(doc_id, f"t{i} " * 10, "x", "b", 0) for i in range(300)]
    rows = alike + other + documents(200, 5, 15)
    size, total, target = _mix(rows)
    for range_docs in (50, 2_000):
        got = mix(frame(spark, rows).repartition(7), range_docs=range_docs).collect()
        taken = Counter()
        for r in got:
            assert r.taken <= 2 * r.size
            taken[r.source] += r.taken
        assert len(got) == len(rows) and all(taken[s] == round(target[s]) for s in total)
        words = mixed_documents(frame(spark, rows), range_docs=range_docs).groupBy("source").agg(F.sum(common.word_count(F.col("text"))).alias("n")).collect()
        assert {r.source: r.n for r in words} == {s: round(target[s]) for s in total}


@given(st.lists(st.integers(1, 64), max_size=80))
@settings(max_examples=60, deadline=None)
def test_best_fit_fills_no_bin_over(sizes):
    lengths = np.array(sizes, np.int64)
    bins, offset, cap = best_fit(lengths, (8, 16, 32, 64), 2)
    for b in set(bins.tolist()):
        own = bins == b
        spans = sorted(zip(offset[own].tolist(), lengths[own].tolist()))
        assert spans[0][0] == 0 and all(a + n == c for (a, n), (c, _) in zip(spans, spans[1:]))
        used = int(lengths[own].sum())
        assert cap[own][0] == min(c for c in (8, 16, 32, 64) if c >= used)


def test_pack_keeps_every_word(spark):
    rows = hard()
    got = pack(frame(spark, rows, True), group_pieces=20).toPandas()
    words = Counter()
    for r in rows:
        words[r[0]] += len((r[1] or "").split())
    assert got[got.doc_id.notna()].groupby("doc_id").length.sum().to_dict() == {k: v for k, v in words.items() if k is not None}
    assert got[got.doc_id.isna()].length.sum() == 3
    assert got[got.length == 0].bin_id.isna().all()
    full = got[got.length > 0].groupby("bin_id").agg(used=("length", "sum"), cap=("capacity", "first"))
    assert (full.used <= full.cap).all()
    assert not pack(frame(spark, [])).collect()
    many = pack(frame(spark, documents(400, 3, 300))).toPandas()
    caps = many.drop_duplicates("bin_id").capacity.sum()
    assert many.length.sum() / caps > 0.97


def _plain_best_fit(lengths, caps, bin_cost):
    """The stated rule over plain lists: every open bin and every piece still to come is looked at."""
    bins, free, promised, out = [], sorted(lengths, reverse=True), [], {}
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        size = lengths[i]
        (promised if size in promised else free).remove(size)
        fitting = [b for b in bins if b[0] - b[1] >= size]
        if fitting:
            least = min(b[0] - b[1] for b in fitting)
            # of bins with the same room the one that has had it for the shortest time
            b = max((b for b in fitting if b[0] - b[1] == least), key=lambda b: b[2])
        else:
            offers = []
            for c in sorted(caps):
                if c < size:
                    continue
                room, filling = c - size, []
                for s in free:
                    if s <= room:
                        filling.append(s)
                        room -= s
                words = size + sum(filling)
                offers.append(((min(x for x in caps if x >= words) + bin_cost) / words, c, filling))
            _, c, filling = min(offers, key=lambda o: o[:2])
            for s in filling:
                free.remove(s)
                promised.append(s)
            b = [c, 0, 0, len(bins)]
            bins.append(b)
        out[i] = (b[3], b[1])
        b[1] += size
        b[2] = len(out)
    return [(*out[i], min(c for c in caps if c >= bins[out[i][0]][1])) for i in range(len(lengths))]


@given(st.lists(st.integers(1, 64), max_size=60), st.sampled_from([(8, 16, 32, 64), (64,), (20, 64)]), st.integers(0, 9))
@settings(max_examples=150, deadline=None)
def test_best_fit_against_plain_lists(sizes, caps, bin_cost):
    got = best_fit(np.array(sizes, np.int64), caps, bin_cost)
    assert list(zip(*(x.tolist() for x in got))) == _plain_best_fit(sizes, caps, bin_cost)


def test_lengths_are_opened_by_what_can_fill_them():
    # two of 1400 words leave 1296 of 4096 empty, one leaves 100 of 1500
    _, _, cap = best_fit(np.full(50, 1400), (1500, 4096), 16)
    assert set(cap.tolist()) == {1500}
    # 1290 words more fill what two of 1400 leave
    _, _, cap = best_fit(np.r_[np.full(40, 1400), np.full(20, 1290)], (1500, 4096), 16)
    assert set(cap.tolist()) == {4096}


def test_pack_against_plain_lists(spark):
    rows = hard() + [(900 + i, "w " * n, "en", "a", 0) for i, n in enumerate((4096, 4097, 9000, 3000, 1500, 1500))]
    got = pack(frame(spark, rows).repartition(3)).collect()
    by_row = {}
    for r in got:
        by_row.setdefault((r.bin_id if r.length else None), []).append(r)
    for b, own in by_row.items():
        if b is None:
            assert all(r.length == 0 for r in own)
            continue
        own.sort(key=lambda r: r.bin_offset)
        assert own[0].bin_offset == 0 and all(x.bin_offset + x.length == y.bin_offset for x, y in zip(own, own[1:]))
        assert {r.capacity for r in own} == {min(c for c in CAPACITIES if c >= sum(r.length for r in own))}
    pieces = Counter((r.doc_id, r.piece, r.length) for r in got)
    want = Counter()
    rests = []
    for r in rows:
        n = len([w for w in (r[1] or "").translate(str.maketrans("\t\n\r\v\f", "     ")).split(" ") if w])
        want.update((r[0], k, 4096) for k in range(n // 4096))
        if n % 4096 or not n:
            want[(r[0], n // 4096, n % 4096)] += 1
        rests += [n % 4096] if n % 4096 else []
    assert pieces == want
    # one group: bins do not depend on the order of equal lengths, so their contents are those of the plain rule
    plain = {}
    for n, (b, _, cap) in zip(rests, _plain_best_fit(rests, CAPACITIES, 16)):
        plain.setdefault((b, cap), []).append(n)
    mine = Counter((own[0].capacity, tuple(sorted(r.length for r in own))) for b, own in by_row.items() if b is not None)
    full = sum(n for (_, _, length), n in want.items() if length == 4096)
    assert mine == Counter((cap, tuple(sorted(ns))) for (_, cap), ns in plain.items()) + Counter({(4096, (4096,)): full})


def _simhash(text):
    words = ["".join(w) for w in (text or "").translate(LOW).replace("\n", " ").replace("\t", " ").split(" ") if w]
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def _components(ids, fps, radius=3):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(fps))]


def test_fingerprints_against_loops():
    texts = [r[1] or "" for r in hard()] + ["a", "a b", "a b c", "x " * 70_000]
    assert fingerprints([t.encode() for t in texts]).tolist() == [_simhash(t) for t in texts]


def test_near_groups_against_all_pairs(spark):
    base = "the quick brown fox jumps over the lazy dog and runs far away from every hunter in the wood " * 12
    near = [(200 + i, base + f"tail{i}", "en", "a", 0) for i in range(12)]
    rows = hard() + near
    got = near_groups(frame(spark, rows, True)).collect()
    fps = [_simhash(r[1]) for r in rows]
    want = Counter((r[0], f"{f:016x}", c) for r, f, c in zip(rows, fps, _components([r[0] for r in rows], fps)))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want
    assert len({r.component_id for r in got if r.doc_id and r.doc_id >= 200}) < 12
    kept = Counter(r.doc_id for r in keep_one_of_near(frame(spark, rows)).collect())
    assert kept[105] == 1
    assert not near_groups(frame(spark, [])).collect()


@pytest.mark.parametrize("n", [100, 10**7, 10**9, 10**11])
def test_masks_lose_no_pair(n):
    rng, masks = np.random.default_rng(n % 97), block_masks(n)
    for _ in range(300):
        flips = sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
        assert any(not m & flips for m in masks)


def test_forest_and_large_shards_find_all_links():
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 2**63, 40, dtype=np.uint64)
    flips = [[sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for k in range(8)] for _ in seeds]
    fps = np.unique(np.array([int(s) ^ f for s, own in zip(seeds, flips) for f in own], np.uint64))
    tree = (fps % np.uint64(3)).astype(np.int64)
    f = BKForest(tree, fps)
    got = set(zip(*map(list, f.within(np.arange(len(fps))))))
    assert got == {(i, j) for i in range(len(fps)) for j in range(len(fps)) if i != j and tree[i] == tree[j] and (int(fps[i]) ^ int(fps[j])).bit_count() <= 3}
    for most in (4096, 5):
        a, b = shard_links(np.zeros(len(fps), np.int64), fps, most=most)
        place = {int(x): i for i, x in enumerate(fps)}
        root = list(range(len(fps)))

        def find(i):
            while root[i] != i:
                i = root[i]
            return i
        for x, y in zip(a.tolist(), b.tolist()):
            root[find(place[x])] = find(place[y])
        want = _components(list(range(len(fps))), [int(x) for x in fps])
        groups = defaultdict(set)
        for i in range(len(fps)):
            groups[find(i)].add(want[i])
        assert len(groups) == len(set(want)) and all(len(g) == 1 for g in groups.values())


def test_the_mix_keeps_white_space_and_bins_give_every_word_back(spark):
    texts = ["a\n b   c\td  e", "  lead and tail \n", "one", "", None, " \n ", "\r\nx\x0by\x0c z\n\n\nq ", "w\n" * 5_000, "\t" + "v  " * 9_000]
    rows = [(i % 6, t, "en", "abc"[i % 3], 0) for i, t in enumerate(texts * 3)]
    mixed = mixed_documents(frame(spark, rows))
    cut = {(r.doc_id, r.text) for r in mixed.collect()}
    originals = {}
    for r in rows:
        originals.setdefault(r[0], []).append(r[1] or "")
    assert all(any(o.startswith(t or "") for o in originals[d]) for d, t in cut)  # what is left of a cut text is its begin
    docs = common.Scratch(spark, "t").write(mixed, "mixed")
    got, want = packed_texts(docs, group_pieces=40).collect(), Counter((r.doc_id, (r.text or "").rstrip(" \t\n\x0b\x0c\r")) for r in docs.collect())
    by_row = {}
    for r in got:
        assert len(r.text.split()) == r.length
        by_row.setdefault((r.row, r.doc_id), []).append((r.piece, r.text))
    assert Counter((d, "".join(t for _, t in sorted(own))) for (_, d), own in by_row.items()) == want
    assert len({r.row for r in got}) == docs.count() and packed_texts(frame(spark, [])).count() == 0
    places = {(r.bin_id, r.bin_offset) for r in got if r.length}
    assert len(places) == sum(1 for r in got if r.length)  # no two pieces share a place
