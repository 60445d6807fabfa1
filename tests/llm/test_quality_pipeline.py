import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from letterlens.llm import quality_fm as q
from letterlens.llm.common import LOWER, UPPER, table

from .data import documents, frame, hard
from .test_dedup_mix_pack import _mix
from .test_near_copies import _groups

SF = "/root/testdata/sf0.001"
LOW = str.maketrans(UPPER, LOWER)


def test_linear_time_sum_equals_all_pairs():
    rng = np.random.default_rng(1)
    texts = [b"a b c a", b"", b"Zebra!! 12\nx", "été naïve".encode()]
    sizes, slots, values, stats = q.features(texts)
    m = q.Machine(0.3, rng.normal(size=q.WORD_SLOTS + q.N_STATS), rng.normal(size=(q.WORD_SLOTS + q.N_STATS, q.RANK)), stats.mean(0), np.ones(q.N_STATS))
    got, _, z = m.margins(sizes, slots, values, stats)
    ends = np.cumsum(sizes)
    for d in range(len(texts)):
        s = slice(ends[d] - sizes[d], ends[d])
        at = np.r_[slots[s], np.arange(q.WORD_SLOTS, q.WORD_SLOTS + q.N_STATS)]
        x = np.r_[values[s], z[d]]
        pairs = sum(m.v[at[i]] @ m.v[at[j]] * x[i] * x[j] for i in range(len(at)) for j in range(i))
        assert got[d] == pytest.approx(m.w0 + m.w[at] @ x + pairs)


def test_fit_learns_an_interaction():
    rng = np.random.default_rng(2)
    texts, y = [], []
    for _ in range(900):
        a, b = rng.random(2) < 0.5
        texts.append(b" ".join([b"alpha" if a else b"gamma", b"beta" if b else b"delta"]))
        y.append(float(a == b))
    m = q.fit(*q.features(texts), np.array(y), epochs=30)
    s = m.scores([b"alpha beta", b"gamma delta", b"alpha delta", b"gamma beta"])
    assert min(s[:2]) > 0.8 and max(s[2:]) < 0.2


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    scored = q.score_quality(docs, q.train(docs, labels)).join(labels, "doc_id").where("held_out")
    r = scored.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")).alias("acc"),
                   F.avg(F.when(F.col("quality") == 1, F.col("predicted"))).alias("kept"), F.avg(F.when(F.col("quality") == 0, F.col("predicted"))).alias("let_in")).first()
    assert r.acc > 0.97 and r.kept > 0.98 and r.let_in < 0.1


def test_model_is_the_same_however_repeated_rows_lie(spark):
    rows = [(i % 40, t, "en", "a", 0) for i, (_, t, *_) in enumerate(documents(120, 6, 40))]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    one, other = q.train(frame(spark, rows).repartition(1), labels), q.train(frame(spark, rows[::-1]).repartition(5), labels)
    assert one.w0 == other.w0 and np.array_equal(one.w, other.w) and np.array_equal(one.v, other.v)


def test_hard_rows_and_odd_labels(spark):
    rows = hard()
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(1, None, 1), (None, 1, 0), (2, 1, 1)], "doc_id long, quality int, toxic int")
    m = q.train(frame(spark, rows, True), labels)
    got = q.score_quality(frame(spark, rows, True), m).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert Counter(r.held_out for r in got)[True] > 0
    kept = q.keep_good(frame(spark, rows, True), labels)
    assert kept.columns == frame(spark, [], True).columns
    none = q.train(frame(spark, rows), labels.limit(0))
    assert {round(r.score, 6) for r in q.score_quality(frame(spark, rows), none).collect()} == {0.5}
    assert not q.score_quality(frame(spark, []), none).collect()
    assert q.train(frame(spark, []), labels).w0 == 0


def test_pipeline_against_plain_loops(spark):
    docs = table(spark, SF, "documents")
    columns, out = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        out[name] = docs.toPandas()
        if name != "packing":
            assert docs.columns == columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact", "near", "mix", "packing"]
    source = table(spark, SF, "documents").toPandas()
    machine = q.train(table(spark, SF, "documents"), table(spark, SF, "labels"))
    score = dict(zip(source.doc_id, machine.scores([t.encode() for t in source.text])))
    want = {d for d, s in score.items() if s >= 0.7}
    assert set(out["quality"].doc_id) == want and 0.5 < len(want) / len(source)
    last = {}
    for d, t in zip(out["quality"].doc_id, out["quality"].text):
        k = t.translate(LOW)
        last[k] = max(d, last.get(k, d))
    assert set(out["exact"].doc_id) == set(last.values())
    assert set(out["near"].doc_id) == {least for _, least in _groups(list(zip(out["exact"].doc_id, out["exact"].text)))}
    rows = list(out["near"][columns].itertuples(index=False, name=None))
    size, total, target = _mix(rows)
    mixed = Counter()
    for d, t, s in zip(out["mix"].doc_id, out["mix"].text, out["mix"].source):
        mixed[s] += len(t.split())
    assert {s: n for s, n in mixed.items() if n} == {s: round(target[s]) for s in total if round(target[s])}
    packed = out["packing"]
    assert packed.length.sum() == sum(len(t.split()) for t in out["mix"].text)
    bins = packed[packed.length > 0].groupby("bin_id").agg(used=("length", "sum"), cap=("capacity", "first"))
    assert (bins.used <= bins.cap).all()
    given = Counter((d, t.rstrip(" \t\n\x0b\x0c\r")) for d, t in zip(out["mix"].doc_id, out["mix"].text))
    texts = packed.sort_values("piece").groupby(["row", "doc_id"]).text.agg("".join)
    assert Counter((d, t) for (_, d), t in texts.items()) == given  # every word of the mix, in order, from the bins
    ran = corpus_pipeline.run(spark, SF).toPandas()
    assert Counter(zip(ran.doc_id, ran.piece, ran.length)) == Counter(zip(packed.doc_id, packed.piece, packed.length))


def test_pipeline_of_hard_tables(spark, tmp_path):
    """Without labels the base rate rejects all; where all labels are good, it keeps all that the other stages do not drop."""
    for rows, quality in ((hard(), None), (hard(), 1), (documents(12), 1), ([], 1)):
        folder = tmp_path / f"d{len(rows)}-{quality}"
        frame(spark, rows).write.parquet(str(folder / "documents.parquet"))
        labels = [] if quality is None else [(r[0], quality, 0) for r in rows if r[0] is not None]
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
        got = corpus_pipeline.run(spark, str(folder)).collect()
        if quality is None or not rows:
            assert not got
            continue
        assert {r.doc_id for r in got} <= {r[0] for r in rows} and sum(r.length for r in got) > 0
        bins = {}
        for r in got:
            assert (r.bin_id is None) == (r.length == 0)
            if r.length:
                bins.setdefault((r.bin_id, r.capacity), []).append((r.bin_offset, r.length))
        for (_, capacity), spans in bins.items():
            spans.sort()
            assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and sum(spans[-1]) <= capacity
