import hashlib
import time
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from letterlens.llm import chat_format as chat
from letterlens.llm.queries import op2_chat_format
from letterlens.llm.token_counts import RankMerger, TokenCounter, count_tokens, vocabulary_path
from letterlens.llm.vector_topk import block_topk, top_k

from .data import frame, hard

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary_path())


@pytest.fixture(scope="module")
def counter():
    return TokenCounter(vocabulary_path())


def _want(library, texts):
    return [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


PIECES = st.lists(st.sampled_from([" ", "  ", "\n", " \n", "\t", "\x0b", "\x1c", "\x85", " ", "　", "a", "aaaa", "the", "The", "'s", "'ll", "'", "!!", "...", "12", "9", "é", "ñandú", "日本", "🙂", "<|endoftext|>", "<|endof", "_", "x" * 50]), max_size=25)


@given(st.lists(PIECES, max_size=6))
@settings(max_examples=300, deadline=None)
def test_counts_equal_the_library(library, counter, parts):
    texts = ["".join(p) for p in parts]
    assert counter.counts(texts) == (_want(library, texts) if texts else [])


def test_merges_of_long_runs(library):
    merger = RankMerger(vocabulary_path())
    words = ["a" * n for n in range(1, 70)] + ["ab" * 33, "aab" * 20, "haha" * 9]
    assert merger.counts([w.encode() for w in words]).tolist() == _want(library, words)


@given(st.integers(0, 2**32 - 1), st.sampled_from(["ab", "abc ", "etaoin", "abcdefghijklmnopqrstuvwxyz", "日本語の中国", "01", "=-_"]), st.integers(1, 3000))
@settings(max_examples=60, deadline=None)
def test_merges_of_long_random_pre_tokens(library, seed, letters, n):
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list(letters), n)).replace(" ", ""), "a" * (n // 2), "ab" * (n // 3)]
    words = [w for w in words if w]
    counter = TokenCounter(vocabulary_path())
    assert counter.counts(words) == _want(library, words)


def test_a_pre_token_of_a_megabyte_is_counted_in_seconds(library, counter):
    rng = np.random.default_rng(1)
    for letters in ("abcdefghijklmnopqrstuvwxyz", "日月火水木金土人大小中国一二三"):
        word = "".join(rng.choice(list(letters), (1 << 20) // len(letters[0].encode())))
        began = time.process_time()
        assert counter.counts([word]) == _want(library, [word])
        assert time.process_time() - began < 20


def test_counts_of_driver_texts(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = {r.doc_id: r for r in count_tokens(docs).collect()}
    assert {k: r.n_tokens for k, r in got.items()} == dict(zip(texts, _want(library, list(texts.values()))))
    assert all(r.n_bytes == len(texts[k].encode()) and r.over_limit == (r.n_tokens > 1024) for k, r in got.items())


def test_counts_of_hard_rows(spark, library):
    rows = hard()
    got = sorted((r.n_bytes, r.n_tokens) for r in count_tokens(frame(spark, rows, True)).collect())
    texts = [r[1] or "" for r in rows]
    assert got == sorted(zip((len(t.encode()) for t in texts), _want(library, texts)))
    assert not count_tokens(frame(spark, [])).collect()


@given(st.lists(st.tuples(st.text(max_size=8), st.lists(st.sampled_from(["\\", "#", "<", ":", "\n", "</turn>", "### ", "\\h", "a"]), max_size=8).map("".join)), max_size=5))
def test_template_round_trip(turns):
    text, spans = chat.render(turns, "a")
    back, loss = chat.parse(text, spans)
    assert back == turns and loss == "".join(t for r, t in turns if r == "a")


def test_op2_reads_back_every_conversation(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    by_conv = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.conv_id, r.turn)):
        by_conv[r.conv_id].append((r.role or "", r.text or ""))
    by_conv[-7] = [(role, r"\### Assistant: </turn> ok") for role in ("user", "assistant")]
    got = {r.conv_id: r for r in op2_chat_format(spark, SF).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert set(got) == set(by_conv)
    for c, turns in by_conv.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (
            len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss))


NODES = "conv_id long, node long, parent long, score double, role string, text string"


def test_paths_of_trees_are_ranked_and_listed(spark):
    rows = [(1, 1, None, 0.0, "user", "q"), (1, 2, 1, 5.0, "assistant", "good"), (1, 3, 1, 1.0, "assistant", "bad"), (1, 4, 3, 1.0, "user", "more"),
            (1, 5, 4, None, None, None), (2, 1, 99, 1.0, "user", "orphan"), (3, 1, 2, 0.0, "user", "circle"), (3, 2, 1, 0.0, "user", "circle"),
            *[(4, i, i - 1 or None, 0.0, "user", str(i)) for i in range(1, 38)], (None, 1, None, 0.0, "user", "no id")]
    nodes = spark.createDataFrame(rows, NODES)
    got = defaultdict(list)
    for r in chat.chosen_paths(nodes, None).collect():
        got[(r.conv_id, r.leaf, r.path_rank)].append((r.depth, r.node))
    assert {k: [n for _, n in sorted(v)] for k, v in got.items()} == {
        (1, 2, 1): [1, 2], (1, 5, 2): [1, 3, 4, 5], (2, 1, 1): [1], (4, 37, 1): list(range(1, 38)), (None, 1, 1): [1]}
    out = {r.conv_id: r.formatted for r in chat.format_trees(nodes, 1).collect()}
    assert chat.parse(out[1], [])[0] == [("user", "q"), ("assistant", "good")] and 3 not in out
    assert not chat.format_trees(spark.createDataFrame([], NODES)).collect()
    assert not chat.format_trees(chat.conversation_nodes(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).collect()


def test_conversations_with_ties_and_nulls(spark):
    rows = [(1, 1, "user", "b"), (1, 1, "user", "a"), (1, 1, "user", "a"), (1, 0, None, None), (None, 5, "assistant", "x"), (1, None, "user", "first")]
    nodes = chat.conversation_nodes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as node2", "turn as depth"))
    got = {r.conv_id: chat.parse(r.formatted, [])[0] for r in chat.format_trees(nodes).collect()}
    assert got == {1: [("user", "first"), ("", ""), ("user", "a"), ("user", "a"), ("user", "b")], None: [("assistant", "x")]}


@given(st.integers(0, 2**32 - 1), st.integers(1, 40), st.integers(1, 300), st.integers(1, 70), st.integers(1, 25), st.sampled_from([3, 64, 10**6]))
@settings(max_examples=60, deadline=None)
def test_block_topk_against_all_products(seed, n_q, n_x, dim, k, most):
    rng = np.random.default_rng(seed)
    q, x = rng.integers(-most, most + 1, (n_q, dim)), rng.integers(-most, most + 1, (n_x, dim))
    x_ids, q_ids = rng.permutation(n_x * 2)[:n_x], rng.integers(0, n_x * 2, n_q)
    i, j, s = block_topk(q_ids, q, x_ids, x, k)
    got = defaultdict(list)
    for a, b, c in zip(i.tolist(), j.tolist(), s.tolist()):
        got[a].append((-c, int(x_ids[b])))
    for a in range(n_q):
        assert got[a] == sorted((-int(q[a] @ x[b]), int(x_ids[b])) for b in range(n_x) if x_ids[b] != q_ids[a])[:k]


def test_top_k_with_odd_vectors(spark):
    rng = np.random.default_rng(5)
    v = {i: rng.normal(size=8).astype(np.float32).tolist() for i in range(130)}
    v[7] = v[9] = v[11]
    v[21], v[22], v[23], v[24] = None, [None] * 8, [float("nan")] * 8, [float("inf")] + [0.0] * 7
    rows = list(v.items()) + [(13, v[13]), (40, v[40]), (None, v[1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "vec_id as rank", "1 as score", "2 as block")
    ints = {i: np.floor(64 * np.array(x, np.float64)).astype(int) for i, x in v.items() if i not in (21, 22, 23, 24)}
    want = {(q, r + 1, i, -s) for q in ints if q % 20 == 0 for r, (s, i) in enumerate(sorted((-int(ints[q] @ ints[i]), i) for i in ints if i != q)[:20])}
    for row_block, query_block in ((8192, 2048), (17, 3)):
        assert {tuple(r) for r in top_k(df, row_block=row_block, query_block=query_block).collect()} == want
    assert not top_k(df.limit(0)).collect() and not top_k(df.where("vec_id = 20")).collect()
