import hashlib
import json
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from letterlens.llm import merkle, token_align, token_files
from letterlens.llm.queries import op11_token_alignment, op12_merkle_manifest, op13_token_files
from letterlens.llm.token_counts import vocabulary_path
from letterlens.llm.word_ids import WordIds

from .data import frame, hard

SF = "/root/testdata/sf0.001"
ODD_TEXTS = ["", " ", "  ", "a  b", " \n \n x", "\x1c \x1c y", "a▁b", "\0", "\x85 z", "<|endoftext|> a<|endoftext|>", "<s> </s> <unk>", "<|startoftext|>x <|END", "日本語の テキスト", "é é",
             "ﬁ Ⅳ ½", "🙂🙂 👨‍👩‍👧", " wide　space", "ΣΑΣ σας", "İstanbul", "x" * 300, "ab " * 200, "'s 'll don't", "\r\n\t mixed \r", "́ lone"]
PIECES = st.lists(st.sampled_from([" ", "  ", "\n", "\t", "\r", "\x0b", "\x1c", "\x85", " ", "　", "a", "The", "'s", "!!", "12", "é", "e", "́", "日本", "🙂", "▁", "<|endoftext|>", "<|endof", "text|>", "Σ", "_"]), max_size=30)


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=vocabulary_path("piece_bpe_32k.model")), Tokenizer.from_file(vocabulary_path("word_bpe_49k.json"))


@given(st.lists(PIECES, min_size=1, max_size=5))
@settings(max_examples=300, deadline=None)
def test_ids_by_words_are_those_of_whole_texts(libraries, parts):
    texts = ["".join(p) for p in parts]
    a, _, w = libraries
    for own, library, lead in ((WORDS[0], a, " "), (WORDS[1], w, "")):
        want = [library.encode(lead + t, add_special_tokens=False).ids for t in texts]
        assert [x.tolist() for x in own.ids(texts)] == want


WORDS = WordIds(vocabulary_path("byte_bpe_50k.json"), " ", False), WordIds(vocabulary_path("word_bpe_49k.json"), "", True)


def test_a_full_cache_changes_no_id(libraries, monkeypatch):
    monkeypatch.setattr("letterlens.llm.word_ids.CACHE", 3)
    own, rng = WordIds(vocabulary_path("word_bpe_49k.json"), "", True), random.Random(3)
    for _ in range(30):
        texts = [" ".join(rng.choices(["one", "two", "three", "four", "five", "six" * 40], k=5)) for _ in range(3)]
        assert [x.tolist() for x in own.ids(texts)] == [libraries[2].encode(t, add_special_tokens=False).ids for t in texts]


def test_ids_of_characters_that_the_library_composes_or_lowers_to_marks(libraries):
    a, _, w = libraries
    texts = ["İ. İ!x", "cafe\u0301 e\u0301.", "Å ™ ㎏ Ⓐ ℓ.", "x\x1cy \x1f", "<|ENDOFTEXT|> <|endoftext|>.", "² ½ Ⅷ ٣ ʰ ǅ.", "y" * 70 + ". " + "y" * 70]
    for own, library, lead in ((WORDS[0], a, " "), (WORDS[1], w, "")):
        assert [x.tolist() for x in own.ids(texts)] == [library.encode(lead + t, add_special_tokens=False).ids for t in texts]


# Alignment

def _a_token_bytes():
    spec = json.load(open(vocabulary_path("byte_bpe_50k.json"), encoding="utf-8"))
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back, extra = {chr(b): b for b in shown}, 256
    for b in range(256):
        if b not in shown:
            back[chr(extra)], extra = b, extra + 1
    return {i: bytes(back[c] for c in t) for t, i in spec["model"]["vocab"].items()}


def brute_align(texts, a, b):
    """Rows by comparing every end of one list with every end of the other."""
    of_a, docs, count = _a_token_bytes(), [], Counter()
    for text in texts:
        if not text:
            docs.append(None)
            continue
        x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        pieces = [b.id_to_piece(i) for i in y]
        y_bytes = [bytes([int(p[3:-1], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(y, pieces, strict=True)]
        x_bytes = [of_a[i] for i in x]
        if b"".join(x_bytes) != (" " + text).encode() or b"".join(y_bytes) != (" " + text).encode():
            docs.append(None)
            continue
        ends = [[sum(map(len, p[:k + 1])) for k in range(len(p))] for p in (x_bytes, y_bytes)]
        links = [(x[i], y[j]) for i, e in enumerate(ends[0]) for j, f in enumerate(ends[1]) if e == f]
        groups, last_a, last_b = [], 0, 0
        for cut in [e for e in ends[0] if e in ends[1]]:
            p, q = ends[0].index(cut) + 1, ends[1].index(cut) + 1
            groups.append(",".join(map(str, x[last_a:p])) + "|" + ",".join(map(str, y[last_b:q])))
            last_a, last_b = p, q
        count.update(links)
        docs.append((len(x), len(y), links, ";".join(groups), len(groups)))
    best = {}
    for (_, j), n in count.items():
        best[j] = max(best.get(j, 0), n)
    out = []
    for d in docs:
        if d is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, links, text, n = d
            out.append((n_a, n_b, n, len(links), sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest()))
    return out


def _aligned(df):
    return sorted((r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect())


@pytest.mark.parametrize("bound", [0, 1 << 30])
def test_alignment_of_hard_and_odd_rows(spark, libraries, bound):
    rows = [*hard(), *[(1000 + i, t, "en", "a", len(t)) for i, t in enumerate(ODD_TEXTS)]]
    rows = [r if not r[1] or len(r[1]) < 5000 else (r[0], r[1][:3000], *r[2:]) for r in rows]  # the brute force is quadratic
    got = _aligned(token_align.with_counts(frame(spark, rows, True), broadcast_bytes=bound))
    assert got == sorted(brute_align([r[1] for r in rows], *libraries[:2]))
    assert (0, 0, 0, 0, 0, 0, "") in got  # an unwritable text, as one with U+2581


def test_alignment_of_driver_texts(spark, libraries):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("n_chars < 4000").orderBy("doc_id")
    got = _aligned(token_align.with_counts(docs))
    assert got == sorted(brute_align([r.text for r in docs.collect()], *libraries[:2]))
    assert op11_token_alignment(spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_alignment_of_a_long_text_and_of_none(spark, libraries):
    text = "Ünïcode and plain words, mixed. " * 20_000
    row = token_align.align_tokens(frame(spark, [(1, text, None, None, None)])).first()
    assert row.n_groups == row.n_links == len(row.a_last) and row.a_last[-1] == row.n_a - 1 and row.b_last[-1] == row.n_b - 1
    assert sum(row.times) == row.n_links
    assert token_align.with_counts(frame(spark, [])).count() == 0


def test_linked_pairs_are_within_the_bound_of_the_vocabularies():
    own = token_align.aligner(vocabulary_path(token_align.A_FILE), vocabulary_path(token_align.B_FILE))
    some = 0
    for x in own.a_bytes[::997]:
        some += sum(1 for y in own.b_bytes if x and y and (x.endswith(y) or y.endswith(x)))
    assert 0 < some < own.most_pairs()
    assert own.most_pairs() * token_align.PAIR_BYTES <= token_align.BROADCAST_BYTES


# Merkle manifest

def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_merkle(rows):
    """Rows (doc_id, text, lang, source, n_chars) with trees as plain lists, each proof checked by folding from the leaf."""
    def leaf(d, t, lang, s, n):
        return _h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (d, s, lang, n, t)])

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([_h(*levels[-1][k:k + 16]) for k in range(0, len(levels[-1]), 16)])
        return levels

    def way(levels, at):
        for level in levels[:-1]:
            run = at // 16 * 16
            yield level[run:at], level[at + 1:run + 16]
            at //= 16

    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append((leaf(*r), r))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        by[s].sort(key=lambda x: (x[1][0] is not None, x[1][0] or 0, x[0]))
        trees[s] = tree([x[0] for x in by[s]])
    top = tree([trees[s][-1][0] for s in sources])
    root, out = top[-1][0], []
    for k, s in enumerate(sources):
        for i, (own, (d, t, lang, _, n)) in enumerate(by[s]):
            changed = d is not None and zlib.crc32(str(d).encode()) % 5 == 0 and t is not None
            value, proof = leaf(d, t.translate(lower), lang, s, n) if changed else own, []
            for left, right in [*way(trees[s], i), *way(top, k)]:
                value = _h(*left, value, *right)
                proof += left + right
            out.append((d, own, trees[s][-1][0], root, _h(*proof), value, value == root))
    return out


def _key(row):
    return tuple((v is not None, v) for v in row)


def _manifest(spark, rows, **options):
    got = merkle.merkle_manifest(frame(spark, rows, True), *merkle.lower_cased_fifth(), **options)
    return sorted((tuple(r) for r in got.select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join("proof", ""), 256), "folded_root", "verified").collect()), key=_key)


def _many(n, sources, seed=5):
    rng = random.Random(seed)
    return [(i, rng.choice(["Some Text", "plain", None, "", "ÄÖ Ü"]) if i % 3 else f"Row {i}", "en", rng.choice(sources), rng.choice([None, 3])) for i in range(n)]


@pytest.mark.parametrize("rows", [hard(), _many(300, ["a"] * 5 + ["b", "c", None]), _many(17, ["a"]), _many(1, [None]), _many(60, [f"s{i}" for i in range(40)]),
                                  _many(273, ["z", "é", "", None] + [f"lone {i}" for i in range(30)]), [(7, "Same", "en", "a", 4)] * 40])
def test_manifest_is_that_of_plain_lists(spark, rows):
    assert _manifest(spark, rows, range_leaves=25) == sorted(brute_merkle(rows), key=_key)


def test_manifest_of_driver_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    rows = [tuple(r) for r in docs.collect()]
    got = op12_merkle_manifest(spark, SF)
    assert sorted(map(tuple, got.collect()), key=_key) == sorted(brute_merkle(rows), key=_key)
    bad = [r for r in got.collect() if not r.verified]
    assert bad and all(r.folded_root != r.root for r in bad)


def test_parents_resume_kept_states():
    kids = [_h(str(i)) for i in range(16)]
    parent = merkle.Parent("".join(kids))
    assert parent.digest == _h(*kids)
    for slot in range(16):
        assert parent.fold(slot, "x" * 64) == _h(*kids[:slot], "x" * 64, *kids[slot + 1:])
        assert parent.fold(slot, kids[slot]) == parent.digest
        assert parent.siblings(slot) == "".join(kids[:slot] + kids[slot + 1:])


def test_manifest_of_no_rows_and_without_tampering(spark):
    assert merkle.merkle_manifest(frame(spark, [])).count() == 0
    assert all(r.verified for r in merkle.merkle_manifest(frame(spark, hard(), True)).collect())


def test_proofs_leave_a_task_in_small_batches():
    """A batch of Spark's holds 10,000 runs, whose proofs are a GB together."""
    kids = [_h(str(i)) for i in range(16)]
    run = {"top_idx": 0, "subroot": kids[0], "path": ["".join(kids)] * 5, "top_path": ["".join(kids)], "items": [{"idx": i, "doc_id": i, "digest": d, "other": None} for i, d in enumerate(kids)]}
    given = merkle.pa.RecordBatch.from_pylist([run | {"run": n} for n in range(3 * merkle.RUNS + 1)])
    sizes = [(len(b), b.nbytes) for b in merkle._fold(iter([given]))]
    assert sum(n for n, _ in sizes) == 16 * len(given) and max(n for n, _ in sizes) <= 16 * merkle.RUNS and max(b for _, b in sizes) < 32 << 20


# Token files

def brute_tokens(rows, library):
    encoded = sorted(((d is not None, d or 0, [*library.encode(t or "", add_special_tokens=False).ids, 2]) for d, t in rows), key=lambda x: x[:2])
    out, past = [], 0
    for known, d, ids in encoded:
        out.append((d if known else None, past, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        past += len(ids)
    return out


def _written(spark, rows, tmp_path, **options):
    token_files.write_tokens(frame(spark, rows, True), f"file://{tmp_path}/t", **options)
    return token_files.read_tokens(spark, f"file://{tmp_path}/t")


@pytest.mark.parametrize("shard_ids", [1 << 26, 300])
def test_token_files_of_hard_and_odd_rows(spark, libraries, tmp_path, shard_ids):
    unique = [*[r for r in hard() if r[0] not in (None, 105)], *[(1000 + i, t, "en", "a", len(t)) for i, t in enumerate(ODD_TEXTS)]]
    tokens = _written(spark, unique, tmp_path, shard_ids=shard_ids, page_rows=4)
    got = sorted(tuple(r) for r in token_files.digests(tokens).collect())
    assert got == sorted(brute_tokens([r[:2] for r in unique], libraries[2]))
    assert spark.read.parquet(f"file://{tmp_path}/t/shards").count() == (1 if shard_ids > 300 else spark.read.parquet(f"file://{tmp_path}/t/ids").select("shard").distinct().count())


def test_token_files_with_repeated_and_null_ids(spark, libraries, tmp_path):
    rows = [*hard(), (50, "again, another text", "en", "a", 1)]
    tokens = _written(spark, rows, tmp_path, shard_ids=200)
    got = sorted(tokens.select("start", "n_tokens", "doc_id").collect())
    past = 0
    for r in got:  # starts have no gap, ids rise, nulls come first
        assert r.start == past
        past += r.n_tokens
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda d: (d is not None, d))
    want = Counter((d, n, c) for d, _, n, c in brute_tokens([r[:2] for r in rows], libraries[2]))
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files.digests(tokens).collect()) == want


def test_token_files_of_no_rows(spark, tmp_path):
    assert _written(spark, [], tmp_path).count() == 0


def test_layout_of_the_files(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    token_files.write_tokens(docs, f"file://{tmp_path}/t", group_bytes=200_000, page_bytes=20_000, page_rows=50)
    groups = 0
    for file in sorted((tmp_path / "t" / "ids").glob("*.parquet")):
        meta = pq.ParquetFile(file).metadata
        groups += meta.num_row_groups
        for g in range(meta.num_row_groups):
            own = {meta.row_group(g).column(k).path_in_schema.split(".")[0]: meta.row_group(g).column(k) for k in range(meta.num_columns)}
            assert all(c.has_column_index and c.has_offset_index for c in own.values())
            assert own["ids"].has_dictionary_page and "RLE_DICTIONARY" in own["ids"].encodings
            assert all("DELTA_BINARY_PACKED" in own[c].encodings and not own[c].has_dictionary_page for c in ("doc_id", "start", "n_tokens"))
    assert groups > 1
    plan = token_files.read_tokens(spark, f"file://{tmp_path}/t").where("doc_id between 10 and 12").select("start", "n_tokens")._jdf.queryExecution().toString()
    scan = next(x for x in plan.splitlines() if "FileScan parquet" in x and "doc_id" in x and "/ids" in x)
    assert "ids:array" not in scan.split("ReadSchema")[1] and "GreaterThanOrEqual(doc_id,10)" in scan


def test_stretches_of_the_corpus(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    folder = f"file://{tmp_path}/t"
    token_files.write_tokens(docs, folder, shard_ids=5_000, page_rows=20)
    rows = sorted(token_files.read_tokens(spark, folder).select("start", "ids").collect())
    flat = [i for r in rows for i in r.ids]
    for begin, end in ((0, 1), (4_990, 5_020), (12_345, 12_345), (100, 30_000), (len(flat) - 5, len(flat) + 50)):
        got = sorted(token_files.read_stretch(spark, folder, begin, end).collect())
        assert [i for r in got for i in r.ids] == flat[begin:end]
        assert not got or got[0].start == begin


def test_registered_token_files(spark, libraries):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(map(tuple, op13_token_files(spark, SF).collect()))
    assert got == brute_tokens([(r.doc_id, r.text) for r in docs], libraries[2])


def test_counts_of_alignment_carry_no_lists_of_ids(spark):
    docs = frame(spark, [(1, "one two", None, None, None), (2, None, None, None, None), (3, "two, three", None, None, None)])
    whole, bare = token_align.align_tokens(docs), token_align.align_tokens(docs, ids=False)
    assert not {"a_ids", "b_ids", "a_last", "b_last"} & set(bare.columns)
    assert sorted(map(tuple, bare.collect())) == sorted(tuple(r) for r in whole.select(bare.columns).collect())
    rows = {r.doc_id: r for r in whole.collect()}
    assert all(rows[k].a_last[-1] == rows[k].n_a - 1 and rows[k].b_last[-1] == rows[k].n_b - 1 and len(rows[k].a_last) == rows[k].n_groups for k in (1, 3)) and rows[2].a_ids == []
