"""Packing and token files: round trips and invariants against the tokenizer itself."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from strideway.llm import op1_packing, op10_token_files, tokens

TEXTS = [None, "", "   ", "a\x1cb c\x85d e", "It's I'm <|endoftext|>x ÀÉß ñandú 12 34a!!?", "İstanbul ΣΑΣ é ̈x ﬁ", "日本語 テキスト、 ok", " ́a", "it’s «x»", "don't we'll 3's 'tis 'S", "A" * 5000, "word " * 9000]


@pytest.fixture(scope="module")
def whole():
    return tokens.WordEncoder(tokens.default_tokenizer())


def ids_of(whole, text):
    return [*whole.whole.encode(text or "", add_special_tokens=False).ids, tokens.END_ID]


@pytest.mark.parametrize("most", [3, 350_000])
def test_cached_words_encode_like_whole_texts(whole, most):
    e = tokens.WordEncoder(tokens.default_tokenizer(), most)
    for _ in range(2):
        ids, at = tokens.with_end(*e.encode(pa.array(TEXTS, pa.string())))
        for i, t in enumerate(TEXTS):
            assert ids[at[i] : at[i + 1]].tolist() == ids_of(whole, t)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing(docs, whole):
    r = random.Random(1)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100 + i, "tok " * r.choice([3, 700, 700, 700, 1300, 4000, 4095, 4096])) for i in range(60)] + [(None, "x"), (100, "tok " * 5), (100, "tok " * 5)]
    found = op1_packing.pack_documents(docs(rows)).collect()
    want = Counter()
    for i, t in rows:
        ids = ids_of(whole, t)
        for k, at in enumerate(range(0, len(ids), 4096)):
            own = ids[at : at + 4096]
            want[i, k, at, len(own), crc(own)] += 1
    assert Counter((x["doc_id"], x["piece"], x["start"], x["length"], x["ids_crc32"]) for x in found) == want
    assert all(crc(x["ids"]) == x["ids_crc32"] for x in found)
    sequences = defaultdict(list)
    for x in found:
        sequences[x["sequence_id"]].append((x["offset"], x["length"]))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 4096
    assert op1_packing.pack_documents(docs([])).count() == 0


def test_packing_of_pieces_with_clashing_columns(spark):
    """Whatever the pieces' other columns are called, they stay as they are; own places are replaced."""
    names = ["at", "rank_from", "rank_to", "in_each", "first_sequence", "_bucket", "_rank", "_n", "_before", "_plan_at", "_length"]
    rows = spark.range(200).selectExpr("id AS doc_id", "0 AS piece", "id % 40 + 1 AS length", "-1L AS sequence_id", *[f"id * {i + 2} AS {c}" for i, c in enumerate(names)])
    found = op1_packing.best_fit_pack(rows, 50)
    assert found.columns == ["doc_id", "piece", "length", *names, "sequence_id", "offset"]
    got = found.collect()
    assert len(got) == 200 and all(x[c] == x["doc_id"] * (i + 2) for x in got for i, c in enumerate(names))
    held = {}
    for x in got:
        held.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
    assert all(sorted(v)[0][0] == 0 and sum(n for _, n in v) <= 50 and all(a + n == b for (a, n), (b, _) in zip(sorted(v), sorted(v)[1:], strict=False)) for v in held.values()) and -1 not in held


def test_an_index_is_read_from_the_row_that_is_asked_for(docs, spark):
    uri = op10_token_files.new_folder(spark)
    op10_token_files.write_token_files(docs([(i, "some words " * (i % 7)) for i in range(60)]), uri, shards=2)
    manifest = spark.read.parquet(f"{uri}/manifest").orderBy("shard").collect()
    source, base = op10_token_files.opened(uri)
    for m in manifest:
        whole = op10_token_files.read_index(source, f"{base}/{m['file']}", m["index_at"], 0, m["n_docs"])
        assert whole["start"].tolist() == (np.cumsum(whole["n_tokens"]) - whole["n_tokens"]).tolist()
        part = op10_token_files.read_index(source, f"{base}/{m['file']}", m["index_at"], 5, 4)
        assert part.tolist() == whole[5:9].tolist()
    very_long = docs([(1, "word " * 60_000), (2, None), (3, "x")])
    uri = op10_token_files.new_folder(spark)
    op10_token_files.write_token_files(very_long, uri)
    assert [(x["start"], x["n_tokens"]) for x in op10_token_files.read_token_files(spark, uri, block=1).orderBy("doc_id").collect()] == [(0, 60_001), (60_001, 1), (60_002, 2)]


@pytest.mark.parametrize("seed", range(5))
def test_plan_is_best_fit_one_by_one(seed):
    r = random.Random(seed)
    lengths = Counter(r.randrange(1, 50) for _ in range(r.randrange(1, 400)))
    rows = op1_packing.plan_best_fit(dict(lengths), 50)
    bins = []
    for n in sorted(lengths.elements(), reverse=True):
        fit = min((b for b in range(len(bins)) if bins[b] >= n), key=lambda b: bins[b], default=None)
        if fit is None:
            bins.append(50 - n)
        else:
            bins[fit] -= n
    used, placed = defaultdict(list), Counter()
    for length, a, b, first, each, at in rows:
        for rank in range(a, b):
            used[first + (rank - a) // each].append((at + (rank - a) % each * length, length))
        placed[length] += b - a
    assert placed == lengths and len(used) == len(bins)
    for s in used.values():
        s.sort()
        assert all(x + n == y for (x, n), (y, _) in zip(s, s[1:], strict=False)) and s[0][0] == 0 and sum(s[-1]) <= 50


def test_token_files_round_trip(docs, whole, spark):
    rows = [(50 - i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (7, "twice"), (7, "twice")] + [(1000 + i, f"short text {i}") for i in range(200)]
    uri = op10_token_files.new_folder(spark)
    manifest = op10_token_files.write_token_files(docs(rows), uri, shards=3)
    found = op10_token_files.read_token_files(spark, uri, block=7, keep_ids=True).collect()
    start, want = 0, []
    for i, t in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        ids = ids_of(whole, t)
        want.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(((x["doc_id"], x["start"], x["n_tokens"], x["ids_crc32"]) for x in found), key=lambda x: x[1]) == want
    assert all(crc(x["ids"]) == x["ids_crc32"] for x in found)
    first = min(manifest.collect(), key=lambda m: m["shard"])
    assert crc(op10_token_files.read_document(uri, first["file"], 1)) == want[1][3]


def test_token_files_of_nothing(docs, spark):
    uri = op10_token_files.new_folder(spark)
    op10_token_files.write_token_files(docs([]), uri)
    assert op10_token_files.read_token_files(spark, uri).count() == 0


def test_tokenizers_of_other_rules_encode_whole_texts():
    import public_tokenizers

    e = tokens.WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert not e.by_words
    ids, at = e.encode(pa.array(TEXTS, pa.string()))
    for i, t in enumerate(TEXTS):
        assert ids[at[i] : at[i + 1]].tolist() == e.whole.encode(t or "", add_special_tokens=False).ids
