import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest

from strideway.llm import op3_jaccard, op8_language, tokens
from tests.llm.test_dedup import brute_components, brute_lines, signed, words
from tests.llm.test_filters import brute_language, brute_targets


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


def fixture(spark, sf_dir):
    """The driver's smallest documents, with nulls, copies, shared lines, repeated ids and a hot source."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [tuple(r) for r in docs.where("doc_id % 3 = 0").collect()]
    text = {r[0]: r[1] for r in rows}
    some = [r for r in rows if r[1]][:4]
    lines = [f"the lines that {i} texts have in them" for i in range(4)]
    rows += [(100000 + i, f"the text of {i} has its own line\n" + "\n".join(lines) + f"\nand ends with {i}", "en", "hot", 0) for i in range(12)]
    rows += [(200000 + i, some[i % 4][1], "en", "hot", 0) for i in range(8)]
    rows += [(300000 + i, " ".join([*words(60, 3), f"x{i}"]), None, None, 0) for i in range(5)]
    rows += [(400000, None, "en", "a", None), (400001, "", "en", None, 0), (400002, "12 34 !", "en", "a", 0), (some[0][0], text[some[1][0]], "en", "b", 0), (None, "the words of a text without an id", "en", "a", 0)]
    return spark.createDataFrame(rows, docs.schema)


def test_stages_do_what_brute_force_does(spark, sf_dir):
    """Each stage on what the one before kept, and the whole run on the table itself."""
    docs = fixture(spark, sf_dir)
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    own = [tuple(r) for r in docs.collect()]

    model = op8_language.fit(docs)
    kept = stages["language"](spark, docs, sf_dir)
    assert kept.columns == columns
    assert rows_of(kept) == Counter(r for r in own if not brute_language(r[1], model)[2])
    assert kept.count() > 0.9 * len(own)

    docs, own = kept, [tuple(r) for r in kept.collect()]
    gone, want = brute_lines([r[:2] for r in own], True), []
    for i, text, lang, source, n in own:
        drop = gone.get((i, signed(text)), set()) if i is not None else set()
        left = "\n".join(x for k, x in enumerate(text.split("\n")) if k not in drop)
        if left.strip(" "):
            want.append((i, left, lang, source, len(left)))
    kept = stages["repeated_lines"](spark, docs, sf_dir)
    assert kept.columns == columns and rows_of(kept) == Counter(want) and sum(map(len, gone.values())) > 30

    docs, own = kept, want
    numbered = {k: r for k, r in enumerate(r for r in own if r[0] is not None)}
    order = sorted(numbered, key=lambda k: (numbered[k][0], signed(numbered[k][1])))
    place = {k: at for at, k in enumerate(order)}  # rows by (doc_id, hash of the text), as components are named after
    stay = {c for _, _, c in brute_components([(place[k], r[1]) for k, r in numbered.items()])}
    want = [r for k, r in numbered.items() if place[k] in stay] + [r for r in own if r[0] is None]
    kept = stages["near_copies"](spark, docs, sf_dir)
    assert kept.columns == columns and rows_of(kept) == Counter(want) and len(want) < len(own)

    docs, own = kept, want
    mixed = stages["source_mix"](spark, docs, sf_dir)
    found, sizes, taken = rows_of(mixed), Counter(), Counter()
    assert mixed.columns == columns and set(found) <= set(own) and all(n <= 2 * Counter(own)[r] for r, n in found.items())
    for _, text, _, source, _ in own:
        sizes[source] += len(text.split())
    for r, n in found.items():
        taken[r[3]] += n * len(r[1].split())
    longest = max(len(r[1].split()) for r in own)
    assert all(abs(taken[s] - t) <= longest for s, t in brute_targets(sizes).items())

    packed = stages["sequences"](spark, mixed, sf_dir).collect()
    check_packed(packed, found)


def check_packed(packed, rows):
    """rows: a counter of documents. Their ids, in pieces, lie one after another in sequences."""
    whole = tokens.WordEncoder(tokens.default_tokenizer()).whole
    want, places = Counter(), defaultdict(list)
    for r, n in rows.items():
        ids = [*whole.encode(r[1] or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            want[r[0], k, at, tuple(ids[at : at + 4096])] += n
    assert Counter((x["doc_id"], x["piece"], x["start"], tuple(x["ids"])) for x in packed) == want
    for x in packed:
        assert zlib.crc32(np.array(x["ids"], "<u4").tobytes()) == x["ids_crc32"] and len(x["ids"]) == x["length"]
        places[x["sequence_id"]].append((x["offset"], x["length"]))
    for own in places.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and sum(own[-1]) <= 4096


def test_run_is_its_stages_one_after_another(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    packed, key = corpus_pipeline.run(spark, sf_dir), ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert rows_of(packed.select(key)) == rows_of(docs.select(key)) and packed.count() > 0


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_empty_tables_and_nulls(spark, docs, sf_dir, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    assert stage(spark, docs([], extra=False), sf_dir).count() == 0
    rows = [(1, None, None, None), (None, "some words here", "en", "a"), (2, "", "en", None), (3, "some words here", "en", "a"), (3, "some words here", "en", "a")]
    stage(spark, docs(rows, extra=False), sf_dir).collect()


def test_clean_documents_stay(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert op8_language.recognised(docs, op8_language.fit(docs)).count() >= 0.98 * docs.count()
    kept = op3_jaccard.one_of_each(docs)
    again = op3_jaccard.jaccard_components(kept)
    assert again.where("doc_id <> component_id").count() == 0
