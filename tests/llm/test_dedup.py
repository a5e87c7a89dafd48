"""Exact, near, passage and line deduplication against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from strideway.llm import op3_jaccard, op4_substring, op7_line_dedup, op9_exact_dedup
from strideway.llm.common import rolled

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(n, seed, vocabulary=500):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def edge_rows():
    return [(1, None), (2, ""), (3, " \n\t "), (4, "Été one"), (5, "Été ONE"), (6, "Été one"), (None, "Été one"), (7, " ".join(words(9000, 7)))]


def corpus():
    r, rows = random.Random(3), edge_rows()
    base = words(120, 1)
    for i in range(40):  # one large group of near copies: each a few words off the base
        own = list(base)
        for _ in range(r.randrange(4)):
            own[r.randrange(len(own))] = f"x{i}"
        rows.append((100 + i, " ".join(own)))
    for i in range(30):  # unlike texts that share a passage of 60 words
        rows.append((200 + i, " ".join(words(150, 50 + i) + base[20:80] + words(100, 90 + i))))
    rows += [(300 + i, " ".join(words(3 + i % 4, i % 3))) for i in range(12)]
    rows += [(400 + i, " ".join(words(70, 5))) for i in range(10)]
    r.shuffle(rows)
    return rows


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    rows = [r for r in rows if r[0] is not None]
    sets = {i: shingles(t) for i, t in rows}
    label = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(label[a], label[b])
            if label[a] != m or label[b] != m:
                label[a] = label[b] = m
                changed = True
    return {(i, len(sets[i]), label[i]) for i in sets}


def test_jaccard_components_are_those_of_all_pairs(docs):
    rows = corpus()
    found = op3_jaccard.jaccard_components(docs(rows)).collect()
    assert len(found) == len(rows)
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in found if r["doc_id"] is not None} == brute_components(rows)
    assert [(r["class_id"], r["component_id"]) for r in found if r["doc_id"] is None] == [(None, None)]


@pytest.mark.parametrize("seed", range(2))
def test_jaccard_chains(docs, seed):
    """Texts that drift word by word: links join what isn't similar itself."""
    r, rows, own = random.Random(seed), [], words(60, seed)
    for i in range(60):
        own = list(own)
        own[r.randrange(len(own))] = f"n{i}"
        rows.append((i, " ".join(own)))
    found = op3_jaccard.jaccard_components(docs(rows)).collect()
    assert {(x["doc_id"], x["n_shingles"], x["component_id"]) for x in found} == brute_components(rows)


def test_jaccard_repeated_rows_and_empty_table(docs):
    text = " ".join(words(30, 2))
    found = op3_jaccard.jaccard_components(docs([(5, text), (5, text), (9, text)])).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in found) == [(5, 5), (5, 5), (9, 5)]
    assert op3_jaccard.jaccard_components(docs([])).count() == 0
    assert op3_jaccard.jaccard_components(docs([(1, None), (2, "")])).count() == 2


def test_jaccard_of_rows_that_share_a_doc_id(docs):
    """Each row has its own set, and one row of each component stays."""
    a, b = words(60, 1), words(60, 2)
    rows = [(5, " ".join(a)), (5, " ".join(b)), (6, " ".join([*a, "x"])), (7, " ".join(["x", *b])), (7, " ".join(["x", *b])), (8, None), (8, None), (5, "alone here"), (5, "alone here")]
    d = docs(rows)
    found = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in op3_jaccard.jaccard_components(d).collect())
    assert found == [(5, 1, 5), (5, 1, 5), (5, 56, 5), (5, 56, 5), (6, 57, 5), (7, 57, 5), (7, 57, 5), (8, 0, 8), (8, 0, 8)]
    kept = [(r["doc_id"], r["text"]) for r in op3_jaccard.one_of_each(d.withColumn("_print", F.lit(1))).collect()]
    assert sorted(map(str, kept)) == sorted(map(str, [(5, " ".join(a)), (5, " ".join(b)), (8, None), (8, None), (5, "alone here")]))


def test_a_shingle_of_all_documents_is_dealt_a_few_times_for_each_part(spark):
    base = " ".join(words(80, 1))
    d = spark.range(0, 3000, 1, 3).selectExpr("id AS doc_id", f"concat('{base} own', id, ' and', id) AS text").withColumn("print", F.xxhash64("text"))
    dealt = op3_jaccard.pack_sets(d, 5).agg(F.sum(F.length("tokens") / 4)).first()[0]
    assert dealt == 3 * 2 * 76 + 2 * 3000  # two documents of each of three parts for what all share, and what each has itself
    found = op3_jaccard.jaccard_components(d).groupBy("component_id").count().collect()
    assert [(x["component_id"], x["count"]) for x in found] == [(0, 3000)]


def test_one_of_each_keeps_columns(docs):
    d = docs(corpus())
    kept = op3_jaccard.one_of_each(d)
    assert kept.columns == d.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({c for _, _, c in brute_components(corpus())}) and ids.count(None) == 1


def brute_passages(rows, window):
    split = {i: WORD.findall(t or "") for i, t in rows if i is not None}
    first = {}
    for i in sorted(split):
        for k in range(len(split[i]) - window + 1):
            first.setdefault(tuple(split[i][k : k + window]), i)
    out = set()
    for i, w in split.items():
        gone = {k + j for k in range(len(w) - window + 1) if first[tuple(w[k : k + window])] < i for j in range(window)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.add((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize(("window", "period"), [(50, 21), (12, 7)])
def test_passages_are_those_of_all_windows(docs, window, period):
    rows = corpus()
    found = op4_substring.substring_dedup(docs(rows), window, period).collect()
    assert len(found) == len(rows)
    assert {(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found if r["doc_id"] is not None} == brute_passages(rows, window)
    for r in found:
        assert r["n_words"] - len(r["kept_text"].split()) == r["n_removed"] == sum(x["words"] for x in r["removed"])


def test_passages_empty_and_repeated(docs):
    assert op4_substring.substring_dedup(docs([])).count() == 0
    text = " ".join(words(60, 1))
    assert {r["n_removed"] for r in op4_substring.substring_dedup(docs([(1, text), (1, text)])).collect()} == {0}


def test_passages_of_rows_that_share_a_doc_id(docs):
    """Each row is judged by its own text, against smaller doc_ids only."""
    a, b = words(120, 1), words(200, 2)
    rows = [(1, " ".join(a)), (2, " ".join(a)), (2, "short text"), (2, " ".join(b)), (2, " ".join(b[50:])), (3, " ".join(["x", *b])), (3, None), (3, " ".join(a[:60]))]
    found = {(r["doc_id"], r["n_words"]): r["n_removed"] for r in op4_substring.substring_dedup(docs(rows)).collect()}
    assert found == {(1, 120): 0, (2, 120): 120, (2, 2): 0, (2, 200): 0, (2, 150): 0, (3, 201): 200, (3, 0): 0, (3, 60): 60}


def test_a_passage_of_all_documents_is_dealt_a_few_times_for_each_part(spark):
    """Bytes of the largest group grow with the parts of batches that hold a passage, not with the documents that do."""
    base = " ".join(words(80, 1))
    d = spark.range(0, 3000, 1, 3).selectExpr("id AS doc_id", f"concat('{base} own', id) AS text").withColumn("print", F.xxhash64("text"))
    dealt = op4_substring.anchor_hashes(d, 50, 21).withColumn("n", F.length("hashes") / 8)
    longest = dealt.groupBy("bucket").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0]
    assert longest <= 6 * 4  # two documents of each of three parts, for the few anchors of a bucket
    found = op4_substring.substring_dedup(d).groupBy("n_removed").count().collect()
    assert {x["n_removed"]: x["count"] for x in found} == {0: 1, 80: 2999}


@pytest.mark.parametrize("period", [1, 2, 3, 7, 13, 21])
def test_difference_cover(period):
    cover = op4_substring.difference_cover(period)
    for i in range(period):
        for j in range(period):
            assert any((i + d) % period in cover and (j + d) % period in cover for d in range(period))


def test_rolled_is_a_function_of_the_run():
    h = np.arange(1, 200, dtype="<u8") ** 3
    both = np.r_[h, h]
    for k in (1, 5, 8, 9, 30, 50):
        r = rolled(both, k)
        assert (r[: len(h) - k + 1] == r[len(h) : len(h) + len(h) - k + 1]).all() and len(np.unique(rolled(h, k))) == len(h) - k + 1


def test_exact_dedup_with_history(docs):
    rows = corpus()
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(LOWER), []).append(i)
    for cut in (-1, 150, 10_000):
        past, new = [r for r in rows if r[0] is not None and r[0] <= cut], [r for r in rows if r[0] is None or r[0] > cut]
        found = op9_exact_dedup.exact_dedup(docs(new), docs(past)).collect()
        assert len(found) == len(rows)
        for r in found:
            text = next(t for t, ids in groups.items() if hashlib.sha256(t.encode()).hexdigest() == r["text_sha256"])
            ids = [i for i in groups[text] if i is not None]
            assert (r["keep_id"], r["group_size"]) == (max(ids, default=None), len(groups[text]))
            assert r["kept"] == (r["doc_id"] == r["keep_id"])


def test_exact_dedup_edges(docs):
    assert op9_exact_dedup.exact_dedup(docs([])).count() == 0
    nulls = op9_exact_dedup.exact_dedup(docs([(None, "a"), (None, "A"), (None, "b"), (3, "b")])).collect()
    assert sorted((str(r["doc_id"]), r["keep_id"], r["group_size"], r["kept"]) for r in nulls if r["keep_id"] is None) == [("None", None, 2, True)] * 2
    assert {(r["doc_id"], r["kept"]) for r in nulls if r["keep_id"] == 3} == {(None, False), (3, True)}
    same = op9_exact_dedup.exact_dedup(docs([(1, "a"), (1, "a")])).collect()
    assert [(r["keep_id"], r["group_size"], r["kept"]) for r in same] == [(1, 2, True)] * 2


def test_perfect_hash_is_minimal():
    keys = np.frombuffer(b"".join(hashlib.sha256(str(i).encode()).digest() for i in range(3000)), "<u8").reshape(-1, 4)
    levels = op9_exact_dedup.build_levels(keys[:2000])
    assert sorted(op9_exact_dedup.slots(keys[:2000], levels)) == list(range(2000))
    assert (op9_exact_dedup.slots(keys[2000:], levels) < 2000).all()


def brute_chunks(lines):
    """The chunks of all boundary rules, worked out line by line with plain numbers."""
    import xxhash

    def mix(h):
        for k in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            h = (h ^ h >> 33) * k & (1 << 64) - 1
        return h ^ h >> 33

    h, out = [int.from_bytes(xxhash.xxh64_digest(x), "little") for x in lines], set()
    for width, spacing, salt in op7_line_dedup.RULES:
        last, begin = len(lines) - width, None
        for i in range(last + 1):
            v = 0
            for x in h[i : i + width]:
                v = (v * 0x9E3779B97F4A7C15 + x) & (1 << 64) - 1
            if i in (0, last) or mix(mix(v) ^ salt) % spacing == 0:
                if begin is not None:
                    out.add((begin, i + width - begin))
                begin = i
    return sorted(out)


def brute_lines(rows, extend):
    """What line_dedup removes, row by row: chunks by their bytes, then line by line around them."""
    names = {}  # rows by (doc_id, hash of the text), in the order of that hash
    for i, t in rows:
        if i is not None and t is not None:
            names[i, signed(t)] = t.encode().split(b"\n")
    first, chunks = {}, {k: brute_chunks(x) for k, x in names.items()}
    for k in sorted(names):
        for a, n in chunks[k]:
            first.setdefault(tuple(names[k][a : a + n]), (*k, a))
    out = {}
    for k, lines in names.items():
        gone, runs = set(), []
        for a, n in chunks[k]:
            place = first[tuple(lines[a : a + n])]
            if place != (*k, a):
                gone |= set(range(a, a + n))
                if not runs or a > max(x + m for x, m, _ in runs[-1]):
                    runs.append([])
                runs[-1].append((a, n, place))
        for i, run in enumerate(runs if extend else []):
            floor = max(x + m for x, m, _ in runs[i - 1]) if i else 0
            ceiling = runs[i + 1][0][0] if i + 1 < len(runs) else len(lines)
            a, _, (*other, b) = run[0]
            while a > floor and b > 0 and lines[a - 1] == names[tuple(other)][b - 1]:
                a, b = a - 1, b - 1
                gone.add(a)
            a, n, (*other, b) = min(run, key=lambda x: (-x[0] - x[1], x[0]))
            theirs = names[tuple(other)]
            while a + n < ceiling and b + n < len(theirs) and lines[a + n] == theirs[b + n]:
                gone.add(a + n)
                n += 1
        out[k] = gone
    return out


def signed(text):
    """Spark's xxhash64 of a string, with its seed."""
    import xxhash

    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def line_rows():
    r = random.Random(9)
    passage = [f"shared line {i}" for i in range(20)]
    rows = [(1, None), (2, ""), (3, "\n\n"), (None, "\n".join(passage)), (None, "\n".join(passage))]
    for i in range(30):
        own = [f"{i} own {k} {r.random()}" for k in range(r.randrange(12))]
        at = r.randrange(len(own) + 1)
        rows.append((10 + i, "\n".join(own[:at] + passage[i % 18 : i % 18 + r.randrange(2, 20)] + own[at:])))
    # one doc_id with other texts, and twice with the same
    rows += [(60, "\n".join(f"only {i}" for i in range(29))), (60, "one line"), (60, "\n".join(["x", *passage[3:9]])), (60, "\n".join(["x", *passage[3:9]]))]
    return rows + [(70, "\n".join(f"x {i}" for i in range(9000))), (71, "\n".join(f"x {i}" for i in range(4000, 9005)))]


@pytest.mark.parametrize("extend", [False, True])
def test_lines_against_brute_force(docs, extend):
    rows = line_rows()
    d, brute = docs(rows), brute_lines(line_rows(), extend)
    found = op7_line_dedup.line_dedup(d, extend=extend).collect()
    want = []
    for i, t in rows:
        lines = [] if t is None else t.split("\n")
        gone = brute[i, signed(t)] if i is not None and t is not None else set()
        kept = None if t is None else "\n".join(x for k, x in enumerate(lines) if k not in gone)
        want.append((i, len(lines), len(gone), hashlib.sha256((kept or "").encode()).hexdigest(), kept))
    assert sorted(map(str, want)) == sorted(str((x["doc_id"], x["n_lines"], x["n_removed"], x["kept_sha256"], x["kept_text"])) for x in found)
    texts = op7_line_dedup.line_dedup_texts(d.withColumn("_print", F.lit(1)).withColumn("_gone", F.lit(2)), extend)
    assert texts.columns == [*d.columns, "_print", "_gone"]
    assert sorted(map(str, ((i, k) for i, *_, k in want))) == sorted(str((x["doc_id"], x["text"])) for x in texts.collect())
    assert op7_line_dedup.line_dedup(docs([])).count() == 0


def repeated_lines(rows):
    """By row, the lines in runs of two or more that stand at a smaller (doc_id, hash of the text, place)."""
    first, gone = {}, {}
    for i, t in sorted({(i, t) for i, t in rows if i is not None and t is not None}, key=lambda x: (x[0], signed(x[1]))):
        lines, gone[i, t] = t.split("\n"), set()
        for k in range(len(lines) - 1):
            if first.setdefault((lines[k], lines[k + 1]), (i, t, k)) != (i, t, k):
                gone[i, t] |= {k, k + 1}
    return gone


def test_recall_of_repeated_lines(spark):
    """On the driver's documents at least nine tenths of the repeated lines go, with and without exact copies, and nothing else."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    for rows in (d, d.groupBy("text").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "text")):
        own = [(x["doc_id"], x["text"]) for x in rows.collect()]
        want = repeated_lines(own)
        found = {x["doc_id"]: x for x in op7_line_dedup.line_dedup(rows).collect()}
        total, hit = sum(map(len, want.values())), 0
        for (i, t), gone in want.items():
            assert found[i]["n_removed"] <= len(gone)
            hit += found[i]["n_removed"]
        print("recall of repeated lines:", hit, total)
        assert hit >= 0.9 * total


def test_boundaries_shift_with_the_lines():
    """Lines before and after change no chunk but those at the ends, and a chunk has two lines at least."""
    lines = [f"line {i}".encode() for i in range(60)]
    own, moved = op7_line_dedup.line_chunks(lines), op7_line_dedup.line_chunks([b"x", b"y", b"z", *lines, b"u"])
    inside = lambda chunks: {(a, n) for a, n in chunks if a > 0 and a + n < 60}
    assert inside(own) == inside({(a - 3, n) for a, n in moved}) and min(n for _, n in own) >= 2
    assert own == brute_chunks(lines) and 3 < max(n for _, n in own) and op7_line_dedup.line_chunks([b"one"]) == []


def test_chunks_are_few_for_their_lines():
    """The rules together make fewer than two chunks for a line, of more than two lines on average."""
    lines = [f"line {i}".encode() for i in range(5000)]
    chunks = op7_line_dedup.line_chunks(lines)
    assert len(chunks) < 1.8 * len(lines) and sum(n for _, n in chunks) > 2.5 * len(chunks)
