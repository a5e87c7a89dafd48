"""Phrases, fingerprints and spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from strideway.llm import op11_phrases, op12_simhash, op13_spelling
from strideway.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
EDGES = [(1, None), (2, ""), (3, " \n\t "), (4, "Été one"), (5, "Été ONE"), (6, "Été one"), (6, "Été one"), (None, "Été one"), (7, "." * 50)]


def prose(n, seed, vocabulary=5, mark=0.1):
    r = random.Random(seed)
    return "".join(r.choice(["w", "W", "é"]) + str(r.randrange(vocabulary)) + (r.choice([", ", "\n", ". ", "\t ", "\x0b"]) if r.random() < mark else " ") for _ in range(n))


def brute_phrases(rows, least, top):
    f, n = {}, Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    key = lang, tuple(w[i : i + k])
                    f[key] = f.get(key, 0) + 1
    out = []
    for lang in n:
        own = {p: c for (x, p), c in f.items() if x == lang and c >= least}
        rows = []
        for p, a in own.items():
            if len(p) < 2 or any(100 * c >= 80 * a and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) for q, c in own.items()):
                continue
            score, k = min((2000000 * a // (own[p[:k]] + own[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        for i, (s, a, p, x, y) in enumerate(sorted(rows)[:top]):
            out.append((lang, i + 1, p.decode(), -a, x, y, n[lang], -s))
    return sorted(out)


@pytest.mark.parametrize("shard_bytes", [300, 16_000_000])
def test_phrases_agree_with_a_plain_count(docs, shard_bytes, monkeypatch):
    if shard_bytes == 300:
        monkeypatch.setattr(op11_phrases, "RANGE_WORDS", 200)
    rows = [(*r, None) for r in EDGES] + [(100 + i, prose(60, i), ["en", "de", None][i % 3]) for i in range(40)] + [(200, prose(9000, 5, 12), "fr")]
    found = op11_phrases.collocations(docs(rows).repartition(3), least=8, top=60, shard_bytes=shard_bytes)
    got = sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in found.collect())
    assert got == brute_phrases(rows, 8, 60) and len(got) > 100


def test_phrases_know_what_stands_beside_them(docs):
    text = "a b c. " * 9 + "x b c. " * 9 + "b d. " * 9
    every, totals = op11_phrases.phrases(docs([(1, text, "en")]), least=9)
    found = {r["phrase"]: (r["f"], r["n_left"], r["n_right"]) for r in every.collect()}
    assert found["b"] == (27, 2, 2) and found["b c"] == (18, 2, 0) and found["a b"] == (9, 0, 1) and found["a b c"] == (9, 0, 0)
    assert [tuple(r) for r in totals.collect()] == [("en", 72)]


def test_phrases_of_an_empty_table(docs):
    assert op11_phrases.collocations(docs([])).count() == 0
    assert op11_phrases.collocations(docs(EDGES[:3])).count() == 0


def test_a_transform_leads_to_every_occurrence():
    r = np.random.default_rng(1)
    seq = np.concatenate([[0], r.integers(0, 5, 400), [0]])
    bwt = op11_phrases.transform(seq)
    count = np.bincount(bwt, minlength=5)
    lo, count, known = np.cumsum(count)[:-1], count[1:], [(s,) for s in range(1, 5)]
    for k in range(2, 5):
        symbol, owner, place, n, start = op11_phrases.extended(bwt, lo, count)
        own = {(int(s), *known[o]): int(c) for s, o, c in zip(symbol, owner, n, strict=True)}
        runs = Counter(tuple(seq[i : i + k].tolist()) for i in range(len(seq) - k + 1))
        assert own == {p: c for p, c in runs.items() if 0 not in p}
        assert all(known[s] == (int(x), *known[o])[:-1] for x, o, s in zip(symbol, owner, start, strict=True))
        order = np.argsort(place)
        lo, count, known = place[order], n[order], [(int(symbol[i]), *known[owner[i]]) for i in order]


def brute_print(text):
    w = [x.encode() for x in WORD.findall((text or "").translate(LOWER))]
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, radius=2):
    label = list(range(len(prints)))
    links = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= radius]
    changed = True
    while changed:
        changed = False
        for i, j in links:
            m = min(label[i], label[j])
            changed |= label[i] != m or label[j] != m
            label[i] = label[j] = m
    return label


def test_fingerprints_and_their_components_agree_with_brute_force(docs):
    r, rows = random.Random(2), list(EDGES)
    base = [f"w{r.randrange(900)}" for _ in range(400)]
    for i in range(60):
        own = list(base)
        for _ in range(r.randrange(3)):
            own[r.randrange(len(own))] = f"x{i}"
        rows.append((100 + i, " ".join(own)))
    rows += [(300 + i, prose(3 + i, i)) for i in range(40)] + [(400, prose(150_000, 3, 50))]
    found = op12_simhash.simhash_components(docs(rows)).collect()
    prints = [brute_print(t) for _, t in rows]
    label = brute_components(prints)
    least = {c: min((d for (d, _), x in zip(rows, label, strict=True) if x == c and d is not None), default=None) for c in label}
    want = sorted((str(d), f"{p:016x}", least[c]) for (d, _), p, c in zip(rows, prints, label, strict=True))
    assert sorted((str(x["doc_id"]), x["fingerprint"], x["component_id"]) for x in found) == want
    assert len({x["component_id"] for x in found}) < len({x["fingerprint"] for x in found})
    assert op12_simhash.simhash_components(docs([])).count() == 0


@pytest.mark.parametrize("most", [4, 64, 4096])
def test_shards_lose_no_link_of_a_dense_cloud(spark, most):
    """Fingerprints close around a few centres, so that shards are dealt again and again."""
    r = np.random.default_rng(4)
    centres = r.integers(0, 1 << 63, 4, np.uint64)
    flips = [sum(1 << int(b) for b in r.choice(64, r.integers(0, 4), replace=False)) for _ in range(500)]
    prints = sorted({int(centres[i % 4]) ^ f for i, f in enumerate(flips)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    dealt = op12_simhash.shards(spark.createDataFrame([(p,) for p in signed], "fp long"), 2, most)
    assert dealt.groupBy("path", "value").count().where("count > 4096").count() == 0
    edges = [(a & (1 << 64) - 1, b & (1 << 64) - 1) for a, b in op12_simhash.links(dealt, 2).collect()]
    at = {p: i for i, p in enumerate(prints)}
    label = list(range(len(prints)))
    for _ in prints:
        old = list(label)
        for a, b in edges:
            label[at[a]] = label[at[b]] = min(label[at[a]], label[at[b]])
        if old == label:
            break
    want = brute_components(prints)
    assert len(set(zip(label, want, strict=True))) == len(set(label)) == len(set(want)) > 4


def test_a_tree_has_a_child_for_each_distance():
    r = np.random.default_rng(5)
    fp = r.integers(0, 256, 300, np.uint64)
    root = np.repeat([0, 100], [100, 200])
    keys, nodes = op12_simhash.forest(fp, root)
    assert len(set(keys.tolist())) == len(keys) == 298 and sorted(nodes.tolist() + [0, 100]) == list(range(300))
    assert all((int(fp[k // 65]) ^ int(fp[n])).bit_count() == k % 65 for k, n in zip(keys, nodes, strict=True))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def brute_variants(rows):
    n = Counter()
    for d, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", (text or "").translate(LOWER)):
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 199 == 0 else w] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    near = {w: [x for x in n if abs(len(x) - len(w)) < 2 and distance(w, x) == 1] for w in n}
    best = {w: min(((-n[x], x) for x in near[w]), default=None) for w in n}
    form = {w: b[1] if b and -b[0] >= 5 * n[w] else None for w, b in best.items()}
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=str)


def spellings(seed):
    r, rows = random.Random(seed), list(EDGES)
    syllables = ["eau", "ou", "tion", "é", "ment", "ß÷", "an", "st", "b"]
    vocabulary = ["".join(r.choice(syllables) for _ in range(r.randrange(2, 5))) for _ in range(90)]
    for i in range(300):
        own = []
        for _ in range(120):
            w = vocabulary[int(len(vocabulary) * r.random() ** 3)]
            if r.random() < 0.15:
                at = r.randrange(len(w) + 1)
                w = w[:at] + r.choice(["", "x", "é"]) + w[at + r.randrange(2) :]
            own.append(r.choice([w, w.upper(), w.capitalize()]))
        rows.append((100 + i, " ".join(own)))
    return rows


@pytest.mark.parametrize(("most", "detail"), [(64, 4096), (2, 20), (3, 1)])
def test_variants_agree_with_brute_force(docs, most, detail):
    rows = spellings(detail)
    found = op13_spelling.spelling_variants(docs(rows), most, detail)
    got = sorted((tuple(x[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for x in found.collect()), key=str)
    want = brute_variants(rows)
    assert got == want and sum(x[1] is not None for x in got) > 20
    assert op13_spelling.spelling_variants(docs(EDGES)).count() == 0
    assert op13_spelling.spelling_variants(docs([])).count() == 0


def test_the_query_agrees_with_brute_force(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    found = QUERIES["op13_spelling_variants"](spark, sf_dir).collect()
    assert sorted((tuple(x[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for x in found), key=str) == brute_variants(rows)


def test_the_bound_on_affected_grams_holds():
    """Whatever the edit, the words' grams in common are as many as the bounds of both say."""
    r = random.Random(6)
    for longest in (2, 3, 4, 5):
        words = ["".join(r.choice("aabbc") for _ in range(r.randrange(6, 12))) for _ in range(300)]
        every = Counter(w[p : p + q] for w in words for q in range(2, longest + 1) for p in range(len(w) - q + 1))
        grams = op13_spelling.Grams({g: c for g, c in every.items() if len(g) == 2 or every[g[:-1]] > 60}, longest=longest)
        for w in words:
            at = r.randrange(len(w))
            x = r.choice([w[:at] + w[at + 1 :], w[:at] + "c" + w[at:], w[:at] + "b" + w[at + 1 :]])
            own, other = ({s[a:b] for a, b in grams.cut(s)} for s in (w, x))
            assert len(own & other) >= max(len(own) - grams.affected(w, grams.cut(w)), len(other) - grams.affected(x, grams.cut(x)))
