"""URL filter, mixing, quality labelling and language ID."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strideway.llm import op2_url_filter, op5_mixing, op6_quality, op8_language

URLS = [None, "", "no scheme", "http://", "HTTP://A.Example.ORG/es/x?q#f", "https://example.org/en/12", "https://example.org/enx", "https://x.com/fr/1", "https://x.com/de/1", "https://com/de/", "ftp://u@h.co.uk:80/p#?", "http://notexample.org?x://y", "a://b://c/d", "http://x.org", "http://Ünï.Com/fr/é"]


def test_rules_longest_wins(spark):
    pages = spark.createDataFrame([(i, u, "html", "host") for i, u in enumerate(URLS)], "page_id long, url string, html string, host string")
    outcomes = spark.createDataFrame([], "page_id long, good boolean")
    found = {r["page_id"]: r for r in op2_url_filter.url_filter(pages, outcomes).collect()}
    assert len(found) == len(URLS)
    for i, url in enumerate(URLS):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]) if m else ""
        path = m[2] if m else ""
        fits = [(len(h + p), h + p, v) for v, h, p in op2_url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (found[i]["host"], found[i]["path"], found[i]["rule"]) == (host, path, max(fits)[1] if fits else None)
        if fits:
            assert found[i]["verdict"] == max(fits)[2]
    assert op2_url_filter.url_filter(pages.limit(0), outcomes).count() == 0


def test_reputation_shrinks_and_blocks(spark):
    r, pages, good = random.Random(1), [], []
    for k in range(3000):
        host = r.choice(["good.net", "a.good.net", "bad.net", "b.bad.net", f"h{k % 40}.info"])
        pages.append((k, f"http://{host}/{k}"))
        good.append((k, r.random() < (0.1 if "bad" in host else 0.95)))
    pages += [(9000, "http://new.bad.net/"), (9001, "http://new.good.net/"), (9002, "http://one.info/"), (None, "http://good.net/")]
    good += [(9002, False), (None, False)]
    p, o = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(good, "page_id long, good boolean")
    found = {x["host"]: x for x in op2_url_filter.url_filter(p, o, rules=(("allow", "none.example", "/"),)).collect()}
    assert found["bad.net"]["verdict"] == found["b.bad.net"]["verdict"] == "block"
    assert found["new.bad.net"]["mean"] < found["new.good.net"]["mean"] and found["good.net"]["verdict"] == "allow"
    assert found["one.info"]["verdict"] == "allow"  # one bad page is no reputation


def shares(spark, hosts, n):
    """Pages of hosts (name, share of good ones), n to each, with outcomes that come as close to the share as they can."""
    named = spark.createDataFrame(hosts, "host string, share double")
    rows = named.crossJoin(spark.range(n)).selectExpr("concat(host, '-', id) AS page", "host", "id", "floor((id + 1) * share) > floor(id * share) AS good")
    rows = rows.selectExpr("xxhash64(page) AS page_id", "concat('http://', host, '/', id) AS url", "good", "repeat('x', 5) AS html", "host")
    return rows, rows.select("page_id", "good")


@pytest.mark.parametrize("n", [10, 100, 10_000])
def test_hosts_like_the_others_are_never_blocked_and_bad_ones_are(spark, n):
    """Whatever the number of pages: of equal hosts, and of hosts that differ by a few hundredths, none; far worse ones, all."""
    equal = [(f"h{i}.net", 0.9) for i in range(30)]
    near = [(f"h{i}.net", 0.9 + 0.002 * i) for i in range(30)]
    for hosts in (equal, near):
        pages, good = shares(spark, hosts, n)
        assert op2_url_filter.url_filter(pages, good, rules=()).where("verdict = 'block'").count() == 0
    if n > 10:
        pages, good = shares(spark, [*near, *[(f"bad{i}.info", 0.3) for i in range(4)]], n)
        found = op2_url_filter.url_filter(pages, good, rules=()).where("verdict = 'block'").select("host").distinct().collect()
        assert {x["host"] for x in found} == {f"bad{i}.info" for i in range(4)}


def test_verdicts_of_the_real_tables_are_rules_or_tolerance(spark):
    """Their hosts are alike, so what no rule fits stays; and it follows from the bound in each row."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    found = op2_url_filter.url_filter(pages, op2_url_filter.page_outcomes(pages)).collect()
    assert {x["verdict"] for x in found} == {"allow", "block"}
    free = [x for x in found if x["rule"] is None]
    assert len(free) > 100 and all((x["verdict"] == "block") == (x["upper"] < x["overall"] * op2_url_filter.TOLERANCE) for x in free)
    assert min(x["mean"] for x in free) > 0.8 and all(x["verdict"] == "allow" for x in free)


def test_suffixes_of_a_table(spark):
    hosts = spark.createDataFrame([(h,) for h in ("a.b.co.uk", "co.uk", "b.co.uk:80", "x.y.city.kawasaki.jp", "me@a.com", "com", "", "a.b.example.com")], "host string")
    of = lambda suffixes=None: {x["host"]: (x["suffix"], x["domain"]) for x in op2_url_filter.levels(hosts, suffixes).collect()}
    plain = {"me@a.com": ("com", "a.com"), "com": ("com", "com"), "": ("", ""), "a.b.example.com": ("com", "example.com")}
    assert of() == plain | {"a.b.co.uk": ("co.uk", "b.co.uk"), "co.uk": ("co.uk", "co.uk"), "b.co.uk:80": ("co.uk", "b.co.uk"), "x.y.city.kawasaki.jp": ("jp", "kawasaki.jp")}
    more = spark.createDataFrame([("city.kawasaki.jp",), ("kawasaki.jp",), ("kawasaki.jp",)], "suffix string")
    assert of(more)["x.y.city.kawasaki.jp"] == ("city.kawasaki.jp", "y.city.kawasaki.jp") and of(more)["a.b.co.uk"] == ("uk", "co.uk")


def test_very_long_html_and_repeated_pages(spark):
    rows = [(1, "http://a.net/", "word " * 200_000), (1, "http://a.net/2", "# " * 200_000), (2, "http://b.net/", None), (None, "http://b.net/", "<script>" + "#" * 100_000 + "</script> one"), (3, None, "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    outcomes = {(x["page_id"], x["good"]) for x in op2_url_filter.page_outcomes(pages).collect()}
    assert outcomes == {(1, True), (1, False), (2, None), (None, True), (3, True)}
    found = op2_url_filter.url_filter(pages, op2_url_filter.page_outcomes(pages), rules=())
    assert found.count() == 5 and {x["n_rows"] for x in found.groupBy("page_id").agg(F.count("*").alias("n_rows")).where("page_id = 1").collect()} == {2}


def test_of_rules_as_long_the_verdict_of_the_last_in_order_wins(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x")], "page_id long, url string")
    none = spark.createDataFrame([], "page_id long, good boolean")
    rules = (("block", "a.org", "/"), ("allow", "a.org", "/"))
    for own in (rules, rules[::-1]):
        x = op2_url_filter.url_filter(pages, none, rules=own).first()
        assert (x["rule"], x["verdict"]) == ("a.org/", "block")


def brute_targets(sizes, weights=(5, 2, 1)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    held, rest = {}, sum(sizes.values()) * 1.5
    while True:
        open_ = [s for s in names if s not in held]
        level = rest / sum(w[s] for s in open_) if open_ else 0
        above = [s for s in open_ if level * w[s] > 2 * sizes[s]]
        if not above:
            return {s: held.get(s, level * w[s]) for s in names}
        for s in above:
            held[s] = 2 * sizes[s]
            rest -= held[s]


@pytest.mark.parametrize("seed", range(2))
def test_mix(docs, seed):
    r = random.Random(seed)
    names = ["b", "a", "ä", None, "hot", "z", "void"]
    rows = [(i, None if r.random() < 0.02 else "w " * r.randrange(0, 60), None, r.choices(names, [3, 1, 2, 1, 9, 1, 0])[0]) for i in range(1500)] + [(5000, "", None, "void"), (None, "one two", None, "a")]
    d = docs(rows)
    found = op5_mixing.mix_report(d).collect()
    assert len(found) == len(rows)
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += len((t or "").split())
    targets = brute_targets(sizes)
    taken, of = Counter(), {i: s for i, _, _, s in rows}
    for x in found:
        s = of[x["doc_id"]]
        assert x["source_size"] == sizes[s] and x["target"] == pytest.approx(targets[s]) and x["taken"] <= 2 * x["size"]
        taken[s] += x["taken"]
    for s in targets:
        assert abs(taken[s] - targets[s]) <= 60
    assert sorted(map(str, found)) == sorted(map(str, op5_mixing.mix_report(d.repartition(7)).collect()))
    mixed = op5_mixing.mix_sources(d)
    assert mixed.columns[: len(d.columns)] == d.columns
    shards = Counter(x["mix_shard"] for x in mixed.collect())
    assert len(shards) == op5_mixing.LEAST_SHARDS
    assert op5_mixing.mix_report(docs([])).count() == 0


def test_mix_of_null_and_repeated_ids_and_clashing_columns(spark):
    """Sources made of null ids, of one id, and of an id that another source has too; every row is a document of its own."""
    rows = [(None, "w " * 20, "nulls", i) for i in range(50)] + [(7, f"x{i} " * 21, "one", i) for i in range(41)] + [(7, "y " * 10, "third", i) for i in range(40)] + [(7, None, None, 0)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, copy int").selectExpr("*", "1 AS _shard", "2 AS row", "'x' AS mix_row", "3 AS mix_shard", "4 AS order", "5 AS block")
    found = op5_mixing.mix_report(d).collect()
    sizes, taken = {"nulls": 1000, "one": 861, "third": 400, None: 0}, Counter()
    targets = brute_targets(sizes)
    size_to_source = {v: k for k, v in sizes.items()}
    for x in found:
        s = size_to_source[x["source_size"]]
        assert x["target"] == pytest.approx(targets[s]) and x["taken"] in (0, x["size"], 2 * x["size"])
        assert len(x["shards"]) == len(x["places"]) == (x["taken"] // x["size"] if x["size"] else 0)
        taken[s] += x["taken"]
    assert len(found) == len(rows) and all(abs(taken[s] - t) <= 11 for s, t in targets.items())
    mixed = op5_mixing.mix_sources(d)
    assert Counter(mixed.columns) == Counter([c for c in d.columns if c != "mix_shard"] + ["mix_copy", "mix_shard", "mix_place"])
    mixed = mixed.collect()
    words = Counter()
    for x in mixed:
        words[x["source"]] += len(x["text"].split())
    assert all(abs(words[s] - t) <= 11 for s, t in targets.items())
    assert Counter(s for x in found for s in x["shards"]) == Counter(x["mix_shard"] for x in mixed)
    copies = Counter((x["source"], x["copy"]) for x in mixed)  # copy: the rows' own column, which tells them apart
    assert max(copies.values()) == 2


def test_shards_share_real_draws_only(docs):
    """With equal words a block is one draw or none: shards hold as many draws of each source as split_quotas says."""
    rows = [(i, "w " * 10, None, "hot") for i in range(6000)] + [(10000 + i, "w " * 10, None, "b") for i in range(1500)]
    d = docs(rows)
    taken, drawn = op5_mixing.mix_plan(d.withColumnRenamed("doc_id", "row").withColumn("doc_id", F.col("row")), weights=(5, 1), share=0.5)
    got = drawn.select("source_no", "shard", "block", "copy").distinct().groupBy("source_no", "shard").count().collect()
    got = {(x["source_no"], x["shard"]): x["count"] for x in got}
    target = {x["source"]: (x["target"], x["source_size"]) for x in taken.select("source", "target", "source_size").distinct().collect()}
    assert target["hot"][0] < target["hot"][1] / 2
    quota = Counter()
    for (no, _), n in got.items():
        quota[no] += n
    quotas = d.sparkSession.createDataFrame(sorted(quota.items()), "source_no long, quota long")
    assert got == {(x["source_no"], x["shard"]): x["draws"] for x in op5_mixing.split_quotas(quotas).collect()}


def test_quotas_add_up_and_draws_follow_the_distribution(spark):
    q = spark.createDataFrame([(1, 700), (2, 250), (3, 51), (4, 1)], "source_no long, quota long")
    found = op5_mixing.split_quotas(q, 8, seed=4).collect()
    by_source, by_shard = Counter(), Counter()
    for x in found:
        by_source[x["source_no"]] += x["draws"]
        by_shard[x["shard"]] += x["draws"]
    assert by_source == {1: 700, 2: 250, 3: 51, 4: 1} and max(by_shard.values()) - min(by_shard.values()) <= 3
    sql = op5_mixing.hypergeometric("60L", "25L", "20L", "u")
    drawn = [r["n"] for r in spark.range(4000).select(F.rand(1).alias("u")).select(F.expr(sql).alias("n")).collect()]
    assert np.mean(drawn) == pytest.approx(20 * 25 / 60, abs=0.1) and np.var(drawn) == pytest.approx(20 * (25 / 60) * (35 / 60) * (40 / 59), rel=0.12)


def brute_counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines, dup, seen = (text or "").split("\n"), 0, set()
    for x in lines:
        dup += bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in seen
        seen.add(x)
    tri = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    cover = {i + k for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(cover)


def test_quality_counts_and_verdicts(docs, spark, sf_dir):
    real, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    field = op6_quality.fit(real, labels)
    rows = [(1, None), (2, ""), (3, "a b a b a b a"), (4, "é" * 9), (5, "x\nx\n \n \nx y\r\nx y\r\n"), (6, "one two " * 9000), (None, "# *"), (7, "\n".join(f"word{i} and line {i * 7} of text." for i in range(40)))]
    found = op6_quality.quality(docs(rows), field, keep_spans=True).collect()
    for (i, t), x in zip(sorted(rows, key=lambda r: (r[0] is None, r[0])), sorted(found, key=lambda x: (x["doc_id"] is None, x["doc_id"])), strict=True):
        c = brute_counts(t)
        assert (x["doc_id"], x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"]) == (i, *c)
        assert x["base_failed"] == (c[0] < 50 or 2 * c[4] > c[0]) and not (x["base_failed"] and x["kept"])
        assert len(x["line_labels"]) == len((t or "").split("\n"))
    assert op6_quality.quality(docs([]), field).count() == 0
    more = "/root/testdata/sf0.01"
    whole, marks = spark.read.parquet(f"{more}/documents.parquet"), spark.read.parquet(f"{more}/labels.parquet")
    half = op6_quality.fit(whole, marks.where("doc_id % 2 = 0"))
    judged = op6_quality.quality(whole, half).join(marks.where("doc_id % 2 = 1"), "doc_id").where("not base_failed").collect()
    assert np.mean([x["kept"] == (x["quality"] == 1) for x in judged]) > 0.9
    assert np.mean([x["kept"] for x in judged if x["quality"] == 1]) > 0.97
    assert op6_quality.fit(real, labels.where("quality = 1")) is None
    assert all(x["kept"] != x["base_failed"] for x in op6_quality.quality(real, None).collect())


def test_viterbi_is_the_best_of_all_labellings():
    r = np.random.default_rng(1)
    field = op6_quality.LineField(r.normal(size=op6_quality.N_BINS), r.normal(size=(2, 2)), r.normal(size=2))
    for _ in range(20):
        bins = r.integers(0, op6_quality.N_BINS, (6, 11))
        score = field.bins[bins].sum(axis=1)

        def value(y, score=score):
            return field.first[y[0]] + sum(score[i] * y[i] for i in range(6)) + sum(field.pairs[a, b] for a, b in zip(y, y[1:], strict=False))

        best = max((tuple(k >> i & 1 for i in range(6)) for k in range(64)), key=value)
        assert tuple(op6_quality.decode(field, bins)) == best


def test_language(docs, spark):
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = op8_language.fit(real)
    found = op8_language.predict(real, model).join(real.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([x["lang_pred"] == x["lang"] for x in found]) > 0.97 and len(found) > 150
    rows = [(1, None), (2, ""), (3, "12 !! \n ¿"), (4, "é"), (None, "zzz"), (5, "the and of " * 20000), (5, "the and of " * 20000)]
    got = op8_language.predict(docs(rows), model).collect()
    assert sorted(x["doc_id"] for x in got if x["lang_pred"] == "und") == [1, 2, 3] and len(got) == len(rows)
    assert all(0 <= x["score"] <= 1 and (x["rejected"] or x["lang_pred"] != "und") for x in got)
    assert op8_language.predict(docs([]), model).count() == 0
    assert {x["lang_pred"] for x in op8_language.predict(docs(rows), None).collect()} == {"und"}
    d = docs(rows)
    assert op8_language.recognised(d, model).columns == d.columns
    assert op8_language.fit(docs(rows)) is None


def brute_language(text, model):
    """The language, cosine and rejection of one text, gram by gram."""
    if text is None or model is None or not any(c.isalpha() for c in text):
        return "und", 0.0, True
    b = " ".join("".join(c if ord(c) >= 128 or c.isalpha() else " " for c in text.lower()).split()).encode()
    tf = Counter()
    for n in op8_language.SIZES:
        for i in range(len(b) - n + 1):
            h = 0
            for x in b[i : i + n]:
                h = (h * 257 + x) % 2**32
            tf[(h * 2654435761 % 2**32) >> 20] += 1
    weights = {k: v**0.5 * float(model.idf[k]) for k, v in tf.items()}
    size = sum(w * w for w in weights.values()) ** 0.5
    cosines = [sum(w * float(c[k]) for k, w in weights.items()) / max(size, 1e-12) for c in model.centroids]
    best = max(range(len(cosines)), key=cosines.__getitem__)
    return model.languages[model.owner[best]], cosines[best], cosines[best] < model.least[best]


def test_language_against_brute_force(docs, spark, sf_dir):
    real = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = op8_language.fit(real)
    rows = [(x["doc_id"], x["text"]) for x in real.collect()] + [(-1, None), (-2, "1 2"), (-3, "a"), (None, "été Été"), (-4, "ab " * 70000), (-5, "日本語")]
    found = {x["doc_id"]: x for x in op8_language.predict(docs(rows), model).collect()}
    for i, text in rows:
        lang, score, rejected = brute_language(text, model)
        assert (found[i]["lang_pred"], found[i]["rejected"]) == (lang, rejected) and found[i]["score"] == pytest.approx(score, abs=1e-5)


def test_fits_are_bounded(docs, spark, sf_dir):
    """A repeated id and a very long text are one bounded sample each."""
    lines = "\n".join(f"line {i}" for i in range(5000)).encode().split(b"\n")
    assert op6_quality.spaced(op6_quality.line_features(lines)[0]).shape[0] == op6_quality.SEQUENCES * op6_quality.SEQUENCE
    rows = [(1, "one two three " * 30000, "en")] * 300 + [(i, f"uno dos tres {i}", "es") for i in range(2, 9)]
    model = op8_language.fit(docs(rows))
    assert model.languages == ("en", "es") and len(model.owner) <= 8
