import random

from segtide.llm import quality_classifier, quality_rules, url_filter
from segtide.llm.url_filter import Rule

PAGES = "page_id bigint, url string, html string"


def judged(spark, rows, rules, **kwargs):
    df = spark.createDataFrame(rows, "page_id bigint, url string, host string, rule string")
    return {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(df, rules, keep=["page_id"], **kwargs).collect()}


def test_hosts_paths_and_rules(spark):
    rules = [Rule("com/", "allow"), Rule("example.com/en/", "block"), Rule("www.example.com/en/", "allow"), Rule("net/es/", "block")]
    urls = {
        1: ("http://EXAMPLE.com/en/x?q=/en/#f", ("example.com", "/en/x", "example.com/en/", "block")),
        2: ("https://www.example.com/en/", ("www.example.com", "/en/", "www.example.com/en/", "allow")),
        3: ("https://a.www.example.com/en/", ("a.www.example.com", "/en/", "www.example.com/en/", "allow")),
        4: ("https://notexample.com/en/", ("notexample.com", "/en/", "com/", "allow")),
        5: ("https://example.com", ("example.com", "", None, "block")),
        6: ("https://example.com?x=/en/", ("example.com", "", None, "block")),
        7: ("x://a://net/es/", ("a:", "//net/es/", None, "block")),
        8: (None, ("", "", None, "block")),
        9: ("no scheme.com/", ("", "", None, "block")),
        10: ("", ("", "", None, "block")),
        11: ("ftp://s.net/es/" + "y" * 100_000, ("s.net", "/es/" + "y" * 100_000, "net/es/", "block")),
        12: ("ftp://s.net/ES/", ("s.net", "/ES/", None, "block")),
        13: ("http://h.de/.example.com\x00/en/", ("h.de", "/.example.com\x00/en/", None, "block")),
        14: ("http://\u00dcMLAUT.com/", ("\u00dcmlaut.com", "/", "com/", "allow")),
    }
    rows = [(i, u, "x", "y") for i, (u, _) in urls.items()] + [(1, urls[1][0], "x", "y")]
    assert judged(spark, rows, rules, default="block") == {i: e for i, (_, e) in urls.items()}
    assert judged(spark, [], rules) == {}
    assert judged(spark, [(1, "http://a.com/", "", "")], []) == {1: ("a.com", "/", None, "allow")}


def test_many_rules_cross_word_edges():
    random.seed(2)
    name = lambda: "".join(random.choices("ab", k=random.randint(1, 4)))
    globs = [f"{random.choice(['', '*'])}{name()}\x00{name()}" for _ in range(80)]
    texts = [f"{name()}{name()}\x00{name()}{name()}" for _ in range(500)] + ["", "a"]
    hits = url_filter.ShiftAnd(globs).match([t.encode() for t in texts])
    for row, text in zip(hits, texts, strict=True):
        for hit, glob in zip(row, globs, strict=True):
            literal = glob.lstrip("*")
            assert hit == (literal in text if glob[0] == "*" else text.startswith(literal))


def test_globs_against_fnmatch():
    """Stars and question marks anywhere, in characters of one to four bytes; the end is open."""
    from fnmatch import fnmatchcase

    rng = random.Random(9)
    piece = lambda: "".join(rng.choices(["a", "b", "\u00e9", "\u65e5", "\U0001f600", "*", "?"], weights=[6, 6, 2, 1, 1, 3, 2], k=rng.randint(1, 6)))
    globs = [g for g in (piece() for _ in range(200)) if g.strip("*")]
    texts = ["".join(rng.choices("ab\u00e9\u65e5\U0001f600", k=rng.randint(0, 9))) for _ in range(400)] + ["", "a" * 300 + "b"]
    hits = url_filter.ShiftAnd(globs).match([t.encode() for t in texts])
    for row, text in zip(hits, texts, strict=True):
        for hit, glob in zip(row, globs, strict=True):
            assert hit == fnmatchcase(text, glob + "*"), (text, glob)


def test_rules_with_wildcards(spark):
    rules = [Rule("*.example.com/*/print?/", "block"), Rule("ex*.net/a?c", "block"), Rule("example.com/", "allow")]
    urls = {
        1: ("http://x.example.com/en/de/print1/", "*.example.com/*/print?/"),
        2: ("http://x.example.com/en/print/", "example.com/"),
        3: ("http://example.com/en/print1/", "example.com/"),
        4: ("http://exa.b.net/a\u00e9cd", "ex*.net/a?c"),
        5: ("http://ex.org/x.net/abc", None),
        6: ("http://sub.ex.net/abc", "ex*.net/a?c"),
        7: ("http://ex.net/a/c", "ex*.net/a?c"),
    }
    found = judged(spark, [(i, u, "x", "y") for i, (u, _) in urls.items()], rules)
    assert {i: f[2] for i, f in found.items()} == {i: r for i, (_, r) in urls.items()}


def test_what_url_rules_refuse(spark):
    import pytest

    df = spark.createDataFrame([(1, "u")], "rule int, url string")
    for bad in (Rule("*/x", "block"), Rule("a.com/\x00", "block")):
        with pytest.raises(ValueError, match="may not hold"):
            url_filter.judge_urls(df, [bad])
    with pytest.raises(ValueError, match="name of a result"):
        url_filter.judge_urls(df, [], keep=["rule"])


def counts(spark, documents, texts):
    df = documents([(i, t) for i, t in enumerate(texts)])
    return {r["doc_id"]: tuple(r)[1:] for r in quality_rules.base_counts(df, keep=["doc_id"]).collect()}


def brute_counts(text):
    import re

    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(i, i + 5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines)), len(covered)


def test_base_counts(spark, documents):
    random.seed(4)
    texts = [None, "", " \n\t", "a", "a b c d e", "a b c d e a b c d e", "x " * 12, "l\nl\nm\n\n \nl", "\u00fc# <>\x0b|", "w\x85v \x1cz", "p q r s t u p q r s t p q r s t"]
    texts += [" ".join(random.choices("ab", k=40)) for _ in range(20)] + ["\n".join(random.choices(["one", "two", " "], k=9)) for _ in range(5)]
    assert counts(spark, documents, texts) == {i: brute_counts(t) for i, t in enumerate(texts)}


def test_fences_follow_language_and_source(spark, documents, monkeypatch):
    plain = "one two three four five six seven eight nine ten eleven number{}"
    code = "x{} # a | b % c & d < e > f * g $ h # i | j % k"
    rows = [(i, plain.format(i), "en", "prose") for i in range(60)] + [(100 + i, code.format(i), "en", "code") for i in range(60)]
    rows += [(200, code.format("y"), "en", "prose"), (201, code.format("y"), "en", "code"), (202, None, None, None), (203, plain.format("z"), None, None), (203, plain.format("z"), None, None), (204, "", "en", "prose")]
    found = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in quality_rules.judge_quality(documents(rows), keep=["doc_id"]).collect()}
    assert all(found[i] == (False, True) for i in range(60))
    assert all(found[100 + i] == (False, True) for i in range(60))
    assert found[200] == (False, False) and found[201] == (False, True)
    assert found[202] == (True, False) and found[203] == (False, True) and found[204] == (True, False)


def with_lines(name, lines, again):
    """Lines of one word, some of them twice, never five in a row."""
    own = [f"{name}x{k}" for k in range(lines - again)]
    return "\n".join(own + own[::-1][:again])


def with_repeats(name, words, again):
    """Words of which a stretch comes twice."""
    own = [f"{name}x{k}" for k in range(words - again)]
    return " ".join(own + own[:again])


def test_each_rate_rejects_by_its_source_alone(spark, documents):
    """One text passes in a source where its like is usual, and fails in one where it isn't, at production parameters."""
    texts = {
        "lines": (lambda i: with_lines(f"a{i}", 50, 1 + i % 2), lambda i: with_lines(f"a{i}", 50, 10 + i % 11), with_lines("probe", 50, 20)),
        "repeats": (lambda i: with_repeats(f"a{i}", 1000, 5 + i % 5), lambda i: with_repeats(f"a{i}", 200, 10 + i % 9), with_repeats("probe", 200, 18)),
        "lengths": (lambda i: " ".join(f"w{(i * 13 + k) % 97:02d}z" for k in range(14)), lambda i: " ".join(f"longword{(i * 13 + k) % 97:02d}" for k in range(14)), " ".join(f"longword{k}" for k in range(10, 24))),
        "symbols": (lambda i: f"plain text number {i} without any of the signs that code has", lambda i: f"x{i} # a | b % c & d < e > f * g $ h", "y # a | b % c & d < e > f * g $ h"),
    }
    rows = []
    for lang, (low, high, probe) in texts.items():
        rows += [(len(rows) + i, low(i), lang, "low") for i in range(400)]
        rows += [(len(rows) + i, high(i), lang, "high") for i in range(400)]
        rows += [(f"{lang} {s}", probe, lang, s) for s in ("low", "high")]
    names = {f"{lang} {s}": 10_000 + k for k, (lang, s) in enumerate((x, s) for x in texts for s in ("low", "high"))}
    df = documents([(names.get(i, i), *rest) for i, *rest in rows])
    found = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in quality_rules.judge_quality(df, keep=["doc_id"]).collect()}
    assert {n: found[i] for n, i in names.items()} == {n: (False, n.endswith("high")) for n in names}


def test_own_fences_by_hand(spark):
    """Quartiles and fences of merged sketches against sorted values."""
    rng = random.Random(6)
    groups = {"one": [7], "same": [5] * 9, "zeros": [0] * 90 + [40, 60, 80, 200], "wide": [rng.randrange(300) for _ in range(77)], "low": [1, 2] + [50] * 30}
    sketch = spark.createDataFrame([(g, "word_length", v, 1) for g, values in groups.items() for v in values], "lang string, rate string, bin long, n long")
    found = {r["lang"]: r for r in quality_rules.own_fences(sketch, "lang").collect()}
    for g, values in groups.items():
        disc = lambda v, p: sorted(v)[-(-len(v) * p // 4) - 1] if v else None
        q1, q3 = disc(values, 1), disc(values, 3)
        above = disc([v for v in values if v > q3], 1) or 0
        high = q3 + 6 * max(q3 - q1, q3 // 20, 1) if q3 else above // 2
        low = q1 - 6 * max(q3 - q1, q3 // 20, 1)
        assert tuple(found[g][c] for c in ("total", "q1", "q3", "high", "low")) == (len(values), q1, q3, high, low)


def test_rules_on_odd_tables(spark, clashing):
    assert quality_rules.judge_quality(clashing([]), keep=["doc_id"]).collect() == []
    got = quality_rules.judge_quality(clashing([(None, "a " * 200_000), (1, None)]), keep=["doc_id", "size", "rank", "kind"]).collect()
    assert {(r["doc_id"], r["n_words"], r["n_repeat_words"], r["kept"], r["size"]) for r in got} == {(None, 200_000, 200_000, False, "x"), (1, 0, 0, False, "x")}


def test_rules_keep_clean_documents(spark, sf):
    from segtide.llm.queries import quality_rules_query

    labels = spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1")
    clean = quality_rules_query(spark, sf).filter("NOT base_failed").join(labels, "doc_id").collect()
    assert sum(r["kept"] for r in clean) >= 0.99 * len(clean)


def test_rules_use_no_python(spark, sf):
    from segtide.llm.queries import mixing_query, quality_rules_query

    for query in (quality_rules_query, mixing_query):
        plan = query(spark, sf)._jdf.queryExecution().toString()
        assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_classifier_on_held_out_labels(spark, sf):
    from segtide.llm.queries import quality_classifier_query

    scored = quality_classifier_query(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = scored.join(labels, "doc_id").filter("held_out").collect()
    assert len(rows) > 50
    good, bad = [r["score"] for r in rows if r["quality"] == 1], [r["score"] for r in rows if r["quality"] == 0]
    auc = sum(g > b for g in good for b in bad) / (len(good) * len(bad))
    assert auc > 0.99
    assert sum(r["predicted"] for r in rows if r["quality"] == 1) >= 0.98 * len(good)
    every = scored.collect()
    assert len(every) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in every)


def test_classifier_on_odd_rows(spark, clashing):
    from pyspark.sql import functions as F

    rows = [(i, f"clean words number {i} of the text here.") for i in range(60)] + [(100 + i, f"&&& ### {i} ||| $$$") for i in range(60)]
    rows += [(None, "clean words"), (200, None), (201, ""), (202, "long " * 100_000), (1, rows[1][1])]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(100 + i, 0, 0) for i in range(60)] + [(None, 1, 0), (3, None, 0), (999, 1, 0), (4, 1, 0)], "doc_id bigint, quality int, toxic int")
    got = quality_classifier.classify(clashing(rows), labels, 0.3, keep=["doc_id", "label", "value"]).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["label"] == "x" for r in got)
    by = {r["doc_id"]: r["score"] for r in got}
    assert min(by[i] for i in range(60)) > max(by[100 + i] for i in range(60))
    assert by[200] == by[201]
    for few in (labels.limit(0), labels.filter("quality = 1")):
        assert len(quality_classifier.classify(clashing(rows), few, 0.3, keep=["doc_id"]).collect()) == len(rows)
    assert quality_classifier.classify(clashing([]), labels, 0.3, keep=["doc_id"]).collect() == []
    held = clashing(rows).select("doc_id", quality_classifier.held_out().alias("h"), (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).alias("e")).collect()
    assert all(r["h"] == (True if r["doc_id"] is None else r["e"]) for r in held)


def test_sum_of_squares_identity():
    import numpy as np

    rng = np.random.default_rng(1)
    machine = quality_classifier.Machine(0.5, rng.normal(size=9), rng.normal(size=(9, 3)))
    x = rng.normal(size=(4, 9))
    pairs = [machine.bias + r @ machine.linear + sum(machine.factors[i] @ machine.factors[j] * r[i] * r[j] for i in range(9) for j in range(i + 1, 9)) for r in x]
    assert np.allclose(machine.margins(x), pairs)


def test_scores_by_all_pairs(spark, sf):
    """Scores against the machine's definition, pair by pair, from the features of each text."""
    import math

    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(60)
    machine = quality_classifier.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    got = {r["doc_id"]: r["score"] for r in quality_classifier.score(docs, machine, keep=["doc_id"]).collect()}
    features = quality_classifier.Features()
    for i, text in texts.items():
        x = features.rows([text.encode()])[0].astype(float)
        on = [int(k) for k in x.nonzero()[0]]
        margin = machine.bias + sum(float(machine.linear[k]) * x[k] for k in on)
        for n, a in enumerate(on):
            for b in on[n + 1 :]:
                margin += float(machine.factors[a].astype(float) @ machine.factors[b].astype(float)) * x[a] * x[b]
        assert abs(got[i] - 1 / (1 + math.exp(-max(-30.0, min(30.0, margin))))) < 1e-3
