"""Each operator against a brute-force version on small inputs with nulls, empty and long texts, ties, repeats and odd columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from fieldloom.llm import decontamination, html_extraction, jaccard_join, packing, pii, quality_classifier, quality_rules, queries, sharding, substring_dedup, token_counts

SF = "/root/testdata/sf0.001"
LONG = "le mot " * 30_000


def _docs(spark, rows):
    """Documents with columns of names that operators use inside."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, row long, d long, spans string, base string, window string"
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 0.5, 7, 8, "x", "y", "z") for i, t, s in rows], schema)


ODD = [(1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, "one", "b"), (5, "one two", "b"), (6, LONG, "a"), (7, LONG, "b"), (8, "Ünï çode Ωmega ﬁ İ ǅ 🙂 " * 9, "c"), (None, "no id here at all", "c"), (4, "one", "b"), (9, "x" * 5000, "a")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("odd"))
    _docs(spark, ODD).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (6, 0, 0), (7, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(0, None), (1, ""), (2, "too short"), (3, "What is the sum of the first ten numbers in this list of odd values?")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(1, None, None), (2, "http://a.b/c", ""), (3, "bad", "<p>x<br>y"), (3, "bad", "<p>x<br>y")], "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    return d


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    for t in ("documents", "labels", "benchmark", "pages"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{d}/{t}.parquet")
    return d


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_odd_and_empty_tables(spark, folder, empty, name):
    out = queries.QUERIES[name](spark, folder)
    n = {"op6_html_extraction": 4, "op4_decontamination": 0, "op12_spelling_variants": 0}.get(name, len(ODD))
    if name in ("op3_token_counts", "op5_packing"):
        assert out.count() >= n
    else:
        assert out.count() == n
    assert queries.QUERIES[name](spark, empty).count() == 0


def test_quality_rules_against_sql(spark):
    import sys, os

    sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))
    from oracle import rows_of, sql_rows

    df = quality_rules.query(spark, SF)
    assert rows_of(df) == sql_rows(quality_rules.oracle_sql(), SF)[1]


def test_repeated_words(spark):
    rows = [(1, "a b c a b c x y z"), (2, "a a a a a"), (3, "a b c\na b c\n\n  \nd"), (4, "a b")]
    got = {r.doc_id: (r.n_repeat_words, r.n_dup_lines) for r in quality_rules.text_counts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (6, 0), 2: (5, 0), 3: (6, 1), 4: (0, 0)}


def _sets(rows, k):
    out = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        out[i] = frozenset([tuple(w)] if 0 < len(w) < k else [tuple(w[j : j + k]) for j in range(len(w) - k + 1)])
    return out


def _classes(sets, percent):
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            common = len(sets[a] & sets[b])
            if 100 * common >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


@pytest.mark.parametrize(("words", "percent", "leaf"), [(3, 90, 32), (5, 80, 4), (3, 60, 2)])
def test_jaccard_join(spark, words, percent, leaf):
    r = random.Random(words * percent)
    vocabulary = ["".join(r.choice("abcdef") for _ in range(r.randint(1, 6))) for _ in range(60)]
    base = [[r.choice(vocabulary) for _ in range(r.randint(1, 70))] for _ in range(25)]
    rows = []
    for i in range(220):
        t = list(base[min(r.randrange(25), r.randrange(25))])
        for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
            t[r.randrange(len(t))] = r.choice(vocabulary)
        rows.append((i, " ".join(t).upper() if i % 7 == 0 else " ".join(t)))
    rows += [(900, None), (901, ""), (902, "  ")]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string"), words, percent, leaf).collect()}
    sets = _sets(rows, words)
    want = _classes(sets, percent)
    assert got == {i: (len(sets[i]), want[i]) for i in sets}


@pytest.mark.parametrize("edits", [3, 4])
def test_jaccard_join_of_a_family_beyond_the_threshold(spark, edits):
    """Copies of one text, with edits that take most of them just beyond the threshold of each other."""
    r = random.Random(edits)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(120)]
    rows = []
    for i in range(150):
        t = list(base)
        for _ in range(r.randint(1, edits)):
            t[r.randrange(len(t))] = word()
        rows.append((i, " ".join(t + [word() for _ in range(r.choice([0, 0, 3]))])))
    got = {x.doc_id: x.component_id for x in jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 8).collect()}
    assert got == _classes(_sets(rows, 3), 90)


def test_token_counts(spark):
    raw = "a\n\n\n\nlong line here\nend\n".encode()
    starts = token_counts.line_starts(raw)
    assert starts.tolist() == [0, 2, 3, 4, 5, 20]
    n, crossing = token_counts.share_out(np.array([0, 4]), 8, np.array([3, 4, 1]), "first")
    assert n.tolist() == [2, 1] and crossing.tolist() == [1, 0]
    n, crossing = token_counts.share_out(np.array([0, 4]), 8, np.array([3, 4, 1]), "most")
    assert n.tolist() == [1, 2] and crossing.tolist() == [0, 1]
    out = token_counts.query(spark, SF)
    whole = out.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.max("doc_tokens").alias("all"), F.max("end").alias("e"))
    text = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.octet_length("text").alias("size"))
    assert whole.join(text, "doc_id").filter("n <> all or e <> size").count() == 0


def test_decontamination(spark):
    item = "Anna buys 12 apples and 30 pears at the small market for 5 euros, then gives half of the pears to her brother. How many pears are left?"
    other = item.replace("Anna", "Peter").replace("12", "7").replace("30", "44").replace("5 euros", "9 dollars")
    mixed = re.sub(r"\d+|Anna|How", lambda m, n=iter(range(99)): {"A": "Name%d" % next(n)}.get(m[0][0], str(next(n))), item)
    filler = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    docs = [(1, filler), (2, f"{filler} {item} {filler}"), (3, f"{filler}\n{other}"), (4, None), (5, "")]
    got = {(r.doc_id, r.item_id): r.n_changed for r in decontamination.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, item), (8, "short one")], "item_id long, text string")).collect()}
    assert set(got) == {(2, 7), (3, 7)} and got[2, 7] == 0 and got[3, 7] >= 4
    assert mixed


def test_plans_of_the_jaccard_join_stay_small(spark, monkeypatch):
    """No step's plan holds those of the rounds before it: the driver plans and keeps each of its exchanges."""
    sizes, stash = {}, jaccard_join.stash

    def measured(df, name, *a):
        sizes[name] = max(sizes.get(name, 0), df._jdf.queryExecution().executedPlan().toString().count("Exchange"))
        return stash(df, name, *a)

    monkeypatch.setattr(jaccard_join, "stash", measured)
    docs = _docs(spark, [(i, " ".join(f"w{j}" for j in range(i % 7, 40 + i % 3)), "a") for i in range(60)] + ODD)
    jaccard_join.join(docs.select("doc_id", "text"), words=3, percent=80)
    assert sizes["spokes"] and max(sizes.values()) < 30, sizes


@pytest.mark.parametrize(("words", "percent"), [(2, 80), (3, 90)])
def test_jaccard_join_finds_further_shingles_without_chance_hits(spark, monkeypatch, words, percent):
    """Lookups of shingles keep the rows that have them alone: a bitmap of fixed size lets more pass by chance as both sides grow, until it lets all pass."""
    monkeypatch.setattr(jaccard_join, "SPARE", 0)
    found, filtered, stash, may_hold = {}, set(), jaccard_join.stash, jaccard_join.may_hold

    def kept(df, name, *a):
        found.setdefault(name, []).append(out := stash(df, name, *a))
        return out

    monkeypatch.setattr(jaccard_join, "stash", kept)
    monkeypatch.setattr(jaccard_join, "may_hold", lambda df, column, *a, **k: filtered.add(column) or may_hold(df, column, *a, **k))
    r = random.Random(words * percent)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    common = [[word() for _ in range(30)] for _ in range(4)]
    rows = []
    for i in range(160):
        t = [*common[i % 4][: r.randint(20, 30)], *[word() for _ in range(r.choice([0, 2, 30, 60]))]]
        if rows and r.random() < 0.4:
            t = r.choice(rows)[1].split(" ")
            for _ in range(r.choice([1, 1, 2, 4])):
                t[r.randrange(len(t))] = word()
        rows.append((i, " ".join(t)))
    got = {x.doc_id: x.component_id for x in jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string"), words, percent, 3).collect()}
    assert got == _classes(_sets(rows, words), percent)
    assert filtered == {"doc_id"} and len(found["whole-sets"][0].take(1)) == 1
    # A text's own row for a shingle is no other's.
    held = found["points"][0].select("node", "m", "pivots").collect()
    asked = [p for x in held[::9] for p in x["pivots"][::3]] + [1, 2]
    places = [(x["node"], x["m"] + x["node"] % 3) for x in held if x["node"] % 5]
    out = jaccard_join._carrying(found["points"][0], spark.createDataFrame(places, "node long, last long"), spark.createDataFrame([(p,) for p in set(asked)], "pivot long"))
    last = dict(places)
    want = sorted((p, x["node"]) for x in held if x["node"] in last for p in x["pivots"][: last[x["node"]] + 1] if p in set(asked))
    assert want and sorted(map(tuple, out.collect())) == want


def test_the_jaccard_join_moves_no_shingles_to_sort_texts_out(spark, monkeypatch):
    """Bounds of pairs and the lookup of asked shingles don't shuffle the shingles that texts carry, even where Spark broadcasts nothing by itself."""
    moved, stash = {}, jaccard_join.stash

    def seen(df, name, *a):
        said = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
        inputs = re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: (.*)", said)
        moved[name] = moved.get(name, False) | any("pivots#" in x for x in inputs)
        return stash(df, name, *a)

    monkeypatch.setattr(jaccard_join, "stash", seen)
    docs = [(i, " ".join(f"w{j}" for j in range(i % 7, 40 + i % 3))) for i in range(60)]
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        jaccard_join.join(spark.createDataFrame(docs, "doc_id long, text string"), words=3, percent=80)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert {"points", "spokes", "pairs", "late-pairs", "seen"} <= set(moved)
    assert not [name for name in ("pairs", "late-pairs", "seen") if moved[name]], moved


def test_jaccard_join_bounds_pairs_by_halves_of_shingles(spark):
    """No pair within reach is lost, even where the kept halves of shingles are equal; and pairs whose sizes alone rule a link out go first."""
    r = np.random.default_rng(5)
    pool = np.sort(np.concatenate([(np.int64(i) << 32) + r.integers(0, 1 << 32, 3) for i in r.choice(1 << 30, 110, False)]))
    sets = []
    for i in range(60):
        base = pool if i % 3 == 0 else pool[:90] if i % 3 == 1 else pool[::3]
        sets.append(np.sort(r.choice(base, max(2, int(len(base) * r.uniform(0.75, 1))), False)))
    rows = [(i, len(x), [int(v) for v in jaccard_join.leading(x[:120])]) for i, x in enumerate(sets)]
    assert all(len(set(f)) == len(f) for _, _, f in rows)
    near = {(a, b) for a in range(60) for b in range(a + 1, 60) if (c := len(np.intersect1d(sets[a], sets[b]))) * 100 >= 60 * (len(sets[a]) + len(sets[b]) - c)}
    pairs = spark.createDataFrame([(a, b) for a in range(60) for b in range(a + 1, 60)], "a long, b long")
    got = {tuple(x) for x in jaccard_join._possible(pairs, spark.createDataFrame(rows, "node long, n long, first array<int>"), F.lit(0.4)).collect()}
    assert near and near <= got and len(got) < 60 * 59 // 2
    simple = spark.createDataFrame([(1, 100, 0, 69), (2, 1000, 0, 899), (3, 105, 0, 74)], "node long, n long, lost long, rest long")
    met = spark.createDataFrame([(1, 2, 9), (1, 3, 30), (2, 4, 1)], "a long, b long, met long")
    none = spark.createDataFrame([], "centre long, r double")
    assert {(x.a, x.b) for x in jaccard_join._meeting_often(met, none, simple, 0.1).collect()} == {(1, 3), (2, 4)}


def test_jaccard_join_looks_up_many_asked_shingles_by_a_shuffle(spark, monkeypatch):
    """The same rows come from a broadcast and, beyond ASKED shingles, from a shuffled join."""
    held = spark.createDataFrame([(i, list(range(i, i + 9))) for i in range(40)], "node long, pivots array<long>")
    within = spark.createDataFrame([(i, i % 9) for i in range(0, 40, 2)], "node long, last long")
    asked = spark.createDataFrame([(p,) for p in range(5, 45, 3)], "pivot long")
    want = sorted((p, i) for i in range(0, 40, 2) for p in range(i, i + i % 9 + 1) if p in range(5, 45, 3))
    for most in (1 << 18, 3):
        monkeypatch.setattr(jaccard_join, "ASKED", most)
        assert sorted(map(tuple, jaccard_join._carrying(held, within, asked).collect())) == want


def test_plans_of_packing_stay_small(spark, monkeypatch):
    """The plan of the pieces holds the running totals of the windows and of the documents once at most."""
    docs = _docs(spark, [(i, "a b c " * (i % 5), "ab"[i % 2]) for i in range(40)])
    import public_tokenizers

    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    assert pieces._jdf.queryExecution().executedPlan().toString().count("Exchange") < 10


def test_packing_encodes_batches_in_parts(spark):
    """However many rows a batch has, a task turns packing.ROWS of them into Python objects at a time."""
    import pyarrow as pa

    class Rows:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):  # noqa: N802
            self.run = run
            return self

        def withColumn(self, *_):  # noqa: N802
            return self

    n = 2 * packing.ROWS + 100
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(["s"] * n), pa.array([f"text {i}" for i in range(n)])], ["doc_id", "source", "text"])
    out = list(packing.encode_documents(Rows(), P.path("word_bpe_49k.json")).run([batch]))
    assert [b.num_rows for b in out] == [packing.ROWS, packing.ROWS, 100]
    assert [x for b in out for x in b.column(0).to_pylist()] == list(range(n))


def test_windows_of_many_documents_at_once(spark, monkeypatch):
    """Documents are hashed together, which gives the same windows as one by one and none across two of them."""
    import pyarrow as pa

    class Rows:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):  # noqa: N802
            return run

    r = random.Random(4)
    texts = [" ".join(r.choice(["Alpha", "beta", "7", "km", "of", "the", "Gamma", "word", "b2"]) for _ in range(r.randrange(30))) for _ in range(200)] + [None, "", "one"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    calls, forms = [], decontamination.window_forms
    monkeypatch.setattr(decontamination, "window_forms", lambda *a: calls.append(1) or forms(*a))
    run = decontamination._windows(Rows(), "doc_id", (np.full(decontamination.BITS // 8, 255, np.uint8), [3]), 8, 4)
    rows = lambda batches: sorted(map(str, (x for b in batches for x in b.to_pylist())))
    together = rows(run([batch]))
    assert len(calls) < len(texts) / 8
    assert len(together) > 1000 and together == rows(run([batch.slice(i, 1) for i in range(len(texts))]))


def test_decontamination_in_any_case(spark):
    item = "Anna buys 12 apples and 30 pears at the small market for 5 euros, then gives half of the pears to her brother. How many pears are left?"
    few = "Paris London Rome 1 2 3 4 5 6 of 7 8 Berlin Madrid"
    filler = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    items = [(7, item), (8, few), (9, "Who wrote the Blue Lantern?"), (10, "What is the capital of Norway?"), (11, "?!"), (12, "What is 12 times 12?")]
    docs = [(1, f"{filler} {item.upper()}"), (2, item.lower() + filler), (3, f"{filler} {item.title()} {filler}"), (4, item.upper().replace("12", "13").replace("30", "31"))]
    docs += [(5, few), (6, few.upper()), (7, few.replace("1 2 3", "9 8 7").replace("Rome", "Oslo")), (8, filler + " who WROTE the blue lantern " + filler), (9, "Oslo is the capital of Norway and 12 times 13 is no square")]
    docs += [(10, "what is the Capital of Norway"), (11, "so what is 12 times 12"), (12, "so what is 12 times 11"), (13, None)]
    got = decontamination.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 7), (2, 7), (3, 7), (4, 7), (5, 8), (6, 8), (8, 9), (10, 10), (11, 12)}
    assert all(r.n_windows <= r.item_windows for r in got) and all(r.n_windows == r.item_windows for r in got if r.doc_id not in (4,))


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    rows = [(i, t, s) for i, t, s in ODD if i is not None and i != 4] + [(100 + i, f"text {i} " * (i % 50), f"s{i % 3}") for i in range(300)]
    out = packing.pack(_docs(spark, rows), path, length=256, window=4).collect()
    encode = Tokenizer.from_file(path).encode
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    assert set(by) == {i for i, _, _ in rows}
    for i, t, _ in rows:
        ids = np.array(encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes()
        pieces = sorted(by[i], key=lambda r: r.start)
        assert b"".join(bytes(p.ids) for p in pieces) == ids
        assert [p.start for p in pieces] == np.concatenate([[0], np.cumsum([p.length for p in pieces])[:-1]]).tolist()
    at = sorted((r.sequence_id, r.offset, r.length) for r in out)
    ends = 0
    for s, o, n in at:
        assert s * 256 + o == ends and o + n <= 256
        ends += n


def test_html():
    text = lambda h: html_extraction.main_text(h, set())
    assert text(None) == "" and text("<") == "<"
    page = "<body><div id='site-nav'>m</div><main><h1>A &amp; B</h1><p>one<p>two  <i>x</i>y<div class='comments'><p>c</div><form>f</form></main><aside>s</aside><footer>f</footer></body>"
    assert text(page) == "A & B\none\ntwo xy"
    assert text("<article><p>first</p><button>Share<p>second</p></article>") == "first\nShare\nsecond"
    assert text("<p>a<noscript>b<p>c") == "ab\nc" and text("<p>a<button>x</button>b<p>c") == "ab\nc"
    assert text("<style>p{}</style><script>'</p>'</script><!-- c --><p>k") == "k"


def test_html_names_attributes_and_drawings():
    text = lambda h: html_extraction.main_text(h, set())
    kept = "<h2 id='related-work'>Related work</h2><section class='share-prices'>Prices</section><p title='the hidden gem'>Gem</p><p data-tip='role = alert'>Tip <span data-id=menu>word</span></p>"
    assert text(f"<article>{kept}</article>") == "Related work\nPrices\nGem\nTip word"
    assert text("<article><p>a <math><mi>x</mi><mo>=</mo><mn>1</mn></math> <svg><title>t</title><desc>d</desc><text>b</text></svg></article>") == "a x=1 b"
    dropped = "<div class='social-share'>s</div><div id=cookieBanner>c</div><div class='card ad-slot-2'>a</div><p hidden>h</p><p aria-hidden='true'>i</p><p style='display: none'>n</p><div role=navigation>r</div>"
    assert text(f"<article>{dropped}<p>kept</p></article>") == "kept"


@pytest.mark.parametrize("page", ["<div>" * 100_000 + "x", "<div></p>" * 100_000, "<a " * 300_000, '<a "' * 200_000, "<!" * 400_000, "<button>" * 100_000 + "</button>", "<p>" + "<span>" * 80_000 + "<b></b>" * 80_000, "<ul><li>" * 60_000, "<table><tr><td>" * 60_000, "<article><p>" + "word &amp; " * 500_000])
def test_long_broken_pages_are_read_in_one_pass(page):
    import time

    began = time.perf_counter()
    html_extraction.blocks(page)
    assert time.perf_counter() - began < 20


def test_style_tree_of_a_small_host(spark):
    """What two pages share proves little; what three share is cut."""
    pages = lambda n: spark.createDataFrame([(i, f"http://h{n}/{i}", f"<body><div class=top>Our shop</div><div class=txt>story {i}</div></body>") for i in range(n)], "page_id long, url string, html string")
    assert [r.text for r in html_extraction.extract(pages(2)).orderBy("page_id").collect()] == ["Our shop\nstory 0", "Our shop\nstory 1"]
    assert [r.text for r in html_extraction.extract(pages(3)).orderBy("page_id").collect()] == ["story 0", "story 1", "story 2"]


def test_style_tree_by_brute_force(spark):
    """Importance of every node of a host's tree, counted in plain Python."""
    import math

    page = lambda i: f"<body><div class=top>Menu {i % 2}</div><div class=side>{'<p>x' * (1 + i % 3)}</div><div class=txt>story {i}</div></body>"
    rows = [("h", page(i)) for i in range(9)]
    got = {(r["path"]): (r["pages"], r["importance"]) for r in html_extraction.style_tree(spark.createDataFrame(rows, "host string, html string")).collect()}
    nodes = {}
    for _, h in rows:
        mine = {}
        for text, path, _, _ in html_extraction.blocks(h):
            mine.setdefault(path, []).append(text)
        for path, texts in mine.items():
            nodes.setdefault(path, []).append(("\n".join(texts), len(texts)))
    assert len(got) == len(nodes)
    for path, seen in nodes.items():
        n, most = len(seen), math.log(len(seen) + html_extraction.SMOOTH)
        count = lambda k, v: sum(s[k] == v for s in seen)
        # A content counts once in the mean, a presentation by its pages.
        contents = {s[0] for s in seen}
        recurring = sum(math.log(count(0, c)) for c in contents) / len(contents)
        entropy = -sum(count(1, v) / n * math.log(count(1, v) / n) for v in {s[1] for s in seen})
        pages, importance = got[html_extraction._signed(path)]
        assert pages == n and abs(importance - (0.9 * (1 - recurring / most) + 0.1 * entropy / most)) < 1e-9


def test_clashing_columns(spark, folder):
    """Public functions on tables with columns of the names that they add."""
    rows = [(1, "Call +44 20 7946 0958 or mail a.b@c.de", "mine", 5, 0.1), (2, None, "mine", 6, 0.2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, base string, n_words long, score double").withColumns({"kept": F.lit("k"), "spans": F.lit("s"), "n_email": F.lit(9)})
    ruled = quality_rules.apply_rules(docs).orderBy("doc_id").collect()
    assert [r["n_words"] for r in ruled] == [8, 0] and [r["kept"] for r in ruled] == [False, False] and ruled[0]["base"] == "mine"
    found = pii.find(docs, None).orderBy("doc_id").collect()
    assert [r["n_email"] for r in found] == [1, 0] and len(found[0]["base"]) == 2 and found[0]["score"] == 0.1
    redacted = pii.redact(docs, None).orderBy("doc_id")
    assert redacted.columns == docs.columns
    assert redacted.first()["text"] == "Call <phone> or mail <email>" and redacted.first()["base"] == "mine" and redacted.first()["spans"] == "s"
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    teach = spark.createDataFrame([(i, "good text of words" if i % 2 else "#### 1234 ####", "mine", i, 0.5) for i in range(40)], "doc_id long, text string, base string, n_words long, score double")
    scored = quality_classifier.score_documents(teach.unionByName(teach), labels)
    assert scored.count() == 80 and scored.filter("score BETWEEN 0 AND 1").count() == 80 and scored.columns.count("score") == 1
    again = quality_classifier.score_documents(teach.unionByName(teach), labels)
    assert again.exceptAll(scored).count() == 0


def test_style_tree(spark):
    pages = [("h", f"<body><div class=top>Our shop, since 1990</div><div class=txt><p>story {i} {i * i}</p></div></body>") for i in range(12)]
    df = spark.createDataFrame([(i, f"http://{h}/{i}", t) for i, (h, t) in enumerate(pages)], "page_id long, url string, html string")
    assert [r.text for r in html_extraction.extract(df).orderBy("page_id").collect()] == [f"story {i} {i * i}" for i in range(12)]


def test_style_tree_of_copies(spark):
    """A host of copies of one page has no template that its copies show."""
    page = "<body><div class=body><p>the story</p></div></body>"
    df = spark.createDataFrame([(i, f"http://h/{i % 4}", page) for i in range(12)], "page_id long, url string, html string")
    assert [r.text for r in html_extraction.extract(df).collect()] == ["the story"] * 12


@pytest.mark.parametrize("shards", [1, 3, 16])
def test_sharding(spark, shards):
    df = spark.range(500).select(F.col("id").alias("doc_id"))
    out = sharding.assign(df, F.col("doc_id"), ["doc_id"], shards).collect()
    assert sorted(r.doc_id for r in out) == list(range(500))
    sizes = [sorted(r.slot for r in out if r.shard == s) for s in range(shards)]
    assert all(x == list(range(len(x))) for x in sizes) and max(map(len, sizes)) - min(map(len, sizes)) <= 1


def test_sharding_moves_little(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"))
    at = lambda n: {r.doc_id: r.shard for r in sharding.assign(df, F.col("doc_id"), ["doc_id"], n).collect()}
    a, b = at(16), at(17)
    assert sum(a[i] != b[i] for i in a) / 3000 < 0.25


def _brute_removal(rows, length):
    seen, out = set(), {}
    for d, t in sorted(rows):
        raw, mask = (t or "").encode(), None
        mask = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            w = raw[i : i + length]
            mask[i : i + length] |= w in seen
            seen.add(w)
        if mask.any():
            out[d] = (hashlib.sha256(bytes(np.frombuffer(raw, np.uint8)[~mask])).hexdigest(), int(mask.sum()), int((np.diff(np.concatenate([[0], mask.astype(int)])) == 1).sum()))
    return out


@pytest.mark.parametrize("block", [1 << 20, 512])
def test_substring_removal(spark, block, monkeypatch):
    r = random.Random(block)
    base = "".join(r.choice("ab é") for _ in range(600))
    rows = [(1000, ""), (1001, None), (1002, "a" * 700), (1003, "ab" * 400)]
    for i in range(90):
        a = r.randrange(400)
        x = base[a : a + r.randint(60, 200)]
        rows.append((i, r.choice(["", "xyz" * r.randrange(60), "a" * r.randrange(300)]) + x + "".join(r.choice("ab é") for _ in range(r.randrange(60))) + r.choice(["", x])))
    rows.append((2000, rows[9][1]))
    if block == 1 << 20:
        df = substring_dedup.keyed(spark.createDataFrame(rows, "doc_id long, text string"))
        got = {x.d: (hashlib.sha256(bytes(x.kept)).hexdigest(), x.n_removed, x.n_spans) for x in substring_dedup.remove(df).collect()}
        assert got == _brute_removal(rows, 100)
    else:  # places don't depend on how a text is cut for hashing
        whole = [substring_dedup.places((t or "").encode() * 5)[:2] for _, t in rows[:20]]
        monkeypatch.setattr(substring_dedup, "BLOCK", block)
        substring_dedup._powers.cache_clear()
        cut = [substring_dedup.places((t or "").encode() * 5)[:2] for _, t in rows[:20]]
        substring_dedup._powers.cache_clear()
        for (a, h), (b, g) in zip(whole, cut, strict=True):
            assert (a >> 16).tolist() == (b >> 16).tolist() and h.tolist() == g.tolist()


def test_substring_removal_of_odd_documents(spark):
    """Rows without an id, rows that share one, repeated rows, and a long run of one byte."""
    r = random.Random(8)
    words = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    p, q = words(40), words(40)
    rows = [(None, p + q), (None, words(3) + p), (None, "short"), (3, q + words(9)), (3, words(9) + q), (3, words(9) + q[:90]), (5, p), (5, p), (6, "z" * 3_000_000), (7, "yy" + "z" * 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    keyed = substring_dedup.keyed(df).select("doc_id", "d", "t", "text").collect()
    order = {x: i for i, x in enumerate(sorted({(x.d, x.t, x.text) for x in keyed if x.d != 6}))}
    want = _brute_removal([(i, x[2]) for x, i in order.items()] + [(10**9, "z" * 3000)], 100)
    sha = lambda t: (hashlib.sha256(t.encode()).hexdigest(), 0, 0)
    # Document 6 lies between 5 and 7: its run of z makes that of 7 a repeated one.
    want[order[next(x for x in order if x[0] == 7)]] = (hashlib.sha256(b"yy").hexdigest(), 400, 1)
    got = {(x.d, x.t): (hashlib.sha256(bytes(x.kept)).hexdigest(), x.n_removed, x.n_spans) for x in substring_dedup.remove(substring_dedup.keyed(df)).collect()}
    z = next((x.d, x.t) for x in keyed if x.d == 6)
    assert got.pop(z) == (hashlib.sha256(b"z").hexdigest(), 2_999_999, 1)
    for (d, t, text), i in order.items():
        assert got.get((d, t), sha(text)) == want.get(i, sha(text)), (d, text[:20])


PATTERNS = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def _base(t):
    out = []
    for k, (kind, p) in enumerate(PATTERNS):
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum((v - 9 if v > 9 else v) for v in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(d)))) % 10 == 0
            if {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".") if kind == "ip"), "card": 12 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans(spark):
    texts = [None, "", "a@b.c%d@e.f.g x", "1.2.3.4.5.6.7.8 300.1.1.1 0255.001.1.1 99999999999999999999.1.1.1", "4539 1488 0343 6467 and 4539148803436467-", "+1 (555) 010-9999 call +44 20 7946 0958.", "ü@ö.de é a.b@c.d1-e.f 🙂 q@r.st", "12.34.56.78 " * 200, "1 2 3 4 5 6 7 8 9 " * 3000, "9" * 20000, "a" * 50000 + "@" + "b" * 10 + ".c", "@@@ . - +"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [tuple(x) for x in r.base] for r in pii.find(df, None).collect()}
    assert got == {i: _base(t) for i, t in enumerate(texts)}


def test_boosted_spans(spark):
    r = random.Random(9)
    hexes = lambda: "".join(r.choice("0123456789abcdef") for _ in range(24))
    texts = []
    for i in range(300):
        texts += [f"say token = \"{hexes()}\" now", f"my mail me{i}@ex.org and +1 (555) 010-{1000 + i}", f"lot {r.randrange(10**6, 10**9)} of {r.randrange(10**6, 10**8)}", "plain words only here"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    chooser = pii.fit(df)
    assert chooser is not None
    got = {x.doc_id: x for x in pii.find(df, chooser).collect()}
    secrets = sum(any(s.k == 5 for s in got[i].spans) for i in range(0, len(texts), 4))
    assert secrets > 280
    assert all(set(map(tuple, x.base)) <= set(map(tuple, x.spans)) for x in got.values())
    assert not any(got[i].spans for i in range(3, len(texts), 4))
    red = pii.redact(df, chooser).filter("doc_id = 1").first()
    assert red.text == "my mail <email> and <phone>"


def test_boosted_spans_beside_many_negatives(spark):
    r = random.Random(10)
    hexes = lambda: "".join(r.choice("0123456789abcdef") for _ in range(24))
    number = lambda: r.randrange(10**6, 10**9)
    rare = [f"say token = \"{hexes()}\" now, call +1 (555) 010-{1000 + i}" for i in range(80)]
    texts = rare + [f"lot {number()} of {number()} in {number()} and {number()}, {number()}" for i in range(400)] + ["plain words only here"] * 2000
    texts.append("".join(f"lot {number()}, " for _ in range(600)))  # alone more than the bound
    df = spark.createDataFrame([*enumerate(texts), (None, texts[-1])], "doc_id long, text string")
    chooser = pii.fit(df, sample=128)
    assert chooser is not None
    got = {x.doc_id: x for x in pii.find(df.filter("doc_id < 480"), chooser).collect()}
    assert sum(any(s.k == 5 for s in got[i].spans) for i in range(80)) > 75
    assert not any(got[i].spans for i in range(80, 480))


def test_boosted_spans_count_every_candidate(spark):
    """9000 candidates of one label and one place are all counted, and so are the rare ones beside them."""
    texts = [f"lot {10**7 + i} left" for i in range(9000)] + [f"token = \"a{i:023d}\" now" for i in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.label, r.held): r.n for r in pii._counted(df).groupBy("label", "held").agg(F.sum("n").alias("n")).collect()}
    want = Counter((float(i >= 9000), zlib.crc32(str(i).encode()) % 4 == 0) for i in range(len(texts)))
    assert got == want
    rows = pii._counted(df).collect()
    assert len(rows) < 100 and all(r.share == 1.0 for r in rows)
    assert all(len(pii.CUTS) == len(r.q) and all(0 <= v <= len(c) for v, c in zip(r.q, pii.CUTS, strict=True)) for r in rows)


def test_boosted_spans_count_texts_with_many_candidates_whole(spark):
    df = spark.createDataFrame([(1, "".join(f"lot {10**7 + i}, " for i in range(600))), (2, "lot 12345678"), (None, None)], "doc_id long, text string")
    assert pii._labelled(df).count() == 601
    assert pii._counted(df).agg(F.sum("n")).first()[0] == 601


def test_classifier_held_out(spark):
    out = quality_classifier.query(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.quality for r in out) / len(out) > 0.95
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)


def test_labels_of_held_out_rows_are_not_used(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{SF}/labels.parquet")
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted(map(tuple, quality_classifier.score_documents(docs, x).select("doc_id", "score").collect())) for x in (labels, flipped))
    assert a == b


def test_pipeline_stages_without_and_with_repeated_ids(spark, folder):
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    text = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    leak = "What is the sum of the first ten numbers in this list of odd values?"
    rows = [(1, text, "a"), (1, text, "a"), (2, text + " x", "a"), (None, "only here", "a"), (None, leak, "a"), (None, None, "a"), (3, leak, "b"), (4, "", "b"), (5, text[:200], "b")]
    docs = _docs(spark, rows)
    once = stages["jaccard_join"](spark, docs, folder)
    assert once.columns == docs.columns
    assert sorted((r.doc_id or -1, r.text or "-") for r in once.collect()) == sorted([(1, text), (-1, "only here"), (-1, leak), (-1, "-"), (4, "-"), (5, text[:200])])
    clean = stages["decontamination"](spark, docs, folder)
    assert clean.count() == 7 and not any(r.text == leak for r in clean.collect())
    none = docs.limit(0)
    assert all(stages[n](spark, none, folder).count() == 0 for n in stages)


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = stage(spark, docs, SF).persist()
        after = {r.doc_id: r.text for r in docs.collect()}
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and set(after) <= set(before), name
        if name == "jaccard_join":
            classes = _classes(_sets(sorted(before.items()), 5), 80)
            assert set(after) == set(classes.values())
        if name == "pii":
            assert set(after) == set(before) and not any(_base(t) for t in after.values())
    assert corpus_pipeline.run(spark, SF).agg(F.sum("length")).first()[0] > 0
