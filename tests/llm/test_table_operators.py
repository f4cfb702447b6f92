"""Groups, vectors, pages, URLs, conversations and the pipeline."""
import random

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from check import TABLES, compare
from types import SimpleNamespace

import corpus_pipeline
from termflow.llm import chat, common, html_extract, pivots, queries, shingles, simhash, url_filter

SF = "/root/testdata/sf0.001"


def named(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    message, good = compare(spark, con, SimpleNamespace(run=queries.QUERIES[name], sql=queries.ORACLES[name]), SF)
    assert good, message


def test_components(spark):
    rng = random.Random(0)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 200)] + [(300, 300)] + [
        (rng.randrange(400, 600), rng.randrange(400, 600)) for _ in range(90)] + [(5, 5), (100, 101)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    nodes = {x for e in edges for x in e if e[0] != e[1]}
    assert got == named([e for e in edges if e[0] != e[1]], nodes)
    assert common.components(spark.createDataFrame([], "a long, b long"), "t").collect() == []


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    counts = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if counts[b] * 2 > len(shingles)) if shingles else 0


def test_simhash_groups_match_brute_force(spark):
    texts = [None, "", "  ", "A", "a b", "ÀB c\x0bd\u00a0e f", *["copy of this text here"] * 5,
             *[" ".join(f"w{(i * 7 + j) % 400}" for j in range(300)) + (" tail" if i % 3 == 0 else "") for i in range(0, 40)],
             *[" ".join(f"v{j}" for j in range(2000)) + f" x{i}" for i in range(40)]]
    rows = [(i, t, "c", "c") for i, t in enumerate(texts)] + [(None, "no id", "c", "c"), (7, "copy of this text here", "c", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, component string")
    got = simhash.simhash_groups(docs).collect()
    assert len(got) == len(texts) + 1
    prints = [plain_fingerprint(t) for t in texts]
    want = named([(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2], range(len(texts)))
    for r in got:
        assert r.fp & (2**64 - 1) == prints[r.doc_id] and r.component_id == want[r.doc_id]
    assert simhash.simhash_groups(docs.limit(0)).collect() == []


def test_chain_keys_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 8)  # large buckets are cut into blocks
    rng = np.random.default_rng(1)
    centre = [int(x) for x in rng.integers(0, 2**63, 3)]
    prints = {centre[i % 3] ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 4), replace=False)) for i in range(300)}
    prints = sorted(prints)
    got = {r.doc_id: r.component_id for r in simhash.near_groups(
        spark.createDataFrame(list(enumerate(prints)), "doc_id long, fp long")).collect()}
    assert got == named([(i, j) for i in range(len(prints)) for j in range(i)
                         if (prints[i] ^ prints[j]).bit_count() <= 2], range(len(prints)))


def plain_jaccard(a, b):
    a, b = ({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.lower().split() for t in (a, b)))
    return len(a & b) / len(a | b)


def test_one_of_each_matches_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    texts = []
    for n in (4, 9, 40, 120, 400):
        for _ in range(4):
            base = [word() for _ in range(n)]
            texts.append(" ".join(base))
            for edits in (1, 2, 4, 8, n // 60, n // 40):
                copy = list(base)
                for _ in range(edits):
                    copy[rng.randrange(n)] = word()
                texts.append(" ".join(copy))
    crowd = [word() for _ in range(200)]
    texts += [" ".join([*crowd, word()]) for _ in range(60)] + ["Some Text", "some  text", "", " ", None]
    rng.shuffle(texts)
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(0, texts[0], "y"), (None, "stands alone", "x"), (None, texts[3], "x")]
    want = named([(i, j) for i in range(len(texts)) for j in range(i)
                  if plain_jaccard(texts[i] or "", texts[j] or "") >= 0.8], range(len(texts)))
    heads = sorted(set(want.values()))
    assert len(heads) < len(texts) - 60
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for block in (1000, 8):  # large groups are cut into blocks
        monkeypatch.setattr(shingles, "BLOCK", block)
        got = shingles.one_of_each(docs).collect()
        assert sorted(r.doc_id for r in got if r.doc_id is not None) == heads
        assert [r.text for r in got if r.doc_id is None] == ["stands alone"]
    assert shingles.one_of_each(docs.limit(0)).collect() == []


def test_pipeline_groups_go_through_fingerprints(spark):
    """Two texts of one fingerprint with few runs of five words in common, one with a near copy at 0.8."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    a, b = (" ".join(["one two three"] * 300 + [word() for _ in range(30)]) for _ in range(2))
    near = b + " " + word()
    assert bin(simhash.fingerprint(a) ^ simhash.fingerprint(b)).count("1") <= 2 and plain_jaccard(a, b) < 0.2 and plain_jaccard(b, near) > 0.8
    docs = spark.createDataFrame([(7, a), (5, b), (3, near), (None, b), (1, "quite another text")], "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.one_of_each_group(spark, docs, SF).collect()} == {1, 3}


def test_alike_counts_rare_and_common_shingles(monkeypatch):
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, 40)).astype(np.uint64) for _ in range(50)]
    want = [(i, j) for i in range(50) for j in range(i + 1, 50)
            if len(np.intersect1d(sets[i], sets[j])) >= 0.4 * len(np.union1d(sets[i], sets[j]))]
    for dense in (2, 16, 99):
        monkeypatch.setattr(shingles, "DENSE", dense)
        assert sorted(zip(*(x.tolist() for x in shingles.alike(sets, 0.4)))) == want


def test_vectors_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(pivots, "BLOCK", 50)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(200, 24))
    dense = base[0] + 0.15 * rng.normal(size=(150, 24)) * np.abs(base[0]).mean()
    near = base[:40] + 0.1 * rng.normal(size=(40, 24))
    rows = [*map(list, base), *map(list, dense), *map(list, near), list(base[3]), list(base[3]), list(2 * base[3])]
    rows = [[float(x) for x in v] for v in rows]
    bad = [None, [], [0.0] * 24, [float("nan")] * 24, [1.0] * 23 + [None], [float("inf")] + [1.0] * 23, [1.0], [1.0, 2.0]]
    table = [(i, v, 1, "k") for i, v in enumerate([*rows, *bad])] + [(None, rows[0], 1, "k"), (5, rows[5], 2, "k")]
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>, copies int, key string")
    got = {r.vec_id: r for r in pivots.near_vectors(df).collect()}
    assert len(got) == len(rows) + len(bad)
    unit = np.array(rows) / np.linalg.norm(rows, axis=1, keepdims=True)
    hit = unit @ unit.T >= 0.95
    np.fill_diagonal(hit, False)
    found, true = sum(got[i].n_links for i in range(len(rows))), hit.sum()
    assert found >= 0.9 * true and all(got[i].n_links <= hit[i].sum() for i in range(len(rows)))
    assert all(got[i].n_links == 0 and got[i].component_id == i for i in range(len(rows), len(rows) + len(bad)))
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    whole = named(np.argwhere(hit).tolist(), range(len(rows)))
    assert np.mean([got[i].component_id == whole[i] for i in range(len(rows))]) > 0.95
    assert pivots.near_vectors(df.limit(0)).collect() == []


PAGE = ("<!DOCTYPE html><html><head><title>t</title><script>var a='</p>';</script></head><body><div id='top'><a href='/'>Site {k}</a></div>"
        "<div class='x1'>Always the same line of words</div>{side}<div class='text'><h1>Title {i}</h1><p>Body &amp; more {i}<p>Second\n"
        " para <b>bold</b> {i}</div><div class='x2'>Made by us</div></body></html>")


def test_wrapper_induction(spark):
    side = "<aside>old {0}</aside><div class='comments'><p>first! {0}</p></div>"
    rows = [(i, f"http://h.example/{i}", PAGE.format(i=i, k=1, side=side.format(i) if i % 2 else "")) for i in range(12)]
    rows += [(50, "http://h.example/z", None), (51, None, ""), (52, "http://one.example/", "<p>only page</p>"),
             (53, "http://h.example/q", "<article><header>x</header><p>A<br>b</p><footer>f</footer>tail</article><p>out"),
             (3, rows[3][1], rows[3][2]), (54, "u", "<" * 50 + "<p <a href='x"), (55, "u", "<div>" * 3000 + "deep"),
             (56, "u2", "<form><div class='page with-sidebar'><nav>n</nav><h1>T</h1><p>body<div class='sidebar'>s</div></div></form>")]
    rows += [(57, "u3", "<article><header><h1>Head</h1></header><div class=ad>z</div><p>x\n y</article>")]
    rows += [(70 + i, "http://copies.example/", "<h1>Copied page</h1><p>with one text") for i in range(6)]
    rows += [(80, "http://copies.example/", "<h1>Other page</h1><p>with another text")]
    pages = spark.createDataFrame([(*r, "h", "r") for r in rows], "page_id long, url string, html string, host string, reference string")
    got = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    assert html_extract.extract(pages).count() == len(rows)
    for i in range(12):
        assert got[i] == f"Title {i}\nBody & more {i}\nSecond para bold {i}"
    assert got[50] == "" and got[51] == "" and got[52] == "only page" and got[53] == "A b\ntail" and got[55] == "deep"
    assert got[56] == "T\nbody" and got[57] == "Head\nx y"
    assert got[70] == got[75] == "Copied page\nwith one text"  # copies are no template
    assert html_extract.extract(pages.limit(0)).collect() == []


def test_copied_articles_are_no_template(spark):
    page = ("<div class='a'>Line of the site</div><nav>n{i}</nav><div class='b'>Chrome {i}</div><article><h1>{t}</h1><p>{t} first</p>"
            "<div>{t} second</div></article>")
    titles = ["Copied", "Copied", "Copied", "One", "Two"]
    rows = [(i, "http://h.example/", page.format(i=i, t=t)) for i, t in enumerate(titles)]
    # most pages agree in one place; the others keep their own text there
    line = "<div class='x'>{}</div><p>Body {}</p>"
    rows += [(10 + i, "http://k.example/", line.format("Same line" if i < 4 else f"Own line {i}", i)) for i in range(6)]
    got = {r.page_id: r.text for r in html_extract.extract(
        spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, t in enumerate(titles):
        assert got[i] == f"{t}\n{t} first\n{t} second"
    for i in range(6):
        assert got[10 + i] == (f"Body {i}" if i < 4 else f"Own line {i}\nBody {i}")


def test_simple_tree_matching_is_largest():
    leaf = lambda name, d=0: [name, d, []]
    a = ["r", 0, [leaf("p"), ["d", 0, [leaf("x"), leaf("y")]], leaf("q"), leaf("p")]]
    b = ["r", 0, [["d", 0, [leaf("y")]], leaf("p"), leaf("q"), leaf("z")]]
    assert sorted(p[0] for p, _ in html_extract.align(a, b)) == ["d", "q", "r", "y"]


def test_urls(spark):
    urls = ["HTTP://WWW.Example.COM/en/x", "http://a.example.com/en/", "http://example.com", "http://example.com/en", "x.com/en/",
            None, "", "ftp://x.net/es/a?b", "http://notexample.com/en/q", "http://ÉX.net/fr/#t", "a://b.net/fr/://c", "http://net/es/", "http:///fr/"]
    pages = spark.createDataFrame([(i, u, "b", "w") for i, u in enumerate([*urls, urls[0]])], "page_id long, url string, block string, word_0 string")
    rules = spark.createDataFrame(queries.RULES, "host string, path string, verdict string")
    got = url_filter.judge(pages, rules).orderBy("page_id").collect()
    assert [r.rule for r in got] == ["www.example.com/en/", "example.com/en/", None, "com/", None, None, None, "net/es/", "com/", "net/fr/",
                                    "net/fr/", "net/es/", None, "www.example.com/en/"]
    assert got[0].host == "www.example.com" and got[9].host == "Éx.net" and got[2].path == ""
    assert {r.verdict for r in url_filter.judge(pages, rules.limit(0)).collect()} == {"allow"}
    assert url_filter.judge(pages.limit(0), rules).collect() == []


def test_bloom_has_no_false_negative_and_few_positives(spark):
    keys = spark.range(5000).selectExpr("concat('k', id) key")
    held = url_filter.bloom(keys)
    assert url_filter.might_hold(keys, held).count() == 5000
    assert url_filter.might_hold(spark.range(20000).selectExpr("concat('other', id) key"), held).count() < 400


def test_preference_pairs(spark):
    t = [(1, 0, "user", "q"), (1, 1, "assistant", "good"), (2, 0, "user", "q"), (2, 1, "assistant", "bad"), (2, 2, "user", None),
         (3, 0, None, "q"), (4, 0, None, "q"), (4, 0, None, "q"), (None, 0, "user", "x"), (5, None, "user", "x"), (6, 1, "user", "")]
    turns = spark.createDataFrame([(*r, "n") for r in t], "conv_id long, turn long, role string, text string, chosen string")
    pairs = spark.createDataFrame([(1, 1, 2), (2, 3, 4), (3, 1, 99), (4, 1, 3), (5, 6, 1)], "pair_id long, chosen_id long, rejected_id long")
    got = {r.pair_id: r for r in chat.preference_pairs(turns, pairs).collect()}
    assert set(got) == {1, 2, 4, 5}
    r = got[1]
    assert (r.prompt, r.chosen, r.rejected) == ("<|user|>\nq<|end|>\n", "<|assistant|>\ngood<|end|>\n",
                                                "<|assistant|>\nbad<|end|>\n<|user|>\n<|end|>\n")
    assert r.chosen_mask == f"1:{len(r.chosen)}" and r.rejected_mask.split(",")[1].startswith("0:")
    assert got[2].chosen == "" == got[2].rejected and got[2].prompt_turns == 1 and got[4].prompt == ""
    assert chat.preference_pairs(turns.limit(0), pairs).collect() == []
    own = spark.createDataFrame([(0, 1, "user", "q", "x"), (0, 2, "assistant", "a", "x"), (0, 3, "user", "bye", "x"), (1, 1, "assistant", "b", "x"),
                                 (2, 1, "assistant", "no neighbour", "x"), (4, 1, "user", "none", "x"), (5, 1, "assistant", "c", "x")],
                                "conv_id long, turn long, role string, text string, last string")
    got = {r.pair_id: r for r in chat.formatted(chat.with_other_replies(own)).collect()}
    assert set(got) == {0, 1} and (got[0].prompt_turns, got[0].rejected_id) == (1, 1)
    assert got[0].rejected == "<|assistant|>\nb<|end|>\n<|user|>\nbye<|end|>\n" and got[0].rejected_mask.startswith("1:")
    shared = queries.QUERIES["op3_preference_formatting"](spark, SF).agg(F.count("*").alias("n"), F.count_if(F.col("prompt_turns") > 0).alias("k")).first()
    assert shared.n > 0 and shared.k > shared.n * 0.8


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = docs.first()
    extra = spark.createDataFrame([(10_000_001, None, "en", "s", 0), (10_000_002, "123 !!", "en", "s", 6),
                                   (10_000_003, first.text, first.lang, "s", 9), (10_000_004, "", None, None, None)], docs.schema)
    state = docs.union(extra)
    seen = [state.count()]
    for name, stage in corpus_pipeline.STAGES:
        state = common.written(stage(spark, state, SF), f"test-{name}")
        seen.append(state.count())
        if name != "tokens":
            assert state.columns == docs.columns
    assert seen[1] == seen[0] - 3 and seen[2] > 0.8 * seen[1] and seen[3] < seen[2] and seen[5] == seen[4]
    ids = {r.doc_id for r in state.select("doc_id").collect()}
    assert not ids & {10_000_001, 10_000_002, 10_000_003, 10_000_004}
    leaks = {r.doc_id for r in queries.decontamination(spark, SF).collect()}
    assert not ids & leaks
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs.limit(0), SF).collect()


def pages_of(spark, htmls, host="h.example.com"):
    return spark.createDataFrame([(i, f"http://{host}/{i}", h) for i, h in enumerate(htmls)], "page_id long, url string, html string")


def test_deep_pages_keep_their_text(spark):
    deep = lambda i, n: "<div>" * n + f"<p>Article number {i} of its own.</p>" + "</div>" * n
    for n in (18, 26, 3000):
        got = {r.page_id: r.text for r in html_extract.extract(pages_of(spark, [deep(i, n) for i in range(6)])).collect()}
        assert got == {i: f"Article number {i} of its own." for i in range(6)}


def test_template_decides_without_names(spark):
    """Pages without article, main, telling names or telling elements: only the alignment tells slots from template."""
    page = lambda i: ("<html><body><div class=alpha><p>Our house</p><p>Call us any day</p></div>"
                      f"<div class=beta><h2>Title {i}</h2><p>Story {i} goes on for {i * 7} days.</p></div>"
                      "<div class=gamma><p>All rights kept</p></div></body></html>")
    got = {r.page_id: r.text for r in html_extract.extract(pages_of(spark, [page(i) for i in range(8)])).collect()}
    assert got == {i: f"Title {i}\nStory {i} goes on for {i * 7} days." for i in range(8)}


def plain_matching(a, b):
    """Size of the largest matching that keeps parents and order, from its definition."""
    if a[0] != b[0]:
        return 0

    def best(x, y):
        if not x or not y:
            return 0
        return max(best(x[1:], y), best(x, y[1:]), plain_matching(x[0], y[0]) + best(x[1:], y[1:]))
    return 1 + best(a[2], b[2])


def test_alignment_matches_brute_force():
    rng = random.Random(5)

    def tree(n):
        return [rng.choice("ab"), rng.randrange(3), [tree(n - 1) for _ in range(rng.randrange(4))] if n else []]
    for _ in range(200):
        a, b = ["r", 0, [tree(1) for _ in range(3)]], ["r", 0, [tree(1) for _ in range(3)]]
        pairs = html_extract.align(a, b)
        assert len(pairs) == plain_matching(a, b) and all(x[0] == y[0] for x, y in pairs)
        assert len({id(x) for x, _ in pairs}) == len({id(y) for _, y in pairs}) == len(pairs)


def test_malformed_pages_take_linear_time():
    import time
    began = time.time()
    for piece, tail in (("<a ", ""), ("<a x ", '"'), ("<a \"' ", ">"), ("<![CDATA[", ""), ("<!--", ""), ("<a", ' "'), ("<p><span>", ""), ("<li><b>", "</b>"),
                        ("<script>", "</script"), ("<span>", "</div>" * 20_000)):
        html_extract.content(html_extract.parse(piece * 20_000 + tail), None, {})
    assert time.time() - began < 40
    text = lambda h: html_extract.content(html_extract.parse(h), None, {})
    assert text("a <b title='x > y'>c</b> < d <e") == "a c < d <e"
    assert text("<p>1<!-- x --><![CDATA[<&amp;]]><script>no</script >2<?pi?><!x>3") == "1<&amp;23"


def test_names_inside_articles(spark):
    kept = [f'<article><p>Before.</p><section class="{c}"><p>Kept text.</p></section></article>' for c in (
        "search-results-explained", "survey-method", "share-price", "login-guide", "notice-board-history")]
    gone = [f'<article><p>Before.</p><div class="{c}"><p>Gone.</p></div></article>' for c in (
        "comments-area", "cookie-banner", "related posts", "socialShare", "newsletter-signup", "ad")]
    assert {html_extract.content(html_extract.parse(h), None, {}) for h in kept} == {"Before.\nKept text."}
    assert {html_extract.content(html_extract.parse(h), None, {}) for h in gone} == {"Before."}
    teaser = "<body><p>" + "The whole story stands here. " * 20 + "</p><article>teaser</article></body>"
    assert html_extract.content(html_extract.parse(teaser), None, {}).startswith("The whole story")


def test_stages_keep_clashing_columns(spark, tmp_path):
    words = "the house stands near river and people walk there every day with their dogs".split()
    rng = random.Random(0)
    rows = [(i, " ".join(rng.choice(words) for _ in range(40)), "en", "s", 1, f"p{i}", f"s{i}", "r", "d") for i in range(30)]
    docs = spark.createDataFrame([*rows, (99, rows[0][1], "en", "s", 1, "p", "s", "r", "d")],
                                 "doc_id long, text string, lang string, source string, n_chars long, _p string, _s string, _row string, _doc string")
    spark.createDataFrame([(i, 0, i % 2) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for stage, kept in ((corpus_pipeline.language, 31), (corpus_pipeline.not_toxic, None), (corpus_pipeline.one_of_each_group, 30)):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        found = {tuple(r) for r in out.collect()}
        assert found <= {tuple(r) for r in docs.collect()} and (kept is None or len(found) == kept)
