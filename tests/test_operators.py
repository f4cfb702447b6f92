"""Cases the tables lack, and order-dependent rules against brute force."""
import random

import pandas as pd
import pytest

from pyspark.sql import functions as F

from termflow.functions import maps as M
from termflow.functions import text as T
from termflow.operators import exchange as X
from termflow.operators import extraction as E
from termflow.operators import matching as MT
from termflow.operators import segments as S
from termflow.operators import glossary as G
from termflow.operators import jobs as J
from termflow.operators import library_store as LS
from termflow.skew import global_rank, lag_by_chunk, running_sum_by_chunk
from termflow.sources import html as H
from termflow.sources import plain as PL
from termflow.sources import resources as R
from termflow import tables as TB
from termflow.streaming import progress as P


@pytest.fixture
def few_partitions(spark):
    """Streams keep a state for every shuffle partition; small ones need few."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def one(spark, expr):
    return spark.range(1).select(expr).first()[0]


def test_translatable_and_tokens(spark):
    for text, want in [("https://a.b/c", False), ("WWW.x.org", False), ("12,5 %", False), ("x", False), ("ok", True), ("　 a", False)]:
        assert one(spark, T.is_translatable(F.lit(text))) is want, text
    assert one(spark, T.token_estimate(F.lit("中文 two words"))) == 2 / 2 + 2 * 1.3
    assert one(spark, T.clock_seconds(F.lit("1:02:03,5"))) == 3723.5


def test_word_boundaries(spark):
    for term, text, want in [("ab", "éab", False), ("ab", "x AB!", True), ("C++", "C++ code", False), ("C++", "C++x", True),
                             ("a b", "a, b", False), ("语", "中语文", True), ("a-b", "x a-b.", True)]:
        assert one(spark, T.term_in_text(F.lit(term), F.lit(text))) is want, (term, text)


def test_map_rules(spark):
    m = lambda **kw: F.create_map(*[F.lit(x) for p in kw.items() for x in p]).cast("map<string,string>")
    assert one(spark, M.upsert(m(fr="a", de="b"), m(fr="", es="c", ja=""))) == {"fr": "a", "de": "b", "es": "c"}
    assert one(spark, M.update(m(fr="a"), m(fr="", ja=""))) == {"fr": ""}
    assert one(spark, M.prefer_right(m(fr="a"), m(fr=""))) == {"fr": ""}
    assert one(spark, M.fill_empty(m(fr="", de="b"), m(fr="x", de="y"))) == {"fr": "x", "de": "b"}
    assert one(spark, M.resolve_target(m(fr=""), F.lit("fr"), F.lit("s"), F.lit(False))) == ""


def test_substring_hits_in_long_tokens(spark):
    long = "甲" * 3000 + "机器学习" + "乙" * 3000
    b = spark.createDataFrame([(1, 0, long + " the Machine Learning"), (1, 1, "machine  learning, 机器")], "doc_id long, block_no int, source_text string")
    t = spark.createDataFrame([("机器学习",), ("machine learning",), ("机器",)], "term string")
    got = {(r.block_no, r.term): (r.n, r.bounded) for r in MT.term_hits(b, t).collect()}
    assert got == {(0, "机器学习"): (1, True), (0, "machine learning"): (1, True), (0, "机器"): (1, True), (1, "机器"): (1, True)}


def brute_general(blocks, limit, size):
    """Segment lists of block dicts, walked the plain way."""
    out, cur = [], []
    tok = lambda bs: sum(13 * len(b["text"].split()) for b in bs)
    end = lambda b: b["text"].endswith(".")
    for b in blocks:
        glued = bool(cur) and b["group_id"] is not None and b["group_id"] == cur[-1]["group_id"]
        if cur and not glued and (b["type"] == "heading" or (len(cur) >= size and end(cur[-1])) or tok(cur) + tok([b]) > limit * 10):
            at = next((i for i in range(len(cur) - 1, 0, -1) if not (cur[i]["group_id"] and cur[i]["group_id"] == cur[i - 1]["group_id"])
                       and (cur[i]["type"] == "heading" or end(cur[i - 1]))), None)
            out.append(cur[:at] if at else cur)
            cur = cur[at:] if at else []
        cur = cur + [b]
    return out + ([cur] if cur else [])


def test_general_segments_match_plain_walk(spark):
    rnd = random.Random(3)
    docs = []
    for d in range(60):
        n = rnd.randint(1, 60)
        docs.append((d, [dict(block_no=i, text=" ".join(["w"] * rnd.randint(1, 9)) + rnd.choice([".", "", "."]), type=rnd.choice(["paragraph"] * 9 + ["heading"]),
                              group_id=rnd.choice([None, f"g{i // 3}", f"g{i // 5}"])) for i in range(n)]))
    df = spark.createDataFrame(docs, "doc_id long, blocks array<struct<block_no:int,text:string,type:string,group_id:string>>")
    for limit, size in [(20, 4), (60, 12), (5, 3)]:
        got = {r.doc_id: [[b.block_no for b in s] for s in r.segments] for r in S.segment(df, "general", limit, size=size).collect()}
        for d, bs in docs:
            assert got[d] == [[b["block_no"] for b in s] for s in brute_general(bs, limit, size)], (d, limit)


def distance(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


def test_asr_pruning_order(spark):
    rnd = random.Random(5)
    rows = [(d, i, "".join(rnd.choice("ABC") for _ in range(rnd.randint(2, 4))), rnd.randint(1, 5)) for d in range(40) for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, pos int, source string, frequency long")
    got = {(r.doc_id, r.pos) for r in E.prune_asr_duplicates(df).collect()}
    for d in range(40):
        t = [r for r in rows if r[0] == d]
        gone = set()
        for i, a in enumerate(t):
            if a[1] in gone:
                continue
            for b in t[i + 1:]:
                if b[1] not in gone and distance(a[2], b[2]) <= 1:
                    gone.add(b[1] if a[3] >= b[3] else a[1])
        assert {p for dd, p in got if dd == d} == {r[1] for r in t} - gone


def test_adversarial_replies(spark):
    ids = ["a", "b", "c"]
    full = "\n\n".join(f"[[BLOCK:{i}]]\n[T]{i}" for i in ids)
    cases = {
        "faithful": (full + "\n\n[[END]]", "abc"), "drop_last": ("[[BLOCK:a]]\nx\n\n[[BLOCK:b]]\ny\n[[END]]", "ab"),
        "swap": ("[[BLOCK:c]]\n3\n[[BLOCK:a]]\n1\n[[BLOCK:b]]\n2", "abc"), "invented": ("[[BLOCK:zz]]\nq\n" + full, "abc"),
        "blank": ("[[BLOCK:a]]\n \n[[BLOCK:b]]\ny\n[[BLOCK:c]]\nz", "bc"), "nothing": ("sorry", ""),
        "inline": ("[[BLOCK:a]]\nsee [[BLOCK:b]] here\n[[BLOCK:b]]\ny\n[[BLOCK:c]]\nz", "abc"),
        "end_inside": ("[[BLOCK:a]]\n1\n[[BLOCK:b]]\n2\n[[END]]\nmore\n[[BLOCK:c]]\n3\n[[END]]\nbye", "abc"),
    }
    df = spark.createDataFrame([(k, 0, [(i, i, None) for i in ids], r) for k, (r, _) in cases.items()],
                               "doc_id string, segment_no int, blocks array<struct<block_id:string,text:string,group_id:string>>, reply string")
    got = {r.doc_id: {p.block_id: p.text for p in r.parsed} for r in X.read_replies(df).collect()}
    for k, (_, want) in cases.items():
        assert set(got[k]) == set(want), k
    assert got["end_inside"]["b"] == "2\n[[END]]\nmore"
    assert got["inline"]["a"] == "see [[BLOCK:b]] here"


def test_failed_blocks_are_reported(spark):
    seg = spark.createDataFrame([(1, 0, [("a", "x", "g"), ("b", "y", "g")])], "doc_id long, segment_no int, blocks array<struct<block_id:string,text:string,group_id:string>>")
    done, failed = X.translate(seg, lambda r: X.echo_model(r).where(~r["payload"].str.contains("BLOCK:b"), "[[END]]"))
    assert [(r.block_id, r["pass"]) for r in done.collect()] == [("a", 3)]
    assert [r.block_id for r in failed.collect()] == ["b"]


def test_chunked_scans_equal_plain_windows(spark):
    rows = [(k, t, (t * 7 + k) % 5) for k in range(3) for t in range(200)]
    df = spark.createDataFrame(rows, "k int, t int, v int")
    a = running_sum_by_chunk(lag_by_chunk(df, ["k"], ["t"], F.floor(F.col("t") / 7), F.col("v"), "before"), ["k"], ["t"], F.floor(F.col("t") / 9), F.col("v"), "total")
    got = {(r.k, r.t): (r.before, r.total) for r in a.collect()}
    for k in range(3):
        total, before = 0, None
        for t in range(200):
            v = (t * 7 + k) % 5
            total += v
            assert got[k, t] == (before, total)
            before = v


def test_html_blocks(spark):
    page = ("<html><body><h1>Big <b>title</b></h1><p translate='no'>keep</p><div><p>One<p>Two <a href='x'>link here</a></div>"
            "<img alt='a picture'><pre>code here</pre><ul><li>42<li>item text</ul></body></html>")
    got = [(r.type, r.attr, r.source_text) for r in H.html_blocks(spark.createDataFrame([(1, page)], "page_id long, html string")).orderBy("seq").collect()]
    assert got == [("heading", "", "Big title"), ("paragraph", "", "One"), ("paragraph", "", "link here"),
                   ("paragraph", "alt", "a picture"), ("paragraph", "", "item text")]


def test_html_blocks_leave_in_parts():
    import pyarrow as pa
    pages = [f"<p>page {i}</p><p>more</p>" for i in range(500)] + [None, "", "<p>" + "x" * (1 << 20) + "</p>", "<p>last</p>"]
    out = list(H._arrow_blocks([pa.RecordBatch.from_pydict({"page_id": list(range(504)), "html": pages})], "page_id"))
    assert [b.num_rows for b in out] == [400, 400, 201, 1]
    assert [(r["page_id"], r["seq"]) for b in out for r in b.to_pylist()] == [(i, k) for i in range(500) for k in (0, 1)] + [(502, 0), (503, 0)]


def test_model_is_asked_in_small_batches(spark, monkeypatch):
    x = spark.range(2000, numPartitions=1).select("id", F.concat(F.lit("t"), F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id"))).alias("text"))
    cache = x.where("id in (0, 1)").select(F.sha2(F.to_json(F.struct("text")), 256).alias("request_key"), F.lit("old").alias("reply"))
    model = lambda rows: rows["text"] + " " + str(len(rows))
    for hot in (10, 10**6):  # every second request is the same one: spread over tasks, and not
        monkeypatch.setattr(X, "HOT", hot)
        monkeypatch.setattr(X, "fits_broadcast", lambda df: False)
        got = X.answer(x, cache, model, ["text"])[0].collect()
        assert {r.id: r.reply.split()[0] for r in got} == {i: "old" if i % 2 == 0 or i == 1 else f"t{i}" for i in range(2000)} and len(got) == 2000
        assert max(int(r.reply.split()[1]) for r in got if not r.hit) <= 500
    seg = x.select(F.col("id").alias("doc_id"), F.lit(0).alias("segment_no"), F.array(F.struct(
        F.lit("b0").alias("block_id"), F.lit("").alias("group_id"), "text")).alias("blocks"))
    done, _ = X.translate(seg, lambda r: "[[BLOCK:b0]]\n" + pd.Series([str(len(r))] * len(r), index=r.index))
    assert done.agg(F.max(F.col("translated_text").cast("int"))).first()[0] <= 500


def test_reply_cache_files(spark, tmp_path):
    from termflow.sources.resources import reply_cache
    (tmp_path / ("a" * 64 + ".json")).write_text('{"reply": "hi"}')
    (tmp_path / "notes.json").write_text('{"reply": "no"}')
    assert [tuple(r) for r in reply_cache(spark, str(tmp_path)).collect()] == [("a" * 64, "hi")]


def test_file_scan(spark, tmp_path):
    from termflow.sources.files import documents, scan
    (tmp_path / "a.txt").write_bytes(b"\xef\xbb\xbfhello there")
    (tmp_path / "b.txt").write_bytes("caf\xe9".encode("latin-1"))
    (tmp_path / "c.exe").write_bytes(b"x")
    good, bad = scan(spark, str(tmp_path))
    assert sorted(r.text for r in documents(good, "txt").collect()) == ["café", "hello there"]
    assert [r.verdict for r in bad.collect()] == ["unsupported"]


def test_scanned_files_are_opened_once(spark, tmp_path):
    from termflow.sources.files import documents, scan
    for i in range(300):
        (tmp_path / f"{i}.{'txt' if i % 2 else 'md'}").write_text(f"text {i}")
    good, bad = scan(spark, str(tmp_path))
    for f in tmp_path.iterdir():
        f.unlink()
    assert good.rdd.getNumPartitions() <= 16
    assert {r.text for k in ("txt", "md") for r in documents(good, k).collect()} == {f"text {i}" for i in range(300)} and bad.count() == 0


def test_terms_across_window_borders(spark):
    """A term of 600 and one of 3,000 characters inside tokens that are cut into windows."""
    short, long = "".join(chr(0x4E00 + i * 7 % 900) for i in range(600)), "".join(chr(0x5E00 + i * 11 % 2000) for i in range(3000))
    b = spark.createDataFrame([(1, 0, "x" * 1700 + short + "y" * 900), (2, 0, "x" * 1201 + long)], "doc_id long, block_no int, source_text string")
    t = spark.createDataFrame([(short,), (long,)], "term string")
    assert {(r.doc_id, r.term, r.n) for r in MT.term_hits(b, t).collect()} == {(1, short, 1), (2, long, 1)}


def test_json_walk(spark):
    import json
    deep = '{"a": ' * 200 + '"leaf text"' + "}" * 200
    files = [(1, deep), (2, '{"k": ["a b", {"x": "c"}, 1, null, ""], "url": "skip"}'), (3, "{broken"), (4, None), (5, '"top"'), (6, '{"a": "x", "a": "y"}'),
             (7, "[" * 100_000)]
    got = {(r.doc_id, r.key_path[-5:], r.value) for r in R.json_leaves(spark.createDataFrame(files, "doc_id long, text string")).collect()}
    assert got == {(1, "a.a.a", "leaf text"), (2, "k.0", "a b"), (2, "k.1.x", "c"), (5, "", "top")}
    assert json.loads(deep)


def test_po_entries_without_blank_lines(spark):
    text = 'msgid ""\nmsgstr "h"\n#, fuzzy\nmsgctxt "menu"\nmsgid "first one"\nmsgstr ""\nmsgid "second "\n"one"\nmsgid_plural "seconds"\nmsgstr[0] "a"\nmsgstr[1] "b"\n# note\nmsgid "third"\nmsgstr "c"\n'
    rows = R.po_blocks(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("block_no").collect()
    assert [(r.source_text, r.msgctxt, r.msgid_plural, r.flags) for r in rows] == [
        ("first one", "menu", None, "fuzzy"), ("second one", None, "seconds", ""), ("third", None, None, "")]


def test_deep_and_null_pages(spark):
    pages = spark.createDataFrame([(1, "<div>" * 1200 + "<p>deep text</p>" + "</div>" * 1200), (2, None), (3, "<p>one two</p>")], "page_id long, html string")
    assert {(r.page_id, r.source_text) for r in H.html_blocks(pages).collect()} == {(1, "deep text"), (3, "one two")}


def test_slides_sorted_and_filled(spark):
    schema = "doc_id long, blocks array<struct<text:string,slide:int,group_id:string,block_id:string>>"
    blocks = [("c", 2, None, "x"), ("a", None, None, "x"), ("b", None, None, "slide1_p"), ("a2", None, None, "x")]
    got = S.segment(spark.createDataFrame([(1, blocks)], schema), "slide", 100.0).first().segments
    assert [[b.text for b in s] for s in got] == [["a", "a2", "b"], ["c"]]


def test_bilingual_notes(spark):
    b = spark.createDataFrame([(1, 0, "École (ÉCOLE) et mot (word)"), (1, 1, "école (école) puis MOT (Word), logo (logo)")], "doc_id long, block_no int, text string")
    t = spark.createDataFrame([(1, 0, "école", "École", False), (1, 1, "ÉCOLE", "école", False), (1, 2, "word", "mot", False), (1, 3, "logo", "logo", True)],
                              "doc_id long, pos int, source string, target string, do_not_translate boolean")
    got = [r.text for r in G.keep_first_annotation(b, t).orderBy("block_no").collect()]
    assert got == ["École (ÉCOLE) et mot (word)", "École puis mot, logo (logo)"]


def test_annotations_in_one_walk(spark):
    terms = [("Uno", "one"), ("Uno due", "two"), ("C (x)", "c (lang)"), ("É", "é é"), ("Uno", "uno"), ("x", "long " * 50)]
    index = G.AnnotationIndex([{"pos": i, "target": t, "source": s} for i, (t, s) in enumerate(terms)])
    told = lambda text: ([(n[0], n[3]) for n in index.find(text)[0]], "".join(n[2] + n[4] for n in index.find(text)[0]) + index.find(text)[1])
    assert told("uno (ONE), UNO due（ two ）; c (X) (C (LANG)) ( (") == (
        [(0, "uno (ONE)"), (1, "UNO due（ two ）"), (2, "c (X) (C (LANG))")], "Uno, Uno due; C (x) ( (")
    assert told("é(É é) uno(uno)uno (one") == ([(3, "é(É é)"), (4, "uno(uno)")], "É Unouno (one")
    assert told("") == ([], "") and told("(" * 3) == ([], "(((")
    b = spark.createDataFrame([(1, 0, None, "e"), (1, 1, "a", "e"), (1, 2, "Uno (one) Uno (one)", "e"), (2, 0, "uno (one)", "e"), (1, 0, "uno (ONE)", "e")],
                              "doc_id long, block_no int, text string, terms string")
    t = spark.createDataFrame([(1, 7, "one", "Uno"), (1, 8, "gone", None), (1, 9, "", "x")], "doc_id long, pos int, source string, target string")
    got = sorted((r.doc_id, r.block_no, r.text or "") for r in G.keep_first_annotation(b.where("text is null or block_no > 0 or doc_id = 2"), t).collect())
    assert got == [(1, 0, ""), (1, 1, "a"), (1, 2, "Uno (one) Uno"), (2, 0, "uno (one)")]


def plain_path(x, y):
    lengths = [[0] * (len(y) + 1)]
    for a in x:
        row = [0]
        for j, b in enumerate(y):
            row.append(lengths[-1][j] + 1 if a == b else max(lengths[-1][j + 1], row[j]))
        lengths.append(row)
    i, j, out = len(x), len(y), ""
    while i or j:
        keep = i and j and x[i - 1] == y[j - 1]
        insert = not keep and j and (not i or lengths[i][j - 1] >= lengths[i - 1][j])
        out = ("=" if keep else "+" if insert else "-") + out
        i, j = i - bool(keep or not insert), j - bool(keep or insert)
    return out


def test_edit_paths(monkeypatch):
    rng = random.Random(9)
    for masks in (32_000_000, 4):
        monkeypatch.setattr(X, "MASK_BYTES", masks)
        for _ in range(700):
            x, y = ([rng.choice("abcd") for _ in range(rng.randrange(30))] for _ in range(2))
            assert X.edit_path(x, y).decode() == plain_path(x, y)
            steps = X.edit_steps(x, y)
            assert "".join(t for op, t in steps if op != "insert") == "".join(x)
            assert "".join(t for op, t in steps if op != "delete") == "".join(y)
            assert all(a[0] != b[0] for a, b in zip(steps, steps[1:]))
    assert X.edit_path([], []) == b"" and X.edit_steps([], ["a"]) == [("insert", "a")]


def test_long_texts_in_little_memory():
    import tracemalloc
    rng = random.Random(1)
    x = [f"w{int(rng.paretovariate(0.4)) % 9000}" for _ in range(30_000)]
    y = [t if rng.random() < 0.9 else "new" for t in x if rng.random() < 0.95]
    tracemalloc.start()
    path = X.edit_path(x, y)
    assert tracemalloc.get_traced_memory()[1] < 100_000_000
    tracemalloc.stop()
    assert path.count(b"=") + path.count(b"-") == len(x) and path.count(b"=") + path.count(b"+") == len(y) and path.count(b"=") > 25_000


def test_library_changes_the_touched_buckets_only(spark, tmp_path):
    from termflow.operators import library as L
    row = "id long, domain_id long, norm string, source string, targets map<string,string>, strategy string, ai_category string, context string"
    lib = spark.createDataFrame([(i, i % 3, f"t{i}", f"T{i}", {"fr": f"f{i}"}, "hard", "", "") for i in range(1, 60)], row)
    store = LS.StoredLibrary(spark, f"{tmp_path}/lib", lib.schema, 32)
    store.load(lib)
    files = lambda: {str(f): f.stat().st_mtime_ns for f in (tmp_path / "lib/terms").rglob("*.parquet")}
    before = files()
    batch = spark.createDataFrame([(1, 0, "t3", {"fr": "", "de": "d"}, "skip", "", "c"), (2, 2, "new", {"fr": "n"}, "hard", "", ""),
                                   (3, 2, " NEW ", {"de": "m"}, "hard", "", "")],
                                  "row_no long, domain_id long, source string, targets map<string,string>, strategy string, ai_category string, context string")
    touched = store.upsert(batch, "one")
    kept = {f for f in before if not any(f"bucket={b}/" in f for b in touched)}
    assert 1 <= len(touched) <= 2 and all(files().get(f) == before[f] for f in kept) and len(kept) >= len(before) - 2
    store.upsert(batch, "one")  # the same import again, as after a failure
    want = L.upsert(lib, batch).select(store.columns)
    key = lambda r: (r.id, r.domain_id, r.norm, r.source, sorted(r.targets.items()), r.strategy, r.ai_category, r.context)
    assert sorted(map(key, store.read().collect())) == sorted(map(key, want.collect()))
    more = spark.createDataFrame([(1, 0, "later", {}, "hard", "", "")], batch.schema)
    store.upsert(more, "two")
    assert {r.norm: r.id for r in store.read().where("id > 59").collect()} == {"new": 60, "later": 61}
    plan = store.touched_terms(more.withColumn("norm", F.col("source")))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan


def test_term_pages_read_their_ranges(spark):
    rng = random.Random(3)
    rows = [(i, rng.randrange(3), rng.choice(["a", "b%", "ab", "c_d"]) + str(rng.randrange(40))) for i in range(900)]
    pages = LS.TermPages(spark.createDataFrame(rows, "id long, domain_id long, norm string"), 12)
    for search, match in (("", lambda n: True), ("b", lambda n: "b" in n)):
        want = sorted((n, i) for i, d, n in rows if d == 1 and match(n))
        for offset, limit in ((0, 5), (37, 100), (len(want) - 2, 9), (len(want) + 5, 3), (0, 10_000)):
            got = pages.page(1, search, offset, limit)
            assert [(r.norm, r.id) for r in got.collect()] == want[offset:offset + limit]
            assert {r.total for r in got.collect()} <= {len(want)}
    plan = pages.page(1, "", 100, 5)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and plan.count("range#") >= 1
    assert pages.page(99).collect() == []


def test_global_rank(spark):
    rows = [(i * 7919 % 1000 // 3, i) for i in range(1000)]
    got = global_rank(spark.createDataFrame(rows, "k long, i long"), [F.desc("k"), F.col("i")]).collect()
    want = {r: n for n, r in enumerate(sorted(rows, key=lambda r: (-r[0], r[1])), 1)}
    assert all(want[(r.k, r.i)] == r.rank for r in got) and len(got) == 1000


def test_streams_over_batches_and_restarts(spark, few_partitions, tmp_path):
    from datetime import datetime, timedelta
    rows = [(i % 5, i % 3, datetime(2024, 1, 1) + timedelta(minutes=i), i, ["translating", "reviewing", "done"][i // 40], i % 40) for i in range(120)]
    folder, state = f"{tmp_path}/in", f"{tmp_path}/state"
    schema = "run_id long, job_id long, ts timestamp, event_id long, status string, segments_done long"
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    write = lambda part: spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    for a in (0, 30, 60):
        write(rows[a:a + 30])
    P.latest_runs(stream(), f"{state}/latest")
    P.live_timing(stream(), F.lit(40), f"{state}/timing")
    P.live_rollup(stream().withColumn("segments_total", F.lit(40)), f"{state}/rollup")
    P.daily_status(stream(), f"{state}/days")
    write(rows[90:])  # the second run goes on from the folders of the first
    got = {r.run_id: r.event_id for r in P.latest_runs(stream(), f"{state}/latest").collect()}
    assert got == {k: max(r[3] for r in rows if r[0] == k) for k in range(5)}
    timing = P.live_timing(stream(), F.lit(40), f"{state}/timing")
    batch = J.stage_timing(spark.createDataFrame(rows, schema), F.lit(40), F.date_trunc("day", F.col("ts")))
    assert sorted(map(str, timing.collect())) == sorted(map(str, batch.select(timing.columns).collect()))
    assert sum(r.n for r in P.daily_status(stream(), f"{state}/days").collect()) == 120
    rollup = P.live_rollup(stream().withColumn("segments_total", F.lit(40)), f"{state}/rollup")
    newest = {r[0]: r for r in rows}
    runs = spark.createDataFrame(list(newest.values()), schema).selectExpr("*", "40 segments_total", "'x' target_lang")
    batch = J.rollup_runs(runs, ["run_id"]).select(rollup.columns)
    assert sorted(map(tuple, rollup.collect())) == sorted(map(tuple, batch.collect()))


def test_streams_read_folders_of_parts_out_of_order(spark, few_partitions, tmp_path):
    from datetime import datetime, timedelta
    rows = [(datetime(2024, 1, 1) + timedelta(days=5 * (i % 3)), f"k{i % 7}", "done") for i in range(60)]
    for part in (rows[40:], rows[20:40], rows[:20], sorted(rows, reverse=True)[:5], sorted(rows)[:5]):
        spark.createDataFrame(part, "ts timestamp, request_key string, status string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame(rows, "ts timestamp, request_key string, status string").coalesce(1).write.parquet(f"{tmp_path}/x")
    one = next(tmp_path.glob("x/part-*")).rename(tmp_path / "single.parquet")
    assert one.is_file()
    stream = lambda: P.source(spark, str(tmp_path), "events", 1)
    assert sum(r.n for r in P.daily_status(stream()).collect()) == 70
    assert sum(r.n for r in P.daily_status(P.source(spark, str(tmp_path), "single")).collect()) == 60
    folder = f"{tmp_path}/keys"
    for _ in range(2):
        assert sorted(r.request_key for r in P.unique_requests(stream(), folder=folder).collect()) == [f"k{i}" for i in range(7)]
    spark.createDataFrame([(rows[0][0], "k3", "done"), (rows[0][0], "k9", "done"), (rows[0][0], None, "done")],
                          "ts timestamp, request_key string, status string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    # A front that remembers next to nothing: the table of keys alone keeps them unique.
    got = [r.request_key for r in P.unique_requests(stream(), "1 millisecond", folder).collect()]
    assert sorted(map(str, got)) == sorted([*(f"k{i}" for i in range(7)), "k9", "None"])


def plain_sessions(cues, gap):
    out = []
    for start, length in sorted(cues):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], start + length + gap), out[-1][2] + 1)
        else:
            out.append((start, start + length + gap, 1))
    return out


@pytest.mark.parametrize("idle_ms", [P.DAY_MS, 1])
def test_cue_sessions_in_any_order(spark, few_partitions, tmp_path, idle_ms):
    from datetime import datetime, timezone
    rng = random.Random(idle_ms)
    at = lambda s: datetime.fromtimestamp(s, timezone.utc).replace(tzinfo=None)
    cues = [(k, rng.randrange(2000), rng.choice([0, 1, 5, 60])) for k in range(6) for _ in range(80)]
    cues += [(7, 100, 5), (7, 110, 1), (7, 117, 1)]  # a pause of exactly the gap, and one second more
    schema = "key long, start_at timestamp, seconds double"
    folder, state = f"{tmp_path}/in", f"{tmp_path}/state"
    write = lambda part: spark.createDataFrame([(k, at(s), float(n)) for k, s, n in part], schema).coalesce(1).write.mode("append").parquet(folder)
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    rng.shuffle(cues)
    write(cues[:200])
    write(cues[200:330])
    P.cue_sessions(stream(), 5, idle_ms, state)
    write(cues[330:])
    got = {}
    for r in P.cue_sessions(stream(), 5, idle_ms, state).collect():
        got.setdefault(r.key, []).append((r.session_start, r.session_end, r.n_cues))
    want = {k: [(at(s), at(e), n) for s, e, n in plain_sessions([c[1:] for c in cues if c[0] == k], 5)] for k in {c[0] for c in cues}}
    assert {k: sorted(v) for k, v in got.items()} == want
    assert len(want[7]) == 2 or len(want[7]) == 1


def test_timing_of_files_out_of_order(spark, few_partitions, tmp_path):
    from datetime import datetime, timedelta
    rng = random.Random(2)
    statuses = ["queued", "translating", "translating", "reviewing", "done", "error"]
    rows = [(i % 4, i % 2, datetime(2024, 1, 1) + timedelta(minutes=i // 2), i, rng.choice(statuses), rng.randrange(40)) for i in range(160)]
    schema = "run_id long, job_id long, ts timestamp, event_id long, status string, segments_done long"
    folder, state = f"{tmp_path}/in", f"{tmp_path}/state"
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    write = lambda part: spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    write(rows[110:])
    write(rows[::2][:55])
    P.live_timing(stream(), F.lit(40), f"{state}/t")
    P.live_rollup(stream().withColumn("segments_total", F.lit(40)), f"{state}/r")
    write(rows[1:110:2])
    timing = P.live_timing(stream(), F.lit(40), f"{state}/t")
    batch = J.stage_timing(spark.createDataFrame(rows, schema), F.lit(40), F.date_trunc("day", F.col("ts")))
    assert sorted(map(str, timing.collect())) == sorted(map(str, batch.select(timing.columns).collect()))
    got = {r.job_id: r.n_runs for r in P.live_rollup(stream().withColumn("segments_total", F.lit(40)), f"{state}/r").collect()}
    assert got == {0: 2, 1: 2}


def test_finished_runs_leave_the_state(spark, few_partitions, tmp_path):
    from datetime import datetime, timedelta
    schema = "run_id long, ts timestamp, event_id long, status string, segments_done long"
    folder, state = f"{tmp_path}/in", f"{tmp_path}/state"
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    at = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    write = lambda part: spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    write([(1, at(0), 0, "translating", 1), (1, at(5), 1, "done", 9), (2, at(0), 2, "translating", 1)])
    P.live_timing(stream(), F.lit(9), state, idle_ms=1)
    write([(3, at(0), 3, "queued", 0)])  # a batch in which the timers of the others fire
    P.live_timing(stream(), F.lit(9), state, idle_ms=1)
    write([(1, at(9), 4, "done", 9), (2, at(6), 5, "translating", 3)])
    got = {r.event_id: r.elapsed for r in P.live_timing(stream(), F.lit(9), state, idle_ms=1).collect()}
    assert got == {0: 0.0, 1: 300.0, 2: 0.0, 3: 0.0, 4: None, 5: 360.0}


def test_rollup_takes_back(spark, few_partitions, tmp_path):
    from datetime import datetime, timedelta
    schema = "run_id long, job_id long, ts timestamp, event_id long, status string, segments_done long, segments_total long"
    folder, state = f"{tmp_path}/in", f"{tmp_path}/state"
    at = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    write = lambda part: spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    write([(1, 10, at(0), 0, "translating", 3, 9), (2, 10, at(0), 1, "queued", 0, 9)])
    assert [tuple(r)[:7] for r in P.live_rollup(stream(), state).collect()] == [(10, 2, 0, 0, 0, 3, 18)]
    write([(1, 11, at(2), 2, "done", 9, 9), (1, 10, at(1), 3, "error", 5, 9), (None, 10, at(1), 4, "error", 5, 9)])
    assert sorted(tuple(r)[:7] for r in P.live_rollup(stream(), state).collect()) == [(10, 1, 0, 0, 0, 0, 9), (11, 1, 1, 0, 1, 9, 9)]


def test_empty_streams(spark, few_partitions, tmp_path):
    schema = "run_id long, job_id long, ts timestamp, event_id long, status string, segments_done long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    assert P.latest_runs(stream).collect() == [] and P.live_timing(stream, F.lit(1)).collect() == []
    assert P.daily_status(stream).collect() == [] and P.live_rollup(stream.withColumn("segments_total", F.lit(1))).collect() == []
    cues = stream.selectExpr("run_id key", "ts start_at", "1D seconds")
    assert P.cue_sessions(cues, 1).collect() == [] and P.unique_requests(stream.selectExpr("status request_key")).collect() == []


def test_state_calls_do_not_grow_with_events():
    from types import SimpleNamespace

    class Value:
        calls, value = 0, None

        def get(self):
            self.calls += 1
            return self.value

        def update(self, value):
            self.calls, self.value = self.calls + 1, value

    for processor, frame, n in (
            (P.StageTiming(1000), pd.DataFrame({"at": range(500), "event_id": range(500), "status": "translating", "segments_done": [None, 1] * 250, "total": 9}), 500),
            (P.CueSessions(1000), pd.DataFrame({"start": range(0, 5000, 10), "until": range(5, 5005, 10)}), 500)):
        made = []
        processor.init(SimpleNamespace(getValueState=lambda *_: made.append(Value()) or made[-1], listTimers=lambda: [], registerTimer=lambda t: None))
        timer = SimpleNamespace(getCurrentProcessingTimeInMs=lambda: 5)
        assert sum(map(len, processor.handleInputRows((1,), [frame], timer))) == n
        assert sum(map(len, processor.handleInputRows((1,), [frame.tail(1)], timer))) == 1
        assert sum(v.calls for v in made) <= 8 and len(made[0].value[0]) == n


def test_intake_replaces_files(spark, few_partitions, tmp_path):
    write = lambda rows: spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    files = lambda: {str(f.relative_to(tmp_path)): f.stat().st_mtime_ns for f in (tmp_path / "state/blocks").rglob("*.parquet")}
    write([(1, "old text\n\nmore old"), (2, "stays here"), (3, "goes away")])
    P.intake(stream(), PL.txt_blocks, f"{tmp_path}/state", 64)
    before = files()
    write([(1, "new text"), (3, ""), (None, "no id")])
    got = {(r.doc_id, r.source_text) for r in P.intake(stream(), PL.txt_blocks, f"{tmp_path}/state", 64).collect()}
    assert got == {(1, "new text"), (2, "stays here")}
    kept = files().items() & before.items()
    assert len(kept) == 1 and len(before) == 3  # the bucket of document 2 is untouched
    assert P.intake(stream(), PL.txt_blocks, f"{tmp_path}/state", 64).count() == 2


def test_repeated_changes_count_once(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(list(x), "k string, n long")
    counts = TB.BucketTable(spark, f"{tmp_path}/t", rows(("", 0)).schema, ["k"], 8)
    add = P._added(["k"], ("n",))
    counts.update(rows(("a", 1), ("b", 2)), add, "1")
    counts.update(rows(("a", 5)), add, "2")
    counts.update(rows(("a", 5)), add, "2")  # the batch again, after a restart
    assert {r.k: r.n for r in counts.read().collect()} == {"a": 6, "b": 2}
    plan = counts.read([3])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan


def test_held_and_joined_search_agree(spark, monkeypatch):
    rng = random.Random(6)
    alphabet = ["ab", "Ab", "b", "C++", "c", "é", "-", "_", "1", "语", " ", " ", "\t", ".", "a-b"]
    text = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    blocks = spark.createDataFrame([(i, j, text(rng.randrange(60))) for i in range(30) for j in range(4)] + [(99, 0, None), (99, 1, "")],
                                   "doc_id long, block_no int, source_text string")
    terms = spark.createDataFrame([(t,) for t in {text(rng.randrange(1, 5)) for _ in range(150)} | {"AB", "ab", "c++", "b b", " b", ""}], "term string")
    held = sorted(tuple(r) for r in MT.term_hits(blocks, terms).select("doc_id", "block_no", "term", "n", "bounded").collect())
    monkeypatch.setattr(MT, "HELD_BYTES", -1)
    joined = sorted(tuple(r) for r in MT.term_hits(blocks, terms).select("doc_id", "block_no", "term", "n", "bounded").collect())
    assert held == joined and len(held) > 500


def documents_at(spark, path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return str(path)


@pytest.mark.parametrize("name, rows", [("constraint_texts", 1), ("glossary_summary", 1), ("edited_glossary", 6),
                                        ("modified_library_terms", 2), ("glossary_review_list", 4), ("glossary_texts", 1)])
def test_words_that_stand_once_are_in_the_glossary(spark, tmp_path, name, rows):
    from termflow.plans import load_all
    words = "alpha bravo charlie delta echo foxtrot golf"
    d = documents_at(spark, tmp_path, [(1, words, "en", "a", 0), (7, "\n".join(w for w in words.split() for _ in range(60)), "en", "a", 0)])
    assert load_all()[name].run(spark, d).where("doc_id = 1").count() == rows


def test_edits_of_a_document_meet_its_terms(spark):
    t = spark.createDataFrame([(d, p, "hard", {"fr": "x"}, False) for d in (1, 2) for p in (1, 2, 3)],
                              "doc_id long, pos long, strategy string, targets map<string,string>, save boolean")
    e = spark.createDataFrame([(1, 1, "set", "skip", {"fr": ""}, None), (1, 3, "remove", None, None, None), (2, 2, "set", None, None, True)],
                              "doc_id long, pos long, action string, strategy string, targets map<string,string>, save boolean")
    got = {(r.doc_id, r.pos): (r.strategy, r.targets["fr"], r.save) for r in G.apply_edits(t, e).collect()}
    assert got == {(1, 1): ("skip", "", False), (1, 2): ("hard", "x", False), (2, 1): ("hard", "x", False),
                   (2, 2): ("hard", "x", True), (2, 3): ("hard", "x", False)}


@pytest.mark.parametrize("few", [0, 1 << 19])
def test_occurrences_are_those_of_every_term_alone(monkeypatch, few):
    monkeypatch.setattr(T, "FEW_CHARACTERS", few)
    rng = random.Random(5)
    for _ in range(200):
        text = "".join(rng.choice("aabé \n\t") for _ in range(60))
        terms = ["".join(rng.choice("aabé ") for _ in range(rng.randint(0, 4))) for _ in range(12)] + [None]
        assert T._occurrences(text, terms) == [None if t is None else text.count(t) if t else 0 for t in terms]
    # One term at a time would read a hundred million characters here.
    words = [f"w{i:x}" for i in range(3000)]
    assert T._occurrences(" ".join(words * 2), words) == [sum(o.count(w) for o in words) * 2 for w in words]
    assert T._occurrences(None, ["a", ""]) == [None, 0]


def test_term_search_by_tokens_is_that_of_whole_texts():
    rng = random.Random(9)
    bits = ["na", "banana", "é", "a", "İ".lower(), "a_", "-", "ß", "中文", "\t", "x1", "", "ná"]
    for _ in range(150):
        texts = [" ".join("".join(rng.choices(bits, k=rng.randint(1, 3))) for _ in range(rng.randint(0, 12))) for _ in range(6)] + [None, ""]
        terms = sorted({rng.choice(["", "A"]) + " ".join("".join(rng.choices(bits, k=rng.randint(1, 2))) for _ in range(rng.choice([1, 1, 2, 2, 3])))
                        for _ in range(25)} - {""})
        pairs = [(t, t.lower()) for t in terms if t.strip()]
        want = sorted(zip(*(x.tolist() for x in MT.FlatTerms(pairs).search(texts))))
        search = MT.TokenTerms(pairs)
        search.BATCH = rng.choice([1, 40, 1 << 21])
        assert sorted(x for part in search.search(texts) for x in zip(*(y.tolist() for y in part))) == want


def test_words_of_the_library_are_added_up_over_parts(monkeypatch):
    import pyarrow as pa
    from termflow.plans import views as V
    monkeypatch.setattr(V, "HELD_GRAMS", 2)
    texts = ["one two three four"] * 600 + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array([None] * 602, pa.string()), pa.array(texts)], ["lang", "t"])
    n = {}
    for b in V._gram_counts(iter([batch, batch])):
        for r in b.to_pylist():
            n[(r["cls"], r["tok"])] = n.get((r["cls"], r["tok"]), 0) + r["n"]
    assert n == {(1, w): 1200 for w in "one two three four".split()} | {(2, p): 1200 for p in ("one two", "three four")}
