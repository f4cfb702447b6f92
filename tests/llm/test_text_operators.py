"""Encoding, tiling, language and toxicity: brute-force versions, edge cases, planted cases."""
import hashlib
import os
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from termflow.llm import byte_bpe, decontaminate, langid, queries, token_store, toxicity
from termflow.llm.bytewords import words
from termflow.llm.common import held_out

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "\n\n", "a", "it's 12ab  \t x\u001c!\u00a0y", "É" * 3000, "x" * 200_000, " " * 70_000 + "word" + "\n" * 66_000,
       ("wörter und “quotes” 123 " * 9000), "<|endoftext|> 'll 's", "日本語のテキスト", "ΑΣ ΑΣ. İstanbul é", "same text", "same text"]


def frame(spark, rows, schema="doc_id long, text string, lang string, start string, key string, ids string"):
    return spark.createDataFrame([(i, t, None, "s", "k", "i") for i, t in rows], schema)


def odd_docs(spark):
    return frame(spark, [*enumerate(ODD), (3, "\n\n"), (None, "no id")])


def encoding():
    return byte_bpe.encoding(queries.RANKS, public_tokenizers.PATTERN)


def test_byte_bpe_matches_library_and_decodes(spark):
    got = queries.byte_tokens(odd_docs(spark)).collect()
    assert len(got) == len(ODD) + 2
    by_id = {r.doc_id: r for r in got}
    for i, text in enumerate(ODD):
        ids = encoding().encode_ordinary(text or "")
        assert by_id[i].n_tokens == len(ids)
        assert by_id[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert by_id[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert queries.byte_tokens(frame(spark, [])).collect() == []


def test_byte_bpe_cuts_only_at_safe_borders(monkeypatch):
    monkeypatch.setattr(byte_bpe, "PIECE", 7)
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice("ab1! \n\t'sé\u001c\u00a0—") for _ in range(rng.randrange(80)))
        assert "".join(byte_bpe.pieces(text, 7)) == text
        assert np.frombuffer(byte_bpe.encode_text(encoding(), text), "<u4").tolist() == encoding().encode_ordinary(text)


def test_long_blank_runs_are_one_match():
    enc = encoding()
    for text in ("a" + " " * 70_000 + "b", "\n" * 66_000, "x" + "\t" * 65_600 + "\n"):
        assert np.frombuffer(byte_bpe.encode_text(enc, text), "<u4").tolist() == enc.encode_ordinary(text)


def test_token_store_matches_library(spark):
    files = token_store.write_tokens(odd_docs(spark), queries.WORD_BPE, 2, length=64, file_bytes=100_000)
    assert files.count() > 2
    got = token_store.read_digests(files).orderBy("start").collect()
    tk = Tokenizer.from_file(queries.WORD_BPE)
    want, start = [], 0
    rows = sorted([(-1, "no id"), *enumerate(ODD), (3, "\n\n")], key=lambda r: r[0])
    for i, text in rows:
        ids = [*tk.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((None if i < 0 else i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [tuple(r) for r in got] == want
    assert token_store.read_digests(token_store.write_tokens(frame(spark, []), queries.WORD_BPE, 2)).collect() == []


def test_word_cache_matches_plain_library():
    """The library's own answer on special tokens, letters whose lower case is longer, combining marks, random Unicode."""
    tk, cache = Tokenizer.from_file(queries.WORD_BPE), token_store.cache_for(queries.WORD_BPE)
    rng = random.Random(0)
    fixed = ["hello <|endoftext|> world", "<|startoftext|>a<|endoftext|>.", "x<|ENDOFTEXT|>", "İ!", "İSTANBUL. İ,", "ẞ! ǅ. ŉ; ΑΣ. ΑΣ",
             "e\u0301! \u0301x n\u0303, A\u030a.", "it's I'LL 'tis don't.", "ﬁ! ① ٣4 x²", "\u00a0a\u2003b\u0085c\u001cd"]
    letters = [*"aAzZ !.,'<|>0\n\t", "İ", "ı", "ß", "É", "\u0301", "\u0307", "ŉ", "Σ", "ς", "語", "\u00a0", "<|endoftext|>", "ɏ", "Ɐ", "\U0001F600"]
    odd = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(3000)]
    odd += ["".join(chr(rng.choice([rng.randrange(32, 0x250), rng.randrange(0x250, 0xd800)])) for _ in range(30)) for _ in range(1500)]
    for text in fixed + odd:
        assert np.frombuffer(cache.encode(text), cache.kind).tolist() == tk.encode(text, add_special_tokens=False).ids, text


def test_token_store_random_access(tmp_path):
    path = f"{tmp_path}/f.arrows"
    w = token_store.Writer(path, np.dtype("<u2"), 16, 4)
    ids = np.arange(1000, dtype="<u2")
    w.add([ids[:900].tobytes(), b"", ids[900:].tobytes()], [1, 2, 3])
    w.close()
    r = token_store.Reader(path)
    for n in (62, 0, 17, 61):
        got, mask = r.sequence(n)
        real = ids[n * 16:(n + 1) * 16]
        assert got[:len(real)].tolist() == real.tolist() and mask.sum() == len(real)
        assert not got.flags.owndata  # a view of the mapped file
    assert np.concatenate(list(r.tokens(890, 60))).tolist() == list(range(890, 950))


def plain_tiles(a, b, least):
    """Greedy string tiling from its definition."""
    free_a, free_b, out = [True] * len(a), [True] * len(b), []
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and free_a[i + n] and free_b[j + n]:
                    n += 1
                best = max(best, (n, -i, -j))
        n, i, j = best[0], -best[1], -best[2]
        if n < least:
            return out
        free_a[i:i + n] = free_b[j:j + n] = [False] * n
        out.append(n)


def test_tiles_match_definition():
    rng = np.random.default_rng(0)
    for k in range(400):
        a = rng.integers(1, 2 + k % 5, rng.integers(0, 40)).astype(np.uint64)
        b = rng.integers(1, 2 + k % 5, rng.integers(0, 60)).astype(np.uint64)
        assert sorted(t[0] for t in decontaminate.tiles(a, b, 3)) == sorted(plain_tiles(a.tolist(), b.tolist(), 3))


def test_repetitive_texts_take_little(tmp_path):
    import time
    import tracemalloc
    index = decontaminate.Benchmark([(1, "ha " * 200), (2, "ho ha he " * 50)], 5)
    text = "ha " * 300_000
    tracemalloc.start()
    began = time.time()
    found = list(index.search([text, "ho ha he " * 40_000]))
    assert time.time() - began < 30 and tracemalloc.get_traced_memory()[1] < 300_000_000
    tracemalloc.stop()
    assert [(n, i, w, c) for n, i, w, c, *_ in found] == [(0, 1, 200, 200), (1, 2, 150, 150)]


def test_language_score_does_not_depend_on_neighbours():
    rng = np.random.default_rng(1)
    crf = langid.Crf(["a", "b"], rng.normal(0, 1, (1 << langid.BITS, 2)).astype(np.float32), np.zeros(2), np.eye(2))
    long = " ".join(f"w{i % 7919}" for i in range(140_000))
    texts = [long, "short one", long[:700_000], "x", long[:30_000]]
    together = langid.label_texts(texts, crf)
    for i, t in enumerate(texts):
        alone = langid.label_texts([t], crf)
        assert alone[0][0] == together[0][i] and abs(alone[1][0] - together[1][i]) < 1e-12


def test_samples_are_bounded_where_ids_repeat(spark):
    docs = spark.createDataFrame([(i % 3, f"text number {i} words", "en") for i in range(300)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i % 3, i % 2) for i in range(60)], "doc_id long, toxic int")
    assert toxicity._sample(docs, labels, F.lit(True), 2).count() == 2
    assert langid.fit(docs, F.lit(True), 2, 1).languages == ["en"]


def test_contaminated_planted_cases(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    item = [word() for _ in range(40)]
    filler = " ".join(word() for _ in range(3000))
    turned = " ".join(item[20:]) + " " + filler[:200] + " " + " ".join(item[:20])
    edited = " ".join(w if i % 13 else word() for i, w in enumerate(item))
    docs = frame(spark, [(1, f"{filler} {' '.join(item)} {filler}"), (2, turned), (3, edited.upper().replace(" ", ", ")), (4, filler),
                         (5, None), (6, ""), (7, " ".join(item[:12])), (1, f"{filler} {' '.join(item)}"), (8, " ".join(item) * 2)])
    bench = spark.createDataFrame([(9, " ".join(item), "x"), (9, " ".join(item), "y"), (10, None, "x"), (11, "one two", "x"), (12, "", "x")],
                                  "item_id long, text string, doc_id string")
    got = decontaminate.contaminated(docs, bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(1, 9), (1, 9), (2, 9), (3, 9), (8, 9)]
    assert {r.doc_id: r.covered_words for r in got}[2] == 40
    assert decontaminate.contaminated(frame(spark, []), bench).collect() == []
    assert decontaminate.contaminated(docs, bench.limit(0)).collect() == []


def test_contaminated_short_items_and_scripts_without_blanks(spark):
    docs = frame(spark, [(1, "前の文です。東京は日本の首都であり、人口が多い。後の文"), (2, "Who wrote Faust, they asked"), (3, "who wrote"),
                         (4, "นี่กรุงเทพมหานครเป็นเมืองหลวงของประเทศไทยนะ"), (5, "别的话首都北京是一座很大的城市别的话"), (6, "wrote who Faust")])
    bench = spark.createDataFrame([(1, "東京は日本の首都であり、人口が多い"), (2, "who wrote faust?"), (3, "กรุงเทพมหานครเป็นเมืองหลวงของประเทศไทย"),
                                   (4, "首都北京是一座很大的城市"), (5, "...")], "item_id long, text string")
    got = decontaminate.contaminated(docs, bench).collect()
    assert sorted((r.doc_id, r.item_id, r.coverage) for r in got) == [(1, 1, 1.0), (2, 2, 1.0), (4, 3, 1.0), (5, 4, 1.0)]


def test_contaminated_in_blocks(spark, monkeypatch):
    whole = sorted(tuple(r) for r in queries.decontamination(spark, SF).collect())
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 2000)
    assert sorted(tuple(r) for r in queries.decontamination(spark, SF).collect()) == whole


def test_words_of_slices_equal_words_of_text():
    text = " ".join(f"wört{i % 977}" for i in range(400_000))
    per_word = np.concatenate([w.hash for w in words([text])])
    one = {i: next(words([f"wört{i}"])).hash[0] for i in range(977)}
    assert per_word.tolist() == [one[i % 977] for i in range(400_000)]


def test_marginals_match_enumeration():
    rng = np.random.default_rng(2)
    k = 3
    crf = langid.Crf(list("abc"), np.zeros((1, k)), rng.normal(size=k), rng.normal(size=(k, k)))
    for n in (1, 2, 33, 70):
        scores = rng.normal(size=(n, k))
        got = langid.marginals(scores, np.zeros(n, int), crf)
        forward, back = np.zeros((n, k)), np.zeros((n, k))
        lse = lambda x, axis: np.log(np.exp(x - x.max()).sum(axis=axis)) + x.max()
        forward[0] = crf.start + scores[0]
        for t in range(1, n):
            forward[t] = lse(forward[t - 1][:, None] + crf.transition, 0) + scores[t]
        for t in range(n - 2, -1, -1):
            back[t] = lse(crf.transition + (scores[t + 1] + back[t + 1])[None, :], 1)
        want = forward + back
        want = np.exp(want - want.max(axis=1, keepdims=True))
        assert np.allclose(got, want / want.sum(axis=1, keepdims=True))
    two = langid.marginals(np.vstack([scores[:40], scores[:5]]), np.repeat([0, 1], [40, 5]), crf)
    assert np.allclose(two[40:], langid.marginals(scores[:5], np.zeros(5, int), crf))


def test_marginals_of_many_languages_word_by_word():
    rng = np.random.default_rng(8)
    crf = langid.Crf(list("abc"), np.zeros((1, 3)), rng.normal(size=3), rng.normal(size=(3, 3)))
    scores, chain = rng.normal(size=(200, 3)), np.repeat([0, 1, 5, 6], [70, 1, 33, 96])
    assert np.allclose(langid.by_word(scores, chain, crf), langid.marginals(scores, chain, crf))


def test_every_language_is_learned(spark):
    rng = random.Random(9)
    rows, doc = [], 0
    for lang in range(70):
        own = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(12)]
        for _ in range(9):
            rows.append((doc, " ".join(rng.choice(own) for _ in range(40)), f"l{lang}"))
            doc += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    crf = langid.fit(docs, ~held_out(F.col("doc_id")), rows=5)
    assert len(crf.languages) == 70
    got = docs.where(held_out(F.col("doc_id"))).select("lang", langid.predict(F.col("text"), crf, spark).alias("p")).collect()
    assert sum(r.lang == r.p.lang_pred for r in got) >= 0.97 * len(got)


def test_language_held_out_and_edges(spark):
    got = queries.languages(spark, SF)
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = got.join(truth, "doc_id").where("held_out and lang is not null").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
    crf = langid.fit(spark.read.parquet(f"{SF}/documents.parquet"), ~held_out(F.col("doc_id")))
    odd = odd_docs(spark).select("doc_id", langid.predict(F.col("text"), crf, spark).alias("p")).select("doc_id", "p.*").collect()
    assert len(odd) == len(ODD) + 2 and all(0 <= r.score <= 1 for r in odd)
    assert {r.doc_id for r in odd if r.lang_pred == "und"} >= {0, 1, 2, 3}
    nothing = langid.fit(frame(spark, []), F.lit(True))
    assert {r[0].lang_pred for r in odd_docs(spark).select(langid.predict(F.col("text"), nothing, spark)).collect()} == {"und"}
    mixed = " ".join(["the thing and of that with"] * 3 + ["der und die nicht das sich"] * 3)
    assert len(list(langid.words_of(mixed, crf))) == 36


def test_toxicity_held_out_and_edges(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmno") for _ in range(5))
    bad = ["zzvork", "qquump", "xyzzak"]
    rows = []
    for i in range(600):
        body = [word() for _ in range(rng.randrange(5, 200))]
        toxic = int(i % 5 == 0)
        if toxic:
            body.insert(rng.randrange(len(body)), rng.choice(bad) + word()[:2])
        rows.append((i, " ".join(body), toxic))
    docs = frame(spark, [r[:2] for r in rows]).withColumn("toxic", F.lit(7))
    labels = spark.createDataFrame([(i, t) for i, _, t in rows] + [(1, None), (0, 1), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, ~held_out(F.col("doc_id")))
    got = {r[0]: r[1] for r in docs.where(held_out(F.col("doc_id"))).select("doc_id", toxicity.score(F.col("text"), model, spark)).collect()}
    assert np.mean([(s >= 0.7) == (i % 5 == 0) for i, s in got.items()]) > 0.97
    odd = [r[0] for r in odd_docs(spark).select(toxicity.score(F.col("text"), model, spark)).collect()]
    assert all(0 <= s <= 1 for s in odd)
    for none in (labels.limit(0), labels.where("toxic = 0")):
        empty = toxicity.fit(docs, none, ~held_out(F.col("doc_id")))
        assert all(0 <= r[0] <= 1 for r in odd_docs(spark).select(toxicity.score(F.col("text"), empty, spark)).collect())


def test_grams_of_long_texts_equal_those_of_parts(monkeypatch):
    text = "".join(random.Random(5).choice("abc de") for _ in range(5000))
    whole = [(a.tolist(), b.tolist()) for a, b in toxicity._distinct([text, "x", text], None)]
    monkeypatch.setattr(toxicity, "SLICE", 300)
    parts: dict[int, set] = {}
    for number, feature in toxicity._distinct([text, "x", text], None):
        for n, f in zip(number.tolist(), feature.tolist(), strict=True):
            assert f not in parts.setdefault(n, set())
            parts[n].add(f)
    want: dict[int, set] = {}
    for number, feature in whole:
        for n, f in zip(number, feature, strict=True):
            want.setdefault(n, set()).add(f)
    assert parts == want
