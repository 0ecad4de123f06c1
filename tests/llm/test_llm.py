"""The training-data operators against brute force on small fixtures."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridloom.llm import language, mixing, neardup, ngram, pieces, quality, quotes, repeats, topk, toxicity
from gridloom.llm.queries import fold

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
BASE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega"


def words(n: int, seed: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(BASE.split()[i] + str(j) for i, j in zip(rng.integers(0, 24, n), rng.integers(0, 9, n), strict=True))


@pytest.fixture(scope="module")
def docs(spark):
    long = words(120, 1)
    parts = long.split()
    near = " ".join([*parts[:60], "changed", *parts[61:]])
    rows = [(1, long), (2, long), (3, near), (4, words(120, 2)), (5, None), (6, ""), (7, "hi"), (8, "hi"), (9, "é" * 200), (10, words(30, 3) + "\n" + long[:200] + "\n" + words(20, 4)), (10, words(40, 5)), (11, "go go go " * 40), (12, words(3000, 6))]
    return spark.createDataFrame([(i, t, "xx" if i % 2 else "yy", None if i == 4 else f"s{i % 3}", len(t or "")) for i, t in rows], DOCS).withColumn("label", F.lit(1)).cache()


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert quality.quality(none).count() == neardup.classes(none).count() == pieces.encode(none).count() == mixing.mix_totals(none).count() == repeats.measure(none).count() == 0
    assert ngram.score(none, ngram.train(none)).count() == 0 and language.identify(none, language.train_profiles(none)).count() == 0
    assert toxicity.score(none, spark.createDataFrame([], "doc_id long, toxic int")).count() == 0
    assert quotes.conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    v = topk.quantised(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert topk.top_k(v, v).count() == 0


def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(7)
    data = [(int(i), [float(x) for x in v]) for i, v in enumerate(rng.normal(0, 0.2, (400, 16)).round(2))]
    data += [(900, data[0][1]), (901, None), (902, [float("nan")] * 16), (903, [None] * 16)]
    v = topk.quantised(spark.createDataFrame(data, "vec_id long, embedding array<float>"))
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(v, v.filter("vec_id % 50 = 0")).collect()}
    known = {i: np.floor(256 * np.array(x, np.float32).astype(float)).astype(int) for i, x in data if i < 901}
    for q in [i for i in known if i % 50 == 0]:
        best = sorted((-int(known[q] @ x), i) for i, x in known.items() if i != q)[:5]
        assert [got[q, k + 1] for k in range(5)] == [(i, -s) for s, i in best]


def test_near_duplicates(spark, docs):
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(docs).collect()}
    assert got[1] == got[2] == got[3] == 1 and got[7] == got[8] == 7
    assert all(got[i] == i for i in (4, 5, 6, 9, 10, 11, 12))


def test_near_duplicates_with_null_ids(spark):
    docs = spark.createDataFrame([(1, words(40, 1)), (2, words(40, 1)), (None, words(40, 2)), (None, words(40, 1))], "doc_id long, text string")
    got = neardup.classes(docs).collect()
    assert {(r["doc_id"], r["class_id"]) for r in got} == {(1, 1), (2, 1), (None, None), (None, 1)}
    assert [r["doc_id"] for r in neardup.keep_firsts(docs).orderBy(F.col("doc_id").desc_nulls_last()).collect()] == [1, None]


def test_signatures_estimate_weighted_similarity():
    a, b = np.arange(300, dtype=np.uint64), np.arange(100, 400, dtype=np.uint64)
    rows, items = np.repeat([0, 1], 300), np.concatenate((a, b))
    sig = neardup.signatures(rows, items, np.ones(600), 2, 2000)
    assert abs((sig[0] == sig[1]).mean() - 0.5) < 0.05
    heavy = np.concatenate((np.full(300, 1.0), np.full(300, 3.0)))
    sig = neardup.signatures(np.repeat([0, 1], 300), np.concatenate((a, a)), heavy, 2, 2000)
    assert abs((sig[0] == sig[1]).mean() - 1 / 3) < 0.05


def test_pieces_equal_the_library_and_round_trip(spark, docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    extra = spark.createDataFrame([(100, " a  b   c"), (101, "x\n\n y\t z"), (102, "日本 🎉 émoji ▁"), (103, "a" * 3000), (104, "<s> <0x41>")], "doc_id long, text string")
    rows = pieces.encode(docs.select("doc_id", "text").union(extra))
    texts = defaultdict(list)
    for r in docs.select("doc_id", "text").union(extra).collect():
        texts[r["doc_id"]].append(r["text"])
    for r in rows.collect():
        assert r["ids"] in [None if t is None else sp.encode(t) for t in texts[r["doc_id"]]]
        assert r["round_trip"] in (True, None) or r["doc_id"] == 102
    assert {r["doc_id"]: r["text"] for r in pieces.decode(rows.filter("doc_id = 12")).collect()} == {12: texts[12][0]}


def base_counts(text):
    text = text or ""
    ws = WORDS.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(ws[i : i + 8]) for i in range(len(ws) - 7))
    cover = set()
    for i in range(len(ws) - 7):
        if windows[tuple(ws[i : i + 8])] > 1:
            cover.update(range(i, i + 8))
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), dup, len(cover)


def test_quality_counts_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in quality.quality(docs).collect():
        want = base_counts(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and (not r["base_failed"] or not r["kept"])


def test_clean_texts_in_all_scripts_stay(spark):
    clean = ["Каждый вечер старый мастер закрывал окно и долго слушал как шумит река за садом пока соседские дети бегали по узкой дороге и звали друг друга домой ужинать с кабелем USB", "Κάθε βράδυ ο γέρος μάστορας έκλεινε το παράθυρο και άκουγε το ποτάμι πίσω από τον κήπο ενώ τα παιδιά έτρεχαν στον στενό δρόμο με το σήμα της NASA", "每天 晚上 老 师傅 关上 窗户 静静 地 听 花园 后面 的 河水 声 孩子们 在 小路 上 跑 着 叫 彼此 回家 吃饭 还有 一根 USB 线"]
    got = {r["doc_id"]: r for r in quality.quality(spark.createDataFrame(list(enumerate([*clean, "𐐀𐐁 x", "", "123"])), "doc_id long, text string")).collect()}
    assert [got[i]["kept"] for i in range(3)] == [True] * 3 and [got[i]["script"] for i in range(3)] == ["greek-cyrillic", "greek-cyrillic", "cjk"]
    assert all(got[i]["base_failed"] for i in (3, 4, 5))


def test_quotes_link_nested_levels(spark):
    rows = [
        (1, 0, "u", "The first idea\nis simple"), (1, 1, "a", "I agree fully"), (1, 2, "u", "Ann wrote:\n> I agree  FULLY\n>> is simple\nMe too"),
        (1, 3, "a", "> Me too\nFine"), (2, 0, "u", "> Fine\nfrom elsewhere"), (2, 1, "a", None), (2, 2, "a", ""), (3, 0, "u", "> never said"),
    ]
    got = {(r["conv_id"], r["turn"]): r for r in quotes.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert (got[1, 2]["reply_turn"], got[1, 2]["text"]) == (1, "Me too")
    assert [(q["level"], q["src_turn"]) for q in got[1, 2]["quotes"]] == [(1, 1), (2, 0)]
    assert (got[1, 3]["reply_turn"], got[1, 3]["thread_turn"], got[1, 3]["depth"]) == (2, 1, 2)
    assert (got[2, 0]["reply_conv"], got[2, 0]["reply_turn"]) == (1, 3) and got[3, 0]["reply_turn"] is None
    assert got[2, 1]["text"] is None and len(got) == 8


def test_quotes_link_rewrapped_and_partial_passages(spark):
    long = "One two three four five six seven eight nine ten. A second sentence that stands in the same line."
    rows = [
        (1, 0, "u", long), (1, 1, "a", "A common answer that nobody else gives here"),
        (1, 2, "u", "> One two three\n> four FIVE six seven\n>\n> eight nine ten.\nYes"),  # re-wrapped
        (1, 3, "a", "> a second sentence that stands in\nNo"),  # one sentence of a line
        (1, 4, "u", "> nobody else\n>> seven eight\n>> nine ten. A second\nOh"),  # few words, and a nested re-wrapped run
        (2, 0, "u", "> three four five six\n> seven\n\n> else gives\nfrom elsewhere"), (2, 1, "a", "> five six nine seven eight one\nnot written so"),
    ]
    got = {(r["conv_id"], r["turn"]): r for r in quotes.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert [(got[k]["reply_conv"], got[k]["reply_turn"]) for k in ((1, 2), (1, 3), (1, 4), (2, 0), (2, 1))] == [(1, 0), (1, 0), (1, 1), (1, 0), (None, None)]
    assert [(q["level"], q["src_turn"], q["n_lines"]) for q in got[1, 4]["quotes"]] == [(1, 1, 1), (2, 0, 2)]
    assert got[1, 2]["quotes"][0]["n_lines"] == 3 and got[1, 2]["text"] == "Yes"


def test_repeats_equal_brute_force(spark, docs):
    rows = sorted(((r["doc_id"], (r["text"] or "").encode()) for r in docs.collect()))
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.measure(docs).collect())
    want = []
    for i, b in rows:
        earlier = {x[p : p + 50] for j, x in rows if j < i for p in range(len(x) - 49)}
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if b[p : p + 50] in earlier:
                gone[p : p + 50] = b"\1" * 50
        spans = sum(1 for p in range(len(b)) if gone[p] and (p == 0 or not gone[p - 1]))
        want.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    assert got == sorted(want)


def test_language_and_toxicity_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language.identify(docs, language.train_profiles(docs.filter(fold(4) != 2))).join(docs.select("doc_id", "lang"), "doc_id").filter(fold(4) == 2)
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.95
    odd = spark.createDataFrame([(1, None), (2, "123 !"), (3, "")], "doc_id long, text string")
    assert {r["lang_pred"] for r in language.identify(odd, language.train_profiles(docs)).collect()} == {"und"}
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = toxicity.score(docs, labels.filter(fold(4) != 2)).join(labels, "doc_id").filter(fold(4) == 2)
    assert got.filter("toxic = predicted").count() > 0.9 * got.count()


def test_levenshtein_automaton():
    m = toxicity.Matcher([("idiot", False), ("loweis", True), ("ass", False)], 5)
    words_ = ["idiot", "idot", "idiott", "ldiot", "idi0t", "ids", "loweischaft", "lowei", "ass", "as", "", "idioten"]
    assert [h >= 0 for h in m.match(words_)] == [True, True, True, True, True, False, True, False, True, False, False, False]


def test_misspellings_inside_a_learned_beginning(spark):
    rows = [(words(30, i) + (" grobian" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(120)]
    terms = toxicity.learn_terms(spark.createDataFrame(rows, "text string, toxic int"), toxicity.Lexicon())
    assert ("grob", True) in terms and ("grobian", False) in terms
    m = toxicity.Matcher(terms, 5)
    assert [h >= 0 for h in m.match(["grobian", "gxobian", "gobian", "grrobian", "grobianus", "gxxbian"])] == [True, True, True, True, True, False]


def test_rare_terms_are_learned_whatever_the_sample(spark):
    """500 terms, each in 4 of 2,000 toxic rows (0.2 %) of 16,000, are all learned and trusted; words of single rows are not."""
    stem = lambda i: "".join("bdfgklmnprstvz"[i // 14**k % 14] + "aeiou"[(i >> k) % 5] for k in range(3))
    rows = [(words(12, i % 3000) + (f" {stem(i // 8 % 500)}" if i % 8 == 0 else ""), int(i % 8 == 0)) for i in range(16000)]
    terms, trust = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, toxic int"), toxicity.Lexicon())
    found = toxicity.Matcher(terms, 5).match([stem(i) for i in range(500)])
    assert (found >= 0).all() and (found % 2 == 0).all() and (trust[found // 2] > 0.9).all()
    assert (toxicity.Matcher(terms, 5).match([b + "0" for b in BASE.split()]) < 0).all()


def test_language_model(spark, docs):
    model = ngram.train(docs.filter("doc_id < 10"))
    rows = {r["doc_id"]: r for r in ngram.score(docs.filter("doc_id != 10"), model).collect()}
    train = [r["text"] or "" for r in docs.filter("doc_id < 10").collect()]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    c = Counter(w for t in train for w in [*WORDS.findall(t.translate(lower)), None])
    n, v = sum(c.values()), len(c)
    for r in docs.filter("doc_id != 10").collect():
        ts = [*WORDS.findall((r["text"] or "").translate(lower)), None]
        assert rows[r["doc_id"]]["base_score"] == pytest.approx(sum(np.log10((c[t] + 1) / (n + v + 1)) for t in ts))
        assert (rows[r["doc_id"]]["n_tokens"], rows[r["doc_id"]]["n_known"], rows[r["doc_id"]]["train_tokens"]) == (len(ts), sum(c[t] > 0 for t in ts), n)
    assert rows[1]["score"] > rows[1]["base_score"]
    # after one context, the probabilities of all known words and of one unknown word sum to 1
    vocabulary = [w for w in c if w is not None]
    one = spark.createDataFrame([(i, "alpha0 " + w) for i, w in enumerate([*vocabulary, "unseen"])], "doc_id long, text string")
    first = ngram.score(spark.createDataFrame([(0, "alpha0")], "doc_id long, text string"), model).first()["score"]
    assert first < 0 and ngram.score(one, model).filter("score >= 0 or isnan(score)").count() == 0


def test_mix_reaches_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.mix_totals(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    by = defaultdict(lambda: [0, 0, 0])
    for r in rows:
        assert r["size"] == 0 or r["taken"] <= 2 * r["size"]
        by[r["source"]][0] += r["size"]
        by[r["source"]][1] += r["taken"]
        by[r["source"]][2] = r["target"]
    total, most = sum(s for s, _, _ in by.values()), max(r["size"] for r in rows)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(by))}
    want, left, open_ = {}, 1.5 * total, dict(weight)
    while open_:
        level = left / sum(open_.values())
        over = [s for s in open_ if level * open_[s] > 2 * by[s][0]]
        for s in over or list(open_):
            want[s] = 2 * by[s][0] if over else level * open_[s]
            left -= want[s]
            del open_[s]
    for s, (_, taken, target) in by.items():
        assert target == pytest.approx(want[s]) and abs(taken - target) <= 2 * most


def test_mix_takes_rows_with_null_and_repeated_ids(spark):
    rows = [(i if i < 40 else 7 if i < 50 else None, f"text{i} " + words(19, i), "xx", f"s{i % 2}", 0) for i in range(100)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    copies = mixing.mix_sources(docs)
    taken = copies.filter("taken")
    got = Counter(r["text"] for r in mixing.mixed_documents(docs).collect())
    assert sum(got.values()) == 150 == taken.count() and max(got.values()) <= 2
    assert sum(n for t, n in got.items() if int(t.split()[0][4:]) >= 50) == taken.filter("doc_id is null").count() > 50
    assert copies.filter("doc_id is null").select("at").distinct().count() == 100


def test_pipeline_stages(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    ids = [r["doc_id"] for r in out.collect()]
    assert ids and max(Counter(ids).values()) <= 2
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = {r["doc_id"] for r in quality.quality(docs).filter("kept").collect()}
    assert set(ids) <= kept
