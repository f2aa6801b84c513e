"""The nine operators against plain versions on one hand-made corpus, and their edge cases."""

import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from conftest_rows import rows
from pyspark.sql import functions as F

from siftmark.llm import distinctive_terms, encoding, format_duplicates, gear, leakage, lookalikes, queries, reading_level, shared_spans, split_overlap, term_frequency
from siftmark.plans import spread

CORPUS = "row_idx bigint, uid string, text string, label string, split string, source string"
FILLER = "our team reads every message before lunch while another reviewer checks the noisy label near harbour seven twice because nobody trusts a single model today".split()


def corpus_rows() -> list[tuple]:
    rng = random.Random(3)
    out: list[tuple] = []

    def add(text, label="allow", split=None, uid=None):
        i = len(out)
        out.append((i, uid or f"c{i:08d}", text, label, split or ("train", "test", "validation")[i % 3], f"s{i % 4}"))

    base = [" ".join(rng.sample(FILLER, 16)) + f" name{rng.randint(0, 40)}" for _ in range(40)]
    for t in base:
        add(t)
    for t in base[:8]:  # format variants, near copies, embedded quotes
        add(t.upper() + " !!")
        add(t.replace(" ", "  ") + ".", " Allow ")
        add(t + " extra", "block")
        add("Quoting: " + t + " -- end of " + str(rng.random()))
        add(" ".join(reversed(t.split())))
    add(None), add(""), add("   "), add("\t\n"), add("?!"), add("word"), add("word")
    add("a " * 3000), add("z" * 20000), add("z" * 20000 + "y")
    add("zork zork zork and zork"), add("zork again"), add("frob frob frob")
    add("café on the corner"), add("café on the corner"), add("cаfé on the corner"), add("cafe on the corner"), add("Café on the corner")
    add("plain", uid="ｃ０００００００３"), add(" "), add("​")
    out.append((len(out), None, "no uid here", None, None, None))
    return out


@pytest.fixture(scope="module")
def data():
    names = [c.split()[0] for c in CORPUS.split(", ")]
    return [dict(zip(names, r, strict=True)) for r in corpus_rows()]


@pytest.fixture(scope="module")
def corpus(spark):
    # columns whose names the operators use inside must not get in the way
    df = spark.createDataFrame(corpus_rows(), CORPUS)
    return df.withColumns({"id": F.lit("x"), "key": F.lit(1), "rep": F.lit(2), "n": F.lit(None).cast("int"), "digest": F.lit("d"), "term": F.lit("t"), "k": F.lit(0), "form": F.lit(9), "h": F.lit(0)}).repartition(5)


RAW = [(0, '{"uid":"a","text":"Hello, you","label":"allow"}'), (1, '{ "label" : " ALLOW", "text" : "hello YOU", "uid": 3 }'), (2, '{"text": "Hello, y'), (3, None), (4, "  "), (5, "[1]"), (6, '{"text":"hello you","label":null}'), (7, '{"text":"h\\u0065llo you","label":"allow","meta":{"x":[1]}}'), (8, '{"text":"\\ud800 hello","label":"x"}'), (9, '{"text":"hello you","label":"allow"} tail')]


def raw_df(spark):
    return spark.createDataFrame([(i, "s", line) for i, line in RAW], "line_id bigint, shard_name string, line string")


def empty(spark, schema):
    return spark.createDataFrame([], schema)


def test_p1_found(spark, corpus, data):
    got = rows(format_duplicates.copies_found(corpus, raw_df(spark)))
    assert got == brute.p1(data, RAW)
    assert ("raw_records", 0, 1) in got and ("raw_records", 0, 7) in got


def test_p1_counts_add_up(spark, corpus):
    keyed = corpus.select("row_idx", format_duplicates.record_key(F.col("text"), F.col("label")).alias("kk")).where("kk is not null").count()
    members, runs = format_duplicates.collapse(corpus, "row_idx")
    assert members.count() == keyed == runs.agg(F.sum("n")).first()[0]
    assert runs.count() == members.select("rep").distinct().count()


def test_p1_hot_group_spans_partitions(spark):
    df = spark.range(5000).select(F.col("id").alias("row_idx"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("Same, text"), F.repeat(F.lit("!"), (F.col("id") % 5).cast("int")))).otherwise(F.concat(F.lit("t"), F.col("id"))).alias("text"), F.lit("a").alias("label"))
    _, runs = format_duplicates.collapse(df, "row_idx")
    assert [tuple(r) for r in runs.where("n > 1").collect()] == [(0, 1667)]
    assert runs.count() == 3334


def test_p1_empty(spark):
    members, runs = format_duplicates.collapse(empty(spark, CORPUS), "row_idx")
    assert members.count() == runs.count() == 0


def test_p2(corpus, data):
    marked = term_frequency.marked_terms(corpus)
    assert rows(marked.where("mark <> 'useful'").select("term", "mark")) == brute.p2(data)
    stats = {r["term"]: (r["term_count"], r["doc_count"]) for r in marked.collect()}
    assert stats["zork"] == (5, 2) and stats["a"][0] >= 3000


def test_p2_empty(spark):
    assert term_frequency.marked_terms(empty(spark, CORPUS)).count() == 0


def test_p3(corpus, data):
    got = rows(shared_spans.shared_windows(corpus, "row_idx").select("id").distinct())
    assert {i for (i,) in got} == brute.p3(data) == {r["id"] for r in shared_spans.sharing_records(corpus, "row_idx").collect()}


@pytest.mark.parametrize("k", [24, 80, 200])
def test_p3_random_texts(spark, k):
    rng = random.Random(k)
    common = ["".join(rng.choice("abcd é漢") for _ in range(n)) for n in (k - 1, k, k + 1, 2 * k)]
    data = []
    for i in range(120):
        noise = lambda: "".join(rng.choice("efgh ij") for _ in range(rng.randint(0, 60)))  # noqa: E731, B023
        data.append({"row_idx": i, "text": noise() + rng.choice(common) + noise() if i % 2 else noise() * 4})
    df = spark.createDataFrame([(r["row_idx"], r["text"]) for r in data], "row_idx bigint, text string")
    want = brute.p3(data, k)
    assert {r[0] for r in shared_spans.shared_windows(df, "row_idx", min_chars=k).select("id").distinct().collect()} == want
    assert {r[0] for r in shared_spans.sharing_records(df, "row_idx", min_chars=k).collect()} == want
    assert shared_spans.sharing_records(df.limit(0), "row_idx").count() == 0


def test_p3_long_texts_are_cut_in_segments(spark, monkeypatch):
    """Segments and slices bound memory and change no anchor."""
    rng = random.Random(8)
    texts = ["".join(rng.choice("abcdefg ") for _ in range(n)) for n in (5000, 90, 3000, 700)]
    df = spark.createDataFrame(list(enumerate(texts)), "row_idx bigint, text string")
    source = [pa.RecordBatch.from_pydict({"id": [0, 1, 2, 3], "text": texts})]
    found = lambda: {tuple(r.values()) for b in shared_spans._anchors(80)(iter(source)) for r in b.to_pylist()}
    whole = found()
    assert whole == {tuple(r) for r in shared_spans.anchors(df, "row_idx").collect()}
    monkeypatch.setattr(gear, "SEGMENT", 400)
    monkeypatch.setattr(spread, "SLICE_BYTES", 1000)
    assert found() == whole


def test_p3_amount(spark):
    a = "".join(random.Random(1).choice("abcdefghij") for _ in range(100))
    df = spark.createDataFrame([(0, a + "x" * 10), (1, "yy" + a), (2, None), (3, ""), (4, "short")], "row_idx bigint, text string")
    got = {r["id"]: r["shared_chars"] for r in shared_spans.shared_amount(df, "row_idx").collect()}
    assert got == {0: 100, 1: 100, 3: 0, 4: 0}
    assert shared_spans.shared_amount(df.limit(0), "row_idx").count() == 0


def test_p3_bound():
    with pytest.raises(ValueError):
        shared_spans.Plan(10).width  # noqa: B018


QUEUE = "entry_id bigint, uid string, excerpt string"


def queue_rows(data):
    t = data[0]["text"]
    return [(1000, "c00000000", t[:140]), (1001, "c00000000", t[:20] + "​" + t[20:140]), (1002, "с" + "00000001", data[1]["text"][:140].replace("a", "а")), (1003, None, "x"), (1004, "nobody", None), (1005, "с" + "00000002", None), (1005 + 1, "c00000000", t[:30])]


def test_p4(spark, corpus, data):
    q = queue_rows(data)
    queue = spark.createDataFrame(q, QUEUE)
    entries = [dict(zip(("entry_id", "uid", "excerpt"), r, strict=True)) for r in q]
    got = rows(lookalikes.lookalikes_found(corpus, queue))
    assert got == brute.p4(data, entries)
    assert {g[0] for g in got} == {"text", "uid", "queue_uid", "excerpt"}
    assert lookalikes.lookalikes_found(corpus.limit(0), queue.limit(0)).count() == 0


def test_p4_classes(spark):
    df = spark.createDataFrame([(3, "café"), (1, "cafe\u0301"), (2, "x"), (4, None), (5, "\u200b "), (6, "x")], "row_idx bigint, text string")
    members, classes = lookalikes.lookalike_classes(df, "row_idx", "text")
    assert rows(members) == {(1, 1), (3, 1), (2, 2), (6, 2)} and rows(classes) == {(1, 2), (2, 2)}


def test_p4_segments_equal_the_whole():
    rng = random.Random(5)
    alphabet = "ab e é́̈‍ ﬁａ\U0001d5baаññ한한А"
    for _ in range(3000):
        s = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 12)))
        c = lookalikes.canonical(s)
        assert lookalikes.canonical(c) == c
        assert c == lookalikes._segment("".join(s)) or s.isascii()
    assert lookalikes.canonical(None) is None


def test_p5(corpus, data):
    got = rows(split_overlap.cross_split_pairs(corpus).select("idx_a", "idx_b"))
    assert got == brute.p5(data)
    assert got


def test_p5_random_sets(spark):
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(60)]
    data = []
    for i in range(200):
        if i % 2 and i > 1:
            w = data[rng.randrange(len(data))]["text"].split()
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            w += rng.sample(vocab, rng.randint(0, 3))
            rng.shuffle(w)
        else:
            w = rng.sample(vocab, rng.randint(4, 30))
        data.append({"row_idx": i, "text": " ".join(w), "split": rng.choice(["train", "test", "validation", "other"])})
    df = spark.createDataFrame([(r["row_idx"], r["text"], r["split"]) for r in data], "row_idx bigint, text string, split string")
    for s in (0.8, 0.9):
        found = rows(split_overlap.cross_split_pairs(df, similarity=s).select("idx_a", "idx_b"))
        if s == 0.8:
            assert found == brute.p5(data)
        else:
            assert found <= brute.p5(data)
    assert split_overlap.cross_split_pairs(df.limit(0)).count() == 0


def test_p5_rows_are_linear_in_the_words():
    """A long held-out record is cut into a few ranges a word at most, and no digest stands for an empty range."""
    rng = np.random.default_rng(1)
    for n in (5, 26, 500, 5000, 50_000):
        h = np.sort(rng.integers(0, 1 << 63, n, dtype=np.uint64) * 2)
        for train in (True, False):
            rec, digest, group = split_overlap.range_chunks(h, np.array([0, n]), np.array([train]), 0.8)
            assert len(rec) == len(digest) <= (1 if train else 3) * 2 * n and len(set(digest.tolist())) == len(digest)
            for hot in (digest[:0], digest):  # also where every range is a heavy hitter
                rec, chunks = split_overlap.meeting_chunks(rec, digest, group, hot.view(np.int64))
                assert len(rec) == len(chunks) <= (1 if train else 3) * max(5 * n, 153)
                rec = np.zeros(len(digest), np.int64)
    other = np.sort(rng.integers(0, 1 << 63, 12, dtype=np.uint64) * 2)
    mine = np.sort(rng.integers(0, 1 << 63, 12, dtype=np.uint64) * 2)
    two = [set(split_overlap.range_chunks(x, np.array([0, 12]), np.array([t]), 0.8)[1].tolist()) for x, t in ((other, True), (mine, False))]
    assert not two[0] & two[1]  # unrelated records have no chunk in common


def test_p5_every_similar_pair_has_a_range_in_common():
    rng = np.random.default_rng(2)
    for _ in range(400):
        n = int(rng.integers(5, 60) if _ % 10 else rng.integers(100, 900))
        h = rng.integers(0, 1 << 62, n, dtype=np.uint64) * 4
        drop = int(rng.integers(0, n // 9 + 1))
        kept = h[drop:]
        more = rng.integers(0, 1 << 62, int(len(kept) / 0.8) - n, dtype=np.uint64) if len(kept) / 0.8 > n else h[:0]
        other = np.concatenate([kept, more])
        if len(kept) < 0.8 * (n + len(other) - len(kept)) or len(other) < 5:
            continue
        for a, b in ((h, other), (other, h)):
            cut = [split_overlap.range_chunks(np.sort(x), np.array([0, len(x)]), np.array([t]), 0.8) for x, t in ((a, True), (b, False))]
            for hot in (cut[0][1][:0], np.concatenate([cut[0][1], cut[1][1]]), cut[0][1][::2]):
                chunks = [set(split_overlap.meeting_chunks(*c, hot.view(np.int64))[1].tolist()) for c in cut]
                assert chunks[0] & chunks[1]


def test_p5_heavy_chunks_come_last():
    row, digest, chars = np.array([0, 0, 0, 1, 1]), np.array([5, 9, 7, 5, 8]), np.array([30, 30, 40, 50, 50])
    assert sorted(zip(*(x.tolist() for x in split_overlap.first_chunks(row, digest, chars, np.array([5]), 0.7)), strict=True)) == [(0, 7), (1, 8)]
    assert sorted(zip(*(x.tolist() for x in split_overlap.first_chunks(row, digest, chars, np.array([], np.int64), 0.7)), strict=True)) == [(0, 5), (0, 7), (1, 5)]


def test_p5_classes_have_a_row_a_record(spark):
    t = "one two three four five six seven eight nine ten eleven twelve"
    df = spark.range(300).select(F.col("id").alias("row_idx"), F.when(F.col("id") % 3 < 2, F.lit(t)).otherwise(F.concat(F.lit("other words of no use to row "), F.col("id").cast("string"))).alias("text"), F.when(F.col("id") % 2 == 0, "train").otherwise("test").alias("split"))
    pairs, members = split_overlap.overlap_classes(df)
    held = {r["id"]: r["rep"] for r in members.collect()}
    assert [(held[0], held[1])] == [(r["t"], r["e"]) for r in pairs.collect() if held[r["t"]] == held[0]]
    assert sum(v == held[0] for v in held.values()) == 100
    assert split_overlap.cross_split_pairs(df).where("overlap = 1 and rolling").count() == 100 * 100


def test_p5_overlap(spark):
    t = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    df = spark.createDataFrame([(0, t, "train", "a"), (1, t.upper() + "!", "test", None), (2, "nothing of the kind is found in this other text at all", "train", "a"), (3, None, "test", "b"), (4, "", "test", "b")], "row_idx bigint, text string, split string, source string")
    got = {r["id"]: r["overlap"] for r in split_overlap.overlap_fractions(df).collect()}
    assert got == {0: 1.0, 1: 1.0, 2: 0.0}
    assert rows(split_overlap.overlap_report(df)) == {("train", "a", 1), ("test", None, 1)}


def test_p6(spark, corpus, data):
    scored = distinctive_terms.distinctive_terms(corpus, "row_idx", min_tf=3, min_docs=2, max_docs=5)
    assert rows(scored.select("id", "term")) == brute.p6(data)
    full = distinctive_terms.distinctive_terms(corpus, "row_idx").where("term in ('zork', 'and')").collect()
    z = {(r["id"], r["term"]): r["z"] for r in full}
    row = next(i for i, t in z if t == "zork" and z[i, t] == max(v for (_, w), v in z.items() if w == "zork"))
    assert z[row, "zork"] > 2 and z[row, "zork"] > z.get((row, "and"), -9)
    assert distinctive_terms.distinctive_terms(corpus.limit(0), "row_idx").count() == 0
    alone = spark.createDataFrame([(1, "one one")], "row_idx bigint, text string")
    assert distinctive_terms.distinctive_terms(alone, "row_idx").count() == 1


def test_p6_found_has_no_stage_without_effect(spark, corpus, data, tmp_path):
    """Its rows rest on counts, so nothing but the corpus and one scan of the statistics is in the plan; the scores need the total too."""
    corpus.write.parquet(f"{tmp_path}/corpus.parquet")
    found, scores = queries.p6_found(spark, str(tmp_path)), queries.p6_scores(spark, str(tmp_path))
    leaves = lambda df: df._jdf.queryExecution().optimizedPlan().collectLeaves().size()
    assert leaves(found) == 2 and leaves(scores) == 3
    assert rows(found) == brute.p6(data) == rows(scores.where("tf >= 3 and doc_count between 2 and 5").select("row_idx", "term"))
    assert rows(distinctive_terms.counted_terms(corpus, "row_idx")) == rows(distinctive_terms.distinctive_terms(corpus, "row_idx").drop("z"))
    assert distinctive_terms.counted_terms(corpus.limit(0), "row_idx").count() == 0


TEXTS = [None, "", " ", "Hello <|endoftext|> world's  end\n\n x", "日本語とEnglish", "a" * 5000, " " * 700, "word " * 400, "é́" * 300, "x1y2" * 500, "mixed 123 " * 90 + "!" * 600 + " tail"]


def test_p7_ids_and_round_trip(spark):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(encoding.VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string").withColumn("ids", F.lit(0)).withColumn("k", F.lit(1))
    for chunk, overlap in ((16384, 512), (120, 40), (64, 16)):  # the small ones cut everything, also where nothing meets
        got = {r["doc_id"]: r["ids"] for r in encoding.encode_corpus(df, chunk_chars=chunk, overlap_chars=overlap).collect()}
        assert len(got) == len(TEXTS)
        for i, text in enumerate(TEXTS):
            assert got[i] == (t.encode(text, add_special_tokens=False).ids if text else [])
            assert encoding.decode(got[i]) == (text or "")
    assert encoding.encode_corpus(df.limit(0)).count() == 0


def test_p8(spark):
    words = [f"q{i}" for i in range(40)]
    items = [(1, " ".join(words[:20]), "yes q1"), (2, " ".join(words[10:35]), None), (3, "too short", "a"), (4, None, None), (5, " ".join(words[:20]), "other")]
    docs = [(0, "Before. " + ", ".join(words[3:15]).upper() + " after yes, q1"), (1, " ".join(words[3:14])), (2, "-".join(words)), (3, None), (4, ""), (5, "x " * 500 + "\n".join(words[:12]) + " mid " + " ".join(words[5:20])), (6, " ".join(words[:12]) + "İ" + " ".join(words[12:30]))]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit(0)).withColumn("start", F.lit(0))
    e = spark.createDataFrame(items, "item_id bigint, text string, answer string")
    assert rows(leakage.leaks_found(d, e)) == brute.p8(docs, [(i, t) for i, t, _ in items])
    spans = {(r["doc_id"], r["item_id"]): r for r in leakage.leaked_spans(d, e).where("doc_id in (0, 2)").collect()}
    s = spans[0, 1]
    assert docs[0][1][s["start"] : s["end"]].lower() == ", ".join(words[3:15]) and s["n_words"] == 12 and s["answer_seen"] and not spans[0, 5]["answer_seen"]
    assert leakage.leaks_found(d.limit(0), e).count() == leakage.leaks_found(d, e.limit(0)).count() == 0


@pytest.mark.parametrize("odd", ["İstanbul", "GROẞE", "e\u0301te\u0301", "İ\u0307İ"])
def test_p8_offsets_are_those_of_the_original(spark, odd):
    words = [f"q{i}" for i in range(14)]
    text = f"{odd} is {odd}: {' '.join(words[:6])} {odd}, {' '.join(words[6:])} and {odd}"
    item = f"x {' '.join(words[:6])} {odd} {' '.join(words[6:])}"
    d = spark.createDataFrame([(0, text)], "doc_id bigint, text string")
    e = spark.createDataFrame([(1, item, None)], "item_id bigint, text string, answer string")
    got = leakage.leaked_spans(d, e).collect()
    assert [text[r["start"] : r["end"]] for r in got] == [f"{' '.join(words[:6])} {odd}, {' '.join(words[6:])}"]


def test_p8_blocks_change_nothing(spark, monkeypatch):
    words = [f"q{i}" for i in range(40)]
    d = spark.createDataFrame([(0, " ".join(words))], "doc_id bigint, text string")
    e = spark.createDataFrame([(i, " ".join(words[i : i + 15]), None) for i in range(20)], "item_id bigint, text string, answer string")
    one = rows(leakage.leaks_found(d, e))
    monkeypatch.setattr(leakage, "BLOCK_CHARS", 200)
    assert rows(leakage.leaks_found(d, e)) == one and len(one) == 20


EASY = "The cat saw a dog. A kid had a ball. The bus is red. A boy ran to the park."
HARD = "Any epistemological operationalisation presupposes institutional accountability notwithstanding methodological heterogeneity. Such counterfactual multicollinearity destabilises probabilistic reproducibility."


def documents():
    rng = random.Random(2)
    out = []
    for i in range(80):
        parts = (HARD if i % 2 else EASY).split(". ")
        out.append((i, ". ".join(rng.choice(parts) for _ in range(8)), "en" if i % 5 else None, "post", 5 if i % 2 else 1))
    return out


def test_p9(spark):
    rated = documents()
    extra = [(100, None, "en", "post"), (101, "", "en", "post"), (102, HARD[:40], "en", "post"), (103, HARD * 3, "en", "config"), (104, HARD * 3, "ru", "post"), (105, "слово " * 60, None, "post"), (106, HARD * 200, "en", None), (107, EASY + "\n> " + HARD.replace(". ", "\n> ") + "\n" + EASY * 3, "en", "post"), (108, "\U0001f44d " + HARD * 2, None, "post"), (109, "123 456 " * 30, "en", "post")]
    docs = spark.createDataFrame([r[:4] for r in rated] + extra, "doc_id bigint, text string, lang string, kind string").withColumn("band", F.lit("x"))
    ratings = spark.createDataFrame([(i, r[0], f"r{k}", r[4] if k else None) for i, r in enumerate(rated) for k in range(3)] * 2 + [(999, 12345, "r", 3)], "rating_id bigint, doc_id bigint, rater string, band int")
    got = rows(reading_level.demanding_found(docs, ratings))
    assert {i for (i,) in got if i < 100} == {r[0] for r in rated if r[4] == 5}
    assert {i for (i,) in got if i >= 100} == {106, 108}
    assert reading_level.demanding_found(docs.limit(0), ratings).count() == 0
    assert reading_level.demanding_found(docs, ratings.limit(0)).count() == 0


def test_p9_neighbours_of_the_languages():
    other = ["Il modello è stato valutato con una serie di testi che non sono nel corpus, e per questo gli errori sono più rari.", "Het model is met een reeks van teksten getest die niet in de verzameling zijn, en dat is ook voor de lezer van belang.", "O modelo não foi avaliado com os textos que são do conjunto, e por isso os erros da medida são mais raros para o leitor."]
    ours = ["The model was evaluated on a series of texts that are not in the collection, and for this the errors are rare.", "Le modèle est évalué sur des textes qui ne sont pas dans la collection, et les erreurs sont rares pour le lecteur.", "Das Modell ist mit den Texten der Sammlung nicht geprüft, und die Fehler sind für den Leser auch selten.", "El modelo no se evalúa con los textos de la colección, y por eso los errores son más raros para el lector.", "", "short"]
    assert all(map(reading_level.other_language, other)) and not any(map(reading_level.other_language, ours))


def test_p9_held_out():
    docs = documents()
    m = reading_level.fit([d[1] for d in docs[:50]], [d[4] for d in docs[:50]])
    p, n = m.bands([d[1] for d in docs[50:]])
    assert [int(b) for b in p.argmax(axis=1) + 1] == [d[4] for d in docs[50:]] and (n > 20).all()


def test_gear_depends_on_its_window_only():
    a, b = "q" * 40 + "the same sixteen chars and more", "zz" + "the same sixteen chars and more"
    ha, hb = (gear.gear(gear.code_points([t])[0]) for t in (a, b))
    n = len("the same sixteen chars and more") - gear.WINDOW + 1
    assert (ha[-n:] == hb[-n:]).all()


def test_cuts_cover_every_window():
    rng = random.Random(4)
    texts = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 300))) for _ in range(50)] + ["", "z" * 500]
    cp, off = gear.code_points(texts)
    at, row = gear.cuts(cp, off, 24)
    for i, t in enumerate(texts):
        mine = set((at[row == i] - off[i]).tolist())
        for s in range(gear.WINDOW - 1, len(t) - 24 + 1):
            assert mine & set(range(s, s + 24))
