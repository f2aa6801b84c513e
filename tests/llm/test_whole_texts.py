"""Texts that must be read whole: prose behind a quote, long texts with blank lines on a chunk's border."""

from siftmark.llm import encoding, reading_level
from test_problems import EASY, HARD


def bare(text: str) -> str:
    return " ".join(reading_level._own_lines(text).split())


def test_p9_prose_goes_on_behind_a_quote():
    quote = "The label rejected this\n> record after each random channel and\n> one steady corpus trained."
    assert bare(f"Own words > {quote} own again. And to the end.\nLast.") == "Own words own again. And to the end. Last."
    assert bare("Own words > not told from what follows, to the end.\nLast.") == "Own words > not told from what follows, to the end. Last."
    assert bare("One.\n> quoted alone\nTwo.\n  > quoted. " + "Own words again. " * 20 + "\nThree.").endswith("Own words again. Three.")
    assert bare("One.\n> quoted\n> more\n\n> again\nTwo 3 > 2.") == "One. Two 3 > 2."


def test_p9_counts_the_prose_behind_a_quote():
    texts = [EASY * 4 if i % 2 else HARD * 4 for i in range(20)]
    m = reading_level.fit(texts, [1 if i % 2 else 5 for i in range(20)])
    p, _ = m.bands(["The cat saw > a ball. " + HARD * 6, "Any > the cat saw a dog by\n> the park and the bus. " + HARD * 6])
    assert list(p.argmax(axis=1) + 1) == [5, 5]


def test_p7_blank_line_ends_on_the_border(spark):
    texts = []
    for gap in ("\n\n", "\r\n\r\n", " \n\t", "   \n", "\n\n　", " \n  "):
        for shift in range(-2, 4):
            head = "word " * 40
            texts.append(head[: 64 - len(gap) + shift] + gap + "Foo bar and more of it. " * 12)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["ids"] for r in encoding.encode_corpus(df, chunk_chars=64, overlap_chars=32).collect()}
    assert got == {i: encoding.encode(t) for i, t in enumerate(texts)}


def test_p9_is_trained_on_whole_texts(spark):
    text = EASY * 100 + HARD
    docs = spark.createDataFrame([(1, text, "post")], "doc_id bigint, text string, kind string")
    ratings = spark.createDataFrame([(1, 1, "r", 3)], "rating_id bigint, doc_id bigint, rater string, band int")
    assert [r["text"] for r in reading_level.rated_sample(docs, ratings)] == [text] and len(text) > 6000
