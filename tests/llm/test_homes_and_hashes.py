"""Homes spread whatever the ids look like; windows are told apart by two hashes, also those made to collide; pages with awkward tags."""

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import html_extraction, lm_scoring, substring_dedup
from tidemark.llm.homes import home_column, home_of
from tidemark.llm.tokens import words_of


def test_both_forms_of_a_home_agree(spark):
    ids = [0, 1, -5, 400, 1 << 62, -(1 << 63), (1 << 63) - 1, *range(0, 4000, 400)]
    df = spark.createDataFrame([(i, i * 7 % 1000 - 500) for i in ids], "d long, print long").select("d", "print", home_column(97, F.col("d"), F.col("print")).alias("home"))
    rows = df.collect()
    assert [r.home for r in rows] == home_of(97, np.array([r.d for r in rows]), np.array([r["print"] for r in rows])).tolist()


def test_strides_and_missing_ids_fill_the_homes(spark):
    for ids in (F.col("id") * 400, F.col("id") * 2_147_483_647, F.lit(None).cast("long")):
        df = spark.range(20_000).select(ids.alias("d"), F.xxhash64(F.concat(F.lit("text "), F.col("id"))).alias("print"))
        sizes = [r["count"] for r in df.groupBy(home_column(400, F.col("d"), F.col("print"))).count().collect()]
        assert len(sizes) == 400 and max(sizes) < 100


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_words_made_to_collide_are_told_apart(spark):
    one = thue_morse(2048)
    other = one.translate(str.maketrans("ab", "ba"))
    data = f"{one} {other}".encode()
    words = words_of(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    assert len(set(words.hashes().tolist())) == 1  # the polynomial alone takes them for one
    for hashes in words.strong_hashes():
        assert len(set(hashes.tolist())) == 2
    rest = " ".join(f"w{i}" for i in range(19))
    df = spark.createDataFrame([(1, f"{one} {rest}"), (2, f"{other} {rest}"), (3, f"{one} {rest} end")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(df).collect()} == {1: 0, 2: 0, 3: 20}


def test_second_windows_are_independent():
    rng = np.random.default_rng(1)
    text = " ".join(f"w{i}" for i in rng.integers(0, 50, 4000)).encode()
    words = words_of(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    first, second = words.strong_hashes()
    h, of, at = words.windows(first, 20)
    g = words.second_windows(second, of, at, 20)
    assert len(set(h.tolist())) == len(set(g.tolist())) == len(h)
    assert abs(np.corrcoef((h >> np.uint64(40)).astype(float), (g >> np.uint64(40)).astype(float))[0, 1]) < 0.06


def test_dedup_and_scores_of_many_missing_ids(spark):
    shared = " ".join(f"s{i}" for i in range(25))
    rows = [(None, f"own{i} {shared} tail{i}") for i in range(40)] + [(None, "short")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = substring_dedup.remove_repeats(df).collect()
    assert len(got) == 43 and sorted(r.n_removed for r in got) == [0] * 4 + [25] * 39
    scored = lm_scoring.lm_scores(df).collect()
    assert len(scored) == 43 and {r.train_tokens for r in scored} == {28 * 40 + 6}


P = "<p>The old bridge over the river was closed in March, and engineers have worked on the new one since then. It opens today.</p>"
LINE = "The old bridge over the river was closed in March, and engineers have worked on the new one since then. It opens today."


def texts(*pages):
    return html_extraction.main_texts(list(pages), html_extraction.content_model())


def test_a_slash_ends_only_void_and_foreign_elements():
    script, nested, links, svg = texts(
        f"<body><div class=article><script src=/js/>var tracker = 1;</script>{P}</div></body>",
        f"<body><div class=article><div data-u=/p/>first line here, a sentence.</div>{P * 2}</div><footer>Copyright</footer></body>",
        f"<body><ul class=menu><li><a href=/x/>Home</a><li><a href=/y/>World</a></ul><article>{P * 2}</article></body>",
        f'<body><article>{P}<svg viewBox="0 0 1 1"><title/><path d="M0 0"/><script/></svg>{P}</article></body>',
    )
    assert script == LINE
    assert nested == f"first line here, a sentence.\n{LINE}\n{LINE}"
    assert links == f"{LINE}\n{LINE}"
    assert svg == f"{LINE}\n{LINE}"


def test_cdata_is_a_comment_up_to_the_first_end():
    unclosed, closed, cut = texts(f"<body><article>{P}<![CDATA[unfinished tail</p>{P}</article>", f"<body><article>{P}<p>Now <![CDATA[a > b]]> we know more, and all is well.</p></article>", f"<body><article>{P}<![CDATA[never ended")
    assert unclosed == f"{LINE}\n{LINE}"
    assert closed == f"{LINE}\nNow b]]> we know more, and all is well."
    assert cut == LINE


def test_titles_and_leads_stay():
    pages = {
        f'<html><head><title>t</title></head><body><div class="article"><h1>New bridge</h1><h2>By the river</h2>{P * 3}</div></body></html>': ["New bridge", "By the river"],
        f'<html><head><title>t</title></head><body><div class="article"><h1>New bridge</h1><div class="lead">Lead line of the story about the bridge.</div>{P * 3}</div></body></html>': ["New bridge", "Lead line of the story about the bridge."],
        f'<body><header class="site-header"><h1>Daily News</h1></header><nav><a href=/x/>Home</a></nav><article><h1>Council votes</h1>{P * 2}</article><footer>Copyright 2020 Daily News</footer></body>': ["Council votes"],
        f"<body><main><h1>Short</h1><p>One.</p><div>A bare lead sentence of the story.</div>{P * 2}</main><aside class=sidebar><h3>Related</h3><ul><li><a href=/1>One</a></ul></aside></body>": ["Short", "One.", "A bare lead sentence of the story."],
        f'<body><div id="content"><h1>Title of the piece</h1><div class="intro">An introduction, short.</div>{P}</div></body>': ["Title of the piece", "An introduction, short."],
    }
    for text, lines in zip(texts(*pages), pages.values()):
        assert [x for x in text.split("\n") if x != LINE] == lines


def test_an_input_text_column_is_replaced(spark):
    df = spark.createDataFrame([(1, f"<article>{P}</article>", "old", 5)], "page_id long, html string, text string, n_chars int")
    row = html_extraction.extract_text(df).first()
    assert row.text == LINE and row.n_chars == 5


def test_a_hot_line_and_many_missing_ids(spark, monkeypatch):
    """A line of every document is dealt to shares; rows without an id each lose their own lines, whatever the others hold."""
    from tidemark.llm import hot, line_dedup

    monkeypatch.setattr(hot, "LEAST_SHARE", 8)
    hot_line = "a line that everyone has"
    rows = [(i, f"{hot_line}\nonly in document {i} and nowhere else") for i in range(200)]
    rows += [(None, f"{hot_line}\nwithout an id, number {i} here\nonly in document {i} and nowhere else") for i in range(30)]
    rows += [(5, f"{hot_line}\nthe same id with another text")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    keys = line_dedup.line_keys(df)
    most, n = hot.most_of(keys, "h1", "h2")
    assert most == 231 and -(-most // max(8, n // (4 * 4))) > 1
    got = line_dedup.dedup_lines(df).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id == 0:
            assert r.n_dropped == 0
        elif r.doc_id is None:
            assert r.n_dropped == 2 and r.text.startswith("without an id, number") and "\n" not in r.text
        else:
            assert r.n_dropped == 1 and hot_line not in r.text


def test_parts_of_buckets_give_the_same_repeats(spark, monkeypatch):
    """With buckets merged in parts first, as a corpus of very many blocks has them."""
    rows = [(i, " ".join(f"w{(i * 7 + j) % 50 if i % 3 else j}" for j in range(40 + i))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    plain = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in substring_dedup.remove_repeats(df).collect()}
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", 300)
    monkeypatch.setattr(substring_dedup, "BLOCKS_OF_GROUP", 12)
    assert sum(len(t) for _, t in rows) > 2 * 300 * 12
    assert {r.doc_id: (r.n_words, r.n_removed, r.text) for r in substring_dedup.remove_repeats(df).collect()} == plain
    assert any(r[1] for r in plain.values())
