"""Evidence of language identification that bounds used to cut."""

from tidemark.llm import language_id


def test_declared_anywhere_in_the_page():
    tag = '<html class="x" lang="pt-BR"><body>x</body></html>'
    for before in ("<!-- " + "licence " * 1000 + "-->", "\n" * 5000, "<script>" + "x=1;" * 2000 + "</script>", "<html>" * 1000):
        assert language_id.declared(before + tag) == "pt"
    assert language_id.declared("<!-- <html lang=de> -->" + " " * 5000 + tag) == "pt"
    assert language_id.declared("<!-- no end " + tag) == "pt" and language_id.declared("<html " + "a" * 9000) == ""
    assert language_id.declared("<!--" * 200_000) == "" and language_id.declared(None) == ""


def coded(spark, rows):
    return spark.createDataFrame(rows, "declared string, text_lang int")


def test_every_declared_pair_counts(spark):
    """1,400 tags, each seen in two languages: none is cut."""
    tags = [a + b + c for a in "abcdefgh" for b in "abcdefghijklmnopqrstuvwxyz"[:25] for c in "abcdefg"]
    rows = [(t, 0) for t in tags for _ in range(2)] + [(t, 1) for t in tags]
    got = {r.declared: r.likely for r in language_id._declared_odds(coded(spark, rows), 2).collect()}
    assert len(tags) == 1400 and set(got) == set(tags)
    assert all(v == [2.5 / (2800 + 700), 1.5 / (1400 + 700)] for v in got.values())


def test_every_suffix_of_a_deep_host(spark):
    """Blogs of one page each under de.blogs.example.com and en.blogs.example.com, five labels deep:
    a page without evidence of its own takes the language of the four labels above it."""
    docs = spark.createDataFrame(
        [(i, t, g) for i, (t, g) in enumerate([("der fluss und langsam", "de"), ("the river and slow", "en")] * 40)],
        "doc_id long, text string, lang string",
    )
    rows = []
    for g, text in (("de", "der fluss und langsam"), ("en", "the river and slow")):
        rows += [(f"{g}{i}", f"https://u{i}.{g}.blogs.example.com/", f"<p>{text} {text}</p>") for i in range(30)]
        rows.append((f"{g} none", f"https://none.{g}.blogs.example.com/", "<p></p>"))
    pages = spark.createDataFrame(rows, "page_id string, url string, html string")
    got = {r.page_id: r for r in language_id.identify(pages, docs).collect()}
    assert len(got) == len(rows)
    for g in ("de", "en"):
        assert got[f"{g} none"].lang == g and got[f"{g} none"].confidence > 0.7
