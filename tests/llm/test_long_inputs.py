"""Very long, hostile and unlucky inputs: right results, and time in proportion to length."""

import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat, common, embedding_dedup, exact_dedup, language_id, pii
from tidemark.llm.common import materialise


def seconds(run):
    began = time.perf_counter()
    out = run()
    return time.perf_counter() - began, out


def test_numbers_of_any_length():
    zeros, nines = "0" * 5000 + "1.2.3.4", "9" * 5000 + ".2.3.4"
    assert pii.find(zeros)[0] == [(0, 1, len(zeros))] and not [s for s in pii.find(nines)[0] if s[1] == 1]


def test_disguises_in_bulk():
    text = "write to jane.doe (at) example (dot) com or 10 . 0 . 0 . 7 now\n"
    took, (base, every) = seconds(lambda: pii.find(text * 8000))
    assert took < 30 and not base and len(every) == 16_000
    one = [k for _, k, _ in pii.find(text)[1]]
    assert one == [0, 1] and every[2][0] == every[0][0] + len(text)


@pytest.mark.parametrize("sign", ["<!--", "<", "<html ", "<nav", "<script>", "</nav ", "-->", "<nav x>"])
def test_a_page_of_one_sign(sign):
    page = sign * (1_000_000 // len(sign)) + "end"
    took, text = seconds(lambda: language_id.visible(page))
    assert took < 5 and text.endswith("end")
    took, found = seconds(lambda: language_id.declared(page))
    assert took < 5 and found == ""


def test_what_is_shown():
    page = "<p>a<!-- b > c -->d<SCRIPT x='1'>if (a<b) {}</script >e<nav>f<b>g</NAV>h <style>i<!--j</style>k<br/>l &amp; m < n"
    assert language_id.visible(page) == "a d e h k l & m < n"
    assert language_id.visible("x <!-- y <b>z</b>") == "x z" and language_id.visible("<nav>never closed") == "never closed"
    assert language_id.declared(" " * 10_000 + "<!-- <html lang=de> --><html class='a' lang='FR-be'>") == "fr"


def test_a_conversation_of_10_000_turns(spark):
    rows = spark.range(10_000).select(
        F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
        F.concat(F.lit("text ### "), F.col("id")).alias("text"),
    )
    out = materialise(chat.format_chats(rows))
    took, got = seconds(lambda: out.select(chat.masked(F.col("formatted"), F.col("layout"))).head()[0])
    assert got == "".join(f"text ### {i}" for i in range(1, 10_000, 2)) and took < 10
    r = out.head()
    assert [r.formatted[s.start : s.end].replace("\\", "") for s in r.loss[:3]] == ["text ### 1", "text ### 3", "text ### 5"]


def test_the_largest_id_is_an_id(spark):
    top = (1 << 63) - 1
    out = exact_dedup.exact_dedup(spark.createDataFrame([(top, "a"), (None, "a "), (None, "c")], "doc_id long, text string"))
    assert {(r.doc_id, r.keep_id, r.kept) for r in out.collect()} == {(top, None, False), (None, None, True)}
    out = exact_dedup.exact_dedup(spark.createDataFrame([(top, "a"), (None, "a")], "doc_id long, text string"))
    assert {(r.doc_id, r.keep_id) for r in out.collect()} == {(top, top), (None, top)}


def test_many_unrelated_vectors_of_one_label(spark):
    """Where splitting cells would only lend, rows are sent once for each chunk of the label."""
    n = 20_000
    rng = np.random.default_rng(10)
    points = rng.normal(size=(n, 64)).astype(np.float32)
    points[1::10] = points[::10] + rng.normal(size=(n // 10, 64)).astype(np.float32) * 0.02
    rows = [(i, v.tolist(), 1) for i, v in enumerate(points)]
    df = materialise(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(8))
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_dedup(df, cell=4096).collect()}
    unit = points.astype(np.float64)
    unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    links = []
    for at in range(0, n, 2000):
        i, j = np.nonzero(unit[at : at + 2000] @ unit.T >= 0.98)
        links += [(at + int(a), int(b)) for a, b in zip(i, j, strict=True) if at + a != b]
    count = np.bincount([a for a, _ in links], minlength=n)
    assert count.sum() >= n // 10 and [got[i][0] for i in range(n)] == count.tolist()
    assert all(got[a][1] == got[b][1] for a, b in links) and len({c for _, c in got.values()}) == n - len(links) // 2


def test_lending_decides_about_a_round(spark):
    rng = np.random.default_rng(11)
    spread = rng.normal(size=(3000, 64))
    tight = rng.normal(size=(30, 64))[rng.integers(0, 30, 3000)] + rng.normal(size=(3000, 64)) * 0.005
    rows = [(label, 0, i, 1, v.tolist(), True, i.to_bytes(8, "little") + label.encode()) for label, m in (("a", spread), ("b", tight)) for i, v in enumerate(m)]
    frame = materialise(spark.createDataFrame(rows, embedding_dedup._ROWS.replace("rep long, n long", "rep long, n long")))
    big = frame.groupBy("label", "cell").agg(F.count(F.lit(1)).alias("size"))
    worth = embedding_dedup._worth(frame, big, 0.2, 64)
    assert [r.label for r in worth.collect()] == ["b"]


def test_long_texts_come_in_small_batches(spark):
    """Texts of 1 MB: no task is handed tens of megabytes at once, and none is lost."""
    docs = spark.range(0, 40, 1, 1).select("id", F.repeat(F.lit("x"), 1 << 20).alias("text"))

    def sizes(parts):
        for part in parts:
            yield pa.RecordBatch.from_arrays([pa.array([part.nbytes]), pa.array([part.num_rows])], names=["size", "n"])

    got = common.arrow_map(docs, sizes, "size long, n long").collect()
    assert sum(r.n for r in got) == 40 and max(r.size for r in got) <= 6 << 20
