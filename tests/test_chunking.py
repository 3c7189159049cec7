import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tarn.operators import chunking as K


def test_separator_leads_the_next_piece():
    got = K.split_text("甲" * 500 + "。" + "乙" * 300, 400, 40)
    assert [len(x) for x in got] == [400, 140, 301] and got[2][0] == "。"


def test_edges():
    assert K.split_text("", 400, 40) == []
    assert K.split_text("短文本", 400, 40) == ["短文本"]
    assert K.split_text("\n短文本\n", 400, 40) == ["短文本"]
    with pytest.raises(ValueError):
        K.split_text("x", 10, 11)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab。.\n 甲!", max_size=300), st.integers(5, 60))
def test_windows_fit_and_cover(text, size):
    got = K.split_text(text, size, size // 5)
    assert all(0 < len(x) <= size for x in got)
    assert set("".join(got)) >= {c for c in text if not c.isspace()}


def test_ids_run_over_pages(spark):
    pages = spark.createDataFrame([("d", 0, "甲" * 1300), ("d", 1, "乙" * 100), ("e", 0, None)], "doc_id string, page int, text string")
    c = K.chunk(pages).orderBy("doc_id", "child_ord").collect()
    assert [r.chunk_uid for r in c] == [f"d:c{i:05d}" for i in range(len(c))]
    assert c[-1].parent_id == "d:p0002" and c[-1].page == 1 and c[-1].text == "乙" * 100
    assert {r.doc_id for r in c} == {"d"}
    assert K.parents_of(K.chunk(pages)).count() == 3
