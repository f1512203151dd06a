"""The corpus pipeline against a brute-force version of its stages."""

import corpus_pipeline
import pytest
from test_table_ops import _lines_to_drop, _near, _words
from test_text_ops import _tiktoken

from posttrain.llm import decontaminate, language_id

SF = "/root/testdata/sf0.001"


def _brute(rows):
    """Documents after language ID, line dedup and near dedup."""
    rows = [(i, t) for i, t in rows if language_id.has_letter(t)]
    drop = _lines_to_drop(rows)
    rows = [(i, "\n".join(x for k, x in enumerate(t.split("\n")) if k not in drop[i]) if i in drop else t) for i, t in rows]
    rows = [(i, t) for i, t in rows if i not in drop or _words(t)]
    _, component = _near(rows, 5, 80)
    return {i: t for i, t in rows if component[i] == i}


def test_pipeline_equals_brute_force(spark, duck):
    kept = _brute(duck.execute("SELECT doc_id, text FROM documents").fetchall())
    items = [decontaminate.normal(t) for _, t in duck.execute("SELECT * FROM benchmark").fetchall()]
    rows = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(rows) <= set(kept)
    own = _tiktoken()
    for i, t in kept.items():
        text = decontaminate.normal(t)
        if i in rows:
            assert rows[i]["ids"] == own.encode_ordinary(t) and not any(x in text for x in items)
        else:  # it holds an item within the edit limit
            assert any(decontaminate.align(x, text, int(0.2 * len(x))) for x in items)


def test_stages_take_odd_documents(spark):
    line = "a line of text that is repeated in two documents"
    rows = [(1, None, "en", None, None), (2, "", None, "s", 0), (3, "123 456", "en", "s", 7), (4, "A text of its own.\n" + line, "en", "s", 1),
            (5, line + "\nand more of it here", "en", "s", 9), (6, line, None, None, 48), (6, line, None, None, 48), (None, "no id but words", "en", "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == names, name
    got = sorted(((r["doc_id"] or 0), r["text"], r["n_chars"]) for r in docs.collect())
    assert got == [(0, "no id but words", 3), (4, "A text of its own.\n" + line, 1), (5, "and more of it here", 19)]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 3


@pytest.mark.parametrize("k", range(5))
def test_stages_take_empty_tables(spark, k):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.STAGES[k][1](spark, docs, SF).count() == 0
