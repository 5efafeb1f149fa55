"""Spans of a document whose row is repeated."""

from attestry.llm import substring


def test_repeated_rows_do_not_multiply_spans(spark):
    text = " ".join(f"w{i}" for i in range(80))
    longest = []
    for rows in (2, 40):
        docs = spark.createDataFrame([(1, text)] * rows + [(None, text)] * rows, "doc_id long, text string")
        lists = substring._span_lists(substring.repeated_spans(docs)).collect()
        assert len(lists) == 2 and all(len(set(r["__spans"])) == len(r["__spans"]) for r in lists)
        longest.append(max(len(r["__spans"]) for r in lists))
        assert {r.n_removed for r in substring.remove_repeats(docs).collect()} == {80}
    assert longest[0] == longest[1]
