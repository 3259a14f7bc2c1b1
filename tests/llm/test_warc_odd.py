"""Archives of pages with null and repeated ids and clashing columns."""

from girthkit.llm import warc


def test_null_and_repeated_ids(spark):
    rows = [(None, "a"), (None, "a"), (4, "a"), (4, "a"), (2, "a"), (None, "b"), (None, "b"), (None, "c"), (7, None), (None, "")]
    pages = spark.createDataFrame([(i, "http://h/", h, "x") for i, h in rows], "page_id long, url string, html string, payload string")
    got = warc.archive(pages, 0, 256).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.payload_digest, []).append((r.page_id, r.record_type, r.refers_to))
    found = sorted((sorted(v, key=repr) for v in by.values()), key=lambda v: (-len(v), repr(v)))
    assert found[0] == [(2, "revisit", 4), (4, "response", None), (4, "response", None), (None, "revisit", 4), (None, "revisit", 4)]
    assert found[1:] == [[(7, "response", None), (None, "revisit", 7)], [(None, "response", None)] * 2, [(None, "response", None)]]
