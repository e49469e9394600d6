import hashlib

import pytest
from llm_cases import fetch, rows_of, sentence

from ledgerlens.llm import warc
from ledgerlens.llm.queries import op5_warc
from ledgerlens.llm.storage import filesystem, new_folder


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


def expected(rows, least=0):
    groups = {}
    for page_id, _, html in rows:
        groups.setdefault((html or "").encode(), []).append(page_id)
    out, seen = [], set()
    for page_id, _, html in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        payload = (html or "").encode()
        ids = [i for i in groups[payload] if i is not None]
        refers = None
        if len(payload) >= least and len(groups[payload]) > 1 and ids:
            refers = max(ids)
            if page_id == refers and (page_id, payload) not in seen:
                refers = None
        seen.add((page_id, payload))
        out.append((page_id, len(payload), warc.digest(payload), "response" if refers is None else "revisit", refers))
    return sorted(out, key=repr)


EDGE_PAGES = [
    (1, "https://a.example/", "<p>x</p>"),
    (2, "https://b.example/ü?q=\r\nX-Bad: 1", "<p>x</p>"),
    (3, None, "<p>x</p>"),
    (4, "", None),
    (5, "u", ""),
    (6, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\n"),
    (7, "u", "😀 日本語\r\n\r\n" + sentence(1, 50_000, 9000)),
    (8, "u", "alone"),
    (8, "u", "alone"),  # a repeated row
    (8, "v", "same id, other payload"),
    (None, "u", "<p>x</p>"),
    (None, "u", "only without id"),
    (None, "u", "only without id"),
]


def test_whole_table(spark):
    got = op5_warc(spark, "/root/testdata/sf0.001")
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert rows_of(got) == expected(fetch("pages", "page_id, url, html"))


def test_edge_rows(spark):
    assert rows_of(warc.round_trip(pages(spark, EDGE_PAGES).repartition(5))) == expected(EDGE_PAGES)


def test_large_group_of_copies(spark):
    rows = [(i, f"u{i}", "same" if i % 3 else f"own {i}") for i in range(300)]
    got = warc.round_trip(pages(spark, rows).repartition(4))
    assert rows_of(got) == expected(rows) and {r.refers_to for r in got.collect()} == {None, 299}


def test_files_are_rolled_and_deterministic(spark):
    rows = [(i, f"http://h/{i}", sentence(i, 300, 5000)) for i in range(200)]
    sums = []
    for split in (3, 7):  # the input's partitions do not matter
        folder = new_folder(spark, "warc-test")
        manifest = warc.write_warc(pages(spark, rows).repartition(split).coalesce(1), folder, file_bytes=20_000).collect()
        assert len(manifest) > 5 and sum(m.records for m in manifest) == 200
        for m in manifest:
            store, path = filesystem(f"{folder}/{m.file}")
            with store.open_input_stream(path, compression=None) as f:
                content = f.read()
            assert hashlib.sha1(content).hexdigest() == m.sha1 and len(content) == m.bytes
            assert len(list(warc.read_records(content))) == m.records
        sums.append(sorted(m.sha1 for m in manifest))
        assert rows_of(warc.read_warc(spark, folder)) == expected(rows)
    assert sums[0] == sums[1]


def test_only_files_in_the_manifest_count(spark):
    folder = new_folder(spark, "warc-test")
    warc.write_warc(pages(spark, EDGE_PAGES), folder)
    before = rows_of(warc.read_warc(spark, folder))
    import gzip

    warc.commit_file(folder, "part-999999-000000.warc.gz", gzip.compress(warc.make_record(99, "u", b"stray", None, 0)))
    assert rows_of(warc.read_warc(spark, folder)) == before


def test_damage_is_reported():
    import gzip

    record = warc.make_record(1, "u", b"payload", None, 0)
    assert [warc.parse_record(*r)[0] for r in warc.read_records(gzip.compress(record))] == [1]
    with pytest.raises(ValueError):
        list(warc.read_records(gzip.compress(record.replace(b"payload", b"changed"))))


def test_threshold_empty_table_and_clashing_columns(spark):
    folder = new_folder(spark, "warc-test")
    warc.write_warc(pages(spark, EDGE_PAGES), folder, least=5)
    assert rows_of(warc.read_warc(spark, folder)) == expected(EDGE_PAGES, 5)
    assert warc.round_trip(pages(spark, [])).collect() == []
    more = pages(spark, EDGE_PAGES).selectExpr("*", "1 AS sha1", "2 AS refers_to", "3 AS payload")
    assert rows_of(warc.round_trip(more)) == expected(EDGE_PAGES)


def test_one_page_id_spreads_over_tasks(spark, tmp_path):
    """Rows of a null id and of one repeated id, most with payloads of their own, some repeated."""
    rows = [(None if i % 2 else 7, f"http://a/{i}", f"payload {i // 2 % 900}") for i in range(4000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(6)
    folder = str(tmp_path / "warc")
    merge = "spark.sql.adaptive.coalescePartitions.enabled"  # would join ranges as small as these
    spark.conf.set(merge, False)
    try:
        manifest = warc.write_warc(pages, folder, file_bytes=1 << 12)
    finally:
        spark.conf.unset(merge)
    assert manifest.select("part").distinct().count() > 2
    got = warc.read_warc(spark, folder).collect()
    assert len(got) == len(rows)
    # of each payload one record of id 7 is the response, all others (the null id's too) refer to it
    assert sum(r.record_type == "response" for r in got) == 900
    assert all(r.page_id == 7 for r in got if r.record_type == "response")
    assert all(r.refers_to == 7 for r in got if r.record_type == "revisit")
