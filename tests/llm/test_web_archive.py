"""Archives and their index: round trips, revisits, damaged records, merges against sorting, odd rows and the SQL."""

import gzip
import hashlib
import random

import duckdb
import pytest

SMALL = "/root/testdata/sf0.001"
LONG = "<p>the same page in many places</p>" * 40
ROWS = [(1, "http://a.org/x?q=1#top", LONG), (7, "https://A.org/x?q=1", LONG), (3, None, LONG), (None, "http://a.org/x", LONG), (7, "https://A.org/x?q=1", LONG), (4, " ", None), (5, "no scheme here", ""), (6, "http://b.a.org", "short"), (8, "http://b.a.org", "short"), (9, "http://c/é\r\nX: y", "é" * 5000 + "\r\n\r\nWARC/1.1\r\n\r\n"), (-2, "http://a.org", LONG)]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(i, u, h, "z") for i, u, h in ROWS], "page_id long, url string, html string, payload string").repartition(3)


def test_loser_merge():
    from stratalake.llm.web_archive import loser_merge

    rng = random.Random(3)
    for _ in range(300):
        runs = [sorted(rng.randint(0, 9) for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(0, 9))]
        got = list(loser_merge(runs))
        assert got == sorted(((r, k) for r, run in enumerate(runs) for k in range(len(run))), key=lambda x: (runs[x[0]][x[1]], x[0], x[1]))


def test_records():
    from stratalake.llm.web_archive import ArchiveError, members, page_record, read_capture, read_record, url_key

    assert url_key("HTTP://WWW.Example.ORG/Path?x#y") == "org,example,www)/Path?x" and url_key("a b") == ")a b" and url_key("x://h?q") == "h)?q"
    warc = page_record(5, "http://e.org/", "2001-01-01T00:00:00.000001Z", b"abc", None) + page_record(4, "http://e.org/", "2001-01-01T00:00:00.5Z", b"abc", 5)
    found = [read_capture(*read_record(content)) for _, _, content in members(warc, step=7)]
    assert [f[2:] for f in found] == [(5, "http://e.org/", 3, hashlib.sha1(b"abc").hexdigest(), "response", None), (4, "http://e.org/", 3, hashlib.sha1(b"abc").hexdigest(), "revisit", 5)]
    assert found[0][1] == 978307200_000001
    content = gzip.decompress(warc)
    for bad in (content[:-1], content.replace(b"abc", b"abd", 1), content.replace(b"WARC/1.1", b"WARC/0.9", 1), content.replace(b"Content-Length: ", b"Content-Length: 9", 1)):
        first = bad[: bad.index(b"WARC/1.1", 9)] if b"WARC/1.1" in bad[9:] else bad
        with pytest.raises(ArchiveError):
            read_capture(*read_record(first if first != content[: len(first)] else bad))
    with pytest.raises(ArchiveError):
        list(members(warc[:-3]))


def test_pages(spark, pages):
    from stratalake.llm.web_archive import archive_pages, capture_digests

    rows = archive_pages(pages).collect()
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=str)
    wanted = []
    for i, _, h in ROWS:
        raw = (h or "").encode()
        older = h == LONG and i != 7
        wanted.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if older else "response", 7 if older else None))
    assert got == sorted(wanted, key=str)
    by_place = sorted(rows, key=lambda r: r.place)
    assert [r.place for r in by_place] == list(range(1, len(ROWS) + 1))
    order = [(r.url_key, r.captured, r.page_id is not None, r.page_id or 0) for r in by_place]
    assert order == sorted(order)
    assert next(r.url for r in rows if r.page_id == 9) == "http://c/é%0D%0AX:%20y" and next(r.url for r in rows if r.page_id == 3) == "about:blank"
    assert capture_digests(pages.where("false")).count() == 0


def test_small_archives_runs_and_ranges(spark):
    from stratalake.llm.common import materialize
    from stratalake.llm.web_archive import capture_runs, merge_runs, save_archives, with_referents, write_archives

    pages = spark.range(500).selectExpr("id AS page_id", "concat('http://h', id % 3, '.org/', id % 7) AS url", "repeat(cast(id % 50 AS string), 600) AS html")
    rows, _ = with_referents(pages)
    archives = write_archives(rows, archive_bytes=3000)
    assert archives.count() > 20
    merged = merge_runs(materialize(capture_runs(archives, run_rows=9)), range_rows=40).collect()
    assert len({r.part for r in merged}) > 5
    merged.sort(key=lambda r: (r.part, r.seq))
    keys = [(r.url_key, r.captured, r.page_id) for r in merged]
    assert keys == sorted(keys) and len(set(keys)) == 500
    for r in merged:
        newest = 450 + r.page_id % 50
        big = r.page_id % 50 >= 10
        assert (r.record_type, r.refers_to) == (("revisit", newest) if big and r.page_id != newest else ("response", None))


def test_files(spark, pages, tmp_path):
    from stratalake.llm.web_archive import members, save_archives, with_referents, write_archives

    saved = save_archives(write_archives(with_referents(pages)[0]), f"file://{tmp_path}/warc").collect()
    assert sum(b"WARC-Type: re" in content for r in saved for _, _, content in members(open(r.path, "rb").read())) == len(ROWS)
    assert all(r.bytes == len(open(r.path, "rb").read()) for r in saved)


def test_sql(spark):
    from stratalake.llm.queries import oracle_sql, queries

    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SMALL}/pages.parquet'")
    df = queries()["op12_warc"](spark, SMALL)
    plain = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    assert plain(df.collect()) == plain(con.execute(f"SELECT {', '.join(df.columns)} FROM ({oracle_sql()['op12_warc']})").fetchall())
