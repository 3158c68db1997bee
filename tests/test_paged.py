"""The paged source over files and over a local web server, against a plain walk of the pages."""

import datetime as dt
import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from sortilege.sources import paged, payloads


def item(n):
    return {"id": n, "slug": f"{n}-2", "date": "2026-04-03T10:00:00", "link": f"l{n}", "acf": {"draw_date": "04/03/2026", "lotto_winning_numbers": {"number_1": n % 36, "number_2": "7"}}}


def listing(folder, n, per_page=10, end=None):
    pages = [[item(i) for i in range(a, min(n, a + per_page))] for a in range(0, n, per_page)] + ([end] if end is not None else [])
    folder.mkdir(parents=True, exist_ok=True)
    for k, p in enumerate(pages, 1):
        (folder / f"{k}.json").write_text(json.dumps(p))
    return f"{folder}/{{page}}.json"


@pytest.mark.parametrize("n", [0, 3, 10, 11, 95, 100, 333])
@pytest.mark.parametrize("end", [None, [], {"code": paged.PAST_END}])
def test_last_page(tmp_path, n, end):
    """As many partitions as a walk reads pages, found with few reads."""
    at, reads = listing(tmp_path, n, end=end), []
    one = paged.Listing(at, 10)
    plain = one.page
    one.page = lambda k, *a: (reads.append(k), plain(k, *a))[1]
    got = paged.Reader({"at": at, "per_page": "10"})
    got.listing = one
    want = n // 10 + 1
    assert [p.number for p in got.partitions()] == list(range(1, want + 1)) and len(reads) <= 2 * want.bit_length() + 2


def test_same_records_as_saved_pages(spark, tmp_path):
    at = listing(tmp_path / "a", 57)
    rows = paged.read(spark, at, per_page=10)
    assert rows.rdd.getNumPartitions() == 6
    want = payloads.records(payloads.items(spark, str(tmp_path / "a" / "*.json")), "lotto", "w")
    got = payloads.records(paged.items(rows), "lotto", "w")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 57
    assert paged.read(spark, at, per_page=10, max_pages=2).count() == 20 and paged.failures(rows).count() == 0


def test_a_bad_page_fails_alone(spark, tmp_path):
    at = listing(tmp_path, 57)
    (tmp_path / "1.json").write_text("[{")
    (tmp_path / "4.json").write_text("<html>")
    (tmp_path / "5.json").write_text(json.dumps({"code": "rest_no_route", "message": "gone"}))
    rows = paged.read(spark, at, per_page=10)
    assert {r.page for r in paged.failures(rows).collect()} == {1, 4, 5}
    assert sorted(r.id for r in paged.items(rows).collect()) == [*range(10, 30), *range(50, 57)]
    assert "rest_no_route: gone" in {r.error for r in paged.failures(rows).collect()}


def test_all_pages_bad(spark, tmp_path):
    for k in range(1, 9):
        (tmp_path / f"{k}.json").write_text("no")
    assert paged.failures(paged.read(spark, f"{tmp_path}/{{page}}.json")).count() == 1


def test_windows(spark, tmp_path):
    for k, n in enumerate((25, 0, 10)):
        listing(tmp_path / str(dt.date(2026, 1, 1) + dt.timedelta(7 * k)), n)
    rows = paged.read(spark, f"{tmp_path}/{{after}}/{{page}}.json", per_page=10, start="2026-01-01", end="2026-01-20")
    assert rows.rdd.getNumPartitions() == 3
    got = [(r.after, r.page) for r in rows.filter("error IS NULL").collect()]
    assert {x: got.count(x) for x in got} == {(dt.date(2026, 1, 1), 1): 10, (dt.date(2026, 1, 1), 2): 10, (dt.date(2026, 1, 1), 3): 5, (dt.date(2026, 1, 15), 1): 10}


def test_over_http(spark):
    """A server of 42 items, which refuses pages past the end, and one page by an error."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            page = int(parse_qs(urlparse(self.path).query)["page"][0])
            found = [item(i) for i in range(42)][10 * page - 10 : 10 * page]
            self.send_response(500 if page == 2 else 200 if found else 400)
            self.end_headers()
            self.wfile.write(b"oops" if page == 2 else json.dumps(found or {"code": paged.PAST_END}).encode())

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        rows = paged.read(spark, f"http://127.0.0.1:{server.server_port}/posts?page={{page}}&per_page=10", per_page=10, tries=2).collect()
    finally:
        server.shutdown()
    assert sorted(r.id for r in rows if r.error is None) == [*range(10), *range(20, 42)]
    assert [(r.page, r.error) for r in rows if r.error] == [(2, "HTTPError: HTTP Error 500: Internal Server Error")]


def test_written_pages_come_back(spark, tmp_path):
    made = spark.range(1, 26).selectExpr("id", "id nth", "cast((id - 1) div 10 + 1 as int) page", "concat(id, '-1') slug", "'2026-04-03' date", "'l' link", "to_json(named_struct('draw_date', '20260403', 'lotto_winning_numbers', named_struct('number_1', id))) acf", "'x' game")
    paged.write_pages(made, str(tmp_path / "p"), "game")
    rows = paged.read(spark, f"{tmp_path}/p/game=x/page={{page}}", per_page=10)
    got = payloads.records(paged.items(rows), "lotto", "w").collect()
    assert sorted((r.draw_number, r.numbers, str(r.draw_date)) for r in got) == [(i, [i], "2026-04-03") for i in range(1, 26)]
    assert sorted({(r.page, r.id) for r in rows.collect()}) == [((i - 1) // 10 + 1, i) for i in range(1, 26)]


def test_long_listings_have_few_partitions(spark, tmp_path):
    """Every page of a long listing is read once, a bad one fails alone within its stretch, and the partitions stay few."""
    at = listing(tmp_path, 1503, per_page=5)
    (tmp_path / "50.json").write_text("[{")
    rows = paged.read(spark, at, per_page=5)
    assert rows.rdd.getNumPartitions() <= paged.MOST_PARTITIONS
    assert [(r.page, r.id) for r in paged.items(rows.withColumn("slug", F.col("page").cast("string"))).selectExpr("int(slug) page", "id").orderBy("id").collect()] == [(i // 5 + 1, i) for i in range(1503) if i // 5 != 49]
    assert [r.page for r in paged.failures(rows).collect()] == [50]
