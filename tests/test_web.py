"""The page source against a server of its own, and discovery on small relations."""

import http.server
import threading

import pytest

from pagewright.operators.parse import parse_pages
from pagewright.sources.web import WebPages, discovered


class Site(http.server.BaseHTTPRequestHandler):
    def do_GET(self):
        status = 404 if self.path == "/gone" else 302 if self.path == "/old" else 200
        self.send_response(status)
        self.send_header("Content-Type", "text/plain" if self.path == "/text" else "text/html; charset=utf-8")
        self.send_header("X-Frame-Options", "DENY")
        self.send_header("Link", '<https://ex.com/c>; rel="canonical"')
        if status == 302:
            self.send_header("Location", "/")
        self.end_headers()
        self.wfile.write("<title>Größe</title>".encode())

    def log_message(self, *args):
        pass


@pytest.fixture
def site():
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_pages_of_a_server(spark, site):
    spark.dataSource.register(WebPages)
    urls = [f"{site}/", f"{site}/gone", f"{site}/text", f"{site}/old", "http://127.0.0.1:1/none"]
    raw = spark.read.format("web_pages").option("urls", " ".join(urls)).option("batch", 2).load()
    got = {r.ord: r for r in raw.collect()}
    assert [got[i].url for i in range(5)] == urls and [got[i].status_code for i in range(5)] == [200, 404, 200, 200, 0]
    assert got[0].html == "<title>Größe</title>" and got[1].html is got[2].html is None and got[4].error
    assert got[0].security_headers == {"x-frame-options": "DENY"} and got[0].http_link_canonical == "https://ex.com/c" and got[3].final_url == urls[0]
    assert {r.title for r in parse_pages(raw.filter("html IS NOT NULL")).collect()} == {"Größe"}
    assert spark.read.format("web_pages").load().count() == 0


def test_discovery(spark):
    frame = lambda rows: spark.createDataFrame(rows, "domain string, url string, ord int")
    roots = spark.createDataFrame([("https://a",), ("https://b/",), ("https://c",)], "domain string")
    maps = frame([("https://a", "https://a/2", 0), ("https://a", "https://a/1", 1), ("https://a", "https://a/2", 2)])
    links = frame([("https://a", "https://a/x", 0), ("https://b", "https://b/", 0), ("https://b", "https://b/y#z", 1), ("https://b", "https://other/", 2)])
    got = [tuple(r) for r in discovered(roots, maps, links, 3).orderBy("domain", "place").collect()]
    assert got == [("https://a", "https://a", 1), ("https://a", "https://a/2", 2), ("https://a", "https://a/1", 3), ("https://b", "https://b/", 1), ("https://b", "https://b/y", 2), ("https://c", "https://c", 1)]
