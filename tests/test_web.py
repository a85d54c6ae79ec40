"""Fetching of pages: pacing, retries, refusals, and plain HTTP against a local server."""

import http.server
import threading

import pytest

from tessella.providers import FetchError, HttpFetcher, ScriptedFetcher
from tessella.sources import web


def page(title, text):
    return 200, "html", f"<html><title>{title}</title><body><p>{text}</p></body></html>"


WALL = page("wait", "请完成验证")
ANSWERS = {
    ("https://a.io/1", "service"): page("One", "first text"), ("https://a.io/2", "browser"): page("Two", "Two is in here"), ("https://a.io/4", "service"): (503, "html", "x"), ("https://a.io/5", "service"): page("", " "),
    ("https://a.io/6", "service"): WALL, ("https://a.io/6", "browser"): page("", "real text"), ("https://a.io/7", "service"): WALL, ("https://a.io/7", "browser"): WALL, ("https://a.io/8", "service"): WALL,
    ("https://a.io/9", "service"): (200, "text", "plain"), ("https://a.io/10", "service"): (204, "image", "\x00"), ("https://a.io/11", "service"): page("long", "请完成验证" + "x" * 5000),
}


def test_every_outcome(spark):
    rows = [(i, f"https://a.io/{i}") for i in range(1, 12)] + [(20, "https://b.io/1"), (21, None), (22, "https://a.io/1")]
    df = spark.createDataFrame(rows, "req int, url string").repartition(3)
    got = {r.req: r for r in web.fetch_pages(df, ScriptedFetcher(ANSWERS), lambda u: u.startswith("https://a.io/"), tasks=3).collect()}
    assert len(got) == len(rows)
    plain = {k: (r.status, r.agent, r.calls, r.retried, r.title, r.text, r.error) for k, r in got.items()}
    one = (200, "service", 1, False, "One", "One\n\nfirst text", None)
    assert plain[1] == plain[22] == one
    assert plain[2] == (200, "browser", 2, False, "Two", "Two is in here", None)
    assert plain[3] == (None, None, 2, False, None, None, "网页抓取失败：service is down")
    assert plain[4] == (503, "service", 1, False, None, None, "网页返回状态码 503，抓取失败")
    assert plain[5][-1] == plain[10][-1] == web.EMPTY
    assert plain[6] == (200, "browser", 2, True, "wait", "wait\n\nreal text", None)
    assert plain[7] == (200, "service", 2, True, "wait", "wait\n\n请完成验证", None) == plain[8]
    assert plain[9] == (200, "service", 1, False, "", "plain", None)
    assert plain[11][3] is False and plain[11][-1] is None
    assert plain[20] == plain[21] == (None, None, None, None, None, None, "host not allowed")


def test_an_empty_table(spark):
    assert web.fetch_pages(spark.createDataFrame([], "req int, url string"), ScriptedFetcher({})).count() == 0


def test_pacer_keeps_hosts_apart():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    p = web.Pacer(2.0, lambda: now[0], sleep)
    for host in ("a", "b", "a", "a", "b"):
        p.wait(host)
    assert slept == [2.0, 2.0] and now[0] == 4.0
    web.Pacer(0.0, lambda: 1 / 0).wait("a")


def test_lanes_share_a_hosts_rate(spark):
    """20 links of one host at 20 a second in 4 lanes: no lane calls faster than 5 a second."""
    import time

    df = spark.createDataFrame([(i, f"https://a.io/{i}") for i in range(20)], "req int, url string")
    answers = {(f"https://a.io/{i}", "service"): page("t", "text") for i in range(20)}
    began = time.monotonic()
    out = web.fetch_pages(df, ScriptedFetcher(answers), lambda u: u.isNotNull(), per_second=20.0, lanes=4, tasks=4)
    assert out.where("error is null").count() == 20 and time.monotonic() - began >= 4 * 0.2


class Handler(http.server.BaseHTTPRequestHandler):
    def do_GET(self):
        if self.path == "/moved":
            self.send_response(302)
            self.send_header("Location", "/page")
            self.end_headers()
            return
        status, kind, body = {"/page": (200, "text/html; charset=gbk", "<title>标题</title>正文".encode("gbk")), "/gone": (404, "text/plain", b"no")}.get(self.path, (200, "text/plain; charset=none", b"by " + self.headers["User-Agent"][:8].encode()))
        self.send_response(status)
        self.send_header("Content-Type", kind)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *a):
        pass


@pytest.fixture(scope="module")
def server():
    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_plain_http(server):
    f = HttpFetcher(timeout=5)
    assert f.fetch(f"{server}/moved", "service") == (200, "html", "<title>标题</title>正文")
    assert f.fetch(f"{server}/gone", "service") == (404, "text", "no")
    assert f.fetch(f"{server}/who", "browser") == (200, "text", "by Mozilla/")
    for url in ("http://127.0.0.1:1/", "nonsense", "ftp:/x"):
        with pytest.raises(FetchError):
            f.fetch(url, "service")


def test_plain_http_through_the_stages(spark, server):
    df = spark.createDataFrame([(1, f"{server}/page"), (2, f"{server}/gone"), (3, "http://127.0.0.1:1/x")], "req int, url string")
    got = {r.req: r for r in web.fetch_pages(df, HttpFetcher(timeout=5), lambda u: u.isNotNull(), tasks=2).collect()}
    assert (got[1].title, got[1].text) == ("标题", "标题 正文") or got[1].text.endswith("正文")
    assert "404" in got[2].error and got[3].error.startswith("网页抓取失败：")
