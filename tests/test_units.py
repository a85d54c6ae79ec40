"""Golden vectors and edge cases that the tables do not hold."""

import pytest
from pyspark.sql import functions as F

from tessella.config import Config, resolve
from tessella.functions import text as T
from tessella.operators import budget as B
from tessella.operators import chunk as C
from tessella.operators import html as H
from tessella.operators import jsonx as J
from tessella.operators import render as R
from tessella.operators import sanitize as S
from tessella.operators import state as ST
from tessella.sources import resolve as SR


def one(spark, *columns, **given):
    df = spark.createDataFrame([tuple(given.values())], ", ".join(f"{k} {'string' if isinstance(v, (str, type(None))) else 'double'}" for k, v in given.items())) if given else spark.range(1)
    return df.select(*columns).first()


def test_config():
    assert resolve("x") == Config()
    assert resolve({"chunk_chars": -1, "cache_ttl_hours": 0, "cache_enabled": "no", "max_parts": 5}) == Config(cache_ttl_hours=0, max_parts=5)


@pytest.mark.parametrize("text,units,tokens", [("中文，ab", 5, 3), ("a😀b", 4, 2), ("", 0, 0), ("　", 1, 1)])
def test_units_and_tokens(spark, text, units, tokens):
    r = one(spark, T.units(F.col("t")).alias("u"), T.tokens(F.col("t")).alias("k"), t=text)
    assert (r.u, r.k) == (units, tokens)


def test_prefix_never_splits_a_character(spark):
    r = one(spark, *[T.prefix(F.col("t"), n).alias(f"p{n}") for n in range(1, 5)], t="a😀b")
    assert list(r) == ["a", "a", "a😀", "a😀b"]


def test_trim(spark):
    assert one(spark, T.trim(F.col("t")), t=" 　﻿ x \n")[0] == "x"


@pytest.mark.parametrize(
    "text,rates,mode,want",
    [
        ("兼容校准文本。" * 1000, B.Rates(80, 600), "deep", (1, 4800, 4000, 8800, 1.8)),
        ("字" * 10000, B.Rates(), "quick", (1, 6600, 2500, 9100, 1.5)),
        ("字" * 10000, B.Rates(), "deep", (3, 9800, 15000, 24800, 4.2)),
        ("字" * 10000, B.Rates(), "feynman", (4, 13400, 15000, 28400, 4.8)),
    ],
)
def test_estimates(spark, text, rates, mode, want):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = B.estimate_modes(df, rates=rates).where(F.col("mode") == mode).first()
    assert (r.calls, r.input_tokens, r.output_tokens, r.total_tokens, r.minutes) == want


@pytest.mark.parametrize("n", [0, 1, 6000, 6001, 9000, 9001, 30001, 400001])
def test_thresholds(spark, n):
    df = spark.createDataFrame([(1, "字" * n)], "doc_id long, text string")
    r = {x["mode"]: x for x in B.estimate_modes(df).collect()}
    parts = min(-(-min(n, 400000) // 6000), 20)
    assert r["deep"].calls == (parts + 1 if n > 9000 else 1) and r["book"].calls == max(1, parts) + 1
    assert r["quick"].input_tokens == -(-min(n, 30000) * 6 // 10) + 600


def brute_chunks(text, size):
    """The rule by a plain loop over characters."""
    import re

    out, cur = [], ""
    for p in filter(None, (x.strip() for x in re.split(r"\n{2,}|\r\n{2,}", text))):
        if len(p) > size:
            if cur:
                out.append(cur)
            while len(p) > size:
                ends = [k + 1 for k in range(size // 2 + 1, size) if p[k] in C.ENDS]
                k = ends[-1] if ends else size
                out.append(p[:k].strip())
                p = p[k:]
            cur = p.strip()
        elif cur and len(cur) + 2 + len(p) > size:
            out.append(cur)
            cur = p
        else:
            cur = f"{cur}\n\n{p}" if cur else p
    return out + ([cur] if cur else [])


def test_chunks(spark):
    import random

    rng = random.Random(0)
    texts = ["字" * 25, "a" * 10 + "。" + "b" * 14, "a" * 11 + "。" + "b" * 20, "ab\n\ncd\n\n\n" + "x" * 45 + "\n\nyz", "", None, " \n\n ", "x. " * 30]
    texts += ["".join(rng.choice(["ab", ". ", "\n\n", "。", "c" * 9, " ", "\n"]) for _ in range(rng.randrange(60))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    for r in df.select("i", C.split_chunks(F.col("text"), 20).alias("c")).collect():
        assert r.c == brute_chunks(texts[r.i] or "", 20), texts[r.i]


def test_cutting_stops_at_the_cap(spark):
    import random

    rng = random.Random(2)
    texts = ["字" * 400, "x. " * 300, "\n\n".join("a" * 15 for _ in range(60)), "ab"]
    texts += ["".join(rng.choice(["ab", ". ", "\n\n", "。", "c" * 9, " ", "\n", "d" * 50]) for _ in range(rng.randrange(90))) for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    for r in df.select("i", F.slice(C.split_chunks(F.col("text"), 20, 4), 1, 4).alias("c")).collect():
        assert r.c == brute_chunks(texts[r.i], 20)[:4], texts[r.i]


@pytest.mark.parametrize(
    "raw,want",
    [("&amp;lt;", "&lt;"), ("&#38;lt;", "&lt;"), ("&amp;#65;", "&#65;"), ("&#x1F600;&#65;", "😀A"), ("&bogus; &COPY;", "&bogus; ©"), ("&#0;&#x110000;&#xD800;", "&#0;&#x110000;&#xD800;"), ("&nbsp;", " "), ("&#X41;&#41A;&#abc;&#x;", "&#X41;)&#abc;&#x;"), ("a\ue000b&amp;\ue000", "a\ue000b&\ue000"), ("&#00000000000065;&#99999999999999999999;&a1;&;", "A&#99999999999999999999;&a1;&;"), ("x & y", "x & y")],
)
def test_entities(spark, raw, want):
    assert one(spark, H.decode_entities(F.col("t")), t=raw)[0] == want


def test_regions(spark):
    long = "x" * 201
    get = lambda html: one(spark, H.content_region(F.col("t")), t=html)[0]
    assert get(f'<body><div id="js_content"><div>{long}</div><div></div>y</div>z</body>') == f"<div>{long}</div><div></div>y"
    assert get(f"<article>{long[1:]}</article><main>{long}</main>") == long
    assert get(f"<body>b<article>{long[1:]}</article></body>") == f"b<article>{long[1:]}</article>"
    assert get("<p>bare") == "<p>bare"
    assert get(f"<article>{long}") == long
    assert get(f'<DIV class="a content b">{long}</DIV>') == long


def test_body_text(spark):
    html = '<body><script>x</script><h1>T</h1><p>a<br>b</p><ul><li>one<li>two</ul><img src="i" alt="pic"><nav>n</nav><table><tr><td>1</td><td>2</td></tr></table></body>'
    assert one(spark, H.body_text(F.col("t")), t=html)[0] == "T\n\na\nb\n\n- one\n- two\n[图：pic]\n1 2"


@pytest.mark.parametrize(
    "raw,want", [('{"a": 1}', "1"), ('```json\n{"a": 2,}\n```', "2"), ('say {"a": 3} ok', "3"), ('{"a": "x\ny"}', "x\ny"), ("[1, 2]", None), ("null", None), ("{broken", None), ("", None)]
)
def test_json(spark, raw, want):
    r = one(spark, F.try_variant_get(J.parse(F.col("t")), "$.a", "string").alias("a"), J.parse(F.col("t")).isNotNull().alias("ok"), t=raw)
    assert r.a == want and r.ok == (want is not None or raw in ("[1, 2]", "null"))


def test_repair_touches_strings_only(spark):
    assert one(spark, J.repair(F.col("t")), t='{\n"a\\"\tb": "c\r\n"}')[0] == '{\n"a\\"\\tb": "c\\r\\n"}'


def test_cap_comes_before_the_filter(spark):
    v = F.parse_json(F.lit('["", "", "", "", "", "", "", "", "", "", "late"]'))
    assert one(spark, S.records(v, S.ARGUMENTS))[0] == []
    assert one(spark, S.section(F.parse_json(F.lit("[1]")), "第 1 部分"))[0].title == "第 1 部分"


def test_hosts(spark):
    hosts = {"https://mp.weixin.qq.com/s": True, "https://MP.weixin.qq.com": True, "https://x.weixin.qq.com?a": True, "https://notweixin.qq.com": False, "https://mp.weixin.qq.com:80/": False, "mp.weixin.qq.com": False}
    for u, ok in hosts.items():
        assert one(spark, SR.allowed(F.col("t")), t=u)[0] is ok


def test_requests(spark):
    df = spark.createDataFrame([(1, '{"path": "a.exe"}'), (2, "{}"), (3, '{"text": "x", "batch": [{"text": "a", "url": 5}, 7, "s"]}'), (4, "no json")], "req_id long, raw string")
    got = {r.req_id: r for r in SR.route_source(SR.parse_requests(df)).collect()}
    assert got[1].error == "unsupported file type" and got[2].error == got[4].error == "nothing to analyse"
    assert got[3].error is None and [tuple(b) for b in got[3].batch] == [(None, None, None, "a", None)]


def test_text_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("# A\n\nb")
    (tmp_path / "b.html").write_text("<title>t</title><body><p>x &amp; y</p></body>")
    (tmp_path / "c.bin").write_text("z")
    got = {r.path[-5:]: r for r in SR.scan_files(spark, str(tmp_path)).collect()}
    assert got["/a.md"].text == "# A\n\nb" and got[".html"].text == "x & y" and got["c.bin"].error


def test_cache_limits(spark):
    now = F.expr("timestamp'2024-01-08 00:00:00'")
    rows = [(f"u{i:03d}", "t", "2024-01-07T00:00:00Z", i) for i in range(201)] + [("old", "t", "2024-01-01T00:00:00Z", 300), ("bad", "t", "x", 301), ("u005", "new", "2024-01-07T00:00:01Z", 302)]
    df = spark.createDataFrame(rows, "url string, text string, fetched_at string, seq long")
    got = {r.url: r.text for r in ST.cache_write(df.limit(0).select("url", "text", "fetched_at"), df, now).collect()}
    assert len(got) == 200 and "old" not in got and "bad" not in got and "u000" not in got and got["u005"] == "new"
    assert ST.cache_write(df.limit(0).select("url", "text", "fetched_at"), df, now, ttl_hours=0).count() == 0


def test_moving_average(spark):
    rows = [("k", 1, 10.0, 0.0), ("k", 2, 20.0, 10.0), ("k", 3, 30.0, 9999.0), ("k", 4, -1.0, 1.0), ("k", 5, float("nan"), 1.0)]
    r = ST.ewma(spark.createDataFrame(rows, "key string, seq long, rate double, latency double"), "key", "seq", "rate", "latency").first()
    assert r.rate == 15.600000000000001 and r.calls == 3 and r.latency == (800 * 0.8 + 50 * 0.2) * 0.8 + 5000 * 0.2


def test_memory_of_the_average_is_exact(spark):
    rows = [("k", i, float(i * 7919 % 101 + 1), 100.0) for i in range(1500)]
    want = None
    for _, _, v, _ in rows:
        want = v if want is None else want * 0.8 + v * 0.2
    assert ST.ewma(spark.createDataFrame(rows, "key string, seq long, rate double, latency double"), "key", "seq", "rate", "latency").first().rate == want


def test_map_tree_and_xml(spark):
    m = S.knowledge_map(F.parse_json(F.lit('{"title": "a<b", "coreQuestion": "q", "items": [{"type": "事实", "claim": "c", "evidence": "e"}, {"type": "数据", "claim": "hidden"}], "caveats": ["v"]}')))
    df = spark.range(1).select("id", m.alias("m")).select("id", "m.title", R.map_branches(F.col("m")).alias("branches"))
    nodes = {r.path: r.title for r in R.mind_tree(df, "id").collect()}
    assert nodes == {"": "a<b", "0": "核心问题", "0.0": "q", "1": "事实", "1.0": "c", "1.0.0": "证据：e", "2": "反对意见与局限", "2.0": "v"}
    assert '<node TEXT="a&lt;b">' in df.select(R.freemind(F.col("title"), F.col("branches"))).first()[0]


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([("A b/c", "# A", "<map/>", "<html/>")], "title string, md string, mm string, html string")
    paths = R.write_exports(df, str(tmp_path))
    assert {f: spark.read.text(p).first().value for f, p in paths.items()} == {"md": "# A", "mm": "<map/>", "html": "<html/>"}
    assert spark.read.text(paths["md"]).first()["name"] == "A-b-c"


def test_exports_beside_a_folder_that_cannot_be(spark, tmp_path):
    df = spark.createDataFrame([("a b", "# a")], "title string, md string")
    (tmp_path / "taken").write_text("a file")
    assert R.write_exports(df, str(tmp_path / "taken"), ("md",)) == {"md": f"{tmp_path}/taken-md"}
    assert (tmp_path / "taken-md" / "name=a-b").is_dir()
    got = R.write_exports(df, str(tmp_path / "taken" / "below" / "x"), ("md",), "old")
    assert set(got) == {"note"} and got["note"].startswith("old；" + R.EXPORT_FAILED)
