"""Archives read back, their files, and URL verdicts against plain versions."""

import gzip
import hashlib
import io
import random

import numpy as np

from vecspark.llm import bloom
from vecspark.llm.queries import RULES
from vecspark.llm.url_filter import judge
from vecspark.llm.warc import manifest, read_archives, records, write_archives


def pages(spark):
    draw = random.Random(1)
    same, other = "é" * 700, "z" * 1000
    rows = [(i, f"http://h{i}.com/", draw.choice([same, other, "s" * 999, f"own {i} " * 300, None, ""])) for i in range(90)]
    rows += [(7, "http://again", rows[7][2]), (95, None, same), (95, "http://x y\n", same), (None, "u", other), (96, "", "long" * 200_000)]
    return rows, spark.createDataFrame([(i, u, h, "x") for i, u, h in rows], "page_id long, url string, html string, row string").repartition(5)


def plain(rows):
    keeper, out, used = {}, [], set()
    for i, _, h in rows:
        if len((h or "").encode()) >= 1000 and i is not None:
            keeper[h] = max(keeper.get(h, i), i)
    for i, _, h in rows:
        b = (h or "").encode()
        first = keeper.get(h) if len([1 for r in rows if r[2] == h]) > 1 else None
        response = first is None or (first == i and h not in used)
        if first == i:
            used.add(h)
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "response" if response else "revisit", None if response else first))
    return sorted(out, key=repr)


def test_round_trip(spark, tmp_path):
    rows, df = pages(spark)
    sums = []
    for name in ("one", "two"):
        out = str(tmp_path / name)
        write_archives(df, out, roll_bytes=4000)
        assert sorted(map(tuple, read_archives(spark, out).collect()), key=repr) == plain(rows)
        files = manifest(spark, out).collect()
        assert len(files) > 3 and sum(f.records for f in files) == len(rows)
        for f in files:
            data = (tmp_path / name / f.name).read_bytes()
            assert len(data) == f.bytes and hashlib.sha256(data).hexdigest() == f.sha256
            found = list(records(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data)))))
            assert found[0][0]["WARC-Type"] == "warcinfo" and len(found) == f.records + 1
        assert not (tmp_path / name / "_temporary").exists()
        sums.append(sorted((f.name, f.sha256) for f in files))
    assert sums[0] == sums[1]


def test_stray_files_do_not_count(spark, tmp_path):
    out = str(tmp_path / "w")
    write_archives(spark.createDataFrame([(1, "u", "html")], "page_id long, url string, html string"), out)
    (tmp_path / "w" / "shard-000009-00000.warc.gz").write_bytes(b"left by a lost task")
    assert read_archives(spark, out).count() == 1
    write_archives(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "none"))
    assert read_archives(spark, str(tmp_path / "none")).count() == 0


def test_bloom(spark):
    draw = np.random.default_rng(3)
    keys = draw.integers(-2**63, 2**63 - 1, 5000)
    df = spark.createDataFrame([(int(k),) for k in keys] + [(None,)], "h long")
    for most in (1 << 27, 1 << 12):
        found = bloom.build(df, "h", max_bits=most)
        assert found.might_contain(keys).all() and len(found.words) * 64 <= most
    assert bloom.build(df, "h").might_contain(draw.integers(-2**63, 2**63 - 1, 20_000)).mean() < 0.02
    assert not bloom.build(df.limit(0), "h").might_contain(keys).any()


def test_urls(spark):
    urls = [None, "", "nothing", "http://", "http://com", "http://com/", "http://Example.COM/en/x", "https://www.example.com/en/?q=/", "http://a.www.example.com/en/",
            "http://example.com/en", "http://xexample.com/en/1", "ftp://shop.net/es/1", "http://net/fr/#a", "http://a.net/de/", "http://b.net?x=/es/", "x://y://z.com/a",
            "http://example.com.br/en/", "http://bücher.com/", "http://" + "a." * 3000 + "com/" + "p" * 5000, "http://host.org/en/"]
    rows = [(i, u) for i, u in enumerate(urls)] + [(3, urls[6]), (None, urls[6])]

    def one(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = path[:min([path.index(c) for c in "?#" if c in path], default=len(path))]
        fits = [(len(h + p), h + p, a) for h, p, a in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(max(fits)[1:] if fits else (None, "allow")))
    df = spark.createDataFrame([(i, u, "x") for i, u in rows], "page_id long, url string, verdict string")
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    assert sorted(map(tuple, judge(df, rules).collect()), key=repr) == sorted(((i, *one(u)) for i, u in rows), key=repr)
    assert {r.verdict for r in judge(df, rules.limit(0)).collect()} == {"allow"}
    assert judge(df.limit(0), rules).count() == 0
