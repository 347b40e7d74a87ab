import hashlib
import random

import pytest

from cutweave.llm.warc import MAGIC, archive_round_trip, read_warc, write_warc

SCHEMA = "page_id long, url string, html string, digest string, at int"


def brute(rows):
    head = {}
    for i, _, h in rows:
        if len((h or "").encode()) >= 1000 and i is not None:
            head[h] = max(head.get(h, i), i)
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        to = head.get(h)
        to = to if to is not None and to != i else None
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "response" if to is None else "revisit", to))
    return sorted(out, key=str)


def pages():
    rng = random.Random(3)
    fake = MAGIC + "WARC-Type: response\r\nX-Page-ID: 666\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    rows = [(i, f"http://h/{i}\r\nX-Evil: 1", "".join(rng.choice("abü \r\n") for _ in range(rng.randint(0, 3000)))) for i in range(120)]
    rows += [(200 + i, "u", fake * i) for i in range(6)]
    rows += [(300 + i, "u", "x" + MAGIC * (i + 1) + "tail") for i in range(4)]
    rows += [(400, "u", MAGIC + "Content-Length: 999999\r\n\r\n" + "y" * 50), (401, "u", "z" * 200_000 + fake + "z" * 200_000), (402, None, None), (403, "u", "")]
    rows += [(410, "u", "W"), (411, "u", MAGIC[:-1]), (412, "u", "\r\n\r\n" + fake), (413, "u", "b" * 999), (414, "u", "b" * 999)]
    rows += [(500 + i, "u", "copy " * 300) for i in range(40)] + [(None, "u", "copy " * 300), (539, "u", "copy " * 300), (None, "u", "n" * 2000)]
    return rows


@pytest.mark.parametrize(("parts", "split"), [(1, "100000"), (3, "900"), (7, "128m")])
def test_round_trip(spark, parts, split):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        rows = pages()
        df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(parts)
        got = sorted((tuple(r) for r in archive_round_trip(df).collect()), key=str)
        assert got == brute(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_splits_may_change_between_scans(spark, tmp_path):
    """The result is planned under one split size and worked out under another, as when executors come and go."""
    rows, key = pages(), "spark.sql.files.maxPartitionBytes"
    write_warc(spark.createDataFrame([(*r, "", 1) for r in rows], SCHEMA).repartition(2), str(tmp_path / "w"))
    old = spark.conf.get(key)
    try:
        spark.conf.set(key, "128m")
        read = read_warc(spark, str(tmp_path / "w"))
        spark.conf.set(key, "700")
        got = read.collect()
    finally:
        spark.conf.set(key, old)
    assert len(got) == len(rows)
    assert sorted(r.stated for r in got) == sorted(hashlib.sha1((h or "").encode()).hexdigest() for *_, h in rows)
    assert all(r.digest == r.stated for r in got if r.type == "response")


def test_archive_bytes_are_a_chain(spark, tmp_path):
    rows = pages()
    write_warc(spark.createDataFrame([(*r, "", 1) for r in rows], SCHEMA).coalesce(1), str(tmp_path / "w"))
    (part,) = [p for p in (tmp_path / "w").glob("part-*")]
    data, at, n = part.read_bytes(), 0, 0
    while at < len(data):
        assert data.startswith(MAGIC.encode(), at)
        head, _, _ = data[at:].partition(b"\r\n\r\n")
        length = int(next(x for x in head.split(b"\r\n") if x.startswith(b"Content-Length")).split(b":")[1])
        at += len(head) + 4 + length
        assert data[at : at + 4] == b"\r\n\r\n"
        at, n = at + 4, n + 1
    assert n == len(rows)
    assert read_warc(spark, str(tmp_path / "w")).count() == n


def test_empty(spark):
    assert archive_round_trip(spark.createDataFrame([], SCHEMA)).count() == 0
