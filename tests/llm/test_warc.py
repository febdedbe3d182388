import base64
import gzip
import hashlib
import os

from pyspark.sql import functions as F

from weftgraph.llm.warc import base32_of_hex, coalesced, parse_record, read_records, record_bytes, write_archives


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").select("*", F.lit(1).alias("digest"), F.lit("x").alias("key"), F.lit(0).alias("offset")).repartition(3)


def test_round_trip(spark, tmp_path):
    rows = [(i, f"http://x/{i}", "same" if i % 3 == 0 else f"<p>é {i}</p>\r\n\r\nWARC/1.1") for i in range(30)]
    rows += [(100, "u\r\nX: y", None), (101, None, ""), (102, "u", "z" * 300_000), (103, "u", "twice"), (103, "v", "twice"), (None, "w", "no id"), (None, "w", "same")]
    folder = f"file://{tmp_path}/w"
    index = write_archives(pages(spark, rows), folder)
    got = read_records(index, folder).collect()
    latest = {}
    for p, _, h in rows:
        key = h or ""
        latest[key] = max(latest.get(key, -1), -1 if p is None else p)
    assert len(got) == len(rows)
    seen = {}
    for r in got:
        seen.setdefault(r["page_id"], []).append(r)
    for p, url, h in rows:
        data = (h or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        mine = [r for r in seen[p] if r["payload_digest"] == digest]
        for r in mine:
            assert r["payload_bytes"] == len(data)
            if r["record_type"] == "response":
                assert r["payload"] == data and r["refers_to"] is None
            else:
                assert r["payload"] is None and r["refers_to"] == (latest[h or ""] if latest[h or ""] >= 0 else None)
        wanted = 1 if (latest[h or ""] == (-1 if p is None else p)) else 0
        assert sum(r["record_type"] == "response" for r in mine) == wanted
    some = index.where("page_id in (3, 7, 102)")
    assert sorted(r["page_id"] for r in read_records(some, folder).collect()) == [3, 7, 102]
    name = next(f for f in os.listdir(tmp_path / "w") if f.endswith(".warc.gz"))
    whole = gzip.open(tmp_path / "w" / name).read()  # members one after the other are one file
    assert whole.startswith(b"WARC/1.1\r\n") and whole.count(b"WARC-Record-ID") == index.where(F.col("file") == name).count()
    assert base32_of_hex is not None and spark.range(1).select(base32_of_hex(F.sha1(F.lit("abc")))).first()[0] == base64.b32encode(hashlib.sha1(b"abc").digest()).decode()


def test_small_payloads_and_empty_tables(spark, tmp_path):
    df = pages(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")])
    index = write_archives(df, f"file://{tmp_path}/w", 4)
    assert {r["page_id"]: r["record_type"] for r in index.collect()} == {1: "response", 2: "response", 3: "revisit", 4: "response"}
    empty = write_archives(df.where("false"), f"file://{tmp_path}/e")
    assert empty.count() == 0 and read_records(empty, f"file://{tmp_path}/e").count() == 0


def test_damage_is_noticed():
    raw = record_bytes(1, "u", base64.b32encode(hashlib.sha1(b"abc").digest()).decode(), b"abc", 3, None)
    assert parse_record(raw)[0] == 1
    for bad in (raw.replace(b"abc\r\n\r\n", b"abd\r\n\r\n"), b"HTTP/1.1 200"):
        try:
            parse_record(bad)
        except ValueError:
            continue
        raise AssertionError(bad)


def test_ranges_are_joined():
    ranges = [("a", 0, 10), ("a", 12, 5), ("a", 500, 10), ("b", 0, 4), ("b", 4, 200)]
    assert list(coalesced(ranges, 16, 100)) == [("a", 0, 17, [(0, 10), (12, 5)]), ("a", 500, 10, [(0, 10)]), ("b", 0, 4, [(0, 4)]), ("b", 4, 200, [(0, 200)])]
