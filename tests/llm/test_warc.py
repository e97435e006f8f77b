from __future__ import annotations

import base64
import hashlib

import numpy as np
import pytest

from tapeworks.llm import warc


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'own' AS payload", "'own' AS ts", "'own' AS holder", "'own' AS value")


ROWS = [(i, f"http://www.{'ab'[i % 2]}.example.org/p{i % 5}?q={i % 3}", f"<p>{i % 7}\r\n\r\nWARC/1.1\r\n\r\n é</p>" * (i % 4)) for i in range(60)]
ROWS += [(100, None, None), (101, "", ""), (102, "http://x.org/a\r\nb", None), (103, "no scheme", "ü" * 50_000), (104, "http://x.org", "\r\n\r\n"), (None, "http://n.org/", "null id")]


def test_round_trip(spark):
    got = {r["page_id"]: r for r in warc.archive(pages(spark, ROWS)).collect()}
    assert len(got) == len(ROWS)
    holder: dict = {}
    for i, _, html in ROWS:
        holder[html or ""] = max(holder.get(html or "", -1), -1 if i is None else i)
    for i, _, html in ROWS:
        body = (html or "").encode()
        r = got[i]
        assert r["payload_bytes"] == len(body) and r["payload_digest"] == base64.b32encode(hashlib.sha1(body).digest()).decode()
        top = holder[html or ""]
        again = i is not None and i != top
        assert r["record_type"] == ("revisit" if again else "response") and r["refers_to"] == (top if again else None)


def test_least_size_of_shared_payloads(spark):
    got = warc.archive(pages(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")]), min_bytes=3).collect()
    assert {r["page_id"]: r["record_type"] for r in got} == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_index_is_in_global_order_and_addresses_records(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write_archive(warc.captures(pages(spark, ROWS * 2).repartition(4)), path)
    index = warc.merge_index(warc.read_archive(spark, path), rows_per_part=25).orderBy("part", "at").collect()
    keys = [(r["url_key"], r["ts"], r["page_id"] is not None, r["page_id"] or 0) for r in index]
    assert len(index) == 2 * len(ROWS) and keys == sorted(keys) and len({r["part"] for r in index}) > 2
    for r in index[::7]:
        with open(r["file"].removeprefix("file:"), "rb") as f:
            f.seek(r["offset"])
            fields, _, length, block = next(warc.parse_records(f.read(r["length"])))
        assert length == r["length"] and fields["warc-type"] == r["record_type"]
        if r["record_type"] == "response":
            assert hashlib.sha1(block[block.index(b"\r\n\r\n") + 4 :]).digest() == base64.b32decode(r["payload_digest"])


def test_loser_tree(spark):
    rng = np.random.default_rng(3)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted(rng.integers(0, 20, rng.integers(0, 30)).tolist()) for _ in range(k)]
        got = [(runs[r][p], r, p) for r, p in warc.loser_tree_merge(runs)]
        assert got == sorted((x, r, p) for r, run in enumerate(runs) for p, x in enumerate(run))


def test_damage_is_reported():
    record = b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert [b for *_, b in warc.parse_records(record * 2)] == [b"abc"] * 2
    for bad in (record[:-2], b"x" + record, record.replace(b"3", b"2")):
        with pytest.raises(ValueError):
            list(warc.parse_records(bad))


def test_empty_table(spark):
    assert warc.archive(pages(spark, []).limit(0)).collect() == []
