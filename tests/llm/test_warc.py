import base64
import hashlib

from polarity.llm import warc

PAGES = [(1, "http://a/x", "<p>é</p>"), (2, "http://a/y", "<p>é</p>"), (3, None, None), (4, "http://b/", ""), (5, "http://b/1", "body\r\n\r\nWARC/1.1\r\n\r\nmore\n\n"),
         (6, "http://b/2\r\nX: y", "x" * 200_000), (7, "http://c", "<p>é</p>"), (8, "http://c", "t\r\n"), (9, "http://c", "t\r\n\r\n"), (10, "http://d", "nul\x00   end")]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "k", 1) for r in rows], "page_id long, url string, html string, key string, master long")


def test_round_trip_and_revisits(spark, tmp_path):
    for least, dedup in ((0, lambda n: True), (100, lambda n: n >= 100)):
        path = f"{tmp_path}/{least}"
        warc.write_warc(pages(spark).repartition(3), path, least=least)
        rows = warc.assemble(warc.read_warc(spark, path)).collect()
        by = {r["metadata"]["fields"]["key"]: r for r in rows}
        payload = {i: (h or "").encode() for i, _, h in PAGES}
        assert len(rows) == len(PAGES) == len(by)
        for i, url, _ in PAGES:
            r = by[str(i)]
            master = max(k for k, p in payload.items() if p == payload[i])
            digest = base64.b32encode(hashlib.sha1(payload[i]).digest()).decode()
            assert r["response"]["digest"] == digest
            assert r["metadata"]["fields"]["payload-bytes"] == str(len(payload[i]))
            assert r["request"]["record_type"] == "request" and r["request"]["target_uri"] == " ".join((url or "").split())
            if dedup(len(payload[i])) and master != i:
                assert r["response"]["record_type"] == "revisit" and r["metadata"]["fields"]["refers-to-key"] == str(master)
            else:
                assert r["response"]["record_type"] == "response" and bytes(r["response"]["payload"]) == payload[i]
                assert r["response"]["payload_bytes"] == len(payload[i])


def captures(spark, rows, path):
    warc.write_warc(pages(spark, rows).repartition(2), path)
    out = []
    for r in warc.assemble(warc.read_warc(spark, path)).collect():
        f = r["metadata"]["fields"]
        out.append((f.get("key"), r["response"]["record_type"], f.get("refers-to-key"), r["response"]["payload"] and bytes(r["response"]["payload"]).decode()))
    return sorted(out, key=str)


def test_every_payload_is_stored_once_whatever_the_keys(spark, tmp_path):
    """Equal rows, one key with several payloads, ties of the largest key, and rows without a key."""
    assert captures(spark, [PAGES[0], PAGES[0]], f"{tmp_path}/a") == [("1", "response", None, "<p>é</p>"), ("1", "revisit", "1", None)]
    got = captures(spark, [(1, "u", "A"), (1, "u", "B"), (2, "u", "A")], f"{tmp_path}/b")
    assert got == [("1", "response", None, "B"), ("1", "revisit", "2", None), ("2", "response", None, "A")]
    got = captures(spark, [(None, "u", "A"), (None, "u", "A"), (5, "u", "A"), (5, "v", "A"), (None, None, None), (None, "w", "")], f"{tmp_path}/c")
    assert [g[1:3] for g in got if g[0] == "5"] in ([("response", None), ("revisit", "5")],) and [g[1:3] for g in got if g[0] is None and g[2]] == [("revisit", "5")] * 2
    assert sorted(g[1] for g in got if g[0] is None and not g[2]) == ["response", "revisit"]


def test_long_payloads_make_small_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "LARGE", 1000)
    monkeypatch.setattr(warc, "FILE_BYTES", 50_000)
    rows = [(i, "u", f"{i} " + "x" * (40 if i % 2 else 9000)) for i in range(60)]
    assert [g[3] for g in captures(spark, rows, f"{tmp_path}/w")] == [h for _, _, h in sorted(rows, key=lambda r: str((str(r[0]), "response", None, r[2])))]
    assert spark.read.format("binaryFile").load(f"{tmp_path}/w").count() > 8


def test_chains_of_any_length(spark):
    kinds = ["response", "request", *["metadata"] * 9]
    rows = [(f"{c}{k}", kinds[k], f"{c}{k - 1}" if k else None, None, None, None, None, {}) for c in "ab" for k in range(11)]
    df = spark.createDataFrame(rows, warc._READ_SQL)
    got = {r["capture_id"]: (r["request"]["record_id"], r["response"]["record_id"], r["metadata"]["record_id"]) for r in warc.assemble(df).collect()}
    assert got == {"a0": ("a1", "a0", "a10"), "b0": ("b1", "b0", "b10")}


def test_empty_table(spark, tmp_path):
    warc.write_warc(pages(spark, PAGES).filter("page_id < 0"), f"{tmp_path}/w")
    assert warc.assemble(warc.read_warc(spark, f"{tmp_path}/w")).collect() == []


def test_records_of_other_writers(spark):
    """One file without gzip, LF after the version, a record without links, chained links."""
    def record(kind, i, to, body):
        link = f"WARC-Concurrent-To: <urn:uuid:{to}>\r\n" if to else ""
        return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{i}>\r\n{link}Content-Length: {len(body)}\r\n\r\n{body}\r\n\r\n"
    data = "".join([record("warcinfo", "0", None, "software: x"), record("metadata", "m", "q", "a: 1\r\nb: 2"), record("request", "q", "r", "GET"), record("response", "r", None, "HTTP/1.1 200\r\n\r\nhi")])
    rows = [tuple(x) for x in warc._records(data.encode())]
    assert [h["warc-type"] for h, _ in rows] == ["warcinfo", "metadata", "request", "response"]
    assert rows[3][1].endswith(b"hi")
