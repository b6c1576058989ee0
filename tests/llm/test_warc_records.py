"""WARC records as other readers expect them: HTTP responses, revisits that name what they repeat, a warcinfo record on files."""

import http.client
import io

from groundshift.llm import warc


class _Wire:
    def __init__(self, data):
        self.data = data

    def makefile(self, *_):
        return io.BytesIO(self.data)


def _http(block):
    """Body and content type as the standard library reads them."""
    answer = http.client.HTTPResponse(_Wire(block))
    answer.begin()
    return answer.read(), answer.getheader("Content-Type")


def test_records_are_http_responses(spark):
    rows = [(1, "http://a/x", "same é\r\n\r\nbody"), (2, "http://b/y\nz", "same é\r\n\r\nbody"), (3, None, ""), (4, "http://d/", None), (5, "http://e/", "HTTP/1.1 404 no\r\n\r\n")]
    archives = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(1))
    seen = {}
    for bundle in archives.collect():
        for e in bundle["entries"]:
            head, block, _ = warc.parse_record(warc.read_frame(bytes(bundle["content"]), e["frame"]), e["offset"])
            seen[e["page_id"]] = head, block
    assert seen[1][0]["WARC-Type"] == "revisit" and seen[1][0]["WARC-Refers-To-Target-URI"] == "http://b/y%0Az" and seen[1][0]["WARC-Refers-To"] == warc.record_id(2)
    assert seen[3][0]["WARC-Type"] == "revisit" and seen[3][0]["WARC-Refers-To-Target-URI"] == "http://d/" and "WARC-Target-URI" not in seen[3][0]
    for i, want in ((2, rows[1][2]), (4, ""), (5, rows[4][2])):
        head, block = seen[i]
        assert head["Content-Type"] == "application/http; msgtype=response" and _http(block) == (want.encode(), "text/html; charset=utf-8")
    assert warc.http_payload(seen[1][1]) == b""
    by_record = {r["page_id"]: bytes(r["payload"]).decode() for r in warc.read_payloads(archives, record_ids=[warc.record_id(2), warc.record_id(5), "none"]).collect()}
    assert by_record == {2: rows[1][2], 5: rows[4][2]}
    assert warc.read_payloads(archives, [77]).count() == 0


def test_files_may_start_with_their_warcinfo(spark, tmp_path):
    import zstandard

    rows = [(i, f"http://h/{i}", f"text {i} " * 30) for i in range(40)]
    archives = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), frame_bytes=1000)
    for r in warc.export_files(archives, str(tmp_path), warcinfo=True).collect():
        data = open(r["path"], "rb").read()
        plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
        head, block, at = warc.parse_record(plain, 0)
        assert head["WARC-Type"] == "warcinfo" and head["WARC-Filename"] == r["path"].rsplit("/", 1)[1] and b"software" in block
        n = 0
        while at < len(plain):
            head, block, at = warc.parse_record(plain, at)
            i = int(head["X-Page-ID"])
            assert head["WARC-Type"] == "response" and _http(block)[0].decode() == rows[i][2]
            n += 1
        bundle = next(b for b in archives.collect() if b["bundle_id"] in r["path"])
        assert n == len(bundle["entries"])
        for e in bundle["entries"]:
            head, _, _ = warc.parse_record(warc.read_frame(data, e["frame"] + 1), e["offset"])
            assert int(head["X-Page-ID"]) == e["page_id"]
