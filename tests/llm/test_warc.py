import base64
import gzip
import hashlib
from collections import defaultdict

import pytest

from panelforge.llm.warc import assemble, parse_records, read_archives, roundtrip, write_archives
from tests.llm.conftest import none_first

LAST = (1 << 63) - 1


def by_brute_force(rows):
    first = defaultdict(lambda: LAST)
    for r in rows:
        key = r.html or ""
        first[key] = min(first[key], LAST if r.page_id is None else r.page_id)
    for r in rows:
        data = (r.html or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        me, best = LAST if r.page_id is None else r.page_id, first[r.html or ""]
        yield (r.page_id, len(data), digest, "response" if me == best else "revisit", None if me == best else best)


@pytest.fixture
def pages(spark, sf_dir):
    odd = [
        (9001, "http://a/\r\nb", "<p>x</p>\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n"),
        (9000, None, "<p>x</p>\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n"),
        (9002, "u", None),
        (9003, "u", ""),
        (9003, "u", ""),
        (None, "q", "zz"),
        (9004, "q", "zz"),
        (None, "q", ""),
        (None, "q", "nulls only"),
        (9005, "http://é/😀", "é\x00😀" * 10),
        (9006, "long", "x" * 300_000),
    ] + [(9100 + i, f"http://copy/{i}", "the same page") for i in range(50)]
    more = spark.createDataFrame(odd, "page_id long, url string, html string")
    real = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return real.unionByName(more).selectExpr("*", "1 AS type", "2 AS capture", "3 AS digest").cache()


def test_roundtrip(pages):
    got = roundtrip(pages)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert none_first(got.collect()) == none_first(by_brute_force(pages.collect()))


def test_captures_hold_what_was_written(spark, pages, tmp_path):
    path = str(tmp_path / "warc")
    write_archives(pages, path, file_bytes=50_000)
    files = sorted((tmp_path / "warc").glob("*.gz"))
    assert len(files) > 1
    rows = assemble(read_archives(spark, path)).collect()
    assert len(rows) == pages.count()
    want = {(r.page_id, r.url): r.html or "" for r in pages.collect() if "\n" not in (r.url or "")}
    for r in rows:
        key = (int(r.metadata.fields["pageid"]) if r.metadata.fields["pageid"] else None, r.response.uri)
        assert r.request.uri == r.response.uri and r.request.record_id != r.response.record_id
        if r.response.type == "response" and key in want:
            assert r.response.payload == want[key]
        if r.response.type == "revisit":
            assert r.response.payload is None and r.response.refers_to is not None


def test_records_follow_the_format(pages, tmp_path):
    path = str(tmp_path / "warc")
    write_archives(pages.filter("page_id >= 9000"), path)
    kinds = defaultdict(int)
    for f in (tmp_path / "warc").glob("*.gz"):
        data = gzip.decompress(f.read_bytes())
        for r in parse_records(data):
            kinds[r["head"]["warc-type"]] += 1
            assert r["head"]["warc-record-id"].startswith("<urn:uuid:") and "warc-date" in r["head"]
            if r["head"]["warc-type"] in ("request", "metadata"):
                assert r["head"]["warc-concurrent-to"].startswith("<urn:uuid:")
    assert kinds["request"] == kinds["metadata"] == kinds["response"] + kinds["revisit"]


def test_no_rows(spark):
    assert roundtrip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_damage_is_noticed(spark, pages, tmp_path):
    path = tmp_path / "warc"
    write_archives(pages.filter("page_id = 9006"), str(path))
    file = max(path.glob("*.gz"), key=lambda f: f.stat().st_size)
    file.write_bytes(gzip.compress(gzip.decompress(file.read_bytes()).replace(b"xxxx", b"xxyx", 1)))
    (path / f".{file.name}.crc").unlink(missing_ok=True)
    with pytest.raises(Exception, match="does not match its digest"):
        read_archives(spark, str(path)).count()


@pytest.mark.parametrize("kind", ["whole", "record", "mixed"])
def test_archives_of_many_members(spark, pages, tmp_path, kind):
    """One member per record, as other writers make them, or several records in some members: no record is lost."""
    written_to, path = tmp_path / "warc", tmp_path / "other"
    write_archives(pages, str(written_to))
    path.mkdir()
    for n, f in enumerate(sorted(written_to.glob("*.gz"))):
        data, cuts, at = gzip.decompress(f.read_bytes()), [0], 0
        for r in parse_records(data):
            at = data.index(b"\r\n\r\n", at) + 4 + len(r["block"]) + 4
            cuts.append(at)
        cuts = {"whole": [0, len(data)], "record": cuts, "mixed": [*cuts[:5], *cuts[5:-1:3], len(data)]}[kind]
        parts = [gzip.compress(data[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        (path / f"{n}.warc.gz").write_bytes(b"".join(parts) + (b"\0" * 7 if kind == "mixed" else b""))

    def rows(folder):
        return sorted((r.record_id, r.type, r.payload or "") for r in read_archives(spark, str(folder)).collect())

    assert rows(path) == rows(written_to) and len(rows(path)) == 3 * pages.count()


def test_a_cut_off_archive_is_noticed(spark, pages, tmp_path):
    path = tmp_path / "warc"
    write_archives(pages.filter("page_id = 9006"), str(path))
    file = max(path.glob("*.gz"), key=lambda f: f.stat().st_size)
    file.write_bytes(file.read_bytes()[:-20])
    (path / f".{file.name}.crc").unlink(missing_ok=True)
    with pytest.raises(Exception, match="ends inside"):
        read_archives(spark, str(path)).count()
