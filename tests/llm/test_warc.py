import gzip
import hashlib
import io

import pytest

from vaultlake.llm import warc

SCHEMA = "page_id long, url string, html string"


def brute(rows):
    groups = {}
    for i, _, h in rows:
        data = (h or "").encode()
        if len(data) >= 1000 and i is not None:
            groups[data] = max(i, groups.get(data, i))
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        first = groups.get(data)
        again = first is not None and first != i
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def test_round_trip(spark, tmp_path):
    big, edge = "<p>é漢</p>" * 400, "x" * 1000
    rows = [(i, f"http://h/{i}", big) for i in range(40)] + [(100 + i, None, edge) for i in range(3)] + [(200 + i, "u\r\nWARC-Type: x", "y" * 999) for i in range(3)]
    rows += [(300, "a", None), (301, "a", ""), (302, "a", "\r\n\r\nWARC/1.1\r\n\r\n" * 90), (39, "again", big), (None, "n", big), (None, "n", "only null " * 200), (303, "z", "long " * 400_000)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as payload", "2 as n", "3 as first")
    manifest = warc.write_archives(df, str(tmp_path / "out"), archive_bytes=2_000)
    assert manifest.agg({"records": "sum"}).first()[0] == len(rows) and manifest.count() > 4
    got = warc.read_archives(manifest, keep_payload=True).collect()
    assert sorted(((x["page_id"], x["payload_bytes"], x["payload_digest"], x["record_type"], x["refers_to"]) for x in got), key=str) == brute(rows)
    html = {(i, h) for i, _, h in rows}
    for x in got:
        assert (x["payload"] is None) == (x["record_type"] == "revisit")
        if x["payload"] is not None:
            assert (x["page_id"], x["payload"].decode()) in html or not x["payload"]
    # each file is plain gzip, readable as a whole
    path = manifest.first()["path"]
    assert gzip.open(path).read().count(b"WARC/1.1\r\nWARC-Type") >= 1


def test_no_pages(spark, tmp_path):
    manifest = warc.write_archives(spark.createDataFrame([], SCHEMA), str(tmp_path / "none"))
    assert warc.read_archives(manifest).count() == 0


@pytest.mark.parametrize("piece", [1, 7, 1 << 16])
def test_reader_takes_any_piece_size(piece):
    data = b"".join(warc.record(i, f"u{i}", b"pay\r\n\r\nload" * i, "response", None) for i in range(20))
    got = list(warc.read_records(io.BytesIO(data), True, piece))
    assert [(x[0], x[6]) for x in got] == [(i, b"pay\r\n\r\nload" * i) for i in range(20)]


def test_damage_is_noticed():
    import zlib

    member = warc.record(1, "u", b"payload" * 50, "response", None)
    plain = zlib.decompress(member, 31)
    pack = lambda x: gzip.compress(x)
    for wrong in (member[:-20], pack(plain.replace(b"payload" * 2, b"PAYLOAD" * 2, 1)), pack(plain + b"x"), pack(plain[:-4]), pack(b"no" + plain), pack(plain.replace(b"Content-Length: ", b"Content-Length: 9", 1))):
        with pytest.raises((ValueError, zlib.error)):
            list(warc.read_records(io.BytesIO(wrong)))
