import gzip
import uuid
from pathlib import Path

import pytest

from terraloom.llm import warc

SCHEMA = "html string, page_id bigint, url string, shard int"


def run(spark, tmp_path, rows, **sizes):
    folder = f"file://{tmp_path}/{uuid.uuid4().hex}"
    warc.write_archives(spark.createDataFrame([(h, i, u, 5) for i, u, h in rows], SCHEMA).repartition(3), folder, **sizes)
    return folder, warc.read_archives(spark, folder).collect()


def brute(rows, least):
    best = {}
    for i, _, h in rows:
        if i is not None:
            best[h or ""] = max(best.get(h or "", i), i)
    out, used = [], set()
    for i, u, h in rows:
        h = h or ""
        response = len(h.encode()) < least or (i == best.get(h) and (i, h) not in used)
        used.add((i, h))
        out.append((i, u, len(h.encode()), warc.base32_sha1(h.encode()), "response" if response else "revisit", None if response else best.get(h), h if response else None))
    return sorted(out, key=repr)


ROWS = [(i, f"http://peta.example/{i}", f"<p>halaman {i % 7}</p>" * 50) for i in range(60)] + [
    (100, None, None), (101, "http://x/%0A\n", ""), (102, "", "é\r\n\r\n𝄞"), (103, "u", "x" * 300000), (104, "v", "x" * 300000), (104, "v", "x" * 300000), (None, "n", "only"), (None, "n", "x" * 300000)]


@pytest.mark.parametrize("least,sizes", [(0, {"roll_bytes": 500, "shard_bytes": 2000}), (0, {}), (1000, {"roll_bytes": 1})])
def test_round_trip(spark, tmp_path, least, sizes):
    _, got = run(spark, tmp_path, ROWS, min_revisit_bytes=least, **sizes)
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "html"]
    assert sorted((tuple(r[n] for n in names) for r in got), key=repr) == brute(ROWS, least)


def test_the_same_bytes_again_and_no_leftovers(spark, tmp_path):
    a, _ = run(spark, tmp_path, ROWS, roll_bytes=3000)
    b, _ = run(spark, tmp_path, ROWS[::-1], roll_bytes=3000)
    files = [{p.name: p.read_bytes() for p in Path(x.removeprefix("file://"), "data").glob("shard*")} for x in (a, b)]
    assert files[0] == files[1] and len(files[0]) > 2
    assert not list(Path(a.removeprefix("file://"), "_temporary").iterdir())
    text = gzip.decompress(next(iter(files[0].values())))
    assert text.startswith(b"WARC/1.0\r\nWARC-Type: re") and text.endswith(b"\r\n\r\n")


def test_a_hot_id_is_spread(spark, tmp_path):
    rows = [(i, f"u{i}", f"{i}" * 40) for i in range(100)] + [(None, f"n{i % 3}", f"hot {i % 200} " * 40) for i in range(400)] + [
        (50, "same", "the same page")] * 100
    folder, got = run(spark, tmp_path, rows, shard_bytes=5000)
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "html"]
    want = sorted((w[0], w[2:], ) for w in brute(rows, 0) if w[0] is not None)
    assert sorted((r["page_id"], tuple(r[n] for n in names[2:])) for r in got if r["page_id"] is not None) == want
    assert sum(r["record_type"] == "response" for r in got if r["page_id"] is None) == 200 and len(got) == 600
    files = spark.read.parquet(f"{folder}/manifest").collect()
    assert max(f["n_records"] for f in files) <= 150 and len(files) > 8


def test_files_outside_the_manifest_are_not_read(spark, tmp_path):
    folder, got = run(spark, tmp_path, ROWS[:5])
    Path(folder.removeprefix("file://"), "data", "shard-9999999-00000.warc.gz").write_bytes(b"of an attempt that was lost")
    assert warc.read_archives(spark, folder).count() == len(got)


def test_a_changed_file_is_an_error(spark, tmp_path):
    folder, _ = run(spark, tmp_path, ROWS[:5])
    for p in Path(folder.removeprefix("file://"), "data").glob("shard*"):
        p.with_name(f".{p.name}.crc").unlink(missing_ok=True)
        p.write_bytes(p.read_bytes()[:-9])
    with pytest.raises(Exception, match="manifest"):
        warc.read_archives(spark, folder).collect()


def test_empty_table(spark, tmp_path):
    assert run(spark, tmp_path, [])[1] == []
