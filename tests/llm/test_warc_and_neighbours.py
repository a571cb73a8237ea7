"""WARC round trip and nearest neighbours."""

import base64
import collections
import hashlib

import numpy as np
import pytest

from regweave.llm import neighbours
from regweave.llm.neighbours import nearest
from regweave.llm.warc import new_folder, read_archives, record, records, write_archives

PAGES = "page_id long, url string, html string, digest string"


def pages(spark, rows):
    return spark.createDataFrame(rows, PAGES)


def expected(rows, least=0):
    last = collections.defaultdict(list)
    for p, _, h, _ in rows:
        last[(h or "").encode()].append(p)
    out = []
    for p, u, h, _ in rows:
        b = (h or "").encode()
        top = max((x for x in last[b] if x is not None), default=None)
        revisit = len(b) >= least and top is not None and p != top
        out.append((p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response",
                    top if revisit else None))
    return sorted(out, key=str)


ROWS = [(i, f"http://x/{i}", "<p>" + "ab" * (i % 7) * 50, "clash") for i in range(60)] + [
    (100, None, None, None), (101, "", "", None), (None, "u", "<p>", None), (None, "u", "only here", None),
    (102, "u", "twice", None), (102, "u", "twice", None), (103, "u", "é\r\n\r\n\0" * 500, None)]


@pytest.mark.parametrize("least,roll", [(0, 4 << 20), (10, 600)])
def test_round_trip(spark, least, roll):
    folder = new_folder(spark)
    manifest = write_archives(pages(spark, ROWS), folder, least, roll).collect()
    assert sum(r.records for r in manifest) == len(ROWS)
    got = read_archives(spark, folder).collect()
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=str) == expected(ROWS, least)
    assert all(r.intact for r in got)
    assert all(bytes(r.payload) == (dict((p, h) for p, _, h, _ in ROWS)[r.page_id] or "").encode()
               for r in got if r.record_type == "response" and r.page_id is not None)
    again = write_archives(pages(spark, ROWS).repartition(7), new_folder(spark), least, roll).collect()
    assert sorted((r.path, r.sha256) for r in again) == sorted((r.path, r.sha256) for r in manifest)


def test_lost_or_changed_archives_are_told(spark):
    import os
    folder = new_folder(spark)
    manifest = write_archives(pages(spark, ROWS), folder, 0, 600).collect()
    path = os.path.join(folder.removeprefix("file://").removeprefix("file:"), manifest[0].path)
    data = open(path, "rb").read()
    with open(path, "wb") as f:
        f.write(data[:-9] + bytes([data[-9] ^ 1]) + data[-8:])
    os.remove(os.path.join(os.path.dirname(path), f".{manifest[0].path}.crc")) if os.path.exists(
        os.path.join(os.path.dirname(path), f".{manifest[0].path}.crc")) else None
    with pytest.raises(Exception, match="not the bytes"):
        read_archives(spark, folder).collect()
    os.remove(path)
    with pytest.raises(ValueError, match="absent archives"):
        read_archives(spark, folder)


def test_no_pages(spark):
    folder = new_folder(spark)
    assert write_archives(pages(spark, []), folder).count() == 0 and read_archives(spark, folder).count() == 0


def test_record_headers():
    import gzip
    data = gzip.compress(record(5, "http://x\r\nX-Evil: 1", b"hi", False, None)) + gzip.compress(record(6, "u", b"hi", True, 5))
    (a, block), (b, _) = records(data)
    assert a["WARC-Type"] == "response" and block.endswith(b"\r\n\r\nhi") and "X-Evil" not in a
    assert b["WARC-Refers-To"] == a["WARC-Record-ID"] and a["Content-Length"] == str(len(block))


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


@pytest.mark.parametrize("normed,shard", [(True, 8192), (False, 500)])
def test_recall(spark, monkeypatch, normed, shard):
    monkeypatch.setattr(neighbours, "SHARD_ROWS", shard)
    r = np.random.default_rng(4)
    x = r.normal(size=(1500, 16)).astype(np.float32) + 3 * r.normal(size=(30, 16)).astype(np.float32)[np.arange(1500) % 30]
    if normed:
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[40:70] = x[40]
    df = vectors(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)])
    got = collections.defaultdict(list)
    for g in sorted(nearest(df, df.filter("vec_id % 20 = 0"), 20).collect()):
        got[g.query_id].append((g.vec_id, g.score, g["rank"]))
    found = []
    d = x.astype(np.float64)
    for q in range(0, 1500, 20):
        s = d @ d[q]
        s[q] = -np.inf
        top = np.lexsort([np.arange(1500), -s])[:20]
        own = got[q]
        assert [g[2] for g in own] == list(range(1, 21))
        assert all(abs(g[1] - s[g[0]]) < 1e-12 for g in own) and q not in [g[0] for g in own]
        assert own == sorted(own, key=lambda g: (-g[1], g[0]))
        found.append(len({g[0] for g in own} & set(top.tolist())) / 20)
    assert np.mean(found) >= 0.9


@pytest.mark.parametrize("times", [1_000, 10_000, 1e12])
def test_recall_beside_a_long_vector(spark, times):
    r = np.random.default_rng(6)
    x = r.normal(size=(1200, 24)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[17] *= times
    d, df = x.astype(np.float64), vectors(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)])
    got = collections.defaultdict(set)
    for g in nearest(df, df.filter("vec_id % 20 = 0"), 20).collect():
        got[g.query_id].add(g.vec_id)
    found = []
    for q in range(0, 1200, 20):
        s = d @ d[q]
        s[q] = -np.inf
        found.append(len(got[q] & set(np.lexsort([np.arange(1200), -s])[:20].tolist())) / 20)
    assert np.mean(found) >= 0.9


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0], 1), (20, [1.0, 0.0], 1), (1, None, 1), (2, [0.0, 0.0], 1), (3, [None, 1.0], 1),
            (4, [float("nan"), 1.0], 1), (5, [float("inf"), 1.0], 1), (6, [0.5, 0.5], 1), (40, None, 1)]
    df = vectors(spark, rows)
    got = sorted(tuple(r) for r in nearest(df, df.filter("vec_id % 20 = 0"), 20).collect())
    assert got == [(0, 1, 20, 1.0), (0, 2, 6, 0.5), (20, 1, 0, 1.0), (20, 2, 6, 0.5)]
    none = vectors(spark, [])
    assert nearest(none, none).count() == 0
