import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tributary.llm import transport_stream as ts

from .conftest import rows


@settings(max_examples=150, deadline=None)
@given(st.binary(min_size=1, max_size=6000), st.sampled_from([184, 1920, 333]))
def test_round_trip(data, unit):
    stream = ts.mux(data, unit)
    got = ts.demux(stream)
    (e,) = got.streams
    assert e.payload == data and got.status == "ok" and len(stream) % 188 == 0
    assert e.random_access == [k % 12 == 0 for k in range(-(-len(data) // unit))]
    assert e.pts == [3600 * k for k in range(len(e.pts))]


def test_every_size():
    for n in [*range(1, 400), *range(1700, 2300), 50_000]:
        data = bytes(i % 251 for i in range(n))
        assert ts.demux(ts.mux(data)).streams[0].payload == data


DATA = bytes(i % 251 for i in range(20_000))


def packets():
    return np.frombuffer(ts.mux(DATA), np.uint8).reshape(-1, 188).copy()


def units_but(*gone):
    return b"".join(DATA[k * 1920 : (k + 1) * 1920] for k in range(11) if k not in gone)


def test_lost_and_repeated_packets():
    p = packets()
    es = np.flatnonzero((p[:, 1] & 31) == 1)  # 11 packets a unit
    for k in (3, 17, 40):
        less = ts.demux(np.delete(p, es[k], 0).tobytes())
        unit = int((p[es[: k + 1], 1] & 0x40 != 0).sum()) - 1
        assert less.continuity_errors == 1 and less.status == "lost packets; damaged units"
        assert less.streams[0].payload == units_but(unit) and less.streams[0].damaged_units == 1
        twice = ts.demux(np.insert(p, es[k], p[es[k]], 0).tobytes())
        assert twice.repeats == 1 and twice.status == "ok" and twice.streams[0].payload == DATA
    starts = es[p[es, 1] & 0x40 != 0]
    headless = ts.demux(np.delete(p, starts[4], 0).tobytes())  # the rest of unit 4 comes after unit 3's end
    assert headless.streams[0].payload == units_but(3, 4) or headless.streams[0].payload == units_but(4)
    assert headless.status == "lost packets; damaged units"


def test_damage_is_seen():
    p = packets()
    p[5, 3] ^= 1
    assert ts.demux(p.tobytes()).continuity_errors == 2
    p = packets()
    p[5, 0] = 0
    lost = ts.demux(p.tobytes())
    assert lost.lost_bytes == 188 and "lost sync" in lost.status and lost.streams[0].payload == units_but(0)
    good = ts.mux(DATA)
    assert ts.demux(b"junk" + good).streams[0].payload == DATA
    assert ts.demux(good[:-1]).streams[0].payload == units_but(10)
    assert ts.demux(good[:9] + b"\1" + good[10:]).status == "no program; damaged tables" or ts.demux(good[:9] + b"\1" + good[10:]).streams
    p = packets()
    p[5, 1] |= 0x80
    assert "error packets" in ts.demux(p.tobytes()).status
    for odd in (b"", b"G", bytes(188), b"G" * 188 * 3, bytes(range(256)) * 20):
        assert ts.demux(odd).status != "ok" and not any(e.payload for e in ts.demux(odd).streams)


def test_discontinuity_flag():
    p = packets()
    es = np.flatnonzero((p[:, 1] & 31) == 1)
    later = es[np.flatnonzero(p[es, 1] & 0x40)[0] + 11 :]
    p[later, 3] = p[later, 3] & 0xF0 | (p[later, 3] + 5) & 15
    assert ts.demux(p.tobytes()).continuity_errors == 1
    first = later[0]
    assert p[first, 3] >> 4 & 2 == 0
    p[first, 3] |= 0x20
    body = p[first, 4:186].copy()  # two bytes of it make room for the field: the length says so
    p[first, 4:6], p[first, 6:] = (1, 0x80), body
    assert ts.demux(p.tobytes()).continuity_errors == 0


def test_programs_streams_and_long_sections():
    many = b"".join(n.to_bytes(2, "big") + (0xE000 | 0x1000 + n).to_bytes(2, "big") for n in range(1, 80))
    pat = ts._section(0x00, 1, many)
    assert len(pat) > 184  # over two packets
    parts = [pat[:183], pat[183:]]
    table = [ts._table_packet(0, 0, parts[0]), np.frombuffer(bytes([0x47, 0, 0, 0x11]) + parts[1].ljust(184, b"\xff"), np.uint8)]
    stream = lambda pid, tag: bytes([tag]) + (0xE000 | pid).to_bytes(2, "big") + b"\xf0\x00"
    for n in (1, 2):
        body = (0xE100).to_bytes(2, "big") + b"\xf0\x00" + stream(0x100, 6) + (stream(0x101, 6) if n == 2 else b"")
        table.append(ts._table_packet(0x1000 + n, 0, ts._section(0x02, n, body)))
    one = np.frombuffer(ts.mux(DATA), np.uint8).reshape(-1, 188)
    one = one[(one[:, 1] & 31) == 1]
    two = one.copy()
    two[:, 2] = 1
    mixed = np.stack([one, two], 1).reshape(-1, 188)
    got = ts.demux(np.concatenate([np.stack(table), mixed]).tobytes())
    assert got.programs == 79 and [(e.program, e.pid) for e in got.streams] == [(1, 0x100), (2, 0x100), (2, 0x101)]
    assert all(e.payload == DATA for e in got.streams)


def test_unbounded_units_and_no_timestamps():
    p = packets()
    es = np.flatnonzero((p[:, 1] & 31) == 1)
    for i in es[p[es, 1] & 0x40 != 0]:
        at = 4 + (p[i, 4] + 1 if p[i, 3] & 0x20 else 0)
        p[i, at + 4 : at + 6] = 0  # no length
        p[i, at + 7] = 0  # no flag of a timestamp
    e = ts.demux(p.tobytes()).streams[0]
    assert e.payload == DATA and set(e.pts) == {None}


def test_columns(docs, nothing):
    got = ts.stream_features(ts.store_streams(docs)).collect()
    want = []
    for i, t, *_ in rows():
        raw = (t or "").encode()
        pay = raw + b" " * (-len(raw) % 192 if raw else 192)
        want.append((len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-16:])))
    assert sorted((r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == sorted(want)
    by_text = {}
    for r in got:
        assert by_text.setdefault(r.payload_sha256, (r.media_sha256, r.feature, r.media_bytes)) == (r.media_sha256, r.feature, r.media_bytes)
        assert set(r.random_access_pts) <= set(r.pts)
        assert r.status == "ok"
    assert ts.stream_features(ts.store_streams(nothing)).count() == 0


def test_damaged_rows(spark):
    good = ts.mux(DATA)
    rows_ = [(1, 5, good), (2, 5, good[: 188 * 20] + good[188 * 21 :]), (3, 5, None), (None, None, b"no stream")]
    got = {r.doc_id: r for r in ts.stream_features(spark.createDataFrame(rows_, "doc_id long, n_bytes long, media binary")).collect()}
    assert got[1].status == "ok" and "lost packets" in got[2].status and got[3].media_bytes == 0 and got[None].status.startswith("no packets")
    words = spark.createDataFrame([("x", "text"), ("7", "text")], "doc_id string, text string")
    assert {r.doc_id for r in ts.stream_features(ts.store_streams(words)).collect()} == {None, 7}
