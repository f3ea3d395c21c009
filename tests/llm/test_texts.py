"""Token table and Ogg media: exact round trips."""

import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vellum.llm import media_ogg as M
from vellum.llm import sentencepiece_table as S


@pytest.fixture(scope="module")
def known():
    return S.chunk_table(S.default_model())


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" ▁\n\taéß中"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_chunks_equal_the_library(text):
    known = S.chunk_table(S.default_model())
    known.learn(set(known.chunks(text)))
    ids = known.model.encode(text, add_eos=True)
    assert known.encode(text) == " ".join(map(str, ids))
    assert known.decode(text) == known.model.decode(ids)


def test_table_is_bounded(monkeypatch):
    known = S.ChunkTable(S.default_model())
    monkeypatch.setattr(S, "MOST_BYTES", 600)
    for k in range(30):
        words = {f"w{k}x{i}" for i in range(20)} | {"frequent"}
        known.learn(words)
        assert words <= known.new.keys() and known.bytes < 600 + 21 * 40 and len(known.old) < 100
    assert known.segmented == 30 * 20 + 1  # what is used in every turn is segmented once
    known.learn({"y" * 5000})
    known.forget_long({"y" * 5000})
    assert known.bytes < 1500 and not any(len(c) > S.LONGEST for c in (*known.new, *known.decoded))


def test_table_of_the_corpus_gives_the_same_ids(awkward, nothing, spark, sf, known):
    rows = awkward.where("doc_id is not null").dropDuplicates(["doc_id"]).union(nothing)
    assert {r.doc_id: r.ids for r in S.joined(rows).collect()} == {r.doc_id: known.model.encode(r.text or "", add_eos=True) for r in rows.collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert {r.doc_id: r.ids for r in S.joined(docs).collect()} == {r.doc_id: r.ids for r in S.encode(docs).collect()}


def test_tokens_query_equals_the_library(spark, sf, known):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in S.op7_sentencepiece(spark, sf).collect():
        ids = known.model.encode(texts[r.doc_id], add_eos=True)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(known.model.decode(ids).encode()).hexdigest()


def test_tokens_of_awkward_rows(awkward, nothing, known):
    got = [r for r in S.encode(awkward).collect()]
    assert all(r.ids == known.model.encode(r.text or "", add_eos=True) for r in got)
    assert {r.n_tokens for r in S.round_trip(awkward).collect() if not r.text} == {1}
    assert S.encode(nothing).count() == 0 and S.round_trip(nothing).count() == 0


def slow_crc(data):
    crc = 0
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1) ^ (0x104C11DB7 if crc & 0x80000000 else 0)
    return crc


@given(st.binary(max_size=200))
def test_checksum_equals_bitwise(data):
    assert M.checksum(data) == slow_crc(data)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 200_000), st.integers(0, 255))
def test_media_round_trip(size, byte):
    payload = M.padded(bytes((byte + i * i) % 256 for i in range(min(size, 3000))) + bytes([byte]) * max(0, size - 3000))
    streams = M.read(M.write(payload))
    assert M.payload_of(streams) == payload and len(payload) % 64 == 0 and payload
    assert streams[M.SAMPLES].times[-1][1] == len(payload)
    assert streams[M.NOTES].packets[1] == f"bytes={len(payload)}".encode()


def test_packets_across_pages_and_interleaved_streams():
    big = bytes(range(256)) * 400
    a, b = M.paged(7, [(b"head", 0), (big, 5), (b"", 6), (b"x" * 255, 7)]), M.paged(8, [(b"other", 0), (b"y" * 70_000, 9)])
    mixed = [a[0], b[0]] + [p for pair in zip(a[1:], b[1:], strict=False) for p in pair] + a[1 + min(len(a), len(b)) - 1 :] + b[1 + min(len(a), len(b)) - 1 :]
    got = M.read(b"".join(dict.fromkeys(mixed)))
    assert got[7].packets == [b"head", big, b"", b"x" * 255] and got[8].packets == [b"other", b"y" * 70_000]
    assert got[7].times[-1] == (4, 7) and got[7].times[1][1] == -1


@pytest.mark.parametrize("harm", [lambda d: d[:-1], lambda d: d[:100] + bytes([d[100] ^ 1]) + d[101:], lambda d: d + b"OggS", lambda d: d[: len(d) // 2]])
def test_damaged_media_raise(harm):
    with pytest.raises(M.DamagedMedia):
        M.payload_of(M.read(harm(M.write(bytes(100_032)))))


def test_lost_page_raises():
    pages = M.paged(1, [(b"h", 0), (bytes(200_000), 1)])
    with pytest.raises(M.DamagedMedia, match="missing"):
        M.read(b"".join(pages[:2] + pages[3:]))


def test_media_query_equals_brute_force(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in M.op10_media(spark, sf).collect():
        b = texts[r.doc_id].encode()
        p = b + bytes(-len(b) % 64 or (0 if b else 64))
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(b), len(p), zlib.crc32(p[-64:]))
        assert r.payload_sha256 == hashlib.sha256(p).hexdigest()


def test_media_of_awkward_rows(awkward, nothing):
    got = [r for r in M.describe(M.store(awkward)).collect()]
    assert len(got) == 22 and {r.payload_bytes for r in got if not r.text} == {64}
    assert M.describe(M.store(nothing)).count() == 0


def independent_media(data):
    """(packets of each stream, last granule of each stream) by a reader that knows the format's tables only."""
    packets, open_, granules, at = {}, {}, {}, 0
    while at < len(data):
        assert data[at : at + 5] == b"OggS\0"
        granule, serial = int.from_bytes(data[at + 6 : at + 14], "little", signed=True), int.from_bytes(data[at + 14 : at + 18], "little")
        n = data[at + 26]
        end = at + 27 + n + sum(data[at + 27 : at + 27 + n])
        assert slow_crc(data[at : at + 22] + b"\0" * 4 + data[at + 26 : end]) == int.from_bytes(data[at + 22 : at + 26], "little")
        place = at + 27 + n
        for size in data[at + 27 : at + 27 + n]:
            open_[serial] = open_.get(serial, b"") + data[place : place + size]
            place += size
            if size < 255:
                packets.setdefault(serial, []).append(open_.pop(serial))
        if granule >= 0:
            granules[serial] = granule
        at = end
    return packets, granules


def test_media_and_feature_by_another_reader(spark):
    import math
    from collections import Counter

    texts = ["", "x", "plain words " * 30, "é中" * 2000, "z" * 64, "ab" * 9000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in M.describe(M.store(df)).collect():
        packets, granules = independent_media(r.media)
        payload = b"".join(packets[M.SAMPLES][1:])
        raw = texts[r.doc_id].encode()
        assert payload == raw + bytes(-len(raw) % 64 or (0 if raw else 64)) and granules[M.SAMPLES] == len(payload)
        assert (r.media_bytes, r.media_sha256) == (len(r.media), hashlib.sha256(r.media).hexdigest())
        n, values = len(payload), [b - 128 for b in payload]
        entropy = -sum(k / n * math.log2(k / n) for k in Counter(payload).values())
        want = {
            "seconds": n / 8000, "packets": len(packets[M.SAMPLES]) - 1, "mean": sum(values) / n, "rms": math.sqrt(sum(v * v for v in values) / n),
            "crossings": sum((a >= 0) != (b >= 0) for a, b in zip(values, values[1:], strict=False)), "entropy": entropy,
        }
        got = dict(x.split("=") for x in r.feature.split(";"))
        assert got.keys() == want.keys() and all(abs(float(got[k]) - v) < 1e-4 for k, v in want.items())


def test_large_types_are_read_whole():
    import pyarrow as pa

    from vellum.llm.common import blocks, text_bytes

    for kind, values in ((pa.large_binary(), [b"abc", None, b"defgh"]), (pa.large_string(), ["abc", None, "defgh"]), (pa.binary(), [b"abc", None, b"defgh"])):
        raw, starts = text_bytes(pa.array(values, kind))
        assert raw.tobytes() == b"abcdefgh" and starts.tolist() == [0, 3, 3, 8]
        batch = pa.RecordBatch.from_arrays([pa.array([b"abc", b"", b"defgh"] if "binary" in str(kind) else ["abc", "", "defgh"], kind)], ["t"])
        assert list(blocks(batch, "t", 4)) == [(0, 2), (2, 3)]
