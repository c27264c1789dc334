import hashlib
import zlib

import pytest

from wayfold.llm import oggmedia as O


def slow_crc(data):
    r = 0
    for x in data:
        r ^= x << 24
        for _ in range(8):
            r = ((r << 1) ^ 0x04C11DB7) & 0xFFFFFFFF if r >> 31 else r << 1
    return r


@pytest.mark.parametrize("data", [b"", b"OggS", bytes(range(256)) * 3])
def test_checksum(data):
    assert O.checksum(data) == slow_crc(data)


@pytest.mark.parametrize("size", [64, 255, 256, 4096, 4097, 255 * 255, 255 * 255 + 7, 300_000])
def test_round_trip(size):
    payload = bytes(i * 7 % 251 for i in range(size))
    back, seen = O.decode(O.encode(payload))
    assert back == payload and seen["seconds"] == size / O.RATE and seen["times"] == sorted(seen["times"])


def test_long_packets_continue_over_pages():
    packet = bytes(200_000)
    pages = O.pages_of([(packet, 99)], 5, 0, O.FIRST | O.LAST)
    assert len(pages) > 1 and [p[5] & O.CONTINUED for p in pages] == [0] + [1] * (len(pages) - 1)
    assert [(p, g) for _, p, g, _ in O.packets(b"".join(pages))] == [(packet, 99)]


@pytest.mark.parametrize("most", [1, 2, 7, 32, 255])
def test_granules_of_several_packets_on_a_page(most):
    sizes = [64, 1, 0, 255, 700, 5, 5, 510, 33]
    ends = [sum(sizes[: k + 1]) for k in range(len(sizes))]
    pages = O.pages_of([(bytes([k]) * n, e) for k, (n, e) in enumerate(zip(sizes, ends))], 9, 1, O.LAST, most)
    head = O.pages_of([(b"head", 0)], 9, 0, O.FIRST)
    got = list(O.packets(b"".join(head + pages)))
    assert [(p, g) for _, p, g, _ in got[1:]] == [(bytes([k]) * n, e) for k, (n, e) in enumerate(zip(sizes, ends))]


def test_written_pages_share_and_continue_packets():
    media = O.encode(bytes(200_000))
    pages, at = [], 0
    while at < len(media):
        segments = media[at + 26]
        values = media[at + 27 : at + 27 + segments]
        pages.append((media[at + 5], sum(v < O.FULL for v in values)))
        at += 27 + segments + sum(values)
    assert any(kind & O.CONTINUED for kind, _ in pages) and any(ends > 1 for _, ends in pages)


def test_damage_is_found():
    media = O.encode(bytes(range(64)) * 300)
    for at in (10, 30, len(media) // 2, len(media) - 1):
        with pytest.raises(O.OggError):
            O.decode(media[:at] + bytes([media[at] ^ 1]) + media[at + 1 :])
    with pytest.raises(O.OggError):
        O.decode(media[:-50])


def test_table(docs, empty):
    rows = {r.doc_id: r for r in O.read_back(O.store(docs)).collect()}
    for r in docs.collect():
        data = (r.text or "").encode()
        payload = data + bytes(-len(data) % 64) or bytes(64)
        got = rows[r.doc_id]
        assert (got.n_bytes, got.payload_bytes, got.payload_sha256, got.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert got.media_sha256 == hashlib.sha256(O.encode(payload)).hexdigest()
    assert rows[4].feature == rows[5].feature
    assert O.read_back(O.store(empty)).count() == 0
