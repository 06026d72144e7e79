"""Salvage of damaged archives: cut, broken and wrongly summed members, folded headers."""

import gzip
import random
import time

import pytest

from loam.llm import warc


def record(n, payload, extra=""):
    http = b"HTTP/1.1 200 OK\r\nContent-Length: 999\r\n\r\n"
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{n}>\r\n{extra}WARC-Payload-Digest: sha1:{warc.base32_sha1(payload)}\r\nContent-Type: application/http\r\nContent-Length: {len(http) + len(payload)}\r\n\r\n".encode()
    return head + http + payload + b"\r\n\r\n"


@pytest.fixture(scope="module")
def records():
    rng = random.Random(4)
    return [record(n, rng.randbytes(rng.randint(0, 3000)).replace(b"\x1f\x8b", b"..")) for n in range(100)]


def ids(found):
    return [int(r["record_id"][10:-1]) for r in found if r["kind"] == "record"]


def gaps(found):
    return [(r["reason"], r["offset"], r["length"]) for r in found if r["kind"] == "gap"]


@pytest.mark.parametrize("share", [0.1, 0.5, 0.9])
def test_a_cut_member_gives_the_records_before_the_cut(records, share):
    packed = gzip.compress(b"".join(records))
    cut = packed[: int(share * len(packed))]
    found = list(warc.salvage(cut))
    got = ids(found)
    assert got == list(range(len(got))) and 100 * share - 5 < len(got) < 100 * share + 2
    (reason, offset, length), = gaps(found)
    assert reason == "gzip ends early" and offset + length == len(cut) and length < 70000
    # What stands behind is found again.
    after = list(warc.salvage(cut + gzip.compress(records[7]) + records[8]))
    assert ids(after) == [*got, 7, 8] and len(gaps(after)) == 1


def test_a_wrong_checksum_loses_nothing_but_is_logged(records):
    packed = bytearray(gzip.compress(b"".join(records)))
    packed[-5] ^= 1
    found = list(warc.salvage(bytes(packed) + records[3]))
    assert ids(found) == [*range(100), 3]
    assert gaps(found) == [("gzip checksum", len(packed) - 8, 8)]


def test_a_broken_byte_inside_loses_what_follows_in_its_member(records):
    packed = bytearray(gzip.compress(b"".join(records), mtime=0))
    packed[len(packed) // 2 : len(packed) // 2 + 40] = b"\xff" * 40
    found = list(warc.salvage(gzip.compress(records[0]) + bytes(packed) + gzip.compress(records[1])))
    got = ids(found)
    assert got[0] == 0 and got[-1] == 1 and got[1:-1] == list(range(len(got) - 2)) and len(got) > 40
    assert gaps(found)


def test_members_with_names_comments_and_extra_fields(records):
    plain = gzip.compress(records[0], mtime=0)
    named = plain[:3] + bytes([4 | 8 | 16 | 2]) + plain[4:10] + b"\x03\x00abc" + b"name\0" + b"comment\0" + b"\x00\x00" + plain[10:]
    assert ids(warc.salvage(named + plain)) == [0, 0]
    assert gaps(warc.salvage(plain[:12])) and gaps(warc.salvage(b"\x1f\x8b\x08"))


def test_folded_lines_belong_to_their_field_and_sizes_are_true():
    found = list(warc.salvage(record(1, b"abc", "X-Note: one\r\n two\r\n\tthree\r\n")))
    assert [(r["kind"], r["payload_bytes"]) for r in found] == [("record", 3)]


def test_reading_members_is_linear():
    rng = random.Random(9)
    parts = [gzip.compress(record(n, rng.randbytes(6000)), 1) for n in range(4000)]
    began = time.perf_counter()
    found = list(warc.salvage(b"".join(parts)))
    took = time.perf_counter() - began
    assert ids(found) == list(range(4000)) and took < 5
