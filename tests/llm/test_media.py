import io

import numpy as np
import pytest

from tests.llm.helpers import clashing, crc, docs, sha
from tidewake.llm import media
from tidewake.llm.queries import QUERIES


def bmp(bits, pixels, palette=b"", top_down=False):
    height, width = pixels.shape[:2]
    rows = pixels if top_down else pixels[::-1]
    body = b"".join(r.tobytes() + bytes(-len(r.tobytes()) % 4) for r in rows)
    start = 54 + len(palette)
    n = lambda v, k=4: int(v).to_bytes(k, "little", signed=v < 0)
    head = b"BM" + n(start + len(body)) + n(0) + n(start) + n(40) + n(width) + n(-height if top_down else height)
    return head + n(1, 2) + n(bits, 2) + n(0) + n(len(body)) + n(0) * 2 + n(len(palette) // 4) + n(0) + palette + body


@pytest.mark.parametrize(
    ("data", "want"),
    [
        (b"P1\n# c\n3 2\n101\n0 1 0\n", [[0, 1, 0], [1, 0, 1]]),
        (b"P2 2 2 9\n1 2 # x\n3 4", [[1, 2], [3, 4]]),
        (b"P3 1 1 255 7 8 9", [[[7, 8, 9]]]),
        (b"P4\n9 1\n" + bytes([0b10000000, 0b10000000]), [[0, 1, 1, 1, 1, 1, 1, 1, 0]]),
        (b"P5 2 1 255\n\x05\x06", [[5, 6]]),
        (b"P5 1 1 65535\n\x01\x02", [[258]]),
        (b"P6 1 1 255\n\x01\x02\x03", [[[1, 2, 3]]]),
        (bmp(24, np.array([[[1, 2, 3]], [[4, 5, 6]]], np.uint8)), [[[3, 2, 1]], [[6, 5, 4]]]),
        (bmp(24, np.array([[[1, 2, 3]], [[4, 5, 6]]], np.uint8), top_down=True), [[[3, 2, 1]], [[6, 5, 4]]]),
        (bmp(8, np.array([[0, 1], [1, 1]], np.uint8), bytes([9, 9, 9, 0, 50, 50, 50, 0])), [[9, 50], [50, 50]]),
        (bmp(32, np.array([[[1, 2, 3, 0]]], np.uint8)), [[[3, 2, 1]]]),
    ],
)
def test_images_are_decoded(data, want):
    assert media.decode(data).tolist() == want


def test_what_is_no_image_is_refused():
    for data in (b"", b"GIF89a", b"P5 2", bmp(8, np.zeros((1, 4), np.uint8)).replace(b"\x01\x00\x08\x00", b"\x01\x00\x04\x00")):
        with pytest.raises(ValueError):
            media.decode(data)


@pytest.mark.parametrize("shape", [(8, 9), (1, 64), (70, 64), (5, 3), (1, 1)])
def test_resizing_averages_exact_areas(shape, monkeypatch):
    monkeypatch.setattr(media, "STRIP", 16)
    image = np.random.default_rng(1).integers(0, 256, shape)
    fine = np.kron(image, np.ones((8, 9)))  # now both sides divide evenly
    h, w = fine.shape
    want = fine.reshape(8, h // 8, 9, w // 9).mean((1, 3))
    assert np.allclose(media.resized(image), want)


def test_difference_hash_and_tile():
    tile = np.tile(np.arange(9), (8, 1))
    assert media.difference_hash(tile) == "ff" * 8 and media.difference_hash(-tile) == "00" * 8
    assert np.load(io.BytesIO(media.npy(tile))).tolist() == tile.tolist()


def test_query_round_trip(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in QUERIES["op7_media_columns"](spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        raw = r.text.encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        g = got[r.doc_id]
        assert (g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32) == (len(raw), len(payload), sha(payload), crc(payload[-64:]))
        assert g.media_bytes > len(payload) and g.media_sha256 == sha(media.encode_payload(payload))


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "x" * 64), (3, "x" * 64), (None, "é" * 70_000)]
    out = media.features(media.stored(clashing(docs(spark, rows)))).collect()
    assert sorted(r.payload_bytes for r in out) == [64, 64, 64, 64, 140_032]
    assert len({r.feature for r in out if r.doc_id == 3}) == 1
    assert media.features(media.stored(docs(spark, []))).count() == 0
