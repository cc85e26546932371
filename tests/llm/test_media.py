import hashlib
import zlib

import numpy as np
import pytest

from rillgrid.llm import media


def bits(*parts):
    """Scan bytes of (code, length) parts, filled with ones, zeros stuffed after 255."""
    text = "".join(f"{c:0{n}b}" if n else "" for c, n in parts)
    text += "1" * (-len(text) % 8)
    return bytes(int(text[k : k + 8], 2) for k in range(0, len(text), 8)).replace(b"\xff", b"\xff\x00")


def test_images_give_their_samples_back():
    rng = np.random.default_rng(0)
    payloads = [rng.integers(0, 256, 576 * k, dtype=np.uint8) for k in (1, 2, 7, 341)]
    payloads += [np.full(576, 255, np.uint8), np.zeros(1152, np.uint8), np.tile(np.array([0, 255], np.uint8), 576)]
    files = media.write_images(payloads)
    for file, payload, images in zip(files, payloads, media.read_images(files), strict=True):
        assert file[:2] == b"\xff\xd8" and file[-2:] == b"\xff\xd9"
        [(width, height, thumb)] = images
        assert (width, height) == (192, len(payload) // 24 * 8)
        assert (thumb.ravel() == payload).all()


def test_a_colour_image_with_other_terms_and_no_restarts():
    # 16 x 16 pixels, 4:2:0: four blocks of luminance, one each of two colours, AC terms in between.
    ac_bits, ac_values = (0, 2, 2, *[0] * 13), (0x00, 0x01, 0x11, 0xF0)
    dc = {v: (c, n) for v, c, n in media._codes(media.DC_BITS, media.DC_VALUES)}
    ac = {v: (c, n) for v, c, n in media._codes(ac_bits, ac_values)}

    def block(diff, terms=()):
        kind = abs(diff).bit_length()
        out = [dc[kind], (diff if diff >= 0 else diff + (1 << kind) - 1, kind)]
        for symbol in terms:
            out += [ac[symbol], (1, symbol & 15)]
        return [*out, ac[0]]

    scan = bits(*block(10, [0x01, 0x11]), *block(-3), *block(0, [0xF0, 0x01]), *block(7), *block(5), *block(-5, [0x11]))
    seg = media._segment
    data = b"".join((
        b"\xff\xd8", seg(0xDB, b"\x00" + bytes([16] * 64)), seg(0xFE, b"a comment"),
        seg(0xC0, b"\x08\x00\x10\x00\x10\x03\x01\x22\x00\x02\x11\x00\x03\x11\x00"),
        seg(0xC4, b"\x00" + bytes(media.DC_BITS) + bytes(media.DC_VALUES) + b"\x10" + bytes(ac_bits) + bytes(ac_values)),
        seg(0xDA, b"\x03\x01\x00\x02\x00\x03\x00\x00\x3f\x00"), scan, b"\xff\xd9",
    ))
    [[(width, height, thumb)]] = media.read_images([data])
    assert (width, height) == (16, 16)
    assert thumb.tolist() == [[148, 142], [142, 156]]


def test_other_kinds_of_image_are_refused():
    file = media.write_images([np.zeros(576, np.uint8)])[0].replace(b"\xff\xc0", b"\xff\xc2")
    with pytest.raises(ValueError, match="baseline"):
        media.read_images([file])


def test_store_reads_back_every_text(documents, rows, nothing, monkeypatch):
    got = media.store(documents).collect()
    assert len(got) == len(rows)
    texts = {}
    for r in rows:
        texts.setdefault(r[0], []).append((r[1] or "").encode())
    for r in got:
        raw = next(t for t in texts[r["doc_id"]] if t == bytes(r["payload"])[: r["n_bytes"]] and len(t) == r["n_bytes"])
        want = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        assert bytes(r["payload"]) == want and r["payload_sha256"] == hashlib.sha256(want).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(want[-32:])
        assert r["media_bytes"] == len(r["media"]) and r["media_sha256"] == hashlib.sha256(bytes(r["media"])).hexdigest()
    assert len({bytes(r["payload"]) for r in got}) == len({r["media_sha256"] for r in got})
    assert media.store(nothing).count() == 0


def test_a_text_of_several_images(spark):
    text = "é" * 250_000
    [r] = media.store(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert r["images"] == 3 and bytes(r["payload"])[:500_000] == text.encode()
