import random

import pytest

from tessera.operators import entropy


def test_published_sequence():
    """The arithmetic coder's test sequence: one context, 256 decisions."""
    coded = bytes.fromhex("84C73BFCE1A1430402200000410DBB86F4317FFF88FF37471ADB6ADFFFAC")
    plain = bytes.fromhex("00020051000000C00352872AAAAAAAAA82C02000FCD79EF6BF7FED904F46A3BF")
    decode = entropy.decoder(coded, [0] * 19)
    assert int("".join(str(decode(0)) for _ in range(256)), 2).to_bytes(32, "big") == plain
    encoder = entropy.MQEncoder([0] * 19)
    for k in range(256):
        encoder(0, int.from_bytes(plain, "big") >> 255 - k & 1)
    assert coded.startswith(encoder.flush())


def test_published_code_block():
    """The high band's code-block of the standard's worked example, an image of one column."""
    coded = entropy.decode_block(bytes.fromhex("0FB176"), 1, 4, 2, 3, 7, 10)
    assert [-((v & 0x7FFFFFFF) >> 21) if v < 0 else v >> 21 for v in coded] == [1, 5, 1, 0]


def test_tables():
    assert len(entropy.STATES) == 47 and all(0 <= a < 47 and 0 <= b < 47 and c in (0, 1) for _, a, b, c in entropy.STATES)
    assert [max(t) for t in entropy.SIGNIFICANCE] == [8, 8, 8]
    assert entropy.SIGNIFICANCE[0][0] == 0 and entropy.SIGN[0, 0] == (9, 0) and entropy.SIGN[-1, 1] == (11, 1) and entropy.SIGN[1, 1] == (13, 0)


@pytest.mark.parametrize("orient", range(4))
@pytest.mark.parametrize(("w", "h"), [(1, 1), (5, 3), (8, 8), (17, 9), (1, 13)])
def test_blocks_return(orient, w, h):
    rng = random.Random(w * 100 + h * 10 + orient)
    for top in (1, 40, 5000):
        samples = [rng.choice([0, 0, rng.randint(-top, top)]) for _ in range(w * h)]
        data, planes, passes = entropy.encode_block(samples, w, h, orient)
        mag_bits = planes + 2
        got = entropy.decode_block(data, w, h, orient, planes, passes, mag_bits)
        back = [-((v & 0x7FFFFFFF) >> 31 - mag_bits) if v < 0 else v >> 31 - mag_bits for v in got]
        assert back == samples


def test_fewer_passes_only_lose_detail():
    rng = random.Random(1)
    samples = [rng.randint(-200, 200) for _ in range(64)]
    data, planes, passes = entropy.encode_block(samples, 8, 8, 3)
    cut = entropy.decode_block(data, 8, 8, 3, planes, passes - 6, planes)
    for v, s in zip(cut, samples, strict=True):
        m = (v & 0x7FFFFFFF) >> 31 - planes
        assert m & ~3 == m and m <= abs(s) and (m == 0 or (v < 0) == (s < 0))
    assert entropy.decode_block(b"", 4, 4, 0, 0, 0, 8) == [0] * 16
    assert len(entropy.decode_block(b"\x01", 8, 8, 0, 9, 25, 9)) == 64
