"""Code-block entropy coding: a binary arithmetic (MQ) coder under three passes a bit-plane.

Every bit depends on the one before, so a block is decoded by plain Python over flat lists; blocks are
independent and are spread over tasks (`plans.decode`). The same passes drive the encoder that makes
fixtures: a coder is called with a context and the bit to code, and returns the bit.
"""

from __future__ import annotations

#: Fixed values, a row for each of the 47 states: Qe, next state after MPS, after LPS, switch.
STATES = (
    (0x5601, 1, 1, 1),
    (0x3401, 2, 6, 0),
    (0x1801, 3, 9, 0),
    (0x0AC1, 4, 12, 0),
    (0x0521, 5, 29, 0),
    (0x0221, 38, 33, 0),
    (0x5601, 7, 6, 1),
    (0x5401, 8, 14, 0),
    (0x4801, 9, 14, 0),
    (0x3801, 10, 14, 0),
    (0x3001, 11, 17, 0),
    (0x2401, 12, 18, 0),
    (0x1C01, 13, 20, 0),
    (0x1601, 29, 21, 0),
    (0x5601, 15, 14, 1),
    (0x5401, 16, 14, 0),
    (0x5101, 17, 15, 0),
    (0x4801, 18, 16, 0),
    (0x3801, 19, 17, 0),
    (0x3401, 20, 18, 0),
    (0x3001, 21, 19, 0),
    (0x2801, 22, 19, 0),
    (0x2401, 23, 20, 0),
    (0x2201, 24, 21, 0),
    (0x1C01, 25, 22, 0),
    (0x1801, 26, 23, 0),
    (0x1601, 27, 24, 0),
    (0x1401, 28, 25, 0),
    (0x1201, 29, 26, 0),
    (0x1101, 30, 27, 0),
    (0x0AC1, 31, 28, 0),
    (0x09C1, 32, 29, 0),
    (0x08A1, 33, 30, 0),
    (0x0521, 34, 31, 0),
    (0x0441, 35, 32, 0),
    (0x02A1, 36, 33, 0),
    (0x0221, 37, 34, 0),
    (0x0141, 38, 35, 0),
    (0x0111, 39, 36, 0),
    (0x0085, 40, 37, 0),
    (0x0049, 41, 38, 0),
    (0x0025, 42, 39, 0),
    (0x0015, 43, 40, 0),
    (0x0009, 44, 41, 0),
    (0x0005, 45, 42, 0),
    (0x0001, 45, 43, 0),
    (0x5601, 46, 46, 0),
)

#: Contexts: 0 to 8 significance, 9 to 13 sign, 14 to 16 refinement, then uniform and run.
UNIFORM, RUN, CONTEXTS = 17, 18, 19
#: States in which contexts start; all others start in 0.
FIRST_STATES = {UNIFORM: 46, RUN: 3, 0: 4}


def _states() -> list[int]:
    return [FIRST_STATES.get(k, 0) for k in range(CONTEXTS)]


def decoder(data: bytes, states: list[int] | None = None):
    """A function of a context that returns the next bit. Past the end of its bytes it reads ones, as the standard has it."""
    data += b"\xff\xff"
    last, state, mps = len(data) - 2, list(states or _states()), [0] * CONTEXTS
    at, c, ct, a = 0, data[0] << 16, 0, 0x8000

    def byte() -> None:
        nonlocal at, c, ct
        here = at if at < last else last
        follows = data[here + 1]
        if data[here] == 0xFF:
            if follows > 0x8F:
                c += 0xFF00
                ct = 8
                return
            c += follows << 9
            ct = 7
        else:
            c += follows << 8
            ct = 8
        at = here + 1

    byte()
    c <<= 7
    ct -= 7

    def decode(cx: int, _bit: int = 0) -> int:
        nonlocal a, c, ct
        qe, after_mps, after_lps, switch = STATES[state[cx]]
        out = mps[cx]
        a -= qe
        if c >> 16 < qe:  # the lower part, of size qe
            lps = a >= qe
            a = qe
        else:
            c -= qe << 16
            if a & 0x8000:
                return out
            lps = a < qe
        if lps:
            out ^= 1
            if switch:
                mps[cx] ^= 1
            state[cx] = after_lps
        else:
            state[cx] = after_mps
        while a < 0x8000:
            if not ct:
                byte()
            a <<= 1
            c = c << 1 & 0xFFFFFFFF
            ct -= 1
        return out

    return decode


class MQEncoder:
    def __init__(self, states: list[int] | None = None):
        self.out = bytearray([0])
        self.state, self.mps = states or _states(), [0] * CONTEXTS
        self.a, self.c, self.ct = 0x8000, 0, 12

    def __call__(self, cx: int, bit: int) -> int:
        qe, after_mps, after_lps, switch = STATES[self.state[cx]]
        self.a -= qe
        if bit == self.mps[cx]:
            if self.a & 0x8000:
                self.c += qe
                return bit
            if self.a < qe:
                self.a = qe
            else:
                self.c += qe
            self.state[cx] = after_mps
        else:
            if self.a < qe:
                self.c += qe
            else:
                self.a = qe
            if switch:
                self.mps[cx] ^= 1
            self.state[cx] = after_lps
        while not self.a & 0x8000:
            self.a <<= 1
            self.c <<= 1
            self.ct -= 1
            if not self.ct:
                self._byte()
        return bit

    def _byte(self) -> None:
        if self.out[-1] != 0xFF and self.c >= 0x8000000:  # carry
            self.out[-1] += 1
            self.c &= 0x7FFFFFF
        if self.out[-1] == 0xFF:
            self.out.append(self.c >> 20 & 0xFF)
            self.c &= 0xFFFFF
            self.ct = 7
        else:
            self.out.append(self.c >> 19 & 0xFF)
            self.c &= 0x7FFFF
            self.ct = 8

    def flush(self) -> bytes:
        top = self.c + self.a
        self.c |= 0xFFFF
        if self.c >= top:
            self.c -= 0x8000
        for _ in range(2):
            self.c <<= self.ct
            self._byte()
        return bytes(self.out[1:-1] if self.out[-1] == 0xFF else self.out[1:])


def _significance(kind: int, h: int, v: int, d: int) -> int:
    """Context by significant neighbours: two beside, two above and below, four diagonal. kind 0: LL, LH; 1: HL; 2: HH."""
    if kind == 2:
        if d >= 3:
            return 8
        return (0, 3, 6)[d] + min(h + v, 1 if d == 2 else 2)
    if kind == 1:
        h, v = v, h
    if h == 2:
        return 8
    if h == 1:
        return 7 if v else 6 if d else 5
    return 2 + v if v else min(d, 2)


#: Context by kind, then 15 * h + 5 * v + d.
SIGNIFICANCE = [[_significance(kind, h, v, d) for h in range(3) for v in range(3) for d in range(5)] for kind in range(3)]


def _sign(h: int, v: int) -> tuple[int, int]:
    """Context and the bit to flip by, from the neighbours' signs beside and above and below."""
    flip = h < 0 or h == 0 and v < 0
    if flip:
        h, v = -h, -v
    return (12 + v if h else 9 + v), int(flip)


SIGN = {(h, v): _sign(h, v) for h in (-1, 0, 1) for v in (-1, 0, 1)}


def context_kind(orient: int) -> int:
    """0 for LL and LH, 1 for HL, 2 for HH."""
    return {0: 0, 1: 1, 2: 0, 3: 2}[orient]


class Block:
    """The state of one code-block's coding; samples have a border of one on each side.

    `near` has, for each sample, its significant neighbours as 15 * beside + 5 * above and below + diagonal:
    the place of its context in the table, zero if it has none. It changes only where a sample becomes
    significant.
    """

    def __init__(self, width: int, height: int, orient: int, coder, target: list[int] | None = None):
        self.w, self.h, self.stride = width, height, width + 2
        size = self.stride * (height + 2)
        self.sig, self.seen, self.refined, self.near = ([0] * size for _ in range(4))
        self.sign = [0] * size  # 1 or -1 once significant
        self.mag = [0] * size
        self.table = SIGNIFICANCE[context_kind(orient)]
        self.coder, self.target = coder, target
        # Columns of up to four samples, stripe by stripe: the order of every pass.
        self.columns = [range((top + 1) * self.stride + x + 1, (min(top + 4, height) + 1) * self.stride + x + 1, self.stride) for top in range(0, height, 4) for x in range(width)]
        self.order = [i for column in self.columns for i in column]
        self.none = [0] * size

    def _bits(self, plane: int) -> list[int]:
        """What an encoder codes in a plane; a decoder's coder doesn't look at it."""
        return [abs(v) >> plane & 1 for v in self.target] if self.target else self.none

    def _sign_of(self, i: int, plane: int) -> None:
        g, near, stride = self.sign, self.near, self.stride
        h = max(-1, min(1, g[i - 1] + g[i + 1]))
        v = max(-1, min(1, g[i - stride] + g[i + stride]))
        cx, flip = SIGN[h, v]
        negative = self.coder(cx, (self.target[i] < 0) ^ flip if self.target else 0) ^ flip
        self.sig[i], g[i], self.mag[i] = 1, -1 if negative else 1, 1 << plane
        near[i - 1] += 15
        near[i + 1] += 15
        for row in (i - stride, i + stride):
            near[row - 1] += 1
            near[row] += 5
            near[row + 1] += 1

    def propagate(self, plane: int) -> None:
        sig, near, seen, table, coder, bits = self.sig, self.near, self.seen, self.table, self.coder, self._bits(plane)
        for i in self.order:
            if near[i] and not sig[i]:
                seen[i] = 1
                if coder(table[near[i]], bits[i]):
                    self._sign_of(i, plane)

    def refine(self, plane: int) -> None:
        sig, near, seen, refined, mag, coder, bits, one = self.sig, self.near, self.seen, self.refined, self.mag, self.coder, self._bits(plane), 1 << plane
        for i in self.order:
            if sig[i] and not seen[i]:
                if refined[i]:
                    cx = 16
                else:
                    cx = 15 if near[i] else 14
                    refined[i] = 1
                if coder(cx, bits[i]):
                    mag[i] |= one

    def clean(self, plane: int) -> None:
        sig, near, seen, table, coder, bits = self.sig, self.near, self.seen, self.table, self.coder, self._bits(plane)
        for column in self.columns:
            rest = column
            if len(column) == 4:
                a, b, c, d = column
                if not (near[a] or near[b] or near[c] or near[d] or sig[a] or sig[b] or sig[c] or sig[d]):
                    ones = [bits[a], bits[b], bits[c], bits[d]]
                    if not coder(RUN, 1 in ones):
                        continue
                    at = ones.index(1) if 1 in ones else 0
                    start = coder(UNIFORM, at >> 1) << 1
                    start |= coder(UNIFORM, at & 1)
                    self._sign_of(column[start], plane)
                    rest = column[start + 1 :]
            for i in rest:
                if not sig[i] and not seen[i] and coder(table[near[i]], bits[i]):
                    self._sign_of(i, plane)
        self.seen = [0] * len(seen)

    def run(self, planes: int, passes: int) -> None:
        """The first plane has a cleanup pass only, each other one all three; `passes` may end early."""
        for k in range(passes):
            plane = planes - 1 - (k + 2) // 3
            if plane < 0:
                break
            (self.propagate, self.refine, self.clean)[(k + 2) % 3](plane)


def decode_block(data: bytes, width: int, height: int, orient: int, significant: int, passes: int, mag_bits: int) -> list[int]:
    """Samples row by row as signed 32-bit sign and magnitude, the magnitude's first bit-plane at bit 30."""
    if significant <= 0 or passes <= 0 or not width or not height:
        return [0] * (width * height)
    block = Block(width, height, orient, decoder(data))
    block.run(significant, passes)
    shift, out = 31 - mag_bits, []
    for y in range(height):
        at = (y + 1) * block.stride + 1
        for i in range(at, at + width):
            m = block.mag[i] << shift
            out.append(m - 0x80000000 if block.sign[i] < 0 else m)
    return out


def encode_block(samples: list[int], width: int, height: int, orient: int) -> tuple[bytes, int, int]:
    """(bytes, significant bit-planes, passes) of integer samples, row by row."""
    planes = max(map(abs, samples), default=0).bit_length()
    if not planes:
        return b"", 0, 0
    stride = width + 2
    target = [0] * (stride * (height + 2))
    for y in range(height):
        target[(y + 1) * stride + 1 : (y + 1) * stride + 1 + width] = samples[y * width : (y + 1) * width]
    coder = MQEncoder()
    passes = 3 * planes - 2
    Block(width, height, orient, coder, target).run(planes, passes)
    return coder.flush(), planes, passes
