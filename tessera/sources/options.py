"""Run options: the keys of an INI file as a dataclass."""

from __future__ import annotations

import re
from dataclasses import dataclass, fields


@dataclass
class Options:
    """Every key with its default (fixed values); a tile size of None means one tile."""

    tile_w: int | None = None
    tile_h: int | None = None
    tile_comp_dlvls: int = 4
    cblk_exp_w: int = 6
    cblk_exp_h: int = 6
    wavelet_type: int = 1
    use_mct: int = 0
    device: int = 0
    target_size: int = 0
    bp: float = 0.0
    use_part2_mct: int = 0
    mct_compression_method: int = 0
    mct_klt_iterations: int = 10000
    mct_klt_err: float = 1.0e-7
    mct_klt_border_eigenvalue: float = 0.000001


_PAIR = re.compile(r"([^=:;]*?)\s*[=:]\s*(.*)")
_COMMENT = re.compile(r"\s;.*")
_NUMBER = {int: re.compile(r"[+-]?\d+"), float: re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?")}


def _number(kind: type, text: str):
    """The number that a text starts with, 0 if there is none."""
    return kind(m[0]) if (m := _NUMBER[kind].match(text)) else kind(0)


def parse(text: str | None) -> Options:
    """Options of INI text.

    Sections don't matter, unknown keys and lines that say nothing are ignored, later values win. A line
    that is set in stands for a new value of the key before it. Values are read up to what is no number;
    without one they are 0. A tile size of 0 or less is no tiling. Null counts as empty.
    """
    out, kinds, key = Options(), {f.name: type(f.default) if f.default is not None else int for f in fields(Options)}, ""
    for line in (text or "").splitlines():
        said = line.strip()
        if key and said and line[0].isspace():
            value = said
        elif said.startswith((";", "#")):
            continue
        elif said.startswith("["):
            key = ""
            continue
        elif pair := _PAIR.fullmatch(_COMMENT.sub("", said).rstrip()):
            key, value = pair.groups()
        else:
            continue
        if key in kinds:
            setattr(out, key, _number(kinds[key], value))
    for size in ("tile_w", "tile_h"):
        if (getattr(out, size) or 0) <= 0:
            setattr(out, size, None)
    return out
