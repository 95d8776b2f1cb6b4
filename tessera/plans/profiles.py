"""Encoder parameters: defaults, validation, and rules of profiles."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Bytes of a frame at 24 frames a second and 250 Mbit/s.
CINEMA_24 = 1_302_083
CINEMA_48 = 651_041


@dataclass
class EncoderParameters:
    numres: int = 6
    cblkw: int = 64
    cblkh: int = 64
    order: str = "LRCP"
    layers: int = 1
    guard_bits: int = 2
    irreversible: bool = False
    mct: int = 1
    tile: tuple[int, int] | None = None
    rates: list[float] = field(default_factory=list)
    max_bytes: int = 0

    def problems(self) -> list[str]:
        out = []
        if not 1 <= self.numres <= 33:
            out.append("1 to 33 resolutions")
        if not 1 <= self.layers <= 256:
            out.append("1 to 256 layers")
        for n in (self.cblkw, self.cblkh):
            if n & (n - 1) or not 4 <= n <= 1024:
                out.append("block sides are powers of two from 4 to 1024")
        if self.cblkw * self.cblkh > 4096:
            out.append("at most 4096 samples in a block")
        if self.order not in ("LRCP", "RLCP", "RPCL", "PCRL", "CPRL", "PRCL"):
            out.append("unknown progression")
        if any(b >= a for a, b in zip(self.rates, self.rates[1:], strict=False)):
            out.append("rates must fall")
        return out


def cinema(params: EncoderParameters, width: int, height: int, comps: int, prec: int, four_k: bool = False, fps: int = 24) -> list[str]:
    """What keeps an image and its parameters from the cinema profiles."""
    w, h, res = (4096, 2160, 7) if four_k else (2048, 1080, 6)
    rules = [
        (width <= w and height <= h, f"at most {w} x {h}"), (comps == 3, "three components"), (prec == 12, "12 bits"), (params.irreversible, "irreversible kernel"),
        (params.numres <= res, f"at most {res} resolutions"), (params.order == "CPRL", "CPRL"), (params.layers == 1, "one layer"), ((params.cblkw, params.cblkh) == (32, 32), "blocks of 32 x 32"),
        (0 < params.max_bytes <= (CINEMA_24 if fps == 24 else CINEMA_48), "size of a frame"),
    ]
    return [text for ok, text in rules if not ok]


def imf(params: EncoderParameters, width: int, height: int, main_level: int, comps: int, prec: int) -> list[str]:
    side = 2048 if main_level <= 3 else 4096 if main_level <= 6 else 8192
    rules = [(width <= side, f"at most {side} across"), (comps in (1, 3), "one or three components"), (8 <= prec <= 16, "8 to 16 bits"), (params.cblkw <= 32 and params.cblkh <= 32, "blocks up to 32 x 32"), (0 <= main_level <= 11, "main level 0 to 11")]
    return [text for ok, text in rules if not ok]


def broadcast(params: EncoderParameters, comps: int, prec: int, level: int) -> list[str]:
    rules = [(1 <= level <= 7, "level 1 to 7"), (comps <= 4, "at most four components"), (8 <= prec <= 12, "8 to 12 bits"), (params.order == "CPRL", "CPRL"), (params.numres <= 6, "at most 6 resolutions"), (all(7 >= n.bit_length() - 1 >= 5 for n in (params.cblkw, params.cblkh)), "blocks of 32 to 128")]
    return [text for ok, text in rules if not ok]
