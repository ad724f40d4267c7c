"""Index descriptions as strings, such as ``PCA64,IVF100,PQ8x8,RFlat``."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from itertools import product


@dataclass(frozen=True)
class IndexSpec:
    """What a description asks for; ``transforms`` in order of application."""

    kind: str
    d: int
    metric: str = "l2"
    binary: bool = False
    transforms: tuple[tuple[str, int], ...] = ()
    nlist: int = 0
    coarse: str = "flat"
    codec: str = "flat"
    m: int = 0
    nbits: int = 0
    links: int = 0
    refine: str | None = None
    id_map: bool = False
    options: tuple[str, ...] = field(default=())

    def code_size(self) -> int:
        """Bytes of one stored vector, list number and id aside."""
        d = next((n for name, n in reversed(self.transforms) if n > 0), self.d)
        if self.binary:
            return self.d // 8
        if self.codec == "flat":
            return 4 * d
        if self.codec in ("pq", "rq", "lsq"):
            return math.ceil(self.m * self.nbits / 8)
        if self.codec == "sq":
            return 2 * d if self.nbits == 16 else math.ceil(d * self.nbits / 8)
        return math.ceil(self.nbits / 8)

    def describe(self) -> str:
        """The string that gives this index."""
        if self.binary:
            return {"flat": "BFlat", "ivf": f"BIVF{self.nlist}", "hnsw": f"BHNSW{self.links}", "hash": f"BHash{self.nbits}", "multihash": f"BHash{self.m}x{self.nbits}"}[self.kind]
        parts = [f"{n}{v}" if n != "L2norm" else n for n, v in self.transforms]
        if self.nlist:
            parts.append(f"IMI{self.m_imi()}x{int(math.log2(self.nlist) // 2)}" if self.coarse == "imi" else f"IVF{self.nlist}" + (f"_HNSW{self.links}" if self.coarse == "hnsw" else ""))
        if self.kind == "hnsw":
            parts.append(f"HNSW{self.links}")
        names = {"flat": "Flat", "pq": f"PQ{self.m}x{self.nbits}", "rq": f"RQ{self.m}x{self.nbits}", "lsq": f"LSQ{self.m}x{self.nbits}", "sq": "SQfp16" if self.nbits == 16 else f"SQ{self.nbits}", "lsh": "LSH"}
        if not (self.kind == "hnsw" and self.codec == "flat"):
            parts.append(names[self.codec] + ("fs" if "fastscan" in self.options else ""))
        if self.refine:
            parts.append(self.refine)
        return ",".join((["IDMap"] if self.id_map else []) + parts)

    @staticmethod
    def m_imi() -> int:
        return 2


def parse(d: int, text: str, metric: str = "l2") -> IndexSpec:
    """The index that a description names; raises ValueError at what it can't read."""
    if text.startswith("B"):
        return _binary(d, text)
    out = {"kind": "flat", "d": d, "metric": metric}
    transforms, seen = [], False
    for part in text.split(","):
        if part in ("IDMap", "IDMap2"):
            out["id_map"] = True
        elif part in ("RFlat",) or re.fullmatch(r"Refine\(.+\)", part):
            out["refine"] = part
        elif m := re.fullmatch(r"(PCAWR|PCAW|PCAR|PCA|RR|ITQ|OPQ|Pad)(\d+)(?:_(\d+))?", part):
            transforms.append((m[1], int(m[3] or m[2]) if m[1] != "OPQ" or m[3] else d))
        elif part == "L2norm":
            transforms.append((part, 0))
        elif m := re.fullmatch(r"IVF(\d+)(k|M)?(?:_(HNSW|NSG)(\d+))?", part):
            out |= {"kind": "ivf", "nlist": int(m[1]) * {"k": 1024, "M": 1 << 20}.get(m[2], 1)} | ({"coarse": m[3].lower(), "links": int(m[4])} if m[3] else {})
        elif m := re.fullmatch(r"IMI2x(\d+)", part):
            out |= {"kind": "ivf", "nlist": 1 << 2 * int(m[1]), "coarse": "imi"}
        elif m := re.fullmatch(r"(HNSW|NSG)(\d+)", part):
            out |= {"kind": m[1].lower(), "links": int(m[2])}
            seen = True
        elif part == "Flat":
            seen = True
        elif m := re.fullmatch(r"(PQ|RQ|LSQ)(\d+)(?:x(\d+))?(fs|fsr)?(?:_\d+)?", part):
            out |= {"codec": m[1].lower(), "m": int(m[2]), "nbits": int(m[3] or 8)} | ({"options": ("fastscan",)} if m[4] else {})
            seen = True
        elif m := re.fullmatch(r"SQ(fp16|\d+)", part):
            out |= {"codec": "sq", "nbits": 16 if m[1] == "fp16" else int(m[1])}
            seen = True
        elif re.fullmatch(r"LSHr?t?", part):
            out |= {"codec": "lsh", "nbits": d, "options": tuple(x for x, on in (("rotate", "r" in part), ("train", "t" in part)) if on)}
            seen = True
        else:
            raise ValueError(f"can't read {part!r} in {text!r}")
    if not seen:
        raise ValueError(f"{text!r} names no storage")
    return IndexSpec(**out, transforms=tuple(transforms))


def _binary(d: int, text: str) -> IndexSpec:
    base = {"d": d, "binary": True, "metric": "hamming"}
    for pattern, make in (
        (r"BFlat", lambda m: {"kind": "flat"}), (r"BIVF(\d+)(?:_HNSW(\d+))?", lambda m: {"kind": "ivf", "nlist": int(m[1]), "links": int(m[2] or 0)}),
        (r"BHNSW(\d+)", lambda m: {"kind": "hnsw", "links": int(m[1])}), (r"BHash(\d+)", lambda m: {"kind": "hash", "nbits": int(m[1])}),
        (r"BHash(\d+)x(\d+)", lambda m: {"kind": "multihash", "m": int(m[1]), "nbits": int(m[2])}),
    ):
        if m := re.fullmatch(pattern, text):
            return IndexSpec(**base, **make(m))
    raise ValueError(f"can't read {text!r}")


@dataclass
class ParameterSpace:
    """Search-time parameters worth trying, and the operating points found so far."""

    ranges: dict[str, list[float]]

    @classmethod
    def of(cls, spec: IndexSpec) -> ParameterSpace:
        r: dict[str, list[float]] = {}
        if spec.nlist:
            r["nprobe"] = [1 << i for i in range(13) if 1 << i < spec.nlist]
        if spec.codec == "pq":
            bits = spec.m * spec.nbits
            r["ht"] = [*range(2, bits // 2 + 1, max(1, bits // 16)), bits + 1]
        if spec.coarse == "imi":
            r["max_codes"] = [1 << i for i in range(8, 20)] + [math.inf]
        if spec.refine:
            r["k_factor_rf"] = [1 << i for i in range(7)]
        if spec.kind == "hnsw":
            r["efSearch"] = [1 << i for i in range(2, 10)]
        return cls(r)

    def combinations(self) -> list[dict[str, float]]:
        return [dict(zip(self.ranges, c)) for c in product(*self.ranges.values())]

    def text(self, values: dict[str, float]) -> str:
        return ",".join(f"{k}={v:g}" for k, v in values.items())

    @staticmethod
    def values(text: str) -> dict[str, float]:
        return {k: float(v) for k, _, v in (x.partition("=") for x in text.split(",") if x)}

    @staticmethod
    def worth_trying(values: dict[str, float], tried: list[tuple[dict[str, float], float, float]]) -> bool:
        """Could a setting still be optimal? All-larger settings bound its quality, all-smaller ones its time."""
        above = [p for v, p, _ in tried if all(v[k] >= values[k] for k in values)]
        below = [t for v, _, t in tried if all(v[k] <= values[k] for k in values)]
        most, least = min(above, default=math.inf), max(below, default=0.0)
        return not any(p >= most and t <= least for _, p, t in tried)
