"""Black-oil closures as column expressions: relative permeability, capillary pressure, volume factors and viscosity.

A function table is a few dozen breakpoints, so it becomes a literal array in the
expression; rows aren't shuffled or joined. All curves are held at their ends.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def curve(x: Sequence[float], y: Sequence[float], q: Column) -> Column:
    """Linear interpolation by one CASE chain, held at both ends."""
    out = F.lit(float(y[-1]))
    for i in range(len(x) - 2, -1, -1):
        a, b, c, d = float(x[i]), float(x[i + 1]), float(y[i]), float(y[i + 1])
        out = F.when(q < b, F.lit(c) + (q - a) * ((d - c) / (b - a))).otherwise(out)
    return F.when(q <= float(x[0]), F.lit(float(y[0]))).otherwise(out)


def extended(x: Sequence[float], y: Sequence[float], q: Column) -> Column:
    """Linear interpolation that goes on along the end segments."""
    out = None
    for i in range(len(x) - 2, -1, -1):
        a, b, c, d = float(x[i]), float(x[i + 1]), float(y[i]), float(y[i + 1])
        line = F.lit(c) + (q - a) * ((d - c) / (b - a))
        out = line if out is None else F.when(q < b, line).otherwise(out)
    return F.lit(float(y[0])) if out is None else out


@dataclass(frozen=True)
class Tables:
    """Saturation and pressure tables of one region, as columns of numbers."""

    swof: dict[str, list[float]]  # sw, krw, krow, pcow
    sgof: dict[str, list[float]]  # sg, krg, krog, pcgo
    pvdg: dict[str, list[float]]  # p, fvf, visc
    pvto: dict[str, list[float]]  # rs, p, fvf, visc of saturated rows
    pvtw: dict[str, float]  # p, fvf, compr, visc, viscosibility

    def krw(self, sw: Column) -> Column:
        return curve(self.swof["sw"], self.swof["krw"], sw)

    def krow(self, sw: Column) -> Column:
        return curve(self.swof["sw"], self.swof["krow"], sw)

    def krg(self, sg: Column) -> Column:
        return curve(self.sgof["sg"], self.sgof["krg"], sg)

    def krog(self, sg: Column) -> Column:
        return curve(self.sgof["sg"], self.sgof["krog"], sg)

    def pcow(self, sw: Column) -> Column:
        return curve(self.swof["sw"], self.swof["pcow"], sw) if self.swof.get("pcow") else F.lit(0.0)

    def pcgo(self, sg: Column) -> Column:
        return curve(self.sgof["sg"], self.sgof["pcgo"], sg) if self.sgof.get("pcgo") else F.lit(0.0)

    def bg(self, p: Column) -> Column:
        return curve(self.pvdg["p"], self.pvdg["fvf"], p)

    def mug(self, p: Column) -> Column:
        return curve(self.pvdg["p"], self.pvdg["visc"], p)

    def bo(self, rs: Column) -> Column:
        return curve(self.pvto["rs"], self.pvto["fvf"], rs)

    def muo(self, rs: Column) -> Column:
        return curve(self.pvto["rs"], self.pvto["visc"], rs)

    def bw(self, p: Column) -> Column:
        t = self.pvtw
        return t["fvf"] / F.greatest(1 + t["compr"] * (p - t["p"]), F.lit(1e-6))

    def muw(self, p: Column) -> Column:
        t = self.pvtw
        return t["visc"] / F.greatest(1 - t.get("viscosibility", 0.0) * (p - t["p"]), F.lit(1e-6))

    @property
    def krc(self) -> float:
        """Oil's end point."""
        return max(self.swof["krow"][0], self.sgof["krog"][0], 1e-6)

    @property
    def residuals(self) -> tuple[float, float, float]:
        """(connate water, oil left by water, oil left by gas), by where a curve first is zero."""
        swc = self.swof["sw"][0]
        zero = lambda x, k: next((a for a, v in zip(x, k, strict=True) if v <= 0), x[-1])
        return swc, max(0.0, 1 - zero(self.swof["sw"], self.swof["krow"])), max(0.0, 1 - swc - zero(self.sgof["sg"], self.sgof["krog"]))

    def kro_stone2(self, sw: Column, sg: Column) -> Column:
        c, krw, krg = self.krc, self.krw(sw), self.krg(sg)
        return F.greatest(c * ((self.krow(sw) / c + krw) * (self.krog(sg) / c + krg) - (krw + krg)), F.lit(0.0))

    def kro_stone1(self, sw: Column, sg: Column) -> Column:
        swc, sorw, sorg = self.residuals
        low = F.lit(1e-9)
        alpha = 1 - sg / max(1 - swc - sorg, 1e-9)
        som = alpha * sorw + (1 - alpha) * sorg
        span = F.greatest(1 - swc - som, low)
        unit = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
        so_, sw_, sg_ = unit((1 - sw - sg - som) / span), unit((sw - swc) / span), unit(sg / span)
        top = so_ * self.krow(sw) * self.krog(sg)
        return F.greatest(top / (self.krc * F.greatest((1 - sw_) * (1 - sg_), low)), F.lit(0.0))

    def kro(self, sw: Column, sg: Column, model: str = "stone2") -> Column:
        return self.kro_stone1(sw, sg) if model == "stone1" else self.kro_stone2(sw, sg)

    def kro_baker(self, sw: Column, sg: Column) -> Column:
        """Saturation-weighted mean of the two-phase curves."""
        swc = self.swof["sw"][0]
        free = F.greatest(sw - swc, F.lit(0.0))
        total = free + sg
        return F.when(total > 1e-9, (free * self.krow(sw) + sg * self.krog(sg)) / total).otherwise(self.krow(sw))

    def phase_pressures(self, po: Column, sw: Column, sg: Column) -> dict[str, Column]:
        return {"p_o": po, "p_w": po - self.pcow(sw), "p_g": po + self.pcgo(sg), "s_o": 1 - sw - sg}

    def mobilities(self, po: Column, sw: Column, sg: Column, rs: Column, model: str = "stone2", floor: float = 0.0) -> dict[str, Column]:
        """``(kr + floor) / max(mu B, 1e-12)`` of each phase."""
        low = F.lit(1e-12)
        p = self.phase_pressures(po, sw, sg)
        return {
            "o": (self.kro(sw, sg, model) + floor) / F.greatest(self.muo(rs) * self.bo(rs), low),
            "w": (self.krw(sw) + floor) / F.greatest(self.muw(p["p_w"]) * self.bw(p["p_w"]), low),
            "g": (self.krg(sg) + floor) / F.greatest(self.mug(p["p_g"]) * self.bg(p["p_g"]), low),
        }


def in_place(volume: Column, poro: Column, saturation: Column, fvf: Column, beta: float = 1 / 5.614583) -> Column:
    """Surface volume in a cell: ``V beta phi S / B``; sum it for a field's total."""
    return volume * beta * poro * saturation / fvf
