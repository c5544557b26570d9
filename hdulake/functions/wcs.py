"""World coordinates as column expressions: pixel to world and back, for celestial pairs and linear axes.

A ``Wcs`` is read from a header on the driver; its numbers become literals of the expressions, so a
transform is one projection inside code generation. Projections that need an iteration (inverse ZPN, AIR and PCO,
forward MOL) solve for a whole Arrow batch at a time, by Newton steps until nothing moves any more.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from hdulake.errors import HduError
from hdulake.sources.header import Header

D = 180 / math.pi
ZENITHAL = ("AZP", "SZP", "TAN", "STG", "SIN", "ARC", "ZPN", "ZEA", "AIR")
CONIC = ("COP", "COE", "COD", "COO")
OTHERS = ("CYP", "CEA", "CAR", "MER", "SFL", "PAR", "MOL", "AIT", "BON", "PCO")
#: Newton steps at most, and the step (radians) that counts as none.
NEWTON, STILL = 100, 1e-14
DEGREES = {"deg": 1.0, "arcmin": 1 / 60, "arcsec": 1 / 3600, "mas": 1 / 3.6e6, "rad": D}


def _sin(x):
    return F.sin(F.radians(x))


def _cos(x):
    return F.cos(F.radians(x))


def _clip(x: Column) -> Column:
    """x between -1 and 1; NaN, which Spark orders above all numbers, stays NaN."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)) + F.lit(0.0) * x


def _newton(start: np.ndarray, step: Callable[[np.ndarray], np.ndarray], low: float = -np.inf, high: float = np.inf) -> np.ndarray:
    """The roots that the steps (what to take off) lead to, kept between ``low`` and ``high``."""
    x = np.clip(np.asarray(start, dtype=np.float64), low, high)
    with np.errstate(all="ignore"):
        for _ in range(NEWTON):
            move = step(x)
            new = np.clip(x - np.where(np.isfinite(move), move, 0.0), low, high)
            still = np.nanmax(np.abs(new - x), initial=0.0) < STILL
            x = new
            if still:
                break
    return x


def _solved(f: Callable[..., np.ndarray], *columns: Column) -> Column:
    """f of the columns' batches; nulls and NaNs go in as NaN, and NaN comes out where any of them is."""

    read = lambda p: p.to_numpy(dtype=np.float64, na_value=np.nan)

    def one(p: pd.Series) -> pd.Series:
        return pd.Series(f(read(p)))

    def two(p: pd.Series, q: pd.Series) -> pd.Series:
        return pd.Series(f(read(p), read(q)))

    missing = F.lit(False)
    for c in columns:
        missing = missing | F.isnan(c)
    return F.when(missing, float("nan")).otherwise(F.pandas_udf(one if len(columns) == 1 else two, "double")(*columns))


def _zpn_zeta(pv: list[float]) -> Callable[[np.ndarray], np.ndarray]:
    c = np.array([float(v or 0.0) for v in pv] or [0.0])
    slope = c[1:] * np.arange(1, len(c))

    def solve(u: np.ndarray) -> np.ndarray:
        return _newton(u, lambda z: (np.polyval(c[::-1], z) - u) / np.polyval(slope[::-1], z))

    return solve


def _air_xi(k: float) -> Callable[[np.ndarray], np.ndarray]:
    def solve(u: np.ndarray) -> np.ndarray:
        def step(xi: np.ndarray) -> np.ndarray:
            log, tan = np.log(np.cos(xi)), np.tan(xi)
            return (-2 * (log / tan + k * tan) - u) / (-2 * (-1 - log / np.sin(xi) ** 2 + k / np.cos(xi) ** 2))

        return _newton(u / 2, step, 1e-9, math.pi / 2 - 1e-6)

    return solve


def _pco_theta(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    def step(t: np.ndarray) -> np.ndarray:
        f = u * u - 2 * (v - t) / np.tan(t) + (v - t) ** 2
        return f / (2 / np.tan(t) + 2 * (v - t) / np.sin(t) ** 2 - 2 * (v - t))

    return _newton(0.9 * v, step, -math.pi / 2 + 1e-9, math.pi / 2 - 1e-9)


def _mol_gamma(theta: np.ndarray) -> np.ndarray:
    """gamma with 2 gamma + sin 2 gamma = pi sin theta; sought as the distance e = pi - 2 gamma from the pole, where the root is threefold."""
    goal = 2 * math.pi * np.sin(np.radians(90.0 - np.abs(theta)) / 2) ** 2

    def step(e: np.ndarray) -> np.ndarray:
        # e - sin e, without cancelling where e is small
        f = np.where(e < 1e-2, e**3 / 6 * (1 - e**2 / 20 * (1 - e**2 / 42)), e - np.sin(e))
        return (f - goal) / (2 * np.sin(e / 2) ** 2)

    e = _newton(np.cbrt(6 * goal), step, 0.0, math.pi)
    return np.copysign((math.pi - e) / 2, theta)


def norm360(x: Column) -> Column:
    return x - F.lit(360.0) * F.floor(x / 360.0)


def _air_k(pv: list[float]) -> float:
    half = math.radians((90 - (pv[1] if len(pv) > 1 else 90.0)) / 2)
    return -0.5 if half == 0 else math.log(math.cos(half)) / math.tan(half) ** 2


def _conic(code: str, pv: list[float]) -> dict[str, float]:
    a, eta = math.radians(pv[1]), math.radians(pv[2] if len(pv) > 2 else 0.0)
    one, two = a - eta, a + eta
    if code == "COP":
        return {"a": a, "c": math.sin(a), "y0": D * math.cos(eta) / math.tan(a), "eta": eta}
    if code == "COE":
        s1, s2 = math.sin(one), math.sin(two)
        c = (s1 + s2) / 2
        return {"a": a, "c": c, "y0": D / c * math.sqrt(1 + s1 * s2 - 2 * c * math.sin(a)), "p": 1 + s1 * s2}
    if code == "COD":
        c = math.sin(a) * (math.sin(eta) / eta if eta else 1.0)
        return {"a": a, "c": c, "y0": D * (eta / math.tan(eta) if eta else 1.0) / math.tan(a)}
    c = math.sin(a) if not eta else math.log(math.cos(two) / math.cos(one)) / math.log(math.tan(math.pi / 4 - two / 2) / math.tan(math.pi / 4 - one / 2))
    psi = D * math.cos(one) / (c * math.tan(math.pi / 4 - one / 2) ** c)
    return {"a": a, "c": c, "y0": psi * math.tan(math.pi / 4 - a / 2) ** c, "psi": psi}


def _pv(pv: list[float], k: int, default: float = 0.0) -> float:
    return pv[k] if len(pv) > k and pv[k] is not None else default


def project(code: str, phi: Column, theta: Column, pv: list[float]) -> tuple[Column, Column]:
    """Native spherical coordinates to the plane, all in degrees."""
    t, zeta = F.radians(theta), F.radians(90.0 - theta)
    if code == "AZP":
        mu, gamma = _pv(pv, 1), math.radians(_pv(pv, 2))
        r = D * (mu + 1) * F.cos(t) / ((mu + F.sin(t)) + F.cos(t) * _cos(phi) * math.tan(gamma))
        return r * _sin(phi), -r * _cos(phi) / math.cos(gamma)
    if code == "SZP":
        xp, yp, zp = _szp(pv)
        s = 1 - F.sin(t)
        return D * (zp * F.cos(t) * _sin(phi) - xp * s) / (zp - s), D * (-zp * F.cos(t) * _cos(phi) - yp * s) / (zp - s)
    if code in ZENITHAL:
        if code == "ZPN":
            r = F.lit(0.0)
            for c in reversed(pv):
                r = r * zeta + F.lit(float(c or 0.0))
            r = D * r
        elif code == "AIR":
            xi = zeta / 2
            r = F.when(zeta < 1e-12, 0.0).otherwise(-2 * D * (F.log(F.cos(xi)) / F.tan(xi) + _air_k(pv) * F.tan(xi)))
        else:
            r = D * {"TAN": lambda: F.tan(zeta), "SIN": lambda: F.sin(zeta), "ARC": lambda: zeta, "ZEA": lambda: 2 * F.sin(zeta / 2), "STG": lambda: 2 * F.tan(zeta / 2)}[code]()
        return r * _sin(phi), -r * _cos(phi)
    if code in CONIC:
        k = _conic(code, pv)
        r = {
            "COP": lambda: D * math.cos(k["eta"]) * (1 / math.tan(k["a"]) - F.tan(t - k["a"])),
            "COE": lambda: D / k["c"] * F.sqrt(k["p"] - 2 * k["c"] * F.sin(t)),
            "COD": lambda: k["y0"] + D * k["a"] - theta,
            "COO": lambda: k["psi"] * F.pow(F.tan(math.pi / 4 - t / 2), F.lit(k["c"])),
        }[code]()
        return r * _sin(k["c"] * phi), k["y0"] - r * _cos(k["c"] * phi)
    if code == "BON":
        t1 = math.radians(_pv(pv, 1))
        if t1 == 0:
            return project("SFL", phi, theta, pv)
        y0 = t1 + 1 / math.tan(t1)
        r = y0 - t
        a = F.radians(phi) * F.cos(t) / r
        return D * r * F.sin(a), D * (y0 - r * F.cos(a))
    if code == "PCO":
        w = F.radians(phi) * F.sin(t)
        cot = 1 / F.tan(t)
        return F.when(theta == 0, phi).otherwise(D * cot * F.sin(w)), F.when(theta == 0, 0.0).otherwise(theta + D * cot * (1 - F.cos(w)))
    if code == "MOL":
        g = _solved(_mol_gamma, theta.cast("double"))
        return 2 * math.sqrt(2) / math.pi * phi * F.cos(g), math.sqrt(2) * D * F.sin(g)
    if code == "AIT":
        half = F.radians(phi) / 2
        g = D * F.sqrt(2 / (1 + F.cos(t) * F.cos(half)))
        return 2 * g * F.cos(t) * F.sin(half), g * F.sin(t)
    mu, lam = _pv(pv, 1), _pv(pv, 2) or 1.0
    return {
        "CAR": lambda: (phi, theta),
        "CEA": lambda: (phi, D * F.sin(t) / (_pv(pv, 1) or 1.0)),
        "MER": lambda: (phi, D * F.log(F.tan(math.pi / 4 + t / 2))),
        "CYP": lambda: (lam * phi, D * (mu + lam) * F.sin(t) / (mu + F.cos(t))),
        "SFL": lambda: (phi * F.cos(t), theta),
        "PAR": lambda: (phi * (2 * F.cos(2 * t / 3) - 1), 180 * F.sin(t / 3)),
    }[code]()


def _szp(pv: list[float]) -> tuple[float, float, float]:
    mu, pc, tc = _pv(pv, 1), math.radians(_pv(pv, 2)), math.radians(_pv(pv, 3, 90.0))
    return -mu * math.cos(tc) * math.sin(pc), mu * math.cos(tc) * math.cos(pc), mu * math.sin(tc) + 1


def deproject(code: str, x: Column, y: Column, pv: list[float]) -> tuple[Column, Column]:
    """The plane to native spherical coordinates, all in degrees."""
    if code == "AZP":
        mu, gamma = _pv(pv, 1), math.radians(_pv(pv, 2))
        r = F.sqrt(x * x + y * y * math.cos(gamma) ** 2)
        phi = F.degrees(F.atan2(x, -y * math.cos(gamma)))
        rho = r / (D * (mu + 1) + y * math.sin(gamma))

        def latitude(p: Column) -> Column:
            one, two = p["one"], F.when(p["two"] > 180, p["two"] - 360).otherwise(p["two"])
            best = F.when(F.abs(one - 90) <= F.abs(two - 90), one).otherwise(two)
            return F.when(one.between(-90, 90) & ~two.between(-90, 90), one).when(two.between(-90, 90) & ~one.between(-90, 90), two).otherwise(best)

        def candidates(p: Column) -> Column:
            psi, w = F.degrees(F.atan2(F.lit(1.0), p)), F.degrees(F.asin(_clip(p * mu / F.sqrt(p * p + 1))))
            return F.struct((psi - w).alias("one"), (psi + w + 180).alias("two"))

        # both solutions are bound, so the choice between them doesn't repeat what they are made of
        return phi, F.get(F.transform(F.transform(F.array(rho), candidates), latitude), F.lit(0))
    if code == "SZP":
        xp, yp, zp = _szp(pv)
        u, v = x / D, y / D
        a, b = (u - xp) / zp, (v - yp) / zp
        # with s = 1 - sin(theta): (u - a s)^2 + (v - b s)^2 = 1 - (1 - s)^2
        qa, qb, qc = a * a + b * b + 1, u * a + v * b + 1, u * u + v * v
        s = (qb - F.sqrt(F.greatest(qb * qb - qa * qc, F.lit(0.0)))) / qa
        return F.degrees(F.atan2(u - a * s, -(v - b * s))), F.degrees(F.asin(_clip(1 - s)))
    if code in ZENITHAL:
        r = F.sqrt(x * x + y * y)
        phi = F.when(r == 0, 0.0).otherwise(F.degrees(F.atan2(x, -y)))
        u = r / D
        if code == "ZPN":
            return phi, 90.0 - F.degrees(_solved(_zpn_zeta(pv), u))
        if code == "AIR":
            return phi, F.when(u == 0, 90.0).otherwise(90.0 - F.degrees(2 * _solved(_air_xi(_air_k(pv)), u)))
        zeta = {"TAN": lambda: F.atan(u), "SIN": lambda: F.asin(_clip(u)), "ARC": lambda: u, "ZEA": lambda: 2 * F.asin(_clip(u / 2)), "STG": lambda: 2 * F.atan(u / 2)}[code]()
        return phi, 90.0 - F.degrees(zeta)
    if code in CONIC:
        k = _conic(code, pv)
        sign = math.copysign(1.0, k["a"])
        r = sign * F.sqrt(x * x + (k["y0"] - y) * (k["y0"] - y))
        phi = F.degrees(F.atan2(sign * x, sign * (k["y0"] - y))) / k["c"]
        theta = {
            "COP": lambda: F.degrees(k["a"] + F.atan(1 / math.tan(k["a"]) - r / (D * math.cos(k["eta"])))),
            "COE": lambda: F.degrees(F.asin(_clip((k["p"] - F.pow(r * k["c"] / D, F.lit(2.0))) / (2 * k["c"])))),
            "COD": lambda: k["y0"] + D * k["a"] - r,
            "COO": lambda: F.degrees(math.pi / 2 - 2 * F.atan(F.pow(r / k["psi"], F.lit(1 / k["c"])))),
        }[code]()
        return phi, theta
    if code == "BON":
        t1 = math.radians(_pv(pv, 1))
        if t1 == 0:
            return deproject("SFL", x, y, pv)
        y0 = D * (t1 + 1 / math.tan(t1))
        sign = math.copysign(1.0, t1)
        r = sign * F.sqrt(x * x + (y0 - y) * (y0 - y))
        a = F.atan2(sign * x, sign * (y0 - y))
        theta = y0 - r
        return F.when(F.abs(theta) >= 90, 0.0).otherwise(a * r / _cos(theta)), theta
    if code == "PCO":
        u, v = x / D, y / D
        t = _solved(_pco_theta, u, v)
        w = F.atan2(u * F.tan(t), 1 - (v - t) * F.tan(t))
        return F.when(F.abs(y) < 1e-12, x).otherwise(F.degrees(w / F.sin(t))), F.when(F.abs(y) < 1e-12, 0.0).otherwise(F.degrees(t))
    if code == "MOL":
        g = F.asin(_clip(y / (math.sqrt(2) * D)))
        theta = F.degrees(F.asin(_clip((2 * g + F.sin(2 * g)) / math.pi)))
        return F.when(F.abs(F.cos(g)) < 1e-12, 0.0).otherwise(math.pi * x / (2 * math.sqrt(2) * F.cos(g))), theta
    if code == "AIT":
        z = F.sqrt(F.greatest(1 - F.pow(x / (4 * D), F.lit(2.0)) - F.pow(y / (2 * D), F.lit(2.0)), F.lit(0.0)))
        return F.degrees(2 * F.atan2(z * x / (2 * D), 2 * z * z - 1)), F.degrees(F.asin(_clip(y * z / D)))
    mu, lam = _pv(pv, 1), _pv(pv, 2) or 1.0

    def cyp() -> tuple[Column, Column]:
        eta = y / (D * (mu + lam))
        return x / lam, F.degrees(F.atan2(eta, F.lit(1.0)) + F.asin(_clip(eta * mu / F.sqrt(eta * eta + 1))))

    def par() -> tuple[Column, Column]:
        s = y / 180
        return x / (1 - 4 * s * s), F.degrees(3 * F.asin(_clip(s)))

    return {
        "CAR": lambda: (x, y),
        "CEA": lambda: (x, F.degrees(F.asin(_clip(y / D * (_pv(pv, 1) or 1.0))))),
        "MER": lambda: (x, F.degrees(2 * F.atan(F.exp(y / D))) - 90),
        "CYP": cyp,
        "SFL": lambda: (F.when(F.abs(y) >= 90, 0.0).otherwise(x / _cos(y)), y),
        "PAR": par,
    }[code]()


def invert(matrix: list[list[float]]) -> list[list[float]]:
    """Gauss-Jordan with partial pivoting; a pivot under 1e-300 makes the matrix singular."""
    n = len(matrix)
    a = np.hstack([np.array(matrix, dtype=float), np.eye(n)])
    for i in range(n):
        p = i + int(np.abs(a[i:, i]).argmax())
        if abs(a[p, i]) < 1e-300:
            raise HduError("InvalidValue", "the linear transform is singular")
        a[[i, p]] = a[[p, i]]
        a[i] /= a[i, i]
        for j in range(n):
            if j != i:
                a[j] -= a[j, i] * a[i]
    return a[:, n:].tolist()


#: Fixed by the format: the types of spectral axes.
SPECTRAL = ("FREQ", "ENER", "WAVN", "VRAD", "WAVE", "VOPT", "ZOPT", "AWAV", "VELO", "BETA")
#: Fixed by the format: keywords of an image, of a list of pixels in table columns, and of images in a column's cells.
#: {i} and {j} are axes (or their columns), {m} a parameter, {n} the column, {a} the alternate description.
_IMAGE = {"ctype": ["CTYPE{i}{a}"], "crpix": ["CRPIX{i}{a}"], "crval": ["CRVAL{i}{a}"], "cdelt": ["CDELT{i}{a}"], "crota": ["CROTA{i}"], "cunit": ["CUNIT{i}{a}"], "pc": ["PC{i}_{j}{a}"], "cd": ["CD{i}_{j}{a}"], "pv": ["PV{i}_{m}{a}"], "lonpole": ["LONPOLE{a}"], "latpole": ["LATPOLE{a}"]}
_PIXEL_LIST = {"ctype": ["TCTYP{i}{a}"], "crpix": ["TCRPX{i}{a}"], "crval": ["TCRVL{i}{a}"], "cdelt": ["TCDLT{i}{a}"], "crota": ["TCROT{i}{a}"], "cunit": ["TCUNI{i}{a}"], "pc": ["TPC{i}_{j}{a}"], "cd": ["TCD{i}_{j}{a}"], "pv": ["TPV{i}_{m}{a}"], "lonpole": ["LONP{a}"], "latpole": ["LATP{a}"]}
_ARRAY = {"ctype": ["{i}CTYP{n}{a}"], "crpix": ["{i}CRPX{n}{a}"], "crval": ["{i}CRVL{n}{a}"], "cdelt": ["{i}CDLT{n}{a}"], "crota": ["{i}CROT{n}{a}"], "cunit": ["{i}CUNI{n}{a}"], "pc": ["{i}{j}PC{n}{a}"], "cd": ["{i}{j}CD{n}{a}"], "pv": ["{i}PV{n}_{m}{a}", "{i}V{n}_{m}{a}"], "lonpole": ["LONPOLE{a}"], "latpole": ["LATPOLE{a}"]}


@dataclass
class Keywords:
    """A header's coordinate keywords by what they mean; ``axes`` are the numbers that the family writes for each axis."""

    header: Header
    family: dict[str, list[str]]
    axes: list[int]
    column: int | None
    alt: str

    def _find(self, read, key: str, first: int | None, second: int | None, default):
        i = None if first is None else self.axes[first]
        j = self.axes[second] if second is not None and key in ("pc", "cd") else None
        for form in self.family[key]:
            v = read(form.format(i=i, j=j, m=second, n=self.column, a=self.alt))
            if v is not None:
                return v
        return default

    def real(self, key: str, first: int | None = None, second: int | None = None, default: float | None = None) -> float | None:
        return self._find(self.header.real, key, first, second, default)

    def text(self, key: str, first: int) -> str | None:
        return self._find(self.header.text, key, first, None, None)


@dataclass
class Wcs:
    crpix: list[float]
    crval: list[float]
    matrix: list[list[float]]
    ctype: list[str]
    lng: int | None = None
    lat: int | None = None
    code: str | None = None
    pv: list[float] = field(default_factory=list)
    pole: tuple[float, float, float] = (0.0, 0.0, 0.0)
    unsupported: list[int] = field(default_factory=list)

    @classmethod
    def from_header(cls, h: Header, alt: str = "") -> Wcs:
        n = h.integer(f"WCSAXES{alt}", h.integer("NAXIS", 0)) or 0
        return cls._read(Keywords(h, _IMAGE, list(range(1, n + 1)), None, alt))

    @classmethod
    def from_pixel_list(cls, h: Header, columns: list[int], alt: str = "") -> Wcs:
        """Of table columns (numbered from 1) whose rows are the places of events, in the order of the axes."""
        return cls._read(Keywords(h, _PIXEL_LIST, list(columns), None, alt))

    @classmethod
    def from_array_column(cls, h: Header, column: int, alt: str = "") -> Wcs:
        """Of a table column whose cells are images. The rank is WCAXn, or the highest axis up to 99 that a keyword names."""
        n = h.integer(f"WCAX{column}{alt}", 0)
        if n <= 0:
            named = [i for i in range(1, 100) if h.text(f"{i}CTYP{column}{alt}") is not None or any(h.real(f"{i}{k}{column}{alt}") is not None for k in ("CRVL", "CDLT", "CRPX"))]
            n = max(named, default=0)
        if not n:
            raise HduError("MissingKeyword", "iCTYPn")
        if n > 999:
            raise HduError("KeywordOutOfRange", "WCAXn")
        return cls._read(Keywords(h, _ARRAY, list(range(1, n + 1)), column, alt))

    @classmethod
    def _read(cls, keys: Keywords) -> Wcs:
        n = len(keys.axes)
        if not 1 <= n <= 999:
            raise HduError("KeywordOutOfRange", "WCSAXES")
        each, axes = range(n), [(i, j) for i in range(n) for j in range(n)]
        ctype = [keys.text("ctype", i) or "" for i in each]
        crpix, crval = ([keys.real(k, i, default=0.0) for i in each] for k in ("crpix", "crval"))
        cdelt = [keys.real("cdelt", i, default=1.0) for i in each]
        cd, pc = ({p: keys.real(k, *p) for p in axes} for k in ("cd", "pc"))
        turned = [keys.real("crota", i) for i in each]
        has_cd, has_pc, has_rota = (any(v is not None for v in vs) for vs in (cd.values(), pc.values(), turned))
        if has_pc and (has_cd or has_rota):
            raise HduError("ConflictingWcsKeywords")
        out = cls(crpix, crval, [], ctype)
        out._find_pair()
        if has_cd:
            m = [[cd[i, j] or 0.0 for j in each] for i in each]
        else:
            m = [[cdelt[i] * (pc[i, j] if pc[i, j] is not None else float(i == j)) for j in each] for i in each]
            if has_rota and not has_pc and out.lng is not None:
                a, b = out.lng, out.lat
                rho = math.radians(turned[b] or 0.0)
                m[a][a], m[a][b] = cdelt[a] * math.cos(rho), -cdelt[b] * math.sin(rho)
                m[b][a], m[b][b] = cdelt[a] * math.sin(rho), cdelt[b] * math.cos(rho)
        if out.lng is not None:
            for axis in (out.lng, out.lat):
                unit = DEGREES.get((keys.text("cunit", axis) or "deg").strip(), 1.0)
                m[axis] = [v * unit for v in m[axis]]
                crval[axis] *= unit
        out.matrix = m
        if out.lng is not None:
            out._set_pole(keys)
        return out

    def _find_pair(self) -> None:
        lng = lat = None
        for i, c in enumerate(self.ctype):
            head, code = c.partition("-")[0].rstrip(), c.rpartition("-")[2].strip() if "-" in c else ""
            east, north = head == "RA" or head[1:] == "LON" or head[2:] == "LN", head == "DEC" or head[1:] == "LAT" or head[2:] == "LT"
            if east or north:
                if len(code) == 3 and code not in ZENITHAL + CONIC + OTHERS:
                    self.unsupported.append(i)
                elif code in ZENITHAL + CONIC + OTHERS:
                    lng, lat = (i, lat) if east else (lng, i)
            elif head in SPECTRAL and c[5:].strip():
                self.unsupported.append(i)
        if lng is None or lat is None:
            return
        if self.ctype[lng].rpartition("-")[2].strip() != self.ctype[lat].rpartition("-")[2].strip():
            raise HduError("InvalidValue", "the axes of a pair name different projections")
        self.lng, self.lat, self.code = lng, lat, self.ctype[lng].rpartition("-")[2].strip()

    def _set_pole(self, keys: Keywords) -> None:
        a, b = self.lng, self.lat
        given = [keys.real("pv", b, m) for m in range(21)]
        last = max((m for m, v in enumerate(given) if v is not None), default=-1)
        self.pv = [v or 0.0 for v in given[: last + 1]]
        if self.code in CONIC and not _pv(self.pv, 1):
            self.unsupported += [self.lng, self.lat]
            self.lng = self.lat = self.code = None
            return
        theta0 = 90.0 if self.code in ZENITHAL else _pv(self.pv, 1) if self.code in CONIC else 0.0
        phi0 = keys.real("pv", a, 1, default=0.0)
        theta0 = keys.real("pv", a, 2, default=theta0)
        alpha0, delta0 = self.crval[self.lng], self.crval[self.lat]
        phip = keys.real("pv", a, 3, default=keys.real("lonpole", default=phi0 if delta0 >= theta0 else phi0 + 180.0))
        latpole = keys.real("pv", a, 4, default=keys.real("latpole", default=90.0))
        self.pole = pole_of(alpha0, delta0, phi0, theta0, phip, latpole)

    @property
    def naxis(self) -> int:
        return len(self.crpix)

    def pixel_to_world(self, *pixel: Column) -> list[Column]:
        """World coordinates of 1-based pixel coordinates."""
        if len(pixel) != self.naxis:
            raise ValueError("one coordinate for each axis is needed")
        step = [p - F.lit(c) for p, c in zip(pixel, self.crpix, strict=True)]
        middle = [_dot(row, step) for row in self.matrix]
        world = [m + F.lit(v) for m, v in zip(middle, self.crval, strict=True)]
        if self.code:
            phi, theta = deproject(self.code, middle[self.lng], middle[self.lat], self.pv)
            world[self.lng], world[self.lat] = to_sky(phi, theta, self.pole)
        return world

    def world_to_pixel(self, *world: Column) -> list[Column]:
        if len(world) != self.naxis:
            raise ValueError("one coordinate for each axis is needed")
        middle = [w - F.lit(v) for w, v in zip(world, self.crval, strict=True)]
        if self.code:
            phi, theta = from_sky(world[self.lng], world[self.lat], self.pole)
            middle[self.lng], middle[self.lat] = project(self.code, phi, theta, self.pv)
        return [_dot(row, middle) + F.lit(c) for row, c in zip(invert(self.matrix), self.crpix, strict=True)]


def _dot(row: list[float], columns: list[Column]) -> Column:
    out = None
    for k, c in zip(row, columns, strict=True):
        if k:
            out = F.lit(k) * c if out is None else out + F.lit(k) * c
    return F.lit(0.0) if out is None else out


def pole_of(alpha0: float, delta0: float, phi0: float, theta0: float, phip: float, latpole: float) -> tuple[float, float, float]:
    """Celestial coordinates of the native pole and the native longitude of the celestial pole."""
    if theta0 == 90:
        return alpha0, delta0, phip
    rad = math.radians
    d = rad(phip - phi0)
    st, ct, sd = math.sin(rad(theta0)), math.cos(rad(theta0)), math.sin(rad(delta0))
    z = math.sqrt(max(0.0, 1 - ct**2 * math.sin(d) ** 2))
    if z == 0:
        deltap = latpole
    else:
        middle, off = math.degrees(math.atan2(st, ct * math.cos(d))), math.degrees(math.acos(max(-1.0, min(1.0, sd / z))))
        roots = [(x + 180) % 360 - 180 for x in (middle + off, middle - off)]
        fine = [x for x in roots if -90 - 1e-10 <= x <= 90 + 1e-10] or [max(-90.0, min(90.0, roots[0]))]
        deltap = min(fine, key=lambda x: abs(x - latpole))
    deltap = max(-90.0, min(90.0, deltap))
    if abs(math.cos(rad(delta0))) < 1e-12:
        alphap = alpha0
    elif deltap >= 90 - 1e-12:
        alphap = alpha0 + phip - phi0 - 180
    elif deltap <= -90 + 1e-12:
        alphap = alpha0 - phip + phi0
    else:
        y = math.sin(d) * ct / math.cos(rad(delta0))
        x = (st - math.sin(rad(deltap)) * sd) / (math.cos(rad(deltap)) * math.cos(rad(delta0)))
        alphap = alpha0 - math.degrees(math.atan2(y, x))
    return alphap, deltap, phip


def to_sky(phi: Column, theta: Column, pole: tuple[float, float, float]) -> tuple[Column, Column]:
    ap, dp, pp = pole
    s, c = math.sin(math.radians(dp)), math.cos(math.radians(dp))
    d = phi - pp
    lat = F.degrees(F.asin(_clip(_sin(theta) * s + _cos(theta) * _cos(d) * c)))
    lng = ap + F.degrees(F.atan2(-_cos(theta) * _sin(d), _sin(theta) * c - _cos(theta) * _cos(d) * s))
    return norm360(lng), lat


def from_sky(lng: Column, lat: Column, pole: tuple[float, float, float]) -> tuple[Column, Column]:
    ap, dp, pp = pole
    s, c = math.sin(math.radians(dp)), math.cos(math.radians(dp))
    d = lng - ap
    theta = F.degrees(F.asin(_clip(_sin(lat) * s + _cos(lat) * _cos(d) * c)))
    phi = pp + F.degrees(F.atan2(-_cos(lat) * _sin(d), _sin(lat) * c - _cos(lat) * _cos(d) * s))
    turned = phi - F.lit(360.0) * F.floor((phi + 180.0) / 360.0)
    return turned, theta
