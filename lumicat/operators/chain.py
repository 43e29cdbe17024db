"""Ordered chains of pixel stages: the whole of a development's colour work as one row expression.

A chain is a list of stages.  Each turns r, g, b (0..65535) into new ones, for the pixels its ``where`` holds for (any
predicate over the row, such as a field of the frame's parameter record).  Curves are cut into tables of a few hundred entries
once, when the stage is made, and lie in the plan as one array each.  A chain adds no exchange and no Python: all stages run in
one code generation span, and values that a stage uses more than once are columns of their own, so they are computed once.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import appearance
from ..functions import formulas as S
from ..functions.curves import lookup, sampled

Curve = Callable[[float], float]
Steps = list[dict[str, Column]]

#: Entries of a stage's tables.
SIZE = 256
#: The lightness 40 "of middle chroma" that scales lightness by hue, what lightness loses by hue, how far hue moves
#: by hue, and where the effect of lightness by chroma ends and how strong it is.
CHROMA_UNIT, DARKER, TURN, LOW_CHROMA, SOFT = 40.0, 1.9, 1.7, 50.0, 0.25
#: Hue in Lab (radians, from) to position on the hue circle of curves, as (from, slope, offset).
HUE_PIECES = ((-3.14159, 0.23419, 1.1557), (-2.8, 0.16, 0.948), (-2.3, 0.12143, 0.85928), (-0.9, 0.2125, 0.94125), (-0.1, 0.1, 0.93), (0.0, 0.11666, 0.93), (0.6, 0.1125, -0.0675), (1.4, 0.2666, -0.2833), (2.0, 0.1489, -0.04785))


class Scratch:
    """Names for a stage's own columns that no column of the row has."""

    def __init__(self, prefix: str):
        self.prefix = prefix

    def __call__(self, name: str) -> str:
        return f"{self.prefix}{name}"

    def named(self, values: Sequence[str], names: str) -> dict[str, Column]:
        return {self(n): F.expr(v) for n, v in zip(names.split(), values, strict=True)}

    def renamed(self, stages: list[dict[str, str]]) -> Steps:
        """Stages of SQL text with their own column names put under this prefix."""
        names = sorted({n for s in stages for n in s}, key=len, reverse=True)
        mine = re.compile(r"\b(" + "|".join(map(re.escape, names)) + r")\b(?!\()")
        return [{self(n): F.expr(mine.sub(lambda m: self(m[1]), e)) for n, e in s.items()} for s in stages]


def table_of(curve: Curve | Sequence[float] | None) -> list[float] | None:
    """A curve on 0..1 as a table; what is a table already stays."""
    return None if curve is None else sampled(curve, SIZE) if callable(curve) else list(curve)


def through(table: Sequence[float], at: Column) -> Column:
    """A table on 0..1, constant beyond its ends."""
    return lookup(table, at * float(len(table) - 1))


def _inside(c: Column) -> Column:
    return c.between(0.0, 65535.0)


@dataclass(frozen=True)
class Stage:
    where: str | None = field(default=None, kw_only=True)

    def steps(self, at: Scratch, r: str, g: str, b: str) -> Steps:
        """Columns to add one after the other; the last step has those of the result, ``at("r")``, ``at("g")``, ``at("b")``."""
        raise NotImplementedError


@dataclass(frozen=True)
class Mix(Stage):
    """Channels as weighted sums of channels."""

    matrix: S.Matrix

    def steps(self, at, r, g, b):
        return [at.named(S.matrix3(self.matrix, r, g, b), "r g b")]


@dataclass(frozen=True)
class Exposure(Stage):
    """A gain in stops over a black point (a share of the range)."""

    stops: float = 0.0
    black: float = 0.0

    def steps(self, at, r, g, b):
        return [{at(n): (F.col(c) - 65535.0 * self.black) * 2.0**self.stops / (1 - self.black) for n, c in zip("rgb", (r, g, b), strict=True)}]


@dataclass(frozen=True)
class Tone(Stage):
    """A tone curve.

    ``standard``: each channel by itself, where one of them lies inside the range; ``luminance``: channels scaled by the change of
    luminance; ``film``: the largest and smallest channel by the curve, the middle one at its place between them;
    ``perceptual``: lightness in the appearance model moves as luminance does, chroma and hue stay.
    """

    curve: Curve | Sequence[float]
    mode: str = "standard"
    viewing: appearance.Viewing = field(default_factory=lambda: appearance.Viewing(white=(96.42, 100.0, 82.49)))

    def steps(self, at, r, g, b):
        table = table_of(self.curve)
        curved = lambda c: through(table, c / 65535.0) * 65535.0
        if self.mode == "standard":
            some = _inside(F.col(r)) | _inside(F.col(g)) | _inside(F.col(b))
            return [{at("some"): some}, {at(n): F.when(F.col(at("some")), curved(F.col(c))).otherwise(F.col(c)) for n, c in zip("rgb", (r, g, b), strict=True)}]
        if self.mode == "film":
            low, top = F.least(r, g, b), F.greatest(r, g, b)
            ends = {at("low"): low, at("top"): top, at("to_low"): curved(low), at("to_top"): curved(top)}
            share = lambda c: F.coalesce(F.try_divide(F.col(c) - F.col(at("low")), F.col(at("top")) - F.col(at("low"))), F.lit(0.0))
            return [ends, {at(n): F.col(at("to_low")) + (F.col(at("to_top")) - F.col(at("to_low"))) * share(c) for n, c in zip("rgb", (r, g, b), strict=True)}]
        if self.mode not in ("luminance", "perceptual"):
            raise ValueError(f"no tone mode {self.mode}")
        gain = [{at("y"): F.expr(S.luminance(r, g, b))}, {at("to"): curved(F.col(at("y")))}]
        scaled = [at.named(S.rgb_scaled_by(r, g, b, at("y"), at("to")), "r g b" if self.mode == "luminance" else "sr sg sb")]
        if self.mode == "luminance":
            return gain + scaled
        model = lambda by, rgb: by.renamed([dict(zip(("k_x", "k_y", "k_z"), (f"({e} / 655.35e0)" for e in S.matrix3(S.XYZ_FROM_SRGB, *rgb)), strict=True)), *appearance.ciecam02(self.viewing, "k_x", "k_y", "k_z")])
        old, new, out = Scratch(at("o_")), Scratch(at("n_")), Scratch(at("b_"))
        back = out.renamed(appearance.xyz_from_ciecam02(self.viewing, new("J"), old("C"), old("h")))
        xyz = [f"({out(f'out_{c}')} * 655.35e0)" for c in "xyz"]
        # black has neither chroma nor hue: it stays what scaling makes of it
        rgb = S.matrix3(S.inverse3(S.XYZ_FROM_SRGB), *xyz)
        last = {at(n): F.when((F.col(old("J")) > 0) & (F.col(new("J")) > 0), F.expr(e)).otherwise(F.col(at(f"s{n}"))) for n, e in zip("rgb", rgb, strict=True)}
        return gain + scaled + model(old, (r, g, b)) + model(new, (at("sr"), at("sg"), at("sb"))) + back + [last]


@dataclass(frozen=True)
class Curves(Stage):
    """A curve a channel.  ``lightness``: only the lightness that they make is taken, a and b stay; the curves then share their
    effect by ``weights``."""

    red: Curve | Sequence[float] | None = None
    green: Curve | Sequence[float] | None = None
    blue: Curve | Sequence[float] | None = None
    lightness: bool = False
    weights: tuple[float, float, float] = (1.0, 1.0, 1.0)

    def steps(self, at, r, g, b):
        tables = [table_of(c) for c in (self.red, self.green, self.blue)]
        curved = lambda c, t: F.col(c) if t is None else through(t, F.col(c) / 65535.0) * 65535.0
        if not self.lightness:
            return [{at(n): F.when(_inside(F.col(c)), curved(c, t)).otherwise(F.col(c)) for n, c, t in zip("rgb", (r, g, b), tables, strict=True)}]
        moved = {at(f"m{n}"): F.col(c) + (curved(c, t) - F.col(c)) * w for n, c, t, w in zip("rgb", (r, g, b), tables, self.weights, strict=True)}
        y = S.row3(S.XYZ_FROM_SRGB[1], at("mr"), at("mg"), at("mb"))
        return [
            moved | at.named(S.matrix3(S.XYZ_FROM_SRGB, r, g, b), "x y z"),
            at.named(S.lab_from_xyz(at("x"), at("y"), at("z")), "l a c") | {at("ny"): F.expr(y)},
            {at("l"): F.expr(S.lab_from_xyz(S.num(0), at("ny"), S.num(0))[0])},
            at.named(S.xyz_from_lab(at("l"), at("a"), at("c")), "x y z"),
            at.named(S.matrix3(S.SRGB_FROM_XYZ, at("x"), at("y"), at("z")), "r g b"),
        ]


@dataclass(frozen=True)
class HueSaturationValue(Stage):
    """Saturation (-100..100), then curves of hue on the circle 0..1 whose neutral value is one half: they move hue, saturation
    and value; value moves less where a colour is pale."""

    saturation: float = 0.0
    hue: Curve | Sequence[float] | None = None
    sat: Curve | Sequence[float] | None = None
    value: Curve | Sequence[float] | None = None

    def steps(self, at, r, g, b):
        h, s, v = (F.col(at(c)) for c in "hsv")
        cut = lambda c: F.least(c, F.lit(1.0))
        amount = self.saturation / 100
        out = [at.named(S.hsv(r, g, b), "h s v")]
        if amount > 0:
            out.append({at("s"): F.greatest(F.lit(0.0), amount * (1 - F.pow(1 - cut(s), F.lit(4))) + (1 - amount) * s)})
        elif amount < 0:
            out.append({at("s"): s * (1 + amount)})
        if self.hue is not None:
            out += [{at("h"): h + (through(table_of(self.hue), h) - 0.5) * 2}, {at("h"): F.when(h > 1, h - 1).when(h < 0, h + 1).otherwise(h)}]
        if self.sat is not None:
            p = F.col(at("p"))
            up = F.greatest(F.lit(0.0), (1 - p) * s + p * (1 - (1 - cut(s)) * (1 - cut(s))))
            out += [{at("p"): (through(table_of(self.sat), h) - 0.5) * 2}, {at("s"): F.when(p > 0.00001, up).when(p < -0.00001, s * (1 + p)).otherwise(s)}]
        if self.value is not None:
            p = F.col(at("p"))
            up = F.greatest(F.lit(0.0), (1 - p) * v + p * (1 - (1 - cut(v)) * (1 - cut(v))))
            out += [{at("p"): (through(table_of(self.value), h) - 0.5) * (1 - F.pow(1 - cut(s), F.lit(4)))}, {at("v"): F.when(p > 0.00001, up).when(p < -0.00001, v * (1 + p)).otherwise(v)}]
        return [*out, at.named(S.rgb_from_hsv(at("h"), at("s"), at("v")), "r g b")]


@dataclass(frozen=True)
class BlackWhite(Stage):
    """All channels as one weighted sum (``appearance.bw_mixer`` gives weights)."""

    weights: tuple[float, float, float] = (1 / 3, 1 / 3, 1 / 3)

    def steps(self, at, r, g, b):
        return [{at("v"): F.expr(S.row3(self.weights, r, g, b))}, {at(c): F.col(at("v")) for c in "rgb"}]


@dataclass(frozen=True)
class Toning(Stage):
    """a and b move linearly with lightness, from a shadow to a highlight offset (``formulas.lab_grid``)."""

    a: tuple[float, float]
    b: tuple[float, float]

    def steps(self, at, r, g, b):
        return [
            at.named(S.matrix3(S.XYZ_FROM_SRGB, r, g, b), "x y z"),
            at.named(S.lab_from_xyz(at("x"), at("y"), at("z")), "l a c"),
            at.named(S.lab_grid(at("l"), at("a"), at("c"), *self.a, *self.b), "a c"),
            at.named(S.xyz_from_lab(at("l"), at("a"), at("c")), "x y z"),
            at.named(S.matrix3(S.SRGB_FROM_XYZ, at("x"), at("y"), at("z")), "r g b"),
        ]


@dataclass(frozen=True)
class LabCurves(Stage):
    """Curves in Lab, in this order: lightness, a and b by themselves; lightness, chroma and hue by hue (curves on the hue circle
    whose neutral value is one half); chroma as a whole (-100..100); chroma by lightness, chroma by chroma, lightness by chroma.

    ``reach``: how far chroma curves reach, as the working space needs (2 for sRGB); ``protect`` (0..100): how much of a
    growth of chroma reds and skin are spared.
    """

    lightness: Curve | Sequence[float] | None = None
    a: Curve | Sequence[float] | None = None
    b: Curve | Sequence[float] | None = None
    lightness_by_hue: Curve | Sequence[float] | None = None
    chroma_by_hue: Curve | Sequence[float] | None = None
    hue_by_hue: Curve | Sequence[float] | None = None
    chroma: float = 0.0
    chroma_by_lightness: Curve | Sequence[float] | None = None
    chroma_by_chroma: Curve | Sequence[float] | None = None
    lightness_by_chroma: Curve | Sequence[float] | None = None
    reach: float = 2.0
    protect: float = 0.0

    def steps(self, at, r, g, b):
        col = lambda n: F.col(at(n))
        out = [at.named(S.matrix3(S.XYZ_FROM_SRGB, r, g, b), "x y z"), at.named(S.lab_from_xyz(at("x"), at("y"), at("z")), "l a c"), {at("l0"): col("l") / S.SCALE, at("l"): col("l") / S.SCALE}]
        if (t := table_of(self.lightness)) is not None:
            out.append({at("l"): through(t, col("l") / 100.0) * 100.0})
        for name, curve in (("a", self.a), ("c", self.b)):
            if (t := table_of(curve)) is not None:
                out.append({at(name): through(t, (col(name) + 32768.0) / 65536.0) * 65536.0 - 32768.0})
        size = F.sqrt(col("a") * col("a") + col("c") * col("c")) / S.SCALE
        out.append({at("c0"): size, at("h"): F.atan2(col("c"), col("a")), at("f"): F.lit(1.0)})
        out.append({at("hp"): hue_position(col("h"))})
        if (t := table_of(self.lightness_by_hue)) is not None:
            w = col("w")
            share = F.when(w > 0, 2 * w * col("c0") / CHROMA_UNIT).otherwise(w * col("c0") / CHROMA_UNIT)
            unit = col("l") / 100.0
            brighter = (1 - col("w")) * unit + col("w") * (1 - F.pow(1 - F.least(unit, F.lit(1.0)), F.lit(4)))
            out += [{at("w"): through(t, col("hp")) - 0.5}, {at("w"): share}, {at("l"): 100.0 * F.when(w > 0, brighter).otherwise(unit * (1 + DARKER * w))}]
        if (t := table_of(self.chroma_by_hue)) is not None:
            out.append({at("f"): 1 + (through(t, col("hp")) - 0.5) * 2})
        if (t := table_of(self.hue_by_hue)) is not None:
            out.append({at("h"): col("h") + (through(t, col("hp")) - 0.5) * TURN})
        if self.chroma:
            out.append({at("f"): col("f") * self._spared(F.lit((100 + self.chroma) / 100), col("h"))})
        if (t := table_of(self.chroma_by_lightness)) is not None:
            factor = F.coalesce(F.try_divide(through(t, col("l0") / 100.0) * 100.0, col("l0")), F.lit(1.0))
            out.append({at("f"): col("f") * F.when(col("l0") > 0, self._spared(factor, col("h"))).otherwise(1.0)})
        at_chroma = F.sqrt(F.pow(col("f") * col("c0") * S.SCALE, F.lit(2)) + 0.001) * self.reach
        by_chroma = lambda t: through(t, col("q") / 65535.0) * 65535.0 / col("q")
        if (t := table_of(self.chroma_by_chroma)) is not None:
            out += [{at("q"): at_chroma}, {at("f"): col("f") * self._spared(by_chroma(t), col("h"))}]
        if (t := table_of(self.lightness_by_chroma)) is not None:
            near = SOFT * F.pow(F.least(col("c0") / LOW_CHROMA, F.lit(1.0)), F.lit(2))
            out += [{at("q"): at_chroma}, {at("l"): col("l") * ((by_chroma(t) - 1) * near + 1)}]
        out.append({at("a"): S.SCALE * col("f") * col("c0") * F.cos(col("h")), at("c"): S.SCALE * col("f") * col("c0") * F.sin(col("h")), at("l"): col("l") * S.SCALE})
        return [*out, at.named(S.xyz_from_lab(at("l"), at("a"), at("c")), "x y z"), at.named(S.matrix3(S.SRGB_FROM_XYZ, at("x"), at("y"), at("z")), "r g b")]

    def _spared(self, factor: Column, hue: Column) -> Column:
        if not self.protect:
            return factor
        skin = _trapezoid(hue, -0.45, -0.05, 1.6, 2.0)
        return F.when(factor > 1, 1 + (factor - 1) * (1 - self.protect / 100 * skin)).otherwise(factor)


def _trapezoid(x: Column, low: float, full: float, to: float, high: float) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - low) / (full - low), (high - x) / (high - to)))


def hue_position(h: Column) -> Column:
    """The place of a Lab hue (radians in -pi..pi) on the circle 0..1 of hue curves."""
    h = F.when(h > pi, h - 2 * pi).when(h < -pi, h + 2 * pi).otherwise(h)
    out = h * HUE_PIECES[0][1] + HUE_PIECES[0][2]
    for start, slope, offset in HUE_PIECES[1:]:
        out = F.when(h >= start, h * slope + offset).otherwise(out)
    return out - F.floor(out)


def develop(px: DataFrame, stages: Sequence[Stage], r: str = "r", g: str = "g", b: str = "b") -> DataFrame:
    """``px`` with r, g and b after all stages, the other columns as they are.

    A stage whose ``where`` is false or null for a row leaves it.  Nulls stay null.  No stages change nothing.

    The new channels leave through a generator of one row: the optimizer would write a later filter on them back in terms of the
    input, which multiplies with every stage; filters on other columns still reach the scan.
    """
    start = "_chain"
    while any(c.lower().startswith(start) for c in px.columns):
        start += "_"
    out, kept = px.withColumns({c: F.col(c).cast("double") for c in (r, g, b)}), px.columns
    for i, stage in enumerate(stages):
        at = Scratch(f"{start}{i}_")
        for step in stage.steps(at, r, g, b):
            out = out.withColumns(step)
        new = {c: F.col(at(n)) for n, c in zip("rgb", (r, g, b), strict=True)}
        if stage.where:
            hit = F.expr(stage.where)
            new = {c: F.when(hit, v).otherwise(F.col(c)) for c, v in new.items()}
        out = out.withColumns(new).select(*kept)
    if not stages:
        return out
    done = F.inline(F.array(F.struct(*[F.col(c).alias(f"{start}_{c}") for c in (r, g, b)])))
    out = out.select(*[F.col(f"`{c}`") for c in kept if c not in (r, g, b)], done)
    return out.select(*[F.col(f"{start}_{c}").alias(c) if c in (r, g, b) else F.col(f"`{c}`") for c in kept])
