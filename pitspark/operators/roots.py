"""Certified roots of a discounted-cash-flow value in one of its parameters.

Within a piece of its domain the value is a polynomial of the parameter. It is enclosed, together with its
derivative, by intervals whose ends are rounded outwards after every operation, from an expansion around
the middle of a domain. A domain whose enclosure leaves out the target holds no root; one whose
derivative keeps its sign, and whose ends lie on different sides for certain, holds exactly one; any other
is cut in two until it is too narrow or the budget is spent, and then stays unresolved. So nothing is ever
called without solution because a grid passed over it.

All rows of an Arrow batch are worked on together: the work list holds the open domains of all of them,
and each round encloses the whole list at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

GROWTH, MARGIN, REINVESTMENT = VARIABLES = ("revenue_cagr", "terminal_operating_margin", "reinvestment_to_revenue")
YEARLY = ("growth", "margins", "taxes", "reinvestment")
SINGLE = ("revenue", "wacc", "terminal_growth", "terminal_margin", "terminal_tax", "terminal_roic", "target")
#: Where an open domain is cut: beside its middle, as roots like to lie on round numbers.
CUT = 0.4871
#: Newton's steps towards a root before halving.
LEAPS = 12
RESULT = "state string, solution double, roots array<struct<low:double,high:double>>, unresolved array<struct<low:double,high:double>>, evaluations int, subdivisions int"


@dataclass(frozen=True)
class Bounds:
    """What a search may use up for a row, and how narrow a root must be and how near its value to the target."""

    absolute: float = 1e-6
    relative: float = 1e-9
    width: float = 1e-9
    iterations: int = 256
    subdivisions: int = 4096
    evaluations: int = 10_000


class Span:
    """Intervals, elementwise; every result is rounded outwards by one step."""

    def __init__(self, low, high=None):
        self.low, self.high = low, low if high is None else high

    @staticmethod
    def outward(low, high) -> Span:
        return Span(np.nextafter(low, -np.inf), np.nextafter(high, np.inf))

    def __add__(self, other: Span) -> Span:
        return Span.outward(self.low + other.low, self.high + other.high)

    def __sub__(self, other: Span) -> Span:
        return Span.outward(self.low - other.high, self.high - other.low)

    def __mul__(self, other: Span) -> Span:
        a, b, c, d = self.low * other.low, self.low * other.high, self.high * other.low, self.high * other.high
        return Span.outward(np.minimum(np.minimum(a, b), np.minimum(c, d)), np.maximum(np.maximum(a, b), np.maximum(c, d)))

    def over(self, other: Span) -> Span:
        """The quotient by intervals without zero; others give all numbers."""
        with np.errstate(divide="ignore", invalid="ignore"):
            out = self * Span.outward(1 / other.high, 1 / other.low)
        torn = (other.low <= 0) & (other.high >= 0)
        return Span(np.where(torn, -np.inf, out.low), np.where(torn, np.inf, out.high))

    def sign(self):
        return np.where(self.low > 0, 1, np.where(self.high < 0, -1, 0))


ZERO, ONE = Span(0.0), Span(1.0)


def _tax(profit_sign: np.ndarray, rate: np.ndarray) -> Span:
    """The tax rate by the sign of a profit; where that is open, all between none and the rate."""
    return Span(np.where(profit_sign > 0, rate, np.minimum(0.0, rate)), np.where(profit_sign < 0, 0.0, np.maximum(0.0, rate)))


def _sum(parts: list[Span]) -> Span:
    out = parts[0]
    for part in parts[1:]:
        out = out + part
    return out


def polynomials(rows: dict[str, np.ndarray], variable: str, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[Span]:
    """The value less the target as a polynomial in the variable, from the constant up, on the domain of each row of ``at``.

    With growth alone open, revenue of year k is a power of 1 + growth and profits keep the margins' signs;
    else revenues are numbers and the value is a straight line, broken only where a faded margin passes zero.
    """
    years, one = rows["growth"].shape[1], {name: Span(rows[name][at]) for name in SINGLE}
    of = [{name: Span(rows[name][at, k]) for name in YEARLY} for k in range(years)]
    factor = (ONE + one["terminal_growth"]) * (ONE - one["terminal_tax"]) * (ONE - one["terminal_growth"].over(one["terminal_roic"]))
    factor = factor.over(one["wacc"] - one["terminal_growth"])
    discounts = [ONE + one["wacc"]]
    revenues = [one["revenue"]]
    for k in range(years):
        discounts.append(discounts[-1] * discounts[0])
        revenues.append(revenues[-1] * (ONE + of[k]["growth"]))
    if variable == GROWTH:
        upward = one["revenue"].sign()
        powers = [ZERO - one["target"]]
        for k in range(years):
            margin = of[k]["margins"]
            kept = margin * (ONE - _tax(upward * margin.sign(), rows["taxes"][at, k])) - of[k]["reinvestment"]
            powers.append((one["revenue"] * kept).over(discounts[k]))
        powers[-1] = powers[-1] + (one["revenue"] * one["terminal_margin"] * factor).over(discounts[years - 1])
        return shifted(powers, 1.0)  # from 1 + growth to growth
    base, slope = [ZERO - one["target"]], []
    last = (revenues[years] * factor).over(discounts[years - 1])
    for k in range(years):
        scale = revenues[k + 1].over(discounts[k])
        if variable == REINVESTMENT:
            margin = of[k]["margins"]
            base.append(scale * margin * (ONE - _tax(revenues[k + 1].sign() * margin.sign(), rows["taxes"][at, k])))
            slope.append(ZERO - scale)
        else:
            weight, anchor = Span(rows["weights"][at, k]), Span(rows["anchor_margin"][at])
            fixed = (ONE - weight) * anchor
            ends = [(fixed + weight * Span(x)).sign() for x in (low, high)]
            kept = (ONE - _tax(revenues[k + 1].sign() * np.where(ends[0] == ends[1], ends[0], 0), rows["taxes"][at, k])) * scale
            base += [fixed * kept, ZERO - scale * of[k]["reinvestment"]]
            slope.append(weight * kept)
    return [_sum(base), _sum([*slope, last])] if variable == MARGIN else [_sum([*base, last * one["terminal_margin"]]), _sum(slope)]


def shifted(powers: list[Span], centre) -> list[Span]:
    """The same polynomial in the distance from ``centre``."""
    out = list(powers)
    for i in range(len(out) - 1):
        for j in range(len(out) - 2, i - 1, -1):
            out[j] = out[j] + Span(centre) * out[j + 1]
    return out


def enclosed(powers: list[Span], low: np.ndarray, high: np.ndarray) -> tuple[Span, Span]:
    """The polynomial and its derivative over domains, from its expansion around their middles.

    What the middle says is exact but for rounding, so the enclosure is too wide by the curvature alone.
    """
    middle = (low + high) / 2
    around = shifted(powers, middle)
    reach = np.nextafter(np.maximum(high - middle, middle - low), np.inf)
    reach = np.where(low == high, 0.0, reach)
    value, slope, step = around[0], around[1] if len(around) > 1 else ZERO, Span(-reach, reach)
    power = step
    for k in range(1, len(around)):
        value = value + around[k] * power
        if k + 1 < len(around):
            slope = slope + Span(float(k + 1)) * around[k + 1] * power
        power = power * step
        if k % 2 == 1:
            power = Span(np.zeros_like(power.high), power.high)
    return value, slope


class Search:
    """The open domains of many rows, and what has been found."""

    def __init__(self, rows: dict[str, np.ndarray], variable: str, low: float, high: float, bounds: Bounds):
        self.rows, self.variable, self.bounds = rows, variable, bounds
        many = len(rows["revenue"])
        self.evaluations, self.subdivisions = np.zeros(many, np.int64), np.zeros(many, np.int64)
        self._roots: list[tuple[np.ndarray, ...]] = []  # row, low, high and best point of each root
        self._unresolved: list[tuple[np.ndarray, ...]] = []  # row, low and high of each domain
        self.at, self.low, self.high = self._cut(np.arange(many), low, high)
        with np.errstate(over="ignore", invalid="ignore"):
            self.powers = polynomials(rows, variable, self.at, self.low, self.high)
        self.piece = np.arange(len(self.at))  # which polynomial belongs to each open domain

    def _cut(self, at: np.ndarray, low: float, high: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The whole domain of each row, cut where a faded margin passes zero, so that kinks lie in narrow bands."""
        edges = [np.full(len(at), low), np.full(len(at), high)]
        if self.variable == MARGIN:
            with np.errstate(divide="ignore", invalid="ignore"):
                kinks = (ZERO - Span(self.rows["anchor_margin"][:, None])) * (ONE - Span(self.rows["weights"]))
                kinks = kinks.over(Span(self.rows["weights"]))
            for ends in (kinks.low, kinks.high):
                edges += [np.where((k > low) & (k < high), k, high) for k in ends.T]
        cuts = np.sort(np.stack(edges, axis=1), axis=1)
        row, k = np.nonzero(cuts[:, :-1] < cuts[:, 1:])
        np.add.at(self.subdivisions, row, 1)
        self.subdivisions -= 1
        return at[row], cuts[row, k], cuts[row, k + 1]

    def enclose(self, at: np.ndarray, piece: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[Span, Span]:
        np.add.at(self.evaluations, at, 1)
        with np.errstate(over="ignore", invalid="ignore"):
            value, slope = enclosed([Span(p.low[piece], p.high[piece]) for p in self.powers], low, high)
        bad = ~(np.isfinite(value.low) & np.isfinite(value.high) & np.isfinite(slope.low) & np.isfinite(slope.high))
        return tuple(Span(np.where(bad, -np.inf, s.low), np.where(bad, np.inf, s.high)) for s in (value, slope))

    def give_up(self, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        self._unresolved.append((at, low, high))

    def roots(self) -> list[np.ndarray]:
        """Row, low, high and best point of all roots, by row and low."""
        return _by_row(self._roots, 4)

    def unresolved(self) -> list[np.ndarray]:
        """Row, low and high of all domains left open, by row and low, neighbouring ones as one."""
        at, low, high = _by_row(self._unresolved, 3)
        # domains of a row overlap in their ends alone, so that one which goes on starts where the last stopped
        first = np.r_[True, (at[1:] != at[:-1]) | (low[1:] > high[:-1])][: len(at)]
        starts = np.flatnonzero(first)
        return [at[starts], low[starts], np.maximum.reduceat(high, starts) if len(starts) else high]

    @staticmethod
    def _nth(at: np.ndarray) -> np.ndarray:
        """Which of its row's entries each one is, from 0; they share the row's budget."""
        by = np.argsort(at, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(at[by]) != 0]) if len(at) else np.zeros(0, np.int64)
        nth = np.zeros(len(at), np.int64)
        nth[by] = np.arange(len(at)) - np.repeat(starts, np.diff(np.r_[starts, len(at)]))
        return nth

    def run(self) -> None:
        while len(self.at):
            spent = self.evaluations[self.at] + 3 * (self._nth(self.at) + 1) > self.bounds.evaluations  # its own and both its ends
            self.give_up(self.at[spent], self.low[spent], self.high[spent])
            at, piece, low, high = self.at[~spent], self.piece[~spent], self.low[~spent], self.high[~spent]
            value, slope = self.enclose(at, piece, low, high)
            open_ = value.sign() == 0
            straight = np.flatnonzero(open_ & (slope.sign() != 0))
            left, right = (self.enclose(at[straight], piece[straight], end[straight], end[straight])[0].sign() for end in (low, high))
            open_[straight[(left == right) & (left != 0)]] = False
            crossing = straight[left * right == -1]
            held = self._refine(at[crossing], piece[crossing], low[crossing], high[crossing], left[left * right == -1])
            open_[crossing[held]] = False
            rest = np.flatnonzero(open_)
            middle = low[rest] + CUT * (high[rest] - low[rest])
            halve = (self.subdivisions[at[rest]] + self._nth(at[rest]) < self.bounds.subdivisions) & (middle > low[rest]) & (middle < high[rest]) & (high[rest] - low[rest] > self.bounds.width)
            self.give_up(at[rest][~halve], low[rest][~halve], high[rest][~halve])
            rest, middle = rest[halve], middle[halve]
            np.add.at(self.subdivisions, at[rest], 1)
            self.at, self.piece, self.low, self.high = np.r_[at[rest], at[rest]], np.r_[piece[rest], piece[rest]], np.r_[low[rest], middle], np.r_[middle, high[rest]]

    def _leap(self, at: np.ndarray, piece: np.ndarray, low: np.ndarray, high: np.ndarray, left: np.ndarray, near: np.ndarray) -> None:
        """Puts brackets of one root each, in place, around the point that Newton's steps end in, where both new
        ends are told from the root; the others stay for halving."""
        x, reach, going = (low + high) / 2, np.full(len(at), self.bounds.width / 4), np.ones(len(at), bool)
        for _ in range(LEAPS):
            i = np.flatnonzero(going)
            i = i[self.evaluations[at[i]] + 8 * (self._nth(at[i]) + 1) <= self.bounds.evaluations]
            going[:] = False
            if not len(i):
                break
            value, slope = self.enclose(at[i], piece[i], x[i], x[i])
            with np.errstate(all="ignore"):
                tilt = (slope.low + slope.high) / 2
                new = np.clip(x[i] - (value.low + value.high) / 2 / tilt, low[i], high[i])
                noise = 4 * (value.high - value.low) / np.abs(tilt) + 4 * np.spacing(np.abs(new))
                span = np.maximum(np.minimum(self.bounds.width / 4, near[i] / 4 / np.abs(tilt)), noise)
            sound = np.isfinite(new) & np.isfinite(span)
            i, new, span = i[sound], new[sound], span[sound]
            going[i] = np.abs(new - x[i]) > span
            x[i], reach[i] = new, span
        j = np.flatnonzero(self.evaluations[at] + 6 * (self._nth(at) + 1) <= self.bounds.evaluations)
        inner, outer = np.maximum(x[j] - reach[j], low[j]), np.minimum(x[j] + reach[j], high[j])
        told = (self.enclose(at[j], piece[j], inner, inner)[0].sign() == left[j]) & (self.enclose(at[j], piece[j], outer, outer)[0].sign() == -left[j])
        low[j[told]], high[j[told]] = inner[told], outer[told]

    def _nearest(self, at: np.ndarray, piece: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """A root's best point within its bracket: one more step of Newton's from the middle."""
        middle = (low + high) / 2
        value, slope = self.enclose(at, piece, middle, middle)
        with np.errstate(all="ignore"):
            point = np.clip(middle - (value.low + value.high) / (slope.low + slope.high), low, high)
        return np.where(np.isfinite(point), point, middle)

    def _refine(self, at: np.ndarray, piece: np.ndarray, low: np.ndarray, high: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Narrows brackets that hold one root each; whether each got narrow and near enough."""
        low, high, done, going = low.copy(), high.copy(), np.zeros(len(at), bool), np.ones(len(at), bool)
        near = self.bounds.absolute + self.bounds.relative * np.abs(self.rows["target"][at])
        self._leap(at, piece, low, high, left, near)
        for _ in range(self.bounds.iterations):
            i = np.flatnonzero(going)
            i = i[self.evaluations[at[i]] + 4 * (self._nth(at[i]) + 1) <= self.bounds.evaluations]
            if not len(i):
                break
            going[:] = False
            value = self.enclose(at[i], piece[i], low[i], high[i])[0]
            fine = (high[i] - low[i] <= self.bounds.width) & (np.maximum(np.abs(value.low), np.abs(value.high)) <= near[i])
            done[i[fine]] = True
            i = i[~fine]
            middle = (low[i] + high[i]) / 2
            between = (middle > low[i]) & (middle < high[i])
            sign = self.enclose(at[i], piece[i], middle, middle)[0].sign()
            up, down = sign == left[i], sign == -left[i]
            low[i[up]], high[i[down]] = middle[up], middle[down]
            # a middle that cannot be told from the root is put between two points that can
            unsure = np.flatnonzero(sign == 0)
            j, m = i[unsure], middle[unsure]
            inner, outer = (low[j] + m) / 2, (m + high[j]) / 2
            told = (self.enclose(at[j], piece[j], inner, inner)[0].sign() == left[j]) & (self.enclose(at[j], piece[j], outer, outer)[0].sign() == -left[j])
            low[j[told]], high[j[told]] = inner[told], outer[told]
            moved = between
            moved[unsure[~told]] = False
            going[i[moved]] = True
        k = np.flatnonzero(done)
        self._roots.append((at[k], low[k], high[k], self._nearest(at[k], piece[k], low[k], high[k])))
        return done


def _by_row(parts: list[tuple[np.ndarray, ...]], width: int) -> list[np.ndarray]:
    """Parts of the same columns (row, low, ...) as one, by row and low."""
    if not parts:
        return [np.zeros(0, np.int64), *(np.zeros(0) for _ in range(width - 1))]
    columns = [np.concatenate(c) for c in zip(*parts)]
    by = np.lexsort(columns[1::-1])
    return [c[by] for c in columns]


STATES = ("no_input", "inconclusive", "non_unique", "converged", "no_solution")
NO_INPUT, INCONCLUSIVE, NON_UNIQUE, CONVERGED, NO_SOLUTION = range(5)


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each list starts among all values, its length (-1 for null), and the values (null: not a number)."""
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    values = pc.fill_null(column.flatten(), np.nan).to_numpy(zero_copy_only=False)
    return np.cumsum(np.maximum(lengths, 0)) - np.maximum(lengths, 0), lengths, values


def _domains(places: np.ndarray, low: np.ndarray, high: np.ndarray, known: np.ndarray) -> pa.ListArray:
    """A list of domains for each row, from domains in the order of their rows; null where not ``known``."""
    offsets = np.r_[0, np.cumsum(np.bincount(places, minlength=len(known)))].astype(np.int32)
    spans = pa.StructArray.from_arrays([pa.array(low, pa.float64()), pa.array(high, pa.float64())], ["low", "high"])
    return pa.ListArray.from_arrays(pa.array(offsets, mask=np.r_[~known, False]), spans)


def solve_batch(batch: pa.StructArray, variable: str, low: float, high: float, bounds: Bounds = Bounds()) -> pa.StructArray:
    """:data:`RESULT` of each row of an Arrow batch, from columns to columns: no row is a Python object."""
    many, columns = len(batch), dict(zip([f.name for f in batch.type], batch.flatten()))
    yearly = [*YEARLY, *(["weights"] if variable == MARGIN else [])]
    single = [*SINGLE, *(["anchor_margin"] if variable == MARGIN else [])]
    numbers = {name: pc.fill_null(columns[name], np.nan).to_numpy(zero_copy_only=False) for name in single}
    lists = {name: _lists(columns[name]) for name in yearly}
    years = lists["growth"][1]
    whole = (years > 0) & np.logical_and.reduce([np.isfinite(v) for v in numbers.values()])
    for starts, lengths, values in lists.values():
        bad = np.r_[0, np.cumsum(~np.isfinite(values))]
        whole &= (lengths == years) & (bad[starts + np.maximum(lengths, 0)] == bad[starts])
    state, solution = np.full(many, NO_INPUT), np.full(many, np.nan)
    evaluations, subdivisions = np.zeros(many, np.int32), np.zeros(many, np.int32)
    roots, open_ = [], []
    for n in np.unique(years[whole]):
        own = np.flatnonzero(whole & (years == n))
        rows = {name: values[starts[own][:, None] + np.arange(n)] for name, (starts, _, values) in lists.items()} | {name: v[own] for name, v in numbers.items()}
        search = Search(rows, variable, low, high, bounds)
        search.run()
        at, *ends, point = search.roots()
        left, *left_ends = search.unresolved()
        found = np.bincount(at, minlength=len(own))
        state[own] = np.where(np.bincount(left, minlength=len(own)) > 0, INCONCLUSIVE, np.where(found > 1, NON_UNIQUE, np.where(found == 1, CONVERGED, NO_SOLUTION)))
        sure = state[own[at]] == CONVERGED
        solution[own[at[sure]]] = point[sure]
        evaluations[own], subdivisions[own] = search.evaluations, search.subdivisions
        roots.append((own[at], *ends))
        open_.append((own[left], *left_ends))
    counts = [pa.array(v, mask=~whole) for v in (evaluations, subdivisions)]
    domains = [_domains(*_by_row(parts, 3), whole) for parts in (roots, open_)]
    return pa.StructArray.from_arrays([pa.array(STATES).take(pa.array(state)), pa.array(solution, mask=state != CONVERGED), *domains, *counts], ["state", "solution", "roots", "unresolved", "evaluations", "subdivisions"])


def solver(variable: str, low: float, high: float, bounds: Bounds = Bounds()):
    """A function of a struct column (:data:`YEARLY`, :data:`SINGLE`, weights, anchor_margin) to :data:`RESULT`."""
    if variable not in VARIABLES or not low < high or (variable == GROWTH and low <= -1):
        raise ValueError(f"{variable} from {low} to {high} cannot be solved for; variables are {', '.join(VARIABLES)}")

    def solve(batch: pa.Array) -> pa.Array:
        return solve_batch(batch, variable, low, high, bounds)

    return F.arrow_udf(solve, RESULT)


def inputs(columns: list[str]) -> Column:
    """What :func:`solver` asks for, from a row's columns; a row without weights or an anchor has null ones."""
    empty = {"weights": F.lit(None).cast("array<double>"), "anchor_margin": F.lit(None).cast("double")}
    taken = [F.col(c).cast("array<double>" if c in (*YEARLY, "weights") else "double").alias(c) if c in columns else empty[c].alias(c) for c in (*YEARLY, *SINGLE, "weights", "anchor_margin")]
    return F.struct(*taken)
