"""Scalar functions of match data, as expressions over Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from touchline import config as C

INF = float("inf")


def known(value: Column, missing: float = C.MISSING) -> Column:
    """A value, or null where it is the sentinel for missing."""
    return F.nullif(value, F.lit(missing))


def clip01(x: Column) -> Column:
    return F.when(x <= 0, F.lit(C.ALMOST_ZERO)).when(x >= 1, F.lit(C.ALMOST_ONE)).otherwise(x)


def scaled(x: Column, most: float) -> Column:
    """x / most, clipped into the open unit interval."""
    return clip01(x / F.lit(float(most))) if most > 0 else F.lit(C.ALMOST_ZERO)


def scaled_stat(x: Column, stat: str) -> Column:
    return scaled(x, C.SCALES[stat])


def season01(season: Column) -> Column:
    """Season over the configured range; a null season is exactly 0."""
    span = C.LAST_SEASON - 1 - C.FIRST_SEASON
    return F.when(season.isNull(), F.lit(0.0)).otherwise(clip01((season - C.FIRST_SEASON) / F.lit(float(span))))


def elo01(elo: Column) -> Column:
    return clip01((elo - C.ELO_MIN) / (C.ELO_MAX - C.ELO_MIN))


def unit_from_sine(x: Column) -> Column:
    return (x + 1) / 2


def cyclic(value: Column, period: float, origin: float = 0) -> tuple[Column, Column]:
    """Sine and cosine of a position in a period, each mapped to [0, 1]."""
    angle = 2 * F.pi() * (value - origin) / F.lit(float(period))
    return unit_from_sine(F.sin(angle)), unit_from_sine(F.cos(angle))


def clip_probability(p: Column) -> Column:
    return F.greatest(F.least(p, F.lit(C.ALMOST_ONE)), F.lit(C.ALMOST_ZERO))


def logit(p: Column) -> Column:
    return F.ln(p / (1 - p))


def ratio(a: Column, b: Column, empty: float | None = None) -> Column:
    """a / b, with empty (or null) where b is 0."""
    got = F.try_divide(a, b)
    return got if empty is None else F.coalesce(got, F.lit(float(empty)))


def odds_or_null(x: Column) -> Column:
    """A quoted decimal price: a finite number over 1."""
    number = x.try_cast("double")
    return F.when((number > 1) & ~F.isnan(number) & (number < INF), number)


def observed_skill(x: Column) -> Column:
    number = x.cast("double")
    return F.when((number >= 0) & ~F.isnan(number) & (number < INF), number)


def skill_value(x: Column) -> Column:
    """An observed skill over 100, clipped to [0, 1]; 0 if missing."""
    return F.when(x >= 0, F.least(F.greatest(x / 100, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))


def strength_values(matrix: Column) -> Column:
    return F.transform(matrix, lambda row: F.transform(row, skill_value))


def strength_mask(matrix: Column) -> Column:
    return F.transform(matrix, lambda row: F.transform(row, lambda x: F.coalesce((x >= 0).cast("double"), F.lit(0.0))))


def goalkeeper_score(skills: Column) -> Column:
    """Mean of the observed goalkeeper skills less that of the others; null if either has none."""
    first, last = C.GOALKEEPER_SKILLS

    def mean(part: Column) -> Column:
        seen = F.filter(part, lambda x: x != C.MISSING)
        return F.try_divide(F.aggregate(seen, F.lit(0.0), lambda a, x: a + x), F.size(seen))

    return mean(F.slice(skills, first + 1, last - first)) - mean(F.slice(skills, 1, first))


def target(home: Column, away: Column, mode: str = "binary_u25", most: int = 10) -> Column:
    """Under 2.5 goals (1.0 or 0.0), the class of the goals (at most `most`), or the goals."""
    goals = F.coalesce(home, F.lit(0)) + F.coalesce(away, F.lit(0))
    modes = {"binary_u25": (goals <= 2).cast("double"), "goals_dist": F.least(goals, F.lit(most)).cast("int"), "goals_reg": goals.cast("double")}
    if mode not in modes:
        raise ValueError(f"unknown target mode {mode}")
    return modes[mode]


def points(scored: Column, conceded: Column) -> Column:
    return F.when(scored > conceded, 3).when(scored == conceded, 1).otherwise(0)


def lineup_bucket(size: Column) -> Column:
    return F.when(size == 0, "empty").when(size < C.PLAYERS, "partial").when(size == C.PLAYERS, "full").otherwise("oversized")


def position_label(position: Column) -> Column:
    own = F.trim(position)
    return F.when(own.isin(*C.POSITIONS), own).otherwise(F.lit("Unknown"))


def position_rank(position: Column) -> Column:
    """1 to 4 in line-up order, 99 for others."""
    ranked = F.create_map(*[F.lit(x) for i, p in enumerate(C.POSITIONS, 1) for x in (p, i)])
    return F.coalesce(F.try_element_at(ranked, position), F.lit(99))


def position_index(position: Column) -> Column:
    """0 to 3 in line-up order, 4 for unknown."""
    rank = position_rank(position)
    return F.when(rank == 99, F.lit(len(C.POSITIONS))).otherwise(rank - 1)


def plain_name(name: Column) -> Column:
    """Lower case, punctuation as spaces, single spaces."""
    return F.trim(F.regexp_replace(F.translate(F.lower(F.coalesce(name, F.lit(""))), ".,'\"()-_", " " * 8), r"\s+", " "))


def ascii_name(name: Column) -> Column:
    """Lower-case letters and digits alone, for names that are already without accents."""
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def name_key(plain: Column) -> Column:
    """last name|first initial of a plain name; null if the last name has fewer than two letters or there is one word."""
    parts = F.split(plain, " ")
    last = F.element_at(parts, -1)
    return F.when((F.size(parts) >= 2) & (F.length(last) >= 2), F.concat(last, F.lit("|"), F.substring(plain, 1, 1)))


def iso_day(day: Column) -> Column:
    """A day as year-month-day; years beyond 9999 have their digits without the plus sign that date_format puts before them."""
    return F.when(day.isNotNull(), F.format_string("%04d-%02d-%02d", F.year(day), F.month(day), F.dayofmonth(day)))


def season_of_date(day: Column, first_month: int = 7) -> Column:
    return F.year(day) - (F.month(day) < first_month).cast("int")


def season_key(day: Column, first_month: int) -> Column:
    """A date within a season that begins in first_month, comparable across seasons."""
    month = F.month(day)
    return F.struct(F.when(month < first_month, month + 12).otherwise(month).alias("m"), F.dayofmonth(day).alias("d"))


def missing_stat(name: Column, value: Column, zero_is_missing: tuple[str, ...] = ()) -> Column:
    empty = value.isNull() | (value == C.MISSING)
    return empty | (name.isin(*zero_is_missing) & (value == 0)) if zero_is_missing else empty


def first_text(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns])


def flexible_date(text: Column) -> Column:
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd")), F.try_to_timestamp(text, F.lit("M/d/yyyy"))).cast("date")


def clean_cell(cell: Column) -> Column:
    """A CSV cell without byte-order mark, no-break spaces and outer white space."""
    return F.trim(F.replace(F.replace(F.coalesce(cell, F.lit("")), F.lit("\ufeff"), F.lit("")), F.lit("\u00a0"), F.lit(" ")))


def number_in(text: Column) -> Column:
    """The first number of a text; a percentage as a share."""
    number = F.regexp_extract(F.replace(text, F.lit(","), F.lit(".")), r"(-?\d+(?:\.\d+)?)", 1).try_cast("double")
    return F.when(F.contains(text, F.lit("%")), number / 100).otherwise(number)


def quoted_move(title: Column) -> tuple[Column, Column]:
    """Start and end price of a title 'a » b'; of a title with one price, that price as the end."""
    parts = F.split(title, "»")
    one = F.size(parts) < 2
    return F.when(~one, odds_or_null(F.trim(F.get(parts, F.lit(0))))), odds_or_null(F.trim(F.when(one, F.get(parts, F.lit(0))).otherwise(F.get(parts, F.lit(1)))))


def is_number(text: Column) -> Column:
    return text.try_cast("double").isNotNull()


def array_distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def matrix_is(matrix: Column, rows: int = C.PLAYERS, width: int = C.SKILLS) -> Column:
    return F.coalesce((F.size(matrix) == rows) & F.forall(matrix, lambda r: F.size(r) == width), F.lit(False))
