"""Fixed values and settings of the match-data operators."""

from __future__ import annotations

from dataclasses import dataclass, field

# Bounds, Elo, scaling and as-of limits.
ALMOST_ZERO = 1e-6
ALMOST_ONE = 1 - 1e-6
FIRST_SEASON = 2021
LAST_SEASON = 2025
ELO_K = 32.0
ELO_SEASON_REGRESSION = 0.75
INIT_ELO = 1543.6724
ELO_MIN = 1352.5387
ELO_MAX = 1734.8060
MAX_AGE_DAYS = 120
MAX_SNAPSHOTS = 6
PLAYERS = 11
SKILLS = 34
GOALKEEPER_SKILLS = (29, 34)
NEUTRAL_SKILL = 50.0
MISSING = -1.0

# What a statistic is divided by.
SCALES = {
    "goals": 5.0, "shots_on_target": 12.0, "shots_off_target": 18.0, "shots": 29.0, "corners": 13.0, "fouls": 22.0, "attacks": 161.0,
    "dangerous_attacks": 100.0, "load": 0.24, "xg": 2.86, "total_xg": 4.38, "pre_match_xg": 2.35, "total_pre_match_xg": 4.106, "possession": 100.0, "points": 3.0,
}

# Positions in line-up order.
POSITIONS = ("Goalkeeper", "Defender", "Midfielder", "Forward")

# Least name similarity of each matching stage, in the order in which stages are tried.
MATCH_STAGES = (("team_and_dob", 40.0), ("team_only", 69.9), ("dob_only", 60.0), ("name_bucket", 69.9))

# Betting thresholds, coverage levels and the lower bounds of half-open bands.
THRESHOLDS = (0.0, 0.02, 0.03, 0.05, 0.07, 0.10)
COVERAGE_LEVELS = (1.0, 0.5, 0.25, 0.2, 0.15, 0.1, 0.05, 0.02, 0.01)
EDGE_BINS = (0.0, 0.015, 0.03, 0.05, 0.07, 0.09, 0.11, 0.13, 0.15)
ODDS_BANDS = (1.0, 1.5, 1.75, 2.0, 2.25, 2.5, 3.0)
MARGIN_BANDS = (float("-inf"), 0.03, 0.05, 0.07, 0.10)
MIN_DEVELOPMENT_BETS = 100


@dataclass(frozen=True)
class Selection:
    """Which matches are kept: competitions, seasons in [first, last), excluded (competition, season), round ids by (competition, season)."""

    competitions: tuple[str, ...]
    first_season: int = FIRST_SEASON
    last_season: int = LAST_SEASON
    excluded: tuple[tuple[str, int], ...] = ()
    rounds: dict[tuple[str, int], tuple[int, ...]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not self.competitions or self.first_season >= self.last_season:
            raise ValueError("competitions must be named and the season range must not be empty")


@dataclass(frozen=True)
class Imputation:
    """Support that medians need and the value without any."""

    competition_support: int = 20
    position_support: int = 20
    global_support: int = 1
    neutral: float = NEUTRAL_SKILL

    def __post_init__(self) -> None:
        if min(self.competition_support, self.position_support, self.global_support) < 1 or not 0 <= self.neutral <= 100:
            raise ValueError("supports must be positive and the neutral value a skill")
