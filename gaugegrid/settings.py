"""Constants of the data contract and the parameters of a gauge network."""

from __future__ import annotations

from dataclasses import dataclass

# ---- fixed values: amounts, classes, radii and layouts every result depends on ----

#: Amount edges (mm) between the nine classes of a half-hour total.
EDGES = (0.0, 0.2, 0.5, 1.0, 2.0, 5.0, 10.0, 20.0)
#: Lower bound of classes 1..8: each edge plus half the 0.1 mm resolution.
CLASS_FLOORS = (0.05, 0.25, 0.55, 1.05, 2.05, 5.05, 10.05, 20.05)
N_CLASSES = 9
HEAVY_CLASS = 6
#: Thresholds of the score tables, the in-class Brier checks and the skill curve.
SCORE_EDGES = (0.0, 1.0, 5.0, 20.0)
BETWEEN_EDGES = (3.0, 15.0, 30.0)
SKILL_THETAS = (0.0, 0.2, 0.5, 1.0, 2.0, 3.0, 5.0, 7.5, 10.0, 15.0, 20.0, 25.0, 30.0)

#: Trailing totals: minutes in the column name -> slots of five minutes.
TRAILING_SLOTS = {5: 1, 15: 3, 30: 6, 60: 12, 120: 24, 1440: 288}
MINUTES_PER_SLOT = 5
DAY_SLOTS = 288

#: Map projection centre (degrees) and kilometres per degree.
LON_CENTRE, LAT_CENTRE = 103.82, 1.35
KM_PER_DEGREE_LON, KM_PER_DEGREE_LAT = 111.32, 110.57

#: Neighbourhood radii (km), the distance floor of inverse-distance weights, the "no rain near" distance.
R_CLOSE, R_NEAR, R_FAR = 5.0, 10.0, 25.0
IDW_FLOOR_KM = 0.5
NO_RAIN_KM = 30.0

#: Season code -> (heading towards in degrees, speed in km/h) of the prevailing motion.
MOTION = {0: (136.4, 51.4), 1: (118.2, 59.1), 2: (79.3, 37.9)}
UPSTREAM_MINUTES = (15, 30)
UPSTREAM_SIGMA_KM, UPSTREAM_CUT_KM = 4.0, 10.0
CHANGE_LAG_SLOTS = 3

#: Season code -> months, and its name.
SEASON_MONTHS = {0: (12, 1, 2, 3), 2: (6, 7, 8, 9)}
SEASON_NAMES = {0: "NE monsoon", 1: "inter-monsoon", 2: "SW monsoon"}

#: Neighbour feature columns, in table order.
T2_COLUMNS = (
    "t2_idw_rain_15", "t2_idw_rain_30", "t2_idw_trend", "t2_far_rain_30", "t2_max_rain_30",
    "t2_wet_frac_5km", "t2_wet_frac_10km", "t2_dist_rain_km",
    "t2_rain_30_n", "t2_rain_30_e", "t2_rain_30_s", "t2_rain_30_w",
    "t2_island_wet_frac", "t2_island_rain_30", "t2_nbrs_10km",
)
#: Neighbour features whose change over CHANGE_LAG_SLOTS is a feature too.
CHANGED_COLUMNS = (
    "idw_rain_30", "far_rain_30", "max_rain_30", "wet_frac_5km", "wet_frac_10km", "dist_rain_km",
    "rain_30_n", "rain_30_e", "rain_30_s", "rain_30_w", "island_wet_frac", "island_rain_30",
)
STATION_FEATURES = ("t0_x_km", "t0_y_km", "t0_wet_ratio", "t0_heavy_ratio")

#: Feature prefixes that get log1p, and signed log1p, before a linear model.
LOG_PREFIXES = (
    "t1_rain", "t1_max5", "t1_min_since", "t2_idw_rain", "t2_far_rain", "t2_max_rain", "t2_rain_30",
    "t2_island_rain", "t3_up15_rain", "t3_up30_rain",
)
SIGNED_LOG_PREFIXES = (
    "t1_trend", "t2_idw_trend", "t3_d15_idw_rain", "t3_d15_far_rain", "t3_d15_max_rain", "t3_d15_rain_30",
    "t3_d15_island_rain",
)
#: Inner cut points of the features a linear model also sees as bands.
SHARE_CUTS = (1e-6, 0.1, 0.25, 0.5, 0.75)
BAND_CUTS = {
    "t1_rain_5": CLASS_FLOORS, "t1_rain_15": CLASS_FLOORS, "t1_rain_30": CLASS_FLOORS, "t1_max5_30": CLASS_FLOORS,
    "t2_idw_rain_15": CLASS_FLOORS, "t2_idw_rain_30": CLASS_FLOORS, "t2_max_rain_30": CLASS_FLOORS,
    "t2_wet_frac_5km": SHARE_CUTS, "t2_wet_frac_10km": SHARE_CUTS, "t2_island_wet_frac": SHARE_CUTS,
    "t2_dist_rain_km": (2.0, 5.0, 10.0, 20.0, 29.99),
    "t1_min_since_rain": (0.5, 15.5, 30.5, 60.5, 180.5, 720.5, 1439.5),
}
#: Upper bound (minutes) and name of each band of the time since the last wet reading.
RECENCY_BANDS = ((0, "0 raining now"), (30, "1 within 30 min"), (60, "2 30–60 min"), (120, "3 1–2 h"), (360, "4 2–6 h"))
RECENCY_DAY, RECENCY_REST = "5 6–24 h", "6 none in 24 h"
COMPASS = ("N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW")
COMPASS_WORDS = {"N": "north", "E": "east", "S": "south", "W": "west"}

#: Shrinkage, flag and sampling constants.
RATIO_SHRINK = 500
STUCK_EXPECTED = 30
CLIMATOLOGY_STRENGTHS = (0, 100, 1000, 3000, 10000)
WET_DAY_MM, WET_DAY_SLACK = 1.0, 1e-9
COVERAGE_CUTOFFS = (0.80, 0.90, 0.95)
#: Distance bands (km) of the correlation table, of the motion fit, and of the cluster test.
DISTANCE_BANDS = (0, 2, 4, 6, 8, 10, 13, 16, 20, 25, 30, 40, 50)
MOTION_RING_KM = (5.0, 30.0)
CLUSTER_TEST_BANDS = ((3, 8), (8, 13), (13, 20))
MIN_PEAK_CORRELATION = 0.1
LR_SPECS = ((1e-5, False), (1e-6, True), (1e-5, True), (1e-4, True))
RF_START = {"max_depth": 14, "min_instances": 100, "feature_subset": "sqrt", "max_bins": 64, "impurity": "gini"}
RF_GRID = {
    "max_depth": (14, 17, 20, 24), "min_instances": (20, 50, 100, 300), "feature_subset": ("sqrt", "onethird", "0.5"),
    "max_bins": (64, 256), "impurity": ("gini", "entropy"),
}
RESOLUTION_SLOTS = {"5 min": 1, "15 min": 3, "1 h": 12, "3 h": 36, "1 day": 288}
SEED = 42

# ---- end of fixed values ----


@dataclass(frozen=True)
class Grid:
    """A regular time grid in local wall-clock time: slot 0 starts at ``origin``."""

    origin: str = "2017-01-01 00:00:00"
    width: int = 300

    @property
    def per_day(self) -> int:
        return 86400 // self.width

