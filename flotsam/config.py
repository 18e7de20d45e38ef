"""Parameters of the survey, detector, pairing and concentration rules."""
from __future__ import annotations

from dataclasses import dataclass

# ---- Fixed values: they decide the results and are stated as given -------------------------------------------------

# Registry columns read as numbers; an empty field is unknown, never zero
NUMERIC_COLUMNS = (
    "latitude", "longitude", "lat_start", "lon_start", "lat_end", "lon_end", "items_count",
    "concentration_value_orig", "concentration_items_km2", "concentration_g_km2", "transect_length_km",
    "transect_width_m", "sampled_area_km2", "sea_state_beaufort", "wind_speed_kn",
    "reported_concentration_items_km2", "reported_concentration_g_km2", "parent_concentration_items_km2",
    "density_numerator_items", "source_reported_total_items", "source_object_filtered_items",
)

# Basins: lon_min, lat_min, lon_max, lat_max
BASINS = {
    "black_sea": (27.0, 40.5, 42.0, 46.0),
    "nw_atlantic_subtropical": (-75.0, 20.0, -55.0, 35.0),
    "north_sea": (-4.0, 50.0, 10.0, 60.0),
    "north_pacific_gyre": (-160.0, 20.0, -120.0, 40.0),
}

# Sentinel-2A central wavelengths, nm
WAVELENGTH = {"b04": 665.0, "b06": 740.0, "b08": 842.0, "b11": 1610.0}

# Median clean-water reflectance per band
WATER_REF = {
    "b01": 0.0368, "b02": 0.0342, "b03": 0.0268, "b04": 0.0175, "b05": 0.0142, "b06": 0.0140,
    "b07": 0.0148, "b08": 0.0121, "b8a": 0.0140, "b11": 0.0086, "b12": 0.0062,
}

# Pixel groups of the classifier, and the label classes they gather
GROUPS = ("debris", "organic", "ship", "cloud", "water", "foam")
LABEL_TO_GROUP = {1: 0, 2: 1, 3: 1, 4: 1, 5: 2, 6: 3, 7: 4, 8: 4, 9: 5, 10: 4, 11: 4, 12: 5, 13: 3, 14: 5, 15: 4}
LABEL2_TO_GROUP = {1: 0, 2: 1, 3: 1, 4: 1, 5: 2, 6: 4, 7: 4, 8: 4, 9: 5, 10: 4, 11: 4, 12: 5, 13: 2, 14: 1, 15: 1}
# First label set expressed in the classes of the second one (clouds and mixed water have no counterpart)
LABEL_TO_LABEL2 = {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 7: 7, 8: 8, 9: 9, 10: 10, 11: 11, 12: 12, 14: 12}

# Regions of labelled scenes by tile prefix
TILE_REGIONS = {
    "Central America": ("16P", "16Q"),
    "Caribbean": ("18Q", "19Q"),
    "Northern Europe": ("30V",),
    "South Africa": ("36J",),
    "South-East Asia": ("48", "50L", "51P"),
    "East Asia": ("51R", "52S"),
}

# Status dictionaries: code, key, label
DETECTION_STATUS = ((0, "not_detected", "не обнаружено"), (1, "detected", "обнаружено"),
                    (2, "insufficient_data", "недостаточно данных"))
CONCENTRATION_STATUS = ((0, "unavailable", "концентрация недоступна"), (1, "model_estimate", "модельная оценка"),
                        (2, "research_estimate", "исследовательская оценка"))
QUALITY_CODES = ((0, "ok", "пригоден"), (1, "land", "суша / вне маски воды"), (2, "nodata", "нет данных"),
                 (3, "cloud", "облако"), (4, "shadow", "тень облака"), (5, "cirrus", "перистые облака"),
                 (6, "glint", "сильный блик"), (7, "ice", "лёд / шуга"), (8, "ship", "судно / кильватер"),
                 (9, "static", "постоянный объект"))
REJECT_ORDER = ("static", "ship", "ice", "cloud", "foam", "isolated", "cfar", "small")

# Scene classes: clear-sky, unusable, cloud-like
SCL_CLEAR = (2, 4, 5, 6, 7, 11)
SCL_BAD = (0, 1, 3, 8, 9, 10, 11)
SCL_CLOUD_EDGE = (3, 8, 9, 10)

# Cover classes start above 0 and at these m²/km²
COVER_EDGES = (0.0, 15.0, 40.0, 100.0)
# Variogram lag edges, km
VARIOGRAM_EDGES = (0, 15, 30, 60, 120, 250, 500, 1000, 2500, 20000)
# Threshold grid of the index baseline
FDI_LO = (0.005, 0.01, 0.015, 0.02, 0.03)
FDI_HI = (0.04, 0.06, 0.08, 0.1, 0.15, 0.2, 1.0)
NDVI_MAX = (0.0, 0.1, 0.2, 0.3, 1.0)
# Ocean-field products: shelf box, and wind products by first day
SHELF_BOX = (-19.88, 40.07, 12.99, 65.0)
CURRENT_PRODUCTS = {"shelf": "cmems_mod_nws_phy-uv_my_7km-2D_PT1H-i", "global": "cmems_mod_glo_phy_my_0.083deg_P1D-m"}
WIND_PRODUCTS = (("cmems_obs-wind_glo_phy_my_l4_0.125deg_PT1H", "2007-01-11"),
                 ("cmems_obs-wind_glo_phy_my_l4_0.25deg_PT1H", "1994-06-01"))
COMPASS = ("N", "NE", "E", "SE", "S", "SW", "W", "NW")

HEX_EXPORT_COLUMNS = (
    "aoi", "date", "scene_id", "h3", "hex_index", "lon", "lat", "water_km2", "valid_frac", "detection_status",
    "detection_status_ru", "n_det_px", "cover_m2_km2", "profile", "unit", "conc_items_km2", "conc_lo80",
    "conc_hi80", "conc_status", "conc_status_ru", "model_version",
)
DENSITY_UNIT = "шт./км²"
ZONE_EXPORT_COLUMNS = (
    "zone_id", "aoi", "date", "scene_id", "scene_datetime_utc", "lon", "lat", "h3", "zone_area_km2", "n_pixels",
    "cover_m2", "cover_m2_km2", "p_mean", "p_max", "detection_status", "detection_status_ru",
    "profile", "profile_label", "size_class", "unit", "conc_items_km2", "conc_lo80", "conc_hi80", "conc_lo95",
    "conc_hi95", "conc_status", "conc_status_ru", "conc_reasons", "model_version", "valid_frac_scene", "wind_ms",
    "sea", "field_event_id", "field_profile", "field_date", "field_distance_km", "field_date_gap_days",
    "field_conc_items_km2",
)

# Field selection: profile groups in order, then exclusion rules in order
BANNED_FLAGS = ("source_total_vs_object_count_conflict",)
PROFILE_GROUPS = (
    ("A", "train", {"record_type": ("transect_density",), "target_scope": ("total_plastic",),
                    "measurement_profile": ("S2_visual_GT2",)}),
    ("B", "train", {"record_type": ("transect_density",), "target_scope": ("all_litter",),
                    "measurement_profile": ("S4_visual_GT2_5",)}),
    ("B", "transfer_check", {"record_type": ("transect_density",), "target_scope": ("all_litter",),
                             "measurement_profile": ("S3_visual_GT2",)}),
    ("C", "optional", {"record_type": ("transect_density",), "target_scope": ("total_plastic",),
                       "measurement_profile": ("S1_trawl_5_to_50",)}),
)
EXCLUSION_RULES = (
    ("object_context_not_label", {"target_scope": ("object_context",)}),
    ("subpopulation_not_target", {"target_scope": ("plastic_category", "fisheries_litter_category")}),
    ("total_missing_or_conflict", {"target_scope": ("total_plastic",), "measurement_profile": ("S1_aerial_GT50",)}),
)
PROFILE_BASINS = {"A": ("nw_atlantic_subtropical",), "B": ("black_sea",), "C": ("north_pacific_gyre",)}
FORBIDDEN_PREDICTORS = frozenset((
    "conc_items_km2", "conc_lo95", "conc_hi95", "conc_published", "conc_g_km2", "n_items", "area_km2",
    "concentration_items_km2", "concentration_g_km2", "concentration_value_orig", "concentration_unit_orig",
    "items_count", "density_numerator_items", "source_reported_total_items", "source_object_filtered_items",
    "reported_concentration_items_km2", "reported_concentration_g_km2", "parent_concentration_items_km2",
    "parent_sample_id", "zero_scope", "quality_flags", "calculation_method", "sea_state_beaufort", "wind_speed_kn",
    "ctx_seaweed_clumps_km2",
))


@dataclass(frozen=True)
class Detector:
    """Detector and status thresholds."""
    p_det: float = 0.5
    all_flags: int = 7
    storm_wind_ms: float = 8.0
    rough_wind_ms: float = 6.0
    ice_frac: float = 0.005
    min_scene_valid: float = 0.3
    min_hex_valid: float = 0.5
    glint_b11: float = 0.03
    glint_scene_frac: float = 0.3
    cloud_buffer_px: int = 10
    zone_merge_px: int = 1
    ice_valid_px: int = 5
    ice_zone_px: int = 30
    ship_px: int = 40
    small_px: int = 4


@dataclass(frozen=True)
class Pairing:
    """Event to scene matching."""
    window_days: int = 1
    tier_a_max_h: float = 3.0
    tier_b_max_h: float = 18.0
    current_ms: float = 0.3
    windage: float = 0.02
    max_feature_buffer_km: float = 5.0
    min_coverage: float = 0.9
    min_clear_water: float = 0.5
    max_glint_b11: float = 0.03


@dataclass(frozen=True)
class Applicability:
    validated_radius_km: float = 60.0
    feature_margin: float = 0.1


# ---- end of fixed values -------------------------------------------------------------------------------------------

DETECTOR = Detector()
PAIRING = Pairing()
APPLICABILITY = Applicability()


def check_predictors(features) -> None:
    """Refuse predictors derived from the answer or unknown when the model is applied."""
    bad = sorted(set(features) & FORBIDDEN_PREDICTORS)
    if bad:
        raise ValueError(f"forbidden predictors: {bad}")
