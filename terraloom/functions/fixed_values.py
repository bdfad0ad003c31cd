"""Values that must equal the source material's for right results (fixed values)."""

# Movement resistance per land-cover class, and the classes that count.
RESISTANCE = {0: 50, 1: 90, 2: 50, 3: 100, 4: 1, 5: 5, 6: 5, 7: 10, 8: 40, 9: 30, 10: 80, 11: 50}
RESISTANCE_DEFAULT = 50
VALID_CLASSES = (1, 10)

# Weights of the priority index.
PRIORITY_WEIGHTS = {
    "richness": 0.177, "connectivity": 0.181, "threatened": 0.169,
    "diversity": 0.180, "co_occurrence": 0.180, "permeability": 0.113,
}

# Crop coefficient curve, (first day, last day, Kc at start, Kc at end, days).
KC_CURVE = [(1, 10, 1.05, 1.05, 10), (11, 40, 1.05, 1.15, 30), (41, 80, 1.15, 1.2, 40), (81, 110, 1.2, 0.95, 30)]
KC_DAYS = 110
CORRECTION = 1.2

# Reflectance and thermal scaling, albedo weights, land-cover recode.
REFLECTANCE_SCALE = (0.0000275, -0.2)
THERMAL_SCALE = (0.00341802, 149.0)
ALBEDO_WEIGHTS = {
    "blue": 0.254, "green": 0.149, "red": 0.147, "nir": 0.311, "swir1": 0.103, "swir2": 0.036,
}
WORLD_COVER = {10: 1, 20: 2, 30: 3, 40: 4, 50: 5, 60: 6, 70: 7, 80: 8, 90: 9}
CLOUD_PROBABILITY = 40
DARK_NIR = 0.15
WATER_CLASS = 6

# Band names per sensor, and the bands that sensors share.
S2_TO_FOUR_BAND = {"B02": "blue", "B03": "green", "B04": "red", "B08": "nir"}
EIGHT_BANDS = ["coastal_blue", "blue", "green_i", "green", "yellow", "red", "red_edge", "nir"]
SIX_OF_EIGHT = ["coastal_blue", "blue", "green", "red", "red_edge", "nir"]
LANDSAT_8_9 = {"SR_B2": "blue", "SR_B3": "green", "SR_B4": "red", "SR_B5": "nir", "SR_B6": "swir1", "SR_B7": "swir2"}
LANDSAT_5_7 = {"SR_B1": "blue", "SR_B2": "green", "SR_B3": "red", "SR_B4": "nir", "SR_B5": "swir1", "SR_B7": "swir2"}
S2_SIX = {"B2": "blue", "B3": "green", "B4": "red", "B8": "nir", "B11": "swir1", "B12": "swir2"}
