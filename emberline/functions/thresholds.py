"""Fixed values of the scoring rules."""

INDUSTRIAL_CLOSE_M, INDUSTRIAL_NEAR_M, INDUSTRIAL_FAR_M = 500, 2000, 5000
FOREST_CLOSE_M, AGRI_CLOSE_M = 2000, 2000
FLARE_TYPES = ["refinery", "petroleum", "oil", "gas", "lng", "gas_plant", "petrochemical"]
INDUSTRIAL_FACILITY_TYPES = ["refinery", "petroleum", "oil", "gas", "lng", "gas_plant", "petrochemical", "chemical",
                             "chemical_plant", "power_plant", "power", "steel", "steel_plant", "factory",
                             "industrial", "industrial_area", "mine", "cement", "aluminum"]
CRITICAL_TYPES = ["refinery", "petroleum", "chemical", "power_plant", "lng", "oil", "gas"]
FRP_LOW, FRP_MEDIUM, FRP_HIGH, FRP_VERY_HIGH = 20, 50, 100, 180
BT_LOW, BT_HIGH, BT_VERY_HIGH = 310, 340, 360
PERSISTENCE_LOW, PERSISTENCE_MODERATE, PERSISTENCE_HIGH = 0.3, 0.6, 0.75
NDVI_VEGETATION, NDVI_LOW, NDBI_BUILTUP = 0.4, 0.2, 0.3
TIER1_RISK, MONITOR_RISK = 75, 50
# Class names in declared order: ties go to the first.
INDUSTRIAL_FIRE, PERSISTENT, GAS_FLARE = "industrial_fire", "persistent_industrial_thermal_source", "gas_flare"
WILDFIRE, AGRICULTURAL, UNKNOWN = "wildfire", "agricultural_fire", "unknown"
CLASSES = [INDUSTRIAL_FIRE, PERSISTENT, GAS_FLARE, WILDFIRE, AGRICULTURAL, UNKNOWN]
# Order of the label list in model evaluation.
EVALUATION_LABELS = [AGRICULTURAL, GAS_FLARE, INDUSTRIAL_FIRE, PERSISTENT, WILDFIRE, UNKNOWN]
