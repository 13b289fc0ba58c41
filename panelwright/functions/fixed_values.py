"""Word lists, patterns, code tables and limits of the default profile.

Nothing in here is logic. All operators take these as arguments, so that another city or
another rule set only needs another table.
"""

# --- fixed values: request categories -------------------------------------------------
CATEGORIES = [
    "noise",
    "parking_traffic",
    "sanitation",
    "housing",
    "water_sewer",
    "infrastructure",
    "environment",
    "public_safety",
    "other",
]

CATEGORY_LABELS = {
    "noise": "Noise & Disturbance",
    "parking_traffic": "Parking, Traffic & Mobility",
    "sanitation": "Sanitation & Waste",
    "housing": "Housing & Building Conditions",
    "water_sewer": "Water & Sewer",
    "infrastructure": "Street Infrastructure & Public Works",
    "environment": "Environmental Health & Green Space",
    "public_safety": "Public Safety & Regulatory Enforcement",
    "other": "Other / Administrative & Unclassified",
}

# --- fixed values: request type names per category, later categories win on repeats ----
TYPE_NAMES = {
    "noise": [
        "Noise", "Noise - Residential", "Noise - Street/Sidewalk", "Noise - Commercial",
        "Noise - Vehicle", "Noise - Park", "Noise - House of Worship",
        "Noise - Helicopter", "Helicopter", "Collection Truck Noise",
        "Loud Music/Party", "Loud Talking", "Banging/Pounding",
    ],
    "parking_traffic": [
        "Illegal Parking", "Blocked Driveway", "Derelict Vehicles",
        "Traffic", "Traffic Signal Condition", "Traffic Signal",
        "Broken Muni Meter", "Street Sign - Damaged", "Street Sign - Missing",
        "Street Sign - Dangling", "Highway Sign - Damaged", "Highway Sign - Missing",
        "Highway Sign - Dangling", "Bike/Roller/Skate Chronic",
        "Abandoned Bike", "Derelict Bicycle", "Bike Rack Condition",
        "Bus Stop Shelter Complaint", "Bus Stop Shelter Placement",
        "Taxi Complaint", "Taxi Report", "For Hire Vehicle Complaint",
        "For Hire Vehicle Report", "FHV Licensee Complaint",
        "Green Taxi Complaint", "E-Scooter", "E-Bike", "Request Changes - A.S.P.",
        "Lost Property",
    ],
    "sanitation": [
        "Request Large Bulky Item Collection", "Dirty Conditions",
        "Missed Collection", "Missed Collection (All Materials)", "Sanitation Condition",
        "Illegal Dumping", "Electronics Waste Appointment",
        "Residential Disposal Complaint", "Commercial Disposal Complaint",
        "Dumpster Complaint", "Overflowing Litter Baskets", "Litter Basket / Request",
        "Litter Basket Complaint", "Dead Animal", "Derelict Vehicle",
        "Recycling Enforcement", "Sweeping/Missed", "Sweeping/Inadequate",
        "Sweeping/Missed-Inadequate", "DSNY Spillage", "Lot Condition",
        "General Sanitation", "Graffiti", "Graffiti Removal",
        "Unsanitary Pigeon Condition", "Wood Pile Remaining",
        "Illegal Animal Kept as Pet", "Animal-Abuse", "Animal Abuse",
    ],
    "housing": [
        "HEAT/HOT WATER", "Heat/Hot Water", "Heating", "HEATING",
        "UNSANITARY CONDITION", "PAINT/PLASTER", "PLUMBING", "DOOR/WINDOW",
        "WATER LEAK", "GENERAL", "General Construction/Plumbing", "FLOORING/STAIRS",
        "APPLIANCE", "ELECTRIC", "Electrical", "SAFETY", "OUTSIDE BUILDING",
        "ELEVATOR", "Elevator", "Boiler", "Building/Use", "Building Marshals office",
        "Building Condition", "Building Maintenance", "Maintenance or Facility",
        "Mold", "Asbestos", "Lead", "Indoor Air Quality", "Non-Residential Heat",
        "Window Guard", "Peeling Paint", "HPD Literature Request",
        "Special Projects Inspection Team (SPIT)", "Construction",
        "COVID-19 Non-essential Construction", "Scaffold Safety",
        "Cranes and Derricks", "BEST/Site Safety",
    ],
    "water_sewer": [
        "Water System", "Sewer", "Water Conservation", "Water Quality",
        "Indoor Sewage", "Water Drainage", "Drinking Water", "Bottled Water",
        "Hydrant", "Street Flooding", "Catch Basin Clogged/Flooding",
        "Root/Sewer/Sidewalk Condition", "Beach/Pool/Sauna Complaint",
    ],
    "infrastructure": [
        "Street Condition", "Street Light Condition", "Sidewalk Condition",
        "Curb Condition", "Highway Condition", "Bridge Condition",
        "Tunnel Condition", "Public Toilet", "Snow", "Snow or Ice", "Snow Removal",
        "Obstruction", "Damaged Tree", "Dead/Dying Tree", "Overgrown Tree/Branches",
        "New Tree Request", "Plant", "Street Sweeping Complaint",
        "Municipal Parking Facility", "Found Property",
    ],
    "environment": [
        "Air Quality", "Air", "Rodent", "Standing Water", "Vacant Lot",
        "Mosquitoes", "Poison Ivy", "Harboring Bees/Wasps", "Illegal Tree Damage",
        "Plant", "Unsanitary Animal Pvt Property", "Animal Facility - No Permit",
        "Industrial Waste", "Hazardous Materials", "Hazmat Storage/Use",
        "Calorie Labeling", "Drinking", "Open Flame Permit",
    ],
    "public_safety": [
        "Non-Emergency Police Matter", "Consumer Complaint", "Food Establishment",
        "Food Poisoning", "Vendor Enforcement", "Mobile Food Vendor",
        "Other Enforcement", "Real Time Enforcement", "Violation of Park Rules",
        "Outdoor Dining", "Illegal Posting", "Smoking", "Smoking or Vaping",
        "Urinating in Public", "Day Care", "NonCompliance with Phased Reopening",
        "Vaccine Mandate Non-Compliance", "Mass Gathering Complaint",
        "Sustainability Enforcement", "Investigations and Discipline (IAD)",
        "Illegal Fireworks", "Homeless Person Assistance", "Homeless Encampment",
        "Panhandling", "Drinking", "Tattooing", "Public Payphone Complaint",
        "Disorderly Youth", "Senior Center Complaint", "School Maintenance",
        "Public Assembly - Temporary", "Fire Alarm - Replacement",
        "Emergency Response Team (ERT)",
    ],
}

# --- fixed values: fallback patterns on the normalised type, first match wins ----------
TYPE_PATTERNS = [
    ("noise", r"\bnoise\b|loud|helicopter"),
    ("parking_traffic", r"parking|driveway|vehicle|traffic|meter|taxi|fhv|e-?bike|e-?scooter|bike|skate|bus stop|street sign|highway sign"),
    ("sanitation", r"sanitation|collection|litter|dump|dumpster|recycl|disposal|garbage|rubbish|trash|dirty|dead animal|graffiti|pigeon|wood pile"),
    ("housing", r"heat|hot water|paint|plaster|plumb|window|door|floor|stairs|appliance|electric|elevator|boiler|building|mold|asbestos|lead|scaffold|construction|housing|hpd|maintenance"),
    ("water_sewer", r"water system|sewer|water conservation|water quality|drainage|hydrant|flood|catch basin|bottled water|indoor sewage"),
    ("infrastructure", r"street condition|street light|sidewalk|curb|bridge|tunnel|highway|snow|ice|obstruction|tree|public toilet|public works"),
    ("environment", r"air quality|rodent|standing water|mosquito|vacant lot|poison ivy|bees|wasps|hazard|industrial waste|animal facility"),
    ("public_safety", r"police|consumer|food|vendor|enforcement|park rules|smoking|vaping|urinating|day care|vaccine|gathering|fireworks|homeless|panhandling|public assembly|safety|discipline"),
]

# --- fixed values: word-bounded patterns on type plus descriptor, first match wins ------
TYPE_DESCRIPTOR_PATTERNS = [
    ("noise", r"\b(noise|loud|music|talking|banging|party|jackhammer|after\s*hours)\b"),
    ("housing", r"\b(heat/hot\s*water|hot\s*water|heating|heat|plumbing|electric|door/window|window|flooring|stairs|paint/plaster|paint|plaster|appliance|elevator|building|maintenance|water\s*leak|leak|unsanitary\s*condition|safety|gas|boiler)\b"),
    ("sanitation", r"\b(sanitation|dirty|garbage|trash|litter|recycling|missed\s*collection|bulk|derelict\s*bicycle|street\s*sweeping|sweeping|rodent|rat|mouse|mice|pest|mold|illegal\s*dumping|dumping)\b"),
    ("water_sewer", r"\b(sewer|water\s*system|water\s*quality|catch\s*basin|flooding|hydrant|drinking\s*water|wastewater)\b"),
    ("infrastructure", r"\b(street\s*condition|sidewalk\s*condition|street\s*light|highway\s*condition|bridge\s*condition|curb|pothole|roadway|road\s*condition|traffic\s*signal|street\s*light\s*condition|streetlight)\b"),
    ("parking_traffic", r"\b(illegal\s*parking|blocked\s*driveway|traffic|street\s*sign|parking\s*meter|derelict\s*vehicle|abandoned\s*vehicle|taxi|for\s*hire\s*vehicle|bike\s*lane|bus\s*stop|bus\s*lane|vehicle|parking)\b"),
    ("environment", r"\b(tree|damaged\s*tree|dead/dying\s*tree|air\s*quality|asbestos|lead|industrial\s*waste|hazardous|chemical|environment|plant|parks|green|noise\s*from\s*park)\b"),
    ("public_safety", r"\b(homeless|animal|dog|illegal\s*fireworks|fireworks|drinking|drug\s*activity|panhandling|vending|encampment|harassment|graffiti|non-emergency\s*police|police|fire\s*safety)\b"),
]

# --- fixed values: point-of-interest categories over tag values, first match wins -------
POI_PATTERNS = [
    ("healthcare", r"(?:hospital|clinic|doctors|doctor|dentist|pharmacy|healthcare|nursing_home|social_facility|veterinary|optometrist|physiotherapist)"),
    ("education", r"(?:school|university|college|kindergarten|childcare|daycare|language_school|music_school|driving_school|library)"),
    ("transport", r"(?:bus_station|bus_stop|subway|subway_entrance|train_station|railway|station|ferry_terminal|taxi|parking|bicycle_parking|bicycle_rental|car_rental|car_sharing|fuel|charging_station|public_transport|aeroway|airport|tram_stop|pier)"),
    ("emergency_safety", r"(?:police|fire_station|emergency|ambulance_station|rescue_station|siren|fire_hydrant|lifeguard)"),
    ("public_service", r"(?:courthouse|townhall|city_hall|post_office|government|public_building|community_centre|community_center|shelter|toilets|waste_basket|recycling|waste_disposal|drinking_water|bench|prison|ranger_station)"),
    ("food_drink", r"(?:restaurant|cafe|coffee|fast_food|food_court|bar|pub|biergarten|ice_cream|juice_bar|bakery|deli)"),
    ("retail", r"(?:supermarket|convenience|mall|department_store|clothes|shoes|jewelry|jewellery|florist|hardware|furniture|electronics|mobile_phone|computer|books|bookshop|butcher|greengrocer|marketplace|chemist|beauty|hairdresser|laundry|dry_cleaning|car_repair|bicycle_shop|pet|gift|variety_store|retail|shop)"),
    ("finance", r"(?:bank|atm|money_transfer|bureau_de_change|financial|insurance)"),
    ("accommodation", r"(?:hotel|motel|hostel|guest_house|apartment|apartments|chalet|camp_site|caravan_site)"),
    ("recreation_green", r"(?:park|garden|playground|sports_centre|sport|pitch|swimming_pool|fitness_centre|fitness_station|stadium|track|recreation_ground|dog_park|nature_reserve|picnic_site|leisure)"),
    ("culture_tourism", r"(?:museum|gallery|artwork|attraction|viewpoint|zoo|aquarium|theme_park|theatre|theater|cinema|arts_centre|tourism|historic|monument|memorial|information)"),
    ("religion", r"(?:place_of_worship|church|mosque|synagogue|temple|shrine|religion|chapel)"),
    ("office_work", r"(?:office|coworking|company|commercial|business|employment_agency|estate_agent|lawyer|accountant|consulting)"),
    ("industrial_logistics", r"(?:industrial|warehouse|storage|logistics|factory|works|utility|power|substation|water_works|wastewater_plant|depot)"),
]
POI_CATEGORIES = [name for name, _ in POI_PATTERNS] + ["other"]

POI_TAG_COLUMNS = [
    "amenity", "shop", "tourism", "leisure", "office", "healthcare", "public_transport",
    "railway", "highway", "natural", "historic", "craft", "emergency", "sport", "landuse",
    "building", "man_made", "aeroway", "waterway", "religion", "category", "subcategory",
    "type", "poi_type", "osm_type", "osm_category", "fclass", "class",
]
POI_TAG_FAMILIES = POI_TAG_COLUMNS[:19]

POI_GROUPS = {
    "commercial_activity": ["food_drink", "retail", "finance", "accommodation", "office_work"],
    "daily_activity": ["food_drink", "retail", "education", "healthcare", "transport"],
    "social_infrastructure": ["education", "healthcare", "public_service", "religion", "culture_tourism"],
    "mobility_access": ["transport"],
    "recreation_environment": ["recreation_green", "culture_tourism"],
    "safety_public_service": ["emergency_safety", "public_service"],
    "employment_industrial": ["office_work", "industrial_logistics"],
}

# --- fixed values: point-of-interest groups by exact tag value --------------------------
POI_VALUE_SETS = [
    ("food_nightlife", ["restaurant", "cafe", "bar", "pub", "fast_food", "marketplace", "bakery"]),
    ("education", ["school", "university", "college", "kindergarten", "library"]),
    ("healthcare", ["hospital", "clinic", "doctors", "pharmacy"]),
    ("transport_parking", ["parking", "parking_entrance", "station", "subway_entrance", "tram_stop", "platform", "stop_position", "bus_stop"]),
    ("public_service", ["police", "fire_station", "community_centre"]),
    ("recreation", ["park", "playground", "sports_centre", "fitness_centre", "garden", "recreation_ground", "museum", "attraction", "gallery"]),
    ("retail", ["supermarket", "convenience", "mall", "department_store", "clothes", "laundry", "hardware", "furniture"]),
    ("finance", ["bank", "atm"]),
    ("accommodation", ["hotel"]),
]

# --- fixed values: land-use codes (two digits) ------------------------------------------
LANDUSE_CATEGORY = {
    "01": "residential_low_mid",
    "02": "residential_multifamily_walkup",
    "03": "residential_multifamily_elevator",
    "04": "mixed_residential_commercial",
    "05": "commercial_office",
    "06": "industrial_manufacturing",
    "07": "transportation_utility",
    "08": "public_facility_institution",
    "09": "open_space_recreation",
    "10": "parking_facility",
    "11": "vacant_land",
}
LANDUSE_LABELS = {
    "residential_low_mid": "One-/Two-Family and Low-Rise Residential",
    "residential_multifamily_walkup": "Multi-Family Walk-Up Residential",
    "residential_multifamily_elevator": "Multi-Family Elevator Residential",
    "mixed_residential_commercial": "Mixed Residential and Commercial",
    "commercial_office": "Commercial and Office",
    "industrial_manufacturing": "Industrial and Manufacturing",
    "transportation_utility": "Transportation and Utility",
    "public_facility_institution": "Public Facilities and Institutions",
    "open_space_recreation": "Open Space and Outdoor Recreation",
    "parking_facility": "Parking Facilities",
    "vacant_land": "Vacant Land",
    "unknown": "Unknown / Missing Land Use",
}
LANDUSE_CATEGORIES = list(LANDUSE_LABELS)
LANDUSE_GROUPS = {
    "residential": ["residential_low_mid", "residential_multifamily_walkup", "residential_multifamily_elevator"],
    "mixed_use": ["mixed_residential_commercial"],
    "commercial_activity": ["mixed_residential_commercial", "commercial_office"],
    "industrial_utility": ["industrial_manufacturing", "transportation_utility"],
    "civic_institutional": ["public_facility_institution"],
    "open_recreation": ["open_space_recreation"],
    "parking_auto": ["parking_facility"],
    "vacant_underused": ["vacant_land"],
}
# land-use codes without leading zero -> type and coarse group
PARCEL_TYPE = {
    "1": "one_two_family_residential",
    "2": "multi_family_walkup_residential",
    "3": "multi_family_elevator_residential",
    "4": "mixed_residential_commercial",
    "5": "commercial_office",
    "6": "industrial_manufacturing",
    "7": "transportation_utility",
    "8": "public_facility_institution",
    "9": "open_space_recreation",
    "10": "parking",
    "11": "vacant_land",
}
PARCEL_GROUP = {
    "1": "residential",
    "2": "residential",
    "3": "residential",
    "4": "mixed_use",
    "5": "commercial",
    "6": "industrial",
    "7": "transportation_utility",
    "8": "public_facility",
    "9": "open_space",
    "10": "parking",
    "11": "vacant",
}
PARCEL_GROUPS = [
    "residential", "mixed_use", "commercial", "industrial", "transportation_utility",
    "public_facility", "open_space", "parking", "vacant", "unknown",
]
BOROUGH_NAMES = {
    "1": "Manhattan", "2": "Bronx", "3": "Brooklyn", "4": "Queens", "5": "Staten Island",
    "MN": "Manhattan", "BX": "Bronx", "BK": "Brooklyn", "QN": "Queens", "SI": "Staten Island",
    "MANHATTAN": "Manhattan", "BRONX": "Bronx", "BROOKLYN": "Brooklyn", "QUEENS": "Queens",
    "STATEN ISLAND": "Staten Island",
}

# --- fixed values: parcel measures ------------------------------------------------------
PARCEL_SUMS = {
    "lotarea": "lot_area_sqft_sum",
    "bldgarea": "building_area_sqft_sum",
    "comarea": "commercial_area_sqft_sum",
    "resarea": "residential_area_sqft_sum",
    "officearea": "office_area_sqft_sum",
    "retailarea": "retail_area_sqft_sum",
    "garagearea": "garage_area_sqft_sum",
    "strgearea": "storage_area_sqft_sum",
    "factryarea": "factory_area_sqft_sum",
    "otherarea": "other_area_sqft_sum",
    "numbldgs": "building_count_sum",
    "unitsres": "residential_units_sum",
    "unitstotal": "total_units_sum",
    "assesstot": "assessed_total_value_sum",
    "assessland": "assessed_land_value_sum",
}
PARCEL_STATS = {
    "lotarea": "lot_area_sqft",
    "bldgarea": "building_area_sqft",
    "numfloors": "num_floors",
    "builtfar": "built_far",
    "residfar": "residential_far_allowed",
    "commfar": "commercial_far_allowed",
    "facilfar": "facility_far_allowed",
    "yearbuilt": "year_built",
}
PARCEL_TOTALS = {
    "lotarea": "total_lot_area",
    "bldgarea": "total_building_area",
    "resarea": "total_residential_area",
    "comarea": "total_commercial_area",
    "officearea": "total_office_area",
    "retailarea": "total_retail_area",
    "garagearea": "total_garage_area",
    "strgearea": "total_storage_area",
    "factryarea": "total_factory_area",
    "otherarea": "total_other_area",
    "numbldgs": "total_buildings",
    "unitsres": "total_residential_units",
    "unitstotal": "total_units",
}
SQFT_TO_KM2 = 9.290304e-8
EARTH_RADIUS_M = 6371008.8

# --- fixed values: weather --------------------------------------------------------------
WEATHER_FAMILIES = ["tmax", "tmin", "tavg", "prcp", "snow", "snwd", "awnd"]
WEATHER_DATATYPES = ["TMAX", "TMIN", "PRCP", "SNOW", "SNWD", "AWND"]
# weekly event-day counts: output, family, comparison, limit
WEATHER_EVENTS = [
    ("hot_day_30c_count", "tmax", ">=", 30.0),
    ("hot_day_35c_count", "tmax", ">=", 35.0),
    ("ice_day_tmax_0c_count", "tmax", "<=", 0.0),
    ("cold_day_0c_count", "tmin", "<=", 0.0),
    ("very_cold_day_minus5c_count", "tmin", "<=", -5.0),
    ("rain_day_count", "prcp", ">=", 1.0),
    ("moderate_rain_day_10mm_count", "prcp", ">=", 10.0),
    ("heavy_rain_day_25mm_count", "prcp", ">=", 25.0),
    ("very_heavy_rain_day_50mm_count", "prcp", ">=", 50.0),
    ("snow_day_count", "snow", ">", 0.0),
    ("heavy_snow_day_25mm_count", "snow", ">=", 25.0),
]
# daily indicator flags: output, datatype, comparison, limit
DAILY_FLAGS = [
    ("hot_day_30c", "TMAX", ">=", 30.0),
    ("hot_day_35c", "TMAX", ">=", 35.0),
    ("cold_day_0c", "TMIN", "<=", 0.0),
    ("rain_day", "PRCP", ">", 0.0),
    ("heavy_rain_day_25mm", "PRCP", ">=", 25.0),
    ("snow_day", "SNOW", ">", 0.0),
]
SENTINEL_LIMIT = 9990.0

# --- fixed values: word lists for flags and missing keys --------------------------------
TRUE_WORDS = ["true", "t", "yes", "y", "1"]
FALSE_WORDS = ["false", "f", "no", "n", "0"]
MISSING_KEY_WORDS = ["", "nan", "None"]
MISSING_TOKEN_WORDS = ["", "nan", "none", "null"]

# --- fixed values: panel windows and default split --------------------------------------
LAG_WEEKS = [1, 2, 4, 8, 12, 52]
ROLLING_WEEKS = [4, 8, 12]
LABEL_WEEKS = 8
LABEL_MULTIPLIER = 1.5
MIN_HISTORY_WEEKS = 12
DEFAULT_SPLIT = {
    "train_end": "2022-12-31",
    "validation_start": "2023-01-01",
    "validation_end": "2023-12-31",
    "test_start": "2024-01-01",
}
MIN_CATEGORY_POSITIVES = 30
NO_SCORE = -1e9

# Parts of column names that decide how a missing parcel figure is filled (Q01), tested in this order.
AVERAGE_WORDS = ["avg_", "mean", "median", "num_floors", "floor", "far", "building_area_to_lot_area_ratio"]
RATIO_WORDS = ["_ratio", "_share", "_hhi", "entropy", "mixed_use_index"]
VOLUME_WORDS = ["_count", "_sum", "_density", "total_", "lot_area_", "building_area", "parcel_density", "buildings", "units", "area"]

# Names under which a column may come, first one that exists wins.
REQUEST_COLUMNS = {
    "created_date": ["created_date", "created date", "createddate"],
    "complaint_type": ["complaint_type", "complaint type", "complainttype"],
    "descriptor": ["descriptor", "incident_descriptor"],
    "nta2020": ["nta2020", "nta", "nta_code", "ntacode"],
    "ntaname": ["ntaname", "nta_name", "nta name"],
    "boroname": ["boroname", "boro_name", "borough", "borough_name"],
    "unique_key": ["unique_key", "unique key", "uniquekey"],
}
POI_COLUMNS = {
    "nta2020": ["nta2020", "nta_2020", "nta", "nta_code", "ntacode"],
    "ntaname": ["ntaname", "nta_name", "name_nta"],
    "boroname": ["boroname", "boro_name", "borough", "boro"],
    "borocode": ["borocode", "boro_code"],
    "cdta2020": ["cdta2020", "cdta_2020"],
    "cdtaname": ["cdtaname", "cdta_name"],
    "name": ["name", "poi_name", "osm_name"],
    "latitude": ["latitude", "lat", "y"],
    "longitude": ["longitude", "lon", "lng", "x"],
    "osm_id": ["osm_id", "osmid", "id", "element_id"],
}
PARCEL_COLUMNS = {
    "nta2020": ["nta2020", "nta", "ntacode", "nta_code", "nta2020code"],
    "ntaname": ["ntaname", "nta_name", "ntaname2020", "nta2020name"],
    "boroname": ["boroname", "borough", "boro", "boroughname"],
    "borocode": ["borocode", "borocode1", "borocode2020", "boro_code"],
    "cdta2020": ["cdta2020", "cdtacode", "cdta_code"],
    "cdtaname": ["cdtaname", "cdta_name"],
    "bbl": ["bbl", "bbl10", "boroughblocklot"],
    "landuse": ["landuse", "land_use", "plutolanduse"],
    "bldgclass": ["bldgclass", "buildingclass", "bldg_class"],
    "lotarea": ["lotarea", "lot_area", "lotsqft", "lotareasqft"],
    "bldgarea": ["bldgarea", "bldg_area", "buildingarea", "building_area", "bldgareafeet"],
    "comarea": ["comarea", "commercialarea", "commercial_area", "com_area"],
    "resarea": ["resarea", "residentialarea", "residential_area", "res_area"],
    "officearea": ["officearea", "office_area"],
    "retailarea": ["retailarea", "retail_area"],
    "garagearea": ["garagearea", "garage_area"],
    "strgearea": ["strgearea", "storagearea", "storage_area", "strgarea"],
    "factryarea": ["factryarea", "factoryarea", "factory_area", "industrialarea", "industrial_area"],
    "otherarea": ["otherarea", "other_area"],
    "numbldgs": ["numbldgs", "num_bldgs", "numberofbuildings", "number_buildings"],
    "numfloors": ["numfloors", "num_floors", "numberoffloors", "floors"],
    "unitsres": ["unitsres", "units_res", "residentialunits", "res_units"],
    "unitstotal": ["unitstotal", "units_total", "totalunits", "total_units"],
    "yearbuilt": ["yearbuilt", "year_built", "yrbuilt"],
    "yearalter1": ["yearalter1", "year_alter1", "yearaltered1"],
    "yearalter2": ["yearalter2", "year_alter2", "yearaltered2"],
    "builtfar": ["builtfar", "built_far", "builtfloorarearatio"],
    "residfar": ["residfar", "resid_far", "residentialfar"],
    "commfar": ["commfar", "comm_far", "commercialfar"],
    "facilfar": ["facilfar", "facil_far", "facilityfar"],
    "assesstot": ["assesstot", "assess_total", "assessedtotal", "assess_tot"],
    "assessland": ["assessland", "assess_land", "assessedland"],
    "zonedist1": ["zonedist1", "zone_dist1", "zoningdistrict1"],
    "latitude": ["latitude", "lat", "ycoord", "ycoordinate"],
    "longitude": ["longitude", "lon", "lng", "xcoord", "xcoordinate"],
}

# Columns that a raw schema report looks for dates in.
DATE_COLUMNS = ["created_date", "closed_date", "date", "version"]
