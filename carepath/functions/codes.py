"""Code maps. All values in this module are fixed values of the domain."""

from __future__ import annotations

# fixed values: treatment codes by category; J9228 counts as immunotherapy only
CHEMO = {
    "J9060": "Cisplatin", "J9045": "Carboplatin", "J9206": "Irinotecan", "J9017": "Etoposide IV", "J8560": "Etoposide Oral", "J9264": "Paclitaxel",
    "J9351": "Topotecan IV", "J8705": "Topotecan Oral", "J9070": "Cyclophosphamide", "J9230": "Doxorubicin", "J9250": "Vincristine", "J9223": "Lurbinectedin",
}
IMMUNO = {"J9271": "Pembrolizumab", "J9173": "Durvalumab", "J9023": "Atezolizumab", "J9299": "Nivolumab", "J9228": "Ipilimumab", "C9399": "Immunotherapy NOS"}
TARGETED = {"J9305": "Temozolomide", "J9035": "Bevacizumab"}
RADIATION = ["77385", "77386", "77401", "77402", "77412", "77427", "32701", "77371", "77372", "77373", "G6015", "G6016"]

# fixed values: biomarker codes by test type
BIOMARKERS = {"PD-L1": ["88360", "88361", "0001U", "0002U"], "TMB": ["81479", "0179U"], "NGS": ["81455", "81456", "0037U", "81445"]}

# fixed values: small-cell morphology codes
MORPHOLOGY = ["8041", "8042", "8043", "8044", "8045"]

# fixed values: response names, exact ones first, then words looked for in this order
RESPONSES = {
    "complete response": "CR", "cr": "CR", "partial response": "PR", "pr": "PR", "stable disease": "SD", "sd": "SD",
    "progressive disease": "PD", "pd": "PD", "not evaluable": "NE", "ne": "NE",
}
RESPONSE_WORDS = {"complete": "CR", "partial": "PR", "stable": "SD", "progress": "PD"}
RESPONSE_ORDER = ["CR", "PR", "SD", "PD"]

# fixed values: gender names
GENDERS = {
    "m": "Male", "male": "Male", "f": "Female", "female": "Female", "o": "Other", "other": "Other",
    "non-binary": "Other", "nb": "Other", "x": "Other", "u": "Unknown", "unknown": "Unknown",
}

# fixed values: parts of insurance names; the first that occurs counts
INSURANCES = [
    ("medicare", "Medicare"), ("medicaid", "Medicaid"), ("commercial", "Commercial"), ("private", "Commercial"), ("employer", "Commercial"),
    ("hmo", "Commercial"), ("ppo", "Commercial"), ("self-pay", "Self-Pay"), ("uninsured", "Self-Pay"),
    ("tricare", "Other Government"), ("va", "Other Government"), ("other", "Other"),
]

# fixed values: parts of race and ethnicity names; the first that occurs counts
RACES = [
    ("white", "White"), ("caucasian", "White"), ("black", "Black or African American"), ("african american", "Black or African American"),
    ("black or african american", "Black or African American"), ("hispanic", "Hispanic or Latino"), ("latino", "Hispanic or Latino"),
    ("hispanic or latino", "Hispanic or Latino"), ("asian", "Asian"), ("asian american", "Asian"),
    ("native hawaiian", "Native Hawaiian or Pacific Islander"), ("pacific islander", "Native Hawaiian or Pacific Islander"),
    ("american indian", "American Indian or Alaska Native"), ("alaska native", "American Indian or Alaska Native"),
    ("native american", "American Indian or Alaska Native"), ("two or more", "Two or More Races"), ("multiracial", "Two or More Races"),
    ("other", "Other"), ("unknown", "Unknown"), ("declined", "Unknown"), ("not reported", "Unknown"),
]

# fixed values: first three digits of ZIP codes
URBAN = [(100, 119), (200, 219), (300, 319), (600, 619), (900, 919), (700, 709)]
SUBURBAN = [(120, 149), (220, 259), (320, 349), (620, 649), (920, 949)]

# fixed values: days to treatment: label, first and last day, order; and the target
BUCKETS = [("0-7", 0, 7, 1), ("8-14", 8, 14, 2), ("15-21", 15, 21, 3), ("22-30", 22, 30, 4), ("31+", 31, 9999, 5)]
TARGET_DAYS = 21

# fixed values: states
STATES = {
    "AL": "Alabama", "AK": "Alaska", "AZ": "Arizona", "AR": "Arkansas", "CA": "California", "CO": "Colorado", "CT": "Connecticut", "DE": "Delaware",
    "DC": "District of Columbia", "FL": "Florida", "GA": "Georgia", "HI": "Hawaii", "ID": "Idaho", "IL": "Illinois", "IN": "Indiana", "IA": "Iowa",
    "KS": "Kansas", "KY": "Kentucky", "LA": "Louisiana", "ME": "Maine", "MD": "Maryland", "MA": "Massachusetts", "MI": "Michigan", "MN": "Minnesota",
    "MS": "Mississippi", "MO": "Missouri", "MT": "Montana", "NE": "Nebraska", "NV": "Nevada", "NH": "New Hampshire", "NJ": "New Jersey",
    "NM": "New Mexico", "NY": "New York", "NC": "North Carolina", "ND": "North Dakota", "OH": "Ohio", "OK": "Oklahoma", "OR": "Oregon",
    "PA": "Pennsylvania", "RI": "Rhode Island", "SC": "South Carolina", "SD": "South Dakota", "TN": "Tennessee", "TX": "Texas", "UT": "Utah",
    "VT": "Vermont", "VA": "Virginia", "WA": "Washington", "WV": "West Virginia", "WI": "Wisconsin", "WY": "Wyoming",
}
