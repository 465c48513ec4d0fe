"""Fixed values.

Everything in this module is a value that has to be exactly this for results to agree (names, word lists,
thresholds, formula constants). Nothing here is logic. The ISO country-code map has more than 200 entries and is
therefore not listed: it is a table the user supplies (``sources.readers.read_country_codes``).
"""

# ---- fixed values: labels, models, scopes -------------------------------------------------------------------
NEGATIVE, NEUTRAL, POSITIVE = "negative", "neutral", "positive"
LABELS = [NEGATIVE, NEUTRAL, POSITIVE]
LEXICON, CLASSIFIER = "lexicon", "classifier"
MODELS = [LEXICON, CLASSIFIER]
NATIONAL, INTERNATIONAL = "national", "international"
SCOPES = [NATIONAL, INTERNATIONAL]
WORLD = "World"

# ---- fixed values: thresholds and formula constants ---------------------------------------------------------
LABEL_EDGE = 0.05
SLOT_HOURS = 4
BACKFILL_SLOTS = 58
MIN_MENTIONS = 3_300_000
MIN_WEIGHT = 0.76
MIN_AUTHORITY = 60
RANK_SHIFT, RANK_FLOOR = 10, 0.68
NO_SCORE = -500.0
OUTLET_MARK, OUTLET_END, OUTLET_CHARS = "Media Outlet", "Contact", 157
OUTLET_DENY = ["nytimes.com", "bbc.com"]

# ---- fixed values: time formats -----------------------------------------------------------------------------
SECOND_FORMAT = "yyyyMMddHHmmss"
HOUR_FORMAT = "yyyy-MM-dd-HH"
DAY_FORMAT = "yyyyMMdd"

# ---- fixed values: the 15 subject words ---------------------------------------------------------------------
SUBJECTS = [
    "Corruption", "Economy", "Climate", "Healthcare", "Education", "Geopolitics", "Technology", "Inequality",
    "Migration", "Security", "Trade", "Democracy", "Agriculture", "Energy", "Poverty",
]

# ---- fixed values: country aliases --------------------------------------------------------------------------
ALIASES = {"United States": "US", "United Kingdom": "UK", "Moldova": "Moldavia"}

# ---- fixed values: the 150 tracked countries ----------------------------------------------------------------
TRACKED_COUNTRIES = [
    "India", "China", "UnitedStates", "Indonesia", "Pakistan", "Nigeria", "Brazil", "Bangladesh", "Russia",
    "Ethiopia", "Mexico", "Japan", "Egypt", "Philippines", "DemocraticRepublicoftheCongo", "Vietnam", "Iran",
    "Turkey", "Germany", "Thailand", "UnitedKingdom", "Tanzania", "France", "SouthAfrica", "Italy", "Kenya",
    "Myanmar", "Colombia", "SouthKorea", "Sudan", "Uganda", "Spain", "Algeria", "Iraq", "Argentina",
    "Afghanistan", "Yemen", "Canada", "Poland", "Morocco", "Angola", "Ukraine", "Uzbekistan", "Malaysia",
    "Mozambique", "Ghana", "Peru", "SaudiArabia", "Madagascar", "Coted'Ivoire", "Nepal", "Cameroon",
    "Venezuela", "Niger", "Australia", "NorthKorea", "Syria", "Mali", "BurkinaFaso", "Taiwan", "SriLanka",
    "Malawi", "Zambia", "Kazakhstan", "Chad", "Chile", "Romania", "Somalia", "Senegal", "Guatemala",
    "Netherlands", "Ecuador", "Cambodia", "Zimbabwe", "Guinea", "Benin", "Rwanda", "Burundi", "Bolivia",
    "Tunisia", "SouthSudan", "Haiti", "Belgium", "Jordan", "DominicanRepublic", "UnitedArabEmirates", "Cuba",
    "Honduras", "CzechRepublic", "Sweden", "Tajikistan", "PapuaNewGuinea", "Portugal", "Azerbaijan", "Greece",
    "Hungary", "Togo", "Israel", "Austria", "Belarus", "Switzerland", "SierraLeone", "Laos", "Turkmenistan",
    "HongKong", "Libya", "Kyrgyzstan", "Paraguay", "Nicaragua", "Bulgaria", "Serbia", "ElSalvador", "Congo",
    "Denmark", "Singapore", "Lebanon", "Finland", "Liberia", "Norway", "Slovakia", "StateofPalestine",
    "CentralAfricanRepublic", "Oman", "Ireland", "NewZealand", "Mauritania", "CostaRica", "Kuwait", "Panama",
    "Croatia", "Georgia", "Eritrea", "Mongolia", "Uruguay", "PuertoRico", "BosniaandHerzegovina", "Qatar",
    "Moldova", "Namibia", "Armenia", "Lithuania", "Jamaica", "Albania", "Gambia", "Gabon", "Botswana",
    "Lesotho", "Guinea-Bissau", "Slovenia", "EquatorialGuinea",
]

# ---- fixed values: language names the translators spell differently -----------------------------------------
LANGUAGE_NAMES = {"Chinese": "Chinese (simplified)"}
ENGLISH = "English"

# ---- fixed values: rule constants of the published lexicon model (Hutto & Gilbert, ICWSM 2014) ----------------
NORMALISER = 15.0
BOOST = 0.293
CAPITALS = 0.733
NEGATION = -0.74
DAMPING = [1.0, 0.95, 0.9]
NEVER_SO = [None, 1.5, 1.25]
BEFORE_BUT, AFTER_BUT = 0.5, 1.5
EXCLAMATION, MAX_EXCLAMATIONS = 0.292, 4
QUESTION, MAX_QUESTIONS, MANY_QUESTIONS = 0.18, 3, 0.96

BOOSTERS_UP = [
    "absolutely", "amazingly", "awfully", "completely", "considerably", "decidedly", "deeply", "effing",
    "enormously", "entirely", "especially", "exceptionally", "extremely", "fabulously", "flipping", "flippin",
    "fricking", "frickin", "frigging", "friggin", "fully", "fucking", "greatly", "hella", "highly", "hugely",
    "incredibly", "intensely", "majorly", "more", "most", "particularly", "purely", "quite", "really",
    "remarkably", "so", "substantially", "thoroughly", "totally", "tremendously", "uber", "unbelievably",
    "unusually", "utterly", "very",
]
BOOSTERS_DOWN = [
    "almost", "barely", "hardly", "kinda", "kindof", "kind-of", "less", "little", "marginally",
    "occasionally", "partly", "scarcely", "slightly", "somewhat", "sorta", "sortof", "sort-of",
]
NEGATIONS = [
    "aint", "arent", "cannot", "cant", "couldnt", "darent", "didnt", "doesnt", "dont", "hadnt", "hasnt",
    "havent", "isnt", "mightnt", "mustnt", "neither", "neednt", "never", "none", "nope", "nor", "not",
    "nothing", "nowhere", "oughtnt", "shant", "shouldnt", "uhuh", "uh-uh", "wasnt", "werent", "without",
    "wont", "wouldnt", "rarely", "seldom", "despite",
]
# One of these before or after a word is stripped from it.
PUNCTUATION = [
    ".", "!", "?", ",", ";", ":", "-", "'", "\"", "!!", "!!!", "??", "???", "?!?", "!?!", "?!?!", "!?!?",
]
