"""Word lists, rules and weights that results depend on.

They are data, stated as they must be for right results; order matters where a
list is a sequence of rules.
"""

from __future__ import annotations

#: Cell texts that count as missing on read.
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
#: Cell texts (lower case) that normalisers treat as empty.
NULL_LIKE = ["", "nan", "none", "null"]
NULL_LIKE_ENHANCED = ["", "nan", "none", "null", "<na>"]

# --- countries -------------------------------------------------------------
COUNTRIES = {
    "us": "US", "usa": "US", "united states": "US", "united states of america": "US",
    "india": "India", "ind": "India", "in": "India",
    "france": "France", "fr": "France", "fra": "France",
}
COUNTRIES_ENHANCED = COUNTRIES | {"bharat": "India", "republique francaise": "France"}

# --- business names --------------------------------------------------------
#: Legal forms: (text that must occur for the rule to be tried, pattern, replacement), applied in this order.
#: The first is fixed behaviour too: a dotted form is only tried where its undotted letters occur elsewhere.
LEGAL_FORMS = [
    ("private", r"\bprivate\s+limited\b", "pvt ltd"),
    ("pvt", r"\bpvt\.?\s*ltd\.?\b", "pvt ltd"),
    ("pvt", r"\bpvt\s+limited\b", "pvt ltd"),
    ("private", r"\bprivate\s+ltd\.?\b", "pvt ltd"),
    ("limited", r"\blimited\s+liability\s+company\b", "llc"),
    ("llc", r"\bl\.l\.c\.?\b", "llc"),
    ("lp", r"\bl\.p\.?\b", "lp"),
    ("public", r"\bpublic\s+limited\s+(?:company)?\b", "plc"),
    ("plc", r"\bp\.l\.c\.?\b", "plc"),
    ("limited", r"\blimited\b", "ltd"),
    ("ltd", r"\bltd\.?\b", "ltd"),
    ("incorporated", r"\bincorporated\b", "inc"),
    ("inc", r"\binc\.?\b", "inc"),
    ("corporation", r"\bcorporation\b", "corp"),
    ("corp", r"\bcorp\.?\b", "corp"),
    ("company", r"\bcompany\b", "co"),
    ("co", r"\bco\.?\b", "co"),
    ("sarl", r"\bs\.a\.r\.l\.?\b", "sarl"),
    ("sasu", r"\bs\.a\.s\.u\.?\b", "sasu"),
    ("sas", r"\bs\.a\.s\.?\b", "sas"),
    ("sa", r"\bs\.a\.?\b", "sa"),
    ("eurl", r"\be\.u\.r\.l\.?\b", "eurl"),
    ("sci", r"\bs\.c\.i\.?\b", "sci"),
    ("snc", r"\bs\.n\.c\.?\b", "snc"),
    ("sca", r"\bs\.c\.a\.?\b", "sca"),
    ("gmbh", r"\bg\.m\.b\.h\.?\b", "gmbh"),
    ("llp", r"\bl\.l\.p\.?\b", "llp"),
]
#: Single words that end or begin a name without being part of its core.
LEGAL_WORDS = ["ltd", "inc", "llc", "corp", "co", "plc", "llp", "sarl", "sas", "sasu", "sa", "eurl", "sci", "snc", "sca", "gmbh", "lp", "pvt", "private"]
#: Words that tell businesses apart badly.
GENERIC_TERMS = [
    "pvt", "ltd", "inc", "llc", "corp", "co", "plc", "llp", "sarl", "sas", "sasu", "sa", "eurl", "sci", "snc", "sca", "gmbh", "lp",
    "limited", "private", "corporation", "company", "incorporated",
    "enterprises", "services", "solutions", "technologies", "international", "group", "holdings",
    "consulting", "management", "industries", "associates", "ventures", "systems", "trading",
    "financial", "logistics", "retail", "products", "center", "global", "national",
]
#: Words that part a name from another of the same business, tried in this order.
#: Those with slashes only occur in names that are not normalised.
ALIASES = ["formerly", "nee", "f/k/a", "fka", "aka", "a/k/a", "d/b/a", "dba"]
ACRONYM_STOP = ["and", "the", "for", "all"]
DOMAIN_SUFFIX = r"\.(?:com|org|net|in|co\.in|co|io|biz|info)$"

LEGAL_WORDS_ENHANCED = [
    "ltd", "limited", "corp", "corporation", "inc", "incorporated",
    "pvt", "private", "llc", "llp", "gmbh", "sa", "sarl", "sas", "co",
    "company", "enterprises", "enterprise", "holdings", "holding",
    "solutions", "services", "technologies", "tech", "group", "ventures",
    "industries", "associates", "consulting", "international", "intl",
    "trading", "traders", "agency", "agencies", "foundation", "society",
    "trust", "club", "association", "institute", "center", "centre",
]
GENERIC_TERMS_ENHANCED = [
    "and", "the", "for", "all", "of", "in", "at", "by", "on", "with",
    "services", "service", "solutions", "solution", "technologies", "technology",
    "enterprises", "enterprise", "group", "holdings", "holding", "industries",
    "industry", "associates", "consulting", "consultants", "consultant",
    "international", "intl", "national", "global", "ventures", "venture",
    "trading", "traders", "trader", "commercial", "products", "product",
    "systems", "system", "management", "consultancy", "logistics",
]

# --- addresses -------------------------------------------------------------
#: Street, then unit, then state rules: (text that must occur, pattern, replacement), applied in this order.
#: Some of the texts hold brackets, so that these rules never apply.
STREETS = [
    ("road", r"\broad\b", "rd"), ("rd", r"\brd\.?\b", "rd"), ("street", r"\bstreet\b", "st"), ("st", r"\bst\.?\b", "st"), ("saint", r"\bsaint\b", "st"),
    ("avenue", r"\bavenue\b", "ave"), ("ave", r"\bave\.?\b", "ave"), ("boulevard", r"\bboulevard\b", "blvd"), ("blvd", r"\bblvd\.?\b", "blvd"),
    ("drive", r"\bdrive\b", "dr"), ("dr", r"\bdr\.?\b", "dr"), ("lane", r"\blane\b", "ln"), ("ln", r"\bln\.?\b", "ln"),
    ("highway", r"\bhighway\b", "hwy"), ("hwy", r"\bhwy\.?\b", "hwy"), ("circle", r"\bcircle\b", "cir"), ("cir", r"\bcir\.?\b", "cir"),
    ("court", r"\bcourt\b", "ct"), ("ct", r"\bct\.?\b", "ct"), ("parkway", r"\bparkway\b", "pkwy"), ("pkwy", r"\bpkwy\.?\b", "pkwy"),
    ("terrace", r"\bterrace\b", "ter"), ("ter", r"\bter\.?\b", "ter"), ("expressway", r"\bexpressway\b", "expy"), ("expy", r"\bexpy\.?\b", "expy"),
    ("trail", r"\btrail\b", "trl"), ("place", r"\bplace\b", "pl"), ("square", r"\bsquare\b", "sq"),
    ("rue", r"\brue\b", "st"), ("chemin", r"\bchemin\b", "ch"), ("impasse", r"\bimpasse\b", "imp"), ("all[eé]e", r"\ball[eé]e\b", "all"), ("route", r"\broute\b", "rte"),
    ("quai", r"\bquai\b", "quai"), ("cours", r"\bcours\b", "crs"), ("passage", r"\bpassage\b", "pass"), ("faubourg", r"\bfaubourg\b", "fbg"),
]
UNITS = [
    ("apartment", r"\bapartment\b", "apt"), ("apt", r"\bapt\.?\b", "apt"), ("suite", r"\bsuite\b", "ste"), ("ste", r"\bste\.?\b", "ste"),
    ("building", r"\bbuilding\b", "bldg"), ("bldg", r"\bbldg\.?\b", "bldg"), ("floor", r"\bfloor\b", "fl"), ("fl", r"\bfl\.?\b", "fl"),
    ("door", r"\bdoor\s+no\.?\b", "door"), ("shop", r"\bshop\s+no\.?\b", "shop"), ("plot", r"\bplot\s+no\.?\b", "plot"), ("flat", r"\bflat\s+no\.?\b", "flat"),
    ("house", r"\b(?:house\s+no|h\.?\s*no)\.?\b", "hno"), ("kh", r"\bkh\s*(?:no\.?|-)\s*", "kh "),
    ("p", r"\bp\.?\s*o\.?\s*box\b", "pobox"), ("po", r"\bpo\s+box\b", "pobox"),
    ("b[aâ]timent", r"\bb[aâ]timent\b", "bldg"), ("b[aâ]t", r"\bb[aâ]t\.?\b", "bldg"), ("[eé]tage", r"\b[eé]tage\b", "fl"), ("r[eé]sidence", r"\br[eé]sidence\b", "res"),
    ("porte", r"\bporte\b", "door"), ("b", r"\bb\.?\s*p\.?\b", "pobox"), ("cedex", r"\bcedex\b", "cedex"),
    ("z", r"\bz\.?\s*i\.?\b", "zi"), ("z", r"\bz\.?\s*a\.?\b", "za"), ("z", r"\bz\.?\s*a\.?\s*c\.?\b", "zac"), ("null", r"\bnull\b", " "),
]
STATES = [
    ("north", r"\bnorth\s+carolina\b", "nc"), ("south", r"\bsouth\s+carolina\b", "sc"), ("new", r"\bnew\s+york\b", "ny"), ("california", r"\bcalifornia\b", "ca"),
    ("texas", r"\btexas\b", "tx"), ("florida", r"\bflorida\b", "fl"), ("illinois", r"\billinois\b", "il"), ("missouri", r"\bmissouri\b", "mo"), ("maryland", r"\bmaryland\b", "md"),
    ("ohio", r"\bohio\b", "oh"), ("connecticut", r"\bconnecticut\b", "ct"), ("oklahoma", r"\boklahoma\b", "ok"), ("arizona", r"\barizona\b", "az"), ("pennsylvania", r"\bpennsylvania\b", "pa"),
    ("michigan", r"\bmichigan\b", "mi"), ("georgia", r"\bgeorgia\b", "ga"), ("virginia", r"\bvirginia\b", "va"), ("tennessee", r"\btennessee\b", "tn"), ("colorado", r"\bcolorado\b", "co"),
    ("new", r"\bnew\s+jersey\b", "nj"), ("uttarakhand", r"\buttarakhand\b", "uk"), ("uttarkhand", r"\buttarkhand\b", "uk"), ("uttar", r"\buttar\s+pradesh\b", "up"),
    ("tamil", r"\btamil\s+nadu\b", "tn"), ("madhya", r"\bmadhya\s+pradesh\b", "mp"), ("west", r"\bwest\s+bengal\b", "wb"), ("karnataka", r"\bkarnataka\b", "ka"),
    ("maharashtra", r"\bmaharashtra\b", "mh"), ("delhi", r"\bdelhi\b", "dl"), ("rajasthan", r"\brajasthan\b", "rj"), ("gujarat", r"\bgujarat\b", "gj"), ("haryana", r"\bharyana\b", "hr"),
    ("andhra", r"\bandhra\s+pradesh\b", "ap"), ("telangana", r"\btelangana\b", "ts"), ("kerala", r"\bkerala\b", "kl"), ("punjab", r"\bpunjab\b", "pb"), ("bihar", r"\bbihar\b", "br"),
]
ADDRESS_KEY_STOP = [
    "apt", "ste", "unit", "shop", "door", "hno", "block", "floor", "fl", "ground",
    "near", "opp", "opposite", "behind", "road", "rd", "street", "st", "lane", "ln",
    "avenue", "ave", "drive", "dr", "highway", "hwy", "court", "ct", "circle", "cir",
    "terrace", "ter", "expressway", "expy", "parkway", "pkwy", "trail", "trl", "pl", "sq",
    "rue", "ch", "chemin", "impasse", "imp", "all", "allee", "route", "rte", "quai",
    "cours", "crs", "pass", "passage", "fbg", "faubourg", "cedex", "res", "bldg",
    "de", "la", "du", "des", "le", "les", "en", "sur",
]
LOCALITY_KEY_STOP = [
    "rd", "st", "ave", "dr", "ln", "hwy", "blvd", "ct", "cir", "fl", "apt", "ste",
    "unit", "shop", "near", "opp", "opposite", "behind", "hotel", "road", "street",
    "highway", "lane", "avenue", "drive", "floor", "ground", "block", "sector", "building",
    "rue", "ch", "chemin", "impasse", "imp", "all", "allee", "route", "rte", "quai",
    "cours", "crs", "pass", "passage", "fbg", "faubourg", "cedex", "res", "bldg",
]
LOCALITY_KEY_STOP_ENHANCED = [
    "road", "street", "avenue", "drive", "lane", "highway", "court", "circle",
    "building", "floor", "apartment", "suite", "unit", "near", "opposite", "behind",
]
LOCALITY_STOP = [
    "rd", "st", "ave", "dr", "ln", "hwy", "blvd", "ct", "cir", "fl", "apt", "ste",
    "unit", "shop", "near", "opp", "opposite", "behind", "hotel", "road", "street",
    "highway", "lane", "floor", "building", "bldg", "cross", "main", "nagar", "block",
]
LOCALITY_STOP_ENHANCED = [
    "road", "street", "avenue", "drive", "lane", "highway", "court", "circle",
    "floor", "building", "apartment", "suite", "unit", "near", "opposite", "behind",
    "block", "sector", "nagar", "colony", "cross", "main",
]
#: Abbreviations that variant C writes out.
ABBREVIATIONS = {
    "st": "street", "rd": "road", "ave": "avenue", "av": "avenue",
    "blvd": "boulevard", "dr": "drive", "ln": "lane", "hwy": "highway",
    "ct": "court", "cir": "circle", "bldg": "building", "fl": "floor",
    "ground": "ground", "apt": "apartment", "ste": "suite", "unit": "unit",
    "dept": "department", "no": "number", "nr": "near", "opp": "opposite",
    "behind": "behind", "dist": "district", "sec": "sector", "ph": "phase",
    "bl": "block", "blk": "block", "nagar": "nagar", "marg": "marg",
    "colony": "colony", "puram": "puram", "road": "road", "street": "street",
}
ORDINALS = ["st", "nd", "rd", "th"]

# --- candidates and decisions ----------------------------------------------
KEY_WEIGHTS = {
    "NCOMP": 5.0, "NP6": 4.0, "PLOT": 4.0, "UNIT": 4.0, "ADDR": 3.5, "POSTAL": 3.5,
    "NSORT": 2.5, "TOK": 2.0, "NP4": 2.0, "ADDR_LOC": 1.5, "TOK3": 1.0,
}
BRANCH_DIRECTIONS = ["north", "south", "east", "west", "northeast", "northwest", "southeast", "southwest", "central"]
BRANCH_DIVISIONS = ["retail", "wholesale", "express", "logistics", "distribution", "services", "capital", "holdings"]
COLLISION_WORDS = ["north", "south", "east", "west", "central", "main", "branch", "phase", "sector"]
MISS_ADDRESS_STOP = ["rd", "st", "ave", "dr", "ln", "us", "in", "tn", "nc", "fl", "oh"]
#: Thresholds by country for variant B, and the rest.
COUNTRY_THRESHOLDS = {"US": 0.55, "India": 0.50, "France": 0.55}
OTHER_THRESHOLD = 0.55
#: Least thresholds by country for variant A, and the rest.
BASE_THRESHOLDS = {"US": 0.78, "India": 0.76}
BASE_OTHER = 0.75
#: (last rank, added to the threshold), and beyond.
RANK_STEPS = [(3, 0.0), (6, 0.03), (10, 0.06)]
RANK_BEYOND = 0.09
PAIR_THRESHOLDS = [0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85, 0.90, 0.95]
MACRO_THRESHOLDS = [0.40, 0.50, 0.60, 0.70, 0.75, 0.80, 0.85, 0.90, 0.95]
INDIC_SCRIPTS = ["Devanagari", "Bengali", "Gurmukhi", "Gujarati", "Tamil", "Telugu", "Kannada", "Malayalam"]
