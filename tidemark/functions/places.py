"""Names and codes of countries, and words that tell a sector, in full.

Names that are common words or places elsewhere (Chad, Niger, Jersey, Georgia) are left out on purpose.
"""

#: Country -> what a page may call it, in lower case.
ALIASES = {
    "United States": (
        "united states", "united states of america", "usa", "u.s.a.", "u.s.",
        "america", "american",
    ),
    "United Kingdom": (
        "united kingdom", "uk", "u.k.", "great britain", "britain", "british",
        "england", "scotland", "wales", "northern ireland",
    ),
    "Canada": ("canada", "canadian"),
    "Australia": ("australia", "australian"),
    "New Zealand": ("new zealand",),
    "Ireland": ("ireland", "irish", "republic of ireland"),
    "Germany": ("germany", "german", "deutschland"),
    "France": ("france", "french"),
    "Italy": ("italy", "italian", "italia"),
    "Spain": ("spain", "spanish", "españa", "espana"),
    "Portugal": ("portugal", "portuguese"),
    "Netherlands": ("netherlands", "the netherlands", "holland", "dutch"),
    "Belgium": ("belgium", "belgian"),
    "Luxembourg": ("luxembourg",),
    "Switzerland": ("switzerland", "swiss"),
    "Austria": ("austria", "austrian"),
    "Denmark": ("denmark", "danish"),
    "Sweden": ("sweden", "swedish"),
    "Norway": ("norway", "norwegian"),
    "Finland": ("finland", "finnish"),
    "Iceland": ("iceland", "icelandic"),
    "Poland": ("poland", "polish", "polska"),
    "Czechia": ("czechia", "czech republic", "czech"),
    "Slovakia": ("slovakia", "slovak"),
    "Hungary": ("hungary", "hungarian"),
    "Romania": ("romania", "romanian"),
    "Bulgaria": ("bulgaria", "bulgarian"),
    "Greece": ("greece", "greek"),
    "Croatia": ("croatia", "croatian"),
    "Slovenia": ("slovenia", "slovenian"),
    "Serbia": ("serbia", "serbian"),
    "Bosnia and Herzegovina": ("bosnia", "bosnia and herzegovina", "herzegovina"),
    "Albania": ("albania", "albanian"),
    "North Macedonia": ("north macedonia", "macedonia"),
    "Montenegro": ("montenegro",),
    "Estonia": ("estonia", "estonian"),
    "Latvia": ("latvia", "latvian"),
    "Lithuania": ("lithuania", "lithuanian"),
    "Ukraine": ("ukraine", "ukrainian"),
    "Belarus": ("belarus", "belarusian"),
    "Russia": ("russia", "russian", "russian federation"),
    "Moldova": ("moldova", "moldovan"),
    "Armenia": ("armenia", "armenian"),
    "Azerbaijan": ("azerbaijan", "azerbaijani"),
    "Kazakhstan": ("kazakhstan",),
    "Uzbekistan": ("uzbekistan",),
    "Turkey": ("türkiye", "turkiye", "republic of turkey", "turkish"),
    "Israel": ("israel", "israeli"),
    "Saudi Arabia": ("saudi arabia", "saudi", "ksa"),
    "United Arab Emirates": ("united arab emirates", "uae", "u.a.e.", "emirates", "dubai"),
    "Qatar": ("qatar", "qatari"),
    "Kuwait": ("kuwait", "kuwaiti"),
    "Bahrain": ("bahrain",),
    "Oman": ("oman", "omani"),
    "Jordan": ("jordan", "jordanian"),
    "Lebanon": ("lebanon", "lebanese"),
    "Egypt": ("egypt", "egyptian"),
    "Morocco": ("morocco", "moroccan"),
    "Algeria": ("algeria", "algerian"),
    "Tunisia": ("tunisia", "tunisian"),
    "Libya": ("libya", "libyan"),
    "Nigeria": ("nigeria", "nigerian"),
    "Ghana": ("ghana", "ghanaian"),
    "Kenya": ("kenya", "kenyan"),
    "Tanzania": ("tanzania", "tanzanian"),
    "Uganda": ("uganda", "ugandan"),
    "Ethiopia": ("ethiopia", "ethiopian"),
    "South Africa": ("south africa", "south african"),
    "Zimbabwe": ("zimbabwe",),
    "Zambia": ("zambia",),
    "Botswana": ("botswana",),
    "Namibia": ("namibia",),
    "Mozambique": ("mozambique",),
    "Angola": ("angola",),
    "Senegal": ("senegal",),
    "Ivory Coast": ("ivory coast", "cote d'ivoire", "côte d'ivoire"),
    "Cameroon": ("cameroon",),
    "India": ("india", "indian", "bharat"),
    "Pakistan": ("pakistan", "pakistani"),
    "Bangladesh": ("bangladesh", "bangladeshi"),
    "Sri Lanka": ("sri lanka", "sri lankan"),
    "Nepal": ("nepal", "nepalese"),
    "China": ("china", "chinese", "prc", "people's republic of china"),
    "Hong Kong": ("hong kong", "hongkong"),
    "Taiwan": ("taiwan", "taiwanese"),
    "Japan": ("japan", "japanese"),
    "South Korea": ("south korea", "korea", "republic of korea", "korean"),
    "Singapore": ("singapore", "singaporean"),
    "Malaysia": ("malaysia", "malaysian"),
    "Indonesia": ("indonesia", "indonesian"),
    "Thailand": ("thailand", "thai"),
    "Vietnam": ("vietnam", "viet nam", "vietnamese"),
    "Philippines": ("philippines", "the philippines", "filipino"),
    "Cambodia": ("cambodia", "cambodian"),
    "Myanmar": ("myanmar", "burma"),
    "Mexico": ("mexico", "mexican", "méxico"),
    "Guatemala": ("guatemala",),
    "Costa Rica": ("costa rica", "costa rican"),
    "Panama": ("panama", "panamanian"),
    "Dominican Republic": ("dominican republic",),
    "Puerto Rico": ("puerto rico", "puerto rican"),
    "Brazil": ("brazil", "brazilian", "brasil"),
    "Argentina": ("argentina", "argentinian", "argentine"),
    "Chile": ("chile", "chilean"),
    "Colombia": ("colombia", "colombian"),
    "Peru": ("peru", "peruvian"),
    "Ecuador": ("ecuador", "ecuadorian"),
    "Uruguay": ("uruguay", "uruguayan"),
    "Paraguay": ("paraguay",),
    "Bolivia": ("bolivia", "bolivian"),
    "Venezuela": ("venezuela", "venezuelan"),
    "Cyprus": ("cyprus", "cypriot"),
    "Malta": ("malta", "maltese"),
}

#: Country code -> country.
CODES = {
    "us": "United States", "uk": "United Kingdom", "gb": "United Kingdom",
    "ca": "Canada", "au": "Australia", "nz": "New Zealand", "ie": "Ireland",
    "de": "Germany", "fr": "France", "it": "Italy", "es": "Spain", "pt": "Portugal",
    "nl": "Netherlands", "be": "Belgium", "lu": "Luxembourg", "ch": "Switzerland",
    "at": "Austria", "dk": "Denmark", "se": "Sweden", "no": "Norway", "fi": "Finland",
    "is": "Iceland", "pl": "Poland", "cz": "Czechia", "sk": "Slovakia", "hu": "Hungary",
    "ro": "Romania", "bg": "Bulgaria", "gr": "Greece", "hr": "Croatia", "si": "Slovenia",
    "rs": "Serbia", "ba": "Bosnia and Herzegovina", "al": "Albania",
    "mk": "North Macedonia", "ee": "Estonia", "lv": "Latvia", "lt": "Lithuania",
    "ua": "Ukraine", "by": "Belarus", "ru": "Russia", "md": "Moldova",
    "az": "Azerbaijan", "kz": "Kazakhstan", "uz": "Uzbekistan",
    "tr": "Turkey", "il": "Israel", "sa": "Saudi Arabia", "ae": "United Arab Emirates",
    "qa": "Qatar", "kw": "Kuwait", "bh": "Bahrain", "om": "Oman", "jo": "Jordan",
    "lb": "Lebanon", "eg": "Egypt", "ma": "Morocco", "dz": "Algeria", "tn": "Tunisia",
    "ng": "Nigeria", "gh": "Ghana", "ke": "Kenya", "tz": "Tanzania", "ug": "Uganda",
    "et": "Ethiopia", "za": "South Africa", "zw": "Zimbabwe", "zm": "Zambia",
    "bw": "Botswana", "na": "Namibia", "mz": "Mozambique", "ao": "Angola",
    "sn": "Senegal", "ci": "Ivory Coast", "cm": "Cameroon",
    "in": "India", "pk": "Pakistan", "bd": "Bangladesh", "lk": "Sri Lanka",
    "np": "Nepal", "cn": "China", "hk": "Hong Kong", "tw": "Taiwan", "jp": "Japan",
    "kr": "South Korea", "sg": "Singapore", "my": "Malaysia", "id": "Indonesia",
    "th": "Thailand", "vn": "Vietnam", "ph": "Philippines", "kh": "Cambodia",
    "mm": "Myanmar", "mx": "Mexico", "gt": "Guatemala", "cr": "Costa Rica",
    "pa": "Panama", "do": "Dominican Republic", "pr": "Puerto Rico", "br": "Brazil",
    "ar": "Argentina", "cl": "Chile", "pe": "Peru", "ec": "Ecuador", "uy": "Uruguay",
    "py": "Paraguay", "bo": "Bolivia", "ve": "Venezuela", "cy": "Cyprus", "mt": "Malta",
}

#: Sector -> its words, in lower case.
SECTORS = {
    "Healthcare": (
        "health", "healthcare", "hospital", "medical", "medicine", "clinic", "clinical",
        "dental", "dentistry", "surgery", "surgical", "care home", "nursing", "patient",
        "orthopedic", "orthopaedic", "pediatric", "paediatric", "radiology", "oncology",
    ),
    "Pharmaceuticals": (
        "pharma", "pharmaceutical", "pharmaceuticals", "pharmacy", "biotech",
        "biotechnology", "laboratories", "biosciences",
    ),
    "Financial Services": (
        "bank", "banking", "bancorp", "credit union", "capital", "finance", "financial",
        "investment", "investments", "asset management", "wealth", "brokerage",
        "securities", "mortgage", "lending", "payments", "fintech",
    ),
    "Insurance": ("insurance", "insurers", "assurance", "underwriters", "reinsurance"),
    "Legal": (
        "law firm", "law offices", "attorneys", "attorney", "solicitors", "barristers",
        "legal services", "advocates", "notary",
    ),
    "Education": (
        "school", "schools", "university", "universities", "college", "academy",
        "institute of technology", "school district", "campus", "education",
        "educational", "kindergarten", "polytechnic",
    ),
    "Government": (
        "ministry", "municipality", "municipal", "city of", "county of", "township",
        "government", "federal", "department of", "public works", "borough", "council",
        "administration", "parliament", "police", "sheriff", "fire department",
    ),
    "Manufacturing": (
        "manufacturing", "manufacturer", "industries", "industrial", "factory",
        "fabrication", "machining", "plastics", "steel", "foundry", "tooling",
        "components", "castings",
    ),
    "Automotive": (
        "automotive", "motors", "auto parts", "car dealership", "dealership", "vehicles",
        "trucking company", "tyres", "tires",
    ),
    "Aerospace & Defense": (
        "aerospace", "avionics", "defense", "defence", "aviation", "airlines", "airline",
        "airport", "aircraft", "space systems",
    ),
    "Technology": (
        "software", "technologies", "technology", "systems", "it services",
        "managed services", "cloud", "data center", "datacenter", "cybersecurity",
        "computing", "digital solutions", "hosting", "saas",
    ),
    "Telecommunications": (
        "telecom", "telecommunications", "telecoms", "broadband", "wireless", "mobile network",
        "isp", "internet service",
    ),
    "Energy & Utilities": (
        "energy", "utilities", "utility", "electric", "electricity", "power company",
        "oil", "gas", "petroleum", "solar", "renewables", "pipeline", "water authority",
        "grid",
    ),
    "Mining": ("mining", "minerals", "quarry", "quarries", "ore", "smelting"),
    "Construction": (
        "construction", "contractors", "contracting", "builders", "building services",
        "civil engineering", "roofing", "plumbing", "electrical services", "concrete",
        "architects", "architecture",
    ),
    "Real Estate": (
        "real estate", "realty", "properties", "property group", "estates", "letting",
        "housing association", "facilities management",
    ),
    "Transportation & Logistics": (
        "logistics", "freight", "shipping", "haulage", "transport", "transportation",
        "courier", "warehousing", "supply chain", "fleet", "maritime", "port authority",
        "rail", "railway",
    ),
    "Retail": (
        "retail", "retailer", "stores", "store", "supermarket", "shop", "boutique",
        "e-commerce", "ecommerce", "outlet", "wholesale", "distribution",
    ),
    "Food & Beverage": (
        "food", "foods", "beverage", "beverages", "brewery", "winery", "distillery",
        "dairy", "bakery", "catering", "restaurant", "restaurants", "meat", "produce",
    ),
    "Agriculture": (
        "agriculture", "agricultural", "agri", "farms", "farming", "livestock",
        "horticulture", "fisheries", "forestry",
    ),
    "Hospitality & Travel": (
        "hotel", "hotels", "resort", "resorts", "hospitality", "travel", "tourism",
        "casino", "leisure", "cruise",
    ),
    "Media & Entertainment": (
        "media", "broadcasting", "publishing", "publishers", "newspaper", "studios",
        "entertainment", "advertising", "marketing agency", "production company",
    ),
    "Professional Services": (
        "consulting", "consultants", "consultancy", "accounting", "accountants",
        "auditors", "advisory", "staffing", "recruitment", "engineering services",
        "surveyors",
    ),
    "Non-profit": (
        "foundation", "charity", "charitable", "non-profit", "nonprofit", "ngo",
        "association", "society", "trust fund", "humanitarian",
    ),
    "Chemicals": ("chemicals", "chemical", "coatings", "polymers", "fertilizer", "adhesives"),
}
