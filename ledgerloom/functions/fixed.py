"""Word lists, patterns and constants whose exact content decides results."""

# Suffixes of company names, and those that a matching name may have over another.
NAME_SUFFIXES = [
    ", incorporated", " incorporated", ", technologies", " technologies", ", corporation", " corporation",
    ", limited", " limited", ", company", " company", ", inc.", " inc.", ", inc", " inc", ", llc", " llc",
    ", ltd.", " ltd.", ", ltd", " ltd", ", corp.", " corp.", ", corp", " corp", ", co.", " co.", ", co", " co",
    " labs", " lab", " tech", " ai", " health", " cloud", " ml", " ops", " dev", " hq", " app", " io",
    " software", " systems", " healthcare", " bio", " therapeutics", " sciences", " data", " analytics",
    " intelligence", " platform", " x", " go", " ly", " fy", " ify",
]
MATCH_SUFFIXES = ["ai", "hq", "app", "io", "labs", "lab", "tech", "health", "cloud", "ml", "ops", "dev", "x", "go", "ly", "fy", "ify"]

# Amounts.
AMOUNT_PLACEHOLDERS = ["<unknown>", "unknown", "none", "null", "undisclosed", "not disclosed", "n/a", "na", "tbd", "confidential", ""]
AMOUNT_PLACEHOLDER_PARTS = ["unknown", "undisclosed", "not disclosed"]
AMOUNT_UNITS = {
    "million": 1_000_000, "mn": 1_000_000, "mm": 1_000_000, "m": 1_000_000, "billion": 1_000_000_000, "bn": 1_000_000_000,
    "b": 1_000_000_000, "thousand": 1_000, "k": 1_000, "crore": 120_500, "cr": 120_500, "lakh": 1_205, "lac": 1_205,
}
ROUND_LIMITS = {"pre_seed": 10_000_000, "seed": 50_000_000, "series_a": 200_000_000, "series_b": 500_000_000, "series_c": 1_000_000_000}

# Query parameters that only track.
TRACKING_PARAMETERS = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "gclsrc", "dclid", "msclkid",
    "ref", "source", "mc_cid", "mc_eid", "_ga", "_gl", "_hsenc", "_hsmi", "ncid", "sr_share", "vero_id",
]

# URLs that are none, and hosts that are no company's website.
URL_PLACEHOLDERS = [
    "not mentioned", "not specified", "unknown", "n/a", "none", "", "<unknown>", "$unknown", "null", "undefined", "n.a.", "na",
    "not available", "not provided", "tbd", "tba", "pending", "no website", "no url", "unavailable", "not found",
]
URL_PLACEHOLDER_PARTS = ["not mentioned", "not specified", "unknown", "n/a", "unavailable"]
OTHER_SITES = [
    "linkedin.com", "twitter.com", "facebook.com", "instagram.com", "youtube.com", "tiktok.com", "x.com", "medium.com",
    "substack.com", "blogspot.com", "wordpress.com", "github.com", "gitlab.com", "bitbucket.org", "crunchbase.com", "pitchbook.com",
    "techcrunch.com", "bloomberg.com", "reuters.com", "forbes.com", "wsj.com", "nytimes.com", "google.com/search",
    "linkedin.com/search", "bing.com/search",
]
SITE_PATTERN = r"^https?://[a-zA-Z0-9][a-zA-Z0-9.-]+\.[a-zA-Z]{2,}(?:/.*)?$"
PROFILE_PATTERN = r"^https?://(?:www\.)?linkedin\.com/in/[a-zA-Z0-9_-]{3,}(?:/.*)?(?:\?.*)?$"
COMPANY_PAGE_PATTERN = r"^https?://(?:www\.)?linkedin\.com/company/[a-zA-Z0-9_-]{2,}(?:/.*)?(?:\?.*)?$"

# Titles that announce nothing, and signs of funding in titles.
NO_ANNOUNCEMENT = [
    "year in review", "year-in-review", "yearinreview", "2024 recap", "2025 recap", "annual review", "year end",
    "looking back at", "best of 2024", "best of 2025", "portfolio update", "portfolio spotlight", "portfolio news",
    "company update:", "quarterly update", "interview with", "q&a with", "q&a:", "in conversation with", "fireside chat",
    "podcast:", "episode:", "demo day recap", "conference recap", "event recap", "webinar:", "live event:", "summit recap",
    "opinion:", "analysis:", "predictions for", "trends in", "what we learned", "lessons from", "how to", "we're hiring",
    "join our team", "career opportunities", "job opening", "now hiring", "acquired by", "acquisition of", "merger with", "ipo:",
]
STRONG_TITLE = ["series a", "series b", "series c", "series d", "seed round", "raises $", "raised $", "led by", "funding round", "pre-seed"]
WEAK_TITLE = ["funding", "investment", "venture", "capital", "million", "billion", "backed", "round", "investor"]

# Pages of sources that never announce.
CRUNCHBASE_PAGES = ["/reviews/", "/jobs/", "/people/", "/acquisitions/", "/ipo/", "/hub/", "/lists/", "/discover/", "/organization/", "/event/", "/school/"]
YC_PAGES = ["/apply/", "/about/", "/blog/", "/library/", "/resources/", "/faq/", "/contact/"]
YC_TITLES = ["how to apply", "application deadline", "startup school", "office hours", "yc library", "founder resource"]
LINKEDIN_PAGES = ["/jobs/", "/learning/", "/company/", "/school/", "/groups/", "/events/", "/pulse/topic/"]

# Signs of funding in texts.
STRONG_FUNDING = [
    "raised", "raises", "funding", "series", "seed round", "led by", "leads", "investment round", "secures", "closes round",
    "announces funding", "closes", "gets", "bags", "nabs", "receives", "wins", "grabs", "pulls", "attracts", "lands", "raise", "led",
    "invests",
]
AMOUNT_WORDS = ["million", "billion", "$", "mn", "m funding"]

# Crypto.
CRYPTO_WORDS = [
    "crypto", "blockchain", "web3", "defi", "nft", "token", "protocol", "layer 2", "l2", "dao", "smart contract", "ethereum",
    "bitcoin", "solana", "polygon", "avalanche", "arbitrum", "optimism", "base chain", "cosmos", "polkadot", "decentralized",
    "on-chain", "tokenomics", "staking", "yield farming", "liquidity pool", "airdrop", "bridge", "validator", "consensus", "gas fee",
    "mint", "tokenization", "tokenize", "tokenized", "wallet connect", "metamask", "dex", "amm", "tvl", "memecoin", "meme coin",
    "altcoin", "stablecoin",
]
CRYPTO_NAMES = ["0x", "defi", "nft", "web3", "dao", "swap"]
CRYPTO_NAME_WORDS = r"\bprotocol\b|\btoken\b|\bcoin\b"
CRYPTO_SITES = [".eth", ".crypto", ".sol", "crypto", "defi", "nft", "web3", "coindesk", "cointelegraph", "theblock.co", "decrypt.co", "token"]
KNOWN_CRYPTO = ["farcaster", "cork"]
CRYPTO_LABELS = [
    "tokenization startup", "tokenization company", "tokenization platform", "tokenization protocol", "tokenization project",
    "blockchain startup", "blockchain company", "blockchain platform", "crypto startup", "crypto company", "crypto platform",
    "crypto project", "defi startup", "defi company", "defi platform", "defi protocol", "nft marketplace", "nft platform",
    "nft startup", "web3 startup", "web3 company", "web3 platform",
]
AI_IN_DESCRIPTION = ["nlp", "natural language", "machine learning", "neural", "large language model", "llm", "text processing", "ai model"]
AI_IN_CRYPTO_TEXT = ["ai infrastructure", "machine learning", "llm", "large language model", "ai platform", "enterprise ai", "mlops", "ai agent", "ai model"]

# Consumer fintech.
FINTECH_WORDS = [
    "neobroker", "neo-broker", "stock trading", "stock trading app", "retail trading", "retail investor", "retail brokerage",
    "commission-free trading", "zero-commission", "fractional shares", "robinhood competitor", "trading platform", "neobank", "neo-bank",
    "challenger bank", "digital bank", "mobile banking", "consumer banking", "retail banking", "checking account", "savings account",
    "debit card", "mobile payments", "peer-to-peer payments", "p2p payments", "money transfer", "remittance", "payment app",
    "consumer lending", "personal loans", "buy now pay later", "bnpl", "insurtech", "consumer insurance", "personal insurance",
]
FINTECH_NAMES = ["bank", "trade", "trading", "broker", "invest", "wealth", "pay", "money", "cash", "coin", "finance", "capital"]
KNOWN_FINTECH = [
    "trade republic", "robinhood", "revolut", "n26", "chime", "sofi", "nubank", "monzo", "starling", "wise", "transferwise", "venmo",
    "cash app", "square", "stripe", "plaid", "klarna", "affirm", "afterpay", "clearpay", "webull", "public.com", "m1 finance", "acorns",
    "stash", "etoro", "freetrade", "wealthfront", "betterment",
]
FINTECH_DESCRIPTIONS = ["neobroker", "neobank", "trading app", "stock trading", "retail banking", "consumer banking", "payment app", "buy now pay later", "bnpl", "challenger bank"]
AI_IN_FINTECH_TEXT = ["artificial intelligence", "machine learning", "ai-powered", "ai platform", "llm", "large language model", "generative ai", "neural network"]

# Consumer AI.
CONSUMER_WORDS = [
    "dating app", "dating platform", "matchmaking", "relationship app", "social network", "social media app", "social platform",
    "photo editor", "photo editing", "selfie", "face filter", "personal assistant", "life coach", "habit tracker", "fitness app",
    "workout app", "diet app", "meditation app", "journaling app", "diary app", "game", "gaming", "mobile game", "casual game",
    "entertainment app", "music app", "video app", "streaming app", "b2c", "consumer app", "consumer product", "consumer-facing",
    "app store", "play store", "mobile-first", "consumer startup", "individual users", "personal use", "everyday users",
]
CONSUMER_NAMES = ["dating", "social", "selfie", "photo", "game", "gaming", "match", "love", "friend", "chat", "snap", "gram", "music", "video", "stream", "play", "fun"]
CONSUMER_DESCRIPTIONS = ["consumer", "b2c", "dating", "social", "gaming", "game", "personal use", "individual users", "app store", "mobile app"]
ENTERPRISE_DESCRIPTIONS = ["b2b", "enterprise", "business", "saas", "platform", "api", "infrastructure"]
CONSUMER_CATEGORIES = ["consumer_ai", "gaming_ai", "social_ai"]

# Words without which a category isn't believed.
CATEGORY_WORDS = {
    "crypto": ["crypto", "cryptocurrency", "blockchain", "web3", "defi", "nft", "token", "stablecoin", "bitcoin", "ethereum", "solana"],
    "fintech": ["neobank", "payments", "lending", "banking", "trading", "fintech", "payment", "credit", "loan", "brokerage", "neobroker"],
    "healthcare": ["biotech", "pharmaceutical", "pharma", "clinical", "medical", "drug", "therapy", "patient", "healthcare", "health care"],
    "hardware": ["semiconductor", "chip", "hardware", "device", "manufacturing", "sensor", "robotics", "physical", "electronics"],
    "saas": ["saas", "software as a service", "subscription software", "cloud software", "enterprise software"],
}

# Names that are titles.
TITLE_PATTERNS = [
    r"'s\s+(problem|challenge|crisis|issue|opportunity|dilemma|future|guide|next|biggest|latest|new|great)",
    r"^(how|why|what|when|where|who|which|can|will|should|is|are|does|do)\s+",
    r"^the\s+(problem|future|guide|art|science|rise|fall|state|end|best|worst|top|only|real|truth|power|secret|key|way|case|death|birth|age|era|dawn|race|battle|fight|war|promise|perils|myth|reality|answer|question)\b",
    r"^a\s+(guide|look|deep|new|better|simple|complete|brief|quick|closer|comprehensive|radical|bold|different|revolutionary)\b",
    r"(problem|challenge|crisis|issue|opportunity|future|guide|revolution|transformation|disruption|solution|solved)$",
    r"^\d+\s+(ways?|tips|secrets|lessons|habits|mistakes|things|reasons|steps|strategies|trends|predictions|companies|startups)",
    r"^(building|creating|scaling|growing|launching|transforming|disrupting|revolutionizing|rethinking|reimagining|solving|tackling|fixing|navigating)\s+",
    r"(problem-solving|next-gen|cutting-edge|state-of-the-art|ground-breaking|game-changing)",
    r"^(why|how)\s+.*\s+(is|are|will|can|should|must|might)\b",
    r":\s+.{10,}$",
]
TITLE_PARTS = [
    "problem", "challenge", "crisis", "issue", "opportunity", "dilemma", "'s construction", "'s future", "'s challenge", "'s problem",
    "'s biggest", "'s latest", "'s next act", "'s new", "'s great", "the rise of", "the fall of", "the future of", "the state of",
    "the end of", "the death of", "the birth of", "the age of", "revolution", "transformation", "disruption", "reinvention", "how to",
    "why you", "what you", "when to",
]

# Signal scoring.
AI_WORDS = [
    "ai", "artificial intelligence", "machine learning", "ml", "llm", "gpt", "neural", "deep learning", "nlp", "transformer",
    "generative", "agent", "langchain", "openai", "anthropic", "claude", "chatgpt", "copilot",
]
ENTERPRISE_WORDS = [
    "enterprise", "b2b", "saas", "api", "sdk", "infrastructure", "database", "cloud", "devops", "mlops", "security", "compliance",
    "observability", "monitoring", "analytics", "data pipeline",
]
FUNDING_WORDS = ["series a", "series b", "seed", "raised", "funding", "backed by", "venture", "investor", "capital", "valuation"]
FOUNDING_ROLES = ["founding", "co-founder", "cto", "ceo", "head of", "vp of", "director of"]
ENGINEERING_ROLES = ["engineer", "developer", "architect"]
SIGNAL_AGENTS = ["stripe atlas", "clerky", "legalzoom", "rocket lawyer", "harvard business services", "northwest registered", "incorp services"]
RECENT_WORDS = ["today", "yesterday", "this week", "last week", "days ago"]
AI_NAME_WORDS = ["ai", "ml", "intelligence", "neural", "gpt", "llm"]
TECH_NAME = (
    r"\b(ai|ml|labs?|tech|technologies|systems|software|platform|cloud|data|analytics|cyber|security)\b"
    r"|\b(automation|robotics|bio|health|med|fin|dev|ops|infrastructure)\b"
    r"|\b(intelligence|agent|bot|quantum|neural|deep|machine)\b"
)
REGISTRY_AGENTS = [
    "corporation service company", "csc", "ct corporation", "registered agents inc", "harvard business services",
    "delaware registered agent", "incorp services", "northwest registered agent", "rocket lawyer", "legalzoom", "stripe atlas", "clerky",
]

# Token prices per million: input, output, cache read, cache write.
TOKEN_PRICES = (0.80, 4.00, 0.08, 1.00)

# Tracked funds, in order, with the names that they go by, and names that only look like theirs.
FUND_NAMES = {
    "a16z": ["andreessen horowitz", "a16z bio", "a16z games", "a16z"], "sequoia": ["sequoia capital", "sequoia"], "benchmark": ["benchmark capital", "benchmark"],
    "founders_fund": ["founders fund"], "greylock": ["greylock partners", "greylock"], "accel": ["accel partners", "accel"], "index": ["index ventures"],
    "insight": ["insight partners"], "felicis": ["felicis ventures", "felicis"], "redpoint": ["redpoint ventures", "redpoint"], "khosla": ["khosla ventures", "khosla"],
    "menlo": ["menlo ventures"], "bessemer": ["bessemer venture partners", "bessemer", "bvp"], "gv": ["google ventures", "gv"], "usv": ["union square ventures", "usv"],
    "thrive": ["thrive capital", "thrive"], "general_catalyst": ["general catalyst"], "first_round": ["first round capital", "first round"],
}
NOT_FUNDS = {
    "a16z": ["a16z crypto", "crypto fund", "a16z cryptocurrency"], "gv": ["nyse:gv", "nyse: gv", "gv stock", "visionary holdings", "global ventures"],
    "thrive": ["thrive global", "thrive it", "thrive market", "thrive services", "thrive pet", "thrive wellness", "thrive causemetics", "thrive fitness"],
    "sequoia": ["hongshan", "peak xv", "sequoia india", "sequoia china", "sequoia heritage"],
    "benchmark": ["benchmark international", "benchmark electronics", "benchmark capital management", "benchmark mineral", "benchmark litigation"],
    "insight": ["insight venture management"], "index": ["index fund", "stock index", "s&p index", "market index"], "accel": ["accelerator program", "accel entertainment"],
    "menlo": ["menlo college", "menlo school"], "redpoint": ["redpoint bio", "redpoint positioning", "redpoint global"],
}

# Language that shows who led a round.
LEAD_LANGUAGE = r"\bled\s+by\b|\bled\s+the\b|\bleads?\s+|\bleading\b|\bco-led\b|\bco-leads?\b|\bheaded\s+by\b|\blead\s+investor\b|\bspearheaded\b"

# Rounds, and what exports call them.
ROUNDS = ["pre_seed", "seed", "series_a", "series_b", "series_c", "series_d", "series_e_plus", "growth", "debt", "unknown"]
EXPORT_ROUNDS = {
    "pre-seed": "pre_seed", "seed": "seed", "series a": "series_a", "series b": "series_b", "series c": "series_c", "series d": "series_d",
    "series e": "series_e_plus", "series f": "series_e_plus", "series g": "series_e_plus", "series h": "series_e_plus", "growth": "growth",
    "venture": "unknown", "venture - series unknown": "unknown", "debt financing": "debt", "convertible note": "seed", "angel": "pre_seed", "grant": "unknown",
}

# Aircraft categories by number, and states by name.
AIRCRAFT = [
    "unknown", "unknown", "light", "small", "large", "high_vortex", "heavy", "high_perf", "rotorcraft", "glider", "lighter_than_air", "parachutist",
    "ultralight", "reserved", "uav", "space_vehicle", "emergency", "service", "ground_obstacle", "cluster_obstacle", "line_obstacle",
]
STATES = {
    "ALABAMA": "AL", "ALASKA": "AK", "ARIZONA": "AZ", "ARKANSAS": "AR", "CALIFORNIA": "CA", "COLORADO": "CO", "CONNECTICUT": "CT", "DELAWARE": "DE",
    "FLORIDA": "FL", "GEORGIA": "GA", "HAWAII": "HI", "IDAHO": "ID", "ILLINOIS": "IL", "INDIANA": "IN", "IOWA": "IA", "KANSAS": "KS", "KENTUCKY": "KY",
    "LOUISIANA": "LA", "MAINE": "ME", "MARYLAND": "MD", "MASSACHUSETTS": "MA", "MICHIGAN": "MI", "MINNESOTA": "MN", "MISSISSIPPI": "MS", "MISSOURI": "MO",
    "MONTANA": "MT", "NEBRASKA": "NE", "NEVADA": "NV", "NEW HAMPSHIRE": "NH", "NEW JERSEY": "NJ", "NEW MEXICO": "NM", "NEW YORK": "NY",
    "NORTH CAROLINA": "NC", "NORTH DAKOTA": "ND", "OHIO": "OH", "OKLAHOMA": "OK", "OREGON": "OR", "PENNSYLVANIA": "PA", "RHODE ISLAND": "RI",
    "SOUTH CAROLINA": "SC", "SOUTH DAKOTA": "SD", "TENNESSEE": "TN", "TEXAS": "TX", "UTAH": "UT", "VERMONT": "VT", "VIRGINIA": "VA", "WASHINGTON": "WA",
    "WEST VIRGINIA": "WV", "WISCONSIN": "WI", "WYOMING": "WY", "DISTRICT OF COLUMBIA": "DC",
}

# Industries by kind, for deals of exports.
INDUSTRIES = {
    "crypto": ["cryptocurrency", "crypto", "blockchain", "web3", "defi", "nft", "decentralized", "bitcoin", "ethereum"],
    "ai": ["artificial intelligence", "ai", "machine learning", "ml", "generative ai", "deep learning", "natural language processing", "nlp", "computer vision", "robotics", "automation"],
    "consumer": [
        "consumer", "e-commerce", "ecommerce", "retail", "marketplace", "social media", "social network", "dating", "gaming", "games", "entertainment", "media", "music", "video", "streaming",
        "food delivery", "food tech", "consumer electronics", "travel", "hospitality", "real estate",
    ],
    "security": ["cyber security", "cybersecurity", "network security", "security", "information security", "identity management", "fraud detection"],
    "vertical_saas": [
        "health care", "healthcare", "medical", "health tech", "healthtech", "life science", "biotechnology", "therapeutics", "pharmaceuticals", "fintech", "financial services", "banking", "payments",
        "insurance", "insurtech", "regtech", "wealthtech", "legal tech", "legaltech", "compliance", "hr tech", "hrtech", "human resources", "recruiting", "workforce",
    ],
    "data_intelligence": ["data storage", "database", "data management", "data infrastructure", "big data", "data science", "data engineering"],
    "infrastructure": [
        "enterprise software", "saas", "developer tools", "developer platform", "analytics", "data analytics", "business intelligence", "devops", "cloud computing", "infrastructure",
        "platform as a service", "software as a service", "information technology", "it services",
    ],
}
AI_IN_EXPORT = ["ai-", "ai ", " ai", "artificial intelligence", "machine learning", "ml-powered", "llm"]
ENTERPRISE_IN_EXPORT = ["enterprise", "b2b", "business", "platform", "saas", "developer"]

# Industries of filings that venture funds back, and the least amount.
BACKED_INDUSTRIES = ["technology", "computers", "software", "telecommunications", "biotechnology", "health care", "energy", "manufacturing"]
BACKED_AMOUNT = 500_000

# Titles of leaders, and parts of profile addresses that are no names.
LEADERS = ["ceo", "chief executive", "founder", "co-founder", "cofounder", "president", "cto", "chief technology", "coo", "chief operating", "managing director", "general partner", "owner", "principal"]
NO_NAMES = ["ceo", "cto", "cfo", "coo", "founder", "cofounder", "president", "md", "mba", "phd", "dr", "prof", "jr", "sr", "iii", "ii", "1", "2", "3", "123", "01", "02"]

# Signs of a fund raising for itself.
FUND_RAISES = [
    "raised a fund", "raised a new fund", "new fund", "fund i", "fund ii", "fund iii", "fund iv", "fund v", "fund vi", "fund vii", "fund viii", "fund ix", "fund x", "limited partners", "lp commitments",
    "fund size", "assets under management", "aum", "fundraising",
]
FUND_NAME_END = r"\bfund\s*((?:i{1,3}|iv|vi{0,3}|ix|xi{0,3}|xiv|xvi{0,3}|x{1,2}|xv)|[0-9]+)?\s*,?\s*(lp|llc|llp)?$"
SPECIAL_VEHICLE = r"\bspv[\s\-]?([0-9]+|[ivxlc]+)?\b"

# Funding words of feeds.
FEED_WORDS = [
    "raises", "raised", "funding", "series a", "series b", "series c", "series d", "seed", "million", "billion", "led by", "investment", "round", "valuation", "venture", "capital", "secures", "closes",
    "announces", "backs", "invests",
]
FEED_AI_WORDS = ["saas", "b2b", "enterprise", "ai", "infrastructure", "devops", "security", "cybersecurity", "fintech", "healthtech", "devtools", "platform", "api", "cloud", "automation", "agent", "llm"]

# Words that rule pages of funds out, and words that they must have.
PAGE_EXCLUDES = {
    "accel": ["accel entertainment", "accel gaming", "distributed gaming", "video gaming terminal", "vgt", "acel", "nyse: acel", "nyse:acel", "casino", "slot machine", "gaming terminal"],
    "gv": ["visionary holdings", "nyse:gv", "nyse: gv", "ticker: gv", "stock: gv", "gv ticker", "visionary group"],
    "sequoia": ["hongshan", "peak xv", "sequoia india", "sequoia china", "sequoia southeast asia", "sequoia sea"],
    "thrive": ["thrive it services", "thrive global", "thrive market", "thrive pet healthcare", "thrive fitness", "thrive causemetics", "thrive wellness"],
    "benchmark": ["benchmark international", "benchmark electronics", "benchmark capital management", "benchmark mineral", "benchmark litigation"],
}
PAGE_REQUIRES = {"thrive": ["thrive capital", "thrive led", "led by thrive", "josh kushner"], "benchmark": ["benchmark capital", "benchmark partners", "benchmark led", "led by benchmark"]}
TITLE_ONLY_PAGES = ["sequoia"]
CRYPTO_NOISE = ["price prediction", "exchange review", "best crypto exchange", "how to buy", "trading guide", "price analysis", "referral code", "cloud mining", "daily returns"]
VENTURE_WORDS = ["raises", "raised", "funding", "series", "seed", "million", "billion", "led by", "investment", "round", "valuation", "venture", "capital", "secures", "closes", "bags", "snaps"]
POST_WORDS = ["funding", "raised", "series", "seed", "investment", "led by", "announces", "closes", "million", "venture", "portfolio", "backed", "round"]
MARK_WORDS = [
    "ai", "artificial intelligence", "machine learning", "cloud", "saas", "platform", "analytics", "cyber", "security", "data", "automation", "bot", "agent", "api", "infrastructure", "devops", "fintech",
    "healthtech", "biotech",
]
MARK_CLASSES = ["009", "035", "042"]
MARK_STARTUPS = ["inc", "labs", "technologies", "systems", "ventures", "co", "hq", "studio"]

# Portfolio pages of funds, and signs on a fund's own pages that it leads.
PORTFOLIO_PAGES = {
    "a16z": "https://a16z.com/portfolio/", "sequoia": "https://www.sequoiacap.com/our-companies/", "founders_fund": "https://foundersfund.com/portfolio/", "benchmark": "https://www.benchmark.com/portfolio/",
    "greylock": "https://greylock.com/portfolio/", "khosla": "https://www.khoslaventures.com/portfolio", "index": "https://www.indexventures.com/companies/", "insight": "https://www.insightpartners.com/portfolio/",
    "bessemer": "https://www.bvp.com/portfolio", "accel": "https://www.accel.com/companies", "felicis": "https://www.felicis.com/portfolio", "general_catalyst": "https://www.generalcatalyst.com/portfolio",
    "first_round": "https://firstround.com/companies/", "menlo": "https://www.menlovc.com/portfolio/", "redpoint": "https://www.redpoint.com/companies/", "usv": "https://www.usv.com/companies/",
    "gv": "https://www.gv.com/portfolio/",
}
PAGE_LEADS = (
    r"(?:we(?:'re| are) leading|we led (?:the |a |)|we're excited to lead|we are pleased to lead|our investment leads|our firm (?:is |)leading|usv (?:is |)lead(?:s|ing)"
    r"|led by (?:usv|union square)|union square ventures (?:is |)leading|union square ventures led|usv led (?:the |a |))"
)

# Rounds of structured deals.
INGEST_ROUNDS = {
    "pre_seed": "pre_seed", "pre-seed": "pre_seed", "seed": "seed", "series_a": "series_a", "series a": "series_a", "series_b": "series_b", "series b": "series_b", "series_c": "series_c",
    "series c": "series_c", "series_d": "series_d", "series d": "series_d", "series_e": "series_e_plus", "series e": "series_e_plus", "series_e_plus": "series_e_plus", "series f": "series_e_plus",
    "series g": "series_e_plus", "series h": "series_e_plus", "growth": "growth", "debt": "debt", "unknown": "unknown",
}

# Searches for deals: names of funds, what to leave out, and words of categories.
QUERY_FUNDS = {
    "founders_fund": "Founders Fund", "benchmark": "Benchmark", "sequoia": "Sequoia Capital", "khosla": "Khosla Ventures", "index": "Index Ventures", "a16z": "Andreessen Horowitz", "insight": "Insight Partners",
    "bessemer": "Bessemer Venture Partners", "redpoint": "Redpoint Ventures", "greylock": "Greylock Partners", "gv": "Google Ventures", "menlo": "Menlo Ventures", "usv": "Union Square Ventures",
    "thrive": "Thrive Capital", "accel": "Accel Partners", "felicis": "Felicis Ventures", "general_catalyst": "General Catalyst", "first_round": "First Round Capital",
}
QUERY_EXCLUDES = {
    "gv": ['-"NYSE:GV"', '-"GV stock"', '-"Visionary Holdings"', '-"GV ticker"'], "thrive": ['-"Thrive Global"', '-"Thrive IT"', '-"Thrive Market"', '-"Thrive Wellness"'],
    "sequoia": ['-"Sequoia National"', "-HongShan", '-"Peak XV"', '-"Sequoia India"', '-"Sequoia China"'], "benchmark": ["-benchmark.com", '-"Benchmark International"', '-"Benchmark Electronics"'],
    "accel": ['-"Accel Entertainment"'], "index": ['-"index fund"', '-"stock index"', '-"S&P index"', '-"market index"'], "insight": ['-"market insight"', '-"business insight"', '-"consumer insight"'],
    "menlo": ['-"Menlo Park"', '-"Menlo College"', '-"Menlo School"'], "redpoint": ['-"Redpoint Bio"', '-"Redpoint Positioning"'], "first_round": ['-"first round pick"', '-"first round draft"', "-NFL", "-NBA"],
}
ENTERPRISE_QUERIES = {
    "infrastructure": '"AI infrastructure" OR "LLMOps" OR "MLOps" OR "vector database"', "security": '"AI security" OR "cybersecurity AI" OR "AI threat detection"',
    "vertical_saas": '"AI SaaS" OR "enterprise AI" OR "B2B AI"', "agentic": '"AI agents" OR "agentic AI" OR "AI automation" OR "AI copilot"',
    "data_intelligence": '"AI analytics" OR "enterprise search AI" OR "knowledge management AI"',
}

# Funding words of each feed, and words of enterprise AI.
FEEDS = {
    "techcrunch": ["raises", "raised", "funding", "series a", "series b", "series c", "series d", "seed", "million", "billion", "led by", "investment", "round", "valuation", "venture", "capital"],
    "axios_prorata": [
        "raises", "raised", "funding", "series a", "series b", "series c", "series d", "seed", "million", "billion", "led by", "investment", "round", "valuation", "venture", "capital", "secures", "closes",
        "announces", "backs", "invests", "deal", "exclusive", "scoop",
    ],
    "crunchbase_news": FEED_WORDS,
    "fortune_term_sheet": [
        "raises", "raised", "funding", "series", "seed", "million", "billion", "led by", "investment", "round", "valuation", "venture", "capital", "deal", "closes", "closed", "secures", "secured", "lands",
    ],
    "strictlyvc": [
        "raises", "raised", "funding", "series a", "series b", "series c", "series d", "seed", "million", "billion", "led by", "investment", "round", "valuation", "venture", "capital", "secures", "closes",
        "announces", "backs", "invests", "deal", "exclusive",
    ],
    "tech_funding_news": ["raises", "raised", "funding", "series", "seed", "million", "billion", "led by", "investment", "round", "valuation", "venture", "capital", "secures", "bags", "snaps", "hits", "closes", "announces"],
    "venturebeat": [
        "raises", "raised", "funding", "series a", "series b", "series c", "series d", "seed", "million", "billion", "led by", "investment", "round", "valuation", "venture", "capital", "secures", "closes",
        "announces", "backs", "invests", "funding round",
    ],
    "hackernews": ["raises", "raised", "funding", "series", "seed", "million", "billion", "led by", "investment", "round", "valuation", "venture", "capital", "yc", "y combinator"],
}
VENTUREBEAT_AI_WORDS = [*FEED_AI_WORDS, "genai", "generative ai", "machine learning", "deep learning"]
AI_FEEDS = ["tech_funding_news", "axios_prorata", "crunchbase_news", "strictlyvc", "venturebeat"]

# Negative keywords of funds, words that rule news searches out, and tracked names in press releases.
FUND_NEGATIVES = {
    "benchmark": ["International", "Electronics", "Benchmark Capital Management"], "sequoia": ["HongShan", "Peak XV", "Sequoia India", "Sequoia China"], "bessemer": ["BVP Forge"],
    "gv": ["Visionary Holdings", "GV Ticker", "NYSE:GV"], "thrive": ["Thrive IT Services", "Thrive Global", "Thrive Market"],
}
NEWS_EXCLUDES = {
    "thrive": ["Thrive Global", "Thrive IT", "Thrive Market", "Thrive Wellness", "Arianna Huffington"], "benchmark": ["Benchmark Electronics", "Benchmark International", "Benchmark Mineral"],
    "first_round": ["first round pick", "NFL", "NBA", "first round draft", "playoff"], "gv": ["NYSE:GV", "Visionary Holdings", "stock ticker GV", "GV stock"], "redpoint": ["Redpoint Bio", "Redpoint Biopharmaceutical"],
}
WIRE_NAMES = [
    "founders fund", "benchmark", "sequoia", "khosla", "index ventures", "andreessen horowitz", "insight partners", "bessemer", "redpoint", "greylock", "google ventures", "menlo ventures", "union square",
    "thrive capital", "accel", "felicis", "general catalyst", "first round", "peter thiel", "bill gurley", "sarah tavel", "vinod khosla", "reid hoffman", "tomasz tunguz", "logan bartlett", "josh kopelman",
    "josh kushner",
]
WIRE_SHORT_NAMES = ["a16z", "gv", "usv", "bvp"]

# Companies that are no startups, signs of startups, and signs of stealth in job posts.
ESTABLISHED = [
    "amazon", "google", "alphabet", "meta", "facebook", "apple", "microsoft", "nvidia", "netflix", "tesla", "twitter", "x corp", "salesforce", "oracle", "ibm", "intel", "amd", "qualcomm", "cisco", "adobe",
    "vmware", "dell", "hp", "hpe", "uber", "lyft", "airbnb", "doordash", "instacart", "spotify", "snap", "pinterest", "reddit", "linkedin", "tiktok", "bytedance", "jpmorgan", "goldman", "morgan stanley",
    "bank of america", "wells fargo", "visa", "mastercard", "paypal", "square", "block",
]
STARTUP_SIGNS = [
    "launches from stealth", "emerges from stealth", "exits stealth", "comes out of stealth", "raises", "raised", "seed round", "series a", "series b", "series c", "funding round", "founded by",
    "founding team", "backed by", "led by", "new startup", "startup announces",
]
JOB_PLACES = [
    "remote", "hybrid", "onsite", "on-site", "usa", "us", "uk", "san francisco", "new york", "nyc", "los angeles", "la", "seattle", "austin", "boston", "chicago", "denver", "miami", "london", "berlin",
    "paris", "singapore", "tokyo", "california", "texas", "washington", "massachusetts",
]
STEALTH_WORDS = ["stealth", "stealth mode", "stealth startup", "well-funded startup", "recently funded", "pre-launch", "unannounced"]
NO_STEALTH = ["not stealth", "no longer stealth", "exited stealth", "out of stealth", "left stealth", "emerged from stealth"]

# Words of developer tools and of accelerator companies for enterprises, signs on funds' pages, regions.
DEVTOOL_WORDS = [
    "api", "sdk", "cli", "framework", "platform", "infrastructure", "database", "queue", "cache", "storage", "cloud", "ai", "ml", "llm", "gpt", "agent", "embedding", "vector", "langchain", "llamaindex", "rag",
    "transformer", "deploy", "ci", "cd", "kubernetes", "docker", "terraform", "monitoring", "observability", "logging", "tracing", "security", "auth", "identity", "encryption", "compliance", "analytics",
    "etl", "pipeline", "warehouse", "lakehouse",
]
BATCH_WORDS = ["b2b", "enterprise", "saas", "infrastructure", "api", "platform", "developer", "devtools", "ai", "ml", "llm", "automation", "workflow", "agent", "copilot"]
FOLLOW_ONS = ["double down", "follow-on", "follow on", "additional investment", "continued support", "expanding our investment"]
INCUBATIONS = ["hatching", "co-creation", "co-founded", "incubat", "studio", "built with gc", "company creation", "company building", "venture creation", "co-built"]
WELCOMES = [
    "welcome to the family", "welcome to the felicis family", "we're thrilled to announce", "we're excited to announce", "proud to announce", "joining the pack", "newest member", "new portfolio company",
    "thrilled to welcome", "excited to welcome",
]
PAGE_AI_WORDS = [
    "artificial intelligence", "machine learning", "deep learning", "neural network", "large language model", "generative ai", "ai-powered", "ai-native", "ai infrastructure", "foundation model", "ml ops",
    "mlops",
]
PAGE_AI_SHORT = ["ml", "llm", "ai"]
INVESTMENT_TITLES = ["investment in", "investing in", "introducing", "our investment", "congrats", "congratulations", "welcome"]
REGIONS = {
    "us": ["san francisco", "palo alto", "silicon valley", "new york", "boston", "los angeles", "seattle", "austin"],
    "london": ["london", "uk", "united kingdom", "europe", "european", "berlin", "paris", "amsterdam"],
    "india": ["india", "bangalore", "bengaluru", "mumbai", "delhi", "hyderabad", "chennai", "indian"],
}
OTHER_VERTICALS = ["crypto", "web3", "bio", "games", "gaming", "consumer", "nft", "defi"]

# Well-known companies on portfolio pages.
WELL_KNOWN = [
    "google", "alphabet", "meta", "facebook", "amazon", "apple", "microsoft", "nvidia", "netflix", "tesla", "twitter", "x", "airbnb", "doordash", "uber", "lyft", "pinterest", "snap", "snapchat", "spotify",
    "shopify", "stripe", "instacart", "coinbase", "robinhood", "snowflake", "datadog", "crowdstrike", "cloudflare", "mongodb", "elastic", "palantir", "unity", "roblox", "discord", "reddit", "linkedin",
    "salesforce", "workday", "servicenow", "atlassian", "slack", "zoom", "dropbox", "box", "docusign", "okta", "twilio", "sendgrid", "hubspot", "zendesk", "freshworks", "monday", "asana", "notion", "figma",
    "canva", "miro", "airtable", "webflow", "plaid", "brex", "ramp", "gusto", "rippling", "deel", "square", "block", "paypal", "klarna", "affirm", "chime", "whatsapp", "youtube", "instagram", "waze", "nest",
    "fitbit", "github", "gitlab", "bitbucket", "heroku", "vercel", "netlify", "spacex", "openai", "anthropic", "anduril", "skype", "samsara", "pagerduty", "oculus", "databricks", "splunk", "wise", "retool",
    "linear", "vanta",
]

# Names that an extractor makes up.
NO_COMPANY = ["<unknown>", "unknown", "n/a", "none", "tbd", ""]
MADE_UP_NAMES = [r"^unnamed\s+", r"^untitled\s+", r"^unidentified\s+", r"^undisclosed\s+", r"\s+startup$", r"^the\s+company$", r"^a\s+new\s+", r"^stealth\s+"]

# people's names in titles of profiles.
NAME_ENDS = [" - ", " | ", " • ", " – ", " — ", ": ", ", "]
ROLE_WORDS = ["ceo", "cto", "founder", "president", "director", "head of", "vp "]
GENERIC_WORDS = [
    "ceo", "cto", "cfo", "coo", "cmo", "cpo", "ciso", "cro", "founder", "founders", "cofounder", "president", "chairman", "director", "manager", "engineer", "developer", "designer", "analyst", "consultant",
    "specialist", "coordinator", "associate", "head", "chief", "senior", "junior", "lead", "principal", "staff", "vice", "executive", "officer", "partner", "member", "profile", "page", "company", "linkedin",
    "view", "about", "contact", "support", "admin", "team", "portal", "official", "careers", "jobs", "hiring", "recruiting", "talent", "hr", "sales", "marketing", "product", "business", "corporate", "global",
    "international", "regional", "local", "national", "north", "south", "east", "west", "central", "americas", "emea", "apac", "operations", "finance", "legal", "technology", "research", "customer", "client",
    "service", "services", "solutions",
]
NO_PEOPLE = ["postings", "jobs", "careers", "hiring", "official", "team", "admin", "support", "contact", "sales", "recruiting", "talent", "openings"]
PROFILE_TITLES = r"\b(CEO|CTO|COO|CFO|Founder|Co-Founder|President|Chief\s+\w+\s+Officer|Managing\s+Director|VP\s+of|Vice\s+President|Director\s+of|Head\s+of)\b"

# Websites that are no startup's, and what tells a startup's.
NO_STARTUP_SITES = [
    "crunchbase.com", "linkedin.com", "twitter.com", "facebook.com", "bloomberg.com", "techcrunch.com", "forbes.com", "reuters.com", "wikipedia.org", "pitchbook.com", "cbinsights.com", "tracxn.com", "owler.com",
    "zoominfo.com", "apollo.io", "glassdoor.com", "indeed.com", "ycombinator.com", "producthunt.com", "github.com", "youtube.com", "medium.com", "substack.com", "sec.gov", "businesswire.com", "prnewswire.com",
    "spotify.com", "apple.com", "amazon.com", "google.com", "rangers.co.uk", "leonalewismusic.com", "apache.org", "music.com", "band.com", "artist.com", "wix.com", "squarespace.com", "wordpress.com",
    "blogspot.com",
]
FALSE_SITES = {
    "maven": ["apache.org", "maven.apache.org"], "leona": ["leonalewis", "music", "leonalewismusic"], "ranger": ["rangers.co.uk", "rangerfc", "football", "soccer"], "unknown": ["weareunknown"],
    "miden": ["miden.co"], "0xmiden": ["miden.co"], "graphite": ["graphitehealth", "graphitehealth.io", "graphitehealth.com"],
}
HEALTH_SITES = ["health", "medical", "clinic", "hospital", "pharma", "care"]
SITE_ENDINGS = [
    "com", "io", "ai", "co", "dev", "app", "tech", "cloud", "xyz", "me", "health", "bio", "so", "gg", "net", "org", "us", "uk", "eu", "info", "de", "ch", "nl", "fr", "se", "no", "at", "be", "fi", "dk", "es",
    "it", "pl", "studio", "solutions", "systems", "ventures", "fund", "consulting",
]

# Words too common to stand for a company.
COMMON_WORDS = [
    "intelligence", "analytics", "platform", "systems", "solutions", "technologies", "software", "digital", "global", "modern", "industrial", "capital", "ventures", "partners", "group", "labs", "studio",
    "works", "network", "networks", "media", "services", "consulting", "research", "enterprise", "automation", "robotics", "autonomous", "machine", "learning", "neural", "cognitive", "smart", "advanced",
    "next", "future", "first",
]

# Parts of long articles that are kept, the characters kept in all, and the share of them from the beginning.
KEPT_PARTS = [r"\$[\d,]+\s*(?:million|billion|M|B)?", r"(?:raised|raises|securing|secures)\s+\$[\d,]+", r"series\s+[a-z]", r"(?:led|co-led)\s+by", r"seed\s+(?:round|funding)", r"pre-seed"]
KEPT_CHARACTERS = 4000
KEPT_HEAD = 0.7

# Amounts in headlines, companies in titles, registry names in search results.
HEADLINE_AMOUNTS = [r"[\$€£][\d,]+(?:\.\d+)?[MBmb](?:illion)?", r"[\$€£][\d,]+(?:\.\d+)?\s*(?:million|billion)", r"[\d,]+(?:\.\d+)?[MBmb]\s*(?:round|funding|raise)"]
SIGNAL_TITLES = [
    r"^(?:GitHub Trending: )?([A-Za-z0-9_-]+/[A-Za-z0-9_-]+)", r"^(?:YC [A-Z]\d+: )?(.+?)(?:\s*[-–—:]\s*.+)?$", r"^(?:Delaware Filing: )?(.+?)(?:\s*[-–—:]\s*.+)?$",
    r"^(?:Stealth Signal: )?(.+?)(?:\s*[-–—:]\s*.+)?$", r"^(.+?)(?:\s*[-–—:]\s*.+)?$",
]
REGISTRY_NAMES = [
    r'"([^"]+(?:Inc\.?|LLC|Corp\.?|Technologies|Labs|AI))"', r"([A-Z][a-zA-Z0-9]+(?:\s+[A-Z][a-zA-Z0-9]+)*(?:\s+(?:Inc\.?|LLC|Corp\.?|Technologies|Labs|AI)))", r"startup\s+([A-Z][a-zA-Z0-9]+)",
    r"company\s+([A-Z][a-zA-Z0-9]+)",
]
REGISTRY_TITLE_END = r"(?i)\s*[-|]\s*(Delaware|Corporation|Corp|Inc|LLC|Filing|Incorporation|State|Division).*$"

# Partners of funds, and words of investment that must stand with them.
PARTNERS = {
    "benchmark": ["chetan puttagunta", "peter fenton", "eric vishria", "bill gurley", "sarah tavel", "miles grimshaw", "victor lazarte"],
    "founders_fund": [
        "peter thiel", "napoleon ta", "trae stephens", "lauren gross", "scott nolan", "john luttig", "delian asparouhov", "joey krug", "matias van thienen", "amin mirzadegan", "sean liu", "keith rabois",
        "brian singerman",
    ],
    "khosla": ["vinod khosla", "samir kaul", "sven strohband", "david weiden", "keith rabois", "ethan choi", "kanu gulati", "alex morgan", "jai sajnani"],
    "greylock": [
        "reid hoffman", "asheem chandna", "jerry chen", "saam motamedi", "seth rosenberg", "mike duboe", "david sze", "josh elman", "corinne riley", "christine kim", "mor chen", "shreya shekhar",
    ],
    "redpoint": ["tomasz tunguz", "logan bartlett", "annie kadavy", "scott raney", "jason warner"],
    "gv": [
        "m.g. siegler", "mg siegler", "crystal huang", "terri burns", "krishna yeshwant", "frédérique dame", "frederique dame", "david krane", "tyson clark", "brendan bulik-sullivan", "sangeen zeb", "issi rozen",
    ],
    "thrive": ["josh kushner", "kareem zaki", "nabil mallick", "belen mella", "gaurav ahuja", "joe kahn", "kyle yuan"],
    "first_round": ["josh kopelman", "todd jackson", "brett berson", "bill trenchard", "meka asonye", "liz wessel", "hayley barna"],
}
INVESTMENT_WORDS = [
    "led", "leads", "leading", "co-led", "invested", "invests", "investing", "investment", "backed", "backs", "backing", "funding", "funded", "round", "series a", "series b", "series c", "seed", "raised",
    "raises", "raising", "participated", "participating", "participation", "joined", "joining",
]

# Sources whose articles say little, figures of markets, and when an extraction is tried again.
OUTSIDE_FUNDS = ["thrive", "benchmark", "greylock", "gv", "redpoint", "founders_fund", "first_round", "khosla"]
OUTSIDE_SOURCES = ["google_news", "brave_search", "sec_edgar", "news_aggregator"]
MARKET_SIZES = [
    r"\$\s*(\d+(?:\.\d+)?)\s*(?:billion|B)\s*(?:market|industry|opportunity|TAM|sector)", r"(?:market|industry|opportunity|TAM|sector)\s*(?:size|worth|valued at|of)\s*\$\s*(\d+(?:\.\d+)?)\s*(?:billion|B)",
    r"(?:spend|spending|spent)\s*(?:over|approximately|about|around)?\s*\$\s*(\d+(?:\.\d+)?)\s*(?:billion|B)", r"\$\s*(\d+(?:\.\d+)?)\s*(?:billion|B)\s*(?:annually|per year|a year)",
]
AGAIN_FROM, AGAIN_FROM_OUTSIDE, AGAIN_TO = 0.45, 0.35, 0.65

# What tracked funds are called in deals.
FUND_LABELS = {
    "founders_fund": "Founders Fund", "benchmark": "Benchmark", "sequoia": "Sequoia Capital", "khosla": "Khosla Ventures", "index": "Index Ventures", "a16z": "a16z", "insight": "Insight Partners",
    "bessemer": "Bessemer Venture Partners", "redpoint": "Redpoint", "greylock": "Greylock", "gv": "GV (Google Ventures)", "menlo": "Menlo Ventures", "usv": "Union Square Ventures", "thrive": "Thrive Capital",
    "accel": "Accel", "felicis": "Felicis Ventures", "general_catalyst": "General Catalyst", "first_round": "First Round Capital",
}

# List pages of funds: where their relative links lead, and what holds an item, in order.
FUND_PAGES = {
    "a16z": ("https://a16z.com", ["article", ".post-card", ".news-item", "[class*='PostCard']", "[class*='NewsCard']", "[class*='article-card']", "[class*='card']", "[class*='Card']", "a[href*='/announcement']"]),
    "accel": ("https://accel.com", ["article", ".news-item", ".post-card", "[class*='news']", "[class*='article']", ".card"]),
    "bessemer": ("https://bvp.com", ["article", ".news-item", ".news-card", ".post", "[class*='news']", "[class*='article']", ".card"]),
    "felicis": ("https://felicis.com", ["article", ".insight", ".insight-card", ".post-card", "[class*='insight']", "[class*='post']", ".card"]),
    "general_catalyst": ("https://www.generalcatalyst.com", ["article", ".news-item", ".post-card", "[class*='news']", "[class*='article']", ".card"]),
    "gv": ("https://gv.com", ["article", ".news-item", ".post", "[class*='news']", "[class*='article']", ".card"]),
    "index": ("https://indexventures.com", ["article", ".perspective-card", ".post-card", "[class*='article']", "[class*='card']", ".insight"]),
    "insight": ("https://insightpartners.com", ["article", ".media-item", ".news-item", ".press-release", "[class*='media']", "[class*='news']", ".card"]),
    "menlo": ("https://menlovc.com", ["article", ".news-item", ".post-card", "[class*='news']", "[class*='post']", ".card"]),
    "redpoint": ("https://www.redpoint.com", ["[class*='card-module']", "[class*='Card']", "article", ".content-item"]),
    "sequoia": ("https://sequoiacap.com", ["article", ".story-card", "[class*='story']", "[class*='Story']", "[class*='post']", "[class*='Post']", "[class*='Card']", "[class*='card']", "a[href*='/article/']"]),
    "usv": ("https://usv.com", ["article", ".blog-post", ".post", "[class*='blog']", "[class*='post']", ".card"]),
}
OWN_DOMAIN_PAGES = {"a16z": "a16z.com", "redpoint": "redpoint.com", "sequoia": "sequoiacap.com"}
SILENT_PAGES = ["first_round", "khosla"]
SIGNAL_SOURCES = {
    "hackernews": "hackernews", "ycombinator": "ycombinator", "github_trending": "github", "github": "github", "linkedin_jobs": "linkedin", "linkedin": "linkedin", "delaware_corps": "delaware", "delaware": "delaware",
}
