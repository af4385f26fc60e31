"""Column names, word lists, weights and defaults.

Every literal whose exact value decides a result lives here, in its natural
order, so that a reader can check it in one place.
"""

# Column headers of the profile tables.
NAME = "企業名稱"
CUST_NO = "104_custNo"
PROFILE = "公司簡介"
WELFARE = "福利制度"
WELFARE_TAGS = "104_welfare_tags"
LEGAL_TAGS = "104_legal_welfare_tags"
SIGNAL = "104_has_snack_related_welfare"
SIGNAL_WORDS = "104_welfare_snack_keywords"
CITY = "104_address_city"
DISTRICT = "104_address_district"
EMPLOYEES = "local_employee_count"
CAPITAL = "local_capital_ntd"
INDUSTRY = "industry"
WEBSITE = "104_website"
ROW_ORD = "row_ord"

# The ten industry flags, keyed by the letter of a business code.
INDUSTRY_BY_LETTER = {
    "A": "農、林、漁、牧業",
    "B": "礦業及土石採取業",
    "C": "製造業",
    "D": "電力及燃氣供應業",
    "E": "營造業",
    "F": "批發、零售及餐飲業",
    "G": "運輸及倉儲業",
    "H": "金融及保險業",
    "I": "專業、科學及技術服務業",
    "J": "文化、運動、娛樂及其他服務業",
}
INDUSTRY_FLAGS = list(INDUSTRY_BY_LETTER.values())

# The four columns that make up the welfare text, in order.
WELFARE_TEXT = [WELFARE, WELFARE_TAGS, LEGAL_TAGS, SIGNAL_WORDS]

# Layout of a finished profile record.
PROFILE_COLUMNS = [
    NAME,
    CUST_NO,
    "104_matched_company_name",
    "104_profile_status",
    "104_official_company_name",
    PROFILE,
    WELFARE,
    WELFARE_TAGS,
    LEGAL_TAGS,
    SIGNAL,
    SIGNAL_WORDS,
    "104_address",
    CITY,
    DISTRICT,
    "104_addr_no_desc",
    WEBSITE,
    EMPLOYEES,
    CAPITAL,
    INDUSTRY,
    *INDUSTRY_FLAGS,
]

# Layout of the contact history.
HISTORY_COLUMNS = [
    "developed_at",
    "company_name",
    "company_key",
    CUST_NO,
    "rank",
    "similarity_score",
    "source",
    "status",
    "outcome",
    "outcome_at",
    "run_id",
]
HISTORY_DEDUPE_KEYS = ["developed_at", "company_key", CUST_NO, "source", "status", "outcome"]

# Layout of the compact lead list.
COMPACT_LEAD_COLUMNS = [
    "outreach_rank",
    "rank",
    NAME,
    "Email",
    "email",
    "contact_email",
    "電子郵件",
    "email_status",
    "email_source_url",
    "email_candidates",
    "similarity_score",
    "score_percentile",
    "manual_physical_letter",
    "n8n_should_email",
    CUST_NO,
    "104_official_company_name",
    WEBSITE,
    WELFARE,
    SIGNAL_WORDS,
    "104_address",
    CITY,
    DISTRICT,
    EMPLOYEES,
    CAPITAL,
    INDUSTRY,
    "top_existing_customer_names",
    "top_existing_customer_scores",
    "last_developed_at",
    "recently_developed",
]

# Weights of the score.
COMPONENT_WEIGHTS = {
    "profile": 0.18,
    "welfare": 0.55,
    "industry": 0.10,
    "size": 0.07,
    "location": 0.04,
    "snack_signal": 0.06,
}
TOP_MIX = {"max": 0.45, "top3": 0.35, "top10": 0.20}
INDUSTRY_MIX = {"jaccard": 0.65, "text": 0.35}
LOCATION_MIX = {"city": 0.7, "district": 0.3}
SIGNAL_MATRIX = {"both": 1.0, "potential_only": 0.45, "neither": 0.25, "customer_only": 0.10}
SIZE_SCALE = 1.5
MAX_DOCUMENT_SHARE = 0.95
GRAM_SIZES = (2, 3, 4)
TOP_MATCHES = 5
TOP_VALUES = 10

# Defaults of the jobs.
CRAWL_TARGET = 500
TOP_LEADS = 100
RECENT_DAYS = 7
MIN_SUCCESS_RATIO = 0.5
LETTER_RANK_LIMIT = 10
PAGES_PER_SITE = 4

# Spellings that count as true.
TRUE_WORDS = ["true", "1", "yes", "y", "是", "有", "t"]

# Words that mark a company as won for good.
WON_WORDS = [
    "won",
    "signed",
    "closed_won",
    "converted",
    "converted_customer",
    "customer",
    "success",
    "successful",
    "deal",
    "成交",
    "簽約",
    "签约",
    "成為客戶",
    "成为客户",
    "正式客戶",
    "正式客户",
    "成功開發",
    "成功开发",
    "開發成功",
    "开发成功",
    "已成交",
    "已簽約",
    "已签约",
    "已成為客戶",
    "已成为客户",
]

# Legal forms removed anywhere in a company key.
KEY_SUFFIXES = ["股份有限公司", "有限公司", "台灣分公司", "臺灣分公司", "分公司", "股份"]

# Legal forms removed once from the end of a core name.
CORE_SUFFIXES = [
    "股份有限公司台灣分公司",
    "股份有限公司臺灣分公司",
    "有限公司台灣分公司",
    "有限公司臺灣分公司",
    "股份有限公司",
    "有限公司",
    "台灣分公司",
    "臺灣分公司",
    "分公司",
    "股份",
]

# Cities in the order in which an address is searched.
CITIES = [
    "台北市",
    "新北市",
    "桃園市",
    "台中市",
    "台南市",
    "高雄市",
    "基隆市",
    "新竹市",
    "嘉義市",
    "新竹縣",
    "苗栗縣",
    "彰化縣",
    "南投縣",
    "雲林縣",
    "嘉義縣",
    "屏東縣",
    "宜蘭縣",
    "花蓮縣",
    "台東縣",
    "澎湖縣",
    "金門縣",
    "連江縣",
]

# Words that show a snack-like benefit.
SNACK_WORDS = [
    "零食",
    "點心",
    "下午茶",
    "happyhour",
    "happy hour",
    "咖啡",
    "咖啡吧",
    "飲料",
    "茶水",
    "員工餐",
    "伙食",
    "餐費",
    "部門聚餐",
    "聚餐",
]

# Registry filter and name match.
REGISTRY_ACTIVE = "01"
REGISTRY_APPROVED = "核准設立"
MATCH_TIERS = ["exact", "core_exact", "partial", "core_partial", "core_fuzzy"]
FUZZY_RATIO = 0.86
MIN_KEYWORD_LENGTH = 3

# Contact addresses.
EMAIL_COLUMNS = ["Email", "email", "contact_email", "電子郵件"]
EMAIL_PATTERN = r"(?<![\w.+-])([A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,})(?![\w.+-])"
EMAIL_STRIP = ".,;:()[]{}<>\"'"
ESCAPED_MARKS = [
    ("\\\\u003c", "<"),
    ("\\\\u003e", ">"),
    ("\\\\u0026", "&"),
    ("\\\\u0040", "@"),
    ("u003c", "<"),
    ("u003e", ">"),
    ("u0026", "&"),
    ("u0040", "@"),
]
BAD_LOCAL_PARTS = ["noreply", "no-reply", "donotreply", "do-not-reply", "example", "test"]
BAD_LOCAL_PREFIXES = ["%", "u00", "x00"]
BAD_TLDS = ["png", "jpg", "jpeg", "gif", "svg", "webp", "css", "js", "pdf"]
BAD_DOMAIN_ENDS = [".example", ".test"]
ROLE_WORDS = ["info", "contact", "service", "sales", "support", "business", "marketing", "hr", "admin"]
ROLE_NAMES = ["info", "contact", "service", "sales"]
ROLE_WORD_POINTS = 30
OWN_DOMAIN_POINTS = 20
ROLE_NAME_POINTS = 10
STRONG_CONTEXTS = [
    "公司聯絡信箱",
    "公司信箱",
    "聯絡信箱",
    "聯絡電子信箱",
    "電子信箱",
    "客服信箱",
    "服務信箱",
    "業務信箱",
    "合作信箱",
    "採購信箱",
    "公關信箱",
    "媒體信箱",
    "contact email",
    "contact e-mail",
    "business email",
    "service email",
]
WEAK_CONTEXTS = [
    "聯絡我們",
    "聯絡方式",
    "客服",
    "服務",
    "業務",
    "合作",
    "採購",
    "公關",
    "媒體",
    "信箱",
    "email",
    "e-mail",
    "mail",
]
NEGATIVE_CONTEXTS = ["訂閱", "退訂", "電子報", "隱私", "履歷", "求職", "招募"]
CONTEXT_CHARS = 140
MAILTO_CHARS = 40
CONTEXT_POINTS = {"strong": 100, "weak": 35, "mailto": 15, "negative": -60}

# Websites and contact pages.
SKIPPED_HOSTS = ["104.com.tw", "facebook.com", "instagram.com", "linkedin.com", "youtube.com", "line.me"]
CONTACT_PATHS = [
    "/contact",
    "/contact-us",
    "/contacts",
    "/about",
    "/about-us",
    "/support",
    "/service",
    "/聯絡我們",
    "/關於我們",
]
CONTACT_WORDS = [
    "contact",
    "contacts",
    "contact-us",
    "contactus",
    "about",
    "about-us",
    "support",
    "service",
    "聯絡",
    "聯繫",
    "客服",
    "關於",
    "公司",
]
SKIPPED_SCHEMES = ["mailto:", "tel:", "javascript:", "#"]

# Links, hosts and web addresses in texts; (?U) counts all white space.
HREF = r"(?i)<a\b[^>]*?\bhref=[\"']([^\"']+)[\"'][^>]*>"
HOST = r"(?i)^[a-z][a-z0-9+.-]*://([^/?#]*)"
LINK = r"(?iU)https?://[^\s,，;；]+"
DOMAIN = r"(?U)(?:www\.)?[A-Za-z0-9][A-Za-z0-9.-]+\.[A-Za-z]{2,}(?:/[^\s,，;；]*)?"
