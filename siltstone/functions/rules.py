"""Word lists, marks and limits that results depend on, stated as they are."""

# Page types: the last path segments that tell them, words in link texts, and the default priority (4: excluded).
# The order settles ties.
PAGE_TYPES = [
    ("about", ["about", "about-us", "our-story"], ["about", "about us", "our story"], 1),
    ("contact", ["contact", "contact-us", "get-in-touch"], ["contact", "contact us", "get in touch"], 1),
    ("wholesale", ["wholesale", "wholesale-enquiries", "become-a-stockist"], ["wholesale", "become a stockist"], 1),
    ("trade", ["trade", "trade-account", "trade-application"], ["trade account", "trade"], 1),
    ("careers", ["careers", "jobs", "work-with-us"], ["careers", "jobs", "work with us"], 1),
    ("shipping", ["shipping", "delivery", "shipping-information"], ["shipping", "delivery"], 1),
    ("click_and_collect", ["click-and-collect", "pickup", "store-pickup"], ["click and collect", "click & collect", "store pickup", "pickup"], 1),
    ("store_locator", ["stores", "store-locator", "locations", "our-stores"], ["stores", "store locator", "locations", "find a store"], 1),
    ("returns", ["returns", "refund-policy", "returns-and-exchanges"], ["returns", "refund policy", "returns and exchanges"], 2),
    ("faq", ["faq", "faqs", "frequently-asked-questions"], ["faq", "faqs", "frequently asked questions"], 2),
    ("support", ["support", "help", "help-centre"], ["support", "help"], 2),
    ("blog", ["blog", "journal", "articles"], ["blog", "journal", "articles"], 2),
    ("news", ["news", "press", "media"], ["news", "press", "media"], 2),
    ("team", ["team", "our-team", "people"], ["team", "our team", "people"], 2),
    ("brands", ["brands", "our-brands"], ["brands", "our brands"], 2),
    ("subscription", ["subscription", "subscribe"], ["subscription", "subscribe"], 2),
    ("privacy", ["privacy", "privacy-policy"], ["privacy", "privacy policy"], 3),
    ("terms", ["terms", "terms-and-conditions"], ["terms", "terms and conditions", "terms of service"], 3),
    ("account", ["account", "my-account", "login", "sign-in", "register"], ["account", "sign in", "log in", "login", "register"], 4),
    ("cart", ["cart", "basket"], ["cart", "basket"], 4),
    ("checkout", ["checkout"], ["checkout"], 4),
    ("search", ["search"], ["search"], 4),
]
PATH_PREFIXES = [("product", ["/products/", "/product/"]), ("collection", ["/collections/"]), ("category", ["/category/", "/categories/"])]
PRIORITY = {name: p for name, _, _, p in PAGE_TYPES} | {"homepage": 1, "product": 3, "collection": 3, "category": 3, "unknown": 3}
CRAWL_ORDER = [
    "homepage", "wholesale", "trade", "contact", "about", "store_locator", "click_and_collect", "shipping", "careers", "returns", "faq", "support", "team", "brands", "subscription", "blog", "news",
    "collection", "category", "product", "privacy", "terms", "unknown", "account", "cart", "checkout", "search",
]
CRAWL_DENIED = ["account", "cart", "checkout", "search"]
CRAWL_CAPS = {"product": 5, "collection": 8, "category": 8, "unknown": 3}
CRAWL_PAGES = 30
PREFERRED_SOURCES = ["navigation", "footer", "robots", "sitemap", "sitemap_index"]
EXCLUDED_EXTENSIONS = ["jpg", "jpeg", "png", "gif", "svg", "webp", "ico", "bmp", "tiff", "mp4", "mov", "avi", "webm", "mkv", "woff", "woff2", "ttf", "otf", "eot", "css", "js", "mjs", "zip", "rar", "tar", "gz", "exe", "dmg", "apk", "msi"]

TRACKING_PARAMS = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid"]
REDACTED_PARAMS = ["utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term", "mc_cid", "mc_eid", "vero_id", "vero_conv", "klaviyo_id", "_kx", "subscriber_id", "contact_id", "customer_id", "email", "recipient", "uid"]
# Networks that no public site is in: private, local, reserved and group addresses; and the parts of them that are public.
INNER_NETWORKS = [
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16",
    "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4",
    "::/8", "100::/8", "200::/7", "400::/6", "800::/5", "1000::/4", "2001::/23", "2001:db8::/32", "2002::/16",
    "4000::/3", "6000::/3", "8000::/3", "a000::/3", "c000::/3", "e000::/4", "f000::/5", "f800::/6", "fc00::/7", "fe00::/9", "fe80::/10", "ff00::/8",
]
OUTER_NETWORKS = ["192.0.0.9/32", "192.0.0.10/32", "2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28"]
RESERVED_SUFFIXES = ["local", "internal", "localdomain", "lan", "home", "test", "invalid", "example"]
COMPOUND_SUFFIXES = ["co.nz", "co.uk", "org.uk", "com.au", "co.za", "com.br", "co.jp", "or.jp", "ne.jp", "com.cn", "co.in", "co.id", "com.mx", "co.il", "com.sg", "com.hk", "co.kr", "com.tw"]
TLD_COUNTRIES = {"au": "Australia", "nz": "New Zealand", "uk": "United Kingdom", "us": "United States", "ca": "Canada"}

# Names of countries in addresses, and what stands for a city: words before a state and a postcode.
COUNTRY_WORDS = r"Australia|New Zealand|United Kingdom|United States(?: of America)?|U\.S\.A\.|USA|UK|Canada"
COUNTRY_NAMES = {
    "australia": "Australia", "new zealand": "New Zealand", "united kingdom": "United Kingdom", "uk": "United Kingdom", "united states": "United States",
    "united states of america": "United States", "usa": "United States", "u.s.a.": "United States", "canada": "Canada",
}
CITY = r"([A-Z][a-zA-Z]+(?:\s[A-Z][a-zA-Z]+){0,2}),?\s+[A-Z]{2,3}\s+\d{4,5}\b"
# What belongs to a member of a team: the markup from one such class to the next.
TEAM_BLOCK = r"""(?is)class="[^"]*(?:team-member|person)[^"]*"[^>]*>(.*?)(?=class="[^"]*(?:team-member|person)|\z)"""

ROLE_BLOCK = r"""(?is)class="[^"]*(?:role|title)[^"]*"[^>]*>(.*?)</"""

# Blocked or challenge pages, in order: class and phrases.
CHALLENGES = [
    ("cloudflare_challenge", ["checking your browser", "cf-browser-verification", "cf-chl-bypass", "just a moment"]),
    ("captcha", ["captcha", "recaptcha", "hcaptcha", "verify you are human"]),
    ("access_denied", ["access denied", "you don't have permission to access", "403 forbidden"]),
    ("password_protected_storefront", ["password protected", "enter store using password", "this store is password protected"]),
    ("maintenance_page", ["site is under maintenance", "scheduled maintenance", "maintenance mode"]),
    ("bot_challenge", ["unusual traffic", "automated queries", "bot detection", "are you a robot"]),
]
BINARY_SIGNATURES = [
    ("89504E470D0A1A0A", "PNG image"),
    ("FFD8FF", "JPEG image"),
    ("474946383761", "GIF image"),
    ("474946383961", "GIF image"),
    ("255044462D", "PDF document"),
    ("504B0304", "ZIP archive"),
    ("504B0506", "ZIP archive (empty)"),
    ("4D5A", "Windows executable"),
    ("7F454C46", "Linux executable"),
]
REJECTED_CONTENT_TYPES = ["image/", "video/", "audio/", "application/pdf", "application/zip", "application/x-msdownload", "application/octet-stream", "application/gzip"]
# Charsets by name: those of several bytes that Spark reads, those of one byte a character (read by the tables of these names), and those that an Arrow batch reads.
CHARSETS = {"utf-8": "UTF-8", "utf8": "UTF-8", "utf-8-sig": "UTF-8", "utf-16": "UTF-16", "utf16": "UTF-16", "utf-16le": "UTF-16LE", "utf-16-le": "UTF-16LE", "utf-16be": "UTF-16BE", "utf-16-be": "UTF-16BE"}
BYTE_CHARSETS = [
    "us-ascii", "ascii", "latin-1", "latin1", "iso-8859-1", "iso-8859-2", "iso-8859-3", "iso-8859-4", "iso-8859-5", "iso-8859-6", "iso-8859-7", "iso-8859-8", "iso-8859-9", "iso-8859-10", "iso-8859-11",
    "iso-8859-13", "iso-8859-14", "iso-8859-15", "iso-8859-16", "windows-1250", "windows-1251", "windows-1252", "windows-1253", "windows-1254", "windows-1255", "windows-1256", "windows-1257", "windows-1258",
    "cp1250", "cp1251", "cp1252", "cp1253", "cp1254", "cp1255", "cp1256", "cp1257", "cp1258", "cp437", "cp850", "cp852", "cp866", "koi8-r", "koi8-u", "tis-620",
]
BATCH_CHARSETS = ["shift_jis", "shift-jis", "sjis", "euc-jp", "iso-2022-jp", "gb2312", "gbk", "gb18030", "big5", "euc-kr", "cp949"]
ACTIVE_RUNS = ["queued", "running"]
DONE_RUNS = ["completed", "completed_with_warnings", "partial"]
RETRYABLE_STATUS = [408, 425, 429, 500, 502, 503, 504]
RETRYABLE_ERRORS = ["timeout", "connection_error"]

# Roles, in order: category and pattern (ASCII word borders, any case).
ROLES = [
    ("founder", r"\bfounder\b"),
    ("owner", r"\bowner\b"),
    ("ecommerce", r"\b(?:e-?commerce|online\s+store)\b"),
    ("operations", r"\b(?:operations|logistics|warehouse\s+manager)\b"),
    ("marketing", r"\b(?:marketing|brand)\b"),
    ("technology", r"\b(?:technology|engineering|developer|it\s+manager|cto)\b"),
    ("customer_service", r"\b(?:customer\s+service|support)\b"),
    ("sales", r"\b(?:sales|account\s+manager)\b"),
    ("executive", r"\b(?:ceo|cfo|coo|chief|president|director|executive)\b"),
]
CONTACT_PRIORITY = {"ecommerce": 1, "operations": 2, "owner": 3, "founder": 3, "technology": 4, "marketing": 5}

# Wording that states a business model: field, value, confidence, patterns.
BUSINESS_RULES = [
    ("business.wholesale", True, 80, [r"\bwholesale\s+application\b", r"\bwholesale\s+enquir(?:y|ies)\b", r"\bbecome\s+a\s+stockist\b", r"\bwholesale\s+pricing\b", r"\bretailer\s+application\b", r"\bwholesale\s+account\s+login\b"]),
    ("business.trade_accounts", True, 78, [r"\btrade\s+account\b", r"\btrade\s+application\b", r"\btrade\s+pricing\b", r"\bprofessional\s+account\b", r"\bcommercial\s+account\b"]),
    ("business.click_and_collect", True, 78, [r"\bclick\s*(?:and|&)\s*collect\b", r"\bstore\s+pickup\b", r"\bpick\s*up\s+in\s+store\b", r"\bcollection\s+available\b"]),
    ("business.subscription", True, 78, [r"\bsubscribe\s*(?:and|&)\s*save\b", r"\brecurring\s+delivery\b", r"\bproduct\s+subscription\b", r"\bmembership\s+delivery\s+plan\b"]),
    ("business.booking", True, 75, [r"\bbook\s+(?:an\s+)?appointment\b", r"\bbooking\s+form\b", r"\bschedule\s+a?\s*consultation\b", r"\breserve\s+(?:a\s+)?session\b"]),
    ("business.online_only", True, 80, [r"\bonline[\s-]only\s+store\b", r"\bexclusively\s+online\b", r"\bno\s+physical\s+retail\s+location\b"]),
    ("business.custom_products", True, 72, [r"\bpersonali[sz]ation\b", r"\bcustom\s+engraving\b", r"\bmade\s+to\s+order\b", r"\bcustom\s+printing\b", r"\bbespoke\s+product\b", r"\bupload\s+(?:your\s+)?artwork\b"]),
    ("business.wholesale", False, 75, [r"\bwe\s+do\s+not\s+offer\s+wholesale\b", r"\bno\s+wholesale\s+program\b"]),
    ("business.click_and_collect", False, 75, [r"\bclick\s*(?:and|&)\s*collect\s+is\s+not\s+available\b"]),
]

# Parts of words of which each pattern above needs one: cheap to look for first. They are free of letters that other letters fold to (i, k, s).
BUSINESS_PARTS = {
    "business.wholesale": ["whole", "toc", "reta"],
    "business.trade_accounts": ["trade", "account"],
    "business.click_and_collect": ["collect", "tore"],
    "business.subscription": ["cr", "recurr", "member"],
    "business.booking": ["boo", "chedule", "erve"],
    "business.online_only": ["onl", "reta"],
    "business.custom_products": ["onal", "tom", "made", "product", "upload"],
}
# Technology marks: name, field, script hosts, generator words, markup, confidence.
TECHNOLOGIES = [
    ("shopify", "technology.commerce_platform", ["cdn.shopify.com", "shopifycdn.com"], ["shopify"], [], 85),
    ("woocommerce", "technology.commerce_platform", [], ["woocommerce"], ["wp-content/plugins/woocommerce"], 85),
    ("magento", "technology.commerce_platform", [], ["magento"], ["mage.cookies", "mage/cookies"], 85),
    ("bigcommerce", "technology.commerce_platform", ["bigcommerce.com", "cdn11.bigcommerce.com"], [], [], 85),
    ("shopline", "technology.commerce_platform", ["shoplineapp.com"], [], [], 80),
    ("squarespace", "technology.commerce_platform", ["squarespace.com"], ["squarespace"], [], 80),
    ("wix", "technology.commerce_platform", ["wix.com", "wixstatic.com"], ["wix"], [], 80),
    ("stripe", "technology.payment_providers", ["js.stripe.com", "api.stripe.com"], [], [], 75),
    ("paypal", "technology.payment_providers", ["paypal.com", "paypalobjects.com"], [], [], 75),
    ("afterpay", "technology.payment_providers", ["afterpay.com"], [], [], 75),
    ("klarna", "technology.payment_providers", ["klarna.com"], [], [], 75),
    ("laybuy", "technology.payment_providers", ["laybuy.com"], [], [], 75),
    ("windcave", "technology.payment_providers", ["windcave.com", "paymentexpress.com"], [], [], 75),
    ("shopify_payments", "technology.payment_providers", [], [], ["shopify_pay"], 75),
    ("apple_pay", "technology.payment_providers", [], [], ["apple-pay", "applepay"], 75),
    ("google_pay", "technology.payment_providers", [], [], ["google-pay", "gpay"], 75),
    ("hubspot", "technology.crm", ["hs-scripts.com", "hsforms.net", "hubspot.com"], [], [], 75),
    ("salesforce", "technology.crm", ["salesforce.com", "force.com"], [], [], 75),
    ("klaviyo", "technology.email_marketing", ["klaviyo.com"], [], [], 75),
    ("mailchimp", "technology.email_marketing", ["list-manage.com", "mailchimp.com"], [], [], 75),
    ("activecampaign", "technology.email_marketing", ["activehosted.com"], [], [], 75),
    ("odoo", "technology.erp", ["odoo.com"], [], [], 75),
    ("netsuite", "technology.erp", ["netsuite.com"], [], [], 75),
    ("xero", "technology.accounting", ["xero.com"], [], [], 75),
    ("myob", "technology.accounting", ["myob.com"], [], [], 75),
    ("cin7", "technology.erp", ["cin7.com"], [], [], 75),
    ("unleashed", "technology.erp", ["unleashedsoftware.com"], [], [], 75),
    ("yotpo", "technology.review_platforms", ["staticw2.yotpo.com", "yotpo.com"], [], [], 75),
    ("judge_me", "technology.review_platforms", ["judge.me"], [], [], 75),
    ("reviews_io", "technology.review_platforms", ["reviews.io"], [], [], 75),
    ("trustpilot", "technology.review_platforms", ["trustpilot.com"], [], [], 75),
    ("stamped", "technology.review_platforms", ["stamped.io"], [], [], 75),
    ("zendesk", "technology.support_tools", ["zendesk.com"], [], [], 75),
    ("gorgias", "technology.support_tools", ["gorgias.chat", "gorgias.com"], [], [], 75),
    ("intercom", "technology.support_tools", ["intercom.io"], [], [], 75),
    ("tidio", "technology.support_tools", ["tidio.co"], [], [], 75),
    ("freshdesk", "technology.support_tools", ["freshdesk.com"], [], [], 75),
    ("google_analytics", "technology.analytics", ["google-analytics.com"], [], [], 75),
    ("google_tag_manager", "technology.analytics", ["googletagmanager.com"], [], [], 75),
    ("meta_pixel", "technology.analytics", ["connect.facebook.net"], [], [], 75),
    ("hotjar", "technology.analytics", ["hotjar.com"], [], [], 75),
    ("microsoft_clarity", "technology.analytics", ["clarity.ms"], [], [], 75),
    ("smile_io", "technology.loyalty", ["smile.io"], [], [], 75),
    ("loyaltylion", "technology.loyalty", ["loyaltylion.com"], [], [], 75),
    ("yotpo_loyalty", "technology.loyalty", ["loyalty.yotpo.com"], [], [], 75),
    ("react", "technology.frameworks", [], [], ["data-reactroot"], 65),
    ("vue", "technology.frameworks", [], [], ["v-cloak", "__vue__"], 65),
    ("nuxt", "technology.frameworks", [], [], ["__nuxt__"], 68),
    ("nextjs", "technology.frameworks", [], [], ["__next_data__", 'id="__next"'], 68),
    ("angular", "technology.frameworks", [], [], ["ng-version"], 65),
    ("svelte", "technology.frameworks", [], [], ["data-svelte"], 65),
]
AI_WORDS = ["chatgpt", "openai", "ai-powered", "ai powered", "ai chatbot"]

# Wording that reports growth: field, confidence, patterns, and what must stand nearby (any case).
GROWTH_RULES = [
    ("growth.hiring", 68, [r"\bwe(?:'|’)re\s+hiring\b", r"\bjoin\s+our\s+growing\s+team\b", r"\bmultiple\s+(?:roles|positions)\s+available\b"], r"\b(?:growing|growth|expand(?:ing|sion)?|scaling)\b"),
    ("growth.new_store", 75, [r"\bopening\s+(?:a\s+)?new\s+store\b", r"\bnew\s+store\s+now\s+open\b", r"\bwe(?:'|’)ve\s+opened\s+a\s+new\s+location\b"], None),
    ("growth.warehouse_change", 72, [r"\bmoving\s+(?:to\s+)?(?:a\s+)?(?:new|bigger|larger)\s+warehouse\b", r"\bnew\s+distribution\s+centre?\b"], None),
    ("growth.expansion", 70, [r"\bexpanding\s+(?:our\s+)?distribution\b", r"\binternational\s+expansion\b", r"\bnow\s+shipping\s+(?:internationally|to\s+[A-Z][a-z]+)\b", r"\backquir(?:ed|ing|es|e)\b", r"\bmerger\b", r"\brebrand(?:ed|ing)?\b"], None),
    ("growth.platform_migration", 72, [r"(?-i:\bwe(?:'|’)ve\s+moved\s+to\s+[A-Z][\w]*\b)", r"\bmigrat(?:ed|ing)\s+to\s+a\s+new\s+platform\b"], None),
    ("growth.new_category", 70, [r"\bnow\s+launching\s+(?:our\s+)?new\s+[a-z]+\s+range\b", r"\bintroducing\s+(?:our\s+)?new\s+category\b"], None),
    ("growth.subscription_launch", 72, [r"\blaunching\s+(?:our\s+)?(?:new\s+)?subscription\b", r"\bnow\s+offering\s+subscriptions\b"], None),
]
# Wording without further conditions: field, value, confidence, patterns.
WORDING_RULES = [
    ("catalogue.bundle_evidence", "true", 65, [r"\bbundle\b", r"\bgift\s+set\b", r"\b\d[- ]piece\s+kit\b", r"\bmultipack\b", r"\bbuild[- ]your[- ]own\b"]),
    ("catalogue.customization_evidence", "true", 65, [r"\bpersonali[sz]e\s+(?:this\s+)?(?:item|product)\b", r"\bengraving\b", r"\bmonogram\b", r"\bcustom\s+text\b"]),
    ("operations.pickup_available", "true", 75, [r"\bpickup\s+(?:is\s+)?available\b", r"\bcurbside\s+pickup\b", r"\bin-?store\s+pickup\b"]),
    ("organisation.internal_it_status", "detected", 72, [r"\b(?:head\s+of\s+engineering|software\s+engineer|in[\s-]house\s+develop(?:er|ment)|internal\s+it\s+team|technology\s+lead|engineering\s+careers|we\s+are\s+hiring\s+(?:a\s+)?developers?)\b"]),
]
# Bits of which each text with such wording, or with the growth of that name, has one; as for BUSINESS_PARTS.
WORDING_PARTS = {
    "catalogue.bundle_evidence": ["bundle", "ft", "ece", "mult", "own"],
    "catalogue.customization_evidence": ["onal", "engrav", "monogram", "tom"],
    "operations.pickup_available": ["lable", "curb", "tore"],
    "organisation.internal_it_status": ["head", "oftware", "develop", "ternal", "technology", "career"],
}
GROWTH_PARTS = {
    "growth.hiring": ["'re", "\u2019re", "grow", "mult"],
    "growth.new_store": ["open"],
    "growth.warehouse_change": ["warehou", "centr"],
    "growth.expansion": ["expan", "now", "qu", "merger", "rebrand"],
    "growth.platform_migration": ["moved", "platform"],
    "growth.new_category": ["launch", "category"],
    "growth.subscription_launch": ["launch", "offer"],
}
# Places: wording of pages that list other firms' shops, and the parts of an address in order.
STOCKIST_WORDING = [r"\bstockists?\b", r"\bfind\s+us\s+at\s+these\s+retailers\b", r"\bavailable\s+at\s+these\s+retailers\b"]
ADDRESS_PARTS = ["streetAddress", "addressLocality", "addressRegion", "postalCode", "addressCountry"]
# Catalogues: markup of variant selectors and of inputs for custom goods, and the least sample of variants.
VARIANT_SELECT = r"""(?i)<select[^>]+(?:name|id|class)="[^"]*(?:variant|size|colou?r)[^"]*\""""
CUSTOM_INPUT = r"""(?i)<input[^>]+type="file"|<input[^>]+(?:name|id|class)="[^"]*(?:engrav|personali[sz]|monogram|custom-text)[^"]*\""""
LEAST_VARIANT_SAMPLE = 5
TRADING_AS = r"trading\s+as\s+([A-Z][\w&'.\- ]{1,60})"

SOURCE_PRIORITY = {
    "manual": 1000, "json_ld": 100, "open_graph": 90, "sitemap_summary": 85, "meta_tag": 80, "script_marker": 70, "cookie_marker": 65,
    "html_element": 60, "page_metadata": 60, "link": 55, "form": 50, "imported": 40, "deterministic_inference": 20,
}
PRIORITY_GAP = 20
STALE_DAYS = {"identity": 365, "platform": 180, "contact": 180, "business": 180, "operations": 180, "technology": 90, "catalogue": 30, "growth": 90, "careers": 30}
CONTACT_FIELDS = ["organisation.emails", "organisation.phone_numbers", "organisation.people", "organisation.internal_it_status", "organisation.recommended_contact_candidates"]

PROCESSING = {
    "imported": ["discovering"],
    "discovering": ["discovered", "failed"],
    "discovered": ["crawling", "failed"],
    "crawling": ["crawled", "failed"],
    "crawled": ["extracting", "failed"],
    "extracting": ["extracted", "failed"],
    "extracted": ["analysing", "failed"],
    "analysing": ["analysed", "failed"],
    "analysed": ["scoring", "failed"],
    "scoring": ["ready", "partial", "failed"],
}
WORKFLOW = {
    "unreviewed": ["reviewed", "shortlisted", "not_suitable", "archived"],
    "reviewed": ["shortlisted", "not_suitable", "contacted", "archived"],
    "shortlisted": ["contacted", "not_suitable", "archived"],
    "not_suitable": ["archived", "unreviewed"],
    "contacted": ["customer", "not_suitable", "archived"],
    "customer": ["archived"],
    "archived": ["unreviewed"],
}

# Extractors: name here, id, version, the page types they are for (none: all), and their rank.
EXTRACTORS = [
    ("company_name", "identity.company_name", "v1", ["homepage", "about"], 100),
    ("trading_name", "identity.trading_name", "v1", [], 90),
    ("country", "identity.country_city", "v1", [], 90),
    ("business_model", "business.model_signals", "v1", [], 80),
    ("contacts", "organisation.contact_signals", "v1", [], 70),
    ("operations", "operations.physical_locations", "v1", [], 70),
    ("brands", "business.brands", "v1", ["brands", "product"], 60),
    ("technology", "technology.signatures", "v1", [], 60),
    ("catalogue", "catalogue.product_signals", "v1", [], 55),
    ("language", "identity.language", "v1", [], 50),
    ("growth", "growth.signals", "v1", [], 50),
]
GROUPS = ["identity", "business", "catalogue", "operations", "technology", "organisation", "growth"]
PLATFORMS = ["shopify", "woocommerce", "magento", "custom", "prestashop", "opencart"]
