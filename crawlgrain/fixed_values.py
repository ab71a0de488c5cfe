"""Results depend on these exact words, numbers and patterns. Plain data, no logic."""

# --- page analysis ------------------------------------------------------------------------------
COMPONENTS = ["navigation", "forms", "buttons", "modals", "tables", "iframes"]
NAVIGATION_TAGS = ["nav", "header"]
MODAL_CLASS = "modal|popup"
SEMANTIC_TAGS = ["article", "section", "header", "footer", "aside", "main"]
CONTENT_CONTAINER_CLASS = "content|container|main|body|wrapper"
FRAMEWORKS = ["react", "angular", "vue"]
SECURITY_HEADERS = ["Content-Security-Policy", "X-Frame-Options", "Strict-Transport-Security"]
DYNAMIC_ATTRIBUTE_PREFIXES = ["data-", "aria-", "ng-"]
KEYWORD = r"[\p{L}\p{N}_]{4,}"
KEYWORD_LIMIT = 20
LANGUAGE_SAMPLE_CHARS = 1000
PAGE_NUMBER_TEXT = r"Page \p{Nd}+"
PAGE_LINK = "page|next"

PATTERN_PARENT_TAGS = ["div", "main", "section", "ul", "ol", "table"]
HEURISTICS = [
    # name, tags, class pattern, count must exceed, sample size, reported selector
    ("list_items", ["li"], None, 5, 5, "li"),
    ("cards", None, "card|item|box|tile|product", 3, 3,
     '[class*="card"], [class*="item"], [class*="box"], [class*="tile"], [class*="product"]'),
    ("table_rows", ["tr"], None, 3, 3, "tr"),
    ("articles", ["article", "div"], "post|article|story|entry|feed-item", 2, 3,
     'article, [class*="post"], [class*="article"], [class*="story"], [class*="entry"], [class*="feed-item"]'),
    ("headings", ["h1", "h2", "h3"], None, 3, 5, "h1, h2, h3"),
]
STRATEGY_TAGS = ["div", "main", "section", "article"]
STRATEGY_CLASS = "content|container|main|list|results"
SUGGESTION_TAGS = ["article", "main", "div"]
SUGGESTION_PATTERN = "content|main|article"
TEMPLATE_ROLES = [
    ("container", ["div", "main", "section"], "content|container|main"),
    ("item", ["article", "div", "li"], "item|card|product"),
    ("title", ["h1", "h2", "h3", "a"], "title|heading"),
    ("price", ["span", "div"], "price"),
]
LOADING_BUTTON_TEXT = "load|view|show|more|next|continue|expand|pagination"
SNAPSHOT_CONTAINER_CLASS = "content|container|results|list|feed|items|products|grid"
SNAPSHOT_ITEM_TAGS = ["article", "div", "li"]
SNAPSHOT_ITEM_CLASS = "item|card|product|post|entry|result"
SHOP_TERMS = ["product", "price", "shop", "cart", "store", "buy"]
NEWS_TERMS = ["article", "news", "post", "blog", "story"]

# --- extraction jobs ----------------------------------------------------------------------------
ERROR_PATTERNS = [
    # pattern, explanation, recommendation
    ("Connection refused", "The website may be blocking automated requests",
     "Try adding request headers (User-Agent) or using a headless browser"),
    ("HTTPError: 403", "Access forbidden - site may have anti-scraping measures",
     "Try adding request headers (User-Agent) or using a headless browser"),
    ("HTTPError: 429", "Too many requests - rate limiting detected",
     "Add delays between requests with time.sleep()"),
    ("timeout", "Request timed out - site might be slow or blocking",
     "Increase request timeout or add retry mechanism"),
    ("NoSuchElementException", "Element not found - selector may be incorrect or page structure changed",
     "Check selector or add explicit waits for dynamic content"),
    ("ElementNotVisibleException", "Element not visible - may be hidden or not loaded yet",
     "Check selector or add explicit waits for dynamic content"),
    ("captcha", "CAPTCHA detected - site is using anti-bot protection",
     "Site uses CAPTCHA protection - consider if scraping is appropriate"),
]
TIMEOUT_ISSUE = ("timeout", "The request or script execution took too long",
                 "Add explicit timeouts, reduce scope, or add pagination")
TIMEOUT_BROWSER_HINT = ". Browser-based scrapers often need longer timeouts or explicit waits."
TIMEOUT_REQUESTS_HINT = ". Consider adding timeout parameters to your requests."
ALLOWED_MODULES = [
    "numpy", "pandas", "requests", "beautifulsoup4", "selenium", "scrapy", "lxml", "html5lib", "httpx", "parsel",
    "fake-useragent", "playwright", "webdriver-manager", "bs4", "urllib3",
]
DATA_TYPES = ["product", "article", "news", "review", "profile", "comment", "post", "job", "experience",
              "education", "project"]
DATA_TYPE_SYNONYMS = [
    ("experience", ["journey", "career"]),
    ("education", ["education", "degree", "university"]),
    ("project", ["project", "portfolio"]),
]
STAGES = ["setup", "prompt_formatting", "code_generation", "code_extraction", "code_execution", "data_validation",
          "refinement"]
FINAL_STAGES = ["data_validation", "refinement"]

# --- model ledger -------------------------------------------------------------------------------
DEFAULT_PRICE = (0.001, 0.002)
PRICES = [
    # model, USD per 1000 input tokens, USD per 1000 output tokens
    ("gpt-4o", 0.005, 0.015),
    ("gpt-4o-mini", 0.0015, 0.006),
    ("gpt-4-turbo", 0.01, 0.03),
    ("gpt-4", 0.03, 0.06),
    ("gpt-3.5-turbo", 0.0005, 0.0015),
    ("gemini-1.5-pro", 0.0025, 0.0075),
    ("gemini-1.5-flash", 0.0005, 0.0015),
    ("gemini-2.0-flash-lite", 0.0001, 0.0003),
    ("gemini-1.0-pro", 0.0025, 0.0075),
    ("gemini-1.0-ultra", 0.0025, 0.0075),
    ("claude-3-opus", 0.015, 0.075),
    ("claude-3-sonnet", 0.003, 0.015),
    ("claude-3-haiku", 0.00025, 0.00125),
    ("claude-3.5-sonnet", 0.003, 0.015),
    ("mistral-large", 0.002, 0.006),
    ("mistral-medium", 0.0008, 0.0024),
    ("mistral-small", 0.0002, 0.0006),
]
PROVIDER_PREFIXES = [
    ("openai", "^gpt-"), ("google", "^gemini-"), ("anthropic", "^claude-"), ("mistral", "^mistral-"),
    ("meta", "^llama-"), ("deepseek", "^deepseek-"), ("cohere", "^command"), ("ai21", "^j2-"),
    ("together", "^(yi-|qwen|falcon)"),
]
PROVIDER_SUBSTRINGS = [
    ("openai", ["gpt"]), ("google", ["gemini"]), ("anthropic", ["claude"]), ("mistral", ["mistral"]),
    ("meta", ["llama"]), ("deepseek", ["deepseek"]), ("cohere", ["command"]), ("ai21", ["j2-"]),
    ("together", ["yi-", "qwen", "falcon"]),
]
MODEL_API_NAMES = [
    ("claude-3-opus", "claude-3-opus-20240229"),
    ("claude-3-sonnet", "claude-3-sonnet-20240229"),
    ("claude-3-haiku", "claude-3-haiku-20240307"),
    ("claude-3.5-sonnet", "claude-3-5-sonnet-20240620"),
    ("mistral-large", "mistral-large-latest"),
    ("mistral-medium", "mistral-medium-latest"),
    ("mistral-small", "mistral-small-latest"),
    ("deepseek-coder", "deepseek-chat"),
    ("deepseek-chat", "deepseek-chat"),
    ("deepseek-llm-67b", "deepseek-chat"),
    ("deepseek-llm-7b", "deepseek-chat"),
    ("command-r", "command-r-v1"),
    ("command-r-plus", "command-r-plus-v1"),
    ("command", "command-light-v1"),
    ("yi-34b", "01-ai/Yi-34B-Chat"),
    ("qwen-72b", "Qwen/Qwen-72B-Chat"),
    ("falcon-180b", "tiiuae/falcon-180B-chat"),
]
MODEL_CATALOG = {
    "openai": ["gpt-4o", "gpt-4o-mini", "gpt-4-turbo", "gpt-4", "gpt-3.5-turbo"],
    "google": ["gemini-1.5-pro", "gemini-1.5-flash", "gemini-2.0-flash-lite", "gemini-1.0-pro", "gemini-1.0-ultra"],
    "anthropic": ["claude-3-opus", "claude-3-sonnet", "claude-3-haiku", "claude-3.5-sonnet"],
    "mistral": ["mistral-large", "mistral-medium", "mistral-small"],
    "meta": ["llama-3-70b", "llama-3-8b"],
    "deepseek": ["deepseek-coder", "deepseek-chat", "deepseek-llm-67b", "deepseek-llm-7b"],
    "cohere": ["command-r", "command-r-plus", "command"],
    "ai21": ["j2-ultra", "j2-mid"],
    "together": ["yi-34b", "qwen-72b", "falcon-180b"],
}

# --- lifetimes ----------------------------------------------------------------------------------
CACHE_SECONDS = 86400
STATUS_SECONDS = 300
FINISHED_STATUS_SECONDS = 60
