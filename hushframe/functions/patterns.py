"""The patterns, word lists and tables that decide what is private.

They are Java regular expressions; (?U) gives \\b, \\w and \\s their Unicode meaning,
(?iU) ignores case as well.  All of these are data: changing one changes results.
"""

from __future__ import annotations

# Patterns.
EMAIL = r"(?U)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.(?:[A-Za-z]{2,}|test|invalid)\b"
PHONE = r"(?U)(?<!\w)(?:\+?1[\s.-]?)?(?:\(?\d{3}\)?[\s.-]?)\d{3}[\s.-]?\d{4}(?!\w)"
LOCAL_PHONE = r"(?U)(?<![\w.-])\d{3}[-.]\d{4}(?![\w.-])"
URL = r"(?U)\b(?:https?://|www\.)[^\s<>)\"]+|\b[A-Za-z0-9-]+\.(?:com|net|org|io|co|ai|test|invalid)\b"
API_KEY = r"(?iU)\b(?:sk-[A-Za-z0-9_-]{16,}|sk_(?:test|live)_[A-Za-z0-9]{16,}|rk_(?:test|live)_[A-Za-z0-9]{16,}|ghp_[A-Za-z0-9_]{20,}|github_pat_[A-Za-z0-9_]{40,}|glpat-[A-Za-z0-9_-]{20,}|xoxb-[A-Za-z0-9-]{20,}|SG\.[A-Za-z0-9_-]{12,}\.[A-Za-z0-9_-]{12,}|AKIA[A-Z0-9]{16}|Bearer\s+[A-Za-z0-9._~+/=-]{20,})\b"
LABELED_API_KEY = r"(?iU)\b(?:api[_-]?key|key|config)_[A-Za-z0-9][A-Za-z0-9_-]{5,}\b"
LONG_SECRET = r"(?U)\b(?:[A-Fa-f0-9]{32,}|[A-Za-z0-9+/]{36,}={0,2})\b"
LABELED_SECRET = r"(?iU)\b(?:token|secret|pwd|pass|password|dev|access|session|auth)_[A-Za-z0-9][A-Za-z0-9_-]{3,}\b"
FILE_PATH = r"(?U)(?<!\w)(?:~?/(?:home|mnt|var|tmp|etc|Users|opt|srv|\.config)[^\s,;:)\]\"']+|[A-Za-z]:\\[^\s,;:)\]\"']+)"
PRICE = r"(?iU)(?:\$\s?\d[\d,]*(?:\.\d{2})?(?:\s?[-–—]\s?\$?\d[\d,]*(?:\.\d{2})?)?\s?(?:/|per\s+)?(?:day|month|mo|mrr)?|\b\d[\d,]*(?:\s?[-–—]\s?\d[\d,]*)?\s?(?:/|per\s+)(?:day|month|mo)\b|\b\d{1,3}%\s?(?:commission|revshare|fee|cut)?\b|\b\d[\d,]*\s?MRR\b)"
SPELLED_PRICE = r"(?iU)\b(?:(?:twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety)(?:[-\s](?:one|two|three|four|five|six|seven|eight|nine))?|one hundred(?:[-\s](?:twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety))?(?:[-\s](?:one|two|three|four|five|six|seven|eight|nine))?)\s+(?:per\s+)?(?:day|month|mo)\b"
ACCOUNT = r"(?iU)\b(?:(?:acct|account|client|customer|cus|pi|ch|sub|in|src)_[A-Za-z0-9][A-Za-z0-9_-]{3,}|[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}|\d{10,})\b"
DATE = r"(?iU)\b(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{2,4}|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec)[a-z]*\.?\s+\d{1,2}(?:,\s*\d{4})?|(?:Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday)|(?:deadline|due)\s+(?:today|tomorrow|next\s+\w+))\b"
RELATIVE_DATE = r"(?iU)\b(?:(?:next|this|last)\s+(?:week|month|quarter|year|Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday)|(?:early|mid|late)\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec)[a-z]*)\b"
BUSINESS = r"(?U)\b([A-Z][A-Za-z]+(?:[-\s]?[A-Z][A-Za-z]+){0,3}[-\s]?(?:LLC|Inc|Co|Company|Roofing|Insurance|Agency|Clinic|Dental|Plumbing|Services|Solutions|Media|Marketing))\b"
PERSON = r"(?U)\b([A-Z][a-z]{2,}\s+[A-Z][a-z]{2,})\b"
TITLE_NAME = r"(?U)\b(?:Dr|Mr|Mrs|Ms|Prof|Sir|Capt|Sgt|Rev)\.?\s+[A-Z][a-z]{2,}(?:\s+[A-Z][a-z]{2,})?"
INITIAL_SURNAME = r"(?U)\b[A-Z]\.\s*[A-Z][a-z]{2,}\b"
NAME_INITIAL = r"(?U)\b[A-Z][a-z]{2,}\s+[A-Z]\.(?!\w)"
MODEL = r"(?iU)\b(?:Claude(?:\s+Code)?|Gemini|Granite|Qwen|SmolLM|GPT[-\s]?\d(?:\.\d)?|Llama)\b"
MODEL_CONTEXT = r"(?iU)\b(?:local|frontier|cloud|private|routing|grader|judge|span|proposal|source|tool(?:ing)?|assistant|model|eval|benchmark)(?:[-\s]+(?:local|frontier|cloud|private|routing|grader|judge|span|proposal|source|tool(?:ing)?|assistant|model|eval|benchmark|seat|runner|pass|profile|loop)){1,5}\b"
RELATION_ROLE = r"(?iU)\b(?:the|our|their|that|this)\s+(?:[a-z][\w'-]+\s+){0,4}?(?:guy|gal|lady|ladies|woman|women|man|men|gentleman|gentlemen|person|people|folks|team|crew|rep|reps|owner|owners|contact|contacts|partner|partners|subcontractor|member|client|customer|decision[\s-]?maker|point[\s-]?of[\s-]?contact)(?:\s+(?:who|whom|that|we|behind|over\s+at|at|handling|running|fronting|managing|covering|on)\b[^.;,\n]*)?"
RELATION_ONE = r"(?iU)\bthe\s+one\s+(?:who|that)\b[^.;,\n]*"
RELATION_WHOEVER = r"(?iU)\bwhoever\s+[a-z][^.;,\n]*"
STATUS = r"(?iU)\b(?:will\s+not\s+launch\s+until|won't\s+launch\s+until|billing\s+issue\s+is\s+fixed|got\s+cold\s+feet\s+after\s+the\s+invoice\s+issue|only\s+agreed\s+verbally|mentioned\s+a\s+competitor\s+privately|nervous\s+about\s+daily\s+spend|nervous\s+about\s+budget|waiting\s+on\s+a\s+private\s+approval\s+call)\b"
STATUS_IDIOM = "(?iU)(?:" + "|".join((
    r"(?:got\s+)?cold\s+feet\b[^.;,\n]*",
    r"(?:spooked|skittish|hesitant|nervous|anxious|worried|wary|uneasy)\s+(?:about|by|over|that)\b[^.;,\n]*",
    r"(?:stalling|stall|stalled|holding\s+off|dragging\s+(?:their\s+)?feet|sitting\s+on)\b[^.;,\n]*",
    r"(?:won't|will\s+not|wont|won’t|refus(?:e|es|ing)\s+to)\s+(?:commit|sign|pay|launch|go\s+live|move\s+forward|renew|proceed|start)\b[^.;,\n]*",
    r"threaten(?:ing|ed)?\s+to\s+(?:walk|leave|cancel|churn|switch|pull\s+out)\b[^.;,\n]*",
    r"(?:shopping|comparing|eyeing|considering|weighing)\s+(?:other|another|competing|rival|two|several|a\s+few)?\s*(?:vendor|vendors|competitor|competitors|provider|providers|agency|agencies|options|quotes)\b[^.;,\n]*",
    r"(?:gone\s+(?:quiet|dark|silent|cold)|ghosting|ghosted)\b[^.;,\n]*",
    r"(?:froze|paused|holding|withholding|stopped|halted|disputing|pending)\s+(?:the\s+|an?\s+)?(?:payment|invoice|deposit|funds|billing|refund|dispute)\b[^.;,\n]*",
    r"balk(?:ing|ed)?\s+at\b[^.;,\n]*",
    r"(?:verbal(?:ly)?\s+(?:agreed|agreement|commitment|only)|handshake\s+deal|nothing\s+(?:on|in)\s+(?:paper|writing)|everything\s+in\s+writing|in\s+writing\s+before|off\s+the\s+record)\b[^.;,\n]*",
    r"(?:mention(?:ed|ing)?|named|cited|referenced|eyeing)\s+(?:a\s+)?competitor\b[^.;,\n]*",
)) + ")"
SENTINEL_TEXT = r"(?iU)\b(?:REVEAL[_-]?MAP|ORIGINAL[_-]?VALUE|DEBUG[_-]?RAW|RAW[_-]?PRIVATE|DO[_-]?NOT[_-]?PRINT)[A-Z0-9_-]*\b"
SENTINEL_SAFE = r"(?iU)\b(?:REVEAL[_-]?MAP|ORIGINAL[_-]?VALUE|DEBUG[_-]?RAW|RAW[_-]?PRIVATE|DO[_-]?NOT[_-]?PRINT)\b"
DETERMINER = r"(?iU)\b(?:the|our|their|that|this|these|those)\b[^.;:\n,]{2,70}"
CLAUSE = r"[^.;:\n]+"
NUMBER = r"\d[\d,]*(?:\.\d+)?"
RANGE = r"(?iU)\b(\d[\d,]*(?:\.\d+)?)\s*(?:-|–|—|to)\s*(\d[\d,]*(?:\.\d+)?)\b"
PLACEHOLDER = r"\b[A-Z][A-Za-z]+_\d+\b"
APPROVED_PLACEHOLDER = r"^(?:Person|Org|Email|Phone|Url|Path|Account|Model|Author|Repo|Client|Project)_\d+$|^\[REDACTED_[A-Z_]+\]$"

# Fixed values: (field type, pattern, reason, confidence), in the order in which spans are listed.
DETECTORS = (
    ("email", EMAIL, "email address", 0.99),
    ("phone", PHONE, "phone number", 0.96),
    ("phone", LOCAL_PHONE, "local phone number", 0.91),
    ("url", URL, "url or domain", 0.92),
    ("api_key", API_KEY, "api-key-like secret", 0.99),
    ("api_key", LABELED_API_KEY, "labeled api-key-like secret", 0.97),
    ("secret_token", LONG_SECRET, "long token-like string", 0.9),
    ("secret_token", LABELED_SECRET, "labeled secret token", 0.95),
    ("file_path", FILE_PATH, "local file path", 0.95),
    ("budget", PRICE, "price or budget", 0.92),
    ("budget", SPELLED_PRICE, "spelled price or budget", 0.9),
    ("account_id", ACCOUNT, "account id", 0.93),
    ("date", DATE, "date", 0.88),
    ("date", RELATIVE_DATE, "relative date phrase", 0.86),
    ("business_name", BUSINESS, "organization suffix heuristic", 0.78),
    ("model_name", MODEL, "known model name", 0.92),
    ("model_name", MODEL_CONTEXT, "model or source identity phrase", 0.82),
    ("secret_token", SENTINEL_TEXT, "debug or reveal sentinel", 0.98),
    ("client_status", STATUS, "private client status phrase", 0.89),
    ("client_status", STATUS_IDIOM, "generalizing client status idiom", 0.6),
    ("business_relationship", RELATION_ROLE, "role-only relationship reference", 0.6),
    ("business_relationship", RELATION_ONE, "indirect 'the one who' relationship reference", 0.6),
    ("business_relationship", RELATION_WHOEVER, "indirect 'whoever' relationship reference", 0.58),
)

# Word lists.
LOCATIONS = ("Grand Rapids", "Midland", "Detroit", "Henderson", "Saginaw", "Lansing", "Flint", "Bay City", "Ann Arbor", "Kalamazoo", "Toledo", "Cleveland", "Warren", "Livonia", "Royal Oak", "Chicago", "New York", "Los Angeles")
STATUS_PHRASES = ("likes the work but is nervous about budget", "will not launch until billing is fixed", "wants to wait until after a private call", "is unhappy with the invoice", "is ready if the account issue is resolved", "only agreed verbally", "mentioned a competitor privately")
NOT_PERSONS = ("Grand Rapids", "True North", "Oak Street", "Blue Lantern")
NOT_FIRST_NAMES = ("The", "This", "That", "Call", "Send", "Email", "Ping", "Tell", "Ask", "Let", "See", "Note", "Per", "Crm", "And", "But", "For", "Our", "Their", "His", "Her")
CUES = ("stall", "launch", "go live", "go-live", "rollout", "billing", "invoice", "payment", "refund", "deposit", "competitor", "vendor", "verbal", "handshake", "cold feet", "spooked", "nervous", "skittish", "hesitant", "ghost", "walk away", "cancel", "churn", "dispute", "off the record", "in writing", "procurement", "confidential", "do not", "don't", "quietly", "behind", "contract", "legal", "sign off", "signed", "renew", "retainer", "discount", "shopping", "balk")
NOTE_OPENERS = ("do not", "don't", "keep ", "never ", "confidential")
GENERIC_WORDS = ("likes", "work", "nervous", "budget", "launch", "billing", "fixed", "wants", "wait", "after", "private", "call", "unhappy", "invoice", "ready", "account", "issue", "resolved", "only", "agreed", "verbally", "mentioned", "competitor", "privately", "commission", "month", "daily", "deadline", "launches", "email", "phone", "url", "org", "person", "author", "project", "client", "clients", "customer", "company", "contact", "notes", "note", "status", "home", "acme", "repo", "repos", "path", "plan", "brief", "debug", "raw", "sentinel", "reveal", "print", "test", "map", "original", "value", "values", "clinic", "dental", "roofing", "insurance", "agency", "plumbing", "services", "solutions", "media", "marketing", "lawn", "model", "assistant", "source", "tool", "tools", "calls", "correctly", "huge", "context", "window", "small", "local", "followed", "rubric", "labeled", "winner", "blind", "eval", "other")

# Numbers, ranks, formats, look-alike letters.
NUMBER_WORDS = {"zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90, "hundred": 100, "thousand": 1000}
BUDGET_WORDS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90, "hundred": 100}
SENSITIVITY = {"api_key": 100, "secret_token": 95, "email": 90, "phone": 88, "account_id": 86, "file_path": 84, "person_name": 80, "business_name": 78, "model_name": 77, "url": 76, "private_note": 70, "business_relationship": 68, "client_status": 66, "budget": 64, "exact_price": 64, "location": 60, "date": 50}
FIELD_TYPES = tuple(SENSITIVITY)
DEFAULT_FORMATS = {"person_name": "Person_{n}", "business_name": "Org_{n}", "email": "Email_{n}", "phone": "Phone_{n}", "url": "Url_{n}", "file_path": "Path_{n}", "account_id": "Account_{n}", "model_name": "Model_{n}"}
#: Cyrillic letters that look like Latin ones; detection knows these.
CYRILLIC = ("АВЕНІКМОРСТХаеіорсху", "ABEHIKMOPCTXaeiopcxy")
#: Verification knows Greek ones too.
LEET = ("013457", "oieast")
LOOKALIKES = (CYRILLIC[0] + "ΑΒΕΗΙΚΜΝΟΡΤΧΥο", CYRILLIC[1] + "ABEHIKMNOPTXYo")

#: For each pattern, something cheap that any text with a match of it has: parts of the
#: text in lower case, or short patterns.  They only save work.
NEEDS: dict[str, tuple[tuple[str, ...], str | None]] = {
    EMAIL: (("@",), None),
    PHONE: ((), r"(?U)\d{3}"),
    LOCAL_PHONE: ((), r"(?U)\d{3}[-.]\d{4}"),
    URL: (("http", "www.", ".com", ".net", ".org", ".io", ".co", ".ai", ".test", ".invalid"), None),
    API_KEY: (("sk-", "k_test_", "k_live_", "ghp_", "github_pat_", "glpat-", "xoxb-", "sg.", "akia", "bearer"), None),
    LABELED_API_KEY: (("key_", "config_"), None),
    LONG_SECRET: ((), r"[A-Za-z0-9+/]{32}"),
    LABELED_SECRET: (("token_", "secret_", "pwd_", "pass_", "password_", "dev_", "access_", "session_", "auth_"), None),
    FILE_PATH: (("/home", "/mnt", "/var", "/tmp", "/etc", "/users", "/opt", "/srv", "/.config", ":\\"), None),
    PRICE: (("$",), r"(?U)\d"),
    SPELLED_PRICE: (("twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety", "one hundred"), None),
    ACCOUNT: ((), r"(?U)\d{10}|[0-9a-fA-F]{8}-|(?iu)(?:acct|account|client|customer|cus|pi|ch|sub|in|src)_"),
    DATE: (("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec", "day", "deadline", "due"), r"(?U)\d[-/]\d"),
    RELATIVE_DATE: (("next", "this", "last", "early", "mid", "late"), None),
    BUSINESS: (("llc", "inc", "co", "roofing", "insurance", "agency", "clinic", "dental", "plumbing", "services", "solutions", "media", "marketing"), None),
    PERSON: ((), r"(?U)[A-Z][a-z]{2,}\s+[A-Z][a-z]{2}"),
    TITLE_NAME: ((), r"(?:Dr|Mr|Mrs|Ms|Prof|Sir|Capt|Sgt|Rev)[.\s\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"),
    INITIAL_SURNAME: ((), r"(?U)[A-Z]\.\s*[A-Z][a-z]"),
    NAME_INITIAL: ((), r"(?U)[a-z]\s+[A-Z]\."),
    MODEL: (("claude", "gemini", "granite", "qwen", "smollm", "gpt", "llama"), None),
    MODEL_CONTEXT: (("local", "frontier", "cloud", "private", "routing", "grader", "judge", "span", "proposal", "source", "tool", "assistant", "model", "eval", "benchmark"), None),
    SENTINEL_TEXT: (("reveal", "original", "debug", "raw", "do_not", "do-not", "donot"), None),
    STATUS: (("launch until", "launch", "billing", "cold", "verbally", "competitor", "nervous", "waiting"), None),
    STATUS_IDIOM: (("feet", "spooked", "skittish", "hesitant", "nervous", "anxious", "worried", "wary", "uneasy", "stall", "holding", "sitting", "won", "will", "refus", "threaten", "shopping", "comparing", "eyeing", "considering", "weighing", "gone", "ghost", "froze", "paused", "stopped", "halted", "disputing", "pending", "balk", "verbal", "handshake", "nothing", "writing", "off", "competitor"), None),
    RELATION_ROLE: (("guy", "gal", "lad", "man", "men", "people", "person", "folks", "team", "crew", "rep", "owner", "contact", "partner", "subcontractor", "member", "client", "customer", "decision", "point"), None),
    RELATION_ONE: (("one",), None),
    RELATION_WHOEVER: (("whoever",), None),
}
#: Of some patterns, other parts of which any text with a match has one besides.
NEEDS_TOO: dict[str, tuple[str, ...]] = {
    RELATION_ROLE: ("the", "our", "that", "this"),
    RELATION_ONE: ("the",),
}
