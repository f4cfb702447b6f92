"""Fixed values that results depend on: word lists, lookup tables, limits, patterns."""

# Canonical document domains, in library order.
DOMAINS = [
    "economics_finance", "law", "medical", "information_technology", "engineering",
    "natural_science", "agriculture", "energy_environment", "education",
    "politics_military", "social_science", "literature_arts", "media_communication",
    "business", "general",
]

# Accepted spelling -> canonical domain.
DOMAIN_SYNONYMS = {
    "finance": "economics_finance", "economics": "economics_finance", "financial": "economics_finance",
    "banking": "economics_finance", "accounting": "economics_finance", "investment": "economics_finance",
    "insurance": "economics_finance", "economy": "economics_finance", "fiscal": "economics_finance",
    "trading": "economics_finance", "management": "economics_finance", "statistics": "economics_finance",
    "legal": "law", "judicial": "law", "regulatory": "law", "compliance": "law", "legislation": "law",
    "healthcare": "medical", "health": "medical", "medicine": "medical", "clinical": "medical",
    "pharmaceutical": "medical", "biomedical": "medical", "pharmacy": "medical",
    "technology": "information_technology", "tech": "information_technology", "it": "information_technology",
    "software": "information_technology", "computing": "information_technology", "digital": "information_technology",
    "ai": "information_technology", "cybersecurity": "information_technology", "blockchain": "information_technology",
    "computer": "information_technology", "telecommunications": "information_technology",
    "mechanical": "engineering", "civil": "engineering", "construction": "engineering", "manufacturing": "engineering",
    "automotive": "engineering", "aerospace": "engineering", "chemical_engineering": "engineering",
    "materials": "engineering", "transportation": "engineering",
    "science": "natural_science", "physics": "natural_science", "chemistry": "natural_science",
    "biology": "natural_science", "mathematics": "natural_science", "astronomy": "natural_science",
    "geology": "natural_science",
    "farming": "agriculture", "forestry": "agriculture", "fishery": "agriculture", "veterinary": "agriculture",
    "energy": "energy_environment", "environment": "energy_environment", "environmental": "energy_environment",
    "nuclear": "energy_environment", "ecology": "energy_environment", "climate": "energy_environment",
    "academic": "education", "teaching": "education", "training": "education", "sports": "education",
    "politics": "politics_military", "political": "politics_military", "government": "politics_military",
    "military": "politics_military", "defense": "politics_military", "defence": "politics_military",
    "diplomacy": "politics_military", "policy": "politics_military",
    "philosophy": "social_science", "sociology": "social_science", "psychology": "social_science",
    "history": "social_science", "religion": "social_science", "anthropology": "social_science",
    "archaeology": "social_science",
    "literature": "literature_arts", "art": "literature_arts", "arts": "literature_arts",
    "linguistics": "literature_arts", "culture": "literature_arts", "music": "literature_arts",
    "film": "literature_arts",
    "media": "media_communication", "journalism": "media_communication", "communication": "media_communication",
    "publishing": "media_communication",
    "marketing": "business", "advertising": "business", "branding": "business", "sales": "business", "pr": "business",
    "commerce": "business", "ecommerce": "business", "retail": "business",
    "entertainment": "general", "gaming": "general", "tourism": "general", "travel": "general",
}

# Acronyms that are never terminology.
ACRONYM_STOP_LIST = [
    "AM", "AN", "AS", "AT", "BE", "BY", "DO", "GO", "HA", "HE", "IF",
    "IN", "IS", "IT", "ME", "MY", "NO", "OF", "OH", "OK", "ON", "OR",
    "OX", "SO", "TO", "UP", "US", "WE",
    "AD", "BC", "EU", "HR", "ID", "PM", "PR", "QA", "TV", "UK", "UN",
    "VS", "CD", "DJ", "FM", "PC", "VR", "AR", "OP", "RE", "CC", "BCC",
    "GG", "LOL", "OMG", "WOW", "YEP", "NAH", "HMM", "UMM",
]

# Languages written with Han, kana or hangul.
CJK_LANGUAGES = ["zh-CN", "zh-TW", "zh", "ja", "ko"]

# Categories of a term.
AI_CATEGORIES = ["proper_noun", "person", "place", "brand", "domain_term", "ambiguous"]

# Language display names by lower-case code.
LANGUAGE_NAMES_EN = {
    "zh-cn": "Simplified Chinese", "zh-tw": "Traditional Chinese",
    "en": "English", "ja": "Japanese", "ko": "Korean", "mn": "Mongolian", "th": "Thai",
    "vi": "Vietnamese", "id": "Indonesian", "kk": "Kazakh", "fr": "French",
    "de": "German", "es": "Spanish", "pt": "Portuguese", "ru": "Russian",
}

# JSON keys whose values are not prose.
JSON_SKIP_KEYS = [
    "url", "href", "src", "id", "uuid", "guid", "key", "name", "version", "color",
    "colour", "type", "format", "icon", "class", "className", "style", "lang", "locale",
    "currency", "email", "phone", "date", "time", "timestamp",
]

# XML attributes that carry prose.
XML_TEXT_ATTRS = ["label", "title", "placeholder", "alt", "aria-label", "content", "description"]
XML_SKIP_TAGS = ["script", "style", "code", "pre"]

# HTML elements by role.
HTML_BLOCK_TAGS = ["p", "li", "td", "th", "button", "a", "label", "figcaption", "caption", "dt", "dd"]
HTML_HEADING_TAGS = ["h1", "h2", "h3", "h4", "h5", "h6"]
HTML_SKIP_TAGS = ["script", "style", "code", "pre", "svg", "math"]
HTML_TEXT_ATTRS = ["alt", "placeholder", "title"]

# Run and job lifecycle, in order.
STATUSES = ["queued", "pending", "parsing", "terminology", "awaiting_glossary_review",
            "translating", "reviewing", "rebuilding", "done", "error", "cancelled"]
TERMINAL_STATUSES = ["done", "error", "cancelled"]
ACTIVE_RUN_STATUSES = ["pending", "queued", "translating", "reviewing", "rebuilding"]

# Segment limits by file type.
SEGMENT_TOKENS = {
    "default": 2600, "pptx": 5200, "docx": 3800, "doc": 3800, "srt": 2200, "vtt": 2200,
    "ass": 2200, "md": 3000, "json": 2800, "yaml": 2800, "yml": 2800, "po": 2200,
    "pot": 2200, "xliff": 2400, "xlf": 2400, "xml": 2800, "html": 3200, "htm": 3200,
}
SLIDES_PER_SEGMENT = 2
CUES_PER_SEGMENT = 12
CUE_GAP_SECONDS = 5.0
BLOCKS_PER_SEGMENT = 12
CONTEXT_CHARS = 500
PREVIEW_CHARS = 350
SEGMENTS_PER_WINDOW = 3
MAX_FILE_BYTES = 50 * 1024 * 1024
REGRESSION_DROP = -2.0
OVERFLOW_RATIO = 1.5
FONT_RATIO = 1.4
FONT_FLOOR = 8.0

# File extension -> reader.
READER_BY_EXTENSION = {
    ".pptx": "pptx", ".docx": "docx", ".doc": "docx", ".srt": "srt", ".vtt": "vtt",
    ".ass": "ass", ".md": "md", ".json": "json", ".yaml": "yaml", ".yml": "yaml",
    ".po": "po", ".pot": "po", ".xliff": "xliff", ".xlf": "xliff", ".xml": "xml",
    ".html": "html", ".htm": "html", ".txt": "txt", ".text": "txt",
}

# Characters that Unicode-aware stripping removes.
WHITESPACE = (" \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
              "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
# Blanks of every width, without tabs and line ends (Unicode's space separators).
SPACES = " \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"

# Patterns (Java regex syntax).
WORD = r"[^\s\p{Z}\x{85}\x{1c}-\x{1f}]+"
WIDE_CHAR = r"[\x{2e80}-\x{9fff}\x{f900}-\x{faff}\x{20000}-\x{2fa1f}]"
HAN_CHAR = r"[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{f900}-\x{faff}]"
SENTENCE_END = r"[.!?。！？…]\s*$"
URL_ONLY = r"(?i)^(https?://\S+|www\.\S+)$"
NUMBER_ONLY = r"^[\p{Nd}\s.,;:+\-*/=%$€£¥()\[\]{}]+$"
PLACEHOLDER = r"\{[^{}]*\}|%\d*\$?[sdfouxX]|%[sdfouxX]|\{\{[^{}]+\}\}|\$\{[^{}]+\}"
CLOCK = r"^(\d+):(\d+):(\d+)[:,.](\d+)"
TRAILING_PUNCT = r"[\s,.!?;:，。！？；：、…⋯—–]+$"
BULLET_PREFIX = r"^([•●▪■◆◇○◦·\-*]\s+)(.+)$"
NUMBER_PREFIX = r"^((?:\(?\d+[).、]|[A-Za-z][).、]|[IVXLCMivxlcm]+[).、])\s+)(.+)$"
ACRONYM = r"(?<![\p{L}\p{N}_])[A-Z]{2,8}(?![\p{L}\p{N}_])"
MD_HEADING = r"^(#{1,6})\s+(.+)$"
MD_LIST = r"^(\s*(?:[-*+]|\d+\.)\s+)(.+)$"
BLOCK_MARKER = r"(?:^|\n)\[\[BLOCK:([\w\-]+)\]\][ \t]*\n?"
GROUP_COMMENT = r"(?s)<!--.*?-->"
END_MARKER = "[[END]]"
END_LINE = r"(?:^|\n)[ \t]*\[\[END\]\][ \t]*(?=\n|$)"

# Headings of the sections of a prompt that bind terms.
HARD_HEADER = "Terminology constraints (must follow exactly):\n"
FIRST_USE_HEADER = ("When a term is marked for first-use annotation in this segment, render its first occurrence as "
                    "target term followed by the source term in parentheses.\n")
DIRECT_HEADER = "Use the prescribed term directly.\n"
SOFT_HEADER = "Terminology preferences (apply for consistency; override only if context requires a different meaning):\n"
