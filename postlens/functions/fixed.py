"""Word lists, lookup tables, patterns and constants that decide results.

Everything here is data that must stay as it is for results to match; the logic lives elsewhere.
"""

# Whitespace as Python's str.strip and \s see it.
WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85         "
    "        　"
)
WS_CLASS = "[\\t-\\r\\x1c-\\x20\\x85\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"

# Company suffix patterns, removed in this order, case ignored.
COMPANY_SUFFIXES = [
    r"\bPrivate Limited\b",
    r"\bPte\.?\s*Ltd\.?\b",
    r"\bLimited\b",
    r"\bLtd\.?\b",
    r"\bIncorporated\b",
    r"\bInc\.?\b",
    r"\bCorporation\b",
    r"\bCorp\.?\b",
    r"\bLLC\b",
    r"\bL\.L\.C\.\b",
]

# Lower-cased place names and the region they stand for.
LOCATION_MAP = {
    "central": "Central",
    "central region": "Central",
    "central area": "Central",
    "cbd": "Central",
    "city": "Central",
    "downtown": "Central",
    "east": "East",
    "east region": "East",
    "eastern": "East",
    "west": "West",
    "west region": "West",
    "western": "West",
    "north": "North",
    "north region": "North",
    "northern": "North",
    "north-east": "North-East",
    "northeast": "North-East",
    "north east": "North-East",
    "north-eastern": "North-East",
    "singapore": "Singapore",
    "sg": "Singapore",
}

# Words that mark a pay text as having no figure.
PAY_WITHOUT_FIGURE = ["competitive", "negotiable", "attractive", "commensurate", "to be discussed", "tbd"]

# Amount pattern, applied to lower-cased text (WS_CLASS stands for \s).
PAY_AMOUNT = rf"\$?{WS_CLASS}*(\d+(?:,\d{{3}})*(?:\.\d+)?){WS_CLASS}*k?"

# Substrings that name a pay period, tested in this order, and the factor to a month.
PAY_PERIODS = [
    ("hourly", ["hour", "/hr"], 160.0),
    ("daily", ["day", "daily"], 22.0),
    ("yearly", ["year", "annual", "per annum", "p.a.", "pa"], 1 / 12),
]

# Personal-data patterns, in the order they are reported and redacted.
NRIC_PATTERN = r"(?i)\b[STFG]\d{7}[A-Z]\b"
PHONE_PATTERN = r"\+65\s?\d{4}\s?\d{4}|\b[89]\d{7}\b"
EMAIL_PATTERN = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
CARD_PATTERN = r"\b\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b"
PII_MASKS = [
    (NRIC_PATTERN, "[REDACTED_NRIC]"),
    (PHONE_PATTERN, "[REDACTED_PHONE]"),
    (EMAIL_PATTERN, "[REDACTED_EMAIL]"),
    (CARD_PATTERN, "[REDACTED_CC]"),
]

# Prompt-injection patterns (ignore case, multi-line); the position in the list is reported.
PROMPT_INJECTION = [
    r"ignore\s+(previous|all|earlier)\s+(instructions?|prompts?|commands?)",
    r"forget\s+(everything|all|previous)",
    r"disregard\s+(all|previous|earlier)",
    r"(act|pretend|behave)\s+as\s+(a\s+)?(different|new)",
    r"system\s*:\s*",
    r"<\s*system\s*>",
    r"override\s+(previous|all|earlier)",
    r"new\s+(instruction|command|rule)",
]

# SQL-injection patterns (ignore case, multi-line); the position in the list is reported.
SQL_INJECTION = [
    r";\s*(union|select|insert|update|delete|drop|exec|execute)\b",
    r"--\s*$",
    r"/\*.*\*/",
    r"'\s*(or|and)\s*'",
    r"'.*\bor\b.*'.*=.*'",
    r"\bor\b\s+\d+\s*=\s*\d+",
    r"\band\b\s+\d+\s*=\s*\d+",
    r"\bunion\b.*\bselect\b",
]

# Stop words left out of cluster names.
LABEL_STOP_WORDS = ["the", "a", "an", "and", "or", "in", "at", "for", "to", "of", "-"]

# Frequent function words per language, used as language profiles.
LANGUAGE_WORDS = {
    "de": ["der", "die", "das", "und", "ist", "nicht", "ein", "eine", "mit", "für", "auf", "von", "zu", "den", "sich"],
    "en": ["the", "and", "of", "to", "in", "is", "that", "for", "with", "was", "are", "this", "by", "on", "it"],
    "es": ["el", "los", "las", "y", "una", "por", "con", "para", "del", "se", "no", "su", "es", "al", "lo"],
    "fr": ["le", "les", "des", "et", "une", "est", "dans", "pour", "que", "qui", "sur", "pas", "au", "du", "avec"],
    "ms": ["dan", "yang", "untuk", "dengan", "dari", "ini", "itu", "pada", "adalah", "dalam", "akan", "tidak", "kami", "anda", "ke"],
}

# Scripts that name a language by themselves, and the share of letters from which they do.
LANGUAGE_SCRIPTS = {"ta": "Tamil", "zh": "Han"}
SCRIPT_SHARE = 0.3

# Advice returned when retrieval finds nothing.
NO_RESULT_ADVICE = (
    "I couldn't find any jobs matching your search criteria. "
    "This might be because:\n"
    "- The filters are too restrictive (try relaxing location or salary requirements)\n"
    "- The query terms don't match available jobs\n"
    "- Try a broader search without filters first."
)

# Price in USD per million tokens of the paid model; other providers cost nothing.
TOKEN_PRICE_INPUT = 0.075
TOKEN_PRICE_OUTPUT = 0.30

# Latency histogram bounds in seconds.
REQUEST_BOUNDS = [0.1, 0.5, 1.0, 2.0, 5.0, 10.0, 30.0, 60.0]
MODEL_CALL_BOUNDS = [0.5, 1.0, 2.0, 5.0, 10.0, 20.0, 30.0, 60.0]
RETRIEVAL_BOUNDS = [0.1, 0.5, 1.0, 2.0, 5.0]
GRADING_BOUNDS = [0.5, 1.0, 2.0, 5.0, 10.0]
AGENT_BOUNDS = [1.0, 5.0, 10.0, 20.0, 30.0, 60.0, 120.0]

# Markup taken out with its content, tags that end a line, and any other tag.
HTML_BLOCKS = ["(?isu)<script[^>]*>.*?</script>", "(?isu)<style[^>]*>.*?</style>"]
HTML_LINE_TAGS = "(?iu)</?(p|div|br|li|tr|h[1-6])[^>]*>"
HTML_TAGS = "<[^>]+>"
