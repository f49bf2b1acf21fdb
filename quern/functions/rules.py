"""Patterns, word lists and tables that rules must share for equal results."""

# Fixed values, as published: text normalisation.
ZERO_WIDTH = "​‌‍⁠﻿­"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
URL = r"(?i)https?://\S+|www\.\S+"
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
QUOTES_FROM, QUOTES_TO = "‘’“”–", "''\"\"-"
LONG_DASH, ELLIPSIS = ("—", "--"), ("…", "...")

# Fixed values, as published: safety patterns, in the order in which they are tried.
HATE = r"\b(?:kill all|genocide of|exterminate|gas the|white power|racial slur placeholder|death to all)\b"
EXPLICIT = r"\b(?:explicit_term_placeholder|adult_content_marker)\b"
SPAM = r"(?:click here to claim|you have won|act now|limited time offer|100% free|make money fast|work from home|earn \$\d+/day|buy now|buy cheap|cheap meds|erectile|casino|gambling|bitcoin doubler|crypto scam|phishing\.)"
INJECTION = r"(?:ignore previous instructions|disregard your|forget everything|you are now|pretend you are a|act as if|jailbreak|DAN mode|prompt injection|override safety|bypass filter|<\|system\|>|<\|user\|>|<\|assistant\|>|<\|im_start\|>)"
MALWARE = r"(?:eval\(base64_decode|exec\(base64|shell_exec\(|powershell -enc|cmd\.exe /c|net user /add|wget http.*\| bash|curl.*\| sh|chmod \+x.*&&|rm -rf /|format c:|WScript\.Shell|CreateObject\(\"Shell)"
PII = r"(?:\b\d{3}[-.\s]?\d{2}[-.\s]?\d{4}\b|\b\d{16}\b|\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z]{2,}\b(?:.{0,10}password|.{0,10}ssn)|password[\s:=]+\S{4,})"
SYNTHETIC = r"(?:as an ai language model|as an ai assistant|i cannot and will not|i'm just an ai|this content was generated|lorem ipsum dolor sit amet.{0,100}lorem ipsum|test test test test|aaaa+|zzzz+|1234567890 1234567890)"

# Fixed values, as published: quality patterns, words and weights.
MARKUP = r"<[^>]{1,80}>|\{\{[^}]{1,80}\}\}|\[\[[^\]]{1,80}\]\]"
BOILERPLATE = r"(click here|privacy policy|terms of service|all rights reserved|subscribe to our newsletter|copyright \d{4}|follow us on|share this article|loading\.\.\.|advertisement|sponsored content|read more|see also|external links|references\s*\[)"
EDUCATIONAL = ("because", "therefore", "however", "although", "furthermore", "moreover", "consequently", "nevertheless", "whereas", "thus", "hence", "since", "unless", "meanwhile", "despite", "analysis", "research", "study", "evidence", "according", "result", "conclusion", "theory", "experiment", "hypothesis", "data", "example", "definition", "explains", "demonstrates", "indicates", "suggests", "represents")
WEIGHTS = {"alpha": 0.15, "unique": 0.10, "educational": 0.15, "paragraph": 0.10, "word_length": 0.10, "punctuation": 0.05, "repetition": -0.20, "markup": -0.15, "boilerplate": -0.10, "uppercase": -0.05, "url": -0.05}

# Fixed values, as published: topics and their key words, in the order that breaks ties.
TOPICS = {
    "science": ("research", "experiment", "hypothesis", "data", "study", "analysis", "evidence"),
    "technology": ("software", "hardware", "algorithm", "system", "network", "code", "api", "database"),
    "mathematics": ("theorem", "proof", "equation", "function", "variable", "integral", "derivative"),
    "history": ("century", "war", "empire", "revolution", "civilization", "ancient", "medieval"),
    "politics": ("government", "election", "policy", "parliament", "democracy", "law", "rights"),
    "health": ("medical", "disease", "treatment", "patient", "clinical", "therapy", "diagnosis"),
    "education": ("learning", "student", "teacher", "curriculum", "university", "knowledge", "skill"),
    "philosophy": ("ethics", "morality", "consciousness", "existence", "reasoning", "logic", "truth"),
    "literature": ("novel", "poem", "story", "character", "narrative", "fiction", "author"),
    "business": ("company", "market", "revenue", "profit", "investment", "startup", "management"),
}
# Fixed values, as published: language codes a document may carry.
LANGUAGES = tuple("af sq am ar hy az eu be bn bs bg ca ceb zh co hr cs da nl en eo et fi fr fy gl ka de el gu ht ha haw he hi hmn hu is ig id ga it ja jv kn kk km ko ku ky lo la lv lt lb mk mg ms ml mt mi mr mn my ne no ny or ps fa pl pt pa ro ru sm gd sr sn sd si sk sl so st es su sw sv tl tg ta tt te th tr tk uk ur ug uz vi cy xh yi yo zu xx".split())

# Fixed values, as published: line cleaning, in the order in which the substitutions apply.
LINE_MARKUP = (
    (r"(?is)<ref[^>]*>.*?</ref>", ""),
    (r"<[^>]+>", ""),
    (r"\{\{[^}]*\}\}", ""),
    (r"\[https?://[^\s\]]+(?:\s[^\]]+)?\]", ""),
    (r"\[\[(?:[^|\]]*\|)?([^\]]*)\]\]", "$1"),
    (r"https?://\S+", ""),
    (r"\[\d+\]", ""),
    (r"^[\*#:;]+\s*", ""),
    (CONTROL, ""),
    (r" {2,}", " "),
)
STRUCTURAL = (r"^={1,6}.+={1,6}\s*$", r"^\s*[|!{]", r"(?i)^\s*(?:Category|File|Image|Media|Template):", r"(?i)^\s*#redirect")

# Fixed values, as published: encyclopaedia pages.
WIKITEXT = (
    (r"(?s)<!--.*?-->", ""),
    (r"(?is)<ref[^>]*>.*?</ref>", ""),
    (r"(?i)\[\[(?:File|Image|Media):[^\]]*\]\]", ""),
    *[(r"(?s)\{\{[^}]*?\}\}", "")] * 4,
    (r"(?s)\{\{.*?\}\}", ""),
    (r"\[\[(?:[^|\]]*\|)?([^\]]*)\]\]", "$1"),
    (r"<[^>]{1,80}>", ""),
    (r"(?m)^={1,6}\s*.+\s*={1,6}\s*$", ""),
    (r"\n{3,}", "\n\n"),
    (r" {2,}", " "),
)
SKIPPED_TITLES = ("Wikipedia:", "Template:", "Help:", "File:", "Category:", "Talk:", "User:", "Portal:", "Draft:", "Module:", "MediaWiki:", "TimedText:", "Special:")
# Fixed values, as published: book boilerplate, in order of priority.
BOOK_START = ("*** START OF THE PROJECT GUTENBERG", "***START OF THE PROJECT GUTENBERG", "*** START OF THIS PROJECT GUTENBERG")
BOOK_END = ("*** END OF THE PROJECT GUTENBERG", "***END OF THE PROJECT GUTENBERG", "*** END OF THIS PROJECT GUTENBERG", "End of the Project Gutenberg")
# Fixed values, as published: domains by category prefix, code file extensions.
PREPRINT_DOMAINS = {"cs": "computer_science", "math": "mathematics", "physics": "physics", "astro": "astronomy", "bio": "biology", "chem": "chemistry", "econ": "economics", "stat": "statistics"}
CODE_EXTENSIONS = (".py", ".js", ".ts", ".java", ".cpp", ".c", ".h", ".cs", ".go", ".rs", ".rb", ".php", ".swift", ".kt", ".scala", ".sh", ".sql", ".md", ".rst", ".txt")

# Fixed values, as published: search intent.
LIVE = r"\btoday\b|\bnow\b|\bcurrent(ly)?\b|\blatest\b|\brecent(ly)?\b|\bright now\b|\bthis (week|month|year)\b|\b202[4-9]\b|\bprice of\b|\bstock\b|\bweather\b|\bbreaking\b|\bnews\b|\bupdate(s)?\b|\bwhat happened\b|\bwhen did\b|\bwho (is|are) (the )?(current|new)\b"
FACTUAL = ("who is", "what is the", "where is", "when is", "how much is")
# Fixed values, as published: log lines and token splitting.
LOG_LINE = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})\s+\|\s+(\w+)\s+\|\s+([^|]+)\s+\|\s+(.+)"
LEGACY_SPLIT = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\w+| ?[^\s\w]+|\s+(?!\S)|\s+"
PRE_SPLIT = r"(?U)'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
