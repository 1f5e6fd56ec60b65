"""Text rules as column expressions over whole texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditlake.functions.scalars import col, contains_any, let, lookup

# Look-alike characters and their ASCII form, position by position.
UNICODE_FROM = "：﹕—–−‐‑＊⁎∗“”‘’    "
UNICODE_TO = "::-----***\"\"''    "

# Patterns that hint at malicious intent, by category.
MALICIOUS_PATTERNS = {
    "Backdoor/Remote Access": [
        r"reverse\s*shell",
        r"bind\s*shell",
        r"nc\s+-[elp]",
        r"bash\s+-i\s+>&",
        r"/dev/tcp/",
        r"socket\.connect.*\(.*,\s*\d+\)",
        r"subprocess\.Popen.*shell\s*=\s*True",
        r"os\.system\s*\(\s*['\"].*sh",
        r"hidden[_\s]?admin",
        r"secret[_\s]?backdoor",
        r"debug[_\s]?shell",
        r"master[_\s]?password",
    ],
    "Credential Harvesting": [
        r"keylog",
        r"password.*dump",
        r"credential.*steal",
        r"harvest.*password",
        r"capture.*credential",
        r"\.ssh/id_rsa",
        r"\.aws/credentials",
        r"/etc/shadow",
        r"mimikatz",
        r"lsass",
    ],
    "Data Exfiltration": [
        r"exfil",
        r"upload.*sensitive",
        r"send.*to.*server",
        r"post.*data.*external",
        r"curl.*-d.*password",
        r"requests\.post.*secret",
        r"base64.*encode.*send",
        r"dns.*tunnel",
    ],
    "Obfuscated Code Execution": [
        r"exec\s*\(\s*base64",
        r"eval\s*\(\s*base64",
        r"fromCharCode",
        r"\\x[0-9a-f]{2}\\x[0-9a-f]{2}",
        r"chr\s*\(\s*\d+\s*\)\s*\+\s*chr",
        r"exec\s*\(\s*['\"].*['\"]\s*\.\s*decode",
        r"__import__\s*\(\s*['\"]os",
        r"getattr.*__builtins__",
    ],
    "Cryptocurrency Mining": [
        r"stratum\+tcp",
        r"xmr\.pool",
        r"monero",
        r"coinhive",
        r"crypto.*mine",
        r"hashrate",
        r"--cpu-priority",
    ],
    "Persistence Mechanism": [
        r"crontab",
        r"/etc/rc\.local",
        r"systemd.*service",
        r"HKEY.*Run",
        r"startup.*folder",
        r"launchd",
        r"\.bashrc.*curl",
        r"\.profile.*wget",
    ],
    "Privilege Escalation": [
        r"setuid",
        r"setgid",
        r"sudo.*NOPASSWD",
        r"chmod\s+[47]755",
        r"chmod\s+u\+s",
        r"pkexec",
        r"doas",
    ],
}

# Tag of a test case and the words that give it.
TAG_WORDS = [
    ("buffer-overflow", ["buffer", "overflow"]),
    ("injection", ["sql", "injection"]),
    ("xss", ["xss", "cross-site"]),
    ("pointer-arithmetic", ["pointer"]),
    ("memory-issue", ["memory", "leak"]),
    ("integer-overflow", ["integer"]),
    ("format-string", ["format"]),
    ("command-injection", ["command"]),
    ("path-traversal", ["path", "traversal"]),
]

# Words that are no category keywords.
KEYWORD_STOPWORDS = ["a", "an", "the", "of", "in", "to", "and", "or", "via", "through"]

# Parameter name parts, in matching order, with their source and risk.
PARAMETER_RISKS = [
    ("filename", "User-controlled path", "HIGH - path traversal risk"),
    ("input", "External input", "HIGH - injection risk"),
    ("user", "User data", "HIGH - untrusted"),
    ("query", "Query string", "HIGH - injection risk"),
    ("cmd", "Command string", "HIGH - command injection risk"),
    ("buffer", "Buffer", "MEDIUM - overflow risk"),
    ("data", "Generic data", "MEDIUM - check source"),
]

# Words before a parenthesis that are no calls.
CALL_KEYWORDS = ["if", "for", "while", "switch", "return", "print", "def", "class"]

# CWE number to name, severity, and reason ({sink} is the called function).
CWE_NAMES = {
    "CWE-22": "Path Traversal",
    "CWE-78": "Command Injection",
    "CWE-89": "SQL Injection",
    "CWE-120": "Buffer Overflow",
    "CWE-134": "Format String Vulnerability",
    "CWE-190": "Integer Overflow",
    "CWE-269": "UEFI Variable Access",
    "CWE-327": "Weak Cryptographic Algorithm",
    "CWE-415": "Double Free",
    "CWE-416": "Use After Free",
    "CWE-749": "SMM Handler Vulnerability",
    "CWE-789": "Memory Allocation",
    "CWE-798": "Hardcoded Credentials",
    "CWE-824": "Uninitialized Pointer",
}
CWE_SEVERITY = {
    "CWE-22": "High",
    "CWE-78": "Critical",
    "CWE-89": "Critical",
    "CWE-120": "High",
    "CWE-134": "High",
    "CWE-190": "High",
    "CWE-269": "Medium",
    "CWE-327": "Medium",
    "CWE-415": "High",
    "CWE-416": "High",
    "CWE-749": "Critical",
    "CWE-789": "Medium",
    "CWE-798": "High",
    "CWE-824": "Medium",
}
CWE_REASONS = {
    "CWE-22": "File path passed to {sink}() may allow traversal",
    "CWE-78": "User-controlled data may reach {sink}() for shell usage",
    "CWE-89": "Potential SQL injection via {sink}()",
    "CWE-120": "Unbounded copy using {sink}() may overflow buffer",
    "CWE-134": "Variable format string passed to {sink}()",
    "CWE-190": "Integer arithmetic in allocation size may overflow",
    "CWE-327": "Weak cryptographic algorithm: {sink}",
    "CWE-415": "Potential double-free detected",
    "CWE-416": "Memory freed - verify no subsequent use",
    "CWE-798": "Potential hardcoded credential",
    "CWE-824": "Potentially uninitialized pointer dereference",
}

# Ordered literal rewrites of prompt templates.
TEMPLATE_REWRITES = [
    ("VERIFY", "REAL"),
    ("REJECT", "FALSE_POSITIVE"),
    ("verify", "REAL"),
    ("reject", "FALSE_POSITIVE"),
]

# Shapes of a provider's token-limit error.
LIMIT_FULL = r"(?i)max.*tokens.*too large:\s*(\d+).*maximum context length is\s*(\d+).*has\s*(\d+)\s*input"
LIMIT_PROMPT = r"(?i)maximum context length is\s*(\d+).*requested\s*(\d+).*\((\d+).*prompt"
LIMIT_PLAIN = r"(?i)context length is\s*(\d+)"

# Function headers and calls as the regex index sees them.
PARAM_LIST = r"(?:def|void|int|char\*?|string)\s+(\w+)\s*\(([^)]*)\)"
CALL_NAME = r"(?:^|[^\w])([a-zA-Z_][\w\.]*)\s*\("
PY_FUNCTION = r"def\s+(\w+)\s*\("
C_FUNCTION = r"(?:void|int|char|bool|float|double|[\w\*]+)\s+(\w+)\s*\("


# What \s stands for, and line ends beside it, before which a $ holds too.
SPACES, LINE_ENDS = " \t\n\x0b\f\r", ["\u0085", "\u2028", "\u2029"]


def strip_spaces(text: Column) -> Column:
    """Remove white space of every kind from both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def capture(text: Column, pattern: str, group: int = 1) -> Column:
    """A regex group, or null when it is absent or empty."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def captures(text: Column | str, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(col(text), F.lit(pattern), F.lit(group))


def strip_thinking(text: Column | str) -> Column:
    """Remove think and thinking tags with their content, then single tags."""
    out = col(text)
    for tag in ("thinking", "think"):
        out = F.regexp_replace(out, rf"(?is)<{tag}>.*?</{tag}>", "")
        out = F.regexp_replace(out, rf"(?i)</?{tag}>", "")
    return strip_spaces(out)


def strip_reasoning(text: Column | str) -> Column:
    """As ``strip_thinking``, also for reasoning and reflection tags and for unclosed ones."""
    out = col(text)
    for tag in ("thinking", "think", "reasoning", "reflection"):
        out = F.regexp_replace(out, rf"(?is)<{tag}>.*?</{tag}>", "")
    for tag in ("thinking", "think"):
        out = F.regexp_replace(out, rf"(?is)<{tag}>.*$", "")
    out = F.regexp_replace(out, r"(?i)</?(?:thinking|think|reasoning|reflection)>", "")
    return F.when(col(text).contains("<"), out).otherwise(col(text))


def strip_outer_fence(text: Column | str) -> Column:
    """Drop the first and last line when they are the only two code fences."""
    t = strip_spaces(col(text))
    lines = F.split(t, "\n")
    fences = (F.length(t) - F.length(F.replace(t, F.lit("```"), F.lit("")))) / 3
    wrapped = (
        t.startswith("```") & (fences == 2) & (strip_spaces(F.element_at(lines, -1)) == "```")
    )
    inner = F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 2, F.lit(0))), "\n")
    return F.when(wrapped, inner).otherwise(t)


def strip_first_last_fence(text: Column | str) -> Column:
    """Keep the lines between a leading fence and the last closing one."""
    t = strip_spaces(col(text))
    lines = F.split(t, "\n")
    back = F.array_position(F.reverse(F.transform(lines, strip_spaces)), F.lit("```"))
    close = F.size(lines) - back  # number of lines before the last closing fence
    inner = F.array_join(F.slice(lines, 2, F.greatest(close - 1, F.lit(0)).cast("int")), "\n")
    return F.when(t.startswith("```") & (back > 0) & (close > 0), strip_spaces(inner)).otherwise(t)


def normalize_unicode(text: Column | str) -> Column:
    return F.translate(col(text), UNICODE_FROM, UNICODE_TO)


def preprocess(text: Column | str) -> Column:
    """Tags off, look-alikes to ASCII, fence off, line ends to newline; no regex where a text shows that none changes it."""

    def rest(t: Column) -> Column:
        plain = (F.octet_length(t) == F.char_length(t)) & ~t.contains("```") & ~t.contains("\r")
        out = strip_spaces(F.regexp_replace(strip_first_last_fence(normalize_unicode(t)), r"\r\n?", "\n"))
        return F.when(plain, F.btrim(t, F.lit(SPACES))).otherwise(out)

    return let(strip_reasoning(text), rest)


def vote_decision(text: Column | str) -> Column:
    """Decision by substring, FALSE_POSITIVE first; ABSTAIN when none occurs."""
    up = F.upper(col(text))
    return (
        F.when(up.contains("FALSE_POSITIVE") | up.contains("FALSE POSITIVE"), "FALSE_POSITIVE")
        .when(up.contains("REAL"), "REAL")
        .when(up.contains("NEEDS_VERIFIED") | up.contains("NEEDS VERIFIED"), "NEEDS_VERIFIED")
        .when(up.contains("WEAKNESS"), "WEAKNESS")
        .otherwise("ABSTAIN")
    )


def vote_token(text: Column | str) -> Column:
    """The exact-token variant: FP is an alias, anything else is a parse error (null)."""
    token = F.upper(capture(col(text), r"(?i)(?:vote|decision|verdict|verified)\s*:\s*(\w+)"))
    return (
        F.when(token.isin("FALSE_POSITIVE", "FP"), "FALSE_POSITIVE")
        .when(token.isin("REAL", "WEAKNESS", "NEEDS_VERIFIED"), token)
    )


def clamp_confidence(text: Column | str, default: int = 50) -> Column:
    number = capture(col(text), r"(\d+)").try_cast("bigint")
    return F.least(F.lit(100), F.coalesce(number, F.lit(default))).cast("int")


def malicious_categories(*texts: Column | str) -> Column:
    """One message per category with a hit, naming its first matching pattern."""
    searched = F.lower(F.concat_ws(" ", *[F.coalesce(col(t), F.lit("")) for t in texts]))
    found = []
    for name, patterns in MALICIOUS_PATTERNS.items():
        first = F.coalesce(*[F.when(searched.rlike(f"(?i){p}"), F.lit(p)) for p in patterns])
        message = F.concat(F.lit(f"{name}: matched pattern '"), first, F.lit("'"))
        # One alternation decides for most texts; the single patterns run on hits only.
        found.append(F.when(searched.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns)), message))
    return F.array_compact(F.array(*found))


def case_tags(vulnerability_type: Column | str, reason: Column | str, difficulty: Column, num_votes: Column) -> Column:
    combined = F.lower(F.concat_ws(" ", col(vulnerability_type), col(reason)))
    tags = [F.when(contains_any(combined, words), F.lit(tag)) for tag, words in TAG_WORDS]
    tags.append(F.when(difficulty > 0.7, F.lit("difficult")).when(difficulty < 0.3, F.lit("easy")))
    tags.append(
        F.when(num_votes >= 5, F.lit("high-agreement")).when(num_votes >= 3, F.lit("medium-agreement"))
    )
    return F.array_compact(F.array(*tags))


def max_output_tokens(prompt: Column, requested: Column, context: Column, minimum: int = 100) -> Column:
    """Output budget that fits the context; an unknown context (0) keeps the request."""
    room = context - F.floor(F.length(prompt) / 4)
    return (
        F.when(context <= 0, requested)
        .when(room < minimum, F.lit(minimum))
        .otherwise(F.least(requested, room))
        .cast("bigint")
    )


def limit_error(message: Column | str) -> Column:
    """Struct (context, input_tokens, requested) of a token-limit error, null when it is none."""
    m = col(message)
    part = lambda pattern, group: F.regexp_extract(m, pattern, group).try_cast("bigint")
    shape = lambda c, i, r: F.struct(c.alias("context"), i.alias("input_tokens"), r.alias("requested"))
    zero = F.lit(0).cast("bigint")
    return (
        F.when(m.rlike(LIMIT_FULL), shape(part(LIMIT_FULL, 2), part(LIMIT_FULL, 3), part(LIMIT_FULL, 1)))
        .when(m.rlike(LIMIT_PROMPT), shape(part(LIMIT_PROMPT, 1), part(LIMIT_PROMPT, 3), part(LIMIT_PROMPT, 2)))
        .when(
            m.rlike(LIMIT_PLAIN),
            shape(
                part(LIMIT_PLAIN, 1),
                F.coalesce(part(r"(?i)(\d+)\s*input", 1), zero),
                F.coalesce(part(r"too large:\s*(\d+)", 1), zero),
            ),
        )
    )


def retry_tokens(message: Column | str, error: Column) -> Column:
    """95 % of the room left, else half of the requested number."""
    room = F.floor((error["context"] - error["input_tokens"]) * 95 / 100)
    requested = F.regexp_extract(col(message), r"too large:\s*(\d+)", 1).try_cast("bigint")
    return F.when(room > 0, room).otherwise(F.floor(requested / 2)).cast("bigint")


def keywords(text: Column | str) -> Column:
    """Words over two letters of a category text, without CWE numbers and stop words."""
    plain = F.regexp_replace(F.lower(col(text)), r"cwe-\d+", "")
    words = captures(plain, r"([\p{L}\p{N}_]+)")
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(KEYWORD_STOPWORDS))


def short_name(text: Column | str) -> Column:
    return capture(col(text), r"\b([A-Z]{2,6})\b")


def parameter_risks(content: Column | str) -> Column:
    """Array of ``function(parameter)|source|risk`` for parameters with telling names."""
    names, params = captures(content, PARAM_LIST, 1), captures(content, PARAM_LIST, 2)

    def risks(pair: Column) -> Column:
        parts = F.filter(F.transform(F.split(pair["1"], ","), strip_spaces), lambda p: p != "")
        last = F.transform(
            parts,
            lambda p: F.regexp_replace(F.element_at(F.split(p, r"\s+"), -1), r"^[*& ]+|[*& ]+$", ""),
        )

        def risk(p: Column) -> Column:
            out = F.when(F.lit(False), F.lit(""))
            for word, source, level in PARAMETER_RISKS:
                text = F.concat(pair["0"], F.lit("("), p, F.lit(f")|{source}|{level}"))
                out = out.when(F.lower(p).contains(word), text)
            return out

        return F.array_compact(F.transform(last, risk))

    return F.flatten(F.transform(F.arrays_zip(names.alias("0"), params.alias("1")), risks))


def call_names(content: Column | str) -> Column:
    return F.filter(
        captures(content, CALL_NAME),
        lambda c: ~c.isin(CALL_KEYWORDS) & ~c.startswith("__"),
    )


def function_names(content: Column | str) -> Column:
    return F.concat(captures(content, PY_FUNCTION), captures(content, C_FUNCTION))


def agent_verdict(answer: Column | str) -> Column:
    """Struct of verdict, confidence, reasoning and attack path of an agent's final answer."""
    a = col(answer)
    number = capture(a, r"(?i)CONFIDENCE:\s*(\d+)").try_cast("bigint")
    return F.struct(
        F.upper(a).contains("REAL").alias("verified"),
        F.least(F.lit(100), F.coalesce(number, F.lit(50))).cast("int").alias("confidence"),
        F.coalesce(
            strip_spaces(capture(a, r"(?is)REASONING:\s*(.+?)(?:ATTACK_PATH:|$)")),
            F.lit("Analysis incomplete"),
        ).alias("reasoning"),
        F.coalesce(
            strip_spaces(capture(a, r"(?is)ATTACK_PATH:\s*(.+?)(?:\*END|$)")), F.lit("")
        ).alias("attack_path"),
    )


def cwe_name(cwe: Column | str) -> Column:
    return F.coalesce(lookup(CWE_NAMES, col(cwe)), col(cwe))


def cwe_severity(cwe: Column | str) -> Column:
    return lookup(CWE_SEVERITY, col(cwe), "Medium")


def cwe_reason(cwe: Column | str, sink: Column | str) -> Column:
    template = F.coalesce(
        lookup(CWE_REASONS, col(cwe)),
        F.concat(F.lit("Potential "), cwe_name(cwe), F.lit(" detected")),
    )
    return F.replace(template, F.lit("{sink}"), col(sink))


def rewrite_template(template: Column | str) -> Column:
    out = col(template)
    for old, new in TEMPLATE_REWRITES:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def numbered_code(content: Column | str, start: int = 1) -> Column:
    """Lines as ``%4d | line``."""
    return F.array_join(
        F.transform(
            F.split(col(content), "\n"),
            lambda x, i: F.concat(_pad(i + start), F.lit(" | "), x),
        ),
        "\n",
    )


def _pad(number: Column) -> Column:
    text = number.cast("string")
    return F.when(F.length(text) >= 4, text).otherwise(F.lpad(text, 4, " "))
