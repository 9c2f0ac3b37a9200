"""Settings of the operators: patterns, tiers, severities and policies, as plain data that compiles into Columns."""

from __future__ import annotations

from dataclasses import dataclass, field

# Ordered severities and tiers.
SEVERITIES = ("info", "low", "medium", "high", "critical")
TIERS = ("L0", "L1", "L2", "L3", "L4")

# Sensitive zones and their patterns, in order.
ZONES = {
    "auth": r"(auth|login|password|credential|token|secret|api.?key)",
    "payment": r"(payment|billing|credit.?card|stripe|paypal|transaction)",
    "crypto": r"(encrypt|decrypt|hash|sign|verify|private.?key|public.?key)",
    "database": r"(sql|query|execute|cursor|connection|migrate)",
    "security": r"(security|permission|access|role|admin|privilege)",
    "pii": r"(email|phone|address|ssn|social.?security|date.?of.?birth)",
    "config": r"(config|setting|environment|env\.|\.env)",
    "infra": r"(terraform|kubernetes|docker|aws|azure|gcp|cloudformation)",
    "command_injection": r"(os\.system|os\.popen|child_process|exec\(|eval\(|spawn|shell\s*=\s*True|subprocess\.(?:Popen|call)\s*\()",
    "deserialization": r"(pickle\.load|yaml\.load\(|yaml\.unsafe_load|marshal\.load|shelve\.open|jsonpickle|unserialize|readObject)",
    "template_injection": r"(render_template_string|Template\(|Jinja2|mako\.template|format_map|\.safe_substitute|mark_safe|Markup\(|server.?side.?template)",
    "path_traversal": r"(\.\./|\.\.\\|os\.path\.join|path\.join|send_file|sendFile|readFile|shutil\.(copy|move|copytree)|extractall|zipfile\.ZipFile|tarfile\.open)",
    "weak_crypto": r"(md5|sha1[^0-9]|DES\b|RC4|ECB|random\.random|random\.seed|Math\.random|weak.?hash|insecure.?random)",
    "xss": r"(<script|<img\s|onerror|onload|innerHTML|\.html\(|document\.write|mark_safe|Markup\(|\bResponse\s*\(.*<)",
}
TOPIC_ZONES = ("auth", "payment", "crypto", "database", "security", "pii", "config", "infra")
HASH_FIELD = r"""\b\w*_hash\b.{0,20}["']?(?:sha256:)?[0-9a-fA-F]{64}["']?"""
DOC_FILE = r"(?:\.md|\.txt|\.rst)$|(?:^|/)(?:README|LICENSE|CHANGELOG|CONTRIBUTING)"
CONFIG_FILE = r"(?:^|/)\.env(?:\.[^/]*)?$|\.(?:ya?ml|json|toml|ini|cfg|conf|lock|env|properties)$"
COMMENT_MARKERS = {
    "#": (".py", ".sh", ".bash", ".rb", ".pl", ".r", ".ps1", ".tf", ".coffee"),
    "//": (".js", ".ts", ".jsx", ".tsx", ".mjs", ".cjs", ".java", ".c", ".cc", ".cpp", ".cxx", ".h", ".hpp", ".cs", ".go", ".rs", ".kt", ".kts", ".swift", ".scala", ".php", ".dart"),
    "--": (".sql", ".lua", ".hs"),
}

# Path patterns of the preliminary and of the final tier, and size thresholds.
EARLY_PATHS = {
    "L0": (r"\.md$", r"\.txt$", r"\.rst$", "LICENSE", "CHANGELOG", "README", r"\.gitignore$"),
    "L1": ("test[s]?/", "spec[s]?/", "__test__", r"\.test\.", r"\.spec\.", r"_test\.py$"),
    "L3": ("auth", "login", "session", "permission", "role", "access", "middleware", "config"),
    "L4": ("payment", "billing", "transaction", "credit", "stripe", "encrypt", "decrypt", "secret", "password", "credential", "ssn", "pii", "hipaa", "gdpr"),
}
PATHS = {
    "L0": (r"\.md$", r"\.txt$", r"\.rst$", "LICENSE", "CHANGELOG", "README", r"\.gitignore$", r"\.editorconfig$"),
    "L1": ("test[s]?/", "spec[s]?/", "__test__", r"\.test\.", r"\.spec\.", r"_test\.py$", "mock", "fixture"),
    "L3": ("auth", "login", "session", "permission", "role", "access", "middleware", "interceptor", "config", "setting", r"\.env"),
    "L4": ("payment", "billing", "transaction", "credit", "stripe", "paypal", "encrypt", "decrypt", "secret", "password", "credential", "token", "ssn", "social.security", "pii", "hipaa", "gdpr", "compliance"),
}
ZONE_SEVERITY = {
    "payment": "critical", "crypto": "critical", "pii": "critical", "command_injection": "critical", "deserialization": "critical",
    "xss": "high", "auth": "high", "security": "high", "database": "high", "template_injection": "high", "path_traversal": "high", "weak_crypto": "high", "entropy_secret": "high",
    "config": "medium", "infra": "medium",
}
SIZE_THRESHOLDS = {"large": 500, "medium": 100, "small": 20}

# File lanes by extension, and model slots by tier.
LANES = {"pdf": (".pdf",), "sheet": (".xlsx", ".xlsm"), "image": (".png", ".jpg", ".jpeg", ".bmp", ".tiff")}
REVIEW_SLOTS = {"L0": 0, "L1": 1, "L2": 2, "L3": 3, "L4": 3}


@dataclass(frozen=True)
class RiskPolicy:
    """Path patterns, zone severities and size thresholds; thresholds must fall strictly and none be negative."""

    paths: dict = field(default_factory=lambda: PATHS)
    zone_severity: dict = field(default_factory=lambda: ZONE_SEVERITY)
    sizes: dict = field(default_factory=lambda: SIZE_THRESHOLDS)

    def __post_init__(self):
        if unknown := set(self.paths) - {"L0", "L1", "L3", "L4"}:
            raise ValueError(f"unknown tiers: {sorted(unknown)}")
        if bad := set(self.zone_severity.values()) - set(SEVERITIES):
            raise ValueError(f"unknown severities: {sorted(bad)}")
        if not self.sizes["large"] > self.sizes["medium"] > self.sizes["small"] >= 0:
            raise ValueError("size thresholds must fall from large to small")


@dataclass(frozen=True)
class DecisionPolicy:
    """Rules that block and rules that set conditions, each of severity, provable_only and category (all that are given)."""

    name: str
    block: tuple[dict, ...]
    conditions: tuple[dict, ...]
    max_conditions: int

    def __post_init__(self):
        for rule in (*self.block, *self.conditions):
            if rule.get("severity", "high") not in SEVERITIES:
                raise ValueError(f"unknown severity: {rule['severity']}")


# The built-in decision policies.
POLICIES = {
    "standard": DecisionPolicy("standard", ({"severity": "critical", "provable_only": True},), ({"severity": "critical"}, {"severity": "high"}), 2),
    "strict": DecisionPolicy("strict", ({"severity": "critical"}, {"severity": "high", "provable_only": True}), ({"severity": "high"}, {"severity": "medium", "provable_only": True}), 2),
    "advisory": DecisionPolicy("advisory", (), ({"severity": "critical"}, {"severity": "high"}), 2),
}
