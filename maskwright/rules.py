"""Detection rules as data.

A rule is one row: what to look for, what to write instead, and how sure we are.
Rules live on the driver (tens of rows); everything they do to text happens in
Spark expressions built from them (see ``operators.detect``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, replace

from maskwright.functions.dialect import java_pattern, runs_on_jvm

__all__ = [
    "Rule", "Detector", "RuleSet", "PRIORITIES", "PROFILES",
    "default_rules", "rules_for_profile", "profile_names", "strict_ipv6", "rules_dataframe", "profiles_dataframe",
]


@dataclass(frozen=True)
class Rule:
    """One pattern rule.

    ``pattern`` is a Python regular expression and defines the meaning. ``jvm``
    may hold an equivalent Java pattern when the plain translation would be slow
    or would recurse; ``gate`` is a cheap necessary condition over the SQL names
    ``{x}`` (text) and ``{lc}`` (text in lower case). ``need`` is another one that several
    rules share, over ``{x}`` only; it is tested once, and their gates only where it holds.
    ``lead`` is a class every match must start with.
    """

    category: str
    label: str
    pattern: str
    replacement: str
    confidence: float = 1.0
    priority: int = 99
    jvm: str | None = None
    gate: str | None = None
    lead: str | None = None
    check: str | None = None
    engine: str | None = None
    need: str | None = None

    def resolved_engine(self) -> str:
        if self.engine:
            return self.engine
        return "jvm" if self.jvm or runs_on_jvm(self.pattern) else "python"

    def java(self) -> str:
        return self.jvm or java_pattern(self.pattern, self.lead)


@dataclass(frozen=True)
class Detector:
    """A user detector: ``column(text) -> array<span>``, with a category and priority.

    The function gets the text Column and returns an array of structs with the
    fields of ``operators.detect.SPAN_TYPE``; it may be built from expressions or
    be a pandas UDF.
    """

    category: str
    column: Callable
    priority: int = 99


@dataclass(frozen=True)
class RuleSet:
    rules: tuple[Rule, ...]
    detectors: tuple[Detector, ...] = ()
    tables: tuple = ()  # of operators.many_rules.RuleTable

    @classmethod
    def of(cls, items: RuleSet | Iterable | None) -> RuleSet:
        """Accept a rule set, any mix of rules, detectors and rule tables, or nothing (= the defaults).

        An empty list also means the defaults.
        """
        if isinstance(items, RuleSet):
            return items
        items = list(items or ())
        if not items:
            return cls(tuple(default_rules()))
        return cls(tuple(i for i in items if isinstance(i, Rule)),
                   tuple(i for i in items if isinstance(i, Detector)),
                   tuple(i for i in items if not isinstance(i, (Rule, Detector))))

    def ordered(self) -> list[Rule]:
        """Stable order by priority; this is the last tie-break of overlap resolution."""
        return sorted(self.rules, key=lambda r: r.priority)


# --------------------------------------------------------------------------- gates
def _has(*words: str) -> str:
    return "(" + " OR ".join(f"contains({{x}}, '{w}')" for w in words) + ")"


def _has_ci(*words: str) -> str:
    return "(" + " OR ".join(f"contains({{lc}}, '{w}')" for w in words) + ")"


# Needs: what the gates of several rules have in common. Most texts of a corpus hold none of it, so a pass per need is all they cost.
# A name, which ends in one of these letters, and a sign after it
_PAIR = "((contains({x}, '=') OR contains({x}, ':')) AND rlike({x}, '[dyntDYNT][\\\\p{{IsWhite_Space}}\\\\x1c-\\\\x1f]*[=:]'))"
_NUMBER = ("rlike({x}, '(?=[.)0-9A-Z])(?:[.][0-9\\\\p{{Nd}}]{{1,3}}[.]|[0-9)][ .-][0-9]{{3}}[ .-][0-9]{{4}}|[0-9]{{4}}[ -]?[0-9]{{4}}[ -]?[0-9]{{4}}"
           "|[0-9]-[0-9]{{2}}-[0-9]{{4}}|[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11}}|A[KSRINP][IODPVK]A[0-9A-Z]{{16}})')")
_NAMED = "rlike({x}, '(?=[bBpPlL.])(?iu:bearer|passport|localhost|[.](?:internal|local|corp|lan|home[.]arpa))')"

# One host label followed by a dot, and the walk to the next label that starts with an
# internal suffix. Possessive loops keep the Java matcher iterative (a plain repeated group
# recurses once per label and overflows the stack on long dotted runs) and one pass long.
_LABEL = r"[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?(?=\.)"
_SUFFIX = r"(?:internal|local|corp|lan|home\.arpa)"


def _host(suffix: str) -> str:
    to_suffix = rf"(?:\.(?!{suffix}){_LABEL})*+\.(?={suffix})"
    return rf"{_LABEL}(?:{to_suffix}{_LABEL}(?={to_suffix}))*+{to_suffix}{suffix}"


# --------------------------------------------------------------------------- fixed values
# Labels, patterns, replacements, confidences and priorities that results must equal.
PRIORITIES = {"secrets": 1, "cloud": 2, "pii": 2, "network": 3, "custom": 10}

PROFILES = {
    "aws": ("secrets", "cloud"),
    "k8s": ("secrets", "network"),
    "secrets": ("secrets",),
    "network": ("network",),
}
ALWAYS_ON = ("custom", "pii")

# The secrets patterns are our own: only labels, replacements and a few examples are public.
SECRETS = (
    ("private_key", r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z0-9 ]*PRIVATE KEY-----",
     "[PRIVATE_KEY]", 1.0),
    ("jwt", r"\beyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "[JWT]", 1.0),
    ("bearer_token", r"(?i)\bbearer\s+[A-Za-z0-9._~+/=-]{8,}", "[BEARER_TOKEN]", 0.95),
    ("api_key",
     r"(?i)(?:api[_-]?key|access[_-]?token|secret[_-]?key)\s*[=:]\s*['\"]?[A-Za-z0-9._~+/=-]{8,}['\"]?",
     "[API_KEY]", 0.90),
    ("password", r"(?i)(?:password|passwd|pwd)\s*[=:]\s*(?:\"[^\"\n]*\"|'[^'\n]*'|[^\s'\"]+)",
     "[REDACTED]", 0.85),
    ("hex_token", r"\b[0-9a-f]{32,64}\b", "[TOKEN]", 0.70),
)

CLOUD = (
    ("aws_access_key_id", r"\b(?:AKIA|ASIA|AROA|AIDA|ANPA|ANVA|APKA)[0-9A-Z]{16}\b", "[AWS_ACCESS_KEY_ID]", 1.0),
    ("aws_secret_access_key",
     r"(?i)aws[_-]?secret[_-]?access[_-]?key\s*[=:]\s*['\"]?([A-Za-z0-9+/]{40})['\"]?",
     "[AWS_SECRET_ACCESS_KEY]", 0.95),
    ("aws_account_id", r"(?i)(?:account[_-]?id|aws[_-]?account)\s*[=:]\s*['\"]?(\d{12})['\"]?",
     "[AWS_ACCOUNT_ID]", 0.90),
    ("aws_arn", r"\barn:aws[a-z0-9-]*:[a-z0-9\-]*:[a-z0-9\-]*:\d{12}:[^\s\"']+", "[AWS_ARN]", 1.0),
    ("aws_session_token",
     r"(?i)(?:aws[_-]?session[_-]?token|session[_-]?token)\s*[=:]\s*['\"]?([A-Za-z0-9+/=]{100,300})['\"]?",
     "[AWS_SESSION_TOKEN]", 0.95),
    ("gcp_api_key", r"\bAIza[0-9A-Za-z\-_]{35}\b", "[GCP_API_KEY]", 1.0),
    ("gcp_service_account", r"\b[a-z0-9\-]+@[a-z0-9\-]+\.iam\.gserviceaccount\.com\b",
     "[GCP_SERVICE_ACCOUNT]", 1.0),
    ("gcp_project_id",
     r"(?i)(?:project[_-]?id|gcp[_-]?project)\s*[=:]\s*['\"]?([a-z][a-z0-9\-]{4,28}[a-z0-9])['\"]?",
     "[GCP_PROJECT_ID]", 0.80),
    ("azure_id",
     r"(?i)(?:subscription[_-]?id|tenant[_-]?id|client[_-]?id)\s*[=:]\s*['\"]?"
     r"([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})['\"]?",
     "[AZURE_ID]", 0.90),
    ("azure_client_secret", r"(?i)client[_-]?secret\s*[=:]\s*['\"]?([A-Za-z0-9~._\-]{34,})['\"]?",
     "[AZURE_CLIENT_SECRET]", 0.85),
    ("azure_storage_connection_string",
     r"DefaultEndpointsProtocol=https;AccountName=[^;]+;AccountKey=[A-Za-z0-9+/=]{88};[^\s\"']*",
     "[AZURE_STORAGE_CONNECTION_STRING]", 1.0),
    ("azure_sas_token",
     r"(?i)(?:sv|se|sr|sp|sig)=[A-Za-z0-9%+/=]+(?:&(?:sv|se|sr|sp|sig)=[A-Za-z0-9%+/=]+){3,}",
     "[AZURE_SAS_TOKEN]", 0.95),
)

NETWORK = (
    ("ipv4_address", r"\b(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\b",
     "[IP_ADDRESS]", 0.90),
    ("ipv6_address", r"\b(?:[A-Fa-f0-9]{1,4}:){2,7}[A-Fa-f0-9]{1,4}\b|\b(?:[A-Fa-f0-9]{1,4}:){1,7}:\b",
     "[IP_ADDRESS]", 0.85),
    ("internal_hostname",
     r"(?i)\b(?:localhost|[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?(?:\.[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?)*"
     r"\.(?:internal|local|corp|lan|home\.arpa))\b",
     "[INTERNAL_HOSTNAME]", 0.85),
    ("internal_url",
     r"(?i)\bhttps?://(?:localhost|127\.0\.0\.1|10(?:\.\d{1,3}){3}|192\.168(?:\.\d{1,3}){2}"
     r"|172\.(?:1[6-9]|2\d|3[01])(?:\.\d{1,3}){2}"
     r"|[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?(?:\.[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?)*"
     r"\.(?:internal|local|corp|lan|home\.arpa))(?::\d{1,5})?(?:/[^\s\"']*)?",
     "[INTERNAL_URL]", 0.90),
)

# Entity names and their replacements; any other entity becomes "[ENTITY]".
ENTITY_REPLACEMENTS = {
    "EMAIL_ADDRESS": "[EMAIL]",
    "PHONE_NUMBER": "[PHONE_NUMBER]",
    "PERSON": "[PERSON]",
    "CREDIT_CARD": "[CREDIT_CARD]",
    "IBAN_CODE": "[IBAN]",
    "US_SSN": "[SSN]",
    "US_PASSPORT": "[PASSPORT]",
    "LOCATION": "[LOCATION]",
    "URL": "[URL]",
}
SKIPPED_ENTITIES = ("IP_ADDRESS",)

# The pii patterns are our own: the original delegates to a language model.
PII = (
    ("email_address", r"(?i)\b[a-z0-9][a-z0-9._%+-]*@[a-z0-9.-]+\.[a-z]{2,}\b", "[EMAIL]", 1.0),
    ("phone_number", r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)|\b[0-9]{3})[ .-][0-9]{3}[ .-][0-9]{4}\b",
     "[PHONE_NUMBER]", 0.75),
    ("credit_card", r"\b[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}\b", "[CREDIT_CARD]", 1.0),
    ("iban_code", r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\b", "[IBAN]", 1.0),
    ("us_ssn", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "[SSN]", 0.85),
    ("us_passport", r"(?i)\bpassport\s*(?:number|no\.?|#)?\s*[:=#]?\s*[a-z0-9][0-9]{8}\b", "[PASSPORT]", 0.60),
    ("url", r"(?i)\bhttps?://[^\s\"'<>]+", "[URL]", 0.60),
)

# --------------------------------------------------------------------------- execution hints
_W = r"[\p{L}\p{N}_]"

_GATES = {
    "private_key": f"({_has('PRIVATE KEY-----')} AND {_has('-----END ')})",
    "jwt": _has("eyJ"),
    "bearer_token": _has_ci("bearer"),
    "api_key": f"(({_has_ci('key')} AND {_has_ci('api', 'secret')}) OR ({_has_ci('token')} AND {_has_ci('access')}))",
    "password": _has_ci('password', 'passwd', 'pwd'),
    "aws_secret_access_key": f"({_has_ci('aws')} AND {_has_ci('secret')})",
    "aws_account_id": _has_ci('account'),
    "aws_arn": _has("arn:aws"),
    "aws_session_token": f"({_has_ci('session')} AND {_has_ci('token')})",
    "gcp_api_key": _has("AIza"),
    "gcp_service_account": _has(".iam.gserviceaccount.com"),
    "gcp_project_id": _has_ci('project'),
    "azure_id": _has_ci('subscription', 'tenant', 'client'),
    "azure_client_secret": f"({_has_ci('client')} AND {_has_ci('secret')})",
    "azure_storage_connection_string": _has("DefaultEndpointsProtocol=https;AccountName="),
    "azure_sas_token": _has_ci('&sv=', '&se=', '&sr=', '&sp=', '&sig='),
    "hex_token": "rlike({x}, '[0-9a-f]{{32}}')",
    "aws_access_key_id": "rlike({x}, 'A[KSRINP][IODPVK]A[0-9A-Z]{{16}}')",
    "ipv4_address": "rlike({x}, '[.][0-9\\\\p{{Nd}}]{{1,3}}[.]')",
    "phone_number": "rlike({x}, '[0-9)][ .-][0-9]{{3}}[ .-][0-9]{{4}}')",
    "credit_card": "rlike({x}, '[0-9]{{4}}[ -]?[0-9]{{4}}[ -]?[0-9]{{4}}')",
    "iban_code": "rlike({x}, '[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11}}')",
    "us_ssn": "rlike({x}, '[0-9]-[0-9]{{2}}-[0-9]{{4}}')",
    "ipv6_address": "rlike({x}, ':[A-Fa-f0-9]{{0,4}}:')",
    "internal_hostname":
        "(contains({lc}, 'localhost')"
        " OR rlike({lc}, '[.](?:internal|local|corp|lan|home[.]arpa)'))",
    "internal_url": _has_ci("http"),
    "email_address": _has("@"),
    "us_passport": _has_ci("passport"),
    "url": _has_ci("http"),
}

_NEEDS = (
    dict.fromkeys(("api_key", "password", "aws_secret_access_key", "aws_account_id", "aws_session_token", "gcp_project_id", "azure_id",
                   "azure_client_secret"), _PAIR)
    | dict.fromkeys(("aws_access_key_id", "ipv4_address", "phone_number", "credit_card", "iban_code", "us_ssn"), _NUMBER)
    | dict.fromkeys(("bearer_token", "internal_hostname", "us_passport"), _NAMED)
    | dict.fromkeys(("internal_url", "url"), _has("://")) | {"azure_sas_token": _has("&"), "ipv6_address": _has(":")}
)

_LEADS = {
    "hex_token": "[0-9a-f]",
    "aws_access_key_id": "A",
    "ipv4_address": r"[0-9\p{Nd}]",
    "ipv6_address": "[A-Fa-f0-9]",
    "phone_number": "[+(0-9]",
    "credit_card": "[0-9]",
    "iban_code": "[A-Z]",
    "us_ssn": "[0-9]",
}

_JVM = {
    "azure_sas_token":
        r"(?iu)(?:sv|se|sr|sp|sig)=[A-Za-z0-9%+/=]++(?:&(?:sv|se|sr|sp|sig)=[A-Za-z0-9%+/=]++){3,}+",
    "internal_hostname":
        rf"(?iu)(?=[a-z0-9])(?<!{_W})(?:localhost|{_host(_SUFFIX + f'(?!{_W})')})(?!{_W})",
    "internal_url":
        rf"(?iu)(?=h)(?<!{_W})https?://(?:localhost|127\.0\.0\.1|10(?:\.\p{{Nd}}{{1,3}}){{3}}"
        rf"|192\.168(?:\.\p{{Nd}}{{1,3}}){{2}}"
        rf"|172\.(?:1[6-9]|2\p{{Nd}}|3[01])(?:\.\p{{Nd}}{{1,3}}){{2}}"
        rf"|{_host(_SUFFIX)})"
        r"(?::\p{Nd}{1,5})?(?:/[^\p{IsWhite_Space}\x1c-\x1f\"']*+)?",
}

# An address is looked for from every word start, and a long run of its characters has many. So a long run that no domain
# follows, within which no address can begin, is matched as a whole, from its beginning or where the last match ended, and dropped
# by the check: the search then takes linear time.
_LOCAL = "[a-z0-9._%+-]"
_JVM["email_address"] = (java_pattern(dict((label, p) for label, p, *_ in PII)["email_address"])
                         + rf"|(?:\G|(?<!{_LOCAL})){_LOCAL}{{256,}}+(?!{java_pattern(r'@[a-z0-9.-]+\.[a-z]{2,}\b').partition(')')[2]})")

# The opt-in stricter form: a whole token of groups and colons, which a check parses. Clock times are none.
_STRICT_IPV6 = (r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,8}(?:[0-9]{1,3}(?:\.[0-9]{1,3}){3}|[0-9A-Fa-f]{0,4})(?![\w:]|\.\w)")

_CHECKS = {"credit_card": "luhn", "iban_code": "mod97", "us_ssn": "ssn", "email_address": "at_sign"}


def _group(category: str, rows) -> list[Rule]:
    return [
        Rule(category, label, pattern, replacement, confidence, PRIORITIES[category],
             jvm=_JVM.get(label), gate=_GATES.get(label), lead=_LEADS.get(label), check=_CHECKS.get(label),
             need=_NEEDS.get(label))
        for label, pattern, replacement, confidence in rows
    ]


def secrets_rules() -> list[Rule]:
    return _group("secrets", SECRETS)


def cloud_rules() -> list[Rule]:
    return _group("cloud", CLOUD)


def network_rules() -> list[Rule]:
    return _group("network", NETWORK)


def strict_ipv6(rules: Iterable[Rule]) -> list[Rule]:
    """The rules with the IPv6 rule replaced by one that takes whole, valid addresses only, and is surer than the IPv4 rule inside them."""
    return [replace(r, pattern=_STRICT_IPV6, confidence=0.95, jvm=None, lead="[0-9A-Fa-f:]", check="ipv6") if r.label == "ipv6_address" else r for r in rules]


def pii_rules() -> list[Rule]:
    return _group("pii", PII)


_GROUPS = {"secrets": secrets_rules, "cloud": cloud_rules, "network": network_rules, "pii": pii_rules}


def default_rules(custom: Sequence[Rule] = (), pii: bool = True) -> list[Rule]:
    """Every category, listed as secrets, cloud, network, custom, pii."""
    return [*secrets_rules(), *cloud_rules(), *network_rules(), *custom, *(pii_rules() if pii else ())]


def profile_names() -> list[str]:
    return sorted(PROFILES)


def rules_for_profile(profile: str, custom: Sequence[Rule] = (), pii: bool = True) -> list[Rule]:
    """The categories of a named profile, plus custom and pii rules, which always run."""
    categories = PROFILES.get(profile.lower())
    if categories is None:
        raise ValueError(f"Unknown profile: {profile!r} (known: {', '.join(profile_names())})")
    rules = [rule for name in categories for rule in _GROUPS[name]()]
    return [*rules, *custom, *(pii_rules() if pii else ())]


def rules_dataframe(spark, items=None):
    """The rule table, one row per rule in evaluation order (tiny by construction)."""
    rules = RuleSet.of(items).ordered()
    return spark.createDataFrame(
        [(i, r.category, r.priority, r.label, r.pattern, r.replacement, float(r.confidence), r.resolved_engine())
         for i, r in enumerate(rules)],
        "rule_ord INT, category STRING, priority INT, label STRING, pattern STRING, replacement STRING,"
        " confidence DOUBLE, engine STRING")


def profiles_dataframe(spark):
    """One row per (profile, category), with the categories that always run."""
    rows = [(p, c) for p in profile_names() for c in (*PROFILES[p], *ALWAYS_ON)]
    return spark.createDataFrame(rows, "profile STRING, category STRING")
