"""Column functions over log records (no Python runs on rows)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and tables that must equal what the detectors are defined by.
INJECTION = {
    "xss": r"<\s*script|javascript:|on\w+\s*=|<\s*img[^>]+src\s*=",
    "sqli": r"union\s+select|'\s*(or|and)\s+'?\d|--\s*$|;\s*drop\s+table|select\s+.+\s+from",
    "path_trav": r"\.\./|\.\.\\|%2e%2e[%/\\]|/etc/passwd|/windows/system32",
    "cmd_inject": r";\s*(ls|cat|whoami|id|uname|wget|curl)\b|`[^`]+`|\|\s*(sh|bash|cmd)\b",
    "xxe_ssrf": r"<!entity|file://|dict://|gopher://|/proc/self",
}
#: What every text has in which a family finds anything: a character that is none of letters, digits, _ and /, or one of the paths.
SUSPECT = r"(?i)[^a-z0-9_/]|/etc/passwd|/windows/system32|/proc/self"
BENIGN_SERVICE_PORTS = (21, 22, 23, 25, 53, 67, 68, 80, 110, 123, 137, 138, 139, 143, 389, 443, 445, 465, 587, 993, 995, 1080, 1433, 1521, 3306, 3389, 5432, 5900, 6379, 8080, 8443, 8888, 27017)
PRIVATE = (("10.0.0.0", 8), ("172.16.0.0", 12), ("192.168.0.0", 16), ("127.0.0.0", 8), ("169.254.0.0", 16), ("0.0.0.0", 8), ("192.0.0.0", 29), ("192.0.2.0", 24), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("240.0.0.0", 4))
PROTOCOLS = {"TCP": "GET", "UDP": "POST", "ICMP": "OPTIONS"}
STATES = {"REQ": "GET", "CON": "POST", "FIN": "DELETE", "INT": "GET", "RST": "GET", "CLO": "GET"}
CATEGORIES = (
    ("DDoS", "DDoS"), ("Brute Force", "Brute Force"), ("FTP-Patator", "Brute Force"), ("SSH-Patator", "Brute Force"), ("DoS", "DoS"), ("Hulk", "DoS"), ("GoldenEye", "DoS"),
    ("PortScan", "Port Scan"), ("Bot", "Botnet"), ("Web Attack", "Web Attack"), ("Infiltration", "Infiltration"), ("Heartbleed", "Heartbleed"),
)
UNSW_CATEGORIES = {"normal": "Benign", "fuzzers": "Fuzzing", "analysis": "Analysis", "backdoors": "Backdoor", "backdoor": "Backdoor", "dos": "DoS", "exploits": "Exploit", "generic": "Generic Attack", "reconnaissance": "Reconnaissance", "shellcode": "Shellcode", "worms": "Worm"}
THREAT_LABELS = {"DOS": "DoS", "DDOS": "DDoS", "PORT_SCAN": "Port Scan", "BRUTE_FORCE": "Brute Force", "CREDENTIAL_STUFFING": "Brute Force", "BOT_ACTIVITY": "Botnet", "SCRAPING": "DoS", "WEB_ATTACK": "Web Attack", "UNKNOWN_ABUSE": "Other", "NONE": "Benign"}
OBJECTS, LOGINS = ("/user/", "/account/", "/profile/", "/order/"), ("/login", "/auth", "/token", "/session")
# End of the fixed values.


def endpoint_template(endpoint: Column) -> Column:
    """/port_80/x to /port_80, anything else unchanged."""
    return F.coalesce(F.nullif(F.regexp_extract(endpoint, r"^(/port_\d+)", 1), F.lit("")), endpoint)


def session_id(*parts: Column) -> Column:
    """First ten hexadecimal digits of the md5 of the parts."""
    return F.substring(F.md5(F.concat_ws("|", *parts)), 1, 10)


def or_default(c: Column, default: str) -> Column:
    """Null and its spellings to a default."""
    return F.when(c.isNull() | F.lower(F.trim(c)).isin("nan", "none", "nat", ""), F.lit(default)).otherwise(c)


def port(endpoint: Column) -> Column:
    """Text after the last /port_, up to a slash, as a number; null if it is none."""
    return F.split(F.element_at(F.split(endpoint, "/port_"), -1), "/")[0].try_cast("int")


def latency_ms(micros: Column) -> Column:
    """Microseconds to milliseconds within 0 and 10000 (P5)."""
    return F.greatest(F.lit(0.0), F.least(micros / 1000, F.lit(10000.0)))


def _lookup(key: Column, values: dict[str, str], default: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for p in values.items() for x in p))[key], default)


def method(protocol: Column) -> Column:
    """Protocol to a method; GET if unknown."""
    return _lookup(F.upper(F.trim(protocol)), PROTOCOLS, F.lit("GET"))


def state_method(state: Column) -> Column:
    """Connection state to a method; GET if unknown."""
    return _lookup(F.upper(F.trim(state)), STATES, F.lit("GET"))


def category(label: Column) -> Column:
    """Raw label to a category by ordered substrings, DDoS before DoS."""
    label, out = F.trim(label), F.lit("Other")
    for part, name in reversed(CATEGORIES):
        out = F.when(label.contains(part), name).otherwise(out)
    return F.when(label == "BENIGN", "Benign").otherwise(out)


def unsw_category(raw: Column) -> Column:
    """Category of the UNSW set; unknown ones stay, blank or null is Benign."""
    c = or_default(F.trim(raw), "normal")
    return _lookup(F.lower(c), UNSW_CATEGORIES, c)


def threat_label(threat: Column) -> Column:
    """Threat to the label of ground truth."""
    return _lookup(threat, THREAT_LABELS, threat)


def numeric_component(endpoint: Column) -> Column:
    """The first number between separators (P10)."""
    return F.nullif(F.regexp_extract(endpoint, r"[/_\-](\d+)(?:[/?#]|$)", 1), F.lit("")).try_cast("bigint")


def decoded(endpoint: Column) -> Column:
    """Percent-decoding that keeps a plus and leaves bad escapes."""
    return F.coalesce(F.try_url_decode(F.replace(endpoint, F.lit("+"), F.lit("%2B"))), endpoint)


def injection(endpoint: Column, family: str) -> Column:
    """1 if the decoded endpoint matches a family of injections."""
    return decoded(endpoint).rlike("(?i)" + INJECTION[family]).cast("int")


def ip_number(ip: Column) -> Column:
    """A dotted quad as a number; null if it is none."""
    parts = F.split(ip, r"\.")
    number = sum((parts[i].try_cast("long") * (1 << 8 * (3 - i)) for i in range(4)), F.lit(0))
    return F.when(ip.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), number)


def is_private(ip: Column) -> Column:
    """Reserved addresses, and whatever is no address."""
    n = ip_number(ip)
    inside = F.lit(False)
    for base, bits in PRIVATE:
        low = sum(int(x) << 8 * (3 - i) for i, x in enumerate(base.split(".")))
        inside = inside | n.between(low, low + (1 << (32 - bits)) - 1)
    return F.coalesce(inside, F.lit(True))


def off_hours(ts: Column) -> Column:
    """0 to 5 hours UTC."""
    return F.hour(ts) < 6


def confidence_level(score: Column) -> Column:
    return F.when(score >= 0.75, "HIGH").when(score >= 0.45, "MEDIUM").otherwise("LOW")


def request_path(line: Column, body: Column) -> Column:
    """Path of a request line's url, with ?body where there is one."""
    path = F.try_parse_url(F.split(line, " ")[0], F.lit("PATH"))
    return F.concat(path, F.when(F.length(F.trim(F.coalesce(body, F.lit("")))) > 0, F.concat(F.lit("?"), body)).otherwise(""))


def port_endpoint(port_text: Column) -> Column:
    """A port to its endpoint; missing to /port_0, hexadecimal to /port_unknown."""
    return F.when(port_text.isNull() | (F.trim(port_text) == ""), "/port_0").when(port_text.rlike("(?i)^0x"), "/port_unknown").otherwise(F.concat(F.lit("/port_"), F.coalesce(port_text.try_cast("double").cast("int").cast("string"), F.lit("unknown"))))


def owasp(endpoint: Column) -> Column:
    """API1 for access to objects, API2 for authentication, else null (P20)."""
    low = F.lower(endpoint)
    has = lambda parts: F.greatest(*(F.instr(low, x) for x in parts)) > 0
    return F.when(has(OBJECTS), "API1").when(has(LOGINS), "API2")


def explanation(is_attack: Column, threat: Column, confidence: Column, sent: Column, signals: Column, found: Column) -> Column:
    """Lines that tell a verdict (P22): head, compound signals, triage, and what the agents that fired found."""
    head = F.concat(F.when(is_attack, F.lit("ATTACK ")).otherwise("benign "), threat, F.lit(" confidence="), F.format_number(confidence, 3))
    each = lambda name, lines: F.transform(lines, lambda x: F.concat(F.lit(f"{name}: "), x))
    return F.concat_ws("\n", head, each("compound", signals), F.concat(F.lit("triage: "), F.array_join(sent, ", ")), each("found", F.slice(found, 1, 3)))
