"""Personal data and text patterns, as Column expressions over one value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sigloom.functions.numbers import col

_OCTET = r"(?:25[0-5]|2[0-4]\d|[01]?\d{1,2})"
_HEX = "[0-9A-Fa-f]"
_MONTH, _DAY, _YEAR = r"(?:0[1-9]|1[0-2])", r"(?:0[1-9]|[12]\d|3[01])", r"(?:19|20)\d\d"
_MAIL = r"[\w.%+-]+@[A-Za-z\d.-]+\.[A-Za-z]{2,}"
_UUID = "-".join(f"{_HEX}{{{n}}}" for n in (8, 4, 4, 4, 12))
_IPV4 = r"\.".join([_OCTET] * 4)
_SEP = r"[\s.-]?"

#: (type, pattern of the whole value) in order: the first that fits decides.
PII = [
    ("SSN", r"\d{3}-?\d\d-?\d{4}"),
    ("CreditCard", r"3[47]\d{13}|4\d{12}(?:\d{3})?|5[1-5]\d{14}"),
    ("CreditCard", r"\d{4}" + r"[\s-]?\d{4}" * 3),
    ("Email", _MAIL),
    ("PhoneNumber", r"(?:\+1)?" + _SEP + r"\(?\d{3}\)?" + _SEP + r"\d{3}" + _SEP + r"\d{4}"),
    ("PhoneNumber", r"\+?[1-9]\d{9,14}"),
    ("IPAddress", _IPV4),
    ("MACAddress", rf"(?:{_HEX}{{2}}[:-]){{5}}{_HEX}{{2}}"),
    ("UUID", _UUID),
    ("URL", r"(?i:https?)://[^\s#$./?]\S+"),
    ("DateOfBirth", f"{_MONTH}/{_DAY}/{_YEAR}"),
    ("DateOfBirth", f"{_YEAR}-{_MONTH}-{_DAY}"),
    ("ZipCode", r"\d{5}(?:-\d{4})?"),
    ("VIN", r"(?i:[0-9A-HJ-NPR-Z]{17})"),
    ("IBAN", r"(?i:[A-Z]{2}\d\d[\dA-Z]{4,30})"),
    ("RoutingNumber", r"\d{9}"),
    ("BankAccount", r"\d{8,17}"),
]

#: Patterns of text columns; a value may fit several.
TEXT_PATTERNS = {
    "CreditCard": r"\d{4}" + r"[\s-]?\d{4}" * 2 + r"[\s-]?\d{1,7}",
    "Currency": r"[$£€¥][\d,]+\.?\d*",
    "Date": rf"{_YEAR}[-/]{_MONTH}[-/]{_DAY}",
    "Email": _MAIL,
    "IpAddress": _IPV4,
    "Percentage": r"-?\d+\.?\d*\s*%",
    "Phone": r"\+?\(?\d{1,3}\)?" + r"[\s.-]?\d{3}" + r"[\s.-]?\d{4,6}",
    "Url": r"https?://\S+",
    "Uuid": _UUID,
}


def whole(pattern: str) -> str:
    return f"^(?:{pattern})$"


def may_be_pii(value) -> Column:
    """Whether a pattern of PII may fit: each asks for a digit, ``@``, ``:`` or ``-``, but VIN's, for 17 characters."""
    return col(value).rlike("[0-9@:-]") | (F.length(col(value)) == 17)


def pii_type(value) -> Column:
    """The first type whose pattern the whole value fits, else null."""
    out = F.when(~may_be_pii(value), F.lit(None).cast("string"))
    for name, pattern in PII:
        hit = col(value).rlike(whole(pattern))
        out = out.when(hit, name)
    return out


_NAMES = [
    ("SSN", lambda n: "ssn" in n or "social_security" in n),
    ("CreditCard", lambda n: "credit" in n and ("card" in n or "number" in n)),
    ("Email", lambda n: "email" in n or "e_mail" in n),
    ("PhoneNumber", lambda n: any(x in n for x in ("phone", "mobile", "cell"))),
    ("Address", lambda n: "address" in n or "street" in n),
    ("PersonName", lambda n: n == "name" or "first_name" in n or "last_name" in n),
    ("IPAddress", lambda n: n == "ip" or "ip_address" in n),
    ("DateOfBirth", lambda n: "dob" in n or "birth" in n),
    ("PassportNumber", lambda n: "passport" in n),
    ("DriversLicense", lambda n: "license" in n or "dl_" in n),
]


def pii_from_name(column: str) -> str | None:
    """The type that a column's name suggests; rules in order."""
    return next((kind for kind, rule in _NAMES if rule(column.lower())), None)


_HIGH = ("SSN", "CreditCard", "BankAccount", "PassportNumber")
_MIDDLE = ("Email", "PhoneNumber", "DriversLicense", "DateOfBirth")


def risk(kind, rate) -> Column:
    """Critical, High, Medium or Low; a rate over .7 raises it."""
    k, sure = col(kind), col(rate) > 0.7
    return F.when(k.isin(*_HIGH), F.when(sure, "Critical").otherwise("High")).when(k.isin(*_MIDDLE), F.when(sure, "High").otherwise("Medium")).otherwise(F.when(sure, "Medium").otherwise("Low"))


def action(level) -> Column:
    names = {"Critical": "exclude from output or hash", "High": "mask or redact", "Medium": "replace by pseudonyms", "Low": "keep; synthesise by distribution"}
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), col(level)), F.lit("none"))


def redact(value, kind) -> Column:
    """The value masked by its type; values of four characters or fewer are masked whole."""
    v, k = col(value), col(kind)
    last4, n = F.right(v, F.lit(4)), F.length(v)
    ending = F.when(F.contains(v, F.lit("@")), F.regexp_extract(v, r"(\.[^.]*)$", 1)).otherwise("")
    stars = F.repeat(F.lit("*"), F.least(n - 4, F.lit(10)))
    return (
        F.when(n <= 4, "****")
        .when(k == "SSN", F.concat(F.lit("***-**-"), last4))
        .when(k == "CreditCard", F.concat(F.lit("**** " * 3), last4))
        .when(k == "Email", F.concat(F.substring(v, 1, 2), F.lit("***@***"), ending))
        .when(k == "PhoneNumber", F.concat(F.lit("***-***-"), last4))
        .otherwise(F.concat(F.substring(v, 1, 2), stars, F.right(v, F.lit(2))))
    )


def char_classes(value) -> Column:
    """Runs of letters, digits, blanks and others as A, N, W, S."""
    # placeholders beyond the classes, so that one step's letters aren't taken by the next
    x = F.regexp_replace(col(value), r"\p{L}+", "\u0001")
    x = F.regexp_replace(x, r"\p{Nd}+", "\u0002")
    x = F.regexp_replace(x, r"\s+", "\u0003")
    x = F.regexp_replace(x, "[^\u0001\u0002\u0003]+", "S")
    return F.translate(x, "\u0001\u0002\u0003", "ANW")


def classes_regex(classes) -> Column:
    x = col(classes)
    for c, r in (("A", "<letters>+"), ("N", "<digits>+"), ("S", "<others>+"), ("W", "<blanks>+")):
        x = F.regexp_replace(x, c, r)
    for c, r in (("<letters>", "[a-zA-Z]"), ("<digits>", "[0-9]"), ("<others>", "[^a-zA-Z0-9\\s]"), ("<blanks>", "\\s")):
        x = F.replace(x, F.lit(c), F.lit(r))
    return F.concat(F.lit("^"), x, F.lit("$"))


def distribution_class(skewness, kurtosis, iqr_ratio=None) -> Column:
    """Class by skewness and raw kurtosis (3 for the normal one)."""
    s, k = col(skewness), col(kurtosis)
    r = F.lit(None).cast("double") if iqr_ratio is None else col(iqr_ratio)
    return (
        F.when((F.abs(s) < 0.5) & (F.abs(k - 3) < 1), "Normal")
        .when((k < 2) & (r > 0.4) & (r < 0.6), "Uniform")
        .when((s > 2) & (k > 10), "PowerLaw")
        .when((s > 0.5) & (k > 6), "Exponential")
        .when(s > 1, "RightSkewed")
        .when(s < -1, "LeftSkewed")
        .otherwise("Unknown")
    )
